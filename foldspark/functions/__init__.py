"""Column expressions: causal features and forward-looking targets."""
