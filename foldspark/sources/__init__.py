"""Where bars come from and where they are kept."""
