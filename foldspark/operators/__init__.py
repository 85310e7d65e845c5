"""DataFrame operators: folds, models, transforms, diagnostics, projection, selection."""
