"""Feature matrix, stacked hurdle models, conformal intervals, metrics and diagnostics."""
