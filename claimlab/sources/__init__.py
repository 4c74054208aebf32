"""Sources of the validation engine."""
