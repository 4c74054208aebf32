"""Plans of the validation engine."""
