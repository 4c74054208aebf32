"""Functions of the validation engine."""
