"""Operators of the validation engine."""
