"""Streaming of the validation engine."""
