"""Operators on panels: features, signals, evaluation, multiple testing, validation."""
