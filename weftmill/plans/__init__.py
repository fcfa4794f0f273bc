"""Whole queries composed of operators, with their SQL twins."""
