"""Pipelines of operators and presets."""
