"""Stateful and windowed operators on streams."""
