"""Incremental operators on streams."""
