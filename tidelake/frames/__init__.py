"""Versioned frames: a spine with typed columns, changed by four closed operations."""
