"""Part of the tidelake engine."""
