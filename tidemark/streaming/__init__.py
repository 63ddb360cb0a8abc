"""streaming of the layered-table engine."""
