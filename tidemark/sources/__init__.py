"""sources of the layered-table engine."""
