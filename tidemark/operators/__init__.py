"""operators of the layered-table engine."""
