"""functions of the layered-table engine."""
