"""plans of the layered-table engine."""
