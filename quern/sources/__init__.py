"""Table sources."""

from quern.sources.tables import TABLES, read_table, register_views

__all__ = ["TABLES", "read_table", "register_views"]
