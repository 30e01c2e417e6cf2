"""Named queries over the driver tables, each with the SQL it must agree with."""

from relief.queries.registry import all_queries, all_sql

__all__ = ["all_queries", "all_sql"]
