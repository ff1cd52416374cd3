"""All queries of the library by name, with their SQL."""

from skytile.plans import piece_queries, pixel_queries, sink_queries, source_queries  # noqa: F401  (they register theirs)
from skytile.plans.queries import QUERIES, SQL

__all__ = ["QUERIES", "SQL"]
