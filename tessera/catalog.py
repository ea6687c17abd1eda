"""All registered queries and their DuckDB twins."""

from tessera.queries import relational, scalars, series, supersets, surveyed  # noqa: F401  they register themselves
from tessera.queries.base import ORACLES, QUERIES

__all__ = ["ORACLES", "QUERIES"]
