"""The registered queries of the engine's own operators, each with its DuckDB SQL where SQL can say it."""

from armwise.plans import answers, draws, fits, matches, records, reports, splits, tables  # noqa: F401  they register
from armwise.plans.catalog import ORACLE_SQL, QUERIES

__all__ = ["ORACLE_SQL", "QUERIES"]
