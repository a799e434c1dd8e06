"""All registered queries, section by section."""

from panelforge.plans import (  # noqa: F401
    queries_aggregates,
    queries_cleaning,
    queries_columns,
    queries_growth,
    queries_inference,
    queries_joins,
    queries_plots,
    queries_windows,
)
from panelforge.plans.registry import QUERIES

__all__ = ["QUERIES"]
