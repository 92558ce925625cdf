"""Every registered query of the library outside the training-data subpackage, with its oracle SQL."""

from __future__ import annotations

from loomline.plans import boxes, choices, columns, files, graphs, intervals, profiles, records, relational, scalars, state, trees, values  # noqa: F401
from loomline.plans.registry import ORACLES, QUERIES

FLAGSHIP = "pricing_summary"


def queries() -> dict:
    return dict(QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(ORACLES)
