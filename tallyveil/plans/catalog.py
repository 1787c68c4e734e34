"""All registered queries."""

from __future__ import annotations

from tallyveil.plans import analysis, counting, models, preparation, release, reports  # noqa: F401
from tallyveil.plans.registry import CATALOG, Query


def load() -> dict[str, Query]:
    return CATALOG
