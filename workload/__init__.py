"""Registered queries over the given tables, each with its SQL where SQL can express it."""

from __future__ import annotations

from workload.registry import ORACLES, QUERIES  # noqa: F401
from workload import (  # noqa: F401,E402  isort:skip
    dimensions,
    joins,
    filters,
    features,
    timing,
    scalars,
    modules,
    outputs,
    files,
)
