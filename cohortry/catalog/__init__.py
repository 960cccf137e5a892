"""Ready-made queries over the shared test tables, each with its SQL counterpart where SQL can say it."""

from __future__ import annotations

from cohortry.catalog.base import ORACLES, QUERIES
from cohortry.catalog import (  # noqa: F401  (importing registers the queries)
    clusters,
    features,
    profiling,
    reports,
    runs,
    selection,
    text,
)
