"""Registered queries: each pairs a call of the library with the SQL that checks it."""

from . import (  # noqa: F401  (importing registers the cases)
    aggregates, features, insights, joins, models, projections, ranking, sources, statistics, streams, text,
)
from .registry import CASES, ORACLES  # noqa: F401
