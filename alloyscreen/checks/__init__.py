"""Registered queries over the driver's tables, each next to the SQL that must give the same rows."""

from alloyscreen.checks import (  # noqa: F401
    aggregate_checks,
    cleaning_checks,
    expression_checks,
    join_checks,
    model_checks,
    ranking_checks,
    scan_checks,
    stream_checks,
)
from alloyscreen.checks.core import ORACLES, QUERIES  # noqa: F401
