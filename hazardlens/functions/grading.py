"""Severity grades and vulnerability labels from parameter tables."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hazardlens import params


def grade(value: Column, table, unknown: str = params.UNKNOWN_GRADE) -> Column:
    """First severity whose upper bound exceeds ``value``; a missing value is ``unknown``."""
    out = F.when(value.isNull() | F.isnan(value), F.lit(unknown))
    for name, upper in table:
        out = out.otherwise(F.lit(name)) if upper is None else out.when(value < F.lit(upper), F.lit(name))
    return out


def vulnerability_label(index: Column, table=None) -> Column:
    """First label whose lower bound the index reaches."""
    out = None
    for name, lower in table or params.VULNERABILITY_LABELS:
        if lower is None:
            return out.otherwise(F.lit(name))
        test = index >= F.lit(lower)
        out = F.when(test, F.lit(name)) if out is None else out.when(test, F.lit(name))
    return out


def alert_limit(event_type: Column, severity: Column, limits=None) -> Column:
    """The alert limit of (type, severity) as a CASE over the parameter table, NULL if none."""
    out = None
    for kind, by_severity in (limits or params.ALERT_LIMITS).items():
        for name, limit in by_severity.items():
            test = (event_type == kind) & (severity == name)
            out = F.when(test, F.lit(float(limit))) if out is None else out.when(test, F.lit(float(limit)))
    return out
