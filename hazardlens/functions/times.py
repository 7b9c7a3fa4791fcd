"""Times from text, zone-free and in UTC."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

EPOCH = "TIMESTAMP_NTZ'1970-01-01 00:00:00'"
_ZONED = r"\d{1,2}:\d{2}\S*(Z|[+-]\d{2}:?\d{2})$"


def utc_from_text(text: Column) -> Column:
    """A time in UTC: one with an offset or Z is moved to UTC, one without counts as UTC; NULL where unreadable."""
    own = F.regexp_replace(F.trim(text), r"(:\d{2}\S*[+-]\d{2})(\d{2})$", "$1:$2")
    micros = F.unix_micros(own.try_cast("timestamp")).cast("decimal(20,0)")
    moved = F.expr(EPOCH) + F.make_dt_interval(secs=(micros / F.lit(1_000_000).cast("decimal(7,0)")).cast("decimal(18,6)"))
    return F.when(own.rlike(_ZONED), moved).otherwise(own.try_cast("timestamp_ntz"))
