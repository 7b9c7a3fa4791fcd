"""Row projections that Catalyst does not take apart."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def evaluate_once(rows: DataFrame, *columns: Column | str, beside: list[str] | None = None) -> DataFrame:
    """Project ``columns`` so that later filters on them are not pushed into the expressions.

    Columns ``beside`` them pass as they are, and filters on those still go down to the scan.

    A filter above a plain projection is rewritten to the projected expression. Where that is a
    parser or a deep CASE, every mention of the column evaluates it again; the output of a
    one-element inline is not rewritten.
    """
    return rows.select(*(beside or []), F.inline(F.array(F.struct(*columns))))
