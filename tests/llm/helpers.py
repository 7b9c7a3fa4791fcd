from __future__ import annotations

import re

import pandas as pd

WORD = re.compile(r"[^\x20\x09-\x0D]+")


def lower(text: str) -> str:
    return "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in text)


def words(text: str | None) -> list[str]:
    return WORD.findall(text or "")


def docs_frame(spark, rows, extra=True):
    """documents-like rows (doc_id, text[, lang, source]); with columns whose names operators may use inside."""
    full = [(r[0], r[1], r[2] if len(r) > 2 else "en", r[3] if len(r) > 3 else "src0", None if r[1] is None else len(r[1])) for r in rows]
    df = spark.createDataFrame(full, "doc_id long, text string, lang string, source string, n_chars long")
    if extra:
        from pyspark.sql import functions as F

        df = df.withColumns({c: F.lit(c) for c in ("h", "x", "n", "cell", "mark", "kept", "start", "node", "root", "label", "rep", "block", "kind")})
    return df


def sample(small: str) -> list[tuple]:
    return [tuple(r) for r in pd.read_parquet(f"{small}/documents.parquet")[["doc_id", "text", "lang", "source"]].itertuples(index=False, name=None)]


ODD = [
    (1, None), (2, ""), (3, " \t\n "), (4, "one"), (5, "one two three four five six seven eight nine ten eleven twelve thirteen fourteen"),
    (6, "x one two three four five six seven eight nine ten eleven twelve thirteen y"), (6, "x one two three four five six seven eight nine ten eleven twelve thirteen y"),
    (7, "ä " * 9000 + "Öl é   \u0085 z"), (None, "one two three four five six seven eight nine ten eleven twelve thirteen"), (None, None), (8, "a b " * 40), (9, "A B " * 40 + "tail"),
]
