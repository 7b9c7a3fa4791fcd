"""Secret scan with multipart credential linking, in DataFrame operations only.

Each text is cut by each pattern into gaps and hits; the running sum of their lengths gives spans in code points.
The parts of a text, ordered by start, then look at the nearest part of each role before and after them: that is the
interval join of identifiers, secrets and endpoints within ``SCOPE`` code points, without listing pairs. Strong parts
always stand; a weak candidate is reported only where the parts that complete it lie in its scope.
"""

from __future__ import annotations

from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.llm.common import written

SCOPE = 300
ROLES = ("identifier", "secret", "endpoint")


@dataclass(frozen=True)
class Kind:
    """``least``: code points that ``group`` of a hit needs; ``needs``: the roles that a weak hit needs in scope."""

    name: str
    role: str
    pattern: str
    group: int = 0
    least: int = 1
    needs: tuple[str, ...] = ()


def _any_case(word: str) -> str:
    return "".join(f"[{c.upper()}{c}]" if c.isalpha() else c for c in word)


def _named(*words: str) -> str:
    return "(" + "|".join(_any_case(w) for w in words) + ")"


_VALUE = r"""["']?\x20*[:=]\x20*["']?"""
BASE = (
    Kind("assign", "secret", _named("password", "passwd", "secret", "token", "api_?key") + _VALUE + "([A-Za-z0-9+/_.=-]+)", 2, 6),
    # a run of 20 or 24 is found whole or not at all, so the length stands in the pattern
    Kind("access", "identifier", "AKIA[A-Z0-9]{16,}"),
    Kind("hex", "secret", "[0-9a-f]{24,}"),
)
LINKED = (
    Kind("login", "identifier", _named("client_id", "user_?name", "login", "account") + _VALUE + "([A-Za-z0-9@+/_.-]+)", 2, 3, ("secret",)),
    Kind("blob", "secret", r"[A-Za-z0-9+/]{40,}={0,2}", 0, 40, ("identifier",)),
    Kind("endpoint", "endpoint", r"https?://[A-Za-z0-9.-]+(:[0-9]+)?[A-Za-z0-9/._~%?&=-]*", 0, 10, ("identifier", "secret")),
)
KINDS = BASE + LINKED


def _hits(text: Column, kind: Kind, number: int) -> Column:
    """(kind, number of the hit, gap before it, its length, does it pass) for the hits of one pattern, else empty."""
    pattern = F.lit(kind.pattern)
    gaps = F.split(text, kind.pattern, -1)
    passes = lambda hit: F.length(F.regexp_extract(hit, kind.pattern, kind.group)) >= kind.least
    found = F.zip_with(
        F.regexp_extract_all(text, pattern, F.lit(0)), gaps,
        lambda hit, gap: F.struct(F.length(gap).alias("gap"), F.length(hit).alias("size"), passes(hit).alias("good")),
    )
    rows = F.transform(
        F.filter(found, lambda x: x["size"].isNotNull()),
        lambda x, i: F.struct(F.lit(number).alias("kind"), i.alias("nth"), x["gap"].alias("gap"), x["size"].alias("size"), x["good"].alias("good")),
    )
    return F.when(text.rlike(kind.pattern), rows).otherwise(F.array().cast("array<struct<kind:int,nth:int,gap:int,size:int,good:boolean>>"))


def parts(docs: DataFrame) -> DataFrame:
    """(doc_id, mark, kind, start, end, strong, reported): every part of every text; a text without one has a row of nulls.

    Reads doc_id and text. A null text is empty. Rows equal in both are one text; other rows that share a doc_id are
    told apart by ``mark``, their text's hash. ``start`` and ``end`` are code points, the end exclusive.
    """
    text = F.coalesce("text", F.lit(""))
    every = F.concat(*[_hits(F.col("text"), k, i) for i, k in enumerate(KINDS)])
    rows = docs.select("doc_id", text.alias("text")).select("doc_id", F.xxhash64("text").alias("mark"), F.explode_outer(every).alias("hit"))
    rows = rows.select("doc_id", "mark", "hit.*").repartition("doc_id", "mark").distinct()
    key = ["doc_id", "mark"]
    upto = Window.partitionBy(*key, "kind").orderBy("nth").rowsBetween(Window.unboundedPreceding, 0)
    end = F.sum(F.col("gap") + F.col("size")).over(upto)
    rows = rows.withColumn("end", end).withColumn("start", F.col("end") - F.col("size")).filter("kind is null or good")

    strong = F.col("kind") < len(BASE)
    role = F.element_at(F.array(*[F.lit(ROLES.index(k.role)) for k in KINDS]), F.col("kind") + 1)
    rows = rows.withColumns({"strong": strong, "role": role})
    order = Window.partitionBy(*key).orderBy("start", "kind")
    before, after = order.rowsBetween(Window.unboundedPreceding, -1), order.rowsBetween(1, Window.unboundedFollowing)
    rows = rows.withColumn("covered", F.max(F.when(F.col("strong"), F.col("end"))).over(before))
    rows = rows.withColumn("follows", F.min(F.when(F.col("strong"), F.col("start"))).over(after))
    # a weak hit that overlaps a strong one is the same part seen twice
    rows = rows.filter("kind is null or strong or not (coalesce(covered > start, false) or coalesce(follows < end, false))")
    near = {}
    for i, name in enumerate(ROLES):
        last = F.max(F.when(F.col("role") == i, F.col("end"))).over(before)
        next_ = F.min(F.when(F.col("role") == i, F.col("start"))).over(after)
        near[name] = F.coalesce(F.col("start") - last <= SCOPE, F.lit(False)) | F.coalesce(next_ - F.col("end") <= SCOPE, F.lit(False))
    rows = rows.withColumns({f"near_{k}": v for k, v in near.items()})
    complete = F.lit(False)
    for i, k in enumerate(KINDS):
        if k.needs:
            own = F.lit(True)
            for r in k.needs:
                own = own & F.col(f"near_{r}")
            complete = complete | ((F.col("kind") == i) & own)
    return rows.select(*key, "kind", "start", "end", "strong", (F.col("strong") | complete).alias("reported"))


def scan(docs: DataFrame) -> DataFrame:
    """(doc_id, n_assign, n_access, n_hex, n_weak, base array, found array): one row for each distinct (doc_id, text).

    ``base`` lists the spans of the base kinds as kind:start:end by start, then kind; ``found`` adds the weak parts
    that their complements complete. Other columns are not read; an empty table gives no rows.
    """
    rows = parts(docs)
    name = F.element_at(F.array(*[F.lit(k.name) for k in KINDS]), F.col("kind") + 1)
    span = F.struct("start", "kind", F.concat_ws(":", name, "start", "end").alias("span"))
    listed = lambda which: F.transform(F.sort_array(F.collect_list(F.when(which, span))), lambda x: x["span"])
    counts = [F.count_if((F.col("kind") == i) & F.col("reported")).alias(f"n_{k.name}") for i, k in enumerate(BASE)]
    return rows.groupBy("doc_id", "mark").agg(
        *counts, F.count_if(~F.col("strong") & F.col("reported")).alias("n_weak"),
        listed(F.col("strong")).alias("base"), listed(F.col("reported")).alias("found"),
    ).drop("mark")


def redact(docs: DataFrame, mask: str = "[SECRET]") -> DataFrame:
    """The documents with each reported span of their text replaced; overlapping spans are one. All columns stay.

    A text without a reported part, a null text and every other column come back as they were.
    """
    spans = parts(docs).filter("reported").groupBy("doc_id", "mark").agg(F.sort_array(F.collect_list(F.struct("start", "end"))).alias("spans"))
    spans = written(spans, "secret_spans")
    s = spans.select(F.col("doc_id").alias("_id"), F.col("mark").alias("_mark"), F.col("spans").alias("_spans"))
    joined = docs.withColumn("_own", F.xxhash64(F.coalesce("text", F.lit("")))).join(
        s, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("_own") == F.col("_mark")), "left"
    )
    state = F.struct(F.array().cast("array<string>").alias("pieces"), F.lit(0).cast("long").alias("at"))

    def step(a, x):
        piece = F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.greatest(x["start"] - a["at"], F.lit(0)).cast("int"))
        fresh = x["start"] >= a["at"]
        more = F.when(fresh, F.concat(a["pieces"], F.array(piece, F.lit(mask)))).otherwise(a["pieces"])
        return F.struct(more.alias("pieces"), F.greatest(a["at"], x["end"]).alias("at"))

    def finish(a):
        return F.concat(F.array_join(a["pieces"], ""), F.substring(F.col("text"), (a["at"] + 1).cast("int"), F.length("text")))

    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.aggregate("_spans", state, step, finish))
    return joined.withColumn("text", text).select(*docs.columns)


def base_sql() -> str:
    """The base and linked spans in DuckDB's SQL, written from the same list of kinds."""
    quoted = lambda x: "'" + x.replace("'", "''") + "'"
    one = " UNION ALL ".join(
        f"SELECT doc_id, {i} AS kind, generate_subscripts(hits, 1) AS nth, hits, gaps FROM (SELECT doc_id, regexp_extract_all(text, {quoted(k.pattern)}) AS hits,"
        f" string_split_regex(text, {quoted(k.pattern)}) AS gaps FROM d)" for i, k in enumerate(KINDS)
    )
    good = " ".join(f"WHEN {i} THEN length(regexp_extract(hits[nth], {quoted(k.pattern)}, {k.group})) >= {k.least}" for i, k in enumerate(KINDS))
    case = lambda f: "CASE kind " + " ".join(f"WHEN {i} THEN {f(k)}" for i, k in enumerate(KINDS)) + " END"
    near = ", ".join(
        f"(coalesce(start - max(CASE WHEN role = {i} THEN stop END) OVER w1 <= {SCOPE}, false) OR coalesce(min(CASE WHEN role = {i} THEN start END) OVER w2 - stop <= {SCOPE}, false)) AS near_{r}"
        for i, r in enumerate(ROLES)
    )
    done = case(lambda k: " AND ".join(f"near_{r}" for r in k.needs) or "true")
    names = case(lambda k: quoted(k.name))
    return f"""
WITH d AS (SELECT doc_id, coalesce(text, '') AS text FROM documents), one AS ({one}),
placed AS (SELECT doc_id, kind, length(hits[nth]) AS size, CASE kind {good} END AS good,
  sum(length(gaps[nth]) + length(hits[nth])) OVER (PARTITION BY doc_id, kind ORDER BY nth) AS stop FROM one),
part AS (SELECT doc_id, kind, stop - size AS start, stop, kind < {len(BASE)} AS strong, {case(lambda k: str(ROLES.index(k.role)))} AS role FROM placed WHERE good),
seen AS (SELECT *, max(CASE WHEN strong THEN stop END) OVER w1 AS covered, min(CASE WHEN strong THEN start END) OVER w2 AS follows FROM part
  WINDOW w1 AS (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w2 AS (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
single AS (SELECT * FROM seen WHERE strong OR NOT (coalesce(covered > start, false) OR coalesce(follows < stop, false))),
near AS (SELECT *, {near} FROM single
  WINDOW w1 AS (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         w2 AS (PARTITION BY doc_id ORDER BY start, kind ROWS BETWEEN 1 FOLLOWING AND UNBOUNDED FOLLOWING)),
told AS (SELECT *, strong OR {done} AS reported, {names} || ':' || start::BIGINT || ':' || stop::BIGINT AS span FROM near),
per AS (SELECT doc_id, count(*) FILTER (WHERE kind = 0) AS n_assign, count(*) FILTER (WHERE kind = 1) AS n_access, count(*) FILTER (WHERE kind = 2) AS n_hex,
  count(*) FILTER (WHERE reported AND NOT strong) AS n_weak, string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE strong) AS base,
  string_agg(span, ',' ORDER BY start, kind) FILTER (WHERE reported) AS spans FROM told GROUP BY doc_id)
SELECT doc_id, coalesce(n_assign, 0) AS n_assign, coalesce(n_access, 0) AS n_access, coalesce(n_hex, 0) AS n_hex,
  sha256(coalesce(base, '')) AS base_sha256, coalesce(spans, '') AS spans, coalesce(n_weak, 0) AS n_weak
FROM d LEFT JOIN per USING (doc_id)"""
