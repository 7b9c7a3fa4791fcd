"""URL filters: rules for a host with its subdomains and a path prefix, looked up by hashes of a URL's expressions.

Every address (host and path of a URL) becomes the expressions that could be a rule: a host suffix of as many labels as some
rule has, with a path prefix of a length that such a rule has. Addresses, not rows, are expanded, so a URL or page that
repeats costs one address. Expressions meet rules by the first 32 bits of their SHA-256; of what met, the full digests are
compared, and of the rules that fit an address the longest decides (host and path together; then the longer host).

All of it is SQL functions. The join of expressions and rules is left to Spark's size estimates: a rule table that is small
is broadcast, a large one is shuffled, where Spark splits prefixes that very many addresses share.

Defined cases: a URL that is null or without "://" has an empty host and path and no rule; a rule with a null or empty host
or one with a slash, a path that neither is empty nor begins with a slash, or a verdict other than allow or block is no rule; of two rules for one host and path, block counts. Hosts keep
a port or user part, and then end in no suffix of another host. Columns of the input that are called host, path, rule or
verdict give way to the results; all others stay, whatever their names.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hazardlens.functions.rows import evaluate_once
from hazardlens.llm.common import written

RESULTS = ("host", "path", "rule", "verdict")
VERDICTS = ("allow", "block")
_UPPER, _LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"


def lowered(text: Column) -> Column:
    """A-Z in lower case, all other letters as they are."""
    return F.translate(text, _UPPER, _LOWER)


def address(url: Column) -> tuple[Column, Column]:
    """Host and path of a URL, both empty where there is no "://"."""
    at = F.coalesce(F.instr(url, "://"), F.lit(0))
    rest = F.when(at > 0, F.substring(url, at + 3, F.length(url))).otherwise(F.lit(""))
    return lowered(F.regexp_extract(rest, r"^[^/?#]*", 0)), F.regexp_extract(rest, r"^[^/?#]*([^?#]*)", 1)


def labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."), F.lit(""))) + 1


def digest(host: Column, path: Column) -> Column:
    """A host has no slash and a path is empty or begins with one, so the text says both."""
    return F.sha2(F.concat(host, path), 256)


def short(full: Column) -> Column:
    """The first 32 bits of a digest in hexadecimal."""
    return F.conv(F.substring(full, 1, 8), 16, 10).cast("bigint")


def rule_table(rules: DataFrame) -> DataFrame:
    """(r_host, r_path, r_verdict, full, prefix): one row per host and path that is a rule."""
    host, path, verdict = lowered(F.col("host")), F.col("path"), F.col("verdict")
    usable = (F.length(host) > 0) & path.isNotNull() & verdict.isin(*VERDICTS) & ~host.contains("/") & ((path == "") | path.startswith("/"))
    one = rules.select(host.alias("r_host"), path.alias("r_path"), verdict.alias("r_verdict"), usable.alias("usable")).filter("usable")
    one = one.groupBy("r_host", "r_path").agg(F.max("r_verdict").alias("r_verdict"))
    full = digest(F.col("r_host"), F.col("r_path"))
    return one.withColumns({"full": full, "prefix": short(full)})


def shapes(rules: DataFrame) -> list[tuple[int, int]]:
    """The (labels, path length) that rules have; there are no more than a rule has labels and characters, however many rules."""
    found = rules.select(labels(F.col("r_host")).alias("k"), F.length("r_path").alias("n")).distinct()
    return sorted((r["k"], r["n"]) for r in found.collect())


def expressions(addresses: DataFrame, wanted: list[tuple[int, int]]) -> DataFrame:
    """(a_host, a_path, k, n, prefix): the hashed expressions of each address, for the wanted shapes that it has."""
    have = labels(F.col("a_host"))
    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(n).alias("n")) for k, n in wanted])
    own = F.filter(every, lambda s: (F.col("a_host") != "") & (s["k"] <= have) & (s["n"] <= F.length("a_path")))
    out = addresses.withColumn("have", have).select("a_host", "a_path", F.inline(own))
    return out.withColumn("prefix", short(digest(*expression())))


def expression() -> tuple[Column, Column]:
    """The host suffix and path prefix of (a_host, a_path, k, n)."""
    return F.call_function("substring_index", F.col("a_host"), F.lit("."), -F.col("k")), F.left(F.col("a_path"), F.col("n"))


def best_rules(addresses: DataFrame, rules: DataFrame) -> DataFrame:
    """(a_host, a_path, rule, verdict) of the addresses that a rule fits."""
    table = rule_table(rules)
    wanted = shapes(table)
    none = "a_host string, a_path string, rule string, verdict string"
    if not wanted:
        return addresses.sparkSession.createDataFrame([], none)
    met = expressions(addresses, wanted).join(table, "prefix")
    checked = evaluate_once(met, "r_host", "r_path", "r_verdict", (digest(*expression()) == F.col("full")).alias("fits"), beside=["a_host", "a_path"])
    text = F.concat("r_host", "r_path")
    order = F.struct(F.length(text).alias("all"), F.length("r_host").alias("host"), text.alias("rule"), F.col("r_verdict").alias("verdict"))
    best = checked.filter("fits").groupBy("a_host", "a_path").agg(F.max(order).alias("best"))
    return best.select("a_host", "a_path", "best.rule", "best.verdict")


def judge(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows of ``pages`` with host, path, the rule that decides (``host`` and path, null if none) and the verdict.

    ``rules`` has host, path and verdict (allow or block); ``default`` is the verdict where no rule fits. The rules found
    are written once, so that the join back to the rows deals both sides anew and Spark can split a very frequent address.
    """
    kept = [c for c in pages.columns if c not in RESULTS]
    held = pages.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(kept)], *[c.alias(n) for c, n in zip(address(F.col(f"`{url}`")), ("a_host", "a_path"))])
    addresses = held.select("a_host", "a_path").distinct()
    found = written(best_rules(addresses, rules), "url_rules").withColumnsRenamed({"a_host": "f_host", "a_path": "f_path"})
    out = held.join(found, (F.col("a_host") == F.col("f_host")) & (F.col("a_path") == F.col("f_path")), "left")
    return out.select(
        *[F.col(f"p{i}").alias(c) for i, c in enumerate(kept)],
        F.col("a_host").alias("host"), F.col("a_path").alias("path"), "rule", F.coalesce("verdict", F.lit(default)).alias("verdict"),
    )


def allowed(pages: DataFrame, rules: DataFrame, url: str = "url", default: str = "allow") -> DataFrame:
    """The rows whose URL is not blocked, with the columns they came with; only a null in ``url`` is judged by ``default``."""
    held = pages.select(*[F.col(f"`{c}`").alias(f"p{i}") for i, c in enumerate(pages.columns)])
    passed = judge(held, rules, f"p{pages.columns.index(url)}", default).filter(F.col("verdict") == "allow")
    return passed.select(*[F.col(f"p{i}").alias(c) for i, c in enumerate(pages.columns)])
