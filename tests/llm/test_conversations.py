from __future__ import annotations

import hashlib
import random
import re
import zlib
from functools import lru_cache

import pytest
from pyspark.sql import functions as F

from hazardlens.llm import conversations as C

GRAMMAR = re.compile(r"(s?(ua)+)?")
EMPTY = hashlib.sha256(b"").hexdigest()


def cheapest(initials: str, states: bytes) -> tuple[int, str, str]:
    """All edit sequences that give a string of the grammar, by trying them all."""
    n = len(initials)

    @lru_cache(None)
    def best(i: int, made: str):
        out = [(0, "", made)] if i == n and GRAMMAR.fullmatch(made) else []
        if i < n:
            add = lambda cost, edit, rest: rest and out.append((rest[0] + cost, edit + rest[1], rest[2]))
            add(2, "D", best(i + 1, made))
            if states[i] != C.MUST_GO and len(made) < n + 4:
                stay = 5 * (states[i] == C.CUT)
                add(stay, "K", best(i + 1, made + initials[i]))
                for role in "ua":
                    add(stay + 1, "R", best(i + 1, made + role))
        if len(made) < n + 4 and (made[-1:] not in "ua" or re.fullmatch(r"s?(ua)*u?", made)):
            for role in "ua":
                if re.fullmatch(r"s?(ua)*u?", made + role):
                    rest = best(i, made + role)
                    if rest:
                        out.append((rest[0] + 5, "I" + rest[1], rest[2]))
        return min(out) if out else None

    return best(0, "")


def random_turns(rnd, n):
    return "".join(rnd.choice("ssuuaax" if rnd.random() < 0.5 else "ua") for _ in range(n)), bytes(rnd.choice((0, 0, 0, 1, 2)) for _ in range(n))


def test_alignment_against_all_edits():
    rnd = random.Random(5)
    for k in range(400):
        initials, states = random_turns(rnd, k % 7)
        want = cheapest(initials, states)
        own = initials.replace("x", "?")
        assert C.align_lengths(own, states) == want[:2], (initials, states)
        assert C.align_folded(own, states) == want[:2], (initials, states)


def test_bands_and_folded_table_agree_on_longer_ones():
    rnd = random.Random(6)
    for k in range(25):
        initials, states = random_turns(rnd, 8 + 2 * k)
        own = initials.replace("x", "?")
        assert C.align_lengths(own, states) == C.align_folded(own, states)


def test_a_bound_below_the_cost_gives_nothing():
    assert C.align_to("uu", b"\0\0", "ua", 0) is None
    assert C.align_to("uu", b"\0\0", "ua", 1) == (1, "KR")
    assert C.align_to("u", b"\0", "uaua", 14) is None
    assert C.align_to("u", b"\0", "uaua", 15) == (15, "IIKI") or C.align_to("u", b"\0", "uaua", 15)[0] == 15


def brute(rows):
    """Contract columns and repaired turns of conversations rows (conv_id, turn, role, text) after damage."""
    groups: dict = {}
    for conv, turn, role, text in rows:
        role, text = " " if role is None else role, " " if text is None else text
        name = f"{' ' if conv is None else conv}:{' ' if turn is None else turn}"
        fault = zlib.crc32(name.encode()) % 20
        own = groups.setdefault(conv, [])
        if fault == 1:
            text = ""
        if fault == 2:
            text = re.sub("[.!?]", "", text)
        if fault == 4:
            role = "user"
        own += [] if fault == 0 else [(turn, role, text)] * (2 if fault == 3 else 1)
    out = {}
    for conv, turns in groups.items():
        turns.sort(key=lambda t: (t[0] is not None, t[0] or 0, t[1].encode(), t[2].encode()))
        known = [t[0] for t in turns if t[0] is not None]
        gaps = max(known) - min(known) + 1 - len(set(known)) if known else 0
        states, seen = [], set()
        for _, role, text in turns:
            solid = re.findall(r"[^\x20\x09-\x0D]", text)
            states.append("blank" if not solid else "duplicate" if (role, text) in seen else "truncated" if solid[-1] not in ".!?" else "")
            seen.add((role, text))
        initials = [role[:1] for _, role, _ in turns]
        illegal = sum(a + b not in ("su", "ua", "au") for a, b in zip(initials, initials[1:]))
        codes = bytes({"": 0, "truncated": 2}.get(s, 1) for s in states)
        cost, audit, made = cheapest("".join(i or "x" for i in initials), codes) if turns else (0, "", "")
        lines, at, place = [], 0, 0
        for edit in audit:
            if edit != "I":
                _, role, text = turns[at]
                at += 1
            if edit != "D":
                new = {"u": "user", "a": "assistant"}.get(made[place])
                lines.append(("K", role, text) if edit == "K" else ("R", new, text) if edit == "R" else ("I", new, ""))
                place += 1
        sha = hashlib.sha256("\n".join(f"{r}:{t}" for _, r, t in lines).encode()).hexdigest()
        out[conv] = (gaps, *(states.count(x) for x in ("blank", "duplicate", "truncated")), illegal, cost, audit, sha), lines
    return out


def frame(spark, rows):
    df = spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")
    return df.withColumns({c: F.lit(c) for c in ("cost", "audit", "initial", "edit", "place", "_", "dotted.name")})


def made_rows(n, rnd):
    texts = ["Yes.", "No!", "And", " ", "", None, "Why?\n", "…", "a.b", "é?\u0085", "Long. " * 30]
    roles = ["user", "assistant", "user", "assistant", "system", "tool", "", None, "sys"]
    return [
        (None if rnd.random() < 0.05 else rnd.randint(0, n), None if rnd.random() < 0.1 else rnd.randint(-2, 3), rnd.choice(roles), rnd.choice(texts))
        for _ in range(3 * n)
    ]


@pytest.mark.parametrize("which", ["made", "given", "empty"])
def test_against_brute_force(spark, small, which):
    if which == "given":
        rows = [tuple(r) for r in spark.read.parquet(f"{small}/conversations.parquet").select("conv_id", "turn", "role", "text").collect()]
    else:
        rows = [] if which == "empty" else [r for r in made_rows(60, random.Random(8)) if r[0] is not None] + made_rows(1, random.Random(9))
    want = brute(rows)
    got = {r["conv_id"]: tuple(r)[1:] for r in C.repair(C.damaged(frame(spark, rows))).collect()}
    assert got == {k: v[0] for k, v in want.items()}
    turns: dict = {k: [] for k in want}
    for r in sorted(C.repaired_turns(C.damaged(frame(spark, rows))).collect(), key=lambda r: r["place"]):
        turns[r["conv_id"]].append((r["edit"], r["role"], r["text"]))
    assert turns == {k: v[1] for k, v in want.items()}


def test_one_hot_conversation_with_long_texts(spark, monkeypatch):
    """Far over LONG turns and over the bytes held in memory; texts of a megabyte."""
    monkeypatch.setattr(C, "HELD_BYTES", 1 << 16)
    rows = [(7, i, ("user", "assistant")[i % 2], f"{i} " + "x" * (1_500_000 if i == 5 else 50) + ".") for i in range(3000)]
    df = spark.createDataFrame(rows + [(8, 0, "user", "Hi.")], "conv_id long, turn long, role string, text string")
    got = {r["conv_id"]: r for r in C.repair(df).collect()}
    assert (got[7]["cost"], got[7]["audit"]) == (0, "K" * 3000)
    assert got[7]["repaired_sha256"] == hashlib.sha256("\n".join(f"{r}:{t}" for _, _, r, t in rows).encode()).hexdigest()
    assert (got[8]["cost"], got[8]["audit"], got[8]["repaired_sha256"]) == (2, "D", EMPTY)


def test_query_columns(spark, small):
    from hazardlens.llm.queries import queries

    out = queries()["op12_conversation_repair"](spark, small)
    assert out.dtypes[0] == ("conv_id", "bigint") and {t for _, t in out.dtypes[1:7]} == {"bigint"}
    assert out.count() == spark.read.parquet(f"{small}/conversations.parquet").select("conv_id").distinct().count()
