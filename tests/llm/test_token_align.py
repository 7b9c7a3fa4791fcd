from __future__ import annotations

import hashlib
from collections import Counter

import numpy as np
import pytest
import sentencepiece
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from hazardlens.llm import token_align as T
from tests.llm.helpers import sample

FOLDER = "/opt/tokenizers"
ODD = [
    (1, None), (2, ""), (3, " "), (4, "  two  blanks \n\t"), (5, "▁"), (6, "<|endoftext|> </s> <0x41> <s>"), (7, "naïve café Ωμέγα 漢字 😀👩‍👩‍👧"), (8, "x"),
    (8, "x"), (None, "x y z"), (9, "a" * 5000), (10, "one two three " * 90000), (11, "A\u0000B\u0085\ufeff"), (12, "it's  'll\r\n 1234567 -- ??"), (None, None),
]


@pytest.fixture(scope="module")
def files():
    return T.tokenizer_files(FOLDER)


def brute(rows):
    """Encoding by the public libraries alone, byte ends in dictionaries, links by comparing ranges."""
    plain = Tokenizer.from_file(f"{FOLDER}/byte_bpe_50k.json")
    plain.encode_special_tokens = True
    pieces = sentencepiece.SentencePieceProcessor(model_file=f"{FOLDER}/piece_bpe_32k.model")
    letters = T.byte_alphabet()

    def spell_b(i):
        p = pieces.id_to_piece(int(i))
        return bytes([int(p[3:5], 16)]) if pieces.is_byte(int(i)) else p.replace("\u2581", " ").encode()

    def ends(tokens):
        return np.cumsum([len(t) for t in tokens]).tolist()

    told, held = [], Counter()
    for doc, text in rows:
        a = plain.encode(" " + (text or ""), add_special_tokens=False).ids
        b = pieces.encode(text or "")
        bytes_a, bytes_b = [bytes(letters[c] for c in plain.id_to_token(i)) for i in a], [spell_b(i) for i in b]
        want = (" " + (text or "")).encode()
        if not text or b"".join(bytes_a) != want or b"".join(bytes_b) != want:
            told.append((doc, [], [], [], ""))
            continue
        ea, eb = ends(bytes_a), ends(bytes_b)
        links, j = [], 0
        for i in range(len(a)):
            lo = ea[i - 1] if i else 0
            while eb[j] <= lo:
                j += 1
            k = j
            while k < len(b) and (eb[k - 1] if k else 0) < ea[i]:
                links.append((a[i], b[k]))
                k += 1
        cuts = sorted(set(ea) & set(eb))
        groups, i, j = [], 0, 0
        for c in cuts:
            x, y = ea.index(c, i) + 1, eb.index(c, j) + 1
            groups.append(",".join(map(str, a[i:x])) + "|" + ",".join(map(str, b[j:y])))
            i, j = x, y
        told.append((doc, a, b, links, ";".join(groups)))
        held.update(set(links))
    top: dict = {}
    for (x, _), n in held.items():
        top[x] = max(top.get(x, 0), n)
    return [
        (doc, len(a), len(b), g.count("|"), len(links), sum(held[p] == top[p[0]] for p in links), sum(held[p] for p in links), hashlib.sha256(g.encode()).hexdigest() if g else "", g)
        for doc, a, b, links, g in told
    ]


def frame(spark, rows):
    return spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit(c) for c in ("pairs", "times", "n_a", "pair", "n", "_row", "groups", "dotted.name")})


COLUMNS = ["doc_id", "n_a", "n_b", "n_groups", "n_links", "n_best", "count_sum", "groups_sha256", "groups"]


@pytest.mark.parametrize("most_pairs", [T.MOST_PAIRS, 0])
@pytest.mark.parametrize("which", ["odd", "given", "empty"])
def test_against_brute_force(spark, small, files, which, most_pairs):
    rows = {"odd": ODD, "given": [r[:2] for r in sample(small)], "empty": []}[which]
    out = T.align(frame(spark, rows), files, spell_out=True, most_pairs=most_pairs)
    got = [tuple(r) for r in out.select(*COLUMNS).collect()]
    assert sorted(got, key=str) == sorted(brute(rows), key=str)


@pytest.mark.parametrize("lane", [1, 7, 10**9])
def test_lanes_change_nothing(files, lane):
    tokens = T.loaded(files)
    both = [tokens.both((text or "").encode()) for _, text in ODD if len(text or "") < 10000]
    want, got = (T.walk_texts(both, tokens, x) for x in (T.LANE, lane))
    assert want["groups"] == got["groups"]
    assert all(np.array_equal(want[k], got[k]) for k in want if k != "groups")


def test_rank_encoder_equals_the_library_and_falls_back(files):
    tokens = T.loaded(files)
    assert tokens.ranks is not None
    for _, text in ODD:
        own = " " + (text or "")
        assert tokens.encode_a(own).tolist() == tokens.plain.encode(own, add_special_tokens=False).ids
    assert len(tokens.encode_a(" " * 1_000_000)) > 0


def test_invalid_text_has_no_tokens(spark, files):
    bad = spark.sql("SELECT 1L AS doc_id, CAST(X'61ff62' AS STRING) AS text UNION ALL SELECT 2L, 'ab'")
    got = {r["doc_id"]: (r["n_a"], r["n_links"], r["groups_sha256"]) for r in T.align(bad, files).collect()}
    assert got[1] == (0, 0, "") and got[2][0] > 0
