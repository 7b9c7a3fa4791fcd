"""Cross-tokenizer alignment: how the tokens of two tokenizers overlap in each text, and which id pairs go together.

Both tokenizers spell every text as the same bytes, so a token is a byte range. Walking both lists together, the pair of
tokens at hand always overlaps: it is a link, then the one that ends first moves on, and where both end is a cut. A block
of texts is walked in lockstep: one state vector holds the two pointers of every text, each step emits a link for each and
the cuts among them, and texts that are done leave the vector. A long text enters as several lanes that begin at cuts, so
that the vector stays full to the end; lanes of one text and texts are treated alike.

Null, empty, invalid UTF-8 or texts that a tokenizer does not spell back byte by byte have no tokens: zeros and an empty
digest. Rows are documents, also where two have one id or one text. Only the id and text columns are read, so other columns
and their names do not matter. Texts are handled in blocks of a megabyte of whole texts; a longer one is a block of its own.
"""

from __future__ import annotations

import hashlib
import json
from collections.abc import Iterator
from dataclasses import dataclass
from functools import lru_cache
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hazardlens.llm import kernel
from hazardlens.llm.common import written

BLOCK_BYTES = 1 << 20
#: Tokens after which a lane ends at the next cut.
LANE = 256
#: Distinct id pairs whose counts are sent to the tasks whole, 16 bytes each; more are joined by a shuffle.
MOST_PAIRS = 1 << 22
SPACE = "▁"
# How byte-level vocabularies split text before merging.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""


@dataclass(frozen=True)
class Files:
    """What two tokenizer files hold: a byte-level BPE as JSON and a piece model; a few megabytes that tasks get whole."""

    byte_level: bytes
    pieces: bytes


def tokenizer_files(folder: str, byte_level: str = "byte_bpe_50k.json", pieces: str = "piece_bpe_32k.model") -> Files:
    return Files(Path(folder, byte_level).read_bytes(), Path(folder, pieces).read_bytes())


class Spelling:
    """The bytes of every id of a vocabulary, end to end."""

    def __init__(self, tokens: list[bytes]):
        self.length = np.array([len(t) for t in tokens], np.int64)
        self.start = np.cumsum(self.length) - self.length
        self.flat = np.frombuffer(b"".join(tokens), np.uint8)

    def __len__(self) -> int:
        return len(self.length)

    def spell(self, ids: np.ndarray) -> bytes:
        n = self.length[ids]
        at = np.repeat(self.start[ids] - (np.cumsum(n) - n), n) + np.arange(int(n.sum()))
        return self.flat[at].tobytes()


def byte_alphabet() -> dict[str, int]:
    """Byte-level vocabularies write a byte as a printable character: itself, or the next free one from U+0100 on."""
    own = [b for b in range(256) if 33 <= b <= 126 or 161 <= b <= 172 or 174 <= b <= 255]
    rest = [b for b in range(256) if b not in own]
    return {chr(b): b for b in own} | {chr(256 + k): b for k, b in enumerate(rest)}


class Tokenizers:
    """Both tokenizers of ``Files``, with ids as arrays."""

    def __init__(self, files: Files):
        import sentencepiece
        import tiktoken
        from tokenizers import Tokenizer

        self.plain = Tokenizer.from_buffer(files.byte_level)
        self.plain.encode_special_tokens = True
        told = json.loads(files.byte_level)
        special = {t["content"] for t in told["added_tokens"]}
        letters, vocabulary = byte_alphabet(), self.plain.get_vocab()
        spelled = [b""] * (max(vocabulary.values()) + 1)
        for token, i in vocabulary.items():
            spelled[i] = token.encode() if token in special else bytes(letters[c] for c in token)
        self.a = Spelling(spelled)
        # Where merges are in the order of the ids they make, a rank encoder gives the same ids several times faster.
        made = [vocabulary.get("".join(m.split(" ") if isinstance(m, str) else m)) for m in told["model"]["merges"]]
        self.ranks = None
        if None not in made and made == sorted(set(made)):
            ranks = {spelled[i]: i for t, i in vocabulary.items() if t not in special}
            self.ranks = tiktoken.Encoding("byte level", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.pieces = sentencepiece.SentencePieceProcessor(model_proto=files.pieces)
        n = self.pieces.get_piece_size()
        names = [self.pieces.id_to_piece(i) for i in range(n)]
        self.b = Spelling([bytes([int(p[3:5], 16)]) if self.pieces.is_byte(i) else p.replace(SPACE, " ").encode() for i, p in enumerate(names)])

    def encode_a(self, text: str) -> np.ndarray:
        if self.ranks is not None:
            try:
                return np.array(self.ranks.encode_ordinary(text), np.int64)
            except BaseException as e:  # its pattern engine gives up on endless runs of one kind of character
                if isinstance(e, (KeyboardInterrupt, SystemExit)):
                    raise
        return np.array(self.plain.encode(text, add_special_tokens=False).ids, np.int64)

    def encode_b(self, text: str) -> np.ndarray:
        return np.array(self.pieces.encode(text), np.int64)

    def both(self, raw: bytes) -> tuple[np.ndarray, np.ndarray]:
        """Ids of a text by both, none where it is empty or either does not spell it back behind a space."""
        none = np.zeros(0, np.int64), np.zeros(0, np.int64)
        try:
            text = raw.decode()
        except UnicodeDecodeError:
            return none
        if not text:
            return none
        a, b = self.encode_a(" " + text), self.encode_b(text)
        want = b" " + raw
        return (a, b) if self.a.spell(a) == want == self.b.spell(b) else none


@lru_cache(maxsize=2)
def loaded(files: Files) -> Tokenizers:
    return Tokenizers(files)


@dataclass
class Walk:
    """Links (token numbers of a and b) in order, and at which tokens both end."""

    a: np.ndarray
    b: np.ndarray
    cut_a: np.ndarray
    cut_b: np.ndarray


def lanes(end_a: np.ndarray, end_b: np.ndarray, text_a: np.ndarray, lane: int) -> tuple[np.ndarray, np.ndarray]:
    """Where lanes end, as token numbers of a and b: at the end of each text, and at the first cut after each ``lane`` tokens.

    ``text_a`` are the numbers of the tokens that texts begin and end with, one more than there are texts.
    """
    marks = np.concatenate([np.arange(lo + lane, hi, lane) for lo, hi in zip(text_a[:-1], text_a[1:]) if hi - lo > lane] or [np.zeros(0, np.int64)])
    open_ = np.arange(len(marks))
    while len(open_):
        at = np.searchsorted(end_b, end_a[marks[open_] - 1])
        open_ = open_[end_b[at] != end_a[marks[open_] - 1]]
        marks[open_] += 1
    stop_a = np.unique(np.concatenate([text_a[1:], marks]))
    stop_a = stop_a[stop_a > 0]
    return stop_a, np.searchsorted(end_b, end_a[stop_a - 1]) + 1


def lockstep(end_a: np.ndarray, end_b: np.ndarray, stop_a: np.ndarray, stop_b: np.ndarray) -> Walk:
    """Walk all lanes at once. ``end_*`` are byte ends through the whole block; a link's numbers sum to its own slot."""
    slots = len(end_a) + len(end_b)
    link_a, link_b = np.full(slots, -1, np.int64), np.full(slots, -1, np.int64)
    cut_a, cut_b = np.zeros(len(end_a), bool), np.zeros(len(end_b), bool)
    i = np.concatenate([[0], stop_a[:-1]]) if len(stop_a) else np.zeros(0, np.int64)
    j = np.concatenate([[0], stop_b[:-1]]) if len(stop_b) else np.zeros(0, np.int64)
    stop = stop_a
    while len(i):
        slot, ea, eb = i + j, end_a[i], end_b[j]
        link_a[slot], link_b[slot] = i, j
        both = ea == eb
        cut_a[i[both]] = True
        cut_b[j[both]] = True
        i, j = i + (ea <= eb), j + (eb <= ea)
        going = i < stop
        if not going.all():
            i, j, stop = i[going], j[going], stop[going]
    used = link_a >= 0
    return Walk(link_a[used], link_b[used], cut_a, cut_b)


_DIGITS: dict[int, tuple[np.ndarray, np.ndarray]] = {}


def digits(size: int) -> tuple[np.ndarray, np.ndarray]:
    """Decimal digits of all numbers below ``size``, one row each, left-aligned, and how many there are."""
    if size not in _DIGITS:
        texts = np.array([str(k) for k in range(size)], "S")
        _DIGITS[size] = np.frombuffer(texts.tobytes(), np.uint8).reshape(size, -1), np.char.str_len(texts)
    return _DIGITS[size]


def group_texts(a: np.ndarray, b: np.ndarray, walk: Walk, text_a: np.ndarray, text_b: np.ndarray, size: int) -> list[bytes]:
    """``a1,a2|b1;a3|b2,b3`` for each text: the ids between cuts, a's before b's."""
    table, count = digits(size)
    before_a = np.concatenate([[0], np.cumsum(walk.cut_a)])[:-1]  # the group of each token
    before_b = np.concatenate([[0], np.cumsum(walk.cut_b)])[:-1]
    last_a, last_b = np.flatnonzero(walk.cut_a), np.flatnonzero(walk.cut_b)
    begin_b = np.concatenate([[0], last_b[:-1] + 1]) if len(last_b) else last_b
    place = np.empty(len(a) + len(b), np.int64)  # ids and separators in the order they are written
    mark = np.full(len(place), ord(","), np.uint8)
    at_a = np.arange(len(a)) + begin_b[before_a] if len(a) else np.zeros(0, np.int64)
    at_b = np.arange(len(b)) + last_a[before_b] + 1 if len(b) else np.zeros(0, np.int64)
    place[at_a], place[at_b] = a, b
    mark[at_a[walk.cut_a]], mark[at_b[walk.cut_b]] = ord("|"), ord(";")
    width = table.shape[1]
    wide = np.empty((len(place), width + 1), np.uint8)
    wide[:, :width] = table[place]
    n = count[place]
    wide[np.arange(len(place)), n] = mark
    out = wide[np.arange(width + 1) <= n[:, None]].tobytes()
    ends = np.concatenate([[0], np.cumsum(n + 1)])
    edges = ends[text_a + text_b]
    return [out[lo : max(lo, hi - 1)] for lo, hi in zip(edges[:-1], edges[1:])]


def walk_texts(both: list[tuple[np.ndarray, np.ndarray]], tokens: Tokenizers, lane: int = LANE) -> dict[str, object]:
    """Counts, group texts and distinct linked pairs (with their numbers of links) of some texts."""
    text_a = np.concatenate([[0], np.cumsum([len(x) for x, _ in both])]).astype(np.int64)
    text_b = np.concatenate([[0], np.cumsum([len(y) for _, y in both])]).astype(np.int64)
    a, b = np.concatenate([x for x, _ in both]), np.concatenate([y for _, y in both])
    end_a, end_b = np.cumsum(tokens.a.length[a]), np.cumsum(tokens.b.length[b])
    walk = lockstep(end_a, end_b, *lanes(end_a, end_b, text_a, lane))
    text = np.searchsorted(text_a, walk.a, "right") - 1
    space = len(tokens.a) * len(tokens.b)
    keys, times = np.unique(text * space + a[walk.a] * len(tokens.b) + b[walk.b], return_counts=True)
    return {
        "n_a": np.diff(text_a), "n_b": np.diff(text_b),
        "n_groups": np.diff(np.concatenate([[0], np.cumsum(walk.cut_a)])[text_a]),
        "n_links": np.bincount(text, minlength=len(both)),
        "groups": group_texts(a, b, walk, text_a, text_b, max(len(tokens.a), len(tokens.b))),
        "edges": np.searchsorted(keys // space, np.arange(len(both) + 1)), "pairs": keys % space, "times": times,
    }


_SCAN = "n_a long, n_b long, n_groups long, n_links long, groups_sha256 string, pairs array<long>, times array<int>"


def scan(docs: DataFrame, files: Files, text: str = "text", key: str = "doc_id", spell_out: bool = False) -> DataFrame:
    """One row per document: its counts, the digest of its groups, its distinct linked pairs (a id x b size + b id) and
    how often each is linked; with ``spell_out`` also the groups themselves, in ``groups``. Narrow: nothing is shuffled."""
    sent = docs.sparkSession.sparkContext.broadcast(files)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokens = loaded(sent.value)
        for batch in batches:
            for block in kernel.blocks(batch.column(1), BLOCK_BYTES):
                raw = block.data.tobytes()
                both = [tokens.both(raw[lo:hi]) for lo, hi in zip(block.edges[:-1], block.edges[1:])]
                out = walk_texts(both, tokens)
                edges = pa.array(out["edges"], pa.int32())
                columns = [batch.column(0).slice(block.first, len(block)), *(pa.array(out[c], pa.int64()) for c in ("n_a", "n_b", "n_groups", "n_links"))]
                columns.append(pa.array([hashlib.sha256(g).hexdigest() if g else "" for g in out["groups"]]))
                columns.append(pa.ListArray.from_arrays(edges, pa.array(out["pairs"], pa.int64())))
                columns.append(pa.ListArray.from_arrays(edges, pa.array(out["times"], pa.int32())))
                if spell_out:
                    columns.append(pa.array([g.decode() for g in out["groups"]]))
                yield pa.RecordBatch.from_arrays(columns, [key, "n_a", "n_b", "n_groups", "n_links", "groups_sha256", "pairs", "times", *(["groups"] if spell_out else [])])

    kind = docs.schema[key].dataType.simpleString()
    schema = f"`{key}` {kind}, {_SCAN}" + (", groups string" if spell_out else "")
    return docs.select(F.col(f"`{key}`"), F.col(f"`{text}`")).mapInArrow(work, schema)


def pair_counts(scanned: DataFrame) -> DataFrame:
    """(pair, n): in how many documents a pair is linked. Tasks add their own documents first."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held, size = [], 0

        def combined() -> pa.RecordBatch:
            pairs, n = np.unique(np.concatenate(held), return_counts=True)
            return pa.RecordBatch.from_arrays([pa.array(pairs, pa.int64()), pa.array(n, pa.int64())], ["pair", "n"])

        for batch in batches:
            held.append(batch.column(0).flatten().to_numpy())
            size += len(held[-1])
            if size > 1 << 22:
                yield combined()
                held, size = [], 0
        if held:
            yield combined()

    return scanned.select("pairs").mapInArrow(add, "pair long, n long").groupBy("pair").agg(F.sum("n").alias("n"))


def weighed(scanned: DataFrame, counts: DataFrame, size_b: int, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """``scanned`` with n_best and count_sum in place of its pairs. Up to ``most_pairs`` counts go to the tasks whole; more are
    joined, by rows (document, pair), with the same result."""
    kept = [c for c in scanned.columns if c not in ("pairs", "times")]
    if counts.count() > most_pairs:
        best = counts.groupBy(F.expr(f"pair div {size_b}").alias("a")).agg(F.max("n").alias("top"))
        numbered = scanned.withColumn("_row", F.monotonically_increasing_id())
        links = numbered.select("_row", F.inline(F.arrays_zip("pairs", "times")).alias("pair", "links"))
        marked = counts.withColumn("a", F.expr(f"pair div {size_b}")).join(best, "a").select("pair", "n", (F.col("n") == F.col("top")).alias("is_best"))
        sums = links.join(marked, "pair").groupBy("_row").agg(
            F.sum(F.when(F.col("is_best"), F.col("links")).otherwise(0)).alias("n_best"), F.sum(F.col("n") * F.col("links")).alias("count_sum")
        )
        zero = [F.coalesce(c, F.lit(0)).cast("long").alias(c) for c in ("n_best", "count_sum")]
        return numbered.join(sums, "_row", "left").select(*kept, *zero)
    table = counts.toArrow()
    pairs, n = table.column("pair").to_numpy(), table.column("n").to_numpy()
    order = np.argsort(pairs)
    sent = scanned.sparkSession.sparkContext.broadcast((pairs[order], n[order]))

    def look_up(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        pairs, n = sent.value
        first = np.flatnonzero(np.diff(pairs // size_b, prepend=-1))  # a's pairs lie together
        top = np.repeat(np.maximum.reduceat(n, first), np.diff(first, append=len(n))) if len(n) else n
        for batch in batches:
            own, times = (batch.column(k) for k in (batch.num_columns - 2, batch.num_columns - 1))
            at = np.searchsorted(pairs, own.flatten().to_numpy())
            links = times.flatten().to_numpy().astype(np.int64)
            edges = np.concatenate([[0], np.cumsum(own.value_lengths().to_numpy())])
            sums = [np.diff(np.concatenate([[0], np.cumsum(x)])[edges]) for x in (links * (n[at] == top[at]), links * n[at])]
            yield pa.RecordBatch.from_arrays([*batch.columns[:-2], *(pa.array(s, pa.int64()) for s in sums)], [*kept, "n_best", "count_sum"])

    types = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in scanned.schema.fields if f.name in kept)
    return scanned.select(*kept, "pairs", "times").mapInArrow(look_up, f"{types}, n_best long, count_sum long")


def align(docs: DataFrame, files: Files, text: str = "text", key: str = "doc_id", spell_out: bool = False, most_pairs: int = MOST_PAIRS) -> DataFrame:
    """One row per document: n_a, n_b, n_groups, n_links, groups_sha256 [, groups], n_best (links whose pair is in as many
    documents as any pair of its a id) and count_sum (documents of the pair, over all links)."""
    scanned = written(scan(docs, files, text, key, spell_out), "linked")
    counts = written(pair_counts(scanned), "pair_counts")
    return weighed(scanned, counts, len(loaded(files).b), most_pairs)
