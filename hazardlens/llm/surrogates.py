"""PII surrogates: every detected entity gets a keyed replacement of its own type, gender, script and format.

A replacement is a function of a secret key, the type and the normal form of the entity, so the same entity is replaced alike
in every document and spelling. The table of all distinct entities is checked: two entities of a type never share a
replacement, and no replacement is itself an entity of the corpus; whatever collides is drawn again. Replacements then
join the distinct (text, entity) pairs, so a very common entity or a text with many copies stays small.
"""

from __future__ import annotations

import hashlib
import hmac
import re
from collections.abc import Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from hazardlens.llm.common import written

MOST_DRAWS = 64
#: After so many draws a replacement may leave its format: one character more each time, an address in a wider range.
WIDER = 8
# Titles and the gender they tell.
TITLES = {
    "Mr": "m", "Mrs": "f", "Ms": "f", "Miss": "f", "Sir": "m", "Lady": "f", "Herr": "m", "Frau": "f", "Señor": "m", "Señora": "f", "Sr": "m", "Sra": "f",
    "Monsieur": "m", "Madame": "f", "Mme": "f", "Dr": "n", "Prof": "n", "г-н": "m", "г-жа": "f", "Κος": "m", "Κα": "f",
}
#: Syllables and endings by script: consonants, vowels, then endings of given names by gender and of surnames.
SCRIPTS = {
    "latin": ("bdfgklmnprstv", "aeiou", {"m": "o", "f": "a", "n": "i"}, ("son", "man", "er")),
    "cyrillic": ("бвгдзклмнпрст", "аеиоу", {"m": "ан", "f": "ина", "n": "и"}, ("ов", "ин", "ко")),
    "greek": ("βγδζκλμνπρστ", "αειου", {"m": "ος", "f": "η", "n": "ι"}, ("ου", "ιδης", "ας")),
}
_GENDER = {t.casefold(): g for t, g in TITLES.items()}
_TITLE = "|".join(sorted(map(re.escape, TITLES), key=len, reverse=True))
_FIRST = "".join(sorted({c for t in TITLES for c in t[0].lower() + t[0].upper()}))
PATTERNS = (
    ("email", r"(?<![\w.%+-])[\w.%+-]++@(?:[\w-]++\.)+[^\W\d_]{2,}"),
    ("iban", r"(?<!\w)[A-Z]{2}\d{2}(?: ?[A-Z0-9]{4}){2,7}(?: ?[A-Z0-9]{1,3})?(?!\w)"),
    ("card", r"(?<![\w+])(?:\d[ -]?){12,18}\d(?!\w)"),
    ("ssn", r"(?<![\w-])\d{3}-\d{2}-\d{4}(?![\w-])"),
    ("ip", r"(?<![\w.])(?:(?:25[0-5]|2[0-4]\d|1?\d?\d)\.){3}(?:25[0-5]|2[0-4]\d|1?\d?\d)(?!\w|\.\d)"),
    ("phone", r"(?<![\w+])\+\d{1,3}(?:[ .-]?\(\d{1,4}\))?(?:[ .-]?\d){4,24}(?!\w)|(?<![\w+(])(?:\+\d{1,3}[ .-]?)?(?:\(\d{2,4}\)[ .-]?)?\d{2,4}(?:[ .-]\d{2,4}){1,4}(?!\w)"),
    ("name", rf"(?<!\w)(?=[{_FIRST}])(?i:{_TITLE})\.? +(?:[^\W\d_][\w'’-]*)(?: [^\W\d_][\w'’-]*){{0,2}}"),
)
_FIND = re.compile("|".join(f"(?P<{k}>{p})" for k, p in PATTERNS))
#: A text without any of this holds no entity; for Spark's filter.
MAY_HOLD = rf"[0-9@]|(?=[{_FIRST}])(?iu:{_TITLE})\.? "
_POSSESSIVE = re.compile(r"(?:['’][sS]?|-)+$")


@dataclass(frozen=True)
class Mention:
    start: int
    end: int
    kind: str
    norm: str


def script_of(word: str) -> str:
    c = word[0].lower()
    return "cyrillic" if "а" <= c <= "я" or c == "ё" else "greek" if "α" <= c <= "ω" or c in "άέήίόύώ" else "latin"


def find(text: str) -> list[Mention]:
    """Mentions of a text from left to right, none over another. A name is a mention for each of its words.

    Names are found after a title in any case; a title and a name both in capitals are left. What a title has made known
    as a name is a mention wherever else it stands in the text, in the same case or capitalised.
    """
    out, people = [], []
    for m in _FIND.finditer(text):
        kind, value = m.lastgroup, m.group()
        if kind == "email":
            out.append(Mention(m.start(), m.end(), kind, value.lower()))
        elif kind == "phone":
            digits = re.sub(r"\D", "", value)
            if len(digits) >= 7 and (value[0] in "+(" or len(re.findall(r"[ .-]", value)) >= 2):
                out.append(Mention(m.start(), m.end(), kind, ("+" if value[0] == "+" else "") + digits))
        elif kind == "name":
            title = re.match(rf"(?i:{_TITLE})\.?", value).group()
            words = [w for w in re.finditer(r"[^\W\d_][\w'’-]*", value[len(title) :])]
            upto = next((i for i, w in enumerate(words) if not w.group()[0].isupper()), len(words))
            if title.isupper() and all(w.group().isupper() for w in words[:upto]):
                continue
            for i, w in enumerate(words[:upto]):
                a, name = m.start() + len(title) + w.start(), _POSSESSIVE.sub("", w.group())
                people.append((a, name, _GENDER[title.rstrip(".").casefold()] if i < upto - 1 else "", upto > 1))
        else:
            out.append(Mention(m.start(), m.end(), kind, value if kind == "ip" else re.sub(r"[ -]", "", value)))
    return sorted(out + _named(text, out, people), key=lambda x: x.start) if people else out


def _named(text: str, others: list[Mention], people: list[tuple[int, str, str, bool]]) -> list[Mention]:
    """Mentions of the words of names (place, word, gender of a given name, one of several words) and of the same words elsewhere."""
    surnames = {name.lower() for _, name, gender, several in people if several and not gender}
    given: dict[str, str] = {}
    for _, name, gender, _ in people:
        if gender and given.get(name.lower(), "n") == "n":
            given[name.lower()] = gender

    def mention(a: int, name: str, gender: str) -> Mention:
        what = f"given_{given[name.lower()] if gender == 'n' else gender}" if gender else "surname"
        return Mention(a, a + len(name), f"{what}_{script_of(name)}", name.lower())

    def alone(name: str) -> str:
        return "" if name.lower() in surnames else given.get(name.lower(), "")

    out = [mention(a, name, gender if several else alone(name)) for a, name, gender, several in people]
    taken = {i for m in others + out for i in range(m.start, m.end)}
    forms = {form for _, name, _, _ in people if len(name) > 1 for form in (name, name[0] + name[1:].lower())}
    for form in sorted(forms, key=lambda x: (-len(x), x)):
        a = text.find(form)
        while a >= 0:
            b = a + len(form)
            whole = not (a and (text[a - 1].isalnum() or text[a - 1] == "_")) and not (b < len(text) and (text[b].isalnum() or text[b] == "_"))
            if whole and taken.isdisjoint(range(a, b)):
                out.append(mention(a, form, alone(form)))
                taken.update(range(a, b))
            a = text.find(form, b)
    return out


def luhn(digits: str) -> int:
    """The sum that is a multiple of ten for a valid number."""
    return sum(int(c) if i % 2 == 0 else (2 * int(c)) // 10 + (2 * int(c)) % 10 for i, c in enumerate(reversed(digits)))


class _Draws:
    """Choices from a keyed stream of bytes."""

    def __init__(self, key: bytes, *what: str):
        self.key, self.what, self.at, self.held = key, "\x1f".join(what).encode(), 0, b""

    def below(self, n: int) -> int:
        if len(self.held) < 4:
            self.held += hmac.new(self.key, self.what + self.at.to_bytes(4, "big"), hashlib.sha256).digest()
            self.at += 1
        value, self.held = int.from_bytes(self.held[:4], "big"), self.held[4:]
        return value * n >> 32

    def like(self, text: str) -> str:
        """As many characters of the same kinds: digits, Latin letters by case, all others as they are."""
        return "".join(
            str(self.below(10)) if c.isdigit() else chr(97 + self.below(26)) if "a" <= c <= "z" else chr(65 + self.below(26)) if "A" <= c <= "Z"
            else "aeiou"[self.below(5)] if c.isalpha() else c for c in text
        )


def surrogate(key: bytes, kind: str, norm: str, draw: int) -> str:
    """The draw-th replacement of an entity's normal form, itself in normal form; wider than it if many draws were taken."""
    d, more = _Draws(key, kind, norm, str(draw)), draw // WIDER
    if kind == "email":
        local, domain = norm.rsplit("@", 1)
        labels, top = domain.rsplit(".", 1)
        return f"{d.like(local + 'a' * more)}@{_Draws(key, 'domain', domain).like(labels)}.{top}"
    if kind == "ip":
        own = norm.split(".")
        kept = 1 if own[0] == "10" else 2 if own[:2] == ["192", "168"] else 0
        if kept == 2 and more:  # still private, but of 254 times as many
            own, kept = ["10", *own[1:]], 1
        if more > 2:
            kept = 0
        return ".".join([*own[:kept], *[str(1 + d.below(254)) for _ in own[kept:]]])
    if kind == "card":
        body = norm[0] + "".join(str(d.below(10)) for _ in norm[2:] + "0" * more)
        check = next(str(c) for c in range(10) if luhn(f"{body}{c}") % 10 == 0)
        return body + (check if luhn(norm) % 10 == 0 else str((int(check) + 1 + d.below(9)) % 10))
    if kind == "iban":
        body = d.like(norm[4:] + "0" * more)
        check = 98 - int("".join(str(int(c, 36)) for c in body + norm[:2] + "00")) % 97
        return f"{norm[:2]}{check:02d}{body}"
    if kind == "ssn":
        return f"{1 + d.below(665):03d}{1 + d.below(99):02d}{1 + d.below(9999):04d}" + d.like("0" * more)
    if kind == "phone":
        kept = 0 if norm[0] != "+" else 2 if norm[1] in "17" else 3
        rest = [str(d.below(10)) for _ in norm[kept:] + "0" * more]
        return norm[:kept] + str(2 + d.below(8)) + "".join(rest[1:])
    what, *_, script = kind.split("_")
    consonants, vowels, endings, families = SCRIPTS[script]
    stem = "".join(consonants[d.below(len(consonants))] + vowels[d.below(len(vowels))] for _ in range(2 + d.below(2) + draw))
    last = consonants[d.below(len(consonants))]
    return stem + (families[d.below(len(families))] if what == "surname" else last + endings[kind.split("_")[1]])


def dressed(surface: str, kind: str, norm: str) -> str:
    """A replacement in the case and with the separators of the mention that it replaces."""
    if kind in ("card", "iban", "ssn", "phone"):
        rest = iter(norm.lstrip("+") if kind == "phone" else norm)
        out = "".join(next(rest, "") if c.isalnum() else c for c in surface)
        return out + "".join(rest)
    if surface.isupper():
        return norm.upper()
    if kind.startswith(("given", "surname")):
        return norm.capitalize()
    return "".join(n.upper() if s.isupper() else n for s, n in zip(surface, norm)) + norm[len(surface) :] if kind == "email" else norm


def entities(docs: DataFrame) -> DataFrame:
    """(th, kind, norm): the distinct entities of each distinct text, th being the text's hash; a written table."""
    def detect(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            rows = [(th, m.kind, m.norm) for th, text in zip(batch.column(0).to_pylist(), batch.column(1)) for m in {(x.kind, x.norm): x for x in find(text.as_py())}.values()]
            yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.int64()), *[pa.array([r[i] for r in rows], pa.string()) for i in (1, 2)]], ["th", "kind", "norm"])

    texts = docs.filter(F.col("text").rlike(MAY_HOLD)).select(F.xxhash64("text").alias("th"), "text")
    return written(texts.mapInArrow(detect, "th long, kind string, norm string").distinct(), "entities")


def assign(found: DataFrame, key: bytes) -> DataFrame:
    """(kind, norm, replacement) for each distinct entity; one to one within a kind, and never an entity itself."""
    def draw(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            kinds, norms, draws = (c.to_pylist() for c in batch.columns)
            own = [surrogate(key, k, n, d) for k, n, d in zip(kinds, norms, draws)]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(own, pa.string())], ["kind", "norm", "draw", "replacement"])

    schema = "kind string, norm string, draw int, replacement string"
    every = written(found.select("kind", "norm").distinct(), "distinct_entities")
    table = every.withColumn("draw", F.lit(0)).mapInArrow(draw, schema)
    first = Window.partitionBy("kind", "replacement").orderBy("draw", "norm")
    for _ in range(MOST_DRAWS):
        taken = every.select("kind", F.col("norm").alias("replacement"), F.lit(True).alias("real"))
        # who has drawn least often, then the smaller normal form, keeps a replacement that several have drawn
        checked = table.join(taken, ["kind", "replacement"], "left").withColumn("again", F.col("real").isNotNull() | (F.row_number().over(first) > 1))
        table = written(checked.select("kind", "norm", "draw", "replacement", "again"), "draws")
        if not table.filter("again").limit(1).count():
            return table.select("kind", "norm", "replacement")
        more = table.filter("again").select("kind", "norm", (F.col("draw") + 1).alias("draw")).mapInArrow(draw, schema)
        table = table.filter("not again").select("kind", "norm", "draw", "replacement").union(more)
    raise ValueError("a format has too few values to keep its entities apart")


def one_for_a_given_name(table: DataFrame) -> DataFrame:
    """``table`` with the replacement of a given name of unknown gender taken from the one gender that it has elsewhere."""
    script = F.substring_index("kind", "_", -1)
    known = table.filter(F.col("kind").rlike("^given_[mf]_")).groupBy(F.concat(F.lit("given_n_"), script).alias("kind"), "norm")
    known = known.agg(F.count("*").alias("genders"), F.first("replacement").alias("own")).filter("genders = 1").drop("genders")
    return table.join(known, ["kind", "norm"], "left").select("kind", "norm", F.coalesce("own", "replacement").alias("replacement"))


def replace(docs: DataFrame, key: bytes) -> DataFrame:
    """The rows of ``docs`` with each entity of ``text`` replaced, all other columns as they are, and n_entities.

    A null text stays null with 0 entities, a text without entities stays as it is. Equal texts change alike, whatever
    their ids. Reads text only; the names of other columns do not matter. No rows give no rows.
    """
    names, columns = docs.columns, [F.col(f"`{c}`").alias(f"in_{c}") for c in docs.columns]
    may = F.coalesce(F.col("text").rlike(MAY_HOLD), F.lit(False))
    found = entities(docs)
    pairs = found.join(one_for_a_given_name(assign(found, key)), ["kind", "norm"])
    lists = pairs.groupBy(F.col("th").alias("of")).agg(F.collect_list(F.struct("kind", "norm", "replacement")).alias("swaps"))
    place = names.index("text")

    def swap(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            texts, n = [], []
            for text, swaps in zip(batch.column(place), batch.column(len(names)).to_pylist()):
                text, own, out, at = text.as_py(), {(s["kind"], s["norm"]): s["replacement"] for s in swaps or ()}, [], 0
                mentions = find(text) if own else []
                for m in mentions:
                    out += [text[at : m.start], dressed(text[m.start : m.end], m.kind, own[m.kind, m.norm])]
                    at = m.end
                texts.append("".join([*out, text[at:]]))
                n.append(len(mentions))
            rest = list(batch.columns[: len(names)])
            rest[place] = pa.array(texts, pa.string())
            yield pa.RecordBatch.from_arrays([*rest, pa.array(n, pa.int64())], [*[f"in_{c}" for c in names], "n_entities"])

    open_ = docs.filter(may).select(*columns, F.xxhash64("text").alias("th")).join(lists, F.col("th") == F.col("of"), "left").select(*[f"in_{c}" for c in names], "swaps")
    schema = open_.drop("swaps").schema.add("n_entities", "long")
    done = open_.mapInArrow(swap, schema).union(docs.filter(~may).select(*columns, F.lit(0).cast("long")))
    return done.select(*[F.col(f"in_{c}").alias(c) for c in names], "n_entities")
