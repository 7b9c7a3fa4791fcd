from __future__ import annotations

import re

import pytest

from hazardlens.llm import surrogates
from hazardlens.llm.queries import queries
from tests.llm.helpers import ODD, docs_frame

KEY = b"k"
ROWS = [
    (20, "Mail Ann.Lee@Mail.example.com or ann.lee@mail.example.com, bob@mail.example.com."), (21, "call +1 (017) 555-7713 or +1 017 555 7713; 10.0.0.7 and 97.51.17.173. end"),
    (22, "card 4111 1111 1111 1111 and 4111111111111111, ssn 123-45-6789, iban DE89 3704 0044 0532 0130 00"), (23, "Mr. John Smith met Mrs Smith and MR. SMITH; г-жа Анна Иванова, Κος Νίκος Παππάς. Dr no"),
    (24, "version 1.2.3, year 2024, 12 apples, 3.14 and ratio 1-2 stay"), (25, "Mr. John Smith met Mrs Smith and MR. SMITH; г-жа Анна Иванова, Κος Νίκος Παππάς. Dr no"),
] + [r[:2] for r in ODD]


@pytest.fixture(scope="module")
def out(spark):
    df = surrogates.replace(docs_frame(spark, ROWS), KEY)
    assert df.columns == [*docs_frame(spark, ROWS).columns, "n_entities"]
    return df.collect()


def text(out, doc):
    return next(r["text"] for r in out if r["doc_id"] == doc)


def test_rows_stay(out):
    assert len(out) == len(ROWS)
    assert sorted(str(r["doc_id"]) for r in out) == sorted(str(d) for d, _ in ROWS)
    plain = {d: t for d, t in ROWS if d in (1, 2, 3, 4, 5, 7, 8, 24)}
    assert {d: text(out, d) for d in plain} == plain


def test_emails(out):
    a, b, c = re.findall(r"\S+@\S+[a-z]", text(out, 20))
    assert a.lower() == b and a[0].isupper() and a != b and b != c
    assert b.split("@")[1] == c.split("@")[1] and b.endswith(".com") and "mail.example" not in text(out, 20)
    assert re.fullmatch(r"[a-z]{3}\.[a-z]{3}@[a-z]{4}\.[a-z]{7}\.com", b)


def test_numbers_keep_their_form(out):
    t = text(out, 21)
    a, b = re.search(r"\+1 \((\d{3})\) (\d{3})-(\d{4})", t), re.search(r"\+1 (\d{3}) (\d{3}) (\d{4})", t)
    assert a.groups() == b.groups() and "5557713" not in "".join(a.groups())
    assert re.search(r"10\.\d+\.\d+\.\d+ and \d+\.\d+\.\d+\.\d+\. end", t) and "97.51" not in t
    t = text(out, 22)
    card = re.search(r"card (\d{4} \d{4} \d{4} \d{4}) and (\d{16})", t)
    assert card[1].replace(" ", "") == card[2] != "4111111111111111" and card[2][0] == "4" and surrogates.luhn(card[2]) % 10 == 0
    iban = re.search(r"DE\d\d \d{4} \d{4} \d{4} \d{4} \d\d", t)[0].replace(" ", "")
    assert int("".join(str(int(c, 36)) for c in iban[4:] + iban[:4])) % 97 == 1
    assert re.search(r"ssn \d{3}-\d\d-\d{4},", t) and "123-45" not in t


def test_names_refer_alike(out):
    t = text(out, 23)
    m = re.fullmatch(r"Mr\. (\w+) (\w+) met Mrs (\w+) and MR\. SMITH; г-жа (\w+) (\w+), Κος (\w+) (\w+)\. Dr no", t)
    assert m and m[2] == m[3] and m[1].endswith("o") and m[4].endswith("ина") and m[6].endswith("ος")
    assert "John" not in t and "Smith" not in t and "Иванова" not in t
    assert text(out, 25) == t


def test_names_found_once_are_replaced_everywhere_in_the_text(spark):
    rows = [
        (1, "Mr. John Smith called. Smith said John's car, Smith’s own; mail John.Smith@x.org. Smithson, blacksmith and smith stay"),
        (2, "mr John Smith and MRS. Anna Lee; Dr Anna came, Anna Lee too"), (3, "Dr Anna Stone wrote"), (4, "Mrs. Ann-Marie Lee's: Ann-Marie, Ann and Lee"),
        (5, "г-жа Анна Иванова. Иванова и Анна; Г-ЖА Иванова"), (6, "Dr PAUL KING came; King and KING"),
    ]
    out = {r["doc_id"]: r for r in surrogates.replace(docs_frame(spark, rows), KEY).collect()}
    t = {d: r["text"] for d, r in out.items()}
    m = re.fullmatch(r"Mr\. (\w+) (\w+) called\. (\w+) said (\w+)'s car, (\w+)’s own; mail \S+@\S+\.org\. Smithson, blacksmith and smith stay", t[1])
    assert m and m[1] == m[4] != "John" and m[2] == m[3] == m[5] != "Smith" and out[1]["n_entities"] == 6
    n = re.fullmatch(r"mr (\w+) (\w+) and MRS\. (\w+) (\w+); Dr (\w+) came, (\w+) (\w+) too", t[2])
    assert n and (n[1], n[2]) == (m[1], m[2]) and n[3] == n[5] == n[6] and n[4] == n[7] and n[3].endswith("a")
    assert re.fullmatch(rf"Dr {n[3]} \w+ wrote", t[3])
    assert re.fullmatch(rf"Mrs\. (\S+) {n[4]}'s: \1, Ann and {n[4]}", t[4])
    o = re.fullmatch(r"г-жа (\w+) (\w+)\. (\w+) и (\w+); Г-ЖА (\w+)", t[5])
    assert o and o[1] == o[4] and o[2] == o[3] == o[5] and "Анна" not in t[5]
    p = re.fullmatch(r"Dr ([A-Z]+) ([A-Z]+) came; (\w+) and ([A-Z]+)", t[6])
    assert p and p[2] == p[3].upper() == p[4] != "KING"


@pytest.mark.parametrize("number", ["+15551234567", "+1 5551234567", "+1-555-1234567", "+49 30 1234 5678901", "+44 (20) 79460958"])
def test_a_number_after_a_plus_needs_no_separators(number):
    for text in (f"call {number}.", f"({number})", number):
        (m,) = surrogates.find(text)
        assert (m.kind, m.norm, text[m.start : m.end]) == ("phone", "+" + re.sub(r"\D", "", number), number)
    assert not surrogates.find("a+15551234567 or +123456 or 1+1")


def test_draws_again_until_distinct(spark, monkeypatch):
    real = surrogates.surrogate
    names = [f"a{i}@x.org" for i in range(30)] + ["taken@x.org"]

    def narrow(key, kind, norm, draw):
        return "taken@x.org" if draw == 0 else f"s{int(norm[1:3].strip('@') or 0) // 2 if norm[1].isdigit() else 99}-{draw}@x.org" if draw == 1 else real(key, kind, norm, draw)

    monkeypatch.setattr(surrogates, "surrogate", narrow)
    found = spark.createDataFrame([(1, "email", n) for n in names], "th long, kind string, norm string")
    table = surrogates.assign(found, KEY).collect()
    assert sorted(r["norm"] for r in table) == sorted(names)
    assert len({r["replacement"] for r in table}) == len(names) and not {r["replacement"] for r in table} & set(names)


def test_a_format_with_too_few_values_is_widened(spark):
    names = [f"{c}@x.org" for c in "äöüéèñø"]  # five vowels stand for such a letter
    found = spark.createDataFrame([(1, "email", n) for n in names], "th long, kind string, norm string")
    table = surrogates.assign(found, KEY).collect()
    assert sorted(r["norm"] for r in table) == sorted(names) and len({r["replacement"] for r in table}) == len(names)


@pytest.mark.parametrize("kind,norm", [("ip", "192.168.0.7"), ("ip", "10.0.0.7"), ("card", "4111111111111111"), ("iban", "DE89370400440532013000"), ("ssn", "123456789"), ("phone", "5551234567"), ("phone", "+15551234567"), ("email", "a@x.org")])
def test_wider_replacements_are_of_the_same_kind(kind, norm):
    first, late = surrogates.surrogate(KEY, kind, norm, 0), surrogates.surrogate(KEY, kind, norm, 3 * surrogates.WIDER)
    surface = norm if kind in ("ip", "email") else f"{norm[:4]} {norm[4:]}"
    assert "".join(c for c in surrogates.dressed(surface, kind, late) if c != " ") == late
    assert len(first) == len(norm) or kind == "ip"
    assert len(late) == len(norm) + 3 if kind != "ip" else not late.startswith("192.168.") and late.count(".") == 3


def test_other_key_other_surrogates():
    assert surrogates.surrogate(b"a", "email", "x.y@z.org", 0) != surrogates.surrogate(b"b", "email", "x.y@z.org", 0)


def test_empty(spark):
    assert surrogates.replace(docs_frame(spark, []), KEY).collect() == []


def test_query(spark, small):
    rows = {r["doc_id"]: r["text"] for r in spark.read.parquet(f"{small}/documents.parquet").collect()}
    for r in queries()["op1_pii_surrogates"](spark, small).collect():
        old = rows[r["doc_id"]]
        assert r["n_entities"] == len(surrogates.find(old)) and (r["text"] == old) == (not surrogates.find(old))
        assert not {m.norm for m in surrogates.find(old) if m.kind == "email"} & {m.norm for m in surrogates.find(r["text"])}
