import random
import unicodedata

import pyarrow as pa
import pytest

from stemline.llm import lookalike


def form(*texts):
    return lookalike.consistent(pa.array(texts, pa.string())).to_pylist()


@pytest.mark.parametrize(
    "a, b",
    [("ａｂｃ", "abc"), ("é", "é"), ("a​b­﻿", "ab"), ("a b", "a b"), ("a‑b‐", "a-b-"), ("раԁ", "pad"), ("ς̧", "ς̧"), ("ą́", "ą́"), ("ﬁ", "fi"), ("Ａ́", "Á"), ("e‍́", "é"), ("한글", "한글"), ("ё", "ë"), ("*Ｔ", "*Т"), (" a  b ", "a b")],
)
def test_alike(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [*zip("ոհՍԼցզᎪꓮⲟⅼυ", "nhULgqAAolu"), ("ᏢᎪᎢ", "PAT"), ("ΰ", "ΰ"), ("νυ", "vu"), ("ύ", "ú")])
def test_further_alphabets(a, b):
    assert form(a) == form(b)


@pytest.mark.parametrize("a, b", [("a", "A"), ("a", "á"), ("l", "ł"), ("o", "ø"), ("h₁", "h1"), ("kʷ", "kw"), ("ab", "a b"), ("a-b", "ab"), ("ȩ́", "é"), ("m", "rn"), ("0", "o")])
def test_different(a, b):
    assert form(a) != form(b)


def test_equals_composition_where_nothing_else_applies():
    pool = [c for c in map(chr, [*range(0x41, 0x5B), *range(0x61, 0x7B), *range(0xC0, 0x250), *range(0x1E00, 0x1F00), *range(0x300, 0x345), *range(0xAC00, 0xAC40), *range(0x1100, 0x1113), *range(0x1161, 0x1176), *range(0x11A8, 0x11C3)]) if unicodedata.category(c) != "Cn" and not unicodedata.decomposition(c).startswith("<") and c not in "͏ĐƉ"]
    r = random.Random(1)
    texts = ["".join(["x", *(r.choice(pool) for _ in range(r.randint(0, 9)))]) for _ in range(5000)]
    assert form(*texts) == [unicodedata.normalize("NFC", t) for t in texts]


def test_idempotent_and_edges():
    texts = [None, "", " ", "​", "́a", "x" * 100_000, "á" * 20_000, "🙂👍🏽", "a\tb\nc"]
    once = form(*texts)
    assert once[:4] == [None, "", "", ""] and once[5] == texts[5] and once[6] == "á" * 20_000 and once[8] == "a b c"
    assert form(*once) == once
    assert form() == []


def test_pairs(spark):
    rows = [(1, "L", "pad"), (2, "L", "раԁ"), (3, "L", "pád"), (4, "M", "раԁ"), (5, "L", "pad"), (6, "L", None), (7, None, "раԁ"), (8, "L", "pa​d"), (8, "L", "pa​d")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, lang string, t string, form string")
    got = {tuple(r) for r in lookalike.alike_pairs(df, "id", ["lang"], "t").collect()}
    expected = {(a[0], b[0]) for a in rows for b in rows if a[0] < b[0] and a[1] and a[1] == b[1] and a[2] and b[2] and a[2] != b[2] and form(a[2]) == form(b[2])}
    assert got == expected == {(1, 2), (2, 5), (1, 8), (2, 8), (5, 8)}
    assert lookalike.alike_pairs(df.limit(0), "id", ["lang"], "t").count() == 0


def test_classes(spark):
    rows = [(1, "L", "pad"), (2, "L", "раԁ"), (3, "L", "pád"), (4, "M", "раԁ"), (5, "L", "pad"), (6, "L", None), (7, None, "раԁ"), (8, "L", "pa​d"), (8, "L", "pa​d"), (None, "L", "pad")]
    df = spark.createDataFrame([(*r, "x") for r in rows], "id long, lang string, t string, form string")
    got = {tuple(r) for r in lookalike.alike_classes(df, "id", ["lang"], "t").collect()}
    assert got == {(1, 1, 3, 2), (2, 1, 3, 3), (5, 1, 3, 2), (8, 1, 3, 3), (3, 3, 1, 0), (4, 4, 1, 0)}
    pairs = lookalike.alike_pairs(df, "id", ["lang"], "t").count()
    assert sum(links for *_, links in got) == 2 * pairs
    assert lookalike.alike_classes(df.limit(0), "id", ["lang"], "t").count() == 0
