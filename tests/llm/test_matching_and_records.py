import random
from itertools import product

import pytest

from stemline.llm import aliases, survivor
from stemline.llm.bktree import BKTree, distance, nearest, sharded

LIST = [(1, "English", "eng"), (2, "Old English", "ang"), (3, "Proto-Kalidonic", "kal-pro"), (4, "Kalidonic", None), (5, "Southern Velumarish", "svl"), (6, "Velumarish", "vel"), (7, "Middle Torakese", "mto")]


@pytest.fixture(scope="module")
def matcher():
    return aliases.Matcher(aliases.Listed(LIST))


@pytest.mark.parametrize(
    "text, lang",
    [
        ("English", 1), ("  englsih ", 1), ("OLD ENGLISH", 2), ("English, Old", 2), ("O. English", 2), ("OldEnglish", 2), ("old english language", 2), ("the Old Englihs tongue", 2), ("Middle English", -1), ("English (old)", 2), ("English (proto)", -1),
        ("kalidonic, proto", 3), ("P.-Kaldonic", 3), ("protokalidonic", 3), ("Kalid.", 4), ("Kàlidonic *", 4), ("Old Kalidonic", -1), ("KAL-PRO", 3), ("kal pro", 3), ("[svl]", 5), ("lang=svl", 5), ("code svl", 5), ("svm", -1), ("Svl.", 5),
        ("Sth. Velumarish", 5), ("Velumar1sh", 6), ("Western Velumarish", -1), ("svl – Southern Velumarish", 5), ("Southern Velumarish (svl)", 5), ("Southern Velumarish/svl", 5), ("Mid-Torakese", 7), ("Torakese", -1), ("m. torak.", 7),
        ("Gukonashar", -1), ("old", -1), ("language", -1), ("", -1), ("   ", -1), (None, -1), ("?", -1), ("n/a", -1), ("unknown", -1), ("Old", -1), ("x" * 50_000, -1),
    ],
)
def test_typed_names(matcher, text, lang):
    assert matcher.match(text) == lang


def test_match_aliases(spark):
    lang = spark.createDataFrame([(*r, 1) for r in LIST], "lang_id int, name string, wikt_code string, alias int")
    al = spark.createDataFrame([(1, "English", 1), (2, "englsih", None), (3, None, None), (4, "englsih", None)], "alias_id long, alias string, lang_id int")
    assert {tuple(r) for r in aliases.match_aliases(al, lang).collect()} == {(2, 1), (3, -1), (4, 1)}
    assert {tuple(r) for r in aliases.match_aliases(al, lang.limit(0)).collect()} == {(2, -1), (3, -1), (4, -1)}
    assert aliases.match_aliases(al.limit(0), lang).count() == 0


def test_a_list_never_held_gives_the_same(spark):
    """Codes and names by joins, stems in shards: as the matcher that holds the whole list."""
    lang = spark.createDataFrame(LIST, "lang_id int, name string, wikt_code string")
    texts = ["englsih", "O. English", "English (old)", "the Old Englihs tongue", "Middle English", "Kalid.", "protokalidonic", "KAL-PRO", "svl – Southern Velumarish", "svm", "m. torak.", "Gukonashar", "", None]
    al = spark.createDataFrame([(k, t, None) for k, t in enumerate(texts)], "alias_id long, alias string, lang_id int")
    whole = aliases.Matcher(aliases.Listed(LIST))
    assert {tuple(r) for r in aliases.match_aliases(al, lang, most_held=3).collect()} == {(k, whole.match(t)) for k, t in enumerate(texts)}


def test_distance_is_a_metric():
    assert distance("ca", "abc") == 2 and distance("abcd", "abdc") == 1 and distance("", "ab") == 2
    words = ["".join(p) for n in range(4) for p in product("abc", repeat=n)]
    r = random.Random(1)
    for _ in range(4000):
        a, b, c = (r.choice(words) for _ in range(3))
        assert distance(a, b) == distance(b, a) and distance(a, c) <= distance(a, b) + distance(b, c) and (distance(a, b) == 0) == (a == b)


def test_tree_finds_all_within():
    r = random.Random(2)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(1, 8))) for _ in range(300)]
    tree = BKTree(words)
    for q in words[:40] + ["", "zzz"]:
        for most in (0, 1, 2, 3):
            assert tree.within(q, most) == sorted((distance(q, w), w) for w in set(words) if distance(q, w) <= most)


def test_shards_agree_with_the_whole(spark):
    r = random.Random(3)
    words = ["".join(r.choice("abcd") for _ in range(r.randint(2, 7))) for _ in range(120)]
    ref = spark.createDataFrame([(w,) for w in words] + [(None,)], "e string")
    q = spark.createDataFrame([(w[1:] + "a",) for w in words[:30]] + [("zzzzzzzz",), (None,)], "q string")
    whole = {tuple(x) for x in nearest(q, "q", ref, "e", 2).collect()}
    assert {tuple(x) for x in nearest(q, "q", ref, "e", 2, shard_rows=15).collect()} == whole
    tree = BKTree(words)
    assert all((e, d) == (tree.within(t, 2)[0][::-1] if tree.within(t, 2) else (None, None)) for t, e, d in whole)
    asked = q.where("q IS NOT NULL").distinct().selectExpr("q", "2 AS most")
    for x in sharded(asked, ref.where("e IS NOT NULL").distinct(), 3, shard_rows=15, block_queries=4).collect():
        assert [tuple(f) for f in x.found] == tree.within(x.q, 2)[:3]


CLAIM = "ety_id long, word_id long, ordinal int, label string, gloss string, source_id int, recorded_at timestamp, id string"


def test_survivors(spark):
    sources = spark.createDataFrame([(1, " Curated", 0), (2, "extract", 0), (3, "derived", 0), (4, "curated", 1), (5, "extract", None)], "source_id int, kind string, additive_only int")
    order = spark.createDataFrame([(1, 50), (2, 10), (2, 20), (4, 1)], "source_id int, priority int")
    import datetime

    d = lambda n: datetime.datetime(2024, 1, n)
    rows = [
        (1, 1, 1, "a", None, 1, d(1), "x"), (2, 1, 1, "n/a", "g", 2, d(2), "x"), (3, 1, 1, "z", "h", 4, d(9), "x"), (4, 1, 1, "—", "(unknown)", 3, d(3), "x"),
        (5, 2, 1, "only", None, 1, d(1), "x"), (6, 3, None, "late", "x", 5, d(1), "x"), (7, 3, None, "later", "x", 5, d(5), "x"), (8, 3, None, "none yet", "x", 5, None, "x"), (9, 3, None, "later", "x", 3, d(9), "x"),
        (10, 4, 1, None, " ", 1, None, "x"), (11, 4, 1, "", "TBD", 99, None, "x"), (12, 5, 1, "p", None, 99, None, "x"), (13, 5, 1, "q", None, 3, None, "x"),
    ]
    claims = spark.createDataFrame(rows, CLAIM)
    long = survivor.long_claims(claims, ["word_id", "ordinal"], ["label", "gloss"], survivor.ranked_sources(sources, order))
    got = {(r.word_id, r.ordinal, r.field): r.id for r in survivor.by_precedence(long, ["word_id", "ordinal"]).collect()}
    assert got == {(1, 1, "label"): 1, (1, 1, "gloss"): 2, (3, None, "label"): 7, (3, None, "gloss"): 7, (5, 1, "label"): 13}
    rec = {r.word_id: (r.label, r.gloss) for r in survivor.records(survivor.by_votes(long, ["word_id", "ordinal"]), ["word_id", "ordinal"], ["label", "gloss"]).collect()}
    assert rec[1] == ("a", "g") and rec[3] == ("later", "x") and rec[2] == ("only", None) and 4 not in rec
    words = survivor.long_claims(spark.createDataFrame([(1, 1, 1, "Na", "nothing", 1, None, "x"), (2, 1, 1, None, "n/a", 1, None, "x")], CLAIM), ["word_id", "ordinal"], ["label", "gloss"], survivor.ranked_sources(sources, order), nothing={"label": ("unknown",)})
    assert {(r.field, r.value) for r in survivor.by_precedence(words, ["word_id", "ordinal"]).collect()} == {("label", "Na"), ("gloss", "nothing")}
    empty = survivor.long_claims(claims.limit(0), ["word_id", "ordinal"], ["label"], survivor.ranked_sources(sources.limit(0), order))
    assert survivor.by_precedence(empty, ["word_id", "ordinal"]).count() == 0 == survivor.by_votes(empty, ["word_id", "ordinal"]).count()
