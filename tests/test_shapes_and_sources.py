import json

import pytest

from stemline.operators import shapes
from stemline.sources import dump, sinks

ROWS = [
    {"name": n, "wikt_code": c, "bucket": b, "era_start": s, "era_end": e}
    for n, c, b, s, e in [
        ("English", "en", "Germanic", 1500, 9999), ("Middle English", "enm", "Germanic", 1100, 1500), ("Old English", "ang", "Germanic", 450, 1100), ("Old Norse", "non", "Norse", 700, 1400),
        ("Old French", "fro", "French", 800, 1400), ("Latin", "la", "Latin", -75, 476), ("Proto-Indo-European", "ine-pro", "PIE", -4500, -2500), ("Arabic", "ar", "Semitic", 500, 9999), ("Middle French", "frm", "French", 1400, 1600),
    ]
]


def t(name, *args, **named):
    return {"name": name, "args": {str(i + 1): a for i, a in enumerate(args)} | named}


CASES = {
    "mile": [t("root", "en", "ine-pro", "*r"), t("inh", "en", "enm", "mile"), t("inh+", "en", "enm", "mile"), t("der", "en", "la", "mille"), t("cog", "en", "de", "x")],
    "hazelrow": [t("root", "en", "ine-pro", "*h"), t("root", "en", "ine-pro", "*h"), t("root", "en", "ine-pro", "-"), t("inh", "en", "enm", "hasel")],
    "grafted": [t("der", "en", "enm", "o"), t("der", "en", "fro", "o"), t("der", "en", "la", "October"), t("der", "en", "ine-pro", "*o"), t("der", "en", "la", "-ber")],
    "apart": [t("bor", "en", "la", "s"), t("der", "en", "ar", "s")],
    "viking": [t("inh", "en", "enm", "knif"), t("inh", "en", "ang", "cnif"), t("der", "en", "non", "knifr")],
    "obvious": [t("af", "en", "la:obvius", "-ous")],
    "darkness": [t("suffix", "en", "dark", "ness")],
    "outlet": [t("surf", "+deverbal", "en", "let")],
    "geology": [t("confix", "en", "geo", "log", "y"), t("prefix", "en", "un", "geo")],
    "colons": [t("af", "en", "zz:top", ":af", "frm:porter<alt:porte><t:carry>", "x#Noun", "y<z", "y<z", "v<t:b<c>d>w", "<alt: >", "u>", "s<alt:r#1>")],
    "government": [t("bor", "en", "fro", "governement"), t("suffix", "en", "govern", "ment")],
    "telephone": [t("der", "en", "la", "a"), t("bor", "en", "fro", "b"), t("der", "en", "ar", "c"), t("af", "en", "tele-", "phone")],
    "nightmare": [t("af", "en", "night", "mare"), t("root", "en", "ine-pro", "*mer-")],
    "bead": [t("ety", "en", ":inh", "enm:bede<ety:inh<ang:bedu<unc:1><alt:gebed>>>")],
    "broken": [t("ety", "en", ":inh", "enm:bede<ety:inh<ang:b>")],
    "kin": [t("etymon", "en", ":cog", "enm:x"), t("etymon", "en", ":af", "left", "-ward")],
    "computer": [t("root", "en", "ine-pro", "*p")],
    "ended": [t("col-top"), t("inh", "en", "enm", "a")],
    "unsure": [t("uinh", "en", "enm", "un")],
    "species": [t("der", "en", "mul-tax", "S."), t("der", "en", "mul", "s")],
    "undetermined": [t("der", "en", "und", "?"), t("der", "en", "la", "-")],
    "phone": [t("clipping", "en", "telephone")],
    "edit": [t("back-form", "en", "editor")],
    "empty": [],
}
TEXTS = {
    "father": "Etymology tree\nLatin pater\nOld English fæder\nMiddle English fader inh.\nEnglish father\n\nFrom Middle English, prose.\nLatin x",
    "stepwise": "Etymology tree\nOld English a\nLatin b?\nOld French c\nOld French d\nEnglish stepwise",
    "other": "Etymology tree\nLatin pater\nEnglish another word",
    "prose": "From Latin.\nLatin pater\nEnglish prose",
}


@pytest.fixture(scope="module")
def trees(spark):
    """``word: [(shape, [(parent, lang, term, rel)], nodes)]`` of all cases, assembled together."""
    rows = [(w, 1, x, None) for w, x in CASES.items()] + [(w, 1, None, x) for w, x in TEXTS.items()]
    df = spark.createDataFrame(rows, "word string, num int, templates array<struct<name:string,args:map<string,string>>>, text string")
    out: dict = {}
    languages = spark.createDataFrame([tuple(r.values()) for r in ROWS], "name string, wikt_code string, bucket string, era_start int, era_end int")
    for r in sorted(shapes.assembled(df, languages).collect(), key=lambda r: (r.word, r.tree, r.no)):
        out.setdefault(r.word, {}).setdefault(r.tree, (r.shape, []))[1].append(r)
    return {w: [*of.values()] for w, of in out.items()}


def told(tree):
    return [(n.parent, n.lang, n.term, n.rel) for n in tree[1]]


def test_chain_with_roots_at_its_end(trees):
    (tree,) = trees["mile"]
    assert tree[0] == "chain" and told(tree) == [(None, "English", "mile", "head"), (0, "Middle English", "mile", "inherited"), (1, "Latin", "mille", "derived"), (2, "Proto-Indo-European", "*r", "root")]
    (tree,) = trees["hazelrow"]
    assert told(tree)[1:] == [(0, "Middle English", "hasel", "inherited"), (1, "Proto-Indo-European", "*h", "root"), (2, "Proto-Indo-European", "-", "root")]


def test_second_account_is_grafted_or_apart(trees):
    (tree,) = trees["grafted"]
    assert told(tree)[-1] == (3, "Latin", "-ber", "formed_from")
    assert [x[0] for x in trees["apart"]] == ["chain", "chain"]
    assert [n[1] for n in told(trees["viking"][0])] == ["English", "Middle English", "Old English", "Old Norse"]


def test_parts(trees):
    parts = lambda w: [(n.lang, n.term, n.is_affix) for n in trees[w][0][1][1:]]
    assert trees["obvious"][0][0] == "fork" and parts("obvious") == [("Latin", "obvius", False), ("English", "-ous", True)]
    assert parts("darkness") == [("English", "dark", False), ("English", "ness", True)] and parts("outlet") == [("English", "let", False)]
    assert parts("geology") == [("English", "geo", True), ("English", "log", False), ("English", "y", True), ("English", "un", True)]
    assert parts("colons") == [("English", "zz:top", False), ("Middle French", "porte", False), ("English", "x", False), ("English", "y", False), ("English", "vw", False), ("English", "u>", False), ("English", "s", False)]
    assert trees["government"][0][0] == "mixed" and parts("phone") == [("English", "telephone", False)] and parts("edit") == [("English", "editor", False)]
    tele = trees["telephone"]
    assert len(tele) == 1 and [n.parent for n in tele[0][1]].count(0) == 4
    kids = sorted((n for n in tele[0][1] if n.parent == 0), key=lambda n: n.ordinal)
    assert [n.lang for n in kids] == ["Old French", "Latin", "English", "English"] or kids[-1].rel == kids[-2].rel == "formed_from"
    assert [(n.rel, n.certainty) for n in trees["nightmare"][0][1][1:]] == [("formed_from", "direct"), ("formed_from", "direct"), ("root", "related")]


def test_nested_notation_and_stub(trees):
    (x,) = trees["bead"]
    assert x[0] == "rendered" and told(x)[1:] == [(0, "Middle English", "bede", "inherited"), (1, "Old English", "gebed", "inherited")] and x[1][2].certainty == "related"
    assert "broken" not in trees and "ended" not in trees and "empty" not in trees
    assert told(trees["kin"][0])[1:] == [(0, "English", "left", "formed_from"), (0, "English", "-ward", "formed_from")]
    (z,) = trees["computer"]
    assert z[0] == "stub" and z[1][1].certainty == "related"


def test_rendered_blocks(trees):
    assert [n[1] for n in told(trees["father"][0])] == ["English", "Middle English", "Old English", "Latin"]
    assert told(trees["stepwise"][0])[1:] == [(0, "Old French", "d", "inherited")]
    assert "other" not in trees and "prose" not in trees


def test_vocabulary(trees):
    assert told(trees["unsure"][0])[1:] == [(0, "Middle English", "un", "inherited")]
    assert "species" not in trees
    assert told(trees["undetermined"][0])[1:] == [(0, "und", "?", "derived"), (1, "Latin", None, "derived")]


def test_brackets():
    assert shapes.split_groups("a<b<c>><d>") == ("a", ["b<c>", "d"])
    assert shapes.split_groups("a<b") is None and shapes.split_groups("a>b<") is None


LINES = [
    {"lang": "English", "word": "bear", "pos": "noun", "etymology_number": "1", "etymology_templates": [t("inh", "en", "enm", "bere")], "senses": [{"glosses": ["an animal " * 40]}], "forms": [{"form": "bears", "tags": ["plural"]}, {"form": "bear", "tags": ["plural"]}]},
    {"lang": "English", "word": "bear", "pos": "verb", "etymology_number": 1, "etymology_templates": [t("inh", "en", "enm", "bere")], "senses": [{}], "translations": [{"lang": "French", "lang_code": "fr"}], "derived": [{"word": "bearer", "lang": "English"}]},
    {"lang": "English", "word": "bear", "pos": "verb", "etymology_number": 2, "etymology_templates": [t("inh", "en", "ang", "beran")]},
    {"lang": "German", "word": "Bär"}, {"lang": "English", "word": ""}, {"lang": "English"},
    {"lang": "English", "word": "bore", "forms": [{"form": "bears", "tags": ["plural"]}]},
]


def test_dump(spark, tmp_path):
    path = str(tmp_path / "dump.jsonl")
    with open(path, "w") as f:
        f.write("\n".join(["", "{bad", *(json.dumps(x) for x in LINES)]))
    e = dump.read_entries(spark, path)
    assert e.count() == 4 and dump.read_entries(spark, path, limit=2).count() == 2
    g = {(r.word, r.num): r for r in dump.grouped_entries(e).collect()}
    assert set(g) == {("bear", 1), ("bear", 2), ("bore", 1)}
    assert len(g["bear", 1].templates) == 1 and g["bear", 1].pos == "noun,verb"
    assert [(r.word, len(r.gloss)) for r in dump.senses(e).collect()] == [("bear", 200)]
    assert [tuple(r) for r in dump.relations(e).collect()] == [("bear", "derived_term", "bearer", "English", None)]
    assert [tuple(r) for r in dump.inflections(e).collect()] == [("bears", "bear")]
    assert [tuple(r) for r in dump.harvested_names(e).collect()] == [("fr", "French")]
    languages = spark.createDataFrame([tuple(r.values()) for r in ROWS], "name string, wikt_code string, bucket string, era_start int, era_end int")
    nodes = shapes.assembled(dump.grouped_entries(e), languages)
    assert {(r.word, r.num, r.lang) for r in nodes.where("rel <> 'head'").collect()} == {("bear", 1, "Middle English"), ("bear", 2, "Old English")}
    assert all(r.n == 0 for r in shapes.node_faults(nodes).collect())


def test_small_sources(spark, tmp_path):
    p = tmp_path / "codes.csv"
    p.write_text("﻿code,name\naa,Afar\n", encoding="utf-8")
    assert [tuple(r) for r in dump.read_registry(spark, str(p)).collect()] == [("aa", "Afar")]
    assert dump.read_registry(spark, str(tmp_path / "none.csv")).count() == 0
    (tmp_path / "m.json").write_text('{"a": "b", "c": "d"}')
    assert sorted(tuple(r) for r in dump.read_json_map(spark, str(tmp_path / "m.json")).collect()) == [("a", "b"), ("c", "d")]
    (tmp_path / "bad.json").write_text("{")
    assert dump.read_json_map(spark, str(tmp_path / "bad.json")).count() == 0 and dump.read_json_map(spark, str(tmp_path / "no.json")).count() == 0
    (tmp_path / "c.txt").write_text("one\n\ntwo\nlines\n\n\n")
    assert [r.text for r in dump.read_corpus(spark, str(tmp_path / "c.txt")).orderBy("part").collect()] == ["one", "two\nlines"]
    (tmp_path / "c.json").write_text('{"data":[{"text":"x"},{"text":"y"}]}')
    assert dump.read_corpus(spark, str(tmp_path / "c.json")).count() == 2
    (tmp_path / "l.csv").write_text("name,wikt_code,bucket,family,era_start,era_end,era_label,era_certain,is_proto,is_english_stage,source\nLatin,la,Latin,r,-75,476,x,1,0,0,s\n,zz,,,,,,,,,\n")
    assert [r.era_start for r in dump.read_languages(spark, str(tmp_path / "l.csv")).collect()] == [-75]
    (tmp_path / "d.jsonl").write_text(json.dumps({"lang": "P", "word": "a", "descendants": [{"lang": "Q", "word": "b", "descendants": [{"word": "c"}]}]}) + "\nbad\n")
    from stemline.operators.nested import flatten_json_trees

    got = flatten_json_trees(dump.read_descendants(spark, str(tmp_path / "d.jsonl"), "s"), fields=("term",)).collect()
    assert {(r.node_path, r.term) for r in got} == {("0", "a"), ("0.0", "b"), ("0.0.0", "c")}


def test_relation_reader_prunes_and_pushes(spark, tmp_path):
    spark.createDataFrame([("1", "English", "a"), ("2", "German", "b")], "term_id string, lang string, term string").write.parquet(str(tmp_path / "r"))
    df = dump.read_relations(spark, str(tmp_path / "r")).select("term")
    plan = df._jdf.queryExecution().toString()
    assert "EqualTo(lang,English)" in plan and [r.term for r in df.collect()] == ["a"]


def test_sinks(spark, tmp_path):
    path = str(tmp_path / "t")
    df = spark.createDataFrame([(1, "a"), (2, "b")], "id int, v string")
    assert sinks.replace_checked(df, path) == 2
    with pytest.raises(ValueError):
        sinks.replace_checked(df.limit(0), path)
    with pytest.raises(ValueError):
        sinks.replace_checked(df.union(df), path, [sinks.no_duplicates(["id"])])
    with pytest.raises(ValueError):
        sinks.replace_checked(df, path, [sinks.references("v", df.limit(1), "v")])
    assert spark.read.parquet(path).count() == 2
    more = spark.createDataFrame([(2, "z"), (3, "c")], "id int, v string")
    assert {tuple(r) for r in sinks.insert_missing(df, more, ["id"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert {tuple(r) for r in sinks.first_by_key(df.union(more), ["id"], ["v"]).collect()} == {(1, "a"), (2, "b"), (3, "c")}
    assert sinks.surrogate(df, ["v"], "k").select("k").distinct().count() == 2
    sinks.write_tsv(df, str(tmp_path / "tsv"))
    assert spark.read.option("sep", "\t").option("header", True).csv(str(tmp_path / "tsv")).count() == 2
    assert sinks.build_meta(spark, version="1").first()["version"] == "1"
