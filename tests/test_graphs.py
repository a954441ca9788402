import json

import pyspark.sql.functions as F

from stemline.operators import forest, lineage, notes, relations, shares

NODES = "node_id long, tree_id long, parent_id long, lang string, term string, raw_term string, ordinal int"
TREES = "tree_id long, lang string, term string, raw_term string, node_count int, source string"


def forests(spark):
    nodes = [
        (1, 1, None, "PG", "b", "*b", 0), (2, 1, None, "La", "l", "l", 1), (3, 1, 2, "Fr", "f", "f", 0),
        (4, 2, None, "OE", "broþor", "broþor", 0), (5, 2, 4, "English", "brother", "brother", 0), (6, 2, None, "OE", "broþer", "broþer", 1), (7, 2, 6, "English", "brother", "brother", 0),
        (8, 2, None, "OE", "x", "x", 2), (9, 2, None, "PG", "b", "*b", 3),
    ]
    trees = [(1, "PIE", "p", "*p", 3, "s"), (2, "PG", "b", "*b", 6, "s"), (3, "PG", "b", "*b", 1, "s")]
    return spark.createDataFrame(nodes, NODES), spark.createDataFrame(trees, TREES)


def test_climb_and_parents(spark):
    n, t = forests(spark)
    assert [tuple(r) for r in forest.parent_trees(n, t).collect()] == [("PG", "b", 1, "PIE", "p")]
    assert {(r.term, r.top_id, r.top_term, r.steps) for r in forest.climb(n, t).collect()} == {("b", 1, "p", 1), ("p", 1, "p", 0)}
    assert {(r.lang, r.term, r.tree_id, r["rank"]) for r in forest.trees_containing(n, t).where("lang = 'PG'").collect()} == {("PG", "b", 2, 1), ("PG", "b", 1, 2)}


def test_climb_stops_on_cycles(spark):
    n = spark.createDataFrame([(1, 1, None, "B", "b", "b", 0), (2, 2, None, "A", "a", "a", 0)], NODES)
    t = spark.createDataFrame([(1, "A", "a", "a", 1, "s"), (2, "B", "b", "b", 1, "s")], TREES)
    assert {(r.term, r.top_term, r.steps) for r in forest.climb(n, t).collect()} == {("a", "b", 1), ("b", "a", 1)}


def test_splice_once(spark):
    n, t = forests(spark)
    s = forest.splice(n, t).where("top = 1").collect()
    assert len(s) == 9 and sum(r.spliced for r in s) == 1
    assert {r.depth for r in s if r.tree_id == 2} == {2, 3}


def test_variants_merge_equal_siblings(spark):
    n, _ = forests(spark)
    n = n.where("tree_id = 2").withColumn("parent_id", F.when(F.col("parent_id").isNull() & (F.col("node_id") != 100), 100).otherwise(F.col("parent_id")))
    n = n.unionByName(spark.createDataFrame([(100, 2, None, "PG", "b", "*b", 0)], NODES))
    got = {r.node_id: (r.spellings, r.variants, r.merged) for r in forest.variants(n).collect()}
    assert got[4] == ("broþor, broþer", 2, 0) and 6 not in got and 7 not in got and got[100][2] == 2 and got[8] == ("x", 1, 0)


def test_budget_marks_nesting_and_forms(spark):
    n, _ = forests(spark)
    assert {tuple(r) for r in forest.pruned(n, 2).collect()} == {(1, 3, 2, True), (2, 6, 2, True)}
    assert [r.node_id for r in forest.breadth_first(n).where("tree_id = 2").orderBy("rank").collect()] == [4, 6, 8, 9, 5, 7]
    assert {(r.node_id, r.match) for r in forest.on_path(n, F.col("lang") == "English").collect()} == {(4, False), (5, True), (6, False), (7, True)}
    tree = json.loads(forest.nested(n).where("tree_id = 1").first()["tree_json"])
    assert tree == [{"lang": "PG", "term": "b"}, {"lang": "La", "term": "l", "children": [{"lang": "Fr", "term": "f"}]}]
    words = spark.createDataFrame([("Brother",), ("brother",), ("none",), ("",), (None,)], "w string")
    assert {tuple(r) for r in forest.covered_form(words, "w", n).collect()} == {("Brother", "brother"), ("brother", "brother"), ("none", None)}
    assert forest.nested(n.limit(0)).count() == forest.variants(n.limit(0)).count() == forest.pruned(n.limit(0)).count() == 0


NODE = "word_id long, tree_no long, node_path string, parent_path string, lang string, term string, rel string, certainty string, is_root string, is_affix string"


def stored(spark):
    return spark.createDataFrame(
        [
            (1, 1, "0", "", "English", "pipe", "head", None, None, None), (1, 1, "0.0", "0", "Old English", "pipe", "inherited", "direct", None, None), (1, 1, "0.1", "0", "Latin", "pipa", "borrowed", "direct", None, None),
            (1, 1, "0.1.0", "0.1", "Greek", "g", "derived", None, None, None), (1, 1, "0.0.0", "0.0", "Proto-X", "p", "root", "related", None, None),
            (2, 1, "0", "", "English", "bagpipe", "head", None, None, None), (2, 1, "0.0", "0", "English", "bag", "formed_from", "direct", None, "false"), (2, 1, "0.1", "0", "English", "pipe", "formed_from", "direct", None, None), (2, 1, "0.2", "0", "English", "-s", "formed_from", None, None, None),
            (3, 1, "0", "", "English", "bag", "head", None, None, None), (3, 1, "0.0", "0", "Middle English", "bagge", "inherited", None, None, None),
            (4, 1, "0", "", "English", "z", "head", None, None, None), (4, 1, "0.0", "0", "Proto-Y", "y", "borrowed", None, None, None), (4, 1, "0.0.0", "0.0", "Latin", "y", "derived", None, None, None),
            (4, 2, "0", "", "English", "z", "head", None, None, None), (4, 2, "0.0", "0", "Latin", "z", "borrowed", None, None, None), (5, 1, "0", "", "English", "s", "head", None, None, None),
            (6, 1, "0", "", "English", "sky", "head", None, None, None), (6, 1, "0.0", "0", "Latin", "c", "calque", None, None, None),
        ],
        NODE,
    )


def test_lines_and_readings(spark):
    n = stored(spark)
    s = lineage.spines(n)
    lines = {(r.word_id, r.tree_no): [x.lang for x in r.spine] for r in s.collect()}
    assert lines[1, 1] == ["English", "Latin", "Greek"] and lines[5, 1] == ["English"]
    words = spark.createDataFrame([(i,) for i in range(1, 8)], "word_id long")
    assert {r.word_id: r.status for r in lineage.statuses(words, s).collect()} == {1: "resolved", 2: "resolved", 3: "resolved", 4: "resolved", 5: "stub", 6: "resolved", 7: "none"}
    prime = lineage.primary(s)
    assert {r.word_id: r.tree_no for r in prime.collect()}[4] == 2
    lookup = spark.createDataFrame([("pipe", 1), ("bag", 3), ("bagpipe", 2)], "form string, word_id long")
    parts = lineage.components(n, prime, lookup)
    assert {tuple(r) for r in parts.collect()} == {(2, 3, 0), (2, 1, 1)}
    own = prime.withColumn("spine", F.expr("filter(spine, s -> s.rel <> 'formed_from')"))
    lines = lineage.lineages(own, parts)
    got = {r.word_id: [x.term for x in r.line] for r in lines.collect()}
    assert got[2] == ["bagpipe", "pipe", "pipa", "g"]
    languages = spark.createDataFrame([("Latin", "Latin", -75, 476), ("Greek", "Greek", -900, 600), ("English", "Germanic", 1500, 9999), ("Middle English", "Germanic", 1100, 1500)], "name string, bucket string, era_start int, era_end int")
    r = {x.word_id: (x.direct, x.influence, x.root) for x in lineage.readings(lines, languages).collect()}
    assert r[1] == ("Latin", "Greek", "Greek") and r[2] == ("Latin", "Greek", "Greek") and r[3] == ("Germanic",) * 3 and r[4] == ("Latin",) * 3 and r[5] == ("Unknown",) * 3
    fixes = spark.createDataFrame([(1, "French"), (3, "Germanic")], "word_id long, p string")
    c = {x.word_id: (x.direct, x.corrected) for x in lineage.corrected(lineage.readings(lines, languages), fixes).collect()}
    assert c[1] == ("French", True) and c[3] == ("Germanic", False) and c[2] == ("Latin", False)


def test_notes(spark):
    n = stored(spark)
    prime = lineage.primary(lineage.spines(n))
    languages = spark.createDataFrame([("Latin", "75 BC-476", 1, -75), ("Greek", "x", 0, -900)], "name string, era_label string, era_certain int, era_start int")
    coined = spark.createDataFrame([(5, "coined by X")], "word_id long, text string")
    got = {r.word_id: [tuple(x) for x in r.notes] for r in notes.note_columns(n, prime, prime.select("word_id", F.col("spine").alias("line")), languages, coined).collect()}
    assert got[1] == [("era", "English took this from Latin, spoken 75 BC-476")] and got[2] == [("formation", "built from bag + pipe + -s")] and got[5] == [("coinage", "coined by X")]
    assert got[6][0] == ("calque", "a word-for-word translation of Latin c") and 3 not in got
    lined = [
        (9, 1, "0", "", "English", "w", "head", None, None, None), (9, 1, "0.0", "0", "Latin", "a", "borrowed", None, None, None), (9, 1, "0.0.0", "0.0", "Latin", "b", "root", None, None, None), (9, 1, "0.0.0.0", "0.0.0", "Latin", "c", "root", None, None, None),
        (9, 1, "0.0.0.0.0", "0.0.0.0", "Latin", "d", "root", None, None, None), (9, 1, "0.2", "0", "Old French", "e", "borrowed", None, None, None), (9, 1, "0.2.0", "0.2", "Latin", "f", "derived", None, None, None), (9, 1, "0.2.1", "0.2", "Greek", "g", "derived", None, None, None),
    ]
    at, edges = notes.diagram(spark.createDataFrame(lined, NODE))
    # of a run of root citations every other one is taken in; only first children are followed; rows are compact
    assert {(r.col, r["row"], r.term, r.term2) for r in at.collect()} == {(0, 1, "a", "b"), (0, 1, "c", "d"), (1, 0, "e", None), (1, 1, "f", None)}
    assert sorted((r.col, r["row"], r.below) for r in edges.collect()) == [(0, 1, 1), (1, 0, 1)]


def test_lookups(spark):
    known = spark.createDataFrame([("deru-", "tree"), ("ab", "x"), ("ab-", "y"), ("-frī", "suffix")], "k string, v string")
    asked = spark.createDataFrame([("*deru",), ("*DERU-",), ("*ab--",), ("*frī",), (None,)], "t string")
    assert {tuple(r) for r in notes.root_glosses(asked, "t", known, "k", "v").collect()} == {("*deru", "tree"), ("*DERU-", "tree"), ("*ab--", None), ("*frī", None)}
    d = notes.with_definition(spark.createDataFrame([("wolves",), ("wolf",), ("zz",)], "w string"), "w", spark.createDataFrame([("wolf", "an animal")], "word string, gloss string"), spark.createDataFrame([("wolves", "wolf")], "form string, base string"))
    assert {tuple(r) for r in d.collect()} == {("wolves", "an animal", "wolf"), ("wolf", "an animal", None), ("zz", None, None)}
    words = spark.createDataFrame([(1, "March", "march", 1), (2, "march", "march", 2), (3, "Ran", "ran", 1)], "word_id long, headword string, key_lower string, ety_count int")
    typed = spark.createDataFrame([("March",), ("march",), ("MARCH",), ("ran",), ("x",), (None,)], "t string")
    got = {r.typed: (r.headword, r.kind) for r in shares.ranked_lookup(typed, "t", shares.surface_forms(words), words).collect()}
    assert got == {"March": ("March", "verbatim"), "march": ("march", "exact"), "MARCH": ("march", "exact"), "ran": ("Ran", "case"), "x": (None, None)}


def test_consensus(spark):
    counts = [("-ness", 7529, 7533), ("er", 345, 348), ("man", 574, 1072), ("few", 4, 4), ("edge", 19, 20), ("under", 18, 20)]
    rows = spark.createDataFrame([(t, i < k) for t, k, n in counts for i in range(n)], "term string, flag boolean")
    assert {r.term for r in shares.consensus(rows, "term", F.col("flag")).collect()} == {"-ness", "er", "edge"}


REL = "term_id string, term string, reltype string, related_lang string, related_term string, pos int, group_tag string, parent_tag string"


def test_relation_groups(spark):
    rows = spark.createDataFrame(
        [
            ("1", "sandal", "has_root", "Proto-Q", "r", 0, None, None), ("1", "sandal", "group_derived_root", None, None, 1, "g1", None), ("1", "sandal", "inherited_from", "Middle English", "s", 2, "g2", "g1"), ("1", "sandal", "derived_from", "Latin", "s", 3, None, "g2"),
            ("1", "sandal", "cognate_of", "Dutch", "s", 4, None, None), ("2", "loop", "group_derived_root", None, None, 0, "a", None), ("2", "loop", "group_related_root", None, None, 1, "b", "a"), ("2", "loop", "group_related_root", None, None, 2, "a", "b"), ("2", "loop", "derived_from", "Latin", "x", 3, None, "b"),
            ("3", "stub", "has_root", "Proto-Q", "q", 0, None, None),
        ],
        REL,
    )
    languages = spark.createDataFrame([("Latin", "Latin", -75, 476), ("Middle English", "Germanic", 1100, 1500), ("Proto-Q", "PIE", -4000, -2000)], "name string, bucket string, era_start int, era_end int")
    r = relations.records(rows, languages)
    got = {x.term: x.record for x in r.collect()}
    assert got["sandal"].chain == ["Latin", "PIE"] and got["sandal"].native and got["sandal"].root_lang == "Latin" and got["sandal"].root_pie
    assert got["loop"].chain == ["Latin"] and got["stub"].prox_kind == "root"
    pointers = spark.createDataFrame([("stub", "sandal#1", 0), ("far", "stub", 0), ("far", "-x", 0), ("lost", "nobody", 0)], "term string, base string, priority int")
    done = {x.term: (x.record.chain, x.via) for x in relations.patched_stubs(r, pointers).collect()}
    assert done["stub"] == (["Latin", "PIE"], "sandal") and done["far"] == (["Latin", "PIE"], "sandal") and "lost" not in done and done["sandal"][1] is None


def test_compounds_and_orphans(spark):
    p = spark.createDataFrame([("upside", 0, "up"), ("upside", 1, "Side"), ("oddbit", 0, "odd"), ("oddbit", 1, "bit"), ("up", 0, "u"), ("solo", 0, "up")], "word string, place int, part string")
    known = spark.createDataFrame([("up",), ("side",), ("odd",), ("u",)], "term string")
    assert [tuple(r) for r in relations.compounds(p, known).collect()] == [("upside", ["up", "Side"])]
    b = spark.createDataFrame([("w", 1, "L", "a", 1, False), ("w", 2, "L", "a", 3, True), ("w", 3, "L", "b", 1, False)], "key string, branch int, lang string, term string, size int, inner boolean")
    assert {r.branch for r in relations.without_orphans(b, "key").collect()} == {2, 3}


def test_inherited_roots(spark):
    links = spark.createDataFrame([("b", "a"), ("c", "b"), ("d", "e"), ("e", "d")], "word string, base string")
    roots = spark.createDataFrame([("a", "R")], "word string, root string")
    assert {tuple(r) for r in lineage.inherited_roots(links, roots).collect()} == {("a", "R", "a"), ("b", "R", "a"), ("c", "R", "a")}


def test_shares(spark):
    docs = spark.createDataFrame([(1, "the table and the table"), (2, ""), (3, None)], "doc_id int, text string")
    lex = spark.createDataFrame([("table", "French"), ("the", "Germanic")], "form string, bucket string")
    s = {r.bucket: r for r in shares.shares(shares.resolved_tokens(shares.token_counts(docs, ["doc_id"]), lex), ["doc_id"]).collect()}
    assert (s["French"].votes, s["French"].pct_all, s["French"].pct_resolved) == (2.0, 40.0, 50.0) and s["Unknown"].pct_resolved is None
    s = {r.bucket: r.votes for r in shares.shares(shares.resolved_tokens(shares.token_counts(docs, [], connectors=False), lex), []).collect()}
    assert s == {"French": 2.0}
    v = {r.part: r.votes for r in shares.split_votes(spark.createDataFrame([(1, ["up", "side"]), (2, []), (3, ["up"])], "k int, w array<string>"), "k", "w").collect()}
    assert v == {"up": 1.5, "side": 0.5}


def test_all_surface_forms(spark):
    words = spark.createDataFrame([(1, "wolf", "wolf", "resolved"), (2, "profession", "profession", "resolved"), (3, "professional", "professional", "none"), (4, "Ryan", "ryan", "stub"), (5, None, None, "none")], "word_id long, headword string, key_lower string, status string")
    inflected = spark.createDataFrame([("wolves", "Wolf"), ("wolf", "ryan")], "form string, base string")
    got = {(r.form, r.kind): r.word_id for r in shares.all_surface_forms(words, inflected).collect()}
    assert got["wolves", "inflection"] == 1 and ("wolf", "inflection") not in got and got["professional", "derivation"] == 2
    assert got["ryans", "generated"] == 4 and got["Ryan", "verbatim"] == 4 and got["ryan", "case"] == 4


def test_family(spark):
    n, t = forests(spark)
    got = forest.family(n, t, "English", "brother", budget=4).collect()
    assert len(got) == 9 and sum(r.shown for r in got) == 4 and sum(r.match for r in got) == 2
    assert {r.term for r in got if r.on_path} == {"b", "broþor", "broþer", "brother"} and {r.term for r in got if r.spliced} == {"b"}
    assert forest.family(n, t, "English", "nothing").count() == 0


def test_stubs_and_strays(spark):
    n = stored(spark)
    extra = spark.createDataFrame([(8, 1, "0", "", "English", "s", "head", None, None, None), (8, 1, "0.0", "0", "PIE", "r", "root", "related", "true", None)], NODE)
    got = {r.word_id: r.stub for r in lineage.stubs(n.unionByName(extra)).collect() if r.tree_no == 1}
    assert got[8] and got[5] and not got[1] and not got[3]
    lines = lineage.primary(lineage.spines(n)).select("word_id", F.col("spine").alias("line"))
    assert lineage.strays(lines, n).count() == 0 and lineage.strays(lines, n.where("lang <> 'Greek'")).collect()[0].lang == "Greek"


def test_strays_are_looked_for_in_the_trees_of_the_word(spark):
    n = stored(spark)
    prime = lineage.primary(lineage.spines(n))
    lookup = spark.createDataFrame([("pipe", 1), ("bag", 3), ("bagpipe", 2)], "form string, word_id long")
    own = prime.withColumn("spine", F.expr("filter(spine, s -> s.rel <> 'formed_from')"))
    lines = lineage.lineages(own, lineage.components(n, prime, lookup))
    shown = lineage.drawn(lineage.trees_drawn(n, prime, lookup), n)
    assert {r.lang for r in shown.where("word_id = 2").collect()} == {"English", "Middle English", "Old English", "Latin", "Greek", "Proto-X"}
    assert lineage.strays(lines, shown).count() == 0
    # Latin and Greek are drawn for word 1 (Latin for others too), but not in the tree of word 2, whose line goes through word 1
    assert {tuple(r) for r in lineage.strays(lines, n).collect()} == {(2, "Latin"), (2, "Greek")}
    # a component with a donor of its own keeps that and is not opened
    kept = n.unionByName(spark.createDataFrame([(2, 1, "0.1.0", "0.1", "Dutch", "pijp", "borrowed", None, None, None)], NODE))
    assert {tuple(r) for r in lineage.strays(lines, lineage.drawn(lineage.trees_drawn(kept, prime, lookup), kept)).collect()} == {(2, "Latin"), (2, "Greek")}
    read = spark.createDataFrame([(1, "Latin"), (3, "Latin"), (5, None)], "word_id long, root_lang string")
    assert [tuple(r) for r in lineage.strays(lines, shown, read).collect()] == [(3, "Latin")]


def test_drawn_depth_and_loops(spark):
    rows = [r for i in range(1, 8) for r in [(i, 1, "0", "", "English", f"w{i}", "head", None, None, None), (i, 1, "0.0", "0", "English", f"w{i % 7 + 1}", "formed_from", None, None, None), (i, 1, "0.1", "0", f"L{i}", "x", "root", None, None, None)]]
    n = spark.createDataFrame(rows, NODE)
    prime = lineage.primary(lineage.spines(n))
    lookup = spark.createDataFrame([(f"w{i}", i) for i in range(1, 8)], "form string, word_id long")
    assert {r.lang for r in lineage.drawn(lineage.trees_drawn(n, prime, lookup), n).where("word_id = 1").collect()} == {"English", "L1", "L2", "L3", "L4", "L5"}
    two = n.where("word_id < 3").withColumn("term", F.when((F.col("word_id") == 2) & (F.col("rel") == "formed_from"), "W1").otherwise(F.col("term")))
    assert {r.lang for r in lineage.drawn(lineage.trees_drawn(two, prime, lookup.unionByName(spark.createDataFrame([("W1", 3)], "form string, word_id long"))), two).where("word_id = 1").collect()} == {"English", "L1", "L2"}


def test_inheritance_ends_only_when_nothing_changes(spark):
    far = [(f"w{i:02}", f"w{i - 1:02}") for i in range(1, 24)]
    roots = spark.createDataFrame([("w00", "R")], "word string, root string")
    assert {tuple(r) for r in lineage.inherited_roots(spark.createDataFrame(far, "word string, base string"), roots).collect()} == {(f"w{i:02}", "R", "w00") for i in range(24)}
    languages = spark.createDataFrame([("Latin", "Latin", -75, 476), ("Proto-Q", "PIE", -4000, -2000)], "name string, bucket string, era_start int, era_end int")
    rel = [("1", "w00", "derived_from", "Latin", "x", 0, None, None), ("2", "explain", "derived_from", "Latin", "y", 0, None, None), ("3", "walked", "has_root", "Proto-Q", "q", 0, None, None), ("4", "walk", "derived_from", "Latin", "z", 0, None, None)]
    r = relations.records(spark.createDataFrame(rel, REL), languages)
    more = [("unexplained", "explained"), ("unheard", "heard"), ("unwalked", "walked"), ("reunexplained", "unexplained")]
    pointers = spark.createDataFrame([(t, b, 0) for t, b in far + more], "term string, base string, priority int")
    inflected = spark.createDataFrame([("heard", "w00"), ("explaineds", "w00")], "form string, base string")
    via = {x.term: x.via for x in relations.patched_stubs(r, pointers, inflected=inflected).collect()}
    assert all(via[f"w{i:02}"] == "w00" for i in range(1, 24))
    assert via["unexplained"] == via["reunexplained"] == "explain" and via["unheard"] == "w00"
    # a stub is a record, so its stems are not tried
    assert "unwalked" not in via and via["walked"] is None


def test_groups_follow_depth_hints(spark):
    rel = [
        ("1", "a", "derived_from", "Latin", "l", 0, None, None), ("1", "a", "derived_from", "Nowhere", "n", 1, None, None), ("1", "a", "derived_from", "Old French", "f", 2, None, None),
        ("2", "b", "derived_from", "Old French", "f", 0, None, None), ("2", "b", "has_root", "Proto-Indo-European", "r", 1, "g", None), ("2", "b", "derived_from", "French", "m", 2, None, "g"),
    ]
    languages = spark.createDataFrame([("Latin", "Latin", -75, 476), ("Old French", "French", 800, 1400), ("French", "Modern", 1600, 9999), ("Nowhere", "Other", None, None), ("Proto-Indo-European", "PIE", -4000, -2000)], "name string, bucket string, era_start int, era_end int")
    got = {x.term: x.record.chain for x in relations.records(spark.createDataFrame(rel, REL), languages).collect()}
    assert got == {"a": ["Other", "French", "Latin"], "b": ["Modern", "French", "PIE"]}


def test_groups_however_deep(spark):
    rows = [("1", "a", "derived_from", f"L{i:02}", "x", i, f"g{i}", f"g{i - 1}" if i else None) for i in range(40)]
    got = relations.expanded(spark.createDataFrame(rows, REL)).orderBy("path").collect()
    assert [r.lang for r in got] == [f"L{i:02}" for i in range(40)]


def test_chains_of_whole_lines(spark, tmp_path):
    from stemline.plans import etl

    rows = [(1, 1, None, "Latin", "l/é"), (2, 1, 1, None, None), (3, 1, 2, "Old French", "f"), (4, 1, 3, "English", "e"), (5, 2, 6, "Latin", "x"), (6, 2, 5, "French", "y"), (7, 2, 6, "English", "z"), (8, 3, 9, "Latin", "lost parent")]
    spark.createDataFrame(rows, "node_id long, tree_id long, parent_id long, lang string, term string").write.parquet(f"{tmp_path}/descendant_node.parquet")
    spark.createDataFrame([("Latin", "Latin", -75, 476), ("Old French", "French", 800, 1400), ("French", "French", 1600, 9999)], "name string, bucket string, era_start int, era_end int").write.parquet(f"{tmp_path}/languages.parquet")
    line = {k: [] for k in "1345678"}
    for r in relations.expanded(etl._ancestor_rows(spark, str(tmp_path))).orderBy("term_id", "path").collect():
        line[r.term_id].append((r.lang, r.related))
    assert line["4"] == [("Old French", "f"), ("Latin", "l/é")] and line["3"] == [("Latin", "l/é")] and line["1"] == line["8"] == []
    assert line["5"] == [("French", "y"), ("Latin", "x")] and line["7"] == [("French", "y"), ("Latin", "x")]
    assert {r.term_id: r.chain for r in etl.relation_chains(spark, str(tmp_path)).collect()} == {"3": "Latin", "4": "French>Latin", "5": "French>Latin", "6": "Latin>French", "7": "French>Latin"}
