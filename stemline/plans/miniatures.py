"""Small worlds made in the query for steps that the stored tables never reach, each with what must come out."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stemline.functions import classify, text
from stemline.operators import cascade, forest, lineage, relations, shapes, shares

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str):
    def add(f):
        QUERIES[f.__name__] = f
        SQL[f.__name__] = sql
        return f

    return add


def _values(rows: list[tuple], names: str) -> str:
    """Rows as SQL; texts quoted, nulls kept."""
    cell = lambda v: "NULL" if v is None else ("true" if v else "false") if isinstance(v, bool) else str(v) if isinstance(v, int) else "'" + v.replace("'", "''") + "'"
    return "SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(cell, r)) + ")" for r in rows) + f") v({names})"


def _forest(spark: SparkSession) -> tuple[DataFrame, DataFrame]:
    """Nine trees, the head of each a leaf of the next; two that hold one another; a leaf that is a head twice over."""
    k = spark.range(9)
    up = k.where("id < 8").select((F.col("id") * 10 + 11).alias("node_id"), (F.col("id") + 1).alias("tree_id"), (F.col("id") * 10 + 10).alias("parent_id"), F.lit("Old").alias("lang"), F.concat(F.lit("t"), "id").alias("term"), F.lit(1).alias("ordinal"))
    top = k.select((F.col("id") * 10).alias("node_id"), F.col("id").alias("tree_id"), F.lit(None).cast("long").alias("parent_id"), F.lit("Old").alias("lang"), F.concat(F.lit("c"), "id").alias("term"), F.lit(0).alias("ordinal"))
    under = up.withColumn("parent_id", F.col("tree_id") * 10)
    loop = spark.createDataFrame([(901, 90, None, "Old", "y", 0), (911, 91, None, "Old", "x", 0)], "node_id long, tree_id long, parent_id long, lang string, term string, ordinal int")
    trees = k.select(F.col("id").alias("tree_id"), F.lit("Old").alias("lang"), F.concat(F.lit("t"), "id").alias("term"), (F.col("id") + 2).cast("int").alias("node_count"))
    pair = spark.createDataFrame([(90, "Old", "x", 1), (91, "Old", "y", 1)], "tree_id long, lang string, term string, node_count int")
    nodes = top.unionByName(under).unionByName(loop).withColumn("raw_term", F.col("term"))
    return nodes, trees.unionByName(pair)


@query("""SELECT 't' || k AS term, CAST(least(k + 6, 8) AS BIGINT) AS top_id, 't' || least(k + 6, 8) AS top_term, CAST(least(6, 8 - k) AS INT) AS steps FROM range(9) r(k) UNION ALL VALUES ('x', 91, 'y', 1), ('y', 90, 'x', 1)""")
def climb_miniature(spark, sf):
    """Climbs of no step to six, at most, and two forms that go back to one another."""
    n, t = _forest(spark)
    return forest.climb(n, t).select("term", "top_id", "top_term", "steps")


@query("""SELECT 't' || k AS term, CAST(k + 1 AS BIGINT) AS up_id, 't' || (k + 1) AS up_term FROM range(8) r(k) UNION ALL VALUES ('x', 91, 'y'), ('y', 90, 'x')""")
def parent_tree_miniature(spark, sf):
    n, t = _forest(spark)
    return forest.parent_trees(n, t).select("term", "up_id", "up_term")


@query("""SELECT CAST(k AS BIGINT) AS top, CAST(least(1 + 2 * k, 6) AS BIGINT) AS nodes, CAST(least(k, 2) AS BIGINT) AS spliced FROM range(9) r(k) UNION ALL VALUES (90, 2, 1), (91, 2, 1)""")
def splice_miniature(spark, sf):
    """Leaves continued by the trees they head, down to the sixth level, each form once under a top."""
    n, t = _forest(spark)
    return forest.splice(n, t).groupBy("top").agg(F.count(F.lit(1)).alias("nodes"), F.sum(F.col("spliced").cast("long")).alias("spliced"))


_SEEN = [("ness", 7529, 7533), ("ly", 345, 348), ("man", 574, 1072), ("sea", 2, 287), ("rare", 4, 4), ("edge", 19, 20), ("five", 5, 5)]


@query(_values([(t, a, b) for t, a, b in _SEEN if b >= 5 and a * 100 >= b * 95], "term, flagged, seen"))
def affix_miniature(spark, sf):
    """Terms flagged as affixes in 95 of 100 of at least five sightings."""
    rows = spark.createDataFrame(_SEEN, "term string, flagged int, seen int").select("term", "flagged", F.explode(F.sequence(F.lit(1), F.col("seen"))).alias("i"))
    return shares.consensus(rows.select("term", (F.col("i") <= F.col("flagged")).alias("flag")), "term", F.col("flag"))


_LANGS = [
    ("English", "en", "Germanic", 1500, 9999), ("Middle English", "enm", "Germanic", 1100, 1500), ("Old English", "ang", "Germanic", 450, 1100), ("Old Norse", "non", "Norse", 700, 1400), ("Old French", "fro", "French", 800, 1400),
    ("Latin", "la", "Latin", -75, 476), ("Proto-Indo-European", "ine-pro", "PIE", -4500, -2500), ("Arabic", "ar", "Semitic", 500, 9999), ("Middle French", "frm", "French", 1400, 1600), ("Proto-Germanic", "gem-pro", "Germanic", -500, 200),
]


def _languages(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame([(*x, x[0].startswith("Proto-")) for x in _LANGS], "name string, wikt_code string, bucket string, era_start int, era_end int, is_proto boolean")


_ROWS = [
    # one line in groups of groups, a root inside it, and a group that would hold itself
    ("1", "harbourage", "inherited_from", "Middle English", "a", 0, "g1", None), ("1", "harbourage", "derived_from", "Old French", "b", 1, "g2", "g1"), ("1", "harbourage", "has_root", "Proto-Indo-European", "*r", 2, None, "g2"),
    ("1", "harbourage", "derived_from", "Latin", "c", 3, None, "g2"), ("1", "harbourage", "derived_from", "Arabic", "d", 4, "g1", "g2"),
    # two separate lines: the English one leads although it comes second
    ("2", "backwater", "borrowed_from", "Old French", "bac", 0, None, None), ("2", "backwater", "group_derived_root", None, None, 1, "h1", None), ("2", "backwater", "inherited_from", "Old English", "baec", 2, None, "h1"), ("2", "backwater", "inherited_from", "Proto-Germanic", "*baka", 3, None, "h1"),
    # what states no ancestry, a root alone, and what is no language
    ("3", "thorny", "cognate_of", "Latin", "x", 0, None, None), ("3", "thorny", "has_root", "Proto-Indo-European", "*t", 1, None, None), ("4", "genus", "derived_from", "Translingual", "y", 0, None, None),
    # citations of a foreign word: the most telling relation counts
    ("5", "expostulation", "has_prefix", "Latin", "ex", 0, None, None), ("5", "expostulation", "has_prefix_with_root", "Latin", "postulo", 1, None, None), ("6", "leafy", "has_affix", "English", "leaf", 0, None, None), ("6", "leafy", "has_affix", "English", "-y", 1, None, None),
]
_RELATION = "term_id string, term string, reltype string, related_lang string, related_term string, pos int, group_tag string, parent_tag string"


@query(_values([
    ("1", 1, "inherited", "Middle English"), ("1", 2, "derived", "Old French"), ("1", 3, "root", "Proto-Indo-European"), ("1", 4, "derived", "Latin"),
    ("2", 1, "borrowed", "Old French"), ("2", 2, "inherited", "Old English"), ("2", 3, "inherited", "Proto-Germanic"), ("3", 1, "root", "Proto-Indo-European"),
], "term_id, place, kind, lang"))
def relation_groups_miniature(spark, sf):
    """Ancestry rows in the order of their groups, groups within groups below what opens them."""
    from pyspark.sql import Window

    e = relations.expanded(spark.createDataFrame(_ROWS, _RELATION))
    return e.select("term_id", F.row_number().over(Window.partitionBy("term_id").orderBy("path")).alias("place"), "kind", "lang")


@query(_values([
    ("harbourage", "French", "PIE", "French>Latin>PIE", "derived", "Latin", True), ("backwater", "Germanic", "French", "Germanic>French", "inherited", "Old French", False), ("thorny", "PIE", "PIE", "PIE", "root", "Proto-Indo-European", False),
    ("expostulation", "Latin", "Latin", "Latin", "derived", "Latin", False),
], "term, p, d, chain, prox_kind, root_lang, root_pie"))
def relation_records_miniature(spark, sf):
    """Chain records of grouped rows, English lines first, roots last; and those of words that only cite a foreign one."""
    rows, languages = spark.createDataFrame(_ROWS, _RELATION), _languages(spark)
    r = relations.records(rows, languages).select("term", "record")
    cited = relations.foreign_roots(r, rows, languages)
    told = lambda d: d.select("term", *[F.col(f"record.{c}").alias(c) for c in ("p", "d")], F.array_join("record.chain", ">").alias("chain"), *[F.col(f"record.{c}").alias(c) for c in ("prox_kind", "root_lang", "root_pie")])
    return told(r).unionByName(told(cited))


@query(_values([("leafy", "leaf|-y")], "term, bases"))
def root_candidates_miniature(spark, sf):
    return relations.root_candidates(spark.createDataFrame(_ROWS, _RELATION), ("has_affix",)).select("term", F.array_join("bases", "|").alias("bases"))


_RECORD = "term string, record struct<chain:array<string>,prox_kind:string,root_lang:string,root_pie:boolean,root_term:string>"


@query(_values([("a", "target", None), ("a", None, True), ("b", "target", None), ("b", None, False), ("c", None, False), ("d", None, True)], "term, kind, pie"))
def enrichment_miniature(spark, sf):
    """Reconstructed roots still to be looked up, and records after their answers came in."""
    rows = [("a", (["Germanic"], "inherited", "Proto-Germanic", False, "*a")), ("b", (["Germanic"], "inherited", "Proto-Germanic", False, "*b")), ("c", (["Latin"], "borrowed", "Latin", False, "c")), ("d", (["PIE"], "root", "Proto-Germanic", True, "*d"))]
    r, proto = spark.createDataFrame(rows, _RECORD), _languages(spark).where("is_proto")
    answers = spark.createDataFrame([("Proto-Germanic", "*a", "Proto-Indo-European"), ("Proto-Germanic", "*b", "Latin"), ("Latin", "c", "PIE")], "lang string, term string, deeper string")
    targets = relations.enrichment_targets(r, proto).select(F.expr("substring(term, 2)").alias("term"), F.lit("target").alias("kind"), F.lit(None).cast("boolean").alias("pie"))
    return targets.unionByName(relations.enriched(r, answers, proto).select("term", F.lit(None).cast("string").alias("kind"), F.col("record.root_pie").alias("pie")))


def _t(name: str, *args: str) -> dict:
    return {"name": name, "args": {str(i + 1): a for i, a in enumerate(args)}}


_ENTRIES = [
    ("millrace", [_t("root", "en", "ine-pro", "*m"), _t("inh", "en", "enm", "mille"), _t("inh+", "en", "enm", "mille"), _t("uder", "en", "la", "-"), _t("cog", "en", "la", "z"), _t("col-top"), _t("bor", "en", "ar", "q")], None),
    ("leapyear", [_t("der", "en", "fro", "l"), _t("der", "en", "ine-pro", "*l"), _t("der", "en", "fro", "-p")], None),
    ("ferryman", [_t("bor", "en", "non", "f"), _t("suffix", "en", "ferry", "man")], None),
    ("unlit", [_t("prefix", "en", "un", "lit"), _t("af", "en", "la:lux", "lit"), _t("root", "en", "ine-pro", "*l")], None),
    ("brooding", [_t("ety", "en", ":inh", "enm:brod<ety:inh<ang:brod<unc:1>>>")], None),
    ("stonework", [], "Etymology tree\nLatin s\nOld English stan\nMiddle English ston inh.\nEnglish stonework"),
    ("hollow", [_t("root", "en", "ine-pro", "*h")], None),
    ("nothing", [_t("der", "en", "mul-tax", "N.")], None),
]
_TREES = [
    ("millrace", "chain", 1, 0, "Middle English", "mille", "inherited"), ("millrace", "chain", 2, 1, "Latin", None, "derived"), ("millrace", "chain", 3, 2, "Proto-Indo-European", "*m", "root"),
    ("leapyear", "chain", 1, 0, "Old French", "l", "derived"), ("leapyear", "chain", 2, 1, "Proto-Indo-European", "*l", "root"), ("leapyear", "chain", 3, 1, "Old French", "-p", "formed_from"),
    ("ferryman", "mixed", 1, 0, "Old Norse", "f", "borrowed"), ("ferryman", "mixed", 2, 0, "English", "ferry", "formed_from"), ("ferryman", "mixed", 3, 0, "English", "man", "formed_from"),
    ("unlit", "fork", 1, 0, "English", "un", "formed_from"), ("unlit", "fork", 2, 0, "English", "lit", "formed_from"), ("unlit", "fork", 3, 0, "Latin", "lux", "formed_from"), ("unlit", "fork", 4, 0, "Proto-Indo-European", "*l", "root"),
    ("brooding", "rendered", 1, 0, "Middle English", "brod", "inherited"), ("brooding", "rendered", 2, 1, "Old English", "brod", "inherited"),
    ("stonework", "rendered", 1, 0, "Middle English", "ston", "inherited"), ("stonework", "rendered", 2, 1, "Old English", "stan", "inherited"), ("stonework", "rendered", 3, 2, "Latin", "s", "inherited"),
    ("hollow", "stub", 1, 0, "Proto-Indo-European", "*h", "root"),
]


@query(_values(_TREES, "word, shape, no, parent, lang, term, rel"))
def shapes_miniature(spark, sf):
    """Templates, nested notation and rendered blocks as trees of all five shapes."""
    e = spark.createDataFrame([(w, 1, t, x) for w, t, x in _ENTRIES], "word string, num int, templates array<struct<name:string,args:map<string,string>>>, text string")
    return shapes.assembled(e, _languages(spark)).where("no > 0").select("word", "shape", "no", "parent", "lang", "term", "rel")


@query(_values([("wolves", "form", "wolf"), ("ran", "own", "ran"), ("catnap", "parts", "cat+nap"), ("stub", "own", "stub"), ("lost", "none", ""), ("hillside", "parts", "hill+side"), ("wolf", "own", "wolf")], "word, via, forms"))
def cascade_miniature(spark, sf):
    """Words answered for by themselves, by another form, by parts of parts, by a bare root for want of better, or not at all."""
    records = spark.createDataFrame([("wolf", True, True), ("ran", True, True), ("stub", False, False), ("cat", True, True), ("nap", False, True), ("hill", True, True), ("side", True, True), ("wolves", False, True)], "form string, trusted boolean, usable boolean")
    hand = spark.createDataFrame([("catnap", ["cat", "nap"]), ("lost", ["los", "t"])], "word string, parts array<string>")
    found = spark.createDataFrame([("catnap", ["c", "atnap"]), ("hillside", ["hill", "side"])], "word string, parts array<string>")
    words = spark.createDataFrame([(w,) for w in ("wolves", "ran", "catnap", "stub", "lost", "hillside", "wolf", None)], "word string")
    forms = F.when(F.col("word") == "wolves", F.array(F.lit("wolv"), F.lit("wolf"))).otherwise(text.stem_candidates(F.col("word")))
    return cascade.answered(words, "word", records, forms, cascade.merged_splits(hand, found)).withColumn("forms", F.array_join("forms", "+"))


@query(_values([("armchair", True), ("mountainside", True), ("overactive", True), ("plain", False), ("muskrat", False)], "word, by_hand"))
def hand_split_miniature(spark, sf):
    """Splits made by hand overrule an answer that is another word's, a bare root, or lost its parts; no other."""
    a = spark.createDataFrame([("Armchair", None, "root", False), ("mountainside", "mountain", "donor", False), ("overactive", None, "donor", True), ("plain", None, "donor", False), ("muskrat", "musk", "donor", False)], "word string, via string, kind string, collapsed boolean")
    hand = spark.createDataFrame([("armchair",), ("mountainside",), ("overactive",), ("plain",)], "w string")
    return lineage.hand_split(a, hand.withColumnRenamed("w", "word"), "word").select(F.lower("word").alias("word"), "by_hand")


@query(_values([("Latin", 14), ("Middle English", 0), ("Nowhere", 10), ("Old English", 1), ("Old French", 12), ("Proto-Indo-European", 18)], "name, depth"))
def depth_order_miniature(spark, sf):
    n = spark.createDataFrame([(x,) for x in ("Latin", "Middle English", "Nowhere", "Old English", "Old French", "Proto-Indo-European")], "name string")
    return n.select("name", classify.depth_hint(F.col("name")).alias("depth"))
