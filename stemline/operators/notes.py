"""Side notes on words, lookups with fallbacks, cards, and the layout of a tree as a diagram."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, Window

from stemline.functions import classify, text


def note_columns(nodes: DataFrame, prime: DataFrame, lines: DataFrame, languages: DataFrame, coinages: DataFrame | None = None) -> DataFrame:
    """``word_id, notes``: an array of ``kind, text`` in fixed order: coinage, calque, formation, era. Words without any are left out."""
    heads = nodes.join(prime.select("word_id", "tree_no"), ["word_id", "tree_no"], "left_semi").where("parent_path = '0'")
    heads = heads.withColumn("place", F.element_at(F.split("node_path", r"\."), -1).cast("int"))
    calque = heads.where("rel = 'calque' AND lang IS NOT NULL").groupBy("word_id").agg(F.min_by(F.concat(F.lit("a word-for-word translation of "), F.concat_ws(" ", "lang", "term")), "place").alias("calque"))
    parts = heads.where("rel = 'formed_from' AND term IS NOT NULL").groupBy("word_id").agg(F.array_sort(F.collect_list(F.struct("place", "term"))).alias("p"))
    parts = parts.where(F.size("p") >= 2).select("word_id", F.concat(F.lit("built from "), F.array_join(F.transform("p", lambda s: s["term"]), " + ")).alias("formation"))
    behind = F.slice("line", F.lit(2), F.greatest(F.size("line") - 1, F.lit(0)))
    donor = F.get(F.filter(behind, lambda s: ~classify.is_english_stage(s["lang"]) & (F.coalesce(s["rel"], F.lit("")) != "root")), F.lit(0))["lang"]
    label = languages.where("era_certain = 1 AND era_label IS NOT NULL").groupBy(F.col("name").alias("donor")).agg(F.min("era_label").alias("label"))
    era = lines.select("word_id", donor.alias("donor")).join(label, "donor").select("word_id", F.concat(F.lit("English took this from "), "donor", F.lit(", spoken "), "label").alias("era"))
    j = prime.select("word_id").distinct().join(calque, "word_id", "left").join(parts, "word_id", "left").join(era, "word_id", "left")
    if coinages is not None:
        j = j.join(coinages.groupBy("word_id").agg(F.min("text").alias("coinage")), "word_id", "left")
    else:
        j = j.withColumn("coinage", F.lit(None).cast("string"))
    notes = F.array_compact(F.array(*[F.when(F.col(k).isNotNull(), F.struct(F.lit(k).alias("kind"), F.col(k).alias("text"))) for k in ("coinage", "calque", "formation", "era")]))
    return j.select("word_id", notes.alias("notes")).where(F.size("notes") > 0)


def lower_then_typed(asked: DataFrame, word: str, known: DataFrame, key: str, value: str) -> DataFrame:
    """The record of a word in lower case, else as typed: ``word, value``."""
    k = known.groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
    low, typed = k.select(F.col("k").alias("k1"), F.col("v").alias("v1")), k.select(F.col("k").alias("k2"), F.col("v").alias("v2"))
    a = asked.select(F.trim(F.col(word)).alias("word")).where("word <> ''").distinct()
    j = a.join(low, F.lower("word") == F.col("k1"), "left").join(typed, F.col("word") == F.col("k2"), "left")
    return j.select("word", F.coalesce("v1", "v2").alias("value"))


def root_glosses(terms: DataFrame, term: str, known: DataFrame, key: str, value: str) -> DataFrame:
    """``term, value``: by the exact key, else with trailing hyphens and case folded where only one key folds so."""
    k = known.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
    fold = lambda c: F.lower(F.regexp_replace(c, "-+$", ""))
    folded = k.groupBy(fold(F.col("k")).alias("f")).agg(F.count(F.lit(1)).alias("n"), F.min("v").alias("v2")).where("n = 1").select("f", "v2")
    a = terms.select(F.col(term).alias("term"), text.root_key(F.col(term)).alias("a")).where("term IS NOT NULL").distinct()
    j = a.join(k, F.col("a") == F.col("k"), "left").join(folded, fold(F.col("a")) == F.col("f"), "left")
    return j.select("term", F.coalesce("v", "v2").alias("value"))


def cased_lookup(asked: DataFrame, word: str, known: DataFrame, key: str, value: str) -> DataFrame:
    """``word, value, case_fallback``: the record in lower case, else as typed, else with a capital, which is flagged: it may be another word."""
    k = known.where(F.col(key).isNotNull()).groupBy(F.col(key).alias("k")).agg(F.min(value).alias("v"))
    a = asked.select(F.trim(F.col(word)).alias("word")).where("word <> ''").distinct()
    capital = F.concat(F.upper(F.substring("word", 1, 1)), F.lower(F.expr("substring(word, 2)")))
    tries = a.select("word", F.posexplode(F.array(F.lower("word"), F.col("word"), capital)).alias("i", "k")).join(k, "k")
    best = tries.groupBy("word").agg(F.min_by(F.struct("v", "i"), "i").alias("b"))
    return a.join(best, "word", "left").select("word", F.col("b.v").alias("value"), F.coalesce(F.col("b.i") == 2, F.lit(False)).alias("case_fallback"))


def diagram(nodes: DataFrame) -> tuple[DataFrame, DataFrame]:
    """Nodes and edges of each tree as a diagram: ``word_id, tree_no, col, row, lang, term, term2`` and ``word_id, tree_no, col, row, below``.

    A column a branch, in which only first children are followed; a row for each depth that the tree uses, by the depth hint.
    A node whose only child is a root citation of its own language takes that in (``term2``) and goes on with the
    child's first child. Edges join neighbouring rows of a column.
    """
    tree = ["word_id", "tree_no"]
    steps = F.split("node_path", r"\.")
    n = nodes.where("parent_path <> ''").select(*tree, "node_path", "parent_path", "lang", "term", "rel", (F.size(steps) - 1).alias("level"), F.element_at(steps, -1).cast("long").alias("place"))
    kids = n.groupBy(*tree, "parent_path").agg(F.min("place").alias("eldest"), F.count(F.lit(1)).alias("kids"))
    n = n.join(kids, [*tree, "parent_path"])
    # on the line are branches and all whose way there takes first children only
    ways = n.select(*tree, "node_path", F.explode(F.transform(F.sequence(F.lit(2), F.greatest(F.col("level"), F.lit(2))), lambda i: F.array_join(F.slice(steps, F.lit(1), i + 1), "."))).alias("on"))
    other = n.where("level > 1 AND place <> eldest").select(*tree, F.col("node_path").alias("on"))
    off = ways.join(other, [*tree, "on"], "left_semi").select(*tree, "node_path").distinct()
    line = n.join(off, [*tree, "node_path"], "left_anti").withColumn("branch", F.get(steps, F.lit(1)).cast("long"))
    column = Window.partitionBy(*tree, "branch").orderBy("level")
    line = line.withColumn("same", (F.col("level") > 1) & (F.col("kids") == 1) & (F.col("rel") == "root") & F.coalesce(F.col("lang") == F.lag("lang").over(column), F.lit(False)))
    # of citations behind one another every other one is taken in
    line = line.withColumn("run", F.coalesce(F.col("level") - F.max(F.when(~F.coalesce("same", F.lit(False)), F.col("level"))).over(column), F.lit(0)))
    line = line.withColumn("in", F.col("run") % 2 == 1).withColumn("term2", F.when(F.lead("in").over(column), F.lead("term").over(column)))
    shown = line.where(~F.col("in")).withColumn("col", F.dense_rank().over(Window.partitionBy(*tree).orderBy("branch")) - 1)
    shown = shown.withColumn("row", F.dense_rank().over(Window.partitionBy(*tree).orderBy(classify.depth_hint(F.col("lang")))) - 1)
    edges = shown.select(*tree, "col", "row", F.lead("row").over(Window.partitionBy(*tree, "col").orderBy("row", "level")).alias("below")).where("below IS NOT NULL")
    return shown.select(*tree, "col", "row", "lang", "term", "term2"), edges


def with_definition(words: DataFrame, word: str, known: DataFrame, base: DataFrame) -> DataFrame:
    """``word, gloss, defined_by``: a word's own gloss, else that of the word it is a form of (``form, base``)."""
    g = known.groupBy(F.col("word").alias("w1")).agg(F.min("gloss").alias("g1"))
    b = base.groupBy("form").agg(F.min("base").alias("base"))
    a = words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct()
    j = a.join(g, F.col("word") == F.col("w1"), "left").join(b, F.col("word") == F.col("form"), "left")
    j = j.join(g.select(F.col("w1").alias("w2"), F.col("g1").alias("g2")), F.col("base") == F.col("w2"), "left")
    return j.select("word", F.coalesce("g1", "g2").alias("gloss"), F.when(F.col("g1").isNull() & F.col("g2").isNotNull(), F.col("base")).alias("defined_by"))
