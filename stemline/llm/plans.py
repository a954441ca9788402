"""Queries of the text problems (2, 4, 6, 8, 9, 10), each over its whole tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stemline.llm import aliases, bktree, bpe, lookalike, packing, reading, survivor
from stemline.session import cut, table

ETY_KEY, ETY_FIELDS = ["word_id", "ordinal"], ["label", "pos_list", "shape", "confidence", "gloss"]


def p2_found(spark: SparkSession, sf: str) -> DataFrame:
    n = lookalike.alike_pairs(table(spark, sf, "descendant_node"), "node_id", ["tree_id", "lang"], "term")
    t = lookalike.alike_pairs(table(spark, sf, "descendant_tree"), "tree_id", ["lang"], "raw_term")
    return n.select(F.lit("descendant_node").alias("tab"), "id_a", "id_b").unionByName(t.select(F.lit("descendant_tree").alias("tab"), "id_a", "id_b"))


def p2_forms(spark: SparkSession, sf: str) -> DataFrame:
    """Every term in its consistent form."""
    n = table(spark, sf, "descendant_node").select(F.lit("descendant_node").alias("tab"), F.col("node_id").alias("id"), lookalike.consistent_form("term").alias("form"))
    t = table(spark, sf, "descendant_tree").select(F.lit("descendant_tree").alias("tab"), F.col("tree_id").alias("id"), lookalike.consistent_form("raw_term").alias("form"))
    return n.unionByName(t)


def p2_classes(spark: SparkSession, sf: str) -> DataFrame:
    """Every row with its class of equal-looking texts and the number of rows in it that are spelled otherwise."""
    n = lookalike.alike_classes(table(spark, sf, "descendant_node"), "node_id", ["tree_id", "lang"], "term")
    t = lookalike.alike_classes(table(spark, sf, "descendant_tree"), "tree_id", ["lang"], "raw_term")
    return n.select(F.lit("descendant_node").alias("tab"), "*").unionByName(t.select(F.lit("descendant_tree").alias("tab"), "*"))


def _claims(spark: SparkSession, sf: str) -> DataFrame:
    ranked = survivor.ranked_sources(table(spark, sf, "sources"), table(spark, sf, "source_precedence"))
    return survivor.long_claims(table(spark, sf, "etymology"), ETY_KEY, ETY_FIELDS, ranked)


def p6_found(spark: SparkSession, sf: str) -> DataFrame:
    return survivor.by_precedence(_claims(spark, sf), ETY_KEY).select(*ETY_KEY, "field", F.col("id").alias("ety_id"))


P6_SQL = r"""
WITH c AS (
  SELECT e.*, p.priority, row_number() OVER (PARTITION BY e.word_id, e.ordinal ORDER BY p.priority NULLS LAST,
    CASE WHEN p.priority IS NULL THEN CASE lower(trim(s.kind)) WHEN 'curated' THEN 0 WHEN 'extract' THEN 1 WHEN 'derived' THEN 2 ELSE 3 END ELSE 0 END,
    e.recorded_at DESC NULLS LAST, e.ety_id) AS r, count(*) OVER (PARTITION BY e.word_id, e.ordinal) AS n, coalesce(s.additive_only, 0) = 1 AS barred
  FROM etymology e LEFT JOIN sources s USING (source_id) LEFT JOIN source_precedence p USING (source_id)),
l AS (
  SELECT word_id, ordinal, 'label' AS field, label AS v, ety_id, r FROM c WHERE n > 1 AND NOT barred
  UNION ALL SELECT word_id, ordinal, 'pos_list', pos_list, ety_id, r FROM c WHERE n > 1 AND NOT barred
  UNION ALL SELECT word_id, ordinal, 'shape', shape, ety_id, r FROM c WHERE n > 1 AND NOT barred
  UNION ALL SELECT word_id, ordinal, 'confidence', confidence, ety_id, r FROM c WHERE n > 1 AND NOT barred
  UNION ALL SELECT word_id, ordinal, 'gloss', gloss, ety_id, r FROM c WHERE n > 1 AND NOT barred)
SELECT word_id, ordinal, field, arg_min(ety_id, r) AS ety_id FROM l
WHERE regexp_replace(lower(v), '[^\p{L}\p{N}]', '', 'g') NOT IN ('', 'na', 'none', 'null', 'tbd', 'unknown') GROUP BY ALL
"""


def p6_records(spark: SparkSession, sf: str) -> DataFrame:
    """One record an etymology by summed votes."""
    return survivor.records(survivor.by_votes(_claims(spark, sf), ETY_KEY), ETY_KEY, ETY_FIELDS)


def p8_ids(spark: SparkSession, sf: str) -> DataFrame:
    return bpe.encode_column(table(spark, sf, "documents"))


def p9_containers(spark: SparkSession, sf: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf, "documents"))


def p9_fill(spark: SparkSession, sf: str) -> DataFrame:
    """How many containers are filled to which degree."""
    c = p9_containers(spark, sf).groupBy("container").agg(F.sum("size").alias("tokens"), F.count(F.lit(1)).alias("items"))
    return c.groupBy((F.floor(F.col("tokens") * 100 / packing.CAPACITY)).alias("percent")).agg(F.count(F.lit(1)).alias("containers"), F.sum("items").alias("items"), F.sum("tokens").alias("tokens"))


def p9_report(spark: SparkSession, sf: str) -> DataFrame:
    """Containers and their lower bound, and what must not be: overfull ones, lost, doubled or altered items."""
    items = packing.items_of(bpe.count_column(table(spark, sf, "documents")), packing.CAPACITY)
    items = cut(items)
    return packing.report(cut(packing.pack(items)), items)


def p4_found(spark: SparkSession, sf: str) -> DataFrame:
    return aliases.match_aliases(table(spark, sf, "language_alias"), table(spark, sf, "languages"))


def p4_report(spark: SparkSession, sf: str) -> DataFrame:
    """Typed texts with the name and code they mean, or marked as unmatched, and how often each was typed."""
    typed = table(spark, sf, "language_alias").where("lang_id IS NULL").select("alias_id", "alias")
    languages = table(spark, sf, "languages").select("lang_id", "name", "wikt_code")
    found = p4_found(spark, sf).join(languages, "lang_id", "left").join(typed, "alias_id")
    return found.groupBy("alias", "name", "wikt_code", (F.col("lang_id") >= 0).alias("matched")).agg(F.count(F.lit(1)).alias("times"))


def p4_nearest(spark: SparkSession, sf: str) -> DataFrame:
    """The name of the list nearest to each typed text by the plain edit metric, within 3 edits."""
    typed = table(spark, sf, "language_alias").where("lang_id IS NULL").select(F.lower(F.trim("alias")).alias("alias"))
    names = table(spark, sf, "languages").select(F.lower("name").alias("name"))
    return bktree.nearest(typed, "alias", names, "name", most=3)


def p10_found(spark: SparkSession, sf: str) -> DataFrame:
    return reading.reading_levels(table(spark, sf, "documents"), table(spark, sf, "reading_label"))


def p10_profile(spark: SparkSession, sf: str) -> DataFrame:
    """The corpus by reading level and kind of document."""
    d = table(spark, sf, "documents").select("doc_id", "kind", "n_chars")
    return p10_found(spark, sf).join(d, "doc_id").groupBy("level", "kind").agg(F.count(F.lit(1)).alias("documents"), F.sum("n_chars").alias("characters"))


QUERIES = {f.__name__: f for f in (p2_found, p2_forms, p2_classes, p4_found, p4_report, p4_nearest, p6_found, p6_records, p8_ids, p9_containers, p9_fill, p9_report, p10_found, p10_profile)}
P6_RECORDS_SQL = r"""
WITH c AS (
  SELECT e.*, CASE WHEN p.priority IS NOT NULL THEN 100.0 / (10.0 + p.priority) ELSE 1.0 / (1.0 + k) END * pow(2.0, -coalesce((1893456000.0 - epoch_us(e.recorded_at) / 1e6) / 86400.0, 3650.0) / 365.0) AS vote,
    row_number() OVER (ORDER BY p.priority NULLS LAST, CASE WHEN p.priority IS NULL THEN k ELSE 0 END, e.recorded_at DESC NULLS LAST, e.ety_id) AS r
  FROM etymology e LEFT JOIN (SELECT source_id, coalesce(additive_only, 0) = 1 AS barred, CASE lower(trim(kind)) WHEN 'curated' THEN 0 WHEN 'extract' THEN 1 WHEN 'derived' THEN 2 ELSE 3 END AS k FROM sources) s USING (source_id)
  LEFT JOIN source_precedence p USING (source_id) WHERE NOT coalesce(barred, false)),
l AS (SELECT word_id, ordinal, unnest(['label', 'pos_list', 'shape', 'confidence', 'gloss']) AS field, unnest([label, pos_list, shape, confidence, gloss]) AS v, vote, r FROM c),
n AS (SELECT *, lower(trim(regexp_replace(v, '\s+', ' ', 'g'))) AS norm FROM l WHERE regexp_replace(lower(v), '[^\p{L}\p{N}]', '', 'g') NOT IN ('', 'na', 'none', 'null', 'tbd', 'unknown')),
g AS (SELECT word_id, ordinal, field, norm, sum(vote) AS votes, min(r) AS best, arg_min(v, r) AS v FROM n GROUP BY ALL),
w AS (SELECT word_id, ordinal, field, arg_max(v, struct_pack(a := round(votes, 9), b := -best)) AS v FROM g GROUP BY ALL)
SELECT word_id, ordinal, max(v) FILTER (WHERE field = 'label') AS label, max(v) FILTER (WHERE field = 'pos_list') AS pos_list, max(v) FILTER (WHERE field = 'shape') AS shape,
  max(v) FILTER (WHERE field = 'confidence') AS confidence, max(v) FILTER (WHERE field = 'gloss') AS gloss FROM w GROUP BY ALL
"""
# the distance of the other engine counts bytes; names of the list are ASCII, so any one sign may stand for a letter that is not
P4_NEAREST_SQL = r"""
WITH q AS (SELECT DISTINCT lower(trim(alias)) AS query FROM language_alias WHERE lang_id IS NULL AND alias IS NOT NULL), n AS (SELECT DISTINCT lower(name) AS entry FROM languages WHERE name IS NOT NULL),
d AS (SELECT query, entry, damerau_levenshtein(regexp_replace(query, '[^\x00-\x7F]', '~', 'g'), entry) AS distance FROM q JOIN n ON length(query) - length(entry) BETWEEN -3 AND 3),
b AS (SELECT query, arg_min(struct_pack(e := entry, d := distance), struct_pack(d := distance, e := entry)) AS b FROM d WHERE distance <= 3 GROUP BY 1)
SELECT query, b.e AS entry, CAST(b.d AS INT) AS distance FROM q LEFT JOIN b USING (query)
"""
SQL = {"p6_found": P6_SQL, "p6_records": P6_RECORDS_SQL, "p4_nearest": P4_NEAREST_SQL}
