"""Queries of the general data problems (1, 3, 5, 7), each over its whole tables."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stemline.operators import compare, hierarchy, nested, skew
from stemline.session import table

NODE_FIELDS = ("lang", "term", "rel", "reltype", "certainty", "is_root", "is_affix")


def p1_found(spark: SparkSession, sf: str) -> DataFrame:
    return nested.flatten_json_trees(table(spark, sf, "word"))


def p1_nodes(spark: SparkSession, sf: str) -> DataFrame:
    """The node table with its own columns, linked to its tree and parent."""
    return nested.flatten_json_trees(table(spark, sf, "word"), fields=NODE_FIELDS).withColumn("rel", F.coalesce("rel", "reltype")).drop("reltype")


def p1_trees(spark: SparkSession, sf: str) -> DataFrame:
    """The tree table: nodes and levels of each tree, and its head's language and term."""
    n = nested.flatten_json_trees(table(spark, sf, "word"), fields=("lang", "term"))
    head = F.col("parent_path") == ""
    return n.groupBy("word_id", "tree_no").agg(
        F.count(F.lit(1)).alias("nodes"),
        F.max(F.size(F.split("node_path", r"\."))).cast("long").alias("levels"),
        F.max(F.when(head, F.col("lang"))).alias("head_lang"),
        F.max(F.when(head, F.col("term"))).alias("head_term"),
    )


def p3_term_stats(spark: SparkSession, sf: str) -> DataFrame:
    s = skew.key_stats(table(spark, sf, "descendant_tree"), "term", "node_count", {"median": 0.5, "p90": 0.9})
    return s.select("term", F.col("n").alias("trees"), F.col("total").alias("sum_nodes"), F.round("mean", 6).alias("mean_nodes"), F.col("highest").alias("max_nodes"), "distinct_values", "mode", "median", "p90")


P3_SQL = """
WITH m AS (
  SELECT term, node_count, row_number() OVER (PARTITION BY term ORDER BY count(*) DESC, node_count) AS r
  FROM descendant_tree WHERE node_count IS NOT NULL GROUP BY term, node_count),
o AS (
  SELECT term, node_count, row_number() OVER (PARTITION BY term ORDER BY node_count) AS r, count(*) OVER (PARTITION BY term) AS n
  FROM descendant_tree WHERE node_count IS NOT NULL),
q AS (
  SELECT term, max(node_count) FILTER (WHERE r = greatest(1, ceil(n * 0.5))) AS median, max(node_count) FILTER (WHERE r = greatest(1, ceil(n * 0.9))) AS p90
  FROM o GROUP BY term)
SELECT t.term, count(*) AS trees, CAST(sum(t.node_count) AS BIGINT) AS sum_nodes, round(avg(t.node_count), 6) AS mean_nodes,
  max(t.node_count) AS max_nodes, count(DISTINCT t.node_count) AS distinct_values, max(m.node_count) AS mode, max(q.median) AS median, max(q.p90) AS p90
FROM descendant_tree t
LEFT JOIN m ON m.term IS NOT DISTINCT FROM t.term AND m.r = 1
LEFT JOIN q ON q.term IS NOT DISTINCT FROM t.term
GROUP BY t.term
"""


def p5_found(spark: SparkSession, sf: str) -> DataFrame:
    return hierarchy.hierarchy(table(spark, sf, "descendant_node")).select("node_id", "root_id", "depth")


P5_SQL = """
WITH RECURSIVE e AS (
  SELECT n.node_id, n.tree_id, p.node_id AS up FROM descendant_node n LEFT JOIN descendant_node p ON p.node_id = n.parent_id AND p.tree_id = n.tree_id),
w AS (
  SELECT node_id, tree_id, node_id AS root_id, 0 AS depth FROM e WHERE up IS NULL
  UNION ALL
  SELECT e.node_id, e.tree_id, w.root_id, w.depth + 1 FROM e JOIN w ON e.up = w.node_id AND e.tree_id = w.tree_id)
SELECT e.node_id, coalesce(w.root_id, -1) AS root_id, coalesce(w.depth, -1) AS depth FROM e LEFT JOIN w USING (node_id, tree_id)
"""


def p5_paths(spark: SparkSession, sf: str) -> DataFrame:
    """Every node with its path of ids from the root."""
    return hierarchy.hierarchy(table(spark, sf, "descendant_node"), paths=True)


P5_PATHS_SQL = P5_SQL.replace("0 AS depth FROM e", "0 AS depth, CAST(node_id AS VARCHAR) AS path FROM e").replace(
    "w.depth + 1 FROM e", "w.depth + 1, w.path || '/' || CAST(e.node_id AS VARCHAR) FROM e"
).replace("SELECT e.node_id, coalesce", "SELECT e.node_id, e.tree_id, w.path, coalesce")


def p5_descendant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes lie below each node."""
    return hierarchy.descendant_counts(table(spark, sf, "descendant_node"))


P5_COUNTS_SQL = P5_PATHS_SQL.split("SELECT e.node_id, e.tree_id, w.path")[0] + """
, u AS (SELECT tree_id, node_id, depth, unnest(string_split(path, '/')) AS a FROM w)
SELECT tree_id, CAST(a AS BIGINT) AS node_id, count(*) - 1 AS descendants FROM u GROUP BY ALL
"""


def p5_all_descendant_counts(spark: SparkSession, sf: str) -> DataFrame:
    """How many nodes lie below each node, those on loops and below them included."""
    return hierarchy.descendant_counts(table(spark, sf, "descendant_node"), loops=True)


P5_ALL_COUNTS_SQL = """
WITH RECURSIVE e AS (
  SELECT n.tree_id, n.node_id, p.node_id AS up FROM descendant_node n JOIN descendant_node p ON p.node_id = n.parent_id AND p.tree_id = n.tree_id),
u AS (
  SELECT tree_id, node_id, up AS a FROM e
  UNION
  SELECT u.tree_id, u.node_id, e.up FROM u JOIN e ON e.node_id = u.a AND e.tree_id = u.tree_id)
SELECT n.tree_id, n.node_id, count(u.a) AS descendants
FROM descendant_node n LEFT JOIN u ON u.a = n.node_id AND u.tree_id = n.tree_id AND u.node_id <> n.node_id GROUP BY ALL
"""


def _side(df: DataFrame, languages: DataFrame) -> DataFrame:
    root = compare.trimmed(F.regexp_replace("root", r"(?U)(\s*\([^()]*\))+\s*$", ""))
    rows = compare.latest(
        df.where(F.col("word").isNotNull()),
        F.regexp_replace("word", r"(?U)^\s+|\s+$", ""),
        {"resolved": F.col("resolved"), "bucket": compare.trimmed(F.col("bucket")), "root": root},
        F.col("checked_at"),
    )
    return compare.coded(rows, "root", languages, "wikt_code", "name")


def p7_found(spark: SparkSession, sf: str) -> DataFrame:
    languages = table(spark, sf, "languages")
    old, new = (_side(table(spark, sf, f"compare_{s}"), languages) for s in ("old", "new"))
    return compare.differences(old, new, ["resolved", "bucket", "root"]).select(F.col("key").alias("word"), "diff")


_P7_SIDE = r"""
  SELECT w, arg_max(struct_pack(r := resolved, b := b, t := coalesce(l.name, t)), struct_pack(c := coalesce(epoch_us(checked_at), -9223372036854775807), t := coalesce(t, ''))) AS s
  FROM (SELECT regexp_replace(word, '^\s+|\s+$', '', 'g') AS w, resolved, nullif(regexp_replace(bucket, '^\s+|\s+$', '', 'g'), '') AS b,
          nullif(regexp_replace(regexp_replace(root, '(\s*\([^()]*\))+\s*$', ''), '^\s+|\s+$', '', 'g'), '') AS t, checked_at
        FROM {0} WHERE word IS NOT NULL) x LEFT JOIN languages l ON l.wikt_code = x.t GROUP BY w"""
P7_SQL = f"""
WITH o AS ({_P7_SIDE.format('compare_old')}), n AS ({_P7_SIDE.format('compare_new')}),
j AS (SELECT coalesce(o.w, n.w) AS word, o.s AS a, n.s AS b, o.w IS NULL AS no_old, n.w IS NULL AS no_new FROM o FULL JOIN n ON o.w = n.w)
SELECT word, 'only_new' AS diff FROM j WHERE no_old
UNION ALL SELECT word, 'only_old' FROM j WHERE no_new
UNION ALL SELECT word, 'resolved' FROM j WHERE NOT no_old AND NOT no_new AND a.r IS DISTINCT FROM b.r
UNION ALL SELECT word, 'bucket' FROM j WHERE NOT no_old AND NOT no_new AND a.b IS DISTINCT FROM b.b
UNION ALL SELECT word, 'root' FROM j WHERE NOT no_old AND NOT no_new AND a.t IS DISTINCT FROM b.t
"""

QUERIES = {f.__name__: f for f in (p1_found, p1_nodes, p1_trees, p3_term_stats, p5_found, p5_paths, p5_descendant_counts, p5_all_descendant_counts, p7_found)}
SQL = {"p3_term_stats": P3_SQL, "p5_found": P5_SQL, "p5_paths": P5_PATHS_SQL, "p5_descendant_counts": P5_COUNTS_SQL, "p5_all_descendant_counts": P5_ALL_COUNTS_SQL, "p7_found": P7_SQL}

_KIDS = "CASE WHEN json_exists(n, '$.children') THEN n->'$.children' ELSE n->'$.branches' END"
P1_SQL = f"""
WITH RECURSIVE u AS (
  SELECT word_id, CAST(tree_json AS VARCHAR) AS j FROM word WHERE json_valid(tree_json)
  UNION ALL SELECT word_id, json_extract_string(j, '$') FROM u WHERE json_type(j) = 'VARCHAR' AND json_valid(json_extract_string(j, '$'))),
t AS (
  SELECT word_id, 1 AS tree_no, CAST(j AS JSON) AS j FROM u WHERE json_type(j) = 'OBJECT'
  UNION ALL SELECT word_id, generate_subscripts(l, 1), unnest(l) FROM (SELECT word_id, json_extract(j, '$[*]') AS l FROM u WHERE json_type(j) = 'ARRAY')),
h AS (SELECT word_id, tree_no, CASE WHEN json_exists(j, '$.head') THEN j->'$.head' ELSE j END AS n FROM t WHERE json_type(j) = 'OBJECT' AND json_keys(j) <> []),
w AS (
  SELECT word_id, tree_no, n, '0' AS node_path, '' AS parent_path FROM h WHERE json_type(n) = 'OBJECT'
  UNION ALL
  SELECT word_id, tree_no, c, node_path || '.' || i, node_path FROM (
    SELECT word_id, tree_no, node_path, unnest(l) AS c, generate_subscripts(l, 1) - 1 AS i FROM (
      SELECT word_id, tree_no, node_path, CASE json_type({_KIDS}) WHEN 'ARRAY' THEN json_extract({_KIDS}, '$[*]') WHEN 'OBJECT' THEN [{_KIDS}] ELSE [] END AS l FROM w))
  WHERE json_type(c) = 'OBJECT')
SELECT word_id, CAST(tree_no AS BIGINT) AS tree_no, node_path, parent_path FROM w
"""
SQL["p1_found"] = P1_SQL
_NODES = P1_SQL.split("SELECT word_id, CAST(tree_no")[0]
_TEXT = ", ".join(f"n->>'$.{f}' AS {f}" for f in ("lang", "term", "certainty", "is_root", "is_affix"))
NODES_CTE = _NODES + f", x AS (SELECT word_id, CAST(tree_no AS BIGINT) AS tree_no, node_path, parent_path, coalesce(n->>'$.rel', n->>'$.reltype') AS rel, {_TEXT} FROM w)"
SQL["p1_nodes"] = NODES_CTE + " SELECT * FROM x"
SQL["p1_trees"] = NODES_CTE + """ SELECT word_id, tree_no, count(*) AS nodes, max(len(string_split(node_path, '.'))) AS levels,
  max(lang) FILTER (WHERE parent_path = '') AS head_lang, max(term) FILTER (WHERE parent_path = '') AS head_term FROM x GROUP BY word_id, tree_no"""
