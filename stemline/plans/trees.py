"""Queries on stored trees and descendant forests, with the SQL each is compared with where SQL can tell it."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession

from stemline.functions import classify, text
from stemline.operators import compare, forest, lineage, nested, shares
from stemline.plans import text_sql
from stemline.plans.problems import _P7_SIDE, NODE_FIELDS, NODES_CTE, P5_PATHS_SQL
from stemline.session import cut, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def nodes(spark: SparkSession, sf: str) -> DataFrame:
    n = nested.flatten_json_trees(table(spark, sf, "word"), fields=NODE_FIELDS)
    return n.withColumn("rel", F.coalesce("rel", "reltype")).drop("reltype")


def _with_lines(spark: SparkSession, sf: str) -> tuple[DataFrame, ...]:
    """Nodes, main lines with the groups of their languages, primary trees, answering forms, and lines through components."""
    n = cut(nodes(spark, sf))
    s = cut(lineage.spines(classify.with_bucket(n, "lang", table(spark, sf, "languages"))))
    prime = cut(lineage.primary(s))
    forms = _answering_forms(spark, sf)
    return n, s, prime, forms, lineage.lineages(prime, lineage.components(n, prime, forms))


_IDS = "word_id, tree_no"
#: Main lines: how far direct links lead below each node, then from the head always the child with most below it.
_SPINES = NODES_CTE + f""",
n AS (SELECT *, coalesce(certainty, 'direct') = 'direct' AS d, CAST(string_split(node_path, '.')[-1] AS INT) AS place FROM x),
up AS (SELECT {_IDS}, node_path AS y, parent_path AS a, 1 AS len FROM n WHERE d AND parent_path <> ''
  UNION ALL SELECT u.word_id, u.tree_no, u.y, n.parent_path, len + 1 FROM up u JOIN n ON n.word_id = u.word_id AND n.tree_no = u.tree_no AND n.node_path = u.a WHERE n.d AND n.parent_path <> ''),
ht AS (SELECT {_IDS}, a AS node_path, max(len) AS h FROM up GROUP BY ALL),
best AS (SELECT * FROM (SELECT n.*, row_number() OVER (PARTITION BY n.word_id, n.tree_no, n.parent_path ORDER BY coalesce(h, 0) DESC, place) AS r FROM n LEFT JOIN ht USING ({_IDS}, node_path) WHERE d AND parent_path <> '') WHERE r = 1),
sp AS (SELECT {_IDS}, node_path, lang, term, rel, 0 AS pos FROM n WHERE parent_path = ''
  UNION ALL SELECT b.word_id, b.tree_no, b.node_path, b.lang, b.term, b.rel, pos + 1 FROM sp JOIN best b ON b.word_id = sp.word_id AND b.tree_no = sp.tree_no AND b.parent_path = sp.node_path),
k AS (SELECT {_IDS}, CAST(count(*) AS INT) AS nodes, CAST(1 + (SELECT count(*) FROM up WHERE up.word_id = n.word_id AND up.tree_no = n.tree_no AND a = '0') AS INT) AS direct_nodes FROM n GROUP BY ALL)"""
_STAGE = "regexp_full_match(coalesce({0}, ''), '((Northern|Southern|Eastern|Western|Midland|Anglian|Northumbrian|Mercian|Kentish|West Saxon|Early|Late) )?((Middle|Old) )?English')"
_PROTO = "(coalesce({0}, '') LIKE 'Proto-%' OR {0} = 'PIE')"
#: The tree that answers for a word: the first, unless that is borrowed by way of a reconstruction and another has an attested donor.
_PRIMARY = _SPINES + f""",
dn AS (SELECT {_IDS}, list(lang ORDER BY pos) FILTER (WHERE pos > 0 AND NOT {_STAGE.format('lang')} AND coalesce(rel, '') <> 'root') AS ds, count(*) AS steps FROM sp GROUP BY ALL),
dq AS (SELECT *, coalesce(len(ds), 0) AS c, {_PROTO.format('ds[1]')} AS p, list_bool_and([{_PROTO.format('y')} FOR y IN coalesce(ds, [])]) AS ap FROM dn),
pr AS (SELECT f.word_id, CASE WHEN f.c > 0 AND f.p AND NOT f.ap AND a.t IS NOT NULL THEN a.t ELSE f.tree_no END AS tree_no
  FROM (SELECT * FROM dq WHERE tree_no = (SELECT min(tree_no) FROM dq e WHERE e.word_id = dq.word_id)) f LEFT JOIN (SELECT word_id, min(tree_no) AS t FROM dq WHERE c > 0 AND NOT p GROUP BY 1) a USING (word_id))"""


@query(_SPINES + f" SELECT {_IDS}, nodes, direct_nodes, CAST(pos AS INT) AS pos, lang, term, rel FROM sp JOIN k USING ({_IDS})")
def word_spines(spark, sf):
    """The main line of every stored tree, one row a step."""
    s = lineage.spines(nodes(spark, sf))
    return s.select("word_id", "tree_no", "nodes", "direct_nodes", F.explode("spine").alias("s")).select("word_id", "tree_no", "nodes", "direct_nodes", "s.pos", "s.lang", "s.term", "s.rel")


_STATES = "st AS (SELECT w.word_id, CASE WHEN max(direct_nodes) > 1 THEN 'resolved' WHEN max(direct_nodes) IS NOT NULL THEN 'stub' ELSE 'none' END AS status FROM word w LEFT JOIN k USING (word_id) GROUP BY w.word_id)"


@query(_SPINES + f", {_STATES} SELECT * FROM st")
def word_status(spark, sf):
    return lineage.statuses(table(spark, sf, "word"), lineage.spines(nodes(spark, sf)))


@query(_PRIMARY + f" SELECT word_id, tree_no, CAST(steps AS INT) AS steps FROM pr JOIN dn USING ({_IDS})")
def word_primary_tree(spark, sf):
    p = lineage.primary(lineage.spines(nodes(spark, sf)))
    return p.select("word_id", "tree_no", F.size("spine").alias("steps"))


def _answering_forms(spark: SparkSession, sf: str) -> DataFrame:
    """``form, word_id``: the word that answers for each form."""
    words = table(spark, sf, "word").where("key_lower IS NOT NULL")
    return shares.surface_forms(words).groupBy("form").agg(F.min_by("word_id", F.struct("rank", "word_id")).alias("word_id"))


_FORMS_CTE = """sf AS (SELECT form, arg_min(word_id, rank * 1000000000000 + word_id) AS word_id FROM (
  SELECT headword AS form, word_id, CASE WHEN headword <> key_lower THEN 5 ELSE 10 END AS rank FROM word WHERE key_lower IS NOT NULL AND headword IS NOT NULL
  UNION ALL SELECT key_lower, word_id, 50 FROM word WHERE headword <> key_lower) GROUP BY form)"""
_BOUND = "(coalesce(is_affix IN ('true', '1'), false) OR coalesce(length(trim(term)) > 1 AND (trim(term) LIKE '-%' OR trim(term) LIKE '%-'), false))"


def _buckets_cte(source: str) -> str:
    """The group of each language name of ``source``: of the name or of the longest end of it that the list knows."""
    return f"""bk AS (SELECT k.lang, coalesce(arg_min(l.bucket, i), 'Other') AS bucket FROM (SELECT lang, generate_subscripts(w, 1) AS i, array_to_string(w[generate_subscripts(w, 1):], ' ') AS n FROM (SELECT DISTINCT lang, string_split(lang, ' ') AS w FROM {source} WHERE lang IS NOT NULL)) k
  LEFT JOIN (SELECT name, min(bucket) AS bucket FROM languages WHERE bucket IS NOT NULL GROUP BY 1) l ON l.name = n GROUP BY 1)"""


def _lines_sql(depth: int = lineage.DEPTH) -> str:
    """Lines through components: the ways from words without a donor, level by level, and back with the best line behind each."""
    out = f""", {_FORMS_CTE},
own AS (SELECT word_id, list(struct_pack(lang := lang, term := term, rel := rel) ORDER BY pos) AS spine, coalesce(bool_or(NOT {_STAGE.format('lang')} AND rel IN ('inherited', 'borrowed', 'derived', 'formed_from')), false) AS donor FROM pr JOIN sp USING ({_IDS}) GROUP BY 1),
pa AS (SELECT n.word_id, place, term, {_BOUND} AS b FROM n JOIN pr USING ({_IDS}) WHERE parent_path = '0' AND rel = 'formed_from' AND term IS NOT NULL),
pt AS (SELECT pa.word_id, sf.word_id AS part_id, min(place) AS place FROM pa JOIN sf ON sf.form = pa.term WHERE (NOT b OR b = (SELECT bool_and(q.b) FROM pa q WHERE q.word_id = pa.word_id)) AND sf.word_id <> pa.word_id GROUP BY ALL),
w0 AS (SELECT [word_id] AS way, word_id AS cur, 0 AS place, false AS closed FROM own WHERE NOT donor)"""
    for k in range(1, depth):
        out += f""",
w{k} AS (SELECT list_append(way, part_id) AS way, part_id AS cur, pt.place, o.donor AS closed FROM w{k - 1} w JOIN pt ON pt.word_id = w.cur JOIN own o ON o.word_id = part_id WHERE NOT closed AND NOT list_contains(way, part_id))"""
    last = depth - 1
    out += f", l{last} AS (SELECT way, place, spine AS line FROM w{last} JOIN own ON own.word_id = cur)"
    for k in range(last - 1, -1, -1):
        out += f""",
b{k} AS (SELECT way[:-2] AS way, arg_max(line, struct_pack(f := len(list_filter(line, lambda s: NOT {_STAGE.format('s.lang')})), n := len(line), p := -place)) AS sub FROM l{k + 1} GROUP BY 1),
l{k} AS (SELECT way, place, CASE WHEN donor OR sub IS NULL THEN spine ELSE list_concat(spine[:1], sub) END AS line FROM w{k} w JOIN own ON own.word_id = cur LEFT JOIN b{k} USING (way))"""
    return out + ",\nli AS (SELECT word_id, spine AS line FROM own WHERE donor UNION ALL SELECT way[1], line FROM l0)"


_CORE = "(" + ", ".join(f"'{b}'" for b in classify.CORE) + ")"
_RESOLVED = _PRIMARY + _lines_sql() + f""", {_STATES}, {_buckets_cte('n')},
f AS (SELECT word_id, list(struct_pack(lang := s.lang, bucket := coalesce(bk.bucket, 'Other')) ORDER BY i) AS f FROM (SELECT word_id, unnest(line[2:]) AS s, generate_subscripts(line[2:], 1) AS i FROM li) LEFT JOIN bk ON bk.lang = s.lang
  WHERE s.rel IN ('inherited', 'borrowed', 'derived', 'formed_from') AND NOT {_STAGE.format('s.lang')} GROUP BY 1),
ct AS (SELECT n.word_id, arg_min(struct_pack(lang := n.lang, bucket := bk.bucket), place) AS c FROM n JOIN pr USING ({_IDS}) JOIN bk ON bk.lang = n.lang WHERE parent_path = '0' AND rel = 'root' GROUP BY 1),
pp AS (SELECT n.word_id, list(trim(term, '-') ORDER BY place) AS parts FROM n JOIN pr USING ({_IDS}) WHERE parent_path = '0' AND rel = 'formed_from' AND term <> '' AND NOT coalesce(is_affix IN ('true', '1'), false) AND trim(term, '-') = term GROUP BY 1 HAVING count(*) >= 2),
a0 AS (SELECT li.word_id, line, status = 'stub' AS stub, CASE WHEN f IS NULL AND status = 'stub' AND c IS NOT NULL THEN [c] ELSE coalesce(f, []) END AS f, parts FROM li JOIN st USING (word_id) LEFT JOIN f USING (word_id) LEFT JOIN ct USING (word_id) LEFT JOIN pp USING (word_id)),
a1 AS (SELECT *, CASE WHEN len(f) > 0 AND stub THEN 'root' WHEN len(f) > 0 THEN 'donor' WHEN len(list_filter(line[2:], lambda s: s.rel IN ('inherited', 'derived') AND {_STAGE.format('s.lang')})) > 0 THEN 'native' WHEN parts IS NOT NULL THEN 'parts' ELSE 'none' END AS kind,
  [s.bucket FOR s IN f] AS chain, [s FOR s IN f IF coalesce(s.lang, '') NOT IN ('Proto-Indo-European', 'PIE')] AS apart, coalesce(f[-1].lang, '') IN ('Proto-Indo-European', 'PIE') AS deep, [s.lang FOR s IN line IF {_STAGE.format('s.lang')}] AS stages FROM a0),
a2 AS (SELECT *, [b FOR b IN chain IF b <> 'PIE'] AS rest, [b FOR b IN chain IF b <> 'PIE'][2:-2] AS inside, kind IN ('donor', 'root') AS abroad, CASE kind WHEN 'native' THEN 'Germanic' WHEN 'parts' THEN 'Compound' ELSE 'Unknown' END AS flat, deep AND len(apart) > 0 AS pie FROM a1),
a3 AS (SELECT *, CASE WHEN abroad THEN CASE WHEN pie THEN apart[-1].lang ELSE f[-1].lang END END AS root_lang, CASE WHEN len(rest) = 0 THEN chain[-1] WHEN len(rest) <= 2 THEN rest[-1]
  ELSE coalesce([b FOR b IN inside IF b NOT IN {_CORE} AND b NOT IN ('Other', 'Unknown')][-1], [b FOR b IN inside IF b NOT IN ('Other', 'Unknown')][-1], inside[-1]) END AS inf FROM a2)"""


@query(_RESOLVED + """ SELECT word_id, kind, CASE WHEN kind = 'donor' THEN chain[1] WHEN abroad THEN 'Unknown' ELSE flat END AS direct, CASE WHEN kind = 'donor' THEN inf WHEN abroad THEN 'Unknown' ELSE flat END AS influence,
CASE WHEN abroad THEN chain[-1] ELSE flat END AS root, root_lang, CASE WHEN kind = 'native' THEN CASE WHEN len(stages) > 1 THEN stages[-1] ELSE 'English (native core)' END ELSE root_lang || CASE WHEN pie THEN ' (from PIE)' ELSE '' END END AS root_name,
array_to_string(parts, '|') AS parts FROM a3""")
def word_readings(spark, sf):
    """Every word in three readings, components followed into their own words."""
    n, s, prime, _, lines = _with_lines(spark, sf)
    return lineage.resolved(lines, n, prime, lineage.statuses(table(spark, sf, "word"), s), table(spark, sf, "languages")).withColumn("parts", F.array_join("parts", "|"))


_DRAWN = _PRIMARY + f""", {_FORMS_CTE},
gr AS (SELECT DISTINCT {_IDS}, parent_path AS node_path, true AS g FROM n WHERE parent_path <> '' AND coalesce(rel, '') <> 'root'),
m AS (SELECT n.word_id, n.tree_no, node_path, parent_path, lang, term, rel, {_BOUND} AS affix, CASE WHEN rel = 'formed_from' AND term <> '' AND g IS NULL THEN term END AS seek, [CAST(q AS BIGINT) FOR q IN string_split(node_path, '.')[2:]] AS pl FROM n LEFT JOIN gr USING ({_IDS}, node_path)),
hd AS (SELECT word_id, min(lower(term)) AS head FROM m JOIN pr USING ({_IDS}) WHERE parent_path = '' GROUP BY 1),
ins AS (SELECT m.* FROM m JOIN pr USING ({_IDS}) WHERE parent_path <> ''),
g AS (SELECT m.word_id, list_prepend(m.tree_no, pl) AS path, lang, term, rel, affix, seek, [coalesce(head, '')] AS seen, 0 AS opened FROM m JOIN hd USING (word_id) WHERE parent_path <> ''
  UNION ALL SELECT g.word_id, list_concat(list_append(g.path, ins.pl[1] - 1099511627776), ins.pl[2:]), ins.lang, ins.term, ins.rel, ins.affix, ins.seek, list_append(g.seen, lower(g.seek)), opened + 1
  FROM g JOIN sf ON sf.form = g.seek JOIN ins ON ins.word_id = sf.word_id WHERE NOT list_contains(g.seen, lower(g.seek)) AND opened < 4),
gb AS (SELECT *, path[:2] AS branch FROM g),
gf AS (SELECT word_id, lang, term, min(branch) AS first FROM gb GROUP BY ALL), gs AS (SELECT word_id, branch, count(*) AS size FROM gb GROUP BY ALL),
dr AS (SELECT gb.* FROM gb JOIN gs USING (word_id, branch) JOIN gf ON gf.word_id = gb.word_id AND gf.lang IS NOT DISTINCT FROM gb.lang AND gf.term IS NOT DISTINCT FROM gb.term WHERE NOT (size = 1 AND first < gb.branch))"""


def _trees_drawn(spark: SparkSession, sf: str) -> DataFrame:
    n = cut(nodes(spark, sf))
    return lineage.trees_drawn(n, cut(lineage.primary(lineage.spines(n))), cut(_answering_forms(spark, sf)))


@query(_DRAWN + " SELECT word_id, array_to_string(path, '.') AS path, array_to_string(path[:-2], '.') AS parent, lang, term, rel, opened FROM dr")
def word_trees(spark, sf):
    """The tree of each word as it is drawn: all its etymologies, components opened into their own words."""
    join = lambda c: F.array_join(F.transform(c, lambda x: x.cast("string")), ".")
    return _trees_drawn(spark, sf).select("word_id", join("path").alias("path"), join("parent").alias("parent"), "lang", "term", "rel", "opened")


_FIXES = f"fx0 AS ({_P7_SIDE.format('compare_new')}), fx AS (SELECT lower(w) AS fw, min(s.b) AS fb FROM fx0 WHERE w <> '' AND s.b IS NOT NULL AND s.r GROUP BY 1)"


@query(_DRAWN + f""", {_buckets_cte('x')}, {_FIXES},
sb AS (SELECT word_id, bool_and(c = 1 AND thin) AS stub FROM (SELECT word_id, branch, count(*) AS c, bool_and(coalesce(rel = 'root', false) OR affix) AS thin FROM dr GROUP BY ALL) GROUP BY 1),
ow AS (SELECT form, arg_min(struct_pack(i := word_id, s := stub), struct_pack(s := stub, i := word_id)) AS o FROM sf JOIN sb USING (word_id) GROUP BY 1),
v AS (SELECT DISTINCT headword AS token FROM documents WHERE headword IS NOT NULL UNION SELECT headword || 's' FROM documents WHERE headword IS NOT NULL), {text_sql.STEMS},
al AS (SELECT word, arg_min(base, place) AS other FROM stems JOIN ow ON ow.form = base WHERE NOT o.s GROUP BY 1),
nm AS (SELECT word_id, lang AS b FROM dr WHERE lang IS NOT NULL UNION SELECT word_id, bucket FROM dr JOIN bk USING (lang))
SELECT v.token AS word, CASE WHEN NOT o.s THEN 'own' WHEN other IS NOT NULL THEN 'form' WHEN o IS NOT NULL THEN 'stub' ELSE 'none' END AS source, CASE WHEN NOT o.s THEN v.token WHEN other IS NOT NULL THEN other WHEN o IS NOT NULL THEN v.token ELSE '' END AS forms,
  coalesce(NOT o.s AND fb IS NOT NULL AND NOT EXISTS (SELECT 1 FROM nm WHERE nm.word_id = o.i AND nm.b = fb), false) AS fixed
FROM v LEFT JOIN ow ON ow.form = v.token LEFT JOIN al ON al.word = v.token LEFT JOIN fx ON fw = lower(v.token)""")
def word_tree_sources(spark, sf):
    """Whose tree answers for the headwords of the corpus and their plurals: their own, that of another form, or a stub; and which trees the latest checked answers overrule."""
    t = cut(_trees_drawn(spark, sf))
    own = _answering_forms(spark, sf).join(lineage.drawn_stubs(t), "word_id")
    d = table(spark, sf, "documents").where("headword IS NOT NULL")
    asked = d.select(F.col("headword").alias("word")).unionByName(d.select(F.concat("headword", F.lit("s")).alias("word")))
    fixes = compare.latest(table(spark, sf, "compare_new"), compare.trimmed(F.col("word")), {"bucket": compare.trimmed(F.col("bucket")), "resolved": F.col("resolved")}, F.col("checked_at")).where("resolved AND bucket IS NOT NULL")
    shown = classify.with_bucket(t.select("word_id", "lang").where("lang IS NOT NULL").distinct(), "lang", table(spark, sf, "languages"))
    splits = spark.createDataFrame([], "word string, parts array<string>")
    answers = lineage.tree_answers(asked, "word", own, text.stem_candidates(F.col("word")), splits, fixes.select(F.col("key").alias("word"), "bucket"), shown)
    return answers.withColumn("forms", F.array_join("forms", "+"))


@query(NODES_CTE + """ SELECT term, CAST(sum(CAST(coalesce(is_affix IN ('true', '1'), false) AS INT)) AS BIGINT) AS flagged, count(*) AS seen FROM x WHERE term IS NOT NULL GROUP BY term
HAVING count(*) >= 5 AND sum(CAST(coalesce(is_affix IN ('true', '1'), false) AS INT)) >= 0.95 * count(*)""")
def tree_affix_consensus(spark, sf):
    """Terms that are flagged as affixes nearly everywhere in the stored trees."""
    n = nodes(spark, sf)
    return shares.consensus(n, "term", F.coalesce(F.col("is_affix").isin("true", "1"), F.lit(False)))


@query(NODES_CTE + " SELECT word_id, tree_no, count(*) AS nodes, coalesce(array_to_string(list_sort(list_distinct(list(lang))), '|'), '') AS languages, count(DISTINCT term) AS terms FROM x GROUP BY ALL")
def tree_languages(spark, sf):
    """Languages and terms of each stored tree."""
    n = nodes(spark, sf)
    return n.groupBy("word_id", "tree_no").agg(F.count(F.lit(1)).alias("nodes"), F.array_join(F.sort_array(F.collect_set("lang")), "|").alias("languages"), F.countDistinct("term").alias("terms"))


@query("SELECT tree_id, t.node_count AS stored, count(n.node_id) AS counted FROM descendant_tree t LEFT JOIN descendant_node n USING (tree_id) GROUP BY ALL HAVING t.node_count IS DISTINCT FROM count(n.node_id)")
def stale_node_counts(spark, sf):
    n = table(spark, sf, "descendant_node").groupBy("tree_id").agg(F.count(F.lit(1)).alias("counted"))
    t = table(spark, sf, "descendant_tree").select("tree_id", F.col("node_count").alias("stored")).join(n, "tree_id", "left").withColumn("counted", F.coalesce("counted", F.lit(0)))
    return t.where(~F.col("stored").eqNullSafe(F.col("counted").cast("int")))


@query("""SELECT 'node without tree' AS fault, count(*) AS n FROM descendant_node n WHERE NOT EXISTS (SELECT 1 FROM descendant_tree t WHERE t.tree_id = n.tree_id)
UNION ALL SELECT 'tree without node', count(*) FROM descendant_tree t WHERE NOT EXISTS (SELECT 1 FROM descendant_node n WHERE t.tree_id = n.tree_id)
UNION ALL SELECT 'parent missing', count(*) FROM descendant_node n WHERE parent_id IS NOT NULL AND NOT EXISTS (SELECT 1 FROM descendant_node p WHERE p.node_id = n.parent_id AND p.tree_id = n.tree_id)
UNION ALL SELECT 'tree with several tops', count(*) FROM (SELECT tree_id FROM descendant_node GROUP BY tree_id HAVING count(*) FILTER (WHERE parent_id IS NULL) <> 1)
UNION ALL SELECT 'claim without word', count(*) FROM etymology e WHERE NOT EXISTS (SELECT 1 FROM word w WHERE w.word_id = e.word_id)""")
def validators(spark, sf):
    n, t = table(spark, sf, "descendant_node"), table(spark, sf, "descendant_tree")
    p = n.select(F.col("node_id").alias("parent_id"), "tree_id")
    count = lambda df, name: df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("fault"), "n")
    tops = n.groupBy("tree_id").agg(F.sum(F.when(F.col("parent_id").isNull(), 1).otherwise(0)).alias("k")).where("k <> 1")
    return (
        count(n.join(t, "tree_id", "left_anti"), "node without tree")
        .unionByName(count(t.join(n, "tree_id", "left_anti"), "tree without node"))
        .unionByName(count(n.where("parent_id IS NOT NULL").join(p, ["parent_id", "tree_id"], "left_anti"), "parent missing"))
        .unionByName(count(tops, "tree with several tops"))
        .unionByName(count(table(spark, sf, "etymology").join(table(spark, sf, "word"), "word_id", "left_anti"), "claim without word"))
    )


@query("""SELECT lang, term, tree_id, node_count, rank FROM (SELECT lang, term, tree_id, node_count, row_number() OVER (PARTITION BY lang, term ORDER BY node_count DESC NULLS LAST, tree_id) AS rank
FROM (SELECT DISTINCT n.lang, n.term, tree_id, node_count FROM descendant_node n JOIN descendant_tree t USING (tree_id) WHERE n.term IS NOT NULL AND n.lang IS NOT NULL)) WHERE rank <= 4""")
def trees_of_forms(spark, sf):
    return forest.trees_containing(table(spark, sf, "descendant_node"), table(spark, sf, "descendant_tree"))


_UP = """up AS (SELECT lang, term, arg_max(struct_pack(up_id := t, up_lang := tl, up_term := tt), struct_pack(n := coalesce(nc, -1), i := -t)) AS b FROM (
  SELECT DISTINCT n.lang, n.term, t.tree_id AS t, t.lang AS tl, t.term AS tt, t.node_count AS nc FROM descendant_node n JOIN descendant_tree t USING (tree_id)
  WHERE t.term <> n.term AND EXISTS (SELECT 1 FROM descendant_tree r WHERE r.lang = n.lang AND r.term = n.term)) GROUP BY ALL)"""


@query(f"WITH {_UP} SELECT lang, term, b.up_id AS up_id, b.up_lang AS up_lang, b.up_term AS up_term FROM up")
def parent_tree_of_roots(spark, sf):
    return forest.parent_trees(table(spark, sf, "descendant_node"), table(spark, sf, "descendant_tree"))


@query(f"""WITH RECURSIVE {_UP},
c AS (SELECT lang, term, arg_max(tree_id, struct_pack(n := coalesce(node_count, -1), i := -tree_id)) AS top_id, lang AS top_lang, term AS top_term, 0 AS steps, [lang || chr(1) || term] AS seen
  FROM descendant_tree WHERE lang IS NOT NULL AND term IS NOT NULL GROUP BY lang, term
  UNION ALL SELECT c.lang, c.term, b.up_id, b.up_lang, b.up_term, steps + 1, list_append(seen, b.up_lang || chr(1) || b.up_term) FROM c JOIN up ON up.lang = top_lang AND up.term = top_term
  WHERE steps < 6 AND NOT list_contains(seen, b.up_lang || chr(1) || b.up_term))
SELECT lang, term, max_by(top_id, steps) AS top_id, max_by(top_lang, steps) AS top_lang, max_by(top_term, steps) AS top_term, max(steps) AS steps FROM c GROUP BY lang, term""")
def climb_to_top(spark, sf):
    return forest.climb(table(spark, sf, "descendant_node"), table(spark, sf, "descendant_tree"))


_LABEL = "lpad(CAST(coalesce({0}ordinal, 0) AS VARCHAR), 6, '0') || '.' || lpad(CAST({0}node_id AS VARCHAR), 12, '0')"
_RANKED = """WITH RECURSIVE e AS (SELECT n.node_id, n.tree_id, n.ordinal, p.node_id AS up FROM descendant_node n LEFT JOIN descendant_node p ON p.node_id = n.parent_id AND p.tree_id = n.tree_id),
w AS (SELECT node_id, tree_id, 0 AS depth, {0} AS path FROM e WHERE up IS NULL
  UNION ALL SELECT e.node_id, e.tree_id, w.depth + 1, w.path || '/' || {1} FROM e JOIN w ON e.up = w.node_id AND e.tree_id = w.tree_id),
r AS (SELECT *, row_number() OVER (PARTITION BY tree_id ORDER BY depth, path) AS rank FROM w)""".format(_LABEL.format(""), _LABEL.format("e."))


@query(_RANKED + " SELECT tree_id, node_id, rank FROM r")
def breadth_first_rank(spark, sf):
    return forest.breadth_first(table(spark, sf, "descendant_node")).select("tree_id", "node_id", "rank")


@query(_RANKED + " SELECT tree_id, count(*) AS total, count(*) FILTER (WHERE rank <= 40) AS shown, count(*) > 40 AS truncated FROM r GROUP BY tree_id")
def pruned_trees(spark, sf):
    return forest.pruned(table(spark, sf, "descendant_node"), 40)


@query(P5_PATHS_SQL.split("SELECT e.node_id, e.tree_id, w.path")[0] + """, h AS (SELECT w.tree_id, w.node_id, w.path FROM w JOIN descendant_node n ON n.node_id = w.node_id AND n.tree_id = w.tree_id WHERE n.lang = 'English'),
u AS (SELECT tree_id, node_id AS hit, CAST(unnest(string_split(path, '/')) AS BIGINT) AS node_id FROM h)
SELECT tree_id, node_id, max(node_id = hit) AS match FROM u GROUP BY ALL""")
def marked_paths(spark, sf):
    return forest.on_path(table(spark, sf, "descendant_node"), F.col("lang") == "English")


def _spliced_sql(most: int = forest.CLIMB) -> str:
    """The forest spliced round by round: leaves that head another tree are continued there, each form once under a top."""
    out = _RANKED.split("r AS (SELECT")[0] + f"""bd AS (SELECT w.tree_id, w.node_id, w.depth, w.path, n.lang, n.term, NOT EXISTS (SELECT 1 FROM descendant_node k WHERE k.tree_id = w.tree_id AND k.parent_id = w.node_id) AS leaf FROM w JOIN descendant_node n USING (tree_id, node_id)),
rt AS (SELECT lang, term, arg_max(tree_id, struct_pack(c := coalesce(node_count, -1), i := -tree_id)) AS next FROM descendant_tree WHERE lang IS NOT NULL AND term IS NOT NULL GROUP BY ALL),
s0 AS (SELECT tree_id AS top, lang, term FROM descendant_tree), f0 AS (SELECT tree_id AS top, path, lang, term, depth + 1 AS depth, leaf FROM bd)"""
    for k in range(most):
        out += f""",
m{k} AS (SELECT top, lang, term, arg_min(struct_pack(p := path, d := depth, n := next), path) AS b FROM f{k} JOIN rt USING (lang, term) WHERE leaf AND depth < {most} AND NOT EXISTS (SELECT 1 FROM s{k} s WHERE s.top = f{k}.top AND s.lang = f{k}.lang AND s.term = f{k}.term) GROUP BY top, lang, term),
f{k + 1} AS (SELECT top, b.p || '/' || bd.path AS path, bd.lang, bd.term, bd.depth + 1 + b.d AS depth, bd.leaf FROM m{k} JOIN bd ON bd.tree_id = b.n), s{k + 1} AS (SELECT * FROM s{k} UNION ALL SELECT top, lang, term FROM m{k})"""
    rows = " UNION ALL ".join([f"SELECT top, depth, 0 AS x FROM f{k}" for k in range(most + 1)] + [f"SELECT top, NULL, 1 FROM m{k}" for k in range(most)])
    return out + f" SELECT top, count(depth) AS nodes, max(depth) AS deepest, CAST(sum(x) AS BIGINT) AS spliced FROM ({rows}) GROUP BY top"


@query(_spliced_sql())
def spliced_forest(spark, sf):
    """Every tree with its leaves continued by the trees they are roots of: its size and depth."""
    s = forest.splice(table(spark, sf, "descendant_node"), table(spark, sf, "descendant_tree"))
    return s.groupBy("top").agg(F.count(F.lit(1)).alias("nodes"), F.max("depth").alias("deepest"), F.sum(F.col("spliced").cast("long")).alias("spliced"))


@query()
def spelling_variants(spark, sf):
    return forest.variants(table(spark, sf, "descendant_node"))


@query(_RANKED.split(",\nr AS (SELECT")[0] + """,
q AS (SELECT w.*, n.lang, n.term, regexp_replace(path, '/[^/]*$', '') AS above, EXISTS (SELECT 1 FROM e WHERE e.tree_id = w.tree_id AND e.up = w.node_id) AS inner_ FROM w JOIN descendant_node n USING (tree_id, node_id)),
o AS (SELECT *, row_number() OVER (PARTITION BY tree_id, CASE WHEN depth > 0 THEN above END ORDER BY path) > 1 AS comma, concat_ws(', ', '"lang": ' || CAST(to_json(lang) AS VARCHAR), '"term": ' || CAST(to_json(term) AS VARCHAR), CASE WHEN inner_ THEN '"children": [' END) AS told FROM q),
p AS (SELECT tree_id, path AS k, CASE WHEN comma THEN ', {' ELSE '{' END || told AS s, 1 AS c FROM o UNION ALL SELECT tree_id, path || '/~', CASE WHEN inner_ THEN ']}' ELSE '}' END, 0 FROM o)
SELECT tree_id, CAST(sum(c) AS INT) AS nodes, '[' || string_agg(s, '' ORDER BY k) || ']' AS tree_json FROM p GROUP BY tree_id""")
def nested_trees(spark, sf):
    return forest.nested(table(spark, sf, "descendant_node"))


@query("""WITH e AS (SELECT DISTINCT term FROM descendant_node WHERE lang = 'English' AND term <> ''), w AS (SELECT DISTINCT trim(headword) AS word FROM word WHERE headword <> '')
SELECT word, coalesce(a.term, b.term) AS form FROM w LEFT JOIN e a ON a.term = word LEFT JOIN e b ON b.term = lower(word)""")
def covered_forms(spark, sf):
    return forest.covered_form(table(spark, sf, "word"), "headword", table(spark, sf, "descendant_node"))


@query("SELECT source, count(*) AS trees, CAST(sum(node_count) AS BIGINT) AS nodes, max(node_count) AS largest FROM descendant_tree GROUP BY source")
def descendant_sources(spark, sf):
    return table(spark, sf, "descendant_tree").groupBy("source").agg(F.count(F.lit(1)).alias("trees"), F.sum("node_count").alias("nodes"), F.max("node_count").alias("largest"))


@query("""SELECT t.lang, t.term, count(DISTINCT n.term) AS words, array_to_string(list_sort(list_distinct(list(n.term))), '|') AS list FROM descendant_node n JOIN descendant_tree t USING (tree_id)
WHERE n.lang = 'English' AND n.term IS NOT NULL GROUP BY ALL""")
def english_words_by_root(spark, sf):
    n = table(spark, sf, "descendant_node").where("lang = 'English' AND term IS NOT NULL").select("tree_id", F.col("term").alias("w"))
    t = table(spark, sf, "descendant_tree").select("tree_id", "lang", "term")
    d = n.join(t, "tree_id").select("lang", "term", "w").distinct()
    return d.groupBy("lang", "term").agg(F.count(F.lit(1)).alias("words"), F.array_join(F.sort_array(F.collect_list("w")), "|").alias("list"))


@query(NODES_CTE + """, i AS (SELECT DISTINCT word_id, tree_no, parent_path AS node_path, true AS inner FROM x WHERE parent_path <> '')
SELECT word_id, tree_no, bool_and(parent_path = '' OR (i.inner IS NULL AND (coalesce(is_root IN ('true', '1'), false) OR coalesce(is_affix IN ('true', '1'), false)
  OR coalesce(length(trim(term)) > 1 AND (trim(term) LIKE '-%' OR trim(term) LIKE '%-'), false)))) AS stub FROM x LEFT JOIN i USING (word_id, tree_no, node_path) GROUP BY ALL""".replace("inner", "has_kids"))
def stub_trees(spark, sf):
    return lineage.stubs(nodes(spark, sf))


@query("SELECT CAST(0 AS BIGINT) AS strays")
def line_strays(spark, sf):
    """How many languages of lines through components and of the roots read from them the word's own drawn tree lacks: none are expected."""
    n, s, prime, forms, lines = _with_lines(spark, sf)
    lines = cut(lines)
    read = lineage.resolved(lines, n, prime, lineage.statuses(table(spark, sf, "word"), s), table(spark, sf, "languages")).select("word_id", "root_lang")
    return lineage.strays(lines, lineage.drawn(lineage.trees_drawn(n, prime, forms), n), read).agg(F.count(F.lit(1)).alias("strays"))


@query()
def family_of_commonest_word(spark, sf):
    """The family of the English form that most trees hold."""
    n = table(spark, sf, "descendant_node")
    best = n.where("lang = 'English' AND term IS NOT NULL").groupBy("term").agg(F.countDistinct("tree_id").alias("k")).orderBy(F.col("k").desc(), "term").first()
    return forest.family(n, table(spark, sf, "descendant_tree"), "English", best["term"] if best else "")
