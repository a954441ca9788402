"""Queries of the build side: templates and relation rows to trees and chains, notes, cards, layouts, and the streamed shares."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, SparkSession

from stemline.functions import classify, text
from stemline.operators import forest, lineage, nested, notes, relations, shapes, shares
from stemline.operators.hierarchy import hierarchy
from stemline.plans.problems import NODES_CTE
from stemline.plans.trees import _PRIMARY, _STAGE
from stemline.plans.trees import nodes as stored_nodes
from stemline.plans.words import _LEX, TOKENS, lexicon_known
from stemline.session import cut, shared_dir, table
from stemline.streaming import shares as streamed

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def _templates(spark: SparkSession, sf: str) -> DataFrame:
    """Stored main lines written as the templates that a dictionary would state them with, languages by name: ``word, num, templates, text``."""
    names = {"inherited": "inh", "borrowed": "bor", "derived": "der", "calque": "cal", "root": "root", "formed_from": "af"}

    def template(step: Column) -> Column:
        term = F.coalesce(step["term"], F.lit("-"))
        keyed = lambda *values: F.map_from_arrays(F.array(*[F.lit(str(k + 1)) for k in range(len(values))]), F.array(*values))
        # a part's own language comes first, a donor's behind that of the word
        args = F.when(step["rel"] == "formed_from", keyed(F.coalesce(step["lang"], F.lit("en")), term)).otherwise(keyed(F.lit("en"), step["lang"], term))
        return F.struct(classify.lookup(names, step["rel"], "der").alias("name"), args.alias("args"))

    s = lineage.spines(stored_nodes(spark, sf)).where(F.size("spine") > 1)
    w = table(spark, sf, "word").select("word_id", F.coalesce("headword", F.lit("")).alias("word"))
    templates = F.transform(F.slice("spine", F.lit(2), F.size("spine")), template)
    return s.join(w, "word_id").select("word", F.col("tree_no").cast("int").alias("num"), templates.alias("templates"), F.lit(None).cast("string").alias("text"))


@query()
def template_trees(spark, sf):
    """Every stored main line through templates and back to node rows."""
    return shapes.assembled(_templates(spark, sf), table(spark, sf, "languages"))


@query("SELECT fault, CAST(0 AS BIGINT) AS n FROM (VALUES ('heads'), ('floating')) v(fault)")
def template_tree_faults(spark, sf):
    """Trees built from templates with no or several heads, and nodes without their parent: none are expected."""
    return shapes.node_faults(cut(template_trees(spark, sf)))


def _relation_rows(spark: SparkSession, sf: str) -> DataFrame:
    n = table(spark, sf, "descendant_node")
    up = n.select(F.col("node_id").alias("parent_id"), "tree_id", F.col("lang").alias("related_lang"), F.col("term").alias("related_term"))
    rel = F.when(F.col("related_lang") == F.col("lang"), "derived_from").when(classify.is_proto(F.col("related_lang")), "inherited_from").otherwise("borrowed_from")
    j = n.select("node_id", "tree_id", "parent_id", "lang", "term").join(up, ["parent_id", "tree_id"])
    return j.where("term IS NOT NULL").select(
        F.col("node_id").cast("string").alias("term_id"), "term", rel.alias("reltype"), "related_lang", "related_term", F.col("node_id").alias("pos"), F.lit(None).cast("string").alias("group_tag"), F.lit(None).cast("string").alias("parent_tag")
    )


def _looped_lines(nodes: DataFrame) -> DataFrame:
    """``node_id, line`` of nodes that no root reaches, on a loop or below one: followed until an ancestor comes again. A tree's part of them is one task's."""
    step = pa.struct([("i", pa.int64()), ("l", pa.string()), ("t", pa.string())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for tree in batch.column(0).to_pylist():
                at = {x["node_id"]: x for x in tree}
                lines = []
                for x in tree:
                    line, seen, up = [x["s"]], set(), x["up"]
                    while up in at and up not in seen:
                        seen.add(up)
                        line.append(at[up]["s"])
                        up = at[up]["up"]
                    lines.append(line)
                yield pa.RecordBatch.from_arrays([pa.array([x["node_id"] for x in tree], pa.int64()), pa.array(lines, pa.list_(step))], ["node_id", "line"])

    return nodes.groupBy("tree_id").agg(F.collect_list(F.struct("node_id", "up", "s")).alias("nodes")).select("nodes").mapInArrow(run, "node_id long, line array<struct<i:long,l:string,t:string>>")


def _ancestor_rows(spark: SparkSession, sf: str) -> DataFrame:
    """The whole line above each node as groups within groups: one row an ancestor, which opens a group and lies in the group of the one before.

    Nodes without a language are markers: they state nothing, but their group goes on.
    """
    n = table(spark, sf, "descendant_node").where("node_id IS NOT NULL")
    # JSON in which the separator of paths is escaped
    label = F.replace(F.to_json(F.struct(F.col("node_id").alias("i"), F.col("lang").alias("l"), F.col("term").alias("t"))), F.lit("/"), F.lit(r"\u002f"))
    h = cut(hierarchy(n, paths=True, label=label))
    ups = F.reverse(F.split("path", "/"))
    own = h.where("depth > 0").select("node_id", F.transform(ups, lambda x: F.from_json(x, "i long, l string, t string")).alias("line"))
    lost = h.where("depth < 0").select("node_id", "tree_id")
    e = n.join(lost, (n.node_id == lost.node_id) & n.tree_id.eqNullSafe(lost.tree_id), "left_semi").groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("up"), F.min(F.struct(F.col("node_id").alias("i"), F.col("lang").alias("l"), F.col("term").alias("t"))).alias("s"))
    own = own.unionByName(_looped_lines(e))
    at = own.where(F.get("line", F.lit(0))["t"].isNotNull()).select("node_id", "line", F.posexplode(F.slice("line", F.lit(2), F.size("line") - 1)).alias("i", "a"))
    below = F.get("line", F.col("i"))
    lang = F.col("a.l")
    rel = F.when(lang.isNull(), "group_related_root").when(lang == below["l"], "derived_from").when(classify.is_proto(lang), "inherited_from").otherwise("borrowed_from")
    return at.select(
        F.col("node_id").cast("string").alias("term_id"), F.get("line", F.lit(0))["t"].alias("term"), rel.alias("reltype"), lang.alias("related_lang"), F.col("a.t").alias("related_term"), F.col("i").alias("pos"),
        F.col("a.i").cast("string").alias("group_tag"), F.when(F.col("i") > 0, below["i"].cast("string")).alias("parent_tag"),
    )


@query()
def relation_chains(spark, sf):
    """The chain record of each node from its whole line of ancestors."""
    r = relations.records(_ancestor_rows(spark, sf), table(spark, sf, "languages"))
    c = F.col("record")
    return r.select("term_id", "term", c["p"].alias("p"), c["d"].alias("d"), F.array_join(c["chain"], ">").alias("chain"), c["prox_kind"].alias("prox_kind"), c["root_lang"].alias("root_lang"))


@query("""WITH p AS (SELECT n.node_id, p.lang AS lang, p.term AS term FROM descendant_node n JOIN descendant_node p ON p.node_id = n.parent_id AND p.tree_id = n.tree_id WHERE n.term IS NOT NULL)
SELECT CAST(node_id AS VARCHAR) AS term_id, lang, term AS related FROM p WHERE lang IS NOT NULL""")
def relation_rows(spark, sf):
    return relations.expanded(_relation_rows(spark, sf)).select("term_id", "lang", "related")


_NOTES = _PRIMARY + f""",
hn AS (SELECT n.* FROM n JOIN pr USING (word_id, tree_no) WHERE parent_path = '0'),
cq AS (SELECT word_id, 'a word-for-word translation of ' || arg_min(concat_ws(' ', lang, term), place) AS note FROM hn WHERE rel = 'calque' AND lang IS NOT NULL GROUP BY 1),
fm AS (SELECT word_id, 'built from ' || string_agg(term, ' + ' ORDER BY place) AS note FROM hn WHERE rel = 'formed_from' AND term IS NOT NULL GROUP BY 1 HAVING count(*) >= 2),
fd AS (SELECT word_id, arg_min(lang, pos) AS donor FROM sp JOIN pr USING (word_id, tree_no) WHERE pos > 0 AND lang IS NOT NULL AND NOT {_STAGE.format('lang')} AND coalesce(rel, '') <> 'root' GROUP BY 1),
er AS (SELECT word_id, 'English took this from ' || donor || ', spoken ' || label AS note FROM fd JOIN (SELECT name, min(era_label) AS label FROM languages WHERE era_certain = 1 AND era_label IS NOT NULL GROUP BY 1) l ON l.name = donor),
al AS (SELECT word_id, 1 AS o, 'calque' AS kind, note FROM cq UNION ALL SELECT word_id, 2, 'formation', note FROM fm UNION ALL SELECT word_id, 3, 'era', note FROM er),
nt AS (SELECT word_id, CAST(row_number() OVER (PARTITION BY word_id ORDER BY o) - 1 AS INT) AS place, kind, note AS text FROM al)"""


@query(_NOTES + " SELECT * FROM nt")
def word_notes(spark, sf):
    """Side notes of each word, one row a note."""
    n = cut(stored_nodes(spark, sf))
    prime = cut(lineage.primary(lineage.spines(n)))
    lines = prime.select("word_id", F.col("spine").alias("line"))
    return notes.note_columns(n, prime, lines, table(spark, sf, "languages")).select("word_id", F.posexplode("notes").alias("place", "s")).select("word_id", "place", "s.kind", "s.text")


@query("""WITH k AS (SELECT term AS k, min(lang) AS v FROM descendant_tree WHERE term IS NOT NULL GROUP BY 1),
f AS (SELECT lower(regexp_replace(k, '-+$', '')) AS f, min(v) AS v2 FROM k GROUP BY 1 HAVING count(*) = 1),
a AS (SELECT DISTINCT raw_term AS term, trim(regexp_replace(trim(raw_term), '^\\*+', '')) AS a FROM descendant_node WHERE raw_term IS NOT NULL)
SELECT term, coalesce(v, v2) AS value FROM a LEFT JOIN k ON k = a LEFT JOIN f ON f = lower(regexp_replace(a, '-+$', ''))""")
def root_form_lookup(spark, sf):
    return notes.root_glosses(table(spark, sf, "descendant_node"), "raw_term", table(spark, sf, "descendant_tree"), "term", "lang")


@query("""WITH k AS (SELECT headword AS k, min(word_id) AS v FROM word WHERE headword IS NOT NULL GROUP BY 1), a AS (SELECT DISTINCT trim(headword) AS word FROM documents WHERE headword <> '')
SELECT word, coalesce(l.v, t.v) AS value FROM a LEFT JOIN k l ON l.k = lower(word) LEFT JOIN k t ON t.k = word""")
def lower_then_typed_lookup(spark, sf):
    return notes.lower_then_typed(table(spark, sf, "documents"), "headword", table(spark, sf, "word").where("headword IS NOT NULL"), "headword", "word_id")


_HINTS = "(VALUES " + ",".join(f"('{n}', {d})" for n, d in classify.DEPTH_HINT.items()) + ") hi(nm, d)"
_DIAGRAM = NODES_CTE + f""",
a AS (SELECT word_id, tree_no, node_path, parent_path, lang, term, rel, len(string_split(node_path, '.')) - 1 AS level, CAST(string_split(node_path, '.')[-1] AS BIGINT) AS place, CAST(string_split(node_path, '.')[2] AS BIGINT) AS branch FROM x WHERE parent_path <> ''),
b AS (SELECT *, min(place) OVER p = place AS eldest, count(*) OVER p AS kids FROM a WINDOW p AS (PARTITION BY word_id, tree_no, parent_path)),
-- down first children, taking in a lone root citation of the node's own language
c AS (SELECT word_id, tree_no, branch, node_path, level, lang, term FROM b WHERE level = 1
  UNION ALL SELECT b.word_id, b.tree_no, b.branch, b.node_path, b.level, b.lang, b.term FROM c
    LEFT JOIN b m ON m.word_id = c.word_id AND m.tree_no = c.tree_no AND m.parent_path = c.node_path AND m.kids = 1 AND m.rel = 'root' AND m.lang = c.lang
    JOIN b ON b.word_id = c.word_id AND b.tree_no = c.tree_no AND b.eldest AND b.parent_path = coalesce(m.node_path, c.node_path)),
e AS (SELECT c.word_id, c.tree_no, CAST(dense_rank() OVER (PARTITION BY c.word_id, c.tree_no ORDER BY c.branch) - 1 AS INT) AS col, CAST(dense_rank() OVER (PARTITION BY c.word_id, c.tree_no ORDER BY coalesce(d, 10)) - 1 AS INT) AS row, c.level, c.lang, c.term, m.term AS term2 FROM c
  LEFT JOIN b m ON m.word_id = c.word_id AND m.tree_no = c.tree_no AND m.parent_path = c.node_path AND m.kids = 1 AND m.rel = 'root' AND m.lang = c.lang LEFT JOIN {_HINTS} ON nm = c.lang)"""


@query(_DIAGRAM + " SELECT word_id, tree_no, col, row, lang, term, term2 FROM e")
def diagram_layout(spark, sf):
    """Where the nodes of each stored tree stand in its diagram."""
    return notes.diagram(stored_nodes(spark, sf))[0]


@query(_DIAGRAM + " SELECT * FROM (SELECT word_id, tree_no, col, row, lead(row) OVER (PARTITION BY word_id, tree_no, col ORDER BY row, level) AS below FROM e) WHERE below IS NOT NULL")
def diagram_edges(spark, sf):
    return notes.diagram(stored_nodes(spark, sf))[1]


@query("""WITH p AS (SELECT n.lang, p.lang AS up FROM descendant_node n JOIN descendant_node p ON p.node_id = n.parent_id AND p.tree_id = n.tree_id WHERE n.term IS NOT NULL),
r AS (SELECT up, CASE WHEN up = lang THEN 'derived_from' WHEN up LIKE 'Proto-%' OR up = 'PIE' THEN 'inherited_from' ELSE 'borrowed_from' END AS kind FROM p)
SELECT kind, family, count(*) AS n FROM r LEFT JOIN (SELECT name, min(family) AS family FROM languages GROUP BY 1) l ON l.name = up GROUP BY ALL""")
def relation_kinds(spark, sf):
    """How many relation rows there are of each kind and each family of the related language; languages that are not listed count too."""
    r = _relation_rows(spark, sf).groupBy("reltype", "related_lang").agg(F.count(F.lit(1)).alias("n"))
    l = table(spark, sf, "languages").groupBy(F.col("name").alias("related_lang")).agg(F.min("family").alias("family"))
    return r.join(l, "related_lang", "left").groupBy(F.col("reltype").alias("kind"), "family").agg(F.sum("n").alias("n"))


@query(_NOTES + """, gc AS (SELECT word_id, gloss, count(*) AS c, min(ety_id) AS f FROM etymology WHERE gloss IS NOT NULL GROUP BY ALL), gm AS (SELECT word_id, arg_min(gloss, struct_pack(c := -c, f := f)) AS gloss FROM gc GROUP BY 1),
ps AS (SELECT word_id, array_to_string(list_sort(list_distinct(list(pos_list))), ', ') AS pos FROM etymology WHERE pos_list IS NOT NULL GROUP BY 1), ns AS (SELECT word_id, string_agg(text, '; ' ORDER BY place) AS notes FROM nt GROUP BY 1)
SELECT word_id, headword, gloss, pos, notes FROM word LEFT JOIN gm USING (word_id) LEFT JOIN ps USING (word_id) LEFT JOIN ns USING (word_id) WHERE gloss IS NOT NULL OR pos IS NOT NULL OR notes IS NOT NULL""")
def word_cards(spark, sf):
    """Definition, parts of speech and notes of each word that has any of them."""
    w = table(spark, sf, "word").select("word_id", "headword")
    e = table(spark, sf, "etymology")
    g = shares.most_common(e, ["word_id"], "gloss", "ety_id").select("word_id", F.col("modal").alias("gloss"))
    p = e.where("pos_list IS NOT NULL").groupBy("word_id").agg(F.array_join(F.array_sort(F.collect_set("pos_list")), ", ").alias("pos"))
    n = word_notes(spark, sf).groupBy("word_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("place", "text"))), lambda s: s["text"]), "; ").alias("notes"))
    j = w.join(g, "word_id", "left").join(p, "word_id", "left").join(n, "word_id", "left")
    return j.where("gloss IS NOT NULL OR pos IS NOT NULL OR notes IS NOT NULL")


@query("""WITH g AS (SELECT headword AS w, min(gloss) AS g FROM word JOIN etymology USING (word_id) WHERE headword IS NOT NULL AND gloss IS NOT NULL GROUP BY 1),
b AS (SELECT key_lower || 's' AS form, min(headword) AS base FROM word WHERE headword IS NOT NULL GROUP BY 1),
a AS (SELECT headword AS word FROM word WHERE headword IS NOT NULL UNION SELECT key_lower || 's' FROM word WHERE key_lower IS NOT NULL)
SELECT word, coalesce(x.g, y.g) AS gloss, CASE WHEN x.g IS NULL AND y.g IS NOT NULL THEN base END AS defined_by FROM a LEFT JOIN g x ON x.w = word LEFT JOIN b ON b.form = word LEFT JOIN g y ON y.w = base""")
def definition_fallback(spark, sf):
    w = table(spark, sf, "word")
    known = w.where("headword IS NOT NULL").select("word_id", F.col("headword").alias("word")).join(table(spark, sf, "etymology").where("gloss IS NOT NULL").select("word_id", "gloss"), "word_id")
    plural = F.concat("key_lower", F.lit("s"))
    asked = w.where("headword IS NOT NULL").select(F.col("headword").alias("word")).unionByName(w.where("key_lower IS NOT NULL").select(plural.alias("word")))
    return notes.with_definition(asked, "word", known, w.where("headword IS NOT NULL AND key_lower IS NOT NULL").select(plural.alias("form"), F.col("headword").alias("base")))


@query("""SELECT lang, raw_term, 'https://dictionary.example/wiki/' || replace(url_encode(replace(CASE WHEN raw_term LIKE '*%' THEN 'Reconstruction:' || coalesce(lang, 'Undetermined') || '/' || trim(regexp_replace(trim(raw_term), '^\\*+', '')) ELSE raw_term END, ' ', '_')), '%2F', '/') AS url
FROM (SELECT DISTINCT lang, raw_term FROM descendant_node WHERE raw_term IS NOT NULL)""")
def form_pages(spark, sf):
    """Page address of every stored form."""
    n = table(spark, sf, "descendant_node").where("raw_term IS NOT NULL").select("lang", "raw_term").distinct()
    return n.select("lang", "raw_term", text.page_url(text.page_title(F.coalesce("lang", F.lit("Undetermined")), F.col("raw_term")), "https://dictionary.example/wiki/").alias("url"))


@query("SELECT tree_id, n FROM (SELECT tree_id, count(*) AS n FROM descendant_node GROUP BY tree_id)")
def nested_roundtrip(spark, sf):
    """Trees nested to JSON and flattened again: nodes of each tree without the loops, then with what lies on them added."""
    n = table(spark, sf, "descendant_node")
    back = nested.flatten_json_trees(forest.nested(n), "tree_id", "tree_json").groupBy("tree_id").agg(F.count(F.lit(1)).alias("k"))
    lost = hierarchy(n).where("depth < 0").groupBy("tree_id").agg(F.count(F.lit(1)).alias("l"))
    return back.join(lost, "tree_id", "full").select("tree_id", (F.coalesce("k", F.lit(0)) + F.coalesce("l", F.lit(0))).alias("n"))


@query(f"""WITH {_LEX}, tok AS (SELECT time_bucket(INTERVAL 30 DAYS, CAST(published_at AS TIMESTAMP), TIMESTAMP '1970-01-01') AS start, unnest({TOKENS}) AS token FROM documents WHERE published_at IS NOT NULL)
SELECT CAST(epoch(start) AS BIGINT) AS start, coalesce(bucket, 'Unknown') AS bucket, count(*) AS votes FROM tok LEFT JOIN lex ON form = token GROUP BY ALL""")
def streamed_bucket_votes(spark, sf):
    """The votes of the corpus by windows of 30 days of publication (``start`` in seconds since 1970), through a stream of its files."""
    static = table(spark, sf, "documents")
    # a glob, so that the table may be one file or a folder of files
    d = streamed.read_documents(spark, f"{sf}/documents.parque[t]", static.schema)
    base = f"{shared_dir(spark).rstrip('/')}/stream-{uuid.uuid4().hex}"
    q = streamed.write_votes(streamed.votes(d, cut(lexicon_known(spark, sf))), f"{base}/out", f"{base}/state")
    q.awaitTermination()
    return streamed.current_votes(spark, f"{base}/out").withColumn("start", F.unix_timestamp("start"))
