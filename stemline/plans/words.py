"""Queries on words, tokens and shares, with the SQL each is compared with."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import DataFrame, SparkSession, Window

from stemline.functions import classify, text
from stemline.operators import cascade, compare, notes, shares
from stemline.plans import text_sql
from stemline.plans.problems import _P7_SIDE
from stemline.session import cut, spread, table

QUERIES: dict = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None):
    def add(f):
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return add


def lexicon(spark: SparkSession, sf: str) -> DataFrame:
    """``form, bucket, root``: the latest answer for each word, one row a lower-case form."""
    rows = compare.latest(
        table(spark, sf, "compare_new"),
        compare.trimmed(F.col("word")),
        {"bucket": compare.trimmed(F.col("bucket")), "root": compare.trimmed(F.regexp_replace("root", r"(?U)(\s*\([^()]*\))+\s*$", ""))},
        F.col("checked_at"),
    )
    return rows.groupBy(F.lower("key").alias("form")).agg(F.min_by("bucket", "key").alias("bucket"), F.min_by("root", "key").alias("root"))


_LEX = f"""lex0 AS ({_P7_SIDE.format('compare_new')}),
lex AS (SELECT lower(w) AS form, arg_min(s.b, w) AS bucket FROM (SELECT w, s FROM lex0 WHERE w <> '' AND s.b IS NOT NULL) GROUP BY 1)"""
_CUT = "lower(text)"
_CUT = f"translate({_CUT}, '’ʼ＇‘', '''''''''')"
for _a, _b in text.IRREGULAR.items():
    _CUT = "regexp_replace({}, '\\b{}\\b', '{}', 'g')".format(_CUT, _a.replace("'", "''"), _b)
_CUT = f"regexp_replace({_CUT}, '(\\w+)n''t\\b', '\\1 not', 'g')"
for _a, _b in text.CLITICS.items():
    _CUT = "regexp_replace({}, '{}\\b', ' {}', 'g')".format(_CUT, _a.replace("'", "''"), _b)
TOKENS = f"list_filter(regexp_extract_all({_CUT}, '[a-z]+'), lambda t: length(t) > 1)"
_TOK = f"tok AS (SELECT doc_id, lang, source, unnest({TOKENS}) AS token FROM documents)"
_ORDER = "coalesce(list_position([" + ",".join(f"'{b}'" for b in classify.BUCKETS) + "], bucket), 999)"


def _shares_sql(key: str, where: str = "") -> str:
    return f"""WITH {_LEX}, {_TOK},
v AS (SELECT tok.{key}, coalesce(lex.bucket, 'Unknown') AS bucket, CAST(count(*) AS DOUBLE) AS votes FROM tok LEFT JOIN lex ON lex.form = tok.token {where} GROUP BY ALL)
SELECT {key}, bucket, votes, round(votes * 100 / sum(votes) OVER (PARTITION BY {key}), 6) AS pct_all,
  round(CASE WHEN bucket <> 'Unknown' THEN votes * 100 / sum(votes) FILTER (WHERE bucket <> 'Unknown') OVER (PARTITION BY {key}) END, 6) AS pct_resolved, {_ORDER} AS place FROM v"""


def _shares(spark: SparkSession, sf: str, key: str, connectors: bool = True) -> DataFrame:
    c = shares.token_counts(table(spark, sf, "documents"), [key], connectors=connectors)
    s = shares.shares(shares.resolved_tokens(c, lexicon_known(spark, sf)), [key])
    return s.withColumn("pct_all", F.round("pct_all", 6)).withColumn("pct_resolved", F.round("pct_resolved", 6))


def lexicon_known(spark: SparkSession, sf: str) -> DataFrame:
    rows = compare.latest(table(spark, sf, "compare_new"), compare.trimmed(F.col("word")), {"bucket": compare.trimmed(F.col("bucket"))}, F.col("checked_at"))
    return rows.where(F.col("bucket").isNotNull()).groupBy(F.lower("key").alias("form")).agg(F.min_by("bucket", "key").alias("bucket"))


@query(_shares_sql("lang"))
def bucket_share_by_lang(spark, sf):
    return _shares(spark, sf, "lang")


@query(_shares_sql("source"))
def bucket_share_by_source(spark, sf):
    return _shares(spark, sf, "source")


@query(_shares_sql("doc_id"))
def bucket_share_by_doc(spark, sf):
    return _shares(spark, sf, "doc_id")


@query(_shares_sql("lang", "WHERE token NOT IN (" + ",".join(f"'{c}'" for c in text.CONNECTORS) + ")"))
def connector_excluded_share(spark, sf):
    return _shares(spark, sf, "lang", connectors=False)


@query(f"""WITH {_LEX}, {_TOK}, r AS (SELECT lang, coalesce(bucket, 'Unknown') AS bucket FROM tok LEFT JOIN lex ON form = token)
SELECT lang, count(*) AS tokens, count(*) FILTER (WHERE bucket <> 'Unknown') AS resolved, count(*) FILTER (WHERE bucket = 'Germanic') AS approximate,
  count(*) FILTER (WHERE bucket <> 'Unknown') * 100.0 / count(*) AS coverage,
  CASE WHEN count(*) FILTER (WHERE bucket <> 'Unknown') > 0 THEN count(*) FILTER (WHERE bucket = 'Germanic') * 100.0 / count(*) FILTER (WHERE bucket <> 'Unknown') END AS approximate_share FROM r GROUP BY lang""")
def coverage_report(spark, sf):
    c = shares.token_counts(table(spark, sf, "documents"), ["lang"])
    return shares.coverage(shares.resolved_tokens(c, lexicon_known(spark, sf)), ["lang"])


@query(f"SELECT doc_id, len({TOKENS}) AS tokens, len(list_distinct({TOKENS})) AS distinct_tokens FROM documents WHERE text IS NOT NULL")
def document_tokens(spark, sf):
    t = text.tokens(F.col("text"))
    return spread(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.size(t).cast("long").alias("tokens"), F.size(F.array_distinct(t)).cast("long").alias("distinct_tokens"))


@query("SELECT doc_id, md5(array_to_string(" + TOKENS + ", ' ')) AS expanded FROM documents WHERE text IS NOT NULL")
def contraction_expand(spark, sf):
    """The tokens of each document, contractions expanded, told by a digest."""
    return spread(table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", "text")).select("doc_id", F.md5(F.array_join(text.tokens(F.col("text")), " ")).alias("expanded"))


@query(f"WITH {_TOK} SELECT token, count(*) AS n FROM tok GROUP BY token ORDER BY n DESC, token LIMIT 100")
def token_frequency_topk(spark, sf):
    return shares.token_counts(table(spark, sf, "documents"), []).orderBy(F.col("n").desc(), "token").limit(100)


@query(f"""WITH {_LEX}, p AS (SELECT doc_id, unnest({TOKENS}) AS token, generate_subscripts({TOKENS}, 1) - 1 AS pos FROM documents),
d AS (SELECT doc_id, token, count(*) AS n, min(pos) AS first, any_value(coalesce(bucket, 'Unknown')) AS bucket FROM p LEFT JOIN lex ON form = token GROUP BY doc_id, token)
SELECT doc_id, token, n, first, bucket, row_number() OVER (PARTITION BY doc_id ORDER BY first) AS by_input, row_number() OVER (PARTITION BY doc_id ORDER BY token) AS by_alpha,
  row_number() OVER (PARTITION BY doc_id ORDER BY {_ORDER}, token) AS by_language,
  row_number() OVER (PARTITION BY doc_id ORDER BY bucket IN ({','.join(f"'{b}'" for b in classify.CORE)}), token) AS by_distinctive,
  row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, first) AS by_frequency FROM d""")
def document_word_orders(spark, sf):
    t = shares.token_rows(table(spark, sf, "documents"), ["doc_id"])
    return shares.word_orders(shares.resolved_tokens(t, lexicon_known(spark, sf)), "doc_id")


@query(f"""WITH {_P7_SIDE.format('compare_new').join(['lex0 AS (', ')'])},
l AS (SELECT lower(w) AS form, arg_min(struct_pack(b := s.b, t := s.t), w) AS s FROM lex0 WHERE w <> '' AND s.b IS NOT NULL AND s.t IS NOT NULL GROUP BY 1), {_TOK},
c AS (SELECT s.b AS bucket, s.t AS language, count(*) AS n FROM tok JOIN l ON form = token GROUP BY ALL)
SELECT bucket, language, n, n * 100.0 / sum(n) OVER (PARTITION BY bucket) AS pct FROM c""")
def bucket_drilldown(spark, sf):
    rows = compare.latest(
        table(spark, sf, "compare_new"), compare.trimmed(F.col("word")),
        {"bucket": compare.trimmed(F.col("bucket")), "root": compare.trimmed(F.regexp_replace("root", r"(?U)(\s*\([^()]*\))+\s*$", ""))}, F.col("checked_at"),
    )
    rows = compare.coded(rows, "root", table(spark, sf, "languages"), "wikt_code", "name").where("bucket IS NOT NULL AND root IS NOT NULL")
    lex = rows.groupBy(F.lower("key").alias("form")).agg(F.min_by(F.struct("bucket", "root"), "key").alias("s"))
    t = shares.token_counts(table(spark, sf, "documents"), [])
    c = t.join(lex, t["token"] == lex["form"]).groupBy(F.col("s.bucket").alias("bucket"), F.col("s.root").alias("language")).agg(F.sum("n").alias("n"))
    return c.withColumn("pct", F.col("n") * 100.0 / F.sum("n").over(Window.partitionBy("bucket")))


@query("""WITH s AS (SELECT headword AS form, word_id, CASE WHEN headword <> key_lower THEN 'verbatim' ELSE 'exact' END AS kind, CASE WHEN headword <> key_lower THEN 5 ELSE 10 END AS rank FROM word
  UNION ALL SELECT key_lower, word_id, 'case', 50 FROM word WHERE headword <> key_lower),
a AS (SELECT DISTINCT headword AS typed FROM documents WHERE headword IS NOT NULL),
t AS (SELECT typed, typed AS form FROM a UNION SELECT typed, lower(typed) FROM a),
r AS (SELECT typed, w.word_id, w.headword, kind, rank, row_number() OVER (PARTITION BY typed ORDER BY rank, w.headword <> w.key_lower, -coalesce(ety_count, -1), w.headword, w.word_id) AS k
  FROM t JOIN s USING (form) JOIN word w USING (word_id))
SELECT a.typed, word_id, headword, kind, rank FROM a LEFT JOIN r ON r.typed = a.typed AND k = 1""")
def surface_form_lookup(spark, sf):
    w = table(spark, sf, "word")
    return shares.ranked_lookup(table(spark, sf, "documents"), "headword", shares.surface_forms(w), w)


_FORMS = """list_filter([key_lower || 's', CASE WHEN regexp_matches(key_lower, '(s|x|z|ch|sh)$') THEN key_lower || 'es' END,
  CASE WHEN length(key_lower) > 2 AND regexp_matches(key_lower, '[^aeiou]y$') THEN key_lower[:-2] || 'ies' END,
  CASE WHEN key_lower LIKE '%e' THEN key_lower || 'd' ELSE key_lower || 'ed' END, CASE WHEN key_lower LIKE '%e' THEN key_lower[:-2] || 'ing' ELSE key_lower || 'ing' END], lambda f: f IS NOT NULL)"""


@query(f"""WITH g AS (SELECT key_lower AS base, unnest({_FORMS}) AS form FROM word WHERE status <> 'none' AND key_lower IS NOT NULL)
SELECT form, min(base) AS base FROM g WHERE form NOT IN (SELECT headword FROM word WHERE headword IS NOT NULL) AND form NOT IN (SELECT key_lower FROM word WHERE key_lower IS NOT NULL) GROUP BY form""")
def generated_forms(spark, sf):
    w = table(spark, sf, "word")
    return shares.new_forms(w.where("status <> 'none'"), "key_lower", text.regular_forms(F.col("key_lower")), shares.surface_forms(w), "form")


@query(f"""WITH {_TOK}, v AS (SELECT DISTINCT token FROM tok), {text_sql.STEMS}
SELECT word, arg_min(base, place) AS base, CAST(min(place) AS INT) AS place FROM stems JOIN v ON v.token = base GROUP BY word""")
def stem_first_match(spark, sf):
    """Tokens of the corpus with the first of their stems that is a token itself."""
    vocabulary = cut(shares.token_counts(table(spark, sf, "documents"), []).select("token"))
    return shares.first_match(vocabulary, "token", text.stem_candidates(F.col("token")), vocabulary, "token")


@query("""WITH c AS (SELECT word_id, gloss, count(*) AS n, min(ety_id) AS f FROM etymology WHERE gloss IS NOT NULL GROUP BY ALL),
r AS (SELECT *, row_number() OVER (PARTITION BY word_id ORDER BY n DESC, f) AS k FROM c)
SELECT word_id, max(gloss) FILTER (WHERE k = 1) AS modal, max(n) FILTER (WHERE k = 1) AS n, coalesce(string_agg(gloss, '|' ORDER BY k) FILTER (WHERE k BETWEEN 2 AND 4), '') AS also FROM r GROUP BY word_id""")
def modal_gloss(spark, sf):
    return shares.most_common(table(spark, sf, "etymology"), ["word_id"], "gloss", "ety_id")


@query("SELECT word_id, arg_min(label, ety_id) FILTER (WHERE label IS NOT NULL) AS label, arg_min(shape, ety_id) FILTER (WHERE shape IS NOT NULL) AS shape FROM etymology GROUP BY word_id")
def first_wins(spark, sf):
    pick = lambda c: F.min_by(c, F.when(F.col(c).isNotNull(), F.col("ety_id"))).alias(c)
    return table(spark, sf, "etymology").groupBy("word_id").agg(pick("label"), pick("shape"))


@query("SELECT word_id, string_agg(shape, ',' ORDER BY f) AS shapes FROM (SELECT word_id, shape, min(ety_id) AS f FROM etymology WHERE shape IS NOT NULL GROUP BY ALL) GROUP BY word_id")
def ordered_distinct_shapes(spark, sf):
    d = table(spark, sf, "etymology").where("shape IS NOT NULL").groupBy("word_id", "shape").agg(F.min("ety_id").alias("f"))
    return d.groupBy("word_id").agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("f", "shape"))), lambda s: s["shape"]), ",").alias("shapes"))


@query("SELECT e.source_id, s.name, lower(trim(s.kind)) AS kind, count(*) AS claims, count(DISTINCT word_id) AS words FROM etymology e LEFT JOIN sources s USING (source_id) GROUP BY ALL")
def claims_by_source(spark, sf):
    e, s = table(spark, sf, "etymology"), table(spark, sf, "sources").select("source_id", "name", F.lower(F.trim("kind")).alias("kind"))
    c = e.groupBy("source_id").agg(F.count(F.lit(1)).alias("claims"), F.countDistinct("word_id").alias("words"))
    return c.join(s, "source_id", "left").select("source_id", "name", "kind", "claims", "words")


@query("""WITH k AS (SELECT DISTINCT lang FROM descendant_node WHERE lang IS NOT NULL),
p AS (SELECT lang, 0 AS i, lang AS n FROM k UNION ALL SELECT lang, 1, regexp_replace(lang, '^[^ ]* ', '') FROM k WHERE lang LIKE '% %' UNION ALL SELECT lang, 2, regexp_replace(lang, '^[^ ]* [^ ]* ', '') FROM k WHERE lang LIKE '% % %'),
b AS (SELECT p.lang, arg_min(l.bucket, i) AS bucket FROM p JOIN languages l ON l.name = n AND l.bucket IS NOT NULL GROUP BY p.lang)
SELECT d.lang, coalesce(b.bucket, 'Other') AS bucket, count(*) AS nodes FROM descendant_node d LEFT JOIN b ON b.lang = d.lang GROUP BY ALL""")
def bucket_by_parent_name(spark, sf):
    n = table(spark, sf, "descendant_node").groupBy("lang").agg(F.count(F.lit(1)).alias("nodes"))
    return classify.with_bucket(n, "lang", table(spark, sf, "languages")).select("lang", "bucket", "nodes")


@query("""SELECT a.name AS name_a, b.name AS name_b, coalesce(a.family = b.family, false) AS same_family FROM languages a JOIN languages b
ON a.era_start <= b.era_end AND b.era_start <= a.era_end AND a.lang_id < b.lang_id""")
def era_contemporaries(spark, sf):
    return classify.contemporaries(table(spark, sf, "languages"))


@query("""SELECT a.alias_id, coalesce(c.lang_id, n.lang_id) AS found FROM language_alias a
LEFT JOIN (SELECT wikt_code, min(lang_id) AS lang_id FROM languages GROUP BY 1) c ON c.wikt_code = a.alias
LEFT JOIN (SELECT lower(name) AS name, min(lang_id) AS lang_id FROM languages GROUP BY 1) n ON n.name = lower(a.alias)""")
def language_by_code_or_name(spark, sf):
    a = table(spark, sf, "language_alias").select("alias_id", "alias")
    return classify.find_language(a, "alias", table(spark, sf, "languages"), "found").select("alias_id", "found")


@query("""SELECT lang_code, coalesce(l.name, h.name, lang_code) AS name, n FROM (SELECT lang_code, count(*) AS n FROM descendant_node WHERE lang_code IS NOT NULL GROUP BY 1) d
LEFT JOIN (SELECT wikt_code, min(name) AS name FROM languages GROUP BY 1) l ON l.wikt_code = lang_code
LEFT JOIN (SELECT lang_code AS code, arg_min(lang, node_id) AS name FROM descendant_node WHERE lang IS NOT NULL AND lang_code IS NOT NULL GROUP BY 1) h ON h.code = lang_code""")
def code_display_names(spark, sf):
    """Curated name, else the name harvested first with the code, else the code."""
    n = table(spark, sf, "descendant_node").where("lang_code IS NOT NULL")
    harvested = n.where("lang IS NOT NULL").groupBy(F.col("lang_code").alias("code")).agg(F.min_by("lang", "node_id").alias("name"))
    return classify.display_name(n.groupBy("lang_code").agg(F.count(F.lit(1)).alias("n")), "lang_code", table(spark, sf, "languages"), harvested).select("lang_code", "name", "n")


@query("SELECT word_id, headword FROM word WHERE headword IS NOT NULL ORDER BY md5(headword || '#20260730'), headword LIMIT 200")
def seeded_word_sample(spark, sf):
    return shares.seeded_sample(table(spark, sf, "word").where("headword IS NOT NULL").select("word_id", "headword"), "headword", 200, 20260730)


@query(f"""WITH {_LEX}, {_TOK} SELECT token, count(*) AS n, min(doc_id) AS example FROM tok WHERE token NOT IN (SELECT form FROM lex) AND lang = 'en' GROUP BY token""")
def unknown_tokens(spark, sf):
    d = spread(table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "text"))
    t = d.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example"))
    return t.join(lexicon_known(spark, sf), t["token"] == F.col("form"), "left_anti")


@query("""WITH t AS (SELECT doc_id, regexp_extract_all(text, '[A-Za-z]+|[.!?]') AS t FROM documents),
w AS (SELECT doc_id, unnest(t) AS w, unnest(list_concat(['.'], t[:-2])) AS p FROM t WHERE len(t) > 0)
SELECT lower(w) AS word, count(DISTINCT doc_id) AS documents FROM w WHERE regexp_matches(w, '^[A-Z]') AND p NOT IN ('.', '!', '?') GROUP BY 1""")
def mid_sentence_names(spark, sf):
    """Words that begin with a capital inside a sentence, and in how many documents."""
    w = table(spark, sf, "documents").select("doc_id", F.explode(text.mid_sentence_capitals(F.col("text"))).alias("word"))
    return w.groupBy("word").agg(F.count(F.lit(1)).alias("documents"))


@query("""SELECT w.word_id, headword FROM word w WHERE regexp_full_match(headword, '\\p{Ll}{3,19}') AND EXISTS (SELECT 1 FROM etymology e WHERE e.word_id = w.word_id AND e.gloss IS NOT NULL)""")
def dictionary_pool(spark, sf):
    w = table(spark, sf, "word").where(text.in_dictionary_pool(F.col("headword"))).select("word_id", "headword")
    return w.join(table(spark, sf, "etymology").where("gloss IS NOT NULL").select("word_id"), "word_id", "left_semi")


@query("""SELECT word_id, bool_or(gloss IS NOT NULL) AS has_gloss, bool_or(shape IS NOT NULL) AS has_shape, array_to_string(list_sort(list_distinct(list(pos_list) FILTER (WHERE pos_list IS NOT NULL))), '|') AS parts,
count(DISTINCT ordinal) AS ordinals FROM etymology GROUP BY word_id""")
def claim_coverage(spark, sf):
    return table(spark, sf, "etymology").groupBy("word_id").agg(
        F.bool_or(F.col("gloss").isNotNull()).alias("has_gloss"), F.bool_or(F.col("shape").isNotNull()).alias("has_shape"),
        F.when(F.count("pos_list") > 0, F.array_join(F.sort_array(F.collect_set("pos_list")), "|")).alias("parts"), F.countDistinct("ordinal").alias("ordinals"),
    )


@query("""SELECT 'word' AS tab, count(*) AS n FROM word UNION ALL SELECT 'etymology', count(*) FROM etymology UNION ALL SELECT 'languages', count(*) FROM languages
UNION ALL SELECT 'descendant_node', count(*) FROM descendant_node UNION ALL SELECT 'status ' || coalesce(status, '-'), count(*) FROM word GROUP BY status""")
def table_stats(spark, sf):
    one = lambda t: table(spark, sf, t).agg(F.count(F.lit(1)).alias("n")).select(F.lit(t).alias("tab"), "n")
    status = table(spark, sf, "word").groupBy("status").agg(F.count(F.lit(1)).alias("n")).select(F.concat(F.lit("status "), F.coalesce("status", F.lit("-"))).alias("tab"), "n")
    return one("word").unionByName(one("etymology")).unionByName(one("languages")).unionByName(one("descendant_node")).unionByName(status)


@query("""SELECT doc_id, regexp_matches(text, '(?i)first written down') AND NOT regexp_matches(text, '(?i)nobody has explained|no clear link') AS asserted FROM documents WHERE text IS NOT NULL""")
def attribution_claims(spark, sf):
    t = text.asserts(F.col("text"), "first written down", "nobody has explained|no clear link")
    return table(spark, sf, "documents").where("text IS NOT NULL").select("doc_id", t.alias("asserted"))


@query("""WITH c AS (SELECT unnest(regexp_extract_all(text, '\\{\\{([^{}]+)\\}\\}', 1)) AS c FROM documents)
SELECT trim(string_split(c, '|')[1]) AS name, trim(string_split(c, '|')[2]) AS code, count(*) AS n FROM c GROUP BY ALL""")
def template_calls(spark, sf):
    c = table(spark, sf, "documents").select(F.explode(text.template_calls(F.col("text"))).alias("c"))
    return c.groupBy(F.get("c", F.lit(0)).alias("name"), F.get("c", F.lit(1)).alias("code")).agg(F.count(F.lit(1)).alias("n"))


@query(f"""SELECT lang, bucket, pct, repeat('#', CAST(round_even(pct / 2, 0) AS INT)) AS bar FROM (SELECT lang, bucket, pct_resolved AS pct FROM ({_shares_sql('lang')}) WHERE bucket <> 'Unknown')""")
def report_bars(spark, sf):
    s = bucket_share_by_lang(spark, sf).where("bucket <> 'Unknown'")
    return s.select("lang", "bucket", F.col("pct_resolved").alias("pct"), text.bar(F.col("pct_resolved")).alias("bar"))


@query("""SELECT bucket, name, round(35 + 40 * CASE WHEN n > 1 THEN (r - 1.0) / (n - 1) ELSE 0.5 END, 4) AS lightness FROM (
SELECT bucket, name, row_number() OVER (PARTITION BY bucket ORDER BY name) AS r, count(*) OVER (PARTITION BY bucket) AS n FROM languages WHERE bucket IS NOT NULL)""")
def language_shades(spark, sf):
    return classify.shades(table(spark, sf, "languages"))


@query("SELECT lang_id, regexp_replace(regexp_replace(lower(name), '[^a-z0-9]+', '-', 'g'), '^-|-$', '', 'g') AS slug, name LIKE 'Proto-%' AS proto, regexp_full_match(name, '((Northern|Southern|Eastern|Western|Midland|Anglian|Northumbrian|Mercian|Kentish|West Saxon|Early|Late) )?((Middle|Old) )?English') AS english_stage, era_end = 9999 AS living FROM languages")
def language_flags(spark, sf):
    n = F.col("name")
    return table(spark, sf, "languages").select("lang_id", classify.slug(n).alias("slug"), classify.is_proto(n).alias("proto"), classify.is_english_stage(n).alias("english_stage"), (F.col("era_end") == 9999).alias("living"))


@query("""WITH p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part WHERE p_name IS NOT NULL)
SELECT part, round(sum(1.0 / n), 6) AS votes, count(*) AS uses FROM (SELECT unnest(w) AS part, len(w) AS n FROM p) GROUP BY part""")
def split_votes(spark, sf):
    p = table(spark, sf, "part").where("p_name IS NOT NULL").select("p_partkey", F.split("p_name", " ").alias("w"))
    return shares.split_votes(p, "p_partkey", "w").withColumn("votes", F.round("votes", 6))


@query(f"""WITH {_TOK}, p AS (SELECT p_partkey, string_split(p_name, ' ') AS w FROM part WHERE p_name IS NOT NULL), k AS (SELECT DISTINCT token AS part FROM tok)
SELECT p_partkey, max(n) AS parts FROM (SELECT p_partkey, unnest(list_distinct(w)) AS part, len(w) AS n FROM p) e LEFT JOIN k ON k.part = e.part GROUP BY p_partkey HAVING bool_and(k.part IS NOT NULL) AND max(n) >= 2""")
def all_parts_known(spark, sf):
    """Names every word of which is a token of the corpus: relational division."""
    p = table(spark, sf, "part").where("p_name IS NOT NULL").select("p_partkey", F.split("p_name", " ").alias("w"))
    known = shares.token_counts(table(spark, sf, "documents"), []).select("token")
    return shares.all_known(p, "p_partkey", "w", known, "token").withColumn("parts", F.col("parts").cast("long"))


@query("""SELECT doc_id, trim(regexp_extract(text, '([^.!?]*\\b(?:church|market)\\b[^.!?]*[.!?]?)', 1)) AS sentence FROM documents WHERE regexp_matches(text, '\\b(?:church|market)\\b')""")
def sentence_of_interest(spark, sf):
    d = table(spark, sf, "documents").where(F.rlike("text", F.lit(r"\b(?:church|market)\b")))
    return d.select("doc_id", text.sentence_with(F.col("text"), "(?:church|market)").alias("sentence"))


@query("SELECT ety_id, CASE WHEN length(gloss) > 12 THEN substr(gloss, 1, 12) || '...' ELSE gloss END AS short FROM etymology WHERE gloss IS NOT NULL")
def truncated_gloss(spark, sf):
    return table(spark, sf, "etymology").where("gloss IS NOT NULL").select("ety_id", text.truncated(F.col("gloss"), 12, "...").alias("short"))


_GEN = _FORMS.replace("key_lower", "w.key_lower")


@query(f"""WITH b AS (SELECT DISTINCT headword AS form, word_id, CASE WHEN headword <> key_lower THEN 'verbatim' ELSE 'exact' END AS kind FROM word WHERE headword IS NOT NULL
  UNION SELECT key_lower, word_id, 'case' FROM word WHERE headword <> key_lower),
hd AS (SELECT key_lower, arg_min(word_id, struct_pack(c := headword <> key_lower, i := word_id)) AS word_id FROM word WHERE status <> 'none' AND key_lower IS NOT NULL GROUP BY 1),
inf AS (SELECT DISTINCT lower(lang || '-' || term) AS form, term AS base FROM descendant_node WHERE lang = 'English' AND term IS NOT NULL AND lang IS NOT NULL),
i AS (SELECT DISTINCT form, word_id, 'inflection' AS kind FROM inf JOIN hd ON lower(base) = key_lower WHERE form NOT IN (SELECT headword FROM word WHERE headword IS NOT NULL)),
v AS (SELECT DISTINCT lower(headword) AS token FROM word WHERE status = 'none' AND headword IS NOT NULL), {text_sql.STEMS},
d AS (SELECT word AS form, hd.word_id, 'derivation' AS kind FROM (SELECT word, arg_min(base, place) AS base FROM stems JOIN hd ON key_lower = base GROUP BY 1) JOIN hd ON key_lower = base),
m AS (SELECT * FROM b UNION SELECT * FROM i UNION SELECT * FROM d),
g0 AS (SELECT form, min(base) AS base FROM (SELECT key_lower AS base, unnest({_FORMS}) AS form FROM word WHERE status <> 'none' AND key_lower IS NOT NULL) WHERE form NOT IN (SELECT form FROM m WHERE form IS NOT NULL) GROUP BY 1),
g AS (SELECT form, hd.word_id, 'generated' AS kind FROM g0 JOIN hd ON base = key_lower)
SELECT kind, CAST(CASE kind WHEN 'verbatim' THEN 5 WHEN 'exact' THEN 10 WHEN 'inflection' THEN 40 WHEN 'generated' THEN 45 WHEN 'case' THEN 50 ELSE 60 END AS INT) AS rank, count(*) AS forms FROM (SELECT * FROM m UNION SELECT * FROM g) GROUP BY ALL""")
def surface_form_kinds(spark, sf):
    """How many forms reach a word in each way; as inflected forms stand those that the descendant forest gives English words, marked by their language."""
    w = table(spark, sf, "word")
    inflected = table(spark, sf, "descendant_node").where("lang = 'English' AND term IS NOT NULL").select(F.lower(F.concat_ws("-", "lang", "term")).alias("form"), F.col("term").alias("base")).distinct()
    return shares.all_surface_forms(w, inflected).groupBy("kind", "rank").agg(F.count(F.lit(1)).alias("forms"))


_CASCADE = f"""WITH RECURSIVE lex0 AS ({_P7_SIDE.format('compare_new')}), r AS (SELECT lower(w) AS form, bool_or(s.b IS NOT NULL AND coalesce(s.r, false)) AS trusted, bool_or(s.b IS NOT NULL) AS usable FROM lex0 WHERE w <> '' GROUP BY 1),
v0 AS (SELECT token, CAST(sum(n) AS BIGINT) AS n FROM (SELECT token, 1 AS n FROM (SELECT unnest({TOKENS}) AS token FROM documents) UNION ALL SELECT form || 's', 0 FROM r UNION ALL SELECT form || form, 0 FROM r) GROUP BY 1), v AS (SELECT token FROM v0), {text_sql.STEMS},
ot AS (SELECT word, arg_min(base, place) AS other FROM stems JOIN r ON r.form = base WHERE usable GROUP BY 1),
fine AS (SELECT form || form AS word FROM r WHERE usable),
c AS (SELECT v0.token, n, CASE WHEN r.trusted THEN 'own' WHEN other IS NOT NULL THEN 'form' WHEN r.usable THEN 'own' WHEN fine.word IS NOT NULL THEN 'parts' WHEN r.form IS NOT NULL THEN 'own' ELSE 'none' END AS via
  FROM v0 LEFT JOIN r ON r.form = v0.token LEFT JOIN ot ON ot.word = v0.token LEFT JOIN fine ON fine.word = v0.token)
SELECT via, count(*) AS tokens, CAST(sum(n) AS BIGINT) AS occurrences FROM c GROUP BY via"""


@query(_CASCADE)
def token_cascade(spark, sf):
    """How each token of the corpus, and each known word's plural and doubling, is answered for: by itself, by a stem of it, by its two halves, or not at all."""
    latest = compare.latest(table(spark, sf, "compare_new"), compare.trimmed(F.col("word")), {"bucket": compare.trimmed(F.col("bucket")), "resolved": F.col("resolved")}, F.col("checked_at"))
    records = cut(latest.select(F.lower("key").alias("form"), (F.col("bucket").isNotNull() & F.coalesce("resolved", F.lit(False))).alias("trusted"), F.col("bucket").isNotNull().alias("usable")))
    made = lambda c: records.select(c.alias("token"), F.lit(0).cast("long").alias("n"))
    vocabulary = shares.token_counts(table(spark, sf, "documents"), []).unionByName(made(F.concat("form", F.lit("s")))).unionByName(made(F.concat("form", "form")))
    vocabulary = cut(vocabulary.groupBy("token").agg(F.sum("n").alias("n")))
    pieces = records.select(F.concat("form", "form").alias("word"), F.posexplode(F.array("form", "form")).alias("place", "part"))
    splits = cascade.flattened_splits(pieces)
    answers = cascade.answered(vocabulary, "token", records, text.stem_candidates(F.col("word")), splits)
    return vocabulary.join(answers, F.col("token") == F.col("word")).groupBy("via").agg(F.count(F.lit(1)).alias("tokens"), F.sum("n").alias("occurrences"))


@query("""WITH n AS (SELECT lang, lang_code FROM descendant_node), l AS (SELECT wikt_code AS code, min(name) AS name FROM languages WHERE wikt_code IS NOT NULL GROUP BY 1)
SELECT lang_code, coalesce(f.name, l.name, lang_code) AS name, coalesce(b.bucket, 'Unknown') AS fixed_bucket, count(*) AS nodes FROM n
LEFT JOIN (VALUES """ + ",".join(f"('{c}', '{n}')" for c, n in classify.FAMILY_CODES.items()) + """) f(code, name) ON f.code = lang_code LEFT JOIN l ON l.code = lang_code
LEFT JOIN (VALUES """ + ",".join(f"('{c}', '{b}')" for c, b in classify.CODE_BUCKETS.items()) + """) b(code, bucket) ON b.code = lang_code WHERE lang_code IS NOT NULL GROUP BY ALL""")
def code_resolution(spark, sf):
    """What each code of the forest is called: the name of a family, else the listed one, else the code; and the group that the fixed codes give it."""
    n = table(spark, sf, "descendant_node").where("lang_code IS NOT NULL").groupBy("lang_code").agg(F.count(F.lit(1)).alias("nodes"))
    registry = table(spark, sf, "languages").select(F.col("wikt_code").alias("code"), "name")
    return classify.resolved_names(n, "lang_code", registry).select("lang_code", "name", classify.bucket_of_code(F.col("lang_code")).alias("fixed_bucket"), "nodes")


@query("SELECT lang_id, l.bucket, f.family FROM languages l LEFT JOIN (VALUES " + ",".join(f"('{b}', '{f}')" for b, f in classify.FAMILIES.items()) + ") f(bucket, family) ON f.bucket = l.bucket")
def language_families(spark, sf):
    """The broad lineage of each language's group."""
    return table(spark, sf, "languages").select("lang_id", "bucket", classify.family_of(F.col("bucket")).alias("family"))


@query("SELECT name, CAST(coalesce(d, 10) AS INT) AS depth FROM (SELECT DISTINCT lang AS name FROM descendant_node WHERE lang IS NOT NULL UNION SELECT name FROM languages WHERE name IS NOT NULL) LEFT JOIN (VALUES " + ",".join(f"('{n}', {d})" for n, d in classify.DEPTH_HINT.items()) + ") h(n, d) ON n = name")
def depth_hints(spark, sf):
    """How far back each language of the forest and of the list lies."""
    n = table(spark, sf, "descendant_node").select(F.col("lang").alias("name")).unionByName(table(spark, sf, "languages").select("name"))
    return n.where("name IS NOT NULL").distinct().select("name", classify.depth_hint(F.col("name")).alias("depth"))


@query(f"""WITH {_LEX}, {_TOK}, m AS (SELECT DISTINCT lower(w) AS word FROM (SELECT unnest(t) AS w, unnest(list_concat(['.'], t[:-2])) AS p FROM (SELECT regexp_extract_all(text, '[A-Za-z]+|[.!?]') AS t FROM documents WHERE lang = 'en') WHERE len(t) > 0) WHERE regexp_matches(w, '^[A-Z]') AND p NOT IN ('.', '!', '?'))
SELECT token, count(*) AS n, min(doc_id) AS example, token IN (SELECT word FROM m) AS name_like, CASE WHEN token NOT IN (SELECT form FROM lex) THEN 'Unknown' ELSE 'Other' END AS class
FROM tok WHERE lang = 'en' AND (token NOT IN (SELECT form FROM lex) OR token IN (SELECT form FROM lex WHERE bucket = 'Other')) GROUP BY token""")
def unknown_findings(spark, sf):
    """Tokens of English documents that nothing answers for (Unknown) or whose group is open (Other): how often, where, and whether they stand with a capital inside a sentence."""
    d = spread(table(spark, sf, "documents").where("lang = 'en'").select("doc_id", "text"))
    t = d.select("doc_id", F.explode(text.tokens(F.col("text"))).alias("token")).groupBy("token").agg(F.count(F.lit(1)).alias("n"), F.min("doc_id").alias("example"))
    names = d.select(F.explode(text.mid_sentence_capitals(F.col("text"))).alias("token")).distinct().withColumn("name_like", F.lit(True))
    j = t.join(lexicon_known(spark, sf), t["token"] == F.col("form"), "left").where("bucket IS NULL OR bucket = 'Other'")
    return j.join(names, "token", "left").select("token", "n", "example", F.coalesce("name_like", F.lit(False)).alias("name_like"), F.coalesce("bucket", F.lit("Unknown")).alias("class"))


_OLD = _P7_SIDE.replace("t := coalesce(l.name, t))", "t := coalesce(l.name, t), n := branches)").replace("resolved, nullif", "resolved, branches, nullif", 1).format("compare_old")


@query(f"""WITH o AS ({_OLD}), n AS ({_P7_SIDE.format('compare_new')}), j AS (SELECT coalesce(o.s.r, false) AS a, coalesce(n.s.r, false) AS b, o.s AS x, n.s AS y FROM o FULL JOIN n ON o.w = n.w)
SELECT CASE WHEN a AND NOT b THEN 'lost_data' WHEN b AND NOT a THEN 'gained_data' WHEN NOT a THEN 'same' WHEN x.b IS DISTINCT FROM y.b THEN 'bucket_changed' WHEN x.t IS DISTINCT FROM y.t THEN 'root_changed' WHEN x.n > 1 THEN 'unfloated' ELSE 'same' END AS class, count(*) AS words FROM j GROUP BY 1""")
def answer_classes(spark, sf):
    """How many words the new answers lose, gain, move or leave as they were."""
    languages = table(spark, sf, "languages")

    def side(name: str, *more: str) -> DataFrame:
        root = compare.trimmed(F.regexp_replace("root", r"(?U)(\s*\([^()]*\))+\s*$", ""))
        fields = {"resolved": F.col("resolved"), "bucket": compare.trimmed(F.col("bucket")), "root": root, **{m: F.col(m) for m in more}}
        rows = compare.latest(table(spark, sf, name).where("word IS NOT NULL"), F.regexp_replace("word", r"(?U)^\s+|\s+$", ""), fields, F.col("checked_at"))
        return compare.coded(rows, "root", languages, "wikt_code", "name")

    return compare.answer_class(side("compare_old", "branches"), side("compare_new")).groupBy("class").agg(F.count(F.lit(1)).alias("words"))


@query(f"""WITH s AS ({_shares_sql('lang')}), c AS (SELECT lang, sum(votes) AS t, coalesce(sum(votes) FILTER (WHERE bucket <> 'Unknown'), 0) AS r, coalesce(sum(votes) FILTER (WHERE bucket = 'Germanic'), 0) AS a FROM s GROUP BY lang)
SELECT lang, CAST(unnest([0, 1, 2, 3, 4, 5]) AS INT) AS place, unnest([format('Tokens analyzed : {{:d}}', CAST(t AS BIGINT)), format('Classified      : {{:d}}  (coverage {{:.1f}}%)', CAST(r AS BIGINT), round_even(r * 100.0 / t, 1)), format('Unknown         : {{:d}}', CAST(t - r AS BIGINT)),
  format('Approx. (OE/ME) : {{:d}}  ({{:.1f}}% of classified lean on the Germanic approximation)', CAST(a AS BIGINT), round_even(coalesce(a * 100.0 / nullif(r, 0), 0), 1)), '', 'Origin breakdown (of classified words):']) AS line FROM c
UNION ALL SELECT lang, CAST(5 + row_number() OVER (PARTITION BY lang ORDER BY place, bucket) AS INT), '  ' || rpad(bucket, CAST(greatest(16, length(bucket)) AS INT), ' ') || ' ' || format('{{:5.1f}}', round_even(pct_resolved, 1)) || '%  ' || repeat('#', CAST(round_even(pct_resolved / 2, 0) AS INT)) FROM s WHERE bucket <> 'Unknown'""")
def text_report(spark, sf):
    """The report on the documents of each language, line by line."""
    r = shares.resolved_tokens(cut(shares.token_counts(table(spark, sf, "documents"), ["lang"])), cut(lexicon_known(spark, sf)))
    return shares.report(shares.shares(r, ["lang"]).withColumn("pct_resolved", F.round("pct_resolved", 6)), shares.coverage(r, ["lang"]), "lang")


@query("""WITH k AS (SELECT headword AS k, min(word_id) AS v FROM word WHERE headword IS NOT NULL GROUP BY 1), a AS (SELECT DISTINCT trim(headword) AS word FROM documents WHERE headword <> '' UNION SELECT DISTINCT lower(trim(headword)) FROM word WHERE headword <> ''),
t AS (SELECT word, unnest([0, 1, 2]) AS i, unnest([lower(word), word, upper(word[1]) || lower(word[2:])]) AS k FROM a), b AS (SELECT word, arg_min(v, i) AS v, min(i) AS i FROM t JOIN k USING (k) GROUP BY 1)
SELECT a.word, b.v AS value, coalesce(b.i = 2, false) AS case_fallback FROM a LEFT JOIN b ON b.word = a.word""")
def case_fallback_lookup(spark, sf):
    """Headwords of documents and lower-case headwords of words, looked up in lower case, as typed, and with a capital."""
    d, w = table(spark, sf, "documents"), table(spark, sf, "word")
    asked = d.select("headword").unionByName(w.where("headword <> ''").select(F.lower(F.trim("headword")).alias("headword")))
    return notes.cased_lookup(asked, "headword", w.where("headword IS NOT NULL"), "headword", "word_id")


@query("""SELECT lang_code, coalesce(b, 'Unknown') AS bucket, count(*) AS nodes FROM descendant_node LEFT JOIN (SELECT wikt_code, min(bucket) AS b FROM languages WHERE wikt_code IS NOT NULL GROUP BY 1) l ON wikt_code = lang_code GROUP BY ALL""")
def bucket_by_code(spark, sf):
    n = table(spark, sf, "descendant_node").groupBy("lang_code").agg(F.count(F.lit(1)).alias("nodes"))
    return classify.code_bucket(n, "lang_code", table(spark, sf, "languages")).select("lang_code", "bucket", "nodes")


@query("""SELECT name, bucket, era_certain, is_proto FROM languages UNION ALL SELECT DISTINCT root, 'Other', 0, CAST(root LIKE 'Proto-%' AS INT) FROM compare_new WHERE root IS NOT NULL AND root NOT IN (SELECT name FROM languages)""")
def languages_with_unlisted(spark, sf):
    return classify.with_unlisted(table(spark, sf, "languages"), table(spark, sf, "compare_new"), "root")


@query("""SELECT lower(trim(kind)) AS kind, count(*) AS sources, sum(coalesce(additive_only, 0)) AS additive FROM sources GROUP BY 1""")
def sources_by_kind(spark, sf):
    return table(spark, sf, "sources").groupBy(F.lower(F.trim("kind")).alias("kind")).agg(F.count(F.lit(1)).alias("sources"), F.sum(F.coalesce("additive_only", F.lit(0))).alias("additive"))
