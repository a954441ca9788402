"""Readers: dictionary dumps in JSON lines, relation tables, language lists, code registries, JSON maps and text corpora."""

from __future__ import annotations

import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame, SparkSession, Window

ENTRY = (
    "lang string, word string, pos string, etymology_number string, etymology_text string, "
    "etymology_templates array<struct<name:string,args:map<string,string>>>, senses array<struct<glosses:array<string>>>, "
    "forms array<struct<form:string,tags:array<string>>>, translations array<struct<lang:string,lang_code:string,code:string>>, "
    "derived array<struct<word:string,lang:string,sense:string>>, related array<struct<word:string,lang:string,sense:string>>, "
    "synonyms array<struct<word:string,lang:string,sense:string>>, antonyms array<struct<word:string,lang:string,sense:string>>, "
    "hyponyms array<struct<word:string,lang:string,sense:string>>, hypernyms array<struct<word:string,lang:string,sense:string>>, "
    "meronyms array<struct<word:string,lang:string,sense:string>>, holonyms array<struct<word:string,lang:string,sense:string>>, "
    "coordinate_terms array<struct<word:string,lang:string,sense:string>>"
)
RELATION = "term_id string, lang string, term string, reltype string, related_lang string, related_term string, position int, group_tag string, parent_tag string, parent_position double"
LANGUAGE = "name string, wikt_code string, bucket string, family string, era_start int, era_end int, era_label string, era_certain int, is_proto int, is_english_stage int, source string"
#: The entry's lists of other words and the kind of relation each states.
RELATION_FIELDS = {
    "derived": "derived_term", "related": "related_term", "synonyms": "synonym", "antonyms": "antonym", "hyponyms": "hyponym",
    "hypernyms": "hypernym", "meronyms": "meronym", "holonyms": "holonym", "coordinate_terms": "coordinate",
}
GLOSS_MOST = 200


def numbered_lines(spark: SparkSession, path: str) -> DataFrame:
    """``file, line, value``: every line with its number in its file, from 1, however the file is cut into tasks."""
    rows = spark.read.text(path).select(F.col("_metadata.file_path").alias("file"), F.col("_metadata.file_block_start").alias("block"), F.monotonically_increasing_id().alias("id"), "value")
    # ids rise without gaps within a block of a file; a row a block tells how many lines lie before it
    blocks = rows.groupBy("file", "block").agg(F.min("id").alias("first"), F.count(F.lit(1)).alias("n"))
    before = blocks.select("file", "block", "first", (F.sum("n").over(Window.partitionBy("file").orderBy("block")) - F.col("n")).alias("before"))
    return rows.join(before, ["file", "block"]).select("file", (F.col("id") - F.col("first") + F.col("before") + 1).alias("line"), "value")


def read_entries(spark: SparkSession, path: str, lang: str = "English", limit: int | None = None) -> DataFrame:
    """``file, line, at, entry`` of the usable lines: JSON, of the language, with a headword. ``line`` is the line's number in its file, ``at`` file and line, the order of the dump.

    Texts are read through a variant first, so a field of an odd type spoils that field only, not its line.
    """
    lines = numbered_lines(spark, path)
    v = lines.where(F.trim("value") != "").withColumn("v", F.try_parse_json("value"))
    v = v.where(F.col("v").isNotNull())
    ok = v.withColumn("e_lang", F.try_variant_get("v", "$.lang", "string")).withColumn("e_word", F.try_variant_get("v", "$.word", "string"))
    ok = ok.where((F.col("e_lang") == lang) & (F.col("e_word") != ""))
    out = ok.select("file", "line", F.struct("file", "line").alias("at"), F.from_json("value", ENTRY).alias("entry"))
    return out.orderBy("file", "line").limit(limit) if limit is not None else out


def grouped_entries(entries: DataFrame) -> DataFrame:
    """One row per word and etymology number: templates in order with repeated lists once, parts of speech, first rendered text."""
    e = entries.select("at", "entry.*").withColumn("num", F.coalesce(F.expr("try_cast(etymology_number as int)"), F.lit(1)))
    e = e.withColumn("num", F.when(F.col("num") == 0, 1).otherwise(F.col("num")))
    listed = F.transform("etymology_templates", lambda t: F.struct(t["name"].alias("name"), F.to_json(F.array_sort(F.map_entries(t["args"]))).alias("args")))
    e = e.withColumn("sig", F.sha2(F.coalesce(F.to_json(listed), F.lit("")), 256))
    lists = e.groupBy("word", "num", "sig").agg(F.min("at").alias("at"), F.min_by("etymology_templates", "at").alias("x"))
    templates = _ordered_templates(lists)
    facts = e.groupBy("word", "num").agg(
        F.array_join(F.sort_array(F.collect_set("pos")), ",").alias("pos"),
        F.min_by("etymology_text", F.when(F.startswith("etymology_text", F.lit("Etymology tree")), F.col("at"))).alias("text"),
    )
    return templates.join(facts, ["word", "num"])


def _ordered_templates(lists: DataFrame) -> DataFrame:
    # maps cannot be ordered, so lists are put in order by their line through a window, not by sorting structs
    w = Window.partitionBy("word", "num").orderBy("at").rowsBetween(Window.unboundedPreceding, Window.unboundedFollowing)
    t = lists.drop("sig")
    t = t.withColumn("all", F.collect_list(F.coalesce("x", F.array().cast(t.schema["x"].dataType))).over(w)).withColumn("r", F.row_number().over(Window.partitionBy("word", "num").orderBy("at")))
    return t.where("r = 1").select("word", "num", F.flatten("all").alias("templates"))


def senses(entries: DataFrame, most: int = 3) -> DataFrame:
    """``word, ordinal, pos, gloss``: the first gloss of a word's first entries that have one, cut to length."""
    e = entries.select("at", "entry.word", "entry.pos", F.expr("filter(entry.senses, s -> element_at(s.glosses, 1) is not null)").alias("s"))
    e = e.where(F.size("s") > 0).select("at", "word", "pos", F.substring(F.get(F.get("s", F.lit(0))["glosses"], F.lit(0)), 1, GLOSS_MOST).alias("gloss"))
    return e.withColumn("ordinal", F.row_number().over(Window.partitionBy("word").orderBy("at")) - 1).where(F.col("ordinal") < most).drop("at")


def relations(entries: DataFrame) -> DataFrame:
    """``word, kind, other, lang, sense`` of all lists of other words."""

    def listed(field: str, kind: str):
        rows = F.coalesce(F.col(f"entry.{field}"), F.array().cast("array<struct<word:string,lang:string,sense:string>>"))
        return F.transform(rows, lambda r: F.struct(F.lit(kind).alias("kind"), r["word"].alias("other"), r["lang"].alias("lang"), r["sense"].alias("sense")))

    parts = [listed(f, k) for f, k in RELATION_FIELDS.items()]
    r = entries.select("entry.word", F.explode(F.concat(*parts)).alias("r")).where(F.col("r.other") != "")
    return r.select("word", "r.*")


#: Tags that name a real inflection, and what only serves the layout of inflection tables.
INFLECTION_TAGS = ("past", "participle", "plural", "comparative", "superlative")
SCAFFOLD_TAGS = ("table-tags", "inflection-template")
SCAFFOLD_FORMS = ("no-table-tags", "table-tags", "inflection-template", "glossary")


def inflections(entries: DataFrame, tags: tuple[str, ...] = INFLECTION_TAGS) -> DataFrame:
    """``form, base``: inflected forms in lower case with the word as spelled; the first in file order wins, forms equal to their word in all but case are none."""
    f = entries.select("at", F.col("entry.word").alias("base"), F.posexplode("entry.forms").alias("i", "f"))
    listed = lambda names: F.arrays_overlap("f.tags", F.array(*[F.lit(t) for t in names]))
    f = f.where(listed(tags) & ~listed(SCAFFOLD_TAGS) & (F.col("f.form") != "") & ~F.col("f.form").isin(*SCAFFOLD_FORMS))
    f = f.select(F.lower("f.form").alias("form"), "base", "at", "i").where(F.col("form") != F.lower("base"))
    return f.groupBy("form").agg(F.min_by("base", F.struct("at", "i")).alias("base"))


def harvested_names(entries: DataFrame) -> DataFrame:
    """``code, name`` of the languages that translations name; the first wins."""
    t = entries.select("at", F.posexplode("entry.translations").alias("i", "t")).select("at", "i", F.coalesce("t.lang_code", "t.code").alias("code"), F.col("t.lang").alias("name"))
    return t.where("code IS NOT NULL AND name IS NOT NULL").groupBy("code").agg(F.min_by("name", F.struct("at", "i")).alias("name"))


def read_descendants(spark: SparkSession, path: str, source: str) -> DataFrame:
    """Dump lines with nested descendants as JSON trees for ``flatten_json_trees``: ``word_id, tree_json``, children under ``children``."""
    lines = spark.read.text(path).where(F.trim("value") != "").withColumn("v", F.try_parse_json("value")).where("v IS NOT NULL")
    word = F.try_variant_get("v", "$.word", "string")
    renamed = F.regexp_replace(F.regexp_replace("value", r'"descendants"\s*:', '"children":'), r'"word"\s*:', '"term":')
    return lines.where(F.col("v").isNotNull() & word.isNotNull()).select(F.xxhash64("value").alias("word_id"), renamed.alias("tree_json"), F.lit(source).alias("source"))


def read_relations(spark: SparkSession, path: str, lang: str = "English", term: str | None = None) -> DataFrame:
    """Relation rows of one language, or of one term of it; the filters and the columns reach the scan."""
    rows = spark.read.schema(RELATION).parquet(path).where(F.col("lang") == lang)
    return rows if term is None else rows.where(F.col("term") == term)


def read_languages(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(LANGUAGE).csv(path, header=True).where("name IS NOT NULL AND name <> ''")


def exists(spark: SparkSession, path: str) -> bool:
    p = spark._jvm.org.apache.hadoop.fs.Path(path)
    return p.getFileSystem(spark._jsc.hadoopConfiguration()).exists(p)


def read_registry(spark: SparkSession, path: str) -> DataFrame:
    """``code, name`` of a CSV with or without a byte order mark; an absent file has no rows."""
    if not exists(spark, path):
        return spark.createDataFrame([], "code string, name string")
    r = spark.read.option("header", True).csv(path)
    first, second = r.columns[:2]
    return r.select(F.regexp_replace(F.col(f"`{first}`"), "﻿", "").alias("code"), F.col(f"`{second}`").alias("name")).where("code IS NOT NULL")


def read_json_map(spark: SparkSession, path: str, value: str = "string") -> DataFrame:
    """``key, value`` of a JSON object; an absent or unreadable file has no rows."""
    empty = spark.createDataFrame([], T.StructType([T.StructField("key", T.StringType()), T.StructField("value", T._parse_datatype_string(value))]))
    if not exists(spark, path):
        return empty
    m = spark.read.text(path, wholetext=True).select(F.from_json("value", f"map<string,{value}>").alias("m"))
    return m.where("m IS NOT NULL").select(F.explode("m").alias("key", "value"))


def read_corpus(spark: SparkSession, path: str, field: str = "text") -> DataFrame:
    """``part, text``: items of a JSON ``{"data": [{field}]}``, or paragraphs of a text split at blank lines."""
    whole = spark.read.text(path, wholetext=True)
    items = F.from_json("value", f"data array<struct<`{field}`:string>>")
    parts = F.coalesce(F.transform(items["data"], lambda s: s[field]), F.split(F.regexp_replace("value", r"\r\n?", "\n"), r"\n\s*\n"))
    return whole.select(F.posexplode(parts).alias("part", "text")).where(F.trim("text") != "")
