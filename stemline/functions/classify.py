"""Names, codes, stages and groups of languages as Columns and small joins."""

from __future__ import annotations

from itertools import chain as _flat

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: The groups in display order.
BUCKETS = (
    "Germanic", "Norse", "French", "Latin", "Greek", "Romance (other)", "Celtic", "Slavic", "Indo-Iranian", "Iranian", "Semitic", "Turkic",
    "East Asian", "Austronesian", "Indigenous American", "Caribbean", "Afro-Asiatic (other)", "African (other)", "PIE", "Other", "Unknown",
)
CORE = ("Germanic", "Norse", "French", "Latin", "Greek", "Romance (other)", "Celtic", "PIE")
UNINFORMATIVE = ("Other", "Unknown")
APPROXIMATE = ("Germanic",)
ENGLISH_STAGES = ("English", "Middle English", "Old English")
STAGE_QUALIFIERS = ("Northern", "Southern", "Eastern", "Western", "Midland", "Anglian", "Northumbrian", "Mercian", "Kentish", "West Saxon", "Early", "Late")
PIE_NAMES = ("Proto-Indo-European", "PIE")
DONOR_RELS = ("inherited", "borrowed", "derived", "formed_from")
NATIVE_RELS = ("inherited", "derived")
#: Templates by the relation they state; others that lead to an ancestor state that a word is derived.
INHERITING = ("inh", "uinh", "inh+")
DERIVING = ("der", "uder", "der+")
BORROWING = ("bor", "ubor", "bor+", "lbor", "slbor", "obor")
CALQUING = ("cal", "calque", "clq")
TEMPLATE_RELS = {
    **dict.fromkeys(INHERITING, "inherited"), **dict.fromkeys(DERIVING, "derived"), **dict.fromkeys(BORROWING, "borrowed"), **dict.fromkeys(CALQUING, "calque"), "root": "root",
}
#: Codes that are no single language, and what stands for a form that is not recorded.
NO_LANGUAGE = ("mul", "mul-tax")
PLACEHOLDERS = ("-", "")
#: The broad lineage of each group.
FAMILIES = {
    "Germanic": "germanic", "Norse": "germanic", "Latin": "italic", "French": "italic", "Romance (other)": "italic", "Greek": "hellenic", "Celtic": "celtic", "Slavic": "slavic",
    "Indo-Iranian": "indo-iranian", "Iranian": "indo-iranian", "Semitic": "semitic", "Turkic": "turkic", "East Asian": "east-asian", "Austronesian": "austronesian",
    "Indigenous American": "amerind", "Caribbean": "caribbean", "Afro-Asiatic (other)": "afro-asiatic", "African (other)": "african", "PIE": "pie",
}
#: Groups of the three-letter and older codes, for tables that name languages by them.
CODE_BUCKETS = {
    **dict.fromkeys(("ang", "enm", "eng", "gem", "gem-pro", "p_gem", "p_gmw", "gmw-pro", "deu", "goh", "gmh", "nld", "dum", "gml", "osx", "frk", "got"), "Germanic"),
    **dict.fromkeys(("non", "isl", "swe", "dan", "nor"), "Norse"),
    **dict.fromkeys(("lat", "la-vul", "la-med"), "Latin"),
    **dict.fromkeys(("fra", "fro", "frm", "xno"), "French"),
    **dict.fromkeys(("ita", "spa", "por", "ron", "cat", "oci", "roa-opt"), "Romance (other)"),
    **dict.fromkeys(("grc", "ell"), "Greek"),
    **dict.fromkeys(("fas", "pal", "peo"), "Iranian"),
    **dict.fromkeys(("cel", "gla", "gle", "cym", "bre"), "Celtic"),
    **dict.fromkeys(("ine", "ine-pro", "p_ine"), "PIE"),
}
#: Names of families and of codes that no registry of single languages has.
FAMILY_CODES = {
    "alg": "Algonquian", "alg-eas": "Eastern Algonquian", "trk-pro": "Proto-Turkic", "gmw-msc": "Middle Scots", "nan-tws": "Teochew", "trk": "Turkic", "cel-bry": "Brythonic",
    "azc-nah": "Nahuan", "sem": "Semitic", "roa": "Romance", "tup": "Tupian", "bnt": "Bantu", "dra": "Dravidian", "ira": "Iranian", "ath": "Athabaskan", "aav": "Austroasiatic",
    "iro": "Iroquoian", "sio": "Siouan", "mus": "Muskogean", "sla": "Slavic", "gem": "Germanic", "cel": "Celtic", "ine": "Indo-European", "itc": "Italic", "grk": "Hellenic",
    "inc": "Indo-Aryan", "iir": "Indo-Iranian", "urj": "Uralic", "map": "Austronesian", "nic": "Niger-Congo", "afa": "Afro-Asiatic", "cus": "Cushitic", "ber": "Berber",
    "tut": "Altaic", "khi": "Khoisan", "paa": "Papuan", "aus": "Australian", "nai": "Native American", "sai": "South American Indian", "cai": "Central American Indian",
    "crp": "Creole", "art": "Constructed",
}
#: Fixed value: how far back a language lies, English stages before any foreign one. Orders separate groups and diagrams; eras order steps.
DEPTH_HINT = {
    **dict.fromkeys(("Middle English", "English", "Scots"), 0),
    "Old English": 1,
    **dict.fromkeys(("French", "German", "Dutch", "Irish", "Modern Greek"), 10),
    **dict.fromkeys(("Middle French", "Middle High German", "Middle Low German", "Middle Dutch", "Middle Irish", "New Latin", "Byzantine Greek", "Medieval Greek"), 11),
    **dict.fromkeys(("Old French", "Anglo-Norman", "Norman", "Old Northern French", "Old Norse", "Old High German", "Old Saxon", "Old Dutch", "Old Frisian", "Old Irish", "Medieval Latin"), 12),
    **dict.fromkeys(("Late Latin", "Vulgar Latin", "Koine Greek"), 13),
    **dict.fromkeys(("Latin", "Ancient Greek"), 14),
    **dict.fromkeys(("Proto-West Germanic", "Proto-Italic", "Proto-Celtic", "Proto-Slavic", "Sanskrit"), 15),
    "Proto-Germanic": 16,
    "Proto-Indo-European": 18,
}
NO_HINT = 10


def lookup(mapping: dict, key: Column, default=None) -> Column:
    """A small fixed map as an expression."""
    m = F.create_map(*[F.lit(x) for x in _flat.from_iterable(mapping.items())])
    found = F.try_element_at(m, key)
    return found if default is None else F.coalesce(found, F.lit(default))


def bucket_order(bucket: Column) -> Column:
    """Place in the display order; others last."""
    at = F.array_position(F.array(*[F.lit(b) for b in BUCKETS]), bucket)
    return F.when(at > 0, at).otherwise(999)


def family_of(bucket: Column) -> Column:
    """The broad lineage of a group; null for those that have none."""
    return lookup(FAMILIES, bucket)


def bucket_of_code(code: Column) -> Column:
    """The group of a fixed code; a code that is not listed is unknown, not other."""
    return lookup(CODE_BUCKETS, code, "Unknown")


def depth_hint(name: Column) -> Column:
    """How far back a language lies; what is not listed lies among the foreign ones nearest to the present."""
    return lookup(DEPTH_HINT, name, NO_HINT)


def is_english_stage(name: Column) -> Column:
    """A stage of English itself, with at most one dialect's name before it; not a language named after English."""
    stages = "|".join(sorted(ENGLISH_STAGES, key=len, reverse=True))
    return F.coalesce(F.rlike(name, F.lit(f"^(({'|'.join(STAGE_QUALIFIERS)}) )?({stages})$")), F.lit(False))


def is_pie(name: Column) -> Column:
    return F.coalesce(name.isin(*PIE_NAMES), F.lit(False))


def is_proto(name: Column) -> Column:
    return F.coalesce(F.startswith(name, F.lit("Proto-")), F.lit(False)) | is_pie(name)


def parents_of(name: Column) -> Column:
    """A name and the names left as its words go one by one from the front: the order in which its group is looked up."""
    w = F.split(name, " ")
    return F.transform(F.sequence(F.lit(1), F.size(w)), lambda i: F.array_join(F.slice(w, i, F.size(w)), " "))


def with_bucket(df: DataFrame, name: str, languages: DataFrame, default: str = "Other", out: str = "bucket") -> DataFrame:
    """The group of a language's name, or of its longest parent in the list, else ``default``. The list is a small dimension."""
    names = languages.where(F.col("name").isNotNull() & F.col("bucket").isNotNull()).groupBy(F.col("name").alias("__n")).agg(F.min("bucket").alias("__b"))
    distinct = df.select(F.col(name).alias("__k")).where(F.col(name).isNotNull()).distinct()
    c = distinct.select("__k", F.posexplode(parents_of(F.col("__k"))).alias("__i", "__n")).join(names, "__n")
    best = c.groupBy("__k").agg(F.min_by("__b", "__i").alias("__b"))
    return df.join(best, df[name] == best["__k"], "left").withColumn(out, F.coalesce("__b", F.lit(default))).drop("__k", "__b")


def display_name(df: DataFrame, code: str, languages: DataFrame, registry: DataFrame | None = None, out: str = "name") -> DataFrame:
    """Name of a code: curated, else registered (``code, name``), else the code itself."""
    cur = languages.where(F.col("wikt_code").isNotNull()).groupBy(F.col("wikt_code").alias("__c")).agg(F.min("name").alias("__n1"))
    d = df.join(cur, df[code] == cur["__c"], "left").drop("__c")
    names = [F.col("__n1")]
    if registry is not None:
        reg = registry.groupBy(F.col("code").alias("__c")).agg(F.min("name").alias("__n2"))
        d = d.join(reg, d[code] == reg["__c"], "left").drop("__c")
        names.append(F.col("__n2"))
    return d.withColumn(out, F.coalesce(*names, F.col(code))).drop("__n1", "__n2")


def resolved_names(df: DataFrame, column: str, registry: DataFrame, out: str = "name") -> DataFrame:
    """What a column of names and codes means: the name of a family code, else the registered name (``code, name``), else the value itself."""
    reg = registry.where("code IS NOT NULL AND name IS NOT NULL").groupBy(F.trim("code").alias("__c")).agg(F.min("name").alias("__n"))
    key = F.trim(F.col(column))
    return df.join(reg, key == F.col("__c"), "left").withColumn(out, F.coalesce(lookup(FAMILY_CODES, key), F.col("__n"), F.col(column))).drop("__c", "__n")


def find_language(df: DataFrame, key: str, languages: DataFrame, out: str = "lang_id") -> DataFrame:
    """By code first, then by name without case."""
    by_code = languages.where(F.col("wikt_code").isNotNull()).groupBy(F.col("wikt_code").alias("__c")).agg(F.min("lang_id").alias("__i1"))
    by_name = languages.groupBy(F.lower("name").alias("__m")).agg(F.min("lang_id").alias("__i2"))
    d = df.join(by_code, df[key] == by_code["__c"], "left").join(by_name, F.lower(df[key]) == by_name["__m"], "left")
    return d.withColumn(out, F.coalesce("__i1", "__i2")).drop("__c", "__m", "__i1", "__i2")


def contemporaries(languages: DataFrame) -> DataFrame:
    """Pairs of languages whose times overlap: equal centuries are joined, then the ranges compared (each pair once)."""
    l = languages.where(F.col("era_start").isNotNull() & F.col("era_end").isNotNull()).select("lang_id", "name", "family", "era_start", "era_end")
    end = F.least(F.col("era_end"), F.lit(2100))
    spans = l.select("*", F.explode(F.sequence(F.floor(F.col("era_start") / 100), F.greatest(F.floor(F.col("era_start") / 100), F.floor(end / 100)))).alias("century"))
    a, b = spans.alias("a"), spans.alias("b")
    overlap = (F.col("a.era_start") <= F.col("b.era_end")) & (F.col("b.era_start") <= F.col("a.era_end")) & (F.col("a.lang_id") < F.col("b.lang_id"))
    return a.join(b, (F.col("a.century") == F.col("b.century")) & overlap).select(
        F.col("a.name").alias("name_a"), F.col("b.name").alias("name_b"), F.coalesce(F.col("a.family") == F.col("b.family"), F.lit(False)).alias("same_family")
    ).distinct()


def slug(name: Column) -> Column:
    """Lower case, other signs to single hyphens."""
    return F.regexp_replace(F.regexp_replace(F.lower(name), "[^a-z0-9]+", "-"), "^-|-$", "")


def shades(languages: DataFrame) -> DataFrame:
    """A lightness step for each language of a group, by sorted name, spread evenly from 35 to 75 percent."""
    from pyspark.sql import Window

    w = Window.partitionBy("bucket").orderBy("name")
    n = F.count(F.lit(1)).over(Window.partitionBy("bucket"))
    step = F.when(n > 1, (F.row_number().over(w) - 1) / (n - 1)).otherwise(F.lit(0.5))
    return languages.where(F.col("bucket").isNotNull()).select("bucket", "name", F.round(35 + 40 * step, 4).alias("lightness"))


def code_bucket(df: DataFrame, code: str, languages: DataFrame, default: str = "Unknown", out: str = "bucket") -> DataFrame:
    """The group of a code; codes that are not listed are ``default``."""
    known = languages.where("wikt_code IS NOT NULL").groupBy(F.col("wikt_code").alias("__c")).agg(F.min("bucket").alias("__b"))
    return df.join(known, df[code] == F.col("__c"), "left").withColumn(out, F.coalesce("__b", F.lit(default))).drop("__c", "__b")


def with_unlisted(languages: DataFrame, used: DataFrame, name: str) -> DataFrame:
    """The list and, flagged as uncertain, every used name that it lacks, so that nothing is dropped for want of a row."""
    more = used.select(F.col(name).alias("name")).where("name IS NOT NULL").distinct().join(languages.select("name"), "name", "left_anti")
    more = more.select("name", F.lit("Other").alias("bucket"), F.lit(0).alias("era_certain"), F.startswith("name", F.lit("Proto-")).cast("int").alias("is_proto"))
    return languages.select("name", "bucket", "era_certain", "is_proto").unionByName(more)
