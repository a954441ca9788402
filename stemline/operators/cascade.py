"""From a typed word to the form whose record answers for it: itself, another form of it, or its parts."""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stemline.session import cut

DEPTH = 4


def flattened_splits(splits: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``word, parts``: splits (``word, place, part``) with parts that are split themselves replaced by theirs, at most ``depth`` times; a word never stands in itself."""
    s = splits.select("word", "place", "part").where("word IS NOT NULL AND part IS NOT NULL")
    inner = s.select(F.col("word").alias("w"), F.col("place").alias("p"), F.col("part").alias("q"))
    current = s.select("word", F.array("place").alias("at"), "part", F.array("word").alias("above"))
    for _ in range(depth):
        j = current.join(inner, (F.col("part") == F.col("w")) & ~F.array_contains("above", F.col("part")), "left")
        deeper = F.col("w").isNotNull()
        current = cut(
            j.select(
                "word",
                F.when(deeper, F.concat("at", F.array("p"))).otherwise(F.col("at")).alias("at"),
                F.when(deeper, F.col("q")).otherwise(F.col("part")).alias("part"),
                F.when(deeper, F.concat("above", F.array("part"))).otherwise(F.col("above")).alias("above"),
                deeper.alias("moved"),
            )
        )
        if not current.where("moved").take(1):
            break
        current = current.drop("moved")
    rows = current.groupBy("word").agg(F.array_sort(F.collect_list(F.struct("at", "part"))).alias("p"))
    return rows.select("word", F.transform("p", lambda x: x["part"]).alias("parts"))


def merged_splits(*tables: DataFrame) -> DataFrame:
    """``word, parts`` of several tables; of a word in several the first table's counts."""
    rows = [t.select("word", "parts", F.lit(k).alias("__k")) for k, t in enumerate(tables)]
    return reduce(DataFrame.unionByName, rows).where("word IS NOT NULL").groupBy("word").agg(F.min_by("parts", "__k").alias("parts"))


def answered(words: DataFrame, word: str, records: DataFrame, candidates: Column, splits: DataFrame) -> DataFrame:
    """``word, via, forms``: which forms' records answer for each word.

    ``records``: ``form, trusted, usable``. A trusted record of its own answers; else the first candidate form with a usable
    record; else its own usable record; else its parts (``word, parts``) if each has a usable record; else any record of its
    own; else nothing (``none``). Null words are left out, repeated words come out once.
    """
    r = records.groupBy("form").agg(F.max("trusted").alias("trusted"), F.max("usable").alias("usable"))
    asked = words.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct()
    own = asked.join(r.withColumnRenamed("form", "f0").withColumnRenamed("trusted", "t0").withColumnRenamed("usable", "u0"), F.col("word") == F.col("f0"), "left")
    tries = asked.select("word", F.posexplode(candidates).alias("place", "form")).join(r.where("usable").select("form"), "form")
    other = tries.groupBy("word").agg(F.min_by("form", "place").alias("other"))
    good = r.where("usable").select(F.col("form").alias("part"), F.lit(True).alias("ok"))
    p = splits.join(asked, "word", "left_semi").select("word", "parts", F.explode("parts").alias("part")).join(good, "part", "left")
    whole = p.groupBy("word").agg(F.bool_and(F.coalesce("ok", F.lit(False))).alias("all"), F.any_value("parts").alias("parts")).where("all").select("word", "parts")
    j = own.join(other, "word", "left").join(whole, "word", "left")
    me = F.array("word")
    steps = [
        (F.coalesce("t0", F.lit(False)), "own", me),
        (F.col("other").isNotNull(), "form", F.array("other")),
        (F.coalesce("u0", F.lit(False)), "own", me),
        (F.col("parts").isNotNull(), "parts", F.col("parts")),
        (F.col("f0").isNotNull(), "own", me),
    ]
    via, forms = F.lit("none"), F.array().cast("array<string>")
    for hit, name, value in reversed(steps):
        via, forms = F.when(hit, F.lit(name)).otherwise(via), F.when(hit, value).otherwise(forms)
    return j.select("word", via.alias("via"), forms.alias("forms"))
