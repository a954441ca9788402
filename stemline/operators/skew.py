"""Per-key results where a few keys hold most rows (problem 3): value-frequency compression.

Rows are first counted per (key, value), which combines before the shuffle and spreads a hot key over its values; exact
sums, distinct counts, modes and percentiles then come from the weighted values.  Percentiles find the band of values
that holds the rank (bands follow the logarithm of the value and are combined before the shuffle), split it until it holds
few distinct values, and only then put those in order.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stemline.session import cut


def value_frequencies(df: DataFrame, key: str, value: str) -> DataFrame:
    """``k, v, w``: how often each value (null included) occurs with each key (null included)."""
    return df.select(F.col(key).alias("k"), F.col(value).alias("v")).groupBy("k", "v").agg(F.count(F.lit(1)).alias("w"))


#: A band of at most so many distinct values is put in order; a larger one is split first.
ORDERED = 10_000
_PARTS = 256


def _band(v: Column) -> Column:
    """A number that never falls as the value rises: 64 bands for each doubling of the magnitude, however small or large that is."""
    x = v.cast("double")
    size = F.floor(F.log2(F.when((x != 0) & (F.abs(x) < float("inf")), F.abs(x)).otherwise(F.lit(1.0))) * 64) + 70_000
    band = F.when(x == 0, 0).when(x == float("inf"), 1 << 20).when(x == -float("inf"), -(1 << 20)).otherwise(F.signum(x) * size)
    return F.when(F.isnan(x), (1 << 20) + 1).otherwise(band).cast("int")


def key_stats(df: DataFrame, key: str, value: str, percentiles: dict[str, float] | None = None, ordered: int = ORDERED) -> DataFrame:
    """Per key: ``n`` rows, ``total``, ``mean``, ``highest``, ``distinct_values``, ``mode`` of a numeric value, and percentiles.

    ``percentiles`` maps column names to ranks in (0, 1]: the smallest value with at least that share of the key's
    values at or below it.  Defined cases: null keys are one key; null values count in ``n`` only; a key without values
    has nulls and 0 distinct; ties of the mode go to the smallest value; an empty table gives no rows.
    """
    percentiles = percentiles or {}
    f = cut(value_frequencies(df, key, value))  # the rows are read once; all that follows reads the counts
    best = F.struct(F.col("w").alias("w"), (-F.col("v")).alias("low"))
    there = F.col("v").isNotNull()
    # (key, band) rows: sums of sums, so a key's distinct values are never together in one task
    bands = f.groupBy("k", _band(F.col("v")).alias("band")).agg(
        F.sum("w").alias("w"),
        F.sum(F.when(there, F.col("w"))).alias("nv"),
        F.sum(F.col("v").cast("decimal(19,0)") * F.col("w") if dict(df.dtypes)[value] in ("int", "bigint", "smallint", "tinyint") else F.col("v") * F.col("w")).alias("s"),
        F.min("v").alias("lo"),
        F.max("v").alias("hi"),
        F.count("v").alias("d"),
        F.max(F.when(there, best)).alias("m"),
    )
    stats = bands.groupBy("k").agg(
        F.sum("w").alias("n"),
        F.sum("s").alias("total"),
        F.sum("nv").alias("nv"),
        F.max("hi").alias("highest"),
        F.sum("d").alias("distinct_values"),
        F.max("m").alias("m"),
    )
    kind = "bigint" if dict(df.dtypes)[value] in ("int", "bigint", "smallint", "tinyint") else "double"
    out = stats.select(
        F.col("k").alias(key),
        "n",
        F.col("total").cast(kind).alias("total"),
        (F.col("total").cast("double") / F.col("nv")).alias("mean"),
        "highest",
        "distinct_values",
        (-F.col("m.low")).cast(dict(df.dtypes)[value]).alias("mode"),
    )
    if not percentiles:
        return out
    p = _percentiles(f, bands, percentiles, ordered)
    return out.join(p, F.col(key).eqNullSafe(F.col("__k")), "left").drop("__k")


def _percentiles(f: DataFrame, bands: DataFrame, percentiles: dict[str, float], ordered: int = ORDERED) -> DataFrame:
    """``__k`` and a column a percentile: the band that holds each rank, split while it has more than ``ordered`` values, then the order of the values in it."""
    b = bands.where(F.col("band").isNotNull()).select("k", "band", "nv", "lo", "hi", "d")
    b = b.withColumn("below", F.sum("nv").over(Window.partitionBy("k").orderBy("band")) - F.col("nv")).withColumn("all", F.sum("nv").over(Window.partitionBy("k")))
    ranks = F.array(*[F.struct(F.lit(n).alias("name"), F.greatest(F.lit(1), F.ceil(F.col("all") * F.lit(share))).cast("long").alias("rank")) for n, share in percentiles.items()])
    held = lambda rows: F.filter(rows, lambda r: (F.col("below") < r["rank"]) & (r["rank"] <= F.col("below") + F.col("nv")))
    # a row an interval of values: what lies below it, how many it holds, and the ranks in it
    spans = cut(b.select("k", "lo", "hi", "d", "below", held(ranks).alias("ranks")).where(F.size("ranks") > 0))
    values = f.where(F.col("v").isNotNull()).select("k", "v", "w")
    within = F.col("k").eqNullSafe(F.col("k2")) & F.col("v").between(F.col("lo"), F.col("hi"))
    renamed = lambda s: s.withColumnRenamed("k", "k2")
    while True:
        wide = (F.col("d") > ordered) & (F.col("lo") < F.col("hi"))
        if not spans.where(wide).take(1):
            break
        # equal parts of the interval; its first and last value are never in one part, so this ends
        place = (F.col("v").cast("double") - F.col("lo").cast("double")) / (F.col("hi").cast("double") - F.col("lo").cast("double"))
        inner = F.least(F.lit(_PARTS - 2), F.greatest(F.lit(0), F.floor(F.coalesce(F.nanvl(place, F.lit(0.0)), F.lit(0.0)) * (_PARTS - 1)))).cast("int")
        part = F.when(F.col("v") == F.col("lo"), -1).when(F.col("v") == F.col("hi"), _PARTS).otherwise(inner)
        j = values.join(renamed(spans.where(wide)), within)
        s = j.groupBy("k", "lo", part.alias("part")).agg(F.sum("w").alias("nv"), F.min("v").alias("lo2"), F.max("v").alias("hi"), F.count(F.lit(1)).alias("d"), F.first("below").alias("under"), F.first("ranks").alias("of"))
        s = s.withColumn("below", F.col("under") + F.sum("nv").over(Window.partitionBy("k", "lo").orderBy("part")) - F.col("nv"))
        s = s.select("k", F.col("lo2").alias("lo"), "hi", "d", "below", held(F.col("of")).alias("ranks")).where(F.size("ranks") > 0)
        spans = cut(spans.where(~wide).unionByName(s))
    j = values.join(renamed(spans), within)
    upto = F.sum("w").over(Window.partitionBy("k", "lo").orderBy("v")) + F.col("below")
    named = j.withColumn("upto", upto).select("k", "v", "w", "upto", F.explode("ranks").alias("r"))
    named = named.where((F.col("upto") >= F.col("r.rank")) & (F.col("upto") - F.col("w") < F.col("r.rank")))
    return named.groupBy(F.col("k").alias("__k")).agg(*[F.max(F.when(F.col("r.name") == n, F.col("v"))).alias(n) for n in percentiles])
