"""Filling containers of a fixed capacity (problem 9): bound-certified repacking.

Items are packed best-fit decreasing, a partition at a time.  Dual feasible functions give a lower bound for each
partition's bins and for the whole; partitions above their bound exchange their documents, the others give up their
emptiest bin, and what was given up is packed again, for as long as a round saves bins worth it and the whole is above
its bound.
"""

from __future__ import annotations

import numpy as np
import pandas as pd
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stemline.llm import bpe
from stemline.session import cut, partitions_for

CAPACITY = 2048
ITEMS_PER_PARTITION = 30_000
#: A round must save so much of what is still above the bound for another to follow.
LEAST_GAIN = 0.05


def best_fit_decreasing(size: np.ndarray, capacity: int) -> np.ndarray:
    """The bin number of every item; the fullest bin that still takes it, else a new one."""
    out = np.empty(len(size), np.int64)
    open_: list[list[int]] = [[] for _ in range(capacity + 1)]
    gaps, bins = 0, 0
    for i in np.argsort(-size, kind="stable").tolist():
        s = int(size[i])
        fits = gaps >> s
        if fits:
            gap = s + ((fits & -fits).bit_length() - 1)
            b = open_[gap].pop()
            if not open_[gap]:
                gaps ^= 1 << gap
        else:
            b, gap, bins = bins, capacity, bins + 1
        out[i] = b
        left = gap - s
        if not open_[left]:
            gaps |= 1 << left
        open_[left].append(b)
    return out


def lower_bound(histogram: np.ndarray, capacity: int) -> int:
    """Least number of bins by two families of dual feasible functions; ``histogram[s]`` counts the items of size s."""
    sizes = np.arange(capacity + 1)
    total = histogram * sizes
    below = np.concatenate([[0], np.cumsum(total)])
    many = np.concatenate([[0], np.cumsum(histogram)])
    low = np.arange(capacity // 2 + 1)
    # sizes above capacity - low count whole, those below low not at all
    first = (many[-1] - many[capacity - low + 1]) * capacity + below[capacity - low + 1] - below[low]
    best = int(-(-first.max() // capacity))
    for k in range(1, 21):
        x = sizes * (k + 1)
        u = np.where(x % capacity == 0, sizes * k, (x // capacity) * capacity)
        best = max(best, int(-(-int((histogram * u).sum()) // (k * capacity))))
    return max(best, int(many[-1] > 0))


def items_of(counts: DataFrame, capacity: int, id_col: str = "doc_id") -> DataFrame:
    """``id_col, piece, size``: an item each, cut into pieces only where it alone exceeds the capacity."""
    n = F.col("n_tokens")
    pieces = F.greatest(F.lit(1), F.ceil(n / capacity)).cast("int")
    rows = counts.select(id_col, n, F.explode(F.sequence(F.lit(1), pieces)).alias("piece"))
    return rows.select(id_col, "piece", F.least(F.lit(capacity), n - (F.col("piece") - 1) * capacity).cast("int").alias("size"))


def _packed(items: DataFrame, parts: int, seed: int, capacity: int, id_col: str) -> DataFrame:
    kind = items.schema[id_col].dataType.simpleString()

    def pack(pdf: pd.DataFrame) -> pd.DataFrame:
        pdf = pdf.sort_values(["size", id_col, "piece"], ascending=[False, True, True], kind="stable")
        size = pdf["size"].to_numpy(np.int64)
        bins = best_fit_decreasing(size, capacity)
        fill = np.bincount(bins, weights=size)
        used = len(fill)
        bound = lower_bound(np.bincount(size, minlength=capacity + 1), capacity)
        loosest = int(np.argmin(fill))
        return pd.DataFrame({id_col: pdf[id_col], "piece": pdf["piece"], "size": pdf["size"], "part": pdf["part"], "bin": bins, "bins": used, "bound": bound, "loose": bins == loosest})

    part = F.pmod(F.xxhash64(F.lit(seed), id_col, "piece"), F.lit(parts)).alias("part")
    schema = f"{id_col} {kind}, piece int, size int, part long, bin long, bins long, bound long, loose boolean"
    return items.select(id_col, "piece", "size", part).groupBy("part").applyInPandas(pack, schema)


def pack(items: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id", per_partition: int = ITEMS_PER_PARTITION, least_gain: float = LEAST_GAIN) -> DataFrame:
    """``id_col, piece, size, container``: every item in one container, none above the capacity.

    Rounds of repacking go on until the whole is at its bound, a round saves nothing, or it saves less than ``least_gain`` of
    the containers above the bound (0: as long as one is saved).

    Defined cases: items of size 0 (null or empty texts) are placed like any other; null sizes must be 0 already; rows
    repeating an item are items of their own; ties of size go by id; an empty table gives no rows.
    """
    spark = items.sparkSession
    items = cut(items)
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("size").count().collect():  # at most capacity + 1 rows, whatever the data
        histogram[r["size"]] = r["count"]
    total = int(histogram.sum())
    least = lower_bound(histogram, capacity)
    kept: list[DataFrame] = []
    now = cut(_packed(items, partitions_for(spark, total, per_partition), 0, capacity, id_col))
    level, settled = 0, 0
    while True:
        # one row a partition: its bins and its bound
        loose = now.groupBy("part").agg(F.first("bins").alias("bins"), F.first("bound").alias("bound"), F.count(F.lit(1)).alias("n"), F.sum(F.col("loose").cast("long")).alias("k"))
        gap = F.col("bins") > F.col("bound")
        s = loose.agg(
            F.sum("bins").alias("bins"), F.count(F.lit(1)).alias("parts"), F.sum(F.when(gap, F.col("n")).otherwise(F.col("k"))).alias("given"), F.sum(F.when(gap, F.col("bins")).otherwise(1)).alias("freed")
        ).first()
        if not total or settled + s["bins"] <= least or s["parts"] <= 1:
            break
        give = (F.col("bins") > F.col("bound")) | F.col("loose")
        again = cut(_packed(now.where(give).select(id_col, "piece", "size"), max(1, -(-int(s["given"]) // per_partition)), level + 1, capacity, id_col))
        used = again.groupBy("part").agg(F.first("bins").alias("bins")).agg(F.sum("bins")).first()[0]
        if used >= s["freed"]:
            break
        kept.append(now.where(~give).withColumn("level", F.lit(level)))
        settled += int(s["bins"] - s["freed"])
        now, level = again, level + 1
        if int(s["freed"]) - used < least_gain * (settled + used - least):
            break
    out = now.withColumn("level", F.lit(level))
    for k in kept:
        out = out.unionByName(k)
    number = F.shiftleft(F.col("level").cast("long"), 56) + F.shiftleft(F.col("part"), 24) + F.col("bin")
    return out.select(id_col, "piece", "size", number.alias("container"))


def report(packed: DataFrame, items: DataFrame, capacity: int = CAPACITY, id_col: str = "doc_id") -> DataFrame:
    """One row on a packing: ``containers``, their ``bound``, ``overfull`` ones, and ``lost``, ``doubled`` and ``altered`` items; the last four are 0."""
    spark = packed.sparkSession
    histogram = np.zeros(capacity + 1, np.int64)
    for r in items.groupBy("size").count().collect():  # at most capacity + 1 rows
        histogram[r["size"]] = r["count"]
    bins = packed.groupBy("container").agg(F.sum("size").alias("fill")).agg(F.count(F.lit(1)).alias("containers"), F.coalesce(F.sum((F.col("fill") > capacity).cast("long")), F.lit(0)).alias("overfull"))
    key = [id_col, "piece", "size"]
    want, have = items.groupBy(*key).agg(F.count(F.lit(1)).alias("n")), packed.groupBy(*key).agg(F.count(F.lit(1)).alias("m"))
    j = want.join(have, key, "full").agg(
        F.coalesce(F.sum(F.greatest(F.col("n") - F.coalesce("m", F.lit(0)), F.lit(0))), F.lit(0)).alias("lost"),
        F.coalesce(F.sum(F.greatest(F.col("m") - F.col("n"), F.lit(0))), F.lit(0)).alias("doubled"),
        F.coalesce(F.sum(F.when(F.col("n").isNull(), F.col("m"))), F.lit(0)).alias("altered"),
    )
    bound = spark.range(1).select(F.lit(lower_bound(histogram, capacity)).cast("long").alias("bound"))
    one = F.lit(1)  # three rows of one table each, joined by a constant
    parts = [d.withColumn("__k", one) for d in (bins, bound, j)]
    return parts[0].join(parts[1], "__k").join(parts[2], "__k").drop("__k")


def pack_documents(documents: DataFrame, capacity: int = CAPACITY, path: str = bpe.DEFAULT) -> DataFrame:
    return pack(items_of(bpe.count_column(documents, path=path), capacity), capacity)
