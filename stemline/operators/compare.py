"""Differences between two copies of a table (problem 7): hierarchical checksums.

Both sides are reduced to one canonical row a key.  Keys are laid out by a hash, every small range of that line gets a
count and an order-free checksum on either side, these are summed up to the whole line once, and ranges are bisected from
there downwards: only halves whose sums differ are split on, and only rows of differing leaves are joined and compared
field by field.
"""

from __future__ import annotations


import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stemline.session import cut

LEAF_ROWS = 8
_BITS = 62


def trimmed(c: Column) -> Column:
    """Without blanks of any kind at either end; empty is null."""
    t = F.regexp_replace(c, r"(?U)^\s+|\s+$", "")
    return F.when(t != "", t)


def latest(df: DataFrame, key: Column, fields: dict[str, Column], at: Column) -> DataFrame:
    """One row a key: the values that stood with the latest ``at`` (null first; ties to the largest values)."""
    names = list(fields)
    rows = df.select(key.alias("key"), F.struct(at.alias("at"), *[c.alias(n) for n, c in fields.items()]).alias("s")).where(F.col("key").isNotNull())
    return rows.groupBy("key").agg(F.max("s").alias("s")).select("key", *[F.col(f"s.{n}").alias(n) for n in names])


def _sums(side: DataFrame, fields: list[str], bits: int, name: str) -> DataFrame:
    place = F.shiftrightunsigned(F.col("h"), _BITS - bits)
    checksum = F.xxhash64("key", *[c for f in fields for c in (F.col(f).isNull(), F.col(f).cast("string"))])  # a null is told from every text
    return side.groupBy(place.alias("leaf")).agg(F.count(F.lit(1)).alias(f"n_{name}"), F.sum(checksum.cast("decimal(38,0)")).alias(f"c_{name}"))


def differences(old: DataFrame, new: DataFrame, fields: list[str], leaf_rows: int = LEAF_ROWS, by: int = 4) -> DataFrame:
    """``key, diff``: ``only_old``, ``only_new`` or the name of a field that differs, one row each.

    Both sides have one row a ``key`` (see ``latest``) and the ``fields`` already in comparable form; nulls are equal.
    Defined cases: null keys must be gone; an empty side makes every key of the other one missing; identical copies are
    settled by the first sums alone.  ``by`` halvings are made between two looks at the sums.
    """
    line = F.shiftrightunsigned(F.xxhash64("key"), 64 - _BITS)
    old, new = cut(old.withColumn("h", line)), cut(new.withColumn("h", line))
    rows = max(old.count(), new.count())
    bits = min(40, max(0, (rows // leaf_rows).bit_length()))
    leaves = _sums(old, fields, bits, "old").join(_sums(new, fields, bits, "new"), "leaf", "full").na.fill(0, ["n_old", "n_new"])
    zero = F.lit(0).cast("decimal(38,0)")
    leaves = leaves.withColumn("c_old", F.coalesce("c_old", zero)).withColumn("c_new", F.coalesce("c_new", zero))
    # the sums of every range at every depth that is looked at, from the leaves upwards in one aggregation
    depths = sorted({*range(0, bits, by), bits})
    ranges = F.explode(F.array(*[F.struct(F.lit(d).alias("depth"), F.expr(f"shiftrightunsigned(leaf, {bits - d})").alias("range")) for d in depths])).alias("r")
    tree = leaves.select(ranges, "n_old", "n_new", "c_old", "c_new").groupBy("r").agg(*[F.sum(c).alias(c) for c in ("n_old", "n_new", "c_old", "c_new")])
    tree = cut(tree.select("r.depth", "r.range", ((F.col("n_old") != F.col("n_new")) | (F.col("c_old") != F.col("c_new"))).alias("differs")))
    # and downwards: a range is looked at only if the one it lies in differs
    open_, before = None, 0
    for d in depths:
        here = tree.where(F.col("depth") == d).select("range", "differs")
        if open_ is not None:
            here = here.join(open_.select(F.col("range").alias("above")), F.expr(f"shiftrightunsigned(range, {d - before})") == F.col("above"), "left_semi")
        open_, before = here.where("differs").select("range"), d
    open_ = open_.select(F.col("range").alias("leaf"))
    leaf = F.shiftrightunsigned(F.col("h"), _BITS - bits)
    hit = open_.select("leaf")
    a = old.withColumn("leaf", leaf).join(hit, "leaf", "left_semi")
    b = new.withColumn("leaf", leaf).join(hit, "leaf", "left_semi")
    a = a.select("leaf", "key", F.struct(*fields).alias("a"))
    b = b.select("leaf", "key", F.struct(*fields).alias("b"))
    both = a.join(b, ["leaf", "key"], "full")
    found = F.when(F.col("b").isNull(), F.array(F.lit("only_old"))).when(F.col("a").isNull(), F.array(F.lit("only_new"))).otherwise(
        F.array_compact(F.array(*[F.when(~F.col(f"a.{f}").eqNullSafe(F.col(f"b.{f}")), F.lit(f)) for f in fields]))
    )
    return both.select("key", F.explode(found).alias("diff"))


def coded(df: DataFrame, column: str, codes: DataFrame, code: str, name: str) -> DataFrame:
    """``column`` with a code of the small table ``codes`` replaced by its name."""
    names = codes.where(F.col(code).isNotNull()).groupBy(F.col(code).alias("__code")).agg(F.min(name).alias("__name"))
    return df.join(names, F.col(column) == F.col("__code"), "left").withColumn(column, F.coalesce("__name", column)).drop("__code", "__name")




def answer_class(old: DataFrame, new: DataFrame, branches: str = "branches") -> DataFrame:
    """``key, class`` of every key of either side, the worst that applies: ``lost_data``, ``gained_data``, ``bucket_changed``, ``root_changed``, ``unfloated`` (the old answer had several branches) or ``same``.

    Both sides: one row a ``key`` with ``resolved, bucket, root``, the old one with ``branches``; what is missing is not resolved.
    """
    side = lambda d, p, more=(): d.select("key", *[F.col(c).alias(f"{p}_{c}") for c in ("resolved", "bucket", "root", *more)])
    j = side(old, "o", (branches,)).join(side(new, "n"), "key", "full")
    was, now = (F.coalesce(f"{p}_resolved", F.lit(False)) for p in "on")
    kind = F.when(was & ~now, "lost_data").when(now & ~was, "gained_data").when(~was & ~now, "same").when(~F.col("o_bucket").eqNullSafe(F.col("n_bucket")), "bucket_changed")
    kind = kind.when(~F.col("o_root").eqNullSafe(F.col("n_root")), "root_changed").when(F.coalesce(F.col(f"o_{branches}") > 1, F.lit(False)), "unfloated").otherwise("same")
    return j.select("key", kind.alias("class"))
