"""Nearest entries of a reference list under a true edit metric, through a BK-tree."""

from __future__ import annotations

from collections.abc import Iterable, Iterator

import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame

from stemline.session import cut

#: A reference of at most so many rows is broadcast whole; a longer one is cut into shards of at most about this size.
SHARD_ROWS = 50_000
#: So many queries are looked up in one shard by one task.
BLOCK_QUERIES = 20_000


def distance(a: str, b: str, limit: int = 1 << 30) -> int:
    """Damerau-Levenshtein without restriction (a moved neighbour may be edited again), so the triangle inequality holds.

    Beyond ``limit`` any number above it may come out: the least of a row never falls from row to row.
    """
    if a == b:
        return 0
    if not a or not b:
        return len(a) + len(b)
    if abs(len(a) - len(b)) > limit:
        return limit + 1
    last: dict[str, int] = {}
    far = len(a) + len(b)
    rows = [[far] * (len(b) + 2), [far, *range(len(b) + 1)]]
    for i, x in enumerate(a, 1):
        row, above = [far, i] + [0] * len(b), rows[-1]
        same, least, left = 0, i, i
        for j, y in enumerate(b, 1):
            best, hit = above[j] + (x != y), x == y
            if left + 1 < best:
                best = left + 1
            if above[j + 1] + 1 < best:
                best = above[j + 1] + 1
            # two letters in the other order, with what stands between them
            if same and (k := last.get(y)):
                moved = rows[k][same] + (i - k) + (j - same - 1)
                if moved < best:
                    best = moved
            if hit:
                same = j
            row[j + 1] = left = best
            if best < least:
                least = best
        if least > limit:
            return limit + 1
        last[x] = i
        rows.append(row)
    return rows[-1][-1]


class BKTree:
    """Entries hang on their parents by distance; a search visits only branches that the triangle inequality leaves open."""

    def __init__(self, entries: Iterable[str]):
        self.root: tuple[str, dict] | None = None
        self.longest = 0
        for e in dict.fromkeys(entries):
            self.add(e)

    def add(self, entry: str) -> None:
        self.longest = max(self.longest, len(entry))
        if self.root is None:
            self.root = (entry, {})
            return
        node = self.root
        while True:
            d = distance(entry, node[0])
            if d == 0:
                return
            below = node[1].get(d)
            if below is None:
                node[1][d] = (entry, {})
                return
            node = below

    def within(self, query: str, most: int) -> list[tuple[int, str]]:
        """Every entry at a distance of at most ``most``, nearest first, ties in alphabetical order."""
        if len(query) - self.longest > most:
            return []  # every edit changes the length by one at most
        out, stack = [], [self.root] if self.root else []
        while stack:
            entry, below = stack.pop()
            # a distance matters only as far as it reaches the entry or a branch
            d = distance(query, entry, max(below, default=0) + most)
            if d <= most:
                out.append((d, entry))
            stack.extend(node for k, node in below.items() if d - most <= k <= d + most)
        return sorted(out)


_grown: dict[tuple, BKTree] = {}


def _tree(entries: list[str]) -> BKTree:
    """The tree of a shard; a worker that is given the shard again, with other queries, keeps it."""
    key = (len(entries), hash(tuple(entries)))
    if key not in _grown:
        if len(_grown) > 3:
            _grown.clear()
        _grown[key] = BKTree(entries)
    return _grown[key]


FOUND = "array<struct<d:int,e:string>>"


def sharded(queries: DataFrame, reference: DataFrame, keep: int = 1, shard_rows: int = SHARD_ROWS, block_queries: int = BLOCK_QUERIES) -> DataFrame:
    """``q, most, found``: the ``keep`` entries nearest to each distinct query (``q, most``), nearest first, ties in alphabetical order.

    The reference (distinct ``e``) is cut into shards by length, a length of many entries by hash too; a query goes only to
    shards whose length is within its bound. A shard's queries are cut into blocks by their number, and the winners of the shards
    are merged. Neither side is ever in one task whole.
    """
    size = F.length("e").alias("size")
    lengths = reference.groupBy(size).agg(F.count(F.lit(1)).alias("n")).select("size", F.ceil(F.col("n") / shard_rows).cast("int").alias("parts"))
    mine = reference.withColumn("size", F.length("e")).join(lengths, "size").select("e", "size", F.pmod(F.xxhash64("e"), F.col("parts")).cast("int").alias("part"))
    near = F.sequence(F.length("q") - F.col("most"), F.length("q") + F.col("most"))
    asked = queries.select("q", "most", F.explode(near).alias("size")).join(lengths, "size")
    asked = cut(asked.select("q", "most", "size", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)).alias("part")))
    blocks = asked.groupBy("size", "part").agg(F.ceil(F.count(F.lit(1)) / block_queries).cast("int").alias("blocks"))
    asked = asked.join(blocks, ["size", "part"]).withColumn("block", F.pmod(F.xxhash64("q", "most"), F.col("blocks")).cast("int"))
    mine = mine.join(blocks, ["size", "part"]).withColumn("block", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    schema = T._parse_datatype_string(f"q string, most int, found {FOUND}")
    kind = pa.list_(pa.struct([("d", pa.int32()), ("e", pa.string())]))

    def shard(left: pa.Table, right: pa.Table) -> pa.Table:
        tree = _tree(sorted(right.column("e").to_pylist()))
        pairs = [*zip(left.column("q").to_pylist(), left.column("most").to_pylist())]
        found = [[{"d": d, "e": e} for d, e in tree.within(q, most)[:keep]] for q, most in pairs]
        return pa.table({"q": pa.array([q for q, _ in pairs], pa.string()), "most": pa.array([m for _, m in pairs], pa.int32()), "found": pa.array(found, kind)})

    each = asked.select("size", "part", "block", "q", "most").groupBy("size", "part", "block").cogroup(mine.select("size", "part", "block", "e").groupBy("size", "part", "block")).applyInArrow(shard, schema)
    return each.groupBy("q", "most").agg(F.slice(F.array_sort(F.flatten(F.collect_list("found"))), 1, keep).alias("found"))


def nearest(queries: DataFrame, query: str, reference: DataFrame, entry: str, most: int = 2, shard_rows: int = SHARD_ROWS) -> DataFrame:
    """Distinct ``query``, its nearest ``entry`` within ``most`` edits (null where there is none) and the ``distance``.

    The reference is broadcast while it is short, else cut into shards that each give a winner, which are then merged;
    ties go to the entry first in alphabetical order.  Null queries and entries are left out.
    """
    spark = queries.sparkSession
    q = queries.where(F.col(query).isNotNull()).select(F.col(query).cast("string").alias("q")).distinct()
    r = reference.where(F.col(entry).isNotNull()).select(F.col(entry).cast("string").alias("e")).distinct()
    held = [x["e"] for x in r.limit(shard_rows + 1).collect()]
    if len(held) <= shard_rows:
        schema = T.StructType([T.StructField("q", T.StringType()), T.StructField("e", T.StringType()), T.StructField("d", T.IntegerType())])
        entries = spark.sparkContext.broadcast(sorted(held))

        def whole(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            tree = _tree(entries.value)
            for batch in batches:
                found = [next(iter(tree.within(t, most)), (None, None)) for t in batch.column(0).to_pylist()]
                yield pa.RecordBatch.from_arrays([batch.column(0), pa.array([f[1] for f in found], pa.string()), pa.array([f[0] for f in found], pa.int32())], ["q", "e", "d"])

        # a query costs far more than its bytes tell, so tasks are counted by cores
        best = q.repartition(4 * spark.sparkContext.defaultParallelism).mapInArrow(whole, schema)
    else:
        found = sharded(q.withColumn("most", F.lit(most)), r, 1, shard_rows)
        best = q.join(found, "q", "left").select("q", F.get("found", F.lit(0))["e"].alias("e"), F.get("found", F.lit(0))["d"].alias("d"))
    return best.select(F.col("q").alias("query"), F.col("e").alias("entry"), F.col("d").alias("distance"))
