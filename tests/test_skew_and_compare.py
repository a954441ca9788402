import math
import random
from collections import Counter, defaultdict

import pyspark.sql.functions as F
from hypothesis import given, settings
from hypothesis import strategies as st

from stemline.operators import compare
from stemline.operators.skew import key_stats


def brute(rows, shares):
    by = defaultdict(list)
    for k, v in rows:
        by[k].append(v)
    out = {}
    for k, vs in by.items():
        some = sorted(v for v in vs if v is not None)
        c = Counter(some)
        mode = min(c, key=lambda v: (-c[v], v)) if c else None
        p = [some[max(1, math.ceil(len(some) * s)) - 1] if some else None for s in shares]
        out[k] = (len(vs), sum(some) if some else None, max(some, default=None), len(c), mode, *p)
    return out


def check(spark, rows):
    df = spark.createDataFrame(rows, "k string, v int").withColumn("band", F.lit(1)).withColumn("w", F.lit("x"))
    got = {r.k: (r.n, r.total, r.highest, r.distinct_values, r["mode"], r.half, r.most) for r in key_stats(df, "k", "v", {"half": 0.5, "most": 0.9}).collect()}
    assert got == brute(rows, (0.5, 0.9))


def test_hot_key_ties_nulls_negatives(spark):
    r = random.Random(1)
    rows = [("hot", r.choice([1, 1, 2, 3, 500, None, -4])) for _ in range(400)] + [("a", None), ("b", 7), (None, 3), (None, None), ("c", 2), ("c", 1), ("d", -3), ("d", 0)]
    check(spark, rows)


def test_fractions_of_one_key(spark):
    """Values of every magnitude, among them many in one narrow band, with bands split down to five values."""
    r = random.Random(5)
    values = [r.uniform(0, 0.001) for _ in range(300)] + [1 + r.random() / 1e6 for _ in range(300)] + [-1e300, 1e300, 5e-324, 0.0, -0.25, float("inf"), float("-inf")] + [2.5] * 40
    rows = [("hot", v) for v in values] + [("b", 7e-9), ("c", None)]
    shares = {"p1": 0.01, "p30": 0.3, "half": 0.5, "most": 0.9, "all": 1.0}
    df = spark.createDataFrame(rows, "k string, v double")
    got = {x.k: tuple(x[n] for n in shares) for x in key_stats(df, "k", "v", shares, ordered=5).collect()}
    by = sorted(values)
    assert got["hot"] == tuple(by[max(1, math.ceil(len(by) * s)) - 1] for s in shares.values())
    assert got["b"] == (7e-9,) * 5 and got["c"] == (None,) * 5


def test_bands_never_fall(spark):
    from stemline.operators.skew import _band

    r = random.Random(6)
    values = sorted({s * r.random() * 10.0 ** r.randint(-320, 300) for s in (1, -1) for _ in range(500)} | {0.0, float("inf"), float("-inf"), 5e-324, -5e-324})
    bands = [x.b for x in spark.createDataFrame([(v,) for v in values], "v double").select("v", _band(F.col("v")).alias("b")).orderBy("v").collect()]
    assert bands == sorted(bands) and len(set(bands)) > 900
    few = spark.createDataFrame([(v / 1e6,) for v in range(1000)], "v double").select(_band(F.col("v")).alias("b")).distinct().count()
    assert few > 100


def test_empty(spark):
    assert key_stats(spark.createDataFrame([], "k string, v int"), "k", "v", {"half": 0.5}).count() == 0


@settings(max_examples=5, deadline=None)
@given(st.lists(st.tuples(st.sampled_from(["a", "b", None]), st.one_of(st.none(), st.integers(-50, 50))), min_size=1, max_size=40))
def test_any_rows(spark, rows):
    check(spark, rows)


def side(spark, rows):
    return spark.createDataFrame(rows, "key string, a string, b boolean")


def test_differences_against_brute_force(spark):
    r = random.Random(4)
    old = {f"k{i}": (r.choice(["x", "y", None]), r.choice([True, False, None])) for i in range(300)}
    new = {k: (v if r.random() < 0.9 else (r.choice(["x", "z", None]), v[1])) for k, v in old.items() if r.random() < 0.97} | {"new1": ("q", None)}
    expected = {(k, "only_old") for k in old.keys() - new.keys()} | {(k, "only_new") for k in new.keys() - old.keys()}
    expected |= {(k, f) for k in old.keys() & new.keys() for i, f in enumerate(("a", "b")) if old[k][i] != new[k][i]}
    a, b = (side(spark, [(k, *v) for k, v in s.items()]) for s in (old, new))
    for leaf in (1, 8, 10_000):
        assert {tuple(x) for x in compare.differences(a, b, ["a", "b"], leaf_rows=leaf).collect()} == expected


def test_identical_and_empty_sides(spark):
    a = side(spark, [("k", "x", None), ("l", None, True)])
    assert compare.differences(a, a, ["a", "b"]).count() == 0
    assert {tuple(r) for r in compare.differences(a, a.limit(0), ["a", "b"]).collect()} == {("k", "only_old"), ("l", "only_old")}
    assert compare.differences(a.limit(0), a.limit(0), ["a", "b"]).count() == 0
    zero = side(spark, [("k", "\u0000", None), ("l", None, True)])
    assert {tuple(r) for r in compare.differences(side(spark, [("k", None, None), ("l", None, True)]), zero, ["a", "b"]).collect()} == {("k", "a")}


def test_latest_row_and_canonical_values(spark):
    df = spark.createDataFrame([(" a ", "x ", 1), ("a", " ", 2), ("a", "y", None), (None, "z", 3), ("b", "(n) ", None)], "w string, v string, at int")
    out = compare.latest(df, compare.trimmed(F.col("w")), {"v": compare.trimmed(F.col("v"))}, F.col("at"))
    assert {tuple(r) for r in out.collect()} == {("a", None), ("b", "(n)")}
