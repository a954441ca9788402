import pyspark.sql.functions as F
import pytest

from stemline.functions import chains

STEP = "struct<lang:string,term:string,rel:string,bucket:string,era_start:int,era_end:int>"
ERAS = {"English": (1500, 9999), "Middle English": (1100, 1500), "Old English": (450, 1100), "Old Norse": (700, 1400), "Latin": (-75, 476), "PIE": (-4500, -2500), "Old French": (800, 1400), "Nowhere": (None, None)}
BUCKETS = {"Old French": "French", "Old Norse": "Norse", "Latin": "Latin", "PIE": "PIE", "Old English": "Germanic", "Middle English": "Germanic", "Persian": "Indo-Iranian", "Arabic": "Semitic", "Nowhere": "Other"}


def steps(*langs, rel="derived"):
    return [(l, None, rel, BUCKETS.get(l, l), *ERAS.get(l, (None, None))) for l in langs]


def run(spark, column, *rows, kind=f"array<{STEP}>"):
    return [r[0] for r in spark.createDataFrame([(x,) for x in rows], f"x {kind}").select(column(F.col("x"))).collect()]


def test_narratives_split_only_where_time_turns_back(spark):
    cases = [("Middle English", "Old French", "Latin", "PIE", "Latin"), ("Middle English", "Old English", "Old Norse", "PIE"), ("Latin", "Nowhere", "Middle English"), ()]
    got = run(spark, lambda c: chains.narratives(c, STEP), *[steps(*c) for c in cases])
    assert [[[s["lang"] for s in g] for g in x] for x in got] == [
        [["Middle English", "Old French", "Latin", "PIE"], ["Latin"]],
        [["Middle English", "Old English", "Old Norse", "PIE"]],
        [["Latin", "Nowhere"], ["Middle English"]],
        [],
    ]


def brute_influence(chain):
    rest = [b for b in chain if b != "PIE"]
    if not rest:
        return chain[-1] if chain else None
    if len(rest) <= 2:
        return rest[-1]
    inner = rest[1:-1]
    core, dull = {"Germanic", "Norse", "French", "Latin", "Greek", "Romance (other)", "Celtic", "PIE"}, {"Other", "Unknown"}
    for pool in ([b for b in inner if b not in core | dull], [b for b in inner if b not in dull], inner):
        if pool:
            return pool[-1]


def test_influence(spark):
    cases = [["French", "Semitic", "Indo-Iranian"], ["French", "Latin"], ["PIE"], [], ["French", "Latin", "Greek", "PIE"], ["Latin", "Other", "Greek"], ["French", "Semitic", "Latin", "Greek"]]
    assert run(spark, chains.influence, *cases, kind="array<string>") == [brute_influence(c) for c in cases]


def record(spark, foreign, roots=(), stages=()):
    df = spark.createDataFrame([(foreign, list(roots), list(stages))], f"f array<{STEP}>, r array<{STEP}>, s array<{STEP}>")
    df = df.withColumn("record", chains.assembled(F.col("f"), F.col("r"), F.col("s")))
    r = F.col("record")
    return df.select(r, *[chains.view(r, m).alias(m) for m in chains.MODES], chains.root_name(r).alias("root_name"), chains.usable(r).alias("usable")).first()


def test_chain_records(spark):
    x = record(spark, steps("Old French", "Arabic", "Persian"))
    assert (x.direct, x.influence, x.root, x.root_name) == ("French", "Semitic", "Indo-Iranian", "Persian")
    x = record(spark, steps("PIE", "Old French", "Latin"))
    assert x.record.chain == ["French", "Latin", "PIE"] and x.root_name == "Latin (from PIE)"
    x = record(spark, [], steps("PIE", rel="root"))
    assert (x.direct, x.influence, x.root, x.usable) == ("Unknown", "Unknown", "PIE", False)
    x = record(spark, [], [], steps("Old English"))
    assert (x.direct, x.root, x.record.prox_kind) == ("Germanic", "Germanic", "core")
    x = record(spark, steps("Old Norse", rel="inherited"), [], steps("Middle English"))
    assert x.record.chain == ["Germanic", "Norse"] and x.record.prox_kind == "inherited"
    x = record(spark, steps("Old Norse", rel="borrowed"), [], steps("Middle English"))
    assert x.record.chain == ["Norse"] and x.record.prox_kind == "borrowed"
    assert record(spark, [])["record"] is None and record(spark, [])["direct"] == "Unknown"


def test_mode_must_be_known():
    with pytest.raises(ValueError):
        chains.view(None, "sideways")


def test_repeats_and_orders(spark):
    twice = [("Latin", "a", "derived", "Latin", 1, 2)] * 2 + [("Latin", "b", "derived", "Latin", 1, 2)]
    assert [len(x) for x in run(spark, chains.without_repeats, twice, [])] == [2, 0]
    got = run(spark, chains.by_depth, steps("Latin", "Nowhere", "Old French", "Middle English"))
    assert [s["lang"] for s in got[0]] == ["Middle English", "Nowhere", "Old French", "Latin"]
    # one family (Latin and French are) with all tiers known; two families; a language without a tier
    got = run(spark, chains.guarded_by_depth, steps("Latin", "Old French"), steps("Latin", "Middle English"), steps("Latin", "Nowhere", "Old French"))
    assert [[s["lang"] for s in x] for x in got] == [["Old French", "Latin"], ["Latin", "Middle English"], ["Latin", "Nowhere", "Old French"]]


def test_reliable_roots(spark):
    df = spark.createDataFrame([(["Semitic", "French"], "a"), (["French", "Semitic"], "b"), (["French"], "hub")], "c array<string>, l string")
    assert [r[0] for r in df.select(chains.is_reliable_root(F.col("c"), F.col("l"), ("hub",))).collect()] == [False, True, False]
