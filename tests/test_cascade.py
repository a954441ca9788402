import pyspark.sql.functions as F

from stemline.functions import text
from stemline.operators import cascade


def test_flattened_splits(spark):
    s = spark.createDataFrame([("outdoorsman", 0, "outdoors"), ("outdoorsman", 1, "man"), ("outdoors", 0, "out"), ("outdoors", 1, "doors"), ("loop", 0, "pool"), ("pool", 0, "loop"), (None, 0, "x")], "word string, place int, part string")
    got = {r.word: r.parts for r in cascade.flattened_splits(s).collect()}
    assert got["outdoorsman"] == ["out", "doors", "man"] and got["outdoors"] == ["out", "doors"] and set(got) == {"outdoorsman", "outdoors", "loop", "pool"}
    assert cascade.flattened_splits(s.limit(0)).count() == 0


def test_answers(spark):
    records = spark.createDataFrame([("table", True, True), ("computer", False, False), ("compute", True, True), ("up", True, True), ("side", True, True), ("weak", False, True), ("odd", False, False)], "form string, trusted boolean, usable boolean")
    splits = spark.createDataFrame([("upside", ["up", "side"]), ("oddside", ["odd", "side"])], "word string, parts array<string>")
    words = spark.createDataFrame([(w,) for w in ["table", "computer", "upside", "oddside", "weak", "odd", "nothing", "table", None]], "w string")
    got = {r.word: (r.via, r.forms) for r in cascade.answered(words, "w", records, text.stem_candidates(F.col("word")), splits).collect()}
    assert got == {"table": ("own", ["table"]), "computer": ("form", ["compute"]), "upside": ("parts", ["up", "side"]), "oddside": ("none", []), "weak": ("own", ["weak"]), "odd": ("own", ["odd"]), "nothing": ("none", [])}
