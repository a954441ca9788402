import os

import pytest

from stemline.llm import reading


def cut(t):
    return [s.strip() for s in reading.sentences(t)]


def test_sentences():
    assert cut("It is short. What did it mean? See cf. Old Norse, e.g. this, or c. 1200 there.") == ["It is short.", "What did it mean?", "See cf. Old Norse, e.g. this, or c. 1200 there."]
    assert cut("The b was once a p. All of them.\n\nNext one") == ["The b was once a p.", "All of them.", "Next one"]
    assert cut("A sentence that is\nwrapped over lines\nof one width here. And more\nof it.") == ["A sentence that is wrapped over lines of one width here.", "And more of it."]
    assert cut("Every line here is one sentence of its own\nThe next line is one too as one can see\nAnd so is this") == ["Every line here is one sentence of its own", "The next line is one too as one can see", "And so is this"]
    assert cut("== head ==\nText follows. * {{m|a|b}}")[0] == "== head =="
    assert cut("First one... Second one... ") == ["First one...", "Second one..."]
    assert cut("A fire . So it was .") == ["A fire .", "So it was ."] and cut("") == [] and cut("   \n\n ") == []


def test_long_text_is_linear():
    import time

    t = time.time()
    reading.sentences("word " * 200_000 + "." + "a." * 100_000)
    assert time.time() - t < 10


def test_held_out_ratings(spark):
    """Fitted to every other rated document, judged on the rest."""
    sf = "/root/testdata/sf0.1"
    if not os.path.exists(sf):
        pytest.skip("no test tables here")
    docs, labels = spark.read.parquet(f"{sf}/documents.parquet"), spark.read.parquet(f"{sf}/reading_label.parquet")
    rated = labels.groupBy("doc_id").agg({"level": "min"}).toDF("doc_id", "true")
    train = labels.where("doc_id % 2 = 0")
    held = reading.reading_levels(docs, train).join(rated.where("doc_id % 2 = 1"), "doc_id").collect()
    assert len(held) > 150 and sum(r.level == r.true for r in held) >= 0.97 * len(held)


def test_edges(spark):
    text = "The cat sat on the mat. It was a good mat. We like it. " * 15
    docs = spark.createDataFrame([(1, text, "en", 1), (2, None, "en", 1), (3, "short", "en", 1), (4, text, "fr", 1), (5, text, None, 1), (6, "1 2 3 " * 200, "en", 1), (1, text, "en", 1)], "doc_id long, text string, lang string, level int")
    labels = spark.createDataFrame([(1, "basic", "a"), (1, "basic", "b"), (2, "advanced", "a"), (9, "basic", "a"), (3, None, "a"), (None, "basic", "x")], "doc_id long, level string, rater string")
    got = sorted(tuple(r) for r in reading.reading_levels(docs, labels).collect())
    assert got == [(1, "basic"), (1, "basic"), (6, "basic")]
    assert [r.level for r in reading.reading_levels(docs.where("doc_id = 1"), labels.limit(0)).collect()] == ["intermediate"] * 2
    assert reading.reading_levels(docs.limit(0), labels).count() == 0
