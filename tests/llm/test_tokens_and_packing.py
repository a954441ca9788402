import os
import random

import numpy as np
import pytest

from stemline.llm import bpe, packing

pytestmark = pytest.mark.skipif(not os.path.exists(bpe.DEFAULT), reason="no vocabulary here")
HARD = ["", "a" * 3000, "ab" * 2000, " \n\t  x", "é" * 100, "<|endoftext|>", "日本語" * 50, "​﻿", "1234567890" * 20, "  ", "x  ", "don't I'll", "🙂👍🏽", "a\u0000b", "x" * 47, "x" * 48, "x" * 49, "y" * 200_000]


@pytest.fixture(scope="module")
def reference():
    from tokenizers import Tokenizer

    t = Tokenizer.from_file(os.path.join(os.path.dirname(bpe.DEFAULT), "byte_bpe_50k.json"))
    t.encode_special_tokens = True
    return t


def test_ids_equal_those_of_the_library(spark, reference):
    r = random.Random(3)
    texts = HARD + ["".join(r.choice("abcdeéßж ☃\n.,'1") for _ in range(r.randint(1, 200))) for _ in range(200)] + ["the cat sat", "the cat sat"]
    rows = list(enumerate(texts)) + [(len(texts), None)]
    df = spark.createDataFrame([(i, t, 1) for i, t in rows], "doc_id long, text string, ids int")
    got = {x.doc_id: x.ids for x in bpe.encode_column(df).collect()}
    want = {i: e.ids for (i, _), e in zip(rows, reference.encode_batch(texts, add_special_tokens=False))} | {len(texts): []}
    assert got == want
    assert {x.doc_id: x.n_tokens for x in bpe.count_column(df).collect()} == {i: len(v) for i, v in want.items()}
    assert bpe.encode_column(df.limit(0)).count() == 0


def test_long_words_are_merged_like_short_ones():
    v = bpe.vocabulary(bpe.DEFAULT)
    r = random.Random(8)
    for _ in range(200):
        w = "".join(r.choice("abcdeé") for _ in range(r.randint(2, 40))).encode()
        flat, off = v.encode_words([w.decode("utf-8")])
        assert flat.tolist() == v.merge_long(w)


def test_forgetting_words_changes_nothing(monkeypatch):
    v = bpe.Vocabulary(bpe.DEFAULT)
    monkeypatch.setattr(bpe, "_KEEP_WORDS", 3)
    one = [v.flat[v.offset[k] : v.offset[k + 1]].tolist() for k in v.encode(["some words to keep here"])[0]]
    v.encode(["other things altogether"])
    again = [v.flat[v.offset[k] : v.offset[k + 1]].tolist() for k in v.encode(["some words to keep here"])[0]]
    assert one == again


def brute_best_fit(sizes, capacity):
    fill = []
    for s in sorted(sizes, reverse=True):
        fits = [i for i, f in enumerate(fill) if f + s <= capacity]
        if fits:
            fill[max(fits, key=lambda i: fill[i])] += s
        else:
            fill.append(s)
    return len(fill)


def exact_bins(sizes, capacity):
    best = len(sizes)

    def go(i, fill):
        nonlocal best
        if len(fill) >= best:
            return
        if i == len(order):
            best = len(fill)
            return
        for k in range(len(fill)):
            if fill[k] + order[i] <= capacity:
                fill[k] += order[i]
                go(i + 1, fill)
                fill[k] -= order[i]
        go(i + 1, [*fill, order[i]])

    order = sorted(sizes, reverse=True)
    go(0, [])
    return best


def test_best_fit_and_bounds():
    r = random.Random(6)
    for _ in range(60):
        sizes = [r.randint(0, 20) for _ in range(r.randint(1, 8))]
        bins = packing.best_fit_decreasing(np.array(sizes), 20)
        assert len(set(bins.tolist())) == brute_best_fit(sizes, 20)
        assert np.bincount(bins, weights=sizes).max() <= 20
        assert packing.lower_bound(np.bincount(sizes, minlength=21), 20) <= exact_bins(sizes, 20)
    assert packing.lower_bound(np.bincount([11] * 5, minlength=21), 20) == 5  # more than the sum tells


def test_packing(spark):
    r = random.Random(9)
    counts = [(i, n) for i, n in enumerate([0, 0, 100, 101, 250, *(r.choice([1, 7, 30, 60, 99]) for _ in range(2000))])]
    df = spark.createDataFrame(counts, "doc_id long, n_tokens long")
    items = packing.items_of(df, 100)
    for part in (50, 300, 10_000):
        out = packing.pack(items, 100, per_partition=part).collect()
        assert sorted((x.doc_id, x.piece, x.size) for x in out) == sorted((i, k + 1, min(100, n - 100 * k)) for i, n in counts for k in range(max(1, -(-n // 100))))
        fill = {}
        for x in out:
            fill[x.container] = fill.get(x.container, 0) + x.size
        assert max(fill.values()) <= 100
        bound = packing.lower_bound(np.bincount([x.size for x in out], minlength=101), 100)
        assert bound <= len(fill) <= bound * 1.02 + 3
    assert packing.pack(items.limit(0), 100).count() == 0
    told = packing.report(packing.pack(items, 100, per_partition=40, least_gain=0.0), items, 100).first()
    assert told.containers >= told.bound and (told.overfull, told.lost, told.doubled, told.altered) == (0, 0, 0, 0)
    assert len({x.container for x in packing.pack(items.where("size = 0"), 100).collect()}) == 1
