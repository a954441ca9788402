import json
import random

import numpy as np
import pytest

from stemline.operators.nested import _flatten, flatten_json_trees


def brute(text):
    """The rule restated row by row with the standard parser."""

    def no_constant(_):
        raise ValueError

    try:
        j = json.loads(text, parse_constant=no_constant)
        while isinstance(j, str):
            j = json.loads(j, parse_constant=no_constant)
    except ValueError:
        return
    for i, t in enumerate(j if isinstance(j, list) else [j]):
        if not isinstance(t, dict) or not t:
            continue
        h = t["head"] if "head" in t else t
        stack = [(h, "0", "")] if isinstance(h, dict) else []
        while stack:
            n, p, u = stack.pop()
            yield i + 1, p, u
            kids = n["children"] if "children" in n else n.get("branches")
            kids = [kids] if isinstance(kids, dict) else kids if isinstance(kids, list) else []
            stack += [(c, f"{p}.{k}", p) for k, c in enumerate(kids) if isinstance(c, dict)]


def rows(texts):
    raw = [t.encode() for t in texts]
    out = []
    for b in _flatten(np.frombuffer(b"".join(raw), np.uint8), np.cumsum([0, *map(len, raw)]), np.arange(len(raw)), ()):
        out += zip(b["row"].tolist(), b["tree_no"].tolist(), b["node_path"].to_pylist(), b["parent_path"].to_pylist())
    return sorted(out)


HARD = [
    "[]", "{}", "null", '"x"', "1", "", " ", "NaN", "[NaN]", '{"head":{"children":[null,{"a":1},3,{"children":{"b":[]}}]}}',
    '[null,{"head":null},{"lang":"x","branches":[{"lang":"\\"y{"}]}]', '{"a":1,}', "[1,]", '{"a" 1}', '{"a":1 "b":2}', "[{]}", "{]", "[}", '{"x":"\\u12G4"}', '{"x":"\\u1234"}',
    '{"x":"a\nb"}', '{"x":tru}', '{"x":-0.5e3}', '{"x":01}', '{"x":1.}', '\\"', '{"x":1}}', '{"x":"\\\\"}', '{"x":"\\', '{"x":"\\"', json.dumps('[{"head":{"term":"q"}}]'),
    json.dumps(json.dumps({"term": "q", "children": [{}]})), '{"children":[{"t":1}],"children":[]}', '{"chi\\u006cdren":[{"t":1}]}', '[[{"t":1}]]', '{"x":[1,2,{"children":[{}]}]}',
    '"{\\"a\\"', '[,{"t":1}]', '{"t":1} {"t":2}', '{"t":1}x', '  {"t" : [ ] , "children" : [ { } , { } ]}  ', '{"note":{"by":"x","children":2},"children":null}', '{:1}', '{"a":}', '{"a"}', '{1:2}', '"a" "b"',
]


@pytest.mark.parametrize("text", HARD)
def test_single_texts(text):
    assert rows([text]) == sorted((0, *x) for x in brute(text))


def test_all_texts_in_one_buffer():
    assert rows(HARD) == sorted((i, *x) for i, t in enumerate(HARD) for x in brute(t))


def test_broken_texts_do_not_disturb_their_neighbours():
    r = random.Random(5)
    good = json.dumps([{"head": {"term": "a\\\"b", "children": [{"children": [{"x": [1, {"y": "]"}]}]}, None, {"children": {}}]}}])
    texts = [good if r.random() < 0.5 else good[: r.randint(0, len(good))] + r.choice(["", '"', "\\", "}", "]]"]) for _ in range(400)]
    assert rows(texts) == sorted((i, *x) for i, t in enumerate(texts) for x in brute(t))


def test_deep_and_wide():
    deep = '{"children":[' * 400 + "{}" + "]}" * 400
    wide = json.dumps({"children": [{"t": i} for i in range(3000)]})
    assert rows([deep, wide]) == sorted((i, *x) for i, t in enumerate([deep, wide]) for x in brute(t))


def test_operator_with_clashing_columns_nulls_and_fields(spark):
    df = spark.createDataFrame(
        [(1, None, "a"), (2, '{"term":"x\\u00e9","lang":null,"children":[{"term":5,"is_root":true}]}', "b"), (2, '{"term":"x\\u00e9","lang":null,"children":[{"term":5,"is_root":true}]}', "b")],
        "word_id long, tree_json string, node_path string",
    )
    got = sorted(tuple(r) for r in flatten_json_trees(df, fields=("term", "lang", "is_root")).collect())
    assert got == [(2, 1, "0", "", "xé", None, None)] * 2 + [(2, 1, "0.0", "0", "5", None, "true")] * 2
    assert flatten_json_trees(df.limit(0)).count() == 0


def test_text_wrapped_often():
    text = '{"lang":"a"}'
    for _ in range(18):
        text = json.dumps(text)
    assert rows([text, '"\\"\\""']) == [(0, 1, "0", "")]
