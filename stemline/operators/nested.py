"""Deeply nested JSON records to flat node tables (problem 1).

The JSON text of an Arrow batch is read as one byte buffer.  A structural index (quotes, escapes, brackets, commas)
is built for all rows at once, brackets are paired through a stable sort by depth, and each bracket's offset list
gives the child arrays; parents, places and keys are then propagated level by level with ``take``.  No row is parsed
on its own, whatever the depth.
"""

from __future__ import annotations

import json
import re
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame

from stemline.session import spread

_OBR, _OBK, _CBR, _CBK, _COL, _COM, _STR, _SCL = range(1, 9)
_CLASS = np.full(256, _SCL, np.uint8)
_CLASS[list(b'{[}]:," \t\n\r')] = [*range(1, 7), *[0] * 5]
_ESCAPES = np.zeros(256, bool)
_ESCAPES[list(b'"\\/bfnrtu')] = True
_HEX = np.zeros(256, bool)
_HEX[list(b"0123456789abcdefABCDEF")] = True
_NUMBER = re.compile(rb"-?(0|[1-9]\d*)(\.\d+)?([eE][+-]?\d+)?")
_CHUNK = 3 << 20


class _Index:
    """Token table of a chunk of JSON texts: kind, start, end, row, container, place in the container, validity."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray):
        n, rows = len(data), len(offsets) - 1
        offsets = offsets.astype(np.int32)
        bad = np.zeros(rows, bool)
        row_of = lambda at: np.searchsorted(offsets, at, "right") - 1

        # escapes: of each run of backslashes every other one escapes its follower
        slash = np.flatnonzero(data == 0x5C)
        quote = np.flatnonzero(data == 0x22)
        by = slash
        if len(slash):
            first = np.ones(len(slash), bool)
            first[1:] = np.diff(slash) > 1
            first |= np.isin(slash, offsets[:-1])
            run = np.maximum.accumulate(np.where(first, slash, -1))
            by = slash[(slash - run) % 2 == 0]
            quote = quote[~np.isin(quote, by + 1, assume_unique=True)]
        per_row = np.diff(np.searchsorted(quote, offsets))
        odd = np.flatnonzero(per_row % 2)
        if len(odd):
            bad[odd] = True
            data = data.copy()
            for r in odd:
                data[offsets[r] : offsets[r + 1]] = 0x20
            quote = quote[data[quote] == 0x22]
            by = by[data[by] == 0x5C]
        self.data = data
        opened, closed = quote[::2], quote[1::2]
        bounds = np.empty(len(quote) + 2, np.int64)
        bounds[0], bounds[1:-1], bounds[-1] = 0, quote, n
        outside = np.repeat(1 - ((np.arange(len(quote) + 1) & 1).astype(np.uint8)), np.diff(bounds))

        if len(by):
            follower = np.minimum(by + 1, n - 1)
            by_row = row_of(by)
            wrong = (outside[by] == 1) | (by + 1 >= offsets[by_row + 1]) | ~_ESCAPES[data[follower]]
            bad[by_row[wrong]] = True
            coded = (data[follower] == 0x75) & ~wrong
            u, u_row = by[coded], by_row[coded]
            if len(u):
                wrong = (u + 5 >= offsets[u_row + 1]) | ~_HEX[data[np.minimum(u[:, None] + np.arange(2, 6), n - 1)]].all(1)
                bad[u_row[wrong]] = True
        control = np.flatnonzero(data < 0x20)
        if len(control):
            bad[row_of(control[outside[control] == 0])] = True

        cls = _CLASS[data]
        cls *= outside
        cls[opened] = _STR
        at = np.flatnonzero(cls).astype(np.int32)
        kind = cls[at]
        per_row = np.diff(np.searchsorted(at, offsets))
        row = np.repeat(np.arange(rows, dtype=np.int32), per_row)
        # the characters of a scalar make one token
        lone = kind == _SCL
        inner = np.zeros(len(at), bool)
        inner[1:] = lone[1:] & lone[:-1] & (np.diff(at) == 1) & (row[1:] == row[:-1])
        begins = np.flatnonzero(~inner)
        run = np.diff(np.append(begins, len(at)))
        at, kind, row = at[begins], kind[begins], row[begins]
        end = at + run.astype(np.int32)
        string = np.flatnonzero(kind == _STR)
        end[string] = closed + 1
        scalars = np.flatnonzero(kind == _SCL)
        if len(scalars):
            bad[row[scalars[~self._scalars(data, at[scalars], end[scalars])]]] = True

        counts = np.bincount(row, minlength=rows)
        starts = np.cumsum(counts) - counts
        opens, closes = kind <= _OBK, (kind == _CBR) | (kind == _CBK)
        after = np.cumsum(opens.astype(np.int8) - closes.astype(np.int8), dtype=np.int32)
        after -= np.repeat(np.concatenate([np.zeros(1, np.int32), after])[starts], counts)
        level = after + closes  # of an opening or closing bracket: that of what it holds
        bad[row[after < 0]] = True
        bad |= counts == 0
        full = counts > 0
        bad[full] |= after[(starts + counts - 1)[full]] != 0
        if bad.any():
            keep = np.flatnonzero(~bad[row])
            kind, at, end, row, level, opens, closes = (a[keep] for a in (kind, at, end, row, level, opens, closes))
        t = len(kind)
        self.kind, self.at, self.end, self.row, self.bad = kind, at, end, row, bad
        if not t:
            return

        # a stable sort by level brings each bracket's tokens together, its opening first: the child arrays with their offsets
        most = int(level.max())
        order = np.argsort(level.astype(np.uint8 if most < 256 else np.uint16 if most < 65536 else np.int32), kind="stable").astype(np.int32)
        kinds = kind[order]
        opening = kinds <= _OBK
        deep = level[order] > 0
        slot = np.maximum.accumulate(np.where(opening & deep, np.arange(t, dtype=np.int32), -1))
        holder = np.where(deep & (slot >= 0), order[np.maximum(slot, 0)], -1)
        container = np.empty(t, np.int32)
        container[order] = holder
        commas = np.cumsum(kinds == _COM, dtype=np.int32)
        commas -= commas[np.maximum(slot, 0)]
        place = np.empty(t, np.int32)
        place[order] = commas

        prev = np.zeros(t, np.uint8)
        prev[1:] = kind[:-1]
        first = np.ones(t, bool)
        first[1:] = row[1:] != row[:-1]
        prev[first] = 0
        # what a bracket itself lies in and its place there are those of the separator before it
        inner = np.flatnonzero(opens)
        before = np.maximum(inner - 1, 0)
        lead = prev[inner]
        container[inner] = np.where(lead == 0, -1, np.where(lead <= _OBK, before, container[before]))
        place[inner] = np.where(lead == _COM, place[before], 0)

        outer = np.zeros(t, np.uint8)
        has = container >= 0
        outer[has] = kind[container[has]]
        in_object, in_array = outer == _OBR, outer == _OBK
        key_token = (kind == _STR) & in_object & ((prev == _OBR) | (prev == _COM))
        prev_key = np.zeros(t, bool)
        prev_key[1:] = key_token[:-1]
        prev_key[first] = False
        ends = ((prev == _STR) & ~prev_key) | (prev == _SCL) | (prev == _CBR) | (prev == _CBK)
        value = (opens | (kind >= _STR)) & ~key_token
        fit = np.where(in_object, prev == _COL, np.where(in_array, (prev == _OBK) | (prev == _COM), first))
        wrong = value & ~fit
        wrong |= (kind == _COL) & ~(in_object & prev_key)
        wrong |= (kind == _COM) & ~(has & ends)
        wrong |= (kind == _CBR) & ~(in_object & (ends | (prev == _OBR)))
        wrong |= (kind == _CBK) & ~(in_array & (ends | (prev == _OBK)))
        bad[row[wrong]] = True
        self.container, self.value, self.key, self.place = container, value, key_token, place

    @staticmethod
    def _scalars(data: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        length, lead = end - start, data[start]
        ok = (length == 1) & (lead >= 48) & (lead <= 57)
        for word in (b"true", b"false", b"null"):
            at = np.flatnonzero((length == len(word)) & (lead == word[0]))
            if len(at):
                ok[at] = (data[start[at][:, None] + np.arange(len(word))] == np.frombuffer(word, np.uint8)).all(1)
        seen: dict[bytes, bool] = {}
        for i in np.flatnonzero(~ok & ((lead == 45) | ((lead >= 48) & (lead <= 57)))):
            text = data[start[i] : end[i]].tobytes()
            if text not in seen:
                seen[text] = _NUMBER.fullmatch(text) is not None
            ok[i] = seen[text]
        return ok

    def named(self, name: str) -> np.ndarray:
        """Per container token the value token under key ``name`` (the last of repeated keys), or -1."""
        if not hasattr(self, "_keys"):
            keys = np.flatnonzero(self.key)
            slash = np.flatnonzero(self.data == 0x5C)
            spelled = np.searchsorted(slash, self.end[keys]) > np.searchsorted(slash, self.at[keys]) if len(slash) else np.zeros(len(keys), bool)
            self._keys, self._coded = keys, [(k, json.loads(self.text(k))) for k in keys[spelled]]
            self._length = self.end[keys] - self.at[keys] - 2
        raw = np.frombuffer(name.encode(), np.uint8)
        hit = self._keys[self._length == len(raw)]
        for i, c in enumerate(raw):
            hit = hit[self.data[self.at[hit] + i + 1] == c]
        coded = [k for k, text in self._coded if text == name]
        hit = np.sort(np.concatenate([hit, np.array(coded, np.int64)])) if coded else hit
        out = np.full(len(self.kind), -1, np.int32)
        out[self.container[hit]] = np.minimum(hit + 2, len(self.kind) - 1)
        return out

    def text(self, token: int) -> bytes:
        return self.data[self.at[token] : self.end[token]].tobytes()

    def strings(self, tokens: np.ndarray) -> pa.Array:
        """The texts of value tokens (-1 and JSON null: null); strings are unescaped, other values are their JSON text."""
        there = tokens >= 0
        safe = np.where(there, tokens, 0)
        is_string = there & (self.kind[safe] == _STR)
        start = self.at[safe] + is_string
        end = self.end[safe] - is_string
        end = np.where(there, end, start)
        length = end - start
        off = np.concatenate([[0], np.cumsum(length)])
        index = np.arange(off[-1]) + np.repeat(start - off[:-1], length)
        body = self.data[index]
        slashed = np.add.reduceat(np.concatenate([(body == 0x5C), [False]]).astype(np.int64), np.minimum(off[:-1], len(body))) * (length > 0) if len(tokens) else np.zeros(0)
        null = ~there | ((self.kind[safe] == _SCL) & (length == 4) & (self.data[np.minimum(start, len(self.data) - 1)] == 0x6E))
        out = pa.Array.from_buffers(pa.large_string(), len(tokens), [None, pa.py_buffer(off.astype(np.int64)), pa.py_buffer(body)])
        out = pc.if_else(pa.array(null), pa.scalar(None, pa.large_string()), out)
        odd = np.flatnonzero(slashed.astype(bool) & is_string)
        if len(odd):
            fixed = json.loads(b"[" + b",".join(self.text(tokens[i]) for i in odd) + b"]")  # all of them in one call
            fixed = "\0".join(fixed).encode("utf-8", "replace").decode().split("\0") if not any("\0" in x for x in fixed) else [x.encode("utf-8", "replace").decode() for x in fixed]
            mask = np.zeros(len(tokens), bool)
            mask[odd] = True
            out = pc.replace_with_mask(out, pa.array(mask), pa.array(fixed, pa.large_string()))
        return out


def _flatten(data: np.ndarray, offsets: np.ndarray, source: np.ndarray, fields: tuple[str, ...]) -> Iterator[dict]:
    """Node arrays of a chunk; ``source`` maps its rows to the caller's rows."""
    if len(offsets) < 2 or offsets[-1] == offsets[0]:
        return
    x = _Index(data, offsets)
    if not len(x.kind):
        return
    ok = ~x.bad[x.row]
    top = x.value & (x.container < 0) & ok
    # JSON that is a text holding JSON is read through; each time it is shorter, so this ends
    texts = np.flatnonzero(top & (x.kind == _STR))
    if len(texts):
        inner = [json.loads(x.text(i)).encode("utf-8", "replace") for i in texts]
        ends = np.cumsum([0, *map(len, inner)])
        yield from _flatten(np.frombuffer(b"".join(inner), np.uint8), ends, source[x.row[texts]], fields)

    entry = np.flatnonzero(x.value & ok & (x.container >= 0))
    is_object = x.kind == _OBR
    whole = np.flatnonzero(top & is_object)
    listed = entry[is_object[entry] & (x.kind[x.container[entry]] == _OBK) & (x.container[x.container[entry]] < 0)]
    tree = np.concatenate([whole, listed])
    tree_no = np.concatenate([np.ones(len(whole), np.int64), x.place[listed] + 1])
    nonempty = x.kind[np.minimum(tree + 1, len(x.kind) - 1)] != _CBR
    tree, tree_no = tree[nonempty], tree_no[nonempty]
    head = x.named("head")[tree]
    own = head < 0
    held = ~own & is_object[np.maximum(head, 0)]
    root = np.where(own, tree, head)[own | held]
    tree_no = tree_no[own | held]

    # children: the value under `children` (or `branches` where there is no `children`), a list or a single object
    child_list = x.named("children")
    branches = x.named("branches")
    child_list = np.where(child_list >= 0, child_list, branches)
    owner = np.full(len(x.kind), -1, np.int64)
    holders = np.flatnonzero(child_list >= 0)
    owner[child_list[holders]] = holders
    objects = np.flatnonzero(is_object & ok & x.value)
    box = x.container[objects]
    boxed = (box >= 0) & (x.kind[np.maximum(box, 0)] == _OBK)
    parent = np.where(owner[objects] >= 0, owner[objects], np.where(boxed, owner[np.maximum(box, 0)], -1))
    place = np.where(owner[objects] >= 0, 0, x.place[objects])
    child = parent >= 0
    objects, parent, place = objects[child], parent[child], place[child]

    # level by level from the heads: keys, numbers and paths are taken from the parents' rows
    slot = np.full(len(x.kind), -1, np.int64)
    by_parent = np.argsort(parent, kind="stable")
    objects, parent, place = objects[by_parent], parent[by_parent], place[by_parent]
    first = np.searchsorted(parent, np.arange(len(x.kind) + 1))
    told = {f: x.named(f) for f in fields}
    token, number, path = root, tree_no, pa.array(["0"] * len(root), pa.large_string())
    up = pa.array([""] * len(root), pa.large_string())
    while len(token):
        out = {"row": source[x.row[token]], "tree_no": number, "node_path": path, "parent_path": up}
        for f in fields:
            out[f] = x.strings(told[f][token])
        yield out
        count = first[token + 1] - first[token]
        of = np.repeat(np.arange(len(token)), count)
        begin = np.repeat(first[token] - (np.cumsum(count) - count), count)
        pick = begin + np.arange(len(of))
        token, number = objects[pick], number[of]
        up = path.take(pa.array(of))
        path = pc.binary_join_element_wise(up, pa.array(place[pick]).cast(pa.large_string()), pa.scalar(".", pa.large_string()))


def flatten_json_trees(df: DataFrame, id_col: str = "word_id", json_col: str = "tree_json", fields: tuple[str, ...] = ()) -> DataFrame:
    """One row per tree node in the JSON text of ``json_col``.

    Columns: the id, ``tree_no`` (place of the tree in its list from 1; 1 outside a list), ``node_path`` (head ``0``,
    child at place i: parent's path + ``.i``), ``parent_path`` (empty for the head), then ``fields`` as text.

    Defined cases: null, empty and invalid JSON, scalars, empty lists and empty objects give no rows; null entries keep
    their place; JSON within a JSON text is read through, however often it is wrapped; a child outside a list has place 0;
    ``branches`` is read where a node has no ``children``; entries that are no objects are no nodes; of repeated keys the
    last counts; rows with equal ids are kept apart as they come; extra columns are ignored, whatever their names.
    """
    import pyspark.sql.functions as F
    import pyspark.sql.types as T

    src = df.select(F.col(id_col).alias("__id"), F.col(json_col).cast("string").alias("__json"))
    src = src.where(F.col("__json").isNotNull() & (F.length("__json") > 1))
    schema = T.StructType(
        [T.StructField(id_col, df.schema[id_col].dataType), T.StructField("tree_no", T.LongType()), T.StructField("node_path", T.StringType()), T.StructField("parent_path", T.StringType())]
        + [T.StructField(f"node_{f}" if f in (id_col, "tree_no", "node_path", "parent_path") else f, T.StringType()) for f in fields]
    )
    names = [f.name for f in schema.fields]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = batch.column(0)
            text = batch.column(1).cast(pa.large_string())
            offsets = np.frombuffer(text.buffers()[1], np.int64)[text.offset : text.offset + len(text) + 1]
            data = np.frombuffer(text.buffers()[2] or b"", np.uint8)
            begin = 0
            while begin < len(text):
                stop = max(begin + 1, int(np.searchsorted(offsets, offsets[begin] + _CHUNK, "right")) - 1)
                part = data[offsets[begin] : offsets[stop]]
                for out in _flatten(part, offsets[begin : stop + 1] - offsets[begin], np.arange(begin, stop), fields):
                    columns = [ids.take(pa.array(out["row"])), pa.array(out["tree_no"])] + [out[k].cast(pa.string()) for k in ("node_path", "parent_path", *fields)]
                    if len(columns[0]):
                        yield pa.RecordBatch.from_arrays(columns, names)
                begin = stop

    return spread(src).mapInArrow(run, schema)
