"""Encoding with a public byte-level BPE vocabulary (problem 8).

A text is cut into words by the vocabulary's pattern; each distinct word of a batch is merged once, all short words of
one length together: part boundaries and the ranks of adjacent parts are held in contiguous rows, the least rank of
every row is found in one scan, its boundary deleted, and the two neighbouring ranks refreshed.
"""

from __future__ import annotations

import base64
import heapq
import os
from collections import defaultdict
from collections.abc import Iterator
from itertools import count, islice

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import pyspark.sql.types as T
import regex
from pyspark.sql import DataFrame

from stemline.session import spread

DEFAULT = os.environ.get("STEMLINE_TOKENIZERS", "/opt/tokenizers") + "/byte_bpe_50k.tiktoken"
#: Fixed: the pattern that splits text before the merges of the rank files.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
_SHORT = 48
_NEVER = np.int32(1 << 30)
_STEP_CHARS = 1_000_000
_KEEP_WORDS = 200_000


class Vocabulary:
    """Ranks of a ``.tiktoken`` file: a line per token, its bytes in base64 and its id."""

    def __init__(self, path: str):
        with open(path, "rb") as f:
            ranks = {base64.b64decode(a): int(b) for a, b in (line.split() for line in f if line.strip())}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)], np.int32)
        keys, ids = [], []
        for token, rank in ranks.items():
            for i in range(1, len(token)):
                a, b = ranks.get(token[:i]), ranks.get(token[i:])
                if a is not None and b is not None:
                    keys.append(a << 20 | b)
                    ids.append(rank)
        order = np.argsort(np.array(keys, np.int64))
        self.pairs, self.merged = np.array(keys, np.int64)[order], np.array(ids, np.int32)[order]
        self.table = dict(zip(keys, ids))
        self.reset()

    def reset(self) -> None:
        self.number: dict[str, int] = defaultdict(count().__next__)
        self.flat, self.offset = np.zeros(0, np.int32), np.zeros(1, np.int64)

    def ranks(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        key = a.astype(np.int64) << 20 | b
        at = np.minimum(np.searchsorted(self.pairs, key), len(self.pairs) - 1)
        return np.where(self.pairs[at] == key, self.merged[at], _NEVER)

    def merge_rows(self, part: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
        """Merges words of one byte length; gives (rows, parts) for each number of parts left."""
        done, rows = [], np.arange(len(part))
        rank = self.ranks(part[:, :-1], part[:, 1:])
        while True:
            width = part.shape[1]
            if width == 1:
                done.append((rows, part))
                return done
            at = rank.argmin(1)
            best = rank[np.arange(len(rows)), at]
            stuck = best == _NEVER
            if stuck.any():
                done.append((rows[stuck], part[stuck]))
                go = ~stuck
                rows, part, rank, at, best = rows[go], part[go], rank[go], at[go], best[go]
                if not len(rows):
                    return done
            each = np.arange(len(rows))
            part[each, at] = best
            columns = np.arange(width - 1)
            part = np.take_along_axis(part, columns + (columns > at[:, None]), 1)
            columns = columns[:-1]
            rank = np.take_along_axis(rank, columns + (columns >= at[:, None]), 1)
            left, right = np.flatnonzero(at > 0), np.flatnonzero(at < width - 2)
            i = at[left]
            rank[left, i - 1] = self.ranks(part[left, i - 1], part[left, i])
            i = at[right]
            rank[right, i] = self.ranks(part[right, i], part[right, i + 1])

    def merge_long(self, word: bytes) -> list[int]:
        """One long word: the same merges, with the least rank kept in a heap instead of found by a scan."""
        part = self.byte[np.frombuffer(word, np.uint8)].tolist()
        n = len(part)
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        table = self.table
        heap = [(r, i) for i in range(n - 1) if (r := table.get(part[i] << 20 | part[i + 1])) is not None]
        heapq.heapify(heap)
        while heap:
            r, i = heapq.heappop(heap)
            j = after[i]
            if part[i] < 0 or j >= n or table.get(part[i] << 20 | part[j]) != r:
                continue
            part[i], part[j] = r, -1
            k = after[i] = after[j]
            if k < n:
                before[k] = i
                if (s := table.get(r << 20 | part[k])) is not None:
                    heapq.heappush(heap, (s, i))
            if (h := before[i]) >= 0 and (s := table.get(part[h] << 20 | r)) is not None:
                heapq.heappush(heap, (s, h))
        return [p for p in part if p >= 0]

    def encode_words(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Flat ids and offsets of ``words``."""
        raw = [w.encode("utf-8", "replace") for w in words]
        length = np.fromiter(map(len, raw), np.int64, len(raw))
        data = self.byte[np.frombuffer(b"".join(raw), np.uint8)]
        begin = np.cumsum(length) - length
        out_len = np.ones(len(raw), np.int64)
        found: list[tuple[np.ndarray, np.ndarray]] = []
        for n in np.unique(length).tolist():
            rows = np.flatnonzero(length == n)
            if n <= _SHORT:
                for at in range(0, len(rows), 20_000):
                    some = rows[at : at + 20_000]
                    found += [(some[r], p) for r, p in self.merge_rows(data[begin[some][:, None] + np.arange(n)])]
            else:
                for r in rows.tolist():
                    found.append((np.array([r]), np.array([self.merge_long(raw[r])], np.int32)))
        for r, p in found:
            out_len[r] = p.shape[1]
        offset = np.concatenate([[0], np.cumsum(out_len)])
        flat = np.empty(offset[-1], np.int32)
        for r, p in found:
            flat[offset[r][:, None] + np.arange(p.shape[1])] = p
        return flat, offset

    def encode(self, texts: list[str | None]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Word numbers of all texts, words of each text; then ``flat``/``offset`` hold the words' ids."""
        if len(self.number) > _KEEP_WORDS:
            self.reset()
        known = len(self.number)
        cut = _pattern().findall
        per_text, numbers = np.zeros(len(texts), np.int64), []
        take = self.number.__getitem__
        for i, t in enumerate(texts):
            if t:
                words = cut(t)
                per_text[i] = len(words)
                numbers.append(np.fromiter(map(take, words), np.int32, len(words)))
        fresh = len(self.number) - known
        if fresh:
            words = list(islice(reversed(self.number), fresh))[::-1]
            flat, offset = self.encode_words(words)
            self.flat = np.concatenate([self.flat, flat])
            self.offset = np.concatenate([self.offset, self.offset[-1] + offset[1:]])
        return (np.concatenate(numbers) if numbers else np.zeros(0, np.int32)), per_text, self.offset[1:] - self.offset[:-1]


_held: dict[str, Vocabulary] = {}
_compiled: list = []


def _pattern():
    if not _compiled:
        _compiled.append(regex.compile(PATTERN))
    return _compiled[0]


def vocabulary(path: str) -> Vocabulary:
    """One vocabulary a worker process, with the words it has met (at most some hundred thousand)."""
    if path not in _held:
        _held[path] = Vocabulary(path)
    return _held[path]


def _steps(text: pa.Array) -> Iterator[tuple[int, int]]:
    """Slices of about a million bytes."""
    size = np.cumsum(np.asarray(pc.binary_length(text).fill_null(0)))
    begin = 0
    while begin < len(text):
        end = max(begin + 1, int(np.searchsorted(size, (size[begin - 1] if begin else 0) + _STEP_CHARS, "right")))
        yield begin, end
        begin = end


def encode_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT) -> DataFrame:
    """``id_col, ids``: the token ids of every row's text, without special tokens.

    Defined cases: a null text and an empty text both have the empty list; special tokens' strings are ordinary text;
    texts of any length are encoded whole; repeated rows come out as often as they come in; an empty table gives none.
    """
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("ids", T.ArrayType(T.IntegerType(), False))])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        kind = pa.list_(pa.field("element", pa.int32(), False))
        for batch in batches:
            for begin, end in _steps(batch.column(1)):
                numbers, words, length = v.encode(batch.column(1).slice(begin, end - begin).to_pylist())
                size = length[numbers]
                last = np.cumsum(size)
                flat = v.flat[np.arange(last[-1] if len(last) else 0) + np.repeat(v.offset[numbers] - (last - size), size)]
                ends = np.concatenate([[0], last])[np.concatenate([[0], np.cumsum(words)])]
                ids = pa.ListArray.from_arrays(pa.array(ends.astype(np.int32)), pa.array(flat), type=kind)
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), ids], [id_col, "ids"])

    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)


def count_column(df: DataFrame, id_col: str = "doc_id", text_col: str = "text", path: str = DEFAULT) -> DataFrame:
    """``id_col, n_tokens``: the number of ids that ``encode_column`` gives."""
    schema = T.StructType([T.StructField(id_col, df.schema[id_col].dataType), T.StructField("n_tokens", T.LongType())])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        v = vocabulary(path)
        for batch in batches:
            for begin, end in _steps(batch.column(1)):
                numbers, words, length = v.encode(batch.column(1).slice(begin, end - begin).to_pylist())
                upto = np.concatenate([[0], np.cumsum(length[numbers])])
                ends = upto[np.concatenate([[0], np.cumsum(words)])]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(begin, end - begin), pa.array(np.diff(ends))], [id_col, "n_tokens"])

    return spread(df.select(F.col(id_col), F.col(text_col))).mapInArrow(run, schema)
