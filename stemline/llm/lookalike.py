"""One consistent form for text that looks the same (problem 2).

A batch's text is turned into one array of code points.  A lookup table gives each code point's replacement, longer
replacements through expansion offsets; marks are put in order and composed with their letters for all rows together,
mark by mark; a last gather drops what has no ink.  No string of a row is touched by itself.
"""

from __future__ import annotations

import unicodedata

import numpy as np
import pandas as pd
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import Column, DataFrame
from pyspark.sql.functions import arrow_udf

from stemline.session import spread

#: Letters drawn alike in another alphabet (Greek, Coptic, Cyrillic, Armenian, Cherokee, Lisu, letter-like
#: numerals), and the Latin letter that stands for them.
LOOKALIKES = {
    "a": "аɑ", "c": "сϲⲥⅽ", "d": "ԁⅾᏧ", "e": "е", "g": "ɡց", "h": "һհᏂ", "i": "іⅰᎥ", "j": "јϳ", "l": "ӏⅼ",
    "m": "ⅿ", "n": "ո", "o": "оοօⲟ", "p": "рρⲣ", "q": "ԛզ", "s": "ѕ", "u": "սυ", "v": "νѵⅴ", "w": "ԝ", "x": "хⅹ", "y": "у",
    "A": "АΑᎪꓮⲀ", "B": "ВΒᏴꓐⲂ", "C": "СϹᏟꓚⲤⅭ", "D": "ᎠꓓⅮ", "E": "ЕΕᎬꓰⲈ", "F": "Ϝꓝ", "G": "ԌᏀꓖ", "H": "НΗᎻꓧⲎ",
    "I": "ІΙӀⲒⅠꓲ", "J": "ЈͿᎫꓙ", "K": "КΚKᏦꓗⲔ", "L": "ԼᏞꓡⅬⳐ", "M": "МΜᎷꓟⲘⅯ", "N": "ΝꓠⲚ", "O": "ОΟՕꓳⲞ", "P": "РΡᏢꓑⲢ",
    "Q": "Ԛ", "R": "ᎡꓣᏒ", "S": "ЅՏᏚꓢ", "T": "ТΤᎢꓔⲦ", "U": "Սꓴ", "V": "ѴᏙꓦⅤ", "W": "ԜᎳꓪ", "X": "ХΧꓫⲬⅩ",
    "Y": "УΥҮꓬⲨ", "Z": "ΖᏃꓜⲌ", "æ": "ӕ", "Æ": "Ӕ", "Ð": "ĐƉ",
}
#: Hyphens of every kind, and signs without ink that are not of the format category.
HYPHENS = "‐‑‒−﹣－֊⁃"
INKLESS = "͏ᅟᅠ឴឵᠋᠌᠍᠏ㅤﾠ"
_LIMIT = 0x110000
_WITH_INK = "؀؁؂؃؄؅۝܏࢐࢑࣢"


class _Tables:
    """Replacement of every code point, classes of marks, and the pairs that compose."""

    def __init__(self) -> None:
        self.one = np.arange(_LIMIT, dtype=np.int32)
        self.length = np.ones(_LIMIT, np.uint8)
        self.ccc = np.zeros(_LIMIT, np.uint8)
        alike = {ord(c): ord(k) for k, v in LOOKALIKES.items() for c in v}
        more: dict[int, list[int]] = {}
        pairs: dict[int, int] = {}

        def plain(c: int) -> list[int]:
            ch = chr(c)
            kind = unicodedata.category(ch)
            if ch in INKLESS or (kind == "Cf" and ch not in _WITH_INK) or 0xFE00 <= c <= 0xFE0F or 0xE0100 <= c <= 0xE01EF:
                return []
            if kind in ("Zs", "Zl", "Zp") or ch in "\t\n\r\v\f\x85":
                return [0x20]
            if kind == "Cc":
                return []
            if ch in HYPHENS:
                return [0x2D]
            if 0xAC00 <= c <= 0xD7A3:
                return [c]
            d = unicodedata.decomposition(ch)
            if d:
                tag, *parts = d.split() if d[0] == "<" else ("", *d.split())
                if tag in ("", "<wide>", "<narrow>") or 0xFB00 <= c <= 0xFB06:
                    return [x for p in parts for x in plain(int(p, 16))]
            return [alike.get(c, c)]

        for c in [*range(0x80), *(x for x in range(0x80, 0x30000) if unicodedata.category(chr(x)) not in ("Cn", "Co", "Cs", "Lo") or x in alike or unicodedata.decomposition(chr(x)) or chr(x) in INKLESS), *range(0xE0000, 0xE01F0)]:
            to = plain(c)
            self.ccc[c] = unicodedata.combining(chr(c))
            if len(to) == 1:
                self.one[c] = to[0]
            else:
                self.length[c] = len(to)
                more[c] = to
            d = unicodedata.decomposition(chr(c))
            if d and d[0] != "<" and " " in d and unicodedata.normalize("NFC", chr(c)) == chr(c):
                a, b = (int(x, 16) for x in d.split())
                pairs[alike.get(a, a) << 21 | b] = c if alike.get(a, a) == a else pairs.get(alike[a] << 21 | b, c)
        # a composed letter must stand for its look-alike's too: the Latin pair wins
        for key, c in list(pairs.items()):
            whole = unicodedata.normalize("NFC", chr(key >> 21) + chr(key & 0x1FFFFF))
            pairs[key] = ord(whole) if len(whole) == 1 else c
        self.start = np.zeros(_LIMIT, np.int32)
        flat: list[int] = []
        for c, to in more.items():
            self.start[c] = len(flat)
            flat += to
        self.flat = np.array(flat, np.int32)
        order = sorted(pairs)
        self.pair, self.whole = np.array(order, np.int64), np.array([pairs[k] for k in order], np.int32)
        # marks: what may attach to what comes before
        self.mark = self.ccc > 0
        self.mark[[k & 0x1FFFFF for k in order]] = True
        self.mark[0x1161:0x1176] = True
        self.mark[0x11A8:0x11C3] = True

    def composed(self, base: np.ndarray, mark: np.ndarray) -> np.ndarray:
        key = base.astype(np.int64) << 21 | mark
        at = np.minimum(np.searchsorted(self.pair, key), len(self.pair) - 1)
        out = np.where(self.pair[at] == key, self.whole[at], -1)
        lv = (base >= 0x1100) & (base < 0x1113) & (mark >= 0x1161) & (mark < 0x1176)
        out = np.where(lv, 0xAC00 + ((base - 0x1100) * 21 + mark - 0x1161) * 28, out)
        lvt = (base >= 0xAC00) & (base <= 0xD7A3) & ((base - 0xAC00) % 28 == 0) & (mark > 0x11A7) & (mark < 0x11C3)
        return np.where(lvt, base + mark - 0x11A7, out)


_tables: list[_Tables] = []


def tables() -> _Tables:
    if not _tables:
        _tables.append(_Tables())
    return _tables[0]


def consistent(texts: pa.Array) -> pa.Array:
    """The consistent form of every text of a string array; null stays null."""
    t = tables()
    raw = texts.cast(pa.large_string())
    offsets = np.frombuffer(raw.buffers()[1], np.int64)[raw.offset : raw.offset + len(raw) + 1]
    data = np.frombuffer(raw.buffers()[2] or b"", np.uint8)[offsets[0] : offsets[-1]]
    cp = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32).astype(np.int32)
    heads = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    first = heads[offsets - offsets[0]]
    row = np.repeat(np.arange(len(raw), dtype=np.int32), np.diff(first))
    # lookup gather; code points that become none or several go through expansion offsets
    size = t.length[cp]
    if (size != 1).any():
        end = np.cumsum(size, dtype=np.int64)
        within = np.arange(end[-1] if len(end) else 0) - np.repeat(end - size, size)
        source = np.repeat(cp, size)
        several = np.repeat(size, size) != 1
        cp = np.where(several, t.flat[np.minimum(t.start[source] + within, len(t.flat) - 1)], t.one[source])
        row = np.repeat(row, size)
    else:
        cp = t.one[cp]
    cp, row = _compose(t, cp, row)
    # blanks at either end go, runs of blanks become one
    blank = cp == 0x20
    new = np.ones(len(cp), bool)
    new[1:] = row[1:] != row[:-1]
    after = np.zeros(len(cp), bool)
    after[1:] = blank[:-1]
    drop = blank & (after | new)
    if blank.any():
        keep = ~drop
        cp, row = cp[keep], row[keep]
        last = np.ones(len(cp), bool)
        last[:-1] = row[1:] != row[:-1]
        keep = ~((cp == 0x20) & last)
        cp, row = cp[keep], row[keep]
    out = cp.astype("<u4").tobytes().decode("utf-32-le", "replace").encode("utf-8")
    width = 1 + (cp > 0x7F).astype(np.int64) + (cp > 0x7FF) + (cp > 0xFFFF)
    ends = np.concatenate([[0], np.cumsum(width)])
    bound = ends[np.searchsorted(row, np.arange(len(raw) + 1))]
    valid = None if not raw.null_count else pa.py_buffer(np.packbits(raw.is_valid().to_numpy(zero_copy_only=False), bitorder="little").tobytes())
    done = pa.Array.from_buffers(pa.large_string(), len(raw), [valid, pa.py_buffer(bound.astype(np.int64)), pa.py_buffer(out)])
    return done.cast(pa.string())


def _compose(t: _Tables, cp: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    mark = t.mark[cp]
    if not mark.any():
        return cp, row
    mark[0] = False
    mark[1:] &= row[1:] == row[:-1]
    at = np.flatnonzero(mark)
    base = np.maximum.accumulate(np.where(mark, -1, np.arange(len(cp))))[at]
    # marks of one letter in the order of their classes
    still = t.ccc[cp[at]] == 0
    order = np.lexsort((t.ccc[cp[at]], np.cumsum(still), base))
    cp = cp.copy()
    cp[at] = cp[at[order]]
    fresh = np.ones(len(at), bool)
    fresh[1:] = base[1:] != base[:-1]
    begin = np.flatnonzero(fresh)
    rank = np.arange(len(at)) - np.repeat(begin, np.diff(np.append(begin, len(at))))
    gone = np.zeros(len(cp), bool)
    blocking = np.full(len(cp), -1, np.int16)
    by_rank = np.argsort(rank, kind="stable")
    edges = np.searchsorted(rank[by_rank], np.arange(rank.max() + 2))
    for r in range(len(edges) - 1):
        i = by_rank[edges[r] : edges[r + 1]]
        m, b = at[i], base[i]
        ccc = t.ccc[cp[m]].astype(np.int16)
        whole = t.composed(cp[b], cp[m])
        joined = (whole >= 0) & ((blocking[b] < ccc) | (blocking[b] < 0))
        cp[b[joined]] = whole[joined]
        gone[m[joined]] = True
        blocking[b[~joined]] = np.maximum(blocking[b], np.where(ccc == 0, 255, ccc))[~joined]
    return cp[~gone], row[~gone]


@arrow_udf(T.StringType())
def _consistent_udf(texts: pa.Array) -> pa.Array:
    return consistent(texts)


def consistent_form(text: Column | str) -> Column:
    """A column's consistent form.

    Defined cases: null stays null; a text of nothing but blanks and signs without ink becomes empty; blanks of all kinds
    become one space, none at either end; full- and half-width forms, ligatures of f and s, hyphens of every kind and
    letters drawn alike in other alphabets become the plain ones; accents are composed where a composed letter exists;
    case, accents, strokes, raised and lowered letters stay. Texts of any length are treated whole.
    """
    return _consistent_udf(F.col(text) if isinstance(text, str) else text)


def alike_pairs(df: DataFrame, id_col: str, within: list[str], text_col: str) -> DataFrame:
    """``id_a, id_b``: rows of the same ``within`` values whose texts look the same but are spelled otherwise, smaller id first.

    Every such pair has a member whose text is not in consistent form; only those rows are looked up among all rows.
    Null ids, texts or ``within`` values have no pairs; repeated rows give a pair once.
    """
    keys = [F.col(c).alias(f"k{i}") for i, c in enumerate(within)]
    base = spread(df.where(F.col(text_col).isNotNull()).select(F.col(id_col).alias("id"), *keys, F.col(text_col).alias("t")))
    for i in range(len(keys)):
        base = base.where(F.col(f"k{i}").isNotNull())
    base = base.withColumn("form", consistent_form("t")).withColumn("odd", F.when(F.col("form") != F.col("t"), F.col("t")))
    rows = base.select("id", *[f"k{i}" for i in range(len(keys))], "form", "odd")
    odd = rows.where(F.col("odd").isNotNull()).select(F.col("id").alias("id1"), "form", *[f"k{i}" for i in range(len(keys))], F.col("odd").alias("odd1"))
    j = odd.join(rows, [*[f"k{i}" for i in range(len(keys))], "form"]).where(~F.col("odd").eqNullSafe(F.col("odd1")) & (F.col("id") != F.col("id1")))
    j = j.where(F.col("odd").isNull() | (F.col("id1") < F.col("id")))
    return j.select(F.least("id", "id1").alias("id_a"), F.greatest("id", "id1").alias("id_b")).distinct()


def alike_classes(df: DataFrame, id_col: str, within: list[str], text_col: str) -> DataFrame:
    """``id, class_id, spellings, links``: each row with the class of rows whose texts look like its own.

    ``class_id`` is the smallest id of the class, ``spellings`` how many texts it holds, ``links`` how many of its rows are spelled
    otherwise than this one. Rows of equal spelling are counted before their classes are, so no class is ever together in a
    task, and a class of any size costs its rows only. Null ids, texts or ``within`` values are left out; a row repeated whole
    counts once.
    """
    keys = [f"k{i}" for i in range(len(within))]
    base = spread(df.where(F.col(text_col).isNotNull() & F.col(id_col).isNotNull()).select(F.col(id_col).alias("id"), *[F.col(c).alias(k) for c, k in zip(within, keys)], F.col(text_col).alias("t")))
    for k in keys:
        base = base.where(F.col(k).isNotNull())
    rows = base.distinct().withColumn("form", consistent_form("t"))
    spelled = rows.groupBy(*keys, "form", "t").agg(F.count(F.lit(1)).alias("n"), F.min("id").alias("first"))
    classes = spelled.groupBy(*keys, "form").agg(F.sum("n").alias("all"), F.min("first").alias("class_id"), F.count(F.lit(1)).alias("spellings"))
    told = spelled.join(classes, [*keys, "form"]).select(*keys, "form", "t", "class_id", "spellings", (F.col("all") - F.col("n")).alias("links"))
    return rows.join(told, [*keys, "form", "t"]).select("id", "class_id", "spellings", "links")


def consistent_series(s: pd.Series) -> pd.Series:
    """For small tables outside Spark."""
    return pd.Series(consistent(pa.array(s, pa.string())).to_pandas(), index=s.index)
