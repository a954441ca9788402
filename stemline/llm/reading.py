"""Reading level of documents (problem 10): a familiar-word formula.

Familiar words are those in a fair share of the plainly written documents, counted over the whole corpus.  A sentence's
difficulty rests on its share of unfamiliar words and on its length; a text is at the level of most of its sentences.
The weights of the formula are fitted to rated documents.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame

from stemline.session import cut, spread

LEVELS = ("basic", "intermediate", "advanced")
#: A document is plain if its sentences have at most so many words on average.
PLAIN_WORDS = 14
#: A word is familiar if it stands in this share of the plain documents: with a few hundred words a document, at most tens of thousands of words.
FAMILIAR_SHARE = 0.15
#: Words in fewer than this share of all documents are names and cited forms; they count neither way.
NAME_SHARE = 0.0015
#: At most so many rated documents are used to fit the weights; the smallest ids are taken.
MAX_RATED = 20_000
MIN_CODE_POINTS = 500

#: Abbreviations that do not end a sentence.
ABBREVIATIONS = {"cf", "lit", "viz", "etc", "ca", "fl", "esp", "approx", "ed", "eds", "vol", "no", "pp", "fig", "mr", "mrs", "dr", "st", "vs", "e.g", "i.e", "s.v", "q.v", "op", "cit", "ibid"}

_TEMPLATE = re.compile(r"\{\{[^{}]*\}\}|\{\|.*?\|\}|<[^<>\n]{1,200}>|\[https?:[^\]\s]*|https?:\S+", re.S)
_WORD = re.compile(r"[^\W\d_]+(?:['’][^\W\d_]+)*")
_STOP = re.compile(r"[.!?…]+[\"'”’)\]]*(?=\s|$)\s*")
_END = re.compile(r"[.!?…]+(?=\s)")
_BREAK = re.compile(r"\n[ \t]*\n+")
_ITEM = re.compile(r"^\s*(?:[*#•·–—-]+\s+|\d+[.)]\s+|[=#|!>]+)")
_CASE = re.compile(r"[^\W\d_]")


def sentences(text: str) -> list[str]:
    """The sentences of a text; headings, list marks and markup are boundaries, wrapped lines are none."""
    out: list[str] = []
    for block in _BREAK.split(_TEMPLATE.sub(" ", text.replace("\r\n", "\n").replace("\r", "\n"))):
        lines = [x for x in block.split("\n") if x.strip()]
        if not lines:
            continue
        runs = [lines[0]]
        joins = _wrapped(lines)
        for line, join in zip(lines[1:], joins):
            if join:
                runs[-1] += " " + line
            else:
                runs.append(line)
        for run in runs:
            begin = 0
            for m in _STOP.finditer(run):
                at = m.start()
                if run[at] not in "!?":
                    before = run[max(begin, at - 40) : at].rstrip()
                    word = before[max(before.rfind(" "), before.rfind("\n"), before.rfind("\t")) + 1 :].lower().lstrip("([\"'“‘")
                    rest = run[m.end() : m.end() + 1]
                    if word in ABBREVIATIONS or (word == "c" and rest.isdigit()):
                        continue
                    if len(word) == 1 and rest.islower():
                        continue
                out.append(run[begin : m.end()])
                begin = m.end()
            if begin < len(run):
                out.append(run[begin:])
    return out


def _wrapped(lines: list[str]) -> list[bool]:
    """Whether each line but the first goes on with the sentence of the line before."""
    ended = [x.rstrip()[-1:] in ".!?…:|=" for x in lines]
    lower = []
    for x in lines:
        m = _CASE.search(x)
        lower.append(bool(m) and m.group().islower())
    item = [bool(_ITEM.match(x)) or x.rstrip().endswith("==") for x in lines]
    # lines that break anywhere have about one width; lines that are sentences begin with capitals
    inner = [i for i in range(1, len(lines)) if not ended[i - 1] and not item[i] and not item[i - 1]]
    flowing = sum(lower[i] for i in inner)
    short = lambda x: len(_WORD.findall(x)) < 3
    out = []
    for i in range(1, len(lines)):
        if item[i] or item[i - 1] or (i == 1 and short(lines[0]) and not lower[1]):
            out.append(False)
        elif ended[i - 1]:
            out.append(lower[i])
        else:
            out.append(lower[i] or flowing * 2 >= len(inner) or lines[i][:1].isdigit())
    return out


def words(sentence: str) -> list[str]:
    return _WORD.findall(sentence.lower())


def _counts(texts: Iterator[str]) -> tuple[Counter, Counter, int, int]:
    """Document frequencies among all and among plain documents, and the numbers of both."""
    everywhere: Counter = Counter()
    plain: Counter = Counter()
    n = n_plain = 0
    for text in texts:
        all_words = words(text)
        there = set(all_words)
        n += 1
        everywhere.update(there)
        if len(all_words) <= PLAIN_WORDS * len(_END.findall(text)):
            plain.update(there)
            n_plain += 1
    return everywhere, plain, n, n_plain


def document_frequencies(english: DataFrame, text_col: str = "text") -> DataFrame:
    """``word, docs, plain_docs``; the row of the empty word has the numbers of documents. Counted before the shuffle."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 2000):
                everywhere, plain, n, n_plain = _counts(t for t in batch.column(0).slice(begin, 2000).to_pylist() if t)
                keys = [*everywhere, ""]
                yield pa.RecordBatch.from_arrays([pa.array(keys), pa.array([*everywhere.values(), n], pa.int64()), pa.array([*(plain[k] for k in everywhere), n_plain], pa.int64())], ["word", "docs", "plain_docs"])

    parts = english.select(F.col(text_col)).mapInArrow(run, "word string, docs long, plain_docs long")
    return parts.groupBy("word").agg(F.sum("docs").alias("docs"), F.sum("plain_docs").alias("plain_docs"))


def word_lists(frequencies: DataFrame) -> tuple[set[str], set[str]]:
    """Familiar words and counted words. Either has at most (mean distinct words of a document) / (its share) members."""
    whole = frequencies.where(F.col("word") == "").first()
    if whole is None:
        return set(), set()
    n, n_plain = max(1, whole["docs"]), max(1, whole["plain_docs"])
    counted = frequencies.where((F.col("word") != "") & (F.col("docs") >= max(2, NAME_SHARE * n)))
    rows = counted.select("word", (F.col("plain_docs") >= FAMILIAR_SHARE * n_plain).alias("familiar")).collect()
    return {r["word"] for r in rows if r["familiar"]}, {r["word"] for r in rows}


def features(text: str, familiar: set[str], counted: set[str]) -> np.ndarray:
    """A row a sentence of three words or more: its words, and the unfamiliar share of those that count.

    Familiar words are among the counted ones.
    """
    out = []
    counts, known = counted.__contains__, familiar.__contains__
    for s in sentences(text):
        w = words(s)
        if len(w) < 3:
            continue
        c = sum(map(counts, w))
        out.append((len(w), (c - sum(map(known, w))) / c if c else 0.0))
    return np.array(out, float).reshape(-1, 2)


def _design(x: np.ndarray) -> np.ndarray:
    n, u = np.log(x[:, 0]), x[:, 1]
    return np.stack([np.ones(len(x)), n, n * n, u, u * u, n * u], 1)


def fit(docs: list[tuple[np.ndarray, int]], rounds: int = 4) -> np.ndarray:
    """Weights of the formula: sentences first take their document's level, then the level the fit gives them."""
    x = _design(np.concatenate([f for f, _ in docs]))
    y = np.concatenate([np.full(len(f), level) for f, level in docs])
    w = np.zeros((x.shape[1], 3))
    for r in range(rounds):
        w = _softmax(x, y, w)
        if r + 1 < rounds:
            p = _chances(x, w)
            given = np.concatenate([np.full(len(f), level) for f, level in docs])
            p[np.arange(len(y)), given] *= 1.5
            y = p.argmax(1)
    return w


def _chances(x: np.ndarray, w: np.ndarray) -> np.ndarray:
    z = x @ w
    z = np.exp(z - z.max(1, keepdims=True))
    return z / z.sum(1, keepdims=True)


def _softmax(x: np.ndarray, y: np.ndarray, w: np.ndarray, steps: int = 25, ridge: float = 1e-3) -> np.ndarray:
    """Multinomial logistic regression by Newton steps."""
    n, d = x.shape
    target = np.eye(3)[y]
    for _ in range(steps):
        p = _chances(x, w)
        g = x.T @ (p - target) / n + ridge * w
        h = np.zeros((3 * d, 3 * d))
        for a in range(3):
            for b in range(3):
                h[a * d : a * d + d, b * d : b * d + d] = (x * (p[:, a] * ((a == b) - p[:, b]))[:, None]).T @ x / n
        step = np.linalg.solve(h + (ridge + 1e-6) * np.eye(3 * d), g.T.reshape(-1))
        w = w - step.reshape(3, d).T
        if np.abs(step).max() < 1e-6:
            break
    return w


def level_of(f: np.ndarray, w: np.ndarray) -> int:
    """The level of most sentences; ties go to the level with the higher summed chances."""
    if not len(f):
        return 0
    p = _chances(_design(f), w)
    votes = np.bincount(p.argmax(1), minlength=3)
    return int((votes + p.sum(0) / (len(f) + 1) * 1e-3).argmax())


def reading_levels(documents: DataFrame, labels: DataFrame, id_col: str = "doc_id", text_col: str = "text", lang_col: str = "lang", min_code_points: int = MIN_CODE_POINTS) -> DataFrame:
    """``id_col, level`` of every English document of at least ``min_code_points`` code points.

    Defined cases: null, short and other languages' texts have no row; a text without any sentence of three words is
    basic; documents rated twice count once (the first level in alphabetical order); without any rated document
    everything is intermediate; texts of any length are read whole; repeated rows come out as often as they come in.
    """
    spark = documents.sparkSession
    english = spread(documents.where((F.col(lang_col) == "en") & F.col(text_col).isNotNull()).select(F.col(id_col).alias("doc_id"), F.col(text_col).alias("text")))
    # written once: two looks are taken at the counts, and counting reads the whole corpus
    familiar, counted = word_lists(cut(document_frequencies(english)))
    rated = labels.where(F.col("level").isin(*LEVELS) & F.col("doc_id").isNotNull()).groupBy("doc_id").agg(F.min("level").alias("level"))
    rated = rated.orderBy("doc_id").limit(MAX_RATED)
    lists = spark.sparkContext.broadcast((familiar, counted))
    measured = english.join(F.broadcast(rated), "doc_id").select("doc_id", "text", "level").mapInArrow(_measure(lists), "level string, n array<double>, u array<double>")
    docs = [(np.stack([r["n"], r["u"]], 1), LEVELS.index(r["level"])) for r in measured.collect() if r["n"]]
    unfitted = np.zeros((6, 3))
    unfitted[0, 1] = 1.0
    w = spark.sparkContext.broadcast(fit(docs) if docs else unfitted)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fam, cnt = lists.value
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                levels = [LEVELS[level_of(features(t, fam, cnt), w.value)] for t in part.column(1).to_pylist()]
                yield pa.RecordBatch.from_arrays([part.column(0), pa.array(levels, pa.string())], [id_col, "level"])

    kind = documents.schema[id_col].dataType
    return english.where(F.length("text") >= min_code_points).mapInArrow(run, T.StructType([T.StructField(id_col, kind), T.StructField("level", T.StringType())]))


def _measure(lists):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        fam, cnt = lists.value
        for batch in batches:
            for begin in range(0, len(batch), 500):
                part = batch.slice(begin, 500)
                f = [features(t, fam, cnt) for t in part.column(1).to_pylist()]
                kind = pa.list_(pa.float64())
                yield pa.RecordBatch.from_arrays([part.column(2), pa.array([x[:, 0].tolist() for x in f], kind), pa.array([x[:, 1].tolist() for x in f], kind)], ["level", "n", "u"])

    return run
