"""Freely typed language names and codes to the rows of the language list (problem 4).

A typed text is freed of its decoration and split into a stage and a stem.  The stem is looked up in a BK-tree over the
stems of the list and over their beginnings (for shortened names); the stage must be one that the list has for it.
Codes count only letter by letter.
"""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Iterator
from functools import lru_cache

import pyarrow as pa
import pyspark.sql.functions as F
from pyspark.sql import DataFrame

from stemline.llm.bktree import BKTree, distance, sharded
from stemline.session import cut

#: A list of at most so many rows is broadcast whole; a longer one is sharded.
MAX_REFERENCE_ROWS = 5_000
#: A shortened name has at least so many letters.
SHORTEST = 4
_KEEP = 100_000

#: Stages that a language may have, and their irregular short forms.
STAGES = ("old", "middle", "proto", "classical", "northern", "southern", "western", "eastern", "central", "high", "low", "upper", "lower", "late", "early", "new", "modern", "medieval", "ancient", "archaic", "vulgar", "common", "standard")
SHORT = {"nth": "northern", "sth": "southern", "wst": "western", "est": "eastern", "nrth": "northern", "mod": "modern", "anc": "ancient", "clas": "classical", "cl": "classical", "pro": "proto", "mid": "middle", "north": "northern", "south": "southern", "west": "western", "east": "eastern"}
#: Words that decorate a name without telling anything of the language.
DECORATION = {"the", "tongue", "language", "languages", "lang", "langs", "code", "iso", "dialect", "speech", "called", "see", "name"}
_DIGITS = str.maketrans("013457", "oleast")
_LETTERS = re.compile(r"[^\W\d_]+")
_PARTS = re.compile(r"[–—/()\[\]{}=:;|]|\s-\s")


def plain(text: str) -> str:
    """Lower case, without accents; digits written for letters become letters."""
    t = "".join(c for c in unicodedata.normalize("NFKD", text) if not unicodedata.combining(c)).lower()
    return re.sub(r"(?<=[^\W\d_])[013457]|[013457](?=[^\W\d_])", lambda m: m.group().translate(_DIGITS), t)


@lru_cache(maxsize=100_000)
def _stage(token: str, dotted: bool) -> tuple[int, str] | None:
    """The stage a token stands for and how far it is from it."""
    if token in STAGES:
        return 0, token
    if token in SHORT:
        return 0, SHORT[token]
    begins = [s for s in STAGES if s.startswith(token)]
    if begins and (len(token) <= 2 or dotted or len(token) >= 4):
        return 0, begins[0]
    near = sorted((distance(token, s), s) for s in (*STAGES, *SHORT) if abs(len(s) - len(token)) <= 2 and len(s) >= 3)
    if near and near[0][0] <= (1 if len(near[0][1]) <= 5 else 2) and len(token) >= 3:
        return near[0][0], SHORT.get(near[0][1], near[0][1])
    if dotted and len(token) >= 3:
        near = sorted((distance(token, s[: len(token)]), s) for s in STAGES if len(s) > len(token))
        if near and near[0][0] <= 1:
            return near[0][0] + 1, near[0][1]
    return None


def parted(name: str) -> tuple[str, str]:
    """Stage (empty where there is none) and stem of a listed name."""
    tokens = _LETTERS.findall(plain(name))
    stage = tokens[0] if len(tokens) > 1 and tokens[0] in STAGES else ""
    return stage, "".join(tokens[bool(stage) :])


def code_letters(code: str) -> str:
    return "".join(_LETTERS.findall(code.lower()))


class Listed:
    """What a match asks of the language list, from a list held whole."""

    def __init__(self, rows: list[tuple[int, str | None, str | None]]):
        self.codes: dict[str, int] = {}
        self.names: dict[tuple[str, str], int] = {}
        for lang_id, name, code in sorted(rows, key=lambda r: r[0], reverse=True):  # the smallest id of equal names stays
            if code and code_letters(code):
                self.codes[code_letters(code)] = lang_id
            stage, stem = parted(name or "")
            if stem:
                self.names[stage, stem] = lang_id
        stems = sorted({stem for _, stem in self.names})
        owners: dict[str, set[str]] = {}
        for s in stems:
            for n in range(SHORTEST, len(s)):
                owners.setdefault(s[:n], set()).add(s)
        # a beginning of several stems tells nothing
        self.owner = {start: next(iter(of)) for start, of in owners.items() if len(of) == 1}
        self.stem_tree, self.start_tree = BKTree(stems), BKTree(sorted(self.owner))
        self.found: dict[tuple, list] = {}

    def code(self, letters: str) -> int | None:
        return self.codes.get(letters)

    def name(self, stage: str, stem: str) -> int:
        return self.names.get((stage, stem), -1)

    def stems(self, text: str, most: int) -> list[tuple[int, str]]:
        """The two stems nearest to a text within so many edits."""
        return self._kept("stem", text, most, lambda: self.stem_tree.within(text, most)[:2])

    def start(self, text: str, most: int) -> tuple[int, str] | None:
        """The stem that the beginning nearest to a text belongs to, and how far that is."""
        found = self._kept("start", text, most, lambda: [(d, self.owner[s]) for d, s in self.start_tree.within(text, most)[:1]])
        return found[0] if found else None

    def _kept(self, *args) -> list:
        key = args[:3]
        if key not in self.found:
            if len(self.found) > _KEEP:
                self.found.clear()
            self.found[key] = args[3]()
        return self.found[key]


class Missing(Exception):
    """A fact of the list that was not yet looked up: kind, text, bound."""


class Told:
    """The same from facts looked up for one text: ``{(kind, text, bound): found}``; what is not among them is missing."""

    def __init__(self, facts: dict[tuple, list]):
        self.facts = facts

    def _get(self, *key) -> list:
        if key not in self.facts:
            raise Missing(*key)
        return self.facts[key]

    def code(self, letters: str) -> int | None:
        return next((d for d, _ in self._get("code", letters, 0)), None)

    def name(self, stage: str, stem: str) -> int:
        return next((d for d, _ in self._get("name", f"{stage}|{stem}", 0)), -1)

    def stems(self, text: str, most: int) -> list[tuple[int, str]]:
        return self._get("stem", text, most)

    def start(self, text: str, most: int) -> tuple[int, str] | None:
        return next(iter(self._get("start", text, most)), None)


class Matcher:
    """``match`` gives the id of the language that a text means, or -1."""

    def __init__(self, listed: Listed | Told):
        self.listed = listed

    def match(self, text: str | None) -> int:
        if text is None:
            return -1
        code = self._code(text.lower())
        if code is not None:
            return code
        t = plain(text)
        parts = [p for p in _PARTS.split(t) if _LETTERS.search(p)]
        if len(parts) > 1:
            given = [(p, self.listed.code("".join(_LETTERS.findall(p)))) for p in parts]
            listed = [c for _, c in given if c is not None]
            rest = " ".join(p for p, c in given if c is None)
            if listed:
                named = self._name(rest) if _LETTERS.search(rest) else -1
                return named if named >= 0 else listed[0]
        return self._name(t)

    def _code(self, text: str) -> int | None:
        tokens = _LETTERS.findall(text)
        while len(tokens) > 1 and tokens[0] in ("code", "lang", "iso"):
            tokens = tokens[1:]
        return self.listed.code("".join(tokens)) if tokens else None

    def _name(self, t: str) -> int:
        tokens = [(m.group(), t[m.end() : m.end() + 1] == ".") for m in _LETTERS.finditer(t)]
        kept = [x for x in tokens if x[0] not in DECORATION]
        if not kept:
            return -1
        best: tuple[int, int] | None = None  # total distance, id
        tries: list[tuple[int, str, str, bool]] = []  # distance so far, stage, stem, shortened
        if len(kept) > 1:
            for i in (0, len(kept) - 1):
                s = _stage(*kept[i])
                if s:
                    rest = kept[:i] + kept[i + 1 :]
                    tries.append((s[0], s[1], "".join(x for x, _ in rest), rest[-1][1]))
        whole = "".join(x for x, _ in kept)
        if not tries:
            tries.append((0, "", whole, kept[-1][1]))
            # a stage may be written together with its stem
            near = self.listed.stems(whole, 1)
            for s in STAGES if not near else ():
                for n in range(max(3, len(s) - 1), len(s) + 2):
                    if len(whole) - n >= SHORTEST and (d := distance(whole[:n], s)) <= (1 if len(s) > 3 else 0):
                        tries.append((d, s, whole[n:], kept[-1][1]))
        for d, stage, stem, short in tries:
            found = self._stem(stem, short)
            if found is None:
                continue
            total = (d + found[0], self.listed.name(stage, found[1]))
            if best is None or total[0] < best[0]:
                best = total
        return best[1] if best else -1

    def _stem(self, stem: str, short: bool) -> tuple[int, str] | None:
        """The nearest stem of the list, or the only one that a shortened name begins."""
        if len(stem) < SHORTEST:
            return None
        full = self.listed.stems(stem, 1 if len(stem) < 6 else 2 if len(stem) < 9 else 3)
        clear = full[0] if full and (len(full) == 1 or full[0][0] < full[1][0]) else None
        if clear and (clear[0] <= 1 or not short):
            return clear
        start = self.listed.start(stem, 0 if len(stem) < 5 else 1 if len(stem) < 8 else 2)
        if start is None:
            return clear
        return full[0] if full and full[0][0] <= start[0] + (not short) else start


_ready: dict[int, Matcher] = {}


def match_aliases(aliases: DataFrame, languages: DataFrame, most_held: int = MAX_REFERENCE_ROWS) -> DataFrame:
    """``alias_id, lang_id`` of every row without a ``lang_id``: the language meant, or -1.

    Each distinct text is matched once. A list of more than ``most_held`` rows is never held whole: its codes and names are
    looked up by joins and its stems in shards, by the same rules.

    Defined cases: null, empty and blank texts are unmatched; repeated rows come out as often as they come in; ties between
    two stems are unmatched; equal names go to the smallest id; an empty list leaves everything unmatched; other columns
    are ignored, whatever their names.
    """
    typed = aliases.where(F.col("lang_id").isNull()).select(F.col("alias_id").cast("long").alias("alias_id"), F.col("alias").cast("string").alias("alias"))
    texts = typed.where("alias IS NOT NULL").select("alias").distinct()
    listed = languages.where(F.col("lang_id").isNotNull()).select(F.col("lang_id").cast("int").alias("lang_id"), "name", "wikt_code")
    rows = [tuple(r) for r in listed.limit(most_held + 1).collect()]
    found = _held(texts, rows) if len(rows) <= most_held else _looked_up(texts, listed)
    found = found.select(F.col("alias").alias("__t"), F.col("lang_id").alias("__l"))
    return typed.join(found, F.col("alias") == F.col("__t"), "left").select("alias_id", F.coalesce("__l", F.lit(-1)).alias("lang_id"))


def _held(texts: DataFrame, rows: list[tuple]) -> DataFrame:
    held = texts.sparkSession.sparkContext.broadcast(rows)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        key = hash(tuple(held.value))
        if key not in _ready:  # a worker keeps the list it made ready last
            _ready.clear()
            _ready[key] = Matcher(Listed(held.value))
        for batch in batches:
            ids = pa.array([_ready[key].match(t) for t in batch.column(0).to_pylist()], pa.int32())
            yield pa.RecordBatch.from_arrays([batch.column(0), ids], ["alias", "lang_id"])

    # a text costs far more than its bytes tell, so tasks are counted by cores
    return texts.repartition(4 * texts.sparkSession.sparkContext.defaultParallelism).mapInArrow(run, "alias string, lang_id int")


_FACTS = "array<struct<kind:string,text:string,most:int,found:array<struct<d:int,e:string>>>>"


def _looked_up(texts: DataFrame, listed: DataFrame) -> DataFrame:
    """Texts are matched as far as the facts told for them go; what is missing is looked up for all of them together, and they are matched again, until none lacks anything."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            names, codes = batch.column(1).to_pylist(), batch.column(2).to_pylist()
            of = [parted(n or "") for n in names]
            yield pa.RecordBatch.from_arrays(
                [batch.column(0), pa.array([code_letters(c) if c else "" for c in codes]), pa.array([f"{a}|{b}" if b else "" for a, b in of]), pa.array([b for _, b in of])], ["lang_id", "code", "name", "stem"]
            )

    made = cut(listed.mapInArrow(split, "lang_id int, code string, name string, stem string"))
    exact = made.select(F.lit("code").alias("kind"), F.col("code").alias("text"), "lang_id").unionByName(made.select(F.lit("name").alias("kind"), F.col("name").alias("text"), "lang_id"))
    exact = cut(exact.where("text <> ''").groupBy("kind", "text").agg(F.min("lang_id").alias("lang_id")))
    stems = made.where("stem <> ''").select(F.col("stem").alias("e")).distinct()
    begun = stems.where(F.length("e") > SHORTEST).select("e", F.explode(F.sequence(F.lit(SHORTEST), F.length("e") - 1)).alias("n")).select(F.expr("substring(e, 1, n)").alias("start"), "e")
    owners = cut(begun.groupBy("start").agg(F.count(F.lit(1)).alias("n"), F.min("e").alias("owner")).where("n = 1").select("start", "owner"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for text, facts in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist()):
                told = {(f["kind"], f["text"], f["most"]): [(x["d"], x["e"]) for x in f["found"]] for f in facts}
                try:
                    out.append((Matcher(Told(told)).match(text), None, None, None))
                except Missing as m:
                    out.append((None, *m.args))
            columns = [pa.array([r[k] for r in out], t) for k, t in enumerate((pa.int32(), pa.string(), pa.string(), pa.int32()))]
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), *columns], ["alias", "facts", "lang_id", "kind", "text", "most"])

    state, done = texts.withColumn("facts", F.array().cast(_FACTS)), []
    while True:
        step = cut(state.mapInArrow(run, f"alias string, facts {_FACTS}, lang_id int, kind string, text string, most int"))
        done.append(step.where("kind IS NULL").select("alias", "lang_id"))
        open_ = step.where("kind IS NOT NULL").drop("lang_id")
        if not open_.take(1):
            break
        asked = open_.select("kind", "text", "most").distinct()
        one = lambda d, e: F.array(F.struct(d.cast("int").alias("d"), e.alias("e")))
        near = asked.select("kind", F.col("text").alias("q"), "most")
        by_stem = sharded(near.where("kind = 'stem'").select("q", "most"), stems, 2).select(F.lit("stem").alias("kind"), F.col("q").alias("text"), "most", "found")
        by_start = sharded(near.where("kind = 'start'").select("q", "most"), owners.select(F.col("start").alias("e")), 1).select("q", "most", F.get("found", F.lit(0)).alias("f")).join(owners, F.col("f.e") == F.col("start"))
        by_start = by_start.select(F.lit("start").alias("kind"), F.col("q").alias("text"), "most", one(F.col("f.d"), F.col("owner")).alias("found"))
        by_key = asked.join(exact, ["kind", "text"]).select("kind", "text", "most", one(F.col("lang_id"), F.col("text")).alias("found"))
        facts = cut(by_stem.unionByName(by_start).unionByName(by_key))
        told = asked.join(facts, ["kind", "text", "most"], "left").withColumn("found", F.coalesce("found", F.array().cast("array<struct<d:int,e:string>>")))
        j = open_.join(told, ["kind", "text", "most"])
        state = j.select("alias", F.concat("facts", F.array(F.struct("kind", "text", "most", "found"))).alias("facts"))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out
