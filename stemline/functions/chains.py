"""Chains of ancestors as arrays of structs: higher-order functions only, so all of it stays in the JVM.

A step is ``struct<lang, term, rel, bucket, era_start, era_end>``, nearest ancestor first.
"""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stemline.functions.classify import CORE, DEPTH_HINT, DONOR_RELS, NATIVE_RELS, NO_LANGUAGE, PLACEHOLDERS, UNINFORMATIVE, depth_hint, family_of, is_english_stage, lookup

MODES = ("direct", "influence", "root")


def without_repeats(steps: Column) -> Column:
    """Adjacent steps of one language and term are one step."""
    return F.filter(steps, lambda s, i: (i == 0) | ~(s["lang"].eqNullSafe(F.get(steps, i - 1)["lang"]) & s["term"].eqNullSafe(F.get(steps, i - 1)["term"])))


def donor_steps(steps: Column, excluded: tuple[str, ...] = NO_LANGUAGE) -> Column:
    """Steps with a language that counts; placeholders for terms become null; what leads to PIE is a root citation."""
    kept = F.filter(steps, lambda s: s["lang"].isNotNull() & ~s["lang"].isin(*excluded))
    fixed = F.transform(
        kept,
        lambda s: s.withField("term", F.when(s["term"].isin(*PLACEHOLDERS), F.lit(None)).otherwise(s["term"])).withField("rel", F.when(s["bucket"] == "PIE", F.lit("root")).otherwise(s["rel"])),
    )
    return without_repeats(fixed)


def narratives(steps: Column, step_type: str) -> Column:
    """Runs of steps that go back in time. A step younger than the oldest so far begins a new run, unless the two languages coexisted.

    ``step_type`` is the DDL of a step. Steps without an era neither split nor move the floor.
    """
    state = f"struct<groups:array<array<{step_type}>>,lo:int,hi:int>"
    start = F.from_json(F.lit('{"groups":[]}'), state)

    def merge(acc: Column, s: Column) -> Column:
        younger = s["era_start"].isNotNull() & acc["lo"].isNotNull() & (s["era_start"] > acc["lo"])
        coexist = (s["era_start"] <= acc["hi"]) & (acc["lo"] <= s["era_end"])
        new = (F.size(acc["groups"]) == 0) | (younger & ~F.coalesce(coexist, F.lit(False)))
        older = s["era_start"].isNotNull() & (acc["lo"].isNull() | (s["era_start"] < acc["lo"]) | (younger & ~F.coalesce(coexist, F.lit(False))))
        n = F.size(acc["groups"])
        grown = F.concat(F.slice(acc["groups"], F.lit(1), F.greatest(n - 1, F.lit(0))), F.array(F.concat(F.try_element_at(acc["groups"], F.lit(-1)), F.array(s))))
        return F.struct(
            F.when(new, F.concat(acc["groups"], F.array(F.array(s)))).otherwise(grown).alias("groups"),
            F.when(older, s["era_start"]).otherwise(acc["lo"]).cast("int").alias("lo"),
            F.when(older, s["era_end"]).otherwise(acc["hi"]).cast("int").alias("hi"),
        )

    return F.aggregate(steps, start, merge, lambda acc: acc["groups"])


def influence(chain: Column) -> Column:
    """The bucket most worth telling between the donor and the root: the deepest uncommon one inside, else the deepest informative one.

    ``chain`` is an array of buckets, nearest first; PIE never answers unless there is nothing else.
    """
    rest = F.filter(chain, lambda b: b != "PIE")
    inner = F.slice(rest, F.lit(2), F.greatest(F.size(rest) - 2, F.lit(0)))
    notable = F.filter(inner, lambda b: ~b.isin(*CORE) & ~b.isin(*UNINFORMATIVE))
    informative = F.filter(inner, lambda b: ~b.isin(*UNINFORMATIVE))
    last = lambda a: F.try_element_at(a, F.lit(-1))
    return F.when(F.size(rest) == 0, last(chain)).when(F.size(rest) <= 2, last(rest)).otherwise(F.coalesce(last(notable), last(informative), last(inner)))


def distinct_buckets(steps: Column) -> Column:
    """One step a bucket, the first; PIE, where it occurs, last."""
    firsts = F.filter(steps, lambda s, i: ~F.exists(F.slice(steps, F.lit(1), i), lambda p: p["bucket"].eqNullSafe(s["bucket"])))
    return F.concat(F.filter(firsts, lambda s: s["bucket"] != "PIE"), F.filter(firsts, lambda s: s["bucket"] == "PIE"))


def _leads(foreign: Column, stages: Column) -> Column:
    return (F.size(stages) > 0) & ((F.size(foreign) == 0) | (F.get(foreign, F.lit(0))["rel"] == "inherited"))


def joined(foreign: Column, roots: Column, stages: Column) -> Column:
    """Donor steps and root citations behind one another, Germanic first where English stages lead."""
    germanic = F.transform(F.slice(stages, F.lit(1), F.lit(1)), lambda s: s.withField("bucket", F.lit("Germanic")))
    empty = (F.size(foreign) == 0) & (F.size(roots) == 0)
    return F.concat(F.when(_leads(foreign, stages) & ~empty, germanic).otherwise(F.slice(foreign, F.lit(1), F.lit(0))), foreign, roots)


def with_record(df: DataFrame, foreign: str, roots: str, stages: str, out: str = "record") -> DataFrame:
    """Adds ``assembled(...)`` as a column; steps and chain are columns of their own first, so each is evaluated once."""
    f, r, s = F.col(foreign), F.col(roots), F.col(stages)
    df = df.withColumn("__steps", joined(f, r, s)).withColumn("__chain", distinct_buckets(F.col("__steps")))
    return df.withColumn(out, _record(F.col("__chain"), f, r, s)).drop("__steps", "__chain")


def assembled(foreign: Column, roots: Column, stages: Column) -> Column:
    """The chain record of a word: ``p, d, chain, prox_kind, root_lang, root_pie, root_term, native``.

    ``foreign`` are donor steps, ``roots`` bare citations, ``stages`` the English stages in between.  An inherited or
    missing donor after English stages puts Germanic first; without any evidence the record is null.
    """
    return _record(distinct_buckets(joined(foreign, roots, stages)), foreign, roots, stages)


def _record(chain: Column, foreign: Column, roots: Column, stages: Column) -> Column:
    native = F.size(stages) > 0
    lead = _leads(foreign, stages)
    empty = (F.size(foreign) == 0) & (F.size(roots) == 0)
    last = F.try_element_at(chain, F.lit(-1))
    before = F.try_element_at(chain, F.lit(-2))
    through = (last["bucket"] == "PIE") & (F.size(chain) >= 2)
    root = F.when(through, before).otherwise(last)
    kind = F.when(lead, F.lit("inherited")).when(F.size(foreign) > 0, F.get(foreign, F.lit(0))["rel"]).otherwise(F.lit("root"))
    full = F.struct(
        F.get(chain, F.lit(0))["bucket"].alias("p"),
        last["bucket"].alias("d"),
        F.transform(chain, lambda s: s["bucket"]).alias("chain"),
        kind.alias("prox_kind"),
        root["lang"].alias("root_lang"),
        F.coalesce(through, F.lit(False)).alias("root_pie"),
        root["term"].alias("root_term"),
        native.alias("native"),
    )
    core = F.struct(
        F.lit("Germanic").alias("p"),
        F.lit("Germanic").alias("d"),
        F.array().cast("array<string>").alias("chain"),
        F.lit("core").alias("prox_kind"),
        F.lit(None).cast("string").alias("root_lang"),
        F.lit(False).alias("root_pie"),
        F.lit(None).cast("string").alias("root_term"),
        native.alias("native"),
    )
    return F.when(empty & native, core).when(~empty, full)


def view(record: Column, mode: str) -> Column:
    """The bucket of a chain record in one reading; Unknown where there is none."""
    if mode not in MODES:
        raise ValueError(f"unknown mode {mode!r}: one of {', '.join(MODES)}")
    chain = record["chain"]
    pick = {"direct": F.get(chain, F.lit(0)), "influence": influence(chain), "root": F.try_element_at(chain, F.lit(-1))}[mode]
    bare = F.lit(False) if mode == "root" else record["prox_kind"] == "root"
    return F.when(record.isNull(), "Unknown").when(F.size(chain) > 0, F.when(bare, "Unknown").otherwise(pick)).when(record["native"], "Germanic").otherwise("Unknown")


def root_name(record: Column) -> Column:
    """The deepest form's language, with the note that it goes back to PIE."""
    return F.when(record["root_pie"], F.concat(record["root_lang"], F.lit(" (from PIE)"))).otherwise(record["root_lang"])


#: Words that many others are built on in another sense than their own answer has.
HUBS = ("logy", "poly")


def is_reliable_root(chain: Column, word: Column, hubs: tuple[str, ...] = HUBS) -> Column:
    """May a word's chain be handed on: the word is none of the hubs, and no uncommon group comes first with common ones behind it."""
    first = F.get(chain, F.lit(0))
    back = F.exists(F.slice(chain, F.lit(2), F.greatest(F.size(chain) - 1, F.lit(0))), lambda b: b.isin(*CORE))
    odd = ~first.isin(*CORE) & back
    return ~F.coalesce(word.isin(*hubs) if hubs else F.lit(False), F.lit(False)) & ~F.coalesce(odd, F.lit(False))


def usable(record: Column) -> Column:
    """Has a chain that says more than a bare root citation."""
    return F.coalesce((F.size(record["chain"]) > 0) & (record["prox_kind"] != "root"), F.lit(False))


def by_depth(steps: Column) -> Column:
    """Nearest to the present first by the depth hint of the language, stable."""
    keyed = F.transform(steps, lambda s, i: F.struct(depth_hint(s["lang"]).alias("k"), i.alias("i"), s.alias("s")))
    return F.transform(F.array_sort(keyed), lambda k: k["s"])


def guarded_by_depth(steps: Column) -> Column:
    """Sorted by depth only within one family and with all languages in the hint; else as they stand."""
    families = F.array_distinct(F.array_compact(F.transform(steps, lambda s: family_of(s["bucket"]))))
    known = F.forall(steps, lambda s: lookup(DEPTH_HINT, s["lang"]).isNotNull())
    return F.when((F.size(families) <= 1) & known, by_depth(steps)).otherwise(steps)


def foreign_donors(line: Column) -> Column:
    """Donor steps behind the head of a line: foreign, by a relation that hands a word on."""
    return F.filter(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda s: s["rel"].isin(*DONOR_RELS) & ~is_english_stage(s["lang"]))


def has_native_descent(line: Column) -> Column:
    """A step of English itself, inherited or derived."""
    return F.exists(F.slice(line, F.lit(2), F.greatest(F.size(line) - 1, F.lit(0))), lambda s: s["rel"].isin(*NATIVE_RELS) & is_english_stage(s["lang"]))
