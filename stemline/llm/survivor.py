"""Best representative of each group of duplicate records, field by field (problem 6).

Fields are unpivoted to long rows, rows are brought together by normalised value, a winner is chosen by ``max_by`` and
the winners are pivoted back.  All steps combine before their shuffles, so a group of any size is no burden.
"""

from __future__ import annotations

from functools import reduce

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

#: What only says that nothing is known or given, without signs, blanks and case. Words that a text may
#: well mean, such as "nothing" or "empty", are not among them; ``nothing`` gives a field other ones.
NOTHING = ("na", "none", "null", "tbd", "tba", "tbc", "unknown", "notknown", "notgiven", "notavailable", "notapplicable", "unspecified", "nodata", "novalue")
KINDS = ("curated", "extract", "derived")
HALF_LIFE_DAYS = 365.0


def has_value(c: Column, nothing: tuple[str, ...] = NOTHING) -> Column:
    """Not null, not blank, not bare signs, not a word for nothing."""
    bare = F.lower(F.regexp_replace(c, r"[^\p{L}\p{N}]", ""))
    return F.coalesce(~bare.isin("", *nothing), F.lit(False))


def normalised(c: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(c, r"(?U)\s+", " ")))


def ranked_sources(sources: DataFrame, precedence: DataFrame) -> DataFrame:
    """``source_id, barred, priority, kind_rank``: two small reference tables, one row a source."""
    p = precedence.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.min("priority").alias("priority"))
    kind = F.lower(F.regexp_replace("kind", r"(?U)\s", ""))
    rank = reduce(lambda acc, ik: acc.when(kind == ik[1], ik[0]), enumerate(KINDS), F.when(F.lit(False), -1)).otherwise(len(KINDS))
    s = sources.where(F.col("source_id").isNotNull()).groupBy("source_id").agg(F.max("additive_only").alias("additive_only"), F.min("kind").alias("kind"))
    return s.join(p, "source_id", "full").select("source_id", (F.coalesce("additive_only", F.lit(0)) == 1).alias("barred"), "priority", rank.alias("kind_rank"))


def long_claims(claims: DataFrame, key: list[str], fields: list[str], ranked: DataFrame, id_col: str = "ety_id", nothing: dict[str, tuple[str, ...]] | None = None) -> DataFrame:
    """One row per claim and field: ``key, field, value`` (null where there is none), the claim's id and its standing.

    ``nothing`` gives fields their own words for no value, in lower case, letters and digits only.
    """
    r = ranked.withColumnRenamed("source_id", "__source")
    c = claims.select(*key, F.col(id_col).alias("__id"), F.col("source_id").alias("__of"), "recorded_at", *fields)
    c = c.join(r, F.col("__of") == F.col("__source"), "left")
    stand = F.struct(
        # all parts rise with standing: smaller priority, then sources without one by kind, later record, smaller id
        F.coalesce(-F.col("priority").cast("long"), F.lit(-(2**62))).alias("priority"),
        F.when(F.col("priority").isNull(), -F.coalesce("kind_rank", F.lit(len(KINDS)))).otherwise(0).alias("kind"),
        F.coalesce(F.unix_micros(F.col("recorded_at").cast("timestamp")), F.lit(-(2**62))).alias("at"),
        (-F.col("__id")).alias("id"),
    )
    told = lambda f: F.when(has_value(F.col(f).cast("string"), (nothing or {}).get(f, NOTHING)), F.col(f).cast("string"))
    cells = F.explode(F.array(*[F.struct(F.lit(f).alias("field"), told(f).alias("value")) for f in fields])).alias("cell")
    rows = c.select(*key, "__id", "priority", "kind_rank", "recorded_at", F.coalesce("barred", F.lit(False)).alias("barred"), stand.alias("standing"), cells)
    given = F.col("cell.value").isNotNull() & ~F.col("barred")
    return rows.select(*key, F.col("cell.field").alias("field"), F.when(given, F.col("cell.value")).alias("value"), F.when(given, F.col("standing")).alias("standing"), F.col("__id").alias("id"), "priority", "kind_rank", "recorded_at")


def by_precedence(long: DataFrame, key: list[str]) -> DataFrame:
    """``key, field, id, value``: the claim of the best standing that has a value, in groups of two rows or more."""
    best = long.groupBy(*key, "field").agg(F.count(F.lit(1)).alias("n"), F.max_by(F.struct("id", "value"), "standing").alias("w"))
    return best.where((F.col("n") >= 2) & F.col("w").isNotNull()).select(*key, "field", F.col("w.id").alias("id"), F.col("w.value").alias("value"))


def by_votes(long: DataFrame, key: list[str], half_life_days: float = HALF_LIFE_DAYS) -> DataFrame:
    """``key, field, value, votes, share``: the normalised value with most votes, spelled as its best claim spells it.

    A claim's vote is the trust in its source, halved for every ``half_life_days`` it is older than 2030-01-01; claims
    without a time count as ten half-lives old.  Ties go to the better standing.
    """
    trust = F.coalesce(F.lit(100.0) / (F.lit(10.0) + F.col("priority")), F.lit(1.0) / (F.lit(1.0) + F.coalesce("kind_rank", F.lit(len(KINDS)))))
    age = F.coalesce((F.lit(1893456000.0) - F.unix_micros(F.col("recorded_at").cast("timestamp")) / 1e6) / 86400.0, F.lit(10 * half_life_days))
    v = long.where(F.col("value").isNotNull()).withColumn("vote", trust * F.pow(F.lit(2.0), -age / half_life_days))
    per = v.groupBy(*key, "field", normalised(F.col("value")).alias("norm")).agg(F.sum("vote").alias("votes"), F.max(F.struct("standing", "value")).alias("best"))
    top = per.groupBy(*key, "field").agg(F.max_by(F.struct("best", "votes"), F.struct(F.round("votes", 9), "best")).alias("w"), F.sum("votes").alias("all"))
    return top.select(*key, "field", F.col("w.best.value").alias("value"), F.col("w.votes").alias("votes"), (F.col("w.votes") / F.col("all")).alias("share"))


def records(winners: DataFrame, key: list[str], fields: list[str]) -> DataFrame:
    """Winners pivoted back: one record a key, null where nobody supplies a field."""
    return winners.groupBy(*key).agg(*[F.max(F.when(F.col("field") == f, F.col("value"))).alias(f) for f in fields])
