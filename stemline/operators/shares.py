"""Tokens to shares of origin groups: each distinct token is resolved once, votes are weighted sums."""

from __future__ import annotations

import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stemline.functions import classify, text
from stemline.session import spread


def token_rows(docs: DataFrame, keys: list[str], text_col: str = "text") -> DataFrame:
    """``keys, pos, token`` of every token, in order."""
    return spread(docs.select(*keys, text_col)).select(*keys, F.posexplode(text.tokens(F.col(text_col))).alias("pos", "token"))


def token_counts(docs: DataFrame, keys: list[str], text_col: str = "text", connectors: bool = True) -> DataFrame:
    """``keys, token, n``; combined before the shuffle. ``connectors=False`` takes closed-class words out of all totals."""
    t = spread(docs.select(*keys, text_col)).select(*keys, F.explode(text.tokens(F.col(text_col))).alias("token"))
    if not connectors:
        t = t.where(~F.col("token").isin(*text.CONNECTORS))
    return t.groupBy(*keys, "token").agg(F.count(F.lit(1)).alias("n"))


#: Rank of each way in which a form reaches a word; the smallest answers.
RANKS = {"verbatim": 5, "exact": 10, "inflection": 40, "generated": 45, "case": 50, "derivation": 60}


def surface_forms(words: DataFrame) -> DataFrame:
    """``form, word_id, kind, rank``: headwords as spelled (verbatim with capitals, exact without), and the lower-case forms of the former."""
    w = words.where("headword IS NOT NULL")
    kind = F.when(F.col("headword") != F.col("key_lower"), F.lit("verbatim")).otherwise(F.lit("exact"))
    spelled = w.select(F.col("headword").alias("form"), "word_id", kind.alias("kind"))
    case = w.where(F.col("headword") != F.col("key_lower")).select(F.col("key_lower").alias("form"), "word_id", F.lit("case").alias("kind"))
    return spelled.unionByName(case).withColumn("rank", _rank(F.col("kind")))


def _rank(kind: Column) -> Column:
    return F.element_at(F.create_map(*[F.lit(x) for kv in RANKS.items() for x in kv]), kind)


def all_surface_forms(words: DataFrame, inflected: DataFrame) -> DataFrame:
    """Adds inflected (``form, base``), derived and generated forms: those of words without an answer go to the first stem that has one; forms taken by better kinds stay theirs."""
    base = surface_forms(words)
    heads = words.where("status <> 'none' AND key_lower IS NOT NULL").groupBy("key_lower").agg(F.min_by("word_id", F.struct(F.col("headword") != F.col("key_lower"), F.col("word_id"))).alias("word_id"))
    spelled = words.select(F.col("headword").alias("form")).where("form IS NOT NULL").distinct()
    i = inflected.join(spelled, "form", "left_anti").join(heads, F.lower("base") == F.col("key_lower")).select("form", "word_id", F.lit("inflection").alias("kind"))
    lost = words.where("status = 'none' AND headword IS NOT NULL").select(F.lower("headword").alias("w")).distinct()
    d = first_match(lost, "w", text.stem_candidates(F.col("w")), heads, "key_lower").join(heads, F.col("base") == F.col("key_lower")).select(F.col("word").alias("form"), "word_id", F.lit("derivation").alias("kind"))
    more = base.unionByName(i.unionByName(d).withColumn("rank", _rank(F.col("kind"))))
    g = new_forms(words.where("status <> 'none'"), "key_lower", text.regular_forms(F.col("key_lower")), more, "form")
    g = g.join(heads, F.col("base") == F.col("key_lower")).select("form", "word_id", F.lit("generated").alias("kind"))
    return more.unionByName(g.withColumn("rank", _rank(F.col("kind")))).dropDuplicates(["form", "word_id", "kind"])


def ranked_lookup(typed: DataFrame, form: str, surface: DataFrame, words: DataFrame) -> DataFrame:
    """The best word of each typed form: as typed or in lower case, by rank, then lower-case headwords, more etymologies, headword."""
    asked = typed.select(F.col(form).alias("typed")).where(F.col(form).isNotNull()).distinct()
    tries = asked.select("typed", F.explode(F.array_distinct(F.array(F.col("typed"), F.lower("typed")))).alias("form"))
    w = words.select("word_id", "headword", "key_lower", "ety_count")
    hits = tries.join(surface, "form").join(w, "word_id")
    order = F.struct(F.col("rank"), (F.col("headword") != F.col("key_lower")).alias("cased"), (-F.coalesce("ety_count", F.lit(-1))).alias("e"), F.col("headword"), F.col("word_id"))
    best = hits.groupBy("typed").agg(F.min_by(F.struct("word_id", "headword", "kind", "rank"), order).alias("b"))
    return asked.join(best, "typed", "left").select("typed", "b.word_id", "b.headword", "b.kind", "b.rank")


def resolved_tokens(counts: DataFrame, lexicon: DataFrame) -> DataFrame:
    """Adds ``bucket`` (Unknown for a miss) and what else the lexicon (one row a ``form``) has."""
    return counts.join(lexicon, counts["token"] == lexicon["form"], "left").drop("form").withColumn("bucket", F.coalesce("bucket", F.lit("Unknown")))


def shares(resolved: DataFrame, keys: list[str], weight: Column | None = None) -> DataFrame:
    """``keys, bucket, votes, pct_all, pct_resolved``: shares of all tokens and of those that resolved; empty totals give null."""
    w = F.col("n").cast("double") if weight is None else weight
    votes = resolved.groupBy(*keys, "bucket").agg(F.sum(w).alias("votes"))
    over = Window.partitionBy(*keys) if keys else Window.partitionBy(F.lit(1))
    total = F.sum("votes").over(over)
    known = F.sum(F.when(F.col("bucket") != "Unknown", F.col("votes"))).over(over)
    out = votes.withColumn("pct_all", F.try_divide(F.col("votes") * 100.0, total)).withColumn("pct_resolved", F.when(F.col("bucket") != "Unknown", F.try_divide(F.col("votes") * 100.0, known)))
    return out.withColumn("place", classify.bucket_order(F.col("bucket")))


def coverage(resolved: DataFrame, keys: list[str]) -> DataFrame:
    """Totals, coverage, and the share of what resolved that leans on the approximation."""
    known = F.when(F.col("bucket") != "Unknown", F.col("n")).otherwise(0)
    a = F.when(F.col("bucket").isin(*classify.APPROXIMATE), F.col("n")).otherwise(0)
    s = resolved.groupBy(*keys).agg(F.sum("n").alias("tokens"), F.sum(known).alias("resolved"), F.sum(a).alias("approximate"))
    return s.withColumn("coverage", F.try_divide(F.col("resolved") * 100.0, F.col("tokens"))).withColumn("approximate_share", F.try_divide(F.col("approximate") * 100.0, F.col("resolved")))


def split_votes(items: DataFrame, key: str, parts: str) -> DataFrame:
    """One vote an item, shared evenly by its parts: ``part, votes``; repeated parts count each time."""
    e = items.where(F.size(parts) > 0).select(key, F.explode(parts).alias("part"), (F.lit(1.0) / F.size(parts)).alias("share"))
    return e.groupBy("part").agg(F.sum("share").alias("votes"), F.count(F.lit(1)).alias("uses"))


def first_match(words: DataFrame, word: str, candidates: Column, known: DataFrame, form: str) -> DataFrame:
    """Of each word's ordered candidates the first that is known: ``word, base, place``."""
    c = words.select(F.col(word).alias("word"), F.posexplode(candidates).alias("place", "base"))
    k = known.select(F.col(form).alias("base")).where(F.col(form).isNotNull()).distinct()
    return c.join(k, "base").groupBy("word").agg(F.min_by("base", "place").alias("base"), F.min("place").alias("place"))


def all_known(items: DataFrame, key: str, parts: str, known: DataFrame, form: str, least: int = 2) -> DataFrame:
    """Items of ``least`` parts or more of which every one is known."""
    e = items.select(key, F.explode(F.array_distinct(parts)).alias("part"), F.size(parts).alias("n"))
    k = known.select(F.col(form).alias("part"), F.lit(True).alias("hit")).distinct()
    return e.join(k, "part", "left").groupBy(key).agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all"), F.max("n").alias("parts")).where(F.col("all") & (F.col("parts") >= least)).select(key, "parts")


def new_forms(words: DataFrame, base: str, forms: Column, taken: DataFrame, form: str) -> DataFrame:
    """Generated forms that no other word has yet: ``form, base``; of several bases the first in order."""
    g = words.where(F.col(base).isNotNull()).select(F.col(base).alias("base"), F.explode(forms).alias("form"))
    t = taken.select(F.col(form).alias("form")).distinct()
    return g.join(t, "form", "left_anti").groupBy("form").agg(F.min("base").alias("base"))


def most_common(df: DataFrame, keys: list[str], value: str, order: str, alternatives: int = 3) -> DataFrame:
    """The modal value of each key with its count and the next values, ties by first occurrence. Counted per value first."""
    c = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg(F.count(F.lit(1)).alias("n"), F.min(order).alias("first"))
    w = Window.partitionBy(*keys).orderBy(F.col("n").desc(), "first")
    r = c.withColumn("r", F.row_number().over(w)).where(F.col("r") <= alternatives + 1)
    top = r.groupBy(*keys).agg(F.array_sort(F.collect_list(F.struct("r", value, "n"))).alias("v"))
    also = F.transform(F.slice("v", 2, alternatives), lambda s: s[value])
    return top.select(*keys, F.get("v", F.lit(0))[value].alias("modal"), F.get("v", F.lit(0))["n"].alias("n"), F.array_join(also, "|").alias("also"))


def consensus(nodes: DataFrame, term: str, flag: Column, least: int = 5, share: float = 0.95) -> DataFrame:
    """Terms seen ``least`` times or more and flagged in at least ``share`` of them."""
    c = nodes.where(F.col(term).isNotNull()).groupBy(term).agg(F.sum(flag.cast("int")).alias("flagged"), F.count(F.lit(1)).alias("seen"))
    return c.where((F.col("seen") >= least) & (F.col("flagged") >= share * F.col("seen")))


def word_orders(rows: DataFrame, key: str) -> DataFrame:
    """Distinct tokens of each document with count, first place, and their ranks in five orders."""
    d = rows.groupBy(key, "token").agg(F.count(F.lit(1)).alias("n"), F.min("pos").alias("first"), F.first("bucket").alias("bucket"))
    by = lambda *o: F.row_number().over(Window.partitionBy(key).orderBy(*o))
    common = F.col("bucket").isin(*classify.CORE)
    return d.select(
        key, "token", "n", "first", "bucket",
        by("first").alias("by_input"),
        by("token").alias("by_alpha"),
        by(classify.bucket_order(F.col("bucket")), "token").alias("by_language"),
        by(common, "token").alias("by_distinctive"),
        by(F.col("n").desc(), "first").alias("by_frequency"),
    )


def seeded_sample(df: DataFrame, key: str, n: int, seed: int) -> DataFrame:
    """The same ``n`` rows whatever the partitioning: the smallest hashes of key and seed."""
    h = F.md5(F.concat(F.col(key).cast("string"), F.lit(f"#{seed}")))
    return df.withColumn("__h", h).orderBy("__h", key).limit(n).drop("__h")


def report(shared: DataFrame, covered: DataFrame, key: str) -> DataFrame:
    """``key, place, line``: totals (``coverage``) and the groups in display order (``shares``) of each key as the lines of a text."""
    pct = lambda c: F.bround(F.coalesce(F.col(c), F.lit(0.0)), 1)
    head = F.array(
        F.format_string("Tokens analyzed : %d", "tokens"),
        F.format_string("Classified      : %d  (coverage %.1f%%)", F.col("resolved"), pct("coverage")),
        F.format_string("Unknown         : %d", F.col("tokens") - F.col("resolved")),
        F.format_string("Approx. (OE/ME) : %d  (%.1f%% of classified lean on the Germanic approximation)", F.col("approximate"), pct("approximate_share")),
        F.lit(""),
        F.lit("Origin breakdown (of classified words):"),
    )
    top = covered.select(key, F.posexplode(head).alias("place", "line"))
    bars = shared.where("bucket <> 'Unknown'").select(key, (F.lit(6) + F.row_number().over(Window.partitionBy(key).orderBy("place", "bucket")) - 1).alias("place"), text.report_line(F.col("bucket"), F.col("pct_resolved")).alias("line"))
    return top.unionByName(bars)
