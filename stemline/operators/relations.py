"""Grouped relation rows to chains, and links between words to inherited answers."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
import pyspark.sql.types as T
from pyspark.sql import DataFrame, Window

from stemline.functions import chains, classify, text
from stemline.session import cut

#: Relation names by what they state.
BORROWED = ("borrowed_from", "learned_borrowing_from", "semi_learned_borrowing_from", "orthographic_borrowing_from", "unadapted_borrowing_from", "calque_of")
KINDS = {**{r: "borrowed" for r in BORROWED}, "derived_from": "derived", "inherited_from": "inherited", "has_root": "root"}
MARKERS = ("group_derived_root", "group_related_root", "group_affix_root")
NO_DONORS = ("Translingual",)

def expanded(rows: DataFrame, order: str = "pos") -> DataFrame:
    """``term_id, term, path, kind, lang, related``: ancestry rows in the order of their groups, groups within groups below their opener.

    Groups are followed however deep they lie; the rows of a term, which one dictionary entry bounds, are walked in one
    task. A row whose group is open above it, as where a group holds itself, is left out, so loops end.
    """
    r = rows.where(F.col("reltype").isin(*KINDS, *MARKERS) | F.col("group_tag").isNotNull())
    r = r.withColumn("path", F.lpad(F.col(order).cast("string"), 9, "0"))
    out = r.where(F.col("parent_tag").isNull())
    if r.where(F.col("parent_tag").isNotNull()).take(1):
        out = _walked(r)
    kept = out.where(F.col("reltype").isin(*KINDS) & F.col("related_lang").isNotNull() & ~F.col("related_lang").isin(*NO_DONORS))
    return kept.select("term_id", "term", "path", classify.lookup(KINDS, F.col("reltype")).alias("kind"), F.col("related_lang").alias("lang"), F.col("related_term").alias("related"))


def _walked(rows: DataFrame) -> DataFrame:
    """Rows that a walk from the top rows of their term reaches, with the path there."""
    said = ("term", "reltype", "related_lang", "related_term")
    g = rows.groupBy("term_id").agg(F.collect_list(F.struct("path", "group_tag", "parent_tag", *said)).alias("rows"))
    schema = T.StructType([g.schema["term_id"], T.StructField("path", T.StringType()), *[T.StructField(c, T.StringType()) for c in said]])

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            flat, ends = batch.column(1).flatten(), pc.list_value_length(batch.column(1)).to_pylist()
            label, tag, above = (flat.field(c).to_pylist() for c in ("path", "group_tag", "parent_tag"))
            of, at, paths, lo = [], [], [], 0
            for t, n in enumerate(ends):
                kids: dict[str, list[int]] = {}
                open_ = []
                for i in range(lo, lo + n):
                    if above[i] is None:
                        open_.append((i, label[i], (tag[i],)))
                    else:
                        kids.setdefault(above[i], []).append(i)
                lo += n
                while open_:
                    i, path, seen = open_.pop()
                    of.append(t)
                    at.append(i)
                    paths.append(path)
                    if tag[i] is not None:
                        open_ += [(k, f"{path}/{label[k]}", (*seen, tag[k])) for k in kids.get(tag[i], ()) if tag[k] is None or tag[k] not in seen]
            at = pa.array(at, pa.int64())
            columns = [batch.column(0).take(pa.array(of, pa.int64())), pa.array(paths, pa.string()), *[flat.field(c).take(at) for c in said]]
            yield from pa.Table.from_arrays(columns, schema.names).to_batches(max_chunksize=20_000)

    return g.mapInArrow(run, schema)


def records(rows: DataFrame, languages: DataFrame, order: str = "pos") -> DataFrame:
    """``term_id, term, record``: the chain record of each term; separate groups by the depth hint of their first language (of a root only where there is no other), roots last."""
    e = classify.with_bucket(expanded(rows, order), "lang", languages)
    eras = languages.groupBy(F.col("name").alias("lang")).agg(F.min("era_start").alias("era_start"), F.min("era_end").alias("era_end"))
    e = e.join(eras, "lang", "left").withColumn("item", F.element_at(F.split("path", "/"), 1))
    first = F.first("lang").over(Window.partitionBy("term_id", "item").orderBy(F.col("kind") == "root", "path"))
    e = e.withColumn("depth", classify.depth_hint(first))
    step = F.struct("depth", "item", "path", "lang", F.col("related").alias("term"), F.col("kind").alias("rel"), "bucket", "era_start", "era_end")
    g = e.groupBy("term_id").agg(F.min("term").alias("term"), F.array_sort(F.collect_list(step)).alias("line"))
    english = lambda s: classify.is_english_stage(s["lang"])
    g = g.withColumn("stages", F.filter("line", lambda s: english(s) & (s["rel"] != "root")))
    g = g.withColumn("foreign", F.filter("line", lambda s: ~english(s) & (s["rel"] != "root"))).withColumn("roots", F.filter("line", lambda s: s["rel"] == "root"))
    return chains.with_record(g, "foreign", "roots", "stages").select("term_id", "term", "record")


def patched_stubs(records_: DataFrame, pointers: DataFrame, hubs: tuple[str, ...] = chains.HUBS, inflected: DataFrame | None = None) -> DataFrame:
    """Bare roots and missing words take the record of the word they point at (``term, base, priority``), until nothing changes.

    A base without any record stands for the word it is an inflected form of (``inflected``: ``form, base``), else for the
    first of its stems, that has a record of more than a bare root. Only reliable records are handed on; pointers to affixes
    are none; ``via`` names the word whose record it is. Each round needs new terms, so cycles end by themselves.
    """
    real = F.coalesce(F.col("record.prox_kind") != "root", F.lit(False))
    whole = records_.groupBy("term").agg(F.min_by("record", "term_id").alias("record"))
    done = cut(whole.where(real).withColumn("via", F.lit(None).cast("string")))
    base = F.trim(F.regexp_replace("base", "#.*$", ""))
    links = pointers.withColumn("base", base).where(~F.startswith("base", F.lit("-")) & ~F.endswith("base", F.lit("-")))
    lost = links.join(whole.select(F.col("term").alias("base")), "base", "left_anti").select("base", F.lower("base").alias("low")).distinct()
    stems = lost.select("base", F.posexplode(text.stem_candidates(F.col("low"))).alias("place", "stem"))
    if inflected is not None:
        forms = inflected.select(F.col("form").alias("low"), F.col("base").alias("stem")).where(F.lower("stem") != F.col("low"))
        stems = stems.unionByName(lost.join(forms, "low").select("base", F.lit(-1).alias("place"), "stem"))
    stems = cut(stems)
    fresh = done
    ok = lambda word: F.coalesce(chains.is_reliable_root(F.col("record.chain"), F.col(word), hubs), F.lit(False))
    while True:
        exact = fresh.where(ok("term")).select(F.col("term").alias("base"), "record", F.coalesce("via", "term").alias("via"))
        # the first stem with a record decides, even if that is then not reliable
        held = stems.join(done.select(F.col("term").alias("base")), "base", "left_anti").join(done.select(F.col("term").alias("stem"), "record", "via"), "stem")
        held = held.groupBy("base").agg(F.min_by(F.struct("record", F.coalesce("via", "stem").alias("via"), "stem"), F.struct("place", "stem")).alias("s")).select("base", "s.record", "s.via", "s.stem").where(ok("stem")).drop("stem")
        step = links.join(done.select("term"), "term", "left_anti").join(exact.unionByName(held), "base")
        fresh = cut(step.groupBy("term").agg(F.min_by(F.struct("record", "via"), F.struct("priority", "base")).alias("s")).select("term", "s.record", "s.via"))
        if not fresh.take(1):
            break
        done = cut(done.unionByName(fresh))
    left = whole.join(done.select("term"), "term", "left_anti").withColumn("via", F.lit(None).cast("string"))
    return done.unionByName(left)


def root_candidates(rows: DataFrame, reltypes: tuple[str, ...], order: str = "pos") -> DataFrame:
    """``term, bases``: the English words that a term's rows of these kinds name, in file order."""
    r = rows.where(F.col("reltype").isin(*reltypes) & (F.col("related_lang") == "English") & F.col("related_term").isNotNull())
    return r.groupBy("term").agg(F.transform(F.array_sort(F.collect_list(F.struct(order, "related_term"))), lambda x: x["related_term"]).alias("bases"))


#: Relations that may name a foreign root outright, the most telling first.
ROOT_RELATIONS = ("has_prefix_with_root", "has_confix", "has_affix", "has_prefix")


def foreign_roots(records_: DataFrame, rows: DataFrame, languages: DataFrame, order: str = "pos") -> DataFrame:
    """Bare roots and words without a record that cite a word of a foreign language as what they are built on: ``term, record`` of that one step.

    Of several citations the one by the most telling relation counts, the first in order of equals.
    """
    answered = records_.where(F.coalesce(F.col("record.prox_kind") != "root", F.lit(False))).select("term")
    rank = F.array_position(F.array(*[F.lit(r) for r in ROOT_RELATIONS]), F.col("reltype"))
    cited = rows.where(F.col("reltype").isin(*ROOT_RELATIONS) & F.col("related_lang").isNotNull() & ~F.col("related_lang").isin("English", *NO_DONORS))
    best = cited.join(answered, "term", "left_anti").groupBy("term").agg(F.min_by(F.struct("related_lang", "related_term"), F.struct(rank.alias("r"), F.col(order).alias("o"))).alias("b"))
    best = classify.with_bucket(best.select("term", F.col("b.related_lang").alias("lang"), F.col("b.related_term").alias("root_term")), "lang", languages)
    record = F.struct(
        F.col("bucket").alias("p"), F.col("bucket").alias("d"), F.array("bucket").alias("chain"), F.lit("derived").alias("prox_kind"), F.col("lang").alias("root_lang"), F.lit(False).alias("root_pie"), "root_term", F.lit(False).alias("native")
    )
    return best.select("term", record.alias("record"))


def enrichment_targets(records_: DataFrame, proto: DataFrame) -> DataFrame:
    """``lang, term``: reconstructed roots that no record takes back to PIE yet, once each. ``proto``: ``name`` of the languages that are only reconstructed."""
    r = records_.select(F.col("record.root_lang").alias("lang"), F.col("record.root_term").alias("term"), F.col("record.root_pie").alias("pie"))
    return r.where("NOT coalesce(pie, false) AND term <> ''").join(proto.select(F.col("name").alias("lang")), "lang", "left_semi").select("lang", "term").distinct()


def enriched(records_: DataFrame, answers: DataFrame, proto: DataFrame) -> DataFrame:
    """Records whose reconstructed root an answer (``lang, term, deeper``) takes to PIE say so."""
    to_pie = answers.where(F.col("deeper").isin(*classify.PIE_NAMES)).join(proto.select(F.col("name").alias("lang")), "lang", "left_semi").select(F.col("lang").alias("__l"), F.col("term").alias("__t"), F.lit(True).alias("__p")).distinct()
    j = records_.join(to_pie, (F.col("record.root_lang") == F.col("__l")) & (F.col("record.root_term") == F.col("__t")), "left")
    return j.withColumn("record", F.col("record").withField("root_pie", F.coalesce(F.col("record.root_pie"), F.lit(False)) | F.coalesce("__p", F.lit(False)))).drop("__l", "__t", "__p")


def compounds(pointers: DataFrame, known: DataFrame, least: int = 2) -> DataFrame:
    """``word, parts`` of words whose every part (``word, place, part``) is known and that are not known themselves."""
    k = known.select(F.lower("term").alias("low"), F.lit(True).alias("hit")).distinct()
    p = pointers.join(k, F.lower("part") == F.col("low"), "left")
    g = p.groupBy("word").agg(F.bool_and(F.coalesce("hit", F.lit(False))).alias("all"), F.array_sort(F.collect_list(F.struct("place", "part"))).alias("p"))
    own = known.select(F.lower("term").alias("own"))
    return g.where(F.col("all") & (F.size("p") >= least)).join(own, F.lower("word") == F.col("own"), "left_anti").select("word", F.transform("p", lambda s: s["part"]).alias("parts"))


def without_orphans(branches: DataFrame, key: str) -> DataFrame:
    """Branches (``key, branch, lang, term, size``) of one node go where another branch of the key holds the same form."""
    other = branches.where("size > 1 OR inner").select(F.col(key).alias("k"), F.col("lang").alias("l"), F.col("term").alias("t"), F.col("branch").alias("b")).distinct()
    cond = (F.col(key) == F.col("k")) & F.col("lang").eqNullSafe(F.col("l")) & F.col("term").eqNullSafe(F.col("t")) & (F.col("branch") != F.col("b"))
    single = branches.where("size = 1").join(other, cond, "left_anti").select(branches.columns)
    return branches.where("size > 1").unionByName(single)
