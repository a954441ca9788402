"""Lines of descent on flat node tables of stored trees: spines, the primary tree, components followed into their own words, readings."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame

from stemline.functions import chains, classify
from stemline.functions.text import is_affix, is_bound_part
from stemline.operators.treearrays import Trees, ids, spans
from stemline.session import cut

DEPTH = 4


def parent_joined(nodes: DataFrame) -> DataFrame:
    """Place among siblings and level of each node, from its path."""
    steps = F.split("node_path", r"\.")
    return nodes.withColumn("place", F.try_element_at(steps, F.lit(-1)).cast("int")).withColumn("level", F.size(steps) - 1)


def spines(nodes: DataFrame) -> DataFrame:
    """``word_id, tree_no, nodes, direct_nodes, spine``: the main line of each tree as an array of steps, the head first.

    From the head the line goes to the direct child with the longest direct line below it, the first of equals.
    ``direct_nodes`` counts what direct links alone reach. Steps have a ``bucket`` too if the nodes have one.
    """
    told = ["lang", "term", "rel", "certainty", *(["bucket"] if "bucket" in nodes.columns else [])]
    step = pa.struct([("pos", pa.int32()), *[(c, pa.string()) for c in told]])
    schema = f"word_id long, tree_no long, nodes int, direct_nodes int, spine array<struct<pos:int,{','.join(f'{c}:string' for c in told)}>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if not held:
            return
        table = pa.Table.from_batches(held)
        del held
        # nodes by tree and depth; a path is told from its parent's by the place behind the last point
        word, number = ids(table.column("word_id")), ids(table.column("tree_no"))
        order = np.lexsort((number, word))
        word, number, table = word[order], number[order], table.take(pa.array(order))
        tree = np.cumsum(np.append(False, (word[1:] != word[:-1]) | (number[1:] != number[:-1])))
        path, up = table.column("node_path").combine_chunks(), table.column("parent_path").combine_chunks()
        names = pa.chunked_array([path, up]).combine_chunks().dictionary_encode().indices.to_numpy()
        n = len(tree)
        node, parent = names[:n].astype(np.int64), names[n:].astype(np.int64)
        place = pc.cast(pc.replace_substring_regex(path, r"^.*\.", ""), pa.int64()).to_numpy(zero_copy_only=False)
        by = np.lexsort((node, tree))
        t = Trees(node[by], tree[by], parent[by], place[by])
        table = table.take(pa.array(by))
        head = pc.equal(table.column("parent_path"), "").to_numpy()
        direct = pc.fill_null(pc.equal(table.column("certainty"), "direct"), True).to_numpy()
        below, best = np.zeros(n, np.int64), np.full(n, -1, np.int64)
        for level in t.levels[:0:-1]:
            near = level[direct[level]]
            rows = near[np.lexsort((np.arange(len(near)), -below[near], t.up[near]))]
            first = rows[np.append(True, t.up[rows][1:] != t.up[rows][:-1])] if len(rows) else rows
            below[t.up[first]], best[t.up[first]] = below[first] + 1, first
        reach = head.copy()
        for level in t.levels[1:]:
            reach[level] = reach[t.up[level]] & direct[level]
        total, reached = np.bincount(t.tree, minlength=tree[-1] + 1), np.bincount(t.tree[reach], minlength=tree[-1] + 1)
        line, front = [], np.flatnonzero(head)
        while len(front):
            line.append(front)
            front = best[front]
            front = front[front >= 0]
        at = np.concatenate(line)
        pos = np.repeat(np.arange(len(line), dtype=np.int32), [len(x) for x in line])
        order = np.lexsort((pos, t.tree[at]))
        at, pos = at[order], pos[order]
        whole = table.take(pa.array(at))
        edges = spans(t.tree[at])
        steps = pa.StructArray.from_arrays([pa.array(pos), *[whole.column(c).combine_chunks() for c in told]], fields=list(step))
        starts = edges[:-1]
        of = t.tree[at][starts]
        lists = pa.ListArray.from_arrays(pa.array(edges.astype(np.int32)), steps)
        out = [whole.column("word_id").combine_chunks().take(pa.array(starts)), whole.column("tree_no").combine_chunks().take(pa.array(starts)), pa.array(total[of].astype(np.int32)), pa.array(reached[of].astype(np.int32)), lists]
        yield from pa.table(out, ["word_id", "tree_no", "nodes", "direct_nodes", "spine"]).to_batches(max_chunksize=20_000)

    keyed = nodes.where("node_path IS NOT NULL").select(F.col("word_id").cast("long").alias("word_id"), F.col("tree_no").cast("long").alias("tree_no"), "node_path", F.coalesce("parent_path", F.lit("")).alias("parent_path"), *told)
    return keyed.repartition("word_id").mapInArrow(run, schema)


def statuses(words: DataFrame, spined: DataFrame) -> DataFrame:
    """``word_id, status``: resolved with a tree of more than one direct node, stub with any tree, else none."""
    s = spined.groupBy("word_id").agg(F.max("direct_nodes").alias("d"))
    j = words.select("word_id").join(s, "word_id", "left")
    return j.select("word_id", F.when(F.col("d") > 1, "resolved").when(F.col("d").isNotNull(), "stub").otherwise("none").alias("status"))


def donors(spine: Column) -> Column:
    """Languages of a spine behind its head that are foreign and no bare root."""
    rest = F.filter(F.slice(spine, F.lit(2), F.greatest(F.size(spine) - 1, F.lit(0))), lambda s: ~classify.is_english_stage(s["lang"]) & (F.coalesce(s["rel"], F.lit("")) != "root"))
    return F.transform(rest, lambda s: s["lang"])


def primary(spined: DataFrame) -> DataFrame:
    """One tree a word: the first, unless it is borrowed by way of a reconstructed language that is not all of it and another tree has an attested donor."""
    d = spined.select("word_id", "tree_no", "spine", donors(F.col("spine")).alias("donors"))
    d = d.withColumn("proto", classify.is_proto(F.get("donors", F.lit(0)))).withColumn("all_proto", F.forall("donors", classify.is_proto))
    first = d.groupBy("word_id").agg(F.min_by(F.struct("tree_no", "spine", (F.size("donors") > 0).alias("any"), "proto", "all_proto"), "tree_no").alias("f"))
    attested = d.where((F.size("donors") > 0) & ~F.col("proto")).groupBy("word_id").agg(F.min_by(F.struct("tree_no", "spine"), "tree_no").alias("a"))
    j = first.join(attested, "word_id", "left")
    swap = F.col("f.any") & F.col("f.proto") & ~F.col("f.all_proto") & F.col("a").isNotNull()
    return j.select("word_id", F.when(swap, F.col("a.tree_no")).otherwise(F.col("f.tree_no")).alias("tree_no"), F.when(swap, F.col("a.spine")).otherwise(F.col("f.spine")).alias("spine"))


def components(nodes: DataFrame, prime: DataFrame, lookup: DataFrame) -> DataFrame:
    """``word_id, part_id, place``: the words that a word is formed from; affixes only where there is nothing else. ``lookup``: ``form, word_id``."""
    p = nodes.join(prime.select("word_id", "tree_no"), ["word_id", "tree_no"], "left_semi")
    p = parent_joined(p).where((F.col("parent_path") == "0") & (F.col("rel") == "formed_from") & F.col("term").isNotNull())
    bound = F.coalesce(F.col("is_affix").isin("true", "1"), F.lit(False)) | is_affix(F.col("term"))
    p = p.select("word_id", "place", "term", bound.alias("bound"))
    free = p.groupBy("word_id").agg(F.bool_or(~F.col("bound")).alias("any_free"))
    p = p.join(free, "word_id").where(~F.col("bound") | ~F.col("any_free"))
    l = lookup.select(F.col("form").alias("term"), F.col("word_id").alias("part_id"))
    return p.join(l, "term").where(F.col("part_id") != F.col("word_id")).select("word_id", "part_id", "place")


def lineages(prime: DataFrame, parts: DataFrame, depth: int = DEPTH) -> DataFrame:
    """``word_id, line``: the spine where it names a donor, else the head followed by the line of the component that reaches furthest.

    Of the components the one with most foreign steps answers, then the longest, then the first. Components are followed
    through at most ``depth`` words, and never into a word that the way there has passed.
    """
    line = F.col("spine")
    donor = F.exists(F.slice(line, F.lit(1), F.size(line)), lambda s: ~classify.is_english_stage(s["lang"]) & F.coalesce(s["rel"].isin(*classify.DONOR_RELS), F.lit(False)))
    own = prime.select("word_id", "spine", donor.alias("donor"))
    parts = parts.groupBy("word_id", "part_id").agg(F.min("place").alias("place"))
    onward = parts.join(own.where("donor").select(F.col("word_id").alias("part_id"), F.lit(True).alias("closed")), "part_id", "left")
    onward = cut(onward.select(F.col("word_id").alias("at"), "part_id", "place", F.coalesce("closed", F.lit(False)).alias("closed")))
    # the ways from words without a donor, word by word
    way = own.where("not donor").select(F.array("word_id").alias("way"), F.col("word_id").alias("at"), F.lit(0).alias("place"))
    ways = [way]
    for _ in range(depth - 1):
        step = way.join(onward, "at").where(~F.array_contains("way", F.col("part_id")))
        step = cut(step.select(F.concat("way", F.array("part_id")).alias("way"), F.col("part_id").alias("at"), onward["place"].alias("place"), "closed"))
        if not step.take(1):
            break
        ways.append(step.select("way", "at", "place"))
        way = step.where("not closed").select("way", "at", "place")
    # and back: each takes over the best of the lines behind it
    behind = None
    for w in ways[::-1]:
        j = w.join(own.withColumnRenamed("word_id", "at"), "at")
        if behind is None:
            j = j.select("way", "place", F.col("spine").alias("line"))
        else:
            j = j.join(behind, "way", "left").select("way", "place", F.when(F.col("donor") | F.col("sub").isNull(), F.col("spine")).otherwise(F.concat(F.slice("spine", 1, 1), "sub")).alias("line"))
        foreign = F.size(F.filter("line", lambda s: ~classify.is_english_stage(s["lang"])))
        up = F.slice("way", F.lit(1), F.size("way") - 1)
        behind = j if w is ways[0] else j.groupBy(up.alias("way")).agg(F.max_by("line", F.struct(foreign.alias("f"), F.size("line").alias("n"), (-F.col("place")).alias("p"))).alias("sub"))
    return own.where("donor").select("word_id", F.col("spine").alias("line")).unionByName(behind.select(F.get("way", F.lit(0)).alias("word_id"), "line"))


def resolved(lines: DataFrame, nodes: DataFrame, prime: DataFrame, states: DataFrame, languages: DataFrame) -> DataFrame:
    """Each word's answer in three readings: ``word_id, kind, direct, influence, root, root_lang, root_name, parts``.

    ``lines`` with buckets; ``states`` are ``statuses``. Kinds: ``donor`` where the line has foreign donors; ``root`` for a bare stub
    that cites one, which has no direct source or influence; ``native`` on evidence of descent from a stage of English;
    ``parts`` where only components are known (bucket Compound); ``none`` else (Unknown). ``parts`` are the components that are
    words, where there are two or more.
    """
    heads = nodes.where("parent_path = '0'").join(prime.select("word_id", "tree_no"), ["word_id", "tree_no"], "left_semi")
    heads = parent_joined(heads)
    word = ~is_bound_part(F.col("term"), F.coalesce(F.col("is_affix").isin("true", "1"), F.lit(False)))
    built = heads.where((F.col("rel") == "formed_from") & (F.col("term") != "") & word).select("word_id", "place", F.regexp_replace("term", "^-+|-+$", "").alias("part"))
    built = built.groupBy("word_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("place", "part"))), lambda s: s["part"]).alias("p")).where(F.size("p") >= 2)
    cited = heads.where("rel = 'root' AND lang IS NOT NULL").groupBy("word_id").agg(F.min_by("lang", "place").alias("lang"))
    cited = classify.with_bucket(cited, "lang", languages).select("word_id", F.struct("lang", "bucket").alias("c"))
    j = lines.join(states, "word_id").join(built, "word_id", "left").join(cited, "word_id", "left")
    j = j.withColumn("f", F.transform(chains.foreign_donors(F.col("line")), lambda s: F.struct(s["lang"].alias("lang"), s["bucket"].alias("bucket"))))
    stub = F.col("status") == "stub"
    j = j.withColumn("f", F.when((F.size("f") == 0) & stub & F.col("c").isNotNull(), F.array("c")).otherwise(F.col("f")))
    some, native = F.size("f") > 0, F.coalesce(chains.has_native_descent(F.col("line")), F.lit(False))
    kind = F.when(some & stub, "root").when(some, "donor").when(native, "native").when(F.col("p").isNotNull(), "parts").otherwise("none")
    j = j.withColumn("kind", kind).withColumn("chain", F.transform("f", lambda s: s["bucket"]))
    flat = F.when(F.col("kind") == "native", "Germanic").when(F.col("kind") == "parts", "Compound").otherwise("Unknown")
    foreign = F.col("kind").isin("donor", "root")
    view = lambda pick: F.when(F.col("kind") == "donor", pick).otherwise(F.when(foreign, "Unknown").otherwise(flat))
    apart = F.filter("f", lambda s: ~classify.is_pie(s["lang"]))
    last = F.try_element_at("f", F.lit(-1))
    to_pie = (F.size(apart) > 0) & classify.is_pie(last["lang"])
    root_lang = F.when(foreign, F.when(to_pie, F.try_element_at(apart, F.lit(-1))["lang"]).otherwise(last["lang"]))
    stages = F.filter("line", lambda s: classify.is_english_stage(s["lang"]))
    stage = F.when(F.size(stages) > 1, F.try_element_at(stages, F.lit(-1))["lang"]).otherwise("English (native core)")
    j = j.withColumn("root_lang", root_lang).withColumn("to_pie", to_pie)
    return j.select(
        "word_id", "kind", view(F.get("chain", F.lit(0))).alias("direct"), view(chains.influence(F.col("chain"))).alias("influence"),
        F.when(foreign, F.try_element_at("chain", F.lit(-1))).otherwise(flat).alias("root"), "root_lang",
        F.when(F.col("kind") == "native", stage).otherwise(F.concat("root_lang", F.when(F.col("to_pie"), " (from PIE)").otherwise(""))).alias("root_name"), F.col("p").alias("parts"),
    )


def hand_split(answers: DataFrame, split_words: DataFrame, word: str) -> DataFrame:
    """Which answers a split made by hand overrules: those of words that have one (``split_words``) and whose own answer is another word's (``via``), a bare root, or lost its components to the affix filter (``collapsed``)."""
    has = split_words.select(F.lower(F.col(word)).alias("__w"), F.lit(True).alias("__h")).distinct()
    j = answers.join(has, F.lower(F.col(word)) == F.col("__w"), "left")
    weak = F.col("via").isNotNull() | (F.col("kind") == "root") | F.coalesce("collapsed", F.lit(False))
    return j.withColumn("by_hand", F.coalesce("__h", F.lit(False)) & F.coalesce(weak, F.lit(False))).drop("__w", "__h")


def readings(lines: DataFrame, languages: DataFrame) -> DataFrame:
    """``word_id, direct, influence, root, root_name`` of each line."""
    e = lines.select("word_id", F.posexplode("line").alias("i", "s")).select("word_id", "i", "s.lang", "s.term", "s.rel")
    eras = languages.groupBy(F.col("name").alias("lang")).agg(F.min("era_start").alias("era_start"), F.min("era_end").alias("era_end"))
    e = classify.with_bucket(e, "lang", languages).join(eras, "lang", "left")
    steps = F.transform(F.array_sort(F.collect_list(F.struct("i", "lang", "term", "rel", "bucket", "era_start", "era_end"))), lambda s: s)
    g = e.groupBy("word_id").agg(steps.alias("line"))
    behind = F.slice("line", F.lit(2), F.greatest(F.size("line") - 1, F.lit(0)))
    g = g.withColumn("rest", behind)
    g = g.withColumn("stages", F.filter("rest", lambda s: classify.is_english_stage(s["lang"])))
    g = g.withColumn("abroad", F.filter("rest", lambda s: ~classify.is_english_stage(s["lang"]) & F.coalesce(s["rel"] != "root", F.lit(True))))
    g = g.withColumn("foreign", chains.donor_steps(F.col("abroad")))
    g = g.withColumn("roots", F.filter("rest", lambda s: F.coalesce(s["rel"] == "root", F.lit(False))))
    g = chains.with_record(g, "foreign", "roots", "stages")
    r = F.col("record")
    return g.select("word_id", *[chains.view(r, m).alias(m) for m in chains.MODES], chains.root_name(r).alias("root_name"), chains.usable(r).alias("usable"))


def corrected(readings_: DataFrame, fixes: DataFrame) -> DataFrame:
    """Corrections (``word_id, p``) overrule only where the direct bucket disagrees."""
    j = readings_.join(fixes.select("word_id", F.col("p").alias("__p")), "word_id", "left")
    differs = F.col("__p").isNotNull() & (F.col("__p") != F.col("direct"))
    return j.withColumn("corrected", differs).withColumn("direct", F.when(F.col("corrected"), F.col("__p")).otherwise(F.col("direct"))).drop("__p")


def inherited_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Words without a root take that of the word they come from, over and over until nothing changes: ``word, root, via``.

    ``links``: ``word, base``; ``roots``: ``word, root``. A word with several bases takes the first in order; each round
    joins only the words found in the round before, so cycles end by themselves.
    """
    done = cut(roots.where(F.col("root").isNotNull()).groupBy("word").agg(F.min("root").alias("root")).withColumn("via", F.col("word")))
    fresh = done
    while True:
        step = links.join(fresh.select(F.col("word").alias("base"), "root", "via"), "base")
        step = step.join(done.select("word"), "word", "left_anti").groupBy("word").agg(F.min(F.struct("base", "root", "via")).alias("s")).select("word", "s.root", "s.via")
        fresh = cut(step)
        if not fresh.take(1):
            return done
        done = cut(done.unionByName(fresh))


def stubs(nodes: DataFrame) -> DataFrame:
    """``word_id, tree_no, stub``: nothing below the head but childless roots and affixes (or nothing at all)."""
    inner = nodes.where("parent_path <> ''").select("word_id", "tree_no", F.col("parent_path").alias("node_path")).distinct().withColumn("inner", F.lit(True))
    n = nodes.join(inner, ["word_id", "tree_no", "node_path"], "left")
    yes = lambda c: F.coalesce(F.col(c).isin("true", "1"), F.lit(False))
    thin = F.col("inner").isNull() & (yes("is_root") | yes("is_affix") | is_affix(F.col("term")))
    return n.groupBy("word_id", "tree_no").agg(F.bool_and((F.col("parent_path") == "") | thin).alias("stub"))


def trees_drawn(nodes: DataFrame, prime: DataFrame, lookup: DataFrame, depth: int = DEPTH) -> DataFrame:
    """The tree of each word with every etymology of it and its components opened into their own words' trees, as node rows.

    ``word_id, path, parent, branch, lang, term, rel, certainty, affix, opened``. ``lookup``: ``form, word_id``. Paths are places from the head (0),
    the trees' branches one after the other; ``opened`` counts the components behind one another. A component (``formed_from``)
    that has nothing below it but root citations is opened into what the primary tree of its own word holds below its head,
    which then comes before the citations, unless it is spelled as the head or as a component above it, whatever the case,
    or ``depth`` components lie above it. A branch of one node that an earlier branch shows already is left out.
    """
    tree = ["word_id", "tree_no"]
    affix = F.coalesce(F.col("is_affix").isin("true", "1"), F.lit(False)) | is_affix(F.col("term"))
    n = nodes.select(*tree, "node_path", "parent_path", "lang", "term", "rel", "certainty", affix.alias("affix"))
    grown = n.where("parent_path <> '' AND coalesce(rel, '') <> 'root'").select(*tree, F.col("parent_path").alias("node_path")).distinct().withColumn("grown", F.lit(True))
    n = n.join(grown, [*tree, "node_path"], "left")
    # the form under which a node that may be opened is looked up
    closed = (F.col("rel") == "formed_from") & (F.col("term") != "") & F.col("grown").isNull()
    n = cut(n.withColumn("form", F.when(closed, F.lower("term"))).withColumn("seek", F.when(closed, F.col("term"))).drop("grown"))
    heads = n.where("parent_path = ''").join(prime.select(*tree), tree, "left_semi").groupBy("word_id").agg(F.min(F.lower("term")).alias("head"))
    below = n.where("parent_path <> ''")
    told = ("lang", "term", "rel", "certainty", "affix", "form", "seek")
    inner = below.join(prime.select(*tree), tree, "left_semi").select(F.col("word_id").alias("part_id"), F.col("node_path").alias("sub"), *[F.col(c).alias(f"s_{c}") for c in told])
    place = lambda path: F.transform(F.slice(F.split(path, r"\."), F.lit(2), F.lit(1 << 20)), lambda x: x.cast("long"))
    # places of a tree's nodes: the tree's number before the place of its branch, so that branches follow one another
    start = below.join(heads, "word_id").select("word_id", F.concat(F.array(F.col("tree_no")), place(F.col("node_path"))).alias("path"), *told, F.array(F.coalesce("head", F.lit(""))).alias("seen"), F.lit(0).alias("opened"))
    level, levels = cut(start), []
    known = lookup.select(F.col("form").alias("seek"), F.col("word_id").alias("part_id"))
    for k in range(depth + 1):
        levels.append(level)
        if k == depth:
            break
        open_ = level.where(F.col("form").isNotNull() & ~F.array_contains("seen", F.col("form")))
        # what is opened goes before the root citations, which keep their places: places below zero
        more = open_.join(known, "seek").withColumnRenamed("form", "f").drop(*told).join(inner, "part_id")
        sub = place(F.col("sub"))
        path = F.concat("path", F.array(F.get(sub, F.lit(0)) - F.lit(1 << 40)), F.slice(sub, F.lit(2), F.lit(1 << 20)))
        level = cut(more.select("word_id", path.alias("path"), *[F.col(f"s_{c}").alias(c) for c in told], F.concat("seen", F.array("f")).alias("seen"), (F.col("opened") + 1).alias("opened")))
        if not level.take(1):
            break
    out = levels[0]
    for x in levels[1:]:
        out = out.unionByName(x)
    out = cut(out.select("word_id", "path", *told[:5], "opened").withColumn("branch", F.slice("path", 1, 2)).withColumn("parent", F.slice("path", F.lit(1), F.size("path") - 1)))
    # a branch alone is redundant if an earlier one has its node
    first = out.groupBy("word_id", "lang", "term").agg(F.min("branch").alias("first")).withColumnsRenamed({"word_id": "w", "lang": "l", "term": "t"})
    size = out.groupBy("word_id", "branch").agg(F.count(F.lit(1)).alias("size"))
    alone = size.where("size = 1").join(out, ["word_id", "branch"]).join(first, (F.col("word_id") == F.col("w")) & F.col("lang").eqNullSafe(F.col("l")) & F.col("term").eqNullSafe(F.col("t")))
    return out.join(alone.where(F.col("first") < F.col("branch")).select("word_id", "branch"), ["word_id", "branch"], "left_anti").select("word_id", "path", "parent", "branch", "lang", "term", "rel", "certainty", "affix", "opened")


def drawn(trees: DataFrame, nodes: DataFrame) -> DataFrame:
    """``word_id, lang``: the languages that the drawn tree of each word shows (``trees_drawn``), its head's among them."""
    return trees.select("word_id", "lang").unionByName(nodes.where("parent_path = ''").select("word_id", "lang")).where("lang IS NOT NULL").distinct()


def drawn_stubs(trees: DataFrame) -> DataFrame:
    """``word_id, stub``: whether a drawn tree says nothing: all its branches are single nodes, roots or affixes."""
    b = trees.groupBy("word_id", "branch").agg(F.count(F.lit(1)).alias("n"), F.bool_and(F.coalesce(F.col("rel") == "root", F.lit(False)) | F.col("affix")).alias("thin"))
    return b.groupBy("word_id").agg(F.bool_and((F.col("n") == 1) & F.col("thin")).alias("stub"))


def tree_answers(asked: DataFrame, word: str, own: DataFrame, candidates: Column, splits: DataFrame, fixes: DataFrame, shown: DataFrame, most: int = 5) -> DataFrame:
    """``word, source, forms, fixed``: whose drawn tree answers for each word.

    ``own``: ``form, word_id, stub``. The tree of the word itself unless it is a stub; else that of the first candidate form that has one; else one
    branch for each part (``word, parts``) where any part has a tree; else the stub; else nothing. Parts are answered for in the same way, once each.
    ``fixes`` (``word, bucket``) are honoured where no language of the tree (``shown``: ``word_id, lang, bucket``) is of that group or name: then ``fixed`` is set and the
    chain of the fix replaces the tree.
    """
    o = own.groupBy("form").agg(F.min_by(F.struct("word_id", "stub"), F.struct("stub", "word_id")).alias("o")).select("form", "o.word_id", "o.stub")
    a = asked.select(F.col(word).alias("word")).where("word IS NOT NULL").distinct()
    mine = a.join(o.select(F.col("form").alias("f0"), F.col("word_id").alias("id0"), F.col("stub").alias("s0")), F.col("word") == F.col("f0"), "left")
    real = o.where("not stub").select("form")
    other = a.select("word", F.posexplode(candidates).alias("place", "form")).join(real, "form").groupBy("word").agg(F.min_by("form", "place").alias("other"))
    p = splits.select("word", "parts").join(a, "word", "left_semi")
    any_part = p.select("word", F.explode("parts").alias("form")).join(real, "form", "left_semi").select("word").distinct()
    p = p.join(any_part, "word", "left_semi").groupBy("word").agg(F.any_value("parts").alias("parts"))
    j = mine.join(other, "word", "left").join(p, "word", "left")
    cases = [(~F.col("s0"), "own", F.array("word")), (F.col("other").isNotNull(), "form", F.array("other")), (F.col("parts").isNotNull(), "parts", F.col("parts")), (F.col("f0").isNotNull(), "stub", F.array("word"))]
    source, forms = F.lit("none"), F.array().cast("array<string>")
    for hit, name, value in cases[::-1]:
        hit = F.coalesce(hit, F.lit(False))
        source, forms = F.when(hit, F.lit(name)).otherwise(source), F.when(hit, value).otherwise(forms)
    j = j.select("word", "id0", source.alias("source"), forms.alias("forms"))
    named = shown.select(F.col("word_id").alias("id0"), F.explode(F.array("lang", "bucket")).alias("bucket")).where("bucket IS NOT NULL").distinct()
    fixes = fixes.groupBy(F.lower("word").alias("fw")).agg(F.min("bucket").alias("bucket"))
    f = j.where("source = 'own'").join(fixes, F.lower("word") == F.col("fw")).join(named, ["id0", "bucket"], "left_anti").select("word", F.lit(True).alias("fixed"))
    return j.join(f, "word", "left").select("word", "source", "forms", F.coalesce("fixed", F.lit(False)).alias("fixed"))


def strays(lines: DataFrame, shown: DataFrame, readings_: DataFrame | None = None) -> DataFrame:
    """``word_id, lang``: languages of a word's line, and of the root its answer (``resolved``) names, that ``shown`` (``word_id, lang``) lacks for that word; none are expected."""
    told = lines.select("word_id", F.explode(F.array_distinct(F.transform("line", lambda s: s["lang"]))).alias("lang"))
    if readings_ is not None:
        told = told.unionByName(readings_.select("word_id", F.col("root_lang").alias("lang"))).distinct()
    return told.where("lang IS NOT NULL").join(shown.select("word_id", "lang").distinct(), ["word_id", "lang"], "left_anti").select("word_id", "lang")
