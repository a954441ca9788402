"""Descendant forests: trees that hold a form, climbing to the topmost tree, splicing, spelling variants, budgets and marks."""

from __future__ import annotations

import json
from collections.abc import Iterator
from hashlib import blake2b

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import pyspark.sql.functions as F
from pyspark.sql import Column, DataFrame, Window

from stemline.operators.hierarchy import hierarchy
from stemline.operators.treearrays import Trees, distinct_nodes, ids, spans
from stemline.session import cut, partitions_for

CLIMB = 6
BUDGET = 3000
_ROWS_PER_TASK = 200_000


def trees_containing(nodes: DataFrame, trees: DataFrame, most: int = 4) -> DataFrame:
    """For each form the largest trees that hold it: ``lang, term, tree_id, node_count, rank``."""
    held = nodes.where(F.col("term").isNotNull() & F.col("lang").isNotNull()).select("lang", "term", "tree_id").distinct()
    t = trees.select("tree_id", "node_count")
    w = Window.partitionBy("lang", "term").orderBy(F.col("node_count").desc_nulls_last(), "tree_id")
    return held.join(t, "tree_id").withColumn("rank", F.row_number().over(w)).where(F.col("rank") <= most).select("lang", "term", "tree_id", "node_count", "rank")


def tree_of_form(trees: DataFrame) -> DataFrame:
    """The largest tree that a form is the root of: ``lang, term, tree_id``."""
    order = F.struct(F.coalesce("node_count", F.lit(-1)), -F.col("tree_id"))
    t = trees.where(F.col("term").isNotNull() & F.col("lang").isNotNull())
    return t.groupBy("lang", "term").agg(F.max_by("tree_id", order).alias("tree_id"))


def parent_trees(nodes: DataFrame, trees: DataFrame) -> DataFrame:
    """For each root form the largest tree of another term that holds it as a node: ``lang, term, up_id, up_lang, up_term``."""
    forms = trees.select("lang", "term").where(F.col("term").isNotNull() & F.col("lang").isNotNull()).distinct()
    held = nodes.select("lang", "term", F.col("tree_id").alias("up_id")).join(forms, ["lang", "term"], "left_semi").distinct()
    t = trees.select(F.col("tree_id").alias("up_id"), F.col("lang").alias("up_lang"), F.col("term").alias("up_term"), "node_count")
    j = held.join(t, "up_id").where(F.col("up_term") != F.col("term"))
    order = F.struct(F.coalesce("node_count", F.lit(-1)), -F.col("up_id"))
    best = j.groupBy("lang", "term").agg(F.max_by(F.struct("up_id", "up_lang", "up_term"), order).alias("b"))
    return best.select("lang", "term", "b.up_id", "b.up_lang", "b.up_term")


def climb(nodes: DataFrame, trees: DataFrame, most: int = CLIMB) -> DataFrame:
    """Every root form with the topmost tree it goes back to: ``lang, term, top_id, top_lang, top_term, steps``. Cycles stop the climb."""
    up = cut(parent_trees(nodes, trees))
    form = lambda l, t: F.concat_ws("\u0001", l, t)
    state = tree_of_form(trees).select(
        "lang", "term", F.col("tree_id").alias("top_id"), F.col("lang").alias("top_lang"), F.col("term").alias("top_term"), F.array(form(F.col("lang"), F.col("term"))).alias("seen"), F.lit(True).alias("open")
    )
    u = up.select(F.col("lang").alias("l"), F.col("term").alias("t"), "up_id", "up_lang", "up_term")
    for _ in range(most):
        j = state.join(u, (F.col("top_lang") == F.col("l")) & (F.col("top_term") == F.col("t")) & F.col("open"), "left")
        go = F.col("up_id").isNotNull() & ~F.array_contains("seen", form(F.col("up_lang"), F.col("up_term")))
        go = F.coalesce(go, F.lit(False))
        state = j.select(
            "lang", "term",
            F.when(go, F.col("up_id")).otherwise(F.col("top_id")).alias("top_id"),
            F.when(go, F.col("up_lang")).otherwise(F.col("top_lang")).alias("top_lang"),
            F.when(go, F.col("up_term")).otherwise(F.col("top_term")).alias("top_term"),
            F.when(go, F.concat("seen", F.array(form(F.col("up_lang"), F.col("up_term"))))).otherwise(F.col("seen")).alias("seen"),
            go.alias("open"),
        )
    return state.select("lang", "term", "top_id", "top_lang", "top_term", (F.size("seen") - 1).alias("steps"))


def place(ordinal: Column, node: Column) -> Column:
    """A label whose text order is sibling order."""
    return F.concat(F.lpad(F.coalesce(ordinal, F.lit(0)).cast("string"), 6, "0"), F.lit("."), F.lpad(node.cast("string"), 12, "0"))


def breadth_first(nodes: DataFrame) -> DataFrame:
    """``tree_id, node_id, depth, path, rank``: nodes in breadth-first order of their tree; nodes on loops are left out."""
    h = hierarchy(nodes, paths=True, label=place(F.col("ordinal"), F.col("node_id"))).where("depth >= 0")
    return ranked(h, "tree_id", "depth", "path")


def ranked(df: DataFrame, group: str, *order: str) -> DataFrame:
    """Adds the ``rank`` of each row in its group. Rows are laid out by ranges of group and order, so a group of any size is many tasks' work: each counts its rows, and a row's rank is its place there behind what lies before."""
    laid = cut(df.repartitionByRange(group, *order).withColumn("__p", F.spark_partition_id()))
    counts = laid.groupBy(group, "__p").agg(F.count(F.lit(1)).alias("__n"))
    # a row a task and group: a group has no more of them than there are tasks
    before = counts.select(F.col(group).alias("__g"), F.col("__p").alias("__q"), (F.sum("__n").over(Window.partitionBy(group).orderBy("__p")) - F.col("__n")).alias("__before"))
    here = laid.withColumn("__r", F.row_number().over(Window.partitionBy(group, "__p").orderBy(*order)))
    j = here.join(before, F.col(group).eqNullSafe(F.col("__g")) & (F.col("__p") == F.col("__q")))
    return j.withColumn("rank", F.col("__r") + F.col("__before")).drop("__p", "__q", "__g", "__r", "__before")


def pruned(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Per tree its nodes, those shown within the budget, and whether it was cut."""
    n = hierarchy(nodes).where("depth >= 0").groupBy("tree_id").agg(F.count(F.lit(1)).alias("total"))
    return n.withColumn("shown", F.least("total", F.lit(budget).cast("long"))).withColumn("truncated", F.col("shown") < F.col("total"))


def pruned_nodes(nodes: DataFrame, budget: int = BUDGET) -> DataFrame:
    """``tree_id, node_id, rank, pruned``: the nodes shown within the budget, shallow ones first, each with how many of its direct children were cut."""
    b = cut(breadth_first(nodes).select("tree_id", "node_id", "rank"))
    parent = nodes.where("node_id IS NOT NULL").groupBy("tree_id", "node_id").agg(F.min("parent_id").alias("parent_id"))
    gone = b.where(F.col("rank") > budget).join(parent, ["tree_id", "node_id"]).groupBy("tree_id", F.col("parent_id").alias("node_id")).agg(F.count(F.lit(1)).alias("pruned"))
    return b.where(F.col("rank") <= budget).join(gone, ["tree_id", "node_id"], "left").withColumn("pruned", F.coalesce("pruned", F.lit(0)))


def on_path(nodes: DataFrame, match: Column) -> DataFrame:
    """``tree_id, node_id, match``: nodes that match and all nodes above them, from the sum of the matches below each node."""
    hit = F.coalesce(match, F.lit(False)).cast("int")
    h = hierarchy(nodes, weight=hit).where("depth >= 0")
    own = nodes.where(match).select("tree_id", "node_id").distinct().withColumn("match", F.lit(True))
    j = h.join(own, ["tree_id", "node_id"], "left").withColumn("match", F.coalesce("match", F.lit(False)))
    return j.where(F.col("match") | (F.col("below") > 0)).select("tree_id", "node_id", "match")


def splice(nodes: DataFrame, trees: DataFrame, most: int = CLIMB) -> DataFrame:
    """Leaves that are roots of other trees are continued there: ``top, path, tree_id, node_id, lang, term, depth, spliced``.

    A form is continued once under a top, the leaf with the smallest path winning; what is continued earlier in the
    walk by rounds comes first; nothing is continued from ``most`` levels below the top on.
    """
    h = hierarchy(nodes, paths=True, label=place(F.col("ordinal"), F.col("node_id"))).where("depth >= 0").select("tree_id", "node_id", "depth", "path")
    n = nodes.select("tree_id", "node_id", "parent_id", "lang", "term")
    inner = n.select("tree_id", F.col("parent_id").alias("node_id")).where(F.col("node_id").isNotNull()).distinct().withColumn("inner", F.lit(True))
    body = cut(h.join(n.drop("parent_id"), ["tree_id", "node_id"]).join(inner, ["tree_id", "node_id"], "left").withColumn("leaf", F.col("inner").isNull()).drop("inner"))
    roots = tree_of_form(trees).select("lang", "term", F.col("tree_id").alias("next"))
    tops = trees.select(F.col("tree_id").alias("top"), "lang", "term")
    seen = tops.select("top", "lang", "term")
    grown = body.withColumn("top", F.col("tree_id")).withColumn("depth", F.col("depth") + 1)
    done: list[DataFrame] = []
    fresh = grown.select("top", "path", "tree_id", "node_id", "lang", "term", "depth", "leaf")
    for _ in range(most):
        c = fresh.where(F.col("leaf") & (F.col("depth") < most)).join(roots, ["lang", "term"]).join(seen, ["top", "lang", "term"], "left_anti")
        w = cut(c.groupBy("top", "lang", "term").agg(F.min(F.struct("path", "depth", "next")).alias("w")).select("top", "lang", "term", "w.path", "w.depth", "w.next"))
        marked = w.select("top", F.col("path").alias("at"), F.lit(True).alias("spliced"))
        done.append(fresh.join(marked, (fresh["top"] == marked["top"]) & (fresh["path"] == marked["at"]), "left").select(fresh["*"], F.coalesce("spliced", F.lit(False)).alias("spliced")))
        if not w.take(1):
            fresh = None
            break
        more = w.select("top", F.col("path").alias("at"), F.col("depth").alias("under"), F.col("next").alias("tree_id"))
        fresh = cut(more.join(body, "tree_id").select("top", F.concat_ws("/", "at", "path").alias("path"), "tree_id", "node_id", "lang", "term", (F.col("depth") + 1 + F.col("under")).alias("depth"), "leaf"))
        seen = cut(seen.unionByName(w.select("top", "lang", "term")))
    if fresh is not None:
        done.append(fresh.withColumn("spliced", F.lit(False)))
    out = done[0]
    for d in done[1:]:
        out = out.unionByName(d)
    return out.drop("leaf")


def _whole_trees(nodes: DataFrame, columns: list[str], schema: str, work) -> DataFrame:
    """``work(trees, rows)`` for tasks of whole trees; ``rows`` is a table in the order of ``trees``. Trees come from stored texts, which bounds each; null tree and node ids are left out."""
    rows = nodes.where(F.col("tree_id").isNotNull() & F.col("node_id").isNotNull()).select(F.col("tree_id").cast("long").alias("tree_id"), F.col("node_id").cast("long").alias("node_id"), F.col("parent_id").cast("long").alias("parent_id"), *columns)
    n = partitions_for(nodes.sparkSession, rows.count(), _ROWS_PER_TASK)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = list(batches)
        if held:
            table = distinct_nodes(pa.Table.from_batches(held), ("parent_id",))
            del held
            rank = pc.fill_null(table.column("ordinal"), 0).to_numpy()
            node = ids(table.column("node_id"))
            order = np.empty(len(node), np.int64)
            order[np.lexsort((node, rank))] = np.arange(len(node))
            yield from work(Trees(node, ids(table.column("tree_id")), ids(table.column("parent_id")), order), table)

    return rows.repartition(n, "tree_id").mapInArrow(run, schema)


def _digests(column: pa.ChunkedArray) -> np.ndarray:
    """Two 64-bit numbers a value; null has its own. Each distinct value is hashed once."""
    coded = column.combine_chunks().dictionary_encode(null_encoding="encode")
    made = [blake2b(repr(v).encode(), digest_size=16).digest() for v in coded.dictionary.to_pylist()]
    return np.frombuffer(b"".join(made), np.uint64).reshape(-1, 2)[coded.indices.to_numpy()] if len(column) else np.zeros((0, 2), np.uint64)


def _mixed(x: np.ndarray) -> np.ndarray:
    """A permutation of 64-bit numbers that spreads every bit."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


def variants(nodes: DataFrame) -> DataFrame:
    """Sibling spellings merged: ``tree_id, node_id, spellings, variants, merged`` (nodes left and nodes below it gone with the others).

    Siblings are one if they share a language and what is below them is the same; merged from the leaves upwards. What is
    below a node is told by a digest of 128 bits: the sum of those of its children left, each from language, term and
    what is below it, so their order does not count.
    """

    def work(t: Trees, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        n = len(t.node)
        lang, term = _digests(rows.column("lang")), _digests(rows.column("term"))
        below = np.zeros((n, 2), np.uint64)
        kept, first_of = np.ones(n, bool), np.arange(n)
        for level in t.levels[::-1]:
            # equal siblings: the first in order stays; only what stays counts for the parent
            sign = _mixed(below[level] + _mixed(lang[level]))
            family = t.up[level] if len(level) and t.depth[level[0]] > 0 else -1 - np.arange(len(level))
            order = np.lexsort((np.arange(len(level)), sign[:, 1], sign[:, 0], family))
            f, s = family[order], sign[order]
            same = np.append(False, (f[1:] == f[:-1]) & (s[1:] == s[:-1]).all(1))
            head = level[order][np.maximum.accumulate(np.where(same, 0, np.arange(len(order))))]
            first_of[level[order]] = head
            kept[level[order]] = ~same
            left = level[kept[level]]
            left = left[t.up[left] >= 0]
            mine = _mixed(_mixed(lang[left]) + np.uint64(3) * term[left] + np.uint64(7) * below[left])
            for k in (0, 1):
                np.add.at(below[:, k], t.up[left], mine[:, k])
        # below a node that went, all is gone
        for level in t.levels[1:]:
            kept[level] &= kept[t.up[level]]
        size = t.sums(np.ones(n, np.int64))
        gone = size - 1
        stay = np.flatnonzero(kept & (t.depth >= 0))
        under = stay[t.up[stay] >= 0]
        np.subtract.at(gone, t.up[under], size[under])
        spelled = pc.coalesce(pc.if_else(pc.equal(rows.column("raw_term"), ""), None, rows.column("raw_term")), rows.column("term")).combine_chunks()
        names, count = spelled.to_pylist(), np.ones(n, np.int32)
        # the others' spellings, in order, once each
        merged = np.flatnonzero((first_of != np.arange(n)) & kept[first_of] & (t.depth >= 0))
        several: dict[int, dict] = {}
        place = t.preorder()
        for i in merged[np.argsort(place[merged], kind="stable")].tolist():
            several.setdefault(int(first_of[i]), {names[first_of[i]]: None})[names[i]] = None
        for i, found in several.items():
            given = [x for x in found if x]
            names[i], count[i] = ", ".join(given), len(given)
        order = stay[np.argsort(place[stay])]
        out = pa.array(names, pa.string()).take(pa.array(order))
        yield pa.RecordBatch.from_arrays([pa.array(t.tree[order]), pa.array(t.node[order]), out, pa.array(count[order]), pa.array(gone[order].astype(np.int32))], ["tree_id", "node_id", "spellings", "variants", "merged"])

    return _whole_trees(nodes, ["ordinal", "lang", "term", "raw_term"], "tree_id long, node_id long, spellings string, variants int, merged int", work)


def _quoted(column: pa.ChunkedArray) -> pa.Array:
    """JSON of each text; each distinct text is escaped once."""
    coded = column.combine_chunks().dictionary_encode()
    return pa.array([json.dumps(v, ensure_ascii=False) for v in coded.dictionary.to_pylist()], pa.large_string()).take(coded.indices)


def nested(nodes: DataFrame) -> DataFrame:
    """One JSON text a tree, children in sibling order: ``tree_id, nodes, tree_json``. Null fields are left out; nodes on loops are not in it.

    A text is what opens and closes each node, laid out in the order of a walk around the tree.
    """

    def work(t: Trees, rows: pa.Table) -> Iterator[pa.RecordBatch]:
        sign = lambda x: pa.scalar(x, pa.large_string())
        fields = [pc.fill_null(pc.binary_join_element_wise(sign(f'"{c}": '), _quoted(rows.column(c)), sign(", "), sign("")), "") for c in ("lang", "term")]
        inner = t.first[1:] > t.first[:-1]
        opened = pc.if_else(pa.array(inner), sign('"children": ['), sign(""))
        told = pc.utf8_rtrim(pc.binary_join_element_wise(*fields, opened, sign("")), ", ")
        size, pre, depth = t.sums(np.ones(len(t.node), np.int64)), t.preorder(), t.depth.astype(np.int64)
        reached = np.flatnonzero(t.depth >= 0)
        reached = reached[np.argsort(pre[reached])]
        begin = 2 * pre[reached] - depth[reached]
        # a comma before all but the first of each family
        family = np.where(t.up[reached] >= 0, t.up[reached], -1)
        eldest = np.zeros(len(t.node), bool)
        some = np.flatnonzero(inner)
        eldest[t.kids[t.first[some]]] = True
        top = family < 0
        begins_tree = np.append(True, t.tree[reached][1:] != t.tree[reached][:-1])
        comma = np.where(top, ~begins_tree, ~eldest[reached])
        start = pc.binary_join_element_wise(pc.if_else(pa.array(comma), sign(", {"), sign("{")), told.take(pa.array(reached)), sign(""))
        end = pc.if_else(pa.array(inner[reached]), sign("]}"), sign("}"))
        place = np.empty(2 * len(reached), np.int64)
        place[begin] = np.arange(len(reached))
        place[begin + 2 * size[reached] - 1] = len(reached) + np.arange(len(reached))
        pieces = pa.concat_arrays([start, end]).take(pa.array(place))
        edges = spans(t.tree[reached])
        texts = pc.binary_join(pa.LargeListArray.from_arrays(pa.array(2 * edges), pieces), sign(""))
        for k in range(0, len(texts), 1000):
            part = texts.slice(k, 1000)
            count = np.diff(edges[k : k + len(part) + 1]).astype(np.int32)
            yield pa.RecordBatch.from_arrays([pa.array(t.tree[reached][edges[k : k + len(part)]]), pa.array(count), pc.binary_join_element_wise(sign("["), part, sign("]"), sign("")).cast(pa.string())], ["tree_id", "nodes", "tree_json"])

    return _whole_trees(nodes, ["ordinal", "lang", "term"], "tree_id long, nodes int, tree_json string", work)


def covered_form(words: DataFrame, word: str, nodes: DataFrame, lang: str = "English") -> DataFrame:
    """The spelling of each word under which a tree holds it: as it is, else in lower case, else null."""
    there = nodes.where((F.col("lang") == lang) & (F.col("term") != "")).select(F.col("term").alias("f")).distinct()
    w = words.select(F.trim(F.col(word)).alias("word")).where(F.col("word") != "").distinct()
    exact = there.select(F.col("f").alias("exact"))
    low = there.select(F.col("f").alias("low"))
    j = w.join(exact, w["word"] == F.col("exact"), "left").join(low, F.lower("word") == F.col("low"), "left")
    return j.select("word", F.coalesce("exact", "low").alias("form"))


def family(nodes: DataFrame, trees: DataFrame, lang: str, term: str, budget: int = BUDGET) -> DataFrame:
    """The whole recorded family of a form, from the topmost tree down: the largest tree that holds it, climbed from, spliced, cut to the budget and marked.

    ``path, lang, term, depth, rank, shown, match, on_path, spliced``; no rows where nothing holds the form. Paths are in sibling order.
    """
    held = trees_containing(nodes.where((F.col("lang") == lang) & (F.col("term") == term)), trees, 1).select("tree_id")
    start = trees.join(held, "tree_id", "left_semi").select("lang", "term")
    top = climb(nodes, trees).join(start, ["lang", "term"], "left_semi").select(F.col("top_id").alias("top"))
    body = cut(splice(nodes, trees).join(top, "top", "left_semi"))
    order = Window.partitionBy("top").orderBy("depth", "path")
    body = body.withColumn("rank", F.row_number().over(order)).withColumn("match", F.coalesce((F.col("lang") == lang) & (F.col("term") == term), F.lit(False)))
    steps = F.split("path", "/")
    above = body.where("match").select(F.explode(F.transform(F.sequence(F.lit(1), F.size(steps)), lambda i: F.array_join(F.slice(steps, F.lit(1), i), "/"))).alias("path")).distinct().withColumn("on_path", F.lit(True))
    out = body.join(above, "path", "left").withColumn("on_path", F.coalesce("on_path", F.lit(False)))
    return out.select("path", "lang", "term", "depth", "rank", (F.col("rank") <= budget).alias("shown"), "match", "on_path", "spliced")
