"""Whole trees of a task as arrays: links, levels, sums, orders and paths, a level at a time for all trees together."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

NONE = np.iinfo(np.int64).min
_MOST = np.iinfo(np.int64).max
#: Paths are held and handed on in pieces of about so many bytes and at most so many rows.
PIECE_BYTES = 4 << 20
PIECE_ROWS = 50_000


def ids(column: pa.ChunkedArray) -> np.ndarray:
    """64-bit ids, ``NONE`` for null."""
    return column.combine_chunks().cast(pa.int64()).fill_null(NONE).to_numpy(zero_copy_only=False)


def distinct_nodes(rows: pa.Table, smallest: tuple[str, ...] = (), largest: tuple[str, ...] = ()) -> pa.Table:
    """One row a (tree, node), in this order: of repeated rows the smallest value given in each of ``smallest`` and the largest in each of ``largest``, each column by itself; all else from the first row."""
    tree, node = ids(rows.column("tree_id")), ids(rows.column("node_id"))
    order = np.lexsort((node, tree))
    tree, node = tree[order], node[order]
    again = np.zeros(len(node), bool)
    again[1:] = (node[1:] == node[:-1]) & (tree[1:] == tree[:-1])
    rows = rows.take(pa.array(order))
    if not again.any():
        return rows
    # only the rows of repeated nodes are looked at one column after the other
    group = np.cumsum(~again) - 1
    out = rows.filter(pa.array(~again))
    many = np.flatnonzero(np.bincount(group)[group] > 1)
    owner = group[many]
    sub = rows.take(pa.array(many)).append_column("__g", pa.array(owner))
    begins = np.flatnonzero(np.append(True, owner[1:] != owner[:-1]))
    for names, way in ((smallest, "ascending"), (largest, "descending")):
        for c in names:
            by = pc.sort_indices(sub, sort_keys=[("__g", "ascending"), (c, way)], null_placement="at_end")
            best = sub.column(c).take(by).take(pa.array(begins)).combine_chunks()
            mask = np.zeros(len(out), bool)
            mask[owner[begins]] = True
            out = out.set_column(out.schema.get_field_index(c), c, pc.replace_with_mask(out.column(c).combine_chunks(), pa.array(mask), best))
    return out


class Trees:
    """Links of distinct (tree, node) rows in this order; ``rank`` orders siblings and roots, else their ids do.

    ``up`` is the row of the parent or -1; ``levels`` the rows by distance from a root; rows that no root reaches, on a
    loop or below one, are in no level and have depth -1.
    """

    def __init__(self, node: np.ndarray, tree: np.ndarray, parent: np.ndarray, rank: np.ndarray | None = None):
        n = len(node)
        self.node, self.tree = node, tree
        # the parent's row: (tree, node) is sorted, so one search finds it
        number = np.cumsum(np.append(False, tree[1:] != tree[:-1])[:n])
        known = np.unique(node)
        key = number * (len(known) + 1) + np.searchsorted(known, node)
        at = np.searchsorted(known, parent)
        there = (at < len(known)) & (known[np.minimum(at, len(known) - 1)] == parent) & (parent != NONE) if n else np.zeros(0, bool)
        wanted = number * (len(known) + 1) + at
        up = np.searchsorted(key, wanted)
        there &= (up < n) & (key[np.minimum(up, n - 1)] == wanted) if n else there
        self.up = np.where(there, up, -1)
        rank = np.arange(n) if rank is None else rank
        kids = np.flatnonzero(there)
        kids = kids[np.lexsort((rank[kids], self.up[kids]))]
        self.kids, self.first = kids, np.searchsorted(self.up[kids], np.arange(n + 1))
        roots = np.flatnonzero(~there)
        self.roots = roots[np.lexsort((rank[roots], tree[roots]))]
        self.depth, self.root = np.full(n, -1, np.int32), np.full(n, -1, np.int64)
        self.levels: list[np.ndarray] = []
        front, self.root[self.roots] = self.roots, node[self.roots]
        while len(front):
            self.depth[front] = len(self.levels)
            self.levels.append(front)
            of, pick = self.children(front)
            self.root[pick] = self.root[front[of]]
            front = pick

    def children(self, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """For the children of ``rows``, in order: which of ``rows`` is the parent, and the child's row."""
        count = self.first[rows + 1] - self.first[rows]
        of = np.repeat(np.arange(len(rows)), count)
        return of, self.kids[np.repeat(self.first[rows] - (np.cumsum(count) - count), count) + np.arange(len(of))]

    def sums(self, weight: np.ndarray) -> np.ndarray:
        """Each row's weight and that of all below it."""
        total = weight.copy()
        for rows in self.levels[:0:-1]:
            np.add.at(total, self.up[rows], total[rows])
        return total

    def loops(self) -> np.ndarray:
        """Of each row on a loop the first row of its loop; -1 for the others."""
        out = np.full(len(self.node), -1, np.int64)
        lost = np.flatnonzero(self.depth < 0)
        # what no root reaches has its parent among the same rows; so many steps up are on a loop, and every row of one is met
        up = np.searchsorted(lost, self.up[lost])
        far = up
        for _ in range(len(lost).bit_length()):
            far = far[far]
        on = np.unique(far)
        jump, least = np.searchsorted(on, up[on]), np.arange(len(on))
        for _ in range(len(on).bit_length()):
            jump, least = jump[jump], np.minimum(least, least[jump])
        out[lost[on]] = lost[on][least]
        return out

    def loop_sums(self, weight: np.ndarray) -> np.ndarray:
        """As ``sums``, and for rows that no root reaches too: on a loop, the weight of the whole loop and of all below it."""
        total, loop = self.sums(weight), self.loops()
        on = np.flatnonzero(loop >= 0)
        front, levels = self.children(on)[1], []
        front = front[loop[front] < 0]
        while len(front):
            levels.append(front)
            front = self.children(front)[1]
        for rows in reversed(levels):
            np.add.at(total, self.up[rows], total[rows])
        whole = np.zeros_like(total)
        np.add.at(whole, loop[on], total[on])
        total[on] = whole[loop[on]]
        return total

    def preorder(self) -> np.ndarray:
        """Place of each reached row among those of all trees, parents before children, siblings in order; -1 for the others."""
        size = self.sums(np.ones(len(self.node), np.int64))
        out = np.full(len(self.node), -1, np.int64)
        for rows in self.levels[:1]:
            out[rows] = np.cumsum(size[rows]) - size[rows]
        for rows in self.levels[1:]:
            before = np.cumsum(size[rows]) - size[rows]
            fresh = np.append(True, self.up[rows][1:] != self.up[rows][:-1])
            before -= np.repeat(before[fresh], np.diff(np.append(np.flatnonzero(fresh), len(rows))))
            out[rows] = out[self.up[rows]] + 1 + before
        return out

    def paths(self, label: pa.Array, between: str = "/") -> Iterator[tuple[np.ndarray, pa.Array]]:
        """Reached rows with the labels from their root to them, in pieces: what is held at a time does not grow with the sum of the paths."""
        label = label.cast(pa.large_string())
        width = pc.binary_length(label).to_numpy(zero_copy_only=False).astype(np.int64)
        sign = pa.scalar(between, pa.large_string())
        open_: list[tuple] = []  # rows, the places of their parents' paths, those paths

        def put(rows: np.ndarray, of: np.ndarray | None, above: pa.Array | None) -> None:
            size = width[rows] + 1
            if above is not None:
                size = size + pc.binary_length(above).to_numpy(zero_copy_only=False)[of]
            if len(rows) > 2 * PIECE_ROWS or size.sum() > 2 * PIECE_BYTES:
                piece = np.maximum((np.cumsum(size) - size) // PIECE_BYTES, np.arange(len(rows)) // PIECE_ROWS)
                edges = [0, *(np.flatnonzero(np.diff(piece)) + 1).tolist(), len(rows)]
            else:
                edges = [0, len(rows)]
            open_.extend((rows[a:b], None if of is None else of[a:b], above) for a, b in reversed([*zip(edges, edges[1:])]))

        if len(self.roots):
            put(self.roots, None, None)
        held, size, count = [], 0, 0
        while open_:
            rows, of, above = open_.pop()
            path = label.take(pa.array(rows))
            if above is not None:
                path = pc.binary_join_element_wise(above.take(pa.array(of)), path, sign)
            held.append((rows, path))
            size, count = size + path.nbytes, count + len(rows)
            if size > PIECE_BYTES or count > PIECE_ROWS:
                yield np.concatenate([r for r, _ in held]), pa.chunked_array([p for _, p in held]).combine_chunks()
                held, size, count = [], 0, 0
            at, pick = self.children(rows)
            if len(pick):
                put(pick, at, path)
        if held:
            yield np.concatenate([r for r, _ in held]), pa.chunked_array([p for _, p in held]).combine_chunks()


def spans(keys: np.ndarray) -> np.ndarray:
    """Bounds of the runs of equal neighbours."""
    return np.concatenate([[0], np.flatnonzero(np.diff(keys)) + 1, [len(keys)]]) if len(keys) else np.zeros(1, np.int64)
