"""Hard negatives by branch-and-bound in ball trees.

The vectors of a stripe (see searching.py) are one ball tree: a node knows its centre, its
radius and its least and greatest label. The inner product of a query with any vector of
a node lies within |query| * radius of that with the centre. A node is not opened for a
query if its labels rule it out, if its bounds lie outside the query's score window, or
if its upper bound is strictly beneath the query's k-th score so far (equal scores are
told apart by id). Queries go down the tree together, each as far as its bounds let it.

Two searches: the best rows of the anchor's own label (its positives), then, for each
distinct positive score, the best rows of other labels within the window under it.

Defined results: rows with a null id, label or vector or a null or non-finite component
take no part; zero vectors do; shorter vectors are filled up with zeros; each row is a
vector of its own, also with an id seen before: a positive is any row of the label but the
anchor's own, and two anchor rows of one id each have results; ties go to the smaller id;
a positive with an empty window (as with a negative score) gives no row; an empty table
gives an empty result. Scores are exact as long as they stay below 2**53.
"""

from __future__ import annotations

from types import SimpleNamespace

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.llm.common import forget, materialize
from graphloom.llm.searching import Best, blocks, classes, merged, others, prepare, search

#: Vectors of a leaf; relative room for rounding in the bounds.
LEAF, ROOM = 128, 1e-9


# --- the tree -------------------------------------------------------------------------
def _halves(x: np.ndarray, labels: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows of a node in two parts: by label while there are few, then by the projection on two distant vectors."""
    own = labels[rows]
    names, counts = np.unique(own, return_counts=True)
    if 1 < len(names) <= len(rows) // (2 * LEAF):
        cut = names[max(1, int(np.abs(2 * np.cumsum(counts)[:-1] - len(rows)).argmin()) + 1)]
        return rows[own < cut], rows[own >= cut]
    part = x[rows]
    first = part[((part - part.mean(0)) ** 2).sum(1).argmax()]
    second = part[((part - first) ** 2).sum(1).argmax()]
    order = np.argpartition(part @ (second - first), len(rows) // 2)
    return rows[order[: len(rows) // 2]], rows[order[len(rows) // 2 :]]


def tree(table: SimpleNamespace) -> SimpleNamespace:
    """The ball tree of a stripe: nodes with centre, radius, labels (low, high), and rows or children."""
    x = table.x.astype(float)
    nodes, stack = [], [(np.arange(len(x)), None)]
    while stack:
        rows, parent = stack.pop()
        part, labels = x[rows], table.labels[rows]
        centre = part.mean(0)
        radius = float(np.sqrt(((part - centre) ** 2).sum(1).max()))
        node = SimpleNamespace(centre=centre, radius=radius, low=int(labels.min()), high=int(labels.max()), rows=rows, children=[])
        if parent is not None:
            parent.children.append(node)
        nodes.append(node)
        if len(rows) > LEAF and radius > 0:
            stack += [(half, node) for half in _halves(x, table.labels, rows)]
    return SimpleNamespace(table=table, x=x, root=nodes[0], opened=0, leaves=sum(not n.children for n in nodes))


def _reach(node, x: np.ndarray, length: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(lower, upper) bounds of the products of some vectors with those of a node."""
    middle, spread = x @ node.centre, length * node.radius
    room = ROOM * (length * np.sqrt((node.centre**2).sum()) + spread) + ROOM
    return middle - spread - room, middle + spread + room


def descend(index: SimpleNamespace, q: SimpleNamespace, vector: np.ndarray, low: np.ndarray, high: np.ndarray, alike: bool, best: Best) -> None:
    """Offer to each window w (vector[w] of the block q, scores low[w] to high[w]) the rows of the tree with its label, or with others."""
    x = q.x.astype(float)
    length, table = np.sqrt((x * x).sum(1)), index.table
    labels = q.labels[vector]
    stack = [(index.root, np.arange(len(vector)), np.full(len(vector), np.inf))]
    while stack:
        node, w, upper = stack.pop()
        w = w[upper >= -best.last[w]]  # the k-th score may have risen since
        if not len(w):
            continue
        if node.children:
            down = []
            for child in node.children:
                fits = (child.low <= labels[w]) & (labels[w] <= child.high) if alike else (child.low != labels[w]) | (child.high != labels[w])
                c = w[fits]
                each, back = np.unique(vector[c], return_inverse=True)
                under, over = (b[back] for b in _reach(child, x[each], length[each]))
                keep = (over >= low[c]) & (under <= high[c]) & (over >= -best.last[c])
                if keep.any():
                    down.append((float(over[keep].mean()), child, c[keep], over[keep]))
            stack += [d[1:] for d in sorted(down, key=lambda d: d[0])]  # the better child on top
            continue
        index.opened += len(w)
        each, back = np.unique(vector[w], return_inverse=True)
        scores = (x[each] @ index.x[node.rows].T)[back]
        same = table.labels[node.rows][None, :] == labels[w][:, None]
        ok = (same == alike) & (scores >= low[w][:, None]) & (scores <= high[w][:, None]) & (scores >= -best.last[w][:, None])
        i, j = np.nonzero(ok)
        if len(i):
            rows = node.rows[j]
            best.offer(w[i], -scores[i, j], rows, table, (q.same[vector[w[i]]] == table.same[rows]).all(1))


def _positives(keep: int):
    def run(index: SimpleNamespace, q: SimpleNamespace):
        m = len(q.x)
        best = Best(m, keep)
        descend(index, q, np.arange(m), np.full(m, -np.inf), np.full(m, np.inf), True, best)
        return best.batch(q.same)

    return run


def _negatives(keep: int, per_cent: int):
    def run(index: SimpleNamespace, q: SimpleNamespace):
        vector = np.repeat(np.arange(len(q.x)), np.diff(q.ends))
        best = Best(len(vector), keep)
        least = np.array([-(-per_cent * int(p) // 100) for p in q.values], float)  # the least whole number that is enough
        descend(index, q, vector, least, q.values.astype(float), False, best)
        return best.batch(q.same[vector], q.values)

    return run


def mine(vectors: DataFrame, label: Column, asked: Column, positives: int, negatives: int, per_cent: int, steps: int = 256, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """anchor_id, positive_id, rank, negative_id, positive_score, negative_score for each row for which `asked`, over `id`, holds.

    Components become floor(steps * x). Negatives have a label other than the anchor's and
    per_cent / 100 * positive_score <= negative_score <= positive_score.
    """
    rows, dim, kind = prepare(vectors, key, vector, label, lambda x: np.floor(x * steps), zero=True)
    rows = materialize(rows, "negative-vectors")
    known = materialize(classes(rows, max(positives + 1, negatives)), "negative-classes")
    total, row_bytes = known.count(), dim * int(kind[-1]) + 32 + 8 * max(positives + 1, negatives)
    packed = materialize(blocks(known, row_bytes), "negative-blocks")
    forget(known)
    anchors = materialize(rows.filter(asked).select("same", "label", "v").dropDuplicates(["same"]), "negative-anchors")
    plain = anchors.select("same", "label", F.expr("cast(array() as array<long>)").alias("values"), "v")
    found = search(packed, blocks(plain, row_bytes), total, row_bytes, kind, dim, tree, _positives(positives + 1))
    liked = materialize(merged(found, positives + 1).select("same", "best"), "negative-positives")

    pairs = rows.filter(asked).select("id", "same").join(liked, "same").select(F.col("id").alias("anchor_id"), "same", F.explode(others("best", "id", positives)).alias("p"))
    pairs = pairs.select("anchor_id", "same", F.col("p.id").alias("positive_id"), (-F.col("p.key")).cast("long").alias("positive_score"))
    # windows of a class: its distinct positive scores, at most one more than the positives
    caps = F.array_distinct(F.transform(F.filter("best", lambda x: x["key"] <= 0), lambda x: (-x["key"]).cast("long")))
    windows = anchors.join(liked.select("same", caps.alias("values")), "same").filter(F.size("values") > 0)
    found = search(packed, blocks(windows, row_bytes), total, row_bytes, kind, dim, tree, _negatives(negatives, per_cent))
    hard = materialize(merged(found, negatives).select("same", F.col("cap").alias("positive_score"), "best"), "negative-best")
    forget(packed, anchors)
    out = pairs.join(hard, ["same", "positive_score"]).select("anchor_id", "positive_id", "positive_score", F.posexplode("best").alias("place", "n"))
    return out.select("anchor_id", "positive_id", (F.col("place") + 1).alias("rank"), F.col("n.id").alias("negative_id"), "positive_score", (-F.col("n.key")).cast("long").alias("negative_score"))
