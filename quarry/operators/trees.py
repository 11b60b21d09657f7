"""Structural similarity of syntax trees: ordered tree edit distance over pre-order label and parent arrays."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.operators.costs import Costs

def _post_order(labels: list[str], parents: list[int | None]):
    """Labels in post-order, the leftmost leaf of each subtree, and the roots of the distance's subproblems."""
    kids: list[list[int]] = [[] for _ in labels]
    for i, p in enumerate(parents):
        if p is not None and p >= 0:
            kids[p].append(i)
    order, left, spot = [], [], {}
    stack = [(0, False)] if labels else []
    while stack:
        n, done = stack.pop()
        if done:
            spot[n] = len(order)
            left.append(left[spot[kids[n][0]]] if kids[n] else len(order))
            order.append(labels[n])
        else:
            stack += [(n, True), *((k, False) for k in reversed(kids[n]))]
    last = {leaf: i for i, leaf in enumerate(left)}
    return order, left, sorted(last.values())


def tree_distance(a: tuple[list, list], b: tuple[list, list], costs: Costs | None = None) -> float:
    """Least cost of node insertions, deletions and renames that make tree a into tree b; each costs 1 without ``costs``."""
    la, fa, ra = _post_order(*a)
    lb, fb, rb = _post_order(*b)
    drop = [costs.edit(x) if costs else 1 for x in la]
    add = [costs.edit(x) if costs else 1 for x in lb]
    if not la or not lb:
        return sum(drop) + sum(add)
    names = {x: {y: costs.rename(x, y) if costs else int(x != y) for y in set(lb)} for x in set(la)}
    tree = np.zeros((len(la), len(lb)))
    for i in ra:
        for j in rb:
            x, y = fa[i], fb[j]
            d = np.zeros((i - x + 2, j - y + 2))
            d[1:, 0], d[0, 1:] = np.cumsum(drop[x : i + 1]), np.cumsum(add[y : j + 1])
            for p in range(x, i + 1):
                up, row, whole, gone, named = d[p - x].tolist(), [d[p - x + 1, 0]], fa[p] == x, drop[p], names[la[p]]
                for q in range(y, j + 1):
                    k = q - y
                    step = min(up[k + 1] + gone, row[k] + add[q])
                    if whole and fb[q] == y:
                        step = min(step, up[k] + named[lb[q]])
                        tree[p, q] = step
                    else:
                        step = min(step, d[fa[p] - x, fb[q] - y] + tree[p, q])
                    row.append(step)
                d[p - x + 1] = row
    return float(tree[-1, -1])


def tree_similarity(a: tuple[list, list], b: tuple[list, list], costs: Costs | None = None) -> float:
    """1 - distance / the larger size, at least 0; two empty trees are equal."""
    most = max(len(a[0]), len(b[0]))
    return 1.0 - min(tree_distance(a, b, costs), most) / most if most else 1.0


def structural_pairs(pairs: DataFrame, trees: DataFrame, threshold: float = 0.7, costs: Costs | None = None) -> DataFrame:
    """(a, b) candidates with trees (id, labels, parents) -> a, b, distance, similarity of those at the threshold or above.

    Sizes that rule a pair out are compared before the trees are (no edit costs less than 0.1, so only at unit cost)."""
    t = trees.select("id", "labels", "parents")
    x = pairs.select("a", "b").join(t.toDF("a", "la", "pa"), "a").join(t.toDF("b", "lb", "pb"), "b")
    if costs is None:
        x = x.where(F.least(F.size("la"), F.size("lb")) >= F.lit(threshold) * F.greatest(F.size("la"), F.size("lb")))
    kind = pairs.schema["a"].dataType.simpleString()

    def score(batches):
        for b in batches:
            la, pa_, lb, pb = (b.column(c).to_pylist() for c in ("la", "pa", "lb", "pb"))
            d = [tree_distance((p, q), (r, s), costs) for p, q, r, s in zip(la, pa_, lb, pb)]
            sims = [1.0 - min(v, m) / m if (m := max(len(p), len(r))) else 1.0 for v, p, r in zip(d, la, lb)]
            yield pa.RecordBatch.from_arrays([b.column("a"), b.column("b"), pa.array(d, pa.float64()), pa.array(sims, pa.float64())], ["a", "b", "distance", "similarity"])

    return x.mapInArrow(score, f"a {kind}, b {kind}, distance double, similarity double").where(F.col("similarity") >= threshold)
