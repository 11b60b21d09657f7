"""Graph operators over edge tables (src, dst): degrees, coupling, closure, cycles, layers, components, communities.

Loops run on the driver over declarative steps; each step's frontier is checkpointed to the shared folder, so plans
don't grow and lost executors cost one step. No vertex or edge set is collected.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions.lineage import cut
from quarry.functions.scalar import ratio


def dedupe_edges(imports: DataFrame) -> DataFrame:
    """(src, dst, is_lazy) rows -> one edge a pair without loops, lazy only if all its imports are."""
    return imports.where("src <> dst").groupBy("src", "dst").agg(F.bool_and("is_lazy").alias("is_lazy"), F.count("*").alias("imports"))


def coupling(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """node -> ca (dependents), ce (dependencies), instability."""
    out = edges.groupBy(F.col("src").alias("node")).agg(F.count_distinct("dst").alias("ce"))
    into = edges.groupBy(F.col("dst").alias("node")).agg(F.count_distinct("src").alias("ca"))
    x = nodes.join(into, "node", "left").join(out, "node", "left").fillna({"ca": 0, "ce": 0})
    return x.withColumn("instability", ratio(F.col("ce"), F.col("ca") + F.col("ce")))


def roots_and_leaves(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """root: without dependencies; leaf: without dependents."""
    src = edges.select(F.col("src").alias("node")).distinct().withColumn("has_out", F.lit(True))
    dst = edges.select(F.col("dst").alias("node")).distinct().withColumn("has_in", F.lit(True))
    x = nodes.join(src, "node", "left").join(dst, "node", "left")
    return x.select("node", F.col("has_out").isNull().alias("is_root"), F.col("has_in").isNull().alias("is_leaf"))


def two_cycles(edges: DataFrame) -> DataFrame:
    back = edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))
    return edges.select("src", "dst").join(back, ["src", "dst"]).where("src < dst").distinct()


def distances(edges: DataFrame, start: DataFrame) -> DataFrame:
    """(node, hops) reachable from the start nodes, by frontier."""
    seen = cut(start.select("node", F.lit(0).cast("long").alias("hops")).distinct())
    frontier, hops = seen, 0
    while True:
        hops += 1
        nxt = frontier.join(edges, frontier.node == edges.src).select(F.col("dst").alias("node")).distinct().join(seen.select("node"), "node", "left_anti")
        frontier = cut(nxt.withColumn("hops", F.lit(hops).cast("long")))
        if frontier.isEmpty():
            return seen
        seen = seen.unionByName(frontier)


def closure(edges: DataFrame) -> DataFrame:
    """Transitive closure by doubling: paths of length up to 2^k after k steps."""
    paths = cut(edges.select("src", "dst").distinct())
    n = paths.count()
    while True:
        a, b = paths.alias("a"), paths.alias("b")
        step = a.join(b, F.col("a.dst") == F.col("b.src")).select(F.col("a.src").alias("src"), F.col("b.dst").alias("dst"))
        paths = cut(paths.unionByName(step).distinct())
        n, before = paths.count(), n
        if n == before:
            return paths


def _spread(labels: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, label) after each node has taken the least label of all that reach it along the edges."""
    now = labels
    while True:
        into = edges.join(now.withColumnRenamed("node", "src"), "src").groupBy(F.col("dst").alias("node")).agg(F.min("label").alias("low"))
        nxt = cut(now.join(into, "node", "left").select("node", F.least("label", F.coalesce("low", "label")).alias("label"), (F.coalesce("low", "label") < F.col("label")).alias("moved")))
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return now


def strong_components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component, size): nodes that reach each other, named by the least.

    Nodes take the least label that reaches them; those of a label that its node is reached from are a component. What is
    found goes, and edges between labels, which no cycle has, go as well, until no edges are left. Everything is linear in
    the edges; no closure is made."""
    left = cut(edges.select("src", "dst").where("src <> dst").distinct())
    found = None
    while not left.isEmpty():
        ends = left.select(F.col("src").alias("node")).union(left.select("dst")).distinct()
        label = _spread(cut(ends.select("node", F.col("node").alias("label"))), left)
        inner = left.join(label.select(F.col("node").alias("src"), F.col("label").alias("a")), "src").join(label.select(F.col("node").alias("dst"), F.col("label").alias("b")), "dst").where("a = b")
        inner = cut(inner.select("src", "dst", F.col("a").alias("label")))
        # backward from each label's node, within its label
        seen = cut(label.where("node = label").select("node", "label"))
        frontier = seen
        while True:
            back = inner.join(frontier.select(F.col("node").alias("dst")), "dst").select(F.col("src").alias("node"), "label").distinct().join(seen.select("node"), "node", "left_anti")
            frontier = cut(back)
            if frontier.isEmpty():
                break
            seen = cut(seen.unionByName(frontier))
        part = seen.select("node", F.col("label").alias("component"))
        found = part if found is None else found.unionByName(part)
        left = cut(inner.select("src", "dst").join(seen.select(F.col("node").alias("src")), "src", "left_anti").join(seen.select(F.col("node").alias("dst")), "dst", "left_anti"))
    base = nodes.select("node").distinct()
    named = base.withColumn("component", F.col("node")) if found is None else base.join(found, "node", "left").select("node", F.coalesce("component", "node").alias("component"))
    return named.join(named.groupBy("component").agg(F.count("*").alias("size")), "component").select("node", "component", "size")


def _condensed(nodes: DataFrame, edges: DataFrame) -> tuple[DataFrame, DataFrame]:
    """(node, component, size) and the edges (a, b) between components."""
    scc = cut(strong_components(nodes, edges))
    name = scc.select("node", "component")
    e = edges.join(name.withColumnRenamed("component", "a"), edges.src == F.col("node")).drop("node").join(name.withColumnRenamed("component", "b"), edges.dst == F.col("node"))
    return scc, cut(e.where("a <> b").select("a", "b").distinct())


def longest_chains(nodes: DataFrame, edges: DataFrame, n: int = 10) -> DataFrame:
    """component, length, chain: the n longest paths of the condensation by the component that they end in; of equally long
    ones to a component the one whose list comes first."""
    scc, dag = _condensed(nodes, edges)
    now = cut(scc.select("component").distinct().select("component", F.lit(1).alias("length"), F.array("component").alias("chain")))
    while True:
        up = now.join(dag, now.component == dag.a).select(F.col("b").alias("component"), (F.col("length") + 1).alias("length"), F.concat("chain", F.array("b")).alias("chain"))
        best = up.unionByName(now).groupBy("component").agg(F.min(F.struct((-F.col("length")).alias("l"), "chain")).alias("m"))
        nxt = cut(best.select("component", (-F.col("m.l")).alias("length"), F.col("m.chain").alias("chain")))
        if nxt.join(now, ["component", "length", "chain"], "left_anti").isEmpty():
            return nxt.orderBy(F.desc("length"), "component").limit(n)
        now = nxt


def shortest_paths(edges: DataFrame, start: DataFrame) -> DataFrame:
    """node, hops, parent: a tree of shortest paths from the start nodes; of several parents the least."""
    d = cut(distances(edges, start))
    near = edges.join(d.select(F.col("node").alias("src"), F.col("hops").alias("h")), "src").join(d.select(F.col("node").alias("dst"), "hops"), "dst").where("hops = h + 1")
    up = near.groupBy(F.col("dst").alias("node")).agg(F.min("src").alias("parent"))
    return d.join(up, "node", "left").select("node", "hops", "parent")


def shortest_path(edges: DataFrame, a, b) -> list:
    """Nodes from a to b, [] if there is no path. One row is read for each step."""
    spark = edges.sparkSession
    kind = edges.schema["src"].dataType.simpleString()
    tree = cut(shortest_paths(edges, spark.createDataFrame([(a,)], f"node {kind}")))
    out, now = [], b
    while row := tree.where(F.col("node") == now).first():
        out.append(now)
        if row.parent is None:
            return out[::-1]
        now = row.parent
    return []


def cycle_details(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """component, size, modules, chains (edges inside), has_core, severity: components of two and more. One with a module of
    more than ten dependents, or of ten modules, is critical; of six high, of three medium, else low. Severest first."""
    scc = cut(strong_components(nodes, edges).where("size > 1"))
    fan = edges.select("src", "dst").distinct().groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    e = edges.select("src", "dst").distinct().join(scc.select(F.col("node").alias("src"), F.col("component").alias("a")), "src").join(scc.select(F.col("node").alias("dst"), F.col("component").alias("b")), "dst").where("a = b")
    chains = e.groupBy(F.col("a").alias("component")).agg(F.count("*").alias("chains"))
    x = scc.join(fan, "node", "left").groupBy("component").agg(F.count("*").alias("size"), F.sort_array(F.collect_list("node")).alias("modules"), (F.max(F.coalesce("fan_in", F.lit(0))) > 10).alias("has_core"))
    rank = F.when(F.col("has_core") | (F.col("size") >= 10), 3).when(F.col("size") >= 6, 2).when(F.col("size") >= 3, 1).otherwise(0)
    name = F.element_at(F.array(*map(F.lit, ("low", "medium", "high", "critical"))), rank + 1)
    return x.join(chains, "component").withColumn("severity", name).orderBy(F.desc(rank), F.desc("size"), "component")


def cycle_statistics(details: DataFrame) -> DataFrame:
    """One row: cycles by severity, modules in cycles, sizes of the largest and of the one with most chains."""
    by = [F.count_if(F.col("severity") == s).alias(s) for s in ("low", "medium", "high", "critical")]
    return details.agg(F.count("*").alias("cycles"), *by, F.coalesce(F.sum("size"), F.lit(0)).alias("modules"), F.max("size").alias("largest"), F.max_by("component", F.struct("chains", (-F.col("component")).alias("c"))).alias("most_chains"))


def depths(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(component, depth): longest path, in nodes, to each component of the condensation."""
    scc, dag = _condensed(nodes, edges)
    level = cut(scc.select("component").distinct().withColumn("depth", F.lit(1).cast("long")))
    while True:
        up = level.join(dag, level.component == dag.a).groupBy(F.col("b").alias("component")).agg((F.max("depth") + 1).alias("up"))
        nxt = cut(level.join(up, "component", "left").select("component", F.greatest("depth", F.coalesce("up", "depth")).alias("depth"), (F.coalesce("up", "depth") > F.col("depth")).alias("moved")))
        level = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return level


def components(nodes: DataFrame, edges: DataFrame) -> DataFrame:
    """(node, component): least reachable node, ignoring directions; min labels with pointer jumps."""
    both = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).distinct())
    now = cut(nodes.select("node", F.col("node").alias("component")).distinct())
    while True:
        near = both.join(now.withColumnRenamed("node", "dst"), "dst").groupBy(F.col("src").alias("node")).agg(F.min("component").alias("near"))
        low = now.join(near, "node", "left").select("node", "component", F.least("component", F.coalesce("near", "component")).alias("low"))
        jump = now.select(F.col("node").alias("low"), F.col("component").alias("far"))
        nxt = cut(low.join(jump, "low").select("node", F.least("low", "far").alias("component"), (F.least("low", "far") < F.col("component")).alias("moved")))
        now = nxt.drop("moved")
        if nxt.where("moved").isEmpty():
            return now


def k_core(edges: DataFrame, k: int) -> DataFrame:
    """Nodes left when those with fewer than k neighbours are peeled off until none is."""
    left = cut(edges.select("src", "dst").unionByName(edges.select(F.col("dst").alias("src"), F.col("src").alias("dst"))).where("src <> dst").distinct())
    n = left.count()
    while True:
        keep = left.groupBy("src").count().where(F.col("count") >= k).select(F.col("src").alias("node"))
        nxt = left.join(keep.withColumnRenamed("node", "src"), "src", "left_semi").join(keep.withColumnRenamed("node", "dst"), "dst", "left_semi")
        left = cut(nxt.select("src", "dst"))
        n, before = left.count(), n
        if n == before:
            return left.select(F.col("src").alias("node")).distinct()


def undirected(edges: DataFrame, lazy: bool = True, weight: str | Column = "weight") -> DataFrame:
    """(a, b, weight) with a < b: weights of both directions summed, loops dropped; lazy edges too, if not wanted. ``weight``
    may be any expression of an edge's columns."""
    return (edges if lazy else edges.where(~F.col("is_lazy"))).where("src <> dst").groupBy(F.least("src", "dst").alias("a"), F.greatest("src", "dst").alias("b")).agg(F.sum(weight).alias("weight"))


def modularity(weighted: DataFrame, parts: DataFrame, resolution: float = 1.0) -> DataFrame:
    """One row, q: modularity of the partition (node, community) over (a, b, weight)."""
    pa_, pb = parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), parts.select(F.col("node").alias("b"), F.col("community").alias("cb"))
    e = weighted.join(pa_, "a").join(pb, "b")
    inside = e.where("ca = cb").groupBy(F.col("ca").alias("community")).agg(F.sum("weight").cast("double").alias("inside"))
    ends = e.select(F.col("ca").alias("community"), "weight").unionAll(e.select("cb", "weight")).groupBy("community").agg(F.sum("weight").cast("double").alias("degree"))
    total = weighted.agg(F.sum("weight").cast("double").alias("m"))
    x = ends.join(inside, "community", "left").crossJoin(F.broadcast(total))  # one row
    return x.agg(F.sum(F.coalesce("inside", F.lit(0.0)) / F.col("m") - resolution * F.pow(F.col("degree") / (2 * F.col("m")), F.lit(2.0))).alias("q"))


def community_metrics(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """community -> size, internal, outgoing, incoming edges and internal ratio."""
    e = edges.join(parts.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(parts.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")
    rows = e.select(F.col("cs").alias("community"), (F.col("cs") == F.col("cd")).cast("long").alias("internal"), (F.col("cs") != F.col("cd")).cast("long").alias("outgoing"), F.lit(0).cast("long").alias("incoming")).unionAll(
        e.where("cs <> cd").select("cd", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long"))
    )
    n = parts.groupBy("community").agg(F.count("*").alias("size"))
    sums = rows.groupBy("community").agg(*[F.sum(c).alias(c) for c in ("internal", "outgoing", "incoming")])
    x = n.join(sums, "community", "left").fillna(0)
    return x.withColumn("internal_ratio", ratio(F.col("internal"), F.col("internal") + F.col("outgoing") + F.col("incoming")))


def bridges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node -> cross edges and distinct other communities, both directions."""
    e = edges.join(parts.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(parts.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst").where("cs <> cd")
    both = e.select(F.col("src").alias("node"), F.col("cd").alias("other")).unionAll(e.select("dst", "cs"))
    return both.groupBy("node").agg(F.count("*").alias("cross_edges"), F.count_distinct("other").alias("communities"))
