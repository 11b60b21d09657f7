"""Communities of modules against packages and layers: metrics, mismatch, bridges, merging, context map and payload."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.lineage import cut

COLORS = ["#4e79a7", "#f28e2b", "#e15759", "#76b7b2", "#59a14f", "#edc948", "#b07aa1", "#ff9da7", "#9c755f", "#bab0ac"]


def numbered(parts: DataFrame) -> DataFrame:
    """(node, community) -> also id, 'community_1' and on in order of each community's first node."""
    first = parts.groupBy("community").agg(F.min("node").alias("first"))
    rank = F.dense_rank().over(Window.orderBy("first"))  # one row a community
    return parts.join(first.select("community", F.concat(F.lit("community_"), rank.cast("string")).alias("id")), "community").select("node", "community", "id")


def placed(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """src, dst and the community of each end."""
    return edges.select("src", "dst").join(parts.select(F.col("node").alias("src"), F.col("community").alias("cs")), "src").join(parts.select(F.col("node").alias("dst"), F.col("community").alias("cd")), "dst")


def partition_metrics(edges: DataFrame, parts: DataFrame, packages: DataFrame) -> DataFrame:
    """community -> size, packages (sorted), internal, outgoing, incoming and external edges, share of external ones."""
    e = placed(edges, parts)
    rows = e.select(F.col("cs").alias("community"), (F.col("cs") == F.col("cd")).cast("long").alias("internal"), (F.col("cs") != F.col("cd")).cast("long").alias("outgoing"), F.lit(0).cast("long").alias("incoming")).unionAll(
        e.where("cs <> cd").select("cd", F.lit(0).cast("long"), F.lit(0).cast("long"), F.lit(1).cast("long"))
    )
    n = parts.join(packages.select("node", "package"), "node", "left").groupBy("community").agg(F.count("*").alias("size"), F.sort_array(F.collect_set(F.when(F.col("package") != "", F.col("package")))).alias("packages"))
    x = n.join(rows.groupBy("community").agg(*[F.sum(c).alias(c) for c in ("internal", "outgoing", "incoming")]), "community", "left").fillna(0)
    x = x.withColumn("external", F.col("outgoing") + F.col("incoming"))
    return x.withColumn("external_ratio", S.ratio(F.col("external"), F.col("internal") + F.col("external")))


def dominant(parts: DataFrame, values: DataFrame, edges: DataFrame, value: str) -> DataFrame:
    """community -> dominant (most frequent value, ties to the smaller), values (how many), alignment: the share of inner
    edges whose ends have one value, or, without such edges, the dominant value's share of the modules that have one."""
    known = values.where(F.col(value).isNotNull() & (F.col(value) != "") & (F.col(value) != "unknown")).select("node", F.col(value).alias("v"))
    n = parts.join(known, "node").groupBy("community", "v").agg(F.count("*").alias("n"))
    best = n.groupBy("community").agg(F.min_by("v", F.struct((-F.col("n")).alias("n"), "v")).alias("dominant"), F.max("n").alias("top"), F.sum("n").alias("all"), F.count("*").alias("values"))
    e = placed(edges, parts).where("cs = cd").join(known.select(F.col("node").alias("src"), F.col("v").alias("vs")), "src").join(known.select(F.col("node").alias("dst"), F.col("v").alias("vd")), "dst")
    inner = e.groupBy(F.col("cs").alias("community")).agg(F.count("*").alias("edges"), F.count_if(F.col("vs") == F.col("vd")).alias("same"))
    x = best.join(inner, "community", "left")
    return x.select("community", "dominant", "values", F.coalesce(F.col("same") / F.col("edges"), F.col("top") / F.col("all")).alias("alignment"))


def mismatch(parts: DataFrame, values: DataFrame, value: str) -> DataFrame:
    """One row: share of values (packages or layers) that lie in one community, those that are split, and communities that mix."""
    known = parts.join(values.where(F.col(value).isNotNull() & (F.col(value) != "") & (F.col(value) != "unknown")).select("node", F.col(value).alias("v")), "node").select("community", "v").distinct()
    by_value = known.groupBy("v").agg(F.count("*").alias("n"))
    by_part = known.groupBy("community").agg(F.count("*").alias("n"))
    a = by_value.agg(S.ratio(F.count_if(F.col("n") == 1), F.count("*")).alias("score"), F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("v")))).alias("split"))
    b = by_part.agg(F.sort_array(F.collect_list(F.when(F.col("n") > 1, F.col("community")))).alias("mixed"))
    return a.crossJoin(b)  # one row each


def bridges(edges: DataFrame, parts: DataFrame) -> DataFrame:
    """node -> community, cross_edges, targets (sorted), most edges first: both ends of edges between communities."""
    e = placed(edges, parts).where("cs <> cd")
    both = e.select(F.col("src").alias("node"), F.col("cs").alias("community"), F.col("cd").alias("other")).unionAll(e.select("dst", "cd", "cs"))
    return both.groupBy("node", "community").agg(F.count("*").alias("cross_edges"), F.sort_array(F.collect_set("other")).alias("targets")).orderBy(F.desc("cross_edges"), "node")


def layer_bridges(bridge: DataFrame, dominant_layer: DataFrame) -> DataFrame:
    """Nodes of bridges whose community's main layer differs from that of a target's."""
    home = bridge.select("node", "community", F.explode("targets").alias("target")).join(dominant_layer.select("community", F.col("dominant").alias("own")), "community")
    return home.join(dominant_layer.select(F.col("community").alias("target"), F.col("dominant").alias("other")), "target").where("own <> other").select("node").distinct()


def merged_small(weighted: DataFrame, parts: DataFrame, least: int) -> DataFrame:
    """(node, community) after communities of under ``least`` nodes have joined the neighbour they weigh most with, ties to
    the least; one community at a time, the least first, as each merge changes the next (one that has grown meanwhile is still
    merged in its round). Communities, not nodes, are
    looked at on the driver: a row for each pair of neighbours."""
    if least <= 1:
        return parts
    e = weighted.join(parts.select(F.col("node").alias("a"), F.col("community").alias("ca")), "a").join(parts.select(F.col("node").alias("b"), F.col("community").alias("cb")), "b").where("ca <> cb")
    near: dict = {}
    for r in e.groupBy(F.least("ca", "cb").alias("x"), F.greatest("ca", "cb").alias("y")).agg(F.sum("weight").alias("w")).collect():
        near.setdefault(r.x, {})[r.y] = near.setdefault(r.y, {})[r.x] = float(r.w)
    size = {r.community: r.n for r in parts.groupBy("community").agg(F.count("*").alias("n")).collect()}
    into: dict = {}
    changed = True
    while changed:
        changed = False
        for c in sorted(k for k, n in size.items() if n < least):
            if c not in size or not near.get(c):
                continue
            t = min(near[c], key=lambda k: (-near[c][k], k))  # noqa: B023
            for k, w in near.pop(c).items():
                near[k].pop(c, None)
                if k != t:
                    near[t][k] = near[k][t] = near[t].get(k, 0.0) + w
            size[t] += size.pop(c)
            into[c] = t
            changed = True

    def final(c):
        while c in into:
            c = into[c]
        return c

    if not into:
        return parts
    kind = parts.schema["community"].dataType.simpleString()
    names = parts.sparkSession.createDataFrame([(c, final(c)) for c in into], f"community {kind}, _to {kind}")
    return parts.join(names, "community", "left").select("node", F.coalesce("_to", "community").alias("community"))


def level(external_ratio: Column, package_alignment: Column, layer_alignment: Column) -> Column:
    """low, medium (0.3) or high (0.6): external edges count half, misaligned packages and layers a quarter each, where known."""
    w = F.lit(0.5) + F.when(package_alignment.isNotNull(), 0.25).otherwise(0.0) + F.when(layer_alignment.isNotNull(), 0.25).otherwise(0.0)
    part = lambda x: F.coalesce(0.25 * S.clamp(1 - x), F.lit(0.0))
    ratio = (0.5 * S.clamp(external_ratio) + part(package_alignment) + part(layer_alignment)) / w
    return F.when(ratio >= 0.6, "high").when(ratio >= 0.3, "medium").otherwise("low")


def capped(names: Column, most: int) -> Column:
    """The first ``most`` names, and how many more there are; 0 is no limit."""
    more = F.size(names) - most
    return F.when((more > 0) & F.lit(most > 0), F.concat(F.slice(names, F.lit(1), F.lit(most)), F.array(F.concat(F.lit("... +"), more.cast("string"), F.lit(" more"))))).otherwise(names)


def review_scope(names: Column) -> Column:
    """The folder that all dotted names share, with a final slash; of one name its package. Empty without one."""
    parts = F.transform(names, lambda n: F.split(n, r"\."))
    shared = F.aggregate(parts, parts[0], lambda a, b: F.slice(a, F.lit(1), F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)))))
    shared = F.when(F.size(names) == 1, F.slice(shared, F.lit(1), F.greatest(F.size(shared) - 1, F.lit(0)))).otherwise(shared)
    return F.when((F.size(names) > 0) & (F.size(shared) > 0), F.concat(F.array_join(shared, "/"), F.lit("/"))).otherwise("")


def context_map(parts: DataFrame, metrics: DataFrame, bridge: DataFrame, most: int = 20) -> DataFrame:
    """A row for each community: modules (capped), module_count, packages, risk, bridges, scope, summary. metrics has
    community, size, packages, incoming, outgoing, risk."""
    names = parts.groupBy("community").agg(F.sort_array(F.collect_list(F.col("node").cast("string"))).alias("every"))
    over = bridge.groupBy("community").agg(F.sort_array(F.collect_list(F.col("node").cast("string"))).alias("bridge_modules"))
    x = names.join(metrics, "community").join(over, "community", "left").withColumn("bridge_modules", F.coalesce("bridge_modules", F.array().cast("array<string>")))
    cross, n = F.col("incoming") + F.col("outgoing"), F.size("bridge_modules")
    text = F.concat_ws("; ", S.plural(F.col("size"), "module"), S.plural(F.size("packages"), "package"), F.concat(F.lit("risk "), F.col("risk")), S.plural(cross, "cross-community edge"), F.when(n > 0, S.plural(n, "bridge module")))
    return x.select("community", capped(F.col("every"), most).alias("modules"), F.size("every").alias("module_count"), "packages", "risk", "bridge_modules", review_scope(F.col("every")).alias("scope"), F.concat(text, F.lit(".")).alias("summary"))


def payload(edges: DataFrame, parts: DataFrame, bridge: DataFrame, threshold: int = 100) -> tuple[DataFrame, DataFrame]:
    """(nodes, links) of a drawing: modules, or, above ``threshold`` modules, communities with summed links between them."""
    if parts.limit(threshold + 1).count() > threshold:
        nodes = parts.groupBy("community").agg(F.count("*").alias("count")).select(F.col("community").cast("string").alias("id"), "community", F.lit(False).alias("bridge"), "count")
        e = placed(edges, parts).where("cs <> cd").groupBy(F.col("cs").cast("string").alias("src"), F.col("cd").cast("string").alias("dst")).agg(F.count("*").alias("weight"))
        return nodes, e.select("src", "dst", F.lit(True).alias("crosses"), "weight")
    flag = bridge.select("node", F.lit(True).alias("_b"))
    nodes = parts.join(flag, "node", "left").select(F.col("node").cast("string").alias("id"), "community", F.coalesce("_b", F.lit(False)).alias("bridge"), F.lit(1).cast("long").alias("count"))
    e = placed(edges, parts).select(F.col("src").cast("string").alias("src"), F.col("dst").cast("string").alias("dst"), (F.col("cs") != F.col("cd")).alias("crosses"), F.lit(1).cast("long").alias("weight"))
    return nodes, e


def colored(nodes: DataFrame) -> DataFrame:
    """Nodes with a color for each community, in order of communities, around a fixed palette."""
    k = F.dense_rank().over(Window.orderBy("community")) - 1  # nodes of a drawing
    return nodes.withColumn("color", F.element_at(F.array(*map(F.lit, COLORS)), (k % len(COLORS) + 1).cast("int")))


def settled(df: DataFrame) -> DataFrame:
    return cut(df)
