"""Graph queries: nations are modules, regions packages and layers; an edge is one of the three strongest trade flows of a nation."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.lineage import cut
from quarry.operators import architecture as R
from quarry.operators import classes as K
from quarry.operators import graph as G
from quarry.operators import grouping as N


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _flows(spark, d):
    x = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).join(_t(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey")).join(_t(spark, d, "supplier"), F.col("l_suppkey") == F.col("s_suppkey"))
    return x.select(F.col("c_nationkey").alias("src"), F.col("s_nationkey").alias("dst"), "l_returnflag").where("src <> dst")


def edges(spark, d) -> DataFrame:
    """src, dst, weight, is_lazy."""
    e = _flows(spark, d).groupBy("src", "dst").agg(F.count("*").alias("weight"), F.bool_and(F.col("l_returnflag") == "R").alias("is_lazy"))
    w = Window.partitionBy("src").orderBy(F.desc("weight"), "dst")
    return cut(e.withColumn("rn", F.row_number().over(w)).where("rn <= 3").drop("rn"))  # the joins are made once a query


def nodes(spark, d) -> DataFrame:
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("node"))


def packages(spark, d) -> DataFrame:
    return _t(spark, d, "nation").join(_t(spark, d, "region"), F.col("n_regionkey") == F.col("r_regionkey")).select(F.col("n_nationkey").alias("node"), F.col("r_name").alias("package"))


def _parts(spark, d):
    return _t(spark, d, "nation").select(F.col("n_nationkey").alias("node"), F.col("n_regionkey").alias("community"))


def import_edges(spark, d):
    return G.dedupe_edges(_flows(spark, d).withColumn("is_lazy", F.col("l_returnflag") == "R"))


def coupling_metrics(spark, d):
    return G.coupling(nodes(spark, d), edges(spark, d))


def coupling_system(spark, d):
    c = coupling_metrics(spark, d)
    return c.agg(F.avg("instability").alias("mean_instability"), F.avg("ca").alias("mean_ca"), R.fan_limit(F.col("ca")).alias("fan_in_limit"), R.fan_limit(F.col("ce")).alias("fan_out_limit"), (0.4 * F.log2(1 + F.sum("ce") / F.count("*")) + 0.3 * F.log2(1 + F.count("*")) + 3 * F.stddev_pop("instability")).alias("complexity"))


def zones(spark, d):
    c = coupling_metrics(spark, d)
    # the share of a nation's flows that are lazy stands for abstractness
    a = edges(spark, d).groupBy(F.col("src").alias("node")).agg(F.avg(F.col("is_lazy").cast("double")).alias("abstractness"))
    x = c.join(a, "node", "left").fillna({"abstractness": 0.0})
    dist = F.abs(F.col("abstractness") + F.col("instability") - 1)
    zone = F.when((F.col("instability") < 0.3) & (F.col("abstractness") < 0.3), "pain").when((F.col("instability") > 0.7) & (F.col("abstractness") > 0.7), "useless").when(dist <= 0.2, "main").otherwise("other")
    return x.select("node", dist.alias("distance"), zone.alias("zone"), S.risk(dist, 0.4, 0.7).alias("risk"))


def root_leaf(spark, d):
    return G.roots_and_leaves(nodes(spark, d), edges(spark, d))


def simple_cycles(spark, d):
    return G.two_cycles(edges(spark, d))


def reachable(spark, d):
    return G.distances(edges(spark, d), nodes(spark, d).where("node = 0"))


def unreachable(spark, d):
    return nodes(spark, d).join(reachable(spark, d).select("node"), "node", "left_anti")


def transitive(spark, d):
    return G.closure(edges(spark, d)).where("src <> dst").groupBy(F.col("src").alias("node")).agg(F.count("*").alias("transitive"))


def cycles(spark, d):
    s = G.strong_components(nodes(spark, d), edges(spark, d))
    return s.withColumn("severity", F.when(F.col("size") >= 10, "critical").when(F.col("size") >= 6, "high").when(F.col("size") >= 3, "medium").otherwise("low"))


def dependency_depth(spark, d):
    return G.depths(nodes(spark, d), edges(spark, d))


def connected(spark, d):
    return G.components(nodes(spark, d), edges(spark, d))


def core_modules(spark, d):
    """Nodes left when those with fewer than four neighbours are peeled off."""
    return G.k_core(edges(spark, d), 4)


def community_graph(spark, d):
    return G.undirected(edges(spark, d))


def community_modularity(spark, d):
    return G.modularity(G.undirected(edges(spark, d)), _parts(spark, d))


def found_communities(spark, d):
    """Communities found by local moves and refinement, which SQL can't express."""
    return N.communities(G.undirected(edges(spark, d)))


def community_metrics(spark, d):
    return G.community_metrics(edges(spark, d), _parts(spark, d))


def bridge_modules(spark, d):
    return G.bridges(edges(spark, d), _parts(spark, d))


def dominant_package(spark, d):
    """The most frequent segment of a nation's customers, ties to the smaller name."""
    n = _t(spark, d, "customer").groupBy("c_nationkey", "c_mktsegment").agg(F.count("*").alias("n"))
    w = Window.partitionBy("c_nationkey").orderBy(F.desc("n"), "c_mktsegment")
    return n.withColumn("rn", F.row_number().over(w)).where("rn = 1").drop("rn")


def package_cohesion(spark, d):
    return R.package_cohesion(edges(spark, d), packages(spark, d))


#: Layer rules: from, allowed, warned, denied (fixed values).
RULES = [("AFRICA", ["ASIA"], ["EUROPE"], ["AMERICA"]), ("AMERICA", ["ASIA", "EUROPE"], [], ["AFRICA"]), ("ASIA", ["AFRICA"], ["AMERICA"], []), ("EUROPE", [], ["ASIA"], ["MIDDLE EAST"])]


def layer_verdicts(spark, d):
    lists = [F.struct(F.lit(f).alias("from_layer"), *[(F.array(*map(F.lit, v)) if v else F.array().cast("array<string>")).alias(k) for k, v in zip(("allow", "warn", "deny"), vs)]) for f, *vs in RULES]
    rules = spark.range(1).select(F.inline(F.array(*lists)))
    return R.layer_edges(edges(spark, d), packages(spark, d).withColumnRenamed("package", "layer"), rules)


def layer_compliance(spark, d):
    return R.compliance(layer_verdicts(spark, d))


def layer_matrix(spark, d):
    p = packages(spark, d)
    e = edges(spark, d).join(p.select(F.col("node").alias("src"), F.col("package").alias("a")), "src").join(p.select(F.col("node").alias("dst"), F.col("package").alias("b")), "dst")
    return e.groupBy(F.col("a").alias("from_layer"), F.col("b").alias("to_layer")).agg(F.count("*").alias("n"))


def dot_lines(spark, d):
    return edges(spark, d).select(F.concat_ws("", F.lit('  "'), "src", F.lit('" -> "'), "dst", F.lit('" [weight='), "weight", F.lit("];")).alias("line"))


def class_cohesion(spark, d):
    """Class = order, method = line, variable = supplier; the names are long, and alike but for their ends."""
    x = _t(spark, d, "lineitem").select(F.concat(F.lit("OrderOfACustomer"), "l_orderkey").alias("class"), F.concat(F.lit("get_line_number_"), "l_linenumber").alias("method"), F.concat(F.lit("supplier_"), "l_suppkey").alias("variable"))
    return K.lcom4(x, x).drop("groups").withColumn("risk", S.risk(F.col("lcom4"), 2, 5))


def class_coupling(spark, d):
    u = _t(spark, d, "lineitem").join(_t(spark, d, "orders"), F.col("l_orderkey") == F.col("o_orderkey")).select(F.col("o_custkey").alias("class"), F.col("l_suppkey").alias("dependency"), F.col("l_returnflag").alias("kind"))
    return K.coupling(u, ["A", "N", "R"], ["class"]).drop("dependencies").withColumn("risk", S.risk(F.col("cbo"), 3, 7))


def def_use_pairs(spark, d):
    e = _t(spark, d, "events")
    return R.def_use(e, ["user_id"], ["ts", "event_id"], F.col("event_type") == "signup", F.col("event_type") == "purchase", "event_id")


def def_use_features(spark, d):
    p = def_use_pairs(spark, d)
    return p.groupBy("user_id", "definition").agg(F.count("*").alias("chain")).groupBy("user_id").agg(F.count("*").alias("definitions"), F.max("chain").alias("longest"), F.avg("chain").alias("mean_chain"))


E = """WITH flows AS (SELECT c_nationkey AS src, s_nationkey AS dst, l_returnflag FROM lineitem JOIN orders ON l_orderkey = o_orderkey JOIN customer ON o_custkey = c_custkey JOIN supplier ON l_suppkey = s_suppkey WHERE c_nationkey <> s_nationkey),
e AS (SELECT src, dst, weight, is_lazy FROM (SELECT *, row_number() OVER (PARTITION BY src ORDER BY weight DESC, dst) AS rn FROM (SELECT src, dst, count(*) AS weight, bool_and(l_returnflag = 'R') AS is_lazy FROM flows GROUP BY 1, 2)) WHERE rn <= 3),
n AS (SELECT n_nationkey AS node, n_regionkey AS community, r_name AS package FROM nation JOIN region ON n_regionkey = r_regionkey),
c AS (SELECT node, coalesce(ca, 0) AS ca, coalesce(ce, 0) AS ce, CASE WHEN coalesce(ca, 0) + coalesce(ce, 0) = 0 THEN 0 ELSE coalesce(ce, 0) / (coalesce(ca, 0) + coalesce(ce, 0)) END::DOUBLE AS instability FROM n LEFT JOIN (SELECT dst AS node, count(DISTINCT src) AS ca FROM e GROUP BY 1) USING (node) LEFT JOIN (SELECT src AS node, count(DISTINCT dst) AS ce FROM e GROUP BY 1) USING (node))
"""
RE = E.replace("WITH flows", "WITH RECURSIVE flows", 1)
CL = RE + ", p AS (SELECT src, dst FROM e UNION SELECT p.src, e.dst FROM p JOIN e ON p.dst = e.src)\n"
SCC = CL + ", s AS (SELECT node, least(node, coalesce(min(q.dst), node)) AS component FROM n LEFT JOIN (SELECT p.src, p.dst FROM p JOIN p AS r ON p.src = r.dst AND p.dst = r.src) AS q ON q.src = node GROUP BY node)\n"
J = " JOIN n AS a ON e.src = a.node JOIN n AS b ON e.dst = b.node "
VERDICT = "CASE " + " ".join(f"WHEN a.package = '{f}' AND b.package IN ({', '.join(repr(x) for x in v)}) THEN '{k}'" for f, al, wa, de in RULES for k, v in (("error", de), ("warning", wa), ("ok", al)) if v) + " ELSE 'unknown' END"

#: 25 nodes are peeled off in 25 rounds at most.
_PEEL = "u{j} AS MATERIALIZED (SELECT u.src, u.dst FROM u{i} AS u WHERE u.src IN (SELECT src FROM u{i} GROUP BY 1 HAVING count(*) >= 4) AND u.dst IN (SELECT src FROM u{i} GROUP BY 1 HAVING count(*) >= 4))"
CORE = E + ", u0 AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), " + ", ".join(_PEEL.format(i=i, j=i + 1) for i in range(25)) + " SELECT DISTINCT src AS node FROM u25"

QUERIES = {
    "import_edges": (import_edges, E + "SELECT src, dst, bool_and(l_returnflag = 'R') AS is_lazy, count(*) AS imports FROM flows GROUP BY 1, 2"),
    "coupling_metrics": (coupling_metrics, E + "SELECT * FROM c"),
    "coupling_system": (coupling_system, E + "SELECT avg(instability) AS mean_instability, avg(ca) AS mean_ca, greatest(2, ceil(avg(ca) + stddev_pop(ca)))::BIGINT AS fan_in_limit, greatest(2, ceil(avg(ce) + stddev_pop(ce)))::BIGINT AS fan_out_limit, 0.4::DOUBLE * log2(1 + sum(ce) / count(*)) + 0.3::DOUBLE * log2(1 + count(*)) + 3 * stddev_pop(instability) AS complexity FROM c"),
    "zones": (zones, E + "SELECT node, d AS distance, CASE WHEN instability < 0.3 AND ab < 0.3 THEN 'pain' WHEN instability > 0.7 AND ab > 0.7 THEN 'useless' WHEN d <= 0.2 THEN 'main' ELSE 'other' END AS zone, CASE WHEN d <= 0.4 THEN 'low' WHEN d <= 0.7 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT *, abs(ab + instability - 1) AS d FROM (SELECT c.*, coalesce(x.ab, 0) AS ab FROM c LEFT JOIN (SELECT src AS node, avg(is_lazy::INT) AS ab FROM e GROUP BY 1) AS x USING (node)))"),
    "root_leaf": (root_leaf, E + "SELECT node, node NOT IN (SELECT src FROM e) AS is_root, node NOT IN (SELECT dst FROM e) AS is_leaf FROM n"),
    "simple_cycles": (simple_cycles, E + "SELECT DISTINCT a.src, a.dst FROM e AS a JOIN e AS b ON a.src = b.dst AND a.dst = b.src WHERE a.src < a.dst"),
    "reachable": (reachable, RE + ", r AS (SELECT 0 AS node, 0::BIGINT AS hops UNION SELECT e.dst, hops + 1 FROM r JOIN e ON r.node = e.src WHERE hops < 30) SELECT node, min(hops) AS hops FROM r GROUP BY 1"),
    "unreachable": (unreachable, RE + ", r AS (SELECT 0 AS node UNION SELECT e.dst FROM r JOIN e ON r.node = e.src) SELECT node FROM n WHERE node NOT IN (SELECT node FROM r)"),
    "transitive": (transitive, CL + "SELECT src AS node, count(*) AS transitive FROM p WHERE src <> dst GROUP BY 1"),
    "cycles": (cycles, SCC + "SELECT node, component, size, CASE WHEN size >= 10 THEN 'critical' WHEN size >= 6 THEN 'high' WHEN size >= 3 THEN 'medium' ELSE 'low' END AS severity FROM s JOIN (SELECT component, count(*) AS size FROM s GROUP BY 1) USING (component)"),
    "dependency_depth": (dependency_depth, SCC + ", g AS (SELECT DISTINCT x.component AS a, y.component AS b FROM e JOIN s AS x ON e.src = x.node JOIN s AS y ON e.dst = y.node WHERE x.component <> y.component), l AS (SELECT DISTINCT component, 1::BIGINT AS depth FROM s UNION SELECT g.b, l.depth + 1 FROM l JOIN g ON l.component = g.a) SELECT component, max(depth) AS depth FROM l GROUP BY 1"),
    "connected": (connected, RE + ", u AS (SELECT src, dst FROM e UNION SELECT dst, src FROM e), p AS (SELECT node AS src, node AS dst FROM n UNION SELECT p.src, u.dst FROM p JOIN u ON p.dst = u.src) SELECT src AS node, min(dst) AS component FROM p GROUP BY 1"),
    "core_modules": (core_modules, CORE),
    "community_graph": (community_graph, E + "SELECT least(src, dst) AS a, greatest(src, dst) AS b, sum(weight)::BIGINT AS weight FROM e GROUP BY 1, 2"),
    "community_modularity": (community_modularity, E + ", w AS (SELECT src AS a, dst AS b, weight FROM e), m AS (SELECT sum(weight)::DOUBLE AS m FROM w), d AS (SELECT community, sum(weight)::DOUBLE AS degree FROM (SELECT a AS node, weight FROM w UNION ALL SELECT b, weight FROM w) JOIN n USING (node) GROUP BY 1), i AS (SELECT x.community, sum(weight)::DOUBLE AS inside FROM w JOIN n AS x ON w.a = x.node JOIN n AS y ON w.b = y.node WHERE x.community = y.community GROUP BY 1) SELECT sum(coalesce(inside, 0) / m - pow(degree / (2 * m), 2)) AS q FROM d LEFT JOIN i USING (community), m"),
    "found_communities": (found_communities, None),
    "community_metrics": (community_metrics, E + ", x AS (SELECT a.community AS f, b.community AS t FROM e" + J + ") SELECT community, size, internal, outgoing, incoming, CASE WHEN internal + outgoing + incoming = 0 THEN 0 ELSE internal / (internal + outgoing + incoming) END::DOUBLE AS internal_ratio FROM (SELECT community, count(*) AS size, (SELECT count(*) FROM x WHERE f = community AND t = community) AS internal, (SELECT count(*) FROM x WHERE f = community AND t <> community) AS outgoing, (SELECT count(*) FROM x WHERE f <> community AND t = community) AS incoming FROM n GROUP BY community)"),
    "bridge_modules": (bridge_modules, E + ", x AS (SELECT e.src, e.dst, a.community AS f, b.community AS t FROM e" + J + "WHERE a.community <> b.community) SELECT node, count(*) AS cross_edges, count(DISTINCT other) AS communities FROM (SELECT src AS node, t AS other FROM x UNION ALL SELECT dst, f FROM x) GROUP BY 1"),
    "dominant_package": (dominant_package, "SELECT c_nationkey, c_mktsegment, n FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY n DESC, c_mktsegment) AS rn FROM (SELECT c_nationkey, c_mktsegment, count(*) AS n FROM customer GROUP BY 1, 2)) WHERE rn = 1"),
    "package_cohesion": (package_cohesion, E + ", x AS (SELECT a.package AS f, b.package AS t FROM e" + J + ") SELECT package, modules, intra, inter, cohesion, modules >= 3 AND inter >= 2 AND cohesion < 0.5 AS flagged FROM (SELECT *, CASE WHEN intra + inter = 0 THEN 1 ELSE intra / (intra + inter) END::DOUBLE AS cohesion FROM (SELECT package, count(*) AS modules, (SELECT count(*) FROM x WHERE f = package AND t = package) AS intra, (SELECT count(*) FROM x WHERE f = package AND t <> package) AS inter FROM n GROUP BY package))"),
    "layer_verdicts": (layer_verdicts, E + f"SELECT e.src, e.dst, a.package AS from_layer, b.package AS to_layer, {VERDICT} AS verdict FROM e" + J + "WHERE a.package <> b.package"),
    "layer_compliance": (layer_compliance, E + f", v AS (SELECT {VERDICT} AS verdict FROM e" + J + "WHERE a.package <> b.package) SELECT checked, errors, warnings, greatest(0, 1 - CASE WHEN checked = 0 THEN 0 ELSE (5 * errors + warnings) / checked END)::DOUBLE AS compliance FROM (SELECT count(*) AS checked, count(*) FILTER (WHERE verdict = 'error') AS errors, count(*) FILTER (WHERE verdict = 'warning') AS warnings FROM v)"),
    "layer_matrix": (layer_matrix, E + "SELECT a.package AS from_layer, b.package AS to_layer, count(*) AS n FROM e" + J + "GROUP BY 1, 2"),
    "dot_lines": (dot_lines, E + "SELECT '  \"' || src || '\" -> \"' || dst || '\" [weight=' || weight || '];' AS line FROM e"),
    "class_cohesion": (class_cohesion, "WITH RECURSIVE u AS (SELECT DISTINCT l_orderkey AS c, l_linenumber AS m, l_suppkey AS v FROM lineitem), l AS (SELECT DISTINCT a.c, a.m AS x, b.m AS y FROM u AS a JOIN u AS b ON a.c = b.c AND a.v = b.v), p AS (SELECT c, x, y FROM l UNION SELECT p.c, p.x, l.y FROM p JOIN l ON p.c = l.c AND p.y = l.x), k AS (SELECT c, x AS m, min(y) AS comp FROM p GROUP BY 1, 2) SELECT 'OrderOfACustomer' || class AS class, methods, variables, lcom4, CASE WHEN lcom4 <= 2 THEN 'low' WHEN lcom4 <= 5 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT u.c AS class, count(DISTINCT u.m) AS methods, count(DISTINCT v) AS variables, count(DISTINCT comp) AS lcom4 FROM u JOIN k ON u.c = k.c AND u.m = k.m GROUP BY 1)"),
    "class_coupling": (class_coupling, "SELECT *, CASE WHEN cbo <= 3 THEN 'low' WHEN cbo <= 7 THEN 'medium' ELSE 'high' END AS risk FROM (SELECT o_custkey AS class, count(DISTINCT l_suppkey) AS cbo, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'A') AS kind_a, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'N') AS kind_n, count(DISTINCT l_suppkey) FILTER (WHERE l_returnflag = 'R') AS kind_r FROM lineitem JOIN orders ON l_orderkey = o_orderkey GROUP BY 1)"),
    "def_use_pairs": (def_use_pairs, "SELECT user_id, definition, event_id AS use FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition FROM events) WHERE event_type = 'purchase' AND definition IS NOT NULL"),
    "def_use_features": (def_use_features, "WITH p AS (SELECT user_id, definition FROM (SELECT *, last_value(CASE WHEN event_type = 'signup' THEN event_id END IGNORE NULLS) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS definition FROM events) WHERE event_type = 'purchase' AND definition IS NOT NULL) SELECT user_id, count(*) AS definitions, max(chain) AS longest, avg(chain) AS mean_chain FROM (SELECT user_id, definition, count(*) AS chain FROM p GROUP BY 1, 2) GROUP BY 1"),
}
