"""Queries of the whole system over the tables: zones, cycles, chains, layers, responsibilities, communities, scores, orders.

Nations are modules, as in ``graphs``; where layers or concerns matter they have dotted names; suppliers stand for modules
whose names show a layer."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.lineage import cut
from quarry.operators import classes as K
from quarry.operators import clones as C
from quarry.operators import code as D
from quarry.operators import communities as N
from quarry.operators import graph as G
from quarry.operators import layers as L
from quarry.operators import modules as M
from quarry.operators import placeholders as H
from quarry.operators import scoring as Q
from quarry.operators import suggestions as U
from quarry.plans import graphs
from quarry.sources import sinks


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def _abstract(e: DataFrame) -> DataFrame:
    """The share of a nation's flows that are heavy stands for abstractness."""
    return e.groupBy(F.col("src").alias("node")).agg(F.avg((F.col("weight") % 2 == 0).cast("double")).alias("abstractness"))


def _zones(spark, d):
    e = graphs.edges(spark, d)
    return M.coupling_facts(G.coupling(graphs.nodes(spark, d), e), _abstract(e)), e


def module_zones(spark, d):
    return _zones(spark, d)[0].select("node", "abstractness", "distance", "stable", "instable", "pain", "useless", "main_sequence")


def system_metrics(spark, d):
    z, _ = _zones(spark, d)
    return z.agg(F.count("*").alias("modules"), F.avg("ca").alias("mean_fan_in"), F.avg("ce").alias("mean_fan_out"), (F.sum("ce") / F.count("*")).alias("dependency_ratio"), F.avg("abstractness").alias("mean_abstractness"), F.avg("distance").alias("deviation"))


def _cyclic(spark, d, e):
    return G.strong_components(graphs.nodes(spark, d), M.load_time(e.withColumn("is_lazy", F.col("weight") % 2 == 0))).where("size > 1")


def lazy_cycles(spark, d):
    """Cycles of edges that count when modules are loaded."""
    return _cyclic(spark, d, graphs.edges(spark, d))


def modularity_index(spark, d):
    e = graphs.edges(spark, d)
    return M.modularity_index(e, graphs.packages(spark, d), _cyclic(spark, d, e))


def refactoring_priorities(spark, d):
    z, e = _zones(spark, d)
    inside = _cyclic(spark, d, e).select("node", F.lit(True).alias("in_cycle"))
    size = _t(spark, d, "customer").groupBy(F.col("c_nationkey").alias("node")).agg(F.count("*").alias("complexity"))
    x = z.select("node", "distance").join(inside, "node", "left").join(size, "node", "left").fillna({"in_cycle": False, "complexity": 0})
    return M.refactoring(x)


def longest_chains(spark, d):
    e = M.load_time(graphs.edges(spark, d).withColumn("is_lazy", F.col("weight") % 2 == 0))
    return G.longest_chains(graphs.nodes(spark, d), e).select("component", F.col("length").cast("long").alias("length"))


def shortest_paths(spark, d):
    return G.shortest_paths(graphs.edges(spark, d), graphs.nodes(spark, d).where("node = 0"))


def cycle_details(spark, d):
    e = M.load_time(graphs.edges(spark, d).withColumn("is_lazy", F.col("weight") % 2 == 0))
    return G.cycle_details(graphs.nodes(spark, d), e).select("component", "size", "chains", "has_core", "severity", F.array_join(F.transform("modules", lambda m: m.cast("string")), ",").alias("modules"))


def cycle_statistics(spark, d):
    e = M.load_time(graphs.edges(spark, d).withColumn("is_lazy", F.col("weight") % 2 == 0))
    return G.cycle_statistics(G.cycle_details(graphs.nodes(spark, d), e)).select("cycles", "low", "medium", "high", "critical", "modules")


def cycle_advice(spark, d):
    e = M.load_time(graphs.edges(spark, d).withColumn("is_lazy", F.col("weight") % 2 == 0))
    c = cut(G.cycle_details(graphs.nodes(spark, d), e))
    return U.of_cycles(L.cycle_advice(c, c.select(F.col("component").alias("node")).limit(0))).agg(F.count("*").alias("n"), F.count_if(F.col("description").startswith("Break")).alias("pairs"))


# -- layers ---------------------------------------------------------------------------------------------------------

#: Names of modules and the layer of the layered style that they belong to, by hand.
NAMES = [
    ("shop.api.m", "presentation"), ("shop.user_service.m", "application"), ("shop.models.m", "domain"), ("shop.core.db.m", "domain"), ("tests.api.m", "unknown"), ("shop.misc.m", "unknown"),
    ("shop.order_repo.m", "infrastructure"), ("views.thing.m", "presentation"), ("shop.DOMAIN.web.m", "domain"),
]


def _named(col):
    return F.element_at(F.array(*[F.lit(n) for n, _ in NAMES]), (F.pmod(col, F.lit(len(NAMES))) + 1).cast("int"))


def module_layers(spark, d):
    names = _t(spark, d, "supplier").select(F.concat(_named(F.col("s_suppkey")), F.col("s_suppkey").cast("string")).alias("module"))
    return L.module_layers(names, L.patterns(spark, L.LAYERS["layered"]))


def _layered(spark, d):
    """Nations by name, and their edges."""
    name = lambda c: F.concat(_named(F.col(c)), F.col(c).cast("string"))
    e = graphs.edges(spark, d).select(name("src").alias("src"), name("dst").alias("dst"))
    layers = L.module_layers(graphs.nodes(spark, d).select(name("node").alias("module")), L.patterns(spark, L.LAYERS["layered"]))
    return e, layers


def _violations(spark, d, strict=False):
    e, layers = _layered(spark, d)
    _, rules = L.style_rules("layered", rules={"presentation": (["application"], ["domain"], ["infrastructure"])})
    return L.violations(e, layers, L.rule_table(spark, rules), strict)


def layer_violations(spark, d):
    return _violations(spark, d).where("severity is not null").select("src", "dst", "severity", "rule")


def layer_violations_strict(spark, d):
    return _violations(spark, d, True).groupBy("severity", "rule").agg(F.count("*").alias("n"))


def layer_cohesion(spark, d):
    return L.layer_cohesion(_violations(spark, d))


def layer_targets(spark, d):
    return L.targets(_violations(spark, d))


def architecture_suggestions(spark, d):
    x = U.of_architecture(_violations(spark, d))
    return x.select("category", "severity", "effort", "title", F.regexp_extract("description", r"\((targets?: .*)\)$", 1).alias("targets"))


def architecture_recommendations(spark, d):
    v = cut(_violations(spark, d))
    done = v.agg(F.count("*").alias("checked"), F.count_if(F.col("severity") == "error").alias("errors"), F.count_if(F.col("severity") == "warning").alias("warnings"))
    c = done.select(F.greatest(F.lit(0.0), 1 - S.ratio(5 * F.col("errors") + F.col("warnings"), F.col("checked"))).alias("compliance"))
    return L.recommendations(c, v, L.layer_cohesion(v)).select("priority", "kind", F.coalesce("subject", F.lit("")).alias("subject"))


def responsibilities(spark, d):
    """Modules app.<region>.<nation>: a concern is a foreign region, or a nation of the own one."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.concat(F.lit("app.r"), F.col("n_regionkey").cast("string"), F.lit(".n"), F.col("n_nationkey").cast("string")).alias("name"))
    e = graphs.edges(spark, d).join(n.toDF("src", "a"), "src").join(n.toDF("dst", "b"), "dst").select(F.col("a").alias("src"), F.col("b").alias("dst"))
    x = L.responsibilities(n.select(F.col("name").alias("node")), e, 2)
    return x.select("node", "fan_in", "fan_out", F.array_join("concerns", ",").alias("concerns"), "is_hub", "is_overloaded", "severity")


# -- communities ----------------------------------------------------------------------------------------------------


def _parts(spark, d):
    return graphs._parts(spark, d)


def _segment(spark, d):
    """The main market segment of a nation's customers stands for its package."""
    return graphs.dominant_package(spark, d).select(F.col("c_nationkey").alias("node"), F.col("c_mktsegment").alias("package"))


def community_partition(spark, d):
    x = N.partition_metrics(graphs.edges(spark, d), _parts(spark, d), _segment(spark, d))
    return x.withColumn("packages", F.array_join("packages", ","))


def community_dominant(spark, d):
    return N.dominant(_parts(spark, d), _segment(spark, d), graphs.edges(spark, d), "package")


def community_mismatch(spark, d):
    x = N.mismatch(_parts(spark, d), _segment(spark, d), "package")
    return x.select("score", F.array_join("split", ",").alias("split"), F.array_join(F.transform("mixed", lambda c: c.cast("string")), ",").alias("mixed"))


def community_bridges(spark, d):
    return N.bridges(graphs.edges(spark, d), _parts(spark, d)).withColumn("targets", F.array_join(F.transform("targets", lambda c: c.cast("string")), ",")).limit(10)


def community_layer_bridges(spark, d):
    e = graphs.edges(spark, d)
    main = N.dominant(_parts(spark, d), _segment(spark, d), e, "package")
    return N.layer_bridges(N.bridges(e, _parts(spark, d)), main)


def community_numbers(spark, d):
    return N.numbered(_parts(spark, d).withColumn("community", 10 - F.col("community")))


def community_merged(spark, d):
    """Communities by nation key modulo 8, those of under four members merged."""
    parts = graphs.nodes(spark, d).select("node", F.col("node").cast("long").alias("community")).withColumn("community", F.least(F.col("community"), F.lit(20)))
    return N.merged_small(G.undirected(graphs.edges(spark, d)), parts, 3).groupBy("community").agg(F.count("*").alias("n"))


def _metrics(spark, d):
    e = graphs.edges(spark, d)
    x = N.partition_metrics(e, _parts(spark, d), _segment(spark, d)).join(N.dominant(_parts(spark, d), _segment(spark, d), e, "package").select("community", "alignment"), "community", "left")
    return x.withColumn("risk", N.level(F.col("external_ratio"), F.col("alignment"), F.lit(None).cast("double"))), e


def community_context(spark, d):
    x, e = _metrics(spark, d)
    c = N.context_map(_parts(spark, d), x, N.bridges(e, _parts(spark, d)), 3)
    return c.select("community", F.array_join("modules", ",").alias("modules"), "module_count", "risk", F.size("bridge_modules").alias("bridges"), "summary")


def community_risk(spark, d):
    x, e = _metrics(spark, d)
    q = G.modularity(G.undirected(e), _parts(spark, d))
    b = N.bridges(e, _parts(spark, d)).agg(F.count("*").alias("bridges"))
    m = N.mismatch(_parts(spark, d), _segment(spark, d), "package").select("score")
    one = x.agg(F.count("*").alias("n"), F.sum("internal").alias("internal"), F.sum("outgoing").alias("cross")).crossJoin(q).crossJoin(b).crossJoin(m)  # one row each
    risk = Q.community_risk(F.col("n"), F.col("q"), F.col("bridges"), F.col("internal"), F.col("cross"), F.col("score"), F.lit(None).cast("double"))
    return one.select(F.round(risk, 9).alias("risk"), S.half_up(100 * risk).alias("score"), Q.community_penalty(risk).alias("penalty"))


def community_payload(spark, d):
    e = graphs.edges(spark, d)
    nodes, links = N.payload(e, _parts(spark, d), N.bridges(e, _parts(spark, d)), 10)
    return links.select("src", "dst", "crosses", "weight").unionByName(N.colored(nodes).select(F.col("id").alias("src"), F.lit("node").alias("dst"), "bridge", F.col("count").alias("weight")).withColumnRenamed("bridge", "crosses"))


# -- scores ---------------------------------------------------------------------------------------------------------


def _numbers(spark, d):
    p = _t(spark, d, "part").agg(F.count("*").alias("n"), F.count_if(F.col("p_size") > 40).alias("high"), F.count_if(F.col("p_size").between(26, 40)).alias("medium"), (F.avg("p_size") / 10).alias("mean"))
    return p.crossJoin(_t(spark, d, "nation").agg(F.count("*").alias("modules")))  # one row each


def system_scores(spark, d):
    c, x = F.col, _numbers(spark, d)
    keep = Q.maintainability(c("modules"), c("mean"), F.lit(5), F.lit(10), F.lit(20))
    mod = Q.modularity_score(F.lit(0.0), c("modules"), F.lit(5), c("mean"), F.lit(10))
    x = x.select(
        Q.cohesion_penalty(c("high"), c("medium"), c("n")).alias("cohesion"), Q.dependency_penalty(c("modules"), F.lit(10), F.lit(9), F.lit(0.5)).alias("dependency"), keep.alias("maintainability"), mod.alias("modularity"),
        Q.debt_hours(F.lit(3), F.lit(4), c("modules"), F.lit(2), F.lit(1)).alias("debt"), Q.fallback(c("mean") * 6, F.lit(1), c("high"), F.lit(0)).alias("fallback"), Q.system_quality(keep, mod, F.lit(None).cast("double")).alias("quality"),
    )
    return x.withColumn("cohesion_score", Q.category_score(F.col("cohesion"))).withColumn("healthy", Q.is_healthy(F.col("fallback")))


def invalid_numbers(spark, d):
    """Numbers of a summary that are out of their ranges."""
    x = _numbers(spark, d).select((F.col("n") + 1).alias("skipped_files"), F.col("n").alias("total_files"), (-F.col("mean")).alias("mean_complexity"), F.lit(101.0).alias("duplication"), F.lit(0.5).alias("compliance"), F.col("high").alias("high_lcom"), F.col("n").alias("lcom_classes"))
    return Q.invalid(x)


def duplication_percent(spark, d):
    x = _t(spark, d, "documents").agg(F.count("*").alias("n"), F.count_distinct("text").alias("different"))
    p = C.duplication(F.col("n") - F.col("different"), F.col("n"))
    return x.select(p.alias("percent"), Q.duplication_penalty(p).alias("penalty"))


def refactoring_summary(spark, d):
    """Counts and scores of a system in one row."""
    z, e = _zones(spark, d)
    a = z.agg(F.count("*").alias("modules"), F.avg(F.col("ca") + F.col("ce")).alias("mean_coupling"), F.count_if("pain").alias("pain"), F.count_if(F.col("distance") > 0.7).alias("high_risk"))
    b = _cyclic(spark, d, e).agg(F.count("*").alias("in_cycles"))
    c = _violations(spark, d).agg(F.count_if(F.col("severity").isNotNull()).alias("violations"))
    x = a.crossJoin(b).crossJoin(c)  # one row each
    return x.withColumn("debt", Q.debt_hours(F.col("high_risk"), F.col("in_cycles"), F.col("violations"), F.lit(0), F.lit(0)))


# -- clones, names, orders ------------------------------------------------------------------------------------------


def _ranges(spark, d):
    """Lines of orders as fragments: an order is a file, a line number times ten where it starts."""
    x = _t(spark, d, "lineitem").groupBy("l_orderkey", "l_linenumber").agg(F.max("l_quantity").cast("int").alias("q"), F.count("*").alias("k"))
    return x.select(F.concat_ws("#", F.col("l_orderkey").cast("string"), F.col("l_linenumber").cast("string")).alias("id"), F.col("l_orderkey").cast("string").alias("path"), (F.col("l_linenumber") * 10).alias("start_line"), (F.col("l_linenumber") * 10 + F.col("q")).alias("end_line"), (F.col("q") + 1).alias("size"), (F.col("q") + 1).alias("lines"))


def fragment_pairs(spark, d):
    """Pairs of one order's fragments that don't overlap and are of like size."""
    f = cut(_ranges(spark, d))
    pairs = f.select(F.col("id").alias("a"), "path").join(f.select(F.col("id").alias("b"), "path"), "path").where("a < b")
    return C.located(pairs.select("a", "b"), f).select("a", "b")


def significant_pairs(spark, d):
    """Typed pairs of neighbouring parts, filtered by threshold, distance, type and size."""
    p = _t(spark, d, "part").select("p_partkey", "p_size")
    x = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("s")), "p_partkey").select(F.col("p_partkey").alias("a"), (F.col("p_partkey") + 1).alias("b"), S.closeness(F.col("p_size"), F.col("s")).alias("similarity"), (F.col("p_partkey") % 4 + 1).cast("int").alias("type"), F.abs(F.col("p_size") - F.col("s")).cast("double").alias("distance"), F.col("p_size").alias("a_size"), F.col("s").alias("b_size"))
    return C.selected(C.significant(x, 0.65, 5.0, 10), (1, 2, 4), 0.7, 1.0).select("a", "b", "type", "similarity")


def clone_cascade(spark, d):
    """The type of neighbouring parts from four scores made of their sizes."""
    p = _t(spark, d, "part").select("p_partkey", "p_size")
    x = p.join(p.select((F.col("p_partkey") - 1).alias("p_partkey"), F.col("p_size").alias("s")), "p_partkey").withColumn("c", S.closeness(F.col("p_size"), F.col("s")))
    f = C.classified(F.col("c") - 0.1, F.col("c") - 0.05, F.when(F.col("p_size") % 3 > 0, F.col("c")), F.col("c") + 0.05)
    return x.select("p_partkey", f.alias("f"), "p_size", "s").where("f is not null").select("p_partkey", "f.type", "f.similarity", "f.confidence", C.confidence(F.col("f.similarity"), F.col("p_size"), F.col("s")).alias("sure"))


def semantic_scores(spark, d):
    """Likeness of flow and data flow of neighbouring parts, whose numbers stand for blocks, edges and the like."""
    p = _t(spark, d, "part").select("p_partkey", "p_size")

    def shape(e, key, size):
        kinds = F.create_map(F.lit("normal"), size, F.lit("loop"), size % 3, F.lit("cond_true"), size % 5)
        return [key.alias("k"), (size + 2).alias(f"{e}_blocks"), (size * 2).alias(f"{e}_edges"), kinds.alias(f"{e}_edge_types"), (size % 7).alias(f"{e}_defs"), (size % 11).alias(f"{e}_pairs"), (size % 2).alias(f"{e}_cross_pairs"), F.create_map(F.lit("assign"), size % 7).alias(f"{e}_def_kinds"), F.create_map(F.lit("load"), size % 11, F.lit("call"), F.lit(1)).alias(f"{e}_use_kinds")]

    a = p.select(*shape("a", F.col("p_partkey"), F.col("p_size")))
    b = p.select(*shape("b", F.col("p_partkey") - 1, F.col("p_size")))
    return a.join(b, "k").select("k", F.round(C.flow_similarity(), 9).alias("flow"), F.round(C.dataflow_similarity(), 9).alias("dataflow"))


def name_forms(spark, d):
    """Forms of dotted names made from parts: leaf, package, case, layer pattern, scope, folder, numbers as text."""
    p = _t(spark, d, "part")
    name = F.concat(F.lit("app."), F.lower(F.replace("p_brand", F.lit("#"), F.lit("_"))), F.when(F.col("p_partkey") % 2 == 0, ".core.").otherwise(".web."), F.when(F.col("p_partkey") % 3 == 0, "MAX").when(F.col("p_partkey") % 3 == 1, "_Part").otherwise("part"))
    x = p.select("p_partkey", "p_size", name.alias("name"))
    n = F.col("name")
    return x.select(
        "p_partkey", S.leaf(n).alias("leaf"), S.package(n).alias("package"), S.is_upper_constant(S.leaf(n)).alias("is_constant"), S.is_class_like(n).alias("is_class"), S.is_public(S.leaf(n)).alias("is_public"), S.module_matches(n, "core").alias("in_core"),
        S.module_matches(n, "app.*.web.*").alias("in_web"), S.common_prefix(n, F.lit("app.brand_11.core.x")).alias("prefix"), N.review_scope(F.array(n, F.lit("app.brand_11.core.x"))).alias("scope"), S.common_directory(F.replace(n, F.lit("."), F.lit("/")), F.lit("app/brand_11/web/y")).alias("folder"),
        S.plural(F.col("p_size"), "module").alias("modules"), S.percentage(F.col("p_size") / 100).alias("percent"), S.thousands(F.col("p_partkey") * 1000).alias("thousands"), S.duration(F.col("p_size") * 40).alias("took"), H.is_test_module(n).alias("is_test"),
        F.array_join(N.capped(F.split(n, r"\."), 2), ",").alias("capped"),
    )


def axis_ends(spark, d):
    return _t(spark, d, "part").select("p_partkey", sinks.nice_ceiling(F.col("p_partkey")).alias("top")).groupBy("top").agg(F.count("*").alias("n"))


def function_order(spark, d):
    """The first functions by risk, then complexity, then place."""
    x = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start_line"), F.col("p_name").alias("function"), F.col("p_size").alias("cyclomatic"), S.risk(F.col("p_size"), 9, 19).alias("risk"))
    return D.sorted_functions(x, "risk").limit(25).select("path", "start_line", "cyclomatic", "risk")


def class_order(spark, d):
    x = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("class_line"), F.col("p_name").alias("class"), F.col("p_size").alias("cbo"), S.risk(F.col("p_size"), 3, 7).alias("risk"))
    return K.sorted_classes(x, "cbo").limit(25).select("path", "class_line", "cbo")


def finding_order(spark, d):
    x = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("start_line"), F.col("p_name").alias("function"), F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "warning").otherwise("info").alias("severity"))
    return D.sorted_findings(D.at_least(x, "warning")).limit(25).select("path", "start_line", "severity")


def file_order(spark, d):
    """Files with findings, the worst first."""
    x = _t(spark, d, "part").select(F.col("p_brand").alias("path"), F.col("p_partkey").alias("line"), F.lit(0).alias("col"), F.element_at(F.array(*map(F.lit, ("keyword", "domain", "email"))), (F.col("p_partkey") % 3 + 1).cast("int")).alias("kind"), F.when(F.col("p_size") > 45, "error").when(F.col("p_size") > 20, "warning").otherwise("info").alias("severity"))
    return H.sorted_files(H.selected(x, "info", ["keyword", "domain"])).limit(10)


def suggestion_order(spark, d):
    x = _t(spark, d, "part").select(F.when(F.col("p_size") > 40, "critical").when(F.col("p_size") > 20, "warning").otherwise("info").alias("severity"), F.element_at(F.array(*map(F.lit, U.EFFORTS)), (F.col("p_partkey") % 3 + 1).cast("int")).alias("effort"))
    return x.groupBy("severity", "effort", U.priority(F.col("severity"), F.col("effort")).alias("priority")).agg(F.count("*").alias("n"))


def report_rows(spark, d):
    """A report in two columns: a summary and twelve lines, here three, for each module."""
    p = _t(spark, d, "part")
    one = p.agg(F.count("*").alias("Total Files"), F.max("p_size").alias("Most"))
    m = p.groupBy(F.col("p_brand").alias("path")).agg(F.count("*").alias("Functions"), F.max("p_size").alias("Max Complexity"))
    return sinks.metric_rows(one, m)


def graph_lines(spark, d):
    return sinks.dot_lines(graphs.edges(spark, d).join(_t(spark, d, "nation").select(F.col("n_nationkey").alias("src"), "n_name"), "src").select(F.col("n_name").alias("src"), "dst", "weight"), "weight")


def context_lines(spark, d):
    """Three sentences on either side of each sentence of a turn that holds a 'th'."""
    x = _t(spark, d, "conversations").select(F.concat_ws("/", F.col("conv_id").cast("string"), F.col("turn").cast("string")).alias("path"), F.posexplode(F.split("text", r"\. ")).alias("line", "text"))
    found = x.where(F.col("text").contains("th")).select("path", F.col("line").alias("start_line"), F.col("line").alias("end_line"))
    return D.context(x, found).groupBy("path", "start_line").agg(F.count("*").alias("n"), F.min("context_line").alias("least"))


E, RE = graphs.E, graphs.RE
Z = E + ", a AS (SELECT src AS node, avg((weight % 2 = 0)::INT) AS abstractness FROM e GROUP BY 1), z AS (SELECT *, abs(abstractness + instability - 1) AS distance FROM (SELECT c.*, coalesce(a.abstractness, 0) AS abstractness FROM c LEFT JOIN a USING (node))) "
RZ = Z.replace("WITH flows", "WITH RECURSIVE flows", 1)
#: Components of the edges that count when modules are loaded.
LAZY = ", el AS (SELECT src, dst FROM e WHERE weight % 2 <> 0), pl AS (SELECT src, dst FROM el UNION SELECT pl.src, el.dst FROM pl JOIN el ON pl.dst = el.src), sl AS (SELECT node, least(node, coalesce(min(q.dst), node)) AS component FROM n LEFT JOIN (SELECT p.src, p.dst FROM pl AS p JOIN pl AS r ON p.src = r.dst AND p.dst = r.src) AS q ON q.src = node GROUP BY node), sz AS (SELECT component, count(*) AS size FROM sl GROUP BY 1 HAVING count(*) > 1) "
_VALUES = ", ".join(f"({k}, '{n}', '{layer}')" for k, (n, layer) in enumerate(NAMES))
LAYERED = E + f", nm AS (SELECT node, name || node AS module, layer FROM n JOIN (VALUES {_VALUES}) AS v(k, name, layer) ON node % {len(NAMES)} = k), v AS (SELECT a.module AS src, b.module AS dst, a.layer AS f, b.layer AS t FROM e JOIN nm AS a ON src = a.node JOIN nm AS b ON dst = b.node), w AS (SELECT *, CASE WHEN f = 'unknown' OR t = 'unknown' THEN NULL WHEN f = 'presentation' THEN CASE t WHEN 'infrastructure' THEN 'error' WHEN 'domain' THEN 'warning' WHEN 'application' THEN NULL ELSE 'error' END WHEN f = 'application' THEN CASE WHEN t IN ('application', 'domain', 'infrastructure') THEN NULL ELSE 'error' END WHEN f = 'domain' THEN CASE WHEN t IN ('presentation', 'application') THEN 'error' END ELSE CASE WHEN t = 'presentation' THEN 'error' END END AS severity, CASE WHEN f = 'presentation' THEN CASE t WHEN 'infrastructure' THEN f || ' !> ' || t WHEN 'domain' THEN f || ' ~> ' || t ELSE f || ' -> {{application}}' END WHEN f = 'application' THEN f || ' -> {{application,domain,infrastructure}}' WHEN f = 'domain' THEN f || ' !> ' || t ELSE f || ' -> {{infrastructure,domain,application}}' END AS rule FROM v) "
SEG = ", sg AS (SELECT c_nationkey AS node, c_mktsegment AS package FROM (SELECT *, row_number() OVER (PARTITION BY c_nationkey ORDER BY k DESC, c_mktsegment) AS rn FROM (SELECT c_nationkey, c_mktsegment, count(*) AS k FROM customer GROUP BY 1, 2)) WHERE rn = 1), x AS (SELECT e.src, e.dst, a.community AS f, b.community AS t FROM e JOIN n AS a ON e.src = a.node JOIN n AS b ON e.dst = b.node) "
PM = SEG + ", pm AS (SELECT community, (SELECT count(*) FROM n AS y WHERE y.community = k.community) AS size, (SELECT string_agg(DISTINCT sg.package, ',' ORDER BY sg.package) FROM n AS y JOIN sg USING (node) WHERE y.community = k.community) AS packages, (SELECT count(*) FROM x WHERE f = community AND t = community) AS internal, (SELECT count(*) FROM x WHERE f = community AND t <> community) AS outgoing, (SELECT count(*) FROM x WHERE f <> community AND t = community) AS incoming FROM (SELECT DISTINCT community FROM n) AS k) "
DOM = ", dm AS (SELECT community, dominant, vals, coalesce(same / edges, top / total) AS alignment FROM (SELECT community, arg_min(package, (-k, package)) AS dominant, max(k) AS top, sum(k) AS total, count(*) AS vals FROM (SELECT community, sg.package, count(*) AS k FROM n AS y JOIN sg USING (node) GROUP BY 1, 2) GROUP BY 1) LEFT JOIN (SELECT f AS community, count(*) AS edges, count(*) FILTER (WHERE p.package = q.package) AS same FROM x JOIN sg AS p ON x.src = p.node JOIN sg AS q ON x.dst = q.node WHERE f = t GROUP BY 1) USING (community)) "
DOM = DOM.replace("arg_min(package, (-k, package))", "first(package ORDER BY k DESC, package)")
BR = ", br AS (SELECT node, community, count(*) AS cross_edges, string_agg(DISTINCT other::VARCHAR, ',' ORDER BY other::VARCHAR) AS targets FROM (SELECT src AS node, f AS community, t AS other FROM x WHERE f <> t UNION ALL SELECT dst, t, f FROM x WHERE f <> t) GROUP BY 1, 2) "
RISKS = ", rk AS (SELECT pm.*, CASE WHEN r >= 0.6 THEN 'high' WHEN r >= 0.3 THEN 'medium' ELSE 'low' END AS risk FROM (SELECT pm.community, (0.5 * CASE WHEN internal + outgoing + incoming = 0 THEN 0 ELSE (outgoing + incoming) / (internal + outgoing + incoming) END + CASE WHEN alignment IS NULL THEN 0 ELSE 0.25 * (1 - alignment) END) / CASE WHEN alignment IS NULL THEN 0.5 ELSE 0.75 END AS r FROM pm LEFT JOIN dm USING (community)) JOIN pm USING (community)) "
NUM = "x AS (SELECT count(*) AS n, count(*) FILTER (WHERE p_size > 40) AS high, count(*) FILTER (WHERE p_size BETWEEN 26 AND 40) AS medium, avg(p_size) / 10 AS mean FROM part), y AS (SELECT x.*, modules FROM x, (SELECT count(*) AS modules FROM nation))"
NEXT = "x AS (SELECT a.p_partkey, a.p_size, b.p_size AS s, CASE WHEN greatest(a.p_size, b.p_size) = 0 THEN 1 ELSE 1 - abs(a.p_size - b.p_size) / greatest(a.p_size, b.p_size) END AS c FROM part AS a JOIN part AS b ON b.p_partkey = a.p_partkey + 1)"
_N = lambda a, b: f"CASE WHEN greatest({a}, {b}) = 0 THEN 1.0 ELSE 1 - abs({a} - {b}) / greatest({a}, {b})::DOUBLE END"

QUERIES = {
    "module_zones": (module_zones, Z + "SELECT node, abstractness, distance, instability <= 0.3 AS stable, instability >= 0.7 AS instable, distance >= 0.5 AND ca >= 2 AND instability <= 0.3 AND abstractness <= 0.3 AS pain, distance >= 0.5 AND instability >= 0.7 AND abstractness >= 0.7 AS useless, distance <= 0.2 AS main_sequence FROM z"),
    "system_metrics": (system_metrics, Z + "SELECT count(*) AS modules, avg(ca) AS mean_fan_in, avg(ce) AS mean_fan_out, sum(ce) / count(*) AS dependency_ratio, avg(abstractness) AS mean_abstractness, avg(distance) AS deviation FROM z"),
    "lazy_cycles": (lazy_cycles, RE + LAZY + "SELECT node, component, size FROM sl JOIN sz USING (component)"),
    "modularity_index": (modularity_index, RE + LAZY + ", t AS (SELECT count(*) AS edges, count(*) FILTER (WHERE a.package = b.package) AS intra FROM e JOIN n AS a ON src = a.node JOIN n AS b ON dst = b.node), k AS (SELECT coalesce(sum(size), 0)::BIGINT AS cyclic FROM sz) SELECT (SELECT count(*) FROM n) AS modules, (SELECT count(DISTINCT package) FROM n) AS packages, edges, cyclic, intra / edges * (1 - 0.5 * cyclic / (SELECT count(*) FROM n)) AS \"index\" FROM t, k"),
    "refactoring_priorities": (refactoring_priorities, RZ + LAZY + "SELECT node, priority FROM (SELECT z.node, CASE WHEN distance > 0.5 THEN distance * 50 ELSE 0 END + CASE WHEN sz.size IS NOT NULL THEN 30 ELSE 0 END + greatest(0, (coalesce(k, 0) - 20) * 2) AS priority FROM z JOIN sl USING (node) LEFT JOIN sz USING (component) LEFT JOIN (SELECT c_nationkey AS node, count(*) AS k FROM customer GROUP BY 1) USING (node)) WHERE priority > 10 ORDER BY priority DESC, node LIMIT 10"),
    "longest_chains": (longest_chains, RE + LAZY + ", g AS (SELECT DISTINCT x.component AS a, y.component AS b FROM el JOIN sl AS x ON src = x.node JOIN sl AS y ON dst = y.node WHERE x.component <> y.component), l AS (SELECT DISTINCT component, 1::BIGINT AS depth FROM sl UNION SELECT g.b, l.depth + 1 FROM l JOIN g ON l.component = g.a) SELECT component, max(depth) AS length FROM l GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "shortest_paths": (shortest_paths, RE + ", r AS (SELECT 0 AS node, 0::BIGINT AS hops UNION SELECT e.dst, hops + 1 FROM r JOIN e ON r.node = e.src WHERE hops < 30), h AS (SELECT node, min(hops) AS hops FROM r GROUP BY 1) SELECT h.node, h.hops, min(p.node) AS parent FROM h LEFT JOIN e ON e.dst = h.node LEFT JOIN h AS p ON p.node = e.src AND p.hops = h.hops - 1 GROUP BY 1, 2"),
    "cycle_details": (cycle_details, RE + LAZY + ", fi AS (SELECT dst AS node, count(*) AS k FROM el GROUP BY 1) SELECT component, size, (SELECT count(*) FROM el JOIN sl AS a ON src = a.node JOIN sl AS b ON dst = b.node WHERE a.component = sz.component AND b.component = sz.component) AS chains, core AS has_core, CASE WHEN core OR size >= 10 THEN 'critical' WHEN size >= 6 THEN 'high' WHEN size >= 3 THEN 'medium' ELSE 'low' END AS severity, modules FROM sz JOIN (SELECT component, max(coalesce(k, 0)) > 10 AS core, string_agg(node::VARCHAR, ',' ORDER BY node) AS modules FROM sl LEFT JOIN fi USING (node) GROUP BY 1) USING (component)"),
    "cycle_statistics": (cycle_statistics, RE + LAZY + ", fi AS (SELECT dst AS node, count(*) AS k FROM el GROUP BY 1), s AS (SELECT size, CASE WHEN core OR size >= 10 THEN 'critical' WHEN size >= 6 THEN 'high' WHEN size >= 3 THEN 'medium' ELSE 'low' END AS severity FROM sz JOIN (SELECT component, max(coalesce(k, 0)) > 10 AS core FROM sl LEFT JOIN fi USING (node) GROUP BY 1) USING (component)) SELECT count(*) AS cycles, count(*) FILTER (WHERE severity = 'low') AS low, count(*) FILTER (WHERE severity = 'medium') AS medium, count(*) FILTER (WHERE severity = 'high') AS high, count(*) FILTER (WHERE severity = 'critical') AS critical, coalesce(sum(size), 0)::BIGINT AS modules FROM s"),
    "cycle_advice": (cycle_advice, RE + LAZY + ", top AS (SELECT size FROM sz JOIN (SELECT component, string_agg(node::VARCHAR, ',' ORDER BY node) AS m FROM sl GROUP BY 1) USING (component) ORDER BY size DESC, m LIMIT 3) SELECT CASE WHEN (SELECT count(*) FROM sz) = 0 THEN 0 ELSE 3 + (SELECT count(*) FROM top WHERE size <= 4) END AS n, (SELECT count(*) FROM top WHERE size = 2) AS pairs"),
    "module_layers": (module_layers, f"SELECT name || s_suppkey AS module, layer FROM supplier JOIN (VALUES {_VALUES}) AS v(k, name, layer) ON s_suppkey % {len(NAMES)} = k"),
    "layer_violations": (layer_violations, LAYERED + "SELECT src, dst, severity, rule FROM w WHERE severity IS NOT NULL"),
    "layer_violations_strict": (layer_violations_strict, LAYERED + "SELECT severity, rule, count(*) AS n FROM (SELECT CASE WHEN f = 'unknown' OR t = 'unknown' THEN 'warning' ELSE severity END AS severity, CASE WHEN f = 'unknown' OR t = 'unknown' THEN 'strict_mode' WHEN severity IS NOT NULL THEN rule END AS rule FROM w) GROUP BY 1, 2"),
    "layer_cohesion": (layer_cohesion, LAYERED + "SELECT f AS layer, count(*) AS edges, count(*) FILTER (WHERE f = t) AS intra, count(*) FILTER (WHERE f = t) / count(*) AS cohesion, count(*) FILTER (WHERE f = t) / count(*) < 0.5 AS problematic FROM w GROUP BY 1"),
    "layer_targets": (layer_targets, LAYERED + "SELECT src AS module, count(*) AS violations FROM w WHERE severity IS NOT NULL GROUP BY 1 ORDER BY 2 DESC, 1 LIMIT 10"),
    "architecture_suggestions": (architecture_suggestions, LAYERED + "SELECT 'architecture' AS category, CASE severity WHEN 'error' THEN 'critical' ELSE severity END AS severity, CASE severity WHEN 'error' THEN 'hard' ELSE 'moderate' END AS effort, 'Fix architecture violation in ''' || src || '''' AS title, CASE WHEN len(ts) = 1 THEN 'target: ' || ts[1] WHEN len(ts) <= 3 THEN 'targets: ' || array_to_string(ts, ', ') ELSE 'targets: ' || array_to_string(ts[1:3], ', ') || ' and ' || (len(ts) - 3) || ' more' END AS targets FROM (SELECT src, rule, severity, list_sort(list(DISTINCT dst)) AS ts FROM w WHERE severity IS NOT NULL GROUP BY 1, 2, 3)"),
    "architecture_recommendations": (architecture_recommendations, LAYERED + ", cc AS (SELECT greatest(0, 1 - (5 * count(*) FILTER (WHERE severity = 'error') + count(*) FILTER (WHERE severity = 'warning')) / count(*)) AS compliance FROM w), o AS (SELECT src, count(*) AS k FROM w WHERE severity IS NOT NULL GROUP BY 1), r AS (SELECT 'critical' AS priority, 'restructure' AS kind, '' AS subject FROM cc WHERE compliance < 0.6 UNION ALL SELECT 'high', 'refactor', (SELECT string_agg(src, ', ' ORDER BY src) FROM o WHERE k > 2) FROM (SELECT sum(k) AS total, count(*) FILTER (WHERE k > 2) AS tops FROM o) WHERE total > 10 AND tops > 0 UNION ALL SELECT 'medium', 'restructure', f FROM (SELECT f, count(*) FILTER (WHERE f = t) / count(*) AS h FROM w GROUP BY 1) WHERE h < 0.5) SELECT * FROM r UNION ALL SELECT 'low', 'interface', '' FROM (SELECT count(*) AS k FROM r) WHERE k < 3"),
    "responsibilities": (responsibilities, E + ", q AS (SELECT node, 'app.r' || community || '.n' || node AS name, community FROM n), v AS (SELECT a.name AS src, b.name AS dst, CASE WHEN a.community = b.community THEN 'n' || b.node ELSE 'r' || b.community END AS concern FROM e JOIN q AS a ON src = a.node JOIN q AS b ON dst = b.node), y AS (SELECT name AS node, (SELECT count(*) FROM v WHERE dst = name) AS fan_in, (SELECT count(*) FROM v WHERE src = name) AS fan_out, coalesce((SELECT string_agg(DISTINCT concern, ',' ORDER BY concern) FROM v WHERE src = name), '') AS concerns, (SELECT count(DISTINCT concern) FROM v WHERE src = name) AS k FROM q), l AS (SELECT greatest(2, ceil(avg(fan_in) + stddev_pop(fan_in))) AS li, greatest(2, ceil(avg(fan_out) + stddev_pop(fan_out))) AS lo FROM y) SELECT node, fan_in, fan_out, concerns, fan_in >= li AND fan_out >= lo AND k >= 2 AS is_hub, k > 2 AS is_overloaded, CASE WHEN fan_in >= li AND fan_out >= lo AND k > 3 THEN 'error' WHEN k > 2 OR (fan_in >= li AND fan_out >= lo AND k >= 2) THEN 'warning' END AS severity FROM y, l"),
    "community_partition": (community_partition, E + PM + "SELECT community, size, packages, internal, outgoing, incoming, outgoing + incoming AS external, CASE WHEN internal + outgoing + incoming = 0 THEN 0 ELSE (outgoing + incoming) / (internal + outgoing + incoming) END::DOUBLE AS external_ratio FROM pm"),
    "community_dominant": (community_dominant, E + SEG + DOM + "SELECT community, dominant, vals AS \"values\", alignment FROM dm"),
    "community_mismatch": (community_mismatch, E + SEG + ", k AS (SELECT DISTINCT community, package FROM n AS y JOIN sg USING (node)) SELECT (SELECT count(*) FILTER (WHERE c = 1) / count(*) FROM (SELECT package, count(*) AS c FROM k GROUP BY 1)) AS score, coalesce((SELECT string_agg(package, ',' ORDER BY package) FROM (SELECT package, count(*) AS c FROM k GROUP BY 1) WHERE c > 1), '') AS split, coalesce((SELECT string_agg(community::VARCHAR, ',' ORDER BY community) FROM (SELECT community, count(*) AS c FROM k GROUP BY 1) WHERE c > 1), '') AS mixed".replace("AS y JOIN sg USING (node)", "JOIN sg USING (node)").replace("SELECT DISTINCT community, package FROM n", "SELECT DISTINCT community, sg.package FROM n")),
    "community_bridges": (community_bridges, E + SEG + BR + "SELECT * FROM br ORDER BY cross_edges DESC, node LIMIT 10"),
    "community_layer_bridges": (community_layer_bridges, E + SEG + DOM + "SELECT DISTINCT node FROM (SELECT src AS node, f AS c, t AS o FROM x WHERE f <> t UNION ALL SELECT dst, t, f FROM x WHERE f <> t) JOIN dm AS a ON c = a.community JOIN dm AS b ON o = b.community WHERE a.dominant <> b.dominant"),
    "community_numbers": (community_numbers, "SELECT n_nationkey AS node, 10 - n_regionkey AS community, 'community_' || k AS id FROM nation JOIN (SELECT n_regionkey, dense_rank() OVER (ORDER BY min(n_nationkey)) AS k FROM nation GROUP BY 1) USING (n_regionkey)"),
    "community_merged": (community_merged, None),
    "community_context": (community_context, E + PM + DOM + BR + RISKS + ", nn AS (SELECT community, list_sort(list(node::VARCHAR)) AS ns FROM n GROUP BY 1), bb AS (SELECT community, count(*) AS k FROM br GROUP BY 1) SELECT community, CASE WHEN len(ns) > 3 THEN array_to_string(ns[1:3], ',') || ',... +' || (len(ns) - 3) || ' more' ELSE array_to_string(ns, ',') END AS modules, len(ns)::INT AS module_count, risk, coalesce(k, 0)::INT AS bridges, size || ' module' || CASE WHEN size = 1 THEN '' ELSE 's' END || '; ' || len(string_split(packages, ',')) || ' package' || CASE WHEN len(string_split(packages, ',')) = 1 THEN '' ELSE 's' END || '; risk ' || risk || '; ' || (incoming + outgoing) || ' cross-community edge' || CASE WHEN incoming + outgoing = 1 THEN '' ELSE 's' END || CASE WHEN coalesce(k, 0) = 0 THEN '' ELSE '; ' || k || ' bridge module' || CASE WHEN k = 1 THEN '' ELSE 's' END END || '.' AS summary FROM rk JOIN nn USING (community) LEFT JOIN bb USING (community)"),
    "community_risk": (community_risk, E + SEG + BR + ", m AS (SELECT sum(weight)::DOUBLE AS m FROM e), d AS (SELECT community, sum(weight)::DOUBLE AS degree FROM (SELECT src AS node, weight FROM e UNION ALL SELECT dst, weight FROM e) JOIN n USING (node) GROUP BY 1), i AS (SELECT a.community, sum(weight)::DOUBLE AS inside FROM e JOIN n AS a ON src = a.node JOIN n AS b ON dst = b.node WHERE a.community = b.community GROUP BY 1), q AS (SELECT sum(coalesce(inside, 0) / m - pow(degree / (2 * m), 2)) AS q FROM d LEFT JOIN i USING (community), m), k AS (SELECT DISTINCT community, sg.package FROM n JOIN sg USING (node)), z AS (SELECT (SELECT q FROM q) AS q, (SELECT count(*) FROM x WHERE f = t) AS inner_, (SELECT count(*) FROM x WHERE f <> t) AS cross_, (SELECT count(*) FROM br) AS b, (SELECT count(DISTINCT community) FROM n) AS c, (SELECT count(*) FILTER (WHERE c = 1) / count(*) FROM (SELECT package, count(*) AS c FROM k GROUP BY 1)) AS a), r AS (SELECT (0.4 * least(1, greatest(0, (0.3 - q) / 0.3)) + 0.3 * least(1, cross_ / (inner_ + cross_) / 0.5) + 0.3 * least(1, b / c) + 0.25 * (1 - a)) / 1.25 AS r FROM z) SELECT round(r, 9) AS risk, floor(100 * r + 0.5)::BIGINT AS score, floor(10 * r + 0.5)::BIGINT AS penalty FROM r"),
    "community_payload": (community_payload, E + SEG + "SELECT f::VARCHAR AS src, t::VARCHAR AS dst, true AS crosses, count(*) AS weight FROM x WHERE f <> t GROUP BY 1, 2 UNION ALL SELECT community::VARCHAR, 'node', false, count(*) FROM n GROUP BY 1"),
    "system_scores": (system_scores, f"WITH {NUM}, s AS (SELECT least(20, floor((high + 0.3 * medium) / n / 0.4 * 20 + 0.5))::BIGINT AS cohesion, (least(10, greatest(floor(10 * least(1, 10 / modules) + 0.5), floor(log2(11)))) + floor(least(3, greatest(0, 9 - greatest(3, ceil(log2(modules + 1)) + 1))) + 0.5) + 2)::BIGINT AS dependency, round(greatest(0, least(100, 100 - least(30, mean * 8) - least(25, 5 / modules * 25) - least(20, 10 / modules * 20) - least(25, 20 / modules * 10))), 2) AS maintainability, round(greatest(0, least(100, 100 - least(40, mean * 10) - least(40, 10 / modules * 40))), 2) AS modularity, (12 + 8 + modules + 4 + 4)::DOUBLE AS debt, greatest(0, 100 - CASE WHEN mean * 6 > 10 THEN 10 ELSE 0 END - 5 - CASE WHEN high > 0 THEN 5 ELSE 0 END)::BIGINT AS fallback FROM y) SELECT *, round((maintainability * 0.4 + modularity * 0.3) / 0.7, 2) AS quality, floor(100 - cohesion / 20 * 100 + 0.5)::BIGINT AS cohesion_score, fallback >= 70 AS healthy FROM s"),
    "invalid_numbers": (invalid_numbers, f"WITH {NUM} SELECT field, value FROM (SELECT unnest([{{'field': 'skipped_files', 'value': (n + 1)::DOUBLE}}, {{'field': 'mean_complexity', 'value': -mean}}, {{'field': 'duplication', 'value': 101.0::DOUBLE}}], recursive := true) FROM y)"),
    "duplication_percent": (duplication_percent, "SELECT p AS percent, least(20, floor(p / 30 * 20 + 0.5))::BIGINT AS penalty FROM (SELECT least(30, 100 * (count(*) - count(DISTINCT text)) / count(*))::DOUBLE AS p FROM documents)"),
    "refactoring_summary": (refactoring_summary, RZ + LAZY + LAYERED.removeprefix(E) + ", r AS (SELECT (SELECT count(*) FROM z) AS modules, (SELECT avg(ca + ce) FROM z) AS mean_coupling, (SELECT count(*) FROM z WHERE distance >= 0.5 AND ca >= 2 AND instability <= 0.3 AND abstractness <= 0.3) AS pain, (SELECT count(*) FROM z WHERE distance > 0.7) AS high_risk, (SELECT coalesce(sum(size), 0)::BIGINT FROM sz) AS in_cycles, (SELECT count(*) FROM w WHERE severity IS NOT NULL) AS violations) SELECT *, (4 * high_risk + 2 * in_cycles + violations)::DOUBLE AS debt FROM r"),
    "fragment_pairs": (fragment_pairs, "WITH f AS (SELECT l_orderkey || '#' || l_linenumber AS id, l_orderkey AS o, l_linenumber * 10 AS s, max(l_quantity)::INT AS q FROM lineitem GROUP BY l_orderkey, l_linenumber) SELECT a.id AS a, b.id AS b FROM f AS a JOIN f AS b ON a.o = b.o AND a.id < b.id WHERE NOT (a.s <= b.s + b.q AND b.s <= a.s + a.q) AND least(a.q, b.q) + 1 >= 0.5 * (greatest(a.q, b.q) + 1)"),
    "significant_pairs": (significant_pairs, f"WITH {NEXT} SELECT p_partkey AS a, p_partkey + 1 AS b, (p_partkey % 4 + 1)::INT AS type, c AS similarity FROM x WHERE c >= 0.7 AND (p_partkey % 4 = 3 OR abs(p_size - s) <= 5) AND least(p_size, s) >= 10 AND p_partkey % 4 + 1 IN (1, 2, 4)"),
    "clone_cascade": (clone_cascade, f"WITH {NEXT}, y AS (SELECT *, CASE WHEN c - 0.1 >= 0.85 THEN 1 WHEN c - 0.05 >= 0.75 THEN 2 WHEN p_size % 3 > 0 AND c >= 0.7 THEN 3 WHEN c + 0.05 >= 0.65 THEN 4 END AS type FROM x), w AS (SELECT *, CASE type WHEN 1 THEN c - 0.1 WHEN 2 THEN c - 0.05 WHEN 3 THEN c ELSE c + 0.05 END AS similarity FROM y WHERE type IS NOT NULL) SELECT p_partkey, type, similarity, CASE type WHEN 1 THEN 1 WHEN 2 THEN 0.95 WHEN 3 THEN 0.9 ELSE 0.85 END::DOUBLE AS confidence, greatest(0, least(1, similarity * (0.5 + 0.5 * least(least(p_size, s) / 50, 1)))) AS sure FROM w"),
    "semantic_scores": (
        semantic_scores,
        f"WITH {NEXT}, y AS (SELECT p_partkey AS k, p_size AS a, s AS b, p_size % 3 AS la, s % 3 AS lb, p_size % 5 AS ca, s % 5 AS cb, p_size % 7 AS da, s % 7 AS db, p_size % 11 AS pa, s % 11 AS pb, p_size % 2 AS xa, s % 2 AS xb FROM x) "
        f"SELECT k, round(0.20 * ({_N('(a + 2)', '(b + 2)')}) + 0.15 * ({_N('a * 2', 'b * 2')}) + 0.25 * ({_N('a', 'b')}) + 0.25 * (a * b + la * lb + ca * cb) / (sqrt(a * a + la * la + ca * ca) * sqrt(b * b + lb * lb + cb * cb)) + 0.10 * ({_N('(a * 2 / (a + 2))', '(b * 2 / (b + 2))')}) + 0.05 * (({_N('la', 'lb')}) + ({_N('ca', 'cb')})) / 2, 9) AS flow, "
        f"round(CASE WHEN da = 0 AND db = 0 THEN 1 WHEN da = 0 OR db = 0 THEN 0 ELSE 0.25 * ({_N('pa', 'pb')}) + 0.20 * ({_N('(pa / da)', '(pb / db)')}) + 0.20 * ({_N('(CASE WHEN pa = 0 THEN 0 ELSE xa / pa END)', '(CASE WHEN pb = 0 THEN 0 ELSE xb / pb END)')}) + 0.20 + 0.15 * (pa * pb + 1) / (sqrt(pa * pa + 1) * sqrt(pb * pb + 1)) END, 9) AS dataflow FROM y",
    ),
    "name_forms": (
        name_forms,
        "WITH x AS (SELECT p_partkey, p_size, lower(replace(p_brand, '#', '_')) AS brand, CASE WHEN p_partkey % 2 = 0 THEN 'core' ELSE 'web' END AS area, CASE p_partkey % 3 WHEN 0 THEN 'MAX' WHEN 1 THEN '_Part' ELSE 'part' END AS leaf FROM part) "
        "SELECT p_partkey, leaf, 'app.' || brand || '.' || area AS package, leaf = 'MAX' AS is_constant, leaf <> 'part' AS is_class, leaf <> '_Part' AS is_public, area = 'core' AS in_core, area = 'web' AS in_web, CASE WHEN brand <> 'brand_11' THEN 'app' WHEN area = 'core' THEN 'app.brand_11.core' ELSE 'app.brand_11' END AS prefix, CASE WHEN brand <> 'brand_11' THEN 'app/' WHEN area = 'core' THEN 'app/brand_11/core/' ELSE 'app/brand_11/' END AS scope, CASE WHEN brand <> 'brand_11' THEN 'app' WHEN area = 'web' THEN 'app/brand_11/web' ELSE 'app/brand_11' END AS folder, "
        "p_size || ' module' || CASE WHEN p_size = 1 THEN '' ELSE 's' END AS modules, printf('%.1f%%', p_size::DOUBLE) AS percent, format('{:,}', p_partkey * 1000) AS thousands, CASE WHEN p_size * 40 < 1000 THEN (p_size * 40) || 'ms' ELSE printf('%.2fs', p_size * 40 / 1000) END AS took, false AS is_test, 'app,' || brand || ',... +2 more' AS capped FROM x",
    ),
    "axis_ends": (axis_ends, "SELECT CASE WHEN k <= 3 THEN 3 ELSE list_min([s * pw FOR s IN [1, 2, 3, 5, 6, 10] IF s * pw >= k]) END::BIGINT AS top, count(*) AS n FROM (SELECT p_partkey AS k, power(10, length(p_partkey::VARCHAR) - 1)::BIGINT AS pw FROM part) GROUP BY 1"),
    "function_order": (function_order, "SELECT p_brand AS path, p_partkey AS start_line, p_size AS cyclomatic, CASE WHEN p_size <= 9 THEN 'low' WHEN p_size <= 19 THEN 'medium' ELSE 'high' END AS risk FROM part ORDER BY CASE WHEN p_size <= 9 THEN 0 WHEN p_size <= 19 THEN 1 ELSE 2 END DESC, p_size DESC, p_brand, p_partkey LIMIT 25"),
    "class_order": (class_order, "SELECT p_brand AS path, p_partkey AS class_line, p_size AS cbo FROM part ORDER BY p_size DESC, p_brand, p_partkey LIMIT 25"),
    "finding_order": (finding_order, "SELECT p_brand AS path, p_partkey AS start_line, CASE WHEN p_size > 40 THEN 'critical' ELSE 'warning' END AS severity FROM part WHERE p_size > 20 ORDER BY p_size > 40 DESC, p_brand, p_partkey LIMIT 25"),
    "file_order": (file_order, "SELECT p_brand AS path, max(CASE WHEN p_size > 45 THEN 2 WHEN p_size > 20 THEN 1 ELSE 0 END) AS worst, count(*) AS findings, count(*) FILTER (WHERE p_size <= 20) AS infos, count(*) FILTER (WHERE p_size > 20 AND p_size <= 45) AS warnings, count(*) FILTER (WHERE p_size > 45) AS errors, arg_min(CASE p_partkey % 3 WHEN 0 THEN 'keyword' ELSE 'domain' END, p_partkey) AS first_kind FROM part WHERE p_partkey % 3 < 2 GROUP BY 1 ORDER BY 2 DESC, 3 DESC, 1 LIMIT 10"),
    "suggestion_order": (suggestion_order, "SELECT severity, effort, CASE WHEN s <= 1 AND e = 2 THEN 4 + s WHEN s = 2 THEN 6 + e ELSE 2 * s + e END::INT AS priority, count(*) AS n FROM (SELECT CASE WHEN p_size > 40 THEN 'critical' WHEN p_size > 20 THEN 'warning' ELSE 'info' END AS severity, CASE WHEN p_size > 40 THEN 0 WHEN p_size > 20 THEN 1 ELSE 2 END AS s, ['easy', 'moderate', 'hard'][p_partkey % 3 + 1] AS effort, p_partkey % 3 AS e FROM part) GROUP BY 1, 2, 3"),
    "report_rows": (report_rows, "WITH m AS (SELECT p_brand AS path, count(*) AS f, max(p_size) AS c, row_number() OVER (ORDER BY p_brand) AS k FROM part GROUP BY 1) SELECT 'Total Files' AS metric, count(*)::VARCHAR AS value FROM part UNION ALL SELECT 'Most', max(p_size)::VARCHAR FROM part UNION ALL SELECT 'Module ' || k || ' path', path FROM m UNION ALL SELECT 'Module ' || k || ' Functions', f::VARCHAR FROM m UNION ALL SELECT 'Module ' || k || ' Max Complexity', c::VARCHAR FROM m"),
    "graph_lines": (graph_lines, E + "SELECT '  \"' || n_name || '\" -> \"' || dst || '\" [label=\"' || weight || '\"];' AS value FROM e JOIN nation ON src = n_nationkey"),
    "context_lines": (context_lines, "WITH s AS (SELECT conv_id || '/' || turn AS path, text, unnest(range(len(string_split(text, '. ')))) AS k FROM conversations), x AS (SELECT path, k, string_split(text, '. ')[k + 1] AS t FROM s) SELECT a.path, a.k AS start_line, count(*) AS n, min(b.k) AS least FROM x AS a JOIN x AS b ON a.path = b.path AND b.k BETWEEN a.k - 3 AND a.k + 3 WHERE contains(a.t, 'th') GROUP BY 1, 2"),
}
