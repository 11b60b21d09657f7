"""Layers of an architecture: presets, assignment of modules, rules, cohesion, responsibilities, recommendations."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.operators.architecture import fan_limit

#: Layers of each style with the names of packages that belong to them (fixed values).
LAYERS = {
    "layered": {
        "presentation": ["router", "routers", "route", "routes", "endpoint", "endpoints", "handler", "handlers", "controller", "controllers", "view", "views", "api", "apis", "ui", "web", "rest", "graphql"],
        "application": ["service", "services", "usecase", "usecases", "use_case", "use_cases", "workflow", "workflows", "command", "commands", "query", "queries", "manager", "managers"],
        "domain": ["model", "models", "entity", "entities", "schema", "schemas", "domain", "domains", "core", "business", "aggregate", "aggregates", "valueobject", "valueobjects"],
        "infrastructure": ["repository", "repositories", "repo", "repos", "db", "database", "adapter", "adapters", "persistence", "storage", "cache", "client", "clients", "external"],
    },
    "hexagonal": {
        "domain": ["domain", "domains", "model", "models", "entity", "entities", "core", "business", "aggregate", "aggregates", "valueobject", "valueobjects"],
        "ports": ["port", "ports", "interface", "interfaces", "contract", "contracts", "usecase", "usecases", "use_case", "use_cases", "service", "services"],
        "adapters": ["adapter", "adapters", "handler", "handlers", "controller", "controllers", "router", "routers", "api", "apis", "repository", "repositories", "repo", "repos", "db", "database", "persistence", "storage", "client", "clients", "external", "web", "rest", "graphql"],
    },
    "clean": {
        "entities": ["entity", "entities", "model", "models", "domain", "domains", "core", "aggregate", "aggregates", "valueobject", "valueobjects"],
        "use_cases": ["usecase", "usecases", "use_case", "use_cases", "interactor", "interactors", "service", "services", "workflow", "workflows", "command", "commands", "query", "queries"],
        "interface_adapters": ["interface_adapter", "interface_adapters", "adapter", "adapters", "controller", "controllers", "presenter", "presenters", "gateway", "gateways", "repository", "repositories", "repo", "repos", "router", "routers"],
        "frameworks": ["framework", "frameworks", "infrastructure", "db", "database", "web", "api", "apis", "external", "client", "clients", "persistence", "storage", "ui"],
    },
    "mvc": {
        "model": ["model", "models", "entity", "entities", "schema", "schemas", "domain", "domains"],
        "view": ["view", "views", "template", "templates", "serializer", "serializers", "form", "forms"],
        "controller": ["controller", "controllers", "handler", "handlers", "router", "routers", "route", "routes", "viewset", "viewsets"],
    },
}
#: Rules of each style: layer -> allowed, warned and denied layers (fixed values).
RULES = {
    "layered": {
        "presentation": (["presentation", "application", "domain", "infrastructure"], [], []),
        "application": (["application", "domain", "infrastructure"], [], []),
        "domain": (["domain", "infrastructure"], [], ["presentation", "application"]),
        "infrastructure": (["infrastructure", "domain", "application"], [], []),
    },
    "hexagonal": {"domain": (["domain"], [], ["ports", "adapters"]), "ports": (["ports", "domain"], [], ["adapters"]), "adapters": (["adapters", "ports", "domain"], [], [])},
    "clean": {
        "entities": (["entities"], [], ["use_cases", "interface_adapters", "frameworks"]),
        "use_cases": (["use_cases", "entities"], [], ["interface_adapters", "frameworks"]),
        "interface_adapters": (["interface_adapters", "use_cases", "entities"], [], ["frameworks"]),
        "frameworks": (["frameworks", "interface_adapters", "use_cases", "entities"], [], []),
    },
    "mvc": {"model": (["model"], [], ["view", "controller"]), "view": (["view", "controller"], ["model"], []), "controller": (["controller", "model", "view"], [], [])},
}
#: Parts of module names that name no concern (fixed values).
GENERIC_PARTS = ["base", "common", "helpers", "node", "shared", "util", "utils"]
UNKNOWN = "unknown"


def patterns(spark: SparkSession, layers: dict[str, list[str]]) -> DataFrame:
    """layer, pattern: a small table, as large as the configuration."""
    return spark.createDataFrame([(k, p) for k, ps in layers.items() for p in ps], "layer string, pattern string")


def rule_table(spark: SparkSession, rules: dict[str, tuple]) -> DataFrame:
    """from_layer, allow, warn, deny."""
    return spark.createDataFrame([(k, *v) for k, v in rules.items()], "from_layer string, allow array<string>, warn array<string>, deny array<string>")


def merged_rules(base: dict[str, tuple], own: dict[str, tuple]) -> dict[str, tuple]:
    """A user's rule takes the place of the preset's rule of the same layer."""
    return {k: v for k, v in base.items() if k not in own} | own


def style_rules(style: str = "layered", layers: dict[str, list[str]] | None = None, rules: dict[str, tuple] | None = None) -> tuple[dict, dict]:
    """Layers and rules in force: a style's, with own layers in place of its layers and own rules over its rules. Rules of
    layers that aren't there are left out."""
    preset = LAYERS.get(style, {})
    base = RULES.get(style, {})
    now = layers or preset
    return now, merged_rules({k: v for k, v in base.items() if k in now}, rules or {})


def module_layers(modules: DataFrame, table: DataFrame, neutral: tuple[str, ...] = ()) -> DataFrame:
    """module -> layer: the pattern that fits best, 'unknown' where none does or the module is a test.

    A pattern fits the whole name or what follows a dot, and what comes below it; without a star also a part that begins
    with it and '_' or ends with '_' and it. Best is the pattern with most dots, then at the name's start, then on whole
    parts, then furthest left, then longest, then the least layer. Modules and patterns meet by the parts of the names: an
    equi-join on every part and affix, so that patterns are never tried on all modules; patterns with stars or dots, which
    are few, are tried one by one in a column expression."""
    from quarry.operators.placeholders import is_test_module

    name = F.col("module")
    bare = name
    for p in reversed(neutral):
        bare = F.when(name.startswith(p + "."), F.substring(name, len(p) + 2, 1 << 20)).otherwise(bare)
    low = F.lower(F.col("_bare"))
    m = modules.select("module").distinct().withColumn("_bare", bare)
    rows = table.select(F.lower("pattern").alias("p"), "layer")
    single = rows.where(~F.col("p").contains("*") & ~F.col("p").contains("."))
    # a place for every part of the name; of a part also what leads a '_' and what follows one
    parts = m.select("module", F.posexplode(F.split(low, r"\.")).alias("k", "part"), low.alias("low"))
    at = F.length(F.array_join(F.slice(F.split("low", r"\."), F.lit(1), F.col("k")), ".")) + F.when(F.col("k") > 0, 1).otherwise(0)
    cut = F.filter(F.sequence(F.lit(1), F.greatest(F.length("part"), F.lit(1))), lambda i: F.substr("part", i, F.lit(1)) == "_")
    heads = F.transform(cut, lambda i: F.struct(F.substr("part", F.lit(1), i - 1).alias("p"), F.lit(1).alias("b"), F.lit(0).alias("off"), F.lit(True).alias("lead")))
    tails = F.transform(cut, lambda i: F.struct(F.substr("part", i + 1, F.length("part")).alias("p"), F.lit(1).alias("b"), i.alias("off"), F.lit(False).alias("lead")))
    whole = F.array(F.struct(F.col("part").alias("p"), F.lit(2).alias("b"), F.lit(0).alias("off"), F.lit(True).alias("lead")))
    keys = parts.withColumn("at", at).select("module", "k", "at", F.inline(F.concat(whole, heads, tails)))
    hit = keys.join(single, "p").select("module", "layer", F.lit(0).alias("dots"), ((F.col("k") == 0) & F.col("lead")).alias("first"), F.col("b").alias("boundary"), (F.col("at") + F.col("off")).alias("place"), F.length("p").alias("size"))
    listed = rows.where(F.col("p").contains("*") | F.col("p").contains(".")).collect()  # as many as the configuration has
    for r in listed:
        body = "".join(".*" if c == "*" else c if c.isalnum() or c == "_" else "\\" + c for c in r.p)
        tail = "" if "*" in r.p else r"(\..+)?"
        front, back = low.rlike(f"^{body}{tail}$"), low.rlike(f"^.+\\.{body}{tail}$")
        place = F.when(front, 0).otherwise(F.greatest(F.instr(low, "." + r.p.rstrip("*.")), F.lit(0)))
        hit = hit.unionByName(m.where(front | back).select("module", F.lit(r.layer).alias("layer"), F.lit(r.p.count(".")).alias("dots"), front.alias("first"), F.lit(2).alias("boundary"), place.alias("place"), F.lit(len(r.p)).alias("size")))
    order = [F.desc("dots"), F.desc("first"), F.desc("boundary"), F.asc("place"), F.desc("size"), F.asc("layer")]
    best = hit.withColumn("_n", F.row_number().over(Window.partitionBy("module").orderBy(*order))).where("_n = 1").select("module", F.col("layer").alias("_l"))
    x = m.join(best, "module", "left")
    return x.select("module", F.when(is_test_module(name), UNKNOWN).otherwise(F.coalesce("_l", F.lit(UNKNOWN))).alias("layer"))


def violations(edges: DataFrame, layers: DataFrame, rules: DataFrame, strict: bool = False) -> DataFrame:
    """Every edge with its layers and verdict: severity (error, warning or null), rule, suggestion.

    Denied layers are errors, discouraged ones warnings, and where a rule allows some layers, others are errors. Unknown
    layers and layers without a rule are warnings in strict mode only."""
    a = layers.select(F.col("module").alias("src"), F.col("layer").alias("from_layer"))
    b = layers.select(F.col("module").alias("dst"), F.col("layer").alias("to_layer"))
    x = edges.select("src", "dst").join(a, "src").join(b, "dst").join(rules, "from_layer", "left")
    to, unknown, none = F.col("to_layer"), (F.col("from_layer") == UNKNOWN) | (F.col("to_layer") == UNKNOWN), F.col("allow").isNull()
    denied, warned, missing = F.array_contains("deny", to), F.array_contains("warn", to), (F.size("allow") > 0) & ~F.array_contains("allow", to)
    loose = F.lit("warning" if strict else None).cast("string")
    severity = F.when(unknown | none, loose).when(denied, "error").when(warned, "warning").when(missing, "error")
    rule = (
        F.when(unknown, "strict_mode").when(none, "no_rule").when(denied, F.concat_ws(" !> ", "from_layer", "to_layer")).when(warned, F.concat_ws(" ~> ", "from_layer", "to_layer"))
        .when(missing, F.concat("from_layer", F.lit(" -> {"), F.array_join("allow", ","), F.lit("}")))
    )
    advice = F.when(unknown, "Assign the modules to layers").when(none, "Define a rule for this layer").when(denied, "Put an interface between the layers or move the code").when(warned, "Go through a layer between them").otherwise("Change the dependency or the rule")
    return x.select("src", "dst", "from_layer", "to_layer", severity.alias("severity"), F.when(severity.isNotNull(), rule).alias("rule"), F.when(severity.isNotNull(), advice).alias("suggestion"))


def layer_cohesion(checked: DataFrame, least: float = 0.5) -> DataFrame:
    """layer -> edges from it, those that stay in it, their share, whether that is under ``least``."""
    x = checked.groupBy(F.col("from_layer").alias("layer")).agg(F.count("*").alias("edges"), F.count_if(F.col("from_layer") == F.col("to_layer")).alias("intra"))
    return x.withColumn("cohesion", F.col("intra") / F.col("edges")).withColumn("problematic", F.col("cohesion") < least)


def concern(module: Column, neighbour: Column) -> Column:
    """The first part of the neighbour's name, after what both names share, that isn't generic; null if all are."""
    a, b = (F.filter(F.split(c, r"\."), lambda p: p != "") for c in (module, neighbour))
    shared = F.size(F.filter(F.sequence(F.lit(1), F.greatest(F.least(F.size(a), F.size(b)), F.lit(1))), lambda n: F.slice(a, F.lit(1), n) == F.slice(b, F.lit(1), n)))
    rest = F.when(shared < F.size(b), F.slice(b, shared + 1, F.size(b))).otherwise(b)
    return F.try_element_at(F.filter(rest, lambda p: ~p.isin(GENERIC_PARTS)), F.lit(1))


def responsibilities(nodes: DataFrame, edges: DataFrame, most: int = 3, severity: str = "warning") -> DataFrame:
    """node -> fan_in, fan_out, concerns (of its dependencies), is_hub, is_overloaded, severity.

    A hub reaches both fan limits (mean plus deviation, at least 2) and has two concerns; more than ``most`` are an overload;
    a hub with more than one beyond that is an error."""
    e = edges.select("src", "dst").distinct()
    out = e.groupBy(F.col("src").alias("node")).agg(F.count("*").alias("fan_out"), F.sort_array(F.collect_set(concern(F.col("src"), F.col("dst")))).alias("concerns"))
    into = e.groupBy(F.col("dst").alias("node")).agg(F.count("*").alias("fan_in"))
    x = nodes.select("node").join(out, "node", "left").join(into, "node", "left").fillna(0, ["fan_in", "fan_out"]).withColumn("concerns", F.coalesce("concerns", F.array().cast("array<string>")))
    limits = x.agg(fan_limit(F.col("fan_in")).alias("_in"), fan_limit(F.col("fan_out")).alias("_out"))
    n = F.size("concerns")
    x = x.crossJoin(F.broadcast(limits))  # one row
    x = x.withColumn("is_hub", (F.col("fan_in") >= F.col("_in")) & (F.col("fan_out") >= F.col("_out")) & (n >= 2)).withColumn("is_overloaded", n > most)
    verdict = F.when(F.col("is_hub") & (n > most + 1), "critical" if severity == "critical" else "error").when(F.col("is_hub") | F.col("is_overloaded"), severity)
    return x.withColumn("severity", verdict).drop("_in", "_out")


def recommendations(compliance: DataFrame, found: DataFrame, cohesion: DataFrame) -> DataFrame:
    """priority, kind, title, subject: what to do about an architecture. compliance: one row with compliance; found:
    violations (src); cohesion: layer_cohesion. Restructuring below 0.6; frequent violators (over two of more than ten);
    incoherent layers; and, if these are fewer than three, injection."""
    row = lambda df, p, k, t, s: df.select(F.lit(p).alias("priority"), F.lit(k).alias("kind"), t.alias("title"), s.cast("string").alias("subject"))
    none = F.lit(None).cast("string")
    a = row(compliance.where("compliance < 0.6"), "critical", "restructure", F.lit("Major Architecture Restructuring Required"), none)
    n = found.where("severity is not null").groupBy("src").agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"), F.sort_array(F.collect_list(F.when(F.col("n") > 2, F.col("src").cast("string")))).alias("top"))  # violators with three or more: a report's line
    b = row(total.where("total > 10 and size(top) > 0"), "high", "refactor", F.lit("Address Frequent Architecture Violators"), F.array_join("top", ", "))
    c = row(cohesion.where("problematic"), "medium", "restructure", F.concat(F.lit("Improve Cohesion in "), "layer", F.lit(" Layer")), F.col("layer"))
    every = a.unionByName(b).unionByName(c)
    d = every.agg(F.count("*").alias("n")).where("n < 3")
    return every.unionByName(row(d, "low", "interface", F.lit("Introduce Dependency Injection"), none))


def targets(found: DataFrame, n: int = 10) -> DataFrame:
    """The n modules with most violations; ties by name."""
    return found.where("severity is not null").groupBy(F.col("src").alias("module")).agg(F.count("*").alias("violations")).orderBy(F.desc("violations"), "module").limit(n)


def cycle_advice(cycles: DataFrame, core: DataFrame) -> DataFrame:
    """rank, text: how to break cycles. cycles: (modules, size), core: (node). General advice first and last, then modules of
    several cycles, then the first three cycles of up to four modules, largest first."""
    top = cycles.orderBy(F.desc("size"), F.array_join("modules", ",")).limit(3).withColumn("k", F.row_number().over(Window.orderBy(F.desc("size"), F.array_join("modules", ","))))  # three rows
    two = F.format_string("Break cycle between %s and %s by a third module or by injection", F.col("modules")[0].cast("string"), F.col("modules")[1].cast("string"))
    few = F.concat(F.lit("Cycle of "), F.array_join("modules", ", "), F.lit(": take the least coupled module's dependencies out"))
    each = top.where("size <= 4").select((F.lit(2) + F.col("k")).alias("rank"), F.when(F.col("size") == 2, two).otherwise(few).alias("text"))
    some = cycles.limit(1)
    first = some.select(F.lit(1).alias("rank"), F.lit("Turn dependencies around with interfaces or abstract base classes").alias("text"))
    shared = core.agg(F.array_join(F.sort_array(F.collect_list(F.col("node").cast("string"))), ", ").alias("names")).where("names <> ''").select(F.lit(2).alias("rank"), F.concat(F.lit("Modules of several cycles, whose shared parts belong elsewhere: "), "names").alias("text"))
    last = some.select(F.explode(F.array(F.struct(F.lit(8).alias("rank"), F.lit("Check that layers are separated").alias("text")), F.struct(F.lit(9).alias("rank"), F.lit("Decouple modules by events").alias("text")))).alias("r")).select("r.*")
    return first.unionByName(shared).unionByName(each).unionByName(last)


def auto_layers(modules: DataFrame) -> dict[str, list[str]]:
    """Layers of the layered style that the modules' names show: the packages (all but the last part) of each layer."""
    found = module_layers(modules, patterns(modules.sparkSession, LAYERS["layered"])).where(F.col("layer") != UNKNOWN)
    prefixes = found.select("layer", F.when(F.col("module").contains("."), S.package(F.col("module"))).otherwise(F.col("module")).alias("p")).distinct().orderBy("layer", "p")
    out: dict[str, list[str]] = {}
    for r in prefixes.collect():  # one row a layer and package: the size of a configuration
        out.setdefault(r.layer, []).append(r.p)
    return out
