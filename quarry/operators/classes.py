"""Cohesion and coupling of classes: LCOM4 from shared variables and calls, CBO from dependencies of five kinds."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.functions.lineage import cut
from quarry.operators.graph import components
from quarry.sources.facts import BUILTINS, CTYPES

CLASS = ["path", "class", "class_line"]
KINDS = ["inheritance", "type_hint", "instantiation", "attribute", "import"]
#: Names of classes that don't count as dependencies (fixed values).
IGNORED = ("test_*", "*_test", "__*__")
#: Modules whose names describe types and are no dependencies (fixed values).
TYPE_MODULES = ["typing", "typing_extensions", "types", "abc", "collections"]


def _key(cols: list[str]) -> Column:
    """A text that names the values of several columns: each with its length before it."""
    parts = []
    for c in cols:
        t = F.coalesce(F.col(c).cast("string"), F.lit(""))
        parts += [F.length(t).cast("string"), F.lit(":"), t]
    return F.concat(*parts)


def lcom4(methods: DataFrame, uses: DataFrame, calls: DataFrame | None = None, by: list[str] | None = None) -> DataFrame:
    """class -> methods, variables, lcom4, groups: connected components of methods, by shared variables and by calls.

    methods: (class, method); uses: (class, method, variable) of these methods; calls: (class, method, callee). Methods are linked to the
    least method of each of their variables, so links are linear in the uses, and the components of all classes are
    found at once. A class without methods isn't listed here."""
    by = by or ["class"]
    m = methods.select(*by, "method").distinct().withColumn("node", _key([*by, "method"]))
    u = uses.select(*by, "variable", _key([*by, "method"]).alias("node"))
    hubs = u.groupBy(*by, "variable").agg(F.min("node").alias("hub"), F.max("node").alias("other"))
    # most variables have one method and link nothing
    links = u.join(hubs.where("hub <> other").drop("other"), [*by, "variable"]).where("node <> hub").select(F.col("hub").alias("src"), F.col("node").alias("dst"))
    if calls is not None:
        c = calls.select(_key([*by, "method"]).alias("src"), _key([*by, "callee"]).alias("dst")).where("src <> dst")
        links = links.unionByName(c.join(m.select(F.col("node").alias("src")), "src", "left_semi").join(m.select(F.col("node").alias("dst")), "dst", "left_semi"))
    links = cut(links.distinct())  # most methods of most classes are on their own: only the linked ones are searched
    comp = components(links.select(F.col("src").alias("node")).union(links.select("dst")), links)
    parts = m.join(comp, "node", "left").withColumn("component", F.coalesce("component", "node")).groupBy(*by, "component").agg(F.sort_array(F.collect_set("method")).alias("group"), F.count("*").alias("n"))
    out = parts.groupBy(*by).agg(F.sum("n").alias("methods"), F.count("*").alias("lcom4"), F.sort_array(F.collect_list("group")).alias("groups"))
    return out.join(hubs.groupBy(*by).agg(F.count("*").alias("variables")), by, "left").fillna({"variables": 0})


def cohesion(classes: DataFrame, methods: DataFrame, uses: DataFrame, fields: DataFrame) -> DataFrame:
    """Cohesion of the classes of parsed files: total_methods, excluded, instance_variables, lcom4, groups, risk.

    Constructors and class, static and abstract methods are left out; a read of a property is a call of it; a lone self uses
    all declared fields of a foreign-function structure. A class without methods has lcom4 1."""
    cls = classes.select("path", "class", F.col("start_line").alias("class_line"), "end_line")
    props = methods.where("is_property").select(*CLASS, F.col("method").alias("name")).distinct().withColumn("_prop", F.lit(True))
    kept = methods.where("not excluded").select(*CLASS, "method").distinct()
    seen = uses.join(methods.select(*CLASS, "method", "excluded", "is_constructor").distinct(), [*CLASS, "method"])
    seen = seen.join(props, [*CLASS, "name"], "left").withColumn("_prop", F.coalesce("_prop", F.lit(False)))
    var = seen.where("kind = 'variable' and not excluded")
    bare = seen.where("kind = 'bare' and not excluded").select(*CLASS, "method").join(fields.select(*CLASS, F.col("name").alias("variable")), CLASS)
    own = var.where(~F.col("_prop") | (F.col("name") == F.col("method"))).select(*CLASS, "method", F.col("name").alias("variable")).unionByName(bare)
    calls = var.where(F.col("_prop") & (F.col("name") != F.col("method"))).unionByName(seen.where("kind = 'call' and not excluded")).select(*CLASS, "method", F.col("name").alias("callee"))
    shape = lcom4(kept, own, calls, CLASS).select(*CLASS, "lcom4", "groups")
    every = own.select(*CLASS, "variable").unionByName(seen.where("kind = 'variable' and is_constructor and not _prop").select(*CLASS, F.col("name").alias("variable"))).unionByName(fields.select(*CLASS, F.col("name").alias("variable")))
    n = methods.groupBy(*CLASS).agg(F.count_if(~F.col("excluded")).alias("kept"), F.count_if("excluded").alias("excluded"))
    x = cls.join(shape, CLASS, "left").join(n, CLASS, "left").join(every.groupBy(*CLASS).agg(F.count_distinct("variable").alias("instance_variables")), CLASS, "left")
    x = x.fillna({"lcom4": 1, "kept": 0, "excluded": 0, "instance_variables": 0})
    x = x.select(*CLASS, "end_line", (F.col("kept") + F.col("excluded")).alias("total_methods"), "excluded", "instance_variables", "lcom4", F.coalesce("groups", F.array().cast("array<array<string>>")).alias("groups"))
    return x.withColumn("risk", S.risk(F.col("lcom4"), 2, 5))


def counted(deps: DataFrame, classes: DataFrame, builtin_types: bool = False) -> DataFrame:
    """Dependencies that count: not on builtins, type-system modules, ignored names or top-level classes of the same file."""
    names = F.broadcast(deps.sparkSession.createDataFrame([(b,) for b in BUILTINS], "dependency string"))  # a fixed list of some 160 names
    peers = classes.where("is_top").select("path", F.col("name").alias("dependency"))
    ignored = F.col("dependency").rlike(r"^(test_.*|.*_test|__.*__)$")
    typed = F.split("dependency", r"\.")[0].isin(TYPE_MODULES) & F.col("dependency").contains(".")
    x = deps.where(~ignored & ~typed)
    return (x if builtin_types else x.join(names, "dependency", "left_anti")).join(peers, ["path", "dependency"], "left_anti")


def coupling(deps: DataFrame, kinds: list[str] | None = None, by: list[str] | None = None) -> DataFrame:
    """class -> cbo (distinct dependencies) and distinct dependencies by kind, names sorted.

    One row a class and dependency is made first, with a flag for each kind, so nothing is expanded by kind."""
    by, kinds = by or CLASS, kinds or KINDS
    flat = deps.groupBy(*by, "dependency").agg(*[F.max((F.col("kind") == k).cast("int")).alias(k) for k in kinds])
    return flat.groupBy(*by).agg(F.count("*").alias("cbo"), *[F.sum(k).alias(f"kind_{k.lower()}") for k in kinds], F.sort_array(F.collect_list("dependency")).alias("dependencies"))


def class_coupling(classes: DataFrame, deps: DataFrame) -> DataFrame:
    """CBO of the classes of parsed files, those without dependencies too."""
    cls = classes.select("path", "class", F.col("start_line").alias("class_line"), "end_line", "bases", "is_abstract")
    x = cls.join(coupling(counted(deps, classes)), CLASS, "left").fillna(0, ["cbo", *[f"kind_{k}" for k in KINDS]])
    x = x.withColumn("dependencies", F.coalesce("dependencies", F.array().cast("array<string>")))
    return x.withColumn("risk", S.risk(F.col("cbo"), 3, 7))


def class_summary(df: DataFrame, value: str, tops: list[int]) -> DataFrame:
    """One row: classes, mean, least, most, risk counts and a histogram as a map, for cbo or lcom4."""
    n = lambda r: F.count_if(F.col("risk") == r).alias(f"{r}_risk")
    label = S.bucket(F.col(value), tops)
    one = df.agg(F.count("*").alias("classes"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), n("low"), n("medium"), n("high"))
    bars = df.groupBy(label.alias("bucket")).agg(F.count("*").alias("n")).agg(F.map_from_entries(F.sort_array(F.collect_list(F.struct("bucket", "n")))).alias("histogram"))
    return one.crossJoin(bars)  # one row each


def sorted_classes(df: DataFrame, value: str, by: str = "value") -> DataFrame:
    """In order of the value, name, risk or place; ties by place, so the order is total."""
    place = ["path", "class_line", "class"]
    order = {"value": [F.desc(value)], "name": [F.asc("class")], "risk": [F.desc(S.ordinal(F.col("risk"), ["low", "medium", "high"])), F.desc(value)], "place": []}[by]
    return df.orderBy(*order, *place)


def is_structure(base: Column) -> Column:
    return F.element_at(F.split(base, r"\."), -1).isin(list(CTYPES))
