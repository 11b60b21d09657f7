"""Rules between layers, cohesion of packages, limits, and the linear form of definitions and uses."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions.scalar import ratio


def layer_edges(edges: DataFrame, layers: DataFrame, rules: DataFrame) -> DataFrame:
    """Edges between different layers with their verdict: deny beats warn beats allow; no rule is 'unknown'.

    rules: from_layer, allow, warn, deny (arrays of layers); one row a layer, so Spark may broadcast it by its size."""
    e = edges.join(layers.select(F.col("node").alias("src"), F.col("layer").alias("from_layer")), "src").join(layers.select(F.col("node").alias("dst"), F.col("layer").alias("to_layer")), "dst")
    x = e.where("from_layer <> to_layer").join(rules, "from_layer", "left")
    to = F.col("to_layer")
    verdict = F.when(F.array_contains("deny", to), "error").when(F.array_contains("warn", to), "warning").when(F.array_contains("allow", to), "ok").otherwise("unknown")
    return x.select("src", "dst", "from_layer", "to_layer", verdict.alias("verdict"))


def compliance(checked: DataFrame) -> DataFrame:
    """One row: checked edges, errors, warnings, max(0, 1 - (5 errors + warnings) / checked)."""
    x = checked.agg(F.count("*").alias("checked"), F.count_if(F.col("verdict") == "error").alias("errors"), F.count_if(F.col("verdict") == "warning").alias("warnings"))
    return x.withColumn("compliance", F.greatest(F.lit(0.0), 1 - ratio(5 * F.col("errors") + F.col("warnings"), F.col("checked"))))


def package_cohesion(edges: DataFrame, packages: DataFrame, least_modules: int = 3, least_inter: int = 2, score: float = 0.5) -> DataFrame:
    """package -> modules, intra, inter outgoing edges, cohesion, flagged."""
    e = edges.join(packages.select(F.col("node").alias("src"), F.col("package").alias("ps")), "src").join(packages.select(F.col("node").alias("dst"), F.col("package").alias("pd")), "dst")
    sums = e.groupBy(F.col("ps").alias("package")).agg(F.count_if(F.col("ps") == F.col("pd")).alias("intra"), F.count_if(F.col("ps") != F.col("pd")).alias("inter"))
    x = packages.groupBy("package").agg(F.count("*").alias("modules")).join(sums, "package", "left").fillna(0)
    x = x.withColumn("cohesion", ratio(F.col("intra"), F.col("intra") + F.col("inter"), 1.0))
    return x.withColumn("flagged", (F.col("modules") >= least_modules) & (F.col("inter") >= least_inter) & (F.col("cohesion") < score))


def fan_limit(value: Column) -> Column:
    """max(2, ceil(mean + population deviation)) as an aggregate."""
    return F.greatest(F.lit(2), F.ceil(F.avg(value) + F.stddev_pop(value))).cast("long")


def def_use(events: DataFrame, group: list[str], order: list[str], is_def: Column, is_use: Column, what: str) -> DataFrame:
    """Each use with the last definition before it in its group."""
    w = Window.partitionBy(*group).orderBy(*order).rowsBetween(Window.unboundedPreceding, -1)
    seen = events.withColumn("definition", F.last(F.when(is_def, F.col(what)), ignorenulls=True).over(w))
    return seen.where(is_use & F.col("definition").isNotNull()).select(*group, "definition", F.col(what).alias("use"))
