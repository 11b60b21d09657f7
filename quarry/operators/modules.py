"""Imports to modules and edges: relative and absolute resolution, re-exports, facts, matrix, roots and modularity."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.functions import scalar as S

#: Top modules of the standard library that are known by name (fixed values).
STANDARD = [
    "os", "sys", "re", "json", "datetime", "collections", "itertools", "functools", "operator", "math", "random", "string", "io", "pathlib", "unittest", "logging", "argparse", "configparser",
    "urllib", "http", "typing", "abc", "asyncio", "contextlib", "dataclasses", "enum", "pickle", "sqlite3", "csv", "xml", "html", "email", "time", "socket", "subprocess", "multiprocessing",
]


def _marker(path: Column) -> Column:
    return path.rlike(r"(^|/)__init__\.pyi?$")


def _up(package: Column, levels: Column) -> Column:
    """The package ``levels`` above; null if there are not so many."""
    parts = F.filter(F.split(package, r"\."), lambda p: p != "")
    return F.when(levels <= F.size(parts), F.array_join(F.slice(parts, F.lit(1), F.greatest(F.size(parts) - levels, F.lit(0))), "."))


def _joined(a: Column, b: Column) -> Column:
    return F.when((a != "") & (b != ""), F.concat(a, F.lit("."), b)).otherwise(F.concat(a, b))


def own_package(path: Column, module: Column) -> Column:
    return F.when(_marker(path), module).otherwise(S.package(module))


def reexports(imports: DataFrame, declared: DataFrame) -> DataFrame:
    """package, name -> source_module: what package markers import from below or beside themselves, under the name they
    give it; where a marker has a list __all__, only its names. Of equal names the last import counts."""
    m = imports.where(_marker(F.col("path")) & F.col("name").isNotNull() & (F.col("name") != "*"))
    base = F.when(F.col("level") > 0, _up(F.col("module"), F.col("level") - 1)).when(F.startswith("target", F.concat("module", F.lit("."))), F.lit(""))
    source = F.when(F.col("target") != "", _joined(base, F.col("target"))).otherwise(_joined(base, F.col("name")))
    x = m.select(F.col("module").alias("package"), F.coalesce("alias", "name").alias("name"), source.alias("source_module"), "line").where(F.col("source_module").isNotNull() & (F.col("source_module") != "") & (F.col("source_module") != F.col("package")))
    last = x.groupBy("package", "name").agg(F.max_by("source_module", "line").alias("source_module"))
    listed = declared.where(_marker(F.col("path"))).select(F.col("module").alias("package"), "name").distinct()
    some = listed.select("package").distinct().withColumn("_some", F.lit(True))
    kept = last.join(listed.withColumn("_named", F.lit(True)), ["package", "name"], "left").join(some, "package", "left")
    return kept.where(F.col("_some").isNull() | F.col("_named").isNotNull()).select("package", "name", "source_module")


def resolved(imports: DataFrame, modules: DataFrame, standard: bool = False, third_party: bool = False) -> DataFrame:
    """Imports with ``resolved``, the module they mean, and ``origin``: project, standard or third_party.

    Relative ones go up from the importer's package. Absolute ones are a project's module of that name, else one beside the
    importer or a folder above, else the standard library's or another's, which are kept if asked for. Each candidate is an
    equi-join with the modules, tried in order."""
    m = modules.select("module").distinct()
    own = own_package(F.col("path"), F.col("module"))
    rel = _joined(_up(own, F.col("level") - 1), F.col("target"))
    x = imports.withColumn("_own", own).withColumn("_rel", F.when(F.col("level") > 0, rel))
    local = (F.col("level") == 0) & ~F.split("target", r"\.")[0].isin(STANDARD)
    x = x.withColumn("_beside", F.when(local, _joined(F.col("_own"), F.col("target")))).withColumn("_above", F.when(local, _joined(S.package(F.col("_own")), F.col("target"))))
    for k, key in enumerate((F.when(F.col("level") == 0, F.col("target")), F.col("_beside"), F.col("_above"))):
        x = x.withColumn(f"_key{k}", key).join(m.select(F.col("module").alias(f"_m{k}")), F.col(f"_key{k}") == F.col(f"_m{k}"), "left")
    inside = F.coalesce("_rel", "_m0", "_m1", "_m2")
    std = F.split("target", r"\.")[0].isin(STANDARD)
    outside = F.when(F.col("level") == 0, F.when(std, F.when(F.lit(standard), F.col("target"))).otherwise(F.when(F.lit(third_party), F.col("target"))))
    origin = F.when(inside.isNotNull(), "project").when(std, "standard").otherwise("third_party")
    return x.select(*imports.columns, F.coalesce(inside, outside).alias("resolved"), origin.alias("origin"))


def edges(resolved_imports: DataFrame, modules: DataFrame, exports: DataFrame) -> DataFrame:
    """src, dst, is_lazy, type, imports: one edge a pair of different modules that are both known.

    A name is what its package re-exports (absolute imports only), else a submodule, else part of the module. Markers' imports
    of their own submodules don't count. An edge is lazy only if all its imports are; its type is that of its first import."""
    m = modules.select("module").distinct()
    x = resolved_imports.where(F.col("resolved").isNotNull())
    ex = exports.select(F.col("package").alias("_p"), F.col("name").alias("_n"), "source_module")
    x = x.join(ex, (F.col("resolved") == F.col("_p")) & (F.col("name") == F.col("_n")) & (F.col("level") == 0), "left")
    x = x.withColumn("_sub", F.when(F.col("name").isNotNull() & (F.col("name") != "*"), _joined(F.col("resolved"), F.col("name")))).join(m.select(F.col("module").alias("_is")), F.col("_sub") == F.col("_is"), "left")
    kind = F.when(F.col("level") > 0, "relative").when(F.col("name").isNotNull(), "from_import").otherwise("import")
    x = x.select("path", F.col("module").alias("src"), F.coalesce("source_module", "_is", "resolved").alias("dst"), "lazy", "line", kind.alias("type"))
    x = x.where((F.col("src") != F.col("dst")) & ~(_marker(F.col("path")) & F.startswith("dst", F.concat("src", F.lit(".")))))
    known = x.join(m.withColumnRenamed("module", "src"), "src", "left_semi").join(m.withColumnRenamed("module", "dst"), "dst", "left_semi")
    return known.groupBy("src", "dst").agg(F.bool_and("lazy").alias("is_lazy"), F.min_by("type", F.struct("line", "type")).alias("type"), F.count("*").alias("imports"))


def load_time(edges_: DataFrame) -> DataFrame:
    """Edges that count for cycles: those of imports that run when the module is loaded."""
    return edges_.where(~F.col("is_lazy"))


def abstractness() -> Column:
    """Of the relation of module facts."""
    return S.ratio(F.col("abstract_classes"), F.col("classes"))


def coupling_facts(coupling: DataFrame, abstract: DataFrame) -> DataFrame:
    """coupling (node, ca, ce, instability) and (node, abstractness) -> also distance |A + I - 1| and zones.

    stable: I <= 0.3; instable: I >= 0.7; pain: D >= 0.5, two dependents or more, I and A <= 0.3; useless: D >= 0.5, I and
    A >= 0.7; main sequence: D <= 0.2."""
    x = coupling.join(abstract, "node", "left").fillna({"abstractness": 0.0})
    x = x.withColumn("distance", F.abs(F.col("abstractness") + F.col("instability") - 1))
    i, a, d = F.col("instability"), F.col("abstractness"), F.col("distance")
    return x.select("*", (i <= 0.3).alias("stable"), (i >= 0.7).alias("instable"), ((d >= 0.5) & (F.col("ca") >= 2) & (i <= 0.3) & (a <= 0.3)).alias("pain"), ((d >= 0.5) & (i >= 0.7) & (a >= 0.7)).alias("useless"), (d <= 0.2).alias("main_sequence"))


def modularity_index(edges_: DataFrame, packages: DataFrame, cyclic: DataFrame) -> DataFrame:
    """One row, index: the share of edges inside packages, less up to half by the share of modules in cycles; 0 without
    modules, 0.5 with one package, 1 without edges."""
    e = edges_.join(packages.select(F.col("node").alias("src"), F.col("package").alias("ps")), "src").join(packages.select(F.col("node").alias("dst"), F.col("package").alias("pd")), "dst")
    a = e.agg(F.count("*").alias("edges"), F.count_if(F.col("ps") == F.col("pd")).alias("intra"))
    b = packages.agg(F.count("*").alias("modules"), F.count_distinct("package").alias("packages"))
    c = cyclic.agg(F.count("*").alias("cyclic"))
    index = F.when(F.col("modules") == 0, 0.0).when(F.col("packages") <= 1, 0.5).when(F.col("edges") == 0, 1.0).otherwise(S.ratio(F.col("intra"), F.col("edges")) * (1 - 0.5 * S.ratio(F.col("cyclic"), F.col("modules"))))
    return a.crossJoin(b).crossJoin(c).select("modules", "packages", "edges", "cyclic", index.alias("index"))  # one row each


def matrix(edges_: DataFrame) -> DataFrame:
    """node -> its row of the dependency matrix: a map of the nodes it depends on."""
    return edges_.groupBy(F.col("src").alias("node")).agg(F.map_from_entries(F.sort_array(F.collect_set(F.struct(F.col("dst").cast("string").alias("key"), F.lit(True).alias("value"))))).alias("depends_on"))


def refactoring(metrics: DataFrame, n: int = 10) -> DataFrame:
    """(node, distance, in_cycle, complexity) -> the n modules of highest priority above 10: 50 D beyond D 0.5, 30 in a
    cycle, 2 a point of complexity beyond 20; ties by name."""
    p = F.when(F.col("distance") > 0.5, F.col("distance") * 50).otherwise(0.0) + F.when(F.col("in_cycle"), 30.0).otherwise(0.0) + F.greatest(F.lit(0.0), (F.col("complexity") - 20) * 2.0)
    return metrics.select("node", p.alias("priority")).where("priority > 10").orderBy(F.desc("priority"), "node").limit(n)
