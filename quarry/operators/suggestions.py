"""Suggestions from findings of every analysis: one schema, severity and effort rules, ten a category, one order."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S

SEVERITIES, EFFORTS = ["info", "warning", "critical"], ["easy", "moderate", "hard"]
MOST = 10
COLUMNS = "category severity effort title description steps path subject line metric threshold".split()


def priority(severity: Column, effort: Column) -> Column:
    """Place in the order: severity counts double, but what is hard and not mere information comes after what is easier."""
    s, e = 2 - S.ordinal(severity, SEVERITIES), S.ordinal(effort, EFFORTS)
    return F.when((s <= 1) & (e == 2), 4 + s).when(s == 2, 6 + e).otherwise(2 * s + e)


def _row(df: DataFrame, category: str, **cols: Column) -> DataFrame:
    none = {c: F.lit(None).cast("string") for c in ("path", "subject", "metric", "threshold")} | {"line": F.lit(None).cast("int"), "steps": F.array().cast("array<string>")}
    every = none | {"category": F.lit(category)} | cols
    return df.select(*[every[c].alias(c) for c in COLUMNS])


def of_complexity(functions: DataFrame, medium: int = 10, high: int = 20, module: str = "<module>") -> DataFrame:
    """functions: path, function, start_line, cyclomatic, nesting, loops, handlers."""
    x = functions.where(F.col("cyclomatic") > medium)
    top, base = F.col("function") == module, F.element_at(F.split("path", "/"), -1)
    title = F.when(top, F.format_string("Reduce top-level code complexity in '%s'", base)).otherwise(F.format_string("Refactor high-complexity function '%s'", "function"))
    step = (
        F.when(top, F.array(F.lit("Move top-level logic into functions"), F.lit("Keep imports, constants and a call of main at the top")))
        .when(F.col("nesting") > 4, F.array(F.format_string("Find the deepest block at line %d", "start_line"), F.lit("Return early from nested conditions")))
        .when(F.col("loops") >= 3, F.array(F.lit("Move loop bodies into functions"), F.lit("Use comprehensions for simple loops")))
        .when(F.col("handlers") >= 3, F.array(F.lit("Merge similar handlers"), F.lit("Move try statements into functions of their own")))
        .otherwise(F.array(F.format_string("Split '%s' by responsibility", "function"), F.lit("Move long blocks into functions")))
    )
    return _row(
        x, "complexity", severity=F.when(F.col("cyclomatic") > high, "critical").otherwise("warning"), effort=F.lit("moderate"), title=title,
        description=F.format_string("Cyclomatic complexity is %d.", "cyclomatic"), steps=step, path=F.col("path"), subject=F.col("function"), line=F.col("start_line").cast("int"), metric=F.col("cyclomatic").cast("string"), threshold=F.lit(str(medium)),
    )


def of_dead_code(findings: DataFrame) -> DataFrame:
    """findings: path, function, start_line, end_line, reason, severity, description. What follows a terminator is easy to remove."""
    branch = F.col("reason") == "unreachable_branch"
    after = F.regexp_replace(F.regexp_replace("reason", "^unreachable_(after_)?", ""), "_", " ")
    steps = F.when(branch, F.array(F.lit("Look at the condition before this branch"), F.lit("Simplify it or remove the branch"))).otherwise(F.array(F.format_string("Delete lines %d-%d in %s", "start_line", "end_line", "path"), F.lit("Check that nothing needed goes with them")))
    return _row(
        findings, "dead_code", severity=F.col("severity"), effort=F.when(branch, "moderate").otherwise("easy"), title=F.format_string("Remove dead code after %s in '%s'", after, "function"),
        description=F.concat("description", F.when(branch, "").otherwise(" This code is safely removable.")), steps=steps, path=F.col("path"), subject=F.col("function"), line=F.col("start_line").cast("int"),
    )


def of_clones(groups: DataFrame) -> DataFrame:
    """groups: type, members, similarity, path, line. Four members or more are critical; the effort grows with the type."""
    effort = F.when(F.col("type") == 1, "easy").when(F.col("type") <= 3, "moderate").otherwise("hard")
    return _row(
        groups, "clone", severity=F.when(F.col("members") >= 4, "critical").otherwise("warning"), effort=effort, title=F.format_string("Extract duplicated code (Type-%d, %d fragments)", F.col("type").cast("int"), F.col("members").cast("int")),
        description=F.format_string("%d fragments are alike.", F.col("members").cast("int")), path=F.col("path"), line=F.col("line").cast("int"), metric=F.format_string("%.0f%% similarity", F.col("similarity") * 100),
    )


def _of_class(df: DataFrame, category: str, value: str, least: int, high: int, verb: str, names: Column, threshold: str) -> DataFrame:
    x, v = df.where(F.col(value) > least), F.col(value)
    return _row(
        x, category, severity=F.when(v > high, "critical").otherwise("warning"), effort=F.when(v > high, "hard").otherwise("moderate"), title=F.format_string(f"{verb} class '%s'", "class"), description=names,
        path=F.col("path"), subject=F.col("class"), line=F.col("class_line").cast("int"), metric=v.cast("string"), threshold=F.lit(threshold),
    )


def of_coupling(classes: DataFrame) -> DataFrame:
    return _of_class(classes, "coupling", "cbo", 3, 7, "Reduce coupling in", F.format_string("Depends on %d other classes (%s).", F.col("cbo").cast("int"), F.array_join("dependencies", ", ")), "7")


def of_cohesion(classes: DataFrame) -> DataFrame:
    groups = F.array_join(F.transform("groups", lambda g: F.concat(F.lit("["), F.array_join(g, ", "), F.lit("]"))), ", ")
    return _of_class(classes, "cohesion", "lcom4", 2, 5, "Split low-cohesion", F.format_string("Has %d groups of methods that share nothing: %s.", F.col("lcom4").cast("int"), groups), "2")


def of_cycles(advice: DataFrame) -> DataFrame:
    """advice: rank, text; the first ten."""
    return _row(advice.orderBy("rank").limit(MOST), "dependency", severity=F.lit("critical"), effort=F.lit("hard"), title=F.lit("Break circular dependency"), description=F.col("text"))


def of_architecture(violations: DataFrame, shown: int = 3) -> DataFrame:
    """violations: src, dst, severity (error or warning), rule, suggestion. Those of one module, rule and severity are one, with
    the first ``shown`` targets."""
    g = violations.where("severity is not null").groupBy("src", "rule", "severity", "suggestion").agg(F.sort_array(F.collect_set(F.col("dst").cast("string"))).alias("to"))
    n = F.size("to")
    text = F.concat("suggestion", F.when(n == 1, F.concat(F.lit(" (target: "), F.col("to")[0], F.lit(")"))).when(n <= shown, F.concat(F.lit(" (targets: "), F.array_join("to", ", "), F.lit(")"))).otherwise(F.concat(F.lit(" (targets: "), F.array_join(F.slice("to", 1, shown), ", "), F.format_string(" and %d more)", n - shown))))
    level = F.when(F.col("severity").isin("error", "critical"), "critical").otherwise(F.col("severity"))
    return _row(g, "architecture", severity=level, effort=F.when(level == "critical", "hard").otherwise("moderate"), title=F.format_string("Fix architecture violation in '%s'", F.col("src").cast("string")), description=text, subject=F.col("src").cast("string"))


def capped(rows: DataFrame, most: int = MOST) -> DataFrame:
    """The ``most`` of each category, severest first, then by priority and place."""
    order = [F.desc(S.ordinal(F.col("severity"), SEVERITIES)), priority(F.col("severity"), F.col("effort")), F.asc("path"), F.asc("line"), F.asc("title"), F.asc("description")]
    return rows.withColumn("_n", F.row_number().over(Window.partitionBy("category").orderBy(*order))).where(F.col("_n") <= most).drop("_n")


def gathered(*parts: DataFrame, most: int = MOST) -> DataFrame:
    """All suggestions, capped by category, with their priority; in its order."""
    every = capped(reduce(DataFrame.unionByName, parts), most)
    return every.withColumn("priority", priority(F.col("severity"), F.col("effort"))).orderBy("priority", "category", "path", "line", "title", "description")
