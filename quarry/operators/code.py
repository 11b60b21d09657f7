"""Functions, dead code and lines of parsed source files, as relational operators over the relations of ``sources``."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.operators.summaries import merge_spans

#: A function, in the relations that have its blocks.
FUNCTION = ["path", "function", "function_line"]
#: Severities of dead code, mildest first, and reasons (fixed values).
LEVELS = ["info", "warning", "critical"]
REASONS = ["unreachable_after_return", "unreachable_after_break", "unreachable_after_continue", "unreachable_after_raise", "unreachable_branch", "unreachable_after_infinite_loop"]
#: How far above a block its terminator may end.
REACH = 5
WARN_SLOC, LONG_SLOC = 50, 100


# -- functions ------------------------------------------------------------------------------------------------------


def rated(functions: DataFrame) -> DataFrame:
    """Functions with risk (of complexity, cognitive complexity or nesting) and size (ok, warning, critical by source lines)."""
    size = F.when(F.col("sloc") > LONG_SLOC, "critical").when(F.col("sloc") > WARN_SLOC, "warning").otherwise("ok")
    return functions.withColumn("risk", S.complexity_risk(F.col("cyclomatic"), F.col("cognitive"), F.col("nesting"))).withColumn("size", size)


def reported(functions: DataFrame, least: int = 1, unchanged: bool = True) -> DataFrame:
    """What a report lists: functions of ``least`` complexity or more; without ``unchanged`` those of complexity 1 are hidden."""
    return functions.where((F.col("cyclomatic") >= least) & (F.lit(unchanged) | (F.col("cyclomatic") > 1)))


def complexity_summary(functions: DataFrame) -> DataFrame:
    """One row over all functions, reported or not: count, three means, extremes, risk counts and a histogram as a map."""
    n = lambda r: F.count_if(F.col("risk") == r).alias(f"{r}_risk")
    means = [F.coalesce(F.avg(c), F.lit(0.0)).alias(f"mean_{c}") for c in ("cyclomatic", "cognitive", "nesting")]
    buckets = {"1": (0, 1), "2-5": (2, 5), "6-10": (6, 10), "11-20": (11, 20), "21+": (21, 1 << 30)}
    counts = F.create_map(*[x for name, (lo, hi) in buckets.items() for x in (F.lit(name), F.count_if(F.col("cyclomatic").between(lo, hi)))])
    return functions.agg(F.count("*").alias("functions"), *means, F.min("cyclomatic").alias("least"), F.max("cyclomatic").alias("most"), n("low"), n("medium"), n("high"), counts.alias("histogram"))


def sorted_functions(functions: DataFrame, by: str = "complexity") -> DataFrame:
    """In order of complexity, name or risk; ties by path, line and name, so the order is total."""
    order = {"complexity": [F.desc("cyclomatic")], "name": [F.asc("function")], "risk": [F.desc(S.ordinal(F.col("risk"), ["low", "medium", "high"])), F.desc("cyclomatic")]}[by]
    return functions.orderBy(*order, "path", "start_line", "function")


def warnings(functions: DataFrame, cognitive: int = 25, nesting: int = 7) -> DataFrame:
    """path, function, message of functions beyond the thresholds; one row for each threshold that is passed."""
    text = lambda what, col, most: F.when(F.col(col) > most, F.format_string(f"%s: {what} %d exceeds threshold {most}", "function", col))
    found = F.array(text("cognitive complexity", "cognitive", cognitive), text("nesting depth", "nesting", nesting))
    return functions.select("path", "function", F.explode(F.filter(found, lambda m: m.isNotNull())).alias("message"))


def module_rollup(functions: DataFrame, module: str = "<module>") -> DataFrame:
    """By file: functions without the module's own code, whose file is kept with zeros."""
    real = F.col("function") != module
    mean = lambda c: F.coalesce(F.avg(F.when(real, F.col(c))), F.lit(0.0)).alias(f"mean_{c}")
    return functions.groupBy("path").agg(
        F.count_if(real).alias("functions"), mean("cyclomatic"), mean("cognitive"), F.coalesce(F.max(F.when(real, F.col("cyclomatic"))), F.lit(0)).alias("most"),
        F.count_if(real & (F.col("risk") == "high")).alias("high_risk"), F.coalesce(F.sum(F.when(real, F.col("handlers"))), F.lit(0)).alias("handlers"),
    )


def directory_rollup(functions: DataFrame) -> DataFrame:
    """By the folder that holds the file ('.' at the top)."""
    folder = F.when(F.col("path").contains("/"), S.dirname(F.col("path"))).otherwise(".")
    return functions.groupBy(folder.alias("directory")).agg(
        F.count("*").alias("functions"), F.avg("cyclomatic").alias("mean_cyclomatic"), F.max("cyclomatic").alias("most"), F.count_if(F.col("risk") == "high").alias("high_risk"),
        F.avg("nesting").alias("mean_nesting"), F.max("nesting").alias("most_nesting"),
    )


def node_statistics(nodes: DataFrame) -> DataFrame:
    """path, type, count, deepest place."""
    return nodes.groupBy("path", "type").agg(F.count("*").alias("n"), F.max("depth").alias("depth"))


# -- dead code ------------------------------------------------------------------------------------------------------


def dead_blocks(blocks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Blocks with statements that the entry doesn't reach and that aren't just pass, with reason and severity.

    The reason is the terminator of the block that ends last within REACH lines above; of equal ones return, break,
    continue, raise in this order. Without one the block is a branch that is never taken."""
    key = key or FUNCTION
    dead = blocks.where(~F.col("reachable") & (F.col("n_stmts") > 0) & ~F.col("is_noop")).select(*key, "block", "start_line", "end_line")
    ends = blocks.where(F.col("ends_by").isNotNull()).select(*[F.col(k).alias(f"_{k}") for k in key], F.col("block").alias("_block"), F.col("end_line").alias("_end"), "ends_by")
    near = (F.col("start_line") - F.col("_end")).between(1, REACH) & (F.col("block") != F.col("_block"))
    same = near
    for k in key:
        same = same & (F.col(k) == F.col(f"_{k}"))
    rank = S.ordinal(F.col("ends_by"), ["raise", "continue", "break", "return"])
    found = dead.join(ends, same, "left").groupBy(*key, "block", "start_line", "end_line").agg(F.max_by("ends_by", F.struct("_end", rank.alias("r"))).alias("by"))
    reason = F.when(F.col("by").isNull(), "unreachable_branch").otherwise(F.concat(F.lit("unreachable_after_"), "by"))
    return found.select(*key, "block", "start_line", "end_line", reason.alias("reason"), F.when(F.col("by").isNull(), "warning").otherwise("critical").alias("severity"))


def dead_code(found: DataFrame, key: list[str] | None = None) -> DataFrame:
    """Dead blocks that touch and have one reason are one finding."""
    key = key or FUNCTION
    merged = merge_spans(found, [*key, "reason", "severity"], "start_line", "end_line")
    after = F.regexp_extract("reason", r"after_(\w+)$", 1)
    text = F.when(F.col("reason") == "unreachable_branch", "Code in this branch is unreachable under normal execution flow").otherwise(F.format_string("Code appears after a %s statement and will never be executed", after))
    return merged.withColumn("description", text)


def at_least(findings: DataFrame, severity: str, levels: list[str] = LEVELS) -> DataFrame:
    return findings.where(S.ordinal(F.col("severity"), levels) >= levels.index(severity))


def with_reasons(findings: DataFrame, enabled: list[str]) -> DataFrame:
    return findings.where(F.col("reason").isin(enabled))


def dead_summary(blocks: DataFrame, findings: DataFrame) -> DataFrame:
    """One row: findings by severity and by reason (maps), blocks, dead blocks, and the share that is reachable."""
    by = lambda col, names: F.create_map(*[x for n in names for x in (F.lit(n), F.count_if(F.col(col) == n))])
    a = findings.agg(F.count("*").alias("findings"), by("severity", LEVELS).alias("by_severity"), by("reason", REASONS).alias("by_reason"))
    b = blocks.agg(F.count("*").alias("blocks"), F.count_if(~F.col("reachable") & (F.col("n_stmts") > 0) & ~F.col("is_noop")).alias("dead_blocks"), S.ratio(F.count_if("reachable"), F.count("*"), 1.0).alias("reachable_ratio"))
    return a.crossJoin(b)  # one row each


def dead_by_file(dead: DataFrame, findings: DataFrame) -> DataFrame:
    """path -> findings, distinct dead blocks (a block is named by its function and number)."""
    a = findings.groupBy("path").agg(F.count("*").alias("findings"))
    b = dead.select("path", "function", "function_line", "block").distinct().groupBy("path").agg(F.count("*").alias("dead_blocks"))
    return a.join(b, "path", "full").fillna(0)


def sorted_findings(findings: DataFrame, levels: list[str] = LEVELS) -> DataFrame:
    """Severest first, then by place."""
    return findings.orderBy(F.desc(S.ordinal(F.col("severity"), levels)), "path", "start_line", "function")


def reachability(blocks: DataFrame, key: list[str] | None = None) -> DataFrame:
    """By function: blocks, reachable ones and their share."""
    return blocks.groupBy(*(key or FUNCTION)).agg(F.count("*").alias("blocks"), F.count_if("reachable").alias("reachable"), S.ratio(F.count_if("reachable"), F.count("*"), 1.0).alias("ratio"))


def flow_features(blocks: DataFrame, edges: DataFrame, key: list[str] | None = None) -> DataFrame:
    """By function: blocks, edges, each edge type's count, edges - blocks + 2, successors a block, loop and conditional edges."""
    key = key or FUNCTION
    types = ["normal", "cond_true", "cond_false", "loop", "break", "continue", "return", "exception"]
    n = blocks.groupBy(*key).agg(F.count("*").alias("blocks"))
    e = edges.groupBy(*key).agg(F.count("*").alias("edges"), *[F.count_if(F.col("edge_type") == t).alias(t) for t in types])
    x = n.join(e, key, "left").fillna(0, ["edges", *types])
    return x.withColumn("cyclomatic", F.col("edges") - F.col("blocks") + 2).withColumn("branching", F.col("edges") / F.col("blocks")).withColumn("conditional", F.col("cond_true") + F.col("cond_false"))


def dataflow_features(variables: DataFrame, pairs: DataFrame, key: list[str] | None = None) -> DataFrame:
    """By function: definitions, uses, variables, pairs, cross-block ones, the longest chain of a variable, pairs a definition."""
    key = key or FUNCTION
    a = variables.groupBy(*key).agg(F.count_if("is_def").alias("defs"), F.count_if(~F.col("is_def")).alias("uses"), F.count_distinct("name").alias("variables"))
    chains = pairs.groupBy(*key, "name").agg(F.count("*").alias("chain"), F.count_if("cross_block").alias("cross"))
    b = chains.groupBy(*key).agg(F.sum("chain").alias("pairs"), F.sum("cross").alias("cross_pairs"), F.max("chain").alias("longest"))
    return a.join(b, key, "left").fillna(0).withColumn("mean_chain", S.ratio(F.col("pairs"), F.col("defs")))


# -- lines ----------------------------------------------------------------------------------------------------------


def range_sloc(lines: DataFrame, ranges: DataFrame, group: list[str], start: str = "start_line", end: str = "end_line") -> DataFrame:
    """``ranges`` with sloc, the source lines in each: a difference of two running sums, clipped to the file."""
    w = Window.partitionBy(*group).orderBy("line").rowsBetween(Window.unboundedPreceding, 0)
    upto = lines.select(*group, "line", F.sum((F.col("kind") == "code").cast("long")).over(w).alias("upto"))
    last = lines.groupBy(*group).agg(F.max("line").alias("_last"))
    x = ranges.join(last, group, "left").withColumn("_hi", F.least(end, "_last")).withColumn("_lo", F.col(start) - 1)
    hi = upto.select(*group, F.col("line").alias("_hi"), F.col("upto").alias("_a"))
    lo = upto.select(*group, F.col("line").alias("_lo"), F.col("upto").alias("_b"))
    x = x.join(hi, [*group, "_hi"], "left").join(lo, [*group, "_lo"], "left")
    bad = (F.col(start) <= 0) | (F.col(start) > F.col(end)) | F.col("_last").isNull() | (F.col(start) > F.col("_last"))
    return x.withColumn("sloc", F.when(bad, 0).otherwise(F.col("_a") - F.coalesce("_b", F.lit(0))).cast("long")).drop("_hi", "_lo", "_a", "_b", "_last")


def line_totals(facts: DataFrame) -> DataFrame:
    """One row of sums over files, and the share of comments in comments and source lines."""
    names = ("physical", "sloc", "lloc", "comment_lines", "docstring_lines", "blank_lines")
    x = facts.agg(F.count("*").alias("files"), *[F.coalesce(F.sum(c), F.lit(0)).alias(c) for c in names])
    return x.withColumn("comment_ratio", S.ratio(F.col("comment_lines"), F.col("sloc") + F.col("comment_lines")))


def context(lines: DataFrame, findings: DataFrame, key: str = "path", around: int = 3) -> DataFrame:
    """Each finding's lines and ``around`` more on either side: an equi-join by file with a range condition."""
    l = lines.select(F.col(key).alias("_k"), F.col("line").alias("context_line"), F.col("text").alias("context_text"))  # noqa: E741
    return findings.join(l, (F.col(key) == F.col("_k")) & F.col("context_line").between(F.col("start_line") - around, F.col("end_line") + around)).drop("_k")


def gate_rows(functions: DataFrame, most: int = 10, long: int = LONG_SLOC) -> DataFrame:
    """path, function, rule of functions that fail the gate; one row a rule."""
    rules = F.array(F.when(F.col("cyclomatic") > most, "complexity"), F.when(F.col("sloc") > long, "length"))
    return functions.select("path", "function", F.explode(F.filter(rules, lambda r: r.isNotNull())).alias("rule"))


def severity_rank(col: Column) -> Column:
    return S.ordinal(col, LEVELS)
