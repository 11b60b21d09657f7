"""Placeholder data in texts and in the tokens of source files: words, domains, addresses, numbers, keys, comments."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.functions import scalar as S

LEVELS = ["info", "warning", "error"]


def of_string(text: Column, low: Column | None = None) -> list[tuple[str, str, Column]]:
    """(kind, severity, test) in the order in which ties are broken. ``low`` is the text in lower case, made once."""
    low = F.lower(text) if low is None else low
    return [
        ("keyword", "info", S.has_word(low, S.MOCK_WORDS)), ("domain", "warning", S.has_any(low, S.MOCK_DOMAINS)), ("email", "warning", S.mock_email(text)), ("phone", "warning", S.mock_phone(text)),
        ("uuid", "warning", S.mock_uuid(text)), ("repetitive", "info", S.repetitive(text)), ("credential", "error", S.mock_credential(text)),
    ]


def found(tests: list[tuple[str, str, Column]]) -> Column:
    """The array of (kind, severity) of tests that hold."""
    rows = [F.when(t, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))) for k, s, t in tests]
    return F.filter(F.array(*rows), lambda x: x.isNotNull())


def worst(tests: list[tuple[str, str, Column]]) -> Column:
    """(kind, severity) of the severest test that holds, the first of equals; null if none does."""
    out = F.lit(None).cast("struct<kind:string,severity:string>")
    for level in LEVELS:
        for k, s, t in reversed(tests):
            if s == level:
                out = F.when(t, F.struct(F.lit(k).alias("kind"), F.lit(s).alias("severity"))).otherwise(out)
    return out


def findings(tokens: DataFrame) -> DataFrame:
    """path, seq, line, col, kind, severity, value, variable of tokens that look like placeholder data: one a place, of the
    highest severity, the first of equals."""
    value = F.col("value")
    string = F.when(value != "", worst(of_string(value)))
    name = F.when(S.has_word(F.lower("text"), S.MOCK_WORDS), F.struct(F.lit("keyword").alias("kind"), F.lit("warning").alias("severity")))
    comment = F.when(S.mock_comment(value), F.struct(F.lit("placeholder").alias("kind"), F.lit("info").alias("severity")))
    both = F.when(name.isNotNull(), string)
    hit = F.when(F.col("kind") == "string", string).when(F.col("kind") == "identifier", name).when(F.col("kind") == "comment", comment).otherwise(both)
    variable = F.when(F.col("kind").isin("identifier", "assignment"), F.col("text"))
    x = tokens.select("path", "seq", "line", "col", hit.alias("hit"), "value", variable.alias("variable")).where("hit is not null")
    first = F.row_number().over(Window.partitionBy("path", "line", "col").orderBy(F.desc(S.ordinal(F.col("hit.severity"), LEVELS)), "seq"))
    return x.withColumn("_n", first).where("_n = 1").select("path", "seq", "line", "col", "hit.kind", "hit.severity", "value", "variable")


def is_test_file(path: Column) -> Column:
    base = F.element_at(F.split(path, "/"), -1)
    return base.startswith("test_") | base.endswith("_test.py") | (base == "conftest.py") | path.rlike(r"(^|/)(tests|test|testing|__tests__)/")


def is_test_module(module: Column) -> Column:
    parts = F.split(F.lower(module), r"\.")
    last = F.element_at(parts, -1)
    return F.exists(parts, lambda p: p.isin("tests", "test", "testing", "conftest")) | last.startswith("test_") | last.endswith("_test")


def selected(rows: DataFrame, least: str = "warning", kinds: list[str] | None = None, ignore: list[str] | None = None, tests: bool = False) -> DataFrame:
    """Findings to report: severe enough, of the kinds, not in test files (unless ``tests``) or paths that a pattern matches."""
    keep = S.ordinal(F.col("severity"), LEVELS) >= LEVELS.index(least)
    keep = keep & F.col("kind").isin(kinds) if kinds else keep
    keep = keep if tests else keep & ~is_test_file(F.col("path"))
    return rows.where(reduce(lambda a, p: a & ~F.col("path").rlike(p), ignore or [], keep))


def sorted_files(rows: DataFrame, by: str = "severity") -> DataFrame:
    """By file: findings by severity, kinds and the worst severity, in order of severity, name or first kind."""
    level = S.ordinal(F.col("severity"), LEVELS)
    x = rows.groupBy("path").agg(F.max(level).alias("worst"), F.count("*").alias("findings"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in LEVELS], F.min_by("kind", F.struct("line", "col")).alias("first_kind"))
    return x.orderBy(*{"severity": [F.desc("worst"), F.desc("findings"), F.asc("path")], "file": [F.asc("path")], "type": [F.asc("first_kind"), F.asc("path")]}[by])


def summary(rows: DataFrame) -> DataFrame:
    """kind -> findings, errors, warnings, infos, files."""
    return rows.groupBy("kind").agg(F.count("*").alias("n"), *[F.count_if(F.col("severity") == s).alias(f"{s}s") for s in reversed(LEVELS)], F.count_distinct("path").alias("files"))
