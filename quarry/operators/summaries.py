"""Summaries, roll-ups, filters, sorts and windows over metric tables. One pass each; partial aggregation before any shuffle."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def summary(df: DataFrame, value: Column, risk: Column, by: list[str] | None = None) -> DataFrame:
    """Count, mean, extremes and risk counts, of the whole table or by group."""
    n = lambda name: F.count_if(risk == name).alias(f"{name}_risk")
    aggs = [F.count("*").alias("total"), F.avg(value).alias("mean"), F.min(value).alias("least"), F.max(value).alias("most"), n("low"), n("medium"), n("high")]
    return df.groupBy(*(by or [])).agg(*aggs)


def histogram(df: DataFrame, label: Column) -> DataFrame:
    return df.groupBy(label.alias("bucket")).agg(F.count("*").alias("n"))


def in_range(df: DataFrame, value: Column, least: float = 0, most: float = 0, hide_zero: bool = False) -> DataFrame:
    """Rows within [least, most]; most 0 is unlimited."""
    keep = value >= least
    if most:
        keep = keep & (value <= most)
    return df.where(keep & (value > 0) if hide_zero else keep)


def top(df: DataFrame, order: list[Column], n: int) -> DataFrame:
    return df.orderBy(*order).limit(n)


def top_per_group(df: DataFrame, group: list[str], order: list[Column], n: int) -> DataFrame:
    return df.withColumn("rank", F.row_number().over(Window.partitionBy(*group).orderBy(*order))).where(F.col("rank") <= n)


def best_match(df: DataFrame, key: list[str], order: list[Column]) -> DataFrame:
    return top_per_group(df, key, order, 1).drop("rank")


def unpivot(df: DataFrame, ids: list[str], metrics: list[str]) -> DataFrame:
    return df.unpivot(ids, metrics, "metric", "value")


def merge_spans(df: DataFrame, group: list[str], start: str, end: str, slack: int = 1) -> DataFrame:
    """Gaps and islands: spans of a group that touch (within ``slack``) become one."""
    w = Window.partitionBy(*group).orderBy(start, end)
    before = F.max(end).over(w.rowsBetween(Window.unboundedPreceding, -1))
    marked = df.withColumn("_new", (before.isNull() | (F.col(start) > before + slack)).cast("long"))
    numbered = marked.withColumn("_island", F.sum("_new").over(w.rowsBetween(Window.unboundedPreceding, 0)))
    return numbered.groupBy(*group, "_island").agg(F.min(start).alias(start), F.max(end).alias(end), F.count("*").alias("merged")).drop("_island")


def look_back(group: list[str], line: Column, is_mark: Column, reach: int) -> Column:
    """Whether a row of the group whose line is up to ``reach`` lines above has the mark: lines, not rows, are counted."""
    w = Window.partitionBy(*group).orderBy(line).rangeBetween(-reach, -1)
    return F.coalesce(F.max(is_mark.cast("int")).over(w), F.lit(0)) == 1


def quality_join(parts: list[DataFrame], key: str, fills: dict[str, float]) -> DataFrame:
    """Full outer join of roll-ups by one key; what a side lacks is filled."""
    out = parts[0]
    for p in parts[1:]:
        out = out.join(p, key, "full")
    return out.fillna(fills)
