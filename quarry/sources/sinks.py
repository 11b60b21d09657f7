"""Sinks: tables, documents and graph files through Spark's writers; small reports as text on the driver.

What a table has many rows of is written by Spark. What is a report (one summary, a few dozen lines) is collected up to a
limit that its caller names, and formatted.
"""

from __future__ import annotations

import html
import json

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

#: Columns of each report's CSV: header -> column (fixed layouts).
LAYOUTS = {
    "complexity": {"Function": "function", "Complexity": "cyclomatic", "Cognitive Complexity": "cognitive", "Risk": "risk", "Nodes": "blocks", "Edges": "edges", "Nesting Depth": "nesting", "If Statements": "ifs", "Loop Statements": "loops", "Exception Handlers": "handlers", "SLOC": "sloc"},
    "cbo": {"ClassName": "class", "FilePath": "path", "StartLine": "class_line", "EndLine": "end_line", "CBO": "cbo", "RiskLevel": "risk", "IsAbstract": "is_abstract", "InheritanceDeps": "kind_inheritance", "TypeHintDeps": "kind_type_hint", "InstantiationDeps": "kind_instantiation", "AttributeAccessDeps": "kind_attribute", "ImportDeps": "kind_import", "BaseClasses": "bases", "DependentClasses": "dependencies"},
    "lcom": {"ClassName": "class", "FilePath": "path", "StartLine": "class_line", "EndLine": "end_line", "LCOM4": "lcom4", "RiskLevel": "risk", "TotalMethods": "total_methods", "ExcludedMethods": "excluded", "InstanceVariables": "instance_variables"},
    "dead_code": {"File": "path", "Function": "function", "Severity": "severity", "StartLine": "start_line", "EndLine": "end_line", "Reason": "reason", "Description": "description"},
    "mock_data": {"File": "path", "Line": "line", "Type": "kind", "Severity": "severity", "Value": "value"},
    "injection": {"type": "type", "subtype": "subtype", "severity": "severity", "class_name": "class", "method_name": "method", "file_path": "path", "start_line": "line", "description": "description", "suggestion": "suggestion"},
    "clones": {"clone_type": "type", "similarity": "similarity", "confidence": "confidence", "distance": "distance", "clone1_file": "a_path", "clone1_start_line": "a_start", "clone1_end_line": "a_end", "clone1_size": "a_size", "clone1_lines": "a_lines", "clone2_file": "b_path", "clone2_start_line": "b_start", "clone2_end_line": "b_end", "clone2_size": "b_size", "clone2_lines": "b_lines"},
}


def laid_out(df: DataFrame, layout: str) -> DataFrame:
    """The columns of a report's CSV under their headers; lists are joined by semicolons."""
    lists = {f.name for f in df.schema.fields if isinstance(f.dataType, T.ArrayType)}
    one = lambda c: F.array_join(c, ";") if c in lists else F.col(c)
    return df.select(*[one(c).alias(h) for h, c in LAYOUTS[layout].items()])


def to_csv(df: DataFrame, path: str, layout: str | None = None) -> None:
    (laid_out(df, layout) if layout else df).write.option("header", True).csv(path)


def with_empty_lists(df: DataFrame) -> DataFrame:
    """Null lists are empty ones, so that readers always find a list."""
    return df.select(*[F.coalesce(F.col(f"`{f.name}`"), F.array().cast(f.dataType)).alias(f.name) if isinstance(f.dataType, T.ArrayType) else F.col(f"`{f.name}`") for f in df.schema.fields])


def to_json(df: DataFrame, path: str) -> None:
    with_empty_lists(df).write.option("ignoreNullFields", False).json(path)


def json_lines(df: DataFrame) -> DataFrame:
    x = with_empty_lists(df)
    return x.select(F.to_json(F.struct(*[F.col(f"`{c}`") for c in x.columns]), {"ignoreNullFields": "false"}).alias("json"))


def _scalar(v) -> str:
    if v is None:
        return "null"
    if isinstance(v, bool):
        return "true" if v else "false"
    return json.dumps(v, ensure_ascii=False, default=str) if isinstance(v, str) or not isinstance(v, (int, float)) else str(v)


def yaml(value, indent: int = 0) -> str:
    """A document of dicts, lists and scalars as YAML; strings are quoted, so they need no rules."""
    pad = "  " * indent
    if isinstance(value, dict):
        if not value:
            return pad + "{}\n"
        return "".join(f"{pad}{k}:\n{yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}{k}: {'{}' if v == {} else '[]' if v == [] else _scalar(v)}\n" for k, v in value.items())
    if isinstance(value, list):
        if not value:
            return pad + "[]\n"
        return "".join(f"{pad}-\n{yaml(v, indent + 1)}" if isinstance(v, (dict, list)) and v else f"{pad}- {'{}' if v == {} else '[]' if v == [] else _scalar(v)}\n" for v in value)
    return pad + _scalar(value) + "\n"


def rows(df: DataFrame, most: int) -> list[dict]:
    """At most ``most`` rows as dicts: what a report shows."""
    return [r.asDict(recursive=True) for r in df.limit(most).collect()]


def table(df: DataFrame, most: int = 100, title: str = "") -> str:
    """A report's lines: a title, a header, aligned columns, and how many rows are not shown."""
    shown = rows(df, most + 1)
    more, shown = len(shown) > most, shown[:most]
    cells = [df.columns, *[[str(r[c]) if r[c] is not None else "" for c in df.columns] for r in shown]]
    width = [max(len(r[k]) for r in cells) for k in range(len(df.columns))]
    line = lambda r: "  ".join(c.ljust(w) for c, w in zip(r, width)).rstrip()
    out = [*([title, "=" * len(title)] if title else []), line(cells[0]), "  ".join("-" * w for w in width), *map(line, cells[1:])]
    return "\n".join(out + (["..."] if more else [])) + "\n"


def page(sections: dict[str, DataFrame], title: str, most: int = 200) -> str:
    """An HTML report: a heading and a table for each section."""
    out = [f"<!DOCTYPE html><html><head><meta charset='utf-8'><title>{html.escape(title)}</title></head><body><h1>{html.escape(title)}</h1>"]
    for name, df in sections.items():
        head = "".join(f"<th>{html.escape(c)}</th>" for c in df.columns)
        body = "".join("<tr>" + "".join(f"<td>{html.escape('' if r[c] is None else str(r[c]))}</td>" for c in df.columns) + "</tr>" for r in rows(df, most))
        out.append(f"<h2>{html.escape(name)}</h2><table><tr>{head}</tr>{body}</table>")
    return "".join(out) + "</body></html>\n"


def nice_ceiling(n: Column) -> Column:
    """The least of 3, 5, 6 and 1, 2, 3, 5, 6, 10 times a power of ten that is n or more: the end of an axis."""
    power = F.pow(F.lit(10.0), F.floor(F.log10(F.greatest(n, F.lit(1)).cast("double"))))
    steps = F.filter(F.transform(F.array(*[F.lit(float(s)) for s in (1, 2, 3, 5, 6, 10)]), lambda s: s * power), lambda c: c >= n)
    return F.when(n <= 3, F.lit(3)).otherwise(F.array_min(steps)).cast("long")


def bins(low: int, medium: int) -> list[tuple[str, int, int | None]]:
    """(label, least, most) of a histogram whose bars end at 1, 5, low and medium, with an open one after."""
    medium = max(medium, low + 1)
    tops = sorted({1, low, medium} | ({5} if low > 5 else set()))
    out, least = [], 1
    for t in tops:
        out.append((str(t) if t == least else f"{least}-{t}", least, t))
        least = t + 1
    return [*out, (f"{least}+", least, None)]


def binned(df: DataFrame, value: str, low: int, medium: int) -> DataFrame:
    """bin, n of every bar, also of empty ones: one pass with a count for each bar."""
    every = bins(low, medium)
    test = lambda a, b: (F.col(value) >= a) if b is None else F.col(value).between(a if a > 1 else -(1 << 30), b)
    one = df.agg(*[F.count_if(test(a, b)).alias(f"b{k}") for k, (_, a, b) in enumerate(every)])
    return one.select(F.inline(F.array(*[F.struct(F.lit(k).alias("place"), F.lit(n).alias("bin"), F.col(f"b{k}").alias("n")) for k, (n, _, _) in enumerate(every)])))


def metric_rows(summary: DataFrame, modules: DataFrame, most: int = 10_000) -> DataFrame:
    """A report in two columns, metric and value: the one summary row, then each module's numbers under 'Module k ...', by path."""
    head = summary.select(F.explode(F.array(*[F.struct(F.lit(0).alias("k"), F.lit(i).alias("place"), F.lit(c).alias("metric"), F.col(c).cast("string").alias("value")) for i, c in enumerate(summary.columns)])).alias("r")).select("r.*")
    from pyspark.sql import Window

    k = F.row_number().over(Window.orderBy("path"))  # a report's modules: ``most`` of them
    m = modules.orderBy("path").limit(most).withColumn("k", k)
    cells = [F.struct(F.col("k"), F.lit(i).alias("place"), F.concat(F.lit("Module "), F.col("k").cast("string"), F.lit(" " + c)).alias("metric"), F.col(c).cast("string").alias("value")) for i, c in enumerate(modules.columns)]
    return head.unionByName(m.select(F.explode(F.array(*cells)).alias("r")).select("r.*")).orderBy("k", "place").select("metric", "value")


def dot_lines(edges: DataFrame, label: str | None = None) -> DataFrame:
    """(src, dst) as lines of a Graphviz graph; quotes in names are escaped."""
    q = lambda c: F.concat(F.lit('"'), F.replace(F.replace(F.col(c).cast("string"), F.lit("\\"), F.lit("\\\\")), F.lit('"'), F.lit('\\"')), F.lit('"'))
    tail = F.concat(F.lit(' [label="'), F.col(label).cast("string"), F.lit('"];')) if label else F.lit(";")
    return edges.select(F.concat(F.lit("  "), q("src"), F.lit(" -> "), q("dst"), tail).alias("value"))


def to_dot(edges: DataFrame, path: str, label: str | None = None) -> None:
    """A Graphviz file a partition; a reader adds the braces once."""
    dot_lines(edges, label).write.text(path)


def response(df: DataFrame, mode: str = "summary", most: int = 0) -> dict:
    """A tool's answer: the number of rows, and with 'detailed' or 'full' rows up to ``most`` (0: none for a summary, else
    100 and 10,000); whether some were left out."""
    limit = {"summary": 0, "detailed": most or 100, "full": most or 10_000}[mode]
    total = df.count()
    return {"total": total, "rows": rows(df, limit) if limit else [], "truncated": bool(limit) and total > limit}


def exit_code(violations: int, failed: bool = False) -> int:
    """0 without issues, 1 with some, 2 if the analysis itself failed or files could not be analysed."""
    return 2 if failed else int(violations > 0)
