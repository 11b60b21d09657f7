"""Python source files as relations: scan, one parse, then relations of nodes, functions, blocks, imports, classes and so on.

Parsing is the only Python boundary; everything after it is relational. ``snapshot`` parses each file once and writes one
row a file with a column for each relation, an array of structs, to the shared folder; ``relation`` unnests one of them,
so Parquet reads that column alone. A file that can't be read or parsed is a row with an error, never a failed job.
"""

from __future__ import annotations

import sys
from functools import reduce

import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T
from pyspark.sql.pandas.types import to_arrow_type

from quarry.functions.lineage import stored
from quarry.functions.scalar import glob_regex
from quarry.sources import facts

#: Folders that a scan skips (fixed values); * stands for any characters.
SKIPPED = ["__pycache__", ".git", ".svn", ".hg", ".bzr", "node_modules", ".tox", ".pytest_cache", ".mypy_cache", "venv", "env", ".venv", ".env", "build", "dist", "*.egg-info"]
#: Files that are analysed by default, and those that aren't (fixed values).
SOURCES, MODULES = ("**/*.py",), ("**/*.py", "**/*.pyi")
EXCLUDED = ("test_*.py", "*_test.py", "**/tests/**", "**/test/**", "**/testing/**", "**/migrations/**")
_MB = 1 << 20
#: Text that is parsed before its rows are passed on.
BATCH_BYTES = 200_000


def matches(path: Column, pattern: str, basename: bool = False) -> Column:
    """A glob on a path; a pattern without a slash may also match the last part alone."""
    out = path.rlike(glob_regex(pattern))
    return out | F.element_at(F.split(path, "/"), -1).rlike(glob_regex(pattern)) if basename and "/" not in pattern else out


def included(path: Column, include, exclude) -> Column:
    """Exclusion goes first; no include patterns include all."""
    keep = reduce(lambda a, b: a | b, [matches(path, g) for g in include], F.lit(not include))
    return reduce(lambda a, g: a & ~matches(path, g, True), exclude, keep)


def pruned(path: Column) -> Column:
    """Whether a folder of the path is hidden or in SKIPPED, in any case of letters."""
    folders = F.slice(F.split(F.lower(path), "/"), F.lit(1), F.size(F.split(path, "/")) - 1)
    return F.exists(folders, lambda d: d.startswith(".") | reduce(lambda a, b: a | b, [d.rlike(glob_regex(g)) for g in SKIPPED]))


def _hidden_names(spark: SparkSession, root: str):
    """Paths of files that Spark's readers hide: names that begin with an underscore, and empty files. Names only."""
    top = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(root)
    it = top.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).listFiles(top, True)
    while it.hasNext():
        status = it.next()
        p = status.getPath()
        if (p.getName().startswith("_") or status.getLen() == 0) and p.getName().endswith((".py", ".pyi")):
            yield p.toString()


def _read(batches):
    from pyarrow import fs

    for b in batches:
        found, errors = [], []
        for path in b.column("path").to_pylist():
            try:
                system, at = fs.FileSystem.from_uri(path if "://" in path else path.replace("file:", "file://", 1))
                with system.open_input_stream(at) as f:
                    found.append(f.read())
                errors.append(None)
            except (OSError, ValueError, pa.ArrowException) as e:
                found.append(None)
                errors.append(f"{type(e).__name__}: {e}")
        yield pa.RecordBatch.from_arrays([b.column("path"), pa.array(found, pa.binary()), pa.array(errors, pa.string())], ["path", "content", "read_err"])


def scan(spark: SparkSession, root: str, include: tuple[str, ...] = MODULES, exclude: tuple[str, ...] = (), roots: tuple[str, ...] = (), recursive: bool = True) -> DataFrame:
    """path (below ``root``), full_path, module, content, read_err of the Python files under ``root``.

    Package markers, whose underscore hides them from Spark's readers, and empty files are read by the executors from a list
    of names.
    ``roots``: folders below ``root`` that module names start from, besides ``src`` if it is no package; the longest wins.
    """
    seen = spark.read.format("binaryFile").option("recursiveFileLookup", "true").option("pathGlobFilter", "*.py*").load(root).select("path", "content", F.lit(None).cast("string").alias("read_err"))
    names = [(p,) for p in _hidden_names(spark, root)]
    if names:
        listed = spark.createDataFrame(names, "path string").repartition(min(len(names), 4 * spark.sparkContext.defaultParallelism))
        seen = seen.unionByName(listed.mapInArrow(_read, "path string, content binary, read_err string"))
    depth = len(root.split("://", 1)[-1].strip("/").split("/"))
    plain = F.regexp_replace("path", r"^[a-zA-Z0-9+.-]+:/*", "")
    below = F.array_join(F.slice(F.split(plain, "/"), F.lit(depth + 1 if "://" not in root or root.startswith("file:") else depth), F.lit(1 << 20)), "/")
    x = seen.select(below.alias("path"), F.col("path").alias("full_path"), "content", "read_err")
    x = x.where(included(F.col("path"), include, exclude) & ~pruned(F.col("path")))
    if not recursive:
        x = x.where(~F.col("path").contains("/"))
    markers = {n.removeprefix("file:").rstrip("/") for (n,) in names}
    base = root.removeprefix("file://").rstrip("/")
    if not any(n.endswith(f"{base}/src/__init__.py") or n.endswith(f"{base}/src/__init__.pyi") for n in markers):
        roots = (*roots, "src")
    return x.withColumn("module", module_name(F.col("path"), roots)).select("path", "full_path", "module", "content", "read_err")


def module_name(path: Column, roots: tuple[str, ...] = ()) -> Column:
    """Dotted name of a file below the longest of ``roots`` that holds it."""
    rel = path
    for r in sorted(set(roots), key=len):
        rel = F.when(path.startswith(r.rstrip("/") + "/"), F.substring(path, len(r.rstrip("/")) + 2, _MB)).otherwise(rel)
    return F.regexp_replace(F.regexp_replace(F.regexp_replace(rel, r"\.pyi?$", ""), "/", "."), r"(^|\.)__init__$", "")


def canonical(files: DataFrame) -> DataFrame:
    """One file a module: .py before .pyi, then the least path; files without a module name go."""
    rank = F.when(F.col("path").endswith(".py"), 0).when(F.col("path").endswith(".pyi"), 1).otherwise(2)
    first = F.row_number().over(Window.partitionBy("module").orderBy(rank, "path"))
    return files.where("module <> ''").withColumn("_n", first).where("_n = 1").drop("_n")


def _struct(name: str) -> T.StructType:
    return T.StructType.fromDDL(facts.RELATIONS[name][0])


def _list_of(rows: list[list[tuple]], kind: pa.StructType) -> pa.ListArray:
    """A list for each file."""
    flat = [r for part in rows for r in part]
    cols = list(zip(*flat)) if flat else [()] * kind.num_fields
    values = [pa.array([list(v.items()) if isinstance(v, dict) else v for v in c], f.type) for c, f in zip(cols, kind)]
    ends = [0]
    for part in rows:
        ends.append(ends[-1] + len(part))
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.StructArray.from_arrays(values, fields=list(kind)))


def _parser(names: list[str]):
    kinds = {n: to_arrow_type(_struct(n)) for n in names}

    def one(path, module, content, read_err):
        if read_err is not None:
            return None, [[] for _ in names]
        try:
            source = facts.Source(path, module, content or b"")
            return None, [list(facts.RELATIONS[n][1](source)) for n in names]
        except (SyntaxError, ValueError, RecursionError, MemoryError, LookupError) as e:
            return f"{type(e).__name__}: {e}", [[] for _ in names]

    def out(files):
        head, errors, rows = zip(*((f[:2] + f[3:4], *one(*f)) for f in files))
        path, module, read_err = zip(*head)
        cols = [pa.array(v, pa.string()) for v in (path, module, read_err, errors)] + [_list_of(list(r), kinds[n]) for n, r in zip(names, zip(*rows))]
        return pa.RecordBatch.from_arrays(cols, ["path", "module", "read_err", "parse_err", *names])

    def parse(batches):
        sys.setrecursionlimit(max(sys.getrecursionlimit(), 50_000))  # deep trees are legal
        for b in batches:
            todo, size = [], 0
            for k in range(b.num_rows):
                todo.append(tuple(b.column(c)[k].as_py() for c in ("path", "module", "content", "read_err")))
                size += len(todo[-1][2] or b"")
                if size >= BATCH_BYTES:  # rows of the trees take far more than the text
                    yield out(todo)
                    todo, size = [], 0
            if todo:
                yield out(todo)

    return parse


def parsed(files: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """One row a file: path, module, read_err, parse_err and an array for each of ``names`` (default: every relation)."""
    names = list(names or facts.RELATIONS)
    fields = [T.StructField(c, T.StringType()) for c in ("path", "module", "read_err", "parse_err")] + [T.StructField(n, T.ArrayType(_struct(n))) for n in names]
    has_err = "read_err" in files.columns
    slim = files.select("path", "module", F.col("content").cast("binary").alias("content"), F.col("read_err") if has_err else F.lit(None).cast("string").alias("read_err"))
    return slim.mapInArrow(_parser(names), T.StructType(fields))


def snapshot(files: DataFrame, names: tuple[str, ...] = ()) -> DataFrame:
    """``parsed``, written once: all analyses read the same parse."""
    return stored(parsed(files, names), "snapshot")


def relation(snap: DataFrame, name: str) -> DataFrame:
    """path, module and the columns of one relation."""
    return snap.select("path", "module", F.inline(name))


def errors(snap: DataFrame) -> DataFrame:
    """path, module, error of files that yield nothing."""
    x = snap.select("path", "module", F.coalesce("read_err", "parse_err").alias("error"))
    return x.where("error is not null")


def extract(files: DataFrame, name: str) -> DataFrame:
    """One relation of files that aren't worth a snapshot."""
    return errors(parsed(files, ("lines",))) if name == "errors" else relation(parsed(files, (name,)), name)
