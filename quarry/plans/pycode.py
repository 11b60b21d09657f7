"""Queries over Python source files that are written from the tables: one file a part, by one of five templates, and one
package a region with a module for each nation that imports its strongest trade partners. What the files say is known from
the tables, so SQL can check everything that is found by parsing them."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.operators import classes as K
from quarry.operators import clones as C
from quarry.operators import code as D
from quarry.operators import injection as I
from quarry.operators import modules as M
from quarry.operators import placeholders as H
from quarry.operators import suggestions as G
from quarry.plans import graphs
from quarry.sources import python_files as P
from quarry.sources import sinks

TEMPLATES = [
    '''import os
import app.core as core


def plain@K(a, b):
    """Says nothing."""
    # adds
    c = a + b
    return c
''',
    """def branchy@K(x, y):
    if x > 0 and y > 0:
        for i in range(x):
            if i % 2:
                continue
            y += i
    elif x < 0:
        return -1
    else:
        y = 0
    while y:
        y -= 1
    return y
""",
    """def dead@K(x):
    return x
    x = 1
    print(x)


def half@K(x):
    if x:
        raise ValueError(x)
        x = 2
    else:
        return 3
    return 4
""",
    """from abc import abstractmethod
from net import HttpClient

registry = {}


class Base@K:
    @abstractmethod
    def run(self):
        pass


class Service@K(Base@K):
    _instance = None

    def __init__(self, a, b, c, d, e, f, store: SqlStore):
        self.a = a
        self.client = HttpClient(b)

    def first(self):
        return self.a

    def second(self):
        return self.first()

    def third(self):
        return self.client.get(container.resolve("x"))

    def fourth(self):
        global registry
        return registry

    @property
    def fifth(self):
        return self.client
""",
    """URL = "http://example.com/a"
password = "test_password1"


def send@K(foo):
    # TODO: replace mock data
    token = "0000"
    mail = "a@test.org"
    return [x for x in foo if x] + [URL, token, mail]
""",
]


def _t(spark: SparkSession, d: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{d}/{name}.parquet")


def part_files(spark, d) -> DataFrame:
    """path, module, content: a file for each part, in the folder of its brand."""
    # the table is small, what is made of it is not: parsing costs far more than moving the rows
    p = _t(spark, d, "part").select("p_partkey", "p_brand").repartition(2 * spark.sparkContext.defaultParallelism)
    text = F.element_at(F.array(*map(F.lit, TEMPLATES)), (F.pmod("p_partkey", F.lit(len(TEMPLATES))) + 1).cast("int"))
    path = F.concat(F.lit("src/"), F.replace("p_brand", F.lit("#"), F.lit("_")), F.lit("/m"), F.col("p_partkey").cast("string"), F.lit(".py"))
    return p.select(path.alias("path"), P.module_name(path, ("src",)).alias("module"), F.replace(text, F.lit("@K"), F.col("p_partkey").cast("string")).alias("content"))


def nation_files(spark, d) -> DataFrame:
    """Packages app.r<region> with modules n<nation>: imports of submodules, of modules, and of re-exported names; some late."""
    n = _t(spark, d, "nation").select(F.col("n_nationkey").alias("k"), F.col("n_regionkey").alias("r"))
    e = graphs.edges(spark, d).join(n.select(F.col("k").alias("dst"), F.col("r").alias("rd")), "dst")
    pkg, dst = F.concat(F.lit("app.r"), F.col("rd").cast("string")), F.col("dst").cast("string")
    line = F.when(F.col("dst") % 3 == 0, F.concat(F.lit("from "), pkg, F.lit(" import n"), dst)).when(F.col("dst") % 3 == 1, F.concat(F.lit("import "), pkg, F.lit(".n"), dst)).otherwise(F.concat(F.lit("from "), pkg, F.lit(" import thing"), dst))
    line = F.when(F.col("weight") % 2 == 0, F.concat(F.lit("def late"), dst, F.lit("():\n    "), line, F.lit("\n    return 0\n"))).otherwise(F.concat(line, F.lit("\n")))
    body = e.groupBy(F.col("src").alias("k")).agg(F.array_join(F.sort_array(F.collect_list(line)), "").alias("body"))  # three lines a nation
    own = F.concat(F.lit("import os\n"), F.coalesce("body", F.lit("")), F.lit("def thing"), F.col("k").cast("string"), F.lit("():\n    return 0\n"))
    files = n.join(body, "k", "left").select(F.format_string("app/r%d/n%d.py", "r", "k").alias("path"), own.alias("content"))
    names = F.concat(F.lit("from .n"), F.col("k").cast("string"), F.lit(" import thing"), F.col("k").cast("string"), F.lit("\n"))
    marks = n.groupBy("r").agg(F.array_join(F.sort_array(F.collect_list(names)), "").alias("content")).select(F.format_string("app/r%d/__init__.py", "r").alias("path"), "content")
    every = files.unionByName(marks).unionByName(spark.range(1).select(F.lit("app/__init__.py").alias("path"), F.lit("").alias("content")))
    return every.withColumn("module", P.module_name(F.col("path")))


def _of(spark, d, *names):
    """Relations of the parts' files from one parse; several are read from its snapshot."""
    files = part_files(spark, d)
    if len(names) == 1:
        return P.extract(files, names[0])
    snap = P.snapshot(files, names)
    return tuple(P.relation(snap, n) for n in names)


def python_functions(spark, d):
    f = D.rated(_of(spark, d, "functions"))
    return f.select("path", "function", "cyclomatic", "cognitive", "nesting", "ifs", "loops", "handlers", "sloc", "risk", F.array_join("parameters", ",").alias("parameters"))


def python_complexity_summary(spark, d):
    x = D.complexity_summary(D.rated(_of(spark, d, "functions")))
    return x.select("functions", "mean_cyclomatic", "mean_cognitive", "mean_nesting", "least", "most", "low_risk", "high_risk", *[F.col("histogram")[b].alias(n) for b, n in (("1", "h1"), ("2-5", "h2"), ("6-10", "h6"))])


def python_reported(spark, d):
    return D.reported(D.rated(_of(spark, d, "functions")), 2, False).select("path", "function", "cyclomatic")


def python_module_rollup(spark, d):
    return D.module_rollup(D.rated(_of(spark, d, "functions")))


def python_directory_rollup(spark, d):
    return D.directory_rollup(D.rated(_of(spark, d, "functions")))


def python_dead_code(spark, d):
    """Findings from unreachable blocks, merged, of severity warning or more."""
    b = _of(spark, d, "cfg_blocks")
    return D.at_least(D.dead_code(D.dead_blocks(b)), "warning").select("path", "function", "start_line", "end_line", "reason", "severity")


def python_dead_by_file(spark, d):
    b = _of(spark, d, "cfg_blocks")
    dead = D.dead_blocks(b)
    return D.dead_by_file(dead, D.with_reasons(D.dead_code(dead), ["unreachable_after_return"]))


def python_dead_summary(spark, d):
    b = _of(spark, d, "cfg_blocks")
    x = D.dead_summary(b, D.dead_code(D.dead_blocks(b)))
    return x.select("findings", F.col("by_severity")["critical"].alias("critical"), F.col("by_severity")["warning"].alias("warning"), F.col("by_reason")["unreachable_after_raise"].alias("after_raise"), "dead_blocks")


def python_reachability(spark, d):
    return D.reachability(_of(spark, d, "cfg_blocks")).where("ratio < 1").select("path", "function", "reachable", "blocks")


def python_flow_features(spark, d):
    b, e = _of(spark, d, "cfg_blocks", "cfg_edges")
    return D.flow_features(b, e).select("path", "function", "loop", "conditional", "return", "exception", "continue")


def python_raw_metrics(spark, d):
    return _of(spark, d, "module_facts").select("path", "functions", "classes", "abstract_classes", "lines", "physical", "sloc", "lloc", "comment_lines", "docstring_lines", "blank_lines", F.array_join("public_names", ",").alias("public_names"))


def python_line_totals(spark, d):
    return D.line_totals(_of(spark, d, "module_facts"))


def python_range_sloc(spark, d):
    """Source lines of each function by running sums over the lines of its file."""
    lines, f = _of(spark, d, "lines", "functions")
    return D.range_sloc(lines, f.select("path", "function", "start_line", "end_line"), ["path"]).select("path", "function", "sloc")


def python_node_statistics(spark, d):
    """Nodes of some types and the deepest place of statements, by file."""
    x = D.node_statistics(_of(spark, d, "nodes"))
    return x.where(F.col("type").isin("FunctionDef", "ClassDef", "If", "Return", "Import", "ImportFrom")).groupBy("type").agg(F.sum("n").alias("n"), F.count("*").alias("files"))


def python_docstrings(spark, d):
    return _of(spark, d, "nodes").where("is_docstring").groupBy("path").agg(F.count("*").alias("n"))


def python_cohesion(spark, d):
    c, m, u, f = _of(spark, d, "classes", "class_methods", "class_uses", "class_fields")
    x = K.cohesion(c, m, u, f)
    return x.select("path", "class", "total_methods", "excluded", "instance_variables", "lcom4", "risk", F.array_join(F.transform("groups", lambda g: F.array_join(g, "+")), " ").alias("groups"))


def python_coupling(spark, d):
    c, x = _of(spark, d, "classes", "class_deps")
    return K.class_coupling(c, x).select("path", "class", "is_abstract", "cbo", "kind_inheritance", "kind_type_hint", "kind_instantiation", "kind_attribute", "kind_import", "risk", F.array_join("dependencies", ",").alias("dependencies"))


def python_class_summary(spark, d):
    c, m, u, f = _of(spark, d, "classes", "class_methods", "class_uses", "class_fields")
    x = K.class_summary(K.cohesion(c, m, u, f), "lcom4", [1, 2, 5, 10])
    return x.select("classes", "mean", "least", "most", "low_risk", "medium_risk", F.col("histogram")["1"].alias("h1"), F.col("histogram")["3-5"].alias("h3"))


def python_injection(spark, d):
    return I.antipatterns(_of(spark, d, "injection")).select("path", "class", "method", "line", "type", "subtype", "severity", "subject")


def python_injection_summary(spark, d):
    return I.antipattern_summary(I.antipatterns(_of(spark, d, "injection"), "info"))


def python_placeholders(spark, d):
    return H.findings(_of(spark, d, "tokens")).select("path", "line", "kind", "severity")


def python_placeholder_summary(spark, d):
    return H.summary(H.selected(H.findings(_of(spark, d, "tokens")), "info", ["keyword", "domain", "placeholder"], ignore=["Brand_11"]))


def python_def_use(spark, d):
    """Definitions that reach uses, across blocks."""
    return _of(spark, d, "def_use").select("path", "function", "name", "def_line", "def_kind", "use_line", "use_kind", "cross_block")


def python_dataflow_features(spark, d):
    v, p = _of(spark, d, "variables", "def_use")
    return D.dataflow_features(v, p).where("function <> '<module>'").select("path", "function", "defs", "uses", "variables", "pairs", "cross_pairs", "longest")


def python_imports(spark, d):
    return P.extract(nation_files(spark, d), "imports").select("module", "target", "name", "level", "lazy")


def _graph(spark, d):
    files = P.canonical(nation_files(spark, d))
    snap = P.snapshot(files, ("imports", "declared", "module_facts"))
    imports, declared = P.relation(snap, "imports"), P.relation(snap, "declared")
    m = files.select("module")
    return M.edges(M.resolved(imports, m), m, M.reexports(imports, declared))


def python_module_graph(spark, d):
    return _graph(spark, d).select("src", "dst", "is_lazy", "type", "imports")


def python_resolved(spark, d):
    """Where imports lead, the standard library's too."""
    files = nation_files(spark, d)
    imports = P.extract(files, "imports")
    return M.resolved(imports, files.select("module"), standard=True).groupBy("origin", "resolved").agg(F.count("*").alias("n"))


def python_reexports(spark, d):
    x, y = (P.extract(nation_files(spark, d), n) for n in ("imports", "declared"))
    return M.reexports(x, y)


def python_dependency_matrix(spark, d):
    return M.matrix(_graph(spark, d)).select("node", F.array_join(F.map_keys("depends_on"), ",").alias("depends_on"))


def python_clone_types(spark, d):
    """Fragments of equal labels without names: groups of copies by their gram set."""
    f = C.named(C.large_enough(_of(spark, d, "fragments"), 20, 5))
    sets = f.select("id", C.grams(F.col("labels")).alias("grams"))
    _, members = C.classes(sets)
    return members.groupBy("rep").agg(F.count("*").alias("n")).groupBy("n").agg(F.count("*").alias("groups"))


def python_suggestions(spark, d):
    """Ten suggestions a category from complexity, dead code, coupling and cohesion."""
    f, b, c, m, u, x, deps = _of(spark, d, "functions", "cfg_blocks", "classes", "class_methods", "class_uses", "class_fields", "class_deps")
    every = G.gathered(G.of_complexity(f, 5, 20), G.of_dead_code(D.dead_code(D.dead_blocks(b))), G.of_cohesion(K.cohesion(c, m, u, x)), G.of_coupling(K.class_coupling(c, deps)))
    return every.groupBy("category", "severity", "effort", "priority").agg(F.count("*").alias("n"))


def python_csv_layout(spark, d):
    """The complexity report's layout."""
    return sinks.laid_out(D.rated(_of(spark, d, "functions")).where("cyclomatic > 1"), "complexity").select("Function", "Complexity", "Risk", "SLOC")


def python_histogram(spark, d):
    return sinks.binned(_of(spark, d, "functions"), "cyclomatic", 9, 19).select("bin", "n")


def python_gate(spark, d):
    return D.gate_rows(_of(spark, d, "functions"), 5, 12).groupBy("rule").agg(F.count("*").alias("n"))


def python_warnings(spark, d):
    return D.warnings(_of(spark, d, "functions"), 10, 2)


def python_canonical(spark, d):
    """A stub beside each module goes: .py comes before .pyi."""
    f = part_files(spark, d).select("path", "module")
    return P.canonical(f.unionByName(f.withColumn("path", F.concat("path", F.lit("i")))))


# -- SQL ----------------------------------------------------------------------------------------------------------

FILE = "p AS (SELECT p_partkey AS k, p_partkey % 5 AS t, 'src/' || replace(p_brand, '#', '_') || '/m' || p_partkey || '.py' AS path, replace(p_brand, '#', '_') AS brand FROM part)"
#: What each template's functions measure, by hand: name, cyclomatic, cognitive, nesting, ifs, loops, source lines, parameters.
FN = """f AS (SELECT path, k, t, replace(v.name, '@', k::VARCHAR) AS function, c AS cyclomatic, g AS cognitive, n AS nesting, i AS ifs, l AS loops, z AS sloc, a AS parameters
FROM p JOIN (VALUES (0, '<module>', 1, 0, 0, 0, 0, 5, ''), (0, 'plain@', 1, 0, 0, 0, 0, 3, 'a,b'), (1, '<module>', 1, 0, 0, 0, 0, 13, ''), (1, 'branchy@', 6, 11, 3, 3, 2, 13, 'x,y'),
 (2, '<module>', 1, 0, 0, 0, 0, 11, ''), (2, 'dead@', 1, 0, 0, 0, 0, 4, 'x'), (2, 'half@', 2, 2, 1, 1, 0, 7, 'x'), (3, '<module>', 1, 0, 0, 0, 0, 24, ''), (3, 'Base@.run', 1, 0, 0, 0, 0, 2, ''),
 (3, 'Service@.__init__', 1, 0, 0, 0, 0, 3, 'a,b,c,d,e,f,store'), (3, 'Service@.first', 1, 0, 0, 0, 0, 2, ''), (3, 'Service@.second', 1, 0, 0, 0, 0, 2, ''), (3, 'Service@.third', 1, 0, 0, 0, 0, 2, ''),
 (3, 'Service@.fourth', 1, 0, 0, 0, 0, 3, ''), (3, 'Service@.fifth', 1, 0, 0, 0, 0, 2, ''), (4, '<module>', 1, 0, 0, 0, 0, 6, ''), (4, 'send@', 1, 0, 1, 0, 0, 4, 'foo')
) AS v(vt, name, c, g, n, i, l, z, a) ON t = vt)"""
DEAD = """x AS (SELECT path, replace(name, '@', k::VARCHAR) AS function, a AS start_line, b AS end_line, 'unreachable_after_' || r AS reason, 'critical' AS severity
FROM p JOIN (VALUES (2, 'dead@', 3, 4, 'return'), (2, 'half@', 10, 10, 'raise'), (2, 'half@', 13, 13, 'return')) AS v(vt, name, a, b, r) ON t = vt)"""
RISK = "CASE WHEN cyclomatic <= 9 THEN 'low' WHEN cyclomatic <= 19 THEN 'medium' ELSE 'high' END"
MOCK = """h AS (SELECT path, line, kind, severity FROM p JOIN (VALUES (1, 'domain', 'warning'), (2, 'keyword', 'info'), (5, 'keyword', 'warning'), (6, 'placeholder', 'info'), (7, 'repetitive', 'info'), (8, 'domain', 'warning'), (9, 'keyword', 'warning')) AS v(line, kind, severity) ON t = 4)"""
DI = """j AS (SELECT path, replace(c, '@', k::VARCHAR) AS class, method, line, type, subtype, severity, subject FROM p JOIN (VALUES
 ('Service@', '__init__', 16, 'constructor_over_injection', NULL, 'warning', 'a, b, c, d, e, f, store'), ('Service@', NULL, 13, 'hidden_dependency', 'singleton', 'warning', '_instance'),
 ('Service@', 'fourth', 30, 'hidden_dependency', 'global', 'error', 'registry'), ('Service@', 'fourth', 31, 'hidden_dependency', 'module_variable', 'warning', 'registry'),
 ('Service@', '__init__', 18, 'concrete_dependency', 'instantiation', 'warning', 'HttpClient'), ('Service@', 'third', 27, 'service_locator', NULL, 'warning', 'resolve'),
 ('Service@', '__init__', 16, 'concrete_dependency', 'type_hint', 'info', 'SqlStore')) AS v(c, method, line, type, subtype, severity, subject) ON t = 3)"""
LINES = """l AS (SELECT path, t, v.* EXCLUDE (vt) FROM p JOIN (VALUES (0, 1, 0, 0, 10, 9, 5, 5, 1, 1, 2, 'plain@'), (1, 1, 0, 0, 14, 13, 13, 12, 0, 0, 0, 'branchy@'), (2, 2, 0, 0, 14, 13, 11, 10, 0, 0, 2, 'dead@,half@'), (3, 7, 2, 1, 36, 35, 24, 22, 0, 0, 11, 'Base@,Service@,fifth,first,fourth,run,second,third'), (4, 1, 0, 0, 10, 9, 6, 6, 1, 0, 2, 'send@')) AS v(vt, functions, classes, abstract_classes, lines, physical, sloc, lloc, comment_lines, docstring_lines, blank_lines, names) ON t = vt)"""
COH = "k AS (SELECT path, replace(c, '@', k::VARCHAR) AS class, tm AS total_methods, ex AS excluded, iv AS instance_variables, l4 AS lcom4, r AS risk, g AS groups FROM p JOIN (VALUES ('Base@', 1, 1, 0, 1, 'low', ''), ('Service@', 6, 1, 3, 3, 'medium', 'fifth+third first+second fourth')) AS v(c, tm, ex, iv, l4, r, g) ON t = 3)"
#: Definitions that reach uses in each template, by hand: function, name, line and kind of both, whether across blocks.
DU = """d AS (SELECT * FROM (VALUES (0, 'plain@', 'a', 5, 'param', 8, 'load', true), (0, 'plain@', 'b', 5, 'param', 8, 'load', true), (0, 'plain@', 'c', 8, 'assign', 9, 'load', false),
 (1, 'branchy@', 'x', 1, 'param', 2, 'load', true), (1, 'branchy@', 'x', 1, 'param', 3, 'load', true), (1, 'branchy@', 'x', 1, 'param', 7, 'load', true), (1, 'branchy@', 'y', 1, 'param', 2, 'load', true),
 (1, 'branchy@', 'y', 1, 'param', 6, 'load', true), (1, 'branchy@', 'y', 1, 'param', 11, 'load', true), (1, 'branchy@', 'y', 1, 'param', 12, 'load', true), (1, 'branchy@', 'y', 1, 'param', 13, 'load', true),
 (1, 'branchy@', 'i', 3, 'for', 4, 'load', true), (1, 'branchy@', 'i', 3, 'for', 6, 'load', true), (1, 'branchy@', 'y', 6, 'augassign', 6, 'load', false), (1, 'branchy@', 'y', 6, 'augassign', 11, 'load', true),
 (1, 'branchy@', 'y', 6, 'augassign', 12, 'load', true), (1, 'branchy@', 'y', 6, 'augassign', 13, 'load', true), (1, 'branchy@', 'y', 10, 'assign', 11, 'load', true), (1, 'branchy@', 'y', 10, 'assign', 12, 'load', true),
 (1, 'branchy@', 'y', 10, 'assign', 13, 'load', true), (1, 'branchy@', 'y', 12, 'augassign', 11, 'load', true), (1, 'branchy@', 'y', 12, 'augassign', 12, 'load', false), (1, 'branchy@', 'y', 12, 'augassign', 13, 'load', true),
 (2, 'dead@', 'x', 1, 'param', 2, 'load', true), (2, 'dead@', 'x', 3, 'assign', 4, 'load', false), (2, 'half@', 'x', 7, 'param', 8, 'load', true), (2, 'half@', 'x', 7, 'param', 9, 'load', true),
 (3, '<module>', 'Base@', 7, 'assign', 13, 'load', false), (3, 'Service@.__init__', 'self', 16, 'param', 17, 'attribute', true), (3, 'Service@.__init__', 'self', 16, 'param', 18, 'attribute', true),
 (3, 'Service@.__init__', 'a', 16, 'param', 17, 'load', true), (3, 'Service@.__init__', 'b', 16, 'param', 18, 'load', true), (3, 'Service@.first', 'self', 20, 'param', 21, 'attribute', true),
 (3, 'Service@.second', 'self', 23, 'param', 24, 'attribute', true), (3, 'Service@.third', 'self', 26, 'param', 27, 'attribute', true), (3, 'Service@.fifth', 'self', 34, 'param', 35, 'attribute', true),
 (4, 'send@', 'foo', 5, 'param', 9, 'load', true), (4, 'send@', 'token', 7, 'assign', 9, 'load', false), (4, 'send@', 'mail', 8, 'assign', 9, 'load', false)) AS v(vt, f, name, a, dk, b, uk, x)),
u AS (SELECT * FROM p JOIN d ON t = vt)"""
W = "WITH " + FILE + ", "
E = graphs.E + ", m AS (SELECT n_nationkey AS k, 'app.r' || n_regionkey || '.n' || n_nationkey AS name, n_regionkey AS r FROM nation) "

QUERIES = {
    "python_functions": (python_functions, W + FN + f" SELECT path, function, cyclomatic, cognitive, nesting, ifs, loops, 0 AS handlers, sloc, {RISK} AS risk, parameters FROM f"),
    "python_complexity_summary": (python_complexity_summary, W + FN + " SELECT count(*) AS functions, avg(cyclomatic) AS mean_cyclomatic, avg(cognitive) AS mean_cognitive, avg(nesting) AS mean_nesting, min(cyclomatic) AS least, max(cyclomatic) AS most, count(*) FILTER (WHERE cyclomatic <= 9) AS low_risk, 0 AS high_risk, count(*) FILTER (WHERE cyclomatic = 1) AS h1, count(*) FILTER (WHERE cyclomatic BETWEEN 2 AND 5) AS h2, count(*) FILTER (WHERE cyclomatic BETWEEN 6 AND 10) AS h6 FROM f"),
    "python_reported": (python_reported, W + FN + " SELECT path, function, cyclomatic FROM f WHERE cyclomatic > 1"),
    "python_module_rollup": (python_module_rollup, W + FN + " SELECT path, count(*) FILTER (WHERE function <> '<module>') AS functions, avg(cyclomatic) FILTER (WHERE function <> '<module>') AS mean_cyclomatic, avg(cognitive) FILTER (WHERE function <> '<module>') AS mean_cognitive, max(cyclomatic) FILTER (WHERE function <> '<module>') AS most, 0 AS high_risk, 0 AS handlers FROM f GROUP BY 1"),
    "python_directory_rollup": (python_directory_rollup, W + FN + " SELECT regexp_replace(path, '/[^/]*$', '') AS directory, count(*) AS functions, avg(cyclomatic) AS mean_cyclomatic, max(cyclomatic) AS most, 0 AS high_risk, avg(nesting) AS mean_nesting, max(nesting) AS most_nesting FROM f GROUP BY 1"),
    "python_dead_code": (python_dead_code, W + DEAD + " SELECT * FROM x"),
    "python_dead_by_file": (python_dead_by_file, W + DEAD + " SELECT path, count(*) FILTER (WHERE reason = 'unreachable_after_return') AS findings, 3 AS dead_blocks FROM x GROUP BY 1"),
    "python_dead_summary": (python_dead_summary, W + DEAD + " SELECT count(*) AS findings, count(*) AS critical, 0 AS warning, count(*) FILTER (WHERE reason = 'unreachable_after_raise') AS after_raise, count(*) AS dead_blocks FROM x"),
    "python_reachability": (python_reachability, W + "v AS (SELECT * FROM (VALUES ('dead@', 3, 4), ('half@', 5, 7)) AS v(name, reachable, blocks)) SELECT path, replace(name, '@', k::VARCHAR) AS function, reachable, blocks FROM p, v WHERE t = 2"),
    "python_flow_features": (python_flow_features, W + FN + ", v AS (SELECT * FROM (VALUES ('plain', 0, 0, 1, 0, 0), ('branchy', 2, 10, 2, 0, 1), ('dead', 0, 0, 1, 0, 0), ('half', 0, 2, 2, 1, 0), ('first', 0, 0, 1, 0, 0), ('second', 0, 0, 1, 0, 0), ('third', 0, 0, 1, 0, 0), ('fourth', 0, 0, 1, 0, 0), ('fifth', 0, 0, 1, 0, 0), ('send', 0, 0, 1, 0, 0), ('run', 0, 0, 0, 0, 0), ('__init__', 0, 0, 0, 0, 0), ('<module>', 0, 0, 0, 0, 0)) AS v(name, loop, conditional, \"return\", exception, \"continue\")) SELECT path, function, loop, conditional, \"return\", exception, \"continue\" FROM f JOIN v ON regexp_replace(regexp_replace(function, '^.*\\.', ''), '[0-9]+$', '') = v.name"),
    "python_raw_metrics": (python_raw_metrics, W.replace("p_partkey AS k,", "p_partkey AS k,") + LINES.replace("SELECT path, t, v.*", "SELECT path, t, k, v.*") + " SELECT path, functions, classes, abstract_classes, lines, physical, sloc, lloc, comment_lines, docstring_lines, blank_lines, replace(names, '@', k::VARCHAR) AS public_names FROM l"),
    "python_line_totals": (python_line_totals, W + LINES + " SELECT count(*) AS files, sum(physical)::BIGINT AS physical, sum(sloc)::BIGINT AS sloc, sum(lloc)::BIGINT AS lloc, sum(comment_lines)::BIGINT AS comment_lines, sum(docstring_lines)::BIGINT AS docstring_lines, sum(blank_lines)::BIGINT AS blank_lines, (sum(comment_lines) / (sum(sloc) + sum(comment_lines)))::DOUBLE AS comment_ratio FROM l"),
    "python_range_sloc": (python_range_sloc, W + FN + " SELECT path, function, sloc FROM f"),
    "python_node_statistics": (python_node_statistics, W + "v AS (SELECT * FROM (VALUES (0, 'FunctionDef', 1), (0, 'Return', 1), (0, 'Import', 2), (1, 'FunctionDef', 1), (1, 'If', 3), (1, 'Return', 2), (2, 'FunctionDef', 2), (2, 'If', 1), (2, 'Return', 3), (3, 'FunctionDef', 7), (3, 'ClassDef', 2), (3, 'ImportFrom', 2), (3, 'Return', 5), (4, 'FunctionDef', 1), (4, 'Return', 1)) AS v(vt, type, n)) SELECT type, sum(n)::BIGINT AS n, count(*) AS files FROM p JOIN v ON t = vt GROUP BY 1"),
    "python_docstrings": (python_docstrings, W[:-2] + " SELECT path, 1 AS n FROM p WHERE t = 0"),
    "python_cohesion": (python_cohesion, W + COH + " SELECT path, class, total_methods, excluded, instance_variables, lcom4, risk, groups FROM k"),
    "python_coupling": (python_coupling, W[:-2] + " SELECT path, replace(c, '@', k::VARCHAR) AS class, ab AS is_abstract, cbo, 0 AS kind_inheritance, th AS kind_type_hint, 0 AS kind_instantiation, 0 AS kind_attribute, im AS kind_import, 'low' AS risk, dep AS dependencies FROM p JOIN (VALUES ('Base@', true, 0, 0, 0, ''), ('Service@', false, 2, 1, 1, 'HttpClient,SqlStore')) AS v(c, ab, cbo, th, im, dep) ON t = 3"),
    "python_class_summary": (python_class_summary, W + COH + " SELECT count(*) AS classes, avg(lcom4) AS mean, min(lcom4) AS least, max(lcom4) AS most, count(*) FILTER (WHERE lcom4 <= 2) AS low_risk, count(*) FILTER (WHERE lcom4 > 2) AS medium_risk, count(*) FILTER (WHERE lcom4 = 1) AS h1, count(*) FILTER (WHERE lcom4 > 2) AS h3 FROM k"),
    "python_injection": (python_injection, W + DI + " SELECT path, class, method, line, type, subtype, severity, subject FROM j WHERE severity <> 'info'"),
    "python_injection_summary": (python_injection_summary, W + DI + " SELECT type, count(*) FILTER (WHERE severity = 'error') AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(DISTINCT class) AS classes FROM j GROUP BY 1"),
    "python_placeholders": (python_placeholders, W + MOCK + " SELECT path, line, kind, severity FROM h"),
    "python_placeholder_summary": (python_placeholder_summary, W + MOCK + " SELECT kind, count(*) AS n, 0 AS errors, count(*) FILTER (WHERE severity = 'warning') AS warnings, count(*) FILTER (WHERE severity = 'info') AS infos, count(DISTINCT path) AS files FROM h WHERE kind IN ('keyword', 'domain', 'placeholder') AND NOT contains(path, 'Brand_11') GROUP BY 1"),
    "python_def_use": (python_def_use, W + DU + " SELECT path, replace(f, '@', k::VARCHAR) AS function, replace(name, '@', k::VARCHAR) AS name, a AS def_line, dk AS def_kind, b AS use_line, uk AS use_kind, x AS cross_block FROM u"),
    "python_dataflow_features": (python_dataflow_features, W + DU + ", w AS (SELECT * FROM (VALUES (0, 'plain@', 3, 3, 3), (1, 'branchy@', 6, 11, 4), (2, 'dead@', 2, 3, 2), (2, 'half@', 2, 3, 2), (3, 'Base@.run', 1, 0, 1), (3, 'Service@.__init__', 8, 5, 9), (3, 'Service@.first', 1, 1, 1), (3, 'Service@.second', 1, 1, 1), (3, 'Service@.third', 1, 2, 2), (3, 'Service@.fourth', 1, 1, 2), (3, 'Service@.fifth', 1, 1, 1), (4, 'send@', 3, 6, 5)) AS v(t, f, defs, uses, variables)), c AS (SELECT vt, f, sum(n)::BIGINT AS pairs, sum(m)::BIGINT AS cross_pairs, max(n) AS longest FROM (SELECT vt, f, name, count(*) AS n, count(*) FILTER (WHERE x) AS m FROM d GROUP BY 1, 2, 3) GROUP BY 1, 2) SELECT path, replace(w.f, '@', k::VARCHAR) AS function, defs, uses, variables, coalesce(pairs, 0) AS pairs, coalesce(cross_pairs, 0) AS cross_pairs, coalesce(longest, 0) AS longest FROM p JOIN w ON p.t = w.t LEFT JOIN c ON c.vt = w.t AND c.f = w.f"),
    "python_imports": (python_imports, E + "SELECT name AS module, 'os' AS target, NULL AS name, 0 AS level, false AS lazy FROM m UNION ALL SELECT 'app.r' || r, 'n' || k, 'thing' || k, 1, false FROM m UNION ALL SELECT a.name, CASE WHEN dst % 3 = 1 THEN b.name ELSE 'app.r' || b.r END, CASE dst % 3 WHEN 0 THEN 'n' || dst WHEN 2 THEN 'thing' || dst END, 0, weight % 2 = 0 FROM e JOIN m AS a ON src = a.k JOIN m AS b ON dst = b.k"),
    "python_module_graph": (python_module_graph, E + "SELECT a.name AS src, b.name AS dst, weight % 2 = 0 AS is_lazy, CASE WHEN dst % 3 = 1 THEN 'import' ELSE 'from_import' END AS type, 1 AS imports FROM e JOIN m AS a ON src = a.k JOIN m AS b ON dst = b.k"),
    "python_resolved": (python_resolved, E + "SELECT origin, resolved, count(*) AS n FROM (SELECT 'standard' AS origin, 'os' AS resolved FROM m UNION ALL SELECT 'project', CASE WHEN dst % 3 = 1 THEN b.name ELSE 'app.r' || b.r END FROM e JOIN m AS b ON dst = b.k UNION ALL SELECT 'project', name FROM m) GROUP BY 1, 2"),
    "python_reexports": (python_reexports, E + "SELECT 'app.r' || r AS package, 'thing' || k AS name, name AS source_module FROM m"),
    "python_dependency_matrix": (python_dependency_matrix, E + "SELECT a.name AS node, string_agg(b.name, ',' ORDER BY b.name) AS depends_on FROM e JOIN m AS a ON src = a.k JOIN m AS b ON dst = b.k GROUP BY 1"),
    "python_clone_types": (python_clone_types, W[:-2] + " SELECT n, sum(g)::BIGINT AS groups FROM (SELECT t, count(*) AS n FROM p GROUP BY 1) JOIN (VALUES (1, 2), (3, 1), (4, 1)) AS v(vt, g) ON t = vt GROUP BY 1"),
    "python_suggestions": (python_suggestions, W[:-2] + " SELECT category, severity, effort, priority, least(10, count(*)) AS n FROM p JOIN (VALUES (1, 'complexity', 'warning', 'moderate', 3), (2, 'dead_code', 'critical', 'easy', 0), (3, 'cohesion', 'warning', 'moderate', 3)) AS v(vt, category, severity, effort, priority) ON t = vt GROUP BY 1, 2, 3, 4"),
    "python_csv_layout": (python_csv_layout, W + FN + f" SELECT function AS \"Function\", cyclomatic AS \"Complexity\", {RISK} AS \"Risk\", sloc AS \"SLOC\" FROM f WHERE cyclomatic > 1"),
    "python_histogram": (python_histogram, W + FN + " SELECT bin, count(cyclomatic) AS n FROM (VALUES ('1', 1, 1), ('2-5', 2, 5), ('6-9', 6, 9), ('10-19', 10, 19), ('20+', 20, 1000)) AS v(bin, a, b) LEFT JOIN f ON cyclomatic BETWEEN a AND b GROUP BY 1"),
    "python_gate": (python_gate, W + FN + " SELECT rule, count(*) AS n FROM (SELECT 'complexity' AS rule FROM f WHERE cyclomatic > 5 UNION ALL SELECT 'length' FROM f WHERE sloc > 12) GROUP BY 1"),
    "python_warnings": (python_warnings, W + FN + " SELECT path, function, function || ': cognitive complexity ' || cognitive || ' exceeds threshold 10' AS message FROM f WHERE cognitive > 10 UNION ALL SELECT path, function, function || ': nesting depth ' || nesting || ' exceeds threshold 2' FROM f WHERE nesting > 2"),
    "python_canonical": (python_canonical, W[:-2] + " SELECT path, brand || '.m' || k AS module FROM p"),
}
