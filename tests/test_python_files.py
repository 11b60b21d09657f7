import ast

import pytest
from pyspark.sql import functions as F

from quarry.functions import scalar as S
from quarry.operators import classes as K
from quarry.operators import code as D
from quarry.operators import injection as I
from quarry.operators import modules as M
from quarry.operators import placeholders as H
from quarry.sources import control_flow as C
from quarry.sources import facts as A
from quarry.sources import python_files as P

CODE = """
import os
from .a import b as c
def f(x, y):
    if x and y:
        for i in y:
            if i:
                return 1
    elif x:
        return 2
    else:
        raise ValueError
    return 3
class K(Base):
    def __init__(self, n: int):
        self.n = n
        self.m = Other()
    def g(self):
        import json
        return self.n
        print(1)
"""


def source(code):
    return A.Source("x.py", "x", code.encode())


def measured(code):
    return {r[0]: (r[7], r[8], r[9]) for r in A.functions(source(code))}


def test_functions():
    got = measured(CODE)
    # f: if, for, if, elif are decisions; if 1 + and 1 + for 2 + if 3 + elif 1 + else 1
    assert got["f"] == (5, 9, 3) and got["K.g"] == (1, 0, 0) and got["<module>"] == (1, 0, 0)


@pytest.mark.parametrize("body,want", [
    ("pass", (1, 0, 0)), ("if a:\n  pass\nelse:\n  pass", (2, 2, 1)), ("while a:\n  if b:\n    break\nelse:\n  pass", (3, 5, 2)),
    ("try:\n  pass\nexcept A:\n  pass\nexcept B:\n  pass\nelse:\n  pass\nfinally:\n  pass", (3, 3, 2)), ("with a:\n  for x in y:\n    continue", (2, 3, 2)),
    ("match a:\n  case 1:\n    pass\n  case _:\n    pass", (3, 1, 2)), ("return a and b and c or d", (1, 2, 0)), ("x = a if b else c", (1, 1, 0)), ("x = [i for i in y if i]", (3, 0, 1)),
    ("def g():\n  if a:\n    pass", (1, 0, 0)), ("x = lambda: (1 if a else 2)", (1, 2, 1)), ("for x in y:\n  for z in x:\n    while z:\n      pass", (4, 6, 3)),
])
def test_measures(body, want):
    code = "def f():\n" + "\n".join("    " + line for line in body.split("\n"))
    assert measured(code)["f"] == want


def dead(code):
    fn = ast.parse(code).body[0]
    return sorted((b[4], b[5]) for b in C.blocks(C.Flow(fn)) if not b[9] and b[6])


def test_what_leaves_a_try_goes_through_finally():
    code = "def f():\n  for x in y:\n    try:\n      return 1\n    finally:\n      g()\n    h()\n  return 2"
    flow = C.Flow(ast.parse(code).body[0])
    name = {i: label for i, label in enumerate(flow.labels)}
    edges = {(name[a], name[b], k) for a, b, k in flow.edges}
    assert ("try", "finally", "return") in edges and ("finally", "exit", "return") in edges and ("try", "exit", "return") not in edges
    assert dead(code) == [(7, 7)]
    loop = "def f():\n  while a:\n    try:\n      break\n    finally:\n      g()\n  return 2"
    flow = C.Flow(ast.parse(loop).body[0])
    name = {i: label for i, label in enumerate(flow.labels)}
    assert {("try", "finally", "break"), ("finally", "loop_exit", "break")} <= {(name[a], name[b], k) for a, b, k in flow.edges} and dead(loop) == []
    nested = "def f():\n  try:\n    try:\n      raise A\n    finally:\n      g()\n  except A:\n    return 1\n  return 2"
    flow = C.Flow(ast.parse(nested).body[0])
    name = {i: label for i, label in enumerate(flow.labels)}
    assert ("finally", "except", "exception") in {(name[a], name[b], k) for a, b, k in flow.edges} and dead(nested) == [(9, 9)]


def test_deep_trees_are_whole():
    s = source("x = " + " + ".join(["1"] * 1500) + "\n")
    assert len(list(A.nodes(s))) == 3002 and len(list(A.fragments(s))) == 0
    deep = source("def f():\n" + "".join("  " * (k + 1) + "if a:\n" for k in range(60)) + "  " * 61 + "pass\n")
    assert next(r for r in A.functions(deep) if r[0] == "f")[7:10] == (61, 60 * 61 // 2, 60)


def test_lines():
    text = '"""Doc\nmore"""\n\n# c\nx = """a\n# no comment\n"""\ndef f():\n    \'\'\'one\'\'\'\n    return 1  # c\n'
    assert A.line_kinds(text) == ["docstring", "docstring", "blank", "comment", "code", "code", "code", "code", "docstring", "code"]
    assert A.line_kinds("") == [] and A.line_kinds("\n") == ["blank"] and A.line_kinds("a\r\nb") == ["code", "code"]


def test_imports():
    code = "import a.b as c, d\nif TYPE_CHECKING and x:\n    from e import f\nelse:\n    import g\ndef h():\n    from ..i import *\n"
    got = [r for r in A.imports(source(code))]
    assert got == [(1, "a.b", None, "c", 0, False, False), (1, "d", None, None, 0, False, False), (3, "e", "f", None, 0, False, True), (5, "g", None, None, 0, False, False), (7, "i", "*", None, 2, True, False)]


def test_tokens_and_strings():
    code = "x = f'a {b} c'  # hello\ny = " + '"' * 3 + "z" + '"' * 3 + "\nw = r'q'\n"
    got = [(r[1], r[3]) for r in A.tokens(source(code)) if r[1] != "identifier"]
    assert got == [("string", "a {b} c"), ("comment", "# hello"), ("assignment", "z"), ("string", "z"), ("assignment", "r'q'"), ("string", "r'q'")]


def test_relations(spark, tmp_path):
    (tmp_path / "pkg" / ".hidden").mkdir(parents=True)
    (tmp_path / "pkg" / "Build").mkdir()
    (tmp_path / "pkg" / "tests").mkdir()
    (tmp_path / "src" / "lib").mkdir(parents=True)
    (tmp_path / "pkg" / "__init__.py").write_text(CODE)
    (tmp_path / "pkg" / "bad.py").write_text("def (:\n")
    (tmp_path / "pkg" / "latin.py").write_bytes(b"# -*- coding: latin-1 -*-\nx = '\xe9'\n")
    (tmp_path / "pkg" / ".hidden" / "x.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "Build" / "x.py").write_text("x = 1\n")
    (tmp_path / "pkg" / "tests" / "test_a.py").write_text("x = 1\n")
    (tmp_path / "src" / "lib" / "__init__.pyi").write_text("x: int\n")
    (tmp_path / "src" / "lib" / "m.py").write_text("")
    files = P.scan(spark, f"file://{tmp_path}")
    assert sorted((r.path, r.module) for r in files.collect()) == [("pkg/__init__.py", "pkg"), ("pkg/bad.py", "pkg.bad"), ("pkg/latin.py", "pkg.latin"), ("pkg/tests/test_a.py", "pkg.tests.test_a"), ("src/lib/__init__.pyi", "lib"), ("src/lib/m.py", "lib.m")]
    assert sorted(r.path for r in P.scan(spark, f"file://{tmp_path}", P.SOURCES, P.EXCLUDED).collect()) == ["pkg/__init__.py", "pkg/bad.py", "pkg/latin.py", "src/lib/m.py"]
    snap = P.snapshot(files)
    assert [r.path for r in P.errors(snap).collect()] == ["pkg/bad.py"]
    assert P.relation(snap, "functions").where("function <> '<module>'").count() == 3
    facts = {(r["class"], r.kind, r.name) for r in P.relation(snap, "class_uses").collect()}
    assert {("K", "variable", "n"), ("K", "variable", "m")} <= facts
    n = P.relation(snap, "nodes").where("id = 0 and path = 'pkg/__init__.py'").first()
    assert n.type == "Module" and n.size > 40
    gone = files.limit(1).withColumn("read_err", F.lit("gone")).withColumn("content", F.lit(None).cast("binary"))
    assert [r.error for r in P.errors(P.parsed(gone)).collect()] == ["gone"]
    assert P.relation(P.parsed(files.limit(0)), "functions").count() == 0


def project(spark, files):
    df = spark.createDataFrame([(p, c.encode()) for p, c in files.items()], "path string, content binary")
    return df.withColumn("module", P.module_name(F.col("path")))


def test_module_graph(spark):
    files = project(spark, {
        "a/__init__.py": "from .x import X as Y, Z\nfrom . import late\nfrom a.deep import D\n__all__ = ['Y', 'late', 'D']\n", "a/x.py": "import os, json.tool\nfrom a import Y, Z, late, D, nothing\n", "a/late.py": "from ..b import q\nfrom .x import *\n",
        "a/deep/__init__.py": "", "b.py": "import a.x\nimport x\nimport requests\ndef f():\n    import a.late\n    from a import late\n", "a/y.py": "import x\nimport deep\n",
    })
    imports, declared, m = P.extract(files, "imports"), P.extract(files, "declared"), files.select("module")
    ex = M.reexports(imports, declared)
    assert {tuple(r) for r in ex.collect()} == {("a", "Y", "a.x"), ("a", "late", "a.late"), ("a", "D", "a.deep")}
    got = {(r.src, r.dst): (r.is_lazy, r.type) for r in M.edges(M.resolved(imports, m), m, ex).collect()}
    assert got == {
        ("a.x", "a"): (False, "from_import"), ("a.x", "a.late"): (False, "from_import"), ("a.x", "a.deep"): (False, "from_import"), ("a.late", "a.x"): (False, "relative"), ("a.late", "b"): (False, "relative"),
        ("b", "a.x"): (False, "import"), ("b", "a.late"): (True, "import"), ("a.y", "a.x"): (False, "import"), ("a.y", "a.deep"): (False, "import"),
    }
    origin = {(r.target, r.origin, r.resolved) for r in M.resolved(imports, m, True, True).collect()}
    assert {("os", "standard", "os"), ("json.tool", "standard", "json.tool"), ("requests", "third_party", "requests")} <= origin
    assert {(r.node, tuple(sorted(r.depends_on))) for r in M.matrix(M.load_time(M.edges(M.resolved(imports, m), m, ex))).collect()} == {("a.x", ("a", "a.deep", "a.late")), ("a.late", ("a.x", "b")), ("b", ("a.x",)), ("a.y", ("a.deep", "a.x"))}


def test_cohesion_of_classes(spark):
    code = """
import ctypes
class P(ctypes.Structure):
    _fields_ = [("x", int), ("y", int)]
    def area(self):
        return self.x * self.y
    def copy(self):
        return clone(self)
    def other(self):
        return 1
class Q:
    def __init__(self):
        self.a = self.b = 0
    @staticmethod
    def s():
        pass
    @property
    def p(self):
        return self.a
    def get_name(self):
        return self.p
    def get_nations(self):
        return self.b
    def call(self):
        self.get_nations()
class Empty:
    z = 1
"""
    files = project(spark, {"m.py": code})
    got = {r["class"]: r for r in K.cohesion(*[P.extract(files, n) for n in ("classes", "class_methods", "class_uses", "class_fields")]).collect()}
    assert (got["P"].lcom4, got["P"].groups, got["P"].instance_variables) == (2, [["area", "copy"], ["other"]], 2)
    assert (got["Q"].lcom4, got["Q"].groups, got["Q"].total_methods, got["Q"].excluded) == (2, [["call", "get_nations"], ["get_name", "p"]], 6, 2)
    assert (got["Empty"].lcom4, got["Empty"].total_methods) == (1, 0)


def test_long_names_stay_apart(spark):
    rows = [("CustomerAccountA", "get_name", "x"), ("CustomerAccountA", "get_nations", "y"), ("CustomerAccountB", "get_name", "x"), ("CustomerAccountB", "get_nations", "x"), ("a:1", "b", "v"), ("a", "1:b", "v")]
    x = spark.createDataFrame(rows, "class string, method string, variable string")
    assert {r["class"]: r.lcom4 for r in K.lcom4(x, x).collect()} == {"CustomerAccountA": 2, "CustomerAccountB": 1, "a:1": 1, "a": 1}


def test_coupling_of_classes(spark):
    code = "from datetime import datetime\nimport net as n\nclass A: pass\nclass B(A, n.Base):\n    x: Thing[Other, int]\n    def f(self, p: 'Str') -> Back | None:\n        y = datetime.now()\n        z = n.Client.open()\n        return n.CONSTANT, len(z)\n"
    files = project(spark, {"m.py": code, "test_x.py": code})
    got = {r["class"]: r for r in K.class_coupling(P.extract(files, "classes"), P.extract(files, "class_deps")).where("path = 'm.py'").collect()}
    assert got["A"].cbo == 0 and got["B"].dependencies == ["Back", "Other", "datetime", "n.Base", "n.Client"] and (got["B"].kind_import, got["B"].kind_type_hint) == (3, 2)


def test_injection(spark):
    code = "state = 1\nLIMIT = 2\nclass S:\n    def __init__(self, a: IThing, b: Optional[RealThing], c: int):\n        self.x = RealThing()\n        self.y = dict()\n        self.z = AbstractThing()\n    def f(self, state):\n        return state, LIMIT, self.registry.resolve(1), thing.resolve(2), get_service()\n    def g(self):\n        return state\n"
    got = {(r.type, r.subtype, r.method, r.subject, r.severity) for r in I.antipatterns(P.extract(project(spark, {"m.py": code}), "injection"), "info").collect()}
    assert got == {
        ("concrete_dependency", "type_hint", "__init__", "RealThing", "info"), ("concrete_dependency", "instantiation", "__init__", "RealThing", "warning"), ("hidden_dependency", "module_variable", "g", "state", "warning"),
        ("service_locator", None, "f", "resolve", "warning"), ("service_locator", None, "f", "get_service", "warning"),
    }


def test_placeholder_rules(spark):
    cases = {
        "my test here": "keyword", "latest": None, "user@Example.com": "domain", "a.b@gmail.com": None, "call 123-456-7890 now": "phone", "(000) 000-0000": "phone", "00000000-0000-0000-0000-000000000000": "uuid",
        "3f2504e0-4f89-41d3-9a0c-0305e82c3301": None, "12345678-1234-5678-1234-567812345678": "uuid", "aaaa": "repetitive", "abab": "repetitive", "aba": None, "Password1": "credential", "secret123": "credential", "passwords": None, "invalid token": "domain",
    }
    df = spark.createDataFrame(list(cases.items()), "text string, want string")
    assert {r.text: r.kind for r in df.select("text", H.worst(H.of_string(F.col("text")))["kind"].alias("kind")).collect()} == cases
    notes = spark.createDataFrame([("# TODO: replace this",), ("# TODO later",), ("# note: temporary",)], "t string")
    assert [r[0] for r in notes.select(S.mock_comment(F.col("t"))).collect()] == [True, False, True]


def test_empty_inputs(spark):
    files = project(spark, {"a.py": ""}).limit(0)
    b = P.extract(files, "cfg_blocks")
    assert D.dead_code(D.dead_blocks(b)).count() == 0 and D.dead_summary(b, D.dead_code(D.dead_blocks(b))).first().blocks == 0
    assert D.complexity_summary(D.rated(P.extract(files, "functions"))).first().functions == 0
