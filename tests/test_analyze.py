import pytest
from pyspark.sql import functions as F

from quarry import analyze as A
from quarry.config import Config
from quarry.operators import clones as C
from quarry.plans import pycode


@pytest.fixture(scope="module")
def files(spark):
    sf = "/root/testdata/sf0.001"
    return pycode.part_files(spark, sf).unionByName(pycode.nation_files(spark, sf)).unionByName(spark.range(1).select(F.lit("app/bad.py").alias("path"), F.lit("app.bad").alias("module"), F.lit("def (").alias("content")))


def test_everything(spark, files):
    a = A.analyze(spark, files, Config(clone_min_lines=5))
    s = a.summary.first()
    assert (s.total_files, s.skipped_files, s.dead_critical, s.dead_warning) == (232, 1, 120, 0) and s.lcom_classes == 80 and s.medium_lcom == 40
    assert s.parse_penalty == 11 and s.score == max(0, 100 - sum(s[c] for c in a.summary.columns if c.endswith("_penalty"))) and s.grade in "ABCDF"
    assert a.reports["clones"].count() >= 4 * 39 and set(r.type for r in a.reports["clones"].select("type").distinct().collect()) <= {1, 2, 4}
    got = {r.category for r in a.suggestions.select("category").distinct().collect()}
    assert {"dead_code", "clone", "cohesion"} <= got
    issues = {r.rule: r.issues for r in A.check(a).collect()}
    assert issues["dead_code"] == 120 and issues["complexity"] == 0 and issues["injection"] == 240 and issues["mock_data"] == 160


def test_some(spark, files):
    a = A.analyze(spark, files, select=("complexity", "dead_code"))
    assert "clones" not in a.reports and a.summary.first().duplication_penalty == 0
    none = A.analyze(spark, files.limit(0), select=("complexity", "dead_code", "cbo", "lcom", "mock_data", "injection")).summary.first()
    assert (none.total_files, none.score, none.grade) == (0, 100, "A")


def test_two_pieces(spark):
    one = "def f(a):\n    for x in a:\n        if x:\n            print(x)\n    return a\n"
    same = C.of_two(spark, one, one.replace("# no", "")).first()
    assert same.type == 1 and same.structural == 1
    renamed = C.of_two(spark, one, one.replace("x", "item").replace("print", "show").replace("f(", "walk_over_all(")).first()
    assert renamed.syntactic == 1 and renamed.type in (1, 2)
    other = C.of_two(spark, one, "def g():\n    return 1\n").first()
    assert other.type is None
