"""Sinks, configuration and shaping of reports."""

import json

import pytest
from pyspark.sql import functions as F

from quarry import config
from quarry.operators import communities as N
from quarry.operators import layers as L
from quarry.operators import scoring as Q
from quarry.sources import sinks


def test_config_layers(tmp_path):
    (tmp_path / ".git").mkdir()
    (tmp_path / "a" / "b").mkdir(parents=True)
    (tmp_path / "pyproject.toml").write_text("[tool.quarry]\nmax_complexity = 15\n[tool.quarry.clone]\nthreshold = 0.8\ntypes = [1, 2]\n[tool.quarry.layers]\nweb = ['api']\n")
    c = config.load(folder=str(tmp_path / "a" / "b"), strict=True, min_complexity=0)
    assert (c.max_complexity, c.clone_threshold, c.clone_types, c.layers, c.strict, c.min_complexity) == (15, 0.8, (1, 2), {"web": ["api"]}, True, 1)
    (tmp_path / "a" / "quarry.toml").write_text("max_complexity = 7\nunknown = 3\n")
    assert config.load(folder=str(tmp_path / "a" / "b")).max_complexity == 7
    assert config.load(str(tmp_path / "pyproject.toml"), max_complexity=3).max_complexity == 3
    assert config.project_root([str(tmp_path / "a" / "b"), str(tmp_path / "a" / "quarry.toml")]) == str(tmp_path)
    with pytest.raises(FileNotFoundError):
        config.load(str(tmp_path / "none.toml"))
    assert config.chosen(("cbo", "lcom"), ("lcom",)) == ["cbo"] and config.chosen() == list(config.ANALYSES)
    with pytest.raises(ValueError):
        config.chosen(("nope",))


def test_text_forms(spark, tmp_path):
    df = spark.createDataFrame([("a", 1, ["x"]), ("b<", 2, None)], "name string, n int, list array<string>")
    assert sinks.table(df, 1, "T") == "T\n=\nname  n  list\n----  -  -----\na     1  ['x']\n...\n"
    assert "<td>b&lt;</td>" in sinks.page({"s": df}, "t")
    assert [json.loads(r.json) for r in sinks.json_lines(df).collect()] == [{"name": "a", "n": 1, "list": ["x"]}, {"name": "b<", "n": 2, "list": []}]
    sinks.to_json(df, f"{tmp_path}/j")
    sinks.to_csv(df.drop("list"), f"{tmp_path}/c")
    assert spark.read.option("header", True).csv(f"{tmp_path}/c").count() == 2 and spark.read.json(f"{tmp_path}/j").count() == 2
    assert sinks.yaml({"a": [1, {"b": "x: y"}], "c": {}, "d": None, "e": True}) == 'a:\n  - 1\n  -\n    b: "x: y"\nc: {}\nd: null\ne: true\n'
    sinks.to_dot(spark.createDataFrame([('a"b', "c")], "src string, dst string"), f"{tmp_path}/d")
    assert [r.value for r in spark.read.text(f"{tmp_path}/d").collect()] == ['  "a\\"b" -> "c";']
    assert sinks.response(df) == {"total": 2, "rows": [], "truncated": False} and sinks.response(df, "full", 1)["truncated"]
    assert [sinks.exit_code(0), sinks.exit_code(3), sinks.exit_code(0, True)] == [0, 1, 2]
    assert [b[0] for b in sinks.bins(9, 19)] == ["1", "2-5", "6-9", "10-19", "20+"] and [b[0] for b in sinks.bins(3, 3)] == ["1", "2-3", "4", "5+"]


def test_styles():
    layers, rules = L.style_rules("mvc", {"model": ["m"], "view": ["v"]}, {"view": ([], [], ["model"])})
    assert layers == {"model": ["m"], "view": ["v"]} and rules == {"model": (["model"], [], ["view", "controller"]), "view": ([], [], ["model"])}
    assert set(L.LAYERS) == set(L.RULES) and all(set(L.LAYERS[s]) == set(L.RULES[s]) for s in L.LAYERS)


def test_layer_patterns(spark):
    names = {"shop.core.x": "b", "core": "b", "shop.user_core": "a", "core_user.x": "a", "x.y.deep": "c", "x.deep.y": "unknown", "test_core": "unknown", "pre.shop.web.z": "d", "scores": "unknown"}
    table = L.patterns(spark, {"a": ["core"], "b": ["core"], "c": ["y.deep"], "d": ["shop.*"], "e": ["web"]})
    df = spark.createDataFrame([(n,) for n in names], "module string")
    got = {r.module: r.layer for r in L.module_layers(df, table, ("pre",)).collect()}
    assert got == names | {"shop.core.x": "d", "core": "a", "shop.user_core": "d", "core_user.x": "a"}
    auto = L.auto_layers(spark.createDataFrame([("shop.api.users",), ("shop.models.user",), ("misc.x",)], "module string"))
    assert auto == {"presentation": ["shop.api"], "domain": ["shop.models"]}


def test_payload_collapses(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 1)], "src long, dst long")
    parts = spark.createDataFrame([(1, 1), (2, 1), (3, 3)], "node long, community long")
    for most, want in ((10, (3, 3)), (2, (2, 2))):
        n, e = N.payload(edges, parts, N.bridges(edges, parts), most)
        assert (n.count(), e.count()) == want and n.columns == ["id", "community", "bridge", "count"]


def test_scores(spark):
    one = spark.range(1)
    lit = F.lit
    none = lit(None).cast("double")
    x = one.select(
        Q.community_risk(lit(1), lit(0.5), lit(0), lit(1), lit(1), none, none).alias("few"), Q.community_risk(lit(2), lit(0.3), lit(0), lit(5), lit(0), none, none).alias("good"),
        Q.community_risk(lit(2), lit(0.0), lit(4), lit(0), lit(5), lit(0.0), lit(0.0)).alias("bad"), Q.dependency_penalty(lit(0), lit(0), lit(9), lit(1.0)).alias("none"), Q.dependency_penalty(lit(10), lit(10), lit(99), lit(1.0)).alias("most"),
        Q.system_quality(none, none, none).alias("q0"), Q.system_quality(lit(50.0), lit(50.0), lit(100.0)).alias("q"), Q.modularity_score(lit(0.123456), lit(5), lit(2), lit(0.0), lit(0)).alias("m"),
    ).first()
    assert x.few is None and x.good == 0 and abs(x.bad - 1) < 1e-9 and (x.none, x.most) == (3, 16) and (x.q0, x.q, x.m) == (0.0, 65.0, 12.35)
