import ast
import itertools
import random

from pyspark.sql import functions as F

from quarry.operators import communities as M
from quarry.operators import costs as K
from quarry.operators import graph as G
from quarry.operators import grouping as N
from quarry.operators import trees as T
from quarry.sources import control_flow as C
from quarry.sources import python_files as P
from quarry.streaming import windows as W


def quality(edges, part):
    m = sum(w for *_, w in edges)
    inside = sum(w for a, b, w in edges if part[a] == part[b])
    degree = {}
    for a, b, w in edges:
        for x in (a, b):
            degree[part[x]] = degree.get(part[x], 0) + w
    return inside / m - sum((d / (2 * m)) ** 2 for d in degree.values())


def partitions(items):
    if not items:
        yield {}
        return
    for rest in partitions(items[1:]):
        for c in range(len(set(rest.values())) + 1):
            yield {items[0]: c} | rest


def test_partition_is_near_the_best():
    rng = random.Random(3)
    for _ in range(12):
        edges = [(a, b, 1.0) for a, b in itertools.combinations(range(7), 2) if rng.random() < 0.4]
        if edges:
            found = N.partition(edges, float(len(edges)))
            best = max(quality(edges, p) for p in partitions(sorted(found)))
            assert quality(edges, found) >= best - 0.06


def test_two_cliques(spark):
    edges = [(a + k, b + k, 1.0) for k in (0, 10) for a, b in itertools.combinations(range(5), 2)] + [(0, 10, 1.0)]
    got = {r.node: r.community for r in N.communities(spark.createDataFrame(edges, "a long, b long, weight double")).collect()}
    assert got == {n + k: k for k in (0, 10) for n in range(5)}
    assert N.partition([], 1.0) == {}
    assert N.communities(spark.createDataFrame([], "a long, b long, weight double")).count() == 0
    q = G.modularity(spark.createDataFrame(edges, "a long, b long, weight double"), spark.createDataFrame(list(got.items()), "node long, community long")).first().q
    assert abs(q - quality(edges, got)) < 1e-9


def brute(a, b):
    """Tree edit distance by the recursion on forests of (label, children)."""
    size = lambda f: sum(1 + size(k) for _, k in f)
    if not a or not b:
        return size(a) + size(b)
    (x, kx), (y, ky) = a[-1], b[-1]
    return min(brute(a[:-1] + kx, b) + 1, brute(a, b[:-1] + ky) + 1, brute(a[:-1], b[:-1]) + brute(kx, ky) + (x != y))


def test_tree_distance():
    rng = random.Random(5)

    def tree(n):
        parents = [None] + [rng.randrange(i) for i in range(1, n)]
        kids = {i: [j for j in range(n) if parents[j] == i] for i in range(n)}
        labels = [rng.choice("ab") for _ in range(n)]
        out = ([], [])

        def walk(i, up):
            me = len(out[0])
            out[0].append(labels[i])
            out[1].append(up)
            return (labels[i], tuple(walk(j, me) for j in kids[i]))

        return out, (walk(0, None),)

    for _ in range(40):
        (a, fa), (b, fb) = tree(rng.randrange(1, 6)), tree(rng.randrange(1, 6))
        assert T.tree_distance(a, b) == brute(fa, fb)
    assert T.tree_similarity(([], []), ([], [])) == 1.0


CODE = """
def f(x):
    while x:
        if x > 3:
            break
        x -= 1
    else:
        return 0
    try:
        g()
        return 1
        dead()
    except ValueError:
        raise
    finally:
        h()
    return 2
def g(y):
    while y:
        if y > 4:
            break
        y -= 1
    else:
        return 1
    try:
        k()
        return 2
        dead()
    except KeyError:
        raise
    finally:
        m()
    return 3
def endless():
    while True:
        pass
    return 1
"""


def test_control_flow():
    fs = {n.name: n for n in ast.parse(CODE).body}
    flow = C.Flow(fs["f"])
    dead = [(b[4], b[5]) for b in C.blocks(flow) if not b[9] and b[6]]
    assert (12, 12) in dead and all(3 <= a for a, _ in dead)
    assert {"cond_true", "cond_false", "loop", "break", "return", "exception", "normal"} >= {e[2] for e in flow.edges} >= {"break", "return", "exception"}


def test_structural_clones(spark, tmp_path):
    (tmp_path / "a.py").write_text(CODE)
    files = P.scan(spark, f"file://{tmp_path}")
    plain = F.transform("labels", lambda x: F.regexp_extract(x, r"^[^(]+", 0))
    trees = P.extract(files, "fragments").where("name is not null").select(F.col("name").alias("id"), plain.alias("labels"), "parents")
    pairs = spark.createDataFrame([("f", "g"), ("f", "endless")], "a string, b string")
    assert [(r.a, r.b, r.similarity) for r in T.structural_pairs(pairs, trees).collect()] == [("f", "g", 1.0)]
    assert P.extract(files, "cfg_blocks").where("is_entry").count() == 4
    assert P.extract(files, "cfg_edges").where("edge_type = 'break'").count() == 2


def test_windows_on_a_stream_match_a_batch(spark, tmp_path):
    src = "/root/testdata/sf0.001/events.parquet"
    events = spark.read.parquet(src)
    events.write.parquet(f"{tmp_path}/in")
    stream = spark.readStream.schema(events.schema).parquet(f"{tmp_path}/in")
    for name, f in (("w", W.window_counts), ("s", W.sessions)):
        q = f(stream).writeStream.format("memory").queryName(f"out_{name}").outputMode("complete").option("checkpointLocation", f"{tmp_path}/at_{name}").trigger(availableNow=True).start()
        q.awaitTermination(120)
        key = lambda df: sorted(map(str, df.drop("total").collect()))
        assert key(spark.table(f"out_{name}")) == key(f(events))


def test_strong_components_against_closure(spark):
    rng = random.Random(17)
    for n, m in ((6, 8), (12, 20), (12, 40), (5, 0)):
        edges = {(rng.randrange(n), rng.randrange(n)) for _ in range(m)}
        reach = {(v, v) for v in range(n)} | edges
        while True:
            more = reach | {(a, d) for a, b in reach for c, d in reach if b == c}
            if more == reach:
                break
            reach = more
        want = {v: min(u for u in range(n) if (u, v) in reach and (v, u) in reach) for v in range(n)}
        nodes = spark.createDataFrame([(v,) for v in range(n)], "node long")
        df = spark.createDataFrame(sorted(edges), "src long, dst long")
        assert {r.node: r.component for r in G.strong_components(nodes, df).collect()} == want
        hops = {v: 0 for v in [0]}
        frontier = [0]
        while frontier:
            frontier = [b for a, b in sorted(edges) if a in frontier and b not in hops and not hops.update({b: hops[a] + 1})]
        goal = max(hops)
        path = G.shortest_path(df, 0, goal)
        assert len(path) == hops[goal] + 1 and path[0] == 0 and path[-1] == goal and all(e in edges for e in zip(path, path[1:]))
    assert G.shortest_path(spark.createDataFrame([(1, 2)], "src long, dst long"), 2, 1) == []


def test_longest_chains(spark):
    edges = spark.createDataFrame([(1, 2), (2, 3), (3, 2), (3, 4), (1, 4), (5, 4)], "src long, dst long")
    nodes = spark.createDataFrame([(v,) for v in range(1, 7)], "node long")
    got = [(r.component, r.length, r.chain) for r in G.longest_chains(nodes, edges, 3).collect()]
    assert got == [(4, 3, [1, 2, 4]), (2, 2, [1, 2]), (1, 1, [1])]


def test_groups_by_linkage(spark):
    rows = [("a", "b", 0.9), ("b", "c", 0.8), ("a", "c", 0.6), ("c", "d", 0.95), ("x", "y", 0.5)]
    pairs = spark.createDataFrame(rows, "a string, b string, similarity double")
    got = {}
    for r in N.complete_groups(pairs, 0.7).collect():
        got.setdefault(r.group, set()).add(r.node)
    assert list(got.values()) == [{"a", "b"}, {"c", "d"}] or sorted(map(sorted, got.values())) == [["a", "b"], ["c", "d"]]
    got = {}
    for r in N.centroid_groups(pairs, 0.7).collect():
        got.setdefault(r.group, set()).add(r.node)
    assert got == {"a": {"a", "b", "c", "d"}}
    small = {}
    for r in N.centroid_groups(pairs, 0.7, 2).collect():
        small.setdefault(r.group, set()).add(r.node)
    assert small == {"a": {"a", "b"}, "c": {"c", "d"}}


def test_uncovered_groups(spark):
    rng = random.Random(4)
    groups = {g: frozenset(rng.sample(range(8), rng.randrange(1, 5))) for g in range(30)}
    df = spark.createDataFrame([(g, n) for g, ns in groups.items() for n in ns], "group long, node long")
    want = {g for g, ns in groups.items() if not any(ns < o or ns == o and h < g for h, o in groups.items() if h != g)}
    assert {r.group for r in N.uncovered(df).collect()} == want


def test_small_communities_merge(spark):
    edges = [(1, 2, 5.0), (2, 3, 1.0), (3, 4, 5.0), (4, 5, 2.0), (6, 7, 1.0)]
    weighted = spark.createDataFrame(edges, "a long, b long, weight double")
    parts = spark.createDataFrame([(1, 10), (2, 10), (3, 20), (4, 20), (5, 30), (6, 40), (7, 40), (8, 50)], "node long, community long")
    assert {r.node: r.community for r in M.merged_small(weighted, parts, 2).collect()} == {1: 10, 2: 10, 3: 20, 4: 20, 5: 20, 6: 40, 7: 40, 8: 50}
    assert {r.node: r.community for r in M.merged_small(weighted, parts, 3).collect()} == {1: 30, 2: 30, 3: 30, 4: 30, 5: 30, 6: 40, 7: 40, 8: 50}  # 20 is on the round's list


def test_weighted_tree_costs():
    c = K.Costs()
    assert (c.edit("FunctionDef(f)"), c.edit("If"), c.edit("Call"), c.edit("Decorator"), c.edit("Name(x)")) == (1.5, 1.3, 0.8, 0.1, 1.0)
    assert (c.rename("Name(a)", "Name(b)"), c.rename("FunctionDef(a)", "FunctionDef(b)"), c.rename("For", "AsyncFor"), c.rename("If", "While"), c.rename("If", "Name(a)")) == (0.7, 1.0, 0.8, 0.9, 1.0)
    free = K.Costs(ignore_literals=True, ignore_names=True)
    assert free.rename("Name(a)", "Name(b)") == 0 and free.edit("Constant(1)") == 0.1
    a, b = (["FunctionDef(f)", "If", "Name(x)"], [None, 0, 1]), (["FunctionDef(f)", "If"], [None, 0])
    assert T.tree_distance(a, b, c) == 1.0 and T.tree_distance(a, b) == 1 and T.tree_distance(a, ([], []), c) == 1.5 + 1.3 + 1.0
