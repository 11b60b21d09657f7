"""Clone operators against brute force, on texts and on fragments of source files."""

import itertools
import random
import re

from pyspark.sql import functions as F

from quarry.operators import clones as C
from quarry.operators import costs as K
from quarry.operators import trees as T
from quarry.plans import texts
from quarry.sources import python_files as P

R = random.Random(5)
WORDS = [f"w{k}" for k in range(60)]


def prose(n):
    return [R.choice(WORDS) for _ in range(n)]


def near(words, k):
    out = list(words)
    for _ in range(k):
        out[R.randrange(len(out))] = R.choice(WORDS)
    return out


def grams(text):
    w = [x for x in re.split("[^a-z0-9]+", text.lower()) if x]
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3))


def test_pairs_of_texts(spark):
    base = [prose(60) for _ in range(6)]
    docs = [" ".join(near(b, R.randrange(5))) for b in base for _ in range(6)] + [" ".join(base[0])] * 3 + ["a b", "", None]
    df = spark.createDataFrame(list(enumerate(docs)), "doc_id long, text string")
    reps, members = C.classes(C.word_grams(df, "doc_id", "text"))
    sets = {i: grams(t or "") for i, t in enumerate(docs) if grams(t or "")}
    rep = {i: min(j for j in sets if sets[j] == sets[i]) for i in sets}
    assert {r.id: r.rep for r in members.collect()} == rep
    for t in (0.5, 0.75, 1.0):
        want = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(sorted(set(rep.values())), 2)}
        want = {k: round(v, 9) for k, v in want.items() if v >= t}
        assert {(r.a, r.b): round(r.similarity, 9) for r in C.exact_pairs(reps, t).collect()} == want
        assert {(r.a, r.b): round(r.similarity, 9) for r in C.candidates(reps, max(t, 0.75), True).collect()} == {k: v for k, v in want.items() if v >= 0.75}
    assert C.use_bands(500) and C.use_bands(200) and not C.use_bands(100)
    few = C.banded_pairs(reps, 0.5, most=1)
    assert few.groupBy("a").count().where("count > 1").count() == 0


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, x in enumerate(a, 1):
        last, row = row, [i]
        for j, y in enumerate(b, 1):
            row.append(min(last[j] + 1, row[-1] + 1, last[j - 1] + (x != y)))
    return row[-1]


def test_text_similarity(spark, tmp_path):
    rows = [(1, 1, "héllo wörld"), (1, 2, "hello world"), (1, 3, "hello world"), (2, 1, ""), (2, 2, "x" * 70 + "a"), (2, 3, "x" * 70 + "b")]
    spark.createDataFrame(rows, "conv_id long, turn long, text string").write.parquet(f"{tmp_path}/conversations.parquet")
    got = {(r.conv_id, r.turn): r.similarity for r in texts.text_similarity(spark, str(tmp_path)).collect()}
    by = {(c, t): s for c, t, s in rows}
    assert got == {(c, t): 1 - distance(by[c, t], by[c, t - 1]) / max(len(by[c, t]), len(by[c, t - 1])) for c, t in by if (c, t - 1) in by}


CODE = """
def first(a, b):
    # adds up
    total = 0
    for x in a:
        if x > b:
            total += x * 2
        else:
            total -= 1
    return total


def second(a, b):
    total = 0
    for x in a:
        if x > b:
            total += x * 2
        else:
            total -= 1
    return total


def third(items, limit):
    result = 0
    for item in items:
        if item > limit:
            result += item * 3
        else:
            result -= 5
    return result


def fourth(q):
    while q:
        q = q.next
        try:
            print(q)
        except ValueError as e:
            raise KeyError(e)
    return None, q
"""


def test_types_of_fragments(spark):
    files = spark.createDataFrame([("a.py", "a", CODE.encode()), ("b.py", "b", CODE.replace("first", "other").encode())], "path string, module string, content binary")
    f = C.large_enough(C.named(P.extract(files, "fragments")).where("kind = 'FunctionDef'"), 15, 7).cache()
    assert f.count() == 8
    sets = f.select("id", C.grams(F.col("labels")).alias("grams"))
    hashed = sets.select("id", F.array_sort(F.transform("grams", lambda x: F.xxhash64(x))).alias("g"))
    pairs = C.jaccards(f.select(F.col("id").alias("a")).crossJoin(f.select(F.col("id").alias("b"))).where("a < b"), hashed)
    trees = f.select("id", "labels", "parents")
    got = C.scored(pairs, f, T.structural_pairs(pairs, trees, 0.0, K.Costs())).collect()
    name = {r.id: r.name for r in f.collect()}
    kinds = {}
    for r in got:
        kinds.setdefault(tuple(sorted((name[r.a], name[r.b]))), set()).add(r.type)
    # equal but for the name of the function: textual; renamed: by labels without names
    assert kinds["first", "second"] == {1} and kinds["second", "third"] == {2} and kinds["fourth", "fourth"] == {1}
    assert ("first", "fourth") not in kinds or kinds["first", "fourth"] == {4}
    assert all(0 <= r.confidence <= r.similarity <= 1 for r in got)
    best = C.best(C.selected(spark.createDataFrame(got), (1,)), 3).collect()
    assert len(best) == 3 and all(r.similarity >= 0.85 for r in best)
    assert {r.type: r.pairs for r in C.statistics(spark.createDataFrame(got)).collect()}[1] == sum(r.type == 1 for r in got)


def test_overlapping_fragments_make_no_pair(spark):
    rows = [("a", "x.py", 1, 10, 20, 10), ("b", "x.py", 10, 20, 20, 11), ("c", "x.py", 11, 20, 20, 10), ("d", "y.py", 1, 10, 9, 10)]
    f = spark.createDataFrame(rows, "id string, path string, start_line int, end_line int, size int, lines int")
    pairs = spark.createDataFrame(list(itertools.combinations("abcd", 2)), "a string, b string")
    assert {(r.a, r.b) for r in C.located(pairs, f).collect()} == {("a", "c")}


def test_map_cosine(spark):
    rows = [({"a": 1, "b": 2}, {"a": 2, "b": 4}, 1.0), ({"a": 1}, {"b": 1}, 0.0), ({}, {}, 1.0), ({}, {"a": 1}, 0.0)]
    df = spark.createDataFrame(rows, "x map<string,int>, y map<string,int>, want double")
    assert all(abs(r.got - r.want) < 1e-9 for r in df.select("want", C.map_cosine(F.col("x"), F.col("y")).alias("got")).collect())
