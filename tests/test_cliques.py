"""Complete linkage of documents against brute force over all pairs."""

import itertools
import random
import re

import numpy as np
import pytest

from quarry.operators import cliques as Q
from quarry.operators import grouping as N
from quarry.plans import texts

T = texts.THRESHOLD


def grams(text):
    w = re.findall("[a-z0-9]+", (text or "").lower())
    return frozenset(tuple(w[i : i + 4]) for i in range(len(w) - 3))


def linked(docs):
    """id -> (least id with its set, least id of its group)."""
    sets = {i: grams(t) for i, t in docs.items()}
    rep = {i: min(j for j in sets if sets[j] == s) if s else i for i, s in sets.items()}
    own = sorted({r for i, r in rep.items() if sets[i]})
    sim = {(a, b): len(sets[a] & sets[b]) / len(sets[a] | sets[b]) for a, b in itertools.combinations(own, 2)}
    sim = {k: v for k, v in sim.items() if v >= T}
    group = N._complete(sim, sorted({x for k in sim for x in k}), T)
    return {i: (r, group.get(r, r)) for i, r in rep.items()}


def got(spark, docs, path):
    spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3).write.parquet(f"{path}/documents.parquet")
    rows = texts.clone_cliques(spark, str(path)).collect()
    assert len(rows) == len(docs)
    return {r.node: (r.rep, r["group"]) for r in rows}


def words(r, n, most=60):
    return [f"w{r.randrange(most)}" for _ in range(n)]


def changed(r, base, k):
    out = list(base)
    for _ in range(k):
        out[r.randrange(len(out))] = f"x{r.randrange(10**6)}"
    return out


def test_copies_are_linked(spark, tmp_path):
    docs = {3: "One two three four five six.", 8: "one TWO three, four five six", 5: "a b c d e f g", 2: None, 9: "", 7: "a b c", 6: "a b c"}
    want = {3: (3, 3), 8: (3, 3), 5: (5, 5), 2: (2, 2), 9: (9, 9), 7: (7, 7), 6: (6, 6)}
    assert got(spark, docs, tmp_path) == want == linked(docs)


def test_documents_against_all_pairs(spark, tmp_path):
    r = random.Random(8)
    bases = [words(r, n) for n in (5, 9, 30, 80, 200) for _ in range(4)]
    made = [changed(r, b, r.randrange(1 + len(b) // 12)) for b in bases for _ in range(9)]
    made += [m[: len(m) * 5 // 6] for m in made[::5]] + made[::7] + [words(r, 4, 4) for _ in range(60)] + [words(r, 7, 2) for _ in range(60)]
    r.shuffle(made)
    docs = {i * 3: " ".join(m) for i, m in enumerate(made)}
    want = linked(docs)
    assert len({g for _, g in want.values()}) < len({x for x, _ in want.values()}) < len(docs)
    assert got(spark, docs, tmp_path) == want


def test_a_component_of_many_pairs(spark, tmp_path):
    r = random.Random(2)
    base = words(r, 120, 10**6)
    docs = {i: " ".join(changed(r, base, 1 + i % 3)) for i in range(250)}
    want = linked(docs)
    assert sum(len(grams(docs[a]) & grams(docs[b])) >= T * len(grams(docs[a]) | grams(docs[b])) for a, b in itertools.combinations(docs, 2)) > 20_000
    assert got(spark, docs, tmp_path) == want


@pytest.mark.parametrize("most", [1, 7, 50, 10**6])
def test_few_pairs_at_once(most):
    r = random.Random(most)
    base = r.sample(range(10**6), 40)
    sets = [np.array(sorted({*r.sample(base, r.randrange(33, 41)), *r.sample(range(10**6), 2)}), np.uint64) for _ in range(60)]
    own = [set(s.tolist()) for s in sets]
    sim = {(a, b): len(own[a] & own[b]) / len(own[a] | own[b]) for a, b in itertools.combinations(range(60), 2)}
    sim = {k: v for k, v in sim.items() if v >= T}
    want = N._complete(sim, list(range(60)), T)
    assert 1 < len(set(want.values())) < len(want)
    assert Q.complete(sets, T, most).tolist() == [want.get(i, i) for i in range(60)]


def test_the_bound_is_never_too_low():
    r = np.random.default_rng(1)
    for n, m in ((3, 4), (100, 130), (900, 1100), (40, 40)):
        a = r.integers(0, 1 << 63, n).astype(np.uint64)
        b = np.concatenate([a[: n // 2], r.integers(0, 1 << 63, m - n // 2).astype(np.uint64)])
        for x, y in ((a, b), (b, a), (a << np.uint64(20), b << np.uint64(20))):
            assert Q._bound(Q._sketch(x), Q._sketch(y), len(x), len(y)) >= len(set(x.tolist()) & set(y.tolist()))


@pytest.mark.parametrize("few", [0, 10**6])
def test_labels_of_links(spark, monkeypatch, few):
    monkeypatch.setattr(Q, "FEW", few)
    r = random.Random(few)
    links = [(k, k + 1) for k in range(40)] + [tuple(sorted(r.sample(range(100, 160), 2))) for _ in range(35)]
    df = spark.createDataFrame(links, "a long, b long").repartition(5)
    low = {x: x for ab in links for x in ab}
    for _ in low:
        for a, b in links:
            low[a] = low[b] = min(low[a], low[b])
    assert {x.key: x.label for x in Q._named(df).collect()} == low


def test_links_that_the_groups_leave_out_are_counted(spark, tmp_path):
    """The first and the last of a chain are not similar, so a group leaves one of its links out."""
    base = [f"w{i}" for i in range(64)]
    docs = {1: base, 2: base[:50] + ["x"] * 3, 3: base[:44], 4: base[:38], 5: base[:38], 6: ["y"] * 9, 7: [], 8: ["a", "b"]}
    docs = {i: " ".join(w) for i, w in docs.items()}
    r = random.Random(5)
    more = [words(r, n) for n in (5, 9, 30, 80, 200) for _ in range(3)]
    docs |= {20 + i: " ".join(changed(r, b, r.randrange(1 + len(b) // 10))) for i, b in enumerate(more * 8)}
    sets, found = {i: grams(t) for i, t in docs.items()}, linked(docs)
    own = {x for i, (x, _) in found.items() if sets[i]}
    near = {i: [j for j in own if sets[j] != s and len(sets[j] & s) >= T * len(sets[j] | s)] if s else [] for i, s in sets.items()}
    assert any(found[i][1] != found[j][1] for i, n in near.items() for j in n)
    spark.createDataFrame(sorted(docs.items()), "doc_id long, text string").repartition(3).write.parquet(f"{tmp_path}/documents.parquet")
    rows = texts.clone_cliques(spark, str(tmp_path)).collect()
    assert {x.node: (x.rep, x["group"], x.links) for x in rows} == {i: (*found[i], len(near[i])) for i in docs}


def test_pairs_at_the_threshold_share_enough_of_their_prefixes():
    """In any order, and just at the threshold."""
    r = np.random.default_rng(3)
    for _ in range(3000):
        nb = int(r.integers(1, 90))
        na = int(r.integers(int(np.ceil(T * nb)), nb + 1))
        k = int(np.ceil(T * (na + nb) / (1 + T) - 1e-9))
        order = r.permutation(na + nb - k)
        a, b = np.sort(np.concatenate([order[:k], order[k:na]])), np.sort(np.concatenate([order[:k], order[na:]]))
        assert k / (na + nb - k) >= T and len(b) == nb
        both, need = (int(x[0]) for x in Q._least_shared(np.array([na]), np.array([nb]), T))
        kept = [len(x) - int(np.ceil(T * len(x) - 1e-9)) + 1 for x in (a, b)]
        assert all(len(x) - k + need <= n for x, n in zip((a, b), kept))
        shared = np.intersect1d(a[: na - k + need], b[: nb - k + need])
        assert both == k and 1 <= need <= len(shared)
        for g in shared:
            x, y = np.searchsorted(a, g), np.searchsorted(b, g)
            assert min(x, y) + 1 + min(na - 1 - x, nb - 1 - y) >= k
