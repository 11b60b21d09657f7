"""Rows that repeat, share an id or have none are told apart: each row is decided by its own text."""

import hashlib
import random

import numpy as np

from quarry.llm import decontaminate, license_scan, mixing, near_dedup, quality_rules, suffix_dedup

from . import plain

R = random.Random(11)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(2, 7))) for _ in range(300)]


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


def near(text, k=2):
    w = text.split()
    for _ in range(k):
        w[R.randrange(len(w))] = R.choice(WORDS)
    return " ".join(w)


def test_near_dedup_keeps_one_row_a_class(spark):
    a, b, c, d, e, f = (prose(150) for _ in range(6))
    rows = [(1, a), (1, a), (None, a), (None, b), (None, c), (None, c), (None, near(c)), (7, d), (7, e), (8, d), (3, near(d)), (None, None), (None, None), (9, f), (9, f), (9, near(f, 1)), (None, "")]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long").repartition(3)
    texts = [t if t is not None else f"null {k}" for k, (_, t) in enumerate(rows)]
    cls = plain.near_classes(texts)
    got = near_dedup.near_dedup(df).collect()
    assert len(got) == len(rows) and sum(r.kept for r in got) == len(set(cls))
    least = {k: min((i for (i, _), x in zip(rows, cls) if x == k and i is not None), default=None) for k in cls}
    assert sorted(((r.doc_id, r.class_id) for r in got), key=str) == sorted(((i, least[k]) for (i, _), k in zip(rows, cls)), key=str)
    assert all(r.doc_id == r.class_id for r in got if r.kept)
    left = near_dedup.stage(df)
    assert left.columns == df.columns
    kept = [r.k for r in left.collect()]
    assert sorted(cls[k] for k in kept) == sorted(set(cls))
    assert all(rows[k][0] == least[cls[k]] for k in kept)


def test_blocks_give_each_row_back_once(spark):
    passage, other = prose(30), prose(30)
    items = [("1", passage), ("2", passage + " end"), ("3", other), ("4", other + " stop")]
    bench = spark.createDataFrame(items, "item_id string, text string")
    pad = [prose(10) for _ in range(4)]
    # equal ids (or none) and equal numbers of words, other hits
    rows = [(5, pad[0] + " " + passage), (5, pad[1] + " " + other), (5, pad[2] + " " + prose(30)), (5, pad[2] + " " + prose(30)), (None, pad[0] + " " + passage), (None, pad[3] + " " + prose(30)), (None, pad[3] + " " + prose(30)), (5, pad[0] + " " + passage), (None, None), (None, None)]
    df = spark.createDataFrame([(i, t, k) for k, (i, t) in enumerate(rows)], "doc_id long, text string, k long")
    want = sorted(((i, *plain.decontaminated(t, items)) for i, t in rows), key=str)
    clean = [k for k, (_, t) in enumerate(rows) if plain.decontaminated(t, items)[2] < decontaminate.STAGE_ITEMS]
    for limit in (1 << 20, 300):
        assert (sum(1 for _ in decontaminate.blocks(bench, limit)) > 1) == (limit == 300)
        got = decontaminate.decontaminate(df, bench, limit=limit).collect()
        assert sorted(((r.doc_id, r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in got), key=str) == want
        left = decontaminate.stage(df, bench, limit=limit)
        assert left.columns == df.columns and sorted(r.k for r in left.collect()) == clean


def test_suffix_dedup_tells_rows_apart(spark):
    a, b, c = (prose(90) for _ in range(3))
    rows = [(None, prose(20) + a), (None, prose(50)), (None, b + prose(60)), (None, prose(60) + a), (4, prose(40) + b), (4, prose(10) + c), (4, prose(70) + c), (4, c[:300] + b[:250]), (6, a + c), (6, a + c), (None, prose(50) + " twin"), (2, ""), (2, None), (9, "short"), (9, "short")]
    rows += [rows[1], rows[10]]
    df = spark.createDataFrame(rows, "doc_id long, text string")
    order = [tuple(r) for r in df.selectExpr("doc_id", "xxhash64(text) AS sub", "text").collect()]
    order.sort(key=lambda r: (r[0] is not None, r[0] or 0, r[1]))
    data = [(t or "").encode() for _, _, t in order]
    want = [(i, len(t), int(g.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()) for (i, _, _), t, g in zip(order, data, plain.repeated_bytes(data))]
    for most in (suffix_dedup.MOST, 2, 1):  # groups that are held, and groups whose strings are dealt out
        got = [(r.doc_id, r.n_bytes, r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, most).collect()]
        assert sorted(got, key=str) == sorted(want, key=str)


def test_license_notices_that_stand_close(spark):
    mit, bsd = license_scan.TEMPLATES["MIT-notice"], license_scan.TEMPLATES["BSD-notice"]
    texts = [f"{mit}\n{mit}", f"{mit}\n" * 7, f"x {mit} y {bsd}\n{mit} z {mit}", f"Released under the MIT {mit}", f"Released under {mit} the MIT License", license_scan.TEMPLATES["ISC"] * 3]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {}
    for r in license_scan.license_scan(df).collect():
        got.setdefault(r.doc_id, []).append((r.license, r.start_word, r.end_word))
    n = len(license_scan.Index(license_scan.TEMPLATES).words[sorted(license_scan.TEMPLATES).index("ISC")])
    assert got == {
        0: [("MIT-notice", 0, 5), ("MIT-notice", 5, 10)], 1: [("MIT-notice", k, k + 5) for k in range(0, 35, 5)],
        2: [("MIT-notice", 1, 6), ("BSD-notice", 7, 12), ("MIT-notice", 12, 17), ("MIT-notice", 18, 23)],
        3: [("MIT-notice", 0, 4), ("MIT-notice", 4, 9)], 4: [("MIT-notice", 2, 7)], 5: [("ISC", k * n, (k + 1) * n) for k in range(3)],
    }


CLASHING = "_id _d _digest _key _gone _rule_source _whole _rest _under _copy rest whole under counts features _counts _features value score label digest rep row kept k".split()


def test_stages_keep_columns_that_clash(spark):
    a, b, c = prose(120), prose(120), prose(120)
    rows = [(1, a), (1, a), (2, near(a)), (None, b), (None, None), (4, c + " " + b), (4, ""), (5, c), (6, prose(70))]
    df = spark.createDataFrame([(i, t, "s1" if (i or 0) % 2 else None, n) for n, (i, t) in enumerate(rows)], "doc_id long, text string, source string, n long")
    df = df.selectExpr("*", *[f"n * {k} AS `{name}`" for k, name in enumerate(CLASHING)], "'x' AS `a.b`")
    bench = spark.createDataFrame([("i", " ".join(c.split()[10:40]))], "item_id string, text string")
    labels = spark.createDataFrame([(1, 1), (6, 0)], "doc_id long, quality int")
    for out in (near_dedup.stage(df), decontaminate.stage(df, bench), mixing.stage(df), quality_rules.stage(df, labels)):
        assert out.columns == df.columns
        for r in out.collect():
            assert all(r[name] == r.n * k for k, name in enumerate(CLASHING)) and r["a.b"] == "x"
    assert sorted(r.n for r in decontaminate.stage(df, bench).collect()) == [0, 1, 2, 3, 4, 6, 8]


def test_a_passage_that_many_share(spark):
    """Its edges make one group of all documents, which is dealt out by strings."""
    passage = prose(70)
    texts = [prose(R.randrange(12)) + passage[: R.randrange(200, len(passage))] + " " + prose(R.randrange(12)) for _ in range(60)] + [passage[50:], passage]
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    data = [t.encode() for t in texts]
    want = {i: (int(g.sum()), hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()) for i, (t, g) in enumerate(zip(data, plain.repeated_bytes(data)))}
    for most in (suffix_dedup.MOST, 7):
        assert {r.doc_id: (r.n_removed, r.kept_sha256) for r in suffix_dedup.suffix_dedup(df, most).collect()} == want
