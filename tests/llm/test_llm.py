"""The dealt operators against brute force, round trips and held-out labels, on small fixtures with awkward rows."""

import random
import zlib

import numpy as np
import pyarrow as pa
import pytest

pytest.importorskip("quarry.llm")

from pyspark.sql import types as T  # noqa: E402

from quarry.llm import decontaminate, language_id, license_scan, mixing, near_dedup, quality_gam, quality_rules, suffix_dedup, token_output, toxicity  # noqa: E402
from quarry.llm import queries as Q  # noqa: E402

from . import plain  # noqa: E402

R = random.Random(7)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(2, 7))) for _ in range(300)]
DOCS = T.StructType([T.StructField("doc_id", T.LongType()), T.StructField("text", T.StringType()), T.StructField("lang", T.StringType()), T.StructField("source", T.StringType()), T.StructField("n_chars", T.LongType()), T.StructField("score", T.DoubleType())])


def prose(n):
    return " ".join(R.choice(WORDS) for _ in range(n))


LONG = prose(60)
TEXTS = [prose(80), None, "", " \n\t ", LONG + " " + prose(40), prose(10) + " " + LONG, "a b c", "for for for " * 60, "it's a test  \n\n we'll see, they're 'quoted' 12.5% \r\n ", "don''t 'sx 're", prose(30) + "\n" + LONG + "\n" + LONG, "é" * 150, "x" * 260]
TEXTS += [TEXTS[0], TEXTS[0].replace(" ", "  ", 1), " ".join([*TEXTS[0].split()[:-1], "zzz"])]


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i if i != 3 else None, t, "en" if i % 2 else None, f"src{i % 4}" if i % 5 else None, len(t or ""), 0.5) for i, t in enumerate(TEXTS)]
    return spark.createDataFrame(rows, DOCS)


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], DOCS)


@pytest.fixture(scope="module")
def labels(spark):
    return spark.createDataFrame([(i, i % 2, (i + 1) % 2) for i in range(12)] + [(None, 1, 0), (2, None, None)], "doc_id long, quality int, toxic int")


def test_mix(docs, empty):
    rows = mixing.mix(docs).collect()
    assert len(rows) == len(TEXTS) and all(r.taken in (0, r.size, 2 * r.size) for r in rows)
    assert sorted(map(tuple, rows), key=str) == sorted(map(tuple, mixing.mix(docs).collect()), key=str)
    total = sum(r.size for r in rows)
    source = {i if i != 3 else None: f"src{i % 4}" if i % 5 else None for i in range(len(TEXTS))}
    goals = {source[r.doc_id]: (r.source_size, r.target) for r in rows}
    assert len(goals) == 5 and sum(n for n, _ in goals.values()) == total
    assert abs(sum(t for _, t in goals.values()) - 1.5 * total) < 1e-6 and all(t <= 2 * n + 1e-9 for n, t in goals.values())
    largest = max(r.size for r in rows)
    for name, (_, target) in goals.items():
        assert abs(sum(r.taken for r in rows if source[r.doc_id] == name) - target) <= largest
    assert mixing.mix(empty).count() == 0
    assert mixing.stage(docs).columns == docs.columns


def test_decontaminate(spark, docs, empty):
    items = [("1", " ".join(LONG.split()[5:30])), ("2", LONG.upper()), ("3", "a b"), ("", "c"), ("5", None), ("6", "!?")]
    bench = spark.createDataFrame([(i or None, t) for i, t in items], "item_id string, text string")
    kept = [(i, t) for i, t in items if t is not None]
    for limit in (1 << 20, 400):
        got = {r.doc_id: (r.n_words, r.n_hit, r.n_items, r.items_sha256) for r in decontaminate.decontaminate(docs, bench, limit=limit).collect()}
        for i, t in enumerate(TEXTS):
            assert got[i if i != 3 else None] == plain.decontaminated(t, kept)
    assert decontaminate.decontaminate(empty, bench).count() == 0
    assert decontaminate.decontaminate(docs, bench.limit(0)).where("n_hit > 0").count() == 0


def test_token_output(docs, empty):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(Q.tokenizer_path())
    order = sorted(range(len(TEXTS)), key=lambda i: -1 if i == 3 else i)
    want, start = {}, 0
    for i in order:
        ids = [*tok.encode(TEXTS[i] or "", add_special_tokens=False).ids, 2]
        want[i if i != 3 else None] = (start, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes()))
        start += len(ids)
    got = token_output.token_output(docs, Q.tokenizer_path())
    assert {r.doc_id: (r.start, r.n_tokens, r.ids_crc32) for r in got.collect()} == want
    assert token_output.token_output(empty, Q.tokenizer_path()).count() == 0


def test_records_find_damage():
    data = token_output.frame(token_output.pack(5, np.array([1, 70000]))) + token_output.frame(token_output.pack(None, np.array([], int)))
    got = [token_output.unpack(p) for _, p in token_output.records(data)]
    assert got[0][0] == 5 and got[0][1].tolist() == [1, 70000] and got[1][0] is None
    with pytest.raises(ValueError):
        list(token_output.records(data[:20] + b"\xff" + data[21:]))


def test_suffix_dedup(docs, empty):
    import hashlib

    order = sorted(range(len(TEXTS)), key=lambda i: -1 if i == 3 else i)
    data = [(TEXTS[i] or "").encode() for i in order]
    gone = plain.repeated_bytes(data)
    got = {r.doc_id: r for r in suffix_dedup.suffix_dedup(docs).collect()}
    for i, t, g in zip(order, data, gone):
        r = got[i if i != 3 else None]
        assert (r.n_bytes, r.n_removed) == (len(t), int(g.sum()))
        assert r.kept_sha256 == hashlib.sha256(np.frombuffer(t, np.uint8)[~g].tobytes()).hexdigest()
    assert suffix_dedup.suffix_dedup(empty).count() == 0


def test_deep_shallow_sorts():
    s = [bytes(R.choice(b"ab") for _ in range(R.randint(0, 12))) * R.randint(1, 12) for _ in range(300)] + [b"", b"", b"a" * 90, b"a" * 91]
    assert [s[i] for i in suffix_dedup.deep_shallow(s)] == sorted(s)
    assert [s[i] for i in suffix_dedup.deep_shallow(s, 8)] == sorted(s)


def test_license_scan(spark, docs):
    t = prose(20) + "\nReleased under the MIT License.\n" + prose(5) + " " + license_scan.TEMPLATES["ISC"].replace("fee", "charge")
    got = license_scan.license_scan(spark.createDataFrame([(1, t), (2, None)], "doc_id long, text string")).collect()
    assert [(r.doc_id, r.license) for r in got] == [(1, "MIT-notice"), (1, "ISC")]
    assert got[0].coverage == 1 and (got[0].start_word, got[0].end_word) == (20, 25)
    assert license_scan.license_scan(docs).count() == 0


def test_language(spark):
    a, b = [prose(60) for _ in range(40)], [" ".join(w[::-1].replace("a", "ö") for w in prose(60).split()) for _ in range(40)]
    rows = [(i, t, "aa") for i, t in enumerate(a)] + [(100 + i, t, "bb") for i, t in enumerate(b)] + [(500, None, "aa"), (501, "12 !", "aa"), (502, "", None)]
    got = {r.doc_id: r for r in language_id.identify(spark.createDataFrame(rows, "doc_id long, text string, lang string")).collect()}
    assert all(got[i].lang_pred == "und" and got[i].score == 0 for i in (500, 501, 502))
    right = [got[i].lang_pred == k for i, t, k in rows[:80] if got[i].held_out]
    assert np.mean(right) > 0.95


def test_rules(docs, empty, labels):
    got = {r.doc_id: r for r in quality_rules.quality_rules(docs, labels).collect()}
    for i, t in enumerate(TEXTS):
        r = got[i if i != 3 else None]
        want = plain.rules_counts(t)
        assert (r.n_words, r.word_chars, r.n_symbols, r.n_dup_lines, r.n_repeat_words) == want
        assert r.base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (r.base_failed and r.kept)
    assert quality_rules.quality_rules(empty, labels).count() == 0
    assert quality_rules.stage(docs, labels).columns == docs.columns


def test_classifiers_run_on_awkward_rows(docs, empty, labels):
    for m in (quality_gam, toxicity):
        rows = m.classify(docs, labels).collect()
        assert len(rows) == len(TEXTS) and all(0 <= r.score <= 1 for r in rows)
        assert m.classify(empty, labels).count() == 0
        assert m.classify(docs, labels.limit(0)).count() == len(TEXTS)


@pytest.mark.parametrize("name,label,least", [("op1_quality_classifier", "quality", 0.95), ("op9_toxicity", "toxic", 0.9)])
def test_held_out(spark, name, label, least):
    sf = "/root/testdata/sf0.01"
    got = Q.queries()[name](spark, sf).where("held_out").join(Q.table(spark, sf, "labels"), "doc_id").collect()
    assert np.mean([r.predicted == r[label] for r in got]) >= least


def test_near_dedup(spark, docs, empty):
    base = [prose(150) for _ in range(8)]
    texts = [t for t in TEXTS if t]
    for b in base:
        for _ in range(12):
            w = b.split()
            for _ in range(R.randint(0, 8)):
                w[R.randrange(len(w))] = R.choice(WORDS)
            texts.append(" ".join(w))
    df = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(df).collect()}
    assert [got[i] for i in range(len(texts))] == plain.near_classes(texts)
    assert near_dedup.near_dedup(docs).count() == len(TEXTS)
    assert near_dedup.near_dedup(empty).count() == 0


def test_later_links_join_classes(spark):
    first, more = [(1, 2), (3, 4), (5, 6)], [(2, 4), (6, 9), (7, 8), (1, 2)]
    labels = near_dedup.components(spark.createDataFrame(first, "a long, b long"))
    got = near_dedup.joined_components(labels, spark.createDataFrame(more, "a long, b long"))
    assert {r.node: r.label for r in got.collect()} == {1: 1, 2: 1, 3: 1, 4: 1, 5: 5, 6: 5, 9: 5, 7: 7, 8: 7}
    assert got.count() == 9


def test_dart_signatures_estimate_weighted_similarity():
    from quarry.llm.textcore import mix

    a = np.arange(1000, dtype=np.uint64)
    b = np.arange(200, 1200, dtype=np.uint64)
    u = mix(np.concatenate([a, b]))
    sig = near_dedup.darts(u, np.repeat([0, 1], 1000), 2, 1024)
    assert abs((sig[0] == sig[1]).mean() - 800 / 1200) < 0.07


def test_pipeline(spark):
    import corpus_pipeline

    assert [n for n, _ in corpus_pipeline.STAGES] == ["quality_rules", "near_dedup", "decontamination", "mixing", "token_output"]
    rows = corpus_pipeline.run(spark, "/root/testdata/sf0.001").orderBy("start").collect()
    assert rows and rows[0].start == 0
    assert all(a.start + a.n_tokens == b.start and a.doc_id <= b.doc_id for a, b in zip(rows, rows[1:]))


def test_outsiders_return_each_long_pair_once():
    """Two buckets share a pair of long texts of different classes; a short pair's link is named once a class."""
    sig = np.zeros(near_dedup.COORDINATES, np.uint8).tobytes()
    bands = [7, 3, *range(100, 100 + near_dedup.BANDS - 2)]
    short = np.arange(20, dtype="<u8").tobytes()
    rows = [(3, 1, 1, True, None), (3, 2, 2, False, None), (7, 1, 1, True, None), (7, 2, 2, False, None), (9, 4, 4, True, short), (9, 5, 5, False, short), (9, 6, 5, False, short)]
    cols = [pa.array([r[c] for r in rows]) for c in range(4)]
    batch = pa.RecordBatch.from_arrays([*cols, pa.array([sig] * 7, pa.binary()), pa.array([r[4] for r in rows], pa.binary()), pa.array([bands] * 7, pa.list_(pa.int64()))], ["bucket", "rep", "label", "outside", "sig", "own", "bands"])
    for most, want in ((2, [(1, 2), (4, 5)]), (None, [(1, 2)])):
        got = [p for out in near_dedup._outsiders(most)([batch]) for p in zip(out.column("a").to_pylist(), out.column("b").to_pylist())]
        assert sorted(got) == want
