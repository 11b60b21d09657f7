"""The learned and matched operators against plain versions that look nothing up and batch nothing."""

import math
import random
import re

import numpy as np
from pyspark.sql import functions as F

from quarry.llm import features, language_id, license_scan, near_dedup, quality_gam, quality_rules, toxicity
from quarry.llm.textcore import Words, text_chunks

from . import plain

R = random.Random(23)
WORDS = ["".join(R.choice("abcdeé") for _ in range(R.randint(2, 7))) for _ in range(200)]


def prose(n, words=WORDS):
    return " ".join(R.choice(words) for _ in range(n))


def junk(n):
    return " ".join(R.choice(["!!!", "BUY", "$$$", "now", "###"]) for _ in range(n))


ROWS = [(k, prose(R.randint(40, 90)) if k % 2 else prose(20) + " " + junk(R.randint(20, 60)), k % 2 if R.random() < 0.85 else 1 - k % 2) for k in range(160)]
ROWS += [(7, prose(60), 1), (7, None, 1), (500, None, None), (501, "", None), (None, prose(50), None), (502, "x", None)]


def frames(spark):
    docs = spark.createDataFrame([(i, t) for i, t, _ in ROWS], "doc_id long, text string")
    labels = spark.createDataFrame([(i, y, 1 - y) for i, _, y in ROWS if y is not None], "doc_id long, quality int, toxic int").distinct()
    return docs, labels


def stats(text):
    """FEATURES of one text by hand."""
    t = text or ""
    words = re.findall(r"[^\x20\x09-\x0D]+", t)
    n, bytes_ = len(words), t.encode()
    _, chars, symbols, dups, repeats = plain.rules_counts(t)
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    upper, digits, wide = (sum(f(c) for c in t) for f in (lambda c: "A" <= c <= "Z", lambda c: "0" <= c <= "9", lambda c: ord(c) > 127))
    lower = sum("a" <= c <= "z" for c in t)
    some, letters, every = max(n, 1), max(upper + lower + wide, 1), max(len(t), 1)
    other = sum(32 < b < 128 and not chr(b).isalnum() and chr(b) not in "#*$%&|<>!?.,;:" or b < 32 and not 9 <= b <= 13 or b == 127 for b in bytes_)
    return [math.log1p(n), chars / some, symbols / some, dups / max(len(lines), 1), repeats / some, upper / letters, digits / every, t.count("!") / some, sum(t.count(c) for c in ".,;:") / some, t.count("?") / some, n / max(len(lines), 1), wide / every, len(set(words)) / some, other / some]


def test_features_are_the_plain_ones(spark):
    docs, _ = frames(spark)
    got = features.with_stats(docs, "counts", "features").collect()
    for r in got:
        assert np.allclose(r.features, stats(r.text), atol=1e-12), r.text
        assert tuple(r.counts) == plain.rules_counts(r.text)


def test_scores_are_sums_of_bins(spark):
    docs, labels = frames(spark)
    model = quality_gam.fit(docs, labels, features.fold("doc_id", quality_gam.FOLDS) != quality_gam.HELD_OUT)
    for r, t in zip(got := quality_gam.classify(docs, labels).collect(), [t for _, t, _ in ROWS]):
        x, z = stats(t), model.base
        for v, cuts, table in zip(x, model.cuts, model.tables):
            z += table[sum(c <= v for c in cuts)]
        for (i, j), table in zip(model.chosen, model.pair_tables):
            z += table[sum(c <= x[i] for c in model.pair_cuts[i]), sum(c <= x[j] for c in model.pair_cuts[j])]
        assert abs(r.score - 1 / (1 + math.exp(-z))) < 1e-9 and r.predicted == (r.score >= 0.7)
    assert len(got) == len(ROWS) and len(model.chosen) > 0


def test_samples_have_a_row_an_id_and_never_change(spark):
    docs, labels = frames(spark)
    more = docs.unionAll(docs).repartition(5)
    take = lambda d: sorted(map(tuple, features.labelled(d, labels, "quality", F.lit(True), 50, lambda x: x.withColumn("value", F.col("text"))).collect()))
    assert take(docs) == take(more) and len(take(docs)) == 50 == len({r[0] for r in take(docs)})


def test_the_list_is_tried_in_order(spark):
    docs, labels = frames(spark)
    rules = quality_rules.learn(docs, labels)
    assert rules
    for r, (i, t, _) in zip(quality_rules.quality_rules(docs, labels).collect(), ROWS):
        x, n = stats(t), plain.rules_counts(t)
        failed = n[0] < 50 or 100 * n[4] > 50 * n[0]
        rejected = any(all((x[c.feature] > c.cut) if c.above else (x[c.feature] <= c.cut) for c in rule) for rule in rules)
        assert (r.base_failed, r.kept) == (failed, not failed and not rejected)
    assert len(quality_rules.spoken(rules)) == len(rules)


def test_toxic_features_by_hand():
    strong, weak = ["vile", "awful"], ["dull"]
    texts = ["You are a vile, AWFUL person!", "v1le and 4wful stuff", "dull dull day you say", "", "vile" + " word" * 8 + " you", "a-b c_d e.f", "vile you", "usted vile vile?"]
    data = [t.encode() for t in texts]
    got = toxicity.Features(strong, weak)(np.frombuffer(b"".join(data), np.uint8), np.cumsum([0, *map(len, data)]))
    you = set(toxicity.YOU)
    for t, x in zip(texts, got):
        ws = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", t.lower())
        n = max(len(ws), 1)
        at = [k for k, w in enumerate(ws) if w in strong]
        near = sum(any(ws[j] in you for j in range(max(0, k - 5), min(len(ws), k + 6))) for k in at)
        undone = re.findall(r"[0-9a-z@$!\x80-\U0010ffff]+", t.lower())
        clear = [w.translate(str.maketrans("01345789@$!", "oieastbgasi")) for w in undone]
        assert np.allclose(x[[0, 1, 2, 3, 4, 5]], [len(at) / n, min(len(at), 20), len({ws[k] for k in at}), sum(w in weak for w in ws) / n, sum(w in strong for w in clear) / n, near / n]), t
        assert np.isclose(x[6], sum("A" <= c <= "Z" for c in t) / max(sum(c.isalpha() for c in t), 1)) and np.isclose(x[11], math.log1p(len(ws)))


def test_toxicity_scores_by_hand(spark):
    """A tree is walked test by test, then calibrated between its knots."""
    docs, labels = frames(spark)
    use = features.fold("doc_id", toxicity.FOLDS) != toxicity.HELD_OUT
    words, model = toxicity.fit(docs, labels, use)
    make = toxicity.Features(*words)

    def leaf(tree, bins):
        while isinstance(tree, tuple):
            tree = tree[2] if bins[tree[0]] < tree[1] else tree[3]
        return tree

    for r, (_, t, _) in zip(toxicity.classify(docs, labels).collect(), ROWS):
        data = (t or "").encode()
        x = make(np.frombuffer(data, np.uint8), np.array([0, len(data)]))[0]
        bins = [sum(c <= v for c in cuts) for v, cuts in zip(x, model.cuts)]
        raw = model.base + sum(leaf(tree, bins) for tree in model.trees)
        xs, ys = model.knots
        k = next((k for k, v in enumerate(xs) if v >= raw), len(xs))
        flat = ys[0] if k == 0 else ys[-1] if k == len(xs) else ys[k] if xs[k] == xs[k - 1] else ys[k - 1] + (ys[k] - ys[k - 1]) * (raw - xs[k - 1]) / (xs[k] - xs[k - 1])
        assert abs(r.score - min(1, max(0, 0.98 * flat + 0.02 / (1 + math.exp(-raw))))) < 1e-9


def test_language_is_the_least_compressed_size(spark):
    import zstandard as z

    langs = {"aa": WORDS, "bb": [w[::-1].replace("a", "ö") for w in WORDS], "cc": [w.replace("b", "zz") for w in WORDS]}
    rows = [(k, prose(60, langs[n]), n) for k, n in enumerate(sorted(langs) * 25)] + [(900, "½ ² Ⅷ ①", "aa"), (901, None, "aa"), (902, "12 _", None), (903, "ª", "bb"), (904, "a" * 9000, "cc")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string")
    content = language_id.dictionaries(docs, features.fold("doc_id", 3) != 1)
    assert sorted(content) == sorted(langs)
    got = {r.doc_id: r for r in language_id.identify(docs).collect()}
    firm = {r.doc_id: r for r in language_id.identify(docs, reject=True).collect()}
    for i, t, _ in rows:
        if not any(c.isalpha() for c in t or ""):
            assert (got[i].lang_pred, got[i].score) == ("und", 0.0)
            continue
        data, sizes = t.lower().encode(), {}
        for name in sorted(content):
            d = z.ZstdCompressionDict(content[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(6, dict_size=len(content[name]), source_size=4096, strategy=z.STRATEGY_LAZY, min_match=4, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            sizes[name] = sum(len(z.ZstdCompressor(dict_data=d, compression_params=how).compress(data[k : k + 4096])) for k in range(0, len(data), 4096))
        best = min(sizes, key=lambda n: (sizes[n], n))
        margin = (sorted(sizes.values())[1] - sizes[best]) / sizes[best]
        assert got[i].lang_pred == best and got[i].sure == (margin >= language_id.MARGIN)
        assert firm[i].lang_pred == (best if got[i].sure else "und")
    assert language_id.identify(docs.limit(0)).count() == 0
    assert {r.lang_pred for r in language_id.identify(docs.withColumn("lang", F.lit(None).cast("string"))).collect()} == {"und"}


def best_coverage(template, text):
    """Most template words in one local alignment (match 2, else -1), over all cells, without a band."""
    last, top = [(0, 0)] * (len(text) + 1), (0, 0)
    for w in template:
        now = [(0, 0)]
        for j, x in enumerate(text):
            s, m = last[j]
            cell = max((s + 2, m + 1) if w == x else (s - 1, m), (last[j + 1][0] - 1, last[j + 1][1]), (now[j][0] - 1, now[j][1]))
            now.append(cell if cell[0] > 0 else (0, 0))
            top = max(top, now[-1])
        last = now
    return top[1] / len(template)


def test_degraded_licenses(spark):
    texts = license_scan.templates()
    assert {"Apache-2.0-text", "GPL-3-text", "MPL-2.0-text", "MIT-text", "ISC-text"} <= set(texts) and len(texts) > 30
    rows, want = [], {}
    for k, name in enumerate(["MIT-text", "ISC-text", "Zlib-text", "BSD-3-Clause", "Apache-2.0-header", "GPL-3-text", "Apache-2.0-text"]):
        words = texts[name].split()
        for j, share in enumerate((0.0, 0.06, 0.9)):
            if len(words) > 1000 and share > 0.5:
                continue
            some = [R.choice(WORDS) if R.random() < share else w for w in words]
            rows.append((10 * k + j, prose(30) + "\n" + "\n".join(" ".join(some[i : i + 9]) for i in range(0, len(some), 9)) + "\n" + prose(12)))
            want[10 * k + j] = name if share < 0.5 else None
    rows += [(900, None), (901, ""), (902, prose(3000))]
    got = {}
    for r in license_scan.license_scan(spark.createDataFrame(rows, "doc_id long, text string")).collect():
        got.setdefault(r.doc_id, []).append(r)
    for i, t in rows:
        if want.get(i):
            top = max(got[i], key=lambda r: r.matched_words)
            assert top.license == want[i] and top.coverage >= 0.85, (i, top)
            if len(t) < 4000:
                cut = lambda x: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", x.lower())
                assert abs(top.coverage - best_coverage(cut(texts[want[i]]), cut(t))) < 0.02
        else:
            assert i not in got
    assert license_scan.license_scan(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_near_dedup_recall_over_a_table(spark):
    """Every pair of a query set (ids that 20 divides) against all rows, exactly; at least 0.9 of the links are found."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet")
    got = {r.doc_id: r.class_id for r in near_dedup.near_dedup(docs).collect()}
    rows = {r.doc_id: plain.shingles(r.text or "") for r in docs.collect()}
    size = {i: sum(s.values()) for i, s in rows.items()}
    links = found = 0
    for q in (i for i in rows if i % 20 == 0):
        for i in rows:
            if i != q and min(size[q], size[i]) >= 0.8 * max(size[q], size[i]) > 0:
                both = sum((rows[q] & rows[i]).values())
                if both >= 0.8 * (size[q] + size[i] - both):
                    links += 1
                    found += got[q] == got[i]
    assert links > 5 and found >= 0.9 * links


def test_chunks_hold_whole_rows():
    import pyarrow as pa

    texts = ["a" * n for n in (0, 5, 3_000_000, 1, 0)] + [None] * 9000
    batch = pa.RecordBatch.from_arrays([pa.array(texts)], ["text"])
    out = list(text_chunks([batch]))
    assert sum(r.num_rows for r, _, _ in out) == len(texts) and max(r.num_rows for r, _, _ in out) <= 4000
    assert [n for _, _, off in out for n in np.diff(off)] == [len(t or "") for t in texts]
    assert sum(Words(buf, off).counts.sum() for _, buf, off in out) == 3
