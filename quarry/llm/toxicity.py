"""Toxicity: gradient-boosted trees over dense features, calibrated by an isotonic fit.

Features: densities of two lexicons (strong and weak), their presence with obfuscation undone, second-person words
near lexicon words, capitals, punctuation and obfuscation rates. The lexicons are learned: words whose share among
toxic documents is many times their share among others, from at most SAMPLE labelled documents outside the held-out
fold (those of least id hash). Nulls: a null text scores as an empty one; null labels are left out; a null id is in
fold 0. Without labels of both kinds every score is the base rate. Empty tables give no rows; extra columns are
ignored; repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.features import fold, histogram, labelled
from quarry.llm.learning import BoostedTrees
from quarry.llm.textcore import LOWER, WORD, Words, byte_table, member, per_doc, text_chunks, tidied

SAMPLE = 12_000
FOLDS, HELD_OUT = 5, 0
THRESHOLD = 0.5
LIFT, STRONG, WEAK, MOST = 20.0, 0.10, 0.03, 100
NEAR = 5
#: Second-person words (fixed values).
YOU = "du dich dir euch tu te toi tú usted vous you your yours ustedes votre vos dein".split()

_LEET = LOWER.copy()
for _a, _b in zip(b"01345789@$!", b"oieastbgasi"):
    _LEET[_a] = _b
_BREAK = byte_table(lambda b: chr(b) in "0123456789@$!*_-.")
_LETTER = byte_table(lambda b: 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
_LEET_WORD = byte_table(lambda b: WORD[b] or chr(b) in "@$!")


def word_hashes(words: list[str]) -> np.ndarray:
    data = [w.encode() for w in words]
    off = np.cumsum([0, *map(len, data)])
    return np.unique(Words(np.frombuffer(b"".join(data), np.uint8), off).hash)


class Features:
    def __init__(self, strong: list[str], weak: list[str]):
        self.strong, self.weak, self.you = word_hashes(strong), word_hashes(weak), word_hashes(YOU)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> np.ndarray:
        n = len(off) - 1
        w = Words(buf, off, WORD, LOWER)
        some = np.maximum(w.counts, 1)
        strong, weak = member(w.hash, self.strong), member(w.hash, self.weak)
        leet = Words(buf, off, _LEET_WORD, _LEET)
        undone = member(leet.hash, self.strong)
        you = np.flatnonzero(member(w.hash, self.you))
        at = np.flatnonzero(strong)
        k = np.searchsorted(you, at)
        near = np.zeros(len(at), bool)
        for j in (k - 1, k):
            ok = (j >= 0) & (j < len(you))
            near[ok] |= (np.abs(you[j[ok]] - at[ok]) <= NEAR) & (w.doc[you[j[ok]]] == w.doc[at[ok]])
        # obfuscated: a token with a breaking character between letters
        mid = np.zeros(len(buf), bool)
        if len(buf) > 2:
            mid[1:-1] = _BREAK[buf[1:-1]] & _LETTER[buf[:-2]] & _LETTER[buf[2:]]
        marks = np.diff(np.concatenate([[0], np.cumsum(mid)])[off])
        distinct = np.zeros(n)
        if strong.any():
            pairs = np.unique(np.stack([w.doc[strong].astype(np.uint64), w.hash[strong]], 1), axis=0)
            distinct = np.bincount(pairs[:, 0].astype(int), minlength=n).astype(float)
        count = per_doc(strong, w.doc, n)
        hist = histogram(buf, off)
        letters = np.maximum(hist[:, 1] + hist[:, 2] + hist[:, 6], 1)
        return np.stack([
            count / some, np.minimum(count, 20), distinct, per_doc(weak, w.doc, n) / some, per_doc(undone, leet.doc, n) / some, per_doc(near, w.doc[at], n) / some,
            hist[:, 2] / letters, hist[:, 9] / some, hist[:, 10] / some, hist[:, 8] / some, marks / some, np.log1p(w.counts),
        ], 1)


def _count_words(batches):
    """word, toxic and other documents that have it, in this part of the sample."""
    toxic: dict[str, int] = {}
    other: dict[str, int] = {}
    for rows, buf, off in text_chunks(batches):
        words = Words(buf, off)
        for d, label in enumerate(rows.column("label").to_pylist()):
            for x in set(words.doc_words(d)):
                try:
                    t = x.decode()
                except UnicodeDecodeError:
                    continue
                into = toxic if label else other
                into[t] = into.get(t, 0) + 1
    names = sorted(toxic.keys() | other.keys())
    yield pa.RecordBatch.from_arrays([pa.array(names, pa.string()), pa.array([toxic.get(t, 0) for t in names], pa.int64()), pa.array([other.get(t, 0) for t in names], pa.int64())], ["word", "toxic", "other"])


def _features(shared, *carry: str):
    def run(batches):
        for rows, buf, off in text_chunks(batches):
            x = Features(*shared.value)(buf, off)
            yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in carry), pa.array(list(x), pa.list_(pa.float64()))], [*carry, "features"])

    return run


def lexicons(sample: DataFrame) -> tuple[list[str], list[str]]:
    """Strong and weak words of a labelled sample, at most MOST of each."""
    n = dict(sample.groupBy("label").count().collect())
    toxic, other = n.get(1, 0), n.get(0, 0)
    if not toxic or not other:
        return [], []
    counts = sample.select("text", "label").mapInArrow(tidied(_count_words), "word string, toxic long, other long").groupBy("word").agg(F.sum("toxic").alias("toxic"), F.sum("other").alias("other"))
    lift = (F.col("toxic") + 0.5) / (toxic + 1) / ((F.col("other") + 0.5) / (other + 1))
    found = counts.where((F.col("toxic") >= max(3, WEAK * toxic)) & (lift >= LIFT) & (F.length("word") > 2)).orderBy(F.desc("toxic"), "word").limit(2 * MOST).collect()
    strong = [r.word for r in found if r.toxic >= max(3, STRONG * toxic)][:MOST]
    return strong, [r.word for r in found if r.word not in set(strong)][:MOST]


def fit(docs: DataFrame, labels: DataFrame, use=None, sample: int = SAMPLE) -> tuple[tuple[list[str], list[str]], BoostedTrees]:
    use = F.lit(True) if use is None else use
    rows = labelled(docs, labels, "toxic", use, sample, lambda d: d.withColumn("value", F.col("text"))).withColumnRenamed("value", "text")
    words = lexicons(rows)
    shared = docs.sparkSession.sparkContext.broadcast(words)
    got = rows.mapInArrow(tidied(_features(shared, "doc_id", "label")), "doc_id long, label int, features array<double>").collect()
    got.sort(key=lambda r: r.doc_id)
    model = BoostedTrees()
    if got:
        model.fit(np.array([r.features for r in got]), np.array([float(r.label) for r in got]))
    else:
        model.cuts, model.knots = [np.zeros(0)] * 12, (np.array([0.0]), np.array([0.5]))
    return words, model


def _scorer(shared):
    def run(batches):
        words, model = shared.value
        features = Features(*words)
        for rows, buf, off in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(model.score(features(buf, off)))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    shared = docs.sparkSession.sparkContext.broadcast(fit(slim, labels, fold("doc_id", FOLDS) != HELD_OUT, sample))
    scored = slim.mapInArrow(tidied(_scorer(shared)), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
