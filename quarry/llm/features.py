"""Counts and dense features of whole texts, vectorised over Arrow batches."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from quarry.llm.store import written
from quarry.llm.textcore import NOT_SPACE, PLAIN, Words, byte_table, gram_hash, per_doc, repeated, span_hash, spans, text_chunks, tidied

#: Byte classes of the histogram.
_KINDS = ("other", "lower", "upper", "digit", "blank", "newline", "lead", "tail", "symbol", "shout", "ask", "stop")
_KIND = np.zeros(256, np.int64)
for _b in range(256):
    _c = chr(_b)
    _KIND[_b] = (
        6 if _b >= 0xC0 else 7 if _b >= 0x80 else 1 if "a" <= _c <= "z" else 2 if "A" <= _c <= "Z" else 3 if "0" <= _c <= "9" else 5 if _c == "\n"
        else 4 if _b == 0x20 or 9 <= _b <= 13 else 8 if _c in "#*$%&|<>" else 9 if _c == "!" else 10 if _c == "?" else 11 if _c in ".,;:" else 0
    )
_NOT_NEWLINE = byte_table(lambda b: b != 10)

COUNTS = ("n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words")
FEATURES = (
    "log_words", "word_length", "symbols", "dup_lines", "repeats", "capitals", "digits", "shouts",
    "stops", "asks", "line_words", "non_ascii", "distinct_words", "others",
)


def histogram(buf: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Bytes of each kind in each document."""
    n, kinds = len(off) - 1, len(_KINDS)
    return np.bincount(np.repeat(np.arange(n) * kinds, np.diff(off)) + _KIND[buf], minlength=kinds * n).reshape(n, kinds)


class Stats:
    """COUNTS and FEATURES of a chunk's documents; an empty text has zeros."""

    def __init__(self, buf: np.ndarray, off: np.ndarray):
        n = len(off) - 1
        self.words = w = Words(buf, off, NOT_SPACE, PLAIN)
        self.hist = histogram(buf, off)
        k = {name: self.hist[:, i] for i, name in enumerate(_KINDS)}
        n_words = w.counts
        chars = np.diff(off) - k["tail"]
        word_chars = chars - k["blank"] - k["newline"]

        s, e, of = spans(_NOT_NEWLINE[buf], off)
        at = np.searchsorted(w.s, s, "left")
        full = at < len(w.s)
        full[full] = w.s[at[full]] < e[full]  # lines with a word
        s, e, of = s[full], e[full], of[full]
        lines = np.bincount(of, minlength=n)
        dup = per_doc(repeated(span_hash(w.sums, s, e), of)[1], of, n)

        g, ok = gram_hash(w.hash, w.doc, 3)
        at = np.flatnonzero(ok)
        twice = at[repeated(g[at], w.doc[at])[0]]
        hit = np.zeros(len(w.hash), bool)
        for j in range(3):
            hit[twice + j] = True
        rep = per_doc(hit, w.doc, n)
        fresh = per_doc(~repeated(w.hash, w.doc)[1], w.doc, n)

        self.counts = np.stack([n_words, word_chars, k["symbol"], dup, rep], 1).astype(np.int64)
        some, letters = np.maximum(n_words, 1), np.maximum(k["lower"] + k["upper"] + k["lead"], 1)
        self.features = np.stack([
            np.log1p(n_words), word_chars / some, k["symbol"] / some, dup / np.maximum(lines, 1), rep / some, k["upper"] / letters, k["digit"] / np.maximum(chars, 1), k["shout"] / some,
            k["stop"] / some, k["ask"] / some, n_words / np.maximum(lines, 1), k["lead"] / np.maximum(chars, 1), fresh / some, k["other"] / some,
        ], 1)


def free_name(columns, name: str) -> str:
    while name.lower() in {c.lower() for c in columns}:
        name += "_"
    return name


def with_stats(docs: DataFrame, counts: str, features: str) -> DataFrame:
    """``docs`` with two more columns: an array of COUNTS and an array of FEATURES. Columns may have any names."""
    plain = [f"c{k}" for k in range(len(docs.columns))]
    text = plain[docs.columns.index("text")]

    def run(batches):
        for rows, buf, off in text_chunks(batches, text):
            x = Stats(buf, off)
            cols = [pa.array(list(x.counts), pa.list_(pa.int64())), pa.array(list(x.features), pa.list_(pa.float64()))]
            yield pa.RecordBatch.from_arrays([*rows.columns, *cols], [*rows.schema.names, "counts", "features"])

    kinds = [T.StructField(c, f.dataType) for c, f in zip(plain, docs.schema.fields)]
    made = [T.StructField("counts", T.ArrayType(T.LongType())), T.StructField("features", T.ArrayType(T.DoubleType()))]
    return docs.toDF(*plain).mapInArrow(tidied(run), T.StructType([*kinds, *made])).toDF(*docs.columns, counts, features)


def fold(doc_id: str, parts: int) -> F.Column:
    """crc32 of the id as text, modulo ``parts``; a null id is in fold 0."""
    return F.coalesce(F.crc32(F.col(doc_id).cast("string").cast("binary")) % parts, F.lit(0))


def labelled(docs: DataFrame, labels: DataFrame, label: str, use, bound: int, fields) -> DataFrame:
    """doc_id, label and ``value`` of at most ``bound`` labelled documents: those whose ids have the least hashes.

    Null labels are left out; an id with several labels has the greatest. ``fields`` maps rows of doc_id, label, text to
    rows that also have ``value``, what is learned from. Of rows that repeat an id the one whose text has the least hash
    counts, so there is one row an id, the same one in each run. The sample is written once."""
    lab = labels.where(F.col("doc_id").isNotNull() & F.col(label).isNotNull() & use).groupBy("doc_id").agg(F.max(label).cast("int").alias("label"))
    lab = lab.orderBy(F.xxhash64("doc_id"), "doc_id").limit(bound)  # ``bound`` pairs of numbers: safe to broadcast
    rows = fields(docs.select("doc_id", "text").join(F.broadcast(lab), "doc_id"))
    order = F.struct(F.xxhash64("text"), F.sha2(F.col("text"), 256))
    one = rows.groupBy("doc_id", "label").agg(F.min_by("value", order).alias("value"))
    return written(one.select(F.col("doc_id").cast("long").alias("doc_id"), "label", "value"), "sample")
