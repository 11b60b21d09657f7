"""Benchmark decontamination by winnowing.

Words are runs of digits, letters and non-ASCII characters, A-Z in lower case. A window is WINDOW consecutive words of
a benchmark item, or all words of a shorter item. Documents and items are fingerprinted alike: of each WINDOW words'
k-grams the least hash is kept, so any shared run of WINDOW words has a fingerprint in common. Fingerprints that meet
are extended: the windows around the hit are looked up and compared word by word, so hashes only find candidates. Items
of fewer words than a window are looked up at every position instead.

The benchmark is the stated query set. It is sent to the executors in blocks of at most BLOCK_BYTES of text, and each
block meets all documents, so what is broadcast is bounded whatever the benchmark's size.
Nulls: a null text (of a document or item) has no words; a null item_id counts as ''. Items without words never
occur. Documents without words have no hits. Rows that repeat an item_id are one item. Empty tables give no hits or
no rows. Columns other than doc_id, text and item_id are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.features import free_name
from quarry.llm.store import digest, written
from quarry.llm.textcore import LOWER, WORD, Words, gram_hash, member, text_chunks, tidied, winnow

WINDOW = 8
GRAM = 5
BLOCK_BYTES = 16_000_000
#: The query calls a document contaminated from two items on; the stage removes it from the first.
MIN_ITEMS, STAGE_ITEMS = 2, 1


class Index:
    """Fingerprints and windows of one block of benchmark items, in arrays: some 60 bytes a word."""

    def __init__(self, items: list[tuple[str, str]], window: int = WINDOW, gram: int = GRAM):
        self.window, self.gram = window, gram
        self.names = sorted({i for i, _ in items})
        number = {x: k for k, x in enumerate(self.names)}
        data = [t.encode() for _, t in items]
        off = np.cumsum([0, *map(len, data)])
        words = Words(np.frombuffer(b"".join(data), np.uint8), off)
        self.bytes, self.s, self.e = LOWER[words.buf].tobytes(), words.s, words.e
        g, ok = gram_hash(words.hash, words.doc, gram)
        self.prints = np.unique(g[winnow(g, ok, window - gram + 1)])
        of = np.array([number[name] for name, _ in items], np.int64)
        counts = words.counts
        #: sizes of windows, and of each size the sorted hashes with the first word and the item of each
        self.tables: dict[int, tuple[np.ndarray, np.ndarray, np.ndarray]] = {}
        for n in sorted({window, *np.unique(counts[(counts > 0) & (counts < window)]).tolist()}):
            h, same = gram_hash(words.hash, words.doc, n)
            at = np.flatnonzero(same & ((counts[words.doc[: len(h)]] == n) | (n == window)))
            order = np.argsort(h[at], kind="stable")
            at = at[order]
            self.tables[n] = (h[at], at, of[words.doc[at]])

    def items(self, n: int, h: int, text: list[bytes]) -> set[int]:
        """Numbers of the items that have the n words as a window."""
        keys, at, of = self.tables[n]
        lo, hi = np.searchsorted(keys, h, "left"), np.searchsorted(keys, h, "right")
        return {int(of[k]) for k in range(lo, hi) if all(self.bytes[self.s[at[k] + j] : self.e[at[k] + j]] == w for j, w in enumerate(text))}


def scan(words: Words, index: Index) -> dict[int, tuple[np.ndarray, set[int]]]:
    """document -> (its words that are hit, numbers of its items)."""
    g, ok = gram_hash(words.hash, words.doc, index.gram)
    at = winnow(g, ok, index.window - index.gram + 1)
    at = at[member(g[at], index.prints)]
    span = index.window - index.gram
    places = np.unique(np.concatenate([at - j for j in range(span + 1)])) if len(at) else at
    found_at: list[tuple[int, int, int]] = []
    for n, (table, _, _) in index.tables.items():
        if n == index.window and not len(places):
            continue
        h, same = gram_hash(words.hash, words.doc, n)
        where = places[(places >= 0) & (places < len(h))] if n == index.window else np.arange(len(h))
        where = where[same[where] & member(h[where], table)]
        found_at += [(s, n, x) for s, x in zip(where.tolist(), h[where])]
    out: dict[int, tuple[np.ndarray, set[int]]] = {}
    seen: dict[int, list[bytes]] = {}
    for s, n, h in sorted(found_at, key=lambda x: x[:2]):
        d = int(words.doc[s])
        a, b = int(words.first[d]), int(words.first[d + 1])
        if d not in seen:
            seen = {d: words.doc_words(d)}  # places are sorted, so one document at a time
        if items := index.items(n, h, seen[d][s - a : s - a + n]):
            hit, found = out.setdefault(d, (np.zeros(b - a, bool), set()))
            hit[s - a : s - a + n] = True
            found |= items
    return out


HITS = "doc_id long, digest binary, n_words long, spans array<struct<lo:int,hi:int>>, items array<string>"


def _matcher(shared):
    def match(batches):
        index = shared.value
        kind = pa.list_(pa.struct([("lo", pa.int32()), ("hi", pa.int32())]))
        for rows, buf, off in text_chunks(batches):
            words = Words(buf, off, WORD, LOWER)
            found = scan(words, index)
            runs, items = [], []
            for d in range(rows.num_rows):
                hit, own = found.get(d, (None, ()))
                edge = np.flatnonzero(np.diff(np.concatenate([[0], hit, [0]]))) if hit is not None else []
                runs.append([{"lo": int(a), "hi": int(b)} for a, b in zip(edge[::2], edge[1::2])])
                items.append(sorted(index.names[i] for i in own))
            yield pa.RecordBatch.from_arrays([rows.column("doc_id").cast(pa.int64()), rows.column("digest"), pa.array(words.counts, pa.int64()), pa.array(runs, kind), pa.array(items, pa.list_(pa.string()))], ["doc_id", "digest", "n_words", "spans", "items"])

    return match


def blocks(benchmark: DataFrame, limit: int = BLOCK_BYTES):
    """Lists of (item_id, text), each of about ``limit`` bytes at most; one is on the driver at a time."""
    items = benchmark.select(F.coalesce(F.col("item_id").cast("string"), F.lit("")).alias("item"), "text").where("text is not null")
    total = items.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = -(-total // (limit // 2)) or 1
    for k in range(n):
        yield [tuple(r) for r in items.where(F.pmod(F.xxhash64("item", "text"), F.lit(n)) == k).toLocalIterator()]


def hits(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, gram: int = GRAM, limit: int = BLOCK_BYTES) -> DataFrame:
    """doc_id, digest (of the text), n_words, spans (runs of hit words) and items of each document."""
    spark = docs.sparkSession
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text")
    parts = []
    for items in blocks(benchmark, limit):
        shared = spark.sparkContext.broadcast(Index(items, window, gram))
        parts.append(slim.mapInArrow(tidied(_matcher(shared)), HITS))
    if len(parts) == 1:
        return parts[0]
    # several blocks: hits follow from the text alone, so they are put together by text; the first block has all rows
    kept = [written(p if k == 0 else p.where(F.size("items") > 0), f"block{k}") for k, p in enumerate(parts)]
    every = kept[0].where(F.size("items") > 0)
    for p in kept[1:]:
        every = every.unionByName(p)
    sets = every.groupBy(F.col("digest").alias("_d")).agg(F.flatten(F.collect_set("spans")).alias("_s"), F.array_distinct(F.flatten(F.collect_set("items"))).alias("_i"))
    both = kept[0].join(sets, F.col("digest") == F.col("_d"), "left")
    return both.select("doc_id", "digest", "n_words", F.coalesce("_s", "spans").alias("spans"), F.coalesce("_i", "items").alias("items"))


def _covered(spans):
    """Words in the union of spans."""
    step = lambda acc, s: F.struct(
        (acc["n"] + F.greatest(F.lit(0), s["hi"] - F.greatest(s["lo"], acc["end"]))).cast("long").alias("n"), F.greatest(acc["end"], s["hi"]).alias("end")
    )
    return F.aggregate(F.sort_array(spans), F.struct(F.lit(0).cast("long").alias("n"), F.lit(0).alias("end")), step)["n"]


def decontaminate(docs: DataFrame, benchmark: DataFrame, min_items: int = MIN_ITEMS, **kw) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated."""
    n = F.size("items").cast("long")
    return hits(docs, benchmark, **kw).select(
        "doc_id", "n_words", _covered(F.col("spans")).alias("n_hit"), n.alias("n_items"),
        F.sha2(F.array_join(F.sort_array("items"), ","), 256).alias("items_sha256"), (n >= min_items).alias("contaminated"),
    )


def stage(docs: DataFrame, benchmark: DataFrame, min_items: int = STAGE_ITEMS, **kw) -> DataFrame:
    """The documents in which no benchmark item's window occurs, whole, with their columns, whatever their names.

    Whether a document goes follows from its text, not its id: the digests of the texts that go are written, and an
    anti-join with them (a table that grows with the contaminated texts only) leaves the rest."""
    gone, own = (free_name(docs.columns, c) for c in ("_gone", "_digest"))
    counted = hits(docs, benchmark, **kw).where(F.size("items") >= min_items)
    bad = written(counted.select(F.col("digest").alias(gone)).distinct(), "contaminated")
    return docs.withColumn(own, digest()).join(bad, F.col(own) == F.col(gone), "left_anti").drop(own)


ORACLE = r"""
WITH d AS (SELECT doc_id, row_number() OVER () AS k, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM documents),
i AS (SELECT coalesce(item_id::VARCHAR, '') AS item, regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w FROM benchmark WHERE text IS NOT NULL),
iw AS (SELECT DISTINCT item, list_aggregate(w[x : x + 7], 'string_agg', ' ') AS gram, least(8, len(w)) AS n FROM (SELECT item, w, unnest(range(1, greatest(1, len(w) - 7) + 1)) AS x FROM i WHERE len(w) > 0)),
sizes AS (SELECT DISTINCT n FROM iw),
dw AS (SELECT k, x, n, list_aggregate(w[x : x + n - 1], 'string_agg', ' ') AS gram FROM (SELECT k, w, n, unnest(range(1, len(w) - n + 2)) AS x FROM d, sizes WHERE len(w) >= n)),
m AS (SELECT k, x, dw.n, item FROM dw JOIN iw ON dw.gram = iw.gram AND dw.n = iw.n),
h AS (SELECT k, count(DISTINCT p) AS n_hit FROM (SELECT k, unnest(range(x, x + n)) AS p FROM m) GROUP BY k),
t AS (SELECT k, count(DISTINCT item) AS n_items, string_agg(DISTINCT item, ',' ORDER BY item) AS items FROM m GROUP BY k)
SELECT doc_id, len(w)::BIGINT AS n_words, coalesce(n_hit, 0)::BIGINT AS n_hit, coalesce(n_items, 0)::BIGINT AS n_items,
       sha256(coalesce(items, '')) AS items_sha256, coalesce(n_items, 0) >= 2 AS contaminated
FROM d LEFT JOIN h USING (k) LEFT JOIN t USING (k)
"""
