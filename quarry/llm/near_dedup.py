"""MinHash near-dedup with DartMinHash signatures.

A text is the weighted set of its SHINGLE-word shingles (lower-case words of letters, digits and non-ASCII
characters), a shingle's weight being how often it occurs; a text of fewer words is one shingle. Two texts are linked
if their weighted Jaccard similarity is THRESHOLD or more; classes are the connected components of the links.

Signature: every unit of an element's weight is a region of its own, over which darts are thrown at hashed rising
ranks, each to a hashed coordinate; of each coordinate the earliest dart is kept, named by its rank. The number of darts follows the
number of coordinates, not the text's length. BANDS bands of ROWS coordinates miss a pair at the threshold with a
probability of (1 - 0.8^4)^24 = 3e-6.

Rows with equal texts are one representative (aggregated before anything is joined): the first row of the least id, under
a row number that the written signatures fix, so rows that share an id, or have none, are told apart. A bucket's texts are ordered by
the values of their next band, so that close ones are neighbours, and each is paired with the closest of the few
before it: a forest, not all pairs. Most of a large group is one class after that. Then, in buckets whose texts are still in different classes,
the texts outside the bucket's main class are held against the others' signatures, and pairs of different classes
whose estimate is within 4.4 standard errors of the threshold are compared: short texts at once, where one link to
each other class suffices; of long ones the best first, then all the rest. So every link that could join two classes is tried, and no bucket or partner list is capped. Links are checked on
exact shingle multisets.

Nulls: rows with a null text, and texts without words that differ, are classes of their own; equal texts of any kind
are one class. A null id is a class member like others, but never names a class unless all of its ids are null. One row of
each class is kept, also of repeated rows. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.features import free_name
from quarry.llm.store import digest, dropped, release, small_batches, written
from quarry.llm.textcore import Words, gram_hash, mix, text_chunks, tidied

SHINGLE = 5
THRESHOLD = 0.8
BANDS, ROWS = 24, 4
COORDINATES = 512
#: Signatures that agree on less than this share of coordinates can't be of a link (4.4 standard errors).
ESTIMATE = THRESHOLD - 4.4 * (THRESHOLD * (1 - THRESHOLD) / COORDINATES) ** 0.5
#: Rows before it, in its bucket's order, of which a text is compared with the closest.
LOOK_BACK = 16
#: Texts of at most this many shingles carry them into their buckets, where they are compared exactly at once.
CARRIED = 256
#: Partners of long texts, the best by estimate in a bucket, that each round takes; the last takes all that is left.
ROUNDS = (2, None)
_G = np.uint64(0x9E3779B97F4A7C15)


def shingles(words: Words, k: int = SHINGLE) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes and their documents, documents in order, hashes sorted within each."""
    g, ok = gram_hash(words.hash, words.doc, k)
    g, doc = g[ok], words.doc[: len(g)][ok]
    short = np.flatnonzero((words.counts > 0) & (words.counts < k))
    if len(short):
        extra = np.array([gram_hash(words.hash[words.first[d] : words.first[d + 1]], np.zeros(words.counts[d], int), int(words.counts[d]))[0][0] for d in short], np.uint64)
        g, doc = np.concatenate([g, extra]), np.concatenate([doc, short])
    order = np.lexsort((g, doc))
    return g[order], doc[order]


def units(g: np.ndarray, doc: np.ndarray) -> np.ndarray:
    """A hash for each unit of weight: the n-th copy of a shingle in a document has a hash of its own."""
    if not len(g):
        return g
    at = np.arange(len(g))
    first = np.ones(len(g), bool)
    first[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    copy = at - np.maximum.accumulate(np.where(first, at, 0))
    return mix(g + _G * copy.astype(np.uint64))


def darts(u: np.ndarray, doc: np.ndarray, n: int, k: int) -> np.ndarray:
    """n x k signatures (k a power of two): the rank of the dart that comes first at each coordinate, which names the
    dart, since ranks are hashed. Documents without units have a value that all of them share."""
    best = np.full(n * k, np.inf)
    weight = np.bincount(doc, minlength=n)
    todo, reach = weight > 0, k * (np.log(k) + 2.5)
    while todo.any():
        limit = np.where(todo, reach / np.maximum(weight, 1), 0.0)[doc]
        live = np.flatnonzero(limit > 0)
        rank, seed, limit = np.zeros(len(live)), u[live], limit[live]
        base = doc[live] * k
        while len(base):
            seed = mix(seed + _G)
            rank = rank - np.log(((seed >> np.uint64(11)).astype(np.float64) + 0.5) * 2.0**-53)
            inside = rank <= limit
            base, rank, seed, limit = base[inside], rank[inside], seed[inside], limit[inside]
            np.minimum.at(best, base + (seed & np.uint64(k - 1)).astype(np.int64), rank)
        todo = todo & ~np.isfinite(best.reshape(n, k)).all(1)
        reach *= 2
    return mix(best.view(np.uint64)).reshape(n, k)


def bands(sig: np.ndarray, bands: int, rows: int) -> np.ndarray:
    out = np.empty((len(sig), bands), np.uint64)
    for b in range(bands):
        h = np.full(len(sig), np.uint64(b + 1))
        for j in range(rows):
            h = mix(h * _G + sig[:, b * rows + j])
        out[:, b] = h
    return out


def _sign(batches):
    for rows, buf, off in text_chunks(batches, rows=1_000):  # a row's signatures take some 10 KB on the way
        n = rows.num_rows
        words = Words(buf, off)
        g, doc = shingles(words)
        u = units(g, doc)
        sig = darts(u, doc, n, COORDINATES)
        keys = bands(sig, BANDS, ROWS).view(np.int64)
        short = (sig >> np.uint64(56)).astype(np.uint8)
        cut = np.searchsorted(doc, np.arange(n + 1)).tolist()
        own = [u[a:b].astype("<u8").tobytes() if b - a <= CARRIED else None for a, b in zip(cut, cut[1:])]
        full = words.counts > 0
        lists = [x if f else [] for x, f in zip(keys, full)]
        cols = [rows.column("doc_id"), rows.column("digest"), pa.array(lists, pa.list_(pa.int64())), pa.array([x.tobytes() for x in short], pa.binary()), pa.array(own, pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["doc_id", "digest", "bands", "sig", "own"])


def _sigs(batch) -> np.ndarray:
    col = batch.column("sig")
    return np.frombuffer(b"".join(col.to_pylist()), np.uint8).reshape(len(col), COORDINATES)


def _pairs(a, b):
    a, b = np.asarray(a, np.int64), np.asarray(b, np.int64)
    return pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b))], ["a", "b"])


def _neighbours(batches):
    """Of rows sorted by bucket: each with the closest of the LOOK_BACK rows before it in its bucket, if plausible."""
    tail = None
    for batch in batches:
        bucket, rep, sig = batch.column("bucket").to_numpy(), batch.column("rep").to_numpy(), _sigs(batch)
        new = len(rep)
        if tail is not None:
            bucket, rep, sig = np.append(tail[0], bucket), np.append(tail[1], rep), np.concatenate([tail[2], sig])
        tail = (bucket[-LOOK_BACK:], rep[-LOOK_BACK:], sig[-LOOK_BACK:])
        best, mate = np.zeros(len(rep), np.int64), np.zeros(len(rep), np.int64)
        for lag in range(1, min(LOOK_BACK, len(rep) - 1) + 1):
            at = np.flatnonzero(bucket[lag:] == bucket[:-lag]) + lag
            if not len(at):
                break
            est = np.count_nonzero(sig[at] == sig[at - lag], axis=1)
            up = est > best[at]
            best[at[up]], mate[at[up]] = est[up], at[up] - lag
        at = np.flatnonzero(best >= ESTIMATE * COORDINATES)
        at = at[at >= len(rep) - new]
        yield _pairs(rep[at], rep[mate[at]])


def _alike(a: bytes, b: bytes) -> bool:
    """Whether two texts, each the bytes of its unit hashes, are a link."""
    x, y = np.frombuffer(a, "<u8"), np.frombuffer(b, "<u8")
    if min(len(x), len(y)) < THRESHOLD * max(len(x), len(y)):
        return False
    z = np.sort(np.concatenate([x, y]))
    both = np.count_nonzero(z[1:] == z[:-1])
    return both / (len(z) - both) >= THRESHOLD


def _outsiders(most: int | None):
    """Pairs of different classes in rows sorted by bucket, outsiders first. Texts that carry their shingles are
    compared here, in the first round, and an outsider's links name one row of each class; of others, the ``most``
    plausible pairs by estimate are returned, each in the least bucket that its texts share."""

    def run(batches):
        now, out, sure, best = None, None, [], []

        def close():
            a, b = [], []
            for x, linked, found in zip(out[0] if out else [], sure, best):
                rest = sorted(f for f in found if f[2] not in linked)[:most]
                mates = [*linked.values(), *(f[1] for f in rest)]
                a += [x] * len(mates)
                b += mates
            return _pairs(a, b)

        for batch in batches:
            cols = [batch.column(c).to_numpy(zero_copy_only=False) for c in ("bucket", "rep", "label", "outside")]
            sig, own = _sigs(batch), np.array(batch.column("own").to_pylist(), object)
            keys = batch.column("bands").flatten().to_numpy().reshape(len(sig), BANDS)
            for part in np.split(np.arange(len(sig)), np.flatnonzero(np.diff(cols[0])) + 1):
                if not len(part):
                    continue
                if cols[0][part[0]] != now:
                    yield close()
                    now, out, sure, best = cols[0][part[0]], None, [], []
                rep, label, outside = (c[part] for c in cols[1:])
                s, carried, b = sig[part], own[part], keys[part]
                if outside.any():
                    o = np.flatnonzero(outside)
                    mine = (rep[o], label[o], s[o], carried[o], b[o])
                    out = mine if out is None else tuple(np.concatenate(x) for x in zip(out, mine))
                    sure += [{} for _ in o]
                    best += [[] for _ in o]
                if out is None:
                    continue
                for k, linked in enumerate(sure):
                    est = np.count_nonzero(s == out[2][k], axis=1)
                    for j in np.flatnonzero((est >= ESTIMATE * COORDINATES) & (label != out[1][k])).tolist():
                        named = int(label[j])
                        if out[3][k] is None or carried[j] is None:
                            both = b[j][b[j] == out[4][k]]
                            # rows that share an id may lie in buckets of another row's bands
                            if now not in both or now == both.min():
                                best[k].append((-int(est[j]), int(rep[j]), named))
                        elif most is not None and named not in linked and _alike(out[3][k], carried[j]):
                            linked[named] = int(rep[j])
        yield close()

    return run


def _shingle_rows(batches):
    for rows, buf, off in text_chunks(batches):
        g, doc = shingles(Words(buf, off))
        g = units(g, doc).view(np.int64)
        cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        yield pa.RecordBatch.from_arrays([rows.column("rep"), pa.array([g[a:b] for a, b in zip(cut, cut[1:])], pa.list_(pa.int64()))], ["rep", "g"])


def similarities(a: pa.ListArray, b: pa.ListArray) -> np.ndarray:
    """Jaccard similarity of each pair of lists of distinct unit hashes."""
    keys, sizes = [], []
    for col in (a, b):
        n = np.diff(col.offsets.to_numpy())
        keys.append(mix(col.flatten().to_numpy().view(np.uint64) + mix(np.repeat(np.arange(len(n)), n).astype(np.uint64))))
        sizes.append(n)
    which = np.repeat(np.arange(len(a)), sizes[0])
    small = np.sort(keys[1])
    at = np.minimum(np.searchsorted(small, keys[0]), max(len(small) - 1, 0))
    both = np.bincount(which[small[at] == keys[0]], minlength=len(a)) if len(small) else np.zeros(len(a))
    return both / np.maximum(sizes[0] + sizes[1] - both, 1)


def _verify(batches):
    for batch in batches:
        sims = similarities(batch.column("ga"), batch.column("gb"))
        yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(sims, pa.float64())], ["a", "b", "similarity"])


def components(links: DataFrame) -> DataFrame:
    """node, label: the least node of each connected component of (a, b). Min-label rounds with pointer jumps."""
    both = written(links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct(), "edges")
    now = written(both.groupBy(F.col("a").alias("node")).agg(F.least(F.min("b"), F.first("a")).alias("label")), "labels")
    while True:
        near = both.join(now.withColumnRenamed("node", "b"), "b").groupBy(F.col("a").alias("node")).agg(F.min("label").alias("near"))
        low = now.join(near, "node").select("node", "label", F.least("label", "near").alias("low"))
        up = now.select(F.col("node").alias("low"), F.col("label").alias("jump"))
        nxt = written(low.join(up, "low").select("node", F.least("low", "jump").alias("label"), (F.least("low", "jump") < F.col("label")).alias("moved")), "labels")
        done = nxt.where("moved").isEmpty()
        dropped(now)
        now = nxt.drop("moved")
        now._written_to = nxt._written_to
        if done:
            dropped(both)
            return now


def joined_components(labels: DataFrame, links: DataFrame) -> DataFrame:
    """``labels`` (node, label) after further links: components of the graph whose nodes are the classes so far."""
    named = links.select("a", "b")
    for end in ("a", "b"):
        named = named.join(labels.select(F.col("node").alias(end), F.col("label").alias("_l")), end, "left").withColumn(end, F.coalesce("_l", end)).drop("_l")
    above = components(named.where("a <> b"))
    old = labels.join(above.select(F.col("node").alias("label"), F.col("label").alias("_l")), "label", "left").select("node", F.coalesce("_l", "label").alias("label"))
    out = written(old.unionByName(above.join(labels.select("node"), "node", "left_anti").select("node", "label")), "labels")
    dropped(labels, above)
    return out


class _Classes:
    """Finds classes of representatives; each step's tables lie in the shared folder."""

    def __init__(self, docs: DataFrame):
        small_batches(docs.sparkSession)
        rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), digest().alias("digest"), "text")
        signed = rows.mapInArrow(tidied(_sign), "doc_id long, digest binary, bands array<long>, sig binary, own binary")
        signed = written(signed.withColumn("row", F.monotonically_increasing_id()), "signed")
        #: row, doc_id, digest of each row
        self.rows = written(signed.select("row", "doc_id", "digest"), "rows")
        first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "row")).alias("f")
        same = self.rows.where("digest is not null").groupBy("digest").agg(first)
        #: digest, rep (the row that stands for the text) and its doc_id
        self.reps = written(same.select("digest", F.col("f.row").alias("rep"), F.col("f.doc_id").alias("doc_id")), "reps")
        self.docs = rows
        # the signatures of representatives
        ids = self.reps.select(F.col("rep").alias("row"))
        own = written(signed.where(F.size("bands") > 0).hint("merge").join(ids, "row", "left_semi").withColumnRenamed("row", "rep").drop("digest", "doc_id"), "own")
        dropped(signed)
        flat = own.select("rep", F.explode("bands").alias("bucket"))
        shared = flat.groupBy("bucket").agg(F.count("*").alias("n")).where("n > 1").select("bucket")
        members = written(flat.hint("merge").join(shared, "bucket", "left_semi"), "members")
        release(docs.sparkSession)
        sigs = own.hint("merge").join(members.select("rep").distinct(), "rep", "left_semi")
        self.sigs = written(sigs.select("rep", "bands", "sig", "own"), "sigs")
        nxt = F.try_element_at("bands", ((F.array_position("bands", F.col("bucket")) % BANDS) + 1).cast("int"))
        self.slim = written(members.join(self.sigs.select("rep", "bands"), "rep").select("bucket", "rep", nxt.alias("next")), "slim")
        dropped(own, members)
        # only texts that share a bucket are ever compared: their shingles are made once
        needed = self.reps.join(self.sigs.select("rep"), "rep", "left_semi").select("rep", F.col("digest").alias("_d"), F.coalesce("doc_id", F.lit(0)).alias("_id"))
        texts = self.docs.withColumn("digest", F.coalesce("digest", F.expr("X''"))).hint("merge").join(needed, (F.col("digest") == F.col("_d")) & (F.coalesce("doc_id", F.lit(0)) == F.col("_id"))).select("rep", "text").mapInArrow(tidied(_shingle_rows), "rep long, g array<long>")
        self.texts = written(texts, "shingles")
        release(docs.sparkSession)

    def verified(self, pairs: DataFrame) -> DataFrame:
        """Of candidate pairs (a, b) in the shared folder: those that are links."""
        ids = written(pairs.select(F.col("a").alias("rep")).unionByName(pairs.select(F.col("b").alias("rep"))).distinct(), "ids")
        texts = self.texts.join(ids, "rep", "left_semi").dropDuplicates(["rep"])
        joined = pairs.join(texts.select(F.col("rep").alias("a"), F.col("g").alias("ga")), "a").join(texts.select(F.col("rep").alias("b"), F.col("g").alias("gb")), "b")
        # sizes too different for a link keep a hopeless pair from being compared
        la, lb = F.size("ga"), F.size("gb")
        maybe = joined.where(F.least(la, lb) >= THRESHOLD * F.greatest(la, lb))
        out = written(maybe.mapInArrow(tidied(_verify), "a long, b long, similarity double").where(F.col("similarity") >= THRESHOLD), "links")
        dropped(ids)
        release(self.docs.sparkSession)
        return out

    def run(self) -> tuple[DataFrame, DataFrame]:
        """(links, labels of linked representatives)."""
        chain = self.slim.join(self.sigs.drop("bands"), "rep").repartition("bucket").sortWithinPartitions("bucket", "next", "rep")
        tested = written(chain.mapInArrow(tidied(_neighbours), "a long, b long").where("a <> b").distinct(), "pairs")
        links = self.verified(tested)
        labels, pairs = components(links), [tested]
        for most in ROUNDS:
            named = self.slim.select("bucket", "rep").distinct().join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
            sizes = named.groupBy("bucket", "label").agg(F.count("*").alias("n"))
            main = sizes.groupBy("bucket").agg(F.max_by("label", F.struct("n", "label")).alias("main"), F.count("*").alias("k")).where("k > 1").drop("k")
            open_ = named.join(main, "bucket").withColumn("outside", F.col("label") != F.col("main")).drop("main")
            rows = open_.join(self.sigs, "rep").repartition("bucket").sortWithinPartitions("bucket", F.desc("outside"))
            found = rows.mapInArrow(tidied(_outsiders(most)), "a long, b long").distinct()
            new = written(found.join(tested, ["a", "b"], "left_anti"), "pairs")
            if new.isEmpty():
                continue
            tested = tested.unionByName(new)
            pairs.append(new)
            more = self.verified(new)
            if more.isEmpty():
                continue
            links = links.unionByName(more)
            labels = joined_components(labels, more)
        dropped(self.slim, self.sigs, self.texts, *pairs)
        return links, labels

    def decided(self) -> DataFrame:
        """doc_id, digest, class_id, rep, kept of each row."""
        return _decided(self.rows, self.reps, self.run()[1])


def _decided(rows: DataFrame, all_reps: DataFrame, labels: DataFrame) -> DataFrame:
    reps = all_reps.join(labels.withColumnRenamed("node", "rep"), "rep", "left").withColumn("label", F.coalesce("label", "rep"))
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "rep")).alias("f")
    heads = reps.groupBy("label").agg(first).select("label", F.col("f.doc_id").alias("class_id"), F.col("f.rep").alias("head"))
    named = reps.join(heads, "label").select(F.col("digest").alias("_d"), F.col("doc_id").alias("rep"), "class_id", "head")
    out = rows.join(named, F.col("digest") == F.col("_d"), "left")
    alone = F.col("digest").isNull()
    return out.select("doc_id", "digest", F.coalesce("class_id", "doc_id").alias("class_id"), F.coalesce("rep", "doc_id").alias("rep"), (alone | (F.col("row") == F.col("head"))).alias("kept"))


def near_dedup(docs: DataFrame) -> DataFrame:
    """doc_id, class_id (the least doc_id of the class), rep (the least doc_id with the same text), kept (one row a class)."""
    return _Classes(docs).decided().drop("digest")


def stage(docs: DataFrame) -> DataFrame:
    """One document of each class, with the columns of ``docs``. An id whose rows all go is dropped by itself; rows without
    an id, or of an id of which a part stays, are decided by id and text."""
    c = _Classes(docs)
    each = written(c.decided().groupBy("doc_id", "digest").agg(F.bool_or("kept").alias("kept"), F.count("*").alias("n")), "decided")
    dropped(c.rows, c.reps)
    i, d, own, key = (free_name(docs.columns, c) for c in ("_id", "_d", "_digest", "_key"))
    ids = written(each.where("doc_id is not null").groupBy(F.col("doc_id").alias(i)).agg(F.bool_or("kept").alias("stays")).where("not stays").select(i), "dropped")
    left = docs.join(ids, F.col("doc_id").cast("long") == F.col(i), "left_anti")
    rest = each.where("digest is not null and (not kept or n > 1)").join(ids, F.col("doc_id") == F.col(i), "left_anti")
    rest = written(rest.select(F.col("doc_id").alias(i), F.col("digest").alias(d), F.col("kept").alias(key)), "parts")
    dropped(each)
    if rest.isEmpty():
        return left
    same = F.col("doc_id").cast("long").eqNullSafe(F.col(i)) & (F.col(own) == F.col(d))
    keyed = left.withColumn(own, digest())
    once = keyed.join(rest.where(F.col(key)), same, "left_semi").withColumn(key, F.col("doc_id").cast("long")).dropDuplicates([key, own])
    return keyed.join(rest, same, "left_anti").drop(own).unionByName(once.drop(key, own))
