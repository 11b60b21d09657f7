"""Complete linkage of documents by their sets of 4-grams of words, exactly, without a table of all similar pairs.

Documents with equal sets are one class, which takes part as its least id. Then, of classes:

1. Each set's rarest grams (in one fixed order: grams that chunks of texts have seen often come last, others by hash) are
   its prefix; two sets at the threshold share a number of grams of both prefixes that follows from their sizes, at
   places that are not too far apart (prefix, count and positional filters). The order decides the cost alone.
2. In each gram's list, neighbours by size are held against each other; what may be similar gets one label. In the last
   round all pairs of a list with different labels are held against each other, so every pair at the threshold has one
   label in the end. A pair is ruled out here by how many lists it shares (fewer than all are seen before the last
   round, which tries it again) and by a bound that is never too low: the grams of both sets, counted by hash.
3. A label's sets go to one task, which finds their similarities by an inverted index and joins groups. It keeps a
   bit a pair of sets and at most about PAIRS pairs at once, the best first, and goes over the sets again for the rest.

Sets and grams are told apart by 64-bit hashes.
"""

from __future__ import annotations

from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.store import dropped, release, small_batches, written
from quarry.llm.textcore import LOWER, Words, byte_table, gram_hash, mix, text_chunks, tidied
from quarry.operators.graph import components

#: [a-z0-9]+ of lower-case texts
LETTERS = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A)
#: A gram that so many texts of a chunk have is reported; so many of the most frequent come last in the order.
OFTEN, LAST = 3, 100_000
#: Pairs that a task holds at once.
PAIRS = 8_000_000
#: How far apart the rows of a list may be whose pairs are tried in each round; the last tries all that are left.
ROUNDS = (8, 64, None)
#: Links whose components one task finds.
FEW = 4_000_000
#: Grams that a pair's prefixes share; more are not asked for, as longer prefixes make more pairs.
ENOUGH = 8
#: Labels that are sent to every task; more are joined.
SENT = 2_000_000
_FULL = 15


def gram_sets(buf: np.ndarray, off: np.ndarray, k: int = 4) -> tuple[np.ndarray, np.ndarray]:
    """Distinct gram hashes and their documents, documents in order, hashes sorted within each."""
    w = Words(buf, off, LETTERS, LOWER)
    g, ok = gram_hash(w.hash, w.doc, k)
    g, doc = g[ok], w.doc[: len(g)][ok]
    order = np.lexsort((g, doc))
    g, doc = g[order], doc[order]
    new = np.ones(len(g), bool)
    new[1:] = (g[1:] != g[:-1]) | (doc[1:] != doc[:-1])
    return g[new], doc[new]


def _keys(g: np.ndarray, cut: np.ndarray) -> np.ndarray:
    """A hash of each set."""
    total = np.concatenate([np.zeros(1, np.uint64), np.cumsum(mix(g))])
    return mix(total[cut[1:]] - total[cut[:-1]] + np.diff(cut).astype(np.uint64)).view(np.int64)


def _sketch(g: np.ndarray) -> bytes:
    """Counts of a set's grams by hash, half as many as grams or more, two a byte; _FULL is that many or more."""
    size = max(64, 1 << (len(g) // 2).bit_length())
    n = np.minimum(np.bincount((g & np.uint64(size - 1)).astype(np.int64), minlength=size), _FULL).astype(np.uint8)
    return (n[::2] | n[1::2] << 4).tobytes()


def _bound(a: bytes, b: bytes, na: int, nb: int) -> int:
    """At least as many as the grams that two sets share."""
    x, y = (np.stack([v & 15, v >> 4], 1).ravel().astype(np.int64) for v in (np.frombuffer(a, np.uint8), np.frombuffer(b, np.uint8)))
    x[x == _FULL], y[y == _FULL] = na, nb
    size = min(len(x), len(y))
    return int(np.minimum(x.reshape(-1, size).sum(0), y.reshape(-1, size).sum(0)).sum())


def _gather(batches):
    for rows, buf, off in text_chunks(batches):
        g, doc = gram_sets(buf, off)
        cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        size = np.diff(cut)
        often, times = np.unique(g, return_counts=True)
        many = times >= OFTEN
        lists = [(often[many].view(np.int64), times[many])] + [([], [])] * (rows.num_rows - 1)
        cols = [rows.column("id"), pa.array(_keys(g, cut)), pa.array(size, pa.int32()), pa.array([_sketch(g[a:b]) for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary())]
        cols += [pa.array([x[i] for x in lists], pa.list_(t)) for i, t in ((0, pa.int64()), (1, pa.int64()))]
        yield pa.RecordBatch.from_arrays(cols, ["id", "key", "n", "sketch", "often", "times"])


def _prefixes(often: np.ndarray, times: np.ndarray, threshold: float):
    """The prefix of each set, once a chunk; ``often`` is sorted."""

    def run(batches):
        for rows, buf, off in text_chunks(batches):
            g, doc = gram_sets(buf, off)
            cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
            key, size = _keys(g, cut), np.diff(cut)
            late = np.zeros(len(g), np.int64)
            if len(often):
                place = np.minimum(np.searchsorted(often, g), len(often) - 1)
                late = np.where(often[place] == g, times[place], 0)
            order = np.lexsort((g, late, doc))
            g, at = g[order], np.arange(len(g)) - cut[doc]
            once = np.zeros(rows.num_rows, bool)
            once[np.unique(key, return_index=True)[1]] = True
            keep = once[doc] & (at <= size[doc] - np.ceil(threshold * size[doc] - 1e-9))
            d = doc[keep]
            cols = [pa.array(g[keep].view(np.int64)), pa.array(key[d]), pa.array(size[d], pa.int32()), pa.array(at[keep], pa.int32())]
            yield pa.RecordBatch.from_arrays(cols, ["gram", "key", "n", "at"])

    return run


def _lists(batches):
    """Columns of whole lists of rows that are sorted by gram, each set once in a list."""
    tail = None
    for batch in batches:
        now = {c: batch.column(c).to_numpy() for c in batch.schema.names}
        if not batch.num_rows:
            continue
        if tail is not None:
            now = {c: np.concatenate([tail[c], v]) for c, v in now.items()}
        new = np.ones(len(now["gram"]), bool)
        new[1:] = (now["gram"][1:] != now["gram"][:-1]) | (now["key"][1:] != now["key"][:-1])
        now = {c: v[new] for c, v in now.items()}
        last = int(np.searchsorted(now["gram"], now["gram"][-1]))
        tail = {c: v[last:] for c, v in now.items()}
        if last:
            yield {c: v[:last] for c, v in now.items()}
    if tail is not None:
        yield tail


def _shared(batches):
    """Rows of grams that two sets or more have."""
    for now in _lists(batches):
        g = now["gram"]
        same = g[1:] == g[:-1]
        many = np.zeros(len(g), bool)
        many[1:] |= same
        many[:-1] |= same
        yield pa.RecordBatch.from_arrays([pa.array(v[many]) for v in now.values()], list(now))


def _least_shared(na: np.ndarray, nb: np.ndarray, threshold: float) -> tuple[np.ndarray, np.ndarray]:
    """How many grams two sets at the threshold share, at least (both), and how many of these (need) are among the first
    n - both + need of each: a set has at most n - both that the other lacks, and of these two prefixes the one that ends first
    in the order has no more, and lies within the other. Prefixes that are kept are long enough."""
    both = np.ceil(threshold / (1 + threshold) * (na + nb) - 1e-9).astype(np.int64)
    return both, np.minimum(ENOUGH, both - np.ceil(threshold * np.maximum(na, nb) - 1e-9).astype(np.int64) + 1)


def _pairs(threshold: float, lags: int | None):
    """Pairs (a < b) of a list, sorted by size, that their places and sizes don't rule out: of rows at most ``lags`` apart, or of all
    with different labels. ``need``: in how many lists a pair at the threshold is."""

    def run(batches):
        for now in _lists(batches):
            g, key, n, at = (now[c] for c in ("gram", "key", "n", "at"))
            label = now.get("label", key)
            left, n, at, lag = np.arange(len(g)), n.astype(np.int64), at.astype(np.int64), 0
            while lags is None or lag < lags:
                lag += 1
                left = left[left + lag < len(g)]
                left = left[g[left + lag] == g[left]]
                left = left[n[left] >= threshold * n[left + lag] - 1e-9]  # sizes rise
                if not len(left):
                    break
                other = left + lag
                both, need = _least_shared(n[left], n[other], threshold)
                fit = np.maximum(at[left] - n[left], at[other] - n[other]) < need - both
                # what both may share before this gram, it, and after it
                fit &= np.minimum(at[left], at[other]) + 1 + np.minimum(n[left] - 1 - at[left], n[other] - 1 - at[other]) >= both
                fit &= label[left] != label[other]
                a, b = key[left[fit]], key[other[fit]]
                if len(a):
                    yield pa.RecordBatch.from_arrays([pa.array(np.minimum(a, b)), pa.array(np.maximum(a, b)), pa.array(need[fit], pa.int32())], ["a", "b", "need"])

    return run


def _possible(threshold: float):
    def run(batches):
        for batch in batches:
            rows = zip(*(batch.column(c).to_pylist() for c in ("sa", "sb", "na", "nb")))
            keep = pa.array([_bound(sa, sb, na, nb) >= threshold / (1 + threshold) * (na + nb) - 1e-9 for sa, sb, na, nb in rows], pa.bool_())
            yield batch.select(["a", "b"]).filter(keep)

    return run


class Linkage:
    """Groups of 0..n-1 under merges. ``near`` has a bit for each item that is similar to all members of a group; ``links`` is the
    number of others that an item is similar to."""

    def __init__(self, n: int):
        self.group = np.arange(n)
        self.members = [np.array([i]) for i in range(n)]
        self.near = np.zeros((n, (n + 7) // 8), np.uint8)
        self.links = np.zeros(n, np.int64)
        self.apart: set = set()

    def bits(self, group, item):
        return (self.near[group, item >> 3] >> (item & 7).astype(np.uint8)) & 1

    def live(self, a: np.ndarray, b: np.ndarray) -> np.ndarray:
        """Whether pairs of items may still join their groups."""
        x, y = self.group[a], self.group[b]
        return (x != y) & (self.bits(x, b) & self.bits(y, a)).astype(bool)

    def join(self, a: np.ndarray, b: np.ndarray) -> None:
        """Pairs in order: the groups of each are joined if all of their items are similar. A group is named by its least item."""
        for i in range(0, len(a), 1 << 16):
            p, q = a[i : i + (1 << 16)], b[i : i + (1 << 16)]
            keep = self.live(p, q)
            for u, v in zip(p[keep].tolist(), q[keep].tolist()):
                x, y = sorted((int(self.group[u]), int(self.group[v])))
                if x == y or (x, y) in self.apart:
                    continue
                if not self.bits(x, self.members[y]).all():
                    self.apart.add((x, y))
                    continue
                self.members[x] = np.concatenate([self.members[x], self.members[y]])
                self.group[self.members[y]] = x
                self.near[x] &= self.near[y]


def complete(sets: list[np.ndarray], threshold: float, most: int = PAIRS) -> np.ndarray:
    """For sets, in the order of their names: the least member of each one's group."""
    return linkage(sets, threshold, most).group


def linkage(sets: list[np.ndarray], threshold: float, most: int = PAIRS) -> Linkage:
    """Of sets, in the order of their names. The most similar pairs come first, of equals those that are first by name; the groups
    of a pair are joined if all of their sets are similar."""
    n = len(sets)
    size = np.array([len(s) for s in sets], np.int64)
    doc = np.repeat(np.arange(n), size)
    _, gram = np.unique(np.concatenate(sets), return_inverse=True)
    order = np.argsort(gram, kind="stable")
    posts = doc[order]
    start = np.concatenate([[0], np.cumsum(np.bincount(gram))])
    cut = np.concatenate([[0], np.cumsum(size)])
    out, high, first = Linkage(n), np.inf, True
    while True:
        low, held, kept = threshold, 0, []
        for i in range(n):
            mine = gram[cut[i] : cut[i + 1]]
            both = np.bincount(np.concatenate([posts[start[x] : start[x + 1]] for x in mine.tolist()]), minlength=n)
            sims = both / (size[i] + size - both)
            if first:
                near = sims >= threshold
                near[i] = True
                out.links[i] = near.sum() - 1
                out.near[i] = np.packbits(near, bitorder="little")
            j = i + 1 + np.flatnonzero((sims[i + 1 :] >= low) & (sims[i + 1 :] < high))
            if not first and len(j):
                j = j[out.live(np.full(len(j), i), j)]
            if len(j):
                kept.append((sims[j], np.full(len(j), i), j))
                held += len(j)
            if held > 2 * most:  # the best are kept, with all that are as good as the last of them
                s, a, b = (np.concatenate(c) for c in zip(*kept))
                low = float(np.partition(s, len(s) - most)[len(s) - most])
                good = s >= low
                kept, held = [(s[good], a[good], b[good])], int(good.sum())
        if kept:
            s, a, b = (np.concatenate(c) for c in zip(*kept))
            order = np.lexsort((b, a, -s))
            out.join(a[order], b[order])
        if low <= threshold:
            return out
        high, first = low, False


def _link(threshold: float):
    """Rows sorted by label and id, with their sets -> key, head: the key of the group's first, links: similar sets."""

    def close(keys, sets):
        found = linkage(sets, threshold) if len(sets) > 1 else Linkage(1)
        keys = np.array(keys, np.int64)
        return pa.RecordBatch.from_arrays([pa.array(keys), pa.array(keys[found.group]), pa.array(found.links)], ["key", "head", "links"])

    def run(batches):
        now, keys, sets = None, [], []
        for batch in batches:
            for label, key, own in zip(*(batch.column(c).to_pylist() for c in ("label", "key", "own"))):
                if label != now:
                    if keys:
                        yield close(keys, sets)
                    now, keys, sets = label, [], []
                if not keys or key != keys[-1]:  # rows that are repeated are one
                    keys.append(key)
                    sets.append(np.frombuffer(own, "<u8"))
        if keys:
            yield close(keys, sets)

    return run


def _own(batches):
    for rows, buf, off in text_chunks(batches):
        g, doc = gram_sets(buf, off)
        cut = np.searchsorted(doc, np.arange(rows.num_rows + 1))
        cols = [rows.column("id"), rows.column("label"), rows.column("wanted"), pa.array(_keys(g, cut)), pa.array([g[a:b].astype("<u8").tobytes() for a, b in zip(cut.tolist(), cut[1:].tolist())], pa.binary())]
        yield pa.RecordBatch.from_arrays(cols, ["id", "label", "wanted", "key", "own"])


def least_reached(a: np.ndarray, b: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Ends of links, and the least end that each one's links lead to."""
    ends, at = np.unique(np.concatenate([a, b]), return_inverse=True)
    x, y = at[: len(a)], at[len(a) :]
    low = np.arange(len(ends))
    while len(x):
        least = np.minimum(low[x], low[y])
        np.minimum.at(low, low[x], least)
        np.minimum.at(low, low[y], least)
        while (low[low] != low).any():
            low = low[low]
        open_ = low[x] != low[y]
        x, y = x[open_], y[open_]
    return ends, ends[low]


def _forest(batches):
    """One link for each end of a task's links, to the least that it leads to."""
    a, b = np.zeros(0, np.int64), np.zeros(0, np.int64)
    for batch in batches:
        a, b = least_reached(np.append(a, batch.column("a").to_numpy()), np.append(b, batch.column("b").to_numpy()))
    yield pa.RecordBatch.from_arrays([pa.array(a), pa.array(b)], ["a", "b"])


def _named(links: DataFrame) -> DataFrame:
    """(a, b) -> key, label. Up to FEW links are one task's, after each task has joined its own; more take rounds."""
    kept = links.mapInArrow(tidied(_forest), "a long, b long")
    if links.count() <= FEW:
        comp = kept.repartition(1).mapInArrow(tidied(_forest), "a long, b long").toDF("node", "component")
    else:
        nodes = kept.select(F.col("a").alias("node")).union(kept.select("b")).distinct()
        comp = components(nodes, kept.select(F.col("a").alias("src"), F.col("b").alias("dst")))
    return written(comp.select(F.col("node").alias("key"), F.col("component").alias("label")), "labels")


def complete_documents(docs: DataFrame, id_col: str, text: str, threshold: float) -> DataFrame:
    """node, rep, group, links: for each document the least id with its set of grams, the least of its group by complete linkage of these
    sets, and how many other sets its own is similar to, in its group or not. A text of fewer than four words has no set and is
    alone, as a null one is."""
    spark = docs.sparkSession
    small_batches(spark)
    texts = docs.select(F.col(id_col).alias("id"), F.lower(F.col(text)).alias("text"))
    kind = texts.schema["id"].dataType.simpleString()
    rows = written(texts.mapInArrow(tidied(_gather), f"id {kind}, key long, n int, sketch binary, often array<long>, times array<long>"), "rows")
    top = rows.where(F.size("often") > 0).select(F.explode(F.arrays_zip("often", "times")).alias("o")).groupBy("o.often").agg(F.sum("o.times").alias("times"))
    top = top.orderBy(F.desc("times"), "often").limit(LAST).toArrow()
    often, times = top["often"].to_numpy().view(np.uint64), top["times"].to_numpy()
    order = np.argsort(often)

    columns = "gram long, key long, n int, at int"
    prefix = texts.mapInArrow(tidied(_prefixes(often[order], times[order], threshold)), columns)
    entries = written(prefix.repartition("gram").sortWithinPartitions("gram", "key").mapInArrow(tidied(_shared), columns), "entries")
    release(spark)
    # copies have equal sketches
    sketches = rows.where("n > 0").groupBy("key").agg(F.first("n").alias("n"), F.first("sketch").alias("s"))

    def possible(pairs: DataFrame) -> DataFrame:
        ends = pairs.select(F.col("a").alias("key")).unionByName(pairs.select(F.col("b").alias("key"))).distinct()
        known = written(sketches.join(ends, "key", "left_semi"), "sketches")
        x = pairs.join(known.toDF("a", "na", "sa"), "a").join(known.toDF("b", "nb", "sb"), "b")
        out = written(x.mapInArrow(tidied(_possible(threshold)), "a long, b long"), "links")
        dropped(known)
        release(spark)
        return out

    def listed(df: DataFrame) -> DataFrame:
        return df.repartition("gram").sortWithinPartitions("gram", "n", "key")

    found, tested, labels = [], [], None
    for lags in ROUNDS:
        marked = entries
        if labels is not None:
            marked = entries.join(F.broadcast(labels) if labels.count() <= SENT else labels, "key", "left").select("gram", "key", "n", "at", F.coalesce("label", "key").alias("label"))
        pairs = listed(marked).mapInArrow(tidied(_pairs(threshold, lags)), "a long, b long, need int")
        pairs = pairs.groupBy("a", "b", "need").count().where("count >= need").select("a", "b")
        for old in tested:
            pairs = pairs.join(old, ["a", "b"], "left_anti")
        pairs = written(pairs, "pairs")
        release(spark)
        tested.append(pairs)
        found.append(possible(pairs))
        dropped(*[x for x in [labels] if x is not None])
        labels = _named(reduce(DataFrame.unionByName, found))
    dropped(entries, *tested, *found)

    reps = written(rows.where("n > 0").groupBy("key").agg(F.min("id").alias("id")), "reps")
    wanted = reps.join(labels, "key").select(F.col("id").alias("_id"), F.col("key").alias("wanted"), "label")
    sets = texts.join(wanted, F.col("id").eqNullSafe(F.col("_id"))).select("id", "text", "label", "wanted").mapInArrow(tidied(_own), f"id {kind}, label long, wanted long, key long, own binary")
    linked = sets.where("key = wanted").repartition("label").sortWithinPartitions("label", "id", "key").mapInArrow(tidied(_link(threshold)), "key long, head long, links long")
    linked = written(linked, "linked")
    heads = linked.join(reps.select(F.col("key").alias("head"), F.col("id").alias("group")), "head").select("key", "group", "links")
    named = reps.join(heads, "key", "left").select("key", F.col("id").alias("rep"), F.coalesce("group", "id").alias("group"), "links")
    out = rows.select(F.col("id").alias("node"), F.when(F.col("n") > 0, F.col("key")).alias("key")).join(named, "key", "left")
    return out.select("node", F.coalesce("rep", "node").alias("rep"), F.coalesce("group", "node").alias("group"), F.coalesce("links", F.lit(0)).cast("long").alias("links"))
