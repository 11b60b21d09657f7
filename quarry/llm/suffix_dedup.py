"""Suffix dedup: removes each byte that a LENGTH-byte string covers which also starts earlier in the corpus.

Of every LENGTH bytes the least hashed GRAM-byte string is an anchor (minimizers), so equal LENGTH-byte strings have
equal anchors at equal places, and only suffixes at anchors need sorting: a sparse suffix array.
1. Anchors are dealt by their hash with a hash of their context (all bytes of any LENGTH-byte string they can be the
   anchor of). Copies within a chunk are settled before the shuffle. Of anchors with equal contexts all but the first
   are covered whole; rows stream by in sorted order, so a group of any size takes no memory.
2. Anchors that occur with several contexts are the edges of repeats. The first of each context is sent with its bytes
   to the group that shares its right 62 or left 39 bytes and more (one of which every LENGTH-byte string has).
3. In a group the suffixes are sorted deep-shallow: multikey quicksort on eight-byte characters to a shallow depth,
   blind tries for what is still equal there. Each node of the sorted suffixes' tree is a right match; the longest
   left match with an earlier member, found among sorted reversed left parts, decides what is covered. No pairs.
   A group of more than MOST members is not held: its LENGTH-byte strings go on by their hashes, and of equal ones all but
   the first are covered.
Hashes decide equality in step 1 and of such strings (64 bits from two polynomials; in step 1 the anchor's own hash has to
be equal besides), bytes in step 3.

Order is by doc_id, then by the text's 64-bit hash, then start; a null doc_id comes first. So texts that share an id, or
have none, are documents of their own, named by id and hash. Of rows that repeat both, all but one are covered whole if
they have LENGTH bytes. A null text has no bytes. Empty tables give no rows; extra columns are ignored.
"""

from __future__ import annotations

import bisect
import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.store import release, small_batches, written
from quarry.llm.textcore import gram_bytes, mix, prefix_hash, span_hash, text_chunks, tidied

LENGTH = 100
GRAM = 24
SHALLOW = 64
#: Members of a group that are held and sorted (some 1 KB each); the strings of larger groups are dealt out by their hashes.
MOST = 100_000
_REACH = LENGTH - GRAM
_RIGHT = GRAM + _REACH // 2
_LEFT = LENGTH - _RIGHT + 1
_NONE = -(1 << 63)
ANCHOR, COVER = 0, 1


def sliding(x: np.ndarray, w: int, op) -> np.ndarray:
    """op over each w neighbours, by doubling."""
    span = 1
    while 2 * span <= w:
        x = op(x[: len(x) - span], x[span:])
        span *= 2
    return op(x[: len(x) - (w - span)], x[w - span :]) if w > span else x


def anchors(buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Document, place, hash and context hash of each anchor of a chunk."""
    n, w = len(buf), _REACH + 1
    none = np.zeros(0, np.int64)
    if n < LENGTH:
        return none, none, none.astype(np.uint64), none.astype(np.uint64)
    cs = prefix_hash(buf)
    g = gram_bytes(cs, GRAM)
    low = sliding((g >> np.uint64(32)).astype(np.uint32), w, np.minimum)  # of each LENGTH bytes
    ends = np.repeat(off[1:], np.diff(off))
    ok = np.arange(len(low)) + LENGTH <= ends[: len(low)]
    # an anchor is the least of some LENGTH bytes: compare it with the greatest of the least around it
    pad = np.zeros(w - 1, np.uint32)
    top = sliding(np.concatenate([pad, np.where(ok, low, 0).astype(np.uint32), pad]), w, np.maximum)[: len(g)]
    pos = np.flatnonzero(((g >> np.uint64(32)).astype(np.uint32) == top) & (top > 0))
    doc = np.searchsorted(off, pos, "right") - 1
    pos = pos[inside := pos + GRAM <= off[doc + 1]]
    doc = doc[inside]
    lo, hi = np.maximum(pos - _REACH, off[doc]), np.minimum(pos + LENGTH, off[doc + 1])
    c = mix(span_hash(cs, lo, hi) + mix((pos - lo).astype(np.uint64)))
    return doc, pos - off[doc], g[pos], c


_ROW = "h long, c long, doc long, sub long, pos int, kind byte"


def _rows(h, c, doc, sub, pos, kind):
    return pa.RecordBatch.from_arrays([pa.array(h.view(np.int64)), pa.array(c.view(np.int64)), pa.array(doc), pa.array(sub), pa.array(pos.astype(np.int32)), pa.array(kind.astype(np.int8))], ["h", "c", "doc", "sub", "pos", "kind"])


def _anchor_rows(batches):
    for rows, buf, off in text_chunks(batches):
        d, pos, h, c = anchors(buf, off)
        doc, sub = (rows.column(k).to_numpy()[d] for k in ("doc", "sub"))
        order = np.lexsort((pos, sub, doc, c, h))
        h, c, doc, sub, pos = h[order], c[order], doc[order], sub[order], pos[order]
        same = np.zeros(len(h), bool)
        same[1:] = (h[1:] == h[:-1]) & (c[1:] == c[:-1])
        first = np.maximum.accumulate(np.where(same, 0, np.arange(len(h)))) if len(h) else order
        again = same & ((doc != doc[first]) | (sub != sub[first]) | (pos != pos[first]))
        h = np.where(again, mix(h + doc.astype(np.uint64) + sub.astype(np.uint64)), h)  # what is settled travels anywhere
        yield _rows(h, c, doc, sub, pos, again)


MARK = "doc long, sub long, pos int, kind byte"


def _settle(batches):
    """Rows sorted by (h, c, doc, sub, pos) -> covered anchors, and the first of each context of anchors with several."""

    def out(doc, sub, pos, kind):
        return pa.RecordBatch.from_arrays([pa.array(doc.astype(np.int64)), pa.array(sub.astype(np.int64)), pa.array(pos.astype(np.int32)), pa.array(np.full(len(doc), kind, np.int8))], ["doc", "sub", "pos", "kind"])

    first = None  # of the open (h, c)
    held, near = None, False  # the last first, and whether its h has had another context
    for batch in batches:
        h, c, doc, sub, pos, kind = (batch.column(k).to_numpy() for k in ("h", "c", "doc", "sub", "pos", "kind"))
        done = kind == COVER
        if done.any():
            yield out(doc[done], sub[done], pos[done], COVER)
            h, c, doc, sub, pos = h[~done], c[~done], doc[~done], sub[~done], pos[~done]
        if not len(h):
            continue
        x = np.stack([h, c, doc, sub, pos.astype(np.int64)])
        if first is not None:
            x = np.concatenate([first, x], 1)
        new = np.ones(x.shape[1], bool)
        new[1:] = (x[0, 1:] != x[0, :-1]) | (x[1, 1:] != x[1, :-1])
        lead = np.maximum.accumulate(np.where(new, np.arange(len(new)), 0))
        again = ~new & (x[2:] != x[2:, lead]).any(0)
        yield out(*x[2:, again], COVER)
        first = x[:, lead[-1:]]
        f = x[:, new]
        same = f[0, 1:] == f[0, :-1]
        many = np.zeros(f.shape[1], bool)
        many[1:] |= same
        many[:-1] |= same
        many[0] |= near
        yield out(*f[2:, :-1][:, many[:-1]], ANCHOR)
        held, near = f[:, -1], bool(many[-1])
    if held is not None and near:
        yield out(held[2:3], held[3:4], held[4:5], ANCHOR)


CONTEXT = "key long, doc long, sub long, pos int, before int, bytes binary"


def _contexts(batches):
    """Documents with their places of edges -> the bytes around each, by what is shared on either side."""
    for rows, buf, off in text_chunks(batches):
        marks = rows.column("places")
        n = np.diff(marks.offsets.to_numpy())
        d = np.repeat(np.arange(rows.num_rows), n)
        p = marks.flatten().to_numpy().astype(np.int64) + off[d]
        if not len(p):
            continue
        cs = prefix_hash(buf)
        lo, hi = np.maximum(p - _REACH, off[d]), np.minimum(p + LENGTH, off[d + 1])
        right, left = p + _RIGHT <= hi, p - _LEFT >= lo
        doc, sub = (rows.column(k).to_numpy()[d] for k in ("doc", "sub"))
        for side, ok in ((0, right), (1, left)):
            a, b = (p, p + _RIGHT) if side == 0 else (p - _LEFT, p + GRAM)
            k = mix(span_hash(cs, a[ok], b[ok]) + np.uint64(side))
            data = pa.array([buf[x:y].tobytes() for x, y in zip(lo[ok], hi[ok])], pa.binary())
            yield pa.RecordBatch.from_arrays([pa.array(k.view(np.int64)), pa.array(doc[ok]), pa.array(sub[ok]), pa.array((p - off[d])[ok].astype(np.int32)), pa.array((p - lo)[ok].astype(np.int32)), data], ["key", "doc", "sub", "pos", "before", "bytes"])


# -- sorting ----------------------------------------------------------------------------------------------------


def common(a: bytes, b: bytes) -> int:
    m = min(len(a), len(b))
    return m - (int.from_bytes(a[:m], "big") ^ int.from_bytes(b[:m], "big")).bit_length().__add__(7) // 8


class BlindTrie:
    """A trie of branching places only: a search skips bytes, and one comparison with the leaf it ends at places the string."""

    def __init__(self, strings: list[bytes], which: list[int]):
        self.strings = strings
        self.root: object = [which[0]]  # a leaf is a list of equal strings
        for i in which[1:]:
            self._insert(i)

    def _insert(self, i: int):
        s, node = self.strings[i], self.root
        while isinstance(node, dict):
            node = node["at"].get(s[node["skip"] : node["skip"] + 1]) or next(iter(node["at"].values()))
        leaf = self.strings[node[0]]
        k = common(s, leaf)
        if k == len(s) == len(leaf):
            node.append(i)
            return
        # down again to the edge on which place k lies
        parent, key, node = None, b"", self.root
        while isinstance(node, dict) and node["skip"] < k:
            parent, key = node, s[node["skip"] : node["skip"] + 1]
            node = node["at"][key]
        if isinstance(node, dict) and node["skip"] == k:
            node["at"][s[k : k + 1]] = [i]
            return
        fork = {"skip": k, "at": {leaf[k : k + 1]: node, s[k : k + 1]: [i]}}
        if parent is None:
            self.root = fork
        else:
            parent["at"][key] = fork

    def order(self) -> list[int]:
        out, stack = [], [self.root]
        while stack:
            node = stack.pop()
            if isinstance(node, list):
                out += node
            else:
                stack += [node["at"][k] for k in sorted(node["at"], reverse=True)]
        return out


def deep_shallow(strings: list[bytes], shallow: int = SHALLOW) -> list[int]:
    """Indices in sorted order: multikey quicksort by eight bytes at a time to the shallow depth, then blind tries."""
    out: list[int] = []
    stack: list[tuple[list[int], int]] = [(list(range(len(strings))), 0)]
    while stack:
        part, depth = stack.pop()
        if len(part) < 2 or depth < 0:
            out += part
        elif depth >= shallow:
            out += BlindTrie(strings, part).order()
        else:
            keys = [strings[i][depth : depth + 8] for i in part]
            pivot = sorted((keys[0], keys[len(keys) // 2], keys[-1]))[1]
            less, equal, more = [], [], []
            for i, k in zip(part, keys):
                (less if k < pivot else more if k > pivot else equal).append(i)
            stack += [(more, depth), (equal, depth + 8 if len(pivot) == 8 else -1), (less, depth)]
    return out


def covered(group: list[tuple[tuple[int, int], int, int, bytes]]) -> list[tuple[tuple[int, int], int, int]]:
    """(doc, lo, hi) that an earlier member covers; group: (doc, pos, bytes before pos, bytes) in ascending order."""
    right = [b[k:] for _, _, k, b in group]
    left = [b[:k][::-1] for _, _, k, b in group]
    order = deep_shallow(right)
    depth = [common(right[i], right[j]) for i, j in zip(order, order[1:])]
    found: dict[int, tuple[int, int]] = {}  # all spans of a member hold its place, so their union is one span
    # every interval of the common-prefix table is a node: its members share ``least`` bytes to the right
    open_: list[tuple[int, int]] = []
    nodes = []
    for i in range(len(order)):
        d, start = depth[i] if i < len(depth) else 0, i
        while open_ and open_[-1][0] > d:
            least, start = open_.pop()
            nodes.append((least, start, i + 1))
        if d >= GRAM and (not open_ or open_[-1][0] < d):
            open_.append((d, start))
    for least, a, b in nodes:
        seen: list[bytes] = []
        for m in sorted(order[a:b]):
            k = bisect.bisect_left(seen, left[m])
            best = max((common(left[m], seen[j]) for j in (k - 1, k) if 0 <= j < len(seen)), default=-1)
            if best >= 0 and best + least >= LENGTH:
                x, y = found.get(m, (0, 0))
                found[m] = (max(x, best), max(y, least))
            if k == len(seen) or seen[k] != left[m]:
                seen.insert(k, left[m])
    return [(group[m][0], group[m][1] - x, group[m][1] + y) for m, (x, y) in found.items()]


SPAN = "doc long, sub long, lo int, hi int, h long"


def _spans(rows):
    cols = list(zip(*rows)) if rows else [()] * 5
    kinds = (pa.int64(), pa.int64(), pa.int32(), pa.int32(), pa.int64())
    return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(cols, kinds)], ["doc", "sub", "lo", "hi", "h"])


def _windows(group: list[tuple[tuple[int, int], int, int, bytes]]):
    """Every LENGTH-byte string of the contexts, with its hash."""
    buf = np.frombuffer(b"".join(g[3] for g in group), np.uint8)
    size = np.array([len(g[3]) for g in group], np.int64)
    n = np.maximum(size - LENGTH + 1, 0)
    which = np.repeat(np.arange(len(group)), n)
    inner = np.arange(int(n.sum())) - np.repeat(np.cumsum(n) - n, n)
    at = (np.cumsum(size) - size)[which] + inner
    h = span_hash(prefix_hash(buf), at, at + LENGTH).view(np.int64)
    doc, sub, pos, before = (np.array(c, np.int64)[which] for c in zip(*((*d, p, k) for d, p, k, _ in group)))
    lo = pos - before + inner
    return pa.RecordBatch.from_arrays([pa.array(doc), pa.array(sub), pa.array(lo.astype(np.int32)), pa.array((lo + LENGTH).astype(np.int32)), pa.array(h)], ["doc", "sub", "lo", "hi", "h"])


def _comparer(most: int):
    """Contexts sorted by (key, doc, sub, pos) -> covered spans; of groups of over ``most`` members the hashed strings (h)."""

    def close(group):
        # equal places of rows that repeat id and text are one
        rows = [g for i, g in enumerate(group) if not i or g[:2] != group[i - 1][:2]]
        return _spans([(*d, a, b, None) for d, a, b in (covered(rows) if len(rows) > 1 else [])])

    def compare(batches):
        key, group, hot = None, [], False
        for batch in batches:
            for k, doc, sub, *row in zip(*(batch.column(c).to_pylist() for c in ("key", "doc", "sub", "pos", "before", "bytes"))):
                if k != key:
                    if group and hot:
                        yield _windows(group)
                    elif len(group) > 1:
                        yield close(group)
                    key, group, hot = k, [], False
                group.append(((doc, sub), *row))
                if len(group) > most:
                    yield _windows(group)
                    group, hot = [], True
        if group:
            yield _windows(group) if hot else close(group)

    return compare


def _cut(batches):
    for rows, buf, off in text_chunks(batches):
        n, removed, runs, digest = [], [], [], []
        for d, (nth, spans) in enumerate(zip(rows.column("nth").to_pylist(), rows.column("spans").to_pylist())):
            text = buf[off[d] : off[d + 1]]
            size = len(text)
            edge = np.zeros(size + 1, np.int64)
            if nth > 1 and size >= LENGTH:
                spans = [{"lo": 0, "hi": size}]
            for s in spans or ():
                edge[min(max(s["lo"], 0), size)] += 1
                edge[min(s["hi"], size)] -= 1
            gone = np.cumsum(edge[:size]) > 0
            n.append(size)
            removed.append(int(gone.sum()))
            runs.append(int(np.count_nonzero(np.diff(np.concatenate([[False], gone]).astype(np.int8)) == 1)))
            digest.append(hashlib.sha256(text[~gone].tobytes()).hexdigest())
        ids = rows.column("doc_id")
        yield pa.RecordBatch.from_arrays([ids, pa.array(n, pa.int64()), pa.array(removed, pa.int64()), pa.array(runs, pa.int64()), pa.array(digest, pa.string())], ["doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256"])


def _named(docs: DataFrame) -> DataFrame:
    """doc (the id, least for null), sub (the text's hash), doc_id, text."""
    i = F.col("doc_id").cast("long")
    return docs.select(F.coalesce(i, F.lit(_NONE)).alias("doc"), F.xxhash64("text").alias("sub"), i.alias("doc_id"), "text")


def repeats(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc, sub, spans: the covered spans of each document that has any."""
    rows = _named(docs).drop("doc_id")
    dealt = rows.mapInArrow(tidied(_anchor_rows), _ROW).repartition("h").sortWithinPartitions("h", "c", "doc", "sub", "pos")
    marks = written(dealt.mapInArrow(tidied(_settle), MARK), "marks")
    release(docs.sparkSession)
    places = marks.where(F.col("kind") == ANCHOR).groupBy(F.col("doc").alias("_doc"), F.col("sub").alias("_sub")).agg(F.collect_set("pos").alias("places"))
    edges = rows.hint("merge").join(places, (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub"))).select("doc", "sub", "text", "places")
    contexts = edges.mapInArrow(tidied(_contexts), CONTEXT).repartition("key").sortWithinPartitions("key", "doc", "sub", "pos")
    spans = written(contexts.mapInArrow(tidied(_comparer(most)), SPAN), "spans")
    release(docs.sparkSession)
    strings, spans = spans.where("h is not null"), spans.where("h is null").drop("h")
    if not strings.isEmpty():
        # of equal strings all but the first are covered; the first is found by partial sums, then all meet it
        place = F.struct("doc", "sub", "lo")
        first = strings.groupBy("h").agg(F.min(place).alias("first"))
        spans = spans.unionByName(strings.join(first, "h").where(place != F.col("first")).select("doc", "sub", "lo", "hi").distinct())
    whole = marks.where(F.col("kind") == COVER).select("doc", "sub", (F.col("pos") - _REACH).alias("lo"), (F.col("pos") + LENGTH).alias("hi"))
    return spans.unionByName(whole).groupBy("doc", "sub").agg(F.collect_set(F.struct("lo", "hi")).alias("spans"))


def suffix_dedup(docs: DataFrame, most: int = MOST) -> DataFrame:
    """doc_id, n_bytes, n_removed, n_spans, kept_sha256."""
    small_batches(docs.sparkSession)
    spans = repeats(docs, most).select(F.col("doc").alias("_doc"), F.col("sub").alias("_sub"), "spans")
    both = _named(docs).hint("merge").join(spans, (F.col("doc") == F.col("_doc")) & (F.col("sub") == F.col("_sub")), "left")
    nth = F.row_number().over(Window.partitionBy("doc", "sub").orderBy("doc"))  # of rows that repeat id and text; the join deals and sorts for it
    return both.select("doc_id", "text", "spans", nth.alias("nth")).mapInArrow(tidied(_cut), "doc_id long, n_bytes long, n_removed long, n_spans long, kept_sha256 string")
