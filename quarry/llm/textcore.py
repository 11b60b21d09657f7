"""Vectorised text primitives over the UTF-8 bytes of Arrow batches.

All functions take a chunk: ``buf`` (uint8, the texts one after another) and ``off`` (int64 offsets, one more than
documents). A chunk holds whole documents, about CHUNK bytes and at most ROWS rows, so memory follows the chunk, not the
batch. A longer document is a chunk of its own and takes some 60 bytes of memory a byte while it is worked on.

Hashes of spans join two polynomials, one modulo 2^64 and one modulo the prime 2^31 - 1, since the first alone is equal
for some pairs of long strings whatever its base (Thue and Morse's).
"""

from __future__ import annotations

import ctypes

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

CHUNK = 1_000_000
ROWS = 4_000
_P = np.uint64(0x9E3779B97F4A7C15 | 1)
_PINV = np.uint64(pow(int(_P), -1, 1 << 64))
_Q = np.uint64((1 << 31) - 1)
_R = np.uint64(1_103_515_245)
_RINV = np.uint64(pow(int(_R), -1, int(_Q)))
_tables: list[np.ndarray] = []


def text_chunks(batches, column: str = "text", limit: int = CHUNK, rows: int = ROWS):
    """(rows, buf, off) for runs of whole rows; null texts count as empty."""
    for batch in batches:
        n = batch.num_rows
        if not n:
            continue
        arr = pc.fill_null(batch.column(column).cast(pa.large_binary()), b"")
        off = np.frombuffer(arr.buffers()[1], np.int64, n + 1, arr.offset * 8)
        data = np.frombuffer(arr.buffers()[2], np.uint8) if arr.buffers()[2] else np.zeros(0, np.uint8)
        i = 0
        while i < n:
            j = min(max(i + 1, int(np.searchsorted(off, off[i] + limit, "right")) - 1), i + rows)
            yield batch.slice(i, j - i), data[off[i] : off[j]], off[i : j + 1] - off[i]
            i = j


def tidied(run):
    """``run`` over batches, after which the worker gives free memory back: it stays for other stages."""

    def tidy(batches):
        yield from run(batches)
        pa.default_memory_pool().release_unused()
        try:
            ctypes.CDLL("libc.so.6").malloc_trim(0)
        except (OSError, AttributeError):  # another C library
            pass

    return tidy


def byte_table(keep) -> np.ndarray:
    return np.array([bool(keep(b)) for b in range(256)])


#: [^\x20\x09-\x0D]+ on bytes
NOT_SPACE = byte_table(lambda b: not (b == 0x20 or 9 <= b <= 13))
#: [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ after lower-casing A-Z
WORD = byte_table(lambda b: 0x30 <= b <= 0x39 or 0x41 <= b <= 0x5A or 0x61 <= b <= 0x7A or b >= 0x80)
LOWER = np.array([b + 32 if 0x41 <= b <= 0x5A else b for b in range(256)], np.uint8)
PLAIN = np.arange(256, dtype=np.uint8)


def mix(h: np.ndarray) -> np.ndarray:
    """splitmix64 finaliser."""
    h = h ^ (h >> np.uint64(30))
    h = h * np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


def _prime_powers(base: np.uint64, n: int) -> np.ndarray:
    """base^i modulo the prime, for i < n, by doubling."""
    out = np.ones(1, np.uint64)
    step = base
    while len(out) < n:
        out = np.concatenate([out, out * step % _Q])
        step = step * step % _Q
    return out[:n].astype(np.uint32)


def _powers(n: int) -> list[np.ndarray]:
    """Powers of both bases and of their inverses; those of a chunk's length are kept."""
    if _tables and n <= len(_tables[0]):
        return [t[:n] for t in _tables]
    size, made = max(n, CHUNK + 1), []
    for base in (_P, _PINV):
        t = np.full(size, base, np.uint64)
        t[0] = 1
        made.append(np.cumprod(t))
    made += [_prime_powers(base, size) for base in (_R, _RINV)]
    if size == CHUNK + 1:
        _tables[:] = made
    return [t[:n] for t in made]


def spans(mask: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Starts, ends and documents of the maximal runs of True, which documents' bounds cut."""
    n = len(mask)
    if not n:
        return np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0, np.int64)
    before, after = np.zeros(n, bool), np.zeros(n, bool)
    before[1:] = mask[:-1]
    after[:-1] = mask[1:]
    full = off[1:] > off[:-1]
    before[off[:-1][full]] = False
    after[off[1:][full] - 1] = False
    s = np.flatnonzero(mask & ~before)
    return s, np.flatnonzero(mask & ~after) + 1, np.searchsorted(off, s, "right") - 1


def prefix_hash(buf: np.ndarray, fold: np.ndarray = PLAIN) -> tuple[np.ndarray, np.ndarray]:
    """Cumulative sums from which span_hash takes the hash of any span."""
    n = len(buf)
    pw, _, rw, _ = _powers(n + 1)
    v = fold[buf].astype(np.uint64)
    v += np.uint64(1)
    cs, ds = np.zeros(n + 1, np.uint64), np.zeros(n + 1, np.uint64)
    np.cumsum(v * pw[:n], out=cs[1:])
    v *= rw[:n]
    if n >= 1 << 24:  # shorter sums can't overflow
        v %= _Q
    np.cumsum(v, out=ds[1:])
    return cs, ds


def gram_bytes(sums: tuple[np.ndarray, np.ndarray], n: int) -> np.ndarray:
    """64-bit hashes of the n bytes from each place, for short n: the first polynomial alone."""
    cs = sums[0]
    _, inv, _, _ = _powers(len(cs))
    k = len(cs) - n
    return mix((cs[n:] - cs[:k]) * inv[:k] + np.uint64(n))


def span_hash(sums: tuple[np.ndarray, np.ndarray], s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[s:e]; equal bytes have equal hashes in any chunk."""
    cs, ds = sums
    _, inv, _, rinv = _powers(len(cs))
    second = (ds[e] - ds[s]) % _Q * rinv[s] % _Q
    return mix((cs[e] - cs[s]) * inv[s] + (e - s).astype(np.uint64) + mix(second))


class Words:
    """Words of a chunk: starts, ends, document of each, hash of each, first word of each document."""

    def __init__(self, buf, off, table=WORD, fold=LOWER):
        self.buf, self.off, self.fold = buf, off, fold
        self.s, self.e, self.doc = spans(table[buf], off)
        self.sums = prefix_hash(buf, fold)
        self.hash = span_hash(self.sums, self.s, self.e)
        self.first = np.searchsorted(self.doc, np.arange(len(off)), "left")

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def text(self, i: int) -> bytes:
        return self.fold[self.buf[self.s[i] : self.e[i]]].tobytes()

    def doc_words(self, d: int) -> list[bytes]:
        a, b = self.first[d], self.first[d + 1]
        base, end = self.off[d], self.off[d + 1]
        data = self.fold[self.buf[base:end]].tobytes()
        return [data[x:y] for x, y in zip((self.s[a:b] - base).tolist(), (self.e[a:b] - base).tolist())]


def gram_hash(h: np.ndarray, doc: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Hash of the k words from each position, and whether these lie in one document."""
    n = len(h) - k + 1
    if n <= 0:
        return np.zeros(0, np.uint64), np.zeros(0, bool)
    g = np.zeros(n, np.uint64)
    for j in range(k):
        g *= np.uint64(0xD6E8FEB86659FD93)
        g += h[j : j + n]
    return mix(g), doc[:n] == doc[k - 1 : k - 1 + n]


def winnow(g: np.ndarray, ok: np.ndarray, w: int) -> np.ndarray:
    """Positions of the least hash (the rightmost of equals) in each run of w hashes that are all ok."""
    n = len(g) - w + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    best, at = g[:n].copy(), np.arange(n)
    whole = ok[:n].copy()
    for j in range(1, w):
        less = g[j : j + n] <= best
        best = np.where(less, g[j : j + n], best)
        at = np.where(less, np.arange(j, j + n), at)
        whole &= ok[j : j + n]
    return np.unique(at[whole])


def member(values: np.ndarray, table: np.ndarray) -> np.ndarray:
    """Which values the sorted table has."""
    if not len(table):
        return np.zeros(len(values), bool)
    at = np.searchsorted(table, values)
    at[at == len(table)] = 0
    return table[at] == values


def per_doc(values: np.ndarray, doc: np.ndarray, n: int) -> np.ndarray:
    return np.bincount(doc, values, n) if len(doc) else np.zeros(n)


def repeated(keys: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Of each key: whether its document has it twice or more, and whether it has it earlier."""
    n = len(keys)
    if not n:
        return np.zeros(0, bool), np.zeros(0, bool)
    x = mix(keys + mix(doc.astype(np.uint64)))
    order = np.argsort(x, kind="stable")
    same = x[order][1:] == x[order][:-1]
    twice, again = np.zeros(n, bool), np.zeros(n, bool)
    twice[order[1:][same]] = True
    again[order[1:][same]] = True
    twice[order[:-1][same]] = True
    return twice, again
