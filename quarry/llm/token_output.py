"""Token-ID output as length-delimited binary records with an offset index.

Format. A shard is a run of records in ascending (doc_id, text hash) order. A record frames one document:
    u64 payload bytes | u32 masked CRC-32 of those 8 bytes | payload | u32 masked CRC-32 of the payload | 0x0A
payload: i64 doc_id, u8 flags (1: doc_id is null; 2: ids are u32, else u16), then the ids. All little-endian.
mask(c) = rotate_right(c, 15) + 0xA282EAD8 mod 2^32. The index is a table beside the shards: shard, offset of the
record in its file, bytes, doc_id, n_tokens, first (ids before it in its shard) and ids_crc32, so that readers can
seek to any record. Shards are written by Spark's own writer and read as binary files, so any file system that Spark
reaches will do. A lost task rewrites its shard from its range.
Nulls: a null text is an empty one and yields the end id alone; null ids come first. Rows that share an id are
ordered by a hash of their texts. An empty table gives no shards and an empty result. Other columns are ignored.
"""

from __future__ import annotations

import json
import os
import struct
import zlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from quarry.llm.store import new_folder, release, small_batches
from quarry.llm.textcore import mix, text_chunks, tidied

END_ID = 2
SHARD_BYTES = 24_000_000
#: Pre-tokens that a worker remembers (some 60 bytes each), and ids above which one isn't kept.
CACHE_WORDS, LONG = 600_000, 64
#: New ones that are kept apart before they are merged with the others.
RECENT = 65_536
#: Pre-tokens that are encoded in one string.
RUN_WORDS = 500
_HEAD = struct.Struct("<QI")
_META = struct.Struct("<qB")


def mask(c: int) -> int:
    return (((c >> 15) | (c << 17)) + 0xA282EAD8) & 0xFFFFFFFF


def frame(payload: bytes) -> bytes:
    n = struct.pack("<Q", len(payload))
    return n + struct.pack("<I", mask(zlib.crc32(n))) + payload + struct.pack("<I", mask(zlib.crc32(payload))) + b"\n"


def pack(doc_id: int | None, ids: np.ndarray) -> bytes:
    wide = bool(len(ids)) and int(ids.max()) > 0xFFFF
    return _META.pack(doc_id or 0, (doc_id is None) + 2 * wide) + ids.astype("<u4" if wide else "<u2").tobytes()


def unpack(payload: bytes) -> tuple[int | None, np.ndarray]:
    doc_id, flags = _META.unpack_from(payload)
    return None if flags & 1 else doc_id, np.frombuffer(payload, "<u4" if flags & 2 else "<u2", offset=_META.size).astype("<u4")


def records(data: bytes):
    """(offset, payload) of each record; a wrong checksum is an error."""
    at = 0
    while at < len(data):
        n, c = _HEAD.unpack_from(data, at)
        if mask(zlib.crc32(data[at : at + 8])) != c:
            raise ValueError(f"record length at {at} is damaged")
        payload = data[at + 12 : at + 12 + n]
        if mask(zlib.crc32(payload)) != struct.unpack_from("<I", data, at + 12 + n)[0] or data[at + 16 + n] != 0x0A:
            raise ValueError(f"record at {at} is damaged")
        yield at, payload
        at += n + 17


# -- encoding ---------------------------------------------------------------------------------------------------

_LETTER, _NUMBER, _SPACE, _OTHER = 1, 2, 3, 4


def _classes() -> np.ndarray:
    """Class of each code point in the vocabulary's split pattern."""
    import regex

    table = np.full(0x110000, _OTHER, np.uint8)
    for lo, hi in ((0, 0xD800), (0xE000, 0x40000), (0xE0000, 0x110000)):  # beyond: none is assigned
        every = np.arange(lo, hi, dtype="<u4").tobytes().decode("utf-32-le")
        for kind, pattern in ((_LETTER, r"\p{L}+"), (_NUMBER, r"\p{N}+"), (_SPACE, r"\s+")):
            for run in regex.findall(pattern, every):
                table[np.frombuffer(run.encode("utf-32-le"), np.uint32)] = kind
    return table


def byte_classes(buf: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """The class of each byte's character, of valid UTF-8."""
    out = classes[:256][buf]
    x = buf.astype(np.uint32) if (buf >= 0xC0).any() else buf
    for size, lo, hi in ((2, 0xC0, 0xE0), (3, 0xE0, 0xF0), (4, 0xF0, 0x100)):
        at = np.flatnonzero((buf >= lo) & (buf < hi))
        if len(at):
            point = x[at] & (0x7F >> size)
            for j in range(1, size):
                point = point << 6 | x[at + j] & 0x3F
            kind = classes[point]
            for j in range(size):
                out[at + j] = kind
    return out


def pieces(buf: np.ndarray, off: np.ndarray, c: np.ndarray) -> np.ndarray:
    """Starts of the pre-tokens: 's|'t|'re|'ve|'m|'ll|'d| ?L+| ?N+| ?[^\\sLN]+|\\s+(?!\\S)|\\s+, texts apart."""
    n = len(buf)
    if not n:
        return np.zeros(0, np.int64)
    first = np.zeros(n + 1, bool)
    first[off] = True
    start = np.ones(n, bool)
    start[1:] = (c[1:] != c[:-1]) | first[1:n]
    space = c == _SPACE
    # the last of a run of white space, before other text: it stands alone, or leads the text if it is a blank
    last = np.flatnonzero(space[:-1] & ~space[1:] & ~first[1:n])
    start[last[buf[last] == 0x20] + 1] = False
    while (inner := (buf[last] & 0xC0) == 0x80).any():
        last = last - inner
    start[last] = True
    # an apostrophe that is a run of its own and that no blank leads takes its ending along
    if n > 1:
        mark = np.flatnonzero((buf[:-1] == 0x27) & start[:-1] & (c[1:] == _LETTER) & ~first[1:n])
        ends = off[np.searchsorted(off, mark, "right")].tolist()
        for i, end in zip(mark.tolist(), ends):
            two = buf[i + 1 : min(i + 3, end)].tobytes()
            k = 2 if two in (b"re", b"ve", b"ll") else 1 if two[:1] in (b"s", b"t", b"m", b"d") else 0
            if k:
                start[i + 1] = False
                if i + 1 + k < end and c[i + 1 + k] == _LETTER:
                    start[i + 1 + k] = True
    return np.flatnonzero(start)


_MASKS = np.array([(1 << 8 * k) - 1 for k in range(9)], np.uint64)


def piece_keys(buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> np.ndarray:
    """64-bit hashes of buf[s:e], eight bytes a round; those of at most eight bytes differ if these do."""
    padded = np.concatenate([buf, np.zeros(8, np.uint8)])
    words = np.ndarray((len(buf) + 1,), "<u8", padded, strides=(1,))
    left = e - s
    h = mix(mix(left.astype(np.uint64)) ^ words[s] & _MASKS[np.minimum(left, 8)])
    live, step = np.flatnonzero(left > 8), 8
    while len(live):
        rest = left[live] - step
        h[live] = mix(h[live] ^ words[s[live] + step] & _MASKS[np.minimum(rest, 8)])
        live, step = live[rest > 8], step + 8
    return h


class Encoder:
    """Encodes texts with the tokenizers library; pre-tokens it has met before are looked up.

    Merges never cross pre-tokens, so a text's ids are its pre-tokens' ids in a row. New ones are encoded many to a
    string, a line feed between them, which is a pre-token of its own. They are known by 64-bit hashes of their bytes.
    Beyond CACHE_WORDS the half that was met least often goes, and so do long ones.
    Vocabularies whose split isn't the one of ``pieces``, and texts that aren't UTF-8, are encoded text by text.
    """

    def __init__(self, path: str):
        from tokenizers import Tokenizer, pre_tokenizers

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        self.tok = Tokenizer.from_file(path)
        parts = json.loads(self.tok.to_str())
        pre = parts["pre_tokenizer"] or {}
        self.split = pre.get("type") == "ByteLevel" and not pre.get("add_prefix_space") and pre.get("use_regex", True) and not parts["normalizer"]
        self.special = [t.content for t in self.tok.get_added_tokens_decoder().values()]
        self.classes = _classes() if self.split else None
        feed = self.tok.encode("\n", add_special_tokens=False).ids
        self.feed = feed[0] if len(feed) == 1 else None
        if self.split:  # for pre-tokens that are cut already
            self.known = Tokenizer.from_file(path)
            self.known.pre_tokenizer = pre_tokenizers.Sequence([pre_tokenizers.Split("\n", "isolated"), pre_tokenizers.ByteLevel(add_prefix_space=False, use_regex=False)])
        self._start(np.zeros(0, np.uint64), np.zeros(0, np.int32), np.zeros(0, np.int32), np.zeros(0, np.uint32))

    def _start(self, key: np.ndarray, n: np.ndarray, met: np.ndarray, ids: np.ndarray):
        """Entries (hash, count of ids, how often it was met) and their ids, one after another; more are appended to them.

        Two sorted lists of hashes lead to entries: a large one and a small one of what is new, so that a chunk's new
        pre-tokens don't move all others."""
        self.size, self.used = len(key), len(ids)
        self.key, self.n, self.met, self.ids = key, n, met, ids
        ends = np.cumsum(n, dtype=np.int64)
        self.at = ends - n
        order = np.argsort(key)
        self.levels = [(key[order], order), (np.zeros(0, np.uint64), np.zeros(0, np.int64))]

    def _append(self, name: str, more: np.ndarray, used: int):
        old = getattr(self, name)
        if used + len(more) > len(old):
            old = np.concatenate([old[:used], np.empty(max(len(more), used, 1 << 14), old.dtype)])
            setattr(self, name, old)
        old[used : used + len(more)] = more

    def _find(self, keys: np.ndarray) -> np.ndarray:
        """Entries of sorted hashes; -1 for unknown ones."""
        out = np.full(len(keys), -1, np.int64)
        for known, entry in self.levels:
            if len(known):
                at = np.searchsorted(known, keys)
                at[at == len(known)] = 0
                hit = known[at] == keys
                out[hit] = entry[at[hit]]
        return out

    def _encode(self, words: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the strings, one after another, and the count of each."""
        found = [e.ids for e in self.tok.encode_batch_fast(words, add_special_tokens=False)]
        n = np.fromiter(map(len, found), np.int64, len(found))
        return np.fromiter((i for x in found for i in x), np.uint32, n.sum()), n

    def _encode_plain(self, buf: np.ndarray, s: np.ndarray, e: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The same of buf[s:e], pre-tokens without white space but for a leading blank: RUN_WORDS to a string."""
        n = e - s + 1  # with the line feed
        ends = np.cumsum(n)
        joined = np.append(buf, np.uint8(0))[np.repeat(s - (ends - n), n) + np.arange(ends[-1])]
        joined[ends - 1] = 10
        cut = [0, *ends[RUN_WORDS - 1 :: RUN_WORDS].tolist(), int(ends[-1])]
        data = joined.tobytes()
        found = self.known.encode_batch_fast([data[a:b].decode() for a, b in zip(cut, cut[1:])], add_special_tokens=False)
        ids = np.concatenate([np.array(x.ids, np.uint32) for x in found])
        feeds = np.flatnonzero(ids == self.feed)
        if len(feeds) != len(s):
            return self._encode([buf[a:b].tobytes().decode() for a, b in zip(s.tolist(), e.tolist())])
        return np.delete(ids, feeds), np.diff(feeds, prepend=-1) - 1

    def _learn(self, keys: np.ndarray, buf: np.ndarray, s: np.ndarray, e: np.ndarray, c: np.ndarray):
        blank = (c[s] == _SPACE) & ((e - s == 1) | (buf[s] != 0x20) | (c[np.minimum(s + 1, len(c) - 1)] == _SPACE))
        if self.feed is None:
            blank[:] = True
        entry = np.empty(len(keys), np.int64)
        for some, plain in ((blank, False), (~blank, True)):
            if some.any():
                a, b = s[some], e[some]
                more, n = self._encode_plain(buf, a, b) if plain else self._encode([buf[x:y].tobytes().decode() for x, y in zip(a.tolist(), b.tolist())])
                entry[some] = np.arange(self.size, self.size + len(n))
                for name, values in (("key", keys[some]), ("n", n), ("met", np.zeros(len(n), np.int32)), ("at", self.used + np.cumsum(n) - n)):
                    self._append(name, values, self.size)
                self._append("ids", more, self.used)
                self.size, self.used = self.size + len(n), self.used + len(more)
        big, small = self.levels[0], self._merged(self.levels[1], (keys, entry))
        self.levels = [big, small] if len(small[0]) < RECENT else [self._merged(big, small), (keys[:0], entry[:0])]

    @staticmethod
    def _merged(a, b):
        key = np.concatenate([a[0], b[0]])
        order = np.argsort(key, kind="stable")  # sorted runs merge
        return key[order], np.concatenate([a[1], b[1]])[order]

    def _sweep(self):
        most = CACHE_WORDS // 2
        n, met = self.n[: self.size], self.met[: self.size]
        keep = n <= LONG
        if np.count_nonzero(keep) > most:
            at = np.flatnonzero(keep)
            keep[at[np.argpartition(-met[at], most)[most:]]] = False
        old, n = self.at[: self.size][keep], n[keep]
        ends = np.cumsum(n, dtype=np.int64)
        ids = self.ids[np.repeat(old - (ends - n), n) + np.arange(int(ends[-1]) if len(ends) else 0)]
        self._start(self.key[: self.size][keep], n, met[keep] // 2, ids)

    def __call__(self, buf: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All ids of a chunk's texts, and the count of each text."""
        data = buf.tobytes()
        try:
            text = data.decode()
        except UnicodeDecodeError:
            text = None
        if text is None or not self.split or any(s in text for s in self.special):
            found = self.tok.encode_batch_fast([data[a:b].decode("utf-8", "replace") for a, b in zip(off.tolist(), off[1:].tolist())], add_special_tokens=False)
            return np.fromiter((i for e in found for i in e.ids), np.uint32), np.array([len(e.ids) for e in found], np.int64)
        del text, data
        c = byte_classes(buf, self.classes)
        s = pieces(buf, off, c)
        if not len(s):
            return np.zeros(0, np.uint32), np.zeros(len(off) - 1, np.int64)
        e = np.append(s[1:], len(buf))
        h = piece_keys(buf, s, e)
        order = np.argsort(h)
        h = h[order]
        lead = np.ones(len(h), bool)
        lead[1:] = h[1:] != h[:-1]
        which = np.empty(len(h), np.int64)
        which[order] = np.cumsum(lead) - 1
        keys, some, at = h[lead], order[lead], np.flatnonzero(lead)
        k = self._find(keys)
        new = k < 0
        if new.any():
            self._learn(keys[new], buf, s[some[new]], e[some[new]], c)
            k[new] = self._find(keys[new])
        self.met[k] += np.diff(at, append=len(h)).astype(np.int32)
        n = self.n[k].astype(np.int64)[which]
        ends = np.cumsum(n)
        ids = self.ids[np.repeat(self.at[k][which] - (ends - n), n) + np.arange(ends[-1])]
        per = np.concatenate([[0], ends])[np.searchsorted(s, off, "left")]
        if self.size > CACHE_WORDS or self.used > 8 * CACHE_WORDS:
            self._sweep()
        return ids, np.diff(per)


_encoders: dict[str, Encoder] = {}


def _writer(path: str, end_id: int):
    def write(batches):
        if path not in _encoders:
            _encoders.clear()
            _encoders[path] = Encoder(path)
        encode = _encoders[path]
        for rows, buf, off in text_chunks(batches):
            ids, counts = encode(buf, off)
            out, at = [], 0
            for doc_id, n in zip(rows.column("doc_id").to_pylist(), counts.tolist()):
                out.append(frame(pack(doc_id, np.append(ids[at : at + n], np.uint32(end_id))))[:-1])  # the writer ends each record
                at += n
            yield pa.RecordBatch.from_arrays([pa.array(out, pa.binary())], ["record"])

    return write


def write_shards(docs: DataFrame, path: str, tokenizer: str, end_id: int = END_ID) -> None:
    """Encode ``docs`` and write its shards to ``path``, in ascending doc_id order over files in name order."""
    spark = docs.sparkSession
    small_batches(spark, 4)
    size = docs.agg(F.sum(F.octet_length("text"))).first()[0] or 0
    n = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-size // SHARD_BYTES))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text").withColumn("_h", F.xxhash64("text"))
    order = [F.col("doc_id").asc_nulls_first(), F.col("_h")]
    ranged = slim.repartitionByRange(n, *order).sortWithinPartitions(*order).drop("_h")
    framed = ranged.mapInArrow(tidied(_writer(tokenizer, end_id)), "record binary")
    framed.select(F.col("record").cast("string").alias("value")).write.option("lineSep", "\n").option("compression", "none").text(path)


INDEX = "shard string, offset long, bytes long, doc_id long, n_tokens long, first long, ids_crc32 long"


def _index(batches):
    names = ["shard", "offset", "bytes", "doc_id", "n_tokens", "first", "ids_crc32"]

    def out(name, rows):
        cols = list(zip(*rows)) if rows else [[]] * 6
        return pa.RecordBatch.from_arrays([pa.array([name] * len(rows), pa.string()), *(pa.array(c, pa.int64()) for c in cols)], names)

    for batch in batches:
        for path, content in zip(batch.column("path").to_pylist(), batch.column("content")):
            name, rows, first = path.rsplit("/", 1)[-1], [], 0
            for at, payload in records(memoryview(content.as_buffer())):
                doc_id, ids = unpack(payload)
                rows.append((at, len(payload) + 17, doc_id, len(ids), first, zlib.crc32(ids.tobytes())))
                first += len(ids)
                if len(rows) == 10_000:
                    yield out(name, rows)
                    rows = []
            yield out(name, rows)


def read_index(spark: SparkSession, path: str) -> DataFrame:
    """The offset index, made by reading the shards back; every checksum is checked on the way."""
    files = spark.read.format("binaryFile").option("pathGlobFilter", "part-*").load(path)
    return files.select("path", "content").mapInArrow(tidied(_index), INDEX)


def token_output(docs: DataFrame, tokenizer: str, path: str | None = None, end_id: int = END_ID) -> DataFrame:
    """Write shards and index under ``path`` (a new shared folder by default).

    Returns doc_id, start, n_tokens, ids_crc32, and where the record is: shard, offset, bytes.
    """
    spark = docs.sparkSession
    path = path or new_folder(spark, "tokens")
    write_shards(docs, f"{path}/shards", tokenizer, end_id)
    release(spark)
    read_index(spark, f"{path}/shards").write.parquet(f"{path}/index")
    index = spark.read.schema(INDEX).parquet(f"{path}/index")
    totals = index.groupBy("shard").agg(F.sum("n_tokens").alias("n"))
    w = Window.orderBy("shard").rowsBetween(Window.unboundedPreceding, -1)  # one row a shard
    before = totals.select(F.col("shard").alias("_shard"), F.coalesce(F.sum("n").over(w), F.lit(0)).alias("_before"))
    return index.join(before, F.col("shard") == F.col("_shard")).select("doc_id", (F.col("_before") + F.col("first")).alias("start"), "n_tokens", "ids_crc32", "shard", "offset", "bytes")
