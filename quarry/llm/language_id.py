"""Language identification by compression.

Each language has a zstandard raw-content dictionary, cut from documents of that language outside the held-out fold.
A text is compressed in blocks of BLOCK bytes, each with every dictionary, and the language whose dictionary gives the
least total is chosen. A relative margin under MARGIN to the next is a rejection: ``sure`` is false, and with ``reject``
the language is 'und'; without, as in the query, the best guess stays. Nulls: a null text, or one without a letter
(of Unicode's categories L), is 'und' with score 0; a null lang isn't learned; a null id is in fold 0. Without any learned
language every text is 'und'. Ties go to the language that is first in code point order. Dictionaries share TOTAL bytes,
so many languages have smaller ones. Empty tables give no rows; extra columns are ignored; repeated rows are alike.
"""

from __future__ import annotations

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.features import fold
from quarry.llm.textcore import tidied

FOLDS, HELD_OUT = 3, 1
#: The dictionaries are fitted on about SAMPLE documents a language, PIECE bytes of each, DICTIONARY bytes in all.
SAMPLE, PIECE, DICTIONARY = 300, 1_200, 64_000
#: Bytes of all dictionaries together, and values of lang above which it isn't one of languages: an error, not a cut.
TOTAL, LANGUAGES = 16_000_000, 2_000
BLOCK = 4_096
#: Matches of four bytes and up count; letters are compared in lower case.
LEVEL, SHORTEST = 6, 4
MARGIN = 0.01


def dictionaries(docs: DataFrame, use) -> dict[str, bytes]:
    """Raw content by language, from a bounded sample of documents chosen by the hash of their ids.

    The sampled pieces start where a hash of the id says, so that openings aren't all that is learned."""
    rows = docs.where(F.col("lang").isNotNull() & F.col("text").isNotNull() & use)
    counts = rows.groupBy("lang").count().orderBy("lang").limit(LANGUAGES + 1).collect()
    if not counts:
        return {}
    if len(counts) > LANGUAGES:
        raise ValueError(f"lang has more than {LANGUAGES} values: these are no languages")
    size = min(DICTIONARY, TOTAL // len(counts))
    share = F.create_map(*[F.lit(x) for r in counts for x in (r["lang"], min(1.0, SAMPLE / r["count"]))])
    u = F.pmod(F.xxhash64(F.col("doc_id")), F.lit(1 << 30)) / float(1 << 30)
    at = (F.pmod(F.xxhash64(F.col("doc_id"), F.lit(7)), F.greatest(F.length("text") - PIECE, F.lit(1)))).cast("int") + 1
    picked = rows.where(u < F.coalesce(share[F.col("lang")], F.lit(0.0))).select("lang", F.xxhash64("doc_id").alias("h"), F.substring("text", at, F.lit(PIECE)).alias("piece"))
    out: dict[str, bytes] = {}
    for r in picked.orderBy("h", "lang", "piece").limit(4 * SAMPLE * len(counts)).collect():
        if len(out.get(r.lang, b"")) < size:
            out[r.lang] = out.get(r.lang, b"") + r.piece.lower().encode() + b"\n"
    return {k: v[:size] for k, v in sorted(out.items())}


class Classifier:
    def __init__(self, content: dict[str, bytes]):
        import zstandard as z

        self.names = sorted(content)
        self.packers = []
        for name in self.names:
            d = z.ZstdCompressionDict(content[name], dict_type=z.DICT_TYPE_RAWCONTENT)
            how = z.ZstdCompressionParameters.from_level(LEVEL, dict_size=len(content[name]), source_size=BLOCK, strategy=z.STRATEGY_LAZY, min_match=SHORTEST, write_content_size=False, write_checksum=False, write_dict_id=False)
            d.precompute_compress(compression_params=how)
            self.packers.append(z.ZstdCompressor(dict_data=d, compression_params=how))

    def __call__(self, text: str | None) -> tuple[str, float, bool]:
        """(language, score, sure). The score is the winner's share when sizes are weighed exponentially by margin."""
        if not text or not self.names or not any(map(str.isalpha, text)):
            return "und", 0.0, False
        data = text.lower().encode("utf-8", "replace")
        sizes = [sum(len(p.compress(data[i : i + BLOCK])) for i in range(0, len(data), BLOCK)) for p in self.packers]
        order = sorted(range(len(sizes)), key=lambda k: (sizes[k], k))
        best = sizes[order[0]]
        score = 1 / sum(2.0 ** (-(s - best) / best / MARGIN) for s in sizes)
        sure = len(sizes) < 2 or (sizes[order[1]] - best) / best >= MARGIN
        return self.names[order[0]], score, sure


def _runner(shared, reject: bool):
    def run(batches):
        classify = Classifier(shared.value)
        for b in batches:
            got = [classify(t) for t in b.column("text").to_pylist()]
            name, score, sure = zip(*got) if got else ((), (), ())
            if reject:
                name = [n if ok else "und" for n, ok in zip(name, sure)]
            yield pa.RecordBatch.from_arrays([b.column("doc_id"), pa.array(name, pa.string()), pa.array(score, pa.float64()), pa.array(sure, pa.bool_())], ["doc_id", "lang_pred", "score", "sure"])

    return run


def identify(docs: DataFrame, reject: bool = False) -> DataFrame:
    """doc_id, held_out, lang_pred, score, sure."""
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text", "lang")
    shared = docs.sparkSession.sparkContext.broadcast(dictionaries(slim, fold("doc_id", FOLDS) != HELD_OUT))
    got = slim.select("doc_id", "text").mapInArrow(tidied(_runner(shared, reject)), "doc_id long, lang_pred string, score double, sure boolean")
    return got.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "lang_pred", "score", "sure")
