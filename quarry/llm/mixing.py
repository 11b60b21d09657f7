"""Mixing sources to target weights by nested hash-threshold histograms.

Each document has a 60-bit hash of its id. A source that is to give a share of its words takes all documents under a
hash threshold. The threshold is found without sorting: words are summed by source and hash bucket, the bucket in
which the budget ends is the only one that is split further, and this goes on until that bucket holds one hash.
Nulls: a null text has no words, a null source is a source of its own (last in order), a null id is hashed as 'null'.
Rows that share an id share a hash and are taken together. An empty table gives an empty result. Only the columns
doc_id, text and source are read; others, whatever their names, are ignored by ``mix``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from quarry.llm.features import free_name
from quarry.llm.store import written

WEIGHTS = (5, 2, 1)
SHARE = 1.5
MOST = 2
HASH_BITS = 60
STEP = 12
WORD_PATTERN = r"[^\x20\x09-\x0D]+"


def id_hash(col: Column) -> Column:
    return F.conv(F.substring(F.md5(F.coalesce(col.cast("string"), F.lit("null"))), 1, 15), 16, 10).cast("long")


def targets(by_source: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """source, source_size -> also target: shares by weight, none above ``most`` times its source's size.

    Sources in order of cap / weight: those that reach their cap are the first ones of this order, so running sums
    give the level that the rest share. One row a source; nothing of the documents passes here.
    """
    k = F.row_number().over(Window.orderBy(F.col("source").asc_nulls_last())) - 1
    weight = F.element_at(F.array(*[F.lit(int(w)) for w in weights]), (k % len(weights) + 1).cast("int")).cast("long")
    ranked = by_source.withColumn("weight", weight).withColumn("cap", F.lit(most) * F.col("source_size"))
    by_ratio = Window.orderBy((F.col("cap").cast("double") / F.col("weight")), F.col("source").asc_nulls_last())
    before, every = by_ratio.rowsBetween(Window.unboundedPreceding, -1), Window.partitionBy()
    left = ranked.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum("cap").over(before), F.lit(0))).alias("rest"),
        (F.sum("weight").over(every) - F.coalesce(F.sum("weight").over(before), F.lit(0))).alias("rest_weight"),
    )
    full = left.withColumn("full", F.col("weight") * F.col("rest") / F.col("rest_weight") > F.col("cap"))
    shared = full.select(
        "*",
        (F.lit(share) * F.sum("source_size").over(every) - F.coalesce(F.sum(F.when(F.col("full"), F.col("cap"))).over(every), F.lit(0))).alias("pool"),
        F.sum(F.when(~F.col("full"), F.col("weight"))).over(every).alias("pool_weight"),
    )
    target = F.when(F.col("full"), F.col("cap").cast("double")).otherwise(F.col("weight") * F.col("pool") / F.col("pool_weight"))
    return shared.select("source", "source_size", target.alias("target"))


def _sized(docs: DataFrame) -> DataFrame:
    size = F.coalesce(F.regexp_count("text", F.lit(WORD_PATTERN)), F.lit(0)).cast("long")
    return written(docs.select("doc_id", "source", size.alias("size"), id_hash(F.col("doc_id")).alias("h")), "sizes")


def rules(sizes: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """One row a source: rule_source, source_size, target, whole (repeats of all its documents), rest (words still to
    give) and under (documents whose hash is less are taken once more; null: all of them)."""
    goals = targets(sizes.groupBy("source").agg(F.sum("size").alias("source_size")), weights, share, most)
    whole = F.when(F.col("source_size") > 0, F.least(F.lit(most), F.floor(F.col("target") / F.col("source_size")))).otherwise(0).cast("long")
    goals = written(goals.withColumn("whole", whole).withColumn("rest", F.col("target") - F.col("whole") * F.col("source_size")), "goals")

    found, bits = None, 0
    # edge: the source's open bucket (its hash prefix), the words before it, and the rest of the budget
    edge = goals.where("rest > 0").select("source", "rest", F.lit(0).cast("long").alias("prefix"), F.lit(0).cast("long").alias("base"))
    while bits < HASH_BITS:
        at = F.shiftright("h", HASH_BITS - bits) if bits else F.lit(0).cast("long")
        bits += STEP
        e = edge.withColumnRenamed("source", "edge_source")
        inside = sizes.join(e, F.col("source").eqNullSafe(F.col("edge_source")) & (at == F.col("prefix"))).drop("edge_source")
        hist = inside.groupBy("source", "rest", "base", F.shiftright("h", HASH_BITS - bits).alias("bucket")).agg(F.sum("size").alias("words"), F.min("h").alias("h_min"), F.max("h").alias("h_max"))
        w = Window.partitionBy("source").orderBy("bucket")
        run = hist.withColumn("base", F.col("base") + F.sum("words").over(w) - F.col("words"))
        last = run.where("base + words > rest").groupBy("source").agg(F.min_by(F.struct("rest", "bucket", "base", "words", "h_min", "h_max"), "bucket").alias("b")).select("source", "b.*")
        last = written(last, f"edge{bits}")
        done = last if bits >= HASH_BITS else last.where("h_min = h_max")
        # the one hash left goes in if the sum is then nearer to the budget
        done = done.select("source", F.when(F.col("base") + F.col("words") - F.col("rest") < F.col("rest") - F.col("base"), F.col("h_max") + 1).otherwise(F.col("h_min")).alias("under"))
        found = done if found is None else found.unionByName(done)
        edge = last.where("h_min < h_max").select("source", "rest", F.col("bucket").alias("prefix"), "base")
        if edge.isEmpty():
            break
    f = found.withColumnRenamed("source", "found_source")
    return goals.join(f, F.col("source").eqNullSafe(F.col("found_source")), "left").select(F.col("source").alias("rule_source"), "source_size", "target", "whole", "rest", "under")


def _times(h, most: int = MOST, whole: str = "whole", rest: str = "rest", under: str = "under"):
    # a rest that all documents together don't exceed has no edge: everything is taken once more
    more = F.when((F.col(rest) > 0) & (F.col(under).isNull() | (h < F.col(under))), 1).otherwise(0)
    return F.least(F.lit(most), F.col(whole) + more)


def mix(docs: DataFrame, weights=WEIGHTS, share: float = SHARE, most: int = MOST) -> DataFrame:
    """doc_id, size, source_size, target, taken (``size`` times the repeats of the document in the mix)."""
    sizes = _sized(docs)
    joined = sizes.join(rules(sizes, weights, share, most), F.col("source").eqNullSafe(F.col("rule_source")))
    return joined.select("doc_id", "size", "source_size", "target", (F.col("size") * _times(F.col("h"), most)).cast("long").alias("taken"))


def stage(docs: DataFrame) -> DataFrame:
    """The mixed corpus: each document as many times as the mix takes it, with the columns of ``docs``, whatever their names.

    The rules, one row a source, are joined to the documents; no text is shuffled by document."""
    mine = {c: free_name(docs.columns, f"_{c}") for c in ("rule_source", "whole", "rest", "under", "copy")}
    r = rules(_sized(docs)).select(*[F.col(c).alias(n) for c, n in mine.items() if c != "copy"])
    joined = docs.join(r, F.col("source").eqNullSafe(F.col(mine["rule_source"])))
    times = _times(id_hash(F.col("doc_id")), MOST, mine["whole"], mine["rest"], mine["under"]).cast("int")
    return joined.withColumn(mine["copy"], F.explode(F.array_repeat(F.lit(0), times))).select(*[F.col(f"`{c}`") for c in docs.columns])


ORACLE = r"""
WITH sized AS (
  SELECT doc_id, source, coalesce(len(regexp_extract_all(text, '[^\x20\x09-\x0D]+')), 0)::BIGINT AS size,
         ('0x' || substr(md5(coalesce(doc_id::VARCHAR, 'null')), 1, 15))::BIGINT AS h
  FROM documents),
src AS (SELECT source, sum(size)::BIGINT AS source_size FROM sized GROUP BY source),
w AS (SELECT *, [5, 2, 1][((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 + 1)::INT] AS weight, 2 * source_size AS cap FROM src),
l AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE
         - coalesce(sum(cap) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::DOUBLE AS rest,
         (sum(weight) OVER ())::BIGINT - coalesce(sum(weight) OVER (ORDER BY cap::DOUBLE / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0)::BIGINT AS rest_weight
      FROM w),
f AS (SELECT *, weight * rest / rest_weight > cap AS is_full FROM l),
p AS (SELECT *, 1.5::DOUBLE * (sum(source_size) OVER ())::DOUBLE - coalesce(sum(CASE WHEN is_full THEN cap END) OVER (), 0)::DOUBLE AS pool,
         (sum(CASE WHEN NOT is_full THEN weight END) OVER ())::BIGINT AS pool_weight FROM f),
t AS (SELECT source, source_size, CASE WHEN is_full THEN cap::DOUBLE ELSE weight * pool / pool_weight END AS target FROM p),
g AS (SELECT *, CASE WHEN source_size > 0 THEN least(2, floor(target / source_size)) ELSE 0 END::BIGINT AS whole FROM t),
r AS (SELECT *, target - whole * source_size AS rest FROM g),
c AS (SELECT s.doc_id, s.size, r.source_size, r.target, r.whole, r.rest, h,
         (sum(size) OVER (PARTITION BY s.source ORDER BY h RANGE BETWEEN UNBOUNDED PRECEDING AND CURRENT ROW))::BIGINT AS upto,
         (sum(size) OVER (PARTITION BY s.source, h))::BIGINT AS own
      FROM sized s JOIN r ON s.source IS NOT DISTINCT FROM r.source)
SELECT doc_id, size, source_size, target,
       (size * least(2, whole + CASE WHEN rest > 0 AND (upto <= rest OR (upto - own <= rest AND upto - rest < rest - (upto - own))) THEN 1 ELSE 0 END))::BIGINT AS taken
FROM c
"""
