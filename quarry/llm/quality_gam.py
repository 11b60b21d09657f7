"""Quality classifier: an additive model with pairwise interactions, learned by cyclic boosting of shallow trees.

It learns from at most SAMPLE labelled documents outside the held-out fold, those of least id hash (one row an id); scoring adds up
looked-up bins of each document's dense features. Nulls: a null text scores as an empty one; null labels are left
out; a null id is in fold 0. Without labels every score is the base rate (0.5). Empty tables give no rows; extra
columns are ignored. Repeated rows are scored alike.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from quarry.llm.features import fold, labelled, with_stats
from quarry.llm.features import Stats
from quarry.llm.learning import AdditiveModel
from quarry.llm.textcore import text_chunks, tidied

SAMPLE = 12_000
FOLDS, HELD_OUT = 4, 2
THRESHOLD = 0.7


def fit(docs: DataFrame, labels: DataFrame, use=None, sample: int = SAMPLE) -> AdditiveModel:
    use = F.lit(True) if use is None else use
    rows = labelled(docs, labels, "quality", use, sample, lambda d: with_stats(d, "counts", "value")).collect()
    rows.sort(key=lambda r: r.doc_id)
    if not rows:
        return AdditiveModel()
    return AdditiveModel().fit(np.array([r.value for r in rows]), np.array([float(r.label) for r in rows]))


def _scorer(shared):
    def run(batches):
        for rows, buf, off in text_chunks(batches):
            yield pa.RecordBatch.from_arrays([rows.column("doc_id"), pa.array(shared.value.score(Stats(buf, off).features))], ["doc_id", "score"])

    return run


def classify(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, held_out, score, predicted."""
    model = docs.sparkSession.sparkContext.broadcast(fit(docs, labels, fold("doc_id", FOLDS) != HELD_OUT, sample))
    slim = docs.select(F.col("doc_id").cast("long").alias("doc_id"), "text")
    scored = slim.mapInArrow(tidied(_scorer(model)), "doc_id long, score double")
    return scored.select("doc_id", (fold("doc_id", FOLDS) == HELD_OUT).alias("held_out"), "score", F.when(F.col("score") >= THRESHOLD, 1).otherwise(0).alias("predicted"))
