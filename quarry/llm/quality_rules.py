"""Quality rules: a learned decision list over text statistics, emitted as an ordered Spark conditional expression.

Base rule: fewer than MIN_WORDS words, or over half of the words in repeated three-word windows. The list is learned
by sequential covering from the statistics of at most SAMPLE labelled documents (those of least id hash); its rules
reject. Nulls: a null text has no words, so it fails the base rule; null labels are left out; a null id is as good as
any. Without labels of both kinds the list is empty and the base rule alone decides. Empty tables give no rows. Extra
columns are ignored, and kept by ``stage`` under their own names.
"""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from quarry.llm.features import COUNTS, FEATURES, free_name, labelled, with_stats
from quarry.llm.learning import Test, decision_list

SAMPLE = 12_000
MIN_WORDS = 50


def learn(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> list[list[Test]]:
    rows = labelled(docs, labels, "quality", F.lit(True), sample, lambda d: with_stats(d, "counts", "value")).collect()
    rows.sort(key=lambda r: r.doc_id)
    if len({r.label for r in rows}) < 2:
        return []
    return decision_list(np.array([r.value for r in rows]), np.array([1.0 - r.label for r in rows]))


def verdict(rules: list[list[Test]], features: str) -> Column:
    """kept: false where a rule of the list holds, tried in order; true where none does."""
    out = None
    for rule in rules:
        test = F.lit(True)
        for t in rule:
            x = F.col(features)[t.feature]
            test = test & ((x > t.cut) if t.above else (x <= t.cut))
        out = F.when(test, False) if out is None else out.when(test, False)
    return F.lit(True) if out is None else out.otherwise(True)


def spoken(rules: list[list[Test]]) -> list[str]:
    """The list for readers."""
    return ["reject if " + " and ".join(f"{FEATURES[t.feature]} {'>' if t.above else '<='} {t.cut:.6g}" for t in r) for r in rules]


def base_failed(counts: str) -> Column:
    words, repeat = F.col(counts)[0], F.col(counts)[4]
    return (words < MIN_WORDS) | (100 * repeat > 50 * words)


def quality_rules(docs: DataFrame, labels: DataFrame, sample: int = SAMPLE) -> DataFrame:
    """doc_id, the counts, base_failed, kept."""
    rules = learn(docs, labels, sample)
    x = with_stats(docs.select("doc_id", "text"), "counts", "features")
    return x.select("doc_id", *[F.col("counts")[i].alias(c) for i, c in enumerate(COUNTS)], base_failed("counts").alias("base_failed"), (~base_failed("counts") & verdict(rules, "features")).alias("kept"))


def stage(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """The documents that the rules keep; decided as the rows stream by, without a join."""
    rules = learn(docs, labels)
    counts, features = free_name(docs.columns, "_counts"), free_name(docs.columns, "_features")
    return with_stats(docs, counts, features).where(~base_failed(counts) & verdict(rules, features)).drop(counts, features)
