"""Lineage cuts in the folder that the session's spark.checkpoint.dir names."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def cut(df: DataFrame) -> DataFrame:
    """A checkpointed copy; a folder of our own only where the session has none and runs on this machine alone."""
    spark = df.sparkSession
    sc = spark.sparkContext
    if sc._jsc.sc().getCheckpointDir().isEmpty():
        folder = spark.conf.get("spark.checkpoint.dir", None) or sc.getConf().get("spark.checkpoint.dir")
        if not folder and not sc._jsc.sc().isLocal():
            raise ValueError("spark.checkpoint.dir has to name a folder that driver and executors share")
        sc.setCheckpointDir(folder or "file://" + tempfile.mkdtemp(prefix="quarry-"))
    return df.checkpoint()


def stored(df: DataFrame, name: str) -> DataFrame:
    """A copy as Parquet in the same folder: later reads take only the columns they need."""
    spark = df.sparkSession
    cut(spark.range(0))  # sets the folder
    path = f"{spark.sparkContext._jsc.sc().getCheckpointDir().get()}/{uuid.uuid4().hex}/{name}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
