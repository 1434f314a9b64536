"""Frames that several parts of a plan read, and sides small enough to broadcast."""

from __future__ import annotations

import tempfile
import uuid

import pandas as pd
from pyspark.sql.classic.dataframe import DataFrame
from pyspark.sql import functions as F


def kept(df: DataFrame) -> DataFrame:
    """Computed once, and a short plan for what follows: in the cluster's checkpoint folder where one is set, which also cuts
    lineage; else kept by Spark, as in tests."""
    spark = df.sparkSession
    if spark.sparkContext._jsc.sc().getCheckpointDir().isDefined():
        return df.checkpoint()
    rows = df.persist()._jdf
    return DataFrame(spark._jsparkSession.createDataFrame(rows.javaRDD(), rows.schema()), spark)


def small(df: DataFrame, most: int = 100_000, otherwise: str | None = None) -> DataFrame:
    """The frame with a broadcast hint if it has at most `most` rows; a larger one is joined as Spark sees fit, or by the hint
    `otherwise`."""
    if df.limit(most + 1).count() <= most:
        return F.broadcast(df)
    return df.hint(otherwise) if otherwise else df


def scratch_folder(spark, label: str) -> str:
    """A new folder's name under the one that all executors share (`spark.checkpoint.dir`); where that is unset and Spark runs in
    one process, as in tests, under a temporary one. What is written there stays until it is removed by hand."""
    root = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getConf().get("spark.checkpoint.dir")
    if not root:
        if not spark.sparkContext.master.startswith("local") or spark.sparkContext.master.startswith("local-cluster"):
            raise ValueError("set spark.checkpoint.dir to a folder that the driver and all executors share")
        root = "file://" + tempfile.gettempdir()
    return f"{root.rstrip('/')}/engram-{label}-{uuid.uuid4().hex[:12]}"


_DTYPES = {"string": object, "int": "int32", "long": "int64", "double": "float64"}


def rows_of(rows: list[tuple], schema: str) -> pd.DataFrame:
    """Rows as a pandas frame of a schema of plain types; without rows its columns still have their types, which Arrow needs."""
    fields = [c.split() for c in schema.split(", ")]
    frame = pd.DataFrame(rows, columns=[n for n, _ in fields])
    return frame if rows else frame.astype({n: _DTYPES[k] for n, k in fields})
