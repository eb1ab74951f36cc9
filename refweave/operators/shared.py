"""Tables that a plan uses more than once, written to the folder that all executors share."""

from __future__ import annotations

import tempfile
import uuid

from pyspark.sql import DataFrame


def shared(df: DataFrame, name: str) -> DataFrame:
    """`df` written as Parquet in spark.checkpoint.dir and read back: computed once, whatever executors are lost later.

    Where the setting is absent, on a single machine, the folder is one of our own.
    """
    spark = df.sparkSession
    found = spark.conf.get("spark.checkpoint.dir", None)
    if not found and not spark.sparkContext.master.startswith("local"):
        raise ValueError("spark.checkpoint.dir must name a folder that the driver and all executors share")
    path = f"{(found or tempfile.gettempdir() + '/checkpoints').rstrip('/')}/linkage/{name}-{uuid.uuid4().hex}"
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)
