"""Stateless normalisation of arriving JSONL rows: a file stream in, rows with clean tokens out."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..schemas import BIBITEMS, REFERENCES
from ..sources.papers import postprocess_tokens


def stream(spark: SparkSession, path: str, kind: str = "bibitems") -> DataFrame:
    schema = BIBITEMS if kind == "bibitems" else REFERENCES
    return postprocess_tokens(spark.readStream.schema(schema).option("mode", "DROPMALFORMED").json(path).where("paper_id <> ''"))


def start(rows: DataFrame, out: str, checkpoint: str) -> StreamingQuery:
    """Append the rows that are there now as Parquet, and stop."""
    return rows.writeStream.format("parquet").option("path", out).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
