"""Queries over streams: the predicate keeps no state, so the same filter serves a stream."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession

from winnow.operators.engine import Engine, default_engine
from winnow.sources.scratch import shared_dir


def filter_stream(query: str, stream: DataFrame, engine: Engine | None = None) -> DataFrame:
    """The rows of a streaming DataFrame that match."""
    return (engine or default_engine()).filter(query, stream)


def filter_files(spark: SparkSession, folder: str, name: str, query: str, *columns: str) -> DataFrame:
    """The Parquet file ``name`` of a folder read as a stream, filtered, and drained once into the shared folder."""
    schema = spark.read.parquet(f"{folder}/{name}").schema
    stream = spark.readStream.schema(schema).option("pathGlobFilter", name).parquet(folder)
    found = filter_stream(query, stream).select(*columns)
    out = f"{shared_dir(spark)}/winnow/{uuid.uuid4().hex}"
    run = found.writeStream.format("parquet").option("path", f"{out}/rows").option("checkpointLocation", f"{out}/state").trigger(availableNow=True).start()
    run.awaitTermination()
    return spark.read.schema(found.schema).parquet(f"{out}/rows")
