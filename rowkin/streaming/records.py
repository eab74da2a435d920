"""Record normalisation over a stream. Linkage itself is a batch operation: it needs corpus-wide counts and candidates."""

from __future__ import annotations

from pyspark.sql import SparkSession
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from rowkin.operators.normalize import normalise
from rowkin.sources.tables import RECORD


def normalise_stream(spark: SparkSession, source: str, target: str, checkpoint: str, schema: StructType = RECORD) -> StreamingQuery:
    """New Parquet files of ``source`` are normalised and appended to ``target`` exactly once; ends when all present files are done."""
    records = spark.readStream.schema(schema).parquet(source)
    return normalise(records).writeStream.format("parquet").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
