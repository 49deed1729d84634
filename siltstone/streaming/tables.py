"""Tables as streams, and streams run to their end."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from ..sources.tables import new_folder, setting

def table_stream(spark: SparkSession, folder: str, name: str, files: int = 64) -> DataFrame:
    """A table of Parquet files as a stream that takes up to `files` files at a time, oldest first; a table can be one file."""
    schema = spark.read.parquet(f"{folder}/{name}.parquet").schema
    # a pattern, as a stream's plain path must be a folder
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files).parquet(f"{folder}/{name}.parque[t]")


def run_to_end(stream: DataFrame, target: str, checkpoint: str) -> StreamingQuery:
    """Append all that `stream` has to Parquet files under `target`, and stop. With the checkpoint of an earlier run it goes on from there."""
    with setting(stream.sparkSession, "spark.sql.streaming.stateStore.providerClass", "org.apache.spark.sql.execution.streaming.state.RocksDBStateStoreProvider"):
        query = stream.writeStream.format("parquet").outputMode("append").option("path", target).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
    query.awaitTermination()
    return query


def finished(stream: DataFrame, name: str) -> DataFrame:
    """What a stream has appended by the end of its input, as a table."""
    spark = stream.sparkSession
    target = new_folder(spark, name)
    run_to_end(stream, target, new_folder(spark, f"{name}-checkpoint"))
    return spark.read.schema(stream.schema).parquet(target)


def late_rows(query: StreamingQuery) -> int:
    """Rows that the query's stateful operators left out because they came after the watermark."""
    return sum(operator["numRowsDroppedByWatermark"] for progress in query.recentProgress for operator in progress["stateOperators"])
