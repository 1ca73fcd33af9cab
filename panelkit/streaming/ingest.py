"""Price files as they arrive.

The batch cleaning applies to files one by one, so a stream of files gives the same panel: each file is one ticker's, and
equal rows within it go. New files are taken up once, by the checkpoint.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery

from ..sources.prices import COLUMNS, RAW, clean_prices


def read_stream(spark: SparkSession, folder: str, files_per_batch: int = 1000) -> DataFrame:
    """New CSV files of a folder, with their ``filename``."""
    return spark.readStream.schema(RAW).option("header", True).option("maxFilesPerTrigger", files_per_batch).option("pathGlobFilter", "*.csv").csv(folder).withColumn("filename", F.col("_metadata.file_path"))


def write_stream(raw: DataFrame, out_path: str, checkpoint: str, once: bool = False) -> StreamingQuery:
    """Clean each batch and add it to the panel; a batch that is tried again replaces its own folder."""

    def write(batch: DataFrame, number: int) -> None:
        clean_prices(batch).select(*COLUMNS).write.mode("overwrite").parquet(f"{out_path}/batch={number}")

    writer = raw.writeStream.foreachBatch(write).option("checkpointLocation", checkpoint)
    return (writer.trigger(availableNow=True) if once else writer).start()


def ingest_available(spark: SparkSession, folder: str, out_path: str, checkpoint: str) -> None:
    """Take up all files that are there and weren't taken up before."""
    write_stream(read_stream(spark, folder), out_path, checkpoint, once=True).awaitTermination()
