"""Continuous indexing: new rows of a folder are packed into chunks as they come, and counted per case in windows of time."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.streaming import StreamingQuery
from pyspark.sql.types import StructType

from lexmill.operators import sections
from lexmill.sources.files import write_index


def arrivals(spark: SparkSession, folder: str, schema: StructType, files_per_trigger: int = 64) -> DataFrame:
    """Rows of the Parquet files that come into a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_per_trigger).parquet(folder)


def deliveries_by_case(stream: DataFrame, lateness: str = "21 days", width: str = "7 days") -> DataFrame:
    """Deliveries of each case in windows of their own time; a row delivered twice counts once, as long as it comes within the lateness."""
    once = stream.withColumn("added_at", F.col("added_at").cast("timestamp")).withWatermark("added_at", lateness).dropDuplicatesWithinWatermark(["doc_id"])
    return once.groupBy(F.window("added_at", width).alias("w"), "case_id").agg(F.count("*").alias("n")).select(F.col("w.start").alias("start"), "case_id", "n")


def index_continuously(stream: DataFrame, index: str, checkpoint: str, limit: int = 384, overlap: int = 100) -> StreamingQuery:
    """Re-indexes the documents of every batch: their chunks replace those of the same documents."""

    def batch(rows: DataFrame, _: int) -> None:
        docs = rows.dropDuplicates(["doc_id"]).select(F.col("doc_id").cast("string").alias("source"), "text")
        chunks = sections.chunked(docs, ["source"], limit, overlap)
        write_index(chunks, index)

    return stream.writeStream.foreachBatch(batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()
