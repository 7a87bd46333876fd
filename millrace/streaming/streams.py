"""Streams: first-wins by fingerprint within a watermark, windowed counts, reports in complete mode."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from millrace.functions import text as T
from millrace.runtime import shared_dir


def first_by_fingerprint(stream: DataFrame, text_col: str, time_col: str, late: str = "7 days") -> DataFrame:
    """Documents whose fingerprint was not seen within the watermark."""
    return stream.withColumn("fingerprint", T.fingerprint(F.col(text_col))).withWatermark(time_col, late).dropDuplicatesWithinWatermark(["fingerprint"])


def windowed_counts(stream: DataFrame, time_col: str, kind_col: str, size: str = "1 hour", late: str = "2 hours") -> DataFrame:
    """window_start, kind, n: counts of each window and kind; rows later than the watermark are dropped."""
    return stream.withWatermark(time_col, late).groupBy(F.window(time_col, size).alias("w"), kind_col).agg(F.count("*").alias("n")).select(F.col("w.start").alias("window_start"), F.col(kind_col).alias("kind"), "n")


def run_once(stream: DataFrame, name: str, mode: str = "append") -> DataFrame:
    """Runs a bounded stream to its end and returns what it wrote, a table in the shared folder; in complete mode each
    batch writes the whole report in place of the one before."""
    import uuid

    spark: SparkSession = stream.sparkSession
    at = f"{shared_dir(spark).rstrip('/')}/millrace-stream-{name}-{uuid.uuid4().hex}"
    out = stream.writeStream.outputMode(mode).option("checkpointLocation", at + "-state").trigger(availableNow=True)
    if mode == "complete":
        q = out.foreachBatch(lambda report, _: report.write.mode("overwrite").parquet(at)).start()
    else:
        q = out.format("parquet").option("path", at).start()
    q.awaitTermination()
    return spark.read.schema(stream.schema).parquet(at)
