"""Streaming ingest of sections: an extension beside the batch operators.

Running means and sums by sample are kept over an unbounded stream of pixel files. Medians and
spatial statistics cannot be maintained that way and stay batch operators.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import StructType


def pixel_stream(spark: SparkSession, folder: str, schema: StructType, files_a_trigger: int = 16) -> DataFrame:
    """Stream of pixel tables as they arrive in a folder."""
    return spark.readStream.schema(schema).option("maxFilesPerTrigger", files_a_trigger).parquet(folder)


def running_pseudobulk(pixels: DataFrame, sample_key: str = "section") -> DataFrame:
    """``sample, feature_idx, n_pixels, sum, mean``, for complete or update mode."""
    long = pixels.select(F.col(sample_key).cast("string").alias("sample"), F.posexplode("values").alias("feature_idx", "value"))
    return long.groupBy("sample", "feature_idx").agg(F.count(F.lit(1)).alias("n_pixels"), F.sum("value").alias("sum"), F.avg("value").alias("mean"))


def windowed_profile(events: DataFrame, time: str, key: str, value: str, width: str = "1 hour", delay: str = "10 minutes") -> DataFrame:
    """Counts and means by key in event-time windows; rows later than ``delay`` are left out."""
    return events.withWatermark(time, delay).groupBy(F.window(time, width), key).agg(F.count(F.lit(1)).alias("n"), F.avg(value).alias("mean"))
