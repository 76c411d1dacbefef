"""The exact rung over a stream: the first record of each key within a watermark."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from gleanery.functions import text as T


def first_of_each(stream: DataFrame, time: str, text: str, lateness: str = "1 hour") -> DataFrame:
    """Rows whose canonical text hasn't come within the watermark's lateness; state goes when the watermark has passed."""
    keyed = stream.withColumn("exact_key", T.exact_key(text)).withWatermark(time, lateness)
    return keyed.dropDuplicatesWithinWatermark(["exact_key"])


def collapse_by_window(stream: DataFrame, time: str, text: str, width: str = "1 hour", lateness: str = "1 hour") -> DataFrame:
    """(start, records, distinct) for each window of event time, the distinct counted approximately (state stays small)."""
    keyed = stream.select(time, T.exact_key(text).alias("k")).withWatermark(time, lateness)
    out = keyed.groupBy(F.window(time, width).alias("w")).agg(F.count("*").alias("records"), F.approx_count_distinct("k", 0.01).alias("distinct"))
    return out.select(F.col("w.start").alias("start"), "records", "distinct")
