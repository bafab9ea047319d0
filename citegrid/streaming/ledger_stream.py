"""The ledger as a stream: an extension, since edits arrive one after the other."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F


def unique_edits(edits: DataFrame, key: list[str], time: str, lateness: str = "1 hour") -> DataFrame:
    """Edits without repeats that come within ``lateness``: state is dropped behind the watermark."""
    return edits.withWatermark(time, lateness).dropDuplicatesWithinWatermark(key)


def heads(edits: DataFrame, key: str, time: str, values: list[str]) -> DataFrame:
    """The last state of each key, as a running aggregate (update or complete mode); ties go to the larger values."""
    last = F.max(F.struct(time, *values)).alias("s")
    return edits.groupBy(key).agg(last, F.count(F.lit(1)).alias("edits")).select(key, *[F.col(f"s.{c}").alias(c) for c in [time, *values]], "edits")


def edits_by_window(edits: DataFrame, time: str, kind: str, size: str = "1 day", lateness: str = "2 days") -> DataFrame:
    """Edits of each kind in each window of time; late ones count until the watermark has passed."""
    w = edits.withWatermark(time, lateness).groupBy(F.window(time, size).alias("w"), kind).agg(F.count(F.lit(1)).alias("n"))
    return w.select(F.col("w.start").alias("start"), kind, "n")
