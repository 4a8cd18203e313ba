"""Mora counts over streams."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from hakuspark.functions import core


def mora_stream(stream: DataFrame, text: str, *, ignore: bool = True) -> DataFrame:
    """The stream with columns kana and n_morae; no state is kept."""
    kana = core.mora_str(F.col(text), ignore=ignore)
    return stream.withColumn("kana", kana).withColumn("n_morae", core.mora_count(F.col("kana")))


def windowed_mora_counts(stream: DataFrame, text: str, time: str, *, window: str = "1 hour", late: str = "10 minutes") -> DataFrame:
    """Morae per time window; the watermark bounds the state."""
    counted = mora_stream(stream, text).withWatermark(time, late)
    return counted.groupBy(F.window(time, window).alias("w")).agg(F.sum("n_morae").alias("n_morae")).select(F.col("w.start").alias("start"), "n_morae")
