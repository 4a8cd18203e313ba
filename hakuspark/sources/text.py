"""Text files as rows of kana."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.functions import core


def without_lines(text: Column) -> Column:
    """A file's text on one line: line ends of any kind are taken out, as morae may span them."""
    return F.translate(text, "\r\n", "")


def whole_texts(spark: SparkSession, path: str) -> DataFrame:
    """path and text, on one line, of each UTF-8 file that isn't empty."""
    files = spark.read.text(path, wholetext=True)
    return files.select(F.col("_metadata.file_path").alias("path"), without_lines(F.col("value")).alias("text"))


def kana_lines(spark: SparkSession, path: str, *, ignore: bool = True) -> DataFrame:
    """One mora column row per line; splittable, for files too large to be one row."""
    return spark.read.text(path).select(core.mora_str(F.col("value"), ignore=ignore).alias("kana"))


def count_file(spark: SparkSession, path: str, *, validate: bool = False) -> DataFrame:
    """path and number of morae of each file that isn't empty."""
    return whole_texts(spark, path).select("path", core.count_all(F.col("text"), ignore=not validate).alias("morae"))


def count_line(spark: SparkSession, line: str, *, validate: bool = False) -> int:
    """Number of morae of one line."""
    return spark.range(1).select(core.count_all(F.lit(line), ignore=not validate)).first()[0]
