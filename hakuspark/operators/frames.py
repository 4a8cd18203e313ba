"""Rows from morae."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from hakuspark.functions import core, search
from hakuspark.functions.core import Text


def explode_morae(df: DataFrame, kana: Column, mora: str = "mora", position: str | None = None) -> DataFrame:
    """One row per mora, with its position if a name for that is given."""
    if position is None:
        return df.select("*", F.explode(core.morae(kana)).alias(mora))
    return df.select("*", F.posexplode(core.morae(kana)).alias(position, mora))


def explode_hits(df: DataFrame, kana: Column, needle: Text, name: str = "at", *, charwise: bool = False) -> DataFrame:
    """One row per hit of a needle."""
    return df.select("*", F.explode(search.finditer(kana, needle, charwise=charwise)).alias(name))


def mora_histogram(df: DataFrame, kana: Column) -> DataFrame:
    """How often each mora occurs: partial counts per task before the one exchange."""
    return df.select(F.explode(core.morae(kana)).alias("mora")).groupBy("mora").agg(F.count("*").alias("n"))
