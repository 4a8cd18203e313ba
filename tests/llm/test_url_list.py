"""Long lists of URL rules: what the filter lets through to the exact join, in both of its forms."""

import pytest
from pyspark.sql import functions as F

from hakuspark.llm import url_filter


def listed(spark, n):
    return spark.range(n).select(F.concat(F.lit("h"), F.col("id"), F.lit(".org")).alias("host"), F.concat(F.lit("/"), F.repeat(F.lit("x"), (F.col("id") % 40).cast("int"))).alias("path"), F.lit("block").alias("verdict"))


@pytest.mark.parametrize("filter_bytes", [8_000_000, 0])
def test_long_list(spark, monkeypatch, filter_bytes):
    """A list that isn't broadcast; hits are right, and no page is lost."""
    monkeypatch.setattr(url_filter, "BROADCAST_ROWS", 10)
    monkeypatch.setattr(url_filter, "FILTER_BYTES", filter_bytes)
    pages = spark.range(4_000).select(F.col("id").alias("page_id"), F.concat(F.lit("http://w.h"), F.col("id"), F.lit(".org/"), F.repeat(F.lit("x"), F.lit(60))).alias("url"))
    got = url_filter.judge_urls(pages.unionByName(pages.where("page_id < 5")), listed(spark, 2_000))
    assert got.count() == 4_005 and got.where("verdict = 'block'").count() == 2_005
    assert got.where("page_id < 2000 and rule is null").count() == 0 and got.where("page_id >= 2000 and rule is not null").count() == 0


@pytest.mark.parametrize("filter_bytes", [8_000_000, 0])
def test_only_positives_are_joined(spark, monkeypatch, filter_bytes):
    """Of keys that no rule lists, the filter passes less than a hundredth, and all of those that rules list."""
    monkeypatch.setattr(url_filter, "FILTER_BYTES", filter_bytes)
    rules = listed(spark, 3_000).select(F.col("host").alias("r_host"), F.col("path").alias("r_path"), F.col("verdict").alias("r_verdict"))
    keys = listed(spark, 30_000).select(F.col("host").alias("k_host"), F.col("path").alias("k_path"))
    possible, left = url_filter.possible_hits(keys, rules, 3_000 * url_filter.BITS_PER_KEY // 512)
    if filter_bytes:
        assert 3_000 <= possible.count() < 3_000 + 270
    else:
        assert possible.count() == 30_000 and left.count() == 3_000
    hit = possible.join(left, (F.col("k_host") == F.col("r_host")) & (F.col("k_path") == F.col("r_path")))
    assert hit.count() == 3_000


def test_candidate_keys(spark):
    shapes = [(0, 1), (1, 4), (2, 4), (2, 9)]
    df = spark.createDataFrame([("www.example.com", "/en/1"), ("com", ""), ("", ""), ("a.b.c.d.e", "/x/y/zzzz")], "h string, p string")
    got = [[tuple(k) for k in r[0]] for r in df.select(url_filter.candidate_keys(F.col("h"), F.col("p"), shapes)).collect()]
    assert got == [[("com", "/"), ("example.com", "/en/"), ("www.example.com", "/en/")], [], [], [("e", "/"), ("d.e", "/x/y"), ("c.d.e", "/x/y"), ("c.d.e", "/x/y/zzzz")]]
