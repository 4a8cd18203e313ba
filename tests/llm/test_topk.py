"""Exact top-k: every query row against all rows, ties, sizes of numbers, and how much work the bounds save."""

import random

import numpy as np
from pyspark.sql import functions as F

from hakuspark.llm import topk_search
from tests.llm.test_ops import clash


def brute(data, wanted, k=5):
    """Rows (query_id, rank, vec_id, score) by Python's own integers."""
    whole = [(i, [int(np.floor(np.float64(256.0) * x)) for x in v]) for i, v in data if i is not None and v is not None and None not in v and np.isfinite(v).all()]
    clip = lambda x: max(-(1 << 63), min((1 << 63) - 1, x))
    out = []
    for q, v in whole:
        if wanted(q):
            best = sorted((-sum(clip(x) * clip(y) for x, y in zip(v, w)), i) for i, w in whole if i != q)[:k]
            out += [(q, rank, i, clip(-s)) for rank, (s, i) in enumerate(best, 1)]
    return sorted(out)


def found(df, queries):
    return sorted(map(tuple, topk_search.top_k(df, queries).select("query_id", "rank", "vec_id", "score").collect()))


def test_topk_rows(spark, monkeypatch):
    for name, value in (("LEAST_ROWS", 70), ("BLOCK_ROWS", 16), ("BATCH", 3)):
        monkeypatch.setattr(topk_search, name, value)
    r = random.Random(12)
    data = [(i, [r.choice([-0.5, -0.01, 0.0, 0.004, 0.25, 0.9, 3.0]) for _ in range(8)]) for i in range(300)]
    data += [(i, data[i % 7][1]) for i in range(300, 340)] + [(400, None), (450, [None, 1.0]), (500, [float("nan")] * 8), (550, [0.5]), (600, []), (650, [0.0] * 8), (700, [-1.0] * 8), (None, [1.0] * 8), (50, [0.3] * 8), (100, data[100][1]), (750, [0.25] * 11)]
    df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
    asked = df.where("vec_id % 50 = 0")
    # A query row for each of the rows that repeat id 50 (two vectors) or 100 (one vector twice), with its own ranks.
    assert found(clash(df), clash(asked)) == brute(data, lambda q: q % 50 == 0)
    assert topk_search.top_k(df.limit(0), df).count() == topk_search.top_k(df, df.limit(0)).count() == 0
    assert topk_search.top_k(df.where("vec_id < 3"), df.where("vec_id = 0")).count() == 2


def test_topk_sizes(spark):
    """Products beyond single precision, double precision, and long."""
    r = random.Random(13)
    for size in (1.0, 1e3, 1e6, 1e9, 1e15, 1e30):
        data = [(i, [r.choice([-1, 1]) * r.random() * size for _ in range(4)]) for i in range(60)] + [(100, [size] * 4), (101, [size] * 4)]
        df = spark.createDataFrame(data, "vec_id long, embedding array<double>")
        assert found(df, df.where("vec_id % 50 = 0")) == brute(data, lambda q: q % 50 == 0)


def test_products_skipped():
    """On sparse vectors most products are skipped, and the result is that of all of them."""
    r = np.random.default_rng(14)
    values = np.zeros((4_000, 64), np.int64)
    for row in values:
        row[r.choice(64, 4, replace=False)] = r.integers(-400, 400, 4)
    dense = r.integers(-60, 60, (4_000, 64))
    skipped = {}
    for name, rows in (("sparse", values), ("dense", dense)):
        shard = topk_search.Shard(np.arange(len(rows)), rows)
        own = np.arange(0, 4_000, 50)
        got = shard.search(own, rows[own], 5)
        scores = rows[own] @ rows.T
        for i, q in enumerate(own):
            assert got[i] == sorted((-int(s), j) for j, s in enumerate(scores[i].tolist()) if j != q)[:5]
        skipped[name] = 1 - shard.tally.made / shard.tally.there
    assert skipped["sparse"] > 0.5 and skipped["dense"] >= 0, skipped
