"""Registered queries that take whole texts, against the plain model, on documents and on long texts."""

import time
from itertools import accumulate

import pytest
from pyspark.sql import functions as F

from hakuspark.functions import core, search
from hakuspark.plans import catalog
from tests import model as M

SF = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def seeds(spark):
    """The morae of each seeded document."""
    return {r["doc_id"]: M.morae(r["k"]) for r in catalog.documents(spark, SF).collect()}


def against(spark, seeds, name, expected):
    got = {r["doc_id"]: r.asDict() for r in catalog.queries()[name](spark, SF).collect()}
    wrong = [k for k, m in seeds.items() if got[k] != {"doc_id": k} | expected(m)]
    assert got.keys() == seeds.keys() and not wrong, wrong[:3]


def within(spark, column, text, seconds):
    """The column of one text; fails if that takes far longer than linear work would."""
    df = spark.createDataFrame([(text,)], "k string")
    start = time.time()
    got = df.select(column.alias("v")).first()["v"]
    assert time.time() - start < seconds
    return got


def test_finditer(spark, seeds):
    assert sum("ウ" in m[60:] for m in seeds.values()) > 100
    against(spark, seeds, "finditer", lambda m: {"hits": ",".join(map(str, M.hits(m, ["ウ"])))})


def test_finditer_long(spark):
    text = "ショウウカ" * 40_000
    assert within(spark, search.finditer(F.col("k"), "ウ"), text, 20) == M.hits(M.morae(text), ["ウ"])
    assert within(spark, search.finditer(F.col("k"), "ウカ", charwise=True), text, 20) == list(range(3, 200_000, 5))
    assert within(spark, search.finditer(F.col("k"), "", charwise=True), text, 20)[-3:] == [199_998, 199_999, 200_000]


def test_char_indices(spark, seeds):
    assert sum(len(m) > 30 for m in seeds.values()) > 100
    against(spark, seeds, "char_indices", lambda m: {"ends": ",".join(map(str, accumulate(map(len, m), initial=0)))})


def test_char_indices_long(spark):
    text = "ショウカァ" * 50_000
    assert within(spark, core.char_indices(F.col("k")), text, 20) == list(accumulate(map(len, M.morae(text))))


def test_whole_joins(spark, seeds):
    def put(m, new):
        return M.joined([x for one in m for x in (new, one)] + [new])

    def large(m):
        return "".join(m).translate(str.maketrans(catalog.TINY, catalog.LARGE))

    def split(m):
        k, half = "".join(m), len("".join(m)) // 2
        return k[:half] + "シャ" + k[half:]

    against(spark, seeds, "insert_between", lambda m: {"kana": put(m, "ト"), "same_vowel": put(m, "カ"), "limited": "".join("ト" + c if i < 3 else c for i, c in enumerate(large(m))) + "ト" * (len(large(m)) < 3)})
    assert sum(put(m, "カ") is not None for m in seeds.values()) > 100
    against(spark, seeds, "concat", lambda m: {"both": "".join(m) + "カ", "same": "".join(m), "swapped": M.joined(m[len(m) // 2 :] + m[: len(m) // 2])})
    against(spark, seeds, "repeat", lambda m: {"thrice": M.joined(m * 3), "large": large(m) * 2})
    against(spark, seeds, "slice_step", lambda m: {"every": M.joined(m[::3]), "back": M.joined(m[::-1]), "large_every": large(m)[1::2], "large_back": large(m)[::-1]})
    against(spark, seeds, "fromstrs", lambda m: {"kana": split(m)})


def test_choon_runs(spark, tmp_path):
    # Each f is a prolonged sound mark.
    texts = ["Ab" + "f" * n + "c" for n in (0, 1, 4, 5, 6, 50, 3_000)] + ["f" * 7 + "A", "Ufffffff" * 3, ""]
    spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    seeded = {r["doc_id"]: r["k"] for r in catalog.documents(spark, str(tmp_path), catalog.TO_LONG).collect()}
    assert sum("ー" * 5 in k for k in seeded.values()) >= 5
    got = {r["doc_id"]: r["kana"] for r in catalog.queries()["choon_to_vowel"](spark, str(tmp_path)).collect()}
    assert got == {i: M.choon_to_vowel(k) for i, k in seeded.items()}
