"""Conversion tables and converters: columns against the driver's own conversion, and both against a plain walk."""

import random

import pytest
from pyspark.sql import functions as F

import hakuspark
from hakuspark.functions import core, phonetic, search, tables
from hakuspark.operators import MoraCol
from hakuspark.sources import count_file
from tests import model as M


def walk(text, table):
    """Keys of three and more characters from the left, longest first; then of two; then single ones."""
    for fits in (lambda n: n > 2, lambda n: n == 2, lambda n: n == 1):
        keys = sorted((k for k in table if fits(len(k))), key=len, reverse=True)
        out, i = "", 0
        while i < len(text):
            key = next((k for k in keys if text.startswith(k, i)), None)
            out += text[i] if key is None else table[key]
            i += len(key or "x")
        text = out
    return text.translate({ord(h): k for h, k in zip(tables.HIRAGANA, tables.KATAKANA)})


def test_random_tables(spark):
    r = random.Random(21)
    for _ in range(8):
        table = {"".join(r.choice("abcde.\\") for _ in range(r.choice([1, 1, 2, 2, 3, 4]))): r.choice("アイウエオカキ") for _ in range(8)}
        texts = ["".join(r.choice("abcde.\\あカ") for _ in range(r.randint(0, 12))) for _ in range(60)]
        df = spark.createDataFrame(list(enumerate(texts)), "i int, k string")
        got = {x["i"]: x["v"] for x in df.select("i", core.normalize(F.col("k"), ignore=True, table=table).alias("v")).collect()}
        kept = lambda t: "".join(c for c in t if "ァ" <= c <= "ヾ")
        assert got == {i: kept(walk(t, table)) for i, t in enumerate(texts)}
        assert all(tables.to_katakana(t, True, table) == got[i] for i, t in enumerate(texts))


def test_overlapping_keys(spark):
    table = {"abc": "ア", "bcde": "イ", "d": "ウ", "e": "エ", "a": "オ"}
    assert spark.range(1).select(core.normalize(F.lit("abcde"), table=table)).first()[0] == tables.to_katakana("abcde", table=table) == "アウエ"
    table = {"ab": "ア", "bcd": "イ", "a": "ウ", "c": "エ", "d": "オ"}
    assert spark.range(1).select(core.normalize(F.lit("abcd"), table=table)).first()[0] == tables.to_katakana("abcd", table=table) == "ウイ"


def test_checked_keys():
    for bad in ({"カx": "ア"}, {"xカ": "ア"}, {"xあ": "ア"}, {"": "ア"}, {"a": "ア゛"}, {"a": "a"}):
        with pytest.raises(ValueError):
            tables.checked_table(bad)
    with pytest.raises(TypeError):
        tables.checked_table({"a": 1})
    assert tables.CONVERSION_TABLE["ｶﾞ"] == "ガ" and tables.CONVERSION_TABLE["ｦﾞ"] == "ヺ" and tables.CONVERSION_TABLE["-"] == "ー"


def test_table_in_needles(spark):
    table = {"ka": "カ", "shi": "シ"}
    made = MoraCol(F.lit("kashika"), table=table)
    row = spark.range(1).select(made.find("shi").alias("a"), made.replace("ka", "shi").string.alias("b"), made[1:].count("ka").alias("c"), MoraCol.fromstrs(F.lit("ka"), ["shi"], table=table).string.alias("d"), MoraCol.count_all(F.lit("kashi"), table=table).alias("e")).first()
    assert tuple(row) == (1, "シシシ", 1, "カシ", 2)


def test_python_converter(spark):
    convert = core.python_converter(lambda t: t.replace("山", "ヤマ"))
    df = spark.createDataFrame([("山か",), (None,), ("",)], "k string")
    assert [r[0] for r in df.select(core.mora_str(F.col("k"), converter=convert)).collect()] == ["ヤマカ", None, ""]


def test_line_ends(spark, tmp_path, capsys):
    from hakuspark.__main__ import run

    for name, text, n in (("crlf", "か\r\nき\r\n", 2), ("cr", "か\rき", 2), ("empty", "", 0)):
        path = tmp_path / f"{name}.txt"
        path.write_bytes(text.encode())
        run(["-v", str(path)])
        assert f"$ total mora count: {n}\n" in capsys.readouterr().out
    assert count_file(spark, str(tmp_path / "crlf.txt"), validate=True).first()["morae"] == 2


@pytest.mark.parametrize("maxrep", [0, 1, 2, 3, -1])
def test_extra_pairs(spark, maxrep):
    """ou and ei at any maxrep, and characters from the private use area."""
    r = random.Random(22)
    texts = ["".join(r.choice("アイウエオカケコトセンァゥx") for _ in range(r.randint(0, 14))) for _ in range(600)] + ["カアア", "カアアア\nオウウ"]
    df = spark.createDataFrame(list(enumerate(texts)), "i int, k string")
    for ou, ei in ((True, True), (True, False), (False, True)):
        got = {x["i"]: x["v"] for x in df.select("i", phonetic.vowel_to_choon(F.col("k"), maxrep, ou=ou, ei=ei).alias("v")).collect()}
        assert got == {i: M.vowel_to_choon(t, maxrep, ou=ou, ei=ei) for i, t in enumerate(texts)}


def test_exports(spark):
    assert hakuspark.MoraCol is MoraCol and hakuspark.CONVERSION_TABLE is tables.CONVERSION_TABLE
    assert spark.range(1).select(hakuspark.count_all(F.lit("かゃ")), search.rfind(F.lit("カシカ"), "カ")).first()[:] == (2, 2)
