"""Row operators, the column wrapper, sources, streams, and the entry points."""

import pytest
from pyspark.sql import functions as F

import __spark_entry__
from hakuspark.__main__ import run
from hakuspark.operators import MoraCol, explode_hits, explode_morae, mora_histogram
from hakuspark.plans import catalog
from hakuspark.sources import count_file, count_line, kana_lines
from hakuspark.streaming import mora_stream, windowed_mora_counts


def values(spark, **columns):
    return spark.createDataFrame([("ショーシャマン", "シャ")], "k string, x string").select(*(c.alias(n) for n, c in columns.items())).first().asDict()


def test_moracol(spark):
    m, x = MoraCol.of(F.col("k")), MoraCol.of(F.col("x"))
    got = values(
        spark, length=m.length, item=m[0], last=m[-1], part=m[1:3].string, plus=(m + "カ").string, twice=(x * 2).string, rtwice=(2 * x).string, equal=m == x, same=m == MoraCol.of(F.col("k")),
        text_differs=m == "ショーシャマン", unequal=m != x, has=m.contains(x), starts=m.startswith(("カ", "ショ")), ends=m.endswith("ン"), at=m.find(x), rat=m.rfind("ー"), index=m.index(x), rindex=m.rindex(x),
        n=m.count(x), hits=m.finditer("マ"), cut=m.removeprefix("ショ").string, cut2=m.removesuffix("ン").string, put=m.replace("マ", "ナ").string, back=m.reversed(), ends_at=m.char_indices(), repr=x.repr(), text=m.tostr(),
        long=MoraCol.of(F.lit("カア")).vowel_to_choon().string, short=MoraCol.of(F.lit("カー")).choon_to_vowel().string, joined=MoraCol.fromstrs(F.col("x"), ["か"]).string, raw=MoraCol(F.lit("ｶﾞ")).string, all=MoraCol.count_all(F.lit("かゃ"), ignore=True), hash=m.hash() == F.xxhash64("k"), copy=MoraCol(m).string, morae=x.morae,
    )
    assert got == {
        "length": 5, "item": "ショ", "last": "ン", "part": "ーシャ", "plus": "ショーシャマンカ", "twice": "シャシャ", "rtwice": "シャシャ", "equal": False, "same": True, "text_differs": False, "unequal": True, "has": True, "starts": True, "ends": True,
        "at": 2, "rat": 1, "index": 2, "rindex": 2, "n": 1, "hits": [3], "cut": "ーシャマン", "cut2": "ショーシャマ", "put": "ショーシャナン", "back": ["ン", "マ", "シャ", "ー", "ショ"], "ends_at": [2, 3, 5, 6, 7], "repr": "MoraStr('シャ')", "text": "ショーシャマン",
        "long": "カー", "short": "カア", "joined": "シャカ", "raw": "ガ", "all": 2, "hash": True, "copy": "ショーシャマン", "morae": ["シャ"],
    }


def test_rows(spark):
    df = spark.createDataFrame([(1, "シャカシャ"), (2, ""), (3, None)], "i int, k string")
    assert [tuple(r) for r in explode_morae(df, F.col("k"), position="at").select("i", "at", "mora").collect()] == [(1, 0, "シャ"), (1, 1, "カ"), (1, 2, "シャ")]
    assert explode_morae(df, F.col("k")).count() == 3
    # The empty text has fewer morae than the needle, so it is searched for in the needle.
    assert [(r["i"], r["at"]) for r in explode_hits(df, F.col("k"), "シャ").collect()] == [(1, 0), (1, 2), (2, 0), (2, 1)]
    assert {r["mora"]: r["n"] for r in mora_histogram(df, F.col("k")).collect()} == {"シャ": 2, "カ": 1}


def test_files(spark, tmp_path, capsys, monkeypatch):
    path = tmp_path / "a.txt"
    path.write_text("しゃ漢\nゃか\n", encoding="utf-8")
    assert count_file(spark, str(path)).first()["morae"] == 3  # a small kana after the line feed, and no fusing across it
    assert [r["kana"] for r in kana_lines(spark, str(path)).collect()] == ["シャ", "ャカ"]
    assert count_line(spark, "かき") == 2
    run([str(path)])
    assert "$ total mora count: 3" in capsys.readouterr().out
    monkeypatch.setattr("builtins.input", lambda: "かき")
    run([])
    assert "$ total mora count: 2" in capsys.readouterr().out
    with pytest.raises(Exception, match="invalid character"):
        run(["-v", str(path)])


def test_streams(spark, tmp_path):
    spark.createDataFrame([("2024-01-01 00:10:00", "かき"), ("2024-01-01 00:50:00", "しゃ"), ("2024-01-01 01:10:00", "あ")], "t string, k string").select(F.to_timestamp("t").alias("t"), "k").write.parquet(str(tmp_path / "in"))
    stream = lambda: spark.readStream.schema("t timestamp, k string").parquet(str(tmp_path / "in"))

    def result(df, name, mode):
        df.writeStream.format("memory").queryName(name).outputMode(mode).option("checkpointLocation", str(tmp_path / name)).trigger(availableNow=True).start().awaitTermination()
        return sorted(tuple(r) for r in spark.table(name).collect())

    assert [r[1:] for r in result(mora_stream(stream(), "k").select("t", "kana", "n_morae"), "plain", "append")] == [("カキ", 2), ("シャ", 1), ("ア", 1)]
    assert [r[1] for r in result(windowed_mora_counts(stream(), "k", "t"), "windows", "complete")] == [3, 1]


def test_entry(spark):
    assert {"mora_count", "find", "replace", "choon_to_vowel"} <= set(__spark_entry__.queries())
    assert set(catalog.oracle_sql()) <= set(catalog.queries())
    assert __spark_entry__.entry(spark).columns == ["doc_id", "mora_count"]


@pytest.mark.parametrize("name", sorted(catalog.oracle_sql()))
def test_against_sql(spark, name):
    duckdb = pytest.importorskip("duckdb")
    connection = duckdb.connect()
    for table in ("documents", "part"):
        connection.sql(f"create view {table} as select * from '/root/testdata/sf0.001/{table}.parquet'")
    got = catalog.queries()[name](spark, "/root/testdata/sf0.001")
    wanted = connection.sql(catalog.oracle_sql()[name])
    assert sorted(got.columns) == sorted(wanted.columns)
    columns = sorted(got.columns)
    rows = lambda found: sorted(map(repr, found))
    assert rows(tuple(r) for r in got.select(*columns).collect()) == rows(wanted.select(*columns).fetchall())
