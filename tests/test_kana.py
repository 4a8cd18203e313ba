"""Columns against the plain model, over random texts; goldens and edge cases."""

import random

import pytest
from pyspark.errors import PySparkException
from pyspark.sql import functions as F

from hakuspark.functions import access, core, edit, phonetic, search, tables
from tests import model as M

ALPHABET = "アイウエオカキクシスセトノハンッーァィゥェォャュョヮヶ"


def texts(n, seed, most=9, alphabet=ALPHABET):
    r = random.Random(seed)
    out = []
    while len(out) < n:
        t = "".join(r.choice(alphabet) for _ in range(r.randint(0, most)))
        if all(len(m) <= 3 for m in M.morae(t)):
            out.append(t)
    return out


@pytest.fixture(scope="module")
def pairs(spark):
    """k, a needle x that is often part of it, another text y, and bounds."""
    r = random.Random(5)
    rows = []
    for i, (k, y) in enumerate(zip(texts(1500, 1), texts(1500, 2, 3))):
        m = M.morae(k)
        a = r.randint(0, len(m))
        x = "".join(m[a : a + r.randint(0, 2)]) if r.random() < 0.8 else y
        rows.append((i, k, x if M.joined(M.morae(x)) is not None else "", y, r.randint(-6, 7), r.randint(-6, 7)))
    df = spark.createDataFrame(rows, "i int, k string, x string, y string, a int, b int").cache()
    return df, rows


def check(pairs, column, expected):
    df, rows = pairs
    got = {r["i"]: r["v"] for r in df.select("i", column.alias("v")).collect()}
    wrong = [(row, got[row[0]], expected(*row[1:])) for row in rows if got[row[0]] != expected(*row[1:])]
    assert not wrong, wrong[:3]


K, X, Y, A, B = map(F.col, "kxyab")
m = M.morae


def test_tokens(pairs):
    check(pairs, core.morae(K), lambda k, *_: m(k))
    check(pairs, core.mora_count(K), lambda k, *_: len(m(k)))
    check(pairs, core.encoded(K), lambda k, *_: "".join(f"<{x}>" for x in m(k)))
    check(pairs, core.char_indices(K), lambda k, *_: [sum(map(len, m(k)[: i + 1])) for i in range(len(m(k)))])
    check(pairs, core.char_indices(K, zero=True), lambda k, *_: [sum(map(len, m(k)[:i])) for i in range(len(m(k)) + 1)])
    check(pairs, access.reversed_morae(K), lambda k, *_: m(k)[::-1])
    check(pairs, core.mora_repr(K), lambda k, *_: "MoraStr(" + " ".join(f"'{x}'" for x in m(k)) + ")")


def test_access(pairs):
    check(pairs, access.item(K, A, errors="null"), lambda k, x, y, a, b: m(k)[a] if -len(m(k)) <= a < len(m(k)) else None)
    check(pairs, access.slice_morae(K, A, B), lambda k, x, y, a, b: "".join(m(k)[a:b]))
    for step in (2, 3, -1, -2):
        check(pairs, access.slice_morae(K, A, B, step, errors="null"), lambda k, x, y, a, b: M.joined(m(k)[a:b:step]))
        check(pairs, access.slice_morae(K, None, None, step, errors="null"), lambda k, x, y, a, b: M.joined(m(k)[::step]))
    check(pairs, access.concat(K, Y, errors="null"), lambda k, x, y, a, b: M.joined(m(k) + m(y)))
    check(pairs, access.repeat(K, A, errors="null"), lambda k, x, y, a, b: M.joined(m(k) * a))


def test_search(pairs):
    check(pairs, search.contains(K, X), lambda k, x, *_: not x or bool(M.hits(m(k), m(x))))
    check(pairs, search.find(K, X), lambda k, x, *_: M.find(m(k), m(x)))
    check(pairs, search.find(K, X, A, B), lambda k, x, y, a, b: M.find(m(k), m(x), a, b))
    check(pairs, search.rfind(K, X), lambda k, x, *_: M.rfind(m(k), m(x)))
    check(pairs, search.rfind(K, X, A, B), lambda k, x, y, a, b: M.rfind(m(k), m(x), a, b))
    check(pairs, search.find(K, X, charwise=True), lambda k, x, *_: len("".join(m(k)[:i])) if (i := M.find(m(k), m(x))) >= 0 else -1)
    check(pairs, search.rfind(K, X, charwise=True), lambda k, x, *_: len("".join(m(k)[:i])) if (i := M.rfind(m(k), m(x))) >= 0 else -1)
    check(pairs, search.index(K, X, errors="null"), lambda k, x, *_: i if (i := M.find(m(k), m(x))) >= 0 else None)
    check(pairs, search.rindex(K, X, errors="null"), lambda k, x, *_: i if (i := M.rfind(m(k), m(x))) >= 0 else None)
    check(pairs, search.count(K, X), lambda k, x, *_: M.count(m(k), m(x)))
    check(pairs, search.count(K, X, A, B), lambda k, x, y, a, b: M.count(m(k), m(x), a, b))

    def tail(first):
        def expected(k, x, y, a, b):
            s, e = M.adjust(len(m(k)), a, b)
            part, w = m(k)[s:e], m(x)
            return a <= len(m(k)) and s <= e and len(w) <= len(part) and (not w or (part[: len(w)] if first else part[-len(w) :]) == w)

        return expected

    check(pairs, search.startswith(K, X, A, B), tail(True))
    check(pairs, search.endswith(K, X, A, B), tail(False))
    check(pairs, search.startswith(K, (X, Y)), lambda k, x, y, *_: any(m(k)[: len(m(w))] == m(w) for w in (x, y)))
    check(pairs, search.startswith(K, ()), lambda *_: False)


def test_finditer(pairs):
    def expected(k, x, *_):
        one, two = m(k), m(x)
        one, two = (two, one) if len(one) < len(two) else (one, two)
        return M.hits(one, two) if two else list(range(len(one) + 1))

    check(pairs, search.finditer(K, X), expected)
    check(pairs, search.finditer(K, Y), lambda k, x, y, *_: expected(k, y))
    check(pairs, search.finditer(K, X, charwise=True), lambda k, x, *_: [len("".join((m(k) if len(m(k)) >= len(m(x)) else m(x))[:i])) for i in expected(k, x)])


def test_edit(pairs):
    check(pairs, edit.removeprefix(K, X), lambda k, x, *_: "".join(m(k)[len(m(x)) :]) if m(k)[: len(m(x))] == m(x) else k)
    check(pairs, edit.removesuffix(K, X), lambda k, x, *_: "".join(m(k)[: len(m(k)) - len(m(x))]) if m(k)[len(m(k)) - len(m(x)) :] == m(x) else k)
    check(pairs, edit.replace(K, X, Y, errors="null"), lambda k, x, y, *_: M.replace(m(k), m(x), m(y)))
    check(pairs, edit.replace(K, X, Y, A, errors="null"), lambda k, x, y, a, b: M.replace(m(k), m(x), m(y), a))
    check(pairs, edit.replace(K, "", "ト", 2, errors="null"), lambda k, *_: M.replace(m(k), [], ["ト"], 2))
    check(pairs, edit.replace(K, "カ", "シ", errors="null"), lambda k, *_: M.replace(m(k), ["カ"], ["シ"]))


@pytest.mark.parametrize("maxrep", [0, 1, 2, 3, -1])
def test_long_vowels(pairs, maxrep):
    check(pairs, phonetic.vowel_to_choon(K, maxrep), lambda k, *_: M.vowel_to_choon(k, maxrep))
    check(pairs, phonetic.vowel_to_choon(K, maxrep, nn=False), lambda k, *_: M.vowel_to_choon(k, maxrep, nn=False))
    check(pairs, phonetic.choon_to_vowel(K, strict=False), lambda k, *_: M.choon_to_vowel(k))
    check(pairs, phonetic.choon_to_vowel(K, errors="null"), lambda k, *_: None if "ー" in M.choon_to_vowel(k) else M.choon_to_vowel(k))


def one(spark, column, **values):
    names = list(values)
    return spark.createDataFrame([tuple(values.values())], ", ".join(f"{n} string" for n in names)).select(column).first()[0]


def test_goldens(spark):
    for raw, expected in {
        "モーラ": "モ|ー|ラ", "シミュレーション": "シ|ミュ|レ|ー|ショ|ン", "ひらがな": "ヒ|ラ|ガ|ナ", "ﾊﾝｶｸﾓｼﾞ": "ハ|ン|カ|ク|モ|ジ",
        "シュレッダー": "シュ|レ|ッ|ダ|ー", "ｺﾝﾋﾟｭｰﾀｰ": "コ|ン|ピュ|ー|タ|ー", "カァ": "カ|ァ", "シァ": "シァ", "シャァ": "シャ|ァ",
        "キィェァ": "キ|ィェァ", "ァメ": "ァ|メ", "ゕゖゝゞ": "ヵ|ヶ|ヽ|ヾ", "か-": "カ|ー", "ンァ": "ンァ", "ーァ": "ーァ", "": "",
    }.items():
        assert one(spark, F.array_join(core.morae(core.mora_str(F.col("k"))), "|"), k=raw) == expected
        assert "|".join(tables.split_morae(tables.to_katakana(raw))) == expected
    assert one(spark, core.mora_str(F.col("k"), ignore=True), k="ｶ漢ﾞ") == "カ"
    k = F.col("k")
    assert one(spark, access.item(k, 3), k="アーティキュレーション") == "キュ"
    assert one(spark, access.item(k, -2), k="アーティキュレーション") == "ショ"
    assert one(spark, access.slice_morae(k, None, 3), k="ジェットエンジン") == "ジェット"
    assert [one(spark, search.contains(k, x), k="ショーシャマン") for x in ("シャ", "ショーシャ", "シ")] == [True, True, False]
    assert one(spark, search.find(k, "ショ", charwise=True), k="シャシュショ") == 4
    assert one(spark, search.finditer(k, "アイア"), k="ア") == [0, 2]
    assert one(spark, phonetic.vowel_to_choon(k, ou=True), k="トウキョウ") == "トーキョー"
    assert one(spark, phonetic.vowel_to_choon(k, ei=True), k="ケイ") == "ケー"
    assert one(spark, phonetic.vowel_to_choon(k), k="オネエサンカンンナ") == "オネーサンカンーナ"
    assert one(spark, phonetic.vowel_to_choon(k, -1), k="アアアア") == "アーーー"
    assert one(spark, phonetic.choon_to_vowel(k), k="カーーンー") == "カアアンン"
    assert one(spark, phonetic.vowel_to_choon(k, clean=True), k="おかアさん") == "オカアサン"
    assert one(spark, core.from_strs(F.col("k"), "ゃ", F.col("l")), k="し", l="ｶ") == "シャカ"
    assert one(spark, core.has_leading_small(k), k="ァメ") is True
    assert one(spark, core.count_all(k, ignore=True), k="漢シャカ") == 2


@pytest.mark.parametrize(
    "column",
    [
        core.mora_str(F.lit("漢カ")), core.mora_str(F.lit("カ゛")), core.mora_str(F.lit("ヿ")), core.mora_str(F.lit("キェァィ")),
        access.item(F.lit("カ"), 1), access.concat(F.lit("シ"), F.lit("ァ")), access.slice_morae(F.lit("シカァ"), None, None, 2),
        search.index(F.lit("カ"), "シ"), search.rindex(F.lit("カ"), "シ"), edit.replace(F.lit("カァ"), "カ", "シ"),
        edit.replace(F.lit("カ"), F.lit("カ"), F.lit("ァ")), phonetic.choon_to_vowel(F.lit("ーカ")), phonetic.choon_to_vowel(F.lit("ッー")),
    ],
)
def test_errors(spark, column):
    with pytest.raises(PySparkException):
        spark.range(1).select(column).collect()


def test_null_policy(spark):
    n = F.lit(None).cast("string")
    for column in (core.mora_str(n), core.mora_count(n), access.item(n, 0), access.slice_morae(n, 1, 2), access.slice_morae(n, None, None, 2), search.contains(n, "カ"), search.find(n, "カ"), search.count(n, "カ"), search.startswith(n, "カ"), search.finditer(n, "カ"), edit.replace(n, "カ", "シ"), phonetic.vowel_to_choon(n, 2), phonetic.choon_to_vowel(n), core.mora_str(F.lit("漢"), errors="null")):
        assert spark.range(1).select(column).first()[0] is None


def test_driver_errors():
    for bad in (lambda: edit.replace(F.lit("カ"), "カ", "ァ"), lambda: search.contains(F.lit("カ"), "漢"), lambda: tables.checked_table({"": "ア"}), lambda: tables.checked_table({"あ": "ア"}), lambda: tables.checked_table({"a": "アア"}), lambda: access.slice_morae(F.lit("カ"), step=0)):
        with pytest.raises(ValueError):
            bad()
    with pytest.raises(TypeError):
        search.find(F.lit("カ"), "カ", 1, charwise=True)


def test_table_and_converter(spark):
    table = {"a": "ア", "ka": "カ", "shi": "シ"}
    assert one(spark, core.normalize(F.col("k"), table=table), k="shikaaい") == "シカアイ"
    assert one(spark, core.normalize(F.col("k"), converter=lambda c: F.replace(c, F.lit("山"), F.lit("ヤマ"))), k="山ﾞ".rstrip("ﾞ")) == "ヤマ"
    assert len(tables.CONVERSION_TABLE) == 86
