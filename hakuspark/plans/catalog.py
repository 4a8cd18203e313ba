"""Registered queries of the kana library and their DuckDB counterparts.

The tables hold no kana, so texts are seeded by transliteration, in the same way by both engines.
"""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.functions import access, core, edit, phonetic, search
from hakuspark.functions.tables import CONVERSION_TABLE, HIRAGANA, KATAKANA, LONG, NOT_KANA, ROWS, SMALLS, VOWELS, mora_without_lookaround, split_morae
from hakuspark.operators import explode_morae, mora_histogram
from hakuspark.sources import without_lines

Query = Callable[[SparkSession, str], DataFrame]

FROM = "ABCDEFGHIJKLMNOPQRSTUVWXYZ0123456789abcdefghijklmnopqrstuvwxyz"
_KANA = "アバチデエフガャイジクルムンオプキラシツウヴヮセァゾゼイニサヨゴロナハク"
TO = _KANA + _KANA[:26]
#: For long vowels: frequent letters become vowels and the prolonged sound mark.
TO_LONG = TO.translate(str.maketrans("ジクフ", "アウー"))
#: For normalizing: some kana become hiragana or half-width.
HALVES = {"バ": "ﾊﾞ", "プ": "ﾌﾟ", "ガ": "ｶﾞ"}
SOFT = "アチデイムオキラシツセ"
SOFT_TO = "あちでいむｵｷﾗｼﾂｾ"
#: Small kana and large ones in their place, for texts whose morae never fuse.
TINY, LARGE = "ァィゥェォャュョヮ", "アイウエオヤユヨワ"


def seeded(text: Column, to: str = TO) -> Column:
    return F.regexp_replace(F.translate(text, FROM, to), NOT_KANA, "")


def documents(spark: SparkSession, sf_dir: str, to: str = TO) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", seeded(F.col("text"), to).alias("k"))


def part_names(spark: SparkSession, sf_dir: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", seeded(F.col("p_name")).alias("k"))


def _spelled(text: str) -> str:
    """A converter that is any Python function."""
    return text.replace("sh", "シ").translate(str.maketrans("ao", "アオ"))


def _per_document(to: str = TO, **columns: Callable[[Column], Column]) -> Query:
    return lambda spark, sf_dir: documents(spark, sf_dir, to).select("doc_id", *(make(F.col("k")).alias(name) for name, make in columns.items()))


RE2 = mora_without_lookaround()
_K = f"regexp_replace(translate(text, '{FROM}', '{TO}'), '{NOT_KANA}', '', 'g')"
_LONG_K = _K.replace(TO, TO_LONG)


def _seeds(k: str = _K, table: str = "documents", key: str = "doc_id") -> str:
    """k, its bracket form e and its morae m."""
    return f"with s0 as (select {key}, {k} as k from {table}), t as (select {key}, k, regexp_replace(k, '{RE2}', '<\\0>', 'g') as e, regexp_extract_all(k, '{RE2}') as m from s0)\n"


def _sql(k: str = _K, **columns: str) -> str:
    return _seeds(k) + "select doc_id, " + ", ".join(f"{sql} as {name}" for name, sql in columns.items()) + " from t"


def _form(needle: str) -> str:
    return "".join(f"<{x}>" for x in split_morae(needle))


def _marks(sql: str) -> str:
    return f"(length({sql}) - length(replace({sql}, '<', '')))"


def _find_sql(form: str, needle: str, start: str = "0") -> str:
    n = _form(needle)
    return f"cast(case when strpos({form}, '{n}') > 0 then {start} + {_marks(f"substr({form}, 1, strpos({form}, '{n}') - 1)")} else -1 end as int)"


def _rfind_sql(needle: str, form: str = "e", start: str = "0") -> str:
    n = _form(needle)
    pos = f"(length({form}) - strpos(reverse({form}), '{n[::-1]}') - {len(n)} + 2)"
    return f"cast(case when strpos(reverse({form}), '{n[::-1]}') > 0 then {start} + {_marks(f'substr({form}, 1, {pos} - 1)')} else -1 end as int)"


def _checked(sql: str) -> str:
    """The text of a bracket form, or null if it splits into other morae."""
    return f"case when regexp_replace(translate({sql}, '<>', ''), '{RE2}', '<\\0>', 'g') = {sql} then translate({sql}, '<>', '') end"


_PART = "(case when len(m[3:12]) > 0 then '<' || array_to_string(m[3:12], '><') || '>' else '' end)"
#: A needle that is frequent in the seeded texts: two morae.
_PAIR = "サニ"

_QUERIES: dict[str, Query] = {}
_ORACLES: dict[str, str] = {}


def _add(name: str, query: Query, sql: str | None = None) -> None:
    _QUERIES[name] = query
    if sql:
        _ORACLES[name] = sql


_add("mora_count", _per_document(mora_count=lambda k: core.mora_count(k).cast("long")), _sql(mora_count="cast(len(m) as bigint)"))
_add("count_all", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", core.count_all(F.translate("text", FROM, TO), ignore=True).cast("long").alias("n")), _sql(_K.replace(FROM, FROM + '-').replace(TO, TO + LONG), n="cast(len(m) as bigint)"))


def _soft(k: Column) -> Column:
    for full, half in HALVES.items():
        k = F.replace(k, F.lit(full), F.lit(half))
    return F.translate(k, SOFT, SOFT_TO)


_raw_sql = "k"
for _full, _half in HALVES.items():
    _raw_sql = f"replace({_raw_sql}, '{_full}', '{_half}')"
_raw_sql = f"translate({_raw_sql}, '{SOFT}', '{SOFT_TO}')"
_norm_sql = _raw_sql
for _key in sorted((x for x in CONVERSION_TABLE if len(x) > 1)):
    _norm_sql = f"replace({_norm_sql}, '{_key}', '{CONVERSION_TABLE[_key]}')"
_single = [x for x in CONVERSION_TABLE if len(x) == 1]
_norm_sql = f"translate({_norm_sql}, '{''.join(_single)}{HIRAGANA}', '{''.join(CONVERSION_TABLE[x] for x in _single)}{KATAKANA}')"
_add("normalize", _per_document(raw=_soft, kana=lambda k: core.normalize(_soft(k))), _sql(raw=_raw_sql, kana=_norm_sql))
_add("normalize_or_null", _per_document(kana=lambda k: core.mora_str(F.when(F.length(k) % 2 == 0, F.concat(k, F.lit("x"))).otherwise(k), errors="null")), _sql(kana="case when length(k) % 2 = 1 then k end"))
_add("mora_limit", _per_document(kana=lambda k: core.mora_str(F.when(F.length(k) % 2 == 0, F.concat(k, F.lit("シァィゥ"))).otherwise(F.concat(k, F.lit("シァィ"))), errors="null")), _sql(kana="case when length(k) % 2 = 1 then k || 'シァィ' end"))
_add("converted", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", core.normalize(F.lower("p_name"), ignore=True, converter=core.python_converter(_spelled)).alias("kana")), f"select p_partkey, regexp_replace(translate(replace(lower(p_name), 'sh', 'シ'), 'ao', 'アオ'), '{NOT_KANA}', '', 'g') as kana from part")
_add("file_text", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", core.count_all(without_lines(F.translate("text", FROM, TO)), ignore=True).cast("long").alias("n")), _sql(_K.replace(FROM, FROM + '-').replace(TO, TO + LONG), n="cast(len(m) as bigint)"))
_add("morae", _per_document(morae=lambda k: F.array_join(core.morae(k), "|")), _sql(morae="array_to_string(m, '|')"))
_add("mora_repr", _per_document(repr=core.mora_repr), _sql(repr="case when k = '' then 'MoraStr()' else 'MoraStr(''' || array_to_string(m, ''' ''') || ''')' end"))
_add("leading_small", _per_document(small=core.has_leading_small), _sql(small=f"regexp_matches(k, '^[{SMALLS}]')"))
_add("item", _per_document(third=lambda k: access.item(k, 2, errors="null"), last=lambda k: access.item(k, -1, errors="null")), _sql(third="m[3]", last="m[-1]"))
_add("slice", _per_document(head=lambda k: access.slice_morae(k, 1, 5), tail=lambda k: access.slice_morae(k, -4)), _sql(head="array_to_string(m[2:5], '')", tail="array_to_string(m[greatest(len(m) - 3, 1):], '')"))


def _form_of(items: str) -> str:
    return f"(case when len({items}) > 0 then '<' || array_to_string({items}, '><') || '>' else '' end)"


def _half(n: Column) -> Column:
    return F.floor(n / 2).cast("int")


def _large(k: Column) -> Column:
    return F.translate(k, TINY, LARGE)


_LARGE_SQL = f"translate(k, '{TINY}', '{LARGE}')"
# Where morae would fuse anywhere in a text, it is null as a whole; in a text of large kana they never do.
_add("slice_step", _per_document(every=lambda k: access.slice_morae(k, None, None, 3, errors="null"), back=lambda k: access.slice_morae(k, None, None, -1, errors="null"), large_every=lambda k: access.slice_morae(_large(k), 1, None, 2, errors="null"), large_back=lambda k: access.slice_morae(_large(k), None, None, -1, errors="null")), _sql(every=_checked(_form_of("m[1:len(m):3]")), back=_checked(_form_of("list_reverse(m)")), large_every=f"array_to_string(string_split({_LARGE_SQL}, '')[2:length(k):2], '')", large_back=f"reverse({_LARGE_SQL})"))
_add("reversed", _per_document(morae=lambda k: F.array_join(access.reversed_morae(k), "|")), _sql(morae="array_to_string(list_reverse(m), '|')"))
_add("char_indices", _per_document(ends=lambda k: F.array_join(core.char_indices(k, zero=True).cast("array<string>"), ",")), _seeds() + """, u as (select doc_id, unnest(m) as x, generate_subscripts(m, 1) as i from t),
ends as (select doc_id, i, sum(length(x)) over (partition by doc_id order by i) as stop from u),
joined as (select doc_id, string_agg(cast(cast(stop as bigint) as varchar), ',' order by i) as ends from ends group by doc_id)
select t.doc_id, case when t.k is null then null else '0' || coalesce(',' || ends, '') end as ends from t left join joined on t.doc_id = joined.doc_id""")
_add("mora_histogram", lambda spark, sf_dir: mora_histogram(documents(spark, sf_dir), F.col("k")), _seeds() + "select mora, count(*) as n from (select unnest(m) as mora from t) group by mora")
_add("mora_positions", lambda spark, sf_dir: explode_morae(documents(spark, sf_dir), F.col("k"), position="at").groupBy("mora").agg(F.count("*").alias("n"), F.min("at").alias("first"), F.max("at").alias("last")), _seeds() + "select mora, count(*) as n, cast(min(pos) as int) as first, cast(max(pos) as int) as last from (select unnest(m) as mora, generate_subscripts(m, 1) - 1 as pos from t) group by mora")
_add("concat", _per_document(both=lambda k: access.concat(k, "カ"), same=lambda k: access.concat(access.slice_morae(k, 0, _half(core.mora_count(k))), access.slice_morae(k, _half(core.mora_count(k))), errors="null"), swapped=lambda k: access.concat(access.slice_morae(k, _half(core.mora_count(k))), access.slice_morae(k, 0, _half(core.mora_count(k))), errors="null")), _sql(both="k || 'カ'", same=_checked("e"), swapped=_checked(_form_of("m[len(m) // 2 + 1:] || m[1:len(m) // 2]"))))
_add("repeat", _per_document(thrice=lambda k: access.repeat(k, 3, errors="null"), large=lambda k: access.repeat(_large(k), 2)), _sql(thrice=_checked("repeat(e, 3)"), large=f"repeat({_LARGE_SQL}, 2)"))
_add("contains", _per_document(single=lambda k: search.contains(k, "ジ"), pair=lambda k: search.contains(k, _PAIR)), _sql(single="contains(e, '<ジ>')", pair=f"contains(e, '{_form(_PAIR)}')"))
_add("startswith", _per_document(whole=lambda k: search.startswith(k, ("ア", "デ")), bounded=lambda k: search.startswith(k, "ャ", 2, 12)), _sql(whole="starts_with(e, '<ア>') or starts_with(e, '<デ>')", bounded=f"len(m) >= 2 and starts_with({_PART}, '<ャ>')"))
_add("endswith", _per_document(whole=lambda k: search.endswith(k, ("ア", "デ")), bounded=lambda k: search.endswith(k, "ウ", 2, 12)), _sql(whole="ends_with(e, '<ア>') or ends_with(e, '<デ>')", bounded=f"len(m) >= 2 and ends_with({_PART}, '<ウ>')"))
_add("equals_join", lambda spark, sf_dir: (names := part_names(spark, sf_dir)).groupBy("k").agg(F.count("*").alias("n")).join(names.select("k").distinct(), "k").select("k", "n"), f"select {_K.replace('text', 'p_name')} as k, count(*) as n from part group by 1")
_add("find", _per_document(whole=lambda k: search.find(k, _PAIR), bounded=lambda k: search.find(k, "ウ", 2, 12)), _sql(whole=_find_sql("e", _PAIR), bounded=_find_sql(_PART, "ウ", "2")))
_add("find_charwise", _per_document(at=lambda k: search.find(k, _PAIR, charwise=True)), _sql(at=f"cast(case when strpos(e, '{_form(_PAIR)}') > 0 then length(translate(substr(e, 1, strpos(e, '{_form(_PAIR)}') - 1), '<>', '')) else -1 end as int)"))
_add("rfind", _per_document(at=lambda k: search.rfind(k, _PAIR), bounded=lambda k: search.rfind(k, "ウ", 2, 12)), _sql(at=_rfind_sql(_PAIR), bounded=_rfind_sql("ウ", _PART, "2")))
_add("index", _per_document(first=lambda k: search.index(k, _PAIR, errors="null"), last=lambda k: search.rindex(k, _PAIR, errors="null")), _sql(first=f"nullif({_find_sql('e', _PAIR)}, -1)", last=f"nullif({_rfind_sql(_PAIR)}, -1)"))
_count_sql = lambda form, n: f"cast((length({form}) - length(replace({form}, '{_form(n)}', ''))) / {len(_form(n))} as int)"
_add("count", _per_document(pair=lambda k: search.count(k, _PAIR), empty=lambda k: search.count(k, "")), _sql(pair=_count_sql("e", _PAIR), empty="cast(len(m) + 1 as int)"))
_add("count_bounded", _per_document(n=lambda k: search.count(k, "ウ", 2, 12)), _sql(n=_count_sql(_PART, "ウ")))
_add("finditer", _per_document(hits=lambda k: F.array_join(search.finditer(k, "ウ").cast("array<string>"), ",")), _sql(hits="array_to_string(list_filter(list_transform(m, lambda x, i: case when x = 'ウ' then i - 1 end), lambda i: i is not null), ',')"))
_add("removeprefix", _per_document(kana=lambda k: edit.removeprefix(k, "ア")), _sql(kana="translate(case when starts_with(e, '<ア>') then substr(e, 4) else e end, '<>', '')"))
_add("removesuffix", _per_document(kana=lambda k: edit.removesuffix(k, "ア")), _sql(kana="translate(case when ends_with(e, '<ア>') then substr(e, 1, length(e) - 3) else e end, '<>', '')"))
_add("replace", _per_document(kana=lambda k: edit.replace(k, _PAIR, "トウ", errors="null")), _sql(kana=_checked(f"replace(e, '{_form(_PAIR)}', '<ト><ウ>')")))
_add("replace_maxcount", _per_document(kana=lambda k: edit.replace(k, "ウ", "ノ", 1, errors="null")), _sql(kana=_checked("(case when strpos(e, '<ウ>') > 0 then substr(e, 1, strpos(e, '<ウ>') - 1) || '<ノ>' || substr(e, strpos(e, '<ウ>') + 3) else e end)")))
# A small kana of vowel A fuses with ト before it and makes the whole text null, but not with カ.
_add("insert_between", _per_document(kana=lambda k: edit.replace(k, "", "ト", errors="null"), same_vowel=lambda k: edit.replace(k, "", "カ", errors="null"), limited=lambda k: edit.replace(_large(k), "", "ト", 3)), _sql(kana=_checked("('<ト>' || replace(e, '>', '><ト>'))"), same_vowel=_checked("('<カ>' || replace(e, '>', '><カ>'))"), limited=f"regexp_replace(substr({_LARGE_SQL}, 1, 3), '(.)', 'ト\\1', 'g') || substr({_LARGE_SQL}, 4) || case when length(k) < 3 then 'ト' else '' end"))


def _choon_sql(ou: bool = False, ei: bool = False) -> str:
    rules = phonetic._rules(ou, ei, True)
    return f"regexp_replace(k, '{'|'.join(f'([{b}])[{x}]' for b, x in rules)}', '{''.join(f'\\{i + 1}' for i in range(len(rules)))}{LONG}', 'g')"


def _runs_sql(rules: list[tuple[str, str, str]]) -> str:
    """Runs of any length: a character before, the rest of the run, and what stands for each of the rest."""
    pieces = "regexp_extract_all(k, '" + "|".join(f"[{before}][{run}]+" for before, run, _ in rules) + "|.')"
    cases = " ".join(f"when contains('{before}', x[1]) then x[1] || repeat('{mark}', length(x) - 1)" for before, _, mark in rules)
    return f"array_to_string(list_transform({pieces}, lambda x: case when length(x) = 1 then x {cases} end), '')"


_CHOON_RUNS = _runs_sql([(before, run, LONG) for before, run in phonetic._rules(False, False, True)])
_VOWEL_RUNS = _runs_sql([(row, LONG, VOWELS[vowel]) for vowel, row in ROWS.items()])
_add("vowel_to_choon", _per_document(TO_LONG, plain=phonetic.vowel_to_choon, ou_ei=lambda k: phonetic.vowel_to_choon(k, ou=True, ei=True)), _sql(_LONG_K, plain=_choon_sql(), ou_ei=_choon_sql(True, True)))
_add("vowel_to_choon_runs", _per_document(TO_LONG, kana=lambda k: phonetic.vowel_to_choon(k, -1)), _sql(_LONG_K, kana=_CHOON_RUNS))
_add("choon_to_vowel", _per_document(TO_LONG, kana=lambda k: phonetic.choon_to_vowel(k, strict=False)), _sql(_LONG_K, kana=_VOWEL_RUNS))


def _same_count(sql: str) -> str:
    return f"case when len(regexp_extract_all({sql}, '{RE2}')) = len(m) then {sql} end"


_add("long_vowels_guarded", _per_document(TO_LONG, choon=lambda k: phonetic.vowel_to_choon(k, guard=True, errors="null"), vowel=lambda k: phonetic.choon_to_vowel(k, strict=False, guard=True, errors="null")), _sql(_LONG_K, choon=_same_count(_choon_sql()), vowel=_same_count(_VOWEL_RUNS)))
# Texts with all that isn't kana, which is dropped after the change: what stands between keeps kana apart.
_RAW_LONG = f"translate(text, '{FROM}', '{TO_LONG}')"
_add("vowel_to_choon_clean", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/documents.parquet").select("doc_id", phonetic.vowel_to_choon(F.translate("text", FROM, TO_LONG), clean=True).alias("kana")), f"select doc_id, regexp_replace(translate({_choon_sql().replace('(k,', f'({_RAW_LONG},')}, '-', '{LONG}'), '{NOT_KANA}', '', 'g') as kana from documents")
_add("fromstrs", _per_document(kana=lambda k: core.from_strs(F.substring(k, F.lit(1), _half(F.length(k))), ["シ", "ャ"], F.substring(k, _half(F.length(k)) + 1, F.length(k)))), _sql(kana="substr(k, 1, length(k) // 2) || 'シャ' || substr(k, length(k) // 2 + 1)"))
_add("table_override", lambda spark, sf_dir: spark.read.parquet(f"{sf_dir}/part.parquet").select("p_partkey", core.normalize(F.lower("p_name"), ignore=True, table={"a": "ア", "e": "エ", "ing": "ン", "o": "オ"}).alias("kana")), f"select p_partkey, regexp_replace(translate(replace(lower(p_name), 'ing', 'ン'), 'aeo', 'アエオ'), '{NOT_KANA}', '', 'g') as kana from part")


def queries() -> dict[str, Query]:
    return dict(_QUERIES)


def oracle_sql() -> dict[str, str]:
    return dict(_ORACLES)
