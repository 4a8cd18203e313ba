"""Normalizing kana columns and splitting them into morae.

All functions take and return columns and stay in the JVM. A *mora column* is a string column of full-width
katakana; morae, offsets and the bracket form (every mora between < and >) derive from it. Null gives null. Where a
value is wrong, errors="raise" fails the query and errors="null" gives null.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F

from hakuspark.functions.tables import CONVERSION_TABLE, HIRAGANA, KATAKANA, LIMIT, MORA, NOT_KANA, SMALLS, TOO_LONG, checked_table, key_passes, split_morae, to_katakana

Text = Column | str


def let(value: Column, body: Callable[[Column], Column]) -> Column:
    """body of a value that is computed once, however often body uses it (also inside other lambda functions)."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def failing(bad: Column, message: Column | str, value: Column, errors: str = "raise") -> Column:
    """value, unless bad holds: then an error or null."""
    if errors not in ("raise", "null"):
        raise ValueError("errors must be 'raise' or 'null'")
    wrong = F.raise_error(F.lit(message) if isinstance(message, str) else message) if errors == "raise" else F.lit(None)
    return F.when(bad, wrong.cast("string") if errors == "raise" else wrong).otherwise(value)


def _literally(text: str) -> str:
    """A Java pattern of just this text."""
    return "".join(f"\\x{{{ord(c):x}}}" for c in text)


def put_together(gaps: Column, hits: Column) -> Column:
    """A text from what stands between hits, and the hits (one fewer) or what replaces them."""
    return F.array_join(F.zip_with(gaps, hits, lambda gap, hit: F.concat(gap, F.coalesce(hit, F.lit("")))), "")


def _table_steps(col: Column, table: Mapping[str, str]) -> Column:
    for keys in key_passes(table):
        if len(keys[0]) == 2:
            pattern = "|".join(f"[{_literally(''.join(k[0] for k in keys if k[1] == last))}]{_literally(last)}" for last in sorted({k[1] for k in keys}))
        else:
            pattern = "|".join(map(_literally, keys))
        values = F.create_map(*(F.lit(x) for k in keys for x in (k, table[k])))
        col = _replaced(col, pattern, values)
    single = "".join(k for k in table if len(k) == 1)
    return F.translate(col, single + HIRAGANA, "".join(table[k] for k in single) + KATAKANA)


def _replaced(col: Column, pattern: str, values: Column) -> Column:
    """Matches replaced by their values, all in one pass from the left."""
    hits = F.transform(F.regexp_extract_all(col, F.lit(pattern), 0), lambda hit: F.element_at(values, hit))
    return F.when(col.rlike(pattern), put_together(F.split(col, pattern, -1), hits)).otherwise(col)


def python_converter(f: Callable[[str], str]) -> Callable[[Column], Column]:
    """A converter from any Python function of one string; it runs in Arrow batches, and isn't asked for nulls."""

    @F.pandas_udf("string")
    def convert(texts: pd.Series) -> pd.Series:
        return texts.map(f, na_action="ignore")

    return convert


def normalize(raw: Column, *, ignore: bool = False, errors: str = "raise", table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None) -> Column:
    """Hiragana and half-width katakana as full-width katakana; other characters are errors, or dropped by ignore.

    table replaces the conversion table; its keys of three or more characters are replaced first, then those of two,
    then single ones, each from the left. converter, a function of columns, runs before it; python_converter makes
    one of a Python function.
    """
    table = table if table is CONVERSION_TABLE else checked_table(table)
    col = converter(raw) if converter else raw
    # Most text is full-width already, and then no replacement runs.
    kana = F.when(col.rlike(NOT_KANA), _table_steps(col, table)).otherwise(col)
    if ignore:
        return F.regexp_replace(kana, NOT_KANA, "")
    first = F.regexp_extract(kana, NOT_KANA, 0)
    return failing(kana.rlike(NOT_KANA), F.concat(F.lit("invalid character: '"), first, F.lit("' (u+"), F.lpad(F.lower(F.hex(F.ascii(first))), 4, "0"), F.lit(")")), kana, errors)


def mora_str(raw: Column, *, ignore: bool = False, errors: str = "raise", table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None) -> Column:
    """A mora column from any kana text: normalized, with no mora of more than three characters."""
    kana = normalize(raw, ignore=ignore, errors=errors, table=table, converter=converter)
    return failing(kana.rlike(TOO_LONG), f"each mora must have at most {LIMIT} characters", kana, errors)


def from_strs(*parts: Column | Iterable[str], ignore: bool = False, errors: str = "raise", table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None) -> Column:
    """A mora column from arrays of strings, strings, or literal strings, joined before anything else."""

    def piece(position: int, part: Column | Iterable[str]) -> Column:
        if isinstance(part, Column):
            return part
        items = [part] if isinstance(part, str) else list(part)
        if not all(isinstance(x, (str, Column)) for x in items):
            raise TypeError(f"argument {position} must hold only strings")
        return F.concat(*(x if isinstance(x, Column) else F.lit(x) for x in items)) if items else F.lit("")

    joined = F.concat(*(piece(i, p) for i, p in enumerate(parts, 1))) if parts else F.lit("")
    return mora_str(joined, ignore=ignore, errors=errors, table=table, converter=converter)


def joined_array(col: Column) -> Column:
    """The text of an array of strings, for from_strs."""
    return F.array_join(col, "")


def has_leading_small(kana: Column) -> Column:
    """Whether the text starts with a small kana, which then is a mora of its own."""
    return kana.rlike(f"^[{SMALLS}]")


def morae(kana: Column) -> Column:
    return F.regexp_extract_all(kana, F.lit(MORA), 0)


def encoded(kana: Column) -> Column:
    """Bracket form: in it, a search for whole morae is a plain substring search."""
    return F.regexp_replace(kana, MORA, "<$0>")


def decoded(brackets: Column) -> Column:
    return F.translate(brackets, "<>", "")


def mora_count(kana: Column) -> Column:
    return F.regexp_count(kana, F.lit(MORA))


def count_all(raw: Column, *, ignore: bool = False, errors: str = "raise", table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None) -> Column:
    """Number of morae of any kana text."""
    return mora_count(mora_str(raw, ignore=ignore, errors=errors, table=table, converter=converter))


def mora_repr(kana: Column) -> Column:
    return F.when(kana == "", "MoraStr()").otherwise(F.concat(F.lit("MoraStr('"), F.array_join(morae(kana), "' '"), F.lit("')")))


def char_indices(kana: Column, *, zero: bool = False) -> Column:
    """The position in characters after each mora; with zero, 0 stands first."""
    # Each blank between morae stands behind as many characters as the mora's end, and the blanks before it.
    between = lambda m: F.transform(places(F.array_join(m, " "), " "), lambda at, i: at - i)
    ends = let(morae(kana), lambda m: F.when(F.size(m) > 0, F.concat(between(m), F.array(F.length(F.array_join(m, ""))))).when(m.isNotNull(), F.array().cast("array<int>")))
    return F.concat(F.array(F.lit(0)), ends) if zero else ends


def literal(text: str, ignore: bool = False, table: Mapping[str, str] = CONVERSION_TABLE) -> str:
    """A literal kana text, normalized and checked on the driver.

    Needles of the search and edit functions are literals of the default table; of another table, pass
    literal(text, table=...).
    """
    kana = to_katakana(text, ignore, table if table is CONVERSION_TABLE else checked_table(table))
    split_morae(kana)
    return kana


def kana_of(text: Text) -> Column:
    """A mora column: a column as it is, or a literal text."""
    return text if isinstance(text, Column) else F.lit(literal(text))


def brackets_of(text: Text) -> Column:
    """The bracket form of a needle; a literal's is made on the driver."""
    return encoded(text) if isinstance(text, Column) else F.lit("".join(f"<{m}>" for m in split_morae(literal(text))))


def part_of(form: Column, a: Column, b: Column) -> Column:
    """The bracket form of morae [a:b] of a bracket form, 0 <= a, b <= its number of morae."""
    before = lambda n: F.when(n > 0, F.concat(F.call_function("substring_index", form, F.lit(">"), n), F.lit(">"))).otherwise("")
    return F.when(a < b, F.substring(before(b), F.length(before(a)) + 1, F.length(form))).when(form.isNotNull(), "")


def marks(brackets: Column) -> Column:
    """Number of morae in a bracket form."""
    return F.length(brackets) - F.length(F.replace(brackets, F.lit("<")))


def places(text: Column, mark: str) -> Column:
    """The 0-based positions of a character, in time that grows with the text only."""
    return F.filter(F.transform(F.split(text, ""), lambda c, i: F.when(c == mark, i)), lambda i: i.isNotNull())


def well_formed(brackets: Column, errors: str = "raise", message: str = "ill-formed mora string") -> Column:
    """The text of a bracket form, if splitting it again gives the same morae."""
    return let(brackets, lambda form: let(decoded(form), lambda text: failing(encoded(text) != form, message, text, errors)))

