"""Searching by mora: bounds are mora indices as in Python slices, hits do not overlap, leftmost first."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hakuspark.functions.access import Bound, bounds
from hakuspark.functions.core import Text, brackets_of, encoded, failing, kana_of, let, marks, part_of, places

#: In place of a hit in a bracket form, which holds only katakana and brackets.
HIT = "\ue000"


def _beyond(start: Bound, size: Column) -> Column:
    """Whether start lies after the end of the text."""
    return F.lit(False) if start is None else (start if isinstance(start, Column) else F.lit(start)) > size


def contains(kana: Column, needle: Text) -> Column:
    # The plain texts are a cheap necessary condition.
    return F.contains(kana, kana_of(needle)) & F.contains(encoded(kana), brackets_of(needle))


def _within(kana: Column, start: Bound, end: Bound, result) -> Column:
    """result(form, part, n, a, b) of a text's bracket form, that of its morae [a:b], and its number of morae."""

    def given(form: Column) -> Column:
        if start is None and end is None:
            return let(marks(form), lambda n: result(form, form, n, F.lit(0), n))

        def bounded(n: Column) -> Column:
            a, b = bounds(n, start, end)
            return let(F.struct(a.alias("a"), b.alias("b")), lambda r: let(part_of(form, r["a"], r["b"]), lambda part: result(form, part, n, r["a"], r["b"])))

        return let(marks(form), bounded)

    return let(encoded(kana), given)


def _tail(kana: Column, needles: Text | tuple[Text, ...], start: Bound, end: Bound, test) -> Column:
    def fits(form: Column, part: Column, n: Column, a: Column, b: Column) -> Column:
        some = F.lit(False)
        for needle in needles if isinstance(needles, tuple) else (needles,):
            some = some | test(part, brackets_of(needle))
        return some & (a <= b) & ~_beyond(start, n)

    return F.when(kana.isNotNull(), _within(kana, start, end, fits))


def startswith(kana: Column, prefixes: Text | tuple[Text, ...], start: Bound = None, end: Bound = None) -> Column:
    """Whether morae [start:end] start with the prefix, or with any of a tuple."""
    return _tail(kana, prefixes, start, end, F.startswith)


def endswith(kana: Column, suffixes: Text | tuple[Text, ...], start: Bound = None, end: Bound = None) -> Column:
    return _tail(kana, suffixes, start, end, F.endswith)


def _found(kana: Column, needle: Text, start: Bound, end: Bound, charwise: bool, last: bool) -> Column:
    if charwise and not (start is None and end is None):
        raise TypeError("charwise can't be combined with bounds")
    wanted = brackets_of(needle)

    def hit(form: Column) -> Column:
        if last:
            back = F.instr(F.reverse(form), F.reverse(wanted))
            return F.when(back > 0, F.length(form) - back - F.length(wanted) + 2).otherwise(0)
        return F.instr(form, wanted)

    def place(form: Column, part: Column, n: Column, a: Column, b: Column) -> Column:
        before = lambda at: marks(F.substring(part, F.lit(1), at - 1))
        found = let(hit(part), lambda at: F.when(at > 0, at - 1 - 2 * before(at) if charwise else before(at) + a).otherwise(-1))
        empty = (F.length(kana) if charwise else b) if last else a
        return F.when(_beyond(start, n), -1).when(wanted == "", F.when(a <= b, empty).otherwise(-1)).otherwise(found)

    return F.when(kana.isNotNull() & wanted.isNotNull(), _within(kana, start, end, place)).cast("int")


def find(kana: Column, needle: Text, start: Bound = None, end: Bound = None, *, charwise: bool = False) -> Column:
    """Mora index of the first hit, or -1; with charwise the index in characters."""
    return _found(kana, needle, start, end, charwise, False)


def rfind(kana: Column, needle: Text, start: Bound = None, end: Bound = None, *, charwise: bool = False) -> Column:
    """Mora index of the last hit, or -1."""
    return _found(kana, needle, start, end, charwise, True)


def index(kana: Column, needle: Text, start: Bound = None, end: Bound = None, *, charwise: bool = False, errors: str = "raise") -> Column:
    """As find, but a needle that isn't there is an error or null."""
    at = find(kana, needle, start, end, charwise=charwise)
    return failing(at < 0, "submora-string not found", at, errors).cast("int")


def rindex(kana: Column, needle: Text, start: Bound = None, end: Bound = None, *, charwise: bool = False, errors: str = "raise") -> Column:
    at = rfind(kana, needle, start, end, charwise=charwise)
    return failing(at < 0, "submora-string not found", at, errors).cast("int")


def count(kana: Column, needle: Text, start: Bound = None, end: Bound = None) -> Column:
    """Number of hits in morae [start:end]; an empty needle counts the gaps."""
    wanted = brackets_of(needle)

    def number(form: Column, part: Column, n: Column, a: Column, b: Column) -> Column:
        hits = (F.length(part) - F.length(F.replace(part, wanted))) / F.greatest(F.length(wanted), F.lit(1))
        return F.when(_beyond(start, n), 0).when(wanted == "", F.greatest(b - a + 1, F.lit(0))).otherwise(hits)

    return F.when(kana.isNotNull() & wanted.isNotNull(), _within(kana, start, end, number)).cast("int")


def finditer(kana: Column, needle: Text, *, charwise: bool = False) -> Column:
    """Indices of all hits, as an array. A needle of more morae than the text swaps roles with it."""
    other = brackets_of(needle)
    # What is searched and what is searched for, after the swap.
    roles = let(encoded(kana), lambda form: F.when(marks(form) < marks(other), F.struct(other.alias("form"), form.alias("wanted"))).otherwise(F.struct(form.alias("form"), other.alias("wanted"))))
    return let(roles, lambda r: F.when(r["form"].isNotNull() & r["wanted"].isNotNull(), F.when(r["wanted"] == "", _ends(r["form"], charwise)).otherwise(_hits(r["form"], r["wanted"], charwise))))


def _ends(form: Column, charwise: bool) -> Column:
    """All places between morae."""
    if not charwise:
        return F.sequence(F.lit(0), marks(form))
    # Every mora's end stands behind the closing brackets before it.
    return F.concat(F.array(F.lit(0)), F.transform(places(F.replace(form, F.lit("<")), ">"), lambda at, i: at - i))


def _hits(form: Column, wanted: Column, charwise: bool) -> Column:
    """Where the needle stands: each hit becomes one mark, among one character for each mora (or character) between."""
    marked = F.replace(form, wanted, F.lit(HIT))
    thin = F.translate(marked, "<>", "") if charwise else F.regexp_replace(marked, f"[^<{HIT}]", "")
    length = F.length(wanted) - 2 * marks(wanted) if charwise else marks(wanted)
    return let(length, lambda step: F.transform(places(thin, HIT), lambda at, i: (at + i * (step - 1)).cast("int")))
