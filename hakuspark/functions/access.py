"""Items, slices, concatenation and repetition by mora."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hakuspark.functions.core import brackets_of, encoded, failing, let, morae, well_formed

Bound = Column | int | None


def bound(value: Bound, size: Column, default: Column) -> Column:
    """A slice bound as in Python: counted from the end if negative, and kept within 0 and size."""
    if value is None:
        return default
    at = value if isinstance(value, Column) else F.lit(value)
    return F.coalesce(F.when(at < 0, F.greatest(size + at, F.lit(0))).otherwise(F.least(at, size)), default)


def bounds(size: Column, start: Bound, end: Bound) -> tuple[Column, Column]:
    return bound(start, size, F.lit(0)), bound(end, size, size)


def item(kana: Column, index: Column | int, *, errors: str = "raise") -> Column:
    """The mora at a 0-based index, negative from the end; out of range is an error or null."""
    at = index if isinstance(index, Column) else F.lit(index)
    found = F.try_element_at(morae(kana), F.when(at < 0, at).otherwise(at + 1).cast("int"))
    return failing(kana.isNotNull() & at.isNotNull() & found.isNull(), "mora index out of range", found, errors)


def part(m: Column, start: Bound, end: Bound) -> Column:
    """Elements [start:end] of an array of morae."""
    a, b = bounds(F.size(m), start, end)
    return F.slice(m, a + 1, F.greatest(b - a, F.lit(0)))


def form_of(m: Column) -> Column:
    """The bracket form of an array of morae."""
    return F.when(F.size(m) > 0, F.concat(F.lit("<"), F.array_join(m, "><"), F.lit(">"))).when(m.isNotNull(), "")


def slice_morae(kana: Column, start: Bound = None, end: Bound = None, step: int | None = None, *, errors: str = "raise") -> Column:
    """Morae [start:end:step] as text. With a step, morae that would fuse are an error or null."""
    step = 1 if step is None else step
    if step == 0:
        raise ValueError("slice step cannot be zero")
    if step == 1:
        return let(morae(kana), lambda m: F.array_join(part(m, start, end), ""))
    return well_formed(let(morae(kana), lambda m: form_of(_stepped(m, start, end, step))), errors)


def _stepped(m: Column, start: Bound, end: Bound, step: int) -> Column:
    """Elements [start:end:step] of an array, step not 1."""
    n = F.size(m)
    if step > 0:
        a, b = bounds(n, start, end)
        last = b - 1
    else:

        def low(value: Bound, default: Column) -> Column:
            if value is None:
                return default
            at = value if isinstance(value, Column) else F.lit(value)
            return F.coalesce(F.when(at < 0, F.greatest(n + at, F.lit(-1))).otherwise(F.least(at, n - 1)), default)

        a, last = low(start, n - 1), low(end, F.lit(-1)) + 1
    some = (a <= last) if step > 0 else (a >= last)
    at = F.sequence(F.when(some, a).otherwise(0), F.when(some, last).otherwise(0), F.lit(step) if step > 0 else F.when(some, step).otherwise(1))
    picked = F.transform(F.when(some, at).otherwise(F.array().cast("array<int>")), lambda i: F.get(m, i))
    return F.when(m.isNotNull(), picked)


def reversed_morae(kana: Column) -> Column:
    """Morae from last to first, as an array."""
    return F.reverse(morae(kana))


def concat(kana: Column, other: Column | str, *, errors: str = "raise") -> Column:
    """Both texts in a row; if a mora would fuse across the seam, an error or null."""
    return well_formed(F.concat(encoded(kana), brackets_of(other)), errors, "mora length inconsistency")


def repeat(kana: Column, times: Column | int, *, errors: str = "raise") -> Column:
    return well_formed(F.repeat(encoded(kana), times if isinstance(times, Column) else F.lit(times)), errors, "mora length inconsistency")


def equals(kana: Column, other: Column) -> Column:
    """Equality of mora columns is that of their texts, which therefore serve as join and grouping keys."""
    return kana == other
