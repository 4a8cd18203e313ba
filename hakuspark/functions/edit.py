"""Removing and replacing by mora."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hakuspark.functions.core import SMALLS, Text, brackets_of, decoded, encoded, failing, kana_of, let, literal, marks, well_formed


def removeprefix(kana: Column, prefix: Text) -> Column:
    cut = brackets_of(prefix)
    return let(encoded(kana), lambda form: decoded(F.when(F.startswith(form, cut), F.substring(form, F.length(cut) + 1, F.length(form))).otherwise(form)))


def removesuffix(kana: Column, suffix: Text) -> Column:
    cut = brackets_of(suffix)
    return let(encoded(kana), lambda form: decoded(F.when(F.endswith(form, cut), F.substring(form, F.lit(1), F.length(form) - F.length(cut))).otherwise(form)))


def replace(kana: Column, old: Text, new: Text, maxcount: Column | int = -1, *, errors: str = "raise") -> Column:
    """Hits of old replaced by new, at most maxcount from the left (negative: all).

    An empty old puts new before every mora and at the end. A new text that starts with a small kana, and a result
    whose morae would fuse otherwise than intended, are errors or null.
    """
    if isinstance(new, str) and literal(new)[:1] in tuple(SMALLS):
        raise ValueError("the new text must not start with a small kana")
    was, put = brackets_of(old), brackets_of(new)
    limit = maxcount if isinstance(maxcount, Column) else F.lit(maxcount)

    def some(form: Column) -> Column:
        if isinstance(maxcount, int) and maxcount < 0:
            return F.replace(form, was, put)
        pieces = F.split(form, F.concat(F.lit("\\Q"), was, F.lit("\\E")), F.when(limit < 0, -1).otherwise(limit + 1))
        tail = lambda p: F.transform(F.slice(p, F.lit(2), F.size(p)), lambda x: F.concat(put, x))
        return F.when(limit == 0, form).otherwise(let(pieces, lambda p: F.concat(F.get(p, F.lit(0)), F.array_join(tail(p), ""))))

    def everywhere(form: Column) -> Column:
        # Every mora, numbered, takes new before it while the limit lasts.
        numbered = F.transform(F.split(F.translate(form, ">", ""), "<"), lambda m, i: F.when(i == 0, "").otherwise(F.concat(F.when((limit < 0) | (i <= limit), put).otherwise(""), F.lit("<"), m, F.lit(">"))))
        return F.concat(F.array_join(numbered, ""), F.when((limit < 0) | (marks(form) < limit), put).otherwise(""))

    result = well_formed(let(encoded(kana), lambda form: F.when(was == "", everywhere(form)).otherwise(some(form))), errors)
    if isinstance(new, Column):
        small = kana_of(new).rlike(f"^[{SMALLS}]")
        return failing(small, "the new text must not start with a small kana", result, errors)
    return result
