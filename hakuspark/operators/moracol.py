"""MoraCol: a mora column with the operators and methods of a Python sequence of morae."""

from __future__ import annotations

from collections.abc import Callable, Iterable, Mapping
from typing import Union

from pyspark.sql import Column
from pyspark.sql import functions as F

from hakuspark.functions import access, core, edit, phonetic, search
from hakuspark.functions.core import Text
from hakuspark.functions.tables import CONVERSION_TABLE

Needle = Union[Text, "MoraCol"]


class MoraCol:
    """A column of morae. Texts given to methods are literals, mora columns, or MoraCol.

    errors is the policy of what this column's methods check: "raise" or "null". Literal needles go through the same
    conversion table as the column.
    """

    table: Mapping[str, str] = CONVERSION_TABLE

    def __init__(self, kana: Column | str | MoraCol = "", *, ignore: bool = False, errors: str = "raise", table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None):
        self.errors = errors
        if isinstance(kana, MoraCol):
            self.string, self.table = kana.string, kana.table
        else:
            self.table = table
            raw = kana if isinstance(kana, Column) else F.lit(kana)
            self.string = core.mora_str(raw, ignore=ignore, errors=errors, table=table, converter=converter)

    @classmethod
    def of(cls, kana: Column, errors: str = "raise") -> MoraCol:
        """Wrap a column that is normalized already."""
        made = cls.__new__(cls)
        made.string, made.errors = kana, errors
        return made

    @classmethod
    def fromstrs(cls, *parts: Column | Iterable[str], ignore: bool = False, errors: str = "raise", table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None) -> MoraCol:
        made = cls.of(core.from_strs(*parts, ignore=ignore, errors=errors, table=table, converter=converter), errors)
        made.table = table
        return made

    @staticmethod
    def count_all(raw: Column, *, ignore: bool = False, table: Mapping[str, str] = CONVERSION_TABLE, converter: Callable[[Column], Column] | None = None) -> Column:
        return core.count_all(raw, ignore=ignore, table=table, converter=converter)

    def _text(self, value: Needle) -> Text:
        if isinstance(value, str):
            return core.literal(value, table=self.table)
        return value.string if isinstance(value, MoraCol) else value

    def _made(self, kana: Column) -> MoraCol:
        made = MoraCol.of(kana, self.errors)
        made.table = self.table
        return made

    @property
    def length(self) -> Column:
        return core.mora_count(self.string)

    @property
    def morae(self) -> Column:
        return core.morae(self.string)

    def tostr(self) -> Column:
        return self.string

    def repr(self) -> Column:
        return core.mora_repr(self.string)

    def char_indices(self, *, zero: bool = False) -> Column:
        return core.char_indices(self.string, zero=zero)

    def reversed(self) -> Column:
        return access.reversed_morae(self.string)

    def __getitem__(self, at: int | Column | slice) -> Column | MoraCol:
        if isinstance(at, slice):
            return self._made(access.slice_morae(self.string, at.start, at.stop, at.step, errors=self.errors))
        return access.item(self.string, at, errors=self.errors)

    def __add__(self, other: Needle) -> MoraCol:
        return self._made(access.concat(self.string, self._text(other), errors=self.errors))

    def __mul__(self, times: int | Column) -> MoraCol:
        return self._made(access.repeat(self.string, times, errors=self.errors))

    __rmul__ = __mul__

    def __eq__(self, other: object) -> Column:  # type: ignore[override]
        """Only mora columns are equal to mora columns; anything else differs."""
        return self.string == other.string if isinstance(other, MoraCol) else F.lit(False)

    def __ne__(self, other: object) -> Column:  # type: ignore[override]
        return self.string != other.string if isinstance(other, MoraCol) else F.lit(True)

    __hash__ = None  # type: ignore[assignment]

    def hash(self) -> Column:
        return F.xxhash64(self.string)

    def contains(self, needle: Needle) -> Column:
        return search.contains(self.string, self._text(needle))

    def _texts(self, value: Needle | tuple[Needle, ...]) -> Text | tuple[Text, ...]:
        return tuple(map(self._text, value)) if isinstance(value, tuple) else self._text(value)

    def startswith(self, prefix: Needle | tuple[Needle, ...], start: access.Bound = None, end: access.Bound = None) -> Column:
        return search.startswith(self.string, self._texts(prefix), start, end)

    def endswith(self, suffix: Needle | tuple[Needle, ...], start: access.Bound = None, end: access.Bound = None) -> Column:
        return search.endswith(self.string, self._texts(suffix), start, end)

    def find(self, needle: Needle, start: access.Bound = None, end: access.Bound = None, *, charwise: bool = False) -> Column:
        return search.find(self.string, self._text(needle), start, end, charwise=charwise)

    def rfind(self, needle: Needle, start: access.Bound = None, end: access.Bound = None, *, charwise: bool = False) -> Column:
        return search.rfind(self.string, self._text(needle), start, end, charwise=charwise)

    def index(self, needle: Needle, start: access.Bound = None, end: access.Bound = None, *, charwise: bool = False) -> Column:
        return search.index(self.string, self._text(needle), start, end, charwise=charwise, errors=self.errors)

    def rindex(self, needle: Needle, start: access.Bound = None, end: access.Bound = None, *, charwise: bool = False) -> Column:
        return search.rindex(self.string, self._text(needle), start, end, charwise=charwise, errors=self.errors)

    def count(self, needle: Needle, start: access.Bound = None, end: access.Bound = None) -> Column:
        return search.count(self.string, self._text(needle), start, end)

    def finditer(self, needle: Needle, *, charwise: bool = False) -> Column:
        return search.finditer(self.string, self._text(needle), charwise=charwise)

    def removeprefix(self, prefix: Needle) -> MoraCol:
        return self._made(edit.removeprefix(self.string, self._text(prefix)))

    def removesuffix(self, suffix: Needle) -> MoraCol:
        return self._made(edit.removesuffix(self.string, self._text(suffix)))

    def replace(self, old: Needle, new: Needle, maxcount: int | Column = -1) -> MoraCol:
        return self._made(edit.replace(self.string, self._text(old), self._text(new), maxcount, errors=self.errors))

    def vowel_to_choon(self, maxrep: int = 1, *, ou: bool = False, ei: bool = False, nn: bool = True) -> MoraCol:
        return self._made(phonetic.vowel_to_choon(self.string, maxrep, ou=ou, ei=ei, nn=nn, guard=True, errors=self.errors))

    def choon_to_vowel(self, *, strict: bool = True) -> MoraCol:
        return self._made(phonetic.choon_to_vowel(self.string, strict=strict, guard=True, errors=self.errors))
