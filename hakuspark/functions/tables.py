"""Kana tables, the conversion table, and regular expressions built from them."""

from __future__ import annotations

import re
import unicodedata
from collections.abc import Mapping
from functools import cache
from types import MappingProxyType

# The full-width katakana by vowel (N stands alone; others have no vowel), and the small kana that attach
# to a different vowel.
ROWS = {
    "A": "ァアカガサザタダナハバパマャヤラヮワヷ",
    "I": "ィイキギシジチヂニヒビピミリヰヸ",
    "U": "ゥウクグスズツヅヌフブプムュユルヴ",
    "E": "ェエケゲセゼテデネヘベペメレヱヹ",
    "O": "ォオコゴソゾトドノホボポモョヨロヲヺ",
    "N": "ン",
}
SMALL = {"A": "ァャヮ", "I": "ィ", "U": "ゥュ", "E": "ェ", "O": "ォョ"}
VOWELS = {"A": "ア", "I": "イ", "U": "ウ", "E": "エ", "O": "オ", "N": "ン"}
LONG = "ー"
ANY = "ァ-ヾ"
NOT_KANA = f"[^{ANY}]"
HIRAGANA = "".join(map(chr, [*range(0x3041, 0x3097), 0x309D, 0x309E]))
KATAKANA = "".join(chr(ord(c) + 0x60) for c in HIRAGANA)
SMALLS = "".join(SMALL.values())
#: Longest run of characters in one mora.
LIMIT = 3

def _conversion_table() -> dict[str, str]:
    """Half-width katakana, alone and with either sound mark, to what Unicode's compatibility forms make of them."""
    singles = [chr(i) for i in range(0xFF65, 0xFF9E)]
    composed = {key: unicodedata.normalize("NFKC", key) for key in [*singles, *(x + mark for mark in "\uff9e\uff9f" for x in singles)]}
    return {key: kana for key, kana in composed.items() if len(kana) == 1} | {"-": LONG}


CONVERSION_TABLE: Mapping[str, str] = MappingProxyType(_conversion_table())


def checked_table(mapping: Mapping[str, str]) -> dict[str, str]:
    """A conversion table, or ValueError: keys hold neither full-width katakana nor hiragana, values are one katakana."""
    for key, value in mapping.items():
        if not isinstance(key, str) or not isinstance(value, str):
            raise TypeError("a table maps strings to strings")
        if not key or re.search(f"[{ANY}{HIRAGANA}]", key):
            raise ValueError(f"a key must be neither empty nor hold full-width kana: {key!r}")
        if not re.fullmatch(f"[{ANY}]", value):
            raise ValueError(f"a value must be one full-width katakana: {value!r}")
    return dict(mapping)


def key_passes(table: Mapping[str, str]) -> list[list[str]]:
    """The keys of several characters by pass: those of three or more, longest first, and then those of two.

    In each pass keys are looked for from the left, all at once. Single characters come last.
    """
    long = sorted((k for k in table if len(k) > 2), key=lambda k: (-len(k), k))
    return [keys for keys in (long, sorted(k for k in table if len(k) == 2)) if keys]


#: A small kana that joins what is before it, as its vowel is another one. Most kana fail the first test.
_JOINS = f"(?=[{SMALLS}])(?:" + "|".join(f"(?<![{ROWS[v]}])[{small}]" for v, small in SMALL.items()) + ")"
#: One mora (Java and Python): a kana, and small kana that join.
MORA = f"[{ANY}](?:{_JOINS})*"
#: A mora over the limit.
TOO_LONG = f"[{ANY}](?:{_JOINS}){{{LIMIT},}}"


@cache
def mora_without_lookaround(depth: int = LIMIT) -> str:
    """The same mora for engines without lookaround: nested alternatives by vowel, to a depth."""

    def follow(vowel: str, left: int) -> str:
        if left == 1:
            return "[" + "".join(s for v, s in SMALL.items() if v != vowel) + "]?"
        return "(?:" + "|".join(f"[{s}]{follow(v, left - 1)}" for v, s in SMALL.items() if v != vowel) + ")?"

    rest = "".join(c for c in map(chr, range(ord("ァ"), ord("ヾ") + 1)) if not any(c in ROWS[v] for v in SMALL))
    heads = [f"[{ROWS[v]}]{follow(v, depth)}" for v in SMALL] + [f"[{rest}]{follow('', depth)}"]
    return "(?:" + "|".join(heads) + ")"


def to_katakana(text: str, ignore: bool = False, table: Mapping[str, str] = CONVERSION_TABLE) -> str:
    """Literal text as full-width katakana; ValueError for other characters unless they are ignored."""
    kana = text
    for keys in key_passes(table):
        kana = re.sub("|".join(map(re.escape, keys)), lambda m: table[m[0]], kana)
    kana = kana.translate(dict(zip(map(ord, HIRAGANA), KATAKANA)) | {ord(k): v for k, v in table.items() if len(k) == 1})
    if ignore:
        return re.sub(NOT_KANA, "", kana)
    if bad := re.search(NOT_KANA, kana):
        raise ValueError(f"invalid character: {bad[0]!r} (u+{ord(bad[0]):04x})")
    return kana


def split_morae(kana: str) -> list[str]:
    """Morae of literal full-width katakana."""
    found = re.findall(MORA, kana)
    if any(len(m) > LIMIT for m in found):
        raise ValueError(f"each mora must have at most {LIMIT} characters")
    return found
