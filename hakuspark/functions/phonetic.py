"""Long vowels: written as vowel kana, or with the prolonged sound mark."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from hakuspark.functions.core import failing, let, mora_count, normalize, put_together
from hakuspark.functions.tables import LONG, ROWS, VOWELS

#: The kana that write each vowel by themselves, large and small.
LETTERS = {"A": "アァ", "I": "イィ", "U": "ウゥ", "E": "エェ", "O": "オォ"}
#: What may follow in a pair that is replaced; few places pass this first test.
_NEXT = f"(?s)(?=.[{''.join(LETTERS.values())}ン])"


def _rules(ou: bool, ei: bool, nn: bool) -> list[tuple[str, str]]:
    """(characters before, repeated vowel kana): after one of the former, the latter is a long vowel."""
    rules = []
    for vowel, letters in LETTERS.items():
        before = ROWS[vowel] + (ROWS["O"] if ou and vowel == "U" else "") + (ROWS["E"] if ei and vowel == "I" else "")
        rules.append((before, letters))
    return rules + [(ROWS["N"], VOWELS["N"])] * nn


def vowel_to_choon(text: Column, maxrep: int = 1, *, clean: bool = False, ou: bool = False, ei: bool = False, nn: bool = True, guard: bool = False, errors: str = "raise") -> Column:
    """A vowel kana that repeats the vowel before it becomes the prolonged sound mark, up to maxrep in a row (-1: all).

    ou and ei also take those two pairs, at most one in a row; nn takes a repeated N. Any text passes through; only
    full-width katakana are looked at. clean normalizes the result and drops what isn't kana. guard is for mora
    columns: a changed number of morae is an error or null.
    """
    out = text
    if maxrep == 1:
        rules = _rules(ou, ei, nn)
        groups = "".join(f"${i + 1}" for i in range(len(rules)))
        out = F.regexp_replace(text, f"{_NEXT}(?:{'|'.join(f'([{before}])[{letters}]' for before, letters in rules)})", groups + LONG)
    elif maxrep:
        # Each hit is a character before and a run of vowel kana after it, which becomes a run of marks. The extra
        # pairs take one place only, so they are kept apart from the runs of equal vowels.
        most = "" if maxrep < 0 else str(maxrep)
        runs = [f"[{before}][{letters}]{{1,{most}}}" for before, letters in _rules(False, False, nn)]
        runs += [f"[{ROWS['O']}][ウゥ]"] * ou + [f"[{ROWS['E']}][イィ]"] * ei
        pattern = f"{_NEXT}(?:{'|'.join(runs)})"
        hits = F.transform(F.regexp_extract_all(text, F.lit(pattern), 0), lambda x: F.rpad(F.substring(x, 1, 1), F.length(x), LONG))
        out = put_together(F.split(text, pattern, -1), hits)
    return _finished(text, out, clean, guard, errors)


def choon_to_vowel(text: Column, *, strict: bool = True, clean: bool = False, guard: bool = False, errors: str = "raise") -> Column:
    """Each prolonged sound mark becomes the vowel of the katakana before its run (N after N).

    Where there is none, strict makes it an error or null; otherwise the mark stays.
    """
    # What stands between marks and runs of marks take turns; the character before a run tells its vowel.
    pieces = F.regexp_extract_all(text, F.lit(f"[^{LONG}]+|{LONG}+"), 0)
    kana, vowels = "".join(ROWS.values()), "".join(VOWELS[v] * len(row) for v, row in ROWS.items())

    def filled(all_: Column, x: Column, i: Column) -> Column:
        before = F.substring(F.get(all_, i - 1), -1, 1)
        run = F.rpad(F.lit(""), F.length(x), F.translate(before, kana, vowels))
        return F.when(F.startswith(x, F.lit(LONG)) & F.instr(F.lit(kana), before).between(1, len(kana)), run).otherwise(x)

    out = F.when(F.contains(text, F.lit(LONG)), let(pieces, lambda p: F.array_join(F.transform(p, lambda x, i: filled(p, x, i)), ""))).otherwise(text)
    if strict:
        out = failing(F.contains(out, F.lit(LONG)), "no vowel before a prolonged sound mark", out, errors)
    return _finished(text, out, clean, guard, errors)


def _finished(text: Column, out: Column, clean: bool, guard: bool, errors: str) -> Column:
    if guard:
        out = failing(mora_count(text) != mora_count(out), "mora length inconsistency", out, errors)
    return normalize(out, ignore=True) if clean else out
