"""A plain model of mora texts, to hold columns against."""

import re

from hakuspark.functions.tables import ROWS, SMALL, VOWELS, split_morae

VOWEL_OF = {c: v for v, row in ROWS.items() for c in row}
SMALL_OF = {c: v for v, row in SMALL.items() for c in row}


def morae(text):
    out = []
    for i, c in enumerate(text):
        if i and c in SMALL_OF and SMALL_OF[c] != VOWEL_OF.get(text[i - 1]):
            out[-1] += c
        else:
            out.append(c)
    return out


def adjust(n, a, b):
    s = slice(a, b).indices(n)
    return s[0], s[1]


def hits(m, x, a=None, b=None):
    """Leftmost non-overlapping positions of x within m[a:b]."""
    i, e = adjust(len(m), a, b)
    out = []
    while i + len(x) <= e:
        if m[i : i + len(x)] == x:
            out.append(i)
            i += len(x)
        else:
            i += 1
    return out


def find(m, x, a=None, b=None):
    s, e = adjust(len(m), a, b)
    if a is not None and a > len(m):
        return -1
    if not x:
        return s if s <= e else -1
    found = hits(m, x, a, b)
    return found[0] if found else -1


def rfind(m, x, a=None, b=None):
    s, e = adjust(len(m), a, b)
    if a is not None and a > len(m):
        return -1
    if not x:
        return e if s <= e else -1
    found = [i for i in range(s, e - len(x) + 1) if m[i : i + len(x)] == x]
    return found[-1] if found else -1


def count(m, x, a=None, b=None):
    s, e = adjust(len(m), a, b)
    if a is not None and a > len(m):
        return 0
    return max(0, e - s + 1) if not x else len(hits(m, x, a, b))


def joined(parts):
    """The text of morae that stay the same when it is split again, or None."""
    text = "".join(parts)
    return text if morae(text) == list(parts) else None


def replace(m, old, new, limit=-1):
    if new and new[0][0] in SMALL_OF:
        return None
    if not old:
        out = []
        for i, x in enumerate(m):
            out += (new if limit < 0 or i < limit else []) + [x]
        return joined(out + (new if limit < 0 or len(m) < limit else []))
    out, i, n = [], 0, 0
    while i < len(m):
        if m[i : i + len(old)] == old and (limit < 0 or n < limit):
            out += new
            i, n = i + len(old), n + 1
        else:
            out.append(m[i])
            i += 1
    return joined(out)


def vowel_to_choon(text, maxrep=1, ou=False, ei=False, nn=True):
    out, i = "", 0
    same = {c: v for v, s in zip("AIUEO", ("アァ", "イィ", "ウゥ", "エェ", "オォ")) for c in s}
    while i < len(text):
        c = text[i]
        out += c
        i += 1
        v = VOWEL_OF.get(c)
        if not v or not maxrep:
            continue
        if i < len(text) and (ou and v == "O" and text[i] in "ウゥ" or ei and v == "E" and text[i] in "イィ"):
            out += "ー"
            i += 1
            continue
        n = 0
        while i < len(text) and (maxrep < 0 or n < maxrep) and (same.get(text[i]) == v and v != "N" or v == "N" and nn and text[i] == "ン"):
            out += "ー"
            i, n = i + 1, n + 1
    return out


def choon_to_vowel(text):
    out = ""
    source = ""
    for c in text:
        if c == "ー" and VOWEL_OF.get(source):
            out += VOWELS[VOWEL_OF[source]]
        else:
            out += c
            source = c if c != "ー" else ""
    return out


assert split_morae("シャァ") == ["シャ", "ァ"] and re
