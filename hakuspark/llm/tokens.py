"""Whole texts to token ids, with a bounded memo of parts that can be encoded on their own."""

from __future__ import annotations

import os
import re
from collections.abc import Callable, Hashable
from itertools import chain, compress

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

MEMO_PARTS = 300_000
MEMO_SIZE = 12_000_000


def vocabulary_path(name: str) -> str:
    """The place of a public vocabulary file; it is never copied."""
    import public_tokenizers

    return public_tokenizers.path(name)


class Memo:
    """Ids of parts of texts. It is emptied when it holds too many parts, or too many bytes and ids together."""

    def __init__(self, encode: Callable[[list], tuple[list, np.ndarray, np.ndarray]]):
        """encode takes parts, and returns them in any order, their ids one after another, and how many each has."""
        self.encode = encode
        self.forget()

    def forget(self) -> None:
        self.at: dict[Hashable, int] = {}
        self.starts = np.zeros(1 << 12, np.int64)
        self.sizes = np.zeros(1 << 12, np.int64)
        self.flat = np.zeros(1 << 14, np.uint32)
        self.used = self.size = 0

    def _learn(self, parts: list) -> None:
        parts, found, sizes = self.encode(parts)
        n, more = len(self.at), len(found)
        while n + len(parts) > len(self.starts):
            self.starts, self.sizes = np.resize(self.starts, 2 * len(self.starts)), np.resize(self.sizes, 2 * len(self.sizes))
        while self.used + more > len(self.flat):
            self.flat = np.resize(self.flat, 2 * len(self.flat))
        self.flat[self.used : self.used + more] = found
        self.starts[n : n + len(parts)] = self.used + np.cumsum(sizes) - sizes
        self.sizes[n : n + len(parts)] = sizes
        self.used += more
        self.size += sum(map(len, parts)) + more
        self.at.update(zip(parts, range(n, n + len(parts))))

    def places(self, parts: list) -> np.ndarray:
        """Where the ids of each part are; they hold until the next call."""
        if len(self.at) > MEMO_PARTS or self.size > MEMO_SIZE:
            self.forget()
        if new := set(parts).difference(self.at):
            self._learn(list(new))
        return np.fromiter(map(self.at.__getitem__, parts), np.int64, len(parts))

    def take(self, which: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The ids of the parts at these places, one after another, and where those of each part end."""
        return taken(self.flat, self.starts[which], self.sizes[which])

    def ids(self, parts: list) -> np.ndarray:
        """The ids of all parts, one after another."""
        return self.take(self.places(parts))[0]


def lengths(rows: list[list[int]]) -> np.ndarray:
    return np.fromiter(map(len, rows), np.int64, len(rows))


def flattened(rows: list[list[int]]) -> np.ndarray:
    return np.fromiter(chain.from_iterable(rows), np.uint32, sum(map(len, rows)))


def taken(flat: np.ndarray, starts: np.ndarray, sizes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The runs of so many values from these starts on, one after another, and their ends."""
    ends = np.cumsum(sizes)
    total = int(ends[-1]) if len(ends) else 0
    return flat[np.repeat(starts - ends + sizes, sizes) + np.arange(total)], ends


_held: dict[str, WordTokenizer] = {}


def _byte_letters() -> dict[int, str]:
    """The printable character that a byte-level vocabulary writes for each byte."""
    plain = {*range(33, 127), *range(161, 173), *range(174, 256)}
    others = iter(range(256, 512))
    return {b: chr(b if b in plain else next(others)) for b in range(256)}


class WordTokenizer:
    """The tokenizer of a file that composes, lower-cases, drops white space and splits letters from signs.

    What stands between ASCII white space is therefore independent, and so are ASCII signs (but the apostrophe) after
    small Latin letters; each distinct part is encoded once. Parts of such letters only are one word for the model,
    and skip the steps before it. Texts are split, and their distinct words found, as Arrow arrays.
    """

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer, pre_tokenizers

        self.tokenizer = Tokenizer.from_file(path)
        self.speller = Tokenizer(self.tokenizer.model)
        self.speller.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
        self.ends = np.zeros(self.tokenizer.get_vocab_size(), np.bool_)
        self.ends[[i for t, i in self.tokenizer.get_vocab(with_added_tokens=False).items() if t.endswith("</w>")]] = True
        self.letters = _byte_letters() | {32: " "}
        small = "".join(c for c in map(chr, range(0x180)) if c.isalpha() and c == c.lower())
        self.word = re.compile(f"[{small}]+").fullmatch
        self.signed = f"^(?P<word>[{small}]+)(?P<signs>[!-&(-/:-@\\[-`{{-~]+)$"
        self.memo = Memo(self._encode)

    def _encode(self, parts: list[bytes]) -> tuple[list[bytes], np.ndarray, np.ndarray]:
        texts = [p.decode("utf-8", "replace") for p in parts]
        easy = list(map(bool, map(self.word, texts)))
        words, hard = list(compress(parts, easy)), [i for i, word in enumerate(easy) if not word]
        # All words are one text, in which every word's last id is one that ends words.
        line = b" ".join(words).decode("latin-1").translate(self.letters)
        ids = np.array(self.speller.encode_batch_fast([line], add_special_tokens=False)[0].ids, np.uint32)
        sizes = np.diff(np.flatnonzero(self.ends[ids]), prepend=-1)
        rest = [e.ids for e in self.tokenizer.encode_batch_fast([texts[i] for i in hard], add_special_tokens=False)]
        ordered = words + [parts[i] for i in hard]
        return ordered, np.concatenate((ids, flattened(rest))), np.concatenate((sizes, lengths(rest)))

    @staticmethod
    def held(path: str) -> WordTokenizer:
        """One for each Python worker."""
        if path not in _held:
            _held[path] = WordTokenizer(path)
        return _held[path]

    def encode_all(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """The ids of all texts, one after another, and where those of each text end; a null text is an empty one."""
        texts = texts.fill_null("")
        # Lower case first, unless a combining mark follows (U+0300 to U+037F) or a special token is spelled out.
        words = pc.ascii_split_whitespace(pc.if_else(pc.match_substring_regex(texts, _ODD), texts, pc.ascii_lower(texts)))
        coded = words.flatten().dictionary_encode()
        distinct, at = coded.dictionary, coded.indices.to_numpy()
        both = pc.extract_regex(distinct, self.signed)
        parts = (pc.coalesce(pc.struct_field(both, "word"), distinct), pc.coalesce(pc.struct_field(both, "signs"), pa.scalar("", distinct.type)))
        tails = parts[1].dictionary_encode()
        # Both kinds of parts are looked up at once, as the memo may forget between calls.
        places = self.memo.places([*parts[0].cast(pa.large_binary()).to_pylist(), *tails.dictionary.cast(pa.large_binary()).to_pylist()])
        which = np.stack((places[: len(distinct)], places[len(distinct) :][tails.indices.to_numpy()]), 1)
        flat, ends = self.memo.take(which.ravel())
        ends = ends[1::2]
        sizes = np.diff(ends, prepend=0)
        ids, stops = taken(flat, (ends - sizes)[at], sizes[at])
        return ids, np.concatenate(([0], stops))[words.offsets.to_numpy()[1:] - words.offsets[0].as_py()]

    def encode(self, text: str) -> np.ndarray:
        return self.encode_all(pa.array([text.encode("utf-8", "replace").decode()]))[0]


_ODD = r"[\x{300}-\x{37f}]|<\|"
