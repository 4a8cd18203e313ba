"""SentencePiece encoding and decoding.

An Aho-Corasick automaton over the pieces reads the text once; at each position the output links give every piece
that ends there, and each relaxes the best score of that position (Viterbi). The segmentation is the one of highest
total score, the earliest start winning ties: the unigram objective over the model's pieces and scores. A character
that no piece covers falls back to its bytes.

The text is cut where no piece can reach across (before blanks, if no piece has a blank after another character,
and around control characters that no longer piece holds), so that each distinct part is encoded once. Decoding is
exact, except that U+2581 stands for a blank in the model and so comes back as one. Texts are not normalized, but for
the blank put before each: models whose own rules fold characters give other pieces here.

Defined cases: a null text has null results; an empty text has no ids; segmentations of equal score go to the earliest
start; repeated rows are each encoded; an empty table has no rows; other columns are ignored. Texts are encoded whole;
the places of a part of more than LONG characters (without any blank) are kept in compact arrays.
"""

from __future__ import annotations

import re
from array import array
from collections import deque
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import small_batches, table
from hakuspark.llm.packing import _nullable
from hakuspark.llm.tokens import Memo, flattened, lengths, vocabulary_path

MODEL = "piece_bpe_32k.model"
BLANK = "▁"
UNKNOWN_PENALTY = 10.0
LONG = 100_000


class Automaton:
    """Aho-Corasick: child tables, failure links, and for each state the pieces that end there by output links."""

    def __init__(self, pieces: dict[str, int]):
        self.child: list[dict[str, int]] = [{}]
        self.piece = [-1]
        self.depth = [0]
        for text, i in pieces.items():
            state = 0
            for c in text:
                if c not in self.child[state]:
                    self.child[state][c] = len(self.child)
                    self.child.append({})
                    self.piece.append(-1)
                    self.depth.append(self.depth[state] + 1)
                state = self.child[state][c]
            self.piece[state] = i
        self.fail = [0] * len(self.child)
        self.output = [0] * len(self.child)  # the longest proper suffix that is a piece; 0: none
        waiting = deque(self.child[0].values())
        while waiting:
            state = waiting.popleft()
            for c, below in self.child[state].items():
                waiting.append(below)
                back = self.fail[state]
                while back and c not in self.child[back]:
                    back = self.fail[back]
                self.fail[below] = self.child[back].get(c, 0)
            back = self.fail[state]
            self.output[state] = back if self.piece[back] >= 0 else self.output[back]


class PieceModel:
    _held: dict[str, PieceModel] = {}

    def __init__(self, path: str):
        import sentencepiece

        model = sentencepiece.SentencePieceProcessor(model_file=path)
        size = range(model.vocab_size())
        usable = {model.id_to_piece(i): i for i in size if not (model.is_control(i) or model.is_unknown(i) or model.is_byte(i))}
        self.scores = [model.get_score(i) for i in size]
        self.unknown = min((self.scores[i] for i in usable.values()), default=0.0) - UNKNOWN_PENALTY
        self.unknown_id = model.unk_id()
        self.bytes_at = {int(model.id_to_piece(i)[1:-1], 16): i for i in size if model.is_byte(i)}
        self.spelled = [b"" if model.is_control(i) else model.id_to_piece(i).replace(BLANK, " ").encode() for i in size]
        for value, i in self.bytes_at.items():
            self.spelled[i] = bytes([value])
        self.automaton = Automaton(usable)
        inside = {c for p in usable if len(p) > 1 for c in p}
        alone = "".join(re.escape(chr(i)) for i in range(32) if chr(i) not in inside)
        across = any(BLANK in p.lstrip(BLANK) for p in usable)
        self.parts = re.compile(rf"[{alone}]|[^{alone}]+" if across else rf"[{alone}]|{BLANK}+[^{BLANK}{alone}]*|[^{BLANK}{alone}]+")
        self.memo = Memo(self._encode)

    @classmethod
    def held(cls, path: str) -> PieceModel:
        """One for each Python worker."""
        if path not in cls._held:
            cls._held[path] = cls(path)
        return cls._held[path]

    def segment(self, text: str) -> list[int]:
        """Ids of the best segmentation of a text whose blanks are already written as U+2581."""
        a, scores, n = self.automaton, self.scores, len(text)
        row = (lambda code, value: [value] * (n + 1)) if n <= LONG else (lambda code, value: array(code, [value]) * (n + 1))
        best, start, chosen = row("d", -np.inf), row("q", 0), row("i", -1)
        best[0] = 0.0
        state = 0
        for at, c in enumerate(text, 1):
            while state and c not in a.child[state]:
                state = a.fail[state]
            state = a.child[state].get(c, 0)
            ends = state if a.piece[state] >= 0 else a.output[state]
            single = False
            while ends:  # longest first
                length, i = a.depth[ends], a.piece[ends]
                score = best[at - length] + scores[i]
                if score > best[at]:
                    best[at], start[at], chosen[at] = score, at - length, i
                single = length == 1
                ends = a.output[ends]
            if not single and best[at - 1] + self.unknown > best[at]:
                best[at], start[at], chosen[at] = best[at - 1] + self.unknown, at - 1, -1
        ids: list[int] = []
        at = n
        while at:
            if chosen[at] >= 0:
                ids.append(chosen[at])
            elif self.bytes_at:
                ids.extend(self.bytes_at[b] for b in reversed(text[start[at] : at].encode("utf-8", "replace")))
            else:
                ids.append(self.unknown_id)
            at = start[at]
        return ids[::-1]

    def _encode(self, parts: list[str]) -> tuple[list[str], np.ndarray, np.ndarray]:
        found = list(map(self.segment, parts))
        return parts, flattened(found), lengths(found)

    def encode(self, text: str) -> np.ndarray:
        return self.memo.ids(self.parts.findall(BLANK + text.replace(" ", BLANK))) if text else np.zeros(0, np.uint32)

    def decode(self, ids: np.ndarray | list[int]) -> str:
        return b"".join(map(self.spelled.__getitem__, np.asarray(ids, np.int64).tolist())).decode("utf-8", "replace").removeprefix(" ")


def encode(docs: DataFrame, path: str, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, ids, n_tokens, and round_trip: whether decoding the ids gives the text again."""
    small_batches(docs.sparkSession)

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PieceModel.held(path)
        for batch in batches:
            for at in range(0, len(batch), 1000):
                part = batch.iloc[at : at + 1000]
                ids = [model.encode(t).astype(np.int32) if isinstance(t, str) else None for t in part["_text"]]
                same = [None if x is None else model.decode(x) == t for x, t in zip(ids, part["_text"])]
                yield pd.DataFrame({"_key": part["_key"].to_numpy(object), "ids": ids, "n_tokens": pd.array([None if x is None else len(x) for x in ids], "Int64"), "round_trip": same})

    rows = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInPandas(_nullable(run), "_key long, ids array<int>, n_tokens long, round_trip boolean")
    return rows.withColumnRenamed("_key", key)


def decode(encoded: DataFrame, path: str, key: str = "doc_id", ids: str = "ids") -> DataFrame:
    """Return key and text for rows of ids; null for null."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        model = PieceModel.held(path)
        for batch in batches:
            yield pd.DataFrame({"_key": batch["_key"], "text": [None if x is None else model.decode(x) for x in batch["_ids"]]})

    rows = encoded.select(F.col(key).cast("long").alias("_key"), F.col(ids).alias("_ids")).mapInPandas(_nullable(run), "_key long, text string")
    return rows.withColumnRenamed("_key", key)


def op3_sentencepiece(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode(table(spark, sf_dir, "documents"), vocabulary_path(MODEL))


QUERIES = {"op3_sentencepiece": op3_sentencepiece}
ORACLES: dict[str, str] = {}
