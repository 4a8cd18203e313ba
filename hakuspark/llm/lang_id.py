"""Language identification with bit-sliced Bloom filters of n-grams.

Slot i of the filter is a mask with one bit a language, so that one probe (the AND of the slots of an n-gram)
returns all languages that contain the n-gram. A document's popcounts by language, corrected for the false
positives to be expected at each language's fill, decide.

Learning: a bounded sample of labelled texts, about SAMPLE_DOCS a language, drawn by a hash of the text from all of
them; copies count once, except that all n-grams of a text with copies are seen twice.
A language keeps the n-grams (four characters of lower-cased letters, blanks between words) that are among its
GRAMS most frequent, seen at least twice, and not SHARE times as frequent in another language.

Defined cases: a text that is null or has no letter is ``und`` with score 0; a text of unknown n-grams gets the
first language by name with score 0; without any labelled row all are ``und``; ties go to the first name;
an empty table has no rows; repeated rows are each judged; other columns of the input are ignored. Texts are read
whole; long ones in slices of SLICE characters, with the same n-grams as at once.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import masked, small_batches, table

N = 4
SAMPLE_DOCS = 1_500
GRAMS = 12_000
SHARE = 4.0
SLOT_BITS = 18
PROBES = 3
#: Languages in one mask; more take further masks for each slot.
WORD = 64
SLICE = 200_000
LOT_ROWS = 500

_cache: dict[str, np.ndarray] = {}


def _letters() -> np.ndarray:
    if "letters" not in _cache:
        _cache["letters"] = np.fromiter((chr(i).isalpha() for i in range(0x110000)), np.bool_, 0x110000)
    return _cache["letters"]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(31))) * np.uint64(0xBF58476D1CE4E5B9)
    return h ^ (h >> np.uint64(29))


def _gram_hashes(texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
    """64-bit hashes of the n-grams of all texts, and how many each text has.

    A text without any letter has none.
    """
    codes = np.frombuffer(" ".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32)
    lengths = np.fromiter(map(len, texts), np.int64, len(texts))
    starts = np.cumsum(lengths + 1) - lengths - 1
    owner = np.repeat(np.arange(len(texts)), lengths + 1)[: len(codes)]
    letter = _letters()[codes]
    # Of a run of other characters only the first stays, as a blank; a text's first and last blank stay as word ends.
    kept = letter | np.concatenate(([True], letter[:-1]))
    kept[starts[starts < len(kept)]] = True
    small = np.where(letter, codes, 32)[kept].astype(np.uint64)
    owner = owner[kept]
    padded = np.concatenate((np.full(1, 32, np.uint64), small, np.full(1, 32, np.uint64)))
    owned = np.concatenate((owner[:1], owner, owner[-1:]))
    if len(padded) < N:
        return np.zeros(0, np.uint64), np.zeros(len(texts), np.int64)
    h = np.zeros(len(padded) - N + 1, np.uint64)
    word = np.zeros(len(h), np.bool_)
    for i in range(N):
        part = padded[i : i + len(h)]
        h = h * np.uint64(0x9E3779B97F4A7C15) + part
        word |= part != 32
    # An n-gram belongs to one text: from its second character on it may only meet that text's closing blank.
    word &= owned[1 : 1 + len(h)] == owned[N - 2 : N - 2 + len(h)]
    return _mixed(h[word]), np.bincount(owned[1 : 1 + len(h)][word], minlength=len(texts))


def _long_hashes(text: str) -> Iterator[np.ndarray]:
    """What _gram_hashes gives for one text, by slices: each goes on from the last characters of the one before."""
    tail, after_letter = np.full(1, 32, np.uint64), True
    for at in range(0, len(text), SLICE):
        codes = np.frombuffer(text[at : at + SLICE].encode("utf-32-le", "surrogatepass"), np.uint32)
        letter = _letters()[codes]
        kept = letter | np.concatenate(([after_letter], letter[:-1]))
        after_letter = bool(letter[-1])
        end = [np.full(1, 32, np.uint64)] * (at + SLICE >= len(text))
        stream = np.concatenate((tail, np.where(letter, codes, 32)[kept].astype(np.uint64), *end))
        h, word = np.zeros(max(0, len(stream) - N + 1), np.uint64), np.zeros(max(0, len(stream) - N + 1), np.bool_)
        for i in range(N):
            part = stream[i : i + len(h)]
            h = h * np.uint64(0x9E3779B97F4A7C15) + part
            word |= part != 32
        yield _mixed(h[word])
        tail = stream[-(N - 1) :]


def _lots(texts: list[str]) -> Iterator[tuple[np.ndarray, np.ndarray, list[int]]]:
    """Bounded lots of n-gram hashes, how many each text has there, and the texts' indices."""
    parts, owners, size = [], [], 0
    for i, text in enumerate(texts):
        if len(text) > SLICE:
            for hashes in _long_hashes(text):
                yield hashes, np.array([len(hashes)]), [i]
            continue
        parts.append(text)
        owners.append(i)
        size += len(text)
        if size >= SLICE:
            yield *_gram_hashes(parts), owners
            parts, owners, size = [], [], 0
    if parts:
        yield *_gram_hashes(parts), owners


class LanguageModel:
    """Bit-sliced Bloom filter: slot arrays with a bit for each language, WORD languages in each."""

    def __init__(self, grams: dict[str, np.ndarray], slot_bits: int = SLOT_BITS, probes: int = PROBES):
        self.languages = sorted(grams)
        self.probes, self.slot_bits = probes, slot_bits
        kind = next(t for t in (np.uint8, np.uint16, np.uint32, np.uint64) if np.iinfo(t).bits >= min(len(self.languages), WORD))
        self.words = [np.zeros(1 << slot_bits, kind) for _ in range(0, max(1, len(self.languages)), WORD)]
        for i, language in enumerate(self.languages):
            for at in self._places(grams[language]):
                self.words[i // WORD][at] |= kind(1 << i % WORD)
        fill = [float(np.mean((self.words[i // WORD] >> kind(i % WORD)) & kind(1))) for i in range(len(self.languages))]
        self.false_rate = np.array([f**probes for f in fill])

    def _places(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(self.probes):
            yield (hashes >> np.uint64(20 * k)) & np.uint64((1 << self.slot_bits) - 1)

    def containing(self, hashes: np.ndarray, word: int = 0) -> np.ndarray:
        """The mask of languages (of the word-th WORD of them) that contain each n-gram."""
        masks = None
        for at in self._places(hashes):
            masks = self.words[word][at] if masks is None else masks & self.words[word][at]
        return masks

    def predict(self, texts: list[str | None]) -> tuple[list[str], np.ndarray]:
        counts = np.zeros((len(texts), len(self.languages)))
        total = np.zeros(len(texts))
        lettered = np.zeros(len(texts), np.bool_)
        for hashes, each, owners in _lots([(t or "").lower() for t in texts]):
            ends = np.concatenate(([0], np.cumsum(each)))
            for i in range(len(self.languages)):
                masks = masks if i % WORD else self.containing(hashes, i // WORD)
                hits = np.concatenate(([0], np.cumsum((masks >> masks.dtype.type(i % WORD)) & masks.dtype.type(1), dtype=np.int64)))
                np.add.at(counts[:, i], owners, hits[ends[1:]] - hits[ends[:-1]])
            np.add.at(total, owners, each)
        for i, t in enumerate(texts):
            lettered[i] = total[i] > 0 or any(map(str.isalpha, t or ""))
        if not self.languages:
            return ["und"] * len(texts), np.zeros(len(texts))
        right = np.clip((counts - total[:, None] * self.false_rate) / (1 - np.minimum(self.false_rate, 0.999)), 0, None)
        best = right.argmax(1)
        score = np.clip(np.divide(right[np.arange(len(texts)), best], total, out=np.zeros(len(texts)), where=total > 0), 0, 1)
        return [self.languages[b] if ok else "und" for b, ok in zip(best, lettered)], np.where(lettered, score, 0.0)


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", sample_docs: int = SAMPLE_DOCS, grams: int = GRAMS) -> LanguageModel:
    """Learn from rows with text and lang; reads a sample of about sample_docs distinct texts a language."""
    rows = labelled.select(F.col(text).alias("t"), F.col(lang).alias("l"), F.xxhash64(text).alias("h")).where("t is not null and l is not null")
    small_batches(labelled.sparkSession)
    sizes = {r["l"]: r["n"] for r in rows.groupBy("l", "h").agg(F.lit(1)).groupBy("l").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return LanguageModel({})
    share = F.create_map(*(F.lit(x) for k, n in sizes.items() for x in (k, min(1.0, sample_docs / n))))
    drawn = rows.where(F.pmod("h", F.lit(1_000_003)) < share[F.col("l")] * 1_000_003).groupBy("l", "h").agg(F.min("t").alias("t"), F.least(F.count("*"), F.lit(2)).alias("c")).drop("h")

    def count(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for (language, copies), texts in batch.groupby(["l", "c"])["t"]:
                for found, _, _ in _lots([t.lower() for t in texts]):
                    hashes, n = np.unique(found, return_counts=True)
                    yield pd.DataFrame({"l": language, "g": hashes.view(np.int64), "n": n, "seen": n * copies})

    counted = drawn.mapInPandas(count, "l string, g long, n long, seen long").groupBy("l", "g").agg(F.sum("n").alias("n"), F.sum("seen").alias("seen")).where("seen >= 2")
    from pyspark.sql import Window

    ranked = counted.withColumn("_at", F.row_number().over(Window.partitionBy("l").orderBy(F.desc("n"), "g"))).where(F.col("_at") <= 2 * grams)
    top = ranked.select("l", "g", "n").toPandas()  # at most 2 * grams rows a language
    rate = top["n"] / top.groupby("l")["n"].transform("sum")
    most = rate.groupby(top["g"]).transform("max")
    top = top[rate * SHARE >= most].sort_values(["n", "g"], ascending=[False, True], kind="stable")
    return LanguageModel({k: top[top["l"] == k]["g"].to_numpy()[:grams].view(np.uint64) if (top["l"] == k).any() else np.zeros(0, np.uint64) for k in sizes})


def predict(docs: DataFrame, model: LanguageModel, text: str = "text", keep: list[str] | None = None) -> DataFrame:
    """docs' columns in keep (default: all), then lang_pred and score, which replace columns of those names."""
    kept = docs.select(*(F.col(f"`{c}`") for c in (docs.columns if keep is None else keep) if c not in ("lang_pred", "score")))
    inner = masked(kept)
    small_batches(docs.sparkSession)
    shared = docs.sparkSession.sparkContext.broadcast(model)
    from pyspark.sql.types import DoubleType, StringType, StructField, StructType

    def judge(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LOT_ROWS):
                lot = batch.iloc[at : at + LOT_ROWS]
                labels, scores = shared.value.predict([t if isinstance(t, str) else None for t in lot["_text"]])
                yield lot.drop(columns="_text").assign(lang_pred=labels, score=scores)

    schema = StructType([*inner.schema.fields, StructField("lang_pred", StringType()), StructField("score", DoubleType())])
    source = docs.select(*(F.col(f"`{c}`").alias(n) for c, n in zip(kept.columns, inner.columns)), F.col(f"`{text}`").alias("_text"))
    return source.mapInPandas(judge, schema).toDF(*kept.columns, "lang_pred", "score")


def held_out(doc_id: Column) -> Column:
    return F.coalesce(F.pmod(F.crc32(doc_id.cast("string").cast("binary")), F.lit(4)) == 2, F.lit(False))


def op8_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    model = fit(docs.where(~held_out(F.col("doc_id"))))
    return predict(docs.select("doc_id", held_out(F.col("doc_id")).alias("held_out"), "text"), model, keep=["doc_id", "held_out"])


QUERIES = {"op8_language_id": op8_language_id}
ORACLES: dict[str, str] = {}
