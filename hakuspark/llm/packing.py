"""Packing by minimum bin slack.

Documents become pieces of at most the capacity; only the histogram of piece lengths (at most `capacity` counts,
whatever the corpus) reaches the driver. There each window takes the longest remaining length and the multiset of
other remaining lengths that comes closest to the capacity, found by subset-sum over a bitset and backtracked into
counts; the same pattern is used as often as the counts allow. Windows that can't be filled exactly go, pattern by
pattern, into one stream that is cut at every multiple of the capacity, and whose last part is cut at powers of
two, so that nothing is padded. A piece finds its place by its rank among pieces of its length: arithmetic, no
further exchange. Ranks are counted within (length, hash bucket), so a length that a third of all pieces have is
spread over buckets.

Defined cases: a null or empty text is one end token; a document longer than the capacity is cut; repeated rows
are packed each; null document ids are kept; an empty table gives no rows; other columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hakuspark.llm.common import small, small_batches, stored, table
from hakuspark.llm.tokens import WordTokenizer, vocabulary_path

CAPACITY = 2048
END_ID = 1
TOKENIZER = "word_bpe_49k.json"
BUCKET_ROWS = 5_000
#: Texts of about so many bytes are encoded together, and so many pieces come out at once.
LOT_BYTES = 1_000_000
BATCH_PIECES = 8_192
_RANKS = np.int64(1) << 44


def _lots(texts: pa.Array) -> Iterator[tuple[int, int]]:
    """Runs of texts of about LOT_BYTES together."""
    sizes = pc.fill_null(pc.binary_length(texts), 0).to_numpy(zero_copy_only=False).astype(np.int64)
    lot = (np.cumsum(sizes) - sizes) // LOT_BYTES
    edges = np.concatenate(([0], np.flatnonzero(np.diff(lot)) + 1, [len(texts)]))
    return zip(edges[:-1].tolist(), edges[1:].tolist())


def cut_documents(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, key: str = "doc_id", text: str = "text") -> DataFrame:
    """One row per piece: _key, start, length, doc_tokens, ids_crc32, ids (little-endian unsigned 32-bit)."""
    names = ["_key", "start", "length", "doc_tokens", "ids_crc32", "ids"]

    def lot(tokenizer: WordTokenizer, keys: pa.Array, texts: pa.Array) -> Iterator[pa.RecordBatch]:
        ids, ends = tokenizer.encode_all(texts)
        ends = ends + np.arange(1, len(ends) + 1)  # each text takes the end token
        tokens = np.diff(ends, prepend=0)
        flat = np.full(int(ends[-1]), end_id, "<u4")
        inner = np.ones(len(flat), np.bool_)
        inner[ends - 1] = False
        flat[inner] = ids
        each = -(-tokens // capacity)
        owner = np.repeat(np.arange(len(ends)), each)
        start = capacity * (np.arange(len(owner)) - np.repeat(np.cumsum(each) - each, each))
        length = np.minimum(capacity, tokens[owner] - start)
        # The pieces follow one another in flat, so that it is their column.
        offsets, data = np.concatenate(([0], 4 * np.cumsum(length))), memoryview(flat).cast("B")
        for first in range(0, len(owner), BATCH_PIECES):
            some = slice(first, first + BATCH_PIECES)
            at = offsets[first : first + BATCH_PIECES + 1]
            held = data[at[0] : at[-1]]
            crc = np.fromiter((zlib.crc32(data[a:b]) for a, b in zip(at[:-1].tolist(), at[1:].tolist())), np.int64, len(at) - 1)
            column = pa.Array.from_buffers(pa.binary(), len(crc), [None, pa.py_buffer((at - at[0]).astype(np.int32)), pa.py_buffer(held)])
            yield pa.RecordBatch.from_arrays([keys.take(pa.array(owner[some])), *map(pa.array, (start[some], length[some], tokens[owner[some]], crc)), column], names)

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        tokenizer = WordTokenizer.held(path)
        for batch in batches:
            for a, b in _lots(batch.column("_text")) if len(batch) else ():
                yield from lot(tokenizer, batch.column("_key")[a:b], batch.column("_text")[a:b])
        # The worker goes on to other tasks, and stages, that need the memory.
        tokenizer.memo.forget()
        pa.default_memory_pool().release_unused()

    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text"))
    return source.mapInArrow(cut, "_key long, start long, length long, doc_tokens long, ids_crc32 long, ids binary")


def _nullable(f):
    """f with _key as an object column on both sides, so that a null id stays null."""

    def run(batches):
        for out in f(b.assign(_key=b["_key"].astype("Int64")) for b in batches):
            yield out.assign(_key=out["_key"].astype("Int64"))

    return run


def fill_window(counts: dict[int, int], capacity: int) -> dict[int, int]:
    """The longest length and the multiset of others that leaves the least slack, as counts by length."""
    seed = max(counts)
    room = capacity - seed
    within, reach, steps = (1 << (room + 1)) - 1, 1, []
    for length in sorted((n for n in counts if n <= room), reverse=True):
        if reach >> room & 1:
            break
        left, chunk = min(counts[length] - (length == seed), room // length), 1
        while left > 0:
            chunk = min(chunk, left)
            steps.append((length, chunk, reach))
            reach |= reach << (length * chunk) & within
            left, chunk = left - chunk, 2 * chunk
    total, used = reach.bit_length() - 1, {seed: 1}
    for length, chunk, before in reversed(steps):
        if not before >> total & 1:
            total -= length * chunk
            used[length] = used.get(length, 0) + chunk
    return used


@dataclass
class Plan:
    """Where the pieces of each length go, by rank. Its size depends on the capacity, not on the corpus."""

    capacity: int
    keys: np.ndarray  # length * 2**44 + first rank, ascending
    first: np.ndarray  # first rank
    each: np.ndarray  # pieces of that length in a window
    sequence: np.ndarray  # sequence of the first window
    offset: np.ndarray  # of the first such piece in its window
    stream_from: np.ndarray  # by length: the first rank that is in the stream
    stream_at: np.ndarray  # by length: its place in the stream
    stream_sequence: int
    stream_tokens: int

    def streamed(self) -> list[int]:
        """Lengths that have pieces in the stream."""
        return [n for n, at in enumerate(self.stream_at) if at >= 0]


def plan_windows(histogram: dict[int, int], capacity: int = CAPACITY) -> Plan:
    counts = {n: c for n, c in histogram.items() if c}
    placed, entries, streamed, sequence = dict.fromkeys(counts, 0), [], dict.fromkeys(counts, 0), 0
    while counts:
        used = fill_window(counts, capacity)
        times = min(counts[n] // k for n, k in used.items())
        if exact := sum(n * k for n, k in used.items()) == capacity:
            offset = 0
            for n, k in used.items():
                entries.append((n, placed[n], k, sequence, offset))
                placed[n] += k * times
                offset += n * k
            sequence += times
        for n, k in used.items():
            streamed[n] += 0 if exact else k * times
            counts[n] -= k * times
            if not counts[n]:
                del counts[n]
    entries.sort()
    stream_from, stream_at, at = np.zeros(capacity + 1, np.int64), np.full(capacity + 1, -1, np.int64), 0
    for n, c in sorted(streamed.items(), reverse=True):
        stream_from[n] = placed[n]
        if c:
            stream_at[n] = at
            at += n * c
    columns = np.array(entries, np.int64).reshape(-1, 5).T
    return Plan(capacity, columns[0] * _RANKS + columns[1], *columns[1:], stream_from, stream_at, sequence, at)


def stream_cuts(tokens: int, capacity: int) -> np.ndarray:
    """Lengths of the stream's last sequences: the powers of two that add up to what full ones leave."""
    rest = tokens % capacity
    return np.array([1 << i for i in reversed(range(rest.bit_length())) if rest >> i & 1], np.int64)


def _place(plan: Plan, with_ids: bool):
    """Pieces with their rank to pieces with sequence_id and offset; the stream's are cut at its windows."""
    body = plan.stream_tokens // plan.capacity
    edges = body * plan.capacity + np.concatenate(([0], np.cumsum(stream_cuts(plan.stream_tokens, plan.capacity))))

    def window(at: int) -> tuple[int, int, int]:
        """Number, start and end of the window of the stream that holds a token."""
        if at < body * plan.capacity:
            i = at // plan.capacity
            return i, i * plan.capacity, (i + 1) * plan.capacity
        i = int(np.searchsorted(edges, at, "right"))
        return body + i - 1, int(edges[i - 1]), int(edges[i])

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            length, rank = batch["length"].to_numpy(np.int64), batch["_rank"].to_numpy(np.int64)
            whole = rank < plan.stream_from[length]
            exact = batch[whole].drop(columns="_rank")
            if len(exact):
                n, r = length[whole], rank[whole]
                e = np.searchsorted(plan.keys, n * _RANKS + r, "right") - 1
                times, slot = np.divmod(r - plan.first[e], plan.each[e])
                yield exact.assign(sequence_id=plan.sequence[e] + times, offset=plan.offset[e] + slot * n)
            cut = batch[~whole]
            if not len(cut):
                continue
            rows, places = [], plan.stream_at[length[~whole]] + (rank[~whole] - plan.stream_from[length[~whole]]) * length[~whole]
            for at, row in zip(places.tolist(), cut.rename(columns={"_key": "key"}).itertuples(index=False)):
                ids, done = row.ids, 0
                while done < row.length:
                    i, start, end = window(at + done)
                    n = min(row.length - done, end - at - done)
                    part = ids[4 * done : 4 * (done + n)]
                    rows.append((row.key, row.start + done, n, row.doc_tokens, zlib.crc32(part), part, plan.stream_sequence + i, at + done - start))
                    done += n
            yield pd.DataFrame(rows, columns=["_key", "start", "length", "doc_tokens", "ids_crc32", "ids", "sequence_id", "offset"])

    def run(batches):
        for out in _nullable(place)(batches):
            yield out if with_ids else out.drop(columns="ids")

    return run


def pack(docs: DataFrame, path: str, capacity: int = CAPACITY, end_id: int = END_ID, with_ids: bool = False, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, start, length, ids_crc32, doc_tokens, sequence_id and offset for every piece, and its ids if asked."""
    small_batches(docs.sparkSession)
    pieces = stored(cut_documents(docs, path, capacity, end_id, key, text), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count("*").alias("n")).collect()}
    plan = plan_windows(histogram, capacity)
    buckets = max(16, sum(histogram.values()) // BUCKET_ROWS)
    rows = pieces.withColumn("_bucket", F.pmod(F.xxhash64("_key", "start", "ids_crc32"), F.lit(buckets)))
    sizes = rows.groupBy("length", "_bucket").agg(F.count("*").alias("_n"))
    before = sizes.select("length", "_bucket", (F.sum("_n").over(Window.partitionBy("length").orderBy("_bucket")) - F.col("_n")).alias("_before"))
    streamed = plan.streamed()
    carried = F.col("ids") if with_ids else F.when(F.col("length").isin(streamed), F.col("ids")) if streamed else F.lit(None).cast("binary")
    ranked = rows.withColumn("ids", carried).withColumn("_in", F.row_number().over(Window.partitionBy("length", "_bucket").orderBy("_key", "start", "ids_crc32", "doc_tokens")))
    ranked = ranked.join(small(before, min(buckets * len(histogram), sum(histogram.values()))), ["length", "_bucket"])
    ranked = ranked.select("_key", "start", "length", "doc_tokens", "ids_crc32", "ids", (F.col("_before") + F.col("_in") - 1).alias("_rank"))
    schema = "_key long, start long, length long, doc_tokens long, ids_crc32 long, " + "ids binary, " * with_ids + "sequence_id long, offset long"
    placed = ranked.mapInPandas(_place(plan, with_ids), schema)
    return placed.select(F.col("_key").alias(key), "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset", *["ids"] * with_ids)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents").select("doc_id", "text"), vocabulary_path(TOKENIZER))


QUERIES = {"op4_packing": op4_packing}
ORACLES: dict[str, str] = {}
