"""Exact top-k search by inner product with MaxScore.

A vector component is a term of two signs: a posting list holds the rows with a positive component, another those
with a negative one, each with its value. A query term's list of its own sign adds to the score, the other takes
away, so the other's bound is 0. Query terms are sorted by their bounds (weight times the list's largest value); the
ones whose bounds together can't reach the current k-th best score, and all lists of the other sign, are
non-essential. Essential postings are traversed; what they leave competitive, that is, with a score that the
remaining bounds can raise to the k-th best, is probed in the rest. While the k-th best is not above 0, every row is
a candidate.

Queries go in lots of BATCH that share their largest terms. A block's lists that are essential for no query of a lot
are not multiplied, nor is anything for rows that no query of it finds competitive; blocks come by their bounds, so
that the k-th best scores are high early, and a block whose bounds can't reach them costs nothing. Where that would
save nothing, all terms of a lot count as essential. How many products are skipped depends on the data: with dense
vectors in all directions none, with sparse ones most.

Rows are dealt into shards, and queries, the smaller side, are sent to every shard; a task holds one shard's lists
and streams the queries past them. The best k of all shards are merged by a second ranking. No pair of rows is ever
emitted beyond k for each query and shard.

Defined cases: a vector that is null, or holds null or non-finite components, takes no part; a component that one
of the two vectors lacks counts as 0; ties go to the smaller id; a query is never its own neighbour, that is, rows
with its id are left out; rows that repeat an id count each, as candidates and as queries, and each query row has
its own ranks; null ids take no part; a component beyond the range of a long counts as the nearest long; scores are
compared exactly whatever their size, and one beyond the range of a long is returned as the nearest long; other
columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from hakuspark.llm.common import table

K = 5
SCALE = 256
QUERY_EVERY = 50
#: A shard has at most SHARD_ROWS rows; smaller tables give up to LEAST_SHARDS shards of LEAST_ROWS.
SHARD_ROWS, LEAST_SHARDS, LEAST_ROWS = 65_536, 64, 4_096
BLOCK_ROWS = 1_024
BATCH = 8
_LONG = (1 << 63) - 1


def usable(vector: Column) -> Column:
    """Whether all components are finite numbers."""
    finite = F.forall(vector, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vector.isNotNull() & F.coalesce(finite, F.lit(False))


def quantized(vector: Column, scale: int = SCALE) -> Column:
    return F.transform(vector, lambda x: F.floor(F.lit(float(scale)) * x.cast("double")))


class Postings:
    """The posting lists of a block of rows: one row of `lists` for each dimension and sign, 0 where a row isn't in it."""

    def __init__(self, ids: np.ndarray, values: np.ndarray, kind: type):
        self.ids = ids
        self.values = values.astype(kind)
        self.lists = _signed(self.values).T
        self.most = self.lists.max(1, initial=0)


def _signed(values: np.ndarray) -> np.ndarray:
    """Positive parts, then negative ones turned positive."""
    return np.concatenate((np.maximum(values, 0), np.maximum(-values, 0)), axis=1)


def exact_kind(*matrices: np.ndarray) -> type:
    """A type in which every sum of products of the matrices' rows is exact; floating point where it is."""
    largest = [int(np.abs(m.astype(object) if m.size and m.min() == -_LONG - 1 else m).max(initial=0)) for m in matrices]
    most = largest[0] * largest[-1] * max(matrices[0].shape[1], 1)
    return np.float32 if most < 1 << 24 else np.float64 if most < 1 << 53 else np.int64 if most < 1 << 62 else object


def _lead(values: np.ndarray) -> np.ndarray:
    """An order of rows that puts those of equal largest terms side by side."""
    terms = _signed(values)
    top = np.argsort(-terms, axis=1, kind="stable")[:, :2]
    return np.lexsort((*top.T[::-1],)) if terms.shape[1] else np.arange(len(values))


@dataclass
class Tally:
    """The products of all queries with all rows, how many of them were made, and the share of rows last left for probing."""

    there: int = 0
    made: int = 0
    left: float = 0.0


def search_block(block: Postings, queries: np.ndarray, own: np.ndarray, best: list[list[tuple[int, int]]], k: int, state: Tally) -> None:
    """Bring best, the k best (-score, id) of each query in order, up to date with a block."""
    none = -np.inf if queries.dtype.kind == "f" else -(1 << 62) if queries.dtype.kind == "i" else -(1 << 200)
    floor = np.array([-b[-1][0] if len(b) == k else none for b in best], queries.dtype)[:, None]
    dims, positive = queries.shape[1], queries > 0
    bound = np.abs(queries) * np.where(positive, block.most[:dims], block.most[dims:])
    order = np.argsort(-bound, axis=1, kind="stable")
    tails = np.zeros((len(queries), dims + 1), queries.dtype)  # tails[:, i]: the bounds of the terms from the i-th on
    tails[:, :dims] = np.cumsum(np.take_along_axis(bound, order, 1)[:, ::-1], axis=1)[:, ::-1]
    count = np.where(floor[:, 0] > 0, (tails[:, :dims] >= floor).sum(1), dims).astype(np.int64)[:, None]
    essential = np.zeros(queries.shape, np.bool_)
    np.put_along_axis(essential, order, np.arange(dims)[None, :] < count, 1)
    tail = np.take_along_axis(tails, count, 1)
    rows, weights = np.arange(len(block.ids)), _signed(np.where(essential, queries, 0).astype(queries.dtype))
    used, asked = np.flatnonzero((weights != 0).any(0)), np.flatnonzero((queries != 0).any(0))
    state.there += dims * len(queries) * len(rows)
    # Lists are traversed first only if what they are likely to leave for probing makes that worth while; otherwise
    # all terms count as essential.
    if len(used) + state.left * len(asked) < len(asked):
        score = weights[:, used] @ block.lists[used]
        state.made += len(used) * len(queries) * len(rows)
        rows = np.flatnonzero(((score + tail >= floor) & ((score > 0) | (floor <= 0))).any(0))
        state.left = len(rows) / len(block.ids)
    # Probe what is still competitive in the non-essential lists, and in those of the other sign, which take away.
    score = queries[:, asked] @ (block.values[:, asked] if len(rows) == len(block.ids) else block.values[np.ix_(rows, asked)]).T
    state.made += len(asked) * len(queries) * len(rows)
    alive = (score >= floor) & (block.ids[rows][None, :] != own[:, None])
    for i in np.flatnonzero(alive.any(1)):
        hits = np.flatnonzero(alive[i])
        if len(hits) > k:
            hits = hits[score[i, hits] >= np.sort(score[i, hits])[len(hits) - k]]
        best[i] = sorted(best[i] + [(-int(x), y) for x, y in zip(score[i, hits].tolist(), block.ids[rows[hits]].tolist())])[:k]


class Shard:
    """The rows of a shard as blocks of posting lists, made in each type that queries ask for."""

    def __init__(self, ids: np.ndarray, values: np.ndarray):
        order = _lead(values)
        self.ids, self.values, self.made = ids[order], values[order], {}
        self.tally = Tally()

    def blocks(self, kind: type) -> list[Postings]:
        if kind not in self.made:
            cuts = range(0, len(self.ids), BLOCK_ROWS)
            self.made = {kind: [Postings(self.ids[at : at + BLOCK_ROWS], self.values[at : at + BLOCK_ROWS], kind) for at in cuts]}
        return self.made[kind]

    def search(self, own: np.ndarray, queries: np.ndarray, k: int) -> list[list[tuple[int, int]]]:
        """The k best (-score, id) of each query."""
        kind = exact_kind(self.values, queries)
        blocks, found = self.blocks(kind), [[] for _ in own]
        queries, order = queries.astype(kind), _lead(queries)
        for at in range(0, len(order), BATCH):
            lot = order[at : at + BATCH]
            weights, best = queries[lot], [[] for _ in lot]
            self.tally.left = 0.0
            reach = [(_signed(weights) @ block.most).sum() for block in blocks]
            for i in sorted(range(len(blocks)), key=lambda i: -reach[i]):
                search_block(blocks[i], weights, own[lot], best, k, self.tally)
            for i, b in zip(lot.tolist(), best):
                found[i] = b
        return found


def _matrix(vectors, dims: int) -> np.ndarray:
    """An integer matrix; short vectors are filled with 0, long ones cut."""
    values = np.zeros((len(vectors), dims), np.int64)
    for i, v in enumerate(vectors):
        values[i, : len(v)] = v[:dims]
    return values


def top_k(vectors: DataFrame, queries: DataFrame, k: int = K, key: str = "vec_id", vector: str = "embedding", scale: int = SCALE) -> DataFrame:
    """Return query_id, rank, vec_id and score: for each row of queries its k best rows of vectors."""

    def clean(df: DataFrame) -> DataFrame:
        rows = df.select(F.col(key).cast("long").alias("id"), quantized(F.col(vector), scale).alias("v"), F.col(vector).alias("_x"))
        return rows.where(F.col("id").isNotNull() & usable(F.col("_x"))).select("id", "v")

    base = clean(vectors)
    n = base.count()
    shards = max(-(-n // SHARD_ROWS), min(-(-n // LEAST_ROWS), LEAST_SHARDS), 1)
    # Equal queries are asked once, and their answers given as often as they stand there.
    asked = clean(queries).groupBy("id", "v").agg(F.count("*").alias("copies"))
    dealt = base.withColumn("shard", F.pmod(F.xxhash64("id", F.monotonically_increasing_id()), F.lit(shards)).cast("int"))
    sent = asked.withColumn("shard", F.explode(F.sequence(F.lit(0), F.lit(shards - 1))))
    sides = dealt.select("shard", F.lit(0).cast("long").alias("copies"), "id", "v").unionByName(sent.select("shard", "copies", "id", "v"))

    def search(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        current, held, shard = -1, [], None
        for batch in batches:
            asks = batch["copies"] > 0
            for (number, is_query), part in batch.groupby([batch["shard"], asks]):
                if number != current:
                    current, held, shard = number, [], None
                if not is_query:
                    held.append((part["id"].to_numpy(np.int64), part["v"].tolist()))
                    continue
                if not held and shard is None:
                    continue
                if shard is None:
                    dims = max(len(v) for _, vs in held for v in vs)
                    shard = Shard(np.concatenate([i for i, _ in held]), np.concatenate([_matrix(vs, dims) for _, vs in held]))
                    held = []
                own = part["id"].to_numpy(np.int64)
                found = shard.search(own, _matrix(part["v"].tolist(), shard.values.shape[1]), k)
                rows = [(q, c, h, v, max(-_LONG - 1, min(_LONG, -s)), ((1 << 159) - s).to_bytes(20, "big")) for q, c, h, b in zip(own.tolist(), part["copies"].tolist(), part["h"].tolist(), found) for s, v in b]
                yield pd.DataFrame(rows, columns=["query_id", "copies", "h", "vec_id", "score", "exact"])

    sorted_ = sides.withColumn("h", F.xxhash64("v")).repartition(shards, "shard").sortWithinPartitions("shard", "copies")
    found = sorted_.mapInPandas(search, "query_id long, copies long, h long, vec_id long, score long, exact binary")
    # exact is the score as big-endian bytes, which sort as the numbers do, also beyond a long.
    ranked = found.withColumn("rank", F.row_number().over(Window.partitionBy("query_id", "h").orderBy(F.desc("exact"), "vec_id"))).where(F.col("rank") <= k)
    each = ranked.withColumn("_copy", F.explode(F.sequence(F.lit(1).cast("long"), "copies")))
    return each.select("query_id", "rank", "vec_id", "score")


def op9_topk_search(spark: SparkSession, sf_dir: str) -> DataFrame:
    vectors = table(spark, sf_dir, "embeddings")
    return top_k(vectors, vectors.where(F.col("vec_id") % QUERY_EVERY == 0))


ORACLE_SQL = f"""
with v as (
  select vec_id, [cast(floor({SCALE} * cast(x as double)) as bigint) for x in embedding] as c from embeddings
  where embedding is not null and len([x for x in embedding if x is null or not isfinite(x)]) = 0 and vec_id is not null
), s as (
  select q.vec_id as query_id, d.vec_id, cast(list_sum([coalesce(p[1], 0) * coalesce(p[2], 0) for p in list_zip(q.c, d.c)]) as bigint) as score
  from v q join v d on q.vec_id % {QUERY_EVERY} = 0 and q.vec_id <> d.vec_id
), r as (select *, row_number() over (partition by query_id order by score desc, vec_id) as rank from s)
select query_id, cast(rank as int) as rank, vec_id, score from r where rank <= {K}
"""

QUERIES = {"op9_topk_search": op9_topk_search}
ORACLES = {"op9_topk_search": ORACLE_SQL}
