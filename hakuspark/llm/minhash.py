"""Near-duplicate texts by min-max hashing over word shingles, confirmed on full sets.

Each of PERMUTATIONS multiplicative permutations of 32-bit shingle hashes gives two signature values, the least and
the greatest: half the hash evaluations of plain MinHash for the same number of values. Bands of ROWS values from
different permutations make buckets: at a similarity of 0.8 a pair misses all BANDS buckets with probability
(1 - 0.8 ** ROWS) ** BANDS, about 9e-7, and less above.

Texts of equal shingle sets are one class from the start (128-bit digest of the sorted set), so exact copies never
meet in a bucket. Links are looked for in two rounds, and every one is confirmed on full sets:

1. each member of a bucket against the bucket's smallest member;
2. where a bucket still holds several components, its members against those of other components.

In the second round, buckets of at most SMALL members give pairs; larger ones, joined where they share members, are
cut into blocks (of one component where it fills blocks, mixed otherwise), and pairs of blocks that meet in a bucket
are compared, except those of one and the same component. So no pair of one bucket that could join two components is
left out, yet a group of mutual copies costs rows in proportion to its members. The first round's parts hold at most
FIRST_TEXTS texts and about FIRST_SHINGLES shingles, the second's blocks PART_TEXTS and PART_SHINGLES. What is joined
by a key that a third of all rows may have is stored first, so that Spark can split such a join.

Defined cases: a null text, or one without words, has an empty set and links with nothing; with fewer words than a
shingle the whole sequence is one shingle; rows that repeat are one class; a component's id is its smallest non-null
id; null ids are kept; other columns are ignored. Texts are read whole.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pandas as pd
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import mask_of, masked, numbered, small, small_batches, stored, table, unmasked
from hakuspark.llm.components import components, roots, unite
from hakuspark.llm.packing import _nullable

WORDS = 5
PERCENT = 80
ROWS = 6
BANDS = 46
PERMUTATIONS = ROWS * BANDS // 2
SMALL = 16
FIRST_TEXTS = 128
FIRST_SHINGLES = 60_000
PART_TEXTS = 1_024
PART_SHINGLES = 500_000
CHUNK = 2_048
LOT_ROWS = 500
_PRIME = np.uint64(0x9E3779B97F4A7C15)
_MULTIPLIERS = (np.random.Generator(np.random.PCG64(7)).integers(1, 1 << 31, PERMUTATIONS, dtype=np.uint64) * 2 + 1).astype(np.uint32)[:, None]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def shingles(text: str | None, words: int) -> np.ndarray:
    """Sorted distinct 64-bit hashes of the shingles of a text, A-Z lower-cased, split at ASCII white space."""
    parts = (text or "").encode("utf-8", "replace").lower().split()
    if not parts:
        return np.zeros(0, np.uint64)
    hashes = np.fromiter(map(xxhash.xxh3_64_intdigest, parts), np.uint64, len(parts))
    k = min(words, len(parts))
    n = len(parts) - k + 1
    out = np.full(n, k, np.uint64)
    for i in range(k):
        out = _mixed((out ^ hashes[i : i + n]) * _PRIME)
    return np.unique(out)


def digest(values: np.ndarray) -> tuple[int, int]:
    """128 bits of a sorted set, as two signed longs."""
    both = np.frombuffer(xxhash.xxh3_128_digest(values.tobytes()), ">i8")
    return int(both[0]), int(both[1])


def signature(values: np.ndarray) -> np.ndarray:
    """Least values of all permutations, then greatest."""
    short = (values >> np.uint64(32)).astype(np.uint32)
    low, high = None, None
    for at in range(0, len(short), CHUNK):
        h = _MULTIPLIERS * short[at : at + CHUNK]
        a, b = h.min(1), h.max(1)
        low, high = (a, b) if low is None else (np.minimum(low, a), np.maximum(high, b))
    return np.concatenate((low, high))


def bands(signatures: np.ndarray) -> np.ndarray:
    """A 64-bit bucket for each band of each signature, as signed longs."""
    values = signatures.reshape(len(signatures), BANDS, ROWS).astype(np.uint64)
    out = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64), values.shape[:2]) * _PRIME
    for i in range(ROWS):
        out = _mixed((out ^ values[:, :, i]) * _PRIME)
    return out.view(np.int64)


def sketch(docs: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """_key, n_shingles, h1, h2 and bands of every row; rows without shingles have null bands and a null h2."""

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LOT_ROWS):
                part = batch.iloc[at : at + LOT_ROWS]
                sets = [shingles(t if isinstance(t, str) else None, words) for t in part["_text"]]
                full = [i for i, s in enumerate(sets) if len(s)]
                found = [None] * len(sets)
                if full:
                    for i, row in zip(full, bands(np.stack([signature(sets[i]) for i in full]))):
                        found[i] = row
                halves = [digest(s) for s in sets]
                yield pd.DataFrame({"_key": part["_key"].to_numpy(object), "n_shingles": [len(s) for s in sets], "h1": [h[0] for h in halves], "h2": pd.array([h[1] if len(s) else None for h, s in zip(halves, sets)], "Int64"), "bands": found})

    return docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).mapInPandas(_nullable(run), "_key long, n_shingles long, h1 long, h2 long, bands array<long>")


def shingle_sets(docs: DataFrame, wanted: DataFrame, words: int, key: str, text: str) -> DataFrame:
    """cid and set (little-endian unsigned 64-bit) for the rows of wanted: cid, min_key, h1, h2.

    An id may repeat with another text, so the digest picks the right row.
    """

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for at in range(0, len(batch), LOT_ROWS):
                lot, rows = batch.iloc[at : at + LOT_ROWS], []
                for cid, h1, h2, t in zip(lot["cid"], lot["h1"], lot["h2"], lot["_text"]):
                    found = shingles(t, words)
                    if digest(found) == (h1, h2):
                        rows.append((cid, found.tobytes()))
                yield pd.DataFrame(rows, columns=["cid", "set"])

    source = docs.select(F.col(key).cast("long").alias("_key"), F.col(text).alias("_text")).where(F.col("_text").isNotNull())
    found = source.join(small(wanted, wanted.count()), F.col("_key").eqNullSafe(F.col("min_key"))).select("cid", "h1", "h2", "_text")
    return found.mapInPandas(run, "cid long, set binary").dropDuplicates(["cid"])


def _match(percent: int):
    """Groups of rows (gid, side, cid, label, set), one after another, to links (a, b) that connect what is similar."""

    def links(cids: np.ndarray, sides: np.ndarray, labels: np.ndarray, blobs: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        sizes = np.fromiter(map(len, blobs), np.int64, len(blobs)) // 8
        codes = np.unique(np.frombuffer(b"".join(blobs), np.uint64), return_inverse=True)[1]
        ends = np.cumsum(sizes)
        own = not (sides == 1).any()
        right = np.arange(len(cids)) if own else np.flatnonzero(sides == 1)
        right = right[sizes[right] > 0]
        within = codes if own and len(right) == len(cids) else np.concatenate([codes[ends[i] - sizes[i] : ends[i]] for i in right]) if len(right) else codes[:0]
        starts = np.cumsum(sizes[right]) - sizes[right]
        labels = np.unique(labels, return_inverse=True)[1]
        parent, a, b = np.arange(int(labels.max()) + 1), [], []
        for i in np.flatnonzero(sides == 0):
            fit = (roots(parent, labels[right]) != roots(parent, labels[i : i + 1])) & (100 * np.minimum(sizes[right], sizes[i]) >= percent * np.maximum(sizes[right], sizes[i]))
            if own:
                fit &= right > i
            if not fit.any():
                continue
            mark = np.zeros(int(codes.max(initial=-1)) + 1, np.int32)
            mark[codes[ends[i] - sizes[i] : ends[i]]] = 1
            shared = np.add.reduceat(mark[within], starts)
            hit = right[fit & (100 * shared >= percent * (sizes[right] + sizes[i] - shared))]
            a.append(np.full(len(hit), cids[i]))
            b.append(cids[hit])
            unite(parent, labels[hit], np.full(len(hit), labels[i]))
        return (np.concatenate(a), np.concatenate(b)) if a else (cids[:0], cids[:0])

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        def settled(group: pd.DataFrame) -> Iterator[pd.DataFrame]:
            for _, g in group.groupby("gid", sort=False):
                a, b = links(g["cid"].to_numpy(), g["side"].to_numpy(), g["label"].to_numpy(), g["set"].tolist())
                if len(a):
                    yield pd.DataFrame({"a": a, "b": b})

        rest = None
        for batch in batches:
            batch = batch if rest is None else pd.concat((rest, batch))
            last = batch["gid"].to_numpy() == batch["gid"].iloc[-1]
            rest = batch[last]
            yield from settled(batch[~last])
        if rest is not None:
            yield from settled(rest)

    return run


def compare(groups: DataFrame, sets: DataFrame, percent: int) -> DataFrame:
    """Confirmed links (a, b) within groups: rows of gid, side, cid and label.

    Side 0 is compared with side 1, or with itself where there is none, except what has one label. A group's links
    connect all that is linked there, through labels too; links that would connect nothing more may be missing.
    """
    rows = groups.join(sets, "cid").select("gid", "side", "cid", "label", "set").repartition("gid").sortWithinPartitions("gid", "side", "cid")
    return stored(rows.mapInPandas(_match(percent), "a long, b long"), "links")


def _parts(texts, total, most_texts: int, most_shingles: int):
    """How many parts so many texts and shingles take."""
    return F.greatest(F.ceil(texts / most_texts), F.ceil(total / most_shingles), F.lit(1)).cast("long")


def _against_least(members: DataFrame, percent: int) -> DataFrame:
    """Groups of the first round: the least member of buckets, and in parts the others of its buckets."""
    pairs = members.where(F.col("cid") != F.col("least.cid")).where(100 * F.least("n", "least.n") >= percent * F.greatest("n", "least.n")).select(F.col("least.cid").alias("at"), "cid", "n").distinct()
    pairs = stored(pairs, "pairs")
    parts = stored(pairs.groupBy("at").agg(_parts(F.count("*"), F.sum("n"), FIRST_TEXTS, FIRST_SHINGLES).alias("parts")), "parts")
    gid = lambda part: F.xxhash64("at", part).alias("gid")
    others = pairs.join(parts, "at").select(gid(F.pmod(F.xxhash64("cid"), F.col("parts"))), F.lit(1).alias("side"), "cid", F.col("cid").alias("label"))
    firsts = parts.select("at", F.explode(F.sequence(F.lit(0).cast("long"), F.col("parts") - 1)).alias("part")).select(gid(F.col("part")), F.lit(0).alias("side"), F.col("at").alias("cid"), F.col("at").alias("label"))
    return firsts.unionByName(others)


def _small_buckets(open_: DataFrame, percent: int) -> DataFrame:
    """Groups of the second round from buckets of at most SMALL members: each member and others of other components."""
    one = open_.where(F.col("size") <= SMALL).select("bucket", "cid", "n", "label")
    two = one.select("bucket", *(F.col(c).alias(f"_{c}") for c in ("cid", "n", "label")))
    pairs = one.join(two, "bucket").where((F.col("cid") < F.col("_cid")) & (F.col("label") != F.col("_label")) & (100 * F.least("n", "_n") >= percent * F.greatest("n", "_n")))
    pairs = pairs.select("cid", "label", "_cid", "_label").distinct()
    firsts = pairs.select(F.col("cid").alias("gid"), F.lit(0).alias("side"), "cid", "label").distinct()
    return firsts.unionByName(pairs.select(F.col("cid").alias("gid"), F.lit(1).alias("side"), F.col("_cid").alias("cid"), F.col("_label").alias("label")))


def _large_buckets(open_: DataFrame) -> DataFrame:
    """Groups of the second round from larger buckets: pairs of blocks of what such buckets connect."""
    large = open_.where(F.col("size") > SMALL)
    families = components(large.select(F.col("cid").alias("a"), F.col("least.cid").alias("b")))
    members = stored(large.select("cid", "n", "label").distinct().join(families, F.col("cid") == F.col("node")).select(F.col("root").alias("family"), "cid", "n", "label"), "families")
    labels = members.groupBy("family", "label").agg(F.count("*").alias("texts"), F.sum("n").alias("total"))
    # A component that fills parts has blocks of its own; what is left of the family is mixed.
    parts = lambda texts, total: _parts(texts, total, PART_TEXTS, PART_SHINGLES)
    full = stored(labels.where((F.col("texts") > PART_TEXTS) | (F.col("total") > PART_SHINGLES)).select("family", "label", F.col("label").alias("kind"), parts(F.col("texts"), F.col("total")).alias("parts")), "full")
    mixed = stored(labels.join(full, ["family", "label"], "left_anti").groupBy("family").agg(parts(F.sum("texts"), F.sum("total")).alias("mixed")), "mixed")
    placed = members.join(full, ["family", "label"], "left").join(mixed, "family", "left")
    block = F.struct("family", F.coalesce("kind", F.lit(-1)).alias("kind"), F.pmod(F.xxhash64("cid"), F.coalesce("parts", "mixed", F.lit(1))).alias("k"))
    placed = stored(placed.select(block.alias("block"), "cid", "label"), "blocks")
    meet = stored(large.select("bucket", "cid").join(placed.select("cid", "block"), "cid").select("bucket", "block").distinct(), "meet")
    both = meet.join(meet.select("bucket", F.col("block").alias("other")), "bucket").where((F.col("block") <= F.col("other")) & ((F.col("block.kind") != F.col("other.kind")) | (F.col("block.kind") == -1)))
    both = stored(both.select("block", "other").distinct().withColumn("gid", F.xxhash64("block", "other")), "both")
    sides = both.select("gid", "block", F.lit(0).alias("side")).unionByName(both.where("block <> other").select("gid", F.col("other").alias("block"), F.lit(1).alias("side")))
    return placed.join(sides, "block").select("gid", "side", "cid", "label")


def near_duplicates(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """Return key, n_shingles, component_id and kept for every row."""
    small_batches(docs.sparkSession)
    sketches = stored(sketch(docs, words, key, text), "sketches")
    first = sketches.where("h2 is not null").groupBy("h1", "h2").agg(F.min("_key").alias("min_key"), F.first("n_shingles").alias("n"), F.first("bands").alias("bands"))
    classes = stored(first.withColumn("cid", F.monotonically_increasing_id()), "classes")
    spread = classes.select("cid", "n", F.explode("bands").alias("bucket"))
    shared = stored(spread.groupBy("bucket").agg(F.min(F.struct("cid", "n")).alias("least"), F.count("*").alias("size")).where("size > 1"), "shared")
    members = stored(spread.join(shared, "bucket"), "buckets")
    wanted = classes.select("cid", "min_key", "h1", "h2").join(members.select("cid").distinct(), "cid", "left_semi")
    sets = stored(shingle_sets(docs, stored(wanted, "wanted"), words, key, text), "sets")
    links = compare(_against_least(members, percent), sets, percent)
    joined = components(links)
    labelled = members.join(joined, F.col("cid") == F.col("node"), "left").withColumn("label", F.coalesce("root", "cid")).drop("node", "root")
    unsettled = stored(labelled.groupBy("bucket").agg(F.min("label").alias("_lo"), F.max("label").alias("_hi")).where("_lo < _hi").select("bucket"), "unsettled")
    open_ = stored(labelled.join(unsettled, "bucket", "left_semi"), "open")
    more = compare(_small_buckets(open_, percent).unionByName(_large_buckets(open_)), sets, percent)
    if more.take(1):
        joined = components(links.unionByName(more))
    ids = classes.select("cid", "h1", "h2", "min_key").join(joined, F.col("cid") == F.col("node"), "left").withColumn("root", F.coalesce("root", "cid"))
    least = stored(ids.groupBy("root").agg(F.min("min_key").alias("least_key")), "least")
    done = ids.join(least, "root").select("h1", "h2", "least_key")
    out = sketches.select("_key", "n_shingles", "h1", "h2").join(done, ["h1", "h2"], "left")
    component = F.when(F.col("h2").isNull(), F.col("_key")).otherwise(F.col("least_key"))
    return out.select(F.col("_key").alias(key), "n_shingles", component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))


def deduplicate(docs: DataFrame, words: int = WORDS, percent: int = PERCENT, key: str = "doc_id", text: str = "text") -> DataFrame:
    """The rows of docs, in all columns, without near duplicates: of each group the row with the smallest id stays.

    Works by row, so repeated and null ids lose nothing: of rows with equal ids the first by place in the files
    stays, and null ids come last.
    """
    rows = numbered(masked(docs), "_row")
    groups = near_duplicates(rows, words, percent, "_row", mask_of(docs, text)).select("_row", "component_id")
    named = stored(groups.join(rows.select("_row", F.col(mask_of(docs, key)).alias("_key")), "_row"), "named")
    order = F.struct(F.col("_key").isNull().alias("none"), "_key", "_row")
    best = stored(named.groupBy("component_id").agg(F.min(order).alias("_best"), F.count("*").alias("_n")).where("_n > 1"), "best")
    gone = stored(named.join(best, "component_id").where(F.col("_row") != F.col("_best._row")).select("_row"), "gone")
    return unmasked(rows.join(small(gone, gone.count()), "_row", "left_anti"), docs)


def op7_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), words=2)


#: All pairs that share a shingle; for small tables.
ORACLE_SQL = r"""
with recursive words as (
  select doc_id, regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x20\x09-\x0D]+') as w from documents
), shingled as (
  select distinct doc_id, unnest(case when len(w) = 0 then [] when len(w) = 1 then w else [w[i] || ' ' || w[i + 1] for i in range(1, len(w))] end) as s from words
), sizes as (select doc_id, count(*) as n from shingled group by doc_id),
shared as (select x.doc_id as a, y.doc_id as b, count(*) as n from shingled x join shingled y on x.s = y.s and x.doc_id <> y.doc_id group by 1, 2),
links as (select a, b from shared join sizes p on p.doc_id = a join sizes q on q.doc_id = b where 100 * shared.n >= 80 * (p.n + q.n - shared.n)),
reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as b from reach group by a)
select d.doc_id, coalesce(s.n, 0) as n_shingles, least(d.doc_id, coalesce(l.b, d.doc_id)) as component_id, d.doc_id = least(d.doc_id, coalesce(l.b, d.doc_id)) as kept
from documents d left join sizes s on s.doc_id = d.doc_id left join least l on l.a = d.doc_id
"""

QUERIES = {"op7_minhash_dedup": op7_minhash_dedup}
ORACLES = {"op7_minhash_dedup": ORACLE_SQL}
