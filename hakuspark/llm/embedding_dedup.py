"""Near-duplicate embeddings: all pairs of cosine at least a threshold, by dual traversal of cover trees.

Equal vectors become one class with a weight. Classes are dealt into cells around centres from a bounded sample
(SAMPLE_ROWS rows; a centre for each block's worth of classes, CENTERS at least, by farthest-first order, that is,
the top of a cover tree) and large cells into blocks of about BLOCK_BYTES. Each block gets a cover tree: nested levels
of centres with halving radii, where a node knows the largest distance from its centre to what is below. Trees are
stored once. A task takes two groups of at most GROUP_BLOCKS trees, so that a tree is sent once for each group and not
for each block, and compares those whose cells' covering radii let them hold a link: both trees are descended
together, and pairs of nodes that are farther apart than their radii and the link distance are pruned; if even the
farthest points must be linked, the pair is counted whole. Distances between centres are in double precision. What
is left is compared in single precision with a margin, and the hits in double precision. A task returns, for each
point, its number of links there and the smallest point that it is connected to, never the pairs; so a group of any
size costs rows in proportion.

With embeddings that lie apart in many directions no metric bound separates cells, and all pairs of blocks are
compared, each as matrix products: the work, and the trees sent, grow with the square of the rows then. Links are
exact in any case.

Defined cases: vectors that are null, all zero, or hold null or non-finite components link with nothing, and are
returned with no links as their own component; a shorter vector is filled with zeros; rows that repeat a vector
link with each other; an id that repeats is one row each; a component's id is its smallest non-null id; other
columns are ignored.
"""

from __future__ import annotations

import pickle
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from hakuspark.llm.common import drop_stored, small, stored, table
from hakuspark.llm.components import components, local_components, roots, unite
from hakuspark.llm.topk_search import usable

THRESHOLD = 0.95
SAMPLE_ROWS = 1_024
CENTERS = 8
BLOCK_BYTES = 1 << 22
GROUP_BLOCKS = 8
LEAF = 64
TILE = 2_048
#: Pairs of nodes with at most so many pairs of points are not descended further; points are compared in such lots.
FEW = 256
LOT = 100_000
#: More than single precision can be off by in a cosine, and double precision in a distance.
MARGIN, FAR = 2e-5, 1e-4


def unit(values: np.ndarray) -> np.ndarray:
    """Rows in double precision, scaled to length 1."""
    values = values.astype(np.float64)
    values = values / np.abs(values).max(1, keepdims=True)
    return values / np.sqrt(np.einsum("ij,ij->i", values, values))[:, None]


def matrix(vectors, dims: int) -> np.ndarray:
    out = np.zeros((len(vectors), dims))
    for i, v in enumerate(vectors):
        out[i, : len(v)] = v
    return out


def farthest_first(points: np.ndarray, count: int) -> np.ndarray:
    """Indices of up to count points, each the farthest from those before."""
    chosen, near = [0], points @ points[0]
    while len(chosen) < min(count, len(points)):
        chosen.append(int(near.argmin()))
        near = np.maximum(near, points @ points[chosen[-1]])
    return np.array(chosen)


def _cover(points: np.ndarray, radius: float) -> np.ndarray:
    """For each point the index of a centre within radius; centres are farther apart than that, and the first is one."""
    least = 1 - radius * radius / 2
    centers, owner = [0], np.full(len(points), -1)
    for at in range(0, len(points), 256):
        part = points[at : at + 256]
        near = part @ points[centers].T
        best = near.argmax(1)
        done = near[np.arange(len(part)), best] >= least
        owner[at : at + 256] = np.where(done, np.array(centers)[best], -1)
        among = part @ part.T >= least
        for i in np.flatnonzero(~done):
            if owner[at + i] < 0:
                centers.append(at + int(i))
                free = among[i] & (owner[at : at + 256] < 0)
                owner[at : at + 256][free] = at + i
    owner[centers] = centers
    return owner


class CoverTree:
    """Points in depth-first order, and nodes as arrays; the children of a node follow one another, widest first."""

    def __init__(self, points: np.ndarray, ids: np.ndarray, weights: np.ndarray):
        order = np.arange(len(points))
        center, start, end, reach, first, last = [0], [0], [len(points)], [2.0], [0], [0]
        waiting = [(0, 2.0)]
        for node, radius in waiting:
            members = order[start[node] : end[node]]
            if len(members) <= LEAF or radius < 1e-3:
                continue
            at = members == center[node]
            members = np.concatenate((members[at], members[~at]))
            owner = _cover(points[members].astype(np.float32), radius / 2)
            groups = np.argsort(owner, kind="stable")
            cuts = np.flatnonzero(np.diff(owner[groups])) + 1
            lots = np.split(members[groups], cuts)
            heads = members[owner[groups][np.concatenate(([0], cuts))]]
            wide = [float(np.sqrt(max(0.0, 2 - 2 * (points[lot] @ points[head]).min()))) if len(lot) > 1 else 0.0 for lot, head in zip(lots, heads)]
            first[node] = len(center)
            at = start[node]
            for i in sorted(range(len(lots)), key=lambda i: -wide[i]):
                lot = np.concatenate(([heads[i]], lots[i][lots[i] != heads[i]]))
                order[at : at + len(lot)] = lot
                center.append(heads[i])
                start.append(at)
                end.append(at + len(lot))
                reach.append(wide[i])
                first.append(0)
                last.append(0)
                if len(lot) > 1:
                    waiting.append((len(center) - 1, radius / 2))
                at += len(lot)
            last[node] = len(center)
        self.points, self.ids, self.weights = points[order], ids[order], weights[order]
        place = np.empty_like(order)
        place[order] = np.arange(len(order))
        center = place[np.array(center)]  # points move while their nodes are split, so centres are found again last
        self.center, self.start, self.end, self.first, self.last = (np.array(x, np.int64) for x in (center, start, end, first, last))
        self.reach = np.array(reach)

    def single(self) -> None:
        """Keep the points in single precision too, for products."""
        self.fast = self.points.astype(np.float32)

    def below(self, node: int) -> np.ndarray:
        """The children of a node, or itself if it has none."""
        return np.arange(self.first[node], self.last[node]) if self.last[node] else np.array([node])


class Links:
    """Dual traversal of two trees, or of one with itself; counts links and unites what they connect."""

    def __init__(self, a: CoverTree, b: CoverTree | None, threshold: float):
        self.a, self.b, self.same = a, a if b is None else b, b is None
        self.threshold, self.distance = threshold, float(np.sqrt(2 - 2 * threshold))
        self.shift = 0 if self.same else len(a.ids)
        self.counts = np.zeros(self.shift + len(self.b.ids), np.int64)
        self.parent = np.arange(len(self.counts))

    def run(self) -> None:
        waiting = [(0, 0)]
        while waiting:
            x, y = waiting.pop()
            if not self.a.last[x] and not self.b.last[y]:
                self._points(np.arange(self.a.start[x], self.a.end[x]), np.arange(self.b.start[y], self.b.end[y]), self.same and x == y)
            else:
                waiting.extend(self._children(self.a.below(x), self.b.below(y), self.same and x == y))

    def _children(self, xs: np.ndarray, ys: np.ndarray, own: bool) -> Iterator[tuple[int, int]]:
        """Pairs of nodes that may hold links; points stand last in each list and are settled at once."""
        a, b = self.a, self.b
        lone = lambda t, ns: int(np.searchsorted(-(t.end[ns] - t.start[ns] > 1).astype(int), 0))
        xs = np.concatenate((xs[a.end[xs] - a.start[xs] > 1], xs[a.end[xs] - a.start[xs] == 1]))
        ys = np.concatenate((ys[b.end[ys] - b.start[ys] > 1], ys[b.end[ys] - b.start[ys] == 1]))
        mx, my = lone(a, xs), lone(b, ys)
        self._points(a.start[xs[mx:]], b.start[ys[my:]], own)
        for one, two, half in ((xs[:mx], ys, own), (xs[mx:], ys[:my], False)):
            if own and not half:
                break  # the same pairs the other way round
            for at in range(0, len(one), TILE):
                part = one[at : at + TILE]
                cos = a.points[a.center[part]] @ b.points[b.center[two]].T
                far = a.reach[part][:, None] + b.reach[two][None, :] + (self.distance + FAR)
                keep = cos >= 1 - np.minimum(far, 2) ** 2 / 2
                i, j = np.nonzero(keep)
                if half:
                    right = j >= i + at
                    i, j = i[right], j[right]
                whole = np.sqrt(np.maximum(0, 2 - 2 * cos[i, j])) + a.reach[part[i]] + b.reach[two[j]] < self.distance - FAR
                x, y = part[i], two[j]
                few = (a.end[x] - a.start[x]) * (b.end[y] - b.start[y]) <= FEW
                self._few(x[few], y[few], half)
                for x, y, full in zip(x[~few].tolist(), y[~few].tolist(), whole[~few].tolist()):
                    if full and not (half and x == y):
                        self._all(x, y)
                    else:
                        yield x, y

    def _few(self, x: np.ndarray, y: np.ndarray, half: bool) -> None:
        """All points of many pairs of small nodes at once."""
        a, b = self.a, self.b
        size = b.end[y] - b.start[y]
        each = (a.end[x] - a.start[x]) * size
        for lot in np.split(np.arange(len(x)), np.searchsorted(np.cumsum(each), np.arange(LOT, int(each.sum()), LOT))):
            of = np.repeat(lot, each[lot])
            at = np.arange(len(of)) - np.repeat(np.cumsum(each[lot]) - each[lot], each[lot])
            p, q = a.start[x[of]] + at // size[of], b.start[y[of]] + at % size[of]
            if half:
                p, q = p[(x[of] != y[of]) | (p < q)], q[(x[of] != y[of]) | (p < q)]
            self._settle(p, q, np.einsum("ij,ij->i", a.fast[p], b.fast[q]) >= np.float32(self.threshold - MARGIN))

    def _settle(self, p: np.ndarray, q: np.ndarray, near: np.ndarray) -> None:
        """Compare the near pairs of points in double precision, and count and unite the links among them."""
        a, b = self.a, self.b
        p, q = p[near], q[near]
        for k in range(0, len(p), LOT):
            x, y = p[k : k + LOT], q[k : k + LOT]
            linked = np.einsum("ij,ij->i", a.points[x], b.points[y]) >= self.threshold
            x, y = x[linked], y[linked]
            np.add.at(self.counts, x, b.weights[y])
            np.add.at(self.counts, y + self.shift, a.weights[x])
            unite(self.parent, x, y + self.shift)

    def _all(self, x: int, y: int) -> None:
        """Every point below x is linked with every point below y, which is another node."""
        one, two = slice(self.a.start[x], self.a.end[x]), slice(self.shift + self.b.start[y], self.shift + self.b.end[y])
        self.counts[one] += self.b.weights[self.b.start[y] : self.b.end[y]].sum()
        self.counts[two] += self.a.weights[self.a.start[x] : self.a.end[x]].sum()
        p, q = np.arange(one.start, one.stop), np.arange(two.start, two.stop)
        unite(self.parent, np.concatenate((p, np.full(len(q), p[0]))), np.concatenate((np.full(len(p), q[0]), q)))

    def _points(self, p: np.ndarray, q: np.ndarray, own: bool) -> None:
        a, b = self.a, self.b
        for at in range(0, len(p), TILE):
            part = p[at : at + TILE]
            rest, before = (q[at:], at) if own else (q, 0)
            i, j = np.nonzero(a.fast[part] @ b.fast[rest].T >= np.float32(self.threshold - MARGIN))
            if own:
                right = j + before > i + at
                i, j = i[right], j[right]
            self._settle(part[i], rest[j], np.ones(len(i), np.bool_))


def _link_blocks(lots: list[int], allowed: np.ndarray, dims: int, threshold: float):
    """The two group functions: a block to its tree and tiles, and a tile's trees to links by point."""
    offset, cell_of = np.concatenate(([0], np.cumsum(lots))), np.repeat(np.arange(len(lots)), lots)
    per = min(GROUP_BLOCKS, -(-len(cell_of) // GROUP_BLOCKS))
    groups = -(-len(cell_of) // per)

    def build(rows: pd.DataFrame) -> pd.DataFrame:
        cell, lot = int(rows["cell"].iloc[0]), int(rows["lot"].iloc[0])
        tree = CoverTree(unit(matrix(rows["v"], dims)), rows["cid"].to_numpy(np.int64), rows["n"].to_numpy(np.int64))
        block = int(offset[cell] + lot)
        own = block // per
        near = allowed[cell_of[own * per : (own + 1) * per]].any(0)[cell_of]
        others = np.unique(np.flatnonzero(near) // per)
        tiles = np.minimum(own, others) * groups + np.maximum(own, others)
        return pd.DataFrame({"block": block, "tiles": [tiles], "blob": [pickle.dumps(tree, protocol=5)]})

    def link(rows: pd.DataFrame) -> pd.DataFrame:
        first, second = divmod(int(rows["tile"].iloc[0]), groups)
        trees = {block: pickle.loads(blob) for block, blob in zip(rows["block"].tolist(), rows["blob"])}
        for tree in trees.values():
            tree.single()
        cids, counts, ends = [], [], []
        for x in sorted(trees):
            for y in sorted(trees):
                if x // per != first or y // per != second or x > y or not allowed[cell_of[x], cell_of[y]]:
                    continue
                found = Links(trees[x], None if x == y else trees[y], threshold)
                found.run()
                at = np.flatnonzero(found.counts)
                ids = np.concatenate([trees[t].ids for t in sorted({x, y})])
                cids.append(ids[at])
                counts.append(found.counts[at])
                ends.append(ids[roots(found.parent, at)])
        if not any(map(len, cids)):
            return pd.DataFrame({"cid": [], "links": [], "root": []}, dtype=np.int64)
        node, root = local_components(np.concatenate(cids), np.concatenate(ends))
        links = np.zeros(len(node), np.int64)
        np.add.at(links, np.searchsorted(node, np.concatenate(cids)), np.concatenate(counts))
        return pd.DataFrame({"cid": node, "links": links, "root": root})

    return build, link, groups


def near_duplicates(vectors: DataFrame, threshold: float = THRESHOLD, key: str = "vec_id", vector: str = "embedding") -> DataFrame:
    """Return key, n_links, component_id and kept for every row."""
    v = F.col(vector)
    good = usable(v) & F.coalesce(F.exists(v, lambda x: x != 0), F.lit(False))
    rows = vectors.select(F.col(key).alias("_key"), F.when(good, v).alias("v"))
    # Rows that take no part have a null second half of the digest, and a first half that spreads them.
    rows = rows.select("_key", "v", F.coalesce(F.when(F.col("v").isNotNull(), F.xxhash64("v")), F.xxhash64("_key")).alias("h1"), F.when(F.col("v").isNotNull(), F.xxhash64(F.lit(1), "v")).alias("h2"))
    grouped = rows.where("v is not null").groupBy("h1", "h2").agg(F.count("*").alias("n"), F.min("_key").alias("min_key"), F.first("v").alias("v"))
    classes = stored(grouped.withColumn("cid", F.monotonically_increasing_id()), "classes")
    facts = classes.agg(F.count("*").alias("n"), F.max(F.size("v")).alias("dims")).first()
    if not facts["n"]:
        return rows.select(F.col("_key").alias(key), F.lit(0).cast("long").alias("n_links"), F.col("_key").alias("component_id"), F.lit(True).alias("kept"))
    dims = facts["dims"]
    sample = unit(matrix([r["v"] for r in classes.orderBy("h1", "h2").limit(SAMPLE_ROWS).select("v").collect()], dims))
    block_rows = max(256, BLOCK_BYTES // (8 * dims))
    centers = sample[farthest_first(sample, max(CENTERS, facts["n"] // block_rows))]

    def assign(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            cos = unit(matrix(batch["v"], dims)) @ centers.T
            cell = cos.argmax(1)
            yield batch.assign(cell=cell.astype(np.int32), far=np.sqrt(np.maximum(0, 2 - 2 * cos[np.arange(len(cell)), cell])))

    kind = classes.schema["v"].dataType.simpleString()
    celled = stored(classes.select("cid", "n", "v").mapInPandas(assign, f"cid long, n long, v {kind}, cell int, far double"), "cells")
    sizes = {r["cell"]: (r["n"], r["far"]) for r in celled.groupBy("cell").agg(F.count("*").alias("n"), F.max("far").alias("far")).collect()}
    lots = [-(-sizes.get(c, (0, 0))[0] // block_rows) for c in range(len(centers))]
    far = np.array([sizes.get(c, (0, 0.0))[1] for c in range(len(centers))])
    apart = np.sqrt(np.maximum(0, 2 - 2 * centers @ centers.T))
    allowed = apart <= far[:, None] + far[None, :] + np.sqrt(2 - 2 * threshold) + FAR
    build, link, groups = _link_blocks(lots, allowed, dims, threshold)
    lot = F.pmod(F.xxhash64("cid"), F.element_at(F.lit([max(1, x) for x in lots]), F.col("cell") + 1)).cast("int")
    trees = stored(celled.withColumn("lot", lot).repartition(sum(lots), "cell", "lot").groupBy("cell", "lot").applyInPandas(build, "block long, tiles array<long>, blob binary"), "trees")
    tiles = trees.select(F.explode("tiles").alias("tile"), "block", "blob").repartition(min(10_000, groups * (groups + 1) // 2), "tile")
    links = stored(tiles.groupBy("tile").applyInPandas(link, "cid long, links long, root long"), "links")
    drop_stored(trees)
    drop_stored(celled)
    joined = components(links.select(F.col("cid").alias("a"), F.col("root").alias("b")))
    ids = classes.select("cid", "h1", "h2", "n", "min_key")
    labelled = ids.join(joined, ids["cid"] == joined["node"], "left").withColumn("root", F.coalesce("root", "cid")).drop("node")
    # Stored, so that the join reads two exchanges and a large component's part can be split.
    least = stored(labelled.groupBy("root").agg(F.min("min_key").alias("component_id")), "least")
    counts = links.groupBy("cid").agg(F.sum("links").alias("links"))
    done = labelled.join(least, "root").join(counts, "cid", "left").select("h1", "h2", (F.col("n") - 1 + F.coalesce("links", F.lit(0))).alias("n_links"), "component_id")
    out = rows.drop("v").join(small(done, facts["n"]), ["h1", "h2"], "left")
    component = F.when(F.col("n_links").isNull(), F.col("_key")).otherwise(F.col("component_id"))
    return out.select(F.col("_key").alias(key), F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"), component.alias("component_id"), F.col("_key").eqNullSafe(component).alias("kept"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "embeddings"))


ORACLE_SQL = r"""
with recursive v as (
  select vec_id, cast(embedding as double[]) as e from embeddings
), good as (
  select vec_id, e from v where e is not null and len([x for x in e if x is null or not isfinite(x)]) = 0 and len([x for x in e if x <> 0]) > 0
), links as (
  select a.vec_id as a, b.vec_id as b from good a join good b on a.vec_id <> b.vec_id and list_cosine_similarity(a.e, b.e) >= 0.95
), reach(a, b) as (select a, b from links union select r.a, l.b from reach r join links l on r.b = l.a),
least as (select a, min(b) as b from reach group by a), counts as (select a, count(*) as n from links group by a)
select vec_id, coalesce(n, 0) as n_links, least(vec_id, coalesce(l.b, vec_id)) as component_id, vec_id = least(vec_id, coalesce(l.b, vec_id)) as kept
from v left join counts c on c.a = vec_id left join least l on l.a = vec_id
"""

QUERIES = {"op1_embedding_dedup": op1_embedding_dedup}
ORACLES = {"op1_embedding_dedup": ORACLE_SQL}
