"""Approximate nearest neighbours by a forest of random-projection trees (operator 5).

Nearness is the largest inner product. Vectors get one more component, sqrt(M**2 - |v|**2) with M the
greatest length, and queries a zero there: then the largest inner product is the least distance, and
hyperplanes through the space separate it. A tree splits a sample at the median of its projection on a
random direction, until leaves have LEAF sampled vectors. The sample has at most SAMPLE vectors (those
whose id has the least hash); of more rows, each leaf is split on by random directions at its mean,
level by level, so that leaves stay about as large at any size. Every row is put into a leaf of
every tree.

A query searches all trees through one priority queue of nodes, nearest margin first, until it has
met a number of leaves. That is LEAVES at least; PROBES queries, the ones of least hash, are held against
all rows first, and show how many leaves find RECALL of their neighbours. Queries and rows meet by
leaf, in order; each leaf gives its best by exact inner product in double precision, and the best of
those over all leaves are the result. Where so many leaves would hold more than a DENSE-th of the
rows, as in large indexes without structure, every query is compared with every row instead.

Rows of equal vectors are one vector in the index, with the TOP + 1 least ids, which is all that ties
to smaller ids can ever show. Vectors that are null, empty, zero or hold null or non-finite
components take no part, nor do those of another length than the most frequent one. Rows with a
null vec_id take no part; of rows with equal vec_id, the least vector does. With fewer candidates
than TOP met, all that were met are returned. Extra columns are ignored.
"""

from __future__ import annotations

import heapq
import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, partitions, table, written

TOP, TREES, LEAF, SAMPLE, SEED = 20, 32, 64, 60_000, 11
#: Leaves that a query meets at least; queries that show whether that is enough, and the share of neighbours they are to find.
LEAVES, PROBES, RECALL = 520, 64, 0.93
#: Leaves beyond LEAVES that hold more than this part of the rows cost more than all rows do.
DENSE = 20
#: Queries that one pass over all rows compares.
PASS = 20_000
#: Queries that a worker's queue handles together; bounds its table of margins.
TOGETHER = 64
#: Found pairs that a task gathers before it keeps the best of each query.
GATHER = 600_000


@dataclass
class Trees:
    """Inner node i of a tree has a direction, a threshold and two children; a child c below zero is leaf -c - 1."""

    direction: np.ndarray
    threshold: np.ndarray
    left: np.ndarray
    right: np.ndarray
    roots: list[int]
    extra: np.ndarray  # directions of the levels below sampled leaves
    centre: np.ndarray  # mean of each leaf's sample on those

    def leaves(self, rows: np.ndarray) -> np.ndarray:
        """Leaf of each row in each tree."""
        levels, out = len(self.extra), np.zeros((len(rows), len(self.roots)), np.int64)
        below = rows @ self.extra.T if levels else None
        for t, root in enumerate(self.roots):
            at = np.full(len(rows), root)
            live = np.flatnonzero(at >= 0)
            while len(live):
                side = np.einsum("ij,ij->i", rows[live], self.direction[at[live]]) > self.threshold[at[live]]
                at[live] = np.where(side, self.right[at[live]], self.left[at[live]])
                live = live[at[live] >= 0]
            leaf = -at - 1
            for e in range(levels):
                out[:, t] |= (below[:, e] > self.centre[leaf, e]).astype(np.int64) << e
            out[:, t] |= leaf << levels
        return out

    def search(self, queries: np.ndarray, most: int) -> list[list[int]]:
        """Leaves in the order in which one queue over all trees meets them."""
        levels, found = len(self.extra), []
        for at in range(0, len(queries), TOGETHER):
            margins = queries[at : at + TOGETHER] @ self.direction.T - self.threshold
            below = queries[at : at + TOGETHER] @ self.extra.T if levels else None
            for i in range(len(margins)):
                m, leaves = margins[i], []
                # (-priority, node, level below a leaf, bits so far)
                queue = [(-np.inf, r, 0, 0) for r in self.roots]
                heapq.heapify(queue)
                while queue and len(leaves) < most:
                    p, node, level, bits = heapq.heappop(queue)
                    if node >= 0:
                        x = float(m[node])
                        heapq.heappush(queue, (max(p, -x), int(self.right[node]), 0, 0))
                        heapq.heappush(queue, (max(p, x), int(self.left[node]), 0, 0))
                    elif level < levels:
                        x = float(below[i, level] - self.centre[-node - 1, level])
                        heapq.heappush(queue, (max(p, -x), node, level + 1, bits | 1 << level))
                        heapq.heappush(queue, (max(p, x), node, level + 1, bits))
                    else:
                        leaves.append(((-node - 1) << levels) | bits)
                found.append(leaves)
        return found


def _tree(sample: np.ndarray, number: int, leaf: int) -> tuple[np.ndarray, np.ndarray, list[int], list[int], int, list[np.ndarray]]:
    """One tree: directions, thresholds, children, root, rows of each leaf."""
    rng = np.random.default_rng((SEED, number))
    direction, threshold, left, right, members = [], [], [], [], []

    def split(rows: np.ndarray) -> int:
        if len(rows) > leaf:
            i, j = rows[rng.integers(0, len(rows), 2)]
            d = sample[i] - sample[j] if i != j else rng.standard_normal(sample.shape[1])
            size = np.linalg.norm(d)
            if size > 1e-12:
                x = sample[rows] @ (d / size)
                middle = float(np.median(x))
                if (x > middle).any():
                    me = len(direction)
                    direction.append(d / size)
                    threshold.append(middle)
                    left.append(0)
                    right.append(0)
                    left[me] = split(rows[x <= middle])
                    right[me] = split(rows[x > middle])
                    return me
        members.append(rows)
        return -len(members)

    root = split(np.arange(len(sample)))
    return np.array(direction).reshape(-1, sample.shape[1]), np.array(threshold), left, right, root, members


def joined(sample: np.ndarray, parts: list[tuple], levels: int) -> Trees:
    """Trees made one by one, as one set of arrays; `levels` random splits go below each of their leaves."""
    wide = sample.shape[1]
    extra = np.random.default_rng(SEED).standard_normal((levels, wide))
    extra /= np.linalg.norm(extra, axis=1, keepdims=True)
    left, right, roots, members, nodes = [], [], [], [], 0
    for direction, _, a, b, root, rows in parts:
        move = lambda c, n=nodes, m=len(members): c + n if c >= 0 else c - m
        left += map(move, a)
        right += map(move, b)
        roots.append(move(root))
        members += rows
        nodes += len(direction)
    centre = np.array([(sample[r].mean(axis=0) if len(r) else np.zeros(wide)) @ extra.T for r in members]).reshape(len(members), levels)
    return Trees(np.concatenate([p[0] for p in parts]), np.concatenate([p[1] for p in parts]), np.array(left, np.int64), np.array(right, np.int64), roots, extra, centre)


def grow(spark: SparkSession, sample: np.ndarray, trees: int, leaf: int, levels: int) -> Trees:
    """Trees over a sample, each grown by a task."""
    shared = spark.sparkContext.broadcast(sample)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            made = [pickle.dumps(_tree(shared.value, t, leaf)) for t in batch.column(0).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(made, pa.binary())], names=["id", "tree"])

    rows = map_arrow(spark.range(trees).repartition(trees), run, "id long, tree binary").collect()  # as many as trees, over at most SAMPLE rows
    return joined(sample, [pickle.loads(r.tree) for r in sorted(rows)], levels)


def _matrix(column: pa.Array, wide: int) -> np.ndarray:
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, wide)


def product(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Inner products of rows in double precision, components added in order."""
    total = np.zeros(len(a))
    for j in range(a.shape[1]):
        total += a[:, j] * b[:, j]
    return total


def compared(classes: DataFrame, keys: np.ndarray, queries: np.ndarray, top: int) -> DataFrame:
    """class, other, score: of all classes, the `top` with the largest products with each query, from each task. Equal scores go to the lesser class."""
    shared = classes.sparkSession.sparkContext.broadcast((keys, queries, np.linalg.norm(queries, axis=1)))
    wide = queries.shape[1]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, length = shared.value
        score = np.full((len(keys), top), -np.inf)
        other = np.full((len(keys), top), np.iinfo(np.int64).max)
        for batch in batches:
            near, rows = batch.column(0).to_numpy(), _matrix(batch.column(1), wide)
            for x in range(0, len(near), 2048):
                b, ids = rows[x : x + 2048], near[x : x + 2048]
                far = np.linalg.norm(b, axis=1).max()
                for y in range(0, len(keys), 1024):
                    q = queries[y : y + 1024]
                    rough = q @ b.T  # added in another order: what may differ by that is let through
                    slack = 1e-12 * wide * far * length[y : y + 1024]
                    least = score[y : y + 1024, -1] - slack
                    if len(ids) > top and np.isneginf(least).any():
                        least = np.maximum(least, np.partition(rough, len(ids) - top, axis=1)[:, len(ids) - top] - 2 * slack)
                    i, j = np.nonzero(rough >= least[:, None])
                    if not len(i):
                        continue
                    s = np.concatenate([product(q[i[z : z + 100_000]], b[j[z : z + 100_000]]) for z in range(0, len(i), 100_000)])
                    some = np.unique(i)
                    i = np.concatenate([np.repeat(some, top), i])
                    s = np.concatenate([score[y + some].ravel(), s])
                    v = np.concatenate([other[y + some].ravel(), ids[j]])
                    order = np.lexsort((v, -s, i))
                    first = np.searchsorted(i[order], some)
                    pick = order[first[:, None] + np.arange(top)]
                    score[y + some], other[y + some] = s[pick], v[pick]
        i, j = np.nonzero(np.isfinite(score))
        for z in range(0, len(i), 100_000):
            a, c = i[z : z + 100_000], j[z : z + 100_000]
            yield pa.RecordBatch.from_arrays([pa.array(keys[a]), pa.array(other[a, c]), pa.array(score[a, c])], names=["class", "other", "score"])

    return map_arrow(classes.select("class", "embedding"), run, "class long, other long, score double")


def _best(met: DataFrame, top: int) -> DataFrame:
    return met.withColumn("_n", F.row_number().over(Window.partitionBy("class").orderBy(F.desc("score"), "other"))).where(F.col("_n") <= top).select("class", "other", "score")


def _collected(rows: DataFrame, wide: int) -> tuple[np.ndarray, np.ndarray]:
    found = rows.select("class", "embedding").toArrow().combine_chunks()
    return found["class"].to_numpy(), _matrix(found["embedding"].combine_chunks(), wide)


def enough(classes: DataFrame, asked: DataFrame, forest, lift: Callable[[np.ndarray], np.ndarray], top: int, most: int) -> int | None:
    """Leaves in which PROBES of the asked classes find RECALL of their true neighbours; None if `most` don't."""
    spark, wide = classes.sparkSession, len(forest.value.extra[0]) - 1 if len(forest.value.extra) else forest.value.direction.shape[1] - 1
    keys, queries = _collected(asked.orderBy(F.xxhash64("class"), "class").limit(PROBES), wide)  # at most PROBES
    true = _best(compared(classes, keys, queries, top + 1), top + 1).where("class <> other")
    true = _best(true, top).join(classes.select(F.col("class").alias("other"), "embedding"), "other").select("class", "embedding")
    owner, near = _collected(true, wide)  # at most PROBES * top
    shared = spark.sparkContext.broadcast((keys, queries, owner, near))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, queries, owner, near = shared.value
        for batch in batches:
            for i in batch.column(0).to_pylist():
                mine = near[owner == keys[i]]
                if len(mine):
                    order = forest.value.search(np.append(queries[i], 0.0)[None], most)[0]
                    at = {leaf: n for n, leaf in enumerate(order, 1)}
                    ranks = [min(at.get(x, most + 1) for x in row) for row in forest.value.leaves(lift(mine)).tolist()]
                    yield pa.RecordBatch.from_arrays([pa.array(ranks, pa.int64())], names=["rank"])

    ranks = sorted(r.rank for r in map_arrow(spark.range(len(keys)).repartition(partitions(spark)), run, "rank long").collect())
    need = ranks[int(np.ceil(RECALL * len(ranks))) - 1] if ranks else 1
    return need if need <= most else None


def nearest(embeddings: DataFrame, step: int = 20, top: int = TOP, trees: int = TREES, leaf: int = LEAF, leaves: int | None = None, sample: int = SAMPLE) -> DataFrame:
    """query_id, rank, vec_id, score: neighbours found for each row whose vec_id is divisible by step."""
    spark = embeddings.sparkSession
    result = "query_id long, rank int, vec_id long, score double"
    bad = lambda x: x.isNull() | F.isnan(x) | (F.abs(x) == float("inf"))
    # single floats stay as they are, which loses nothing; all else is scored as doubles
    kind = "array<float>" if embeddings.schema["embedding"].dataType.simpleString() == "array<float>" else "array<double>"
    v = F.col("embedding")
    usable = embeddings.select(F.col("vec_id").cast("long").alias("vec_id"), v.cast(kind).alias("embedding")).where(F.col("vec_id").isNotNull() & v.isNotNull() & (F.size(v) > 0) & ~F.exists(v, bad) & F.exists(v, lambda x: x != 0))
    usable = usable.groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    usable = written(usable, "vectors")
    wide = usable.groupBy(F.size("embedding").alias("n")).count().orderBy(F.desc("count"), F.desc("n")).first()
    if wide is None:
        return spark.createDataFrame([], result)
    wide = wide.n
    usable = usable.where(F.size("embedding") == wide)
    # least ids of each distinct vector; Spark keeps so many of a group before it shuffles
    ranked = usable.withColumn("_n", F.row_number().over(Window.partitionBy("embedding").orderBy("vec_id"))).where(F.col("_n") <= top + 1)
    classes = written(ranked.groupBy("embedding").agg(F.min("vec_id").alias("class"), F.array_sort(F.collect_list("vec_id")).alias("ids")), "vector-classes")
    length = F.sqrt(F.aggregate("embedding", F.lit(0.0), lambda s, x: s + x.cast("double") * x.cast("double")))
    n, far = classes.agg(F.count("*"), F.max(length)).first()
    picked = classes.orderBy(F.xxhash64("class"), "class").limit(sample).select("embedding").collect()  # at most `sample`
    some = np.array([r.embedding for r in picked], np.float64)
    lift = lambda x: np.concatenate([x, np.sqrt(np.maximum(far**2 - (x**2).sum(axis=1, keepdims=True), 0))], axis=1)
    levels = max(0, int(np.ceil(np.log2(n / len(some)))))
    forest = spark.sparkContext.broadcast(grow(spark, lift(some), trees, leaf, levels))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 2048):
                part = batch.slice(at, 2048)
                found = forest.value.leaves(lift(_matrix(part.column(1), wide)))
                take = pa.array(np.repeat(np.arange(len(part)), found.shape[1]))
                yield pa.RecordBatch.from_arrays([pa.array(found.ravel()), pa.array([False] * found.size), part.column(0).take(take), part.column(1).take(take)], names=["leaf", "asks", "class", "embedding"])

    def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 512):
                part = batch.slice(at, 512)
                x = _matrix(part.column(1), wide)
                found = forest.value.search(np.concatenate([x, np.zeros((len(x), 1))], axis=1), meet_most)
                take = pa.array(np.repeat(np.arange(len(part)), [len(f) for f in found]))
                yield pa.RecordBatch.from_arrays([pa.array([y for f in found for y in f], pa.int64()), pa.array([True] * len(take)), part.column(0).take(take), part.column(1).take(take)], names=["leaf", "asks", "class", "embedding"])

    meeting = f"leaf long, asks boolean, class long, embedding {kind}"
    rows = map_arrow(classes.select("class", "embedding"), place, meeting)
    # each distinct vector among the queries asks once
    asked = usable.where(F.col("vec_id") % step == 0).select("embedding", "vec_id")
    asking = written(asked.join(classes.select("embedding", "class"), "embedding").select(F.col("vec_id").alias("query_id"), "class"), "queries")
    asked = written(classes.join(asking.select("class").distinct(), "class", "left_semi").select("class", "embedding"), "asked")
    total = len(forest.value.centre) << levels
    meet_most = leaves or LEAVES
    if leaves is None and total > LEAVES:
        most = max(LEAVES, total // (DENSE * trees))
        need = enough(classes, asked, forest, lift, top, most)
        meet_most = max(LEAVES, need) if need else None
    asks = map_arrow(asked, ask, meeting) if meet_most else None

    def best_of(found: list[tuple[np.ndarray, np.ndarray, np.ndarray]]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        q, v, s = (np.concatenate(x) for x in zip(*found, strict=True))
        order = np.lexsort((v, -s, q))
        q, v, s = q[order], v[order], s[order]
        new = np.append(True, (q[1:] != q[:-1]) | (v[1:] != v[:-1]))  # equal pairs have equal scores
        q, v, s = q[new], v[new], s[new]
        first = np.flatnonzero(np.append(True, q[1:] != q[:-1]))
        keep = np.arange(len(q)) - np.repeat(first, np.diff(np.append(first, len(q)))) <= top
        return q[keep], v[keep], s[keep]

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of leaf, rows before queries."""
        found, held, at, b, near = [], 0, None, np.zeros((0, wide)), np.zeros(0, np.int64)

        def out(rows: tuple) -> pa.RecordBatch:
            return pa.RecordBatch.from_arrays(list(map(pa.array, rows)), names=["class", "other", "score"])

        for batch in batches:
            leaf, asks, key = (batch.column(i).to_numpy(zero_copy_only=False) for i in range(3))
            vectors = _matrix(batch.column(3), wide)
            cut = np.flatnonzero(np.append(True, (leaf[1:] != leaf[:-1]) | (asks[1:] != asks[:-1])))
            for x, y in zip(cut.tolist(), [*cut[1:].tolist(), len(leaf)], strict=True):
                if not asks[x]:
                    fresh = leaf[x] != at
                    b, near = (vectors[x:y], key[x:y]) if fresh else (np.concatenate([b, vectors[x:y]]), np.concatenate([near, key[x:y]]))
                    at = leaf[x]
                elif leaf[x] == at:
                    for z in range(x, y, 256):
                        a, q = vectors[z : min(y, z + 256)], key[z : min(y, z + 256)]
                        score = np.zeros((len(a), len(b)))
                        for j in range(wide):
                            score += a[:, j, None] * b[None, :, j]
                        pick = np.argsort(-score, axis=1, kind="stable")[:, : top + 1]
                        found.append((np.repeat(q, pick.shape[1]), near[pick].ravel(), np.take_along_axis(score, pick, 1).ravel()))
                        held += pick.size
                if held > GATHER:
                    found = [best_of(found)]
                    held = len(found[0][0])
                    if held > GATHER // 2:
                        yield out(found[0])
                        found, held = [], 0
        if found:
            yield out(best_of(found))

    if meet_most:
        meets = rows.unionByName(asks).repartition(partitions(spark), "leaf").sortWithinPartitions("leaf", "asks", "class")
        met = map_arrow(meets, meet, "class long, other long, score double").distinct()
        best = written(_best(met, top + 1), "met")
    else:
        n_asked, best = asked.count(), None
        passes = -(-n_asked // PASS)
        for i in range(passes):
            keys, queries = _collected(asked.where(F.pmod(F.xxhash64("class"), F.lit(passes)) == i), wide)  # about PASS
            part = written(_best(compared(classes, keys, queries, top + 1), top + 1), "met")
            best = part if best is None else best.unionByName(part)
    # from distinct vectors back to rows: at most top + 1 vectors of at most top + 1 ids
    pairs = asking.join(best, "class").join(classes.select(F.col("class").alias("other"), "ids"), "other").select("query_id", "score", F.explode("ids").alias("vec_id")).where("vec_id <> query_id")
    rank = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return pairs.withColumn("rank", rank.cast("int")).where(F.col("rank") <= top).select("query_id", "rank", "vec_id", "score")


def op5_neighbours(spark: SparkSession, sf_dir: str) -> DataFrame:
    return nearest(table(spark, sf_dir, "embeddings"))
