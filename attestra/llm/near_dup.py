"""MinHash near-duplicates by SetSketch (operator 2).

A document's set of word shingles has REGISTERS registers. Each is the least of a hash of all its
shingles, truncated on an exponential scale of base BASE: floor(1 - log_BASE(least)). Sketches of
unions are the greater registers, and equal registers are about as likely as the sets are alike.

1. Documents of equal sets are one node.
2. BANDS groups of ROWS registers each are bucket keys. Two nodes of similarity 0.75 share no
   bucket with a probability of about 1e-8.
3. Nodes that share a bucket are paired as stars.py says: with the first of a bucket, in each task and
   then over all tasks. From the counts of greater, equal and lesser registers and the two set sizes,
   the similarity of greatest likelihood is estimated; pairs more than SLACK under the threshold
   go (over 4 standard errors). The others are verified on full sets, read anew from the texts of
   just those documents.
4. Buckets in which nodes remain in different components are done whole, in blocks: at first by
   registers, then on full sets of those nodes that may be linked, each pair in the first bucket
   that it shares. Only links that join something leave the task.
5. Components of verified links, by large-star and small-star rounds.

A null, empty or wordless text has an empty set: it is linked with nothing and is its own
component. Rows with equal doc_id are rows of their own, and each of one component's least doc_id
is kept; a null doc_id counts after all others and has the component's id if it is linked, else
null. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stars
from .common import few, map_arrow, scratch, steps, table, text_buffer, written
from .components import components, joined, merged
from .textvec import BY_SPACE, shingle_sets

WORDS, SHARE = 5, 75
BANDS, ROWS = 48, 4
REGISTERS = BANDS * ROWS
BASE = 1.001
SLACK = 0.13
#: Keys that a task gathers before it pairs them and passes them on.
GATHER = 1_000_000
#: Bytes of text that are handled at once.
STEP = 400_000

_rng = np.random.default_rng(20240229)
FACTORS = (_rng.integers(0, 1 << 31, REGISTERS, np.uint32) << np.uint32(1)) | np.uint32(1)
SHIFTS = _rng.integers(0, 1 << 32, REGISTERS, np.uint64).astype(np.uint32)
#: Least values of each step of the scale; a register is the number of steps that a minimum lies below 1.
SCALE = np.unique(np.minimum(2.0**32 * BASE ** -np.arange(0, 22200, dtype=np.float64), 2**32 - 1).astype(np.uint32))


def registers(shingles: np.ndarray) -> np.ndarray:
    """SetSketch registers of a set of 64-bit hashes."""
    least = np.full(REGISTERS, 0xFFFFFFFF, np.uint32)
    low = (shingles ^ (shingles >> np.uint64(32))).astype(np.uint32)
    for at in range(0, len(low), 512):
        np.minimum(least, (low[at : at + 512, None] * FACTORS[None, :] + SHIFTS[None, :]).min(axis=0), out=least)
    return (len(SCALE) - np.searchsorted(SCALE, least, side="right")).astype(np.uint16)


def band_keys(rows: np.ndarray) -> np.ndarray:
    """Bucket numbers of rows of registers, a column for each band; the band is in the lowest bits."""
    x = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for j in range(ROWS):
        h ^= x[:, :, j]
        h *= np.uint64(0xBF58476D1CE4E5B9)
        h ^= h >> np.uint64(29)
    low = np.uint64((1 << stars.BAND_BITS) - 1)
    return (h & ~low) | np.arange(BANDS, dtype=np.uint64)


def estimate(a: np.ndarray, b: np.ndarray, size_a: np.ndarray, size_b: np.ndarray) -> np.ndarray:
    """Similarity of greatest likelihood for pairs of rows of registers and their set sizes."""
    more, less = (a > b).sum(axis=1), (a < b).sum(axis=1)
    same = a.shape[1] - more - less
    u = size_a / (size_a + size_b)
    v = 1 - u
    grid = np.arange(0, 1.0001, 0.01)[None, :]
    p = lambda x: -np.log1p(-np.clip(x, 1e-9, 1) * (BASE - 1) / BASE) / np.log(BASE)
    up, down = p(u[:, None] - v[:, None] * grid), p(v[:, None] - u[:, None] * grid)
    eq = np.clip(1 - up - down, 1e-9, 1)
    score = more[:, None] * np.log(up) + less[:, None] * np.log(down) + same[:, None] * np.log(eq)
    score[grid > np.minimum(u / v, v / u)[:, None] + 0.005] = -np.inf
    return grid[0][score.argmax(axis=1)]


def sketches(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, node (digest of the set) and registers of each row; of empty sets, the last two are null."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets, STEP):
                sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SPACE, WORDS)
                nodes = [hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in sets]
                found = [registers(x).tobytes() if len(x) else None for x in sets]
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array([len(x) for x in sets], pa.int64()), pa.array(nodes, pa.binary()), pa.array(found, pa.binary())], names=["doc_id", "n_shingles", "node", "registers"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "doc_id long, n_shingles long, node binary, registers binary")


def _entries(nodes: DataFrame) -> DataFrame:
    """Tasks' entries of buckets, as stars.shared() takes them."""

    def spread(keys: list[np.ndarray], names: list[pa.Array]) -> Iterator[pa.RecordBatch]:
        if keys:
            bucket, name = np.concatenate(keys), pa.concat_arrays(names)
            first, other, lead, size = stars.starred(bucket, np.repeat(np.arange(len(name)), BANDS))
            for at in range(0, len(first), 20_000):
                s = first[at : at + 20_000]
                yield _entry(bucket[s], name.take(pa.array(s // BANDS)), pa.nulls(len(s), pa.binary()), pa.nulls(len(s), pa.int32()))
            for at in range(0, len(other), 20_000):
                s = slice(at, at + 20_000)
                yield _entry(bucket[other[s]], name.take(pa.array(other[s] // BANDS)), name.take(pa.array(lead[s] // BANDS)), pa.array(size[s], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, names, held = [], [], 0
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                keys.append(band_keys(stars.matrix(part.column(1))).ravel())
                names.append(part.column(0))
                held += len(keys[-1])
                if held >= GATHER:
                    yield from spread(keys, names)
                    keys, names, held = [], [], 0
        yield from spread(keys, names)

    return map_arrow(nodes.select("node", "sketch"), run, "bucket long, node binary, u binary, n int")


def _entry(bucket: np.ndarray, node: pa.Array, u: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), node, u, n], names=["bucket", "node", "u", "n"])


def _likely(share: int) -> stars.Likely:
    def likely(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        keep = 100 * np.minimum(size_a, size_b).astype(np.int64) >= share * np.maximum(size_a, size_b).astype(np.int64)
        keep[keep] = (a[keep] == b[keep]).mean(axis=1) >= share / 100 - SLACK - 0.02
        some = np.flatnonzero(keep)
        for at in range(0, len(some), 4096):
            k = some[at : at + 4096]
            keep[k] = estimate(a[k], b[k], size_a[k], size_b[k]) >= share / 100 - SLACK
        return keep

    return likely


def _sifted(pairs: DataFrame, share: int) -> DataFrame:
    """Of pairs with sizes and registers of both, u, v and s of those that may be linked."""
    likely = _likely(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                yield part.select([0, 1, 2]).filter(pa.array(likely(stars.matrix(part.column(5)), part.column(3).to_numpy(), stars.matrix(part.column(6)), part.column(4).to_numpy())))

    sizes = F.least("sizeu", "sizev").cast("long") * 100 >= F.greatest("sizeu", "sizev").cast("long") * share
    return map_arrow(pairs.where(sizes).select("u", "v", "s", "sizeu", "sizev", "sketchu", "sketchv"), run, "u binary, v binary, s int")


def _among(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """Rows of docs whose doc_id is among ids, a table of distinct ones."""
    ids = few(written(ids, "ids"), 16)
    return docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi")


def _sets(docs: DataFrame, nodes: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, content (its shingles) of the wanted nodes, from a text of each."""
    held = nodes.join(wanted, "node", "left_semi").select("doc_id").distinct()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets, STEP):
                sets = [x for x in shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SPACE, WORDS) if len(x)]
                yield pa.RecordBatch.from_arrays([pa.array([hashlib.blake2b(x, digest_size=16).digest() for x in sets], pa.binary()), pa.array([x.tobytes() for x in sets], pa.binary())], names=["node", "content"])

    # rows with a repeated doc_id may give a node more than once, or one that isn't wanted
    return map_arrow(_among(docs.select(F.col("doc_id").cast("long"), "text"), held), run, "node binary, content binary").groupBy("node").agg(F.first("content").alias("content"))


def _verify(share: int) -> Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]:
    def verify(sets: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        return stars.alike(*_flat(sets.take(pa.array(some))), place[: len(i)], place[len(i) :], share)

    return verify


def _flat(sets: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """The elements of sets end to end, and the n + 1 ends of each."""
    raw = sets.to_pylist()
    return np.frombuffer(b"".join(raw), np.uint64), np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)


def _verified(pairs: DataFrame, share: int) -> DataFrame:
    """Of pairs with both sets, links that join what those that are alike do."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 1024):
                part = batch.slice(at, 1024)
                n = np.arange(len(part))
                yield part.select([0, 1]).filter(pa.array(stars.alike(*_flat(pa.concat_arrays([part.column(2), part.column(3)])), n, n + len(part), share)))

    return map_arrow(pairs.select("u", "v", "contentu", "contentv"), lambda batches: joined(run(batches)), "u binary, v binary")


def near_duplicates(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id, kept of each row."""
    with scratch() as held:
        return held.keep(written(_judged(docs, share), "near-duplicates"))


def _judged(docs: DataFrame, share: int) -> DataFrame:
    rows = written(sketches(docs), "sketches")
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("size"), F.first("registers").alias("sketch"))
    nodes = written(nodes, "nodes")
    sized = nodes.select("node", "size", "sketch")
    pairs = written(stars.shared(_entries(nodes)), "shared")
    likely = written(_sifted(stars.with_both(written(stars.pairs_of(pairs), "pairs"), sized), share), "likely")
    sets = written(_sets(docs, nodes, likely.select(F.col("u").alias("node")).union(likely.select("v")).distinct()), "sets")
    roots = components(_verified(stars.with_both(likely, sets), share))
    found = merged(roots, stars.open_links(pairs, roots, sized, lambda wanted: _sets(docs, nodes, wanted), "binary", ROWS, _likely(share), _verify(share)))
    ids = nodes.select("node", "doc_id").join(found, "node").groupBy("root").agg(F.min("doc_id").alias("component_id"))
    named = found.join(written(ids, "component-ids"), "root").select("node", "component_id")
    alone = nodes.join(found, "node", "left_anti").select("node", F.col("doc_id").alias("component_id"))
    out = rows.select("doc_id", "n_shingles", "node").join(named.unionByName(alone), "node", "left")
    out = out.withColumn("component_id", F.when(F.col("node").isNull(), F.col("doc_id")).otherwise(F.col("component_id")))
    return out.select("doc_id", "n_shingles", "component_id", F.col("doc_id").eqNullSafe(F.col("component_id")).alias("kept"))


def op2_near_dup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
