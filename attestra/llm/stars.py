"""Comparisons within buckets of any size: what near duplicates of texts and of lines have in common.

Nodes (sets, by an id) have sketches, whose bands are bucket keys; a bucket's number has its band in the
lowest BAND_BITS bits. Nodes that share a bucket may be linked:

1. Each task pairs the entries that it has of a bucket with the first of them (starred()). Only the first goes
   on, and is paired with the least of those of all tasks (shared()). So a bucket that holds a third of
   all nodes has no more than an entry from each task where its entries meet.
2. Pairs are joined with what they need. Partners of one frequent node are dealt over several tasks,
   HUB for each (with_both()).
3. Buckets whose nodes then remain in different components are compared whole (open_links()): at first
   sketches alone, in blocks of BLOCK, for which only nodes that may be linked with one of another
   component go on; then their contents, in blocks of BLOCK_BYTES. Only links that join something leave
   a task: fewer than it has nodes, however many pairs a group has.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import few, map_arrow, partitions, written

BAND_BITS = 6
HUB, BLOCK, BLOCK_BYTES = 2000, 1024, 8_000_000
#: Bytes of sketches that are compared at once.
STEP_BYTES = 8_000_000
#: Pairs that are verified before it is looked again which are joined by now.
TOGETHER = 1024


def starred(buckets: np.ndarray, nodes: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Of entries (bucket, node): places of each bucket's first; places of its others, of the first of each of those, and its number of entries."""
    order = np.lexsort((nodes, buckets))
    b, n = buckets[order], nodes[order]
    new = np.ones(len(b), bool)
    new[1:] = (b[1:] != b[:-1]) | (n[1:] != n[:-1])
    order, b = order[new], b[new]
    lead = np.ones(len(b), bool)
    lead[1:] = b[1:] != b[:-1]
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, len(b)))
    return order[first], order[~lead], np.repeat(order[first], size)[~lead], np.repeat(size, size)[~lead]


def shared(entries: DataFrame) -> DataFrame:
    """bucket, u, v, n of pairs to look at, from tasks' entries.

    entries: bucket, node of those that go on (u null), and bucket, node, u, n of those that are paired.
    The latter are dealt out by what is their own, lest a large bucket's all go to one task.
    """
    key = F.when(F.col("u").isNull(), F.col("bucket")).otherwise(F.xxhash64("u", "node"))
    ahead = F.when(F.col("u").isNull(), F.col("node"))
    bucket = Window.partitionBy("_key")
    rows = entries.withColumn("_key", key).withColumn("_least", F.min(ahead).over(bucket)).withColumn("_n", F.count(ahead).over(bucket))
    rows = rows.where("u IS NOT NULL OR node <> _least")
    return rows.select("bucket", F.coalesce("u", "_least").alias("u"), F.col("node").alias("v"), F.coalesce("n", "_n").cast("long").alias("n"))


def pairs_of(rows: DataFrame) -> DataFrame:
    """u, v, s of each pair among those of shared(): s deals the partners of a frequent u over several tasks."""
    pairs = rows.groupBy("u", "v").agg(F.max("n").alias("n"))
    return pairs.select("u", "v", F.pmod(F.xxhash64("v"), F.ceil(F.col("n") / HUB)).cast("int").alias("s"))


def with_both(pairs: DataFrame, nodes: DataFrame) -> DataFrame:
    """pairs with the columns of both nodes, named for u and v: x of the first is xu."""
    names = [c for c in nodes.columns if c != "node"]
    of = lambda end: nodes.select(F.col("node").alias(end), *(F.col(c).alias(f"{c}{end}") for c in names))
    ahead = pairs.select("u", "s").distinct().join(of("u"), "u")
    return pairs.join(of("v"), "v").join(ahead, ["u", "s"]).select("u", "v", "s", *(f"{c}{end}" for c in names for end in "uv"))


def matrix(column: pa.Array, kind: type = np.uint16) -> np.ndarray:
    """Rows of a binary column of one length."""
    return np.frombuffer(b"".join(column.to_pylist()), kind).reshape(len(column), -1)


def rows_of(rows: np.ndarray) -> pa.Array:
    """A binary column of the rows of a matrix."""
    wide = rows.shape[1] * rows.itemsize
    return pa.Array.from_buffers(pa.binary(), len(rows), [None, pa.py_buffer((np.arange(len(rows) + 1) * wide).astype(np.int32)), pa.py_buffer(np.ascontiguousarray(rows))])


def whole_groups(batches: Iterator[pa.RecordBatch], keys: int) -> Iterator[tuple[pa.Table, np.ndarray]]:
    """Rows that come in order of their first `keys` columns, in tables that divide no group, with the starts of their groups."""
    held: list[pa.RecordBatch] = []

    def starts(columns) -> np.ndarray:
        new = np.zeros(len(columns[0]), bool)
        new[:1] = True
        for c in columns:
            x = c.to_numpy(zero_copy_only=False) if isinstance(c, pa.Array) else c.to_numpy()
            new[1:] |= x[1:] != x[:-1]
        return np.flatnonzero(new)

    def out(parts: list[pa.RecordBatch]) -> tuple[pa.Table, np.ndarray]:
        table = pa.Table.from_batches(parts).combine_chunks()
        return table, starts([table.column(k) for k in range(keys)])

    for batch in batches:
        if not len(batch):
            continue
        last = int(starts([batch.column(k) for k in range(keys)])[-1])
        same = bool(held) and all(held[-1].column(k)[len(held[-1]) - 1].as_py() == batch.column(k)[0].as_py() for k in range(keys))
        if last or not same:
            if held or last:
                yield out([*held, *([batch.slice(0, last)] if last else [])])
            held = []
        held.append(batch.slice(last))
    if held:
        yield out(held)


#: Elements of sets that are compared at once; bits of a set's outline; bytes of outlines held at once.
STEP_SETS, OUTLINE, OUTLINE_BYTES = 500_000, 4096, 8_000_000


def alike(flat: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    """Whether sets i and j, of which bounds has the n + 1 ends in flat, have `share` percent or more in common, for arrays of i and j.

    flat holds 64-bit hashes, of which 47 bits are compared; repeated ones in a set count once. A set's
    outline has a bit for each of its elements' lowest bits. Two sets have no more in common than
    their outlines and what one of them lost to shared bits: pairs for which that is too little go.
    The elements of the others are sorted together and counted.
    """
    out = np.zeros(len(i), bool)
    if not len(i):
        return out
    owner = np.repeat(np.arange(len(bounds) - 1, dtype=np.uint64), np.diff(bounds))
    if len(bounds) <= 1 << 17:  # number and element of a set in one word
        key = owner << np.uint64(47) | flat >> np.uint64(17)
        key.sort()
        owner, flat = key >> np.uint64(47), key & np.uint64((1 << 47) - 1)
    else:
        flat = flat >> np.uint64(17)
        order = np.lexsort((flat, owner))
        owner, flat = owner[order], flat[order]
    new = np.ones(len(flat), bool)
    new[1:] = (flat[1:] != flat[:-1]) | (owner[1:] != owner[:-1])
    owner, flat = owner[new].astype(np.int64), flat[new]
    size = np.bincount(owner, minlength=len(bounds) - 1)
    bounds = np.concatenate([[0], np.cumsum(size)])
    likely = np.arange(len(i))
    if len(size) * OUTLINE // 8 <= OUTLINE_BYTES:
        held = np.zeros((len(size), OUTLINE), bool)
        held[owner, (flat & np.uint64(OUTLINE - 1)).astype(np.int64)] = True
        lost, bits = size - held.sum(axis=1), np.packbits(held, axis=1).view(np.uint64)
        step = max(1, OUTLINE_BYTES * 8 // OUTLINE)
        most = np.concatenate([np.bitwise_count(bits[i[at : at + step]] & bits[j[at : at + step]]).sum(axis=1, dtype=np.int64) for at in range(0, len(i), step)])
        most += np.minimum(lost[i], lost[j])
        likely = np.flatnonzero(100 * most >= share * (size[i] + size[j] - most))
    i, j = i[likely], j[likely]
    before, at = np.concatenate([[0], np.cumsum(size[i] + size[j])]), 0
    while at < len(i):
        to = min(len(i), at + 65_536, max(at + 1, int(np.searchsorted(before, before[at] + STEP_SETS, side="right")) - 1))
        out[likely[at:to]] = _counted(flat, bounds, size, i[at:to], j[at:to], share)
        at = to
    return out


def _counted(flat: np.ndarray, bounds: np.ndarray, size: np.ndarray, i: np.ndarray, j: np.ndarray, share: int) -> np.ndarray:
    keys = []
    for side, k in enumerate((i, j)):
        own = size[k]
        place = np.repeat(bounds[k] - np.concatenate([[0], np.cumsum(own)[:-1]]), own)
        place += np.arange(len(place))
        key = flat[place] << np.uint64(1)
        key |= np.repeat(np.arange(len(k), dtype=np.uint64) << np.uint64(48) | np.uint64(side), own)
        keys.append(key)
    key = np.concatenate(keys)
    key.sort()
    both = np.zeros(len(key), bool)
    both[1:] = (key[1:] ^ key[:-1]) == 1  # the same element, of the one and of the other
    pair = (key >> np.uint64(48)).astype(np.int64)
    common = np.bincount(pair[both], minlength=len(i))
    union = size[i] + size[j] - common
    return (100 * common >= share * union) & (union > 0)


#: Rows of sketches, their sizes, and those of the partners -> whether each pair may be linked.
Likely = Callable[[np.ndarray, np.ndarray, np.ndarray, np.ndarray], np.ndarray]


def candidates(starts: np.ndarray, band: np.ndarray, across: np.ndarray, block: np.ndarray, root: np.ndarray, sketch: np.ndarray, size: np.ndarray, rows: int, likely: Likely) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(i, j) of pairs within groups that have different roots and may be linked.

    Of groups that hold two blocks (across), only pairs of one and the other. With rows, the registers
    of a band, only pairs that share no earlier band: those are members of that one's bucket.
    """
    ends = np.repeat(np.append(starts[1:], len(root)), np.diff(np.append(starts, len(root))))
    left = ends - np.arange(len(root)) - 1
    before = np.concatenate([[0], np.cumsum(left)])
    step, at = max(1, STEP_BYTES // max(1, sketch.shape[1] * sketch.itemsize)), 0
    while at < len(left):
        to = max(at + 1, int(np.searchsorted(before, before[at] + step, side="right")) - 1)
        counts = left[at:to]
        i = np.repeat(np.arange(at, to), counts)
        j = np.arange(len(i)) - np.repeat(before[at:to] - before[at], counts) + i + 1
        at = to
        fits = (root[i] != root[j]) & (~across[i] | (block[i] != block[j]))
        i, j = i[fits], j[fits]
        for x in range(0, len(i), step):
            a, b = i[x : x + step], j[x : x + step]
            if rows:
                same = (sketch[a] == sketch[b]).reshape(len(a), -1, rows).all(axis=2)
                mine = same.argmax(axis=1) == band[a]
                a, b = a[mine], b[mine]
            if len(a):
                fits = likely(sketch[a], size[a], sketch[b], size[b])
                yield a[fits], b[fits]


def _blocked(rows: DataFrame) -> DataFrame:
    """Rows with a number of blocks -> each for the pairs of its block with every block, in order of bucket, lo, hi."""
    rows = rows.withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    rows = rows.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    rows = rows.withColumn("lo", F.least("block", "other")).withColumn("hi", F.greatest("block", "other")).drop("other", "blocks")
    return rows.repartition(partitions(rows.sparkSession), "bucket", "lo", "hi").sortWithinPartitions("bucket", "lo", "hi")


def _open(pairs: DataFrame, roots: DataFrame) -> DataFrame:
    """bucket, node, root, n of the members of buckets of more than two nodes that aren't all of one root.

    A bucket's pairs hold it together, so it is open if one of them has two roots.
    """
    known = few(roots, 48)
    root = lambda end: known.select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    named = pairs.join(root("u"), "u", "left").join(root("v"), "v", "left")
    named = written(named.select("bucket", "u", "v", "n", F.coalesce("ru", "u").alias("ru"), F.coalesce("rv", "v").alias("rv")), "named")
    open_ = named.groupBy("bucket").agg(F.bool_or(F.col("ru") != F.col("rv")).alias("open"), F.count("*").alias("c"), F.max("n").alias("m"))
    some = named.join(written(open_.where("open AND (c > 1 OR m > 2)").select("bucket"), "open"), "bucket", "left_semi")
    ends = F.explode(F.array(F.struct(F.col("u").alias("node"), F.col("ru").alias("root")), F.struct(F.col("v").alias("node"), F.col("rv").alias("root"))))
    members = written(some.select("bucket", ends.alias("x")).select("bucket", "x.node", "x.root").distinct(), "members")
    return members.join(written(members.groupBy("bucket").agg(F.count("*").alias("n")), "sizes"), "bucket")


def open_links(pairs: DataFrame, roots: DataFrame, sketches: DataFrame, contents: Callable[[DataFrame], DataFrame], kind: str, rows: int, likely: Likely, verify: Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]) -> DataFrame:
    """u, v: roots that nodes of a bucket link, in buckets that the links which gave `roots` leave in different components.

    sketches: node, size, sketch of all nodes. contents: from distinct nodes (node) to node, content (binary)
    of those. kind: type of nodes. verify: from contents and two arrays of their numbers to whether those are linked.
    """
    held = _open(pairs, roots).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n").join(sketches, "node")

    def parts(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
        for table, starts in whole_groups(batches, 3):
            bucket, lo, hi, block = (table.column(c).to_numpy() for c in ("bucket", "lo", "hi", "block"))
            root = table.column("root").combine_chunks().dictionary_encode()
            root = (root.combine_chunks() if isinstance(root, pa.ChunkedArray) else root).indices.to_numpy()
            yield table, starts, root, candidates(starts, bucket & ((1 << BAND_BITS) - 1), lo != hi, block, root, matrix(table.column("sketch").combine_chunks()), table.column("size").to_numpy(), rows, likely)

    def sift(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, _, found in parts(batches):
            some = np.zeros(len(table), bool)
            for i, j in found:
                some[i] = some[j] = True
            yield from table.select(["bucket", "node", "root", "size", "sketch"]).filter(pa.array(some)).to_batches()

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for table, _, root, found in parts(batches):
            content, names, u, v = table.column("content").combine_chunks(), table.column("root").combine_chunks(), [], []
            joined: dict[int, int] = {}  # which roots are one by now

            def find(r: int) -> int:
                while r in joined:
                    r = joined[r]
                return r

            for i, j in found:
                for at in range(0, len(i), TOGETHER):
                    a, b = i[at : at + TOGETHER], j[at : at + TOGETHER]
                    apart = np.array([find(x) != find(y) for x, y in zip(root[a].tolist(), root[b].tolist(), strict=True)], bool)
                    a, b = a[apart], b[apart]
                    if not len(a):
                        continue
                    linked = verify(content, a, b)
                    for x, y in zip(a[linked].tolist(), b[linked].tolist(), strict=True):
                        p, q = find(int(root[x])), find(int(root[y]))
                        if p != q:
                            joined[p] = q
                            u.append(x)
                            v.append(y)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(u, pa.int64())), names.take(pa.array(v, pa.int64()))], names=["u", "v"])

    columns = ["bucket", "lo", "hi", "block", "node", "root", "size", "sketch"]
    sifted = map_arrow(_blocked(held).select(columns), sift, f"bucket long, node {kind}, root {kind}, size int, sketch binary")
    sifted = written(sifted.dropDuplicates(["bucket", "node"]), "sifted")
    texts = contents(sifted.select("node").distinct())
    whole = sifted.join(texts, "node")
    heavy = written(whole.groupBy("bucket").agg(F.ceil(F.sum(F.octet_length("content") + 512) / BLOCK_BYTES).cast("int").alias("blocks")), "heavy")
    return map_arrow(_blocked(whole.join(heavy, "bucket")).select([*columns, "content"]), compare, f"u {kind}, v {kind}")
