"""N-gram Jaccard join (operator 12): documents by shingles as a sparse matrix, multiplied in blocks.

A document's row has its distinct WORDS-word shingles as columns. Rows that have SHARE percent of their
union in common are linked.

1. Rows of equal columns are one node, told apart by 128-bit digests and named by 64 bits of them (clashes()). Each task counts how many of its rows have a column, in SLOTS counters
   by the column's hash; the sums over all tasks put columns in an order, rare ones first.
2. A linked row has at least ceil(SHARE n / 100) columns in common with one of n, so two linked rows share
   one of the first n - ceil(SHARE n / 100) + 1 columns of each, and of the smaller one about half as many do.
   Only rows that meet in these columns are candidates, and only those of like sizes: a column is divided by
   classes of sizes (classes()). Frequent columns come last in the order: rows that have little else meet in them.
3. Bounds by sizes drop pairs: n and m columns can't have enough in common if the smaller is under SHARE
   percent of the greater, or if the product of both rows with columns folded to OUTLINE bits, plus what one of
   them lost by folding, is too little; of large rows a part of the columns is folded, and what that part differs
   in counts against the pair. Rows of a column and class meet as stars.py says, each with the first row at
   first; where that leaves several groups, all of them, group by group (reached()). The outcome is groups
   of rows outside of which nobody has a partner: components of what may be linked.
4. Each group is multiplied in blocks of rows of one class of sizes and the next, made anew from the texts of just
   those: columns that two rows of a block have become bits, and the product of two rows is the number of bits in common, added up COLUMNS at a
   time. It is exact; pairs that are joined by then are left out. A group of any size is pairs of blocks.
5. Components of links, by large-star and small-star rounds. Only links that join something leave a task.

No step misses a link: what is folded or left out is bounded from above. Columns are 64-bit hashes. A null, empty
or wordless text has no columns and is linked with nothing. Fewer words than WORDS are one column, the
whole sequence. Rows with equal doc_id are rows of their own; a null doc_id comes after all others and has the
component's id if it is linked, else null. An empty table gives no rows. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stars
from .common import few, map_arrow, scratch, steps, table, text_buffer, written
from .components import components, joined, merged
from .textvec import BY_SPACE, mix, shingle_sets

WORDS, SHARE = 3, 90
#: Counters of columns, by the highest bits of their hashes; bits of a folded row.
SLOTS, OUTLINE = 1 << 20, 2048
#: Columns up to which a row is folded whole; of larger ones, those whose highest PART_BITS bits are 0.
WHOLE, PART_BITS = 2000, 3
#: Bytes and rows of a block; columns that are multiplied at once.
BLOCK_BYTES, BLOCK, COLUMNS = 8_000_000, 2048, 1 << 14
#: Counters that are added up in one place at most.
TOGETHER = 16
#: Entries that a task gathers before it pairs them and passes them on; bytes of text handled at once.
GATHER, STEP = 1_000_000, 400_000


def needed(n: np.ndarray | int, share: int) -> np.ndarray | int:
    """Columns that a row of n has in common with any that it is linked with, at least."""
    return -(-share * n // 100)


def _slots(columns: np.ndarray) -> np.ndarray:
    return (columns >> np.uint64(64 - (SLOTS.bit_length() - 1))).astype(np.int64)


def outlines(flat: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """Rows folded to OUTLINE bits, as 16-bit words, and in two more words how many columns were folded."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    some = (size[owner] <= WHOLE) | (flat >> np.uint64(64 - PART_BITS) == 0)
    held = np.zeros((len(size), OUTLINE), bool)
    held[owner[some], (flat[some] & np.uint64(OUTLINE - 1)).astype(np.int64)] = True
    n = np.bincount(owner[some], minlength=len(size)).astype(np.uint32)
    return np.concatenate([np.packbits(held, axis=1).view(np.uint16), n.view(np.uint16).reshape(-1, 2)], axis=1)


def _rows(batch_texts: pa.Array, words: int) -> Iterator[tuple[int, int, list[np.ndarray], list[bytes | None]]]:
    """(from, to, columns, nodes) of a batch's texts, step by step."""
    data, offsets = text_buffer(batch_texts)
    for a, b in steps(offsets, STEP):
        sets = shingle_sets(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], BY_SPACE, words)
        yield a, b, sets, [hashlib.blake2b(x, digest_size=16).digest() if len(x) else None for x in sets]


def _laid(sets: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    return np.concatenate([*sets, np.zeros(0, np.uint64)]), np.concatenate([[0], np.cumsum([len(x) for x in sets])]).astype(np.int64)


def sketches(docs: DataFrame, words: int) -> DataFrame:
    """doc_id, n_shingles, node and outline of each row; and, with a null n_shingles, each task's counters of columns as its outline."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(SLOTS, np.uint32)
        for batch in batches:
            for a, b, sets, nodes in _rows(batch.column(1), words):
                flat, bounds = _laid(sets)
                np.add.at(counts, _slots(flat), 1)
                folded = outlines(flat, bounds)
                held = pa.array([x.tobytes() if node else None for x, node in zip(folded, nodes, strict=True)], pa.binary())
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(np.diff(bounds)), pa.array(nodes, pa.binary()), held], names=["doc_id", "n_shingles", "node", "outline"])
        yield pa.RecordBatch.from_arrays([pa.nulls(1, pa.int64()), pa.nulls(1, pa.int64()), pa.nulls(1, pa.binary()), pa.array([counts.tobytes()], pa.binary())], names=["doc_id", "n_shingles", "node", "outline"])

    return map_arrow(docs, run, "doc_id long, n_shingles long, node binary, outline binary")


def frequencies(counters: DataFrame) -> np.ndarray:
    """The steps, by powers of two, of the sums of tasks' counters; added up in ever fewer tasks, the last TOGETHER here."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros(SLOTS, np.uint64)
        for batch in batches:
            for x in batch.column(0).to_pylist():
                total += np.frombuffer(x, np.uint32)
        yield pa.RecordBatch.from_arrays([pa.array([np.minimum(total, 0xFFFFFFFF).astype(np.uint32).tobytes()], pa.binary())], names=["outline"])

    n = counters.count()
    while n > TOGETHER:
        n = -(-n // TOGETHER)
        counters = written(map_arrow(counters.repartition(n), run, "outline binary"), "counters")
    total = np.zeros(SLOTS, np.float64)
    for row in counters.collect():  # TOGETHER rows at most
        total += np.frombuffer(row.outline, np.uint32)
    return np.log2(total + 1).astype(np.uint8)


def classes(size: np.ndarray, share: int) -> np.ndarray:
    """Numbers of classes of sizes: of rows that may be linked, the greater is of the same class as the smaller or of the next."""
    return np.floor(np.log(np.maximum(size, 1)) / np.log(100 / share) + 1e-9).astype(np.int64)


def leading(flat: np.ndarray, bounds: np.ndarray, order: np.ndarray, share: int) -> tuple[np.ndarray, np.ndarray]:
    """Keys (column and class) under which each row is multiplied, with the number of the row.

    Under its own class a row meets those of its class and smaller ones, of which some may need it by all of its
    prefix. Under the next class it meets greater ones: it has at least 2 SHARE / (100 + SHARE) of its columns in
    common with them, so fewer will do. Rounding at a class's edge may make a class more: so one more is taken.
    """
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    at = np.lexsort((flat, order[_slots(flat)], owner))
    nth = np.arange(len(flat)) - bounds[:-1][owner]
    own = at[nth <= (size - needed(size, share))[owner]]
    fewer = at[nth <= (size - -(-2 * share * size // (100 + share)))[owner]]
    level = classes(size, share)
    keys = [mix(flat[own] ^ (level[owner[own]] + 1).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))]
    keys.append(mix(flat[fewer] ^ (level[owner[fewer]] + 2).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)))
    return np.concatenate(keys), np.concatenate([owner[own], owner[fewer]])


def _id(node: Column | str) -> Column:
    """The first 64 bits of a digest."""
    return F.conv(F.hex(F.substring(node, 1, 8)), 16, -10).cast("long")


def named(nodes: list[bytes], other: dict[bytes, int]) -> list[int]:
    """The 64-bit names of digests: their first bytes, or what `other` says."""
    return [other[x] if x in other else int.from_bytes(x[:8], "big", signed=True) for x in nodes]


def clashes(nodes: DataFrame) -> dict[bytes, int]:
    """Other names, from their last 64 bits, of digests that share their first ones.

    Of n nodes about n * n / 2**64 do: none of a billion, some tens of a trillion. Names that clash even so raise an error.
    """
    ids = nodes.select("node", _id("node").alias("id"))
    twice = written(ids.groupBy("id").agg(F.count("*").alias("n")).where("n > 1").select("id"), "clashes")
    found = {bytes(r.node): int.from_bytes(bytes(r.node)[8:], "big", signed=True) for r in ids.join(few(twice, 16), "id").collect()}
    if found and (len(set(found.values())) < len(found) or not ids.where(F.col("id").isin(list(found.values()))).isEmpty()):
        raise ValueError("digests of different texts share both halves")
    return found


def _entries(docs: DataFrame, order: np.ndarray, renamed: dict[bytes, int], words: int, share: int) -> DataFrame:
    """Tasks' entries of columns, as stars.shared() takes them."""
    shared = docs.sparkSession.sparkContext.broadcast(order)

    def spread(keys: list[np.ndarray], own: list[np.ndarray], names: list[bytes]) -> Iterator[pa.RecordBatch]:
        if not names:
            return
        bucket, node, name = np.concatenate(keys), np.concatenate(own), pa.array(named(names, renamed), pa.int64())
        first, other, lead, size = stars.starred(bucket, node)
        for at in range(0, len(first), 20_000):
            s = first[at : at + 20_000]
            yield _entry(bucket[s], name.take(pa.array(node[s])), pa.nulls(len(s), pa.int64()), pa.nulls(len(s), pa.int32()))
        for at in range(0, len(other), 20_000):
            s = slice(at, at + 20_000)
            yield _entry(bucket[other[s]], name.take(pa.array(node[other[s]])), name.take(pa.array(node[lead[s]])), pa.array(size[s], pa.int32()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, own, names, seen, held = [], [], [], set(), 0
        for batch in batches:
            for _, _, sets, nodes in _rows(batch.column(0), words):
                new = []
                for i, x in enumerate(nodes):  # equal rows of a task are one
                    if x is not None and x not in seen:
                        seen.add(x)
                        new.append(i)
                columns, owner = leading(*_laid([sets[i] for i in new]), shared.value, share)
                keys.append(columns)
                own.append(owner + len(names))
                names += [nodes[i] for i in new]
                held += len(columns)
                if held >= GATHER:
                    yield from spread(keys, own, names)
                    keys, own, names, seen, held = [], [], [], set(), 0
        yield from spread(keys, own, names)

    return map_arrow(docs.select("text"), run, "bucket long, node long, u long, n int")


def _entry(bucket: np.ndarray, node: pa.Array, u: pa.Array, n: pa.Array) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array(bucket.view(np.int64)), node, u, n], names=["bucket", "node", "u", "n"])


def _likely(share: int) -> stars.Likely:
    """Whether rows may be linked, by their sizes and what they have in common when folded: never false for those that are."""

    def likely(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        size_a, size_b = size_a.astype(np.int64), size_b.astype(np.int64)
        keep = 100 * np.minimum(size_a, size_b) >= share * np.maximum(size_a, size_b)
        some = np.flatnonzero(keep & ((size_a <= WHOLE) == (size_b <= WHOLE)))
        words = OUTLINE // 16
        bits = lambda z: np.bitwise_count(z).sum(axis=1, dtype=np.int64)
        folded = lambda z: z[:, words].astype(np.int64) | z[:, words + 1].astype(np.int64) << 16
        for at in range(0, len(some), 8192):
            k = some[at : at + 8192]
            x, y = a[k], b[k]
            n, m = folded(x), folded(y)
            x, y = x[:, :words], y[:, :words]
            common = bits(x & y) + np.minimum(n - bits(x), m - bits(y))  # of what was folded, at most
            differ = np.maximum(n - common, 0) + np.maximum(m - common, 0)
            most = (size_a[k] + size_b[k] - differ) // 2
            keep[k] = 100 * most >= share * (size_a[k] + size_b[k] - most)
        return keep

    return likely


def _sifted(pairs: DataFrame, share: int) -> DataFrame:
    likely = _likely(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                yield part.select([0, 1, 2]).filter(pa.array(likely(stars.matrix(part.column(5)), part.column(3).to_numpy(), stars.matrix(part.column(6)), part.column(4).to_numpy())))

    sizes = F.least("sizeu", "sizev").cast("long") * 100 >= F.greatest("sizeu", "sizev").cast("long") * share
    return map_arrow(pairs.where(sizes).select("u", "v", "s", "sizeu", "sizev", "sketchu", "sketchv"), run, "u long, v long, s int")


def _whole(docs: DataFrame, nodes: DataFrame, wanted: DataFrame, other: dict[bytes, int], words: int) -> DataFrame:
    """node, content (its columns) of the wanted nodes, from a text of each."""
    ids = few(written(nodes.join(wanted, "node", "left_semi").select("doc_id").distinct(), "ids"), 16)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for _, _, sets, names in _rows(batch.column(0), words):
                some = [i for i, x in enumerate(names) if x is not None]
                yield pa.RecordBatch.from_arrays([pa.array(named([names[i] for i in some], other), pa.int64()), pa.array([sets[i].tobytes() for i in some], pa.binary())], names=["node", "content"])

    rows = docs.join(ids, docs["doc_id"].eqNullSafe(ids["doc_id"]), "left_semi").select("text")
    return map_arrow(rows, run, "node long, content binary").groupBy("node").agg(F.first("content").alias("content"))


def _contents(raw: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    return np.frombuffer(b"".join(raw), np.uint64), np.concatenate([[0], np.cumsum([len(x) // 8 for x in raw])]).astype(np.int64)


def reached(sketch: np.ndarray, size: np.ndarray, root: np.ndarray, apart: np.ndarray | None, likely: stars.Likely) -> Iterator[tuple[int, np.ndarray]]:
    """(row, rows found from it) of a walk through rows that may be linked and have different roots.

    A row that is found isn't looked at again but as one to look from, so alike rows cost one look at all others.
    apart: for a pair of blocks, which block each row is of: only pairs of one and the other are looked at.
    """
    left = np.ones(len(size), bool)
    for start in range(len(size)):
        if not left[start]:
            continue
        left[start], walk = False, [start]
        while walk:
            i = walk.pop()
            j = np.flatnonzero(left & (root != root[i]) & (apart != apart[i] if apart is not None else True))
            if not len(j):
                continue
            at = np.full(len(j), i)
            found = j[likely(sketch[at], size[at], sketch[j], size[j])]
            if len(found):
                left[found] = False
                walk += found.tolist()
                yield i, found


def _groups(pairs: DataFrame, sized: DataFrame, share: int) -> DataFrame:
    """node, root of groups outside of which no row has a partner."""
    likely = _likely(share)
    near = _sifted(stars.with_both(written(stars.pairs_of(pairs), "pairs"), sized), share).select("u", "v")
    roots = components(map_arrow(near, joined, "u long, v long"), "groups")
    held = stars._open(pairs, roots).withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).drop("n").join(sized, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in stars.whole_groups(batches, 3):
            names = rows.column("node").combine_chunks()
            root = rows.column("root").combine_chunks().dictionary_encode()
            root = (root.combine_chunks() if isinstance(root, pa.ChunkedArray) else root).indices.to_numpy()
            sketch, size, block = stars.matrix(rows.column("sketch").combine_chunks()), rows.column("size").to_numpy(), rows.column("block").to_numpy()
            across = (rows.column("lo").to_numpy() != rows.column("hi").to_numpy())[starts]
            u, v = [], []
            for a, b, two in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], across.tolist(), strict=True):
                if b - a > 1:
                    for i, found in reached(sketch[a:b], size[a:b], root[a:b], block[a:b] if two else None, likely):
                        u.append(np.full(len(found), a + i))
                        v.append(a + found)
            if u:
                yield pa.RecordBatch.from_arrays([names.take(pa.array(np.concatenate(x))) for x in (u, v)], names=["u", "v"])

    columns = ["bucket", "lo", "hi", "block", "node", "root", "size", "sketch"]
    more = map_arrow(stars._blocked(held).select(columns), lambda batches: joined(run(batches)), "u long, v long")
    return merged(roots, _of_roots(more, roots))


def _of_roots(links: DataFrame, roots: DataFrame) -> DataFrame:
    """Links between nodes as links between their roots, or themselves if they have none."""
    links = written(links, "more")
    named = lambda end: few(roots, 48).select(F.col("node").alias(end), F.col("root").alias(f"r{end}"))
    both = links.join(named("u"), "u", "left").join(named("v"), "v", "left")
    return both.select(F.coalesce("ru", "u").alias("u"), F.coalesce("rv", "v").alias("v"))


def product(flat: np.ndarray, bounds: np.ndarray, apart: np.ndarray | None, share: int, guest: np.ndarray | None = None) -> list[tuple[int, int]]:
    """Links between rows of a block, those that join something; apart: as in reached(). Two guests aren't compared: they are at home elsewhere."""
    size = np.diff(bounds)
    owner = np.repeat(np.arange(len(size)), size)
    order = np.argsort(flat, kind="stable")
    column, row = flat[order], owner[order]
    new = np.append(True, column[1:] != column[:-1])[: len(column)]
    number = np.cumsum(new) - 1
    shared = np.bincount(number, minlength=1)[number] > 1  # a column that one row alone has adds nothing
    row, number = row[shared], (np.cumsum(new[shared]) - 1 if shared.any() else number[shared])
    wide = -(-min(COLUMNS, int(number.max(initial=0)) + 1) // 64) * 64
    parts = []
    for at in range(0, int(number.max(initial=0)) + 1, wide):
        here = (number >= at) & (number < at + wide)
        bits = np.zeros((len(size), wide), bool)
        bits[row[here], number[here] - at] = True
        parts.append(np.packbits(bits, axis=1).view(np.uint64))
    label, out = np.arange(len(size)), []
    for i in range(len(size)):
        j = i + 1 + np.flatnonzero(label[i + 1 :] != label[i])
        j = j[100 * np.minimum(size[i], size[j]) >= share * np.maximum(size[i], size[j])]
        if apart is not None:
            j = j[apart[j] != apart[i]]
        if guest is not None and guest[i]:
            j = j[~guest[j]]
        if not len(j):
            continue
        common = np.zeros(len(j), np.int64)
        for bits in parts:
            step = max(1, BLOCK_BYTES // (8 * bits.shape[1]))
            for at in range(0, len(j), step):
                common[at : at + step] += np.bitwise_count(bits[j[at : at + step]] & bits[i]).sum(axis=1, dtype=np.int64)
        for k in j[100 * common >= share * (size[i] + size[j] - common)].tolist():
            if label[k] != label[i]:
                label[label == label[k]] = label[i]
                out.append((i, k))
    return out


def _links(groups: DataFrame, sized: DataFrame, whole: DataFrame, share: int) -> DataFrame:
    """Links within groups, from the product of each pair of blocks."""
    level = F.floor(F.log(F.col("size").cast("double")) / float(np.log(100 / share)) + 1e-9).cast("int")
    held = groups.select("node", "root").join(sized.select("node", "size"), "node").withColumn("level", level)
    # a row is at home among those of its class of sizes, and a guest in the next one
    places = F.array(F.struct(F.col("level").alias("at"), F.lit(False).alias("guest")), F.struct((F.col("level") + 1).alias("at"), F.lit(True).alias("guest")))
    held = held.select("node", "size", "root", F.explode(places).alias("x")).select("node", "size", F.xxhash64("root", "x.at").alias("bucket"), "x.guest")
    count = held.groupBy("bucket").agg(F.greatest(F.ceil(F.count("*") / BLOCK), F.ceil(F.sum("size") * 8 / BLOCK_BYTES)).cast("int").alias("blocks"), F.count("*").alias("n"), F.count_if(~F.col("guest")).alias("home"))
    held = held.join(written(count.where("n > 1 AND home > 0").select("bucket", "blocks"), "blocks"), "bucket").join(whole, "node")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in stars.whole_groups(batches, 3):
            names, content = rows.column("node").combine_chunks(), rows.column("content").combine_chunks()
            block, across = rows.column("block").to_numpy(), (rows.column("lo").to_numpy() != rows.column("hi").to_numpy())[starts]
            guest, u, v = rows.column("guest").to_numpy(), [], []
            for a, b, two in zip(starts.tolist(), [*starts[1:].tolist(), len(rows)], across.tolist(), strict=True):
                if b - a > 1 and not guest[a:b].all():
                    for i, j in product(*_contents(content[a:b].to_pylist()), block[a:b] if two else None, share, guest[a:b]):
                        u.append(a + i)
                        v.append(a + j)
            yield pa.RecordBatch.from_arrays([names.take(pa.array(x, pa.int64())) for x in (u, v)], names=["u", "v"])

    return map_arrow(stars._blocked(held).select("bucket", "lo", "hi", "block", "guest", "node", "content"), lambda batches: joined(run(batches)), "u long, v long")


def jaccard_join(docs: DataFrame, words: int = WORDS, share: int = SHARE) -> DataFrame:
    """doc_id, n_shingles, component_id of each row."""
    with scratch() as held:
        return held.keep(written(_joined(docs.select(F.col("doc_id").cast("long"), "text"), words, share), "jaccard-join"))


def _joined(docs: DataFrame, words: int, share: int) -> DataFrame:
    made = written(sketches(docs, words), "sketches")
    rows = made.where("n_shingles IS NOT NULL")
    order = frequencies(made.where("n_shingles IS NULL").select("outline"))
    nodes = rows.where("node IS NOT NULL").groupBy("node").agg(F.min("doc_id").alias("doc_id"), F.first("n_shingles").cast("int").alias("size"), F.first("outline").alias("sketch"))
    nodes = written(nodes.select(F.col("node").alias("digest"), "doc_id", "size", "sketch"), "nodes")
    other = clashes(nodes.select(F.col("digest").alias("node")))
    again = F.coalesce(*(F.when(F.col("digest") == F.lit(k), F.lit(x)) for k, x in other.items()), _id("digest"))
    nodes = nodes.withColumn("node", again)
    sized = nodes.select("node", "size", "sketch")
    pairs = written(stars.shared(_entries(docs, order, other, words, share)), "shared")
    groups = written(_groups(pairs, sized, share), "groups")
    whole = _whole(docs, nodes, groups.select("node"), other, words)
    found = written(components(_links(groups, sized, whole, share)), "found")
    ids = written(nodes.select("node", "doc_id").join(found, "node").groupBy("root").agg(F.min("doc_id").alias("component_id")), "component-ids")
    named_ = nodes.select("digest", "node", "doc_id").join(found, "node", "left").join(ids, "root", "left").select(F.col("digest").alias("node"), F.when(F.col("root").isNull(), F.col("doc_id")).otherwise(F.col("component_id")).alias("component_id"))
    # rows without columns stand apart: they are joined with nothing
    linked = rows.where("node IS NOT NULL").select("doc_id", "n_shingles", "node").join(named_, "node").select("doc_id", "n_shingles", "component_id")
    return linked.unionByName(rows.where("node IS NULL").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def op12_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_join(table(spark, sf_dir, "documents"))
