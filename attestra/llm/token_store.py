"""Token ids in a content-addressed store (operator 1).

Format, all in Parquet under one folder:
- chunks: digest, n, payload, doc_id, row, pos. A rolling hash over the last WINDOW ids cuts each
  document's id stream, so equal passages give equal chunks. A row says that document (doc_id, row)
  has the chunk at pos; exactly one row of each digest holds the payload, the ids as zstd-compressed
  little-endian unsigned integers (16 bits if the vocabulary allows). digest is their sha256.
- recipes: documents in ascending order of doc_id, a file for each range (_part): start (ids of all
  documents before it), n_tokens, chunks in order, and the Merkle root over their digests.
- manifest: for each range, its documents, their ids, and the Merkle root over doc_id, start, n_tokens
  and root of each; with _part -1, the same over all ranges.

Reading holds all of it against the manifest: each chunk against its digest, each document's root made
anew from the chunks read, each range's root and the root over all made anew from the documents. A lost,
damaged or changed chunk, recipe, recipe file or manifest raises an error.

A null text is empty; an empty text has the end id alone. Rows with equal doc_id are documents of
their own, in an arbitrary fixed order; a null doc_id comes first. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from .bytepair import PackedIds, classes, eights, library_encoder
from .common import drop_written, fresh_path, map_arrow, partitions, range_slots, steps, table, text_buffer

FILE = "byte_bpe_50k.json"
END_ID = 2
#: Ids that decide a cut; the mean number of ids between cuts; the least and the most.
WINDOW, MEAN, LEAST, MOST = 8, 2048, 128, 16384
#: Distinct pretokens that a worker remembers.
REMEMBERED = 1_500_000
#: Bytes of text that are handled at once: what that takes fits a core's cache.
STEP = 200_000
#: Digests whose payload a task remembers to have sent.
SENT = 200_000


class Ids(PackedIds):
    """Ids of texts by the tokenizers library, an end id after each."""

    def __init__(self, path: str, end_id: int) -> None:
        tokenizer = Tokenizer.from_file(path)
        classes(tokenizer.pre_tokenizer)
        special = {t.content: i for i, t in tokenizer.get_added_tokens_decoder().items()}
        super().__init__(library_encoder(tokenizer), special, max(tokenizer.get_vocab_size(), end_id + 1), REMEMBERED, end_id)


_coders: dict[tuple[str, int], Ids] = {}


def coder_of(path: str, end_id: int) -> Ids:
    """A worker's own, which its next tasks use again: what it remembers is bounded."""
    if (path, end_id) not in _coders:
        _coders[path, end_id] = Ids(path, end_id)
    return _coders[path, end_id]


def cuts(ids: np.ndarray, offsets: np.ndarray) -> list[list[int]]:
    """Positions in `ids` at which each document's chunks end."""
    n = len(ids)
    marked = np.flatnonzero((eights(ids) % np.uint64(MEAN)) == 0) + WINDOW
    lo, hi = np.searchsorted(marked, offsets[:-1] + LEAST), np.searchsorted(marked, offsets[1:] - LEAST)
    out = []
    for i in range(len(offsets) - 1):
        at, to, found = int(offsets[i]), int(offsets[i + 1]), []
        for m in [*marked[lo[i] : hi[i]].tolist(), to]:
            while m - at > MOST:
                at += MOST
                found.append(at)
            if m - at >= LEAST or m == to:
                at = m
                found.append(at)
        out.append(found)
    return out


def chunk_rows(docs: DataFrame, path: str, end_id: int) -> DataFrame:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder, squeeze, sent = coder_of(path, end_id), zstandard.ZstdCompressor(1), set()
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            keys = batch.column(0).to_pylist()
            for a, b in steps(offsets, STEP):
                ids, bounds = coder.of(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                out: list[list] = [[] for _ in range(6)]
                for i, ends in enumerate(cuts(ids, bounds)):
                    at = int(bounds[i])
                    for pos, to in enumerate(ends):
                        raw = ids[at:to].tobytes()
                        digest = hashlib.sha256(raw).digest()
                        payload = None
                        if digest not in sent:
                            if len(sent) >= SENT:
                                sent.clear()
                            sent.add(digest)
                            payload = squeeze.compress(raw)
                        for column, x in zip(out, (digest, to - at, payload, keys[a + i], row, pos), strict=True):
                            column.append(x)
                        at = to
                    row += 1
                kinds = (pa.binary(), pa.int32(), pa.binary(), pa.int64(), pa.int64(), pa.int32())
                yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(out, kinds, strict=True)], names=["digest", "n", "payload", "doc_id", "row", "pos"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "digest binary, n int, payload binary, doc_id long, row long, pos int")


def merkle(leaves: list[bytes]) -> bytes:
    """Root of the tree whose nodes hash two nodes below; an odd one goes up as it is."""
    level = [hashlib.sha256(b"\0" + x).digest() for x in leaves]
    while len(level) > 1:
        level = [hashlib.sha256(b"\1" + b"".join(level[i : i + 2])).digest() if i + 1 < len(level) else level[i] for i in range(0, len(level), 2)]
    return level[0] if level else hashlib.sha256(b"").digest()


class Tree:
    """The same root from leaves that come one after the other, with a node for each level at most."""

    def __init__(self) -> None:
        self.peaks: list[tuple[int, bytes]] = []

    def push(self, leaf: bytes) -> None:
        level, node = 0, hashlib.sha256(b"\0" + leaf).digest()
        while self.peaks and self.peaks[-1][0] == level:
            node = hashlib.sha256(b"\1" + self.peaks.pop()[1] + node).digest()
            level += 1
        self.peaks.append((level, node))

    def root(self) -> bytes:
        if not self.peaks:
            return hashlib.sha256(b"").digest()
        out = self.peaks[-1][1]
        for _, node in reversed(self.peaks[:-1]):
            out = hashlib.sha256(b"\1" + node + out).digest()
        return out


def _rooted(df: DataFrame, schema: str) -> DataFrame:
    """df with the column root, the Merkle root over the array column `digests`."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = [merkle(x) for x in batch.column(batch.schema.get_field_index("digests")).to_pylist()]
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(found, pa.binary())], names=[*batch.schema.names, "root"])

    return map_arrow(df, run, schema)


def _leaf(*numbers: int | None) -> bytes:
    return b"".join(b"-" if x is None else b"%d" % x + b"," for x in numbers)


def _manifest(recipes: DataFrame) -> list[tuple[int, int, int, bytes]]:
    """_part, documents, ids, root of each range of recipes, and of all as _part -1; as many rows as there are recipe files."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        out, at, n, ids, tree = [], None, 0, 0, Tree()
        for batch in batches:
            for part, key, start, size, root in zip(*(batch.column(c).to_pylist() for c in ("_part", "doc_id", "start", "n_tokens", "root")), strict=True):
                if part != at:
                    if n:
                        out.append((at, n, ids, tree.root()))
                    at, n, ids, tree = part, 0, 0, Tree()
                n, ids = n + 1, ids + size
                tree.push(_leaf(key, start, size) + root)
        if n:
            out.append((at, n, ids, tree.root()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(zip(*out, strict=True) if out else [()] * 4, (pa.int32(), pa.int64(), pa.int64(), pa.binary()), strict=True)], names=["_part", "documents", "ids", "root"])

    rows = recipes.select("_part", "doc_id", "row", "start", "n_tokens", "root").repartition(partitions(recipes.sparkSession), "_part").sortWithinPartitions("_part", "start", "doc_id", "row")
    found = sorted((r._part, r.documents, r.ids, bytes(r.root)) for r in map_arrow(rows, run, _MANIFEST).collect())
    whole = Tree()
    for part, n, ids, root in found:
        whole.push(_leaf(part, n, ids) + root)
    return [(-1, sum(r[1] for r in found), sum(r[2] for r in found), whole.root()), *found]


_MANIFEST = "_part int, documents long, ids long, root binary"


def write_store(docs: DataFrame, to: str, path: str, end_id: int = END_ID) -> None:
    """Encode every text and write the store.

    Only rows that hold a payload are brought together by digest, at most one from each task
    (or from each SENT chunks of it): a chunk that a third of all documents share is no hot key.
    """
    spark = docs.sparkSession
    rows = chunk_rows(docs, path, end_id)
    key = F.when(F.col("payload").isNotNull(), F.col("digest")).otherwise(F.concat(F.lit(b"-"), F.encode(F.concat_ws("-", "row", "pos"), "utf-8")))
    first = F.row_number().over(Window.partitionBy("_key").orderBy("row", "pos")) == 1
    once = rows.withColumn("_key", key).withColumn("payload", F.when(first, F.col("payload")))
    once.drop("_key").write.option("compression", "uncompressed").parquet(f"{to}/chunks")
    refs = spark.read.parquet(f"{to}/chunks").select("doc_id", "row", "pos", "n", "digest")
    recipes = refs.groupBy("doc_id", "row").agg(F.sum("n").cast("long").alias("n_tokens"), F.array_sort(F.collect_list(F.struct("pos", "n", "digest"))).alias("chunks"))
    recipes = recipes.withColumn("digests", F.col("chunks.digest"))
    ordered = range_slots(recipes, ["doc_id", "row"], "recipes")
    kinds = "doc_id long, row long, n_tokens long, chunks array<struct<pos:int,n:int,digest:binary>>, digests array<binary>, _part int"
    # as many rows as there are files
    sums = ordered.groupBy("_part").agg(F.sum("n_tokens").alias("ids")).withColumn("before", F.sum("ids").over(Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    running = Window.partitionBy("_part").orderBy("doc_id", "row").rowsBetween(Window.unboundedPreceding, -1)
    placed = _rooted(ordered, f"{kinds}, root binary").join(sums.select("_part", "before"), "_part")
    placed = placed.withColumn("start", F.coalesce("before", F.lit(0)) + F.coalesce(F.sum("n_tokens").over(running), F.lit(0)))
    final = placed.select("_part", "doc_id", "row", "start", "n_tokens", "chunks", "root").repartitionByRange(partitions(spark), "_part").sortWithinPartitions("_part", "doc_id", "row")
    final.write.parquet(f"{to}/recipes")
    drop_written(spark, ordered)
    spark.createDataFrame(_manifest(spark.read.parquet(f"{to}/recipes")), _MANIFEST).coalesce(1).write.parquet(f"{to}/manifest")


def checked_recipes(spark: SparkSession, at: str) -> DataFrame:
    """The recipes, held against the manifest."""
    recipes = spark.read.parquet(f"{at}/recipes")
    said = sorted((r._part, r.documents, r.ids, bytes(r.root)) for r in spark.read.parquet(f"{at}/manifest").collect())
    if said != _manifest(recipes):
        raise ValueError(f"the recipes in {at} aren't those of its manifest")
    return recipes


def _unpack(digest: bytes, payload: bytes | None, n: int) -> np.ndarray:
    """The ids of a chunk, held against its digest."""
    if payload is None:
        raise ValueError(f"chunk {digest.hex()} is missing")
    raw = zstandard.decompress(payload)
    if hashlib.sha256(raw).digest() != digest or len(raw) not in (2 * n, 4 * n):
        raise ValueError(f"chunk {digest.hex()} is damaged")
    return np.frombuffer(raw, np.uint16 if len(raw) == 2 * n else np.uint32)


def checked_chunks(spark: SparkSession, at: str) -> DataFrame:
    """digest, crc, bytes of every stored chunk, each read back whole and held against its digest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            digests, found = batch.column(0).to_pylist(), []
            for digest, n, payload in zip(digests, batch.column(1).to_pylist(), batch.column(2).to_pylist(), strict=True):
                found.append(zlib.crc32(_unpack(digest, payload, n).astype("<u4")))
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, pa.int64())], names=["digest", "crc"])

    return map_arrow(spark.read.parquet(f"{at}/chunks").where("payload IS NOT NULL").select("digest", "n", "payload"), run, "digest binary, crc long")


def _shift_tables() -> list[np.ndarray]:
    """For each k, tables that carry a crc32 over 2**k zero bytes."""
    column = [1 << i for i in range(32)]
    # one zero bit, then doubled
    step = [0xEDB88320 if i == 0 else 1 << (i - 1) for i in range(32)]

    def apply(matrix: list[int], x: int) -> int:
        out = 0
        for i in range(32):
            if x >> i & 1:
                out ^= matrix[i]
        return out

    tables = []
    for k in range(3 + 44):
        if k >= 3:
            tables.append(np.array([[apply(step, v << (8 * j)) for v in range(256)] for j in range(4)], np.uint32))
        step = [apply(step, step[i]) for i in range(len(column))]
    return tables


_shifts: list[np.ndarray] = []


def crc_join(first: np.ndarray, second: np.ndarray, length: np.ndarray) -> np.ndarray:
    """crc32 of two byte strings end to end, from the crc32 of each and the second's length."""
    if not _shifts:
        _shifts.extend(_shift_tables())
    out = first.astype(np.uint32)
    for k, t in enumerate(_shifts):
        on = (length >> k) & 1 == 1
        if on.any():
            x = out[on]
            out[on] = t[0][x & 255] ^ t[1][x >> 8 & 255] ^ t[2][x >> 16 & 255] ^ t[3][x >> 24]
    return out ^ second.astype(np.uint32)


def read_digests(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start, n_tokens and ids_crc32 of each document, from the files alone.

    Every stored chunk is read once and held against its digest; every document's root is made
    anew from the chunks found and held against its recipe, recipes against the manifest. Both sides of
    the join by digest are plain tables, so a chunk that many documents share is dealt over several
    tasks as Spark does with skewed keys.
    """
    recipes = checked_recipes(spark, at)
    refs = recipes.select("doc_id", "row", "start", "n_tokens", "root", F.explode("chunks").alias("c")).select("doc_id", "row", "start", "n_tokens", "root", "c.*")
    joined = refs.join(checked_chunks(spark, at), "digest", "left")
    whole = joined.groupBy("doc_id", "row").agg(F.max("start").alias("start"), F.max("n_tokens").alias("n_tokens"), F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("pos", "n", "digest", "crc"))).alias("chunks"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keys, start, n_tokens, root, chunks = (batch.column(i) for i in range(5))
            crcs, offsets = np.zeros(len(keys), np.uint32), chunks.offsets.to_numpy().astype(np.int64)
            flat = chunks.flatten()
            if flat.field("crc").null_count:
                raise ValueError(f"chunk {flat.field('digest').filter(flat.field('crc').is_null())[0].as_py().hex()} is missing")
            crc, n, digest = flat.field("crc").to_numpy(zero_copy_only=False), flat.field("n").to_numpy(zero_copy_only=False), flat.field("digest").to_pylist()
            offsets = offsets - offsets[0]
            for i, want in enumerate(root.to_pylist()):
                if merkle(digest[offsets[i] : offsets[i + 1]]) != want or n[offsets[i] : offsets[i + 1]].sum() != n_tokens[i].as_py():
                    raise ValueError(f"document {keys[i]} can't be put together")
            for j in range(int(np.diff(offsets).max(initial=0))):
                live = np.flatnonzero(offsets[1:] - offsets[:-1] > j)
                k = offsets[live] + j
                crcs[live] = crc_join(crcs[live], crc[k], n[k].astype(np.int64) * 4)
            yield pa.RecordBatch.from_arrays([keys, start, n_tokens, pa.array(crcs.astype(np.int64))], names=["doc_id", "start", "n_tokens", "ids_crc32"])

    return map_arrow(whole.select("doc_id", "start", "n_tokens", "root", "chunks"), run, "doc_id long, start long, n_tokens long, ids_crc32 long")


def read_ids(spark: SparkSession, at: str) -> DataFrame:
    """doc_id, start and the ids of each document."""
    stored = spark.read.parquet(f"{at}/chunks").where("payload IS NOT NULL").select("digest", "payload")
    refs = checked_recipes(spark, at).select("doc_id", "row", "start", "root", F.explode("chunks").alias("c")).select("doc_id", "row", "start", "root", "c.*")
    whole = refs.join(stored, "digest", "left").groupBy("doc_id", "row", "start").agg(F.first("root").alias("root"), F.array_sort(F.collect_list(F.struct("pos", "n", "digest", "payload"))).alias("x"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ids = []
            for key, want, x in zip(batch.column(0).to_pylist(), batch.column(3).to_pylist(), batch.column(2).to_pylist(), strict=True):
                ids.append(np.concatenate([_unpack(c["digest"], c["payload"], c["n"]) for c in x]).astype(np.int64))
                if merkle([c["digest"] for c in x]) != want:
                    raise ValueError(f"document {key} can't be put together")
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(ids, pa.list_(pa.int64()))], names=["doc_id", "start", "ids"])

    return map_arrow(whole.select("doc_id", "start", "x", "root"), run, "doc_id long, start long, ids array<long>")


def op1_token_store(spark: SparkSession, sf_dir: str) -> DataFrame:
    at = fresh_path(spark, "token-store")
    write_store(table(spark, sf_dir, "documents"), at, public_tokenizers.path(FILE))
    return read_digests(spark, at)
