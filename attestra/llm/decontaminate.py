"""Benchmark decontamination by winnowing (operator 8).

Of every LENGTH consecutive words, the least k-word hash is a fingerprint, in documents and in
benchmark items alike. Two texts that share LENGTH words share a fingerprint there, so documents'
fingerprints are looked up among the items' ones; around each one found, the windows of LENGTH words
that hold it are held against the items' windows, and all words of those that occur are hit. Items
of fewer words, which winnowing doesn't guarantee, are windows looked up at every position.

The items' index goes to all executors if the items are at most INDEX_BYTES of text; beyond that,
fingerprints and windows are joined as tables. Windows are told apart by 64-bit hashes of whole words.

A null or wordless text has no words and isn't contaminated; a wordless item occurs nowhere. Rows
with equal doc_id are documents of their own; items with equal item_id count as one, those without
an id count under the empty id. An empty benchmark hits nothing. Extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, map_arrow, steps, table, text_buffer, written
from .textvec import ALPHANUMERIC, gram_hashes, inside_text, words

#: Words of a window; words that a fingerprint's hash covers.
LENGTH, K = 10, 5
#: Text of items up to which their index, of some 20 bytes for each word, is sent to all executors.
INDEX_BYTES = 8_000_000
RESULT = "doc_id long, n_words long, n_hit long, n_items long, items_sha256 string, contaminated boolean"


def fingerprints(hashes: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Positions and k-gram hashes of the fingerprints of texts laid end to end; ties go to the last."""
    grams, w = gram_hashes(hashes, K), LENGTH - K + 1
    n = len(hashes) - LENGTH + 1
    if n <= 0:
        return np.zeros(0, np.int64), np.zeros(0, np.uint64)
    coded = grams & ~np.uint64(7)
    least = coded[:n] | np.uint64(w - 1)
    for j in range(1, w):
        np.minimum(least, coded[j : n + j] | np.uint64(w - 1 - j), out=least)
    chosen = np.arange(n) + (w - 1) - (least & np.uint64(7)).astype(np.int64)
    mark = np.zeros(len(hashes), bool)
    mark[chosen[inside_text(bounds, LENGTH, n)]] = True
    at = np.flatnonzero(mark)
    return at, grams[at]


class Index:
    """Fingerprints of items, and the items of each window, by window length, all in flat arrays."""

    def __init__(self, items: list[tuple[str, str]]) -> None:
        self.names = sorted({key for key, _ in items})
        number = {key: i for i, key in enumerate(self.names)}
        data, offsets = text_buffer(pa.array([t for _, t in items], pa.large_string()))
        _, _, hashes, bounds = words(data, offsets, ALPHANUMERIC)
        self.prints = np.unique(fingerprints(hashes, bounds)[1])
        owner = np.array([number[key] for key, _ in items], np.int32)
        size = np.diff(bounds)
        #: Of each window length: distinct windows, where their items begin, and the items' numbers.
        self.windows: dict[int, np.ndarray] = {}
        self.begins: dict[int, np.ndarray] = {}
        self.items: dict[int, np.ndarray] = {}
        for k in sorted({int(min(LENGTH, n)) for n in size if n}):
            grams = gram_hashes(hashes, k)
            mine = np.repeat(np.where(np.minimum(size, LENGTH) == k, owner, -1), size)[: len(grams)]
            keep = inside_text(bounds, k, len(grams)) & (mine >= 0)
            grams, mine = grams[keep], mine[keep]
            order = np.lexsort((mine, grams))
            grams, mine = grams[order], mine[order]
            new = np.append(True, (grams[1:] != grams[:-1]) | (mine[1:] != mine[:-1]))
            grams, mine = grams[new], mine[new]
            first = np.flatnonzero(np.append(True, grams[1:] != grams[:-1]))
            self.windows[k], self.begins[k], self.items[k] = grams[first], np.append(first, len(grams)), mine
        self.near = {k: self._near(x) for k, x in (*self.windows.items(), (0, self.prints))}

    def of(self, k: int, window: int) -> list[str]:
        """The ids of the items that have a window, by its number."""
        a, b = self.begins[k][window : window + 2]
        return [self.names[i] for i in self.items[k][a:b]]

    @staticmethod
    def _near(hashes: np.ndarray) -> np.ndarray:
        """A table by some bits of a hash, to rule most others out."""
        bits = max(16, min(24, 3 + len(hashes).bit_length()))
        table = np.zeros(1 << bits, bool)
        table[(hashes >> np.uint64(64 - bits)).astype(np.int64)] = True
        return table

    def find(self, kind: int, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(positions in `hashes` that are known, their numbers); kind: a window length, or 0 for fingerprints."""
        known = self.prints if kind == 0 else self.windows[kind]
        near = self.near[kind]
        maybe = np.flatnonzero(near[(hashes >> np.uint64(64 - (len(near).bit_length() - 1))).astype(np.int64)])
        if not len(known) or not len(maybe):
            return maybe[:0], maybe[:0]
        at = np.minimum(np.searchsorted(known, hashes[maybe]), len(known) - 1)
        same = known[at] == hashes[maybe]
        return maybe[same], at[same]


def around(at: np.ndarray, bounds: np.ndarray, n_words: int) -> np.ndarray:
    """Starts of all windows that hold a fingerprint at one of the positions and lie in one text."""
    starts = np.unique((at[:, None] - np.arange(LENGTH - K + 1)[None, :]).ravel())
    n = n_words - LENGTH + 1
    starts = starts[(starts >= 0) & (starts < n)]
    return starts[inside_text(bounds, LENGTH, n)[starts]] if n > 0 else starts[:0]


def occurring(hashes: np.ndarray, bounds: np.ndarray, index: Index) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
    """(window length, starts, numbers of windows) of all windows of items that occur."""
    for k in index.windows:
        if k == LENGTH:
            at, prints = fingerprints(hashes, bounds)
            starts = around(at[index.find(0, prints)[0]], bounds, len(hashes))
            if len(starts):
                grams = gram_hashes(hashes, LENGTH)[starts]
                where, numbers = index.find(LENGTH, grams)
                yield LENGTH, starts[where], numbers
        elif len(hashes) >= k:
            grams = gram_hashes(hashes, k)
            where, numbers = index.find(k, grams)
            keep = inside_text(bounds, k, len(grams))[where]
            yield k, where[keep], numbers[keep]


def _digest(items: set[str]) -> str:
    return hashlib.sha256(",".join(sorted(items)).encode()).hexdigest()


def _result(keys: pa.Array, n_words: np.ndarray, n_hit: np.ndarray, items: list[set[str]]) -> pa.RecordBatch:
    none = _digest(set())
    columns = [keys.cast(pa.int64()), pa.array(n_words.astype(np.int64)), pa.array(n_hit.astype(np.int64)), pa.array([len(x) for x in items], pa.int64()), pa.array([_digest(x) if x else none for x in items]), pa.array(n_hit > 0)]
    return pa.RecordBatch.from_arrays(columns, names=[x.split()[0] for x in RESULT.split(", ")])


def _hits(texts: pa.Array, index: Index) -> Iterator[tuple[int, int, np.ndarray, np.ndarray, list[set[str]]]]:
    """(from, to, words, words hit, items) of the texts of a batch, step by step."""
    data, offsets = text_buffer(texts)
    for a, b in steps(offsets):
        _, _, hashes, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALPHANUMERIC)
        hit = np.zeros(len(hashes) + 1, np.int32)
        items: list[set[str]] = [set() for _ in range(b - a)]
        for k, starts, numbers in occurring(hashes, bounds, index):
            np.add.at(hit, starts, 1)
            np.add.at(hit, starts + k, -1)
            for i, x in set(zip((np.searchsorted(bounds, starts, side="right") - 1).tolist(), numbers.tolist(), strict=True)):
                items[i].update(index.of(k, x))
        total = np.zeros(len(hashes) + 1, np.int64)
        np.cumsum(np.cumsum(hit[:-1]) > 0, out=total[1:])
        yield a, b, np.diff(bounds), np.diff(total[bounds]), items


def _by_index(docs: DataFrame, index: Index) -> DataFrame:
    shared = docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for a, b, n_words, n_hit, items in _hits(batch.column(1), shared.value):
                yield _result(batch.column(0)[a:b], n_words, n_hit, items)

    return map_arrow(docs, run, RESULT)


def _index_of(items: DataFrame, index_bytes: int) -> Index | None:
    """The items' index, if they are at most index_bytes of text."""
    if (items.agg(F.sum(F.octet_length("text") + 16)).first()[0] or 0) > index_bytes:
        return None
    return Index([(r.id or "", r.text or "") for r in items.collect()])


def _items(benchmark: DataFrame) -> DataFrame:
    return benchmark.select(F.col("item_id").cast("string").alias("id"), F.col("text").alias("text"))


def clean(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """The rows of docs, with all their columns, in which no window of an item occurs."""
    items = _items(benchmark)
    if (index := _index_of(items, index_bytes)) is None:
        name = "_row"
        while name in docs.columns:
            name = f"_{name}"
        rows = written(docs.withColumn(name, F.monotonically_increasing_id()), "rows")
        lost = written(_by_join(rows.select(F.col(name).alias("doc_id"), "text"), items).where("contaminated").select(F.col("doc_id").alias(name)), "lost")
        return rows.join(few(lost, 16), name, "left_anti").drop(name)
    at, shared = docs.columns.index("text"), docs.sparkSession.sparkContext.broadcast(index)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            keep = [n_hit == 0 for _, _, _, n_hit, _ in _hits(batch.column(at), shared.value)]
            yield batch.filter(pa.array(np.concatenate([*keep, np.zeros(0, bool)])))

    return docs.mapInArrow(run, docs.schema)


def _windows(df: DataFrame, lengths: list[int] | None) -> DataFrame:
    """doc_id, row, n_words and probes of each text: at (start), k (length), print (a fingerprint in it; its own hash if short), window.

    With lengths, windows of LENGTH around fingerprints and of those lengths everywhere; without,
    the windows of an item.
    """
    schema = "id string, row long, n_words long, probes array<struct<at:int,k:int,print:long,window:long>>"

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        row = TaskContext.get().partitionId() << 36
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets):
                _, _, hashes, bounds = words(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], ALPHANUMERIC)
                at, prints = fingerprints(hashes, bounds)
                tens, out = gram_hashes(hashes, LENGTH).view(np.int64), []
                for lo, hi in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
                    found = []
                    x, y = np.searchsorted(at, (lo, hi))
                    for p, h in zip(at[x:y].tolist(), prints[x:y].view(np.int64).tolist(), strict=True):
                        found += [(s - lo, LENGTH, h, int(tens[s])) for s in range(max(lo, p - LENGTH + K), min(p, hi - LENGTH) + 1)]
                    for k in lengths if lengths is not None else [hi - lo] if 0 < hi - lo < LENGTH else []:
                        if k <= hi - lo:
                            found += [(j, k, h, h) for j, h in enumerate(gram_hashes(hashes[lo:hi], k).view(np.int64).tolist())]
                    out.append([dict(zip(("at", "k", "print", "window"), f, strict=True)) for f in found])
                kind = pa.list_(pa.struct([("at", pa.int32()), ("k", pa.int32()), ("print", pa.int64()), ("window", pa.int64())]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b].cast(pa.string()), pa.array(range(row, row + b - a), pa.int64()), pa.array(np.diff(bounds)), pa.array(out, kind)], names=["id", "row", "n_words", "probes"])
                row += b - a

    return map_arrow(df, run, schema)


def _by_join(docs: DataFrame, items: DataFrame) -> DataFrame:
    of_items = written(_windows(items, None).select(F.coalesce("id", F.lit("")).alias("item"), F.explode("probes").alias("p")).select("item", "p.k", "p.print", "p.window").distinct(), "item-windows")
    lengths = [r.k for r in of_items.where(F.col("k") < LENGTH).select("k").distinct().collect()]  # fewer than LENGTH rows
    probed = written(_windows(docs, lengths), "doc-windows")
    probes = probed.select("row", F.explode("probes").alias("p")).select("row", "p.*")
    probes = probes.join(of_items.select("k", "print").distinct(), ["k", "print"], "left_semi")
    hits = probes.join(of_items.select("item", "k", "window").distinct(), ["k", "window"])
    hits = hits.groupBy("row").agg(F.collect_set(F.struct("at", "k")).alias("spans"), F.collect_set("item").alias("items"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_hit = [len({x for s in spans or () for x in range(s["at"], s["at"] + s["k"])}) for spans in batch.column(2).to_pylist()]
            yield _result(batch.column(0), batch.column(1).to_numpy(), np.array(n_hit, np.int64), [set(x or ()) for x in batch.column(3).to_pylist()])

    return map_arrow(probed.select(F.col("id").cast("long").alias("doc_id"), "n_words", "row").join(hits, "row", "left").select("doc_id", "n_words", "spans", "items"), run, RESULT)


def contamination(docs: DataFrame, benchmark: DataFrame, index_bytes: int = INDEX_BYTES) -> DataFrame:
    """Per document: its words, those hit, the items whose windows occur."""
    docs, items = docs.select(F.col("doc_id").cast("long"), "text"), _items(benchmark)
    index = _index_of(items, index_bytes)
    return _by_join(docs, items) if index is None else _by_index(docs, index)


def op8_decontaminate(spark: SparkSession, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))
