"""Quality classifier: gradient-boosted trees on histograms of document statistics (operator 6).

Statistics of a whole text (shares of kinds of characters, lengths of words and lines, repetition)
are binned by quantiles; each tree is grown level by level from histograms of gradients, and all
trees are laid out in arrays that numpy walks for a batch of documents at once.

Labels are learnt from at most FIT_ROWS documents: those labelled rows, of ids that aren't held out,
whose doc_id has the least hash. That is the one bound; every document is scored. Inputs of a score
are the text's statistics alone.

A null or empty text has statistics of zero and is scored like any other. Labels that are null or
neither 0 nor 1 are left out; of conflicting labels of a doc_id, the least holds. With labels of
one kind only, or none, every score is that kind's, or 0.5. Rows with equal doc_id are scored each;
a null doc_id isn't held out. Extra columns are ignored.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import map_arrow, steps, table, text_buffer
from .textvec import BY_SPACE, span_hashes, words

FIT_ROWS = 20_000
TREES, DEPTH, BINS, RATE, L2, LEAST_WEIGHT = 120, 4, 64, 0.12, 1.0, 5.0

#: Kinds of bytes whose share of a text counts.
KINDS = {
    "upper": range(65, 91),
    "lower": range(97, 123),
    "digit": range(48, 58),
    "space": [32],
    "line": [10],
    "stop": [46, 63],
    "exclaim": [33],
    "comma": [44, 58, 59],
    "pipe": [124],
    "symbol": [35, 36, 37, 38, 42, 43, 61, 64, 94, 95, 96, 126],
    "bracket": [40, 41, 60, 62, 91, 93, 123, 125],
    "quote": [34, 39],
    "slash": [45, 47, 92],
    "high": range(128, 256),
    "control": [*range(9), *range(11, 32), 127],
}
NAMES = [*KINDS, "log_bytes", "log_words", "word_mean", "word_sd", "word_max", "distinct_words", "top_word", "again", "line_mean", "distinct_lines", "short_lines", "ends_with_stop", "plain_words", "caps_words"]
_kind_of = np.full(256, len(KINDS), np.uint8)
for _i, _bytes in enumerate(KINDS.values()):
    _kind_of[list(_bytes)] = _i
_plain = np.zeros(256, bool)
_plain[[*range(65, 91), *range(97, 123), *range(128, 256)]] = True


def statistics(data: np.ndarray, offsets: np.ndarray) -> np.ndarray:
    """A row of statistics for each text."""
    n, size = len(offsets) - 1, np.diff(offsets)
    some = np.maximum(size, 1)
    out = np.zeros((n, len(NAMES)), np.float64)
    doc = np.repeat(np.arange(n), size)
    kinds = np.bincount(doc * (len(KINDS) + 1) + _kind_of[data], minlength=n * (len(KINDS) + 1)).reshape(n, -1)
    out[:, : len(KINDS)] = kinds[:, :-1] / some[:, None]
    starts, ends, hashes, bounds = words(data, offsets, BY_SPACE)
    count = np.diff(bounds)
    lengths = (ends - starts).astype(np.float64)
    plain, upper = np.concatenate([[0], np.cumsum(_plain[data])]), np.concatenate([[0], np.cumsum(_kind_of[data] == 0)])
    whole_plain = (plain[ends] - plain[starts]) >= lengths - 1
    caps = (upper[ends] - upper[starts]) * 2 > lengths
    of_word = np.repeat(np.arange(n), count)
    mean = lambda x: np.bincount(of_word, x, minlength=n) / np.maximum(count, 1)
    k = len(KINDS)
    m = mean(lengths)
    out[:, k], out[:, k + 1], out[:, k + 2] = np.log1p(size), np.log1p(count), m
    out[:, k + 3] = np.sqrt(np.maximum(mean(lengths**2) - m**2, 0))
    line_starts = np.unique(np.concatenate([offsets[:-1][size > 0], np.flatnonzero(data == 10) + 1]))
    line_starts = line_starts[line_starts < len(data)]
    line_ends = np.append(line_starts[1:], len(data))
    line_bounds = np.searchsorted(line_starts, offsets)
    line_hashes = span_hashes(data, line_starts, line_ends)
    line_sizes = line_ends - line_starts
    for i in range(n):
        a, b = bounds[i], bounds[i + 1]
        if b > a:
            x = np.sort(hashes[a:b])
            runs = np.diff(np.flatnonzero(np.concatenate([[True], x[1:] != x[:-1], [True]])))
            out[i, k + 4] = lengths[a:b].max()
            out[i, k + 5], out[i, k + 6] = len(runs) / (b - a), runs.max() / (b - a)
            out[i, k + 7] = (hashes[a + 1 : b] == hashes[a : b - 1]).mean() if b - a > 1 else 0
        a, b = line_bounds[i], line_bounds[i + 1]
        if b > a:
            out[i, k + 8] = np.log1p(line_sizes[a:b].mean())
            out[i, k + 9] = len(np.unique(line_hashes[a:b])) / (b - a)
            out[i, k + 10] = (line_sizes[a:b] < 20).mean()
            out[i, k + 11] = np.isin(data[offsets[i + 1] - 1], (33, 46, 63))
    out[:, k + 12], out[:, k + 13] = mean(whole_plain), mean(caps)
    return out


@dataclass
class Forest:
    """Trees in arrays: node i of tree t splits on feature[t, i] at threshold[t, i], its children are 2i + 1 and 2i + 2, the last level holds the values."""

    feature: np.ndarray
    threshold: np.ndarray
    value: np.ndarray
    base: float

    def score(self, rows: np.ndarray) -> np.ndarray:
        total = np.full(len(rows), self.base)
        each = np.arange(len(rows))
        inner = self.feature.shape[1]
        for t in range(len(self.feature)):
            at = np.zeros(len(rows), np.int64)
            for _ in range(DEPTH):
                at = 2 * at + 1 + (rows[each, self.feature[t, at]] > self.threshold[t, at])
            total += self.value[t, at - inner]
        return 1 / (1 + np.exp(-total))


def fit(rows: np.ndarray, labels: np.ndarray) -> Forest:
    """Boosted trees for the log loss."""
    inner, leaves = 2**DEPTH - 1, 2**DEPTH
    n, width = rows.shape
    rate = (labels.sum() + 0.5) / (len(labels) + 1)
    forest = Forest(np.zeros((TREES, inner), np.int64), np.full((TREES, inner), np.inf), np.zeros((TREES, leaves)), float(np.log(rate / (1 - rate))))
    if n == 0 or labels.min() == labels.max():
        return Forest(forest.feature[:0], forest.threshold[:0], forest.value[:0], 0.0 if n == 0 else forest.base)
    edges = [np.unique(np.quantile(rows[:, f], np.arange(1, BINS) / BINS)) for f in range(width)]
    binned = np.stack([np.searchsorted(e, rows[:, f], side="left") for f, e in enumerate(edges)], axis=1)
    total = np.full(n, forest.base)
    for t in range(TREES):
        p = 1 / (1 + np.exp(-total))
        g, h, at = p - labels, np.maximum(p * (1 - p), 1e-6), np.zeros(n, np.int64)
        for level in range(DEPTH):
            first, wide = 2**level - 1, 2**level
            best, pick = np.full(wide, 1e-6), np.full(wide, -1)
            where = np.zeros(wide, np.int64)
            for f in range(width):
                cell = (at - first) * BINS + binned[:, f]
                sums = [np.cumsum(np.bincount(cell, x, minlength=wide * BINS).reshape(wide, BINS), axis=1) for x in (g, h)]
                gl, hl = sums[0][:, :-1], sums[1][:, :-1]
                gt, ht = sums[0][:, -1:], sums[1][:, -1:]
                gain = gl**2 / (hl + L2) + (gt - gl) ** 2 / (ht - hl + L2) - gt**2 / (ht + L2)
                gain[(hl * 4 < LEAST_WEIGHT) | ((ht - hl) * 4 < LEAST_WEIGHT)] = 0
                gain[:, len(edges[f]) :] = 0
                top = gain.argmax(axis=1)
                better = gain[np.arange(wide), top] > best
                best[better], pick[better], where[better] = gain[np.arange(wide), top][better], f, top[better]
            for i in range(wide):
                if pick[i] >= 0:
                    forest.feature[t, first + i], forest.threshold[t, first + i] = pick[i], edges[pick[i]][where[i]]
            at = 2 * at + 1 + (rows[np.arange(n), forest.feature[t, at]] > forest.threshold[t, at])
        leaf = at - inner
        forest.value[t] = -RATE * np.bincount(leaf, g, minlength=leaves) / (np.bincount(leaf, h, minlength=leaves) + L2)
        total += forest.value[t, leaf]
    return forest


def held_out(key: Column) -> Column:
    return F.coalesce(F.crc32(key.cast("string").cast("binary")) % 3 == 1, F.lit(False))


def learnt(docs: DataFrame, labels: DataFrame, fit_rows: int = FIT_ROWS) -> Forest:
    """A classifier from at most fit_rows labelled documents."""
    usable = labels.where("doc_id IS NOT NULL AND quality IN (0, 1)").where(~held_out(F.col("doc_id"))).select("doc_id", "quality")
    some = usable.groupBy("doc_id").agg(F.min("quality").alias("quality")).orderBy(F.xxhash64("doc_id"), "doc_id").limit(fit_rows)
    picked = {r.doc_id: r.quality for r in some.collect()}  # at most fit_rows
    if not picked:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    ids = docs.sparkSession.createDataFrame([(k,) for k in picked], "doc_id long")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets):
                rows = statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], pa.array(list(rows), pa.list_(pa.float64()))], names=["doc_id", "x"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text").join(F.broadcast(ids), "doc_id", "left_semi"), run, "doc_id long, x array<double>")
    # repeated doc_ids could be more: the first fit_rows in a fixed order
    rows = sorted(found.orderBy(F.xxhash64("doc_id"), "doc_id", F.xxhash64("x")).limit(fit_rows).collect())
    if not rows:
        return fit(np.zeros((0, len(NAMES))), np.zeros(0))
    return fit(np.array([r.x for r in rows]), np.array([picked[r.doc_id] for r in rows], np.float64))


def scored(docs: DataFrame, forest: Forest) -> DataFrame:
    """doc_id, held_out, score, predicted of each row."""
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        forest = shared.value
        for batch in batches:
            data, offsets = text_buffer(batch.column(2))
            for a, b in steps(offsets):
                score = forest.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]))
                yield pa.RecordBatch.from_arrays([batch.column(0)[a:b], batch.column(1)[a:b], pa.array(score), pa.array((score >= 0.5).astype(np.int32))], names=["doc_id", "held_out", "score", "predicted"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), held_out(F.col("doc_id")).alias("held_out"), "text"), run, "doc_id long, held_out boolean, score double, predicted int")


def keep_good(docs: DataFrame, forest: Forest) -> DataFrame:
    """Rows of docs, with all their columns, that aren't predicted 0."""
    at, names = docs.columns.index("text"), docs.columns
    shared = docs.sparkSession.sparkContext.broadcast(forest)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(at))
            good = [shared.value.score(statistics(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])) >= 0.5 for a, b in steps(offsets)]
            yield batch.filter(pa.array(np.concatenate(good))) if good else batch

    return map_arrow(docs.select(names), run, docs.schema)


def op6_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return scored(docs, learnt(docs, table(spark, sf_dir, "labels")))
