"""Fuzzy line dedup by MinHash (operator 3).

Lines are lower-cased (A-Z) with runs of white space made one space. All but empty
ones take part. A line's set is its distinct SHINGLE-character shingles; lines whose sets have a
similarity of SHARE percent or more are linked, equal lines are one. Lines of fewer characters have
no shingles, and are linked with equal ones alone. Of each connected component, the
line that comes first, by doc_id and place, is kept; all others are cut out of their documents.

1. One pass over the texts gives each line a 64-bit id and a MinHash signature: every shingle is hashed
   once and goes to one of BINS bins, whose minima (16 bits of them) are the signature; empty bins borrow
   from others in a fixed order. BANDS groups of ROWS minima are bucket keys. Each task sorts its own
   keys and pairs lines that share one with the first of them, which alone goes on, packed into 12
   bytes, to the partition of the key, where the same is done with those of all tasks.
2. Lines that were paired are read again from one place each, and joined with their pairs. Pairs whose
   signatures agree in too few bins go: DEVIATIONS standard errors below the threshold, as many bins
   counted as the emptier line fills.
3. The others are verified on full sets of shingles. Buckets whose lines remain in different components
   are compared whole, in blocks (stars.py), pairs within a component aside.
4. Components of verified links, by large-star and small-star rounds, and the first place of each.

Keys of 3 of 54 bins in 18 bands miss a pair of similarity 0.75 with a probability of 5e-5, one of
0.9 with 6e-11, if bins are independent. A null text has no lines; an empty text has one empty line, which is kept, as all empty lines
are. Rows of equal doc_id and text are one document, and keep the same lines; a null doc_id comes
first. Extra columns are carried along by deduplicated() and ignored otherwise.
"""

from __future__ import annotations

import re
import zlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from . import stars
from .common import few, map_arrow, partitions, scratch, steps, table, text_buffer, written
from .components import components, joined, merged
from .textvec import eights as grams
from .textvec import mix, span_hashes

#: LEAST_CHARS of 1 leaves out empty lines alone.
LEAST_CHARS, SHINGLE, SHARE = 1, 8, 75
BANDS, ROWS = 18, 3
BINS = BANDS * ROWS
DEVIATIONS = 5
#: Bytes of text that are handled at once: what that takes fits a core's cache.
STEP = 200_000
#: Keys that a task gathers before it pairs them and passes them on.
GATHER = 1_000_000
#: Bytes of stored documents for each partition of keys; bytes of a filter of places.
PART_BYTES, OVER, FILTER_BYTES = 10_000_000, 16, 4_194_304
NONE = np.uint32(0xFFFFFFFF)

_borrow = np.random.default_rng(7).integers(0, BINS, (BINS, 512))


class Lines:
    """Lines of a batch of texts: their normal forms as code points, ids, documents and places."""

    def __init__(self, data: np.ndarray, offsets: np.ndarray) -> None:
        points = np.frombuffer(data.tobytes().decode("utf-8", "replace").encode("utf-32-le", "surrogatepass"), np.uint32)
        bounds = offsets if len(points) == len(data) else offsets - np.searchsorted(np.flatnonzero((data & 0xC0) == 0x80), offsets)
        low = points + ((points - np.uint32(65) < 26).view(np.uint8) << np.uint8(5))
        white = (points == 32) | ((points - np.uint32(9) < 5) & (points != 10))
        low[white] = 32
        again = np.flatnonzero(white[1:] & white[:-1]) + 1  # white space after white space
        if len(again):
            low = np.delete(low, again)
            bounds = bounds - np.searchsorted(again, bounds)
        self.points = low
        breaks = np.flatnonzero(self.points == 10)
        starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
        ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
        counts = np.diff(np.searchsorted(breaks, bounds)) + 1
        self.doc = np.repeat(np.arange(len(counts)), counts)
        self.first = np.concatenate([[0], np.cumsum(counts)])
        if len(self.points):
            starts = starts + ((starts < ends) & (self.points[np.minimum(starts, len(self.points) - 1)] == 32))
            ends = ends - ((ends > starts) & (self.points[np.maximum(ends - 1, 0)] == 32))
        self.starts, self.ends = starts, ends
        self.long = ends - starts >= max(LEAST_CHARS, SHINGLE)
        self.ids = np.zeros(len(starts), np.uint64)
        some = ends - starts >= LEAST_CHARS
        if some.any():
            h = span_hashes(self.points, starts[some], ends[some])
            self.ids[some] = np.where(h == 0, np.uint64(1), h)
        self.grams = grams(self.points)

    def signatures(self, some: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Rows of BINS minima for the lines numbered in `some`, all long, and how many bins each fills itself."""
        sizes = self.ends[some] - self.starts[some] - SHINGLE + 1
        before = np.concatenate([[0], np.cumsum(sizes)])
        at = np.repeat(self.starts[some] - before[:-1], sizes)
        at += np.arange(before[-1])
        h = self.grams[at]
        cell = (((h >> np.uint64(40)) * np.uint64(BINS)) >> np.uint64(24)).astype(np.int64)
        cell += np.repeat(np.arange(len(some)) * BINS, sizes)
        out = np.full(len(some) * BINS, NONE, np.uint32)
        np.minimum.at(out, cell, h.astype(np.uint32))
        out = out.reshape(-1, BINS)
        full = out != NONE
        row, column = np.nonzero(~full)
        for t in range(_borrow.shape[1]):
            if not len(row):
                break
            source = _borrow[column, t]
            have = full[row, source]
            out[row[have], column[have]] = out[row[have], source[have]] ^ np.uint32(t + 1)
            row, column = row[~have], column[~have]
        return out.astype(np.uint16), full.sum(axis=1)


_SPACES = re.compile(rb"[\t\x0b\x0c\r ]+")
_ODD = re.compile(rb"[\t\x0b\x0c\r]|  ")


def normal(line: bytes) -> bytes:
    """The normal form of a line, as bytes: what isn't UTF-8 is replaced."""
    if not line.isascii():
        line = line.decode("utf-8", "replace").encode()
    low = line.lower()  # of bytes, A-Z alone
    return (_SPACES.sub(b" ", low) if _ODD.search(low) else low).strip(b" ")


def shingles(lines: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Shingles of normal lines end to end, and the n + 1 ends of each line's."""
    data, offsets = text_buffer(lines.cast(pa.large_binary()).cast(pa.large_string()))
    points = np.frombuffer(data.tobytes().decode("utf-8").encode("utf-32-le"), np.uint32)
    if len(points) != len(data):
        offsets = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])[offsets]
    own = np.diff(offsets) - SHINGLE + 1
    found, sizes = grams(points), np.maximum(own, 0)
    before = np.concatenate([[0], np.cumsum(sizes)])
    return found[np.repeat(offsets[:-1] - before[:-1], sizes) + np.arange(before[-1])], before


def band_keys(rows: np.ndarray) -> np.ndarray:
    """64-bit keys of rows of minima, a column for each band."""
    x = rows.reshape(len(rows), BANDS, ROWS).astype(np.uint64)
    h = np.broadcast_to(np.arange(1, BANDS + 1, dtype=np.uint64) * np.uint64(0x9E3779B97F4A7C15), x.shape[:2]).copy()
    for j in range(ROWS):
        h = mix(h ^ x[:, :, j])
    return h


DOCUMENT, STAR, BLOB = 0, 1, 2
_MADE = {"kind": "tinyint", "p": "int", "band": "int", "doc_id": "long", "row": "long", "ids": "array<long>", "bucket": "long", "u": "long", "v": "long", "n": "int", "blob": "binary"}
_KINDS = {"tinyint": pa.int8(), "long": pa.int64(), "int": pa.int32(), "binary": pa.binary(), "array<long>": pa.list_(pa.int64())}


def _made(kind: int, size: int, **columns: pa.Array | np.ndarray) -> pa.RecordBatch:
    filled = {"kind": pa.array(np.full(size, kind, np.int8))}
    for c, x in columns.items():
        filled[c] = x if isinstance(x, pa.Array) else pa.array(x.view(np.int64) if x.dtype == np.uint64 else x)
    return pa.RecordBatch.from_arrays([filled[c].cast(_KINDS[t]) if c in filled else pa.nulls(size, _KINDS[t]) for c, t in _MADE.items()], names=list(_MADE))


def row_of(text: str) -> Column:
    return F.xxhash64(text)


def _stars(slot: np.ndarray, key: np.ndarray, ids: np.ndarray, parts: int) -> Iterator[pa.RecordBatch]:
    """Pairs of the least line of each bucket with its others, from entries in any order; a bucket is a key of a slot."""
    if not len(key):
        return
    both = slot << np.uint64(32) | key
    order = np.lexsort((ids, both))
    both, ids = both[order], ids[order]
    new = np.append(True, (both[1:] != both[:-1]) | (ids[1:] != ids[:-1]))  # equal lines are one
    both, ids = both[new], ids[new]
    lead = np.append(True, both[1:] != both[:-1])
    first = np.flatnonzero(lead)
    size = np.diff(np.append(first, len(both)))
    other = np.flatnonzero(~lead)
    u, n = np.repeat(ids[first], size)[other], np.repeat(size, size)[other]
    band = (both >> np.uint64(32)) % np.uint64(BANDS)
    bucket = (mix(both.copy()) & ~np.uint64((1 << stars.BAND_BITS) - 1)) | band
    for x in range(0, len(other), 20_000):
        y = other[x : x + 20_000]
        yield _made(STAR, len(y), p=np.arange(len(y)) % parts, bucket=bucket[y], u=u[x : x + 20_000], v=ids[y], n=n[x : x + 20_000])


def _repeated(keys: np.ndarray) -> np.ndarray:
    """Of keys in order, which ones come more than once."""
    same = np.zeros(len(keys) + 1, bool)
    same[1:-1] = keys[1:] == keys[:-1]
    return same[1:] | same[:-1]


def _packed(key: np.ndarray, ids: np.ndarray) -> bytes:
    """32 bits of keys, in order, as differences, and ids: byte by byte, so that they compress well."""
    step = np.diff(key.astype(np.uint32), prepend=np.uint32(0))
    return np.ascontiguousarray(step.view(np.uint8).reshape(-1, 4).T).tobytes() + ids.tobytes()


def _unpacked(blob: bytes) -> tuple[np.ndarray, np.ndarray]:
    n = len(blob) // 12
    step = np.ascontiguousarray(np.frombuffer(blob, np.uint8, 4 * n).reshape(4, n).T).view(np.uint32).ravel()
    return np.cumsum(step, dtype=np.uint32), np.frombuffer(blob, np.uint64, n, 4 * n)


def bucketed(docs: DataFrame) -> DataFrame:
    """Rows of documents (doc_id, row: hash of the text, ids of its lines, 0 for empty ones) and of stars (bucket, u, v, n: lines with the least one of a bucket)."""
    # by the planner's estimate, which costs no scan; one that is far too great makes no more than OVER times the usual partitions
    total, usual = int(str(docs._jdf.queryExecution().optimizedPlan().stats().sizeInBytes())), partitions(docs.sparkSession)
    parts = max(usual, min(OVER * usual, -(-total // PART_BYTES)))

    def spread(keys: np.ndarray, ids: np.ndarray) -> Iterator[pa.RecordBatch]:
        """Pairs within what was gathered, and the first entry of each bucket, packed, for its partition."""
        band = np.tile(np.arange(BANDS, dtype=np.uint64), len(keys))
        flat = keys.ravel()
        both = ((flat & np.uint64(0xFFFFFFFF)) % np.uint64(parts) * np.uint64(BANDS) + band) << np.uint64(32) | flat >> np.uint64(32)
        order = np.argsort(both)
        both, own = both[order], ids[order // BANDS]
        twice = _repeated(both)
        yield from _stars(both[twice] >> np.uint64(32), both[twice] & np.uint64(0xFFFFFFFF), own[twice], parts)
        # of a bucket's entries the one with the least id goes on
        order = np.flatnonzero(twice)
        order = order[np.lexsort((own[order], both[order]))]
        lead = np.append(True, both[order][1:] != both[order][:-1])[: len(order)]
        some = np.sort(np.concatenate([np.flatnonzero(~twice), order[lead]]))
        both, own = both[some], own[some]
        slot = both >> np.uint64(32)
        cut = np.flatnonzero(np.append(True, slot[1:] != slot[:-1]))
        blobs = [_packed(both[a:b] & np.uint64(0xFFFFFFFF), own[a:b]) for a, b in zip(cut.tolist(), [*cut[1:].tolist(), len(both)], strict=True)]
        p, band = np.divmod(slot[cut].astype(np.int64), BANDS)
        for x in range(0, len(blobs), 256):
            y = slice(x, x + 256)
            yield _made(BLOB, len(blobs[y]), p=p[y], band=band[y], blob=pa.array(blobs[y], pa.binary()))

    def produce(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, ids, seen = [], [], set()
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            nulls, lists = batch.column(1).is_null().to_numpy(zero_copy_only=False), []
            for a, b in steps(offsets, STEP):
                x = Lines(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])
                null = nulls[a:b]
                here = ~np.repeat(null, np.diff(x.first))
                counts = np.where(null, 0, np.diff(x.first))
                lists.append(pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(counts)]), pa.int32()), pa.array(x.ids[here].view(np.int64))))
                some = np.flatnonzero(x.long)
                some = some[np.unique(x.ids[some], return_index=True)[1]]
                some = some[[k not in seen for k in x.ids[some].tolist()]] if len(some) else some
                for y in range(0, len(some), GATHER // BANDS):
                    part = some[y : y + GATHER // BANDS]
                    if (len(seen) + len(part)) * BANDS > GATHER and keys:
                        yield from spread(np.concatenate(keys), np.concatenate(ids))
                        keys, ids, seen = [], [], set()
                    keys.append(band_keys(x.signatures(part)[0]))
                    ids.append(x.ids[part])
                    seen.update(x.ids[part].tolist())
            if lists:
                yield _made(DOCUMENT, len(batch), p=np.arange(len(batch)) % parts, doc_id=batch.column(0), row=batch.column(2), ids=pa.concat_arrays(lists))
        if keys:
            yield from spread(np.concatenate(keys), np.concatenate(ids))

    def met(p: int, band: int, blobs: list[bytes]) -> Iterator[pa.RecordBatch]:
        """Pairs of one band in one partition."""
        found = [_unpacked(x) for x in blobs]
        key, ids = np.concatenate([x[0] for x in found]), np.concatenate([x[1] for x in found])
        order = np.argsort(key)
        some = order[_repeated(key[order])]
        yield from _stars(np.full(len(some), p * BANDS + band, np.uint64), key[some].astype(np.uint64), ids[some], parts)

    def consume(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        """Rows come in order of kind, partition and band."""
        at, held = None, []
        for batch in batches:
            blob = pa.compute.equal(batch.column(0), BLOB)
            rest = batch.filter(pa.compute.invert(blob))
            if len(rest):
                yield rest
            part = batch.filter(blob)
            for p, band, x in zip(*(part.column(c) for c in ("p", "band", "blob")), strict=True):
                key = (p.as_py(), band.as_py())
                if key != at:
                    if held:
                        yield from met(*at, held)
                    at, held = key, []
                held.append(x.as_py())
        if held:
            yield from met(*at, held)

    schema = ", ".join(f"{c} {t}" for c, t in _MADE.items())
    made = map_arrow(docs.select(F.col("doc_id").cast("long"), "text", row_of("text")), produce, schema)
    return written(map_arrow(made.repartition(parts, "p").sortWithinPartitions("kind", "p", "band"), consume, schema).drop("p", "band", "blob"), "lines")


def _places(ids: np.ndarray, rows: np.ndarray, places: np.ndarray) -> np.ndarray:
    """64-bit hashes of places of lines."""
    with np.errstate(over="ignore"):
        return mix(mix(ids.astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15) ^ rows.astype(np.uint64)) + places.astype(np.uint64) * np.uint64(0xD6E8FEB86659FD93))


class Filter:
    """Which of many places may be wanted: a Bloom filter of at most FILTER_BYTES."""

    def __init__(self, bits: int) -> None:
        self.bits, self.held = bits, np.zeros(bits // 8, np.uint8)

    @staticmethod
    def bits_for(expected: int) -> int:
        return min(FILTER_BYTES * 8, 1 << max(10, (12 * expected).bit_length()))

    def _at(self, hashes: np.ndarray) -> Iterator[np.ndarray]:
        for k in range(4):
            yield (hashes >> np.uint64(16 * k)) * np.uint64(0x9E3779B97F4A7C15) >> np.uint64(64 - self.bits.bit_length() + 1)

    def add(self, hashes: np.ndarray) -> None:
        for at in self._at(hashes):
            np.bitwise_or.at(self.held, at >> np.uint64(3), np.uint8(1) << (at & np.uint64(7)).astype(np.uint8))

    def may(self, hashes: np.ndarray) -> np.ndarray:
        out = np.ones(len(hashes), bool)
        for at in self._at(hashes):
            out &= (self.held[at >> np.uint64(3)] >> (at & np.uint64(7)).astype(np.uint8)) & 1 == 1
        return out


def _filter(chosen: DataFrame) -> Filter:
    """A filter of the places (doc_id, row, place) of chosen, gathered from those of all partitions."""
    expected = chosen.count()
    bits = Filter.bits_for(expected)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        own = Filter(bits)
        for batch in batches:
            own.add(_places(*(_numbers(batch.column(k)) for k in range(3))))
        yield pa.RecordBatch.from_arrays([pa.array([0]), pa.array([zlib.compress(own.held.tobytes(), 1)], pa.binary())], names=["k", "held"])

    whole, most = Filter(bits), max(1, min(16, expected // 50_000))
    for r in map_arrow(chosen.select("doc_id", "row", "place").coalesce(most), run, "k long, held binary").toLocalIterator():  # FILTER_BYTES at a time
        whole.held |= np.frombuffer(zlib.decompress(r.held), np.uint8)
    return whole


def _numbers(column: pa.Array) -> np.ndarray:
    return column.cast(pa.int64()).fill_null(-(1 << 62)).to_numpy(zero_copy_only=False).view(np.uint64) if column.null_count else column.cast(pa.int64()).to_numpy().view(np.uint64)


def _texts(docs: DataFrame, lines: DataFrame, wanted: DataFrame) -> DataFrame:
    """node, content (the normal form), size (bins that it fills), sketch of the wanted lines (node), each from one place that it has.

    All documents are read once more. Their lines' places go through a filter, so that those that are
    not wanted mostly stay where they are; the others are then joined with the wanted ones.
    """
    wanted = few(written(wanted, "wanted"), 16)
    chosen = written(lines.join(wanted, "node", "left_semi").dropDuplicates(["node"]), "chosen")
    named = few(chosen.select("node"), 16)
    shared = docs.sparkSession.sparkContext.broadcast(_filter(chosen))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids, rows, found = _numbers(batch.column(0)), _numbers(batch.column(2)), []
            for a, b in steps(offsets, STEP):
                base = int(offsets[a])
                part, bounds = data[base : offsets[b]], offsets[a : b + 1] - base
                breaks = np.flatnonzero(part == 10)
                before = np.searchsorted(breaks, bounds)
                doc = np.repeat(np.arange(b - a), np.diff(before) + 1)
                starts = np.sort(np.concatenate([bounds[:-1], breaks + 1]), kind="stable")
                ends = np.sort(np.concatenate([breaks, bounds[1:]]), kind="stable")
                place = np.arange(len(doc)) - np.searchsorted(doc, doc)
                some = np.flatnonzero(shared.value.may(_places(ids[a:b][doc], rows[a:b][doc], place)))
                if not len(some):
                    continue
                whole = part.tobytes()
                text = [normal(whole[x:y]) for x, y in zip(starts[some].tolist(), ends[some].tolist(), strict=True)]
                flat, at = text_buffer(pa.array(text, pa.binary()).cast(pa.large_binary()).cast(pa.large_string()))
                x = Lines(flat, at)
                long = np.flatnonzero(x.long)
                sketch, bins = x.signatures(long)
                take = pa.array(long)
                found.append([pa.array(x.ids[long].view(np.int64)), pa.array(text, pa.binary()).take(take), pa.array(bins, pa.int32()), stars.rows_of(sketch)])
            if found:
                yield pa.RecordBatch.from_arrays([pa.concat_arrays(c) for c in zip(*found, strict=True)], names=["node", "content", "size", "sketch"])

    found = map_arrow(docs.select(F.col("doc_id").cast("long"), "text", row_of("text")), run, "node long, content binary, size int, sketch binary")
    return found.join(named, "node", "left_semi").groupBy("node").agg(F.first("content").alias("content"), F.first("size").alias("size"), F.first("sketch").alias("sketch"))


def _likely(share: int) -> stars.Likely:
    def likely(a: np.ndarray, size_a: np.ndarray, b: np.ndarray, size_b: np.ndarray) -> np.ndarray:
        s = share / 100
        return (a == b).mean(axis=1) >= s - DEVIATIONS * np.sqrt(s * (1 - s) / np.minimum(size_a, size_b))

    return likely


def _verify(share: int) -> Callable[[pa.Array, np.ndarray, np.ndarray], np.ndarray]:
    def verify(lines: pa.Array, i: np.ndarray, j: np.ndarray) -> np.ndarray:
        some, place = np.unique(np.concatenate([i, j]), return_inverse=True)
        return stars.alike(*shingles(lines.take(pa.array(some))), place[: len(i)], place[len(i) :], share)

    return verify


def _linked(pairs: DataFrame, share: int) -> DataFrame:
    """Of pairs with sketches and lines of both, links that join what those that are alike do."""
    likely = _likely(share)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), 4096):
                part = batch.slice(at, 4096)
                keep = likely(stars.matrix(part.column(4)), part.column(2).to_numpy(), stars.matrix(part.column(5)), part.column(3).to_numpy())
                part = part.filter(pa.array(keep))
                n = np.arange(len(part))
                both = shingles(pa.concat_arrays([part.column(6), part.column(7)]))
                yield part.select([0, 1]).filter(pa.array(stars.alike(*both, n, n + len(part), share)))

    columns = ["u", "v", "sizeu", "sizev", "sketchu", "sketchv", "contentu", "contentv"]
    return map_arrow(pairs.select(columns), lambda batches: joined(run(batches)), "u long, v long")


def _lines(made: DataFrame) -> DataFrame:
    """doc_id, row, place, node of all lines but empty ones."""
    return made.where(F.col("kind") == DOCUMENT).select("doc_id", "row", F.posexplode("ids").alias("place", "node")).where("node <> 0")


def grouped(docs: DataFrame, made: DataFrame, share: int) -> DataFrame:
    """node, root of the lines that are linked with others."""
    lines = _lines(made)
    pairs = made.where(F.col("kind") == STAR).select("bucket", "u", "v", F.col("n").cast("long").alias("n"))
    found = written(stars.pairs_of(pairs), "pairs")
    texts = written(_texts(docs, lines, found.select(F.col("u").alias("node")).union(found.select("v")).distinct()), "line-texts")
    sketches = texts.select("node", "size", "sketch")
    contents = texts.select("node", "content")
    roots = components(_linked(stars.with_both(found, texts), share))
    more = stars.open_links(pairs, roots, sketches, lambda wanted: contents.join(wanted, "node", "left_semi"), "long", ROWS, _likely(share), _verify(share))
    return merged(roots, more)


def cut_lines(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """doc_id, row (hash of the text), cut (places of the lines to cut out) of documents that lose any."""
    with scratch() as held:
        return held.keep(_cut(docs, share))


def _cut(docs: DataFrame, share: int) -> DataFrame:
    made = bucketed(docs)
    lines = _lines(made)
    roots = grouped(docs, made, share)
    # a line that occurs once and has no link has no part in what follows
    again = lines.groupBy("node").agg(F.count("*").alias("n")).where("n > 1").select("node").join(roots, "node", "left_anti")
    named = few(written(roots.select("node", "root").unionByName(again.select("node", F.col("node").alias("root"))), "repeated"), 16)
    held = written(lines.join(named, "node").select("root", "doc_id", "row", "place"), "occurrences")
    place = F.struct("doc_id", "row", "place")
    first = few(written(held.groupBy("root").agg(F.min(place).alias("kept")), "first-lines"), 48)
    lost = held.join(first, "root").where(~place.eqNullSafe(F.col("kept"))).select("doc_id", "row", "place")
    return written(lost.groupBy("doc_id", "row").agg(F.array_sort(F.collect_set("place")).alias("cut")), "cut")


def deduplicated(docs: DataFrame, share: int = SHARE) -> DataFrame:
    """Rows of docs with all their columns, those lines cut out of text, and _lines and _kept, the numbers of lines before and after."""
    names = docs.columns
    cut = cut_lines(docs, share).select(F.col("doc_id").alias("_cut_doc"), F.col("row").alias("_cut_row"), F.col("cut").alias("_cut"))
    cut = few(cut, F.size("_cut") * 4 + 24)
    rows = docs.join(cut, docs["doc_id"].cast("long").eqNullSafe(cut["_cut_doc"]) & (F.xxhash64(docs["text"]) == cut["_cut_row"]), "left")
    text = rows["text"]
    pieces = F.split(text, "\n", -1)
    left = F.filter(pieces, lambda x, i: ~F.array_contains(cut["_cut"], i))
    after = F.when(cut["_cut"].isNull(), text).otherwise(F.array_join(left, "\n"))
    n = F.coalesce(F.octet_length(text) - F.octet_length(F.replace(text, F.lit("\n"), F.lit(""))) + 1, F.lit(0)).cast("long")
    lost = F.coalesce(F.when(cut["_cut"].isNotNull(), F.size(cut["_cut"])), F.lit(0))
    return rows.select(*(docs[f"`{c}`"] if c != "text" else after.alias("text") for c in names), n.alias("_lines"), (n - lost).alias("_kept"))


def op3_line_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    return deduplicated(docs).select("doc_id", F.col("_lines").alias("n_lines"), F.col("_kept").alias("n_kept"), "text")
