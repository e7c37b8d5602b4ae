"""Spelling variants by a positional q-gram index with a count filter (operator 11).

Words are maximal runs of Latin letters (A-Z, a-z, U+00C0 to U+00FF) with A-Z lower-cased, some of them noised as
the query says (noised()), of LEAST_CHARS code points or more, that occur LEAST_N times in all. Two words are near if
one inserted, deleted or replaced code point makes one the other.

1. Tasks cut runs out of whole batches of texts with numpy and count equal ones; Spark sums the counts.
2. A word of L code points has L - Q + 1 grams of Q code points, each at a position. One edit spoils Q of
   them at most, so near words have max(L, L') - 2Q + 1 grams in common, at positions that differ by no
   more than their lengths do. Grams are put in one order, rare ones first, by a table of how many words
   have each: the alphabet bounds it to 90**3 entries.
3. The index: a word is posted under its first Q + 1 grams in that order, each with its length and position, and
   looks itself up among words of its own length and of one more, there at the same position and the next. Near
   words must meet: of the grams in common, the first is among the first Q + 1 of each. Postings of grams that
   over HOT words have are divided by the next gram in common, which is among the first Q + 2. Spark deals
   postings out and sorts them, so each is merged in one place, in blocks of STEP pairs.
4. One edit changes at most two of the letters that a word has; pairs of a posting whose sets of letters differ in
   more go at once. The count filter keeps those with enough grams in common at fitting positions; they are
   verified by comparing the words from both ends. A pair met in several postings counts once.
5. form is a table join of each word with its near words; roots follow forms by doubling, in tables.

A null text has no words. A null doc_id is written as nothing before the colon. Rows with equal doc_id and text
count again, noised alike. An empty table gives no rows. Words may be of any length. Extra columns are ignored.
"""

from __future__ import annotations

import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import few, map_arrow, partitions, scratch, steps, table, text_buffer, written
from .stars import whole_groups
from .textvec import LOWER, mix, span_hashes

LEAST_CHARS, LEAST_N, FACTOR = 7, 2, 10
#: One in so many runs, by its crc32, loses a code point.
NOISED = 31
Q = 3
#: Letters by their number: a-z, then U+00C0 to U+00FF.
LETTERS = [*range(97, 123), *range(0xC0, 0x100)]
BASE = len(LETTERS)
#: Words that may have a gram before its postings are divided.
HOT = 20_000
#: Bytes of text, and pairs of words that are looked at, at once; rows of an Arrow batch sent back.
STEP, COMPARED, ROWS = 1_000_000, 1_000_000, 50_000

_number = np.full(0x100, -1, np.int64)
_number[LETTERS] = np.arange(BASE)
_is_letter = np.zeros(256, bool)
_is_letter[[*range(65, 91), *range(97, 123), 0xC3]] = True
_crc = np.arange(256, dtype=np.uint32)
for _ in range(8):
    _crc = np.where(_crc & 1, _crc >> 1 ^ np.uint32(0xEDB88320), _crc >> 1)


def runs(data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, numbers of texts) of all runs in UTF-8 texts: U+00C0 to U+00FF are 0xC3 and one more byte."""
    inside = np.zeros(len(data) + 2, bool)
    inside[1:-1] = _is_letter[data]
    inside[2:-1] |= data[:-1] == 0xC3
    edge = np.zeros(len(data) + 1, bool)
    edge[offsets] = True
    starts = np.flatnonzero(inside[1:-1] & (~inside[:-2] | edge[:-1]))
    ends = np.flatnonzero(inside[1:-1] & (~inside[2:] | edge[1:])) + 1
    return starts, ends, np.searchsorted(offsets, starts, side="right") - 1


def crcs(data: np.ndarray, starts: np.ndarray, ends: np.ndarray, before: np.ndarray) -> np.ndarray:
    """Unsigned crc32 of spans, each going on from the crc32 of what comes before it."""
    state = before.astype(np.uint32) ^ np.uint32(0xFFFFFFFF)
    lengths = ends - starts
    live, at = np.flatnonzero(lengths > 0), 0
    while len(live):
        if at == 64:  # the few long ones, one by one
            for i in live.tolist():
                state[i] = zlib.crc32(data[starts[i] + at : ends[i]].tobytes(), int(state[i]) ^ 0xFFFFFFFF) ^ 0xFFFFFFFF
            break
        x = state[live]
        state[live] = _crc[(x ^ data[starts[live] + at]) & np.uint32(255)] ^ x >> np.uint32(8)
        at += 1
        live = live[lengths[live] > at]
    return state ^ np.uint32(0xFFFFFFFF)


def noised(low: np.ndarray, starts: np.ndarray, ends: np.ndarray, chars: np.ndarray, crc: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(bytes, starts, ends) of the words, those whose crc32 NOISED divides without the code point at crc32 % length."""
    hit = np.flatnonzero(crc % np.uint32(NOISED) == 0)
    if not len(hit):
        return low, starts, ends
    parts, at, starts, ends = [low], len(low), starts.copy(), ends.copy()
    for i, k in zip(hit.tolist(), (crc[hit] % chars[hit].astype(np.uint32)).tolist(), strict=True):
        word = low[starts[i] : ends[i]]
        first = np.flatnonzero((word & 0xC0) != 0x80)  # where code points begin
        word = np.delete(word, np.s_[first[k] : first[k + 1] if k + 1 < len(first) else len(word)])
        parts.append(word)
        starts[i], at = at, at + len(word)
        ends[i] = at
    return np.concatenate(parts), starts, ends


def word_counts(docs: DataFrame, noise: bool = True) -> DataFrame:
    """word, n of all words of LEAST_CHARS code points or more."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            ids = batch.column(0).to_pylist()
            for a, b in steps(offsets, STEP):
                raw = data[offsets[a] : offsets[b]]
                starts, ends, owner = runs(raw, offsets[a : b + 1] - offsets[a])
                twos = np.concatenate([[0], np.cumsum(raw == 0xC3)])
                chars = ends - starts - (twos[ends] - twos[starts])
                keep = chars >= LEAST_CHARS
                starts, ends, owner, chars = starts[keep], ends[keep], owner[keep], chars[keep]
                low = LOWER[raw]
                if noise:
                    ahead = np.array([zlib.crc32(f"{'' if x is None else x}:".encode()) for x in ids[a:b]], np.uint32)
                    crc = crcs(low, starts, ends, ahead[owner])
                    some = (crc % np.uint32(NOISED) != 0) | (chars > LEAST_CHARS)  # the others get too short
                    low, starts, ends = noised(low, starts[some], ends[some], chars[some], crc[some])
                    order = np.argsort(starts, kind="stable")
                    starts, ends = starts[order], ends[order]
                if not len(starts):
                    continue
                _, first, n = np.unique(span_hashes(low, starts, ends), return_index=True, return_counts=True)
                sizes = ends[first] - starts[first]
                laid = np.concatenate([[0], np.cumsum(sizes)])
                text = low[np.repeat(starts[first] - laid[:-1], sizes) + np.arange(laid[-1])]
                words = pa.LargeStringArray.from_buffers(len(first), pa.py_buffer(laid.astype(np.int64)), pa.py_buffer(text)).cast(pa.string())
                for x in range(0, len(first), ROWS):
                    yield pa.RecordBatch.from_arrays([words[x : x + ROWS], pa.array(n[x : x + ROWS].astype(np.int64))], names=["word", "n"])

    return map_arrow(docs.select(F.col("doc_id").cast("long"), "text"), run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def letters(words: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Numbers of the letters of words end to end, and the n + 1 offsets."""
    data, offsets = text_buffer(words)
    points = np.frombuffer(data.tobytes().decode().encode("utf-32-le"), np.uint32)
    ahead = np.concatenate([[0], np.cumsum((data & 0xC0) != 0x80)])
    return _number[points], ahead[offsets]


def grams(numbers: np.ndarray, bounds: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(gram, word, position) of all grams of words laid end to end."""
    n = max(0, len(numbers) - Q + 1)
    whole = np.zeros(n, np.int64)
    for j in range(Q):
        whole = whole * BASE + numbers[j : n + j]
    owner = np.repeat(np.arange(len(bounds) - 1), np.diff(bounds))[:n]
    at = np.arange(n) - bounds[:-1][owner]
    keep = np.arange(n) + Q <= bounds[1:][owner]
    return whole[keep], owner[keep], at[keep]


def gram_order(words: DataFrame) -> tuple[np.ndarray, np.ndarray]:
    """(place of each gram in the order, rare ones first; whether over HOT words have it): BASE ** Q entries each."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        count = np.zeros(BASE**Q, np.int64)
        for batch in batches:
            gram, owner, _ = grams(*letters(batch.column(0)))
            count += np.bincount(np.unique(owner * BASE**Q + gram) % BASE**Q, minlength=BASE**Q)
        some = np.flatnonzero(count)
        yield pa.RecordBatch.from_arrays([pa.array(some), pa.array(count[some])], names=["gram", "n"])

    count = np.zeros(BASE**Q, np.int64)
    found = map_arrow(words.select("word"), run, "gram long, n long").groupBy("gram").agg(F.sum("n").alias("n")).toPandas()  # BASE ** Q rows at most
    count[found["gram"].to_numpy(np.int64)] = found["n"].to_numpy(np.int64)
    place = np.empty(BASE**Q, np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(BASE**Q)
    return place, count > HOT


def posted(numbers: np.ndarray, bounds: np.ndarray, place: np.ndarray, often: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(key, asks, word): under which keys words are posted, and those (asks) that they look up besides; often: which grams' postings are divided."""
    gram, owner, at = grams(numbers, bounds)
    order = np.lexsort((at, place[gram], owner))
    gram, owner, at = gram[order], owner[order], at[order]
    size = np.diff(bounds)
    first = np.concatenate([[0], np.cumsum(size - Q + 1)])
    nth = np.arange(len(gram)) - first[:-1][owner]
    lead = np.flatnonzero(nth <= Q)
    plain, hot = lead[~often[gram[lead]]], lead[often[gram[lead]]]
    later = first[:-1][owner[hot]] + Q + 1 - hot  # grams after this one, up to the one numbered Q + 1
    x = np.repeat(hot, later)
    y = x + 1 + np.arange(len(x)) - np.repeat(np.cumsum(later) - later, later)
    one, two = np.concatenate([plain, x]), np.concatenate([np.zeros(len(plain), np.int64), gram[y] + 1])
    keys, asks, who = [], [], []
    for longer, shift in ((0, 0), (1, 0), (1, 1)):
        key = mix((gram[one] * (BASE**Q + 1) + two).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15))
        keys.append(mix(key ^ ((size[owner[one]] + longer) << 32 | at[one] + shift).astype(np.uint64)))
        asks.append(np.full(len(one), bool(longer)))
        who.append(owner[one])
    return np.concatenate(keys), np.concatenate(asks), np.concatenate(who)


def _index(words: DataFrame, place: np.ndarray, often: np.ndarray) -> DataFrame:
    """key, asks, word, n of the index."""
    shared = words.sparkSession.sparkContext.broadcast((place.astype(np.int32), often))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        order, divided = shared.value
        for batch in batches:
            for lo in range(0, len(batch), 4096):
                part = batch.slice(lo, 4096)
                key, asks, who = posted(*letters(part.column(0)), order, divided)
                for x in range(0, len(key), ROWS):
                    y = pa.array(who[x : x + ROWS])
                    yield pa.RecordBatch.from_arrays([pa.array(key[x : x + ROWS].view(np.int64)), pa.array(asks[x : x + ROWS]), part.column(0).take(y), part.column(1).take(y)], names=["key", "asks", "word", "n"])

    return map_arrow(words.select("word", "n"), run, "key long, asks boolean, word string, n long")


def letter_sets(numbers: np.ndarray, bounds: np.ndarray) -> np.ndarray:
    """A bit for each letter that a word has; some letters share one."""
    return np.bitwise_or.reduceat(np.uint64(1) << (numbers & 63).astype(np.uint64), bounds[:-1])


def one_edit(numbers: np.ndarray, bounds: np.ndarray, i: np.ndarray, j: np.ndarray) -> np.ndarray:
    """Whether words i and j, of which j is as long or longer by one, are near: count filter, then verification."""
    size = np.diff(bounds)
    own = size[i]
    before = np.concatenate([[0], np.cumsum(own)])
    at = np.arange(before[-1]) - np.repeat(before[:-1], own)
    a = numbers[np.repeat(bounds[:-1][i], own) + at]
    there = np.repeat(bounds[:-1][j], own) + at
    same, shifted = a == numbers[there], np.zeros(len(a), bool)
    longer = np.repeat(size[j] - own, own).astype(bool)
    shifted[longer] = a[longer] == numbers[there[longer] + 1]
    # grams in common: Q letters that agree, at the same position or, if the other is longer, at the next
    begins = at + Q <= np.repeat(own, own)
    hit = np.zeros(len(a), bool)
    for x in (same, shifted):
        run = x.copy()
        for k in range(1, Q):
            run[:-k] &= x[k:]
        hit |= run & begins
    starts = before[:-1]
    common = np.add.reduceat(hit.astype(np.int64), starts)
    enough = common >= size[j] - 2 * Q + 1
    # equal lengths: one letter differs; else what agrees from the front and from the back covers the shorter word
    differ = np.add.reduceat((~same).astype(np.int64), starts)
    front = np.minimum.reduceat(np.where(same, np.repeat(own, own), at), starts)
    back = np.maximum.reduceat(np.where(shifted, -1, at), starts)
    return enough & np.where(size[j] == own, differ == 1, back < front)


def _near(index: DataFrame) -> DataFrame:
    """word, n, near, near_n of near words, both ways; a pair for each posting in which it meets."""
    n = partitions(index.sparkSession)

    def pairs(starts: np.ndarray, asks: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
        """Within each posting, every two posted words, and each that asks with every posted one, COMPARED pairs at once."""
        ends = np.append(starts[1:], len(asks))
        group = np.repeat(np.arange(len(starts)), ends - starts)
        held = np.add.reduceat((~asks).astype(np.int64), starts)  # posted words come first
        end = (starts + held)[group]
        begin = np.where(asks, starts[group], np.arange(len(asks)) + 1)
        left = np.maximum(end - begin, 0)
        before, at = np.concatenate([[0], np.cumsum(left)]), 0
        while at < len(left):
            to = max(at + 1, int(np.searchsorted(before, before[at] + COMPARED, side="right")) - 1)
            i = np.repeat(np.arange(at, to), left[at:to])
            yield i, np.arange(len(i)) + np.repeat(begin[at:to] - before[at:to] + before[at], left[at:to])
            at = to

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for rows, starts in whole_groups(batches, 1):
            words, counts = rows.column("word").combine_chunks(), rows.column("n").combine_chunks()
            asks = rows.column("asks").to_numpy()
            ends = np.append(starts[1:], len(asks))
            more = np.flatnonzero((ends - starts > 1) & ~asks[starts])  # postings that a pair can come from
            some = np.repeat(starts[more], ends[more] - starts[more])
            lead = np.cumsum(np.append(0, ends[more] - starts[more]))[:-1]
            some += np.arange(len(some)) - np.repeat(lead, ends[more] - starts[more])
            if not len(some):
                continue
            words, counts, asks = words.take(pa.array(some)), counts.take(pa.array(some)), asks[some]
            words = words.combine_chunks() if isinstance(words, pa.ChunkedArray) else words
            numbers, bounds = letters(words)
            held = letter_sets(numbers, bounds)
            for i, j in pairs(lead, asks):
                alike = np.flatnonzero(np.bitwise_count(held[i] ^ held[j]) <= 2)
                if not len(alike):
                    continue
                i, j = i[alike], j[alike]
                near = one_edit(numbers, bounds, i, j)
                for x, y in ((i[near], j[near]), (j[near], i[near])):
                    x, y = pa.array(x), pa.array(y)
                    yield pa.RecordBatch.from_arrays([words.take(x), counts.take(x), words.take(y), counts.take(y)], names=["word", "n", "near", "near_n"])

    return map_arrow(index.repartition(n, "key").sortWithinPartitions("key", "asks"), run, "word string, n long, near string, near_n long")


def _rooted(forms: DataFrame) -> DataFrame:
    """word, root of words that have a form. A form occurs FACTOR times as often, so chains end."""
    at = written(forms.select("word", F.col("form").alias("root")), "roots")
    while True:
        onward = at.join(at.select(F.col("word").alias("root"), F.col("root").alias("next")), "root", "left")
        after = written(onward.select("word", F.coalesce("next", "root").alias("root"), F.col("next").isNotNull().alias("moved")), "roots")
        if after.where("moved").isEmpty():
            return after.drop("moved")
        at = after.drop("moved")


def variants(docs: DataFrame, noise: bool = True) -> DataFrame:
    """word, form, root, n, n_near, form_n of all words; noise: noised() runs first, as the query wants it."""
    with scratch() as held:
        return held.keep(written(_grouped(docs, noise), "variants"))


def _grouped(docs: DataFrame, noise: bool) -> DataFrame:
    words = written(word_counts(docs, noise).where(F.col("n") >= LEAST_N), "words")
    near = _near(_index(words, *gram_order(words))).repartition(partitions(words.sparkSession), "word")
    once = near.groupBy("word", "near").agg(F.first("n").alias("n"), F.first("near_n").alias("near_n"))
    found = once.groupBy("word").agg(F.first("n").alias("n"), F.count("*").alias("n_near"), F.min(F.struct((-F.col("near_n")).alias("less"), F.col("near").alias("near"))).alias("best"))
    good = -F.col("best.less") >= FACTOR * F.col("n")
    found = written(found.select("word", "n_near", F.when(good, F.col("best.near")).alias("form"), F.when(good, -F.col("best.less")).alias("form_n")), "near")
    roots = _rooted(found.where("form IS NOT NULL"))
    out = words.join(found, "word", "left").join(few(roots, F.octet_length("word") + F.octet_length("root") + 32), "word", "left")
    return out.select("word", "form", F.coalesce("root", "word").alias("root"), "n", F.coalesce("n_near", F.lit(0)).alias("n_near"), "form_n")


def op11_spelling(spark: SparkSession, sf_dir: str) -> DataFrame:
    return variants(table(spark, sf_dir, "documents"))
