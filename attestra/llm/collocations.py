"""Phrase collocations by suffix arrays (operator 13).

Texts, with A-Z lower-cased, are cut into pieces at .,;:!? and at line and page ends, pieces into words at
spaces and tabs. All is per language: words of different languages are different words.

1. Each task lays the texts it gets end to end, SHARD words at a time, numbers the words and sorts the
   places by what follows: prefix doubling, numpy sorts that give ranks by one word, two words, four. Intervals
   of places whose longest common prefixes are at least k words are the shard's k-grams, the interval's length
   their count. A first pass gives words, and pairs by a 64-bit hash, which are summed over all shards.
2. Pairs that may come LEAST times are marked in a bitmap of BITS bits at most, for every task. A phrase
   can't come more often than a pair in it, so a second pass gives the phrases, as texts, of which all pairs are
   marked. The marks only spare rows: counts are of phrases themselves, and whole.
3. Counts are merged by language and phrase; candidates, their parts and the longer ones that hold
   them are joined as tables. Scores are decimals of 38 digits, divided without a remainder.

A null text is empty; an empty text has no words. A null lang is `und`. Repeated rows count again. An empty
table gives no rows. Extra columns are ignored. A word or text may have any length.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import map_arrow, scratch, steps, table, text_buffer, written
from .textvec import byte_class, mix, words

LENGTH, LEAST, SHARE, TOP = 4, 30, 80, 2000
SCALE = 2_000_000
#: What divides pieces, and what divides words in them.
ENDS = [*b".,;:!?", *range(0x0A, 0x0E)]
IS_WORD = byte_class([0x20, 0x09, *ENDS])
#: Words of a shard; bytes of text handled at once; the most bits of a bitmap (8 MB).
SHARD, STEP, BITS = 700_000, 500_000, 1 << 26
UNKNOWN = "und"


class Shard:
    """Words of texts end to end as numbers, and their places in the order of what follows."""

    def __init__(self) -> None:
        self.parts: list[tuple] = []
        self.size, self.at = 0, 0

    def add(self, data: np.ndarray, offsets: np.ndarray, lang: np.ndarray) -> None:
        """Texts, and a number of each one's language."""
        starts, ends, hashes, bounds = words(data, offsets, IS_WORD)
        divides = np.zeros(256, np.int32)
        divides[ENDS] = 1
        piece = np.cumsum(divides[data])[starts]
        follows = np.zeros(len(starts), bool)  # whether the next word is in the same piece
        follows[:-1] = piece[1:] == piece[:-1]
        last = bounds[1:][bounds[1:] > bounds[:-1]] - 1
        follows[last] = False
        own = np.repeat(lang, np.diff(bounds))
        self.parts.append((data, (starts + self.at).astype(np.int32), (ends + self.at).astype(np.int32), hashes, follows, own))
        self.size, self.at = self.size + len(starts), self.at + len(data)

    def closed(self) -> Shard:
        data, self.starts, self.ends, hashes, self.follows, self.lang = (np.concatenate(x) for x in zip(*self.parts, strict=True))
        self.text, self.own, self.parts = data, hashes, []
        del data
        key = mix(hashes ^ mix((self.lang.astype(np.uint64) + np.uint64(1)) * np.uint64(0x9E3779B97F4A7C15)))
        self.places, numbers = np.unique(key, return_index=True, return_inverse=True)[1:]
        self.words = numbers.astype(np.int32)
        return self

    def intervals(self, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k, first places and counts of all k-grams, for k from 1 to depth (1, 2 or 4).

        Ranks of twice as many words come from two ranks of half as many. Each interval of the
        sorted places in which neighbours share k words is one k-gram.
        """
        n = len(self.words)
        yield 1, self.places, np.bincount(self.words, minlength=len(self.places))
        rank, width = self.words + np.int32(1), 1
        while width < depth:
            far = np.zeros(n, np.int32)  # the rank of what follows after `width` words, 0 where the piece ends before
            on = np.ones(n, bool)
            for j in range(width):
                on[: n - 1 - j] &= self.follows[j : n - 1]
                on[max(0, n - 1 - j) :] = False
            far[: n - width] = np.where(on[: n - width], rank[width:], 0)
            both = rank.astype(np.int64) * (int(rank.max(initial=0)) + 1) + far
            order = np.argsort(both, kind="stable")
            yield from self._between(order, width, depth)
            first = np.append(True, both[order][1:] != both[order][:-1])[: len(order)]
            rank = np.empty(n, np.int32)
            rank[order] = np.cumsum(first)
            width *= 2

    def _between(self, order: np.ndarray, width: int, depth: int) -> Iterator[tuple[int, np.ndarray, np.ndarray]]:
        """k-grams of more than `width` and at most twice as many words, from places sorted by twice as many."""
        n = len(order)
        for k in range(width + 1, min(2 * width, depth) + 1):
            whole = np.ones(n, bool)  # places from which k words lie in one piece
            for j in range(k - 1):
                whole[: n - j] &= self.follows[j:]
                whole[n - j :] = False
            some = order[whole[order]]
            new = np.zeros(len(some), bool)  # where the longest common prefix with the place before is shorter
            new[:1] = True
            for j in range(k):
                x = self.words[some + j]
                new[1:] |= x[1:] != x[:-1]
            first = np.flatnonzero(new)
            yield k, some[first], np.diff(np.append(first, len(some)))

    def texts(self, at: np.ndarray) -> pa.Array:
        """The words at places."""
        sizes = self.ends[at] - self.starts[at]
        before = np.concatenate([[0], np.cumsum(sizes)])
        data = self.text[np.repeat(self.starts[at] - before[:-1], sizes) + np.arange(before[-1])]
        data[(data >= 65) & (data <= 90)] += 32
        return pa.LargeStringArray.from_buffers(len(at), pa.py_buffer(before.astype(np.int64)), pa.py_buffer(data))

    def phrases(self, at: np.ndarray, k: int) -> pa.Array:
        """The phrases of k words that begin at places, words divided by a space."""
        columns = []
        for j in range(k):
            some, which = np.unique(self.words[at + j], return_inverse=True)
            columns.append(self.texts(self.places[some]).take(pa.array(which)))
        return columns[0] if k == 1 else pc.binary_join_element_wise(*columns, pa.scalar(" ", pa.large_string()))


def _cut(data: np.ndarray, offsets: np.ndarray, step: int) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Texts as they are; one that is longer than a step in parts of about that size, cut where pieces end."""
    if len(offsets) > 2 or len(data) <= step:
        yield data, offsets
        return
    at = 0
    while at < len(data):
        to = min(len(data), at + step)
        while to < len(data) and data[to] not in ENDS:
            ahead = np.flatnonzero(np.isin(data[to : to + step], ENDS))
            to += int(ahead[0]) if len(ahead) else min(step, len(data) - to)
        yield data[at:to], np.array([0, to - at])
        at = to


def _shards(batches: Iterator[pa.RecordBatch], most: int, step: int) -> Iterator[tuple[Shard, list[str]]]:
    """Shards of the texts of about `most` words in (text, lang) batches, with the languages that their numbers stand for."""
    shard, number = Shard(), {}
    for batch in batches:
        data, offsets = text_buffer(batch.column(0))
        names = batch.column(1).to_pylist()
        for a, b in steps(offsets, step):
            lang = np.array([number.setdefault(x, len(number)) for x in names[a:b]], np.int32)
            for some, ends in _cut(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a], step):
                shard.add(some, ends, lang)
                if shard.size >= most:
                    yield shard.closed(), list(number)
                    shard = Shard()
    if shard.size:
        yield shard.closed(), list(number)


def _named(lang: np.ndarray, names: list[str]) -> pa.Array:
    return pa.array(names, pa.string()).take(pa.array(lang))


#: Rows of an Arrow batch sent back.
ROWS = 50_000


def _pairs(docs: DataFrame) -> DataFrame:
    """lang, word (null for pairs), key (null for words), n of each shard."""
    sizes = SHARD, STEP

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for shard, names in _shards(batches, *sizes):
            keys = _language_keys(names)
            for k, at, n in shard.intervals(2):
                for x in range(0, len(at), ROWS):
                    y, c = at[x : x + ROWS], pa.array(n[x : x + ROWS], pa.int64())
                    if k == 1:
                        columns = [_named(shard.lang[y], names), shard.texts(y).cast(pa.string()), pa.nulls(len(y), pa.int64()), c]
                    else:
                        key = _global_keys(shard, y, keys)
                        columns = [pa.nulls(len(y), pa.string()), pa.nulls(len(y), pa.string()), pa.array(key.view(np.int64)), c]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "word", "key", "n"])

    return map_arrow(docs, run, "lang string, word string, key long, n long")


def _language_keys(names: list[str]) -> np.ndarray:
    """A 64-bit hash of each language's name, the same in every task."""
    data, offsets = text_buffer(pa.array([f"{x}." for x in names], pa.large_string()))
    return words(data, offsets, np.ones(256, bool))[2]


def _global_keys(shard: Shard, at: np.ndarray, languages: np.ndarray) -> np.ndarray:
    """Hashes of the pairs at places, the same in every task: of the words' own hashes and the language's."""
    return mix(mix(shard.own[at] * np.uint64(0xD6E8FEB86659FD93) + shard.own[at + 1]) ^ languages[shard.lang[at]])


def _marked(pairs: DataFrame, least: int) -> np.ndarray:
    """A bitmap, of BITS bits at most, in which all pairs that come `least` times are marked by the lowest bits of their keys."""
    often = written(pairs.where("key IS NOT NULL").groupBy("key").agg(F.sum("n").alias("n")).where(F.col("n") >= least).select("key"), "frequent")
    bits = 1 << max(16, min(BITS.bit_length() - 1, (16 * often.count()).bit_length()))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = np.zeros(bits // 8, np.uint8)
        for batch in batches:
            at = (batch.column(0).to_numpy().view(np.uint64) & np.uint64(bits - 1)).astype(np.int64)
            np.bitwise_or.at(held, at >> 3, (1 << (at & 7)).astype(np.uint8))
        yield pa.RecordBatch.from_arrays([pa.array([held.tobytes()], pa.binary())], names=["bits"])

    whole = np.zeros(bits // 8, np.uint8)
    for row in map_arrow(often.coalesce(4), run, "bits binary").collect():  # 4 rows at most
        whole |= np.frombuffer(row.bits, np.uint8)
    return whole


def _phrases(docs: DataFrame, marked: np.ndarray) -> DataFrame:
    """lang, phrase, k, n of each shard, of phrases all of whose pairs are marked."""
    shared, sizes = docs.sparkSession.sparkContext.broadcast(marked), (SHARD, STEP)

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        bitmap = shared.value
        for shard, names in _shards(batches, *sizes):
            languages = _language_keys(names)
            often = np.zeros(len(shard.words) + 1, bool)
            some = np.flatnonzero(shard.follows)
            bit = (_global_keys(shard, some, languages) & np.uint64(8 * len(bitmap) - 1)).astype(np.int64)
            often[some] = bitmap[bit >> 3] >> (bit & 7).astype(np.uint8) & 1
            for k, at, n in shard.intervals(LENGTH):
                if k == 1:
                    continue
                keep = often[at].copy()
                for j in range(1, k - 1):
                    keep &= often[at + j]
                at, n = at[keep], n[keep]
                for x in range(0, len(at), ROWS):
                    y = at[x : x + ROWS]
                    columns = [_named(shard.lang[y], names), shard.phrases(y, k).cast(pa.string()), pa.array(np.full(len(y), k, np.int32)), pa.array(n[x : x + ROWS], pa.int64())]
                    yield pa.RecordBatch.from_arrays(columns, names=["lang", "phrase", "k", "n"])

    return map_arrow(docs, run, "lang string, phrase string, k int, n long")


def _ends(split: Column, k: Column) -> Column:
    """The cuts of a phrase's words: k, the first part and the rest."""
    cut = lambda i: F.struct(i.alias("at"), F.array_join(F.slice(split, F.lit(1), i), " ").alias("first"), F.array_join(F.slice(split, i + 1, k - i), " ").alias("rest"))
    return F.transform(F.sequence(F.lit(1), k - 1), cut)


def _within(split: Column, k: Column) -> Column:
    """The shorter phrases, of two words or more, that lie in a phrase."""
    of = lambda m: F.transform(F.sequence(F.lit(1), k - m + 1), lambda i: F.array_join(F.slice(split, i, m), " "))
    return F.flatten(F.transform(F.sequence(F.lit(2), k - 1), of))


def collocations(docs: DataFrame, least: int = LEAST, share: int = SHARE, top: int = TOP) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score of each language's first `top` phrases."""
    with scratch() as held:
        return held.keep(written(_ranked(docs, least, share, top), "collocations"))


def _ranked(docs: DataFrame, least: int, share: int, top: int) -> DataFrame:
    texts = docs.select("text", F.coalesce(F.col("lang").cast("string"), F.lit(UNKNOWN)).alias("lang")).where("text IS NOT NULL")
    found = written(_pairs(texts), "pairs")
    counted = written(found.where("word IS NOT NULL").groupBy("lang", "word").agg(F.sum("n").alias("n")), "words")
    phrases = _phrases(texts, _marked(found, least)).groupBy("lang", "phrase", "k").agg(F.sum("n").alias("a"))
    phrases = written(phrases.where(F.col("a") >= least), "phrases")
    total = counted.groupBy("lang").agg(F.sum("n").alias("n"))
    # a part of a candidate comes as often as it, at least
    parts = written(phrases.where(F.col("k") < LENGTH).select("lang", "phrase", F.col("a").alias("f")).unionByName(counted.where(F.col("n") >= least).select("lang", F.col("word").alias("phrase"), F.col("n").alias("f"))), "parts")
    split = F.split("phrase", " ", -1)
    longer = phrases.where("k > 2").select("lang", F.explode(F.array_distinct(_within(split, F.col("k")))).alias("phrase"), "a")
    longer = longer.groupBy("lang", "phrase").agg(F.max("a").alias("of_longer"))
    kept = phrases.join(longer, ["lang", "phrase"], "left").where(F.col("of_longer").isNull() | (F.col("of_longer").cast("decimal(38,0)") * 100 < F.col("a").cast("decimal(38,0)") * share))
    cuts = written(kept.select("lang", "phrase", "a", F.explode(_ends(split, F.col("k"))).alias("c")).select("lang", "phrase", "a", "c.*"), "cuts")
    side = lambda name, as_: parts.select("lang", F.col("phrase").alias(name), F.col("f").alias(as_))
    scored = cuts.join(side("first", "l"), ["lang", "first"]).join(side("rest", "r"), ["lang", "rest"])
    scored = scored.withColumn("score", F.expr(f"(CAST(a AS DECIMAL(28,0)) * {SCALE}) div (CAST(l AS DECIMAL(28,0)) + r)"))
    lowest = scored.groupBy("lang", "phrase").agg(F.min(F.struct("score", "at", "a", "l", "r")).alias("x")).select("lang", "phrase", "x.*")
    order = Window.partitionBy("lang").orderBy(F.desc("score"), F.desc("a"), "phrase")
    ranked = lowest.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return ranked.join(F.broadcast(total) if total.count() <= 10_000 else total, "lang").select("lang", F.col("rank").cast("long").alias("rank"), "phrase", "a", "l", "r", "n", F.col("score").cast("long").alias("score"))


def op13_collocations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return collocations(table(spark, sf_dir, "documents"))
