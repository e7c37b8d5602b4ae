"""Vectors of texts, kept by digest, and search by terms and vectors together.

A Memo is a table of vectors by provider and sha256 of the text. Before a provider is asked, texts are
joined with it by digest: only those that nobody has asked for yet are computed, each once, and appended. So
a second run over the same texts computes nothing, and a corpus that grows costs what was added to it.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from attestra.functions import exprs as E
from attestra.operators import retrieval
from attestra.plans.shared import exists

#: From texts to their vectors; None is no vector.
Embed = Callable[[list[str]], list[list[float] | None]]


@dataclass
class Provider:
    """Whoever makes vectors. `name` tells its vectors from those of others; `batch` texts are passed at once."""

    name: str
    embed: Embed
    batch: int = 64


def hashing(wide: int = 32) -> Provider:
    """Counts of a text's lexemes in `wide` buckets, by the first 32 bits of their md5: needs no model."""

    def embed(texts: list[str]) -> list[list[float] | None]:
        out: list[list[float] | None] = []
        for text in texts:
            counts = [0.0] * wide
            for word in re.findall(r"[a-z0-9][a-z0-9\-.]*", text.replace("İ", "i").lower()):  # one letter, as in SQL
                counts[int(hashlib.md5(word.encode(), usedforsecurity=False).hexdigest()[:8], 16) % wide] += 1.0
            out.append(counts)
        return out

    return Provider(f"hashing-{wide}", embed)


class Memo:
    """Vectors under one folder, partitioned by provider and run; it only grows."""

    def __init__(self, spark: SparkSession, path: str) -> None:
        self.spark, self.path = spark, path.rstrip("/")

    def _rows(self) -> DataFrame:
        schema = "digest string, vector array<double>, provider string, run string"
        return self.spark.read.schema(schema).parquet(self.path) if exists(self.spark, self.path) else self.spark.createDataFrame([], schema)

    def vectors(self, provider: Provider) -> DataFrame:
        """digest, vector of all texts that the provider has been asked for; two runs at once may have stored one twice."""
        rows = self._rows().where(F.col("provider") == provider.name)
        return rows.groupBy("digest").agg(F.min_by("vector", "run").alias("vector"))

    def fill(self, texts: DataFrame, provider: Provider) -> DataFrame:
        """Ask the provider for the texts (key, text) that are new; returns one row: rows, distinct, known, computed.

        Null texts have no vector. Of equal texts the one of least key is sent, and no others are moved. If the
        provider fails, nothing is stored. A text for which it gives None is asked for again next time.
        """
        run = uuid.uuid4().hex
        named = texts.where("text IS NOT NULL").select("key", F.sha2("text", 256).alias("digest"), "text")
        once = named.groupBy("digest").agg(F.min("key").alias("key"), F.count("*").alias("n"))
        new = once.join(self.vectors(provider).select("digest"), "digest", "left_anti")
        # one key for each digest, so a text that was moved for the join isn't moved again
        todo = named.join(new.select("key", "digest"), ["key", "digest"], "left_semi").dropDuplicates(["key", "digest"])
        name, embed, batch = provider.name, provider.embed, provider.batch

        def ask(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for rows in batches:
                for at in range(0, len(rows), batch):
                    part = rows.slice(at, batch)
                    vectors = embed(part.column(1).to_pylist())
                    keep = pa.array([v is not None for v in vectors])
                    made = pa.RecordBatch.from_arrays([part.column(0), pa.array(vectors, pa.list_(pa.float64()))], names=["digest", "vector"])
                    yield made.filter(keep)

        made = todo.select("digest", "text").mapInArrow(ask, "digest string, vector array<double>")
        made.withColumns({"provider": F.lit(name), "run": F.lit(run)}).write.mode("append").partitionBy("provider", "run").parquet(self.path)
        computed = self._rows().where((F.col("provider") == name) & (F.col("run") == run)).agg(F.count("*").alias("computed"))
        counts = once.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("rows"), F.count("*").alias("distinct"))
        return counts.crossJoin(computed).select("rows", "distinct", (F.col("distinct") - F.col("computed")).alias("known"), "computed")  # a row each

    def of(self, texts: DataFrame, provider: Provider) -> DataFrame:
        """texts with their vectors; null where there is none."""
        found = self.vectors(provider)
        return texts.withColumn("_digest", F.sha2("text", 256)).join(found, F.col("_digest") == found["digest"], "left").drop("_digest", "digest")


def hybrid(passages: DataFrame, queries: DataFrame, k: int = 6, constant: int = 60, per_doc: int = 2, least_cosine: float = 0.0, least_score: float = 0.0, texts: DataFrame | None = None, bare: float = 0.0) -> DataFrame:
    """query_id, position, id, doc_id, score, cosine, found_by, terms: a ranking by terms and one by vectors, fused, gated, made diverse.

    passages: id, doc_id, text, vector; queries: query_id, text, vector. Each ranking gives its best 3 k. The
    gate keeps what is at least so like the query, by cosine; without a query vector there is nothing to
    gate by, and terms alone decide. Equal scores: by the ranking of terms, then of vectors.
    texts: id, doc_id, text of the same passages, where these come without a join; then no text is moved for its vector.
    bare: the cosine of vectors without length; NaN comes first and passes the gate.
    """
    texts = passages if texts is None else texts
    words = retrieval.bm25_top(texts.select("id", "text"), queries.select("query_id", "text"), 3 * k).where(F.col("score") > least_score)
    near = retrieval.cosine_top(passages.where("vector IS NOT NULL").select("id", "vector"), queries.where("vector IS NOT NULL").select("query_id", "vector"), 3 * k, bare=bare)
    both = retrieval.fused(words, near, constant).join(words.select("query_id", "id", "terms"), ["query_id", "id"], "left")
    # at most 6 k of each query of a stated set: they go to the passages, not these to them
    like = passages.select("id", "vector").join(F.broadcast(both), "id").join(F.broadcast(queries.select("query_id", F.col("vector").alias("_asked"))), "query_id")
    like = like.withColumn("cosine", F.when(F.col("vector").isNotNull() & F.col("_asked").isNotNull(), retrieval.cosine(F.col("vector"), F.col("_asked"), bare))).drop("vector", "_asked")
    if least_cosine > 0:
        like = like.where(F.col("cosine").isNull() | (F.col("cosine") >= least_cosine))
    order = Window.partitionBy("query_id").orderBy(F.round("score", 9).desc(), F.asc_nulls_last("ra"), F.asc_nulls_last("rb"))
    read = texts.select("id", "doc_id", "text").join(F.broadcast(like), "id").withColumn("words", F.array_distinct(E.tokens(F.col("text"), "lexemes"))).drop("text")
    ranked = read.withColumn("rank", F.row_number().over(order))
    chosen = retrieval.diverse(ranked.select("query_id", "rank", "id", "doc_id", "words"), k, per_doc)
    return chosen.join(ranked.select("query_id", "id", "score", "cosine", "found_by", "terms"), ["query_id", "id"]).select("query_id", "position", "id", "doc_id", "score", "cosine", "found_by", "terms")


def cosine_sweep(best: DataFrame, gates: list[float]) -> DataFrame:
    """library, gate, kept, total: queries whose best passage would pass each gate; a null library is all of them.

    best: query_id, library, cosine of each query's best passage; a query without one has 0.
    """
    # a grid that the caller writes down
    rows = best.select("library", F.coalesce("cosine", F.lit(0.0)).alias("cosine"), F.explode(F.array(*(F.lit(float(g)) for g in gates))).alias("gate"))
    sets = rows.groupingSets([["library", "gate"], ["gate"]], "library", "gate")
    return sets.agg(F.count_if(F.col("cosine") >= F.col("gate")).alias("kept"), F.count("*").alias("total"))
