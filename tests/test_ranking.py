"""The best of each query, kept by each task alone, is what ranking all scores gives."""

from __future__ import annotations

import numpy as np
import pytest
from pyspark.sql import functions as F

import __spark_entry__
from attestra.operators import ranking, reports, retrieval


def frames(spark):
    rng = np.random.default_rng(3)
    words = np.array([f"w{i}" for i in range(40)] + ["on-call", "é"])
    texts = [" ".join(words[rng.zipf(1.5, int(n)) % 42]) for n in rng.integers(0, 30, 300)] + ["w1 w2 w3"] * 60 + [None, "", "!"]
    docs = spark.createDataFrame(list(enumerate(texts)), "id long, text string").repartition(5)
    queries = spark.createDataFrame([(i, " ".join(words[rng.integers(0, 42, 6)])) for i in range(9)] + [(50, "nowhere"), (51, None), (52, "w1 w1 w2")], "query_id long, text string")
    return docs, queries


def small(monkeypatch):
    for name, value in (("PASS", 4), ("CELLS", 30), ("PAIRS", 7)):
        monkeypatch.setattr(ranking, name, value)
    monkeypatch.setattr(ranking.blocks, "__defaults__", (4,))


@pytest.mark.parametrize("few", [False, True])
@pytest.mark.parametrize("best,scores", [("bm25_top", "bm25"), ("lexical_top", "lexical")])
def test_terms(spark, monkeypatch, few, best, scores):
    if few:
        small(monkeypatch)
    docs, queries = frames(spark)
    show = lambda df: {(r.query_id, r["rank"]): (r.id, round(r.score, 8), r.terms) for r in df.collect()}
    want = show(retrieval.top(getattr(retrieval, scores)(docs, queries), 7))
    assert show(getattr(retrieval, best)(docs, queries, 7)) == want and len(want) > 60
    named = queries.select(F.concat(F.lit("q"), "query_id").alias("query_id"), "text")
    assert getattr(retrieval, best)(docs.select(F.concat(F.lit("d"), "id").alias("id"), "text"), named, 2).where("query_id = 'q52'").count() == 2
    assert getattr(retrieval, best)(docs.limit(0), queries, 3).count() == getattr(retrieval, best)(docs, queries.limit(0), 3).count() == 0


@pytest.mark.parametrize("few", [False, True])
def test_labels_and_keys(spark, monkeypatch, few):
    if few:
        small(monkeypatch)
    items = [(i, ["a", None] if i % 7 == 0 else ["b"] if i % 5 else None, f"alpha beta{i % 3} gamma{i % 4}" if i % 6 else None, i % 3, (i % 4) * 2) for i in range(120)]
    asked = [(1, "a", "alpha beta1"), (2, "b", None), (3, None, "gamma2 beta0 zzz"), (4, "x", ""), (5, "a", "beta2")]
    want = {}
    for q, key, text in asked:
        rows = []
        for i, keys, t, tier, bonus in items:
            shared = len(set((text or "").split()) & set((t or "").split()))
            if shared or (key is not None and key in (keys or [])):
                rows.append((-(8 * (key is not None and key in (keys or [])) + shared + bonus), tier, -i))
        want |= {(q, n): (-i, -s) for n, (s, _, i) in enumerate(sorted(rows)[:5], 1)}
    frame = spark.createDataFrame(items, "id long, keys array<string>, text string, tier int, bonus int").repartition(4)
    got = retrieval.overlap_rank(frame, spark.createDataFrame(asked, "query_id long, key string, text string"))
    assert {(r.query_id, r["rank"]): (r.id, r.score) for r in got.collect()} == want


def test_vectors(spark, monkeypatch):
    rng = np.random.default_rng(5)
    rows = [(i, [float(x) for x in rng.integers(0, 3, 4)]) for i in range(200)] + [(200, None), (201, [1.0])]
    frame = spark.createDataFrame(rows, "id long, vector array<double>").repartition(3)
    queries = frame.where("id % 20 = 0").withColumnRenamed("id", "query_id")
    show = lambda df: {(r.query_id, r["rank"]): (r.id, round(r.score, 9)) for r in df.collect()}
    every = frame.crossJoin(queries.withColumnRenamed("vector", "v")).withColumn("score", F.when(F.size("vector") == F.size("v"), retrieval.cosine(F.col("vector"), F.col("v"))).otherwise(0.0))
    want = show(retrieval.top(every.select("query_id", "id", "score"), 5))
    assert show(retrieval.cosine_top(frame, queries, 5)) == want
    monkeypatch.setattr(retrieval, "PASS", 3)
    monkeypatch.setattr(ranking, "CELLS", 8)
    assert show(retrieval.cosine_top(frame, queries, 5)) == want


@pytest.mark.parametrize("name", ["bm25_topk", "lexical_topk", "gated_topk", "ratio_sweep", "rrf_fusion", "token_overlap_rank", "memories_for_challenger", "threshold_trace"])
def test_matches_are_no_rows(spark, name):
    """What matches a query is neither exploded nor joined: the plan holds no row for each match."""
    plan = __spark_entry__.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
    assert "MapInArrow" in plan and "Generate explode(regexp" not in plan and plan.count("Generate") <= (name == "ratio_sweep")


def test_hybrid_moves_no_text(spark, tmp_path):
    """Passages stay where they are when those that were found are read again."""
    plan = __spark_entry__.queries()["hybrid_topk"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert not [x for x in plan.split("\n") if "Exchange hashpartitioning(id" in x]


def test_best_cosine_is_the_greatest(spark):
    """Of scores that round alike, the greatest passes a gate that the one of least id doesn't; a cosine of 0.8 is 0.8."""
    rows = [(1, [0.8 - 2e-11, 0.6]), (2, [4.0, 3.0]), (3, [0.0, 1.0])]
    found = retrieval.cosine_top(spark.createDataFrame(rows, "id long, vector array<double>"), spark.createDataFrame([(9, [7.0, 0.0])], "query_id long, vector array<double>"), 1, None).first()
    assert (found.id, found.score) == (2, 0.8)


def test_scores_are_rounded_as_numbers(spark):
    """169.24405 is a little less than that, as SQL sees it."""
    scores = spark.createDataFrame([(1, 5, 169.24405, 1)], "query_id long, id long, score double, rank int")
    assert reports.threshold_trace(scores, spark.createDataFrame([(1, 0, "a")], "query_id long, library int, text string"), 6, 10).first().score == 169.244


def test_scores_of_vectors_without_length(spark):
    """They come first where their score is NaN; missing vectors and those of another length are 0 all the same."""
    rows = spark.createDataFrame([(1, [3.0, 4.0]), (2, [0.0, 0.0]), (3, None), (4, [0.0]), (5, [0.0, 0.0])], "id long, vector array<double>").repartition(2)
    queries = spark.createDataFrame([(7, [1.0, 0.0]), (8, [0.0, 0.0]), (9, None)], "query_id long, vector array<double>")
    show = lambda k, *more: {(r.query_id, r["rank"]): (r.id, str(r.score)) for r in retrieval.cosine_top(rows, queries, k, *more).collect()}
    assert [show(4, 9, float("nan"))[7, i] for i in (1, 2, 3, 4)] == [(2, "nan"), (5, "nan"), (1, "0.6"), (3, "0.0")]
    assert [show(4, 9, float("nan"))[8, i] for i in (1, 2, 3, 4)] == [(1, "nan"), (2, "nan"), (5, "nan"), (3, "0.0")]
    assert show(1, None, float("nan")) == {(7, 1): (2, "nan"), (8, 1): (1, "nan"), (9, 1): (1, "0.0")} and show(1) == {(7, 1): (1, "0.6"), (8, 1): (1, "0.0"), (9, 1): (1, "0.0")}
