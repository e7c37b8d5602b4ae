"""The pipeline held against plain versions of its stages, whole tables and odd rows alike."""

from __future__ import annotations

import hashlib

import public_tokenizers
from pyspark.sql import functions as F
from tokenizers import Tokenizer

import corpus_pipeline
from attestra.llm import bpe_roundtrip, quality
from attestra.llm.common import table

from . import test_decontaminate, test_line_dedup, test_near_dup
from .conftest import DATA


def lines_cut(rows):
    """(doc_id, text) rows after line dedup; those of which nothing is left are gone."""
    cut = {}
    distinct = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    for (key, n, kept, text), row in zip(test_line_dedup.brute(rows, keep_order=True), distinct, strict=True):
        cut[row] = None if kept < n and not (text or "").strip() else (key, text)
    return [cut[r] for r in rows if cut[r] is not None]


def near_copies_cut(rows):
    """One row of each component: the least doc_id, null last; ties fall to any of equal rows."""
    judged = test_near_dup.brute([(i, t) for i, (_, t) in enumerate(rows)])
    root = {int(k): int(c) for k, _, c, _ in judged}
    groups = {}
    for i, (key, _) in enumerate(rows):
        groups.setdefault(root[i], []).append(((key is None, key or 0), i))
    best = {i for members in groups.values() for i in [min(members)[1]]}
    ties = {i for members in groups.values() for k, i in members if k == min(members)[0]}
    return best, ties


def contaminated(rows, items):
    return {i for i, _, n, *_ in test_decontaminate.brute([(i, t) for i, (_, t) in enumerate(rows)], items) if n}


def pairs(df):
    return sorted(((r.doc_id, r.text) for r in df.select("doc_id", "text").collect()), key=str)


def check(spark, docs, d):
    """Each stage on what the one before it kept, and the digests of the last."""
    library = Tokenizer.from_file(public_tokenizers.path(bpe_roundtrip.FILE))
    items = [(r.item_id, r.text) for r in table(spark, d, "benchmark").collect()]
    stages = dict(corpus_pipeline.STAGES)
    forest = quality.learnt(docs, table(spark, d, "labels"))
    good = {(r.doc_id, r.text) for r in docs.join(quality.scored(docs, forest).where("predicted = 1").select("doc_id").distinct(), "doc_id", "left_semi").select("doc_id", "text").collect()}
    kept = stages["quality_classifier"](spark, docs, d)
    before = pairs(kept)
    assert set(before) <= good | {r for r in before if r[0] is None}
    after = stages["line_dedup"](spark, kept, d)
    assert pairs(after) == sorted(lines_cut(before), key=str)
    rows = pairs(after)
    near = stages["minhash_near_dedup"](spark, after, d)
    best, ties = near_copies_cut(rows)
    got = pairs(near)
    assert len(got) == len(best) and all(x in [rows[i] for i in ties] for x in got)
    rows = got
    clean = stages["benchmark_decontamination"](spark, near, d)
    lost = contaminated(rows, items)
    assert pairs(clean) == sorted((r for i, r in enumerate(rows) if i not in lost), key=str)
    last = sorted((tuple(r) for r in stages["bpe_encoding"](spark, clean, d).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str)
    want = []
    for key, text in pairs(clean):
        ids = library.encode(text or "", add_special_tokens=False).ids
        sha = lambda x: hashlib.sha256(x.encode()).hexdigest()
        want.append((key, len(ids), sha(",".join(map(str, ids))), sha(library.decode(ids, skip_special_tokens=False))))
    assert last == sorted(want, key=str)
    return last


def test_whole_table(spark):
    docs = table(spark, DATA, "documents")
    last = check(spark, docs, DATA)
    assert sorted((tuple(r) for r in corpus_pipeline.run(spark, DATA).select("doc_id", "n_tokens", "ids_sha256", "decoded_sha256").collect()), key=str) == last


def test_odd_rows(spark, edge_docs):
    docs = edge_docs.withColumn("_key", F.lit(1)).withColumn("component_id", F.lit(2)).withColumn("at", F.lit("x"))
    again = table(spark, DATA, "documents").limit(40).withColumn("doc_id", F.col("doc_id") + 100)
    # repeated and null ids over texts that share no line: which of those comes first isn't defined
    own = lambda n, w: " ".join(f"{w}{i * i % 97}" for i in range(n))
    more = spark.createDataFrame([(3, own(60, "p")), (3, own(70, "q")), (None, own(80, "r")), (3, own(60, "p").replace("p4 ", "p5x ", 1))], "doc_id long, text string")
    both = docs.unionByName(again.select("doc_id", "text"), allowMissingColumns=True).unionByName(more, allowMissingColumns=True)
    check(spark, both.cache(), DATA)
