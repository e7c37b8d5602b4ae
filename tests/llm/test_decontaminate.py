from __future__ import annotations

import hashlib
import re

import pytest

from attestra.llm import decontaminate
from attestra.llm.common import table

from .conftest import DATA


def words(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


def brute(docs, items):
    windows = {}
    for key, text in items:
        w = words(text)
        k = min(10, len(w))
        for i in range(len(w) - k + 1 if k else 0):
            windows.setdefault(tuple(w[i : i + k]), set()).add(str(key) if key is not None else "")
    lengths = {len(w) for w in windows}
    out = []
    for key, text in docs:
        w, hit, found = words(text), set(), set()
        for k in lengths:
            for i in range(len(w) - k + 1):
                got = windows.get(tuple(w[i : i + k]))
                if got:
                    hit.update(range(i, i + k))
                    found |= got
        out.append((key, len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit)))
    return sorted(out, key=str)


def check(docs, items, **options):
    got = sorted((tuple(r) for r in decontaminate.contamination(docs, items, **options).collect()), key=str)
    want = brute([(r.doc_id, r.text) for r in docs.collect()], [(r.item_id, r.text) for r in items.collect()])
    assert got == want
    return got


@pytest.mark.parametrize("index_bytes", [1 << 30, 0])
def test_whole_table(spark, index_bytes):
    d = DATA.replace("0.001", "0.01") if index_bytes else DATA
    got = check(table(spark, d, "documents"), table(spark, d, "benchmark"), index_bytes=index_bytes)
    assert any(r[-1] for r in got) and not all(r[-1] for r in got)


@pytest.mark.parametrize("index_bytes", [1 << 30, 0])
def test_edges(spark, edge_docs, index_bytes):
    items = [
        (1, "quick brown fox"),
        (2, "Fox, jumps over the lazy dog and runs far away from here"),
        (2, "one"),
        (3, None),
        (4, ""),
        (5, "..."),
        (None, "two"),
        (6, "the the the the the the the the the the the the"),
        (7, " ".join(f"w{i * i % 7919}" for i in range(20000, 20100))),
    ]
    items = spark.createDataFrame(items, "item_id long, text string")
    more = spark.createDataFrame([(20, "the " * 30), (21, "lazy the the the the the the the the the the dog")], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(more)
    check(docs, items, index_bytes=index_bytes)
    check(docs, items.limit(0), index_bytes=index_bytes)
    check(docs.limit(0), items, index_bytes=index_bytes)
