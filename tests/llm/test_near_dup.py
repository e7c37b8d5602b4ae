from __future__ import annotations

import random
import re

import numpy as np

from attestra.llm import near_dup, stars
from attestra.llm.common import table
from attestra.llm.components import components, joined

from .conftest import DATA


def shingles(text):
    words = re.findall(r"[^\x20\x09-\x0D]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))
    if len(words) < 5:
        return {tuple(words)} if words else set()
    return {tuple(words[i : i + 5]) for i in range(len(words) - 4)}


def brute(rows):
    sets = [shingles(t) for _, t in rows]
    root = list(range(len(rows)))

    def find(i):
        while root[i] != i:
            root[i] = root[root[i]]
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for x in s:
            where.setdefault(x, []).append(i)
    pairs = {(a, b) for x in where.values() for k, a in enumerate(x) for b in x[k + 1 :]}
    for a, b in pairs:
        if 100 * len(sets[a] & sets[b]) >= 75 * len(sets[a] | sets[b]):
            root[find(a)] = find(b)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i)), k == least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def run(docs, **options):
    return sorted((tuple(r) for r in near_dup.near_duplicates(docs, **options).collect()), key=str)


def check(docs):
    rows = [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()]
    assert run(docs) == brute(rows)


def test_whole_table(spark):
    check(table(spark, DATA.replace("0.001", "0.01"), "documents"))


def test_edges(spark, edge_docs):
    check(edge_docs)
    check(edge_docs.limit(0))


def test_hot_group_of_near_copies(spark, monkeypatch):
    r = random.Random(3)
    base = [f"w{i}" for i in range(120)]
    rows = []
    for i in range(400):
        words = list(base)
        for _ in range(r.choice([1, 2, 3, 4, 6])):
            words[r.randrange(len(words))] = f"x{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(stars, "BLOCK", 64)
    monkeypatch.setattr(stars, "BLOCK_BYTES", 20_000)
    monkeypatch.setattr(stars, "HUB", 30)
    monkeypatch.setattr(near_dup, "GATHER", 500)
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_chain_of_links(spark):
    words = [f"w{i}" for i in range(400)]
    rows = [(100 - i, " ".join(words[i * 8 : i * 8 + 120])) for i in range(30)]
    check(spark.createDataFrame(rows, "doc_id long, text string"))


def test_estimate_follows_similarity():
    r = np.random.default_rng(1)
    for share in (0.5, 0.75, 0.9):
        found = []
        for _ in range(20):
            n = 400
            common = int(2 * n * share / (1 + share))
            x = r.integers(0, 2**63, 2 * n).astype(np.uint64)
            a, b = x[:n], np.concatenate([x[:common], x[n : 2 * n - common]])
            s = near_dup.estimate(near_dup.registers(a)[None], near_dup.registers(b)[None], np.array([n]), np.array([n]))
            found.append(s[0])
        assert abs(np.mean(found) - share) < 0.03


def test_registers_merge():
    r = np.random.default_rng(2)
    a, b = (r.integers(0, 2**63, 100).astype(np.uint64) for _ in range(2))
    assert (near_dup.registers(np.concatenate([a, b])) == np.maximum(near_dup.registers(a), near_dup.registers(b))).all()


def test_components(spark):
    r = random.Random(5)
    links = [(r.randrange(300), r.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(1000, 1200)] + [(2000, i) for i in range(2001, 2200)]
    root = {}

    def find(x):
        while root.setdefault(x, x) != x:
            x = root[x]
        return x

    for a, b in links:
        x, y = sorted((find(a), find(b)))
        root[y] = x
    want = {x: find(x) for a, b in links if a != b for x in (a, b)}
    frame = spark.createDataFrame(links + [(5, None)], "u long, v long").repartition(5)
    fewer = frame.where("v IS NOT NULL").mapInArrow(joined, "u long, v long")
    for some in (frame, fewer):
        assert {x.node: x.root for x in components(some).collect()} == want
    text = spark.createDataFrame([(f"é{a}", f"é{b}") for a, b in links], "u string, v string")
    assert {(x.node, x.root) for x in components(text).collect()} == {(x.node, x.root) for x in components(text.mapInArrow(joined, "u string, v string")).collect()}


def test_alike_both_ways(monkeypatch):
    r = np.random.default_rng(8)
    pool = r.integers(0, 2**64, 300, dtype=np.uint64)
    sets = [r.choice(pool, r.integers(0, 60)) for _ in range(30)] + [pool[:200], pool[:160], pool[:150], pool[:0]]
    flat, bounds = np.concatenate(sets), np.concatenate([[0], np.cumsum(list(map(len, sets)))])
    i, j = (x.ravel() for x in np.meshgrid(np.arange(len(sets)), np.arange(len(sets))))
    want = [bool(a | b) and 100 * len(a & b) >= 75 * len(a | b) for a, b in ((set(sets[x]), set(sets[y])) for x, y in zip(i, j))]
    for outline, held in ((4096, 8_000_000), (64, 8_000_000), (64, 1000), (4096, 0)):
        monkeypatch.setattr(stars, "OUTLINE", outline)
        monkeypatch.setattr(stars, "OUTLINE_BYTES", held)
        monkeypatch.setattr(stars, "STEP_SETS", 100 if held else 500_000)
        assert stars.alike(flat, bounds, i, j, 75).tolist() == want
