"""Operators 11 to 13 against plain versions."""

from __future__ import annotations

import random
import re
import zlib
from collections import Counter, defaultdict

import duckdb
import numpy as np
import pyarrow as pa
import pytest

from attestra.llm import collocations, ngram_join, oracles, spelling
from attestra.llm.common import table, text_buffer

from .conftest import DATA


def lowered(text):
    return re.sub("[A-Z]", lambda m: m[0].lower(), text or "")


def rows_of(df):
    return sorted((tuple(r) for r in df.collect()), key=str)


# -- spelling ------------------------------------------------------------------------------------


def near(a, b):
    if len(a) > len(b):
        a, b = b, a
    if len(a) == len(b):
        return sum(x != y for x, y in zip(a, b)) == 1
    return len(a) + 1 == len(b) and any(b[:i] + b[i + 1 :] == a for i in range(len(b)))


def plain_variants(rows, noise=True):
    n = Counter()
    for key, text in rows:
        for run in re.findall("[A-Za-zÀ-ÿ]+", text or ""):
            run = lowered(run)
            h = zlib.crc32(f"{'' if key is None else key}:{run}".encode())
            if noise and h % 31 == 0:
                run = run[: h % len(run)] + run[h % len(run) + 1 :]
            if len(run) >= 7:
                n[run] += 1
    n = {w: k for w, k in n.items() if k >= 2}
    by = defaultdict(list)
    for w in n:
        by[len(w)].append(w)
    form, count = {}, {}
    for w in n:
        found = [x for k in (-1, 0, 1) for x in by[len(w) + k] if x != w and near(w, x)]
        count[w] = len(found)
        best = min(found, key=lambda x: (-n[x], x), default=None)
        form[w] = best if best is not None and n[best] >= 10 * n[w] else None

    def root(w):
        return w if form[w] is None else root(form[w])

    return sorted(((w, form[w], root(w), n[w], count[w], n[form[w]] if form[w] else None) for w in n), key=str)


def word_docs(spark, seed, times):
    r = random.Random(seed)
    words = ["".join(r.choice("abcdeéxñ") for _ in range(r.randint(7, 12))) for _ in range(60)]
    for w in words[:60]:
        for _ in range(6):
            k = r.randrange(len(w))
            words.append(r.choice([w[:k] + w[k + 1 :], w[:k] + r.choice("abé") + w[k:], w[:k] + r.choice("abé") + w[k + 1 :], w + w[-1], w[0] + w]))
    weights = [times if i < 60 else r.choice([1, 2, 3]) for i in range(len(words))]
    texts = [r.choices(words, weights, k=80) for _ in range(60)]
    rows = [(i, " ".join(w.upper() if r.random() < 0.1 else w for w in x)) for i, x in enumerate(texts)]
    rows += [(None, "Abcdefgh abcdefgh abcdefg"), (3, rows[3][1]), (7, None), (8, ""), (9, "×÷àÿ×÷àÿ ×÷àÿ×÷àÿ " + "longword" * 400 + " " + "longword" * 400 + "x " + "longword" * 400 + " " + "longword" * 400 + "x")]
    return rows, spark.createDataFrame(rows, "doc_id long, text string")


@pytest.mark.parametrize("hot", [spelling.HOT, 0, 30])
def test_variants_of_words(spark, monkeypatch, hot):
    monkeypatch.setattr(spelling, "HOT", hot)
    rows, docs = word_docs(spark, 4, 30)
    got = rows_of(spelling.variants(docs))
    assert got == plain_variants(rows)
    assert any(r[1] for r in got) and any(r[4] > 3 for r in got)


def test_chain_of_forms(spark):
    words = {"abcdefgh": 1500, "abcdefgx": 120, "abcdefyx": 11, "abcdezyx": 1}
    rows = [(1, " ".join(w for w, n in words.items() for _ in range(n * 2)))]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    assert rows_of(spelling.variants(docs, noise=False)) == plain_variants(rows, noise=False)
    assert {r.root for r in spelling.variants(docs, noise=False).collect()} == {"abcdefgh"}


def test_index_meets_every_near_pair():
    r = random.Random(6)
    words = {"".join(r.choice("ab") for _ in range(r.randint(7, 11))) for _ in range(400)}  # grams repeat within words
    words = sorted(words)
    numbers, bounds = spelling.letters(pa.array(words))
    gram = spelling.grams(numbers, bounds)[0]
    count = np.bincount(gram, minlength=spelling.BASE**spelling.Q)
    place = np.empty(len(count), np.int64)
    place[np.argsort(count, kind="stable")] = np.arange(len(count))
    for often in (np.zeros(len(count), bool), np.ones(len(count), bool), count > 20):
        posts = defaultdict(lambda: ([], []))
        for key, asks, who in zip(*(x.tolist() for x in spelling.posted(numbers, bounds, place, often))):
            posts[key][asks].append(who)
        met = {(min(x, y), max(x, y)) for held, asking in posts.values() for x in held for y in [*held, *asking] if x != y}
        assert {(i, j) for i in range(len(words)) for j in range(i + 1, len(words)) if near(words[i], words[j])} <= met


def test_variants_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows_of(spelling.variants(edge_docs)) == plain_variants(rows)
    assert spelling.variants(edge_docs.limit(0)).count() == 0


# -- n-gram Jaccard join -------------------------------------------------------------------------


def shingles(text, k=3):
    words = re.findall(r"[^\x20\x09-\x0D]+", lowered(text))
    return {tuple(words[i : i + k]) for i in range(max(1, len(words) - k + 1))} if words else set()


def plain_join(rows, share=90):
    sets, root = [shingles(t) for _, t in rows], list(range(len(rows)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    for i in range(len(rows)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= share * len(sets[i] | sets[j]):
                root[find(i)] = find(j)
    least = {}
    for i, (k, _) in enumerate(rows):
        if k is not None:
            least[find(i)] = min(k, least.get(find(i), k))
    return sorted(((k, len(s), least.get(find(i))) for i, ((k, _), s) in enumerate(zip(rows, sets))), key=str)


def near_copies(seed, groups, copies, passage=""):
    r = random.Random(seed)
    texts = []
    for _ in range(groups):
        words = [f"w{r.randrange(400)}" for _ in range(r.randint(3, 160))]
        for _ in range(r.randint(1, copies)):
            x = list(words)
            for _ in range(r.randint(0, 3)):
                x[r.randrange(len(x))] = f"v{r.randrange(400)}"
            texts.append(" ".join(x) + passage)
    r.shuffle(texts)
    return [(i, t) for i, t in enumerate(texts)]


def test_join_of_near_copies(spark):
    rows = near_copies(1, 40, 12) + near_copies(2, 30, 3, " " + " ".join(f"p{i}" for i in range(60)))
    rows = [(i, t) for i, (_, t) in enumerate(rows)]
    assert rows_of(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(5))) == plain_join(rows)


def test_join_in_blocks(spark, monkeypatch):
    """A group that is compared block by block, and one column that many unlike rows have."""
    monkeypatch.setattr(ngram_join, "BLOCK", 8)
    monkeypatch.setattr(ngram_join, "BLOCK_BYTES", 4000)
    r = random.Random(3)
    rows = near_copies(3, 3, 60)
    rows += [(1000 + i, f"same old words {' '.join(f'u{r.randrange(30)}' for _ in range(r.randint(0, 4)))}") for i in range(120)]
    assert rows_of(ngram_join.jaccard_join(spark.createDataFrame(rows, "doc_id long, text string").repartition(6))) == plain_join(rows)


def test_digests_that_share_their_first_half(spark):
    a, b, c = b"a" * 8 + b"c" * 8, b"a" * 8 + b"b" * 8, bytes(range(250, 256)) * 2 + b"zzzz"
    frame = spark.createDataFrame([(a,), (b,), (c,)], "node binary")
    other = ngram_join.clashes(frame)
    assert set(other) == {a, b} and len(set(ngram_join.named([a, b, c], other))) == 3
    ids = {bytes(r.node): r.id for r in frame.select("node", ngram_join._id("node").alias("id")).collect()}
    assert [ids[c], ids[a]] == ngram_join.named([c, a], {})
    assert ngram_join.clashes(frame.where("node <> X'" + b.hex() + "'")) == {}


def test_leading_columns_meet():
    r = np.random.default_rng(2)
    order = r.integers(0, 5, ngram_join.SLOTS).astype(np.uint8)
    for _ in range(300):
        n = int(r.integers(1, 400))
        a = np.unique(r.integers(0, 1 << 63, n, np.uint64))
        b = a.copy()
        b[r.permutation(len(a))[: int(r.integers(0, 1 + len(a) // 15))]] = r.integers(0, 1 << 63, 1, np.uint64)
        b = np.concatenate([b, r.integers(0, 1 << 63, int(r.integers(0, 2 + n // 20)), np.uint64)])
        b = np.unique(b)
        if 100 * len(np.intersect1d(a, b)) >= 90 * len(np.union1d(a, b)):
            found = [set(ngram_join.leading(x, np.array([0, len(x)]), order, 90)[0].tolist()) for x in (a, b)]
            assert found[0] & found[1]


def test_classes_of_linked_sizes_are_neighbours():
    for n in range(1, 4000):
        sizes = np.arange(n, 100 * n // 90 + 1)
        assert set((ngram_join.classes(sizes, 90) - ngram_join.classes(np.array([n]), 90)).tolist()) <= {0, 1}


def test_folded_rows_bound_overlaps():
    r = np.random.default_rng(5)
    pool = r.integers(0, 1 << 64, 3600, np.uint64)
    sets = [np.unique(r.choice(pool, int(r.integers(1, 3600)), replace=False)) for _ in range(60)]
    folded, size = ngram_join.outlines(*ngram_join._laid(sets)), np.array([len(x) for x in sets])
    likely = ngram_join._likely(30)
    for i in range(60):
        j = np.arange(60)
        found = likely(folded[np.full(60, i)], size[np.full(60, i)], folded, size)
        linked = np.array([100 * len(np.intersect1d(sets[i], sets[k])) >= 30 * len(np.union1d(sets[i], sets[k])) for k in j])
        assert not (linked & ~found).any()


@pytest.mark.parametrize("columns", [64, 1 << 16])
def test_product_of_blocks(monkeypatch, columns):
    monkeypatch.setattr(ngram_join, "COLUMNS", columns)
    r = np.random.default_rng(9)
    base = [r.integers(0, 1 << 64, 200, np.uint64) for _ in range(4)]
    sets = [np.unique(np.concatenate([b[: 200 - int(k)], r.integers(0, 1 << 64, int(r.integers(0, 14)), np.uint64)])) for b in base for k in r.integers(0, 20, 15)] + [base[0][:1]]
    apart = r.integers(0, 2, len(sets))
    for blocks in (None, apart):
        want = {(i, j) for i in range(len(sets)) for j in range(i + 1, len(sets)) if (blocks is None or blocks[i] != blocks[j]) and 100 * len(np.intersect1d(sets[i], sets[j])) >= 90 * len(np.union1d(sets[i], sets[j]))}
        got = ngram_join.product(*ngram_join._laid(sets), blocks, 90)
        assert set(got) <= want and 0 < len(got) < len(sets)

        def joined(links):
            root = list(range(len(sets)))
            for _ in sets:
                for i, j in links:
                    root[i] = root[j] = min(root[i], root[j])
            return root

        assert joined(got) == joined(want)


def test_walk_finds_all_that_may_be_linked():
    r = np.random.default_rng(4)
    place = r.random(80)
    likely = lambda a, _, b, __: np.abs(a[:, 0] - b[:, 0]) < 0.02
    root, apart = r.integers(0, 12, 80), r.integers(0, 2, 80)
    for blocks in (None, apart):
        links = [(i, j) for i, found in ngram_join.reached(place[:, None], np.ones(80), root, blocks, likely) for j in found.tolist()]
        want = [(i, j) for i in range(80) for j in range(80) if abs(place[i] - place[j]) < 0.02 and root[i] != root[j] and (blocks is None or blocks[i] != blocks[j])]

        def joined(pairs):
            at = list(range(80))
            for _ in range(80):
                for i, j in pairs:
                    at[i] = at[j] = min(at[i], at[j])
            return at

        assert joined(links) == joined(want)


def test_counters_add_up_in_steps(spark, monkeypatch):
    monkeypatch.setattr(ngram_join, "TOGETHER", 2)
    docs = table(spark, DATA, "documents").select("doc_id", "text").repartition(9)
    counters = ngram_join.sketches(docs, 3).where("n_shingles IS NULL").select("outline")
    want = sum(np.frombuffer(r.outline, np.uint32).astype(float) for r in counters.collect())
    assert (ngram_join.frequencies(counters) == np.log2(want + 1).astype(np.uint8)).all()


def test_join_edges(spark, edge_docs):
    rows = [(r.doc_id, r.text) for r in edge_docs.collect()]
    assert rows_of(ngram_join.jaccard_join(edge_docs)) == plain_join(rows)
    assert ngram_join.jaccard_join(edge_docs.limit(0)).count() == 0


# -- collocations --------------------------------------------------------------------------------


def plain_collocations(rows, least=30, share=80, top=2000):
    counts, total = defaultdict(Counter), Counter()
    for text, lang in rows:
        lang = "und" if lang is None else lang
        for piece in re.split("[.,;:!?\x0a-\x0d]", lowered(text)):
            words = re.findall("[^\x20\x09]+", piece)
            total[lang] += len(words)
            for k in range(1, 5):
                for i in range(len(words) - k + 1):
                    counts[lang][tuple(words[i : i + k])] += 1
    out = []
    for lang, f in counts.items():
        kept = {p: a for p, a in f.items() if len(p) > 1 and a >= least}
        held = Counter()
        for p, a in kept.items():
            for m in range(2, len(p)):
                for i in range(len(p) - m + 1):
                    held[p[i : i + m]] = max(held[p[i : i + m]], a)
        scored = []
        for p, a in kept.items():
            if 100 * held[p] < share * a:
                score, k = min((2000000 * a // (f[p[:k]] + f[p[k:]]), k) for k in range(1, len(p)))
                scored.append((-score, -a, " ".join(p).encode(), f[p[:k]], f[p[k:]]))
        for i, (s, a, p, left, right) in enumerate(sorted(scored)[:top]):
            out.append((lang, i + 1, p.decode(), -a, left, right, total[lang], -s))
    return sorted(out, key=str)


def phrase_docs(spark, seed):
    r = random.Random(seed)
    rows = []
    for i in range(120):
        words = r.choices(["New York", "the", "of the", "in spite of", "x", "y", "z w", "ÉTÉ", "a,b", "é;", "two\tthree  four", "\n", "!"], [4, 9, 5, 3, 2, 2, 2, 2, 2, 1, 3, 1, 1], k=r.randint(0, 90))
        rows.append((" ".join(words), r.choice(["en", "fr", None, "und"])))
    rows += [(None, "en"), ("", None), ("word " * 5000, "xx"), ("Hello. " * 40, "yy"), ("a b c d. " * 31, "zz")]
    return rows, spark.createDataFrame(rows, "text string, lang string")


@pytest.mark.parametrize("sizes", [(collocations.SHARD, collocations.STEP), (50, 200)])
def test_collocations(spark, monkeypatch, sizes):
    monkeypatch.setattr(collocations, "SHARD", sizes[0])
    monkeypatch.setattr(collocations, "STEP", sizes[1])
    rows, docs = phrase_docs(spark, 3)
    assert rows_of(collocations.collocations(docs)) == plain_collocations(rows)
    assert rows_of(collocations.collocations(docs, least=5, share=60, top=7)) == plain_collocations(rows, 5, 60, 7)


def test_intervals_are_counts():
    r = random.Random(8)
    texts = [" ".join(r.choices("a b c d. e".split(), k=r.randint(0, 60))) for _ in range(30)]
    shard = collocations.Shard()
    data, offsets = text_buffer(pa.array(texts))
    shard.add(data, offsets, np.arange(30) % 2)
    shard.closed()
    want = Counter()
    for i, text in enumerate(texts):
        for piece in text.split("."):
            w = piece.split()
            want.update((i % 2, " ".join(w[x : x + k])) for k in range(1, 5) for x in range(len(w) - k + 1))
    got = {}
    for k, at, n in shard.intervals(4):
        assert not (keys := list(zip(shard.lang[at].tolist(), shard.phrases(at, k).to_pylist()))) or not set(keys) & set(got)
        got.update(zip(keys, n.tolist()))
    assert got == dict(want)


def test_scores_beyond_64_bits(spark):
    a, l, r = 9 * 10**14, 10**15, 1 + 10**15
    row = spark.sql(f"SELECT (CAST({a} AS DECIMAL(28,0)) * {collocations.SCALE}) div (CAST({l} AS DECIMAL(28,0)) + CAST({r} AS BIGINT)) AS s").first()
    assert row.s == a * 2000000 // (l + r)


def test_collocations_edges(spark, edge_docs):
    rows = [(r.text, r.lang) for r in edge_docs.collect()]
    assert rows_of(collocations.collocations(edge_docs, least=2)) == plain_collocations(rows, 2)
    assert collocations.collocations(edge_docs.limit(0)).count() == 0


# -- SQL -----------------------------------------------------------------------------------------


@pytest.mark.parametrize("name", ["op11_spelling", "op12_jaccard_join", "op13_collocations"])
def test_queries_as_their_sql(spark, name):
    from attestra.llm import registry

    duck = duckdb.connect()
    duck.execute(f"CREATE VIEW documents AS SELECT * FROM '{DATA}/documents.parquet'")
    found = duck.execute(oracles.SQL[name])
    names = [d[0] for d in found.description]
    frame = registry.QUERIES[name](spark, DATA)
    assert sorted(frame.columns) == sorted(names)
    assert rows_of(frame.select(names)) == sorted(found.fetchall(), key=str)
