from __future__ import annotations

import re

import pytest

from attestra.llm import line_dedup, stars
from attestra.llm.common import table

from .conftest import DATA


def normal(line):
    line = re.sub("[A-Z]", lambda m: m[0].lower(), line)
    return re.sub(r"[\t\x0b\x0c\r ]+", " ", line).strip(" ")


def brute(rows, keep_order=False):
    """(doc_id, text) of documents, repeated ones once -> their texts after dedup."""
    rows = sorted(set(rows), key=lambda r: (r[0] is not None, r[0] or 0, r[1] or ""))
    lines = [(i, j, normal(x)) for i, (_, t) in enumerate(rows) if t is not None for j, x in enumerate(t.split("\n"))]
    lines = [x for x in lines if len(x[2]) >= line_dedup.LEAST_CHARS]
    texts = sorted({x[2] for x in lines})
    sets = [{t[k : k + line_dedup.SHINGLE] for k in range(len(t) - line_dedup.SHINGLE + 1)} for t in texts]
    root = list(range(len(texts)))

    def find(i):
        while root[i] != i:
            i = root[i]
        return i

    where = {}
    for i, s in enumerate(sets):
        for g in s:
            where.setdefault(g, []).append(i)
    common = {}
    for w in where.values():
        for x, a in enumerate(w):
            for b in w[x + 1 :]:
                common[a, b] = common.get((a, b), 0) + 1
    for (a, b), n in common.items():
        if 100 * n >= 75 * (len(sets[a]) + len(sets[b]) - n):
            root[find(b)] = find(a)
    at = {t: find(i) for i, t in enumerate(texts)}
    seen, cut = set(), {}
    for i, j, t in lines:
        if at[t] in seen:
            cut.setdefault(i, set()).add(j)
        seen.add(at[t])
    out = []
    for i, (k, t) in enumerate(rows):
        kept = None if t is None else "\n".join(x for j, x in enumerate(t.split("\n")) if j not in cut.get(i, ()))
        out.append((k, 0 if t is None else t.count("\n") + 1, 0 if t is None else t.count("\n") + 1 - len(cut.get(i, ())), kept))
    return out if keep_order else sorted(out, key=str)


def run(docs):
    out = line_dedup.deduplicated(docs)
    assert out.columns[:-2] == docs.columns
    return sorted({(r.doc_id, r._lines, r._kept, r.text) for r in out.collect()}, key=str)


def test_whole_table(spark):
    docs = table(spark, DATA, "documents")
    got = run(docs)
    assert got == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert any(k < n for _, n, k, _ in got)


def test_edges(spark, edge_docs):
    long = "this line has more than thirty-two characters and comes again"
    more = spark.createDataFrame([(30, f"{long}\nshort\n{long.upper()}  \n\n"), (31, f"  {long.replace('again', 'agein')}\nshort"), (29, "first of all\n" + long), (None, long)], "doc_id long, text string")
    docs = edge_docs.select("doc_id", "text").union(more)
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])
    assert len(run(edge_docs)) == len({(r.doc_id, r.text) for r in edge_docs.collect()})
    assert run(edge_docs.limit(0)) == []


def test_hot_group_and_blocks(spark, monkeypatch):
    import random

    r = random.Random(4)
    base = [f"word{i}" for i in range(40)]
    rows = []
    for i in range(150):
        words = list(base)
        for _ in range(r.choice([0, 1, 2, 3, 5])):
            words[r.randrange(40)] = f"other{r.randrange(10**6)}"
        rows.append((i, " ".join(words)))
    monkeypatch.setattr(stars, "BLOCK", 16)
    monkeypatch.setattr(stars, "BLOCK_BYTES", 10_000)
    monkeypatch.setattr(stars, "HUB", 10)
    monkeypatch.setattr(line_dedup, "GATHER", 100)
    docs = spark.createDataFrame(rows, "doc_id long, text string").repartition(4)
    got, want = run(docs), brute(rows)
    # banding may miss a link near the threshold: none here is lost to buckets or blocks
    assert sum(g != w for g, w in zip(got, want)) <= 2


@pytest.mark.parametrize("text", ["", "\n", "a\n", "\n\nb", "x" * 40 + "\n" + "x" * 40])
def test_lines_of_small_texts(text):
    from attestra.llm.common import text_buffer
    import pyarrow as pa

    data, offsets = text_buffer(pa.array([text, None, text + "é" * 33, ""]))
    x = line_dedup.Lines(data, offsets)
    want = [normal(p) for t in (text, "", text + "é" * 33, "") for p in t.split("\n")]
    assert ["".join(map(chr, x.points[a:b])) for a, b in zip(x.starts, x.ends)] == want


def test_short_lines(spark):
    docs = spark.createDataFrame([(1, "}\nend\nRelease 1.0\n"), (2, " }\nEND\n\nrelease 1.0"), (3, "End of it\n}")], "doc_id long, text string")
    assert {(r.doc_id, r._kept, r.text) for r in line_dedup.deduplicated(docs).collect()} == {(1, 4, "}\nend\nRelease 1.0\n"), (2, 1, ""), (3, 1, "End of it")}


def test_few_pairs_are_missed_by_bands():
    np, n = line_dedup.np, 5000
    r = np.random.default_rng(3)
    h = r.integers(0, 2**64, (n, 40), dtype=np.uint64)  # 30 shingles in common of 40: similarity 0.75

    def keys(h):
        x = line_dedup.Lines.__new__(line_dedup.Lines)
        x.grams, x.starts = h.ravel(), np.arange(len(h)) * h.shape[1]
        x.ends = x.starts + h.shape[1] + line_dedup.SHINGLE - 1
        return line_dedup.band_keys(x.signatures(np.arange(len(h)))[0])

    a, b = keys(h[:, :35]), keys(np.concatenate([h[:, :30], h[:, 35:]], axis=1))
    assert (~(a == b).any(axis=1)).sum() <= 3


def test_every_pair_of_a_bucket(spark, monkeypatch):
    """A bucket's first line g is like x, x isn't like the first line w of its task, g isn't like w."""

    def three(salt):
        long, other = ([f"{i:02d}{w}" for i in range(40)] for w in (f"abcdefg{salt}", f"ijklmno{salt}"))
        line = lambda a, b: "".join([*other[:a], *long[a : 40 - b], *other[40 - b :]])
        g, x, w = line(4, 0), line(0, 0), line(0, 4)
        return [(int(line_dedup.Lines(*_buffer(t)).ids[0]), t) for t in (g, x, w)]

    # x has the greatest id, so that it is the first line of no task it shares
    found = next(t for t in map(three, "abcdefghijklmnopqrstuvwxyz") if t[1] == max(t))
    (a, x, w), texts = [t for _, t in found], [t for _, t in sorted(found)]
    monkeypatch.setattr(line_dedup, "band_keys", lambda rows: line_dedup.np.zeros((len(rows), 1), line_dedup.np.uint64))
    monkeypatch.setattr(line_dedup, "BANDS", 1)
    monkeypatch.setattr(line_dedup, "ROWS", line_dedup.BINS)
    monkeypatch.setattr(line_dedup.Lines, "signatures", lambda self, some: (line_dedup.np.zeros((len(some), line_dedup.BINS), line_dedup.np.uint16), line_dedup.np.full(len(some), line_dedup.BINS)))
    sets = lambda t: {t[k : k + 8] for k in range(len(t) - 7)}
    alike = lambda p, q: len(sets(p) & sets(q)) / len(sets(p) | sets(q)) >= 0.75
    assert alike(a, x) and alike(x, w) and not alike(a, w)
    for deal in ([[0], [1, 2]], [[0, 1], [2]]):
        slots = [(10 * task + i, texts[i]) if i in members else (99, None) for task, members in enumerate(deal) for i in range(3)]
        docs = spark.createDataFrame(spark.sparkContext.parallelize(slots, len(deal)), "doc_id long, text string")
        assert docs.rdd.getNumPartitions() == len(deal)
        assert sum(r._kept for r in line_dedup.deduplicated(docs).collect()) == 1, deal


def _buffer(text):
    from attestra.llm.common import text_buffer
    import pyarrow as pa

    return text_buffer(pa.array([text]))


def test_filter_forgets_nothing(monkeypatch):
    np = line_dedup.np
    r = np.random.default_rng(2)
    wanted, others = (r.integers(0, 2**64, 5000, dtype=np.uint64) for _ in range(2))
    own = line_dedup.Filter(line_dedup.Filter.bits_for(5000))
    own.add(wanted)
    assert own.may(wanted).all() and own.may(others).mean() < 0.02
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 1024)
    full = line_dedup.Filter(line_dedup.Filter.bits_for(5000))
    full.add(wanted)
    assert len(full.held) == 1024 and full.may(wanted).all()


def test_full_filter_changes_nothing(spark, monkeypatch):
    docs = table(spark, DATA, "documents")
    monkeypatch.setattr(line_dedup, "FILTER_BYTES", 128)
    assert run(docs) == brute([(r.doc_id, r.text) for r in docs.collect()])


def test_packed_entries():
    np = line_dedup.np
    r = np.random.default_rng(3)
    key, ids = np.sort(r.integers(0, 2**32, 300, dtype=np.uint64)), r.integers(0, 2**64, 300, dtype=np.uint64)
    got = line_dedup._unpacked(line_dedup._packed(key, ids))
    assert (got[0] == key).all() and (got[1] == ids).all()
