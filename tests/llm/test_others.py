from __future__ import annotations

import zlib

import numpy as np
import pyarrow as pa
import pyarrow.parquet as pq
import pytest
from pyspark.sql import functions as F

from attestra.llm import licences, neighbours, quality, shards, url_rules
from attestra.llm.common import table

from .conftest import DATA


def test_quality_held_out(spark):
    d = DATA.replace("0.001", "0.01")
    docs, labels = table(spark, d, "documents"), table(spark, d, "labels")
    got = {r.doc_id: r for r in quality.op6_quality(spark, d).collect()}
    assert len(got) == docs.count()
    truth = {r.doc_id: r.quality for r in labels.collect()}
    out = [(truth[k], r.predicted) for k, r in got.items() if r.held_out and k in truth]
    assert all(r.held_out == (zlib.crc32(str(k).encode()) % 3 == 1) for k, r in got.items())
    assert sum(a == b for a, b in out) / len(out) > 0.95


def test_quality_walk_is_the_plain_one():
    r = np.random.default_rng(1)
    rows = r.random((400, len(quality.NAMES)))
    labels = ((rows[:, 3] > 0.5) ^ (rows[:, 7] > 0.8)).astype(float)
    forest = quality.fit(rows, labels)

    def plain(x):
        total = forest.base
        for t in range(len(forest.feature)):
            at = 0
            for _ in range(quality.DEPTH):
                at = 2 * at + (2 if x[forest.feature[t, at]] > forest.threshold[t, at] else 1)
            total += forest.value[t, at - forest.feature.shape[1]]
        return 1 / (1 + np.exp(-total))

    score = forest.score(rows)
    assert np.allclose(score, [plain(x) for x in rows])
    assert ((score >= 0.5) == labels).mean() > 0.97


def test_quality_edges(spark, edge_docs):
    labels = spark.createDataFrame([(1, 1), (2, 0), (2, 1), (3, None), (4, 7), (6, 0), (None, 1), (5, 1)], "doc_id long, quality int")
    for usable in (labels, labels.limit(0), labels.where("quality = 1")):
        forest = quality.learnt(edge_docs, usable)
        got = quality.scored(edge_docs, forest).collect()
        assert len(got) == edge_docs.count() and all(0 <= r.score <= 1 and r.predicted == int(r.score >= 0.5) for r in got)
        kept = quality.keep_good(edge_docs, forest)
        assert kept.columns == edge_docs.columns and kept.count() == sum(r.predicted for r in got)
    assert quality.scored(edge_docs.limit(0), forest).count() == 0


def product(a, b):
    total = 0.0
    for x, y in zip(a, b):
        total += x * y
    return total


def exact(rows, step, top):
    best = {}
    for k, v in rows:
        if k is not None and v and all(x is not None and np.isfinite(x) for x in v) and any(v):
            best[k] = min(best.get(k, v), v)
    wide = max({len(v) for v in best.values()}, key=lambda n: (sum(len(v) == n for v in best.values()), n), default=0)
    best = {k: np.array(v, float) for k, v in best.items() if len(v) == wide}
    out = {}
    for q in best:
        if q % step == 0:
            near = [(-product(best[q].tolist(), v.tolist()), k) for k, v in best.items() if k != q]
            out[q] = [(k, -s) for s, k in sorted(near)[:top]]
    return out


def found(frame):
    out = {}
    for r in sorted(frame.collect(), key=lambda r: (r.query_id, r["rank"])):
        out.setdefault(r.query_id, []).append((r.vec_id, r.score))
        assert r["rank"] == len(out[r.query_id])
    return out


def recall(got, want):
    return sum(len({k for k, _ in got.get(q, [])} & {k for k, _ in w}) for q, w in want.items()) / sum(map(len, want.values()))


@pytest.mark.parametrize("sample", [neighbours.SAMPLE, 300])
def test_neighbours_recall(spark, sample):
    frame = table(spark, DATA.replace("0.001", "0.1"), "embeddings")
    want = exact([(r.vec_id, r.embedding) for r in frame.collect()], 20, 20)
    got = found(neighbours.nearest(frame, sample=sample))
    assert all(len(v) == 20 for v in got.values()) and set(got) == set(want)
    assert recall(got, want) >= 0.9
    for q, w in got.items():
        assert w == sorted(w, key=lambda x: (-x[1], x[0]))
        assert dict(w).items() >= {k: s for k, s in want[q] if k in dict(w)}.items()


def test_neighbours_of_a_large_index_without_structure(spark, tmp_path):
    n, wide, step = 200_000, 64, 5_000
    x = np.random.default_rng(5).standard_normal((n, wide)).astype(np.float32)
    pq.write_table(pa.table({"vec_id": pa.array(range(n), pa.int64()), "embedding": pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), wide).cast(pa.list_(pa.float32()))}), str(tmp_path / "embeddings.parquet"))
    want = {}
    for q in range(0, n, step):
        score = x.astype(float) @ x[q].astype(float)
        score[q] = -np.inf
        want[q] = [(int(k), score[k]) for k in np.argsort(-score)[:20]]
    got = found(neighbours.nearest(table(spark, str(tmp_path), "embeddings"), step=step))
    print("recall", recall(got, want))
    assert recall(got, want) >= 0.9


def test_neighbours_compared_with_all_rows(spark, monkeypatch):
    r = np.random.default_rng(6)
    rows = [(i, [float(y) for y in r.integers(-2, 3, 6)]) for i in range(1500)]  # many ties
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").repartition(3)
    monkeypatch.setattr(neighbours, "enough", lambda *a: None)
    monkeypatch.setattr(neighbours, "LEAVES", 1)
    monkeypatch.setattr(neighbours, "PASS", 20)
    assert found(neighbours.nearest(frame)) == exact(rows, 20, 20)


def test_neighbours_of_doubles_and_mixed_widths(spark):
    r = np.random.default_rng(9)
    rows = [(i, r.standard_normal(5).tolist()) for i in range(300)] + [(i, r.standard_normal(4).tolist()) for i in range(300, 400)]
    rows += [(i, rows[7][1]) for i in range(400, 430)]  # more equal vectors than a result has rows
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<double>").repartition(3)
    assert found(neighbours.nearest(frame)) == exact(rows, 20, 20)


def test_neighbours_edges(spark):
    nan, inf = float("nan"), float("inf")
    rows = [(i, [1.0, 2.0, float(i % 3)]) for i in range(0, 90)] + [(100, None), (120, []), (140, [0.0, 0.0, 0.0]), (160, [nan, 1.0, 1.0]), (180, [inf, 1.0, 1.0]), (200, [None, 1.0, 1.0]), (220, [1.0, 1.0]), (None, [1.0, 2.0, 3.0]), (40, [9.0, 9.0, 9.0]), (40, [9.0, 9.0, 9.0])]
    frame = spark.createDataFrame(rows, "vec_id long, embedding array<float>").withColumn("class", F.lit(1)).withColumn("leaf", F.lit(2)).withColumn("score", F.lit(3))
    assert found(neighbours.nearest(frame)) == exact(rows, 20, 20)
    assert found(neighbours.nearest(frame.limit(0))) == {}
    few = frame.where("vec_id in (0, 1, 20)")
    assert found(neighbours.nearest(few)) == exact([(r.vec_id, r.embedding) for r in few.collect()], 20, 20)


def test_shards(spark, edge_docs):
    docs = table(spark, DATA, "documents")
    for frame in (docs, edge_docs, edge_docs.limit(0)):
        got = shards.sharded(frame, shards.tree_of(16), shards.tree_of(17)).collect()
        assert len(got) == frame.count()
        by = {}
        for r in got:
            by.setdefault(r.shard, []).append(r)
            assert 0 <= r.shard < 16 and r.grown_shard in (r.shard, 16) and r.law == "key"
        for rows in by.values():
            rows.sort(key=lambda r: r.slot)
            assert [r.slot for r in rows] == list(range(len(rows)))
            keys = [(r.doc_id is not None, r.doc_id or 0) for r in rows]
            assert keys == sorted(keys)
        texts = {r.doc_id: r.text for r in frame.collect()}
        for r in got:
            raw = (texts[r.doc_id] or "").encode()
            assert (r.size, r.text_crc32) == (len(raw) + 1, zlib.crc32(raw))


def test_shards_weights_confine_movement(spark):
    tree = {"a": {"a/x": {0: 1.0, 1: 1.0}, "a/y": {2: 2.0}}, "b": {"b/x": {3: 1.0, 4: 3.0}}}
    lighter = {"a": tree["a"], "b": {"b/x": {3: 1.0, 4: 1.0}}}
    rows = spark.range(40000).select(shards.shard_of(F.col("id"), tree).alias("s"), shards.shard_of(F.col("id"), lighter).alias("t")).collect()
    share = np.bincount([r.s for r in rows], minlength=5) / len(rows)
    assert np.allclose(share, np.array([1, 1, 2, 1, 3]) / 8, atol=0.01)
    moved = {(r.s, r.t) for r in rows if r.s != r.t}
    assert all(s in (3, 4) for s, _ in moved)  # only out of, or within, the subtree that weighs less
    assert shards.tree_of(3).keys() == {"alone0", "alone1", "alone2"}


def test_write_shards(spark, edge_docs, tmp_path):
    shards.write_shards(edge_docs, shards.tree_of(16), str(tmp_path / "out"))
    back = spark.read.parquet(str(tmp_path / "out"))
    assert back.count() == edge_docs.count() and "_shard" in back.columns


PAGES = [
    (1, "https://bad.net/x", "<html>"),
    (2, "http://Alias.example.org/a?q=1#z", '<head><LINK rel="canonical" href="https://bad.net/x"></head>'),
    (3, "https://hop.org/1", "<meta http-equiv='refresh' content='0; url=http://alias.example.org/a?q=1'>"),
    (4, "https://free.org/fr/2", "<link href=/there rel=canonical>"),
    (5, "https://free.org/there", None),
    (6, "https://m.example.net/en/1", "<link rel='canonical' href='https://both.org/1'>"),
    (7, "https://both.org/1", "<link rel='canonical' href='https://bad.net/y'>"),
    (8, None, "<link rel='canonical' href='https://bad.net/x'>"),
    (9, "no host", ""),
    (10, "https://example.com/de/", "<link rel=stylesheet href='https://bad.net/x'>"),
    (11, "https://NET", ""),
    (12, "https://notexample.net/en/", ""),
    (13, "x://a://b/c", ""),
    (14, "https://alone.org/q", "canonical"),
]


def test_url_rules(spark):
    pages = spark.createDataFrame(PAGES, "page_id long, url string, html string").withColumn("host", F.lit("clash")).withColumn("rule", F.lit(1))
    for inline in (128, 0):
        url_rules.INLINE = inline
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.filtered(pages, url_rules.RULES).collect()}
        assert got == {
            1: ("bad.net", "/x", "net/", "block"),
            2: ("alias.example.org", "/a", None, "block"),
            3: ("hop.org", "/1", None, "block"),
            4: ("free.org", "/fr/2", "org/fr/", "allow"),
            5: ("free.org", "/there", None, "allow"),
            6: ("m.example.net", "/en/1", "example.net/en/", "allow"),
            7: ("both.org", "/1", None, "allow"),
            8: ("", "", None, "allow"),
            9: ("", "", None, "allow"),
            10: ("example.com", "/de/", "example.com/de/", "block"),
            11: ("net", "", None, "allow"),
            12: ("notexample.net", "/en/", "net/", "block"),
            13: ("a:", "//b/c", None, "allow"),
            14: ("alone.org", "/q", None, "allow"),
        }
    url_rules.INLINE = 128
    redirects = spark.createDataFrame([("https://alone.org/q", "https://bad.net/z"), (None, "x")], "from_url string, to_url string")
    got = {r.page_id: r.verdict for r in url_rules.filtered(pages, url_rules.RULES, redirects).collect()}
    assert got[14] == "block" and len(got) == len(PAGES)
    assert url_rules.filtered(pages.limit(0), url_rules.RULES).count() == 0


def judged_one(url, rules):
    """host, path, rule, ruled of a url, from the words of the contract."""
    host = path = ""
    if url is not None and "://" in url:
        rest = url.split("://", 1)[1]
        at = next((i for i, c in enumerate(rest) if c in "/?#"), len(rest))
        host = "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in rest[:at])
        path = rest[at:]
        path = path[: next((i for i, c in enumerate(path) if c in "?#"), len(path))]
    fits = [(len(h + p), v == "allow", h + p, v) for h, p, v in rules if (host == h or host.endswith("." + h)) and path.startswith(p)]
    _, _, rule, verdict = max(fits, default=(0, False, None, None))
    return host, path, rule, verdict


def test_url_rules_of_whole_table(spark):
    import re

    pages = table(spark, DATA.replace("0.001", "0.1"), "pages")
    rows = [(r.page_id, r.url) for r in pages.select("page_id", "url").collect()]
    assert not any(re.search("canonical|http-equiv", r.html or "", re.I) for r in pages.select("html").collect())  # so that rules alone decide
    for inline in (128, 0):
        url_rules.INLINE = inline
        got = {r.page_id: (r.host, r.path, r.rule, r.verdict) for r in url_rules.filtered(pages, url_rules.RULES).collect()}
        want = {k: (h, p, rule, verdict or "allow") for k, u in rows for h, p, rule, verdict in [judged_one(u, url_rules.RULES)]}
        assert got == want and {v for *_, v in want.values()} == {"allow", "block"}
    url_rules.INLINE = 128


def descended(key_hash, tree):
    """The shard that a descent by hand gives; key_hash: name -> the 64-bit hash of key and name."""
    import math

    def least(children):
        draws = []
        for name in sorted(children):
            u = ((key_hash(name) % (1 << 64) >> 11) + 0.5) * 2.0**-53
            draws.append((-math.log(u) / children[name][0], name))
        return children[min(draws)[1]][1]() if len(children) > 1 else next(iter(children.values()))[1]()

    racks = lambda r: least({k: (sum(s.values()), lambda k=k, s=s: shard(k, s)) for k, s in tree[r].items()})
    shard = lambda k, s: least({f"{k}/{n:06d}": (w, lambda n=n: n) for n, w in s.items()})
    return least({r: (sum(w for s in t.values() for w in s.values()), lambda r=r: racks(r)) for r, t in tree.items()})


def test_shards_by_hand(spark):
    trees = {"even": shards.tree_of(16), "grown": shards.tree_of(17), "uneven": {"a": {"a/x": {0: 1.0, 1: 2.5}, "a/y": {2: 2.0}}, "b": {"b/x": {3: 0.5, 4: 3.0}}}}
    names = {n for t in trees.values() for r, racks in t.items() for n in [r, *racks, *(f"{k}/{s:06d}" for k, x in racks.items() for s in x)]}
    ids = spark.range(0, 3000, 7)
    hashes = ids.select("id", *(F.xxhash64(F.col("id"), F.lit(n)).alias(n.replace("/", "_")) for n in sorted(names)))
    rows = hashes.withColumns({k: shards.shard_of(F.col("id"), t) for k, t in trees.items()}).collect()
    for r in rows:
        for k, t in trees.items():
            assert r[k] == descended(lambda name: r[name.replace("/", "_")], t)


def test_full_licence_texts(spark):
    from pathlib import Path

    from attestra.llm import licence_catalogue as catalogue

    rows, want = [], {}

    def add(text, name, whole=True):
        want[len(rows)] = (name, whole)
        rows.append((len(rows), text))

    for name, text in catalogue.texts().items():
        add(text, name)
        add("Copyright (c) 2020 Somebody Else. All rights reserved.\n\n" + text.replace("\n", "\r\n"), name)
        add(" ".join(text.split()).upper().replace(",", " ,") if "opyright (" not in text else text, name)
        if name in {n for n, _ in catalogue.sections()}:  # found by its paragraphs
            add("Some program\n\n" + text + "\n\nand more", name, False)
    add(f"The MIT License (MIT)\n\nCopyright © 2020 X\n\n{catalogue.texts()['MIT']}", "MIT")
    add(f"BSD 3-Clause License\n\nCopyright (c) 2020, X\nAll rights reserved.\n\n{catalogue.texts()['BSD-3-Clause']}", "BSD-3-Clause")
    add(catalogue.texts()["Apache-2.0"].replace(catalogue.PLACE, "Copyright 2020 X"), "Apache-2.0")
    for path, name in (("pytest/../pytest-9.2.0.dist-info/licenses/LICENSE", "MIT"), ("packaging-26.3.dist-info/licenses/LICENSE.APACHE", "Apache-2.0"), ("zstandard-0.25.0.dist-info/licenses/LICENSE", "BSD-3-Clause")):
        file = Path(pytest.__file__).parent.parent / path
        if file.exists():
            add(file.read_text(), name)
    got = {r.doc_id: r for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    for k, (name, whole) in want.items():
        assert name in got[k].licences.split(","), (k, name, rows[k][1][:80])
        assert got[k].whole == (name if whole else None), (k, name, rows[k][1][:80])
    assert len(catalogue.sections()) > 100 and {n for n, _ in catalogue.sections()} == set(catalogue.texts()) - {"BSD-2-Clause"}  # all of it is in another


def test_licences(spark, edge_docs):
    rows = [
        (1, "Some text.\n  released UNDER the MIT licence\nmore"),
        (2, "Copyright (c) 2020 Somebody\n\nPermission to use, copy, modify, and/or distribute this software for any purpose with or without fee is hereby granted, provided that the above\ncopyright notice and this permission notice appear in all copies."),
        (3, "Licensed under CC BY-NC 4.0.\nLicensed under the Apache License, Version 2.0."),
        (4, "not released under the MIT License."),
        (5, None),
        (6, "Copyright 2020 X"),
    ]
    got = {r.doc_id: (r.licences, r.n_matches, r.whole) for r in licences.scanned(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {1: ("MIT", 1, None), 2: ("ISC", 1, None), 3: ("Apache-2.0,CC-BY-NC-4.0", 2, None), 4: ("", 0, None), 5: ("", 0, None), 6: ("", 0, None)}
    assert licences.scanned(edge_docs).count() == edge_docs.count()
    assert licences.scanned(edge_docs.limit(0)).count() == 0


def test_pipeline(spark, edge_docs):
    import corpus_pipeline

    d = DATA.replace("0.001", "0.01")
    docs = table(spark, d, "documents")
    names = [n for n, _ in corpus_pipeline.STAGES]
    assert len(names) == 5
    for name, stage in corpus_pipeline.STAGES[:4]:
        out = stage(spark, docs, d)
        assert out.columns == docs.columns
        odd = stage(spark, edge_docs, d)
        assert odd.columns == edge_docs.columns and 0 < odd.count() <= edge_docs.count()
        assert stage(spark, edge_docs.limit(0), d).count() == 0
    result = corpus_pipeline.run(spark, d)
    assert 0 < result.count() < docs.count()


def test_pipeline_judges_rows(spark):
    import corpus_pipeline

    d = DATA
    a = [" ".join(f"{w}{i}" for i in range(60)) for w in ("red", "green", "blue")]
    near = [x.replace("7 ", "7x ", 1) for x in a]
    item = next(r.text for r in table(spark, d, "benchmark").collect() if r.text and len(r.text.split()) > 12)
    frame = lambda rows: spark.createDataFrame(rows, "doc_id long, text string").repartition(3)
    rows = lambda df: sorted(((r.doc_id, r.text) for r in df.collect()), key=str)
    clean = "words of nobody else that stand for themselves and are here once only, as anyone can see"
    docs = [(None, a[0]), (None, near[0]), (None, clean), (5, a[1]), (5, near[1]), (5, clean + " again and again in some other way of saying"), (3, a[2]), (9, near[2]), (9, "quite another text with nothing in common with what came before it"), (7, None), (7, "")]
    got = rows(corpus_pipeline.near_deduplication(spark, frame(docs), d))
    want = [(None, clean), *docs[5:7], *docs[8:]]
    assert all(x in got for x in want)
    # of two near copies under one id, one stays
    assert sum(x in got for x in docs[:2]) == 1 and sum(x in got for x in docs[3:5]) == 1 and len(got) == len(want) + 2
    docs = [(None, item), (None, clean), (4, item), (4, clean), (6, clean)]
    assert rows(corpus_pipeline.benchmark_decontamination(spark, frame(docs), d)) == rows(frame([x for x in docs if x[1] == clean]))
