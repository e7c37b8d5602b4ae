from __future__ import annotations

import hashlib
import random
import zlib

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from attestra.llm import bpe_roundtrip, token_store
from attestra.llm.bytepair import Cached, Decoder, Merges, Transducer, classes, library_encoder
from attestra.llm.common import fresh_path, table, text_buffer

from .conftest import DATA

PATH = public_tokenizers.path("byte_bpe_50k.json")


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


@pytest.fixture(scope="module")
def merges():
    return Merges(PATH)


ODD = ["", " ", "  a", "don't you'll 'tis ''s x's 're'", "a\n\n b\n", "\t\t", "x \n", "it's'", "'s", "é'd '", "日本語 テスト", "a" * 5000, "ab" * 3000, "\x00\x01", "🙂🙂 🙂", "1²³½ Ⅷ", "a\u00a0b \u2003c", "<|endoftext|>", "a <|endoftext|>\n<|endoftext|> b's", "<|endof text|>", "\u1c89\ua7cb x"]


def test_encode_and_decode_as_the_library(library):
    r = random.Random(1)
    texts = ODD + ["".join(r.choice("ab  '\n\tsdlvert1é9!? ") for _ in range(r.randint(0, 30))) for _ in range(800)]
    coder = bpe_roundtrip.RoundTrip(PATH)
    ids = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    assert coder.encode(texts) == ids
    assert [coder.decode(x) for x in ids] == [library.decode(x, skip_special_tokens=False) for x in ids]
    own = token_store.Ids(PATH, 2)
    data, offsets = text_buffer(pa.array(texts))
    found, bounds = own.of(data, offsets)
    assert [found[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*x, 2] for x in ids]


def test_cache_that_overflows_changes_nothing(library):
    classes(library.pre_tokenizer)
    texts = [f" w{i % 97} x{i} y{i * 7 % 301}" for i in range(500)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    cached = Cached(library_encoder(library), most=1500)
    for _ in range(2):
        got = []
        for at in range(0, 500, 100):
            data, offsets = text_buffer(pa.array(texts[at : at + 100]))
            numbers, bounds, values = cached.batch(data, offsets)
            got += [[x for k in numbers[a:b].tolist() for x in values[k]] for a, b in zip(bounds[:-1], bounds[1:])]
        assert got == want


def test_stream_is_the_whole_in_constant_memory(merges):
    r = random.Random(2)
    for _ in range(60):
        piece = "".join(r.choice(["the", "ing", "a", "ab", "tion", "er", "e", "n", "z", "=", "--"]) for _ in range(r.randint(300, 900))).encode()
        stream, got, most = Transducer(merges), [], 0
        for at in range(0, len(piece), 37):
            got += stream.push(piece[at : at + 37])
            most = max(most, len(stream.buffer))
        got += stream.flush()
        assert got == merges.merge(piece)
        assert most <= stream.hold + 37


def test_decoder_waits_for_whole_characters():
    decoder = Decoder()
    raw = "é日🙂".encode() + b"\xff\xe2\x82"
    assert "".join(decoder.push(raw[i : i + 1]) for i in range(len(raw))) + decoder.flush() == raw.decode("utf-8", "replace")


def expected(library, rows):
    rows = sorted(rows, key=lambda r: (r[0] is not None, r[0] or 0))
    at, out = 0, []
    for key, text in rows:
        ids = [*library.encode(text or "", add_special_tokens=False).ids, 2]
        out.append((key, at, len(ids), zlib.crc32(np.array(ids, "<u4").tobytes())))
        at += len(ids)
    return out


def test_store_reads_back(spark, library, edge_docs):
    for docs in (edge_docs, table(spark, DATA, "documents"), edge_docs.limit(0)):
        at = fresh_path(spark, "store")
        token_store.write_store(docs, at, PATH)
        got = sorted(map(tuple, token_store.read_digests(spark, at).collect()), key=lambda r: r[1])
        want = expected(library, [(r.doc_id, r.text) for r in docs.select("doc_id", "text").collect()])
        assert got == want
        whole = {r.start: r.ids for r in token_store.read_ids(spark, at).collect()}
        assert all(zlib.crc32(np.array(whole[s], "<u4").tobytes()) == c for _, s, _, c in want)
        stored = spark.read.parquet(f"{at}/chunks").where("payload IS NOT NULL")
        assert stored.count() == stored.select("digest").distinct().count()


def test_tree_grows_as_merkle():
    for n in range(40):
        leaves = [bytes([i, n]) for i in range(n)]
        tree = token_store.Tree()
        for x in leaves:
            tree.push(x)
        assert tree.root() == token_store.merkle(leaves)


@pytest.fixture(scope="module")
def stored(spark):
    at = fresh_path(spark, "store")
    docs = spark.createDataFrame([(i, f"text {i} " * (i % 5 + 1)) for i in range(40)] + [(50, "a long one " * 9000), (51, "text 3 " * 4)], "doc_id long, text string")
    token_store.write_store(docs, at, PATH)
    assert token_store.read_digests(spark, at).count() == 42
    return at


CHANGES = {
    "digest": ("chunks", "damaged|missing", lambda d, F: d.withColumn("digest", F.when(F.col("n") > 1000, F.lit(b"x" * 32)).otherwise(F.col("digest")))),
    "payload": ("chunks", "damaged", lambda d, F: d.withColumn("payload", F.when(F.col("payload").isNotNull(), F.max("payload").over(__import__("pyspark").sql.Window.partitionBy(F.lit(1)))))),
    "lost payload": ("chunks", "missing", lambda d, F: d.withColumn("payload", F.when(F.col("doc_id") != 7, F.col("payload")))),
    "lost chunk": ("chunks", "missing", lambda d, F: d.where("doc_id <> 7")),
    "lost recipe": ("recipes", "manifest", lambda d, F: d.where("doc_id <> 7")),
    "repeated recipe": ("recipes", "manifest", lambda d, F: d.unionByName(d.where("doc_id = 7"))),
    "start": ("recipes", "manifest", lambda d, F: d.withColumn("start", F.col("start") + (F.col("doc_id") == 7).cast("int"))),
    "number of ids": ("recipes", "manifest", lambda d, F: d.withColumn("n_tokens", F.col("n_tokens") + (F.col("doc_id") == 7).cast("int"))),
    "root": ("recipes", "manifest", lambda d, F: d.withColumn("root", F.when(F.col("doc_id") == 7, F.lit(b"x" * 32)).otherwise(F.col("root")))),
    "chunks": ("recipes", "put together", lambda d, F: d.withColumn("chunks", F.when(F.col("doc_id") == 50, F.reverse(F.transform("chunks", lambda c, i: F.struct((-i).alias("pos"), c["n"].alias("n"), c["digest"].alias("digest"))))).otherwise(F.col("chunks")))),
    "manifest": ("manifest", "manifest", lambda d, F: d.where("_part <> 0")),
    "top": ("manifest", "manifest", lambda d, F: d.where("_part >= 0")),
}


@pytest.mark.parametrize("what", sorted(CHANGES))
def test_damage_is_found(spark, stored, what):
    import shutil

    from pyspark.sql import functions as F

    part, says, change = CHANGES[what]
    bad = fresh_path(spark, "damaged")
    shutil.copytree(stored.removeprefix("file:"), bad.removeprefix("file:"))
    shutil.rmtree(f"{bad}/{part}".removeprefix("file:"))
    change(spark.read.parquet(f"{stored}/{part}"), F).write.parquet(f"{bad}/{part}")
    for read in (token_store.read_digests, token_store.read_ids):
        with pytest.raises(Exception, match=says):
            read(spark, bad).collect()


def test_crc_of_parts():
    r = random.Random(3)
    for _ in range(50):
        a, b = r.randbytes(r.randrange(300)), r.randbytes(r.randrange(3000))
        assert token_store.crc_join(np.array([zlib.crc32(a)]), np.array([zlib.crc32(b)]), np.array([len(b)]))[0] == zlib.crc32(a + b)


def test_cuts_move_with_the_content():
    r = np.random.default_rng(4)
    ids = r.integers(0, 50000, 60000).astype(np.uint16)
    a = token_store.cuts(ids, np.array([0, len(ids)]))[0]
    b = token_store.cuts(np.concatenate([ids[:7], ids]), np.array([0, len(ids) + 7]))[0]
    assert len({x + 7 for x in a} & set(b)) > 0.8 * len(a)
    assert a[-1] == len(ids) and max(np.diff([0, *a])) <= token_store.MOST


def test_round_trip_query(spark, library, edge_docs):
    got = bpe_roundtrip.round_trip(edge_docs, PATH, texts=True).collect()
    assert len(got) == edge_docs.count()
    texts = sorted((r.text or "") for r in edge_docs.collect())
    assert sorted(r.decoded for r in got) == texts
    for r in got:
        assert r.ids == library.encode(r.decoded, add_special_tokens=False).ids and r.n_tokens == len(r.ids)
        assert r.ids_sha256 == hashlib.sha256(",".join(map(str, r.ids)).encode()).hexdigest()
        assert r.decoded_sha256 == hashlib.sha256(r.decoded.encode()).hexdigest()
    assert bpe_roundtrip.round_trip(edge_docs.limit(0), PATH).count() == 0
