"""Long spans whose pattern makes sums of powers collide: Thue-Morse words and their complements."""

from __future__ import annotations

import random

import numpy as np
import public_tokenizers
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from attestra.llm import bpe_roundtrip, decontaminate, line_dedup, near_dup, token_store
from attestra.llm.bytepair import span_hashes
from attestra.llm.common import text_buffer

PATH = public_tokenizers.path("byte_bpe_50k.json")


def pattern(order: int) -> str:
    word = "a"
    for _ in range(order):
        word += word.translate(str.maketrans("ab", "ba"))
    return word


def twins(order: int) -> tuple[str, str]:
    word = pattern(order)
    return word, word.translate(str.maketrans("ab", "ba"))


ORDERS = (8, 10, 11, 12)


@pytest.mark.parametrize("kind", [np.uint8, np.uint32, np.uint64])
def test_hashes_differ(kind):
    for order in range(1, 15):
        a, b = (np.frombuffer(x.encode(), np.uint8).astype(kind) for x in twins(order))
        x, y = span_hashes(np.concatenate([a, b, a]), np.arange(3) * len(a), np.arange(1, 4) * len(a)).tolist()[:2]
        assert x != y
        assert span_hashes(np.concatenate([a, b, a]), np.arange(3) * len(a), np.arange(1, 4) * len(a))[2] == x


def test_hashes_are_of_contents_alone():
    r = np.random.default_rng(1)
    values = r.integers(0, 200, 30000).astype(np.uint8)
    starts = np.sort(r.choice(30000, 40, replace=False))
    ends = np.append(starts[1:], 30000) - r.integers(0, 2, 40)
    ends = np.maximum(ends, starts)
    found = span_hashes(values, starts, ends)
    assert [span_hashes(values[a:b], np.array([0]), np.array([b - a]))[0] for a, b in zip(starts, ends)] == found.tolist()


def test_ids_of_long_words():
    library = Tokenizer.from_file(PATH)
    texts = [x for order in ORDERS for x in twins(order)]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    coder = bpe_roundtrip.RoundTrip(PATH)
    assert coder.encode(texts) == want
    assert [coder.decode(x) for x in want] == texts
    own = token_store.Ids(PATH, 2)
    found, bounds = own.of(*text_buffer(pa.array(texts)))
    assert [found[a:b].tolist() for a, b in zip(bounds[:-1], bounds[1:])] == [[*x, 2] for x in want]


def test_documents_of_one_long_word_are_not_linked(spark):
    rows = [(i, x) for i, x in enumerate(x for order in ORDERS for x in twins(order))]
    got = near_dup.near_duplicates(spark.createDataFrame(rows, "doc_id long, text string")).collect()
    assert sorted((r.doc_id, r.component_id, r.kept) for r in got) == [(i, i, True) for i, _ in rows]


def test_window_with_another_long_word_is_no_hit():
    common = "one two three four five six seven eight nine "
    for order in ORDERS:
        a, b = twins(order)
        index = decontaminate.Index([("1", common + a)])
        ((_, _, _, hit, items),) = decontaminate._hits(pa.array([common + a, common + b]), index)
        assert hit.tolist() == [10, 0] and items == [{"1"}, set()]


def test_lines_that_share_no_shingle_both_stay(spark):
    r = random.Random(5)
    for order in (7, 8, 9):
        a, b = twins(order)
        lines = ["".join("".join(r.choice("cdefgh") for _ in range(7)) + x for x in a)]
        lines.append("".join(lines[0][8 * i : 8 * i + 7] + x for i, x in enumerate(b)))
        got = line_dedup.deduplicated(spark.createDataFrame(list(enumerate(lines)), "doc_id long, text string")).collect()
        assert {x.doc_id: x.text for x in got} == dict(enumerate(lines))


def test_long_texts_are_encoded_in_parts(monkeypatch):
    r = random.Random(11)
    library = Tokenizer.from_file(PATH)
    pieces = ["don't", " the", "\n\n", "  ", " é", "日本", "<|endoftext|>", "\t", " x1", "'s", " \u00a0", "🙂", "a b"]
    texts = ["".join(r.choice(pieces) for _ in range(r.randint(1, 400))) for _ in range(40)] + ["日本語" * 200, "x" * 700, " " * 300 + "y"]
    want = [e.ids for e in library.encode_batch(texts, add_special_tokens=False)]
    monkeypatch.setattr("attestra.llm.bytepair.LONG", 40)
    coder, own = bpe_roundtrip.RoundTrip(PATH), token_store.Ids(PATH, 2)
    for text, ids in zip(texts, want, strict=True):
        data, offsets = text_buffer(pa.array([text]))
        assert [i for x in coder.packed.pieces(data) for i in x.tolist()] == ids
        assert own.of(data, offsets)[0].tolist() == [*ids, 2]
        assert coder.encode([text]) == [ids] and coder.digests(coder.packed.pieces(data))[0] == len(ids)


def test_hashes_of_some_spans_at_a_time(monkeypatch):
    values = np.random.default_rng(3).integers(0, 200, 5000).astype(np.uint8)
    ends = np.cumsum(np.random.default_rng(4).integers(0, 90, 100))
    starts, ends = ends[:-1], ends[1:]
    want = span_hashes(values, starts, ends)
    monkeypatch.setattr("attestra.llm.bytepair.TOGETHER", 64)
    assert (span_hashes(values, starts, ends) == want).all()


def test_memory_of_a_long_text_stays():
    """A text of 30 MB takes no more than 150 MB more than one of 2 MB."""
    import subprocess
    import sys

    program = "import sys, resource, numpy as np; from attestra.llm.bpe_roundtrip import RoundTrip; c = RoundTrip(sys.argv[1]); c.digests(c.packed.pieces(np.frombuffer(b'some words of a long text 123, ' * int(sys.argv[2]), np.uint8))); print(resource.getrusage(resource.RUSAGE_SELF).ru_maxrss // 1024)"
    peak = [int(subprocess.run([sys.executable, "-c", program, PATH, str(n)], capture_output=True, text=True, check=True).stdout) for n in (65_000, 1_000_000)]
    assert peak[1] - peak[0] < 150 + 30
