"""BPE encoding and decoding as streaming transducers (operator 4).

Encoding: pretokens as the tokenizer file's pattern cuts them; each goes through a transducer that
holds at most twice the merge list's sufficient lookahead, computed once from the list, and emits
a token as soon as no later byte can change it. Decoding: token bytes go through an incremental
machine that gives out characters once they are complete. Equal pretokens are encoded once. A long text is
encoded part by part, and ids and decoded text are digested as they come, so that neither is held whole.
Contents of special tokens in a text are those tokens, as in the tokenizers library.

A null text is empty; an empty text has no ids and decodes to an empty text. Texts of any length
are encoded whole. Rows with equal or null doc_id are rows of their own; extra columns are ignored.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from tokenizers import Tokenizer

from .bytepair import Decoder, Merges, PackedIds, Transducer, classes
from .common import map_arrow, steps, table, text_buffer

FILE = "byte_bpe_50k.json"
#: Ids that are digested at once.
AT_ONCE = 4096
#: Distinct pretokens that a worker remembers.
REMEMBERED = 500_000
#: Bytes of text that are handled at once: what that takes fits a core's cache.
STEP = 200_000


class RoundTrip:
    """Ids of texts by the transducer, and what they decode to."""

    def __init__(self, path: str) -> None:
        self.merges = Merges(path)
        classes(Tokenizer.from_file(path).pre_tokenizer)
        transducer = Transducer(self.merges)
        size = 1 + max(self.merges.bytes_of, default=0)
        self.decimals, self.tokens = [b"%d" % i for i in range(size)], [self.merges.bytes_of.get(i, b"") for i in range(size)]
        self.packed = PackedIds(lambda pieces: [transducer.encode(p.encode("utf-8", "replace")) for p in pieces], self.merges.special, size, REMEMBERED)

    def rows(self, data: np.ndarray, offsets: np.ndarray) -> Iterator[Iterable[np.ndarray]]:
        """The ids of each text, in parts."""
        if len(offsets) == 2:
            yield self.packed.pieces(data)
            return
        ids, bounds = self.packed.of(data, offsets)
        for a, b in zip(bounds[:-1].tolist(), bounds[1:].tolist(), strict=True):
            yield (ids[a:b],)

    def digests(self, pieces: Iterable[np.ndarray]) -> tuple[int, str, str]:
        """Number of ids, sha256 of them as comma-separated decimals, and of the decoded text, made piece by piece."""
        listed, text, decoder, n = hashlib.sha256(), hashlib.sha256(), Decoder(), 0
        for ids in pieces:
            for at in range(0, len(ids), AT_ONCE):
                some = ids[at : at + AT_ONCE].tolist()
                listed.update((b"," if n else b"") + b",".join([self.decimals[i] for i in some]))
                text.update(decoder.push(b"".join([self.tokens[i] for i in some])).encode())
                n += len(some)
        text.update(decoder.flush().encode())
        return n, listed.hexdigest(), text.hexdigest()

    def encode(self, texts: list[str | None]) -> list[list[int]]:
        data, offsets = text_buffer(pa.array(texts, pa.string()))
        return [[i for ids in pieces for i in ids.tolist()] for a, b in steps(offsets, STEP) for pieces in self.rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a])]

    def decode(self, ids: list[int]) -> str:
        decoder = Decoder()
        return "".join([decoder.push(self.merges.bytes_of[i]) for i in ids]) + decoder.flush()


_coders: dict[str, RoundTrip] = {}


def coder_of(path: str) -> RoundTrip:
    """A worker's own, which its next tasks use again: what it remembers is bounded."""
    if path not in _coders:
        _coders[path] = RoundTrip(path)
    return _coders[path]


def round_trip(docs: DataFrame, path: str, texts: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256 and decoded_sha256 of each row; with texts, also the ids and the decoded text."""
    schema = "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string" + (", ids array<int>, decoded string" if texts else "")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = coder_of(path)
        for batch in batches:
            data, offsets = text_buffer(batch.column(1))
            for a, b in steps(offsets, STEP):
                out: list[list] = [[] for _ in range(6 if texts else 4)]
                out[0] = batch.column(0)[a:b]
                for pieces in coder.rows(data[offsets[a] : offsets[b]], offsets[a : b + 1] - offsets[a]):
                    if texts:
                        pieces = [np.concatenate([*pieces, np.zeros(0, np.uint32)]).astype(np.int32)]
                    row: list = list(coder.digests(pieces))
                    if texts:
                        row += [pieces[0].tolist(), coder.decode(pieces[0].tolist())]
                    for column, x in zip(out[1:], row, strict=True):
                        column.append(x)
                kinds = [pa.int64(), pa.int64(), pa.string(), pa.string(), pa.list_(pa.int32()), pa.string()]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256", "ids", "decoded"]
                yield pa.RecordBatch.from_arrays([out[0].cast(pa.int64()), *(pa.array(c, k) for c, k in zip(out[1:], kinds[1:], strict=False))], names=names[: len(out)])

    return map_arrow(docs.select("doc_id", "text"), run, schema)


def op4_bpe_roundtrip(spark: SparkSession, sf_dir: str) -> DataFrame:
    return round_trip(table(spark, sf_dir, "documents"), public_tokenizers.path(FILE))
