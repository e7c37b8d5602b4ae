"""Byte-level BPE: pretokens found with numpy, encoded once each, and a streaming transducer.

A text is cut into pretokens as the pattern of the tokenizer file does. Pretokens repeat, so a
worker encodes each distinct one once and keeps the result in a bounded cache.
"""

from __future__ import annotations

import codecs
import heapq
import json
import unicodedata
from collections.abc import Callable, Iterator

import numpy as np
import regex

LETTER, NUMBER, OTHER, SPACE = 0, 1, 2, 3
#: Distinct pretokens that a worker remembers; beyond it, it starts afresh.
CACHE = 700_000

_tables: dict[str, np.ndarray] = {}


def classes(pre_tokenizer=None) -> np.ndarray:
    """The class of every code point.

    Versions of Unicode differ in what they have named; with the library's pre-tokenizer given,
    letters and numbers that only the newest versions name are classed as it classes them.
    """
    if "classes" not in _tables:
        kinds = np.full(0x110000, OTHER, np.uint8)
        every = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
        for kind, what in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\p{White_Space}+")):
            for m in regex.finditer(what, every):
                a = ord(m[0][0])
                kinds[a : a + len(m[0])] = kind if ord(m[0][-1]) == a + len(m[0]) - 1 else kinds[a : a + len(m[0])]
                if ord(m[0][-1]) != a + len(m[0]) - 1:
                    kinds[list(map(ord, m[0]))] = kind
        _tables["classes"] = kinds
    if pre_tokenizer is not None and "agreed" not in _tables:
        kinds = _tables["classes"].copy()
        for c in np.flatnonzero(kinds < OTHER).tolist():
            if unicodedata.category(chr(c)) == "Cn":
                pieces = tuple(x[1][0] for x in pre_tokenizer.pre_tokenize_str(f"a{chr(c)}1"))
                kinds[c] = {(0, 2): LETTER, (0, 1): NUMBER}.get(pieces, OTHER)
        _tables["classes"] = _tables["agreed"] = kinds
    return _tables["classes"]


def mix(h: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, in place."""
    h ^= h >> np.uint64(30)
    h *= np.uint64(0xBF58476D1CE4E5B9)
    h ^= h >> np.uint64(27)
    h *= np.uint64(0x94D049BB133111EB)
    h ^= h >> np.uint64(31)
    return h


#: Values that are hashed at once.
TOGETHER = 2_000_000
#: Random weights of places in a span.
WEIGHTS = np.random.default_rng(2011).integers(0, 1 << 63, 1 << 12, np.uint64) * np.uint64(2) + np.uint64(1)
#: What each byte counts.
BYTES = np.random.default_rng(2012).integers(0, 1 << 63, 256, np.uint64) * np.uint64(2) + np.uint64(1)


def span_hashes(values: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the spans [start, end) of an array of small integers; spans are in order and don't overlap.

    Multilinear hashing: values (of bytes, random ones) times random weights of their places in the span. The
    weights were drawn independently, so no pattern of values cancels out as it does with powers of one number: two
    spans that differ by d somewhere have one hash with a probability of 2**-63 times the greatest power of 2 in d.
    """
    n, lengths = len(values), ends - starts
    if not len(starts):
        return np.zeros(0, np.uint64)
    if n > TOGETHER and len(starts) > 1:
        out, at = [], 0
        while at < len(starts):  # some spans at a time: a long text takes no more memory than its words
            to = max(at + 1, int(np.searchsorted(ends, starts[at] + TOGETHER, side="right")))
            lo = starts[at]
            out.append(span_hashes(values[lo : ends[to - 1]], starts[at:to] - lo, ends[at:to] - lo))
            at = to
        return np.concatenate(out)
    place = np.arange(n, dtype=np.int32 if n < 1 << 31 else np.int64)
    place[starts[0] :] -= np.repeat(starts.astype(place.dtype), np.diff(np.append(starts, n)))
    x = BYTES[values] if values.dtype == np.uint8 else values + np.uint64(0x51ED27)
    if lengths.max() > len(WEIGHTS):
        x *= mix((place // len(WEIGHTS)).astype(np.uint64) * np.uint64(0x9E3779B97F4A7C15)) | np.uint64(1)
        place %= len(WEIGHTS)
    x *= WEIGHTS.take(place, mode="clip")
    sums = np.empty(n + 1, np.uint64)
    sums[0] = 0
    np.cumsum(x, out=sums[1:])
    return mix(sums[ends] - sums[starts] ^ lengths.astype(np.uint64) << np.uint64(40))


_factors = np.random.default_rng(8).integers(1 << 62, 1 << 63, 4, np.uint64) * np.uint64(2) + np.uint64(1)


def eights(values: np.ndarray) -> np.ndarray:
    """64-bit hashes of all runs of eight small integers, each from those of its halves."""
    h, width = (values + np.uint64(0x51ED27)) * _factors[0], 1
    for f in _factors[1:]:
        if len(h) <= width:
            return np.zeros(0, np.uint64)
        h = h[:-width] * f + h[width:]
        width *= 2
    h ^= h >> np.uint64(32)
    h *= np.uint64(0xD6E8FEB86659FD93)
    h ^= h >> np.uint64(29)
    return h


def pretokens(points: np.ndarray, doc_starts: np.ndarray) -> np.ndarray:
    """Positions at which pretokens start, for texts laid end to end as code points.

    doc_starts: positions at which texts start. The pattern is
    's|'t|'re|'ve|'m|'ll|'d| ?\\p{L}+| ?\\p{N}+| ?[^\\s\\p{L}\\p{N}]+|\\s+(?!\\S)|\\s+
    """
    n = len(points)
    if not n:
        return np.zeros(0, np.int64)
    kind = classes()[points]
    first = np.zeros(n + 1, bool)
    first[doc_starts] = True
    first[n] = True
    white = kind == SPACE
    run = first[:n].copy()
    run[1:] |= kind[1:] != kind[:-1]
    start = white & run
    # the last of a run of white space before other text stands alone or leads it
    start[:-1] |= white[:-1] & ~white[1:] & ~first[1:n]
    led = np.zeros(n, bool)
    led[1:] = (points[:-1] == 32) & ~first[1:n]
    start |= ~white & run & ~led
    quotes = np.flatnonzero((points[:-1] == 39) & start[:-1] & (kind[1:] == LETTER) & ~first[1:n])
    for p in quotes.tolist():
        a = points[p + 1]
        b = points[p + 2] if p + 2 < n and not first[p + 2] else 0
        k = 1 if a in (115, 116, 109, 100) else 2 if (a, b) in ((114, 101), (118, 101), (108, 108)) else 0
        if k:
            start[p + 1] = False
            if p + 1 + k < n and kind[p + 1 + k] == LETTER and not first[p + 1 + k]:
                start[p + 1 + k] = True
    return np.flatnonzero(start)


class Cached:
    """Pretokens of batches as numbers into a growing table of what `encode` gives for each.

    Found pretokens lie in a table with two places for each 64-bit hash. One that finds both
    taken pushes another out, which is encoded again if it comes back; past `most` entries all
    is forgotten. So memory stays bounded and results don't depend on what is remembered.
    """

    def __init__(self, encode: Callable[[list[str]], list], most: int = CACHE) -> None:
        self.encode, self.most = encode, most
        self.mask = np.uint64((1 << max(10, (2 * most - 1).bit_length())) - 1)
        self.forget()

    def forget(self) -> None:
        self.keys = np.zeros(int(self.mask) + 1, np.uint64)
        self.numbers = np.zeros(int(self.mask) + 1, np.int32)
        self.values: list = []

    def batch(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray, list]:
        """(number of each pretoken, n + 1 offsets of the texts into them, the table)."""
        text = data.tobytes().decode("utf-8", "replace")
        points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
        if len(points) == len(data):
            bounds = offsets
        else:
            ahead = np.zeros(len(data) + 1, np.int64)
            np.cumsum((data & 0xC0) != 0x80, out=ahead[1:])
            bounds = ahead[offsets]
        starts = pretokens(points, bounds[:-1][bounds[:-1] < len(points)])
        ends = np.append(starts[1:], len(points))
        h = span_hashes(points, starts, ends)
        h[h == 0] = 1
        one, two = (h & self.mask).astype(np.int64), ((h >> np.uint64(32)) & self.mask).astype(np.int64)
        missing = np.flatnonzero((self.keys[one] != h) & (self.keys[two] != h))
        if len(missing):
            fresh, where = np.unique(h[missing], return_index=True)
            if len(self.values) + len(fresh) > self.most and self.values:
                self.forget()
                return self.batch(data, offsets)
            where = missing[where]
            at = len(self.values)
            self.values += self.encode([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
            numbers = np.arange(at, len(self.values), dtype=np.int32)
            place = np.where(self.keys[one[where]] == 0, one[where], two[where])
            self.keys[place], self.numbers[place] = fresh, numbers
            in_one = self.keys[one] == h
            got = np.where(in_one, self.numbers[one], self.numbers[two])
            got[missing] = numbers[np.searchsorted(fresh, h[missing])]
            # what the new ones pushed out has no place now, and is looked up as it was
            lost = np.flatnonzero(~in_one & (self.keys[two] != h))
            lost = lost[~np.isin(h[lost], fresh, assume_unique=False)]
            if len(lost):
                again, where = np.unique(h[lost], return_index=True)
                where = lost[where]
                at = len(self.values)
                self.values += self.encode([text[a:b] for a, b in zip(starts[where].tolist(), ends[where].tolist(), strict=True)])
                got[lost] = at + np.searchsorted(again, h[lost])
        else:
            got = np.where(self.keys[one] == h, self.numbers[one], self.numbers[two])
        return got, np.searchsorted(starts, bounds), self.values


#: Bytes from which on a text is encoded in parts, and about how many a part has.
LONG = 400_000


def parts(data: np.ndarray) -> Iterator[tuple[int, int]]:
    """Ranges of a long text, of about LONG bytes, that begin where a pretoken surely does: at ASCII white space after an ASCII character that is none.

    Where there is no such place, a part goes on to the next one.
    """
    white = lambda x: (x == 32) | ((x >= 9) & (x <= 13))
    at = 0
    while at < len(data):
        to = at + LONG
        while to < len(data):
            x = data[to - 1 : to + LONG]
            found = np.flatnonzero(white(x[1:]) & (x[:-1] > 32) & (x[:-1] < 127))
            if len(found):
                to += int(found[0])
                break
            to += LONG
        to = min(to, len(data))
        yield at, to
        at = to


class PackedIds:
    """Ids of pretokens laid in one array, for whole batches of texts.

    encode: ids of each of some pretokens; special: ids of contents that are no pretokens; vocabulary:
    more than any id; most: pretokens that are remembered; end_id: an id after each text, if any.
    """

    def __init__(self, encode: Callable[[list[str]], list[list[int]]], special: dict[str, int], vocabulary: int, most: int, end_id: int | None = None) -> None:
        self.special, self.end_id = special, end_id
        self.kind = np.uint16 if vocabulary <= 1 << 16 else np.uint32
        self.cached = Cached(encode, most)
        self._reset()

    def _reset(self) -> None:
        self.seen, self.used, self.source = 0, 0, None
        self.flat, self.at = np.zeros(1 << 16, self.kind), np.zeros((1 << 16) + 1, np.int64)

    def _follow(self, values: list) -> None:
        if values is not self.source:  # the cache has started afresh
            self._reset()
            self.source = values
        new = values[self.seen :]
        lengths = np.fromiter(map(len, new), np.int64, len(new))
        total = self.used + int(lengths.sum())
        while len(self.flat) < total:
            self.flat = np.concatenate([self.flat, np.zeros_like(self.flat)])
        while len(self.at) < len(values) + 1:
            self.at = np.concatenate([self.at, np.zeros_like(self.at)])
        self.flat[self.used : total] = [i for x in new for i in x]
        self.at[self.seen + 1 : len(values) + 1] = self.used + np.cumsum(lengths)
        self.seen, self.used = len(values), total
        for i in range(len(values) - len(new), len(values)):
            values[i] = ()

    def of(self, data: np.ndarray, offsets: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Ids of texts end to end, the end id after each, and the n + 1 offsets of the texts."""
        if len(offsets) == 2 and len(data) > LONG:
            end = np.array([] if self.end_id is None else [self.end_id], self.kind)
            ids = np.concatenate([*self.pieces(data), end])
            return ids, np.array([0, len(ids)])
        marks = [s.encode() for s in self.special]
        whole = data.tobytes() if marks else b""
        if any(m in whole for m in marks):
            parts = [self._one(whole[a:b]) for a, b in zip(offsets[:-1], offsets[1:], strict=True)]
            return np.concatenate(parts), np.concatenate([[0], np.cumsum([len(p) for p in parts])])
        return self._plain(data, offsets, self.end_id is not None)

    def pieces(self, data: np.ndarray) -> Iterator[np.ndarray]:
        """The ids of one text, without an end id, part by part: memory doesn't grow with the text."""
        marks = [s.encode() for s in self.special]
        cut = parts(data) if not any(c.isspace() for s in self.special for c in s) else [(0, len(data))]
        for a, b in cut:
            whole = data[a:b].tobytes() if marks else b""
            if any(m in whole for m in marks):
                yield self._one(whole, False)
            else:
                yield self._plain(data[a:b], np.array([0, b - a]), False)[0]

    def _one(self, text: bytes, end: bool = True) -> np.ndarray:
        found = []
        for piece in split_special(text.decode("utf-8", "replace"), self.special):
            if isinstance(piece, int):
                found.append(np.array([piece], self.kind))
            else:
                raw = np.frombuffer(piece.encode(), np.uint8)
                found.append(self._plain(raw, np.array([0, len(raw)]), False)[0])
        return np.concatenate([*found, np.array([self.end_id] if end and self.end_id is not None else [], self.kind)])

    def _plain(self, data: np.ndarray, offsets: np.ndarray, end: bool) -> tuple[np.ndarray, np.ndarray]:
        numbers, bounds, values = self.cached.batch(data, offsets)
        self._follow(values)
        first, count = self.at[numbers], self.at[numbers + 1] - self.at[numbers]
        before = np.zeros(len(numbers) + 1, np.int64)
        np.cumsum(count, out=before[1:])
        ids = self.flat[np.repeat(first - before[:-1], count) + np.arange(before[-1])]
        ends = before[bounds]
        if not end:
            return ids, ends
        return np.insert(ids, ends[1:], self.end_id), ends + np.arange(len(ends))


def byte_alphabet() -> dict[str, int]:
    """The printable characters that stand for bytes in a byte-level vocabulary, as its format fixes them."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    spare = [b for b in range(256) if b not in set(plain)]
    return {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(spare)}


class Merges:
    """The vocabulary and merge list of a byte-level BPE file, and the lookahead that its merges need."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        alphabet = byte_alphabet()
        raw = lambda token: bytes(alphabet[c] for c in token)
        model = whole["model"]
        self.special = {x["content"]: x["id"] for x in whole.get("added_tokens", [])}
        self.ids = {raw(t): i for t, i in model["vocab"].items() if t not in self.special}
        self.bytes_of = {i: t for t, i in self.ids.items()} | {i: t.encode() for t, i in self.special.items()}
        pairs = [tuple(m.split(" ")) if isinstance(m, str) else tuple(m) for m in model["merges"]]
        self.ranks = {(raw(a), raw(b)): k for k, (a, b) in enumerate(pairs)}
        self.lookahead = self._lookahead()

    def _lookahead(self) -> int:
        """Bytes after a token that decide whether it is final.

        What follows can reach left only by a chain of merges of rising rank. A merge (u, v) at
        the edge of the undecided part moves the edge left by the length of u; from then on a
        token that begins at the edge begins with u. The next merge of the chain so has a right
        part that begins with u. The longest chain's length, plus the longest token, is enough.
        """
        reach: dict[bytes, int] = {}
        most, longest = 0, 1
        for (u, v), _ in sorted(self.ranks.items(), key=lambda x: x[1]):
            far = len(u) + max((reach.get(v[:k], 0) for k in range(1, len(v) + 1)), default=0)
            reach[u] = max(reach.get(u, 0), far)
            most, longest = max(most, far), max(longest, len(u) + len(v))
        return most + longest

    def merge(self, piece: bytes) -> list[bytes]:
        """The tokens of a whole piece: the lowest-ranked pair, leftmost first, until none is left."""
        n = len(piece)
        if n == 1:
            return [piece]
        ranks = self.ranks
        parts = [piece[i : i + 1] for i in range(n)]
        if n > 48:
            return self._merge_long(parts)
        scores = [ranks.get((parts[i], parts[i + 1]), 1 << 30) for i in range(n - 1)]
        while scores:
            best = min(scores)
            if best == 1 << 30:
                break
            i = scores.index(best)
            parts[i : i + 2] = [parts[i] + parts[i + 1]]
            del scores[i]
            if i < len(scores):
                scores[i] = ranks.get((parts[i], parts[i + 1]), 1 << 30)
            if i:
                scores[i - 1] = ranks.get((parts[i - 1], parts[i]), 1 << 30)
        return parts

    def _merge_long(self, parts: list) -> list[bytes]:
        """The same with a heap over a linked list, for long pieces."""
        n, ranks = len(parts), self.ranks
        after, before = list(range(1, n + 1)), list(range(-1, n - 1))
        heap = [(r, i, parts[i], parts[i + 1]) for i in range(n - 1) if (r := ranks.get((parts[i], parts[i + 1]))) is not None]
        heapq.heapify(heap)
        while heap:
            _, i, a, b = heapq.heappop(heap)
            j = after[i] if parts[i] is not None else n
            if j >= n or parts[i] != a or parts[j] != b:
                continue
            parts[i], parts[j] = a + b, None
            after[i] = after[j]
            if after[j] < n:
                before[after[j]] = i
            for k in (before[i], i):
                if k >= 0 and after[k] < n and (r := ranks.get((parts[k], parts[after[k]]))) is not None:
                    heapq.heappush(heap, (r, k, parts[k], parts[after[k]]))
        return [p for p in parts if p is not None]


class Transducer:
    """Encodes one pretoken as its bytes arrive, holding no more than a fixed number of them.

    A token is emitted once `lookahead` bytes follow it: no later byte can change it then. What
    is left is encoded anew together with the bytes that follow, which gives the same tokens,
    as a suffix that starts where a token starts has the tokens that the whole has there.
    """

    def __init__(self, merges: Merges, hold: int = 0) -> None:
        self.merges, self.buffer = merges, b""
        self.hold = max(hold, 2 * merges.lookahead)

    def push(self, data: bytes) -> Iterator[bytes]:
        for at in range(0, len(data), self.hold):
            self.buffer += data[at : at + self.hold]
            if len(self.buffer) > self.hold:
                end, limit = 0, len(self.buffer) - self.merges.lookahead
                for token in self.merges.merge(self.buffer):
                    if end + len(token) > limit:
                        break
                    end += len(token)
                    yield token
                self.buffer = self.buffer[end:]

    def flush(self) -> Iterator[bytes]:
        rest, self.buffer = self.buffer, b""
        yield from self.merges.merge(rest) if rest else []

    def encode(self, piece: bytes) -> list[int]:
        ids = self.merges.ids
        return [ids[t] for part in (self.push(piece), self.flush()) for t in part]


class Decoder:
    """Text from token bytes as they arrive: an incomplete character waits for the next bytes."""

    def __init__(self) -> None:
        self.state = codecs.getincrementaldecoder("utf-8")("replace")

    def push(self, data: bytes) -> str:
        return self.state.decode(data)

    def flush(self) -> str:
        return self.state.decode(b"", True)


def split_special(text: str, special: dict[str, int]) -> list[str | int]:
    """The text cut at the contents of special tokens, which become ids; leftmost first, the longest of those that start there."""
    out: list[str | int] = []
    while text:
        found = min(((at, -len(s), s) for s in special if s and (at := text.find(s)) >= 0), default=None)
        if found is None:
            out.append(text)
            break
        at, _, s = found
        out += [text[:at], special[s]] if at else [special[s]]
        text = text[at + len(s) :]
    return out


def library_encoder(tokenizer) -> Callable[[list[str]], list[list[int]]]:
    """Ids of pretokens by the tokenizers library.

    Pretokens of a space and letters are laid end to end, as the library cuts them apart again
    before each space; its cost for a call then spreads over all of them. Others go one by one.
    """
    vocabulary = tokenizer.get_vocab_size(with_added_tokens=True)
    opens = np.zeros(vocabulary, bool)
    for token, number in tokenizer.get_vocab().items():
        opens[number] = token.startswith("\u0120")

    def encode(pieces: list[str]) -> list[list[int]]:
        out: list[list[int]] = [[]] * len(pieces)
        joined = [i for i, p in enumerate(pieces) if len(p) > 1 and p[0] == " " and p[1] != " " and p[1:].isalpha()]
        apart = sorted(set(range(len(pieces))) - set(joined))
        for at in range(0, len(joined), 4096):
            some = joined[at : at + 4096]
            ids = tokenizer.encode_batch_fast(["".join([pieces[i] for i in some])], add_special_tokens=False)[0].ids
            starts = np.flatnonzero(opens[ids]).tolist()
            if len(starts) != len(some):
                apart += some
                continue
            for i, a, b in zip(some, starts, [*starts[1:], len(ids)], strict=True):
                out[i] = ids[a:b]
        for i, e in zip(apart, tokenizer.encode_batch_fast([pieces[i] for i in apart], add_special_tokens=False), strict=True):
            out[i] = e.ids
        return out

    return encode
