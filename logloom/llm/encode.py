"""Problem 8: encoding of texts by a public byte-level BPE vocabulary, with vectorised pre-tokenisation."""

from __future__ import annotations

import base64
import heapq
import os
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: Where the public vocabularies lie; a parameter of every function that reads one.
TOKENIZERS = "/opt/tokenizers"
#: Code points that are scanned at once, so that the arrays stay small.
SCAN = 2_000_000
#: Distinct pieces whose ids are kept; the cache starts anew beyond it.
CACHED = 400_000

# Symbols of the pre-tokeniser's automaton.
LETTER, NUMBER, OTHER, INNER, JOINING, SINGLE, SHORT, LONG, RESET = range(9)
# States: what the last code point was part of.
IN_L, IN_N, IN_P, IN_W, SPACE, NONE, NEED1, NEED2 = range(8)
# The contractions that are pieces of their own.
CONTRACTIONS = ["s", "t", "m", "d", "re", "ve", "ll"]


def _automaton() -> tuple[np.ndarray, np.ndarray]:
    """Next state, and whether a piece starts at the symbol, by state and symbol."""
    step, starts = np.zeros((8, 9), np.uint8), np.ones((8, 9), bool)

    def rule(symbol: int, to: int, joined: dict[int, int]) -> None:
        step[:, symbol] = to
        for state, then in joined.items():
            step[state, symbol], starts[state, symbol] = then, False

    rule(LETTER, IN_L, {IN_L: IN_L, SPACE: IN_L, NEED1: NONE, NEED2: NEED1})
    rule(NUMBER, IN_N, {IN_N: IN_N, SPACE: IN_N})
    rule(OTHER, IN_P, {IN_P: IN_P, SPACE: IN_P})
    rule(INNER, IN_W, {IN_W: IN_W})
    rule(JOINING, SPACE, {})
    rule(SINGLE, NONE, {})
    rule(SHORT, NEED1, {IN_P: IN_P, SPACE: IN_P})
    rule(LONG, NEED2, {IN_P: IN_P, SPACE: IN_P})
    rule(RESET, NONE, {})
    return step, starts


STEP, STARTS = _automaton()


@lru_cache(1)
def _monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """All functions from state to state that texts can make: ``functions``, those of symbols, and ``compose[f, g]`` (f first)."""
    index = {tuple(range(8)): 0}
    functions = [tuple(range(8))]
    symbols = [tuple(int(x) for x in STEP[:, s]) for s in range(9)]
    at = 0
    while at < len(functions):
        for g in symbols:
            h = tuple(g[x] for x in functions[at])
            if h not in index:
                index[h] = len(functions)
                functions.append(h)
        at += 1
    table = np.array(functions, np.uint8)
    compose = np.array([[index[tuple(int(y) for y in table[g][table[f]])] for g in range(len(table))] for f in range(len(table))], np.uint16)
    return table, np.array([index[s] for s in symbols], np.uint16), compose


def _states_before(symbols: np.ndarray) -> np.ndarray:
    """The automaton's state before each symbol, by an associative scan of the symbols' transition functions.

    Symbols stand in columns of blocks. The functions of all blocks are composed side by side, the blocks'
    functions are scanned in turn, and from the state each block starts in all blocks are walked side by side.
    """
    table, of_symbol, compose = _monoid()
    n = len(symbols)
    width = max(1, min(1024, int(n**0.5)))
    high = -(-n // width)
    grid = np.full(high * width, RESET, np.uint8)
    grid[:n] = symbols
    grid = np.ascontiguousarray(grid.reshape(high, width).T)
    whole = of_symbol[grid[0]]
    for column in grid[1:]:
        whole = compose[whole, of_symbol[column]]
    prefix, acc = np.zeros(high, np.uint16), 0
    for i, f in enumerate(whole.tolist()):
        prefix[i] = acc
        acc = int(compose[acc, f])
    state = table[prefix, NONE]
    out = np.empty((width, high), np.uint8)
    for k, column in enumerate(grid):
        out[k] = state
        state = STEP[state, column]
    return np.ascontiguousarray(out.T).reshape(-1)[:n]


@lru_cache(1)
def _classes() -> np.ndarray:
    """Class of every code point: letter, number, other, or white space (as INNER)."""
    points = "".join(chr(i) if not 0xD800 <= i < 0xE000 else "\0" for i in range(0x110000))
    out = np.full(0x110000, OTHER, np.uint8)
    for pattern, kind in ((r"\p{L}", LETTER), (r"\p{N}", NUMBER), (r"\s", INNER)):
        out[[m.start() for m in regex.finditer(pattern, points)]] = kind
    return out


def piece_starts(text: str, bounds: np.ndarray) -> np.ndarray:
    """Where pieces start in joined texts that end at ``bounds``; a piece is what the vocabulary's pattern splits off."""
    points = np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)
    n = len(points)
    symbols = _classes()[points]
    last = np.zeros(n + 1, bool)  # the next code point is of another text
    last[bounds[bounds > 0] - 1] = True
    blank = symbols == INNER
    before_text = np.zeros(n, bool)  # white space that is followed by none
    before_text[:-1] = blank[:-1] & ~blank[1:] & ~last[: n - 1]
    symbols[before_text] = np.where(points[before_text] == 32, JOINING, SINGLE)
    quotes = np.flatnonzero(points == 39)
    if len(quotes):
        pad = np.concatenate([points, [0, 0]])
        one, two = pad[quotes + 1], pad[quotes + 2]
        inside = ~last[quotes]
        for word in CONTRACTIONS:
            hit = inside & (one == ord(word[0]))
            if len(word) == 2:
                hit &= (two == ord(word[1])) & ~last[np.minimum(quotes + 1, n)]
            symbols[quotes[hit]] = SHORT if len(word) == 1 else LONG
    first = np.concatenate([[0], bounds[:-1]])
    first = first[first < n]
    # in the scan a text's last symbol leaves the state behind that texts start in
    scanned = symbols.copy()
    scanned[first[first > 0] - 1] = RESET
    starts = STARTS[_states_before(scanned), symbols]
    starts[first] = True
    return np.flatnonzero(starts)


def merged(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of a piece: the adjacent pair of lowest rank, then leftmost, is merged until none is left."""
    if (whole := ranks.get(piece)) is not None:
        return [whole]
    parts = [piece[i : i + 1] for i in range(len(piece))]
    after, before = [*range(1, len(parts)), -1], list(range(-1, len(parts) - 1))
    heap = [(r, i, a + b) for i, (a, b) in enumerate(pairwise(parts)) if (r := ranks.get(a + b)) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, joint = heapq.heappop(heap)
        j = after[i] if parts[i] else -1
        if j < 0 or len(parts[i]) + len(parts[j]) != len(joint) or parts[i] + parts[j] != joint:
            continue
        parts[i], parts[j] = joint, b""
        after[i] = after[j]
        if after[j] >= 0:
            before[after[j]] = i
        for a in (before[i], i):
            if a >= 0 and (b := after[a]) >= 0 and (r := ranks.get(parts[a] + parts[b])) is not None:
                heapq.heappush(heap, (r, a, parts[a] + parts[b]))
    return [ranks[p] for p in parts if p]


def read_ranks(name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> dict[bytes, int]:
    """The vocabulary as a rank file gives it: bytes of a token -> id."""
    with open(os.path.join(folder, f"{name}.tiktoken"), "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, lines)}


class Encoder:
    """Ids of batches of texts; pieces seen before are looked up, new ones merged."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        self.ranks = ranks
        self._new()

    def _new(self) -> None:
        self.numbers: dict[str, int] = {}
        self.flat, self.ends = np.zeros(1024, np.int32), np.zeros(1025, np.int64)

    def _learn(self, pieces: list[str]) -> None:
        for piece in pieces:
            ids = merged(piece.encode("utf-8", "surrogatepass"), self.ranks)
            k = self.numbers[piece] = len(self.numbers)
            if k + 1 >= len(self.ends):
                self.ends = np.concatenate([self.ends, np.zeros(len(self.ends), np.int64)])
            a = self.ends[k]
            self.ends[k + 1] = b = a + len(ids)
            if b > len(self.flat):
                self.flat = np.concatenate([self.flat, np.zeros(max(len(self.flat), len(ids)), np.int32)])
            self.flat[a:b] = ids

    def pieces(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Piece numbers of all texts in a row, where each text's pieces end, and the pieces' offsets in their text."""
        bounds = np.cumsum([len(x) for x in texts])
        joined = "".join(texts)
        if not joined:
            return np.zeros(0, np.int64), np.zeros(len(texts), np.int64), np.zeros(0, np.int64)
        if len(self.numbers) > CACHED:
            self._new()
        starts = piece_starts(joined, bounds)
        cuts = [*starts.tolist(), len(joined)]
        found = list(map(joined.__getitem__, map(slice, cuts, cuts[1:])))
        if new := set(found) - self.numbers.keys():
            self._learn(sorted(new))
        numbers = np.fromiter(map(self.numbers.__getitem__, found), np.int64, len(found))
        ends = np.searchsorted(starts, bounds)
        origin = np.repeat(bounds - [len(x) for x in texts], np.diff(ends, prepend=0))
        return numbers, ends, starts - origin

    def sizes(self, texts: list[str]) -> np.ndarray:
        """Number of ids of each text."""
        numbers, ends, _ = self.pieces(texts)
        total = np.concatenate([[0], np.cumsum(self.ends[numbers + 1] - self.ends[numbers])])
        return np.diff(total[ends], prepend=0)

    def ids(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and where those of each text end."""
        numbers, ends, _ = self.pieces(texts)
        a = self.ends[numbers]
        n = self.ends[numbers + 1] - a
        total = np.concatenate([[0], np.cumsum(n)])
        at = np.repeat(a - total[:-1], n) + np.arange(total[-1])
        return self.flat[at], total[ends]


def _parts(texts: list[str]) -> Iterator[tuple[int, int]]:
    """Stretches of texts of about SCAN code points; a longer text is one by itself, read whole."""
    start, size = 0, 0
    for i, x in enumerate(texts):
        if size and size + len(x) > SCAN:
            yield start, i
            start, size = i, 0
        size += len(x)
    yield start, len(texts)


@lru_cache(1)
def _encoder(key: str) -> Encoder:
    return Encoder(_SHIPPED[key])


_SHIPPED: dict[str, dict[bytes, int]] = {}


def _worker(key: str, ranks: dict[bytes, int]) -> Encoder:
    """One encoder per Python worker, kept for later tasks."""
    _SHIPPED.setdefault(key, ranks)
    return _encoder(key)


def encoded(docs: DataFrame, key: str = "doc_id", text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS, with_offsets: bool = False) -> DataFrame:
    """``key, ids``: the token ids of every text, without special tokens; an empty list for empty and null texts.

    The names of special tokens are ordinary text. The vocabulary (fixed size) is broadcast. No shuffle.
    ``with_offsets`` adds ``offsets``, where each piece starts in the text (in code points), and ``piece_ids``,
    the number of ids up to its end: any stretch of ids can so be found in the text again.
    """
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(f"{folder}/{name}", ranks.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(1).to_pylist()]
            for a, b in _parts(texts):
                ids, ends = encoder.ids(texts[a:b])
                lists = [_lists(ids, ends)]
                if with_offsets:
                    numbers, piece_ends, offsets = encoder.pieces(texts[a:b])
                    n = encoder.ends[numbers + 1] - encoder.ends[numbers]
                    before = np.repeat(np.concatenate([[0], ends[:-1]]), np.diff(piece_ends, prepend=0))
                    lists += [_lists(offsets, piece_ends), _lists(np.cumsum(n) - before, piece_ends)]
                yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), *lists], names=["key", "ids", "offsets", "piece_ids"][: 1 + len(lists)])

    slim = docs.select(F.col(key).cast("long").alias("key"), F.col(text).alias("text"))
    return slim.mapInArrow(run, "key long, ids array<int>" + (", offsets array<int>, piece_ids array<int>" if with_offsets else "")).withColumnRenamed("key", key)


def _lists(values: np.ndarray, ends: np.ndarray) -> pa.ListArray:
    return pa.ListArray.from_arrays(pa.array(np.concatenate([[0], ends]), pa.int32()), pa.array(values, pa.int32()))


def decoded(ids: DataFrame, key: str = "doc_id", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """``key, text``: the texts of token ids; an empty text for empty and null lists. Ids that aren't in the vocabulary are an error."""
    ranks = ids.sparkSession.sparkContext.broadcast(read_ranks(name, folder))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        back = {v: k for k, v in ranks.value.items()}
        for batch in batches:
            texts = [b"".join(map(back.__getitem__, x or ())).decode("utf-8", "surrogatepass") for x in batch.column(1).to_pylist()]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(texts, pa.string())], names=["key", "text"])

    return ids.select(F.col(key).cast("long").alias("key"), "ids").mapInArrow(run, "key long, text string").withColumnRenamed("key", key)


def token_sizes(docs: DataFrame, keep: list[str], text: str = "text", name: str = "byte_bpe_50k", folder: str = TOKENIZERS) -> DataFrame:
    """Columns ``keep`` and ``n_tokens`` of every text; 0 for empty and null texts."""
    ranks = docs.sparkSession.sparkContext.broadcast(read_ranks(name, folder))
    slim = docs.select(*keep, F.col(text).alias("_text"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder = _worker(f"{folder}/{name}", ranks.value)
        for batch in batches:
            texts = [x or "" for x in batch.column(len(keep)).to_pylist()]
            sizes = np.concatenate([np.zeros(0, np.int64), *[encoder.sizes(texts[a:b]) for a, b in _parts(texts)]])
            yield pa.RecordBatch.from_arrays([*batch.columns[:-1], pa.array(sizes, pa.int64())], names=[*keep, "n_tokens"])

    fields = ", ".join(f"`{c}` {slim.schema[c].dataType.simpleString()}" for c in keep)
    return slim.mapInArrow(run, f"{fields}, n_tokens long")
