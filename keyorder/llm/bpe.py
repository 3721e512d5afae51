"""Byte-level BPE encoding and decoding.

Pre-tokenisation is vectorised and uses no regex on texts; the classes of code
points alone are read off the split pattern, once.  Every code point becomes a symbol (its class plus the little look-ahead the split pattern needs),
every symbol is a transition function on eight automaton states, and functions
compose associatively, so an inclusive scan over a whole batch of concatenated
texts gives the state at every code point.  The finite monoid generated by the
symbols is enumerated once; composing two functions is then one table lookup.
Slices between boundaries feed a bounded cache of merged pieces, and the byte
offset of every piece is kept: ``decode`` can go straight to some pieces of a text.

Null and empty texts encode to no ids, a text of any length is encoded whole,
repeated rows are encoded each, an empty table gives no rows, and only the named
columns are read, whatever others are called.  Invalid ids raise in ``decode``.
"""

from __future__ import annotations

import base64
import heapq
from collections.abc import Iterator
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.llm.common import slices, text_buffer

#: Text bytes handled at once in a task.
CHUNK_BYTES = 1 << 20
#: Merged pieces that a Python worker keeps; beyond it pieces are merged as they come.
CACHE_PIECES = 300_000
#: Longer pieces are merged but not kept.
CACHE_PIECE_BYTES = 64

# Code point classes.
OTHER, LETTER, NUMBER, SPACE = range(4)
# Symbols: classes with look-ahead.
S_LETTER, S_NUMBER, S_OTHER, S_JOIN, S_BODY, S_TAIL, S_SHORT, S_LONG = range(8)
# States: nothing open; in a run of letters, numbers, others; after a blank that
# joins the next run; in a run of white space; one or two letters of a
# contraction outstanding.
START, IN_L, IN_N, IN_O, JOINED, IN_W, ONE_LEFT, TWO_LEFT = range(8)
N_STATES = 8


@lru_cache(maxsize=1)
def class_ranges() -> tuple[tuple[int, int, int], ...]:
    """(first, last, class) of code points, asked of the tiktoken library itself.

    Each class is read off an encoding whose pattern is just that class, so the
    Unicode version is always the library's own.
    """
    import tiktoken

    text = "".join(map(chr, [*range(0xD800), *range(0xE000, 0x110000)]))
    single = {bytes([b]): b for b in range(256)}
    ranges = []
    for kind, pattern in ((LETTER, r"\p{L}+"), (NUMBER, r"\p{N}+"), (SPACE, r"\s+")):
        probe = tiktoken.Encoding("probe", pat_str=pattern, mergeable_ranks=single, special_tokens={})
        found = np.array([ord(c) for c in bytes(probe.encode_ordinary(text)).decode()])
        cut = np.flatnonzero(np.diff(found) != 1) + 1
        for run in np.split(found, cut):
            ranges.append((int(run[0]), int(run[-1]), kind))
    return tuple(ranges)


def class_table(ranges: tuple[tuple[int, int, int], ...]) -> np.ndarray:
    table = np.full(0x110000, OTHER, np.uint8)
    for first, last, kind in ranges:
        table[first : last + 1] = kind
    return table


def _step(state: int, symbol: int) -> tuple[int, bool]:
    """Next state, and whether a piece begins at this code point."""
    if symbol == S_LETTER:
        if state == TWO_LEFT:
            return ONE_LEFT, False
        if state == ONE_LEFT:
            return START, False
        return IN_L, state not in (IN_L, JOINED)
    if symbol == S_NUMBER:
        return IN_N, state not in (IN_N, JOINED)
    if symbol == S_OTHER:
        return IN_O, state not in (IN_O, JOINED)
    if symbol in (S_SHORT, S_LONG):  # an apostrophe inside other signs, or after a joined blank, is one of them
        if state in (IN_O, JOINED):
            return IN_O, False
        return (ONE_LEFT if symbol == S_SHORT else TWO_LEFT), True
    if symbol == S_JOIN:
        return JOINED, True
    if symbol == S_BODY:
        return IN_W, state != IN_W
    return START, True  # S_TAIL


@lru_cache(maxsize=1)
def monoid() -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray, int]:
    """Element of each symbol (in a text, first of a text), product table, action, begins table, identity."""
    table = [[_step(s, y) for s in range(N_STATES)] for y in range(8)]
    inside = [tuple(t[0] for t in row) for row in table]
    first = [(row[START][0],) * N_STATES for row in table]
    identity = tuple(range(N_STATES))
    elements = list(dict.fromkeys([identity, *inside, *first]))
    index = {f: i for i, f in enumerate(elements)}
    products: dict[tuple[int, int], int] = {}
    done = 0
    while done < len(elements):
        done = len(elements)
        for a in range(done):
            for b in range(done):
                if (a, b) not in products:
                    both = tuple(elements[b][s] for s in elements[a])
                    if both not in index:
                        index[both] = len(elements)
                        elements.append(both)
                    products[a, b] = index[both]
    k = len(elements)
    product = np.empty((k, k), np.int32)
    for a in range(k):
        for b in range(k):
            product[a, b] = products[a, b]
    begins = np.array([[t[1] for t in row] for row in table], bool)
    return (
        np.array([index[f] for f in inside + first], np.int32),
        product,
        np.array(elements, np.uint8),
        begins,
        index[identity],
    )


def scan(elements: np.ndarray) -> np.ndarray:
    """Inclusive scan of monoid elements: blocks side by side, then their totals, then both together."""
    _, product, _, _, identity = monoid()
    n, k = len(elements), len(product)
    flat = product.ravel()
    if n <= 64:
        out = np.empty(n, np.int32)
        acc = identity
        for i, x in enumerate(elements.tolist()):
            acc = out[i] = flat[acc * k + x]
        return out
    rows = 64
    cols = -(-n // rows)
    grid = np.full(rows * cols, identity, np.int32)
    grid[:n] = elements
    grid = np.ascontiguousarray(grid.reshape(cols, rows).T)
    for j in range(1, rows):
        np.take(flat, grid[j - 1] * k + grid[j], out=grid[j])
    before = np.empty(cols, np.int32)
    before[0] = identity
    before[1:] = scan(grid[-1])[:-1]
    return flat[before[None, :] * k + grid].T.reshape(-1)[:n]


def boundaries(points: np.ndarray, heads: np.ndarray, classes: np.ndarray) -> np.ndarray:
    """Indexes of code points at which pieces begin.

    points: code points of concatenated texts; heads: index of each non-empty text's first.
    """
    n = len(points)
    if not n:
        return np.empty(0, np.int64)
    kind = classes[points]
    is_head = np.zeros(n + 1, bool)
    is_head[heads] = True
    is_head[n] = True
    ends = is_head[1:]  # the next code point belongs to another text
    symbol = np.array([S_OTHER, S_LETTER, S_NUMBER, S_BODY], np.uint8)[kind]
    space = kind == SPACE
    if space.any():
        follows = np.empty(n, bool)  # a non-space of the same text follows
        follows[:-1] = ~space[1:]
        follows[-1] = False
        follows &= ~ends
        last = space & follows
        symbol[last] = np.where(points[last] == 0x20, S_JOIN, S_TAIL)
    quote = np.flatnonzero(points == 0x27)
    quote = quote[~ends[quote]]
    if len(quote):
        a = points[quote + 1]
        symbol[quote[np.isin(a, np.frombuffer(b"stmd", np.uint8))]] = S_SHORT
        b = np.where(ends[quote + 1], 0, points[np.minimum(quote + 2, n - 1)])
        two = ((a == 0x72) | (a == 0x76)) & (b == 0x65) | (a == 0x6C) & (b == 0x6C)
        symbol[quote[two]] = S_LONG
    of, _, action, begins, _ = monoid()
    held = scan(of[symbol + 8 * is_head[:n]])
    before = np.empty(n, np.uint8)
    before[1:] = action[held[:-1], START]
    before[is_head[:n]] = START
    return np.flatnonzero(begins[symbol, before])


def merge(piece: bytes, ranks: dict[bytes, int]) -> list[int]:
    """Ids of one piece: the lowest-ranked neighbouring pair merges first, the leftmost of equals."""
    whole = ranks.get(piece)
    if whole is not None:
        return [whole]
    n = len(piece)
    end = list(range(1, n + 1))  # of the part that starts here; 0: merged away
    left = list(range(-1, n - 1))
    heap = [(r, i, i + 2) for i in range(n - 1) if (r := ranks.get(piece[i : i + 2])) is not None]
    heapq.heapify(heap)
    while heap:
        _, i, to = heapq.heappop(heap)
        mid = end[i]
        if not mid or mid >= n or end[mid] != to:  # one of the two has changed since
            continue
        end[i], end[mid] = to, 0
        if to < n:
            left[to] = i
            if (r := ranks.get(piece[i : end[to]])) is not None:
                heapq.heappush(heap, (r, i, end[to]))
        if (j := left[i]) >= 0 and (r := ranks.get(piece[j:to])) is not None:
            heapq.heappush(heap, (r, j, to))
    ids, i = [], 0
    while i < n:
        ids.append(ranks[piece[i : end[i]]])
        i = end[i]
    return ids


@lru_cache(maxsize=2)
def load_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as lines:
        return {base64.b64decode(token): int(rank) for token, rank in (line.split() for line in lines if line.strip())}


class _Pieces(dict):
    """Piece to its ids as little-endian unsigned 32-bit integers, merged when first met."""

    def __init__(self, ranks: dict[bytes, int]):
        super().__init__()
        self.ranks = ranks

    def __missing__(self, piece: bytes) -> bytes:
        out = np.array(merge(piece, self.ranks), "<u4").tobytes()
        if len(piece) <= CACHE_PIECE_BYTES and len(self) < CACHE_PIECES:
            self[piece] = out
        return out


@lru_cache(maxsize=1)
def load_pieces(path: str) -> _Pieces:
    """Lives as long as the Python worker, so later tasks find it filled."""
    return _Pieces(load_ranks(path))


class Encoder:
    """Encodes batches of texts; one per task."""

    def __init__(self, pieces: _Pieces, ranges: tuple[tuple[int, int, int], ...]):
        self.classes = class_table(ranges)
        self.pieces = pieces

    def split(self, data: bytes, at: np.ndarray) -> np.ndarray:
        """Byte offsets at which pieces begin in concatenated texts; ``at``: offsets of the texts."""
        points = np.frombuffer(data.decode("utf-8").encode("utf-32-le"), np.uint32)
        heads = np.unique(at[:-1][np.diff(at) > 0])
        if len(points) == len(data):
            return boundaries(points, heads, self.classes)
        width = 1 + (points > 0x7F).astype(np.int64) + (points > 0x7FF) + (points > 0xFFFF)
        byte = np.cumsum(width) - width
        return byte[boundaries(points, np.searchsorted(byte, heads), self.classes)]

    def encode(self, column: pa.Array) -> tuple[list[bytes], list[bytes]]:
        """Ids, and piece offsets inside the text, of every text: little-endian unsigned 32-bit integers."""
        data, at = text_buffer(column)
        starts = self.split(data, at)
        cuts = [*starts.tolist(), len(data)]
        get = self.pieces.__getitem__
        ids = [get(data[a:b]) for a, b in pairwise(cuts)]
        of = np.searchsorted(starts, at).tolist()
        rows = range(len(column))
        return (
            [b"".join(ids[of[i] : of[i + 1]]) for i in rows],
            [(starts[of[i] : of[i + 1]] - at[i]).astype("<u4").tobytes() for i in rows],
        )


def encode(df: DataFrame, id_col: str, text_col: str, vocab_path: str) -> DataFrame:
    """(id, ids, piece_starts): packed ids of each text and the byte offset of each of its pieces.

    Both are little-endian unsigned 32-bit integers in binary columns.  Rows are
    independent: one narrow pass, no shuffle; other columns are not read.
    """
    ranges = class_ranges()
    kind = df.schema[id_col].dataType

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = Encoder(load_pieces(vocab_path), ranges)
        for batch in batches:
            for begin, end in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                coded = (pa.array(x, pa.binary()) for x in coder.encode(part.column(1)))
                yield pa.RecordBatch.from_arrays([part.column(0), *coded], [id_col, "ids", "piece_starts"])

    schema = T.StructType(
        [T.StructField(id_col, kind), T.StructField("ids", T.BinaryType()), T.StructField("piece_starts", T.BinaryType())]
    )
    return df.select(id_col, F.col(text_col).cast("string")).mapInArrow(run, schema)


def ids_of_pieces(ids: np.ndarray, piece_starts: np.ndarray, lengths: np.ndarray, pieces: tuple[int, int]) -> np.ndarray:
    """The ids of the pieces from one to before another; ``lengths``: bytes of each token."""
    ends = np.cumsum(lengths[ids])
    at = [piece_starts[p] if p < len(piece_starts) else ends[-1] if len(ends) else 0 for p in pieces]
    return ids[slice(*np.searchsorted(ends, at, side="right").tolist())]


def decode(encoded: DataFrame, id_col: str, vocab_path: str, pieces: tuple[int, int] | None = None) -> DataFrame:
    """The rows of ``encode`` with ``decoded``: the bytes that the ids stand for, or those of the given pieces alone."""
    kept = encoded.select(id_col, "ids", "piece_starts")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ranks = load_ranks(vocab_path)
        tokens = [b""] * (max(ranks.values(), default=-1) + 1)
        for token, rank in ranks.items():
            tokens[rank] = token
        get, lengths = tokens.__getitem__, np.fromiter(map(len, tokens), np.int64, len(tokens))
        for batch in batches:
            for begin, end in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                ids = [np.frombuffer(x or b"", "<u4") for x in part.column(1).to_pylist()]
                if pieces is not None:
                    starts = [np.frombuffer(x or b"", "<u4") for x in part.column(2).to_pylist()]
                    ids = [ids_of_pieces(i, s, lengths, pieces) for i, s in zip(ids, starts, strict=True)]
                texts = [b"".join(map(get, i.tolist())) for i in ids]
                yield pa.RecordBatch.from_arrays([*part.columns, pa.array(texts, pa.binary())], [*part.schema.names, "decoded"])

    return kept.mapInArrow(run, T.StructType([*kept.schema.fields, T.StructField("decoded", T.BinaryType())]))
