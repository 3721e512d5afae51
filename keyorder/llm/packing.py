"""Vector bin packing of token sequences for training.

Every example is a vector of demands: tokens, one segment, loss-bearing tokens.
A sequence is a bin with a limit on each.  One bin is open at a time; the
example whose demands have the largest dot product with what the bin has left
goes in, until none fits.  If more than ``max_padding`` tokens are then still
free, the head with the largest dot product among all examples' heads that fit
is cut off and fills the bin.

Packing is local to a task: a task keeps a bounded window of examples, carries
what is left into the next window, and cuts only its very last bin into powers
of two, which need no padding.  So there is no shuffle, memory doesn't grow
with the input, and a lost task is redone from its own split of the input.

Null and empty texts hold only the closing id, null prompts nothing.  Repeated
rows are packed as often as they occur, ties go to the example that came first,
a text of any length is cut into as many pieces as it needs, an empty table
gives no rows, and only the named columns are read, whatever others are called.
Control strings of the vocabulary inside a text are ordinary text unless
``control_ids`` is set: a document can't forge the end of another.
"""

from __future__ import annotations

import os
from collections.abc import Iterator
from dataclasses import dataclass, field
from functools import lru_cache
from itertools import pairwise

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.llm.common import released, slices, text_buffer
from keyorder.llm.shingles import span_hashes

CHUNK_BYTES = 1 << 20
#: Words whose ids a Python worker keeps, from the second time on that it meets them; beyond it words are encoded as they come.
CACHE_WORDS = 250_000
CACHE_WORD_BYTES = 64
#: Flags, by hash, of the words that a worker has met.
MET_FLAGS = 1 << 22


@dataclass(frozen=True)
class Limits:
    tokens: int = 2048
    segments: int = 256
    loss: int = 2048
    #: Free tokens that a bin may keep rather than cut an example.
    max_padding: int = 8
    #: Examples that wait for a place in a task.
    window: int = 2048

    def __post_init__(self) -> None:
        if min(self.tokens, self.segments, self.loss, self.window) < 1 or self.max_padding < 0:
            raise ValueError(f"no example could ever be placed under {self}")


@lru_cache(maxsize=4)
def load_tokenizer(path: str, control_ids: bool = False):
    os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
    from tokenizers import Tokenizer

    tokenizer = Tokenizer.from_file(path)
    tokenizer.encode_special_tokens = not control_ids
    return tokenizer


@lru_cache(maxsize=2)
def closes_word(path: str) -> np.ndarray:
    """Which ids end a word of letters: each such word has exactly one of them, its last."""
    vocabulary = load_tokenizer(path).get_vocab()
    out = np.zeros(max(vocabulary.values()) + 1, bool)
    out[[i for token, i in vocabulary.items() if token.endswith("</w>")]] = True
    return out


@lru_cache(maxsize=2)
def plain_tokenizer(path: str):
    """For lower-case ASCII letters and blanks, which the normaliser and the splitter only take apart at the blanks."""
    from tokenizers import Tokenizer, normalizers, pre_tokenizers

    tokenizer = Tokenizer(load_tokenizer(path).model)  # shares the vocabulary
    tokenizer.normalizer = normalizers.Sequence([])
    tokenizer.pre_tokenizer = pre_tokenizers.WhitespaceSplit()
    return tokenizer


@lru_cache(maxsize=1)
def word_cache(path: str) -> tuple[dict[bytes, bytes], np.ndarray]:
    """Word to packed ids, and flags of words met; lives as long as the Python worker, so later tasks find it filled."""
    return {}, np.zeros(MET_FLAGS, bool)


@lru_cache(maxsize=1)
def _byte_kinds() -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Bytes that are blanks, ASCII letters and digits, and ASCII signs but the apostrophe."""
    code = np.arange(256)
    plain = np.array([chr(c).isalnum() and c < 128 for c in code])
    blank = np.isin(code, (9, 10, 13, 32))
    return blank, plain, (code > 32) & (code < 127) & ~plain & (code != 39)


def split_words(data: bytes, at: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Bytes of concatenated texts, where words begin and end in them, and the n + 1 offsets of the texts' words.

    Words end at blanks, tabs and line breaks, which the tokenizer's normaliser
    and splitter never join across, and so does a single sign beside them that
    touches an ASCII letter or digit.  ASCII letters are lower-cased, as the
    normaliser would; only where combining marks occur, which may compose with
    one case and not with the other, is that left to it.
    """
    if b"\xcc" not in data and b"\xcd" not in data:
        data = data.lower()
    blank, plain, sign = _byte_kinds()
    heads = np.unique(at[1:-1])
    # A blank before, between and after the texts: neighbours of each byte in its own text.
    code = np.concatenate([[np.uint8(32)], np.insert(np.frombuffer(data, np.uint8), heads, np.uint8(32)), [np.uint8(32)]])
    blanks, signs, plains = blank[code], sign[code], plain[code]
    begins = np.zeros(len(code) + 1, bool)
    begins[1:-2] = plains[:-2] & signs[1:-1] & blanks[2:]
    begins[2:-1] |= blanks[:-2] & signs[1:-1] & plains[2:]
    begins[1:-1] |= blanks[:-1] & ~blanks[1:]
    ends = ~blanks & (begins[1:] | np.append(blanks[1:], True))
    begins = np.flatnonzero(begins)
    return code, begins, np.flatnonzero(ends) + 1, np.searchsorted(begins, at + np.searchsorted(heads, at, side="right") + 1)


def distinct(code: np.ndarray, begins: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(hash and place of one word of each kind, and the kind of every word), kinds in order of their hashes.

    Words are of one kind if two independent 64-bit hashes are equal.
    """
    first, second = (span_hashes(code, begins, ends, k) for k in (0, 1))
    order = np.argsort(first)
    fresh = np.ones(len(order), bool)
    ranked, check = first[order], second[order]
    fresh[1:] = ranked[1:] != ranked[:-1]
    if not (fresh[1:] | (check[1:] == check[:-1])).all():  # two words with one hash: told apart by both
        order = np.lexsort((second, first))
        ranked, check = first[order], second[order]
        fresh[1:] = (ranked[1:] != ranked[:-1]) | (check[1:] != check[:-1])
    kind = np.empty(len(order), np.int64)
    kind[order] = np.cumsum(fresh) - 1
    return ranked[fresh], order[fresh], kind


class WordCoder:
    """Ids of texts by way of a cache of words: a text's ids are those of its words, one after the other."""

    def __init__(self, path: str, closing_id: int | None, control_ids: bool = False):
        self.tokenizer = load_tokenizer(path)
        self.closing = closing_id
        self.plain = plain_tokenizer(path)
        self.words, self.met = word_cache(path)
        self.closes = closes_word(path)
        self.control = load_tokenizer(path, True) if control_ids else None
        self.marks = tuple(t.content.encode() for t in self.tokenizer.get_added_tokens_decoder().values()) if control_ids else ()

    def _look_up(self, new: list[bytes]) -> list[bytes]:
        """Packed ids of words, a thousand of them to a call."""
        plain, letters, others = [], [], []
        for i, w in enumerate(new):
            (plain if w.isalpha() else letters if w.decode().isalpha() else others).append(i)  # of bytes only ASCII is alpha
        found = [b""] * len(new)
        for coder, places in ((self.plain, plain), (self.tokenizer, letters)):
            for at in range(0, len(places), 1000):
                part = places[at : at + 1000]
                said = b" ".join([new[i] for i in part])
                said = said.lower().decode() if coder is self.plain else said.decode()
                ids = np.array(coder.encode_batch_fast([said], add_special_tokens=False)[0].ids, "<u4")
                ends = np.flatnonzero(self.closes[ids]) + 1
                if len(ends) != len(part):  # letters that the normaliser takes apart
                    others += part
                    continue
                data, cuts = ids.tobytes(), (4 * ends).tolist()
                for i, a, b in zip(part, [0, *cuts], cuts):
                    found[i] = data[a:b]
        for at in range(0, len(others), 1000):
            part = others[at : at + 1000]
            words = [new[i].decode() for i in part]
            coded = self.tokenizer.encode(" ".join(words), add_special_tokens=False)
            data = np.array(coded.ids, "<u4").tobytes()
            begins = np.array([a for a, _ in coded.offsets], np.int64)
            lengths = np.fromiter(map(len, words), np.int64, len(words)) + 1
            cuts = (4 * np.searchsorted(begins, np.cumsum(lengths) - lengths)).tolist()
            for i, a, b in zip(part, cuts, [*cuts[1:], len(data)]):
                found[i] = data[a:b]
        return found

    def _ids_of(self, words: list[bytes], hashes: np.ndarray) -> list[bytes]:
        ids = list(map(self.words.get, words))
        new = [i for i, x in enumerate(ids) if x is None]
        flags = hashes[new] & np.uint64(MET_FLAGS - 1)
        met = self.met[flags].tolist()
        self.met[flags] = True
        room = CACHE_WORDS - len(self.words)
        for i, found, again in zip(new, self._look_up([words[i] for i in new]), met, strict=True):
            ids[i] = found
            if again and room > 0 and len(words[i]) <= CACHE_WORD_BYTES:  # most words that are met once aren't met again
                self.words[words[i]] = found
                room -= 1
        return ids

    def encode(self, column: pa.Array, closed: bool = True) -> list[np.ndarray]:
        """Ids of the texts of a string column, each with the closing id if ``closed``."""
        data, at = text_buffer(column)
        code, begins, ends, of = split_words(data, at)
        hashes, one, kind = distinct(code, begins, ends)
        said = code.tobytes()
        words = [said[a:b] for a, b in zip(begins[one].tolist(), ends[one].tolist())]
        ids = self._ids_of(words, hashes)
        size = np.fromiter(map(len, ids), np.int64, len(ids)) // 4
        flat, place = np.frombuffer(b"".join(ids), "<u4"), np.cumsum(size) - size
        lengths = size[kind]
        to = np.cumsum(lengths)
        where = np.repeat(place[kind] - (to - lengths), lengths) + np.arange(to[-1] if len(to) else 0)
        cuts = np.concatenate([[0], to])[of]
        out = flat[where]
        if closed and self.closing is not None:
            out = np.insert(out, cuts[1:], np.uint32(self.closing))
            cuts = cuts + np.arange(len(cuts))
        texts = [out[a:b].copy() for a, b in pairwise(cuts.tolist())]  # so that one that waits keeps no others
        if self.control is not None and any(m in data for m in self.marks):
            closing = [self.closing] if closed and self.closing is not None else []
            for i, (a, b) in enumerate(pairwise(at.tolist())):
                if any(m in data[a:b] for m in self.marks):
                    texts[i] = np.array(self.control.encode(data[a:b].decode(), add_special_tokens=False).ids + closing, "<u4")
        return texts


@dataclass
class Packer:
    """Bins of one task.  ``add`` examples, then ``drain``; both yield rows of placed pieces."""

    limits: Limits
    first_bin: int
    examples: list = field(default_factory=list)

    def __post_init__(self) -> None:
        # Columns of the waiting pieces: example, start, length, loss-bearing tokens from here on.
        self.waiting = np.empty((0, 4), np.int64)
        self.bins = self.first_bin

    def _loss(self, start, stop, loss_from):
        return np.maximum(0, stop - np.maximum(start, loss_from))

    def add(self, examples: list[tuple[object, np.ndarray, int]]) -> Iterator[tuple]:
        """examples: (id, ids, index of the first loss-bearing token)."""
        lim = self.limits
        base = len(self.examples)
        self.examples += examples
        fresh = []
        for i, (_, ids, loss_from) in enumerate(examples, base):
            n, start = len(ids), 0
            while n - start >= lim.tokens and self._loss(start, start + lim.tokens, loss_from) <= lim.loss:
                yield self._row(self.bins, 0, i, start, lim.tokens)
                self.bins += 1
                start += lim.tokens
            if start < n:
                fresh.append((i, start, n - start, loss_from))
        if fresh:
            self.waiting = np.concatenate([self.waiting, np.array(fresh, np.int64)])
        while len(self.waiting) >= lim.window:
            yield from self._fill(to=lim.window // 2)
        self._forget()

    def drain(self) -> Iterator[tuple]:
        if len(self.waiting):
            yield from self._fill(to=0)
        self.examples = []

    def _forget(self) -> None:
        """Drop the ids of examples that are placed."""
        if len(self.examples) > 2 * self.limits.window:
            used, at = np.unique(self.waiting[:, 0], return_inverse=True)
            self.examples = [self.examples[i] for i in used.tolist()]
            self.waiting[:, 0] = at

    def _row(self, bin_id: int, offset: int, example: int, start: int, length: int) -> tuple:
        key, ids, loss_from = self.examples[example]
        return (
            key, start, length, ids[start : start + length].tobytes(), len(ids),
            bin_id, offset, int(self._loss(start, start + length, loss_from)),
        )

    def _fill(self, to: int) -> Iterator[tuple]:
        lim = self.limits
        w = self.waiting
        size = np.array([lim.tokens, lim.segments, lim.loss], float)
        length, free_rows = w[:, 2].copy(), np.ones(len(w), bool)
        start, loss_from = w[:, 1].copy(), w[:, 3]
        loss = self._loss(start, start + length, loss_from)
        left = len(w)
        while left > to:
            room = size.copy()
            placed: list[tuple[int, int, int]] = []
            while left and room[0] >= 1 and room[1] >= 1:
                share = room / size / size
                fits = free_rows & (length <= room[0]) & (loss <= room[2])
                at = np.flatnonzero(fits)
                if len(at):
                    best = int(at[np.argmax(length[at] * share[0] + loss[at] * share[2])])
                    taken = int(length[best])
                    free_rows[best] = False
                    left -= 1
                elif room[0] > lim.max_padding or not placed:
                    best, taken = self._cut(free_rows, start, length, loss_from, room)
                    if not taken:
                        break
                else:
                    break
                used = int(self._loss(start[best], start[best] + taken, loss_from[best]))
                placed.append((best, int(start[best]), taken))
                room -= (taken, 1, used)
                if free_rows[best]:  # the tail of a cut example waits on
                    start[best] += taken
                    length[best] -= taken
                    loss[best] = self._loss(start[best], start[best] + length[best], loss_from[best])
            yield from self._close(placed, [int(w[i, 0]) for i, _, _ in placed], last=not left)
        self.waiting = np.stack([w[:, 0], start, length, loss_from], 1)[free_rows]

    def _cut(self, free, start, length, loss_from, room) -> tuple[int, int]:
        """The waiting piece, and how much of its head, with the largest dot product among heads that fit."""
        at = np.flatnonzero(free)
        can = np.minimum(length[at], int(room[0]))
        can = np.minimum(can, np.maximum(loss_from[at], start[at]) + int(room[2]) - start[at])
        size = np.array([self.limits.tokens, self.limits.segments, self.limits.loss], float)
        share = room / size / size
        best = int(np.argmax(can * share[0] + self._loss(start[at], start[at] + can, loss_from[at]) * share[2]))
        return int(at[best]), max(0, int(can[best]))

    def _close(self, placed: list[tuple[int, int, int]], examples: list[int], last: bool) -> Iterator[tuple]:
        total = sum(n for _, _, n in placed)
        caps = [self.limits.tokens]
        if last and self.limits.tokens - total > self.limits.max_padding:
            caps = [1 << b for b in reversed(range(total.bit_length())) if total >> b & 1]
        caps = caps[::-1]
        cap, offset = caps.pop(), 0
        for (_, start, length), example in zip(placed, examples, strict=True):
            while length:
                n = min(length, cap - offset)
                yield self._row(self.bins, offset, example, start, n)
                start, length, offset = start + n, length - n, offset + n
                if offset == cap and caps:
                    cap, offset = caps.pop(), 0
                    self.bins += 1
        self.bins += 1


SCHEMA = [
    ("start", T.LongType()), ("length", T.LongType()), ("ids", T.BinaryType()), ("doc_tokens", T.LongType()),
    ("sequence_id", T.LongType()), ("offset", T.LongType()), ("loss_tokens", T.LongType()),
]
_ARROW = [pa.int64(), pa.int64(), pa.binary(), pa.int64(), pa.int64(), pa.int64(), pa.int64()]


def pack(
    df: DataFrame, id_col: str, text_col: str, tokenizer_path: str, *, closing_id: int | None = 1,
    limits: Limits = Limits(), prompt_col: str | None = None, loss_from_col: str | None = None, control_ids: bool = False,
) -> DataFrame:
    """One row per piece: where it comes from, its ids, and its place in a sequence.

    ``prompt_col``: a text whose ids come before those of ``text_col`` and bear
    no loss.  ``loss_from_col``: else, the index of each example's first
    loss-bearing token.  With neither, only a text's first token bears none.
    Sequence ids are unique, with the number of the task above 40 bits.
    """
    source = df.select(
        F.col(id_col),
        F.col(text_col).cast("string").alias("_text"),
        (F.coalesce(F.col(loss_from_col), F.lit(0)) if loss_from_col else F.lit(1)).cast("long").alias("_loss_from"),
        *([F.col(prompt_col).cast("string").alias("_prompt")] if prompt_col else []),
    )

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        coder = WordCoder(tokenizer_path, closing_id, control_ids)
        packer = Packer(limits, TaskContext.get().partitionId() << 40)
        kind = None

        def out(rows):
            cols = list(zip(*rows, strict=True))
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], kind), *(pa.array(c, t) for c, t in zip(cols[1:], _ARROW, strict=True))], [id_col, *(n for n, _ in SCHEMA)]
            )

        for batch in batches:
            kind = batch.schema.field(0).type
            for begin, end in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                ids, loss_from = coder.encode(part.column(1)), part.column(2).to_pylist()
                if prompt_col:
                    prompts = coder.encode(part.column(3), closed=False)
                    ids, loss_from = [np.concatenate(x) for x in zip(prompts, ids, strict=True)], list(map(len, prompts))
                rows = list(packer.add(list(zip(part.column(0).to_pylist(), ids, loss_from, strict=True))))
                if rows:
                    yield out(rows)
        if rows := list(packer.drain()):
            yield out(rows)

    schema = T.StructType([df.schema[id_col], *(T.StructField(n, t) for n, t in SCHEMA)])
    return source.mapInArrow(released(run), schema)
