"""Language-model scores by stupid backoff, over count tables of a corpus.

Texts are kept in chunks of some megabytes.  For each order a chunk sends its
distinct n-grams, as hashes with their counts, to the range of each hash; there
the counts of all chunks are summed into a count table, a row for each range of
hashes.  To score texts, the n-grams of their chunks join the count table by
range and get the counts back; a chunk then holds the counts of all its n-grams
side by side, scores each word, and sums the scores of each document.  Where a
corpus scores itself, a range's table joins the very n-grams that it was summed
from, in the same task, so they are sent once.

A frequent n-gram is one entry for each chunk, not one for each occurrence, so
no hash is hot.  There is a range for every ``RANGE_WORDS`` words of the corpus:
what a task holds doesn't grow with it.  Chunks and ranges exchange packed
arrays of hashes, as a row for each n-gram and chunk takes about twice the disk.

A word after history h scores count(h word) / count(h) if the n-gram occurs
``MIN_COUNT`` times; else ``BACKOFF`` times its score after a shorter history;
and count(word) / words without any, where a word that the corpus lacks counts
as one.  Words are what ``[^\\x20\\x09-\\x0D]+`` matches, A-Z lower-cased.  N-grams
are told apart by 64-bit hashes.

Null texts, and those without a word, have no words and a null score; repeated
rows count and score each, texts of any length are taken whole, an empty table
gives no rows, ids may be of any type, and only the named columns are read.
"""

from __future__ import annotations

import math
from collections.abc import Iterator
from dataclasses import dataclass
from itertools import groupby, pairwise
from operator import itemgetter

import numpy as np
import pyarrow as pa
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from keyorder.llm.common import discard, released, scratch, slices, text_buffer, write_table
from keyorder.llm.shingles import mix, word_hashes

ORDER = 3
MIN_COUNT = 2
BACKOFF = 0.4
#: Text bytes of a chunk, about.
CHUNK_BYTES = 8 << 20
#: Words of the corpus for each range of hashes, but at least RANGES ranges for each shuffle partition.
RANGE_WORDS = 4 << 20
RANGES = 2


def _grams(words: np.ndarray, of: np.ndarray, order: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the n-grams that end at each word, and whether the word has so much history in its text."""
    n = len(words)
    if order == 1:
        return words, np.ones(n, bool)
    first = np.repeat(of[:-1], np.diff(of))
    whole = np.arange(n) - first >= order - 1
    out = words.copy()
    for back in range(1, order):  # the same hash for the same words, whatever the text
        out[back:] = mix(out[back:] * np.uint64(0x9E3779B97F4A7C15) + words[: n - back] + np.uint64(2 * back + 1))
        out[:back] = 0
    return out, whole


def _pack(values: np.ndarray) -> bytes:
    """Sorted distinct hashes as differences of six bytes each, or of eight where one is larger."""
    steps = np.diff(values, prepend=np.uint64(0))
    if len(steps) and int(steps[1:].max(initial=0)) >> 48 == 0:
        return b"\6" + values[:1].tobytes() + np.ascontiguousarray(steps[1:].view(np.uint8).reshape(-1, 8)[:, :6]).tobytes()
    return b"\x08" + values.tobytes()


def _unpack(data: bytes) -> np.ndarray:
    if data[:1] == b"\x08":
        return np.frombuffer(data, np.uint64, offset=1)
    steps = np.zeros((1 + (len(data) - 9) // 6, 8), np.uint8)
    steps[0] = np.frombuffer(data, np.uint8, 8, 1)
    steps[1:, :6] = np.frombuffer(data, np.uint8, offset=9).reshape(-1, 6)
    return np.cumsum(steps.view(np.uint64).reshape(-1), dtype=np.uint64)


def _chunks(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(chunk, ids, packed, words): texts of some megabytes, zero-joined lengths, as they come in a task."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(3)
        chunk = TaskContext.get().partitionId() << 24
        for batch in batches:
            for begin, end in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                data, at = text_buffer(part.column(1))
                words, _ = word_hashes(data, at)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array([chunk]), pa.ListArray.from_arrays(pa.array([0, end - begin], pa.int32()), part.column(0)), pa.array([packer.compress(data)]),
                        pa.array([at.astype("<i8").tobytes()]), pa.array([len(words)], pa.int64()),
                    ],
                    ["chunk", "ids", "packed", "at", "words"],
                )
                chunk += 1

    source = df.select(F.col(id_col).alias("id"), F.col(text_col).cast("string"))
    ids = T.ArrayType(source.schema["id"].dataType)
    kinds = (("chunk", T.LongType()), ("ids", ids), ("packed", T.BinaryType()), ("at", T.BinaryType()), ("words", T.LongType()))
    return source.mapInArrow(released(run), T.StructType([T.StructField(n, t) for n, t in kinds]))


def _words(packed: bytes, at: bytes) -> tuple[np.ndarray, np.ndarray]:
    data = zstandard.ZstdDecompressor().decompress(packed)
    return word_hashes(data, np.frombuffer(at, "<i8"))


@dataclass(frozen=True)
class Counts:
    """Count tables of a corpus: for each order, (place, grams, counts) of every range of hashes, hashes ascending.

    Of orders above one only n-grams that occur ``MIN_COUNT`` times are kept: all others count as unseen.
    """

    tables: tuple[str, ...]
    words: int
    ranges: int


_SENT = "place int, chunk long, grams binary, counts binary"


def _sent(chunks: DataFrame, order: int, ranges: int) -> DataFrame:
    """(place, chunk, grams, counts): the distinct n-grams of a chunk in each range of hashes, and how often it has them."""
    shift = np.uint64(64 - (ranges.bit_length() - 1))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer = zstandard.ZstdCompressor(1)
        for batch in batches:
            for chunk, packed, at in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                grams, whole = _grams(*_words(packed, at), order)
                values, counts = np.unique(grams[whole], return_counts=True)
                where = values >> shift
                cuts = [*np.flatnonzero(np.diff(where, prepend=np.uint64(ranges))).tolist(), len(values)]  # ranges that hold something
                for lo in range(0, len(cuts) - 1, 4096):
                    spans = [slice(a, b) for a, b in pairwise(cuts[lo : lo + 4097])]
                    yield pa.RecordBatch.from_arrays(
                        [
                            pa.array([int(where[s.start]) for s in spans], pa.int32()), pa.array([chunk] * len(spans), pa.int64()),
                            pa.array([_pack(values[s]) for s in spans]), pa.array([packer.compress(counts[s].astype("<u8").tobytes()) for s in spans]),
                        ],
                        ["place", "chunk", "grams", "counts"],
                    )

    return chunks.select("chunk", "packed", "at").mapInArrow(released(run), _SENT)


def _rows(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple]:
    for batch in batches:
        yield from zip(*(c.to_pylist() for c in batch.columns), strict=True)


class _Table:
    """Sum of what is sent to one range, held at no more than about twice the size of the result."""

    def __init__(self) -> None:
        self.known, self.totals = np.empty(0, np.uint64), np.empty(0, "<u8")
        self.held: list[tuple[np.ndarray, np.ndarray]] = []
        self.waiting = 0

    def add(self, grams: np.ndarray, counts: np.ndarray) -> None:
        self.held.append((grams, counts))
        self.waiting += len(grams)
        if self.waiting > max(1 << 20, len(self.known)):
            self._merge()

    def _merge(self) -> None:
        self.held.append((self.known, self.totals))
        self.known, inverse = np.unique(np.concatenate([g for g, _ in self.held]), return_inverse=True)
        self.totals = np.bincount(inverse, np.concatenate([c for _, c in self.held]), len(self.known)).astype("<u8")
        self.held, self.waiting = [], 0

    def close(self, least: int) -> None:
        self._merge()
        some = self.totals >= least
        self.known, self.totals = self.known[some], self.totals[some]

    def of(self, grams: np.ndarray) -> np.ndarray:
        """Their counts, zero where the table has none."""
        if not len(self.known):
            return np.zeros(len(grams), "<u8")
        at = np.minimum(np.searchsorted(self.known, grams), len(self.known) - 1)
        return np.where(self.known[at] == grams, self.totals[at], 0).astype("<u8")


def _summed(sent: DataFrame, least: int, partitions: int) -> DataFrame:
    """(place, grams, counts): what all chunks sent to a range, summed as it streams by."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, reader = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        for place, rows in groupby(_rows(batches), key=itemgetter(0)):
            table = _Table()
            for _, grams, counts in rows:
                table.add(_unpack(grams), np.frombuffer(reader.decompress(counts), "<u8"))
            table.close(least)
            columns = [pa.array([place], pa.int32()), pa.array([_pack(table.known)]), pa.array([packer.compress(table.totals.tobytes())])]
            yield pa.RecordBatch.from_arrays(columns, ["place", "grams", "counts"])

    dealt = sent.repartition(partitions, "place").sortWithinPartitions("place").select("place", "grams", "counts")
    return dealt.mapInArrow(released(run), "place int, grams binary, counts binary")


_FOUND = "chunk long, place int, counts binary"


def _found(chunk: int, place: int, counts: bytes) -> pa.RecordBatch:
    return pa.RecordBatch.from_arrays([pa.array([chunk], pa.int64()), pa.array([place], pa.int32()), pa.array([counts])], ["chunk", "place", "counts"])


def _joined(sent: DataFrame, table: DataFrame, partitions: int) -> DataFrame:
    """(chunk, place, counts): counts in the table of the n-grams that a chunk sent to a range, in their order; zero where it has none."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, reader = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        for place, rows in groupby(_rows(batches), key=itemgetter(0)):
            known = _Table()
            for _, chunk, grams, counts in rows:
                if chunk is None:
                    known.known, known.totals = _unpack(grams), np.frombuffer(reader.decompress(counts), "<u8")
                else:
                    yield _found(chunk, place, packer.compress(known.of(_unpack(grams)).tobytes()))

    asked = sent.select("place", "chunk", "grams", F.lit(None).cast("binary").alias("counts"))
    both = asked.unionByName(table.withColumn("chunk", F.lit(None).cast("long")))
    # The table's row of a range, whose chunk is null, comes first.
    dealt = both.repartition(partitions, "place").sortWithinPartitions("place", "chunk").select("place", "chunk", "grams", "counts")
    return dealt.mapInArrow(released(run), _FOUND)


def _summed_and_joined(sent: DataFrame, least: int, partitions: int) -> DataFrame:
    """As ``_joined`` with the table that ``_summed`` makes of the same n-grams; they stay packed, and a range has few."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        packer, reader = zstandard.ZstdCompressor(1), zstandard.ZstdDecompressor()
        for place, rows in groupby(_rows(batches), key=itemgetter(0)):
            table, asked = _Table(), []
            for _, chunk, grams, counts in rows:
                table.add(_unpack(grams), np.frombuffer(reader.decompress(counts), "<u8"))
                asked.append((chunk, grams))
            table.close(least)
            for chunk, grams in asked:
                yield _found(chunk, place, packer.compress(table.of(_unpack(grams)).tobytes()))

    dealt = sent.repartition(partitions, "place").sortWithinPartitions("place").select("place", "chunk", "grams", "counts")
    return dealt.mapInArrow(released(run), _FOUND)


def _ranges(spark: SparkSession, chunks: DataFrame) -> tuple[int, int]:
    """Words of all chunks, and how many ranges of hashes they need."""
    words = chunks.agg(F.sum("words").alias("n")).first()["n"] or 0
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    return words, 1 << max(1, (max(RANGES * partitions, words // RANGE_WORDS) - 1).bit_length())


def _least(order: int) -> int:
    return 1 if order == 1 else MIN_COUNT


def count_tables(df: DataFrame, text_col: str, order: int = ORDER) -> Counts:
    """The count tables of a corpus, in the shared folder: a model that can score any texts."""
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    texts = df.select(F.lit(None).cast("int").alias("id"), F.col(text_col).alias("text"))
    with scratch(spark) as keep:
        chunks = spark.read.parquet(write_table(_chunks(texts, "id", "text"), "lm-chunks"))
        words, ranges = _ranges(spark, chunks)
        tables = []
        for k in range(1, order + 1):
            tables.append(write_table(_summed(_sent(chunks, k, ranges), _least(k), partitions), f"lm-counts-{k}"))
            discard(spark)
        keep(*tables)
    return Counts(tuple(tables), words, ranges)


def _scored(words: np.ndarray, of: np.ndarray, tables: list[np.ndarray], total: int) -> np.ndarray:
    """Natural log of the score of each word; tables: totals of a chunk's distinct n-grams of each order."""
    if not len(words):
        return np.empty(0)
    counts = []
    for order, table in enumerate(tables, 1):
        grams, whole = _grams(words, of, order)
        at = np.zeros(len(words))
        _, inverse = np.unique(grams[whole], return_inverse=True)
        at[whole] = table[inverse]
        counts.append(at)
    score = np.log(np.maximum(counts[0], 1)) - math.log(max(total, 1))
    for order in range(2, len(tables) + 1):
        seen = counts[order - 1] >= MIN_COUNT
        history = np.ones(len(words))  # the n-gram before the word is the shorter one that ends a word earlier
        history[1:] = counts[order - 2][:-1]
        ample = np.arange(len(words)) - np.repeat(of[:-1], np.diff(of)) >= order - 1
        longer = np.log(np.maximum(counts[order - 1], 1)) - np.log(np.maximum(history, 1))
        score = np.where(seen, longer, np.where(ample, score + math.log(BACKOFF), score))
    return score


def score(df: DataFrame, id_col: str, text_col: str, counts: Counts | None = None) -> DataFrame:
    """(id, n_words, log_score, total_log_score) of every row: the mean log of its words' scores, and their sum.

    ``counts``: a model of ``count_tables``; without one, that of the rows themselves.
    """
    spark = df.sparkSession
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    with scratch(spark) as keep:
        stored = write_table(_chunks(df, id_col, text_col), "lm-chunks")
        chunks = spark.read.parquet(stored)
        words, ranges = _ranges(spark, chunks) if counts is None else (counts.words, counts.ranges)
        found = []
        for k in range(1, ORDER + 1 if counts is None else len(counts.tables) + 1):
            if counts is None:
                known = _summed_and_joined(_sent(chunks, k, ranges), _least(k), partitions)
            else:
                known = _joined(_sent(chunks, k, ranges), spark.read.parquet(counts.tables[k - 1]), partitions)
            found.append(write_table(known, f"lm-found-{k}"))
            discard(spark)
        keep(stored, *found)
    return _summed_up(df, id_col, stored, found, words)


def _summed_up(df: DataFrame, id_col: str, stored: str, tables: list[str], total: int) -> DataFrame:
    spark = df.sparkSession
    read = spark.read.parquet
    order = len(tables)
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ids = T.ArrayType(df.schema[id_col].dataType)
    none = {"ids": ids, "packed": T.BinaryType(), "at": T.BinaryType(), "place": T.IntegerType(), "counts": T.BinaryType()}
    columns = ["chunk", "k", *none]

    def rows(part: DataFrame, k: int) -> DataFrame:
        part = part.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in part.columns})
        return part.withColumn("k", F.lit(k)).select(columns)

    everything = rows(read(stored), 0)
    for k, path in enumerate(tables, 1):
        everything = everything.unionByName(rows(read(path), k))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        reader = zstandard.ZstdDecompressor()

        def close(held: dict) -> pa.RecordBatch:
            words, of = _words(held["packed"], held["at"])
            counts = [np.frombuffer(b"".join(reader.decompress(c) for c in held["counts"][k]), "<u8") for k in range(1, order + 1)]
            scores = _scored(words, of, counts, total)
            n = np.diff(of)
            sums = np.zeros(len(n))
            some = n > 0
            if some.any():
                sums[some] = np.add.reduceat(scores, of[:-1][some])
            mean = pa.array(np.divide(sums, n, out=np.zeros(len(n)), where=some), mask=~some)
            return pa.RecordBatch.from_arrays([held["ids"], pa.array(n), mean, pa.array(sums)], ["id", "n_words", "log_score", "total_log_score"])

        current, held = None, {}
        for batch in batches:
            lists = batch.column(2)
            for i, (chunk, k, packed, at, _, counts) in enumerate(zip(*(batch.column(c).to_pylist() for c in (0, 1, 3, 4, 5, 6)), strict=True)):
                if chunk != current:
                    if held:
                        yield close(held)
                    current, held = chunk, {"counts": {o: [] for o in range(1, order + 1)}}
                if k == 0:
                    held |= {"ids": lists[i].values, "packed": packed, "at": at}
                else:
                    held["counts"][k].append(counts)
        if held:
            yield close(held)

    dealt = everything.repartition(partitions, "chunk").sortWithinPartitions("chunk", "k", "place")
    kinds = (("n_words", T.LongType()), ("log_score", T.DoubleType()), ("total_log_score", T.DoubleType()))
    schema = T.StructType([T.StructField("id", ids.elementType), *(T.StructField(n, t) for n, t in kinds)])
    return dealt.mapInArrow(released(run), schema).select(F.col("id").alias(id_col), *(n for n, _ in kinds))
