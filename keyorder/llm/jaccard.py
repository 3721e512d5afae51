"""Exact N-gram Jaccard self-join with set-relation skipping, and its components.

Two texts link when the Jaccard similarity of their sets of word shingles is at
least 0.8.  Equal sets are one class from the start.  Classes meet in index
lists, one for each shingle of a set's prefix (its rarest fifth, by counts of
shingle buckets over the whole corpus), sorted by set size:

* Blocks of a list are skipped when their sizes and positions leave too little
  for any pair of their sets to overlap in.  Two linked sets share not one but a
  known number of prefix shingles, so pairs that meet in fewer lists are dropped.
* Answers are derived from those of similar sets.  In each list, sets of like
  size are compared with a few leaders.  A set refers to the leader that most
  sets are similar to, linked or not, and is held as what it has and lacks
  against it.  Sets of one leader, component and size are then one entry of a
  list, with the span of their positions, put together before lists are dealt;
  lists name pairs of leaders only, whose exact overlap bounds
  that of any two sets that refer to them.  Where the bound leaves pairs open,
  and among sets of one leader that aren't connected yet, overlaps are derived
  from the differences, whole blocks of sets at a time.  One link is enough
  where two components meet.

So near copies that link with their leader cost one comparison each, not one for
each other copy; only those that don't are held against all of their group, and
no pair is ever a row of its own.  No link between different components is lost.  Sets are
of 64-bit hashes, which could only err if two shingles of one pair of texts
collided (about n^2 / 2^65).

Every row is a document.  Rows with equal sets are of one class, whatever their
ids; an id that several rows share doesn't link them, so rows of one id with
different texts have the classes and components of their own texts.  The least
id of rows without any is null.  Null and empty texts, and those without a word,
have empty sets and link with nothing.  Texts of any length are taken whole, an
empty table gives no rows, ids are integers (others are cast to them), and only
the named columns are read, whatever others are called.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyorder.llm.common import discard, fewer, released, scratch, slices, text_buffer, write_bucketed, write_table
from keyorder.llm.components import components
from keyorder.llm.shingles import mix, overlap, shingle_sets

CHUNK_BYTES = 1 << 20
#: Buckets, by the first bits of a shingle's hash, whose counts order shingles.
BUCKET_BITS = 16
#: Entries of an index list that are skipped or looked at together.
BLOCK = 64
#: Leaders that the sets of a list are compared with, in each of two rounds.
LEADERS = 4
#: Sets that a leader must meet for others of the group to be held against it in any case.
GROUP = 16
#: Sets of a star, and questions about it, that meet in one block.
BLOCK_SETS = 256
#: Sets of like size in a list: within this factor.
SIZE_STEP = 1.25


def needed(n: int) -> int:
    """Least overlap of a set of n with any partner: 80 % of it."""
    return -(-4 * n // 5)


def least_meetings(na, nb):
    """Index lists in which two linked sets meet at least.

    Whichever prefix ends first in the order of shingles, all common shingles up
    to there are in both prefixes, and fewer than 80 % of its set come after.
    """
    return np.maximum(1, -(-4 * (na + nb) // 9) - (-(-4 * np.maximum(na, nb) // 5)) + 1)


def linked(o, total):
    """100 o >= 80 (total - o), total being the sum of both sizes."""
    return 9 * o >= 4 * total


def _buckets(s: np.ndarray) -> np.ndarray:
    return (s >> np.uint64(64 - BUCKET_BITS)).astype(np.int64)


def _profile(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """Rows of two kinds: (0, id, n, class, packed text at a class's first row in a task) and (1, bucket, count)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts = np.zeros(1 << BUCKET_BITS, np.int64)
        packer, seen = zstandard.ZstdCompressor(3), set()
        names = ["kind", "id", "n", "fp", "packed"]
        for batch in batches:
            for begin, end in slices(batch.column(1), CHUNK_BYTES):
                part = batch.slice(begin, end - begin)
                data, at = text_buffer(part.column(1))
                sizes, prints, packed = [], [], []
                cuts = at.tolist()
                for i, s in enumerate(shingle_sets(data, at)):
                    sizes.append(len(s))
                    fp = xxhash.xxh3_64_intdigest(s.tobytes()) - (1 << 63) if len(s) else None
                    prints.append(fp)
                    packed.append(packer.compress(data[cuts[i] : cuts[i + 1]]) if len(s) and fp not in seen else None)
                    seen.add(fp)
                    counts += np.bincount(_buckets(s), minlength=len(counts)) if len(s) > len(counts) else 0
                    if len(s) <= len(counts):
                        np.add.at(counts, _buckets(s), 1)
                yield pa.RecordBatch.from_arrays(
                    [
                        pa.array(np.zeros(end - begin, np.int32)), part.column(0), pa.array(sizes, pa.int64()),
                        pa.array(prints, pa.int64()), pa.array(packed, pa.binary()),
                    ],
                    names,
                )
        used = np.flatnonzero(counts)
        yield pa.RecordBatch.from_arrays(
            [
                pa.array(np.ones(len(used), np.int32)), pa.array(used), pa.array(counts[used]),
                pa.nulls(len(used), pa.int64()), pa.nulls(len(used), pa.binary()),
            ],
            names,
        )

    source = df.select(F.col(id_col).cast("long").alias("id"), F.col(text_col).cast("string").alias("text"))
    return source.mapInArrow(released(run), "kind int, id long, n long, fp long, packed binary")


def unpack(packed: pa.Array) -> tuple[bytes, np.ndarray]:
    reader = zstandard.ZstdDecompressor()
    texts = [reader.decompress(p) for p in packed.to_pylist()]
    return b"".join(texts), np.concatenate([[0], np.cumsum([len(t) for t in texts])]).astype(np.int64)


def _entries(packed: DataFrame, counts: np.ndarray) -> DataFrame:
    """(token, fp, n, pos): the prefix of each class, rarest bucket first."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin, end in slices(batch.column(1), CHUNK_BYTES // 4):
                part = batch.slice(begin, end - begin)
                tokens, prints, sizes, places = [], [], [], []
                for fp, s in zip(part.column(0).to_pylist(), shingle_sets(*unpack(part.column(1))), strict=True):
                    n = len(s)
                    take = n - needed(n) + 1
                    tokens.append(s[np.argsort(counts[_buckets(s)], kind="stable")[:take]])
                    prints.append(np.full(take, fp, np.int64))
                    sizes.append(np.full(take, n, np.int32))
                    places.append(np.arange(take, dtype=np.int32))
                if tokens:
                    columns = [np.concatenate(tokens).view(np.int64), *(np.concatenate(c) for c in (prints, sizes, places))]
                    yield pa.RecordBatch.from_arrays([pa.array(c) for c in columns], ["token", "fp", "n", "pos"])

    return packed.select("fp", "packed").mapInArrow(released(run), "token long, fp long, n int, pos int")


def _lists(batches: Iterator[pa.RecordBatch], columns: int) -> Iterator[list[np.ndarray]]:
    """Sorted batches as arrays that never break an index list (equal first column)."""
    held: list[list[np.ndarray]] = []
    for batch in batches:
        if not len(batch):
            continue
        now = [batch.column(c).to_numpy(zero_copy_only=False) for c in range(columns)]
        change = np.flatnonzero(np.diff(now[0]) != 0)
        if held and held[0][0][0] != now[0][0]:
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = []
        if len(change):
            cut = change[-1] + 1
            held.append([c[:cut] for c in now])
            yield [np.concatenate(c) for c in zip(*held, strict=True)]
            held = [[c[cut:].copy() for c in now]]
        else:
            held.append([c.copy() for c in now])
    if held:
        yield [np.concatenate(c) for c in zip(*held, strict=True)]


def _fit(na, nb, pa_, pb, to_a=None, to_b=None) -> np.ndarray:
    """Whether sets of these sizes, sharing a shingle at these positions, may link: by what can match before, at and after it.

    With ``to_a`` and ``to_b`` the positions are spans, and some pair of places in them is asked for.
    """
    to_a, to_b = pa_ if to_a is None else to_a, pb if to_b is None else to_b
    most = np.minimum(np.minimum(na, nb), np.minimum(nb + to_a - pb, na + to_b - pa_))
    return (5 * na >= 4 * nb) & (5 * nb >= 4 * na) & linked(most, na + nb)


def _block_pairs(n: np.ndarray, pos: np.ndarray, to: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """Pairs (i < j) of one list, sorted by n, with spans of positions, that may link; blocks that can't are skipped."""
    count = len(n)
    for a in range(0, count, BLOCK):
        ai = slice(a, min(a + BLOCK, count))
        rest_a, most_a = int((n[ai] - pos[ai]).max()), int(to[ai].max())
        for b in range(a, count, BLOCK):
            bi = slice(b, min(b + BLOCK, count))
            if 5 * int(n[ai][-1]) < 4 * int(n[b]):
                break  # all further sets are too large
            rest = min(rest_a, int((n[bi] - pos[bi]).max()))
            if not linked(min(most_a, int(to[bi].max())) + rest, int(n[a]) + int(n[b])):
                continue
            i, j = np.nonzero(_fit(n[ai, None], n[None, bi], pos[ai, None], pos[None, bi], to[ai, None], to[None, bi]))
            i, j = i + a, j + b
            ahead = i < j
            yield i[ahead], j[ahead]


def _bounds(first: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    starts = np.flatnonzero(np.concatenate([[True], np.diff(first) != 0]))
    return starts, np.diff(np.concatenate([starts, [len(first)]]))


_STAR = "kind int, token long, fp long, n int, pos int, other long, other_n int, meetings long"


def _led(token, n, fp, pos, component, seeds: range) -> tuple[np.ndarray, np.ndarray]:
    """(set, n, leader, n) of different components that may link, and in how many of these lists they meet.

    Of the sets of like size in a list, each seed makes the one of the least hash a leader.
    """
    size = np.floor(np.log(n) / np.log(SIZE_STEP)).astype(np.int64)
    heads = np.flatnonzero(np.concatenate([[True], (np.diff(token) != 0) | (np.diff(size) != 0)]))
    lengths = np.diff(np.concatenate([heads, [len(token)]]))
    where = np.repeat(lengths, lengths)
    pairs = []
    for k, seed in enumerate(seeds):
        hashed = mix(fp.view(np.uint64) ^ np.uint64(seed * 0x9E3779B97F4A7C15 & (1 << 64) - 1))
        least = np.repeat(np.minimum.reduceat(hashed, heads), lengths)
        at = np.repeat(np.flatnonzero(hashed == least), lengths)
        ok = (where > k + 1) & (component != component[at]) & _fit(n, n[at], pos, pos[at])
        x, y = np.flatnonzero(ok), at[ok]
        swap = fp[x] > fp[y]
        x, y = np.where(swap, y, x), np.where(swap, x, y)
        pairs.append(np.stack([token[x], fp[x], n[x].astype(np.int64), fp[y], n[y].astype(np.int64)], 1))
    once = np.unique(np.concatenate(pairs), axis=0)[:, 1:]  # a list counts once for a pair
    return np.unique(once, axis=0, return_counts=True)


def _pair_batch(pairs: np.ndarray, met: np.ndarray) -> pa.RecordBatch:
    size = len(pairs)
    columns = [
        pa.array(np.ones(size, np.int32)), pa.nulls(size, pa.int64()), pa.array(pairs[:, 0]), pa.array(pairs[:, 1].astype(np.int32)),
        pa.nulls(size, pa.int32()), pa.array(pairs[:, 2]), pa.array(pairs[:, 3].astype(np.int32)), pa.array(met.astype(np.int64)),
    ]
    return pa.RecordBatch.from_arrays(columns, [c.split()[0] for c in _STAR.split(", ")])


def _star_pairs(entries: DataFrame, partitions: int) -> DataFrame:
    """Of lists with a pair that may link: (0, entry) of the sets in such pairs, and (1, set, leader, lists in which they meet)."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, fp, pos in _lists(batches, 4):
            fresh = np.ones(len(token), bool)  # a class met in several tasks of the texts
            fresh[1:] = (np.diff(token) != 0) | (np.diff(fp) != 0)
            starts, lengths = _bounds(token[fresh])
            several = np.repeat(lengths > 1, lengths)
            token, n, fp, pos = (c[fresh][several] for c in (token, n, fp, pos))
            if not len(token):
                continue
            starts, lengths = _bounds(token)
            mated = np.zeros(len(token), bool)
            two = starts[lengths == 2]
            fits = _fit(n[two], n[two + 1], pos[two], pos[two + 1])
            mated[two[fits]] = mated[two[fits] + 1] = True
            for a, length in zip(starts[lengths > 2].tolist(), lengths[lengths > 2].tolist(), strict=True):
                _mate(n[a : a + length], pos[a : a + length], mated[a : a + length])
            if not mated.any():
                continue
            token, n, fp, pos = (c[mated] for c in (token, n, fp, pos))
            count = len(token)
            empty = [pa.nulls(count, pa.int64()), pa.nulls(count, pa.int32()), pa.nulls(count, pa.int64())]
            yield pa.RecordBatch.from_arrays(
                [pa.array(np.zeros(count, np.int32)), *(pa.array(c) for c in (token, fp, n, pos)), *empty], [c.split()[0] for c in _STAR.split(", ")]
            )
            pairs, met = _led(token, n, fp, pos, fp, range(LEADERS))
            if len(pairs):
                yield _pair_batch(pairs, met)

    dealt = entries.select("token", "n", "fp", "pos").repartition(partitions, "token").sortWithinPartitions("token", "n", "fp", "pos")
    return dealt.mapInArrow(released(run), _STAR)


def _mate(n: np.ndarray, pos: np.ndarray, mated: np.ndarray) -> None:
    """Mark the sets of one list that may link with another; a set needs one mate only."""
    for shift in range(1, min(len(n), BLOCK)):
        fits = _fit(n[:-shift], n[shift:], pos[:-shift], pos[shift:])
        mated[:-shift] |= fits
        mated[shift:] |= fits
        if mated.all():
            return
    if len(n) > BLOCK:
        for i, j in _block_pairs(n, pos, pos):
            mated[i] = mated[j] = True


def _more_star_pairs(labelled: DataFrame, partitions: int) -> DataFrame:
    """As ``_star_pairs``, with other leaders, across the components found so far."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, fp, pos, component in _lists(batches, 5):
            starts, lengths = _bounds(token)
            mixed = np.repeat(np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts), lengths)
            if mixed.any():
                pairs, met = _led(*(c[mixed] for c in (token, n, fp, pos, component)), range(LEADERS, 2 * LEADERS))
                if len(pairs):
                    yield _pair_batch(pairs, met)

    dealt = labelled.select("token", "n", "fp", "pos", "component").repartition(partitions, "token").sortWithinPartitions("token", "n", "fp", "pos")
    return dealt.mapInArrow(released(run), _STAR)


def _cross_pairs(entries: DataFrame, partitions: int) -> DataFrame:
    """(a, b): different leaders of sets of different components that meet often enough to link.

    Lists count once for two stars, and the least number of meetings that any of
    their pairs needs is what counts: no pair that links is lost.
    """

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for token, n, pos, to, leader, component in _lists(batches, 6):
            starts, lengths = _bounds(token)
            mixed = np.minimum.reduceat(component, starts) != np.maximum.reduceat(component, starts)
            found = []
            for a, length in zip(starts[mixed].tolist(), lengths[mixed].tolist(), strict=True):
                m, c, s = n[a : a + length], component[a : a + length], leader[a : a + length]
                here = []
                for i, j in _block_pairs(m, pos[a : a + length], to[a : a + length]):
                    apart = (c[i] != c[j]) & (s[i] != s[j])
                    if apart.any():
                        i, j = i[apart], j[apart]
                        here.append(np.stack([np.minimum(s[i], s[j]), np.maximum(s[i], s[j]), least_meetings(m[i], m[j])], 1))
                if here:
                    found.append(_least(np.concatenate(here))[0])
            if found:
                pairs, met = _least(np.concatenate(found))
                yield pa.RecordBatch.from_arrays([*(pa.array(pairs[:, k]) for k in range(3)), pa.array(met)], ["a", "b", "need", "meetings"])

    # Near copies that have one leader are one entry from here on: summed up in the tasks that hold them, so that no list is hot for their sake.
    spans = entries.groupBy("token", "n", "leader", "component").agg(F.min("pos").alias("pos"), F.max("pos").alias("to"))
    dealt = spans.select("token", "n", "pos", "to", "leader", "component").repartition(partitions, "token").sortWithinPartitions("token", "n", "leader", "pos")
    met = dealt.mapInArrow(released(run), "a long, b long, need long, meetings long")
    return met.groupBy("a", "b").agg(F.sum("meetings").alias("m"), F.min("need").alias("need")).filter("m >= need").select("a", "b")


def _least(rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Rows (a, b, need), one for each (a, b) with its least need; and how many there were of each."""
    rows = rows[np.lexsort((rows[:, 2], rows[:, 1], rows[:, 0]))].astype(np.int64)
    starts = np.flatnonzero(np.concatenate([[True], (np.diff(rows[:, 0]) != 0) | (np.diff(rows[:, 1]) != 0)]))
    return rows[starts], np.diff(np.concatenate([starts, [len(rows)]]))


def _overlaps(pairs: DataFrame, texts: DataFrame) -> DataFrame:
    """pairs (a, b) of classes with na, nb and o, the exact size of the intersection."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                a, b = part.column(0), part.column(1)
                sets: dict[int, np.ndarray] = {}
                for ids, packed in ((a.to_pylist(), part.column(2)), (b.to_pylist(), part.column(3))):
                    first = {fp: i for i, fp in enumerate(ids) if fp not in sets}
                    if first:
                        sets.update(zip(first, shingle_sets(*unpack(packed.take(pa.array(list(first.values()))))), strict=True))
                both = [(sets[x], sets[y]) for x, y in zip(a.to_pylist(), b.to_pylist(), strict=True)]
                sizes = [pa.array([len(p[k]) for p in both], pa.int64()) for k in (0, 1)]
                yield pa.RecordBatch.from_arrays([a, b, *sizes, pa.array([overlap(*p) for p in both], pa.int64())], ["a", "b", "na", "nb", "o"])

    of = lambda c: texts.select(F.col("fp").alias(c), F.col("packed").alias(f"p{c}"))
    with_texts = pairs.join(of("a"), "a").join(of("b"), "b").select("a", "b", "pa", "pb")
    return with_texts.mapInArrow(released(run), "a long, b long, na long, nb long, o long")


LINKED = "9 * o >= 4 * (na + nb)"
#: Similarity of at least one half.
SIMILAR = "3 * o >= na + nb"


def _apart(counts: DataFrame, name: str) -> DataFrame:
    """``counts`` written, so that a join with it has nothing but shuffles below and Spark can split the rows of a popular leader."""
    spark = counts.sparkSession
    return spark.read.parquet(write_table(counts, name, fewer(spark)))


def _met_often(pairs: DataFrame) -> DataFrame:
    """(a, b) that meet in enough lists where one leads, and each set of a group with the popular leader it meets most.

    Pairs that meet elsewhere as well are left to what follows.
    """
    met = pairs.groupBy(F.col("fp").alias("a"), F.col("other").alias("b")).agg(
        F.sum("meetings").alias("m"), F.first(F.col("n") + F.col("other_n")).alias("total"), F.first(F.greatest("n", "other_n")).alias("most")
    )
    met = met.sparkSession.read.parquet(write_table(met, "join-met"))
    need = F.ceil(4 * F.col("total") / 9) - F.ceil(4 * F.col("most") / 5) + 1  # least_meetings
    sure = met.filter(F.col("m") >= need).select("a", "b")
    way = lambda x, y: met.select(F.col(x).alias("fp"), F.col(y).alias("leader"), "m")
    both = way("a", "b").unionByName(way("b", "a"))
    popular = both.groupBy("leader").agg(F.count("*").alias("met")).filter(F.col("met") >= GROUP)
    popular = _apart(popular, "join-popular")
    best = both.join(popular, "leader").groupBy("fp").agg(F.max(F.struct("m", "met", "leader")).alias("best"))
    close = best.select(F.least("fp", "best.leader").alias("a"), F.greatest("fp", "best.leader").alias("b"))
    return sure.unionByName(close).distinct()


def _labels(overlaps: DataFrame, classes: DataFrame) -> DataFrame:
    """(fp, component, leader, n, extra) of all classes.

    A set refers to the similar set that most sets are similar to, if it is more
    than the set itself; extra is the number of the set's shingles that it lacks.
    """
    near = overlaps.filter(SIMILAR)
    way = lambda x, y: near.select(F.col(x).alias("fp"), F.col(y).alias("leader"), F.col(f"n{x}").alias("n"), (F.col(f"n{x}") - F.col("o")).alias("extra"))
    both = way("a", "b").unionByName(way("b", "a"))
    degree = _apart(both.groupBy("fp").agg(F.count("*").alias("degree")), "join-degree")
    to = degree.select(F.col("fp").alias("leader"), F.struct("degree", F.col("fp").alias("id")).alias("rank"))
    ranked = both.join(to, "leader").groupBy("fp").agg(F.max(F.struct("rank", "leader", "n", "extra")).alias("best"))
    own = degree.select("fp", F.struct("degree", F.col("fp").alias("id")).alias("own"))
    chosen = ranked.join(own, "fp").filter(F.col("best.rank") > F.col("own")).select("fp", "best.leader", "best.n", "best.extra")
    links = overlaps.filter(LINKED)
    found = components(links.select(F.col("a").alias("u"), F.col("b").alias("v"))).withColumnRenamed("node", "fp")
    return (
        classes.join(found, "fp", "left")
        .join(chosen, "fp", "left")
        .select("fp", F.coalesce("component", "fp").alias("component"), F.coalesce("leader", "fp").alias("leader"), "n", "extra")
    )


def _questions(labels: DataFrame, asked: DataFrame) -> DataFrame:
    """(fp, target): whether any set that refers to target, or target itself, links with fp; open after all bounds.

    Within a star: every set that isn't of its leader's component.  Between two
    stars: the sets of the one with fewer.
    """
    members = labels.filter("fp != leader").select("fp", "leader", "component", "n", "extra")
    # 9 |y \\ leader| - 4 |y| at its largest in each star: what a set may add to 9 o - 4 |x|.
    stars = members.groupBy("leader").agg(F.max(9 * F.col("extra") - 4 * F.col("n")).alias("gain"), F.count("*").alias("size"))
    heads = labels.select(F.col("fp").alias("leader"), F.col("component").alias("of"))
    inside = (
        members.join(stars, "leader").join(heads, "leader")
        .filter((F.col("component") != F.col("of")) & (9 * (F.col("n") - F.col("extra")) - 4 * F.col("n") + F.col("gain") >= 0))
        .select("fp", F.col("leader").alias("target"))
    )
    star = lambda c: stars.select(F.col("leader").alias(c), F.col("gain").alias(f"g{c}"), F.col("size").alias(f"s{c}"))
    may = lambda c: F.greatest(F.coalesce(f"g{c}", -4 * F.col(f"n{c}")), -4 * F.col(f"n{c}"))
    both = asked.join(star("a"), "a", "left").join(star("b"), "b", "left")
    opened = both.filter((F.coalesce("sa", "sb").isNotNull()) & (9 * F.col("o") + may("a") + may("b") >= 0))
    swap = F.coalesce("sa", F.lit(0)) > F.coalesce("sb", F.lit(0))
    pick = lambda x, y: F.when(swap, x).otherwise(y)
    sides = opened.select(
        pick(F.col("b"), F.col("a")).alias("from"), pick(F.col("nb"), F.col("na")).alias("n"),
        pick(F.col("a"), F.col("b")).alias("target"), pick(may("a"), may("b")).alias("gain"), "o",
    )
    everyone = members.select(F.col("leader").alias("from"), "fp", F.col("n").alias("m"), "extra")
    theirs = sides.join(everyone, "from").filter(9 * (F.col("o") + F.col("extra")) - 4 * F.col("m") + F.col("gain") >= 0)
    own = sides.filter(9 * F.col("o") - 4 * F.col("n") + F.col("gain") >= 0).select(F.col("from").alias("fp"), "target")
    return inside.unionByName(theirs.select("fp", "target")).unionByName(own)


_BLOCKS = "star long, part int, ask int, kind int, fp long, n long, component long, plus binary, minus binary, packed binary"


def _differences(members: DataFrame, texts: DataFrame) -> DataFrame:
    """(star, fp, n, component, plus, minus): what each set has and lacks against its leader."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for begin in range(0, len(batch), 256):
                part = batch.slice(begin, 256)
                leaders = part.column(0).to_pylist()
                first = {fp: i for i, fp in reversed(list(enumerate(leaders)))}
                heads = dict(zip(first, shingle_sets(*unpack(part.column(3).take(pa.array(list(first.values()))))), strict=True))
                plus, minus, sizes = [], [], []
                for leader, s in zip(leaders, shingle_sets(*unpack(part.column(4))), strict=True):
                    plus.append(np.setdiff1d(s, heads[leader], assume_unique=True).tobytes())
                    minus.append(np.setdiff1d(heads[leader], s, assume_unique=True).tobytes())
                    sizes.append(len(s))
                yield pa.RecordBatch.from_arrays(
                    [part.column(0), part.column(1), pa.array(sizes, pa.int64()), part.column(2), pa.array(plus, pa.binary()), pa.array(minus, pa.binary())],
                    ["star", "fp", "n", "component", "plus", "minus"],
                )

    rows = members.join(texts.select(F.col("fp").alias("leader"), F.col("packed").alias("head")), "leader").join(texts, "fp")
    rows = rows.select("leader", "fp", "component", "head", "packed")
    return rows.mapInArrow(released(run), "star long, fp long, n long, component long, plus binary, minus binary")


def _derived(labels: DataFrame, questions: DataFrame, texts: DataFrame, partitions: int) -> DataFrame:
    """(a, b): links that answer the questions, one for each component that a set links with in a block.

    Blocks of a star's sets meet blocks of its questions.  A question's overlap
    with the leader is computed; with the others it follows from the differences.
    """
    spark = labels.sparkSession
    asked = spark.read.parquet(write_table(questions, "join-questions"))
    sizes = asked.groupBy(F.col("target").alias("star")).agg((F.floor(F.count("*") / BLOCK_SETS) + 1).cast("int").alias("asks"))
    used = labels.filter("fp != leader").select("leader", "fp", "component").join(sizes.select(F.col("star").alias("leader")), "leader")
    counted = used.groupBy(F.col("leader").alias("star")).agg((F.floor(F.count("*") / BLOCK_SETS) + 1).cast("int").alias("parts"))
    shape = sizes.join(counted, "star", "left").select("star", "asks", F.coalesce("parts", F.lit(1)).alias("parts"))
    shape = spark.read.parquet(write_table(shape, "join-shape", fewer(spark)))
    place = lambda c, n: F.pmod(F.xxhash64(c, F.lit("block")), F.col(n)).cast("int")
    each = lambda n: F.explode(F.sequence(F.lit(0), F.col(n) - 1))
    none = {"n": "long", "component": "long", "plus": "binary", "minus": "binary", "packed": "binary"}

    def rows(df: DataFrame, kind: int) -> DataFrame:
        df = df.withColumns({c: F.lit(None).cast(t) for c, t in none.items() if c not in df.columns}).withColumn("kind", F.lit(kind))
        return df.select(*(c.split()[0] for c in _BLOCKS.split(", ")))

    of = labels.select("fp", "component")
    heads = shape.join(texts.withColumnRenamed("fp", "star"), "star").join(of.withColumnRenamed("fp", "star"), "star")
    heads = heads.withColumn("part", each("parts")).withColumn("ask", each("asks")).withColumn("fp", F.col("star"))
    sets = _differences(used, texts).join(shape, "star").withColumn("part", place("fp", "parts")).withColumn("ask", each("asks"))
    asks = asked.withColumnRenamed("target", "star").join(shape, "star").join(texts, "fp").join(of, "fp")
    asks = asks.withColumn("ask", place("fp", "asks")).withColumn("part", each("parts"))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        current, head, block = None, None, None
        for batch in batches:
            found = []
            for star, part, ask, kind, fp, n, component, plus, minus, packed in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                if (star, part, ask) != current:
                    current, head, block = (star, part, ask), None, _Block()
                if kind == 1:
                    block.add(fp, n, component, plus, minus)
                    continue
                data = zstandard.ZstdDecompressor().decompress(packed)
                s = next(shingle_sets(data, np.array([0, len(data)])))
                if kind == 0:
                    head = s
                    block.lead(fp, len(s), component)
                else:
                    found += [(fp, other) for other in block.links(s, overlap(s, head), component) if other != fp]
            if found:
                yield pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in zip(*found, strict=True)], ["a", "b"])

    dealt = rows(heads, 0).unionByName(rows(sets, 1)).unionByName(rows(asks, 2))
    dealt = dealt.repartition(partitions, "star", "part", "ask").sortWithinPartitions("star", "part", "ask", "kind")
    return dealt.mapInArrow(released(run), "a long, b long")


class _Block:
    """Sets of one star by their differences from its leader."""

    def __init__(self) -> None:
        self.fp: list[int] = []
        self.n: list[int] = []
        self.component: list[int] = []
        self.plus: list[np.ndarray] = []
        self.minus: list[np.ndarray] = []
        self.ready = None

    def lead(self, fp: int, n: int, component: int) -> None:
        self.add(fp, n, component, b"", b"")

    def add(self, fp: int, n: int, component: int, plus: bytes, minus: bytes) -> None:
        self.fp.append(fp)
        self.n.append(n)
        self.component.append(component)
        self.plus.append(np.frombuffer(plus, np.uint64))
        self.minus.append(np.frombuffer(minus, np.uint64))
        self.ready = None

    def links(self, s: np.ndarray, shared: int, component: int) -> list[int]:
        """Sets that link with s, one of each other component."""
        if self.ready is None:
            rows = np.arange(len(self.fp))
            self.ready = (
                np.concatenate(self.plus), np.repeat(rows, [len(x) for x in self.plus]),
                np.concatenate(self.minus), np.repeat(rows, [len(x) for x in self.minus]),
                np.array(self.n), np.array(self.component),
            )
        plus, plus_of, minus, minus_of, n, components_ = self.ready
        has = lambda v: s[np.minimum(np.searchsorted(s, v), len(s) - 1)] == v
        o = shared + np.bincount(plus_of[has(plus)], minlength=len(n)) - np.bincount(minus_of[has(minus)], minlength=len(n))
        at = np.flatnonzero(linked(o, n + len(s)) & (components_ != component))
        _, first = np.unique(components_[at], return_index=True)
        return [self.fp[i] for i in at[first].tolist()]


def join(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, n_shingles, class_id, component_id) of every row.

    class_id: smallest id with the same set; component_id: smallest id reachable by links.
    """
    spark = df.sparkSession
    with scratch(spark) as keep:
        answer, rows = _answered(df, id_col, text_col)
        keep(answer, rows)
    docs = spark.read.parquet(rows)
    answer = spark.read.parquet(answer)
    full = docs.filter("fp IS NOT NULL").join(answer, "fp").select("id", "n", "class_id", "component_id")
    empty = docs.filter("fp IS NULL").select("id", "n", F.col("id").alias("class_id"), F.col("id").alias("component_id"))
    return full.unionByName(empty).select(F.col("id").alias(id_col), F.col("n").alias("n_shingles"), "class_id", "component_id")


def _answered(df: DataFrame, id_col: str, text_col: str) -> tuple[str, str]:
    """Tables (fp, class_id, component_id) of the classes and (id, n, fp) of the rows; all others may go."""
    spark = df.sparkSession
    read = spark.read.parquet
    partitions = int(spark.conf.get("spark.sql.shuffle.partitions"))
    few = fewer(spark)
    profile = write_table(_profile(df, id_col, text_col), "join-profile", texts=True)
    docs = read(profile).filter("kind = 0")
    # 2 ** BUCKET_BITS rows at most.
    counts = np.zeros(1 << BUCKET_BITS, np.int64)
    for r in read(profile).filter("kind = 1").groupBy("id").agg(F.sum("n").alias("c")).collect():
        counts[r["id"]] = r["c"]
    star = write_table(_star_pairs(_entries(docs.filter("packed IS NOT NULL"), counts), partitions), "join-star")
    discard(spark)
    entries = read(star).filter("kind = 0").select("token", "fp", "n", "pos")
    wanted = entries.select("fp").distinct()
    named = write_bucketed(
        docs.filter("packed IS NOT NULL").select("fp", "packed").join(wanted, "fp").groupBy("fp").agg(F.first("packed").alias("packed")),
        "texts", "fp", partitions,
    )
    texts = spark.table(named.table)
    discard(spark)
    first = write_table(_overlaps(_met_often(read(star).filter("kind = 1")), texts), "join-first", few, texts=True)
    near = write_table(_labels(read(first), wanted), "join-near", few)
    again = _more_star_pairs(entries.join(read(near).select("fp", "component"), "fp"), partitions)
    second = write_table(_overlaps(_met_often(again), texts), "join-second", few, texts=True)
    both = read(first).unionByName(read(second)).distinct()
    labels = write_table(_labels(both, wanted), "join-labels", few)
    labelled = entries.join(read(labels).select("fp", "leader", "component"), "fp").select("token", "n", "pos", "leader", "component")
    cross = write_table(_cross_pairs(labelled, partitions).filter("a != b"), "join-cross", few)
    asked = write_table(_overlaps(read(cross), texts), "join-asked", few, texts=True)
    derived = write_table(_derived(read(labels), _questions(read(labels), read(asked)), texts, partitions), "join-derived", few, texts=True)
    links = both.unionByName(read(asked)).filter(LINKED).select("a", "b").unionByName(read(derived))
    final = components(links.select(F.col("a").alias("u"), F.col("b").alias("v")))

    known = docs.filter("fp IS NOT NULL")
    classes = known.groupBy("fp").agg(F.min("id").alias("class_id"))
    joined = classes.join(final.withColumnRenamed("node", "fp"), "fp", "left").select("fp", "class_id", F.coalesce("component", "fp").alias("component"))
    joined = write_table(joined, "join-classes", few)
    least = read(joined).groupBy("component").agg(F.min("class_id").alias("component_id"))
    answer = write_table(read(joined).join(least, "component").select("fp", "class_id", "component_id"), "join-answer", few)
    discard(spark, named, star, first, near, second, labels, cross, asked, derived, joined)
    rows = write_table(docs.select("id", "n", "fp"), "join-rows")
    return answer, rows
