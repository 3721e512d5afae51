"""Sharding by sampled splitters, with DataFrame operations only.

Rows are ordered by a key (here the hash of the text, so equal texts lie side
by side).  A sample of keys, drawn in proportion to row size, gives quantile
boundaries; the rows fall into the ranges between them.  The ranges are then
measured exactly, an overfull one (a key that holds many rows, such as a large
group of copies) is subdivided by a hash of the row id, and every shard takes
consecutive ranges holding its share of the bytes.  Slots are numbered from the
exact row counts of the ranges, so no task ever sees a whole shard.

Law: ``bytes``.  Null texts count as no bytes; every row has one byte more than
its text.  Rows that repeat an id are rows of their own.
"""

from __future__ import annotations

from itertools import pairwise

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from keyorder.llm.common import materialize

#: Ranges for each shard; a range is a shard's unit of balance.
RANGES_PER_SHARD = 128
#: Keys sampled for each range.
SAMPLES_PER_RANGE = 16
#: A range is subdivided beyond this many times its share of bytes or rows.
OVERFULL = 2.0
#: Rows of one window task, whatever the number of shards.
RANGE_ROWS = 1_000_000


def describe(df: DataFrame, id_col: str, text_col: str) -> DataFrame:
    """(id, size, text_crc32, key): all that sharding needs of a row."""
    text = F.coalesce(F.col(text_col).cast("string"), F.lit(""))
    return df.select(
        F.col(id_col),
        (F.octet_length(text) + 1).cast("long").alias("size"),
        F.crc32(text).alias("text_crc32"),
        # 52 bits: percentile_approx works on doubles and must return keys exactly.
        F.shiftright(F.xxhash64(text), 12).alias("key"),
    )


def splitters(rows: DataFrame, id_col: str, total_bytes: int, ranges: int) -> list[int]:
    """At most 2 x ranges ascending keys that cut a size-weighted sample into equal parts.

    A row is drawn with probability size x rate (one that exceeds 1 is drawn
    that many times), decided by a hash of the row: a recomputed task draws the same.
    """
    chance = F.col("size") * F.lit(SAMPLES_PER_RANGE * ranges / max(1, total_bytes))
    draw = F.pmod(F.xxhash64(F.lit("draw"), id_col, "key", "size"), F.lit(1 << 30)) / F.lit(float(1 << 30))
    times = F.greatest(F.lit(1), F.round(chance)).cast("int")
    sample = rows.filter(draw < chance).select(F.explode(F.array_repeat("key", times)).alias("key"))
    at = ", ".join(f"{i / ranges!r}D" for i in range(1, ranges))
    found = sample.agg(F.expr(f"percentile_approx(key, array({at}), {SAMPLES_PER_RANGE * ranges})").alias("cuts"))
    keys = found.first()["cuts"] or []
    # A key that fills several parts gets a range of its own.
    alone = {a - 1 for a, b in pairwise(keys) if a == b}
    return sorted({*keys, *alone})


def range_of(key: Column, cuts: list[int]) -> Column:
    """Index of the key's range (a key equal to a cut lies left of it), by binary search."""
    if not cuts:
        return F.lit(0)
    table = F.split(F.lit(",".join(map(str, cuts))), ",").cast("array<bigint>")
    steps = F.sequence(F.lit(1), F.lit(len(cuts).bit_length()))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(cuts)).alias("hi"))

    def halve(acc: Column, _: Column) -> Column:
        mid = F.shiftright(acc["lo"] + acc["hi"], 1)
        open_ = acc["lo"] < acc["hi"]
        right = open_ & (F.get(table, mid) < key)
        return F.struct(
            F.when(right, mid + 1).otherwise(acc["lo"]).alias("lo"),
            F.when(open_ & ~right, mid).otherwise(acc["hi"]).alias("hi"),
        )

    return F.aggregate(steps, start, halve)["lo"]


def shard(df: DataFrame, id_col: str, text_col: str, shards: int) -> DataFrame:
    """(id, size, text_crc32, shard, slot): a shard for each row, and its place there.

    One narrow pass over the texts writes some 32 bytes a row to the shared
    folder; all else works on those.  The one large shuffle deals rows by (range, part),
    whose sizes are bounded, and serves both the join and the numbering.
    """
    rows = materialize(describe(df, id_col, text_col), "shard-rows")
    total = rows.agg(F.sum("size").alias("b")).first()["b"] or 0
    ranges = shards * RANGES_PER_SHARD
    cuts = splitters(rows, id_col, total, ranges)
    # Written, so that the optimiser can't carry the search over to the other side of a join.
    ranged = materialize(rows.withColumn("_range", range_of(F.col("key"), cuts)), "shard-ranges")

    share = max(1.0, OVERFULL * total / ranges)
    parts = F.greatest(F.ceil(F.sum("size") / F.lit(share)), F.ceil(F.count("*") / F.lit(RANGE_ROWS)))
    overfull = ranged.groupBy("_range").agg(parts.alias("_parts"), (F.min("key") == F.max("key")).alias("_one")).filter("_parts > 1")
    overfull = materialize(overfull, "shard-overfull", files=1)
    # At most one row for each range: a constant bound.
    # A range of one key is divided by row, any other by key: equal texts part only where they must.
    by = F.when(F.col("_one"), F.xxhash64(F.lit("part"), id_col)).otherwise(F.xxhash64(F.lit("part"), "key"))
    dealt = ranged.join(F.broadcast(overfull), "_range", "left").withColumn(
        "_part", F.coalesce(F.pmod(by, F.col("_parts")), F.lit(0)).cast("long")
    )

    in_order = Window.orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    in_shard = Window.partitionBy("shard").orderBy("_range", "_part").rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum("_bytes").over(in_order), F.lit(0))
    middle = (before + F.col("_bytes") / 2) * F.lit(shards / max(1, total))
    places = (
        dealt.groupBy("_range", "_part")
        .agg(F.sum("size").alias("_bytes"), F.count("*").alias("_rows"))
        .withColumn("shard", F.least(F.lit(shards - 1), F.floor(middle)).cast("int"))
        .withColumn("_first", F.coalesce(F.sum("_rows").over(in_shard), F.lit(0)))
        .select("_range", "_part", "shard", "_first")
    )
    numbered = Window.partitionBy("_range", "_part").orderBy("key", id_col, "size", "text_crc32")
    return dealt.join(places.hint("shuffle_merge"), ["_range", "_part"]).select(
        id_col, "size", "text_crc32", "shard", (F.col("_first") + F.row_number().over(numbered) - 1).alias("slot")
    )
