"""Connected components of a graph given by its edges, by repeated contraction.

Each task first joins its own edges by union-find.  Then every node takes the
least node of its neighbourhood as its label and the edges are contracted to
labels, until none is left.  Node ids should be hashes: contraction then halves
chains in expectation.  Written tables cut the lineage of every round.
"""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from keyorder.llm.common import discard, fewer, released, write_table


def _joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """The edges of a task as (node, least node of its component)."""
    parent: dict[int, int] = {}

    def find(x: int) -> int:
        root = x
        while parent.get(root, root) != root:
            root = parent[root]
        while parent.get(x, x) != root:
            parent[x], x = root, parent[x]
        return root

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            parent[max(a, b)] = min(a, b)
    nodes = [x for x in parent if find(x) != x]
    for at in range(0, len(nodes), 10_000):
        some = nodes[at : at + 10_000]
        yield pa.RecordBatch.from_arrays([pa.array(some, pa.int64()), pa.array([find(x) for x in some], pa.int64())], ["u", "v"])


def components(edges: DataFrame) -> DataFrame:
    """(node, component) of all nodes on edges (u, v); component: the least node.  Loops add nothing."""
    spark = edges.sparkSession
    read = lambda path: spark.read.parquet(path)
    few = fewer(spark)
    left = write_table(edges.filter("u != v").select("u", "v").mapInArrow(released(_joined), "u long, v long"), "cc-edges", few)
    named = None  # (node, component) so far
    while read(left).limit(1).count():
        e = read(left)
        both = e.unionByName(e.select(F.col("v").alias("u"), F.col("u").alias("v")))
        least = both.groupBy(F.col("u").alias("node")).agg(F.least(F.min("v"), F.first("u")).alias("component"))
        labels = write_table(least, "cc-labels", few)
        of = lambda c: read(labels).select(F.col("node").alias(c), F.col("component").alias(f"l{c}"))
        shrunk = e.join(of("u"), "u").join(of("v"), "v").filter("lu != lv")
        pairs = shrunk.select(F.least("lu", "lv").alias("u"), F.greatest("lu", "lv").alias("v")).distinct()
        left_next = write_table(pairs.mapInArrow(released(_joined), "u long, v long"), "cc-edges", few)
        if named is None:
            named_next = labels
        else:
            step = read(labels).select(F.col("node").alias("component"), F.col("component").alias("next"))
            moved = read(named).join(step, "component", "left").select("node", F.coalesce("next", "component").alias("component"))
            named_next = write_table(moved, "cc-named", few)
            discard(spark, named, labels)
        discard(spark, left)
        named, left = named_next, left_next
    if named is None:
        return spark.createDataFrame([], "node long, component long")
    return read(named)
