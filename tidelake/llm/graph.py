"""Connected components of links, by union-find in each task and min-label stars between tasks."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import packed


#: Links that a task takes.
ROWS = 100_000


def forest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Links (u, v) of a task, replaced by (node, least node) of each tree that union-find makes of them. A task that
    has seen a million nodes passes its trees on and starts anew."""
    over: dict[int, int] = {}

    def root(x: int) -> int:
        while (up := over.setdefault(x, x)) != x:
            over[x] = up = over[up]
            x = up
        return x

    def out() -> pa.RecordBatch:
        nodes = [x for x in over if root(x) != x]
        roots = [root(x) for x in nodes]
        over.clear()
        return pa.RecordBatch.from_arrays([pa.array(nodes, pa.int64()), pa.array(roots, pa.int64())], ["u", "v"])

    for batch in batches:
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = root(u), root(v)
            if a != b:
                over[max(a, b)] = min(a, b)
        if len(over) > 1_000_000:
            yield out()
    if over:
        yield out()


def _state(edges: DataFrame) -> tuple:
    return tuple(edges.agg(F.count("*"), F.coalesce(F.sum(F.xxhash64("u", "v").cast("decimal(38,0)")), F.lit(0))).first())


def components(links: DataFrame, rounds: int | None = None) -> DataFrame:
    """(node, component) of every node of ``links`` (u, v: long), the component being its smallest node.

    Each round links every node to the least node that it knows, first its larger neighbours, then its smaller ones;
    rounds go on until nothing changes (about the logarithm of the longest path). With ``rounds``, stops after so many:
    then nodes with one label are connected, but a component may still have several. Labels are found by grouping and
    plain joins, which are dealt anew where a node has very many links; each round ends with a checkpoint.
    """
    edges = packed(links.where("u IS NOT NULL AND v IS NOT NULL AND u != v").select("u", "v").mapInArrow(forest, "u long, v long").distinct(), ROWS)
    before, n = _state(edges), 0
    while before[0] and (rounds is None or n < rounds):
        both = edges.select("u", "v").unionByName(edges.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # The least nodes are kept first, so that both sides of the join are shuffled for it alone and adaptive execution can
        # split a node with very many links. Later in the round, links lead from larger nodes, which have few.
        least = packed(both.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), F.least("u", "m").alias("m")), ROWS)
        # large star: larger neighbours go to the least node known here
        large = both.join(least, F.col("u") == F.col("node")).where(F.col("v") > F.col("u")).select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        least = large.groupBy("u").agg(F.min("v").alias("m")).select(F.col("u").alias("node"), "m")
        # small star: the node itself and its other smaller neighbours go there
        small = large.join(least, F.col("u") == F.col("node")).where(F.col("v") != F.col("m")).select(F.col("v").alias("u"), F.col("m").alias("v"))
        edges = packed(small.unionByName(least.select(F.col("node").alias("u"), F.col("m").alias("v"))).distinct(), ROWS)
        after, n = _state(edges), n + 1
        if after == before:
            break
        before = after
    own = edges.groupBy("u").agg(F.min("v").alias("component")).withColumnRenamed("u", "node")
    roots = edges.select(F.col("v").alias("node")).distinct().join(own.select("node"), "node", "left_anti")
    return own.unionByName(roots.withColumn("component", F.col("node")))
