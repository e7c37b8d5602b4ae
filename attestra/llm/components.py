"""Connected components over links held in tables, with DataFrame operations alone."""

from __future__ import annotations

from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import drop_written, written

#: Links that a task joins before it passes them on.
GATHER = 200_000


def joined(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Of a task's links (u, v), for each node that they join with lesser ones, the least of those: fewer links, that join the same."""
    root: dict = {}

    def find(x):
        at = x
        while (up := root.get(at, at)) != at:
            at = up
        while x != at:  # what was passed leads there at once
            root[x], x = at, root[x]
        return at

    def out() -> pa.RecordBatch:
        found = [(x, y) for x in list(root) if (y := find(x)) != x]
        return pa.RecordBatch.from_arrays([pa.array([x for x, _ in found], kind), pa.array([y for _, y in found], kind)], names=["u", "v"])

    kind = None
    for batch in batches:
        kind = batch.column(0).type
        for u, v in zip(batch.column(0).to_pylist(), batch.column(1).to_pylist(), strict=True):
            a, b = find(u), find(v)
            if a != b:
                root[max(a, b)] = min(a, b)
        if len(root) > GATHER:
            yield out()
            root = {}
    if root:
        yield out()


def _stars(links: DataFrame) -> bool:
    """Whether each u has one v, and none is a v itself: then v is the component's least node."""
    rows = links.groupBy("u").agg(F.count("*").alias("n")).select("u", "n", F.lit(0).alias("as_v"))
    ends = links.select(F.col("v").alias("u")).distinct().select("u", F.lit(0).cast("long").alias("n"), F.lit(1).alias("as_v"))
    both = rows.unionByName(ends).groupBy("u").agg(F.sum("n").alias("n"), F.sum("as_v").alias("as_v"))
    return both.where("n > 1 OR (n > 0 AND as_v > 0)").isEmpty()


def components(links: DataFrame, name: str = "components") -> DataFrame:
    """node, root of every node that has a link; root is the component's smallest node.

    links: columns u and v of one orderable type; order, repeats and loops don't matter, links
    with a null end are ignored. Large-star and small-star steps alternate until nothing changes:
    the number of rounds grows with the logarithm of a component's size. Each round is written to
    the shared folder, so no lineage grows and no link or component comes to the driver. All is done
    in DataFrame operations; who makes the links in Python may pass them through joined() there.
    """
    at = written(links.where("u <> v").select(F.greatest("u", "v").alias("u"), F.least("u", "v").alias("v")).distinct(), name)
    while not _stars(at):
        both = at.unionByName(at.select(F.col("v").alias("u"), F.col("u").alias("v")))
        # written, so that the join is of two plain tables, and the links of one frequent node can be dealt over several tasks
        least = written(both.groupBy("u").agg(F.min("v").alias("m")).select("u", F.least("u", "m").alias("m")), name)
        large = both.where("v > u").join(least, "u").select(F.col("v").alias("u"), F.col("m").alias("v")).distinct()
        large = written(large, name)
        fewer = large.groupBy("u").agg(F.min("v").alias("m"))
        small = large.join(fewer, "u").where("v <> m").select(F.col("v").alias("u"), F.col("m").alias("v"))
        after = written(small.unionByName(fewer.select("u", F.col("m").alias("v"))).distinct(), name)
        drop_written(at.sparkSession, at, large, least)
        at = after
    return at.select(F.col("u").alias("node"), F.col("v").alias("root")).unionByName(at.select(F.col("v").alias("node"), F.col("v").alias("root")).distinct())


def merged(roots: DataFrame, more: DataFrame) -> DataFrame:
    """node, root after further links (u, v) between roots, or nodes that are alone."""
    again = components(more, "further")
    both = roots.join(again.select(F.col("node").alias("root"), F.col("root").alias("_root")), "root", "left").select("node", F.coalesce("_root", "root").alias("root"))
    return written(both.unionByName(again.join(roots, "node", "left_anti")), "roots")
