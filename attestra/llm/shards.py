"""Sharding by a hierarchical weighted hash tree (operator 9).

A tree of regions, racks and shards has a weight at each shard; a rack weighs what its shards do, a
region what its racks do. A row descends from the top: at each level every child draws -ln(u) / w
with u a hash of the row's key and the child's name, and the least draw wins. So a change of a weight
moves rows only into or out of subtrees whose weights change, and rows elsewhere keep their place.
tree_of() lays shards out so that a further shard beyond the first full tree is a region of its own:
then it takes rows only into itself.

Law of the query: `key`, doc_id and the number of shards decide. Rows with equal doc_id share a shard,
so do those with a null one. A null text has no bytes (size 1, crc32 of nothing). Slots number a
shard's rows from 0 in ascending order of doc_id, null first; ties fall in an arbitrary fixed
order. Extra columns are ignored. All is done in DataFrame operations.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import range_slots, table, written

#: region -> rack -> {shard: weight}
Tree = dict[str, dict[str, dict[int, float]]]
FULL = (2, 2, 4)


def tree_of(shards: int, full: tuple[int, int, int] = FULL) -> Tree:
    """A full tree of regions, racks and shards, and each shard beyond it (all, if they don't fill it) alone in a region."""
    regions, racks, each = full
    tree: Tree = {}
    filled = regions * racks * each if shards >= regions * racks * each else 0
    for s in range(shards):
        if s < filled:
            r, k = divmod(s // each, racks)
            tree.setdefault(f"region{r}", {}).setdefault(f"region{r}/rack{k}", {})[s] = 1.0
        else:
            tree[f"alone{s}"] = {f"alone{s}/rack": {s: 1.0}}
    return tree


def _draw(key: Column, name: str, weight: float) -> Column:
    if weight <= 0:
        return F.lit(float("inf"))
    u = (F.shiftrightunsigned(F.xxhash64(key, F.lit(name)), 11).cast("double") + 0.5) * F.lit(2.0**-53)
    return -F.log(u) / F.lit(float(weight))


def _least(key: Column, children: dict[str, tuple[float, Column]]) -> Column:
    """The value of the child with the least draw; ties go to the lesser name."""
    names = sorted(children)
    if len(names) == 1:
        return children[names[0]][1]
    winner = F.array_min(F.array(*(F.struct(_draw(key, n, children[n][0]).alias("d"), F.lit(i).alias("i")) for i, n in enumerate(names))))["i"]
    chosen = F.when(winner == 0, children[names[0]][1])
    for i, n in enumerate(names[1:], 1):
        chosen = chosen.when(winner == i, children[n][1])
    return chosen


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard that a key descends to."""
    regions = {}
    for region, racks in tree.items():
        below = {}
        for rack, shards in racks.items():
            below[rack] = (sum(shards.values()), _least(key, {f"{rack}/{s:06d}": (w, F.lit(s)) for s, w in shards.items()}))
        regions[region] = (sum(w for w, _ in below.values()), _least(key, below))
    return _least(key, regions)


def sharded(docs: DataFrame, tree: Tree, grown: Tree) -> DataFrame:
    """doc_id, size, text_crc32, law, shard, slot and grown_shard of each row.

    Slots come from a range partitioning by shard and doc_id: rows are numbered within each
    partition, after the counts of a shard's earlier partitions, of which there are few.
    """
    key = F.col("doc_id")
    text = F.coalesce("text", F.lit(""))
    rows = docs.select(key.cast("long").alias("doc_id"), (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = rows.withColumn("shard", shard_of(key, tree).cast("int")).withColumn("grown_shard", shard_of(key, grown).cast("int"))
    # ranges are found by sampling, which would read all texts once more
    placed = range_slots(written(rows, "placed"), ["shard", "doc_id", "text_crc32"], "slots")
    counts = placed.groupBy("_part", "shard").agg(F.count("*").alias("n"))
    before = counts.withColumn("before", F.sum("n").over(Window.partitionBy("shard").orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)))
    own = F.row_number().over(Window.partitionBy("_part", "shard").orderBy("doc_id", "text_crc32"))
    out = placed.withColumn("_own", own).join(before.select("_part", "shard", "before"), ["_part", "shard"])
    slot = (F.col("_own") - 1 + F.coalesce("before", F.lit(0))).cast("long")
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", slot.alias("slot"), "grown_shard")


def write_shards(docs: DataFrame, tree: Tree, to: str) -> None:
    """All rows with all their columns, in a folder shard=N for each shard."""
    name = "shard"
    while name in docs.columns:
        name = f"_{name}"
    docs.withColumn(name, shard_of(F.col("doc_id"), tree)).write.partitionBy(name).parquet(to)


def op9_shards(spark: SparkSession, sf_dir: str) -> DataFrame:
    return sharded(table(spark, sf_dir, "documents"), tree_of(16), tree_of(17))


