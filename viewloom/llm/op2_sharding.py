"""Sharding by a hierarchical weighted hash tree.

A row descends region -> rack -> shard. At each level every child draws an exponential variate from a
hash of (key, child's name), divided by the child's weight; the smallest draw wins. A child is taken
with a probability proportional to its weight, and a change of one weight moves rows only between that
child and its siblings, so movement stays inside the subtrees whose weights change.

Growth: `topology(n)` opens a region of its own for the shards beyond the base tree, so that the step
from the base to one more shard changes no weight but the new region's: rows move only into the new
shard. Weights are the numbers of leaves below a node.

Defined results: a null key is hashed like any value (all null keys share a shard); a null text counts as
no bytes; rows that are equal in all columns get different slots of the same shard; a very long text is only measured;
an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table, written

N_SHARDS = 16
RACKS_PER_REGION = 2
SHARDS_PER_RACK = 4
#: Numbering is done in this many hash buckets of each shard, so no task needs a whole shard.
SLOT_BUCKETS = 1024

Rack = dict[int, float]
Region = dict[str, Rack]
Tree = dict[str, Region]


def topology(n_shards: int, base: int = N_SHARDS) -> Tree:
    """The tree of n_shards: full regions of racks up to `base`, then one region for each further shard."""
    tree: Tree = {}
    for shard in range(n_shards):
        if shard < base:
            rack = shard // SHARDS_PER_RACK
            region = f"region{rack // RACKS_PER_REGION}"
            name = f"rack{rack}"
        else:
            region, name = f"grown{shard}", f"grown{shard}/rack"
        tree.setdefault(region, {}).setdefault(name, {})[shard] = 1.0
    return tree


def _draw(key: Column, node: str, weight: float) -> Column:
    """Exponential draw of a node: -ln(u) / weight, u in (0, 1] from 53 bits of the hash."""
    bits = F.shiftrightunsigned(F.xxhash64(key, F.lit(node)), 11)
    return -F.log((bits.cast("double") + 1.0) / float(2**53)) / weight


def _winner(key: Column, children: list[tuple[str, float, Column]]) -> Column:
    """Value of the child with the smallest draw; ties go to the child listed first."""
    if len(children) == 1:
        return children[0][2]
    draws = [F.struct(_draw(key, name, w).alias("d"), F.lit(i).alias("i")) for i, (name, w, _) in enumerate(children)]
    best = F.least(*draws)["i"]
    out = F.when(best == 0, children[0][2])
    for i, (_, _, value) in enumerate(children[1:], 1):
        out = out.when(best == i, value)
    return out


def shard_of(key: Column, tree: Tree) -> Column:
    """The shard number of a key, by descending the tree."""

    def weight(node) -> float:
        return sum(map(weight, node.values())) if isinstance(node, dict) else node

    def racks(region: Region) -> Column:
        return _winner(key, [(name, weight(rack), shards(rack)) for name, rack in region.items()])

    def shards(rack: Rack) -> Column:
        return _winner(key, [(f"shard{s}", w, F.lit(s)) for s, w in rack.items()])

    return _winner(key, [(name, weight(region), racks(region)) for name, region in tree.items()]).cast("int")


def assign_slots(rows: DataFrame) -> DataFrame:
    """Adds `slot`: gapless from 0 in each shard, without gathering a shard in one task.

    The rows get a number of their own and are written. Within (shard, bucket) they are counted by that number, which also
    deals out the buckets, so that rows with the same key or with the same text spread over all of them; the offset of a
    bucket is the number of rows in the shard's buckets before it, from a table of at most shards x SLOT_BUCKETS rows.
    """
    rows = written(rows.withColumn("_row", F.monotonically_increasing_id()), "sharded")
    rows = rows.withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.lit(SLOT_BUCKETS)).cast("int"))
    before = Window.partitionBy("shard").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy("shard", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("shard", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy("shard", "_bucket").orderBy("_row")
    numbered = rows.withColumn("_rn", F.row_number().over(within))
    return (
        numbered.join(F.broadcast(base), ["shard", "_bucket"])
        .withColumn("slot", (F.col("_base") + F.col("_rn") - 1).cast("long"))
        .drop("_bucket", "_rn", "_base", "_row")
    )


def shard_documents(docs: DataFrame, tree: Tree, grown: Tree | None = None, key: str = "doc_id", text: str = "text") -> DataFrame:
    """doc_id, size, text_crc32, shard, grown_shard, slot of every row of docs; the text itself is never shuffled."""
    whole = F.coalesce(F.col(text), F.lit(""))
    rows = docs.select(
        F.col(key).alias("doc_id"),
        (F.octet_length(whole) + 1).cast("long").alias("size"),
        F.crc32(whole.cast("binary")).alias("text_crc32"),
        shard_of(F.col(key), tree).alias("shard"),
        (shard_of(F.col(key), grown) if grown else F.lit(None).cast("int")).alias("grown_shard"),
    )
    return assign_slots(rows)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    out = shard_documents(docs, topology(N_SHARDS), topology(N_SHARDS + 1))
    return out.select("doc_id", "size", "text_crc32", F.lit("key").alias("law"), "shard", "slot", "grown_shard")
