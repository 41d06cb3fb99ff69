from __future__ import annotations

import math
import struct
import zlib
from collections import Counter

import xxhash
from pyspark.sql import functions as F

from viewloom.llm import op2_sharding as S


def spark_hash(key: int | None, name: str) -> int:
    h = 42 if key is None else xxhash.xxh64_intdigest(struct.pack("<q", key), 42)
    return xxhash.xxh64_intdigest(name.encode(), h)


def by_hand(key: int | None, tree) -> int:
    def weight(n):
        return sum(map(weight, n.values())) if isinstance(n, dict) else n

    def draw(name, w):
        return -math.log(((spark_hash(key, name) >> 11) + 1) / 2**53) / w

    region = min(tree, key=lambda n: draw(n, weight(tree[n])) if len(tree) > 1 else 0)
    racks = tree[region]
    rack = min(racks, key=lambda n: draw(n, weight(racks[n])) if len(racks) > 1 else 0)
    return min(racks[rack], key=lambda s: draw(f"shard{s}", racks[rack][s]) if len(racks[rack]) > 1 else 0)


def test_draws_by_hand(spark):
    tree, grown = S.topology(16), S.topology(17)
    df = spark.range(-50, 400).withColumnRenamed("id", "k").union(spark.createDataFrame([(None,)], "k long"))
    for r in df.select("k", S.shard_of(F.col("k"), tree).alias("a"), S.shard_of(F.col("k"), grown).alias("b")).collect():
        assert r["a"] == by_hand(r["k"], tree) and r["b"] == by_hand(r["k"], grown)


def test_growth_moves_rows_only_into_the_new_shard(spark):
    df = spark.range(30_000).select(S.shard_of(F.col("id"), S.topology(16)).alias("a"), S.shard_of(F.col("id"), S.topology(17)).alias("b"))
    moved = df.filter("a <> b")
    assert moved.filter("b <> 16").count() == 0
    assert abs(moved.count() / 30_000 - 1 / 17) < 0.01
    sizes = Counter(r["a"] for r in df.collect())
    assert len(sizes) == 16 and max(sizes.values()) < 1.15 * 30_000 / 16


def test_weights(spark):
    tree = {"r": {"k": {0: 1.0, 1: 3.0}}, "q": {"l": {2: 4.0}}}
    sizes = Counter(r[0] for r in spark.range(20_000).select(S.shard_of(F.col("id"), tree)).collect())
    assert abs(sizes[0] / 20_000 - 1 / 8) < 0.01 and abs(sizes[1] / 20_000 - 3 / 8) < 0.015 and abs(sizes[2] / 20_000 - 0.5) < 0.015
    changed = {"r": {"k": {0: 2.0, 1: 3.0}}, "q": {"l": {2: 4.0}}}
    both = spark.range(20_000).select(S.shard_of(F.col("id"), tree).alias("a"), S.shard_of(F.col("id"), changed).alias("b")).filter("a <> b").collect()
    assert all(r["b"] in (0, 1) for r in both)  # movement ends in the subtree whose weight grew


def test_query_rows(make, odd_rows):
    rows = odd_rows * 5
    got = S.shard_documents(make(rows), S.topology(16), S.topology(17)).collect()
    assert len(got) == len(rows)
    slots = {}
    for r in got:
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert r["grown_shard"] in (r["shard"], 16) and 0 <= r["shard"] < 16
    assert all(sorted(x) == list(range(len(x))) for x in slots.values())
    sizes = Counter((r["doc_id"], r["size"], r["text_crc32"]) for r in got)
    assert sizes == Counter((d, len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for d, t in rows)
    assert S.shard_documents(make([]), S.topology(16)).count() == 0
