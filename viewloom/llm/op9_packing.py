"""Best-fit packing by minimum bin slack.

Documents are tokenized once, long ones are cut, and the pieces are reduced to a histogram of lengths,
which has at most `capacity` entries whatever the corpus holds. On the histogram the driver builds one bin
after another: the longest length left is the seed, and a subset-sum dynamic program over bitsets finds
the fullest feasible combination of the available lengths for the rest of the bin. The combination is
removed as often as the histogram still holds it, which is what repeating the program for each of these
bins would give. Each combination uses up a length, so the number of combinations is bounded by the
number of lengths too.

A piece that fills a sequence needs no plan: it is a sequence of its own. Other pieces of one length are
interchangeable: they get gapless ranks within their length (numbered in buckets of some BUCKET_ROWS pieces, whatever the
number of pieces or equal documents), and the r-th piece takes the r-th place that the plan has for that length.

Defined results: null text is an empty text, which is one piece with the end id alone; equal texts are packed
separately; very long texts are encoded whole and cut; an empty table gives an empty result; other input columns are ignored.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, read_table, written

CAPACITY = 2048
END_ID = 0
#: The split pattern of the byte-level file (public_tokenizers.PATTERN).
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
LONG_RUN = 100_000
#: Pieces of a length that are numbered at once, and the least number of buckets of a length.
BUCKET_ROWS = 100_000
MIN_BUCKETS = 64


class Ids:
    """Ids of whole texts by a byte-level BPE file of the tokenizers library, as little-endian 32-bit numbers.

    The merge ranks of such a file are its ids, so the faster engine of tiktoken, given the file's own vocabulary
    and split pattern, finds the same ids. Texts with a special token's string, or with a run of
    more than LONG_RUN characters that isn't split at white space, go to the tokenizers library itself.
    """

    def __init__(self, path: str):
        import json

        import tiktoken
        from tokenizers import Tokenizer

        os.environ.setdefault("TOKENIZERS_PARALLELISM", "false")  # a task has one core
        self.slow = Tokenizer.from_file(path)
        with open(path, encoding="utf-8") as f:
            vocab = json.load(f)["model"]["vocab"]
        self.special = [t.content for t in self.slow.get_added_tokens_decoder().values()]
        # The file writes bytes as printable characters: those that are printable as they are, the others from 256 on.
        plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
        byte_of = {chr(b): b for b in plain} | {chr(256 + i): b for i, b in enumerate(b for b in range(256) if b not in plain)}
        ranks = {bytes(byte_of[c] for c in token): i for token, i in vocab.items() if token not in self.special}
        self.fast = tiktoken.Encoding("byte_bpe", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={})
        self.run = re.compile(rf"\S{{{LONG_RUN},}}|\s{{{LONG_RUN},}}")

    def __call__(self, text: str) -> bytes:
        if any(s in text for s in self.special) or len(text) >= LONG_RUN and self.run.search(text):
            return np.asarray(self.slow.encode(text, add_special_tokens=False).ids, dtype="<u4").tobytes()
        return self.fast.encode_to_numpy(text, disallowed_special=()).astype("<u4", copy=False).tobytes()


PIECES = "doc_id {key}, piece int, start long, length long, ids_crc32 long"


def cut(n: int, capacity: int) -> Iterator[tuple[int, int]]:
    """(start, length) of the pieces of n ids: whole bins, but for the first, which takes what is over."""
    first = n % capacity or min(n, capacity)
    start, length = 0, first
    while start < n:
        yield start, length
        start, length = start + length, capacity


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """The pieces of every document: doc_id, piece, start, length, ids_crc32."""
    key = docs.schema["doc_id"].dataType.simpleString()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids_of = Ids(tokenizer_path)
        end = np.asarray([END_ID], dtype="<u4").tobytes()
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                part = batch.slice(at, 256)
                rows: list[tuple[int, int, int, int, int]] = []
                for i, text in enumerate(part.column("text").to_pylist()):
                    ids = ids_of(text or "") + end
                    for k, (start, length) in enumerate(cut(len(ids) // 4, capacity)):
                        rows.append((i, k, start, length, zlib.crc32(ids[4 * start : 4 * (start + length)])))
                cols = list(zip(*rows)) or [(), (), (), (), ()]
                yield pa.RecordBatch.from_arrays(
                    [part.column("doc_id").take(pa.array(cols[0], pa.int64())), pa.array(cols[1], pa.int32()), *(pa.array(c, pa.int64()) for c in cols[2:])],
                    names=["doc_id", "piece", "start", "length", "ids_crc32"],
                )

    return arrow_map(docs.select("doc_id", "text"), run, PIECES.format(key=key))


def fullest(capacity: int, counts: dict[int, int]) -> dict[int, int]:
    """The combination of available lengths with the largest sum up to capacity: {length: times}.

    Subset sums are bits of an integer; a length that is available c times enters as 1, 2, 4, ... copies.
    Longer lengths come first, and the search ends as soon as the bin can be filled completely.
    """
    mask, target = (1 << (capacity + 1)) - 1, 1 << capacity
    reach, steps = 1, []
    for length in sorted((x for x in counts if x <= capacity and counts[x] > 0), reverse=True):
        left, k = min(counts[length], capacity // length), 1
        while left > 0:
            k = min(k, left)
            more = reach | (reach << (length * k)) & mask
            if more != reach:
                steps.append((length, k, reach))
                reach = more
            left, k = left - k, k * 2
        if reach & target:
            break
    at, taken = reach.bit_length() - 1, {}
    for length, k, before in reversed(steps):
        if not (before >> at) & 1:
            taken[length] = taken.get(length, 0) + k
            at -= length * k
    return taken


def plan(histogram: dict[int, int], capacity: int = CAPACITY) -> list[tuple[int, dict[int, int]]]:
    """Bins for a histogram of lengths: (number of bins, {length: times in each})."""
    counts, bins = {x: n for x, n in histogram.items() if n > 0}, []
    for seed in sorted(counts, reverse=True):
        while counts.get(seed, 0) > 0:
            counts[seed] -= 1
            combo = fullest(capacity - seed, counts)
            counts[seed] += 1
            combo[seed] = combo.get(seed, 0) + 1
            times = min(counts[x] // k for x, k in combo.items())
            for x, k in combo.items():
                counts[x] -= k * times
            bins.append((times, combo))
    return bins


def places(bins: list[tuple[int, dict[int, int]]]) -> list[tuple[int, int, int, int, int, int]]:
    """(length, first rank, ranks, times in a bin, first sequence, offset) for the r-th pieces of each length."""
    used: dict[int, int] = {}
    out, sequence = [], 0
    for times, combo in bins:
        offset = 0
        for length in sorted(combo, reverse=True):
            k = combo[length]
            out.append((length, used.get(length, 0), times * k, k, sequence, offset))
            used[length] = used.get(length, 0) + times * k
            offset += length * k
        sequence += times
    return out


def ranked(pieces: DataFrame, histogram: dict[int, int]) -> DataFrame:
    """Adds `rank`: gapless from 0 among the pieces of a length. Buckets are dealt by the pieces' own numbers `_row`."""
    spark = pieces.sparkSession
    table = [(x, max(MIN_BUCKETS, -(-n // BUCKET_ROWS))) for x, n in histogram.items()] or [(0, 1)]
    buckets = spark.createDataFrame(table, "length long, _buckets long")  # at most `capacity` rows
    rows = pieces.join(F.broadcast(buckets), "length").withColumn("_bucket", F.pmod(F.xxhash64("_row"), F.col("_buckets")))
    before = Window.partitionBy("length").orderBy("_bucket").rowsBetween(Window.unboundedPreceding, -1)
    base = (
        rows.groupBy("length", "_bucket").agg(F.count(F.lit(1)).alias("_n"))
        .select("length", "_bucket", F.coalesce(F.sum("_n").over(before), F.lit(0)).alias("_base"))
    )
    within = Window.partitionBy("length", "_bucket").orderBy("_row")
    return (
        rows.withColumn("_rn", F.row_number().over(within))
        .join(base, ["length", "_bucket"])
        .withColumn("rank", F.col("_base") + F.col("_rn") - 1)
        .drop("_bucket", "_buckets", "_rn", "_base")
    )


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = CAPACITY) -> DataFrame:
    """Packs every document: doc_id, piece, start, length, ids_crc32, sequence_id, offset."""
    spark = docs.sparkSession
    pieces = written(pieces_of(docs, tokenizer_path, capacity).withColumn("_row", F.monotonically_increasing_id()), "pieces")
    histogram = {r["length"]: r["n"] for r in pieces.groupBy("length").agg(F.count(F.lit(1)).alias("n")).collect()}
    histogram.pop(capacity, None)
    table = places(plan(histogram, capacity))
    at = spark.createDataFrame(table or [(0, 0, 0, 1, 0, 0)], "length long, _first long, _ranks long, _times long, _sequence long, _offset long")
    within = F.col("rank") - F.col("_first")
    spot = F.pmod(within, F.col("_times"))
    columns = ["doc_id", "piece", "start", "length", "ids_crc32"]
    full = pieces.filter(F.col("length") == capacity).select(*columns, (-1 - F.col("_row")).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    # The table of places is bounded by the capacity: at most `capacity` combinations of distinct lengths.
    mixed = (
        ranked(pieces.filter(F.col("length") < capacity), histogram)
        .join(F.broadcast(at), "length")
        .filter((within >= 0) & (within < F.col("_ranks")))
        .select(
            *columns,
            (F.col("_sequence") + F.floor(within / F.col("_times"))).cast("long").alias("sequence_id"),
            (F.col("_offset") + spot * F.col("length")).cast("long").alias("offset"),
        )
    )
    return full.union(mixed)


def tokenizer_file() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(read_table(spark, sf_dir, "documents"), tokenizer_file())
