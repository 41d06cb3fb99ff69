"""Helpers shared by the operators: shared scratch tables, input reading, size-checked broadcasts, bounded batches."""

from __future__ import annotations

import tempfile
import uuid
from collections.abc import Callable

import numpy as np
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

#: Largest Arrow batch that goes to a Python worker, in bytes (one longer text still makes a batch of its own).
BATCH_BYTES = 4 << 20
#: Largest table that is broadcast, in bytes of its rows as JSON text.
BROADCAST_BYTES = 64 << 20

_CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
_BATCH = "spark.sql.execution.arrow.maxBytesPerBatch"


def read_table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A table of the data set, by a path that Spark's own readers open."""
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def shared_dir(spark: SparkSession) -> str:
    """The folder that the driver and all executors share: `spark.checkpoint.dir` of the session.

    Where that setting is absent, a single-JVM session gets a temporary folder; on a cluster that is an error, as
    executors would write to their own disks.
    """
    where = spark.conf.get("spark.checkpoint.dir", None)
    if not where:
        master = spark.sparkContext.master
        if master != "local" and not master.startswith("local["):
            raise ValueError(f"spark.checkpoint.dir is not set: on {master} the operators need a folder that all executors share")
        where = "file://" + tempfile.mkdtemp(prefix="viewloom-")
        spark.conf.set("spark.checkpoint.dir", where)
    return where.rstrip("/")


def scratch(spark: SparkSession) -> str:
    """The folder of this application's intermediate tables: it names the application, so that leftovers of a lost driver can be told."""
    return f"{shared_dir(spark)}/viewloom-{spark.sparkContext.applicationId}"


def written(df: DataFrame, label: str) -> DataFrame:
    """Cuts the lineage: writes df as Parquet to the shared folder and reads it back.

    A lost executor costs the tasks that were running, never a finished intermediate; so the shuffle files of
    the writing query can go as soon as it ends.
    """
    spark = df.sparkSession
    path = f"{scratch(spark)}/{label}-{uuid.uuid4().hex}"
    before = spark.conf.get(_CLEANUP, None)
    spark.conf.set(_CLEANUP, "true")
    try:
        df.write.parquet(path)
    finally:
        spark.conf.unset(_CLEANUP) if before is None else spark.conf.set(_CLEANUP, before)
    return spark.read.schema(df.schema).parquet(path)


def discard(*tables: DataFrame) -> None:
    """Deletes the files of tables made by `written`, once nothing reads them any more."""
    for df in tables:
        jvm = df.sparkSession.sparkContext._jvm  # Spark has no public call that deletes files
        conf = df.sparkSession._jsparkSession.sessionState().newHadoopConf()
        for folder in {f.rsplit("/", 1)[0] for f in df.inputFiles()}:
            path = jvm.org.apache.hadoop.fs.Path(folder)
            path.getFileSystem(conf).delete(path, True)


def arrow_map(df: DataFrame, run: Callable, schema) -> DataFrame:
    """mapInArrow with batches of at most BATCH_BYTES, unless the session has its own limit: by rows alone, very long texts would make very large batches."""
    spark = df.sparkSession
    if spark.conf.get(_BATCH, None) is None:
        spark.conf.set(_BATCH, BATCH_BYTES)
    return df.mapInArrow(run, schema)


def is_small(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> bool:
    """Whether the rows of a table, which must be a written one, take at most max_bytes as JSON text; they are measured."""
    size = F.octet_length(F.to_json(F.struct(*table.columns)))
    return (table.agg(F.sum(size)).first()[0] or 0) <= max_bytes


def broadcast_if_small(table: DataFrame, max_bytes: int = BROADCAST_BYTES) -> DataFrame:
    """Broadcast hint only if the written table is small; beyond that a shuffled join serves."""
    return F.broadcast(table) if is_small(table, max_bytes) else table


def lower_ascii(col):
    """Lower-cases A-Z alone; other letters stay as they are."""
    return F.translate(col, "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


#: Keys up to which rows are chosen by a bitmap in the workers (32 bits a key: 8 MB); beyond, by a join.
BITMAP_KEYS = 1 << 21


def marked(rows: DataFrame, keys: DataFrame, on: list[str], limit: int = BITMAP_KEYS) -> tuple[DataFrame, Callable]:
    """The rows with a key in `keys`, as (rows with a column `slot`, choose), where choose(batch) gives the places to take.

    Few keys become a bitmap of a fixed number of bits a key, built by an aggregation: no row is shuffled, and some 3 % of
    the other rows are taken as well. More keys than `limit` are joined, which is exact and moves the rows once.
    """
    n = keys.count()
    if n > limit:
        def every(batch) -> np.ndarray:
            return np.arange(batch.num_rows)

        return rows.join(keys.select(*on).distinct(), on, "left_semi").withColumn("slot", F.lit(0).cast("long")), every
    bits = 1 << 16
    while bits < 32 * n:
        bits <<= 1
    slot = F.pmod(F.xxhash64(*on), F.lit(bits)).cast("long")
    word = keys.select(slot.alias("s")).groupBy(F.shiftright("s", 6).alias("w"))
    bitmap = np.zeros(bits // 64, dtype="<i8")
    for r in word.agg(F.bit_or(F.expr("shiftleft(1L, cast(s & 63 as int))")).alias("b")).toLocalIterator():
        bitmap[r["w"]] = r["b"]
    flags = bitmap.view(np.uint8)

    def choose(batch) -> np.ndarray:
        slots = batch.column("slot").to_numpy(zero_copy_only=False)
        return np.flatnonzero((flags[slots >> 3] >> (slots & 7)) & 1)

    return rows.withColumn("slot", slot), choose
