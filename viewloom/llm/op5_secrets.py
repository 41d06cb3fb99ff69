"""Secret scans by an incremental blob ledger.

A document version is a blob, addressed by the SHA-256 of its text. The ledger is a table of (blob,
rule_version, findings) for all blobs that were ever scanned. A run addresses all documents, takes the pairs of blob and
rule version that the ledger lacks, scans one carrier document of each, appends the result to the
ledger, and joins the findings back to every document (path) that has the blob.

The keys are made once and written. The carriers are chosen by a bitmap in the workers, so that texts aren't shuffled, or, if
more blobs are unseen than a bitmap is made for, by a join. A row that the bitmap takes by chance means a second scan of a
blob, whose findings are the same; they enter the ledger once.

A run appends by one commit, into a folder of its own below the ledger (run=<id>); if two runs at once scan the same new
blob, the ledger has it twice, with equal findings, and readers take one of them.

Rules: assign, access and hex as below, and three formats with unmistakable prefixes (pem, github, jwt).
Spans of a kind are leftmost and don't overlap; matches that fail the kind's length are dropped.

Defined results: null text is an empty blob without findings; equal texts share a blob and so their
findings; repeated rows are returned as often; very long texts are scanned whole, in time linear in their length; an empty table gives an empty result; other input columns are ignored,
but for those that `scan` is asked to keep.
"""

from __future__ import annotations

import hashlib
import re
import uuid
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import arrow_map, broadcast_if_small, discard, marked, read_table, scratch, written

KINDS = ["assign", "access", "hex", "pem", "github", "jwt"]
BASE_KINDS = KINDS[:3]
RULE_VERSION = 1
#: Blobs that a task remembers, so as not to scan a copy again.
SEEN = 1_000_000

_ASSIGN = re.compile(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", re.ASCII | re.IGNORECASE)
_ACCESS = re.compile(r"AKIA[A-Z0-9]+")
_HEX = re.compile(r"[0-9a-f]{24,}")  # the runs of [0-9a-f]+ that are long enough
_PEM = re.compile(r"-----BEGIN [A-Z ]{0,30}PRIVATE KEY-----[A-Za-z0-9+/=\s]*(?:-----END [A-Z ]{0,30}PRIVATE KEY-----)?")
_GITHUB = re.compile(r"gh[pousr]_[A-Za-z0-9]{36,}")
_JWT = re.compile(r"eyJ[A-Za-z0-9_-]{8,}\.eyJ[A-Za-z0-9_-]{8,}\.[A-Za-z0-9_-]{8,}")


def secrets(text: str) -> list[tuple[str, int, int]]:
    """(kind, start, end) of all findings, by start and then kind."""
    out = []
    low = text.encode("utf-8", "surrogatepass").lower()
    if b"passw" in low or b"secret" in low or b"token" in low or b"api" in low:
        out += [("assign", *m.span()) for m in _ASSIGN.finditer(text) if len(m[2]) >= 6]
    if "AKIA" in text:
        out += [("access", *m.span()) for m in _ACCESS.finditer(text) if len(m[0]) >= 20]
    out += [("hex", *m.span()) for m in _HEX.finditer(text)]
    if "PRIVATE KEY-----" in text:
        out += [("pem", *m.span()) for m in _PEM.finditer(text)]
    if b"gh" in low and "_" in text:
        out += [("github", *m.span()) for m in _GITHUB.finditer(text)]
    if "eyJ" in text:
        out += [("jwt", *m.span()) for m in _JWT.finditer(text)]
    return sorted(out, key=lambda x: (x[1], KINDS.index(x[0]), x[2]))


def digest(spans: list[tuple[str, int, int]]) -> str:
    return ",".join(f"{k}:{s}:{e}" for k, s, e in spans)


LEDGER = "blob string, rule_version int, n_assign long, n_access long, n_hex long, base_sha256 string, spans string"


def _scanned(rows: DataFrame, choose, rule_version: int) -> DataFrame:
    """Ledger rows for the (blob, slot, text) rows that are chosen; a task scans a blob once."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[str] = set()
        for batch in batches:
            keep = pa.array(choose(batch))
            out: list[tuple] = []
            for blob, text in zip(batch.column("blob").take(keep).to_pylist(), batch.column("text").take(keep).to_pylist()):
                if blob not in seen:
                    if len(seen) >= SEEN:
                        seen.clear()
                    seen.add(blob)
                    spans = secrets(text)
                    base = [x for x in spans if x[0] in BASE_KINDS]
                    kinds = [x[0] for x in base]
                    out.append((blob, rule_version, *map(kinds.count, BASE_KINDS), hashlib.sha256(digest(base).encode()).hexdigest(), digest(spans)))
            cols = list(zip(*out)) or [()] * 7
            types = [pa.string(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.string(), pa.string()]
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, types)], names=[x.split()[0] for x in LEDGER.split(", ")])

    return arrow_map(rows, run, LEDGER)


def known(spark: SparkSession, ledger_path: str, rule_version: int = RULE_VERSION) -> DataFrame:
    """The ledger's rows of a rule version, one for each blob; none if there is no ledger yet."""
    jvm, conf = spark.sparkContext._jvm, spark._jsparkSession.sessionState().newHadoopConf()
    path = jvm.org.apache.hadoop.fs.Path(ledger_path)
    if not path.getFileSystem(conf).exists(path):
        return spark.createDataFrame([], LEDGER)
    rows = spark.read.schema(LEDGER).option("recursiveFileLookup", "true").parquet(ledger_path)
    return rows.filter(F.col("rule_version") == rule_version).dropDuplicates(["blob"])


def _blob():
    return F.sha2(F.coalesce(F.col("text"), F.lit("")).cast("binary"), 256)


def scan(docs: DataFrame, ledger_path: str, rule_version: int = RULE_VERSION, keep: tuple[str, ...] = ()) -> DataFrame:
    """Findings of every document; the ledger at ledger_path (a folder for Parquet files) is read and extended."""
    spark = docs.sparkSession
    paths = written(docs.select("doc_id", *keep, _blob().alias("blob")), "paths")
    # A null id would match no key of a join: those blobs are told by the hash of the id, as in the bitmap.
    path = F.xxhash64("doc_id").alias("path")
    carriers = paths.select(path, "blob").groupBy("blob").agg(F.min("path").alias("path"))
    carriers = written(carriers.join(known(spark, ledger_path, rule_version).select("blob"), "blob", "left_anti"), "carriers")
    if not carriers.isEmpty():
        rows = docs.select(path, _blob().alias("blob"), F.coalesce("text", F.lit("")).alias("text"))
        rows, choose = marked(rows, carriers, ["path", "blob"])
        new = _scanned(rows.select("blob", "slot", "text"), choose, rule_version)
        # A row taken by chance may hold a blob that the ledger has, or that another task scanned.
        new = new.join(carriers.select("blob"), "blob", "left_semi").dropDuplicates(["blob"])
        new.write.parquet(f"{ledger_path}/run={uuid.uuid4().hex}")
    discard(carriers)
    # A table of its own: only a join of two plain inputs is split where many paths have one blob.
    findings = written(known(spark, ledger_path, rule_version), "findings")
    return paths.join(findings, "blob").select("doc_id", *keep, "blob", "n_assign", "n_access", "n_hex", "base_sha256", "spans")


def redact(docs: DataFrame, ledger_path: str, mark: str) -> DataFrame:
    """docs with the union of the findings' spans replaced by `mark`, and n_chars, if there is one, brought up to date."""
    found = scan(docs, ledger_path).filter(F.col("spans") != "").select(F.col("blob").alias("_blob"), "spans").dropDuplicates(["_blob"])
    spot = F.transform(F.split("spans", ","), lambda x: F.struct(F.split_part(x, F.lit(":"), F.lit(2)).cast("int").alias("s"), F.split_part(x, F.lit(":"), F.lit(3)).cast("int").alias("e")))
    found = broadcast_if_small(written(found.select("_blob", F.array_sort(spot).alias("_spans")), "spans"))
    joined = docs.withColumn("_key", _blob()).join(found, F.col("_key") == F.col("_blob"), "left")
    start = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))

    def cut(acc, x):
        # A span that begins inside the one before adds its tail to it.
        fresh = F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, x["s"] - acc["at"]), F.lit(mark))
        return F.struct(F.when(x["s"] >= acc["at"], fresh).otherwise(acc["out"]).alias("out"), F.greatest(acc["at"], x["e"]).alias("at"))

    done = F.aggregate("_spans", start, cut, lambda acc: F.concat(acc["out"], F.substring(F.col("text"), acc["at"] + 1, F.char_length("text"))))
    text = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(done)
    out = joined.withColumn("_text", text)
    changed = {"text": F.col("_text")}
    if "n_chars" in docs.columns:
        kind = docs.schema["n_chars"].dataType
        changed["n_chars"] = F.when(F.col("_spans").isNull(), F.col("n_chars")).otherwise(F.char_length("_text")).cast(kind)
    return out.select(*[changed.get(c, F.col(c)).alias(c) for c in docs.columns])


#: Session setting that names a ledger to keep from run to run; without it the query has a ledger of its own.
LEDGER_SETTING = "spark.viewloom.secretLedger"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    ledger = spark.conf.get(LEDGER_SETTING, None) or f"{scratch(spark)}/ledger-{uuid.uuid4().hex}"
    found = scan(read_table(spark, sf_dir, "documents"), ledger)
    return found.select("doc_id", "n_assign", "n_access", "n_hex", "base_sha256", "spans")
