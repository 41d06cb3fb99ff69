"""Benchmark decontamination with a broadcast hash set of normalised n-grams. DataFrame operations only.

Every window of ten item words (a shorter item is one window) is an entry of the hash set. Document words
are scanned once; a token window is looked up wherever the longest word of some item window stands at its
place in it, which is true of every occurrence of that window, so nothing is lost and most positions cost
one probe of a small table. A looked-up window is verified by its text.

The benchmark's tables are written and measured, and broadcast only while they are small. For a larger benchmark the
windows of the documents, of each length that an item's windows have, are joined with it by a shuffle of (document,
place, window); neither way shuffles a document's text or its list of words. Both take time linear in a text's length.

Defined results: null or wordless text has no words and no hits; null or wordless items have no window;
repeated documents are judged each, repeated items count once for each item_id; an empty table gives an
empty result (documents) or no hits (benchmark); other input columns are ignored or, in `decontaminate`, kept.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import BROADCAST_BYTES, is_small, lower_ascii, read_table, written

WINDOW = 10
#: Bytes up to which a table of the benchmark is broadcast.
MAX_BYTES = BROADCAST_BYTES
NOT_WORD = r"[\x00-\x2F\x3A-\x60\x7B-\x7F]+"


def words_of(text: Column) -> Column:
    """Words of a text: A-Z lower-cased, then the runs of digits, letters a-z and characters beyond ASCII."""
    return F.array_remove(F.split(lower_ascii(F.coalesce(text, F.lit(""))), NOT_WORD), "")


def windows_of(items: DataFrame, window: int = WINDOW) -> DataFrame:
    """item_id, gram, len, anchor (the longest word), off (its place) of every window of every item."""
    w = items.select("item_id", words_of(F.col("text")).alias("w")).filter(F.size("w") > 0)
    w = w.withColumn("len", F.least(F.size("w"), F.lit(window)))
    w = w.withColumn("s", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))))
    w = w.withColumn("g", F.slice("w", F.col("s") + 1, F.col("len")))
    longest = F.array_max(F.transform("g", lambda x, i: F.struct(F.length(x).alias("n"), (-i).alias("i"))))
    return w.withColumn("off", -longest["i"]).select(
        "item_id", F.array_join("g", " ").alias("gram"), "len", "off", F.element_at("g", F.col("off") + 1).alias("anchor")
    )


def hits(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """Verified windows: doc_id, text_hash, start, len, item_ids."""
    grams = windows_of(items, window)
    probes = written(grams.select("anchor", "off", "len").distinct(), "probes")
    known = written(grams.groupBy("gram").agg(F.collect_set("item_id").alias("item_ids")).withColumn("gram_hash", F.xxhash64("gram")), "grams")
    seen = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), words_of(F.col("text")).alias("w"))
    if is_small(probes, MAX_BYTES) and is_small(known, MAX_BYTES):
        known = F.broadcast(known)
        seen = seen.select("doc_id", "text_hash", "w", F.posexplode("w").alias("pos", "word"))
        found = seen.join(F.broadcast(probes), seen["word"] == probes["anchor"]).withColumn("start", F.col("pos") - F.col("off"))
        found = found.filter((F.col("start") >= 0) & (F.col("start") + F.col("len") <= F.size("w")))
        found = found.select("doc_id", "text_hash", "start", "len", F.array_join(F.slice("w", F.greatest(F.col("start"), F.lit(0)) + 1, F.col("len")), " ").alias("seen"))
    else:
        lengths = sorted(r["len"] for r in probes.select("len").distinct().collect())  # at most `window` numbers
        each = F.explode(F.array(*map(F.lit, lengths)) if lengths else F.array().cast("array<int>")).alias("len")
        placed = seen.select("*", each).filter(F.size("w") >= F.col("len"))
        placed = placed.select("doc_id", "text_hash", "w", "len", F.explode(F.sequence(F.lit(0), F.size("w") - F.col("len"))).alias("start"))
        found = placed.select("doc_id", "text_hash", "start", "len", F.array_join(F.slice("w", F.col("start") + 1, F.col("len")), " ").alias("seen"))
    same = (F.xxhash64(found["seen"]) == known["gram_hash"]) & (found["seen"] == known["gram"])
    return found.join(known, same).select("doc_id", "text_hash", "start", "len", "item_ids")


def _covered(spans: Column) -> Column:
    """Number of positions in the union of the (start, len) spans."""
    zero = F.struct(F.lit(0).alias("n"), F.lit(0).alias("end"))

    def add(acc, x):
        end = x["start"] + x["len"]
        return F.struct(
            (acc["n"] + F.greatest(F.lit(0), end - F.greatest(acc["end"], x["start"]))).alias("n"),
            F.greatest(acc["end"], end).alias("end"),
        )

    return F.aggregate(F.array_sort(spans), zero, add)["n"]


def judge(docs: DataFrame, items: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated, spans of every document."""
    by_doc = (
        hits(docs, items, window)
        .groupBy("doc_id", "text_hash")
        .agg(F.collect_set(F.struct("start", "len")).alias("spans"), F.array_distinct(F.flatten(F.collect_set("item_ids"))).alias("ids"))
        .select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "spans", "ids")
    )
    every = docs.select("doc_id", F.xxhash64("text").alias("text_hash"), F.size(words_of(F.col("text"))).cast("long").alias("n_words"))
    ids = F.array_sort(F.transform(F.coalesce("ids", F.array()), lambda x: x.cast("string")))
    return every.join(by_doc, F.col("doc_id").eqNullSafe(F.col("_id")) & (F.col("text_hash") == F.col("_hash")), "left").select(
        "doc_id",
        "text_hash",
        "n_words",
        F.coalesce(_covered(F.col("spans")), F.lit(0)).cast("long").alias("n_hit"),
        F.size(ids).cast("long").alias("n_items"),
        F.sha2(F.array_join(ids, ","), 256).alias("items_sha256"),
        F.col("spans").isNotNull().alias("contaminated"),
        "spans",
    )


def decontaminate(docs: DataFrame, items: DataFrame, remove: str = "documents", window: int = WINDOW) -> DataFrame:
    """docs without contaminated documents (remove="documents") or without the hit words (remove="spans")."""
    found = hits(docs, items, window).select("doc_id", "text_hash", F.struct("start", "len").alias("span"))
    found = found.groupBy("doc_id", "text_hash").agg(F.collect_set("span").alias("_spans"))
    bad = written(found.select(F.col("doc_id").alias("_id"), F.col("text_hash").alias("_hash"), "_spans"), "contaminated")
    same = F.col("doc_id").eqNullSafe(F.col("_id")) & (F.xxhash64("text") == F.col("_hash"))
    if remove == "documents":
        gone = bad.drop("_spans")
        return docs.join(F.broadcast(gone) if is_small(gone, MAX_BYTES) else gone, same, "left_anti")
    if remove != "spans":
        raise ValueError(f"remove must be 'documents' or 'spans', not {remove!r}")
    # Each word with what follows it; the first part is what stands before the first word.
    word = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
    head = F.regexp_extract("text", r"^[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*", 0)
    parts = F.regexp_extract_all(F.col("text"), F.lit(word + r"[\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]*"), F.lit(0))
    left = F.filter(parts, lambda p, i: ~F.exists("_spans", lambda x: (i >= x["start"]) & (i < x["start"] + x["len"])))
    joined = docs.join(bad, same, "left")
    cut = F.when(F.col("_spans").isNull(), F.col("text")).otherwise(F.concat(head, F.array_join(left, "")))
    return joined.select(*[cut.alias(c) if c == "text" else F.col(c) for c in docs.columns])


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = judge(read_table(spark, sf_dir, "documents"), read_table(spark, sf_dir, "benchmark"))
    return out.drop("text_hash", "spans")


_UP, _LOW = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"
_WORDS = r"regexp_extract_all(translate(coalesce(text, ''), '{up}', '{low}'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+')".format(up=_UP, low=_LOW)

SQL = f"""
WITH b AS (SELECT DISTINCT item_id, {_WORDS} AS w FROM benchmark),
bl AS (SELECT item_id, w, least(len(w), {WINDOW}) AS l FROM b WHERE len(w) > 0),
bw AS (SELECT DISTINCT item_id, l, array_to_string(w[s:s + l - 1], ' ') AS gram
       FROM (SELECT item_id, w, l, unnest(generate_series(1, len(w) - l + 1)) AS s FROM bl)),
d AS (SELECT row_number() OVER () AS k, doc_id, {_WORDS} AS w FROM documents),
dw AS (SELECT k, s, l, array_to_string(w[s:s + l - 1], ' ') AS gram
       FROM (SELECT k, w, l, unnest(generate_series(1, len(w) - l + 1)) AS s
             FROM d, (SELECT DISTINCT l FROM bw) WHERE len(w) >= l)),
h AS (SELECT k, s, dw.l AS l, item_id FROM dw JOIN bw ON dw.gram = bw.gram AND dw.l = bw.l),
p AS (SELECT k, count(DISTINCT pos) AS n FROM (SELECT k, unnest(generate_series(s, s + l - 1)) AS pos FROM h) GROUP BY k),
i AS (SELECT k, count(*) AS n, string_agg(x, ',' ORDER BY x) AS ids
      FROM (SELECT DISTINCT k, CAST(item_id AS VARCHAR) AS x FROM h) GROUP BY k)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(p.n, 0) AS BIGINT) AS n_hit,
       CAST(coalesce(i.n, 0) AS BIGINT) AS n_items, sha256(coalesce(i.ids, '')) AS items_sha256, coalesce(p.n, 0) > 0 AS contaminated
FROM d LEFT JOIN p ON d.k = p.k LEFT JOIN i ON d.k = i.k
"""
