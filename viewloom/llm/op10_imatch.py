"""I-Match fingerprints over randomised lexicon subsets. DataFrame operations only.

The lexicon holds the terms whose document frequency lies in a band (a fraction of all documents, so it
never has more than mean distinct terms / lower bound entries, whatever the corpus holds). A document keeps
its distinct lexicon terms, sorted; the hash of their list is the first part of its fingerprint. Each random
subset of the lexicon gives the hash of the kept terms in it as a further part, '-' if there are none. A
subset matches in two texts if no term that only one of them has is in it, which a subset of some 1/size of
the terms does best; so there are PER_SCALE subsets that hold a term with a chance of 1 in 2**s for each s
of SCALES, and texts of a few terms and of a thousand are served alike.
Likeness: equal parts over the parts that aren't empty in both; 1 where all are empty in both.

Defined results: null text is empty, and the fingerprint of a text without lexicon terms is all '-'; equal texts
have equal fingerprints; documents with one doc_id follow each other by ascending xxhash64 of the
text, then by text; null ids come after all others; a lone document is its own next one; an empty table gives an
empty result; a very long text is read whole, in time linear in its words; other input columns are ignored.
"""

from __future__ import annotations

from collections import Counter

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import read_table
from .op7_decontam import words_of

#: Document frequency of lexicon terms as fractions of all documents: IDF between 1.6 and 5.3 (natural logs).
BAND = (0.005, 0.2)
#: A term is in a subset of scale s with a chance of 1 in 2**s; SCALES x PER_SCALE subsets are the bits of a 64-bit mask.
SCALES = range(2, 10)
PER_SCALE = 8
SUBSETS = len(SCALES) * PER_SCALE
#: A likeness that most edited texts reach and few unrelated ones.
NEAR = 0.02
#: Documents in a range of ids that is sorted at once, and the most ranges.
RANGE_ROWS, MAX_RANGES = 64, 65_536


def lexicon_of(docs: DataFrame, n_docs: int, band: tuple[float, float] = BAND) -> list[str]:
    """Terms in the band, counted over all documents."""
    terms = docs.select(F.explode(F.array_distinct(words_of(F.col("text")))).alias("t")).groupBy("t").agg(F.count(F.lit(1)).alias("n"))
    kept = terms.filter((F.col("n") >= max(band[0] * n_docs, 1.0)) & (F.col("n") <= band[1] * n_docs))
    return sorted(r["t"] for r in kept.select("t").collect())


def _in(lexicon: list[str]):
    quoted = ",".join("'" + t.replace("\\", "\\\\").replace("'", "\\'") + "'" for t in lexicon)
    return f"filter(_all, t -> t IN ({quoted}))" if lexicon else "filter(_all, t -> false)"


def _signed(mask: int) -> int:
    return mask - (1 << 64) if mask >> 63 else mask


def _mask(h: Column) -> Column:
    """The subsets that hold a term of hash h, one bit each: the bits of a subset of scale s survive s random words."""
    out = F.lit(-1)
    for j in range(1, SCALES[-1] + 1):
        spared = sum(((1 << PER_SCALE) - 1) << (i * PER_SCALE) for i, s in enumerate(SCALES) if s < j)
        out = out.bitwiseAND(F.xxhash64(h, F.lit(j)).bitwiseOR(F.lit(_signed(spared)).cast("long")))
    return out


def add_fingerprint(df: DataFrame, text: str, name: str, lexicon: list[str]) -> DataFrame:
    """Adds column `name`: an array of the 1 + SUBSETS parts of the text's fingerprint, hashes as longs, 0 for an empty part."""
    plain = df.columns
    df = df.withColumn("_all", F.array_distinct(words_of(F.col(text))))
    df = df.withColumn("_hashes", F.transform(F.sort_array(F.expr(_in(lexicon))), lambda t: F.xxhash64(t)))
    df = df.withColumn("_kept", F.transform("_hashes", lambda h: F.struct(h.alias("h"), _mask(h).alias("m"))))
    # Few terms are in any subset of a large scale: each scale's terms are picked once for its subsets.
    def some(bits: Column):
        return lambda x: x["m"].bitwiseAND(bits) != 0

    scales = [((1 << PER_SCALE) - 1) << (i * PER_SCALE) for i in range(len(SCALES))]
    df = df.withColumns({f"_s{i}": F.filter("_kept", some(F.lit(_signed(m)).cast("long"))) for i, m in enumerate(scales)})

    def digest(k: int) -> Column:
        bit = F.lit(_signed(1 << k)).cast("long")
        return F.aggregate(f"_s{k // PER_SCALE}", F.lit(0).cast("long"), lambda acc, x: F.when(x["m"].bitwiseAND(bit) != 0, F.xxhash64(acc, x["h"])).otherwise(acc))

    whole = F.aggregate("_hashes", F.lit(0).cast("long"), lambda acc, h: F.xxhash64(acc, h))
    return df.select(*plain, F.array(whole, *[digest(k) for k in range(SUBSETS)]).alias(name))


def shown(fp: str) -> Column:
    """A fingerprint as text: its parts in hexadecimal, '-' for the empty ones, joined by dots."""
    return F.array_join(F.transform(fp, lambda x: F.when(x == 0, F.lit("-")).otherwise(F.lower(F.hex(x)))), ".")


def likeness(a: str, b: str) -> Column:
    parts = F.zip_with(a, b, lambda x, y: F.when((x == 0) & (y == 0), F.lit(0)).when(x == y, F.lit(2)).otherwise(F.lit(1)))
    used, same = F.size(F.filter(parts, lambda p: p > 0)), F.size(F.filter(parts, lambda p: p == 2))
    return F.when(used == 0, F.lit(1.0)).otherwise(same / used).cast("double")


def with_next(docs: DataFrame, n_docs: int, columns: list[str]) -> DataFrame:
    """Adds next_<c> of the next row by descending doc_id, then xxhash64 of the text, then text; the last row's next is the first.

    Rows are dealt to ranges of ids, and the rows of an id that fills several ranges to slices of it by the text's hash;
    the first row of each range is also sent to the range before it. So one shuffle brings every row and its next one
    together, and no task gets more than a range. Only rows equal in both id and text can't be told apart and stay together.
    """
    key = F.coalesce(F.col("doc_id").cast("long"), F.lit(-(2**63)))
    df = docs.withColumn("_k", key).withColumn("_n", F.bitwise_not(F.xxhash64("text")))
    m = min(MAX_RANGES, max(1, n_docs // RANGE_ROWS))
    side = max(1, int(m**0.5))
    quantiles = [i / (side * side) for i in range(1, side * side)]
    found: list[int] = []
    if quantiles and n_docs:
        found = df.agg(F.percentile_approx("_k", quantiles, max(10_000, 4 * side * side)).alias("q")).first()["q"] or []
    hot = {x: c + 1 for x, c in Counter(found).items() if c > 1}
    cuts = sorted({*found, *(x + 1 for x in hot if x < 2**63 - 1)})
    width = max(1, int(len(cuts) ** 0.5))
    blocks = [cuts[i : i + width] for i in range(0, len(cuts), width)]
    if cuts:
        # A range is a block and a place in it: two short searches instead of one over all cuts.
        def number(xs):
            return "array(" + ",".join(f"{x}L" if x > -(2**63) else "bigint('-9223372036854775808')" for x in xs) + ")"

        firsts, nested = number([b[0] for b in blocks]), "array(" + ",".join(number(b) for b in blocks) + ")"
        df = df.withColumn("_b", F.expr(f"size(filter({firsts}, x -> x <= _k))"))
        place = f"CASE WHEN _b = 0 THEN 0 ELSE (_b - 1) * {width} + size(filter(element_at({nested}, greatest(_b, 1)), x -> x <= _k)) END"
        df = df.withColumn("_range", F.expr(place)).drop("_b")
    else:
        df = df.withColumn("_range", F.lit(0))
    spark = docs.sparkSession
    if hot:  # at most MAX_RANGES / 2 ids
        df = df.join(F.broadcast(spark.createDataFrame(list(hot.items()), "_k long, _slices int")), "_k", "left")
        share = (F.lit(0.5) - F.col("_n") / F.lit(2.0**64)) * F.col("_slices")
        df = df.withColumn("_slice", F.when(F.col("_slices").isNull(), 0).otherwise(F.least(F.greatest(F.floor(share), F.lit(0)), F.col("_slices") - 1)).cast("int"))
    else:
        df = df.withColumn("_slice", F.lit(0))
    first = F.struct("_k", "_n")
    tops = {(r["_range"], r["_slice"]): r["top"] for r in df.groupBy("_range", "_slice").agg(F.max(first).alias("top")).collect()}  # at most 3 x MAX_RANGES rows
    order = sorted(tops, key=lambda x: (-x[0], x[1]))
    before = [(*x, *tops[x], i, i - 1 if i else len(order) - 1) for i, x in enumerate(order)]
    at = spark.createDataFrame(before or [(0, 0, 0, 0, 0, 0)], "_range int, _slice int, _topk long, _topn long, _at int, _before int")
    df = df.join(F.broadcast(at), ["_range", "_slice"])
    own = F.struct(F.col("_at").alias("r"), F.lit(0).alias("ghost"))
    ghost = F.struct(F.col("_before").alias("r"), F.lit(1).alias("ghost"))
    is_first = (F.col("_k") == F.col("_topk")) & (F.col("_n") == F.col("_topn"))
    df = df.withColumn("_copy", F.explode(F.when(is_first, F.array(own, ghost)).otherwise(F.array(own))))
    w = Window.partitionBy("_copy.r").orderBy(F.col("_copy.ghost"), F.col("_k").desc(), F.col("_n").desc(), F.col("text"))
    df = df.select(*docs.columns, F.col("_copy.ghost").alias("_ghost"), *[F.lead(c).over(w).alias(f"next_{c}") for c in columns])
    return df.filter(F.col("_ghost") == 0).drop("_ghost")


def fingerprints(docs: DataFrame, band: tuple[float, float] = BAND) -> DataFrame:
    """Fingerprints of every document, of its edited text, and their likenesses."""
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    n_docs = base.count()
    lexicon = lexicon_of(base, n_docs, band)
    own = add_fingerprint(base, "text", "fp", lexicon)
    df = with_next(own, n_docs, ["text", "fp"]).withColumn("n_chars", F.char_length("text").cast("long"))
    half = F.floor(F.col("n_chars") / 2).cast("int")
    edited = F.concat(F.expr("left(text, cast(n_chars as int) - cast(floor(n_chars / 2) as int))"), F.substring(F.col("next_text"), F.lit(1), half))
    df = df.select("doc_id", "n_chars", "fp", "next_fp", edited.alias("edited"))
    df = add_fingerprint(df, "edited", "edited_fp", lexicon)
    return df.select(
        "doc_id",
        "n_chars",
        F.sha2(F.col("edited").cast("binary"), 256).alias("edited_sha256"),
        shown("fp").alias("fingerprint"),
        shown("edited_fp").alias("edited_fingerprint"),
        likeness("fp", "edited_fp").alias("near_edited"),
        likeness("fp", "next_fp").alias("near_next"),
    )


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fingerprints(read_table(spark, sf_dir, "documents"))
