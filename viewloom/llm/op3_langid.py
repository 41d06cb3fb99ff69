"""Language ID by word-first backoff.

A word that the model knows is scored by its log frequency in each language. An unseen word falls back to
its character n-grams: the longest length, from 5 down to 1, of which the model knows any. Scores are taken
relative to their mean over the languages; a document's score of a language is the mean over its words, and
the result is the softmax of the mean times EVIDENCE (or the number of words, if fewer).

The model is fitted on a bounded sample of labelled rows: of each language about TRAIN_DOCS documents, chosen
by a hash of doc_id, outside the held-out fifth. Of each language it keeps the MAX_WORDS most frequent words and
the MAX_GRAMS most frequent n-grams of each length, of those seen MIN_COUNT times in the sample, so that a frequent
language doesn't crowd out a rare one and its size doesn't grow with the corpus. Predictions see the text alone.

Defined results: null or letterless text is `und` with score 0; so is every text if no row is labelled; ties between
languages go to the first in order; repeated rows are judged each; an empty table gives an empty result; a very long
text is read whole, its distinct words in slices; other input columns are ignored or, in `identify`, kept.
"""

from __future__ import annotations

import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import arrow_map, discard, read_table, written

#: Bounds of the fitted model, all for each language: documents of the sample, words, n-grams of a length.
TRAIN_DOCS = 2_000
MAX_WORDS = 40_000
MAX_GRAMS = 10_000
#: Times a word or n-gram must be seen in the sample, over all languages.
MIN_COUNT = 2
LONGEST = 5
EVIDENCE = 20
#: Scores that a worker keeps: so many words, times languages.
CACHE_SCORES = 1_000_000
#: Words and n-grams that a task counts before it hands its counts on.
TASK_KEYS = 100_000
UND = "und"

_WORD = re.compile(r"[^\W\d_]+")


def words_of(text: str | None) -> list[str]:
    return _WORD.findall(text.lower()) if text else []


def grams_of(word: str, n: int) -> list[str]:
    w = f"^{word}$"
    return [w[i : i + n] for i in range(len(w) - n + 1)]


def held_out():
    """True for the fifth of the documents that is never learned from."""
    return F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit("")).cast("binary")), F.lit(5)) == 0


class Model:
    """Per-language log frequencies of words and n-grams, as one matrix for each length (0: words)."""

    def __init__(self, langs: list[str], counts: dict[tuple[int, str], list[int]]):
        self.langs = langs
        self.index: list[dict[str, int]] = [{} for _ in range(LONGEST + 1)]
        self.scores: list[np.ndarray] = []
        for n in range(LONGEST + 1 if langs else 0):
            keys = sorted(k for m, k in counts if m == n)
            self.index[n] = {k: i for i, k in enumerate(keys)}
            c = np.array([counts[n, k] for k in keys], dtype=float).reshape(len(keys), len(langs))
            logs = np.log((c + 0.1) / (c.sum(axis=0, keepdims=True) + 0.1 * max(1, len(keys))))
            self.scores.append((logs - logs.mean(axis=1, keepdims=True)).astype(np.float32))

    def word(self, w: str) -> np.ndarray:
        i = self.index[0].get(w)
        if i is not None:
            return self.scores[0][i]
        for n in range(LONGEST, 0, -1):
            rows = [j for g in grams_of(w, n) if (j := self.index[n].get(g)) is not None]
            if rows:
                return self.scores[n][rows].mean(axis=0)
        return np.zeros(len(self.langs), np.float32)


class Scorer:
    """Applies a model to texts; keeps up to CACHE_SCORES scores of words."""

    def __init__(self, model: Model):
        self.model = model
        self.rows: dict[str, int] = {}
        self.most = max(1, CACHE_SCORES // max(1, len(model.langs)))
        self.matrix = np.zeros((self.most, max(1, len(model.langs))), np.float32)

    def __call__(self, text: str | None) -> tuple[str, float]:
        counts = Counter(words_of(text))
        if not self.model.langs or not any(c.isalpha() for w in counts for c in w):
            return UND, 0.0
        rows, total = self.rows, np.zeros(len(self.model.langs))
        words, times = list(counts), np.fromiter(counts.values(), float, len(counts))
        step = min(self.most, 50_000)
        for lo in range(0, len(words), step):
            part = words[lo : lo + step]
            new = [w for w in part if w not in rows]
            if len(rows) + len(new) > self.most:
                rows.clear()
                new = part
            for w in new:
                self.matrix[len(rows)] = self.model.word(w)
                rows[w] = len(rows)
            total += times[lo : lo + step] @ self.matrix[[rows[w] for w in part]]
        n = times.sum()
        z = total / n * min(n, EVIDENCE)
        p = np.exp(z - z.max())
        best = int(np.argmax(p))
        return self.model.langs[best], float(p[best] / p.sum())


def fit(docs: DataFrame, train_docs: int = TRAIN_DOCS) -> Model:
    """Fits the model on about train_docs labelled documents of each language, outside the held-out fifth."""
    labelled = docs.filter(F.col("lang").isNotNull() & ~held_out())
    sizes = {r["lang"]: r["n"] for r in labelled.groupBy("lang").agg(F.count(F.lit(1)).alias("n")).collect()}
    langs = sorted(sizes)
    if not langs:
        return Model([], {})
    spark = docs.sparkSession
    share = spark.createDataFrame([(x, min(1.0, train_docs / sizes[x])) for x in langs], "lang string, _share double")
    draw = F.pmod(F.xxhash64(F.col("doc_id"), F.lit("langid")), F.lit(1_000_000)) / 1_000_000
    sample = labelled.join(F.broadcast(share), "lang").filter(draw < F.col("_share")).select("lang", "text")

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found: dict[str, list[Counter]] = {}

        def rows() -> pa.RecordBatch:
            cols = list(zip(*((x, n, k, c) for x, own in found.items() for n in range(LONGEST + 1) for k, c in own[n].items()))) or [()] * 4
            return pa.RecordBatch.from_arrays(
                [pa.array(cols[0], pa.string()), pa.array(cols[1], pa.int32()), pa.array(cols[2], pa.string()), pa.array(cols[3], pa.int64())],
                names=["lang", "n", "key", "c"],
            )

        for batch in batches:
            words: dict[str, Counter] = {}
            for lang, text in zip(batch.column("lang").to_pylist(), batch.column("text").to_pylist()):
                words.setdefault(lang, Counter()).update(words_of(text))
            for lang, times in words.items():
                own = found.setdefault(lang, [Counter() for _ in range(LONGEST + 1)])
                for w, c in times.items():
                    own[0][w] += c
                    for n in range(1, LONGEST + 1):
                        for g in grams_of(w, n):
                            own[n][g] += c
            if sum(len(x) for own in found.values() for x in own) > TASK_KEYS:
                yield rows()
                found.clear()
        yield rows()

    counts = arrow_map(sample, count, "lang string, n int, key string, c long")
    place = F.create_map(*[x for i, lang in enumerate(langs) for x in (F.lit(lang), F.lit(i))])[F.col("lang")].alias("l")
    by_lang = written(counts.groupBy("n", "key", place).agg(F.sum("c").alias("c")), "gram-counts")
    seen = by_lang.withColumn("total", F.sum("c").over(Window.partitionBy("n", "key"))).filter(F.col("total") >= MIN_COUNT)
    rank = F.row_number().over(Window.partitionBy("n", "l").orderBy(F.desc("c"), "key"))  # at most the sample's distinct keys of a length
    top = seen.withColumn("rank", rank).filter(F.col("rank") <= F.when(F.col("n") == 0, MAX_WORDS).otherwise(MAX_GRAMS)).select("n", "key").distinct()
    found = by_lang.join(top, ["n", "key"], "left_semi").select("n", "key", "l", "c").toArrow()
    discard(by_lang)
    table: dict[tuple[int, str], list[int]] = {}
    for batch in found.to_batches(max_chunksize=10_000):
        for n, key, lang, c in zip(*(column.to_pylist() for column in batch.columns)):
            table.setdefault((n, key), [0] * len(langs))[lang] = c
    return Model(langs, table)


def identify(docs: DataFrame, model: Model, keep: list[str] | None = None) -> DataFrame:
    """The columns `keep` (doc_id), lang_pred and score of every document; a clash of names is the caller's to avoid."""
    keep = keep if keep is not None else ["doc_id"]

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            found = [score(t) for t in batch.column("_text").to_pylist()]
            arrays = [batch.column(c) for c in keep] + [pa.array([x for x, _ in found], pa.string()), pa.array([x for _, x in found], pa.float64())]
            yield pa.RecordBatch.from_arrays(arrays, names=[*keep, "lang_pred", "score"])

    from pyspark.sql import types as T

    schema = T.StructType([*(docs.schema[c] for c in keep), T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType())])
    return arrow_map(docs.select(*keep, F.col("text").alias("_text")), run, schema)


def keep_identified(docs: DataFrame, model: Model, min_score: float) -> DataFrame:
    """The rows of docs, with all their columns, whose language is found with min_score or more."""
    at = docs.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        score = Scorer(model)
        for batch in batches:
            found = [score(t) for t in batch.column(at).to_pylist()]
            keep = [i for i, (x, p) in enumerate(found) if x != UND and p >= min_score]
            yield batch.take(pa.array(keep, pa.int64()))

    return arrow_map(docs, run, docs.schema)


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = read_table(spark, sf_dir, "documents")
    found = identify(docs.withColumn("held_out", held_out()), fit(docs), ["doc_id", "held_out"])
    return found.select("doc_id", "held_out", "lang_pred", "score")
