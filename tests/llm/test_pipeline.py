from __future__ import annotations

import pytest

import corpus_pipeline
from viewloom.llm import op3_langid, op4_jaccard, op9_packing

from .conftest import prose
from .test_decontam import brute as contaminated
from .test_jaccard import brute as grouped
from .test_langid import DE, EN, FR


@pytest.fixture(scope="module")
def folder(spark, make, tmp_path_factory):
    path = str(tmp_path_factory.mktemp("data"))
    item = "what is the name of the dog that went to the old house"
    rows = [(i, f"{(EN, DE, FR)[i % 3]}{prose(i, 30)}", ("en", "de", "fr")[i % 3]) for i in range(60)]
    near = EN * 5 + prose(300, 60)
    rows += [(100, near), (101, near), (102, near + " end"), (110, None), (111, ""), (112, "12 34"), (120, f"{EN} {item}. {prose(400, 20)}"), (130, f"{EN} token = abcdef123456 {prose(401, 20)}"), (140, EN + prose(402, 5_000))]
    make(rows).write.parquet(f"{path}/documents.parquet")
    spark.createDataFrame([(1, item), (2, None)], "item_id long, text string").write.parquet(f"{path}/benchmark.parquet")
    return path


def test_stages(spark, folder):
    docs = spark.read.parquet(f"{folder}/documents.parquet")
    columns, kept = docs.columns, {}
    for name, stage in corpus_pipeline.STAGES[:-1]:
        before = [(r["doc_id"], r["text"]) for r in docs.collect()]
        docs = stage(spark, docs, folder).cache()
        after = {r["doc_id"]: r["text"] for r in docs.collect()}
        assert docs.columns == columns
        kept[name] = after
        if name == "language_id":
            assert {d for d, _ in before} - set(after) == {110, 111, 112}
        elif name == "jaccard_join":
            assert set(after) == {c for _, _, c in grouped(before)} and 101 not in after and 102 not in after
        elif name == "decontamination":
            items = [(r["item_id"], r["text"]) for r in spark.read.parquet(f"{folder}/benchmark.parquet").collect()]
            assert set(after) == {r[0] for r in contaminated(before, items) if not r[-1]} and 120 not in after
        else:
            assert set(after) == {d for d, _ in before}
            assert after[130] == dict(before)[130].replace("token = abcdef123456", corpus_pipeline.SECRET)
            assert all(after[d] == t for d, t in before if d != 130)
    packed = corpus_pipeline.STAGES[-1][1](spark, docs, folder)
    assert {r["doc_id"] for r in packed.collect()} == set(kept["secret_scan"])


def test_run(spark, folder):
    out = corpus_pipeline.run(spark, folder).collect()
    assert len({r["doc_id"] for r in out}) == 60 + 3
    by = {}
    for r in out:
        by.setdefault(r["sequence_id"], []).append(r["length"])
    assert all(sum(x) <= op9_packing.CAPACITY for x in by.values())


def test_registered():
    import __spark_entry__ as entry

    names = set(entry.queries())
    assert "pipeline" in names and all(any(q.startswith(f"op{n}_") for q in names) for n in range(1, 11))
    assert [n for n, _ in corpus_pipeline.STAGES] == ["language_id", "jaccard_join", "decontamination", "secret_scan", "packing"]


def test_empty_tables(spark, make, tmp_path):
    make([]).write.parquet(f"{tmp_path}/documents.parquet")
    spark.createDataFrame([], "item_id long, text string").write.parquet(f"{tmp_path}/benchmark.parquet")
    assert corpus_pipeline.run(spark, str(tmp_path)).count() == 0
    assert op3_langid and op4_jaccard
