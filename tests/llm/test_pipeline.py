"""Each stage of the pipeline on its own input, against plain versions, and the queries' contract columns."""

import zlib

import pytest
from pyspark.sql import functions as F

import __spark_entry__ as contract
import corpus_pipeline as p
from tests.llm.helpers import awkward_rows, frame, joined_sets, sentence
from tests.llm.test_operators import plain_hits

FOLDER = "/root/testdata/sf0.001"


@pytest.fixture(scope="module")
def docs(spark):
    return frame(spark, awkward_rows())


def test_stages_keep_columns_and_clean_rows(spark, docs):
    for name, stage in p.STAGES[:-1]:
        kept = stage(spark, docs, FOLDER)
        assert kept.columns == docs.columns, name
        ids = {r[0] for r in kept.select("doc_id").collect()}
        assert {4, 5, 9, 15, None} <= ids, name  # empty, null, long, unusual letters, without an id


def test_near_duplicates_keep_the_smallest(spark, docs):
    rows = awkward_rows()
    want = sorted({i for i, (_, component) in joined_sets(rows).items() if i == component})
    kept = [r[0] for r in p.near_duplicates(spark, docs, FOLDER).select("doc_id").collect()]
    assert sorted(i for i in kept if i is not None) == want and kept.count(None) == 1


def test_lines_take_effect(spark, docs):
    left = {r["doc_id"]: r for r in p.lines(spark, docs, FOLDER).collect()}
    assert 2 not in left and left[1]["text"] == sentence(1, 120)
    assert left[11]["text"] == sentence(6, 80) and left[11]["n_chars"] == len(sentence(6, 80))


def test_contaminated_documents_go(spark):
    bench = spark.read.parquet(f"{FOLDER}/benchmark.parquet").collect()
    items = [(r["item_id"], r["text"]) for r in bench]
    data = [(1, items[0][1], None, None, None), (2, sentence(900, 2000) + " " + items[1][1], None, None, None), (3, sentence(901, 50), None, None, None),
            (None, items[2][1], None, None, None), (1, sentence(902, 30), None, None, None)]
    kept = p.decontamination(spark, frame(spark, data), FOLDER).select("doc_id", "text").collect()
    want = [(i, t) for i, t, *_ in data if not plain_hits(t, items)[4]]
    assert sorted(map(str, map(tuple, kept))) == sorted(map(str, want)) and len(want) == 3


def test_run_packs_what_the_stages_keep(spark):
    found = p.run(spark, FOLDER)
    docs = spark.read.parquet(f"{FOLDER}/documents.parquet")
    for _, stage in p.STAGES[:-1]:
        docs = stage(spark, docs, FOLDER)
    kept = {r[0] for r in docs.select("doc_id").collect()}
    assert {r[0] for r in found.select("doc_id").collect()} == kept and 0 < len(kept) < 200


def test_stages_of_nothing(spark):
    none = frame(spark, [])
    for _, stage in p.STAGES:
        assert stage(spark, none, FOLDER).count() == 0


def test_every_operator_is_registered():
    names = list(contract.queries())
    assert all(sum(n.startswith(f"op{k}_") for n in names) == 1 for k in range(1, 11)) and "pipeline" in names


def test_contract_columns(spark):
    want = {
        "op1_": {"doc_id", "n_shingles", "component_id"}, "op2_": {"doc_id", "size", "text_crc32", "law", "shard", "slot", "grown_shard"},
        "op3_": {"query_id", "rank", "vec_id", "score"}, "op4_": {"doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"},
        "op6_": {"doc_id", "n_words", "n_hit", "n_items", "items_sha256", "contaminated"}, "op7_": {"doc_id", "held_out", "lang_pred", "score"},
        "op8_": {"doc_id", "n_words", "n_removed", "kept_sha256"},
        "op9_": {"doc_id", "n_email", "n_ip", "n_card", "n_phone", "base_sha256", "spans"}, "op10_": {"doc_id", "held_out", "score", "predicted"},
    }
    for start, columns in want.items():
        name = next(n for n in contract.queries() if n.startswith(start))
        found = contract.queries()[name](spark, FOLDER)
        assert columns <= set(found.columns), name
        if start != "op3_":
            assert found.select("doc_id").distinct().count() == 200, name
        if start in ("op7_", "op10_"):
            divisor, rest = (4, 2) if start == "op7_" else (3, 1)
            assert all(r["held_out"] == (zlib.crc32(str(r["doc_id"]).encode()) % divisor == rest) for r in found.collect())
            assert found.where(~F.col("score").between(0, 1)).count() == 0


def test_quality_keeps_rows_without_text_whatever_the_model(spark, docs, monkeypatch):
    # A model whose score of an empty text is far below one half.
    monkeypatch.setattr(p, "score_quality", lambda df, model, column: df.withColumn(column, F.when(F.length("text") > 20, 0.9).otherwise(0.1)))
    kept = {r[0] for r in p.quality(spark, docs, FOLDER).select("doc_id").collect()}
    assert {4, 5} <= kept and 7 not in kept and 1 in kept
