"""From raw documents to packed training sequences, in five stages.

1. quality: documents that the compression classifier rejects go.
2. lines: of lines that are alike the first one stays; a document that loses all its text goes.
3. near_duplicates: of documents linked by their shingles the one with the smallest id stays.
4. decontamination: documents with benchmark passages go.
5. packing: what is left is cut and packed into sequences.

Every stage works on all rows of the one before and is written as Parquet before the next starts, so a lost executor costs
one stage at most. All but the last return the columns of their input, extra ones included. Rows with null texts pass
the filters (no stage has anything against them) and are packed as empty texts; rows without an id are never duplicates.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from meterstone.llm.common import crc32_rest, stored, table
from meterstone.llm.decontamination import decontaminate, with_hits
from meterstone.llm.lines import remove_lines
from meterstone.llm.ngram_join import similar_sets
from meterstone.llm.packing import pack
from meterstone.llm.quality import fit_quality, score_quality


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep documents with a score of 0.5 or more, and those without text, of which there is nothing to judge.

    The model learns from labelled rows whose crc32 modulo 3 is not 1.
    """
    labels = table(spark, sf_dir, "labels").where(crc32_rest(F.col("doc_id"), 3) != 1)
    scored = score_quality(docs, fit_quality(docs, labels), column="__score")
    return scored.where("text is null or text = '' or __score >= 0.5").select(*docs.columns)


def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take repeated lines out of the texts. Documents left without any text go; those that had none stay."""
    left = remove_lines(docs, counts="__lines", min_chars=1).where(
        (F.col("__lines.n_removed") == 0) | (F.length(F.trim(F.translate("text", "\r\n\t", "   "))) > 0))
    return left.select(*[F.length("text").cast(docs.schema[c].dataType).alias(c) if c == "n_chars" else F.col(c) for c in docs.columns])


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Keep the smallest id of each component; of rows with equal ids, one."""
    found = stored(similar_sets(docs.select("doc_id", "text")), "groups")
    others = found.where("doc_id != component_id").select("doc_id").distinct()
    kept = docs.join(others, "doc_id", "left_anti").select(*docs.columns)
    again = found.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id")
    if again.isEmpty():
        return kept
    once = kept.join(again, "doc_id", "left_semi").dropDuplicates(["doc_id"])
    return kept.join(again, "doc_id", "left_anti").select(*docs.columns).unionByName(once.select(*docs.columns))


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Drop contaminated documents: some words in benchmark windows, and at least a twentieth of all."""
    judged = with_hits(decontaminate(docs, table(spark, sf_dir, "benchmark")), keys=("doc_id", "text_key"))
    bad = judged.where("contaminated").select(F.col("doc_id").alias("__id"), F.col("text_key").alias("__key")).distinct()
    same = F.col("doc_id").eqNullSafe(F.col("__id")) & (F.xxhash64(F.coalesce("text", F.lit(""))) == F.col("__key"))
    return docs.join(bad, same, "left_anti").select(*docs.columns)


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents with their sequence and place."""
    return pack(docs)


STAGES = [("quality", quality), ("lines", lines), ("near_duplicates", near_duplicates), ("decontamination", decontamination), ("packing", packing)]

#: Classifier, MinHash and tokenizer have no SQL form; tests compare the stages with brute-force versions.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name)
    return STAGES[-1][1](spark, docs, sf_dir)
