"""Corpus preparation: documents in, packed training sequences out.

Each stage takes the documents its predecessor kept and returns the documents it keeps, columns unchanged; the last returns
one row per packed piece. Between stages the rows are written to the shared checkpoint folder, since every stage reads its
input more than once. A stage first has the files removed that nothing refers to since its predecessor was written.

Null and repeated rows, empty texts and empty tables behave as each operator's docstring says. In near-deduplication rows
that share an id and a shingle set count as one document; rows without an id stay, one of each text if there are several such rows.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession, Window, functions as F

from watchgrid.llm.common import tables
from watchgrid.llm.decontamination import contamination
from watchgrid.llm.near_duplicates import near_duplicates, with_digest
from watchgrid.llm.packing import pack_documents
from watchgrid.llm.quality import judged
from watchgrid.llm.queries import VOCABULARY, VOCABULARY_RANKS
from watchgrid.llm.toxicity import train
from watchgrid.session import cut_lineage, free_finished


def _all(docs: DataFrame) -> tuple[str, ...]:
    return tuple(f"`{c}`" for c in docs.columns)


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    return judged(docs, _all(docs)).where("kept").select("row.*")


def toxicity(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_finished(spark)
    score = train(docs, tables(spark, sf_dir, "labels"))
    return score(docs, _all(docs)).where("predicted = 0").select("row.*")


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_finished(spark)
    found = cut_lineage(near_duplicates(docs, digest=True))
    rows = found.groupBy(F.col("doc_id").alias("__id")).agg(F.count("*").alias("__rows"), F.count(F.when(F.col("kept"), 1)).alias("__kept"))
    rows = cut_lineage(rows)
    mine = F.col("doc_id").eqNullSafe(F.col("__id"))
    if rows.where(F.col("__rows") > 1).isEmpty():
        return docs.join(rows.where(F.col("__kept") > 0), mine, "left_semi")
    # An id may have several texts, some kept and some not.
    kept = found.where("kept").select(F.col("doc_id").alias("__id"), F.col("digest").alias("__of")).distinct()
    same = with_digest(docs, "__digest").join(kept, mine & F.col("__digest").eqNullSafe(F.col("__of")), "left_semi")
    text = F.sha2(F.encode(F.coalesce("text", F.lit("")), "UTF-8"), 256)
    one = F.coalesce(F.when(F.col("doc_id").isNotNull(), F.hex("__digest")), text)
    first = F.row_number().over(Window.partitionBy("doc_id", one).orderBy(text))
    return same.withColumn("__first", first).where("__first = 1").drop("__first", "__digest")


def decontamination(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_finished(spark)
    found = contamination(docs, tables(spark, sf_dir, "benchmark"), _all(docs))
    return found.where(F.size("spans") == 0).select("row.*")


def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    free_finished(spark)
    return pack_documents(docs, VOCABULARY_RANKS, VOCABULARY)


STAGES = [
    ("quality rules", quality_rules),
    ("toxicity", toxicity),
    ("near-dedup", near_dedup),
    ("decontamination", decontamination),
    ("packing", packing),
]

#: Boosted trees and byte-pair ids are beyond SQL; tests hold the stages against planted cases and brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = tables(spark, sf_dir, "documents")
    for i, (_, stage) in enumerate(STAGES):
        docs = stage(spark, docs if i == 0 else cut_lineage(docs), sf_dir)
    return docs
