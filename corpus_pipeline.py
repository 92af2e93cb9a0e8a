"""A training corpus from documents: rules, language model, near-duplicates, mixing, packing. Each stage works on all that the one before it kept."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidelake.llm import minhash, mixing, packing, quality_lm, quality_rules
from tidelake.llm.common import Scratch, table
from tidelake.llm.queries import tokenizer_path


#: Least similarity of near-duplicates, in hundredths; op7's own bound is another contract.
NEAR_PERCENT = 80


def quality_rules_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that pass the base and all rules."""
    return quality_rules.apply_rules(docs)


def quality_classifier_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents whose perplexity is within their language's threshold."""
    return quality_lm.keep(docs, table(spark, sf_dir, "labels"))


def near_dedup_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-duplicates, the first as stored. A row is a document, by its place in the files; its id, which may be null or repeat, doesn't matter, nor does what other rows with that id say. Rows without words stay."""
    tmp = Scratch(spark, "dedup")
    row = "__row" + "_" * max((len(c) for c in docs.columns), default=0)  # no column of docs
    rows = docs.withColumn(row, F.monotonically_increasing_id())
    found = minhash.near_duplicates(rows, doc_id=row, percent=NEAR_PERCENT)
    gone = tmp.cut(found.where("NOT kept").select(F.col("doc_id").alias(row)), "gone")
    return rows.join(gone.hint("merge"), row, "left_anti").select(docs.columns)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as its rate says."""
    return mixing.apply_mix(docs, table(spark, sf_dir, "labels"))


def packing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Where each piece of each document stands in the training sequences."""
    return packing.pack_documents(docs, tokenizer_path())


STAGES = [
    ("quality_rules", quality_rules_stage),
    ("quality_classifier", quality_classifier_stage),
    ("near_dedup", near_dedup_stage),
    ("mixing", mixing_stage),
    ("packing", packing_stage),
]

#: The classifier, the fit and the packing can't be written in SQL; tests hold each stage against a plain version.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the documents table, each written and read again. A stage's table goes when the next one's is written."""
    tmp, before = Scratch(spark, "pipeline"), None
    docs = table(spark, sf_dir, "documents")
    for name, stage in STAGES:
        docs = tmp.cut(stage(spark, docs, sf_dir), name)
        if before:
            tmp.drop(before)
        before = name
    return docs
