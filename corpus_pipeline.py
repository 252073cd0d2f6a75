"""A corpus in five stages: quality, toxicity, near-duplicates, repeated paragraphs, packing.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame; run() writes each result as Parquet to the shared
folder and hands it to the next stage. All but the last return the columns of documents.
"""

from __future__ import annotations

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from tidemark.llm import near_documents, packing, paragraph_dedup, rule_ensemble, toxicity
from tidemark.llm.common import materialize, table
from tidemark.llm.queries import CUT, WORDS, ship


def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that the rule ensemble takes for good ones."""
    ship(spark)
    model = rule_ensemble.train(docs, table(spark, sf_dir, "labels"))
    return rule_ensemble.keep(docs, model, CUT)


def toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents that score below the cut for toxicity."""
    ship(spark)
    tagger = toxicity.train(docs, table(spark, sf_dir, "labels"))
    return toxicity.keep(docs, tagger, CUT)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each component of near-duplicates: five-word shingles, similarity 0.8 or more."""
    ship(spark)
    return near_documents.deduplicate(docs)


def repeated_paragraphs(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The documents without paragraphs that repeat earlier ones; n_chars follows the text."""
    ship(spark)
    return paragraph_dedup.deduplicate(docs).withColumn("n_chars", F.length("text").cast("long"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Every document's token pieces, placed in sequences."""
    ship(spark)
    return packing.pack(docs, public_tokenizers.path(WORDS))


STAGES = [
    ("quality classifier", quality),
    ("toxicity", toxic),
    ("SimHash near-dedup", near_duplicates),
    ("substring dedup", repeated_paragraphs),
    ("best-fit packing", pack),
]
#: SQL can express neither the trained stages nor the fingerprints.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = materialize(docs, "pipeline-" + name.replace(" ", "-"))
    return docs
