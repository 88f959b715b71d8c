"""Cleaning and packing of the test documents, stage by stage.

Each stage is written as Parquet to the shared folder and read again as the next one's documents. Stages fit what they
need on their own input: the toxicity classifier on labelled documents, the rest on all of them.
A document that a stage drops is dropped for good.

All stages take nulls in any column, empty and very long texts, repeated rows and ids, empty tables and
further columns of any name. The first four return the columns they are given, rows unchanged.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import decontaminate, exact_dedup, features, jaccard_join, packing, toxicity
from driftwatch.llm.queries import default_tokenizer, table
from driftwatch.llm.textops import held_out
from driftwatch.session import pin


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the weakly supervised classifier doesn't call toxic. Labels of the fold that
    ``op5_toxicity`` holds out aren't used here either.

    Null and empty texts are judged like texts without a listed word, and stay wherever such texts are mostly
    clean; rows are judged one by one, so repeated ones share their fate. Without labels no
    document is called toxic.
    """
    labels = table(spark, sf_dir, "labels")
    sample = features.labelled_sample(docs, labels, "toxic", ~held_out("doc_id", 5, 0), toxicity.MAX_ROWS)
    held = docs.select(F.struct("*").alias("row"), "text")
    return toxicity.score(held, toxicity.fit(sample), ["row"], name="toxic").filter("toxic < 0.5").select("row.*")


def drop_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of equal texts (A-Z and a-z alike; null equals empty): that with the
    largest id, null being below all; of rows repeated with id and text, one."""
    return exact_dedup.distinct_documents(docs)


def drop_near_copies(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of each group of near-equal texts: that with the smallest id, null being below all, and
    of equal ids that with the smaller hash of its text. Texts without a word, null ones too, stay."""
    return jaccard_join.one_of_each(docs)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents in which no window of a test string occurs. Null and empty texts stay, and so does every
    copy of a clean document; without test strings all stay."""
    return decontaminate.clean_documents(docs, table(spark, sf_dir, "benchmark"))


def pack(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Pieces of the documents left, with their place in sequences of 2048 tokens. A null text is an empty
    one, of one token; every row is packed, repeated ones too, with its id as it is."""
    return packing.pack_documents(docs, default_tokenizer())


STAGES = [
    ("toxicity", drop_toxic),
    ("exact dedup", drop_copies),
    ("n-gram Jaccard join", drop_near_copies),
    ("benchmark decontamination", drop_leaks),
    ("packing", pack),
]

#: The first stage is a trained classifier and the last a tokenizer, which SQL can't express.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    for _, stage in STAGES:
        docs = pin(stage(spark, docs, sf_dir))
    return docs
