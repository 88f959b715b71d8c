"""Queries of the package's operators over the test tables."""

from __future__ import annotations

import os
from collections.abc import Callable
from pathlib import Path

import driftwatch
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from driftwatch.llm import (
    bpe,
    decontaminate,
    divergence,
    exact_dedup,
    features,
    hard_negatives,
    jaccard_join,
    langid,
    lm,
    packing,
    paragraph_dedup,
    quality,
    toxicity,
    warc,
)
from driftwatch.llm.textops import held_out
from driftwatch.session import run_dir


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    """A test table. Tasks of local sessions find the package where the driver found it; on a cluster
    it is installed or sent along with ``--py-files``."""
    root = str(Path(driftwatch.__file__).resolve().parent.parent)
    known = spark.sparkContext.environment.get("PYTHONPATH", os.environ.get("PYTHONPATH", ""))
    if root not in known.split(os.pathsep):
        spark.sparkContext.environment["PYTHONPATH"] = os.pathsep.join(filter(None, [root, known]))
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def default_tokenizer() -> str:
    import public_tokenizers

    return public_tokenizers.path("word_bpe_49k.json")


def _predicted(least: float) -> Column:
    return (F.col("score") >= least).cast("int")


def op1_ngram_jaccard_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = jaccard_join.jaccard_classes(table(spark, sf_dir, "documents"))
    return found.withColumnRenamed("id", "doc_id")


def op2_language_id(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    dictionaries = langid.fit(docs.filter(~out))
    found = langid.predict(docs, dictionaries, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "lang_pred", "score", "rejected")


def op3_warc(spark: SparkSession, sf_dir: str) -> DataFrame:
    folder = f"{run_dir(spark)}/warc"
    where = folder if "://" in folder or folder.startswith("/") else folder.replace("file:", "", 1)
    index = warc.write(table(spark, sf_dir, "pages"), where)
    columns = ["page_id", "payload_bytes", "payload_digest", "record_type", "refers_to", "intact"]
    return warc.read(index, where, columns).select(*columns)


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return packing.pack_documents(table(spark, sf_dir, "documents"), default_tokenizer())


def op5_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 5, 0)
    sample = features.labelled_sample(docs, table(spark, sf_dir, "labels"), "toxic", ~out, toxicity.MAX_ROWS)
    found = toxicity.score(docs, toxicity.fit(sample), ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "score", _predicted(0.5).alias("predicted"))


def op6_decontamination(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents").select("doc_id", "text")
    marked = decontaminate.mark(docs, table(spark, sf_dir, "benchmark"))
    hits = F.aggregate("__spans", F.lit(0).cast("long"), lambda n, s: n + s["end"] - s["start"])
    ids = F.array_join(F.array_sort(F.transform("__items", lambda i: i.cast("string"))), ",")
    return marked.select(
        "doc_id",
        F.col("__words").alias("n_words"),
        hits.alias("n_hit"),
        F.size("__items").cast("long").alias("n_items"),
        F.sha2(ids, 256).alias("items_sha256"),
        (hits > 0).alias("contaminated"),
    )


def op7_paragraph_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = paragraph_dedup.repeated_passages(table(spark, sf_dir, "documents"))
    return found.withColumnsRenamed({"id": "doc_id", "class_id": "class_doc_id"}).drop("text_hash")


def op8_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    with exact_dedup.DigestIndex(spark, f"{run_dir(spark)}/digests") as index:
        rows = index.add(table(spark, sf_dir, "documents"), batch="documents")
    return rows.select(
        F.col("id").alias("doc_id"),
        "keep_id",
        F.col("copies").alias("group_size"),
        "kept",
        F.lower(F.hex("digest")).alias("text_sha256"),
    )


def op9_quality(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    out = held_out("doc_id", 4, 2)
    sample = features.labelled_sample(docs, table(spark, sf_dir, "labels"), "quality", ~out, quality.MAX_ROWS)
    model, ratios = quality.fit(sample, boundary=0.7)
    found = quality.score(docs, model, ratios, ["doc_id"])
    return found.select("doc_id", out.alias("held_out"), "score", _predicted(0.7).alias("predicted"))


def op10_lm_scoring(spark: SparkSession, sf_dir: str) -> DataFrame:
    out = held_out("doc_id", 7, 2)
    found, counts = lm.fit_and_score(table(spark, sf_dir, "documents"), ~out)
    return found.select(
        "doc_id",
        out.alias("held_out"),
        "n_tokens",
        "n_known",
        F.lit(counts.total).cast("long").alias("train_tokens"),
        "base_score",
        "score",
    )


def op11_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    encoded = bpe.encode(table(spark, sf_dir, "documents"), default_tokenizer(), ["doc_id"])
    decoded = bpe.decode(encoded, default_tokenizer(), ["doc_id", "ids"])
    return decoded.select(
        "doc_id",
        F.size("ids").cast("long").alias("n_tokens"),
        F.sha2(F.array_join(F.col("ids").cast("array<string>"), " "), 256).alias("ids_sha256"),
        F.sha2("decoded", 256).alias("decoded_sha256"),
    )


def op12_hard_negatives(spark: SparkSession, sf_dir: str) -> DataFrame:
    label = F.when(F.col("vec_id") % 7 == 0, (F.col("label") + 1) % 10).otherwise(F.col("label"))
    indexed = hard_negatives.index(table(spark, sf_dir, "embeddings"), label=label)
    return hard_negatives.mine(indexed, F.col("vec_id") % 100 == 0)


def op13_divergence(spark: SparkSession, sf_dir: str) -> DataFrame:
    return divergence.source_divergence(table(spark, sf_dir, "documents"))


QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {
    f.__name__: f
    for f in (
        op1_ngram_jaccard_join,
        op2_language_id,
        op3_warc,
        op4_packing,
        op5_toxicity,
        op6_decontamination,
        op7_paragraph_dedup,
        op8_exact_dedup,
        op9_quality,
        op10_lm_scoring,
        op11_bpe,
        op12_hard_negatives,
        op13_divergence,
    )
}
