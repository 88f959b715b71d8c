"""Toxicity by weak supervision.

1. A lexicon is mined from labelled training rows: words, and beginnings of words, that come much more
   often in toxic texts. Counts are taken by Spark; the ``LEXICON`` strongest entries are collected.
2. Each entry is a voter that votes toxic where it occurs and abstains elsewhere. Pattern voters look at
   a text as a whole: many different entries vote toxic, a high share of entries votes toxic, and no
   entry at all votes clean.
3. A generative label model finds each voter's rates among toxic and clean texts from the votes alone,
   by expectation maximisation, with the lexicon as its start. Voters that still agree given the class are
   correlated; their evidence is divided by the strength of their group, so that an entry
   that only repeats others counts little. Posterior labels follow.
4. A linear (logistic) classifier on entries and patterns is trained on the posterior labels, and scores
   whole texts.

Samples are bounded: ``max_rows`` labelled rows for the lexicon and ``max_rows`` rows for the
label model and the classifier.

Edge cases: null and empty texts have no votes but the clean one. Where no entry is found, as
without labels, every text gets the share of toxic labels, or 0 without labels. Repeated rows get equal results. Other
columns are not read.
"""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from driftwatch.llm.features import prefix_features, sigmoid
from driftwatch.llm.textops import ALNUM, Words, annotate, slices, unique_pairs

LEXICON = 512
MAX_ROWS = 8000
MIN_TEXTS = 4
MIN_RATIO = 40.0


@dataclass
class Model:
    entries: np.ndarray  # hashes, sorted
    weights: np.ndarray  # of entries, then of the pattern voters
    constant: float


def mine_lexicon(sample: DataFrame, size: int = LEXICON) -> tuple[list[int], list[float], float]:
    """Hashes and log ratios of the strongest entries, and the share of toxic rows.

    Copies count once: texts are reduced to distinct ones first.
    """
    once = sample.groupBy(F.xxhash64("text").alias("h"), "label").agg(F.first("text").alias("text"))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                label = part.column("label").to_numpy()
                doc, value = unique_pairs(*prefix_features(part.column("text")))
                value, at = np.unique(value, return_inverse=True)
                toxic = np.bincount(at, label[doc], len(value)).astype(np.int64)
                clean = np.bincount(at, 1 - label[doc], len(value)).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(value.view(np.int64)), pa.array(toxic), pa.array(clean)], ["entry", "toxic", "clean"])

    counts = once.mapInArrow(run, "entry long, toxic long, clean long").groupBy("entry")
    counts = counts.agg(F.sum("toxic").alias("toxic"), F.sum("clean").alias("clean"))
    n = once.agg(F.sum("label").alias("toxic"), F.sum(1 - F.col("label")).alias("clean")).first()
    toxic, clean = n["toxic"] or 0, n["clean"] or 0
    ratio = F.log(((F.col("toxic") + 0.5) / (toxic + 1)) / ((F.col("clean") + 0.5) / (clean + 1)))
    gain = F.col("toxic") * F.col("ratio")
    best = counts.filter(F.col("toxic") >= MIN_TEXTS).withColumn("ratio", ratio).filter(F.col("ratio") >= float(np.log(MIN_RATIO)))
    rows = best.orderBy(gain.desc(), "entry").limit(size).collect()
    return [r["entry"] for r in rows], [r["ratio"] for r in rows], toxic / max(1, toxic + clean)


def votes(texts: pa.Array, entries: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Presence of entries by text (text, entry number), and pattern votes: several entries, a high
    share of entries among words, no entry."""
    doc, value = prefix_features(texts)
    at = np.minimum(np.searchsorted(entries, value), max(0, len(entries) - 1))
    hit = entries[at] == value if len(entries) else np.zeros(len(value), bool)
    words = Words(texts, ALNUM).counts
    hits = np.bincount(doc[hit], minlength=len(texts))
    d, e = unique_pairs(doc[hit], at[hit])
    kinds = np.bincount(d, minlength=len(texts))
    patterns = np.stack([kinds >= 3, hits >= np.maximum(2, 0.005 * words), kinds == 0], 1)
    return np.stack([d, e], 1), patterns.astype(np.float64)


def label_model(matrix: np.ndarray, start: np.ndarray, prior: float, rounds: int = 50) -> np.ndarray:
    """Posterior chance of toxic for each row of a 0/1 vote matrix.

    ``start``: first guess of the posteriors. Rates are smoothed; correlations given the class divide the evidence
    of the voters that share it.
    """
    posterior = start.copy()
    share = np.ones(matrix.shape[1])
    for step in range(rounds):
        toxic, clean = posterior.sum(), (1 - posterior).sum()
        yes = (matrix.T @ posterior + 0.1) / (toxic + 0.2)
        no = (matrix.T @ (1 - posterior) + 0.01) / (clean + 0.2)
        if step % 10 == 0:
            share = 1 / correlation_strength(matrix, posterior, yes, no)
        prior = np.clip(toxic / len(posterior), 0.005, 0.6)
        fired, silent = np.log(yes / no) * share, np.log((1 - yes) / (1 - no)) * share
        new = sigmoid(np.log(prior / (1 - prior)) + matrix @ fired + (1 - matrix) @ silent)
        if np.abs(new - posterior).max() < 1e-6:
            return new
        posterior = new
    return posterior


def correlation_strength(matrix: np.ndarray, posterior: np.ndarray, yes: np.ndarray, no: np.ndarray) -> np.ndarray:
    """Number of voters that each voter stands for: the sum of its correlations given the class."""
    rest = matrix - (posterior[:, None] * yes + (1 - posterior)[:, None] * no)
    scale = np.sqrt((rest * rest).sum(0)) + 1e-9
    related = np.abs(rest.T @ rest / np.outer(scale, scale))
    return np.where(related >= 0.3, related, 0).sum(1).clip(1)


def fit(sample: DataFrame, size: int = LEXICON) -> Model:
    """Model from a bounded sample of ``text`` and ``label``."""
    mined, ratios, prior = mine_lexicon(sample, size)
    order = np.argsort(np.array(mined, np.int64).view(np.uint64))
    entries = np.array(mined, np.int64).view(np.uint64)[order]
    if not len(entries):
        return Model(entries, np.zeros(3), float(np.log(max(prior, 1e-6) / max(1 - prior, 1e-6))))
    sent = sample.sparkSession.sparkContext.broadcast(entries)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, "text"):
                pairs, patterns = votes(part.column("text"), sent.value)
                at = np.searchsorted(pairs[:, 0], np.arange(part.num_rows + 1))
                lists = [pairs[s:e, 1].astype("<i4").tobytes() for s, e in zip(at[:-1], at[1:])]
                flags = (patterns @ np.array([1, 2, 4])).astype(np.int64)
                yield pa.RecordBatch.from_arrays([pa.array(lists, pa.binary()), pa.array(flags)], ["entries", "flags"])

    rows = sample.select("text").mapInArrow(run, "entries binary, flags long").collect()
    rows.sort(key=lambda r: (bytes(r["entries"]), r["flags"]))
    matrix = np.zeros((len(rows), len(entries) + 3))
    for i, r in enumerate(rows):
        matrix[i, np.frombuffer(r["entries"], "<i4")] = 1
        matrix[i, len(entries) :] = [r["flags"] & 1, r["flags"] >> 1 & 1, r["flags"] >> 2 & 1]
    evidence = matrix[:, : len(entries)] @ np.array(ratios)[order]
    posterior = label_model(matrix, np.where(evidence > 0, 0.9, 0.02), prior)
    weights, constant = logistic(matrix, posterior)
    return Model(entries, weights, constant)


def logistic(x: np.ndarray, target: np.ndarray, penalty: float = 1e-3, rounds: int = 400, rate: float = 0.5) -> tuple[np.ndarray, float]:
    """Weights and constant of a logistic model of soft labels; classes weigh alike."""
    toxic = max(target.sum(), 1e-6)
    weight = np.where(target > 0.5, 0.5 / toxic, 0.5 / max(len(target) - toxic, 1e-6))
    w, b = np.zeros(x.shape[1]), 0.0
    square, square_b = np.full(x.shape[1], 1e-8), 1e-8
    for _ in range(rounds):
        error = weight * (sigmoid(x @ w + b) - target)
        g, gb = x.T @ error + penalty * w / x.shape[1], error.sum()
        square += g * g
        square_b += gb * gb
        w -= rate * g / np.sqrt(square)
        b -= rate * gb / np.sqrt(square_b)
    return w, float(b)


def score(docs: DataFrame, model: Model, keep: list[str], text: str = "text", name: str = "score") -> DataFrame:
    """``keep`` columns with the chance that the text is toxic."""
    sent = docs.sparkSession.sparkContext.broadcast(model)

    def work(texts: pa.Array) -> list[pa.Array]:
        m = sent.value
        pairs, patterns = votes(texts, m.entries)
        n = len(m.entries)
        total = np.bincount(pairs[:, 0], m.weights[pairs[:, 1]], len(texts)) + patterns @ m.weights[n:] + m.constant
        return [pa.array(sigmoid(total), pa.float64())]

    return annotate(docs, text, keep, StructType([StructField(name, DoubleType())]), work)
