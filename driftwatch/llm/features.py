"""Hashed text features and bounded labelled samples for the classifiers."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.textops import ALNUM, BASE, LOWER, SOLID, Words, mix, unique_pairs

#: Kinds of bytes in a word's shape: capital, small letter or beyond ASCII, digit, each other byte.
SHAPE = np.arange(256, dtype=np.uint8)
SHAPE[65:91], SHAPE[97:123], SHAPE[128:], SHAPE[48:58] = 65, 97, 97, 48


def shape_words(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of the shapes of white-space separated words (runs of one kind as one), and offsets."""
    plain = Words(texts, SOLID, lower=False)
    kinds = SHAPE[plain.data]
    keep = np.ones(len(kinds), bool)
    keep[1:] = kinds[1:] != kinds[:-1]
    keep[plain.starts] = True
    place = np.concatenate([[0], np.cumsum(keep)])
    plain.data = kinds[keep]
    return plain.hash_spans(place[plain.starts], place[plain.ends]), plain.first


def grams(words: np.ndarray, first: np.ndarray, size: int, salt: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words within texts, and the text of each."""
    doc = np.repeat(np.arange(len(first) - 1), np.diff(first))
    n = max(0, len(words) - size + 1)
    total = np.full(n, salt, np.uint64)
    for k in range(size):
        total = total * np.uint64(BASE) + words[k : k + n]
    inside = doc[:n] == doc[size - 1 :] if n else np.zeros(0, bool)
    return mix(total[inside]), doc[:n][inside]


def ngram_features(texts: pa.Array, bits: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, feature) pairs: words and pairs of words in lower case, and runs of up to
    three word shapes, and repeats of a word in a row, hashed to ``bits`` bits."""
    words = Words(texts, ALNUM)
    hashes = words.hashes()
    shapes, at = shape_words(texts)
    parts = [grams(hashes, words.first, n, n) for n in (1, 2)] + [grams(shapes, at, n, 10 + n) for n in (1, 2, 3)]
    same = hashes[1:] == hashes[:-1]
    for n in (1, 2, 3):  # words said over and over, whatever they are
        run = np.logical_and.reduce([same[k : len(same) - n + 1 + k] for k in range(n)]) if len(same) >= n else same[:0]
        doc = words.doc[: len(run)]
        run = run & (doc == words.doc[n:])
        parts.append((mix(np.full(run.sum(), 20 + n, np.uint64)), doc[run]))
    feature = np.concatenate([p[0] for p in parts]) >> np.uint64(64 - bits)
    doc = np.concatenate([p[1] for p in parts])
    return unique_pairs(doc, feature.astype(np.int64))


def prefix_features(texts: pa.Array, lengths: tuple[int, ...] = (4, 5, 6)) -> tuple[np.ndarray, np.ndarray]:
    """(text, feature) of every word in lower case and of the first bytes of longer words."""
    words = Words(texts, ALNUM)
    doc = words.doc
    hashes, docs = [words.hashes()], [doc]
    for n in lengths:
        long = words.ends - words.starts > n
        start = words.starts[long]
        hashes.append(mix(words.hash_spans(start, start + n) + np.uint64(n)))
        docs.append(doc[long])
    return np.concatenate(docs), np.concatenate(hashes)


def labelled_sample(docs: DataFrame, labels: DataFrame, label: str, train, max_rows: int, text: str = "text") -> DataFrame:
    """Texts with their label, of documents that satisfy ``train``; about ``max_rows`` of them, by the
    hash of their id, or all where fewer are labelled. Rows without id or label teach nothing. Of rows
    with one id a single text counts, that with the smallest hash, so the sample is bounded in rows too.

    The ids of the sample are broadcast: their number is bounded by ``max_rows``.
    """
    known = labels.select(F.col("doc_id").cast("long").alias("doc_id"), F.col(label).cast("int").alias("label"))
    known = known.filter(F.col("doc_id").isNotNull() & F.col("label").isNotNull()).filter(train)
    known = known.groupBy("doc_id").agg(F.max("label").alias("label"))
    total = known.count()
    if total > max_rows:
        chance = F.pmod(F.xxhash64("doc_id", F.lit(11)), F.lit(1 << 30)) / float(1 << 30)
        known = known.filter(chance < max_rows / total)
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    found = keyed.join(F.broadcast(known), "doc_id").groupBy("doc_id", "label")
    return found.agg(F.min_by("text", F.struct(F.xxhash64("text"), F.octet_length("text"))).alias("text")).select("text", "label")


def sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -60, 60)))
