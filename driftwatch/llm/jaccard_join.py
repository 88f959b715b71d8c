"""N-gram Jaccard self-join by chosen paths.

A text's set is its runs of five words. For candidates a set is represented by a sketch of 64 sampled
shingles (the smallest by as many hash functions), and sets are split recursively: a path samples one
of the 64 places by its hash, and sets that have the same shingle there go on together. Buckets of at
most ``BUCKET`` sets are compared; larger ones are split again, twice over, so that a similar pair
survives each further split with high probability. Whole runs of this are repeated until the chance of
missing a pair at the similarity is below ``1 - recall``: with two samples at each further split a
pair at 0.8 survives any number of splits with 15 chances in 16, and the first with 0.8, so seven runs miss
fewer than one pair in ten thousand.

A bucket that hardly shrinks when split, or cannot be split further, holds mostly similar sets. It
becomes one candidate component as it is, and the exact comparison decides on each pair in it.

Links are then compared exactly on all shingles, and classes are components of exact links.

Edge cases: texts with fewer than five words, but not none, have one shingle of all of them; null and
empty texts have none, link to nothing and are a class of their own each. Null ids are below all others;
rows with equal ids are told apart by their texts. Rows repeated with id and text are copies of each
other, of which ``one_of_each`` keeps one. Other columns are not read and pass through it, whatever
their names. An empty table gives no rows.
"""

from __future__ import annotations

import math
from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from driftwatch.llm import sets as S
from driftwatch.session import pin

#: Share of a bucket that must not be left after a split.
DENSE = 0.7
#: Sketch places for each further split.
PLACES = 8
NO_ID = -(2**63)


def survival(similarity: float) -> float:
    """Chance that a pair survives all splits after the first, with two samples at each."""
    lost = 0.0
    for _ in range(200):
        lost = (1 - similarity + similarity * lost) ** 2
    return 1 - lost


def n_runs(similarity: float, recall: float) -> int:
    chance = max(similarity * survival(similarity), 1e-9)
    return math.ceil(math.log(1 - recall) / math.log(1 - chance))


def candidate_links(sets: DataFrame, similarity: float = 0.8, recall: float = 0.9999) -> DataFrame:
    """Candidate links of sets by chosen paths."""
    total = n_runs(similarity, recall)
    if total + PLACES > S.SKETCH:
        raise ValueError(f"A sketch of {S.SKETCH} entries is too small for {total} runs")
    first = F.array(*(F.xxhash64(F.lit(r), F.element_at("sketch", r + 1)) for r in range(total)))
    rows = sets.select("set_id", F.explode(first).alias("path"), F.lit(None).cast("long").alias("parent_size"))
    small, stars = [], []
    level = 0
    while True:
        sizes = rows.groupBy("path").agg(F.count(F.lit(1)).alias("size")).filter("size > 1")
        here = pin(rows.join(sizes, "path"))
        small.append(here.filter(f"size <= {S.BUCKET}").select("path", "set_id"))
        large = here.filter(f"size > {S.BUCKET}")
        base = total + PLACES * level
        if base + PLACES > S.SKETCH:
            stars.append(large.select("path", "set_id"))
            break
        dense = F.coalesce(F.col("size") > DENSE * F.col("parent_size"), F.lit(False))
        stars.append(large.filter(dense).select("path", "set_id"))
        large = large.filter(~dense)
        if not large.limit(1).count():
            break
        one = F.pmod(F.xxhash64("path", F.lit(1)), F.lit(PLACES))
        two = F.pmod(one + 1 + F.pmod(F.xxhash64("path", F.lit(2)), F.lit(PLACES - 1)), F.lit(PLACES))
        places = F.explode(F.array(one, two)).alias("place")
        split = large.join(sets.select("set_id", "sketch"), "set_id").select("set_id", "path", "size", "sketch", places)
        value = F.element_at("sketch", (F.col("place") + base + 1).cast("int"))
        rows = split.select("set_id", F.xxhash64("path", "place", value).alias("path"), F.col("size").alias("parent_size"))
        level += 1
    # Paths of all levels differ, so the buckets of all of them are compared in one operator.
    together = lambda parts: reduce(DataFrame.unionByName, parts)
    return S.bucket_edges(together(small), sets, S.candidate_share(similarity)).unionByName(S.star_edges(together(stars)))


def jaccard_classes(
    docs: DataFrame, doc_id: str = "doc_id", text: str = "text", similarity: float = 0.8, size: int = 5, recall: float = 0.9999
) -> DataFrame:
    """One row per document: ``id``, ``class_id`` (smallest id of its class), ``class_size``, ``n_links``."""
    found = S.classes(_units(docs, doc_id, text), lambda sets: candidate_links(sets, similarity, recall), size, similarity)
    ids = {n: F.when(F.col(f"{k}.id") != NO_ID, F.col(f"{k}.id")) for n, k in (("id", "key"), ("class_id", "class_key"))}
    return found.select(*(c.alias(n) for n, c in ids.items()), "class_size", "n_links")


def _key(doc_id: str, text: str) -> Column:
    """Rows with equal ids, or without one, are told apart by their texts."""
    return F.struct(F.coalesce(F.col(doc_id).cast("long"), F.lit(NO_ID)).alias("id"), F.xxhash64(text).alias("text"))


def _units(docs: DataFrame, doc_id: str, text: str) -> DataFrame:
    return docs.select(_key(doc_id, text).alias("key"), F.col(text).alias("text"))


def one_of_each(docs: DataFrame, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """One row of ``docs`` of each class, that with the smallest id (and, of equal ids, the smallest hash
    of its text). Rows without words stay. Any columns pass through."""
    found = pin(S.classes(_units(docs, doc_id, text), candidate_links).filter("class_size > 1"))
    drop = found.filter("key <> class_key").select("key").distinct()
    again = found.filter("key = class_key").groupBy("key").agg(F.count(F.lit(1)).alias("n")).filter("n > 1").select("key")
    held = docs.select(F.struct("*").alias("row"), _key(doc_id, text).alias("key"))
    stay = held.join(drop, "key", "left_anti")
    # Only rows repeated with id and text are shuffled to take one of them.
    once = stay.join(again, "key", "left_semi").dropDuplicates(["key"])
    return stay.join(again, "key", "left_anti").unionByName(once).select("row.*")
