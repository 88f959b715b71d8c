"""Divergence of the sources of a language, by three-dimensional cube partitioning.

A group is a (lang, source) of documents, and a term a run of letters A-Z (lower-cased) and characters
beyond ASCII. Each language keeps the terms found in at least ``min_docs`` of its documents. A group
gives each kept term the share ``1 + floor(SCALE * (count + 2) / (N + 2 * V))``, with N its
occurrences of kept terms and V the number of them; two shares p and q diverge by
``floor((p - q) ** 2 / (p + q))``. All of it is integer arithmetic, hence exact in any order.

Group pairs are the work of a cube of cells: (group block, group block, term block) of one language.
A group's slice of a term block is replicated to the cells of its block's pairs; a cell fills in the
shares of terms that a group lacks, sums the divergence of each of its pairs, and sums are reduced
along the term axis. Terms that no group of a cell has are not sent; they add the divergence of the
two groups' least shares, times their number. A cell holds about ``GROUPS`` groups twice and
``TERMS`` terms, whatever the corpus holds, and its blocks go by hashes of names, so a source with a
third of all rows is as heavy in a cell as any other.

Counting: tasks count words of their own texts in chunks of ``CHUNK_BYTES`` and give up to ``HELD``
counts at a time, so that frequent words and large sources are summed before the shuffle.

Edge cases: null text, lang or source count as ''. Texts without a term count as documents without
one; their group still has pairs, with all its shares at the least. A language without kept terms has
divergences of 0 and no term rows. Repeated rows count each. Ties go by the name's UTF-8 bytes. An
empty table gives no rows. Other columns are not read.
"""

from __future__ import annotations

import re
from collections import Counter, defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.operators.joins import dimension_join
from driftwatch.session import pin

SCALE = 1_000_000_000
MIN_DOCS = 10
GROUPS, TERMS = 32, 4096
HELD, CHUNK_BYTES = 300_000, 8 << 20

_TERM = re.compile(rb"[a-z\x80-\xff]+")
_END = re.compile(rb"[^A-Za-z\x80-\xff]")
_COUNTS = "lang string, source string, term string, n long, docs long"
_PARTS = "lang string, source string, other string, value long, terms long, least long, other_least long, kept long"


def _chunks(text: bytes) -> Iterator[bytes]:
    """A text in pieces that no word crosses."""
    at = 0
    while at < len(text):
        cut = _END.search(text, at + CHUNK_BYTES) if len(text) - at > CHUNK_BYTES else None
        to = cut.start() if cut else len(text)
        yield text[at:to].lower()
        at = to


def term_counts(docs: DataFrame, text: str = "text", lang: str = "lang", source: str = "source") -> DataFrame:
    """``lang``, ``source``, ``term``, ``n`` (occurrences) and ``docs`` (documents with it)."""

    def emit(held: dict[tuple[str, str], tuple[Counter, Counter]]) -> pa.RecordBatch:
        keys = [(k, term) for k, (n, _) in held.items() for term in n]
        columns = [
            pa.array([k[0] for k, _ in keys], pa.string()),
            pa.array([k[1] for k, _ in keys], pa.string()),
            pa.array([term for _, term in keys], pa.binary()).cast(pa.string()),
            pa.array([c for n, _ in held.values() for c in n.values()], pa.int64()),
            pa.array([d[term] for n, d in held.values() for term in n], pa.int64()),
        ]
        return pa.RecordBatch.from_arrays(columns, ["lang", "source", "term", "n", "docs"])

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held = defaultdict(lambda: (Counter(), Counter()))
        size = 0
        for batch in batches:
            texts = batch.column(2).cast(pa.binary())
            for k, key in enumerate(zip(batch.column(0).to_pylist(), batch.column(1).to_pylist())):
                n, docs = held[key]
                before = len(n)
                seen = set()
                for chunk in _chunks(texts[k].as_py()):
                    words = _TERM.findall(chunk)
                    n.update(words)
                    seen.update(words)
                docs.update(seen)
                size += len(n) - before
                if size >= HELD:
                    yield emit(held)
                    held.clear()
                    size = 0
        yield emit(held)

    rows = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source), ("text", text))))
    return rows.mapInArrow(run, _COUNTS).groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs"))


def _share(count: Column, total: Column, kept: Column) -> Column:
    wide = "decimal(20,0)"
    whole = F.call_function("div", F.lit(SCALE).cast(wide) * (count + 2).cast(wide), (total + 2 * kept).cast(wide))
    return F.when(kept > 0, whole.cast("long") + 1)


def _divergence(p: Column, q: Column) -> Column:
    return F.call_function("div", (p - q) * (p - q), p + q)


def _cell(key: tuple[pa.Scalar, ...], rows: pa.Table) -> pa.Table:
    """Sums of a cell: a row per pair of its groups. Rows without a term list the groups."""
    lang, low, high = key[0].as_py(), key[1].as_py(), key[2].as_py()
    marks = rows.filter(rows["term"].is_null())
    sources = marks["source"].to_pylist()
    least, kept = marks["share"].to_numpy(), marks["kept"].to_pylist()
    block = marks["block"].to_numpy()
    place = {s: k for k, s in enumerate(sources)}
    found = rows.filter(rows["term"].is_valid())
    terms = found["term"].combine_chunks().dictionary_encode()
    shares = np.repeat(np.where(kept, least, 0)[:, None], len(terms.dictionary), 1)
    owner = np.array([place[s] for s in found["source"].to_pylist()], np.int64)
    shares[owner, terms.indices.to_numpy()] = found["share"].to_numpy()
    left = np.flatnonzero(block == low)
    right = np.flatnonzero(block == high)
    out = [[] for _ in range(8)]
    for a in left:
        others = right if low != high else right[right > a]
        d = shares[others] - shares[a]
        sums = (d * d // (shares[others] + shares[a])).sum(1) if shares.shape[1] else np.zeros(len(others), np.int64)
        for b, value in zip(others.tolist(), sums.tolist()):
            made = (lang, sources[a], sources[b], value, shares.shape[1], least[a], least[b], kept[a])
            for o, v in zip(out, made):
                o.append(v)
    kinds = [pa.string()] * 3 + [pa.int64()] * 5
    names = ["lang", "source", "other", "value", "terms", "least", "other_least", "kept"]
    return pa.table([pa.array(o, k) for o, k in zip(out, kinds)], names)


def _pairs(groups: DataFrame, shares: DataFrame) -> DataFrame:
    """``lang``, ``source``, ``other``, ``value`` of each pair of groups, in both directions."""
    term_block = F.pmod(F.xxhash64("term"), F.col("term_blocks"))
    marks = groups.select(
        "lang",
        "source",
        F.lit(None).cast("string").alias("term"),
        F.coalesce("least", F.lit(0)).cast("long").alias("share"),
        "kept",
        "block",
        "blocks",
        F.explode(F.sequence(F.lit(0).cast("long"), F.col("term_blocks") - 1)).alias("term_block"),
    )
    rows = shares.select("lang", "source", "term", "share", "kept", "block", "blocks", term_block.alias("term_block"))
    rows = rows.unionByName(marks)
    rows = rows.withColumn("to", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    rows = rows.withColumns({"low": F.least("block", "to"), "high": F.greatest("block", "to")})
    cells = rows.groupBy("lang", "low", "high", "term_block").applyInArrow(_cell, _PARTS)
    sums = cells.groupBy("lang", "source", "other").agg(
        F.sum("value").alias("value"), F.sum("terms").alias("terms"), *(F.max(c).alias(c) for c in ("least", "other_least", "kept"))
    )
    rest = F.when(F.col("kept") > 0, (F.col("kept") - F.col("terms")) * _divergence(F.col("least"), F.col("other_least"))).otherwise(0)
    both = F.array(F.struct("source", F.col("other").alias("item")), F.struct(F.col("other").alias("source"), F.col("source").alias("item")))
    out = sums.select("lang", (F.col("value") + rest).alias("value"), F.explode(both).alias("pair"))
    return out.select("lang", "pair.source", "pair.item", "value")


def source_divergence(
    docs: DataFrame, min_docs: int = MIN_DOCS, top_terms: int = 10, text: str = "text", lang: str = "lang", source: str = "source"
) -> DataFrame:
    """``lang``, ``source``, ``part``, ``item``, ``value``, ``rank``.

    Part ``pair``: every other source of the language, by divergence over all kept terms. Part
    ``term``: the ``top_terms`` terms by which the group stands out most above its language.
    """
    counts = pin(term_counts(docs, text, lang, source))
    # A term has at most as many rows as its language has sources.
    of_term = Window.partitionBy("lang", "term")
    kept = counts.select(
        "lang",
        "source",
        "term",
        "n",
        F.sum("docs").over(of_term).alias("docs"),
        F.sum("n").over(of_term).alias("lang_n"),
        F.row_number().over(of_term.orderBy("source")).alias("place"),
    )
    kept = pin(kept.filter(F.col("docs") >= min_docs).drop("docs"))
    langs = kept.filter("place = 1").groupBy("lang").agg(F.count(F.lit(1)).alias("kept"), F.sum("lang_n").alias("lang_total"))
    totals = kept.groupBy("lang", "source").agg(F.sum("n").alias("total"))
    names = docs.select(*(F.coalesce(F.col(c).cast("string"), F.lit("")).alias(n) for n, c in (("lang", lang), ("source", source)))).distinct()
    langs = names.groupBy("lang").agg(F.count(F.lit(1)).alias("groups")).join(langs, "lang", "left").fillna(0)
    groups = dimension_join(names.join(totals, ["lang", "source"], "left").fillna(0), langs, ["lang"], ["source"])
    long = lambda c: F.ceil(c).cast("long")
    groups = groups.withColumns(
        {
            "least": _share(F.lit(0), F.col("total"), F.col("kept")),
            "blocks": long(F.col("groups") / GROUPS),
            "term_blocks": F.greatest(long(F.col("kept") / TERMS), F.lit(1)),
        }
    )
    groups = pin(groups.withColumn("block", F.pmod(F.xxhash64("source"), F.col("blocks"))))
    shares = dimension_join(kept.drop("place"), groups.drop("groups", "least"), ["lang", "source"], ["term"])
    shares = shares.withColumns(
        {
            "share": _share(F.col("n"), F.col("total"), F.col("kept")),
            "lang_share": _share(F.col("lang_n"), F.col("lang_total"), F.col("kept")),
        }
    )
    shares = pin(shares)
    order = Window.partitionBy("lang", "source").orderBy(F.desc("value"), "item")
    rank = F.row_number().over(order)
    pairs = _pairs(groups, shares).select("lang", "source", F.lit("pair").alias("part"), "item", "value", rank.alias("rank"))
    above = shares.filter("n > 0 AND share > lang_share")
    above = above.select("lang", "source", F.col("term").alias("item"), _divergence(F.col("share"), F.col("lang_share")).alias("value"))
    terms = above.withColumn("rank", rank).filter(F.col("rank") <= top_terms)
    return pairs.unionByName(terms.select("lang", "source", F.lit("term").alias("part"), "item", "value", "rank"))
