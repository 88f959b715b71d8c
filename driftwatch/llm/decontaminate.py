"""Benchmark decontamination by Wu-Manber search over words.

Texts and test strings are sequences of words: A-Z is lower-cased, and words are runs of digits,
letters a-z and characters beyond ASCII. A pattern is a window of ``size`` consecutive words of a
test string; a shorter string, if it has a word, is one window. Patterns of equal length are searched
together, with words as the symbols of the Wu-Manber algorithm:

* a shift table tells from the block of two words under the cursor how far the cursor can move
  without missing an occurrence; a block that is in no pattern moves it past nearly a whole pattern;
* where the shift is nought, the hash of the block selects the patterns that end in it;
* the candidates are compared, first by word hashes, then byte by byte.

All cursors of a slice of texts move at once as numpy arrays.

The test strings are sent to the tasks in parts of about ``PART_BYTES``, one after the other: what one
part has marked is written before the next is sent, and each process compiles a part once and holds
no other. So memory is bounded by a part, however long the benchmark is.

Edge cases: null or empty texts have no words, no hits and are not contaminated. Test strings that
are null or have no words give no pattern. A test string without id marks words, but names no item.
Equal test strings each name their item; repeated rows of documents each get their own row.
"""

from __future__ import annotations

import uuid
from collections import defaultdict
from collections.abc import Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StructField, StructType

from driftwatch.llm.textops import ALNUM, BASE, Words, mix, slices
from driftwatch.session import pin

PART_BYTES = 32 << 20
SEGMENT = 512
SPAN = ArrayType(StructType([StructField("start", LongType()), StructField("end", LongType())]))


class Patterns:
    """Windows of one length with their shift table and suffix buckets."""

    def __init__(self, windows: dict[tuple[bytes, ...], set], length: int) -> None:
        self.length, self.block = length, min(2, length)
        self.texts = [b" ".join(w) for w in windows]
        self.items = list(windows.values())
        flat = Words(pa.array(self.texts, pa.binary()), ALNUM, lower=False)
        self.hashes = flat.hashes().reshape(len(windows), length)
        bits = max(12, int(np.ceil(np.log2(16 * length * len(windows)))))
        self.drop = np.uint64(64 - bits)
        self.shift = np.full(1 << bits, length - self.block + 1, np.int64)
        for end in range(self.block, length + 1):
            np.minimum.at(self.shift, self.slot(self.hashes, end - 1), length - end)
        slots = self.slot(self.hashes, length - 1)
        self.order = np.argsort(slots, kind="stable")
        self.first = np.searchsorted(slots[self.order], np.arange((1 << bits) + 1))

    def slot(self, hashes: np.ndarray, last: int | np.ndarray) -> np.ndarray:
        """Table places of the blocks that end at word ``last``."""
        end = hashes[..., last] if isinstance(last, int) else hashes[last]
        if self.block == 2:
            before = hashes[..., last - 1] if isinstance(last, int) else hashes[last - 1]
            end = mix(before * np.uint64(BASE) + end)
        return (end >> self.drop).astype(np.int64)

    def search(self, words: Words, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Last word and pattern number of each occurrence."""
        starts, stops = words.first[:-1] + self.length - 1, words.first[1:]
        full = starts < stops
        starts, stops = starts[full], stops[full]
        parts = -(-(stops - starts) // SEGMENT)
        step = np.arange(parts.sum()) - np.repeat(np.cumsum(parts) - parts, parts)
        at = np.repeat(starts, parts) + step * SEGMENT
        stop = np.minimum(at + SEGMENT, np.repeat(stops, parts))
        found_at, found = [], []
        while len(at):
            slot = self.slot(hashes, at)
            shift = self.shift[slot]
            zero = np.flatnonzero(shift == 0)
            if len(zero):
                low = self.first[slot[zero]]
                many = self.first[slot[zero] + 1] - low
                place = np.repeat(low - (np.cumsum(many) - many), many) + np.arange(many.sum())
                pattern, where = self.order[place], np.repeat(at[zero], many)
                same = np.ones(len(where), bool)
                for k in range(self.length):
                    same &= hashes[where - k] == self.hashes[pattern, self.length - 1 - k]
                found_at.append(where[same])
                found.append(pattern[same])
            at = at + np.maximum(shift, 1)
            on = at < stop
            at, stop = at[on], stop[on]
        if not found:
            return np.zeros(0, np.int64), np.zeros(0, np.int64)
        where, pattern = np.concatenate(found_at), np.concatenate(found)
        sure = np.array([self._equal(words, w, p) for w, p in zip(where, pattern)], bool)
        return where[sure], pattern[sure]

    def _equal(self, words: Words, last: int, pattern: int) -> bool:
        span = slice(last - self.length + 1, last + 1)
        text = b" ".join(words.data[s:e].tobytes() for s, e in zip(words.starts[span], words.ends[span]))
        return text == self.texts[pattern]


def compile_patterns(items: list[tuple[int | None, str | None]], size: int) -> list[Patterns]:
    """Patterns of test strings (id, text), by length."""
    by_length: dict[int, dict[tuple[bytes, ...], set]] = defaultdict(lambda: defaultdict(set))
    for item, text in items:
        words = Words(pa.array([text], pa.string()), ALNUM)
        seen = [words.data[s:e].tobytes() for s, e in zip(words.starts, words.ends)]
        length = min(size, len(seen))
        for k in range(len(seen) - length + 1 if length else 0):
            by_length[length][tuple(seen[k : k + length])].add(item)
    return [Patterns(windows, length) for length, windows in sorted(by_length.items())]


def find(texts: pa.Array, patterns: list[Patterns]) -> tuple[np.ndarray, list[list[dict]], list[list[int]]]:
    """Number of words, merged spans of hit words (start, end without it) and items of each text."""
    words = Words(texts, ALNUM)
    hashes = words.hashes()
    edge = np.zeros(len(hashes) + 1, np.int64)
    items: list[set] = [set() for _ in range(words.n_docs)]
    any_hit = False
    for p in patterns:
        last, pattern = p.search(words, hashes)
        any_hit |= len(last) > 0
        np.add.at(edge, last - p.length + 1, 1)
        np.add.at(edge, last + 1, -1)
        docs = np.searchsorted(words.first, last, "right") - 1
        for d, k in zip(docs, pattern):
            items[d] |= p.items[k]
    spans: list[list[dict]] = [[] for _ in range(words.n_docs)]
    if any_hit:
        hit = np.cumsum(edge[:-1]) > 0
        doc = words.doc
        before, after = np.zeros_like(hit), np.zeros_like(hit)
        before[1:] = hit[:-1] & (doc[1:] == doc[:-1])
        after[:-1] = hit[1:] & (doc[1:] == doc[:-1])
        for s, e in zip(np.flatnonzero(hit & ~before), np.flatnonzero(hit & ~after) + 1):
            d = doc[s]
            spans[d].append({"start": s - words.first[d], "end": e - words.first[d]})
    return words.counts, spans, [sorted(i for i in s if i is not None) for s in items]


def merge_spans(a: list[dict], b: list[dict]) -> list[dict]:
    out: list[dict] = []
    for s in sorted([*a, *b], key=lambda s: s["start"]):
        if out and s["start"] <= out[-1]["end"]:
            out[-1] = {"start": out[-1]["start"], "end": max(out[-1]["end"], s["end"])}
        else:
            out.append(dict(s))
    return out


def mark(
    docs: DataFrame,
    items: DataFrame,
    text: str = "text",
    item_id: str = "item_id",
    item_text: str = "text",
    size: int = 10,
    part_bytes: int = PART_BYTES,
) -> DataFrame:
    """``docs`` with ``__words`` (their number), ``__spans`` (runs of hit words) and ``__items``
    (sorted ids of test strings of which a window occurs)."""
    spark = docs.sparkSession
    total = items.agg(F.sum(F.octet_length(item_text))).first()[0] or 0
    n_parts = max(1, -(-total // part_bytes))
    part = F.pmod(F.xxhash64(F.col(item_id), F.col(item_text)), F.lit(n_parts))
    plain = items.filter(F.col(item_text).isNotNull()).select(
        F.col(item_id).cast("long").alias("id"), F.col(item_text).alias("text"), part.alias("part")
    )
    marked = docs
    for k in range(n_parts):
        rows = plain.filter(F.col("part") == k).select("id", "text").collect()
        sent = spark.sparkContext.broadcast([tuple(r) for r in rows])
        marked = _mark_part(marked, sent, text, size, k > 0)
        if k < n_parts - 1:
            marked = pin(marked)
            sent.destroy()
    return marked


#: The part that this process has compiled, by a name of its own.
_compiled: dict[str, list[Patterns]] = {}


def _patterns(name: str, sent, size: int) -> list[Patterns]:
    if name not in _compiled:
        _compiled.clear()
        _compiled[name] = compile_patterns(sent.value, size)
    return _compiled[name]


def _mark_part(docs: DataFrame, sent, text: str, size: int, again: bool) -> DataFrame:
    kept = [c for c in docs.columns if not (again and c in ("__words", "__spans", "__items"))]
    out = StructType(
        [
            *docs.select(*kept).schema.fields,
            StructField("__words", LongType()),
            StructField("__spans", SPAN),
            StructField("__items", ArrayType(LongType())),
        ]
    )
    names = [f.name for f in out.fields]
    span_type = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64())]))

    part = uuid.uuid4().hex

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        patterns = _patterns(part, sent, size)
        for batch in batches:
            for rows in slices(batch, text):
                counts, spans, found = find(rows.column(text), patterns)
                if again:
                    spans = [merge_spans(a, b) for a, b in zip(rows.column("__spans").to_pylist(), spans)]
                    found = [sorted({*a, *b}) for a, b in zip(rows.column("__items").to_pylist(), found)]
                made = [pa.array(counts, pa.int64()), pa.array(spans, span_type), pa.array(found, pa.list_(pa.int64()))]
                yield pa.RecordBatch.from_arrays([*(rows.column(c) for c in kept), *made], names)

    return docs.mapInArrow(run, out)


def clean_documents(docs: DataFrame, items: DataFrame, size: int = 10) -> DataFrame:
    """The rows of ``docs`` in which no window of a test string occurs, with all their columns."""
    held = docs.select(F.struct("*").alias("__row"), F.col("text"))
    return mark(held, items, size=size).filter(F.size("__spans") == 0).select("__row.*")
