"""Words of Arrow text columns as numpy arrays, for use inside ``mapInArrow`` tasks.

A batch is scanned as bytes, without a Python object per word. Nulls count as empty texts.
"""

from __future__ import annotations

from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import StructType

ALL = np.uint64(0xFFFFFFFFFFFFFFFF)
BASE = 0x9E3779B97F4A7C15
INVERSE = pow(BASE, -1, 1 << 64)
SLICE_BYTES = 2 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[65:91] += 32
#: Digits, lower-case letters and every byte of a character beyond ASCII.
ALNUM = np.zeros(256, bool)
ALNUM[48:58] = ALNUM[97:123] = ALNUM[128:] = True
#: The same with capital letters, for text that is not lower-cased.
ALNUM_CASED = ALNUM.copy()
ALNUM_CASED[65:91] = True
#: All but space and the control characters from tab to carriage return.
SOLID = np.ones(256, bool)
SOLID[9:14] = SOLID[32] = False

_powers: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def mix(x: np.ndarray) -> np.ndarray:
    """Spreads every bit of 64-bit numbers over all bits."""
    x = x ^ (x >> np.uint64(33))
    x = x * np.uint64(0xFF51AFD7ED558CCD)
    x ^= x >> np.uint64(33)
    x *= np.uint64(0xC4CEB9FE1A85EC53)
    x ^= x >> np.uint64(33)
    return x


def _power(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_powers[0]) < n:
        size = max(n, SLICE_BYTES + 1)
        for k, base in enumerate((BASE, INVERSE)):
            out = np.full(size, base, np.uint64)
            out[0] = 1
            _powers[k] = np.multiply.accumulate(out)
    return _powers[0], _powers[1]


class Words:
    """The words of a slice of texts.

    ``data``: the bytes of all texts, lower-cased on request; ``starts``, ``ends``: places of words
    in it; ``first``: number of the first word of each text, with the total at the end; ``doc``: the
    text of each word.
    """

    def __init__(self, texts: pa.Array, table: np.ndarray, lower: bool = True) -> None:
        raw, offsets = text_bytes(texts)
        self.data = LOWER[raw] if lower else raw
        self.offsets = offsets
        inside = table[self.data]
        before, after = np.zeros_like(inside), np.zeros_like(inside)
        before[1:], after[:-1] = inside[:-1], inside[1:]
        full = offsets[:-1] < offsets[1:]
        before[offsets[:-1][full]] = False
        after[offsets[1:][full] - 1] = False
        self.starts = np.flatnonzero(inside & ~before)
        self.ends = np.flatnonzero(inside & ~after) + 1
        self.first = np.searchsorted(self.starts, offsets)
        self.n_docs = len(texts)
        self._sums: np.ndarray | None = None

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    @property
    def doc(self) -> np.ndarray:
        return np.repeat(np.arange(self.n_docs), self.counts)

    def hash_spans(self, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
        """64-bit hashes of byte spans; equal bytes hash alike wherever they stand."""
        power, inverse = _power(len(self.data) + 1)
        if self._sums is None:
            sums = np.zeros(len(self.data) + 1, np.uint64)
            np.cumsum((self.data.astype(np.uint64) + np.uint64(1)) * power[: len(self.data)], out=sums[1:])
            self._sums = sums
        return mix((self._sums[ends] - self._sums[starts]) * inverse[starts])

    def hashes(self) -> np.ndarray:
        return self.hash_spans(self.starts, self.ends)


def text_bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """UTF-8 bytes of all texts end to end, and the offsets of the texts in them."""
    if pa.types.is_null(texts.type):
        texts = texts.cast(pa.string())
    wide = pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type)
    if texts.null_count:
        texts = texts.fill_null("")
    _, offs, data = texts.buffers()
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    offsets = np.frombuffer(offs, np.int64 if wide else np.int32)
    offsets = offsets[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[offsets[0] : offsets[-1]], offsets - offsets[0]


def slices(batch: pa.RecordBatch, text: str, limit: int = SLICE_BYTES) -> Iterator[pa.RecordBatch]:
    """Cuts a batch into runs of rows with about ``limit`` bytes of text; longer texts stand alone."""
    _, offsets = text_bytes(batch.column(text))
    at = 0
    while at < batch.num_rows:
        to = max(at + 1, int(np.searchsorted(offsets, offsets[at] + limit, "right")) - 1)
        yield batch.slice(at, to - at)
        at = to


def shingles(words: np.ndarray, first: np.ndarray, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes of runs of ``size`` words, and the text of each, in order. A text with fewer words,
    but not none, has one run of all of them; a text without words has none."""
    n = np.diff(first)
    power = np.array([pow(BASE, k + 1, 1 << 64) for k in range(size)], np.uint64)
    total = np.zeros(max(0, len(words) - size + 1), np.uint64)
    for k in range(size):
        total += words[k : k + len(total)] * power[k]
    doc = np.repeat(np.arange(len(n)), n)
    whole = doc[: len(total)] == doc[size - 1 :] if len(total) else np.zeros(0, bool)
    hashes, docs = mix(total[whole]), doc[: len(total)][whole]
    few = np.flatnonzero((n > 0) & (n < size))
    if len(few):
        sums = np.array([(words[first[d] : first[d + 1]] * power[: n[d]]).sum(dtype=np.uint64) for d in few], np.uint64)
        hashes, docs = np.concatenate([hashes, mix(sums + np.uint64(1))]), np.concatenate([docs, few])
        order = np.argsort(docs, kind="stable")
        hashes, docs = hashes[order], docs[order]
    return hashes, docs


def unique_pairs(docs: np.ndarray, values: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Distinct (text, value) pairs, by text and value."""
    order = np.lexsort((values, docs))
    docs, values = docs[order], values[order]
    new = np.ones(len(docs), bool)
    new[1:] = (docs[1:] != docs[:-1]) | (values[1:] != values[:-1])
    return docs[new], values[new]


def annotate(
    df: DataFrame,
    text: str,
    keep: list[str],
    schema: StructType,
    work: Callable[[pa.Array], list[pa.Array]],
    start: Callable[[], None] | None = None,
) -> DataFrame:
    """``keep`` columns of ``df``, and after them the columns of ``schema`` that ``work`` makes of
    the texts of a slice. No shuffle; each task holds a slice at a time."""
    names = list(dict.fromkeys([*keep, text]))
    out = StructType([*df.select(*keep).schema.fields, *schema.fields])
    columns = [f.name for f in out.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), *work(part.column(text))], columns)

    return df.select(*names).mapInArrow(run, out)


def held_out(doc_id: str, modulus: int, remainder: int):
    """Whether crc32 of the id as text leaves the remainder. Null ids count as empty text."""
    crc = F.crc32(F.coalesce(F.col(doc_id).cast("string"), F.lit("")).cast("binary"))
    return (crc % modulus) == remainder
