"""Cost-balanced packing of tokenised documents into sequences.

A document is its token ids and an end id. Within a block of about ``block_tokens`` tokens:

* every full ``capacity`` of a document becomes a sequence of its own, and the rest is a piece;
* there are as many sequences as the pieces fill, and the tokens left over fill sequences of powers
  of two, which need no padding;
* pieces go in descending length, each to the sequence of the lowest attention cost so far that has
  room for it. A piece of n tokens costs ``linear * n + quadratic * n ** 2``;
* a piece that fits nowhere whole fills the roomiest sequence, and the rest of it queues again.

All sequences end exactly full. A block is packed in the task that read it, so there is no shuffle
and a task holds one block, or one document if that is longer. Sequence numbers are made of the
task's number and a count; input that is read again after a loss is split alike.

Words repeat, so each Python process keeps the ids of words it has met, up to ``CACHE_WORDS`` of
them, and then starts afresh; this changes speed only.

Edge cases: a null text is an empty one, whose only token is the end id. Repeated rows are packed
as documents of their own, null ids are carried as they are, other columns are not read.
"""

from __future__ import annotations

import heapq
import zlib
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

#: ASCII marks but the apostrophe, which can begin a token with the letters after it.
MARKS = "!\"#$%&()*+,-./:;<=>?@[\\]^_`{|}~"
CACHE_PARTS, CACHE_WORDS = 300_000, 700_000
BLOCK_TOKENS = 1 << 20

PIECE = StructType(
    [
        StructField(n, LongType())
        for n in ("doc_id", "start", "length", "ids_crc32", "doc_tokens", "sequence_id", "offset")
    ]
)


def _byte_characters() -> dict[int, str]:
    """The characters that byte-level tokenizers write bytes as: printable ones of Latin-1 stand for
    themselves, the others for the characters from 256 on, in order."""
    plain = [*range(33, 127), *range(161, 173), *range(174, 256)]
    other = [b for b in range(256) if b not in set(plain)]
    return {b: chr(b) for b in plain} | {b: chr(256 + k) for k, b in enumerate(other)}


class _Parts(dict):
    """Ids by part, made when first asked for."""

    def __init__(self, make: Callable[[str], bytes]) -> None:
        self.make = make

    def __missing__(self, part: str) -> bytes:
        if len(self) >= CACHE_PARTS:
            self.clear()
        made = self[part] = self.make(part)
        return made


class WordTokenizer:
    """Ids of whole texts by ``word_bpe_49k.json`` or a file of its kind.

    Its pre-tokenizer never joins across white space, so spaces and line feeds cut a text into parts
    whose ids end to end are those of the text. A part of Latin letters, perhaps with marks after it, is lower-cased and goes to the merge rules directly; other parts go through
    the whole tokenizer. Parts and words met before are looked up.
    """

    def __init__(self, path: str) -> None:
        import os

        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.merge = self.tokenizer.model.tokenize
        self.parts = _Parts(self._part)
        self.words: dict[str, bytes] = {}
        self.characters = _byte_characters()

    def encode(self, text: str, end: int) -> np.ndarray:
        parts = text.replace("\n", " ").split(" ")
        ids = b"".join(map(self.parts.__getitem__, parts))
        return np.frombuffer(ids + end.to_bytes(4, "little"), "<u4")

    def _part(self, part: str) -> bytes:
        word = part.rstrip(MARKS)
        low = word.lower()
        if not (word.isalpha() and low.isalpha() and max(word) < "\u0250"):
            return self._plain(part)
        found = self.words.get(low)
        if found is None:
            if len(self.words) >= CACHE_WORDS:
                self.words.clear()
            symbols = low.encode().decode("latin-1").translate(self.characters)
            found = self.words[low] = np.array([t.id for t in self.merge(symbols)], "<u4").tobytes()
        tail = part[len(word) :]
        if not tail:
            return found
        marks = self.words.get(tail)
        if marks is None:
            marks = self.words[tail] = self._plain(tail)
        return found + marks

    def _plain(self, part: str) -> bytes:
        return np.array(self.tokenizer.encode(part, add_special_tokens=False).ids, "<u4").tobytes()


_tokenizers: dict[str, WordTokenizer] = {}


def tokenizer(path: str) -> WordTokenizer:
    """One per process, so that what it has met serves later tasks too."""
    if path not in _tokenizers:
        _tokenizers[path] = WordTokenizer(path)
    return _tokenizers[path]


def capacities(tokens: int, capacity: int) -> list[int]:
    """Sequence sizes that hold exactly ``tokens``: full ones, then powers of two."""
    left = tokens % capacity
    tail = [1 << b for b in range(left.bit_length() - 1, -1, -1) if left >> b & 1]
    return [capacity] * (tokens // capacity) + tail


def pack(lengths: list[int], capacity: int, linear: float, quadratic: float) -> list[tuple[int, int, int, int, int]]:
    """Pieces (document, start, length, sequence, offset) of documents of the given lengths."""
    out, queue, sequence = [], [], 0
    for d, n in enumerate(lengths):
        full = n // capacity
        for k in range(full):
            out.append((d, k * capacity, capacity, sequence, 0))
            sequence += 1
        if n % capacity:
            queue.append((-(n % capacity), d, full * capacity))
    heapq.heapify(queue)
    room = np.array(capacities(-sum(q[0] for q in queue), capacity), np.int64)
    size = room.copy()
    cost = np.zeros(len(room))
    while queue:
        need, d, start = heapq.heappop(queue)
        need = -need
        fits = room >= need
        if fits.any():
            s = int(np.where(fits, cost, np.inf).argmin())
            n = need
        else:
            s = int(room.argmax())
            n = int(room[s])
            heapq.heappush(queue, (n - need, d, start + n))
        out.append((d, start, n, sequence + s, int(size[s] - room[s])))
        room[s] -= n
        cost[s] += linear * n + quadratic * n * n
    return out


def pack_documents(
    docs: DataFrame,
    tokenizer_path: str,
    capacity: int = 2048,
    end_id: int = 1,
    doc_id: str = "doc_id",
    text: str = "text",
    linear: float = 1.0,
    quadratic: float = 1 / 2048,
    block_tokens: int = BLOCK_TOKENS,
    with_ids: bool = False,
) -> DataFrame:
    """One row per piece: its document, place there, sequence and offset in it. ``with_ids`` adds the
    token ids themselves as ``ids``."""
    schema = StructType([*PIECE.fields])
    if with_ids:
        schema = schema.add("ids", ArrayType(IntegerType()))
    names = [f.name for f in schema.fields]

    def emit(rows: list[tuple[int | None, np.ndarray]], base: int) -> tuple[pa.RecordBatch, int]:
        pieces = pack([len(ids) for _, ids in rows], capacity, linear, quadratic)
        columns = [[] for _ in names]
        used = 0
        for d, start, n, sequence, offset in pieces:
            key, ids = rows[d]
            part = ids[start : start + n]
            made = [key, start, n, zlib.crc32(part), len(ids), base + sequence, offset, *([part.astype("i4")] if with_ids else [])]
            for c, v in zip(columns, made):
                c.append(v)
            used = max(used, sequence + 1)
        kinds = [pa.int64()] * len(PIECE) + [pa.list_(pa.int32())] * with_ids
        return pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(columns, kinds)], names), base + used

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words = tokenizer(tokenizer_path)
        base = TaskContext.get().partitionId() << 40
        rows, held = [], 0
        for batch in batches:
            for key, value in zip(batch.column(0), batch.column(1)):
                ids = words.encode(value.as_py() or "", end_id)
                rows.append((key.as_py(), ids))
                held += len(ids)
                if held >= block_tokens:
                    made, base = emit(rows, base)
                    yield made
                    rows, held = [], 0
        if rows:
            yield emit(rows, base)[0]

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    return plain.mapInArrow(run, schema)
