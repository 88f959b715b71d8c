"""Language identification by compression.

Per language a Zstandard dictionary of raw content is filled with samples of its labelled texts. A
text is encoded with each, and the language of the smallest total wins. Texts are cut into parts of
``PART`` bytes, each of them encoded with the dictionary afresh, so that it helps to the end of a
long text; every byte counts. Where the runner-up is within ``margin`` of the winner the text is
marked as rejected.

The score is the winner's share when languages weigh ``exp(-SHARPNESS * size / smallest)``.

Samples: texts are cut into slices of ``SLICE`` characters, and slices are drawn by their hash at a
rate that follows from the counts of all slices, so any part of any text can be drawn; what reaches
the driver is about ``dictionary_bytes`` per language, however many texts there are.

Edge cases: null texts and texts without a letter are ``und`` with score 0, and so is everything when
no language was learned. Rows without language teach nothing. Rows are predicted one by one, so
repeated rows get equal results. Of equal totals the language first in the alphabet wins. Other columns are
not read.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import BooleanType, DoubleType, StringType, StructField, StructType

from driftwatch.llm.textops import annotate, text_bytes

SLICE = 1000
PART = 4096
LEVEL = 3
SHARPNESS = 60.0
DICTIONARY_BYTES = 96 << 10


def fit(labelled: DataFrame, text: str = "text", lang: str = "lang", dictionary_bytes: int = DICTIONARY_BYTES) -> dict[str, bytes]:
    """Dictionary content by language."""
    rows = labelled.filter(F.col(lang).isNotNull() & (F.length(text) > 0)).select(
        F.col(lang).cast("string").alias("lang"), F.col(text).alias("text")
    )
    n = F.ceil(F.length("text") / SLICE)
    counts = {r["lang"]: r["n"] for r in rows.groupBy("lang").agg(F.sum(n).alias("n")).collect()}
    if not counts:
        return {}
    wanted = 1.5 * dictionary_bytes / SLICE
    rates = {k: min(1.0, wanted / v) for k, v in counts.items()}
    rate = F.element_at(F.create_map(*(F.lit(x) for kv in rates.items() for x in kv)), F.col("lang"))
    drawn = rows.select("lang", "text", rate.alias("rate"), F.explode(F.sequence(F.lit(0), n.cast("int") - 1)).alias("k"))
    chance = F.pmod(F.xxhash64(F.xxhash64("text"), "k"), F.lit(1 << 30)) / float(1 << 30)
    drawn = drawn.filter(chance < F.col("rate"))
    slices = drawn.select("lang", F.expr(f"substring(text, k * {SLICE} + 1, {SLICE})").alias("slice")).distinct().collect()
    out: dict[str, bytes] = {}
    for r in sorted(slices, key=lambda r: (r["lang"], hash_order(r["slice"]))):
        out[r["lang"]] = out.get(r["lang"], b"") + r["slice"].encode() + b"\n"
    return {k: v[-dictionary_bytes:] for k, v in out.items()}


def hash_order(text: str) -> int:
    """An order that has nothing to do with what a slice says."""
    import zlib

    return zlib.crc32(text.encode())


class Classifier:
    """Encoders of all languages, in alphabetical order."""

    def __init__(self, dictionaries: dict[str, bytes]) -> None:
        self.langs = sorted(dictionaries)
        self.encoders = []
        for k in self.langs:
            content = zstandard.ZstdCompressionDict(dictionaries[k], dict_type=zstandard.DICT_TYPE_RAWCONTENT)
            content.precompute_compress(level=LEVEL)
            self.encoders.append(zstandard.ZstdCompressor(dict_data=content, write_dict_id=False, write_content_size=False))

    def sizes(self, text: bytes) -> np.ndarray:
        parts = [text[k : k + PART] for k in range(0, len(text), PART)]
        return np.array([sum(len(e.compress(p)) for p in parts) for e in self.encoders], np.float64)


def predict(docs: DataFrame, dictionaries: dict[str, bytes], keep: list[str], text: str = "text", margin: float = 0.005) -> DataFrame:
    """``keep`` columns with ``lang_pred``, ``score`` and ``rejected`` (no letter or narrow margin)."""
    sent = docs.sparkSession.sparkContext.broadcast(dictionaries)
    schema = StructType(
        [StructField("lang_pred", StringType()), StructField("score", DoubleType()), StructField("rejected", BooleanType())]
    )
    made: list[Classifier] = []

    def work(texts: pa.Array) -> list[pa.Array]:
        if not made:
            made.append(Classifier(sent.value))
        model = made[0]
        raw, offsets = text_bytes(texts)
        data = raw.tobytes()
        ascii_letter = np.zeros(256, bool)
        ascii_letter[65:91] = ascii_letter[97:123] = True
        seen = np.concatenate([[0], np.cumsum(ascii_letter[raw])])
        langs, scores, rejected = [], [], []
        for s, e in zip(offsets[:-1], offsets[1:]):
            body = data[s:e]
            letters = seen[e] > seen[s] or any(c.isalpha() for c in body.decode("utf-8", "replace"))
            if not letters or not model.langs:
                langs.append("und"), scores.append(0.0), rejected.append(True)
                continue
            sizes = model.sizes(body)
            best = int(sizes.argmin())
            others = np.delete(sizes, best)
            weights = np.exp(-SHARPNESS * (sizes / sizes[best] - 1))
            langs.append(model.langs[best])
            scores.append(float(1 / weights.sum()))
            rejected.append(bool(len(others) and (others.min() - sizes[best]) / sizes[best] < margin))
        return [pa.array(langs, pa.string()), pa.array(scores, pa.float64()), pa.array(rejected, pa.bool_())]

    return annotate(docs, text, keep, schema, work)
