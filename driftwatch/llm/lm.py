"""Language-model scores: a log-bilinear model trained with noise-contrastive estimation.

Corpus statistics cover all training texts and are taken by Spark: counts of all words, and counts of
all runs of three classes. A class is one of the most frequent words, the text's boundary, or the other
words of like endings (the last two bytes, hashed). The number of distinct runs is bounded by the third power of ``CLASSES``, so
training takes the same effort however large the corpus is, while its counts follow the corpus.

The model scores a class t after classes u, v as ``(r[v] * p1 + r[u] * p2) . q[t] + b[t]``. Workers train
copies of it on their share of the runs in numpy, with noise from the class frequencies, and the
copies are averaged after each round. Batched matrix products over all pairs of classes give the
normalisers, so token probabilities are exact. A word without a class of its own gets the probability
of its ending's class times (c + 1) / (sum of c + 1 over such words, and 1 for words not seen).

Scoring looks up frequent words (at most ``HEAD``, with their counts, broadcast) and the classes in
the task; counts of rarer words are joined.

Edge cases: null texts are empty and consist of the end token. Rows repeated count and are scored each. Without
training texts all counts are nought, base_score is 0 and the model is uniform. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Iterable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from driftwatch.llm.textops import SOLID, Words, slices
from driftwatch.session import pin

CLASSES = 1024
ENDINGS = 255
SIZE = 32
HEAD = 1 << 17
WORKERS = 16
#: Runs a worker holds at most on average; more of them take more workers.
SHARE_RUNS = 4_000_000
ROUNDS = 3
#: Steps a worker and round takes at least; many runs take more.
STEPS = 200
BATCH = 2048
#: A run of more than this many times the mean count is visited several times in a pass.
HEAVY = 4
NOISE = 64
RATE = 0.1
#: Class of the text's boundary. Classes 1 to ``ENDINGS`` are endings, those above are words.
EDGE = 0


@dataclass
class Counts:
    total: int  # tokens, ends included
    types: int
    ends: int
    words: np.ndarray  # hashes of frequent words, sorted
    counts: np.ndarray
    classes: np.ndarray  # class of each frequent word that has its own, else 0
    ending_log: np.ndarray  # log10 of the denominators of words in the classes of endings


def endings(scan: Words) -> np.ndarray:
    """Class of each word by its ending."""
    tail = scan.hash_spans(np.maximum(scan.starts, scan.ends - 2), scan.ends)
    return (tail % np.uint64(ENDINGS)).astype(np.int64) + 1


def word_counts(docs: DataFrame, text: str = "text") -> DataFrame:
    """``word`` (hash), ``ending`` (class) and ``count`` over all texts; ends are not among them."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for part in slices(batch, text):
                scan = Words(part.column(text), SOLID)
                word, at, count = np.unique(scan.hashes(), return_index=True, return_counts=True)
                made = [pa.array(word.view(np.int64)), pa.array(endings(scan)[at].astype(np.int32)), pa.array(count)]
                yield pa.RecordBatch.from_arrays(made, ["word", "ending", "count"])

    counted = docs.select(text).mapInArrow(run, "word long, ending int, count long")
    return counted.groupBy("word", "ending").agg(F.sum("count").alias("count"))


def count_summary(counted: DataFrame, ends: int, head: int = HEAD, classes: int = CLASSES) -> Counts:
    """Totals, and the frequent words: those above the count that at most ``head`` words exceed."""
    step = F.floor(F.log2("count") * 8).cast("int")
    levels = counted.groupBy(step.alias("level")).agg(F.count(F.lit(1)).alias("types"), F.sum("count").alias("total")).collect()
    kept, level = 0, 10**6
    for r in sorted(levels, key=lambda r: -r["level"]):
        if kept + r["types"] > head:
            break
        kept, level = kept + r["types"], r["level"]
    frequent = counted.filter(step >= level).toArrow()
    word = frequent.column("word").to_numpy().view(np.uint64)
    count = frequent.column("count").to_numpy()
    order = np.argsort(word)
    word, count = word[order], count[order]
    ending = frequent.column("ending").to_numpy()[order]
    best = np.lexsort((word, -count))[: classes - ENDINGS - 1]
    kind = np.zeros(len(word), np.int64)
    kind[best] = np.arange(ENDINGS + 1, ENDINGS + 1 + len(best))
    mass = np.ones(ENDINGS + 1)  # words not seen
    for r in counted.groupBy("ending").agg(F.sum(F.col("count") + 1).alias("mass")).collect():
        mass[r["ending"]] += r["mass"]
    np.subtract.at(mass, ending[best], count[best] + 1)
    total, types = sum(r["total"] for r in levels), sum(r["types"] for r in levels)
    return Counts(total + ends, types + (ends > 0), ends, word, count, kind, np.log10(mass))


def look_up(words: np.ndarray, hashes: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Places of hashes in sorted ``words``, and whether they are there."""
    if not len(words):
        return np.zeros(len(hashes), np.int64), np.zeros(len(hashes), bool)
    at = np.minimum(np.searchsorted(words, hashes), len(words) - 1)
    return at, words[at] == hashes


def class_of(scan: Words, classes: np.ndarray, at: np.ndarray, there: np.ndarray) -> np.ndarray:
    """Own class of each word, or the class of its ending."""
    own = np.where(there, classes[at], 0) if len(classes) else np.zeros(len(at), np.int64)
    return np.where(own > 0, own, endings(scan))


def class_runs(kind: np.ndarray, first: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """Class, the one before and the one before that of all tokens and ends, and the text of each."""
    n = np.diff(first)
    target = np.insert(kind, first[1:], EDGE)
    doc = np.repeat(np.arange(len(n)), n + 1)
    before = np.concatenate([[EDGE], target[:-1]])[: len(target)]
    second = np.concatenate([[EDGE, EDGE], target[:-2]])[: len(target)]
    second[first[:-1] + np.arange(len(n))] = EDGE
    return target, before, second, doc


def run_counts(docs: DataFrame, counts: Counts, text: str = "text") -> DataFrame:
    """``run`` (three classes as one number) and ``count`` over all texts."""
    sent = docs.sparkSession.sparkContext.broadcast((counts.words, counts.classes))

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        words, classes = sent.value
        for batch in batches:
            for part in slices(batch, text):
                scan = Words(part.column(text), SOLID)
                at, there = look_up(words, scan.hashes())
                kind = class_of(scan, classes, at, there)
                target, before, second, _ = class_runs(kind, scan.first)
                code, count = np.unique((second * CLASSES + before) * CLASSES + target, return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(code), pa.array(count)], ["run", "count"])

    return docs.select(text).mapInArrow(run, "run long, count long").groupBy("run").agg(F.sum("count").alias("count"))


def initial(frequency: np.ndarray, seed: int = 1) -> dict[str, np.ndarray]:
    rng = np.random.default_rng(seed)
    small = lambda *shape: (rng.standard_normal(shape) * 0.1).astype(np.float32)
    ones = np.ones(SIZE, np.float32)
    return {"r": small(CLASSES, SIZE), "q": small(CLASSES, SIZE), "p1": ones.copy(), "p2": ones.copy(), "b": np.log(frequency).astype(np.float32)}


def visits(count: np.ndarray, least: int) -> tuple[np.ndarray, np.ndarray, int]:
    """Places of all runs, as often as training comes to each in a pass, the weight of one such visit, and the passes
    that make ``least`` visits. The visits of a run share its count, so a pass weighs all tokens by one; a run of up to
    ``HEAVY`` times the mean count has one visit."""
    times = np.ceil(count / (HEAVY * count.mean())).astype(np.int64)
    places = np.repeat(np.arange(len(count), dtype=np.int32), times)
    return places, (count / times).astype(np.float32), max(1, math.ceil(least / len(places)))


def train_share(model: dict[str, np.ndarray], code: np.ndarray, count: np.ndarray, noise: np.ndarray, seed: int, steps: int = STEPS) -> dict[str, np.ndarray]:
    """Noise-contrastive training on all runs by their counts, with adaptive step sizes: whole passes in random order, as
    many as make ``steps`` steps, and one at least."""
    m = {k: v.copy() for k, v in model.items()}
    square = {k: np.full(v.shape, 1e-3, np.float32) for k, v in m.items()}
    rng = np.random.default_rng(seed)
    noise_sum = np.cumsum(noise)
    offset = np.log(NOISE * noise).astype(np.float32)
    column = np.arange(SIZE)
    places, weight, passes = visits(count, steps * BATCH)
    places = rng.permutation(np.tile(places, passes) if passes > 1 else places)
    weight /= weight[places].mean(dtype=np.float64) * BATCH

    def move(key: str, gradient: np.ndarray) -> None:
        square[key] += gradient * gradient
        m[key] -= RATE * gradient / np.sqrt(square[key])

    def scatter(rows: np.ndarray, values: np.ndarray) -> np.ndarray:
        flat = (rows[:, None] * SIZE + column).ravel()
        return np.bincount(flat, values.ravel(), CLASSES * SIZE).reshape(CLASSES, SIZE).astype(np.float32)

    for low in range(0, len(places), BATCH):
        at = places[low : low + BATCH]
        run, w = code[at], weight[at]
        t, v, u = run % CLASSES, run // CLASSES % CLASSES, run // CLASSES**2
        fake = np.minimum(np.searchsorted(noise_sum, rng.random(NOISE)), CLASSES - 1)
        rv, ru = m["r"][v], m["r"][u]
        context = rv * m["p1"] + ru * m["p2"]
        qt, q_fake = m["q"][t], m["q"][fake]
        real = np.einsum("ij,ij->i", context, qt) + m["b"][t] - offset[t]
        made = context @ q_fake.T + (m["b"][fake] - offset[fake])
        g_real = (1 / (1 + np.exp(-real)) - 1) * w
        g_made = w[:, None] / (1 + np.exp(-made))
        g_context = g_real[:, None] * qt + g_made @ q_fake
        g_q = scatter(t, g_real[:, None] * context) + scatter(fake, g_made.T @ context)
        g_b = np.bincount(t, g_real, CLASSES) + np.bincount(fake, g_made.sum(0), CLASSES)
        g_r = scatter(v, g_context * m["p1"]) + scatter(u, g_context * m["p2"])
        g_1, g_2 = (g_context * rv).sum(0), (g_context * ru).sum(0)
        move("q", g_q), move("b", g_b.astype(np.float32)), move("r", g_r), move("p1", g_1), move("p2", g_2)
    return m


KEYS = ("r", "q", "p1", "p2", "b")


def train(runs: DataFrame, workers: int = WORKERS, rounds: int = ROUNDS) -> dict[str, np.ndarray]:
    """Trains on all runs in ``workers`` shares, or more if there are many runs, and averages after
    each round."""
    by_class = runs.groupBy((F.col("run") % CLASSES).alias("class")).agg(F.sum("count").alias("count")).collect()
    frequency = np.full(CLASSES, 0.5)
    for r in by_class:
        frequency[r["class"]] += r["count"]
    frequency /= frequency.sum()
    model = initial(frequency)
    if not by_class:
        return model
    workers = max(workers, math.ceil(runs.count() / SHARE_RUNS))
    shares = runs.select("run", "count").repartition(workers, "run")
    for k in range(rounds):
        sent = runs.sparkSession.sparkContext.broadcast(model)

        def run(batches: Iterable[pa.RecordBatch], k: int = k, sent=sent) -> Iterator[pa.RecordBatch]:
            parts = list(batches)
            code = np.concatenate([b.column("run").to_numpy() for b in parts]) if parts else np.zeros(0, np.int64)
            if len(code):
                count = np.concatenate([b.column("count").to_numpy() for b in parts])
                order = np.argsort(code)  # the same whenever a task is run again
                code, count = code[order], count[order]
                share = TaskContext.get().partitionId()
                made = train_share(sent.value, code, count, frequency, seed=1000 * k + share)
                flat = np.concatenate([made[key].ravel() for key in KEYS]).astype("<f4")
                yield pa.RecordBatch.from_arrays([pa.array([flat.tobytes()]), pa.array([int(count.sum())])], ["model", "weight"])

        rows = shares.mapInArrow(run, "model binary, weight long").collect()
        weights = np.array([r["weight"] for r in rows], np.float64)
        order = np.argsort([bytes(r["model"][:64]) for r in rows], kind="stable")
        flat = sum(np.frombuffer(rows[i]["model"], "<f4").astype(np.float64) * weights[i] for i in order) / weights.sum()
        at, new = 0, {}
        for key in KEYS:
            new[key] = flat[at : at + model[key].size].reshape(model[key].shape).astype(np.float32)
            at += model[key].size
        model = new
    return model


@dataclass
class Table:
    """Natural logarithms of class scores by the class before, by the one before that, and normalisers."""

    first: np.ndarray
    second: np.ndarray
    constant: np.ndarray
    normaliser: np.ndarray

    def log10(self, target: np.ndarray, before: np.ndarray, second: np.ndarray) -> np.ndarray:
        score = self.first[before, target] + self.second[second, target] + self.constant[target]
        return (score - self.normaliser[second, before]) / np.log(10)


def tabulate(model: dict[str, np.ndarray]) -> Table:
    first = (model["r"] * model["p1"]) @ model["q"].T
    second = (model["r"] * model["p2"]) @ model["q"].T
    top = np.exp(first + model["b"]).astype(np.float64)
    normaliser = np.log(np.exp(second).astype(np.float64) @ top.T)
    return Table(first, second, model["b"], normaliser)


DOC = "row long, doc_id long, n_tokens long, n_known long, all_log double, own_log double, class_log double, rare array<long>, rare_n array<int>"


def score(docs: DataFrame, counts: Counts, counted: DataFrame, table: Table, doc_id: str = "doc_id", text: str = "text") -> DataFrame:
    """``row``, ``doc_id``, ``n_tokens``, ``n_known``, ``base_score``, ``score`` of all texts."""
    spark = docs.sparkSession
    sent = spark.sparkContext.broadcast((counts, table))
    names = [c.split()[0] for c in DOC.split(", ")]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        c, t = sent.value
        row = TaskContext.get().partitionId() << 33
        logs = np.log10(c.counts + 1.0)
        end_log, end_known = np.log10(c.ends + 1.0), int(c.ends > 0)
        for batch in batches:
            for part in slices(batch, "text"):
                scan = Words(part.column("text"), SOLID)
                hashes, doc, n = scan.hashes(), scan.doc, part.num_rows
                at, there = look_up(c.words, hashes)
                log = np.where(there, logs[at], 0.0) if len(logs) else np.zeros(len(hashes))
                kind = class_of(scan, c.classes, at, there)
                target, before, second, owner = class_runs(kind, scan.first)
                other = kind <= ENDINGS
                own = np.where(other, log - c.ending_log[np.where(other, kind, 0)], 0.0)
                rare_doc, rare_at = doc[~there], hashes[~there]
                order = np.lexsort((rare_at, rare_doc))
                rare_doc, rare_at = rare_doc[order], rare_at[order]
                new = np.ones(len(rare_at), bool)
                new[1:] = (rare_doc[1:] != rare_doc[:-1]) | (rare_at[1:] != rare_at[:-1])
                start = np.flatnonzero(new)
                times = np.diff(np.append(start, len(rare_at))).astype(np.int32)
                lists = pa.array(np.searchsorted(rare_doc[start], np.arange(n + 1)).astype(np.int32))
                tally = lambda x, d=doc, n=n: np.bincount(d, x, n).astype(np.float64)
                made = [
                    pa.array(row + np.arange(n)),
                    part.column("doc_id"),
                    pa.array(scan.counts + 1),
                    pa.array((tally(there) + end_known).astype(np.int64)),
                    pa.array(tally(log) + end_log),
                    pa.array(tally(own)),
                    pa.array(np.bincount(owner, t.log10(target, before, second), n), pa.float64()),
                    pa.ListArray.from_arrays(lists, pa.array(rare_at[start].view(np.int64))),
                    pa.ListArray.from_arrays(lists, pa.array(times)),
                ]
                row += n
                yield pa.RecordBatch.from_arrays(made, names)

    plain = docs.select(F.col(doc_id).cast("long").alias("doc_id"), F.col(text).alias("text"))
    scored = pin(plain.mapInArrow(run, DOC))
    pairs = F.explode(F.arrays_zip("rare", "rare_n")).alias("p")
    rare = scored.filter(F.size("rare") > 0).select("row", pairs).select("row", F.col("p.rare").alias("word"), F.col("p.rare_n").alias("n"))
    sums = (
        rare.join(counted, "word", "left")
        .groupBy("row")
        .agg(
            F.sum(F.when(F.col("count").isNotNull(), F.col("n")).otherwise(0)).alias("rare_known"),
            F.sum(F.col("n") * F.log10(F.coalesce("count", F.lit(0)) + 1.0)).alias("rare_log"),
        )
    )
    joined = scored.drop("rare", "rare_n").join(sums, "row", "left")
    known, log = F.coalesce("rare_known", F.lit(0)), F.coalesce("rare_log", F.lit(0.0))
    base = float(np.log10(counts.total + counts.types + 1))
    return joined.select(
        "row",
        "doc_id",
        "n_tokens",
        (F.col("n_known") + known).alias("n_known"),
        (F.col("all_log") + log - F.col("n_tokens") * base).alias("base_score"),
        (F.col("class_log") + F.col("own_log") + log).alias("score"),
    )


def fit_and_score(docs: DataFrame, train_on, doc_id: str = "doc_id", text: str = "text") -> tuple[DataFrame, Counts]:
    """Learns from documents that satisfy ``train_on`` and scores all."""
    training = docs.filter(train_on)
    counted = pin(word_counts(training, text))
    counts = count_summary(counted, training.count())
    model = train(pin(run_counts(training, counts, text)))
    return score(docs, counts, counted, tabulate(model), doc_id, text), counts
