"""Hard negatives of labelled vectors by segment summary filtering.

Each vector is cut into segments, and the index stores every segment's mean and deviation, at several
levels: ``LEVELS`` segments, each level cutting those before. Over a segment of n components two
vectors' product is n times the product of their means, plus or minus at most n times that of their
deviations, so summaries bound a score from both sides. A pair goes on to the next level only while its
bounds leave it a chance, and to exact integer scoring after the last. What has a chance follows from
the best scores found so far, so the filter never loses a row.

Anchors are scored against all rows in cells of an (anchor block, row block) grid: a cell holds at most
about ``CELL_ROWS`` of either, both blocks go by hashes of row numbers, and a cell gives up only its
best few rows per anchor, which are then ordered over all cells. A first pass finds each anchor's
positives, a second the negatives within its score windows.

Both summaries are stored times the root of the segment's length, so that sums of products need no
weights. Scores are 64-bit integers; bounds carry a slack for floating-point rounding.

Edge cases: rows with a null label, a null vector, or a null or non-finite component take no part.
Vectors shorter than the longest are filled up with zeros; empty ones score 0. Rows with a null id take
part, come after all others in ties, and are never anchors. Repeated rows are rows of their own, and a
row is never its own positive. Ties among repeated rows go by an internal row number and show the same
values either way. An empty table gives no rows. Scaled vectors with a squared length of 2 ** 56 or
more have no exact 64-bit bounds and end the job with an error. Other columns are not read.
"""

from __future__ import annotations

import math
from collections.abc import Callable, Iterable, Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.session import pin

#: Segments at each level.
LEVELS = (4, 16)
CELL_ROWS = 65_536
#: Anchors and rows whose scores are held at once.
ANCHORS, ROWS = 64, 4096
LARGEST = float(1 << 56)

_INDEX = "row long, vec_id long, label long, data array<long>, means array<double>, deviations array<double>"
_POSITIVE = "anchor_row long, anchor_id long, row long, vec_id long, score long"
_NEGATIVE = "anchor_row long, anchor_id long, place int, positive_id long, positive_score long, row long, vec_id long, score long"


def _borders(width: int, count: int) -> np.ndarray:
    return np.linspace(0, width, min(count, width) + 1).astype(int)


def summaries(data: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Means and deviations of all segments of all levels, times the root of the segments' lengths."""
    means, deviations = [], []
    for count in LEVELS:
        borders = _borders(data.shape[1], count)
        size = np.diff(borders)
        sums = np.add.reduceat(data, borders[:-1], axis=1)
        centre = sums / size
        left = data - np.repeat(centre, size, axis=1)
        means.append(sums / np.sqrt(size))
        deviations.append(np.sqrt(np.add.reduceat(left * left, borders[:-1], axis=1)))
    return np.concatenate(means, 1), np.concatenate(deviations, 1)


def _lists(values: np.ndarray) -> pa.ListArray:
    offsets = np.arange(len(values) + 1, dtype=np.int32) * values.shape[1]
    return pa.ListArray.from_arrays(pa.array(offsets), pa.array(values.reshape(-1)))


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Lists as rows, filled up with zeros."""
    flat, sizes = column.flatten().to_numpy(zero_copy_only=False), column.value_lengths().to_numpy(zero_copy_only=False)
    out = np.zeros((len(sizes), width), flat.dtype)
    out[np.arange(width) < sizes[:, None]] = flat
    return out


def index(rows: DataFrame, vec_id: str = "vec_id", vector: str = "embedding", label: Column | None = None, scale: float = 256.0) -> DataFrame:
    """The stored rows: ``row`` (a number), ``vec_id``, ``label``, ``data`` (integers) and the summaries."""
    finite = F.forall(F.col(vector), lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    scaled = F.transform(F.col(vector), lambda x: F.floor(F.lit(scale) * x.cast("double")))
    found = rows.select(
        F.col(vec_id).cast("long").alias("vec_id"),
        (F.col("label") if label is None else label).cast("long").alias("label"),
        F.when(F.coalesce(finite, F.lit(False)), scaled).alias("data"),
    )
    found = found.filter("label IS NOT NULL AND data IS NOT NULL")
    width = max(1, found.agg(F.max(F.size("data"))).first()[0] or 0)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, ROWS):
                part = batch.slice(at, ROWS)
                data = _matrix(part.column("data"), width)
                if ((data.astype(float) ** 2).sum(1) >= LARGEST).any():
                    raise ValueError("A vector is too long for 64-bit scores; lower the scale.")
                made = [_lists(data), *map(_lists, summaries(data.astype(float)))]
                columns = [part.column(n) for n in ("row", "vec_id", "label")]
                yield pa.RecordBatch.from_arrays([*columns, *made], ["row", "vec_id", "label", "data", "means", "deviations"])

    # Written at once, so the numbers stay as they were first given out.
    numbered = found.select(F.monotonically_increasing_id().alias("row"), "vec_id", "label", "data")
    return pin(numbered.mapInArrow(run, _INDEX))


class _Vectors:
    """Rows of a cell as arrays."""

    def __init__(self, table: pa.Table) -> None:
        column = {n: table[n].combine_chunks() for n in ("row", "vec_id", "label", "data", "means", "deviations")}
        n = len(table)
        self.row, self.label = column["row"].to_numpy(), column["label"].to_numpy()
        self.no_id = column["vec_id"].is_null().to_numpy(zero_copy_only=False)
        self.id = column["vec_id"].fill_null(0).to_numpy()
        wide = lambda c: column[c].flatten().to_numpy().reshape(n, -1) if n else np.zeros((0, 1))
        self.data, self.means, self.deviations = wide("data").astype(float), wide("means"), wide("deviations")
        self.length = np.sqrt((self.data**2).sum(1))

    def take(self, at: np.ndarray) -> _Vectors:
        out = object.__new__(_Vectors)
        out.__dict__ = {k: v[at] for k, v in self.__dict__.items()}
        return out


def _spans(width: int) -> list[slice]:
    ends = np.cumsum([0, *(len(_borders(width, c)) - 1 for c in LEVELS)])
    return [slice(a, b) for a, b in zip(ends[:-1], ends[1:])]


def _scores(anchors: _Vectors, rows: _Vectors, test: Callable[[np.ndarray, np.ndarray, _Vectors], np.ndarray]) -> tuple[_Vectors, np.ndarray, np.ndarray]:
    """Rows that some anchor still wants after all levels, with their exact scores and which are wanted."""
    for span in _spans(rows.data.shape[1]):
        centre = anchors.means[:, span] @ rows.means[:, span].T
        spread = anchors.deviations[:, span] @ rows.deviations[:, span].T
        spread += 0.5 + 1e-9 * anchors.length[:, None] * rows.length
        wanted = test(centre + spread, centre - spread, rows)
        left = wanted.any(0)
        rows, wanted = rows.take(left), wanted[:, left]
    largest = anchors.length.max(initial=0) * rows.length.max(initial=0)
    if largest < 1 << 52:  # all sums on the way are whole numbers that a double holds exactly
        exact = (anchors.data @ rows.data.T).astype(np.int64)
    else:
        exact = anchors.data.astype(np.int64) @ rows.data.astype(np.int64).T
    return rows, exact, wanted


class _Best:
    """The first ``k`` rows of each group: higher scores, then smaller ids, null ids last."""

    def __init__(self, groups: int, k: int, need: np.ndarray | None = None) -> None:
        self.k = k
        self.need = np.full(groups, -(2**62)) if need is None else need
        self.held = tuple(np.zeros(0, t) for t in (np.int64, np.int64, bool, np.int64, np.int64))

    def add(self, groups: np.ndarray, rows: _Vectors, scores: np.ndarray, wanted: np.ndarray) -> None:
        """``scores`` and ``wanted`` have a line for each of ``groups``."""
        if not wanted.any():
            return
        if scores.shape[1] > self.k:  # equal scores stay together
            least = np.where(wanted, scores, -(2**62))
            wanted = wanted & (scores >= np.partition(least, -self.k, axis=1)[:, [-self.k]])
        g, r = np.nonzero(wanted)
        new = (groups[g], scores[g, r], rows.no_id[r], rows.id[r], rows.row[r])
        group, score, no_id, ids, row = (np.concatenate(x) for x in zip(self.held, new))
        order = np.lexsort((row, ids, no_id, -score, group))
        group = group[order]
        place = np.arange(len(group)) - np.searchsorted(group, group)
        keep = place < self.k
        self.held = (group[keep], *(x[order[keep]] for x in (score, no_id, ids, row)))
        full = place[keep] == self.k - 1
        self.need[self.held[0][full]] = np.maximum(self.need[self.held[0][full]], self.held[1][full])


def _parts(at: np.ndarray, size: int) -> Iterator[np.ndarray]:
    return (at[k : k + size] for k in range(0, len(at), size))


def _two_sides(table: pa.Table) -> tuple[pa.Table, _Vectors, _Vectors]:
    anchor = table["is_anchor"].combine_chunks()
    anchors = table.filter(anchor)
    return anchors, _Vectors(anchors), _Vectors(table.filter(pc.invert(anchor)))


def _made(schema: str, columns: list[list[np.ndarray]], nulls: list[np.ndarray]) -> pa.Table:
    """A result table; the column ``vec_id`` is null where ``nulls`` says so."""
    names = [c.split()[0] for c in schema.split(", ")]
    kinds = [pa.int32() if c.endswith(" int") else pa.int64() for c in schema.split(", ")]
    whole = [np.concatenate(c) if c else np.zeros(0, np.int64) for c in columns]
    null = np.concatenate(nulls) if nulls else None
    return pa.table([pa.array(c, k, mask=null if n == "vec_id" else None) for n, c, k in zip(names, whole, kinds)], names)


def _positives(k: int) -> Callable[[pa.Table], pa.Table]:
    """Best rows of a cell with the anchor's label."""

    def work(table: pa.Table) -> pa.Table:
        _, anchors, rows = _two_sides(table)
        out, nulls = [[] for _ in range(5)], []
        for label in np.intersect1d(anchors.label, rows.label):
            theirs = np.flatnonzero(rows.label == label)
            for at in _parts(np.flatnonzero(anchors.label == label), ANCHORS):
                some = anchors.take(at)
                best = _Best(len(at), k)
                for part in _parts(theirs, ROWS):
                    found, scores, wanted = _scores(some, rows.take(part), lambda high, low, _: high >= best.need[:, None])
                    wanted &= (found.row != some.row[:, None]) & (scores >= best.need[:, None])
                    best.add(np.arange(len(at)), found, scores, wanted)
                group, score, no_id, ids, row = best.held
                for o, v in zip(out, (some.row[group], some.id[group], row, ids, score)):
                    o.append(v)
                nulls.append(no_id)
        return _made(_POSITIVE, out, nulls)

    return work


def _negatives(k: int, low: int, high: int) -> Callable[[pa.Table], pa.Table]:
    """Best rows of a cell with another label, for each window of each anchor."""

    def work(table: pa.Table) -> pa.Table:
        given, anchors, rows = _two_sides(table)
        score, ids = given["positive_scores"].combine_chunks(), given["positive_ids"].combine_chunks()
        width = max(1, pc.max(score.value_lengths()).as_py() or 0)
        count = score.value_lengths().to_numpy()
        scores = _matrix(score, width)
        first = np.where(np.arange(width) < count[:, None], -((-low * scores) // 100), 1)
        last = np.where(np.arange(width) < count[:, None], high * scores // 100, 0)
        starts = ids.offsets.to_numpy()
        ids = ids.flatten()
        out, nulls = [[] for _ in range(8)], []
        for at in _parts(np.arange(len(anchors.row)), ANCHORS):
            some, lows, highs = anchors.take(at), first[at], last[at]
            best = _Best(lows.size, k, lows.reshape(-1).copy())
            need = best.need.reshape(lows.shape)

            def test(upper: np.ndarray, lower: np.ndarray, there: _Vectors) -> np.ndarray:
                hit = np.zeros(upper.shape, bool)
                for w in range(width):
                    open_ = lows[:, w] <= highs[:, w]
                    hit |= open_[:, None] & (upper >= need[:, [w]]) & (lower <= highs[:, [w]])
                return hit & (there.label != some.label[:, None])

            for part in _parts(np.arange(len(rows.row)), ROWS):
                found, exact, wanted = _scores(some, rows.take(part), test)
                for w in range(width):
                    inside = wanted & (exact >= need[:, [w]]) & (exact <= highs[:, [w]])
                    best.add(np.arange(len(at)) * width + w, found, exact, inside)
            group, value, no_id, negative, row = best.held
            a, w = group // width, (group % width).astype(np.int32)
            of = at[a]
            positive = ids.take(pa.array(starts[of] - starts[0] + w))
            made = (some.row[a], some.id[a], w, positive, scores[of, w], row, negative, value)
            for o, v in zip(out, made):
                o.append(v)
            nulls.append(no_id)
        chunks = out[3]
        out[3] = [c.fill_null(0).to_numpy() for c in chunks]
        table = _made(_NEGATIVE, out, nulls)
        if chunks:
            table = table.set_column(3, "positive_id", pa.chunked_array(chunks, pa.int64()))
        return table

    return work


def _cells(anchors: DataFrame, rows: DataFrame, work: Callable[[pa.Table], pa.Table], schema: str) -> DataFrame:
    """Runs ``work`` on every cell: ``anchors`` of a block, told by ``is_anchor``, and rows of a block."""
    session = rows.sparkSession
    n, tasks = rows.count(), int(session.conf.get("spark.sql.shuffle.partitions"))
    n_anchors = max(1, math.ceil(anchors.count() / CELL_ROWS))
    # Few rows make few blocks: each gives up its best rows for every anchor.
    n_rows = max(1, math.ceil(n / CELL_ROWS), min(tasks, n // (CELL_ROWS // 16)))
    every = lambda n: F.explode(F.sequence(F.lit(0), F.lit(n - 1)))
    own = lambda n: F.pmod(F.xxhash64("row"), F.lit(n)).cast("int")
    left = anchors.withColumns({"is_anchor": F.lit(True), "anchor_block": own(n_anchors)}).withColumn("row_block", every(n_rows))
    right = rows.withColumns({"is_anchor": F.lit(False), "row_block": own(n_rows)}).withColumn("anchor_block", every(n_anchors))
    both = left.unionByName(right, allowMissingColumns=True)
    return both.groupBy("anchor_block", "row_block").applyInArrow(work, schema)


def _first(found: DataFrame, group: list[str], k: int) -> DataFrame:
    """The first ``k`` rows of each group with their ``rank``. Cells sent ``k`` at most for each."""
    order = Window.partitionBy(*group).orderBy(F.desc("score"), F.asc_nulls_last("vec_id"), "row")
    return found.withColumn("rank", F.row_number().over(order)).filter(F.col("rank") <= k)


def mine(
    indexed: DataFrame,
    anchors: Column,
    positives: int = 5,
    negatives: int = 10,
    low: int = 30,
    high: int = 90,
) -> DataFrame:
    """Hard negatives of the ``indexed`` rows that satisfy ``anchors``.

    For each of an anchor's ``positives`` best other rows of its label, the ``negatives`` best rows of
    other labels whose score lies between ``low`` and ``high`` percent of the positive's:
    ``anchor_id``, ``positive_id``, ``rank``, ``negative_id``, ``positive_score``, ``negative_score``.
    """
    chosen = indexed.filter(anchors)
    found = _cells(chosen, indexed, _positives(positives), _POSITIVE)
    best = _first(found, ["anchor_row"], positives)
    ordered = F.array_sort(F.collect_list(F.struct("rank", "vec_id", "score")))
    windows = best.groupBy("anchor_row").agg(ordered.alias("best"))
    windows = windows.select(
        F.col("anchor_row").alias("row"), F.col("best.vec_id").alias("positive_ids"), F.col("best.score").alias("positive_scores")
    )
    chosen = pin(chosen.join(windows, "row"))
    found = _cells(chosen, indexed, _negatives(negatives, low, high), _NEGATIVE)
    ranked = _first(found, ["anchor_row", "place"], negatives)
    return ranked.select(
        "anchor_id",
        "positive_id",
        "rank",
        F.col("vec_id").alias("negative_id"),
        "positive_score",
        F.col("score").alias("negative_score"),
    )
