"""Shingle sets, their sketches, exact comparison and components, shared by the near-duplicate
operators.

Units (documents or paragraphs) have a ``key`` struct, which tells units of different text apart, and
a ``text``. Units with equal shingle sets
share a ``set_id``, a 64-bit hash of the set, and everything after that works on distinct sets, so
groups of copies cost no more than one of them. Candidate links come from sketches; they only decide
which sets are compared. Comparison is exact, on all shingles of whole texts.
"""

from __future__ import annotations

import itertools
import math
from collections.abc import Callable, Iterable, Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, IntegerType, LongType, StructField, StructType

from driftwatch.llm.textops import ALNUM, Words, annotate, mix, shingles, slices, unique_pairs
from driftwatch.session import owned_folders, pin, run_dir

SKETCH = 64
#: Sets of a bucket that are compared with each other by their sketches.
BUCKET = 256
#: Sets, and shingles, of a component in one group of the exact comparison; larger components are cut
#: into chunks.
CHUNK, CHUNK_SHINGLES = 256, 2_000_000
#: Rounds of labels after which settled components are put aside.
ROUNDS = 3


def candidate_share(similarity: float) -> float:
    """Share of equal sketch entries from which sets are compared: five standard deviations of a sketch
    below the similarity, so that one pair in three million is missed by it."""
    return max(1 / SKETCH, similarity - 5 * math.sqrt(similarity * (1 - similarity) / SKETCH))


def _sets(texts: pa.Array, size: int) -> tuple[np.ndarray, np.ndarray]:
    """Distinct shingles by text: hashes and offsets."""
    words = Words(texts, ALNUM)
    hashes, docs = shingles(words.hashes(), words.first, size)
    docs, hashes = unique_pairs(docs, hashes)
    return hashes, np.searchsorted(docs, np.arange(words.n_docs + 1))


def _set_ids(hashes: np.ndarray, first: np.ndarray) -> np.ndarray:
    sums = np.zeros(len(hashes) + 1, np.uint64)
    np.cumsum(mix(hashes), out=sums[1:])
    return mix(sums[first[1:]] - sums[first[:-1]]).view(np.int64)


def sketch(units: DataFrame, size: int = 5, text: str = "text") -> DataFrame:
    """``key``, ``set_id``, ``sketch`` and ``shingles`` (their number) of units; the first two null where
    a text has no words."""
    schema = StructType([StructField("set_id", LongType()), StructField("sketch", ArrayType(IntegerType())), StructField("shingles", LongType())])
    random = np.random.default_rng(7)
    factor = random.integers(0, 1 << 63, SKETCH, dtype=np.uint64) * np.uint64(2) + np.uint64(1)

    def work(texts: pa.Array) -> list[pa.Array]:
        hashes, first = _sets(texts, size)
        full = np.flatnonzero(np.diff(first))
        out = np.zeros((len(texts), SKETCH), np.uint32)
        for k in range(SKETCH if len(full) else 0):
            out[full, k] = np.minimum.reduceat(hashes * factor[k], first[full]) >> np.uint64(32)
        none = np.diff(first) == 0
        lists = pa.ListArray.from_arrays(
            pa.array(np.arange(len(texts) + 1, dtype=np.int32) * SKETCH), pa.array(out.reshape(-1).view(np.int32))
        )
        ids = pa.array(_set_ids(hashes, first), pa.int64(), mask=none)
        return [ids, lists.filter(pa.array(~none)).take(_places(none)), pa.array(np.diff(first), pa.int64())]

    return annotate(units, text, ["key"], schema, work)


def _places(none: np.ndarray) -> pa.Array:
    return pa.array(np.cumsum(~none) - 1, pa.int64(), mask=none)


def _whole(key: str) -> Column:
    return F.xxhash64(key)


def distinct_sets(sketched: DataFrame, carry: str | None = "sketch", owner: Callable[[str], Column] = _whole) -> DataFrame:
    """One row per set: ``set_id``, its sketch (column ``carry``, if any), ``rep`` (the smallest key), ``copies``,
    ``shingles``, and ``apart``, whether its units belong to several owners. The first parts of a key
    make its owner, so the smallest and the largest key tell."""
    full = sketched.filter("set_id IS NOT NULL")
    carried = [carry] if carry else []
    found = full.groupBy("set_id").agg(
        *(F.first(c).alias(c) for c in carried),
        F.min("key").alias("rep"),
        F.max("key").alias("last"),
        F.count(F.lit(1)).alias("copies"),
        F.first("shingles").alias("shingles"),
    )
    return found.select("set_id", *carried, "rep", (owner("rep") != owner("last")).alias("apart"), "copies", "shingles")


def runs(batches: Iterable[pa.RecordBatch], keys: list[str]) -> Iterator[tuple[pa.RecordBatch, np.ndarray]]:
    """Batches of sorted rows, cut so that no group is split, with the offsets of groups."""
    rest: list[pa.RecordBatch] = []

    def cut(batch: pa.RecordBatch) -> np.ndarray:
        new = np.zeros(batch.num_rows, bool)
        new[0] = True
        for k in keys:
            v = batch.column(k).to_numpy(zero_copy_only=False)
            new[1:] |= v[1:] != v[:-1]
        return np.flatnonzero(new)

    for batch in batches:
        if not batch.num_rows:
            continue
        # With 64-bit offsets all texts fit into one array, so the rows stay one batch.
        kinds = [pa.large_string() if pa.types.is_string(f.type) else f.type for f in batch.schema]
        table = pa.Table.from_batches([b.cast(pa.schema(zip(b.schema.names, kinds))) for b in (*rest, batch)])
        (whole,) = table.combine_chunks().to_batches()
        first = cut(whole)
        if first[-1]:
            yield whole.slice(0, first[-1]), first
        rest = [whole.slice(first[-1])]
    if rest:
        yield rest[0], np.array([0, rest[0].num_rows])


def _roots(linked: np.ndarray) -> np.ndarray:
    """Smallest row of each row's component in a symmetric matrix of links."""
    label = np.arange(len(linked))
    while True:
        new = np.minimum(label, np.where(linked, label[None, :], len(label)).min(1))
        new = new[new]
        if (new == label).all():
            return label
        label = new


PAIR = StructType([StructField("a", LongType()), StructField("b", LongType())])


def bucket_edges(rows: DataFrame, sets: DataFrame, least: float) -> DataFrame:
    """Candidate links of small buckets: sets with ``least`` of their sketch entries in common. ``rows``: ``path``, ``set_id``, each bucket of at most
    ``BUCKET`` sets. A bucket yields a spanning forest of its candidate pairs, not the pairs."""

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in runs(batches, ["path"]):
            ids = batch.column("set_id").to_numpy()
            sketches = batch.column("sketch").flatten().to_numpy().reshape(-1, SKETCH)
            sizes = np.diff(first)
            left = first[:-1][sizes == 2]
            near = (sketches[left] == sketches[left + 1]).mean(1) >= least
            a, b = [ids[left[near] + 1]], [ids[left[near]]]
            for s, n in zip(first[:-1][sizes > 2], sizes[sizes > 2]):
                part = sketches[s : s + n]
                root = _roots((part[:, None, :] == part[None, :, :]).mean(2) >= least)
                other = np.flatnonzero(root != np.arange(n))
                a.append(ids[s + other])
                b.append(ids[s + root[other]])
            yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(a)), pa.array(np.concatenate(b))], ["a", "b"])

    wide = rows.select("path", "set_id").join(sets.select("set_id", "sketch"), "set_id")
    wide = wide.select("path", "set_id", "sketch").repartition("path").sortWithinPartitions("path")
    return wide.mapInArrow(run, PAIR)


def star_edges(rows: DataFrame) -> DataFrame:
    """Links of every set of a large bucket to its smallest: as candidates all of them are one."""
    centre = rows.groupBy("path").agg(F.min("set_id").alias("b"))
    return rows.join(centre, "path").select(F.col("set_id").alias("a"), "b").filter("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """``node``, ``comp`` (smallest node of its component) of undirected edges ``a``, ``b``.

    Each round takes the smallest label among neighbours, then the label of that label. Labels are
    written to the shared folder after each round; only whether any is open reaches the driver. After some
    ``ROUNDS``, components that are settled are left out of the next.
    """
    edges = pin(edges)  # several branches read it; the comparison that makes it must run once
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    short = edges.join(least, "a")
    # Neighbours of a node are linked to the smallest of them instead of to the node. Buckets of
    # many runs share most of these links, so few are left.
    edges = short.select("a", F.col("m").alias("b")).unionByName(
        short.select(F.col("b").alias("a"), F.col("m").alias("b")).filter("a <> b")
    )
    edges = edges.distinct()
    both = pin(edges.unionByName(edges.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct())
    labels = pin(both.groupBy("a").agg(F.min("b").alias("m")).select(F.col("a").alias("node"), F.least("a", "m").alias("comp")))
    settled: list[DataFrame] = []
    for k in itertools.count(1):
        near = both.join(labels, both.b == labels.node).groupBy("a").agg(F.min("comp").alias("m"), F.max("comp").alias("most"))
        is_open = ((F.col("comp") != F.col("m")) | (F.col("comp") != F.col("most"))).alias("open")
        step = labels.join(near, labels.node == near.a).select("node", F.col("comp").alias("old"), is_open, F.least("comp", "m").alias("next"))
        far = labels.select(F.col("node").alias("next"), F.col("comp").alias("jump"))
        done = pin(step.join(far, "next").select("node", "old", "open", F.least("next", "jump").alias("comp")))
        labels = done.select("node", "comp")
        if not done.filter("open").limit(1).count():
            break
        if k % ROUNDS == 0:
            # The nodes of a label that no edge joins to another label are a whole component.
            more = done.groupBy("old").agg(F.max("open").alias("more")).filter("more").select("old")
            labels = pin(done.join(more, "old", "left_semi").select("node", "comp"))
            settled.append(done.join(labels.select("node"), "node", "left_anti").select("node", "comp"))
            both = pin(both.join(labels.select(F.col("node").alias("a")), "a", "left_semi").select("a", "b"))
    return pin(reduce(DataFrame.unionByName, settled, labels)) if settled else labels


def _common(sets: list[np.ndarray]) -> np.ndarray:
    """Sizes of all intersections of sorted sets."""
    n = len(sets)
    tokens, owner = np.concatenate(sets), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(tokens, kind="stable")
    tokens, owner = tokens[order], owner[order]
    new = np.ones(len(tokens), bool)
    new[1:] = tokens[1:] != tokens[:-1]
    column = np.cumsum(new) - 1
    shared = np.bincount(column)[column] > 1
    owner, column = owner[shared], column[shared]
    if len(column):
        column = np.unique(column, return_inverse=True)[1]
    out = np.zeros((n, n), np.float32)
    width = 4096
    for low in range(0, int(column.max()) + 1 if len(column) else 0, width):
        s, e = np.searchsorted(column, [low, low + width])
        block = np.zeros((n, width), np.float32)
        block[owner[s:e], column[s:e] - low] = 1
        out += block @ block.T
    return out


Units = DataFrame | Callable[[DataFrame], DataFrame]


def exact_links(sets: DataFrame, comps: DataFrame, units: Units, size: int, similarity: float) -> DataFrame:
    """Exact comparison inside candidate components. ``units`` are all units, or a function that makes
    those whose key is in column ``rep`` of the frame given to it.

    Returns per set and task: ``set_id``, ``root`` (a linked set that stands for its group there, or
    itself), ``sets`` and ``docs`` (linked sets and units found there), ``whole`` (its component was
    compared in one task). A component of n sets is cut into chunks of about ``CHUNK``; each pair of
    chunks is a task's group, so no task holds more than two chunks and only counts and a spanning
    forest leave it.
    """
    schema = StructType(
        [
            *(StructField(n, LongType()) for n in ("set_id", "root", "sets", "docs")),
            StructField("n_chunks", LongType()),
        ]
    )

    def pairs(hashes: np.ndarray, at: np.ndarray, left: np.ndarray) -> np.ndarray:
        """Whether the sets in rows ``left`` are linked to those in the next rows, all at once."""
        sizes = at[left + 2] - at[left]
        group = np.repeat(np.arange(len(left)), sizes)
        tokens = hashes[np.arange(len(group)) - np.repeat(np.cumsum(sizes) - sizes - at[left], sizes)]
        order = np.lexsort((tokens, group))
        tokens, group = tokens[order], group[order]
        both = np.bincount(group[1:][(tokens[1:] == tokens[:-1]) & (group[1:] == group[:-1])], minlength=len(left))
        return both >= similarity * (sizes - both) - 1e-9

    def compare(ids, copies, chunk, arrays, cross: bool):
        order = {int(s): k for k, s in enumerate(ids)}
        at = np.array(sorted(order.values()), int)  # repeated rows of a set count once
        ids, copies, chunk, arrays = ids[at], copies[at], chunk[at], [arrays[k] for k in at]
        n = len(ids)
        if n < 2:
            return ids, ids, np.zeros(n, np.int64), np.zeros(n, np.int64)
        sizes = np.array([len(a) for a in arrays], np.float64)
        both = _common(arrays).astype(np.float64)
        linked = both >= similarity * (sizes[:, None] + sizes[None, :] - both) - 1e-9
        np.fill_diagonal(linked, False)
        if cross:
            linked &= chunk[:, None] != chunk[None, :]
        return ids, ids[_roots(linked)], linked.sum(1), (linked * copies[None, :]).sum(1)

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch, first in runs(batches, ["comp", "lo", "hi"]):
            column = {c: batch.column(c).to_numpy(zero_copy_only=False) for c in ("set_id", "copies", "chunk", "lo", "hi", "n_chunks")}
            arrays, found, sizes = [], [], []
            for part in slices(batch, "text"):
                hashes, at = _sets(part.column("text"), size)
                arrays.append((hashes, at))
                sizes.append(np.diff(at))
                found.append(_set_ids(hashes, at))
            ids = column["set_id"]
            right = np.concatenate(found) == ids
            hashes, at = np.concatenate([h for h, _ in arrays]), np.append(0, np.cumsum(np.concatenate(sizes)))
            arrays = [hashes[s:e] for s, e in zip(at[:-1], at[1:])]
            out = [[] for _ in range(5)]
            two = (np.diff(first) == 2) & (column["lo"] == column["hi"])[first[:-1]]
            left = first[:-1][two]
            left = left[right[left] & right[left + 1] & (ids[left] != ids[left + 1])]
            if len(left):
                linked = pairs(hashes, at, left)
                for o, v in zip(
                    out,
                    (
                        np.concatenate([ids[left], ids[left + 1]]),
                        np.concatenate([ids[left], np.where(linked, ids[left], ids[left + 1])]),
                        np.tile(linked, 2).astype(np.int64),
                        np.concatenate([linked * column["copies"][left + 1], linked * column["copies"][left]]),
                        np.tile(column["n_chunks"][left], 2),
                    ),
                ):
                    o.append(v)
            rest = ~np.isin(first[:-1], left)
            for s, e in zip(first[:-1][rest], first[1:][rest]):
                at = s + np.flatnonzero(right[s:e])
                if not len(at):
                    continue
                made = compare(
                    column["set_id"][at], column["copies"][at], column["chunk"][at], [arrays[k] for k in at], column["lo"][s] != column["hi"][s]
                )
                for o, v in zip(out, (*made, np.full(len(made[0]), column["n_chunks"][s]))):
                    o.append(v)
            if out[0]:
                yield pa.RecordBatch.from_arrays([pa.array(np.concatenate(o), pa.int64()) for o in out], schema.names)

    known = comps.join(sets.select(F.col("set_id").alias("node"), "rep", "copies", "shingles"), "node")
    chunks = F.greatest(F.ceil(F.count(F.lit(1)) / CHUNK), F.ceil(F.sum("shingles") / CHUNK_SHINGLES)).cast("long")
    if callable(units):
        units = units(known.select("rep"))
    total = known.groupBy("comp").agg(chunks.alias("n_chunks"))
    rows = (
        known.join(total, "comp")
        .withColumn("chunk", F.pmod(F.xxhash64("node"), F.col("n_chunks")))
        .join(units.select(F.col("key").alias("rep"), "text"), "rep")
    )
    other = F.explode(F.sequence(F.lit(0).cast("long"), F.col("n_chunks") - 1)).alias("other")
    rows = rows.select("comp", F.col("node").alias("set_id"), "copies", "chunk", "n_chunks", "text", other)
    rows = rows.withColumns({"lo": F.least("chunk", "other"), "hi": F.greatest("chunk", "other")}).drop("other")
    rows = rows.repartition("comp", "lo", "hi").sortWithinPartitions("comp", "lo", "hi")
    return rows.mapInArrow(run, schema)


def classes(
    units: DataFrame,
    candidates: Callable[[DataFrame], DataFrame],
    size: int = 5,
    similarity: float = 0.8,
) -> DataFrame:
    """Classes of near-equal units: ``key``, ``class_key`` (smallest key of its class, itself if alone),
    ``class_apart`` (whether its units belong to several owners), ``class_size`` and ``n_links`` (other units at the similarity or above, copies included).

    ``candidates`` makes candidate links (``a``, ``b``) of distinct sets (``set_id``, ``sketch``).
    """
    return resolve(pin(sketch(units, size)), "sketch", candidates, units, size, similarity)


def resolve(sketched: DataFrame, carry: str, candidates: Callable[[DataFrame], DataFrame], units: Units, size: int, similarity: float) -> DataFrame:
    """``classes`` of units that are sketched (and pinned) already, in column ``carry``."""
    folder = run_dir(sketched.sparkSession)
    with owned_folders(sketched.sparkSession):  # only ``of_set`` is read later
        sets = pin(distinct_sets(sketched, carry), compression="zstd")
        # All sets are dealt out once, for those that are candidates; what follows moves these and copies.
        plain = sets.drop(carry)
        members = pin(components(candidates(sets)).withColumnRenamed("node", "set_id").join(plain, "set_id"))
        of_set = pin(linked_sets(members, plain, units, size, similarity), folder)
    return with_classes(sketched, of_set)


def linked_sets(members: DataFrame, plain: DataFrame, units: Units, size: int, similarity: float) -> DataFrame:
    """The sets of ``plain`` with copies or links: ``set_id``, ``rep``, ``apart``, ``copies``, ``class`` and ``docs``
    (linked units). ``members``: those with candidate links, and their ``comp``."""
    comps = members.select(F.col("set_id").alias("node"), "comp")
    found = pin(exact_links(members, comps, units, size, similarity))
    counts = found.groupBy("set_id").agg(F.sum("docs").alias("docs"))
    whole = found.filter("n_chunks = 1").select("set_id", F.col("root").alias("class"))
    cut = found.filter("n_chunks > 1 AND root <> set_id").select(F.col("set_id").alias("a"), F.col("root").alias("b"))
    if cut.limit(1).count():
        whole = whole.unionByName(components(cut).select(F.col("node").alias("set_id"), F.col("comp").alias("class")))
    copied = plain.filter("copies > 1").join(members.select("set_id"), "set_id", "left_anti")
    # Sets of one unit without a link are left out: such a unit is a class of its own.
    return (
        members.select(*plain.columns)
        .unionByName(copied)
        .join(whole, "set_id", "left")
        .join(counts, "set_id", "left")
        .select("set_id", "rep", "apart", "copies", F.coalesce("class", "set_id").alias("class"), F.coalesce("docs", F.lit(0)).alias("docs"))
        .filter("copies > 1 OR docs > 0")
    )


def with_classes(sketched: DataFrame, of_set: DataFrame, also: tuple[str, ...] = (), owner: Callable[[str], Column] = _whole) -> DataFrame:
    """``classes`` of units by the ``linked_sets`` of theirs, with the columns ``also``. ``owner`` makes of a key, by its
    first parts, what it belongs to."""
    # Where no set of a class has several owners, each belongs to the owner of its ``rep``.
    apart = F.max("apart") | (F.min(owner("rep")) != F.max(owner("rep")))
    of_class = of_set.groupBy("class").agg(
        F.min("rep").alias("class_key"), apart.alias("class_apart"), F.sum("copies").alias("class_size")
    )
    by_set = of_set.join(of_class, "class").select(
        "set_id", "class_key", "class_apart", "class_size", (F.col("docs") + F.col("copies") - 1).alias("n_links")
    )
    return (
        sketched.select("key", "set_id", *also)
        .join(by_set, "set_id", "left")
        .select(
            "key",
            *also,
            F.coalesce("class_key", "key").alias("class_key"),
            F.coalesce("class_apart", F.lit(False)).alias("class_apart"),
            F.coalesce("class_size", F.lit(1)).cast("long").alias("class_size"),
            F.coalesce("n_links", F.lit(0)).cast("long").alias("n_links"),
        )
    )
