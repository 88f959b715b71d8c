"""Hard negatives against scores of all pairs."""

import math
import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import hard_negatives

SCHEMA = "vec_id long, embedding array<float>, label int, row long, data string, means int, is_anchor string, score long"
NAMES = ["anchor_id", "positive_id", "rank", "negative_id", "positive_score", "negative_score"]


def frame(spark, rows):
    return spark.createDataFrame([(*r, 1, "x", 2, "y", 3) for r in rows], SCHEMA)


def brute(rows, positives=5, negatives=10):
    kept = []
    for i, v, label in rows:
        if label is not None and v is not None and all(x is not None and math.isfinite(x) for x in v):
            kept.append((i, [math.floor(256 * float(np.float32(x))) for x in v], label))
    out = []
    score = lambda a, b: sum(x * y for x, y in zip(a, b))
    order = lambda x: (-x[0], x[1] is None, x[1] or 0)
    for a, (ai, av, al) in enumerate(kept):
        if ai is None or ai % 10:
            continue
        scored = [(score(av, v), i, label == al) for k, (i, v, label) in enumerate(kept) if k != a]
        for p, pi, _ in sorted((s for s in scored if s[2]), key=order)[:positives]:
            fit = sorted((s for s in scored if not s[2] and 30 * p <= 100 * s[0] <= 90 * p), key=order)
            out += [(ai, pi, k + 1, ni, p, n) for k, (n, ni, _) in enumerate(fit[:negatives])]
    return sorted(out, key=repr)


def made(spark, rows):
    indexed = hard_negatives.index(frame(spark, rows))
    found = hard_negatives.mine(indexed, F.col("vec_id") % 10 == 0)
    return sorted((tuple(r) for r in found.select(*NAMES).collect()), key=repr)


@pytest.mark.parametrize("small", [False, True])
def test_against_all_pairs(spark, monkeypatch, small):
    """With small limits there are many cells, and bounds are used long before all rows are seen."""
    if small:
        for name, value in {"CELL_ROWS": 40, "ANCHORS": 3, "ROWS": 16}.items():
            monkeypatch.setattr(hard_negatives, name, value)
    rng = np.random.default_rng(3)
    centres = rng.normal(size=(4, 21))
    rows = []
    for k in range(260):
        label = int(rng.integers(4))
        rows.append((k, (centres[label] + rng.normal(size=21)).round(2).tolist(), label))
    rows += [(1000 + k, rows[k][1], rows[k][2]) for k in range(0, 60, 3)]  # equal vectors, ties by id
    assert made(spark, rows) == brute(rows)


def test_edge_cases(spark):
    one = [1.0, 0.5, -0.25]
    rows = [
        (0, one, 1), (0, one, 1), (1, one, 1), (2, [0.5, 0.5], 2), (3, [0.5, 0.5], 2), (None, [0.5, 0.5], 2), (None, one, 1),
        (4, None, 2), (5, [float("nan")], 2), (6, [float("inf")], 1), (7, [None], 2), (8, one, None), (10, [], 2), (20, [], 3),
        (30, [-1.0, -1.0], 9), (9, [1.0, 1.0], 9), (40, one, 7),
    ]
    assert made(spark, rows) == brute(rows)
    assert made(spark, []) == []
    with pytest.raises(Exception, match="too long for 64-bit"):
        made(spark, [(0, [1e30], 1), (1, [1.0], 1)])


def test_bounds_hold():
    rng = random.Random(1)
    for width in (1, 3, 16, 50):
        x, y = (np.array([[rng.randint(-300, 300) for _ in range(width)]], float) for _ in range(2))
        (mx, dx), (my, dy) = hard_negatives.summaries(x), hard_negatives.summaries(y)
        for span in hard_negatives._spans(width):
            centre, spread = (mx[:, span] * my[:, span]).sum(), (dx[:, span] * dy[:, span]).sum() + 1e-6
            assert centre - spread <= (x * y).sum() <= centre + spread
