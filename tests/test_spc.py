import datetime as dt
import itertools
import math
import random
import re

import pytest
from pyspark.sql import functions as F

from driftwatch.operators import series, slots, spc
from driftwatch.schemas import SERIES, SERVICE

START = dt.datetime(2024, 1, 1, tzinfo=dt.timezone.utc)
LIMITS = dict(
    center=0.0, one_ucl=1.0, one_lcl=-1.0, two_ucl=2.0, two_lcl=-2.0, three_ucl=3.0, three_lcl=-3.0
)
SAMPLES = "repository string, name string, version string, feature string, created_at timestamp, value double"


def code_of(v):
    if v is None or math.isnan(v):
        return None
    if abs(v) > 3:
        return 4 if v > 0 else -4
    for zone, bound in ((3, 2), (2, 1)):
        if abs(v) >= bound:
            return zone if v > 0 else -zone
    return 0 if v == 0 else (1 if v > 0 else -1)


def runs_of(series):
    """Longest runs by walking through one series, newest first."""
    key = lambda r: (r[0], 2 if r[1] is not None and math.isnan(r[1]) else 0 if r[1] is None else 1,
                     0 if r[1] is None or math.isnan(r[1]) else r[1])
    codes = [code_of(v) for _, v in sorted(series, key=key, reverse=True)]
    best = {}
    for kind, joins in (
        ("Consecutive", lambda a, b: a == b),
        ("Alternating", lambda a, b: a == -b),
    ):
        length = 0
        for i, code in enumerate(codes):
            previous = codes[i - 1] if i else None
            linked = code is not None and previous is not None and code != 0 and joins(previous, code)
            length = length + 1 if linked else 1
            if code:
                k = (kind, abs(code))
                best[k] = max(best.get(k, 0), length)
    return best


def samples(spark, rows):
    df = spark.createDataFrame(
        [("r", "n", "v", f, START + dt.timedelta(seconds=t), v) for f, t, v in rows], SAMPLES
    )
    return spc.classify(df.withColumns({k: F.lit(v) for k, v in LIMITS.items()}))


@pytest.mark.parametrize("slot_seconds, span_slots", [(1, 8640), (1, 3), (7, 2), (100_000, 1)])
@pytest.mark.parametrize("seed", [1, 2])
def test_runs_match_a_walk(spark, monkeypatch, seed, slot_seconds, span_slots):
    """Random series with ties, gaps, NULL and NaN, whatever the slots and spans cut apart."""
    monkeypatch.setattr(slots, "SPAN_SLOTS", span_slots)
    rng = random.Random(seed)
    values = [-3.5, -2.5, -1.5, -0.5, 0.0, 0.5, 1.5, 2.5, 3.5]
    rows = []
    for f in range(12):
        for _ in range(rng.randint(1, 60)):
            pool = rng.choice([values, [0.5, -0.5], [1.5], [None, 0.5], [float("nan"), 3.5, -3.5]])
            t = rng.randint(0, 25 if f % 2 else 60)
            rows.append((f"f{f}", t, rng.choice(pool)))
    found = spc.longest_runs(samples(spark, rows), SERVICE, truncate=False, slot_seconds=slot_seconds)
    got = {(r.feature, r.kind, r.zone): r.longest for r in found.collect()}
    expected = {}
    for f, group in itertools.groupby(sorted(rows, key=lambda r: r[0]), key=lambda r: r[0]):
        for (kind, zone), n in runs_of([(t, v) for _, t, v in group]).items():
            expected[(f, kind, zone)] = n
    assert got == expected


@pytest.mark.parametrize("slot_seconds, span_slots", [(1, 8640), (1, 2), (5, 3)])
def test_truncation_keeps_the_newest(spark, monkeypatch, slot_seconds, span_slots):
    monkeypatch.setattr(slots, "SPAN_SLOTS", span_slots)
    rows = [("a", t, 0.5) for t in range(20)] + [("b", 5, 1.5)] * 7 + [("b", 6, -1.5)]
    found = spc.longest_runs(samples(spark, rows), SERVICE, slot_seconds=slot_seconds)
    got = {(r.feature, r.kind, r.zone): r.longest for r in found.collect()}
    assert got == {
        ("a", "Consecutive", 1): 8,
        ("a", "Alternating", 1): 1,
        ("b", "Consecutive", 2): 7,
        ("b", "Alternating", 2): 2,
    }


def test_a_very_large_tie_is_counted_not_listed(spark):
    """Half a million equal samples at one instant reach the windows as one row."""
    many = spark.range(500_000).select(
        *[F.lit("x").alias(c) for c in SERIES], F.lit(START).alias("created_at"), F.lit(0.5).alias("value")
    )
    classified = spc.classify(many.withColumns({k: F.lit(v) for k, v in LIMITS.items()}))
    assert spc.zone_blocks(classified, SERIES).count() == 1
    runs = {r.kind: r.longest for r in spc.longest_runs(classified, SERVICE).collect()}
    assert runs == {"Consecutive": 500_000, "Alternating": 1}


def test_boundaries(spark):
    values = [3.0, 3.1, 2.0, 1.0, 0.0, -0.1, -1.0, -2.0, -3.0, -3.1, None, float("nan")]
    rows = samples(spark, [("a", i, v) for i, v in enumerate(values)]).orderBy("created_at").collect()
    assert [r.code for r in rows] == [3, 4, 3, 2, 0, -1, -2, -3, -3, -4, None, None]


def test_rule(spark):
    rules = spark.createDataFrame(
        [("r", "n", "v", [4, 4, 4, 8, 2, 4, 1, 1], ["Zone 1", "Zone 4"]), ("r", "m", "v", [1] * 8, [])],
        "repository string, name string, version string, rule array<int>, zones_to_monitor array<string>",
    )
    got = {(r.name, r.kind, r.zone): r.needed for r in spc.rule_thresholds(rules, SERVICE).collect()}
    assert {k[1:]: n for k, n in got.items() if k[0] == "n"} == {
        ("Consecutive", 1): 4,
        ("Alternating", 1): 4,
        ("Consecutive", 4): 1,
        ("Alternating", 4): 2,
    }
    assert len([k for k in got if k[0] == "m"]) == 8


def window_parts(df):
    """(partition columns, first order column) of every window of a plan."""
    plan = df._jdf.queryExecution().optimizedPlan().toString()
    return [
        (set(re.findall(r"(\w+)#", parts)), order)
        for parts, order in re.findall(r"windowspecdefinition\(((?:\w+#\w+, )+)(\w+)#\w+ (?:DESC|ASC)", plan)
    ]


def test_no_window_holds_all_slots_of_a_series(spark):
    """Windows over slots stay within a span, and those over a series see one row per span."""
    classified = samples(spark, [("a", 1, 0.5)])
    values = classified.select(*SERIES, "created_at", "value")
    for df in (spc.longest_runs(classified, SERVICE), series.with_positions(values)):
        seen = window_parts(df)
        assert any(order == "_span" or order == "span" for _, order in seen)
        assert all({"_span", "span"} & parts for parts, order in seen if order == "slot")
        # Samples themselves are ordered within a slot only.
        assert all({"slot", "_key"} & parts for parts, order in seen if order == "created_at")


def test_offsets_over_spans(spark, monkeypatch):
    monkeypatch.setattr(slots, "SPAN_SLOTS", 3)
    rng = random.Random(4)
    rows = [("a" if rng.random() < 0.8 else None, rng.randint(-40, 40)) for _ in range(300)]
    df = spark.createDataFrame(rows, "g string, slot bigint")
    got = {(r.g, r.slot): (r.rows, r.newer, r.total) for r in slots.slot_offsets(df, ["g"]).collect()}
    for g, slot in set(rows):
        own = [s for k, s in rows if k == g]
        assert got[g, slot] == (own.count(slot), sum(s > slot for s in own), len(own))
    assert len(got) == len(set(rows))
