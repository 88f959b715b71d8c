"""Control-chart checks: zones of samples, run lengths, and the alerts a rule raises.

A rule is eight integers, read as (consecutive, alternating) pairs for zones 1 to 4. Zones are
exact: a sample in zone 3 does not also count for zones 1 and 2.
"""

from functools import reduce
from operator import and_

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from driftwatch.functions.zones import ZONES, zone_code, zone_label
from driftwatch.operators.joins import same_keys_join
from driftwatch.operators.slots import SLOT_SECONDS, shortest_series, slot_offsets, span_of, with_slot

CONSECUTIVE = "Consecutive"
ALTERNATING = "Alternating"


def classify(samples: DataFrame) -> DataFrame:
    """Adds ``code`` to samples that carry their limits."""
    return samples.withColumn("code", zone_code(F.col("value")))


def _rank(code: Column, value: Column) -> Column:
    """Place of a sample among those of the same instant, in the order of values.

    Zones rise with the value, so ordering by zone orders by value; NaN sorts above all numbers and
    NULL below.
    """
    return F.when(value.isNull(), -5).when(F.isnan(value), 5).otherwise(code)


def zone_blocks(classified: DataFrame, group: list[str], slot_seconds: int = SLOT_SECONDS) -> DataFrame:
    """Samples of one series, instant and zone counted together, before the first shuffle."""
    # Joins on these keys would add the same filter to some branches only, and branches that differ
    # cannot share the shuffle of the blocks.
    present = reduce(and_, [F.col(c).isNotNull() for c in group + ["slot"]])
    return (
        with_slot(classified, slot_seconds)
        .where(present)
        .withColumn("rank", _rank(F.col("code"), F.col("value")))
        .groupBy(*group, "slot", "created_at", "rank")
        .agg(F.count(F.lit(1)).alias("n"))
    )


def cut_to_shortest(blocks: DataFrame, service: list[str], group: list[str]) -> DataFrame:
    """Adds ``room``: how many samples of the slot remain once all series of a service are cut to
    the shortest one, newest kept. Slots without room are left out."""
    offsets = slot_offsets(blocks, group, size="n")
    room = (
        same_keys_join(offsets, shortest_series(offsets, service), service)
        .where(F.col("newer") < F.col("keep"))
        .select(*group, "slot", (F.col("keep") - F.col("newer")).alias("room"))
    )
    return same_keys_join(blocks, room, group + ["slot"]).drop("_key")


def _slot_runs(blocks: DataFrame, group: list[str]) -> DataFrame:
    """One row per slot: its first and last code and, for runs and for alternations (chains), the
    length of the first and the last one, whether they are the same, and the longest per zone.

    A running sum numbers the samples of the slot, a running maximum holds where the current run
    began, and their difference is the length so far.
    """
    ordered = Window.partitionBy(*group, "slot").orderBy(F.desc("created_at"), F.desc("rank"))
    so_far = ordered.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = ordered.rowsBetween(Window.unboundedPreceding, -1)

    begin = F.coalesce(F.sum("n").over(before), F.lit(0))
    clipped = (
        blocks.withColumn("begin", begin)
        .select(
            *group,
            "slot",
            "created_at",
            "rank",
            F.when(F.abs("rank") <= 4, F.col("rank")).alias("code"),
            "begin",
            F.least(F.col("begin") + F.col("n"), F.col("room")).alias("end"),
        )
        .where(F.col("begin") < F.col("end"))
    )
    # In a chain a block counts with its first sample, which may continue the alternation, and, if
    # it has several, with its last, which may start another one.
    several = F.col("end") - F.col("begin") > 1
    previous = F.lag("code").over(ordered)
    numbered = clipped.withColumns(
        {
            "same": F.coalesce(F.col("code") == previous, F.lit(False)),
            "flips": F.coalesce((F.col("code") == -previous) & (F.col("code") != 0), F.lit(False)),
            "is_first": F.lag("rank").over(ordered).isNull(),
            "is_last": F.lead("rank").over(ordered).isNull(),
            "several": several,
            "last_at": F.sum(F.when(several, 2).otherwise(1)).over(so_far),
        }
    )
    first_at = F.col("last_at") - F.when(F.col("several"), 1).otherwise(0)
    opened_before = F.max(
        F.when(F.col("several"), F.col("last_at")).when(~F.col("flips"), first_at)
    ).over(before)
    measured = numbered.withColumns(
        {
            "run_start": F.max(F.when(~F.col("same"), F.col("begin"))).over(so_far),
            "chain_start": F.when(F.col("flips"), opened_before).otherwise(first_at),
            "first_at": first_at,
        }
    )
    run = F.col("end") - F.col("run_start")
    chain = F.col("first_at") - F.col("chain_start") + 1
    last_chain = F.when(F.col("several"), 1).otherwise(chain)
    one_chain = (F.col("chain_start") == 1) & ~F.col("several")

    def longest(length: Column, kind: str) -> list[Column]:
        return [
            F.max(F.when(F.abs("code") == zone, length)).alias(f"{kind}_{zone}") for zone in ZONES
        ]

    return measured.groupBy(*group, "slot").agg(
        F.max(F.when(F.col("is_first"), F.col("code"))).alias("first_code"),
        F.max(F.when(F.col("is_last"), F.col("code"))).alias("last_code"),
        F.max(F.when(F.col("run_start") == 0, run)).alias("run_first"),
        F.max(F.when(F.col("is_last"), run)).alias("run_last"),
        F.max(F.when(F.col("is_last"), F.col("run_start") == 0)).alias("run_whole"),
        F.max(F.when(F.col("chain_start") == 1, chain)).alias("chain_first"),
        F.max(F.when(F.col("is_last"), last_chain)).alias("chain_last"),
        F.max(F.when(F.col("is_last"), one_chain)).alias("chain_whole"),
        *longest(run, "run"),
        *longest(chain, "chain"),
    )


_KINDS = {CONSECUTIVE: "run", ALTERNATING: "chain"}


def _joined_runs(summaries: DataFrame, part: list[str], order: str) -> DataFrame:
    """One summary per ``part`` of those that follow each other in it, newest ``order`` first.

    A summary is what ``_slot_runs`` makes of a slot, and joining summaries gives a summary of the same
    kind, so it does not matter in how many steps slots are joined.
    """
    across = Window.partitionBy(*part).orderBy(F.desc(order))
    so_far = across.rowsBetween(Window.unboundedPreceding, Window.currentRow)
    before = across.rowsBetween(Window.unboundedPreceding, -1)

    previous = F.lag("last_code").over(across)
    continues = {
        "run": F.col("first_code") == previous,
        "chain": (F.col("first_code") == -previous) & (previous != 0),
    }
    steps = {"is_first": F.lag(order).over(across).isNull(), "is_last": F.lead(order).over(across).isNull()}
    for kind, goes_on in continues.items():
        own = F.col(f"{kind}_first")
        weight = F.when(F.col(f"{kind}_whole"), own).otherwise(own + F.col(f"{kind}_last"))
        steps[f"{kind}_goes_on"] = F.coalesce(goes_on, F.lit(False))
        steps[f"{kind}_weight"] = weight
        steps[f"{kind}_end"] = F.sum(weight).over(so_far)
    numbered = summaries.withColumns(steps)

    starts = {}
    for kind in continues:
        whole, goes_on = F.col(f"{kind}_whole"), F.col(f"{kind}_goes_on")
        begin = F.col(f"{kind}_end") - F.col(f"{kind}_weight")
        opened_before = F.max(
            F.when(~whole, F.col(f"{kind}_end") - F.col(f"{kind}_last")).when(~goes_on, begin)
        ).over(before)
        start = F.when(goes_on, opened_before).otherwise(begin)
        starts[f"{kind}_start"] = start
        starts[f"{kind}_total"] = begin + F.col(f"{kind}_first") - start

    def only(row: str, value: Column) -> Column:
        return F.max(F.when(F.col(row), value))

    parts = [only("is_first", F.col("first_code")).alias("first_code"), only("is_last", F.col("last_code")).alias("last_code")]
    for kind in continues:
        whole, total, start = F.col(f"{kind}_whole"), F.col(f"{kind}_total"), F.col(f"{kind}_start")
        parts += [
            F.max(F.when(start == 0, total)).alias(f"{kind}_first"),
            only("is_last", F.when(whole, total).otherwise(F.col(f"{kind}_last"))).alias(f"{kind}_last"),
            only("is_last", whole & (start == 0)).alias(f"{kind}_whole"),
        ]
        parts += [
            F.greatest(F.max(f"{kind}_{zone}"), F.max(F.when(F.abs("first_code") == zone, total))).alias(f"{kind}_{zone}")
            for zone in ZONES
        ]
    return numbered.withColumns(starts).groupBy(*part).agg(*parts)


def run_lengths(blocks: DataFrame, group: list[str]) -> DataFrame:
    """Longest run per series, kind and zone, from blocks with ``room``.

    Runs are first found inside each slot. A slot hands on one row, the slots of a span are joined to
    one row, and then the spans of a series: no step sees more than the samples of a slot, the slots of
    a span or the spans of a series.
    """
    slots = _slot_runs(blocks, group).withColumn("span", span_of(F.col("slot")))
    best = _joined_runs(_joined_runs(slots, [*group, "span"], "slot"), group, "span")
    entries = F.array(
        *[
            F.struct(
                F.lit(name).alias("kind"),
                F.lit(zone).alias("zone"),
                F.col(f"{kind}_{zone}").alias("longest"),
            )
            for name, kind in _KINDS.items()
            for zone in ZONES
        ]
    )
    return (
        best.select(*group, F.explode(entries).alias("e"))
        .select(*group, "e.*")
        .where(F.col("longest").isNotNull())
    )


def longest_runs(
    classified: DataFrame,
    service: list[str],
    group: list[str] | None = None,
    truncate: bool = True,
    slot_seconds: int = SLOT_SECONDS,
) -> DataFrame:
    """Longest run per (series, kind, zone); ``truncate`` first cuts a service's series to equal length.

    ``group`` names the columns of a series, by default the service and its feature.
    """
    group = group or service + ["feature"]
    blocks = zone_blocks(classified, group, slot_seconds)
    if truncate:
        blocks = cut_to_shortest(blocks, service, group)
    else:
        blocks = blocks.withColumn("room", F.lit((1 << 63) - 1))
    return run_lengths(blocks, group)


def rule_thresholds(rules: DataFrame, service: list[str]) -> DataFrame:
    """One row per (service, kind, zone) with the shortest run that alerts.

    ``rules`` has ``rule`` (array of eight ints) and ``zones_to_monitor`` (labels; empty means all).
    An alternation needs two samples at least.
    """
    entries = []
    for zone in ZONES:
        at = 2 * (zone - 1)
        for kind, minimum, offset in ((CONSECUTIVE, 1, 0), (ALTERNATING, 2, 1)):
            entries.append(
                F.struct(
                    F.lit(kind).alias("kind"),
                    F.lit(zone).alias("zone"),
                    F.greatest(F.col("rule")[at + offset], F.lit(minimum)).alias("needed"),
                )
            )
    labels = F.coalesce(F.col("zones_to_monitor"), F.array().cast("array<string>"))
    return (
        rules.select(*service, labels.alias("labels"), F.explode(F.array(*entries)).alias("e"))
        .select(*service, "labels", "e.*")
        .where((F.size("labels") == 0) | F.array_contains("labels", zone_label(F.col("zone"))))
        .drop("labels")
    )


def raise_alerts(runs: DataFrame, rules: DataFrame, service: list[str]) -> DataFrame:
    """One row per (series, zone, kind) whose longest run reaches the rule."""
    return (
        runs.join(rule_thresholds(rules, service), service + ["kind", "zone"])
        .where(F.col("longest") >= F.col("needed"))
        .select(*service, "feature", zone_label(F.col("zone")).alias("zone"), "kind")
    )
