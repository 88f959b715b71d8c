"""Source divergence against a plain count in Python."""

import random
import re
from collections import Counter, defaultdict

import pytest

from driftwatch.llm import divergence

SCHEMA = "doc_id long, text string, lang string, source string, n long, term string, share long, block long, value long"


def frame(spark, rows):
    return spark.createDataFrame([(k, *r, 1, "t", 2, 3, 4) for k, r in enumerate(rows)], SCHEMA)


def brute(rows, min_docs=10):
    """The contract, word for word."""
    rows = [tuple(v or "" for v in r) for r in rows]
    words = [re.findall(r"[^\x00-\x40\x5B-\x60\x7B-\x7F]+", "".join(c.lower() if "A" <= c <= "Z" else c for c in t)) for t, _, _ in rows]
    out = []
    for lang in {r[1] for r in rows}:
        docs, total, count = Counter(), Counter(), defaultdict(Counter)
        for (_, own, source), found in zip(rows, words):
            if own == lang:
                docs.update(set(found))
                total.update(found)
                count[source].update(found)
        kept = [t for t in docs if docs[t] >= min_docs]

        def shares(counts):
            n = sum(counts[t] for t in kept)
            return {t: 1 + 1_000_000_000 * (counts[t] + 2) // (n + 2 * len(kept)) for t in kept}

        p, q = {s: shares(c) for s, c in count.items()}, shares(total)
        f = lambda x, y: (x - y) ** 2 // (x + y)
        for s in count:
            parts = {
                "pair": [(sum(f(p[s][t], p[o][t]) for t in kept), o) for o in count if o != s],
                "term": [(f(p[s][t], q[t]), t) for t in kept if count[s][t] and p[s][t] > q[t]],
            }
            for part, found in parts.items():
                ordered = sorted(found, key=lambda x: (-x[0], x[1].encode()))
                out += [(lang, s, part, item, v, k + 1) for k, (v, item) in enumerate(ordered) if part == "pair" or k < 10]
    return sorted(out)


def made(df):
    return sorted(tuple(r) for r in df.select("lang", "source", "part", "item", "value", "rank").collect())


@pytest.mark.parametrize("small", [False, True])
def test_against_brute_force(spark, monkeypatch, small):
    """With small limits, groups and terms are cut into many blocks and counts are given up often."""
    if small:
        for name, value in {"GROUPS": 2, "TERMS": 5, "HELD": 7, "CHUNK_BYTES": 11}.items():
            monkeypatch.setattr(divergence, name, value)
    rng = random.Random(5)
    terms = [f"{w}" for w in "alpha Beta gamma DELTA épée École 日本 zeta eta theta iota kappa lambda mu nu xi omicron".split()]
    rows = [
        (" ".join(rng.choices(terms, k=rng.randint(0, 30))) + ", 12x!", rng.choice(["en", "de", None]), rng.choice(["a", "b", "c", "d", "e", None, "é"]))
        for _ in range(150)
    ]
    rows += [(None, "en", "silent"), ("", "xx", "one"), ("rare words", "xx", "two"), ("once", "alone", "only")]
    assert made(divergence.source_divergence(frame(spark, rows))) == brute(rows)


def test_edge_cases(spark):
    assert made(divergence.source_divergence(frame(spark, []))) == []
    rows = [("Same same", "en", "a")] * 12 + [("same", "en", "b")] * 3 + [("w " * 100_000, "en", "b")]
    assert made(divergence.source_divergence(frame(spark, rows))) == brute(rows)
    assert made(divergence.source_divergence(frame(spark, [(None, None, None)]))) == []


def test_a_large_source_leaves_few_rows_for_the_shuffle(spark):
    """Counts of a source are summed in the task that reads it."""
    docs = frame(spark, [("one two three two", "en", "big")] * 500).coalesce(1)
    got = {(r["term"], r["n"], r["docs"]) for r in divergence.term_counts(docs).collect()}
    assert got == {("one", 500, 500), ("two", 1000, 500), ("three", 500, 500)}
