"""Exact and near duplicates against brute force."""

import hashlib
import itertools
import re

import numpy as np
import pandas as pd
import pyarrow as pa
import pyarrow.compute
import pytest
from pyspark.sql import functions as F

from driftwatch.llm import blocks, decontaminate, exact_dedup, jaccard_join, paragraph_dedup, sets
from driftwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
SCHEMA = "doc_id long, text string, id string, digest string, keep_id long, key string, comp int"


def frame(spark, rows):
    return spark.createDataFrame([(*r, "x", "y", 1, "z", 2) for r in rows], SCHEMA)


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def shingle_set(text, size=5):
    words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(text))
    if 0 < len(words) < size:
        return frozenset([tuple(words)])
    return frozenset(tuple(words[k : k + size]) for k in range(len(words) - size + 1))


def brute_classes(units, similarity=0.8):
    """{key: (smallest key of its class, class size, links)} of {key: text}; repeated keys as a list."""
    found = [(k, shingle_set(t)) for k, t in units]
    root = list(range(len(found)))

    def top(i):
        while root[i] != i:
            i = root[i]
        return i

    links = [0] * len(found)
    for i, j in itertools.combinations(range(len(found)), 2):
        a, b = found[i][1], found[j][1]
        if a and b and len(a & b) >= similarity * len(a | b):
            links[i] += 1
            links[j] += 1
            root[max(top(i), top(j))] = min(top(i), top(j))
    members = {}
    for i in range(len(found)):
        members.setdefault(top(i), []).append(found[i][0])
    return sorted((found[i][0], min(members[top(i)]), len(members[top(i)]), links[i]) for i in range(len(found)))


def test_exact_edge_cases(spark, tmp_path):
    docs = frame(
        spark,
        [(1, "Abc"), (2, "aBC"), (3, None), (4, ""), (5, "É"), (6, "é"), (7, "x"), (7, "x"), (None, "x"), (None, "alone"), (8, "w " * 200_000)],
    )
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    got = {(r["id"], r["keep_id"], r["copies"], r["kept"]) for r in index.add(docs).collect()}
    assert got == {
        (1, 2, 2, False),
        (2, 2, 2, True),
        (3, 4, 2, False),
        (4, 4, 2, True),
        (5, 5, 1, True),
        (6, 6, 1, True),
        (7, 7, 3, True),
        (None, 7, 3, False),
        (None, None, 1, True),
        (8, 8, 1, True),
    }
    kept = exact_dedup.distinct_documents(docs)
    assert kept.columns == docs.columns
    assert sorted((r["doc_id"] or 0) for r in kept.collect()) == [0, 2, 4, 5, 6, 7, 8]


def test_exact_later_batches(spark, tmp_path):
    path = str(tmp_path / "index")
    index = exact_dedup.DigestIndex(spark, path, 4)
    index.add(frame(spark, [(1, "a"), (2, "b")])).collect()
    again = exact_dedup.DigestIndex(spark, path, 4)  # another session opens the same folder
    got = {(r["id"], r["keep_id"], r["kept"]) for r in again.add(frame(spark, [(9, "A"), (10, "c")])).collect()}
    assert got == {(9, 1, False), (10, 10, True)}
    assert again.stored().count() == 3
    assert again.add(frame(spark, [])).count() == 0


def test_a_batch_added_again_reports_the_same(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    docs = frame(spark, [(1, "a"), (2, "A"), (3, "b"), (None, "c")])
    report = lambda: sorted(map(str, index.add(docs, batch="first").collect()))
    once = report()
    assert report() == once and sum("kept=True" in r for r in once) == 3
    # A crash after the digests were stored and before the report: the next try reports them as new.
    rows = docs.selectExpr("doc_id AS id", "unhex(sha2(lower(text), 256)) AS digest")
    other = exact_dedup.DigestIndex(spark, str(tmp_path / "other"), 4)
    other.append(rows, "first")
    assert sorted(map(str, other.add(docs, batch="first").collect())) == once
    # Under another name they are known.
    assert not any(r["kept"] for r in index.add(docs, batch="second").collect())
    assert index.stored().count() == 3


def test_a_rewritten_index_has_one_file_a_bucket(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    for k in range(3):
        index.add(frame(spark, [(j, f"text {j}") for j in range(20 * k, 20 * k + 40)]))
    with index.rewritten(str(tmp_path / "new")) as new:
        assert sorted(map(str, new.stored().collect())) == sorted(map(str, index.stored().collect()))
        assert len(list((tmp_path / "new").glob("*.parquet"))) <= 4 < len(list((tmp_path / "index").glob("*.parquet")))
        assert {(r["id"], r["kept"]) for r in new.add(frame(spark, [(500, "TEXT 3"), (501, "new")])).collect()} == {(500, False), (501, True)}
        name = new.table
    assert not spark.catalog.tableExists(name) and spark.catalog.tableExists(index.table)


def test_the_report_does_not_shuffle_the_index(spark, tmp_path):
    """The index meets the batch's distinct digests by its buckets: nothing is exchanged above its scan."""
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(frame(spark, [(1, "a"), (2, "b")])).collect()
    digests = spark.createDataFrame([(hashlib.sha256(b"a").digest(),)], "digest binary")
    for how in ("inner", "left_anti"):
        plan = index.of_stored(digests, how)._jdf.queryExecution().executedPlan().toString()
        right = plan[: plan.index("SelectedBucketsCount")].rsplit("SortMergeJoin", 1)[1]
        assert right.count("Exchange") == 1  # that of the batch


def test_exact_index_is_joined_by_its_buckets(spark, tmp_path):
    index = exact_dedup.DigestIndex(spark, str(tmp_path / "index"), 4)
    index.add(frame(spark, [(1, "a"), (2, "b")]))
    stored = index.stored()
    other = spark.createDataFrame([(hashlib.sha256(b"a").digest(),)], "digest binary")
    plan = other.join(stored.select("digest").hint("merge"), "digest", "left_anti")._jdf.queryExecution().toString()
    assert "SortMergeJoin" in plan and "SelectedBucketsCount: 4" in plan


@pytest.mark.parametrize("small", [False, True])
def test_jaccard_against_brute_force(spark, monkeypatch, small):
    """With small limits buckets are split again and components are cut into chunks."""
    if small:
        monkeypatch.setattr(sets, "BUCKET", 3)
        monkeypatch.setattr(sets, "CHUNK", 4)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(200)
    rows = [(r["doc_id"], r["text"]) for r in docs.collect()]
    base = max(rows, key=lambda r: 300 < len(r[1]) < 4000)[1]
    words = base.split(" ")
    for k in range(12):  # near copies of each other, each with another word changed
        changed = list(words)
        changed[k * 3] = f"other{k}"
        rows.append((10_000 + k, " ".join(changed)))
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    got = jaccard_join.jaccard_classes(docs).collect()
    got = sorted((r["id"], r["class_id"], r["class_size"], r["n_links"]) for r in got)
    assert got == brute_classes(rows)


def test_jaccard_edge_cases(spark):
    same = "one two three four five six seven"
    docs = frame(spark, [(1, None), (2, ""), (3, "a b"), (4, "A, b!"), (5, "..."), (6, same), (6, same), (7, same + "\n"), (None, same)])
    got = sorted(((r["id"] or -1), (r["class_id"] or -1), r["class_size"], r["n_links"]) for r in jaccard_join.jaccard_classes(docs).collect())
    assert got == [(-1, -1, 4, 3), (1, 1, 1, 0), (2, 2, 1, 0), (3, 3, 2, 1), (4, 3, 2, 1), (5, 5, 1, 0), (6, -1, 4, 3), (6, -1, 4, 3), (7, -1, 4, 3)]
    assert jaccard_join.jaccard_classes(frame(spark, [])).count() == 0
    stay = jaccard_join.one_of_each(frame(spark, [(3, "a b"), (4, "A, b!"), (1, None)]))
    assert stay.columns == frame(spark, []).columns and sorted(r["doc_id"] for r in stay.collect()) == [1, 3]


def test_runs_reach_the_recall():
    miss = 1 - 0.8 * jaccard_join.survival(0.8)
    assert miss ** jaccard_join.n_runs(0.8, 0.9999) <= 1e-4


def test_paragraph_classes_against_brute_force(spark, monkeypatch):
    """Every class of near-equal paragraphs, short ones included."""
    monkeypatch.setattr(paragraph_dedup, "ENTRIES", 64)
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(60)
    units = [((r["key"]["id"], r["key"]["place"]), r["text"]) for r in paragraph_dedup._units(docs, "doc_id", "text").collect()]
    want = {(k, c, n, links) for k, c, n, links in brute_classes(units) if n > 1}
    found = paragraph_dedup.repeated_passages(docs, min_words=0, recall=0.9999, within=True).collect()
    got = {((r["id"], r["paragraph"]), (r["class_id"], r["class_paragraph"]), r["class_size"], r["n_links"]) for r in found}
    assert got == want and len(want) > 20


def test_passages_of_fifty_words_are_found(spark):
    """Documents that share fifty words in a row, wherever they stand in a line or across lines."""
    docs = spark.read.parquet("/root/testdata/sf0.01/documents.parquet").select("doc_id", "text")
    owners = {}
    for r in docs.collect():
        words = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(r["text"]))
        for k in range(len(words) - 49):
            owners.setdefault(hash(tuple(words[k : k + 50])), set()).add(r["doc_id"])
    want = {d for own in owners.values() if len(own) > 1 for d in own}
    found = QUERIES["op7_paragraph_dedup"](spark, "/root/testdata/sf0.01")
    assert found.columns[0] == "doc_id"
    got = {r["doc_id"] for r in found.select("doc_id").distinct().collect()}
    assert len(want) > 100 and len(want & got) >= 0.95 * len(want)
    assert len(got - want) < 0.05 * docs.count()


def test_paragraphs_lie_where_they_say(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(80)
    texts = {r["doc_id"]: r["text"].encode() for r in docs.collect()}
    spans = paragraph_dedup.paragraphs(docs).select("key", "begin", "end", "words").collect()
    units = {tuple(r["key"]): r["text"] for r in paragraph_dedup._units(docs, "doc_id", "text").collect()}
    assert len(units) == len(spans) > 500
    word = lambda t: re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", lower(t))
    for r in spans:
        own = texts[r["key"]["id"]][r["begin"] : r["end"]].decode()
        assert lower(own) == units[tuple(r["key"])] and len(word(own)) == r["words"] and "\n" not in own
    together = {}
    for r in sorted(spans, key=lambda r: r["key"]["place"]):
        together.setdefault(r["key"]["id"], []).extend(word(units[tuple(r["key"])]))
    assert all(found == word(texts[d].decode()) for d, found in together.items())


def test_paragraph_edge_cases(spark):
    passage = " ".join(f"w{k}" for k in range(60))
    own, other = " ".join(f"a{k}" for k in range(30)), " ".join(f"b{k}" for k in range(30))
    rows = [(1, own + "\n" + passage), (2, passage + ".\n" + other), (3, None), (4, ""), (None, passage), (5, "short"), (6, "short")]
    # One id twice: only the text that repeats is changed; a row repeated whole is one document.
    rows += [(2, "unrelated " + " ".join(f"c{k}" for k in range(40))), (8, own * 2 + " tail"), (8, own * 2 + " tail")]
    docs = named(spark, rows)
    found = paragraph_dedup.repeated_passages(docs).collect()
    assert {r["id"] for r in found} == {None, 1, 2} and {r["id"] for r in found if r["kept"]} == {None}
    assert paragraph_dedup.repeated_passages(named(spark, [])).count() == 0
    left = paragraph_dedup.without_repeats(docs)
    assert left.columns == docs.columns
    texts = sorted(((r["doc_id"] or 0), r["text"] or "") for r in left.collect())
    want = [(0, passage), (1, own + "\n"), (2, ".\n" + other), (3, ""), (4, ""), (5, "short"), (6, "short"), rows[-3], rows[-2], rows[-1]]
    spaces = lambda rows: sorted((d, " ".join(t.split())) for d, t in rows)
    assert spaces(texts) == spaces(want)


def test_repeats_within_a_document_are_left_unless_asked_for(spark):
    line = " ".join(f"w{k}" for k in range(40))
    docs = frame(spark, [(1, line + "\n" + line), (2, "something else")])
    assert paragraph_dedup.repeated_passages(docs).count() == 0
    assert {r["id"] for r in paragraph_dedup.repeated_passages(docs, within=True).collect()} == {1}
    left = {r["doc_id"]: r["text"] for r in paragraph_dedup.without_repeats(docs, within=True).collect()}
    assert " ".join(left[1].split()) == line


def test_bands_reach_the_recall():
    number, width = paragraph_dedup.tune_bands(0.8, 0.98)
    assert 1 - (1 - 0.8**width) ** number >= 0.98 and number * width <= paragraph_dedup.ENTRIES


def test_components_of_a_chain_and_a_star(spark):
    chain = [(k, k + 1) for k in range(40)]
    star = [(100, 100 + k) for k in range(1, 50)]
    edges = spark.createDataFrame(chain + star, "a long, b long")
    got = sets.components(edges).toPandas()
    want = pd.DataFrame({"node": [*range(41), *range(100, 150)], "comp": [0] * 41 + [100] * 50})
    assert got.sort_values("node").reset_index(drop=True).equals(want)


def test_components_that_settle_at_different_times(spark, monkeypatch):
    import random

    rng = random.Random(4)
    edges, names = [], rng.sample(range(-(10**6), 10**6), 1200)
    at = 0
    for size in [2] * 60 + [3] * 20 + [10] * 10 + [400, 120]:  # chains in any order, and a ring
        own = names[at : at + size]
        at += size
        edges += list(zip(own, own[1:]))
    edges += [(own[-1], own[0]), *edges[:30]]
    linked = {}
    for a, b in edges:
        one = linked.get(a, {a}) | linked.get(b, {b})
        linked.update(dict.fromkeys(one, one))
    want = {n: min(one) for n, one in linked.items()}
    monkeypatch.setattr(sets, "ROUNDS", 2)
    both = sets.components(spark.createDataFrame(edges, "a long, b long"))
    got = [tuple(r) for r in both.select("node", "comp").collect()]
    assert dict(got) == want and len(got) == len(want) and both.columns == ["node", "comp"]


NAMES = "doc_id long, text string, `__id` string, `__key` string, key string, row string, set_id int, id int, `__words` int, `__spans` int"


def named(spark, rows):
    """Rows with columns named like internal ones of the operators."""
    return spark.createDataFrame([(*r, "a", "b", "c", "d", 1, 2, 3, 4) for r in rows], NAMES)


def test_one_of_each_decides_on_rows_not_on_ids(spark):
    text = " ".join(f"w{k}" for k in range(40))
    near, other = text.replace("w3 ", "x3 "), " ".join(f"v{k}" for k in range(30))
    docs = named(spark, [(1, text), (5, near), (5, other), (None, text + "\n"), (None, near + " "), (None, "alone here"), (9, other), (9, other), (None, None), (None, None)])
    kept = jaccard_join.one_of_each(docs)
    assert kept.columns == docs.columns and kept.dtypes == docs.dtypes
    got = kept.collect()
    assert all(tuple(r)[2:] == ("a", "b", "c", "d", 1, 2, 3, 4) for r in got)
    left = sorted(((r["doc_id"] or 0), (r["text"] or "")[:3].strip()) for r in got)
    # One of the four near texts (a null id is below all others), one of the three others, and all without words.
    assert left == [(0, ""), (0, ""), (0, "alo"), (0, "w0"), (5, "v0")]
    repeated = jaccard_join.one_of_each(named(spark, [(9, other), (9, other)]))
    assert repeated.count() == 1


def test_callers_columns_come_through(spark):
    docs = named(spark, [(1, "Some text"), (2, "some TEXT"), (3, None), (3, None)])
    once = exact_dedup.distinct_documents(docs)
    assert once.columns == docs.columns and sorted(r["doc_id"] for r in once.collect()) == [2, 3]
    assert all(tuple(r)[2:] == ("a", "b", "c", "d", 1, 2, 3, 4) for r in once.collect())
    items = spark.createDataFrame([(7, "some text")], "item_id long, text string")
    clean = decontaminate.clean_documents(docs, items)
    assert clean.columns == docs.columns and [r["doc_id"] for r in clean.collect()] == [3, 3]


def test_a_group_over_several_batches_stays_whole():
    batch = lambda *rows: pa.RecordBatch.from_pylist([{"k": k, "text": t} for k, t in rows])
    batches = [batch((1, "a"), (2, "b")), batch((2, "c")), batch((2, "d"), (3, "e")), batch((3, "f"))]
    groups = []
    for rows, first in sets.runs(batches, ["k"]):
        assert pa.types.is_large_string(rows.schema.field("text").type)
        for s, e in zip(first, [*first[1:], rows.num_rows] if first[-1] < rows.num_rows else first[1:]):
            groups.append((rows.column("k")[s].as_py(), rows.column("text").slice(s, e - s).to_pylist()))
    assert groups == [(1, ["a"]), (2, ["b", "c", "d"]), (3, ["e", "f"])]


@pytest.mark.parametrize("similarity", [0.6, 0.8])
def test_recall_of_candidates(spark, similarity):
    """Share of pairs at the similarity that candidate links find, with buckets that must be split."""
    import random

    rng = random.Random(2)
    rows = []
    for k in range(400):
        words = [f"t{rng.randrange(5000)}" for _ in range(120)]
        rows.append((2 * k, " ".join(words)))
        for at in rng.sample(range(120), 2 if similarity == 0.8 else 6):
            words[at] = f"u{rng.randrange(5000)}"
        rows.append((2 * k + 1, " ".join(words)))
    want = {k for k in range(400) if (lambda a, b: len(a & b) >= similarity * len(a | b))(shingle_set(rows[2 * k][1]), shingle_set(rows[2 * k + 1][1]))}
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    found = jaccard_join.jaccard_classes(docs, similarity=similarity).filter("class_size > 1 AND id <> class_id")
    got = {r["class_id"] // 2 for r in found.collect()}
    assert len(want) > 200 and got == want


def test_too_small_a_sketch_is_refused(spark):
    with pytest.raises(ValueError, match="too small"):
        jaccard_join.jaccard_classes(frame(spark, []), similarity=0.1)


@pytest.mark.parametrize("size", [60, 80])
def test_passages_inside_lines_are_found(spark, size):
    """Passages that stand in the midst of a line of two otherwise different documents."""
    import random

    rng = random.Random(size)
    some = lambda n: [f"w{rng.randrange(10**6)}" for _ in range(n)]
    rows = []
    for k in range(150):
        passage = some(size)
        for d in (2 * k, 2 * k + 1):
            rows.append((d, " ".join([*some(rng.randrange(20, 60)), *passage, *some(rng.randrange(20, 60))])))
    rows += [(1000 + k, " ".join(some(120))) for k in range(100)]
    found = {r["id"] for r in paragraph_dedup.repeated_passages(frame(spark, rows)).select("id").distinct().collect()}
    assert len(found & set(range(300))) >= (0.8 if size == 60 else 0.95) * 300 and not found & set(range(1000, 1100))


def test_sets_too_small_to_be_similar_have_no_bands(spark):
    assert [paragraph_dedup.least_shingles(s) for s in (0.5, 0.8, 0.9)] == [1, 4, 9]
    docs = frame(spark, [(k, " ".join(f"w{j}" for j in range(k))) for k in range(1, 13)])
    rows = paragraph_dedup.paragraphs(docs, least=4).select("shingles", F.size("bands").alias("n")).collect()
    assert {(r["shingles"] >= 4, r["n"]) for r in rows} == {(False, 0), (True, 4)}


def test_bands_take_six_bytes(spark):
    """Bands are carried end to end, and equal paragraphs have all of theirs in common."""
    line = " ".join(f"w{j}" for j in range(12))
    docs = frame(spark, [(1, line), (2, line), (3, line.replace("w5", "other")), (4, "too short")])
    rows = paragraph_dedup.packed_paragraphs(docs, "doc_id", "text", 4, 2, 4).collect()
    assert {(r["shingles"] >= 4, len(r["bands"])) for r in rows} == {(False, 0), (True, 24)}
    packed = {r["key"]: bytes(r["bands"]) for r in rows}
    listed = {r["key"]: b"".join(map(bytes, r["bands"])) for r in paragraph_dedup.paragraphs(docs, least=4).collect()}
    assert packed == listed
    sets_found = sets.distinct_sets(paragraph_dedup.packed_paragraphs(docs, "doc_id", "text", 4, 2, 4), "bands", lambda key: F.col(f"{key}.id"))
    found = sets_found.select("rep.id", "copies", "apart").collect()
    assert {(r["id"], r["apart"]) for r in found if r["id"] in (1, 4)} == {(1, True), (4, False)}


def test_wanted_paragraphs_alone_are_made(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").limit(40)
    every = {tuple(r["key"]): r["text"] for r in paragraph_dedup._units(docs, "doc_id", "text").collect()}
    keys = paragraph_dedup.paragraphs(docs).filter("key.place % 3 = 1").select(F.col("key").alias("rep"))
    some = {tuple(r["key"]): r["text"] for r in paragraph_dedup._units(docs, "doc_id", "text", keys).collect()}
    assert some == {k: t for k, t in every.items() if k[2] % 3 == 1} and some


def test_pinned_tables_leave_no_shuffle_files(spark):
    """What a step shuffles is gone when its table is written."""
    from driftwatch.session import pin

    def held():
        blocks = spark._jvm.org.apache.spark.SparkEnv.get().blockManager().diskBlockManager()
        return sum("/shuffle_" in name for name in blocks.getAllFiles().mkString("\n").split("\n"))

    before = held()
    made = pin(spark.range(1000).groupBy((F.col("id") % 7).alias("k")).count())
    assert held() <= before and made.count() == 7


def test_units_alone_are_not_carried_further(spark, monkeypatch):
    """Of sets, only those with copies or links are written after the comparison."""
    written = []
    pin = sets.pin

    def noted(df, *args, **kwargs):
        out = pin(df, *args, **kwargs)
        written.append((out.columns, out))
        return out

    monkeypatch.setattr(sets, "pin", noted)
    same = " ".join(f"w{k}" for k in range(40))
    rows = [(1, same), (2, same), (3, f"{same} more"), *((k, " ".join(f"v{k}x{n}" for n in range(30))) for k in range(4, 40))]
    docs = frame(spark, rows).select(F.struct(F.col("doc_id").alias("id")).alias("key"), "text")
    star = lambda s: s.select(F.col("set_id").alias("a")).crossJoin(s.agg(F.min("set_id").alias("b"))).filter("a <> b")
    found = sets.classes(docs, star)
    got = {r["key"]["id"]: (r["class_key"]["id"], r["class_size"], r["n_links"]) for r in found.collect()}
    assert got == {1: (1, 3, 2), 2: (1, 3, 2), 3: (1, 3, 2)} | {k: (k, 1, 0) for k in range(4, 40)}
    (carried,) = [out for columns, out in written if columns == ["set_id", "rep", "apart", "copies", "class", "docs"]]
    assert carried.count() == 2


def test_paragraphs_are_dealt_out_in_blocks(spark, monkeypatch):
    """What Spark moves are blocks of paragraphs, not a row for each, however they are cut and dealt."""
    rng = np.random.default_rng(5)
    some = lambda n: " ".join(f"w{k}" for k in rng.integers(0, 10**6, n))
    shared = [some(80) for _ in range(12)]
    texts = [f"{some(200)}\n{shared[k % 12]} {some(50)}\n{some(200)}" for k in range(100)]
    texts += [t.replace(" w1", " v1") for t in texts[:40]] + texts[:10] + [None, "", "w1 w2", "w1 w2"]
    docs = frame(spark, [(k % 140, t) for k, t in enumerate(texts)])
    flat = paragraph_dedup.packed_paragraphs(docs, "doc_id", "text", 4, 2, 4)
    pieces = paragraph_dedup.piece_blocks(docs, "doc_id", "text", 4, 2, 4)
    assert pieces.agg(F.sum("n")).first()[0] == flat.count() > 20 * pieces.count()
    found = paragraph_dedup.set_blocks(pieces, 4)
    kind = paragraph_dedup._set_kind(4)
    rows = [r for b in found.select("rows").toArrow().to_batches() for r in blocks.records(b.column("rows"), kind)]
    got = {int(r["set_id"]): (int(r["copies"]), int(r["shingles"]), r["bands"].tobytes()) for r in rows}
    want = flat.groupBy("set_id").agg(F.count(F.lit(1)), F.first("shingles"), F.first("bands")).collect()
    assert got == {r[0]: (r[1], r[2], bytes(r[3]) or bytes(24)) for r in want} and len(got) == len(rows)
    links = paragraph_dedup.band_links(found, 4, 4)
    plan = links._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Generate" not in plan
    monkeypatch.setattr(blocks, "PART_ROWS", 300)
    result = lambda: {tuple(r) for r in paragraph_dedup.repeated_passages(docs, within=True).collect()}
    small = result()
    monkeypatch.setattr(paragraph_dedup, "SPREAD", 1)  # every copied set goes to all tasks
    spread = result()
    monkeypatch.undo()
    assert small == spread == result() and small


def test_sets_of_a_band_are_linked_to_the_smallest(spark):
    kind = paragraph_dedup._set_kind(2)
    ids = [9, 3, 7, 1, 5, 8]
    made = [[(i, 1, 4, bytes([1 if i < 6 else 2] * 6) + bytes([i] * 6))] for i in ids] + [[(2, 1, 3, bytes(12))], [(4, 1, 2, bytes(12))]]
    rows = [(len(m), bytearray(np.array(m, kind).tobytes())) for m in made]
    links = paragraph_dedup.band_links(spark.createDataFrame(rows, "n int, rows binary"), 2, 4)
    got = {r["node"]: r["comp"] for r in sets.components(links).collect()}
    assert got == {1: 1, 3: 1, 5: 1, 7: 7, 8: 7, 9: 7}


@pytest.mark.parametrize("n,values", [(0, 5), (1, 5), (500, 40), (20000, 2**63)])
def test_distinct_shingles_of_paragraphs(n, values):
    random = np.random.default_rng(n)
    piece = np.sort(random.integers(0, max(1, n // 8), n))
    found = random.integers(0, values, n).astype(np.uint64)
    found[random.random(n) < 0.2] = 7
    got, owner = paragraph_dedup.distinct_shingles(found, piece)
    assert sorted(zip(owner, got)) == sorted(set(zip(piece, found))) and (np.diff(owner) >= 0).all()


def test_pairs_are_compared_like_larger_groups(spark):
    """Components of two sets, all at once, against the comparison of every pair."""
    words = [f"w{k}" for k in range(60)]
    texts = {k: " ".join(words[: 20 + k // 2 % 3] + [f"x{k // 2}"] * 6 + (["y", "z"] * (k % 4 == 1))) for k in range(60)}
    rows = [(k, t) for k, t in texts.items()]
    units = frame(spark, rows).select(F.struct(F.col("doc_id").alias("id")).alias("key"), "text")
    sketched = sets.sketch(units).drop("sketch")
    members = sets.distinct_sets(sketched, None)
    linked = {}
    for size in (2, 60):
        comps = members.select(F.col("set_id").alias("node"), F.floor(F.col("rep.id") / size).alias("comp"))
        for r in sets.exact_links(members, comps, units, 5, 0.8).join(members.select("set_id", "rep"), "set_id").collect():
            linked.setdefault(size, {})[r["rep"]["id"]] = (r["sets"], r["docs"])
    found = {k: shingle_set(t) for k, t in texts.items()}
    near = lambda a, b: a != b and len(found[a] & found[b]) >= 0.8 * len(found[a] | found[b])
    for size, got in linked.items():
        for k in got:
            others = [o for o in range(60) if o // size == k // size and near(k, o)]
            classes = {found[o] for o in others if found[o] != found[k]}
            assert got[k] == (len(classes), sum(found[o] in classes for o in others)), (size, k)


def test_blocks_come_back_whole(monkeypatch):
    for name, value in (("BLOCK", 7), ("FILE_BLOCKS", 2), ("SLICE", 50)):
        monkeypatch.setattr(blocks, name, value)
    kind = np.dtype([("key", "<i8"), ("n", "<i4"), ("mark", "V3")])
    rows = np.ones(500, kind)
    rows["key"] = np.random.default_rng(1).integers(-(2**63), 2**63 - 1, 60)[np.arange(500) % 60]
    made = list(blocks.in_blocks(rows, rows["key"].copy()))
    assert sum(sum(b.column("n").to_pylist()) for b in made) == 500 and {b.num_rows for b in made} == {2}
    assert np.concatenate([blocks.records(b.column("c0"), kind) for b in made]).tobytes() == rows.tobytes()
    assert not list(blocks.in_blocks(rows[:0]))
    back = [r for b in made for r in blocks.slices_of(b.rename_columns(["count", "row", "key"]), np.dtype([("key", "<i8"), ("n", "<i4")]))]
    assert (np.concatenate(back)["key"] == rows["key"]).all() and (np.concatenate(back)["n"] == 1).all()
    dealt = [b for b in blocks.deal(rows, rows["key"], 4)]
    assert sum(len(blocks.records(b.column("rows"), kind)) for b in dealt) == 500
    for part in range(4):
        own = [b.filter(pa.compute.equal(b.column("part"), part)) for b in dealt]
        held = list(blocks.gathered(own, kind, lambda r: r[np.unique(r["key"], return_index=True)[1]]))
        want = np.unique(rows["key"][rows["key"].view(np.uint64) % 4 == part])
        assert (held[-1]["key"] == want).all() and all(len(h) <= len(want) for h in held) and len(held) > 1
