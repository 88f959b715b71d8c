"""Search, packing, archives and language models against brute force, round trips and held-out accuracy."""

import hashlib
import math
import random
import re
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F
from tokenizers import Tokenizer

from driftwatch.llm import decontaminate, features, langid, lm, packing, quality, toxicity, warc
from driftwatch.llm.queries import default_tokenizer
from driftwatch.llm.textops import ALNUM, Words, held_out

SF = "/root/testdata/sf0.01"
WORD = re.compile(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")


def lower(text):
    return "".join(c.lower() if "A" <= c <= "Z" else c for c in text or "")


def frame(spark, rows, extra="item_id string, __id string, score string, lang_pred string, ids string"):
    return spark.createDataFrame([(*r, "a", "b", "c", "d", "e") for r in rows], f"doc_id long, text string, {extra}")


def test_words_of_any_text():
    random.seed(2)
    texts = ["".join(random.choice("aZé7 .,\n\x00漢") for _ in range(random.randrange(12))) for _ in range(300)] + [None]
    words = Words(pa.array(texts, pa.string()), ALNUM)
    spans = [words.data[s:e].tobytes().decode() for s, e in zip(words.starts, words.ends)]
    want = [WORD.findall(lower(t)) for t in texts]
    assert spans == [w for ws in want for w in ws]
    assert words.counts.tolist() == [len(w) for w in want]
    by_hash = {}
    for h, w in zip(words.hashes().tolist(), spans):
        assert by_hash.setdefault(h, w) == w
    assert len(by_hash) == len(set(spans))


def brute_hits(text, items, size=10):
    words = WORD.findall(lower(text))
    hit, found = set(), set()
    for item, t in items:
        own = WORD.findall(lower(t))
        n = min(size, len(own))
        windows = {tuple(own[k : k + n]) for k in range(len(own) - n + 1)} if n else set()
        for k in range(len(words) - n + 1 if n else 0):
            if tuple(words[k : k + n]) in windows:
                hit |= set(range(k, k + n))
                if item is not None:
                    found.add(item)
    return len(words), len(hit), sorted(found)


@pytest.mark.parametrize("part_bytes", [decontaminate.PART_BYTES, 20])
def test_search_against_brute_force(spark, part_bytes):
    random.seed(3)
    make = lambda n: " ".join(random.choice(["a", "B", "cc", "é", "7"]) for _ in range(n))
    items = [(k, make(random.randrange(1, 9))) for k in range(12)] + [(None, "a cc a"), (50, None), (51, "!?"), (0, "é é")]
    rows = [(k, make(random.randrange(0, 60))) for k in range(60)] + [(61, None), (62, ""), (5, "a b"), (63, make(3000))]
    bench = spark.createDataFrame(items, "item_id long, text string")
    got = decontaminate.mark(frame(spark, rows), bench, size=4, part_bytes=part_bytes).collect()
    assert len(got) == len(rows)
    for r in got:
        want = brute_hits(r["text"], items, 4)
        assert (r["__words"], sum(s["end"] - s["start"] for s in r["__spans"]), r["__items"]) == want
    clean = decontaminate.clean_documents(frame(spark, rows), bench, 4)
    assert clean.columns == frame(spark, rows).columns
    assert sorted(r["doc_id"] for r in clean.collect()) == sorted(k for k, t in rows if not brute_hits(t, items, 4)[1])
    assert decontaminate.mark(frame(spark, []), bench).count() == 0
    assert decontaminate.mark(frame(spark, rows), bench.limit(0)).filter("size(__spans) > 0").count() == 0


def check_pieces(pieces, ids_of, capacity):
    by_doc, by_sequence = {}, {}
    for p in pieces:
        by_doc.setdefault(p["doc_id"], []).append(p)
        by_sequence.setdefault(p["sequence_id"], []).append(p)
        assert p["ids_crc32"] == zlib.crc32(np.array(ids_of[p["doc_id"]][p["start"] : p["start"] + p["length"]], "<u4").tobytes())
    for key, own in by_doc.items():
        at = 0
        for p in sorted(own, key=lambda p: p["start"]):
            assert p["start"] == at and p["length"] > 0 and p["doc_tokens"] == len(ids_of[key])
            at += p["length"]
        assert at == len(ids_of[key])
    assert set(by_doc) == set(ids_of)
    for own in by_sequence.values():
        at = 0
        for p in sorted(own, key=lambda p: p["offset"]):
            assert p["offset"] == at
            at += p["length"]
        assert at == capacity or at & (at - 1) == 0 and at < capacity


def test_packing_keeps_every_token(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(150).collect()]
    rows += [(20_000, None), (20_001, ""), (20_002, "İSTANBUL ŉ don't <|endoftext|> 12 ́x " * 900), (20_003, "a <|endoftext|> b x<|startoftext|>y")]
    tool = Tokenizer.from_file(default_tokenizer())
    ids = {k: [*tool.encode(t or "", add_special_tokens=False).ids, 1] for k, t in rows}
    pieces = packing.pack_documents(frame(spark, rows), default_tokenizer(), block_tokens=30_000, with_ids=True).collect()
    check_pieces(pieces, ids, 2048)
    assert all(p["ids"] == ids[p["doc_id"]][p["start"] : p["start"] + p["length"]] for p in pieces)
    assert packing.pack_documents(frame(spark, []), default_tokenizer()).count() == 0


def test_packing_balances_cost():
    random.seed(4)
    pieces = packing.pack([random.randrange(1, 400) for _ in range(900)], 2048, 1.0, 1 / 2048)
    cost = Counter()
    for _, _, n, sequence, _ in pieces:
        cost[sequence] += n + n * n / 2048
    full = sorted(cost.values())[len(packing.capacities(2047, 2048)) :]
    assert max(full) < 1.25 * min(full)
    assert packing.capacities(5000, 2048) == [2048, 2048, 512, 256, 128, 8]


def test_archives_round_trip(spark, tmp_path):
    big, small = "<p>é</p>" * 400, "tiny"
    rows = [(1, "u1", big), (2, "u2", big), (3, None, big), (None, "u", big), (4, "a\r\nb", small), (5, "u5", small), (6, "u6", None), (7, "u7", "x" * 3_000_000)]
    rows += [(9, "u", "same" * 300), (9, "u", "same" * 300)]
    pages = spark.createDataFrame([(*r, "k", "p") for r in rows], "page_id long, url string, html string, key string, payload string")
    folder = f"file://{tmp_path}/warc"
    index = warc.write(pages, folder, frame_bytes=4000, bundle_bytes=3000)
    got = warc.read(index, folder).collect()
    assert len(got) == len(rows)
    texts = {r[0]: r[2] or "" for r in rows}
    for r in got:
        raw = texts[r["page_id"]].encode()
        assert (r["payload_bytes"], r["payload_digest"], r["intact"]) == (len(raw), hashlib.sha1(raw).hexdigest(), "yes")
        if r["record_type"] == "response":
            assert r["payload"] == texts[r["page_id"]]
    types = {(r["page_id"], r["record_type"], r["refers_to"]) for r in got}
    assert {(3, "response", None), (1, "revisit", 3), (None, "revisit", 3), (4, "response", None), (5, "response", None), (9, "response", None)} <= types
    one = warc.fetch(index.filter("page_id = 7 OR page_id = 4"), folder).collect()
    assert sorted((r["page_id"], len(r["payload"])) for r in one) == [(4, 4), (7, 3_000_000)]
    empty = warc.write(pages.limit(0), folder)
    assert warc.read(empty, folder).count() == 0


def test_languages(spark):
    docs = spark.read.parquet(f"{SF}/documents.parquet")
    out = held_out("doc_id", 4, 2)
    learned = langid.fit(docs.filter(~out))
    assert set(learned) == {"de", "en", "es", "fr"} and max(map(len, learned.values())) <= langid.DICTIONARY_BYTES
    found = langid.predict(docs.filter(out), learned, ["doc_id", "lang"]).toPandas()
    assert (found.lang == found.lang_pred).mean() > 0.9
    odd = [(1, None), (2, ""), (3, "12 — 。!"), (4, "the and of " * 90_000), (None, "É")]
    got = {r["doc_id"]: r for r in langid.predict(frame(spark, odd), learned, ["doc_id"]).collect()}
    assert [got[k]["lang_pred"] for k in (1, 2, 3)] == ["und"] * 3 and got[3]["score"] == 0 and got[3]["rejected"]
    assert got[4]["lang_pred"] == "en" and got[None]["lang_pred"] in learned and 0 <= got[4]["score"] <= 1
    assert langid.fit(docs.limit(0)) == {} and langid.fit(docs.selectExpr("text", "null AS lang")) == {}
    assert {r["lang_pred"] for r in langid.predict(frame(spark, odd), {}, ["doc_id"]).collect()} == {"und"}
    assert langid.predict(frame(spark, []), learned, ["doc_id"]).count() == 0


@pytest.mark.parametrize("label, modulus, remainder, least", [("toxic", 5, 0, 0.95), ("quality", 4, 2, 0.95)])
def test_classifiers(spark, label, modulus, remainder, least):
    docs, labels = (spark.read.parquet(f"{SF}/{t}.parquet") for t in ("documents", "labels"))
    out = held_out("doc_id", modulus, remainder)
    odd = frame(spark, [(1, None), (2, ""), (3, "the " * 90_000), (3, "the " * 90_000), (None, "x")])

    def fit(sample):
        if label == "toxic":
            model = toxicity.fit(sample)
            return lambda d: toxicity.score(d, model, ["doc_id"])
        model, ratios = quality.fit(sample, boundary=0.7)
        return lambda d: quality.score(d, model, ratios, ["doc_id"])

    score = fit(features.labelled_sample(docs, labels, label, ~out, 5000))
    found = score(docs.filter(out)).join(labels, "doc_id").toPandas()
    predicted = found.score >= (0.5 if label == "toxic" else 0.7)
    assert (predicted == (found[label] == 1)).mean() >= least
    got = score(odd).collect()
    assert len(got) == 5 and all(0 <= r["score"] <= 1 for r in got)
    assert len({r["score"] for r in got if r["doc_id"] == 3}) == 1
    assert score(odd.limit(0)).count() == 0
    none = labels.selectExpr("doc_id", f"cast(null AS int) AS {label}")
    unsure = fit(features.labelled_sample(docs, none, label, ~out, 5000))(odd).collect()
    assert all(0 <= r["score"] <= 1 for r in unsure)
    one = labels.filter(f"{label} = 1")
    assert all(r["score"] > 0.9 for r in fit(features.labelled_sample(docs, one, label, ~out, 5000))(odd).collect())


def test_label_model_discounts_voters_that_repeat_each_other():
    rng = np.random.default_rng(1)
    y = rng.random(4000) < 0.2
    vote = lambda hit, false: np.where(y, rng.random(4000) < hit, rng.random(4000) < false)
    good = [vote(0.7, 0.05) for _ in range(4)]
    noise = vote(0.3, 0.2)
    matrix = np.stack([*good, *[noise] * 6], 1).astype(float)
    posterior = toxicity.label_model(matrix, np.where(matrix[:, :4].sum(1) > 1, 0.9, 0.05), 0.2)
    assert ((posterior > 0.5) == y).mean() > 0.93


def sample_docs(spark):
    rows = [(r["doc_id"], r["text"]) for r in spark.read.parquet(f"{SF}/documents.parquet").limit(120).collect()]
    return rows + [(900, None), (901, ""), (902, "A b\x0bA  C\x1c"), (902, "A b\x0bA  C\x1c"), (None, "unseen-word")]


def test_language_model_counts_against_brute_force(spark, monkeypatch):
    monkeypatch.setattr(lm, "HEAD", 600)  # most words are looked up by the join
    rows = sample_docs(spark)
    tokens = {k: re.findall(r"[^\x20\x09-\x0D]+", lower(t)) + [None] for k, t in rows}
    training = [k for k, _ in rows if zlib.crc32(str("" if k is None else k).encode()) % 7 != 2]
    counts = Counter(t for k in training for t in tokens[k])
    total, types = sum(counts.values()), len(counts)
    found, summary = lm.fit_and_score(frame(spark, rows), ~held_out("doc_id", 7, 2))
    got = found.collect()
    assert len(got) == len(rows) and summary.total == total and summary.types == types
    for r in got:
        own = tokens[r["doc_id"]]
        assert (r["n_tokens"], r["n_known"]) == (len(own), sum(t in counts for t in own))
        base = sum(math.log10((counts[t] + 1) / (total + types + 1)) for t in own)
        assert math.isclose(r["base_score"], base, rel_tol=1e-9)
        assert r["score"] < 0
    assert sum(r["score"] for r in got) > sum(r["base_score"] for r in got)


def test_language_model_is_normalised(spark):
    docs = frame(spark, sample_docs(spark))
    counted = lm.word_counts(docs)
    counts = lm.count_summary(counted, docs.count())
    table = lm.tabulate(lm.train(lm.run_counts(docs, counts), rounds=1))
    every = np.arange(lm.CLASSES)
    for v, u in ((0, 0), (5, 0), (300, 7), (1000, 260)):
        assert math.isclose((10 ** table.log10(every, np.full_like(every, v), np.full_like(every, u))).sum(), 1, rel_tol=1e-3)
    own = dict(zip(counts.words.tolist(), counts.classes.tolist()))
    mass = np.zeros(lm.ENDINGS + 1)
    for r in counted.collect():
        if not own.get(r["word"] & (2**64 - 1)):
            mass[r["ending"]] += (r["count"] + 1) / 10 ** counts.ending_log[r["ending"]]
    assert (mass <= 1 + 1e-9).all() and np.allclose(mass[1:] + 1 / 10 ** counts.ending_log[1:], 1)


def test_language_model_without_training_texts(spark):
    docs = frame(spark, [(1, "a b"), (2, None)])
    from pyspark.sql import functions as F

    got = lm.fit_and_score(docs, F.lit(False))[0].collect()
    assert all(r["base_score"] == 0 and r["n_known"] == 0 and math.isfinite(r["score"]) for r in got)
    assert lm.fit_and_score(docs.limit(0), F.lit(True))[0].count() == 0


def test_training_comes_to_every_counted_run(monkeypatch):
    monkeypatch.setattr(lm, "BATCH", 64)
    before = np.random.default_rng(3).permutation(lm.CLASSES)
    code, count = before * lm.CLASSES + np.arange(lm.CLASSES), np.ones(lm.CLASSES, np.int64)
    count[:3] = 10**6  # draws by count would hardly meet another run
    noise = np.full(lm.CLASSES, 1 / lm.CLASSES)
    model = lm.initial(noise)
    made = lm.train_share(model, code, count, noise, seed=1, steps=1)
    assert (made["r"] != model["r"]).any(1).all() and (made["q"] != model["q"]).any(1).all()


@pytest.mark.parametrize("n,least", [(1, 500), (40, 500), (3000, 500)])
def test_a_pass_weighs_runs_by_their_counts(n, least):
    count = np.random.default_rng(n).zipf(1.6, n).clip(max=10**5)
    places, weight, passes = lm.visits(count, least)
    assert np.allclose(np.bincount(places, weight[places], n), count, rtol=1e-4)
    assert weight.max() <= lm.HEAVY * count.mean() * 1.0001 and least <= passes * len(places) < least + 2 * len(places)


def test_special_tokens_are_packed_as_such(spark):
    pieces = packing.pack_documents(frame(spark, [(1, "a <|endoftext|> b")]), default_tokenizer(), with_ids=True).collect()
    assert [i for p in sorted(pieces, key=lambda p: p["start"]) for i in p["ids"]] == [320, 49407, 321, 1]


def test_a_sample_has_one_text_for_each_id(spark):
    docs = spark.createDataFrame([(1, f"text {k}") for k in range(50)] + [(2, "two"), (3, None), (None, "none")], "doc_id long, text string")
    labels = spark.createDataFrame([(1, 1), (2, 0), (3, 1), (None, 1)], "doc_id long, toxic int")
    rows = features.labelled_sample(docs, labels, "toxic", F.lit(True), 100).collect()
    assert len(rows) == 3 and {(r["text"], r["label"]) for r in rows if not r["text"].startswith("text")} == {("two", 0), ("", 1)}
    assert features.labelled_sample(docs, labels, "toxic", F.lit(True), 100).collect() == rows


def test_parts_of_a_benchmark_are_held_one_at_a_time(spark):
    words = [f"w{k}" for k in range(400)]
    docs = frame(spark, [(k, " ".join(words[k : k + 60])) for k in range(0, 300, 30)])
    items = spark.createDataFrame([(k, " ".join(words[k : k + 15])) for k in range(0, 380, 20)], "item_id long, text string")
    whole = decontaminate.mark(docs, items).select("doc_id", "__words", "__spans", "__items")
    parts = decontaminate.mark(docs, items, part_bytes=200)
    # What earlier parts marked is read from a table, so the plan has one part's operator alone.
    assert parts._jdf.queryExecution().executedPlan().toString().count("MapInArrow") == 1
    assert sorted(map(str, parts.select(whole.columns).collect())) == sorted(map(str, whole.collect()))
