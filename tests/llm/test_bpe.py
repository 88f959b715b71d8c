"""Encoding and decoding against the tokenizer library itself."""

import gc
import hashlib
import random

import public_tokenizers
import pytest
from tokenizers import Tokenizer

from driftwatch.llm import bpe
from driftwatch.llm.queries import QUERIES

SF = "/root/testdata/sf0.001"
PATH = public_tokenizers.path("word_bpe_49k.json")
SCHEMA = "doc_id long, text string, ids2 string, token int, word string"


@pytest.fixture(scope="module")
def library():
    return Tokenizer.from_file(PATH)


def frame(spark, texts):
    return spark.createDataFrame([(k, t, "x", 1, "y") for k, t in enumerate(texts)], SCHEMA)


def both(spark, texts):
    encoded = bpe.encode(frame(spark, texts), PATH, ["doc_id", "token"])
    found = bpe.decode(encoded, PATH, ["doc_id", "ids", "token"]).collect()
    return {r["doc_id"]: (r["ids"], r["decoded"]) for r in found}


def agree(spark, library, texts):
    got = both(spark, texts)
    assert len(got) == len(texts)
    for k, text in enumerate(texts):
        ids = library.encode(text or "", add_special_tokens=False).ids
        assert got[k] == (ids, library.decode(ids, skip_special_tokens=False)), text


def random_texts(n, size):
    rng = random.Random(size)
    alphabet = list("abcdeinghotsr'é日本ß1!?#İΣςǆ \t\n") + ["́", "\x00", " ", " ", " <|endoftext|>", "<|startoftext|>", "<|ENDOFTEXT|>", "😀"]
    return ["".join(rng.choices(alphabet, k=size)) for _ in range(n)] + ["".join(rng.choices("ab", k=size)) for _ in range(n // 2)]


@pytest.mark.parametrize("size", [1, 4, 40, 400])
def test_random_texts(spark, library, size):
    agree(spark, library, random_texts(300, size))


def test_edge_cases(spark, library, monkeypatch):
    texts = [None, "", " ", "\n", "a <|endoftext|> b", "<|endoftext|>", "x<|startoftext|>y", "same", "same", "a" * 5000, "日本" * 2000, "don't we'll THEY'RE 3.14 l'été"]
    agree(spark, library, texts)
    assert both(spark, []) == {}
    assert bpe.encode(frame(spark, texts), PATH, ["text"], name="token").columns == ["text", "token"]


def test_unknown_and_null_ids_decode_to_nothing(spark):
    rows = [(1, [320, 49407, 321]), (2, [-5, 320, 60_000, 321, None]), (3, []), (4, None), (5, [10**9])]
    df = spark.createDataFrame(rows, "k long, ids array<int>")
    got = {r["k"]: r["decoded"] for r in bpe.decode(df, PATH, ["k"]).collect()}
    assert got == {1: "a</w> <|endoftext|> b</w>", 2: "a</w> b</w>", 3: "", 4: "", 5: ""}


def test_small_tables_and_pieces_change_nothing(library, monkeypatch):
    for name, value in {"HELD": 20, "PIECE": 30, "BATCH": 3}.items():
        monkeypatch.setattr(bpe, name, value)
    encoder = bpe.Encoder(PATH)
    texts = random_texts(200, 60)
    for k in range(0, len(texts), 10):
        for text, made in zip(texts[k : k + 10], encoder.encode(texts[k : k + 10])):
            ids = [int.from_bytes(made[i : i + 4], "little") for i in range(0, len(made), 4)]
            assert ids == library.encode(text, add_special_tokens=False).ids


def test_shared_prefixes_are_walked_once():
    root = bpe.build_trie(["car", "card", "care", "cat", "dog", "a"])
    seen, todo = [], [(root, "")]
    while todo:
        node, above = todo.pop()
        assert node.word[: node.depth].startswith(above)
        seen.append((node.word[: node.depth], node.ends))
        todo += [(child, node.word[: node.depth]) for child in node.below]
    assert sorted(seen) == [("", False), ("a", True), ("ca", False), ("car", True), ("card", True), ("care", True), ("cat", True), ("dog", True)]


def test_query(spark, library):
    docs = spark.read.parquet(f"{SF}/documents.parquet").select("doc_id", "text").collect()
    want = set()
    for r in docs:
        ids = library.encode(r["text"] or "", add_special_tokens=False).ids
        digests = (" ".join(map(str, ids)), library.decode(ids, skip_special_tokens=False))
        want.add((r["doc_id"], len(ids), *(hashlib.sha256(d.encode()).hexdigest() for d in digests)))
    found = QUERIES["op11_bpe"](spark, SF)
    assert found.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    assert {tuple(r) for r in found.collect()} == want


def test_lookups_do_not_run_through_the_table(monkeypatch):
    """What is missing is found key by key, whatever the table holds."""
    held = bpe._Held()
    held.update({f"w{k}": b"" for k in range(100)})
    held.before = {"old": b"1", "older": b"2"}

    def scanned(_):
        raise AssertionError("the whole table was read")

    monkeypatch.setattr(bpe._Held, "keys", scanned)
    monkeypatch.setattr(bpe._Held, "__iter__", scanned)
    assert held.missing({"w1", "old", "new"}) == {"new"}
    assert held["old"] == b"1" and "older" not in held


def test_latin_letters_do_not_go_through_the_library(library, monkeypatch):
    """Every letter to U+00FF, in words, with marks and digits, is split as the library splits it."""
    letters = [chr(c) for c in range(33, 256) if chr(c).isprintable() and chr(c) not in "ª²³¹º¼½¾µ\xa0"]
    texts = [f"a{c}b {c} {c}{c.upper()}9{c}'S" for c in letters] + ["Ça l'ÉTÉ,ß", "ÀÖ×÷ØÞ 'Ll"]
    encoder = bpe.Encoder(PATH)
    for text, made in zip(texts, encoder.encode(texts)):
        ids = [int.from_bytes(made[i : i + 4], "little") for i in range(0, len(made), 4)]
        assert ids == library.encode(text, add_special_tokens=False).ids, text
    encoder = bpe.Encoder(PATH)

    def called(_):
        raise AssertionError("the library was asked")

    monkeypatch.setattr(encoder, "split", called)
    monkeypatch.setattr(encoder, "normalise", called)
    assert len(encoder.encode(["L'été où Ößterreich, ÇA 3.14!"])[0]) > 0


def test_no_search_for_cycles_while_encoding():
    encoder, found = bpe.Encoder(PATH), []
    note = lambda phase, info: found.append(phase)
    texts = [f"{word}{k}x{k * k}" for k in range(3000) for word in ("some", "other")]
    encoder.encode(["first"])
    gc.callbacks.append(note)
    try:
        encoder.encode(texts)
    finally:
        gc.callbacks.remove(note)
    # One may start when it is let in again.
    assert found.count("start") <= 1 and gc.isenabled()
