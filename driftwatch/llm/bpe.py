"""Byte-pair encoding of whole texts by prefix-sharing trie traversal, and decoding.

The distinct new words of a slice of texts are inserted into a trie (with edges of several symbols where
nothing branches off), which is walked depth first. A node's state is the last token of its prefix's
encoding, and the encoding of the prefix is that of the shorter prefix before this token, with the token
after it; so each prefix that words share is encoded once. The last token is the one token at the
prefix's end that goes with the last token before it: two tokens go together if encoding both their
texts end to end gives the two again. This is found by undoing their merges, latest first, and looking
for a merge across the border that would have come earlier. A word's last symbol carries the
end-of-word mark and is therefore a node of its own.

Normalisation and splitting into words are those of the tokenizer's file, done by its library on the
distinct parts between spaces and line feeds, across which neither ever looks. Special tokens are found
in the raw text, as the library does.

Each task reads its own texts and shuffles nothing. Parts met before are looked up in tables
of twice ``HELD`` entries at most; their size changes speed only. Long texts are worked on in pieces of about
``PIECE`` characters.

Edge cases: a null text is an empty one and has no ids. Repeated rows and null ids are carried as they
are. Ids that the vocabulary lacks are left out by ``decode``; null ids decode to an empty text. Columns
to keep are named by the caller, and so are the new ones, which must not be among them.
"""

from __future__ import annotations

import gc
import json
import re
from collections.abc import Iterable, Iterator
from contextlib import contextmanager
from functools import cached_property
from itertools import filterfalse
from struct import pack

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from driftwatch.llm.textops import annotate

HELD = 400_000
PIECE = 1 << 20
BATCH = 1000


#: In place of two tokens and a rank, for a token that no merge makes.
_UNMADE = (-1, -1, -1)


class Merges:
    """The vocabulary and merge rules of a tokenizer file."""

    def __init__(self, path: str) -> None:
        with open(path, encoding="utf-8") as file:
            whole = json.load(file)
        model = whole["model"]
        mark = model["end_of_word_suffix"] or ""
        if model["type"] != "BPE" or not mark or model["continuing_subword_prefix"] or model["ignore_merges"] or whole["decoder"]:
            raise ValueError("Only merge tables with an end-of-word mark and plain decoding are supported")
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"] or re.search(r"\s", t["content"]) for t in whole["added_tokens"]):
            raise ValueError("Only plain special tokens are supported")
        vocabulary = model["vocab"]
        self.special = {t["content"]: t["id"] for t in whole["added_tokens"]}
        self.mark = mark
        self.tokens = {i: t for t, i in (vocabulary | self.special).items()}
        #: Rank of the merge of two tokens, and the two with the rank for each merged token.
        self.rank: dict[tuple[int, int], int] = {}
        self.made: dict[int, tuple[int, int, int]] = {}
        for rank, (left, right) in enumerate(m if isinstance(m, list) else m.split(" ") for m in model["merges"]):
            pair, token = (vocabulary[left], vocabulary[right]), vocabulary[left + right]
            earlier = [self.made[t][2] for t in pair if t in self.made]
            if token in self.made or any(r >= rank for r in earlier):
                raise ValueError("Merges must make each token once, after its parts")
            self.rank[pair], self.made[token] = rank, (*pair, rank)
        #: Tokens by the symbols they stand for, within a word and at its end.
        self.inner = {t: i for t, i in vocabulary.items() if not t.endswith(mark) or t == mark}
        self.final = {t[: -len(mark)]: i for t, i in vocabulary.items() if t.endswith(mark) and t != mark}
        #: Per token: whether its text, after that of another token, is encoded as the two.
        self.known: dict[int, dict[int, bool]] = {i: {} for i in vocabulary.values()}
        self._n_known = 0
        self._alone: dict[int, bool] = {}
        self._n_steps = 0

    @cached_property
    def endings(self) -> tuple[list[dict[str, int]], list[int], list[tuple[Ending, ...]]]:
        """See ``_endings``; tokens that are not encoded as themselves end no prefix."""
        own = {i: self.known[i] for i in self.known if self.alone(i)}
        return _endings(self.inner, self.final, self.mark, own)

    def step(self, state: int, symbol: str) -> int:
        """The state one symbol on, by way of shorter ends; entered with the state, so that it is found once."""
        after, shorter, _ = self.endings
        at = state
        while at and symbol not in after[at]:
            at = shorter[at]
        to = after[at].get(symbol, 0)
        if self._n_steps < HELD:
            after[state][symbol] = to
            self._n_steps += 1
        return to

    def goes(self, left: int, right: int) -> bool:
        """Whether the texts of two tokens, end to end, are encoded as the two."""
        known = self.known[right].get(left)
        if known is None:
            if self._n_known >= HELD:
                for held in self.known.values():
                    held.clear()
                self._n_known = 0
            known = self.known[right][left] = self.alone(left) and self.alone(right) and not self._crossed(left, right)
            self._n_known += 1
        return known

    def alone(self, token: int) -> bool:
        """Whether a token's own text is encoded as the token: its last merge joins two that would
        otherwise stay as they are."""
        known = self._alone.get(token)
        if known is None:
            made = self.made.get(token)
            known = made is None or (self.alone(made[0]) and self.alone(made[1]) and not self._crossed(made[0], made[1], made[2]))
            self._alone[token] = known
        return known

    def _crossed(self, left: int, right: int, before: int | None = None) -> bool:
        """Whether some merge across the border of two tokens comes before those that made them, or,
        with ``before``, one other than their own of that rank."""
        limit = len(self.rank) if before is None else before
        rank, made = self.rank, self.made
        ends, begins = made.get(left, _UNMADE), made.get(right, _UNMADE)
        while True:
            across = rank.get((left, right))
            if across is not None and across < limit:
                return True
            if ends[2] > begins[2]:
                # Of two equal merges the one further left is first: here the one inside the left token.
                limit, left = ends[2], ends[1]
                ends = made.get(left, _UNMADE)
            elif begins[2] >= 0:
                limit, right = begins[2] + 1, begins[0]
                begins = made.get(right, _UNMADE)
            else:
                return False


#: A token, its length, and whether it goes with tokens before it, as far as is known.
Ending = tuple[int, int, dict[int, bool]]


def _endings(
    inner: dict[str, int], final: dict[str, int], mark: str, known: dict[int, dict[int, bool]]
) -> tuple[list[dict[str, int]], list[int], list[tuple[Ending, ...]]]:
    """States for the longest end of a prefix with which some token begins: by state the states one symbol
    on, the state of the next shorter end, and the tokens of ``known`` that the prefix ends in,
    longest first. A word's last symbol carries ``mark``."""
    after: list[dict[str, int]] = [{}]
    own = [-1]
    for table, end in ((inner, ""), (final, mark)):
        for token, i in table.items():
            state = 0
            for symbol in [*token[:-1], token[-1] + end]:
                to = after[state].get(symbol)
                if to is None:
                    to = after[state][symbol] = len(after)
                    after.append({})
                    own.append(-1)
                state = to
            own[state] = i if i in known else -1
    shorter, ending = [0] * len(after), [()] * len(after)
    level, size = [0], 0
    while level:
        size += 1
        below = []
        for state in level:
            for symbol, to in after[state].items():
                less = shorter[state]
                while less and symbol not in after[less]:
                    less = shorter[less]
                shorter[to] = after[less].get(symbol, 0) if state else 0
                ending[to] = ((own[to], size, known[own[to]]), *ending[shorter[to]]) if own[to] >= 0 else ending[shorter[to]]
                below.append(to)
        level = below
    return after, shorter, ending


class _Node:
    """A place in the trie: the first ``depth`` symbols of ``word``."""

    __slots__ = ("word", "depth", "ends", "below")

    def __init__(self, word: str, depth: int, ends: bool) -> None:
        self.word, self.depth, self.ends, self.below = word, depth, ends, []


def build_trie(words: Iterable[str]) -> _Node:
    """A trie of distinct words; a node where words branch or end."""
    root = _Node("", 0, False)
    path = [root]
    for word in sorted(words):
        before = path[-1].word
        common = 0
        for x, y in zip(before, word):
            if x != y:
                break
            common += 1
        cut = None
        while path[-1].depth > common:
            cut = path.pop()
        if path[-1].depth < common:
            fork = _Node(before, common, False)
            fork.below.append(cut)
            path[-1].below[-1] = fork
            path.append(fork)
        leaf = _Node(word, len(word), True)
        path[-1].below.append(leaf)
        path.append(leaf)
    return root


def encode_words(merges: Merges, words: Iterable[str]) -> dict[str, list[int]]:
    """Ids of distinct words (strings of byte symbols, none empty) by a walk through their trie."""
    out: dict[str, list[int]] = {}
    # Last token of each prefix of the path, its length and the state of the prefix, by its length.
    last, size, state = [-1], [0], [0]
    goes, step, mark = merges.goes, merges.step, merges.mark
    after, _, ending = merges.endings
    todo = [(build_trie(words), 0)]
    while todo:
        node, to = todo.pop()
        word, depth, below = node.word, node.depth, node.below
        del last[to + 1 :], size[to + 1 :], state[to + 1 :]
        at = state[to]
        for symbol in word[to : depth if below else depth - 1]:
            to += 1
            on = after[at].get(symbol)
            at = step(at, symbol) if on is None else on
            for t, n, fits in ending[at]:
                if n == to:
                    break
                left = last[to - n]
                fit = fits.get(left)
                if fit or fit is None and goes(left, t):
                    break
            else:
                raise ValueError(f"No encoding of {word[:to]!r}")
            last.append(t)
            size.append(n)
            state.append(at)
        if node.ends:
            symbol, at = word[-1] + mark, state[depth - 1]
            on = after[at].get(symbol)
            for t, n, fits in ending[step(at, symbol) if on is None else on]:
                if n == depth:
                    break
                left = last[depth - n]
                fit = fits.get(left)
                if fit or fit is None and goes(left, t):
                    break
            else:
                raise ValueError(f"No encoding of {word!r}")
            ids, at = [t], depth - n
            while at:
                ids.append(last[at])
                at -= size[at]
            ids.reverse()
            out[word] = ids
        for child in below:
            todo.append((child, depth))
    return out


#: How the supported tokenizer splits normalised text, and the same for marks and digits of ASCII and
#: letters to U+00FF, which normalisation only brings to lower case, one by one.
SPLIT = r"'s|'t|'re|'ve|'m|'ll|'d|[\p{L}]+|[\p{N}]|[^\s\p{L}\p{N}]+"
SPLIT_LATIN = re.compile(r"'s|'t|'re|'ve|'m|'ll|'d|[a-zß-öø-ÿ]+|[0-9]|[^\sa-z0-9ß-öø-ÿ]+")
LATIN = re.compile("[!-~À-ÖØ-öø-ÿ]+")


def _byte_symbols() -> dict[int, str]:
    """The symbols that stand for the bytes of each of those letters in a byte-level vocabulary: bytes that
    can be printed stand for themselves, the others follow U+00FF in their order."""
    shown = [*range(33, 127), *range(161, 173), *range(174, 256)]
    symbols = {b: chr(b) for b in shown}
    symbols |= {b: chr(256 + k) for k, b in enumerate(sorted(set(range(256)) - set(shown)))}
    return {c: "".join(symbols[b] for b in chr(c).encode()) for c in range(0xC0, 0x100)}


SYMBOLS = _byte_symbols()


@contextmanager
def _no_cycles() -> Iterator[None]:
    """Holds back the search for cycles, of which nothing here makes any: tables and tries are many
    objects, and it would run through them again and again as they grow."""
    before = gc.isenabled()
    gc.disable()
    try:
        yield
    finally:
        if before:
            gc.enable()


class _Held(dict):
    """A table of bounded size. When full, it starts afresh, and what is asked for again comes back
    from the table before."""

    def __init__(self) -> None:
        self.before: dict[str, bytes] = {}

    def make_room(self) -> None:
        if len(self) > HELD:
            self.before = dict(self)
            self.clear()

    def missing(self, keys: set[str]) -> set[str]:
        """Keys neither here nor in the table before; those there are taken over."""
        new = set(filterfalse(self.__contains__, keys))
        if self.before:
            back = list(filter(self.before.__contains__, new))
            for key in back:
                self[key] = self.before[key]
            new.difference_update(back)
        return new


class Encoder:
    """Ids of texts; what was met before is looked up."""

    def __init__(self, path: str) -> None:
        from tokenizers import Tokenizer

        self.merges = Merges(path)
        library = Tokenizer.from_file(path)
        self.normalise = library.normalizer.normalize_str if library.normalizer else str
        self.split = library.pre_tokenizer.pre_tokenize_str
        settings = json.loads(library.to_str())
        kinds = [n["type"] for n in (settings["normalizer"] or {}).get("normalizers", [])]
        ways = (settings["pre_tokenizer"] or {}).get("pretokenizers", [{}])
        self.plain = (
            kinds == ["NFC", "Replace", "Lowercase"]
            and ways[0].get("pattern") == {"Regex": SPLIT}
            and [w["type"] for w in ways] == ["Split", "ByteLevel"]
        )
        content = sorted(self.merges.special, key=len, reverse=True)
        self.special = re.compile(f"({'|'.join(map(re.escape, content)) or '(?!)'})")
        self.parts, self.words = _Held(), _Held()

    def _words(self, pieces: list[str]) -> dict[str, list[str]]:
        """The words of pieces of parts. Pieces of letters to U+00FF and marks of ASCII are split here, the
        others by the library: many in one call, with spaces between them, but those with white space alone."""
        out: dict[str, list[str]] = {}
        some, alone = [], []
        plain, latin, split = self.plain, LATIN.fullmatch, SPLIT_LATIN.findall
        for piece in pieces:
            if plain and piece.isascii() and piece.isalpha():
                out[piece] = [piece.lower()]
            elif plain and latin(piece):
                own = split(piece.lower())
                out[piece] = own if piece.isascii() else [w.translate(SYMBOLS) for w in own]
            else:
                (some if piece.split() == [piece] else alone).append(piece)
        for at in range(0, len(some), BATCH):
            batch = some[at : at + BATCH]
            normal = self.normalise(" ".join(batch))
            texts = normal.split(" ")
            if len(texts) != len(batch):
                alone += batch
                continue
            ends = np.cumsum([len(t) + 1 for t in texts])
            found = [(w, place[0]) for w, place in self.split(normal) if w]
            owner = np.searchsorted(ends, [place for _, place in found], "right")
            made = [[] for _ in batch]
            for (word, _), k in zip(found, owner.tolist()):
                made[k].append(word)
            out.update(zip(batch, made))
        for piece in alone:
            out[piece] = [w for w, _ in self.split(self.normalise(piece)) if w]
        return out

    def learn(self, parts: set[str]) -> None:
        """Makes the ids of parts not met before."""
        self.parts.make_room()
        self.words.make_room()
        parts = self.parts.missing(parts)
        special = self.merges.special
        marked = {part: [p for p in self.special.split(part) if p] for part in parts if self.special.search(part)}
        pieces = (parts - marked.keys()) | {p for own in marked.values() for p in own if p not in special}
        words = self._words(list(pieces))
        new = self.words.missing({w for own in words.values() for w in own})
        for word, found in encode_words(self.merges, new).items():
            self.words[word] = pack(f"<{len(found)}I", *found)
        ids = self.words
        for part in parts - marked.keys():
            own = words[part]
            self.parts[part] = ids[own[0]] if len(own) == 1 else b"".join([ids[w] for w in own])
        for part, own in marked.items():
            made = ([special[p].to_bytes(4, "little")] if p in special else [ids[w] for w in words[p]] for p in own)
            self.parts[part] = b"".join(i for some in made for i in some)

    def encode(self, texts: list[str]) -> list[bytes]:
        """Ids of each text as little-endian 32-bit numbers."""
        with _no_cycles():
            return self._encode(texts)

    def _encode(self, texts: list[str]) -> list[bytes]:
        out: list[list[bytes]] = [[] for _ in texts]
        group, size = [], 0

        def flush() -> None:
            self.learn(set().union(*(parts for _, parts in group)))
            for k, parts in group:
                out[k].append(b"".join(map(self.parts.__getitem__, parts)))
            group.clear()

        for k, text in enumerate(texts):
            for piece in _pieces(text.replace("\n", " ")):
                group.append((k, piece.split(" ")))
                size += len(piece)
                if size >= PIECE:
                    flush()
                    size = 0
        flush()
        return [b"".join(made) for made in out]


def _pieces(text: str) -> Iterator[str]:
    """A text in pieces, cut at spaces."""
    at = 0
    while at < len(text):
        cut = text.find(" ", at + PIECE)
        to = len(text) if cut < 0 else cut
        yield text[at:to]
        at = to + 1


_encoders: dict[str, Encoder] = {}
_tokens: dict[str, pa.Array] = {}


def encode(docs: DataFrame, tokenizer_path: str, keep: list[str], text: str = "text", name: str = "ids") -> DataFrame:
    """``keep`` columns of ``docs`` and the ids of each whole text in column ``name``."""

    def work(texts: pa.Array) -> list[pa.Array]:
        if tokenizer_path not in _encoders:  # one per process, so that it serves later tasks too
            _encoders[tokenizer_path] = Encoder(tokenizer_path)
        made = _encoders[tokenizer_path].encode([t or "" for t in texts.to_pylist()])
        offsets = np.cumsum([0, *(len(m) // 4 for m in made)]).astype(np.int32)
        return [pa.ListArray.from_arrays(pa.array(offsets), pa.array(np.frombuffer(b"".join(made), "<i4")))]

    return annotate(docs, text, keep, StructType([StructField(name, ArrayType(IntegerType()))]), work)


def _texts(ids: pa.ListArray, tokens: pa.Array) -> pa.Array:
    """The tokens of each list, joined by spaces."""
    flat, sizes = ids.flatten(), pc.fill_null(pc.list_value_length(ids), 0).to_numpy()
    inside = pc.fill_null(pc.and_(pc.greater_equal(flat, 0), pc.less(flat, len(tokens))), False)
    found = tokens.take(pc.if_else(inside, flat, None))
    if found.null_count:  # ids that the vocabulary lacks
        known = found.is_valid()
        sizes = np.diff(np.concatenate([[0], np.cumsum(known.to_numpy(zero_copy_only=False))])[np.concatenate([[0], np.cumsum(sizes)])])
        found = found.filter(known)
    lists = pa.ListArray.from_arrays(pa.array(np.concatenate([[0], np.cumsum(sizes)]), pa.int32()), found)
    return pc.binary_join(lists, " ")


def decode(df: DataFrame, tokenizer_path: str, keep: list[str], ids: str = "ids", name: str = "decoded") -> DataFrame:
    """``keep`` columns of ``df`` and the text that the ids stand for, special tokens included: tokens
    joined by a space, since the tokenizer file has no decoder."""
    schema = StructType([*df.select(*keep).schema.fields, StructField(name, StringType())])
    names = [f.name for f in schema.fields]

    def run(batches: Iterable[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if tokenizer_path not in _tokens:
            known = Merges(tokenizer_path).tokens
            _tokens[tokenizer_path] = pa.array([known.get(k) for k in range(max(known) + 1)], pa.string())
        tokens = _tokens[tokenizer_path]
        for batch in batches:
            column = batch.column(ids)
            ends = np.cumsum(pc.fill_null(pc.list_value_length(column), 0).to_numpy())
            at = 0
            while at < batch.num_rows:
                to = max(at + 1, int(np.searchsorted(ends, (ends[at - 1] if at else 0) + PIECE, "right")))
                part = batch.slice(at, to - at)
                yield pa.RecordBatch.from_arrays([*(part.column(c) for c in keep), _texts(part.column(ids), tokens)], names)
                at = to

    return df.select(*dict.fromkeys([*keep, ids])).mapInArrow(run, schema)
