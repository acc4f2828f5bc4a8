"""Byte-level BPE by a tokenization automaton: pre-split words run through tables, ids decoded by arc labels.

The merges are compiled into a deterministic automaton over tokens that accepts
exactly the token sequences BPE gives. It begins as one state on which every byte
loops. Each merge (u, v) -> w, in order of rank, adds its gadget: the state after u
is split off and loses its arc for v, and w gets an arc from every state that has
one for u, to the state after v. A word has one accepted path; ``encode`` finds it
arc by arc and remembers the words it has seen.

What each case gives:

* null text: no ids, like the empty text; null ids: the empty text.
* Texts of any length, repeated rows, ties and empty tables: rows come back one for
  one, in the other columns unchanged; a long word costs time in proportion.
* A column that is already called like the one to be added is replaced.
* Special tokens in a text become their ids, as the tokenizer does by default.
* Ids that don't make up UTF-8 decode to replacement characters; ids beyond the
  vocabulary are an error.
"""

from __future__ import annotations

import json
import re
from array import array
from collections.abc import Iterator

import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from panelforge.llm.common import for_workers

#: The pre-tokenizer's rule for words: a fixed value.
WORDS = regex.compile(r"'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+")
#: Up to here every version of Unicode has the same letters and digits.
SETTLED = "ɏ"
#: Marks that make one word, in a run of them. An apostrophe may join what follows.
_MARKS = ".,;:!?*#$%&|<>\"()[]{}-_/+=~^@`\\"
TWO_SPACES = re.compile(r"\s\s")
#: A space between two other characters always begins a word.
GAP = re.compile(r"(?<=\S)(?= \S)")
_SPACED = " ".__add__


def byte_letters() -> dict[int, str]:
    """How byte-level vocabularies spell bytes: printable ones as themselves, the others from U+0100 on."""
    shown = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    rest = iter(range(0x100, 0x200))
    return {b: chr(b if b in shown else next(rest)) for b in range(256)}


class MergeAutomaton:
    """The automaton of a list of merges.

    ``after[t]`` is the state that reading the token t leads to; the start is
    state 0. A state is kept as what it has lost: token -> rank of the merge that
    took the arc away. States are shared until a gadget splits one of their tokens
    off, so only the splits are copied.
    """

    START = 0
    #: Transitions that are kept, in the tables of all states.
    TABLE = 1_000_000

    def __init__(self, labels: dict[int, bytes], merges: list[tuple[int, int, int]]):
        """``labels``: the bytes of each token; ``merges``: (u, v, w) in order of rank."""
        self.labels = labels
        self.lost: list[dict[int, int]] = [{}]
        users = [1 + len(labels) - len(merges)]
        self.after = {t: self.START for t in labels}
        #: w -> (u, rank of the merge): w has an arc wherever u had one at that rank
        self.left: dict[int, tuple[int, int]] = {}
        dead: set[int] = set()
        for rank, (u, v, w) in enumerate(merges):
            if w in self.left:
                raise ValueError(f"two merges give token {w}")
            state = self.after[u]
            if {u, v} & dead or not self.has_arc(state, v, rank):
                dead.add(w)  # nothing is ever left for this merge: an earlier one takes u or v first
            else:
                self.after[w] = self.after[v]
                users[self.after[v]] += 1
                if users[state] > 1:
                    users[state] -= 1
                    self.lost.append(dict(self.lost[state]))
                    users.append(1)
                    self.after[u] = state = len(self.lost) - 1
                self.lost[state][v] = rank
            self.left[w] = (u, rank)
        self._compile_bytes({t: label for t, label in labels.items() if t not in dead})

    def has_arc(self, state: int, token: int, rank: int = 1 << 60) -> bool:
        """Whether ``state`` has an arc for ``token`` after the merges up to ``rank``."""
        lost = self.lost[state]
        if not lost:
            return True
        while True:
            # an arc that u lost only after w was made is still there for w
            if lost.get(token, rank + 1) <= rank:
                return False
            if token not in self.left:
                return True
            token, rank = self.left[token]

    def _compile_bytes(self, labels: dict[int, bytes]) -> None:
        """The arcs' labels as a trie over bytes, and each token's next shorter beginning that is a token."""
        self.children: list[dict[int, int]] = [{}]
        self.token_at: list[int] = [-1]
        for token, label in labels.items():
            node = 0
            for b in label:
                if b not in self.children[node]:
                    self.children[node][b] = len(self.children)
                    self.children.append({})
                    self.token_at.append(-1)
                node = self.children[node][b]
            self.token_at[node] = token
        self.shorter = {}
        for token, label in labels.items():
            node, best = 0, -1
            for b in label[:-1]:
                node = self.children[node][b]
                if self.token_at[node] >= 0:
                    best = self.token_at[node]
            self.shorter[token] = best
        self.length = {t: len(label) for t, label in labels.items()}
        self.whole = {label: [t] for t, label in labels.items()}
        self.table: list[dict[int, bool]] = [{} for _ in self.lost]
        self.filled = 0

    def _transition(self, state: int, token: int) -> bool:
        """Works out a transition and enters it into its state's table; the tables start anew when they are full."""
        if self.filled >= self.TABLE:
            for row in self.table:
                row.clear()
            self.filled = 0
        self.filled += 1
        self.table[state][token] = known = self.has_arc(state, token)
        return known

    def _longest(self, word: bytes, at: int) -> int:
        """The longest token that ``word`` goes on with."""
        children, token_at, node, best = self.children, self.token_at, 0, -1
        for k in range(at, len(word)):
            node = children[node].get(word[k])
            if node is None:
                break
            if token_at[node] >= 0:
                best = token_at[node]
        return best

    def encode(self, word: bytes) -> list[int]:
        """The tokens on the only accepted path that spells ``word``.

        A beginning of a word has one accepted path too, so no place is reached
        twice: one that leads nowhere is remembered, and the search is linear.
        """
        if word in self.whole:  # the start has every arc
            return list(self.whole[word])
        shorter, length, after, table = self.shorter, self.length, self.after, self.table
        path, at, state, end = [], 0, self.START, len(word)
        dead: set[int] = set()
        token = self._longest(word, 0) if word else -1
        while at < end:
            while token >= 0:
                known = table[state].get(token)
                if known is None:
                    known = self._transition(state, token)
                if known and at + length[token] not in dead:
                    break
                token = shorter[token]
            if token >= 0:
                path.append(token)
                at, state = at + length[token], after[token]
                token = self._longest(word, at)
            else:
                dead.add(at)
                token = path.pop()
                at, state = at - length[token], after[path[-1]] if path else self.START
                token = shorter[token]
        return path


class Spelling:
    """What a tokenizer file says of its tokens: their bytes, the merges and the special ones. Enough to decode."""

    def __init__(self, path: str):
        """``path``: a tokenizer file with a byte-level BPE model, no normalizer, and special tokens that are matched as they stand."""
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        if spec["model"]["type"] != "BPE" or spec["normalizer"] or spec["pre_tokenizer"].get("type") != "ByteLevel" or spec["pre_tokenizer"]["add_prefix_space"] or not spec["pre_tokenizer"].get("use_regex", True):
            raise ValueError(f"{path} is not a plain byte-level BPE")
        if any(t[k] for t in spec["added_tokens"] for k in ("single_word", "lstrip", "rstrip")):
            raise ValueError(f"{path} has special tokens that take in what surrounds them")
        byte_of = {letter: b for b, letter in byte_letters().items()}
        vocab, pairs = spec["model"]["vocab"], [m.split(" ") if isinstance(m, str) else m for m in spec["model"]["merges"]]
        self.plain = {i: bytes(byte_of[c] for c in token) for token, i in vocab.items() if all(c in byte_of for c in token)}
        self.merges = [(vocab[a], vocab[b], vocab[a + b]) for a, b in pairs]
        self.special = {t["content"]: t["id"] for t in spec["added_tokens"]}
        self.labels = self.plain | {i: content.encode() for content, i in self.special.items()}

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", "replace")


class Encoder(Spelling):
    """Whole texts to ids and back. Words that were seen are remembered, in two bounded halves."""

    CACHE = 250_000
    #: Longer chunks and words aren't remembered.
    LONGEST = 200

    def __init__(self, path: str):
        from tokenizers import Tokenizer

        super().__init__(path)
        made = {w for _, _, w in self.merges}
        self.automaton = MergeAutomaton({i: label for i, label in self.plain.items() if len(label) == 1 or i in made}, self.merges)
        self.packed = {content: array("I", [i]).tobytes() for content, i in self.special.items()}
        self.cut = re.compile("(" + "|".join(re.escape(s) for s in sorted(self.special, key=len, reverse=True)) + ")") if self.special else None
        self.presplit = Tokenizer.from_file(path).pre_tokenizer.pre_tokenize_str
        self.cache: dict[str, bytes] = {"": b""}
        self.old: dict[str, bytes] = {}
        self.word: dict[str, bytes] = {}

    def words(self, chunk: str) -> list[str]:
        """The pre-tokenizer's words. Its own code splits what has letters that are new to Unicode."""
        core = chunk.rstrip(_MARKS)
        if core.lstrip(" ").isalpha() and core.count(" ") <= 1 and max(core) <= SETTLED:  # letters, perhaps with marks behind
            return [core, chunk[len(core) :]] if len(core) < len(chunk) else [core]
        if chunk and max(chunk) > SETTLED:
            return [chunk[a:b] for _, (a, b) in self.presplit(chunk)]
        return WORDS.findall(chunk)

    def _ids(self, chunk: str) -> bytes:
        found = []
        for word in self.words(chunk):
            if (ids := self.word.get(word)) is None:
                ids = array("I", self.automaton.encode(word.encode())).tobytes()
                if len(word) <= self.LONGEST:
                    if len(self.word) >= self.CACHE:
                        self.word.clear()
                    self.word[word] = ids
            found.append(ids)
        return b"".join(found)

    def _learn(self, chunks: set[str]) -> None:
        for chunk in chunks:
            ids = self.old.get(chunk)
            self.cache[chunk] = self._ids(chunk) if ids is None else ids

    def _plain(self, text: str) -> bytes:
        """The ids of a text without special tokens."""
        if TWO_SPACES.search(text):
            chunks = GAP.split(text)
        else:
            first, *rest = text.split(" ")
            chunks = [first, *map(_SPACED, rest)]
        try:
            return b"".join(map(self.cache.__getitem__, chunks))
        except KeyError:
            if len(self.cache) > self.CACHE:
                self.cache, self.old = {"": b""}, self.cache
            lacking = set(chunks).difference(self.cache)
            self._learn(lacking)
            ids = b"".join(map(self.cache.__getitem__, chunks))
            for chunk in lacking:
                if len(chunk) > self.LONGEST:
                    del self.cache[chunk]
            return ids

    def encode(self, text: str) -> bytes:
        """Ids as little-endian unsigned 32-bit integers."""
        if self.cut is None or not self.cut.search(text):
            return self._plain(text)
        return b"".join(self.packed.get(part) or self._plain(part) for part in self.cut.split(text))


_ENCODERS: dict[str, Encoder] = {}
_SPELLINGS: dict[str, Spelling] = {}


def encoder(path: str) -> Encoder:
    """One automaton a worker process: compiled once, for every task that runs there."""
    if path not in _ENCODERS:
        _ENCODERS[path] = Encoder(path)
    return _ENCODERS[path]


def spelling(path: str) -> Spelling:
    """The same for what only decodes: a worker that does has no need of the automaton."""
    if path not in _SPELLINGS:
        _SPELLINGS[path] = Spelling(path)
    return _SPELLINGS[path]


def default_path() -> str:
    import public_tokenizers

    return public_tokenizers.path("byte_bpe_50k.json")


def encode_documents(docs: DataFrame, text: str = "text", into: str = "ids", path: str | None = None) -> DataFrame:
    """``docs`` with ``into``: the ids of ``text`` as little-endian unsigned 32-bit integers, one binary a row."""
    path = path or default_path()

    @F.arrow_udf("binary")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        encode = encoder(path).encode
        for batch in batches:
            yield pa.array([encode(t or "") for t in batch.to_pylist()], pa.binary())

    return for_workers(docs).withColumn(into, run(F.col(text)))


def decode_documents(rows: DataFrame, ids: str = "ids", into: str = "text", path: str | None = None) -> DataFrame:
    """``rows`` with ``into``: the text of packed ``ids``, special tokens spelled out."""
    path = path or default_path()

    @F.arrow_udf("string")
    def run(batches: Iterator[pa.Array]) -> Iterator[pa.Array]:
        decode = spelling(path).decode
        for batch in batches:
            yield pa.array([decode(x or b"") for x in batch.to_pylist()], pa.string())

    return for_workers(rows).withColumn(into, run(F.col(ids)))


def token_digests(docs: DataFrame, path: str | None = None) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 of every document: what is needed to compare two encoders."""
    both = decode_documents(encode_documents(docs.select("doc_id", "text"), path=path), into="decoded", path=path)
    return both.select("doc_id", (F.octet_length("ids") / 4).cast("long").alias("n_tokens"), F.sha2("ids", 256).alias("ids_sha256"), F.sha2(F.col("decoded").cast("binary"), 256).alias("decoded_sha256"))
