"""Byte-level BPE as a deterministic automaton over tokens: encoding of pre-split words and decoding."""

from __future__ import annotations

import hashlib
import json
import re
from array import array
from functools import lru_cache

import numpy as np
import pyarrow as pa
import regex
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import batches

#: The white space (Unicode's White_Space) and the splitting pattern of byte-level BPE files.
SPACE = "\t\n\x0b\x0c\r \x85\xa0\u1680\u2000-\u200a\u2028\u2029\u202f\u205f\u3000"
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
#: Entries of each of a worker's tables; a full table starts anew.
TABLE = 200_000
#: Bytes of a word up to which the states after its prefixes are kept.
SHORT = 32


class Irregular(Exception):
    """White space that the quick way of cutting a text doesn't cover."""


class Table(dict):
    """Keeps what `make` returned, for TABLE keys of moderate length at most."""

    def __init__(self, make):
        self.make = make

    def __missing__(self, key):
        if len(self) >= TABLE:
            self.clear()
        value = self.make(key)
        if len(key) < 64:
            self[key] = value
        return value


def byte_letters() -> dict[str, int]:
    """The letter that stands for each byte in the vocabulary: itself if it can be seen, else the next free one from 256."""
    seen = [*range(33, 127), *range(161, 173), *range(174, 256)]
    hidden = [b for b in range(256) if b not in seen]
    return {chr(b): b for b in seen} | {chr(256 + k): b for k, b in enumerate(hidden)}


class MergeAutomaton:
    """The automaton of all properly merged token sequences, by one gadget for each merge in turn.

    It starts as one state with an arc to itself for each byte. The gadget of merge k, (u, v) -> w,
    takes the arc v from the state that u leads to, adds an arc w to each state that then has an arc u,
    and lets w lead to a copy of the state that v then leads to. Every arc with the same label leads to
    one state, so a state is named by its token, and a gadget is three numbers: k, u and v of w.
    Written out, the arcs of 50,000 gadgets are some 10^9; `arc` reads one off the gadgets instead
    and keeps it in the transition table.
    """

    def __init__(self, parts: dict[int, tuple[int, int]], order: dict[tuple[int, int], int], born: dict[int, int]):
        self.parts, self.order, self.born = parts, order, born
        self.table: dict[int, bool] = {}

    def arc(self, state: int, token: int) -> bool:
        """Whether the state after `state` has an arc `token`."""
        known = self.table.get(state << 20 | token)
        if known is None:
            if len(self.table) >= TABLE:
                self.table.clear()
            known = self.table[state << 20 | token] = self._resolve(state, token)
        return known

    def _resolve(self, x: int, y: int) -> bool:
        """Back through the gadgets: the younger of the two tokens got its arcs from its left or right part."""
        now = len(self.order) + 1  # the gadgets before this one count
        while True:
            k = self.order.get((x, y))
            if k is not None and k < now:
                return False
            if x == y and self.born[x]:
                # a copy of itself follows w where v may be followed by u
                u, v = self.parts[x]
                x, y, now = v, u, self.born[x]
            elif self.born[y] > self.born[x]:
                now = self.born[y]
                u, v = self.parts[y]
                if u == v == x:  # its gadget has just taken the arc from that state
                    return False
                y = u
            elif self.born[x]:
                now = self.born[x]
                x = self.parts[x][1]
            else:
                return True


class Bpe:
    """Encodes and decodes as the tokenizer file says (byte-level BPE without normaliser, prefix space or dropout)."""

    def __init__(self, path: str):
        with open(path, encoding="utf-8") as f:
            spec = json.load(f)
        model = spec["model"]
        letters = byte_letters()
        spell = lambda token: bytes(letters[c] for c in token)
        vocab: dict[str, int] = model["vocab"]
        self.labels: dict[int, bytes] = {i: spell(t) for t, i in vocab.items()}
        self.added: dict[str, int] = {}
        for t in spec["added_tokens"]:
            if t["single_word"] or t["lstrip"] or t["rstrip"] or t["normalized"]:
                raise ValueError("added tokens with conditions are not known here")
            self.added[t["content"]] = t["id"]
            self.labels[t["id"]] = bytes(b for c in t["content"] for b in (bytes([letters[c]]) if c in letters else c.encode()))
        parts, order, born = {}, {}, {}
        born |= {i: 0 for t, i in vocab.items() if len(t) == 1}
        for k, merge in enumerate(model["merges"], 1):
            a, b = merge if isinstance(merge, list) else merge.split(" ")
            u, v, w = vocab[a], vocab[b], vocab[a + b]
            order.setdefault((u, v), k)
            if w not in born:
                parts[w], born[w] = (u, v), k
        self.automaton = MergeAutomaton(parts, order, born)
        self.tokens = {self.labels[i]: i for i in born}
        self.ends, self.next = self._trie(self.tokens)
        self.prefixes: dict[bytes, int] = {}
        self.chunks = Table(self._chunk)
        self.slow = re.compile(f" ?[^{SPACE}]+|[{SPACE}]+(?![^{SPACE}])|[{SPACE}]+")
        self.split = regex.compile(PATTERN.replace(r"\S", f"[^{SPACE}]").replace(r"[^\s", f"[^{SPACE}").replace(r"\s", f"[{SPACE}]"))
        self.edge = re.compile(f"[{SPACE}]|$")
        self.special = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if self.added else None

    @staticmethod
    def _trie(tokens: dict[bytes, int]) -> tuple[list[int | None], list[dict[int, int]]]:
        """For each node the token that ends there, and the nodes by the next byte."""
        ends: list[int | None] = [None]
        arcs: list[dict[int, int]] = [{}]
        for label, i in tokens.items():
            at = 0
            for b in label:
                nxt = arcs[at].get(b)
                if nxt is None:
                    nxt = arcs[at][b] = len(arcs)
                    arcs.append({})
                    ends.append(None)
                at = nxt
            ends[at] = i
        return ends, arcs

    def word(self, data: bytes) -> list[int]:
        """The tokens of one pre-split word: the automaton's one path over its bytes.

        The state after a prefix is the last token of the prefix's own encoding, so the path is read
        off from the word's end. Time is linear in the bytes.
        """
        whole = self.tokens.get(data)
        if whole is not None:
            return [whole]
        n, labels, out = len(data), self.labels, []
        if n > SHORT:
            state = self._states(data)
            while n:
                out.append(token := state[n])
                n -= len(labels[token])
        else:
            while n:
                prefix = data[:n]
                out.append(token := self.prefixes.get(prefix) or self._state(prefix))
                n -= len(labels[token])
        return out[::-1]

    def _state(self, prefix: bytes) -> int:
        """The state after a short prefix, kept for the words that share it. A zero state is found anew each time."""
        token = self.tokens.get(prefix)
        if token is None:
            for j in range(1, len(prefix)):
                token = self.tokens.get(prefix[j:])
                if token is not None:
                    before = self.prefixes.get(prefix[:j]) or self._state(prefix[:j])
                    if self.automaton.arc(before, token):
                        break
        if len(self.prefixes) >= TABLE:
            self.prefixes.clear()
        self.prefixes[prefix] = token
        return token

    def _states(self, data: bytes) -> list[int]:
        """The states after each prefix of a long word: from each state the tokens that start there are tried as arcs."""
        ends, follow, arc = self.ends, self.next, self.automaton.arc
        state: list[int] = [-1] * (len(data) + 1)
        for j in range(len(data)):
            at, i = 0, j
            while i < len(data):
                at = follow[at].get(data[i])
                if at is None:
                    break
                i += 1
                token = ends[at]
                if token is not None and state[i] < 0 and (not j or arc(state[j], token)):
                    state[i] = token
        return state

    def _chunk(self, chunk: str) -> bytes:
        """Of a chunk between single spaces; one that starts with a line end has no space before it."""
        body = chunk[1:] if chunk.startswith("\n") else chunk
        if self.edge.match(body) or self.edge.match(body[-1]):
            raise Irregular
        return self._words(chunk if body is not chunk else " " + chunk)

    def _words(self, text: str) -> bytes:
        return b"".join(array("I", self.word(w.encode())).tobytes() for w in self.split.findall(text))

    def _plain(self, text: str) -> bytes:
        """Of a text without added tokens.

        A space with other than white space on both sides always starts a word, and a line end so placed is
        a word; so the chunks between them are encoded on their own and looked up. Other texts are cut by a pattern.
        """
        if not text:
            return b""
        first, *rest = text.replace("\n", " \n").split(" ")
        try:
            return self.chunks["\n" + first][4:] + b"".join(map(self.chunks.__getitem__, rest))
        except Irregular:
            return b"".join(map(self._words, self.slow.findall(text)))

    def encode(self, text: str) -> bytes:
        """The ids as 32-bit unsigned integers of this machine (little-endian wherever Spark runs)."""
        if not self.special or not self.special.search(text):
            return self._plain(text)
        pieces = self.special.split(text)
        return b"".join(array("I", [self.added[x]]).tobytes() if k % 2 else self._plain(x) for k, x in enumerate(pieces))

    def decode(self, ids: bytes) -> str:
        return b"".join(map(self.labels.__getitem__, memoryview(ids).cast("I"))).decode("utf-8", errors="replace")


@lru_cache(maxsize=2)
def load(path: str) -> Bpe:
    """One for each worker process."""
    return Bpe(path)


def _digest(path: str, ids: list, texts: list) -> dict:
    bpe = load(path)
    out: dict = {"doc_id": ids, "n_tokens": [], "ids_sha256": [], "decoded_sha256": []}
    for text in texts:
        data = bpe.encode(text or "")
        out["n_tokens"].append(len(data) // 4)
        out["ids_sha256"].append(hashlib.sha256(data).hexdigest())
        out["decoded_sha256"].append(hashlib.sha256(bpe.decode(data).encode()).hexdigest())
    return out


def round_trip(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids_sha256, decoded_sha256) for each row of docs (doc_id, text, ...): encoded, and decoded from the ids.

    A null text counts as empty (no token). Rows that repeat give a row each; an empty table gives none;
    other columns play no part. Texts are encoded whole, however long.
    """
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids_sha256", pa.string()), ("decoded_sha256", pa.string())])
    fn = batches(lambda ids, texts: _digest(path, ids, texts), schema)
    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(fn, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def encode(docs: DataFrame, path: str) -> DataFrame:
    """(doc_id, n_tokens, ids array<int>, decoded) for each row of docs; as round_trip for odd rows."""
    schema = pa.schema([("doc_id", pa.int64()), ("n_tokens", pa.int64()), ("ids", pa.list_(pa.int32())), ("decoded", pa.string())])

    def fn(doc_ids: list, texts: list) -> dict:
        bpe = load(path)
        data = [bpe.encode(t or "") for t in texts]
        return {"doc_id": doc_ids, "n_tokens": [len(x) // 4 for x in data], "ids": [np.frombuffer(x, np.int32) for x in data], "decoded": [bpe.decode(x) for x in data]}

    return docs.select(F.col("doc_id").cast("long"), F.col("text").cast("string")).mapInArrow(batches(fn, schema), "doc_id long, n_tokens long, ids array<int>, decoded string")


def decode(encoded: DataFrame, path: str) -> DataFrame:
    """(doc_id, text) for each row of (doc_id, ids): the arcs' labels in turn. Null ids give an empty text; an unknown id is an error."""
    schema = pa.schema([("doc_id", pa.int64()), ("text", pa.string())])
    fn = batches(lambda ids, seqs: {"doc_id": ids, "text": [load(path).decode(array("i", s or []).tobytes()) for s in seqs]}, schema)
    return encoded.select(F.col("doc_id").cast("long"), F.col("ids").cast("array<int>")).mapInArrow(fn, "doc_id long, text string")
