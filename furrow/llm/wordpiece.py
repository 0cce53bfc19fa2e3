"""Greedy word-piece counts by a linear longest-match automaton.

The trie of a vocabulary has two roots: one for pieces that begin a word, one for those inside.
Where a node has no child for the next byte, its failure link leads to the node that greedy matching
would stand at after popping pieces off the front; how many it pops is precomputed. Reading a word
follows each byte once and adds up popped counts, so no piece is ever built. Words met again come
from a cache.
"""

from __future__ import annotations

import json
import os

import pyarrow as pa
import public_tokenizers
from pyspark.sql import DataFrame

from .common import keyed, large, table
from .tokens import KEPT, byte_table

VOCABULARY = "byte_bpe_50k.json"
OUT_SCHEMA = "doc_id long, n_words long, n_tokens long, n_unknown long"


class Automaton:
    """Nodes are numbers; 0 is the root of word-initial pieces, 1 that of pieces inside a word."""

    def __init__(self, initial: list[bytes], inner: list[bytes]) -> None:
        self.child: dict[int, int] = {}  # node * 256 + byte -> node
        ends = [False, False]
        by_depth: list[list[tuple[int, int, int]]] = []  # (node, parent, byte)
        for root, pieces in ((0, initial), (1, inner)):
            for p in pieces:
                v = root
                for depth, b in enumerate(p):
                    nxt = self.child.get(v << 8 | b)
                    if nxt is None:
                        nxt = self.child[v << 8 | b] = len(ends)
                        ends.append(False)
                        while len(by_depth) <= depth:
                            by_depth.append([])
                        by_depth[depth].append((nxt, v, b))
                    v = nxt
                ends[v] = v > 1
        self.fail: list[int] = [-1] * len(ends)  # -1: nothing pops, the word is unknown
        self.popped: list[int] = [0] * len(ends)
        for nodes in by_depth:  # parents, and all nodes of shorter strings, come first
            for v, parent, b in nodes:
                if ends[v]:
                    self.fail[v], self.popped[v] = 1, 1
                    continue
                n, z = self.popped[parent], self.fail[parent]
                while z >= 0 and (z << 8 | b) not in self.child:
                    n, z = n + self.popped[z], self.fail[z]
                if z >= 0:
                    self.fail[v], self.popped[v] = self.child[z << 8 | b], n

    def count(self, word: bytes) -> int:
        """Greedy pieces of a word; -1 if it has no greedy split."""
        child, fail, popped = self.child, self.fail, self.popped
        v = n = 0
        for b in word:
            nxt = child.get(v << 8 | b)
            while nxt is None:
                n += popped[v]
                v = fail[v]
                if v < 0:
                    return -1
                nxt = child.get(v << 8 | b)
            v = nxt
        while v > 1:
            n += popped[v]
            v = fail[v]
        return n if v == 1 else -1


def vocabulary(name: str = VOCABULARY) -> tuple[list[bytes], list[bytes]]:
    """(word-initial, inner) pieces of a byte-level vocabulary, whose initial ones begin with a blank."""
    with open(name if os.sep in name else public_tokenizers.path(name)) as f:
        model = json.load(f)
    special = {x["content"] for x in model["added_tokens"]}
    shown = {c: b for b, c in byte_table().items()}
    pieces = [bytes(map(shown.__getitem__, t)) for t in model["model"]["vocab"] if t not in special]
    return [p for p in pieces if p[0] == 0x20], [p for p in pieces if p[0] != 0x20]


class _Counts(dict):
    """Word -> pieces, or 1 << 32 for an unknown word."""

    def __init__(self, automaton: Automaton) -> None:
        self.automaton = automaton

    def __missing__(self, word: bytes) -> int:
        n = self.automaton.count(b" " + word)
        n = n if n >= 0 else 1 << 32
        if len(word) < 1000:
            if len(self) >= KEPT:
                self.clear()
            self[word] = n
        return n


def counter(name: str) -> _Counts:
    """The worker's counts for a vocabulary file; they stay between tasks."""
    return large(("counts", name), lambda: _Counts(Automaton(*vocabulary(name))))


def _count(name: str):
    def run(batches):
        pieces = counter(name).__getitem__
        for batch in batches:
            n_words, n_tokens, n_unknown = [], [], []
            for text in batch.column(1):
                words = (text.as_py() or "").encode("utf-8", "surrogatepass").split()
                total = sum(map(pieces, words))
                n_words.append(len(words))
                n_unknown.append(total >> 32)
                n_tokens.append((total & 0xFFFFFFFF) + (total >> 32))
            yield pa.RecordBatch.from_arrays([batch.column(0), *(pa.array(x, pa.int64()) for x in (n_words, n_tokens, n_unknown))], names=["doc_id", "n_words", "n_tokens", "n_unknown"])

    return run


def token_counts(docs: DataFrame, name: str = VOCABULARY) -> DataFrame:
    """doc_id, n_words, n_tokens, n_unknown for every row of docs.

    A word is what stands between ASCII white space; it is split greedily into the longest pieces, and
    counts as one token where that fails. A null or empty text has none. Repeated rows each give a row.
    """
    return keyed(docs, "doc_id").mapInArrow(_count(name), OUT_SCHEMA)


def op6_token_counts(spark, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"))
