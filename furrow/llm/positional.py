"""Positional inverted index over shards of documents.

A shard is a run of consecutive words of whole documents: its terms, and for each term the ascending
positions where it stands. Words of all documents of the shard are numbered through. A phrase is
found by intersecting its terms' position lists, each moved back by the term's offset in the phrase,
from the shard's rarest term on; lists are searched, never scanned.
"""

from __future__ import annotations

from collections import defaultdict
from itertools import repeat

import numpy as np

from .common import slices

#: Bytes of UTF-8 that part words; A-Z to lower case.
WORD_BYTES = bytes(b if b >= 0x80 or 0x30 <= b <= 0x39 or 0x61 <= b <= 0x7A else b + 32 if 0x41 <= b <= 0x5A else 0x20 for b in range(256))
#: (phrase, place) pairs that a search holds at a time.
CANDIDATES = 500_000


def byte_words(text: str | None) -> list[bytes]:
    """The words ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+`` of a text after A-Z went to lower case, as UTF-8."""
    return text.encode("utf-8", "surrogatepass").translate(WORD_BYTES).split() if text else []


class Shard:
    """terms, their position lists (term k: postings[first[k]:first[k + 1]]) and the documents' ends."""

    def __init__(self, terms: list[bytes], first: np.ndarray, postings: np.ndarray, ends: np.ndarray) -> None:
        self.terms, self.first, self.postings, self.ends = terms, first, postings, ends

    @classmethod
    def of(cls, texts: list[str | None]) -> Shard:
        number: defaultdict[bytes, int] = defaultdict()
        number.default_factory = number.__len__
        parts, ends, n = [], [], 0
        for t in texts:
            own = byte_words(t)
            parts.append(np.fromiter(map(number.__getitem__, own), np.int32, len(own)))
            n += len(own)
            ends.append(n)
        ids = np.concatenate(parts) if parts else np.zeros(0, np.int32)
        first = np.concatenate(([0], np.cumsum(np.bincount(ids, minlength=len(number)))))
        return cls(list(number), first.astype(np.int64), np.argsort(ids, kind="stable").astype(np.int32), np.array(ends, np.int64))

    def named(self, vocabulary: dict[bytes, int]) -> Shard:
        """Only the vocabulary's terms, numbered as there; a term that isn't here has an empty list."""
        gid = np.fromiter(map(vocabulary.get, self.terms, repeat(-1)), np.int64, len(self.terms))
        have = np.flatnonzero(gid >= 0)
        have = have[np.argsort(gid[have], kind="stable")]
        counts = np.zeros(len(vocabulary), np.int64)
        counts[gid[have]] = np.diff(self.first)[have]
        lists = [self.postings[self.first[k] : self.first[k + 1]] for k in have]
        return Shard(list(vocabulary), np.concatenate(([0], np.cumsum(counts))), np.concatenate(lists) if lists else np.zeros(0, np.int32), self.ends)

    def by_term(self) -> Shard:
        """The same with terms in ascending order."""
        order = sorted(range(len(self.terms)), key=self.terms.__getitem__)
        lists = [self.postings[self.first[k] : self.first[k + 1]] for k in order]
        first = np.concatenate(([0], np.cumsum(self.counts[order]))) if order else self.first
        return Shard([self.terms[k] for k in order], first, np.concatenate(lists) if lists else self.postings, self.ends)

    def documents(self) -> np.ndarray:
        """In how many documents each term stands."""
        if not len(self.terms):
            return np.zeros(0, np.int64)
        doc = self.doc(self.postings)
        begins = np.concatenate(([True], doc[1:] != doc[:-1]))
        begins[self.first[:-1]] = True
        return np.add.reduceat(begins, self.first[:-1], dtype=np.int64)

    @property
    def counts(self) -> np.ndarray:
        return np.diff(self.first)

    def doc(self, positions: np.ndarray) -> np.ndarray:
        """The documents (from 0) of positions."""
        return np.searchsorted(self.ends, positions, "right")

    def find(self, phrases: np.ndarray, slop: int = 0, frequency: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
        """(start, phrase) of all places of phrases: rows of term numbers, all of one length.

        A term counts as in place if it stands within slop words of where the rarest term wants it;
        start is then where the phrase would begin. A place lies in one document. frequency: of each
        term in the whole corpus, by which the rarest is told; without it the shard's own counts.
        """
        size = phrases.shape[1]
        n, lens = int(self.ends[-1]) if len(self.ends) else 0, self.counts
        live = np.flatnonzero((lens[phrases] > 0).all(axis=1)) if len(phrases) and n else np.zeros(0, np.int64)
        order = np.argsort((lens if frequency is None else frequency)[phrases[live]], axis=1, kind="stable")
        anchors = phrases[live, order[:, 0]] if len(live) else np.zeros(0, np.int64)
        key = np.repeat(np.arange(len(lens)), lens) * (n + 1) + self.postings  # ascending: by term, then position
        starts, found = [], []
        sums = np.cumsum(lens[anchors])
        a = 0
        while a < len(live):
            b = max(a + 1, int(np.searchsorted(sums, (sums[a - 1] if a else 0) + CANDIDATES, "right")))
            reps = np.repeat(np.arange(a, b), lens[anchors[a:b]])
            within = np.arange(len(reps)) - np.repeat(np.cumsum(lens[anchors[a:b]]) - lens[anchors[a:b]], lens[anchors[a:b]])
            at = self.postings[self.first[anchors[reps]] + within].astype(np.int64) - order[reps, 0]
            for j in range(1, size):
                term, want = phrases[live[reps], order[reps, j]], at + order[reps, j]
                low = np.clip(want - slop, 0, n)
                k = np.searchsorted(key, term * (n + 1) + low)
                got = key[np.minimum(k, len(key) - 1)]
                good = (k < len(key)) & (got <= term * (n + 1) + np.minimum(want + slop, n)) & (want + slop >= 0)
                at, reps = at[good], reps[good]
            starts.append(at)
            found.append(live[reps])
            a = b
        at, which = (np.concatenate(x) if x else np.zeros(0, np.int64) for x in (starts, found))
        low, high = np.maximum(at - slop * bool(slop), 0), np.minimum(at + size - 1, n - 1)
        good = (at >= 0) & (at + size <= n) & (self.doc(low if not slop else np.maximum(at, 0)) == self.doc(high)) if n else np.zeros(0, bool)
        return at[good], which[good]


def shards(texts: list[str | None], chars: int = 4_000_000):
    """(a, b, Shard of texts[a:b]) over texts; a longer text stands alone."""
    for a, b in slices(texts, chars):
        yield a, b, Shard.of(texts[a:b])
