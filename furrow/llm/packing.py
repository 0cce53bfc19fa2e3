"""Best-fit packing of documents into sequences, with swap-based local search.

Pieces are dealt into groups by a hash of their key and place, so equal ones spread too. Each group is packed best-fit decreasing; then
the local search takes the underfull bins, least filled first, and lets each give: a piece to a
fuller bin, a piece for a smaller one, one for two, or two for one. A step is taken only if it raises
the sum of squared fills, and the search ends when no bin can take one; a bin that has given
everything is gone. What is left underfull in all groups is dealt and packed once more, so groups
cost at most a few bins in all.
"""

from __future__ import annotations

import zlib
from collections import defaultdict
from heapq import heappop, heappush
from itertools import combinations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, materialize, table
from .tokens import encoder

TOKENIZER, END_ID, CAPACITY = "word_bpe_49k.json", 1, 4096
#: Pieces in a packing group: what one task holds (some 40 bytes each).
GROUP_PIECES = 65_536

PIECE_SCHEMA = "doc_id long, piece int, start long, length long, ids_crc32 long"
PLACED_SCHEMA = PIECE_SCHEMA + ", sequence_id long, offset long, fill long"


def best_fit_decreasing(lengths: np.ndarray, capacity: int) -> list[list[int]]:
    """Bins of indices. A bin of the least sufficient gap takes each piece, longest first."""
    by_gap: list[list[list[int]]] = [[] for _ in range(capacity + 1)]
    open_gaps = 0  # bit g: some bin has gap g
    bins: list[list[int]] = []
    for i in np.argsort(-lengths, kind="stable").tolist():
        n = int(lengths[i])
        fits = open_gaps >> n
        if fits:
            g = n + (fits & -fits).bit_length() - 1
            own = by_gap[g].pop()
            if not by_gap[g]:
                open_gaps &= ~(1 << g)
        else:
            own, g = [], capacity
            bins.append(own)
        own.append(i)
        if g > n:
            by_gap[g - n].append(own)
            open_gaps |= 1 << (g - n)
    return bins


class LocalSearch:
    """Bins of indices into lengths; run() exchanges pieces until no step raises the sum of squared fills.

    A donor gives to bins that are at least as full. For every length, the most room of a bin with a
    piece (kind 0) or two pieces (kind 1) of that length is kept up to date, so a donor's steps are
    looked up, and that there is none is known without a search of the bins.
    """

    def __init__(self, bins: list[list[int]], lengths: np.ndarray, capacity: int) -> None:
        self.capacity = capacity
        self.bins: list[defaultdict[int, list[int]]] = []
        for b in bins:
            own: defaultdict[int, list[int]] = defaultdict(list)
            for i in b:
                own[int(lengths[i])].append(i)
            self.bins.append(own)
        self.fill = [int(lengths[b].sum()) for b in bins]
        self.turn = [0] * len(bins)

    def sums(self, b: int) -> tuple[set[int], set[int]]:
        """Lengths of a piece and of two pieces in bin b."""
        own = self.bins[b]
        return set(own), {x + y for x, y in combinations(own, 2)} | {2 * x for x, i in own.items() if len(i) > 1}

    def enter(self, b: int) -> None:
        """Bin b can receive from now on."""
        gap, self.known = self.capacity - self.fill[b], [None, None]
        if not gap:
            return
        self.by_gap[gap].add(b)
        self.gaps |= 1 << gap
        heappush(self.least, (self.fill[b], b, self.turn[b]))
        for kind, sums in enumerate(self.sums(b)):
            for n in sums:
                heappush(self.rooms[kind][n], (-gap, b, self.turn[b]))
                self.reach[kind][n] = max(self.reach[kind][n], n + gap)

    def leave(self, b: int) -> None:
        gap, self.known = self.capacity - self.fill[b], [None, None]
        self.turn[b] += 1
        self.by_gap[gap].discard(b)
        if not self.by_gap[gap]:
            self.gaps &= ~(1 << gap)
        for kind, sums in enumerate(self.sums(b)):
            for n in sums:
                heap = self.rooms[kind][n]
                while heap and self.turn[heap[0][1]] != heap[0][2]:
                    heappop(heap)
                self.reach[kind][n] = n - heap[0][0] if heap else 0

    def taken(self, kind: int) -> np.ndarray:
        """Which lengths some bin takes for a shorter piece or two."""
        if self.known[kind] is None:
            n = np.flatnonzero(self.reach[kind])
            edge = np.bincount(n + 1, minlength=self.capacity + 2) - np.bincount(self.reach[kind][n] + 1, minlength=self.capacity + 2)
            self.known[kind] = np.cumsum(edge) > 0
        return self.known[kind]

    def shift(self, give: list[int], take: list[int], donor: int, to: int) -> None:
        """Pieces of the lengths ``give`` for pieces of the lengths ``take``; the donor can't receive just now."""
        self.leave(to)
        for some, a, b in ((give, donor, to), (take, to, donor)):
            for n in some:
                self.bins[b][n].append(self.bins[a][n].pop())
                if not self.bins[a][n]:
                    del self.bins[a][n]
                self.fill[a] -= n
                self.fill[b] += n
        self.enter(to)

    def give(self, donor: int) -> bool:
        """One improving step of the donor: of the first kind that there is, the one that moves the most."""
        own = sorted(self.bins[donor], reverse=True)
        for x in own:  # move, to the bin of the least sufficient gap
            if fits := self.gaps >> x:
                to = min(self.by_gap[x + (fits & -fits).bit_length() - 1])
                self.shift([x], [], donor, to)
                return True
        pairs = [[x, x] for x in own if len(self.bins[donor][x]) > 1] + [list(p) for p in combinations(own, 2)]
        for kind, offers in ((0, [[x] for x in own]), (0, pairs), (1, [[x] for x in own])):
            taken, best = self.taken(kind), (0, 0, [])
            for offer in offers:
                n = sum(offer)
                if n <= self.capacity and taken[n]:
                    least = int((self.reach[kind][:n] >= n).argmax())
                    best = max(best, (n - least, least, offer))
            if best[0]:
                _, least, offer = best
                to = self.rooms[kind][least][0][1]
                self.shift(offer, self.parted(to, least) if kind else [least], donor, to)
                return True
        return False

    def parted(self, b: int, n: int) -> list[int]:
        """Two lengths of bin b that add up to n."""
        own = self.bins[b]
        return next([x, n - x] for x in sorted(own) if n - x in own and (2 * x != n or len(own[x]) > 1))

    def sweep(self) -> bool:
        """Lets every underfull bin, least filled first, give what it can; whether any could."""
        self.by_gap: list[set[int]] = [set() for _ in range(self.capacity + 1)]
        self.rooms = (defaultdict(list), defaultdict(list))
        self.reach = np.zeros((2, self.capacity + 1), np.int64)
        self.gaps, self.least, self.known, gave = 0, [], [None, None], False
        for b, n in enumerate(self.fill):
            if n:
                self.enter(b)
        while self.least:
            _, b, turn = heappop(self.least)
            if self.turn[b] == turn:
                self.leave(b)
                while self.fill[b] and self.give(b):
                    gave = True
        return gave

    def run(self) -> list[list[int]]:
        while self.sweep():
            pass
        return [[i for own in b.values() for i in own] for b, n in zip(self.bins, self.fill, strict=True) if n]


def pack(lengths: np.ndarray, capacity: int = CAPACITY) -> list[list[int]]:
    """Bins of indices into lengths (1 to capacity each)."""
    bins = best_fit_decreasing(lengths, capacity)
    full = [b for b in bins if lengths[b].sum() == capacity]
    return full + LocalSearch([b for b in bins if lengths[b].sum() < capacity], lengths, capacity).run()


def _pieces(tokenizer: str, end_id: int, capacity: int):
    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        for batch in batches:
            out = []
            for doc_id, text in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
                ids = enc.encode(text.as_py() or "") + end
                for k, a in enumerate(range(0, len(ids), 4 * capacity)):
                    part = ids[a : a + 4 * capacity]
                    out.append((doc_id, k, a // 4, len(part) // 4, zlib.crc32(part)))
            cols = list(zip(*out, strict=True)) or [[]] * 5
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()), strict=True)], names=["doc_id", "piece", "start", "length", "ids_crc32"])

    return run


def pieces(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32: whole documents, only those over capacity cut."""
    return keyed(docs, "doc_id").mapInArrow(_pieces(tokenizer, end_id, capacity), PIECE_SCHEMA)


def _place(capacity: int, round_no: int):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        t = t.sort_by([(c, "ascending") for c in ("doc_id", "piece", "ids_crc32", "length")])
        lengths = t.column("length").to_numpy()
        seq, offset, fill = (np.zeros(len(lengths), np.int64) for _ in range(3))
        base = (2 * key[0].as_py() + round_no) << 24
        for k, own in enumerate(pack(lengths, capacity)):
            own = sorted(own)
            ends = np.cumsum(lengths[own])
            seq[own], offset[own], fill[own] = base + k, ends - lengths[own], ends[-1]
        return t.select(PIECES).append_column("sequence_id", pa.array(seq)).append_column("offset", pa.array(offset)).append_column("fill", pa.array(fill))

    return run


PIECES = ["doc_id", "piece", "start", "length", "ids_crc32"]


def _round(found: DataFrame, n: int, capacity: int, round_no: int) -> DataFrame:
    groups = -(-max(n, 1) // GROUP_PIECES)
    # The place keeps repeated rows of one key out of one group; found is read from files, so it stays.
    dealt = found.select(*PIECES, F.monotonically_increasing_id().alias("at")).select(*PIECES, F.pmod(F.xxhash64(*PIECES, "at"), F.lit(groups)).alias("g"))
    return dealt.groupBy("g").applyInArrow(_place(capacity, round_no), PLACED_SCHEMA)


def pack_documents(docs: DataFrame, tokenizer: str = TOKENIZER, end_id: int = END_ID, capacity: int = CAPACITY) -> DataFrame:
    """doc_id, piece, start, length, ids_crc32, sequence_id, offset for every piece of docs.

    A null text is an empty one: its end id alone is a piece. Repeated rows and null doc_ids are
    pieces of their own. An empty table gives no row. Only lengths and keys move, never texts.
    """
    found = materialize(pieces(docs, tokenizer, end_id, capacity))
    whole = F.col("length") == capacity
    first = materialize(_round(found.where(~whole), found.where(~whole).count(), capacity, 0))
    under = first.where(F.col("fill") < capacity)
    again = _round(under, under.count(), capacity, 1)
    alone = found.where(whole).select(*PIECES, (-1 - F.monotonically_increasing_id()).alias("sequence_id"), F.lit(0).cast("long").alias("offset"))
    cols = [*PIECES, "sequence_id", "offset"]
    return first.where(F.col("fill") == capacity).select(*cols).union(again.select(*cols)).union(alone.select(*cols))


def op2_best_fit_packing(spark, sf_dir: str) -> DataFrame:
    return pack_documents(table(spark, sf_dir, "documents"))
