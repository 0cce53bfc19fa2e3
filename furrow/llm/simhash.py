"""SimHash near-duplicates through pigeonring filtering.

A fingerprint is a ring of four 16-bit segments. If two differ in at most three bits, some segment
starts a chain whose first l segments differ in at most floor(3 l / 4) bits for every l: none in the
first, one in the first two, two in the first three. So the pair shares, for some start, that segment
whole, a half of the next and a third of the one after: 24 exact keys of 29 or 30 bits each. Pairs
under a key pass the chain's budgets and then the full Hamming check.

Equal fingerprints count once. Under a key, links are found by a search that leaves out what is
already reached, so a group of n gives at most n - 1 links, never all pairs. Where many fingerprints
share a key, the bits it leaves are cut into one part more than may differ, of which any linked pair
shares one whole: the key is dealt on by these parts, and again within a task as long as that helps.
Components of the links come from alternating large-star and small-star steps, each written to the
shared folder.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from xxhash import xxh64_intdigest

from ..operators.components import connected_components, meet
from .common import keyed, large, materialize, parts, slices, table

SHINGLE, SEED, DISTANCE = 3, 42, 3
#: Fingerprints under a key beyond which it is dealt on; those that are compared at once within a task;
#: comparisons a fingerprint after which a search is dealt on; share of all rows that makes a print hot.
KEY_PRINTS, AT_ONCE, PATIENCE, HOT_SHARE = 20_000, 512, 64, 1 / 1000
LOWER = bytes(b + 32 if 0x41 <= b <= 0x5A else b for b in range(256))
PRINT_SCHEMA = "doc_id long, key_1 long, key_2 long, fp long"
#: Bits of a segment from its high end: halves, thirds.
HALVES, THIRDS = ((8, 8), (0, 8)), ((10, 6), (5, 5), (0, 5))


def hashes(text: str | None) -> list[int]:
    """XXH64 of each shingle of a whole text, repeats included; of all words if they are fewer."""
    words = text.encode("utf-8", "surrogatepass").translate(LOWER).split() if text else []
    if not words:
        return []
    flat = b" ".join(words)
    if len(words) <= SHINGLE:
        return [xxh64_intdigest(flat, SEED)]
    ends = np.cumsum(np.fromiter(map(len, words), np.int64, len(words)) + 1)
    starts = [0, *ends[: -SHINGLE].tolist()]
    return [xxh64_intdigest(flat[a : b - 1], SEED) for a, b in zip(starts, ends[SHINGLE - 1 :].tolist(), strict=True)]


def fingerprints(texts: list[str | None]) -> np.ndarray:
    """Unsigned 64-bit fingerprints; zero for a text without words."""
    out = np.zeros(len(texts), np.uint64)
    for a, b in slices(texts):
        own = [hashes(t) for t in texts[a:b]]
        n = np.array([len(h) for h in own])
        have = np.flatnonzero(n)
        if len(have):
            flat = np.array([x for h in own for x in h], "<u8")
            bits = np.unpackbits(flat.view(np.uint8).reshape(-1, 8), axis=1, bitorder="little")
            counts = np.add.reduceat(bits, np.cumsum(n[have]) - n[have], axis=0, dtype=np.int64)
            out[a + have] = np.packbits(2 * counts > n[have][:, None], axis=1, bitorder="little").view("<u8").ravel()
    return out


def _prints(batches):
    large()
    for batch in parts(batches, 3):
        fps = fingerprints(batch.column(3).to_pylist())
        yield pa.RecordBatch.from_arrays([*batch.columns[:3], pa.array(fps.view(np.int64))], names=["doc_id", "key_1", "key_2", "fp"])


def _segment(i: int) -> Column:
    return F.shiftrightunsigned("fp", 48 - 16 * (i % 4)).bitwiseAND(F.lit(0xFFFF).cast("long"))


def _keys() -> list[Column]:
    """The 24 keys of a fingerprint: table number above 32 bits of value."""
    out = []
    for i in range(4):
        for j, (h_at, h_bits) in enumerate(HALVES):
            for k, (t_at, t_bits) in enumerate(THIRDS):
                half = F.shiftright(_segment(i + 1), h_at).bitwiseAND(F.lit((1 << h_bits) - 1).cast("long"))
                third = F.shiftright(_segment(i + 2), t_at).bitwiseAND(F.lit((1 << t_bits) - 1).cast("long"))
                value = F.shiftleft(_segment(i), 16).bitwiseOR(F.shiftleft(half, 8)).bitwiseOR(third)
                out.append(F.lit((i * 6 + j * 3 + k) << 32).cast("long").bitwiseOR(value))
    return out


def key_masks() -> list[list[int]]:
    """The bits that each table's keys leave, in DISTANCE + 1 parts, as signed masks."""
    out = []
    for i in range(4):
        for h_at, h_bits in HALVES:
            for t_at, t_bits in THIRDS:
                place = lambda j, at: 48 - 16 * (j % 4) + at
                held = {place(i, k) for k in range(16)} | {place(i + 1, h_at + k) for k in range(h_bits)} | {place(i + 2, t_at + k) for k in range(t_bits)}
                left = [k for k in range(64) if k not in held]
                masks = [sum(1 << k for k in left[c :: DISTANCE + 1]) for c in range(DISTANCE + 1)]
                out.append([m - (1 << 64) if m >> 63 else m for m in masks])
    return out


def near(c: np.uint64, others: np.ndarray, start: int) -> np.ndarray:
    """Which others lie within DISTANCE of c, the chain from segment ``start`` first."""
    x = others ^ c
    turn = np.uint64(16 * start)
    ring = (x << turn) | (x >> (np.uint64(64) - turn)) if start else x
    two = np.bitwise_count(ring >> np.uint64(32))
    at = np.flatnonzero(two <= 1)
    at = at[np.bitwise_count(ring[at] >> np.uint64(16)) <= 2]
    return at[np.bitwise_count(ring[at]) <= DISTANCE]


Links = list[tuple[np.ndarray, np.ndarray]]


def linked(fps: np.ndarray, start: int) -> Links:
    """Links that join what is connected within one key's distinct fingerprints, as pairs of arrays.

    What was compared with all that is left needs no further look; when the rest doesn't shrink fast
    enough, it is dealt on by parts of the bits in which it differs.
    """
    out: Links = []
    if len(fps) <= AT_ONCE:
        return among(fps, start)
    left, reached, cost = fps, [], 0
    while len(left) and cost <= PATIENCE * len(fps):
        if not reached:
            reached, left = [left[0]], left[1:]
        c = reached.pop()
        cost += len(left)
        hit = near(c, left, start)
        if len(hit):
            out.append((np.full(len(hit), c), left[hit]))
            reached += list(left[hit])
            left = np.delete(left, hit)
    if not len(left):
        return out
    rest = np.concatenate((np.array(reached, np.uint64), left))
    differ = np.bitwise_or.reduce(rest ^ rest[0])
    bits = [k for k in range(64) if int(differ) >> k & 1]
    masks = [np.uint64(sum(1 << k for k in bits[c :: DISTANCE + 1])) for c in range(DISTANCE + 1)]
    for mask in masks if len(rest) > AT_ONCE else ():
        part = rest & mask
        order = np.argsort(part, kind="stable")
        edge = np.flatnonzero(np.diff(part[order])) + 1
        for own in np.split(rest[order], edge):
            if len(own) > 1:
                out += linked(own, start)
    return out if len(rest) > AT_ONCE else out + among(rest, start)


def among(fps: np.ndarray, start: int) -> Links:
    """The same for few fingerprints, all compared at once by the chain's budgets."""
    turn = np.uint64(16 * start)
    ring = (fps << turn) | (fps >> (np.uint64(64) - turn)) if start else fps
    x = ring[:, None] ^ ring
    pair = np.bitwise_count(x >> np.uint64(32)) <= 1
    pair &= np.bitwise_count(x >> np.uint64(16)) <= 2
    pair &= np.bitwise_count(x) <= DISTANCE
    out, unseen = [], np.ones(len(fps), bool)
    for k in np.flatnonzero(pair.sum(1) > 1).tolist():
        if unseen[k]:
            unseen[k], reached = False, [k]
            while reached:
                c = reached.pop()
                hit = np.flatnonzero(pair[c] & unseen)
                if len(hit):
                    out.append((np.full(len(hit), fps[c]), fps[hit]))
                    unseen[hit] = False
                    reached += hit.tolist()
    return out


def _links(batches):
    """Links under each key (and part) of rows sorted by them; only the last one's fingerprints wait for more."""
    large()
    held: list[tuple[np.ndarray, ...]] = []

    def found():
        """Of whole keys in held."""
        key, part, bits, fps = (np.concatenate(x) for x in zip(*held, strict=True))
        at = np.concatenate(([0], np.flatnonzero((np.diff(key) != 0) | (np.diff(part) != 0) | (np.diff(bits) != 0)) + 1, [len(key)]))
        out: Links = []
        for a in np.flatnonzero(np.diff(at) > 1):
            out += linked(np.unique(fps[at[a] : at[a + 1]]), int(key[at[a]] >> 32) // 6)
        for a in range(0, max(1, len(out)), 1000):
            some = [np.concatenate(x).view(np.int64) for x in zip(*out[a : a + 1000], strict=True)] or [np.zeros(0, np.int64)] * 2
            yield pa.RecordBatch.from_arrays([pa.array(x) for x in some], names=["u", "v"])

    for batch in batches:
        if not batch.num_rows:
            continue
        rows = *(batch.column(k).to_numpy() for k in range(3)), batch.column(3).to_numpy().view(np.uint64)
        other = np.flatnonzero(np.logical_or.reduce([x != x[-1] for x in rows[:3]]))
        cut = int(other[-1]) + 1 if len(other) else 0
        if cut:
            held.append(tuple(x[:cut] for x in rows))
        if cut or (held and any(x[-1] != y[0] for x, y in zip(held[-1][:3], rows[:3], strict=True))):
            yield from found()
            held = []
        held.append(tuple(x[cut:] for x in rows))
    if held:
        yield from found()


def links(prints: DataFrame, key_prints: int = KEY_PRINTS) -> DataFrame:
    """u, v: pairs of different fingerprints that join all that is linked, for distinct fp in prints."""
    dealt = prints.select("fp", F.explode(F.array(*_keys())).alias("key"))
    none = [F.lit(-1).alias("part"), F.lit(0).cast("long").alias("bits")]
    out = dealt.select("key", *none, "fp")
    # A key of so many prints has a segment of so many: 4 * 2^16 counts tell whether keys need be counted.
    by_segment = prints.select(F.posexplode(F.array(*map(_segment, range(4)))).alias("i", "segment")).groupBy("i", "segment").count()
    dense = materialize(by_segment.where(F.col("count") > key_prints).select("i", "segment"))
    if not dense.isEmpty():
        place = [F.floor(F.shiftright("key", 32) / 6).cast("int").alias("i"), F.shiftright("key", 16).bitwiseAND(F.lit(0xFFFF).cast("long")).alias("segment")]
        some = dealt.select("key", *place).join(F.broadcast(dense), ["i", "segment"], "left_semi")
        hot = materialize(some.groupBy("key").count().where(F.col("count") > key_prints).select("key"))
        masks = F.array(*[F.array(*[F.lit(m).cast("long") for m in row]) for row in key_masks()])
        row = F.element_at(masks, F.shiftright("key", 32).cast("int") + 1)
        more = dealt.join(hot, "key").select("key", F.posexplode(row).alias("part", "mask"), "fp")
        out = dealt.join(hot, "key", "left_anti").select("key", *none, "fp").union(more.select("key", "part", F.col("mask").bitwiseAND(F.col("fp")), "fp"))
    by = ["key", "part", "bits"]
    return out.repartition(*by).sortWithinPartitions(*by, "fp").mapInArrow(_links, "u long, v long").distinct()


def _prints_of(docs: DataFrame) -> DataFrame:
    """doc_id, two hashes that tell rows apart by doc_id and text, and the fingerprint."""
    d = keyed(docs, "doc_id")
    keys = [F.xxhash64(F.lit(k), F.col("doc_id").isNull(), "doc_id", F.col("text").isNull(), "text").alias(f"key_{k}") for k in (1, 2)]
    return materialize(d.select("doc_id", *keys, "text").mapInArrow(_prints, PRINT_SCHEMA))


def _roots(prints: DataFrame) -> DataFrame:
    """fp, root, n (rows) and first (its first row by doc_id and keys) of each distinct fingerprint, written."""
    first = F.min(F.struct(F.col("doc_id").isNull().alias("none"), "doc_id", "key_1", "key_2")).alias("first")
    distinct = materialize(prints.groupBy("fp").agg(F.count("*").alias("n"), first))
    joined = connected_components(links(distinct)).withColumnRenamed("node", "fp")
    return materialize(distinct.join(joined, "fp", "left").select("fp", "n", "first", F.coalesce("root", "fp").alias("root")))


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, fingerprint, component_id for every row of docs.

    A null or empty text has fingerprint zero and links like any other. Repeated rows share a
    component; a null doc_id takes part, but names a component only where no other id does (null).
    Fingerprints of more than a thousandth of all rows, less than a thousand, are broadcast with their
    components, so their rows don't move; nor do the fingerprints of a component of very many.
    """
    prints = _prints_of(docs)
    named = _roots(prints)
    least = named.groupBy("root").agg(F.min("first.doc_id").alias("component_id"), F.count("*").alias("size"))
    by_print = meet(named.select("fp", "n", "root"), least, ["root"], named.count()).select("fp", "n", "component_id")
    hot_rows = F.col("n") > named.agg(F.sum("n")).first()[0] * HOT_SHARE if not named.isEmpty() else F.lit(False)
    hot = F.broadcast(by_print.where(hot_rows).drop("n"))
    rest = prints.join(hot, "fp", "left_anti").join(by_print.where(~hot_rows).drop("n"), "fp")
    both = prints.join(hot, "fp").unionByName(rest)
    return both.select("doc_id", F.lpad(F.lower(F.hex("fp")), 16, "0").alias("fingerprint"), "component_id")


def representatives(docs: DataFrame) -> DataFrame:
    """The rows of docs, all columns, that stand for their component: one of the smallest doc_id (a null
    is the largest), of rows of that id one, by hashes.

    Who stays is decided on hashes of rows; texts move once, to meet their keys.
    """
    first = _roots(_prints_of(docs)).groupBy("root").agg(F.min("first").alias("first"))
    kept = materialize(first.select("first.key_1", "first.key_2"))
    own = [F.xxhash64(F.lit(k), docs["doc_id"].cast("long").isNull(), docs["doc_id"].cast("long"), docs["text"].cast("string").isNull(), docs["text"].cast("string")) for k in (1, 2)]
    names = [f"key_{k}" + "_" * sum(c.startswith("key_") for c in docs.columns) for k in (1, 2)]
    met = docs.withColumns(dict(zip(names, own, strict=True))).join(kept.toDF(*names), names, "left_semi")
    return met.dropDuplicates(names).select(*docs.columns)


def op9_simhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"))
