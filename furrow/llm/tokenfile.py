"""Token files of directly addressable codes.

A segment holds the ids of consecutive documents. Each id is split into chunks of ``bits`` bits, the
lowest first; level 0 has every id's first chunk, level k+1 the next chunk of those ids whose
continuation bit is set in level k. A rank directory beside each level's bitmap counts the set bits
before every 512th, so ``Segment.token(i)`` finds any id from one chunk and one rank a level, without
decoding a block.

Layout, little-endian: ``DAC1``, chunk bits u8, levels u8, documents u64, ids u64, null flags of the
doc_ids (bits), doc_ids i64, ends u64 (each document's last id plus one); then for each level its
length u64, chunks u8, bitmap (bits, low first), directory u64.

Executors can't write plain files to every store, so a segment is one binary cell of a Parquet file;
files are named in the order of their doc_ids.
"""

from __future__ import annotations

import zlib
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import keyed, parts, shared_dir, table
from .tokens import encoder

TOKENIZER, END_ID = "byte_bpe_50k.json", 2
BLOCK = 512
#: Ids after which a segment closes; the last document is always whole.
SEGMENT_IDS = 1_000_000
MAGIC = b"DAC1"

SEGMENT_SCHEMA = "shard int, segment int, shard_start long, n_docs long, n_tokens long, payload binary"
DOC_SCHEMA = "doc_id long, start long, n_tokens long, ids_crc32 long"


def pack_levels(ids: np.ndarray, bits: int = 8) -> list[tuple[np.ndarray, np.ndarray, np.ndarray]]:
    """(chunks, continuation bits, rank directory) of each level; no id: no level."""
    levels, rest = [], ids.astype(np.uint64)
    while len(rest):
        more = rest >> np.uint64(bits)
        go = more > 0
        sums = np.concatenate(([0], np.cumsum(go, dtype=np.uint64)))
        levels.append(((rest & np.uint64((1 << bits) - 1)).astype(np.uint8), go, sums[:-1:BLOCK].astype("<u8")))
        rest = more[go]
    return levels


def write_segment(doc_ids: list[int | None], ends: np.ndarray, ids: np.ndarray, bits: int = 8) -> bytes:
    if not 1 <= bits <= 8:
        raise ValueError("chunks have 1 to 8 bits")
    nulls = np.array([d is None for d in doc_ids], bool)
    levels = pack_levels(ids, bits)
    out = [MAGIC, bytes([bits, len(levels)]), np.array([len(doc_ids), len(ids)], "<u8").tobytes()]
    out += [np.packbits(nulls, bitorder="little").tobytes(), np.array([d or 0 for d in doc_ids], "<i8").tobytes(), np.asarray(ends, "<u8").tobytes()]
    for chunks, go, ranks in levels:
        out += [np.array([len(chunks)], "<u8").tobytes(), chunks.tobytes(), np.packbits(go, bitorder="little").tobytes(), ranks.tobytes()]
    return b"".join(out)


@dataclass
class Level:
    chunks: np.ndarray
    bitmap: np.ndarray
    ranks: np.ndarray

    def go(self, i: int) -> bool:
        return bool(self.bitmap[i >> 3] >> (i & 7) & 1)

    def rank(self, i: int) -> int:
        """Set bits before bit i."""
        at = i // BLOCK
        part = self.bitmap[at * BLOCK // 8 : (i + 7) // 8]
        bits = np.unpackbits(part, bitorder="little")[: i - at * BLOCK]
        return int(self.ranks[at]) + int(bits.sum())


class Segment:
    """A segment's bytes, read in place."""

    def __init__(self, raw: bytes) -> None:
        if raw[:4] != MAGIC:
            raise ValueError("not a segment of directly addressable codes")
        self.bits, n_levels, at = raw[4], raw[5], 6

        def take(dtype: str, n: int) -> np.ndarray:
            nonlocal at
            out = np.frombuffer(raw, dtype, n, at)
            at += out.nbytes
            return out

        n_docs, self.n_tokens = map(int, take("<u8", 2))
        nulls = np.unpackbits(take("u1", (n_docs + 7) // 8), bitorder="little")[:n_docs]
        self.doc_ids = [None if z else int(d) for d, z in zip(take("<i8", n_docs), nulls, strict=True)]
        self.ends = take("<u8", n_docs).astype(np.int64)
        self.levels = []
        for _ in range(n_levels):
            n = int(take("<u8", 1)[0])
            self.levels.append(Level(take("u1", n), take("u1", (n + 7) // 8), take("<u8", (n + BLOCK - 1) // BLOCK)))

    def token(self, i: int) -> int:
        """The id at place i of the segment."""
        if not 0 <= i < self.n_tokens:
            raise IndexError(i)
        out = shift = 0
        for level in self.levels:
            out |= int(level.chunks[i]) << shift
            if not level.go(i):
                break
            i, shift = level.rank(i), shift + self.bits
        return out

    def ids(self) -> np.ndarray:
        """All ids, level by level."""
        out = np.zeros(self.n_tokens, "<u4")
        where = np.arange(self.n_tokens)
        for k, level in enumerate(self.levels):
            out[where] |= level.chunks.astype("<u4") << np.uint32(k * self.bits)
            where = where[np.unpackbits(level.bitmap, bitorder="little")[: len(where)].astype(bool)]
        return out


def _write(tokenizer: str, end_id: int, bits: int):
    def run(batches):
        enc, end = encoder(tokenizer), np.array([end_id], "<u4").tobytes()
        shard, segment, before = TaskContext.get().partitionId(), 0, 0
        doc_ids, ends, held, n = [], [], [], 0

        def closed():
            raw = write_segment(doc_ids, np.array(ends), np.frombuffer(b"".join(held), "<u4"), bits)
            return pa.RecordBatch.from_arrays([pa.array([v], t) for v, t in ((shard, pa.int32()), (segment, pa.int32()), (before, pa.int64()), (len(doc_ids), pa.int64()), (n, pa.int64()), (raw, pa.binary()))], names=["shard", "segment", "shard_start", "n_docs", "n_tokens", "payload"])

        for batch in parts(batches, 1):
            texts = [t or "" for t in batch.column(1).to_pylist()]
            for doc_id, ids in zip(batch.column(0).to_pylist(), enc.encode_all(texts), strict=True):
                part = ids + end
                held.append(part)
                n += len(part) // 4
                doc_ids.append(doc_id)
                ends.append(n)
                if n >= SEGMENT_IDS:
                    yield closed()
                    segment, before = segment + 1, before + n
                    doc_ids, ends, held, n = [], [], [], 0
        if doc_ids:
            yield closed()

    return run


def write_tokens(docs: DataFrame, path: str, tokenizer: str = TOKENIZER, end_id: int = END_ID, bits: int = 8) -> None:
    """Encode the whole texts of docs and write token files to path in ascending doc_id order.

    A null text is an empty one and still gets its end id; null doc_ids come first, equal ones stand
    in the order of their texts' hashes. An empty table gives files without a segment. Texts are dealt
    by ranges of doc_id and hash: a doc_id that many rows share spreads over tasks, and the sample that
    the driver takes for the ranges holds no text.
    """
    n = int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    dealt = keyed(docs, "doc_id").withColumn("h", F.xxhash64("text")).repartitionByRange(n, "doc_id", "h")
    dealt.sortWithinPartitions("doc_id", "h", "text").select("doc_id", "text").mapInArrow(_write(tokenizer, end_id, bits), SEGMENT_SCHEMA).write.parquet(path)


def _read(batches):
    for batch in batches:
        for start, raw in zip(batch.column(0).to_pylist(), batch.column(1), strict=True):
            s = Segment(raw.as_py())
            flat = memoryview(s.ids().tobytes())
            at = np.concatenate(([0], s.ends))
            crcs = [zlib.crc32(flat[4 * a : 4 * b]) for a, b in zip(at[:-1], at[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([pa.array(s.doc_ids, pa.int64()), pa.array(at[:-1] + start, pa.int64()), pa.array(np.diff(at), pa.int64()), pa.array(crcs, pa.int64())], names=["doc_id", "start", "n_tokens", "ids_crc32"])


def read_tokens(spark, path: str) -> DataFrame:
    """One row per document of the files at path: doc_id, start, n_tokens, ids_crc32.

    The driver gets one row per shard (as many as write_tokens had partitions) for the starts.
    """
    files = spark.read.schema(SEGMENT_SCHEMA).parquet(path)
    sums = files.groupBy("shard").agg(F.sum("n_tokens").alias("n")).collect()
    starts, before = [], 0
    for r in sorted(sums):
        starts.append((r["shard"], before))
        before += r["n"]
    by_shard = spark.createDataFrame(starts, "shard int, before long")
    placed = files.join(F.broadcast(by_shard), "shard").select((F.col("before") + F.col("shard_start")).alias("start"), "payload")
    return placed.mapInArrow(_read, DOC_SCHEMA)


def op4_token_files(spark, sf_dir: str) -> DataFrame:
    path = shared_dir(spark)
    write_tokens(table(spark, sf_dir, "documents"), path)
    return read_tokens(spark, path)
