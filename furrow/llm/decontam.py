"""Benchmark decontamination over a distributed positional inverted index.

``build_index`` stores the postings of every training word: a row per shard of documents and term,
longer lists in several rows, so no row is large. ``search`` takes the benchmark in blocks of bounded
size. The terms' document frequencies in the whole corpus come first: windows with a term that stands
nowhere go, and of the index only the remaining terms' rows are read on. Within a shard the lists of
each window are intersected by offset, from the corpus's rarest term on.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import PART_BYTES, large, materialize, parts, table
from .positional import Shard, byte_words, shards

WINDOW = 10
#: Benchmark words whose terms are broadcast at a time (some 100 bytes each); a larger benchmark takes more passes.
BLOCK_WORDS = 250_000
#: Postings, documents in a row of the index at most.
ROW_POSTINGS, ROW_DOCS = 65_536, 16_384

INDEX_SCHEMA = "shard long, term binary, chunk int, docs long, postings binary, doc_ids array<long>, hashes array<long>"
INDEX_COLS = [x.split(" ")[0] for x in INDEX_SCHEMA.split(", ")]
FOUND_SCHEMA = "shard long, ord int, doc_id long, hash long, n_words long, spans array<int>, items array<string>"
FOUND_TYPES = (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.string()))
FOUND_COLS = [x.split(" ")[0] for x in FOUND_SCHEMA.split(", ")]
PLACE_SCHEMA = "doc_id long, item_id string, start long, size int"
#: In the term's place in the rows of a shard's documents; no word is empty.
DOCUMENTS = b""


def _rows(shard: int, ids: list[int | None], hashes: list[int], s: Shard):
    """The shard's rows: its documents with the ends of their words, then the postings by term."""
    for k, a in enumerate(range(0, len(ids), ROW_DOCS)):
        b = a + ROW_DOCS
        row = (shard, DOCUMENTS, k, 0, s.ends[a:b].astype("<i4").tobytes(), ids[a:b], hashes[a:b])
        types = (pa.int64(), pa.binary(), pa.int32(), pa.int64(), pa.binary(), pa.list_(pa.int64()), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array([x], t) for x, t in zip(row, types, strict=True)], names=INDEX_COLS)
    if not s.terms:
        return
    s = s.by_term()
    n = -(-s.counts // ROW_POSTINGS)
    at = np.repeat(np.arange(len(n)), n)
    chunk = np.arange(len(at)) - np.repeat(np.cumsum(n) - n, n)
    begin = s.first[at] + chunk * ROW_POSTINGS
    edges = np.append(begin, s.first[-1]).astype("<i4") * np.int32(4) if s.first[-1] < 1 << 29 else None
    flat = s.postings.astype("<i4")
    if edges is None:  # a text of gigabytes
        lists = pa.array([flat[a:b].tobytes() for a, b in zip(begin, np.append(begin[1:], s.first[-1]), strict=True)], pa.binary())
    else:
        lists = pa.Array.from_buffers(pa.binary(), len(at), [None, pa.py_buffer(edges), pa.py_buffer(flat)])
    none = pa.nulls(len(at), pa.list_(pa.int64()))
    cols = [pa.array(np.full(len(at), shard)), pa.array([s.terms[k] for k in at.tolist()], pa.binary()), pa.array(chunk.astype(np.int32)), pa.array(s.documents()[at] * (chunk == 0)), lists, none, none]
    yield pa.RecordBatch.from_arrays(cols, names=INDEX_COLS)


def _index(batches):
    large()
    part, k = TaskContext.get().partitionId(), 0
    for batch in parts(batches, 2, 2 * PART_BYTES):
        ids, hashes, texts = (batch.column(c).to_pylist() for c in range(3))
        for a, b, s in shards(texts):
            yield from _rows((part << 32) + k, ids[a:b], hashes[a:b], s)
            k += 1


def build_index(docs: DataFrame) -> DataFrame:
    """Store the positional index of docs in the shared folder. A null text has no words, but its row stays."""
    text = F.col("text").cast("string")
    keyed = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.xxhash64(text).alias("hash"), text.alias("text"))
    return materialize(keyed.mapInArrow(_index, INDEX_SCHEMA))


def named(items: set[str | None]) -> list[str | None]:
    """In order, a null last."""
    return sorted(items, key=lambda x: (x is None, x))


class Windows:
    """The distinct windows of a block of items by their length: term numbers, and the items of each."""

    def __init__(self, items: list[tuple[str | None, list[bytes]]], size: int) -> None:
        self.vocabulary: dict[bytes, int] = {}
        self.frequency = None
        found: dict[int, dict[tuple[int, ...], set[str | None]]] = {}
        for item, words in items:
            ids = [self.vocabulary.setdefault(w, len(self.vocabulary)) for w in words]
            n = min(size, len(ids))
            for a in range(len(ids) - n + 1) if n else ():
                found.setdefault(n, {}).setdefault(tuple(ids[a : a + n]), set()).add(item)
        self.by_size = [(n, np.array(list(w), np.int64), [named(x) for x in w.values()]) for n, w in found.items()]

    def present(self, frequency: np.ndarray) -> Windows:
        """Only the windows whose terms all stand somewhere, with the terms' frequencies in the corpus."""
        out = Windows([], 0)
        kept = [(n, w, names, np.flatnonzero((frequency[w] > 0).all(axis=1))) for n, w, names in self.by_size]
        used = np.unique(np.concatenate([w[at].ravel() for _, w, _, at in kept])) if kept else np.zeros(0, np.int64)
        terms = list(self.vocabulary)
        out.vocabulary = {terms[k]: j for j, k in enumerate(used.tolist())}
        out.frequency = frequency[used]
        out.by_size = [(n, np.searchsorted(used, w[at]), [names[k] for k in at.tolist()]) for n, w, names, at in kept if len(at)]
        return out


def blocks(benchmark: DataFrame, size: int, limit: int):
    """Windows of whole items, about limit words each. Texts without words have none; a null id is an item too."""
    own: list[tuple[str | None, list[bytes]]] = []
    n = 0
    for r in benchmark.select(F.col("item_id").cast("string"), F.col("text").cast("string").alias("text")).where("text is not null").toLocalIterator():
        words = byte_words(r[1])
        if words:
            own.append((r[0], words))
            n += len(words)
        if n >= limit:
            yield Windows(own, size)
            own, n = [], 0
    if own:
        yield Windows(own, size)


def _among(index: DataFrame, terms: list[bytes], cols: list[str]) -> DataFrame:
    """cols and t, a term's number, of the index rows of terms, which blocks bound."""
    known = index.sparkSession.createDataFrame(pa.table({"term": pa.array(terms, pa.binary()), "t": pa.array(range(-1, len(terms) - 1), pa.int32())}))
    return index.select("term", *cols).join(F.broadcast(known), "term").select("t", *cols)


def frequencies(index: DataFrame, vocabulary: dict[bytes, int]) -> np.ndarray:
    """In how many documents of the whole corpus each term stands; the driver gets a row per term."""
    got = _among(index, [DOCUMENTS, *vocabulary], ["docs"]).groupBy("t").agg(F.sum("docs").alias("n")).where("t >= 0").toArrow()
    out = np.zeros(len(vocabulary), np.int64)
    out[got.column("t").to_numpy()] = got.column("n").to_numpy()
    return out


def _lists(index: DataFrame, w: Windows) -> DataFrame:
    """The rows that a search of w needs, to be grouped by shard."""
    return _among(index, [DOCUMENTS, *w.vocabulary], [c for c in INDEX_COLS if c not in ("term", "docs")])


def _shard(t: pa.Table, n_terms: int) -> tuple[list[int | None], list[int], Shard]:
    """doc_ids, hashes of texts and the positional lists of one shard's rows."""
    number, chunk = t.column("t").to_numpy(), t.column("chunk").to_numpy()
    order, raw = np.lexsort((chunk, number)), t.column("postings").combine_chunks()
    own = [np.frombuffer(raw[k].as_buffer(), "<i4") for k in order.tolist()]
    n_docs = int((number < 0).sum())
    ids, hashes = ([x for k in order[:n_docs].tolist() for x in t.column(c)[k].as_py()] for c in ("doc_ids", "hashes"))
    counts = np.bincount(number[order[n_docs:]], [len(x) for x in own[n_docs:]], n_terms).astype(np.int64)
    postings = np.concatenate(own[n_docs:]) if len(own) > n_docs else np.zeros(0, np.int32)
    return ids, hashes, Shard([], np.concatenate(([0], np.cumsum(counts))), postings, np.concatenate(own[:n_docs]).astype(np.int64))


def _search(windows, all_docs: bool):
    def run(key: tuple[pa.Scalar, ...], t: pa.Table) -> pa.Table:
        large()
        by = windows.value
        ids, hashes, here = _shard(t, len(by.vocabulary))
        n, n_docs = int(here.ends[-1]), len(ids)
        edge, items = np.zeros(n + 1, np.int32), [set() for _ in range(n_docs)]
        for size, phrases, names in by.by_size:
            at, which = here.find(phrases, frequency=by.frequency)
            np.add.at(edge, at, 1)
            np.add.at(edge, at + size, -1)
            for d, w in set(zip(here.doc(at).tolist(), which.tolist(), strict=True)):
                items[d].update(names[w])
        hit = np.concatenate(([0], np.cumsum(edge)[:-1] > 0, [0])).astype(np.int8)
        change = np.flatnonzero(np.diff(hit))
        begin = np.concatenate(([0], here.ends[:-1]))
        cut = np.unique(np.concatenate((change, begin[begin > 0])))  # spans end with their document
        spans = [[] for _ in range(n_docs)]
        for a, b in zip(cut, np.append(cut[1:], n), strict=True) if len(change) else ():
            if hit[a + 1]:
                d = int(here.doc(a))
                spans[d] += [int(a - begin[d]), int(b - begin[d])]
        keep = [d for d in range(n_docs) if all_docs or spans[d]]
        shard = key[0].as_py()
        cols = [[shard] * len(keep), keep, [ids[d] for d in keep], [hashes[d] for d in keep], [int(here.ends[d] - begin[d]) for d in keep], [spans[d] for d in keep], [named(items[d]) for d in keep]]
        return pa.Table.from_arrays([pa.array(c, x) for c, x in zip(cols, FOUND_TYPES, strict=True)], names=FOUND_COLS)

    return run


def _merge(batches):
    """Spans of several passes as one ascending list."""
    for batch in batches:
        at = batch.schema.get_field_index("spans")
        out = []
        for flat in batch.column(at).to_pylist():
            own: list[int] = []
            for a, b in sorted(zip(flat[::2], flat[1::2], strict=True)):
                if own and a <= own[-1]:
                    own[-1] = max(own[-1], b)
                else:
                    own += [a, b]
            out.append(own)
        yield batch.set_column(at, "spans", pa.array(out, pa.list_(pa.int32())))


def search(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS, all_docs: bool = True) -> DataFrame:
    """shard, ord, doc_id, hash, n_words, spans (begin and end of each run of hit words), items: a row per
    document, or per document that is hit."""
    spark, passes = index.sparkSession, []

    def one(w: Windows) -> DataFrame:
        shared, every = spark.sparkContext.broadcast(w), all_docs and not passes
        return _lists(index, w).groupBy("shard").applyInArrow(_search(shared, every), FOUND_SCHEMA)

    for w in blocks(benchmark, window, block_words) if window > 0 else ():
        w = w.present(frequencies(index, w.vocabulary))
        if w.by_size:
            passes.append(one(w))
    if not passes:
        passes.append(one(Windows([], window)))
    if len(passes) == 1:
        return passes[0]
    out = passes[0]
    for p in passes[1:]:
        out = out.union(p)
    first = [F.first(c).alias(c) for c in ("doc_id", "hash", "n_words")]
    both = out.groupBy("shard", "ord").agg(*first, F.flatten(F.collect_list("spans")).alias("spans"), F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"))
    return both.mapInArrow(_merge, FOUND_SCHEMA)


def _places(windows, slop: int):
    def run(t: pa.Table) -> pa.Table:
        large()
        by = windows.value
        ids, _, here = _shard(t, len(by.vocabulary))
        begin = np.concatenate(([0], here.ends[:-1]))
        out = set()
        for size, phrases, names in by.by_size:
            at, which = here.find(phrases, slop, by.frequency)
            for a, d, w in zip(at.tolist(), here.doc(at).tolist(), which.tolist(), strict=True):
                out.update((d, item, a - int(begin[d]), size) for item in names[w])
        own = sorted(out, key=lambda x: (x[0], x[1] is None, *x[1:]))
        cols = [[ids[x[0]] for x in own], [x[1] for x in own], [x[2] for x in own], [x[3] for x in own]]
        return pa.Table.from_arrays([pa.array(c, k) for c, k in zip(cols, (pa.int64(), pa.string(), pa.int64(), pa.int32()), strict=True)], names=["doc_id", "item_id", "start", "size"])

    return run


def matches(index: DataFrame, benchmark: DataFrame, window: int = WINDOW, slop: int = 0, block_words: int = BLOCK_WORDS) -> DataFrame:
    """doc_id, item_id, start, size of each window's places: exact phrases, or with slop > 0 those
    whose every word stands within slop words of its place beside the corpus's rarest."""
    spark, out = index.sparkSession, None
    for w in blocks(benchmark, window, block_words):
        w = w.present(frequencies(index, w.vocabulary))
        own = _lists(index, w).groupBy("shard").applyInArrow(_places(spark.sparkContext.broadcast(w), slop), PLACE_SCHEMA)
        out = own if out is None else out.union(own)
    return spark.createDataFrame([], PLACE_SCHEMA) if out is None else out


def contamination(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW) -> DataFrame:
    """doc_id, n_words, n_hit, n_items, items_sha256, contaminated for every row of docs.

    A null or empty text has no words and is clean; so is all without a benchmark item. Repeated rows
    each give a row; null doc_ids stay null. Items of a null id count as one, without a name.
    """
    found = search(build_index(docs), benchmark, window)
    n_hit = F.aggregate("spans", F.struct(F.lit(0).cast("long").alias("n"), F.lit(-1).cast("long").alias("s")), lambda acc, x: F.struct((acc["n"] + x.cast("long") * acc["s"]).alias("n"), (-acc["s"]).alias("s")))["n"]
    items = F.array_join(F.array_sort("items"), ",")
    return found.select("doc_id", "n_words", n_hit.alias("n_hit"), F.size("items").cast("long").alias("n_items"), F.sha2(items, 256).alias("items_sha256"), (n_hit > 0).alias("contaminated"))


def clean(docs: DataFrame, benchmark: DataFrame, window: int = WINDOW, block_words: int = BLOCK_WORDS) -> DataFrame:
    """The rows of docs, all columns, in whose ``text`` no window stands; those without words stay.

    What the search of the stored index hits is written as keys (doc_id and the text's hash) and taken
    away; a text only moves if Catalyst finds these keys too many to broadcast by their size.
    """
    found = search(build_index(docs), benchmark, window, block_words, all_docs=False)
    hit = materialize(found.select(F.col("doc_id").alias("hit_id"), F.col("hash").alias("hit_hash")).distinct())
    own = (docs["doc_id"].cast("long"), F.xxhash64(docs["text"].cast("string")))
    return docs.join(hit, own[0].eqNullSafe(hit["hit_id"]) & (own[1] == hit["hit_hash"]), "left_anti")


def op5_decontamination(spark, sf_dir: str) -> DataFrame:
    return contamination(table(spark, sf_dir, "documents"), table(spark, sf_dir, "benchmark"))


OP5_SQL = r"""
WITH dw AS (
  SELECT row_number() OVER () AS r, doc_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM documents),
iw AS (
  SELECT CAST(item_id AS VARCHAR) AS item_id,
         regexp_extract_all(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x2F\x3A-\x60\x7B-\x7F]+') AS w
  FROM benchmark),
win AS (
  SELECT DISTINCT item_id, least(10, len(w)) AS size, array_to_string(w[k:k + least(10, len(w)) - 1], ' ') AS g
  FROM iw, LATERAL (SELECT unnest(range(1, len(w) - least(10, len(w)) + 2)) AS k) WHERE len(w) > 0),
sizes AS (SELECT DISTINCT size FROM win),
grams AS (
  SELECT r, size, k, array_to_string(w[k:k + size - 1], ' ') AS g
  FROM dw, sizes, LATERAL (SELECT unnest(range(1, len(w) - size + 2)) AS k)),
found AS (SELECT r, item_id, k, win.size AS size FROM grams JOIN win ON grams.g = win.g AND grams.size = win.size),
hit AS (
  SELECT r, count(DISTINCT p) AS n_hit FROM (SELECT r, unnest(range(k, k + size)) AS p FROM found) GROUP BY r),
items AS (
  SELECT r, count(*) AS n_items, string_agg(item_id, ',' ORDER BY item_id) AS names FROM (SELECT DISTINCT r, item_id FROM found) GROUP BY r)
SELECT doc_id, CAST(len(w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
       sha256(coalesce(names, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AS contaminated
FROM dw LEFT JOIN hit USING (r) LEFT JOIN items USING (r)
"""
