"""Maximum inner product search by score-aware anisotropic quantisation.

Vectors are scaled to length one, so the inner product is the cosine. A codebook of 16 centres for
every two dimensions is trained on a bounded sample under a loss that weighs the residual along the
vector more than the residual across it; codes minimise the same loss by coordinate descent. A query
turns into tables of 16 scores a subspace; scanning all codes by table lookup gives each vector's code
score, and with the code's own error a bound of its cosine. All vectors whose bound reaches what the
query has for certain are scored exactly on the original vectors, so none of the nearest is lost, however
many lie closer together than the codes can tell.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import materialize, shared_dir, table

#: Rows (and bytes) the codebook is trained on at most, those of the least hash; passes of training and coding.
TRAIN_ROWS, TRAIN_BYTES, TRAIN_PASSES, CODE_PASSES = 20_000, 32_000_000, 8, 2
#: Weight of the parallel residual comes from this share of the largest score.
THRESHOLD = 0.2
#: Best codes that are scored exactly to begin with, for what a query has for certain; bytes of a block of
#: queries; vectors scanned at a time; what sums of table entries may be off by.
RERANK, BLOCK_BYTES, CHUNK, ROUNDING = 200, 16_000_000, 8192, 1e-5
WIDTH, CENTRES = 2, 16


def parallel_weight(dim: int, threshold: float = THRESHOLD) -> float:
    return max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))


def unit(x: np.ndarray) -> np.ndarray:
    x = x.astype(np.float64)
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(axis=1, keepdims=True))


class Quantiser:
    """centres[s, c]: centre c of subspace s. weight: of the parallel residual, one across."""

    def __init__(self, centres: np.ndarray, weight: float) -> None:
        self.centres, self.weight = centres, weight

    def split(self, x: np.ndarray) -> np.ndarray:
        dims = self.centres.shape[0] * WIDTH
        return np.pad(x, ((0, 0), (0, dims - x.shape[1]))).reshape(len(x), -1, WIDTH)

    def encode(self, x: np.ndarray, passes: int = CODE_PASSES, codes: np.ndarray | None = None) -> np.ndarray:
        """Codes (n, subspaces): nearest centres, then each code in turn against the loss of all."""
        parts, c = self.split(x), self.centres
        if codes is None:
            codes = np.stack([((parts[:, s, None] - c[s]) ** 2).sum(2).argmin(1) for s in range(len(c))], 1)
        along = sum((parts[:, s] * (parts[:, s] - c[s][codes[:, s]])).sum(1) for s in range(len(c)))
        for _ in range(passes):
            for s in range(len(c)):
                own = parts[:, s]
                rest = along - (own * (own - c[s][codes[:, s]])).sum(1)
                each = (own**2).sum(1)[:, None] - own @ c[s].T
                loss = ((own[:, None] - c[s]) ** 2).sum(2) + (self.weight - 1) * (rest[:, None] + each) ** 2
                codes[:, s] = loss.argmin(1)
                along = rest + np.take_along_axis(each, codes[:, s, None], 1)[:, 0]
        return codes.astype(np.uint8)

    @classmethod
    def train(cls, x: np.ndarray, passes: int = TRAIN_PASSES, seed: int = 7) -> Quantiser:
        rng, dims = np.random.default_rng(seed), -(-x.shape[1] // WIDTH)
        q = cls(np.zeros((dims, CENTRES, WIDTH)), parallel_weight(x.shape[1]))
        parts = q.split(x)
        for s in range(dims):  # plain k-means first
            q.centres[s] = parts[rng.integers(0, len(x), CENTRES), s]
            for _ in range(6):
                near = ((parts[:, s, None] - q.centres[s]) ** 2).sum(2).argmin(1)
                for k in range(CENTRES):
                    own = parts[near == k, s]
                    q.centres[s, k] = own.mean(0) if len(own) else parts[rng.integers(0, len(x)), s]
        codes = None
        for _ in range(passes):
            codes = q.encode(x, 1, codes).astype(np.int64)
            along = sum((parts[:, s] * (parts[:, s] - q.centres[s][codes[:, s]])).sum(1) for s in range(dims))
            for s in range(dims):
                own = parts[:, s]
                rest = along - (own * (own - q.centres[s][codes[:, s]])).sum(1)
                for k in range(CENTRES):  # the centre of least loss for its members
                    m = codes[:, s] == k
                    if m.any():
                        y, more = own[m], q.weight - 1
                        left = m.sum() * np.eye(WIDTH) + more * y.T @ y
                        q.centres[s, k] = np.linalg.solve(left, y.sum(0) + more * ((rest[m] + (y * y).sum(1)) @ y))
                along = rest + (own * (own - q.centres[s][codes[:, s]])).sum(1)
        return q

    def tables(self, query: np.ndarray) -> np.ndarray:
        """Scores (subspace pairs, 256) of both codes in a byte."""
        lut = np.einsum("sw,skw->sk", self.split(query[None])[0], self.centres)
        if len(lut) % 2:
            lut = np.vstack((lut, np.zeros((1, CENTRES))))
        return (lut[0::2, None, :] + lut[1::2, :, None]).reshape(len(lut) // 2, -1).astype(np.float32)


def nibbles(codes: np.ndarray) -> np.ndarray:
    """Two four-bit codes a byte, transposed: (bytes, n)."""
    if codes.shape[1] % 2:
        codes = np.pad(codes, ((0, 0), (0, 1)))
    return np.ascontiguousarray((codes[:, 0::2] | codes[:, 1::2] << 4).T)


def best(score: np.ndarray, ids: np.ndarray, k: int) -> np.ndarray:
    """Places of the k largest scores, ties to smaller ids."""
    if len(score) > k:
        at = np.flatnonzero(score >= np.partition(score, len(score) - k)[len(score) - k])
    else:
        at = np.arange(len(score))
    return at[np.lexsort((ids[at], -score[at]))[:k]]


def _matrix(column) -> np.ndarray:
    return np.array(column.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(column), -1)


def cosines(raw: np.ndarray, query: np.ndarray) -> np.ndarray:
    """Of rows and one vector; a row's result doesn't depend on the others."""
    with np.errstate(all="ignore"):
        score = (raw * query).sum(1) / (np.sqrt((raw * raw).sum(1)) * np.sqrt((query * query).sum()))
    odd = ~np.isfinite(score) | (np.abs(score) > 1.0001)  # squares out of range
    if odd.any():
        score[odd] = (unit(raw[odd]) * unit(query[None])).sum(1)
    return score


class Coded:
    """Vectors with their codes (bytes, n), and each decoded vector's parts along and across its vector."""

    def __init__(self, raw: np.ndarray, codes: np.ndarray, along: np.ndarray, across: np.ndarray) -> None:
        self.raw, self.codes, self.along, self.across = raw, codes, along, across

    @classmethod
    def of(cls, q: Quantiser, raw: np.ndarray) -> Coded:
        x = unit(raw)
        codes, parts = q.encode(x), q.split(x)
        decoded = np.stack([c[codes[:, s]] for s, c in enumerate(q.centres)], 1)
        along = (decoded * parts).sum((1, 2))
        across = np.sqrt(((decoded - along[:, None, None] * parts) ** 2).sum((1, 2)))
        return cls(raw, nibbles(codes), along, across)

    def nearest(self, q: Quantiser, query: np.ndarray, ids: np.ndarray, k: int, rerank: int, least: float = -1.0) -> tuple[np.ndarray, np.ndarray]:
        """Places and cosines of the k nearest, but those below least.

        A vector at cosine c has a code score of at least c * along - sqrt(1 - c * c) * across, which
        grows with c from zero on: a lower score shows that the cosine is below c.
        """
        score = scores(q.tables(unit(query[None])[0]), self.codes)
        over = self.within(score, least)
        if len(over) > 2 * max(k, rerank):  # the best codes first, for a higher threshold
            exact = cosines(self.raw[best(score, ids, max(k, rerank))], query)
            least = max(least, np.partition(exact, len(exact) - k)[len(exact) - k])
            over = self.within(score, least)
        exact = cosines(self.raw[over], query)
        at = np.flatnonzero(exact >= least)
        at = at[best(exact[at], ids[over[at]], k)]
        return over[at], exact[at]

    def within(self, score: np.ndarray, least: float) -> np.ndarray:
        """Places of the vectors whose cosine may reach least."""
        if least <= ROUNDING:
            return np.arange(len(score))
        c = least - ROUNDING
        return np.flatnonzero((score >= c * self.along - np.sqrt(max(0.0, 1 - c * c)) * self.across - ROUNDING) | (self.along <= 0))


def _codes(shared):
    def run(batches):
        q = shared.value[0]
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                c = Coded.of(q, _matrix(part.column(2)))
                cols = [*part.columns, pa.array([x.tobytes() for x in c.codes.T], pa.binary()), pa.array(c.along), pa.array(c.across)]
                yield pa.RecordBatch.from_arrays(cols, names=["g", "vec_id", "vec", "code", "along", "across"])

    return run


def scores(lut: np.ndarray, codes: np.ndarray) -> np.ndarray:
    """Sums of a query's table entries over codes (bytes, n)."""
    out = np.zeros(codes.shape[1], np.float32)
    for row, code in zip(lut, codes, strict=True):
        out += row[code]
    return out


def _scan(shared, asked, keep: int, rerank: int):
    """Each query's keep nearest of a task's vectors; what it has by then is the threshold for the next chunk."""

    def run(batches):
        q, (queries, vecs, known) = shared.value[0], asked.value
        least = known.copy()
        groups, ids = np.zeros((2, len(queries), keep), np.int64)
        top, n = np.full((len(queries), keep), -np.inf), np.zeros(len(queries), np.int64)
        for batch in batches:
            for a in range(0, batch.num_rows, CHUNK):
                part = batch.slice(a, CHUNK)
                g, vec_id, along, across = (part.column(c).to_numpy() for c in (0, 1, 4, 5))
                codes = np.frombuffer(b"".join(part.column(3).to_pylist()), np.uint8).reshape(len(g), -1)
                own = Coded(_matrix(part.column(2)), np.ascontiguousarray(codes.T), along, across)
                for k, vec in enumerate(vecs):
                    at, score = own.nearest(q, vec, vec_id, keep, rerank, least[k])
                    if len(at):
                        all_of = [np.concatenate((x[k, : n[k]], y)) for x, y in ((top, score), (ids, vec_id[at]), (groups, g[at]))]
                        order = best(all_of[0], all_of[1], keep)
                        n[k] = len(order)
                        for x, y in zip((top, ids, groups), all_of, strict=True):
                            x[k, : n[k]] = y[order]
                        if n[k] == keep:
                            least[k] = max(least[k], top[k, -1])
        have = np.arange(keep) < n[:, None]
        cols = np.repeat(queries, n), groups[have], ids[have], top[have]
        for a in range(0, len(cols[0]), 100_000):
            yield pa.RecordBatch.from_arrays([pa.array(x[a : a + 100_000]) for x in cols], names=["query", "g", "vec_id", "score"])

    return run


def _blocks(shared, keep: int, rerank: int):
    """Blocks of queries: groups, vectors, and the cosine of each one's keep-th nearest in the sample."""

    def run(batches):
        q, sample = shared.value
        ids = np.arange(len(sample.raw))
        size = max(1, BLOCK_BYTES // (8 * sample.raw.shape[1]))
        for batch in batches:
            for a in range(0, batch.num_rows, size):
                part = batch.slice(a, size)
                vecs = _matrix(part.column(1))
                least = np.full(len(vecs), -1.0)
                for k, v in enumerate(vecs):
                    first = best(scores(q.tables(unit(v[None])[0]), sample.codes), ids, max(keep, rerank))
                    if len(first) >= keep:
                        least[k] = np.sort(cosines(sample.raw[first], v))[-keep]
                raw = (part.column(0).to_numpy().astype("<i8"), vecs.astype("<f8"), least.astype("<f8"))
                yield pa.RecordBatch.from_arrays([pa.array([x.tobytes()], pa.binary()) for x in raw], names=["queries", "vecs", "least"])

    return run


def usable(vectors: DataFrame, id_col: str, vec_col: str) -> DataFrame:
    """vec_id, vec and row, a key of its own, of the rows that take part: no null id, a non-zero vector of
    finite numbers."""
    v = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vec_col).cast("array<double>").alias("vec")).where("vec_id is not null and vec is not null")
    finite = F.forall("vec", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    return v.where(finite & F.exists("vec", lambda x: x != 0)).withColumn("row", F.monotonically_increasing_id())


RESULT_SCHEMA = "query_id long, rank int, vec_id long, score double"


def search(vectors: DataFrame, is_query, k: int = 5, id_col: str = "vec_id", vec_col: str = "embedding", rerank: int = RERANK) -> DataFrame:
    """query_id, rank, vec_id, score: the k nearest of each query row among all rows but itself.

    is_query: a condition on the column vec_id. Rows count as they stand: of a repeated vec_id each row is
    a query and a candidate of its own. Equal vectors are coded and scanned once; of their rows the k + 1
    of the smallest ids can be among the nearest, so a group of copies costs no more than they do. A
    block of queries at a time goes to all codes, where they lie; a task's best so far and those of the
    bounded sample give the threshold from which on vectors are scored exactly. Ties go to the smaller
    vec_id. Vectors of different lengths have no cosine: each length is searched by itself. Rows that take
    no part are told in ``usable``. An empty table gives no row.
    """
    v = materialize(usable(vectors, id_col, vec_col))
    lengths = [r["n"] for r in v.where(is_query).select(F.size("vec").alias("n")).distinct().orderBy("n").collect()]
    out = v.sparkSession.createDataFrame([], RESULT_SCHEMA)
    for n in lengths:
        out = out.union(_of_length(v.where(F.size("vec") == n), n, is_query, k, rerank))
    return out


def _of_length(v: DataFrame, dim: int, is_query, k: int, rerank: int) -> DataFrame:
    spark = v.sparkSession
    few = F.row_number().over(Window.partitionBy("vec").orderBy("vec_id", "row"))
    named = F.struct("vec_id", "row")
    copies = v.withColumn("r", few).where(F.col("r") <= k + 1).groupBy("vec").agg(F.min(named).alias("least"), F.collect_list(named).alias("rows"))
    n_parts = int(spark.conf.get("spark.sql.shuffle.partitions"))  # the scan is all work and no data: one file a task
    distinct = materialize(copies.select(F.col("least.row").alias("g"), F.col("least.vec_id").alias("vec_id"), "vec", "rows").repartition(n_parts, "g"))
    sample = distinct.orderBy(F.xxhash64("vec_id"), "vec_id", "g").limit(max(k + 1, min(TRAIN_ROWS, TRAIN_BYTES // (8 * dim)))).select("vec").toArrow().column("vec")
    x = _matrix(sample.combine_chunks())
    quantiser = Quantiser.train(unit(x))
    q = spark.sparkContext.broadcast((quantiser, Coded.of(quantiser, x)))
    asked = materialize(v.where(is_query).select("vec", F.col("vec_id").alias("query_id"), F.col("row").alias("query_row")).join(distinct.select("vec", "g"), "vec").select("query_id", "query_row", F.col("g").alias("query")))
    queries = distinct.join(asked.select(F.col("query").alias("g")).distinct(), "g", "left_semi").select("g", "vec")
    codes = materialize(distinct.select("g", "vec_id", "vec").mapInArrow(_codes(q), "g long, vec_id long, vec array<double>, code binary, along double, across double"))
    blocks = materialize(queries.coalesce(max(1, 8 * dim * asked.count() // BLOCK_BYTES)).mapInArrow(_blocks(q, k + 1, rerank), "queries binary, vecs binary, least binary"))
    # Each block of queries meets all codes: the stated query set against all rows. More groups than k + 1
    # can't hold a nearest row: each of those before has one of a smaller id.
    order, found = Window.partitionBy("query").orderBy(F.desc("score"), "vec_id", "g"), []
    for r in blocks.toLocalIterator():
        block = spark.sparkContext.broadcast((np.frombuffer(r["queries"], "<i8"), np.frombuffer(r["vecs"], "<f8").reshape(-1, dim), np.frombuffer(r["least"], "<f8")))
        scored = codes.mapInArrow(_scan(q, block, k + 1, rerank), "query long, g long, vec_id long, score double")
        found.append(shared_dir(spark))
        scored.withColumn("r", F.row_number().over(order)).where(F.col("r") <= k + 1).select("query", "g", "score").write.parquet(found[-1])
        block.unpersist()
    top = spark.read.schema("query long, g long, score double").parquet(*found)
    near = top.join(distinct.select("g", "rows"), "g").select("query", "score", F.explode("rows").alias("x"))
    each = asked.join(near, "query").where(F.col("x.row") != F.col("query_row")).select("query_id", "query_row", "score", "x.vec_id", "x.row")
    order = Window.partitionBy("query_row").orderBy(F.desc("score"), "vec_id", "row")
    return each.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op10_anisotropic_search(spark, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 50 == 0)
