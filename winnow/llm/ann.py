"""Nearest neighbours by inner product: an inverted file of coarse centroids with product-quantised residuals.

Every vector is stored in the list of its nearest centroid, its residual as one byte a subspace. A query probes its
best lists: as many as were found to hold enough of the neighbours, and more until they hold ``k`` other vectors. In a
block of a list, asymmetric distance tables give an estimate for each code, and the best estimates are ranked again by
the exact inner product of the original vectors in double precision.

Lists are cut into blocks of at most about ``BLOCK`` vectors and each list's queries into blocks too, so that a list
that holds a third of all vectors is many small pairs of blocks. Equal vectors get equal estimates; ties go to the
smaller id at every step.
"""

from __future__ import annotations

import warnings
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from winnow.llm.shared import drawn_by_hash, map_batches

#: The bounded sample that centroids and codebooks are fitted to, and the most centroids there are.
SAMPLE, MAX_LISTS = 16384, 4096
SUBSPACES, CODES = 16, 256
BLOCK, QUERY_BLOCK = 4096, 1024
#: The share of true neighbours, of so many sampled queries among the sample, that must lie in the lists probed.
COVERED, TRIED = 0.985, 512
#: Standard errors of an estimate by which a candidate may fall short of the block's ``k`` best and be ranked exactly.
MARGIN = 2.5


@dataclass
class Index:
    centroids: np.ndarray
    codebooks: np.ndarray  # subspace, code, dimension of the subspace
    probes: int = 1
    #: Standard error of an estimate for a query of length 1, measured on the sample.
    error: float = 0.0

    def assign(self, x: np.ndarray) -> np.ndarray:
        """The nearest centroid of each vector."""
        return nearest(x, self.centroids)

    def split(self, x: np.ndarray) -> np.ndarray:
        """Vectors by subspace; dimensions that don't divide evenly are filled up with zeros."""
        s, _, d = self.codebooks.shape
        full = np.zeros((len(x), s * d), x.dtype)
        full[:, : x.shape[1]] = x
        return full.reshape(len(x), s, d)

    def encode(self, x: np.ndarray, lists: np.ndarray) -> np.ndarray:
        residual = self.split(x - self.centroids[lists])
        return np.stack([nearest(residual[:, s], self.codebooks[s]) for s in range(len(self.codebooks))], axis=1).astype(np.uint8)

    def route(self, q: np.ndarray, held: np.ndarray, least: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The lists that each query probes, as (row of ``q``, list): those whose centroids have the largest inner products.

        Each query takes ``probes`` lists, and further ones until they hold its ``least`` vectors; ``held`` is the
        number of vectors in each list.
        """
        order = np.argsort(-(q @ self.centroids.T), axis=1, kind="stable")
        enough = 1 + (np.cumsum(held[order], axis=1) < least[:, None]).sum(axis=1)
        taken = np.arange(order.shape[1])[None, :] < np.maximum(enough, self.probes)[:, None]
        return np.nonzero(taken)[0], order[taken].astype(np.int32)

    def tables(self, q: np.ndarray) -> np.ndarray:
        """For each query the inner product with each code of each subspace."""
        return np.einsum("qsd,scd->qsc", self.split(q), self.codebooks)


def nearest(x: np.ndarray, centers: np.ndarray) -> np.ndarray:
    out, half = np.empty(len(x), np.int32), 0.5 * (centers**2).sum(axis=1)
    for low in range(0, len(x), 8192):
        out[low : low + 8192] = (x[low : low + 8192] @ centers.T - half).argmax(axis=1)
    return out


def k_means(x: np.ndarray, k: int, rounds: int, rng: np.random.Generator) -> np.ndarray:
    """Centers of at most ``k`` clusters; one that loses all its points takes a random point."""
    distinct = np.unique(x, axis=0)
    if len(distinct) <= k:
        return distinct
    centers = distinct[rng.permutation(len(distinct))[:k]].copy()
    for _ in range(rounds):
        own = nearest(x, centers)
        n = np.bincount(own, minlength=k)
        order = np.argsort(own, kind="stable")
        full = np.flatnonzero(n)
        centers[full] = np.add.reduceat(x[order], (np.cumsum(n) - n)[full], axis=0) / n[full, None]
        centers[n == 0] = x[rng.integers(0, len(x), int((n == 0).sum()))]
    return centers


def valid(vector: Column) -> Column:
    """Vectors that take part: no null or non-finite component, and not all zero."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return vector.isNotNull() & F.coalesce(finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def probes_needed(index: Index, x: np.ndarray, k: int, rng: np.random.Generator) -> int:
    """How many lists to probe so that they hold COVERED of the ``k`` nearest of sampled queries among ``x``.

    All vectors lie denser than the sample, so their neighbours are nearer and in earlier lists than these.
    """
    lists, asked = index.assign(x), rng.permutation(len(x))[:TRIED]
    rank = np.empty((len(asked), len(index.centroids)), np.int64)
    np.put_along_axis(rank, np.argsort(-(x[asked] @ index.centroids.T), axis=1, kind="stable"), np.arange(rank.shape[1])[None, :], axis=1)
    score = x[asked] @ x.T
    score[np.arange(len(asked)), asked] = -np.inf
    k = min(k, len(x) - 1)
    if k < 1:
        return rank.shape[1]
    near = np.argpartition(-score, k - 1, axis=1)[:, :k]
    return 1 + int(np.quantile(np.take_along_axis(rank, lists[near], axis=1), COVERED))


def fit(vectors: DataFrame, n: int, k: int = 20, seed: int = 5) -> Index:
    """An index for ``n`` vectors, fitted to SAMPLE of them at most, the same ones each time."""
    rows = drawn_by_hash(vectors, "vec_id", SAMPLE, n).select("embedding").collect()
    x = np.array([r[0] for r in rows], np.float32).reshape(len(rows), -1)
    rng = np.random.default_rng(seed)
    centroids = k_means(x, int(min(MAX_LISTS, max(1, round(n**0.5)))), 10, rng)
    s = min(SUBSPACES, x.shape[1])
    empty = Index(centroids, np.zeros((s, 1, -(-x.shape[1] // s)), np.float32))
    residual = empty.split(x - centroids[nearest(x, centroids)])
    books = [k_means(np.ascontiguousarray(residual[:, i]), CODES, 8, rng) for i in range(s)]
    size = max(len(b) for b in books)
    index = Index(centroids, np.stack([np.concatenate([b, np.repeat(b[:1], size - len(b), axis=0)]) for b in books]).astype(np.float32))
    index.probes = probes_needed(index, x, k, rng)
    lists = index.assign(x)
    codes = index.encode(x, lists)
    left = (index.split(x - centroids[lists]) - np.stack([index.codebooks[i][codes[:, i]] for i in range(s)], axis=1)).reshape(len(x), -1)[:, : x.shape[1]]
    asked = x[rng.permutation(len(x))[:TRIED]]
    index.error = float((left @ (asked / np.linalg.norm(asked, axis=1, keepdims=True)).T).std())
    return index


def _matrix(column: pa.Array, kind=np.float64) -> np.ndarray:
    n = len(column)
    return np.asarray(column.flatten().to_numpy(zero_copy_only=False), kind).reshape(n, -1) if n else np.zeros((0, 0), kind)


def search(vectors: DataFrame, queries: Column, k: int = 20, index: Index | None = None) -> DataFrame:
    """(query_id, rank, vec_id, score): the ``k`` nearest found of each row for which ``queries`` holds, but itself.

    ``vectors`` has vec_id and embedding. Rows whose vec_id is null, or whose vector is null, zero or not finite take no
    part; nor do vectors of another length than most, which have no inner product with these: a warning tells how many.
    Repeated rows are candidates as often as they come, but a vec_id is never its own, and asks once: by the smallest of
    its vectors, if they differ. Ties go to the smaller vec_id. A query gets fewer than ``k`` only if there are fewer
    other vectors; no vectors give no rows.
    """
    spark = vectors.sparkSession
    # Floats stay floats on the way: they are doubles of half the size.
    kind = "array<float>" if vectors.schema["embedding"].dataType == T.ArrayType(T.FloatType(), vectors.schema["embedding"].dataType.containsNull) else "array<double>"
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast(kind).alias("embedding"), queries.alias("asks")).where(F.col("vec_id").isNotNull() & valid(F.col("embedding")))
    result = "query_id long, rank int, vec_id long, score double"
    usual = rows.groupBy(F.size("embedding").alias("length")).count().orderBy(F.desc("count"), "length").limit(1).collect()
    if not usual:
        return spark.createDataFrame([], result)
    n = usual[0]["count"]
    odd = rows.where(F.size("embedding") != usual[0]["length"]).count()
    if odd:
        warnings.warn(f"{odd} vectors haven't the length of most, {usual[0]['length']}, and take no part", stacklevel=2)
    rows = rows.where(F.size("embedding") == usual[0]["length"])
    shared = spark.sparkContext.broadcast(index or fit(rows, n, k))  # of bounded size: MAX_LISTS centroids

    def store(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            x = _matrix(batch.column(1), np.float32)
            own = shared.value.assign(x) if len(x) else np.zeros(0, np.int32)
            codes = shared.value.encode(x, own) if len(x) else []
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(own, pa.int32()), pa.array([c.tobytes() for c in codes], pa.binary()), batch.column(1)], names=["vec_id", "list", "codes", "embedding"])

    stored = map_batches(rows.select("vec_id", "embedding"), store, f"vec_id long, list int, codes binary, embedding {kind}")

    # One row a list: as many as there are centroids.
    sizes = {r["list"]: (r["n"], 0) for r in stored.groupBy("list").agg(F.count("*").alias("n")).collect()}
    held = np.array([sizes.get(i, (0, 0))[0] for i in range(len(shared.value.centroids))], np.int64)

    def route(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                at, lists = shared.value.route(_matrix(batch.column(1), np.float32), held, k + batch.column(2).to_numpy())
                yield pa.RecordBatch.from_arrays([batch.column(0).take(pa.array(at)), pa.array(lists, pa.int32()), batch.column(1).take(pa.array(at))], names=["query_id", "list", "query"])

    # A query's own rows, which aren't candidates, may be several.
    own = rows.groupBy("vec_id").agg(F.count("*").alias("own")).where(F.col("own") > 1)
    asks = rows.where(F.coalesce("asks", F.lit(False))).join(own, "vec_id", "left").groupBy("vec_id").agg(F.min("embedding").alias("embedding"), F.coalesce(F.max("own"), F.lit(1)).alias("own"))
    asked = map_batches(asks, route, f"query_id long, list int, query {kind}")
    for r in asked.groupBy("list").agg(F.count("*").alias("n")).collect():
        sizes[r["list"]] = (sizes.get(r["list"], (0, 0))[0], r["n"])
    cuts = spark.createDataFrame([(i, max(1, -(-a // BLOCK)), max(1, -(-b // QUERY_BLOCK))) for i, (a, b) in sizes.items()], "list int, n_blocks int, n_query_blocks int")
    block = lambda key, n: F.pmod(F.xxhash64(key), F.col(n)).cast("int")
    cut = F.broadcast(cuts)
    left = stored.join(cut, "list").select("list", block("vec_id", "n_blocks").alias("b"), F.explode(F.sequence(F.lit(0), F.col("n_query_blocks") - 1)).alias("qb"), "vec_id", "codes", "embedding")
    right = asked.join(cut, "list").select("list", F.explode(F.sequence(F.lit(0), F.col("n_blocks") - 1)).alias("b"), block("query_id", "n_query_blocks").alias("qb"), "query_id", "query")

    def compare(have: pa.Table, ask: pa.Table) -> pa.Table:
        if not have.num_rows or not ask.num_rows:
            return pa.table({"query_id": pa.array([], pa.int64()), "vec_id": pa.array([], pa.int64()), "score": pa.array([], pa.float64())})
        have = have.sort_by("vec_id")
        ids, x = have["vec_id"].to_numpy(), _matrix(have["embedding"].combine_chunks())
        codes = np.frombuffer(b"".join(have["codes"].to_pylist()), np.uint8).reshape(len(ids), -1)
        who, q = ask["query_id"].to_numpy(), _matrix(ask["query"].combine_chunks())
        out = ([], [], [])
        slack = MARGIN * shared.value.error * np.linalg.norm(q, axis=1)
        for low in range(0, len(who), 64):
            tables = shared.value.tables(q[low : low + 64].astype(np.float32))
            about = sum(tables[:, s, codes[:, s]] for s in range(codes.shape[1]))  # the list's own centroid adds a constant
            asking = who[low : low + 64]
            first, last = np.searchsorted(ids, asking, "left"), np.searchsorted(ids, asking, "right")
            for i in np.flatnonzero(first < last):  # a query's own rows don't count among the best
                about[i, first[i] : last[i]] = -np.inf
            keep = min(len(ids), k)
            bound = np.partition(about, len(ids) - keep, axis=1)[:, len(ids) - keep] - slack[low : low + 64]
            for i in range(len(about)):
                near = np.flatnonzero(about[i] >= bound[i])
                near = near[ids[near] != who[low + i]]
                exact = (x[near] * q[low + i]).sum(axis=1)
                best = np.lexsort((ids[near], -exact))[:k]
                out[0].append(np.full(len(best), who[low + i]))
                out[1].append(ids[near][best])
                out[2].append(exact[best])
        return pa.table({"query_id": np.concatenate(out[0]), "vec_id": np.concatenate(out[1]), "score": np.concatenate(out[2])})

    found = left.groupBy("list", "b", "qb").cogroup(right.groupBy("list", "b", "qb")).applyInArrow(compare, "query_id long, vec_id long, score double")
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
