"""Exact nearest vectors by cosine, with a cluster index whose bounds say which clusters a query can leave out."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from ..sources.scratch import Tables

#: Vectors and queries of a block (a row of Spark), vectors that a task holds while it deals them out, and block pairs sent at a time.
_VECTORS, _QUERIES, _HELD, _AT_ONCE = 1024, 256, 1 << 16, 16
#: Scores are rounded to so many digits; a bound is taken larger by what that and arithmetic may add.
_DIGITS, _SLACK = 6, 2e-6
_BLOCK = "cluster int, ids binary, m binary, radius double"


def _unit(column) -> tuple[np.ndarray, np.ndarray]:
    """Vectors of length one, and which are none."""
    m = np.array(column.to_pylist(), np.float64) if len(column) else np.empty((0, 0))
    norm = np.linalg.norm(m, axis=1) if m.size else np.zeros(len(column))
    zero = norm == 0
    return m / np.where(zero, 1, norm)[:, None] if m.size else m, zero


def _angles(m: np.ndarray, pivots: np.ndarray) -> np.ndarray:
    return np.arccos(np.clip(m @ pivots.T, -1, 1))


def _record(cluster: int, ids: np.ndarray, m: np.ndarray, radius: float) -> pa.RecordBatch:
    return pa.RecordBatch.from_pydict({"cluster": pa.array([cluster], pa.int32()), "ids": pa.array([ids.astype(np.int64).tobytes()], pa.binary()), "m": pa.array([m.tobytes()], pa.binary()), "radius": pa.array([radius], pa.float64())})


def _dealt(pivots: np.ndarray) -> Callable:
    """Vectors -> blocks of one cluster each; a vector's cluster is its nearest pivot's. Null vectors (all zero) are cluster -1."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        held: dict[int, list] = defaultdict(list)
        size: dict[int, int] = defaultdict(int)

        def block(c: int) -> pa.RecordBatch:
            ids, m, angle = (np.concatenate(x) for x in zip(*held.pop(c), strict=True))
            size.pop(c)
            return _record(c, ids, m, float(angle.max()))

        for batch in batches:
            if not batch.num_rows:
                continue
            m, zero = _unit(batch.column("embedding"))
            ids, angle = batch.column("vec_id").to_numpy(zero_copy_only=False), _angles(m, pivots)
            near = np.where(zero, -1, angle.argmin(axis=1))
            for c in np.unique(near).tolist():
                at = np.flatnonzero(near == c)
                for k in range(0, len(at), _VECTORS):
                    some = at[k : k + _VECTORS]
                    held[c].append((ids[some], m[some], angle[some, c] if c >= 0 else np.zeros(len(some))))
                    size[c] += len(some)
                    if size[c] >= _VECTORS:
                        yield block(c)
            if sum(size.values()) > _HELD:
                for c in list(held):
                    yield block(c)
        for c in list(held):
            yield block(c)

    return rows


def _asked(pivots: np.ndarray, clusters: dict[int, tuple[float, int]], k: int, first: bool) -> Callable:
    """Queries (vec_id, embedding and, on the second pass, last: the score of the k-th so far) -> blocks of queries for each cluster that
    they have to see: on the first pass the nearest that hold k vectors, on the second all others whose bound reaches `last`.
    clusters: radius and size of each."""
    real = np.array(sorted(c for c in clusters if c >= 0), np.int64)
    reach, size = (np.array([clusters[c][x] for c in real.tolist()]) for x in (0, 1))

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if not batch.num_rows or not clusters:
                continue
            m, zero = _unit(batch.column("embedding"))
            ids = batch.column("vec_id").to_numpy(zero_copy_only=False)
            angle = _angles(m, pivots)[:, real]
            order = angle.argsort(axis=1, kind="stable")
            before = np.cumsum(size[order], axis=1) - size[order] if len(real) else np.empty((len(ids), 0))
            home = np.zeros(angle.shape, bool)
            np.put_along_axis(home, order, before < k, axis=1)
            if first:
                sees = home
            else:
                last = batch.column("last").to_numpy(zero_copy_only=False).astype(np.float64)
                last = np.where(np.isnan(last), -2, last)
                bound = np.cos(np.clip(angle - reach, 0, np.pi)) + _SLACK
                bound[zero] = 2  # a null query has the same score with all
                sees = ~home & (bound >= last[:, None])
            parts = {c: np.flatnonzero(sees[:, i]) for i, c in enumerate(real.tolist())}
            if -1 in clusters and not first:
                parts[-1] = np.flatnonzero(last <= _SLACK)
            for c, at in parts.items():
                for x in range(0, len(at), _QUERIES):
                    some = at[x : x + _QUERIES]
                    yield _record(c, ids[some], m[some], 0.0)

    return rows


def _products(k: int) -> Callable:
    """Pairs of a block of vectors and one of queries -> of each query the k best of the block, ties by id."""

    def rows(batches) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for r in batch.to_pylist():
                ids, asked = np.frombuffer(r["ids"], np.int64), np.frombuffer(r["q_ids"], np.int64)
                order = np.argsort(ids, kind="stable")
                ids, m = ids[order], np.frombuffer(r["m"]).reshape(len(ids), -1)[order]
                score = np.round(np.frombuffer(r["q_m"]).reshape(len(asked), -1) @ m.T, _DIGITS) + 0.0
                best = np.argsort(-score, axis=1, kind="stable")[:, :k]
                yield pa.RecordBatch.from_pydict({"query_id": np.repeat(asked, best.shape[1]), "vec_id": ids[best].ravel(), "score": np.take_along_axis(score, best, 1).ravel()})

    return rows


def vector_topk(vectors: DataFrame, queries: DataFrame, k: int = 3, pivots: int = 64, itself: bool = False) -> DataFrame:
    """The k vectors (vec_id, embedding) with the largest cosine to each query, ties by id: query_id, vec_id, k, score (six digits,
    rounded before they are compared). A query's own id is left out, unless `itself` is wanted.

    Vectors are clustered around `pivots` of them (those with the least hashes of their ids: all that goes to every task, with a
    radius for each cluster). No vector of a cluster is nearer to a query than the angle to the pivot less the cluster's radius. A
    query sees its nearest clusters with more than k vectors first, then only those whose bound reaches the k-th score found there, so that nothing can be
    missed. Both are joins of blocks of vectors with blocks of queries by cluster, each pair of blocks one product of matrices: two passes
    whatever the sizes, and a large cluster is many blocks. Where vectors have no clusters, bounds leave little out, and
    the queries see all blocks.

    Null embeddings and ids are left out, an all-zero vector has the score 0 with all. Ids of vectors and of queries are unique; all
    embeddings have one length. Empty tables give an empty result."""
    scratch = Tables(vectors.sparkSession, "vectors")
    clean = lambda df: df.where("vec_id is not null and embedding is not null").select(F.col("vec_id").cast("long").alias("vec_id"), F.col("embedding").cast("array<double>").alias("embedding"))
    vectors, asked = clean(vectors), clean(queries)
    chosen = vectors.where(F.exists("embedding", lambda x: x != 0)).orderBy(F.xxhash64("vec_id"), "vec_id").limit(pivots).collect()
    sample = np.array([r.embedding for r in chosen], np.float64)
    sample = sample / np.linalg.norm(sample, axis=1)[:, None] if len(chosen) else np.zeros((1, len((vectors.first() or [0, [0.0]])[1])))
    blocks = scratch.write(vectors.mapInArrow(_dealt(sample), _BLOCK), "blocks", batch=2000)
    sizes = blocks.groupBy("cluster").agg(F.max("radius").alias("radius"), F.sum(F.octet_length("ids") / 8).cast("long").alias("size"))
    clusters = {r.cluster: (r.radius, r.size) for r in sizes.collect()}
    found = "query_id long, vec_id long, score double"

    def seen(rows: DataFrame, first: bool, name: str) -> DataFrame:
        parts = scratch.write(rows.mapInArrow(_asked(sample, clusters, k + 1, first), _BLOCK), f"{name}-queries", batch=2000)
        pairs = blocks.drop("radius").join(parts.select("cluster", F.col("ids").alias("q_ids"), F.col("m").alias("q_m")).hint("merge"), "cluster")
        return scratch.write(pairs.select("ids", "m", "q_ids", "q_m").mapInArrow(_products(k + 1), found), name, batch=_AT_ONCE)

    def ranked(df: DataFrame) -> DataFrame:
        df = df if itself else df.where("query_id <> vec_id")
        return df.withColumn("k", F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))).where(F.col("k") <= k)

    near = seen(asked, True, "near")
    last = ranked(near).where(F.col("k") == k).select(F.col("query_id").alias("vec_id"), F.col("score").alias("last"))
    far = seen(asked.join(last.hint("merge"), "vec_id", "left").select("vec_id", "embedding", "last"), False, "far")
    return ranked(near.unionByName(far)).select("query_id", "vec_id", "k", "score")
