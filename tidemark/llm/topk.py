"""Exact top-k by inner product: tiles of queries times tiles of candidates, a partial selection per tile, merges of top lists."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.window import Window

from tidemark.llm.common import checkpoint, parallelism, table

SCALE = 1024
K = 10
#: A tile has at most so many rows and so many bytes of float64 components.
TILE_ROWS, TILE_BYTES = 4096, 8 << 20
#: Sums of whole numbers below this are exact in float64.
EXACT = 2.0**53
_LONG = (-(1 << 63), (1 << 63) - 1)


def valid(vectors: DataFrame) -> DataFrame:
    """vec_id and whole components (as doubles) of the rows that take part."""
    ok = F.col("vec_id").isNotNull() & F.col("embedding").isNotNull() & F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) != float("inf")))
    return vectors.where(ok).select(F.col("vec_id").cast("long").alias("vec_id"), F.transform("embedding", lambda x: x.cast("double")).alias("v"))


def _tiles(rows: DataFrame) -> DataFrame:
    """(no, dim, ids, parts): vectors of equal length packed as bytes, as they come; no counts a partition's tiles."""

    def run(batches):
        held: dict[int, list] = {}
        no = 0

        def full(dim):
            ids, parts = zip(*held.pop(dim), strict=True)
            return pa.RecordBatch.from_arrays([pa.array([no], pa.int64()), pa.array([dim], pa.int32()), pa.array([np.concatenate(ids).tobytes()], pa.binary()), pa.array([np.concatenate(parts).tobytes()], pa.binary())], names=["no", "dim", "ids", "parts"])

        for batch in batches:
            ids, lists = batch.column(0).to_numpy(), batch.column(1)
            lengths, flat = lists.value_lengths().to_numpy(), np.floor(lists.flatten().to_numpy() * SCALE) + 0.0
            ends = np.cumsum(lengths)
            for dim in np.unique(lengths).tolist():
                mine = np.flatnonzero(lengths == dim)
                most = max(1, min(TILE_ROWS, TILE_BYTES // (8 * dim or 1)))
                for at in range(0, len(mine), most):
                    part = mine[at : at + most]
                    values = flat[(ends[part, None] - dim + np.arange(dim)).ravel()].reshape(len(part), dim)
                    if sum(len(x) for x, _ in held.get(dim, [])) + len(part) > most:
                        yield full(dim)
                        no += 1
                    held.setdefault(dim, []).append((ids[part], values))
        for dim in list(held):
            yield full(dim)
            no += 1

    return rows.mapInArrow(run, "no long, dim int, ids binary, parts binary")


def products(a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Exact inner products of whole-numbered rows: in float64 where no sum can leave its exact range, else in Python integers held to 64 bits."""
    most = (np.abs(a).max(initial=0.0)) * (np.abs(b).max(initial=0.0)) * max(1, a.shape[1])
    if most < EXACT:
        return (a @ b.T).astype(np.int64)
    whole = lambda m: np.array([[int(x) for x in row] for row in m.tolist()], object).reshape(m.shape)
    return np.clip(whole(a).dot(whole(b).T), *_LONG).astype(np.int64)


def select(scores: np.ndarray, ids: np.ndarray, own: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray]:
    """(row, column) of each row's k best: higher score, then smaller id; columns with the row's own id are passed over."""
    rows, cols = [], []
    order = np.argsort(ids, kind="stable")
    ids, scores = ids[order], scores[:, order]
    other = ids[None, :] != own[:, None]
    at = max(0, len(ids) - k)
    kth = np.partition(np.where(other, scores, _LONG[0]), at, axis=1)[:, at] if len(ids) else np.zeros(len(own), np.int64)
    for r in range(len(own)):
        c = np.flatnonzero(other[r] & (scores[r] >= kth[r]))
        if len(c) > k:
            c = c[np.argsort(~scores[r, c], kind="stable")[:k]]  # ~s descends as s ascends and never overflows
        rows.append(np.full(len(c), r))
        cols.append(order[c])
    return (np.concatenate(rows), np.concatenate(cols)) if rows else (np.zeros(0, np.int64), np.zeros(0, np.int64))


def _best(pairs: DataFrame, k: int) -> DataFrame:
    """The top lists of all (query tile, candidate tile) pairs that a task sees, merged per query tile as they come."""

    def run(batches):
        held: dict[tuple, list[np.ndarray]] = {}

        def merged(tile):
            """Per query: score descending, id ascending, the first k."""
            q, row, i, s = map(np.concatenate, zip(*held[tile], strict=True))
            order = np.lexsort((i, ~s, row))
            row = row[order]
            starts = np.flatnonzero(np.r_[True, row[1:] != row[:-1]]) if len(row) else np.zeros(0, np.int64)
            rank = np.arange(len(row)) - np.repeat(starts, np.diff(np.r_[starts, len(row)]))
            kept = order[rank < k]
            return q[kept], row[rank < k], i[kept], s[kept]

        def out(tile):
            q, row, i, s = merged(tile)
            return pa.RecordBatch.from_arrays([pa.array(np.full(len(q), tile[0])), pa.array(np.full(len(q), tile[1])), pa.array(row), pa.array(q), pa.array(i), pa.array(s)], names=["part", "no", "row", "query_id", "vec_id", "score"])

        for batch in batches:
            for part, no, dim, qi, qp, ci, cp in zip(*(c.to_pylist() for c in batch.columns), strict=True):
                own, ids = np.frombuffer(qi, np.int64), np.frombuffer(ci, np.int64)
                scores = products(np.frombuffer(qp).reshape(len(own), dim), np.frombuffer(cp).reshape(len(ids), dim))
                r, c = select(scores, ids, own, k)
                held.setdefault((part, no), []).append((own[r], r, ids[c], scores[r, c]))
                if len(held[part, no]) > 8:
                    held[part, no] = [merged((part, no))]
                if len(held) > 64:
                    yield out(first := next(iter(held)))
                    del held[first]
        for tile in held:
            yield out(tile)

    return pairs.mapInArrow(run, "part long, no long, row long, query_id long, vec_id long, score long")


def search(vectors: DataFrame, is_query, k: int = K) -> DataFrame:
    """query_id, rank, vec_id, score: the k best candidates of each row that fits is_query, or all if there are fewer.

    Vectors that are null or hold null, NaN or infinite components, and rows with a null vec_id, take no part. Only
    vectors of equal length are compared; of length 0, at score 0. Repeated candidate rows are candidates of their own;
    rows equal in vec_id and vector are one query, and no query meets a row of its own id. Scores beyond 64 bits
    stay at its ends. Other columns are not read; an empty table gives no rows.

    Every candidate tile goes to one lane, dealt in turn, every query tile to all lanes, so tiles meet by an ordinary join on the lane.
    """
    rows = valid(vectors)
    lanes = parallelism(vectors.sparkSession)
    parts = rows.rdd.getNumPartitions()
    dealt = F.pmod(F.col("no") * parts + F.spark_partition_id(), F.lit(lanes)).cast("int")
    candidates = _tiles(rows).select(dealt.alias("lane"), "dim", F.col("ids").alias("c_ids"), F.col("parts").alias("c_parts"))
    asked = checkpoint(rows.where(is_query).distinct())
    queries = checkpoint(_tiles(asked.coalesce(-(-asked.count() // TILE_ROWS) or 1)).withColumn("part", F.spark_partition_id().cast("long")))
    spread = queries.withColumn("lane", F.explode(F.sequence(F.lit(0), F.lit(lanes - 1))))
    pairs = spread.join(candidates, ["lane", "dim"]).select("part", "no", "dim", "ids", "parts", "c_ids", "c_parts")
    one = ["part", "no", "row"]
    rank = F.row_number().over(Window.partitionBy(*one).orderBy(F.desc("score"), "vec_id"))
    return _best(pairs, k).withColumn("rank", rank).where(F.col("rank") <= k).select("query_id", "rank", "vec_id", "score")


def op4_exact_top_k(spark: SparkSession, sf_dir: str) -> DataFrame:
    return search(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 100 == 0)


ORACLE = """
WITH valid AS (
  SELECT vec_id, list_transform(embedding, lambda x: CAST(floor(1024 * CAST(x AS DOUBLE)) AS DOUBLE)) AS v
  FROM embeddings
  WHERE vec_id IS NOT NULL AND embedding IS NOT NULL
    AND len(list_filter(embedding, lambda x: x IS NULL OR NOT isfinite(x))) = 0
), scored AS (
  SELECT q.vec_id AS query_id, c.vec_id AS vec_id, CAST(list_inner_product(q.v, c.v) AS BIGINT) AS score
  FROM valid q JOIN valid c ON q.vec_id % 100 = 0 AND q.vec_id <> c.vec_id AND len(q.v) = len(c.v)
), ranked AS (
  SELECT query_id, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, vec_id) AS INTEGER) AS rank, vec_id, score FROM scored
)
SELECT query_id, rank, vec_id, score FROM ranked WHERE rank <= 10
"""
