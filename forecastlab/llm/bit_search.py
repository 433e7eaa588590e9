"""Nearest neighbours by largest inner product, with randomly rotated one-bit codes.

Index: each vector less the mean of all is rotated by one random orthogonal matrix; the signs are packed
into bits and two scalars are kept, its length and the inner product of its direction with its code. From
these the inner product with a query is estimated without bias, with an error bound that shrinks with the dimension.

Search: every task goes through its part of the index in blocks against one bounded block of queries. It
keeps the exact scores of the best so far; only vectors whose estimate plus error bound reaches the
``k``-th of them are scored exactly, on the original numbers in double precision. The tasks' best are
merged by rank. All rows are indexed and every vector's code meets every query; there is no
cap on candidates. ``ERROR_WIDTH`` standard errors make a miss rare; the tests measure recall.

Vectors that are null, zero, of another length than most, or hold null or non-finite components take no
part. A query never finds rows with its own id. An id asks once, with the least of its vectors where rows repeat it; a repeated
row is found as often as it occurs. With fewer candidates than
``k``, all are returned; an empty table gives no rows.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window, functions as F

from forecastlab.llm.common import table
from forecastlab.llm.registry import query
from forecastlab.session import settle

NEIGHBOURS = 20
ERROR_WIDTH = 2.5
QUERY_BLOCK = 8192  # queries on the driver and in a broadcast at one time
QUERY_TILE = 512
VECTOR_BLOCK = 4096
FIRST_LOOK = 4  # times k vectors, by estimate, that set the first threshold of a block
SEED = 11


def usable(vectors: DataFrame) -> tuple[DataFrame, int]:
    """``(vec_id, embedding)`` of the vectors that take part, and their dimension."""
    fine = F.forall("embedding", lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    rows = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), "embedding").where(
        F.col("vec_id").isNotNull() & F.col("embedding").isNotNull()
        & F.coalesce(fine, F.lit(False)) & F.exists("embedding", lambda x: x != 0)
    )
    most = rows.groupBy(F.size("embedding").alias("d")).count().orderBy(F.desc("count"), F.desc("d")).first()
    dim = most["d"] if most else 0
    return rows.where(F.size("embedding") == dim), dim


def rotation(dim: int, seed: int = SEED) -> np.ndarray:
    q, r = np.linalg.qr(np.random.default_rng(seed).standard_normal((dim, dim)))
    return q * np.sign(np.diag(r))


def encode_block(x: np.ndarray, centre: np.ndarray, turn: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Packed sign bits, lengths, and inner products of direction and code of rows ``x``."""
    rest = (x - centre) @ turn
    length = np.linalg.norm(rest, axis=1)
    unit = rest / np.where(length > 0, length, 1)[:, None]
    match = np.abs(unit).sum(axis=1) / np.sqrt(x.shape[1])
    return np.packbits(rest >= 0, axis=1), length, np.where(length > 0, match, 1.0)


def matrix(column: pa.Array, dim: int) -> np.ndarray:
    """A list column as rows, in double precision."""
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def build_index(vectors: DataFrame) -> tuple[DataFrame, np.ndarray]:
    """The index ``(vec_id, embedding, code, length, match)``, written to the shared folder, and the mean it is centred on."""
    rows, dim = usable(vectors)
    if dim == 0:
        return settle(rows.selectExpr("vec_id", "embedding", "binary(null) code", "0D length", "0D match"), "bit_index"), np.zeros(0)
    sums = rows.agg(F.array(*[F.avg(F.col("embedding")[k].cast("double")) for k in range(dim)])).first()[0]
    centre, turn = np.array(sums), rotation(dim)

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                bits, length, match = encode_block(matrix(batch.column("embedding"), dim), centre, turn)
                yield pa.record_batch(
                    [batch.column("vec_id"), batch.column("embedding"), pa.array([b.tobytes() for b in bits], pa.binary()), pa.array(length), pa.array(match)],
                    names=["vec_id", "embedding", "code", "length", "match"],
                )

    kind = rows.schema["embedding"].dataType.simpleString()
    return settle(rows.mapInArrow(work, f"vec_id long, embedding {kind}, code binary, length double, match double"), "bit_index"), centre


class Best:
    """The best exact scores of one query tile so far."""

    def __init__(self, ids: np.ndarray, queries: np.ndarray, centre: np.ndarray, turn: np.ndarray, k: int):
        self.ids, self.queries, self.k = ids, queries, k
        self.turned = (queries @ turn).astype(np.float32)
        self.at_centre = queries @ centre
        self.width = ERROR_WIDTH * np.linalg.norm(queries, axis=1) / np.sqrt(max(1, queries.shape[1] - 1))
        self.bar = np.full(len(ids), -np.inf)
        self.found = (np.zeros(0, np.int64), np.zeros(0, np.int64), np.zeros(0))

    def add(self, at: np.ndarray, rows: np.ndarray, vec_ids: np.ndarray, x: np.ndarray) -> None:
        """Score the pairs (query ``at``, vector ``rows``) exactly and keep the best ``k`` of each query."""
        parts = [np.einsum("ij,ij->i", self.queries[at[s : s + 65536]], x[rows[s : s + 65536]]) for s in range(0, len(at), 65536)]
        q = np.concatenate([self.found[0], at])
        v = np.concatenate([self.found[1], vec_ids[rows]])
        score = np.concatenate([self.found[2], *parts])
        order = np.lexsort((v, -score, q))
        q, v, score = q[order], v[order], score[order]
        first = np.searchsorted(q, np.arange(len(self.ids)))
        rank = np.arange(len(q)) - first[q]
        keep = rank < self.k
        self.found = q[keep], v[keep], score[keep]
        last = rank == self.k - 1
        self.bar[q[last]] = score[last]

    def search(self, vec_ids: np.ndarray, x: np.ndarray, signs: np.ndarray, length: np.ndarray, match: np.ndarray) -> None:
        scale = length / (match * np.sqrt(x.shape[1]))
        estimate = (self.turned @ signs.T) * scale.astype(np.float32) + self.at_centre[:, None].astype(np.float32)
        error = length * np.sqrt(np.maximum(0, 1 - match**2)) / match
        own = self.ids[:, None] == vec_ids[None, :]
        estimate[own] = -np.inf
        if np.isneginf(self.bar).any():
            many = min(FIRST_LOOK * self.k, len(vec_ids))
            rows = np.argpartition(-estimate, many - 1, axis=1)[:, :many]
            at = np.repeat(np.arange(len(self.ids)), many)
            rows = rows.ravel()
            fine = estimate[at, rows] > -np.inf
            self.add(at[fine], rows[fine], vec_ids, x)
            estimate[at, rows] = -np.inf
        at, rows = np.nonzero((estimate + self.width[:, None].astype(np.float32) * error.astype(np.float32) >= self.bar[:, None]) & (estimate > -np.inf))
        if len(at):
            self.add(at, rows, vec_ids, x)


def search_block(index: DataFrame, centre: np.ndarray, ids: np.ndarray, queries: np.ndarray, k: int) -> DataFrame:
    """Each task's best ``(query_id, vec_id, score)`` for one bounded block of queries."""
    dim = len(centre)
    shared = index.sparkSession.sparkContext.broadcast((centre, ids, queries))  # bounded by QUERY_BLOCK

    def work(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        centre, ids, queries = shared.value
        turn = rotation(dim)
        tiles = [Best(ids[s : s + QUERY_TILE], queries[s : s + QUERY_TILE], centre, turn, k) for s in range(0, len(ids), QUERY_TILE)]
        for whole in batches:
            for start in range(0, whole.num_rows, VECTOR_BLOCK):
                batch = whole.slice(start, VECTOR_BLOCK)
                bits = np.frombuffer(b"".join(batch.column("code").to_pylist()), np.uint8).reshape(batch.num_rows, -1)
                signs = np.unpackbits(bits, axis=1)[:, :dim].astype(np.float32) * 2 - 1
                vec_ids = batch.column("vec_id").to_numpy()
                x = matrix(batch.column("embedding"), dim)
                length, match = batch.column("length").to_numpy(), batch.column("match").to_numpy()
                for tile in tiles:
                    tile.search(vec_ids, x, signs, length, match)
        for tile in tiles:
            at, vec_ids, score = tile.found
            yield pa.record_batch([pa.array(tile.ids[at]), pa.array(vec_ids), pa.array(score)], names=["query_id", "vec_id", "score"])

    return index.select("vec_id", "embedding", "code", "length", "match").mapInArrow(work, "query_id long, vec_id long, score double")


def nearest(vectors: DataFrame, is_query, k: int = NEIGHBOURS) -> DataFrame:
    """``(query_id, rank, vec_id, score)`` of every row for which ``is_query`` holds, against all rows."""
    index, centre = build_index(vectors)
    asked = index.where(is_query).groupBy("vec_id").agg(F.min("embedding").alias("embedding"))
    blocks = max(1, -(-asked.count() // (QUERY_BLOCK // 2)))  # half filled, as the hash spreads unevenly
    empty = asked.sparkSession.createDataFrame([], "query_id long, vec_id long, score double")
    parts = []
    for block in range(blocks if len(centre) else 0):
        rows = asked.where(F.pmod(F.xxhash64("vec_id"), F.lit(blocks)) == block).orderBy("vec_id").collect()
        if rows:
            ids = np.array([r["vec_id"] for r in rows], dtype=np.int64)
            queries = np.array([r["embedding"] for r in rows], dtype=np.float64)
            part = search_block(index, centre, ids, queries, k)
            parts.append(settle(part, "bit_search") if blocks > 1 else part)
    found = reduce(DataFrame.unionByName, parts, empty) if len(parts) != 1 else parts[0]
    order = Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id")
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select(
        "query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score"
    )


@query("op4_bit_search")
def op4_bit_search(spark, sf_dir):
    return nearest(table(spark, sf_dir, "embeddings"), F.col("vec_id") % 20 == 0)
