"""Exact top-k inner products: norm-sorted vectors, rotated partial sums, Cauchy-Schwarz bounds."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlink.llm.shared import cut, new_folder

QUERY_BLOCK = 4096
HEAD_ROWS = 4096
_ROWS = 2048


def _matrix(column: pa.Array, width: int) -> np.ndarray:
    """Rows of a list column as a matrix; shorter rows end in zeros."""
    lists = column.cast(pa.list_(pa.int64()))
    sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False).astype(np.int64)
    out = np.zeros((len(lists), width), np.int64)
    row = np.repeat(np.arange(len(lists)), sizes)
    out[row, np.arange(len(row)) - np.repeat(np.cumsum(sizes) - sizes, sizes)] = lists.flatten().to_numpy()
    return out


def _gram(vectors: DataFrame, width: int) -> np.ndarray:
    """Sum of the outer products of all vectors: width x width numbers, summed by task, then over tasks."""

    def add(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        total = np.zeros((width, width))
        for batch in batches:
            for low in range(0, batch.num_rows, _ROWS):
                part = _matrix(batch.column("v").slice(low, _ROWS), width).astype(float)
                total += part.T @ part
        yield pa.RecordBatch.from_arrays([pa.array(np.arange(width * width)), pa.array(total.ravel())], names=["cell", "x"])

    cells = vectors.select("v").mapInArrow(add, "cell long, x double").groupBy("cell").agg(F.sum("x").alias("x")).collect()
    out = np.zeros(width * width)
    for cell, x in cells:
        out[cell] = x
    return out.reshape(width, width)


def _sortable(ids: np.ndarray) -> np.ndarray:
    """Numbers in the order of the ids, which may be strings."""
    return np.unique(ids, return_inverse=True)[1] if ids.dtype == object else ids


class _Queries:
    """One block of queries, rotated, with the score that the k-th best of each has at least."""

    def __init__(self, uid: np.ndarray, vectors: np.ndarray, rotation: np.ndarray, parts: list[int], least: np.ndarray) -> None:
        self.uid, self.vectors, self.rotation, self.parts, self.least = uid, vectors, rotation, parts, least
        self.turned = vectors @ rotation
        self.rest = np.sqrt(np.maximum(0, np.cumsum((self.turned**2)[:, ::-1], 1)[:, ::-1]))

    def search(self, uid: np.ndarray, ids: np.ndarray, vectors: np.ndarray, k: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """(query, candidate, score) of all pairs that may be among the k best of these candidates or those before."""
        turned = vectors @ self.rotation
        rest = np.sqrt(np.maximum(0, np.cumsum((turned**2)[:, ::-1], 1)[:, ::-1]))
        slack = 1e-9 * float(self.rest[:, 0].max(initial=0)) * float(rest[:, 0].max(initial=0)) + 1e-6
        row = np.flatnonzero(self.rest[:, 0] * rest[:, 0].max(initial=0) + slack >= self.least)
        if not len(row):
            none = np.zeros(0, np.int64)
            return none, none, none
        sums, done = np.zeros((len(row), len(ids))), 0
        live = np.ones((len(row), len(ids)), bool)
        for to in self.parts:  # partial sums over the leading axes; what is left is bounded by the residual lengths
            sums += self.turned[row, done:to] @ turned[:, done:to].T
            done = to
            left = np.outer(self.rest[row, to], rest[:, to]) if to < turned.shape[1] else 0.0
            live = sums + left + slack >= self.least[row][:, None]
            keep = live.any(1)
            row, sums = row[keep], sums[keep]
            live = live[keep]
        query, cand = np.nonzero(live)
        query = row[query]
        own = self.uid[query] == uid[cand]
        query, cand = query[~own], cand[~own]
        score = np.empty(len(query), np.int64)
        for low in range(0, len(query), 200_000):
            at = slice(low, low + 200_000)
            score[at] = np.einsum("ij,ij->i", self.vectors[query[at]], vectors[cand[at]])
        order = np.lexsort((_sortable(ids[cand]), -score, query))
        query, cand, score = query[order], cand[order], score[order]
        rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
        best = rank < k
        return query[best], cand[best], score[best]


def top_k(vectors: DataFrame, is_query: Column, k: int = 5, id_column: str = "vec_id", vector_column: str = "v", query_block: int = QUERY_BLOCK) -> DataFrame:
    """The k rows of highest integer inner product for each query row, ties to the smaller id: query_id, rank, id, score.

    ``vector_column`` holds arrays of integers (up to 2**26 in size, so that sums are exact); shorter ones end in
    zeros; a larger component raises. Rows with a null vector, a vector with a null component or a null id take no part.
    A row is no candidate of its own query, but another row with the same id or vector is. Fewer than k candidates: all
    of them. An empty table gives an empty result. Ids keep their type; other columns are not read.

    Vectors are range-partitioned and sorted by descending length. The longest ones give every query a first k-th best
    score; after that, a stretch of vectors is left out for a query when length times length stays under it, and a pair
    when the partial sum over the leading axes (of a rotation to the singular axes of all vectors) plus the product of
    the residual lengths does. What is left is scored in integers. Queries go in blocks of ``query_block``, each a
    pass over the vectors whose finds are written to the shared folder before the next block is sent, so no task, plan or
    driver holds more than one block, a stretch of rows and their partial sums.
    """
    spark = vectors.sparkSession
    ready = vectors.where(F.col(id_column).isNotNull() & F.col(vector_column).isNotNull() & F.forall(vector_column, lambda x: x.isNotNull()))
    large = F.exists(vector_column, lambda x: F.abs(x) > 1 << 26)
    whole = F.when(large, F.raise_error(F.lit("a component exceeds 2**26")).cast("array<long>")).otherwise(F.col(vector_column).cast("array<long>"))
    ready = ready.select(F.monotonically_increasing_id().alias("uid"), F.col(id_column).alias("id"), whole.alias("v"), is_query.alias("asks"))
    length = F.sqrt(F.aggregate("v", F.lit(0.0), lambda s, x: s + x.cast("double") * x))
    ready = ready.withColumn("length", length)
    parts = int(spark.conf.get("spark.sql.shuffle.partitions"))
    ready = cut(ready.repartitionByRange(parts, F.desc("length"), "uid").sortWithinPartitions(F.desc("length"), "uid"))
    width, asking = ready.agg(F.max(F.size("v")), F.sum(F.col("asks").cast("long"))).first()
    id_type = vectors.schema[id_column].dataType.simpleString()
    kind = f"query_id {id_type}, rank int, `{id_column}` {id_type}, score long"
    if not asking:
        return spark.createDataFrame([], kind)
    width = max(1, width)
    gram = _gram(ready, width)
    rotation = np.linalg.eigh(gram)[1][:, ::-1].copy()
    steps = sorted({max(1, width // 4), max(1, width // 2), width})
    head = ready.orderBy(F.desc("length"), "uid").limit(HEAD_ROWS).select("uid", "id", "v").toArrow()
    head_uid, head_ids, head_v = head.column("uid").to_numpy(), head.column("id").to_numpy(), _matrix(head.column("v").combine_chunks(), width)
    blocks, folder = -(-asking // query_block), new_folder(spark, "top")
    for block in range(blocks):
        mine = ready.where(F.col("asks") & (F.pmod(F.xxhash64("uid"), F.lit(blocks)) == block)).select("uid", "id", "v").toArrow()
        if not mine.num_rows:
            continue
        query_ids = mine.column("id").to_numpy()
        held = _Queries(mine.column("uid").to_numpy(), _matrix(mine.column("v").combine_chunks(), width), rotation, steps, np.full(mine.num_rows, -np.inf))
        for low in range(0, len(head_ids), _ROWS // 4):
            stretch = slice(low, low + _ROWS // 4)
            query, _, score = held.search(head_uid[stretch], head_ids[stretch], head_v[stretch], k)
            _raise(held, query, score, k)
        shared = spark.sparkContext.broadcast((held, query_ids))

        def run(batches: Iterator[pa.RecordBatch], shared=shared) -> Iterator[pa.RecordBatch]:
            (held, query_ids), held_least = shared.value, shared.value[0].least.copy()
            mine = _Queries(held.uid, held.vectors, held.rotation, held.parts, held_least)
            best: tuple[np.ndarray, ...] = tuple(np.zeros(0, np.int64) for _ in range(3))
            id_kind = None
            for batch in batches:
                for low in range(0, batch.num_rows, _ROWS // 4):
                    part = batch.slice(low, _ROWS // 4)
                    id_kind = part.column("id").type
                    ids = part.column("id").to_numpy(zero_copy_only=False)
                    query, cand, score = mine.search(part.column("uid").to_numpy(), ids, _matrix(part.column("v"), width), k)
                    merged = [np.concatenate(x) for x in zip(best, (query, ids[cand], score))]
                    order = np.lexsort((_sortable(merged[1]), -merged[2], merged[0]))
                    merged = [x[order] for x in merged]
                    rank = np.arange(len(order)) - np.searchsorted(merged[0], merged[0], "left")
                    best = tuple(x[rank < k] for x in merged)
                    full = rank[rank < k] == k - 1
                    mine.least[best[0][full]] = np.maximum(mine.least[best[0][full]], best[2][full])
            if id_kind is None:
                return
            yield pa.RecordBatch.from_arrays([pa.array(mine.uid[best[0]]), pa.array(query_ids[best[0]], id_kind), pa.array(best[1], id_kind), pa.array(best[2])], names=["uid", "query_id", id_column, "score"])

        one = ready.select("uid", "id", "v").mapInArrow(run, f"uid long, query_id {id_type}, `{id_column}` {id_type}, score long")
        one.write.parquet(f"{folder}/block={block}")
        shared.unpersist()
    found = spark.read.parquet(folder)
    order = Window.partitionBy("uid").orderBy(F.desc("score"), id_column)
    return found.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k).select("query_id", "rank", id_column, "score")


def _raise(held: _Queries, query: np.ndarray, score: np.ndarray, k: int) -> None:
    """Lift each query's least score to the k-th best of one stretch, if it has k."""
    rank = np.arange(len(query)) - np.searchsorted(query, query, "left")
    full = rank == k - 1
    held.least[query[full]] = np.maximum(held.least[query[full]], score[full])
