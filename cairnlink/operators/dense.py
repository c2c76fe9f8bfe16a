"""Exact inner-product search by blocks of queries: matrix products on the executors, never a row for each pair."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairnlink.sources.tables import shared_folder

QUERY_BLOCK, _ROWS = 4096, 2048
#: Which corpus groups a query group may meet: two arrays of groups to a matrix of booleans.
Allow = Callable[[np.ndarray, np.ndarray], np.ndarray]


def _matrix(vectors: pa.Array, width: int) -> np.ndarray:
    return np.array([x[:width] + [0.0] * (width - len(x)) for x in vectors.to_pylist()], float).reshape(len(vectors), width)


def _blocks(queries: DataFrame, block: int):
    """The queries, ``block`` or so at a time, as Arrow tables; the driver holds one of them."""
    ready = queries.where("id is not null and vector is not null")
    count = ready.count()
    blocks = max(1, -(-count // block))
    for i in range(blocks):
        yield i, blocks, ready.where(F.pmod(F.xxhash64("id"), F.lit(blocks)) == i).toArrow()


def _best(query: np.ndarray, ids: np.ndarray, sim: np.ndarray, k: int) -> np.ndarray:
    """Places of the k best of each query, ties to the smaller id, in order."""
    _, tie = np.unique(ids, return_inverse=True)
    order = np.lexsort((tie, -sim, query))
    ranked = query[order]
    return order[np.arange(len(order)) - np.searchsorted(ranked, ranked, "left") < k]


def search(queries: DataFrame, corpus: DataFrame, k: int, decimals: int = 6, floor: float = -np.inf, allow: Allow | None = None, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, c, sim, rank): for every query the k rows of the corpus of highest inner product but itself, ties to the smaller id.

    Both sides have id and vector, and group if ``allow`` is given. Similarities are rounded to ``decimals`` before they are
    compared. Each task keeps k rows for a query; blocks of queries are passes over the corpus, whose finds are written to the
    shared folder if there are several. Null ids and vectors take no part.
    """
    spark, kind = queries.sparkSession, to_arrow_type(corpus.schema["id"].dataType)
    columns = ["id", "vector", *(["group"] if allow else [])]
    rows = corpus.select(*columns).where("id is not null and vector is not null")
    schema = f"q {queries.schema['id'].dataType.simpleString()}, c {corpus.schema['id'].dataType.simpleString()}, sim double"
    asked_kind, parts, folder = to_arrow_type(queries.schema["id"].dataType), [], None
    for i, blocks, mine in _blocks(queries.select(*columns), block):
        width = max((len(x) for x in mine.column("vector").to_pylist()), default=0)
        asked = mine.column("id").to_numpy() if mine.num_rows else np.zeros(0, np.int64)
        held = spark.sparkContext.broadcast((asked, _matrix(mine.column("vector").combine_chunks(), width) if mine.num_rows else np.zeros((0, 0)), mine.column("group").to_numpy() if allow else None, width))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            asked, left, groups, width = held.value
            query, ids, sims = np.zeros(0, np.int64), np.zeros(0, object), np.zeros(0)
            least = np.full(len(asked), floor, float)
            for batch in batches:
                for low in range(0, batch.num_rows if len(asked) else 0, _ROWS):
                    part = batch.slice(low, _ROWS)
                    names = part.column("id").to_numpy(zero_copy_only=False)
                    sim = np.round(left @ _matrix(part.column("vector"), width).T, decimals)
                    good = (sim >= least[:, None]) & (asked[:, None] != names[None, :])
                    if groups is not None:
                        good &= allow(groups, part.column("group").to_numpy(zero_copy_only=False))
                    hit, at = np.nonzero(good)
                    query, ids, sims = np.concatenate([query, hit]), np.concatenate([ids, names[at].astype(object)]), np.concatenate([sims, sim[hit, at]])
                    keep = _best(query, ids, sims, k) if len(query) else np.zeros(0, np.int64)
                    query, ids, sims = query[keep], ids[keep], sims[keep]
                    full = np.flatnonzero(np.bincount(query, minlength=len(asked)) == k)
                    if len(full):
                        last = np.searchsorted(query, full, "right") - 1
                        least[full] = np.maximum(least[full], sims[last])
            yield pa.RecordBatch.from_arrays([pa.array(asked[query], asked_kind), pa.array(ids.tolist(), kind), pa.array(sims)], names=["q", "c", "sim"])

        found = rows.mapInArrow(run, schema)
        if blocks == 1:
            parts.append(found)
        else:
            folder = folder or f"{shared_folder(spark)}/search-{id(held)}-{i}-{spark.sparkContext.startTime}"
            found.write.mode("overwrite").parquet(f"{folder}/block={i}")
            held.unpersist()
    out = parts[0] if parts else spark.read.parquet(folder).drop("block")
    order = Window.partitionBy("q").orderBy(F.desc("sim"), "c")
    return out.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= k)


def pair_similarities(pairs: DataFrame, queries: DataFrame, corpus: DataFrame, decimals: int = 6) -> DataFrame:
    """(q, c, sim) of the given pairs."""
    from cairnlink.functions.similarity import dot

    one, two = queries.select(F.col("id").alias("q"), F.col("vector").alias("_a")), corpus.select(F.col("id").alias("c"), F.col("vector").alias("_b"))
    return pairs.select("q", "c").distinct().where("q <> c").join(one, "q").join(two, "c").select("q", "c", F.round(dot(F.col("_a"), F.col("_b")), decimals).alias("sim"))


def count_above(marks: DataFrame, queries: DataFrame, corpus: DataFrame, decimals: int = 6, block: int = QUERY_BLOCK) -> DataFrame:
    """(q, above): how many rows of the corpus but the query itself come before (sim, c) of the query's row in ``marks`` (q, c, sim)."""
    spark = queries.sparkSession
    asked = queries.join(marks.select(F.col("q").alias("id"), "c", F.col("sim").alias("mark")), "id").select("id", "vector", "c", "mark")
    rows, kind, folder, parts = corpus.select("id", "vector").where("id is not null and vector is not null"), to_arrow_type(queries.schema["id"].dataType), None, []
    for i, blocks, mine in _blocks(asked, block):
        width = max((len(x) for x in mine.column("vector").to_pylist()), default=0)
        left = _matrix(mine.column("vector").combine_chunks(), width) if mine.num_rows else np.zeros((0, 0))
        held = spark.sparkContext.broadcast((mine.column("id").to_pylist(), left, mine.column("c").to_pylist(), np.array(mine.column("mark").to_pylist(), float), width))

        def run(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            names, left, ties, mark, width = held.value
            total, own, ties = np.zeros(len(names), np.int64), np.array(names), np.array(ties)
            for batch in batches:
                for low in range(0, batch.num_rows if len(names) else 0, _ROWS):
                    part = batch.slice(low, _ROWS)
                    ids = np.array(part.column("id").to_pylist())
                    sim = np.round(left @ _matrix(part.column("vector"), width).T, decimals)
                    before = (sim > mark[:, None]) | ((sim == mark[:, None]) & (ids[None, :] < ties[:, None]))
                    total += (before & (own[:, None] != ids[None, :])).sum(1)
            yield pa.RecordBatch.from_arrays([pa.array(names, kind), pa.array(total)], names=["q", "above"])

        found = rows.mapInArrow(run, f"q {queries.schema['id'].dataType.simpleString()}, above long")
        if blocks == 1:
            parts.append(found)
        else:
            folder = folder or f"{shared_folder(spark)}/above-{id(held)}-{i}-{spark.sparkContext.startTime}"
            found.write.mode("overwrite").parquet(f"{folder}/block={i}")
            held.unpersist()
    out = parts[0] if parts else spark.read.parquet(folder).drop("block")
    return out.groupBy("q").agg(F.sum("above").alias("above"))
