"""Sharding by a keyed permutation of global row numbers (DataFrame functions only)."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlink.llm.shared import number_rows, with_permuted


def shard_rows(df: DataFrame, shards: int, key: int = 2718281828, content: tuple[str, ...] = ("doc_id", "text")) -> DataFrame:
    """Deal all rows into ``shards`` shards whose row counts differ by one at most; add row_no, shard and slot.

    Rows get a global number in the order of a 64-bit hash of ``content`` (ties by its first column, then arbitrary
    among rows that agree in all of it), a Feistel permutation with cycle walking shuffles 0..n-1, and the
    permuted number p gives shard = p mod shards and slot = p div shards. So slots are gapless from 0, the shuffle
    is reproducible from (content, key) alone, and ``locate`` finds shard and slot of any row number, and
    ``row_of`` the reverse, without reading data.

    Nulls count as values of their own, repeated rows get a slot each, an empty table gives an empty result.
    Texts of any length are hashed whole. Columns named row_no, shard or slot are replaced, all others stay (names that
    begin with an underscore are the operator's own). Only numbers are shuffled if ``df`` has no other columns.
    """
    df = df.drop("row_no", "shard", "slot")
    numbered = number_rows(df, [F.xxhash64(*content), F.col(content[0])])
    n = numbered.count()
    return locate(numbered, n, shards, key)


def locate(numbered: DataFrame, n: int, shards: int, key: int) -> DataFrame:
    """Add shard and slot to rows that carry row_no, for a table of n rows."""
    placed = with_permuted(numbered, "row_no", n, key, "_p")
    return placed.withColumns({"shard": F.pmod("_p", F.lit(shards)).cast("int"), "slot": F.expr(f"_p div {shards}")}).drop("_p")


def row_of(places: DataFrame, n: int, shards: int, key: int) -> DataFrame:
    """Add row_no to rows that carry shard and slot, for a table of n rows."""
    return with_permuted(places.withColumn("_p", F.col("slot") * shards + F.col("shard")), "_p", n, key, "row_no", inverse=True).drop("_p")
