"""Mixing sources to target weights by balanced (cube) sampling."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlink.llm.shared import cut, number_rows

BLOCK_ROWS = 1024
LANDING_ROWS = 10
HELD_ROWS = 12
_CLOSE = 1e-9


def source_targets(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: float = 3.0, source_column: str = "source", size_column: str = "size") -> DataFrame:
    """One row for each source: its size, weight and target; the targets share the total size by weight.

    Sources in code point order (null last) take the weights in turn. A target stops at ``most`` times its source's
    size; the excess goes to the others by weight until none is above. The table has a row for each source and stays
    distributed; each step of the sharing is one aggregate over it. Sources without size get target 0.
    """
    sums = docs.groupBy(F.col(source_column).alias("source")).agg(F.sum(F.col(size_column)).cast("long").alias("source_size"))
    ranked = number_rows(sums, [F.col("source").isNull(), F.col("source")], "source_no")
    cycle = F.element_at(F.array(*[F.lit(float(w)) for w in weights]), (F.col("source_no") % len(weights) + 1).cast("int"))
    ranked = cut(ranked.withColumns({"weight": cycle, "most": F.col("source_size") * float(most)}))
    total = ranked.agg(F.sum("source_size")).first()[0] or 0
    level, capped = 0.0, -1
    while True:  # every round caps one more source at least, mostly many; it ends when a round caps none
        is_capped = F.col("weight") * level >= F.col("most")
        free, fixed, count = ranked.agg(F.sum(F.when(~is_capped, F.col("weight"))), F.sum(F.when(is_capped, F.col("most"))), F.count(F.when(is_capped, 1))).first()
        if count == capped or not free:
            break
        capped, level = count, (total - (fixed or 0.0)) / free
    return ranked.select("source", "source_size", "source_no", "weight", F.least(F.col("weight") * level, "most").alias("target"))


def flight(share: np.ndarray, size: np.ndarray, order: np.ndarray, draws: np.ndarray) -> np.ndarray:
    """Move inclusion probabilities until two at most lie strictly between 0 and 1.

    A dozen rows are in the air at a time. Each move is along the vector of the null space of both balancing
    constraints (number of rows, total size) that lies nearest to the first row's own axis, one way or the other up to the
    first 0 or 1. Which way is drawn with the probabilities that keep every row's expected value: way ``up`` with
    down / (up + down). Both totals are kept. Rows fly with others about as long, so if long rows come first, short ones
    are left over.
    """
    share = share.astype(float).copy()
    coming = [int(i) for i in order if _CLOSE < share[i] < 1 - _CLOSE][::-1]
    held: list[int] = []
    for draw in draws:
        while coming and len(held) < HELD_ROWS:
            held.append(coming.pop())
        if len(held) < 2:
            break
        sizes, now = size[held].astype(float), share[held]
        apart = sizes - sizes.mean()
        spread = float(apart @ apart)
        free = 1.0 - 1.0 / len(held) - (apart * apart / spread if spread else 0.0 * apart)
        lead = int(np.argmax(free > 1e-6))
        if free[lead] <= 1e-6:  # two rows of different size: nothing can move
            break
        along = -1.0 / len(held) - (apart * apart[lead] / spread if spread else 0.0 * apart)
        along[lead] += 1.0
        along[np.abs(along) < _CLOSE] = 0.0
        with np.errstate(divide="ignore"):
            to_one, to_zero = (1 - now) / np.abs(along), now / np.abs(along)
        up, down = np.where(along > 0, to_one, to_zero).min(), np.where(along > 0, to_zero, to_one).min()
        now = now + (up if draw * (up + down) < down else -down) * along
        ends = (now <= 1e-7) | (now >= 1 - 1e-7)
        share[held] = np.where(ends, np.round(now), now)
        held = [x for x, ended in zip(held, ends) if not ended]
    return share


def land(share: np.ndarray, size: np.ndarray) -> np.ndarray:
    """Round the few rows still in doubt so that both totals end nearest to those asked for; every choice is tried."""
    left = np.flatnonzero((share > _CLOSE) & (share < 1 - _CLOSE))
    out = share.copy()
    if len(left):
        picks = (np.arange(1 << len(left))[:, None] >> np.arange(len(left))) & 1
        off_size = np.abs(picks @ size[left] - share[left] @ size[left]) / max(1.0, float(size[left].mean()))
        out[left] = picks[np.argmin(off_size + np.abs(picks.sum(1) - share[left].sum()))]
    return np.round(out)


def _round(rows: DataFrame, group: list[Column], seed: int, last: bool) -> DataFrame:
    """One flight in every group; in the last round also the landing."""

    def fly(part: pa.Table) -> pa.Table:
        share, size, id_ = (part.column(c).to_numpy() for c in ("share", "size", "row_no"))
        order = np.lexsort((id_, -size))  # long rows first: what is left to land is short
        draws = np.frombuffer(b"".join(hashlib.blake2b(f"{seed}:{i}".encode(), digest_size=8).digest() for i in id_[order]), "<u8") / 2.0**64
        fliers = max(0, len(order) - LANDING_ROWS)
        moved = flight(share, size, order[:fliers], draws)
        if last:
            moved = land(moved, size)
        return part.set_column(part.schema.get_field_index("share"), "share", pa.array(moved))

    names = [f"_g{i}" for i in range(len(group))]
    schema = rows.schema
    grouped = rows.withColumns(dict(zip(names, group)))
    return grouped.groupBy(*names).applyInArrow(lambda t: fly(t.select(schema.names)), schema)


def mix(docs: DataFrame, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, seed: int = 1618033, id_column: str = "doc_id", source_column: str = "source", size_column: str = "size", content: tuple[str, ...] = ()) -> DataFrame:
    """Say how often each row is taken so that sources reach their targets; adds source_size, target and copies.

    A source with target T and size S takes each row floor(T/S) times for certain and once more with probability
    frac(T/S). Those inclusion probabilities go through the cube method: balancing constraints are the number of rows
    and their total size. Blocks of ``BLOCK_ROWS`` rows fly on their own, each source apart, which leaves two rows in
    doubt beside the ``LANDING_ROWS`` shortest, held back; those of many blocks fly again together, by up to
    ``BLOCK_ROWS`` at a time, until a source fits one block. There the last dozen rows land: every choice among them is
    tried and the one nearest to both totals taken. So no group is ever larger than a block, and a source's taken
    size is off by a few words, or by up to its longest row where a few long rows make up much of it.

    Rows are numbered by source, then a hash of (seed, id, ``content``): reruns agree. A null size counts as 0;
    null sources form one source; repeated rows are rows of their own; an empty table gives an empty result. A row as long
    as its source's target, or longer, makes the source miss it by up to that row's length. Columns named source_size,
    target or copies are replaced; all others stay, but names that begin with an underscore are the operator's own.
    """
    docs = docs.withColumn(size_column, F.coalesce(F.col(size_column), F.lit(0)).cast("long")).drop("source_size", "target", "copies")
    targets = cut(source_targets(docs, weights, most, source_column, size_column))
    sources = _by_size(targets.select(F.col("source").alias("_source"), F.col("source_no").alias("_source_no"), "source_size", "target"))
    joined = docs.join(sources, F.col(f"`{source_column}`").eqNullSafe(F.col("_source"))).drop("_source")
    numbered = number_rows(joined, [F.col("_source_no"), F.xxhash64(F.lit(seed), id_column, *content), F.col(id_column)], "_row_no")
    ratio = F.when(F.col("source_size") > 0, F.col("target") / F.col("source_size")).otherwise(0.0)
    sure = F.floor(ratio + _CLOSE)
    numbered = cut(numbered.withColumns({"_sure": sure, "_share": F.greatest(ratio - sure, F.lit(0.0))}))
    doubt = numbered.where(F.col("_share") > _CLOSE).select(F.col("_row_no").alias("row_no"), F.col("_source_no").alias("source_no"), F.col(size_column).alias("size"), F.col("_share").alias("share"))
    settled, span, level = None, numbered.count(), BLOCK_ROWS
    while True:
        whole = level >= 2 * max(span, 1)
        key = [F.col("source_no")] if whole else [F.col("source_no"), F.expr(f"row_no div {level}")]
        flown = cut(_round(doubt, key, seed + level, whole))
        open_ = (F.col("share") > _CLOSE) & (F.col("share") < 1 - _CLOSE)
        done = flown.where(~open_).select(F.col("row_no").alias("_row_no"), F.col("share").cast("long").alias("_once"))
        settled = done if settled is None else settled.unionByName(done)
        if whole:
            break
        doubt, level = flown.where(open_), level * (BLOCK_ROWS // (LANDING_ROWS + 6))
    return numbered.join(settled, "_row_no", "left").withColumn("copies", F.col("_sure") + F.coalesce("_once", F.lit(0))).drop("_sure", "_share", "_once", "_source_no", "_row_no")


def _by_size(targets: DataFrame, rows: int = 100_000) -> DataFrame:
    """The table of sources, broadcast if it has ``rows`` rows at most."""
    return F.broadcast(targets) if targets.limit(rows + 1).count() <= rows else targets


def remix(docs: DataFrame, size: Column, weights: tuple[float, ...] = (5, 2, 1), most: int = 3, id_column: str = "doc_id", source_column: str = "source", text_column: str = "text") -> DataFrame:
    """``docs`` as mixed: each row as often as ``mix`` says. Only ids, sources and sizes are sorted; texts are joined once."""
    hash_ = F.xxhash64(F.col(text_column), F.col(source_column), F.col(id_column))
    slim = docs.select(F.col(id_column), F.col(source_column), size.alias("size"), hash_.alias("_hash"))
    mixed = mix(slim, weights, most, id_column=id_column, source_column=source_column, content=("_hash",))
    copies = mixed.groupBy(F.col("_hash").alias("_row")).agg(F.sum("copies").alias("_copies"), F.count(F.lit(1)).alias("_rows"))
    joined = docs.withColumn("_hash", hash_).join(copies, F.col("_hash") == F.col("_row"))
    if not copies.where("_rows > 1").isEmpty():  # equal rows share their copies: the first takes what does not divide
        joined = joined.withColumn("_n", F.row_number().over(Window.partitionBy("_hash").orderBy("_row")))
        joined = joined.withColumn("_copies", F.expr("_copies div _rows + cast(_n <= _copies % _rows as long)"))
    return take(joined.select(*docs.columns, "_copies"), "_copies")


def take(docs: DataFrame, copies: str = "copies") -> DataFrame:
    """Each row as often as ``copies`` says; the column goes."""
    return docs.where(F.col(copies) > 0).withColumn(copies, F.explode(F.sequence(F.lit(1).cast("long"), F.col(copies)))).drop(copies)
