"""Benchmark decontamination by spaced seeds and substitution-tolerant verification."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from cairnlink.llm.shared import new_folder
from cairnlink.llm.tokens import ALNUM, find_words, mix, sliced

#: A hit of any of these masks (# compares, - ignores) is certain in 20 words with up to 4 substituted.
MASKS = ["####-##", "###-#---##", "###-###"]
#: The same for items of 8 to 19 words with up to a fifth substituted.
SHORT_MASKS = ["####", "##-##", "#-###", "###-#"]
SPAN = 20
SHORTEST_TOLERANT = 8
BLOCK_WORDS = 500_000
_STEP = np.uint64(0xC2B2AE3D27D4EB4F)


def allowed(span: np.ndarray) -> np.ndarray:
    """Substitutions allowed in overlaps of so many words."""
    return np.where(span >= SHORTEST_TOLERANT, span // 5, 0)


def masked_hashes(hashes: np.ndarray, mask: str) -> np.ndarray:
    n = len(hashes) - len(mask) + 1
    if n <= 0:
        return np.zeros(0, np.uint64)
    out = np.full(n, len(mask), np.uint64)
    for at, kind in enumerate(mask):
        if kind == "#":
            out = out * _STEP + hashes[at : at + n]
    return mix(out)


def _masks_of(words: int) -> list[str]:
    if words >= SPAN:
        return MASKS
    return SHORT_MASKS if words >= SHORTEST_TOLERANT else ["#" * min(4, words)]


@dataclass
class Seeds:
    """Masked hashes of one block of benchmark items: by mask, sorted, with item and place."""

    ids: list
    words: np.ndarray
    first: np.ndarray
    by_mask: dict[str, tuple[np.ndarray, np.ndarray, np.ndarray]]
    likely: dict[str, np.ndarray]

    @classmethod
    def of(cls, items: list[tuple[object, str | None]]) -> Seeds:
        found = find_words(pa.array([text for _, text in items], pa.string()), ALNUM, lower=True)
        hashes = found.hashes()
        parts: dict[str, list] = {}
        for item, (low, high) in enumerate(zip(found.first[:-1], found.first[1:])):
            for mask in _masks_of(high - low) if high > low else ():
                seeds = masked_hashes(hashes[low:high], mask)
                parts.setdefault(mask, []).append((seeds, np.full(len(seeds), item), np.arange(len(seeds))))
        by_mask, likely = {}, {}
        for mask, pieces in parts.items():
            seeds, item, at = (np.concatenate(x) for x in zip(*pieces))
            order = np.argsort(seeds, kind="stable")
            by_mask[mask] = (seeds[order], item[order], at[order])
            likely[mask] = np.zeros(1 << 20, bool)
            likely[mask][seeds >> np.uint64(44)] = True
        return cls([i for i, _ in items], hashes, found.first, by_mask, likely)


def _ragged(low: np.ndarray, size: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """All of low[i] .. low[i]+size[i]-1 in a row, and the i of each."""
    owner = np.repeat(np.arange(len(low)), size)
    return np.arange(len(owner)) - np.repeat(np.cumsum(size) - size, size) + low[owner], owner


def _portions(size: np.ndarray, most: int) -> list[tuple[int, int]]:
    """Stretches whose sizes add up to ``most`` at most, one value at least."""
    total, out, at = np.cumsum(size), [], 0
    while at < len(size):
        to = max(at + 1, int(np.searchsorted(total, (total[at - 1] if at else 0) + most, "right")))
        out.append((at, to))
        at = to
    return out


def overlaps(texts: pa.Array, seeds: Seeds) -> list[list[dict]]:
    """For each text the items it overlaps: one entry for an item, with the widest span of words that counts."""
    found = find_words(texts, ALNUM, lower=True)
    hashes, doc = found.hashes(), found.doc
    spans: list[dict[int, dict]] = [{} for _ in range(len(texts))]
    lanes: list[np.ndarray] = []
    for mask, (keys, item, at) in seeds.by_mask.items():
        here = masked_hashes(hashes, mask)
        hit = np.flatnonzero(seeds.likely[mask][here >> np.uint64(44)])
        hit = hit[doc[hit] == doc[hit + len(mask) - 1]]
        low, high = np.searchsorted(keys, here[hit], "left"), np.searchsorted(keys, here[hit], "right")
        for a, b in _portions(high - low, 200_000):  # however often a seed stands in the benchmark
            entry, owner = _ragged(low[a:b], (high - low)[a:b])
            place = hit[a:b][owner]
            lanes.append(np.unique(np.stack([item[entry], place - at[entry], doc[place]], 1), axis=0))
    if not lanes or not sum(map(len, lanes)):
        return [[] for _ in spans]
    item, start, text = np.unique(np.concatenate(lanes), axis=0).T
    for a in range(0, len(item), 20_000):  # a lane: one item laid over one text with one offset
        i, s, d = item[a : a + 20_000], start[a : a + 20_000], text[a : a + 20_000]
        length = (seeds.first[i + 1] - seeds.first[i]).astype(np.int64)
        low, high = np.maximum(0, found.first[d] - s), np.minimum(length, found.first[d + 1] - s)
        span = np.minimum(SPAN, length)
        fits = high - low >= span
        i, s, d, low, high, span = (x[fits] for x in (i, s, d, low, high, span))
        place, owner = _ragged(low, high - low)
        same = hashes[s[owner] + place] == seeds.words[seeds.first[i[owner]] + place]
        total = np.append(0, np.cumsum(same))
        end = np.cumsum(high - low)
        index = np.arange(len(place))
        whole = index + span[owner] <= end[owner]
        index = index[whole]
        width = span[owner[index]]
        good = index[total[index + width] - total[index] >= width - allowed(width)]
        if not len(good):
            continue
        lane, from_ = np.unique(owner[good], return_index=True)
        to = np.append(from_[1:], len(good)) - 1
        for x, one, two in zip(lane.tolist(), good[from_].tolist(), good[to].tolist()):
            two += int(span[x])
            entry = {"first": int(s[x] + place[one] - found.first[d[x]]), "end": int(s[x] + place[two - 1] + 1 - found.first[d[x]]), "matched": int(total[two] - total[one])}
            old = spans[d[x]].get(int(i[x]))
            if old is None or (entry["matched"], -entry["first"]) > (old["matched"], -old["first"]):
                spans[d[x]][int(i[x])] = entry
    return [[{"item_id": seeds.ids[i], **x[i]} for i in sorted(x)] for x in spans]


def mark_overlaps(docs: DataFrame, benchmark: DataFrame, text_column: str = "text", item_column: str = "item_id", item_text: str = "text", block_words: int = BLOCK_WORDS) -> DataFrame:
    """Add ``overlaps``: for each benchmark item that the text overlaps its id and the words first..end-1 that match.

    Words are lower-cased runs of letters, digits and non-ASCII characters. An overlap is a stretch of ``SPAN`` words, laid
    word by word over the item, of which at most a fifth differ; an item shorter than that must be there as a whole, one
    under 8 words without a difference. Masks that ignore some places find them all: whatever up to a fifth of
    the words is substituted, one mask hits. Every text and item is compared in full, however long.

    The benchmark is taken in blocks of about ``block_words`` words. One block's seeds are broadcast at a time: if there
    are several, each one's hits, by the hash of the text, are written to the shared folder before the next is sent, and
    all are joined to ``docs`` in the end. So what a task and the driver hold is bounded whatever the benchmark's size.

    A null or empty text or item overlaps nothing; items with equal texts are all listed, as are items with a null id; ids
    of items keep their type; repeated rows are marked alike; empty tables are fine. A column ``overlaps`` of the caller is
    replaced; all others stay.
    """
    spark = docs.sparkSession
    docs = docs.drop("overlaps")
    kind = benchmark.schema[item_column].dataType
    items = benchmark.where(F.col(item_text).isNotNull()).select(F.col(item_column).alias("id"), F.col(item_text).cast("string").alias("text"))
    words = items.agg(F.sum(F.size(F.split("text", r"\s+")))).first()[0] or 0
    blocks = max(1, -(-words // block_words))
    entry = pa.list_(pa.struct([("item_id", to_arrow_type(kind)), ("first", pa.int64()), ("end", pa.int64()), ("matched", pa.int64())]))
    named = f"overlaps array<struct<item_id:{kind.simpleString()},first:long,end:long,matched:long>>"

    def seeds_of(block: int):
        part = items.where(F.pmod(F.xxhash64("id", "text"), F.lit(blocks)) == block).orderBy("id", "text").collect()
        return spark.sparkContext.broadcast(Seeds.of([tuple(r) for r in part]))

    if blocks == 1:
        held = seeds_of(0)

        def mark(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches, text_column):
                yield batch.append_column("overlaps", pa.array(overlaps(batch.column(text_column).cast(pa.large_string()), held.value), entry))

        schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
        return docs.mapInArrow(mark, f"{schema}, {named}")

    hash_ = [F.xxhash64(F.col(f"`{text_column}`")), F.xxhash64(F.lit(1), F.col(f"`{text_column}`"))]
    slim = docs.select(F.col(f"`{text_column}`").cast("string").alias("text"), hash_[0].alias("_one"), hash_[1].alias("_two"))
    folder = new_folder(spark, "overlaps")
    for block in range(blocks):
        held = seeds_of(block)

        def hits(batches: Iterator[pa.RecordBatch], held=held) -> Iterator[pa.RecordBatch]:
            for batch in sliced(batches):
                found = overlaps(batch.column("text").cast(pa.large_string()), held.value)
                picks = pa.array([i for i, x in enumerate(found) if x], pa.int64())
                yield batch.drop_columns(["text"]).take(picks).append_column("overlaps", pa.array([x for x in found if x], entry))

        one = slim.mapInArrow(hits, f"_one long, _two long, {named}").groupBy("_one", "_two").agg(F.first("overlaps").alias("overlaps"))
        one.write.parquet(f"{folder}/block={block}")
        held.unpersist()
    found = spark.read.parquet(folder).groupBy("_one", "_two").agg(F.flatten(F.collect_list("overlaps")).alias("overlaps"))
    marked = docs.withColumns({"_1": hash_[0], "_2": hash_[1]}).join(found, (F.col("_1") == F.col("_one")) & (F.col("_2") == F.col("_two")), "left")
    none = F.array().cast(f"array<struct<item_id:{kind.simpleString()},first:long,end:long,matched:long>>")
    return marked.withColumn("overlaps", F.coalesce("overlaps", none)).drop("_1", "_2", "_one", "_two")


def is_clean(overlaps_column: str = "overlaps") -> Column:
    return F.size(overlaps_column) == 0
