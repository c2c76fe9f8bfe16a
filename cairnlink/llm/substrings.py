"""Substring dedup: word windows that repeat are found in buckets of super-k-mers and cut from the later places."""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlink.llm.tokens import NOT_SPACE, Words, find_words, frugal, give_back, mix, sliced, window_hashes

MINIMISER_WORDS = 4
SLOTS = 1 << 16
BUCKET_BYTES = 8 << 20
PIECE_BYTES = 1 << 20
_ODD, _ODD_INVERSE = 0x9E3779B97F4A7C15, pow(0x9E3779B97F4A7C15, -1, 1 << 64)
TASK_BYTES = 32 << 20
_KNOWN_BYTES = 32 << 20  # super-k-mers seen more than once that a task remembers


def _slots(hashes: np.ndarray) -> np.ndarray:
    return (hashes >> np.uint64(48)).astype(np.int64)


def _inside(found: Words, k: int) -> np.ndarray:
    """Which of the len - k + 1 windows of k words lie in one text."""
    doc = found.doc
    return doc[: len(doc) - k + 1] == doc[k - 1 :] if len(doc) >= k else np.zeros(0, bool)


def frequent_slots(docs: DataFrame, minimiser: int = MINIMISER_WORDS) -> tuple[np.ndarray, int]:
    """A bit for each of ``SLOTS`` hash slots: does it hold far more short word sequences than most? And bytes of text.

    Counted over all texts; each task sends at most ``SLOTS`` sums, and at most ``SLOTS`` sums reach the driver.
    """

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums, size = np.zeros(SLOTS, np.int64), 0
        for batch in sliced(batches):
            found = find_words(batch.column("text"), NOT_SPACE)
            size += len(found.data) - 8
            sums += np.bincount(_slots(window_hashes(found.hashes(), minimiser)[_inside(found, minimiser)]), minlength=SLOTS)
        used = np.flatnonzero(sums)
        yield pa.RecordBatch.from_arrays([pa.array(np.append(used, -1)), pa.array(np.append(sums[used], size))], names=["slot", "n"])

    rows = docs.select("text").mapInArrow(frugal(count), "slot long, n long").groupBy("slot").agg(F.sum("n").alias("n")).collect()
    sums, size = np.zeros(SLOTS, np.int64), 0
    for slot, n in rows:
        if slot < 0:
            size = n
        else:
            sums[slot] = n
    return sums > 4 * sums.mean() + 32, size


def _minima(values: np.ndarray, width: int) -> np.ndarray:
    """The least of every ``width`` consecutive values."""
    size = 1
    while 2 * size <= width:
        values = np.minimum(values[:-size], values[size:])
        size *= 2
    return np.minimum(values[: len(values) - (width - size)], values[width - size :]) if width > size else values


def super_kmers(found: Words, k: int, minimiser: int, frequent: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
    """First window, window after, minimiser and word-sequence hash of each run of windows of one text that share it.

    The minimiser of a window is its least short word sequence, in the order (frequent or not, hash): sequences that
    very many texts share come last, so that no bucket gets a large part of all windows.
    """
    hashes = found.hashes()
    nothing = np.zeros(0, np.int64)
    valid = np.flatnonzero(_inside(found, k))
    if not len(valid):
        return nothing, nothing, nothing.astype(np.uint64), nothing.astype(np.uint64)
    short = window_hashes(hashes, minimiser)
    rank = (mix(short) >> np.uint64(1)) | (frequent[_slots(short)].astype(np.uint64) << np.uint64(63))
    least = _minima(rank, k - minimiser + 1)[valid]
    doc = found.doc[valid]
    fresh = np.flatnonzero(np.append(True, (least[1:] != least[:-1]) | (doc[1:] != doc[:-1])))
    first, after = valid[fresh], valid[np.append(fresh[1:], len(valid)) - 1] + 1
    powers = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), _ODD, np.uint64)))
    prefix = np.append(np.uint64(0), np.cumsum(hashes * powers[:-1]))
    back = np.cumprod(np.append(np.uint64(1), np.full(len(hashes), _ODD_INVERSE, np.uint64)))
    sequence = mix((prefix[after + k - 1] - prefix[first]) * back[first]) ^ (after - first).astype(np.uint64)
    return first, after, least[fresh], sequence


def _pack(parts: list[bytes]) -> bytes:
    return zstandard.ZstdCompressor(level=1).compress(b"".join(parts))


def _removed(doc: np.ndarray, text: np.ndarray, low: np.ndarray, high: np.ndarray) -> pa.RecordBatch:
    """Word ranges to remove, one row for each document."""
    order = np.lexsort((low, text, doc))
    doc, text, low, high = doc[order], text[order], low[order], high[order]
    fresh = np.flatnonzero(np.append(True, (doc[1:] != doc[:-1]) | (text[1:] != text[:-1]))) if len(doc) else np.zeros(0, np.int64)
    ends = np.append(fresh[1:], len(doc)).astype(np.int64)
    ranges = [np.stack([low[a:b], high[a:b]], 1).astype("<i4").tobytes() for a, b in zip(fresh, ends)]
    return pa.RecordBatch.from_arrays([pa.array(doc[fresh]), pa.array(text[fresh]), pa.array(ranges, pa.binary())], names=["doc", "text_hash", "ranges"])


def _scatter(k: int, minimiser: int, frequent: np.ndarray, buckets: int):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        known: dict[int, tuple] = {}
        likely, held = np.zeros(1 << 16, bool), 0  # slots of known sequences, bytes of their strings
        for batch in sliced(batches):
            found = find_words(batch.column("text"), NOT_SPACE)
            ids, texts = batch.column("doc").to_numpy(), batch.column("text_hash").to_numpy()
            first, after, least, sequence = super_kmers(found, k, minimiser, frequent)
            if not len(first):
                continue
            doc = found.doc[first]
            at = first - found.first[doc]
            place = np.lexsort((at, texts[doc], ids[doc], sequence))
            first, after, least, sequence, doc, at = (x[place] for x in (first, after, least, sequence, doc, at))
            raw = memoryview(found.data)
            low, high = found.start[first], found.end[after + k - 2]
            send = np.ones(len(first), bool)
            twice = np.append(sequence[1:] == sequence[:-1], False)
            twice[1:] |= twice[:-1].copy()
            for i in np.flatnonzero(twice | likely[_slots(sequence)]):  # equal strings: only the first place travels
                key = int(sequence[i])
                old = known.get(key)
                if old is None and not twice[i]:
                    continue
                mine = (int(ids[doc[i]]), int(texts[doc[i]]), int(at[i]))
                body = raw[low[i] : high[i]]
                if old is not None and (old[1] == body or old[1].split() == bytes(body).split()) and old[0] != mine:
                    if old[0] < mine:
                        send[i] = False
                        continue
                if held >= _KNOWN_BYTES:
                    known.clear()
                    likely[:], held = False, 0
                held += 0 if old is not None else len(body) + 200
                known[key], likely[key >> 48] = (mine, bytes(body)), True
            if not send.all():
                gone = np.flatnonzero(~send)
                row = _removed(ids[doc[gone]], texts[doc[gone]], at[gone], at[gone] + after[gone] - first[gone] + k - 1)
                if row.num_rows:  # copies have one text hash: the id spreads them
                    key = -1 - (mix(row.column("text_hash").to_numpy().view(np.uint64) ^ mix(row.column("doc").to_numpy().astype(np.uint64))) % np.uint64(buckets)).astype(np.int64)
                    blank = pa.array([None] * row.num_rows, pa.binary())
                    yield pa.RecordBatch.from_arrays([pa.array(key), row.column("doc"), row.column("text_hash"), row.column("ranges"), blank], names=["bucket", "doc", "text_hash", "ranges", "packed"])
            bucket = (mix(least + np.uint64(1)) % np.uint64(buckets)).astype(np.int64)
            order = np.flatnonzero(send)[np.argsort(bucket[send], kind="stable")]
            cuts = np.flatnonzero(np.append(True, np.diff(bucket[order]) != 0)) if len(order) else np.zeros(0, np.int64)
            rows = []
            for a, b in zip(cuts, np.append(cuts[1:], len(order))):
                pick = order[a:b]
                head = np.stack([ids[doc[pick]], texts[doc[pick]], at[pick], after[pick] - first[pick] + k - 1], 1).astype("<i8")
                rows.append(_pack([len(pick).to_bytes(8, "little"), head.tobytes(), b" ".join(raw[x:y] for x, y in zip(low[pick].tolist(), high[pick].tolist()))]))
            none = [None] * len(rows)
            yield pa.RecordBatch.from_arrays(
                [pa.array(bucket[order[cuts]]), pa.array(none, pa.int64()), pa.array(none, pa.int64()), pa.array(none, pa.binary()), pa.array(rows, pa.binary())], names=["bucket", "doc", "text_hash", "ranges", "packed"]
            )

    return run


def _later(raw: memoryview, keys: np.ndarray, place: np.ndarray, low: np.ndarray, high: np.ndarray) -> np.ndarray:
    """Which of the windows (in the order of their places) stand at an earlier place too. Compares words, not hashes alone.

    ``keys`` are hashes of their words, ``low`` and ``high`` their bytes; ``place`` grows by one from a window to the next of its string.
    """
    order = np.argsort(keys, kind="stable")
    fresh = keys[order]
    fresh = np.append(True, fresh[1:] != fresh[:-1])
    earliest = np.empty(len(keys), np.int64)
    earliest[order] = order[np.maximum.accumulate(np.where(fresh, np.arange(len(keys)), 0))]
    del order, fresh
    later = earliest != np.arange(len(keys))
    hit = np.flatnonzero(later)
    if not len(hit):
        return later
    first = earliest[hit]
    del earliest
    cuts = np.flatnonzero(np.append(True, (np.diff(place[hit]) != 1) | (np.diff(place[first]) != 1)))
    for a, b in zip(cuts.tolist(), np.append(cuts[1:], len(hit)).tolist()):
        one, two = (raw[low[x[a]] : high[x[b - 1]]] for x in (hit, first))
        if one != two and bytes(one).split() != bytes(two).split():  # two sequences of one hash: compare each in full
            whole = {}
            for i in np.flatnonzero(np.isin(keys, keys[hit[a:b]])):
                whole.setdefault(tuple(bytes(raw[low[i] : high[i]]).split()), []).append(i)
            for same in whole.values():
                later[same[0]], later[same[1:]] = False, True
    return later


def _pieces(packed: pa.ChunkedArray, most: int = PIECE_BYTES) -> Iterator[tuple[np.ndarray, bytes]]:
    """Heads and strings of packed rows, several rows at once up to about ``most`` bytes of strings."""
    open_ = zstandard.ZstdDecompressor()
    heads, bodies, held = [], [], 0
    for row in packed:
        row = open_.decompress(row.as_py())
        n = int.from_bytes(row[:8], "little")
        heads.append(np.frombuffer(row, "<i8", 4 * n, 8).reshape(n, 4).copy())
        bodies.append(row[8 + 32 * n :])
        held += len(bodies[-1])
        if held >= most:
            yield np.concatenate(heads), b" ".join(bodies)
            heads, bodies, held = [], [], 0
    if heads:
        yield np.concatenate(heads), b" ".join(bodies)


def _spans(sizes: np.ndarray, rows: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Each of ``rows`` as often as its size says, and a count from 0 within it."""
    many = sizes[rows]
    return np.repeat(rows, many), np.arange(many.sum()) - np.repeat(np.cumsum(many) - many, many)


def _gather(k: int):
    """Repeated windows of one bucket. Words are told apart piece by piece; of all the bucket only strings and windows are held."""

    def run(part: pa.Table) -> pa.Table:
        done = part.filter(pa.compute.is_null(part.column("packed"))).select(["doc", "text_hash", "ranges"])
        heads, keys, lows, highs, text = [], [], [], [], bytearray()
        for head, body in _pieces(part.column("packed").drop_null()):
            found = find_words(pa.array([body], pa.large_binary()).cast(pa.large_string(), safe=False), NOT_SPACE)
            size = head[:, 3]
            owner, offset = _spans(size - k + 1, np.arange(len(head)))
            first = (np.cumsum(size) - size)[owner] + offset
            heads.append(head)
            keys.append(window_hashes(found.hashes(), k)[first])
            lows.append(found.start[first] + len(text))
            highs.append(found.end[first + k - 1] + len(text))
            text += body
        if not heads:
            return done
        head, keys, lows, highs = (np.concatenate(x) for x in (heads, keys, lows, highs))
        del heads
        order = np.lexsort((head[:, 2], head[:, 1], head[:, 0]))
        order = order[np.append(True, (head[order[1:], :3] != head[order[:-1], :3]).any(1))]  # repeated rows are one document
        windows = head[:, 3] - k + 1
        owner, offset = _spans(windows, order)
        at = (np.cumsum(windows) - windows)[owner] + offset
        hit = np.flatnonzero(_later(memoryview(text), keys[at], at + owner, lows[at], highs[at]))
        if len(hit):
            fresh = np.flatnonzero(np.append(True, (np.diff(hit) != 1) | (np.diff(owner[hit]) != 0)))
            last = hit[np.append(fresh[1:], len(hit)) - 1]
            mine, low = owner[hit[fresh]], offset[hit[fresh]]
            row = _removed(head[mine, 0], head[mine, 1], head[mine, 2] + low, head[mine, 2] + offset[last] + k)
            done = pa.concat_tables([done, pa.Table.from_batches([row])])
        if len(text) >= BUCKET_BYTES:
            del head, keys, lows, highs, owner, offset, at, hit, text
            give_back()
        return done

    return run


def repeated_ranges(docs: DataFrame, k: int = 20, minimiser: int = MINIMISER_WORDS, bucket_bytes: int = BUCKET_BYTES) -> DataFrame:
    """Rows (doc, text_hash, ranges): word ranges, as pairs of 32-bit numbers, of windows of k words that repeat an earlier one.

    ``docs`` has doc (the id; null is the least), text_hash and text. Consecutive windows with one minimiser travel as one
    string to the minimiser's bucket; there a sort puts equal windows together, the first place ahead. A string that
    a task has sent before goes only once. The numbers of buckets and of tasks follow the size of the texts.
    """
    frequent, size = frequent_slots(docs, minimiser)
    buckets = max(1, -(-3 * size // bucket_bytes), int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")))
    sent = docs.mapInArrow(frugal(_scatter(k, minimiser, frequent, buckets)), "bucket long, doc long, text_hash long, ranges binary, packed binary")
    tasks = max(int(docs.sparkSession.conf.get("spark.sql.shuffle.partitions")), -(-3 * size // TASK_BYTES))
    return sent.repartition(tasks, "bucket").groupBy("bucket").applyInArrow(lambda part: _gather(k)(part), "doc long, text_hash long, ranges binary")


def cut_repeats(docs: DataFrame, k: int = 20, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Remove every word covered by a window of k words that also starts earlier; adds n_words, n_removed, removed, kept_text.

    Earlier: in a row with a smaller id, or in the same row further to the left. Windows are judged on the input. Words
    are maximal runs of other characters than space and the controls 9 to 13; kept_text has the kept ones joined by
    one space. ``removed`` lists the removed word ranges (first, word after). The text column itself is dropped.

    Null and empty texts have no words, texts under k words no window. A null id counts as smaller than all others.
    Rows of one id with different texts count as different rows, ordered by a hash of the text; rows that agree in
    id and text are one document and are treated alike. Very long texts go through whole. Ids that are no integers are
    read as such where they can be and count as null else. An empty table gives an empty result. Columns named n_words,
    n_removed, removed or kept_text are replaced; all others stay.
    """
    spare = [c for c in docs.columns if c not in (text_column, "n_words", "n_removed", "removed", "kept_text")]
    ready = docs.select(*[F.col(f"`{c}`") for c in spare], F.coalesce(F.expr(f"try_cast(`{id_column}` as bigint)"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(text_column).alias("_hash"), F.col(f"`{text_column}`").cast("string").alias("_text"))
    ranges = repeated_ranges(ready.select(F.col("_doc").alias("doc"), F.col("_hash").alias("text_hash"), F.col("_text").alias("text")), k)
    gathered = ranges.groupBy(F.col("doc").alias("_d"), F.col("text_hash").alias("_h")).agg(F.collect_list("ranges").alias("_ranges"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press = zstandard.ZstdCompressor(level=3)
        for batch in sliced(batches, "_text"):
            small = [None if x is None else press.compress(x.encode()) for x in batch.column("_text").to_pylist()]
            yield batch.drop_columns(["_text"]).append_column("_packed", pa.array(small, pa.binary()))

    kept_schema = ", ".join(f"`{c}` {docs.schema[c].dataType.simpleString()}" for c in spare)
    packed = ready.mapInArrow(frugal(pack), f"{kept_schema}, _doc long, _hash long, _packed binary")
    joined = packed.join(gathered, (F.col("_doc") == F.col("_d")) & (F.col("_hash") == F.col("_h")), "left").drop("_doc", "_hash", "_d", "_h")

    def keep(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_ = zstandard.ZstdDecompressor()
        for whole in batches:
            for low in range(0, whole.num_rows, 500):
                batch = whole.slice(low, 500)
                columns = {"n_words": [], "n_removed": [], "removed": [], "kept_text": []}
                for text, ranges in zip(batch.column("_packed").to_pylist(), batch.column("_ranges").to_pylist()):
                    words = open_.decompress(text).split() if text else []
                    gone = np.zeros(len(words) + 1, np.int32)
                    for a, b in (np.frombuffer(b"".join(ranges), "<i4").reshape(-1, 2).tolist() if ranges else ()):
                        gone[a] += 1
                        gone[b] -= 1
                    cover = np.cumsum(gone[:-1]) > 0
                    edges = np.flatnonzero(np.diff(np.concatenate([[0], cover.astype(np.int8), [0]]))).reshape(-1, 2)
                    columns["n_words"].append(len(words))
                    columns["n_removed"].append(int(cover.sum()))
                    columns["removed"].append([{"first": a, "end": b} for a, b in edges.tolist()])
                    columns["kept_text"].append(b" ".join([w for w, c in zip(words, cover.tolist()) if not c] if len(edges) else words).decode())
                types = [pa.int64(), pa.int64(), pa.list_(pa.struct([("first", pa.int64()), ("end", pa.int64())])), pa.string()]
                out = batch.drop_columns(["_packed", "_ranges"])
                for (name, values), kind in zip(columns.items(), types):
                    out = out.append_column(name, pa.array(values, kind))
                yield out

    return joined.mapInArrow(frugal(keep), f"{kept_schema}, n_words long, n_removed long, removed array<struct<first:long,end:long>>, kept_text string")
