"""Token-ID output: documents as fixed-length token sequences in a keyed training order, in fixed-stride binary shards."""

from __future__ import annotations

import base64
import json
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.fs as pafs
import zstandard
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlink.llm.shared import drop_folder, new_folder, with_permuted
from cairnlink.llm.tokens import column_bytes, frugal, hash_ranges, sliced

#: Fixed value: how the public byte-level tokenizers cut a text into pieces.
PATTERN = r"""'s|'t|'re|'ve|'m|'ll|'d| ?\p{L}+| ?\p{N}+| ?[^\s\p{L}\p{N}]+|\s+(?!\S)|\s+"""
END_OF_TEXT = 50256
_KNOWN = 400_000
SAMPLE_BYTES = 200_000
_PLAIN = np.array([0x20 < i < 0x7F or i >= 0x80 for i in range(256)])


def load_ranks(ranks_file: str) -> dict[bytes, int]:
    with open(ranks_file, "rb") as lines:
        return {base64.b64decode(a): int(b) for a, b in (line.split() for line in lines)}


#: White space outside ASCII, as UTF-8; texts that hold any are cut with more care.
_WIDE = tuple(c.encode() for c in "\x85\xa0\u1680\u2000\u2001\u2002\u2003\u2004\u2005\u2006\u2007\u2008\u2009\u200a\u2028\u2029\u202f\u205f\u3000")


class Encoder:
    """Token ids of a column of texts; equal stretches between cuts are encoded once for a batch."""

    def __init__(self, ranks: dict[bytes, int]) -> None:
        import tiktoken

        self.encode = tiktoken.Encoding("shards", pat_str=PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        self.known: dict[bytes, bytes] = {}
        self.width = np.zeros(max(ranks.values()) + 1, np.int64)
        self.width[list(ranks.values())] = [len(x) for x in ranks]

    def _cuts(self, data: np.ndarray, base: np.ndarray) -> np.ndarray:
        """Places where a piece begins for certain: a lone space between two characters that are no white space; text starts."""
        body = data[:-8]
        plain = _PLAIN[data[:-7]]
        cut = body == 0x20
        cut[1:] &= plain[:-2]
        cut &= plain[1:]
        lead = np.flatnonzero((body == 0xC2) | ((body >= 0xE1) & (body <= 0xE3)))
        for at in lead.tolist():
            if any(data[at : at + len(w)].tobytes() == w for w in _WIDE):  # no cut right before or after
                cut[max(0, at - 1) : at + 4] = False
        cut[base[:-1][np.diff(base) > 0]] = True
        return np.flatnonzero(cut)

    def _encode_new(self, parts: list[bytes]) -> None:
        """Encode parts not yet known: those that begin with a space and end without, all in one call, split at their ends."""
        joint = [p for p in parts if p[0] == 0x20 and (0x20 < p[-1] < 0x7F or p[-1] > 0x7F and not p.endswith(_WIDE))]
        ids = np.array(self.encode(b"".join(joint).decode()), np.int64)
        ends, wanted = np.cumsum(self.width[ids]), np.cumsum(np.fromiter(map(len, joint), np.int64, len(joint)))
        at = np.searchsorted(ends, wanted) + 1
        if len(joint) and (ends[at - 1] != wanted).any():
            joint, at = [], at[:0]
        raw, low = ids.astype("<u2").tobytes(), 0
        for part, high in zip(joint, (2 * at).tolist()):
            self.known[part] = raw[low:high]
            low = high
        for part in parts:
            if part not in self.known:
                self.known[part] = np.array(self.encode(part.decode()), "<u2").tobytes()

    def batch(self, texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
        """All ids in a row, and how many each text has."""
        data, base = column_bytes(texts)
        start = self._cuts(data, base)
        end = np.append(start[1:], len(data) - 8)
        first = np.searchsorted(start, base)
        _, at, back = np.unique(hash_ranges(data, start, end), return_index=True, return_inverse=True)
        raw = memoryview(data)
        parts = [bytes(raw[low:high]) for low, high in zip(start[at].tolist(), end[at].tolist())]
        if len(self.known) > _KNOWN:
            self.known.clear()
        self._encode_new([p for p in parts if p not in self.known])
        found = [self.known[p] for p in parts]
        size = np.fromiter(map(len, found), np.int64, len(found)) // 2
        bank = np.frombuffer(b"".join(found), "<u2")
        place = (np.cumsum(size) - size)[back]
        size = size[back]
        total = np.append(0, np.cumsum(size))
        index = np.arange(total[-1]) + np.repeat(place - total[:-1], size)
        return bank[index], total[first[1:]] - total[first[:-1]]


def _with_ends(ids: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The ids with an end-of-text id after every text."""
    return np.insert(ids, np.cumsum(counts), END_OF_TEXT) if len(counts) else ids


def _cut(ranks, length: int):
    """Encode texts and cut the ids of each task into sequences; a row holds those that one stretch of texts completes."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encoder, press = Encoder(ranks.value), zstandard.ZstdCompressor(level=6)
        context, number = TaskContext.get(), 0
        task = context.partitionId()
        held, owners = np.zeros(0, np.uint16), []  # ids not yet sent; (first place in held, document)

        def row(count: int, real: int) -> pa.RecordBatch:
            nonlocal held, owners, number
            places, ids = np.array([p for p, _ in owners], np.int64), [d for _, d in owners]
            low = np.maximum(0, np.searchsorted(places, np.arange(count) * length, "right") - 1)
            high = np.searchsorted(places, np.arange(1, count + 1) * length, "left")
            docs = [ids[a:b] for a, b in zip(low.tolist(), high.tolist())]
            packed = press.compress(held[: count * length].tobytes())
            columns = [pa.array([task], pa.int32()), pa.array([number]), pa.array([count]), pa.array([real]), pa.array([docs], pa.list_(pa.list_(pa.int64()))), pa.array([packed], pa.binary())]
            cut = max(0, int(np.searchsorted(places, count * length, "right")) - 1)
            owners = [(max(0, p - count * length), d) for p, d in owners[cut:]]
            held, number = held[count * length :], number + count
            return pa.RecordBatch.from_arrays(columns, names=["task", "first", "n", "real", "docs", "packed"])

        for batch in sliced(batches):
            ids, counts = encoder.batch(batch.column("text"))
            begins = len(held) + np.append(0, np.cumsum(counts + 1))[:-1]
            owners += list(zip(begins.tolist(), batch.column("id").to_pylist()))
            held = np.concatenate([held, _with_ends(ids, counts)])
            if count := len(held) // length:
                yield row(count, length)
        if real := len(held):
            held = np.concatenate([held, np.full(length - real, END_OF_TEXT, np.uint16)])
            yield row(1, real)

    return run


def _single(length: int, starts, sample):
    """One row for each sequence of the stored rows, with its global number; packed alone, with a sample of ids as dictionary."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, press = zstandard.ZstdDecompressor(), zstandard.ZstdCompressor(level=6, dict_data=_dictionary(sample.value))
        for batch in batches:
            for row in batch.to_pylist():
                rows = np.frombuffer(open_.decompress(row["packed"]), "<u2").reshape(-1, length)
                number = starts.value[row["task"]] + row["first"] + np.arange(row["n"])
                real = np.full(row["n"], length)
                real[-1] = row["real"]
                packed = [press.compress(x.tobytes()) for x in rows]
                yield pa.RecordBatch.from_arrays([pa.array(number), pa.array(real), pa.array(row["docs"], pa.list_(pa.int64())), pa.array(packed, pa.binary())], names=["row_no", "n_tokens", "doc_ids", "packed"])

    return run


def _dictionary(sample: bytes) -> zstandard.ZstdCompressionDict:
    return zstandard.ZstdCompressionDict(sample, dict_type=zstandard.DICT_TYPE_RAWCONTENT)


def _write(folder: str, sample):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        files, root = pafs.FileSystem.from_uri(folder)
        open_, stream, now, temporary = zstandard.ZstdDecompressor(dict_data=_dictionary(sample.value)), None, None, ""

        def close() -> None:
            if stream is not None:
                stream.close()
                files.move(temporary, f"{root}/{shard_name(now)}")

        for batch in batches:
            crc = []
            for shard, packed in zip(batch.column("shard").to_pylist(), batch.column("packed").to_pylist()):
                if shard != now:
                    close()
                    now, temporary = shard, f"{root}/.{shard_name(shard)}.{TaskContext.get().taskAttemptId()}"
                    stream = files.open_output_stream(temporary)
                body = open_.decompress(packed)
                stream.write(body)
                crc.append(zlib.crc32(body))
            yield batch.drop_columns(["packed"]).append_column("crc32", pa.array(crc, pa.int64()))
        close()

    return run


def shard_name(shard: int) -> str:
    return f"shard-{shard:08d}.bin"


def write_shards(docs: DataFrame, folder: str, ranks_file: str, key: int = 271_828, length: int = 1024, per_shard: int = 8192, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """Write token shards to ``folder`` and return the manifest: slot, shard, byte_offset, n_tokens, doc_ids, crc32, file.

    Texts are encoded with the byte-level vocabulary of ``ranks_file`` (65,536 ids at most), each followed by an
    end-of-text id, and the ids of each input task cut into sequences of ``length`` (the task's last one filled up with
    end-of-text ids). A keyed Feistel permutation with cycle walking gives every sequence a global slot; shard s holds the
    slots from s * ``per_shard`` on, in order, each as ``length`` little-endian 16-bit ids. So the place of any slot is
    known without an index, and a reader resumes anywhere (``read_sequences``).

    Encoding runs once: the sequences are stored, packed, in the shared folder, then counted by task, numbered, shuffled
    once to their shards and written; the stored ones go. The call returns when all is written. Each shard is written by
    one task, under a name of its own that is then moved, so a lost task leaves no partial shard. ``manifest`` (Parquet)
    and then ``layout.json`` come last: where the latter is, the set is whole.

    A null or empty text is one end-of-text id; a very long one runs through as many sequences as it needs; a null id is
    null in doc_ids; repeated rows are encoded again; an empty table gives an empty manifest and no shard. Ids that are no
    integers are kept as null. Other columns are not read, whatever their names.
    """
    spark = docs.sparkSession
    slim = docs.select(F.expr(f"try_cast(`{id_column}` as bigint)").alias("id"), F.col(f"`{text_column}`").cast("string").alias("text"))
    known = load_ranks(ranks_file)
    if max(known.values(), default=0) >= 1 << 16:
        raise ValueError("the vocabulary has ids beyond 16 bits")
    ranks = spark.sparkContext.broadcast(known)
    path = new_folder(spark, "sequences")
    cut = slim.mapInArrow(frugal(_cut(ranks, length)), "task int, first long, n long, real long, docs array<array<long>>, packed binary")
    cut.write.option("compression", "none").parquet(path)
    ranks.unpersist()
    stored_rows = spark.read.parquet(path)
    counts = {r.task: r.n for r in stored_rows.groupBy("task").agg(F.sum("n").alias("n")).collect()}  # a row for each input task
    starts, total = {}, 0
    for task in sorted(counts):
        starts[task] = total
        total += counts[task]
    shards = max(1, -(-total // per_shard))
    files, root = pafs.FileSystem.from_uri(folder)
    files.create_dir(root, recursive=True)
    some = stored_rows.select("packed").limit(1).collect()
    sample = spark.sparkContext.broadcast(zstandard.ZstdDecompressor().decompress(some[0].packed)[:SAMPLE_BYTES] if some else b"")
    rows = stored_rows.mapInArrow(frugal(_single(length, spark.sparkContext.broadcast(starts), sample)), "row_no long, n_tokens long, doc_ids array<long>, packed binary")
    placed = with_permuted(rows, "row_no", total, key, "slot").withColumn("shard", F.expr(f"cast(slot div {per_shard} as int)"))
    placed = placed.withColumn("byte_offset", (F.col("slot") - F.col("shard") * F.lit(per_shard)) * (2 * length))
    dealt = placed.select("slot", "shard", "byte_offset", "n_tokens", "doc_ids", "packed").repartitionById(shards, "shard").sortWithinPartitions("slot")
    manifest = dealt.mapInArrow(frugal(_write(folder, sample)), "slot long, shard int, byte_offset long, n_tokens long, doc_ids array<long>, crc32 long")
    named = manifest.withColumn("file", F.concat(F.lit(f"{folder}/"), F.format_string("shard-%08d.bin", "shard")))
    named.write.mode("overwrite").parquet(f"{folder}/manifest")
    with files.open_output_stream(f"{root}/layout.json") as out:
        out.write(json.dumps({"sequences": total, "length": length, "per_shard": per_shard, "key": key, "type": "<u2"}).encode())
    drop_folder(spark, path)
    return spark.read.parquet(f"{folder}/manifest")


def read_sequences(folder: str, slot: int, count: int) -> np.ndarray:
    """Up to ``count`` sequences from ``slot`` on, as rows; reads only their bytes."""
    files, root = pafs.FileSystem.from_uri(folder)
    with files.open_input_stream(f"{root}/layout.json") as f:
        layout = json.loads(f.read())
    stride, out = 2 * layout["length"], []
    while count > 0 and slot < layout["sequences"]:
        shard, at = divmod(slot, layout["per_shard"])
        take = min(count, layout["per_shard"] - at, layout["sequences"] - slot)
        with files.open_input_file(f"{root}/{shard_name(shard)}") as f:
            f.seek(at * stride)
            out.append(np.frombuffer(f.read(take * stride), layout["type"]).reshape(take, -1))
        slot, count = slot + take, count - take
    return np.concatenate(out) if out else np.zeros((0, layout["length"]), layout["type"])
