"""Streaming front end: records are normalised as they arrive and linked to a static set of candidates."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql.streaming import StreamingQuery

from cairnlink.functions.normalize import normalize_records
from cairnlink.operators.blocking import Blocking, generate, prepare
from cairnlink.sources.tables import stored

FEED = "entity_id string, business_name string, business_address string, country string"


def normalized_stream(spark: SparkSession, path: str, fmt: str = "parquet") -> DataFrame:
    """Normalisation looks at one record at a time, so the batch functions run on a stream unchanged."""
    return normalize_records(spark.readStream.schema(FEED).format(fmt).load(path))


def link_stream(stream: DataFrame, candidates: DataFrame, out: str, checkpoint: str, config: Blocking = Blocking()) -> StreamingQuery:
    """Write the candidates of the S1 records of each micro-batch; a batch that is run again overwrites its own folder.

    The static candidates are made ready once and stored before the stream starts; batches read that table.
    """
    ready = stored(prepare(candidates.where("source <> 'S1'"), config), "candidates")

    def one_batch(batch: DataFrame, number: int) -> None:
        hits = generate(batch.where("source = 'S1'"), config, checkpoint=True, candidates=ready)
        hits.write.mode("overwrite").parquet(f"{out}/batch={number}")

    return stream.writeStream.foreachBatch(one_batch).option("checkpointLocation", checkpoint).trigger(availableNow=True).start()


def not_yet_done(ones: DataFrame, done: DataFrame) -> DataFrame:
    """S1 records without result: what a resumed run has left."""
    return ones.join(done.select("source1_entity_id").distinct(), ones["entity_id"] == done["source1_entity_id"], "left_anti")
