"""The corpus pipeline: five stages from documents to training shards, each written as Parquet and read again."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlink.llm import decontam, jaccard, mixing, token_shards, toxicity
from cairnlink.llm.queries import TOKENIZERS, word_count
from cairnlink.llm.shared import let_go, new_folder, table


def _aside(docs: DataFrame, *names: str) -> tuple[DataFrame, list[Column]]:
    """``docs`` with columns of these names out of an operator's way, and the expressions that give the old columns back."""
    away = {c: f"_aside_{c}" for c in docs.columns if c in names}
    return docs.withColumnsRenamed(away), [F.col(f"`{away.get(c, c)}`").alias(c) for c in docs.columns]


def toxicity_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the tagger scores at 0.5 or more go.

    Null and empty texts hold no toxic word and stay unless the model scores the empty text itself that high; texts are
    scored whole; repeated rows share one decision; nulls in other columns do not matter; all columns come back as they were.
    """
    tagger = toxicity.learn(docs, table(spark, sf_dir, "labels"), ~toxicity.held_out())
    ready, back = _aside(docs, "toxicity", "toxic_spans")
    return toxicity.score_texts(ready, tagger).where(F.col("toxicity") < 0.5).select(*back)


def jaccard_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each class of near-duplicates the document of the least doc_id stays.

    Texts without words (null, empty) are in no class and all stay; of repeated rows one stays; a null doc_id comes last in
    its class; long texts are compared whole; all columns come back as they were.
    """
    return jaccard.one_of_each(docs)


def decontamination_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that overlap a benchmark item go.

    Null and empty texts overlap nothing and stay; texts are compared whole; repeated rows share one decision; items that are
    null or empty rule out nothing; all columns come back as they were.
    """
    ready, back = _aside(docs, "overlaps")
    return decontam.mark_overlaps(ready, table(spark, sf_dir, "benchmark")).where(decontam.is_clean()).select(*back)


def mixing_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Each document as often as the mix of its source takes it, from not at all to three times.

    A null source is a source; null and empty texts have size 0 and are taken like others; repeated rows share their copies;
    a document longer than its source's target may be left out or taken as a whole; all columns come back as they were.
    """
    return mixing.remix(docs, word_count())


def shards_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token shards in training order, in a new folder of the shared one; returns their manifest, which names the files.

    A null or empty text is one end-of-text id; a null doc_id is null in the manifest; only doc_id and text are read.
    """
    return token_shards.write_shards(docs, new_folder(spark, "training"), f"{TOKENIZERS}/byte_bpe_50k.tiktoken")


STAGES = [
    ("toxicity", toxicity_stage),
    ("ngram_jaccard_join", jaccard_stage),
    ("decontamination", decontamination_stage),
    ("mixing", mixing_stage),
    ("token_shards", shards_stage),
]

#: Tagging, MinHash candidates, the drawn mix and token ids are beyond SQL; tests compare the stages with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole table of documents; the last one's rows."""
    docs, folder = table(spark, sf_dir, "documents"), new_folder(spark, "pipeline")
    for name, stage in STAGES:
        stage(spark, docs, sf_dir).write.parquet(f"{folder}/{name}")
        docs = spark.read.parquet(f"{folder}/{name}")
        let_go(spark)
    return docs


QUERIES = {"pipeline": run}
ORACLES = {"pipeline": ORACLE_SQL} if ORACLE_SQL else {}
