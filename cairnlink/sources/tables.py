"""Sources and sinks: TSV feeds, Parquet tables, candidate lists, ground truth, embeddings, results."""

from __future__ import annotations

import io
import tempfile
import uuid

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

ALIASES = {
    "business_name": ["business_name", "raw_name", "norm_name"],
    "business_address": ["business_address", "raw_address", "norm_address"],
    "country": ["country", "country_canonical"],
}
READ_TSV = {"sep": "\t", "quote": "", "header": "true", "mode": "PERMISSIVE", "inferSchema": "false"}
WRITE_TSV = {"sep": "\t", "quote": "\u0000", "escape": "\\", "header": "true", "emptyValue": ""}


def read_tsv(spark: SparkSession, *paths: str) -> DataFrame:
    """All columns as strings, missing fields as ''; lines are never joined by quotes."""
    found = None
    for path in paths:
        one = spark.read.options(**READ_TSV).csv(path)
        one = one.select([F.coalesce(F.col(f"`{c}`"), F.lit("")).alias(c.strip()) for c in one.columns])
        found = one if found is None else found.unionByName(one, allowMissingColumns=True)
    return found


def as_feed(df: DataFrame) -> DataFrame:
    """entity_id and the first present of each column's names; a missing id, name or address column raises."""
    if "entity_id" not in df.columns:
        raise ValueError("no entity_id column")
    picked = [F.col("entity_id").cast("string").alias("entity_id")]
    for name, others in ALIASES.items():
        known = next((c for c in others if c in df.columns), None)
        if known is None and name != "country":
            raise ValueError(f"no column for {name}: {', '.join(others)}")
        picked.append((F.coalesce(F.col(known).cast("string"), F.lit("")) if known else F.lit("")).alias(name))
    return df.select(*picked).where(F.col("entity_id").isNotNull() & (F.col("entity_id") != ""))


def only_needed(records: DataFrame, needed: DataFrame, column: str = "entity_id", order: list[Column] | None = None) -> DataFrame:
    """Rows whose id is needed, one for each id: the last by ``order``, or, as files have no order here, by a hash of the row."""
    kept = records.join(needed.select(F.col(needed.columns[0]).alias(column)).distinct(), column, "left_semi")
    last = Window.partitionBy(column).orderBy(*(order or [F.xxhash64(*records.columns)]))
    return kept.withColumn("_n", F.row_number().over(last)).withColumn("_all", F.count(F.lit(1)).over(Window.partitionBy(column))).where("_n = _all").drop("_n", "_all")


def explode_ids(df: DataFrame, key: str, ids: str, name: str = "candidate_entity_id", most: int | None = None, dedup: bool = True) -> DataFrame:
    """One row for each id of a comma list, with its place; the first ``most`` of each list only."""
    split = F.filter(F.transform(F.split(F.coalesce(F.col(ids), F.lit("")), ","), lambda x: F.trim(x)), lambda x: x != "")
    split = F.array_distinct(split) if dedup else split
    return df.select(F.col(key), F.posexplode(F.slice(split, 1, most) if most else split).alias("position", name))


def ground_truth_pairs(truth: DataFrame) -> DataFrame:
    return explode_ids(truth, "source1_entity_id", "matched_entity_ids").drop("position").distinct()


def id_list(pairs: DataFrame, manifest: DataFrame, key: str, value: str, order: list[Column], name: str) -> DataFrame:
    """One row for each key of the manifest with its values as a comma list, '' for none."""
    rank = Window.partitionBy(key).orderBy(*order)
    ranked = pairs.withColumn("_n", F.row_number().over(rank)).groupBy(key).agg(F.array_sort(F.collect_list(F.struct("_n", value))).alias("_all"))
    joined = manifest.select(key).distinct().join(ranked, key, "left")
    return joined.select(key, F.coalesce(F.array_join(F.transform("_all", lambda x: x[value]), ","), F.lit("")).alias(name))


def write_records(records: DataFrame, path: str, tsv: bool = False) -> None:
    if not tsv:
        records.write.mode("overwrite").partitionBy("country_canonical").parquet(path)
        return
    flat = [F.array_join(c.name, "|").alias(c.name) if isinstance(c.dataType, T.ArrayType) else F.coalesce(F.col(c.name).cast("string"), F.lit("")).alias(c.name) for c in records.schema]
    records.select(*flat).write.mode("overwrite").options(**WRITE_TSV).csv(path)


def write_results(results: DataFrame, path: str, one_file: bool = True) -> None:
    (results.coalesce(1) if one_file else results).write.mode("overwrite").options(**WRITE_TSV).csv(path)


def write_json(df: DataFrame, path: str) -> None:
    df.write.mode("overwrite").json(path)


def write_candidates(hits: DataFrame, manifest: DataFrame, folder: str) -> None:
    """The candidate lists (one row for each S1, '' for none) and, pair by pair, where the candidates come from, as TSV."""
    key, value = "source1_entity_id", "candidate_entity_id"
    lists = id_list(hits, manifest, key, value, [F.col("place"), F.col(value)], "candidate_entity_ids")
    lists.write.mode("overwrite").options(**WRITE_TSV).csv(f"{folder}/candidate_pairs")
    columns = [key, value, "candidate_source", "blocker_provenance", "blocker_count", "best_blocker_rank", "best_blocker_score", "country_partition", "place"]
    hits.select(columns).write.mode("overwrite").options(**WRITE_TSV).csv(f"{folder}/candidate_provenance")


def read_candidates(spark: SparkSession, path: str, most: int | None = None) -> DataFrame:
    """(s1, cand, position) of candidate lists; the first ``most`` of each list only, none twice."""
    lists = read_tsv(spark, path)
    return explode_ids(lists, "source1_entity_id", "candidate_entity_ids", most=most)


def read_provenance(spark: SparkSession, path: str) -> DataFrame:
    """Hits as ``write_candidates`` writes them, with their types."""
    kinds = {"blocker_count": "int", "best_blocker_rank": "int", "best_blocker_score": "double", "place": "int"}
    rows = read_tsv(spark, path)
    return rows.withColumns({c: F.expr(f"try_cast({c} as {kind})") for c, kind in kinds.items() if c in rows.columns})


def with_provenance(candidates: DataFrame, provenance: DataFrame) -> DataFrame:
    """Candidate pairs with what is known of them; null where nothing is. No order of either side is assumed."""
    keys = ["source1_entity_id", "candidate_entity_id"]
    return candidates.join(provenance.dropDuplicates(keys), keys, "left")


def write_features(features: DataFrame, folder: str, families: dict[str, list[str]] | None = None, tsv: bool = False) -> None:
    """Pair features below ``folder``, one table for each family of columns; a table of all of them without families."""
    keys = ["source1_entity_id", "candidate_entity_id"]
    for name, columns in (families or {"features": [c for c in features.columns if c not in keys]}).items():
        out = features.select(*keys, *columns).write.mode("overwrite")
        out.options(**WRITE_TSV).csv(f"{folder}/{name}") if tsv else out.parquet(f"{folder}/{name}")


def read_features(spark: SparkSession, path: str, tsv: bool = False) -> DataFrame:
    return spark.read.options(sep="\t", header="true", inferSchema="true").csv(path) if tsv else spark.read.parquet(path)


def read_embeddings(spark: SparkSession, path: str, id_column: str = "entity_id", vector: str = "embedding") -> DataFrame:
    """Vectors of length 1 (a zero vector stays) from Parquet, or from .npz files with arrays of ids and vectors.

    An .npz file is one task's work and must fit its memory; Parquet has no such limit.
    """
    from cairnlink.functions.similarity import l2_normalised

    if not path.endswith(".npz"):
        return spark.read.parquet(path).select(F.col(id_column), l2_normalised(F.col(vector)).alias(vector))

    def unpack(batches):
        for batch in batches:
            for content in batch.column("content").to_pylist():
                with np.load(io.BytesIO(content), allow_pickle=False) as arrays:
                    for side in ("candidate", "s1"):
                        if f"{side}_ids" in arrays:
                            ids, rows = arrays[f"{side}_ids"].astype(str).tolist(), arrays[f"{side}_embeddings"].astype(float)
                            yield pa.RecordBatch.from_arrays([pa.array(ids), pa.array(rows.tolist(), pa.list_(pa.float64()))], names=["id", "v"])

    rows = spark.read.format("binaryFile").load(path).select("content").mapInArrow(unpack, "id string, v array<double>")
    return rows.select(F.col("id").alias(id_column), l2_normalised(F.col("v")).alias(vector))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """``rows`` over all cores where the scan has fewer partitions than there are cores; large scans stay as they are."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if rows.rdd.getNumPartitions() < cores else rows


def feed_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Documents as an entity feed: id by doc_id mod 3, name and address are the whole first two lines."""
    lines = F.split("text", "\n")
    rows = table(spark, sf_dir, "documents").select(
        F.concat(F.lit("S"), F.col("doc_id") % 3 + 1, F.lit("-"), "doc_id").alias("entity_id"),
        F.get(lines, F.lit(0)).alias("business_name"),
        F.coalesce(F.get(lines, F.lit(1)), F.lit("")).alias("business_address"),
        F.col("lang").alias("country"),
        "doc_id",
        F.xxhash64("text").alias("text_key"),
    )
    return spread(rows)


def truth_of_documents(spark: SparkSession, sf_dir: str) -> DataFrame:
    """True pairs: an S2 or S3 document with the S1 documents of the least and the greatest id among those of equal text and language.

    So a text that very many documents share makes two pairs for each of its candidates at most. Texts are known by two hashes.
    """
    number = F.col("doc_id")
    rows = table(spark, sf_dir, "documents").where(F.col("text").isNotNull() & F.col("lang").isNotNull())
    rows = rows.select("doc_id", F.xxhash64("text").alias("_h"), F.crc32(F.encode("text", "utf-8")).alias("_c"), "lang")
    ones = rows.where(number % 3 == 0).groupBy("_h", "_c", "lang").agg(F.min("doc_id").alias("_low"), F.max("doc_id").alias("_high"))
    paired = rows.where(number % 3 != 0).join(ones, ["_h", "_c", "lang"]).withColumn("_one", F.explode(F.array_distinct(F.array("_low", "_high"))))
    return paired.select(F.concat(F.lit("S1-"), "_one").alias("source1_entity_id"), F.concat(F.lit("S"), number % 3 + 1, F.lit("-"), "doc_id").alias("candidate_entity_id"), F.col("lang").alias("country"))


def shared_folder(spark: SparkSession) -> str:
    """The folder that spark.checkpoint.dir names. Where it names none, a new local one, on a local master only."""
    setting, context = "spark.checkpoint.dir", spark.sparkContext
    named = context.getConf().get(setting) or spark.conf.get(setting, None) or context.getCheckpointDir()
    if not named:
        if not context.master.startswith("local"):
            raise RuntimeError(f"{setting} must name a folder that all executors share")
        named = "file://" + tempfile.mkdtemp(prefix="cairnlink-")
        spark.conf.set(setting, named)
    if context.getCheckpointDir() is None:
        context.setCheckpointDir(named)
    return named.rstrip("/")


def stored(rows: DataFrame, name: str) -> DataFrame:
    """``rows`` written once to the shared folder and read from there, for plans that need them several times."""
    path = f"{shared_folder(rows.sparkSession)}/{name}-{uuid.uuid4().hex}"
    rows.write.option("compression", "zstd").parquet(path)
    return rows.sparkSession.read.parquet(path)
