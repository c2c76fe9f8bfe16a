"""Training data: samples, positives with hard negatives, evaluation sets, prompts."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

S1, CAND = "source1_entity_id", "candidate_entity_id"


def sample_by_country(records: DataFrame, n: int, exclude: DataFrame | None = None, country: str | None = None, seed: int = 42) -> DataFrame:
    """Up to ``n`` records of every country (or of one), in the order of a hash of the id."""
    rows = records if country is None else records.where(F.col("country_canonical") == country)
    if exclude is not None:
        rows = rows.join(exclude.select(F.col(exclude.columns[0]).alias("entity_id")), "entity_id", "left_anti")
    order = Window.partitionBy("country_canonical").orderBy(F.xxhash64("entity_id", F.lit(seed)), "entity_id")
    return rows.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= n).drop("_n")


def hard_negatives(hits: DataFrame, truth: DataFrame, texts: DataFrame, k: int) -> DataFrame:
    """The first ``k`` candidates of every S1 that are no match and whose text is neither empty, the anchor's nor a match's.

    ``texts`` has id and text; ``hits`` a place for the order.
    """
    named = hits.join(truth.select(S1, CAND), [S1, CAND], "left_anti")
    anchor = texts.select(F.col("id").alias(S1), F.col("text").alias("anchor"))
    cand = texts.select(F.col("id").alias(CAND), "text")
    good = truth.select(S1, CAND).join(cand, CAND).select(S1, F.col("text").alias("_t")).distinct()
    with_text = named.join(anchor, S1).join(cand, CAND).where((F.col("text") != "") & (F.col("text") != F.col("anchor")))
    kept = with_text.join(good, (with_text[S1] == good[S1]) & (with_text["text"] == good["_t"]), "left_anti")
    order = Window.partitionBy(S1).orderBy("place", CAND)
    return kept.withColumn("n", F.row_number().over(order)).where(F.col("n") <= k).select(S1, CAND, "text", "n")


def random_negatives(hits: DataFrame, truth: DataFrame, per_positive: int, seed: int = 42) -> DataFrame:
    """``per_positive`` times as many non-matching candidates of every S1 as it has matches, drawn by a hash of the pair."""
    positives = truth.groupBy(S1).agg(F.count(F.lit(1)).alias("_p"))
    order = Window.partitionBy(S1).orderBy(F.xxhash64(S1, CAND, F.lit(seed)), CAND)
    rest = hits.select(S1, CAND).join(truth.select(S1, CAND), [S1, CAND], "left_anti").join(positives, S1)
    return rest.withColumn("_n", F.row_number().over(order)).where(F.col("_n") <= F.col("_p") * per_positive).select(S1, CAND)


def training_pairs(hits: DataFrame, truth: DataFrame, texts: DataFrame, k: int = 5) -> DataFrame:
    """(s1_id, matched_id, anchor, positive, negatives): one row for each true pair with text on both sides."""
    negatives = hard_negatives(hits, truth, texts, k).groupBy(S1).agg(F.transform(F.array_sort(F.collect_list(F.struct("n", "text"))), lambda x: x["text"]).alias("negatives"))
    anchor, good = texts.select(F.col("id").alias(S1), F.col("text").alias("anchor")), texts.select(F.col("id").alias(CAND), F.col("text").alias("positive"))
    rows = truth.select(S1, CAND).join(anchor, S1).join(good, CAND).where("anchor <> '' and positive <> ''").join(negatives, S1, "left")
    return rows.select(F.col(S1).alias("s1_id"), F.col(CAND).alias("matched_id"), "anchor", "positive", F.coalesce("negatives", F.array().cast("array<string>")).alias("negatives"))


def flat_pairs(pairs: DataFrame, k: int) -> DataFrame:
    """anchor, positive, negative_1 .. negative_k of the pairs that have k negatives."""
    return pairs.where(F.size("negatives") >= k).select("anchor", "positive", *[F.get("negatives", F.lit(i)).alias(f"negative_{i + 1}") for i in range(k)])


def evaluation_set(truth: DataFrame, texts: DataFrame, distractors: DataFrame, queries: int = 2000, seed: int = 42) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Queries, corpus and relevant pairs of a retrieval benchmark: S1 texts, their matches and distractors."""
    chosen = truth.select(S1).distinct().orderBy(F.xxhash64(S1, F.lit(seed)), S1).limit(queries)
    relevant = truth.join(chosen, S1, "left_semi").select(F.col(S1).alias("q"), F.col(CAND).alias("c"))
    asked = texts.join(chosen.select(F.col(S1).alias("id")), "id", "left_semi")
    named = relevant.select(F.col("c").alias("id")).unionByName(distractors.select(F.col(distractors.columns[0]).alias("id"))).distinct()
    return asked, texts.join(named, "id", "left_semi"), relevant


def prompt(left_name: Column, left_address: Column, right_name: Column, right_address: Column) -> Column:
    """Text for a pair classifier; names are cut at 100 and addresses at 200 characters."""
    part = lambda name, address: F.concat(F.lit("Name: "), F.substring(name, 1, 100), F.lit("\nAddress: "), F.when(address == "", F.lit("[NO_ADDRESS]")).otherwise(F.substring(address, 1, 200)))
    return F.concat(F.lit("Do these records name one business?\nA\n"), part(left_name, left_address), F.lit("\nB\n"), part(right_name, right_address), F.lit("\nAnswer Yes or No."))


def score_prompts(pairs: DataFrame, scorer, column: str = "prompt", name: str = "matcher_prob") -> DataFrame:
    """Add the probabilities that ``scorer`` (list of prompts to list of floats) gives, batch by batch on the executors."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in pairs.schema)

    def run(frames):
        for frame in frames:
            frame[name] = scorer(frame[column].tolist())
            frame[f"{name}_missing"] = 0
            yield frame

    return pairs.mapInPandas(run, f"{schema}, `{name}` double, `{name}_missing` int")
