"""Decisions: thresholds, one-to-one assignment, match lists, macro F0.5 and the threshold sweep."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlink.sources.tables import id_list

S1, CAND = "source1_entity_id", "candidate_entity_id"


def allowed_pairs(scored: DataFrame) -> DataFrame:
    """Pairs whose candidate is an S2 or S3 record and not the S1 record itself."""
    return scored.where(F.col(CAND).rlike("^S[23]-") & (F.col(CAND) != F.col(S1)))


def claims(scored: DataFrame, score: str = "calibrated_score") -> DataFrame:
    """Each candidate's best pair only; ties to the smaller S1 id. As S1 records take any number, this is the greedy assignment."""
    order = Window.partitionBy(CAND).orderBy(F.desc(score), S1)
    return allowed_pairs(scored).withColumn("_n", F.row_number().over(order)).where("_n = 1").drop("_n")


def check_scored(scored: DataFrame, manifest: DataFrame, threshold: float, score: str = "calibrated_score") -> None:
    """Raise on missing columns, a threshold outside 0..1, repeated S1 or pairs, scores that are no finite number, unknown S1."""
    missing = {S1, CAND, score} - set(scored.columns)
    if missing:
        raise ValueError(f"no column {', '.join(sorted(missing))}")
    if not 0 <= threshold <= 1:
        raise ValueError("the threshold lies outside 0 to 1")
    number = F.try_cast(F.col(score).cast("string"), "double") if hasattr(F, "try_cast") else F.col(score).cast("double")
    bad = scored.agg(F.sum((number.isNull() | F.isnan(number) | (F.abs(number) == float("inf"))).cast("int"))).first()[0]
    problems = {
        "a score is no finite number": bool(bad),
        "an S1 id repeats": not manifest.groupBy(S1).count().where("count > 1").isEmpty(),
        "a pair repeats": not scored.groupBy(S1, CAND).count().where("count > 1").isEmpty(),
        "an S1 id is unknown": not scored.join(manifest, S1, "left_anti").isEmpty(),
    }
    if found := [text for text, is_so in problems.items() if is_so]:
        raise ValueError("; ".join(found))


def match_lists(scored: DataFrame, manifest: DataFrame, threshold: float, injective: bool = True, score: str = "calibrated_score", check: bool = False) -> DataFrame:
    """One row for each S1 of the manifest with its matches as a comma list, best first."""
    if check:
        check_scored(scored, manifest, threshold, score)
    kept = scored.where(F.col(score) >= threshold)
    kept = claims(kept, score) if injective else allowed_pairs(kept).dropDuplicates([S1, CAND])
    return id_list(kept, manifest, S1, CAND, [F.desc(score), F.col(CAND)], "matched_entity_ids")


def f_half(predicted: Column, actual: Column, right: Column) -> Column:
    """F0.5 of one S1 record; 1 if there is nothing to find and nothing found."""
    p, r = right / predicted, right / actual
    return F.when((predicted == 0) & (actual == 0), 1.0).when((right == 0) | (predicted == 0) | (actual == 0), 0.0).otherwise(1.25 * p * r / (0.25 * p + r))


def _counts(kept: DataFrame, truth: DataFrame, manifest: DataFrame) -> DataFrame:
    marked = kept.select(S1, CAND).join(truth.select(S1, CAND, F.lit(1).alias("_hit")), [S1, CAND], "left")
    predicted = marked.groupBy(S1).agg(F.count(F.lit(1)).alias("predicted"), F.count("_hit").alias("right"))
    actual = truth.groupBy(S1).agg(F.count(F.lit(1)).alias("actual"))
    joined = manifest.select(S1).distinct().join(predicted, S1, "left").join(actual, S1, "left")
    return joined.select(S1, *[F.coalesce(c, F.lit(0)).alias(c) for c in ("predicted", "right", "actual")])


def macro_f_half(scored: DataFrame, truth: DataFrame, manifest: DataFrame, threshold: float, injective: bool = True, score: str = "calibrated_score") -> DataFrame:
    """One row: entities, the mean F0.5 over them, and pooled precision and recall."""
    kept = scored.where(F.col(score) >= threshold)
    per = _counts(claims(kept, score) if injective else allowed_pairs(kept), truth, manifest)
    return per.agg(
        F.count(F.lit(1)).alias("entities"),
        F.round(F.avg(f_half(F.col("predicted"), F.col("actual"), F.col("right"))), 6).alias("macro_f05"),
        F.round(F.sum("right") / F.nullif(F.sum("predicted"), F.lit(0)), 6).alias("pair_precision"),
        F.round(F.sum("right") / F.nullif(F.sum("actual"), F.lit(0)), 6).alias("pair_recall"),
    )


def threshold_sweep(scored: DataFrame, truth: DataFrame, manifest: DataFrame, grid: list[float], injective: bool = True, score: str = "calibrated_score") -> DataFrame:
    """(threshold, macro_f05) for every threshold of the grid, from one pass over the pairs.

    Admitting pairs of an S1 in descending score changes its F0.5 step by step. Each step belongs to the highest
    threshold of the grid that admits it, so the sums of the steps by threshold, added up from the top, give all means.
    """
    kept = claims(scored, score) if injective else allowed_pairs(scored)
    marked = kept.select(S1, CAND, F.col(score).alias("_s")).join(truth.select(S1, CAND, F.lit(1).alias("_hit")), [S1, CAND], "left")
    slot = F.lit(None).cast("int")
    for i, t in enumerate(grid):  # the last threshold that is not above the score
        slot = F.when(F.col("_s") >= t, F.lit(i)).otherwise(slot)
    by_slot = marked.withColumn("slot", slot).where("slot is not null").groupBy(S1, "slot").agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit"))
    actual = truth.groupBy(S1).agg(F.count(F.lit(1)).alias("actual"))
    joined = by_slot.join(actual, S1, "left").withColumn("actual", F.coalesce("actual", F.lit(0))).join(manifest.select(S1).distinct(), S1, "left_semi")
    run = Window.partitionBy(S1).orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    step = joined.withColumns({"p": F.sum("n").over(run), "r": F.sum("hit").over(run)}).withColumn("f", f_half(F.col("p"), F.col("actual"), F.col("r")))
    before = F.lag("f").over(Window.partitionBy(S1).orderBy(F.desc("slot")))
    start = F.when(F.col("actual") == 0, 1.0).otherwise(0.0)
    gains = step.withColumn("gain", F.col("f") - F.coalesce(before, start)).groupBy("slot").agg(F.sum("gain").alias("gain"))
    entities = manifest.select(S1).distinct().join(actual, S1, "left").agg(F.count(F.lit(1)).alias("n"), F.sum(F.when(F.col("actual").isNull(), 1.0).otherwise(0.0)).alias("base"))
    spark = scored.sparkSession
    steps = spark.createDataFrame([(i, float(t)) for i, t in enumerate(grid)], "slot int, threshold double")
    all_ = F.broadcast(steps).join(gains, "slot", "left").crossJoin(F.broadcast(entities))  # as many rows as the grid has
    down = Window.orderBy(F.desc("slot")).rowsBetween(Window.unboundedPreceding, 0)
    return all_.select("threshold", F.round((F.col("base") + F.sum(F.coalesce("gain", F.lit(0.0))).over(down)) / F.col("n"), 6).alias("macro_f05"))


def threshold_grid(scored: DataFrame, score: str = "calibrated_score", few: int = 1000) -> list[float]:
    """0, 0.05 to 0.95 by 0.01, 1; and the scores themselves if there are ``few`` rows at most, else 100 quantiles.

    Quantiles come from a sketch of bounded size.
    """
    steps = [0.0, *[round(0.05 + 0.01 * i, 2) for i in range(91)], 1.0]
    kept = allowed_pairs(scored).select(F.col(score).cast("double").alias("s")).where(F.col("s").isNotNull() & ~F.isnan("s"))
    own = [r.s for r in kept.limit(few + 1).collect()]
    if len(own) > few:
        own = kept.agg(F.percentile_approx("s", [i / 99 for i in range(100)], 10_000)).first()[0]
    return sorted({*steps, *[float(x) for x in own]})


def best_threshold(sweep: DataFrame) -> DataFrame:
    """The row of the highest mean; of equal ones the lowest threshold."""
    return sweep.orderBy(F.desc("macro_f05"), "threshold").limit(1)
