"""Scoring: feature matrix, folds, boosted trees, calibration."""

from __future__ import annotations

import json
from dataclasses import dataclass

from pyspark.ml.classification import GBTClassificationModel, GBTClassifier, LogisticRegression
from pyspark.ml.feature import VectorAssembler
from pyspark.ml.functions import vector_to_array
from pyspark.ml.regression import IsotonicRegression
from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from cairnlink.operators import decide
from cairnlink.operators.evaluate import average_precision
from cairnlink.sources.tables import stored

S1, CAND = "source1_entity_id", "candidate_entity_id"
NOT_FEATURES = [S1, CAND, "label", "blocker_provenance", "left_country", "right_country", "left_country_canonical", "right_country_canonical"]
#: Parameters of the boosted trees.
ROUNDS = 300
TREES = {"maxDepth": 4, "stepSize": 0.03, "subsamplingRate": 0.85, "maxBins": 256, "minInstancesPerNode": 5, "seed": 42}


def feature_names(features: DataFrame) -> list[str]:
    return [c for c in features.columns if c not in NOT_FEATURES]


def fill_value(name: str) -> float:
    """What stands for a missing value of a feature."""
    if name.endswith("_missing"):
        return 1.0
    if "rank" in name:
        return 999.0
    return -1.0 if name in ("best_blocker_score", "country_equal") else 0.0


def filled(features: DataFrame) -> DataFrame:
    """All features as doubles without nulls; text that is no number counts as missing."""
    return features.withColumns({c: F.coalesce(F.expr(f"try_cast(`{c}` as double)"), F.lit(fill_value(c))) for c in feature_names(features)})


def attach_labels(features: DataFrame, truth: DataFrame) -> DataFrame:
    pairs = truth.select(S1, CAND).distinct().withColumn("_hit", F.lit(1))
    return features.join(pairs, [S1, CAND], "left").withColumn("label", F.coalesce("_hit", F.lit(0))).drop("_hit")


def thin_negatives(labelled: DataFrame, keep: int = 6, rank: str = "candidate_rank") -> DataFrame:
    """All positives and the first ``keep`` negatives of every S1, by rank, then id."""
    order = Window.partitionBy(S1, "label").orderBy(rank, CAND)
    return labelled.withColumn("_n", F.row_number().over(order)).where((F.col("label") == 1) | (F.col("_n") <= keep)).drop("_n")


def mask_country(features: DataFrame, rate: float = 0.15, seed: int = 42) -> DataFrame:
    """Hide the country comparison on a share of rows, drawn by a hash of the pair."""
    drawn = F.pmod(F.xxhash64(S1, CAND, F.lit(seed)), F.lit(10_000)) < rate * 10_000
    return features.withColumns({"country_equal": F.when(drawn, -1).otherwise(F.col("country_equal")), "country_equal_missing": F.when(drawn, 1).otherwise(F.col("country_equal_missing"))})


def fold_of(entity: Column, folds: int = 5, seed: int = 42) -> Column:
    """The fold of an S1 id; all pairs of one S1 share it."""
    return F.pmod(F.xxhash64(entity, F.lit(seed)), F.lit(folds)).cast("int")


def with_folds(labelled: DataFrame, folds: int = 5, seed: int = 42, strata: str | None = None, buckets: int = 256) -> DataFrame:
    """Add ``fold``: S1 records of each stratum (its country and whether it has a match) are dealt out evenly.

    Within a stratum S1 records are numbered by hash in ``buckets`` parts, each a sort of its own, so no task gets a stratum;
    counts of two folds in a stratum differ by one for each part at most. All pairs of one S1 share its fold.
    """
    keys = [F.min(strata).alias("_s")] if strata else [F.lit("").alias("_s")]
    entities = labelled.groupBy(S1).agg(F.max("label").alias("_y"), *keys)
    entities = entities.withColumn("_b", F.pmod(F.xxhash64(S1, F.lit(seed)), F.lit(buckets)))
    order = Window.partitionBy("_s", "_y", "_b").orderBy(F.xxhash64(S1, F.lit(seed + 1)), S1)
    numbered = entities.withColumn("fold", F.pmod(F.row_number().over(order) + F.xxhash64("_b", "_s", "_y"), F.lit(folds)).cast("int"))
    return labelled.join(numbered.select(S1, "fold"), S1)


def monotone(names: list[str]) -> dict[str, int]:
    """Expected direction of each feature: 1 rises, -1 falls, 0 free."""
    falls = ("_missing", "abs_diff", "rank", "same_name_different", "same_address_different", "score_diff")
    rises = ("jaccard", "overlap", "similarity", "ratio", "exact", "equal", "cosine", "prob", "blocker_count", "best_blocker_score")
    return {n: -1 if any(x in n for x in falls) else 1 if any(x in n for x in rises) else 0 for n in names}


def _assembled(features: DataFrame, names: list[str]) -> DataFrame:
    return VectorAssembler(inputCols=names, outputCol="_x").transform(filled(features))


def weighted(labelled: DataFrame) -> DataFrame:
    """Positives weigh negatives by positives."""
    totals = labelled.agg(F.sum(F.when(F.col("label") == 0, 1.0).otherwise(0.0)).alias("_neg"), F.sum(F.when(F.col("label") == 1, 1.0).otherwise(0.0)).alias("_pos"))
    joined = labelled.crossJoin(F.broadcast(totals))  # one row
    return joined.withColumn("weight", F.when(F.col("label") == 1, F.col("_neg") / F.greatest(F.col("_pos"), F.lit(1.0))).otherwise(1.0)).drop("_neg", "_pos")


def fit_trees(labelled: DataFrame, names: list[str] | None = None, rounds: int = ROUNDS, early: bool = True, seed: int = 42, **parameters):
    """Gradient-boosted trees. With ``early`` a tenth of the S1 records is held out and trees are added while they help on it."""
    names = names or feature_names(labelled)
    ready = _assembled(weighted(labelled), names).withColumn("_held", fold_of(F.col(S1), 10, seed + 7) == 0)
    kept = ready.groupBy("_held").agg(F.countDistinct("label").alias("n")).where("n = 2").count() == 2 if early else False
    more = {"validationIndicatorCol": "_held"} if kept else {}
    model = GBTClassifier(featuresCol="_x", labelCol="label", weightCol="weight", maxIter=rounds, **(TREES | more | parameters))
    return model.fit(ready), names


def predict(model, names: list[str], features: DataFrame) -> DataFrame:
    return model.transform(_assembled(features, names)).withColumn("raw_score", vector_to_array("probability")[1]).select(S1, CAND, *[c for c in ("label",) if c in features.columns], "raw_score")


def out_of_fold(labelled: DataFrame, folds: int = 5, rounds: int = ROUNDS, seed: int = 42, strata: str | None = None, grown: list[int] | None = None) -> DataFrame:
    """Scores of every pair by a model that has seen no pair of its S1; ``grown`` gets the number of trees of each model."""
    marked = with_folds(labelled, folds, seed, strata).cache()
    found, names = None, feature_names(labelled)
    for fold in range(folds):
        train, test = marked.where(F.col("fold") != fold).drop("fold"), marked.where(F.col("fold") == fold)
        if train.select("label").distinct().count() < 2:
            scored = test.select(S1, CAND, "label", F.lit(0.0).alias("raw_score"))
        else:
            model, _ = fit_trees(mask_country(train, seed=seed) if "country_equal" in names else train, names, rounds)
            if grown is not None:
                grown.append(model.getNumTrees)
            scored = predict(model, names, test)
        scored = scored.withColumn("fold", F.lit(fold))
        found = scored if found is None else found.unionByName(scored)
    found = stored(found, "out-of-fold")
    marked.unpersist()
    return found


def final_rounds(grown: list[int], least: int = 50, most: int = 1000) -> int:
    """A tenth more trees than the folds needed on average, 50 at least and 1,000 at most."""
    return min(most, max(least, int(1.1 * sum(grown) / len(grown)))) if grown else least


@dataclass
class Scorer:
    """A fitted model with all that scoring new pairs needs."""

    model: object
    names: list[str]
    calibrator: dict
    threshold: float

    def score(self, features: DataFrame) -> DataFrame:
        """(s1, cand, calibrated_score) of any pairs; a missing feature column raises."""
        missing = set(self.names) - set(features.columns)
        if missing:
            raise ValueError(f"no column {', '.join(sorted(missing))}")
        return predict(self.model, self.names, features.select(S1, CAND, *self.names)).select(S1, CAND, calibrated(F.col("raw_score"), self.calibrator).alias("calibrated_score"))

    def save(self, path: str) -> None:
        spark = SparkSession.active()
        self.model.write().overwrite().save(f"{path}/model")
        meta = json.dumps({"names": self.names, "calibrator": self.calibrator, "threshold": self.threshold})
        spark.createDataFrame([(meta,)], "value string").coalesce(1).write.mode("overwrite").text(f"{path}/metadata")

    @staticmethod
    def load(path: str) -> Scorer:
        meta = json.loads(SparkSession.active().read.text(f"{path}/metadata").first()[0])
        if missing := {"names", "calibrator", "threshold"} - set(meta):
            raise ValueError(f"no {', '.join(sorted(missing))} in the metadata")
        return Scorer(GBTClassificationModel.load(f"{path}/model"), meta["names"], meta["calibrator"], meta["threshold"])


def train(labelled: DataFrame, manifest: DataFrame, folds: int = 5, rounds: int = ROUNDS, seed: int = 42, strata: str | None = None) -> tuple[Scorer, DataFrame]:
    """A scorer fitted on all pairs, and their cross-fitted out-of-fold scores, by which its threshold was chosen.

    The final model has as many trees as ``final_rounds`` says; its calibrator is fitted on the out-of-fold scores.
    """
    grown: list[int] = []
    out = out_of_fold(labelled, folds, rounds, seed, strata, grown)
    scored = stored(cross_fitted(out, folds), "calibrated")
    truth = labelled.where("label = 1").select(S1, CAND)
    sweep = decide.threshold_sweep(scored, truth, manifest, decide.threshold_grid(scored))
    best = decide.best_threshold(sweep).first()
    names = feature_names(labelled)
    model, _ = fit_trees(mask_country(labelled, seed=seed) if "country_equal" in names else labelled, names, final_rounds(grown), early=False)
    return Scorer(model, names, fit_calibrator(out), best.threshold if best else 0.5), scored


def held_out_country(labelled: DataFrame, country: str, rounds: int = ROUNDS) -> tuple[DataFrame, DataFrame]:
    """Scores of one country's pairs by a model trained on the others, and their average precision."""
    is_it = F.col("left_country_canonical") == country
    model, names = fit_trees(labelled.where(~is_it), rounds=rounds)
    scored = stored(predict(model, names, labelled.where(is_it)), "held-out")
    return scored, average_precision(scored, "raw_score")


def monotone_audit(model, names: list[str], features: DataFrame) -> DataFrame:
    """(feature, expected, change): how the mean score changes when a feature goes from its tenth to its ninetieth percentile.

    The trees have no constraints; a feature whose change goes against ``monotone`` shows here, one pass for each feature.
    """
    expected = {n: d for n, d in monotone(names).items() if d}
    ready = filled(features)
    ends = ready.agg(*[F.percentile_approx(n, [0.1, 0.9], 1000).alias(n) for n in expected]).first()
    rows = []
    for n, direction in expected.items():
        low, high = (predict(model, names, ready.withColumn(n, F.lit(float(x)))).agg(F.avg("raw_score")).first()[0] for x in (ends[n] or [0.0, 0.0]))
        rows.append((n, direction, float((high or 0.0) - (low or 0.0))))
    return features.sparkSession.createDataFrame(rows, "feature string, expected int, change double")


def importance(model, names: list[str], spark) -> DataFrame:
    return spark.createDataFrame([(n, float(w)) for n, w in zip(names, model.featureImportances.toArray())], "feature string, gain double").orderBy(F.desc("gain"), "feature")


def fit_calibrator(scored: DataFrame, score: str = "raw_score") -> dict:
    """Platt below 1,000 positives, isotonic from 10,000 on, between them the one of less log loss."""
    positives, n = scored.agg(F.sum("label"), F.count(F.lit(1))).first()
    choices = (["logistic"] if (positives or 0) < 10_000 else []) + (["isotonic"] if (positives or 0) >= 1_000 else [])
    fitted = [_fit_one(scored, score, kind, n) for kind in choices]
    if len(fitted) == 1:
        return fitted[0]
    losses = [log_loss(scored.withColumn("_p", calibrated(F.col(score), c)), "_p") for c in fitted]
    return fitted[losses.index(min(losses))]


def _fit_one(scored: DataFrame, score: str, kind: str, n: int) -> dict:
    if kind == "logistic":
        x = VectorAssembler(inputCols=[score], outputCol="_x").transform(scored)
        model = LogisticRegression(featuresCol="_x", labelCol="label", regParam=1.0 / max(1, n), standardization=False).fit(x)
        return {"method": "logistic", "coef": float(model.coefficients[0]), "intercept": float(model.intercept)}
    model = IsotonicRegression(featuresCol=score, labelCol="label").fit(scored)
    return {"method": "isotonic", "x_thresholds": [float(v) for v in model.boundaries], "y_thresholds": [float(v) for v in model.predictions]}


def calibrated(score: Column, calibrator: dict) -> Column:
    """A saved calibrator applied to a score."""
    if calibrator["method"] == "logistic":
        logit = F.greatest(F.lit(-500.0), F.least(F.lit(500.0), score * calibrator["coef"] + calibrator["intercept"]))
        return 1 / (1 + F.exp(-logit))
    xs, ys = calibrator["x_thresholds"], calibrator["y_thresholds"]
    x, y = F.array(*map(F.lit, xs)), F.array(*map(F.lit, ys))
    at = F.greatest(F.lit(1), F.least(F.lit(max(1, len(xs) - 1)), F.size(F.filter(x, lambda v: v <= score))))
    x0, x1, y0, y1 = F.element_at(x, at), F.try_element_at(x, at + 1), F.element_at(y, at), F.try_element_at(y, at + 1)
    between = F.when(x1.isNull() | (x1 == x0), y0).otherwise(y0 + (y1 - y0) * (score - x0) / (x1 - x0))
    return F.when(score <= xs[0], ys[0]).when(score >= xs[-1], ys[-1]).otherwise(between)


def log_loss(scored: DataFrame, p: str) -> float:
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    return scored.agg(F.avg(-F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q)))).first()[0]


def calibration_bins(scored: DataFrame, p: str = "p", bins: int = 10) -> DataFrame:
    """(bin, n, mean_p, mean_y) over equal bins, the last closed."""
    return scored.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).cast("int").alias("bin")).agg(F.count(F.lit(1)).alias("n"), F.round(F.avg(p), 6).alias("mean_p"), F.round(F.avg("label"), 6).alias("mean_y"))


def calibration_metrics(scored: DataFrame, p: str = "p", bins: int = 10) -> DataFrame:
    """One row: expected calibration error, Brier score and log loss."""
    per = scored.groupBy(F.least(F.floor(F.col(p) * bins), F.lit(bins - 1)).alias("_b")).agg(F.count(F.lit(1)).alias("n"), F.avg(p).alias("mp"), F.avg("label").alias("my"))
    ece = per.agg((F.sum(F.abs(F.col("mp") - F.col("my")) * F.col("n")) / F.sum("n")).alias("ece"))
    q = F.greatest(F.lit(1e-15), F.least(F.lit(1 - 1e-15), F.col(p)))
    rest = scored.agg(F.avg((F.col(p) - F.col("label")) * (F.col(p) - F.col("label"))).alias("brier"), F.avg(-F.when(F.col("label") == 1, F.log(q)).otherwise(F.log(1 - q))).alias("log_loss"))
    return ece.crossJoin(rest).select(*[F.round(c, 6).alias(c) for c in ("ece", "brier", "log_loss")])


def cross_fitted(scored: DataFrame, folds: int = 5) -> DataFrame:
    """Calibrated scores of every fold by a calibrator fitted on the others; raw ones where that has one class."""
    marked, found = scored.withColumn("_fold", fold_of(F.col(S1), folds)), None
    for fold in range(folds):
        train, test = marked.where(F.col("_fold") != fold), marked.where(F.col("_fold") == fold)
        one_class = train.select("label").distinct().count() < 2
        out = test.withColumn("calibrated_score", F.col("raw_score") if one_class else calibrated(F.col("raw_score"), fit_calibrator(train)))
        found = out if found is None else found.unionByName(out)
    return found.drop("_fold")
