"""The whole linkage pipeline with its stage boundaries as tables."""

from __future__ import annotations

from dataclasses import dataclass, field

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from cairnlink.functions.normalize import normalize_records
from cairnlink.operators import decide, pairs, scoring
from cairnlink.operators.blocking import Blocking, fields, generate
from cairnlink.sources.tables import as_feed, stored


@dataclass(frozen=True)
class Linkage:
    """Settings of a run. With a ``folder`` every stage is stored there and ``skip`` names those to read instead; without one
    records and hits are stored in the shared folder and the rest is one plan, which makes only the features that are used.
    """

    blocking: Blocking = field(default_factory=Blocking)
    threshold: float = 0.5
    injective: bool = True
    rounds: int = scoring.ROUNDS
    model: str | None = None
    folder: str | None = None
    skip: tuple[str, ...] = ()
    ascii_bounds: bool = False


def plain_score(features: DataFrame) -> DataFrame:
    """A fixed weighted score, for runs without training data."""
    score = 0.5 * F.col("name_jaccard") + 0.3 * F.col("address_jaccard") + 0.2 * F.col("name_char_trigram_jaccard")
    return features.select("source1_entity_id", "candidate_entity_id", F.round(score, 6).alias("calibrated_score"))


def run(feed: DataFrame, truth: DataFrame | None = None, settings: Linkage = Linkage()) -> DataFrame:
    """Match lists of all S1 records of a feed.

    With a truth, trees are trained: its pairs get out-of-fold scores, and the folder, if there is one, the fitted scorer.
    With a saved ``model`` pairs are scored by it. Else a fixed weighted score decides.
    """
    spark = feed.sparkSession

    def stage(name: str, make) -> DataFrame:
        if settings.folder is None:
            return stored(make(), name) if name in ("records", "hits") else make()
        path = f"{settings.folder}/{name}"
        if name not in settings.skip:
            make().write.mode("overwrite").parquet(path)
        return spark.read.parquet(path)

    def normalized() -> DataFrame:
        rows = normalize_records(as_feed(feed), ascii_bounds=settings.ascii_bounds)
        return rows if settings.folder is not None else rows.select(*fields(settings.blocking), "country")

    records = stage("records", normalized)
    hits = stage("hits", lambda: generate(records, settings.blocking, checkpoint=True))
    features = stage("features", lambda: pairs.pair_features(hits, records))

    manifest = records.where("source = 'S1'").select(F.col("entity_id").alias("source1_entity_id"))

    def score() -> DataFrame:
        if settings.model is not None:
            return scoring.Scorer.load(settings.model).score(features)
        if truth is None:
            return plain_score(features)
        scorer, scored = scoring.train(scoring.attach_labels(features, truth), manifest, rounds=settings.rounds, strata="left_country_canonical")
        if settings.folder is not None:
            scorer.save(f"{settings.folder}/scorer")
        return scored.select("source1_entity_id", "candidate_entity_id", "calibrated_score")

    scored = stage("scored", score)
    return decide.match_lists(scored, manifest, settings.threshold, settings.injective)
