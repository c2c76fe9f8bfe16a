"""Command line: python -m cairnlink <command>; each stage reads and writes tables, ``run`` goes through all of them."""

from __future__ import annotations

import argparse
import json
import sys
import zipfile

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from cairnlink.functions.normalize import normalize_records
from cairnlink.operators import decide, evaluate, pairs, scoring, validate
from cairnlink.operators.blocking import Blocking, generate
from cairnlink.plans import pipeline
from cairnlink.sources import tables

S1, CAND = "source1_entity_id", "candidate_entity_id"


def _blocking(args) -> Blocking:
    return Blocking.multi(args.cap) if args.multi else Blocking.fast(args.cap)


def _manifest(records: DataFrame) -> DataFrame:
    return records.where("source = 'S1'").select(F.col("entity_id").alias(S1))


def _truth(spark: SparkSession, path: str) -> DataFrame:
    return tables.ground_truth_pairs(tables.read_tsv(spark, path))


def normalize(spark: SparkSession, args) -> None:
    tables.write_records(normalize_records(tables.as_feed(tables.read_tsv(spark, *args.source))), args.out, args.tsv)


def block(spark: SparkSession, args) -> None:
    records = spark.read.parquet(args.records)
    hits = tables.stored(generate(records, _blocking(args), checkpoint=True), "hits")
    tables.write_candidates(hits, _manifest(records), args.out)
    hits.write.mode("overwrite").parquet(f"{args.out}/hits")
    summary = evaluate.blocking_summary(hits, _manifest(records)).withColumn("fingerprint", F.lit(evaluate.fingerprint(spark, [args.records])))
    channels = evaluate.channel_counts(hits).agg(F.map_from_entries(F.collect_list(F.struct("channel", "pairs"))).alias("channels"))  # a row for each channel
    tables.write_json(summary.crossJoin(channels), f"{args.out}/blocking_summary")


def features(spark: SparkSession, args) -> None:
    made = pairs.pair_features(spark.read.parquet(args.hits), spark.read.parquet(args.records))
    tables.write_features(made, args.out, tsv=args.tsv)


def train(spark: SparkSession, args) -> None:
    labelled = scoring.attach_labels(spark.read.parquet(args.features), _truth(spark, args.ground_truth))
    scorer, scored = scoring.train(labelled, _manifest(spark.read.parquet(args.records)), args.folds, args.rounds, strata="left_country_canonical")
    scorer.save(args.out)
    scored.write.mode("overwrite").parquet(f"{args.out}/scored")
    print(json.dumps({"threshold": scorer.threshold, "features": len(scorer.names)}))


def score(spark: SparkSession, args) -> None:
    scoring.Scorer.load(args.model).score(spark.read.parquet(args.features)).write.mode("overwrite").parquet(args.out)


def decisions(spark: SparkSession, args) -> None:
    matched = decide.match_lists(spark.read.parquet(args.scored), _manifest(spark.read.parquet(args.records)), args.threshold, not args.all_matches, check=True)
    tables.write_results(matched, args.out)


def sweep(spark: SparkSession, args) -> None:
    scored = spark.read.parquet(args.scored)
    found = decide.threshold_sweep(scored, _truth(spark, args.ground_truth), _manifest(spark.read.parquet(args.records)), decide.threshold_grid(scored))
    found.write.mode("overwrite").options(**tables.WRITE_TSV).csv(args.out)
    print(json.dumps(decide.best_threshold(found).first().asDict()))


def _findings(spark: SparkSession, results: str, records: str, candidates: str | None) -> DataFrame:
    rows = spark.read.parquet(records)
    others = tables.read_tsv(spark, candidates) if candidates else None
    return validate.result_findings(tables.read_tsv(spark, results), _manifest(rows), rows.where("source <> 'S1'").select("entity_id"), others)


def check(spark: SparkSession, args) -> int:
    found = tables.stored(_findings(spark, args.results, args.records, args.candidates), "findings")
    for row in found.groupBy("rule", "level").count().orderBy("level", "rule").collect():
        print(f"{row.level}: {row.rule} ({row['count']})")
    return int(not found.where("level = 'error'").isEmpty())


def package(spark: SparkSession, args) -> int:
    """Result and candidate files as one zip, unless the validator objects. Files go through this machine one by one."""
    if not args.skip_validation and check(spark, args):
        print("not packaged", file=sys.stderr)
        return 1
    with zipfile.ZipFile(args.out, "w", zipfile.ZIP_DEFLATED) as out:
        for name, path in (("matching_results.tsv", args.results), ("candidate_pairs.tsv", args.candidates)):
            if path is None:
                continue
            rows = tables.read_tsv(spark, path)
            with out.open(name, "w", force_zip64=True) as f:
                f.write(("\t".join(rows.columns) + "\n").encode())
                for row in rows.orderBy(S1).toLocalIterator():
                    f.write(("\t".join(row) + "\n").encode())
        if args.documentation:
            out.write(args.documentation, "documentation.md")
    return 0


def run(spark: SparkSession, args) -> None:
    feed = tables.as_feed(tables.read_tsv(spark, *args.source1, *args.source2, *args.source3))
    truth = _truth(spark, args.ground_truth) if args.ground_truth else None
    skip = tuple(s for s in ("records", "hits", "features", "scored") if getattr(args, f"skip_{s}"))
    settings = pipeline.Linkage(_blocking(args), args.threshold, not args.all_matches, args.rounds, args.model, args.output_dir, skip)
    matched = pipeline.run(feed, truth, settings)
    if not args.skip_decision:
        tables.write_results(matched, f"{args.output_dir}/matching_results")


def parser() -> argparse.ArgumentParser:
    top = argparse.ArgumentParser(prog="cairnlink")
    commands = top.add_subparsers(required=True)

    def command(name: str, make, *needed: str) -> argparse.ArgumentParser:
        one = commands.add_parser(name)
        one.set_defaults(make=make)
        for option in needed:
            one.add_argument(f"--{option}", required=True)
        return one

    def limits(one: argparse.ArgumentParser) -> None:
        one.add_argument("--cap", "--max-candidates-per-entity", type=int, default=10, dest="cap")
        one.add_argument("--multi", action="store_true", help="the limits and dispatch of the multi-channel engine")

    one = command("normalize", normalize, "out")
    one.add_argument("--source", nargs="+", required=True)
    one.add_argument("--tsv", action="store_true")
    limits(command("block", block, "records", "out"))
    command("features", features, "records", "hits", "out").add_argument("--tsv", action="store_true")
    one = command("train", train, "features", "records", "ground-truth", "out")
    one.add_argument("--folds", type=int, default=5)
    one.add_argument("--rounds", type=int, default=scoring.ROUNDS)
    command("score", score, "features", "model", "out")
    one = command("decide", decisions, "scored", "records", "out")
    one.add_argument("--threshold", type=float, default=0.5)
    one.add_argument("--all-matches", action="store_true")
    command("sweep", sweep, "scored", "records", "ground-truth", "out")
    command("validate", check, "results", "records").add_argument("--candidates")
    one = command("package", package, "results", "records", "out")
    one.add_argument("--candidates")
    one.add_argument("--documentation")
    one.add_argument("--skip-validation", action="store_true")
    one = command("run", run, "output-dir")
    one.add_argument("--source1", nargs="+", required=True)
    for name in ("source2", "source3"):
        one.add_argument(f"--{name}", nargs="+", default=[])
    one.add_argument("--ground-truth")
    one.add_argument("--model", help="a saved scorer")
    one.add_argument("--threshold", type=float, default=0.5)
    one.add_argument("--rounds", type=int, default=scoring.ROUNDS)
    one.add_argument("--all-matches", action="store_true")
    for name in ("records", "hits", "features", "scored", "decision"):
        one.add_argument(f"--skip-{name}", action="store_true", help=f"read {name} of an earlier run" if name != "decision" else None)
    limits(one)
    return top


def main(words: list[str] | None = None) -> int:
    args = parser().parse_args(words)
    spark = SparkSession.getActiveSession() or SparkSession.builder.appName("cairnlink").config("spark.sql.session.timeZone", "UTC").getOrCreate()
    return args.make(spark, args) or 0


if __name__ == "__main__":
    sys.exit(main())
