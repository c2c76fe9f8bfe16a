"""Evaluation: classifier, retrieval and margin metrics, gates, recall audits and profiles."""

from __future__ import annotations

import hashlib

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlink.functions import similarity as S
from cairnlink.functions.tokens import words
from cairnlink.operators import dense

S1, CAND = "source1_entity_id", "candidate_entity_id"


def average_precision(scored: DataFrame, score: str = "score", label: str = "label", bins: int = 1000) -> DataFrame:
    """Step-wise average precision over the distinct scores, highest first.

    Running counts go by ``bins`` ranges of the score: within a range in its own task, over the ranges in one of as many rows.
    """
    by = scored.groupBy(F.col(score).cast("double").alias("s")).agg(F.count(F.lit(1)).alias("n"), F.sum(label).alias("hit"))
    ends = by.agg(F.min("s").alias("low"), F.max("s").alias("high"), F.sum("hit").alias("total"))
    place = F.when(F.col("high") > F.col("low"), F.least(F.floor((F.col("s") - F.col("low")) / (F.col("high") - F.col("low")) * bins), F.lit(bins - 1))).otherwise(0)
    placed = by.crossJoin(F.broadcast(ends)).withColumn("bin", place)  # one row
    down = Window.orderBy(F.desc("bin")).rowsBetween(Window.unboundedPreceding, -1)
    before = placed.groupBy("bin").agg(F.sum("n").alias("_n"), F.sum("hit").alias("_hit"))
    before = before.select("bin", F.coalesce(F.sum("_n").over(down), F.lit(0)).alias("n_before"), F.coalesce(F.sum("_hit").over(down), F.lit(0)).alias("hit_before"))
    run = Window.partitionBy("bin").orderBy(F.desc("s")).rowsBetween(Window.unboundedPreceding, 0)
    cum = placed.join(F.broadcast(before), "bin").withColumns({"seen": F.col("n_before") + F.sum("n").over(run), "right": F.col("hit_before") + F.sum("hit").over(run)})  # as many rows as bins
    return cum.agg(F.round(F.sum(F.col("hit") / F.col("total") * F.col("right") / F.col("seen")), 6).alias("average_precision"))


def classifier_metrics(scored: DataFrame, score: str = "score", label: str = "label", cut: float = 0.5) -> DataFrame:
    yes, is_ = (F.col(score) >= cut).cast("int"), F.col(label)
    c = scored.agg(F.count(F.lit(1)).alias("n"), F.sum(yes * is_).alias("tp"), F.sum(yes * (1 - is_)).alias("fp"), F.sum((1 - yes) * is_).alias("fn"))
    p, r = F.col("tp") / F.nullif(F.col("tp") + F.col("fp"), F.lit(0)), F.col("tp") / F.nullif(F.col("tp") + F.col("fn"), F.lit(0))
    f = lambda b: F.coalesce((1 + b) * p * r / F.nullif(b * p + r, F.lit(0.0)), F.lit(0.0))
    return c.select(*[F.round(x, 6).alias(n) for n, x in {"accuracy": 1 - (F.col("fp") + F.col("fn")) / F.col("n"), "precision": F.coalesce(p, F.lit(0.0)), "recall": F.coalesce(r, F.lit(0.0)), "f1": f(1.0), "pair_f05": f(0.25)}.items()])


def matcher_gate(ap: float, accuracy: float, least_ap: float = 0.75, least_accuracy: float = 0.80) -> bool:
    return ap >= least_ap and accuracy >= least_accuracy


def retrieval_metrics(queries: DataFrame, corpus: DataFrame, relevant: DataFrame, ks: tuple[int, ...] = (1, 5, 10)) -> DataFrame:
    """One row: mean recall@k and precision@k, reciprocal rank of the first hit over the whole ranking and over the first ten.

    ``relevant`` has pairs (q, c). The best rows come from a search, the rank of the first hit from a count of the rows above it.
    """
    top = dense.search(queries, corpus, max(*ks, 10)).join(relevant.select("q", "c").distinct(), ["q", "c"], "left_semi")
    totals = relevant.select("q", "c").distinct().groupBy("q").agg(F.count(F.lit(1)).alias("total"))
    hits = [F.count(F.when(F.col("rank") <= k, 1)).alias(f"h{k}") for k in ks]
    first = dense.pair_similarities(relevant, queries, corpus).groupBy("q").agg(F.min(F.struct((-F.col("sim")).alias("less"), "c")).alias("b")).select("q", (-F.col("b.less")).alias("sim"), "b.c")
    ranks = dense.count_above(first, queries, corpus).select("q", (F.col("above") + 1).alias("first"))
    per = totals.join(top.groupBy("q").agg(*hits), "q", "left").join(ranks, "q", "left").na.fill(0, [f"h{k}" for k in ks])
    means = [F.round(F.avg(F.col(f"h{k}") / F.col("total")), 6).alias(f"recall_at_{k}") for k in ks] + [F.round(F.avg(F.col(f"h{k}") / k), 6).alias(f"precision_at_{k}") for k in ks]
    rr = F.coalesce(1.0 / F.col("first"), F.lit(0.0))
    return per.agg(*means, F.round(F.avg(rr), 6).alias("mrr"), F.round(F.avg(F.when(F.col("first") <= 10, rr).otherwise(0.0)), 6).alias("mrr_at_10"))


def margins(queries: DataFrame, corpus: DataFrame, relevant: DataFrame) -> DataFrame:
    """(q, margin): best relevant less best other similarity. One row more than a query has relevant ones holds the best other."""
    pairs = relevant.select("q", "c").distinct()
    most = pairs.groupBy("q").count().agg(F.max("count")).first()[0] or 0
    no = dense.search(queries, corpus, most + 1).join(pairs, ["q", "c"], "left_anti").groupBy("q").agg(F.max("sim").alias("no"))
    yes = dense.pair_similarities(pairs, queries, corpus).groupBy("q").agg(F.max("sim").alias("yes"))
    return yes.join(no, "q").select("q", (F.col("yes") - F.col("no")).alias("margin"))


def margin_analysis(margin: DataFrame, cuts: tuple[float, ...] = (0.10, 0.30)) -> DataFrame:
    passed = [F.round(F.avg((F.col("margin") >= c).cast("double")), 6).alias(f"pass_{int(c * 100):02d}") for c in cuts]
    return margin.agg(F.count(F.lit(1)).alias("n"), F.round(F.avg("margin"), 6).alias("mean_margin"), F.round(F.expr("percentile(margin, 0.5)"), 6).alias("median_margin"), *passed)


def go_no_go(recall_10: float, baseline_recall_10: float, pass_30: float, baseline_pass_30: float, pass_10: float) -> dict[str, bool]:
    """recall@10 of 0.80, a gap to the baseline of 0.05, 15 % more pairs with margin 0.30, 0.60 with margin 0.10."""
    gates = {"recall": recall_10 >= 0.80, "gap": baseline_recall_10 - recall_10 <= 0.05, "gain": pass_30 >= 1.15 * baseline_pass_30, "margin": pass_10 >= 0.60}
    return gates | {"go": all(gates.values())}


def blocking_summary(hits: DataFrame, manifest: DataFrame) -> DataFrame:
    """One row: pairs, and mean, median, p90, p95 and maximum of candidates of an S1, interpolated."""
    per = manifest.select(S1).join(hits.groupBy(S1).agg(F.count(F.lit(1)).alias("n")), S1, "left").select(F.coalesce("n", F.lit(0)).alias("n"))
    return per.agg(
        F.count(F.lit(1)).alias("entities"), F.sum("n").alias("pairs"), F.round(F.avg("n"), 6).alias("mean"), F.expr("percentile(n, 0.5)").alias("median"),
        F.round(F.expr("percentile(n, 0.9)"), 6).alias("p90"), F.round(F.expr("percentile(n, 0.95)"), 6).alias("p95"), F.max("n").alias("most"),
    )


def index_percentile(values: DataFrame, column: str, q: float) -> DataFrame:
    """The value at place int(n * q) of the sorted ones, from counts of distinct values."""
    counts = values.groupBy(column).count()
    run = Window.orderBy(column).rowsBetween(Window.unboundedPreceding, 0)
    n = values.agg(F.count(F.lit(1)).alias("n"))
    cum = counts.withColumn("upto", F.sum("count").over(run)).crossJoin(F.broadcast(n))  # one row
    return cum.where(F.col("upto") > F.floor(F.col("n") * q)).agg(F.min(column).alias("value"))


def channel_counts(hits: DataFrame) -> DataFrame:
    return hits.select(F.explode(F.split("blocker_provenance", ",")).alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("pairs"))


def recall_audit(hits: DataFrame, truth: DataFrame, by: str | None = None) -> DataFrame:
    """Pair recall, and shares of S1 with all and with any of their matches found; over all or by a column of the truth."""
    marked = truth.join(hits.select(S1, CAND, F.lit(1).alias("_hit")).distinct(), [S1, CAND], "left")
    keys = [by] if by else []
    per = marked.groupBy(S1, *keys).agg(F.count(F.lit(1)).alias("n"), F.count("_hit").alias("hit"))
    out = per.groupBy(*keys).agg(
        F.sum("n").alias("pairs"), F.round(F.sum("hit") / F.sum("n"), 6).alias("pair_recall"), F.count(F.lit(1)).alias("entities"),
        F.round(F.avg((F.col("n") == F.col("hit")).cast("double")), 6).alias("full_recall"), F.round(F.avg((F.col("hit") > 0).cast("double")), 6).alias("any_hit"),
    )
    return out


def recall_by_channel(hits: DataFrame, truth: DataFrame) -> DataFrame:
    """Share of all true pairs that each channel found."""
    total = truth.agg(F.count(F.lit(1)).alias("total"))
    found = truth.join(hits, [S1, CAND]).select(F.explode(F.split("blocker_provenance", ",")).alias("channel")).groupBy("channel").agg(F.count(F.lit(1)).alias("found"))
    return found.crossJoin(F.broadcast(total)).select("channel", "found", F.round(F.col("found") / F.col("total"), 6).alias("recall"))  # one row


def match_degrees(truth: DataFrame) -> DataFrame:
    return truth.groupBy(S1).agg(F.count(F.lit(1)).alias("degree")).groupBy("degree").agg(F.count(F.lit(1)).alias("entities"))


def multiple_claims(truth: DataFrame) -> DataFrame:
    return truth.groupBy(CAND).agg(F.countDistinct(S1).alias("claims")).where("claims > 1")


def missingness(feed: DataFrame) -> DataFrame:
    """By source: rows, shares without address and with non-ASCII names, and lengths of names."""
    from cairnlink.functions.normalize import is_missing_address, source_of

    rows = feed.select(source_of(F.col("entity_id")).alias("source"), is_missing_address(F.col("business_address")).cast("double").alias("gone"), F.col("business_name").rlike(r"[^\x00-\x7F]").cast("double").alias("wide"), F.length("business_name").alias("len"))
    return rows.groupBy("source").agg(
        F.count(F.lit(1)).alias("n"), F.round(F.avg("gone"), 6).alias("missing_address"), F.round(F.avg("wide"), 6).alias("non_ascii"), F.round(F.avg("len"), 6).alias("mean_length"),
        F.expr("percentile(len, 0.5)").alias("median_length"), F.expr("percentile(len, 0.95)").alias("p95_length"), F.max("len").alias("longest"),
    )


def match_split(truth: DataFrame) -> DataFrame:
    """(kind, entities): S1 records with matches in S2 only, in S3 only or in both, and how many have several in one source."""
    per = truth.groupBy(S1).agg(F.sum(F.col(CAND).startswith("S2-").cast("int")).alias("two"), F.sum(F.col(CAND).startswith("S3-").cast("int")).alias("three"))
    kinds = F.array(F.when((F.col("two") > 0) & (F.col("three") > 0), "both").when(F.col("two") > 0, "s2_only").otherwise("s3_only"), F.when(F.col("two") > 1, "several_s2"), F.when(F.col("three") > 1, "several_s3"))
    return per.select(F.explode(F.array_compact(kinds)).alias("kind")).groupBy("kind").agg(F.count(F.lit(1)).alias("entities"))


def pair_profile(positives: DataFrame, negatives: DataFrame, records: DataFrame, cuts: tuple[float, ...] = (0.2, 0.3, 0.4)) -> DataFrame:
    """(label, n, and of each similarity mean and median, and the share of name_jaccard at each cut) of true and other pairs."""
    slim = records.select("entity_id", "norm_name", "norm_address")
    both = positives.select(S1, CAND, F.lit(1).alias("label")).unionByName(negatives.select(S1, CAND, F.lit(0).alias("label")))
    both = both.join(slim.toDF(S1, "ln", "la"), S1).join(slim.toDF(CAND, "rn", "ra"), CAND)
    ln, rn, la, ra = (F.col(c) for c in ("ln", "rn", "la", "ra"))
    measures = {
        "name_exact": ((ln == rn) & (ln != "")).cast("double"), "name_jaccard": S.jaccard(words(ln), words(rn)), "name_edit": S.edit_similarity(ln, rn),
        "address_exact": ((la == ra) & (la != "")).cast("double"), "address_jaccard": S.jaccard(words(la), words(ra)), "address_edit": S.edit_similarity(la, ra),
    }
    rows = both.select("label", *[x.alias(c) for c, x in measures.items()])
    numbers = [f for c in measures for f in (F.round(F.avg(c), 6).alias(f"{c}_mean"), F.round(F.expr(f"percentile({c}, 0.5)"), 6).alias(f"{c}_median"))]
    kept = [F.round(F.avg((F.col("name_jaccard") >= c).cast("double")), 6).alias(f"kept_{int(c * 100):02d}") for c in cuts]
    return rows.groupBy("label").agg(F.count(F.lit(1)).alias("n"), *numbers, *kept)


def fingerprint(spark, paths: list[str]) -> str:
    """16 hex digits of the names and sizes of the files below the paths: stored stages of other sources are known by it."""
    found = []
    for path in paths:
        where = spark._jvm.org.apache.hadoop.fs.Path(path)
        files = where.getFileSystem(spark._jsc.hadoopConfiguration()).listFiles(where, True)
        while files.hasNext():
            one = files.next()
            found.append(f"{one.getPath().getName()}:{one.getLen()}")
    return hashlib.md5("|".join(sorted(found)).encode()).hexdigest()[:16]


def dataset_statistics(manifest: DataFrame, candidates: DataFrame, truth: DataFrame) -> DataFrame:
    """One row: S1 rows, candidate rows, positive pairs, S1 without match, and the size of the full product."""
    one, two = manifest.agg(F.count(F.lit(1)).alias("s1_rows")), candidates.agg(F.count(F.lit(1)).alias("candidate_rows"))
    pairs = truth.agg(F.count(F.lit(1)).alias("positive_pairs"), F.countDistinct(S1).alias("_with"))
    all_ = one.crossJoin(two).crossJoin(pairs)  # one row each
    return all_.select("s1_rows", "candidate_rows", "positive_pairs", (F.col("s1_rows") - F.col("_with")).alias("singletons"), (F.col("s1_rows") * F.col("candidate_rows")).alias("full_product"))


def country_label_pivot(labelled: DataFrame, country: str) -> DataFrame:
    pivot = labelled.groupBy(F.col(country).alias("country")).pivot("label", [0, 1]).count()
    return pivot.select("country", F.coalesce("0", F.lit(0)).alias("negatives"), F.coalesce("1", F.lit(0)).alias("positives"))
