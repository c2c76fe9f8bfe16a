import itertools
import random

import duckdb
import pytest
from pyspark.sql import functions as F

from cairnlink.functions import similarity as S
from cairnlink.operators import blocking, decide, scoring, validate
from cairnlink.plans import pipeline
from cairnlink.plans.catalogue import QUERIES
from cairnlink.sources import tables
from cairnlink.streaming import incremental

FEED = [
    ("S1-101", "Harbour Lane Bakery", "12 Quay Street, Portmouth, OR", "US"),
    ("S1-102", "Quick Lend", "88 Millstone Road, Dunmore, TX", "US"),
    ("S1-103", "Sagar Stationery Mart", "41, Lotus Colony Block C, Pune, Maharashtra", "India"),
    ("S1-104", "Northwind Advisory LLC", "ME, Bangor, 700 Alder Avenue", "US"),
    ("S2-201", "Harbor Lane Bakery Corp", "12 Quay St, Portmouth, OR 97401", "USA"),
    ("S2-202", "Quick Lend Services", "88 Millstone Rd, Dunmore, TX", "US"),
    ("S2-203", "Sagar Stationary Mart", "Near Axis ATM, 41 Lotus Colony Block C, Pune 411001", "India"),
    ("S2-204", "Unrelated Trading Inc", "5 Elsewhere St, Town, ST", "India"),
    ("S3-301", "Harbour Lane Bakery", "##12 Quay St, Portmouth", "US"),
    ("S3-302", "Sagar Stationery Mart Pvt Ltd", "41 Lotus Colony, Pune", "Bharat"),
]
SCHEMA = "entity_id string, business_name string, business_address string, country string"
PAIR = "source1_entity_id string, candidate_entity_id string"


@pytest.fixture(scope="module")
def feed(spark):
    return spark.createDataFrame(FEED, SCHEMA)


def test_pipeline_links_the_feed(spark, feed):
    found = {r[0]: set(filter(None, r[1].split(","))) for r in pipeline.run(feed, settings=pipeline.Linkage(threshold=0.3)).collect()}
    assert found["S1-101"] == {"S2-201", "S3-301"}
    assert found["S1-102"] == {"S2-202"}
    assert "S3-302" in found["S1-103"]
    assert found["S1-104"] == set()


def test_cap_and_exact_first(spark, feed):
    from cairnlink.functions.normalize import normalize_records

    hits = blocking.generate(normalize_records(feed), blocking.Blocking.fast(1))
    assert hits.groupBy("source1_entity_id").count().where("count > 1").isEmpty()
    multi = blocking.generate(normalize_records(feed), blocking.Blocking.multi())
    assert multi.where("candidate_entity_id like 'S1-%'").isEmpty()


def test_other_engine_by_hand(spark):
    """Dispatch, global document frequencies, close addresses and alphabetical provenance, worked out by hand."""
    rows = [
        ("S1-1", "alpha beta", "9 harbour walk", "narnia"),  # no candidate of its country: '' and then all others
        ("S1-2", "gamma delta", "77 orchard close", "us"),  # india is known and differs
        ("S1-3", "omega sigma", "", ""),  # without country: everywhere
        ("S2-1", "alpha beta", "", "france"),
        ("S2-2", "gamma delta", "", "india"),
        ("S2-3", "gamma delta", "", ""),
        ("S2-4", "omega sigma", "", "india"),
        ("S2-5", "zeta kappa", "77 orchard close", "us"),
    ]
    from cairnlink.functions.normalize import normalize_records

    hits = blocking.generate(normalize_records(spark.createDataFrame(rows, SCHEMA)), blocking.Blocking.multi()).collect()
    found = {(r.source1_entity_id, r.candidate_entity_id): r for r in hits}
    assert set(found) == {("S1-1", "S2-1"), ("S1-2", "S2-3"), ("S1-2", "S2-5"), ("S1-3", "S2-4")}
    names = found["S1-1", "S2-1"].blocker_provenance.split(",")
    assert names == sorted(names) and {"exact_name", "first_2_tokens", "sorted_name_tokens", "token_inverted"} <= set(names) and found["S1-1", "S2-1"].blocker_count == len(names)
    assert found["S1-2", "S2-5"].blocker_provenance == "address_tokens" and found["S1-2", "S2-5"].best_blocker_score >= 0.75
    frequency = blocking.document_frequency(blocking.prepare(normalize_records(spark.createDataFrame(rows[3:], SCHEMA)), blocking.Blocking.multi()).withColumn("country", F.lit("")), "name_terms")
    assert {r.term: r.df for r in frequency.collect()}["gamma"] == 2


def test_dense_search(spark):
    """Blocks of queries, groups, floors and counts against numpy."""
    import numpy as np

    from cairnlink.operators import dense, evaluate

    draw = np.random.default_rng(2)
    rows = [(i, [float(x) for x in np.round(draw.normal(size=5), 2)], ["", "us", "india"][i % 3]) for i in range(90)] + [(500, None, "us")]
    df = spark.createDataFrame(rows, 'id long, vector array<double>, `group` string').repartition(3)
    asked = df.where("id % 4 = 0")
    all_ = np.array([r[1] for r in rows[:90]])
    sims = np.round(all_ @ all_.T, 6)
    wanted = {(q, c, k + 1) for q in range(0, 90, 4) for k, c in enumerate(sorted((x for x in range(90) if x != q), key=lambda x: (-sims[q, x], x))[:4])}
    for block in (4096, 5):
        assert {(r.q, r.c, r.rank) for r in dense.search(asked, df, 4, block=block).collect()} == wanted
    allow = lambda one, two: (one[:, None] == two[None, :]) | (two == "")[None, :]
    near = {(q, c) for q in range(0, 90, 4) for c in sorted((x for x in range(90) if x != q and x % 3 in (q % 3, 0) and sims[q, x] >= 0.5), key=lambda x: (-sims[q, x], x))[:4]}
    assert {(r.q, r.c) for r in dense.search(asked, df, 4, floor=0.5, allow=allow).collect()} == near
    relevant = spark.createDataFrame([(q, (q + d) % 90) for q in range(0, 90, 4) for d in (7, 30)], "q long, c long")
    got = evaluate.retrieval_metrics(asked.drop("group"), df.drop("group"), relevant).first()
    ranks = [min(1 + sum((sims[q, x], -x) > (sims[q, c], -c) for x in range(90) if x != q) for c in ((q + 7) % 90, (q + 30) % 90)) for q in range(0, 90, 4)]
    assert got.mrr == pytest.approx(np.mean([1 / r for r in ranks]), abs=1e-5)
    margin = {r.q: r.margin for r in evaluate.margins(asked.drop("group"), df.drop("group"), relevant).collect()}
    for q in range(0, 90, 4):
        good = {(q + 7) % 90, (q + 30) % 90}
        assert margin[q] == pytest.approx(max(sims[q, c] for c in good) - max(sims[q, c] for c in range(90) if c != q and c not in good))


def test_average_precision_by_ranges(spark):
    from cairnlink.operators import evaluate

    draw = random.Random(8)
    rows = [(draw.randrange(40) / 40, int(draw.random() < 0.3)) for _ in range(400)]
    total, seen, right, wanted = sum(y for _, y in rows), 0, 0, 0.0
    for s in sorted({s for s, _ in rows}, reverse=True):
        hit = sum(y for x, y in rows if x == s)
        seen, right = seen + sum(x == s for x, _ in rows), right + hit
        wanted += hit / total * right / seen
    df = spark.createDataFrame(rows, "score double, label int")
    for bins in (1000, 3, 1):
        assert evaluate.average_precision(df, bins=bins).first()[0] == pytest.approx(wanted, abs=1e-6)


def test_scorer_is_saved_and_scores_new_pairs(spark, tmp_path):
    draw = random.Random(9)
    rows = [(f"S1-{i % 80}", f"S2-{i}", int(i % 4 == 0), (0.8 if i % 4 == 0 else 0.2) + draw.uniform(-0.3, 0.3), draw.random(), "us" if i // 4 % 2 else "india") for i in range(400)]
    labelled = spark.createDataFrame(rows, f"{PAIR}, label int, name_jaccard double, noise double, left_country_canonical string")
    manifest = labelled.select("source1_entity_id").distinct()
    folds = scoring.with_folds(labelled, 5, strata="left_country_canonical")
    assert folds.groupBy("source1_entity_id").agg(F.countDistinct("fold").alias("n")).where("n > 1").isEmpty() and folds.select("fold").distinct().count() == 5
    scorer, scored = scoring.train(labelled, manifest, folds=3, rounds=10)
    assert scored.count() == 400 and 0 <= scorer.threshold <= 1
    scorer.save(f"{tmp_path}/scorer")
    again = scoring.Scorer.load(f"{tmp_path}/scorer")
    assert sorted(map(tuple, again.score(labelled).collect())) == sorted(map(tuple, scorer.score(labelled).collect()))
    means = {r.label: r.m for r in again.score(labelled).join(labelled, PAIR.replace(" string", "").split(", ")).groupBy("label").agg(F.avg("calibrated_score").alias("m")).collect()}
    assert means[1] > 0.6 > 0.4 > means[0]
    with pytest.raises(ValueError, match="noise"):
        again.score(labelled.drop("noise"))
    assert scoring.held_out_country(labelled, "india", 5)[1].first()[0] > 0.8
    audit = {r.feature: r.change for r in scoring.monotone_audit(scorer.model, scorer.names, labelled).collect()}
    assert audit["name_jaccard"] > 0
    assert [scoring.final_rounds(x) for x in ([], [10, 20], [200, 400], [2000])] == [50, 50, 330, 1000]


def test_threshold_grid(spark):
    few = spark.createDataFrame([("S1-1", "S2-1", 0.123), ("S1-1", "S1-2", 0.777)], f"{PAIR}, calibrated_score double")
    grid = decide.threshold_grid(few)
    assert grid == sorted({0.0, *[round(0.05 + 0.01 * i, 2) for i in range(91)], 1.0, 0.123})
    many = spark.range(5000).select(F.lit("S1-1").alias("source1_entity_id"), F.concat(F.lit("S2-"), "id").alias("candidate_entity_id"), (F.col("id") / 5000).alias("calibrated_score"))
    assert 150 < len(decide.threshold_grid(many)) <= 193


def test_tfidf_cosine(spark):
    import math
    from collections import Counter

    from cairnlink.operators import pairs

    texts = {"a": "blue moon cafe", "b": "blue moon café", "c": "iron works", "d": "", "e": "x"}

    def grams(text):
        out = []
        for w in text.split():
            w = f" {w} "
            for n in (3, 4, 5):
                out += [w[i : i + n] for i in range(len(w) - n + 1)] if len(w) >= n else ([w] if n == 3 else [])
        return Counter(out)

    fit = ["a", "c"]
    df = Counter(g for t in fit for g in grams(texts[t]))
    vector = {t: {g: (1 + math.log(n)) * (math.log(3 / (1 + df[g])) + 1) for g, n in grams(x).items() if g in df} for t, x in texts.items()}
    cosine = lambda x, y: sum(w * y.get(g, 0) for g, w in x.items()) / (math.sqrt(sum(w * w for w in x.values()) * sum(w * w for w in y.values())) or 1)
    asked = [("a", "b"), ("a", "c"), ("a", "d"), ("e", "b"), ("a", "a")]
    found = pairs.tfidf_cosine(spark.createDataFrame(asked, PAIR), spark.createDataFrame(list(texts.items()), "id string, text string"), spark.createDataFrame([(t,) for t in fit], "id string"))
    assert {(r[0], r[1]): round(r[2], 6) for r in found.collect()} == {(x, y): round(cosine(vector[x], vector[y]), 6) for x, y in asked}


def test_grams_by_one_pass(spark):
    from cairnlink.functions import tokens as T

    texts = ["", "ab", "abc", "a😀b😀c", "é\nx ýz", "aaaa"]
    rows = spark.createDataFrame([(i, x) for i, x in enumerate(texts)], "i int, x string")
    for n in (3, 4):
        found = {r.i: r.g for r in rows.select("i", T.grams(F.col("x"), n).alias("g")).collect()}
        assert [found[i] for i in range(len(texts))] == [[x[j : j + n] for j in range(len(x) - n + 1)] for x in texts]


def test_link_stream(spark, feed, tmp_path):
    from cairnlink.functions.normalize import normalize_records

    records = normalize_records(feed)
    for i in range(2):
        feed.where("entity_id like 'S1-%'").where(f"substring(entity_id, 6, 1) % 2 = {i}").write.parquet(f"{tmp_path}/in/part{i}")
    stream = incremental.normalized_stream(spark, f"{tmp_path}/in/*")
    incremental.link_stream(stream, records, f"{tmp_path}/out", f"{tmp_path}/check").awaitTermination(120)
    columns = ["source1_entity_id", "candidate_entity_id", "blocker_provenance", "best_blocker_score"]
    assert sorted(map(tuple, spark.read.parquet(f"{tmp_path}/out").select(columns).collect())) == sorted(map(tuple, blocking.generate(records).select(columns).collect()))


def test_command_line(spark, feed, tmp_path):
    from cairnlink.__main__ import main

    for i in (1, 2, 3):
        tables.write_results(feed.where(f"entity_id like 'S{i}-%'"), f"{tmp_path}/s{i}")
    truth = spark.createDataFrame([("S1-101", "S2-201,S3-301"), ("S1-102", "S2-202"), ("S1-103", "S2-203,S3-302"), ("S1-104", "")], "source1_entity_id string, matched_entity_ids string")
    tables.write_results(truth, f"{tmp_path}/truth")
    w = lambda line: [x.replace("@", str(tmp_path)) for x in line.split()]
    assert main(w("run --source1 @/s1 --source2 @/s2 --source3 @/s3 --output-dir @/run --threshold 0.3")) == 0
    found = {r[0]: r[1] for r in tables.read_tsv(spark, f"{tmp_path}/run/matching_results").collect()}
    assert len(found) == 4 and found["S1-102"] == "S2-202"
    assert main(w("run --source1 @/s1 --source2 @/s2 --source3 @/s3 --output-dir @/run --threshold 0.99 --skip-records --skip-hits --skip-features --skip-scored")) == 0
    assert main(w("normalize --source @/s1 @/s2 @/s3 --out @/records")) == 0
    assert main(w("block --records @/records --out @/blocks --cap 5")) == 0
    hits = tables.read_provenance(spark, f"{tmp_path}/blocks/candidate_provenance")
    assert hits.count() == spark.read.parquet(f"{tmp_path}/blocks/hits").count() == tables.read_candidates(spark, f"{tmp_path}/blocks/candidate_pairs").count()
    assert tables.with_provenance(tables.read_candidates(spark, f"{tmp_path}/blocks/candidate_pairs", 1), hits).where("blocker_count is null").isEmpty()
    assert spark.read.json(f"{tmp_path}/blocks/blocking_summary").first().entities == 4
    assert main(w("features --records @/records --hits @/blocks/hits --out @/features")) == 0
    assert main(w("train --features @/features/features --records @/records --ground-truth @/truth --out @/model --folds 2 --rounds 2")) == 0
    assert main(w("score --features @/features/features --model @/model --out @/scored")) == 0
    assert main(w("sweep --scored @/scored --records @/records --ground-truth @/truth --out @/sweep")) == 0
    assert main(w("decide --scored @/scored --records @/records --out @/results --threshold 0.0")) == 0
    assert main(w("validate --results @/results --records @/records --candidates @/blocks/candidate_pairs")) == 0
    assert main(w("package --results @/results --records @/records --candidates @/blocks/candidate_pairs --out @/all.zip")) == 0
    import zipfile

    assert zipfile.ZipFile(f"{tmp_path}/all.zip").namelist() == ["matching_results.tsv", "candidate_pairs.tsv"]
    tables.write_results(truth.where("source1_entity_id <> 'S1-104'"), f"{tmp_path}/short")
    assert main(w("package --results @/short --records @/records --out @/none.zip")) == 1


def test_embeddings_from_npz(spark, tmp_path):
    import numpy as np

    np.savez(f"{tmp_path}/e.npz", candidate_ids=np.array(["S2-1", "S2-2"]), candidate_embeddings=np.array([[3.0, 4.0], [0.0, 0.0]], np.float32))
    found = {r[0]: r[1] for r in tables.read_embeddings(spark, f"{tmp_path}/e.npz").collect()}
    assert found["S2-1"] == pytest.approx([0.6, 0.8]) and found["S2-2"] == [0.0, 0.0]


def test_encoder_hook(spark):
    from cairnlink.operators import pairs

    rows = spark.createDataFrame([(i, "x" * i) for i in range(5)], "id long, text string")
    assert {r.id: r.vector for r in pairs.encode(rows, lambda texts: [[float(len(t)), 1.0] for t in texts], 2).collect()} == {i: [float(i), 1.0] for i in range(5)}


def test_truth_is_linear_in_copies(spark, tmp_path):
    spark.createDataFrame([(i, "same", "en") for i in range(60)] + [(60, None, "en"), (61, None, "en")], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = tables.truth_of_documents(spark, str(tmp_path))
    assert found.count() == 2 * 40 and {r[0] for r in found.collect()} == {"S1-0", "S1-57"}


def test_claims_equal_greedy(spark):
    draw = random.Random(3)
    rows = list({(f"S1-{draw.randrange(8)}", f"S2-{draw.randrange(9)}"): draw.randrange(5) / 4 for _ in range(60)}.items())
    scored = spark.createDataFrame([(a, b, s) for (a, b), s in rows], f"{PAIR}, calibrated_score double")
    taken = {}
    for (a, b), s in sorted(rows, key=lambda x: (-x[1], x[0][0])):
        taken.setdefault(b, a)
    assert {r[1]: r[0] for r in decide.claims(scored).collect()} == taken


def test_sweep_equals_direct(spark):
    draw = random.Random(4)
    pairs = {(f"S1-{draw.randrange(6)}", f"S{draw.choice('23')}-{draw.randrange(12)}"): draw.randrange(11) / 10 for _ in range(50)}
    scored = spark.createDataFrame([(a, b, s) for (a, b), s in pairs.items()], f"{PAIR}, calibrated_score double")
    truth = spark.createDataFrame([x for x in pairs if draw.random() < 0.4], PAIR)
    manifest = spark.createDataFrame([(f"S1-{i}",) for i in range(8)], "source1_entity_id string")
    for injective in (True, False):
        swept = {r.threshold: r.macro_f05 for r in decide.threshold_sweep(scored, truth, manifest, [0.0, 0.35, 0.7, 1.0], injective).collect()}
        for t, value in swept.items():
            assert decide.macro_f_half(scored, truth, manifest, t, injective).first().macro_f05 == pytest.approx(value, abs=1e-5)


def test_f_half_values(spark):
    row = spark.range(1).select(decide.f_half(F.lit(3), F.lit(2), F.lit(2)), decide.f_half(F.lit(0), F.lit(0), F.lit(0))).first()
    assert row[0] == pytest.approx(0.714, abs=1e-3) and row[1] == 1.0


def test_bad_scored_input_raises(spark):
    scored = spark.createDataFrame([("S1-1", "S2-1", float("nan")), ("S1-9", "S2-1", 0.5)], f"{PAIR}, calibrated_score double")
    manifest = spark.createDataFrame([("S1-1",)], "source1_entity_id string")
    with pytest.raises(ValueError, match="finite.*unknown"):
        decide.check_scored(scored, manifest, 0.5)
    with pytest.raises(ValueError, match="threshold"):
        decide.check_scored(scored, manifest, 1.5)


def test_indel_family():
    assert S.indel_ratio("abcd", "abxd") == pytest.approx(0.75)
    assert S.token_sort_ratio_of("b a", "a b") == 1.0
    assert S.token_set_ratio_of("a b c", "a b") == 1.0
    assert S.token_set_ratio_of("", "a") == 0.0


def test_indel_ratio_by_table(spark):
    """The bit-parallel ratio against the plain table of common subsequences, and the token forms against their definition."""
    draw = random.Random(5)

    def ratio(a, b):
        row = [0] * (len(b) + 1)
        for x in a:
            row, old = [0], row
            for j, y in enumerate(b):
                row.append(old[j] + 1 if x == y else max(old[j + 1], row[-1]))
        return 2 * row[-1] / (len(a) + len(b)) if a or b else 1.0

    for _ in range(300):
        a, b = (" ".join("".join(draw.choices("abcé", k=draw.randint(1, 30))) for _ in range(draw.randint(0, 4))) for _ in range(2))
        assert S.indel_ratio(a, b) == pytest.approx(ratio(a, b))
        assert S.token_sort_ratio_of(a, b) == pytest.approx(ratio(" ".join(sorted(a.split())), " ".join(sorted(b.split()))))
    pairs = [("b a", "a b"), ("x y z", "x y"), ("", "a"), ("p q", "r s"), ("same", "same"), (None, "a")]
    rows = spark.createDataFrame([(i, *x) for i, x in enumerate(pairs)], "i int, a string, b string")
    found = {r.i: (r.s, r.t) for r in rows.select("i", S.token_sort_ratio(F.col("a"), F.col("b")).alias("s"), S.token_set_ratio(F.col("a"), F.col("b")).alias("t")).collect()}
    assert found[0] == (1.0, 1.0) and found[1][1] == 1.0 and found[2] == (0.0, 0.0) and found[4] == (1.0, 1.0)


def test_masking_weights_and_gates(spark):
    from cairnlink.operators import evaluate

    rows = spark.range(4000).select(F.concat(F.lit("S1-"), F.col("id") % 900).alias("source1_entity_id"), F.concat(F.lit("S2-"), "id").alias("candidate_entity_id"), F.lit(1).alias("country_equal"), F.lit(0).alias("country_equal_missing"), (F.col("id") % 5 == 0).cast("int").alias("label"))
    masked = scoring.mask_country(rows).agg(F.avg((F.col("country_equal") == -1).cast("int")).alias("share"), F.avg("country_equal_missing").alias("flag")).first()
    assert masked.share == masked.flag and abs(masked.share - 0.15) < 0.03
    assert {r.label: r.weight for r in scoring.weighted(rows).select("label", "weight").distinct().collect()} == {0: 1.0, 1: 4.0}
    assert evaluate.matcher_gate(0.75, 0.80) and not evaluate.matcher_gate(0.74, 0.9)
    assert evaluate.go_no_go(0.85, 0.88, 0.46, 0.40, 0.61)["go"] and not evaluate.go_no_go(0.85, 0.95, 0.46, 0.40, 0.61)["go"]
    assert decide.allowed_pairs(spark.createDataFrame([("S1-1", "S1-1"), ("S1-1", "S2-1"), ("S2-1", "S2-1")], PAIR)).count() == 1


def test_folds_keep_entities_together(spark):
    rows = spark.range(500).select(F.concat(F.lit("S1-"), F.col("id") % 50).alias("s"))
    assert rows.withColumn("f", scoring.fold_of(F.col("s"))).groupBy("s").agg(F.countDistinct("f").alias("n")).where("n > 1").isEmpty()


def test_isotonic_interpolates(spark):
    curve = {"method": "isotonic", "x_thresholds": [0.0, 0.5, 1.0], "y_thresholds": [0.1, 0.3, 0.9]}
    rows = spark.createDataFrame([(-1.0, 0.1), (0.25, 0.2), (0.5, 0.3), (0.75, 0.6), (2.0, 0.9)], "x double, y double")
    assert rows.where(F.abs(scoring.calibrated(F.col("x"), curve) - F.col("y")) > 1e-9).isEmpty()


def test_validator_rules(spark):
    results = spark.createDataFrame([("S1-1", "S2-1,S2-1"), ("S1-2", "S1-9"), ("S1-2", "Q-1"), ("S1-7", "")], "source1_entity_id string, matched_entity_ids string")
    required = spark.createDataFrame([("S1-1",), ("S1-2",), ("S1-3",)], "source1_entity_id string")
    rules = {r.rule for r in validate.result_findings(results, required).collect()}
    assert rules == {"duplicate_row", "duplicate_id", "self_id", "bad_prefix", "missing_row", "extra_row"}


def test_feed_takes_whole_lines(spark, tmp_path):
    """Lines that differ only far behind stay different, and words there reach the records."""
    long = "word " * 400
    texts = [f"{long}left\n{long}street\nrest", f"{long}right\n{long}road", "one line", "", None]
    spark.createDataFrame([(i, x, "en") for i, x in enumerate(texts)], "doc_id long, text string, lang string").write.parquet(f"{tmp_path}/documents.parquet")
    found = {r.doc_id: (r.business_name, r.business_address) for r in tables.feed_of_documents(spark, str(tmp_path)).collect()}
    wanted = [(x.split("\n") + [""])[:2] for x in texts[:4]]
    assert [found[i] for i in range(4)] == [tuple(x) for x in wanted] and found[4] == (None, "")
    names = {r.entity_id: r.name for r in QUERIES["nfkc_names"](spark, str(tmp_path)).collect()}
    assert names["S1-0"].startswith(f"{long}left") and names["S2-1"].startswith(f"{long}right")


def test_stream_normalises(spark, feed, tmp_path):
    feed.write.parquet(f"{tmp_path}/in")
    stream = incremental.normalized_stream(spark, f"{tmp_path}/in")
    done = stream.writeStream.format("memory").queryName("records").trigger(availableNow=True).start()
    done.awaitTermination(60)
    assert spark.table("records").count() == len(FEED)


def test_tfidf_cosine_by_table_and_by_vectors(spark):
    """Vectors made beside their pairs equal those that travel, and the former need no shuffle of grams."""
    from cairnlink.operators import pairs

    draw = random.Random(11)
    words = ["ñandú", "Quay", "é", "x😀y", "bakery", "a"]
    texts = spark.createDataFrame([(f"T{i}", None if i == 5 else " ".join(draw.choice(words) for _ in range(i % 7))) for i in range(30)], "id string, text string")
    asked = spark.createDataFrame([(f"T{i}", f"T{j}") for i in range(31) for j in range(0, 30, 4)], PAIR)
    for fit in (None, texts.where("id < 'T2'").select("id")):
        one, two = ({(r[0], r[1]): r[2] for r in pairs.tfidf_cosine(asked, texts, fit, most).collect()} for most in (10**6, 0))
        assert len(one) == 31 * 8 and one == pytest.approx(two, abs=1e-12)
    plan = pairs.tfidf_cosine(asked, texts)._jdf.queryExecution().executedPlan().toString()
    assert "Generate" not in plan


def test_ratios_are_measured_once_for_each_pair_of_texts(spark, tmp_path):
    from cairnlink.plans import catalogue

    names = ["large ring", "ring large", None, "", "hot bolt x"]
    rows = [(i, names[i % 5], ("BIG TIN", "TIN")[i % 2], "B1" if i % 3 else None, i % 2) for i in range(60)]
    spark.createDataFrame(rows, "p_partkey long, p_name string, p_type string, p_brand string, p_size int").write.parquet(f"{tmp_path}/part.parquet")
    found, direct = (sorted(map(tuple, catalogue._ratios(spark, str(tmp_path), most).collect()), key=str) for most in (1000, 0))
    assert found == direct and found
    query = QUERIES["token_sort_ratio"](spark, str(tmp_path))
    assert "ArrowEvalPython" not in query._jdf.queryExecution().executedPlan().toString()


def test_shared_weights_are_summed_and_rounded_as_in_sql(spark):
    """Sums that fall on a half do not depend on the order of rows; single weights on a half round as in the SQL's engine."""
    groups = [[2.095513148, 7.422844795, 2.930549557], [7.17568016, 7.42446466, 2.00109068], [8.393719208, 8.349512695, 7.107903597]]
    rows = [(f"{g}-{i}", w) for g, group in enumerate(groups) for i, order in enumerate(itertools.permutations(group)) for w in order]
    rows += [(f"s-{w}", w) for w in (1.0000025, 1.0000075, 1.0000105, 1.0000185)]
    found = {r["g"]: r["raw"] for r in spark.createDataFrame(rows, "g string, w double").coalesce(1).groupBy("g").agg(blocking.shared_weight(F.col("w")).alias("raw")).collect()}
    for g in range(len(groups)):
        assert len({raw for name, raw in found.items() if name.startswith(f"{g}-")}) == 1
    engine = duckdb.connect()
    for name, raw in found.items():
        if name.startswith("s-"):
            assert raw == engine.execute("select round(?::double, 6)", [float(name[2:])]).fetchone()[0]


def test_dispatch_leaves_records_in_place(spark):
    """Whatever Spark thinks of sizes: records with their terms are not shuffled by country."""
    rows = spark.createDataFrame([("S1-1", "us"), ("S1-2", "fr"), ("S1-3", "")], "id string, country string")
    held = spark.createDataFrame([("S2-1", "us")], "id string, country string")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        sent = blocking.dispatch(rows, held)
        assert "SortMergeJoin" not in sent._jdf.queryExecution().executedPlan().toString()
        assert {(r.id, r.country) for r in sent.collect()} == {("S1-1", "us"), ("S1-2", ""), ("S1-3", "")}
    finally:
        spark.conf.unset("spark.sql.autoBroadcastJoinThreshold")


def test_long_keys_travel_as_digests(spark):
    keys = blocking.short_keys(spark.createDataFrame([("S1-1", "x" * 400), ("S2-1", "x" * 400), ("S2-2", "short"), ("S2-3", "é" * 13)], "id string, key string")).collect()
    assert [len(r.key) for r in keys] == [16, 16, 5, 16] and keys[0].key == keys[1].key and bytes(keys[2].key) == b"short"
