"""All measures of a pair of texts against plain loops and the Column measures."""

import random

import pytest
from pyspark.sql import functions as F

from cairnlink.functions import similarity as S
from cairnlink.functions import tokens as T
from cairnlink.operators import pairs


def distance(a, b):
    row = list(range(len(b) + 1))
    for i, c in enumerate(a, 1):
        new = [i]
        for j, d in enumerate(b, 1):
            new.append(min(row[j] + 1, new[-1] + 1, row[j - 1] + (c != d)))
        row = new
    return row[-1]


def test_edit_distances():
    """Several texts side by side, a few of them at a time, or a long one against short ones."""
    draw = random.Random(5)
    for _ in range(600):
        text, *others = ("".join(draw.choice("abcé\0😀") for _ in range(draw.randrange(1, 40))) for _ in range(draw.randrange(2, 9)))
        assert S.edit_distances(text, others, draw.choice([1, 30, 1000])) == [distance(text, x) for x in others]


def test_as_the_columns(spark):
    draw = random.Random(6)
    words = ["ab", "abc", "ΑΣ", "é2", "x_1", "12", "٣", "-", "😀", "İ", "a\nb", "第3"]
    texts = [None, "", " ", "--", *(" ".join(draw.choice(words) for _ in range(draw.randrange(1, 9))) for _ in range(40))]
    rows = spark.createDataFrame([(i, a, b) for i, (a, b) in enumerate((a, b) for a in texts for b in texts)], "i int, a string, b string").repartition(3)
    a, b = F.col("a"), F.col("b")
    sets = lambda of, measure: F.when(a == b, 1.0).otherwise(measure(of(a), of(b)))
    wanted = {
        "jaccard": sets(T.words, S.jaccard), "overlap": sets(T.words, S.overlap), "trigram_jaccard": sets(T.padded_trigrams, S.jaccard),
        "edit_similarity": S.edit_similarity(a, b), "number_overlap": S.overlap(T.numeric_tokens(a), T.numeric_tokens(b)),
    }
    found = S.text_measures(a, b)
    assert list(found) == list(wanted)
    different = rows.where("a is not null or b is not null").select("a", "b", *[F.struct(found[n], wanted[n]).alias(n) for n in wanted]).collect()
    assert len(different) == len(texts) ** 2 - 1
    for row in different:
        assert all(row[n][0] == row[n][1] for n in wanted), row


def test_words_are_those_of_the_columns(spark):
    """Every character of the basic plane that the JVM's tables and Python's both know."""
    import unicodedata

    known = [chr(i) for i in range(1, 0xD800) if unicodedata.category(chr(i)) != "Cn"]
    rows = spark.createDataFrame([(c,) for c in known], "c string").where(F.col("c").rlike(r"\P{Cn}"))
    differing = [r.c for r in rows.select("c", (F.size(T.words(F.col("c"))) > 0).alias("w")).collect() if r.w != bool(S._WORDS.findall(r.c.lower()))]
    assert differing == []


@pytest.mark.parametrize("wanted", ["name_edit_similarity", "address_jaccard"])
def test_pairs_are_measured_by_s1(spark, wanted):
    """Pairs of a much-claimed candidate are not dealt to one task, and no pair is measured by a walk over all cells."""
    records = spark.createDataFrame([(f"S{s}-{i}", "us", f"n{i} x", f"a{i} y", "") for s in (1, 2) for i in range(50)], "entity_id string, country string, norm_name string, norm_address string, postal_code string")
    hits = spark.createDataFrame([(f"S1-{i}", f"S2-{j}") for i in range(50) for j in {0, i}], "source1_entity_id string, candidate_entity_id string")
    held = {k: spark.conf.get(k) for k in ("spark.sql.autoBroadcastJoinThreshold", "spark.sql.adaptive.enabled")}
    try:
        for k, v in zip(held, ("-1", "false")):
            spark.conf.set(k, v)
        found = pairs.pair_features(hits, records, indel=False)
        plan = found.select(wanted)._jdf.queryExecution().executedPlan().toString()
        assert "levenshtein" not in plan and plan.count("ArrowEvalPython") == 1
        assert "source1_entity_id" in next(x for x in plan.splitlines() if "SortMergeJoin" in x)
        assert found.count() == 99
    finally:
        for k, v in held.items():
            spark.conf.set(k, v)


def test_trigrams_by_blocks():
    """A few texts at a time, and characters so high that only three texts go at once."""
    draw = random.Random(7)
    for alphabet in ("ab ", "abé\U0010ffff"):
        text, *others = ("".join(draw.choice(alphabet) for _ in range(draw.randrange(1, 20))) for _ in range(40))
        grams = lambda x: {f"  {x}  "[i : i + 3] for i in range(len(x) + 2)}
        wanted = [len(grams(text) & grams(x)) / len(grams(text) | grams(x)) for x in others]
        assert S.trigram_jaccards(text, others) == S.trigram_jaccards(text, others, 50) == wanted
