"""Term channels against plain loops; no row of a plan may stand for a pair before the best are chosen."""

import math
import random
from collections import Counter, defaultdict

import numpy as np
import pytest

from cairnlink.operators import blocking, postings

KIND = "id string, country string, terms array<string>, len int"


def plain(ones, candidates, channel, top):
    """(s1, cand, score, rank) by loops over all pairs."""
    df, n = Counter((c, t) for _, c, terms, _ in candidates for t in set(terms)), len(candidates)
    idf = {k: math.log(1 + (n - x + 0.5) / (x + 0.5)) for k, x in df.items() if x <= channel.most_documents}
    tf = defaultdict(Counter)
    for i, c, terms, _ in ones:
        tf[i].update((c, t) for t in terms if (c, t) in idf)
    found = []
    for i, counts in tf.items():
        heavy = sorted(((round((1 + math.log(x)) * idf[k], 9), k) for k, x in counts.items()), key=lambda x: (-x[0], x[1][1]))[: channel.terms]
        w, norm = {k: x for x, k in heavy}, math.sqrt(sum(x * x for x, _ in heavy))
        raw, length = Counter(), {}
        for j, c, terms, long in candidates:
            for t in set(terms):
                if (c, t) in w:
                    raw[j] += round(w[c, t] * 1e9)
                    length[j] = long
        best = sorted(((math.floor(x / 1e9 * 1e6 + 0.5) / 1e6, j) for j, x in raw.items()), key=lambda x: (-x[0], x[1]))[: channel.raw]
        scored = sorted(((round(min(1.0, x / (norm * math.sqrt(length[j]))), 6), j) for x, j in best), key=lambda x: (-x[0], x[1]))
        found += [(i, j, s, k + 1) for k, (s, j) in enumerate([x for x in scored if x[0] >= channel.floor][:top])]
    return sorted(found)


@pytest.mark.parametrize("limits", [{}, {"VOCABULARY": 7, "BLOCK": 9, "CHUNK": 12, "COUNTRIES": 1}])
@pytest.mark.parametrize("two", [False, True])
def test_term_hits(spark, monkeypatch, limits, two):
    """Ties, repeated ids, terms without match; ``two``: an S1 id and a candidate id with two countries."""
    for name, value in limits.items():
        monkeypatch.setattr(postings, name, value)
    draw = random.Random(4)

    def records(side, count):
        rows = [(f"{side}-{i}", ["", "us", "ü"][i % 3], [f"t{min(draw.randrange(40), draw.randrange(40))}" for _ in range(draw.randrange(9))]) for i in range(count)]
        rows += [(i, c, [*terms, "t39"]) for i, c, terms in rows[:4]] + ([("%s-1" % side, "", ["t1", "t7", "t30"])] if two else [])
        return [(i, c, terms, max(1, int(i.split("-")[1]) % 11)) for i, c, terms in rows]

    ones, candidates = records("S1", 50), records("S2", 160)
    channel = blocking.TermChannel("char_ngram", 25, 4, 0.2, 6)
    frames = [spark.createDataFrame(rows, KIND).repartition(3) for rows in (ones, candidates)]
    hits = blocking.term_hits(*frames, "terms", "len", channel, 4)
    wanted = plain(ones, candidates, channel, 4)
    assert len(wanted) > 100
    assert sorted((r.s1, r.cand, round(r.score, 6), r["rank"]) for r in hits.collect()) == wanted


def test_pairs_are_no_rows(spark):
    """300 by 300 records that share all terms: what is shuffled are records, not 90,000 pairs for each term."""
    rows = [(f"{side}-{i:03}", "us", ["a", "b", "c"], 3) for side in ("S1", "S2") for i in range(300)]
    frame = spark.createDataFrame(rows, KIND)
    hits = blocking.term_hits(frame.where("id like 'S1%'"), frame.where("id like 'S2%'"), "terms", "len", blocking.TermChannel("char_ngram", 5000, 15, 0.0, 150), 50)
    found = hits.collect()
    assert len(found) == 300 * 50 and {r.cand for r in found} == {f"S2-{i:03}" for i in range(50)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_none_at_all(spark):
    none = spark.createDataFrame([], KIND)
    some = spark.createDataFrame([("S1-1", "us", ["a"], 1)], KIND)
    channel = blocking.TermChannel("char_ngram", 25, 4, 0.2, 6)
    for pair in ((none, none), (some, none), (none, some)):
        assert blocking.term_hits(*pair, "terms", "len", channel, 4).collect() == []


def test_fallback_pairs_are_no_rows(spark):
    """The same under the other dispatch: S1 records reach candidates without country."""
    rows = [(f"{side}-{i:03}", country, ["a", "b", "c"], 3) for side, country in (("S1", "narnia"), ("S2", "")) for i in range(200)]
    frame = spark.createDataFrame(rows, KIND)
    channel = blocking.TermChannel("char_ngram", 5000, 15, 0.0, 150)
    hits = blocking.term_hits_by_fallback(frame.where("id like 'S1%'"), frame.where("id like 'S2%'"), "terms", "len", channel, 50)
    found = hits.collect()
    assert len(found) == 200 * 50 and {r.cand for r in found} == {f"S2-{i:03}" for i in range(50)}
    plan = hits._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "Aggregate" not in plan


def test_codes_are_packed():
    """Gaps of one to five bytes; a slice begins within the buffer."""
    draw = np.random.default_rng(2)
    for high in (60, 5000, 1 << 20, (1 << 31) - 1):
        rows = [np.unique(draw.integers(0, high, draw.integers(1, 40))) for _ in range(200)]
        column = postings.packed(np.concatenate(rows), np.array([len(x) for x in rows]))
        for low, count in ((0, 200), (70, 50)):
            codes, long = postings.unpacked(column.slice(low, count))
            assert codes.tolist() == np.concatenate(rows[low : low + count]).tolist() and long.tolist() == [len(x) for x in rows[low : low + count]]
    near = postings.packed(np.arange(1000, 2000), np.array([1000]))
    assert near.nbytes < 1100  # four bytes a code before


def test_few_ones_get_few_cells(spark):
    """Each candidate is sent to every cell: 200 S1 records are one cell, whatever the number of cores."""
    rows = [(f"{side}-{i:03}", country, ["a", "b", "c"], 3) for side, country in (("S1", "narnia"), ("S2", "")) for i in range(200)]
    frame = spark.createDataFrame(rows, KIND)
    channel = blocking.TermChannel("char_ngram", 5000, 15, 0.0, 150)
    hits = blocking.term_hits_by_fallback(frame.where("id like 'S1%'"), frame.where("id like 'S2%'"), "terms", "len", channel, 50)
    assert hits.rdd.getNumPartitions() == 1 and hits.count() == 200 * 50


def test_done_ones_take_no_part(spark):
    rows = [(f"{side}-{i}", "us", ["a", f"b{i}"], 2) for side in ("S1", "S2") for i in range(9)]
    frame = spark.createDataFrame(rows, KIND)
    channel = blocking.TermChannel("char_ngram", 5000, 15, 0.0, 150)
    done = spark.createDataFrame([("S1-4",), ("S1-4",), ("S1-7",)], "s1 string")
    for search in (blocking.term_hits, blocking.term_hits_by_fallback):
        one, two = frame.where("id like 'S1%'"), frame.where("id like 'S2%'")
        every, left = ({(r.s1, r.cand, r.score, r["rank"]) for r in search(one, two, "terms", "len", channel, 50, done=x).collect()} for x in (None, done))
        assert left == {x for x in every if x[0] not in ("S1-4", "S1-7")} and len(left) == 7 * 9
