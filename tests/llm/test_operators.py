"""Each operator against a brute-force version, and against nulls, empty texts, repeated rows and empty tables."""

import hashlib
import os
import random
import re
import tracemalloc
from collections import Counter, defaultdict
from fractions import Fraction
from pathlib import Path

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from cairnlink.llm import decontam, jaccard, licenses, mixing, sharding, substrings, token_shards, topk, toxicity, unigram
from cairnlink.llm.queries import word_count
from cairnlink.llm.shared import with_permuted
from cairnlink.llm.tokens import find_words

TOKENIZERS = "/opt/tokenizers"
DOCS = "doc_id long, text string, source string, row_no long, shard int"
ODD = [(None, "a b", "s", 1, 2), (1, None, None, 1, 2), (2, "", "s", 1, 2), (3, "a b c", "t", 1, 2), (3, "a b c", "t", 1, 2), (4, " \n\t ", "t", None, None), (5, "x " * 30_000, "t", 1, 2), *2 * [(6, " ".join(f"only{i}" for i in range(45)), "t", 1, 2)]]


def words(text):
    return re.findall(r"[^\x20\x09-\x0D]+", text or "")


def plain(text):
    return re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", re.sub("[A-Z]", lambda m: m[0].lower(), text or ""))


@pytest.fixture(scope="module")
def corpus(spark):
    """Prose from few words, with copies, near copies, shared passages, and the odd rows."""
    draw = random.Random(7)
    lexicon = ["the", "of", *("".join(draw.choices("abcdefgh", k=draw.randint(2, 9))) for _ in range(400))]
    passage = [draw.choice(lexicon) for _ in range(60)]
    rows = []
    for i in range(10, 150):
        text = [draw.choice(lexicon) for _ in range(draw.choice((3, 4, 19, 20, 21, 80, 200)))]
        if i % 7 == 0:
            text[len(text) // 2 : len(text) // 2] = passage
        rows.append((i, " ".join(text), f"s{i % 4}" if i % 3 else "s0", None, None))
    rows += [(200 + i, rows[i][1], "s0", None, None) for i in range(12)]
    for i in range(30):
        text = rows[i][1].split()
        text[draw.randrange(len(text))] = "changed"
        rows.append((300 + i, "\n".join(text), None, None, None))
    return spark.createDataFrame(rows + ODD, DOCS), rows + ODD


@pytest.fixture(scope="module")
def nothing(spark):
    return spark.createDataFrame([], DOCS)


def test_permutation(spark):
    for n in (1, 2, 3, 10, 97, 1000):
        rows = with_permuted(with_permuted(spark.range(n), "id", n, 5, "p"), "p", n, 5, "back", inverse=True).collect()
        assert sorted(r.p for r in rows) == list(range(n)) and all(r.id == r.back for r in rows)


def test_sharding(corpus, nothing):
    df, rows = corpus
    placed = sharding.shard_rows(df.select("doc_id", "text", "shard"), 7)
    found = placed.collect()
    by = defaultdict(list)
    for r in found:
        by[r.shard].append(r.slot)
    assert len(found) == len(rows) and max(map(len, by.values())) - min(map(len, by.values())) <= 1
    assert all(sorted(x) == list(range(len(x))) for x in by.values())
    again = sharding.shard_rows(df.select("doc_id", "text").repartition(9), 7).collect()
    assert Counter((r.doc_id, r.text, r.shard, r.slot) for r in found if r.doc_id not in (3, 6)) == Counter((r.doc_id, r.text, r.shard, r.slot) for r in again if r.doc_id not in (3, 6))
    assert sharding.row_of(placed.drop("row_no"), len(rows), 7, 2718281828).select("row_no").distinct().count() == len(rows)
    assert sharding.shard_rows(nothing.select("doc_id", "text"), 7).count() == 0


def test_mixing(corpus, nothing):
    df, rows = corpus
    mixed = mixing.mix(df.select("doc_id", "source", "shard", word_count().alias("size"))).collect()
    sizes = Counter()
    for r in rows:
        sizes[r[2]] += len(words(r[1]))
    order = sorted(sizes, key=lambda s: (s is None, s or ""))
    weight, target, total = {s: (5, 2, 1)[i % 3] for i, s in enumerate(order)}, {}, sum(sizes.values())
    free = set(order)
    while True:
        level = (total - sum(3 * sizes[s] for s in order if s not in free)) / sum(weight[s] for s in free)
        over = {s for s in free if weight[s] * level > 3 * sizes[s]}
        if not over:
            break
        free -= over
    target = {s: weight[s] * level if s in free else 3.0 * sizes[s] for s in order}
    taken = Counter()
    for r in mixed:
        assert r.target == pytest.approx(target[r.source]) and r.source_size == sizes[r.source] and 0 <= r.copies <= 3
        taken[r.source] += r.copies * r.size
    assert len(mixed) == len(rows)
    for s in order:
        assert abs(taken[s] - target[s]) <= max(30_000 if s == "t" else 0, 0.03 * target[s] + 5)
    again = mixing.mix(df.select("doc_id", "source", "shard", word_count().alias("size")).repartition(5)).collect()
    assert Counter((r.doc_id, r.size, r.copies) for r in mixed) == Counter((r.doc_id, r.size, r.copies) for r in again)
    assert mixing.mix(nothing.select("doc_id", "source", word_count().alias("size"))).count() == 0
    repeated = mixing.remix(df, word_count())
    assert repeated.columns == df.columns and repeated.count() == sum(r.copies for r in mixed)


def test_flight_keeps_probabilities():
    """Over many draws every row ends where it began on average: the moves are a martingale."""
    draw = np.random.default_rng(6)
    size, share = draw.integers(1, 400, 40), draw.uniform(0.1, 0.9, 40)
    order = np.argsort(-size, kind="stable")
    ends = np.mean([mixing.flight(share, size, order, draw.random(40)) for _ in range(3000)], 0)
    assert np.abs(ends - share).max() < 0.04


def test_flight_keeps_totals():
    draw = np.random.default_rng(1)
    for trial in range(120):
        n = int(draw.integers(1, 150))
        size = [draw.integers(1, 2000, n), draw.integers(1, 3, n), np.full(n, 7), np.where(draw.random(n) < 0.1, 5000, 3)][trial % 4]
        share = np.full(n, draw.random())
        moved = mixing.flight(share, size, np.argsort(-size, kind="stable"), draw.random(n))
        assert ((moved > 1e-7) & (moved < 1 - 1e-7)).sum() <= 2
        assert moved @ size == pytest.approx(share @ size, rel=1e-4) and moved.sum() == pytest.approx(share.sum(), abs=1e-3)


def _hits(masks, n, k):
    from itertools import combinations

    for gone in combinations(range(n), k):
        if not any(all(m == "-" or at + i not in gone for i, m in enumerate(mask)) for mask in masks for at in range(n - len(mask) + 1)):
            return False
    return True


def test_masks_miss_nothing():
    assert _hits(decontam.MASKS, 20, 4)
    assert all(_hits(decontam.SHORT_MASKS, n, n // 5) for n in range(8, 20))


def test_decontamination(spark, corpus, nothing):
    df, rows = corpus
    draw = random.Random(9)
    texts = {r[0]: plain(r[1]) for r in rows if r[0] is not None}
    items = []
    for i, d in enumerate([x for x in texts if 60 <= len(texts[x]) < 1000][:25]):
        part = texts[d][5 : 5 + draw.choice((6, 9, 15, 24, 40))]
        for _ in range(draw.randrange(6)):
            part[draw.randrange(len(part))] = "else"
        items.append((i, " ".join(part)))
    items += [(90, None), (91, ""), (92, "of")]
    bench = spark.createDataFrame(items, "item_id long, text string")

    def overlap(text, item):
        span = min(20, len(item))
        most = span // 5 if span >= 8 else 0
        for a in range(len(text) - span + 1):
            for b in range(len(item) - span + 1):
                if sum(x != y for x, y in zip(text[a : a + span], item[b : b + span])) <= most:
                    return True
        return False

    wanted = {(d, i) for d, t in texts.items() if len(t) < 1000 for i, x in items if plain(x) and overlap(t, plain(x))}
    for block in (decontam.BLOCK_WORDS, 100):
        marked = decontam.mark_overlaps(df, bench, block_words=block)
        found = {(r.doc_id, x.item_id) for r in marked.collect() for x in r.overlaps if r.doc_id is not None and len(texts[r.doc_id]) < 1000}
        assert found == wanted
    named = spark.createDataFrame([(f"i{i}", x) for i, x in items], "item_id string, text string")
    for block in (decontam.BLOCK_WORDS, 100):
        marked = decontam.mark_overlaps(df, named, block_words=block)
        assert {(r.doc_id, int(x.item_id[1:])) for r in marked.collect() for x in r.overlaps if r.doc_id is not None and len(texts[r.doc_id]) < 1000} == wanted
        assert marked.count() == len(rows)
    assert decontam.mark_overlaps(nothing, bench).count() == 0
    assert decontam.mark_overlaps(df, bench.limit(0)).where(~decontam.is_clean()).count() == 0


def test_token_shards(spark, corpus, nothing, tmp_path):
    import tiktoken

    df, rows = corpus
    folder = f"file://{tmp_path}/shards"
    made = token_shards.write_shards(df, folder, f"{TOKENIZERS}/byte_bpe_50k.tiktoken", length=64, per_shard=16).collect()
    ranks = token_shards.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    encode = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    n = len(made)
    assert sorted(r.slot for r in made) == list(range(n)) and {r.file for r in made} == {f"{folder}/shard-{r.shard:08d}.bin" for r in made}
    whole = token_shards.read_sequences(folder, 0, n)
    rows_of = spark.createDataFrame([(i,) for i in range(n)], "row_no long")
    place = {r.row_no: r.slot for r in with_permuted(rows_of, "row_no", n, 271_828, "slot").collect()}
    parts = df.select("text").withColumn("task", F.spark_partition_id()).collect()
    line = []
    for task in sorted({r.task for r in parts}):
        ids = [x for r in parts if r.task == task for x in [*encode(r.text or ""), token_shards.END_OF_TEXT]]
        ids += [token_shards.END_OF_TEXT] * (-len(ids) % 64)
        line += [ids[i : i + 64] for i in range(0, len(ids), 64)]
    assert len(line) == n and all(whole[place[i]].tolist() == x for i, x in enumerate(line))
    assert whole.shape == (n, 64) and np.array_equal(token_shards.read_sequences(folder, 14, 5), whole[14:19])
    got = Counter(x for x in whole.ravel().tolist() if x != token_shards.END_OF_TEXT)
    assert got == Counter(x for r in rows for x in encode(r[1] or ""))
    named = {d for r in made for d in r.doc_ids}
    assert named == {r[0] for r in rows}
    assert token_shards.write_shards(nothing, f"file://{tmp_path}/none", f"{TOKENIZERS}/byte_bpe_50k.tiktoken").count() == 0
    assert not [p for p in Path(f"{tmp_path}/shards").iterdir() if p.name.startswith(".shard")]


def test_encoder_is_exact():
    import pyarrow as pa
    import tiktoken

    texts = ["", None, " a", "a  b", "a 　b", "don't  'll it 's", "x\x1c y", "\n\n a", " ", "é è", "a b c d", "\x85 q", "end ", " start", "tab\t x"]
    ranks = token_shards.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    encode = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    ids, counts = token_shards.Encoder(ranks).batch(pa.array(texts))
    assert [x.tolist() for x in np.split(ids, np.cumsum(counts))[:-1]] == [encode(t or "") for t in texts]


def _shingles(text):
    w = plain(text)
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def test_jaccard(corpus, nothing):
    df, rows = corpus
    found = jaccard.link_texts(df).collect()
    sets = [_shingles(r[1]) for r in rows]
    near = [{j for j in range(len(rows)) if j != i and sets[i] and sets[j] and 5 * len(sets[i] & sets[j]) >= 4 * len(sets[i] | sets[j])} for i in range(len(rows))]
    assert Counter((r.doc_id, r.links) for r in found) == Counter((rows[i][0], len(near[i])) for i in range(len(rows)))
    root = list(range(len(rows)))
    for _ in rows:
        root = [min([root[i], *(root[j] for j in near[i])]) for i in range(len(rows))]
    least = {c: min((rows[i][0] for i in range(len(rows)) if root[i] == c and rows[i][0] is not None), default=None) for c in set(root)}
    assert Counter((r.doc_id, r.class_id) for r in found) == Counter((rows[i][0], least[root[i]]) for i in range(len(rows)))
    kept = jaccard.one_of_each(df).collect()
    assert len(kept) == len({c for i, c in enumerate(root) if sets[i]}) + sum(not s for s in sets)
    assert jaccard.link_texts(nothing).count() == 0


def test_depth_shortens():
    assert [jaccard.depth_for(0.8, r) for r in (0.5, 0.99, 0.9999)] == sorted((jaccard.depth_for(0.8, r) for r in (0.5, 0.99, 0.9999)), reverse=True)


def test_depths_are_each_texts_own():
    """A text of n shingles is matched by the shortest prefix that its least alike partner needs, and by none shorter."""
    bound = Fraction(4, 5)
    for n in (*range(1, 30), 400):
        least = min(Fraction(c, n + m - c) for m in range(1, 2 * n + 2) for c in range(1, min(n, m) + 1) if Fraction(c, n + m - c) >= bound)
        depth = jaccard.own_depths(np.array([n]), bound, 0.999)[0]
        missed = [(1 - float(least) ** d) ** jaccard.TREES for d in (depth, depth + 1)]
        assert missed[0] <= 0.001 and (depth == jaccard.MAX_DEPTH or missed[1] > 0.001)
    assert set(jaccard.own_depths(np.arange(1, 30), bound, 0.999)) == {6, 7, 8}


def test_forest_meets_by_prefix(spark):
    """Texts are connected just as a walk over all pairs connects them that share the shorter of their two prefixes."""
    draw, bits = random.Random(8), jaccard.tail_bits(6)
    rows = [(key, draw.randrange(12), *(draw.randrange(3) for _ in range(2)), draw.choice((6, 7, 7, 8, 8, 8))) for key in range(90)]
    forest = [(key, depth, [head], [(x * (depth > 6) << bits) | y * (depth > 7)], bytearray(jaccard.SKETCH)) for key, head, x, y, depth in rows]
    root = list(range(90))
    for _ in rows:
        for a, *one, da in rows:
            for b, *two, db in rows:
                if one[: min(da, db) - 5] == two[: min(da, db) - 5]:
                    root[a] = root[b] = min(root[a], root[b])
    edges = jaccard.meetings(spark.createDataFrame(forest, "key long, depth int, heads array<long>, tails array<long>, sketch binary"), 6)
    found = {r.node: r.root for r in jaccard.components(edges).collect()}
    assert [found.get(x, x) for x in range(90)] == root and len(set(root)) > 12


def test_branch_keeps_what_agrees():
    """Two texts of a branch that agree in SKETCH + LINKED - NEAR places are connected; texts that do not agree are not."""
    draw = np.random.default_rng(3)
    centres = draw.integers(0, 256, (6, jaccard.SKETCH))
    sketch = centres[draw.integers(0, 6, 120)].astype(np.uint8)
    for row in sketch:
        at = draw.integers(0, jaccard.SKETCH, draw.integers(0, 60))
        row[at] = draw.integers(0, 256, len(at))
    key = draw.permutation(1000)[:120]
    head = draw.integers(0, 2, 120)
    one, two = jaccard.branch_edges(head, np.zeros(120, np.int64), np.full(120, 6), key, sketch, 6)
    root = jaccard._roots(120, one, two)
    agree = (sketch[:, None] == sketch[None]).sum(2)
    must = (agree >= jaccard.SKETCH + jaccard.LINKED - jaccard.NEAR) & (head[:, None] == head[None])
    assert must.sum() > 300 and (root[:, None] == root[None])[must].all()
    assert (agree[one, two] >= jaccard.LINKED).all() and len(set(root.tolist())) >= 12


def test_crowded_heads_lose_nothing(spark, corpus):
    """With every head taken for a crowded one the links are the same."""
    df = corpus[0].select("doc_id", "text")
    wanted = sorted(map(tuple, jaccard.link_texts(df).collect()), key=str)
    real = jaccard.meetings
    try:
        jaccard.meetings = lambda signed, top: real(signed, top, 1)
        assert sorted(map(tuple, jaccard.link_texts(df).collect()), key=str) == wanted
    finally:
        jaccard.meetings = real


def test_components(spark):
    draw = random.Random(5)
    edges = [(draw.randrange(80), draw.randrange(80)) for _ in range(60)] + [(i, i + 1) for i in range(100, 140)]
    root = {x: x for e in edges for x in e}
    for _ in range(150):
        for a, b in edges:
            root[a] = root[b] = min(root[a], root[b])
    found = {r.node: r.root for r in jaccard.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert found == {x: root[x] for a, b in edges if a != b for x in (a, b)}


def test_substrings(corpus, nothing, monkeypatch):
    df, rows = corpus
    df = df.where("doc_id is not null")
    seen, wanted = {}, {}
    for d, text in sorted({(r[0], r[1]) for r in rows if r[0] is not None}, key=lambda x: x[0]):
        w = words(text)
        gone = [False] * len(w)
        for i in range(len(w) - 19):
            key = tuple(w[i : i + 20])
            if key in seen:
                gone[i : i + 20] = [True] * 20
            seen.setdefault(key, d)
        kept = " ".join(x for x, g in zip(w, gone) if not g)
        wanted[d] = (len(w), sum(gone), hashlib.sha256(kept.encode()).hexdigest())
    found = substrings.cut_repeats(df).collect()
    assert {r.doc_id: (r.n_words, r.n_removed, hashlib.sha256(r.kept_text.encode()).hexdigest()) for r in found} == wanted
    assert len(found) == len(rows) - 1 and all(sum(x.end - x.first for x in r.removed) == r.n_removed for r in found)
    assert substrings.cut_repeats(nothing).count() == 0


def test_top_k(spark):
    draw = random.Random(3)
    rows = [(i % 190, [draw.randrange(-5, 6) for _ in range(draw.choice((4, 4, 3, 0)))]) for i in range(200)] + [(None, [1]), (7, None)]
    df = spark.createDataFrame(rows, "vec_id long, v array<int>")
    real = [(i, d, v) for i, (d, v) in enumerate(rows) if d is not None and v is not None]
    wanted = []
    for i, d, v in real:
        if d % 50 == 0:
            best = sorted((-sum(a * b for a, b in zip(v, u)), c) for j, c, u in real if j != i)[:5]
            wanted += [(d, n + 1, c, -s) for n, (s, c) in enumerate(best)]
    for block in (4096, 2):
        assert sorted(map(tuple, topk.top_k(df, F.col("vec_id") % 50 == 0, 5, query_block=block).collect())) == sorted(wanted)
    assert topk.top_k(df.limit(0), F.col("vec_id") % 50 == 0).count() == 0


def test_token_counts(corpus, nothing):
    from tokenizers import Tokenizer, models, pre_tokenizers

    df, rows = corpus
    file = f"{TOKENIZERS}/piece_bpe_32k.model"
    whole = Tokenizer(models.Unigram(unigram.vocabulary(file), unk_id=0, byte_fallback=True))
    whole.pre_tokenizer = pre_tokenizers.Metaspace(replacement=unigram.MARK, prepend_scheme="always", split=True)
    found = Counter((r.doc_id, r.n_tokens) for r in unigram.count_tokens(df, file).collect())
    assert found == Counter((r[0], len(whole.encode(r[1] or "").ids)) for r in rows)
    assert unigram.count_tokens(nothing, file).count() == 0
    small = [("<unk>", 0.0), ("a", -1.0), ("b", -1.0), ("ab", -2.0), ("aba", -3.0), ("é", -1.5)]
    tied = Tokenizer(models.Unigram(small, unk_id=0))
    counter = unigram.Counter(small)
    for text in ("abab", "abaab", "xxa", "axxb", "éxé", "ababab"):
        assert counter.count(text) == len(tied.encode(text).ids)


def test_toxicity(spark, nothing):
    draw = random.Random(2)
    lexicon = ["".join(draw.choices("abcdefgh", k=6)) for _ in range(300)]
    texts, labels = [], []
    for i in range(600):
        bad = i % 4 == 0
        text = [draw.choice(lexicon) for _ in range(draw.randint(5, 60))]
        if bad:
            for _ in range(3):
                text.insert(draw.randrange(len(text)), draw.choice(("zounds", "villain", "knave")))
        texts.append((i, " ".join(text), None, None, None))
        labels.append((i, int(bad)))
    df, marks = spark.createDataFrame(texts + ODD[1:3], DOCS), spark.createDataFrame(labels + [(None, 1), (5, None)], "doc_id long, toxic int")
    tagger = toxicity.learn(df, marks, ~toxicity.held_out())
    scored = toxicity.score_texts(df, tagger).where("doc_id >= 10").collect()
    assert np.mean([(r.toxicity >= 0.5) == (r.doc_id % 4 == 0) for r in scored]) > 0.98
    spans = [r.text[s.start : s.end] for r in scored for s in r.toxic_spans if r.doc_id % 4 == 0]
    assert np.mean([any(w in s for w in ("zounds", "villain", "knave")) for s in spans]) > 0.95
    assert toxicity.learn(df, marks.where("toxic = 0"), F.lit(True)) == 0.0 and toxicity.learn(df, marks.limit(0), F.lit(True)) == 0.0
    assert toxicity.score_texts(nothing, tagger).count() == 0


def test_toxicity_sample(spark, monkeypatch):
    """1,000 toxic and 2,000 clean texts are fitted on, in a task; the driver never fits."""
    assert toxicity.SAMPLE == {1: 1000, 0: 2000}
    here = os.getpid()
    rows = [(i, f"word{i} " + ("villain knave" if i % 4 == 0 else "plain text"), None, None, None) for i in range(200)]
    marks = spark.createDataFrame([(i, int(i % 4 == 0)) for i in range(200)], "doc_id long, toxic int")
    monkeypatch.setattr(toxicity, "find_words", lambda *a, **k: pytest.fail("fitted on the driver") if os.getpid() == here else find_words(*a, **k))
    tagger = toxicity.learn(spark.createDataFrame(rows, DOCS), marks, F.lit(True))
    assert isinstance(tagger, toxicity.Tagger)


def test_least_hashes(spark):
    """The rows of least hash, though a few texts hold most ids; and whole long texts, up to the characters that are allowed."""
    rows = spark.range(3000).select(F.xxhash64("id").alias("_at"), F.col("id").cast("string").alias("_id"))
    wanted = [r._id for r in rows.orderBy("_at", "_id").limit(40).collect()]
    for ids in (3000, 100_000, 1):
        assert [r._id for r in toxicity._least(rows, 40, ids)] == wanted
    texts = [(i, f"word{i} " * (20_000 if i % 10 == 0 else 5) + ("villain" if i % 2 else ""), None, None, None) for i in range(100)]
    marks = spark.createDataFrame([(i, i % 2) for i in range(100)], "doc_id long, toxic int")
    taken = []
    real = toxicity.F.broadcast
    try:
        toxicity.F.broadcast = lambda df: taken.append(df.count()) or real(df)
        for characters in (10**9, 200_000):
            toxicity.learn(spark.createDataFrame(texts, DOCS), marks, F.lit(True), characters=characters)
    finally:
        toxicity.F.broadcast = real
    assert taken[0] == 100 and 50 < taken[1] < 100


def test_marginals_are_exact():
    from itertools import product

    draw = np.random.default_rng(4)
    trans, first = draw.normal(size=3), np.array([0, 0, 1, 5, 9, 9])
    unary = draw.normal(size=9)
    logit = toxicity.marginals(unary, first, trans)[2]
    for a, b in zip(first[:-1], first[1:]):
        odds = np.zeros((b - a, 2))
        for tags in product((0, 1), repeat=b - a):
            score = sum(unary[a + i] for i, t in enumerate(tags) if t) + sum((0, trans[0], trans[1], trans[2])[2 * x + y] for x, y in zip(tags, tags[1:]))
            for i, t in enumerate(tags):
                odds[i, t] += np.exp(score)
        assert np.allclose(logit[a:b], np.log(odds[:, 1] / odds[:, 0])) if b > a else True


@pytest.mark.parametrize("piece", [1, 300, 1 << 19])
def test_marginals_of_long_texts(piece, monkeypatch):
    """Against the recursion word by word, in log-odds, also where every word pulls as hard as it may."""
    monkeypatch.setattr(toxicity, "PIECE", piece)
    draw = np.random.default_rng(6)
    first = np.append(0, np.cumsum([0, 1, 63, 64, 65, 700, 0, 2, 1000]))
    for unary, trans in ((draw.normal(-2, 3, first[-1]), draw.normal(size=3)), (draw.choice([-40.0, 40.0], first[-1]), np.array([-9.0, 8.0, 9.0])), (np.full(first[-1], -40.0), np.array([-30.0, 30.0, -30.0]))):
        ot, to, tt = trans
        ahead, back = unary.copy(), np.zeros(first[-1])
        for a, b in zip(first[:-1], first[1:]):
            for t in range(a + 1, b):
                ahead[t] = unary[t] + np.logaddexp(ot, ahead[t - 1] + tt) - np.logaddexp(0, ahead[t - 1] + to)
            for t in range(b - 2, a - 1, -1):
                after = unary[t + 1] + back[t + 1]
                back[t] = np.logaddexp(to, tt + after) - np.logaddexp(0, ot + after)
        found = toxicity.marginals(unary, first, trans)
        assert np.allclose(found[0], ahead) and np.allclose(found[1], back) and np.allclose(found[2], ahead + back)
    assert [len(x) for x in toxicity.marginals(np.zeros(0), np.zeros(3, np.int64), trans)] == [0, 0, 0]


def test_licenses(spark, nothing):
    base = [("mit", "under the mit license"), ("apache-2", "apache license version 2"), ("cc-by-nc", "cc by nc")]
    texts = ["Released under the MIT License. under the mit, license", "x CC BY-NC 4.0 cc by nc by nc", "This work is licensed under the GNU General Public License version 3.", "clean the license of", None, "", "Licensed under the Apache License, Version 2.0", "under under the mit license version 2 apache license version 20"]
    df = spark.createDataFrame([(i, t, None, None, None) for i, t in enumerate(texts)], DOCS)
    found = {r.doc_id: r for r in licenses.scan_licenses(df).collect()}
    for i, t in enumerate(texts):
        w = plain(t)
        places = [(at, label) for label, p in base for at in range(len(w)) if w[at : at + len(p.split())] == p.split()]
        r = found[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word) == (len(w), len(places), min((a for a, _ in places), default=None), max((a for a, _ in places), default=None))
        assert r.base_labels == sorted({x for _, x in places}) and set(r.base_labels) <= set(r.labels) and 0 <= r.score <= 1
    assert "gpl-3" in found[2].labels and found[3].labels == []
    assert licenses.scan_licenses(nothing).count() == 0


def test_license_chains():
    """The best chain of each template, and spans that lie where its words lie; a chain by brute force covers no more."""
    from itertools import combinations

    scanner = licenses.Scanner(licenses.PHRASES, licenses.TEMPLATES, 4, 8, 0.6)
    draw = random.Random(4)
    for trial in range(60):
        number = draw.randrange(len(licenses.PHRASES), len(scanner.texts))
        label, template, _ = scanner.texts[number]
        anchors, at = [], 0
        for _ in range(draw.randint(1, 6)):
            long = draw.randint(4, max(4, len(template) // 2)) if len(template) > 4 else 4
            anchors.append((number, at, draw.randint(0, max(0, len(template) - long)), min(long, len(template))))
            at += draw.randint(1, 12)
        spans = scanner._chain(sorted(anchors))
        rows, most = [x[1:] for x in sorted(anchors)], 0
        for n in range(1, len(rows) + 1):
            for pick in combinations(rows, n):
                value, ok = pick[0][2], True
                for (a, p, s), (b, q, t) in zip(pick, pick[1:]):
                    ahead, along = b - a - s, q - p - s
                    ok &= max(ahead, along) <= 8 and b > a and q > p and ahead + t > 0 and along + t > 0
                    value += t - max(0, -ahead, -along)
                most = max(most, value if ok else 0)
        assert max((x["covered"] for x in spans), default=0) == pytest.approx(min(1.0, most / len(template)) if most >= 0.6 * len(template) else 0)


def test_frugal_passes_every_batch():
    from cairnlink.llm.tokens import frugal

    batches = [pa.record_batch({"x": pa.array([i])}) for i in range(3)]
    assert list(frugal(lambda given: (x for x in given))(iter(batches))) == batches
    assert list(frugal(lambda given: (x for x in given))(iter([]))) == []


def test_toxicity_fit_by_pieces(monkeypatch):
    rng = np.random.default_rng(5)
    at, weight = rng.integers(3, 50, 1000).astype(np.int32), rng.random(1000)
    whole = np.bincount(at, weight, 60)
    words = [f"word{i}x" for i in range(300)]
    toxic = np.arange(400) % 4 == 0
    texts = [" ".join([*rng.choice(words, 12), *["grubling"] * int(bad)]) for bad in toxic]
    found = toxicity.find_words(pa.array(texts, pa.large_string()), toxicity.ALNUM, lower=True)
    marks, models = [], []
    for shares, piece in ((1, 1 << 19), (4, 7)):
        monkeypatch.setattr(toxicity, "SHARES", shares)
        monkeypatch.setattr(toxicity, "PIECE", piece)
        out = np.zeros(60)
        toxicity._add_sums(out, at, lambda part: weight[part])
        assert np.allclose(out, whole)
        marks.append(toxicity.indicative_words(found, toxic.astype(float)))
        models.append(toxicity.fit(texts[:80], toxic[:80].astype(float), 3.0, rounds=3))
    assert marks[0].sum() == toxic.sum() and (marks[0] == marks[1]).all()
    assert np.allclose(models[0].head, models[1].head, atol=1e-5) and np.allclose(models[0].trans, models[1].trans)


def test_toxicity_fit_without_words():
    tagger = toxicity.fit(["", " ", ""], np.array([0.0, 1.0, 0.0]), 2.0)
    assert np.isfinite(tagger.head).all() and 0 < tagger.score(np.zeros((1, 4)))[0] < 1


def test_substring_bucket_is_read_piece_by_piece():
    """A bucket's words are not all held at once: memory stays below ten times its strings; planted repeats are found."""
    pick = np.random.default_rng(7)
    rows = []
    for doc in range(400):
        words = [b"%07d" % x for x in pick.integers(0, 10**7, 2700)]
        if doc == 399:
            words[27:54] = repeated
        repeated = words[:27] if doc == 0 else repeated
        head = np.array([(doc, 7, at, 27) for at in range(0, 2700, 27)], "<i8")
        rows.append(substrings._pack([len(head).to_bytes(8, "little"), head.tobytes(), b" ".join(words)]))
    none = pa.nulls(len(rows), pa.int64())
    part = pa.table({"doc": none, "text_hash": none, "ranges": pa.nulls(len(rows), pa.binary()), "packed": pa.array(rows, pa.binary())})
    tracemalloc.start()
    found = substrings._gather(20)(part).to_pylist()
    peak = tracemalloc.get_traced_memory()[1]
    tracemalloc.stop()
    assert [(r["doc"], r["text_hash"], np.frombuffer(r["ranges"], "<i4").tolist()) for r in found] == [(399, 7, [27, 54])]
    assert peak < 10 * 400 * 2700 * 8
