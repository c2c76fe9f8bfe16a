"""The pipeline's stages against brute force; each hands on the columns of documents."""

from collections import Counter, defaultdict

import corpus_pipeline
import pytest
import tiktoken

from cairnlink.llm import token_shards
from tests.llm.test_operators import TOKENIZERS, _shingles, plain, words


@pytest.fixture(scope="module")
def tables(spark, sf, tmp_path_factory):
    folder, docs = tmp_path_factory.mktemp("pipeline"), spark.read.parquet(f"{sf}/documents.parquet")
    made = [docs]
    for name, stage in corpus_pipeline.STAGES:
        stage(spark, made[-1], sf).write.parquet(f"{folder}/{name}")
        made.append(spark.read.parquet(f"{folder}/{name}"))
    return made


def test_columns_and_counts(tables):
    counts = [t.count() for t in tables]
    assert all(t.columns == tables[0].columns for t in tables[:5])
    assert counts[0] > counts[1] > counts[2] > counts[3] > 0 and counts[5] > 0


def test_toxicity_keeps_clean_documents(spark, sf, tables):
    toxic = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 1").collect()}
    clean = {r.doc_id for r in spark.read.parquet(f"{sf}/labels.parquet").where("toxic = 0").collect()}
    kept = {r.doc_id for r in tables[1].select("doc_id").collect()}
    assert len(clean & kept) >= 0.99 * len(clean) and len(toxic & kept) <= 0.5 * len(toxic)


def test_one_of_each_class_stays(tables):
    texts = {r.doc_id: _shingles(r.text) for r in tables[1].select("doc_id", "text").collect()}
    common, holders = Counter(), defaultdict(list)
    for d in sorted(texts):
        for s in texts[d]:
            for other in holders[s]:
                common[other, d] += 1
            holders[s].append(d)
    root = {d: d for d in texts}

    def find(d):
        while root[d] != d:
            d = root[d]
        return d

    for (a, b), n in common.items():
        if 5 * n >= 4 * (len(texts[a]) + len(texts[b]) - n):
            a, b = sorted((find(a), find(b)))
            root[b] = a
    assert {r.doc_id for r in tables[2].collect()} == {d for d in texts if root[d] == d}


def test_overlapping_documents_go(spark, sf, tables):
    items = [plain(r.text) for r in spark.read.parquet(f"{sf}/benchmark.parquet").collect()]
    kept = {r.doc_id for r in tables[3].collect()}

    def overlap(text):
        places = defaultdict(list)
        for at, w in enumerate(text):
            places[w].append(at)
        for item in items:
            span = min(20, len(item))
            for lane, same in Counter(at - j for j, w in enumerate(item) for at in places.get(w, ())).items():
                if same >= span - span // 5:
                    row = [0 <= lane + j < len(text) and text[lane + j] == w for j, w in enumerate(item)]
                    low, high = max(0, -lane), min(len(item), len(text) - lane)
                    if any(sum(row[j : j + span]) >= span - span // 5 for j in range(low, high - span + 1)):
                        return True
        return False

    assert kept == {r.doc_id for r in tables[2].collect() if not overlap(plain(r.text))}


def test_mix_repeats_documents_to_the_targets(tables):
    sizes, taken, longest, copies = Counter(), Counter(), Counter(), Counter(r.doc_id for r in tables[4].collect())
    for r in tables[3].collect():
        sizes[r.source] += len(words(r.text))
        longest[r.source] = max(longest[r.source], len(words(r.text)))
        taken[r.source] += copies[r.doc_id] * len(words(r.text))
    assert max(copies.values()) <= 3
    weight = {s: (5, 2, 1)[i % 3] for i, s in enumerate(sorted(sizes))}
    level = sum(sizes.values()) / sum(weight.values())
    if all(weight[s] * level <= 3 * sizes[s] for s in sizes):
        off = {s: abs(taken[s] - weight[s] * level) for s in sizes}
        assert all(off[s] <= longest[s] for s in off)  # sources of 40 documents, of which one may be half of the target
        assert sum(off[s] <= 0.02 * weight[s] * level for s in off) >= 0.7 * len(off)


def test_shards_hold_every_token(tables):
    ranks = token_shards.load_ranks(f"{TOKENIZERS}/byte_bpe_50k.tiktoken")
    encode = tiktoken.Encoding("t", pat_str=token_shards.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
    rows = tables[4].collect()
    made = tables[5].collect()
    assert sum(r.n_tokens for r in made) == sum(len(encode(r.text or "")) + 1 for r in rows)
    assert sorted(r.slot for r in made) == list(range(len(made)))
    assert {d for r in made for d in r.doc_ids} == {r.doc_id for r in rows}
