"""N-gram Jaccard join: MinHash LSH forest for candidates, exact verification in blocks, links and classes."""

from __future__ import annotations

import math
from collections.abc import Iterator
from fractions import Fraction

import numpy as np
import pyarrow as pa
import zstandard
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from cairnlink.llm.shared import cut, let_go, spread_join, stored
from cairnlink.llm.tokens import ALNUM, Words, find_words, frugal, mix, sliced, window_hashes

TREES, MAX_DEPTH = 24, 8
#: A sketch is a byte each of so many values of a signature; texts agreeing in NEAR of them lead or follow one another.
SKETCH, NEAR, LINKED = 128, 83, 34
BRANCH_ROWS = 2048
_SIZED = 100
BLOCK = 256
_SEEN = 50_000
_GOLD = np.uint64(0x9E3779B97F4A7C15)


def depth_for(threshold: float, recall: float, trees: int = TREES, max_depth: int = MAX_DEPTH) -> int:
    """Shorten the prefixes, from ``max_depth`` on, until two texts at the threshold meet in a tree often enough."""
    depth = max_depth
    while depth > 1 and 1 - (1 - threshold**depth) ** trees < recall:
        depth -= 1
    return depth


def shingles(found: Words, k: int) -> tuple[np.ndarray, np.ndarray]:
    """Shingle hashes of all texts in a row, distinct and sorted within each text, and where each text's begin.

    A text of 1 to k-1 words has one shingle, all its words.
    """
    hashes, first = found.hashes(), found.first
    n = np.diff(first)
    long, short = np.flatnonzero(n >= k), np.flatnonzero((n > 0) & (n < k))
    doc = found.doc
    whole = window_hashes(hashes, k)
    inside = np.flatnonzero(doc[: len(whole)] == doc[k - 1 :]) if len(whole) else np.zeros(0, np.int64)
    values, owner = [whole[inside]], [doc[inside]]
    for size in range(1, k):
        own = short[n[short] == size]
        rows = hashes[first[own][:, None] + np.arange(size)]
        joined = np.full(len(own), size, np.uint64)
        for j in range(size):
            joined = mix(joined ^ rows[:, j]) * _GOLD
        values.append(joined)
        owner.append(own)
    value, owner = np.concatenate(values), np.concatenate(owner)
    order = np.lexsort((value, owner))
    value, owner = value[order], owner[order]
    fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(value) else np.zeros(0, bool)
    value, owner = value[fresh], owner[fresh]
    return value, np.searchsorted(owner, np.arange(len(n) + 1))


def least_index(n: int, threshold: Fraction) -> Fraction:
    """The least Jaccard index of ``threshold`` or more that a set of ``n`` can have with any other set."""
    found = Fraction(1)
    for m in range(math.ceil(n * threshold), math.floor(n / threshold) + 1):
        common = math.ceil(threshold * (n + m) / (1 + threshold))
        if common <= min(n, m):
            found = min(found, Fraction(common, n + m - common))
    return found


def own_depths(sizes: np.ndarray, threshold: Fraction, recall: float) -> np.ndarray:
    """The prefix that each text is matched by: shortened from ``MAX_DEPTH`` on until its own target is met.

    The target is to meet a partner with probability ``recall`` even if it is the least alike that a text of so many
    shingles can have. Texts of more than ``_SIZED`` shingles are taken to have one at the threshold.
    """
    known = np.array([depth_for(float(least_index(n, threshold)), recall) for n in range(1, _SIZED + 1)] + [depth_for(float(threshold), recall)])
    return known[np.minimum(sizes, _SIZED + 1) - 1]


def signatures(value: np.ndarray, first: np.ndarray, depths: np.ndarray, top: int, trees: int = TREES) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each text that has shingles and each tree the head and the tail of its signature of ``depths`` values; and a sketch.

    The head is a hash of the tree and the first ``top`` values, which nobody's prefix is shorter than. The tail holds the
    next ones, as many low bits of each as fit, the first in the highest bits; those beyond a text's depth are 0. The
    sketch has the low byte of each of the first ``SKETCH`` values of the heads.
    """
    rng = np.random.default_rng(20_240_229)
    odd = rng.integers(1, 1 << 63, (trees, MAX_DEPTH), np.uint64) | np.uint64(1)
    plus = rng.integers(0, 1 << 63, (trees, MAX_DEPTH), np.uint64)
    has = np.flatnonzero(np.diff(first) > 0)
    starts, sizes = first[has], np.diff(first)[has]
    head, tail = np.empty((len(has), trees), np.uint64), np.zeros((len(has), trees), np.uint64)
    sketch = np.zeros((len(has), SKETCH), np.uint8)

    def least(value: np.ndarray, starts: np.ndarray, tree: int, at: int) -> np.ndarray:
        hashed = value * odd[tree, at]
        hashed += plus[tree, at]
        hashed >>= np.uint64(24)  # the low bits of a product are weak
        return np.minimum.reduceat(hashed, starts)

    for tree in range(trees if len(has) else 0):
        label = np.full(len(has), tree + 1, np.uint64) * _GOLD
        for at in range(top):
            found = least(value, starts, tree, at)
            label = mix(label ^ found)
            if tree * top + at < SKETCH:
                sketch[:, tree * top + at] = mix(found).astype(np.uint8)
        head[:, tree] = label
    bits = tail_bits(top)
    for at in range(top, MAX_DEPTH):
        deep = np.flatnonzero(depths > at)
        if len(deep):
            size = sizes[deep]
            begin = np.cumsum(size) - size
            part = value[np.arange(size.sum()) - np.repeat(begin - starts[deep], size)]
            for tree in range(trees):
                tail[deep, tree] |= (least(part, begin, tree, at) & np.uint64((1 << bits) - 1)) << np.uint64(bits * (MAX_DEPTH - 1 - at))
    return head, tail, sketch


def tail_bits(top: int) -> int:
    return min(16, 62 // max(1, MAX_DEPTH - top))


def branch_edges(head: np.ndarray, tail: np.ndarray, depth: np.ndarray, key: np.ndarray, sketch: np.ndarray, top: int) -> tuple[np.ndarray, np.ndarray]:
    """Edges (i, j) between the texts of each branch that are alike by their sketches, many branches at a time.

    Texts are sorted by signature. Step by step the prefix is shortened from ``MAX_DEPTH`` to ``top`` values: a branch has
    the texts that share the prefix and are as deep or deeper, if it is some text's own. In each branch the first text
    leads; those that agree with it in ``NEAR`` places follow it, the others look for a lead of their own; every text is
    connected with every lead that it agrees with in ``LINKED`` places. Agreement is a metric, so two texts that agree in
    SKETCH + LINKED - NEAR places are connected through the lead of one of them.
    """
    bits, lefts, rights = tail_bits(top), [], []
    for level in range(MAX_DEPTH, top - 1, -1):
        rows = np.flatnonzero(depth >= level)
        prefix = (tail[rows] >> np.int64(bits * (MAX_DEPTH - level))) if level > top else np.zeros(len(rows), np.int64)
        order = np.lexsort((key[rows], prefix, head[rows]))
        rows, prefix = rows[order], prefix[order]
        fresh = np.append(True, (head[rows[1:]] != head[rows[:-1]]) | (prefix[1:] != prefix[:-1])) if len(rows) else np.zeros(0, bool)
        once = np.append(True, fresh[1:] | (key[rows[1:]] != key[rows[:-1]])) if len(rows) else fresh  # copies from several tasks
        branch = (np.cumsum(fresh) - 1)[once]
        rows = rows[once]
        own = np.bincount(branch, depth[rows] == level) > 0
        keep = own[branch] & (np.bincount(branch)[branch] > 1) if len(rows) else np.zeros(0, bool)
        rows, branch = rows[keep], branch[keep]
        leads = np.ones(len(rows), bool)  # has no lead yet
        live = np.arange(len(rows))
        while len(live):
            waiting = live[leads[live]]
            if not len(waiting):
                break
            name, at = np.unique(branch[waiting], return_index=True)
            live = live[np.isin(branch[live], name)]
            lead = waiting[at][np.searchsorted(name, branch[live])]
            for low in range(0, len(live), 50_000):
                mine, its = live[low : low + 50_000], lead[low : low + 50_000]
                same = (sketch[rows[mine]] == sketch[rows[its]]).sum(1)
                leads[mine[same >= NEAR]] = False
                linked = (same >= LINKED) & (mine != its)
                lefts.append(rows[mine[linked]])
                rights.append(rows[its[linked]])
            leads[waiting[at]] = False
    none = np.zeros(0, np.int64)
    return (np.concatenate(lefts), np.concatenate(rights)) if lefts else (none, none)


def meetings(signed: DataFrame, top: int, branch_rows: int = BRANCH_ROWS) -> DataFrame:
    """Edges (a, b) that connect the texts of each tree's branches; ``signed`` has key, depth, heads, tails and sketch.

    Heads that one text alone has are dropped by a count that is aggregated before it is shuffled. Texts below a head of
    up to ``branch_rows`` rows are connected by ``branch_edges``, many heads in a task, which passes on a spanning forest. Where more share a head they are all
    connected with its first text, by joins alone, so no task gets them together; that connects more, never fewer.
    """
    spark = signed.sparkSession
    forest = signed.select("key", "depth", F.explode(F.arrays_zip("heads", "tails")).alias("t")).select("key", "depth", F.col("t.heads").alias("head"), F.col("t.tails").alias("tail"))
    counts = forest.groupBy("head").agg(F.count(F.lit(1)).alias("n"), F.min("key").alias("lead"), F.max("key").alias("last"))
    crowded = counts.where("lead <> last").select("head", "n", "lead")
    members = stored(forest.join(crowded, "head"), "members")
    star = members.where((F.col("n") > branch_rows) & (F.col("key") != F.col("lead"))).select(F.col("key").alias("a"), F.col("lead").alias("b")).distinct()
    small = members.where(F.col("n") <= branch_rows)
    sketches = signed.select(F.col("key").alias("_key"), "sketch").join(small.select(F.col("key").alias("_key")).distinct(), "_key", "left_semi").groupBy("_key").agg(F.first("sketch").alias("sketch"))
    shelves = max(int(spark.conf.get("spark.sql.shuffle.partitions")), -(-small.count() // 20_000))

    def connect(part: pa.Table) -> pa.Table:
        head, tail, depth, key = (part.column(c).to_numpy() for c in ("head", "tail", "depth", "key"))
        sketch = np.frombuffer(b"".join(part.column("sketch").to_pylist()), np.uint8).reshape(-1, SKETCH)
        one, two = branch_edges(head, tail, depth, key, sketch, top)
        names, node = np.unique(key, return_inverse=True)
        root = _roots(len(names), node[one], node[two])  # a text meets another in many branches: one edge is enough
        hung = np.flatnonzero(root != np.arange(len(names)))
        return pa.table({"a": pa.array(names[hung]), "b": pa.array(names[root[hung]])})

    shelved = small.join(sketches, F.col("key") == F.col("_key")).select("head", "tail", "depth", "key", "sketch", F.pmod(F.xxhash64("head"), F.lit(shelves)).alias("shelf"))
    found = shelved.groupBy("shelf").applyInArrow(lambda part: connect(part), "a long, b long")
    return found.unionByName(star).where("a <> b")


def components(edges: DataFrame) -> DataFrame:
    """(node, root) for every node of the undirected edges (a, b): root is the least node that it is connected to.

    Large-star and small-star steps in turn until nothing changes: each hangs the neighbours of a node on the least of
    them, by aggregates and joins alone, which split the edges of a node that very many share. Edge counts never grow, and
    the rounds grow with the logarithm of a path.
    """
    pairs = cut(edges.where("a <> b").select(F.greatest("a", "b").alias("v"), F.least("a", "b").alias("u")).distinct())
    state, size = None, pairs.count()
    while True:
        both = pairs.unionByName(pairs.select(F.col("u").alias("v"), F.col("v").alias("u")))
        low = both.groupBy("v").agg(F.least(F.min("u"), F.first("v")).alias("low"), F.count(F.lit(1)).alias("n"))
        large = spread_join(both.where("u > v"), low, "v", "n", 2 * size).select(F.col("u").alias("v"), F.col("low").alias("u"))
        hung = large.where("v <> u").distinct()
        low = hung.groupBy("v").agg(F.min("u").alias("low"), F.count(F.lit(1)).alias("n"))
        small = spread_join(hung, low, "v", "n", 2 * size)
        small = small.select(F.col("u").alias("v"), F.col("low").alias("u")).unionByName(small.select("v", F.col("low").alias("u")))
        pairs = cut(small.where("v <> u").distinct())
        now = pairs.agg(F.count(F.lit(1)), F.sum(F.xxhash64("v", "u").cast("decimal(38,0)"))).first()
        size = now[0]
        let_go(edges.sparkSession)
        if now == state:
            break
        state = now
    return pairs.select(F.col("v").alias("node"), F.col("u").alias("root")).unionByName(pairs.select(F.col("u").alias("node"), F.col("u").alias("root")).distinct())


def _roots(n: int, one: np.ndarray, two: np.ndarray) -> np.ndarray:
    root = np.arange(n)
    while True:
        low = np.minimum(root[one], root[two])
        new = root.copy()
        np.minimum.at(new, one, low)
        np.minimum.at(new, two, low)
        new = new[new]
        if (new == root).all():
            return root
        root = new


def similar_pairs(value: np.ndarray, first: np.ndarray, left: np.ndarray, right: np.ndarray, threshold: Fraction) -> tuple[np.ndarray, np.ndarray]:
    """(i, j), i from ``left`` and j from ``right``, i before j if they are the same list, whose Jaccard index reaches the threshold."""
    same = left is right
    docs = left if same else np.concatenate([left, right])
    size = np.diff(first)
    part = [value[first[d] : first[d + 1]] for d in docs]
    everything = np.concatenate(part)
    row = np.repeat(np.arange(len(docs)), [len(x) for x in part])
    _, column, count = np.unique(everything, return_inverse=True, return_counts=True)
    shared = count[column] > 1
    row, column = row[shared], np.unique(column[shared], return_inverse=True)[1]
    width = int(column.max(initial=-1)) + 1
    a, b = (np.arange(len(docs)),) * 2 if same else (np.arange(len(left)), len(left) + np.arange(len(right)))
    common = np.zeros((len(a), len(b)), np.int64)
    step = max(1, (8 << 20) // len(docs))
    order = np.argsort(column, kind="stable")
    row, column = row[order], column[order]
    for low in range(0, width, step):
        x, y = np.searchsorted(column, [low, low + step])
        grid = np.zeros((len(docs), min(step, width - low)), np.float32)
        grid[row[x:y], column[x:y] - low] = 1
        common += (grid[a] @ grid[b].T).astype(np.int64)
    union = size[docs[a]][:, None] + size[docs[b]][None, :] - common
    i, j = np.nonzero(common * threshold.denominator >= union * threshold.numerator)
    if same:
        i, j = i[i < j], j[i < j]
    return docs[a[i]], docs[b[j]]


def _verify(k: int, threshold: Fraction):
    def run(part: pa.Table) -> pa.Table:
        part = part.sort_by([("root", "ascending"), ("low", "ascending"), ("high", "ascending"), ("key", "ascending")])
        out = {"key": [], "links": [], "text_links": [], "lead": []}
        open_ = zstandard.ZstdDecompressor()
        key, copies, side = (part.column(c).to_numpy() for c in ("key", "copies", "block"))
        root, low, high = (part.column(c).to_numpy() for c in ("root", "low", "high"))
        cuts = np.flatnonzero(np.append(True, (root[1:] != root[:-1]) | (low[1:] != low[:-1]) | (high[1:] != high[:-1])))
        packed = part.column("packed")
        ends = np.append(cuts[1:], len(key))
        at = 0
        while at < len(cuts):  # several small groups at a time, up to two blocks of texts
            to = at + 1
            while to < len(cuts) and ends[to] - cuts[at] <= 2 * BLOCK:
                to += 1
            begin, end = cuts[at], ends[to - 1]
            texts = pa.array([open_.decompress(x) for x in packed.slice(begin, end - begin).to_pylist()], pa.large_binary())
            value, first = shingles(find_words(texts.cast(pa.large_string()), ALNUM, lower=True), k)
            for g in range(at, to):
                mine = np.arange(cuts[g], ends[g]) - begin
                if low[cuts[g]] == high[cuts[g]]:
                    one, two = similar_pairs(value, first, mine, mine, threshold)
                else:
                    here = side[cuts[g] : ends[g]] == low[cuts[g]]
                    one, two = similar_pairs(value, first, mine[here], mine[~here], threshold) if here.any() and not here.all() else (mine[:0], mine[:0])
                if not len(one):
                    continue
                n = len(mine)
                one, two = one - mine[0], two - mine[0]
                k_, c_ = key[cuts[g] : ends[g]], copies[cuts[g] : ends[g]]
                weight = np.bincount(one, c_[two], n) + np.bincount(two, c_[one], n)
                texts_ = np.bincount(one, minlength=n) + np.bincount(two, minlength=n)
                lead = k_[_roots(n, one, two)]
                linked = texts_ > 0
                for name, x in (("key", k_), ("links", weight.astype(np.int64)), ("text_links", texts_), ("lead", lead)):
                    out[name].append(x[linked])
            at = to
        return pa.table({name: pa.array(np.concatenate(x) if x else np.zeros(0, np.int64), pa.int64()) for name, x in out.items()})

    return run


def link_texts(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """One row for each row of ``docs``: id, class_id, links, text_links, copies; and text_key and class_key, 64-bit names.

    Two texts are linked if the sets of their ``k``-word shingles (words are lower-cased runs of letters, digits and
    non-ASCII characters; a text of fewer words is one shingle) have a Jaccard index of ``threshold`` or more.
    ``links`` counts the other rows linked to a row, ``text_links`` the other texts, ``copies`` the rows with the same
    text. class_id is the least id of the rows that are connected by links.

    Candidates: each tree of a MinHash LSH forest sorts texts by a signature; a text meets those that share a prefix of
    it. Each text's prefix is shortened from ``MAX_DEPTH`` on until it meets the least alike partner that its number of
    shingles allows, in one tree at least, with probability ``recall`` (``own_depths``). Of the texts of a branch those
    are connected whose sketches agree (``branch_edges``), so that chance meetings do not grow into groups; two texts at
    the threshold are kept apart by that with a probability under 1 in 10**5. Connected texts form groups, within which
    all pairs are verified exactly, in blocks of ``BLOCK`` by ``BLOCK`` texts; what is passed on is counts and a spanning
    forest, never pairs. A group of n texts costs n*n/2 comparisons, as its links may be that many, but each task holds two
    blocks. Copies of a text are one text, known by a 64-bit hash: among 10**9 different texts two are taken for
    copies with a chance of 3 %.

    Texts without words (null, empty, punctuation) are linked to nothing and are classes of their own (class_key null);
    very long texts go through whole; a null id gives a row like any other, and class_id is null only if all ids of a class
    are. Repeated rows are copies. Ids keep their type. Other columns are not read, whatever their names. An empty table
    gives an empty result.
    """
    spark = docs.sparkSession
    bound = Fraction(threshold).limit_denominator(1000)
    top = depth_for(threshold, recall)
    ready = docs.select(F.col(f"`{id_column}`").alias("id"), F.xxhash64(F.col(f"`{text_column}`")).alias("key"), F.col(f"`{text_column}`").cast("string").alias("text"))

    def sign(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen = set()
        for batch in sliced(batches):
            value, first = shingles(find_words(batch.column("text"), ALNUM, lower=True), k)
            sizes = np.diff(first)
            has = sizes > 0
            keys, depths = batch.column("key").to_numpy()[has], own_depths(sizes[has], bound, recall)
            _, once = np.unique(keys, return_index=True)
            once = once[[x not in seen for x in keys[once].tolist()]] if len(once) else once
            if len(seen) > _SEEN:
                seen.clear()
            seen.update(keys[once].tolist())
            head, tail, sketch = signatures(value, first, depths, top)
            lists = [pa.FixedSizeListArray.from_arrays(pa.array(x[once].astype(np.int64).ravel()), TREES).cast(pa.list_(pa.int64())) for x in (head, tail)]
            yield pa.RecordBatch.from_arrays([pa.array(keys[once]), pa.array(depths[once].astype(np.int32)), *lists, pa.array([x.tobytes() for x in sketch[once]], pa.binary())], names=["key", "depth", "heads", "tails", "sketch"])

    signed = stored(ready.select("key", "text").mapInArrow(frugal(sign), "key long, depth int, heads array<long>, tails array<long>, sketch binary"), "signatures")
    edges = meetings(signed, top)
    groups = cut(components(cut(edges)))
    counted = ready.select("id", "key").groupBy("key").agg(F.count(F.lit(1)).alias("copies"), F.min("id").alias("least"))
    counted = stored(counted, "copies")
    sizes = groups.groupBy("root").agg(F.count(F.lit(1)).alias("n"))
    members = groups.join(sizes, "root").withColumn("blocks", F.ceil(F.col("n") / BLOCK).cast("int")).withColumn("block", F.pmod(F.xxhash64("node"), F.col("blocks")).cast("int"))
    members = members.join(counted.select(F.col("key").alias("node"), "copies"), "node").select(F.col("node").alias("key"), "root", "n", "blocks", "block", "copies")

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        press, seen = zstandard.ZstdCompressor(level=3), set()
        for batch in sliced(batches):
            keys = batch.column("key").to_numpy()
            new = np.array([x not in seen for x in keys.tolist()], bool)
            _, once = np.unique(keys, return_index=True)
            pick = np.intersect1d(once, np.flatnonzero(new))
            if len(seen) > _SEEN:
                seen.clear()
            seen.update(keys[pick].tolist())
            texts = [press.compress((x or "").encode()) for x in batch.column("text").take(pa.array(pick)).to_pylist()]
            yield pa.RecordBatch.from_arrays([pa.array(keys[pick]), pa.array(texts, pa.binary())], names=["key", "packed"])

    texts = ready.select("key", "text").mapInArrow(frugal(pack), "key long, packed binary")
    with_text = members.join(texts.groupBy("key").agg(F.first("packed").alias("packed")), "key")
    dealt = with_text.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
    dealt = dealt.select("key", "root", "block", "copies", "packed", F.least("block", "other").alias("low"), F.greatest("block", "other").alias("high"), "blocks", "n")
    total = groups.count()
    shelves = max(1, -(-total // (2 * BLOCK)))
    shelf = F.when(F.col("blocks") == 1, F.pmod(F.xxhash64("root"), F.lit(shelves))).otherwise(F.xxhash64("root", "low", "high"))
    checked = dealt.withColumn("shelf", shelf).drop("blocks", "n").groupBy("shelf").applyInArrow(lambda part: _verify(k, bound)(part.drop_columns(["shelf"])), "key long, links long, text_links long, lead long")
    checked = stored(checked, "links")
    roots = components(checked.where("key <> lead").select(F.col("key").alias("a"), F.col("lead").alias("b")))
    links = checked.groupBy("key").agg(F.sum("links").alias("links"), F.sum("text_links").alias("text_links"))
    linked = links.join(roots, links["key"] == roots["node"]).drop("node").join(counted.select("key", "copies", "least"), "key")
    firsts = linked.groupBy("root").agg(F.min("least").alias("class_id"))
    linked = linked.join(firsts, "root").select(F.col("key").alias("_key"), "links", "text_links", "class_id", F.col("root").alias("_root"))
    worded = F.col("text").rlike(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]")
    rows = ready.select("id", "key", F.coalesce(worded, F.lit(False)).alias("worded"))
    known = stored(counted.join(linked, F.col("key") == F.col("_key"), "left").select("key", "copies", "least", "links", "text_links", "class_id", "_root"), "known")
    out = spread_join(rows, known, "key", "copies", known.agg(F.sum("copies")).first()[0] or 0)
    return out.select(
        F.col("id").alias(id_column),
        F.when(F.col("worded"), F.coalesce("class_id", "least")).otherwise(F.col("id")).alias("class_id"),
        F.when(F.col("worded"), F.coalesce("links", F.lit(0)) + F.col("copies") - 1).otherwise(0).alias("links"),
        F.coalesce("text_links", F.lit(0)).alias("text_links"),
        "copies",
        F.col("key").alias("text_key"),
        F.when(F.col("worded"), F.coalesce("_root", "key")).alias("class_key"),
    )


def one_of_each(docs: DataFrame, threshold: float = 0.8, k: int = 5, recall: float = 0.999, id_column: str = "doc_id", text_column: str = "text") -> DataFrame:
    """The rows of ``docs`` without near-duplicates: of each class of ``link_texts`` the row of the least id stays.

    Of several such rows the one of the least text hash stays, and of rows equal in both one. A null id comes last. Texts
    without words all stay. The columns are those of ``docs``; names that begin with an underscore are the operator's own.
    """
    linked = stored(link_texts(docs.select(id_column, text_column), threshold, k, recall, id_column, text_column), "classes")
    first = F.min(F.struct(F.col(id_column).isNull().alias("no"), F.col(id_column).alias("id"), "text_key")).alias("best")
    best = linked.where("class_key is not null").groupBy("class_key").agg(first)
    keep = linked.where("class_key is null").select(F.col(id_column).alias("_id"), F.col("text_key").alias("_key"), F.lit(False).alias("_single"))
    keep = keep.unionByName(best.select(F.col("best.id").alias("_id"), F.col("best.text_key").alias("_key"), F.lit(True).alias("_single"))).distinct()
    kept = docs.withColumn("_text", F.xxhash64(text_column)).join(keep, F.col(id_column).eqNullSafe(F.col("_id")) & (F.col("_text") == F.col("_key")))
    if not linked.where("class_key is not null").groupBy(id_column, "text_key").count().where("count > 1").isEmpty():
        order = Window.partitionBy("_id", "_text").orderBy("_key")
        kept = kept.withColumn("_n", F.row_number().over(order)).where(~F.col("_single") | (F.col("_n") == 1))
    return kept.select(*docs.columns)
