"""Toxicity: a linear-chain conditional random field tags toxic words; its marginals give scores and offsets."""

from __future__ import annotations

import pickle
from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from cairnlink.llm.tokens import ALNUM, Words, find_words, frugal, give_back, hash_ranges, sliced

BITS = 18
STRETCH = 1 << 20  # bytes of text that are tagged at a time, one text at least
GRAMS, PREFIXES = (4, 5), (6, 7, 8)
SHARES = 4  # a power of two
PIECE = 1 << 19  # features whose weights or gradients are summed at a time; words whose marginals are computed at a time
RUN = 64
#: Bounds of the sample that the model is fitted on: distinct texts of each class, and characters of each class in all.
SAMPLE = {1: 1000, 0: 2000}
SAMPLE_CHARS = 16_000_000
#: One odd multiplier for each kind of feature: 0 whole words, n byte n-grams, -n the first n bytes of words.
_MULTIPLY = {kind: np.uint64((0x9E3779B97F4A7C15 * (2 * i + 3)) % (1 << 64) | 1) for i, kind in enumerate((0, 4, 5, -6, -7, -8))}


def _views(found: Words) -> np.ndarray:
    """The eight bytes from every byte on, as one number."""
    return np.ndarray((max(0, len(found.data) - 7),), "<u8", buffer=found.data.data, strides=(1,))


def _gram_values(found: Words, n: int) -> np.ndarray:
    return _views(found) & np.uint64((1 << (8 * n)) - 1)


def _features(found: Words, kind: int, tokens: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(token, value) of every feature of a kind that the tokens have."""
    start, end = (found.start, found.end) if tokens is None else (found.start[tokens], found.end[tokens])
    if kind == 0:
        return np.arange(len(start)), hash_ranges(found.data, start, end)
    if kind < 0:
        token = np.flatnonzero(end - start >= -kind)
        return token, _views(found)[start[token]] & np.uint64((1 << (-8 * kind)) - 1)
    sizes = np.maximum(0, end - start - kind + 1)
    token = np.repeat(np.arange(len(start)), sizes)
    at = np.arange(len(token)) - np.repeat(np.cumsum(sizes) - sizes, sizes) + start[token]
    return token, _gram_values(found, kind)[at]


def _slot(values: np.ndarray, n: int) -> np.ndarray:
    return ((values * _MULTIPLY[n]) >> np.uint64(64 - BITS)).astype(np.int64)


def _ratios(p: np.ndarray, q: np.ndarray, r: np.ndarray) -> np.ndarray:
    """x with x[t] = (p[t] x[t-1] + q[t]) / (r[t] x[t-1] + 1), where p and r are 0 at the first place and nothing is negative.

    The places are cut into runs of ``RUN``. All runs advance together: first the 2 x 2 matrix that each one amounts to, scaled
    now and then, so that nothing over- or underflows; from these what each run begins with; then the values.
    """
    n = len(q)
    runs = -(-n // RUN)
    p, q, r = (np.ascontiguousarray(np.append(x, np.zeros(runs * RUN - n)).reshape(runs, RUN).T) for x in (p, q, r))
    a, b, c, d = np.ones(runs), np.zeros(runs), np.zeros(runs), np.ones(runs)
    for i in range(RUN):
        a, b, c, d = p[i] * a + q[i] * c, p[i] * b + q[i] * d, r[i] * a + c, r[i] * b + d
        if i % 4 == 3:
            most = np.maximum(np.maximum(a, b), np.maximum(c, d))
            a, b, c, d = a / most, b / most, c / most, d / most
    begin, x = np.empty(runs), 1.0
    for i, (one, two, three, four) in enumerate(zip(a.tolist(), b.tolist(), c.tolist(), d.tolist())):
        begin[i] = x
        x = (one * x + two) / (three * x + four)
    out, x = np.empty((RUN, runs)), begin
    for i in range(RUN):
        x = (p[i] * x + q[i]) / (r[i] * x + 1)
        out[i] = x
    return out.T.ravel()[:n]


def marginals(unary: np.ndarray, first: np.ndarray, trans: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Log-odds messages forward and backward and the log-odds of the tag at every word; ``trans`` is (OT, TO, TT), OO is 0.

    ``unary`` is 40 at most in size, and ``trans`` is taken as 30 at most. Texts are taken some ``PIECE`` words at a time,
    one text at least.
    """
    ot, to, tt = np.exp(np.clip(trans, -30, 30))
    ahead, back = np.empty_like(unary), np.empty_like(unary)
    edges = np.unique(first)
    low = 0
    while low + 1 < len(edges):
        high = max(low + 1, int(np.searchsorted(edges, edges[low] + PIECE, "right")) - 1)
        part, starts = slice(edges[low], edges[high]), edges[low : high + 1] - edges[low]
        w = np.exp(unary[part])
        p, q, r = w * tt, w * ot, np.full(len(w), to)
        p[starts[:-1]], q[starts[:-1]], r[starts[:-1]] = 0, w[starts[:-1]], 0
        ahead[part] = np.log(_ratios(p, q, r))
        after, last = np.append(w[1:], 0.0), starts[1:] - 1
        p, q, r = after * tt, np.full(len(w), to), after * ot
        p[last], q[last], r[last] = 0, 1, 0
        back[part] = np.log(_ratios(p[::-1], q[::-1], r[::-1])[::-1])
        low = high
    return ahead, back, ahead + back


def _sigmoid(x: np.ndarray) -> np.ndarray:
    return 1 / (1 + np.exp(-np.clip(x, -500, 500)))


@dataclass
class Tagger:
    tables: dict[int, np.ndarray]  # for each kind of feature its weights by hash slot
    bias: float
    trans: np.ndarray
    head: np.ndarray  # weights of the document score
    shift: np.ndarray
    scale: np.ndarray

    def unary(self, found: Words) -> np.ndarray:
        total = np.full(len(found.start), self.bias)
        for n in GRAMS:
            sums = np.append(0.0, np.cumsum(self.tables[n][_slot(_gram_values(found, n), n)], dtype=np.float64))
            last = found.end - n + 1
            ok = last > found.start
            total[ok] += sums[last[ok]] - sums[found.start[ok]]
        for kind in (0, *(-n for n in PREFIXES)):
            token, value = _features(found, kind)
            total[token] += self.tables[kind][_slot(value, kind)]
        return np.clip(total, -40, 40)

    def tag(self, found: Words) -> tuple[np.ndarray, np.ndarray]:
        """Probability that each word is toxic, and the features of each document."""
        p = _sigmoid(marginals(self.unary(found), found.first, self.trans)[2])
        return p, document_features(p, found.first)

    def score(self, features: np.ndarray) -> np.ndarray:
        return _sigmoid((features - self.shift) / self.scale @ self.head[1:] + self.head[0])


def document_features(p: np.ndarray, first: np.ndarray) -> np.ndarray:
    """Of the marginals of each document: expected toxic words (log), their share, the largest, the chance of any."""
    n = np.diff(first)
    sums = np.append(0.0, np.cumsum(p))
    none = np.append(0.0, np.cumsum(np.log1p(-np.clip(p, 0, 1 - 1e-9))))
    expected = sums[first[1:]] - sums[first[:-1]]
    has = np.flatnonzero(n > 0)
    top = np.zeros(len(n))
    if len(has):
        top[has] = np.maximum.reduceat(p, first[:-1][has])
    any_ = 1 - np.exp(none[first[1:]] - none[first[:-1]])
    return np.stack([np.log1p(expected), expected / np.maximum(1, n), top, any_], 1)


def _stretches(n: int, size: int = 100_000) -> list[np.ndarray]:
    """Token numbers in stretches, so that working memory stays small. A text cut in two counts twice for what it has on both sides."""
    return [np.arange(a, min(n, a + size)) for a in range(0, n, size)]


def indicative_words(found: Words, toxic: np.ndarray, purity: float = 0.6) -> np.ndarray:
    """Tokens of toxic texts with a feature (word, byte n-gram, first bytes) that toxic texts have more than chance allows.

    A feature counts if ``purity`` of the texts that have it are toxic and the likelihood ratio of that against the share of
    toxic texts overall exceeds the number of features, which are all tested at once.
    """
    rate = float(np.clip(toxic.mean(), 1e-6, 1 - 1e-6))
    doc = found.doc
    marked = np.zeros(len(doc), bool)
    for kind in _MULTIPLY if len(doc) else ():
        signal, ratios, total = [], [], 0
        for share in range(SHARES):  # a share of the features at a time, so that working memory stays small
            values, bads = [], []
            for stretch in _stretches(len(doc)):
                token, value = _features(found, kind, stretch)
                mine = np.flatnonzero((value * _MULTIPLY[kind]) >> np.uint64(32) & np.uint64(SHARES - 1) == np.uint64(share))
                owner, value = doc[stretch][token[mine]], value[mine]
                order = np.lexsort((owner, value))
                value, owner = value[order], owner[order]
                fresh = np.append(True, (value[1:] != value[:-1]) | (owner[1:] != owner[:-1])) if len(order) else np.zeros(0, bool)
                values.append(value[fresh])
                bads.append(toxic[owner[fresh]].astype(np.float32))
            distinct, number = np.unique(np.concatenate(values), return_inverse=True)
            bad, all_ = np.bincount(number, np.concatenate(bads), len(distinct)), np.bincount(number, minlength=len(distinct))
            del number, values, bads
            pure = bad / all_
            with np.errstate(divide="ignore", invalid="ignore"):
                ratio = bad * np.log(pure / rate) + np.where(all_ > bad, (all_ - bad) * np.log((1 - pure) / (1 - rate)), 0.0)
            signal.append(distinct[pure >= purity])
            ratios.append(ratio[pure >= purity])
            total += len(distinct)
        signal = np.concatenate(signal)[np.concatenate(ratios) >= np.log(total + 1.0)]
        for stretch in _stretches(len(doc)):
            token, value = _features(found, kind, stretch)
            marked[stretch[token[np.isin(value, signal)]]] = True
    return marked & (toxic[doc] > 0)


def _logistic(x: np.ndarray, y: np.ndarray, weight: np.ndarray) -> np.ndarray:
    x = np.column_stack([np.ones(len(x)), x])
    w = np.zeros(x.shape[1])
    for _ in range(50):
        p = _sigmoid(x @ w)
        grad = x.T @ (weight * (p - y)) + 1e-2 * np.append(0, w[1:])
        hess = (x * (weight * np.maximum(p * (1 - p), 1e-9))[:, None]).T @ x + np.diag(np.append(1e-6, np.full(len(w) - 1, 1e-2)))
        step = np.linalg.solve(hess, grad)
        w -= step
        if np.abs(step).max() < 1e-8:
            break
    return w


def _add_sums(out: np.ndarray, at: np.ndarray, weights: Callable[[slice], np.ndarray]) -> None:
    """Add to ``out[at]`` what ``weights`` gives for each piece of ``at``."""
    for a in range(0, len(at), PIECE):
        piece = at[a : a + PIECE]
        begin = int(piece.min())
        sums = np.bincount(piece - begin, weights(slice(a, a + PIECE)))
        out[begin : begin + len(sums)] += sums


def fit(texts: list[str], toxic: np.ndarray, odds: float, rounds: int = 40) -> Tagger:
    """Fit the field on words labelled by ``indicative_words``, then the document score on all texts.

    ``odds`` is clean rows by toxic rows among all labelled ones, to which the sample's classes are weighted.
    """
    found = find_words(pa.array(texts, pa.large_string()), ALNUM, lower=True)
    doc, marked = found.doc, indicative_words(found, toxic)
    give_back()
    explained = np.bincount(doc[marked], minlength=len(texts)) > 0
    used = np.flatnonzero((explained | (toxic == 0))[doc])
    slots, tokens = {}, {}
    for kind in _MULTIPLY:
        parts = []
        for stretch in _stretches(len(used)):
            token, value = _features(found, kind, used[stretch])
            parts.append((_slot(value, kind).astype(np.int32), (token + stretch[0]).astype(np.int32)))
        slots[kind], tokens[kind] = (np.concatenate(x) for x in zip(*parts)) if parts else (np.zeros(0, np.int32),) * 2
    keep = doc[used]
    first = np.append(0, np.flatnonzero(np.diff(keep)) + 1) if len(keep) else np.zeros(0, np.int64)
    first = np.append(first, len(keep))
    tag = marked[used].astype(float)
    tables = {n: np.zeros(1 << BITS) for n in slots}
    grown = {n: np.full(1 << BITS, 1e-8) for n in slots}
    bias, trans = -4.0, np.array([-1.0, 0.0, 0.0])
    grown_small = np.full(4, 1e-8)
    inner = np.setdiff1d(np.arange(len(keep)), first[1:] - 1).astype(np.int32)
    del found, doc, marked, used
    give_back()
    for _ in range(rounds if len(keep) else 0):
        unary = np.full(len(keep), bias)
        for n, slot in slots.items():
            _add_sums(unary, tokens[n], lambda part: tables[n][slot[part]])
        np.clip(unary, -40, 40, out=unary)
        ahead, back, off = marginals(unary, first, trans)
        off = _sigmoid(off) - tag
        small = np.append(off.sum(), 0.1 * trans)
        for low in range(0, len(inner), PIECE):
            at = inner[low : low + PIECE]
            after = unary[at + 1] + back[at + 1]
            scores = np.stack([np.zeros(len(at)), trans[0] + after, ahead[at] + trans[1], ahead[at] + trans[2] + after])
            scores = np.exp(scores - scores.max(0))
            scores /= scores.sum(0)
            a, b = tag[at], tag[at + 1]
            small[1:] += np.array([(scores[1] - (1 - a) * b).sum(), (scores[2] - a * (1 - b)).sum(), (scores[3] - a * b).sum()])
        del unary, ahead, back
        grown_small += small**2
        step = 0.5 * small / np.sqrt(grown_small)
        bias, trans = bias - step[0], trans - step[1:]
        for n, slot in slots.items():
            grad = 0.01 * tables[n]
            _add_sums(grad, slot, lambda part: off[tokens[n][part]])
            grown[n] += grad**2
            tables[n] -= 0.3 * grad / np.sqrt(grown[n])
    tagger = Tagger({n: x.astype(np.float32) for n, x in tables.items()}, bias, trans, np.zeros(5), np.zeros(4), np.ones(4))
    del slots, tokens, grown, keep
    features = np.concatenate([tagger.tag(find_words(part.column("text"), ALNUM, lower=True))[1] for part in sliced(iter([pa.record_batch({"text": pa.array(texts, pa.large_string())})]), most=STRETCH)])
    tagger.shift, tagger.scale = features.mean(0), features.std(0) + 1e-6
    weight = np.where(toxic > 0, 1.0, odds * toxic.sum() / max(1.0, (1 - toxic).sum()))
    tagger.head = _logistic((features - tagger.shift) / tagger.scale, toxic, weight)
    return tagger


def _least(rows: DataFrame, most: int, ids: int) -> list:
    """The ``most`` rows of the least hash ``_at``, in order. Only those below a mark that some more than ``most`` rows
    fall short of are sent to the driver, so what it gets does not grow with the tasks; the mark rises if they are too few.
    """
    share = 2 * (most + 50) / max(1, ids)
    while True:
        below = rows if share >= 1 else rows.where(F.col("_at") < int(share * 2**64) - 2**63)
        found = below.collect()
        if share >= 1 or len(found) >= most:
            return sorted(found, key=lambda r: (r["_at"], r["_id"]))[:most]
        share *= 4


def learn(
    docs: DataFrame, labels: DataFrame, usable: Column, id_column: str = "doc_id", text_column: str = "text", label_column: str = "toxic", sample: dict[int, int] = SAMPLE, characters: int = SAMPLE_CHARS
) -> Tagger | float:
    """Fit a tagger on a bounded sample of the labelled rows that are ``usable``; with one class alone, its constant score.

    The sample takes ``sample`` distinct texts of each class, in the order of a hash of the id, whole and however long;
    a class ends early with the text that brings its characters to ``characters``. One task fits the model; the driver
    gets it and the hashes of the texts, never these. Labels of null id or value are left out, and of labels that
    contradict each other for one id the higher counts. Of rows that share an id, or a text, the one of the least hash
    counts, so reruns agree. Null texts are left out; empty tables give the score 0.
    """
    clean = labels.where(F.col(id_column).isNotNull() & F.col(label_column).isin(0, 1)).where(usable).groupBy(F.col(id_column).alias("_id")).agg(F.max(label_column).cast("int").alias("_toxic"))
    known = docs.where(F.col(text_column).isNotNull()).select(F.col(id_column).alias("_doc"), F.xxhash64(text_column).alias("_key"), F.length(text_column).alias("_n"))
    labelled = known.join(clean, F.col("_id") == F.col("_doc")).select("_toxic", F.struct(F.xxhash64("_id").alias("_at"), F.col("_id").cast("string").alias("_id"), "_key", "_n").alias("_one"), "_id")
    of_id = labelled.groupBy("_id").agg(F.min("_one").alias("_one"), F.first("_toxic").alias("_toxic"))
    of_text = of_id.groupBy("_one._key").agg(F.min(F.struct("_one", "_toxic")).alias("_best")).select("_best._toxic", "_best._one.*").cache()
    sizes = {r[0]: r[1] for r in of_id.groupBy("_toxic").count().collect()}
    rows = {}
    for kind, most in sample.items():
        total = 0
        for r in _least(of_text.where(F.col("_toxic") == kind), most, sizes.get(kind, 0)):
            if total < characters:
                rows[r["_key"]], total = r, total + r["_n"]
    of_text.unpersist()
    kinds = {r["_toxic"] for r in rows.values()}
    if len(kinds) < 2:
        return float(max(kinds, default=0))
    odds = sizes[0] / sizes[1]

    def train(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        found = [x for batch in batches for x in zip(*(batch.column(c).to_pylist() for c in ("_place", "_t", "_y")))]
        found.sort(key=lambda x: x[0])
        tagger = fit([x[1] for x in found], np.array([x[2] for x in found], float), odds)
        yield pa.RecordBatch.from_arrays([pa.array([pickle.dumps(tagger)], pa.binary())], names=["model"])

    picks = docs.sparkSession.createDataFrame([(r["_key"], r["_toxic"], -i) for i, r in enumerate(rows.values())], "_key long, _toxic int, _place int")
    texts = docs.select(F.col(text_column).alias("_text"), F.xxhash64(text_column).alias("_key")).join(F.broadcast(picks), "_key")
    texts = texts.groupBy("_key").agg(F.first("_place").alias("_place"), F.first("_text").alias("_t"), F.first("_toxic").alias("_y"))
    return pickle.loads(texts.repartition(1).mapInArrow(frugal(train), "model binary").first()["model"])


SPAN_TYPE = "array<struct<start:long,end:long,score:double>>"


def score_texts(docs: DataFrame, tagger: Tagger | float, text_column: str = "text") -> DataFrame:
    """Add ``toxicity`` (0 to 1) and ``toxic_spans`` (UTF-8 byte offsets of runs of words that are likelier toxic than not).

    Every word of every text is tagged; memory is the model and 1 MB of text, or one text if it is longer. A null or
    empty text has no words and gets the score of a text without any sign of toxicity, and no spans. Equal texts get
    equal scores, repeated rows stay, an empty table gives an empty result. Columns toxicity and toxic_spans of the
    caller are replaced; all others stay.
    """
    docs = docs.drop("toxicity", "toxic_spans")
    held = docs.sparkSession.sparkContext.broadcast(tagger)
    span = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("score", pa.float64())]))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in sliced(batches, text_column, STRETCH):
            if isinstance(held.value, float):
                scores, spans = np.full(batch.num_rows, held.value), [[] for _ in range(batch.num_rows)]
            else:
                found = find_words(batch.column(text_column), ALNUM, lower=True)
                p, features = held.value.tag(found)
                scores, spans = held.value.score(features), [[] for _ in range(batch.num_rows)]
                hit = np.flatnonzero(p >= 0.5)
                doc = found.doc
                fresh = np.flatnonzero(np.append(True, (np.diff(hit) > 1) | (np.diff(doc[hit]) > 0))) if len(hit) else []
                for a, b in zip(fresh, [*fresh[1:], len(hit)]):
                    d = doc[hit[a]]
                    spans[d].append({"start": int(found.start[hit[a]] - found.base[d]), "end": int(found.end[hit[b - 1]] - found.base[d]), "score": float(p[hit[a:b]].mean())})
            yield batch.append_column("toxicity", pa.array(scores)).append_column("toxic_spans", pa.array(spans, span))

    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in docs.schema)
    return docs.mapInArrow(frugal(run), f"{schema}, toxicity double, toxic_spans {SPAN_TYPE}")


def held_out(id_column: str = "doc_id") -> Column:
    return F.crc32(F.coalesce(F.col(id_column).cast("string"), F.lit(""))) % 5 == 0
