"""Pair features: 45 columns for each candidate pair, and merging of feature families."""

from __future__ import annotations

import re
from hashlib import blake2b

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlink.functions import similarity as S
from cairnlink.functions.normalize import canonical_country, country_match
from cairnlink.functions.tokens import word_bound_grams
from cairnlink.sources.tables import stored

#: The white space of ``split_words``.
BLANKS = re.compile(r"[ \t\n\x0b\f\r]+")


def _exact(left: Column, right: Column) -> Column:
    return ((left == right) & (left != "")).cast("int")


def pair_features(hits: DataFrame, records: DataFrame, indel: bool = True) -> DataFrame:
    """Features of every hit. Both records are joined by id; pairs of unknown ids drop out (see ``unknown_pairs``)."""
    fields = ["entity_id", "country", "norm_name", "norm_address", "postal_code"]
    one = records.select(*[F.col(c).alias(f"l_{c}") for c in fields])
    two = records.select(*[F.col(c).alias(f"r_{c}") for c in fields])
    hits = hits.select("source1_entity_id", "candidate_entity_id", *[c for c in ("blocker_provenance", "blocker_count", "best_blocker_rank", "best_blocker_score") if c in hits.columns])
    for c, kind in (("blocker_provenance", "string"), ("blocker_count", "int"), ("best_blocker_rank", "int"), ("best_blocker_score", "double")):
        if c not in hits.columns:
            hits = hits.withColumn(c, F.lit(None).cast(kind))
    per = Window.partitionBy("source1_entity_id")
    hits = hits.withColumns({"_count": F.count(F.lit(1)).over(per).cast("int"), "_most": F.max("best_blocker_score").over(per)})
    # the S1 last: pairs of an S1 then stand together, and no much-claimed candidate brings its pairs into one task
    both = hits.join(two, F.col("candidate_entity_id") == F.col("r_entity_id")).join(one, F.col("source1_entity_id") == F.col("l_entity_id"))
    ln, rn, la, ra = (F.col(c) for c in ("l_norm_name", "r_norm_name", "l_norm_address", "r_norm_address"))
    lp, rp = F.coalesce("l_postal_code", F.lit("")), F.coalesce("r_postal_code", F.lit(""))
    match = country_match(F.col("l_country"), F.col("r_country"))
    rank, score = F.col("best_blocker_rank"), F.col("best_blocker_score")
    full = (ln != "") & (rn != "") & (la != "") & (ra != "")
    name, address = S.text_measures(ln, rn), S.text_measures(la, ra)
    columns = {
        "l_canonical_country": canonical_country(F.col("l_country")), "r_canonical_country": canonical_country(F.col("r_country")),
        "source_is_s3": F.col("candidate_entity_id").startswith("S3-").cast("int"),
        "country_equal": F.coalesce(match, F.lit(-1)), "country_equal_missing": match.isNull().cast("int"),
        "left_country_missing": (F.col("l_country") == "").cast("int"), "right_country_missing": (F.col("r_country") == "").cast("int"),
        "name_both_missing": ((ln == "") & (rn == "")).cast("int"), "address_both_missing": ((la == "") & (ra == "")).cast("int"),
        "name_exact": _exact(ln, rn), "address_exact": _exact(la, ra),
        "name_jaccard": name["jaccard"], "name_overlap": name["overlap"], "name_edit_similarity": name["edit_similarity"], "name_char_trigram_jaccard": name["trigram_jaccard"],
        "name_token_sort_ratio": S.token_sort_ratio(ln, rn) if indel else F.lit(None).cast("double"), "name_fuzz_ratio": S.fuzz_ratio(ln, rn) if indel else F.lit(None).cast("double"),
        "address_jaccard": address["jaccard"], "address_overlap": address["overlap"], "address_edit_similarity": address["edit_similarity"], "address_char_trigram_jaccard": address["trigram_jaccard"],
        "address_token_set_ratio": S.token_set_ratio(la, ra) if indel else F.lit(None).cast("double"),
        "name_number_overlap": name["number_overlap"], "address_number_overlap": address["number_overlap"],
        "postal_equal": ((lp == rp) & (lp != "")).cast("int"), "postal_missing_either": ((lp == "") | (rp == "")).cast("int"),
        "name_length_abs_diff": F.abs(F.length(ln) - F.length(rn)), "address_length_abs_diff": F.abs(F.length(la) - F.length(ra)),
        "same_name_different_address": (full & (ln == rn) & (la != ra)).cast("int"), "same_address_different_name": (full & (la == ra) & (ln != rn)).cast("int"),
        "candidate_rank": F.coalesce(rank, F.lit(999)), "candidate_rank_missing": rank.isNull().cast("int"), "rank_margin_from_best": F.when(rank.isNull(), 999).otherwise(F.greatest(F.lit(0), rank - 1)),
        "best_blocker_score_filled": F.coalesce(score, F.lit(-1.0)), "best_blocker_score_missing": score.isNull().cast("int"),
        "best_blocker_score_diff": F.when(score.isNull() | F.col("_most").isNull(), 0.0).otherwise(F.round(F.col("_most") - score, 6)), "best_blocker_score_diff_missing": (score.isNull() | F.col("_most").isNull()).cast("int"),
        "blocker_count_filled": F.coalesce("blocker_count", F.lit(0)), "candidate_count_for_s1": F.col("_count"),
        "has_blocker_provenance": F.col("blocker_provenance").isNotNull().cast("int"),
    }
    picked = [F.col("source1_entity_id"), F.col("candidate_entity_id"), F.col("l_country").alias("left_country"), F.col("r_country").alias("right_country")]
    names = {"l_canonical_country": "left_country_canonical", "r_canonical_country": "right_country_canonical", "best_blocker_score_filled": "best_blocker_score", "blocker_count_filled": "blocker_count"}
    return both.select(*picked, *[c.alias(names.get(n, n)) for n, c in columns.items()], F.coalesce("blocker_provenance", F.lit("")).alias("blocker_provenance"))


def unknown_pairs(hits: DataFrame, records: DataFrame) -> DataFrame:
    """Hits whose S1 or candidate has no record."""
    ids = records.select(F.col("entity_id").alias("_id")).distinct()
    one = hits.join(ids, F.col("source1_entity_id") == F.col("_id"), "left_anti")
    return one.unionByName(hits.join(ids, F.col("candidate_entity_id") == F.col("_id"), "left_anti")).distinct()


def merge_features(base: DataFrame, other: DataFrame, prefix: str) -> DataFrame:
    """Left merge by pair, one to one; a repeated pair or a shared column raises. Missing flags become 1 where no row is."""
    keys = ["source1_entity_id", "candidate_entity_id"]
    shared = (set(base.columns) & set(other.columns)) - set(keys)
    if shared:
        raise ValueError(f"both sides have {', '.join(sorted(shared))}")
    for side, df in (("left", base), ("right", other)):
        if not df.groupBy(*keys).count().where("count > 1").isEmpty():
            raise ValueError(f"a pair repeats on the {side}")
    merged = base.join(other, keys, "left")
    flags = [c for c in other.columns if c.startswith(prefix) and c.endswith("_missing")]
    return merged.withColumns({c: F.coalesce(F.col(c).cast("int"), F.lit(1)) for c in flags})


def dense_feature(pairs: DataFrame, vectors: DataFrame, name: str, decimals: int | None = 4) -> DataFrame:
    """Cosine of both records' vectors (id, vector), clipped; missing if either is."""
    one, two = vectors.select(F.col("id").alias("_i"), F.col("vector").alias("_a")), vectors.select(F.col("id").alias("_j"), F.col("vector").alias("_b"))
    both = pairs.join(one, F.col("source1_entity_id") == F.col("_i"), "left").join(two, F.col("candidate_entity_id") == F.col("_j"), "left")
    cosine = S.dot(S.l2_normalised(F.col("_a")), S.l2_normalised(F.col("_b")))
    value = F.greatest(F.lit(-1.0), F.least(F.lit(1.0), cosine))
    value = F.when(F.col("_a").isNull() | F.col("_b").isNull(), F.lit(0.0)).otherwise(F.round(value, decimals) if decimals else value)  # least and greatest skip nulls
    return both.select("source1_entity_id", "candidate_entity_id", value.alias(name), (F.col("_a").isNull() | F.col("_b").isNull()).cast("int").alias(f"{name}_missing"))


def tfidf_vectors(texts: DataFrame, fit: DataFrame | None = None) -> DataFrame:
    """(id, grams, weights): sublinear TF-IDF of character n-grams within words, of length 1, of each text (id, text).

    Document frequencies are those of the texts whose id is in ``fit``, the training fold; grams unknown there weigh nothing.
    Grams are 64-bit hashes in ascending order. An empty text has no grams.
    """
    counts = texts.select("id", F.explode(word_bound_grams(F.coalesce("text", F.lit("")))).alias("g")).groupBy("id", F.xxhash64("g").alias("g")).agg(F.count(F.lit(1)).alias("tf"))
    known = counts if fit is None else counts.join(fit.select(F.col(fit.columns[0]).alias("id")).distinct(), "id", "left_semi")
    ids = texts if fit is None else texts.join(fit.select(F.col(fit.columns[0]).alias("id")).distinct(), "id", "left_semi")
    idf = known.groupBy("g").agg(F.count(F.lit(1)).alias("df")).crossJoin(F.broadcast(ids.agg(F.count(F.lit(1)).alias("n"))))  # one row
    idf = idf.select("g", (F.log((1 + F.col("n")) / (1 + F.col("df"))) + 1).alias("idf"))
    weighed = counts.join(idf, "g").select("id", "g", ((1 + F.log("tf")) * F.col("idf")).alias("w"))
    lists = weighed.groupBy("id").agg(F.array_sort(F.collect_list(F.struct("g", "w"))).alias("x"), F.sqrt(F.sum(F.col("w") * F.col("w"))).alias("norm"))
    return lists.select("id", F.transform("x", lambda x: x["g"]).alias("grams"), F.transform("x", lambda x: x["w"] / F.col("norm")).alias("weights"))


@F.pandas_udf(T.DoubleType())
def _sparse_dot(one: pd.Series, a: pd.Series, two: pd.Series, b: pd.Series) -> pd.Series:
    def dot_of(g, w, h, v) -> float:
        if g is None or h is None:
            return 0.0
        _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
        return float(np.asarray(w)[i] @ np.asarray(v)[j])

    return pd.Series([dot_of(*x) for x in zip(one, a, two, b)], dtype="float64")


class _Grams:
    """Character n-grams within words as 64-bit hashes, each word's made once; at most ``words`` words are kept."""

    def __init__(self, known: np.ndarray | None = None, words: int = 100_000) -> None:
        self.known, self.most, self.kept = known, words, {}

    def of_word(self, word: str) -> np.ndarray:
        found = self.kept.get(word)
        if found is None:
            padded = f" {word} "
            grams = [padded[i : i + n] for n in (3, 4, 5) for i in range(len(padded) - n + 1)]
            found = np.array([int.from_bytes(blake2b(g.encode(errors="surrogatepass"), digest_size=8).digest(), "little", signed=True) for g in grams], dtype=np.int64)
            if self.known is not None:  # places in the table instead; grams that it does not hold weigh nothing
                at = np.searchsorted(self.known, found)
                found = at[self.known[np.minimum(at, len(self.known) - 1)] == found] if len(self.known) else at[:0]
            if len(self.kept) >= self.most:
                self.kept.clear()
            self.kept[word] = found
        return found

    def of_text(self, text: str) -> tuple[np.ndarray, np.ndarray]:
        """Distinct grams in ascending order, and how often each is there."""
        parts = [self.of_word(w) for w in BLANKS.split(text) if w]
        return np.unique(np.concatenate(parts), return_counts=True) if parts else (np.empty(0, np.int64), np.empty(0, np.int64))


def _gram_frequency(rows: DataFrame) -> DataFrame:
    """(g, df) of the grams of texts (id, text), counted batch by batch before the one shuffle."""

    def run(batches):
        grams = _Grams()
        for batch in batches:
            for low in range(0, batch.num_rows, 1000):
                found = [grams.of_text(x)[0] for x in batch.column("text").slice(low, 1000).to_pylist()]
                g, n = np.unique(np.concatenate(found), return_counts=True)
                yield pa.RecordBatch.from_arrays([pa.array(g), pa.array(n)], names=["g", "df"])

    return rows.select("text").mapInArrow(run, "g long, df long").groupBy("g").agg(F.sum("df").alias("df"))


def tfidf_cosine(pairs: DataFrame, texts: DataFrame, fit: DataFrame | None = None, most: int = 8_000_000) -> DataFrame:
    """(s1, cand, tfidf_cosine) of the pairs; 0 where a text has no known gram.

    Texts travel to their pairs, and vectors are made there, from a table of document frequencies that goes to all workers. If
    that has more than ``most`` grams the vectors of ``tfidf_vectors`` travel instead.
    """
    keys = ["source1_entity_id", "candidate_entity_id"]
    bags = texts.groupBy("id").agg(F.concat_ws(" ", F.collect_list(F.lower("text"))).alias("text"))
    ids = None if fit is None else fit.select(F.col(fit.columns[0]).alias("id")).distinct()
    frequency = stored(_gram_frequency(bags if ids is None else bags.join(ids, "id", "left_semi")), "grams")
    if frequency.count() > most:
        return _cosine_of_vectors(pairs, texts, fit)
    table = frequency.orderBy("g").toArrow()
    n = (texts if ids is None else texts.join(ids, "id", "left_semi")).count()
    shared = texts.sparkSession.sparkContext.broadcast((table["g"].to_numpy(), np.log((1 + n) / (1 + table["df"].to_numpy())) + 1))

    def run(batches):
        known, idf = shared.value
        grams, last = _Grams(known), (None, None)

        def vector(text):
            g, tf = grams.of_text(text or "")
            w = (1 + np.log(tf)) * idf[g]
            return g, w / np.sqrt(w @ w) if len(g) else w

        for batch in batches:
            found = []
            for one, a, b in zip(batch.column(0).to_pylist(), batch.column("a").to_pylist(), batch.column("b").to_pylist()):
                if last[0] != one:  # the rows of one S1 stand together
                    last = (one, vector(a))
                (g, w), (h, v) = last[1], vector(b)
                _, i, j = np.intersect1d(g, h, assume_unique=True, return_indices=True)
                found.append(float(w[i] @ v[j]))
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(found, pa.float64())], names=[*keys, "tfidf_cosine"])

    both = pairs.select(*keys).join(bags.toDF("candidate_entity_id", "b"), "candidate_entity_id", "left").join(bags.toDF("source1_entity_id", "a"), "source1_entity_id", "left")
    kinds = ", ".join(f"{c} {both.schema[c].dataType.simpleString()}" for c in keys)
    return both.select(*keys, "a", "b").sortWithinPartitions("source1_entity_id").mapInArrow(run, f"{kinds}, tfidf_cosine double")


def _cosine_of_vectors(pairs: DataFrame, texts: DataFrame, fit: DataFrame | None) -> DataFrame:
    vectors = tfidf_vectors(texts, fit)
    both = pairs.select("source1_entity_id", "candidate_entity_id").join(vectors.toDF("source1_entity_id", "_g", "_w"), "source1_entity_id", "left")
    both = both.join(vectors.toDF("candidate_entity_id", "_h", "_v"), "candidate_entity_id", "left")
    return both.select("source1_entity_id", "candidate_entity_id", _sparse_dot("_g", "_w", "_h", "_v").alias("tfidf_cosine"))


def encode(texts: DataFrame, encoder, batch: int = 256, name: str = "vector") -> DataFrame:
    """Add a vector for each text by ``encoder`` (list of texts to list of vectors), ``batch`` texts at a time, on the executors."""
    schema = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in texts.schema)

    def run(frames):
        for frame in frames:
            values = frame["text"].fillna("").tolist()
            found = [v for low in range(0, len(values), batch) for v in encoder(values[low : low + batch])]
            yield frame.assign(**{name: [[float(y) for y in x] for x in found]})

    return texts.mapInPandas(run, f"{schema}, `{name}` array<double>")
