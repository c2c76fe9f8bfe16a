"""Candidate generation: key channels, TF-IDF channels, country dispatch, gates, union, priority cap."""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from cairnlink.functions import fixed_values as V
from cairnlink.functions import tokens as T
from cairnlink.functions.normalize import split_words
from cairnlink.operators import postings
from cairnlink.sources import tables

BITS = {name: i for i, (name, _) in enumerate(V.CHANNELS)}
#: A bit beyond the channels: an address hit that counts as exact.
CLOSE_ADDRESS = 1 << len(V.CHANNELS)
EXACT_MASK = (1 << V.EXACT_CHANNELS) - 1 | CLOSE_ADDRESS
CHANNEL_MASK = CLOSE_ADDRESS - 1
_SEP = "\u0001"


@dataclass(frozen=True)
class TermChannel:
    """A channel over weighted terms: its bit, df cap, terms kept of an S1, floor of the similarity, and raw candidates kept."""

    name: str
    most_documents: int
    terms: int
    floor: float
    raw: int
    share: float | None = None  # a cap as a share of all candidates, with a least value
    least: int = 0


@dataclass(frozen=True)
class Blocking:
    """All limits of candidate generation. ``fast`` and ``multi`` give the two sets of semantics."""

    cap: int = 50
    top: int = 50
    acronym_cap: int = 10
    acronym_score: float = 0.75
    posting_cap: int | None = None
    address_cap: bool = True
    gate_hits: int = 8
    gram_gate: int | None = 8
    country_mode: str = "fast"
    ascii_address: bool = True
    close_address: float | None = None
    address: TermChannel = TermChannel("address_tokens", 5000, 10, 0.20, 50)
    token: TermChannel = TermChannel("token_inverted", 2500, 10, 0.30, 150)
    gram: TermChannel = TermChannel("char_ngram", 5000, 15, 0.30, 150)

    @staticmethod
    def fast(cap: int = 50) -> Blocking:
        return Blocking(cap=cap)

    @staticmethod
    def multi(cap: int = 50) -> Blocking:
        return Blocking(
            cap=cap, acronym_score=0.70, posting_cap=1000, address_cap=False, gate_hits=10, gram_gate=None, country_mode="multi", ascii_address=False, close_address=0.75,
            token=TermChannel("token_inverted", 2500, 10, 0.0, 150, 0.02, 10), gram=TermChannel("char_ngram", 5000, 15, 0.30, 150, 0.10, 50),
        )


def fields(config: Blocking = Blocking()) -> list[str]:
    """The columns of a normalised record that ``prepare`` reads."""
    names = ["entity_id", "source", "country_canonical", "norm_name", "norm_address", "is_address_missing", "postal_code", "street_number", "trailing_segment"]
    return [*names, "raw_name"] if config.country_mode == "multi" else names


def prepare(records: DataFrame, config: Blocking = Blocking()) -> DataFrame:
    """What channels need of a normalised record: id, country, key columns, terms and lengths, and a stable order."""
    tokens = split_words(F.col("norm_name"))
    multi = config.country_mode == "multi"
    name_terms = T.words(F.col("norm_name"), 3) if multi else F.filter(tokens, lambda w: F.length(w) >= 3)
    name_grams = T.padded_trigrams(F.col("norm_name")) if multi else T.short_grams(F.col("norm_name"))
    address = T.address_tokens(F.col("norm_address"), F.col("is_address_missing"), config.ascii_address)
    number = F.regexp_extract("entity_id", r"(\d+)$", 1).cast("long")
    acronyms = T.acronyms(F.col("raw_name"), F.col("norm_name")) if multi else F.array_compact(F.array(T.initials_two(tokens)))
    return records.select(
        F.col("entity_id").alias("id"), F.col("country_canonical").alias("country"), "source", number.alias("number"),
        "norm_name", F.coalesce("postal_code", F.lit("")).alias("postal"), F.coalesce("street_number", F.lit("")).alias("street"),
        F.coalesce("trailing_segment", F.lit("")).alias("trailing"), (F.col("is_address_missing") == 1).alias("missing"),
        T.first_word(tokens).alias("lead"), T.first_two(tokens).alias("two"), T.sorted_tokens(T.words(F.col("norm_name"), 3) if multi else tokens).alias("sorted"),
        acronyms.alias("acronyms"), name_terms.alias("name_terms"), F.greatest(F.lit(1), F.size(name_terms if multi else tokens)).alias("name_len"),
        name_grams.alias("name_grams"), F.greatest(F.lit(1), F.size(name_grams)).alias("gram_len"), address.alias("address_terms"), F.greatest(F.lit(1), F.size(address)).alias("address_len"),
    )


def keys_of(prepared: DataFrame) -> DataFrame:
    """(id, country, source, number, bit, key): one row for each key channel that a record takes part in."""
    name, lead = F.col("norm_name"), F.col("lead")
    long_lead = F.length(lead) >= 3

    def key(channel: str, when: Column, *parts: Column) -> Column:
        return F.when(when, F.struct(F.lit(BITS[channel]).alias("bit"), F.concat_ws(_SEP, *parts).alias("key")))

    has = {c: F.col(c) != "" for c in ("norm_name", "postal", "street", "trailing")}
    plain = [
        key("exact_name", has["norm_name"], name),
        key("sorted_name_tokens", F.col("sorted").isNotNull(), F.col("sorted")),
        key("first_2_tokens", F.col("two").isNotNull(), F.col("two")),
        key("exact_name_postal", has["norm_name"] & has["postal"], name, F.col("postal")),
        key("exact_name_street", has["norm_name"] & has["street"], name, F.col("street")),
        key("exact_name_trailing", has["norm_name"] & has["trailing"], name, F.col("trailing")),
        key("name_lead_postal", long_lead & has["postal"], lead, F.col("postal")),
        key("name_lead_street_trailing", long_lead & has["street"] & has["trailing"], lead, F.col("street"), F.col("trailing")),
        key("address_structural", ~F.col("missing") & has["postal"] & has["street"], F.col("postal"), F.col("street")),
    ]
    short = F.transform("acronyms", lambda a: F.struct(F.lit(BITS["acronym_match"]).alias("bit"), a.alias("key")))
    everything = F.concat(F.array_compact(F.array(*plain)), short)
    return prepared.select("id", "country", "source", "number", F.explode(everything).alias("k")).select("id", "country", "source", "number", "k.bit", "k.key")


def short_keys(keys: DataFrame) -> DataFrame:
    """The same with keys of more than 24 bytes, which may be whole names, as digests of 128 bits."""
    plain = F.encode("key", "utf-8")
    return keys.withColumn("key", F.when(F.octet_length("key") > 24, F.unhex(F.md5(plain))).otherwise(plain))


def dispatch(ones: DataFrame, candidates: DataFrame) -> DataFrame:
    """The country whose candidates an S1 is compared with: its own if any candidate has it, else ''. Records stay where they are; the list of countries travels."""
    known = candidates.select(F.col("country").alias("_c")).distinct()
    return ones.join(F.broadcast(known), F.col("country") == F.col("_c"), "left").withColumn("country", F.coalesce("_c", F.lit(""))).drop("_c")


def key_hits(one_keys: DataFrame, candidate_keys: DataFrame, config: Blocking = Blocking()) -> DataFrame:
    """(s1, cand, bit, score, rank) of all key channels as one equi-join. Postings are capped before the join."""
    order = Window.partitionBy("country", "bit", "key").orderBy("source", "number", "id")
    cap = F.when(F.col("bit") == BITS["acronym_match"], config.acronym_cap)
    if not config.address_cap:
        cap = cap.when(F.col("bit") == BITS["address_structural"], 2**31 - 1)
    most = max(config.cap, config.acronym_cap) if config.address_cap else None
    ranked = candidate_keys.withColumn("rank", F.row_number().over(order))
    ranked = (ranked.where(F.col("rank") <= most) if most else ranked).where(F.col("rank") <= cap.otherwise(config.cap))
    ranked = ranked.select("country", "bit", "key", F.col("id").alias("cand"), "rank")
    scores = F.create_map(*[F.lit(x) for name, score in V.CHANNELS if score for x in (BITS[name], config.acronym_score if name == "acronym_match" else score)])
    joined = one_keys.select(F.col("id").alias("s1"), "country", "bit", "key").join(ranked, ["country", "bit", "key"])
    return joined.select("s1", "cand", "bit", scores[F.col("bit")].alias("score"), "rank", "key")


def reachable(wanted: DataFrame, held: DataFrame, keys: list[str]) -> DataFrame:
    """``wanted`` (s1, one_country, keys) with each ``country`` whose postings (country, keys) it may use, and ``order``.

    An S1 uses the postings of its own country (order 0) and of '' (1). A key that has neither is looked up in all other
    countries (2), but for those known to differ; an S1 without country looks everywhere. Postings are not touched here,
    only the countries that hold a key.
    """
    places = held.select("country", *keys).distinct()
    own = F.col("country") == F.col("one_country")
    near = own | (F.col("country") == "") | (F.col("one_country") == "")
    apart = F.col("one_country").isin(*V.KNOWN_COUNTRIES) & F.col("country").isin(*V.KNOWN_COUNTRIES)
    marked = wanted.join(places, keys).withColumn("order", F.when(own, 0).when(near, 1).otherwise(2)).where((F.col("order") < 2) | ~apart)
    return marked.withColumn("_least", F.min("order").over(Window.partitionBy("s1", *keys))).where((F.col("order") < 2) | (F.col("_least") == 2)).drop("_least")


def key_hits_by_fallback(one_keys: DataFrame, candidate_keys: DataFrame, config: Blocking) -> DataFrame:
    """Key hits under the other dispatch (``reachable``). Of each country's postings of a key no more than the cap can count."""
    keys = ["bit", "key"]
    cap = F.when(F.col("bit") == BITS["acronym_match"], config.acronym_cap).when(F.col("bit") == BITS["address_structural"], 2**31 - 1).otherwise(config.cap)
    posting = Window.partitionBy("country", *keys).orderBy("source", "number", "id")
    right = candidate_keys.withColumn("_p", F.row_number().over(posting)).where((F.col("_p") <= cap) & (F.col("_p") <= (config.posting_cap or 2**31 - 1)))
    right = right.select(F.col("id").alias("cand"), "country", "source", "number", *keys)
    wanted = one_keys.select(F.col("id").alias("s1"), F.col("country").alias("one_country"), *keys)
    joined = reachable(wanted, right, keys).join(right, ["country", *keys])
    order = Window.partitionBy("s1", *keys).orderBy("order", "source", "number", "cand")
    scores = F.create_map(*[F.lit(x) for name, score in V.CHANNELS if score for x in (BITS[name], config.acronym_score if name == "acronym_match" else score)])
    return joined.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= cap).select("s1", "cand", "bit", scores[F.col("bit")].alias("score"), "rank", "key")


def term_hits_by_fallback(ones: DataFrame, candidates: DataFrame, terms: str, length: str, channel: TermChannel, top: int, close: float | None = None, done: DataFrame | None = None) -> DataFrame:
    """(s1, cand, score, rank, mask) of a term channel under the other dispatch; document frequencies count all countries.

    With ``close`` the hits are ranked by the shared weight and those of that similarity or more are marked as exact; without
    it they are ranked by similarity.
    """
    everywhere = idf_table(candidates.withColumn("country", F.lit("")), terms, channel)
    kept = postings.heaviest(ones, terms, everywhere, channel.terms, F.lit(""), done).withColumnRenamed("country", "one_country")
    kept = tables.stored(kept, "heaviest")
    held = candidates.select("country", F.explode(terms).alias("term")).distinct().join(kept.select("term").distinct(), "term")  # a semi-join would be moved before the first distinct
    reached = reachable(kept, held, ["term"]).select("s1", "country", "term", "w", "norm")
    found = postings.matched(reached, candidates, terms, length, channel.raw, channel.floor, None if close is not None else top, by_country=False)
    bit = 1 << BITS[channel.name]
    mask = F.lit(bit) if close is None else F.when(F.col("score") >= close, bit | CLOSE_ADDRESS).otherwise(bit)
    return found.select("s1", "cand", "score", "rank", mask.alias("mask"))


def shared_weight(weight: Column) -> Column:
    """Sum of weights of 9 decimals, rounded to 6. Summed as integers, so the order of the rows is of no matter, and rounded as the SQL's engine does."""
    exact = F.sum(F.round(weight * 1e9).cast("long")) / F.lit(1e9)
    return F.floor(exact * 1e6 + 0.5) / F.lit(1e6)


def document_frequency(candidates: DataFrame, terms: str) -> DataFrame:
    """(country, term, df): candidates of the country that hold the term."""
    return candidates.select("country", F.explode(F.array_distinct(terms)).alias("term")).groupBy("country", "term").agg(F.count(F.lit(1)).alias("df"))


def idf_table(candidates: DataFrame, terms: str, channel: TermChannel) -> DataFrame:
    """(country, term, df, idf) of the terms within the df cap; n counts the candidates of all countries."""
    n = candidates.agg(F.count(F.lit(1)).alias("n"))
    frequency = document_frequency(candidates, terms)
    joined = frequency.crossJoin(F.broadcast(n))  # one row
    cap = F.lit(channel.most_documents)
    if channel.share is not None:
        cap = F.least(cap, F.greatest(F.floor(F.col("n") * channel.share), F.lit(channel.least)))
    return joined.where(F.col("df") <= cap).select("country", "term", "df", F.log(1 + (F.col("n") - F.col("df") + 0.5) / (F.col("df") + 0.5)).alias("idf"))


def term_hits(ones: DataFrame, candidates: DataFrame, terms: str, length: str, channel: TermChannel, top: int, done: DataFrame | None = None) -> DataFrame:
    """(s1, cand, bit, score, rank) of a term channel: shared weights over both lengths, floored, the top ones. ``done`` (s1) take no part."""
    weights = postings.heaviest(ones, terms, idf_table(candidates, terms, channel), channel.terms, done=done)
    found = postings.matched(weights, candidates, terms, length, channel.raw, channel.floor, top, by_country=True)
    return found.select("s1", "cand", F.lit(BITS[channel.name]).alias("bit"), "score", "rank")


def unite(hits: DataFrame) -> DataFrame:
    """One row for each pair: best score, best rank, channel mask."""
    return unite_masks(hits.withColumn("mask", F.expr("shiftleft(1, bit)")))


def unite_masks(hits: DataFrame) -> DataFrame:
    """The same for rows (s1, cand, score, rank, mask)."""
    return hits.groupBy("s1", "cand").agg(F.max("score").alias("score"), F.min("rank").alias("rank"), F.bit_or("mask").alias("mask"))


def settled_ids(united: DataFrame, config: Blocking) -> DataFrame:
    """S1 ids whose hits so far settle the matter: tier 2 leaves them out."""
    per = united.groupBy("s1").agg(F.count(F.lit(1)).alias("n"), F.max(F.expr(f"mask & {EXACT_MASK}")).alias("exact"))
    return per.where(((F.col("exact") > 0) & (F.col("n") >= config.gate_hits)) | (F.col("n") >= config.cap)).select("s1")


def prioritise(united: DataFrame, cap: int) -> DataFrame:
    """The best ``cap`` pairs of every S1: exact ones first, then by channels, score, rank and id."""
    order = Window.partitionBy("s1").orderBy(F.desc(F.expr(f"(mask & {EXACT_MASK}) <> 0")), F.desc(F.expr(f"bit_count(mask & {CHANNEL_MASK})")), F.desc("score"), "rank", "cand")
    return united.withColumn("place", F.row_number().over(order)).where(F.col("place") <= cap)


def provenance(mask: Column, alphabetical: bool = False) -> Column:
    """The channels of a mask, in the order of their bits or of their names."""
    named = [(1 << i, name) for i, (name, _) in enumerate(V.CHANNELS)]
    return F.array_join(F.array_compact(F.array(*[F.when(mask.bitwiseAND(bit) != 0, F.lit(name)) for bit, name in (sorted(named, key=lambda x: x[1]) if alphabetical else named)])), ",")


def as_hits(kept: DataFrame, ones: DataFrame, alphabetical: bool = False) -> DataFrame:
    """The documented columns of a candidate hit."""
    return kept.join(ones.select(F.col("id").alias("s1"), F.col("country").alias("country_partition")), "s1").select(
        F.col("s1").alias("source1_entity_id"), F.col("cand").alias("candidate_entity_id"), F.regexp_extract("cand", r"^([^-]*)", 1).alias("candidate_source"),
        provenance(F.col("mask"), alphabetical).alias("blocker_provenance"), F.expr(f"cast(bit_count(mask & {CHANNEL_MASK}) as int)").alias("blocker_count"), F.col("rank").alias("best_blocker_rank"),
        F.round("score", 4).alias("best_blocker_score"), "country_partition", "place",
    )


def generate(records: DataFrame, config: Blocking = Blocking(), dense: DataFrame | None = None, checkpoint: bool = False, candidates: DataFrame | None = None) -> DataFrame:
    """Candidates of every S1 record among the S2 and S3 records, in three waves with a gate before each costly one.

    ``dense`` adds hits (s1, cand, score, rank) of a dense index under the bit of the n-gram channel. ``candidates``, if
    given, are S2 and S3 records that ``prepare`` has made ready before, and ``records`` are then S1 records. With
    ``checkpoint`` the hits of a wave are stored before the next reads them more than once; the records should then be a
    stored table. Without it the whole generation is one plan, whose equal exchanges Spark reuses.
    """
    prepared = prepare(records, config)
    fix = (lambda df: tables.stored(df, "wave")) if checkpoint else (lambda df: df)
    ones, candidates = prepared.where("source = 'S1'"), prepared.where("source <> 'S1'") if candidates is None else candidates
    multi = config.country_mode == "multi"
    if multi:
        ones_at, keyed = ones, key_hits_by_fallback(short_keys(keys_of(ones)), short_keys(keys_of(candidates)), config)
    else:
        ones_at = dispatch(ones, candidates)
        keyed = key_hits(short_keys(keys_of(ones_at)), short_keys(keys_of(candidates)), config)

    def terms(names: str, length: str, channel: TermChannel, close: float | None = None, done: DataFrame | None = None) -> DataFrame:
        if multi:
            return term_hits_by_fallback(ones, candidates, names, length, channel, config.top, close, done)
        return _masked(term_hits(ones_at, candidates, names, length, channel, config.top, done))

    hits = _masked(keyed).unionByName(terms("address_terms", "address_len", config.address, config.close_address))
    if dense is not None:
        hits = hits.unionByName(_masked(dense.select("s1", "cand", F.lit(BITS["char_ngram"]).alias("bit"), "score", "rank")))
    united = fix(unite_masks(hits))
    done = settled_ids(united, config)
    hits = united.unionByName(terms("name_terms", "name_len", config.token, done=done))
    if config.gram_gate is not None:
        hits = fix(unite_masks(hits))
        done = done.unionByName(hits.groupBy("s1").count().where(F.col("count") >= config.gram_gate).select("s1"))
    hits = hits.unionByName(terms("name_grams", "gram_len", config.gram, done=done))
    united = unite_masks(hits.repartition("s1"))  # the rows of an S1 stay together until its best are chosen
    return as_hits(prioritise(united, config.cap), ones_at, multi)


def _masked(hits: DataFrame) -> DataFrame:
    return hits.select("s1", "cand", "score", "rank", F.expr("shiftleft(1, bit)").alias("mask"))


def dense_hits(ones: DataFrame, candidates: DataFrame, k: int = 50, floor: float = 0.30, discount: float = 0.95) -> DataFrame:
    """Exact top-k by inner product of (id, country, vector) rows within a country or ''; elsewhere, discounted, if none is there."""
    from cairnlink.operators.dense import search

    left, right = (df.select("id", "vector", F.coalesce("country", F.lit("")).alias("group")) for df in (ones, candidates))
    known = list(V.KNOWN_COUNTRIES)

    def near(one, two):
        return (one[:, None] == two[None, :]) | (two == "")[None, :]

    def far(one, two):
        apart = np.isin(one, known)[:, None] & np.isin(two, known)[None, :]
        return (one[:, None] != two[None, :]) & ~apart

    own = search(left, right, k, 9, floor, near)
    alone = left.join(own.select(F.col("q").alias("id")).distinct(), "id", "left_anti")
    else_ = search(alone, right, k, 9, floor / discount, far).withColumn("sim", F.col("sim") * discount)
    found = own.unionByName(else_).select(F.col("q").alias("s1"), F.col("c").alias("cand"), F.col("sim").alias("score"))
    order = Window.partitionBy("s1").orderBy(F.desc(F.round("score", 6)), "cand")
    return found.withColumn("rank", F.row_number().over(order))
