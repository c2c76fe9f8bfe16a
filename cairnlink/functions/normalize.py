"""Normalisation of names, addresses and countries as Column functions."""

from __future__ import annotations

import unicodedata

import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

from cairnlink.functions import fixed_values as V

#: What a word is made of. The second form keeps the vowel signs of Indic scripts in their words.
WORD, WORD_WITH_MARKS = r"\p{L}\p{N}_", r"\p{L}\p{M}\p{N}_"
#: Words and white space of the SQL twins' patterns.
ASCII, BLANK = "a-zA-Z0-9_", r"[\t\n\f\r ]"


@F.pandas_udf(T.StringType())
def _nfkc(texts: pd.Series) -> pd.Series:
    return texts.map(lambda x: unicodedata.normalize("NFKC", x), na_action="ignore")


def nfkc(text: Column) -> Column:
    """Unicode NFKC; ASCII texts are their own and never reach Python as more than a null."""
    return F.coalesce(_nfkc(F.when(text.rlike(r"[^\x00-\x7F]"), text)), text)


def _or_empty(text: Column) -> Column:
    return F.coalesce(text.cast("string"), F.lit(""))


def let(value: Column, body) -> Column:
    """``body`` of a value that is computed once, however often the body names it."""
    return F.get(F.transform(F.array(value), body), F.lit(0))


def lookup(word: Column, words: dict[str, str]) -> Column:
    """The word that ``words`` has for it, else itself. A map literal is searched one by one, so only known words get there."""
    table = F.expr("map(" + ", ".join(f"'{x}'" for pair in words.items() for x in pair) + ")")
    return F.when(word.isin(*words), F.element_at(table, word)).otherwise(word)


def split_words(text: Column) -> Column:
    """Words between white space; an empty text has none."""
    return F.filter(F.split(text, r"\s+"), lambda w: w != "")


def is_missing_address(address: Column) -> Column:
    plain = F.lower(F.trim(_or_empty(address)))
    starts = plain.startswith(V.MISSING_ADDRESS_STARTS[0])
    for start in V.MISSING_ADDRESS_STARTS[1:]:
        starts |= plain.startswith(start)
    return address.isNull() | plain.isin(*V.MISSING_ADDRESSES) | starts


def strip_urls(text: Column) -> Column:
    return F.regexp_replace(text, V.URL, " ")


def collapse_acronyms(text: Column) -> Column:
    """L.L.C., L.L.C and l. l. c. as LLC and llc: dots and blanks between single letters go, and the dot after the last."""
    letter = rf"(?<![{WORD}])[a-zA-Z]"
    inner = rf"(?<={letter})\s*\.\s*(?=[a-zA-Z](?![{WORD}]))"
    last = rf"(?<={letter}\s{{0,9}}\.\s{{0,9}}[a-zA-Z])\."
    dotted = text.rlike(rf"{letter}\s*\.\s*[a-zA-Z](?![{WORD}])")
    return F.when(dotted, F.regexp_replace(text, f"{inner}|{last}", "")).otherwise(text)


def collapse_runs(text: Column) -> Column:
    """The acronyms of the SQL twins: runs of letters and dots between ASCII bounds, so that the n of ñan. y is a letter of its own.

    A run that is found loses its dots and blanks wherever its characters stand in the text, run after run.
    """
    run = rf"(?<![{ASCII}])(?:[a-zA-Z]{BLANK}*\.{BLANK}*(?=[a-zA-Z](?![{ASCII}])))++[a-zA-Z]\.?"

    def each(text: Column) -> Column:
        found = F.regexp_extract_all(text, F.lit(run), F.lit(0))
        return F.when(text.rlike(run), F.aggregate(found, text, lambda a, r: F.replace(a, r, F.regexp_replace(r, rf"(?:\.|{BLANK})+", "")))).otherwise(text)

    return let(text, each)


def _bounds(pattern: str, ascii_bounds: bool) -> str:
    """``pattern`` with its word bounds as they are or between ASCII words only."""
    return pattern.replace(r"\b", rf"(?:(?<=[{ASCII}])(?![{ASCII}])|(?<![{ASCII}])(?=[{ASCII}]))") if ascii_bounds else pattern


def clean_case(text: Column, ascii_bounds: bool = False) -> Column:
    low = F.trim(F.lower(collapse_runs(text) if ascii_bounds else collapse_acronyms(text)))
    plain = F.translate(F.translate(low, "‘’`´‚", "'''''"), "–—−", "---")
    return F.regexp_replace(F.replace(plain, F.lit("&"), F.lit(" and ")), _bounds(V.DOING_BUSINESS_AS, ascii_bounds), " doing business as ")


def strip_punctuation(text: Column, word: str = WORD) -> Column:
    return F.trim(F.regexp_replace(F.regexp_replace(text, rf"[^{word}\s/\-']", " "), r"\s+", " "))


def strip_hash_prefix(text: Column) -> Column:
    return F.regexp_replace(text, rf"(?<![{WORD}])#+([{WORD}])", "$1")


def plain_ordinals(text: Column, ascii_bounds: bool = False) -> Column:
    return F.regexp_replace(text, _bounds(V.ORDINAL, ascii_bounds), "$1")


def strip_landmarks(text: Column, ascii_bounds: bool = False) -> Column:
    any_ = "|".join(f"(?:{p}(?=\\s*[,\\d]|$))" for p in V.LANDMARKS)
    return F.trim(F.regexp_replace(F.regexp_replace(text, _bounds(f"(?i){any_}", ascii_bounds), " "), r"\s+", " "))


def canonical_legal_form(name: Column) -> Column:
    """Legal forms in the last three words take their canonical spelling."""

    def whole(name: Column) -> Column:
        spelled = name
        for phrase, form in V.LEGAL_PHRASES:
            spelled = F.regexp_replace(spelled, rf"(^|(?<= )){phrase}$", form)
        ends = None
        for last in sorted({phrase.split()[-1] for phrase, _ in V.LEGAL_PHRASES}):
            ends = name.endswith(last) if ends is None else ends | name.endswith(last)
        return F.when(ends, spelled).otherwise(name)

    return let(split_words(let(name, whole)), _spelled)


def _spelled(words: Column) -> Column:
    n = F.size(words)
    tail = [F.when(n >= k, F.get(words, n - k)) for k in range(V.LEGAL_TAIL_WORDS, 0, -1)]
    spelled = []
    for word, after in zip(tail, [*tail[1:], None]):
        plain = lookup(word, V.LEGAL_MAP)
        spelled.append(plain if after is None else F.when((word == "p") & after.isin("ltd", "limited"), F.lit("private")).otherwise(plain))
    head = F.slice(words, F.lit(1), F.greatest(n - V.LEGAL_TAIL_WORDS, F.lit(0)))
    return F.array_join(F.concat(head, F.array_compact(F.array(*spelled))), " ")


def expand_address_words(address: Column) -> Column:
    """Street words in full; directions in full next to a street word only."""
    return let(F.transform(split_words(address), lambda w: lookup(w, V.ADDRESS_MAP)), _directed)


def _directed(words: Column) -> Column:
    street = sorted({*V.ADDRESS_MAP, *V.ADDRESS_MAP.values()})
    n, no_word = F.size(words), F.array(F.lit(""))
    before = F.concat(no_word, F.slice(words, F.lit(1), F.greatest(n - 1, F.lit(0))))
    after = F.concat(F.slice(words, F.lit(2), F.greatest(n - 1, F.lit(0))), no_word)

    def full(word: Column, beside: Column) -> Column:
        return F.when(word.isin(*V.DIRECTIONS) & beside, lookup(word, V.DIRECTIONS)).otherwise(word)

    beside = F.zip_with(before, after, lambda b, a: b.isin(*street) | a.isin(*street))
    return F.when(n == 0, F.lit("")).otherwise(F.array_join(F.zip_with(words, beside, full), " "))


def normalize_name(name: Column, word: str = WORD, unicode: bool = True, ascii_bounds: bool = False) -> Column:
    text = F.trim(_or_empty(name))
    text = F.when(F.lower(text).isin(*V.MISSING_NAMES), F.lit("")).otherwise(text)
    return canonical_legal_form(strip_punctuation(clean_case(strip_urls(nfkc(text) if unicode else text), ascii_bounds), word))


def normalize_address(address: Column, word: str = WORD, unicode: bool = True, ascii_bounds: bool = False) -> Column:
    text = F.when(is_missing_address(address), F.lit("")).otherwise(F.trim(_or_empty(address)))
    text = strip_urls(nfkc(text) if unicode else text)
    text = strip_landmarks(plain_ordinals(strip_hash_prefix(clean_case(text, ascii_bounds)), ascii_bounds), ascii_bounds)
    return expand_address_words(strip_punctuation(text, word))


def encoder_text(norm_name: Column, norm_address: Column, missing: Column) -> Column:
    both = F.concat(norm_name, F.lit(" | "), norm_address)
    return (
        F.when((norm_name != "") & (norm_address != ""), both)
        .when((norm_name != "") & missing, F.concat(norm_name, F.lit(f" | {V.NO_ADDRESS}")))
        .when(norm_name != "", norm_name)
        .when(norm_address != "", norm_address)
        .otherwise(F.lit(V.NO_ADDRESS))
    )


def canonical_country(country: Column, unicode: bool = False) -> Column:
    text = _or_empty(country)
    key = F.regexp_replace(F.lower(F.trim(nfkc(text) if unicode else text)), r"\s+", " ")
    return lookup(key, V.COUNTRY_MAP)


def country_match(left: Column, right: Column) -> Column:
    a, b = canonical_country(left), canonical_country(right)
    return F.when((a == "") | (b == ""), F.lit(None).cast("int")).otherwise((a == b).cast("int"))


def source_of(entity_id: Column) -> Column:
    return F.regexp_extract(F.trim(_or_empty(entity_id)), r"^(S[123])-", 1)


def digit_runs(address: Column) -> Column:
    found = F.regexp_extract_all(strip_hash_prefix(F.trim(_or_empty(address))), F.lit(V.DIGIT_RUN), F.lit(0))
    return F.when(is_missing_address(address), F.array().cast("array<string>")).otherwise(found)


def _found(text: Column, missing: Column, pattern: str) -> Column:
    value = F.regexp_extract(text, pattern, 1)
    return F.when(missing | (value == ""), F.lit(None).cast("string")).otherwise(value)


def trailing_segment(address: Column) -> Column:
    return F.trim(_found(strip_hash_prefix(F.trim(_or_empty(address))), is_missing_address(address), V.TRAILING_SEGMENT))


def street_number(address: Column) -> Column:
    return _found(strip_hash_prefix(F.trim(_or_empty(address))), is_missing_address(address), V.STREET_NUMBER)


def _last(text: Column, pattern: str) -> Column:
    return F.try_element_at(F.regexp_extract_all(text, F.lit(pattern), F.lit(1)), F.lit(-1))


def postal_code(address: Column, country: Column | None = None) -> Column:
    """Postal code by country; elsewhere the PIN or ZIP that ends last.

    In the us, a ZIP that leads the address is taken for a house number: if text follows, the ZIP before it, if any, counts.
    """
    text = _or_empty(address)
    zips = F.regexp_extract_all(text, F.lit(V.ZIP), F.lit(1))
    lead = text.rlike(rf"^{V.ZIP}") | text.rlike(rf"^[ \t\n\r#]*{V.ZIP}\s*\p{{L}}")
    alone = text.rlike(rf"^[ \t\n\r#]*{V.ZIP}\s*$")
    us = F.when(F.size(zips) > 1, F.element_at(zips, -1)).when(lead & ~alone, F.lit(None)).otherwise(F.try_element_at(zips, F.lit(-1)))
    either = F.regexp_extract(F.try_element_at(F.regexp_extract_all(text, F.lit(r"\b(?:[1-9]\d{5}|\d{5}(?:-\d{4})?)\b"), F.lit(0)), F.lit(-1)), r"^(\d+)", 1)
    kind = canonical_country(country) if country is not None else F.lit("")
    code = F.when(kind == "us", us).when(kind == "india", _last(text, V.PIN)).when(kind == "france", _last(text, V.ZIP)).otherwise(F.when(either == "", F.lit(None)).otherwise(either))
    return F.when(is_missing_address(address), F.lit(None).cast("string")).otherwise(code)


def normalize_records(raw: DataFrame, word: str = WORD, raw_trailing: bool = False, unicode: bool = True, ascii_bounds: bool = False) -> DataFrame:
    """The 16 columns of a normalised record from entity_id, business_name, business_address and country.

    ``raw_trailing`` takes the trailing segment from the raw address; from the normalised one, which has no commas, it is
    always null. ``ascii_bounds`` reads acronyms and word bounds as the SQL twins do; the queries compared with them ask for it.
    """
    if unicode:  # the one step in Python comes first, alone; all else is generated code
        folded = {f"_{c}": nfkc(F.trim(_or_empty(F.col(c)))) for c in ("business_name", "business_address", "country")}
    else:
        folded = {f"_{c}": F.trim(_or_empty(F.col(c))) for c in ("business_name", "business_address", "country")}
    raw = raw.withColumns(folded)
    name, address, country = F.col("business_name"), F.col("business_address"), F.col("country")
    base = raw.select(
        F.col("entity_id").cast("string").alias("entity_id"),
        source_of(F.col("entity_id")).alias("source"),
        F.trim(_or_empty(country)).alias("country"),
        canonical_country(F.col("_country")).alias("country_canonical"),
        F.trim(_or_empty(name)).alias("raw_name"),
        F.trim(_or_empty(address)).alias("raw_address"),
        normalize_name(F.col("_business_name"), word, False, ascii_bounds).alias("norm_name"),
        F.when(is_missing_address(address), F.lit("")).otherwise(normalize_address(F.col("_business_address"), word, False, ascii_bounds)).alias("norm_address"),
        is_missing_address(address).alias("_missing"),
    )
    shape = F.when(F.col("norm_address") != "", F.col("norm_address")).otherwise(F.col("raw_address"))
    return base.select(
        "entity_id", "source", "country", "country_canonical", "raw_name", "raw_address", "norm_name", "norm_address",
        encoder_text(F.col("norm_name"), F.col("norm_address"), F.col("_missing")).alias("encoder_text"),
        F.col("_missing").cast("int").alias("is_address_missing"),
        F.when(F.col("_missing"), F.lit(None)).otherwise(postal_code(F.col("raw_address"), F.col("country"))).alias("postal_code"),
        street_number(shape).alias("street_number"),
        trailing_segment(F.col("raw_address") if raw_trailing else shape).alias("trailing_segment"),
        digit_runs(shape).alias("digit_runs"),
        F.size(split_words(F.col("norm_name"))).alias("name_token_count"),
        F.size(split_words(F.col("norm_address"))).alias("address_token_count"),
    )
