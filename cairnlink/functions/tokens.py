"""Tokens, n-grams and blocking keys as Column functions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from cairnlink.functions import fixed_values as V
from cairnlink.functions.normalize import WORD, split_words


def words(text: Column, least: int = 1, ascii_only: bool = False, word: str = WORD) -> Column:
    """Lower-case words of ``least`` characters or more. ASCII words break at accented letters."""
    found = F.regexp_extract_all(text if ascii_only else F.lower(text), F.lit("[a-z0-9]+" if ascii_only else f"[{word}]+"), F.lit(0))
    return F.filter(found, lambda w: F.length(w) >= least) if least > 1 else found


def grams(text: Column, n: int) -> Column:
    """All n-character substrings, in order. One pass of a pattern; texts with characters beyond 16 bits go by place."""
    by_place = F.transform(F.sequence(F.lit(1), F.greatest(F.length(text) - (n - 1), F.lit(1))), lambda i: F.substring(text, i, F.lit(n)))
    found = F.regexp_extract_all(text, F.lit(f"(?s)(?=(.{{{n}}}))"), F.lit(1))
    return F.when(F.length(text) < n, F.array().cast("array<string>")).when(text.rlike(r"[\x{10000}-\x{10FFFF}]"), by_place).otherwise(found)


def padded_trigrams(text: Column) -> Column:
    return F.when(text == "", F.array().cast("array<string>")).otherwise(grams(F.concat(F.lit("  "), text, F.lit("  ")), 3))


def short_grams(text: Column) -> Column:
    return F.concat(grams(text, 3), grams(text, 4))


def content_words(tokens: Column) -> Column:
    kept = F.filter(tokens, lambda w: ~w.isin(*V.NAME_STOPWORDS))
    return F.when(F.size(kept) > 0, kept).otherwise(tokens)


def first_two(tokens: Column) -> Column:
    """First two content words, or first two words if there are not as many; null if there are not two."""
    content = content_words(tokens)
    pick = F.when(F.size(content) >= 2, content).otherwise(tokens)
    return F.when(F.size(tokens) >= 2, F.array_join(F.slice(pick, 1, 2), " "))


def first_word(tokens: Column) -> Column:
    return F.coalesce(F.get(content_words(tokens), F.lit(0)), F.lit(""))


def sorted_tokens(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= 2, F.array_join(F.array_sort(F.array_distinct(tokens)), " "))


def initials_two(tokens: Column) -> Column:
    return F.when(F.size(tokens) >= 2, F.concat(F.substring(F.element_at(tokens, 1), 1, 1), F.substring(F.element_at(tokens, 2), 1, 1)))


def acronyms(raw_name: Column, norm_name: Column) -> Column:
    """All acronym keys of a name: initials of its content words and words that are acronyms themselves."""
    content = content_words(split_words(norm_name))
    two = F.when(F.size(content) >= 2, F.array(F.concat(F.substring(F.element_at(content, 1), 1, 1), F.substring(F.element_at(content, 2), 1, 1)))).otherwise(F.array().cast("array<string>"))
    full = F.array_join(F.transform(content, lambda w: F.substring(w, 1, 1)), "")
    whole = F.when(F.size(content).between(2, 6), F.array(full)).otherwise(F.array().cast("array<string>"))
    skip = sorted({*V.ACRONYM_SKIP, *V.LEGAL_MAP, *V.LEGAL_MAP.values()})
    raw = F.filter(F.regexp_extract_all(raw_name, F.lit(f"[{WORD}]+"), F.lit(0)), lambda w: (w.rlike(r"^\p{Lu}{2,5}$") | F.lower(w).isin(*V.KNOWN_ACRONYMS)) & ~F.lower(w).isin(*skip))
    return F.array_distinct(F.concat(two, whole, F.transform(raw, lambda w: F.lower(w))))


def address_tokens(norm_address: Column, missing: Column, ascii_only: bool = True) -> Column:
    found = F.filter(words(norm_address, 3, ascii_only), lambda w: ~w.isin(*V.ADDRESS_STOPWORDS))
    return F.when((missing == 1) | (norm_address == ""), F.array().cast("array<string>")).otherwise(found)


def numeric_tokens(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(text, F.lit(r"\d+"), F.lit(0)))


def word_bound_grams(text: Column, low: int = 3, high: int = 5) -> Column:
    """Character n-grams of each word with a blank on both sides; a padded word shorter than n counts once, whole."""

    def of_word(word: Column) -> Column:
        padded = F.concat(F.lit(" "), word, F.lit(" "))
        out = grams(padded, low)
        for n in range(low + 1, high + 1):
            out = F.concat(out, F.when(F.length(padded) >= n, grams(padded, n)).otherwise(F.array().cast("array<string>")))
        return out

    return F.flatten(F.transform(split_words(F.lower(text)), of_word))
