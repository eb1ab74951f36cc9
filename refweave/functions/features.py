"""Pair features as Column expressions over arrays and strings that are derived once a row, before any join."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .text import blank, first_names, last_names, once, year_int

MISSING_YEARS = 100


def ratio(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))  # names each side once, as it may be dear


def text_side(title: Column, note_norm: Column, note: Column) -> Column:
    empty = F.lit("")
    return F.trim(F.coalesce(F.nullif(blank(title), empty), F.nullif(blank(note_norm), empty), blank(note)))


def token_side(title_tokens: Column, text: Column) -> Column:
    return F.when(F.size(F.coalesce(title_tokens, F.array())) > 0, title_tokens).otherwise(F.filter(F.split(text, r"\s+"), lambda t: t != ""))


def author_side(authors_norm: Column, authors: Column) -> Column:
    none = F.array().cast("array<string>")
    chosen = F.when(F.size(F.coalesce(authors_norm, none)) > 0, authors_norm).otherwise(F.coalesce(authors, none))
    return F.transform(F.filter(chosen, lambda a: a.isNotNull() & (a != "")), lambda a: F.lower(F.trim(a)))


def levenshtein(a: Column, b: Column) -> Column:
    longest = F.greatest(F.length(a), F.length(b))
    return F.when((a == "") | (b == ""), F.lit(0.0)).when(a == b, F.lit(1.0)).otherwise(1 - F.levenshtein(a, b) / longest)


def jaccard(a: Column, b: Column) -> Column:
    return ratio(F.size(F.array_intersect(a, b)), F.size(F.array_union(a, b)))


def jaccard_of_sizes(a: Column, b: Column, n_a: Column, n_b: Column) -> Column:
    """jaccard_if_both() of arrays whose numbers of distinct members are known."""
    return once(F.size(F.array_intersect(a, b)), lambda both: ratio(both, n_a + n_b - both))


def jaccard_if_both(a: Column, b: Column) -> Column:
    return F.when((F.size(a) == 0) | (F.size(b) == 0), F.lit(0.0)).otherwise(jaccard(a, b))


def token_overlap(a: Column, b: Column) -> Column:
    return F.size(F.array_intersect(a, b))


def token_overlap_ratio(a: Column, b: Column) -> Column:
    return ratio(token_overlap(a, b), F.greatest(F.size(a), F.size(b)))


def ngrams(text: Column, n: int) -> Column:
    """The distinct character n-grams of the lower-cased text without white space."""
    none = F.array().cast("array<string>")
    made = lambda c: F.array_distinct(F.transform(F.sequence(F.lit(1), F.greatest(F.length(c) - n + 1, F.lit(1))), lambda i: F.substring(c, i, F.lit(n))))
    return once(F.lower(F.regexp_replace(text, r"\s+", "")), lambda c: F.when(F.length(c) >= n, made(c)).otherwise(none))


def shared_name(a: Column, b: Column) -> Column:
    return F.coalesce(F.arrays_overlap(a, b), F.lit(False)).cast("double")


def digit_overlap(a: Column, b: Column) -> Column:
    of = lambda x: F.regexp_extract_all(x, F.lit("([0-9]+)"), 1)
    return F.size(F.array_intersect(of(a), of(b)))


def with_plain_sides(rows: DataFrame, side: str, title: Column, note_norm: Column, note: Column, title_tokens: Column, authors_norm: Column, authors: Column) -> DataFrame:
    """with_sides() without n-grams, which take much more room than all else."""
    rows = rows.withColumn(f"{side}_text", text_side(title, note_norm, note))
    rows = rows.withColumns({f"{side}_tokens": token_side(title_tokens, F.col(f"{side}_text")), f"{side}_authors": author_side(authors_norm, authors), f"{side}_year": year_int(F.col("year"))})
    return rows.withColumns({f"{side}_last": last_names(F.col(f"{side}_authors")), f"{side}_first": first_names(F.col(f"{side}_authors"))})


def with_ngrams(rows: DataFrame, side: str) -> DataFrame:
    return rows.withColumns({f"{side}_g{n}": ngrams(F.col(f"{side}_text"), n) for n in (3, 4, 5)})


def with_sides(rows: DataFrame, side: str, title: Column, note_norm: Column, note: Column, title_tokens: Column, authors_norm: Column, authors: Column) -> DataFrame:
    """Columns that the features of this side need, made before the pair join; `side` prefixes them."""
    return with_ngrams(with_plain_sides(rows, side, title, note_norm, note, title_tokens, authors_norm, authors), side)


def features(b: str = "b", r: str = "r") -> dict[str, Column]:
    """The features of a pair whose sides with_sides() has made, in their order; author_firstname_match and digit_overlap on top."""
    of = lambda side, name: F.col(f"{side}_{name}")
    pair = lambda name: (of(b, name), of(r, name))
    years = pair("year")
    return {
        "levenshtein": levenshtein(*pair("text")),
        "jaccard": jaccard(*pair("tokens")),
        "token_overlap": token_overlap(*pair("tokens")),
        "token_overlap_ratio": token_overlap_ratio(*pair("tokens")),
        **{f"char_ngram_{n}": jaccard_of_sizes(*pair(f"g{n}"), *map(F.size, pair(f"g{n}"))) for n in (3, 4, 5)},
        "author_overlap": jaccard_if_both(*pair("authors")),
        "author_lastname_match": shared_name(*pair("last")),
        "year_match": F.coalesce(years[0] == years[1], F.lit(False)).cast("int"),
        "year_diff": F.coalesce(F.abs(years[0] - years[1]), F.lit(MISSING_YEARS)),
        "source_year": years[0],
        "cand_year": years[1],
        "author_firstname_match": shared_name(*pair("first")),
        "digit_overlap": digit_overlap(*pair("text")),
    }
