"""Text functions as column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


#: Words and different words that a text needs to support a summary.
MIN_SUMMARY_WORDS, MIN_DIFFERENT_WORDS = 100, 20


def strip(c: Column) -> Column:
    """A text without white space at its ends."""
    return F.regexp_replace(c, r"^\s+|\s+$", "")


def collapse(c: Column) -> Column:
    """White space runs as one blank, none at the ends."""
    return F.trim(F.regexp_replace(c, r"\s+", " "))


def words(c: Column, first: int | None = None) -> Column:
    """Words between white space; with `first` at least so many of them, after which the rest of the text may stand as one."""
    # white space at the start makes one empty piece more
    return F.filter(F.split(c, r"\s+", -1 if first is None else first + 2), lambda w: w != "")


def lower_tokens(c: Column) -> Column:
    """Lower-case runs of letters and digits of any script."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"[\p{L}\p{N}]+"), F.lit(0))


def is_repetitive(c: Column, least: int = MIN_SUMMARY_WORDS, few: int = MIN_DIFFERENT_WORDS) -> Column:
    """At least `least` tokens, fewer than `few` different ones."""
    t = lower_tokens(c)
    return (F.size(t) >= least) & (F.size(F.array_distinct(t)) < few)


def is_informative(c: Column, least: int = MIN_SUMMARY_WORDS, few: int = MIN_DIFFERENT_WORDS) -> Column:
    """At least `least` tokens, `few` or more different ones."""
    t = lower_tokens(c)
    return (F.size(t) >= least) & (F.size(F.array_distinct(t)) >= few)


def numbers(c: Column) -> Column:
    """Sorted numbers of a text."""
    return F.array_sort(F.regexp_extract_all(c, F.lit(r"[0-9]+"), F.lit(0)))


def clean_is_faithful(cleaned: Column, raw: Column) -> Column:
    """No leaked JSON, not much longer than the source, and the same numbers."""
    n = F.length(raw)
    fits = F.length(cleaned) <= F.greatest(2 * n, n + 80)
    return ~F.trim(cleaned).startswith("{") & fits & (numbers(cleaned) == numbers(raw))


def json_field(c: Column, field: str) -> Column:
    """A field of fenced JSON, of a whole JSON text, or what a pattern finds."""
    fenced = F.regexp_extract(c, r"(?s)```(?:json)?\s*(\{.*?\})\s*```", 1)
    found = F.regexp_extract(c, rf'"{field}"\s*:\s*"([^"]*)"', 1)
    path = f"$.{field}"
    get = lambda x: F.get_json_object(F.when(x != "", x), path)
    return F.coalesce(get(fenced), F.get_json_object(c, path), F.when(found != "", found))


def word_chunks(c: Column, size: int) -> Column:
    """Array of texts of `size` words each, the last may be shorter."""
    w = words(c)
    starts = F.sequence(F.lit(1), F.greatest(F.size(w), F.lit(1)), F.lit(size))
    return F.filter(F.transform(starts, lambda i: F.array_join(F.slice(w, i, size), " ")), lambda x: x != "")


def packed_words(c: Column, most: int) -> Column:
    """Words packed greedily into texts of at most `most` characters; longer words are cut into pieces."""
    pieces = F.flatten(
        F.transform(
            words(c),
            lambda w: F.transform(
                F.sequence(F.lit(0), F.floor((F.length(w) - 1) / most).cast("int")), lambda i: F.substr(w, i * most + 1, F.lit(most))
            ),
        )
    )
    start = F.struct(F.expr("cast(array() as array<string>)").alias("done"), F.lit("").alias("open"))

    def step(s, w):
        fits = F.length(s["open"]) + 1 + F.length(w) <= most
        fresh = s["open"] == ""
        return F.struct(
            F.when(fresh | fits, s["done"]).otherwise(F.concat(s["done"], F.array(s["open"]))).alias("done"),
            F.when(fresh, w).when(fits, F.concat_ws(" ", s["open"], w)).otherwise(w).alias("open"),
        )

    end = lambda s: F.when(s["open"] == "", s["done"]).otherwise(F.concat(s["done"], F.array(s["open"])))
    return F.aggregate(pieces, start, step, end)


#: Fixed value: how the last word of a sentence ends; quotes and brackets may close after the stop.
SENTENCE_END = r"[.!?…][\"'”’)]*$"


def extract_summary(c: Column, low: int = 101, high: int = 180) -> Column:
    """Up to the last sentence end among words `low` to `high`, else the first `high` words."""
    w = words(c, high + 1)
    # a lambda that names w would split the text again for every word
    ends = F.transform(F.slice(w, low, high - low + 1), lambda x, i: F.when(x.rlike(SENTENCE_END), i + low))
    cut = F.coalesce(F.array_max(ends), F.lit(high))
    return F.when(F.size(w) <= high, F.array_join(w, " ")).otherwise(F.array_join(F.slice(w, F.lit(1), cut), " "))


def same_tokens(a: Column, b: Column) -> Column:
    """The same multiset of tokens."""
    return F.array_sort(lower_tokens(a)) == F.array_sort(lower_tokens(b))


def join_texts(regions: Column) -> Column:
    """Stripped non-empty texts joined by a blank."""
    return F.array_join(F.filter(F.transform(regions, lambda t: F.trim(t)), lambda t: t != ""), " ")
