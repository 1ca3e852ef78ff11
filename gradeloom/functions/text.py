"""Tokenising and counting inside one row."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

from gradeloom.functions.lets import int_range, let

# White space of any script: no-break and ideographic spaces count as well.
SPACE = r"(?U:\s)"

# A word is a run of two or more letters, digits or underscores.
WORD_PATTERN = r"[\p{L}\p{N}_]{2,}"


def clean_text(text: Column) -> Column:
    """Missing text counts as empty text."""
    return F.coalesce(text, F.lit(""))


def strip(text: Column) -> Column:
    """Remove any leading and trailing white space, line breaks included."""
    return F.regexp_replace(text, rf"\A{SPACE}+|{SPACE}+\z", "")


def word_tokens(text: Column) -> Column:
    return F.regexp_extract_all(F.lower(clean_text(text)), F.lit(WORD_PATTERN), F.lit(0))


def space_tokens(text: Column) -> Column:
    """Pieces between white space; an empty text has none."""
    return F.filter(F.split(clean_text(text), rf"{SPACE}+"), lambda t: t != "")


def char_tokens(text: Column, unknown: str = "<UNK>") -> Column:
    """One token per character, anything but printable ASCII becomes ``unknown``."""
    chars = F.filter(F.split(clean_text(text), ""), lambda c: c != "")
    return F.transform(chars, lambda c: F.when(c.rlike(r"^[\x20-\x7E]$"), c).otherwise(F.lit(unknown)))


def ngrams(tokens: Column, lo: int, hi: int) -> Column:
    """All n-grams with ``lo <= n <= hi`` in document order, joined by a blank."""

    def of_length(ws: Column, n: int) -> Column:
        if n == 1:
            return ws
        if n == 2:
            pairs = F.greatest(F.size(ws) - 1, F.lit(0))
            return F.zip_with(F.slice(ws, F.lit(1), pairs), F.slice(ws, F.lit(2), pairs), lambda a, b: F.concat(a, F.lit(" "), b))
        starts = int_range(1, F.size(ws) - (n - 1))
        return F.transform(starts, lambda i: F.array_join(F.slice(ws, i, F.lit(n)), " "))

    if (lo, hi) == (1, 1):
        return tokens
    return let(tokens, lambda ws: F.concat(*[of_length(ws, n) for n in range(lo, hi + 1)]))


def term_frequencies(terms: Column) -> Column:
    """``array<struct<term, tf>>`` of one row's terms.

    Sorting the row's own terms and measuring the runs needs no shuffle, so a
    scan can go straight into a per-term aggregate.
    """

    def runs(s: Column, starts: Column) -> Column:
        return F.transform(
            starts,
            lambda at, j: F.struct(
                F.get(s, at).alias("term"),
                (F.coalesce(F.get(starts, j + 1), F.size(s)) - at).cast("bigint").alias("tf"),
            ),
        )

    def run_starts(s: Column) -> Column:
        return F.array_compact(F.transform(s, lambda t, i: F.when((i == 0) | (t != F.get(s, i - 1)), i)))

    return let(F.sort_array(terms), lambda s: let(run_starts(s), lambda starts: runs(s, starts)))


def token_class(token: Column) -> Column:
    """Coarse shape tag of a token."""
    return (
        F.when(token.rlike(r"^\p{N}+$"), "NUM")
        .when(token.rlike(r"\p{N}|_"), "MIX")
        .when(F.length(token) <= 3, "SHORT")
        .when(F.length(token) <= 6, "MID")
        .otherwise("LONG")
    )


# Every tag that token_class can give.
TOKEN_CLASSES = ("NUM", "MIX", "SHORT", "MID", "LONG")
