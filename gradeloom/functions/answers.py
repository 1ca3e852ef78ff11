"""Reading a label out of a language model's free-text answer."""

from __future__ import annotations

import re

from pyspark.sql import Column, functions as F

from gradeloom.functions.lets import let
from gradeloom.functions.levels import LEVELS, parse_level

# The keys that may carry the label, in order of precedence.
LABEL_KEYS = ("score", "level", "label", "cefr")

FLAT_OBJECT = r"\{[^{}]*\}"
STRAY_BEFORE_BRACE = r"[°\s]*\}"
ANY_PAIR = r'\{\s*"([^"]+)"\s*:\s*"([^"]+)"'


def any_level(levels=LEVELS) -> str:
    """A pattern for the names of the scale, longer names first."""
    return "|".join(re.escape(l) for l in sorted(levels, key=len, reverse=True))


def keyed_level_pattern(key: str, levels=LEVELS) -> str:
    return r'(?i)\{\s*"' + re.escape(key) + rf'"\s*:\s*"({any_level(levels)})"'


def _found(text: Column, pattern: str, group: int) -> Column:
    return let(F.regexp_extract(text, pattern, group), lambda hit: F.when(hit != "", hit))


def _one(key: Column, value: Column) -> Column:
    """A one-entry map, null when the value is."""
    return let(value, lambda v: F.when(v.isNotNull(), F.create_map(key, v)))


def last_of_each_key(pairs: Column) -> Column:
    """The map with the last value of a key that occurs more than once."""

    def lasting(entries: Column) -> Column:
        later = lambda i: F.transform(F.slice(entries, i + 2, F.size(entries)), lambda e: e["key"])
        return F.map_from_entries(F.filter(entries, lambda e, i: ~F.array_contains(later(i), e["key"])))

    return let(F.map_entries(pairs), lasting)


def parse_answer(text: Column, levels=LEVELS) -> Column:
    """``map<string,string>`` found in an answer, null when there is nothing.

    Tried in turn: the first flat JSON object, a label key with a level even
    when the object is left open, any open key/value pair, a bare level.
    """
    return let(text, lambda t: _cascade(t, levels))


def _cascade(text: Column, levels) -> Column:
    flat = F.regexp_replace(_found(text, FLAT_OBJECT, 0), STRAY_BEFORE_BRACE, "}")
    whole = last_of_each_key(F.from_json(flat, "map<string,string>"))
    keyed = [_one(F.lit(k), F.upper(_found(text, keyed_level_pattern(k, levels), 1))) for k in LABEL_KEYS]
    level_or_text = lambda v: F.when(v.rlike(rf"(?i)^({any_level(levels)})$"), F.upper(v)).otherwise(v)
    tidy = let(F.trim(_found(text, ANY_PAIR, 2)), level_or_text)
    loose = _one(_found(text, ANY_PAIR, 1), tidy)
    bare = _one(F.lit("score"), _found(text, rf"\b({any_level(levels)})\b", 1))
    return F.coalesce(whole, *keyed, loose, bare)


def label_from_keys(parsed: Column, levels=LEVELS) -> Column:
    """Level named by the first label key present, or by a single entry."""
    return let(let(parsed, _picked), lambda v: parse_level(v, levels))


def _picked(parsed: Column) -> Column:
    has = [F.map_contains_key(parsed, k) for k in LABEL_KEYS]
    picked = F.when(has[0], F.element_at(parsed, F.lit(LABEL_KEYS[0])))
    for key, present in zip(LABEL_KEYS[1:], has[1:]):
        picked = picked.when(present, F.element_at(parsed, F.lit(key)))
    return picked.when(F.size(parsed) == 1, F.get(F.map_values(parsed), F.lit(0)))
