"""Personal data by anchor expansion.

One pass of an Aho-Corasick automaton over a text finds anchors: at-signs,
plus signs, digits, URL schemes and cue words for accounts. Around each anchor a
deterministic local parser expands the span to its boundaries and validates
it. Text without anchors costs nothing more than that pass.

Kinds ``email``, ``ip``, ``card`` and ``phone`` have these bounds (spans of a
kind are leftmost and don't overlap; a span that fails its validation is
dropped without another try):

* email: local part of letters, digits and ``._%+-``, at-sign, two or more
  dot-separated labels of letters, digits and hyphens;
* ip: four dot-separated runs of digits, each at most 255;
* card: digits with single blanks or hyphens between them, 16 to 19 digits that
  pass the Luhn check;
* phone: plus sign, digit, digits, blanks and ``().-``, up to a last digit; 8 to
  15 digits.

The method adds ``url`` (scheme, ``://``, and what follows up to a blank, quote
or bracket, without closing punctuation) and ``account`` (a bank account number
in the international form, checked modulo 97, or 6 to 34 letters and digits
with a digit that follow an account cue).

Rows are independent and not shuffled: hot groups and repeated rows need no
care, and a lost task is repeated. Null and empty texts have no spans. Very long
texts are parsed whole, in time linear in their length. Offsets are in code
points, end exclusive. Input columns are carried in one nested column, so names
cannot clash.
"""

from __future__ import annotations

import re
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame, functions as F
from pyspark.sql.types import ArrayType, IntegerType, StringType, StructField, StructType

from gradeloom.llm.common import carried, pieces, require, restored, ship_code

BASE_KINDS = ("email", "ip", "card", "phone")
KINDS = (*BASE_KINDS, "account", "url")

SCHEMES = ("http://", "https://", "ftp://", "ssh://", "sftp://")
CUES = ("iban", "account", "acct", "konto", "cuenta", "compte")

_LOCAL = frozenset("ABCDEFGHIJKLMNOPQRSTUVWXYZabcdefghijklmnopqrstuvwxyz0123456789._%+-")
_DIGITS = frozenset("0123456789")
_DOMAIN = re.compile(r"[A-Za-z0-9-]+(?:\.[A-Za-z0-9-]+)+")
_QUAD = re.compile(r"[0-9]+\.[0-9]+\.[0-9]+\.[0-9]+")
_CARD = re.compile(r"[0-9](?:[\x20-]?[0-9])+")
_PHONE = re.compile(r"\+[0-9][\x20().0-9-]+[0-9]")
_URL = re.compile(r"[^\s\"'<>\[\]{}()|\\^`]+")
_IBAN = re.compile(r"[A-Z]{2}[0-9]{2}(?:[\x20]?[A-Z0-9]){11,30}")
_NUMBER = re.compile(r"(?:\s*(?:no|number|nr|num)\b\.?)?[\s:#=]*(?=[A-Z0-9-]{0,67}[0-9])([A-Z0-9](?:-?[A-Z0-9]){5,33})(?![A-Za-z0-9])")


def _automaton() -> ahocorasick.Automaton:
    out = ahocorasick.Automaton()
    for anchor, kind in ((("@"), "at"), ("+", "plus"), *((d, "digit") for d in "0123456789")):
        out.add_word(anchor, (kind, 1))
    for word in SCHEMES:
        for form in {word, word.upper(), word.capitalize()}:
            out.add_word(form, ("scheme", len(word)))
    for word in CUES:
        for form in {word, word.upper(), word.capitalize()}:
            out.add_word(form, ("cue", len(word)))
    out.make_automaton()
    return out


def luhn(digits: str) -> bool:
    total = 0
    for k, d in enumerate(map(int, reversed(digits))):
        total += d if k % 2 == 0 else (2 * d if d < 5 else 2 * d - 9)
    return total % 10 == 0


def _mod97(number: str) -> bool:
    turned = number[4:] + number[:4]
    return int("".join(str(int(c, 36)) for c in turned)) % 97 == 1


def find_spans(text: str, automaton: ahocorasick.Automaton) -> dict[str, list[tuple[int, int]]]:
    """Spans by kind, in order."""
    found: dict[str, list[tuple[int, int]]] = {k: [] for k in KINDS}
    free = dict.fromkeys(KINDS, 0)  # where the next span of a kind may begin
    for end, (anchor, length) in automaton.iter(text):
        at = end - length + 1
        if anchor == "digit":
            if at >= free["ip"] and (at == 0 or text[at - 1] not in _DIGITS or at == free["ip"]):
                if m := _QUAD.match(text, at):
                    free["ip"] = m.end()
                    if all(len(p.lstrip("0")) <= 3 and int(p.lstrip("0") or 0) <= 255 for p in m.group().split(".")):
                        found["ip"].append(m.span())
            if at >= free["card"]:
                if m := _CARD.match(text, at):
                    free["card"] = m.end()
                    digits = "".join(c for c in m.group() if c in _DIGITS) if m.end() - at <= 64 else ""
                    if 16 <= len(digits) <= 19 and luhn(digits):
                        found["card"].append(m.span())
        elif anchor == "at":
            start = at
            while start > free["email"] and text[start - 1] in _LOCAL:
                start -= 1
            if start < at and (m := _DOMAIN.match(text, at + 1)):
                found["email"].append((start, m.end()))
                free["email"] = m.end()
        elif anchor == "plus":
            if at >= free["phone"] and (m := _PHONE.match(text, at)):
                free["phone"] = m.end()
                if 8 <= sum(c in _DIGITS for c in m.group()) <= 15:
                    found["phone"].append(m.span())
        elif anchor == "scheme":
            if at >= free["url"] and (at == 0 or not text[at - 1].isalnum()) and (m := _URL.match(text, end + 1)):
                stop = m.end()
                while stop > end + 1 and text[stop - 1] in ".,;:!?":
                    stop -= 1
                if stop > end + 1:
                    found["url"].append((at, stop))
                    free["url"] = stop
        elif at >= free["account"] and not (at and text[at - 1].isalnum()):
            m = _NUMBER.match(text, end + 1)
            span = m.span(1) if m else None
            gap = end + 1
            while gap < len(text) and text[gap] in " :#=\t":
                gap += 1
            if m := _IBAN.match(text, gap):
                code = m.group().replace(" ", "")
                span = m.span() if _mod97(code) else span
            if span:
                found["account"].append(span)
                free["account"] = span[1]
    return found


SPANS = ArrayType(StructType([StructField("kind", StringType()), StructField("start", IntegerType()), StructField("end", IntegerType())]))
_SPANS = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int32()), ("end", pa.int32())]))


def _finding(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    automaton = _automaton()
    for batch in pieces(batches, "text"):
        spans = []
        for text in batch.column("text").to_pylist():
            found = find_spans(text or "", automaton)
            spans.append([{"kind": k, "start": a, "end": b} for k in KINDS for a, b in found[k]])
        yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(spans, _SPANS)], [*batch.schema.names, "spans"])


def spans(docs: DataFrame, text_col: str = "text") -> DataFrame:
    """``record`` (the other columns of the input), ``text`` and ``spans`` by kind, then start."""
    require(docs, text_col)
    ship_code(docs.sparkSession)
    rows = carried(docs, text_col)
    return rows.mapInArrow(_finding, StructType([*rows.schema.fields, StructField("spans", SPANS)]))


def redacted(docs: DataFrame, text_col: str = "text", kinds: tuple[str, ...] = KINDS) -> DataFrame:
    """The rows of the input with each span of the kinds replaced by its kind in angle brackets; where spans overlap, the earlier, then longer one counts."""
    found = spans(docs, text_col)
    some = F.filter("spans", lambda s: s["kind"].isin(*kinds))
    order = F.array_sort(F.transform(some, lambda s: F.struct(s["start"].alias("start"), (-s["end"]).alias("back"), s["kind"].alias("kind"))))
    begin = F.struct(F.lit("").alias("out"), F.lit(0).alias("at"))
    tail = lambda a, b: F.substring(F.col("text"), a + 1, b - a)
    step = lambda s, x: F.when(
        x["start"] >= s["at"],
        F.struct(F.concat(s["out"], tail(s["at"], x["start"]), F.lit("<"), x["kind"], F.lit(">")).alias("out"), (-x["back"]).alias("at")),
    ).otherwise(s)
    clean = F.aggregate(order, begin, step, lambda s: F.concat(s["out"], F.substring(F.col("text"), s["at"] + 1, F.length("text"))))
    return found.withColumn("text", F.when(F.size("spans") > 0, clean).otherwise(F.col("text"))).select(*restored(docs, text_col))
