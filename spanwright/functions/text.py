"""Scalar text helpers as Spark expressions: safe casts, Unicode trimming, quote candidates, spans."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Quote, bracket and dash tokens of treebanks and what they may look like in running text (fixed values).
TREEBANK_FORMS = (
    (("``", "''", "`"), ("'", '"', "`")),
    (("'",), ("'", "\u2019", "`")),
    (('"',), ('"', "\u201c", "\u201d")),
    (("-LRB-",), ("(",)),
    (("-RRB-",), (")",)),
    (("--",), ("--", "\u2014", "\u2013")),
)
#: Pronouns that can't stand for a chain, punctuation around heads (fixed values).
PRONOUNS = "i you he she it we they me him her us them my your his hers its our their this that these those".split()
HEAD_PUNCTUATION = ".,\";\u201d\u2019 "
#: Tags of nominal tokens (fixed values).
NOMINAL_TAGS = ("NN", "NNS", "NNP", "NNPS", "PRP", "PRP$")


def to_int(c: Column) -> Column:
    """Integer of a string, null where it is none."""
    return c.try_cast("int")


def to_double(c: Column) -> Column:
    return c.try_cast("double")


def strip(c: Column) -> Column:
    """Without white space at both ends, Unicode white space included."""
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def strip_chars(c: Column, chars: str) -> Column:
    return F.btrim(c, F.lit(chars))


def present(c: Column) -> Column:
    """Neither null nor empty."""
    return c.isNotNull() & (c != "")


def slice_chars(text: Column, start: Column, end: Column) -> Column:
    """text[start:end] with 0-based ends, clamped to the text."""
    first = F.greatest(start, F.lit(0))
    return F.substring(text, (first + 1).cast("int"), F.greatest(end - first, F.lit(0)).cast("int"))


def find(text: Column, what: Column, start: Column, end: Column) -> Column:
    """0-based place of the first `what` in text[start:end], -1 if it isn't there."""
    inside = F.substring(text, F.lit(1), F.greatest(end, F.lit(0)).cast("int"))
    return F.position(what, inside, (start + 1).cast("int")) - 1


def token_id(misc: Column) -> tuple[Column, Column]:
    """Item and zone of `TokenId=item.zone` in a CoNLL misc column, null if it has none."""
    part = lambda i: to_int(F.nullif(F.regexp_extract(misc, r"TokenId=([0-9]+)\.([0-9]+)", i), F.lit("")))
    return part(1), part(2)


def candidates(form: Column) -> Column:
    """Strings that a treebank form may be in the text, in the order in which to try them."""
    out = F.when(F.lit(False), F.array(F.lit("")))
    for forms, shapes in TREEBANK_FORMS:
        out = out.when(form.isin(*forms), F.array(*map(F.lit, shapes)))
    return out.otherwise(F.array(form))


def html_escape(c: Column) -> Column:
    for raw, safe in (("&", "&amp;"), ("<", "&lt;"), (">", "&gt;"), ('"', "&quot;"), ("'", "&#x27;")):
        c = F.replace(c, F.lit(raw), F.lit(safe))
    return c


def overlaps(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Whether two half-open spans share a character; false if an end is missing."""
    return F.coalesce((a_start < b_end) & (a_end > b_start), F.lit(False))


def iou(a_start: Column, a_end: Column, b_start: Column, b_end: Column) -> Column:
    """Intersection over union of two spans, 0 if both are empty."""
    both = F.greatest(F.least(a_end, b_end) - F.greatest(a_start, b_start), F.lit(0))
    union = (a_end - a_start) + (b_end - b_start) - both
    return F.when(union <= 0, F.lit(0.0)).otherwise(both / F.nullif(union, F.lit(0)))
