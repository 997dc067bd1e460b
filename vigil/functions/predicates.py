"""Predicates as native Column expressions."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from . import vocab
from .text import dotted_prefixes, last_part, string_entropy

ColumnOrName = Column | str


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


def is_sensitive_call(name: ColumnOrName, apis=vocab.SENSITIVE_APIS, keywords=vocab.CALL_KEYWORDS) -> Column:
    """Exact API, or its last dotted part is a listed API, or a keyword substring.

    ``IN`` lists of this size become a hash ``InSet``; the keyword test is one regex.
    """
    n = _c(name)
    apis = list(apis)
    pattern = "|".join(k.replace(".", "\\.") for k in keywords)
    return F.coalesce(n.isin(apis) | last_part(n).isin(apis) | F.lower(n).rlike(pattern), F.lit(False))


_APIS = frozenset(vocab.SENSITIVE_APIS)


def sensitive_name(name: str) -> bool:
    """P1 for one name inside a task, where the extraction decides which calls get a snippet."""
    if name in _APIS or name.rpartition(".")[2] in _APIS:
        return True
    low = name.lower()
    return any(k in low for k in vocab.CALL_KEYWORDS)


def is_sensitive_import(name: ColumnOrName, modules=vocab.BLACKLIST_IMPORTS) -> Column:
    """Exact module, or case-insensitively equal to / below a listed module."""
    n = _c(name)
    lowered = sorted({m.lower() for m in modules})
    return F.coalesce(n.isin(list(modules)) | F.exists(dotted_prefixes(F.lower(n)), lambda p: p.isin(lowered)),
                      F.lit(False))


def is_weak_metadata(value: ColumnOrName) -> Column:
    """Missing, empty or a placeholder such as UNKNOWN (upper-cased compare)."""
    v = _c(value)
    return v.isNull() | (v == "") | F.upper(v).isin(list(vocab.WEAK_METADATA_VALUES))


def is_url_string(s: ColumnOrName) -> Column:
    """URL-ish or chat/paste-site marker, case-insensitive."""
    return F.coalesce(_c(s).rlike("(?iu)" + vocab.URL_PATTERN), F.lit(False))


def is_high_entropy_string(s: ColumnOrName, min_entropy: float = vocab.HIGH_ENTROPY_MIN_ENTROPY,
                           min_length: int = vocab.HIGH_ENTROPY_MIN_LENGTH) -> Column:
    """P5: entropy > 4.2 and length > 30 (length test first, so only long strings are counted)."""
    v = _c(s)
    return F.coalesce(string_entropy(F.when(F.length(v) > min_length, v)) > min_entropy, F.lit(False))


def is_long_string(s: ColumnOrName, min_length: int = vocab.LONG_STRING_MIN_LENGTH) -> Column:
    """Length > 120."""
    return F.coalesce(F.length(_c(s)) > min_length, F.lit(False))


def verdict(p: ColumnOrName, threshold: float = vocab.VERDICT_THRESHOLD) -> Column:
    """``malicious`` iff probability >= threshold."""
    return F.when(_c(p) >= threshold, F.lit("malicious")).otherwise(F.lit("benign"))
