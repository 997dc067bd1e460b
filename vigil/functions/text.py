"""String functions as native Column expressions.

Everything here stays inside Catalyst / whole-stage codegen except the optional
BLAKE2b bucket, which is an Arrow-batched pandas UDF meant to run over distinct
tokens only.
"""

from __future__ import annotations

import hashlib

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import vocab

ColumnOrName = Column | str

# Python's str.split() treats these as whitespace; Java's \s does not cover them all.
PY_WHITESPACE_CLASS = "[\\s\\x1c-\\x1f\\x85\\xa0\\u1680\\u2000-\\u200a\\u2028\\u2029\\u202f\\u205f\\u3000]"


def _c(col: ColumnOrName) -> Column:
    return F.col(col) if isinstance(col, str) else col


# --------------------------------------------------------------------- F1 ---

def md5_bucket(col: ColumnOrName, buckets: int) -> Column:
    """Stable bucket: first 32 bits of md5(utf-8 text) mod ``buckets``."""
    return (F.conv(F.substring(F.md5(_c(col)), 1, 8), 16, 10).cast("bigint") % F.lit(buckets)).cast("int")


def md5_buckets(texts, buckets: int) -> list[int | None]:
    """The buckets of :func:`md5_bucket` for many texts, inside a task."""
    return [None if t is None else int.from_bytes(hashlib.md5(t.encode("utf-8", "replace")).digest()[:4]) % buckets for t in texts]


# Fixed values of the BLAKE2b bucket: eight digest bytes, read as a little-endian number.
BLAKE2B_BYTES, BLAKE2B_ORDER = 8, "<u8"


def blake2b_buckets(texts, buckets: int) -> list[int | None]:
    """The BLAKE2b buckets of many texts: all digests joined, read as numbers at once."""
    known = [t for t in texts if t is not None]
    joined = b"".join(hashlib.blake2b(t.encode("utf-8", "ignore"), digest_size=BLAKE2B_BYTES).digest() for t in known)
    found = iter((np.frombuffer(joined, BLAKE2B_ORDER) % np.uint64(buckets)).tolist())
    return [None if t is None else next(found) for t in texts]


def buckets_of(texts, buckets: int = vocab.HASH_BUCKETS, hash: str = "md5") -> list[int | None]:
    """:func:`bucket` for many texts, inside a task that holds them."""
    if hash not in ("md5", "blake2b"):
        raise ValueError(f"unknown hash {hash!r}")
    return (md5_buckets if hash == "md5" else blake2b_buckets)(texts, buckets)


def bucket_array(texts: list[bytes], buckets: int, hash: str = "md5", prefix: bytes = b"") -> np.ndarray:
    """:func:`bucket` of ``prefix`` + text for many UTF-8 texts, inside a task: all digests joined, read as numbers at once."""
    if hash not in ("md5", "blake2b"):
        raise ValueError(f"unknown hash {hash!r}")
    whole = [prefix + t for t in texts] if prefix else texts
    if hash == "md5":
        md5 = hashlib.md5
        return np.frombuffer(b"".join([md5(t).digest() for t in whole]), ">u4")[::4].astype(np.int64) % buckets
    digests = b"".join([hashlib.blake2b(t, digest_size=BLAKE2B_BYTES).digest() for t in whole])
    return (np.frombuffer(digests, BLAKE2B_ORDER) % np.uint64(buckets)).astype(np.int64)


def _blake2b_bucket_udf(buckets: int):
    @F.pandas_udf("int")
    def udf(s: pd.Series) -> pd.Series:
        return pd.Series(blake2b_buckets(s.tolist(), buckets), dtype="Int32")
    return udf


def bucket(col: ColumnOrName, buckets: int = vocab.HASH_BUCKETS, hash: str = "md5") -> Column:
    """Feature-hash bucket of a string (F1).

    ``hash="md5"`` is native and oracle-checkable; ``hash="blake2b"`` reproduces the
    original detector's bucket numbers exactly (Arrow UDF - apply it to distinct
    names, as the operators in this package do).
    """
    if hash == "md5":
        return md5_bucket(col, buckets)
    if hash == "blake2b":
        return _blake2b_bucket_udf(buckets)(_c(col))
    raise ValueError(f"unknown hash {hash!r}")


# --------------------------------------------------------------------- F2 ---

def characters(col: ColumnOrName) -> Column:
    """Array of the code points of a string (surrogate pairs kept whole)."""
    return F.regexp_extract_all(_c(col), F.lit("(?s)."), 0)


def _counted(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The distinct code points of a text and their counts, in one pass over its UTF-32 form."""
    return np.unique(np.frombuffer(text.encode("utf-32-le", "surrogatepass"), "<u4"), return_counts=True)


def char_histogram(col: ColumnOrName) -> Column:
    """ARRAY<STRUCT<ch STRING, cnt BIGINT>> of distinct characters and their counts (Arrow batches)."""
    @F.pandas_udf("array<struct<ch:string,cnt:bigint>>")
    def udf(s: pd.Series) -> pd.Series:
        return s.map(lambda t: [{"ch": chr(c), "cnt": int(n)} for c, n in zip(*_counted(t or ""))])
    return udf(_c(col))


#: Code points that one histogram of many texts holds at most, and cells of it.
_POINTS, _CELLS = 1 << 20, 1 << 22


def character_counts(texts: list[str], groups: np.ndarray, n: int) -> tuple[np.ndarray, np.ndarray]:
    """``(points, counts)``: the distinct code points of all texts, and how often each of ``n`` groups has them (n x points).

    ``groups`` numbers the group of each text.
    """
    at = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), "<u4")
    seen = np.zeros(0x110000, bool)
    seen[at] = True
    points = np.flatnonzero(seen)
    place = np.zeros(0x110000, np.int64)
    place[points] = np.arange(len(points))
    of = np.repeat(np.asarray(groups, np.int64), [len(t) for t in texts])
    return points, np.bincount(of * len(points) + place[at], minlength=n * len(points)).reshape(n, len(points))


def entropies(texts: list[str]) -> np.ndarray:
    """Entropy in bits over the characters of each text, many texts as one histogram."""
    out, begin = np.zeros(len(texts)), 0
    while begin < len(texts):
        end, held = begin, 0
        while end < len(texts) and (end == begin or held + len(texts[end]) <= _POINTS) and end - begin < 512:
            held += len(texts[end])
            end += 1
        own = texts[begin:end]
        if held:
            points, counts = character_counts(own, np.arange(len(own)), len(own))
            p = counts / np.maximum(counts.sum(axis=1, keepdims=True), 1)
            out[begin:end] = -(p * np.log2(np.where(p > 0, p, 1.0))).sum(axis=1)
        begin = end
    return out


def string_entropy(col: ColumnOrName) -> Column:
    """F2 for many short strings: null for null, one histogram for many of them (Arrow batches)."""
    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        known = s.notna().to_numpy()
        out = np.full(len(s), np.nan)
        out[known] = entropies(s[known].tolist())
        return pd.Series(pd.arrays.FloatingArray(np.nan_to_num(out), ~known))
    return udf(_c(col))


def text_entropy(col: ColumnOrName) -> Column:
    """F2 for long texts: entropy in bits over characters, one pass over each text (Arrow batches).

    The native :func:`shannon_entropy` reads a text once for each distinct character; it suits short strings.
    """
    @F.pandas_udf("double")
    def udf(s: pd.Series) -> pd.Series:
        def one(t):
            if not t:
                return 0.0
            p = _counted(t)[1] / len(t)
            return float(-(p * np.log2(p)).sum())
        return s.map(one).astype("float64")
    return udf(_c(col))


def shannon_entropy(col: ColumnOrName) -> Column:
    """Shannon entropy in bits over characters; 0.0 for empty or null text (F2)."""
    t = _c(col)
    n = F.length(t).cast("double")
    # one O(len) replace per distinct character: counts first, then sum -p*log2(p)
    counts = F.transform(F.array_distinct(characters(t)), lambda ch: n - F.length(F.replace(t, ch, F.lit(""))))
    h = F.aggregate(counts, F.lit(0.0), lambda acc, k: acc - (k / n) * F.log2(k / n))
    return F.when(t.isNull() | (F.length(t) == 0), F.lit(0.0)).otherwise(h)


def entropy_from_counts(total: ColumnOrName, sum_c_log2_c: ColumnOrName) -> Column:
    """Entropy from a histogram summary: log2(N) - sum(c*log2 c)/N; 0 when N = 0."""
    n = _c(total).cast("double")
    return F.when(n > 0, F.log2(n) - _c(sum_c_log2_c) / n).otherwise(F.lit(0.0))


def histogram_entropy(df: DataFrame, keys: list[str], ch: str = "ch", cnt: str = "cnt",
                      out: str = "entropy") -> DataFrame:
    """Entropy of a text given as per-piece character histograms (rows keys+ch+cnt).

    Pieces of one text add up, so the joined text is never built: first sum the
    counts per character (partial aggregation), then one row per key.
    """
    per_char = df.groupBy(*keys, ch).agg(F.sum(cnt).alias("_c"))
    return per_char.groupBy(*keys).agg(
        entropy_from_counts(F.sum("_c"), F.sum(F.col("_c") * F.log2(F.col("_c")))).alias(out))


# ----------------------------------------------------------------- F5/F6 ---

def word_tokens(col: ColumnOrName) -> Column:
    """Identifier-like words of 3+ chars from lower-cased text."""
    return F.regexp_extract_all(F.lower(_c(col)), F.lit(vocab.WORD_PATTERN), 0)


def embed_tokens(col: ColumnOrName) -> Column:
    """Tokens used by the hashed text embedding."""
    return F.regexp_extract_all(F.lower(F.coalesce(_c(col), F.lit(""))), F.lit(vocab.EMBED_TOKEN_PATTERN), 0)


# ----------------------------------------------------------------- F7/F8 ---

def keyword_presence_count(col: ColumnOrName, words=vocab.SUSPICIOUS_WORDS) -> Column:
    """Number of dictionary words contained (each counted once) in lower(text)."""
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + F.when(F.instr(low, w) > 0, 1).otherwise(0)
    return total


def keyword_presence(col: ColumnOrName, words=vocab.SUSPICIOUS_WORDS, scale: float = 20.0) -> Column:
    """words present / 20 (uncapped)."""
    return keyword_presence_count(col, words) / F.lit(scale)


def keyword_occurrence_count(col: ColumnOrName, words=vocab.SUSPICIOUS_WORDS) -> Column:
    """Sum over words of non-overlapping occurrence counts in lower(text).

    Additive over pieces of a text that no word can span, so per-piece then sum.
    """
    low = F.lower(F.coalesce(_c(col), F.lit("")))
    total = F.lit(0)
    for w in words:
        total = total + ((F.length(low) - F.length(F.replace(low, F.lit(w), F.lit("")))) / F.lit(len(w))).cast("bigint")
    return total


def keyword_occurrences(col: ColumnOrName, words=vocab.SUSPICIOUS_WORDS, scale: float = 50.0) -> Column:
    """F8: total occurrences / 50 (uncapped)."""
    return keyword_occurrence_count(col, words) / F.lit(scale)


# ---------------------------------------------------------------- F9-F12 ---

def collapse_whitespace(col: ColumnOrName) -> Column:
    """Python's ``" ".join(v.split())``."""
    return F.trim(F.regexp_replace(_c(col), PY_WHITESPACE_CLASS + "+", " "))


def normalize_key(col: ColumnOrName) -> Column:
    """``_`` to ``-`` then lower case."""
    return F.lower(F.translate(_c(col), "_", "-"))


def last_part(col: ColumnOrName) -> Column:
    """text after the last dot (whole name when undotted)."""
    return F.substring_index(_c(col), ".", -1)


def root_part(col: ColumnOrName) -> Column:
    """text before the first dot."""
    return F.substring_index(_c(col), ".", 1)


def dotted_prefixes(col: ColumnOrName) -> Column:
    """All dot-boundary prefixes of a name, shortest first (``a``, ``a.b``, ``a.b.c``)."""
    parts = F.split(_c(col), "\\.", -1)
    return F.transform(F.sequence(F.lit(1), F.size(parts)), lambda i: F.array_join(F.slice(parts, 1, i), "."))


def split_lines(col: ColumnOrName) -> Column:
    """Lines of newline-translated text, like ``str.splitlines`` on ``\\n`` only."""
    t = _c(col)
    return F.when((t.isNull()) | (F.length(t) == 0), F.array().cast("array<string>")).otherwise(
        F.split(F.regexp_replace(t, "\n\\z", ""), "\n", -1))


def dense(pairs: ColumnOrName, at: str, value: str, size: int) -> Column:
    """Sorted ``(at, value)`` structs as an array of ``size`` doubles: zeros fill the gaps, in one pass over the pairs."""
    p = _c(pairs)
    gaps = F.transform(p, lambda x, i: F.concat(
        F.array_repeat(F.lit(0.0), F.greatest(F.lit(0), (x[at] - F.when(i == 0, F.lit(-1)).otherwise(F.get(p, i - 1)[at]) - 1).cast("int"))),
        F.array(x[value].cast("double"))))
    last = F.coalesce(F.get(p, F.size(p) - 1)[at], F.lit(-1))
    return F.concat(F.flatten(gaps), F.array_repeat(F.lit(0.0), (F.lit(size - 1) - last).cast("int")))
