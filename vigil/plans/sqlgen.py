"""DuckDB SQL fragments generated from the fixed vocabularies.

Used only to write oracle queries (independent re-statements of the same rules
in plain SQL), so the oracle and the Spark operators read the same word lists.
"""

from __future__ import annotations

from ..functions import vocab


def _lit(s: str) -> str:
    return "'" + s.replace("'", "''") + "'"


def in_list(values) -> str:
    return "(" + ", ".join(_lit(v) for v in values) + ")"


def sensitive_call(expr: str) -> str:
    """P1 in DuckDB SQL."""
    apis = in_list(vocab.SENSITIVE_APIS)
    kw = "|".join(vocab.CALL_KEYWORDS)
    return (f"(({expr}) IN {apis} OR string_split({expr}, '.')[-1] IN {apis} "
            f"OR regexp_matches(lower({expr}), '{kw}'))")


def sensitive_import(expr: str) -> str:
    """P2 in DuckDB SQL."""
    exact = in_list(vocab.BLACKLIST_IMPORTS)
    lowered = sorted({m.lower() for m in vocab.BLACKLIST_IMPORTS})
    ors = " OR ".join(f"lower({expr}) = {_lit(m)} OR starts_with(lower({expr}), {_lit(m + '.')})" for m in lowered)
    return f"(({expr}) IN {exact} OR {ors})"


def md5_bucket(expr: str, n: int) -> str:
    """F1 (md5 flavour) in DuckDB SQL."""
    return f"CAST(('0x' || substr(md5({expr}), 1, 8))::BIGINT % {n} AS INTEGER)"


def keyword_presence_count(expr: str, words=vocab.SUSPICIOUS_WORDS) -> str:
    return "(" + " + ".join(f"(CASE WHEN contains(lower({expr}), {_lit(w)}) THEN 1 ELSE 0 END)" for w in words) + ")"


def keyword_occurrence_count(expr: str, words=vocab.SUSPICIOUS_WORDS) -> str:
    return "(" + " + ".join(
        f"CAST((length(lower({expr})) - length(replace(lower({expr}), {_lit(w)}, ''))) / {len(w)} AS BIGINT)"
        for w in words) + ")"


def sigmoid(expr: str) -> str:
    return f"(CASE WHEN ({expr}) < -50 THEN 0.0 WHEN ({expr}) > 50 THEN 1.0 ELSE 1.0 / (1.0 + exp(-({expr}))) END)"


def url_string(expr: str) -> str:
    return f"regexp_matches({expr}, '{vocab.URL_PATTERN}', 'i')"
