"""Query catalogue over the driver tables: Spark plans and their DuckDB oracles.

Every query reads whole driver tables (or data Spark derives from them); the
oracle is an independent statement of the same rule in plain SQL.
"""

from __future__ import annotations

import uuid
from collections.abc import Callable, Iterator

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..operators import counts as C
from ..operators import graph as G
from ..operators import ranking as R
from ..operators.extract import extract_facts, fact_snippets, stored_facts
from ..session import ensure_checkpoint_dir, saved, saved_path
from ..sources import files as SF
from ..sources import sinks as SK
from . import fixtures
from . import sqlgen as S

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}

_FACTS_CACHE: dict[tuple, DataFrame] = {}


def register(name: str, oracle: str | None = None):
    def deco(fn):
        QUERIES[name] = fn
        if oracle is not None:
            ORACLES[name] = oracle
        return fn
    return deco


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir.rstrip('/')}/{name}.parquet")


def event_facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Extracted facts of the events-derived corpus, stored by kind once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _FACTS_CACHE:
        units = fixtures.event_source_units(table(spark, sf_dir, "events"))
        _FACTS_CACHE[key] = stored_facts(extract_facts(units))
    return _FACTS_CACHE[key]


def event_units(spark: SparkSession, sf_dir: str) -> DataFrame:
    return fixtures.event_source_units(table(spark, sf_dir, "events"))


OK = fixtures.ORACLE_EVENT_FACTS


# ------------------------------------------------------------------ round trip ---

@register("rt_top_sensitive_apis", f"""
WITH {OK},
c AS (SELECT package_id, api AS name, count(*) AS cnt, min(path) AS fpath FROM okev GROUP BY 1, 2),
f AS (SELECT c.package_id, c.name, c.cnt, c.fpath, min(o.event_id) AS feid
      FROM c JOIN okev o ON o.package_id = c.package_id AND o.api = c.name AND o.path = c.fpath
      GROUP BY 1, 2, 3, 4),
r AS (SELECT package_id, name AS api, CAST(cnt AS BIGINT) AS cnt,
             CAST(row_number() OVER (PARTITION BY package_id ORDER BY cnt DESC, fpath, feid) AS BIGINT) AS rank
      FROM f WHERE {S.sensitive_call('name')})
SELECT * FROM r WHERE rank <= 20
""")
def q_rt_top_sensitive_apis(spark, sf_dir):
    """Flagship: extract -> count calls -> sensitive filter -> per-package top 20."""
    facts = event_facts(spark, sf_dir)
    calls = C.count_names(facts, "call").where(P.is_sensitive_call("name"))
    top = R.top_k_names(calls, 20)
    return top.select("package_id", F.col("name").alias("api"), "cnt", F.col("rank").cast("bigint").alias("rank"))


@register("rt_calls", f"""
WITH {OK}
SELECT package_id, api AS name, CAST(count(*) AS BIGINT) AS cnt FROM okev GROUP BY 1, 2
""")
def q_rt_calls(spark, sf_dir):
    return C.count_names(event_facts(spark, sf_dir), "call").select("package_id", "name", "cnt")


@register("rt_imports", f"""
WITH {OK},
okf AS (SELECT * FROM files WHERE NOT broken),
imps AS (
  SELECT package_id, event_type || '.core' AS name FROM okf
  UNION ALL SELECT package_id, event_type FROM okf
  UNION ALL SELECT package_id, CASE event_type WHEN 'error' THEN 'xml.dom.minidom'
                                              WHEN 'purchase' THEN 'subprocess' ELSE 'json' END FROM okf
  UNION ALL SELECT package_id, 'xml' FROM okf WHERE event_type = 'error')
SELECT package_id, name, CAST(count(*) AS BIGINT) AS cnt FROM imps GROUP BY 1, 2
""")
def q_rt_imports(spark, sf_dir):
    return C.count_names(event_facts(spark, sf_dir), "import").select("package_id", "name", "cnt")


@register("rt_edges", f"""
WITH {OK},
e AS (SELECT package_id, '<module>' AS src, path || ':f' || CAST(event_id AS VARCHAR) AS dst FROM okev
      UNION ALL
      SELECT package_id, path || ':f' || CAST(event_id AS VARCHAR), api FROM okev)
SELECT package_id, src, dst, CAST(count(*) AS BIGINT) AS weight FROM e GROUP BY 1, 2, 3
""")
def q_rt_edges(spark, sf_dir):
    return C.edge_weights(event_facts(spark, sf_dir)).select("package_id", "src", "dst", "weight")


@register("rt_strings", f"""
WITH {OK}
SELECT package_id, CAST(count(*) AS BIGINT) AS n_strings, CAST(sum(length(props)) AS BIGINT) AS total_chars,
       CAST(count(*) FILTER (WHERE {S.url_string('props')}) AS BIGINT) AS url_strings,
       CAST(count(*) FILTER (WHERE length(props) > 120) AS BIGINT) AS long_strings
FROM okev WHERE props <> '' GROUP BY 1
""")
def q_rt_strings(spark, sf_dir):
    s = event_facts(spark, sf_dir).where(F.col("kind") == "string")
    return s.groupBy("package_id").agg(
        F.count(F.lit(1)).alias("n_strings"),
        F.sum(F.length("value")).cast("bigint").alias("total_chars"),
        F.count_if(P.is_url_string("value")).alias("url_strings"),
        F.count_if(P.is_long_string("value")).alias("long_strings"))


@register("rt_blocks", f"""
WITH {OK}
SELECT package_id, CAST(count(*) FILTER (WHERE event_id % 3 IN (0, 1)) AS BIGINT) AS cfg_nodes,
       CAST(2 * count(*) FILTER (WHERE event_id % 3 IN (0, 1)) AS BIGINT) AS cfg_edges,
       CAST(max(CASE WHEN event_id % 3 IN (0, 1) THEN 1 ELSE 0 END) AS INTEGER) AS max_nesting
FROM okev GROUP BY 1
""")
def q_rt_blocks(spark, sf_dir):
    sc = C.package_scalars(event_facts(spark, sf_dir))
    return sc.where(F.col("python_files") > F.col("parse_errors")).select(
        "package_id", F.col("cfg_nodes").cast("bigint").alias("cfg_nodes"), "cfg_edges", "max_nesting")


@register("rt_parse_errors", f"""
WITH {OK}
SELECT package_id, CAST(count(*) AS BIGINT) AS python_files,
       CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS parse_errors,
       CAST(count(*) FILTER (WHERE broken) AS BIGINT) AS analysis_errors,
       round(count(*) FILTER (WHERE broken) / greatest(1, count(*)), 6) AS parse_error_ratio
FROM files GROUP BY 1
""")
def q_rt_parse_errors(spark, sf_dir):
    sc = C.package_scalars(event_facts(spark, sf_dir))
    return sc.select("package_id", F.col("python_files").cast("bigint").alias("python_files"),
                     F.col("parse_errors").cast("bigint").alias("parse_errors"),
                     F.col("analysis_errors").cast("bigint").alias("analysis_errors"),
                     F.round(F.col("parse_errors") / F.greatest(F.lit(1), F.col("python_files")), 6)
                     .alias("parse_error_ratio"))


_IMPORTS_CTE = """
okf AS (SELECT * FROM files WHERE NOT broken),
imps AS (
  SELECT package_id, event_type || '.core' AS name FROM okf
  UNION ALL SELECT package_id, event_type FROM okf
  UNION ALL SELECT package_id, CASE event_type WHEN 'error' THEN 'xml.dom.minidom'
                                              WHEN 'purchase' THEN 'subprocess' ELSE 'json' END FROM okf
  UNION ALL SELECT package_id, 'xml' FROM okf WHERE event_type = 'error'),
ic AS (SELECT package_id, name, count(*) AS cnt FROM imps GROUP BY 1, 2)"""


@register("rt_sensitive_totals", f"""
WITH {OK}, {_IMPORTS_CTE},
ac AS (SELECT package_id, api AS name, count(*) AS cnt FROM okev GROUP BY 1, 2),
a AS (SELECT package_id, count(*) AS api_unique, sum(cnt) AS api_total,
             count(*) FILTER (WHERE {S.sensitive_call('name')}) AS sensitive_api_unique,
             coalesce(sum(cnt) FILTER (WHERE {S.sensitive_call('name')}), 0) AS sensitive_api_total
      FROM ac GROUP BY 1),
i AS (SELECT package_id, count(*) AS import_unique, sum(cnt) AS import_total,
             count(*) FILTER (WHERE {S.sensitive_import('name')}) AS sensitive_import_unique,
             coalesce(sum(cnt) FILTER (WHERE {S.sensitive_import('name')}), 0) AS sensitive_import_total
      FROM ic GROUP BY 1)
SELECT coalesce(a.package_id, i.package_id) AS package_id,
       CAST(a.api_unique AS BIGINT) AS api_unique, CAST(a.api_total AS BIGINT) AS api_total,
       CAST(a.sensitive_api_unique AS BIGINT) AS sensitive_api_unique,
       CAST(a.sensitive_api_total AS BIGINT) AS sensitive_api_total,
       CAST(i.import_unique AS BIGINT) AS import_unique, CAST(i.import_total AS BIGINT) AS import_total,
       CAST(i.sensitive_import_unique AS BIGINT) AS sensitive_import_unique,
       CAST(i.sensitive_import_total AS BIGINT) AS sensitive_import_total
FROM a FULL OUTER JOIN i ON a.package_id = i.package_id
""")
def q_rt_sensitive_totals(spark, sf_dir):
    facts = event_facts(spark, sf_dir)
    t = C.name_totals(C.count_names(facts, "call"), C.count_names(facts, "import"))
    return t.select("package_id", *[F.col(c).cast("bigint").alias(c) for c in (
        "api_unique", "api_total", "sensitive_api_unique", "sensitive_api_total",
        "import_unique", "import_total", "sensitive_import_unique", "sensitive_import_total")])


_EDGES_CTE = """
e AS (SELECT package_id, '<module>' AS src, path || ':f' || CAST(event_id AS VARCHAR) AS dst, 1 AS w FROM okev
      UNION ALL
      SELECT package_id, path || ':f' || CAST(event_id AS VARCHAR), api, 1 FROM okev),
ew AS (SELECT package_id, src, dst, sum(w) AS weight FROM e GROUP BY 1, 2, 3),
ends AS (SELECT package_id, src AS node, weight AS o, 0 AS i FROM ew
         UNION ALL SELECT package_id, dst, 0, weight FROM ew),
deg AS (SELECT package_id, node, sum(o) AS out_w, sum(i) AS in_w FROM ends GROUP BY 1, 2),
gs AS (SELECT package_id, count(*) AS n, sum(out_w) AS m, max(in_w) AS max_in, max(out_w) AS max_out,
              sum(out_w + in_w) AS deg FROM deg GROUP BY 1)"""


@register("rt_graph_stats", f"""
WITH {OK}, {_EDGES_CTE}
SELECT package_id, CAST(n AS DOUBLE) AS graph_nodes, CAST(m AS DOUBLE) AS graph_edges,
       round(m / greatest(1.0, n * (n - 1.0)), 9) AS graph_density,
       CAST(max_in AS DOUBLE) AS max_indegree, CAST(max_out AS DOUBLE) AS max_outdegree,
       round(deg / n, 9) AS avg_degree
FROM gs
""")
def q_rt_graph_stats(spark, sf_dir):
    g = G.graph_stats(C.edge_weights(event_facts(spark, sf_dir)))
    return g.select("package_id", "graph_nodes", "graph_edges", F.round("graph_density", 9).alias("graph_density"),
                    "max_indegree", "max_outdegree", F.round("avg_degree", 9).alias("avg_degree"))


@register("api_rank", f"""
WITH {OK}, {_EDGES_CTE},
ac AS (SELECT package_id, api AS name, count(*) AS cnt FROM okev GROUP BY 1, 2),
sc AS (SELECT ac.name, sum(ac.cnt * (CASE WHEN {S.sensitive_call('ac.name')} THEN 3 ELSE 1 END)
                           + coalesce(gs.m / greatest(1.0, gs.n * (gs.n - 1.0)), 0.0)) AS score
       FROM ac LEFT JOIN gs ON ac.package_id = gs.package_id GROUP BY 1)
SELECT name, round(score, 6) AS score FROM sc ORDER BY score DESC, name LIMIT 100
""")
def q_api_rank(spark, sf_dir):
    facts = event_facts(spark, sf_dir)
    ranked = G.api_rank(C.count_names(facts, "call"), G.graph_stats(C.edge_weights(facts)), top=100)
    return ranked.select("name", F.round("score", 6).alias("score"))


# ------------------------------------------------------------- text on documents ---
# Stand-ins: package = doc_id (or source), text = documents.text, lines = its '\n' lines.

from ..functions import numeric as N  # noqa: E402
from ..functions import text as T  # noqa: E402
from ..functions import vocab  # noqa: E402
from ..operators import features as FE  # noqa: E402
from ..operators import joins as J  # noqa: E402

_DOC_LINES_SQL = """
dl AS (SELECT doc_id, source, l.line, l.ln
       FROM (SELECT doc_id, source,
                    unnest(CASE WHEN text IS NULL OR text = '' THEN []::VARCHAR[]
                                ELSE string_split(regexp_replace(text, '\\n$', ''), chr(10)) END) AS line,
                    unnest(generate_series(1, CASE WHEN text IS NULL OR text = '' THEN 0
                           ELSE len(string_split(regexp_replace(text, '\\n$', ''), chr(10))) END)) AS ln
             FROM documents) l)"""


def doc_lines(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", "source", F.posexplode(T.split_lines("text")).alias("pos", "line")) \
            .select("doc_id", "source", "line", (F.col("pos") + 1).alias("ln"))


@register("entropy_docs", """
WITH ch AS (SELECT doc_id, unnest(string_split(text, '')) AS c FROM documents WHERE length(text) > 0),
cnt AS (SELECT doc_id, c, count(*) AS k FROM ch GROUP BY 1, 2),
tot AS (SELECT doc_id, sum(k) AS n, sum(k * log2(k)) AS s FROM cnt GROUP BY 1)
SELECT d.doc_id, round(coalesce(log2(t.n) - t.s / t.n, 0.0), 6) AS entropy
FROM documents d LEFT JOIN tot t ON d.doc_id = t.doc_id
""")
def q_entropy_docs(spark, sf_dir):
    """F2 on every document."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id", F.round(T.text_entropy("text"), 6).alias("entropy"))


@register("top_words", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')) AS w,
                  unnest(generate_series(1, len(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')))) AS pos
           FROM documents),
c AS (SELECT doc_id, w, count(*) AS cnt, min(pos) AS fpos FROM t GROUP BY 1, 2),
r AS (SELECT doc_id, w AS word, CAST(cnt AS BIGINT) AS cnt,
             CAST(row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, fpos) AS BIGINT) AS rank FROM c)
SELECT * FROM r WHERE rank <= {vocab.WORD_TOPK}
""")
def q_top_words(spark, sf_dir):
    """F5 + W1: per document, top 500 words by count, ties by first occurrence."""
    d = table(spark, sf_dir, "documents")
    wc = FE.word_counts(d.select(F.col("doc_id").alias("package_id"), F.lit(0).alias("piece"), "text"))
    top = R.top_k_names(wc, vocab.WORD_TOPK)
    return top.select(F.col("package_id").alias("doc_id"), F.col("name").alias("word"), "cnt",
                      F.col("rank").cast("bigint").alias("rank"))


@register("hashed_words", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')) AS w,
                  unnest(generate_series(1, len(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')))) AS pos
           FROM documents),
c AS (SELECT doc_id, w, count(*) AS cnt, min(pos) AS fpos FROM t GROUP BY 1, 2),
r AS (SELECT doc_id, w, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, fpos) AS rank FROM c)
SELECT doc_id, 'code_hash_' || CAST({S.md5_bucket('w', vocab.HASH_BUCKETS)} AS VARCHAR) AS feature,
       round(sum(least(cnt, {vocab.WORD_CAP}) / {float(vocab.WORD_CAP)}), 6) AS value
FROM r GROUP BY 1, 2
""")
def q_hashed_words(spark, sf_dir):
    """M2 + F1: all words hashed into 128 buckets, sum of min(cnt,10)/10."""
    d = table(spark, sf_dir, "documents")
    wc = FE.word_totals(d.select(F.col("doc_id").alias("package_id"), "text"))
    h = FE.hashed_counts(wc, "code", None, vocab.WORD_CAP)
    return h.select(F.col("package_id").alias("doc_id"), "feature", F.round("value", 6).alias("value"))


# Stand-in dictionary of frequent words in the generated prose, next to the real one.
COMMON_WORDS = ("the", "and", "les", "que", "der", "tion", "ent")


@register("keyword_scores", f"""
SELECT doc_id,
       CAST({S.keyword_presence_count('text')} AS BIGINT) AS presence,
       CAST({S.keyword_occurrence_count('text')} AS BIGINT) AS occurrences,
       CAST({S.keyword_presence_count('text', COMMON_WORDS)} AS BIGINT) AS presence_common,
       CAST({S.keyword_occurrence_count('text', COMMON_WORDS)} AS BIGINT) AS occurrences_common,
       round({S.keyword_presence_count('text')} / 20.0, 6) AS meta_suspicious_words,
       round({S.keyword_occurrence_count('text')} / 50.0, 6) AS snippet_suspicious_words
FROM documents
""")
def q_keyword_scores(spark, sf_dir):
    """F7 + F8 with the suspicious-word dictionary and a frequent-word dictionary."""
    d = table(spark, sf_dir, "documents")
    return d.select("doc_id",
                    T.keyword_presence_count("text").cast("bigint").alias("presence"),
                    T.keyword_occurrence_count("text").cast("bigint").alias("occurrences"),
                    T.keyword_presence_count("text", COMMON_WORDS).cast("bigint").alias("presence_common"),
                    T.keyword_occurrence_count("text", COMMON_WORDS).cast("bigint").alias("occurrences_common"),
                    F.round(T.keyword_presence("text"), 6).alias("meta_suspicious_words"),
                    F.round(T.keyword_occurrences("text"), 6).alias("snippet_suspicious_words"))


@register("string_counters", f"""
WITH {_DOC_LINES_SQL[1:]},
ch AS (SELECT doc_id, ln, unnest(string_split(line, '')) AS c FROM dl WHERE length(line) > 30),
cnt AS (SELECT doc_id, ln, c, count(*) AS k FROM ch GROUP BY 1, 2, 3),
ent AS (SELECT doc_id, ln, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM cnt GROUP BY 1, 2)
SELECT dl.doc_id, CAST(count(*) AS BIGINT) AS n_lines,
       CAST(count(*) FILTER (WHERE ent.h > 4.2) AS BIGINT) AS high_entropy_strings,
       CAST(count(*) FILTER (WHERE {S.url_string('dl.line')}) AS BIGINT) AS url_strings,
       CAST(count(*) FILTER (WHERE length(dl.line) > 120) AS BIGINT) AS long_strings,
       round(least(count(*) FILTER (WHERE ent.h > 4.2), 100) / 100.0, 6) AS high_entropy_string_count,
       round(least(count(*) FILTER (WHERE length(dl.line) > 120), 200) / 200.0, 6) AS long_string_count
FROM dl LEFT JOIN ent ON dl.doc_id = ent.doc_id AND dl.ln = ent.ln
GROUP BY 1
""")
def q_string_counters(spark, sf_dir):
    """P4-P6 + A7 over document lines as string literals."""
    lines = doc_lines(spark, sf_dir)
    g = lines.groupBy("doc_id").agg(
        F.count(F.lit(1)).alias("n_lines"),
        F.count_if(P.is_high_entropy_string("line")).alias("high_entropy_strings"),
        F.count_if(P.is_url_string("line")).alias("url_strings"),
        F.count_if(P.is_long_string("line")).alias("long_strings"))
    return g.select("doc_id", "n_lines", "high_entropy_strings", "url_strings", "long_strings",
                    F.round(N.clamp_scale("high_entropy_strings", 100), 6).alias("high_entropy_string_count"),
                    F.round(N.clamp_scale("long_strings", 200), 6).alias("long_string_count"))


@register("url_strings", f"""
SELECT page_id, {S.url_string('url')} AS is_url, {S.url_string('html')} AS html_has_url FROM pages
""")
def q_url_strings(spark, sf_dir):
    """P4 on page URLs and page bodies."""
    p = table(spark, sf_dir, "pages")
    return p.select("page_id", P.is_url_string("url").alias("is_url"), P.is_url_string("html").alias("html_has_url"))


_KW_RE = "|".join(w.replace(".", "\\.") for w in vocab.SUSPICIOUS_WORDS)


@register("context_frame", f"""
WITH {_DOC_LINES_SQL[1:]},
sel AS (SELECT doc_id, ln FROM dl WHERE regexp_matches(lower(line), '{_KW_RE}'))
SELECT sel.doc_id, sel.ln, md5(string_agg(dl.line, chr(10) ORDER BY dl.ln)) AS context_md5,
       CAST(count(*) AS BIGINT) AS context_lines
FROM sel JOIN dl ON dl.doc_id = sel.doc_id AND dl.ln BETWEEN sel.ln - {vocab.SNIPPET_RADIUS} AND sel.ln + {vocab.SNIPPET_RADIUS}
GROUP BY 1, 2
""")
def q_context_frame(spark, sf_dir):
    """+-18 line frame around every line that mentions a suspicious word."""
    lines = doc_lines(spark, sf_dir)
    ctx = R.line_context(lines, vocab.SNIPPET_RADIUS, ["doc_id"])
    hit = F.lower("line").rlike(_KW_RE)
    return ctx.where(hit).select("doc_id", "ln", F.md5("context").alias("context_md5"),
                                 F.col("context_lines").cast("bigint").alias("context_lines"))


@register("context_snippets", f"""
WITH {_DOC_LINES_SQL[1:]},
calls AS (SELECT source AS package_id, CAST(doc_id AS VARCHAR) AS path, ln AS lineno FROM dl
          WHERE regexp_matches(lower(line), '{_KW_RE}')),
kept AS (SELECT *, row_number() OVER (PARTITION BY package_id, path ORDER BY lineno) AS snippet_seq FROM calls)
SELECT package_id, snippet_seq, path, lineno,
       '# ' || path || ':' || CAST(lineno AS VARCHAR) || chr(10) || body AS text
FROM (SELECT k.package_id, CAST(k.snippet_seq AS BIGINT) AS snippet_seq, k.path, CAST(k.lineno AS BIGINT) AS lineno,
             string_agg(dl.line, chr(10) ORDER BY dl.ln) AS body
      FROM kept k JOIN dl ON CAST(dl.doc_id AS VARCHAR) = k.path
           AND dl.ln BETWEEN k.lineno - {vocab.SNIPPET_RADIUS} AND k.lineno + {vocab.SNIPPET_RADIUS}
      GROUP BY 1, 2, 3, 4)
""")
def q_context_snippets(spark, sf_dir):
    """J3 + A8: lines with a suspicious word act as sensitive calls (package = source,
    file = doc_id); +-18-line snippets, numbered within their file."""
    d = table(spark, sf_dir, "documents")
    units = d.select(F.col("source").alias("package_id"), F.col("doc_id").cast("string").alias("path"), "text")
    lines = units.select("package_id", "path", F.posexplode(T.split_lines("text")).alias("pos", "line"))
    calls = lines.where(F.lower("line").rlike(_KW_RE)).select(
        "package_id", "path", (F.col("pos") + 1).alias("seq"), (F.col("pos") + 1).alias("lineno"))
    s = J.context_snippets(calls, units)
    return s.select("package_id", F.col("snippet_seq").cast("bigint").alias("snippet_seq"), "path",
                    F.col("lineno").cast("bigint").alias("lineno"), "text")


# ------------------------------------------------------ round trip: features ---

from ..operators import scoring as SC  # noqa: E402
from ..operators import views as V  # noqa: E402

_PIPE_CACHE: dict[tuple, dict] = {}

META_EMPTY_SCHEMA = "package_id string, field string, value string, source_priority int"


def event_pipeline(spark, sf_dir) -> dict:
    """Features of the events-derived corpus (facts and snippets checkpointed)."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _PIPE_CACHE:
        facts = event_facts(spark, sf_dir)
        packages = facts.where(F.col("kind") == "file").select("package_id").distinct()
        snippets = saved(fact_snippets(facts), "snippets")
        metadata = spark.createDataFrame([], META_EMPTY_SCHEMA)
        out = FE.build_features(facts, metadata, packages, snippets=snippets)
        out["metadata"] = metadata
        out["packages"] = packages
        _PIPE_CACHE[key] = out
    return _PIPE_CACHE[key]


_SNIP = fixtures.ORACLE_EVENT_SNIPPETS.format(sensitive=S.sensitive_call("api"), radius=vocab.SNIPPET_RADIUS)

_SNIPPET_FEATURES_CTE = f"""
sagg AS (SELECT package_id, count(*) AS n, sum({S.keyword_occurrence_count('text')}) AS occ,
                string_agg(text, chr(10) ORDER BY snippet_seq) AS joined FROM snips GROUP BY 1),
sch AS (SELECT package_id, unnest(string_split(joined, '')) AS c FROM sagg),
scnt AS (SELECT package_id, c, count(*) AS k FROM sch GROUP BY 1, 2),
sent AS (SELECT package_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM scnt GROUP BY 1),
sfeat AS (SELECT sagg.package_id, least(n, {vocab.MAX_SNIPPETS}) / {float(vocab.MAX_SNIPPETS)} AS snippet_count,
                 occ / 50.0 AS snippet_suspicious_words, coalesce(h, 0.0) / 8.0 AS snippet_entropy
          FROM sagg LEFT JOIN sent ON sagg.package_id = sent.package_id)"""


@register("rt_snippet_features", f"""
WITH {OK}{_SNIP}, {_SNIPPET_FEATURES_CTE}
SELECT package_id, round(snippet_count, 6) AS snippet_count,
       round(snippet_suspicious_words, 6) AS snippet_suspicious_words,
       round(snippet_entropy, 6) AS snippet_entropy FROM sfeat
""")
def q_rt_snippet_features(spark, sf_dir):
    """J3 + A8 + M5 on the generated corpus: snippets around sensitive calls."""
    s = event_pipeline(spark, sf_dir)["snippet_stats"]
    return s.select("package_id", *[F.round(c, 6).alias(c) for c in
                                    ("snippet_count", "snippet_suspicious_words", "snippet_entropy")])


def _named_sql() -> str:
    meta = []
    for f in vocab.METADATA_FIELDS:
        meta.append(f"0.0 AS \"meta_has_{f}\"")
        meta.append(f"0.0 AS \"meta_len_{f}\"")
    return ", ".join(meta)


_NAMED_CTE = f"""
{_IMPORTS_CTE[1:]},
ac AS (SELECT package_id, api AS name, count(*) AS cnt, min(path) AS fpath FROM okev GROUP BY 1, 2),
tot AS (SELECT p.package_id,
          coalesce((SELECT count(*) FROM ac WHERE ac.package_id = p.package_id), 0) AS api_unique,
          coalesce((SELECT sum(cnt) FROM ac WHERE ac.package_id = p.package_id), 0) AS api_total,
          coalesce((SELECT count(*) FROM ac WHERE ac.package_id = p.package_id AND {S.sensitive_call('ac.name')}), 0) AS sau,
          coalesce((SELECT sum(cnt) FROM ac WHERE ac.package_id = p.package_id AND {S.sensitive_call('ac.name')}), 0) AS sat,
          coalesce((SELECT count(*) FROM ic WHERE ic.package_id = p.package_id AND {S.sensitive_import('ic.name')}), 0) AS siu,
          coalesce((SELECT sum(cnt) FROM ic WHERE ic.package_id = p.package_id AND {S.sensitive_import('ic.name')}), 0) AS sit
        FROM (SELECT DISTINCT package_id FROM files) p),
fc AS (SELECT package_id, count(*) AS nfiles, count(*) FILTER (WHERE broken) AS nerr FROM files GROUP BY 1),
blk AS (SELECT package_id, count(*) FILTER (WHERE event_id % 3 IN (0, 1)) AS cn,
               max(CASE WHEN event_id % 3 IN (0, 1) THEN 1 ELSE 0 END) AS mn FROM okev GROUP BY 1),
strs AS (SELECT package_id, count(*) FILTER (WHERE {S.url_string('props')}) AS url_n,
                count(*) FILTER (WHERE length(props) > 120) AS long_n FROM okev WHERE props <> '' GROUP BY 1),
named AS (
  SELECT fc.package_id, {_named_sql()},
         1.0 AS meta_missing_ratio, 0.0 AS meta_entropy, 0.0 AS meta_suspicious_words,
         least(fc.nfiles, 1000) / 1000.0 AS source_file_count,
         fc.nerr / greatest(1, fc.nfiles) AS parse_error_ratio,
         least(tot.api_unique, 1000) / 1000.0 AS api_unique_count,
         least(tot.api_total, 10000) / 10000.0 AS api_total_count,
         least(tot.sau, 100) / 100.0 AS sensitive_api_unique,
         least(tot.sat, 500) / 500.0 AS sensitive_api_total,
         least(tot.siu, 100) / 100.0 AS sensitive_import_unique,
         least(tot.sit, 500) / 500.0 AS sensitive_import_total,
         least(coalesce(gs.n, 0), 10000) / 10000.0 AS graph_nodes,
         least(coalesce(gs.m, 0), 10000) / 10000.0 AS graph_edges,
         least(coalesce(gs.m / greatest(1.0, gs.n * (gs.n - 1.0)), 0.0), 1.0) AS graph_density,
         least(coalesce(gs.max_in, 0), 10000) / 10000.0 AS max_indegree,
         least(coalesce(gs.max_out, 0), 10000) / 10000.0 AS max_outdegree,
         least(coalesce(gs.deg / gs.n, 0), 10000) / 10000.0 AS avg_degree,
         least(coalesce(blk.cn, 0), 5000) / 5000.0 AS cfg_nodes,
         least(2 * coalesce(blk.cn, 0), 10000) / 10000.0 AS cfg_edges,
         least(coalesce(blk.mn, 0), 50) / 50.0 AS max_nesting,
         coalesce(sfeat.snippet_count, 0.0) AS snippet_count,
         coalesce(sfeat.snippet_suspicious_words, 0.0) AS snippet_suspicious_words,
         coalesce(sfeat.snippet_entropy, 0.0) AS snippet_entropy,
         0.0 AS high_entropy_string_count,
         least(coalesce(strs.url_n, 0), 100) / 100.0 AS url_string_count,
         least(coalesce(strs.long_n, 0), 200) / 200.0 AS long_string_count
  FROM fc JOIN tot ON fc.package_id = tot.package_id
       LEFT JOIN gs ON fc.package_id = gs.package_id
       LEFT JOIN blk ON fc.package_id = blk.package_id
       LEFT JOIN sfeat ON fc.package_id = sfeat.package_id
       LEFT JOIN strs ON fc.package_id = strs.package_id)"""

_RT_FEATURE_WITH = f"WITH {OK}{_SNIP}, {_SNIPPET_FEATURES_CTE}, {_EDGES_CTE[1:]}, {_NAMED_CTE}"


def _unpivot_named() -> str:
    parts = [f"SELECT package_id, '{c}' AS feature, CAST(\"{c}\" AS DOUBLE) AS value FROM named"
             for c in FE.NAMED_FEATURES]
    return " UNION ALL ".join(parts)


_HASHED_SQL = f"""
hashed AS (
  SELECT package_id, 'api_hash_' || CAST({S.md5_bucket('name', vocab.HASH_BUCKETS)} AS VARCHAR) AS feature,
         sum(least(cnt, 20) / 20.0) AS value FROM ac GROUP BY 1, 2
  UNION ALL
  SELECT package_id, 'sapi_hash_' || CAST({S.md5_bucket('name', vocab.HASH_BUCKETS)} AS VARCHAR),
         sum(least(cnt, 20) / 20.0) FROM ac WHERE {S.sensitive_call('name')} GROUP BY 1, 2
  UNION ALL
  SELECT package_id, 'import_hash_' || CAST({S.md5_bucket('name', vocab.HASH_BUCKETS)} AS VARCHAR),
         sum(least(cnt, 20) / 20.0) FROM ic GROUP BY 1, 2
  UNION ALL
  SELECT package_id, 'simport_hash_' || CAST({S.md5_bucket('name', vocab.HASH_BUCKETS)} AS VARCHAR),
         sum(least(cnt, 20) / 20.0) FROM ic WHERE {S.sensitive_import('name')} GROUP BY 1, 2
  UNION ALL
  SELECT package_id, 'code_hash_' || CAST({S.md5_bucket('w', vocab.HASH_BUCKETS)} AS VARCHAR),
         sum(least(cnt, 10) / 10.0)
  FROM (SELECT package_id, w, cnt, row_number() OVER (PARTITION BY package_id ORDER BY cnt DESC, fs, fp) AS rk
        FROM (SELECT package_id, w, count(*) AS cnt, min(snippet_seq) AS fs, min(pos) FILTER (WHERE first_s) AS fp
              FROM (SELECT package_id, snippet_seq, w, pos,
                           snippet_seq = min(snippet_seq) OVER (PARTITION BY package_id, w) AS first_s
                    FROM (SELECT package_id, snippet_seq,
                                 unnest(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')) AS w,
                                 unnest(generate_series(1, len(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')))) AS pos
                          FROM snips))
              GROUP BY 1, 2))
  GROUP BY 1, 2)"""


@register("feature_long", f"""
{_RT_FEATURE_WITH}, {_HASHED_SQL}
SELECT package_id, feature, round(value, 6) AS value FROM ({_unpivot_named()} UNION ALL SELECT * FROM hashed)
""")
def q_feature_long(spark, sf_dir):
    """M1-M7: the 40 named and the hashed features of every generated package."""
    long = event_pipeline(spark, sf_dir)["long"]
    return long.select("package_id", "feature", F.round("value", 6).alias("value"))


def _rule_sql() -> tuple[str, str]:
    score = " + ".join(f"(CASE WHEN {f} > 0 THEN {w} * {f} ELSE 0 END)" for f, w, _ in vocab.HEURISTIC_RULES)
    reasons = "concat_ws('; ', " + ", ".join(
        f"CASE WHEN {f} > 0 THEN '{r}' END" for f, _w, r in vocab.HEURISTIC_RULES) + ")"
    return score, reasons


_RULE_SCORE, _RULE_REASONS = _rule_sql()


@register("heuristic_score", f"""
{_RT_FEATURE_WITH},
sc AS (SELECT package_id, {_RULE_SCORE} AS s, {_RULE_REASONS} AS reasons FROM named)
SELECT package_id, round(s, 6) AS rule_score, round({S.sigmoid('s - 2.2')}, 6) AS probability,
       CASE WHEN {S.sigmoid('s - 2.2')} >= 0.5 THEN 'malicious' ELSE 'benign' END AS prediction, reasons
FROM sc
""")
def q_heuristic_score(spark, sf_dir):
    """M9 + F3 + P7: rule score, probability, verdict and reasons per package."""
    h = SC.heuristic_score(event_pipeline(spark, sf_dir)["named"])
    return h.select("package_id", F.round("rule_score", 6).alias("rule_score"),
                    F.round("probability", 6).alias("probability"), "prediction",
                    F.array_join("reasons", "; ").alias("reasons"))


@register("logistic_score", f"""
{_RT_FEATURE_WITH},
sc AS (SELECT package_id, {" + ".join(f"{w} * {f}" for f, w, _ in vocab.HEURISTIC_RULES)} AS s FROM named)
SELECT package_id, round(s - 2.2, 6) AS logit, round({S.sigmoid('s - 2.2')}, 6) AS probability,
       CASE WHEN {S.sigmoid('s - 2.2')} >= 0.5 THEN 'malicious' ELSE 'benign' END AS prediction
FROM sc
""")
def q_logistic_score(spark, sf_dir):
    """M11 + J4 + M8: a logistic model (the rule weights as a model table, bias -2.2)
    scored through the feature-vocabulary join."""
    p = event_pipeline(spark, sf_dir)
    weights = spark.createDataFrame([(f, float(w)) for f, w, _ in vocab.HEURISTIC_RULES], "feature string, weight double")
    s = SC.logistic_score(p["long"], weights, vocab.HEURISTIC_BIAS, packages=p["packages"])
    return s.select("package_id", F.round("logit", 6).alias("logit"), F.round("probability", 6).alias("probability"),
                    "prediction")


# ------------------------------------------------------------ graph on orders ---

def _orders_graph(spark, sf_dir):
    o = table(spark, sf_dir, "orders").select("o_orderpriority", "o_custkey")
    c = table(spark, sf_dir, "customer").select("c_custkey", "c_nationkey")
    return (o.join(c, o.o_custkey == c.c_custkey)
             .groupBy(F.col("o_orderpriority").alias("package_id"),
                      F.concat(F.lit("c"), F.col("o_custkey").cast("string")).alias("src"),
                      F.concat(F.lit("n"), F.col("c_nationkey").cast("string")).alias("dst"))
             .agg(F.count(F.lit(1)).alias("weight")))


def _pagerank_sql(iters: int, alpha: float = vocab.PAGERANK_ALPHA) -> str:
    ctes = ["""ew AS (SELECT o_orderpriority AS package_id, 'c' || CAST(o_custkey AS VARCHAR) AS src,
                    'n' || CAST(c_nationkey AS VARCHAR) AS dst, count(*) AS weight
             FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3)""",
            """nd AS (SELECT package_id, node, sum(o) AS out_w FROM
               (SELECT package_id, src AS node, weight AS o FROM ew UNION ALL SELECT package_id, dst, 0 FROM ew)
             GROUP BY 1, 2)""",
            "sz AS (SELECT package_id, count(*) AS n FROM nd GROUP BY 1)",
            """tr AS (SELECT ew.package_id, ew.src, ew.dst, ew.weight / nd.out_w AS p
             FROM ew JOIN nd ON ew.package_id = nd.package_id AND ew.src = nd.node)""",
            "r0 AS (SELECT nd.package_id, nd.node, 1.0 / sz.n AS rank FROM nd JOIN sz ON nd.package_id = sz.package_id)"]
    for i in range(1, iters + 1):
        ctes.append(f"""r{i} AS (
  SELECT nd.package_id, nd.node, {alpha} * (coalesce(c.s, 0.0) + d.dm / sz.n) + {1 - alpha} / sz.n AS rank
  FROM nd JOIN sz ON nd.package_id = sz.package_id
  LEFT JOIN (SELECT tr.package_id, tr.dst AS node, sum(r.rank * tr.p) AS s
             FROM tr JOIN r{i-1} r ON r.package_id = tr.package_id AND r.node = tr.src GROUP BY 1, 2) c
         ON c.package_id = nd.package_id AND c.node = nd.node
  JOIN (SELECT r.package_id, sum(CASE WHEN x.out_w = 0 THEN r.rank ELSE 0.0 END) AS dm
        FROM r{i-1} r JOIN nd x ON x.package_id = r.package_id AND x.node = r.node GROUP BY 1) d
         ON d.package_id = nd.package_id)""")
    return "WITH " + ",\n".join(ctes) + f"\nSELECT package_id, node, round(rank, 9) AS pagerank FROM r{iters}"


def _converged_sql(rounds: int, alpha: float = vocab.PAGERANK_ALPHA, tol: float = vocab.PAGERANK_TOL) -> str:
    """CTEs after ``ew``: ``r{rounds}`` (package_id, node, rank, done, iterations), each package frozen once it has converged."""
    ctes = ["""nd AS MATERIALIZED (SELECT package_id, node, sum(o) AS out_w FROM
               (SELECT package_id, src AS node, weight AS o FROM ew UNION ALL SELECT package_id, dst, 0 FROM ew) GROUP BY 1, 2)""",
            "sz AS MATERIALIZED (SELECT package_id, CAST(count(*) AS DOUBLE) AS n FROM nd GROUP BY 1)",
            """tr AS MATERIALIZED (SELECT ew.package_id, ew.src, ew.dst, CAST(ew.weight AS DOUBLE) / nd.out_w AS p
             FROM ew JOIN nd ON ew.package_id = nd.package_id AND ew.src = nd.node)""",
            "r0 AS MATERIALIZED (SELECT nd.package_id, nd.node, 1.0 / sz.n AS rank, false AS done, 0 AS iterations FROM nd JOIN sz USING (package_id))"]
    for i in range(1, rounds + 1):
        ctes.append(f"""m{i} AS MATERIALIZED (
  SELECT r.package_id, r.node, r.rank AS old, r.done, r.iterations, sz.n,
         CASE WHEN r.done THEN r.rank ELSE {alpha} * (coalesce(c.s, 0.0) + d.dm / sz.n) + {1 - alpha} / sz.n END AS rank
  FROM r{i-1} r JOIN sz USING (package_id)
  LEFT JOIN (SELECT tr.package_id, tr.dst AS node, sum(r.rank * tr.p) AS s
             FROM tr JOIN r{i-1} r ON r.package_id = tr.package_id AND r.node = tr.src GROUP BY 1, 2) c USING (package_id, node)
  JOIN (SELECT r.package_id, sum(CASE WHEN x.out_w = 0 THEN r.rank ELSE 0.0 END) AS dm
        FROM r{i-1} r JOIN nd x USING (package_id, node) GROUP BY 1) d USING (package_id)),
r{i} AS MATERIALIZED (
  SELECT package_id, node, rank, done OR sum(abs(rank - old)) OVER (PARTITION BY package_id) < n * {tol} AS done,
         CASE WHEN done THEN iterations ELSE {i} END AS iterations FROM m{i})""")
    return ",\n".join(ctes)


#: More rounds than any of the test graphs takes; a graph that takes more shows as ``converged = false`` in the SQL.
ROUNDS = 30


@register("pagerank_converged", f"""
WITH ew AS (SELECT o_orderpriority AS package_id, 'c' || CAST(o_custkey AS VARCHAR) AS src,
                   'n' || CAST(c_nationkey AS VARCHAR) AS dst, count(*) AS weight
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3
            UNION ALL
            SELECT 'back', 'n' || CAST(c_nationkey AS VARCHAR), 'c' || CAST(c_custkey AS VARCHAR), 1 FROM customer WHERE c_custkey % 3 > 0
            UNION ALL
            SELECT 'back', 'c' || CAST(c_custkey AS VARCHAR), 'n' || CAST(c_custkey % 25 AS VARCHAR), 2 FROM customer WHERE c_custkey % 2 = 0),
{_converged_sql(2 * ROUNDS)}
SELECT package_id, node, round(rank, 9) AS pagerank, CAST(iterations AS INTEGER) AS iterations, done AS converged FROM r{2 * ROUNDS}
""")
def q_pagerank_converged(spark, sf_dir):
    """M14 to convergence: the order-priority graphs, and one with cycles (nations -> customers -> nations)."""
    c = table(spark, sf_dir, "customer")
    customer, nation = F.concat(F.lit("c"), F.col("c_custkey").cast("string")), F.concat(F.lit("n"), F.col("c_nationkey").cast("string"))
    back = (c.where("c_custkey % 3 > 0").select(F.lit("back").alias("package_id"), nation.alias("src"), customer.alias("dst"), F.lit(1).cast("bigint").alias("weight"))
            .unionByName(c.where("c_custkey % 2 = 0").select(F.lit("back").alias("package_id"), customer.alias("src"),
                                                             F.concat(F.lit("n"), (F.col("c_custkey") % 25).cast("string")).alias("dst"), F.lit(2).cast("bigint").alias("weight"))))
    edges = _orders_graph(spark, sf_dir).select("package_id", "src", "dst", F.col("weight").cast("bigint").alias("weight"))
    return G.pagerank(edges.unionByName(back)).withColumn("pagerank", F.round("pagerank", 9))


@register("pagerank_10", _pagerank_sql(10))
def q_pagerank_10(spark, sf_dir):
    """Weighted PageRank, 10 fixed iterations, per order-priority graph (customer -> nation)."""
    pr = G.pagerank(_orders_graph(spark, sf_dir), max_iter=10, tol=None)
    return pr.select("package_id", "node", F.round("pagerank", 9).alias("pagerank"))


@register("graph_stats_orders", """
WITH ew AS (SELECT o_orderpriority AS package_id, 'c' || CAST(o_custkey AS VARCHAR) AS src,
                   'n' || CAST(c_nationkey AS VARCHAR) AS dst, count(*) AS weight
            FROM orders JOIN customer ON o_custkey = c_custkey GROUP BY 1, 2, 3),
ends AS (SELECT package_id, src AS node, weight AS o, 0 AS i FROM ew UNION ALL SELECT package_id, dst, 0, weight FROM ew),
deg AS (SELECT package_id, node, sum(o) AS out_w, sum(i) AS in_w FROM ends GROUP BY 1, 2)
SELECT package_id, CAST(count(*) AS DOUBLE) AS graph_nodes, CAST(sum(out_w) AS DOUBLE) AS graph_edges,
       round(sum(out_w) / greatest(1.0, count(*) * (count(*) - 1.0)), 9) AS graph_density,
       CAST(max(in_w) AS DOUBLE) AS max_indegree, CAST(max(out_w) AS DOUBLE) AS max_outdegree,
       round(sum(out_w + in_w) / count(*), 9) AS avg_degree
FROM deg GROUP BY 1
""")
def q_graph_stats_orders(spark, sf_dir):
    """A3 + M13 on the order-priority graphs."""
    g = G.graph_stats(_orders_graph(spark, sf_dir))
    return g.select("package_id", "graph_nodes", "graph_edges", F.round("graph_density", 9).alias("graph_density"),
                    "max_indegree", "max_outdegree", F.round("avg_degree", 9).alias("avg_degree"))


# ------------------------------------------------------------ scalars & paths ---

@register("scalar_pack", """
SELECT p_partkey,
       round(least(p_size, 20) / 20.0, 6) AS size_scaled,
       trim(regexp_replace(p_name || chr(10) || chr(9) || ' ' || p_brand || '  ', '\\s+', ' ', 'g')) AS name_brand,
       lower(replace(replace(p_type, ' ', '_'), '_', '-')) AS type_key,
       string_split(lower(replace(p_type, ' ', '.')), '.')[-1] AS type_tail,
       string_split(lower(replace(p_type, ' ', '.')), '.')[1] AS type_root,
       p_brand || ': ' || p_name AS kv_line,
       round(p_retailprice / 1000.0, 4) AS price_k,
       round(CASE WHEN p_size - 25 < -50 THEN 0.0 WHEN p_size - 25 > 50 THEN 1.0
                  ELSE 1.0 / (1.0 + exp(-(p_size - 25))) END, 6) AS size_sigmoid
FROM part
""")
def q_scalar_pack(spark, sf_dir):
    """F3, F4, F9, F10, F11, F12, F15 on part columns."""
    p = table(spark, sf_dir, "part")
    dotted = F.lower(F.regexp_replace("p_type", " ", "."))
    return p.select(
        "p_partkey",
        F.round(N.clamp_scale("p_size", 20), 6).alias("size_scaled"),
        T.collapse_whitespace(F.concat(F.col("p_name"), F.lit("\n\t "), F.col("p_brand"), F.lit("  "))).alias("name_brand"),
        T.normalize_key(F.regexp_replace("p_type", " ", "_")).alias("type_key"),
        T.last_part(dotted).alias("type_tail"), T.root_part(dotted).alias("type_root"),
        F.concat_ws(": ", "p_brand", "p_name").alias("kv_line"),
        N.round_prob(F.col("p_retailprice") / 1000.0, 4).alias("price_k"),
        F.round(N.sigmoid(F.col("p_size") - 25), 6).alias("size_sigmoid"))


_EVEN = ("0", "2", "4", "6", "8")


@register("path_filter", f"""
WITH u AS (SELECT page_id, regexp_extract(url, '^[a-z]+://[^/]+/([^?#]*)', 1) AS rel FROM pages),
k AS (SELECT split_part(rel, '/', 1) AS package_id, rel || '@' || CAST(page_id AS VARCHAR) AS path, page_id FROM u
      WHERE ({' OR '.join(f"suffix(rel, '{s}')" for s in _EVEN)})
        AND NOT list_has_any(string_split(rel, '/')[1:len(string_split(rel, '/')) - 1], {list(vocab.SKIP_DIRS)})
        AND NOT len(list_filter(string_split(rel, '/')[1:len(string_split(rel, '/')) - 1], lambda d: starts_with(d, '.eggs'))) > 0)
SELECT package_id, path, page_id FROM k
""")
def q_path_filter(spark, sf_dir):
    """S3 on URL paths: suffix filter and skipped directories."""
    from ..sources import files as SF
    p = table(spark, sf_dir, "pages")
    rel = F.regexp_extract("url", "^[a-z]+://[^/]+/([^?#]*)", 1)
    u = p.select("page_id", rel.alias("rel")).where(SF.path_is_kept("rel", _EVEN))
    k = u.select(F.split("rel", "/").getItem(0).alias("package_id"),
                 F.concat("rel", F.lit("@"), F.col("page_id").cast("string")).alias("path"), "page_id")
    return SF.cap_files(k).select("package_id", "path", "page_id")


# ------------------------------------------------------------ dictionary joins ---

@register("rt_dictionary_hits", f"""
WITH {OK}
SELECT package_id, api AS name, CAST(count(*) AS BIGINT) AS cnt FROM okev
WHERE api IN {S.in_list(vocab.SENSITIVE_APIS)} GROUP BY 1, 2
""")
def q_rt_dictionary_hits(spark, sf_dir):
    """S6 + U1 + J1: call counts semi-joined with the union of both API dictionaries."""
    from ..sources.dictionaries import load_dictionary
    d = load_dictionary(spark, "sensitive_apis")
    c = C.count_names(event_facts(spark, sf_dir), "call").select("package_id", "name", "cnt")
    return J.dictionary_semi_join(c, d)


@register("rt_dictionary_misses", f"""
WITH {OK}
SELECT package_id, api AS name, CAST(count(*) AS BIGINT) AS cnt FROM okev
WHERE api NOT IN {S.in_list(vocab.SENSITIVE_APIS)} GROUP BY 1, 2
""")
def q_rt_dictionary_misses(spark, sf_dir):
    """J1 anti-join: calls whose exact name is in no dictionary."""
    from ..sources.dictionaries import load_dictionary
    d = load_dictionary(spark, "sensitive_apis")
    c = C.count_names(event_facts(spark, sf_dir), "call").select("package_id", "name", "cnt")
    return J.dictionary_semi_join(c, d, anti=True)


@register("rt_sensitive_imports", f"""
WITH {OK}, {_IMPORTS_CTE[1:]}
SELECT package_id, name, CAST(cnt AS BIGINT) AS cnt FROM ic WHERE {S.sensitive_import('name')}
""")
def q_rt_sensitive_imports(spark, sf_dir):
    """P2 via J2: import counts prefix-semi-joined with the import blacklist."""
    from ..sources.dictionaries import load_dictionary
    d = load_dictionary(spark, "blacklist_imports")
    c = C.count_names(event_facts(spark, sf_dir), "import").select("package_id", "name", "cnt")
    return J.prefix_semi_join(c, d)


# ------------------------------------------------------------------ metadata ---

from ..operators import metadata as MD  # noqa: E402


def _customer_metadata_rows(spark, sf_dir):
    """Four ranked metadata sources per customer package (header / setup.cfg /
    pyproject / setup.py), raw keys normalised (F10) and values collapsed (F9)."""
    c = table(spark, sf_dir, "customer")
    n = table(spark, sf_dir, "nation")
    r = table(spark, sf_dir, "region")
    j = c.join(n, c.c_nationkey == n.n_nationkey).join(r, n.n_regionkey == r.r_regionkey)
    pkg = F.concat(F.lit("c"), F.col("c_custkey").cast("string"))

    def rows(prio, path, pairs):
        return j.select(pkg.alias("package_id"), F.lit(path).alias("path"), F.explode(F.array(*[
            F.struct(F.lit(k).alias("k"), v.alias("v"), F.lit(i).alias("ord")) for i, (k, v) in enumerate(pairs)
        ])).alias("e"), F.lit(prio).alias("source_priority"))

    hdr = rows(1, "PKG-INFO", [("Name", F.col("c_name")), ("Summary", F.concat(F.col("c_mktsegment"), F.lit("  \t segment")))])
    cfg = rows(2, "setup.cfg", [("name", F.col("n_name")), ("author", F.col("n_name")),
                                ("license", F.when(F.col("c_acctbal") < 0, F.lit("")))])
    pyp = rows(3, "pyproject.toml", [("license", F.col("r_name")), ("description", F.concat(F.col("r_name"), F.lit(" region")))])
    spy = rows(4, "setup.py", [("home_page", F.concat(F.lit("https://"), F.lower(F.regexp_replace("c_name", "#", "-")),
                                                       F.lit(".example"))),
                               ("Author_Email", F.concat(F.lower("n_name"), F.lit("@example.org")))])
    allr = hdr.unionByName(cfg).unionByName(pyp).unionByName(spy).where(F.col("e.v").isNotNull())
    return allr.select("package_id", "path", T.normalize_key("e.k").alias("field"),
                       T.collapse_whitespace("e.v").alias("value"), "source_priority", F.col("e.ord").alias("ord"))


_CUSTOMER_META_SQL = """
j AS (SELECT 'c' || CAST(c_custkey AS VARCHAR) AS package_id, * FROM customer
      JOIN nation ON c_nationkey = n_nationkey JOIN region ON n_regionkey = r_regionkey),
raw AS (
  SELECT package_id, 'name' AS field, c_name AS value, 1 AS prio FROM j
  UNION ALL SELECT package_id, 'summary', c_mktsegment || ' segment', 1 FROM j
  UNION ALL SELECT package_id, 'name', n_name, 2 FROM j
  UNION ALL SELECT package_id, 'author', n_name, 2 FROM j
  UNION ALL SELECT package_id, 'license', '', 2 FROM j WHERE c_acctbal < 0
  UNION ALL SELECT package_id, 'license', r_name, 3 FROM j
  UNION ALL SELECT package_id, 'description', r_name || ' region', 3 FROM j
  UNION ALL SELECT package_id, 'home-page', 'https://' || lower(replace(c_name, '#', '-')) || '.example', 4 FROM j
  UNION ALL SELECT package_id, 'author-email', lower(n_name) || '@example.org', 4 FROM j),
co AS (SELECT package_id, field, value, prio FROM
        (SELECT *, row_number() OVER (PARTITION BY package_id, field ORDER BY prio) AS rn FROM raw) WHERE rn = 1)"""


@register("metadata_coalesce", f"""
WITH {_CUSTOMER_META_SQL}
SELECT package_id, field, value, CAST(prio AS INTEGER) AS source_priority FROM co
""")
def q_metadata_coalesce(spark, sf_dir):
    """A9 + F9 + F10: first source wins per field across four ranked sources."""
    m = MD.coalesce_metadata(_customer_metadata_rows(spark, sf_dir))
    return m.select("package_id", "field", "value", F.col("source_priority").cast("int").alias("source_priority"))


def _meta_feature_sql():
    cols = []
    for f in vocab.METADATA_FIELDS:
        v = f"coalesce(max(value) FILTER (WHERE field = '{f}'), '')"
        cols.append(f"CASE WHEN length({v}) > 0 THEN 1.0 ELSE 0.0 END AS \"meta_has_{f}\"")
        cols.append(f"round(least(length({v}), 5000) / 5000.0, 6) AS \"meta_len_{f}\"")
    weak = " + ".join(
        f"(CASE WHEN coalesce(max(value) FILTER (WHERE field = '{f}'), '') = '' OR upper(coalesce(max(value) FILTER (WHERE field = '{f}'), '')) IN {S.in_list(vocab.WEAK_METADATA_VALUES)} THEN 1 ELSE 0 END)"
        for f in vocab.METADATA_FIELDS)
    joined = " || ' ' || ".join(f"coalesce(max(value) FILTER (WHERE field = '{f}'), '')" for f in vocab.METADATA_FIELDS)
    return ", ".join(cols), weak, joined


_MF_COLS, _MF_WEAK, _MF_JOINED = _meta_feature_sql()


@register("metadata_features", f"""
WITH {_CUSTOMER_META_SQL},
w AS (SELECT package_id, {_MF_COLS}, ({_MF_WEAK}) / 7.0 AS mr, {_MF_JOINED} AS txt FROM co GROUP BY 1),
ch AS (SELECT package_id, unnest(string_split(txt, '')) AS c FROM w),
cn AS (SELECT package_id, c, count(*) AS k FROM ch GROUP BY 1, 2),
en AS (SELECT package_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM cn GROUP BY 1)
SELECT w.* EXCLUDE (mr, txt), round(mr, 6) AS meta_missing_ratio, round(coalesce(en.h, 0) / 8.0, 6) AS meta_entropy,
       round({S.keyword_presence_count('txt')} / 20.0, 6) AS meta_suspicious_words
FROM w LEFT JOIN en ON w.package_id = en.package_id
""")
def q_metadata_features(spark, sf_dir):
    """M1 + P3 on the coalesced customer metadata."""
    m = MD.coalesce_metadata(_customer_metadata_rows(spark, sf_dir))
    pk = m.select("package_id").distinct()
    f = FE.metadata_features(FE.metadata_wide(m, pk))
    return f.select("package_id", *[F.round(c, 6).alias(c) if "len" in c or c.startswith("meta_m")
                                    or c in ("meta_entropy", "meta_suspicious_words") else F.col(c)
                                    for c in FE.NAMED_FEATURES[:17]])


# ------------------------------------------------------------ views & attention ---

_EMBED_RE = vocab.EMBED_TOKEN_PATTERN.replace("'", "''")


@register("signed_hash_embedding", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_EMBED_RE}')) AS tok FROM documents),
c AS (SELECT doc_id, tok, count(*) AS cnt FROM t WHERE length(tok) > 0 GROUP BY 1, 2),
s AS (SELECT doc_id, {S.md5_bucket('tok', vocab.EMBED_DIM)} AS dim,
             sum(CASE WHEN {S.md5_bucket("'sign:' || tok", 2)} = 0 THEN 1.0 ELSE -1.0 END * cnt) AS v
      FROM c GROUP BY 1, 2),
n AS (SELECT doc_id, sqrt(sum(v * v)) AS nn FROM s GROUP BY 1)
SELECT s.doc_id, s.dim, round(CASE WHEN nn > 0 THEN v / nn ELSE 0.0 END, 6) AS value
FROM s JOIN n ON s.doc_id = n.doc_id
""")
def q_signed_hash_embedding(spark, sf_dir):
    """F6 + M12: 768-wide signed feature hashing of every document, L2-normalised (sparse form)."""
    d = table(spark, sf_dir, "documents")
    sp = V.normalised(V.text_cells(d.select(F.col("doc_id").alias("package_id"), "text"), "code"))
    return sp.select(F.col("package_id").alias("doc_id"), "dim", F.round("value", 6).alias("value"))


def _embedding_views(spark, sf_dir):
    e = table(spark, sf_dir, "embeddings")
    names = F.element_at(F.array(*[F.lit(v) for v in vocab.VIEW_ORDER]), (F.col("vec_id") % 3 + 1).cast("int"))
    return e.select(F.floor(F.col("vec_id") / 3).cast("bigint").alias("package_id"), names.alias("view"),
                    F.col("embedding").cast("array<double>").alias("vector"))


@register("channel_attention", """
WITH e AS (SELECT CAST(floor(vec_id / 3) AS BIGINT) AS package_id, vec_id % 3 AS v,
                  sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS en
           FROM embeddings),
p AS (SELECT package_id, coalesce(max(en) FILTER (WHERE v = 0), 0.0) AS e0, coalesce(max(en) FILTER (WHERE v = 1), 0.0) AS e1,
             coalesce(max(en) FILTER (WHERE v = 2), 0.0) AS e2 FROM e GROUP BY 1),
q AS (SELECT *, greatest(e0, e1, e2) AS m FROM p)
SELECT package_id, round(e0, 6) AS e_metadata, round(e1, 6) AS e_code, round(e2, 6) AS e_graph,
       round(CASE WHEN e0 = 0 AND e1 = 0 AND e2 = 0 THEN 1.0 / 3 ELSE exp(e0 - m) / (exp(e0 - m) + exp(e1 - m) + exp(e2 - m)) END, 6) AS a_metadata,
       round(CASE WHEN e0 = 0 AND e1 = 0 AND e2 = 0 THEN 1.0 / 3 ELSE exp(e1 - m) / (exp(e0 - m) + exp(e1 - m) + exp(e2 - m)) END, 6) AS a_code,
       round(CASE WHEN e0 = 0 AND e1 = 0 AND e2 = 0 THEN 1.0 / 3 ELSE exp(e2 - m) / (exp(e0 - m) + exp(e1 - m) + exp(e2 - m)) END, 6) AS a_graph
FROM q
""")
def q_channel_attention(spark, sf_dir):
    """F13 + F14 + M17: view energies and softmax attention, embeddings grouped three per package."""
    a = SC.channel_attention(_embedding_views(spark, sf_dir))
    return a.select("package_id", *[F.round(f"e_{v}", 6).alias(f"e_{v}") for v in vocab.VIEW_ORDER],
                    *[F.round(F.col("attention")[i], 6).alias(f"a_{v}") for i, v in enumerate(vocab.VIEW_ORDER)])


@register("view_override", f"""
WITH t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{_EMBED_RE}')) AS tok FROM documents),
c AS (SELECT doc_id, tok, count(*) AS cnt FROM t WHERE length(tok) > 0 GROUP BY 1, 2),
s AS (SELECT doc_id, {S.md5_bucket('tok', vocab.EMBED_DIM)} AS dim,
             sum(CASE WHEN {S.md5_bucket("'sign:' || tok", 2)} = 0 THEN 1.0 ELSE -1.0 END * cnt) AS v
      FROM c GROUP BY 1, 2),
hv AS (SELECT doc_id, CASE WHEN sqrt(sum(v * v)) > 0 THEN 1.0 ELSE 0.0 END AS hn FROM s GROUP BY 1),
uv AS (SELECT vec_id, len(embedding) AS dims,
              sqrt(list_sum(list_transform(embedding, lambda x: CAST(x AS DOUBLE) * CAST(x AS DOUBLE)))) AS un
       FROM embeddings)
SELECT hv.doc_id, uv.vec_id IS NOT NULL AND uv.dims > 0 AS overridden,
       CAST(CASE WHEN uv.vec_id IS NOT NULL AND uv.dims > 0 THEN uv.dims ELSE {vocab.EMBED_DIM} END AS INTEGER) AS dims,
       round(CASE WHEN uv.vec_id IS NOT NULL AND uv.dims > 0 THEN uv.un ELSE hv.hn END, 6) AS norm
FROM hv LEFT JOIN uv ON hv.doc_id = uv.vec_id
""")
def q_view_override(spark, sf_dir):
    """A document's hashed code view replaced by the encoder vector when one exists."""
    from ..functions import numeric as NUM
    d = table(spark, sf_dir, "documents")
    views = V.densify(V.normalised(V.text_cells(d.select(F.col("doc_id").alias("package_id"), "text"), "code")))
    user = table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("package_id"), F.lit("code").alias("view"),
                                                      F.col("embedding").alias("vector"))
    o = J.override_vectors(views, user)
    return o.select(F.col("package_id").alias("doc_id"), "overridden", F.size("vector").cast("int").alias("dims"),
                    F.round(NUM.l2_norm("vector"), 6).alias("norm"))


# ------------------------------------------------------------------ training ---

from ..operators import training as TR  # noqa: E402
from ..operators import report as RP  # noqa: E402


def _doc_features(spark, sf_dir):
    d = table(spark, sf_dir, "documents")
    wc = FE.word_totals(d.select(F.col("doc_id").alias("package_id"), "text"))
    return FE.hashed_counts(wc, "code", None, vocab.WORD_CAP)


def _doc_labels(spark, sf_dir):
    lab = table(spark, sf_dir, "labels").join(table(spark, sf_dir, "documents").select("doc_id"), "doc_id", "left_semi")
    lab = lab.select(F.col("doc_id").alias("package_id"), "toxic")
    return TR.label_packages(lab.where(F.col("toxic") == 0), lab.where(F.col("toxic") == 1))


_HW_SQL = f"""
t AS (SELECT doc_id, unnest(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')) AS w,
             unnest(generate_series(1, len(regexp_extract_all(lower(text), '{vocab.WORD_PATTERN}')))) AS pos
      FROM documents),
c AS (SELECT doc_id, w, count(*) AS cnt, min(pos) AS fpos FROM t GROUP BY 1, 2),
r AS (SELECT doc_id, w, cnt, row_number() OVER (PARTITION BY doc_id ORDER BY cnt DESC, fpos) AS rank FROM c),
hw AS (SELECT doc_id, 'code_hash_' || CAST({S.md5_bucket('w', vocab.HASH_BUCKETS)} AS VARCHAR) AS feature,
              sum(least(cnt, {vocab.WORD_CAP}) / {float(vocab.WORD_CAP)}) AS value
       FROM r GROUP BY 1, 2),
lab AS (SELECT l.doc_id, CAST(l.toxic AS DOUBLE) AS y FROM labels l WHERE l.doc_id IN (SELECT doc_id FROM documents))"""


@register("training_union", """
SELECT doc_id AS package_id, CAST(toxic AS INTEGER) AS label FROM labels WHERE doc_id IN (SELECT doc_id FROM documents)
""")
def q_training_union(spark, sf_dir):
    """S7 + U2: benign and malicious package sets tagged and unioned (both labels required)."""
    return _doc_labels(spark, sf_dir).select("package_id", F.col("label").cast("int").alias("label"))


@register("vocabulary", f"""
WITH {_HW_SQL}
SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx
FROM (SELECT DISTINCT feature FROM hw WHERE doc_id IN (SELECT doc_id FROM lab))
""")
def q_vocabulary(spark, sf_dir):
    """A11 + W4: sorted feature vocabulary of the labelled training set."""
    feats = _doc_features(spark, sf_dir).join(_doc_labels(spark, sf_dir), "package_id", "left_semi")
    return FE.vocabulary(feats).select("feature", "idx")


@register("gd_step", f"""
WITH {_HW_SQL},
g AS (SELECT hw.feature, sum((0.5 - lab.y) * hw.value) / (SELECT count(*) FROM lab) AS g
      FROM hw JOIN lab ON hw.doc_id = lab.doc_id WHERE hw.value <> 0 GROUP BY 1)
SELECT feature, round(-{vocab.LOGISTIC_LR} * g, 6) AS weight FROM g
UNION ALL SELECT '{TR.BIAS}', round(-{vocab.LOGISTIC_LR} * sum(0.5 - y) / count(*), 6) FROM lab
""")
def q_gd_step(spark, sf_dir):
    """M10 (full-batch variant), one unrolled gradient step from zero weights."""
    w = TR.gradient_descent(_doc_features(spark, sf_dir), _doc_labels(spark, sf_dir), epochs=1)
    return w.select("feature", F.round("weight", 6).alias("weight"))


def _gd_sql(steps: int) -> str:
    """``steps`` gradient steps from zero weights, one after the other."""
    ctes = [f"""x AS MATERIALIZED (SELECT hw.doc_id, hw.feature, hw.value FROM hw JOIN lab ON hw.doc_id = lab.doc_id WHERE hw.value <> 0
                UNION ALL SELECT doc_id, '{TR.BIAS}', 1.0 FROM lab)""",
            "w0 AS MATERIALIZED (SELECT DISTINCT feature, CAST(0 AS DOUBLE) AS weight FROM x)"]
    for i in range(1, steps + 1):
        ctes.append(f"""e{i} AS MATERIALIZED (SELECT doc_id, {S.sigmoid('z')} - y AS err FROM lab JOIN
  (SELECT doc_id, sum(value * weight) AS z FROM x JOIN w{i-1} USING (feature) GROUP BY 1) USING (doc_id)),
w{i} AS MATERIALIZED (SELECT feature, weight - {vocab.LOGISTIC_LR} * (g + CASE WHEN feature = '{TR.BIAS}' THEN 0 ELSE {vocab.LOGISTIC_L2} * weight END) AS weight
  FROM w{i-1} JOIN (SELECT feature, sum(err * value) / (SELECT count(*) FROM lab) AS g FROM x JOIN e{i} USING (doc_id) GROUP BY 1) USING (feature))""")
    return f"WITH {_HW_SQL},\n" + ",\n".join(ctes)


def _gd_rows(spark, sf_dir, steps):
    w = TR.gradient_descent(_doc_features(spark, sf_dir), _doc_labels(spark, sf_dir), epochs=steps)
    return w.select("feature", F.round("weight", 8).alias("weight"))


@register("gd_steps_2", f"{_gd_sql(2)} SELECT feature, round(weight, 8) AS weight FROM w2")
def q_gd_steps_2(spark, sf_dir):
    """Two gradient steps, the second from weights that are not zero."""
    return _gd_rows(spark, sf_dir, 2)


@register("gd_steps_3", f"{_gd_sql(3)} SELECT feature, round(weight, 8) AS weight FROM w3")
def q_gd_steps_3(spark, sf_dir):
    """Three gradient steps."""
    return _gd_rows(spark, sf_dir, 3)


@register("vectorise", f"""
WITH {_HW_SQL},
own AS (SELECT hw.doc_id, feature, value FROM hw WHERE doc_id IN (SELECT doc_id FROM lab)),
voc AS (SELECT feature, CAST(row_number() OVER (ORDER BY feature) - 1 AS INTEGER) AS idx FROM (SELECT DISTINCT feature FROM own))
SELECT doc_id AS package_id, (SELECT CAST(count(*) AS INTEGER) FROM voc) AS size, idx, round(value, 6) AS value
FROM own JOIN voc USING (feature) WHERE value <> 0
""")
def q_vectorise(spark, sf_dir):
    """M8: the sparse vectors of the labelled documents, cell by cell."""
    feats = saved(_doc_features(spark, sf_dir).join(_doc_labels(spark, sf_dir), "package_id", "left_semi"), "features")
    voc = saved(FE.vocabulary(feats), "vocabulary")
    v = FE.vectorise(feats, voc, voc.count())
    cells = v.select("package_id", F.col("features.size").alias("size"), F.explode(F.arrays_zip("features.indices", "features.values")).alias("c"))
    return cells.select("package_id", "size", F.col("c.indices").alias("idx"), F.round("c.values", 6).alias("value"))


@register("model_file", f"{_gd_sql(2)} SELECT feature, round(weight, 8) AS weight, CAST(0.4 AS DOUBLE) AS threshold, 'md5' AS hash FROM w2")
def q_model_file(spark, sf_dir):
    """A trained model written as a model file and read again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/model-{uuid.uuid4().hex}"
    SK.save_model(TR.gradient_descent(_doc_features(spark, sf_dir), _doc_labels(spark, sf_dir), epochs=2), path, threshold=0.4)
    weights, about = SK.load_model(spark, path)
    return weights.join(F.broadcast(about.select("threshold", "hash"))).select("feature", F.round("weight", 8).alias("weight"), "threshold", "hash")


@register("logistic_train")
def q_logistic_train(spark, sf_dir):
    """L-BFGS logistic regression (pyspark.ml) on hashed document words vs toxic labels."""
    return TR.logistic_train(_doc_features(spark, sf_dir), _doc_labels(spark, sf_dir), method="lbfgs")


def _document_views(spark, sf_dir):
    """The three views of every document: its language and source, its words, and the graph of words that follow each other."""
    d = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("package_id"), "text", "lang", "source")
    fields = F.explode(F.array(F.struct(F.lit("lang").alias("field"), F.col("lang").alias("value")), F.struct(F.lit("source").alias("field"), F.col("source").alias("value"))))
    metadata = d.select("package_id", fields.alias("f")).select("package_id", "f.field", "f.value").where("value is not null")
    texts = d.select("package_id", "text")
    return saved(V.view_matrix(metadata, texts, V.word_graphs(texts)), "views", batch_rows=V.BATCH_ROWS)


@register("train_views")
def q_train_views(spark, sf_dir):
    """M19 (re-aimed): MLP on the attention-weighted matrix of all three hashed views of labelled documents.

    The network is stored, read again, and scores every labelled document from the file.
    """
    views, labels = _document_views(spark, sf_dir), _doc_labels(spark, sf_dir)
    attention = saved(SC.channel_attention(views), "attention")
    model, _ = TR.train_view_classifier(views, attention, labels)
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/view-model-{uuid.uuid4().hex}"
    SK.save_view_classifier(model, path)
    stored, _ = SK.load_view_classifier(spark, path)
    return TR.score_views(stored, TR.view_rows(views, attention, labels.select("package_id", F.col("label").cast("double").alias("label"))))


# ------------------------------------------------------------ evidence merge ---

@register("external_evidence", f"""
WITH {OK}, {_EDGES_CTE[1:]},
ext AS (SELECT 'u' || CAST(user_id AS VARCHAR) AS package_id,
               'scalpel:' || event_type || '_' || CAST(CAST(FLOOR(event_id / 20000) AS BIGINT) AS VARCHAR) || '.py' AS src,
               'scalpel:pkg.' || event_type || '.handle' AS dst FROM events),
me AS (SELECT package_id, src, dst, sum(weight) AS weight FROM
        (SELECT package_id, src, dst, weight FROM ew UNION ALL SELECT package_id, src, dst, 1 FROM ext) GROUP BY 1, 2, 3),
et AS (SELECT package_id, CAST(sum(weight) AS BIGINT) AS edges_total, CAST(count(*) AS BIGINT) AS distinct_edges FROM me GROUP BY 1),
an AS (SELECT package_id, name, sum(cnt) AS cnt FROM
        (SELECT package_id, api AS name, count(*) AS cnt FROM okev GROUP BY 1, 2
         UNION ALL SELECT DISTINCT package_id, 'handle', 0 FROM ext) GROUP BY 1, 2),
a AS (SELECT package_id, CAST(count(*) AS BIGINT) AS api_unique, CAST(sum(cnt) AS BIGINT) AS api_total FROM an GROUP BY 1)
SELECT et.package_id, edges_total, distinct_edges, api_unique, api_total FROM et JOIN a ON et.package_id = a.package_id
""")
def q_external_evidence(spark, sf_dir):
    """Edges reported by an external analyser merged with the extracted ones;
    callee tails registered with count 0."""
    facts = event_facts(spark, sf_dir)
    ev = table(spark, sf_dir, "events")
    ext = ev.select(F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("package_id"),
                    F.concat(F.col("event_type"), F.lit("_"), F.floor(F.col("event_id") / fixtures.CHUNK).cast("bigint").cast("string"),
                             F.lit(".py")).alias("src"),
                    F.concat(F.lit("pkg."), F.col("event_type"), F.lit(".handle")).alias("dst"))
    merged, zero = J.merge_external_edges(C.edge_weights(facts).select("package_id", "src", "dst", "weight"), ext)
    e = merged.groupBy("package_id").agg(F.sum("weight").cast("bigint").alias("edges_total"),
                                         F.count(F.lit(1)).alias("distinct_edges"))
    names = (C.count_names(facts, "call").select("package_id", "name", "cnt").unionByName(zero)
             .groupBy("package_id", "name").agg(F.sum("cnt").alias("cnt")))
    a = names.groupBy("package_id").agg(F.count(F.lit(1)).alias("api_unique"), F.sum("cnt").cast("bigint").alias("api_total"))
    return e.join(a, "package_id")


@register("external_blocks", f"""
WITH {OK},
own AS (SELECT package_id, count(*) FILTER (WHERE event_id % 3 IN (0, 1)) AS n FROM okev GROUP BY 1),
ext AS (SELECT package_id, CAST(sum(event_id % 4) AS BIGINT) AS blocks, CAST(sum(event_id % 3) AS BIGINT) AS links FROM ev WHERE event_id % 7 = 0 GROUP BY 1),
marked AS (SELECT *, CASE WHEN blocks <> 0 OR links <> 0 THEN 'SCALPEL_CFG_BLOCKS=' || CAST(blocks AS VARCHAR) || ';SCALPEL_CFG_EDGES=' || CAST(links AS VARCHAR) END AS marker FROM ext),
ch AS (SELECT package_id, c, count(*) AS k FROM (SELECT package_id, unnest(string_split(marker, '')) AS c FROM marked) GROUP BY 1, 2),
ent AS (SELECT package_id, log2(sum(k)) - sum(k * log2(k)) / sum(k) AS h FROM ch GROUP BY 1)
SELECT f.package_id, CAST(coalesce(n, 0) + coalesce(blocks, 0) AS BIGINT) AS cfg_nodes, CAST(2 * coalesce(n, 0) + coalesce(links, 0) AS BIGINT) AS cfg_edges,
       marker, CASE WHEN length(marker) > {vocab.HIGH_ENTROPY_MIN_LENGTH} AND h > {vocab.HIGH_ENTROPY_MIN_ENTROPY} THEN 1 ELSE 0 END AS marker_strings
FROM (SELECT DISTINCT package_id FROM files) f LEFT JOIN own USING (package_id) LEFT JOIN marked USING (package_id) LEFT JOIN ent USING (package_id)
""")
def q_external_blocks(spark, sf_dir):
    """Block counts of an external analyser added to the extracted ones, and its marker strings."""
    scalars = C.package_scalars(event_facts(spark, sf_dir))
    ext = table(spark, sf_dir, "events").where("event_id % 7 = 0").select(
        F.concat(F.lit("u"), F.col("user_id").cast("string")).alias("package_id"),
        (F.col("event_id") % 4).alias("blocks"), (F.col("event_id") % 3).alias("links"))
    merged = J.merge_external_blocks(scalars, ext).select("package_id", "cfg_nodes", "cfg_edges", "high_entropy_strings")
    before = scalars.select("package_id", F.col("high_entropy_strings").alias("_before"))
    marks = J.block_totals(ext).select("package_id", "marker")
    return merged.join(before, "package_id", "left").join(marks, "package_id", "left").select(
        "package_id", F.col("cfg_nodes").cast("bigint").alias("cfg_nodes"), F.col("cfg_edges").cast("bigint").alias("cfg_edges"), "marker",
        (F.col("high_entropy_strings") - F.coalesce("_before", F.lit(0))).cast("int").alias("marker_strings"))


# ------------------------------------------------------------- fused & report ---

def event_views(spark, sf_dir):
    p = event_pipeline(spark, sf_dir)
    if "views" not in p:
        p["views"] = saved(V.view_matrix(p["metadata"], p["snippets"], p["edges"]), "views", batch_rows=V.BATCH_ROWS)
    return p["views"]


@register("fused_score", f"""
{_RT_FEATURE_WITH},
ct AS (SELECT package_id, unnest(regexp_extract_all(lower(text), '{_EMBED_RE}')) AS tok FROM snips),
cc AS (SELECT package_id, tok, count(*) AS cnt FROM ct WHERE length(tok) > 0 GROUP BY 1, 2),
cs AS (SELECT package_id, {S.md5_bucket('tok', vocab.EMBED_DIM)} AS dim,
              sum(CASE WHEN {S.md5_bucket("'sign:' || tok", 2)} = 0 THEN 1.0 ELSE -1.0 END * cnt) AS v FROM cc GROUP BY 1, 2),
ce AS (SELECT package_id, CASE WHEN sum(v * v) > 0 THEN 1.0 ELSE 0.0 END AS e1 FROM cs GROUP BY 1),
ge AS (SELECT DISTINCT package_id, 1.0 AS e2 FROM ew),
att AS (SELECT n.package_id, 0.0 AS e0, coalesce(ce.e1, 0.0) AS e1, coalesce(ge.e2, 0.0) AS e2
        FROM named n LEFT JOIN ce ON n.package_id = ce.package_id LEFT JOIN ge ON n.package_id = ge.package_id),
sm AS (SELECT *, greatest(e0, e1, e2) AS m, exp(e0 - greatest(e0, e1, e2)) + exp(e1 - greatest(e0, e1, e2))
              + exp(e2 - greatest(e0, e1, e2)) AS z FROM att),
aw AS (SELECT package_id,
              CASE WHEN e0 = 0 AND e1 = 0 AND e2 = 0 THEN 1.0 / 3 ELSE exp(e0 - m) / z END AS a0,
              CASE WHEN e0 = 0 AND e1 = 0 AND e2 = 0 THEN 1.0 / 3 ELSE exp(e1 - m) / z END AS a1,
              CASE WHEN e0 = 0 AND e1 = 0 AND e2 = 0 THEN 1.0 / 3 ELSE exp(e2 - m) / z END AS a2 FROM sm),
sc AS (SELECT n.*, {S.sigmoid('(' + _RULE_SCORE + ') - 2.2')} AS base, aw.a0, aw.a1, aw.a2
       FROM named n JOIN aw ON n.package_id = aw.package_id),
fu AS (SELECT package_id, base, a0, a1, a2,
              least(greatest(0.40 * base
                + 0.20 * a0 * {S.sigmoid('2.5 * (meta_missing_ratio + meta_suspicious_words)')}
                + 0.25 * a1 * {S.sigmoid('3.5 * (sensitive_api_total + snippet_suspicious_words)')}
                + 0.15 * a2 * {S.sigmoid('2.5 * (graph_edges + cfg_edges)')}, 0.0), 1.0) AS p FROM sc)
SELECT package_id, round(base, 6) AS rule_probability, round(p, 6) AS probability,
       CASE WHEN p >= 0.5 THEN 'malicious' ELSE 'benign' END AS prediction,
       round(a0, 6) AS a_metadata, round(a1, 6) AS a_code, round(a2, 6) AS a_graph
FROM fu
""")
def q_fused_score(spark, sf_dir):
    """M16 + M17 + M18: three hashed views, channel attention and the fused probability."""
    p = event_pipeline(spark, sf_dir)
    att = SC.channel_attention(event_views(spark, sf_dir))
    f = SC.fused_score(p["named"], att)
    return f.select("package_id", F.round("rule_probability", 6).alias("rule_probability"),
                    F.round("probability", 6).alias("probability"), "prediction",
                    *[F.round(F.col("attention")[i], 6).alias(f"a_{v}") for i, v in enumerate(vocab.VIEW_ORDER)])


def _view_vectors_sql(tokens: str) -> str:
    """Signed, normalised hash vectors of ``tokens`` (package_id, view, tok, cnt), by dimension."""
    return f"""vs AS (SELECT package_id, view, {S.md5_bucket('tok', vocab.EMBED_DIM)} AS dim,
             sum(CASE WHEN {S.md5_bucket("'sign:' || tok", 2)} = 0 THEN 1.0 ELSE -1.0 END * cnt) AS v
      FROM (SELECT package_id, view, tok, sum(cnt) AS cnt FROM ({tokens}) WHERE length(tok) > 0 GROUP BY 1, 2, 3) GROUP BY 1, 2, 3),
vn AS (SELECT package_id, view, sqrt(sum(v * v)) AS nn FROM vs GROUP BY 1, 2)
SELECT package_id, view, dim, round(v / nn, 6) AS value FROM vs JOIN vn USING (package_id, view) WHERE v <> 0"""


_GRAPH_TOKENS_SQL = f"""
SELECT d.package_id, 'graph' AS view, d.node AS tok,
       CAST(floor(least({vocab.GRAPH_REPEAT_CAP}.0, 1.0 + d.out_w + d.in_w + {vocab.GRAPH_PR_SCALE} * r.rank)) AS BIGINT)
         + CASE WHEN {S.sensitive_call('d.node')} THEN {vocab.GRAPH_SENSITIVE_BONUS} ELSE 0 END AS cnt
FROM deg d JOIN r{ROUNDS} r ON r.package_id = d.package_id AND r.node = d.node
UNION ALL SELECT package_id, 'graph', src || '->' || dst, 1 FROM ew"""


def _sparse(views):
    return (views.select("package_id", "view", F.posexplode("vector").alias("dim", "value")).where("value <> 0")
            .withColumn("value", F.round("value", 6)))


@register("graph_embedding", f"""
WITH {OK}, {_EDGES_CTE},
{_converged_sql(ROUNDS)},
{_view_vectors_sql(_GRAPH_TOKENS_SQL)}
""")
def q_graph_embedding(spark, sf_dir):
    """PageRank/degree-weighted node tokens + edge tokens -> signed hash (graph view), by dimension."""
    return _sparse(event_views(spark, sf_dir).where(F.col("view") == "graph"))


@register("view_vectors", f"""
WITH {OK}{_SNIP}, {_EDGES_CTE},
{_converged_sql(ROUNDS)},
{_view_vectors_sql(_GRAPH_TOKENS_SQL + f"""
UNION ALL SELECT package_id, 'code', unnest(regexp_extract_all(lower(text), '{_EMBED_RE}')), 1 FROM snips""")}
""")
def q_view_vectors(spark, sf_dir):
    """The whole view matrix of the corpus by dimension (it has no metadata files, so no metadata view)."""
    return _sparse(event_views(spark, sf_dir))


def event_reports(spark, sf_dir):
    p = event_pipeline(spark, sf_dir)
    facts = event_facts(spark, sf_dir)
    scores = SC.heuristic_score(p["named"])
    counts = C.evidence_counts(p["packages"], p["scalars"], p["totals"], p["graph"], p["snippet_stats"].select(
        "package_id", F.col("snippet_n").alias("snippet_count")))
    mm = MD.metadata_map(p["metadata"])
    return RP.build_report(scores, counts, p["api_counts"], p["import_counts"], mm, facts, p["snippets"])


_IMPORT_FIRST_SQL = """
imps2 AS (
  SELECT package_id, path, event_type || '.core' AS name, 1 AS seq FROM okf
  UNION ALL SELECT package_id, path, event_type, 2 FROM okf
  UNION ALL SELECT package_id, path, CASE event_type WHEN 'error' THEN 'xml.dom.minidom'
                                     WHEN 'purchase' THEN 'subprocess' ELSE 'json' END, 3 FROM okf
  UNION ALL SELECT package_id, path, 'xml', 4 FROM okf WHERE event_type = 'error'),
ifirst AS (SELECT package_id, name, count(*) AS cnt, min(path) AS fpath FROM imps2 GROUP BY 1, 2),
iseq AS (SELECT f.package_id, f.name, f.cnt, f.fpath, min(i.seq) AS fseq FROM ifirst f
         JOIN imps2 i ON i.package_id = f.package_id AND i.name = f.name AND i.path = f.fpath GROUP BY 1, 2, 3, 4),
itop AS (SELECT package_id, string_agg(name || ':' || CAST(cnt AS VARCHAR), ', ' ORDER BY rk) AS top_imports
         FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY cnt DESC, fpath, fseq) AS rk FROM iseq)
         WHERE rk <= 15 GROUP BY 1),
afirst AS (SELECT c.package_id, c.name, c.cnt, c.fpath, min(o.event_id) AS feid FROM
            (SELECT package_id, api AS name, count(*) AS cnt, min(path) AS fpath FROM okev GROUP BY 1, 2) c
           JOIN okev o ON o.package_id = c.package_id AND o.api = c.name AND o.path = c.fpath GROUP BY 1, 2, 3, 4),
atop AS (SELECT package_id, string_agg(name || ':' || CAST(cnt AS VARCHAR), ', ' ORDER BY rk) AS top_sensitive_apis
         FROM (SELECT *, row_number() OVER (PARTITION BY package_id ORDER BY cnt DESC, fpath, feid) AS rk
               FROM afirst WHERE {sens}) WHERE rk <= 20 GROUP BY 1)"""


@register("report_fields", f"""
{_RT_FEATURE_WITH}, {_IMPORT_FIRST_SQL.format(sens=S.sensitive_call('name'))},
sc AS (SELECT package_id, {_RULE_SCORE} AS s, {_RULE_REASONS} AS reasons FROM named)
SELECT sc.package_id AS input,
       CASE WHEN {S.sigmoid('s - 2.2')} >= 0.5 THEN 'malicious' ELSE 'benign' END AS prediction,
       round({S.sigmoid('s - 2.2')}, 4) AS malicious_probability,
       CAST(fc.nfiles AS BIGINT) AS python_files, CAST(fc.nerr AS BIGINT) AS parse_errors,
       CAST(fc.nerr AS BIGINT) AS analysis_errors, CAST(tot.api_unique AS BIGINT) AS unique_api_calls,
       CAST(coalesce(gs.m, 0) AS BIGINT) AS call_graph_edges, CAST(coalesce(blk.cn, 0) AS BIGINT) AS cfg_nodes,
       CAST(2 * coalesce(blk.cn, 0) AS BIGINT) AS cfg_edges,
       CAST(coalesce((SELECT count(*) FROM snips WHERE snips.package_id = sc.package_id), 0) AS BIGINT) AS snippets,
       coalesce(itop.top_imports, '') AS top_imports, coalesce(atop.top_sensitive_apis, '') AS top_sensitive_apis,
       sc.reasons
FROM sc JOIN fc ON sc.package_id = fc.package_id JOIN tot ON sc.package_id = tot.package_id
     LEFT JOIN gs ON sc.package_id = gs.package_id LEFT JOIN blk ON sc.package_id = blk.package_id
     LEFT JOIN itop ON sc.package_id = itop.package_id LEFT JOIN atop ON sc.package_id = atop.package_id
""")
def q_report_fields(spark, sf_dir):
    """M20 + A12 + P7 + F15: report scalars, counts struct and top lists per package."""
    r = event_reports(spark, sf_dir)
    fmt = lambda c: F.array_join(F.transform(c, lambda x: F.concat(x["name"], F.lit(":"), x["cnt"].cast("string"))), ", ")
    return r.select("input", "prediction", F.round("malicious_probability", 4).alias("malicious_probability"),
                    *[F.col(f"counts.{c}").alias(c) for c in C.COUNT_FIELDS],
                    fmt(F.col("top_imports")).alias("top_imports"),
                    fmt(F.col("top_sensitive_apis")).alias("top_sensitive_apis"),
                    F.array_join("reasons", "; ").alias("reasons"))


@register("report_json", f"""
{_RT_FEATURE_WITH},
sc AS (SELECT package_id, {_RULE_SCORE} AS s FROM named)
SELECT package_id AS input, CAST(json_object('input', package_id, 'prediction',
       CASE WHEN {S.sigmoid('s - 2.2')} >= 0.5 THEN 'malicious' ELSE 'benign' END) AS VARCHAR) AS report
FROM sc
""")
def q_report_json(spark, sf_dir):
    """F16: reports as JSON documents (input and verdict of every package)."""
    return RP.report_json(event_reports(spark, sf_dir).select("input", "prediction"))


@register("report_lists", f"""
WITH {OK}{_SNIP},
pk AS (SELECT DISTINCT package_id FROM files),
err AS (SELECT package_id, path, row_number() OVER (PARTITION BY package_id ORDER BY path) AS n FROM files WHERE broken),
errs AS (SELECT package_id, string_agg(path, '|' ORDER BY n) AS error_files FROM err WHERE n <= 10 GROUP BY 1),
sn AS (SELECT package_id, text, row_number() OVER (PARTITION BY package_id ORDER BY snippet_seq) AS n FROM snips),
sns AS (SELECT package_id, md5(string_agg(text, chr(10) ORDER BY n)) AS snippets_md5, CAST(count(*) AS INTEGER) AS n_snippets FROM sn WHERE n <= 5 GROUP BY 1)
SELECT pk.package_id AS input, coalesce(error_files, '') AS error_files, coalesce(n_snippets, 0) AS n_snippets, coalesce(snippets_md5, md5('')) AS snippets_md5
FROM pk LEFT JOIN errs USING (package_id) LEFT JOIN sns USING (package_id)
""")
def q_report_lists(spark, sf_dir):
    """The first ten errors and five snippets of each report, from reports written as JSON and read again."""
    path = f"{ensure_checkpoint_dir(spark).rstrip('/')}/reports-{uuid.uuid4().hex}"
    reports = event_reports(spark, sf_dir)
    RP.write_reports(reports, path)
    r = spark.read.schema(reports.schema).json(path)
    return r.select("input", F.array_join(F.transform("analysis_errors", lambda e: F.split(e, ":")[0]), "|").alias("error_files"),
                    F.size("snippets").alias("n_snippets"), F.md5(F.array_join("snippets", "\n")).alias("snippets_md5"))


@register("rt_metadata", """
WITH c AS (SELECT c_custkey AS k, c_name, c_mktsegment AS seg, n_name FROM customer JOIN nation ON c_nationkey = n_nationkey),
f AS (
  SELECT k, 'name' AS field, CASE WHEN k % 2 = 1 AND k % 3 = 0 THEN 'other' ELSE c_name END AS value FROM c
  UNION ALL SELECT k, 'home-page', 'none' FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'summary', 'First line ' || seg FROM c WHERE k % 2 = 0
  UNION ALL SELECT k, 'description', CASE WHEN k % 2 = 0 THEN 'Body of ' || n_name ELSE 'Py ' || n_name END FROM c
  UNION ALL SELECT k, 'author', n_name FROM c WHERE k % 3 = 0
  UNION ALL SELECT k, 'license', '' FROM c WHERE k % 3 = 0
  UNION ALL SELECT k, 'license', 'MIT' FROM c WHERE k % 3 <> 0
  UNION ALL SELECT k, 'author-email', 'a' || CAST(k AS VARCHAR) || '@x.org' FROM c)
SELECT 'c' || CAST(k AS VARCHAR) AS package_id, field, value FROM f
""")
def q_rt_metadata(spark, sf_dir):
    """X9-X12 + A9: header, setup.cfg, pyproject.toml and setup.py texts made from customers, read and coalesced."""
    c = table(spark, sf_dir, "customer").join(table(spark, sf_dir, "nation"), F.col("c_nationkey") == F.col("n_nationkey"))
    k = F.col("c_custkey")
    texts = [
        ("header", "x.egg-info/PKG-INFO", k % 2 == 0, F.format_string(
            "Name: %s\nSummary: First\n  line %s\nHome-page: none\n\nBody  of\n%s\n", "c_name", "c_mktsegment", "n_name")),
        ("setup.cfg", "setup.cfg", k % 3 == 0, F.format_string("[metadata]\nname = other\nauthor = %s\nlicense =\n[options]\nx = 1\n", "n_name")),
        ("pyproject", "pyproject.toml", F.lit(True), F.format_string("[project]\nname = '%s'\nlicense = \"MIT\"\n", "c_name")),
        ("setup.py", "setup.py", F.lit(True), F.format_string("import setuptools\nsetuptools.setup(author_email='a%d@x.org', description='Py %s', version=1)\n", "c_custkey", "n_name"))]
    rows = None
    for kind, path, which, text in texts:
        own = c.where(which).select(F.concat(F.lit("c"), k.cast("string")).alias("package_id"), F.lit(path).alias("path"),
                                    F.lit(kind).alias("kind"), text.alias("text"))
        rows = own if rows is None else rows.unionByName(own)
    return MD.coalesce_metadata(MD.extract_metadata(rows)).select("package_id", "field", "value")


@register("rt_input_errors", f"""
WITH {OK}
SELECT package_id, CAST(count(*) FILTER (WHERE event_type <> 'error') AS BIGINT) AS python_files,
       CAST(count(*) FILTER (WHERE event_type <> 'error' AND broken) AS BIGINT) AS parse_errors,
       CAST(count(*) FILTER (WHERE event_type = 'error' OR broken) AS BIGINT) AS analysis_errors,
       coalesce(string_agg(path || ': unreadable', '; ' ORDER BY path) FILTER (WHERE event_type = 'error'), '') AS input_errors
FROM files GROUP BY 1
""")
def q_rt_input_errors(spark, sf_dir):
    """S5 + X1: files as bytes, of which those of one kind can't be read: errors, not parsed files."""
    from ..sources import files as SF
    files = fixtures.event_package_files(table(spark, sf_dir, "events"))
    lost = F.col("path").startswith("error_")
    files = files.withColumn("content", F.when(~lost, F.col("content"))).withColumn("error", F.when(lost, F.lit("unreadable")))
    facts = stored_facts(extract_facts(SF.source_units(files)))
    counts = C.package_scalars(facts).select("package_id", *[F.col(c).cast("bigint").alias(c) for c in ("python_files", "parse_errors", "analysis_errors")])
    errors = (facts.where((F.col("kind") == "error") & (F.col("name") == "input")).groupBy("package_id")
              .agg(F.array_join(F.array_sort(F.collect_list("value")), "; ").alias("input_errors")))
    return counts.join(errors, "package_id", "left").withColumn("input_errors", F.coalesce("input_errors", F.lit("")))


# ---------------------------------------------------------------- files and archives ---
# The corpus of ``events`` as files below the shared folder, found and read again by the scans.

_CORPUS_CACHE: dict[tuple, str] = {}


def event_archives(spark, sf_dir) -> str:
    """The folder of the events-derived corpus with an archive for each package, written once per session."""
    key = (spark.sparkContext.applicationId, sf_dir)
    if key not in _CORPUS_CACHE:
        root = saved_path(spark, "corpus-archives")
        fixtures.write_archives(fixtures.event_package_files(table(spark, sf_dir, "events")), root)
        _CORPUS_CACHE[key] = root
    return _CORPUS_CACHE[key]


def event_folders(spark, sf_dir) -> Iterator[str]:
    """Folders that hold the events-derived corpus between them, with a folder for each package.

    A file of a few hundred bytes takes a block of the disk, ten times and more its share of the table. So packages are
    written in waves: a folder holds its files from when it is asked for until the next one is, and its reader must have
    stored by then what it makes of them. After the last one all are removed.
    """
    roots = []
    for events in fixtures.event_waves(table(spark, sf_dir, "events")):
        if roots:
            fixtures.empty_files(spark, roots[-1])
        roots.append(saved_path(spark, "corpus-files"))
        fixtures.write_files(fixtures.event_package_files(events), roots[-1])
        yield roots[-1]
    for root in roots:
        fixtures.remove_files(spark, root)


@register("rt_scan_files", f"""
WITH {OK}
SELECT package_id, api AS name, CAST(count(*) AS BIGINT) AS cnt FROM okev GROUP BY 1, 2
""")
def q_rt_scan_files(spark, sf_dir):
    """Packages as folders, listed and read by tasks; the calls found are those of ``rt_calls``."""
    path = saved_path(spark, "facts")
    for root in event_folders(spark, sf_dir):
        facts = stored_facts(extract_facts(SF.source_units(SF.scan_files(spark, root))), path)
    return C.count_names(facts, "call").select("package_id", "name", "cnt")


@register("rt_scan_archives", f"""
WITH {OK}
SELECT package_id || CASE WHEN CAST(substr(package_id, 2) AS BIGINT) % 2 = 0 THEN '.zip' ELSE '.tar' END AS package_id,
       api AS name, CAST(count(*) AS BIGINT) AS cnt FROM okev GROUP BY 1, 2
""")
def q_rt_scan_archives(spark, sf_dir):
    """Packages as zip and tar archives, whose members are dealt to tasks."""
    files = SF.scan_archives(spark, event_archives(spark, sf_dir))
    facts = stored_facts(extract_facts(SF.source_units(files)))
    return C.count_names(facts, "call").select("package_id", "name", "cnt")


@register("rt_capped_files", f"""
WITH {OK},
place AS (SELECT package_id, path, row_number() OVER (PARTITION BY package_id ORDER BY path) AS n FROM files)
SELECT package_id, CAST(count(*) FILTER (WHERE n <= 3) AS BIGINT) AS read_files, CAST(count(*) FILTER (WHERE n > 3) AS BIGINT) AS left_out,
       CAST(sum(CASE WHEN n <= 3 THEN k ELSE 0 END) AS BIGINT) AS lines
FROM place JOIN (SELECT package_id, path, 4 * count(*) + 2 AS k FROM ev GROUP BY 1, 2) USING (package_id, path) GROUP BY 1
""")
def q_rt_capped_files(spark, sf_dir):
    """At most three files of a package, in path order; those left out are rows with an error."""
    path = saved_path(spark, "capped")
    for root in event_folders(spark, sf_dir):
        units = SF.source_units(SF.scan_files(spark, root), max_files=3)
        capped = saved(units.groupBy("package_id").agg(
            F.count("text").alias("read_files"), F.count_if(F.col("error") == "beyond the first 3 files").alias("left_out"),
            F.sum(F.coalesce(F.size(T.split_lines("text")), F.lit(0))).alias("lines")), "capped", path=path)
    return capped
