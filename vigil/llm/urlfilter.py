"""URL filters: host-suffix and path-prefix expressions looked up by short hash prefixes.

A rule (host, path, verdict) fits a URL whose host is the rule's or a subdomain of
it, and whose path starts with the rule's. Among the rules that fit, the longest
(host and path together) counts; of equally long ones that with the longer host,
and of the same expression under both verdicts ``block``.

Every distinct URL is expanded into the expressions that a rule could have: its
last k labels with the first r characters of its path, for each shape (k, r) that
the rules have. Expressions are joined with the rules on the first eight digits of
their SHA-256, the full digest is confirmed, and precedence picks one rule for each
URL. Native Spark throughout.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, unused, written

#: Rules up to so many bytes are broadcast; more are joined by shuffle, with the expressions salted.
BROADCAST_BYTES = 64 << 20
SALTS = 16
#: URLs with more than a share 1 / HOT of all rows: fewer than HOT, so their results can be broadcast.
HOT = 1000


def host_of(url: Column) -> Column:
    """What lies between the first ``://`` and ``/``, ``?``, ``#`` or the end, A-Z in lower case; else empty."""
    return ascii_lower(F.regexp_extract(_rest(url), "^[^/?#]*", 0))


def path_of(url: Column) -> Column:
    """What follows the host up to ``?``, ``#`` or the end; else empty."""
    return F.regexp_extract(_rest(url), "^[^/?#]*([^?#]*)", 1)


def _rest(url: Column) -> Column:
    at = F.instr(F.coalesce(url, F.lit("")), "://")
    return F.when(at > 0, F.substr(url, at + 3)).otherwise("")


def _labels(host: Column) -> Column:
    return F.length(host) - F.length(F.replace(host, F.lit("."))) + 1


def _digest(host: Column, path: Column) -> Column:
    """The digest of an expression; the length keeps host and path apart."""
    return F.sha2(F.concat(F.length(host).cast("string"), F.lit(":"), host, path), 256)


def _prefix(digest: Column) -> Column:
    return F.substring(digest, 1, 8)


def expressions(host: Column, path: Column, shapes: list[tuple[int, int]]) -> Column:
    """Digests of the expressions of a URL in the given shapes (labels, characters of the path)."""
    labels, reach = _labels(host), F.length(path)

    def one(shape):
        suffix = F.call_function("substring_index", host, F.lit("."), -shape["k"])
        return F.when((labels >= shape["k"]) & (reach >= shape["r"]), _digest(suffix, F.substr(path, F.lit(1), shape["r"])))

    every = F.array(*[F.struct(F.lit(k).alias("k"), F.lit(r).alias("r")) for k, r in shapes])
    return F.filter(F.transform(every, one), lambda d: d.isNotNull())


def rule_table(rules: DataFrame) -> DataFrame:
    """The rules by digest: prefix, digest, k and r (their shape), rank (what precedence compares), rule, verdict.

    Null hosts and paths are empty; A-Z in hosts are lower-cased; rules without a verdict don't count.
    """
    host, path = ascii_lower(F.coalesce("host", F.lit(""))), F.coalesce("path", F.lit(""))
    one = (rules.where("verdict is not null").select(host.alias("host"), path.alias("path"), "verdict")
           .groupBy("host", "path").agg(F.max(F.struct((F.col("verdict") == "block").alias("block"), "verdict"))["verdict"].alias("verdict")))
    digest = _digest(F.col("host"), F.col("path"))
    rank = F.struct((F.length("host") + F.length("path")).alias("length"), F.length("host").alias("host_length"))
    return one.select(_prefix(digest).alias("prefix"), digest.alias("digest"), _labels(F.col("host")).alias("k"), F.length("path").alias("r"),
                      rank.alias("rank"), F.concat("host", "path").alias("rule"), "verdict")


def judge(pages: DataFrame, rules: DataFrame, default: str = "allow", url: str = "url") -> DataFrame:
    """``pages`` with host, path, rule (null where none fits) and verdict (the rule's, else ``default``).

    ``rules`` has host, path and verdict (``allow`` or ``block``). A null URL, or one without ``://``, has an empty host and
    path. Rows, repeated ones too, keep apart; an empty table gives an empty result, without rules every verdict is
    ``default``. Columns called host, path, rule or verdict are replaced, all others are kept whatever their names.

    The driver gets the distinct shapes of the rules: at most labels of the longest host times characters of the longest path.
    """
    spark = pages.sparkSession
    known = written(rule_table(rules), "rules")
    shapes = sorted((r["k"], r["r"]) for r in known.select("k", "r").distinct().collect())
    keep = pages.drop(*(c for c in ("host", "path", "rule", "verdict") if c != url))
    key, alike, best = (unused(keep, n) for n in ("key", "alike", "best"))
    given = F.coalesce(F.col(f"`{url}`"), F.lit(""))
    rows = keep.withColumn(key, F.md5(given))
    if not shapes:
        found = spark.createDataFrame([], "key string, n long, best struct<rank:struct<length:int,host_length:int>,rule:string,verdict:string>")
    else:
        size = known.agg(F.sum(F.octet_length("rule") + 160).alias("b")).first()["b"]
        urls = (rows.select(F.col(key).alias("key"), host_of(given).alias("host"), path_of(given).alias("path"))
                .groupBy("key").agg(F.count("*").alias("n"), F.any_value("host").alias("host"), F.any_value("path").alias("path")))
        asked = (urls.select("key", "n", F.explode_outer(expressions(F.col("host"), F.col("path"), shapes)).alias("digest"))
                 .withColumn("prefix", _prefix(F.col("digest"))))
        said = known.select("prefix", F.col("digest").alias("full"), F.struct("rank", "rule", "verdict").alias("best"))
        if size <= BROADCAST_BYTES:
            met = asked.join(F.broadcast(said), "prefix", "left")
        else:  # an expression such as a top-level domain may be in a third of all URLs
            asked = asked.withColumn("salt", F.pmod(F.xxhash64("key"), F.lit(SALTS)))
            said = said.withColumn("salt", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(SALTS - 1).cast("long"))))
            met = asked.join(said, ["prefix", "salt"], "left")
        found = met.groupBy("key").agg(F.max("n").alias("n"), F.max(F.when(F.col("full") == F.col("digest"), F.col("best"))).alias("best"))
    found = written(found, "urls")
    total = found.agg(F.sum("n").alias("n")).first()["n"] or 0
    often = found.where(F.col("n") * HOT > total).select(F.col("key").alias(key), F.lit(True).alias(alike), F.col("best").alias(best + "_1"))
    rare = found.where((F.col("n") * HOT <= total) & F.col("best").isNotNull()).select(F.col("key").alias(key), F.col("best").alias(best + "_2"))
    # rows of a frequent URL have their result already: their keys are dealt out and meet nothing
    dealt = F.when(F.col(alike), F.concat(F.lit("-"), F.xxhash64(*[f"`{c}`" for c in keep.columns]).cast("string"))).otherwise(F.col(key))
    out = rows.join(F.broadcast(often), key, "left").withColumn(key, dealt).join(rare, key, "left")
    chosen = F.coalesce(best + "_1", best + "_2")
    return out.select(*[f"`{c}`" for c in keep.columns], host_of(given).alias("host"), path_of(given).alias("path"),
                      chosen["rule"].alias("rule"), F.coalesce(chosen["verdict"], F.lit(default)).alias("verdict"))
