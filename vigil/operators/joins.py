"""Joins (J1-J6) and the size-checked broadcast helper."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from ..functions import predicates as P
from ..functions import text as T
from ..functions import vocab

#: Dictionaries, models and vocabularies up to this size are broadcast; it is far below what an executor holds.
DEFAULT_BROADCAST_BYTES = 64 << 20


def broadcast_if_small(df: DataFrame, max_bytes: int = DEFAULT_BROADCAST_BYTES) -> DataFrame:
    """Broadcast ``df`` if its rows, as text, take at most ``max_bytes``; otherwise leave the join to the planner."""
    size = df.agg(F.sum(F.length(F.to_json(F.struct(*df.columns))) + 32).alias("b")).first()["b"] or 0
    return F.broadcast(df) if size <= max_bytes else df


def dictionary_semi_join(df: DataFrame, dictionary: DataFrame, name_col: str = "name",
                         dict_col: str = "name", anti: bool = False) -> DataFrame:
    """Keep (or with ``anti`` drop) rows whose name is in the dictionary.

    Dictionaries are bounded (a few hundred entries); the size is still checked
    before broadcasting.
    """
    d = dictionary.select(F.col(dict_col).alias("_dict_name")).distinct()
    d = broadcast_if_small(d)
    return df.join(d, F.col(name_col) == F.col("_dict_name"), "left_anti" if anti else "left_semi")


def prefix_semi_join(df: DataFrame, dictionary: DataFrame, name_col: str = "name",
                     dict_col: str = "name", anti: bool = False) -> DataFrame:
    """Keep rows whose name equals a dictionary entry or lies below it
    (``entry.``-prefix), case-insensitively.

    No nested loop: the *distinct* names are expanded to their dotted prefixes
    and equi-joined with the (broadcast, size-checked) dictionary; the matched
    name set is then semi-joined back on equality.
    """
    d = dictionary.select(F.lower(F.col(dict_col)).alias("_p")).distinct()
    d = broadcast_if_small(d)
    names = df.select(F.col(name_col).alias("_n")).distinct()
    matched = (names.select("_n", F.explode(T.dotted_prefixes(F.lower("_n"))).alias("_p"))
                    .join(d, "_p", "left_semi").select("_n").distinct())
    return df.join(matched, F.col(name_col) == F.col("_n"), "left_anti" if anti else "left_semi")


def context_snippets(calls: DataFrame, units: DataFrame, radius: int = vocab.SNIPPET_RADIUS,
                     cap: int | None = None, key: str = "package_id") -> DataFrame:
    """J3 + A8 for calls found elsewhere: the lines around each call.

    ``calls(package_id, path, seq, lineno)``; ``units`` holds ``(package_id, path, text)``. The places of
    a file meet its text once and the lines are cut out of it there, so lines are never exploded or
    joined. ``snippet_seq`` numbers the snippets of a file; with ``cap`` those of a package, of which the
    first ``cap`` stay (by path, then place). Output::

        package_id, snippet_seq, path, lineno, text  ("# path:lineno\\n" + lines)
    """
    from pyspark.sql import Window

    places = calls.select(key, "path", "seq", "lineno")
    if cap is not None:
        places = (places.withColumn("snippet_seq", F.row_number().over(Window.partitionBy(key).orderBy("path", "seq")))
                  .where(F.col("snippet_seq") <= cap))
    else:
        places = places.withColumn("snippet_seq", F.lit(0))
    of_file = places.groupBy(key, "path").agg(F.array_sort(F.collect_list(F.struct("seq", "lineno", "snippet_seq"))).alias("_p"))
    cut = (units.select(key, "path", T.split_lines("text").alias("_lines")).join(of_file, [key, "path"])
           .select(key, "path", "_lines", F.posexplode("_p").alias("_i", "_c")))
    first = F.greatest(F.lit(1), F.col("_c.lineno") - radius)
    lines = F.slice("_lines", first, F.col("_c.lineno") + radius - first + 1)
    return cut.where(F.size("_lines") >= first).select(
        key, (F.when(F.col("_c.snippet_seq") > 0, F.col("_c.snippet_seq")).otherwise(F.col("_i") + 1)).alias("snippet_seq"), "path",
        F.col("_c.lineno").alias("lineno"),
        F.concat(F.lit("# "), F.col("path"), F.lit(":"), F.col("_c.lineno").cast("string"), F.lit("\n"),
                 F.array_join(lines, "\n")).alias("text"))


def block_totals(external: DataFrame, key: str = "package_id") -> DataFrame:
    """``(package_id, blocks, links, marker)`` of the block counts that an external analyser reports.

    ``external(package_id, blocks, links)``, any number of rows for a package; nulls count as zero. The marker is the
    string literal by which the totals enter the string features (its wording is a fixed value), null if both are zero.
    """
    total = lambda c: F.sum(F.coalesce(c, F.lit(0))).cast("bigint").alias(c)
    marker = F.concat(F.lit("SCALPEL_CFG_BLOCKS="), F.col("blocks").cast("string"), F.lit(";SCALPEL_CFG_EDGES="), F.col("links").cast("string"))
    return (external.groupBy(key).agg(total("blocks"), total("links"))
            .withColumn("marker", F.when((F.col("blocks") != 0) | (F.col("links") != 0), marker)))


def merge_external_blocks(scalars: DataFrame, external: DataFrame, key: str = "package_id") -> DataFrame:
    """Add block counts from an external analyser to ``cfg_nodes`` and ``cfg_edges`` of the scalars, and its marker
    strings to the string counters.

    Packages that the scalars lack get a row with their block counts and zeros.
    """
    sums = block_totals(external, key).select(key, F.col("blocks").alias("_b"), F.col("links").alias("_l"), F.col("marker").alias("_m"))
    j = scalars.join(sums, key, "full_outer")
    zero = {c: F.coalesce(F.col(c), F.lit(0)).cast(t) for c, t in scalars.dtypes if c != key}
    more = {"cfg_nodes": F.coalesce("_b", F.lit(0)), "cfg_edges": F.coalesce("_l", F.lit(0))}
    for name, test in (("high_entropy_strings", P.is_high_entropy_string), ("url_strings", P.is_url_string), ("long_strings", P.is_long_string)):
        more[name] = F.when(test("_m"), 1).otherwise(0)
    for name, extra in more.items():
        if name in zero:
            zero[name] = (zero[name] + extra).cast("bigint")
    return j.select(key, *[c.alias(n) for n, c in zero.items()])


def merge_external_edges(edges: DataFrame, external: DataFrame, key: str = "package_id",
                         prefix: str = "scalpel:") -> tuple[DataFrame, DataFrame]:
    """Add edges from an external analyser and register callee tails with count 0.

    ``edges(package_id, src, dst, weight)``; ``external(package_id, src, dst)``
    (one row per reported edge). Returns ``(merged_edges, zero_count_api_names)``
    where the second frame is ``(package_id, name, cnt=0)`` rows to union into
    the API counts (they raise distinct-API counts, not totals).
    """
    ext = external.select(key, F.concat(F.lit(prefix), F.col("src").cast("string")).alias("src"),
                          F.concat(F.lit(prefix), F.col("dst").cast("string")).alias("dst"),
                          F.lit(1).cast("bigint").alias("weight"))
    merged = (edges.select(key, "src", "dst", F.col("weight").cast("bigint"))
                   .unionByName(ext)
                   .groupBy(key, "src", "dst").agg(F.sum("weight").alias("weight")))
    zero = external.select(key, T.last_part(F.col("dst").cast("string")).alias("name"),
                           F.lit(0).cast("bigint").alias("cnt"))
    return merged, zero


def override_vectors(views: DataFrame, user_vectors: DataFrame, key: str = "package_id") -> DataFrame:
    """Replace a hashed view vector by a user-supplied encoder vector when present.

    ``views(package_id, view, vector)``, ``user_vectors(package_id, view, vector)``;
    a null/empty user vector falls back to the hashed one.
    """
    u = user_vectors.select(key, "view", F.col("vector").alias("_user"))
    j = views.join(u, [key, "view"], "left")
    use_user = F.col("_user").isNotNull() & (F.size("_user") > 0)
    return j.select(key, "view", F.when(use_user, F.col("_user").cast("array<double>"))
                    .otherwise(F.col("vector").cast("array<double>")).alias("vector"),
                    use_user.alias("overridden"))
