"""Dictionary tables (S6) and their union.

The sets are small and fixed (a few hundred names); they are created as
DataFrames with a ``source`` column and joined with a size-checked broadcast.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..functions import vocab

DICTIONARIES = {
    "blacklist_calls": vocab.BLACKLIST_CALLS,
    "blacklist_imports": vocab.BLACKLIST_IMPORTS,
    "malware_apis": vocab.MALWARE_APIS,
    "suspicious_words": vocab.SUSPICIOUS_WORDS,
    "metadata_fields": vocab.METADATA_FIELDS,
    "skip_dirs": vocab.SKIP_DIRS,
}


def load_dictionary(spark: SparkSession, name: str) -> DataFrame:
    """One dictionary as ``(name, source)`` rows."""
    if name == "sensitive_apis":
        return dictionary_union(load_dictionary(spark, "blacklist_calls"), load_dictionary(spark, "malware_apis"))
    values = DICTIONARIES[name]
    return spark.createDataFrame([(v, name) for v in values], "name string, source string")


def dictionary_union(*dicts: DataFrame) -> DataFrame:
    """Union of dictionaries, one row per distinct name (first source kept)."""
    u = dicts[0]
    for d in dicts[1:]:
        u = u.unionByName(d)
    return u.groupBy("name").agg(F.min("source").alias("source"))
