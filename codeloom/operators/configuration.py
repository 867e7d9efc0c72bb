"""Layered configuration and error details as data."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F


def resolved(config: DataFrame) -> DataFrame:
    """(key, value) of the highest layer that has the key."""
    return config.groupBy("key").agg(F.max_by("value", "layer").alias("value"))


def out_of_range(config: DataFrame, rules: DataFrame) -> DataFrame:
    """Rows whose number is outside its rule's bounds; rules are a few literals."""
    n = F.col("value").try_cast("double")
    return config.join(rules, "key").filter(n.isNull() | ~n.between(F.col("lo"), F.col("hi")))


def missing(config: DataFrame, required: tuple[str, ...]) -> DataFrame:
    """One row: the required keys that no layer has, joined."""
    keys = config.sparkSession.createDataFrame([(k,) for k in required], "key string")
    lacking = keys.join(config, "key", "left_anti")
    return lacking.agg(F.array_join(F.sort_array(F.collect_list("key")), ", ").alias("missing"))


def details(given: dict[str, Column]) -> Column:
    """A map without the keys whose value is null or empty."""
    pairs = [x for k, v in given.items() for x in (F.lit(k), v)]
    return F.map_filter(F.create_map(*pairs), lambda k, v: v.isNotNull() & (v != ""))


def severity(code: Column, table: dict[str, str], default: str = "medium") -> Column:
    out = F.lit(default)
    for k, v in table.items():
        out = F.when(code == k, v).otherwise(out)
    return out
