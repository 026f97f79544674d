"""Elections: the most common value of a group under three rules for ties."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from kinweave.operators.components import sorted_joins


def elect(df: DataFrame, keys: list[str], value: str, out: str | None = None) -> DataFrame:
    """The most common non-null value per key, the smallest of equals. mode(x, true) is exactly that."""
    return df.groupBy(*keys).agg(F.mode(value, True).alias(out or value))


def unambiguous(df: DataFrame, keys: list[str], value: str, voter: str | None = None, out: str | None = None) -> DataFrame:
    """The most common value per key, or null where two are equally common. With voter, votes are distinct voters."""
    votes = df.where(F.col(value).isNotNull()).groupBy(*keys, value).agg((F.count_distinct(voter) if voter else F.count("*")).alias("__n"))
    # two maxima of a pre-aggregated pair settle it without ranking a group: the largest and the smallest leader
    best = votes.groupBy(*keys).agg(F.max("__n").alias("__top"))
    lead = votes.join(sorted_joins(best), keys).where(F.col("__n") == F.col("__top")).groupBy(*keys).agg(F.count("*").alias("__k"), F.min(value).alias("__v"))
    return lead.select(*keys, F.when(F.col("__k") == 1, F.col("__v")).alias(out or value))


def best_evidenced(df: DataFrame, keys: list[str], value: str, weight: str, out: str | None = None) -> DataFrame:
    """The value with the largest (maximum weight, count) per key; '' where two values share it."""
    per = df.where(F.coalesce(F.col(value), F.lit("")) != "").groupBy(*keys, value).agg(F.max(weight).alias("__w"), F.count("*").alias("__n"))
    rank = F.struct("__w", "__n")
    best = per.groupBy(*keys).agg(F.max(rank).alias("__top"))
    lead = per.join(sorted_joins(best), keys).where(rank == F.col("__top")).groupBy(*keys).agg(F.count("*").alias("__k"), F.min(value).alias("__v"))
    return lead.select(*keys, F.when(F.col("__k") == 1, F.col("__v")).otherwise("").alias(out or value))


def choose_one(df: DataFrame, keys: list[str], candidate: str, points: str, corroborated: bool = False) -> DataFrame:
    """The candidate with most points per key, null on a tie or where the best has none; a single candidate is taken
    without points unless corroboration is asked for."""
    best = df.groupBy(*keys).agg(F.max(points).alias("__top"), F.count("*").alias("__all"))
    lead = df.join(sorted_joins(best), keys).where(F.col(points) == F.col("__top")).groupBy(*keys, "__top", "__all").agg(
        F.count("*").alias("__k"), F.min(candidate).alias("__v"))
    single = (F.col("__all") == 1) & F.lit(not corroborated)
    return lead.select(*keys, F.when(single | ((F.col("__k") == 1) & (F.col("__top") > 0)), F.col("__v")).alias("chosen"))
