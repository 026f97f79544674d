"""Merging ordered sources: order travels in ordinal columns, never in partitions."""

from __future__ import annotations

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F


def by_display_priority(docs: DataFrame, rank: str = "display_rank", ordinal: str = "ordinal") -> DataFrame:
    """One row per doc_id: the least (rank, ordinal)."""
    rest = [c for c in docs.columns if c != "doc_id"]
    return docs.groupBy("doc_id").agg(F.min_by(F.struct(*rest), F.struct(rank, ordinal)).alias("r")).select("doc_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def best_capture(rows: DataFrame, digest: str = "digest", status: str = "status", stamp: str = "stamp", ordinal: str = "ordinal") -> DataFrame:
    """One row per content digest: the best capture (status 200, then latest, then first) in the slot of the first;
    rows with a blank digest are never merged."""
    key = F.coalesce(F.nullif(F.trim(digest), F.lit("")), F.concat(F.lit("#"), F.col(ordinal).cast("string")))
    rank = F.struct((F.trim(F.col(status)) == "200").alias("ok"), F.coalesce(stamp, F.lit("")).alias("at"), (-F.col(ordinal)).alias("first"))
    best = rows.groupBy(key.alias("__k")).agg(F.max_by(F.struct(*rows.columns), rank).alias("r"), F.min(ordinal).alias("slot"))
    return best.select("slot", *(F.col(f"r.{c}").alias(c) for c in rows.columns))


def per_source_cap(docs: DataFrame, keys: list[str], ordinal: str, most: int) -> DataFrame:
    """The first `most` rows per key; WindowGroupLimit keeps the rest from being shuffled."""
    w = Window.partitionBy(*keys).orderBy(ordinal)
    return docs.withColumn("__n", F.row_number().over(w)).where(F.col("__n") <= most).drop("__n")


def interleave(docs: DataFrame, owner: str = "person_id", source: str = "source_rank", ordinal: str = "ordinal", most: int = 40) -> DataFrame:
    """Round-robin over an owner's sources: the first of each source, then the second of each; a document sits where it
    appears first and is shown as the source of least rank has it. Returns slot 0 to most - 1 per owner."""
    place = F.struct((F.row_number().over(Window.partitionBy(owner, source).orderBy(ordinal)) - 1).alias("column"), F.col(source).alias("row"))
    rest = [c for c in docs.columns if c not in (owner, "doc_id")]
    one = docs.withColumn("__place", place).groupBy(owner, "doc_id").agg(
        F.min("__place").alias("__place"), F.min_by(F.struct(*rest), F.struct(source, ordinal)).alias("r"))
    slot = F.row_number().over(Window.partitionBy(owner).orderBy("__place")) - 1
    return one.withColumn("slot", slot).where(F.col("slot") < most).select(owner, "doc_id", *(F.col(f"r.{c}").alias(c) for c in rest), "slot")


def batches(rows: DataFrame, keys: list[str], ordinal: str, size: int) -> DataFrame:
    """Consecutive batches of `size` rows per key, from 0."""
    return rows.withColumn("batch_no", F.floor((F.row_number().over(Window.partitionBy(*keys).orderBy(ordinal)) - 1) / size).cast("long"))


def person_ids(roster: DataFrame) -> DataFrame:
    """Ids of a roster (ordinal, name, details): the name's slug; a later equal one takes its first detail's slug too;
    what still collides takes -2, -3 and so on, in order. Blank names go."""
    from kinweave.functions.text import slug

    named = roster.where(F.trim("name") != "").withColumn("base", slug(F.col("name")))
    n = F.row_number().over(Window.partitionBy("base").orderBy("ordinal"))
    detail = slug(F.get("details", F.lit(0)))
    named = named.withColumn("id", F.when((n == 1) | (F.coalesce(detail, F.lit("")) == ""), F.col("base")).otherwise(F.concat_ws("-", "base", detail)))
    k = F.row_number().over(Window.partitionBy("id").orderBy("ordinal"))
    return named.withColumn("person_id", F.when(k == 1, F.col("id")).otherwise(F.concat("id", F.lit("-"), k.cast("string")))).drop("base", "id")
