"""Exact deduplication: group by a 128-bit content hash, confirm by comparing bytes, keep one stable id."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import ascii_lower, cut, texts


#: A group with more than this share of all rows is joined by broadcast; there are fewer than 1 / HOT_SHARE of them.
HOT_SHARE = 1e-3


def md5_key(text: Column) -> Column:
    return F.unhex(F.md5(text))


def exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest",
                     normalise: Callable[[Column], Column] = ascii_lower, key: Callable[[Column], Column] = md5_key) -> DataFrame:
    """One row per row of docs: doc_id, keep_id, group_size, kept, text_sha256.

    Texts are equal when their normalised bytes are; a null text counts as empty. The row with the largest
    (or smallest) id of a group stays. The key only proposes groups: every member's bytes are compared with the
    other's, and groups that hold different bytes are grouped again by their whole text, so a collision cannot merge texts.

    A row with a null id counts in group_size but can only stay in a group that has no id at all (keep_id null).
    Repeated rows (same id and text) count once each and share one fate. An empty table gives an empty result.
    Other columns of docs are not read, so their names cannot clash.

    Plan: one scan makes narrow rows (id, 16-byte key, 32-byte digest), which are checkpointed, aggregated map-side
    per key and joined back, groups of over HOT_SHARE of all rows by a broadcast of their fewer than a thousand
    keys, so that none of them meets in one task. Text is shuffled once, by id, which has no hot key; members of groups of two or more
    then meet in a map-side minimum and maximum of their bytes per key, which agree exactly if all bytes do, so a
    huge group sends one text per task. Only keys where they differ are grouped again by whole text.
    """
    best = {"largest": F.max, "smallest": F.min}[keep]
    raw = texts(docs, id_col, text_col)
    norm = normalise(F.coalesce("text", F.lit("")))
    rows = cut(raw.select("doc_id", norm.alias("norm")).select("doc_id", key(F.col("norm")).alias("k"), F.unhex(F.sha2("norm", 256)).alias("sha")))
    sizes = rows.groupBy("k").agg(best("doc_id").alias("keep_id"), F.count("*").alias("n"))
    hot = F.broadcast(cut(sizes.where(F.col("n") > rows.count() * HOT_SHARE)))
    rows = rows.join(hot, "k").unionByName(rows.join(hot.select("k"), "k", "left_anti").join(sizes, "k"))

    # byte comparison inside groups: text is fetched for members of real groups only
    role = rows.where("n > 1 and doc_id is not null").select("doc_id", "k").distinct()
    member = raw.join(role, "doc_id").select("doc_id", norm.alias("norm"), "k").where(key(F.col("norm")) == F.col("k"))
    unequal = cut(member.groupBy("k").agg(F.min("norm").alias("lo"), F.max("norm").alias("hi")).where("lo <> hi").select("k"))
    if not unequal.isEmpty():
        apart = member.join(unequal, "k", "left_semi").groupBy("k", "norm").agg(best("doc_id").alias("own_keep"), F.count("*").alias("own_n"))
        apart = apart.select("k", F.unhex(F.sha2("norm", 256)).alias("sha"), "own_keep", "own_n")
        rows = rows.join(apart, ["k", "sha"], "left").withColumns({"keep_id": F.coalesce("own_keep", "keep_id"), "n": F.coalesce("own_n", "n")})
    return rows.select(
        "doc_id", "keep_id", F.col("n").alias("group_size"), F.col("doc_id").eqNullSafe(F.col("keep_id")).alias("kept"),
        F.lower(F.hex("sha")).alias("text_sha256"))


def drop_exact_duplicates(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", keep: str = "largest") -> DataFrame:
    """The rows of docs that stay, with all their columns. Rows with a null id stay; repeated rows of a kept id all stay."""
    kept = exact_duplicates(docs, id_col, text_col, keep).where("kept and doc_id is not null").select(F.col("doc_id").alias("__kept"))
    return docs.join(kept, docs[id_col].cast("long") == F.col("__kept"), "left_semi").unionByName(docs.where(docs[id_col].isNull()))
