"""Typed scans and sinks: dossiers, rosters, recorded answers with expiry, and safe JSON output."""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

FACT = ("struct<fact_id:string,text:string,category:string,provenance:struct<doc_id:string,url:string,source_kind:string,quote:string,"
        "published_at:date,retrieved_at:timestamp,confidence:double>,excluded:boolean,exclusion_reason:string>")
HUB = "struct<hub_id:string,label:string,type:string,recency:double,evidence_fact_ids:array<string>>"
REJECTED = "struct<doc_id:string,match:string,confidence:double,evidence:string,disambiguator:string>"
DOSSIER = (f"person struct<person_id:string,name:string,details:array<string>>, resolution struct<person_id:string,status:string,strong_keys:map<string,string>,"
           f"accepted_doc_ids:array<string>,rejected:array<{REJECTED}>,confidence:double>, facts array<{FACT}>, hubs array<{HUB}>, built_at timestamp, schema_version int")
ROSTER = "people array<struct<name:string,details:array<string>>>"
#: Connectors in display order.
DISPLAY_ORDER = ("self_page", "wikipedia", "wikidata", "github", "openalex", "edgar", "propublica", "hn", "wayback", "search")


def read_dossiers(spark: SparkSession, path: str) -> DataFrame:
    """One row per dossier file, the last path winning a person; a malformed file fails the read. No folder, no rows."""
    if not _there(spark, path):
        return spark.createDataFrame([], DOSSIER)
    df = spark.read.schema(DOSSIER).option("multiLine", True).option("mode", "FAILFAST").json(path).withColumn("path", F.col("_metadata.file_path"))
    return df.groupBy("person.person_id").agg(F.max_by(F.struct(*df.columns), "path").alias("r")).select("r.*").drop("path")


def facts_of(dossiers: DataFrame) -> DataFrame:
    return dossiers.select(F.col("person.person_id").alias("person_id"), F.posexplode("facts").alias("fact_ordinal", "f")).select("person_id", "fact_ordinal", "f.*")


def hub_edges_of(dossiers: DataFrame) -> DataFrame:
    """Edges of resolved people only."""
    return dossiers.where("resolution.status = 'resolved'").select(F.col("person.person_id").alias("person_id"), F.posexplode("hubs").alias("hub_ordinal", "h")).select(
        "person_id", "hub_ordinal", "h.hub_id", "h.label", "h.type", "h.recency", F.col("h.evidence_fact_ids").alias("evidence"))


def read_roster(spark: SparkSession, path: str) -> DataFrame:
    """(ordinal, name, details) of a JSON roster; an entry may be a bare name. A roster without people is an error."""
    entry = spark.read.text(path, wholetext=True).select(F.posexplode(F.from_json("value", "people array<string>")["people"]).alias("ordinal", "e"))
    known = F.from_json("e", "name string, details array<string>")
    out = entry.select("ordinal", F.when(F.ltrim("e").startswith("{"), known["name"]).otherwise(F.trim("e")).alias("name"), F.coalesce(known["details"], F.array().cast("array<string>")).alias("details"))
    if out.isEmpty():
        raise ValueError(f"{path} names nobody")
    return out


def _there(spark: SparkSession, path: str) -> bool:
    """Whether Spark's reader finds anything under a path."""
    try:
        spark.read.format("binaryFile").load(path)
        return True
    except AnalysisException as e:
        if e.getCondition() == "PATH_NOT_FOUND":
            return False
        raise


def source_kinds(spark: SparkSession) -> DataFrame:
    """(kind, display_rank, displayable, non_obvious): the dimension of source kinds."""
    from kinweave.operators.exclusion import DISPLAYABLE, NON_OBVIOUS

    kinds = [*DISPLAY_ORDER, *(k for k in (*DISPLAYABLE, "fec", "courtlistener") if k not in DISPLAY_ORDER)]
    return spark.createDataFrame([(k, i, k in DISPLAYABLE, k in NON_OBVIOUS) for i, k in enumerate(kinds)], "kind string, display_rank int, displayable boolean, non_obvious boolean")


def live_answers(cache: DataFrame, now: str) -> DataFrame:
    """Recorded answers that still hold: no expiry, or one after now; a blank body without expiry is no answer."""
    at = F.lit(now).cast("timestamp")
    return cache.where((F.col("expires_at").isNull() & (F.coalesce(F.trim("body"), F.lit("")) != "")) | (F.col("expires_at") > at))


def violations(facts: DataFrame) -> DataFrame:
    """(person_id, fact_id, rule) of rows that break a constraint."""
    rules = {"blank_text": ~F.col("text").rlike(r"\S"), "confidence": ~(F.col("confidence").between(0, 1) & ~F.isnan("confidence")), "blank_id": F.trim("fact_id") == ""}
    broken = F.array_compact(F.array(*(F.when(F.coalesce(c, F.lit(True)), F.lit(r)) for r, c in rules.items())))
    return facts.select("person_id", "fact_id", F.explode(broken).alias("rule"))


def safe_ids(df: DataFrame, col: str) -> DataFrame:
    """Rows whose id is a safe path segment."""
    return df.where(~F.col(col).isin("", ".", "..") & ~F.col(col).rlike(r"[/\\\x00]"))


def write_dossiers(dossiers: DataFrame, path: str) -> None:
    """One JSON folder per person; the commit protocol makes it atomic. Only the people written are replaced."""
    out = dossiers.withColumn("person_id", F.col("person.person_id"))
    safe_ids(out, "person_id").write.partitionBy("person_id").option("partitionOverwriteMode", "dynamic").mode("overwrite").json(path)


def still_to_build(roster: DataFrame, complete: DataFrame) -> DataFrame:
    """People without a complete dossier."""
    return roster.join(complete.select("person_id"), "person_id", "left_anti")
