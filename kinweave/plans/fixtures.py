"""Tables of the library's own shapes, derived from the driver's tables by fixed rules over all rows."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from kinweave.functions import numbers as N

#: Hub types by k % 10, the fixed day that recency counts from, kinds by source number.
TYPES = ("investor", "board", "company", "school", "city", "topic", "technology", "event", "cause", "person")
TODAY = "2025-06-01"
KINDS = ("self_page", "wikipedia", "wikidata", "github", "openalex", "edgar", "propublica", "hn", "wayback", "search", "uspto", "youtube", "podcast", "fec", "courtlistener")
CATEGORIES = ("current_work", "recent_activity", "affiliation", "hook", "interest", "non_obvious")


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(df: DataFrame, key: str) -> DataFrame:
    """df dealt out by key. A small compressed file is one split, so that costly columns over it would be one task's work."""
    return df.repartition(key)


def _pick(values: tuple[str, ...], index):
    return F.element_at(F.array(*map(F.lit, values)), (index % len(values) + 1).cast("int"))


def sql_pick(values: tuple[str, ...], index: str) -> str:
    return "list_extract([" + ", ".join(f"'{v}'" for v in values) + f"], CAST(({index}) % {len(values)} AS INT) + 1)"


def hub_edges(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Purchases as edges: person = user, hub = props.k, type by k, recency by the last purchase before TODAY."""
    e = table(spark, sf_dir, "events").where("event_type = 'purchase'").select(
        F.col("user_id").alias("person_id"), F.get_json_object("props", "$.k").cast("long").alias("hub_id"), "ts", "event_id")
    # parity of the hub widens the age so that all bands occur
    age = F.to_date(F.date_sub(F.to_date("last"), (F.col("hub_id") % 4 * 400).cast("int")))
    return e.groupBy("person_id", "hub_id").agg(F.max("ts").alias("last"), F.min("event_id").alias("hub_ordinal")).select(
        "person_id", "hub_id", _pick(TYPES, F.col("hub_id")).alias("type"), F.concat(F.lit("Hub number "), F.col("hub_id").cast("string")).alias("label"),
        N.recency(age, F.lit(TODAY).cast("date")).alias("recency"), "hub_ordinal")


EDGES = f"""edges AS (
  SELECT person_id, hub_id, {sql_pick(TYPES, 'hub_id')} AS type, 'Hub number ' || hub_id AS label, hub_ordinal,
         CASE WHEN DATE '{TODAY}' - day <= 365 THEN 1.0 WHEN DATE '{TODAY}' - day <= 1095 THEN 0.6 ELSE 0.3 END::DOUBLE AS recency
  FROM (SELECT user_id AS person_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS hub_id, min(event_id) AS hub_ordinal,
               CAST(max(ts) AS DATE) - CAST(CAST(json_extract_string(props, '$.k') AS BIGINT) % 4 * 400 AS INT) AS day
        FROM events WHERE event_type = 'purchase' GROUP BY user_id, CAST(json_extract_string(props, '$.k') AS BIGINT))),
people AS (SELECT count(DISTINCT user_id)::DOUBLE AS n FROM events),
stats AS (SELECT hub_id, carriers, greatest(0.0, ln(n / (1 + carriers))) AS idf,
                 CASE type WHEN 'investor' THEN 1.5 WHEN 'board' THEN 1.5 WHEN 'company' THEN 1.5 WHEN 'event' THEN 1.3 WHEN 'cause' THEN 1.3
                           WHEN 'person' THEN 1.3 WHEN 'school' THEN 0.8 WHEN 'city' THEN 0.5 ELSE 1.0 END AS boost, type, label
          FROM (SELECT hub_id, count(DISTINCT person_id) AS carriers, min(type) AS type, min(label) AS label FROM edges GROUP BY hub_id), people),
contrib AS (SELECT a.person_id, b.person_id AS other_id, a.hub_id, s.type, s.label, s.idf * least(a.recency, b.recency) * s.boost AS contribution
            FROM edges a JOIN edges b ON a.hub_id = b.hub_id AND a.person_id <> b.person_id JOIN stats s ON s.hub_id = a.hub_id WHERE s.idf > 0),
pairs AS (SELECT person_id, other_id, round(sum(contribution), 12) AS raw FROM contrib GROUP BY ALL),
scored AS (SELECT person_id, other_id, raw,
                  CAST(CASE WHEN raw <= 0 THEN 0 WHEN n < 3 THEN 100 ELSE least(100, greatest(0, round_even(100 * raw / (ln(n / 3) * 1.5), 0))) END AS INT) AS score,
                  CAST(row_number() OVER (PARTITION BY person_id ORDER BY raw DESC, other_id) AS INT) AS rank
           FROM pairs, people)"""


def people(spark: SparkSession, sf_dir: str) -> int:
    """Everyone in the graph, with hubs or without: one number."""
    return table(spark, sf_dir, "events").select("user_id").distinct().count()


def facts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Orders as facts: person = customer, category, kind and confidence by order key."""
    k = F.col("o_orderkey")
    return table(spark, sf_dir, "orders").select(
        F.col("o_custkey").alias("person_id"), F.format_string("f%010d", k).alias("fact_id"), _pick(CATEGORIES, k).alias("category"), _pick(KINDS, k + F.col("o_custkey")).alias("kind"),
        (F.lit(0.5) + k % 6 / 10.0).alias("confidence"), F.when(k % 7 != 0, F.to_date("o_orderdate")).alias("published_at"), (k % 11 == 0).alias("excluded"),
        F.when(k % 22 == 0, F.lit("family")).alias("exclusion_reason"), F.concat(F.lit("d"), (k % 50).cast("string")).alias("doc_id"))


FACTS = f"""facts AS (
  SELECT o_custkey AS person_id, 'f' || lpad(CAST(o_orderkey AS VARCHAR), 10, '0') AS fact_id, {sql_pick(CATEGORIES, 'o_orderkey')} AS category,
         {sql_pick(KINDS, 'o_orderkey + o_custkey')} AS kind, 0.5::DOUBLE + (o_orderkey % 6)::DOUBLE / 10 AS confidence,
         CASE WHEN o_orderkey % 7 <> 0 THEN CAST(o_orderdate AS DATE) END AS published_at, o_orderkey % 11 = 0 AS excluded,
         CASE WHEN o_orderkey % 22 = 0 THEN 'family' END AS exclusion_reason, 'd' || (o_orderkey % 50) AS doc_id FROM orders)"""
