"""Resolution, hub extraction, model answers and view models over customers, events and orders."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions.roster import roster
from kinweave.operators import evidence, identity, requests, views
from kinweave.plans.catalogue import query
from kinweave.plans.fixtures import FACTS, TODAY, facts, table
from kinweave.plans.readers import _P, _people


def _who(spark, sf_dir):
    return _people(spark, sf_dir).withColumn("who", roster("name", "details"))


@query(f"SELECT person_id, CASE WHEN person_id % 3 <> 0 THEN 'employer' WHEN person_id % 2 = 0 THEN 'school' ELSE 'other' END AS attribute FROM {_P}")
def verdict_attributes(spark, sf_dir):
    p = _who(spark, sf_dir).withColumn("d", F.when(F.col("person_id") % 2 == 0, "her college").otherwise("shoe size"))
    a = identity.verdict_attributes(F.col("who"), F.concat(F.lit("seen at "), "echo"), F.col("d"))
    return p.select("person_id", identity.primary_attribute(a, F.col("d")).alias("attribute"))


@query(f"SELECT person_id, person_id % 3 = 0 AS contradicts FROM {_P}")
def identity_conflict(spark, sf_dir):
    return _who(spark, sf_dir).select("person_id", identity.contradicts(F.col("who"), F.concat(F.lit("Employer: "), "echo", F.lit(". City: unknown"))).alias("contradicts"))


@query(f"SELECT person_id, 'Q' || k AS qid, 'u' || k AS github, lpad(k, 10, '0') AS cik FROM {_P} WHERE person_id % 3 <> 0")
def strong_keys(spark, sf_dir):
    p = _who(spark, sf_dir)
    doc = lambda kind, url, title, text: F.struct(F.lit(kind).alias("kind"), url.alias("url"), title.alias("title"), text.alias("text"))
    docs = p.select("person_id", F.explode(F.array(
        doc("wikidata", F.concat(F.lit("https://www.wikidata.org/wiki/Q"), "k"), F.col("name"), F.col("echo")),
        doc("github", F.concat(F.lit("https://github.com/u"), "k"), F.col("name"), F.concat(F.lit("Name: "), "name", F.lit("\nCompany: "), "echo")),
        doc("edgar", F.concat(F.lit("https://www.sec.gov/"), "k"), F.lit("Form 4"), F.concat("name", F.lit(" CIK: "), F.lpad("k", 10, "0"), F.lit("\n"), "echo")))).alias("d")).select("person_id", "d.*")
    keys = identity.strong_keys(identity.key_candidates(p, docs))
    return keys.select("person_id", F.col("strong_keys")["wikidata_qid"].alias("qid"), F.col("strong_keys")["github"].alias("github"), F.col("strong_keys")["sec_cik"].alias("cik"))


@query("SELECT user_id AS person_id, least(n, 5) AS calls, greatest(n - 5, 0) AS refused_by_budget, e AS errors FROM (SELECT user_id, count(*) AS n, count(*) FILTER (r <= 5 AND event_type = 'error') AS e FROM (SELECT *, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS r FROM events) GROUP BY 1)")
def call_budget(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id"), F.col("event_id").alias("call_ordinal"), (F.col("event_type") == "error").alias("failed"))
    return requests.counters(requests.budgeted(e, 5))


@query("SELECT event_id AS request_id, CASE WHEN event_id % 4 < 2 THEN event_type END AS match, event_id % 4 >= 2 AS failed FROM events")
def model_answers(spark, sf_dir):
    e = table(spark, sf_dir, "events").select(F.col("event_id").alias("request_id"), "event_type")
    good = F.to_json(F.struct(F.col("event_type").alias("match")))
    # by event_id % 4: at once, on the retry in a fence, refused, never
    first = F.when(F.col("request_id") % 4 == 0, good).otherwise("well, it is")
    second = F.when(F.col("request_id") % 4 == 1, F.concat(F.lit("```json\n"), good, F.lit("\n```"))).when(F.col("request_id") % 4 == 2, good).otherwise("{")
    r = e.select("request_id", F.explode(F.array(F.struct(F.lit(1).alias("attempt"), first.alias("text"), (F.col("request_id") % 4 == 2).alias("refused")), F.struct(F.lit(2).alias("attempt"), second.alias("text"), F.lit(False).alias("refused")))).alias("r")).select("request_id", "r.*")
    return requests.answers(e, r, "match string").select("request_id", F.col("answer.match").alias("match"), "failed")


@query("SELECT lower(replace(c_name, '#', '-')) AS token, c_custkey AS person_id FROM customer UNION ALL SELECT DISTINCT c_mktsegment, NULL FROM customer")
def roster_lookup(spark, sf_dir):
    c = table(spark, sf_dir, "customer")
    people = c.select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.col("c_custkey").alias("ordinal"))
    tokens = c.select(F.replace("c_name", F.lit("#"), F.lit("-")).alias("token")).select(F.lower("token").alias("token")).union(c.select("c_mktsegment"))
    return views.lookup(people.withColumn("person_id", F.col("person_id").cast("string")), tokens).select("token", F.col("person_id").cast("long").alias("person_id"))


@query(f"""WITH {FACTS}, c AS (SELECT person_id AS digest_id, fact_id, CAST(substr(doc_id, 2) AS BIGINT) AS number, category AS section FROM facts WHERE NOT excluded)
  SELECT digest_id, number, fact_id, CAST(row_number() OVER (PARTITION BY digest_id, number ORDER BY fact_id) AS INT) AS position, section AS sections, section || ': part ' || section AS backs FROM c""")
def source_evidence(spark, sf_dir):
    f = facts(spark, sf_dir)
    claims = f.select(F.col("person_id").alias("digest_id"), F.substring("fact_id", 2, 10).cast("long").alias("claim_ordinal"), F.col("category").alias("section"), F.concat(F.lit("part "), "category").alias("detail"), "fact_id", "doc_id", (~F.col("excluded")).alias("displayable"))
    claims = claims.union(claims)  # a claim made twice counts once
    sources = f.select(F.col("person_id").alias("digest_id"), "doc_id", F.substring("doc_id", 2, 9).cast("long").alias("number")).distinct()
    return views.source_evidence(claims, sources)


@query(f"""SELECT p.person_id, h.label, 'wd:Q' || p.k AS hub_id, p.k || '-f0' AS evidence, 0.5::DOUBLE AS recency FROM {_P}, (SELECT 'Loom Guild' AS label) h WHERE p.person_id % 3 <> 0""")
def hub_evidence(spark, sf_dir):
    p = _people(spark, sf_dir).withColumn("batch_no", F.lit(0).cast("long"))
    docs = p.select("person_id", "batch_no", F.col("k").alias("doc_id"), F.lit("wikidata").alias("kind"), F.concat(F.lit("https://www.wikidata.org/wiki/Q"), "k").alias("url"), F.col("name").alias("title"),
                    F.concat(F.lit("A member of the "), F.when(F.col("person_id") % 3 != 0, "Loom Guild").otherwise("choir")).alias("text"), F.lit(None).cast("date").alias("published_at"))
    kept = p.select("person_id", "batch_no", F.col("k").alias("doc_id"), F.concat("k", F.lit("-f0")).alias("fact_id"), F.concat("name", F.lit(" joined the Loom Guild")).alias("text"), F.lit("q").alias("quote"))
    cands = p.select("person_id", "batch_no", F.lit(0).alias("cand_ordinal"), F.lit("Loom  Guild").alias("label"), F.lit("company").alias("type"), F.concat(F.lit("q"), "k").alias("qid"), F.lit("").alias("doc_id"), F.lit(False).alias("is_field"),
                     F.array().cast("array<string>").alias("claimed"))
    hubs = evidence.merge_hubs(evidence.collect_hubs(cands, kept, docs, TODAY))
    return hubs.select("person_id", "label", "hub_id", F.array_join("evidence", ",").alias("evidence"), "recency")


@query("""WITH h AS (SELECT ps AS hub_id, ps % 7 AS k FROM (SELECT DISTINCT p_partkey AS ps FROM part)), n AS (SELECT hub_id, k, row_number() OVER (PARTITION BY k ORDER BY hub_id) - 1 AS i, count(*) OVER (PARTITION BY k) AS n FROM h)
  SELECT hub_id, 0.0::DOUBLE AS dx, round(-1.0 * (i - (n - 1) / 2.0) * 26 * -1, 4)::DOUBLE AS dy FROM n WHERE n > 1""")
def fan_offsets(spark, sf_dir):
    hubs = table(spark, sf_dir, "part").select(F.col("p_partkey").alias("hub_id"), F.col("p_partkey").alias("ordinal"), F.explode(F.array(F.col("p_partkey") % 7, F.col("p_partkey") % 7 + 100)).alias("person_id"))
    places = spark.range(200).select(F.col("id").alias("person_id"), F.when(F.col("id") < 100, 50.0).otherwise(10.0).alias("x"), F.lit(0.0).alias("y"))
    return views.fan(hubs, places).select("hub_id", (F.col("dx") + 0.0).alias("dx"), "dy")
