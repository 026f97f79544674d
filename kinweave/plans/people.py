"""People, facts, exclusion and digests over orders and customers."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.functions import numbers as N
from kinweave.operators import digest, exclusion, merging, views
from kinweave.plans.catalogue import query
from kinweave.plans.fixtures import CATEGORIES, FACTS, KINDS, TODAY, _pick, facts, spread, sql_pick, table

#: Invented sentences by customer: what each kind of rule has to tell apart.
LINES = (
    "{} was diagnosed with asthma last year.", "{} builds clinical software for hospitals.", "{} is married to a painter.", "{} reportedly moved abroad.",
    "{} settled the lawsuit quietly.", "{} runs a marketing campaign for bakers.", "{} has a net worth of millions.", "{} teaches pottery on Sundays.",
    "{} voted for the new bridge.", "{} bought a house by the lake.", "{} wrote a children's book.", "{} sells surgery robots.", "{} joined the ballot committee.",
    "{} underwent heart surgery and left the hospital for home.", "{} sold a divorce-mediation app to law firms.", "{} was sued by a neighbour over a fence.",
    "{} lives in a mill outside town.", "{} gave 500 to a mayor's campaign.", "His sister company ships looms; {} signs for both.", "{} keeps their salary data in a drawer.",
    "{} publishes salary transparency research.", "{} and her partner run the mill.", "{} left, and no filing explains it.", "{} was charged with rebuilding the bridge.",
    "{} was charged with petty theft.", "{} tracks court records for publishers.", "A clerk kept their court records; {} knew.", "{} has two sons at sea.",
    "{} is a registered independent contractor.", "The farmhouse they bought is on 12 Mill Lane; {} said so.",
)


def _sentences(spark, sf_dir):
    c, k = spread(table(spark, sf_dir, "customer").select("c_custkey", "c_name"), "c_custkey"), F.col("c_custkey")
    return c.select(k.alias("person_id"), F.replace(_pick(LINES, k), F.lit("{}"), F.col("c_name")).alias("text"))


_LINES_SQL = "list_extract([" + ", ".join("'" + x.replace("'", "''") + "'" for x in LINES) + f"], CAST(c_custkey % {len(LINES)} AS INT) + 1)"
_DECISION, _REASON = exclusion.verdict_sql("text")
#: The rules once more in SQL, over the customers' sentences.
JUDGED = f"""said AS (SELECT c_custkey AS person_id, replace({_LINES_SQL}, '{{}}', c_name) AS text FROM customer),
  judged AS (SELECT person_id, text, {_DECISION} AS decision, {_REASON} AS reason FROM said)"""


@query(f"WITH {JUDGED} SELECT person_id, decision, reason FROM judged")
def taste_rules(spark, sf_dir):
    return _sentences(spark, sf_dir).withColumn("v", exclusion.rule_verdict(F.col("text"))).select("person_id", "v.decision", "v.reason")


@query(f"SELECT doc_id, {_DECISION} AS decision, {_REASON} AS reason FROM (SELECT doc_id, text || ' ' || replace({_LINES_SQL.replace('c_custkey', 'doc_id')}, '{{}}', 'Ada') AS text FROM documents)")
def taste_documents(spark, sf_dir):
    """Whole documents with a sentence after them."""
    said = F.concat("text", F.lit(" "), F.replace(_pick(LINES, F.col("doc_id")), F.lit("{}"), F.lit("Ada")))
    return table(spark, sf_dir, "documents").select("doc_id", exclusion.rule_verdict(said).alias("v")).select("doc_id", "v.decision", "v.reason")


@query(f"WITH {JUDGED} SELECT CASE decision WHEN 'exclude' THEN reason WHEN 'unsure' THEN 'low_confidence' ELSE 'shown' END AS reason, count(*) AS n FROM judged GROUP BY 1")
def taste_applied(spark, sf_dir):
    return exclusion.apply_rules(_sentences(spark, sf_dir)).groupBy(F.coalesce("exclusion_reason", F.lit("shown")).alias("reason")).agg(F.count("*").alias("n"))


@query(f"WITH {JUDGED} SELECT person_id, CASE WHEN decision = 'exclude' THEN '{exclusion.QUOTE_WITHHELD}' ELSE text END AS quote FROM judged")
def quote_screen(spark, sf_dir):
    return _sentences(spark, sf_dir).select("person_id", exclusion.screen_quote(F.col("text")).alias("quote"))


@query(f"""WITH {JUDGED} SELECT CASE WHEN decision = 'unsure' THEN CASE WHEN person_id % 3 = 0 THEN 'keep' WHEN person_id % 3 = 1 THEN 'exclude' ELSE 'unsure' END ELSE decision END <> 'keep' AS excluded, count(*) AS n
  FROM judged GROUP BY 1""")
def taste_rulings(spark, sf_dir):
    f = _sentences(spark, sf_dir).select(F.floor(F.col("person_id") / 20).alias("batch_no"), F.col("person_id").cast("string").alias("fact_id"), "text", "person_id")
    p = F.col("person_id")
    said = F.when(p % 3 == 0, F.array(F.lit("keep"), F.lit("keep"))).when(p % 3 == 1, F.array(F.lit("family"))).otherwise(F.array(F.lit("keep"), F.lit("family")))
    r = f.select("batch_no", "fact_id", F.explode(said).alias("verdict"))
    return exclusion.apply_rulings(f.drop("person_id"), r).groupBy("excluded").agg(F.count("*").alias("n"))


WHY = "CASE WHEN excluded THEN coalesce(exclusion_reason, 'excluded') WHEN NOT confidence >= 0.7 THEN 'low_confidence' WHEN kind IN ('fec', 'courtlistener') THEN 'source_kind' END"


def _judged(spark, sf_dir):
    f = facts(spark, sf_dir)
    return f.withColumn("reason", exclusion.withholding_reason(F.col("excluded"), F.col("exclusion_reason"), F.col("confidence"), F.col("kind")))


@query(f"WITH {FACTS} SELECT {WHY} AS reason, count(*) AS n FROM facts WHERE {WHY} IS NOT NULL GROUP BY 1")
def withheld_histogram(spark, sf_dir):
    return views.reason_histogram(_judged(spark, sf_dir))


@query(f"WITH {FACTS} SELECT person_id, count(*) FILTER ({WHY} IS NULL) AS shown, count(*) FILTER ({WHY} IS NOT NULL) AS withheld FROM facts GROUP BY 1")
def fact_counts(spark, sf_dir):
    return views.fact_counts(_judged(spark, sf_dir))


SHOWN = f"shown AS (SELECT * FROM facts WHERE {WHY} IS NULL)"
NEWEST = "published_at DESC NULLS LAST, confidence DESC, fact_id DESC"


@query(f"WITH {FACTS}, {JUDGED} SELECT fact_id FROM facts JOIN judged USING (person_id) WHERE {WHY} IS NULL AND decision <> 'exclude'")
def displayable(spark, sf_dir):
    f = facts(spark, sf_dir).join(_sentences(spark, sf_dir), "person_id")
    return f.where(exclusion.is_displayable(F.col("text"), F.col("excluded"), F.col("confidence"), F.col("kind"))).select("fact_id")


@query(f"""WITH {FACTS}, {SHOWN}, p AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY category <> 'recent_activity', {NEWEST}) AS n FROM shown
    WHERE published_at IS NOT NULL AND category IN ('recent_activity', 'affiliation', 'hook', 'interest'))
  SELECT person_id, fact_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY {NEWEST}) AS INT) AS place FROM p WHERE n <= 3""")
def lately_top3(spark, sf_dir):
    return digest.lately(_judged(spark, sf_dir).where("reason is null")).select("person_id", "fact_id", "place")


@query(f"WITH {FACTS}, {SHOWN} SELECT person_id, max_by(fact_id, (confidence, fact_id)) AS fact_id FROM shown WHERE category = 'non_obvious' GROUP BY 1")
def non_obvious_pick(spark, sf_dir):
    return digest.non_obvious(_judged(spark, sf_dir).where("reason is null"))


@query(f"""WITH {FACTS}, {SHOWN} SELECT person_id, fact_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY category = 'hook' DESC,
  CASE WHEN category = 'hook' THEN confidence END DESC NULLS LAST, CASE WHEN category = 'hook' THEN fact_id END DESC NULLS LAST, {NEWEST}) AS INT) AS place FROM shown""")
def opener_hooks(spark, sf_dir):
    return digest.opener_hooks(_judged(spark, sf_dir).where("reason is null")).select("person_id", "fact_id", "place")


@query(f"""WITH {FACTS}, g AS (SELECT person_id, doc_id, min(fact_id) AS mention, min_by(fact_id, (-confidence, fact_id)) AS fact_id FROM facts GROUP BY ALL)
  SELECT person_id AS digest_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY mention, doc_id) AS INT) AS number, doc_id, fact_id FROM g""")
def sources_numbered(spark, sf_dir):
    m = facts(spark, sf_dir).select(F.col("person_id").alias("digest_id"), F.col("fact_id").alias("mention"), "doc_id", "fact_id", "confidence")
    return digest.numbered_sources(m).select("digest_id", "number", "doc_id", "fact_id")


@query(f"""WITH {FACTS}, g AS (SELECT person_id, count(*) AS documents, count(*) FILTER (NOT excluded) AS kept, count(*) FILTER (excluded) AS excluded, list(kind) AS ks FROM facts GROUP BY 1)
  SELECT person_id, documents, kept, excluded,
  array_to_string(list_filter([{', '.join(f"'{k}'" for k in KINDS)}], lambda x: NOT list_contains(ks, x)), ',') AS zero_sources FROM g""")
def report_rows(spark, sf_dir):
    return views.report_rows(facts(spark, sf_dir), list(KINDS))


@query(f"""WITH {FACTS} SELECT fact_id, CASE WHEN category = 'non_obvious' AND kind NOT IN {exclusion.NON_OBVIOUS} THEN
  CASE WHEN {sql_pick(CATEGORIES, 'person_id')} = 'non_obvious' THEN 'current_work' ELSE {sql_pick(CATEGORIES, 'person_id')} END ELSE category END AS category FROM facts""")
def category_downgrade(spark, sf_dir):
    return facts(spark, sf_dir).select("fact_id", exclusion.category_for(F.col("category"), _pick(CATEGORIES, F.col("person_id")), F.col("kind")).alias("category"))


@query(f"""SELECT o_orderkey, CASE WHEN DATE '{TODAY}' - CAST(o_orderdate AS DATE) <= 365 THEN 1.0 WHEN DATE '{TODAY}' - CAST(o_orderdate AS DATE) <= 1095 THEN 0.6 ELSE 0.3 END AS recency
  FROM (SELECT o_orderkey, o_orderdate + CAST(o_orderkey % 25 AS INT) * INTERVAL 365 DAY AS o_orderdate FROM orders)""")
def recency_bands(spark, sf_dir):
    day = F.date_add(F.to_date("o_orderdate"), (F.col("o_orderkey") % 25 * 365).cast("int"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.recency(day, F.lit(TODAY).cast("date")).alias("recency"))


@query("SELECT o_orderkey, CAST(o_orderdate AS DATE) AS day FROM orders")
def date_forms(spark, sf_dir):
    """Dates written in one of six forms by order key and read back."""
    t, k = F.col("o_orderdate"), F.col("o_orderkey") % 6
    forms = F.when(k == 0, F.date_format(t, "yyyy-MM-dd")).when(k == 1, F.date_format(t, "yyyyMMddHHmmss")).when(k == 2, F.date_format(t, "yyyy/MM/dd")).when(
        k == 3, F.date_format(t, "d MMM yyyy")).when(k == 4, F.date_format(t, "EEE, dd MMM yyyy HH:mm:ss 'GMT'")).otherwise(F.date_format(t, "yyyy-MM-dd'T'HH:mm:ss'Z'"))
    return table(spark, sf_dir, "orders").select("o_orderkey", N.parse_date(forms).alias("day"))


@query("""WITH r AS (SELECT c_custkey AS ordinal, c_mktsegment AS name, 'Area ' || c_nationkey AS d FROM customer), b AS (SELECT *, lower(name) AS base, row_number() OVER (PARTITION BY name ORDER BY ordinal) AS n FROM r),
  i AS (SELECT *, CASE WHEN n = 1 THEN base ELSE base || '-' || replace(lower(d), ' ', '-') END AS id FROM b), k AS (SELECT *, row_number() OVER (PARTITION BY id ORDER BY ordinal) AS k FROM i)
  SELECT ordinal, CASE WHEN k = 1 THEN id ELSE id || '-' || k END AS person_id FROM k""")
def roster_ids(spark, sf_dir):
    c = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("ordinal"), F.col("c_mktsegment").alias("name"), F.array(F.concat(F.lit("Area "), F.col("c_nationkey").cast("string"))).alias("details"))
    return merging.person_ids(c).select("ordinal", "person_id")


@query("""SELECT doc_id FROM (SELECT doc_id, CASE WHEN doc_id % 5 <> 0 THEN TIMESTAMP '2025-01-01' + CAST(doc_id % 900 AS INT) * INTERVAL 1 SECOND END AS e, text FROM documents)
  WHERE (e IS NULL AND trim(coalesce(text, '')) <> '') OR e > TIMESTAMP '2025-01-01 00:07:30'""")
def cache_ttl(spark, sf_dir):
    from kinweave.sources.tables import live_answers

    i = F.col("doc_id")
    c = table(spark, sf_dir, "documents").select("doc_id", F.col("text").alias("body"), F.when(i % 5 != 0, F.timestamp_seconds(F.lit(1735689600) + i % 900)).alias("expires_at"))
    return live_answers(c, "2025-01-01 00:07:30").select("doc_id")


@query(f"WITH {FACTS} SELECT fact_id, doc_id || '-f' || (row_number() OVER (PARTITION BY person_id, doc_id ORDER BY fact_id) - 1) AS numbered FROM facts")
def fact_numbering(spark, sf_dir):
    from kinweave.operators import evidence

    f = facts(spark, sf_dir).withColumn("own", F.col("fact_id"))
    return evidence.number_facts(f, ["own"]).select(F.col("own").alias("fact_id"), F.col("fact_id").alias("numbered"))


TEXTS = "text AS (SELECT *, 'Works on order ' || fact_id || '.' AS text FROM shown)"
#: Customers with their opening and the facts that fit into thirty words, four words each after the name.
WHO = """who AS (SELECT person_id, fact_id, text, doc_id, confidence, row_number() OVER (PARTITION BY person_id ORDER BY confidence DESC, fact_id) - 1 AS pos FROM text WHERE category = 'current_work' QUALIFY pos < 7),
  line AS (SELECT c_custkey AS person_id, c_name || '. ' || coalesce(l, upper(left(c_mktsegment, 1)) || substr(c_mktsegment, 2) || '.') AS who_line, coalesce(ids, '') AS fact_ids
    FROM customer LEFT JOIN (SELECT person_id, string_agg(text, ' ' ORDER BY pos) AS l, string_agg(fact_id, ',' ORDER BY pos) AS ids FROM who GROUP BY 1) ON person_id = c_custkey)"""


def _people(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"), F.array("c_mktsegment").alias("details"))


def _spoken(f):
    return f.withColumn("text", F.concat(F.lit("Works on order "), "fact_id", F.lit(".")))


@query(f"WITH {FACTS}, {SHOWN}, {TEXTS}, {WHO} SELECT person_id, who_line AS line, fact_ids FROM line")
def who_lines(spark, sf_dir):
    f = _spoken(_judged(spark, sf_dir).where("reason is null"))
    return digest.who_line(_people(spark, sf_dir), f).select("person_id", "line", F.array_join("fact_ids", ",").alias("fact_ids"))


@query(f"""WITH {FACTS}, {SHOWN}, {TEXTS}, {WHO}, rest AS (SELECT * FROM text ANTI JOIN who USING (person_id, fact_id)),
  rare AS (SELECT person_id, max_by(fact_id, (confidence, fact_id)) AS fact_id FROM text WHERE category = 'non_obvious' AND kind IN {exclusion.NON_OBVIOUS} GROUP BY 1),
  pool AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY category <> 'recent_activity', {NEWEST}) AS n FROM rest WHERE published_at IS NOT NULL AND category IN ('recent_activity', 'affiliation', 'hook', 'interest')),
  news AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY {NEWEST}) AS place FROM pool WHERE n <= 3),
  hook AS (SELECT person_id, fact_id, text FROM rest QUALIFY row_number() OVER (PARTITION BY person_id ORDER BY category = 'hook' DESC,
    CASE WHEN category = 'hook' THEN confidence END DESC NULLS LAST, CASE WHEN category = 'hook' THEN fact_id END DESC NULLS LAST, {NEWEST}) = 1),
  say AS (SELECT c_custkey AS person_id, CASE WHEN c_custkey % 3 = 0 THEN 'Ask how the season went.' ELSE coalesce('Ask about this: ' || text, '{digest.OPENER_LAST}') END AS line, CASE WHEN c_custkey % 3 <> 0 THEN fact_id END AS quoted FROM customer LEFT JOIN hook ON person_id = c_custkey),
  pairs AS (SELECT c_custkey AS person_id, c_custkey + i AS other_id, (c_custkey * 7 + i * 31) % 100 AS score, (c_custkey + i) % 3 AS w FROM customer, (SELECT unnest([1, 2, 3, 4, 5]) AS i)),
  top AS (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY score DESC, other_id) AS place FROM pairs QUALIFY place <= 3),
  met AS (SELECT person_id, string_agg(other_id || ':' || score || ':' || CASE w WHEN 0 THEN 'Both connected to Databricks.' WHEN 1 THEN 'Both on Reuters Media Group news.' ELSE '{digest.WHY_LAST}' END, ';' ORDER BY place) AS meet FROM top GROUP BY 1),
  behind AS (SELECT person_id, max(fact_id) AS fact_id FROM facts GROUP BY 1),
  stream AS (SELECT person_id, fact_id, 0 AS section, pos, 0 AS later FROM who UNION ALL SELECT person_id, fact_id, 1, place, 0 FROM news UNION ALL SELECT person_id, fact_id, 2, 0, 0 FROM rare
    UNION ALL SELECT top.person_id, b.fact_id, 3, place, 0 FROM top JOIN behind b ON b.person_id = top.person_id UNION ALL SELECT person_id, quoted, 4, 0, 0 FROM say WHERE quoted IS NOT NULL),
  cite AS (SELECT s.person_id, t.doc_id, min((section, pos, later)) AS m, min_by(fact_id, (-confidence, fact_id)) AS fact_id FROM stream s JOIN text t USING (person_id, fact_id) GROUP BY ALL),
  src AS (SELECT person_id, string_agg(n || ':' || doc_id || ':' || fact_id, ';' ORDER BY n) AS sources FROM (SELECT *, row_number() OVER (PARTITION BY person_id ORDER BY m, doc_id) AS n FROM cite) GROUP BY 1)
  SELECT left(sha1('digest:' || l.person_id), 16) AS digest_id, l.person_id, who_line, coalesce(meet, '') AS meet, coalesce((SELECT string_agg(fact_id, ',' ORDER BY place) FROM news WHERE news.person_id = l.person_id), '') AS lately,
    rare.fact_id AS non_obvious, say.line AS say_out_loud, coalesce(sources, '') AS sources
  FROM line l LEFT JOIN met USING (person_id) LEFT JOIN rare USING (person_id) LEFT JOIN say USING (person_id) LEFT JOIN src USING (person_id)""")
def digest_pages(spark, sf_dir):
    """Digests of all customers: five partners each, of whose reasons some need mending and some cannot be said."""
    people, f = _people(spark, sf_dir), _spoken(facts(spark, sf_dir))
    p, o = F.col("person_id"), F.col("other_id")
    why = _pick(("Both connected to Databricks [1].", "Both on Reuters Media Group (old) news.", "Both at Argues that prices rise."), p + o - p)
    m = people.select("person_id", F.explode(F.array(*(F.col("person_id") + i for i in range(1, 6)))).alias("other_id"))
    m = m.withColumn("score", (p * 7 + (o - p) * 31) % 100).withColumns({"raw": F.col("score") / 100.0, "why": why, "labels": F.array(F.lit("Reuters Media Group"))})
    behind = m.select("person_id", "other_id", F.lit(0).alias("ordinal")).join(f.groupBy("person_id").agg(F.max("fact_id").alias("fact_id")), "person_id")
    a = people.select("person_id", F.when(p % 3 == 0, "Ask how the season went.").when(p % 3 == 1, "We noticed a new order.").alias("line")).where("line is not null")
    d = digest.make_digest(people, f, m, behind, a)
    joined = lambda c, x: F.array_join(F.transform(c, x), ";")
    return d.select("digest_id", "person_id", "who_line", joined("meet", lambda x: F.concat_ws(":", x["other_id"], x["score"], x["why"])).alias("meet"), F.array_join("lately", ",").alias("lately"),
                    "non_obvious", "say_out_loud", joined("sources", lambda x: F.concat_ws(":", x["number"], x["doc_id"], x["fact_id"])).alias("sources"))
