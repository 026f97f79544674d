"""The bipartite graph of purchases."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.operators import affinity as A
from kinweave.operators import elections, pairs, views
from kinweave.operators.components import connected_components
from kinweave.plans.catalogue import query
from kinweave.plans.events import LOG
from kinweave.plans.fixtures import EDGES, hub_edges, people, table
from kinweave.streaming import presence as P


def _graph(spark, sf_dir):
    e, n = hub_edges(spark, sf_dir), people(spark, sf_dir)
    return e, A.hub_stats(e, n), n


@query("SELECT CAST(json_extract_string(props, '$.k') AS BIGINT) AS hub_id, count(DISTINCT user_id) AS carriers FROM events WHERE event_type = 'purchase' GROUP BY 1")
def hub_carriers(spark, sf_dir):
    return hub_edges(spark, sf_dir).groupBy("hub_id").agg(F.count_distinct("person_id").alias("carriers"))


@query(f"WITH {EDGES} SELECT hub_id, type, carriers, round(idf, 6) AS idf, round(1 / (1 + idf), 6) AS cost, boost FROM stats")
def hub_idf(spark, sf_dir):
    return _graph(spark, sf_dir)[1].select("hub_id", "type", "carriers", F.round("idf", 6).alias("idf"), F.round("cost", 6).alias("cost"), "boost")


@query(f"WITH {EDGES} SELECT person_id, other_id, round(raw, 6) AS raw, score, rank FROM scored")
def match_scores(spark, sf_dir):
    return A.match_scores(*_graph(spark, sf_dir))


@query(f"WITH {EDGES} SELECT person_id, other_id, round(raw, 6) AS raw, score, CAST(rank AS INT) AS place FROM scored WHERE rank <= 3")
def match_top3(spark, sf_dir):
    return A.best_matches(*_graph(spark, sf_dir))


@query(f"""WITH {EDGES} SELECT person_id, other_id, hub_id, round(contribution, 6) AS contribution,
  CAST(row_number() OVER (PARTITION BY person_id, other_id ORDER BY contribution DESC, hub_id) AS INT) AS place FROM contrib""")
def match_contributions(spark, sf_dir):
    e, s, _ = _graph(spark, sf_dir)
    return pairs.ranked(e, s)


@query(f"""WITH {EDGES}, r AS (SELECT *, row_number() OVER (PARTITION BY person_id, other_id ORDER BY contribution DESC, hub_id) AS p FROM contrib),
  c AS (SELECT person_id, other_id, p, hub_id, CASE type WHEN 'investor' THEN 'both backed by ' WHEN 'board' THEN 'both on the board at ' WHEN 'school' THEN 'both came through '
     WHEN 'city' THEN 'both rooted in ' WHEN 'topic' THEN 'both deep in ' WHEN 'technology' THEN 'both building on ' WHEN 'event' THEN 'both regulars at '
     WHEN 'cause' THEN 'both behind ' WHEN 'person' THEN 'both know ' ELSE 'both connected to ' END
     || CASE WHEN type IN ('cause', 'technology', 'topic') THEN 'hub' || substr(label, 4) ELSE label END AS c FROM r WHERE p <= 2),
  g AS (SELECT person_id, other_id, string_agg(c, '; ' ORDER BY p) AS l, min_by(hub_id, p) AS top FROM c GROUP BY ALL)
  SELECT person_id, other_id, 'B' || substr(l, 2) || '.' AS why, 'person:' || person_id || '>hub:' || top || '>person:' || other_id AS path FROM g""")
def pair_path_why(spark, sf_dir):
    e, s, _ = _graph(spark, sf_dir)
    return A.pair_reasons(e, s)


@query("""WITH v AS (SELECT p_brand, split_part(p_name, ' ', 1) AS w, count(*) AS n FROM part GROUP BY ALL)
  SELECT p_brand, w AS elected FROM (SELECT *, row_number() OVER (PARTITION BY p_brand ORDER BY n DESC, w) AS r FROM v) WHERE r = 1""")
def hub_type_election(spark, sf_dir):
    p = table(spark, sf_dir, "part").select("p_brand", F.substring_index("p_name", " ", 1).alias("w"))
    return elections.elect(p, ["p_brand"], "w", "elected")


@query("""WITH v AS (SELECT user_id, event_type, count(*) AS n FROM events GROUP BY ALL), t AS (SELECT *, max(n) OVER (PARTITION BY user_id) AS m FROM v)
  SELECT user_id, CASE WHEN count(*) = 1 THEN min(event_type) END AS elected FROM t WHERE n = m GROUP BY user_id""")
def hub_qid_refusal(spark, sf_dir):
    return elections.unambiguous(table(spark, sf_dir, "events"), ["user_id"], "event_type", out="elected")


@query("""WITH v AS (SELECT c_nationkey, c_mktsegment, max(floor(c_acctbal / 1000)) AS w, count(*) AS n FROM customer GROUP BY ALL),
  t AS (SELECT *, rank() OVER (PARTITION BY c_nationkey ORDER BY w DESC, n DESC) AS r FROM v)
  SELECT c_nationkey, CASE WHEN count(*) = 1 THEN min(c_mktsegment) ELSE '' END AS value FROM t WHERE r = 1 GROUP BY c_nationkey""")
def best_evidenced(spark, sf_dir):
    c = table(spark, sf_dir, "customer").withColumn("w", F.floor(F.col("c_acctbal") / 1000))
    return elections.best_evidenced(c, ["c_nationkey"], "c_mktsegment", "w", "value")


@query("""WITH p AS (SELECT s_nationkey, s_suppkey, CAST(floor(s_acctbal / 2000) AS BIGINT) AS points FROM supplier),
  t AS (SELECT *, max(points) OVER (PARTITION BY s_nationkey) AS m, count(*) OVER (PARTITION BY s_nationkey) AS n FROM p)
  SELECT s_nationkey, CASE WHEN n = 1 OR (count(*) = 1 AND m > 0) THEN min(s_suppkey) END AS chosen FROM t WHERE points = m GROUP BY s_nationkey, m, n""")
def choose_one(spark, sf_dir):
    s = table(spark, sf_dir, "supplier").withColumn("points", F.floor(F.col("s_acctbal") / 2000))
    return elections.choose_one(s, ["s_nationkey"], "s_suppkey", "points")


@query("""WITH c AS (SELECT p_partkey % 97 AS person_id, p_name AS label, CASE WHEN p_partkey % 3 = 0 THEN 'wd:Q' || (p_partkey % 5 + 1) ELSE 'x:' || (p_partkey % 7) END AS stated_id, p_type AS type FROM part),
  k AS (SELECT *, trim(regexp_replace(lower(label), '[^a-z0-9]+', '-', 'g'), '-') AS key FROM c),
  qv AS (SELECT key, stated_id, count(DISTINCT person_id) AS n FROM k WHERE stated_id LIKE 'wd:Q%' GROUP BY ALL), qm AS (SELECT *, max(n) OVER (PARTITION BY key) AS m FROM qv),
  q AS (SELECT key, CASE WHEN count(*) = 1 THEN min(stated_id) END AS id FROM qm WHERE n = m GROUP BY key),
  o AS (SELECT key, stated_id AS id FROM (SELECT key, stated_id, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, stated_id) AS r FROM k WHERE stated_id NOT LIKE 'wd:Q%' GROUP BY key, stated_id) WHERE r = 1),
  t AS (SELECT key, type || ':' || key AS id FROM (SELECT key, type, row_number() OVER (PARTITION BY key ORDER BY count(*) DESC, type) AS r FROM k GROUP BY key, type) WHERE r = 1)
  SELECT DISTINCT k.key, coalesce(q.id, o.id, t.id) AS hub_id FROM k LEFT JOIN q USING (key) LEFT JOIN o USING (key) LEFT JOIN t USING (key)""")
def canonical_hub(spark, sf_dir):
    p, k = table(spark, sf_dir, "part"), F.col("p_partkey")
    claims = p.select((k % 97).alias("person_id"), F.col("p_name").alias("label"), F.col("p_type").alias("type"),
                      F.when(k % 3 == 0, F.concat(F.lit("wd:Q"), (k % 5 + 1).cast("string"))).otherwise(F.concat(F.lit("x:"), (k % 7).cast("string"))).alias("stated_id"))
    return A.canonical_ids(claims)


@query("""WITH l AS (SELECT DISTINCT p_type || ' of ' || p_name AS label FROM part), a AS (SELECT label, upper(left(label, 1) || left(split_part(label, ' ', 3), 1) || left(split_part(label, ' ', 4), 1)) AS a FROM l)
  SELECT a AS short, min(label) AS long FROM a GROUP BY a HAVING count(*) = 1""")
def acronym_fold(spark, sf_dir):
    long = table(spark, sf_dir, "part").select(F.concat_ws(" ", "p_type", F.lit("of"), "p_name").alias("label")).distinct()
    w = F.split("label", " ")
    short = long.select(F.upper(F.concat(F.substring(F.get(w, F.lit(0)), 1, 1), F.substring(F.get(w, F.lit(2)), 1, 1), F.substring(F.get(w, F.lit(3)), 1, 1))).alias("label")).distinct()
    return A.acronym_folds(long.unionByName(short).withColumn("type", F.lit("company"))).select("short", "long")


@query(f"""WITH {EDGES} SELECT person_id, hub_id % 20 AS hub_id, max(recency) AS recency, count(DISTINCT label) AS n_evidence FROM edges GROUP BY 1, 2""")
def one_hub_per_person(spark, sf_dir):
    e = hub_edges(spark, sf_dir).withColumn("evidence", F.array("label")).withColumn("hub_id", F.col("hub_id") % 20)
    return A.one_hub_per_person(e).select("person_id", "hub_id", "recency", F.size("evidence").cast("long").alias("n_evidence"))


@query("""WITH RECURSIVE g AS (SELECT DISTINCT user_id AS a, 1000000 + CAST(json_extract_string(props, '$.k') AS BIGINT) AS b FROM events WHERE event_type = 'signup'),
  s AS (SELECT a AS x, b AS y FROM g UNION SELECT b, a FROM g), r AS (SELECT x, x AS y FROM s UNION SELECT r.x, s.y FROM r JOIN s ON r.y = s.x)
  SELECT x AS node, min(y) AS component FROM r GROUP BY x""")
def components(spark, sf_dir):
    """Components over every signup edge, whatever its value."""
    e = table(spark, sf_dir, "events").where("event_type = 'signup'").select(
        F.col("user_id").alias("a"), (1_000_000 + F.get_json_object("props", "$.k").cast("long")).alias("b"))
    return connected_components(e, "a", "b")


@query(f"WITH {EDGES}, d AS (SELECT person_id, count(DISTINCT hub_id) AS degree FROM edges GROUP BY 1) SELECT degree, count(*) AS people FROM d GROUP BY 1")
def degree_histogram(spark, sf_dir):
    d = hub_edges(spark, sf_dir).groupBy("person_id").agg(F.count_distinct("hub_id").alias("degree"))
    return d.groupBy("degree").agg(F.count("*").alias("people"))


@query(f"WITH {EDGES} SELECT carriers, count(*) AS hubs FROM stats GROUP BY 1")
def carrier_histogram(spark, sf_dir):
    return views.carrier_histogram(_graph(spark, sf_dir)[1])


#: Who is present by the events, and who of them came on the log's last day.
ROOM = f"""{LOG}, here AS (SELECT person_id, ts FROM stay WHERE kind = 'arrive' AND until IS NULL),
  came AS (SELECT person_id FROM here WHERE ts >= (SELECT max(ts) FROM log) - INTERVAL 1 DAY)"""


def _room(spark, sf_dir):
    log = P.presence_log(table(spark, sf_dir, "events"))
    here = P.present_now(log)
    end = F.broadcast(log.agg((F.max("ts") - F.expr("interval 1 day")).alias("day")))  # one row
    return here, here.join(end).where("since >= day").select("person_id")


@query(f"""WITH {EDGES}, {ROOM}, h AS (SELECT hub_id, count(DISTINCT person_id) AS here FROM edges SEMI JOIN here USING (person_id) GROUP BY 1)
  SELECT h.hub_id, h.here, h.here >= 2 AS shared, carriers, round(idf * boost, 6) AS worth FROM h JOIN stats USING (hub_id)""")
def presence_hubs(spark, sf_dir):
    e, s, _ = _graph(spark, sf_dir)
    return A.presence_hubs(e, s, _room(spark, sf_dir)[0])


@query(f"""WITH {EDGES}, {ROOM}, h AS (SELECT hub_id, count(DISTINCT person_id) AS n FROM edges SEMI JOIN here USING (person_id) GROUP BY 1)
  SELECT CASE WHEN p = 0 THEN 'empty' WHEN p = 1 THEN 'alone' WHEN shared = 0 THEN 'strangers' ELSE 'connected' END AS state, p AS people, shared, solo
  FROM (SELECT count(*) AS p FROM here), (SELECT count(*) FILTER (n >= 2) AS shared, count(*) FILTER (n < 2) AS solo FROM h)""")
def presence_state(spark, sf_dir):
    e, s, _ = _graph(spark, sf_dir)
    here = _room(spark, sf_dir)[0]
    return views.presence_state(here, A.presence_hubs(e, s, here))


@query(f"""WITH {EDGES}, {ROOM} SELECT h.person_id, coalesce(c_name, CAST(h.person_id AS VARCHAR)) AS name, h.person_id IN (SELECT person_id FROM edges) AS in_graph FROM here h LEFT JOIN customer ON c_custkey = h.person_id""")
def present_roster(spark, sf_dir):
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return views.present_roster(_room(spark, sf_dir)[0].select("person_id"), people, hub_edges(spark, sf_dir))


@query(f"""WITH {EDGES}, {ROOM}, x AS (SELECT a.person_id, p.person_id AS other_id FROM came a, here p WHERE a.person_id <> p.person_id), y AS (SELECT x.*, coalesce(q.raw, 0) AS raw FROM x LEFT JOIN pairs q USING (person_id, other_id))
  SELECT person_id, other_id, round(raw, 6) AS raw, CAST(CASE WHEN raw <= 0 THEN 0 ELSE least(100, greatest(0, round_even(100 * raw / (ln(n / 3) * 1.5), 0))) END AS INT) AS score,
    CAST(row_number() OVER (PARTITION BY person_id ORDER BY raw DESC, other_id) AS INT) AS rank FROM y, people""")
def match_present(spark, sf_dir):
    """Those who came on the last day of the log, matched with everyone present."""
    e, s, n = _graph(spark, sf_dir)
    here, came = _room(spark, sf_dir)
    return A.match_present(came, here, e, s, n)


@query(f"""WITH {EDGES}, {ROOM}, x AS (SELECT a.person_id, p.person_id AS other_id FROM came a, here p WHERE a.person_id <> p.person_id), y AS (SELECT x.*, coalesce(q.raw, 0) AS raw FROM x LEFT JOIN pairs q USING (person_id, other_id))
  SELECT person_id, other_id, CAST(row_number() OVER (PARTITION BY person_id ORDER BY raw DESC, other_id) AS INT) AS rank FROM y""")
def arrivals_matched(spark, sf_dir):
    """The same answer as a batch of arrivals meets it: the log's last day after all days before."""
    from kinweave.streaming.arrivals import matches_on_arrival

    e, s, n = _graph(spark, sf_dir)
    log = P.presence_log(table(spark, sf_dir, "events"))
    end = F.broadcast(log.agg((F.max("ts") - F.expr("interval 1 day")).alias("day")))  # one row
    day = log.join(end)
    roster = table(spark, sf_dir, "events").select(F.col("user_id").alias("person_id")).distinct()
    return matches_on_arrival(day.where("ts >= day").drop("day"), day.where("ts < day").drop("day"), roster, e, s, n).select("person_id", "other_id", "rank")


@query(f"WITH {EDGES} SELECT type, count(*) AS count, max(boost)::DOUBLE AS type_boost FROM stats GROUP BY 1")
def type_rows(spark, sf_dir):
    return views.type_rows(_graph(spark, sf_dir)[1])


@query(f"""WITH {EDGES}, e AS (SELECT DISTINCT person_id, hub_id FROM edges), g AS (SELECT person_id, count(*) AS n_hubs, count(*) FILTER (carriers >= 2) AS n_shared,
    string_agg(CAST(hub_id AS VARCHAR), ',' ORDER BY idf * boost DESC, lower(label), hub_id) AS hubs FROM e JOIN stats USING (hub_id) GROUP BY 1)
  SELECT c_custkey AS person_id, coalesce(n_hubs, 0) AS n_hubs, coalesce(n_shared, 0) AS n_shared, hubs FROM customer LEFT JOIN g ON person_id = c_custkey""")
def corpus_view(spark, sf_dir):
    e, s, _ = _graph(spark, sf_dir)
    people = table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), F.col("c_name").alias("name"))
    return views.corpus_view(people, e, s).select("person_id", "n_hubs", "n_shared", F.array_join("hubs", ",").alias("hubs"))


@query(f"""WITH {EDGES}, f AS (SELECT DISTINCT user_id AS person_id, CAST(json_extract_string(props, '$.k') AS BIGINT) AS hub_id FROM events WHERE event_type = 'click'),
  p AS (SELECT e.person_id, e.hub_id, f.hub_id IS NULL AS bare, e.hub_ordinal % 2 = 0 AS shown FROM edges e LEFT JOIN f USING (person_id, hub_id))
  SELECT hub_id, bool_or(bare OR shown) AS nameable FROM p GROUP BY 1""")
def nameable_hubs(spark, sf_dir):
    e = hub_edges(spark, sf_dir).withColumn("evidence", F.array(F.col("hub_id").cast("string")))
    clicks = table(spark, sf_dir, "events").where("event_type = 'click'").select(F.col("user_id").alias("person_id"), F.get_json_object("props", "$.k").alias("fact_id")).distinct()
    own = e.select("person_id", F.col("hub_id").cast("string").alias("fact_id"), (F.col("hub_ordinal") % 2 == 0).alias("displayable"))
    return A.nameable_hubs(e, clicks.join(own, ["person_id", "fact_id"]))


@query(f"""WITH {EDGES}, w AS (SELECT hub_id, round(idf * boost, 6) AS worth FROM stats), r AS (SELECT hub_id, row_number() OVER (ORDER BY worth DESC, hub_id) - 1 AS r, count(*) OVER () AS n FROM w)
  SELECT hub_id, round(100 * cos(2 * pi() * r / n), 4) + 0.0 AS x, round(100 * sin(2 * pi() * r / n), 4) + 0.0 AS y FROM r""")
def graph_ring(spark, sf_dir):
    s = _graph(spark, sf_dir)[1]
    return views.ring(s.select("hub_id", F.round(F.col("idf") * F.col("boost"), 6).alias("worth"))).select("hub_id", (F.col("x") + 0.0).alias("x"), (F.col("y") + 0.0).alias("y"))
