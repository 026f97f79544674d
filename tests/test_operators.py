"""Operators on small tables, and that row order and partitions do not matter."""

import math

import pytest
from pyspark.sql import functions as F

from kinweave.operators import affinity, digest, elections, evidence, exclusion, identity, merging
from kinweave.streaming import presence

EDGE = "person_id string, hub_id string, type string, label string, recency double, hub_ordinal long, evidence array<string>"


def edges(spark, rows):
    return spark.createDataFrame([(p, h, t, h.title(), r, i, []) for i, (p, h, t, r) in enumerate(rows)], EDGE)


def scores(spark, rows, people):
    e = edges(spark, rows)
    return {(r.person_id, r.other_id): (r.raw, r.score) for r in affinity.match_scores(e, affinity.hub_stats(e, people), people).collect()}


def test_golden_scores(spark):
    four = [(p, h, t, 1.0) for p in "abcd" for h, t in (("town", "city"), ("craft", "topic"))] + [("c", "fund", "investor", 1.0), ("d", "fund", "investor", 1.0)]
    got = scores(spark, four, 4)
    assert got["c", "d"] == (round(math.log(4 / 3) * 1.5, 6), 100) and ("a", "b") not in got
    ten = [("a", "fund", "investor", 1.0), ("b", "fund", "investor", 1.0), ("a", "x", "topic", 1.0), ("c", "x", "topic", 0.6)]
    got = scores(spark, ten, 10)
    assert got["a", "b"] == (1.805959, 100) and got["a", "c"] == (0.722384, 40)
    six = [(p, "A", "investor", 1.0) for p in "abcd"] + [(p, "B", "company", 1.0) for p in "bcdef"]
    got = scores(spark, six, 6)
    assert got["b", "a"] == (0.273482, 26) and ("b", "e") not in got
    assert all(not scores(spark, [("a", "h", "board", 1.0), ("b", "h", "board", 1.0)], n) for n in (2, 3))


@pytest.mark.parametrize("seed", range(4))
def test_order_does_not_matter(spark, seed):
    rows = [(f"p{i % 7}", f"h{i % 5}", ("board", "city", "topic")[i % 3], 0.3 + 0.1 * (i % 4)) for i in range(60)]
    e = edges(spark, rows)
    shuffled = e.orderBy(F.rand(seed)).repartition(1 + seed)
    key = lambda df: sorted(map(str, df.collect()))
    for f in (affinity.one_hub_per_person, lambda x: affinity.hub_stats(x, 9), lambda x: affinity.why_and_path(affinity.contributions(affinity.one_hub_per_person(x).join(x.select("hub_id", "type", "label").groupBy("hub_id").agg(F.min("type").alias("type"), F.min("label").alias("label")), "hub_id"), affinity.hub_stats(x, 9)))):
        assert key(f(e)) == key(f(shuffled))


def test_why_names_two_hubs(spark):
    rows = spark.createDataFrame([("a", "b", "f", "investor", "Tall Fund", 2.0), ("a", "b", "t", "topic", "Ocean cleanup", 1.0), ("a", "b", "c", "city", "Oslo", 0.5), ("a", "z", "w", "city", affinity.WITHHELD, 1.0)],
                                 "person_id string, other_id string, hub_id string, type string, label string, contribution double")
    got = {r.other_id: r for r in affinity.why_and_path(rows).collect()}
    assert got["b"].why == "Both backed by Tall Fund; both deep in ocean cleanup." and got["b"].path == ["person:a", "hub:f", "person:b"]
    assert got["z"].why == affinity.NOTHING and got["z"].path == []


def test_elections(spark):
    v = spark.createDataFrame([(1, "b"), (1, "a"), (1, None), (2, "x"), (2, "x"), (2, "y")], "k int, v string")
    assert {r.k: r.v for r in elections.elect(v, ["k"], "v").collect()} == {1: "a", 2: "x"}
    assert {r.k: r.v for r in elections.unambiguous(v, ["k"], "v").collect()} == {1: None, 2: "x"}
    w = spark.createDataFrame([(1, "a", 2), (1, "b", 2), (2, "a", 1), (2, "b", 3)], "k int, v string, w int")
    assert {r.k: r.v for r in elections.best_evidenced(w, ["k"], "v", "w").collect()} == {1: "", 2: "b"}
    assert {r.k: r.chosen for r in elections.choose_one(w, ["k"], "v", "w").collect()} == {1: None, 2: "b"}


def test_canonical_ids(spark):
    c = spark.createDataFrame([("p1", "wd:Q1", "company", "Kiln Co"), ("p2", "wd:Q2", "company", "Kiln co"), ("p3", "x:k", "company", "Kiln Co"), ("p1", "wd:Q9", "school", "Royal Pottery College"), ("p2", "y", "school", "RPC")],
                              "person_id string, stated_id string, type string, label string")
    got = {r.key: r.hub_id for r in affinity.canonical_ids(c).collect()}
    assert got["kiln-co"] == "x:k" and got["royal-pottery-college"] == "wd:Q9" == got["rpc"]


def test_components(spark):
    e = spark.createDataFrame([(1, 2), (3, 2), (9, 8), (5, 5)] + [(i, i + 1) for i in range(20, 60)], "a long, b long")
    got = {r.node: r.component for r in affinity.components(e, "a", "b").collect()}
    assert got[3] == 1 and got[9] == 8 and got[5] == 5 and {got[i] for i in range(20, 61)} == {20}


def test_interleave_and_captures(spark):
    d = spark.createDataFrame([("p", f"d{x}", s, o) for s, o, x in ((0, 0, 1), (0, 1, 2), (1, 0, 1), (1, 1, 3), (2, 0, 4))], "person_id string, doc_id string, source_rank int, ordinal int")
    got = merging.interleave(d, most=3).orderBy("slot").collect()
    assert [(r.doc_id, r.source_rank) for r in got] == [("d1", 0), ("d4", 2), ("d2", 0)]
    c = spark.createDataFrame([(0, "x", "404", "1"), (1, "", "200", "2"), (2, "x", "200", "1"), (3, "", "200", "2"), (4, "x", "200", "1")], "ordinal long, digest string, status string, stamp string")
    assert [(r.slot, r.ordinal) for r in merging.best_capture(c).orderBy("slot").collect()] == [(0, 2), (1, 1), (3, 3)]
    roster = spark.createDataFrame([(0, "Mo Li", ["Oslo"]), (1, "mo li", ["Oslo"]), (2, " ", []), (3, "Mo Li", ["Oslo"]), (4, "Mo  Li", [])], "ordinal int, name string, details array<string>")
    assert [r.person_id for r in merging.person_ids(roster).orderBy("ordinal").collect()] == ["mo-li", "mo-li-oslo", "mo-li-oslo-2", "mo-li-2"]


CASES = [
    ("They were diagnosed with asthma.", "exclude", "health"), ("The team builds surgery robots.", "keep", None), ("He is divorced.", "exclude", "family"), ("She runs a family office.", "keep", None),
    ("Reportedly moving north.", "unsure", None), ("A lawsuit followed.", "unsure", "legal"), ("Her net worth grew.", "exclude", "wealth"), ("Ran an ad campaign.", "keep", None), ("", "keep", None), (None, "keep", None),
    ("Founded a chemotherapy device company.", "keep", None), ("Had chemotherapy, then founded a device company.", "exclude", "health")]


@pytest.mark.parametrize("text, decision, reason", CASES)
def test_rules(spark, text, decision, reason):
    r = spark.createDataFrame([(text,)], "t string").select(exclusion.rule_verdict(F.col("t")).alias("v")).first().v
    assert (r.decision, r.reason) == (decision, reason)


def test_rulings_fail_closed(spark):
    f = spark.createDataFrame([(0, "a", "A lawsuit followed."), (0, "b", "A lawsuit followed."), (0, "c", "A lawsuit followed."), (0, "c", "x"), (0, "d", "He is divorced.")], "batch_no int, fact_id string, text string")
    r = spark.createDataFrame([(0, "a", "keep"), (0, "a", "keep"), (0, "b", "keep"), (0, "b", "legal"), (0, "c", "keep"), (0, "d", "keep")], "batch_no int, fact_id string, verdict string")
    got = {(x.fact_id, x.text): (x.excluded, x.exclusion_reason) for x in exclusion.apply_rulings(f, r).collect()}
    assert got["a", "A lawsuit followed."] == (False, None) and got["b", "A lawsuit followed."] == (True, "low_confidence")
    assert got["c", "A lawsuit followed."][0] and got["d", "He is divorced."] == (True, "family")


def test_resolution(spark):
    v = spark.createDataFrame([("two", 0, "d1", "yes", 0.8, ["employer"]), ("two", 1, "d2", "yes", 0.9, ["city"]), ("same", 0, "d1", "yes", 0.8, ["city"]), ("same", 1, "d2", "yes", 0.8, ["city"]), ("key", 0, "d1", "yes", 0.7, []), ("none", 0, "d1", "no", 0.9, [])],
                              "person_id string, doc_ordinal int, doc_id string, match string, confidence double, attributes array<string>")
    keys = spark.createDataFrame([("key", "github")], "person_id string, key string")
    got = {r.person_id: (r.status, r.accepted_doc_ids, r.confidence) for r in identity.resolve(v, keys).collect()}
    assert got == {"two": ("resolved", ["d1", "d2"], 0.9), "same": ("unresolved", [], 0.0), "key": ("resolved", ["d1"], 0.7), "none": ("unresolved", [], 0.0)}
    d = spark.createDataFrame([("p", "d1", "lives in Oslo"), ("p", "d2", "x"), ("p", "d3", "y")], "person_id string, doc_id string, text string")
    a = spark.createDataFrame([("p", "d1", "yes", 1.5, "Lives in  oslo", "home town"), ("p", "d2", "yes", 0.9, "not there", "job")], "person_id string, doc_id string, match string, confidence double, evidence string, disambiguator string")
    got = {r.doc_id: (r.match, r.confidence) for r in identity.police_verdicts(d, a).collect()}
    assert got == {"d1": ("yes", 1.0), "d2": ("unsure", 0.9), "d3": ("unsure", 0.0)}
    assert [r.f for r in spark.createDataFrame([("Job title",), ("Home town",), ("shoe size",), (None,)], "t string").select(identity.attribute_family(F.col("t")).alias("f")).collect()] == ["role", "city", "shoe size", ""]


def test_facts_are_cited_and_numbered(spark):
    docs = spark.createDataFrame([("p", 0, "d1", "She built the first kiln in town."), ("p", 0, "d2", "Others built the first kiln in town, too.")], "person_id string, batch_no int, doc_id string, text string")
    c = [("p", 0, 0, "d1", "Built a kiln.", "built the first kiln", "hook", 0.9), ("p", 0, 1, "d9", "Built a kiln.", "built the first kiln", "hook", 0.9), ("p", 0, 2, "d9", "Alone?", "She built the first kiln", "hook", 0.9),
         ("p", 0, 3, "d1", "x" * 201, "built the first kiln", "hook", 0.9), ("p", 0, 4, "d1", "No quote.", "never said anywhere here", "hook", 0.9), ("p", 0, 5, "d1", " ", "built the first kiln", "hook", 0.9)]
    cand = spark.createDataFrame(c, "person_id string, batch_no int, cand_ordinal int, doc_id string, text string, quote string, category string, confidence double")
    assert sorted((r.cand_ordinal, r.fact_id) for r in evidence.collect_facts(cand, docs).collect()) == [(0, "d1-f0"), (2, "d1-f1")]
    n = evidence.drop_counters(cand).first()
    assert (n.seen, n.blank_text, n.too_long) == (6, 1, 1)


def test_who_line_skips_what_does_not_fit(spark):
    people = spark.createDataFrame([("p", "Mo Li.", ["potter, Oslo"]), ("q", "Al", ["potter, Oslo."]), ("r", "Bo", [])], "person_id string, name string, details array<string>")
    f = [("p", "f1", "current_work", 0.9, "Makes " + "very " * 24 + "big bowls."), ("p", "f2", "current_work", 0.8, "Teaches five whole classes."), ("p", "f3", "current_work", 0.7, "Sings.")]
    facts = spark.createDataFrame(f, "person_id string, fact_id string, category string, confidence double, text string")
    got = {r.person_id: (r.line, r.fact_ids) for r in digest.who_line(people, facts).collect()}
    assert got["p"][1] == ["f1", "f3"] and got["p"][0].startswith("Mo Li. Makes") and got["q"][0] == "Al. Potter, Oslo." and got["r"][0] == "Bo."


def test_presence_stream_equals_batch(spark, tmp_path):
    log = presence.presence_log(spark.read.parquet("/root/testdata/sf0.001/events.parquet").withColumn("ts", F.col("ts").cast("timestamp")))
    log.repartition(4).write.parquet(str(tmp_path / "in"))
    stream = spark.readStream.schema(log.schema).option("maxFilesPerTrigger", 1).parquet(str(tmp_path / "in"))
    q = presence.present_stream(stream).writeStream.outputMode("update").format("memory").queryName("presence").option("checkpointLocation", str(tmp_path / "cp")).trigger(availableNow=True).start()
    q.awaitTermination(120)
    last = spark.table("presence").groupBy("person_id").agg(F.max_by(F.struct("kind", "event_id"), F.struct("since", "event_id")).alias("x")).where("x.kind = 'arrive'")
    assert {(r.person_id, r.x.event_id) for r in last.collect()} == {(r.person_id, r.event_id) for r in presence.present_now(log).collect()}


def test_rate_limiter(spark):
    r = spark.createDataFrame([("h", 0.0, i) for i in range(6)] + [("g", 5.0, 0)], "host string, at double, ordinal long")
    got = [x.admitted for x in presence.admitted(r, 2.0).where("host = 'h'").orderBy("ordinal").collect()]
    assert got == [0.0, 0.0, 0.0, 0.0, 0.5, 1.0]


def test_plans(spark):
    from kinweave.plans import catalogue

    q = catalogue.queries()
    sf = "/root/testdata/sf0.001"
    plan = lambda n: q[n](spark, sf)._jdf.queryExecution().toString()
    assert "PushedFilters: [IsNotNull(l_shipdate)" in plan("pricing_summary") and "ReadSchema" in plan("pricing_summary")
    assert "WindowGroupLimit" in plan("source_budget")
    assert "CartesianProduct" not in plan("range_join") + plan("citation_guard") + plan("presence_asof") and "BroadcastNestedLoopJoin" not in plan("range_join") + plan("citation_guard")
    assert "Python" not in plan("taste_rules") + plan("doc_slug") + plan("match_scores")


def test_rules_read_words_as_other_engines_do(spark):
    """A letter beyond ASCII bounds a word, a vertical tab is no white space, and a cue may arise once a noun of work is gone."""
    import duckdb

    texts = ["ésued them", "he was sued\x0bover it", "él married a painter", "married \x0b to a", "seven-fiſure", "net~ worth", "her divorce app wife and mortgageé", "bought a family business house",
             "is married real estate to a judge", "their medical software daughter", "fiancé", "his fiancÉ", None, "", "no cue"]
    decision, reason = exclusion.verdict_sql("t")
    c = duckdb.connect()
    want = [c.execute(f"select {decision}, {reason} from (select ?::varchar as t)", [t]).fetchall()[0] for t in texts]
    df = spark.createDataFrame(list(enumerate(texts)), "i long, t string").select("i", exclusion.rule_verdict(F.col("t")).alias("v"))
    assert [(r.v.decision, r.v.reason) for r in sorted(df.collect())] == want
    assert want[0][0] == "exclude" and want[8] == ("exclude", "family")


def test_rules_over_one_split_are_dealt_out(spark):
    """A costly pattern over a small file is no single task's work."""
    from kinweave.plans import catalogue

    for name in ("taste_rules", "quote_screen", "taste_applied"):
        assert "REPARTITION_BY_COL" in catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().toString()
