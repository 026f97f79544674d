"""Requests, view models, lookups, decoding and arrivals on invented rows."""

import datetime as dt

from pyspark.sql import functions as F

from kinweave.functions import markup, numbers
from kinweave.operators import affinity, requests, views
from kinweave.streaming import arrivals


def test_answers(spark):
    req = spark.createDataFrame([(i,) for i in range(6)], "request_id long")
    res = spark.createDataFrame([(0, 1, '{"m": "yes"}', False), (1, 1, "so: yes", False), (1, 2, '```json\n{"m": "no"}\n```', False), (2, 1, None, True), (2, 2, '{"m": "yes"}', False), (3, 1, "x", False), (3, 2, "y", False), (3, 3, '{"m": "late"}', False), (5, 1, "[1]", False)],
                                "request_id long, attempt int, text string, refused boolean")
    got = {r.request_id: (r.answer and r.answer.m, r.failed, r.attempts) for r in requests.answers(req, res, "m string").collect()}
    assert got == {0: ("yes", False, 1), 1: ("no", False, 2), 2: (None, True, 2), 3: (None, True, 2), 4: (None, True, 0), 5: (None, True, 1)}


def test_budget_prompts_and_keys(spark):
    r = requests.budgeted(spark.createDataFrame([("a", i) for i in range(5)], "person_id string, call_ordinal int"), 3).withColumn("failed", F.col("call_ordinal") == 1)
    assert requests.counters(r).collect()[0].asDict() == {"person_id": "a", "calls": 3, "refused_by_budget": 2, "errors": 1}
    df = spark.createDataFrame([("u", None, None, {}, "verdict"), ("u", "post", "{}", {"B": "1", "a": "2"}, "new"), ("u", "POST", "{}", {"a": "2", "b": "1"}, "opener")], "u string, m string, b string, h map<string,string>, s string")
    got = df.select(requests.request_key(df.u, df.m, df.b, df.h).alias("k"), requests.tier(df.s).alias("t")).collect()
    assert got[0] == ("u", "fast") and got[1].k == got[2].k and got[1].k.startswith("POST u {} h=") and len(got[1].k) == len("POST u {} h=") + 16 and got[1].t == "strong"
    p = spark.createDataFrame([("Ann", [], "d1", "x" * 9000)], "n string, d array<string>, i string, t string").select(requests.verdict_prompt(F.col("n"), F.col("d"), F.col("i"), F.col("t")).alias("p")).collect()[0].p
    assert "- nothing else" in p and "[cut]" in p and p.count("x") == 8000


def test_views(spark):
    people = spark.createDataFrame([("ann-lee", "Ann Lee", 0), ("ann-lee-2", "Ann Lee", 1), ("bob", "Bob Ray", 2)], "person_id string, name string, ordinal int")
    tokens = spark.createDataFrame([("bob",), (" Bob Ray ",), ("BOB-RAY",), ("Ann Lee",), ("ann-lee",), ("nobody",), ("",)], "token string")
    assert {r.token: r.person_id for r in views.lookup(people, tokens).collect()} == {"bob": "bob", " Bob Ray ": "bob", "BOB-RAY": "bob", "Ann Lee": "ann-lee-2", "ann-lee": "ann-lee-2", "nobody": None, "": None}
    assert [views.selected(people, x).count() for x in (None, " ", "bob", "Ann Lee", "x")] == [3, 0, 1, 2, 0]
    claims = spark.createDataFrame([(1, 0, "Who", "", "f1", "d1", True), (1, 1, "Meet", "Bob", "f1", "d1", True), (1, 2, "Meet", "Cy", "f1", "d1", True), (1, 3, "Meet", "Bob", "f1", "d1", True), (1, 4, "Lately", "", "f2", "d1", True), (1, 5, "Lately", "", "f3", "d2", False), (1, 6, "Lately", "", "f4", "d9", True)],
                                   "digest_id int, claim_ordinal int, section string, detail string, fact_id string, doc_id string, displayable boolean")
    sources = spark.createDataFrame([(1, "d1", 1), (1, "d2", 2)], "digest_id int, doc_id string, number int")
    got = [tuple(r) for r in views.source_evidence(claims, sources).orderBy("position").collect()]
    assert got == [(1, 1, "f1", 1, "Who, Meet", "Who; Meet: Bob, Cy"), (1, 1, "f2", 2, "Lately", "Lately")]
    rows = spark.createDataFrame([("a", True, "resolved", 0.5, 1, 2, 3, ["hn"], None), (None, None, None, None, None, None, None, [], [])], "person_id string, skipped boolean, status string, confidence double, facts_kept int, facts_excluded int, hubs int, zero_sources array<string>, failed_sources array<string>")
    cells = [tuple(r) for r in views.report_cells(rows).collect()]
    assert cells[0] == ("a (skipped)", "resolved", "0.50", "1", "2", "3", "hn", "-") and cells[1] == ("?", "?", "?", "?", "?", "?", "-", "-")
    hubs = spark.createDataFrame([("h1", 0, "a"), ("h1", 0, "b"), ("h2", 1, "a"), ("h2", 1, "b"), ("h3", 2, "a")], "hub_id string, ordinal int, person_id string")
    places = spark.createDataFrame([("a", 0.0, 0.0), ("b", 10.0, 0.0)], "person_id string, x double, y double")
    assert {r.hub_id: (r.dx, r.dy) for r in views.fan(hubs, places, 10.0).collect()} == {"h1": (0.0, 5.0), "h2": (0.0, -5.0)}
    shown = spark.createDataFrame([(0.5, dt.date(2024, 1, 2)), (1.5, None)], "v double, d date").select(numbers.shown_number(F.col("v")), numbers.shown_score(F.col("v")), numbers.shown_day(F.col("d"))).collect()
    assert [tuple(r) for r in shown] == [("0.5000", "0", "2024-01-02"), ("1.5000", "2", "undated")]


def test_decoding():
    d = markup.decoded
    assert d("é".encode()) == "é" and d("é".encode("cp1252") + b" plain words") == "é plain words" and d("é".encode("utf-16")) == "é" and d(b"\xef\xbb\xbfx") == "x" and d(None) == ""
    assert d('<meta charset="iso-8859-7">α'.encode("iso-8859-7")).endswith("α") and d("ж".encode("koi8-r"), "koi8-r") == "ж" and d(b"\xff\xfe\xfd" * 50, "nonsense") and "�" in d(bytes(range(128, 256)))


def test_arrivals(spark, tmp_path):
    day = lambda n: dt.datetime(2024, 1, n)
    schema = "person_id string, ts timestamp, event_id long, kind string"
    edges = spark.createDataFrame([(p, "h", "board", "H", 1.0, i, []) for i, p in enumerate("ab")] + [("c", "k", "topic", "K", 1.0, 2, [])], "person_id string, hub_id string, type string, label string, recency double, hub_ordinal long, evidence array<string>")
    stats, roster = affinity.hub_stats(edges, 9), spark.createDataFrame([(p,) for p in "abc"], "person_id string")
    src = str(tmp_path / "log")
    for i, rows in enumerate([[("a", day(1), 1, "arrive"), ("x", day(1), 2, "arrive")], [("b", day(2), 3, "arrive"), ("c", day(2), 4, "arrive"), ("c", day(3), 5, "leave")]]):
        spark.createDataFrame(rows, schema).coalesce(1).write.mode("append").parquet(src)
    out = {}
    stream = spark.readStream.schema(schema).option("maxFilesPerTrigger", 1).parquet(src)
    arrivals.on_arrival(stream, str(tmp_path / "seen"), roster, edges, stats, 9, lambda df, n: out.__setitem__(n, [(r.person_id, r.other_id, r.raw > 0) for r in df.collect()]), str(tmp_path / "cp")).awaitTermination()
    assert sorted(x for rows in out.values() for x in rows) in ([("b", "a", True)], [("a", "b", True)])


def test_digest_judges_once(spark):
    """Facts are judged once and cut off, not once for every section; speech is looked at for the best partners only."""
    from pyspark.sql import functions as F

    from kinweave.operators import digest

    people = spark.createDataFrame([(1, "Ann Lee", ["WEAVER"])], "person_id long, name string, details array<string>")
    fact = "person_id long, fact_id string, doc_id string, text string, category string, kind string, confidence double, published_at date, excluded boolean"
    facts = spark.createDataFrame([(1, "f1", "d1", "Weaves linen.", "current_work", "github", 0.9, None, False), (1, "f2", "d2", "Weaves after a diagnosis of cancer.", "current_work", "github", 0.95, None, False),
                                   (1, "f3", "d3", None, "hook", "github", 0.9, None, False)], fact)
    matches = spark.createDataFrame([(1, i, i / 10, i, "Both on linen [1].", ["linen"]) for i in range(2, 8)], "person_id long, other_id long, raw double, score int, why string, labels array<string>")
    behind = matches.select("person_id", "other_id", F.lit(0).alias("ordinal"), F.lit("f1").alias("fact_id"))
    d = digest.make_digest(people, facts, matches, behind, people.select("person_id", F.lit("Ask about looms.").alias("line")))
    assert "psychiatric" not in d._jdf.queryExecution().optimizedPlan().toString()
    r = d.first()
    assert r.who_line == "Ann Lee. Weaves linen." and [(m.other_id, m.why) for m in r.meet] == [(7, "Both on linen."), (6, "Both on linen."), (5, "Both on linen.")] and [s.fact_id for s in r.sources] == ["f1"]
