"""Pairs of people without a shuffle of pairs, and worth that no order of addition changes."""

from pyspark.sql import functions as F

from kinweave.operators import affinity, pairs
from kinweave.plans import catalogue


def graph(spark):
    rows = [(f"p{i % 13:02}", f"h{(i * i + i // 13) % 7}", ("board", "city", "topic")[(i * i + i // 13) % 7 % 3], 0.3 + 0.1 * (i * 5 % 4)) for i in range(80)]
    seen = {}
    for p, h, t, r in rows:
        seen.setdefault((p, h), (p, h, t, affinity.WITHHELD if h == "h2" else h.title(), r))
    e = spark.createDataFrame(sorted(seen.values()), "person_id string, hub_id string, type string, label string, recency double")
    return e, affinity.hub_stats(e, 40)


def plain(df, *columns):
    return sorted((tuple(r[c] for c in columns) for r in df.collect()), key=repr)


def test_blocks_equal_the_joins(spark):
    e, s = graph(spark)
    joined = affinity.ranked_contributions(affinity.contributions(e, s)).withColumn("contribution", F.round("contribution", 6))
    columns = ("person_id", "other_id", "hub_id", "contribution", "place")
    assert plain(pairs.ranked(e, s), *columns) == plain(joined, *columns)
    best = affinity.match_scores(e, s, 40).where("rank <= 3").withColumnRenamed("rank", "place")
    columns = ("person_id", "other_id", "raw", "score", "place")
    assert plain(affinity.best_matches(e, s, 40), *columns) == plain(best, *columns)
    said = affinity.why_and_path(affinity.contributions(e, s)).withColumn("path", F.array_join("path", ">"))
    columns = ("person_id", "other_id", "why", "path")
    got = plain(affinity.pair_reasons(e, s), *columns)
    assert got == plain(said, *columns) and {x[2] == affinity.NOTHING for x in got} == {True, False}


def test_no_pairs_are_shuffled(spark):
    """Joins make no pairs: each side that meets is at most the edges."""
    for name in ("match_top3", "match_contributions", "pair_path_why"):
        plan = catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().optimizedPlan().toString()
        above = plan[:plan.index("MapInArrow")]
        assert not any(x in above for x in ("Join", "Aggregate", "Window", "Repartition", "Sort"))


def test_equal_contributions_tie_in_any_order(spark):
    u, v, w = 2.6955149356245047, 1.67990746161205, 0.7224123253469451
    assert round(u + v + w, 12) != round(w + v + u, 12)
    rows = spark.createDataFrame([("b", u), ("b", v), ("b", w), ("c", w), ("c", v), ("c", u)], "other_id string, contribution double").coalesce(1)
    assert len({r.raw for r in rows.groupBy("other_id").agg(affinity._raw()).collect()}) == 1


def test_moments_meet_stays_in_groups_without_a_sort(spark, monkeypatch):
    """A block's moments are dealt into groups, and the join holds a group instead of sorting and spilling stays."""
    from kinweave.streaming import presence

    monkeypatch.setattr(presence, "GROUP", 3)
    log = spark.createDataFrame([(i % 7, i * 1700 + i % 3 * 40, i, "arrive" if i % 5 else "leave") for i in range(60)], "person_id long, at long, event_id long, kind string").withColumn("ts", F.timestamp_seconds("at")).drop("at")
    moments = spark.createDataFrame([(i, i * 613) for i in range(160)], "moment_id long, s long").select("moment_id", F.timestamp_seconds("s").alias("at"))
    met = presence.present_at(log, moments)
    assert "ShuffledHashJoin" in met._jdf.queryExecution().executedPlan().toString()
    events = sorted((r.person_id, r.ts, r.event_id, r.kind) for r in log.collect())
    want = set()
    for one, after in zip(events, events[1:] + [(None, None, None, None)]):
        until = after[1] if after[0] == one[0] else None
        want |= {(m.moment_id, one[0]) for m in moments.collect() if one[3] == "arrive" and one[1] <= m.at and (until is None or m.at < until)}
    got = [(r.moment_id, r.person_id) for r in met.collect()]
    assert len(got) == len(set(got)) and set(got) == want


def test_prices_meet_balances_without_pairs(spark, tmp_path):
    prices, balances = [5.0, 7.5, 10.0, 10.0, 14.99, 15.0, 400.0, -3.0, None], [0.0, 0.01, 2.5, 5.0, 9.99, 10.0, 10.0, 12.5, 15.0, 19.99, 20.0, 20.01, -2.0, None]
    spark.createDataFrame(list(enumerate(prices)), "p_partkey long, p_retailprice double").write.parquet(f"{tmp_path}/part.parquet")
    spark.createDataFrame(list(enumerate(balances)), "c_custkey long, c_acctbal double").write.parquet(f"{tmp_path}/customer.parquet")
    near = catalogue.queries()["range_join"](spark, str(tmp_path))
    count = lambda p: sum(b is not None and b > 0 and p - 5 <= b <= p + 5 for b in balances)
    want = {i: count(p) for i, p in enumerate(prices) if p is not None and count(p)}
    assert {r.p_partkey: r.near for r in near.collect()} == want
    # customers of one balance are counted before any join
    assert "Aggregate [c_acctbal" in near._jdf.queryExecution().optimizedPlan().toString()


def test_titles_with_other_references(spark, tmp_path):
    import duckdb

    pages = ["<title>a &amp;lt; b &lt;c&gt; &amp</title>", "<title>x &quot;y&quot; &nbsp; &copy z&#39;</title><p>t</p>", "<title>&LT; &ltimes;</title>", "<p>none</p>", None]
    spark.createDataFrame([(i, "u", h) for i, h in enumerate(pages)], "page_id long, url string, html string").coalesce(1).write.parquet(f"{tmp_path}/pages.parquet")
    c = duckdb.connect()
    c.execute(f"create view pages as select * from read_parquet('{tmp_path}/pages.parquet/*.parquet')")
    got = {r.page_id: r.title for r in catalogue.queries()["pages_title"](spark, str(tmp_path)).collect()}
    assert got == dict(c.execute(catalogue.oracle_sql()["pages_title"]).fetchall())
