"""Spoken lines, figures and rate limits on small tables."""

from pyspark.sql import functions as F

from kinweave.functions import text as T
from kinweave.operators import digest, views
from kinweave.streaming import presence


def test_separated(spark):
    df = spark.createDataFrame([("f", "a", 0.0, 0.0, 10.0, 10.0, False), ("f", "b", 4.0, 1.0, 10.0, 10.0, False), ("f", "c", 100.0, 0.0, 10.0, 10.0, True), ("f", "d", 97.0, 0.0, 10.0, 10.0, False)], "figure string, node string, x double, y double, width double, height double, fixed boolean")
    at = {r.node: (r.x, r.y) for r in views.separated(df).collect()}
    size = 16 - 1e-6
    assert at["c"] == (100.0, 0.0) and all(abs(at[p][0] - at[q][0]) >= size or abs(at[p][1] - at[q][1]) >= size for p, q in (("a", "b"), ("c", "d")))


SPOKEN = [("Runs a mill.", True), ("Ask about Argues that prices rise.", False), ("Ask about this: Argues that prices rise.", True), ("Both connected to Databricks.", True), ("Works at AI labs on data.", True), ("Scored 67 of all.", False), ("Ranked in 2019 by all.", True), ("It is 67/100 now", False),
          ("see http://x.y", False), ("As said [3].", False), ("A (short) one", False), (" ", False), (None, False), ("w " * 31, False), ("w " * 30, True), ("Joined the Built environment team", False), ("Part of Co-Founded things here", False)]


def test_speakable(spark):
    df = spark.createDataFrame(list(enumerate(t for t, _ in SPOKEN)), "i int, t string")
    got = {r.i: r.v for r in df.select("i", T.is_speakable(F.col("t")).alias("v")).collect()}
    assert {SPOKEN[i]: got[i] for i in got if got[i] != SPOKEN[i][1]} == {}
    fixed = spark.createDataFrame([("Both at Y Combinator (2019) [1] .",), ("See http://a.b scored 67 twice",), ("w " * 40,), ("(x)",)], "t string").select(T.speakable(F.col("t")).alias("s")).collect()
    assert [r.s for r in fixed] == ["Both at Y Combinator.", "See scored twice", " ".join(["w"] * 30) + ".", ""]
    named = spark.createDataFrame([("Both at Reuters Media Group today.", ["Reuters Media Group"]), ("Both at Reuters Media Group today.", ["Other"])], "t string, n array<string>")
    assert [r.v for r in named.select(T.is_speakable(F.col("t"), nouns=F.col("n")).alias("v")).collect()] == [True, False]


def test_rate_limits_over_blocks(spark):
    """Against the bucket itself, request by request, with busy and quiet blocks of time."""
    import random

    r = random.Random(1)
    rows = [("h", r.choice((0.0, 3600.0, 7200.0)) + r.random() * 40, i) for i in range(300)] + [("slow", i * 0.1, i) for i in range(50)]
    rates = spark.createDataFrame([("slow", 0.5)], "host string, rate double")
    got = {(x.host, x.ordinal): x.admitted for x in presence.admitted(spark.createDataFrame(rows, "host string, at double, ordinal long"), rates=rates).collect()}
    for host, rate in (("h", 2.0), ("slow", 0.5)):
        gap, burst, tat = 1 / rate, max(1.0, min(8.0, 2 * rate)), None
        for _, at, i in sorted((x for x in rows if x[0] == host), key=lambda x: (x[1], x[2])):
            when = at if tat is None else max(at, tat - (burst - 1) * gap)
            tat = (when if tat is None else max(tat, when)) + gap
            assert abs(got[host, i] - when) < 1e-6
    assert digest.OPENER.format("x") == "Ask about this: x"
