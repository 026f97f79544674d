"""Text, number and markup functions on small inputs."""

import datetime

import pytest
from pyspark.sql import functions as F

from kinweave.functions import markup
from kinweave.functions import numbers as N
from kinweave.functions import text as T
from kinweave.plans import documents


def one(spark, column, **values):
    row = [tuple(values.values())]
    kinds = ", ".join(f"{k} {'array<string>' if isinstance(v, list) else 'double' if isinstance(v, float) else 'long' if isinstance(v, int) else 'date' if isinstance(v, datetime.date) else 'string'}" for k, v in values.items())
    return spark.createDataFrame(row, kinds or "x int").select(column.alias("r")).first().r


@pytest.mark.parametrize("text, want", [
    ("Anne O'Hara-Ruiz", "anne-ohara-ruiz"), ("  Harbour Seed 2019  ", "harbour-seed-2019"), ("Zoë Ångström Ñu", "zoe-angstrom-nu"), ("", ""), ("---", ""),
    ("ﬁne ½ cup", "fine-1-2-cup"), ("Straße", "stra-e"), ("é", "e"), (None, None), ("D’Arcy ʼn", "darcy-n")])
def test_slug(spark, text, want):
    assert one(spark, T.slug(F.col("t")), t=text) == want


def test_normalize_and_ids(spark):
    assert one(spark, T.normalize_ws(F.col("t")), t="  A   b\nStraße ") == "a b strasse"
    assert one(spark, T.doc_id(F.col("t")), t="https://example.com/") == "b559c7edd3fb6737"
    assert one(spark, T.cites_document(F.col("a"), F.col("b")), a="Two  WORDS", b="has two words") is True
    assert one(spark, T.cites_document(F.col("a"), F.col("b")), a=" ", b="x") is False


@pytest.mark.parametrize("quote, text, want", [
    ("built the first kiln", "She built  the\nfirst kiln, alone.", "built  the\nfirst kiln"), ("the first kiln", "the first kilns of all", None), ("too short", "this is too short", None),
    ("it’s a long “quote”", 'so it\'s a long "quote" here', 'it\'s a long "quote"'), (None, "x", None)])
def test_citations(spark, quote, text, want):
    assert T.cited_span(quote, text) == want
    assert one(spark, T.is_cited(F.col("q"), F.col("t")), q=quote, t=text) is (want is not None)


def test_names(spark):
    assert one(spark, T.carries_name(F.col("a"), F.col("b")), a="Mira Holm", b="Holm, Mira J.") is True
    assert one(spark, T.mentions_name(F.col("a"), F.col("b")), a="Mira Holm", b="then mira holm spoke") is True
    assert one(spark, T.mentions_name(F.col("a"), F.col("b")), a="Mira Holm", b="Mira met Holm") is False
    assert one(spark, T.mentions_tokens(F.col("t"), F.col("p")), t="An old Mill", p=["mill", "old"]) is True


def test_small_text_functions(spark):
    assert one(spark, T.acronym_of(F.col("t")), t="Institute of Applied Pottery") == "IAP"
    assert one(spark, T.acronym_of(F.col("t")), t="Pottery Guild") is None
    assert one(spark, T.spoken_label(F.col("t"), F.lit("topic")), t="Ocean cleanup tools") == "ocean cleanup tools"
    for label, kind in (("Harbour Seed 2019", "topic"), ("AI safety", "topic"), ("Oslo", "topic"), ("Ocean cleanup", "company")):
        assert one(spark, T.spoken_label(F.col("t"), F.lit(kind)), t=label) == label
    assert one(spark, T.sentence_list(F.col("a")), a=["x", "y", "z"]) == "x, y and z"
    assert one(spark, T.unwrap_redirect(F.col("u")), u="https://s.example/l/?uddg=https%3A%2F%2Fa.example%2Fx") == "https://a.example/x"
    assert one(spark, T.unfence(F.col("t")), t='```json\n{"a": 1}\n```') == '{"a": 1}'
    assert one(spark, T.deinvert(F.col("t")), t='{"b": [1], "a": [0, 2]}') == "a b a"
    assert one(spark, T.clip(F.col("t"), 10), t="abcdefgh ijkl") == "abcdefgh"
    assert one(spark, T.field(F.col("t"), "City"), t="Name: X\nCity:  Oslo \n") == "Oslo" and one(spark, T.field(F.col("t"), "City"), t="City: unknown") is None
    assert one(spark, T.qids(F.col("t")), t="Q42, Q7 and Q42; not AQ1") == ["Q42", "Q7"] and one(spark, T.cik(F.col("t")), t="CIK=0000123") == "0000000123"
    assert one(spark, T.urls(F.col("t")), t="see https://a.example/x, (http://b.example)") == ["https://a.example/x", "http://b.example"]
    assert one(spark, T.looks_binary(F.col("t")), t="a\x00b") is True and one(spark, T.looks_binary(F.col("t")), t="plain\ntext") is False
    assert one(spark, T.is_speakable(F.col("t")), t="see [1]") is False and one(spark, T.is_speakable(F.col("t")), t="makes bowls") is True


def test_numbers(spark):
    assert [round(one(spark, N.idf(F.lit(5.0), F.col("n")), n=n), 7) for n in (2, 4)] == [0.5108256, 0.0]
    assert [one(spark, N.score(F.col("r"), F.lit(1.0)), r=r) for r in (0.025, 0.035, -1.0, 7.0)] == [2, 4, 0, 100]
    assert one(spark, N.score(F.col("r"), F.lit(0.0)), r=0.1) == 100
    today = F.lit("2025-01-01").cast("date")
    days = {datetime.date(2024, 1, 2): 1.0, datetime.date(2024, 1, 1): 0.6, datetime.date(2022, 1, 2): 0.6, datetime.date(2021, 12, 1): 0.3, datetime.date(2026, 1, 1): 1.0}
    assert all(one(spark, N.recency(F.col("d"), today), d=d) == want for d, want in days.items())
    assert one(spark, N.recency(F.lit(None).cast("date"), today), x=1) == 0.5
    for t in ("2024-03-05", "20240305101112", "2024/3/5", "5 Mar 2024", "Tue, 05 Mar 2024 10:00:00 GMT", "2024-03-05T10:00:00Z", "1709632800"):
        assert one(spark, N.parse_date(F.col("t")), t=t) == datetime.date(2024, 3, 5), t
    assert one(spark, N.parse_date(F.col("t")), t="soon") is None and one(spark, N.parse_date(F.col("t")), t="20241399000000") is None


def test_markup(spark):
    html = "<html><head><title> A  page </title><link rel=alternate type='application/rss+xml' href='/f'></head><body><nav>menu</nav><p>One <b>two</b><p>three &amp; four<script>x()</script><div id='cookie-bar'>no</div><a href='/z'>z</a></body>"
    r = spark.createDataFrame([(html,), (None,)], "h string").select(markup.page("h").alias("p")).select("p.*").collect()
    assert (r[0].title, r[0].text, r[0].links, r[0].feeds) == ("A page", "One two\nthree & four\nz", ["/z"], ["/f"]) and r[1].text == ""
    feed = "<rss><channel><item><title>T</title><guid>http://a.example/1</guid><pubDate>Tue, 05 Mar 2024 10:00:00 GMT</pubDate><description>d</description></item></channel></rss>"
    rows = spark.createDataFrame([(feed,), ("<broken",)], "x string").select(markup.feed("x").alias("e")).collect()
    assert rows[0].e[0].url == "http://a.example/1" and rows[0].e[0].summary == "d" and rows[1].e == []


def test_pages_go_to_python_by_hundreds(spark):
    """No Arrow batch, in which a Python worker would hold ten thousand pages at once; not even where Spark prefers them."""
    df = spark.createDataFrame([(None, None), ("http://a.example/", "<title>T</title><p>x<a href='/z#y'>z</a>")], "u string, h string")
    made = (markup.page("h"), markup.page_at("u", "h"), markup.feed("h"), markup.results("h"), markup.officers("h"), markup.decode_body(F.encode("h", "utf-8"), "u"))
    spark.conf.set("spark.sql.execution.pythonUDF.arrow.enabled", "true")
    try:
        for column in made:
            plan = df.select(column.alias("p"))._jdf.queryExecution().executedPlan().toString()
            assert "BatchEvalPython" in plan and "ArrowEvalPython" not in plan
        blank, full = df.select(*(c.alias(f"c{i}") for i, c in enumerate(made))).collect()
    finally:
        spark.conf.unset("spark.sql.execution.pythonUDF.arrow.enabled")
    assert (blank.c0.text, blank.c0.title, blank.c0.links, blank.c1.links, blank.c2, blank.c3, blank.c4, blank.c5) == ("", None, [], [], [], [], [], "")
    assert (full.c0.text, full.c0.title, full.c0.links, full.c1.links) == ("xz", "T", ["/z#y"], ["http://a.example/z"]) and full.c5.startswith("<title>")


def test_pages_are_read_once_for_their_links(spark, tmp_path):
    """The plan has one call of Python, without one more for a filter before the explosion; pages without links have no rows."""
    rows = [(1, "<a href='/x'>x</a><a href=''>y</a><a href='/z'>z</a>"), (2, None), (3, "<p>no link</p>")]
    spark.createDataFrame(rows, "page_id long, html string").write.parquet(f"{tmp_path}/pages.parquet")
    df = documents.pages_links(spark, str(tmp_path))
    assert sorted(map(tuple, df.collect())) == [(1, 0, "/x"), (1, 1, "/z")] and df.columns == ["page_id", "at", "link"]
    assert df._jdf.queryExecution().executedPlan().toString().count("EvalPython") == 1


def test_no_class_of_hundreds(spark):
    """Rare characters are looked up, not tried one by one by a pattern, and are still rewritten."""
    df = spark.createDataFrame([("é ﬁ ẞ ½",)], "t string").withColumn("s", T.slug(F.col("t"))).withColumn("n", T.normalize_ws(F.col("t")))
    assert "RLIKE" not in df._jdf.queryExecution().optimizedPlan().toString()
    r = df.first()
    assert r.s == "e-fi-1-2" and r.n == "é fi ss ½"
