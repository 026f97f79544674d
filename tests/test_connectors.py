"""Readers of recorded answers on invented people."""

import json

import pytest

from kinweave.functions import markup, roster
from kinweave.sources import connectors as C

ANN = ["co-founder, Pelm Works", "Austin, Texas", "https://annlee.example.org/"]
BOB = ["partner, Dorn Capital"]
ANSWER = "person_id string, kind string, endpoint string, key string, ordinal long, body string"


@pytest.fixture(scope="module")
def people(spark):
    return spark.createDataFrame([("a", "Ann Lee", ANN), ("b", "Bob Ray", BOB), ("z", None, None)], "person_id string, name string, details array<string>")


def run(spark, people, kind, rows, budget=8):
    body = lambda b: b if b is None or isinstance(b, str) else json.dumps(b)
    answers = spark.createDataFrame([(p, kind, e, k, o, body(b)) for p, e, k, o, b in rows], ANSWER)
    got = C.gather(people, answers, (kind,), budget).orderBy("person_id", "ordinal").collect()
    return [(r.person_id, r.url, r.title, r.text, str(r.published_at)) for r in got]


def test_roster_lines():
    p = roster.parse("Ann Lee", [*ANN, "writes the AVC blog (avc.org); formerly Pala", "not the Ann Lee of Boston", "likes Ph.D. work i.e. none"])
    assert p["urls"] == ["https://annlee.example.org/", "https://avc.org"] and p["employer"] == ["pelm", "works"] and p["place"] == "Austin, Texas"
    assert p["affiliation"] == "Pelm Works" and "pala" in p["terms"] and p["queries"] == ["Ann Lee", "Pelm Works", "Pala"]
    assert roster.names_a_job("co-founder and partner") and not roster.names_a_job("General Electric") and roster.is_address("Providence, Rhode Island")
    assert roster.parse(None, None)["urls"] == []


def test_own_space(spark):
    q = [("https://annlee.example.org/x", "https://annlee.example.org/", True), ("https://github.com/ann/y", "https://github.com/ann", True),
         ("https://github.com/annex", "https://github.com/ann", False), ("https://github.com/bob", "https://github.com/", False), (None, "https://a.org", False)]
    df = spark.createDataFrame([(u, [d], w) for u, d, w in q], "u string, d array<string>, w boolean")
    assert all(r.w == r.g for r in df.withColumn("g", roster.on_own_host(df.u, df.d)).collect())


def test_wikipedia(spark, people):
    page = {"type": "standard", "title": "Ann Lee", "extract": "Ann Lee co-founded Pelm Works.", "description": "weaver", "timestamp": "2024-05-06T01:02:03Z", "content_urls": {"desktop": {"page": "https://en.wikipedia.org/wiki/Ann_Lee"}}}
    rows = [("a", "summary", "Ann Lee", 0, page), ("a", "summary", "Lee", 1, page | {"title": "Lee"}), ("a", "summary", "Ann Lee (disambiguation)", 2, page | {"type": "disambiguation"}),
            ("b", "summary", "Bob Ray", 0, page | {"title": "Bob Ray", "extract": "Bob Ray swims."}), ("b", "summary", "x", 1, None), ("b", "summary", "y", 2, "{")]
    assert run(spark, people, "wikipedia", rows) == [("a", "https://en.wikipedia.org/wiki/Ann_Lee", "Ann Lee", "weaver\nAnn Lee co-founded Pelm Works.", "2024-05-06")]


def claim(v):
    return {"mainsnak": {"datavalue": {"value": v}}}


def test_wikidata(spark, people):
    found = {"search": [{"id": "Q1", "label": "Ann Lee", "description": "weaver"}, {"id": "Q2", "label": "Ann Lee", "description": "city"}, {"id": "Q3", "label": "Ann Other"}]}
    one = {"labels": {"en": {"value": "Ann Lee"}}, "descriptions": {"en": {"value": "weaver"}}, "claims": {"P31": [claim({"id": "Q5"})], "P108": [claim({"id": "Q9"})], "P856": [claim("https://pelm.example")]}, "sitelinks": {"enwiki": {"title": "Ann Lee"}}}
    rows = [("a", "search", "", 0, found), ("a", "entity", "Q1", 0, one), ("a", "entity", "Q2", 0, {"claims": {"P31": [claim({"id": "Q515"})]}}), ("a", "label", "Q9", 0, "Pelm Works"), ("a", "label", "Q5", 0, "human")]
    assert run(spark, people, "wikidata", rows) == [("a", "https://www.wikidata.org/wiki/Q1", "Ann Lee (Q1)",
        "Ann Lee (Q1)\nweaver\ninstance of: human\nemployer: Pelm Works\nofficial website: https://pelm.example\nEnglish Wikipedia: Ann Lee", "None")]


def test_github(spark, people):
    user = {"login": "annlee", "name": "Ann Lee", "company": "Pelm Works", "html_url": "https://github.com/annlee", "public_repos": 2, "created_at": "2020-01-02T00:00:00Z"}
    repo = lambda n, fork=False: {"html_url": f"https://github.com/annlee/{n}", "full_name": f"annlee/{n}", "fork": fork, "stargazers_count": 3, "pushed_at": "2024-01-01"}
    push = {"type": "PushEvent", "actor": {"login": "AnnLee"}, "repo": {"name": "annlee/loom"}, "payload": {"commits": [{"message": "Warp\nweft"}]}, "created_at": "2024-02-01T00:00:00Z"}
    rows = [("a", "user", "annlee", 0, user), ("a", "user", "other", 1, user | {"login": "other", "company": None, "html_url": "https://github.com/other"}),
            ("a", "repos", "annlee", 0, [repo("loom"), repo("copy", True), repo("dye"), repo("spin")]), ("a", "events", "annlee", 0, [push, push | {"type": "WatchEvent"}, push | {"actor": {"login": "x"}}])]
    got = run(spark, people, "github", rows, 4)
    assert [g[1] for g in got] == ["https://github.com/annlee", "https://github.com/annlee/loom", "https://github.com/annlee/dye", "https://github.com/annlee/loom/commits"]
    assert got[0][3] == "GitHub profile: annlee\nAnn Lee\nCompany: Pelm Works\n2 public repositories, 0 followers." and "Latest commit message: Warp" in got[3][3]
    assert run(spark, people, "github", rows[:1] + [("a", "user", "twin", 1, user | {"login": "twin"})]) == []


def test_openalex(spark, people):
    author = lambda i, place: {"id": f"https://openalex.org/{i}", "display_name": "Lee, Ann", "last_known_institutions": [{"display_name": place}], "works_count": 4}
    work = {"id": "https://openalex.org/W1", "display_name": "On looms", "publication_year": 2023, "publication_date": "2023-03-04", "abstract_inverted_index": {"looms": [1], "Fast": [0]}, "authorships": [{"author": {"display_name": "Ann Lee"}}]}
    rows = [("a", "authors", "", 0, {"results": [author("A1", "Elsewhere"), author("A2", "Pelm Works")]}), ("a", "works", "A2", 0, {"results": [work]}), ("a", "works", "A1", 0, {"results": [work]})]
    got = run(spark, people, "openalex", rows)
    assert [g[1] for g in got] == ["https://openalex.org/A2", "https://openalex.org/W1"] and got[1][3] == "On looms\nPublished 2023\nAuthors: Ann Lee\nCited 0 times.\nFast looms"


def test_edgar(spark, people):
    hit = {"_id": "0001-22-3:x.xml", "_source": {"ciks": ["0000012345"], "display_names": ["LEE ANN", "Pelm Works"], "form": "4", "file_date": "2022-02-03"}}
    rows = [("a", "filings", "", 0, {"hits": {"hits": [hit, hit | {"_source": hit["_source"] | {"display_names": ["Lee Ann"]}}]}})]
    assert run(spark, people, "edgar", rows) == [("a", "https://www.sec.gov/Archives/edgar/data/12345/0001223/0001-22-3-index.htm", "SEC Form 4 — LEE ANN, Pelm Works",
        "SEC EDGAR filing 0001-22-3, form 4\nFiled: 2022-02-03\nFiled by / named in filing: LEE ANN, Pelm Works", "2022-02-03")]


def test_propublica(spark, people):
    org = lambda e, n: {"ein": e, "name": n, "city": "Austin", "state": "TX"}
    page = "<table><tr class='employee-row'><td>LEE ANN <span>(Chair)</span></td><td>0</td></tr><tr><td>No One</td></tr></table>"
    rows = [("a", "search", "q", 0, {"organizations": [org("1", "Loom Trust"), org("1", "Loom Trust"), org("2", "Dye Fund"), org("3", "Other")]}), ("a", "organization", "1", 0, {"organization": {"officers": [{"name": "Ann Lee", "title": "Treasurer"}]}}),
            ("a", "organization", "2", 0, {"organization": {}}), ("a", "page", "2", 0, page), ("a", "organization", "3", 0, {"officers": [{"name": "Bob Ray"}]})]
    got = run(spark, people, "propublica", rows)
    assert [g[2] for g in got] == ["Loom Trust", "Dye Fund"] and "Ann Lee is listed as: LEE ANN (Chair)" in got[1][3]


def test_hn(spark, people):
    story = {"objectID": "1", "title": "Pelm Works by Ann Lee", "author": "al", "points": 5, "created_at": "2024-01-01T00:00:00Z", "_tags": ["story"]}
    own = [{"objectID": str(i), "comment_text": f"c{i}", "author": "al", "story_title": "S", "_tags": ["comment"]} for i in (2, 3, 4)] + [{"objectID": "5", "title": "T", "author": "al"}, {"objectID": "6", "title": "T", "author": "no"}]
    rows = [("a", "name", "", 0, {"hits": [story, story | {"objectID": "9", "title": "Ann Lee sings"}]}), ("a", "profile", "al", 0, {"username": "al", "about": "Ann Lee, https://annlee.example.org/"}), ("a", "author", "al", 0, {"hits": own})]
    assert [g[1].rpartition("=")[2] for g in run(spark, people, "hn", rows)] == ["1", "5", "2", "3"]


def test_wayback(spark, people):
    row = lambda ts, u, d, s="200", m="text/html": ["k", ts, u, m, s, d, "9"]
    cap = [list(C.CDX), row("20200101000000", "https://annlee.example.org/a", "D1"), row("20210101000000", "https://annlee.example.org/b", "D1"), row("20200101000000", "https://else.org/", "D2"), row("20200101000000", "https://annlee.example.org/i", "D3", m="image/png")]
    rows = [("a", "captures", "annlee.example.org/*", 0, cap)] + [("a", "page", f"https://web.archive.org/web/{t}/https://annlee.example.org/{x}", 0, f"<title>{x}</title><p>Page {x}</p>") for t, x in (("20200101000000", "a"), ("20210101000000", "b"))]
    assert run(spark, people, "wayback", rows) == [("a", "https://web.archive.org/web/20210101000000/https://annlee.example.org/b", "b", "Page b", "2021-01-01")]
    assert [r.pattern for r in C.capture_patterns(C.known(people)).collect()] == ["annlee.example.org/*"]


def test_search(spark, people):
    hit = lambda u, c: {"url": u, "title": "Ann Lee", "content": c}
    html = '<a class="result__a" href="//duckduckgo.com/l/?uddg=https%3A%2F%2Fb.org%2F">Bob Ray</a><div class="result__snippet">of <b>Dorn</b> Capital</div>'
    rows = [("a", "results", "", 0, {"results": [hit("https://x.org/", "of Pelm Works"), hit("https://y.org/", "a singer")]}), ("a", "html", "", 0, html), ("b", "results", "", 0, {"error": 1}), ("b", "html", "", 0, html)]
    assert run(spark, people, "search", rows) == [("a", "https://x.org/", "Ann Lee", "Ann Lee\nof Pelm Works", "None"), ("b", "https://b.org/", "Bob Ray", "Bob Ray\nof Dorn Capital", "None")]


def test_self_page(spark, people):
    home = '<title>Home</title><p>Hello</p><a href="/about">a</a><a href="/login">l</a><a href="https://else.org/">e</a><link rel="alternate" type="application/rss+xml" href="/blog.xml">'
    feed = "<rss><channel><item><title>Long</title><link>https://annlee.example.org/long</link><description>" + "word " * 20 + "</description><pubDate>Mon, 06 May 2024 00:00:00 GMT</pubDate></item><item><title>S</title><link>https://annlee.example.org/s</link></item></channel></rss>"
    rows = [("a", "page", "https://annlee.example.org/", 0, home), ("a", "page", "https://annlee.example.org/about", 0, "<p>About me</p>"), ("a", "page", "https://annlee.example.org/login", 0, "<p>x</p>"),
            ("a", "page", "https://annlee.example.org/s", 0, "<title>Short</title><p>Short page</p>"), ("a", "feed", "https://annlee.example.org/blog.xml", 0, feed),
            ("b", "search", "", 0, {"search": [{"id": "Q7", "label": "Bob Ray"}]}), ("b", "entity", "Q7", 0, {"descriptions": {"en": {"value": "of Dorn Capital"}}, "claims": {"P856": [claim("https://bob.example/")]}}), ("b", "page", "https://bob.example/", 0, "<p>Bob</p>")]
    got = run(spark, people, "self_page", rows)
    assert [(g[0], g[1].rpartition("/")[2], g[2], g[4]) for g in got] == [("a", "", "Home", "None"), ("a", "long", "Long", "2024-05-06"), ("a", "s", "Short", "None"), ("a", "about", "", "None"), ("b", "", "", "None")]


def test_contract(spark, people):
    rows = [("a", "results", "", 0, {"results": [{"url": u, "title": "Ann Lee" * 60, "content": "Ann Lee Pelm Works"} for u in ("https://x.org/", "https://x.org/", "ftp://y.org/", "https://z.org/")]})]
    got = run(spark, people, "search", rows)
    assert [g[1] for g in got] == ["https://x.org/", "https://z.org/"] and len(got[0][2]) == 300
    assert len(run(spark, people, "search", rows, 1)) == 1 and run(spark, people, "search", rows, 0) == []
    assert markup.officer_parts(None) == [] and markup.result_parts("<a class='result-link' href='https://q.org'>Q") == [{"url": "https://q.org", "title": "Q", "content": ""}]


@pytest.mark.parametrize("name", ["search", "wayback", "wikidata", "hn", "github", "openalex", "edgar", "propublica", "self_page", "wikipedia"])
def test_readers_broadcast_no_table(spark, name):
    """People and answers grow with the input, however small their compressed files are; and one split is no single task's work."""
    from kinweave.plans import catalogue

    plan = catalogue.queries()[f"source_{name}"](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    assert "Broadcast" not in plan and "SortMergeJoin" in plan and "REPARTITION_BY_COL" in plan


def test_answers_parsed_once(spark, people):
    """A parsed answer is not copied into the conditions on its fields, and roster lines are parsed once."""
    for kind, most in (("wikipedia", 1), ("github", 3), ("hn", 2), ("edgar", 29)):
        plan = C.gather(people, spark.createDataFrame([], ANSWER).repartition(2), (kind,))._jdf.queryExecution().optimizedPlan().toString()
        assert plan.count("from_json") <= most and "roster(" not in plan, (kind, plan.count("from_json"))
