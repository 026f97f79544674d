"""Readers of recorded answers over customers: person = customer, answers invented by fixed rules over all rows."""

from __future__ import annotations

from pyspark.sql import functions as F

from kinweave.plans.catalogue import query
from kinweave.plans.fixtures import spread, table
from kinweave.sources import connectors

_J = lambda **fields: F.to_json(F.struct(*(v.alias(k) for k, v in fields.items())))
_L = lambda x: F.lit(x)


def _people(spark, sf_dir):
    """Every customer as a partner of an atelier with an own site; `echo` is what the sources know of two in three."""
    c = spread(table(spark, sf_dir, "customer").select(F.col("c_custkey").alias("person_id"), "c_name", "c_mktsegment"), "person_id")
    c = c.select("person_id", F.col("c_name").alias("name"), F.concat(_L("Atelier "), "c_mktsegment").alias("house"))
    return c.withColumn("k", F.col("person_id").cast("string")).withColumn("site", F.concat(_L("https://site"), "k", _L(".example.org/"))).withColumn(
        "details", F.array(F.concat(_L("partner, "), "house"), "site")).withColumn("echo", F.when(F.col("person_id") % 3 != 0, F.col("house")).otherwise(_L("nothing")))


def _read(spark, sf_dir, kind, *answers):
    """answers: (endpoint, key, body) Columns over people."""
    p = _people(spark, sf_dir)
    said = p.select("person_id", F.explode(F.array(*(F.struct(_L(e).alias("endpoint"), key.alias("key"), F.lit(i).cast("long").alias("ordinal"), body.alias("body")) for i, (e, key, body) in enumerate(answers)))).alias("a"))
    said = said.select("person_id", F.lit(kind).alias("kind"), "a.*")
    return connectors.gather(p, said, (kind,)).select("person_id", "ordinal", "url", "title")


_P = "(SELECT c_custkey AS person_id, CAST(c_custkey AS VARCHAR) AS k, c_name AS name, 'Atelier ' || c_mktsegment AS house FROM customer) p"


@query(f"SELECT person_id, 0 AS ordinal, 'https://w.example.org/' || k AS url, name AS title FROM {_P} WHERE person_id % 3 <> 0")
def source_wikipedia(spark, sf_dir):
    page = _J(title=F.col("name"), extract=F.concat(F.col("name"), _L(" works at "), F.col("echo")), content_urls=F.struct(F.struct(F.concat(_L("https://w.example.org/"), F.col("k")).alias("page")).alias("desktop")))
    return _read(spark, sf_dir, "wikipedia", ("summary", F.col("name"), page), ("summary", F.col("name"), _J(title=F.col("name"), type=_L("disambiguation"), extract=F.col("echo"))))


@query(f"SELECT person_id, 0 AS ordinal, 'https://www.wikidata.org/wiki/Q' || k AS url, name || ' (Q' || k || ')' AS title FROM {_P} WHERE person_id % 3 <> 0")
def source_wikidata(spark, sf_dir):
    qid = F.concat(_L("Q"), F.col("k"))
    found = _J(search=F.array(F.struct(qid.alias("id"), F.col("name").alias("label"))))
    entity = _J(descriptions=F.create_map(_L("en"), F.struct(F.col("echo").alias("value"))), claims=F.create_map(_L("P31"), F.array(F.struct(F.struct(F.struct(F.struct(_L("Q5").alias("id")).alias("value")).alias("datavalue")).alias("mainsnak")))))
    return _read(spark, sf_dir, "wikidata", ("search", F.col("name"), found), ("entity", qid, entity))


@query(f"""SELECT person_id, i AS ordinal, 'https://github.com/u' || k || ['', '/tools', '/tools/commits'][i + 1] AS url, [name || ' (u' || k || ') on GitHub', 'u' || k || '/tools', 'Pushed commits to u' || k || '/tools'][i + 1] AS title
  FROM {_P}, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS i) WHERE person_id % 3 <> 0""")
def source_github(spark, sf_dir):
    login = F.concat(_L("u"), F.col("k"))
    full = F.concat(login, _L("/tools"))
    user = _J(login=login, name=F.col("name"), company=F.col("echo"), html_url=F.concat(_L("https://github.com/"), login))
    repo = lambda n, fork: F.struct(F.concat(_L("https://github.com/"), n).alias("html_url"), n.alias("full_name"), F.lit(fork).alias("fork"))
    event = F.struct(_L("PushEvent").alias("type"), F.struct(login.alias("login")).alias("actor"), F.struct(full.alias("name")).alias("repo"))
    return _read(spark, sf_dir, "github", ("user", login, user), ("repos", login, F.to_json(F.array(repo(full, False), repo(F.concat(login, _L("/copy")), True)))), ("events", login, F.to_json(F.array(event))))


@query(f"""SELECT person_id, i AS ordinal, 'https://openalex.org/' || ['A', 'W'][i + 1] || k AS url, [name || ' — OpenAlex author profile', 'Notes of ' || name][i + 1] AS title
  FROM {_P}, (SELECT CAST(unnest([0, 1]) AS INT) AS i) WHERE person_id % 3 <> 0""")
def source_openalex(spark, sf_dir):
    author = lambda i, place: F.struct(F.concat(_L("https://openalex.org/" + i), F.col("k")).alias("id"), F.col("name").alias("display_name"), F.array(F.struct(place.alias("display_name"))).alias("last_known_institutions"))
    work = F.struct(F.concat(_L("https://openalex.org/W"), F.col("k")).alias("id"), F.concat(_L("Notes of "), F.col("name")).alias("display_name"), F.lit(2024).alias("publication_year"))
    return _read(spark, sf_dir, "openalex", ("authors", F.col("name"), _J(results=F.array(author("B", _L("elsewhere")), author("A", F.col("echo"))))), ("works", F.concat(_L("A"), F.col("k")), _J(results=F.array(work))))


@query(f"SELECT person_id, 0 AS ordinal, 'https://www.sec.gov/Archives/edgar/data/' || k || '/0001' || k || '/0001-' || k || '-index.htm' AS url, 'SEC Form 4 — ' || name || ', ' || house AS title FROM {_P} WHERE person_id % 3 <> 0")
def source_edgar(spark, sf_dir):
    hit = F.struct(F.struct(F.concat(_L("0001-"), F.col("k")).alias("adsh"), F.array(F.lpad(F.col("k"), 10, "0")).alias("ciks"), F.array(F.col("name"), F.col("echo")).alias("display_names"), _L("4").alias("form")).alias("_source"))
    return _read(spark, sf_dir, "edgar", ("filings", F.col("name"), _J(hits=F.struct(F.array(hit).alias("hits")))))


@query(f"SELECT person_id, 0 AS ordinal, 'https://projects.propublica.org/nonprofits/organizations/' || k AS url, house || ' Trust' AS title FROM {_P} WHERE person_id % 3 <> 0")
def source_propublica(spark, sf_dir):
    row = F.struct(F.col("k").alias("ein"), F.concat(F.col("echo"), _L(" Trust")).alias("name"))
    page = F.concat(_L("<table><tr class='employee-row'><td>"), F.col("name"), _L(" <span>(Chair)</span></td></tr></table>"))
    return _read(spark, sf_dir, "propublica", ("search", F.col("name"), _J(organizations=F.array(row, row))), ("organization", F.col("k"), _L("{}")), ("page", F.col("k"), page))


@query(f"""SELECT person_id, i AS ordinal, 'https://news.ycombinator.com/item?id=' || (person_id * 10 + i) AS url, [name || ' of ' || house, 'Comment on “Looms”'][i + 1] AS title
  FROM {_P}, (SELECT CAST(unnest([0, 1]) AS INT) AS i) WHERE person_id % 3 <> 0""")
def source_hn(spark, sf_dir):
    item = lambda i: (F.col("person_id") * 10 + i).cast("string").alias("objectID")
    handle = F.concat(_L("h"), F.col("k"))
    story = F.struct(item(0), F.concat(F.col("name"), _L(" of "), F.col("echo")).alias("title"), handle.alias("author"), F.array(_L("story")).alias("_tags"))
    comment = F.struct(item(1), _L("Looms").alias("story_title"), _L("indeed").alias("comment_text"), handle.alias("author"), F.array(_L("comment")).alias("_tags"))
    return _read(spark, sf_dir, "hn", ("name", F.col("name"), _J(hits=F.array(story))), ("profile", handle, _J(username=handle, about=F.concat(F.col("name"), _L(" at "), F.col("site")))), ("author", handle, _J(hits=F.array(comment))))


@query(f"SELECT person_id, 0 AS ordinal, 'https://web.archive.org/web/20210101000000/https://site' || k || '.example.org/b' AS url, 'Page b' AS title FROM {_P}")
def source_wayback(spark, sf_dir):
    row = lambda stamp, url, digest: F.array(_L("k"), _L(stamp), url, _L("text/html"), _L("200"), _L(digest), _L("1"))
    rows = F.array(F.array(*map(F.lit, connectors.CDX)), row("20200101000000", F.concat(F.col("site"), _L("a")), "D"), row("20210101000000", F.concat(F.col("site"), _L("b")), "D"), row("20210101000000", _L("https://else.example.org/"), "E"))
    page = lambda stamp, x: ("page", F.concat(_L(f"https://web.archive.org/web/{stamp}/"), F.col("site"), _L(x)), _L(f"<title>Page {x}</title><p>Text {x}</p>"))
    return _read(spark, sf_dir, "wayback", ("captures", F.col("site"), F.to_json(rows)), page("20200101000000", "a"), page("20210101000000", "b"))


@query(f"SELECT person_id, 0 AS ordinal, 'https://r.example.org/' || k AS url, name AS title FROM {_P} WHERE person_id % 3 <> 0")
def source_search(spark, sf_dir):
    hit = F.struct(F.concat(_L("https://r.example.org/"), F.col("k")).alias("url"), F.col("name").alias("title"), F.col("echo").alias("content"))
    return _read(spark, sf_dir, "search", ("results", F.col("name"), F.when(F.col("person_id") % 2 == 0, _J(results=F.array(hit)))), ("html", F.col("name"), F.concat(
        _L("<a class='result__a' href='/l/?uddg=https%3A%2F%2Fr.example.org%2F"), F.col("k"), _L("'>"), F.col("name"), _L("</a><p class='result__snippet'>"), F.col("echo"), _L("</p>"))))


@query(f"""SELECT person_id, i AS ordinal, 'https://site' || k || '.example.org/' || ['', 'long', 'about'][i + 1] AS url, ['Home', 'Long', 'About'][i + 1] AS title FROM {_P}, (SELECT CAST(unnest([0, 1, 2]) AS INT) AS i)""")
def source_self_page(spark, sf_dir):
    home = _L("<title>Home</title><p>Hello</p><a href='/about'>a</a><a href='/login'>l</a><a href='https://else.example.org/'>e</a>")
    feed = F.concat(_L("<rss><item><title>Long</title><link>"), F.col("site"), _L("long</link><description>" + "word " * 12 + "</description></item></rss>"))
    page = lambda x, t: ("page", F.concat(F.col("site"), _L(x)), t)
    return _read(spark, sf_dir, "self_page", page("", home), page("about", _L("<title>About</title><p>Me</p>")), page("login", _L("<p>x</p>")), ("feed", F.concat(F.col("site"), _L("feed")), feed))
