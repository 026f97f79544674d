"""Readers of recorded answers, one per kind of source.

answers(person_id, kind, endpoint, key, ordinal, body): what a source said to a request, `ordinal` its place among the
requests. Stored partitioned by kind, each reader scans its own partition only. people(person_id, name, details) becomes
people with `who`, the parsed roster line, once, by known(). Every reader returns (person_id, kind, at, url, title, text,
published_at), `at` an array of longs that orders a person's documents; gather() unites them under one contract: http(s)
address, text that is not blank, title of at most 300 characters, clipped text, the first of equal documents, a cap per
person and kind. Null bodies and malformed JSON bring no rows. What a reader refuses it refuses by the identity gate.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import markup
from kinweave.functions import roster as R
from kinweave.functions.numbers import parse_date
from kinweave.functions.text import carries_name, clip, deinvert, doc_id, normalize_ws, text_block, unwrap_redirect
from kinweave.operators.components import cut, sorted_joins
from kinweave.operators.elections import choose_one

BUDGET, MAX_TITLE, MIN_ENTRY = 8, 300, 40
#: Properties that describe a person, how they read, and the class of human beings.
PROPERTIES = {"P31": "instance of", "P106": "occupation", "P108": "employer", "P69": "educated at", "P937": "work location",
              "P856": "official website", "P1416": "affiliation", "P512": "academic degree", "P166": "award received"}
HUMAN = "Q5"
#: Public events that publish, how they read, and the page they point at.
EVENTS = {"PushEvent": ("Pushed commits to", "/commits"), "PullRequestEvent": ("Opened a pull request on", "/pulls"),
          "ReleaseEvent": ("Published a release of", "/releases"), "CreateEvent": ("Created", ""), "PublicEvent": ("Made public", "")}
#: Media types of captures that hold no document, path parts never followed, and caps per source.
NO_DOCUMENT = ("image/", "video/", "audio/", "font/", "application/pdf", "application/zip", "application/octet-stream", "application/x-",
               "application/font", "text/css", "application/javascript", "text/javascript", "application/rss", "application/atom")
SKIPPED = ("/login", "/signup", "/cart", "/privacy", "/terms")
LOGINS, EVENT_SLOTS, HANDLES, COMMENTS, ORGANISATIONS, PAGES, OFFICERS = 3, 2, 2, 2, 8, 4, 40
CDX = ("urlkey", "timestamp", "original", "mimetype", "statuscode", "digest", "length")

_none = lambda: F.lit(None).cast("string")
_texts = lambda *c: F.array(*(x.cast("string") for x in c))
_given = lambda c: F.nullif(F.trim(c), F.lit(""))


def known(people: DataFrame) -> DataFrame:
    """(person_id, who): roster lines parsed once."""
    return people.select("person_id", R.roster("name", "details").alias("who"))


def _said(people: DataFrame, answers: DataFrame, kind: str, endpoint: str) -> DataFrame:
    rows = answers.where((F.col("kind") == kind) & (F.col("endpoint") == endpoint) & F.col("body").isNotNull())
    return rows.select("person_id", "key", F.col("ordinal").cast("long").alias("ordinal"), "body").join(people, "person_id")


def _parsed(rows: DataFrame, name: str, body: Column) -> DataFrame:
    """rows with body under a name, parsed once a row: what is generated is never copied into conditions on its fields."""
    return rows.select("*", F.explode(F.array(body)).alias(name))


def _each(rows: DataFrame, items: Column) -> DataFrame:
    return rows.select("person_id", "who", "key", "ordinal", F.posexplode(items).alias("pos", "x"))


def _docs(rows: DataFrame, kind: str, at: list, url: Column, title: Column, text: Column, published: Column | None = None) -> DataFrame:
    return rows.select("person_id", F.lit(kind).alias("kind"), F.array(*(F.lit(a).cast("long") if isinstance(a, int) else a.cast("long") for a in at)).alias("at"),
                       url.alias("url"), title.alias("title"), text.alias("text"), (F.lit(None).cast("date") if published is None else published).alias("published_at"))


def _labelled(label: str, value: Column) -> Column:
    return F.when(_given(value).isNotNull(), F.concat(F.lit(label), value))


def _first(c: Column) -> Column:
    """The first string of a JSON field that is a string or a list of them."""
    return F.when(F.startswith(c, F.lit("[")), F.get(F.from_json(c, "array<string>"), F.lit(0))).otherwise(c)


def first_per(rows: DataFrame, keys: list[str], order: list, most: int) -> DataFrame:
    n = F.row_number().over(Window.partitionBy(*keys).orderBy(*order))
    return rows.withColumn("__n", n).where(F.col("__n") <= most).drop("__n")


def wikipedia(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'summary' answers in the order of the title search: articles, not disambiguations, titled with the name, past the gate."""
    s = F.from_json("body", "type string, title string, extract string, description string, timestamp string, titles struct<normalized:string>, content_urls struct<desktop:struct<page:string>>")
    d = _said(people, answers, "wikipedia", "summary").where(F.col("ordinal") < max(5, min(budget + 3, 10)))
    d = _parsed(d, "s", s)
    landed = F.coalesce(_given(F.col("s.titles.normalized")), _given(F.col("s.title")), F.col("key"))
    prose = _texts(F.col("s.extract"), F.col("s.description"))
    d = d.withColumn("landed", landed).where(_given(F.col("s.extract")).isNotNull() & (F.coalesce(F.col("s.type"), F.lit("")) != "disambiguation"))
    d = d.where(carries_name(F.col("who.name"), F.col("landed")) & R.identifies(F.col("who"), _texts(F.col("landed")), prose, _texts(_none()), prose))
    url = F.coalesce(_given(F.col("s.content_urls.desktop.page")), F.concat(F.lit("https://en.wikipedia.org/wiki/"), F.replace(F.url_encode(F.replace("landed", F.lit(" "), F.lit("_"))), F.lit("+"), F.lit("%20"))))
    return _docs(d, "wikipedia", [F.col("ordinal")], url, F.coalesce(_given(F.col("s.title")), F.col("key")), text_block(F.col("s.description"), F.col("s.extract")), parse_date(F.col("s.timestamp")))


_VALUE = "struct<mainsnak:struct<datavalue:struct<value:string>>>"
ENTITY = (f"labels map<string,struct<value:string>>, descriptions map<string,struct<value:string>>, aliases map<string,array<struct<value:string>>>, "
          f"claims map<string,array<{_VALUE}>>, sitelinks struct<enwiki:struct<title:string>>")


def _value(v: Column) -> Column:
    """The value of a claim: a plain string, or the id, text, time or amount of an object."""
    return F.when(F.startswith(v, F.lit("{")), F.coalesce(*(F.get_json_object(v, f"$.{k}") for k in ("id", "text", "time", "amount")))).otherwise(v)


def claim_values(entity: Column, prop: str) -> Column:
    got = F.transform(F.coalesce(F.try_element_at(entity["claims"], F.lit(prop)), F.array().cast(f"array<{_VALUE}>")), lambda c: _value(c["mainsnak"]["datavalue"]["value"]))
    return F.filter(got, lambda v: F.coalesce(v, F.lit("")) != "")


def _local(m: Column) -> Column:
    return F.coalesce(F.try_element_at(m, F.lit("en"))["value"], F.get(F.map_values(m), F.lit(0))["value"])


def _is_human(entity: Column) -> Column:
    kinds = claim_values(entity, "P31")
    return (F.size(kinds) == 0) | F.array_contains(kinds, HUMAN)


def _candidates(people: DataFrame, answers: DataFrame, kind: str) -> DataFrame:
    """Items of the label search whose label carries the name, in order."""
    rows = _each(_said(people, answers, kind, "search"), F.from_json("body", "search array<struct<id:string,title:string,label:string,description:string,match:struct<text:string>>>")["search"])
    rows = rows.select("person_id", "who", F.array("ordinal", F.col("pos").cast("long")).alias("place"), F.coalesce(_given(F.col("x.id")), F.col("x.title")).alias("qid"),
                       F.coalesce(_given(F.col("x.label")), F.col("x.match.text")).alias("label"), F.col("x.description").alias("description"))
    return rows.where(F.startswith("qid", F.lit("Q")) & carries_name(F.col("who.name"), F.coalesce(_given(F.col("label")), F.col("qid"))))


def _entities(answers: DataFrame, kind: str) -> DataFrame:
    rows = answers.where((F.col("kind") == kind) & (F.col("endpoint") == "entity") & F.col("body").isNotNull())
    return rows.groupBy("person_id", F.col("key").alias("qid")).agg(F.min_by("body", "ordinal").alias("body")).withColumn("e", F.from_json("body", ENTITY)).drop("body")


def wikidata(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'search' candidates, their 'entity' answers (key: item) and 'label' answers (key: item, body: label) of the items that
    claims name. Human or without a class, and on a roster host or echoing a roster term."""
    c = first_per(_candidates(people, answers, "wikidata"), ["person_id"], ["place"], max(3, min(budget + 2, 10))).join(_entities(answers, "wikidata"), ["person_id", "qid"]).where(_is_human(F.col("e")))
    props = F.array(*(F.struct(F.lit(i).alias("i"), F.lit(n).alias("reads"), claim_values(F.col("e"), p).alias("vs")) for i, (p, n) in enumerate(PROPERTIES.items())))
    told = c.select("person_id", "qid", F.explode(props).alias("p")).select("person_id", "qid", "p.i", "p.reads", F.posexplode("p.vs").alias("pos", "v"))
    labels = answers.where("kind = 'wikidata' and endpoint = 'label' and body is not null").groupBy("person_id", F.col("key").alias("v")).agg(F.min("body").alias("said"))
    told = told.join(labels, ["person_id", "v"], "left").withColumn("said", F.when(F.col("v").rlike(r"^Q\d+$"), F.col("said")).otherwise(F.col("v"))).where("said is not null")
    per = told.groupBy("person_id", "qid", "i", "reads").agg(F.array_sort(F.collect_list(F.struct("pos", "said"))).alias("l"))
    line = F.struct("i", F.concat("reads", F.lit(": "), F.array_join(F.transform("l", lambda x: x["said"]), ", ")).alias("t"))
    per = per.groupBy("person_id", "qid").agg(F.array_join(F.transform(F.array_sort(F.collect_list(line)), lambda x: x["t"]), "\n").alias("lines"),
                                              F.flatten(F.transform(F.collect_list("l"), lambda l: F.transform(l, lambda x: x["said"]))).alias("values"))
    c = c.join(sorted_joins(per), ["person_id", "qid"], "left")
    hosts = F.transform(F.col("who.urls"), R.raw_host)
    aliases = F.transform(F.coalesce(F.try_element_at(F.col("e.aliases"), F.lit("en")), F.array().cast("array<struct<value:string>>")), lambda a: a["value"])
    own = F.exists(claim_values(F.col("e"), "P856"), lambda v: F.coalesce(F.array_contains(hosts, R.raw_host(v)), F.lit(False)))
    hay = F.concat_ws(" ", _local(F.col("e.descriptions")), _local(F.col("e.labels")), aliases, F.col("values"))
    d = c.where(own | (R.echoes(F.col("who.terms"), hay) > 0))
    label, about = F.coalesce(_given(_local(F.col("e.labels"))), F.col("label")), F.coalesce(_given(_local(F.col("e.descriptions"))), F.col("description"))
    head = F.when(_given(label).isNotNull(), F.concat(label, F.lit(" ("), "qid", F.lit(")"))).otherwise(F.col("qid"))
    return _docs(d, "wikidata", [F.get("place", F.lit(0)), F.get("place", F.lit(1))], F.concat(F.lit("https://www.wikidata.org/wiki/"), "qid"), head,
                 text_block(head, about, F.col("lines"), _labelled("English Wikipedia: ", F.col("e.sitelinks.enwiki.title"))))


def github(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'user' answers in search order: the first three logins that pass the gate stand for choice, one point per echoed term and
    two per own address, ties decline. Then the profile, own repositories as pushed ('repos'), and two publishing events ('events')."""
    u = F.from_json("body", "login string, name string, bio string, blog string, html_url string, company string, location string, public_repos long, followers long, created_at string")
    a = _parsed(_said(people, answers, "github", "user").where(F.col("ordinal") < LOGINS), "u", u).where("u.login is not null")
    names, prose, urls = _texts(F.col("u.name"), F.col("u.login")), _texts(F.col("u.bio")), _texts(F.col("u.blog"), F.col("u.html_url"))
    context = _texts(F.col("u.company"), F.col("u.location"), F.col("u.blog"), F.col("u.bio"))
    a = a.where(R.identifies(F.col("who"), names, prose, urls, context))
    own = F.size(F.filter(urls, lambda x: R.on_own_host(x, F.col("who.urls"))))
    a = a.withColumn("points", R.echoes(F.col("who.terms"), F.concat(context, names, prose)) + 2 * own).withColumn("login", F.col("u.login"))
    a = sorted_joins(cut(a.select("person_id", "login", "points", "u")))
    one = a.join(sorted_joins(choose_one(a, ["person_id"], "login", "points").select("person_id", F.col("chosen").alias("login"))), ["person_id", "login"]).dropDuplicates(["person_id"])
    profile = _docs(one, "github", [0, 0, 0], F.coalesce(_given(F.col("u.html_url")), F.concat(F.lit("https://github.com/"), "login")),
                    F.concat(F.coalesce(_given(F.col("u.name")), F.col("login")), F.lit(" ("), "login", F.lit(") on GitHub")),
                    text_block(F.concat(F.lit("GitHub profile: "), "login"), F.col("u.name"), _labelled("Company: ", F.col("u.company")), _labelled("Location: ", F.col("u.location")),
                               _labelled("Website: ", F.col("u.blog")), F.col("u.bio"), F.format_string("%d public repositories, %d followers.", F.coalesce("u.public_repos", F.lit(0)), F.coalesce("u.followers", F.lit(0)))),
                    parse_date(F.col("u.created_at")))
    chosen = sorted_joins(one.select("person_id", F.col("login").alias("key")))
    repo = "struct<html_url:string,full_name:string,name:string,description:string,language:string,stargazers_count:long,pushed_at:string,fork:boolean>"
    r = _each(_said(people, answers, "github", "repos").join(chosen, ["person_id", "key"]), F.from_json("body", f"array<{repo}>")).where("not coalesce(x.fork, false)")
    named = F.coalesce(_given(F.col("x.full_name")), F.col("x.name"))
    repos = _docs(r, "github", [1, F.col("ordinal"), F.col("pos")], F.col("x.html_url"), named, text_block(named, F.col("x.description"), _labelled("Language: ", F.col("x.language")), F.format_string(
        "%d stars, last pushed %s.", F.coalesce("x.stargazers_count", F.lit(0)), F.coalesce("x.pushed_at", F.lit("unknown")))), parse_date(F.col("x.pushed_at")))
    item = "struct<html_url:string,name:string,title:string,tag_name:string,body:string>"
    event = (f"struct<type:string,public:boolean,created_at:string,actor:struct<login:string>,repo:struct<name:string>,"
             f"payload:struct<ref_type:string,size:long,description:string,commits:array<struct<message:string>>,release:{item},pull_request:{item},issue:{item}>>")
    e = _each(_said(people, answers, "github", "events").join(chosen, ["person_id", "key"]), F.from_json("body", f"array<{event}>"))
    x = F.col("x")
    e = e.where(F.coalesce(x["public"], F.lit(True)) & (F.lower(x["actor"]["login"]) == F.lower("key")) & x["type"].isin(*EVENTS) & _given(x["repo"]["name"]).isNotNull()
                & ((x["type"] != "CreateEvent") | (x["payload"]["ref_type"] == "repository")))
    e = first_per(e, ["person_id"], ["ordinal", "pos"], max(0, min(EVENT_SLOTS, budget - 2)))
    told = F.create_map(*(F.lit(y) for k, (v, _) in EVENTS.items() for y in (k, v)))[x["type"]]
    page = F.create_map(*(F.lit(y) for k, (_, p) in EVENTS.items() for y in (k, p)))[x["type"]]
    link = F.coalesce(*(F.when(x["payload"][k]["html_url"].rlike("^https?://"), x["payload"][k]["html_url"]) for k in ("release", "pull_request", "issue")),
                      F.concat(F.lit("https://github.com/"), x["repo"]["name"], page))
    message = F.get(F.filter(x["payload"]["commits"], lambda c: _given(c["message"]).isNotNull()), F.lit(0))["message"]
    line = lambda c: F.substring_index(F.trim(c), "\n", 1)
    headline = lambda k, n: F.when(x["payload"][k].isNotNull(), text_block(F.concat(F.lit(n), F.coalesce(*(F.concat(F.lit(": "), _given(x["payload"][k][f])) for f in ("name", "title", "tag_name")), F.lit(""))), line(x["payload"][k]["body"])))
    detail = F.when(x["type"] == "PushEvent", F.coalesce(F.concat(F.lit("Latest commit message: "), line(message)), F.concat(x["payload"]["size"].cast("string"), F.lit(" commits.")))).otherwise(
        F.coalesce(headline("release", "Release"), headline("pull_request", "Pull request"), x["payload"]["description"]))
    title = F.concat(told, F.lit(" "), x["repo"]["name"])
    events = _docs(e, "github", [2, F.col("ordinal"), F.col("pos")], link, title, text_block(F.concat(title, F.lit(" on GitHub.")), detail, F.concat(F.lit("Repository: https://github.com/"), x["repo"]["name"]),
                   F.concat(F.lit("Public activity by "), x["actor"]["login"], F.lit("."))), parse_date(x["created_at"]))
    # events keep their slots: repositories fill what profile and events leave
    taken = events.groupBy("person_id").agg(F.count("*").alias("taken"))
    n = F.row_number().over(Window.partitionBy("person_id").orderBy("at"))
    repos = repos.where(F.col("url").rlike("^https?://")).withColumn("n", n).join(sorted_joins(taken), "person_id", "left").where(F.col("n") <= budget - 1 - F.coalesce("taken", F.lit(0))).drop("n", "taken")
    return profile.unionByName(repos).unionByName(events)


def openalex(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'authors' answers: of those that carry the name the one that roster terms single out (a lone one stands, ties decline);
    then the profile and its 'works' (key: author) as they come, newest first."""
    named = "struct<display_name:string>"
    author = (f"struct<id:string,display_name:string,display_name_alternatives:array<string>,last_known_institutions:array<{named}>,last_known_institution:{named},"
              f"affiliations:array<struct<display_name:string,institution:{named}>>,x_concepts:array<{named}>,topics:array<struct<display_name:string,subfield:{named},field:{named},domain:{named}>>,works_count:long,cited_by_count:long,orcid:string>")
    a = _each(_said(people, answers, "openalex", "authors"), F.from_json("body", f"results array<{author}>")["results"])
    x, short = F.col("x"), lambda c: F.substring_index(c, "/", -1)
    labels = F.concat(_texts(x["display_name"]), F.coalesce(x["display_name_alternatives"], F.array().cast("array<string>")))
    a = a.where(F.exists(labels, lambda n: carries_name(F.col("who.name"), F.coalesce(n, F.lit("")))))
    listed = lambda f: F.coalesce(F.transform(x[f], lambda y: y["display_name"]), F.array().cast("array<string>"))
    deep = F.coalesce(F.transform(x["affiliations"], lambda y: y["institution"]["display_name"]), F.array().cast("array<string>"))
    topics = F.coalesce(F.flatten(F.transform(x["topics"], lambda y: F.array(*(y[f]["display_name"] for f in ("subfield", "field", "domain"))))), F.array().cast("array<string>"))
    a = a.withColumn("author", short(x["id"])).where(_given(F.col("author")).isNotNull()).withColumn("points", R.echoes(F.col("who.terms"), listed("last_known_institutions"), x["last_known_institution"]["display_name"], listed("affiliations"), deep, listed("x_concepts"), listed("topics"), topics))
    one = a.join(sorted_joins(choose_one(a, ["person_id"], "author", "points").select("person_id", F.col("chosen").alias("author"))), ["person_id", "author"]).dropDuplicates(["person_id"])
    places = F.when(F.size(listed("last_known_institutions")) > 0, listed("last_known_institutions")).otherwise(_texts(x["last_known_institution"]["display_name"]))
    profile = _docs(one, "openalex", [0, 0, 0], F.concat(F.lit("https://openalex.org/"), "author"), F.concat(x["display_name"], F.lit(" — OpenAlex author profile")),
                    text_block(x["display_name"], _labelled("Affiliation: ", F.array_join(places, ", ")), _labelled("Research areas: ", F.array_join(F.slice(F.array_compact(listed("x_concepts")), 1, 6), ", ")),
                               F.format_string("%d works, %d citations.", F.coalesce(x["works_count"], F.lit(0)), F.coalesce(x["cited_by_count"], F.lit(0))), _labelled("ORCID: ", x["orcid"])))
    work = (f"struct<id:string,display_name:string,title:string,abstract:string,abstract_inverted_index:string,doi:string,publication_year:long,publication_date:string,cited_by_count:long,"
            f"primary_location:struct<landing_page_url:string,source:{named}>,authorships:array<struct<author:{named}>>>")
    w = _each(_said(people, answers, "openalex", "works").join(sorted_joins(one.select("person_id", F.col("author").alias("key"))), ["person_id", "key"]), F.from_json("body", f"results array<{work}>")["results"])
    title = F.coalesce(_given(x["display_name"]), x["title"])
    url = F.coalesce(_given(x["doi"]), _given(x["primary_location"]["landing_page_url"]), F.concat(F.lit("https://openalex.org/"), _given(short(x["id"]))))
    by = F.array_join(F.transform(x["authorships"], lambda y: y["author"]["display_name"]), ", ")
    year = F.concat(F.lit("Published "), F.coalesce(x["publication_year"].cast("string"), F.lit("None")), F.coalesce(F.concat(F.lit(" in "), _given(x["primary_location"]["source"]["display_name"])), F.lit("")))
    works = _docs(w, "openalex", [1, F.col("ordinal"), F.col("pos")], url, title, text_block(title, year, _labelled("Authors: ", by), F.format_string("Cited %d times.", F.coalesce(x["cited_by_count"], F.lit(0))),
                  F.coalesce(_given(x["abstract"]), deinvert(x["abstract_inverted_index"]))), parse_date(x["publication_date"]))
    return profile.unionByName(works)


def edgar(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'filings' answers of the full-text search whose filer names pass the gate."""
    src = "struct<adsh:string,ciks:string,display_names:string,form:string,root_forms:string,file_date:string,file_description:string>"
    h = _each(_said(people, answers, "edgar", "filings"), F.from_json("body", f"hits struct<hits:array<struct<_id:string,_source:{src}>>>")["hits"]["hits"])
    s = F.col("x._source")
    h = _parsed(h, "names", F.coalesce(F.from_json(s["display_names"], "array<string>"), F.array().cast("array<string>")))
    names = F.col("names")
    about = s["file_description"]
    h = h.where(R.identifies(F.col("who"), names, _texts(about), _texts(_none()), F.concat(names, _texts(about))))
    adsh = F.coalesce(_given(s["adsh"]), _given(F.substring_index(F.col("x._id"), ":", 1)))
    number = F.coalesce(_given(F.regexp_replace(_first(s["ciks"]), "^0+", "")), _given(_first(s["ciks"])), F.lit("0"))
    who = F.when(F.startswith(s["display_names"], F.lit("[")), F.array_join(names, ", ")).otherwise(s["display_names"])
    form = F.coalesce(_given(_first(s["form"])), _first(s["root_forms"]), F.lit(""))
    url = F.concat(F.lit("https://www.sec.gov/Archives/edgar/data/"), number, F.lit("/"), F.replace(adsh, F.lit("-"), F.lit("")), F.lit("/"), adsh, F.lit("-index.htm"))
    title = F.regexp_replace(F.concat(F.lit("SEC Form "), form, F.lit(" — "), F.coalesce(who, F.lit(""))), "^[ —]+|[ —]+$", "")
    return _docs(h, "edgar", [F.col("ordinal"), F.col("pos")], url, title, text_block(F.concat(F.lit("SEC EDGAR filing "), adsh, F.when(form != "", F.concat(F.lit(", form "), form)).otherwise("")),
                 _labelled("Filed: ", s["file_date"]), _labelled("Filed by / named in filing: ", who), about), parse_date(s["file_date"]))


def propublica(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'search' answers (ordinal: query), each employer number once; 'organization' answers (key: number) list the officers, or
    the 'page' of the first four organisations without any. An officer carries the name and the gate is passed."""
    row = "struct<ein:string,strein:string,name:string,city:string,state:string,ntee_code:string>"
    o = answers.where((F.col("kind") == "propublica") & (F.col("endpoint") == "search") & (F.col("ordinal") < R.MAX_QUERIES))
    o = o.select("person_id", F.col("ordinal").cast("long").alias("ordinal"), F.posexplode(F.from_json("body", f"organizations array<{row}>")["organizations"]).alias("pos", "x"))
    o = o.withColumn("key", F.col("x.ein")).where(_given(F.col("key")).isNotNull()).groupBy("person_id", "key").agg(F.min_by(F.struct("ordinal", "pos", "x"), F.struct("ordinal", "pos")).alias("r")).select("person_id", "key", "r.*")
    o = first_per(o, ["person_id"], ["ordinal", "pos"], max(1, min(budget + 3, ORGANISATIONS)))
    staff = "array<struct<name:string,title:string>>"
    got = answers.where("kind = 'propublica' and endpoint = 'organization'").groupBy("person_id", "key").agg(F.min("body").alias("b")).withColumn(
        "b", F.from_json("b", f"officers {staff}, organization struct<officers:{staff}>, filings_with_data array<struct<officers:{staff}>>"))
    page = answers.where("kind = 'propublica' and endpoint = 'page'").groupBy("person_id", "key").agg(F.min("body").alias("html"))
    line = lambda y: F.concat(F.trim(y["name"]), F.coalesce(F.concat(F.lit(" ("), _given(y["title"]), F.lit(")")), F.lit("")))
    lines = lambda c: F.transform(F.filter(c, lambda y: _given(y["name"]).isNotNull()), line)
    some = lambda c: F.when(F.size(c) > 0, c)
    o = o.join(got, ["person_id", "key"], "left").withColumn("stated", F.coalesce(some(lines(F.when(F.col("b.organization").isNotNull(), F.col("b.organization.officers")).otherwise(F.col("b.officers")))), some(lines(F.get("b.filings_with_data", F.lit(0))["officers"]))))
    lacking = F.sum(F.when(F.col("stated").isNull(), 1).otherwise(0)).over(Window.partitionBy("person_id").orderBy("ordinal", "pos"))
    o = o.withColumn("asked", F.col("stated").isNull() & (lacking <= PAGES)).join(page, ["person_id", "key"], "left")
    o = o.withColumn("officers", F.coalesce("stated", F.when(F.col("asked"), markup.officers("html")), F.array().cast("array<string>"))).where(F.size("officers") > 0)
    o = o.select("person_id", "key", "ordinal", "pos", "x", "officers").join(people, "person_id")
    o = o.withColumn("named", F.filter("officers", lambda y: carries_name(F.col("who.name"), y))).where(F.size("named") > 0)
    place = F.concat_ws(", ", _given(F.col("x.city")), _given(F.col("x.state")))
    o = o.where(R.identifies(F.col("who"), F.col("named"), _texts(_none()), _texts(_none()), _texts(F.col("x.name"), place, F.col("x.ntee_code"))))
    head = F.concat(F.lit("EIN "), F.coalesce(_given(F.col("x.strein")), F.col("key")), F.when(place != "", F.concat(F.lit(" — "), place)).otherwise(""))
    return _docs(o, "propublica", [F.col("ordinal"), F.col("pos")], F.concat(F.lit("https://projects.propublica.org/nonprofits/organizations/"), "key"), F.coalesce(_given(F.col("x.name")), F.concat(F.lit("EIN "), "key")),
                 text_block(F.col("x.name"), head, _labelled("NTEE code ", F.col("x.ntee_code")), F.concat(F.col("who.name"), F.lit(" is listed as: "), F.array_join("named", "; ")),
                            F.concat(F.lit("Officers and directors: "), F.array_join(F.slice("officers", 1, OFFICERS), "; "))))


def hn(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'name' hits past the gate; then, of two candidate handles (roster addresses first, then authors of those hits), the first
    whose 'profile' (key: handle) passes it: their stories before two comments ('author', key: handle)."""
    hit = ("struct<objectID:string,story_id:string,title:string,story_title:string,url:string,story_url:string,author:string,created_at:string,created_at_i:string,points:long,num_comments:long,story_text:string,comment_text:string,_tags:array<string>>")
    hits = lambda endpoint: _each(_said(people, answers, "hn", endpoint), F.from_json("body", f"hits array<{hit}>")["hits"])
    x = F.col("x")
    prose, linked = _texts(x["title"], x["story_title"], x["story_text"], x["comment_text"]), _texts(x["url"], x["story_url"])
    by_name = sorted_joins(cut(hits("name").where(R.identifies(F.col("who"), _texts(x["author"]), prose, linked, F.concat(prose, linked))).drop("who")))
    stated = people.select("person_id", F.posexplode("who.urls").alias("pos", "u")).where(R.raw_host(F.col("u")).isin("news.ycombinator.com", "www.news.ycombinator.com")).select(
        "person_id", F.array(F.lit(0), F.lit(0), "pos").cast("array<long>").alias("o"), F.trim(F.try_parse_url("u", F.lit("QUERY"), F.lit("id"))).alias("handle"))
    authors = by_name.select("person_id", F.array(F.lit(1), "ordinal", "pos").cast("array<long>").alias("o"), F.trim(x["author"]).alias("handle"))
    handles = stated.unionByName(authors).where("handle <> ''").groupBy("person_id", "handle").agg(F.min("o").alias("o"))
    handles = first_per(handles, ["person_id"], ["o"], HANDLES)
    p = _parsed(_said(people, answers, "hn", "profile"), "p", F.from_json("body", "username string, id string, about string"))
    user, about = F.coalesce(_given(F.col("p.username")), F.col("p.id")), F.col("p.about")
    found = F.transform(F.regexp_extract_all(F.coalesce(about, F.lit("")), F.lit(r"(?i)https?://[^\s<>\"')]+"), F.lit(0)), lambda u: F.regexp_replace(u, "[.,;]+$", ""))
    p = p.where(R.identifies(F.col("who"), _texts(user), _texts(about), found, _texts(about, user))).select("person_id", F.col("key").alias("handle"))
    one = handles.join(sorted_joins(p.distinct()), ["person_id", "handle"]).groupBy("person_id").agg(F.min_by("handle", "o").alias("key"))
    tags = x["_tags"]
    comment = F.when(F.array_contains(tags, "comment"), True).when(F.array_contains(tags, "story"), False).otherwise(_given(x["comment_text"]).isNotNull() & _given(x["title"]).isNull())
    theirs = hits("author").drop("who").join(sorted_joins(one), ["person_id", "key"]).where(x["author"] == F.col("key")).withColumn("comment", F.coalesce(comment, F.lit(False)))
    k = F.row_number().over(Window.partitionBy("person_id", "comment").orderBy("ordinal", "pos"))
    theirs = theirs.withColumn("k", k).where(~F.col("comment") | (F.col("k") <= COMMENTS)).drop("k")
    both = by_name.withColumn("comment", F.coalesce(comment, F.lit(False))).withColumn("branch", F.lit(0)).unionByName(theirs.withColumn("branch", F.lit(1) + F.col("comment").cast("int")))
    item = lambda c: F.concat(F.lit("https://news.ycombinator.com/item?id="), _given(c))
    story = F.coalesce(_given(x["story_title"]), _given(x["title"]))
    title = F.when(F.col("comment"), F.coalesce(F.concat(F.lit("Comment on “"), story, F.lit("”")), F.lit("Comment on Hacker News"))).otherwise(F.coalesce(_given(x["title"]), x["story_title"], F.lit("")))
    said = text_block(F.coalesce(F.concat(F.lit("Hacker News comment by "), _given(x["author"]), F.lit(".")), F.lit("Hacker News comment.")), F.concat(F.lit("In the discussion of “"), story, F.lit("”.")),
                      F.concat(F.lit("Story: "), item(x["story_id"])), x["comment_text"])
    told = text_block(title, _labelled("Submitted by ", x["author"]), F.format_string("%d points, %d comments.", F.coalesce(x["points"], F.lit(0)), F.coalesce(x["num_comments"], F.lit(0))),
                      _labelled("Links to ", F.coalesce(_given(x["url"]), x["story_url"])), F.coalesce(_given(x["story_text"]), x["comment_text"]))
    return _docs(both, "hn", [F.col("branch"), F.col("ordinal"), F.col("pos")], item(F.coalesce(_given(x["objectID"]), x["story_id"])), title, F.when(F.col("comment"), said).otherwise(told),
                 parse_date(F.coalesce(_given(x["created_at"]), x["created_at_i"])))


def wayback(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'captures' answers (ordinal: pattern; a list of lists, with a header row or the usual columns) of own addresses that hold
    documents, the best capture of a digest in its first place; the document is the 'page' answer (key: replay address)."""
    c = _said(people, answers, "wayback", "captures").withColumn("rows", F.from_json("body", "array<array<string>>"))
    first = F.get("rows", F.lit(0))
    headed = F.coalesce(F.array_contains(first, "timestamp"), F.lit(False))
    c = c.withColumn("head", F.when(headed, first).otherwise(F.array(*map(F.lit, CDX)))).withColumn("body_rows", F.when(headed, F.slice("rows", 2, F.greatest(F.size("rows"), F.lit(1)))).otherwise(F.col("rows")))
    c = c.select("person_id", "who", "ordinal", "head", F.posexplode("body_rows").alias("pos", "r")).where(F.size("r") >= F.size("head"))
    at = lambda name: F.try_element_at("r", F.nullif(F.array_position("head", name), F.lit(0)).cast("int"))
    c = c.select("person_id", "who", "ordinal", "pos", *(at(n).alias(n) for n in ("timestamp", "original", "mimetype", "statuscode", "digest")))
    kind = F.lower(F.trim(F.substring_index(F.coalesce("mimetype", F.lit("")), ";", 1)))
    c = c.where((F.coalesce("timestamp", F.lit("")) != "") & R.on_own_host(F.col("original"), F.col("who.urls")) & ~reduce(lambda a, b: a | b, (F.startswith(kind, F.lit(m)) for m in NO_DOCUMENT)))
    digest = F.coalesce(_given(F.col("digest")), F.concat(F.lit("#"), "pos"))
    best = F.struct((F.trim(F.coalesce("statuscode", F.lit(""))) == "200").alias("ok"), "timestamp", (-F.col("pos")).alias("first"))
    c = c.groupBy("person_id", "ordinal", digest.alias("d")).agg(F.max_by(F.struct("timestamp", "original", "digest"), best).alias("r"), F.min("pos").alias("pos"))
    c = c.withColumn("key", F.concat(F.lit("https://web.archive.org/web/"), "r.timestamp", F.lit("/"), "r.original"))
    page = answers.where("kind = 'wayback' and endpoint = 'page' and body is not null").groupBy("person_id", "key").agg(F.min("body").alias("html"))
    d = c.join(page, ["person_id", "key"]).withColumn("p", markup.page("html"))
    seen = F.coalesce(_given(F.col("r.digest")), F.concat(F.lit("#"), "ordinal", F.lit("#"), "pos"))
    d = first_per(d.where(_given(F.col("p.text")).isNotNull()), ["person_id", seen], ["ordinal", "pos"], 1)
    return _docs(d, "wayback", [F.col("ordinal"), F.col("pos")], F.col("key"), F.coalesce(F.col("p.title"), F.lit("")), F.col("p.text"), parse_date(F.col("r.timestamp")))


def capture_patterns(people: DataFrame) -> DataFrame:
    """(person_id, ordinal, pattern) to ask an archive for: a whole own host, or the path on a shared one."""
    u = people.select("person_id", F.posexplode("who.urls").alias("ordinal", "u")).withColumn("h", R.raw_host(F.col("u"))).withColumn("p", F.rtrim(F.coalesce(F.try_parse_url("u", F.lit("PATH")), F.lit("")), F.lit("/")))
    pattern = F.when(~R.is_shared_host(F.col("h")), F.concat("h", F.lit("/*"))).when(F.col("p") != "", F.concat("h", "p", F.lit("*")))
    return u.select("person_id", "ordinal", pattern.alias("pattern")).where("pattern is not null").groupBy("person_id", "pattern").agg(F.min("ordinal").alias("ordinal"))


def search(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """'results' answers; the result page ('html') only for people whose first source gave no answer, not for those it gave
    an empty one."""
    r = _said(people, answers, "search", "results").withColumn("l", F.from_json("body", "results array<struct<url:string,title:string,content:string,raw_content:string,published_date:string>>")["results"]).where("l is not null")
    h = _said(people, answers, "search", "html").join(sorted_joins(r.select("person_id").distinct()), "person_id", "left_anti")
    a = r.select("person_id", "who", "ordinal", F.posexplode("l").alias("pos", "x")).select("person_id", "who", "ordinal", "pos", "x.url", "x.title", F.coalesce(_given(F.col("x.raw_content")), F.col("x.content")).alias("content"), F.col("x.published_date").alias("day"))
    b = h.select("person_id", "who", "ordinal", F.posexplode_outer(markup.results("body")).alias("pos", "x")).where("pos is not null").select("person_id", "who", "ordinal", "pos", unwrap_redirect(F.col("x.url")).alias("url"), "x.title", "x.content", _none().alias("day"))
    d = a.unionByName(b)
    d = d.where(R.identifies(F.col("who"), _texts(_none()), _texts(F.col("title"), F.col("content")), _texts(F.col("url")), _texts(F.col("url"))))
    return _docs(d, "search", [F.col("ordinal"), F.col("pos")], F.col("url"), F.coalesce("title", F.lit("")), text_block(F.col("title"), F.col("content")), parse_date(F.col("day")))


def official_sites(people: DataFrame, answers: DataFrame) -> DataFrame:
    """(person_id, seed) of people without an address of their own: the website of the one human item that carries the name and
    echoes a roster term; ties decline."""
    few = people.where(F.size("who.urls") == 0)
    c = first_per(_candidates(few, answers, "self_page"), ["person_id"], ["place"], 5).join(_entities(answers, "self_page"), ["person_id", "qid"]).where(_is_human(F.col("e")))
    said = lambda f: F.transform(F.map_values(F.col(f"e.{f}")), lambda v: v["value"])
    aliases = F.flatten(F.transform(F.map_values(F.col("e.aliases")), lambda l: F.transform(l, lambda v: v["value"])))
    c = c.withColumn("points", R.echoes(F.col("who.terms"), said("labels"), said("descriptions"), aliases, claim_values(F.col("e"), "P856")))
    one = choose_one(c, ["person_id"], "qid", "points", corroborated=True).select("person_id", F.col("chosen").alias("qid"))
    site = F.get(F.filter(claim_values(F.col("e"), "P856"), lambda v: v.rlike("^https?://")), F.lit(0))
    return c.join(sorted_joins(one), ["person_id", "qid"]).select("person_id", site.alias("seed")).where("seed is not null").dropDuplicates(["person_id"])


def _in_space(url: Column, base: Column, seed: Column) -> Column:
    """Whether a link stays on its page's host and, on a shared host, under the seed's path."""
    root = F.rtrim(F.coalesce(F.try_parse_url(seed, F.lit("PATH")), F.lit("")), F.lit("/"))
    path = F.coalesce(F.try_parse_url(url, F.lit("PATH")), F.lit(""))
    under = (root != "") & ((path == root) | F.startswith(path, F.concat(root, F.lit("/"))))
    return F.coalesce(url.rlike("^https?://") & (R.raw_host(url) == R.raw_host(base)) & (~R.is_shared_host(R.raw_host(url)) | under), F.lit(False))


def self_page(people: DataFrame, answers: DataFrame, budget: int = BUDGET) -> DataFrame:
    """Own pages: seeds from the roster or the official website, then entries of feeds that a seed advertises, links or is likely
    to have, then links one hop away. 'page' and 'feed' answers have the address as key. Entries with 40 characters or more
    stand for themselves, others for their page."""
    html = answers.where("kind = 'self_page' and endpoint = 'page' and body is not null").groupBy("person_id", F.col("key").alias("url")).agg(F.min("body").alias("html"))
    pages = sorted_joins(cut(html.withColumn("p", markup.page_at("url", "html")).drop("html")))
    seeds = people.select("person_id", F.posexplode("who.urls").alias("s", "seed")).unionByName(official_sites(people, answers).withColumn("s", F.lit(0)))
    at_seed = seeds.withColumn("url", F.col("seed")).join(pages, ["person_id", "url"]).where(~markup.is_feed_url(F.col("url")))
    first = at_seed.select("person_id", F.array(F.lit(0), "s", F.lit(0), F.lit(0)).alias("o"), "url", F.col("p.title").alias("title"), F.col("p.text").alias("text"), F.lit(None).cast("date").alias("day"))
    guess = F.when(~R.is_shared_host(R.raw_host(F.col("url"))), F.array(markup.conventional_feed(F.col("url")))).otherwise(F.array().cast("array<string>"))
    offered = F.concat(F.col("p.feeds"), F.filter("p.links", markup.is_feed_url), guess)
    found = at_seed.select("person_id", "s", "seed", "url", F.posexplode(offered).alias("k", "feed")).where((_in_space(F.col("feed"), F.col("url"), F.col("seed"))) | (F.col("feed") == markup.conventional_feed(F.col("url")))).drop("url")
    found = found.unionByName(seeds.where(markup.is_feed_url(F.col("seed"))).select("person_id", "s", "seed", F.lit(-1).alias("k"), F.col("seed").alias("feed")))
    found = found.groupBy("person_id", "feed").agg(F.min(F.struct("s", "k", "seed")).alias("f")).select("person_id", "feed", "f.*")
    feeds = answers.where("kind = 'self_page' and endpoint = 'feed' and body is not null").groupBy("person_id", F.col("key").alias("feed")).agg(F.min("body").alias("xml"))
    e = found.join(feeds, ["person_id", "feed"]).select("person_id", "feed", "seed", "s", "k", F.posexplode_outer(markup.feed("xml")).alias("j", "e")).where("j is not null")
    e = e.where(_in_space(F.col("e.url"), F.col("feed"), F.col("seed")) & ~markup.is_feed_url(F.col("e.url")))
    e = e.withColumn("body", F.when(F.contains("e.summary", F.lit("<")), markup.page("e.summary")["text"]).otherwise(F.col("e.summary")))
    e = e.withColumn("text", text_block(F.col("e.title"), F.col("body"))).withColumn("url", F.col("e.url")).join(pages, ["person_id", "url"], "left")
    long = F.char_length("text") >= MIN_ENTRY
    order = F.array(F.lit(1), F.col("s") * 100_000 + F.col("k") + 1, F.col("j"), F.lit(0))
    entries = e.select("person_id", order.alias("o"), "url", F.when(long, F.col("e.title")).otherwise(F.col("p.title")).alias("title"), F.when(long, F.col("text")).otherwise(F.col("p.text")).alias("text"), parse_date(F.col("e.published")).alias("day"))
    links = at_seed.select("person_id", "s", "seed", F.col("url").alias("base"), F.posexplode("p.links").alias("k", "url"))
    skip = reduce(lambda a, b: a | b, (F.contains(F.lower(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit(""))), F.lit(x)) for x in SKIPPED))
    links = links.where(_in_space(F.col("url"), F.col("base"), F.col("seed")) & ~markup.is_feed_url(F.col("url")) & ~skip).join(pages, ["person_id", "url"])
    followed = links.select("person_id", F.array(F.lit(2), "s", "k", F.lit(0)).alias("o"), "url", F.col("p.title").alias("title"), F.col("p.text").alias("text"), F.lit(None).cast("date").alias("day"))
    d = first.unionByName(entries).unionByName(followed).where("text <> ''")
    return d.select("person_id", F.lit("self_page").alias("kind"), F.col("o").cast("array<long>").alias("at"), "url", F.coalesce("title", F.lit("")).alias("title"), "text", F.col("day").alias("published_at"))


#: Readers in display order: the order is the priority.
CONNECTORS = {"self_page": self_page, "wikipedia": wikipedia, "wikidata": wikidata, "github": github, "openalex": openalex, "edgar": edgar,
              "propublica": propublica, "hn": hn, "wayback": wayback, "search": search}


def finalise(docs: DataFrame, budget: int = BUDGET) -> DataFrame:
    """The contract of all readers, with doc_id and ordinal (from 0 per person and kind)."""
    d = docs.where(F.col("url").rlike("^https?://") & F.col("text").rlike(r"\S")).withColumn("doc_id", doc_id(F.col("url")))
    d = first_per(d, ["person_id", "kind", "doc_id"], ["at", "title", "text"], 1)
    n = F.row_number().over(Window.partitionBy("person_id", "kind").orderBy("at", "doc_id")) - 1
    return d.withColumn("ordinal", n).where(F.col("ordinal") < budget).select(
        "person_id", "kind", "ordinal", "doc_id", "url", F.substring(F.coalesce("title", F.lit("")), 1, MAX_TITLE).alias("title"), clip(F.col("text")).alias("text"), "published_at")


def gather(people: DataFrame, answers: DataFrame, kinds: tuple[str, ...] = tuple(CONNECTORS), budget: int = BUDGET) -> DataFrame:
    """Documents of all the readers, which share roster lines parsed once and cut off; a budget of 0 or less has none. A source that failed has no answers, hence no rows."""
    who = cut(known(people))
    # what readers need of it
    who, answers = sorted_joins(who.select("person_id", F.struct("who.name", "who.urls", "who.terms").alias("who"))), sorted_joins(answers)
    union = reduce(DataFrame.unionByName, (CONNECTORS[k](who, answers, max(budget, 0)) for k in kinds))
    return finalise(union, budget)
