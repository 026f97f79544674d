"""Resolver details, hub extraction and exclusion match by match on invented rows."""

from pyspark.sql import functions as F

from kinweave.functions import roster
from kinweave.operators import evidence, exclusion, identity

DETAILS = ["co-founder, Pelm Works", "Austin, Texas", "teaches quilting"]


def who(spark):
    return spark.createDataFrame([("a", "Ann Lee", DETAILS), ("z", "Zoe Orr", [])], "person_id string, name string, details array<string>").select("person_id", "details", roster.roster("name", "details").alias("who"))


def test_verdict_attributes_and_claims(spark):
    rows = [("Ann of Pelm Works in Austin, Texas", "employer", ["employer", "city"], "employer", False), ("she quilting teaches", "hobby", ["detail:teaches-quilting"], "detail:teaches-quilting", False),
            ("nothing", "her firm", ["employer"], "employer", False), ("nothing", "shoe size", ["other"], "other", False), (None, "", [], "", False),
            ("Employer: Other Corp. City: Austin, Texas", "", ["city"], "city", True), ("Company: unknown. Location: n/a", "", [], "", False)]
    df = spark.createDataFrame(rows, "e string, d string, attrs array<string>, first string, contra boolean").crossJoin(who(spark).where("person_id = 'a'"))
    got = df.select("e", "attrs", "first", "contra", identity.verdict_attributes(F.col("who"), F.col("e"), F.col("d")).alias("a"), "d", identity.contradicts(F.col("who"), F.col("e")).alias("c"))
    for r in got.withColumn("p", identity.primary_attribute(F.col("a"), F.col("d"))).collect():
        assert (r.a, r.p, r.c) == (r.attrs, r["first"], r.contra), r


def test_strong_keys(spark):
    docs = [("wikidata", "https://www.wikidata.org/wiki/Q42", "Ann Lee (Q42)", "Ann Lee, employer: Pelm Works"), ("wikidata", "https://www.wikidata.org/wiki/Q43", "Ann Lee (Q43)", "singer"),
            ("github", "https://github.com/annlee", "t", "Name: Ann Lee\nCompany: Pelm Works\nLocation: Austin, Texas"), ("github", "https://github.com/other", "t", "Name: Ann Lee\nCompany: unset"),
            ("edgar", "https://sec.gov/x", "Form 4", "Ann Lee CIK 0001234567; Pelm Works CIK 0007654321"), ("search", "https://blog.pelmworks.com/x", "x", "Ann Lee"), (None, None, None, None)]
    d = spark.createDataFrame([("a", *x) for x in docs], "person_id string, kind string, url string, title string, text string")
    got = identity.strong_keys(identity.key_candidates(who(spark), d)).collect()
    assert [r.strong_keys for r in got] == [{"wikidata_qid": "Q42", "company_domain": "pelmworks.com", "github": "annlee", "sec_cik": "0001234567"}]


FACT = "person_id string, batch_no long, doc_id string, fact_id string, text string, quote string"
DOC = "person_id string, batch_no long, doc_id string, kind string, url string, title string, text string, published_at date"


def test_hubs(spark):
    docs = spark.createDataFrame([("a", 0, "d1", "search", "u", "Loom Fund", "Ann works in supply chain at Loom Fund.", None), ("a", 0, "d2", "wikidata", "https://w/Q9", "Dye Club", "Dye Club (Q9) in Austin", None), ("a", 0, "d3", "search", "u", "t", "Dye Club again", None)], DOC)
    facts = spark.createDataFrame([("a", 0, "d1", "d1-f0", "Ann backs Loom Fund", "q"), ("a", 0, "d2", "d2-f0", "Ann founded Dye Club", "q"), ("a", 0, "d3", "d3-f0", "Ann left", "q")], FACT)
    c = [("Loom Fund", "investor", None, "", False, []), ("Dye Club", "company", "q9", "d2", False, ["d2-f0"]), ("Dye Club", "company", "Q1", "", False, ["d2-f0"]), ("Dye Club", "company", None, "", False, []),
         ("modern supply chain work", "topic", None, "", True, ["d1-f0"]), ("business", "topic", None, "", False, ["d1-f0"]), ("knitting", "topic", None, "", True, ["d1-f0"]), (None, "topic", None, "", False, [])]
    cands = spark.createDataFrame([("a", 0, i, *x) for i, x in enumerate(c)], "person_id string, batch_no long, cand_ordinal long, label string, type string, qid string, doc_id string, is_field boolean, claimed array<string>")
    got = {r.cand_ordinal: r for r in evidence.collect_hubs(cands, facts, docs, "2025-01-01").collect()}
    assert sorted(got) == [0, 1, 2, 4] and got[0].evidence == ["d1-f0"] and got[1].qid == "Q9" and got[2].qid is None and got[4].label == "supply chain" and got[4].type == "topic" and got[0].recency == 0.5
    hubs = spark.createDataFrame([("a", "city:rome", "Rome", "city", 1.0, ["x"]), ("a", "company:p", "P", "company", 1.0, ["x"]), ("z", "city:rome", "Rome", "city", 1.0, ["x"])], "person_id string, hub_id string, label string, type string, recency double, evidence array<string>")
    places = spark.createDataFrame([("a", "Austin, Texas"), ("a", "Rome"), ("z", "Rome"), ("a", None)], "person_id string, based_in string")
    got = {(r.person_id, r.hub_id): r.evidence for r in evidence.place_hubs(hubs, places, who(spark), facts, docs, "2025-01-01").collect()}
    assert got == {("a", "company:p"): ["x"], ("a", "city:austin"): ["d2-f0"], ("z", "city:rome"): ["x"]}


def test_exclusion_match_by_match(spark):
    rows = [("Ann builds chemotherapy pumps and chemotherapy apps.", "keep"), ("Ann builds pumps. She had chemotherapy.", "exclude"), ("Ann had chemotherapy and a company.", "exclude"),
            ("Chemotherapy planning software is what Ann sells; chemotherapy followed.", "exclude"), ("chemotherapy research", "keep"), ("", "keep"), (None, "keep")]
    df = spark.createDataFrame(rows, "t string, w string")
    for r in df.withColumn("g", exclusion.rule_verdict(F.col("t"))["decision"]).collect():
        assert r.w == r.g, r


def test_people_and_their_documents_are_not_broadcast(spark):
    """Tables that grow with the people, and a plan that does not repeat the evidence for every later use."""
    from kinweave.plans import catalogue

    plan = lambda name: catalogue.queries()[name](spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    hubs = plan("hub_evidence")
    assert "Broadcast" not in hubs + plan("verdict_attributes") + plan("strong_keys") and hubs.count("SortMergeJoin") < 20
    assert "Join" not in plan("verdict_attributes")
