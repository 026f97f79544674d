"""Cited facts and hubs from candidate answers."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import numbers as N
from kinweave.functions.text import folded, holds_folded, holds_phrase, is_cited, is_evidence, sentence, slug
from kinweave.operators.components import cut, sorted_joins
from kinweave.operators.elections import elect, unambiguous

#: Longest fact, generic hub labels, field hubs kept per person.
MAX_FACT_CHARS, MAX_FIELD_HUBS = 200, 2
STOP_LABELS = ("texas", "startup", "founder", "ai", "technology", "business", "ceo", "investor")
#: The fields of work that a hub may name.
FIELDS = ("venture capital", "private equity", "angel investing", "developer tools", "consumer social", "social media", "enterprise software", "open source",
          "cloud infrastructure", "information security", "digital health", "life sciences", "climate tech", "financial technology", "online marketplaces", "video games",
          "creative software", "online education", "digital media", "consumer hardware", "supply chain", "public policy")


def collect_facts(candidates: DataFrame, docs: DataFrame) -> DataFrame:
    """candidates(person_id, batch_no, cand_ordinal, doc_id, text, quote, category, confidence) to facts.

    A candidate goes if text or quote is blank, the text too long, or no document of its batch holds the quote. The
    declared document is preferred; else the only one of its batch that holds it; several are refused. Documents
    meet candidates by (person_id, batch_no), never all with all, folded before they meet. fact_id counts kept facts per document.
    """
    c = candidates.withColumn("text", sentence(F.col("text"))).where((F.col("text") != "") & (F.trim("quote") != "") & (F.char_length("text") <= MAX_FACT_CHARS))
    key = ["person_id", "batch_no", "cand_ordinal"]
    d = docs.select("person_id", "batch_no", F.col("doc_id").alias("source_id"), folded(F.col("text")).alias("folded_text"))
    q = c.where(is_evidence(F.col("quote"))).select(*key, "doc_id", folded(F.col("quote")).alias("folded_quote"))
    held = q.join(d, ["person_id", "batch_no"]).where(holds_folded(F.col("folded_text"), F.col("folded_quote")))
    found = held.groupBy(*key).agg(F.count("*").alias("n"), F.min("source_id").alias("only"), F.bool_or(F.col("source_id") == F.col("doc_id")).alias("declared"))
    kept = c.join(found, key).where(F.col("declared") | (F.col("n") == 1)).withColumn("doc_id", F.when(F.col("declared"), F.col("doc_id")).otherwise(F.col("only")))
    return number_facts(kept, ["batch_no", "cand_ordinal"]).drop("n", "only", "declared")


def number_facts(kept: DataFrame, order: list[str]) -> DataFrame:
    """kept with a fact_id that counts a person's facts of a document in order, from 0."""
    k = F.row_number().over(Window.partitionBy("person_id", "doc_id").orderBy(*order)) - 1
    return kept.withColumn("fact_id", F.concat("doc_id", F.lit("-f"), k.cast("string")))


def still_cited(facts: DataFrame, docs: DataFrame) -> DataFrame:
    """facts(person_id, fact_id, doc_id, quote) with whether their document, as it is now, still holds the quotation."""
    d = docs.select("person_id", "doc_id", F.col("text").alias("__text"))
    return facts.join(d, ["person_id", "doc_id"], "left").withColumn("cited", F.coalesce(is_cited(F.col("quote"), F.col("__text")), F.lit(False))).drop("__text")


def drop_counters(candidates: DataFrame) -> DataFrame:
    """How many candidates each rule would drop, in one pass."""
    text = sentence(F.col("text"))
    return candidates.agg(F.count("*").alias("seen"), F.count_if(F.coalesce(text, F.lit("")) == "").alias("blank_text"),
                          F.count_if(F.coalesce(F.trim("quote"), F.lit("")) == "").alias("blank_quote"), F.count_if(F.char_length(text) > MAX_FACT_CHARS).alias("too_long"))


def id_map(claims: DataFrame, own: DataFrame) -> DataFrame:
    """claims(batch_no, claimed_id, fact_id) that name one fact and shadow none of our own ids."""
    one = claims.groupBy("batch_no", "claimed_id").agg(F.count_distinct("fact_id").alias("n"), F.min("fact_id").alias("fact_id")).where("n = 1").drop("n")
    return one.join(own.select(F.col("fact_id").alias("claimed_id")).distinct(), "claimed_id", "left_anti")


def merge_hubs(hubs: DataFrame) -> DataFrame:
    """hubs(person_id, batch_no, cand_ordinal, label, type, qid, recency, is_field, evidence) to one row per person and slugged
    label: elected type and label, the QID if one leads, largest recency, evidence in order. Generic labels go."""
    h = hubs.where(~F.lower(F.trim("label")).isin(*STOP_LABELS)).withColumn("key", slug(F.col("label"))).where("key <> ''")
    listed = F.array_sort(F.collect_list(F.struct("batch_no", "cand_ordinal", "evidence")))
    g = h.groupBy("person_id", "key").agg(F.mode("type", True).alias("type"), F.mode("label", True).alias("label"), F.max("recency").alias("recency"),
        F.bool_or("is_field").alias("is_field"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x["evidence"]))).alias("evidence"), F.min(F.struct("batch_no", "cand_ordinal")).alias("first"))
    q = unambiguous(h.where("qid is not null"), ["person_id", "key"], "qid")
    g = g.join(sorted_joins(q), ["person_id", "key"], "left")
    return g.withColumn("hub_id", F.coalesce(F.concat(F.lit("wd:"), "qid"), F.concat("type", F.lit(":"), "key")))


def field_budget(hubs: DataFrame, most: int = MAX_FIELD_HUBS) -> DataFrame:
    """At most `most` field hubs per person, best evidenced first; other hubs all stay."""
    w = Window.partitionBy("person_id", "is_field").orderBy(F.desc(F.size("evidence")), "first", "hub_id")
    return hubs.withColumn("__n", F.row_number().over(w)).where(~F.col("is_field") | (F.col("__n") <= most)).drop("__n")


def supported_hubs(hubs: DataFrame, facts: DataFrame) -> DataFrame:
    """Hubs without those whose known evidence is all excluded; excluded ids leave the others' evidence."""
    e = hubs.select("person_id", "hub_id", F.posexplode_outer("evidence").alias("at", "fact_id")).join(facts.select("person_id", "fact_id", "excluded"), ["person_id", "fact_id"], "left")
    keep = F.transform(F.array_sort(F.collect_list(F.when(F.col("fact_id").isNotNull() & ~F.coalesce("excluded", F.lit(False)), F.struct("at", "fact_id")))), lambda x: x["fact_id"])
    per = e.groupBy("person_id", "hub_id").agg(keep.alias("evidence"), F.count("excluded").alias("known"), F.count_if("excluded").alias("gone"))
    return hubs.drop("evidence").join(per.where("known = 0 or gone < known").select("person_id", "hub_id", "evidence"), ["person_id", "hub_id"])


def hub_recency(evidence: DataFrame, today: str) -> DataFrame:
    """Largest recency over a hub's evidence documents (person_id, hub_id, published_at)."""
    return evidence.groupBy("person_id", "hub_id").agg(F.max(N.recency(F.col("published_at"), F.lit(today).cast("date"))).alias("recency"))


def field_label(label: Column) -> Column:
    """The longest field of work that a label names, the first of equals, or null."""
    return F.coalesce(*(F.when(holds_phrase(label, F.lit(t)), F.lit(t)) for t in sorted(FIELDS, key=lambda t: (-len(t), t))))


def collect_hubs(candidates: DataFrame, facts: DataFrame, docs: DataFrame, today: str) -> DataFrame:
    """candidates(person_id, batch_no, cand_ordinal, label, type, qid, doc_id, is_field, claimed) to hubs for merge_hubs().

    facts(person_id, batch_no, doc_id, fact_id, text, quote) are kept facts, docs(person_id, batch_no, doc_id, kind, url, title,
    text, published_at) their documents. Generic labels go; a field hub takes its vocabulary term. Claimed facts are the
    evidence, for a field hub only where their document states the label. Without any, the declared document that states
    it, else the only one of the batch, lends its facts that mention it. No evidence, no hub. A QID stands if the
    evidence states it and no other as often. Documents meet candidates by person and batch. The evidence found is cut off: the
    plan would hold it once for every later use.
    """
    key = ["person_id", "batch_no", "cand_ordinal"]
    facts, docs = sorted_joins(facts), sorted_joins(docs)
    c = candidates.withColumn("label", sentence(F.col("label"))).where(~F.lower("label").isin(*STOP_LABELS))
    c = c.withColumn("label", F.when(F.col("is_field"), field_label(F.col("label"))).otherwise(F.col("label"))).withColumn("type", F.when(F.col("is_field"), "topic").otherwise(F.col("type")))
    c = c.where(F.coalesce(slug(F.col("label")), F.lit("")) != "").withColumn("qid", F.upper(F.trim("qid"))).withColumn("qid", F.when(F.col("qid").rlike(r"^Q\d+$"), F.col("qid")))
    states = holds_phrase(F.concat_ws("\n", "d.title", "d.text"), F.col("c.label"))
    d, f = docs.alias("d"), facts.alias("f")
    # (candidate, document) pairs of one batch, each with whether the document states the label
    pairs = c.alias("c").join(d, ["person_id", "batch_no"]).select(*key, F.col("d.doc_id").alias("source"), states.alias("states"), (F.col("d.doc_id") == F.trim("c.doc_id")).alias("declared"))
    said = c.select(*key, "is_field", F.posexplode("claimed").alias("at", "fact_id")).join(facts.select("person_id", "batch_no", "fact_id", F.col("doc_id").alias("source")), ["person_id", "batch_no", "fact_id"])
    said = said.join(sorted_joins(pairs.select(*key, "source", "states")), [*key, "source"]).where("not is_field or states").select(*key, "at", "fact_id", "source", "states")
    lone = c.join(sorted_joins(said.select(*key).distinct()), key, "left_anti")
    source = pairs.where("states").groupBy(*key).agg(F.count("*").alias("n"), F.min("source").alias("only"), F.max(F.when(F.col("declared"), F.col("source"))).alias("own")).where("own is not null or n = 1")
    lent = lone.join(sorted_joins(source), key).withColumn("source", F.coalesce("own", "only")).alias("c").join(f, (F.col("c.person_id") == F.col("f.person_id")) & (F.col("c.batch_no") == F.col("f.batch_no")) & (F.col("c.source") == F.col("f.doc_id")))
    lent = lent.where(holds_phrase(F.concat_ws("\n", "f.text", "f.quote"), F.col("c.label"))).select(*(F.col(f"c.{k}").alias(k) for k in key), F.lit(0).alias("at"), F.col("f.fact_id").alias("fact_id"), F.col("c.source").alias("source"), F.lit(True).alias("states"))
    e = said.unionByName(lent)
    source_docs = docs.select("person_id", "batch_no", F.col("doc_id").alias("source"), "kind", "url", "title", "text", "published_at")
    e = cut(e.join(source_docs, ["person_id", "batch_no", "source"]))
    found = F.transform(F.regexp_extract_all(F.concat_ws("\n", "url", "title", "text"), F.lit(r"(?i)\b(Q\d+)\b"), F.lit(1)), F.upper)
    votes = e.where("kind = 'wikidata'").select(*key, "states", F.explode(F.array_distinct(found)).alias("q")).groupBy(*key, "q").agg(F.count_if("states").alias("n"))
    win = votes.withColumn("top", F.max("n").over(Window.partitionBy(*key))).where("n = top").groupBy(*key).agg(F.count("*").alias("k"), F.min("q").alias("winner")).where("k = 1").select(*key, "winner")
    per = e.groupBy(*key).agg(F.array_distinct(F.transform(F.array_sort(F.collect_list(F.struct("at", "fact_id"))), lambda x: x["fact_id"])).alias("evidence"),
                              F.max(N.recency(F.col("published_at"), F.lit(today).cast("date"))).alias("recency"))
    return c.join(sorted_joins(per), key).join(sorted_joins(win), key, "left").select(*key, "label", "type", F.when(F.col("qid") == F.col("winner"), F.col("qid")).alias("qid"), "recency", F.coalesce("is_field", F.lit(False)).alias("is_field"), "evidence")


def place_hubs(hubs: DataFrame, places: DataFrame, people: DataFrame, facts: DataFrame, docs: DataFrame, today: str) -> DataFrame:
    """hubs(person_id, hub_id, label, type, recency, evidence) with the roster's own place for proposed cities.

    places(person_id, based_in) are claims, confirmed where the details state them; the most common one counts. Its leading
    segment, else the whole, becomes a city hub if a fact's document states it, with the facts that mention it or
    else all of those documents' facts. A person without a confirmed place keeps the proposed cities.
    """
    claim = places.withColumn("place", sentence(F.col("based_in"))).join(people.select("person_id", F.array_join("details", "\n").alias("lines")), "person_id")
    place = elect(claim.where(holds_phrase(F.col("lines"), F.col("place"))), ["person_id"], "place")
    tries = place.select("person_id", F.posexplode(F.array_distinct(F.array(sentence(F.substring_index("place", ",", 1)), "place"))).alias("i", "label")).where(F.coalesce(slug(F.col("label")), F.lit("")) != "")
    f = facts.select("person_id", "fact_id", "doc_id", F.concat_ws("\n", "text", "quote").alias("said")).join(docs.select("person_id", "doc_id", F.concat_ws("\n", "title", "text").alias("whole"), "published_at").dropDuplicates(["person_id", "doc_id"]), ["person_id", "doc_id"])
    e = tries.join(f, "person_id").where(holds_phrase(F.col("whole"), F.col("label"))).withColumn("spoken", holds_phrase(F.col("said"), F.col("label")))
    at = lambda c: F.when(F.max("spoken"), F.max(F.when(F.col("spoken"), c))).otherwise(F.max(c))
    ids = lambda cond: F.array_sort(F.collect_set(F.when(cond, F.col("fact_id"))))
    recency = N.recency(F.col("published_at"), F.lit(today).cast("date"))
    g = e.groupBy("person_id", "i", "label").agg(at(recency).alias("recency"), F.when(F.max("spoken"), ids(F.col("spoken"))).otherwise(ids(F.lit(True))).alias("evidence"))
    best = g.groupBy("person_id").agg(F.min_by(F.struct("label", "recency", "evidence"), "i").alias("b"))
    mine = best.select("person_id", F.concat(F.lit("city:"), slug(F.col("b.label"))).alias("hub_id"), F.col("b.label").alias("label"), F.lit("city").alias("type"), F.col("b.recency").alias("recency"), F.col("b.evidence").alias("evidence"))
    kept = hubs.join(place.select("person_id", F.lit(True).alias("confirmed")), "person_id", "left").where("type <> 'city' or confirmed is null").drop("confirmed")
    return kept.select(*mine.columns).unionByName(mine)
