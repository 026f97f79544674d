"""Entity resolution over judged documents."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from kinweave.functions.numbers import clamp01
from kinweave.functions.text import carries_name, cites_document, mentions_name, mentions_tokens, normalize_ws
from kinweave.operators.components import sorted_joins

#: Attribute families in the order they are tried, and strong keys by priority.
FAMILIES = {
    "employer": ("employer", "company", "organisation", "organization", "workplace", "firm", "employment", "employed"),
    "city": ("city", "location", "town", "where they live", "lives in", "based in", "residence", "hometown", "home town"),
    "role": ("role", "title", "occupation", "position", "profession", "job", "post"),
    "handle": ("handle", "username", "user name", "screen name", "nickname", "alias", "login", "profile"),
    "school": ("school", "university", "college", "alma mater", "education", "degree", "alumni"),
    "coauthor": ("coauthor", "co-author", "co author", "collaborator", "coauthorship"),
}
STRONG_KEYS = ("wikidata_qid", "company_domain", "github", "sec_cik")
#: Labels that claim an attribute, all labels that end a claim, what a field says when it is unset, and filer numbers.
CLAIMS = {"employer": ("employer", "company", "workplace"), "city": ("work location", "location", "city")}
LABELS = ("employer", "company", "workplace", "work location", "location", "city", "name", "occupation", "instance of", "country of citizenship", "title", "relationship", "issuer")
UNSET = ("", "-", "n/a", "na", "none", "not set", "unset", "unknown", "null")
CIK = r"(?i)\bCIK(?:\s+of\s+[a-z ]+)?\s*[:#]?\s*(\d{6,12})\b"


def attribute_family(label: Column) -> Column:
    """The attribute a free-text label names; unknown labels keep their normalised spelling, blank ones are ''."""
    text = F.coalesce(normalize_ws(label), F.lit(""))
    out = F.when(text == "", "")
    for family, words in FAMILIES.items():
        out = out.when(F.exists(F.array(*map(F.lit, words)), lambda w: F.contains(text, w)), family)
    return out.otherwise(text)


def corroboration(terms: Column, haystack: Column) -> Column:
    """How many roster terms a text echoes."""
    hay = normalize_ws(haystack)
    return F.size(F.filter(terms, lambda t: (normalize_ws(t) != "") & F.contains(hay, normalize_ws(t))))


def identifies(name: Column, label: Column, prose: Column, terms: Column, context: Column, own_host: Column) -> Column:
    """The identity gate: an own-host address settles it; else the name must be carried and a roster term echoed."""
    return F.coalesce(own_host, F.lit(False)) | ((carries_name(name, label) | mentions_name(name, prose)) & (corroboration(terms, context) >= 1))


def police_verdicts(docs: DataFrame, verdicts: DataFrame) -> DataFrame:
    """One verdict per document (person_id, doc_id): unknown matches and evidence that the text does not hold become unsure,
    confidence is held in 0..1, a missing answer is unsure with 0."""
    d = docs.select("person_id", "doc_id", "text").join(verdicts, ["person_id", "doc_id"], "left")
    known = F.coalesce(F.col("match").isin("yes", "no", "unsure"), F.lit(False))
    backed = cites_document(F.col("evidence"), F.col("text"))
    return d.select("person_id", "doc_id", F.when(known & backed, F.col("match")).otherwise("unsure").alias("match"),
                    F.coalesce(clamp01(F.col("confidence")), F.lit(0.0)).alias("confidence"), "evidence", "disambiguator")


def veto(match: Column, disambiguator: Column, evidence: Column, employer: Column, city: Column) -> Column:
    """Whether a `no` on employer or city stands: the roster lacks that detail or the evidence does not mention it."""
    family = attribute_family(disambiguator)
    detail = F.when(family == "employer", employer).when(family == "city", city)
    absent = F.coalesce(F.trim(detail) == "", F.lit(True))
    return (match == "no") & family.isin("employer", "city") & (absent | ~cites_document(detail, evidence))


def resolve(verdicts: DataFrame, strong: DataFrame | None = None) -> DataFrame:
    """verdicts(person_id, doc_ordinal, doc_id, match, confidence, attributes) to one row per person: resolved with two
    accepted documents on two distinct attributes, or one and a strong key. Unresolved people accept nothing."""
    yes = F.col("match") == "yes"
    per = verdicts.groupBy("person_id").agg(
        F.count_if(yes).alias("n_yes"),
        F.count("*").alias("n_docs"),
        F.array_distinct(F.flatten(F.collect_list(F.when(yes, F.col("attributes"))))).alias("attributes"),
        F.max(F.when(yes, F.col("confidence"))).alias("best"),
        F.transform(F.array_sort(F.collect_list(F.when(yes, F.struct("doc_ordinal", "doc_id")))), lambda x: x["doc_id"]).alias("yes_ids"))
    per = per.withColumn("keys", F.lit(0)) if strong is None else per.join(strong.groupBy("person_id").agg(F.count("*").alias("keys")), "person_id", "left")
    ok = ((F.col("n_yes") >= 2) & (F.size(F.filter("attributes", lambda a: a != "")) >= 2)) | ((F.col("n_yes") >= 1) & (F.coalesce("keys", F.lit(0)) > 0))
    return per.select("person_id", F.when(ok, "resolved").otherwise("unresolved").alias("status"),
                      F.when(ok, F.array_distinct("yes_ids")).otherwise(F.array().cast("array<string>")).alias("accepted_doc_ids"),
                      F.when(ok, F.col("n_docs") - F.col("n_yes")).otherwise(F.col("n_docs")).alias("n_rejected"),
                      F.when(ok, F.coalesce("best", F.lit(0.0))).otherwise(0.0).alias("confidence"))


def strong_keys(candidates: DataFrame) -> DataFrame:
    """candidates(person_id, key, value, details) to a map per person of each key's best-evidenced value, ties left out."""
    from kinweave.operators.elections import best_evidenced

    best = best_evidenced(candidates.where(F.col("key").isin(*STRONG_KEYS)), ["person_id", "key"], "value", "details").where("value <> ''")
    rank = F.array_position(F.array(*map(F.lit, STRONG_KEYS)), F.col("key"))
    listed = F.array_sort(F.collect_list(F.struct(rank.alias("r"), "key", "value")))
    return best.groupBy("person_id").agg(F.map_from_entries(F.transform(listed, lambda x: F.struct(x["key"], x["value"]))).alias("strong_keys"))


def accepted_documents(resolutions: DataFrame, docs: DataFrame) -> DataFrame:
    """Accepted documents in the resolver's order."""
    ids = resolutions.select("person_id", F.posexplode(F.array_distinct("accepted_doc_ids")).alias("position", "doc_id"))
    return docs.join(ids, ["person_id", "doc_id"])


def claimed(text: Column, label: str) -> Column:
    """What `label: value` claims, up to a full stop, the line's end or the next label; null where missing or unset. Fixed
    values: the two patterns."""
    value = F.regexp_extract(text, rf"(?i)\b{label}\s*:\s*([^\n.]*)", 1)
    value = F.trim(F.regexp_replace(value, rf"(?i)\s+\b(?:{'|'.join(LABELS)})\s*:.*$", ""))
    return F.when(~F.trim(normalize_ws(value), F.lit(" .")).isin(*UNSET), value)


def contradicts(who: Column, evidence: Column) -> Column:
    """Whether evidence claims an employer or city other than the roster's; such a document backs no strong key."""
    out = F.lit(False)
    for attribute, labels in CLAIMS.items():
        for label in labels:
            value = claimed(evidence, label)
            out = out | ((F.size(who[attribute]) > 0) & value.isNotNull() & ~mentions_tokens(value, who[attribute]))
    return F.coalesce(out, F.lit(False))


def verdict_attributes(who: Column, evidence: Column, disambiguator: Column) -> Column:
    """Roster attributes the evidence mentions; without any, the family the verdict names ('other' if unknown), or none."""
    backed = F.transform(F.filter(who["attributes"], lambda a: F.exists(a["groups"], lambda g: mentions_tokens(F.coalesce(evidence, F.lit("")), g))), lambda a: a["attribute"])
    family = attribute_family(disambiguator)
    named = F.when(family == "", F.array().cast("array<string>")).otherwise(F.array(F.when(family.isin(*FAMILIES), family).otherwise("other")))
    return F.when(F.size(backed) > 0, F.array_distinct(backed)).otherwise(named)


def primary_attribute(attributes: Column, disambiguator: Column) -> Column:
    """The verdict's own family if it counts, else the first attribute, '' without any."""
    family = attribute_family(disambiguator)
    return F.when(F.array_contains(attributes, family), family).otherwise(F.coalesce(F.get(attributes, F.lit(0)), F.lit("")))


def key_candidates(people: DataFrame, docs: DataFrame) -> DataFrame:
    """(person_id, key, value, details) for strong_keys(), in one pass over docs(person_id, kind, url, title, text) and people
    (person_id, who). A Wikidata item and a filer number need the name and a roster detail, a GitHub account a name and a
    company field, a domain the employer's name."""
    d = docs.join(sorted_joins(people.select("person_id", "who")), "person_id")
    who, hay = F.col("who"), F.concat_ws("\n", "title", "text")
    employer, city = who["employer"], who["city"]
    named = mentions_tokens(hay, who["name_parts"])
    details = mentions_tokens(hay, employer).cast("int") + mentions_tokens(hay, city).cast("int")
    row = lambda key, value, n: F.struct(F.lit(key).alias("key"), value.alias("value"), n.cast("int").alias("details"))
    none = F.array().cast("array<struct<key:string,value:string,details:int>>")
    qid = F.coalesce(*(F.nullif(F.regexp_extract(c, r"\b(Q\d{1,12})\b", 1), F.lit("")) for c in ("url", "title", "text")))
    item = F.when((F.col("kind") == "wikidata") & named & (details > 0) & qid.isNotNull(), F.array(row("wikidata_qid", qid, details)))
    profile, company = claimed(F.col("text"), "name"), claimed(F.col("text"), "company")
    handle = F.nullif(F.regexp_extract(F.coalesce(F.try_parse_url("url", F.lit("PATH")), F.lit("")), "([^/]+)/*$", 1), F.lit(""))
    account = F.when((F.col("kind") == "github") & mentions_tokens(profile, who["name_parts"]) & mentions_tokens(company, employer) & handle.isNotNull(),
                     F.array(row("github", handle, 1 + F.coalesce(mentions_tokens(claimed(F.col("text"), "location"), city), F.lit(False)).cast("int"))))
    lines = F.filter(F.split(hay, "[\\n,;]"), lambda x: x.rlike(CIK) & mentions_tokens(x, who["name_parts"]))
    own = F.array_distinct(F.transform(lines, lambda x: F.regexp_extract(x, CIK, 1)))
    numbers = F.when(F.size(own) > 0, own).otherwise(F.filter(F.array(F.regexp_extract(hay, CIK, 1)), lambda x: x != ""))
    filer = F.when((F.col("kind") == "edgar") & named & mentions_tokens(hay, employer), F.transform(numbers, lambda x: row("sec_cik", x, details)))
    labels = F.split(F.regexp_replace(F.coalesce(F.lower(F.try_parse_url("url", F.lit("HOST"))), F.lit("")), r"^www\.", ""), r"\.")
    joined, dashed = F.array_join(employer, ""), F.array_join(employer, "-")
    at = F.filter(F.transform(F.slice(labels, 1, F.greatest(F.size(labels) - 1, F.lit(0))), lambda x, i: F.when((x == joined) | (x == dashed), i + 1)), lambda i: i.isNotNull())
    domain = F.when((F.char_length(joined) >= 4) & (F.size(at) > 0), F.array(row("company_domain", F.array_join(F.slice(labels, F.greatest(F.coalesce(F.get(at, F.lit(0)), F.lit(1)), F.lit(1)), F.size(labels)), "."), details + named.cast("int"))))
    return d.select("person_id", F.explode(F.concat(*(F.coalesce(c, none) for c in (item, account, filer, domain)))).alias("c")).select("person_id", "c.*")
