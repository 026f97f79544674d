"""The bipartite graph of people and hubs: weights, shared hubs, scores, ranks and their wording."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions import numbers as N
from kinweave.functions.text import acronym_of, reads_as_acronym, slug, spoken_label
from kinweave.operators import pairs
from kinweave.operators.components import connected_components as components  # noqa: F401 - part of the graph's operators
from kinweave.operators.elections import elect, unambiguous

#: Clauses per hub type, what is said without a shared hub, and a withheld hub's label.
CLAUSES = {
    "investor": "both backed by {}", "board": "both on the board at {}", "company": "both connected to {}",
    "school": "both came through {}", "city": "both rooted in {}", "topic": "both deep in {}",
    "technology": "both building on {}", "event": "both regulars at {}", "cause": "both behind {}", "person": "both know {}",
}
CLAUSE, NOTHING, WITHHELD = "both connected to {}", "Nothing in common on the record yet.", "Withheld connection"
WHY_HUBS, MEET_CAP = 2, 3


def one_hub_per_person(edges: DataFrame) -> DataFrame:
    """Edges (person_id, hub_id, hub_ordinal, recency, evidence) merged per person and hub: largest recency, evidence in
    first-seen order."""
    listed = F.array_sort(F.collect_list(F.struct("hub_ordinal", "evidence")))
    return edges.groupBy("person_id", "hub_id").agg(
        F.max("recency").alias("recency"), F.array_distinct(F.flatten(F.transform(listed, lambda x: x["evidence"]))).alias("evidence"))


def hub_stats(edges: DataFrame, people: int) -> DataFrame:
    """hub_id, type, label, carriers, idf, cost, boost. people counts everyone in the graph, hubs or not."""
    n = edges.groupBy("hub_id").agg(F.count_distinct("person_id").alias("carriers"), F.mode("type", True).alias("type"), F.mode("label", True).alias("label"))
    weight = N.idf(F.lit(float(people)), F.col("carriers"))
    return n.withColumn("idf", weight).withColumn("cost", N.crossing_cost(F.col("idf"))).withColumn("boost", N.type_boost(F.col("type")))


def canonical_ids(claims: DataFrame) -> DataFrame:
    """claims(person_id, stated_id, type, label) to (key, hub_id): claims with one slugged label are one hub. Its id is the
    QID that most carriers state, if one leads; else the most common other stated id; else type:slug of elected
    type and label. A short label folds into the only longer label of its type that it abbreviates."""
    c = claims.withColumn("key", F.when(slug(F.col("label")) != "", slug(F.col("label"))).otherwise(F.concat(F.lit("\x00"), "stated_id")))
    kinds = elect(c, ["key"], "type")
    long = c.join(kinds.withColumnRenamed("type", "k"), "key").where(acronym_of(F.col("label")).isNotNull()).select(
        F.lower(acronym_of(F.col("label"))).alias("short"), F.col("k").alias("t"), F.col("key").alias("into")).distinct()
    only = long.groupBy("short", "t").agg(F.count("*").alias("n"), F.min("into").alias("into")).where("n = 1")
    short = c.where(reads_as_acronym(F.col("label"))).select("key").distinct().join(kinds, "key")
    alias = short.join(only, (short["key"] == only["short"]) & (short["type"] == only["t"])).select("key", "into")
    c = c.join(alias, "key", "left").withColumn("group", F.coalesce("into", "key"))
    qid = unambiguous(c.where(F.col("stated_id").rlike("^wd:Q[0-9]+$")), ["group"], "stated_id", "person_id", "qid")
    other = elect(c.where(~F.col("stated_id").rlike("^wd:Q[0-9]+$")), ["group"], "stated_id", "other")
    made = c.groupBy("group").agg(F.concat(F.mode("type", True), F.lit(":"), slug(F.mode("label", True))).alias("made"))
    return c.select("key", "group").distinct().join(qid, "group", "left").join(other, "group", "left").join(made, "group").select(
        "key", F.coalesce("qid", "other", "made").alias("hub_id"))


def acronym_folds(labels: DataFrame) -> DataFrame:
    """labels(label, type) to (short, long): acronyms with exactly one expansion of their type."""
    long = labels.withColumn("a", acronym_of(F.col("label"))).where("a is not null").select("a", "type", F.col("label").alias("l")).distinct()
    only = long.groupBy("a", "type").agg(F.count("*").alias("n"), F.min("l").alias("long")).where("n = 1")
    return labels.where(reads_as_acronym(F.col("label"))).select(F.trim("label").alias("a"), "type").distinct().join(only, ["a", "type"]).select(F.col("a").alias("short"), "type", "long")


#: Carriers of a hub that one task pairs with as many others.
PAIR_BLOCK = 4096


def shared_hubs(edges: DataFrame, stats: DataFrame, keep_zero: bool = False) -> DataFrame:
    """(person_id, other_id, hub_id, type, label, contribution) for every pair that shares a hub, once, person_id < other_id.

    Hubs of idf 0 add nothing and are carried by most people, so unless their rows are wanted they leave before the
    self-join, where they would make almost all pairs. A hub of many carriers is paired block by block: a
    carrier stands on the left of its own and later blocks and on the right of its own and earlier ones."""
    s = stats.where(F.lit(keep_zero) | (F.col("idf") > 0)).select(
        "hub_id", "idf", "boost", F.col("type").alias("t"), F.col("label").alias("l"), F.ceil(F.col("carriers") / PAIR_BLOCK).cast("int").alias("g"))
    e = edges.join(s, "hub_id").withColumn("side", F.pmod(F.xxhash64("person_id"), "g").cast("int"))
    a = e.select("hub_id", F.col("person_id").alias("a_id"), F.col("recency").alias("ar"), "idf", "boost", "t", "l", F.col("side").alias("lo"), F.explode(F.sequence("side", F.col("g") - 1)).alias("hi"))
    b = e.select("hub_id", F.col("person_id").alias("b_id"), F.col("recency").alias("br"), F.col("side").alias("hi"), F.explode(F.sequence(F.lit(0), "side")).alias("lo"))
    both = a.join(b, ["hub_id", "lo", "hi"]).where("a_id <> b_id and (lo < hi or a_id < b_id)")
    return both.select(F.least("a_id", "b_id").alias("person_id"), F.greatest("a_id", "b_id").alias("other_id"), "hub_id", F.col("t").alias("type"), F.col("l").alias("label"),
                        _worth("ar", "br").alias("contribution"))


def _worth(one: str, other: str) -> Column:
    return F.col("idf") * F.least(one, other) * F.col("boost")


def mirrored(pairs: DataFrame) -> DataFrame:
    """Rows of pairs in both directions; a path is turned round."""
    turned = {"person_id": F.col("other_id"), "other_id": F.col("person_id"), "path": F.reverse("path") if "path" in pairs.columns else None}
    rows = F.array(F.struct(*pairs.columns), F.struct(*(turned.get(c, F.col(c)).alias(c) for c in pairs.columns)))
    return pairs.select(F.inline(rows))


def contributions(edges: DataFrame, stats: DataFrame, keep_zero: bool = False) -> DataFrame:
    """shared_hubs() in both directions."""
    return mirrored(shared_hubs(edges, stats, keep_zero))


def _raw() -> Column:
    """A pair's worth. Contributions are added as whole numbers, multiples of 2^-26 and the rest, which no order of addition changes: two
    pairs with equal contributions tie. To 12 places, as in SQL engines: by scaling, not by decimal digits."""
    scaled = F.col("contribution") * 2.0**26
    whole = F.floor(scaled)
    total = F.sum(whole) / 2.0**26 + F.sum(F.floor((scaled - whole) * 2.0**36)) / 2.0**62
    return (F.rint(total * 1e12) / 1e12).alias("raw")


def match_scores(edges: DataFrame, stats: DataFrame, people: int) -> DataFrame:
    """(person_id, other_id, raw, score, rank): shared worth, shown to 6 places, and its place among a person's partners; scores
    and ranks are by the worth as it is, then id."""
    raw = mirrored(shared_hubs(edges, stats).groupBy("person_id", "other_id").agg(_raw()))
    w = Window.partitionBy("person_id").orderBy(F.desc("raw"), "other_id")
    return raw.withColumn("score", N.score(F.col("raw"), N.reference_score(F.lit(float(people))))).withColumn("rank", F.row_number().over(w)).withColumn("raw", F.round("raw", 6))


def best_matches(edges: DataFrame, stats: DataFrame, people: int, most: int = MEET_CAP) -> DataFrame:
    """The first `most` places of match_scores(), as `place`, without making all pairs."""
    score = N.score(F.col("raw"), N.reference_score(F.lit(float(people))))
    return pairs.best(edges, stats, most).select("person_id", "other_id", F.round("raw", 6).alias("raw"), score.alias("score"), "place")


#: Arriving people that meet everyone present in one block.
ARRIVING_BLOCK = 1000


def match_present(arriving: DataFrame, present: DataFrame, edges: DataFrame, stats: DataFrame, people: int) -> DataFrame:
    """Everyone present ranked for each arriving person, partners without a shared hub included with 0.

    The arriving are a query set that meets all present people in blocks, since the answer names all of them; sharers
    are scored by an equi-join of the two sides' hubs, never through pairs among the present."""
    a, p = arriving.select("person_id").distinct(), present.select(F.col("person_id").alias("other_id")).distinct()
    blocks = max(1, -(-a.count() // ARRIVING_BLOCK))
    asked = a.withColumn("block", F.pmod(F.xxhash64("person_id"), F.lit(blocks)))
    pairs = asked.join(p.withColumn("block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(blocks - 1).cast("long")))), "block").where("person_id <> other_id").drop("block")
    s = stats.where("idf > 0").select("hub_id", "idf", "boost")
    mine = edges.join(a, "person_id").join(s, "hub_id").select("hub_id", "person_id", F.col("recency").alias("ar"), "idf", "boost")
    theirs = edges.join(p.withColumnRenamed("other_id", "person_id"), "person_id").select("hub_id", F.col("person_id").alias("other_id"), F.col("recency").alias("br"))
    raw = mine.join(theirs, "hub_id").where("person_id <> other_id").withColumn("contribution", _worth("ar", "br")).groupBy("person_id", "other_id").agg(_raw())
    out = pairs.join(raw, ["person_id", "other_id"], "left").withColumn("raw", F.coalesce("raw", F.lit(0.0)))
    w = Window.partitionBy("person_id").orderBy(F.desc("raw"), "other_id")
    return out.withColumn("score", N.score(F.col("raw"), N.reference_score(F.lit(float(people))))).withColumn("rank", F.row_number().over(w)).withColumn("raw", F.round("raw", 6))


def ranked_contributions(rows: DataFrame) -> DataFrame:
    """contributions() with each hub's place in its pair: largest first, then hub_id."""
    w = Window.partitionBy("person_id", "other_id").orderBy(F.desc("contribution"), "hub_id")
    return rows.withColumn("place", F.row_number().over(w))


def clause(kind: Column, label: Column) -> Column:
    table = F.create_map(*(F.lit(x) for pair in CLAUSES.items() for x in pair))
    return F.replace(F.coalesce(F.try_element_at(table, kind), F.lit(CLAUSE)), F.lit("{}"), spoken_label(label, kind))


def why_and_path(rows: DataFrame) -> DataFrame:
    """(person_id, other_id, why, path) of contributions: a sentence on the two worthiest nameable hubs and the route over the
    first. One aggregate per pair, whose list is as long as what the two share."""
    named = (F.col("contribution") > 0) & (F.col("label") != WITHHELD)
    top = F.slice(F.array_sort(F.collect_list(F.when(named, F.struct((-F.col("contribution")).alias("c"), "hub_id", "type", "label")))), 1, WHY_HUBS)
    said = rows.groupBy("person_id", "other_id").agg(top.alias("top"))
    line = F.array_join(F.transform("top", lambda x: clause(x["type"], x["label"])), "; ")
    some, node = F.size("top") > 0, lambda kind, c: F.concat(F.lit(kind), c.cast("string"))
    why = F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.char_length(line)), F.lit("."))
    path = F.array(node("person:", F.col("person_id")), node("hub:", F.get("top", F.lit(0))["hub_id"]), node("person:", F.col("other_id")))
    return said.select("person_id", "other_id", F.when(some, why).otherwise(NOTHING).alias("why"), F.when(some, path).otherwise(F.array().cast("array<string>")).alias("path"))


def pair_reasons(edges: DataFrame, stats: DataFrame) -> DataFrame:
    """why_and_path() of every pair in both directions, without a shuffle of pairs; path as text, joined by >."""
    worded = stats.withColumn("clause", F.when(F.col("label") != WITHHELD, clause(F.col("type"), F.col("label"))))
    line, some = F.array_join("clauses", "; "), F.size("hubs") > 0
    why = F.concat(F.upper(F.substring(line, 1, 1)), F.substring(line, F.lit(2), F.char_length(line)), F.lit("."))
    path = F.concat(F.lit("person:"), F.col("person_id").cast("string"), F.lit(">hub:"), F.get("hubs", F.lit(0)).cast("string"), F.lit(">person:"), F.col("other_id").cast("string"))
    return pairs.reasons(edges, worded, WHY_HUBS).select("person_id", "other_id", F.when(some, why).otherwise(NOTHING).alias("why"), F.when(some, path).otherwise("").alias("path"))


def nameable_hubs(edges: DataFrame, facts: DataFrame) -> DataFrame:
    """(hub_id, nameable): whether some carrier has no evidence on record for it, or a displayable fact. facts has
    (person_id, fact_id, displayable); evidence that is not on record is skipped."""
    seen = edges.select("person_id", "hub_id", F.explode_outer("evidence").alias("fact_id")).join(facts, ["person_id", "fact_id"], "left")
    per = seen.groupBy("person_id", "hub_id").agg(F.count("displayable").alias("n"), F.coalesce(F.bool_or("displayable"), F.lit(False)).alias("shown"))
    return per.groupBy("hub_id").agg(F.bool_or((F.col("n") == 0) | F.col("shown")).alias("nameable"))


def presence_hubs(edges: DataFrame, stats: DataFrame, present: DataFrame) -> DataFrame:
    """Hubs of those present: carriers in the room, shared from two on; weight stays that of the whole corpus."""
    here = edges.join(present.select("person_id").distinct(), "person_id", "left_semi").groupBy("hub_id").agg(F.count_distinct("person_id").alias("here"))
    return here.join(stats, "hub_id").select("hub_id", "here", (F.col("here") >= 2).alias("shared"), "carriers", F.round(F.col("idf") * F.col("boost"), 6).alias("worth"))
