"""Report rows and statistics over a corpus, in one pass each."""

from __future__ import annotations

import pandas as pd
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from kinweave.operators.components import connected_components, numbered


def fact_counts(facts: DataFrame) -> DataFrame:
    """(person_id, shown, withheld) of facts with withholding_reason `reason`."""
    return facts.groupBy("person_id").agg(F.count_if(F.col("reason").isNull()).alias("shown"), F.count_if(F.col("reason").isNotNull()).alias("withheld"))


def reason_histogram(facts: DataFrame) -> DataFrame:
    return facts.where("reason is not null").groupBy("reason").agg(F.count("*").alias("n"))


def report_rows(docs: DataFrame, kinds: list[str]) -> DataFrame:
    """docs(person_id, kind, excluded) to documents, kept, excluded and the kinds that brought nothing, in order."""
    have = F.collect_set("kind")
    return docs.groupBy("person_id").agg(F.count("*").alias("documents"), F.count_if(~F.col("excluded")).alias("kept"), F.count_if("excluded").alias("excluded"),
                                         F.array_join(F.array_except(F.array(*map(F.lit, kinds)), have), ",").alias("zero_sources"))


def carrier_histogram(stats: DataFrame) -> DataFrame:
    return stats.groupBy("carriers").agg(F.count("*").alias("hubs"))


def ring(stats: DataFrame, width: float = 100.0) -> DataFrame:
    """Places on a circle by (worth, hub_id), rounded to 4 decimals."""
    rows = numbered(stats, [F.desc("worth"), F.col("hub_id")], "r")
    angle = 2 * F.pi() * F.col("r") / rows.count()
    return rows.select("hub_id", F.round(width * F.cos(angle), 4).alias("x"), F.round(width * F.sin(angle), 4).alias("y"))


def corpus_statistics(dossiers: DataFrame) -> DataFrame:
    """One row of counts over dossiers: people by status, facts shown and withheld, hubs, edges, distinct documents by part, and the
    components of the graph of resolved people and hubs. A component of two or more people is joined, else an island."""
    status = dossiers.agg(F.count("*").alias("dossiers"), F.count_if(F.col("resolution.status") == "resolved").alias("resolved"),
                          F.count_if(F.coalesce(F.col("resolution.status"), F.lit("")) != "resolved").alias("unresolved"))
    facts = fact_rows(_facts(dossiers)).agg(F.count("*").alias("facts_total"), F.count_if("shown").alias("facts_shown"), F.count_if(~F.col("shown")).alias("facts_withheld"))
    part = lambda name, ids: F.transform(F.coalesce(ids, F.array().cast("array<string>")), lambda d: F.struct(F.lit(name).alias("part"), d.alias("doc_id")))
    tagged = dossiers.select(F.explode(F.concat(part("accepted", F.col("resolution.accepted_doc_ids")), part("rejected", F.col("resolution.rejected.doc_id")),
                                                part("cited", F.col("facts.provenance.doc_id")))).alias("x")).select("x.*").distinct()
    docs = tagged.agg(*(F.count_if(F.col("part") == k).alias(f"docs_{k}") for k in ("accepted", "rejected", "cited")), F.count_distinct("doc_id").alias("docs_considered"))
    known = dossiers.where("resolution.status = 'resolved'").select(F.col("person.person_id").alias("person_id"), "hubs")
    edges = known.select("person_id", F.explode("hubs.hub_id").alias("hub_id")).distinct()
    node = lambda kind, c: F.concat(F.lit(kind), F.col(c).cast("string"))
    a, b = node("person:", "person_id"), node("hub:", "hub_id")
    # nodes get numbers by their 64-bit hash; a person without a hub is a component, too
    links = edges.select(F.xxhash64(a).alias("a"), F.xxhash64(b).alias("b")).unionByName(known.select(F.xxhash64(a).alias("a"), F.xxhash64(a).alias("b")))
    people = known.select(F.xxhash64(a).alias("node"), F.lit(1).alias("person"))
    per = connected_components(links).join(people, "node", "left").groupBy("component").agg(F.count("*").alias("n"), F.count("person").alias("heads"))
    shape = per.agg(F.coalesce(F.sum("n"), F.lit(0)).alias("nodes"), F.count("*").alias("components"), F.coalesce(F.max("n"), F.lit(0)).alias("largest_component"), F.count_if(F.col("heads") < 2).alias("islands"),
                    F.count_if(F.col("heads") >= 2).alias("joined_components"), F.coalesce(F.sum(F.when(F.col("heads") >= 2, F.col("heads"))), F.lit(0)).alias("joined_people"))
    size = edges.agg(F.count_distinct("hub_id").alias("hubs"), F.count("*").alias("edges"))
    out = status
    for one in (facts, docs, size, shape):
        out = out.join(F.broadcast(one))  # one row each
    return out


def _facts(dossiers: DataFrame) -> DataFrame:
    f = dossiers.select(F.col("person.person_id").alias("person_id"), F.explode("facts").alias("f"))
    return f.select("person_id", "f.fact_id", "f.text", "f.category", "f.excluded", "f.exclusion_reason", F.col("f.provenance.confidence").alias("confidence"), F.col("f.provenance.source_kind").alias("kind"))


def histogram(rows: DataFrame, key: str, out: str = "n") -> DataFrame:
    """Counts per key, the largest first, then the key."""
    return rows.groupBy(key).agg(F.count("*").alias(out)).orderBy(F.desc(out), key)


def type_rows(stats: DataFrame) -> DataFrame:
    """Hubs per type with its weight, the largest first, then the type."""
    return stats.groupBy("type").agg(F.count("*").alias("count"), F.max("boost").alias("type_boost")).orderBy(F.desc("count"), "type")


def people_by_name(people: DataFrame) -> DataFrame:
    return people.orderBy(F.lower("name"), "person_id")


def hub_rows(stats: DataFrame) -> DataFrame:
    """Hubs by worth (idf times boost), then label, then id."""
    return stats.withColumn("worth", F.col("idf") * F.col("boost")).orderBy(F.desc("worth"), F.lower("label"), "hub_id")


def corpus_view(people: DataFrame, edges: DataFrame, stats: DataFrame) -> DataFrame:
    """people(person_id, name) with their hubs in the order of hub_rows() and how many each has and shares, people of many hubs
    first, then by name; who has none is listed, too."""
    e = edges.select("person_id", "hub_id").distinct().join(stats.select("hub_id", "label", "carriers", (F.col("idf") * F.col("boost")).alias("worth")), "hub_id")
    listed = F.array_sort(F.collect_list(F.struct((-F.col("worth")).alias("w"), F.lower("label").alias("l"), "hub_id")))
    per = e.groupBy("person_id").agg(F.count("*").alias("n_hubs"), F.count_if(F.col("carriers") >= 2).alias("n_shared"), F.transform(listed, lambda x: x["hub_id"]).alias("hubs"))
    rows = people.join(per, "person_id", "left").withColumns({"n_hubs": F.coalesce("n_hubs", F.lit(0)), "n_shared": F.coalesce("n_shared", F.lit(0))})
    return rows.orderBy(F.desc("n_hubs"), F.lower("name"), "person_id")


def present_roster(present: DataFrame, people: DataFrame, graph: DataFrame) -> DataFrame:
    """Everyone present with a name, on the roster or not, and whether the graph knows them."""
    known = graph.select("person_id", F.lit(True).alias("known")).distinct()
    return present.join(people.select("person_id", "name"), "person_id", "left").join(known, "person_id", "left").select(
        "person_id", F.coalesce("name", F.col("person_id").cast("string")).alias("name"), F.coalesce("known", F.lit(False)).alias("in_graph"))


def presence_state(present: DataFrame, hubs: DataFrame) -> DataFrame:
    """One row on a room: empty, alone, strangers (no hub of two or more present) or connected; with the counts of people, hubs
    shared and hubs of one. hubs(hub_id, shared) are those of the present."""
    n = present.agg(F.count_distinct("person_id").alias("people"))
    h = hubs.agg(F.count_if("shared").alias("shared"), F.count_if(~F.col("shared")).alias("solo"))
    state = F.when(F.col("people") == 0, "empty").when(F.col("people") == 1, "alone").when(F.col("shared") == 0, "strangers").otherwise("connected")
    return n.join(F.broadcast(h)).select(state.alias("state"), "people", "shared", "solo")


def rejected_rows(dossiers: DataFrame) -> DataFrame:
    """Verdicts that a resolution rejected, one row each: the other half of the debugging view."""
    return dossiers.select(F.col("person.person_id").alias("person_id"), F.posexplode("resolution.rejected").alias("position", "r")).select("person_id", "position", "r.*")


SEPARATED = "figure string, node string, x double, y double"


def separated(boxes: DataFrame, passes: int = 200, pad: float = 6.0) -> DataFrame:
    """boxes(figure, node, x, y, width, height, fixed) with movable boxes pushed apart, each figure on its own: in each pass
    every overlapping pair moves along the axis of least overlap, half each, or the movable one wholly from a fixed
    one. Passes end when nothing overlaps. A figure is one group; it holds what one screen shows."""
    return boxes.groupBy("figure").applyInPandas(lambda pdf: _apart(pdf, passes, pad), SEPARATED)


def _apart(pdf: pd.DataFrame, passes: int, pad: float) -> pd.DataFrame:
    pdf = pdf.sort_values("node", ignore_index=True)
    x, y = pdf.x.to_numpy(float).copy(), pdf.y.to_numpy(float).copy()
    w, h, free = pdf.width.to_numpy(float) / 2, pdf.height.to_numpy(float) / 2, ~pdf.fixed.to_numpy(bool)
    for _ in range(passes):
        moved = False
        for i in range(len(x)):
            for j in range(i + 1, len(x)):
                over_x, over_y = w[i] + w[j] + pad - abs(x[i] - x[j]), h[i] + h[j] + pad - abs(y[i] - y[j])
                if over_x <= 1e-9 or over_y <= 1e-9 or not (free[i] or free[j]):
                    continue
                at, over = (x, over_x) if over_x <= over_y else (y, over_y)
                way = 1.0 if at[j] >= at[i] else -1.0
                share = 0.5 if free[i] and free[j] else 1.0
                if free[i]:
                    at[i] -= way * over * share
                if free[j]:
                    at[j] += way * over * share
                moved = True
        if not moved:
            break
    return pd.DataFrame({"figure": pdf.figure.astype(str), "node": pdf.node.astype(str), "x": x.round(4), "y": y.round(4)})


def lookup(people: DataFrame, tokens: DataFrame) -> DataFrame:
    """(token, person_id) for tokens that are an id, a name or slug to one; an exact match goes first, then the last person.
    Unknown and blank tokens keep null. people(person_id, name, ordinal)."""
    from kinweave.functions.text import slug

    keys = F.array(F.struct(F.col("person_id").alias("k")), F.struct(F.col("name").alias("k")), F.struct(slug(F.col("name")).alias("k")))
    index = people.select("person_id", "ordinal", F.explode(keys).alias("x")).groupBy(F.col("x.k").alias("key")).agg(F.max_by("person_id", "ordinal").alias("person_id"))
    asked = tokens.select("token", F.explode(F.array(F.struct(F.lit(0).alias("i"), F.trim("token").alias("key")), F.struct(F.lit(1).alias("i"), slug(F.trim("token")).alias("key")))).alias("t")).select("token", "t.*").where("key <> ''")
    hit = asked.join(index, "key").groupBy("token").agg(F.min_by("person_id", "i").alias("person_id"))
    return tokens.select("token").distinct().join(hit, "token", "left")


def selected(people: DataFrame, only: str | None) -> DataFrame:
    """All people without a selector, nobody for a blank one, else those whose id, name or slug it is."""
    from kinweave.functions.text import slug

    want = F.trim(F.lit(only))
    return people if only is None else people.where((want != "") & ((F.col("person_id") == want) | (F.col("name") == want) | (F.col("person_id") == slug(want))))


def fact_rows(facts: DataFrame) -> DataFrame:
    """All facts with withholding `reason` and whether they show, shown or not: the debugging view."""
    from kinweave.operators.exclusion import withholding_reason

    reason = withholding_reason(F.col("excluded"), F.col("exclusion_reason"), F.col("confidence"), F.col("kind"))
    return facts.withColumn("reason", reason).withColumn("shown", F.col("reason").isNull())


def source_evidence(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """What each numbered source backs: claims(digest_id, claim_ordinal, section, detail, fact_id, doc_id, displayable) and sources
    (digest_id, doc_id, number) to (digest_id, number, fact_id, position, sections, backs), facts in order of first mention."""
    c = claims.where("displayable").join(sources.select("digest_id", "doc_id", "number"), ["digest_id", "doc_id"])
    per = c.groupBy("digest_id", "number", "fact_id", "section").agg(F.min("claim_ordinal").alias("o"), F.array_sort(F.collect_list(F.when(F.col("detail") != "", F.struct("claim_ordinal", "detail")))).alias("d"))
    names = F.array_distinct(F.transform("d", lambda x: x["detail"]))
    label = F.when(F.size(names) > 0, F.concat("section", F.lit(": "), F.array_join(names, ", "))).otherwise(F.col("section"))
    per = per.withColumn("label", label)
    listed = F.array_sort(F.collect_list(F.struct("o", "section", "label")))
    g = per.groupBy("digest_id", "number", "fact_id").agg(listed.alias("l"), F.min("o").alias("o"))
    w = Window.partitionBy("digest_id", "number").orderBy("o", "fact_id")
    return g.select("digest_id", "number", "fact_id", F.row_number().over(w).alias("position"), F.array_join(F.transform("l", lambda x: x["section"]), ", ").alias("sections"), F.array_join(F.transform("l", lambda x: x["label"]), "; ").alias("backs"))


def report_cells(rows: DataFrame) -> DataFrame:
    """Report rows as they print: a skipped person is marked, unknown values are ?, confidence has two decimals, lists join, none is -."""
    known = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("?"))
    listed = lambda c: F.coalesce(F.nullif(F.array_join(c, ", "), F.lit("")), F.lit("-"))
    return rows.select(F.concat(known("person_id"), F.when(F.coalesce("skipped", F.lit(False)), " (skipped)").otherwise("")).alias("person_id"), known("status").alias("status"), F.when(F.col("confidence").isNull(), "?").otherwise(F.format_string("%.2f", "confidence")).alias("confidence"),
                       known("facts_kept").alias("facts_kept"), known("facts_excluded").alias("facts_excluded"), known("hubs").alias("hubs"), listed("zero_sources").alias("zero_sources"), listed("failed_sources").alias("failed_sources"))


def fan(hubs: DataFrame, places: DataFrame, step: float = 26.0) -> DataFrame:
    """(hub_id, dx, dy): hubs with the same two or more placed carriers slide along the normal of the axis through the first
    carrier and the centre. hubs(hub_id, ordinal, person_id), places(person_id, x, y)."""
    at = hubs.join(places, "person_id")
    per = at.groupBy("hub_id", "ordinal").agg(F.array_sort(F.collect_list(F.struct("person_id", "x", "y"))).alias("who"), F.avg("x").alias("cx"), F.avg("y").alias("cy")).where(F.size("who") >= 2)
    per = per.withColumn("key", F.transform("who", lambda p: p["person_id"]))
    w = Window.partitionBy("key")
    n, i = F.count("*").over(w), F.row_number().over(w.orderBy("ordinal", "hub_id")) - 1
    first = F.get("who", F.lit(0))
    ax, ay = first["x"] - F.col("cx"), first["y"] - F.col("cy")
    per = per.withColumn("n", n).withColumn("i", i).where("n > 1").withColumn("ax", ax).withColumn("ay", ay).withColumn("len", F.hypot("ax", "ay"))
    slide = (F.col("i") - (F.col("n") - 1) / 2.0) * step
    flat = F.col("len") < 1e-9
    return per.select("hub_id", F.round(F.when(flat, 0.0).otherwise(-F.col("ay") / F.col("len")) * slide, 4).alias("dx"), F.round(F.when(flat, 1.0).otherwise(F.col("ax") / F.col("len")) * slide, 4).alias("dy"))
