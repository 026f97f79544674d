"""Sections of a digest, each a ranking with a total order."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import is_speakable, once, speakable, word_count
from kinweave.operators.components import cut, sorted_joins
from kinweave.operators.exclusion import NON_OBVIOUS, POLICY, is_displayable

#: Caps, categories of recent news, words and openings of a spoken line.
LATELY_CAP, SPOKEN_WORDS, HISTORY = 3, 30, 200
PRIMARY, FALLBACK = "recent_activity", ("affiliation", "hook", "interest")
OPENINGS, SURVEILLANCE = ("Ask", "Curious"), ("i saw", "we noticed", "our records")
#: The opener's template, and what is said where nothing else can be.
OPENER, OPENER_LAST = "Ask about this: {}", "Ask what they are working on right now."
WHY_LAST, WHO_LAST = "Worth a hello; nothing quotable on the record yet.", "A member has arrived."


def newest_first() -> list[Column]:
    return [F.desc_nulls_last("published_at"), F.desc("confidence"), F.desc("fact_id")]


def meet(matches: DataFrame, most: int = 3) -> DataFrame:
    """The top partners of each person by score, worth, id."""
    w = Window.partitionBy("person_id").orderBy(F.desc("score"), F.desc("raw"), "other_id")
    return matches.withColumn("place", F.row_number().over(w)).where(F.col("place") <= most)


def unused(facts: DataFrame, used: DataFrame | None) -> DataFrame:
    """facts without those of used(person_id, fact_id), which the page already shows."""
    return facts if used is None else facts.join(used.select("person_id", "fact_id"), ["person_id", "fact_id"], "left_anti")


def lately(facts: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Up to three dated facts per person: recent activity first, topped up from the fallback categories, newest first."""
    dated = unused(facts, used).where(F.col("published_at").isNotNull() & F.col("category").isin(PRIMARY, *FALLBACK))
    tier = F.when(F.col("category") == PRIMARY, 0).otherwise(1)
    picked = dated.withColumn("__n", F.row_number().over(Window.partitionBy("person_id").orderBy(tier, *newest_first()))).where(F.col("__n") <= LATELY_CAP).drop("__n")
    return picked.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy(*newest_first())))


def non_obvious(facts: DataFrame) -> DataFrame:
    """The surest non-obvious fact per person, the larger id on a tie."""
    return facts.where("category = 'non_obvious'").groupBy("person_id").agg(F.max_by("fact_id", F.struct("confidence", "fact_id")).alias("fact_id"))


def opener_hooks(facts: DataFrame, used: DataFrame | None = None) -> DataFrame:
    """Candidates for an opening line: hooks by confidence and id, then the rest newest first."""
    facts = unused(facts, used)
    hook = F.col("category") == "hook"
    order = [F.desc(hook), F.desc(F.when(hook, F.col("confidence"))), F.desc(F.when(hook, F.col("fact_id"))), *newest_first()]
    return facts.withColumn("place", F.row_number().over(Window.partitionBy("person_id").orderBy(*order)))


def who_line(people: DataFrame, facts: DataFrame, most: int = SPOKEN_WORDS) -> DataFrame:
    """people(person_id, name, details) to a line: the name, then current work, surest first, skipping what no longer fits
    the word budget; without any, the first speakable roster detail, then the name."""
    ok = facts.where((F.col("category") == "current_work") & is_speakable(F.col("text")))
    listed = F.array_sort(F.collect_list(F.struct((-F.col("confidence")).alias("c"), "fact_id", F.trim("text").alias("t"), word_count(F.col("text")).alias("w"))))
    p = people.join(ok.groupBy("person_id").agg(listed.alias("l")), "person_id", "left")
    name = F.regexp_replace(F.trim("name"), r"\.+$", "")
    opening = F.when(name != "", F.concat(name, F.lit("."))).otherwise("")
    start = F.struct(word_count(opening).alias("w"), F.array().cast("array<string>").alias("t"), F.array().cast("array<string>").alias("ids"))

    def step(acc, x):
        fits = acc["w"] + x["w"] <= most
        return F.struct(F.when(fits, acc["w"] + x["w"]).otherwise(acc["w"]).alias("w"), F.when(fits, F.concat(acc["t"], F.array(x["t"]))).otherwise(acc["t"]).alias("t"),
                        F.when(fits, F.concat(acc["ids"], F.array(x["fact_id"]))).otherwise(acc["ids"]).alias("ids"))

    used = F.aggregate(F.coalesce("l", F.array().cast("array<struct<c:double,fact_id:string,t:string,w:int>>")), start, step)
    cased = lambda d: F.trim(F.concat(opening, F.lit(" "), F.upper(F.substring(d, 1, 1)), F.substring(d, F.lit(2), F.char_length(d)), F.lit(".")))
    detail = F.get(F.filter(F.transform(F.filter(F.transform("details", lambda d: F.regexp_replace(F.trim(d), r"\.+$", "")), lambda d: d != ""), cased), lambda d: is_speakable(d)), F.lit(0))
    return p.withColumn("u", used).select(
        "person_id", F.when(F.size("u.t") > 0, F.trim(F.concat_ws(" ", F.when(opening != "", opening), F.array_join("u.t", " ")))).when(
            detail.isNotNull(), detail).otherwise(F.coalesce(F.nullif(opening, F.lit("")), F.nullif(F.col("person_id").cast("string"), F.lit("")), F.lit(WHO_LAST))).alias("line"),
        F.col("u.ids").alias("fact_ids"))


def numbered_sources(mentions: DataFrame) -> DataFrame:
    """mentions(digest_id, mention, doc_id, fact_id, confidence, ...) to one source per document: numbered by first mention,
    shown as its surest fact has it, then the smaller id."""
    rest = [c for c in mentions.columns if c not in ("digest_id", "doc_id", "mention")]
    one = mentions.groupBy("digest_id", "doc_id").agg(F.min("mention").alias("mention"), F.min_by(F.struct(*rest), F.struct((-F.col("confidence")).alias("c"), "fact_id")).alias("r"))
    n = F.row_number().over(Window.partitionBy("digest_id").orderBy("mention", "doc_id"))
    return one.withColumn("number", n).select("digest_id", "number", "doc_id", *(F.col(f"r.{c}").alias(c) for c in rest))


def citations(claims: DataFrame, sources: DataFrame) -> DataFrame:
    """Distinct source numbers per claim in order of first use."""
    j = claims.join(sources.select("digest_id", "doc_id", "number"), ["digest_id", "doc_id"])
    listed = F.array_sort(F.collect_list(F.struct("mention", "number")))
    return j.groupBy("digest_id", "claim_id").agg(F.array_distinct(F.transform(listed, lambda x: x["number"])).alias("numbers"))


def spoken_why(matches: DataFrame) -> DataFrame:
    """matches(.., why, labels) with a why that can be read aloud: as it is, else mended, else an admitted blank. The labels of the
    hubs behind it are names, as they stand and as mended."""
    names, why = F.concat("labels", F.transform("labels", lambda x: speakable(x))), F.trim("why")
    said = lambda w, n: once(speakable(w), lambda mended: F.when(is_speakable(w, nouns=n), w).when((mended != "") & is_speakable(mended, nouns=n), mended).otherwise(WHY_LAST))
    return matches.withColumn("why", once(F.struct(why.alias("w"), names.alias("n")), lambda x: said(x["w"], x["n"])))


def valid_opener(line: Column) -> Column:
    """Whether an opening line may be said."""
    start = F.lit(False)
    for p in OPENINGS:
        start = start | F.startswith(F.trim(line), F.lit(p))
    for p in SURVEILLANCE:
        start = start & ~F.contains(F.lower(line), F.lit(p))
    return F.coalesce(start & is_speakable(F.trim(line), SPOKEN_WORDS), F.lit(False))


def openers(people: DataFrame, answers: DataFrame, hooks: DataFrame) -> DataFrame:
    """(person_id, line, quoted): a model's answer(person_id, line) if it may be said, else the template around the first of
    hooks(person_id, fact_id, text, place) with which it may, else the last resort. quoted is the fact that the template shows.
    An answer that came too late or not at all is a missing row."""
    said = sorted_joins(answers).where(valid_opener(F.col("line"))).groupBy("person_id").agg(F.min(F.trim("line")).alias("said"))
    made = hooks.withColumn("made", F.replace(F.lit(OPENER), F.lit("{}"), F.trim("text"))).where(valid_opener(F.col("made")))
    first = made.groupBy("person_id").agg(F.min_by(F.struct("made", "fact_id"), "place").alias("m"))
    return people.select("person_id").join(said, "person_id", "left").join(first, "person_id", "left").select(
        "person_id", F.coalesce("said", "m.made", F.lit(OPENER_LAST)).alias("line"), F.when(F.col("said").isNull(), F.col("m.fact_id")).alias("quoted"))


def opener_prompts(people: DataFrame, hooks: DataFrame, news: DataFrame) -> DataFrame:
    """(person_id, prompt) for the one model call: the name, the best hook, up to three recent facts."""
    hook = hooks.where("place = 1").select("person_id", F.concat(F.lit("In their own public words: "), F.trim("text")).alias("h"))
    lines = news.groupBy("person_id").agg(F.array_sort(F.collect_list(F.struct("place", F.concat(F.lit("Lately: "), F.trim("text")).alias("t")))).alias("l"))
    return people.join(hook, "person_id", "left").join(lines, "person_id", "left").select(
        "person_id", F.concat_ws("\n", F.concat(F.lit("Guest: "), "name"), "h", F.array_join(F.transform(F.coalesce("l", F.array()), lambda x: x["t"]), "\n"), F.lit("Write one opening question for the host.")).alias("prompt"))


def make_digest(people: DataFrame, facts: DataFrame, matches: DataFrame, behind: DataFrame, answers: DataFrame) -> DataFrame:
    """One row per person: digest_id, person_id, who_line, meet, lately, non_obvious, say_out_loud, sources, policy.

    people(person_id, name, details); facts(person_id, fact_id, doc_id, text, category, kind, confidence, published_at, excluded),
    of which only displayable ones count; matches(person_id, other_id, raw, score, why, labels); behind(person_id, other_id,
    ordinal, fact_id) are facts behind the hubs of a match; answers(person_id, line) come from the opener's model call.

    Each section is one aggregate per person; sections meet by person. What a section shows is left out by later ones
    as the page demands: recent facts repeat neither the opening line nor the non-obvious one, the opener not the first.
    Sources are the documents of all facts shown, numbered by first mention: who, lately, non-obvious, the
    three matches in order, the quoted fact. Displayable facts, which every section reads, are judged once and cut off.
    """
    shown = cut(facts.where(is_displayable(F.col("text"), F.col("excluded"), F.col("confidence"), F.col("kind"))).select(
        "person_id", "fact_id", "doc_id", "text", "category", "kind", "confidence", "published_at"))
    people, shown = sorted_joins(people), sorted_joins(shown)
    who = who_line(people, shown)
    who_facts = who.select("person_id", F.posexplode("fact_ids").alias("at", "fact_id"))
    rare = non_obvious(shown.where(F.col("kind").isin(*NON_OBVIOUS)))
    news = lately(shown, who_facts.select("person_id", "fact_id").unionByName(rare))
    say = openers(people, answers, opener_hooks(shown, who_facts))
    top = spoken_why(meet(sorted_joins(matches)))
    behind = behind.join(top.select("person_id", "other_id", "place"), ["person_id", "other_id"]).join(shown.select("person_id", "fact_id"), ["person_id", "fact_id"])
    mention = lambda section, at, rows: rows.select("person_id", "fact_id", F.struct(F.lit(section).alias("section"), at[0].cast("int").alias("at"), at[1].cast("int").alias("then")).alias("mention"))
    zero = F.lit(0)
    stream = mention(0, (F.col("at"), zero), who_facts).unionByName(mention(1, (F.col("place"), zero), news)).unionByName(mention(2, (zero, zero), rare)).unionByName(
        mention(3, (F.col("place"), F.col("ordinal")), behind)).unionByName(mention(4, (zero, zero), say.where("quoted is not null").withColumnRenamed("quoted", "fact_id")))
    used = stream.join(shown.select("person_id", "fact_id", "doc_id", "confidence"), ["person_id", "fact_id"]).withColumnRenamed("person_id", "digest_id")
    sources = numbered_sources(used.select("digest_id", "mention", "doc_id", "fact_id", "confidence"))
    listed = lambda rows, key, place, what, out: rows.groupBy(key).agg(F.transform(F.array_sort(F.collect_list(F.struct(place, F.struct(*what).alias("x")))), lambda r: r["x"]).alias(out)).withColumnRenamed(key, "person_id")
    page = (
        people.select("person_id").join(sorted_joins(who.select("person_id", F.col("line").alias("who_line"))), "person_id", "left")
        .join(sorted_joins(listed(top, "person_id", "place", ("other_id", "score", "why"), "meet")), "person_id", "left")
        .join(sorted_joins(listed(news, "person_id", "place", ("fact_id",), "lately")), "person_id", "left")
        .join(sorted_joins(rare.withColumnRenamed("fact_id", "non_obvious")), "person_id", "left")
        .join(sorted_joins(say.select("person_id", F.col("line").alias("say_out_loud"))), "person_id", "left")
        .join(sorted_joins(listed(sources, "digest_id", "number", ("number", "doc_id", "fact_id"), "sources")), "person_id", "left"))
    nothing = lambda c: F.coalesce(c, F.array().cast(page.schema[c].dataType))
    return page.select(F.substring(F.sha1(F.concat(F.lit("digest:"), F.col("person_id").cast("string"))), 1, 16).alias("digest_id"), "person_id", "who_line", nothing("meet").alias("meet"),
                       F.transform(nothing("lately"), lambda x: x["fact_id"]).alias("lately"), "non_obvious", "say_out_loud", nothing("sources").alias("sources"), F.lit(POLICY).alias("policy"))


def remembered(digests: DataFrame, most: int = HISTORY) -> DataFrame:
    """The last `most` digests: a top-k report."""
    return digests.orderBy(F.desc("created_at"), F.desc("digest_id")).limit(most)
