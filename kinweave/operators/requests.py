"""Model calls as tables: a request table goes out, a response table comes back, plans only read both."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from kinweave.functions.text import unfence

#: Attempts per request: one retry after an answer that is no valid JSON. Calls per person. Text a verdict is asked on.
ATTEMPTS, MAX_CALLS, PROMPT_CHARS = 2, 80, 8000
#: Which tier answers which schema; what is not named goes to the strong one.
TIERS = {"verdict": "fast", "opener": "fast", "rulings": "fast", "extraction": "strong"}


def tier(schema: Column) -> Column:
    return F.coalesce(F.try_element_at(F.create_map(*(F.lit(x) for kv in TIERS.items() for x in kv)), schema), F.lit("strong"))


def verdict_prompt(name: Column, details: Column, doc: Column, text: Column) -> Column:
    """The question whether a document is about a person."""
    known = F.coalesce(F.nullif(F.array_join(F.transform(details, lambda d: F.concat(F.lit("- "), d)), "\n"), F.lit("")), F.lit("- nothing else"))
    cut = F.when(F.char_length(text) > PROMPT_CHARS, F.lit("\n[cut]")).otherwise(F.lit(""))
    return F.concat(F.lit("Who: "), name, F.lit("\nKnown:\n"), known, F.lit("\nDocument "), doc, F.lit(":\n"), F.substring(text, 1, PROMPT_CHARS), cut,
                    F.lit("\nIs this document about that person? Quote what shows it."))


def extraction_prompt(name: Column, docs: Column) -> Column:
    """The request for cited facts; docs is array<struct<doc_id, text>> of one batch."""
    blocks = F.array_join(F.transform(docs, lambda d: F.concat(F.lit("## "), d["doc_id"], F.lit("\n"), d["text"])), "\n\n")
    return F.concat(F.lit("Facts about "), name, F.lit(" that these documents state, each with its exact words:\n\n"), blocks)


def budgeted(requests: DataFrame, most: int = MAX_CALLS) -> DataFrame:
    """requests(person_id, call_ordinal, ...) with `allowed`: the first `most` calls of a person."""
    n = F.row_number().over(Window.partitionBy("person_id").orderBy("call_ordinal"))
    return requests.withColumn("allowed", n <= most)


def answers(requests: DataFrame, responses: DataFrame, schema: str) -> DataFrame:
    """One row per request(request_id): `answer` from the first of ATTEMPTS responses(request_id, attempt, text, refused) that
    parses, fenced or not; null with `failed` for refusals, malformed answers and silence. A refusal ends the attempts."""
    parsed = F.from_json(unfence(F.col("text")), schema)
    valid = F.try_parse_json(unfence(F.col("text"))).isNotNull() & F.startswith(F.ltrim(unfence(F.col("text"))), F.lit("{"))
    r = responses.where(F.col("attempt").between(1, ATTEMPTS)).withColumn("__ok", F.coalesce(valid & ~F.coalesce("refused", F.lit(False)), F.lit(False)))
    first = r.groupBy("request_id").agg(F.min(F.when(F.col("__ok"), F.struct("attempt", "text"))).alias("__a"), F.min(F.when(F.col("refused"), F.col("attempt"))).alias("__no"), F.count("*").alias("attempts"))
    used = F.when(F.col("__no").isNull() | (F.col("__a.attempt") < F.col("__no")), F.col("__a.text"))
    out = requests.join(first.withColumn("text", used).select("request_id", "text", "attempts"), "request_id", "left")
    return out.withColumn("answer", F.when(F.col("text").isNotNull(), parsed)).withColumn("failed", F.col("text").isNull()).withColumn("attempts", F.coalesce("attempts", F.lit(0))).drop("text")


def counters(requests: DataFrame) -> DataFrame:
    """(person_id, calls, refused_by_budget, errors) of budgeted requests with `failed`."""
    return requests.groupBy("person_id").agg(F.count_if("allowed").alias("calls"), F.count_if(~F.col("allowed")).alias("refused_by_budget"), F.count_if(F.col("allowed") & F.col("failed")).alias("errors"))


def request_key(url: Column, method: Column, body: Column, headers: Column) -> Column:
    """What an answer is stored under: the address of a plain GET, else verb, address, body and the first 16 hex digits of a
    digest of the headers, whose names are lower-cased and sorted."""
    verb = F.upper(F.coalesce(F.nullif(method, F.lit("")), F.lit("GET")))
    listed = F.array_sort(F.transform(F.map_entries(headers), lambda e: F.concat(F.lit("["), F.to_json(F.array(F.lower(e["key"]))), F.lit(", "), F.to_json(F.array(e["value"])), F.lit("]"))))
    digest = F.when(F.size(F.coalesce(F.map_keys(headers), F.array().cast("array<string>"))) > 0, F.concat(F.lit("h="), F.substring(F.sha2(F.array_join(listed, ", "), 256), 1, 16)))
    return F.when((verb == "GET") & body.isNull() & digest.isNull(), url).otherwise(F.concat_ws(" ", verb, url, body, digest))
