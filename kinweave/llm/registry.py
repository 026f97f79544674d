"""Queries of this subpackage's operators, one opN_<name> each, and their DuckDB SQL where SQL can say it."""

from __future__ import annotations

from collections.abc import Callable

import public_tokenizers
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .bpe import encode_digests
from .chat import events_from_messages, format_chat
from .embedding_dedup import embedding_duplicates
from .exact_dedup import exact_duplicates
from .minhash_dedup import near_duplicates
from .packing import pack
from .pii import pii_digest
from .substring_dedup import remove_repeats
from .token_count import token_counts
from .toxicity import toxicity_scores, train


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


#: The one tool that op2's calls use: a user's turn asks it for a reply.
REPLY = {"reply": {
    "type": "object", "required": ["prompt", "options"], "additionalProperties": False,
    "properties": {
        "prompt": {"type": "string"},
        "strict": {"type": "boolean", "enum": [True]},
        "options": {"type": "object", "properties": {"tries": {"type": "integer", "minimum": 0}, "tags": {"type": "array", "items": {"type": "string"}}}, "required": ["tries"]},
        "after": {"type": "object", "properties": {"$ref": {"type": "string"}}, "required": ["$ref"], "additionalProperties": False},
    }}}


def turns_as_calls(conversations: DataFrame) -> DataFrame:
    """Events of all conversations. Tool calls and results in the messages are what they are; every other user turn becomes a
    call of the tool `reply` and every other assistant turn a result; other roles stay messages. Traffic of all shapes
    comes from fixed rules on p = (conv_id + turn div 2) mod 8 of a user turn, whose id is conversation and turn:

    0 the answer after it goes to the next user turn's id, which makes an early result; 1 refers to the user turn
    before; 2 has a word where the schema wants an integer; 3 and 4 refer to each other's turns, a cycle; 5 refers to
    the user turn after it; 6 is plain; 7 uses the id of the user turn before it again."""
    events = events_from_messages(conversations)
    plain = ~F.col("role").isin("call", "result") & F.col("call_id").isNull()
    call, result = F.coalesce(plain & (F.col("role") == "user"), F.lit(False)), F.coalesce(plain & (F.col("role") == "assistant"), F.lit(False))
    p = lambda t: F.pmod(F.col("conv_id") + F.floor(t / 2).cast("long"), F.lit(8))
    name = lambda t: F.concat(F.col("conv_id").cast("string"), F.lit("-"), t.cast("string"))
    turn, mine, asked = F.col("turn"), p(F.col("turn")), p(F.col("turn") - 1)
    quoted = F.coalesce(F.regexp_extract(F.to_json(F.struct(F.col("text").alias("t"))), r'(?s)^\{"t":(.*)\}$', 1), F.lit("null"))
    after = F.when(mine.isin(1, 4), name(turn - 2)).when(mine.isin(3, 5), name(turn + 2))
    arguments = F.concat(
        F.lit('{"strict": true, "prompt": '), F.when(F.col("text").isNull(), "null").otherwise(quoted), F.lit(', "options": {"tries": '),
        F.when(mine == 2, '"many"').otherwise(F.concat(F.floor(turn / 2).cast("string"), F.lit(".0"))), F.lit(', "tags": ["user"]}'),
        F.coalesce(F.concat(F.lit(', "after": {"$ref": "'), after, F.lit('"}')), F.lit("")), F.lit("}"))
    return events.select(
        "conv_id", "turn", "item",
        F.when(call, "call").when(result, "result").otherwise(F.col("role")).alias("role"),
        F.when(call, "reply").otherwise(F.col("name")).alias("name"),
        F.when(call, F.when(mine == 7, name(turn - 2)).otherwise(name(turn))).when(result, F.when(asked == 0, name(turn + 1)).otherwise(name(turn - 1))).otherwise(F.col("call_id")).alias("call_id"),
        F.when(~call, F.col("text")).alias("text"), F.when(call, arguments).otherwise(F.col("arguments")).alias("arguments"))


def op1_embedding_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return embedding_duplicates(table(spark, sf_dir, "embeddings"))


def op2_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    return format_chat(turns_as_calls(table(spark, sf_dir, "conversations")), REPLY)


def op3_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    return encode_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op4_packing(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.json"))


def op5_minhash_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return near_duplicates(table(spark, sf_dir, "documents"), percent=85)


def op6_toxicity(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    return toxicity_scores(docs, train(docs, table(spark, sf_dir, "labels")))


def op7_substring_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return remove_repeats(table(spark, sf_dir, "documents"), digest=True)


def op8_token_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    return token_counts(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


def op9_exact_dedup(spark: SparkSession, sf_dir: str) -> DataFrame:
    return exact_duplicates(table(spark, sf_dir, "documents"))


def op10_pii(spark: SparkSession, sf_dir: str) -> DataFrame:
    return pii_digest(table(spark, sf_dir, "documents"))


def queries() -> dict[str, Callable[[SparkSession, str], DataFrame]]:
    return {f.__name__: f for f in (
        op1_embedding_dedup, op2_chat_format, op3_bpe, op4_packing, op5_minhash_dedup,
        op6_toxicity, op7_substring_dedup, op8_token_counts, op9_exact_dedup, op10_pii)}


def oracle_sql() -> dict[str, str]:
    return {
        # u are user turns with p as in turns_as_calls(), c the first call of each id, w those that wait for the next user turn
        "op2_chat_format": """
            WITH m AS (SELECT conv_id, turn, role, text, (conv_id + turn // 2) % 8 AS p, (conv_id + (turn - 1) // 2) % 8 AS asked,
                CASE role WHEN 'user' THEN 'call' WHEN 'assistant' THEN 'result' ELSE 'message' END AS kind FROM conversations),
            e AS (SELECT *, CASE kind WHEN 'call' THEN conv_id || '-' || (turn - CASE WHEN p = 7 THEN 2 ELSE 0 END)
                WHEN 'result' THEN conv_id || '-' || (turn + CASE WHEN asked = 0 THEN 1 ELSE -1 END) END AS call_id FROM m),
            c AS (SELECT conv_id, call_id, min(turn) AS own FROM e WHERE kind = 'call' GROUP BY ALL),
            r AS (SELECT conv_id, call_id, min(turn) AS answer FROM e WHERE kind = 'result' GROUP BY ALL),
            l AS (SELECT e.*, c.own, r.answer, e.kind = 'call' AND e.turn = c.own AS mine FROM e LEFT JOIN c USING (conv_id, call_id) LEFT JOIN r USING (conv_id, call_id)),
            o AS (SELECT conv_id, call_id, turn, p, answer FROM l WHERE mine),
            x AS (SELECT o.conv_id, o.call_id, o.turn, (o.p = 3 AND n.p = 4) OR (o.p = 4 AND b.p = 3) AS cyclic, o.p = 5 AND n.turn IS NOT NULL AS waits,
                coalesce(n.answer, n.turn) AS at, CASE WHEN n.answer IS NULL THEN 2 ELSE 1 END AS level
              FROM o LEFT JOIN o n ON n.conv_id = o.conv_id AND n.call_id = o.conv_id || '-' || (o.turn + 2) AND n.turn = o.turn + 2
                     LEFT JOIN o b ON b.conv_id = o.conv_id AND b.call_id = o.conv_id || '-' || (o.turn - 2) AND b.turn = o.turn - 2),
            y AS (SELECT l.*, coalesce(x.cyclic, false) AS cyc, CASE WHEN x.waits THEN x.at ELSE own END AS call_turn, CASE WHEN x.waits THEN x.level ELSE 0 END AS call_level
              FROM l LEFT JOIN x ON x.conv_id = l.conv_id AND x.call_id = l.call_id)
            SELECT conv_id, turn, 0 AS item, kind, call_id,
                   CASE kind WHEN 'call' THEN mine AND answer IS NOT NULL WHEN 'result' THEN own IS NOT NULL END AS linked,
                   CASE kind WHEN 'call' THEN text IS NOT NULL AND p <> 2 END AS valid,
                   CASE WHEN mine OR kind = 'result' THEN cyc ELSE false END AS cyclic,
                   CASE WHEN mine THEN call_turn WHEN kind = 'result' THEN greatest(turn, coalesce(call_turn, turn)) ELSE turn END AS order_turn,
                   CASE WHEN mine THEN call_level WHEN kind = 'result' AND call_turn >= turn THEN call_level + 1 ELSE 0 END AS order_level,
                   CASE kind
                     WHEN 'call' THEN '{"arguments":{' || CASE WHEN p IN (1, 4) THEN '"after":{"$ref":"' || conv_id || '-' || (turn - 2) || '"},' WHEN p IN (3, 5) THEN '"after":{"$ref":"' || conv_id || '-' || (turn + 2) || '"},' ELSE '' END
                       || '"options":{"tags":["user"],"tries":' || CASE WHEN p = 2 THEN '"many"' ELSE CAST(turn // 2 AS VARCHAR) END || '},"prompt":' || to_json(text) || ',"strict":true},"id":' || to_json(call_id) || ',"name":"reply","role":"call"}'
                     WHEN 'result' THEN '{"content":' || to_json(text) || ',"role":"result","tool_call_id":' || to_json(call_id) || '}'
                     ELSE '{"content":' || to_json(text) || ',"role":' || to_json(role) || '}' END AS json
            FROM y""",
        "op9_exact_dedup": """
            WITH n AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents)
            SELECT doc_id, max(doc_id) OVER (PARTITION BY t) AS keep_id, count(*) OVER (PARTITION BY t) AS group_size,
                   doc_id = max(doc_id) OVER (PARTITION BY t) AS kept, sha256(t) AS text_sha256
            FROM n""",
    }
