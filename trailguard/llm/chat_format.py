"""Chat formatting: records of many layouts to one template with a loss mask. DataFrame functions only.

A record is a JSON object. The nested fields that it has, of those that any layout knows, are its paths; their hash is the
record's schema fingerprint, which selects a declarative mapping, a SQL expression that gives the canonical turns (role,
text). Turns are written as `<|turn|>role<|text|>text<|end|>`; in roles and texts every control string (of this template
and of other common ones) gets a backslash after its first character, one more where it has some, so undoing takes one
away and the text comes back exactly. The loss mask is the spans of the assistant's texts in the formatted string.

Texts may be as long as a column can hold; columns besides conv_id, turn, role and text aren't read. Null roles and texts are
empty; a record of an unknown layout has no turns and the formatted string ''; turns of equal
number are in the order of role and text, a null number comes first; rows with a null conv_id are one conversation; an
empty table gives no rows (the query: the added conversation only).
"""

from __future__ import annotations

import re
from itertools import chain, combinations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

TURN, TEXT, END = "<|turn|>", "<|text|>", "<|end|>"
CONTROLS = ["<|", "<s>", "</s>", "[INST]", "[/INST]"]
RECORD = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<from:string,value:string>>, "
    "turns array<struct<turn:bigint,role:string,text:string>>, prompt string, response string, completion string, "
    "instruction string, input string, output string, question string, answer string, system string"
)
_PAIR = "array(named_struct('role', 'user', 'text', {0}), named_struct('role', 'assistant', 'text', {1}))"
_SYSTEM = "filter(array(named_struct('role', 'system', 'text', r.system)), x -> x.text is not null)"
_ROLES = "case x.{0} when 'human' then 'user' when 'gpt' then 'assistant' when 'bot' then 'assistant' else x.{0} end"
#: Layouts: paths that a record has, paths that it may have besides, and the turns as SQL over the record r.
MAPPINGS = [
    (["turns[].role", "turns[].text"], ["turns[].turn"], "transform(array_sort(r.turns), x -> named_struct('role', x.role, 'text', x.text))"),
    (["messages[].role", "messages[].content"], ["system"], f"concat({_SYSTEM}, transform(r.messages, x -> named_struct('role', {_ROLES.format('role')}, 'text', x.content)))"),
    (["conversations[].from", "conversations[].value"], ["system"], f"concat({_SYSTEM}, transform(r.conversations, x -> named_struct('role', {_ROLES.format('from')}, 'text', x.value)))"),
    (["prompt", "response"], ["system"], f"concat({_SYSTEM}, {_PAIR.format('r.prompt', 'r.response')})"),
    (["prompt", "completion"], ["system"], f"concat({_SYSTEM}, {_PAIR.format('r.prompt', 'r.completion')})"),
    (["question", "answer"], ["system"], f"concat({_SYSTEM}, {_PAIR.format('r.question', 'r.answer')})"),
    (["instruction", "output"], ["input", "system"], f"concat({_SYSTEM}, {_PAIR.format(chr(10).join(['concat_ws(chr(10), r.instruction, nullif(r.input, {0}))']).format(repr('')), 'r.output')})"),
]
PATHS = sorted({p for required, optional, _ in MAPPINGS for p in [*required, *optional]})
_NO_TURNS = "cast(array() as array<struct<role:string,text:string>>)"


def fingerprint(paths: Column) -> Column:
    return F.xxhash64(F.array_join(paths, "\n"))


def _paths(record: str) -> Column:
    """The known paths, in order, that a record has."""
    has = []
    for p in PATHS:
        outer, _, inner = p.partition("[].")
        there = f"exists({record}.{outer}, x -> x.{inner} is not null)" if inner else f"{record}.{p} is not null"
        has.append(f"case when {there} then '{p}' end")
    return F.expr(f"filter(array({', '.join(has)}), p -> p is not null)")


def canonical_turns(records: DataFrame, record: str = "record") -> DataFrame:
    """All columns of records, with `record` (JSON) replaced by schema_fingerprint and turns (array of role, text)."""
    # one string may be as long as a column can hold
    parsed = records.withColumn("r", F.from_json(record, RECORD, {"maxStringLen": str(2**31 - 1)})).withColumn("schema_fingerprint", fingerprint(_paths("r")))
    turns = F.expr(_NO_TURNS)
    for required, optional, sql in MAPPINGS:
        kinds = chain.from_iterable(combinations(optional, n) for n in range(len(optional) + 1))
        known = [fingerprint(F.array(*map(F.lit, sorted([*required, *more])))) for more in kinds]
        turns = F.when(F.col("schema_fingerprint").isin(*known), F.expr(f"cast({sql} as array<struct<role:string,text:string>>)")).otherwise(turns)
    return parsed.withColumn("turns", F.coalesce(turns, F.expr(_NO_TURNS))).drop("r", record)


def escape(c: Column) -> Column:
    for control in CONTROLS:
        c = F.regexp_replace(c, rf"{re.escape(control[0])}(\\*){re.escape(control[1:])}", rf"{control[0]}\\$1{control[1:]}")
    return c


def unescape(c: Column) -> Column:
    for control in reversed(CONTROLS):
        c = F.regexp_replace(c, rf"{re.escape(control[0])}\\(\\*){re.escape(control[1:])}", rf"{control[0]}$1{control[1:]}")
    return c


def format_turns(conversations: DataFrame) -> DataFrame:
    """conv_id, formatted and loss (spans of code points, start from 0 and length) of rows (conv_id, turns)."""
    rows = conversations.select("conv_id", F.posexplode_outer("turns").alias("pos", "turn"))
    clean = lambda f: escape(F.coalesce(F.col(f"turn.{f}"), F.lit("")))
    rows = rows.select("conv_id", "pos", F.col("turn.role").alias("role"), F.concat(F.lit(TURN), clean("role"), F.lit(TEXT)).alias("head"), clean("text").alias("body"))
    rows = rows.withColumn("piece", F.when(F.col("pos").isNotNull(), F.concat("head", "body", F.lit(END))).otherwise(""))
    before = Window.partitionBy("conv_id").orderBy("pos").rowsBetween(Window.unboundedPreceding, -1)
    rows = rows.withColumn("start", F.coalesce(F.sum(F.length("piece")).over(before), F.lit(0)) + F.length("head"))
    span = F.when(F.col("role") == "assistant", F.struct(F.col("start").cast("long").alias("start"), F.length("body").cast("long").alias("length")))
    one = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct(F.coalesce("pos", F.lit(0)).alias("pos"), "piece", span.alias("span")))).alias("all"))
    return one.select("conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"), F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss"))


def parse(formatted: DataFrame) -> DataFrame:
    """conv_id, formatted, turns (role, text) and loss_text (all text under the mask), read back from the output alone."""
    ends = F.split("formatted", re.escape(END))
    parts = F.transform(F.slice(ends, F.lit(1), F.size(ends) - 1), lambda p: F.split(p, re.escape(TEXT), 2))
    turns = F.transform(parts, lambda p: F.struct(unescape(F.substr(p[0], F.lit(len(TURN) + 1))).alias("role"), unescape(p[1]).alias("text")))
    masked = F.transform("loss", lambda s: unescape(F.substr(F.col("formatted"), (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return formatted.select("conv_id", "formatted", turns.alias("turns"), F.array_join(masked, "").alias("loss_text"))


def records_of_rows(rows: DataFrame) -> DataFrame:
    """conv_id and record (JSON) from rows (conv_id, turn, role, text): records of several layouts, as corpora of several
    origins have them. Of conversations of plain roles a quarter are messages, a quarter are from-value pairs, and of the
    exchanges of two turns (or three, with the system's first) a quarter are prompt and response; all others are numbered
    turns, the only layout that holds any role."""
    empty = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("")).alias(c)
    turn = F.struct(F.col("turn").cast("long").alias("turn"), empty("role"), empty("text"))
    all_ = rows.groupBy("conv_id").agg(F.collect_list(turn).alias("turns"))
    # an order for the layouts that have none of their own
    all_ = all_.withColumn("t", F.array_sort("turns"))
    plain = F.forall("t", lambda x: x["role"].isin("system", "user", "assistant"))
    kind = F.when(plain, F.pmod(F.coalesce("conv_id", F.lit(0)), F.lit(4))).otherwise(0)
    roles, said = F.array_join("t.role", ","), lambda i: F.col("t.text")[i]
    messages = F.transform("t", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("content")))
    pairs = F.transform("t", lambda x: F.struct(F.when(x["role"] == "user", "human").when(x["role"] == "assistant", "gpt").otherwise(x["role"]).alias("from"), x["text"].alias("value")))
    layouts = [
        ((kind == 1), F.struct(messages.alias("messages"))),
        ((kind == 2), F.struct(pairs.alias("conversations"))),
        ((kind == 3) & (roles == "user,assistant"), F.struct(said(0).alias("prompt"), said(1).alias("response"))),
        ((kind == 3) & (roles == "system,user,assistant"), F.struct(said(0).alias("system"), said(1).alias("prompt"), said(2).alias("response"))),
    ]
    record = F.to_json(F.struct("turns"))
    for has, of in layouts:
        record = F.when(has, F.to_json(of)).otherwise(record)
    return all_.select("conv_id", record.alias("record"))


def op6_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    odd = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"), "role", "text")
    added = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(odd).alias("text"))
    out = parse(format_turns(canonical_turns(records_of_rows(rows.unionByName(added)))))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


def _escaped_sql(c: str) -> str:
    for control in CONTROLS:
        c = f"regexp_replace({c}, '{re.escape(control[0])}(\\\\*){re.escape(control[1:])}', '{control[0]}\\\\\\1{control[1:]}', 'g')"
    return c


OP6_SQL = f"""
WITH c AS (SELECT CAST(conv_id AS BIGINT) AS conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL VALUES (-7, 0, 'user', '</s>[INST] ok [/INST]'), (-7, 1, 'assistant', '</s>[INST] ok [/INST]'))
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
  CAST(sum({len(TURN + TEXT + END)} + length({_escaped_sql('role')}) + length({_escaped_sql('text')})) AS BIGINT) AS formatted_chars
FROM c GROUP BY conv_id
"""
