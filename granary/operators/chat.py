"""Chat data between its forms: turns, single pairs, nested conversations, canonical messages, flat rows."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from granary.functions.text import strip

MESSAGE = "struct<role:string,content:string>"


def _message(role: str, content: Column) -> Column:
    return F.struct(F.lit(role).alias("role"), content.alias("content"))


def text_or_null(value: Column) -> Column:
    """The text of a variant that is one; null for numbers, lists, objects and the rest."""
    return F.when(F.schema_of_variant(value) == "STRING", F.try_variant_get(value, "$", "string"))


def turns_to_messages(conversation: Column, user_key: str = "human", assistant_key: str = "assistant") -> Column:
    """array<map<string,string>> to messages: of each turn the user's first, then the assistant's, if the key is there."""
    one = lambda t, key, role: F.when(F.map_contains_key(t, key), _message(role, t[key]))
    return F.flatten(F.transform(conversation, lambda t: F.filter(F.array(one(t, user_key, "user"), one(t, assistant_key, "assistant")), lambda m: m.isNotNull())))


def pair_to_messages(prompt: Column, response: Column) -> Column:
    return F.array(_message("user", prompt), _message("assistant", response))


def records_to_messages(lines: DataFrame, user_key: str = "human", assistant_key: str = "assistant") -> DataFrame:
    """(file, messages) of JSON lines that are either {prompt, response} or {conversation: [...]}.

    A content that is no text is null, so examples pass over it. The single pair goes before the conversation; records of neither form, turns that are no
    objects and empty results are dropped, as are lines that are no JSON objects.
    """
    record = F.try_parse_json("line")
    keys = F.json_object_keys("line")
    get = lambda path: text_or_null(F.try_variant_get(record, path, "variant"))
    single = F.array_contains(keys, "prompt") & F.array_contains(keys, "response")
    turns = F.try_variant_get(record, "$.conversation", "array<variant>")
    objects = F.filter(turns, lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    maps = F.transform(objects, lambda t: F.transform_values(F.try_variant_get(t, "$", "map<string,variant>"), lambda _, v: text_or_null(v)))
    messages = F.when(F.coalesce(single, F.lit(False)), pair_to_messages(get("$.prompt"), get("$.response"))).otherwise(turns_to_messages(maps, user_key, assistant_key))
    return lines.select("file", messages.alias("messages")).where(F.size("messages") > 0)


def turns_to_rows(lines: DataFrame, user_key: str = "human", assistant_key: str = "assistant") -> DataFrame:
    """(file, human, assistant): one row for each turn of {conversation: [...]}, stripped; missing and null are empty. Lines of other forms have no rows."""
    turns = F.try_variant_get(F.try_parse_json("line"), "$.conversation", "array<variant>")
    objects = F.filter(turns, lambda t: F.schema_of_variant(t).startswith("OBJECT"))
    said = lambda key: strip(F.coalesce(F.try_variant_get("turn", f"$.{key}", "string"), F.lit("")))
    return lines.select("file", F.explode(objects).alias("turn")).select("file", said(user_key).alias("human"), said(assistant_key).alias("assistant"))


def nest(df: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """Rows of turns to one row of messages for each conversation, in turn order.

    Rows of one turn number are ordered by role, then text; nulls come first and stay null. Repeated
    rows are messages of their own. Null is a conversation of its own. Further columns are left out.
    """
    rows = F.sort_array(F.collect_list(F.struct(F.col(turn).alias("turn"), F.col(role).alias("role"), F.col(text).alias("content"))))
    return df.groupBy(conv).agg(rows.alias("rows")).select(conv, F.transform("rows", lambda r: F.struct(r["role"].alias("role"), r["content"].alias("content"))).alias("messages"))


def flat(df: DataFrame, conv: str = "conv_id") -> DataFrame:
    """One row for each message, with its position from 0; conversations without messages have none. Null roles and contents stay null."""
    return df.select(conv, F.posexplode("messages").alias("position", "message")).select(conv, "position", "message.role", "message.content")


def paired(messages: Column) -> Column:
    """Messages to (human, assistant) pairs: each user message with the assistant message right after it, if any.

    Null contents are empty; an assistant message that follows no user message is passed over, as are
    other roles and null ones; without messages there are no pairs.
    """
    with_next = F.transform(messages, lambda m, i: F.struct(m.alias("m"), F.get(messages, i + 1).alias("n")))
    users = F.filter(with_next, lambda x: x["m"]["role"] == "user")
    return F.transform(users, lambda x: F.struct(strip(F.coalesce(x["m"]["content"], F.lit(""))).alias("human"), F.when(x["n"]["role"] == "assistant", strip(F.coalesce(x["n"]["content"], F.lit("")))).otherwise("").alias("assistant")))
