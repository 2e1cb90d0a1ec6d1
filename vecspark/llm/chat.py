"""Chat formatting by schema fingerprint.

Records come in many layouts: columns for prompt and response, instruction records, lists of messages, one row a turn. The sorted nested
field paths of a layout are hashed; the hash selects a declarative mapping that turns the record into canonical turns (role, text). One
template then writes the turns, and ``read_back`` takes them from the output again. Everything is a DataFrame expression.
"""

from __future__ import annotations

from hashlib import sha256

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql import types as T

TURNS = "array<struct<role:string,text:string>>"
#: Marks of the template. A text holds none of them once escaped.
START, MIDDLE, END = "<|turn|>", "<|text|>", "<|end|>\n"
#: What is escaped in texts and roles, in this order, so that no control string of this or another template stands in them.
ESCAPES = (("~", "~0"), ("<", "~1"), ("[", "~2"))


def escape(text: Column) -> Column:
    for plain, escaped in ESCAPES:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def unescape(text: Column) -> Column:
    for plain, escaped in reversed(ESCAPES):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def paths(schema: T.DataType, prefix: str = "") -> list[str]:
    """Sorted nested field paths; an array adds ``[]``."""
    if isinstance(schema, T.StructType):
        return sorted(p for f in schema for p in paths(f.dataType, f"{prefix}.{f.name}" if prefix else f.name))
    if isinstance(schema, T.ArrayType):
        return paths(schema.elementType, f"{prefix}[]")
    return [prefix]


def fingerprint(field_paths: list[str]) -> str:
    return sha256("\n".join(sorted(field_paths)).encode()).hexdigest()[:16]


def _pairs(**roles: str) -> str:
    """SQL for turns from single fields; absent or null fields give no turn."""
    return "filter(array(" + ", ".join(f"if({field} IS NULL, NULL, named_struct('role', '{role}', 'text', {field}))" for field, role in roles.items()) + "), x -> x IS NOT NULL)"


#: Layout's fields -> SQL of its turns.
MAPPINGS: dict[tuple[str, ...], str] = {
    ("messages[].content", "messages[].role"): "transform(messages, m -> named_struct('role', m.role, 'text', m.content))",
    ("conversations[].from", "conversations[].value"): "transform(conversations, m -> named_struct('role', CASE m.from WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' ELSE m.from END, 'text', m.value))",
    ("turns[].role", "turns[].text"): "transform(turns, m -> named_struct('role', m.role, 'text', m.text))",
    ("prompt", "response"): _pairs(prompt="user", response="assistant"),
    ("completion", "prompt"): _pairs(prompt="user", completion="assistant"),
    ("question", "answer"): _pairs(question="user", answer="assistant"),
    ("instruction", "output"): _pairs(instruction="user", output="assistant"),
    ("input", "instruction", "output"): "array(named_struct('role', 'user', 'text', concat_ws('\n', instruction, nullif(input, ''))), named_struct('role', 'assistant', 'text', output))",
    ("prompt", "response", "system"): _pairs(system="system", prompt="user", response="assistant"),
}
BY_FINGERPRINT = {fingerprint(list(fields)): (fields, turns) for fields, turns in MAPPINGS.items()}
#: Every layout's fields, for records that come as JSON.
JSON_SCHEMA = (
    "messages array<struct<role:string,content:string>>, conversations array<struct<`from`:string,value:string>>, turns array<struct<role:string,text:string>>, "
    "prompt string, response string, completion string, question string, answer string, instruction string, input string, output string, system string"
)


def canonical(df: DataFrame, key: str, columns: list[str] | None = None) -> DataFrame:
    """(key, layout, turns) of records that share one layout, read from the frame's schema.

    ``columns``: the record's columns (default all but ``key``); others are ignored. An unknown layout is an error.
    """
    record = df.select(*(columns or [c for c in df.columns if c != key]))
    layout = fingerprint(paths(record.schema))
    if layout not in BY_FINGERPRINT:
        raise ValueError(f"no mapping for the fields {paths(record.schema)}")
    return df.select(key, F.lit(layout).alias("layout"), F.expr(BY_FINGERPRINT[layout][1]).cast(TURNS).alias("turns"))


def json_fingerprint(record: Column) -> Column:
    """Each JSON record's own fingerprint: fields whose value is null count; arrays show the fields of their first element."""
    keys = F.coalesce(F.json_object_keys(record), F.array())

    def inner(k: Column) -> Column:
        first = F.call_function("get_json_object", record, F.concat(F.lit("$."), k, F.lit("[0]")))
        return F.coalesce(F.transform(F.json_object_keys(first), lambda x: F.concat(k, F.lit("[]."), x)), F.array(k))

    return F.substring(F.sha2(F.array_join(F.array_sort(F.flatten(F.transform(keys, inner))), "\n"), 256), 1, 16)


def canonical_json(df: DataFrame, key: str, record: str) -> DataFrame:
    """(key, layout, turns) of JSON records of mixed layouts; turns are null where the layout is unknown or the JSON broken."""
    named = df.select(key, json_fingerprint(F.col(record)).alias("layout"), F.from_json(record, JSON_SCHEMA).alias("_r"))
    flat = named.select(key, "layout", "_r.*")
    turns = F.lit(None).cast(TURNS)
    for layout, (_, sql) in BY_FINGERPRINT.items():
        turns = F.when(F.col("layout") == layout, F.expr(sql).cast(TURNS)).otherwise(turns)
    return flat.select(key, "layout", turns.alias("turns"))


#: Fields of a row for one turn -> its role and text. Fields that are null are not there.
ROW_MAPPINGS: dict[tuple[str, ...], tuple[str, str]] = {
    ("role", "text"): ("role", "text"), ("role",): ("role", "''"), ("text",): ("''", "text"), (): ("''", "''"),
}
ROWS_BY_FINGERPRINT = {fingerprint(list(fields)): said for fields, said in ROW_MAPPINGS.items()}


def row_fingerprint(fields: dict[str, Column]) -> Column:
    """Each row's own fingerprint: the names of those fields that are not null."""
    there = F.filter(F.array(*(F.when(c.isNotNull(), F.lit(n)) for n, c in sorted(fields.items()))), lambda x: x.isNotNull())
    return F.substring(F.sha2(F.array_join(there, "\n"), 256), 1, 16)


def canonical_rows(df: DataFrame, key: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(key, layout, turns) of a table with one row a turn. Each row's fingerprint selects how its turn is read; ``layout`` joins those
    that a conversation has. Turns of one number go by role, then text; null numbers come first. Rows alike in all count as often as
    they come. Empty in, empty out. Other columns take no part.

    A conversation is one row of the result, so its turns meet in one place; rows with a null key are one conversation.
    """
    named = df.select(F.col(key).alias("_key"), F.col(turn).alias("_n"), F.col(role).alias("role"), F.col(text).alias("text"))
    printed = named.withColumn("_layout", row_fingerprint({"role": F.col("role"), "text": F.col("text")}))
    said = [F.lit(None).cast("string"), F.lit(None).cast("string")]
    for layout, sql in ROWS_BY_FINGERPRINT.items():
        said = [F.when(F.col("_layout") == layout, F.expr(x)).otherwise(y) for x, y in zip(sql, said, strict=True)]
    record = F.struct(F.col("_n").alias("n"), said[0].alias("role"), said[1].alias("text"), F.col("_layout").alias("layout"))
    listed = printed.groupBy(F.col("_key").alias(key)).agg(F.sort_array(F.collect_list(record)).alias("_t"))
    layouts = F.array_join(F.array_sort(F.array_distinct(F.transform("_t", lambda t: t["layout"]))), ",")
    turns = F.transform("_t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))
    return listed.select(key, layouts.alias("layout"), turns.cast(TURNS).alias("turns"))


def render(turns: Column) -> Column:
    """The template's text; null roles and texts are empty."""
    one = F.transform(turns, lambda t: F.concat(F.lit(START), escape(F.coalesce(t["role"], F.lit(""))), F.lit(MIDDLE), escape(F.coalesce(t["text"], F.lit(""))), F.lit(END)))
    return F.array_join(one, "")


def parse(formatted: Column) -> Column:
    """Turns of a formatted text, unescaped."""
    pieces = F.filter(F.split(formatted, F.lit(r"<\|turn\|>")), lambda p: p != "")

    def turn(p: Column) -> Column:
        cut = F.instr(p, MIDDLE)
        body = F.substr(p, cut + len(MIDDLE), F.length(p) - cut - len(MIDDLE) - len(END) + 1)
        return F.struct(unescape(F.substr(p, F.lit(1), cut - 1)).alias("role"), unescape(body).alias("text"))

    return F.transform(pieces, turn)


def mask(turns: Column, role: str = "assistant") -> Column:
    """Where the template's text has what this role says: first code point, from 0, and number of code points of each text, escaped."""
    size = lambda x: F.length(escape(F.coalesce(x, F.lit(""))))
    fixed = [F.lit(len(x)) for x in (START, MIDDLE, END)]
    none = F.array().cast("array<struct<start:int,length:int>>")

    def step(a: Column, t: Column) -> Column:
        start = a["at"] + fixed[0] + size(t["role"]) + fixed[1]
        span = F.array(F.struct(start.alias("start"), size(t["text"]).alias("length")))
        spans = F.when(t["role"] == role, F.concat(a["spans"], span)).otherwise(a["spans"])
        return F.struct((start + size(t["text"]) + fixed[2]).alias("at"), spans.alias("spans"))

    return F.aggregate(turns, F.struct(F.lit(0).alias("at"), none.alias("spans")), step, lambda a: a["spans"])


def format_chats(conversations: DataFrame, key: str) -> DataFrame:
    """Adds ``formatted`` and ``mask``, the code points of it that count for the loss, to (key, layout, turns). Conversations without
    turns give an empty text and no mask; null turns give nulls."""
    return conversations.withColumn("formatted", render(F.col("turns"))).withColumn("mask", mask(F.col("turns")))


def read_back(formatted: DataFrame, key: str) -> DataFrame:
    """Digests of what the formatted texts hold: all turns, and the text under the mask, unescaped."""
    turns = formatted.select(key, "formatted", "mask", F.inline(F.array(F.struct(parse(F.col("formatted")).alias("_t")))))
    masked = F.transform("mask", lambda s: unescape(F.substr(F.col("formatted"), s["start"] + 1, s["length"])))
    said = turns.select("*", F.inline(F.array(F.struct(F.array_join(masked, "").alias("_loss")))))
    return said.select(
        key,
        F.size("_t").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("_t", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("_loss").cast("long").alias("loss_chars"),
        F.sha2("_loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
