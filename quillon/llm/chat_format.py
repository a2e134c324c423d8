"""Chat formatting with DataFrame functions only.

Sources lay conversations out in different ways.  The nested field paths of a row, sorted and
hashed, are its schema fingerprint; the fingerprint selects a declarative mapping, a list of
field paths and roles, that turns the row into canonical turns (an array of role and text).
A typed table has one fingerprint, taken from its schema; JSON rows have one each.  A row with
fields of several layouts has a fingerprint of none: it goes by the first mapping, in the order of
MAPPINGS, all of whose paths it has.

The template puts `<s>[INST]role[/INST]text</s>` for each turn.  In roles and texts `&`, `<`
and `[` are escaped, so no control string can occur inside them and escaping is undone
exactly.  The loss mask lists the code point ranges of assistant texts in the output.

Defined cases: null roles and texts are empty strings; turns of one number go by role, then
text; a conversation of no turns gives an empty string; repeated rows are repeated turns;
columns that the chosen mapping doesn't name are ignored, also those that another one names; a table
with the paths of no mapping raises, a JSON row with them has null turns; rows without a conv_id are
one conversation, null; texts of any length are kept whole; an empty table gives no rows.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

BOS, EOS, OPEN, CLOSE = "<s>", "</s>", "[INST]", "[/INST]"
ESCAPES = (("&", "&amp;"), ("<", "&lt;"), ("[", "&lsqb;"))
TURNS = "array<struct<role:string,text:string>>"


@dataclass(frozen=True)
class Mapping:
    """How one layout becomes turns: a list field with its role and text fields, fixed roles for single fields, or one row a turn."""

    name: str
    paths: tuple[str, ...]
    list_field: str = ""
    role: str = ""
    text: str = ""
    fields: tuple[tuple[str, tuple[str, ...]], ...] = ()
    key: str = ""
    order: str = ""


MAPPINGS = (
    Mapping("rows", ("conv_id", "role", "text", "turn"), role="role", text="text", key="conv_id", order="turn"),
    Mapping("messages", ("messages", "messages.content", "messages.role"), "messages", "role", "content"),
    Mapping("from_value", ("conversations", "conversations.from", "conversations.value"), "conversations", "from", "value"),
    Mapping("instruction", ("input", "instruction", "output"), fields=(("user", ("instruction", "input")), ("assistant", ("output",)))),
    Mapping("instruction_only", ("instruction", "output"), fields=(("user", ("instruction",)), ("assistant", ("output",)))),
    Mapping("prompt_completion", ("completion", "prompt"), fields=(("user", ("prompt",)), ("assistant", ("completion",)))),
    Mapping("prompt_response", ("prompt", "response"), fields=(("user", ("prompt",)), ("assistant", ("response",)))),
    Mapping("question_answer", ("answer", "question"), fields=(("user", ("question",)), ("assistant", ("answer",)))),
)
KNOWN = {p for m in MAPPINGS for p in m.paths}
#: Roles that sources name otherwise.
ROLES = {"human": "user", "gpt": "assistant", "bot": "assistant", "model": "assistant"}


def fingerprint(paths: set[str] | tuple[str, ...]) -> str:
    return hashlib.sha256("\n".join(sorted(set(paths) & KNOWN)).encode()).hexdigest()


BY_PRINT = {fingerprint(m.paths): m for m in MAPPINGS}


def field_paths(kind: T.DataType, at: str = "") -> set[str]:
    """Dotted paths of all fields; list items have the path of their list."""
    if isinstance(kind, T.ArrayType):
        return field_paths(kind.elementType, at)
    if not isinstance(kind, T.StructType):
        return set()
    out: set[str] = set()
    for f in kind.fields:
        p = f"{at}.{f.name}" if at else f.name
        out |= {p} | field_paths(f.dataType, p)
    return out


def _text(c: Column) -> Column:
    return F.coalesce(c.cast("string"), F.lit(""))


def _role(c: Column) -> Column:
    out = _text(c)
    for a, b in ROLES.items():
        out = F.when(out == a, b).otherwise(out)
    return out


def _turn(role: Column, text: Column) -> Column:
    return F.struct(_role(role).alias("role"), _text(text).alias("text"))


def _single(m: Mapping, get) -> Column:
    """Turns of fixed roles; parts that are null or empty are left out of a turn."""
    return F.array(*[_turn(F.lit(r), F.concat_ws("\n\n", *[F.nullif(get(p), F.lit("")) for p in parts])) for r, parts in m.fields])


def _listed(items: Column, m: Mapping) -> Column:
    return F.transform(items, lambda x: _turn(x[m.role], x[m.text]))


def _prefixed(keys: Column, at: str) -> Column:
    return F.transform(keys, lambda k: F.concat(F.lit(at + "."), k))


def canonical(df: DataFrame) -> DataFrame:
    """A table of any known layout as (conv_id, turns); tables without a conv_id get one from their row's content."""
    paths = field_paths(df.schema)
    m = BY_PRINT.get(fingerprint(paths)) or next((m for m in MAPPINGS if paths >= set(m.paths)), None)
    if m is None:
        raise ValueError(f"no mapping has the fields {sorted(field_paths(df.schema))}")
    if m.key:
        rows = df.groupBy(F.col(m.key).alias("conv_id")).agg(F.array_sort(F.collect_list(F.struct(F.col(m.order).alias("at"), _role(F.col(m.role)).alias("role"), _text(F.col(m.text)).alias("text")))).alias("rows"))
        return rows.select("conv_id", F.transform("rows", lambda x: F.struct(x["role"].alias("role"), x["text"].alias("text"))).alias("turns"))
    turns = _listed(F.col(m.list_field), m) if m.list_field else _single(m, F.col)
    key = F.col("conv_id") if "conv_id" in df.columns else F.xxhash64(F.to_json(F.struct(*df.columns)))
    return df.select(key.alias("conv_id"), F.coalesce(turns, F.array().cast(TURNS)).alias("turns"))


def canonical_json(df: DataFrame, column: str) -> DataFrame:
    """Rows of JSON objects of mixed layouts with their `fingerprint` and `turns`."""
    raw = F.col(column)
    top = F.coalesce(F.json_object_keys(raw), F.array().cast("array<string>"))
    lists = sorted({m.list_field for m in MAPPINGS if m.list_field})
    below = [_prefixed(F.coalesce(F.json_object_keys(F.get_json_object(raw, f"$.{x}[0]")), F.array().cast("array<string>")), x) for x in lists]
    known = F.array(*map(F.lit, sorted(KNOWN)))
    paths = F.array_sort(F.array_intersect(F.array_distinct(F.concat(top, *below)), known))
    out: Column = F.lit(None).cast(TURNS)
    print_ = F.sha2(F.array_join(paths, "\n"), 256)
    made: list[tuple[Mapping, Column]] = []
    for m in MAPPINGS:
        if m.key:
            continue
        if m.list_field:
            items = F.from_json(F.get_json_object(raw, f"$.{m.list_field}"), f"array<struct<`{m.role}`:string,`{m.text}`:string>>")
            turns = _listed(items, m)
        else:
            turns = _single(m, lambda p: F.get_json_object(raw, f"$.{p}"))
        made.append((m, turns))
    for m, turns in reversed(made):  # what is asked last decides first
        out = F.when(F.size(F.array_except(F.array(*map(F.lit, m.paths)), paths)) == 0, turns).otherwise(out)
    for m, turns in made:
        out = F.when(print_ == fingerprint(m.paths), turns).otherwise(out)
    return df.withColumns({"fingerprint": print_, "turns": out})


def escape(c: Column) -> Column:
    for a, b in ESCAPES:
        c = F.replace(c, F.lit(a), F.lit(b))
    return c


def unescape(c: Column) -> Column:
    for a, b in reversed(ESCAPES):
        c = F.replace(c, F.lit(b), F.lit(a))
    return c


def render(rows: DataFrame) -> DataFrame:
    """Adds `formatted` and `loss`, the (start, end) ranges of assistant texts."""
    shown = F.transform("turns", lambda x: F.struct((x["role"] == "assistant").alias("learn"), F.concat(F.lit(BOS + OPEN), escape(x["role"]), F.lit(CLOSE)).alias("head"), escape(x["text"]).alias("text")))
    none = F.expr("CAST(array() AS ARRAY<STRUCT<start: INT, end: INT>>)")

    def step(acc: Column, x: Column) -> Column:
        start = acc["at"] + F.length(x["head"])
        end = start + F.length(x["text"])
        return F.struct((end + len(EOS)).alias("at"), F.when(x["learn"], F.concat(acc["mask"], F.array(F.struct(start.alias("start"), end.alias("end"))))).otherwise(acc["mask"]).alias("mask"))

    rows = rows.withColumn("_shown", shown)
    formatted = F.array_join(F.transform("_shown", lambda x: F.concat(x["head"], x["text"], F.lit(EOS))), "")
    loss = F.aggregate("_shown", F.struct(F.lit(0).alias("at"), none.alias("mask")), step, lambda acc: acc["mask"])
    return rows.withColumns({"formatted": formatted, "loss": loss}).drop("_shown")


def read_back(formatted: Column) -> Column:
    """Turns of a formatted string."""
    each = F.filter(F.split(formatted, EOS), lambda x: F.startswith(x, F.lit(BOS + OPEN)))
    body = F.transform(each, lambda x: F.substring(x, F.lit(len(BOS + OPEN) + 1), F.length(x)))
    return F.transform(body, lambda x: F.struct(unescape(F.substring_index(x, CLOSE, 1)).alias("role"), unescape(F.substring(x, F.instr(x, CLOSE) + len(CLOSE), F.length(x))).alias("text")))


def learned(formatted: Column, loss: Column) -> Column:
    """All text under the loss mask, unescaped."""
    return F.array_join(F.transform(loss, lambda x: unescape(F.substring(formatted, x["start"] + 1, x["end"] - x["start"]))), "")


PROBE = "</s>[INST] ok [/INST]"


def query(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = spark.read.parquet(f"{sf_dir}/conversations.parquet").select("conv_id", "turn", "role", "text")
    probe = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(PROBE).alias("text"))
    shown = render(canonical(rows.unionAll(probe))).select("conv_id", "formatted", "loss", read_back(F.col("formatted")).alias("back"), learned(F.col("formatted"), F.col("loss")).alias("learn"))
    said = F.array_join(F.transform("back", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return shown.select("conv_id", F.size("back").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), F.length("learn").cast("long").alias("loss_chars"), F.sha2("learn", 256).alias("loss_sha256"), F.length("formatted").cast("long").alias("formatted_chars"))


_ESCAPED = "replace(replace(replace({0}, '&', '&amp;'), '<', '&lt;'), '[', '&lsqb;')"
SQL = f"""
WITH r AS (
  SELECT conv_id, turn, CASE coalesce(role, '') WHEN 'human' THEN 'user' WHEN 'gpt' THEN 'assistant' WHEN 'bot' THEN 'assistant' WHEN 'model' THEN 'assistant' ELSE coalesce(role, '') END AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '{PROBE}' UNION ALL SELECT -1, 1, 'assistant', '{PROBE}'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(coalesce(sum(CASE WHEN role = 'assistant' THEN length(text) END), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(CASE WHEN role = 'assistant' THEN text END, '' ORDER BY turn, role, text), '')) AS loss_sha256,
  CAST(sum(length({_ESCAPED.format('role')}) + length({_ESCAPED.format('text')}) + {len(BOS + OPEN + CLOSE + EOS)}) AS BIGINT) AS formatted_chars
FROM r GROUP BY conv_id
"""
