"""Chat formatting by relational operations only.

The rows of a conversation are collected as structs and sorted by turn;
adjacent turns of one role are merged into one message, a slice of the sorted
array aggregated into one text; messages are concatenated with their control
strings.  Control strings inside a
text are escaped with a backslash, so formatting is reversible: :func:`parse`
gives back every turn and every text that a loss is taken on.

A message is ``[INST]role[:]text[+]text[/INST]``, and for the assistant
``<s>role[:]text[+]text</s>``; ``[+]`` stands between merged turns.

Defined results: null text and null role are empty; turns are in order of
(turn, role, text), null turns first; repeated rows are turns of their own;
an empty table gives no conversation; a null ``conv_id`` is one conversation;
extra columns are ignored.  One row out holds one conversation, so its rows
have to meet in one task; nothing else does.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from skyquilt.session import table

OPEN, CLOSE, ROLE, JOIN, SAY, END = "[INST]", "[/INST]", "[:]", "[+]", "<s>", "</s>"
_CONTROL = r"([\[<])((?:/?INST|:|\+)\]|/?s>)"


def escape(text: Column) -> Column:
    """Double every backslash, then break every control string with one."""
    return F.regexp_replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), _CONTROL, r"$1\\$2")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chats(turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", speaker: str = "assistant") -> DataFrame:
    """One row per conversation: ``formatted`` and ``loss_spans``, the places of the speaker's
    texts in it (code points, end exclusive)."""
    one = F.struct(F.col(turn).alias("turn"), F.coalesce(role, F.lit("")).alias("role"), F.coalesce(text, F.lit("")).alias("text"))
    rows = turns.groupBy(F.col(conv).alias("conv_id")).agg(F.array_sort(F.collect_list(one)).alias("turns"))
    role_at = lambda i: F.get(F.col("turns"), i)["role"]
    # a message begins where the role changes; its turns are a slice of the conversation, so merging is linear
    first = F.filter(F.sequence(F.lit(0), F.size("turns") - 1), lambda i: (i == 0) | (role_at(i) != role_at(i - 1)))
    rows = rows.withColumn("first", first)

    def message(i: Column, k: Column) -> Column:
        end = F.coalesce(F.get("first", k + 1), F.size("turns"))
        spoken = role_at(i) == F.lit(speaker)
        return F.struct(
            F.concat(F.when(spoken, F.lit(SAY)).otherwise(F.lit(OPEN)), escape(role_at(i)), F.lit(ROLE)).alias("head"),
            F.transform(F.slice("turns", i + 1, end - i), lambda x: escape(x["text"])).alias("bodies"),
            F.when(spoken, F.lit(END)).otherwise(F.lit(CLOSE)).alias("tail"),
            spoken.alias("loss"),
        )

    rows = rows.select("conv_id", F.transform("first", message).alias("messages"))

    def piece(m: Column, body: Column, j: Column) -> Column:
        """What stands before a turn's text, its length, all its characters in the output, and whether the loss is taken on it."""
        lead = F.when(j == 0, F.length(m["head"])).otherwise(F.lit(len(JOIN)))
        last = F.when(j == F.size(m["bodies"]) - 1, F.length(m["tail"])).otherwise(F.lit(0))
        return F.struct(lead.alias("lead"), F.length(body).alias("size"), (lead + F.length(body) + last).cast("long").alias("all"), m["loss"].alias("loss"))

    pieces = F.flatten(F.transform("messages", lambda m: F.transform(m["bodies"], lambda body, j: piece(m, body, j))))
    text = F.array_join(F.transform("messages", lambda m: F.concat(m["head"], F.array_join(m["bodies"], JOIN), m["tail"])), "")
    rows = rows.select("conv_id", text.alias("formatted"), pieces.alias("pieces"))
    rows = rows.withColumn("begin", running(F.transform("pieces", lambda p: p["all"])))

    def span(p: Column, k: Column) -> Column:
        begin = (F.get(F.col("begin"), k) + p["lead"]).cast("int")
        return F.when(p["loss"], F.struct(begin.alias("start"), (begin + p["size"]).alias("end")))

    return rows.select("conv_id", "formatted", F.filter(F.transform("pieces", span), lambda s: s.isNotNull()).alias("loss_spans"))


def running(sizes: Column, block: int = 256) -> Column:
    """The sum of the elements before each one of a long array: blocks of a fixed size are summed
    apart, so that no array is copied once for each of its elements."""
    add = lambda acc, v: F.concat(acc, F.array(F.element_at(acc, -1) + v))
    none = F.array(F.lit(0).cast("long"))
    blocks = F.transform(F.sequence(F.lit(0), F.floor((F.size(sizes) - 1) / block).cast("int")), lambda b: F.slice(sizes, b * block + 1, block))
    inside = F.transform(blocks, lambda x: F.aggregate(x, none, add))
    offsets = F.aggregate(inside, none, lambda acc, x: add(acc, F.element_at(x, -1)))
    return F.flatten(F.transform(inside, lambda x, i: F.transform(F.slice(x, 1, F.size(x) - 1), lambda v: v + F.get(offsets, i))))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation: array of (role, text)."""
    messages = F.regexp_extract_all(formatted, F.lit(r"(?s)(?:\[INST\]|<s>)(.*?)(?:\[/INST\]|</s>)"), F.lit(1))

    def turns(message: Column) -> Column:
        role = unescape(F.substring_index(message, ROLE, 1))
        body = F.substring(message, F.locate(ROLE, message) + F.lit(len(ROLE)), F.length(message))
        return F.transform(F.split(body, r"\[\+\]", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text")))

    return F.flatten(F.transform(messages, turns))


def op8_chat_formatting(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    probe = "</s>[INST] ok [/INST]"
    kind = {f.name: f.dataType for f in rows.schema.fields}
    extra = spark.range(2).select(F.lit(-1).cast(kind["conv_id"]).alias("conv_id"), F.col("id").cast(kind["turn"]).alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(probe).alias("text"))
    out = format_chats(rows.unionByName(extra))
    loss = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), s["start"] + 1, s["end"] - s["start"]))), "")
    back = out.select("conv_id", parse(F.col("formatted")).alias("turns"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    digest = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(digest, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        "formatted_chars",
    )


#: The digests straight from the rows; only the length needs the template.
ORACLE = r"""WITH rows AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
t AS (
  SELECT *, regexp_replace(replace(text, '\', '\\'), '([\[<])((?:/?INST|:|\+)\]|/?s>)', '\1\\\2', 'g') AS body,
         regexp_replace(replace(role, '\', '\\'), '([\[<])((?:/?INST|:|\+)\]|/?s>)', '\1\\\2', 'g') AS who,
         coalesce(lag(role) OVER o = role, false) AS joined
  FROM rows WINDOW o AS (PARTITION BY conv_id ORDER BY turn NULLS FIRST, role, text))
SELECT conv_id, count(*)::bigint AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       coalesce(sum(length(text)) FILTER (role = 'assistant'), 0)::bigint AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (role = 'assistant'), '')) AS loss_sha256,
       sum(length(body) + CASE WHEN joined THEN 3 WHEN role = 'assistant' THEN 10 + length(who) ELSE 16 + length(who) END)::bigint AS formatted_chars
FROM t GROUP BY conv_id"""
