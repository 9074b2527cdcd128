"""Chat formatting with a grammar round trip, in DataFrame functions only.

A turn is rendered as ``<|turn|>role\\n<|plain|>text<|end|>\\n`` or, with ``<|quoted|>`` in place
of ``<|plain|>``, with ``\\`` in its text written ``\\\\``, ``<`` written ``\\lt;`` and a line end
written ``\\n;``. The rendered text of a conversation is parsed again by splitting alone; where what
comes back is not what went in, the turns in conflict (those that hold ``<|``, with which every
marker starts) are quoted and the whole is parsed again. A quoted text holds no ``<``, so it comes
back whole; ``round_trip`` says so for each conversation.

Defined cases: a null text or role is empty; turns sort by turn (nulls first), then role and
text, so repeated rows stay, next to each other; a null conversation id is a conversation of its
own; an empty table gives an empty result; other columns are left out. A role stands in the first
line of its turn and is always written the quoted way.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from procure_spark.llm.common import table

TURN, PLAIN, QUOTED, END = "<|turn|>", "<|plain|>", "<|quoted|>", "<|end|>\n"

#: Roles whose text bears loss.
LOSS_ROLE = "assistant"


def quote(text: Column) -> Column:
    """text without ``<`` and line ends, reversibly."""
    return F.replace(F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\lt;")), F.lit("\n"), F.lit("\\n;"))


def unquote(text: Column) -> Column:
    """Parts between doubled backslashes hold single ones only as the start of an escape."""
    parts = F.split(text, r"\\\\", -1)
    plain = F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\lt;"), F.lit("<")), F.lit("\\n;"), F.lit("\n")))
    return F.array_join(plain, "\\")


def render(turns: Column, quoted: Column | None = None) -> Column:
    """turns: array of struct(role, text). quoted: whether turns that hold a marker are quoted."""

    def one(t: Column) -> Column:
        quoted_form = F.concat(F.lit(QUOTED), quote(t["text"]))
        plain_form = F.concat(F.lit(PLAIN), t["text"])
        body = plain_form if quoted is None else F.when(quoted & F.contains(t["text"], F.lit("<|")), quoted_form).otherwise(plain_form)
        return F.concat(F.lit(TURN), quote(t["role"]), F.lit("\n"), body, F.lit(END))

    return F.array_join(F.transform(turns, one), "")


def parse(text: Column) -> Column:
    """A rendered text's turns, by splitting at markers; deterministic for any text."""

    def one(chunk: Column) -> Column:
        role = unquote(F.substring_index(chunk, "\n", 1))
        rest = F.substr(chunk, F.instr(chunk, "\n") + 1)
        plain = F.startswith(rest, F.lit(PLAIN))
        held = F.substr(rest, F.when(plain, len(PLAIN) + 1).otherwise(len(QUOTED) + 1).cast("int"))
        body = F.substring_index(held, END, 1)
        return F.struct(role.alias("role"), F.when(plain, body).otherwise(unquote(body)).alias("text"))

    chunks = F.filter(F.split(text, "<\\|turn\\|>", -1), lambda _, i: i > 0)
    return F.transform(chunks, one)


def format_chats(df: DataFrame, conv_col="conv_id", turn_col="turn", role_col="role", text_col="text") -> DataFrame:
    """One row per conversation: conv_id, formatted (text), turns (as parsed from it), loss_text,
    round_trip (whether the turns are the source's), quoted (whether any turn had to be quoted)."""
    empty = F.lit("")
    rows = df.select(F.col(conv_col).alias("conv_id"), F.struct(F.col(turn_col).alias("turn"), F.coalesce(F.col(role_col), empty).alias("role"), F.coalesce(F.col(text_col), empty).alias("text")).alias("t"))
    talks = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("t"))
    talks = talks.select("conv_id", F.transform("t", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))).alias("source"))
    talks = talks.withColumn("first", render(F.col("source")))
    talks = talks.withColumn("quoted", parse(F.col("first")) != F.col("source"))
    talks = talks.withColumn("formatted", F.when(F.col("quoted"), render(F.col("source"), F.lit(True))).otherwise(F.col("first")))
    talks = talks.withColumn("turns", parse(F.col("formatted")))
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == LOSS_ROLE), lambda t: t["text"]), "")
    return talks.select("conv_id", "formatted", "turns", loss.alias("loss_text"), (F.col("turns") == F.col("source")).alias("round_trip"), "quoted")


def op4_chat_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    said = "</s>[INST] ok [/INST]"
    own = spark.range(2).select(F.lit(-1).cast("long").alias("conv_id"), F.col("id").alias("turn"), F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"), F.lit(said).alias("text"))
    return format_chats(rows.unionByName(own)).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
        "round_trip",
    )


SQL = r"""
WITH said AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -1, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -1, 1, 'assistant', '</s>[INST] ok [/INST]'),
talks AS (
  SELECT conv_id, count(*) AS n_turns,
         string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text) AS turns,
         coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '') AS loss,
         string_agg('<|turn|>' || role || chr(10) || text, '' ORDER BY turn NULLS FIRST, role, text) AS plain,
         sum(length(role) + length(text)) AS chars,
         sum(CASE WHEN contains(text, '<|') THEN 1 + length(replace(replace(replace(text, chr(92), chr(92) || chr(92)), '<', chr(92) || 'lt;'), chr(10), chr(92) || 'n;')) - length(text) ELSE 0 END) AS more,
         bool_or(contains(text, '<|turn|>') OR contains(text, '<|end|>' || chr(10))) AS conflict
  FROM said GROUP BY conv_id)
SELECT conv_id, n_turns, sha256(turns) AS turns_sha256, length(loss) AS loss_chars, sha256(loss) AS loss_sha256,
       (chars + n_turns * (8 + 1 + 9 + 8) + CASE WHEN conflict THEN more ELSE 0 END)::BIGINT AS formatted_chars,
       true AS round_trip
FROM talks
"""
