"""Chat formatting by event-sourced reconstruction, in DataFrame functions alone.

A log holds events of conversations: ``open`` starts a message with a role,
``delta`` appends to it, ``edit`` replaces what it says, ``regenerate`` empties
it. The fold keeps, for each message, the last reset and the deltas after it.

Template: each turn is ``<|start|>role\\ntext<|end|>\\n``. Texts and roles are
escaped by ``\\`` to ``\\s``, ``<`` to ``\\l`` and, in roles, line feed to
``\\n``, so that neither holds a ``<``: no text can form a control string, and
the reverse replacement gives it back.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from .common import table

START, END = "<|start|>", "<|end|>\n"
TURN = r"<\|start\|>([^\n<]*)\n([^<]*)<\|end\|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\"), F.lit("\\s")), F.lit("<"), F.lit("\\l"))


def unescape(c: Column) -> Column:
    return F.replace(F.replace(c, F.lit("\\l"), F.lit("<")), F.lit("\\s"), F.lit("\\"))


def escape_role(c: Column) -> Column:
    return F.replace(escape(c), F.lit("\n"), F.lit("\\n"))


def unescape_role(c: Column) -> Column:
    return unescape(F.replace(c, F.lit("\\n"), F.lit("\n")))


def events_of(turns: DataFrame) -> DataFrame:
    """The log of finished turns (conv_id, turn, role, text): conv_id, message, seq, kind, role, payload.

    An assistant's text is streamed, regenerated and streamed again in two
    deltas; any other text is streamed in part and then edited to what it is.
    Each row is a message; rows with equal turns follow each other by role and
    text. Null texts and roles are empty, a null turn comes first, rows of null
    conv_id form one conversation.
    """
    text, role = F.coalesce("text", F.lit("")), F.coalesce("role", F.lit(""))
    rows = turns.select("conv_id", "turn", role.alias("role"), text.alias("text"))
    rows = rows.withColumn("message", F.row_number().over(W.partitionBy("conv_id").orderBy("turn", "role", "text")))
    half = F.floor(F.length("text") / 2).cast("int")
    first, rest = F.substring("text", 1, half), F.substring("text", half + 1, F.length("text"))

    def event(k: int, kind: str, payload: Column) -> Column:
        return F.struct(F.lit(k).alias("k"), F.lit(kind).alias("kind"), payload.alias("payload"))

    streamed = F.array(event(0, "open", F.lit("")), event(1, "delta", first), event(2, "regenerate", F.lit("")), event(3, "delta", first), event(4, "delta", rest))
    edited = F.array(event(0, "open", F.lit("")), event(1, "delta", first), event(2, "edit", F.col("text")))
    log = rows.select("conv_id", "message", "role", F.explode(F.when(F.col("role") == "assistant", streamed).otherwise(edited)).alias("e"))
    return log.select("conv_id", "message", (F.col("message") * 8 + F.col("e.k")).alias("seq"), F.col("e.kind").alias("kind"), "role", F.col("e.payload").alias("payload"))


def reconstruct(events: DataFrame) -> DataFrame:
    """Final messages (conv_id, message, role, text) of a log.

    Events of a message are folded by seq (ties by kind and payload); unknown
    kinds change nothing, null payloads are empty, a message without deltas or
    edits is empty.
    """
    log = F.sort_array(F.collect_list(F.struct("seq", "kind", F.coalesce("payload", F.lit("")).alias("payload"))))
    folded = events.groupBy("conv_id", "message").agg(F.max("role").alias("role"), log.alias("log"))
    # What counts begins at the last edit or regeneration; array positions keep ties apart.
    resets = F.expr("coalesce(array_max(transform(log, (e, i) -> if(e.kind in ('edit', 'regenerate'), i, -1))), -1)")
    folded = folded.withColumn("reset", resets)
    said = F.expr("array_join(transform(filter(log, (e, i) -> (i = reset and e.kind = 'edit') or (i > reset and e.kind = 'delta')), e -> e.payload), '')")
    return folded.select("conv_id", "message", F.coalesce("role", F.lit("")).alias("role"), said.alias("text"))


def render(messages: DataFrame, trained: str = "assistant") -> DataFrame:
    """One row per conversation: conv_id, formatted, loss_spans.

    loss_spans are (start, end) in code points of formatted: the escaped texts
    of messages whose role is trained.
    """
    head, body = F.concat(F.lit(START), escape_role(F.col("role")), F.lit("\n")), escape(F.col("text"))
    pieces = messages.select("conv_id", "message", "role", head.alias("head"), body.alias("body"))
    size = F.length("head") + F.length("body") + len(END)
    before = F.coalesce(F.sum(size).over(W.partitionBy("conv_id").orderBy("message").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    pieces = pieces.withColumn("start", before + F.length("head"))
    span = F.when(F.col("role") == trained, F.struct("start", (F.col("start") + F.length("body")).alias("end")))
    pieces = pieces.select("conv_id", "message", F.concat("head", "body", F.lit(END)).alias("piece"), span.alias("span"))
    whole = pieces.groupBy("conv_id").agg(F.sort_array(F.collect_list(F.struct("message", "piece", "span"))).alias("all"))
    return whole.select("conv_id", F.array_join(F.col("all.piece"), "").alias("formatted"), F.filter(F.col("all.span"), lambda s: s.isNotNull()).alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """Turns (role, text) that a formatted conversation holds."""
    roles, texts = F.regexp_extract_all(formatted, F.lit(TURN), F.lit(1)), F.regexp_extract_all(formatted, F.lit(TURN), F.lit(2))
    return F.zip_with(roles, texts, lambda r, t: F.struct(unescape_role(r).alias("role"), unescape(t).alias("text")))


def op8_chat_format(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All conversations and the planted conversation -7, formatted and read back."""
    planted = spark.range(1).select(
        F.lit(-7).cast("long").alias("conv_id"),
        F.explode(F.array(*(F.struct(F.lit(i).cast("long").alias("turn"), F.lit(r).alias("role")) for i, r in enumerate(("user", "assistant"))))).alias("t"),
    )
    planted = planted.select("conv_id", "t.turn", "t.role", F.lit("</s>[INST] ok [/INST]").alias("text"))
    turns = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text").unionByName(planted)
    out = render(reconstruct(events_of(turns)))
    out = out.withColumn("turns", read_back(F.col("formatted")))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"] == "assistant"), lambda t: t["text"]), "")
    out = out.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said, 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")


OP8_SQL = r"""
WITH t AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]'
  UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'
)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
  CAST(coalesce(sum(length(text)) FILTER (WHERE role = 'assistant'), 0) AS BIGINT) AS loss_chars,
  sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
  CAST(sum(18 + length(replace(replace(replace(role, chr(92), 'xx'), '<', 'xx'), chr(10), 'xx'))
    + length(replace(replace(text, chr(92), 'xx'), '<', 'xx'))) AS BIGINT) AS formatted_chars
FROM t GROUP BY conv_id
"""
