"""Chat formatting by event-sourced reconstruction (DataFrame functions only).

A conversation is a log of events, ordered by sequence: ``message`` starts a message with a text,
``delta`` appends to one, ``edit`` replaces its text, ``regenerate`` empties it so that what
follows is its new text. ``fold_events`` folds a log into final messages, ``render`` writes
them with a template whose control strings cannot come from texts, and ``parse`` reads them back.

Template: ``<|role|>``, a newline, the text, ``<|end|>``, a newline. Texts and roles are escaped first:
``&``, ``<``, ``[`` and ``|`` (roles only) become ``&amp;``, ``&lt;``, ``&#91;`` and ``&#124;``. So neither this template's
marks nor others (``</s>``, ``[INST]``) occur inside a text, and undoing the replacements with
``&amp;`` last restores it. The loss mask has a run per turn: code points of markup, code points of
escaped text, and whether the loss covers that text (assistant turns).

Cases: a null text is empty, a null role is an empty role; events with the same sequence
keep the order message, edit, regenerate, delta, then text; a conversation's text is one value, as
long as its log; no rows give no rows.
"""
from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import table

OPEN, CLOSE = "<|", "|>\n"
END = "<|end|>\n"


def escape(c: Column) -> Column:
    return F.replace(F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;")), F.lit("["), F.lit("&#91;"))


def unescape(c: Column) -> Column:
    for mark, char in (("&lt;", "<"), ("&#91;", "["), ("&#124;", "|"), ("&amp;", "&")):
        c = F.replace(c, F.lit(mark), F.lit(char))
    return c


def fold_events(events: DataFrame) -> DataFrame:
    """events(conv_id, seq, kind, msg, role, text) -> conv_id, msg, role, text, one row per message.

    A message's text is the last complete state (message or edit text, or nothing after a
    regenerate) followed by the deltas after it, in sequence."""
    rank = F.when(F.col("kind") == "message", 0).when(F.col("kind") == "edit", 1).when(F.col("kind") == "regenerate", 2).otherwise(3)
    e = events.select("conv_id", "seq", "kind", "msg", "role", F.coalesce("text", F.lit("")).alias("text"), rank.alias("_rank"))
    log = Window.partitionBy("conv_id", "msg").orderBy("seq", "_rank", "text")
    state = F.col("kind") != "delta"
    e = e.withColumn("_epoch", F.count(F.when(state, 1)).over(log))
    pieces = (e.groupBy("conv_id", "msg", "_epoch")
              .agg(F.min(F.struct("seq", F.col("role"))).alias("_head"),
                   F.sort_array(F.collect_list(F.struct("seq", "_rank", F.when(F.col("kind") == "regenerate", "").otherwise(F.col("text")).alias("text"))))
                   .alias("_parts")))
    joined = F.array_join(F.transform("_parts", lambda p: p["text"]), "")
    return (pieces.groupBy("conv_id", "msg")
            .agg(F.max_by(joined, "_epoch").alias("text"), F.min_by(F.col("_head.role"), "_epoch").alias("role"))
            .select("conv_id", "msg", "role", "text"))


def render(messages: DataFrame) -> DataFrame:
    """messages(conv_id, msg, role, text) -> conv_id, formatted, loss_mask.

    ``formatted`` is the conversation in order of ``msg``; ``loss_mask`` holds a run
    (markup, length, loss) per turn, in code points, whose sums give positions in ``formatted``."""
    role = F.replace(escape(F.coalesce("role", F.lit(""))), F.lit("|"), F.lit("&#124;"))
    turn = F.struct("msg", F.concat(F.lit(OPEN), role, F.lit(CLOSE)).alias("head"),
                    escape(F.coalesce("text", F.lit(""))).alias("text"),
                    F.coalesce(F.col("role") == "assistant", F.lit(False)).alias("loss"))
    t = messages.groupBy("conv_id").agg(F.sort_array(F.collect_list(turn)).alias("turns"))
    formatted = F.array_join(F.transform("turns", lambda x: F.concat(x["head"], x["text"], F.lit(END))), "")
    mask = F.transform("turns", lambda x: F.struct(
        F.length(x["head"]).alias("markup"), F.length(x["text"]).alias("length"), x["loss"].alias("loss")))
    return t.select("conv_id", formatted.alias("formatted"), mask.alias("loss_mask"))


def parse(formatted: Column) -> Column:
    """The formatted text -> array of (role, text), unescaped."""
    parts = F.split(formatted, r"<\|end\|>\n", -1)
    parts = F.slice(parts, 1, F.size(parts) - 1)

    def turn(x: Column) -> Column:
        head = F.substring_index(x, CLOSE, 1)                # "<|" + role; a role holds no "|"
        return F.struct(unescape(F.substr(head, F.lit(len(OPEN) + 1))).alias("role"),
                        unescape(F.substr(x, F.length(head) + len(CLOSE) + 1)).alias("text"))
    return F.transform(parts, turn)


def as_events(rows: DataFrame) -> DataFrame:
    """conversations(conv_id, turn, role, text) as a log: a message event per row, with the text of
    assistant rows streamed after it as a delta. Rows of one turn go by role, then text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    r = rows.select("conv_id", "role", F.coalesce("text", F.lit("")).alias("text"),
                    F.row_number().over(order).cast("long").alias("msg"))
    streamed = F.coalesce(F.col("role") == "assistant", F.lit(False))
    event = lambda kind, seq, text: F.struct(F.lit(kind).alias("kind"), seq.alias("seq"), text.alias("text"))
    at = F.col("msg") * 2
    return r.select("conv_id", "msg", "role", F.inline(F.filter(F.array(
        event("message", at, F.when(streamed, "").otherwise(F.col("text"))),
        event("delta", at + 1, F.when(streamed, F.col("text")))), lambda e: e["text"].isNotNull())))


def op6_chat(spark: SparkSession, sf_dir: str) -> DataFrame:
    extra = "</s>[INST] ok [/INST]"
    rows = table(spark, sf_dir, "conversations").select("conv_id", "turn", "role", "text")
    fixed = spark.range(2).select(F.lit(-7).cast("long").alias("conv_id"), F.col("id").alias("turn"),
                                  F.when(F.col("id") == 0, "user").otherwise("assistant").alias("role"),
                                  F.lit(extra).alias("text"))
    done = render(fold_events(as_events(rows.unionByName(fixed)))).withColumn("read", parse(F.col("formatted")))
    turns = F.array_join(F.transform("read", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    loss = F.array_join(F.zip_with("read", "loss_mask", lambda x, m: F.when(m["loss"], x["text"]).otherwise("")), "")
    return (done.select("conv_id", F.size("read").cast("long").alias("n_turns"), turns.alias("turns"), loss.alias("loss"),
                        F.length("formatted").cast("long").alias("formatted_chars"))
            .select("conv_id", "n_turns", F.sha2("turns", 256).alias("turns_sha256"),
                    F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
                    "formatted_chars"))


SQL = {"op6_chat": r"""
WITH r AS (SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '</s>[INST] ok [/INST]' UNION ALL SELECT -7, 1, 'assistant', '</s>[INST] ok [/INST]'),
e AS (SELECT *, replace(replace(replace(text, '&', '&amp;'), '<', '&lt;'), '[', '&#91;') AS et,
  replace(replace(replace(replace(role, '&', '&amp;'), '<', '&lt;'), '[', '&#91;'), '|', '&#124;') AS er FROM r)
SELECT conv_id, count(*) AS n_turns,
  sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn, role, text)) AS turns_sha256,
  CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
  sha256(string_agg(CASE WHEN role = 'assistant' THEN text ELSE '' END, '' ORDER BY turn, role, text)) AS loss_sha256,
  CAST(sum(length(er) + length(et) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id"""}
