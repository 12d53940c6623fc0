"""Chat formatting by event-sourced reconstruction, with built-in expressions only.

A log has one row per event of a conversation: ``message`` opens a message, ``delta`` adds a
streamed piece to it, ``edit`` replaces its text, ``regenerate`` restarts its text and discards
every message opened after it and before the regeneration. The fold keeps, for every message, what came
at or after its last restart; one exchange on the conversation serves all windows and groupings.

Edge cases: a null text or role counts as empty; equal rows are separate events; events of one
sequence number are taken in the order message, edit, regenerate, delta, then by text; a message with
deltas only starts with the first of them; an empty log gives no rows; other columns are ignored.
A null conversation id is a conversation of its own. A conversation becomes one string, so one
conversation has to fit in a row (2 GB); that bound is the contract's, not the plan's.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

TURN_START, TURN_END = "<|im_start|>", "<|im_end|>"
RANK = {"message": 0, "edit": 1, "regenerate": 2, "delta": 3}


def escape(text: Column) -> Column:
    """``<|`` never survives: a backslash goes in after ``<``; runs of backslashes grow by one, so it can be undone."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", r"<$1|")


def escape_role(role: Column) -> Column:
    """Roles stand on a line of their own, so line ends in them are written as %0A."""
    return escape(F.replace(F.replace(role, F.lit("%"), F.lit("%25")), F.lit("\n"), F.lit("%0A")))


def unescape_role(role: Column) -> Column:
    return F.replace(F.replace(unescape(role), F.lit("%0A"), F.lit("\n")), F.lit("%25"), F.lit("%"))


def events_from_turns(turns: DataFrame) -> DataFrame:
    """Rows of (conv_id, turn, role, text) as a log with one ``message`` event each."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    return turns.select(
        "conv_id", F.row_number().over(order).cast("long").alias("seq"), F.lit("message").alias("kind"), F.row_number().over(order).cast("long").alias("message_id"), "role", "text"
    )


def fold_events(events: DataFrame) -> DataFrame:
    """(conv_id, seq, kind, message_id, role, text) to (conv_id, position, message_id, role, text)."""
    rank = F.coalesce(*[F.when(F.col("kind") == k, F.lit(v)) for k, v in RANK.items()], F.lit(9))
    message = Window.partitionBy("conv_id", "message_id")
    restart = F.max(F.when(F.col("kind") != "delta", F.struct("seq", rank.alias("rank"), "text"))).over(message)
    log = events.select("conv_id", "seq", "kind", "message_id", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    live = log.withColumns({"_rank": rank, "_restart": restart, "_opened": F.min("seq").over(message), "_regenerated": F.max(F.when(F.col("kind") == "regenerate", F.col("seq"))).over(message)})
    own = F.struct("seq", F.col("_rank").alias("rank"), "text")
    messages = live.groupBy("conv_id", "message_id").agg(
        F.min("_opened").alias("opened"),
        F.max("_regenerated").alias("regenerated"),
        F.min(F.when(F.col("kind") == "message", F.struct("seq", "role"))).alias("_by"),
        F.min(F.struct("seq", "role")).alias("_first"),
        F.sort_array(F.collect_list(F.when(F.col("_restart").isNull() | (own >= F.col("_restart")), own))).alias("_pieces"),
    )
    before = Window.partitionBy("conv_id").orderBy("opened", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    kept = messages.withColumn("_cut", F.max("regenerated").over(before)).where(F.col("_cut").isNull() | (F.col("_cut") < F.col("opened")))
    return kept.select(
        "conv_id",
        F.row_number().over(Window.partitionBy("conv_id").orderBy("opened", "message_id")).alias("position"),
        "message_id",
        F.coalesce("_by.role", "_first.role").alias("role"),
        F.array_join(F.transform("_pieces", lambda p: p.text), "").alias("text"),
    )


def render(messages: DataFrame, learn_from: str = "assistant") -> DataFrame:
    """(conv_id, formatted, loss_spans): the template marks every turn; a span is (start, length) in code points."""
    role, body = escape_role(F.col("role")), escape(F.col("text"))
    head = F.concat(F.lit(TURN_START), role, F.lit("\n"))
    parts = messages.select("conv_id", "position", "role", head.alias("_head"), body.alias("_body"))
    parts = parts.withColumn("_turn", F.concat("_head", "_body", F.lit(TURN_END + "\n")))
    so_far = Window.partitionBy("conv_id").orderBy("position").rowsBetween(Window.unboundedPreceding, 0)
    ends = F.sum(F.length("_turn")).over(so_far)
    parts = parts.withColumn("_start", ends - F.length("_turn") + F.length("_head"))
    span = F.when(F.col("role") == learn_from, F.struct(F.col("_start").cast("long").alias("start"), F.length("_body").cast("long").alias("length")))
    return parts.groupBy("conv_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("position", "_turn"))), lambda t: t["_turn"]), "").alias("formatted"),
        F.array_sort(F.collect_list(span)).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """Parse the output again: (conv_id, turns, loss_text, formatted_chars); turns are (role, text) in order."""
    pieces = F.split("formatted", r"<\|im_end\|>\n")
    body = F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), lambda p: F.substring(p, F.lit(len(TURN_START) + 1), F.length(p)))
    cut = lambda p: F.instr(p, "\n")
    turns = F.transform(
        body,
        lambda p: F.struct(unescape_role(F.substring_index(p, "\n", 1)).alias("role"), unescape(F.substring(p, cut(p) + 1, F.length(p))).alias("text")),
    )
    learnt = F.array_join(F.transform("loss_spans", lambda s: unescape(F.substring(F.col("formatted"), (s.start + 1).cast("int"), s.length.cast("int")))), "")
    return rendered.select("conv_id", turns.alias("turns"), learnt.alias("loss_text"), F.length("formatted").cast("long").alias("formatted_chars"))


def digests(parsed: DataFrame) -> DataFrame:
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), "")
    return parsed.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(whole, 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"),
        F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars",
    )


def format_conversations(turns: DataFrame) -> DataFrame:
    return render(fold_events(events_from_turns(turns)))
