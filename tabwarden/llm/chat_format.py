"""Chat formatting from event logs.

A log holds events of conversations: ``message`` opens a turn with a text, ``delta`` appends
to the turn, ``edit`` replaces its text, ``regenerate`` empties it so that the deltas after it
build it anew. Events are partitioned by conversation, sorted by turn and sequence, and folded
into the final messages; these are rendered with a template whose control strings are escaped
inside texts so that the output can be read back exactly.

Only Column expressions; one shuffle, by conversation. A conversation's rendered text is one
cell of the result, so its events meet in one row as well.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from tabwarden.llm.common import only

TURN_START, TURN_END = "### ", "</turn>\n"
#: In texts: the escape character first, then what it stands for.
_ESCAPES = (("\\", "\\0"), ("</turn>", "\\1"), ("###", "\\2"))
#: In role names the separator as well.
_ROLE_ESCAPES = (*_ESCAPES, (": ", "\\3"))
#: Events that start a turn's text anew.
_RESETS = ("message", "edit", "regenerate")


def _escape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, escaped in pairs:
        text = F.replace(text, F.lit(plain), F.lit(escaped))
    return text


def _unescape(text: Column, pairs=_ESCAPES) -> Column:
    for plain, escaped in reversed(pairs):
        text = F.replace(text, F.lit(escaped), F.lit(plain))
    return text


def message_events(conversations: DataFrame) -> DataFrame:
    """A finished table of messages as a log: each row is the one event of its message."""
    return only(conversations, "conv_id", "turn", "role", "text").select(
        "conv_id", F.col("turn").alias("seq"), "turn", F.lit("message").alias("kind"), "role", "text"
    )


def fold_events(events: DataFrame) -> DataFrame:
    """``conv_id, messages``: the final messages (role, text) of each conversation, in order.

    Events are sorted by turn, sequence, kind, role and text, so ties have one order and
    repeated rows stay. A ``message`` always opens a new message, so does a turn's first event of
    any kind. Null roles and texts are empty; a null ``conv_id`` is a conversation of its own;
    null turns come first. No event, no conversation.
    """
    log = (
        only(events, "conv_id", "seq", "turn", "kind", "role", "text")
        .groupBy("conv_id")
        .agg(
            F.sort_array(
                F.collect_list(
                    F.struct(
                        "turn",
                        "seq",
                        # within one sequence number: message, regenerate, edit, delta
                        F.array_position(F.array(*map(F.lit, ("message", "regenerate", "edit", "delta"))), F.col("kind")).alias("rank"),
                        F.coalesce("role", F.lit("")).alias("role"),
                        F.when(F.col("kind") == "regenerate", "").otherwise(F.coalesce("text", F.lit(""))).alias("text"),
                        F.col("kind").isin(*_RESETS).alias("resets"),
                    )
                )
            ).alias("log")
        )
    )
    log_, starts = F.col("log"), F.col("starts")
    opened = log.select(
        "conv_id",
        "log",
        F.filter(
            F.sequence(F.lit(0), F.size("log") - 1),
            lambda i: (F.get(log_, i)["rank"] == 1)
            | (i == 0)
            | ~F.get(log_, i)["turn"].eqNullSafe(F.get(log_, i - 1)["turn"]),
        ).alias("starts"),
    )

    def message(start: Column, index: Column) -> Column:
        end = F.coalesce(F.get(starts, index + 1), F.size(log_))
        own = F.slice(log_, start + 1, end - start)
        last_reset = F.array_max(F.transform(own, lambda e, k: F.when(e["resets"], k).otherwise(F.lit(0))))
        return F.struct(
            F.get(log_, start)["role"].alias("role"),
            F.array_join(
                F.transform(F.slice(own, last_reset + 1, F.size(own)), lambda e: e["text"]), ""
            ).alias("text"),
        )

    return opened.select("conv_id", F.transform(starts, message).alias("messages"))


def render(folded: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """``conv_id, formatted, loss_spans``: the rendered text and the spans (start, end in code
    points, end exclusive) of the escaped texts of the role that is trained on."""
    pieces = folded.select(
        "conv_id",
        F.transform(
            "messages",
            lambda m: F.struct(
                F.concat(F.lit(TURN_START), _escape(m["role"], _ROLE_ESCAPES), F.lit(": ")).alias("head"),
                _escape(m["text"]).alias("body"),
                (m["role"] == loss_role).alias("loss"),
            ),
        ).alias("pieces"),
    )
    lengths = F.transform(
        "pieces",
        lambda p: F.struct(
            F.char_length(p["head"]).alias("head"), F.char_length(p["body"]).alias("body"), p["loss"].alias("loss")
        ),
    )
    offset = F.struct(F.lit(0).alias("at"), F.array().cast("array<struct<start:int,end:int>>").alias("spans"))

    def advance(acc: Column, n: Column) -> Column:
        start = acc["at"] + n["head"]
        end = start + n["body"]
        return F.struct(
            (end + len(TURN_END)).alias("at"),
            F.when(
                n["loss"], F.concat(acc["spans"], F.array(F.struct(start.alias("start"), end.alias("end"))))
            ).otherwise(acc["spans"]).alias("spans"),
        )

    return pieces.select(
        "conv_id",
        F.array_join(F.transform("pieces", lambda p: F.concat(p["head"], p["body"], F.lit(TURN_END))), "").alias("formatted"),
        F.aggregate(lengths, offset, advance, lambda acc: acc["spans"]).alias("loss_spans"),
    )


def read_back(rendered: DataFrame) -> DataFrame:
    """``conv_id, turns (role, text), loss_texts``: the messages and what lies under the loss
    mask, both unescaped, from the rendered text alone."""
    segments = F.split(F.col("formatted"), TURN_END, -1)  # the last one is empty
    parsed = rendered.select(
        "*",
        F.transform(
            F.slice(segments, 1, F.size(segments) - 1),
            lambda s: F.struct(
                F.substring_index(s, ": ", 1).alias("head"),
                s.alias("all"),
            ),
        ).alias("segments"),
    )
    return parsed.select(
        "conv_id",
        "formatted",
        F.transform(
            "segments",
            lambda s: F.struct(
                _unescape(F.substring(s["head"], F.lit(len(TURN_START) + 1), F.char_length(s["head"])), _ROLE_ESCAPES).alias("role"),
                _unescape(F.substring(s["all"], F.char_length(s["head"]) + 3, F.char_length(s["all"]))).alias("text"),
            ),
        ).alias("turns"),
        F.transform(
            "loss_spans",
            lambda p: _unescape(F.substring(F.col("formatted"), p["start"] + 1, p["end"] - p["start"])),
        ).alias("loss_texts"),
    )


def format_chats(events: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """Fold a log and render it: ``conv_id, formatted, loss_spans``."""
    return render(fold_events(events), loss_role)


def chat_digests(rendered: DataFrame) -> DataFrame:
    """What the output holds, as counts and digests, read back from it."""
    loss = F.array_join("loss_texts", "")
    return read_back(rendered).select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(
            F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), ""), 256
        ).alias("turns_sha256"),
        F.char_length(loss).cast("long").alias("loss_chars"),
        F.sha2(loss, 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"),
    )
