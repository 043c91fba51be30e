"""Chat formatting by event-sourced reconstruction, with DataFrame functions only.

A conversation is stored as a log of events, ``conv_id, seq, slot, kind, role, text``. ``seq`` orders the events of a
conversation, ``slot`` is a message's place in it. The kinds are

* ``message``: the message at ``slot`` now has this text, whatever it had before;
* ``delta``: text streamed on to the message at ``slot``;
* ``edit``: as ``message``, and all later slots are gone, since they answered another text;
* ``regenerate``: the message at ``slot`` starts anew (with the event's text, if any), and all later slots are gone.

The fold needs no state that runs along a conversation: an event counts in the end just if it is not before the last
reset of its own slot, and not before the last edit or regeneration of an earlier slot. The first is an aggregate of the
slot, the second a running maximum over the slots of a conversation, so the events of one conversation are spread over
tasks by slot first, and only its final messages meet, in the one row that holds the formatted conversation.

The template is ``### role: text</turn>`` and a line end for each message. Control strings inside texts and roles are
written as a backslash and a letter, and so is a backslash, so that no text can end its turn or begin another and every
text can be read back: ``\\`` is ``\\b``, ``### `` is ``\\h``, ``</turn>`` is ``\\e`` and, in a role, a colon is ``\\c``.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

MESSAGE, DELTA, EDIT, REGENERATE = "message", "delta", "edit", "regenerate"
LEARNED = "assistant"
OPEN, COLON, CLOSE = "### ", ": ", "</turn>\n"
#: What is written for what, in the order of writing; read back in reverse.
ESCAPES = [("\\", "\\b"), ("</turn>", "\\e"), ("### ", "\\h")]
ROLE_ESCAPES = [*ESCAPES, (":", "\\c")]
#: Code points of a streamed piece in a log made from stored rows.
PIECE = 400


# ---- the log

def log_of(conversations: DataFrame) -> DataFrame:
    """Stored rows (``conv_id, turn, role, text``) as a log: what an assistant says comes as deltas, the rest whole.

    Rows of a conversation are taken by turn, then role, then text; repeated rows are messages of their own.
    """
    rows = conversations.select(F.col("conv_id").cast("long").alias("conv_id"), F.col("turn").cast("long").alias("turn"),
                                F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    among = F.row_number().over(Window.partitionBy("conv_id", "turn").orderBy("role", "text"))      # rows of one turn
    rows = rows.withColumn("nth", among)
    streamed = F.col("role") == LEARNED
    pieces = F.when(streamed, F.regexp_extract_all("text", F.lit(f"(?s).{{1,{PIECE}}}"), F.lit(0))).otherwise(F.array().cast("array<string>"))
    event = lambda n, kind, text: F.struct(n.alias("n"), F.lit(kind).alias("kind"), text.alias("text"))
    events = F.concat(F.array(event(F.lit(0), MESSAGE, F.when(streamed, "").otherwise(F.col("text")))),
                      F.transform(pieces, lambda p, k: event(k + 1, DELTA, p)))
    return (rows.select("conv_id", "turn", "nth", "role", F.explode(events).alias("e"))
            .select("conv_id", F.struct("turn", "nth", "e.n").alias("seq"), F.struct("turn", "nth").alias("slot"), "e.kind", "role", "e.text"))


def fold(events: DataFrame) -> DataFrame:
    """The messages a log leaves: ``conv_id, slot, role, text``.

    An event delivered twice (all fields equal) counts once. Events without ``seq`` or of an unknown kind are ignored, a
    null text adds nothing, and a message has the last role that any of its events named (null: empty). Null ids and
    slots are values of their own, a null slot is before all others. ``seq`` and ``slot`` can be of any type that has an
    order; ``seq`` must tell the events of a conversation apart (of equal ones, deltas come before resets). Other columns
    are ignored; an empty log leaves nothing.
    """
    kind = F.col("kind")
    rows = (events.select("conv_id", "seq", "slot", "kind", "role", "text")
            .filter(F.col("seq").isNotNull() & kind.isin(MESSAGE, DELTA, EDIT, REGENERATE)))
    slots = rows.groupBy("conv_id", "slot").agg(
        F.collect_list(F.struct("seq", "kind", "role", "text")).alias("log"),      # one message's events
        F.max(F.when(kind != DELTA, F.col("seq"))).alias("reset"), F.max(F.when(kind.isin(EDIT, REGENERATE), F.col("seq"))).alias("cut"))
    earlier = Window.partitionBy("conv_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)
    slots = slots.select("conv_id", "slot", F.array_sort(F.array_distinct("log")).alias("log"), "reset", F.max("cut").over(earlier).alias("gone"))
    since_reset = lambda e: F.col("reset").isNull() | (e["seq"] > F.col("reset")) | ((e["seq"] == F.col("reset")) & (e["kind"] != DELTA))
    live = F.filter("log", lambda e: (F.col("gone").isNull() | (e["seq"] > F.col("gone"))) & since_reset(e))
    named = F.filter("log", lambda e: e["role"].isNotNull())
    role = F.when(F.size(named) > 0, F.element_at(named, -1)["role"]).otherwise("")
    return (slots.select("conv_id", "slot", role.alias("role"), live.alias("live")).filter(F.size("live") > 0)
            .select("conv_id", "slot", "role", F.array_join(F.transform("live", lambda e: F.coalesce(e["text"], F.lit(""))), "").alias("text")))


# ---- the template

def escaped(c: Column, rules=ESCAPES) -> Column:
    for plain, written in rules:
        c = F.replace(c, F.lit(plain), F.lit(written))
    return c


def unescaped(c: Column, rules=ESCAPES) -> Column:
    for plain, written in reversed(rules):
        c = F.replace(c, F.lit(written), F.lit(plain))
    return c


def render(messages: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments`` of each conversation that has messages.

    ``formatted`` is the text to train on. ``segments`` are its parts in order, ``text`` and ``loss``: joined, the texts are
    ``formatted``; a loss counts only inside what an assistant says. A conversation's formatted text is one value (2 GB at most).
    """
    head = F.concat(F.lit(OPEN), escaped(F.coalesce("role", F.lit("")), ROLE_ESCAPES), F.lit(COLON)).alias("head")
    turn = F.struct("slot", head, escaped(F.coalesce("text", F.lit(""))).alias("body"), F.coalesce(F.col("role") == LEARNED, F.lit(False)).alias("loss"))
    segment = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(
        segment(t["head"], F.lit(False)), segment(t["body"], t["loss"]), segment(F.lit(CLOSE), F.lit(False)))))
    return (messages.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
            .select("conv_id", segments.alias("segments"))
            .select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments"))


def format_conversations(events: DataFrame) -> DataFrame:
    """``conv_id, formatted, segments`` of every conversation of a log: :func:`fold`, then :func:`render`."""
    return render(fold(events))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation, ``role`` and ``text``, from its text alone."""
    def turn(piece):
        role = F.substring_index(F.substr(piece, F.lit(len(OPEN) + 1)), COLON, 1)
        body = F.substr(piece, F.char_length(role) + len(OPEN + COLON) + 1)
        return F.struct(unescaped(role, ROLE_ESCAPES).alias("role"), unescaped(body).alias("text"))
    pieces = F.split(formatted, CLOSE)          # every turn is closed, so what comes last is empty
    return F.transform(F.slice(pieces, 1, F.size(pieces) - 1), turn)


def learned(segments: Column) -> Column:
    """All text under the loss mask, as it was written before escaping."""
    return F.array_join(F.transform(F.filter(segments, lambda s: s["loss"]), lambda s: unescaped(s["text"])), "")
