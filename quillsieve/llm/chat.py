"""Chat formatting from event logs, in DataFrame operations only.

A log has events of messages: a `delta` appends to its message, an `edit` replaces what the message says, and a
`regenerate` discards it, for the deltas that follow. Logs are partitioned by conversation and sorted by sequence number;
folding a message's events is the same as joining, in order, the texts from its last edit or regeneration on. The messages
are then rendered by a template, and the assistant's texts get a loss mask of [start, length] spans in characters.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

# What the template and common chat templates use as marks. In a text, the first character of each is
# written as a backslash and a letter, and a backslash as two.
_MARKS = [("<", "l", r"\||/?s>|<SYS>>|</SYS>>"), ("[", "b", r"/?INST\]"), ("|", "p", r">")]
_OPEN, _MIDDLE, _CLOSE = "<|", "|>\n", "</s>\n"


def escape(text: Column) -> Column:
    """The text without any mark of the template; unescape() gives it back."""
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for char, letter, follow in _MARKS:
        out = F.regexp_replace(out, rf"\{char}(?={follow})", rf"\\{letter}")
    return out


def unescape(text: Column) -> Column:
    def plain(part: Column) -> Column:
        for char, letter, _ in _MARKS:
            part = F.replace(part, F.lit("\\" + letter), F.lit(char))
        return part

    return F.array_join(F.transform(F.split(text, r"\\\\"), plain), "\\")


def fold(events: DataFrame) -> DataFrame:
    """(conversation, message, seq, kind, role, text) -> final messages (conversation, at, message, role, text).

    A message's place `at` is that of its first event; its role the first that is given. Null texts count as empty, null
    kinds as deltas. Events with one sequence number go by kind (deltas, edits, regenerations), role and text; of repeated edits
    the last counts. A null conversation or message is one of
    its own.
    """
    kind = F.coalesce("kind", F.lit("delta"))
    event = F.struct("seq", kind.alias("kind"), "role", F.coalesce("text", F.lit("")).alias("text"))
    log = events.groupBy("conversation", "message").agg(F.sort_array(F.collect_list(event)).alias("log"))
    last = F.coalesce(F.array_max(F.transform("log", lambda e, i: F.when(e.kind != "delta", i))), F.lit(0))
    live = F.slice("log", F.col("last") + 1, F.greatest(F.size("log"), F.lit(1)))
    live = F.transform(live, lambda e: F.when(e.kind == "regenerate", "").otherwise(e.text))
    roles = F.filter(F.transform("log", lambda e: e.role), lambda r: r.isNotNull())
    return log.withColumn("last", last).select("conversation", F.get("log", F.lit(0)).seq.alias("at"), "message", F.get(roles, F.lit(0)).alias("role"), F.array_join(live, "").alias("text"))


def render(messages: DataFrame, learn: str = "assistant") -> DataFrame:
    """Final messages -> (conversation, formatted, mask). A null role is written as an empty one.

    A conversation is one row, whatever its length: it is one training example. Null texts are empty; repeated messages are
    turns of their own, in no order that matters; without messages there is no row.
    """
    order = Window.partitionBy("conversation").orderBy("at", "message", "role", "text")
    turn = messages.select("conversation", "at", "message", "role", "text", F.concat(F.lit(_OPEN), escape(F.coalesce("role", F.lit(""))), F.lit(_MIDDLE)).alias("head"), escape(F.coalesce("text", F.lit(""))).alias("body"))
    turn = turn.withColumn("piece", F.concat("head", "body", F.lit(_CLOSE))).withColumn("k", F.row_number().over(order))
    turn = turn.withColumn("start", F.sum(F.length("piece")).over(order.rowsBetween(Window.unboundedPreceding, -1)))
    span = F.when(F.col("role") == learn, F.struct((F.coalesce("start", F.lit(0)) + F.length("head")).cast("int").alias("start"), F.length("body").alias("length")))
    rows = turn.groupBy("conversation").agg(F.sort_array(F.collect_list(F.struct("k", "piece", span.alias("span")))).alias("t"))
    return rows.select("conversation", F.array_join(F.transform("t", lambda x: x.piece), "").alias("formatted"), F.filter(F.transform("t", lambda x: x.span), lambda s: s.isNotNull()).alias("mask"))


def read_turns(formatted: Column) -> Column:
    """The (role, text) pairs of a rendered conversation."""
    parts = F.filter(F.split(formatted, _CLOSE), lambda p: p != "")
    at = lambda p: F.instr(p, _MIDDLE)
    return F.transform(parts, lambda p: F.struct(unescape(F.substring(p, F.lit(len(_OPEN) + 1), at(p) - 1 - len(_OPEN))).alias("role"), unescape(F.substring(p, at(p) + len(_MIDDLE), F.length(p))).alias("text")))


def read_loss(formatted: Column, mask: Column) -> Column:
    """The texts under a loss mask, unescaped."""
    return F.transform(mask, lambda s: unescape(F.substring(formatted, s.start + 1, s.length)))


def as_events(rows: DataFrame, chunk: int = 400, revised: bool = False) -> DataFrame:
    """Conversations as rows (conv_id, turn, role, text) -> the event log that streaming them would leave: each text in
    deltas of `chunk` characters. Rows of one conversation and turn are turns of their own. A null text is one empty delta.

    With `revised`, messages are logged as if they had not come out right at once: of three in a row, the first is drafted
    and regenerated before its deltas come, the second is edited after others have come, and the third is as without."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select("conv_id", "turn", "role", F.coalesce("text", F.lit("")).alias("text")).withColumn("message", F.row_number().over(order).cast("long"))
    event = lambda kind, text: F.struct(F.lit(kind).alias("kind"), text.alias("text"))
    pieces = lambda text: F.transform(F.sequence(F.lit(0), F.greatest(F.ceil(F.length(text) / chunk).cast("int") - 1, F.lit(0))), lambda k: event("delta", F.substring(text, k * chunk + 1, F.lit(chunk))))
    log = pieces(F.col("text"))
    if revised:
        draft, none = pieces(F.concat(F.lit("draft "), F.reverse("text"))), F.lit(None).cast("string")
        log = F.when(F.col("message") % 3 == 1, F.concat(draft, F.array(event("regenerate", none)), log)).when(F.col("message") % 3 == 2, F.concat(draft, F.array(event("edit", F.col("text"))))).otherwise(log)
    rows = rows.select(F.col("conv_id").alias("conversation"), "message", "role", F.posexplode(log).alias("part", "event"))
    return rows.select("conversation", "message", (F.col("message") * (1 << 32) + F.col("part")).alias("seq"), "event.kind", "role", "event.text")
