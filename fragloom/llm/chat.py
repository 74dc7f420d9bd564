r"""Chat formatting by event-sourced reconstruction, of DataFrame functions alone.

A log holds events (conv_id, seq, message_id, kind, role, text). Partitioned by conversation and sorted by seq, the events
of a message fold into its final text: ``message`` and ``edit`` set it, ``regenerate`` empties it and sets it to the event's
text, ``delta`` appends; so it is the text of the last event that sets it and of the deltas after. ``delete`` as the last of these
takes the message out. A message stands where its first event does and has the last role given.

Rendering marks each turn with the control strings of its role and escapes texts reversibly: ``\`` becomes ``\b``,
``<`` becomes ``\l`` and ``[`` becomes ``\s``, so no text holds the first character of a control string. The output has
the formatted string and its segments, each under the loss mask or not: an assistant's text is, nothing else.

Scale: events are shuffled by conversation and message, messages by conversation; only the messages of one conversation
meet in one row, which the output is.

Defined cases: null text or role counts as empty; roles unknown to the template are written out. Events of the same seq
are ordered by kind, role and text. A null conv_id is a conversation. An event of unknown kind is ignored. Deltas before any
message start from empty text. Other columns, whatever their names, are ignored. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings before and after a turn's text.
TURNS = {"system": ("<<SYS>>", "<</SYS>>"), "user": ("[INST] ", " [/INST]"), "assistant": ("<s>", "</s>")}
ROLE, TEXT, END = "<|role|>", "<|text|>", "<|end|>"
LOSS_ROLE = "assistant"
DRAFT = "draft: "
SETS, KINDS = ("message", "edit", "regenerate", "delete"), ("message", "edit", "regenerate", "delete", "delta")

_BODY = r"([^\[<]*)"
_PATTERNS = {"system": rf"^<<SYS>>{_BODY}<</SYS>>$", "user": rf"^\[INST\] {_BODY} \[/INST\]$", "assistant": rf"^<s>{_BODY}</s>$"}
_OTHER = rf"^<\|role\|>{_BODY}<\|text\|>{_BODY}<\|end\|>$"
_ANY = "|".join(p[1:-1].replace("(", "").replace(")", "") for p in [*_PATTERNS.values(), _OTHER])


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\b"))
    return F.replace(F.replace(text, F.lit("<"), F.lit("\\l")), F.lit("["), F.lit("\\s"))


def unescape(text: Column) -> Column:
    text = F.replace(F.replace(text, F.lit("\\s"), F.lit("[")), F.lit("\\l"), F.lit("<"))
    return F.replace(text, F.lit("\\b"), F.lit("\\"))


def fold(events: DataFrame) -> DataFrame:
    """Final messages: conv_id, at (seq of the first event), message_id, role, text."""
    known = events.where(F.col("kind").isin(*KINDS)).select("conv_id", "message_id", F.struct("seq", "kind", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")).alias("e"))
    logs = known.groupBy("conv_id", "message_id").agg(F.array_sort(F.collect_list("e")).alias("log"))
    start = F.array_max(F.transform("log", lambda e, i: F.when(e["kind"].isin(*SETS), i).otherwise(-1)))
    rows = logs.withColumn("start", start).where((F.col("start") < 0) | (F.get("log", "start")["kind"] != "delete"))
    live = F.slice("log", F.greatest(F.col("start"), F.lit(0)) + 1, F.size("log"))
    roles = F.filter(F.transform("log", lambda e: e["role"]), lambda r: r != "")
    return rows.select("conv_id", F.get("log", F.lit(0))["seq"].alias("at"), "message_id", F.coalesce(F.try_element_at(roles, F.lit(-1)), F.lit("")).alias("role"), F.array_join(F.transform(live, lambda e: e["text"]), "").alias("text"))


def render(messages: DataFrame) -> DataFrame:
    """Per conversation: conv_id, formatted, segments (text, loss), loss_spans (start from 0, length; in code points)."""
    head, foot = F.concat(F.lit(ROLE), escape(F.col("role")), F.lit(TEXT)), F.lit(END)
    for role, (before, after) in TURNS.items():
        head, foot = F.when(F.col("role") == role, F.lit(before)).otherwise(head), F.when(F.col("role") == role, F.lit(after)).otherwise(foot)
    turns = messages.withColumns({"head": head, "body": escape(F.col("text")), "foot": foot, "loss": F.col("role") == LOSS_ROLE})
    length = F.char_length("head") + F.char_length("body") + F.char_length("foot")
    upto = Window.partitionBy("conv_id").orderBy("at", "message_id").rowsBetween(Window.unboundedPreceding, -1)
    turns = turns.withColumn("start", F.coalesce(F.sum(length.cast("long")).over(upto), F.lit(0)) + F.char_length("head"))
    turn = F.struct("at", "message_id", "head", "body", "foot", "loss", "start")
    convs = turns.groupBy("conv_id").agg(F.array_sort(F.collect_list(turn)).alias("turns"))
    part = lambda text, loss: F.struct(text.alias("text"), loss.alias("loss"))
    segments = F.flatten(F.transform("turns", lambda t: F.array(part(t["head"], F.lit(False)), part(t["body"], t["loss"]), part(t["foot"], F.lit(False)))))
    spans = F.transform(F.filter("turns", lambda t: t["loss"]), lambda t: F.struct(t["start"].alias("start"), F.char_length(t["body"]).cast("long").alias("length")))
    convs = convs.select("conv_id", segments.alias("segments"), spans.alias("loss_spans"))
    return convs.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments", "loss_spans")


def parse(formatted: Column) -> Column:
    """Array of (role, text), the inverse of render()."""

    def turn(t: Column) -> Column:
        role, text = unescape(F.regexp_extract(t, _OTHER, 1)), F.regexp_extract(t, _OTHER, 2)
        for name, (before, _) in TURNS.items():
            role, text = F.when(t.startswith(before), F.lit(name)).otherwise(role), F.when(t.startswith(before), F.regexp_extract(t, _PATTERNS[name], 1)).otherwise(text)
        return F.struct(role.alias("role"), unescape(text).alias("text"))

    return F.transform(F.regexp_extract_all(formatted, F.lit(_ANY), F.lit(0)), turn)


def message_events(rows: DataFrame, conv_col: str = "conv_id", turn_col: str = "turn") -> DataFrame:
    """A table of turns as a log: each row, repeated ones too, is a message of its own; ordered by turn, then role and text."""
    order = Window.partitionBy("conv_id").orderBy("turn", "role", "text")
    rows = rows.select(F.col(conv_col).alias("conv_id"), F.col(turn_col).alias("turn"), "role", "text")
    return rows.withColumn("seq", F.row_number().over(order).cast("long")).select("conv_id", "seq", F.col("seq").alias("message_id"), F.lit("message").alias("kind"), "role", "text")


def streamed_events(messages: DataFrame, parts: int = 3) -> DataFrame:
    """A log whose fold is that of messages (events of kind message, see message_events()), as a chat server would write it: of
    each three messages one comes whole, one as a draft that an edit mends, and one in `parts` deltas, with every second
    assistant's answer broken off, regenerated and streamed again. What is written over says DRAFT."""
    text, length = F.coalesce("text", F.lit("")), F.char_length(F.coalesce("text", F.lit("")))
    step = F.ceil(length / parts).cast("int")
    event = lambda kind, said: F.struct(F.lit(kind).alias("kind"), said.alias("text"))
    deltas = [event("delta", F.substring(text, step * i + 1, step)) for i in range(parts)]
    opened, again = event("message", F.lit("")), event("regenerate", F.lit(""))
    broken = F.array(opened, event("delta", F.lit(DRAFT)), event("delta", F.substring(text, F.lit(1), step)), again, *deltas)
    way = F.when(F.col("seq") % 3 == 0, F.array(event("message", text))).when(F.col("seq") % 3 == 1, F.array(event("message", F.concat(F.lit(DRAFT), text)), event("edit", text)))
    way = way.when((F.col("role") == LOSS_ROLE) & (F.col("seq") % 2 == 0), broken).otherwise(F.array(opened, *deltas))
    log = messages.select("conv_id", "seq", "message_id", "role", F.posexplode(way).alias("at", "event"))
    return log.select("conv_id", (F.col("seq") * 16 + F.col("at")).alias("seq"), "message_id", "event.kind", "role", "event.text")


def format_chats(events: DataFrame) -> DataFrame:
    return render(fold(events))


def digests(formatted: DataFrame) -> DataFrame:
    """What is read back from format_chats(): turns from the string, the loss text from the masked segments."""
    turns = parse(F.col("formatted"))
    loss = F.array_join(F.transform(F.filter("segments", lambda s: s["loss"]), lambda s: unescape(s["text"])), "")
    rows = formatted.select("conv_id", turns.alias("turns"), loss.alias("loss"), F.char_length("formatted").cast("long").alias("formatted_chars"))
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return rows.select("conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(whole, 256).alias("turns_sha256"), F.char_length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"), "formatted_chars")
