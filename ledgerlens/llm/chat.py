"""Chat formatting from an event log, in built-in expressions only.

The log has one event per row: ``message`` opens a turn, ``delta`` appends streamed text to it,
``edit`` replaces its text and ``regenerate`` starts its text anew. Events belong to a
conversation and to a message of it; they are folded in order of their sequence number. The
folded turns are then rendered by a template that marks each turn and escapes control strings
in texts, so that a transcript can be read back exactly.

Rendered form: ``<|turn|>role\\ntext<|end|>\\n`` for each turn. Inside roles and texts a
backslash stands before each backslash, and after the first character of each control string;
in roles also before a newline. A backslash thus always means: take the next character as it
is.

Turns are first rendered in segments of ``SEGMENT`` sequence numbers, so that a conversation
of any length meets in one task only as a few finished pieces of text.

Cases: null texts and roles are empty; a null kind is ``message``; rows with equal sequence
numbers are ordered by kind, role and text, and equal rows are separate turns; events before
any ``message`` of their message open a turn themselves; an empty table gives no rows; other
columns are not read; rows without a conversation form one conversation with a null id.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F
from pyspark.sql.window import Window

TURN, END = "<|turn|>", "<|end|>"
# Strings that chat templates give a meaning.
CONTROL = (TURN, END, "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<s>", "</s>", "[INST]",
           "[/INST]", "<<SYS>>", "<</SYS>>")
KINDS = ("message", "delta", "edit", "regenerate")
LEARNED_ROLE = "assistant"
SEGMENT = 64

_RESTS = "|".join(c[1:].replace("|", r"\|").replace("[", r"\[").replace("]", r"\]")
                  for c in CONTROL)


def escape(text: Column, *, newline: bool = False) -> Column:
    """Make control strings in a text harmless; undone by :func:`unescape`."""
    safe = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    safe = F.regexp_replace(safe, rf"([<\[])(?={_RESTS})", r"$1\\")
    return F.replace(safe, F.lit("\n"), F.lit("\\\n")) if newline else safe


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def fold(events: DataFrame) -> DataFrame:
    """Turns (conv_id, seq, part, role, text) from events (conv_id, msg, seq, kind, role,
    text): one row per turn, ordered by (seq, msg, part, role, text)."""
    rows = events.select(
        "conv_id", "msg", "seq", F.coalesce("kind", F.lit("message")).alias("kind"),
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rank = F.array_position(F.array(*[F.lit(k) for k in KINDS]), F.col("kind"))
    in_order = Window.partitionBy("conv_id", "msg").orderBy("seq", rank, "role", "text")
    turns = rows.withColumns({
        "place": F.row_number().over(in_order),
        "part": F.sum((F.col("kind") == "message").cast("long")).over(
            in_order.rowsBetween(Window.unboundedPreceding, 0))})
    # Text counts from the last event that set it anew.
    of_turn = Window.partitionBy("conv_id", "msg", "part")
    anew = F.when(F.col("kind") != "delta", F.col("place"))
    live = turns.withColumns({
        "from": F.coalesce(F.max(anew).over(of_turn), F.lit(0)),
        "first": F.min(F.struct("place", "seq", "role")).over(of_turn)}
    ).filter(F.col("place") >= F.col("from"))
    pieces = F.sort_array(F.collect_list(F.struct("place", "text")))
    return live.groupBy("conv_id", "msg", "part").agg(
        F.first("first").alias("first"), F.array_join(pieces["text"], "").alias("text")
    ).select("conv_id", F.col("first.seq").alias("seq"), "msg", "part",
             F.col("first.role").alias("role"), "text")


def render(turns: DataFrame) -> DataFrame:
    """(conv_id, segments): each conversation's transcript in segments, to be read as one
    text, and within each segment its ``loss`` mask: (start, end) in code points of the
    learned role's texts."""
    shown = turns.withColumns({
        "head": F.concat(F.lit(TURN), escape(F.col("role"), newline=True), F.lit("\n")),
        "body": escape(F.col("text"))})
    row = F.struct(
        "seq", "msg", "part", F.concat("head", "body", F.lit(END + "\n")).alias("text"),
        F.char_length("head").alias("head"), F.char_length("body").alias("body"),
        (F.col("role") == LEARNED_ROLE).alias("learn"))
    start = F.struct(F.lit(0).alias("at"),
                     F.array().cast("array<struct<start:int,end:int>>").alias("loss"))

    def add(acc: Column, r: Column) -> Column:
        a = acc["at"] + r["head"]
        span = F.struct(a.alias("start"), (a + r["body"]).alias("end"))
        return F.struct(
            (a + r["body"] + len(END) + 1).alias("at"),
            F.when(r["learn"], F.array_append(acc["loss"], span)).otherwise(acc["loss"])
            .alias("loss"))

    segments = shown.groupBy("conv_id", F.floor(F.col("seq") / SEGMENT).alias("segment")).agg(
        F.sort_array(F.collect_list(row)).alias("rows")
    ).select("conv_id", F.struct(
        "segment", F.array_join(F.col("rows.text"), "").alias("text"),
        F.aggregate("rows", start, add, lambda acc: acc["loss"]).alias("loss")).alias("s"))
    return segments.groupBy("conv_id").agg(F.sort_array(F.collect_list("s")).alias("segments"))


def read_back(formatted: Column) -> Column:
    """Array of (role, text) from a transcript."""
    # An unescaped turn mark can only come from the template.
    bodies = F.filter(F.split(formatted, r"<\|turn\|>"), lambda x: x != "")
    role = r"(?s)^((?:[^\\\n]|\\.)*+)\n.*$"
    return F.transform(bodies, lambda b: F.struct(
        unescape(F.regexp_extract(b, role, 1)).alias("role"),
        unescape(F.regexp_replace(b, r"(?s)^(?:[^\\\n]|\\.)*+\n|<\|end\|>\n$", "")).alias("text")))


def masked_text(segments: Column) -> Column:
    """All text under the loss mask, unescaped, in order."""
    return F.array_join(F.flatten(F.transform(segments, lambda g: F.transform(
        g["loss"], lambda s: unescape(F.substring(
            g["text"], s["start"] + 1, s["end"] - s["start"]))))), "")


def digests(rendered: DataFrame) -> DataFrame:
    """Figures of each transcript, read back from its rendered form."""
    whole = rendered.select(
        "conv_id", F.array_join(F.col("segments.text"), "").alias("formatted"),
        masked_text(F.col("segments")).alias("loss"))
    read = whole.select("*", read_back(F.col("formatted")).alias("turns"))
    listed = F.array_join(F.transform(
        "turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"),
        F.sha2(listed.cast("binary"), 256).alias("turns_sha256"),
        F.char_length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"),
        F.char_length("formatted").cast("long").alias("formatted_chars"))


def from_messages(rows: DataFrame) -> DataFrame:
    """Events from finished messages (conv_id, turn, role, text), one per row."""
    return rows.select("conv_id", F.col("turn").alias("msg"), F.col("turn").alias("seq"),
                       F.lit("message").alias("kind"), "role", "text")
