"""Chat formatting with Spark expressions only.

Turns are collected as structs, sorted, and joined by an expression that compares each turn's role with the one before:
adjacent turns of one role share one frame, with a separator between their texts. Control strings inside texts and
roles are escaped reversibly, so the formatted text alone gives back every turn.

    <|im_start|>role\ntext<|im_sep|>text of the same role<|im_end|>\n<|im_start|>...

Conversations are formatted in two steps. First, the turns of each (conversation, range of `chunk` turn numbers) become
one piece; then a conversation's pieces are joined. A very long conversation is thus sorted, escaped and joined by many
tasks, and only its pieces meet in the one row that it finally is.

The loss mask covers the texts of assistant turns, without frames and separators: `loss` has one flag for each turn.

Defined results: a null text is empty, a null role ''; turns of equal number are ordered by role and text, null numbers
come first; repeated rows are separate turns; rows of a null conversation form one conversation; an empty table gives an
empty result; other columns are ignored. A text is escaped whole where it is read, and a conversation's formatted text
is one value, so the longest one has to fit into a task's memory some four times over.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import pick

START, END, SEP = "<|im_start|>", "<|im_end|>", "<|im_sep|>"
CHUNK = 64


def escape(c: Column, newline: bool = False) -> Column:
    """& and <| are written as references, so no control string is left; in roles the line feed is, too."""
    c = F.replace(F.replace(c, F.lit("&"), F.lit("&amp;")), F.lit("<|"), F.lit("&lt;|"))
    return F.replace(c, F.lit("\n"), F.lit("&nl;")) if newline else c


def unescape(c: Column, newline: bool = False) -> Column:
    c = F.replace(c, F.lit("&nl;"), F.lit("\n")) if newline else c
    return F.replace(F.replace(c, F.lit("&lt;|"), F.lit("<|")), F.lit("&amp;"), F.lit("&"))


def _open(role: Column) -> Column:
    return F.concat(F.lit(START), role, F.lit("\n"))


def format_conversations(turns: DataFrame, assistant: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """(conv_id, formatted, loss): turns has conv_id, turn, role and text."""
    t = pick(turns, "conv_id", "turn", "role", "text").select(
        "conv_id", F.floor(F.col("turn") / chunk).alias("part"), "turn",
        F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"),
    )
    parts = t.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("turns"))
    role = lambda x: escape(x["role"], newline=True)
    # everything of a piece but the opening of its first turn, which depends on the piece before
    link = lambda x, i: F.when(i == 0, F.lit("")).when(
        x["role"] == F.get("turns", i - 1)["role"], F.lit(SEP)
    ).otherwise(F.concat(F.lit(END + "\n"), _open(role(x))))
    pieces = parts.select(
        "conv_id", "part",
        F.array_join(F.transform("turns", lambda x, i: F.concat(link(x, i), escape(x["text"]))), "").alias("body"),
        F.get("turns", F.lit(0))["role"].alias("first"),
        F.element_at("turns", -1)["role"].alias("last"),
        F.transform("turns", lambda x: x["role"] == assistant).alias("loss"),
    )
    whole = pieces.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("part", "first", "last", "body", "loss"))).alias("pieces"))
    joint = lambda x, i: F.when(i == 0, F.lit("")).when(
        x["first"] == F.get("pieces", i - 1)["last"], F.lit(SEP)
    ).otherwise(F.concat(F.lit(END + "\n"), _open(escape(x["first"], newline=True))))
    return whole.select(
        "conv_id",
        F.concat(
            _open(escape(F.get("pieces", F.lit(0))["first"], newline=True)),
            F.array_join(F.transform("pieces", lambda x, i: F.concat(joint(x, i), x["body"])), ""),
            F.lit(END + "\n"),
        ).alias("formatted"),
        F.flatten("pieces.loss").alias("loss"),
    )


def read_turns(formatted: Column) -> Column:
    """The turns of a formatted conversation, as structs (role, text), from its text alone."""
    frames = F.slice(F.split(formatted, r"<\|im_start\|>"), F.lit(2), F.size(F.split(formatted, r"<\|im_start\|>")))

    def turns(frame: Column) -> Column:
        role = F.substring_index(frame, "\n", 1)
        body = F.regexp_extract(frame, r"(?s)^[^\n]*\n(.*)<\|im_end\|>\n$", 1)
        return F.transform(F.split(body, r"<\|im_sep\|>"), lambda text: F.struct(unescape(role, newline=True).alias("role"), unescape(text).alias("text")))

    return F.flatten(F.transform(frames, turns))


def digest(formatted: DataFrame) -> DataFrame:
    """What is read back from format_conversations' output: turns, the text under the loss mask, lengths."""
    t = formatted.select("conv_id", "loss", F.length("formatted").cast("long").alias("formatted_chars"), read_turns(F.col("formatted")).alias("turns"))
    under = F.array_join(F.transform(F.filter("turns", lambda x, i: F.get("loss", i)), lambda x: x["text"]), "")
    t = t.select("*", under.alias("under"))
    said = F.array_join(F.transform("turns", lambda x: F.concat(x["role"], F.lit("\n"), x["text"], F.lit("\n"))), "")
    return t.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(said, 256).alias("turns_sha256"),
        F.length("under").cast("long").alias("loss_chars"),
        F.sha2("under", 256).alias("loss_sha256"),
        "formatted_chars",
    )
