"""Chat formatting: every assistant turn becomes an example of its own.

A turn is written as ``### role: text</turn>`` and a line end. In roles and texts the control strings and the escape
character itself are replaced by two-letter escapes, so a formatted conversation is read back unambiguously.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from careerline.llm.rows import column

HEAD, AFTER_ROLE, END = "### ", ": ", "</turn>\n"
ASSISTANT = "assistant"
#: Written for a string inside a role or text; the escape character comes first.
ESCAPES = (("\\", "\\b"), ("</turn>", "\\e"), ("###", "\\h"))
#: A colon ends the role, so in roles it is escaped too.
ROLE_ESCAPES = (*ESCAPES, (":", "\\c"))


def escaped(text: Column, escapes: tuple[tuple[str, str], ...] = ESCAPES) -> Column:
    """``text`` without control strings."""
    for plain, written in escapes:
        text = F.replace(text, F.lit(plain), F.lit(written))
    return text


def unescaped(text: Column) -> Column:
    """What :func:`escaped` was given."""
    for plain, written in reversed(ROLE_ESCAPES):
        text = F.replace(text, F.lit(written), F.lit(plain))
    return text


def examples(
    conversations: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", assistant: str = ASSISTANT
) -> DataFrame:
    """One row per assistant turn: the conversation up to this turn, of which only its text is trainable.

    Columns: ``conv_id`` (under its given name), ``example`` (from 0), ``turns`` (of the conversation so far), ``formatted``, ``loss_start`` and
    ``loss_chars`` (the trainable code points of ``formatted``) and ``is_last``. Turns after the last assistant turn, or
    a conversation without one, give a last example whose ``loss_chars`` are NULL, so that no turn is lost.

    Rows are taken by turn, NULL turns first, ties by role and text; repeated rows are turns of their own. NULL roles and
    texts are empty, rows with a NULL ``conv_id`` are one conversation, no rows give no rows. Other columns are ignored.

    A conversation is formatted as one value, as its last example is the whole of it.
    """
    rows = conversations.select(
        column(conv_id).alias("key"),
        F.struct(
            column(turn).alias("turn"),
            F.coalesce(column(role), F.lit("")).alias("role"),
            F.coalesce(column(text), F.lit("")).alias("text"),
        ).alias("said"),
    )
    whole = rows.groupBy("key").agg(F.sort_array(F.collect_list("said")).alias("said"))
    block = lambda t: F.concat(
        F.lit(HEAD), escaped(t["role"], ROLE_ESCAPES), F.lit(AFTER_ROLE), escaped(t["text"]), F.lit(END)
    )
    reply_chars = lambda t: F.when(t["role"] == assistant, F.char_length(escaped(t["text"])).cast("long"))
    written = whole.select(
        "key", F.transform("said", block).alias("blocks"), F.transform("said", reply_chars).alias("reply_chars")
    )
    count = F.size("blocks")
    ends = F.filter(F.sequence(F.lit(1), count), lambda k: (k == count) | F.element_at("reply_chars", k).isNotNull())
    cut = written.select("key", "blocks", "reply_chars", F.posexplode(ends).alias("example", "turns"))
    shown = cut.select(
        "key",
        "example",
        "turns",
        F.array_join(F.slice("blocks", F.lit(1), F.col("turns")), "").alias("formatted"),
        F.element_at("reply_chars", F.col("turns")).alias("loss_chars"),
        (F.col("turns") == count).alias("is_last"),
    )
    start = F.char_length("formatted") - len(END) - F.col("loss_chars")
    return shown.select(F.col("key").alias(conv_id), "example", "turns", "formatted", start.alias("loss_start"), "loss_chars", "is_last")


def loss_text(formatted: Column, loss_start: Column, loss_chars: Column) -> Column:
    """The trainable text of an example, as it was said; NULL if there is none."""
    return unescaped(F.substring(formatted, (loss_start + 1).cast("int"), loss_chars.cast("int")))


def read_back(formatted: Column) -> Column:
    """The turns of a formatted conversation: an array of role and text."""
    blocks = F.split(formatted, END, -1)

    def turn(block: Column) -> Column:
        head = F.substring_index(block, ":", 1)
        said = F.substring(block, F.char_length(head) + len(AFTER_ROLE) + 1, F.char_length(block))
        return F.struct(unescaped(F.substring(head, F.lit(len(HEAD) + 1), F.char_length(head))).alias("role"), unescaped(said).alias("text"))

    return F.transform(F.slice(blocks, F.lit(1), F.size(blocks) - 1), turn)


def digests(found: DataFrame, conv_id: str = "conv_id") -> DataFrame:
    """Per conversation what can be read from its :func:`examples`, without shuffling them.

    ``n_turns`` and ``turns_sha256`` (role, line end, text, line end per turn) come from the last example, ``loss_chars`` and ``loss_sha256``
    from the trainable texts of all of them in order, and ``formatted_chars`` counts the code points of all examples.
    """
    turns = F.when(F.col("is_last"), read_back(F.col("formatted")))
    lines = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    reply = loss_text(F.col("formatted"), F.col("loss_start"), F.col("loss_chars"))
    read = found.select(
        F.col(conv_id).alias("key"), "example", turns.alias("turns"), reply.alias("reply"), F.char_length("formatted").alias("chars")
    )
    read = read.select("key", "example", F.size("turns").alias("n"), F.sha2(F.array_join(lines, ""), 256).alias("digest"), "reply", "chars")
    per_conversation = read.groupBy("key").agg(
        F.max(F.when(F.col("digest").isNotNull(), F.col("n"))).cast("long").alias("n_turns"),
        F.max("digest").alias("turns_sha256"),
        F.sort_array(F.collect_list(F.when(F.col("reply").isNotNull(), F.struct("example", "reply")))).alias("replies"),
        F.sum("chars").alias("formatted_chars"),
    )
    said = F.array_join(F.transform("replies", lambda r: r["reply"]), "")
    return per_conversation.select(
        F.col("key").alias(conv_id),
        "n_turns",
        "turns_sha256",
        F.char_length(said).cast("long").alias("loss_chars"),
        F.sha2(said, 256).alias("loss_sha256"),
        "formatted_chars",
    )
