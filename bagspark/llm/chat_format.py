"""Chat formatting by prefix-target expansion: every assistant turn is an example of its own.

An example's context is all turns before its target, written out; only the text of the target is trainable. The
contexts of a conversation add up to the square of its length; they are made one row at a time within a
conversation, and the digests keep only what they read from them.

Template: ``<|im_start|>`` role newline text ``<|im_end|>`` newline. A backslash escapes: inside texts and roles a
backslash is doubled, and every control string gets a backslash after its first character, so none is left
whole; inside roles a newline is preceded by one. ``unescaped`` takes the backslashes out again.
"""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

OPEN, CLOSE = "<|im_start|>", "<|im_end|>"
# Control strings of common chat templates.
CONTROL = (
    "<|im_start|>", "<|im_end|>", "<|endoftext|>", "<|system|>", "<|user|>", "<|assistant|>", "<s>", "</s>", "[INST]", "[/INST]",
    "<<SYS>>", "<</SYS>>", "<|begin_of_text|>", "<|eot_id|>", "<|start_header_id|>", "<|end_header_id|>", "<bos>", "<eos>",
    "<start_of_turn>", "<end_of_turn>",
)
TURN = r"(?s)^<\|im_start\|>((?:[^\n\\]|\\.)*)\n(.*)<\|im_end\|>\n$"


def escaped(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    return reduce(lambda t, s: F.replace(t, F.lit(s), F.lit(f"{s[0]}\\{s[1:]}")), CONTROL, doubled)


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def segments(turns: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text") -> DataFrame:
    """(conv_id, turn, trainable, segment): each row of ``turns`` as formatted text. Null role and text are empty.

    ``trainable`` marks assistant turns. Repeated rows stay; rows with a null conv_id are one conversation.
    """
    who, said = (F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (role, text))
    head = F.concat(F.lit(OPEN), F.replace(escaped(who), F.lit("\n"), F.lit("\\\n")), F.lit("\n"))
    return turns.select(
        F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), (who == "assistant").alias("trainable"),
        F.concat(head, escaped(said), F.lit(CLOSE + "\n")).alias("segment"),
    )


def examples(formatted: DataFrame) -> DataFrame:
    """One row per trainable segment: conv_id, turn, example (from 1), context (all segments before it), target (segment), and sizes.

    Turns are ordered by turn, then by their formatted text. ``trained_from`` and ``trained_to`` bound the
    trainable characters within context plus target: the text of the reply, without its marks.
    """
    order = W.partitionBy("conv_id").orderBy("turn", "segment")
    before = order.rowsBetween(W.unboundedPreceding, -1)
    expanded = formatted.select(
        "*", (F.row_number().over(order) - 1).alias("context_turns"), F.array_join(F.collect_list("segment").over(before), "").alias("context"),
        F.sum(F.col("trainable").cast("int")).over(order.rowsBetween(W.unboundedPreceding, 0)).alias("example"),
    ).where("trainable").withColumn("context_chars", F.length("context").cast("long"))
    return expanded.select(
        "conv_id", "turn", "example", "context_turns", "context_chars", "context", F.col("segment").alias("target"),
        (F.col("context_chars") + len(OPEN) + len("assistant") + 1).alias("trained_from"),
        (F.col("context_chars") + F.length("segment") - len(CLOSE) - 1).alias("trained_to"),
    )


def example_texts(formatted: DataFrame) -> DataFrame:
    """The texts of ``examples`` alone, for trainers: conv_id, turn, example, context, target."""
    return examples(formatted).select("conv_id", "turn", "example", "context", "target")


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, turn, trainable, role, text, chars) parsed from formatted segments."""
    return formatted.select(
        "conv_id", "turn", "trainable", unescaped(F.regexp_extract("segment", TURN, 1)).alias("role"),
        unescaped(F.regexp_extract("segment", TURN, 2)).alias("text"), F.length("segment").cast("long").alias("chars"), "segment",
    )


def replies(expanded: DataFrame) -> DataFrame:
    """(conv_id, turn, target, text, chars) of ``examples``: the span under the loss mask, cut from context plus target and taken back to text, and the length of both."""
    whole = F.concat("context", "target")
    span = F.substr(whole, (F.col("trained_from") + 1).cast("int"), (F.col("trained_to") - F.col("trained_from")).cast("int"))
    return expanded.select(
        "conv_id", "turn", "target", unescaped(span).alias("text"), (F.col("context_chars") + F.length("target")).cast("long").alias("chars"),
    )


def digests(formatted: DataFrame) -> DataFrame:
    """What each formatted conversation says: turns, digest of all of them, the text under the loss mask, and sizes.

    ``formatted_chars`` is the length of the formatted conversation, ``example_chars`` that of all its examples
    with their contexts. Loss text and examples are read back from the rows of ``examples``. A conversation without
    assistant turns has no example and an empty loss text.
    """
    every = F.sort_array(F.collect_list(F.struct("turn", "segment", "role", "text")))
    whole = read_back(formatted).groupBy("conv_id").agg(F.count(F.lit(1)).alias("n_turns"), F.sum("chars").alias("formatted_chars"), every.alias("_all"))
    mine = F.sort_array(F.collect_list(F.struct("turn", "target", "text")))
    trained = replies(examples(formatted)).groupBy(F.col("conv_id").alias("_of")).agg(
        mine.alias("_loss"), F.count(F.lit(1)).alias("_examples"), F.sum("chars").alias("_chars"),
    )
    joined = whole.join(trained, F.col("conv_id").eqNullSafe(F.col("_of")), "left")
    said = F.array_join(F.transform("_all", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.coalesce(F.array_join(F.transform("_loss", lambda t: t["text"]), ""), F.lit(""))
    texts = joined.withColumn("_said", said).withColumn("_lost", lost)
    return texts.select(
        "conv_id", "n_turns", F.sha2("_said", 256).alias("turns_sha256"), F.length("_lost").cast("long").alias("loss_chars"),
        F.sha2("_lost", 256).alias("loss_sha256"), "formatted_chars", F.coalesce("_examples", F.lit(0)).alias("n_examples"),
        F.coalesce("_chars", F.lit(0)).alias("example_chars"),
    )
