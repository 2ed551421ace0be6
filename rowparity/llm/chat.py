"""Relational chat formatting: turns become one marked-up string per conversation, by Spark expressions only.

The turn structs of a conversation are collected and sorted; adjacent turns of one role form a block whose texts are
joined by a separator; the blocks are concatenated. Control strings inside roles and texts are broken by a backslash
after their first character, and backslashes are doubled, so unescaping is one left-to-right replacement and the
output can be read back exactly. Only assistant texts are under the loss mask.

    <s>user[INST]text[SEP]text[/INST]</s><s>assistant[INST]text[/INST]</s>

Defined results: null texts and roles are empty ones; a null conv_id is a conversation of its own; turns sort by turn
(null first), then role, then text, so ties and repeated rows have one order and all stay; other columns are ignored;
an empty table gives no rows. Texts are formatted whole. A conversation becomes one value, so its formatted text must
stay below the 2 GB that Spark allows a value; one with more ends the job.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, BODY, NEXT, STOP, CLOSE = "<s>", "[INST]", "[SEP]", "[/INST]", "</s>"
#: What must not occur in a text as it stands.
CONTROL = [OPEN, CLOSE, BODY, STOP, NEXT, "<<SYS>>", "<</SYS>>", "<|im_start|>", "<|im_end|>", "<|endoftext|>"]
CONTROL_PATTERN = "|".join(r"\Q" + c + r"\E" for c in CONTROL)
LOSS_ROLE = "assistant"


def escape(text: Column) -> Column:
    doubled = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    pattern = "([\\[<])(?<=(?=" + CONTROL_PATTERN + ").)"
    return F.when(text.contains("\\") | text.contains("[") | text.contains("<"), F.regexp_replace(doubled, pattern, r"$1\\")).otherwise(text)


def unescape(text: Column) -> Column:
    return F.when(text.contains("\\"), F.regexp_replace(text, r"(?s)\\(.)", "$1")).otherwise(text)


def format_conversations(turns: DataFrame) -> DataFrame:
    """conv_id, formatted, loss_spans: the loss mask, a (block, start, length) for each block of assistant texts.

    Blocks are what stands between two block ends, counted from 0; start and length are code points within the block.
    """
    one = F.struct("turn", F.coalesce(F.col("role").cast("string"), F.lit("")).alias("role"), F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"))
    sorted_turns = turns.select("conv_id", one.alias("t")).groupBy("conv_id").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    index = F.sequence(F.lit(0), F.size("turns") - 1)
    first = F.filter(index, lambda i: (i == 0) | (F.get("turns", i).role != F.get("turns", i - 1).role))
    starts = sorted_turns.withColumn("first", first)

    def block(at: Column, k: Column) -> Column:
        until = F.coalesce(F.get("first", k + 1), F.size("turns"))
        texts = F.transform(F.slice("turns", at + 1, until - at), lambda t: escape(t.text))
        return F.struct(F.get("turns", at).role.alias("role"), F.array_join(texts, NEXT).alias("body"))

    blocks = starts.select("conv_id", F.transform("first", block).alias("blocks"))
    head = lambda b: F.concat(F.lit(OPEN), escape(b.role), F.lit(BODY))
    whole = F.array_join(F.transform("blocks", lambda b: F.concat(head(b), b.body, F.lit(STOP + CLOSE))), "")
    spans = F.transform("blocks", lambda b, i: F.struct(i.alias("block"), F.length(head(b)).alias("start"), F.length(b.body).alias("length"), (b.role == LOSS_ROLE).alias("loss")))
    masks = F.transform(F.filter(spans, lambda s: s.loss), lambda s: F.struct(s.block.alias("block"), s.start.alias("start"), s.length.alias("length")))
    return blocks.select("conv_id", whole.alias("formatted"), masks.alias("loss_spans"))


def blocks_of(formatted: Column) -> Column:
    return F.split(formatted, r"\Q" + CLOSE + r"\E", -1)


def read_back(blocks: Column) -> Column:
    """The turns in the formatted string's blocks: array of (role, text, loss)."""
    blocks = F.filter(blocks, lambda b: b != "")
    kind = "array<struct<role:string,text:string,loss:boolean>>"

    def turns_of(b: Column) -> Column:
        role = unescape(F.substring_index(F.substr(b, F.lit(len(OPEN) + 1)), BODY, 1))
        inner = F.substring_index(F.substring_index(b, STOP, 1), BODY, -1)
        return F.transform(F.split(inner, r"\Q" + NEXT + r"\E", -1), lambda t: F.struct(role.alias("role"), unescape(t).alias("text"), (role == LOSS_ROLE).alias("loss")))

    return F.flatten(F.transform(blocks, turns_of)).cast(kind)


def masked_text(blocks: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, with nothing between."""
    cut = F.transform(spans, lambda s: F.substr(F.get(blocks, s.block), s.start + 1, s.length))
    texts = F.flatten(F.transform(cut, lambda body: F.split(body, r"\Q" + NEXT + r"\E", -1)))
    return F.array_join(F.transform(texts, unescape), "")


def digest(formatted: DataFrame) -> DataFrame:
    """What can be read back from the output of format_conversations()."""
    # blocks is a column of its own, for an expression would be evaluated again for each span
    parts = formatted.select("conv_id", "formatted", "loss_spans", blocks_of(F.col("formatted")).alias("blocks"))
    back = parts.select("conv_id", "formatted", read_back(F.col("blocks")).alias("turns"), masked_text(F.col("blocks"), F.col("loss_spans")).alias("loss"))
    return back.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(F.array_join(F.transform("turns", lambda t: F.concat(t.role, F.lit("\n"), t.text, F.lit("\n"))), ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
