"""Chat formatting in Spark expressions."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

OPEN, CLOSE, NEXT = "<|im_start|>", "<|im_end|>", "<|im_next|>"
#: Turns of a conversation that are collected together; longer conversations are put together from such parts.
CHUNK = 256


def escape(text: Column) -> Column:
    """No `<|` is left: every `<`, backslashes, `|` gets one backslash more."""
    return F.regexp_replace(text, r"<(\\*)\|", r"<\\$1|")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"<\\(\\*)\|", "<$1|")


def escape_role(role: Column) -> Column:
    """As escape(), and without a line break, which ends the role in the template."""
    return F.replace(F.replace(escape(role), F.lit("\\"), F.lit("\\\\")), F.lit("\n"), F.lit("\\n"))


def unescape_role(role: Column) -> Column:
    parts = F.transform(F.split(role, r"\\\\"), lambda p: F.replace(p, F.lit("\\n"), F.lit("\n")))
    return unescape(F.array_join(parts, "\\"))


def _merged(turns: Column) -> Column:
    """Blocks of adjacent turns with one role: array<struct<role, texts>>."""
    kind = "array<struct<role:string,texts:array<string>>>"

    def add(blocks: Column, t: Column) -> Column:
        last = F.element_at(blocks, -1)
        joined = F.struct(last["role"].alias("role"), F.concat(last["texts"], F.array(t["text"])).alias("texts"))
        fresh = F.struct(t["role"].alias("role"), F.array(t["text"]).alias("texts"))
        return F.when(
            (F.size(blocks) > 0) & (F.try_element_at(blocks, F.lit(-1))["role"] == t["role"]),
            F.concat(F.slice(blocks, 1, F.greatest(F.size(blocks) - 1, F.lit(0))), F.array(joined)),
        ).otherwise(F.concat(blocks, F.array(fresh))).cast(kind)

    return F.aggregate(turns, F.array().cast(kind), add)


def format_chats(conversations: DataFrame, learn: str = "assistant", chunk: int = CHUNK) -> DataFrame:
    """One row per conversation: conv_id, formatted, segments array<struct<text, loss>>.

    Turns go by turn, then role, then text (null turns first; repeated rows stay). A null text or role counts as empty.
    Adjacent turns of one role share a block: `<|im_start|>role`, a line break, their texts with `<|im_next|>` between,
    `<|im_end|>`, a line break. The segments joined give the formatted text; `loss` marks those under the loss mask, the
    escaped text of one `learn` turn each. A null conv_id is a conversation of its own. No rows give no rows.

    Parts of at most `chunk` turn numbers are collected and sorted; where two parts meet inside a block the seam is
    `<|im_next|>`, else it closes one block and opens the next. So a conversation with a large share of all rows is
    collected by many tasks, and only its parts meet.
    """
    turns = conversations.select(
        "conv_id",
        F.floor(F.col("turn") / chunk).alias("part"),
        F.struct(
            F.col("turn").cast("long").alias("turn"),
            F.coalesce("role", F.lit("")).alias("role"),
            F.coalesce("text", F.lit("")).alias("text"),
        ).alias("t"),
    )
    parts = turns.groupBy("conv_id", "part").agg(F.array_sort(F.collect_list("t")).alias("turns"))
    # array_sort puts null fields last; null turns are a part of their own, which is sorted first below
    parts = parts.select(
        "conv_id", "part", _merged(F.transform("turns", lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text")))).alias("blocks")
    )

    def seg(text: Column, loss: Column | bool) -> Column:
        return F.struct(text.alias("text"), (F.lit(loss) if isinstance(loss, bool) else loss).alias("loss"))

    def block_segments(b: Column, i: Column) -> Column:
        def one(x: Column, k: Column) -> Column:
            lead = F.when(k > 0, F.lit(NEXT)).when(i > 0, F.concat(F.lit(f"{CLOSE}\n{OPEN}"), escape_role(b["role"]), F.lit("\n"))).otherwise(F.lit(""))
            return F.array(seg(lead, False), seg(escape(x), b["role"] == learn))

        return F.flatten(F.transform(b["texts"], one))

    parts = parts.select(
        "conv_id",
        F.struct(
            F.coalesce("part", F.lit(-(2**62))).alias("part"),
            F.col("blocks")[0]["role"].alias("first"),
            F.element_at("blocks", -1)["role"].alias("last"),
            F.flatten(F.transform("blocks", block_segments)).alias("body"),
        ).alias("p"),
    )
    whole = parts.groupBy("conv_id").agg(F.array_sort(F.collect_list("p")).alias("ps"))
    opened = lambda p: F.concat(F.lit(OPEN), escape_role(p["first"]), F.lit("\n"))

    def joined(p: Column, i: Column) -> Column:
        before = F.try_element_at("ps", i)  # the part before: positions here start at 1
        lead = F.when(i == 0, opened(p)).when(before["last"] == p["first"], F.lit(NEXT)).otherwise(F.concat(F.lit(f"{CLOSE}\n"), opened(p)))
        return F.concat(F.array(seg(lead, False)), p["body"])

    whole = whole.select(
        "conv_id", F.concat(F.flatten(F.transform("ps", joined)), F.array(seg(F.lit(f"{CLOSE}\n"), False))).alias("segments")
    )
    return whole.select("conv_id", F.array_join(F.transform("segments", lambda s: s["text"]), "").alias("formatted"), "segments")


def read_back(formatted: Column) -> Column:
    """The turns of a formatted text: array<struct<role, text>>."""
    blocks = F.split(formatted, r"<\|im_end\|>\n")
    blocks = F.slice(blocks, 1, F.size(blocks) - 1)

    def turns(b: Column) -> Column:
        cut = F.locate("\n", b)
        role = unescape_role(F.substring(b, F.lit(len(OPEN) + 1), cut - len(OPEN) - 1))
        texts = F.split(F.substring(b, cut + 1, F.length(b)), r"<\|im_next\|>")
        return F.transform(texts, lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    return F.flatten(F.transform(blocks, turns))
