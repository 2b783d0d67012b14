"""Chat formatting: conversations as one marked-up string each, with the spans that carry loss.

A conversation is a sequence of blocks ``<|start|>role<|message|>text<|next|>text<|end|>``. Adjacent
turns of one role share a block; ``<|next|>`` keeps their texts apart. Inside roles and texts a
backslash is doubled and every control string gets a backslash after its first character, so no
marker can occur there and :func:`read_back` restores what was put in.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

# Markers of the template, and control strings of common templates kept out of texts.
START, MESSAGE, NEXT, END = "<|start|>", "<|message|>", "<|next|>", "<|end|>"
CONTROLS = ("<|", "<s>", "</s>", "[INST]", "[/INST]", "<<SYS>>", "<</SYS>>")


def escaped(text: Column) -> Column:
    out = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    for control in CONTROLS:
        out = F.replace(out, F.lit(control), F.lit(f"{control[0]}\\{control[1:]}"))
    return out


def unescaped(text: Column) -> Column:
    return F.regexp_replace(text, r"(?s)\\(.)", "$1")


def format_chat(
    turns: DataFrame, conv: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text",
    loss_role: str = "assistant",
) -> DataFrame:
    """One row per conversation: ``conv_id, formatted, loss_spans``.

    ``loss_spans`` holds ``(start, length)`` in code points, counted from 0, of every text of
    ``loss_role``. Turns go by ``turn`` (nulls first), ties by role and text, and repeated rows are
    kept. Null roles and texts count as empty; a null conversation is a conversation. No rows, no
    result; other columns are ignored. One conversation is one string and so one group: what is
    gathered is as large as the output row.
    """
    rows = turns.select(
        F.col(conv).alias("conv_id"),
        F.struct(
            F.col(turn).alias("turn"),
            F.coalesce(F.col(role).cast("string"), F.lit("")).alias("role"),
            F.coalesce(F.col(text).cast("string"), F.lit("")).alias("text"),
        ).alias("t"),
    )
    ordered = rows.groupBy("conv_id").agg(F.sort_array(F.collect_list("t")).alias("ts"))
    marked = ordered.select(
        "conv_id",
        F.transform(
            "ts",
            lambda t, i: F.struct(
                t["role"].alias("role"),
                escaped(t["text"]).alias("body"),
                ((i == 0) | (F.get("ts", i - 1)["role"] != t["role"])).alias("opens"),
                ((i == F.size("ts") - 1) | (F.get("ts", i + 1)["role"] != t["role"])).alias("closes"),
            ),
        ).alias("ts"),
    )
    parts = F.transform(
        "ts",
        lambda t: F.struct(
            F.when(t["opens"], F.concat(F.lit(START), escaped(t["role"]), F.lit(MESSAGE))).otherwise(F.lit(NEXT)).alias("before"),
            t["body"].alias("body"),
            F.when(t["closes"], F.lit(END)).otherwise(F.lit("")).alias("after"),
            (t["role"] == loss_role).alias("loss"),
        ),
    )
    formatted = F.array_join(F.transform("p", lambda x: F.concat(x["before"], x["body"], x["after"])), "")
    none = F.array().cast("array<struct<start:long,length:long>>")
    walk = F.aggregate(
        "p",
        F.struct(F.lit(0).cast("long").alias("at"), none.alias("spans")),
        lambda acc, x: F.struct(
            (acc["at"] + F.length(x["before"]) + F.length(x["body"]) + F.length(x["after"])).alias("at"),
            F.when(
                x["loss"],
                F.concat(
                    acc["spans"],
                    F.array(F.struct((acc["at"] + F.length(x["before"])).alias("start"), F.length(x["body"]).cast("long").alias("length"))),
                ),
            ).otherwise(acc["spans"]).alias("spans"),
        ),
        lambda acc: acc["spans"],
    )
    return marked.select("conv_id", parts.alias("p")).select("conv_id", formatted.alias("formatted"), walk.alias("loss_spans"))


def read_back(formatted: Column) -> Column:
    """The turns, ``array<struct<role, text>>``, that a formatted conversation holds."""
    blocks = F.filter(F.split(formatted, r"<\|end\|>"), lambda b: b != "")
    return F.flatten(
        F.transform(
            blocks,
            lambda b: F.transform(
                F.split(F.substring_index(b, MESSAGE, -1), r"<\|next\|>"),
                lambda body: F.struct(
                    unescaped(F.replace(F.substring_index(b, MESSAGE, 1), F.lit(START), F.lit(""))).alias("role"),
                    unescaped(body).alias("text"),
                ),
            ),
        )
    )


def loss_text(formatted: Column, spans: Column) -> Column:
    """All text under the loss mask, unescaped, in order, nothing between."""
    cut = F.transform(spans, lambda s: unescaped(F.substring(formatted, (s["start"] + 1).cast("int"), s["length"].cast("int"))))
    return F.array_join(cut, "")


def digests(chats: DataFrame) -> DataFrame:
    """What can be read back from formatted conversations, as counts and SHA-256 digests."""
    read = chats.select("conv_id", "formatted", read_back(F.col("formatted")).alias("turns"), loss_text(F.col("formatted"), F.col("loss_spans")).alias("loss"))
    joined = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    return read.select(
        "conv_id",
        F.size("turns").cast("long").alias("n_turns"),
        F.sha2(joined, 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"),
        F.sha2(F.col("loss"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
