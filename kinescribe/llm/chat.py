r"""Chat formatting with a grammar round trip (DataFrame functions only).

Grammar: conversation = turn*, turn = "### " role ": " body "</turn>\n", role = URL-encoded text, body =
text without the terminator in which a backslash takes the next character literally.

A turn is first written as it is. A deterministic parser reads it back; where that doesn't give the
turn's role and text, the text's conflicts are escaped: a backslash before each backslash, and one inside
each terminator. Escaped text holds no terminator and unescapes to itself, so the second reading agrees
(and the job fails if it ever did not). Only conflicting texts are changed.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

END = "</turn>\n"
HEADER = r"^### ([^ ]*): "


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit(END), F.lit(END.replace("/", "\\/")))


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def render(role: Column, body: Column) -> Column:
    return F.concat(F.lit("### "), F.url_encode(role), F.lit(": "), body, F.lit(END))


def parse(formatted: Column) -> Column:
    """array<struct<head: int, role: string, body: string>> of a formatted conversation: the header's
    length, the role, and the body as it is written (unescape gives the text)."""
    turns = F.split(formatted, END, -1)
    return F.transform(
        F.slice(turns, F.lit(1), F.size(turns) - 1),
        lambda t: F.transform(
            F.array(F.regexp_extract(t, HEADER, 0)),
            lambda h: F.struct(F.length(h).alias("head"), F.url_decode(F.regexp_extract(h, HEADER, 1)).alias("role"), F.substring(t, F.length(h) + 1, F.length(t)).alias("body")),
        )[0],
    )


def _agrees(turn: Column, role: Column, text: Column) -> Column:
    return F.transform(F.array(parse(turn)), lambda p: (F.size(p) == 1) & (F.get(p, F.lit(0))["role"] == role) & (unescape(F.get(p, F.lit(0))["body"]) == text))[0]


def render_turns(turns: DataFrame) -> DataFrame:
    """conv_id, turn, role, text and `rendered`; null roles and texts are empty."""
    t = turns.select(F.col("conv_id").cast("long").alias("conv_id"), "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    plain, safe = render(F.col("role"), F.col("text")), render(F.col("role"), escape(F.col("text")))
    t = t.withColumn("rendered", F.when(_agrees(plain, F.col("role"), F.col("text")), plain).otherwise(safe))
    again = F.when(_agrees(F.col("rendered"), F.col("role"), F.col("text")), F.col("rendered")).otherwise(F.raise_error(F.lit("a turn can't be read back")))
    return t.withColumn("rendered", again)


def format_conversations(turns: DataFrame) -> DataFrame:
    """One row a conversation: conv_id, formatted. Turns stand by turn (null first), then role, then text;
    repeated rows are repeated turns. Rows without conv_id are one conversation. A conversation is one
    text, so its rendered turns meet in one row, collected by map tasks first."""
    return (
        render_turns(turns)
        .groupBy("conv_id")
        .agg(F.collect_list(F.struct("turn", "role", "text", "rendered")).alias("turns"))
        .select("conv_id", F.array_join(F.transform(F.array_sort("turns"), lambda t: t["rendered"]), "").alias("formatted"))
    )


def read_back(conversations: DataFrame, learnt: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """Digests of formatted conversations, from what the parser reads: turns, and the text under the loss
    mask. The mask covers the bodies of the roles in `learnt`: `loss_mask` has each turn's header length,
    body length and whether the body counts."""
    parsed = conversations.select("conv_id", F.length("formatted").cast("long").alias("formatted_chars"), F.transform(parse(F.col("formatted")), lambda t: F.struct(t["role"].alias("role"), t["head"].alias("head"), F.length(t["body"]).alias("size"), unescape(t["body"]).alias("text"))).alias("turns"))
    said = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = F.array_join(F.transform(F.filter("turns", lambda t: t["role"].isin(*learnt)), lambda t: t["text"]), "")
    return parsed.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(said.cast("binary"), 256).alias("turns_sha256"),
        F.length(loss).cast("long").alias("loss_chars"), F.sha2(loss.cast("binary"), 256).alias("loss_sha256"), "formatted_chars",
        F.transform("turns", lambda t: F.struct(t["head"].alias("head"), t["size"].alias("body"), t["role"].isin(*learnt).alias("counts"))).alias("loss_mask"),
    )
