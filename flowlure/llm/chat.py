"""Chat formatting with typed content parts (operator 1).

A message's content is an ordered array of parts. One visitor expression renders each part:
text is escaped, an image, audio or document part becomes a numbered placeholder; its
reference is recorded as an attachment with the number of tokens that it expands to. The
template marks turns with control strings; escaping breaks up control strings inside texts
and is undone exactly on reading. Everything is DataFrame functions on Spark's JVM side.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Control strings of the template.
TURN, BODY, END = "<|turn|>", "<|body|>", "<|end|>"
#: Tokens that a part without a count of its own expands to.
DEFAULT_TOKENS = {"image": 576, "audio": 1500, "document": 1024}
PART = "struct<type: string, text: string, ref: string, tokens: int>"


def escape(text: Column) -> Column:
    """Text that holds no control string, nor begins one that the next part could end.

    A backslash is doubled. Backslash and tilde, which stand for nothing, go in after a
    ``<`` before ``|``, ``/``, ``s`` or the end, and after a ``[`` before ``/``, ``I`` or the end.
    """
    doubled = F.regexp_replace(text, r"\\", r"\\\\")
    return F.regexp_replace(doubled, r"<(?=[|/s]|\z)|\[(?=[/I]|\z)", r"$0\\~")


def unescape(text: Column) -> Column:
    return F.regexp_replace(text, r"\\(\\)|\\~", "$1")


def text_part(text: Column) -> Column:
    """A message of one text part."""
    empty = F.lit(None)
    return F.array(F.struct(F.lit("text").alias("type"), F.coalesce(text, F.lit("")).alias("text"), empty.cast("string").alias("ref"), empty.cast("int").alias("tokens")))


def _kind(part: Column) -> Column:
    return F.coalesce(part["type"], F.lit("text"))


def _is_text(part: Column) -> Column:
    return ~_kind(part).isin(*DEFAULT_TOKENS)


def _visit(part: Column, place: Column) -> Column:
    """Rendered form of one part; ``place`` is its number among the message's parts."""
    return F.when(_is_text(part), escape(F.coalesce(part["text"], F.lit("")))).otherwise(F.concat(F.lit("<|"), _kind(part), F.lit(":"), place.cast("string"), F.lit("|>")))


def _expanded(part: Column) -> Column:
    default = F.lit(0)
    for kind, tokens in DEFAULT_TOKENS.items():
        default = F.when(_kind(part) == kind, tokens).otherwise(default)
    return F.when(_is_text(part), 0).otherwise(F.greatest(F.coalesce(part["tokens"], default), F.lit(0))).cast("long")


def format_conversations(messages: DataFrame, loss_roles: tuple[str, ...] = ("assistant",)) -> DataFrame:
    """One row per conversation: formatted, loss_spans, attachments, expanded_tokens.

    ``messages`` has conv_id, turn, role and content (array of PART); other columns are not
    read. Turns go in order of turn, then role, then content, NULLs first, so repeated turns
    all stay, in a defined order. A NULL role or text counts as empty, NULL content as no
    parts, an unknown part type as text. ``loss_spans``: per turn its start and length, in
    code points of ``formatted``, under the loss mask (length 0 for other roles).
    ``attachments``: (turn number, part number, type, ref, tokens) of every other part.
    A conversation's text is one value of the result, and so of one row; nothing else of a
    conversation is gathered. An empty table gives no rows.
    """
    parts = F.coalesce(F.col("content"), F.array().cast(f"array<{PART}>"))
    turns = messages.select(
        "conv_id", "turn", F.coalesce(F.col("role"), F.lit("")).alias("role"), parts.alias("parts")
    ).select(
        "conv_id", "turn", "role", F.to_json("parts").alias("tie"),
        F.array_join(F.transform("parts", _visit), "").alias("body"),
        F.filter(F.transform("parts", lambda p, i: F.struct(i.alias("part"), p["type"].alias("type"), p["ref"].alias("ref"), _expanded(p).alias("tokens"), _is_text(p).alias("plain"))), lambda x: ~x["plain"]).alias("others"),
    )
    head = F.concat(F.lit(TURN), escape(F.col("role")), F.lit(BODY))
    in_order = Window.partitionBy("conv_id").orderBy("turn", "role", "tie")
    placed = turns.select(
        "conv_id", F.concat(head, "body", F.lit(END)).alias("piece"), "others",
        F.row_number().over(in_order).alias("place"),
        F.length(head).alias("lead"), F.when(F.col("role").isin(*loss_roles), F.length("body")).otherwise(0).alias("loss"),
        (F.sum(F.length(head) + F.length("body") + len(END)).over(in_order.rowsBetween(Window.unboundedPreceding, 0)) - F.length(head) - F.length("body") - len(END)).alias("before"),
    )
    # Grouped as the window is: no second shuffle.
    rows = placed.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("place", "piece", "before", "lead", "loss", "others"))).alias("rows"))
    return rows.select(
        "conv_id",
        F.array_join(F.transform("rows", lambda r: r["piece"]), "").alias("formatted"),
        F.transform("rows", lambda r: F.struct((r["before"] + r["lead"]).alias("start"), r["loss"].cast("long").alias("length"))).alias("loss_spans"),
        F.flatten(F.transform("rows", lambda r: F.transform(r["others"], lambda o: F.struct(r["place"].alias("turn"), o["part"].alias("part"), o["type"].alias("type"), o["ref"].alias("ref"), o["tokens"].alias("tokens"))))).alias("attachments"),
    ).withColumn("expanded_tokens", F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]))


def read_back(formatted: DataFrame) -> DataFrame:
    """Turns read from the output: ``turns``, array of (role, text) unescaped, and ``loss_texts``, the masked text per turn.

    A turn's masked text is cut from its own piece of the output by the span's place in it.
    """
    pieces = F.slice(F.split("formatted", r"<\|turn\|>", -1), 2, 2**31 - 1)
    ends = formatted.withColumn("pieces", pieces)
    turns = F.transform("pieces", lambda p: F.struct(
        unescape(F.substring_index(p, BODY, 1)).alias("role"),
        unescape(F.substring_index(F.substring_index(p, END, 1), BODY, -1)).alias("text")))
    # A span starts as far into its piece as its turn's head is long.
    cut = F.zip_with("pieces", "loss_spans", lambda p, s: F.when(s["length"] > 0, unescape(F.substr(p, F.length(F.substring_index(p, BODY, 1)) + len(BODY) + 1, s["length"].cast("int")))).otherwise(""))
    return ends.withColumns({"turns": turns, "loss_texts": cut}).drop("pieces")


def digest(formatted: DataFrame) -> DataFrame:
    """conv_id, n_turns, turns_sha256, loss_chars, loss_sha256 and formatted_chars, read back from the output."""
    read = read_back(formatted)
    told = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    lost = F.array_join("loss_texts", "")
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.encode(told, "utf-8"), 256).alias("turns_sha256"),
        F.length(lost).cast("long").alias("loss_chars"), F.sha2(F.encode(lost, "utf-8"), 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )
