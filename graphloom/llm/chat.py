"""Chat formatting: turns to one string with a loss mask, and back, in Spark expressions only.

A conversation becomes blocks, one for each maximal run of turns of one role:

    <turn ROLE>\\nTEXT<+>TEXT...</turn>\\n

Inside roles and texts a backslash becomes two and < becomes \\l, and inside
roles > becomes \\g, so no control string can occur in either and the formatted
string can be read back exactly. <+> keeps merged turns apart. The loss mask is
the texts of the loss role's turns, as spans of the formatted string in code
points and in bytes (which a reader cuts out without walking the string).

Edge cases: null texts and roles count as empty; rows with equal turn numbers
are ordered by role and text; repeated rows are turns of their own; rows with a
null conversation id form one conversation; an empty table gives no rows; other
columns, whatever their names, are ignored. A conversation is the unit of work:
its string has to exist as one value, so its turns meet in one task.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from graphloom.functions.arrays import prefix_sums

#: The template's control strings.
OPEN, NAMED, MERGED, CLOSE = "<turn ", ">\n", "<+>", "</turn>\n"


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("\\"), F.lit("\\\\")), F.lit("<"), F.lit("\\l"))


def escape_role(role: Column) -> Column:
    return F.replace(escape(role), F.lit(">"), F.lit("\\g"))


def unescape(text: Column) -> Column:
    """Splits at doubled backslashes first: a backslash that is left begins \\l or \\g."""
    parts = F.split(text, r"\\\\", -1)
    return F.array_join(F.transform(parts, lambda p: F.replace(F.replace(p, F.lit("\\l"), F.lit("<")), F.lit("\\g"), F.lit(">"))), "\\")


def format_conversations(turns: DataFrame, loss_role: str = "assistant") -> DataFrame:
    """(conv_id, turn, role, text) -> (conv_id, formatted, loss_spans).

    Turns are collected as structs and sorted; adjacent ones of one role are
    merged by aggregating over the sorted array. loss_spans: array of (start,
    length, byte_start, byte_length), one for each turn of the loss role.
    """
    own = F.struct(
        F.col("turn").alias("turn"),
        F.coalesce(F.col("role"), F.lit("")).alias("role"),
        F.coalesce(F.col("text"), F.lit("")).alias("text"),
    )
    made = turns.groupBy("conv_id").agg(F.sort_array(F.collect_list(own)).alias("turns"))
    # each turn opens a block unless the turn before has its role, and closes it unless the turn after has
    placed = F.transform(
        "turns",
        lambda t, i: F.struct(
            F.when((i > 0) & (F.get("turns", i - 1)["role"] == t["role"]), F.lit(MERGED)).otherwise(F.concat(F.lit(OPEN), escape_role(t["role"]), F.lit(NAMED))).alias("head"),
            escape(t["text"]).alias("body"),
            F.when(F.coalesce(F.get("turns", i + 1)["role"] == t["role"], F.lit(False)), F.lit("")).otherwise(F.lit(CLOSE)).alias("tail"),
            (t["role"] == loss_role).alias("learned"),
        ),
    )
    made = made.select("conv_id", placed.alias("parts"))
    # code points and bytes before each turn in one sum: no string has 2^31 bytes
    both = " + ".join(f"shiftleft(cast(char_length(p.{c}) AS bigint), 31) + octet_length(p.{c})" for c in ("head", "body", "tail"))
    made = made.select("conv_id", "parts", F.expr(prefix_sums(f"transform(parts, p -> {both})", kind="bigint")).alias("sums"))
    spans = F.filter(
        F.zip_with(
            "parts",
            "sums",
            lambda p, at: F.struct(
                (F.shiftright(at, 31).cast("int") + F.length(p["head"])).alias("start"),
                F.length(p["body"]).alias("length"),
                (at.bitwiseAND(F.lit((1 << 31) - 1)).cast("int") + F.octet_length(p["head"])).alias("byte_start"),
                F.octet_length(p["body"]).alias("byte_length"),
                p["learned"].alias("learned"),
            ),
        ),
        lambda s: s["learned"],
    )
    text = F.array_join(F.transform("parts", lambda p: F.concat(p["head"], p["body"], p["tail"])), "")
    return made.select("conv_id", text.alias("formatted"), F.transform(spans, lambda s: F.struct(*[s[c].alias(c) for c in ("start", "length", "byte_start", "byte_length")])).alias("loss_spans"))


def read_back(formatted: DataFrame) -> DataFrame:
    """(conv_id, formatted, loss_spans) -> the same with turns (array of role, text), parsed from the string, and loss_texts (array), cut out by the spans."""
    blocks = F.filter(F.split("formatted", CLOSE, -1), lambda b: b != "")

    def turns_of(block: Column) -> Column:
        head = F.substring_index(block, NAMED, 1)
        role = unescape(F.substring(head, F.lit(len(OPEN) + 1), F.length(head)))
        body = F.substring(block, F.length(head) + len(NAMED) + 1, F.length(block))
        return F.transform(F.split(body, r"<\+>", -1), lambda x: F.struct(role.alias("role"), unescape(x).alias("text")))

    out = formatted.withColumn("turns", F.flatten(F.transform(blocks, turns_of))).withColumn("as_bytes", F.col("formatted").cast("binary"))
    cut = F.transform("loss_spans", lambda s: unescape(F.substring("as_bytes", s["byte_start"] + 1, s["byte_length"]).cast("string")))
    return out.withColumn("loss_texts", cut).drop("as_bytes")
