r"""Chat formatting with a grammar round trip, in DataFrame operations only.

The template of a turn is "### <Role>: <text> </turn>" and a line feed. A deterministic parser (split at the
end mark, then take the role up to its mark) reads the formatted conversation back. Turns that hold control
strings are escaped; if what is read back differs from the source, all turns are, roles included, and what
is read back is compared again (an error if it differs): an escaped turn is marked by "!" for ":", and its backslash, "#" and "<" are written
\b, \h and \l, so neither mark can occur inside.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Fixed values of the template.
OPEN, PLAIN, ESCAPED, CLOSE = "### ", ": ", "! ", " </turn>\n"
TRAINED_ROLE = "assistant"
_ROLE_AND_TEXT = r"(?s)^### ([^:!\n]*)([:!]) (.*)$"


def escape(text: Column) -> Column:
    for plain, code in (("\\", "\\b"), ("#", "\\h"), ("<", "\\l")):
        text = F.replace(text, F.lit(plain), F.lit(code))
    return text


def unescape(text: Column) -> Column:
    for code, plain in (("\\h", "#"), ("\\l", "<"), ("\\b", "\\")):
        text = F.replace(text, F.lit(code), F.lit(plain))
    return text


def _escape_role(role: Column) -> Column:
    for plain, code in ((":", "\\c"), ("!", "\\x"), ("\n", "\\n")):
        role = F.replace(escape(role) if plain == ":" else role, F.lit(plain), F.lit(code))
    return role


def _unescape_role(role: Column) -> Column:
    for code, plain in (("\\c", ":"), ("\\x", "!"), ("\\n", "\n")):
        role = F.replace(role, F.lit(code), F.lit(plain))
    return unescape(role)


def render_turn(role: Column, text: Column, escaped: Column) -> Column:
    plain = F.concat(F.lit(OPEN), role, F.lit(PLAIN), text, F.lit(CLOSE))
    safe = F.concat(F.lit(OPEN), _escape_role(role), F.lit(ESCAPED), escape(text), F.lit(CLOSE))
    return F.when(escaped, safe).otherwise(plain)


def conflicts(role: Column, text: Column) -> Column:
    """Whether a turn holds what the template uses."""
    return F.contains(text, F.lit("</turn>")) | F.contains(text, F.lit("###")) | role.rlike("[:!\n#<\\\\]")


def pieces(formatted: Column) -> Column:
    """The formatted turns, without their end marks."""
    parts = F.split(formatted, " </turn>\n", -1)
    return F.slice(parts, 1, F.greatest(F.size(parts) - 1, F.lit(0)))


def parse_piece(piece: Column) -> Column:
    """struct(role, text, escaped, at): at is the offset of the text in the piece; nulls where it is no turn."""
    mark = F.regexp_extract(piece, _ROLE_AND_TEXT, 2)
    role, body, safe = F.regexp_extract(piece, _ROLE_AND_TEXT, 1), F.regexp_extract(piece, _ROLE_AND_TEXT, 3), mark == "!"
    ok = mark != ""
    return F.when(ok, F.struct(F.when(safe, _unescape_role(role)).otherwise(role).alias("role"), F.when(safe, unescape(body)).otherwise(body).alias("text"), safe.alias("escaped"), (F.length(role) + len(OPEN) + len(PLAIN)).alias("at")))


def _reads_back(formatted: Column, turns: Column) -> Column:
    got = F.transform(pieces(formatted), lambda p: F.struct(parse_piece(p)["role"].alias("role"), parse_piece(p)["text"].alias("text")))
    return F.coalesce(got == F.transform(turns, lambda t: F.struct(t["role"].alias("role"), t["text"].alias("text"))), F.lit(False))


def format_conversations(rows: DataFrame, conv_id: str = "conv_id", turn: str = "turn", role: str = "role", text: str = "text", trained_role: str = TRAINED_ROLE) -> DataFrame:
    """One row for each conversation, none for an empty table: conv_id, n_turns, formatted, level (0: nothing to escape, 1: conflicting turns escaped, 2: all), and
    turns array<struct<role, text, start, length>> as read back, with each text's place in formatted, and
    loss_mask array<struct<start, length>>, the places of the trained role's texts in order.

    Rows go by turn, null turns first, ties by role and text; null roles and texts count as empty; a null
    conv_id is a conversation of its own. A row that occurs twice is two turns. Other columns are not looked at.
    One shuffle, by conversation: a conversation is one text and has to fit a task.
    """
    source = rows.select(F.col(conv_id).alias("conv_id"), F.col(turn).alias("turn"), F.coalesce(F.col(role), F.lit("")).alias("role"), F.coalesce(F.col(text), F.lit("")).alias("text"))
    turns = F.array_sort(F.collect_list(F.struct("turn", "role", "text")))
    convs = source.groupBy("conv_id").agg(turns.alias("turns"))

    def rendered(escaped) -> Column:
        return F.array_join(F.transform(F.col("turns"), lambda t: render_turn(t["role"], t["text"], escaped(t))), "")

    some = convs.withColumn("some", rendered(lambda t: conflicts(t["role"], t["text"]))).withColumn("any", F.exists("turns", lambda t: conflicts(t["role"], t["text"])))
    convs = some.withColumn("level", F.when(_reads_back(F.col("some"), F.col("turns")), F.col("any").cast("int")).otherwise(2))
    whole = rendered(lambda t: F.lit(True))
    safe = F.when(_reads_back(whole, F.col("turns")), whole).otherwise(F.raise_error(F.concat(F.lit("no form of this conversation reads back: "), F.coalesce(F.col("conv_id").cast("string"), F.lit("null")))))
    convs = convs.withColumn("formatted", F.when(F.col("level") < 2, F.col("some")).otherwise(safe))
    read = convs.select("conv_id", "level", "formatted", F.transform(pieces(F.col("formatted")), lambda p: F.struct(F.length(p).alias("size"), parse_piece(p).alias("turn"))).alias("read"))
    # offsets: running sum of the pieces' lengths
    step = F.aggregate(
        "read",
        F.struct(F.lit(0).alias("upto"), F.array().cast("array<int>").alias("starts")),
        lambda acc, p: F.struct((acc["upto"] + p["size"] + F.lit(len(CLOSE))).alias("upto"), F.array_append(acc["starts"], acc["upto"]).alias("starts")),
    )
    read = read.withColumn("starts", step["starts"])
    placed = F.zip_with(
        "read",
        "starts",
        lambda p, at: F.struct(p["turn"]["role"].alias("role"), p["turn"]["text"].alias("text"), p["turn"]["escaped"].alias("escaped"), (at + p["turn"]["at"]).alias("start"), (p["size"] - p["turn"]["at"]).alias("length")),
    )
    read = read.select("conv_id", "level", "formatted", placed.alias("turns"))
    mask = F.transform(F.filter("turns", lambda t: t["role"] == trained_role), lambda t: F.struct(t["start"], t["length"], t["escaped"]))
    return read.select("conv_id", F.size("turns").cast("long").alias("n_turns"), "formatted", "level", "turns", mask.alias("loss_mask"))


def masked_text(formatted: Column, loss_mask: Column) -> Column:
    """What the mask covers, unescaped, nothing between."""
    def under(m: Column) -> Column:
        raw = F.substr(formatted, m["start"] + F.lit(1), m["length"])
        return F.when(m["escaped"], unescape(raw)).otherwise(raw)

    return F.array_join(F.transform(loss_mask, under), "")


def digest(formatted: DataFrame) -> DataFrame:
    """The digest columns of format_conversations()'s rows."""
    whole = F.array_join(F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
    loss = masked_text(F.col("formatted"), F.col("loss_mask"))
    out = formatted.select("conv_id", "n_turns", F.sha2(whole.cast("binary"), 256).alias("turns_sha256"), loss.alias("loss"), F.length("formatted").cast("long").alias("formatted_chars"))
    return out.select("conv_id", "n_turns", "turns_sha256", F.length("loss").cast("long").alias("loss_chars"), F.sha2(F.col("loss").cast("binary"), 256).alias("loss_sha256"), "formatted_chars")
