"""Chat formatting with a grammar round trip, in built-in functions only.

The template, one entry per turn::

    ### <role><mark>: <body></turn>\\n

``<role>`` is the role in URL encoding. ``<mark>`` is empty when the body is the text itself, ``~`` when
it is escaped. The parser cuts at ``</turn>\\n``, matches each piece against the turn rule from
its first to its last character, and turns down a body that holds a control string. A text whose plain
form does not come back identical is escaped: a backslash goes before each backslash, before the ``#`` of
each ``###`` and before the ``/`` of each ``</turn>``. A body so escaped holds no control string, and
taking each backslash off the character behind it gives the text back.
"""

from pyspark.sql import Column, DataFrame, functions as F

OPEN, CLOSE, END = "###", "</turn>", "</turn>\n"
TURN = r"(?s)^### ([A-Za-z0-9.*_%+\-]*)(~?): (.*)$"


def escape(text: Column) -> Column:
    text = F.replace(text, F.lit("\\"), F.lit("\\\\"))
    text = F.replace(text, F.lit(OPEN), F.lit("\\#\\#\\#"))
    return F.replace(text, F.lit(CLOSE), F.lit("<\\/turn>"))


def unescape(body: Column) -> Column:
    return F.regexp_replace(body, r"(?s)\\(.)", "$1")


def render(role: Column, text: Column, escaped: bool) -> Column:
    body = escape(text) if escaped else text
    return F.concat(F.lit(OPEN + " "), F.url_encode(role), F.lit("~: " if escaped else ": "), body, F.lit(END))


def parse_piece(piece: Column) -> Column:
    """``(role, text, masked, n_body)`` of one turn without its end; null where the grammar turns it down.

    ``masked`` says that the loss reads the turn, ``n_body`` counts the characters of its body as written.
    """
    body = F.regexp_extract(piece, TURN, 3)
    role = F.url_decode(F.regexp_extract(piece, TURN, 1))
    text = F.when(F.regexp_extract(piece, TURN, 2) == "~", unescape(body)).otherwise(body)
    good = piece.rlike(TURN) & ~F.contains(body, F.lit(OPEN)) & ~F.contains(body, F.lit(CLOSE))
    return F.when(good, F.struct(role.alias("role"), text.alias("text"), (role == "assistant").alias("masked"),
                                 F.length(body).cast("long").alias("n_body")))


def parse(formatted: Column) -> Column:
    """The turns of a formatted conversation, in order; the parser reads nothing but the string."""
    pieces = F.split(formatted, "</turn>\n", -1)
    return F.transform(F.slice(pieces, 1, F.greatest(F.size(pieces) - 1, F.lit(0))), parse_piece)


def format_turns(rows: DataFrame) -> DataFrame:
    """``rendered`` for each row of ``role, text``: the plain form if it parses back identical, else the escaped."""
    plain = render(F.col("role"), F.col("text"), False)
    back = parse(plain)
    same = F.coalesce((F.size(back) == 1) & (back[0]["role"] == F.col("role")) & (back[0]["text"] == F.col("text")),
                      F.lit(False))
    return rows.withColumn("rendered", F.when(same, plain).otherwise(render(F.col("role"), F.col("text"), True)))


def format_chats(conversations: DataFrame) -> DataFrame:
    """``conv_id, formatted, source_turns`` of every conversation; ``source_turns`` counts its rows.

    Rows are ordered by turn (null last), then role, then text, so ties and repeated rows have one defined
    order and all stay. Null roles and texts read as empty; a null ``conv_id`` is a conversation of its own;
    an empty table gives no rows; other columns are ignored. A conversation is one string, so its rows meet
    in one row by definition; each row is rendered and checked before they do.
    """
    rows = format_turns(conversations.select(
        "conv_id", "turn", F.coalesce("role", F.lit("")).alias("role"), F.coalesce("text", F.lit("")).alias("text")))
    item = F.struct(F.col("turn").isNull().alias("last"), "turn", "role", "text", "rendered")
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list(item)).alias("_turns"))
    formatted = F.array_join(F.transform("_turns", lambda t: t["rendered"]), "")
    return chats.select("conv_id", formatted.alias("formatted"), F.size("_turns").cast("long").alias("source_turns"))


def read_back(chats: DataFrame) -> DataFrame:
    """What the formatted strings say: turns, loss text and mask, all parsed from ``formatted`` alone.

    ``mask`` has one entry per turn: the length of its body as written and whether the loss reads it. All
    characters outside the bodies are outside the mask.
    """
    turns = chats.withColumn("_turns", parse(F.col("formatted")))
    loss = F.filter("_turns", lambda t: t["masked"])
    return turns.select(
        "conv_id", "formatted", F.size("_turns").cast("long").alias("n_turns"),
        F.array_join(F.transform("_turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n"))), "")
        .alias("turns_text"),
        F.array_join(F.transform(loss, lambda t: t["text"]), "").alias("loss_text"),
        F.transform("_turns", lambda t: F.struct(t["masked"].alias("read"), t["n_body"].alias("n_chars"))).alias("mask"),
        F.length("formatted").cast("long").alias("formatted_chars"))


def digest(read: DataFrame) -> DataFrame:
    return read.select(
        "conv_id", "n_turns", F.sha2("turns_text", 256).alias("turns_sha256"),
        F.length("loss_text").cast("long").alias("loss_chars"), F.sha2("loss_text", 256).alias("loss_sha256"),
        "formatted_chars")
