"""Chat formatting with typed content parts.

``format_chats`` takes message rows (conv_id, turn, role, parts), where parts is
an array of typed parts, and returns one formatted string per conversation. A
visitor over the parts flattens text in place and every image, audio or
document part into a numbered placeholder, and records the reference and the
tokens that it will expand to. ``read_back`` parses the string again.

Template: each turn is ``<turn>role\\ntext</turn>``. Inside roles and texts ``&``
and ``<`` are written as ``&amp;`` and ``&lt;``, so no text can hold a control
string or placeholder, and undoing the two replacements gives the text back. A
newline in a role is written as ``&nl;``, ``>`` in a part's type as ``&gt;``.

Only DataFrame functions are used. A conversation becomes one string, so its
turns meet in one task; nothing else does.

Edge cases. Null texts and roles are empty, null parts are skipped, a null list
of parts is an empty turn. Turns are ordered by turn (null first), ties by role,
then by content; repeated rows are kept. A null conv_id is a conversation of its
own. Unknown part types are treated as documents without pages.
"""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .columns import cells, let, piece, running

PART = "struct<type: string, text: string, uri: string, width: int, height: int, seconds: double, pages: int>"
#: Tokens that a part expands to: an image by patches, audio by time, a document by pages.
PATCH, TOKENS_PER_SECOND, TOKENS_PER_PAGE, LOSS_ROLE = 28, 25.0, 512, "assistant"
END = len("</turn>")


def escape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&"), F.lit("&amp;")), F.lit("<"), F.lit("&lt;"))


def unescape(text: Column) -> Column:
    return F.replace(F.replace(text, F.lit("&lt;"), F.lit("<")), F.lit("&amp;"), F.lit("&"))


def text_parts(text: Column) -> Column:
    """A list of one text part."""
    names = ("uri", "width", "height", "seconds", "pages")
    return F.array(F.struct(F.lit("text").alias("type"), text.alias("text"), *(F.lit(None).alias(n) for n in names))).cast(f"array<{PART}>")


def _expanded(part: Column, patch: int, per_second: float, per_page: int) -> Column:
    side = lambda c: F.ceil(F.coalesce(part[c], F.lit(0)) / F.lit(patch))
    return (
        F.when(part["type"] == "image", side("width") * side("height"))
        .when(part["type"] == "audio", F.ceil(F.coalesce(part["seconds"], F.lit(0.0)) * F.lit(per_second)))
        .otherwise(F.coalesce(part["pages"], F.lit(0)) * F.lit(per_page)).cast("long")
    )


def format_chats(messages: DataFrame, loss_role: str = LOSS_ROLE, patch: int = PATCH, per_second: float = TOKENS_PER_SECOND, per_page: int = TOKENS_PER_PAGE) -> DataFrame:
    """conv_id, n_turns, formatted, attachments (turn index, number, type, uri, tokens) and attachment_tokens."""
    live = F.filter(F.coalesce("parts", F.expr(f"cast(array() AS array<{PART}>)")), lambda p: p.isNotNull())
    rows = messages.select("conv_id", F.struct(F.col("turn"), F.coalesce("role", F.lit("")).alias("role"), live.alias("parts")).alias("m"))
    chats = rows.groupBy("conv_id").agg(F.array_sort(F.collect_list("m")).alias("turns"))
    is_text = lambda p: F.coalesce(p["type"], F.lit("text")) == "text"
    media = F.flatten(F.transform("turns", lambda m, i: F.transform(F.filter(m["parts"], lambda p: ~is_text(p)), lambda p: F.struct(i.cast("long").alias("turn"), p.alias("part")))))
    chats = chats.withColumn("media", media)
    chats = chats.withColumn("attachments", F.transform("media", lambda x, i: F.struct(x["turn"].alias("turn"), (i + 1).cast("long").alias("number"), x["part"]["type"].alias("type"), x["part"]["uri"].alias("uri"), _expanded(x["part"], patch, per_second, per_page).alias("tokens"))))
    # the placeholder of a part is its number among all parts of the conversation that aren't text: running counts of parts
    counts = running(F.transform(F.flatten(F.transform("turns", lambda m: m["parts"])), lambda p: F.when(is_text(p), 0).otherwise(1)), lambda a, b: a + b)
    parts_so_far = running(F.transform("turns", lambda m: F.size(m["parts"])), lambda a, b: a + b)
    chats = chats.withColumns({"numbers": counts, "so_far": parts_so_far})
    number = lambda m, i, j: F.get("numbers", F.get("so_far", i) - F.size(m["parts"]) + j)
    shown = lambda p, n: F.concat(F.lit("<"), _escape_type(p["type"]), F.lit(" "), n.cast("string"), F.lit(">"))
    flat = lambda m, i: F.array_join(F.transform(m["parts"], lambda p, j: F.when(is_text(p), escape(F.coalesce(p["text"], F.lit("")))).otherwise(shown(p, number(m, i, j)))), "")
    role = lambda m: F.replace(escape(m["role"]), F.lit("\n"), F.lit("&nl;"))
    text = F.array_join(F.transform("turns", lambda m, i: F.concat(F.lit("<turn>"), role(m), F.lit("\n"), flat(m, i), F.lit("</turn>"))), "")
    return chats.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), text.alias("formatted"), "attachments",
        F.aggregate("attachments", F.lit(0).cast("long"), lambda a, x: a + x["tokens"]).alias("attachment_tokens"),
        F.lit(loss_role).alias("loss_role"),
    )


def _escape_type(kind: Column) -> Column:
    return F.replace(escape(kind), F.lit(">"), F.lit("&gt;"))


def read_back(formatted: DataFrame) -> DataFrame:
    """Adds turns (role, text, parts, loss_start, loss_length), read from the formatted string alone.

    ``parts`` are (type, text, number): runs of text, unescaped, and placeholders, which no text can be taken for; ``text`` is
    both in one string. The loss mask is in code points of the formatted string: it covers the escaped text of the loss
    role's turns, and other turns have an empty span at their text's start.
    """
    role = lambda p: unescape(F.replace(F.substring_index(F.substr(p, F.lit(7)), "\n", 1), F.lit("&nl;"), F.lit("\n")))
    body = lambda p: F.substr(p, F.instr(p, "\n") + 1)

    def part(x: Column) -> Column:
        number = F.regexp_extract(x, " ([0-9]+)>$", 1).try_cast("long")
        kind = unescape(F.replace(F.substr(x, F.lit(2), F.length(x) - F.length(F.substring_index(x, " ", -1)) - 2), F.lit("&gt;"), F.lit(">")))
        return F.when(F.startswith(x, F.lit("<")), F.struct(kind.alias("type"), F.lit(None).cast("string").alias("text"), number.alias("number"))).otherwise(
            F.struct(F.lit("text").alias("type"), unescape(x).alias("text"), F.lit(None).cast("long").alias("number"))
        )

    def turns(pieces: Column) -> Column:
        ends = running(F.transform(pieces, lambda p: F.length(p) + END), lambda a, b: a + b)
        parts = lambda p: F.transform(F.regexp_extract_all(body(p), F.lit("<[^>]*+>|[^<]++"), F.lit(0)), part)
        start = lambda p, e, i: F.get(e, i) - END - F.length(body(p))
        kept = lambda p: F.when(role(p) == F.col("loss_role"), F.length(body(p))).otherwise(0)
        return let(ends, lambda e: F.transform(pieces, lambda p, i: F.struct(role(p).alias("role"), unescape(body(p)).alias("text"), parts(p).alias("parts"), start(p, e, i).cast("long").alias("loss_start"), kept(p).cast("long").alias("loss_length"))))

    pieces = F.split("formatted", "</turn>")
    return formatted.withColumn("turns", let(pieces, lambda x: turns(F.slice(x, F.lit(1), F.size(x) - 1))))


def loss_text(formatted: Column, turns: Column) -> Column:
    """What the loss mask covers of the formatted string, unescaped, in order and with nothing between."""
    cut = lambda own: F.array_join(F.transform(turns, lambda t: unescape(piece(own, t["loss_start"], t["loss_start"] + t["loss_length"]))), "")
    return let(cells(formatted), cut)


def digest(read: DataFrame) -> DataFrame:
    """What the contract asks for, from ``read_back``."""
    said = F.transform("turns", lambda t: F.concat(t["role"], F.lit("\n"), t["text"], F.lit("\n")))
    read = read.withColumn("loss", loss_text(F.col("formatted"), F.col("turns")))
    return read.select(
        "conv_id", F.size("turns").cast("long").alias("n_turns"), F.sha2(F.array_join(said, ""), 256).alias("turns_sha256"),
        F.length("loss").cast("long").alias("loss_chars"), F.sha2("loss", 256).alias("loss_sha256"),
        F.length("formatted").cast("long").alias("formatted_chars"),
    )


SQL = """
WITH m AS (
  SELECT conv_id, turn, coalesce(role, '') AS role, coalesce(text, '') AS text FROM conversations
  UNION ALL SELECT -7, 0, 'user', '### Assistant: </turn> ok'
  UNION ALL SELECT -7, 1, 'assistant', '### Assistant: </turn> ok'
), e AS (
  SELECT *, replace(replace(role, '&', '&amp;'), '<', '&lt;') AS r, replace(replace(text, '&', '&amp;'), '<', '&lt;') AS t FROM m
)
SELECT conv_id, count(*) AS n_turns,
       sha256(string_agg(role || chr(10) || text || chr(10), '' ORDER BY turn NULLS FIRST, role, text)) AS turns_sha256,
       CAST(sum(CASE WHEN role = 'assistant' THEN length(text) ELSE 0 END) AS BIGINT) AS loss_chars,
       sha256(coalesce(string_agg(text, '' ORDER BY turn NULLS FIRST, role, text) FILTER (WHERE role = 'assistant'), '')) AS loss_sha256,
       CAST(sum(length(replace(r, chr(10), '&nl;')) + 1 + length(t) + 13) AS BIGINT) AS formatted_chars
FROM e GROUP BY conv_id
"""
