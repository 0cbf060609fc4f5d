"""Quotation linking in DataFrame functions: messages lose their quotes and are ordered by whom they reply to.

A line's quote level is the number of ``>`` before it. Runs of lines of one level are passages; a passage, its paragraphs and
its lines are normalised (case, white space) and hashed. The first earlier message of the conversation that wrote a hash itself
is its origin. A message replies to the origin of its longest linked passage of the lowest linked level. Replies and what they
reply to form threads; a conversation is ordered by the first turn of the thread, then by turn, so a reply follows what it
answers. Messages that link nothing are threads of their own and keep the order of turns.

Result: one row per message, so a conversation of any size is never gathered. Null texts count as empty, null roles as
``unknown``; messages with a null conv_id or turn keep their text without quotes and link nothing. Equal rows are kept and share
their links; of messages with one turn none replies to another. A passage without a known origin is removed all the same and
counted. An empty table gives no rows.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from wayline.llm.common import staged
from wayline.llm.components import component_roots

MARK = r"^(?:[ \t]*>)+"
#: Lines that introduce a quote.
INTRODUCTION = r"^(?:On|Am|Le|El)\b.*(?:wrote|schrieb|écrit|escribió)\s*:\s*$"
_BREAK, _LEVEL = "\u0001", "\u0002"


def normal(text: Column) -> Column:
    return F.lower(F.trim(F.regexp_replace(text, r"\s+", " ")))


def marked_lines(text: Column) -> Column:
    """array<struct<level, body>> of the text's lines."""
    lines = F.split(F.translate(text, "\r" + _BREAK + _LEVEL, ""), "\n")

    def one(line: Column) -> Column:
        level = F.length(F.regexp_replace(F.regexp_extract(line, MARK, 0), "[^>]", ""))
        return F.struct(level.alias("level"), F.trim(F.regexp_replace(line, MARK, "")).alias("body"))

    return F.transform(lines, one)


def _joined(lines: Column, paragraphs: bool) -> Column:
    """Runs of lines of one level (up to a blank line with ``paragraphs``) as array<struct<level, body>>."""
    def piece(line: Column, i: Column) -> Column:
        last = F.get(lines, i - 1)
        new = (i == 0) | (last["level"] != line["level"])
        if paragraphs:
            new = new | (last["body"] == "")
        return F.concat(F.when(new, F.concat(F.lit(_BREAK), line["level"].cast("string"), F.lit(_LEVEL))).otherwise(F.lit(" ")), line["body"])

    runs = F.split(F.array_join(F.transform(lines, piece), ""), _BREAK)
    return F.transform(runs, lambda r: F.struct(F.substring_index(r, _LEVEL, 1).try_cast("int").alias("level"), F.substring_index(r, _LEVEL, -1).alias("body")))


def units(lines: Column) -> Column:
    """Hashes of passages, paragraphs and lines: array<struct<level, size, hash>>."""
    every = F.concat(_joined(lines, False), _joined(lines, True), lines)
    normalised = F.transform(every, lambda u: F.struct(u["level"].alias("level"), normal(u["body"]).alias("body")))
    solid = F.filter(normalised, lambda u: u["level"].isNotNull() & (u["body"] != ""))
    return F.array_distinct(F.transform(solid, lambda u: F.struct(u["level"].alias("level"), F.length(u["body"]).alias("size"), F.md5(u["body"]).alias("hash"))))


def without_quotes(lines: Column) -> Column:
    """Own lines, without those that introduce a quote."""
    def own(line: Column, i: Column) -> Column:
        follows = F.coalesce(F.get(lines, i + 1)["level"], F.lit(0))
        introduces = line["body"].rlike(INTRODUCTION) & (follows > 0)
        return F.when((line["level"] > 0) | introduces, F.lit(None)).otherwise(line["body"])

    return F.trim(F.regexp_replace(F.array_join(F.transform(lines, own), "\n"), r"^\s+|\s+$", ""))


def messages(conversations: DataFrame) -> DataFrame:
    """(conv_id, turn, role, text, node, quotes): ``node`` stands for the message's content."""
    rows = conversations.select(
        F.col("conv_id").cast("bigint").alias("conv_id"), F.col("turn").cast("bigint").alias("turn"), F.coalesce(F.col("role").cast("string"), F.lit("unknown")).alias("role"),
        F.coalesce(F.col("text").cast("string"), F.lit("")).alias("text"),
    )
    return rows.withColumn("node", F.xxhash64("conv_id", "turn", "role", "text")).withColumn("quotes", F.col("text").rlike("(?m)" + MARK))


def reply_links(rows: DataFrame) -> DataFrame:
    """(node, parent, parent_turn, linked): what each quoting message replies to, and how many of its passages have an origin."""
    placed = rows.filter("conv_id IS NOT NULL AND turn IS NOT NULL")
    quoting = placed.filter("quotes")
    talks = quoting.select("conv_id").distinct()
    written = placed.join(talks, "conv_id", "left_semi").select("conv_id", "turn", "node", F.explode(units(marked_lines(F.col("text")))).alias("u")).filter("u.level = 0")
    origins = written.groupBy("conv_id", F.col("u.hash").alias("hash")).agg(F.min(F.struct("turn", "node")).alias("origin"))
    quoted = quoting.select("conv_id", "turn", "node", F.explode(units(marked_lines(F.col("text")))).alias("u")).filter("u.level > 0")
    found = quoted.select("conv_id", "turn", "node", "u.level", "u.size", F.col("u.hash").alias("hash")).join(origins, ["conv_id", "hash"]).filter("origin.turn < turn")
    best = F.max(F.struct((-F.col("level")).alias("level"), F.col("size"), F.col("origin.turn").alias("turn"), F.col("origin.node").alias("node")))
    return found.groupBy("node").agg(best.alias("b"), F.countDistinct("hash").alias("linked")).select("node", F.col("b.node").alias("parent"), F.col("b.turn").alias("parent_turn"), "linked")


def reply_ordered(conversations: DataFrame) -> DataFrame:
    """One row per message: (conv_id, thread_turn, turn, role, content, reply_to, n_quotes, quote_levels, n_linked).

    Ordered by (conv_id, thread_turn, turn, role, content) the rows read as the conversation without quotes.
    """
    rows = messages(conversations)
    links = staged(reply_links(rows))
    roots = component_roots(links.select(F.col("node").alias("a"), F.col("parent").alias("b")))
    turns = links.select("node", F.col("parent_turn").alias("turn")).union(rows.join(links.select("node"), "node", "left_semi").select("node", "turn"))
    threads = roots.join(turns.groupBy("node").agg(F.min("turn").alias("turn")), "node").groupBy("root").agg(F.min("turn").alias("thread_turn"))
    place = roots.join(threads, "root").select("node", "thread_turn")
    known = place.join(links, "node", "left")
    lines = marked_lines(F.col("text"))
    passages = F.filter(_joined(lines, False), lambda r: (r["level"] > 0) & (F.trim(r["body"]) != ""))
    done = rows.select(
        "conv_id", "turn", "role", "node",
        F.when(F.col("quotes"), without_quotes(lines)).otherwise(F.regexp_replace("text", r"^\s+|\s+$", "")).alias("content"),
        F.when(F.col("quotes"), F.size(passages)).otherwise(F.lit(0)).alias("n_quotes"),
        F.when(F.col("quotes"), F.array_max(F.transform(lines, lambda m: m["level"]))).otherwise(F.lit(0)).alias("quote_levels"),
    )
    return done.join(known, "node", "left").select(
        "conv_id", F.coalesce("thread_turn", "turn").alias("thread_turn"), "turn", "role", "content", F.col("parent_turn").alias("reply_to"),
        F.col("n_quotes").cast("bigint").alias("n_quotes"), F.col("quote_levels").cast("bigint").alias("quote_levels"), F.coalesce("linked", F.lit(0)).cast("bigint").alias("n_linked"),
    )


def chat_line(role: Column, content: Column) -> Column:
    """A message in chat markup."""
    return F.concat(F.lit("<|"), role, F.lit("|>\n"), content, F.lit("\n<|end|>"))
