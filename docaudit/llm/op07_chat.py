"""Conversations without quotes, in reply order, by quotation linking. DataFrame operations only."""

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import broadcast_if_small, cut, in_order, partitions, table

MARKS = r"^[ \t]*((?:>[ \t]*)+)"


def level(line: Column) -> Column:
    """How many quote marks a line begins with."""
    return F.length(F.regexp_replace(F.regexp_extract(line, MARKS, 1), "[^>]", ""))


def unquoted(text: Column) -> Column:
    """The lines without quote marks, without white space around them all."""
    own = F.array_join(F.filter(F.split(text, "\n"), lambda line: level(line) == 0), "\n")
    return F.when(text.rlike(r"(?m)" + MARKS), F.regexp_replace(own, r"^\s+|\s+$", "")).otherwise(text)


#: Where a text falls into sentences: after . ! or ? and at a blank line.
SENTENCE = r"\n\n+|(?<=[.!?])\s+"


def body(line: Column) -> Column:
    """The line without quote marks; white space and case set aside."""
    return F.lower(F.trim(F.regexp_replace(F.regexp_replace(line, MARKS, ""), r"\s+", " ")))


def by_unit(text: Column) -> Column:
    """An array of (kind, units): a text of clean lines as its lines, and as its sentences; blank ones left out."""
    flat = F.transform(F.split(text, SENTENCE), lambda x: F.trim(F.regexp_replace(x, r"\s+", " ")))
    units = F.filter(F.split(text, "\n"), lambda x: x != ""), F.filter(flat, lambda x: x != "")
    return F.array(*[F.struct(F.lit(kind).alias("kind"), u.alias("units")) for kind, u in zip(("line", "sentence"), units)])


def hashed(units: Column) -> Column:
    return F.sha2(F.array_join(units, "\n"), 256)


def passages(messages: DataFrame) -> DataFrame:
    """(at, conv_id, level, passage, kind, units): quoted paragraphs of one level, in each kind of units. Lines: at most a message's."""
    lines = messages.select("at", "conv_id", F.posexplode(F.split("text", "\n")).alias("pos", "line"))
    lines = lines.withColumn("level", level(F.col("line"))).withColumn("body", body(F.col("line")))
    own = Window.partitionBy("at").orderBy("pos")
    starts = (F.col("level") != F.lag("level", 1, -1).over(own)) | (F.lag("body", 1, "").over(own) == "")
    lines = lines.withColumn("passage", F.sum(starts.cast("int")).over(own)).where("body <> '' and level > 0")
    text = F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("pos", "body"))), lambda x: x["body"]), "\n")
    return lines.groupBy("at", "conv_id", "level", "passage").agg(text.alias("text")).select("at", "conv_id", "level", "passage", F.inline(by_unit(F.col("text"))))


def originals(messages: DataFrame, quoted: DataFrame) -> DataFrame:
    """(at, conv_id, kind, hash): of the messages' own units, the runs that begin like a quoted passage and are as long.

    Only the places of such runs are joined back to the texts. A passage's first unit asks for its different lengths in a
    conversation, of which Q quoted units make no more than the root of 2 Q, so frequent lines make no product."""
    text = F.array_join(F.transform(F.split("text", "\n"), lambda line: F.when(level(line) == 0, body(line)).otherwise("")), "\n")
    own = messages.select("at", "conv_id", F.inline(by_unit(text)))
    asked = quoted.groupBy(F.col("conv_id").alias("_conv"), F.col("kind").alias("_kind"), "first").agg(F.collect_set("n").alias("sizes"))
    asked = broadcast_if_small(cut(asked))
    places = own.select("at", "conv_id", "kind", F.size("units").alias("most"), F.posexplode("units").alias("pos", "unit"))
    places = places.join(asked, F.col("conv_id").eqNullSafe(F.col("_conv")) & (F.col("kind") == F.col("_kind")) & (F.sha2("unit", 256) == F.col("first")))
    places = places.select(F.col("at").alias("_at"), F.col("kind").alias("_kind"), "pos", "most", F.explode("sizes").alias("n")).where("pos + n <= most")
    places = broadcast_if_small(cut(places.groupBy("_at", "_kind").agg(F.collect_list(F.struct("pos", "n")).alias("runs"))))
    found = own.join(places, (F.col("at") == F.col("_at")) & (F.col("kind") == F.col("_kind")))
    runs = F.transform("runs", lambda x: hashed(F.slice(F.col("units"), x["pos"] + 1, x["n"])))
    return found.select("at", "conv_id", "kind", F.explode(F.array_distinct(runs)).alias("hash"))


def latest_before(rows: DataFrame, keys: list[str]) -> DataFrame:
    """rows with source: of the rows of level 0 with the same keys and a smaller `at`, the largest `at`.

    Rows are put in order of keys and `at` once, in ranges; what a key has in earlier ranges is carried over, one row a range, so
    a key that many rows share is spread over tasks."""
    dealt = rows.repartitionByRange(partitions(rows.sparkSession), *keys, "at").withColumn("_part", F.spark_partition_id())
    dealt, own = cut(dealt), F.when(F.col("level") == 0, F.col("at"))
    ends = dealt.groupBy("_part").agg(F.min(F.struct(*keys)).alias("_first"), F.max(F.struct(F.struct(*keys).alias("key"), F.coalesce(own, F.lit(-1)).alias("at"))).alias("_last"))
    ends = cut(ends)
    before = ends.select(F.col("_part").alias("_q"), F.col("_last.key").alias("_key"), F.col("_last.at").alias("_at")).where("_at >= 0")
    carried = ends.join(F.broadcast(before), F.col("_first").eqNullSafe(F.col("_key")) & (F.col("_q") < F.col("_part"))).groupBy("_part").agg(F.max("_at").alias("_carried"), F.first("_first").alias("_first"))
    earlier = Window.partitionBy("_part", *keys).orderBy("at").rangeBetween(Window.unboundedPreceding, -1)
    out = dealt.withColumn("_here", F.max(own).over(earlier)).join(F.broadcast(carried), "_part", "left")  # a row for each range
    source = F.greatest("_here", F.when(F.struct(*keys).eqNullSafe(F.col("_first")), F.col("_carried")))
    return out.withColumn("source", source).drop("_part", "_here", "_first", "_carried")


def link_quotes(conversations: DataFrame) -> DataFrame:
    """One row for each message: conv_id, position (from 0), turn, role, reply_to (position), n_quotes, n_linked, text, chat.

    A message's lines are parsed into quote levels; each passage (quoted lines of one level with no blank line or answer
    between) is joined, by normalised hashes, to the latest earlier message of the conversation whose own text holds all its
    lines, or all its sentences, in a row (blank lines and what it quotes itself set aside). So a part of a paragraph is
    linked, and so is one wrapped anew if it is of whole sentences; a part of a line that is no sentence has no link.
    n_quotes: passages; n_linked: those that have an original. The message replies to the original of its outermost linked
    quote (of several, the latest), else to the message before it; the first replies to none. Messages stand in turn order,
    in which every reply follows what it answers; `chat` is the message in chat form, without quotes.
    Null text: empty. Null role: user. Null turn: first. Null conv_id: one conversation. Repeated rows: a message each, in the
    order of role and text. Empty table: empty. Other columns: ignored. Very large conversations are never gathered."""
    rows = conversations.select("conv_id", "turn", F.coalesce("role", F.lit("user")).alias("role"), F.coalesce("text", F.lit("")).alias("text"))
    rows = in_order(rows, ["conv_id", "turn", "role", "text"])
    first = rows.groupBy(F.col("conv_id").alias("_conv")).agg(F.min("at").alias("_first"))
    quoting = cut(passages(rows.where(F.col("text").rlike(r"(?m)" + MARKS))))
    quoted = quoting.select("at", "conv_id", "level", "passage", "kind", hashed(F.col("units")).alias("hash"), F.sha2(F.col("units")[0], 256).alias("first"), F.size("units").alias("n"))
    held = originals(rows, quoted)
    names = ["conv_id", "kind", "hash", "at", "level", "passage"]
    both = quoted.select(names).union(held.withColumn("level", F.lit(0)).withColumn("passage", F.lit(0)).select(names))
    linked = latest_before(both, ["conv_id", "kind", "hash"]).where("level > 0")
    linked = linked.groupBy("at", "level", "passage").agg(F.max("source").alias("source"))
    answer = F.max(F.when(F.col("source").isNotNull(), F.struct((-F.col("level")).alias("outer"), "source"))).alias("answer")
    linked = linked.groupBy(F.col("at").alias("_at")).agg(F.count("*").alias("n_quotes"), F.count("source").alias("n_linked"), answer)
    linked = broadcast_if_small(cut(linked))
    first = broadcast_if_small(cut(first))
    out = rows.join(first, rows["conv_id"].eqNullSafe(first["_conv"])).join(linked, F.col("at") == F.col("_at"), "left")
    before = F.when(F.col("at") > F.col("_first"), F.col("at") - 1)
    text = unquoted(F.col("text"))
    return out.select(
        "conv_id",
        (F.col("at") - F.col("_first")).alias("position"),
        "turn",
        "role",
        (F.coalesce("answer.source", before) - F.col("_first")).alias("reply_to"),
        F.coalesce("n_quotes", F.lit(0)).alias("n_quotes"),
        F.coalesce("n_linked", F.lit(0)).alias("n_linked"),
        text.alias("text"),
        F.concat(F.lit("<|"), "role", F.lit("|>\n"), text).alias("chat"),
    )


def op7_link_quotations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return link_quotes(table(spark, sf_dir, "conversations"))


QUERIES = {"op7_link_quotations": op7_link_quotations}
