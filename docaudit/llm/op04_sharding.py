"""Balanced contiguous shards from global byte-size prefix sums. DataFrame operations only."""

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import cut, in_order, table


def shard_by_bytes(docs: DataFrame, n_shards: int = 8) -> DataFrame:
    """Deals documents, in doc_id order, into n_shards contiguous shards of near equal bytes.

    The text itself is never shuffled: only doc_id, size and checksum are put in order. A row goes to the shard in whose
    equal share of all bytes it starts, so sizes differ from the target by one document at most. Equal texts of different
    doc_ids may come to different shards: contiguous shards go by doc_id alone.
    Null text: size 1, checksum of the empty string. Null doc_id: first. Repeated rows: each keeps its place, ties by
    checksum and size. Empty table: empty result. Other columns of docs: ignored."""
    text = F.coalesce(F.col("text"), F.lit(""))
    rows = docs.select("doc_id", (F.octet_length(text) + 1).cast("long").alias("size"), F.crc32(text.cast("binary")).alias("text_crc32"))
    rows = in_order(cut(rows), ["doc_id", "text_crc32", "size"], "size")
    total = rows.agg(F.sum("size").alias("_total"))
    rows = rows.join(F.broadcast(total)).withColumn("shard", F.expr(f"cast((before * {n_shards}) div _total as int)"))
    first = rows.groupBy("shard").agg(F.min("at").alias("_first"))  # n_shards rows
    return rows.join(F.broadcast(first), "shard").select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", (F.col("at") - F.col("_first")).alias("slot"), F.lit(None).cast("int").alias("grown_shard"))


def op4_shard_by_bytes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return shard_by_bytes(table(spark, sf_dir, "documents"))


QUERIES = {"op4_shard_by_bytes": op4_shard_by_bytes}
