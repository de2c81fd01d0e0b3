"""Training data: skips, copies, splits, weights, quotas."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators.monitor import value_at


def skip_existing(new: DataFrame, old: DataFrame) -> DataFrame:
    """Rows of new whose exact text isn't in old."""
    return new.join(old.select(F.sha2("text", 256).alias("_k")).distinct(), F.sha2("text", 256) == F.col("_k"), "left_anti")


def dedupe_first(df: DataFrame, order: str) -> DataFrame:
    """The first row of each text; of rows alike in text and order, one. Hashes of a row's other columns settle ties, minima are
    taken by hash before rows are joined, so a common text stays one row a task."""
    keyed = df.withColumn("_k", F.sha2("text", 256)).withColumn("_row", F.xxhash64(*df.columns))
    first = keyed.groupBy("_k").agg(F.min(F.struct(order, "_row")).alias("_first")).select("_k", "_first.*")
    kept = keyed.join(first, (keyed["_k"].eqNullSafe(first["_k"])) & keyed[order].eqNullSafe(first[order]) & (keyed["_row"] == first["_row"]), "left_semi")
    return kept.dropDuplicates(["_k", "_row"]).select(df.columns)


def split_cut(df: DataFrame, strata: list[str], key: str, train: float) -> DataFrame:
    """(strata, last): the hash of the last row of each stratum that trains. Strata are spread over tasks by ranges of the hash."""
    one = df.select(*strata, F.md5(F.col(key).cast("string")).alias("_h")).withColumn("_s", F.lit(0) if not strata else F.xxhash64(*strata))
    return value_at(one, "_s", "_h", F.greatest(F.lit(1), F.floor(F.col("n") * F.lit(train))) - 1, F.substring("_h", 1, 3))


def hash_split(df: DataFrame, strata: list[str], key: str, train: float) -> DataFrame:
    """Adds split: in each stratum the first max(1, int(n * train)) rows by MD5 of the key train, the others validate."""
    last = split_cut(df, strata, key, train)
    df = df.withColumn("_s", F.lit(0) if not strata else F.xxhash64(*strata))
    out = df.join(last, "_s").withColumn("split", F.when(F.md5(F.col(key).cast("string")) <= F.col("at"), "train").otherwise("val"))
    return out.drop("_s", "at")


def class_weights(df: DataFrame, label: str, k: int, low: float, high: float) -> DataFrame:
    n = df.groupBy(label).agg(F.count("*").alias("n"))
    total = n.agg(F.sum("n").alias("total"))
    return n.join(F.broadcast(total)).select(label, "n", F.least(F.greatest(F.col("total") / (k * F.greatest("n", F.lit(1))), F.lit(low)), F.lit(high)).alias("weight"))  # one row


def sufficiency(df: DataFrame, target: int) -> DataFrame:
    """Whether the smallest (label, lang) count and the total reach what the target asks for."""
    n = df.groupBy("label", "lang").count()
    out = n.agg(F.min("count").alias("least"), F.sum("count").alias("total"))
    return out.withColumn("sufficient", (F.col("least") >= max(30, target // 4)) & (F.col("total") >= target * 16))


def label_quota(df: DataFrame, by: list[str], n: int, order: str, least: int = 20) -> DataFrame:
    rows = df.where(F.length("text") >= least)
    return rows.withColumn("rank", F.row_number().over(Window.partitionBy(*by).orderBy(order))).where(F.col("rank") <= n)


def row_print(df: DataFrame) -> Column:
    """64 bits of each row's content: all columns by name, each with its length, so no two rows read alike."""
    text = {c: F.col(f"`{c}`").cast("string") if "<" not in kind else F.to_json(F.struct(F.col(f"`{c}`"))) for c, kind in df.dtypes}
    parts = [F.coalesce(F.concat(F.octet_length(text[c]), F.lit(":"), text[c]), F.lit("n")) for c in sorted(text)]
    return F.conv(F.substring(F.md5(F.concat(*parts)), 1, 16), 16, 10).cast("decimal(20,0)")


def fingerprint(df: DataFrame, by: list[str]) -> DataFrame:
    """Order-free fingerprint of whole rows but for the columns `by`, which name the groups: the number of rows and the sum of
    their prints, so rows that stand twice count twice."""
    return df.withColumn("_print", row_print(df.drop(*by))).groupBy(*by).agg(F.count("*").alias("n"), F.sum("_print").cast("decimal(38,0)").alias("print"))


def label_counts(df: DataFrame, label: str) -> DataFrame:
    return df.groupBy(label).agg(F.count("*").alias("n"))


def anchors(df: DataFrame, order: str, n: int = 5) -> DataFrame:
    """(label, lang, sentences): the first n texts of each label and language, in order. A task keeps n of each at most."""
    best = Window.partitionBy("label", "lang").orderBy(order)
    first = df.withColumn("_r", F.row_number().over(best)).where(F.col("_r") <= n)
    return first.groupBy("label", "lang").agg(F.transform(F.array_sort(F.collect_list(F.struct("_r", "text"))), lambda x: x["text"]).alias("sentences"))


def union_stages(stages: list[DataFrame], existing: DataFrame, order: str) -> DataFrame:
    """The new texts of all stages, a stage's only where no earlier stage and no existing row has them; stage: its number."""
    rows = None
    for i, stage in enumerate(stages):
        stage = stage.withColumn("stage", F.lit(i))
        rows = stage if rows is None else rows.unionByName(stage, allowMissingColumns=True)
    return skip_existing(dedupe_first(rows.withColumn("_order", F.struct("stage", order)), "_order"), existing).drop("_order")


def expand_templates(templates: DataFrame, words: DataFrame, n: int, seed: int, tries: int = 15) -> DataFrame:
    """(text, entities): n distinct texts from templates (template_id, parts: array of struct text, slot) with each slot filled by
    a word of its label (words: slot, word), at most tries * n attempts. entities: start, end, label of each word.

    Attempts are numbered; a hash of seed, number and place picks template and words, so a run can be repeated."""
    spark = templates.sparkSession
    pick = lambda c, size: F.pmod(F.xxhash64(F.lit(seed), "attempt", c), size)
    pool = templates.agg(F.array_sort(F.collect_list(F.struct("template_id", "parts"))).alias("pool"))  # the templates, in one row
    lists = words.groupBy("slot").agg(F.array_sort(F.collect_set("word")).alias("list")).agg(F.map_from_entries(F.collect_list(F.struct("slot", "list"))).alias("lists"))  # the vocabulary, in one row
    rows = spark.range(tries * n).withColumnRenamed("id", "attempt").crossJoin(F.broadcast(pool)).crossJoin(F.broadcast(lists))
    rows = rows.select("attempt", "lists", F.col("pool")[pick(F.lit(-1), F.size("pool")).cast("int")]["parts"].alias("parts"))
    rows = rows.withColumn("n_words", F.transform("parts", lambda p: F.size(F.col("lists")[p["slot"]])))
    filled = F.transform("parts", lambda p, i: F.struct(F.when(p["slot"].isNull(), p["text"]).otherwise(F.col("lists")[p["slot"]][pick(i, F.col("n_words")[i]).cast("int")]).alias("text"), p["slot"].alias("slot")))
    empty = F.struct(F.lit("").alias("text"), F.array().cast("array<struct<start:int,end:int,label:string>>").alias("entities"))
    grow = lambda s, p: F.struct(F.concat(s["text"], p["text"]).alias("text"), F.when(p["slot"].isNull(), s["entities"]).otherwise(F.array_append(s["entities"], F.struct(F.length(s["text"]).alias("start"), (F.length(s["text"]) + F.length(p["text"])).alias("end"), p["slot"].alias("label")))).alias("entities"))
    made = rows.select("attempt", F.aggregate(filled, empty, grow).alias("made")).select("attempt", "made.*")
    first = made.groupBy("text").agg(F.min(F.struct("attempt", "entities")).alias("first"))
    return first.orderBy("first.attempt").limit(n).select("text", "first.entities")
