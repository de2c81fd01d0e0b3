"""Monitoring over an event table: counters, stages, pairs, windows."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F


def pipeline_stats(events: DataFrame, start: str, done: str, failed: str) -> DataFrame:
    """Counters of runs: started, done, failed, still active; share of success in percent; mean duration of all that ended."""
    e = F.col("event_type")
    n = events.agg(F.count_if(e == start).alias("total"), F.count_if(e == done).alias("successful"), F.count_if(e == failed).alias("failed"), F.avg(F.when(e.isin(done, failed), F.col("value"))).alias("mean_duration"))
    n = n.withColumn("active", F.greatest(F.col("total") - F.col("successful") - F.col("failed"), F.lit(0)))
    return n.withColumn("success_rate", F.round(F.col("successful") / F.greatest(F.col("total"), F.lit(1)) * 100, 1))


def value_at(df: DataFrame, group: str, value: str, index: Column, bucket: Column | None = None) -> DataFrame:
    """(group, at): of each group's sorted values, the one at a 0-based index, a function of the column n (the group's rows).

    Equal values are counted before anything is ordered. Values are counted by buckets that rise with them (by default of 1.6 %
    width), and only the bucket that holds the index is ordered, so no task orders all of a group."""
    v = F.col(value)
    rises = bucket if bucket is not None else F.signum(v) * F.floor(F.log1p(F.abs(v)) * 64)
    counts = df.where(v.isNotNull()).groupBy(group, value).agg(F.count("*").alias("times")).withColumn("bucket", rises)
    totals = counts.groupBy(group, "bucket").agg(F.sum("times").alias("inside"))
    by = Window.partitionBy(group)
    earlier = by.orderBy("bucket").rowsBetween(Window.unboundedPreceding, -1)  # a row for each bucket
    totals = totals.select(group, "bucket", "inside", F.coalesce(F.sum("inside").over(earlier), F.lit(0)).alias("before"), F.sum("inside").over(by).alias("n"))
    totals = totals.where((F.col("before") <= index) & (F.col("before") + F.col("inside") > index))
    here = Window.partitionBy(group).orderBy(value)
    ranked = counts.join(totals, [group, "bucket"]).withColumn("upto", F.col("before") + F.sum("times").over(here))
    return ranked.where((F.col("upto") > index) & (F.col("upto") - F.col("times") <= index)).select(group, v.alias("at"))


#: Size of a quantile sketch: at 200, a quantile's rank is wrong by 1.33 % of all rows at most, in 99 of 100 cases.
SKETCH, RANK_ERROR = 200, 0.0133


def stage_stats(events: DataFrame, approximate: bool = False) -> DataFrame:
    """Count, mean, least, most and p95 (the sorted value at index max(0, int(0.95 n) - 1)) of each stage.

    approximate: p95 from a quantile sketch (SKETCH): one pass and one small row a stage and task, rank within RANK_ERROR."""
    sums = [F.count("*").alias("n"), F.avg("value").alias("mean"), F.min("value").alias("least"), F.max("value").alias("most")]
    if approximate:
        sketched = events.groupBy("event_type").agg(*sums, F.kll_sketch_agg_double(F.col("value").cast("double"), F.lit(SKETCH)).alias("_sketch"))
        return sketched.withColumn("p95", quantile(F.col("_sketch"), 0.95)).drop("_sketch")
    stats = events.groupBy("event_type").agg(*sums)
    p95 = value_at(events, "event_type", "value", F.greatest(F.lit(0), F.floor(F.col("n") * F.lit(0.95)) - 1))
    return stats.join(p95.withColumnRenamed("at", "p95"), "event_type", "left")


def quantile(sketch: Column, share: float) -> Column:
    """A quantile of a sketch; NULL of an empty one."""
    return F.when(F.kll_sketch_get_n_double(sketch) > 0, F.kll_sketch_get_quantile_double(sketch, F.lit(share)))


def panes(events: DataFrame, length: str, by: str = "event_type", good: Column | None = None) -> DataFrame:
    """(began, by, n, good, total, most, sketch) for each tumbling pane: all that longer windows are merged from. The same plan
    serves a stream. good: which events count as successes."""
    value = F.col("value").cast("double")
    sums = [F.count("*").alias("n"), F.count_if(good if good is not None else F.lit(True)).alias("good"), F.sum("value").alias("total"), F.max("value").alias("most"), F.kll_sketch_agg_double(value, F.lit(SKETCH)).alias("sketch")]
    return events.groupBy(F.window("ts", length).alias("w"), by).agg(*sums).select(F.col("w.start").alias("began"), by, *["n", "good", "total", "most", "sketch"])


def merged_panes(stored: DataFrame, length: str, slide: str, by: str = "event_type") -> DataFrame:
    """(began, by, n, mean, most, success_rate, p95) for windows of `length` every `slide`, from panes whose length divides both:
    sketches are merged, no event is read again."""
    merged = stored.groupBy(F.window("began", length, slide).alias("w"), by).agg(F.sum("n").alias("n"), F.sum("good").alias("good"), F.sum("total").alias("total"), F.max("most").alias("most"), F.kll_merge_agg_double("sketch", F.lit(SKETCH)).alias("sketch"))
    return pane_figures(merged.select(F.col("w.start").alias("began"), *[c for c in merged.columns if c != "w"]))


def pane_figures(stored: DataFrame, p: float = 0.95) -> DataFrame:
    """Panes as figures: mean, success rate in percent (one digit) and a high quantile instead of sums and sketch."""
    figures = {"mean": F.col("total") / F.col("n"), "success_rate": F.round(F.col("good") / F.greatest(F.col("n"), F.lit(1)) * 100, 1), "p95": quantile(F.col("sketch"), p)}
    return stored.withColumns(figures).drop("good", "total", "sketch")


def node_stats(events: DataFrame, bad: str) -> DataFrame:
    return events.groupBy(F.col("user_id").alias("node")).agg(F.count("*").alias("invocations"), F.sum("value").alias("total"), F.avg("value").alias("mean"), F.count_if(F.col("event_type") == bad).alias("errors"))


def pair_audits(events: DataFrame, start: str, finish: str) -> DataFrame:
    """(user_id, seconds, active): from first start to last finish; a finish without a start counts 0, no finish is active."""
    e = F.col("event_type")
    n = events.groupBy("user_id").agg(F.min(F.when(e == start, F.col("ts"))).alias("began"), F.max(F.when(e == finish, F.col("ts"))).alias("ended"))
    n = n.where(F.col("began").isNotNull() | F.col("ended").isNotNull())
    seconds = F.when(F.col("began").isNull(), 0.0).otherwise(F.greatest(F.lit(0.0), F.unix_micros(F.col("ended").cast("timestamp")) / 1e6 - F.unix_micros(F.col("began").cast("timestamp")) / 1e6))
    return n.select("user_id", F.when(F.col("ended").isNotNull(), seconds).alias("seconds"), F.col("ended").isNull().alias("active"))


def windowed_stats(events: DataFrame, length: str, slide: str | None = None) -> DataFrame:
    """Per stage and tumbling or sliding window: count, mean and most. The same plan serves the stream."""
    return events.groupBy(F.window("ts", length, slide).alias("w"), "event_type").agg(F.count("*").alias("n"), F.avg("value").alias("mean"), F.max("value").alias("most")).select(F.col("w.start").alias("began"), "event_type", "n", "mean", "most")


def audit_status(events: DataFrame) -> DataFrame:
    return events.groupBy("user_id").agg(F.max_by("event_type", F.struct("ts", "event_id")).alias("status"))


def session_stats(events: DataFrame, gap: str, key: str = "user_id") -> DataFrame:
    """Sessions of each key that end after a gap without events: begin, end, events, sum. The same plan serves the stream."""
    out = events.groupBy(key, F.session_window("ts", gap).alias("w")).agg(F.count("*").alias("n"), F.sum("value").alias("total"))
    return out.select(key, F.col("w.start").alias("began"), F.col("w.end").alias("ended"), "n", "total")


def snapshot(pipeline: DataFrame, stages: DataFrame, nodes: DataFrame, collections: DataFrame, models: DataFrame) -> DataFrame:
    """One row with all of the monitor's tables: pipeline as a struct, the others as arrays in order of their first column. Each is
    a row a stage, node, collection or model type."""
    as_list = lambda df, name: df.agg(F.array_sort(F.collect_list(F.struct(*df.columns))).alias(name))
    out = pipeline.select(F.struct(*pipeline.columns).alias("pipeline"))
    for df, name in ((stages, "stages"), (nodes, "nodes"), (collections, "collections"), (models, "models")):
        out = out.crossJoin(as_list(df, name))  # a row each
    return out


def collection_sizes(rows: DataFrame, expected: list[str], key: str = "collection", size: str = "bytes") -> DataFrame:
    """(key, n, bytes) of each expected collection, NULL for one that has no rows, and of all others that have."""
    n = rows.groupBy(key).agg(F.count("*").alias("n"), F.sum(size).alias("bytes"))
    names = rows.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, expected))).alias(key))
    return names.join(n, key, "full_outer")
