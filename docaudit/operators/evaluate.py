"""Evaluation: reports of classifiers, retrieval and regressions."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators.monitor import value_at


def _safe(a: Column, b: Column) -> Column:
    return F.coalesce(F.try_divide(a, b), F.lit(0.0))


def class_report(df: DataFrame, labels: list[str]) -> DataFrame:
    """(label, precision, recall, f1, support) for each label, zero where undefined; df has truth and pred."""
    n = df.groupBy("truth", "pred").count()
    each = n.select(F.explode(F.array(*map(F.lit, labels))).alias("label"), "truth", "pred", "count").groupBy("label")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    t, p = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")
    out = each.agg(hit(t & p).alias("tp"), hit(p).alias("np"), hit(t).alias("support"))
    out = out.withColumn("precision", _safe(F.col("tp"), F.col("np"))).withColumn("recall", _safe(F.col("tp"), F.col("support")))
    return out.select("label", "precision", "recall", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")).alias("f1"), "support")


def overall_metrics(df: DataFrame, labels: list[str]) -> DataFrame:
    """One row: accuracy and macro F1 over the labels."""
    accuracy = df.agg(F.coalesce(F.avg((F.col("truth") == F.col("pred")).cast("double")), F.lit(0.0)).alias("accuracy"))
    return accuracy.crossJoin(class_report(df, labels).agg(F.avg("f1").alias("macro_f1")))  # a row each


def sliced_f1(df: DataFrame, labels: list[str], by: str, base: str) -> DataFrame:
    """(by, macro_f1, gap, band) of each slice: gap to the base slice's, in bands of 0.08 and 0.15."""
    n = df.groupBy(by, "truth", "pred").count()
    each = n.select(by, F.explode(F.array(*map(F.lit, labels))).alias("label"), "truth", "pred", "count").groupBy(by, "label")
    t, p = F.col("truth") == F.col("label"), F.col("pred") == F.col("label")
    hit = lambda c: F.coalesce(F.sum(F.when(c, F.col("count"))), F.lit(0))
    f1 = each.agg(_safe(2 * hit(t & p), hit(p) + hit(t)).alias("f1")).groupBy(by).agg(F.avg("f1").alias("macro_f1"))
    ref = f1.where(F.col(by) == base).select(F.col("macro_f1").alias("_base"))
    out = f1.crossJoin(F.broadcast(ref)).withColumn("gap", F.col("_base") - F.col("macro_f1"))  # one row
    return out.select(by, "macro_f1", "gap", F.when(F.col("gap") <= 0.08, "pass").when(F.col("gap") <= 0.15, "warn").otherwise("fail").alias("band"))


def confusion(df: DataFrame, labels: list[str]) -> DataFrame:
    """Dense (truth, pred, n)."""
    spark = df.sparkSession
    grid = spark.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias("truth")).select("truth", F.explode(F.array(*map(F.lit, labels))).alias("pred"))
    return grid.join(df.groupBy("truth", "pred").agg(F.count("*").alias("n")), ["truth", "pred"], "left").na.fill(0)


def binary_rates(df: DataFrame, by: list[str]) -> DataFrame:
    """TP, FP, TN, FN and the rates from them, by group; df has truth and pred (boolean)."""
    t, p = F.col("truth"), F.col("pred")
    n = df.groupBy(*by).agg(F.count_if(t & p).alias("tp"), F.count_if(~t & p).alias("fp"), F.count_if(~t & ~p).alias("tn"), F.count_if(t & ~p).alias("fn"), *[F.avg("confidence").alias("mean_confidence")] * ("confidence" in df.columns))
    n = n.withColumn("recall", _safe(F.col("tp"), F.col("tp") + F.col("fn"))).withColumn("tnr", _safe(F.col("tn"), F.col("tn") + F.col("fp"))).withColumn("precision", _safe(F.col("tp"), F.col("tp") + F.col("fp")))
    return n.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall"))).withColumn("balanced", (F.col("recall") + F.col("tnr")) / 2)


def tagged(df: DataFrame, tags: dict[str, str]) -> DataFrame:
    """df once for each tag whose text its note contains, ignoring case."""
    hits = F.array_compact(F.array(*[F.when(F.lower("note").contains(text.lower()), F.lit(tag)) for tag, text in tags.items()]))
    return df.withColumn("tag", F.explode(hits))


def outcome_eval(df: DataFrame) -> DataFrame:
    """One row: precision, recall and F1 of prohibited over all rows, and of high risk where neither side is prohibited; how many
    are minimal on either side, and rows that differ in either flag. df: truth_p, truth_h, pred_p, pred_h (boolean)."""
    tp, th, pp, ph = (F.col(c) for c in ("truth_p", "truth_h", "pred_p", "pred_h"))
    free = ~tp & ~pp
    n = df.agg(*[F.count_if(c).alias(a) for a, c in {"p_hit": tp & pp, "p_pred": pp, "p_true": tp, "h_hit": free & th & ph, "h_pred": free & ph, "h_true": free & th, "minimal_truth": ~tp & ~th, "minimal_pred": ~pp & ~ph, "errors": (tp != pp) | (th != ph)}.items()])
    for k in ("p", "h"):
        n = n.withColumn(f"{k}_precision", _safe(F.col(f"{k}_hit"), F.col(f"{k}_pred"))).withColumn(f"{k}_recall", _safe(F.col(f"{k}_hit"), F.col(f"{k}_true"))).withColumn(f"{k}_f1", _safe(2 * F.col(f"{k}_hit"), F.col(f"{k}_pred") + F.col(f"{k}_true")))
    return n.select("p_precision", "p_recall", "p_f1", "h_precision", "h_recall", "h_f1", "minimal_truth", "minimal_pred", "errors")


def accuracy_by(df: DataFrame, key: str, ident: str) -> DataFrame:
    """(key, n, accuracy, failures): failures are the ids of the rows that are wrong, in order."""
    wrong = F.array_sort(F.collect_list(F.when(~F.col("truth").eqNullSafe(F.col("pred")), F.col(ident))))
    return df.groupBy(key).agg(F.count("*").alias("n"), F.avg(F.col("truth").eqNullSafe(F.col("pred")).cast("double")).alias("accuracy"), wrong.alias("failures"))


def errors(df: DataFrame, ident: str, width: int = 80, n: int | None = None) -> DataFrame:
    """Rows that are wrong: id, text cut, truth, pred; the first n by id if asked."""
    out = df.where(~F.col("truth").eqNullSafe(F.col("pred"))).select(ident, F.substring("text", 1, width).alias("text"), "truth", "pred")
    return out if n is None else out.orderBy(ident).limit(n)


def status(df: DataFrame, spec: DataFrame) -> DataFrame:
    """(metric, value, status): pass from the spec's `pass` on, warn from its `warn` on, else fail; metrics without a spec go."""
    out = df.join(F.broadcast(spec), "metric")  # a row for each metric
    return out.select("metric", "value", F.when(F.col("value") >= F.col("pass"), "pass").when(F.col("value") >= F.col("warn"), "warn").otherwise("fail").alias("status"))


def merge_baseline(base: DataFrame, events: DataFrame) -> DataFrame:
    """base (metric, value) with the values of metrics that improved: events (metric, value, status)."""
    new = events.where("status = 'improvement'").select("metric", F.col("value").alias("_new"))
    return base.join(new, "metric", "left").select("metric", F.coalesce("_new", "value").alias("value"))


def precision_gate(hits: DataFrame, k: int = 3, least: float = 0.8) -> DataFrame:
    """One row: how many queries have a relevant hit among their first k, of how many, and whether enough."""
    each = hits.groupBy("query_id").agg(F.max((F.col("relevant") & (F.col("rank") <= k)).cast("int")).alias("hit"))
    return each.agg(F.sum("hit").alias("hits"), F.count("*").alias("queries"), F.avg("hit").alias("precision")).withColumn("passed", F.col("precision") >= least)


def recall_mrr(hits: DataFrame, ks: list[int]) -> DataFrame:
    """Recall at each k and mean reciprocal rank; hits: query_id, rank, relevant."""
    first = hits.groupBy("query_id").agg(F.min(F.when(F.col("relevant"), F.col("rank"))).alias("first"))
    return first.agg(*[F.avg(F.coalesce((F.col("first") <= k).cast("double"), F.lit(0.0))).alias(f"recall_{k}") for k in ks], F.avg(F.coalesce(1 / F.col("first"), F.lit(0.0))).alias("mrr"))


SPAN = ["doc_id", "start", "end", "label"]


def span_matches(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """(doc_id, start, end, label, outcome): each distinct span as tp, fp or fn, by exact match."""
    both = pred.select(*SPAN, F.lit(True).alias("p")).distinct().join(gold.select(*SPAN, F.lit(True).alias("g")).distinct(), SPAN, "full_outer")
    return both.select(*SPAN, F.when(F.col("p") & F.col("g"), "tp").when(F.col("p"), "fp").otherwise("fn").alias("outcome"))


def span_prf(pred: DataFrame, gold: DataFrame) -> DataFrame:
    """Exact span matches by label, and overall (label NULL)."""
    o = F.col("outcome")
    n = span_matches(pred, gold).rollup("label").agg(F.count_if(o == "tp").alias("tp"), F.count_if(o == "fp").alias("fp"), F.count_if(o == "fn").alias("fn"))
    n = n.withColumn("precision", _safe(F.col("tp"), F.col("tp") + F.col("fp"))).withColumn("recall", _safe(F.col("tp"), F.col("tp") + F.col("fn")))
    return n.withColumn("f1", _safe(2 * F.col("precision") * F.col("recall"), F.col("precision") + F.col("recall")))


def consistency(df: DataFrame, probe: str, label: str, threshold: float) -> DataFrame:
    """Share of each probe's majority label, and whether it reaches the threshold."""
    n = df.groupBy(probe, label).count()
    out = n.groupBy(probe).agg(F.max("count").alias("top"), F.sum("count").alias("runs"))
    return out.select(probe, (F.col("top") / F.col("runs")).alias("share"), (F.col("top") / F.col("runs") >= threshold).alias("consistent"))


def compare_to_baseline(current: DataFrame, base: DataFrame, tolerance: float = 0.02) -> DataFrame:
    """(metric, delta, status) of metrics that both have."""
    d = F.col("value") - F.col("base")
    return current.join(base, "metric").select("metric", d.alias("delta"), F.when(d < -tolerance, "regression").when(d > 0.001, "improvement").otherwise("same").alias("status"))


def latency_summary(df: DataFrame, group: str, value: str) -> DataFrame:
    """Mean, median, p95 (the sorted value at index int(0.95 n)), total and rate a minute."""
    stats = df.groupBy(group).agg(F.avg(value).alias("mean"), F.sum(value).alias("total"), (60 * F.count("*") / F.sum(value)).alias("per_minute"))
    at = lambda i, name: value_at(df, group, value, i).withColumnRenamed("at", name)
    n = F.col("n")
    halves = at(F.floor((n - 1) / 2), "low").join(at(F.floor(n / 2), "high"), group).select(group, ((F.col("low") + F.col("high")) / 2).alias("median"))
    return stats.join(halves, group, "left").join(at(F.floor(n * F.lit(0.95)), "p95"), group, "left")


def speed_up(summary: DataFrame, group: str, base: str, other: str) -> DataFrame:
    """How many times faster `other` is than `base`, by mean, median and p95."""
    of = lambda g: summary.where(F.col(group) == g)
    return of(base).alias("a").crossJoin(of(other).alias("b")).select(*[F.try_divide(F.col(f"a.{c}"), F.col(f"b.{c}")).alias(c) for c in ("mean", "median", "p95")])  # a row each


def extract_metrics(results: DataFrame, paths: dict[str, str]) -> DataFrame:
    """(key, metric, value) at dotted paths of a JSON column `body`; missing ones are dropped."""
    each = F.array(*[F.struct(F.lit(m).alias("metric"), F.expr(f"try_cast(get_json_object(body, '$.{p}') as double)").alias("value")) for m, p in paths.items()])
    return results.select("key", F.explode(each).alias("x")).select("key", "x.*").where(F.col("value").isNotNull())
