"""Queries of evaluation, training data, versions and the monitor."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions import text as tx
from docaudit.operators import evaluate, monitor, prep, registry
from docaudit.plans.catalog import ORACLES, _langs, _PRED, _pred, _truth, _TRUTH, query, values
from docaudit.sources import readers
from docaudit.streaming import monitor as streams

_PR = f"pr AS (SELECT doc_id, source, lang AS truth, detected AS pred FROM ({_PRED}) JOIN documents USING (doc_id))"
_L = "(SELECT unnest(['de','en','es','fr']) AS label)"
query("overall_metrics", f"""WITH {_PR}, f AS (SELECT label, coalesce(2 * count(*) FILTER (WHERE truth = label AND pred = label) / nullif(count(*) FILTER (WHERE truth = label) + count(*) FILTER (WHERE pred = label), 0), 0) AS f1 FROM {_L}, pr GROUP BY 1)
SELECT (SELECT round(avg((truth = pred)::INT), 6) FROM pr) AS accuracy, round(avg(f1), 6) AS macro_f1 FROM f""")(lambda t: evaluate.overall_metrics(_pred(t), _langs))
_sourced = lambda t: t("documents").select("doc_id", "source", "text", F.col("lang").alias("truth"), tx.detect_lang(F.col("text")).alias("pred"))
query("sliced_f1", f"""WITH {_PR}, f AS (SELECT source, label, coalesce(2 * count(*) FILTER (WHERE truth = label AND pred = label) / nullif(count(*) FILTER (WHERE truth = label) + count(*) FILTER (WHERE pred = label), 0), 0) AS f1 FROM {_L}, pr GROUP BY 1, 2),
m AS (SELECT source, avg(f1) AS m FROM f GROUP BY 1), g AS (SELECT source, m, (SELECT m FROM m WHERE source = 'src0') - m AS gap FROM m) SELECT source, round(m, 6) AS macro_f1, round(gap, 6) AS gap, CASE WHEN gap <= 0.08 THEN 'pass' WHEN gap <= 0.15 THEN 'warn' ELSE 'fail' END AS band FROM g WHERE gap IS NOT NULL""")(lambda t: evaluate.sliced_f1(_sourced(t), _langs, "source", "src0"))
query("accuracy_by", f"""WITH {_PR} SELECT truth AS lang, count(*) AS n, round(avg((truth = pred)::INT), 6) AS accuracy, coalesce(string_agg(doc_id, ',' ORDER BY doc_id) FILTER (WHERE truth <> pred), '') AS failures FROM pr GROUP BY 1""")(
    lambda t: evaluate.accuracy_by(_sourced(t).withColumn("lang", F.col("truth")), "lang", "doc_id").withColumn("failures", F.array_join(F.col("failures").cast("array<string>"), ","))
)
query("error_listing", f"WITH {_PR} SELECT doc_id, substr(d.text, 1, 80) AS text, truth, pred FROM pr JOIN documents d USING (doc_id) WHERE truth <> pred")(lambda t: evaluate.errors(_sourced(t), "doc_id"))
query("rates_with_confidence", f"WITH {_TRUTH}, n AS (SELECT source, count(*) FILTER (WHERE truth AND pred) AS tp, count(*) FILTER (WHERE NOT truth AND pred) AS fp, count(*) FILTER (WHERE NOT truth AND NOT pred) AS tn, count(*) FILTER (WHERE truth AND NOT pred) AS fn, avg(doc_id % 10 / 10.0) AS c FROM tr GROUP BY 1) SELECT source, tp, fp, tn, fn, round(c, 6) AS mean_confidence FROM n")(
    lambda t: evaluate.binary_rates(_truth(t).withColumn("confidence", F.col("doc_id") % 10 / 10), ["source"]).select("source", "tp", "fp", "tn", "fn", "mean_confidence")
)
query("rates_by_tag", f"WITH {_TRUTH}, g AS (SELECT truth, pred, unnest(list_filter([CASE WHEN contains(lower(source), '1') THEN 'one' END, CASE WHEN contains(lower(source), 'src') THEN 'all' END], lambda x: x IS NOT NULL)) AS tag FROM tr) SELECT tag, count(*) FILTER (WHERE truth AND pred) AS tp, count(*) FILTER (WHERE NOT truth AND pred) AS fp, count(*) FILTER (WHERE NOT truth AND NOT pred) AS tn, count(*) FILTER (WHERE truth AND NOT pred) AS fn FROM g GROUP BY 1")(
    lambda t: evaluate.binary_rates(evaluate.tagged(_truth(t).withColumn("note", F.col("source")), {"one": "1", "all": "SRC"}), ["tag"]).select("tag", "tp", "fp", "tn", "fn")
)
_OUT = "o AS (SELECT quality = 1 AS tp, n_chars % 3 = 0 AS th, n_chars % 2 = 0 AS pp, n_chars % 5 < 2 AS ph FROM labels JOIN documents USING (doc_id))"
query("outcome_eval", f"""WITH {_OUT}, n AS (SELECT count(*) FILTER (WHERE tp AND pp) AS a, count(*) FILTER (WHERE pp) AS b, count(*) FILTER (WHERE tp) AS c, count(*) FILTER (WHERE NOT tp AND NOT pp AND th AND ph) AS d, count(*) FILTER (WHERE NOT tp AND NOT pp AND ph) AS e, count(*) FILTER (WHERE NOT tp AND NOT pp AND th) AS f,
count(*) FILTER (WHERE NOT tp AND NOT th) AS mt, count(*) FILTER (WHERE NOT pp AND NOT ph) AS mp, count(*) FILTER (WHERE tp <> pp OR th <> ph) AS er FROM o)
SELECT round(a / b, 6) AS p_precision, round(a / c, 6) AS p_recall, round(2 * a / (b + c), 6) AS p_f1, round(d / e, 6) AS h_precision, round(d / f, 6) AS h_recall, round(2 * d / (e + f), 6) AS h_f1, mt AS minimal_truth, mp AS minimal_pred, er AS errors FROM n""")(
    lambda t: evaluate.outcome_eval(t("labels").join(t("documents"), "doc_id").select((F.col("quality") == 1).alias("truth_p"), (F.col("n_chars") % 3 == 0).alias("truth_h"), (F.col("n_chars") % 2 == 0).alias("pred_p"), (F.col("n_chars") % 5 < 2).alias("pred_h")).na.fill(False))
)
ORACLES["outcome_eval"] = ORACLES["outcome_eval"].replace("quality = 1 AS tp", "coalesce(quality = 1, false) AS tp")
_means = lambda t: t("events").groupBy(F.col("event_type").alias("metric")).agg((F.avg("value") / 100).alias("value"))
_SPEC = [("click", 0.5, 0.2), ("purchase", 0.9, 0.4), ("signup", 0.99, 0.9), ("error", 0.1, 0.05)]
query("status", f"WITH m AS (SELECT event_type AS metric, avg(value) / 100 AS v FROM events GROUP BY 1) SELECT metric, round(v, 6) AS value, CASE WHEN v >= s.pass THEN 'pass' WHEN v >= s.warn THEN 'warn' ELSE 'fail' END AS status FROM m JOIN {values(_SPEC, 'metric, pass, warn')} s USING (metric)")(
    lambda t: evaluate.status(_means(t), t("events").sparkSession.createDataFrame(_SPEC, "metric string, pass double, warn double"))
)
query("baseline_merge", "WITH c AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1), b AS (SELECT event_type AS metric, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT metric, round(CASE WHEN c.v - b.v > 0.001 THEN c.v ELSE b.v END, 6) AS value FROM b LEFT JOIN c USING (metric)")(
    lambda t: (lambda cur, base: evaluate.merge_baseline(base.withColumnRenamed("base", "value"), evaluate.compare_to_baseline(cur, base).join(cur, "metric")))(t("events").where("user_id % 2 = 1").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("value")), t("events").where("user_id % 2 = 0").groupBy(F.col("event_type").alias("metric")).agg(F.avg("value").alias("base")))
)
query("speed_up", """WITH r AS (SELECT event_type, avg(value) AS m, median(value) AS d FROM events GROUP BY 1), q AS (SELECT event_type, max(value) FILTER (WHERE pos = floor(n * 0.95)) AS p FROM (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events) GROUP BY 1)
SELECT round(a.m / b.m, 6) AS mean, round(a.d / b.d, 6) AS median, round(x.p / y.p, 6) AS p95 FROM r a, r b, q x, q y WHERE a.event_type = 'click' AND b.event_type = 'error' AND x.event_type = 'click' AND y.event_type = 'error'""")(lambda t: evaluate.speed_up(evaluate.latency_summary(t("events"), "event_type", "value"), "event_type", "click", "error"))
query("metric_extract", "SELECT CAST(event_id AS VARCHAR) AS key, m AS metric, round(v, 6) AS value FROM (SELECT event_id, unnest(['a', 'b']) AS m, unnest([value, CASE WHEN user_id % 2 = 0 THEN user_id::DOUBLE END]) AS v FROM events) WHERE v IS NOT NULL")(
    lambda t: evaluate.extract_metrics(t("events").select(F.col("event_id").cast("string").alias("key"), F.to_json(F.struct(F.struct(F.col("value").alias("x")).alias("m"), F.when(F.col("user_id") % 2 == 0, F.col("user_id")).alias("u"))).alias("body")), {"a": "m.x", "b": "u", "c": "m.y"})
)
query("label_counts", "SELECT quality, count(*) AS n FROM labels GROUP BY 1")(lambda t: prep.label_counts(t("labels"), "quality"))
query("known_labels", "SELECT doc_id FROM documents WHERE lang IN ('de', 'en')")(lambda t: _known(t).select("doc_id"))


def _known(t) -> DataFrame:
    from docaudit.operators import rules

    return rules.known_labels(t("documents"), ["de", "en"], "lang")


query("random_split", "SELECT doc_id, CASE WHEN row_number() OVER (ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) <= floor((SELECT count(*) FROM documents) * 0.8::DOUBLE) THEN 'train' ELSE 'val' END AS split FROM documents")(lambda t: prep.hash_split(t("documents").select("doc_id"), [], "doc_id", 0.8).select("doc_id", "split"))
query("anchors", "SELECT lang AS label, source AS lang, string_agg(doc_id, ',' ORDER BY doc_id) AS ids FROM (SELECT *, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS r FROM documents) WHERE r <= 5 GROUP BY 1, 2")(
    lambda t: prep.anchors(t("documents").select("doc_id", F.col("lang").alias("label"), F.col("source").alias("lang"), F.col("doc_id").cast("string").alias("text")), "doc_id").select("label", "lang", F.array_join("sentences", ",").alias("ids"))
)
query("union_stages", "WITH a AS (SELECT doc_id, text, (doc_id % 3)::INT AS stage FROM documents), f AS (SELECT text, min((stage, doc_id)) AS k FROM a GROUP BY 1) SELECT a.doc_id, a.stage FROM a JOIN f ON a.text = f.text AND f.k = (a.stage, a.doc_id) WHERE a.text NOT IN (SELECT text FROM benchmark)")(
    lambda t: prep.union_stages([t("documents").where(f"doc_id % 3 = {i}").select("doc_id", "text") for i in range(3)], t("benchmark").select("text"), "doc_id").select("doc_id", "stage")
)


def _expanded(t) -> DataFrame:
    """Templates over the names of nations and the words of part types."""
    spark = t("nation").sparkSession
    slot = lambda s: {"text": None, "slot": s}
    say = lambda x: {"text": x, "slot": None}
    templates = spark.createDataFrame([(0, [say("The "), slot("ACTOR"), say(" keeps "), slot("THING"), say(".")]), (1, [slot("THING"), say(" of "), slot("ACTOR")])], "template_id int, parts array<struct<text:string,slot:string>>")
    words = t("nation").select(F.lit("ACTOR").alias("slot"), F.col("n_name").alias("word")).unionAll(t("part").select(F.lit("THING"), F.col("p_type")).distinct())
    out = prep.expand_templates(templates, words, 200, 7)
    cut = F.transform("entities", lambda e: F.substring(F.col("text"), e["start"] + 1, e["end"] - e["start"]))
    return out.select("text", F.array_join(cut, "|").alias("words"), F.array_join(F.transform("entities", lambda e: e["label"]), "|").alias("labels"))


query("expand_templates")(_expanded)
_ROW = " || ".join(f"coalesce(strlen({c}::VARCHAR) || ':' || {c}::VARCHAR, 'n')" for c in ("doc_id", "lang", "n_chars", "text"))
_PRINT = f"CAST(sum(('0x' || substr(md5({_ROW}), 1, 16))::UBIGINT::HUGEINT) AS VARCHAR)"
query("fingerprint", f"SELECT source, count(*) AS n, {_PRINT} AS print FROM documents GROUP BY 1")(lambda t: prep.fingerprint(t("documents").select("doc_id", "lang", "n_chars", "source", "text"), ["source"]).select("source", "n", F.col("print").cast("string").alias("print")))

#: Versions from orders: customers as types; each order a version, the last active.
_models = lambda t: t("orders").where("o_custkey % 3 > 0").select(F.col("o_custkey").alias("type"), F.concat(F.lit("v"), "o_orderkey").alias("version"), F.when(F.col("o_orderstatus") == "F", F.concat(F.lit("d"), "o_orderkey")).alias("data_version"), (F.col("o_totalprice") / 1e6).alias("metric"), (F.col("o_orderkey") == F.max("o_orderkey").over(Window.partitionBy("o_custkey"))).alias("active"))
_MODELS = "mo AS (SELECT o_custkey AS type, 'v' || o_orderkey AS version, o_orderkey AS k, CASE WHEN o_orderstatus = 'F' THEN 'd' || o_orderkey END AS data_version, o_totalprice / 1e6 AS metric, o_orderkey = max(o_orderkey) OVER (PARTITION BY o_custkey) AS active FROM orders WHERE o_custkey % 3 > 0)"
_types = lambda t: t("customer").select(F.col("c_custkey").alias("type"))
query("active_versions", f"WITH {_MODELS} SELECT c_custkey AS type, coalesce(version, 'untrained') AS version, coalesce(data_version, 'unknown') AS data_version FROM customer LEFT JOIN mo ON type = c_custkey AND active")(lambda t: registry.active_versions(_types(t), _models(t)))
query("model_versions", f"WITH {_MODELS} SELECT c_custkey AS type, coalesce(version, 'untrained') AS version, coalesce(active, false) AS active, round(metric, 6) AS metric, row_number() OVER (PARTITION BY c_custkey ORDER BY k DESC)::INT AS place FROM customer LEFT JOIN mo ON type = c_custkey")(lambda t: registry.list_models(_types(t), _models(t)))
_data = lambda t: prep.fingerprint(t("documents").select("doc_id", "lang", "n_chars", "source", "text"), ["source"]).select(F.col("source").alias("type"), "n", F.col("print").cast("string").alias("print"))
_VERS = [("src0", "v1", 1, "1", False), ("src0", "v2", 2, "2", True), ("src1", "v9", 1, "1", False), ("src1", "v10", 1, "5", True), ("old", "v1", 3, "3", True)]
_vers = lambda t: t("documents").sparkSession.createDataFrame(_VERS, "type string, version string, n long, print string, active boolean").unionByName(_data(t).where("type = 'src2'").select("type", F.lit("v4").alias("version"), "n", "print", F.lit(True).alias("active")))
_SNAP = f"""dt AS (SELECT source AS type, count(*) AS n, {_PRINT} AS print FROM documents GROUP BY 1), ve AS (SELECT type, version, n, print, active FROM {values(_VERS, "type, version, n, print, active")} UNION ALL SELECT type, 'v4', n, print, true FROM dt WHERE type = 'src2'),
nw AS (SELECT type, 'v' || (coalesce((SELECT max(substr(version, 2)::INT) FROM ve WHERE ve.type = dt.type), 0) + 1) AS version, n, print, true AS active FROM dt WHERE NOT EXISTS (SELECT 1 FROM ve WHERE ve.type = dt.type AND ve.active AND ve.print = dt.print)),
sn AS (SELECT type, version, n, print, active AND type NOT IN (SELECT type FROM nw) AS active FROM ve UNION ALL SELECT * FROM nw)"""
query("snapshot_data", f"WITH {_SNAP} SELECT * FROM sn")(lambda t: registry.snapshot_data(_data(t), _vers(t)))
query("data_versions", f"WITH {_SNAP}, ty AS (SELECT DISTINCT source AS type FROM documents UNION ALL SELECT 'none') SELECT ty.type, count(version) AS versions, coalesce(max(n) FILTER (WHERE active), 0) AS records, max(version) FILTER (WHERE active) AS active FROM ty LEFT JOIN sn USING (type) GROUP BY 1")(
    lambda t: registry.list_data(_data(t).select("type").unionAll(t("documents").sparkSession.createDataFrame([("none",)], "type string")), registry.snapshot_data(_data(t), _vers(t)))
)
query("should_retrain", f"WITH {_MODELS}, m AS (SELECT type, version, data_version, type % 7 = 0 AS hub FROM mo WHERE active) SELECT c_custkey AS type, CASE WHEN version IS NULL THEN true WHEN hub THEN false WHEN data_version IS NULL THEN true ELSE data_version <> 'd' || (c_custkey * 10) END AS retrain FROM customer LEFT JOIN m ON type = c_custkey")(
    lambda t: registry.should_retrain(_models(t).where("active").select("type", F.col("version").alias("model"), (F.col("type") % 7 == 0).alias("from_hub"), F.col("data_version").alias("trained_on")), _types(t).select("type", F.concat(F.lit("d"), F.col("type") * 10).alias("data_version")))
)
query("pinned_promotions", """WITH e AS (SELECT event_id, user_id, ts, value, sum((event_type = 'signup')::INT) OVER (PARTITION BY user_id ORDER BY ts, event_id) AS era FROM events) SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id, era ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM e) WHERE best IS NULL OR value > best""")(
    lambda t: registry.promotions(t("events").withColumn("pinned", F.col("event_type") == "signup"), "user_id", ["ts", "event_id"], "value", "pinned").select("event_id")
)
query("collection_sizes", "SELECT * FROM (SELECT source AS collection, count(*) AS n, sum(n_chars)::BIGINT AS bytes FROM documents GROUP BY 1) FULL JOIN (SELECT unnest(['src0', 'absent']) AS collection) USING (collection)")(lambda t: monitor.collection_sizes(t("documents").select(F.col("source").alias("collection"), F.col("n_chars").alias("bytes")), ["src0", "absent"]))
query("sliding_stats", "SELECT event_type, b AS began, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM (SELECT event_type, value, unnest([x, x - 1800]) AS b FROM (SELECT event_type, value, (epoch_us(ts) // 1800000000) * 1800 AS x FROM events)) GROUP BY 1, 2")(
    lambda t: monitor.windowed_stats(t("events"), "1 hour", "30 minutes").withColumn("began", F.unix_seconds(F.col("began").cast("timestamp")))
)


def _quantiles(t) -> DataFrame:
    """Sliding windows merged from panes; whether p95's rank among the window's values is within the sketch's error (twice)."""
    events = t("events")
    merged = monitor.merged_panes(monitor.panes(events, "30 minutes", good=F.col("event_type") != "error"), "1 hour", "30 minutes")
    inside = events.select(F.explode(F.array(F.window("ts", "30 minutes")["start"], F.window("ts", "30 minutes")["start"] - F.expr("interval 30 minutes"))).alias("began"), "event_type", "value")
    ranks = inside.join(merged, ["began", "event_type"]).groupBy("began", "event_type", "n", "mean", "most", "success_rate").agg(F.avg((F.col("value") < F.col("p95")).cast("int")).alias("low"), F.avg((F.col("value") <= F.col("p95")).cast("int")).alias("high"))
    near = (F.col("low") <= 0.95 + 2 * monitor.RANK_ERROR) & (F.col("high") >= 0.95 - 2 * monitor.RANK_ERROR)
    return ranks.select(F.unix_seconds(F.col("began").cast("timestamp")).alias("began"), "event_type", "n", "mean", "most", "success_rate", near.alias("p95_near"))


query("window_quantiles", """SELECT event_type, b AS began, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most, CASE WHEN event_type = 'error' THEN 0.0 ELSE 100.0 END::DOUBLE AS success_rate, true AS p95_near
FROM (SELECT event_type, value, unnest([x, x - 1800]) AS b FROM (SELECT event_type, value, (epoch_us(ts) // 1800000000) * 1800 AS x FROM events)) GROUP BY 1, 2""")(_quantiles)
query("paired_audits")(lambda t: streams.pair_each_audit(t("events"), "signup", "purchase", "1 day", now="2100-01-01"))
query("session_stats", """WITH e AS (SELECT user_id, epoch_us(ts) AS u, value, lag(epoch_us(ts)) OVER (PARTITION BY user_id ORDER BY ts) AS b FROM events), s AS (SELECT *, sum((b IS NULL OR u - b >= 3600 * 1000000::BIGINT)::INT) OVER (PARTITION BY user_id ORDER BY u) AS k FROM e)
SELECT user_id, min(u) AS began, max(u) + 3600 * 1000000::BIGINT AS ended, count(*) AS n, round(sum(value), 6) AS total FROM s GROUP BY user_id, k""")(
    lambda t: monitor.session_stats(t("events"), "1 hour").withColumns({c: F.unix_micros(F.col(c).cast("timestamp")) for c in ("began", "ended")})
)
query("monitoring_snapshot")(
    lambda t: monitor.snapshot(monitor.pipeline_stats(t("events"), "signup", "purchase", "error"), monitor.stage_stats(t("events")), monitor.node_stats(t("events").withColumn("user_id", F.col("event_type")), "error"), monitor.collection_sizes(t("documents").select(F.col("source").alias("collection"), F.col("n_chars").alias("bytes")), ["src0"]), registry.active_versions(t("nation").select(F.col("n_nationkey").alias("type")), _models(t))).select(F.to_json(F.struct("*")).alias("snapshot"))
)
query("index_docs", "SELECT 'd' || doc_id AS id, text, (n_chars % 7 + 9)::INT AS article, 'ai' AS regulation, lang, 3 AS chunk_index, source AS title FROM documents UNION ALL SELECT 'b' || item_id, text, 9, 'check', 'en', 0, 'item' FROM benchmark")(
    lambda t: readers.to_index_docs(t("documents").select(F.concat(F.lit("d"), "doc_id").alias("id"), "text", (F.col("n_chars") % 7 + 9).cast("int").alias("article"), F.lit("ai").alias("regulation"), "lang", F.lit(3).alias("chunk_index"), F.col("source").alias("title")), t("benchmark").select(F.concat(F.lit("b"), "item_id").alias("id"), "text", F.lit(9).alias("article"), F.lit("check").alias("regulation"), F.lit("item").alias("title")))
)
query("vector_pooling", "SELECT vec_id, round(list_sum(list_transform(e, lambda x: (x / n) * (x / n))), 6) AS one, round((e[1] + e[2]) / 2, 6) AS pooled FROM (SELECT vec_id, embedding::DOUBLE[] AS e, greatest(sqrt(list_inner_product(embedding::DOUBLE[], embedding::DOUBLE[])), 1e-9) AS n FROM embeddings)")(
    lambda t: t("embeddings").select("vec_id", tx.dot(tx.l2_normalise(F.col("embedding")), tx.l2_normalise(F.col("embedding"))).alias("one"), tx.mean_pool(F.array(F.slice("embedding", 1, 1), F.slice("embedding", 2, 1), F.slice("embedding", 3, 1)), F.array(F.lit(1), F.lit(1), F.lit(0)))[0].alias("pooled"))
)
query("reply_lists", """SELECT doc_id, CASE doc_id % 4 WHEN 0 THEN lang || '|' || source WHEN 1 THEN source WHEN 2 THEN lang ELSE '' END AS parsed, lang || '|' || source AS repaired FROM documents""")(
    lambda t: t("documents").select("doc_id", F.when(F.col("doc_id") % 4 == 0, F.to_json(F.array("lang", "source"))).when(F.col("doc_id") % 4 == 1, F.concat(F.lit('{"items": ["'), "source", F.lit('"]}'))).when(F.col("doc_id") % 4 == 2, F.concat(F.lit('here: ["'), "lang", F.lit('"] and ["x"]'))).otherwise("short").alias("reply"), F.when(F.col("doc_id") % 2 == 0, F.concat(F.lit('x ["'), "lang", F.lit('", "'), "source", F.lit('",] y'))).otherwise(F.concat(F.lit('["'), "lang", F.lit('", "'), "source", F.lit('", "cut'))).alias("torn")).select("doc_id", F.array_join(tx.parse_list(F.col("reply")), "|").alias("parsed"), F.array_join(tx.repair_list(F.col("torn")), "|").alias("repaired"))
)
