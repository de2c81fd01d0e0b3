"""Queries of retrieval as a whole, scores and reports."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions import text as tx
from docaudit.functions.plan import broadcast_if_small
from docaudit.operators import evaluate, report, retrieval
from docaudit.plans.catalog import ITEMS, ORACLES, TOKENS, VOTE, _lit, _row_audits, query

DOMAINS = ["risk", "data", "docs", "logs"]
ARTICLES = [9, 10, 11, 12]
#: Chunks: documents in groups of twenty, with a domain by length.
_chunks = lambda t: t("documents").select(F.expr("doc_id div 20").alias("doc_id"), F.col("doc_id").alias("chunk_id"), F.element_at(F.array(*map(F.lit, [*DOMAINS, "other"])), (F.col("n_chars") % 5 + 1).cast("int")).alias("domain"))
query("chunks_by_domain", f"""WITH c AS (SELECT doc_id // 20 AS doc_id, doc_id AS chunk_id, ({_lit([*DOMAINS, 'other'])})[(n_chars % 5 + 1)::INT] AS domain FROM documents), g AS (SELECT DISTINCT doc_id, unnest({_lit(DOMAINS)}) AS domain FROM c)
SELECT g.doc_id, g.domain, coalesce(string_agg(chunk_id, ',' ORDER BY chunk_id), '') AS chunk_ids FROM g LEFT JOIN c USING (doc_id, domain) GROUP BY 1, 2""")(
    lambda t: report.chunks_by_domain(_chunks(t), DOMAINS).select("doc_id", "domain", F.array_join(F.col("chunk_ids").cast("array<string>"), ",").alias("chunk_ids"))
)

#: A row for each document and article: what applies, how many chunks, whether the analysis failed, a reply and passages.
_LIST = "CASE WHEN doc_id % 4 = 0 THEN [] WHEN doc_id % 4 = 1 THEN [9, 10] WHEN doc_id % 4 = 2 THEN [5] ELSE NULL END"
_REPLY = "json_object('score', n_chars % 140 - 10, 'reasoning', ' r ' || doc_id, 'recommendations', json_array('Keep data logs', '', lang), 'gaps', json_array(json_object('title', substr(text, 1, 100), 'description', lang || ' is short', 'severity', upper(source)), json_object('title', ' ', 'description', 'x', 'severity', 'major'), json_object('description', 'no title has been given here', 'severity', CASE WHEN doc_id % 3 = 0 THEN 'Critical' ELSE 'odd' END)))"


def _cases(t) -> DataFrame:
    d = t("documents").withColumn("article", F.explode(F.array(*map(F.lit, ARTICLES))))
    lists = F.when(F.col("doc_id") % 4 == 0, F.array().cast("array<int>")).when(F.col("doc_id") % 4 == 1, F.array(F.lit(9), F.lit(10))).when(F.col("doc_id") % 4 == 2, F.array(F.lit(5)))
    gap = lambda title, text, severity: F.struct(title.alias("title"), text.alias("description"), severity.alias("severity"))
    gaps = F.array(gap(F.substring("text", 1, 100), F.concat("lang", F.lit(" is short")), F.upper("source")), gap(F.lit(" "), F.lit("x"), F.lit("major")), gap(F.lit(None).cast("string"), F.lit("no title has been given here"), F.when(F.col("doc_id") % 3 == 0, "Critical").otherwise("odd")))
    reply = F.struct((F.col("n_chars") % 140 - 10).cast("double").alias("score"), gaps.alias("gaps"), F.array(F.lit("Keep data logs"), F.lit(""), F.col("lang")).alias("recommendations"), F.concat(F.lit(" r "), "doc_id").alias("reasoning"))
    none = F.lit(None).cast("string")
    one = F.struct(F.when(F.col("doc_id") % 2 == 0, F.col("lang")).alias("title"), F.lit("R1").alias("requirement_id"), none.alias("article"), F.col("source").alias("text"), none.alias("regulation"), F.lit("annex").alias("source"), none.alias("article_ref"))
    passages = F.when(F.col("n_chars") % 3 == 0, F.array().cast(f"array<{_cast(one)}>")).otherwise(F.array(one))
    return d.select("doc_id", "article", lists.alias("applicable"), ((F.col("n_chars") + F.col("article")) % 4).cast("int").alias("chunk_count"), (F.col("n_chars") % 7 == 0).alias("failed"), reply.alias("reply"), passages.alias("passages"))


def _cast(one) -> str:
    return "struct<title:string,requirement_id:string,article:string,text:string,regulation:string,source:string,article_ref:string>"


_DEFAULT = f"""cs AS (SELECT doc_id, article::INT AS article, text, lang, source, n_chars, (n_chars + article) % 4 AS chunks, n_chars % 7 = 0 AS failed, {_LIST} AS app FROM documents, (SELECT unnest({ARTICLES}) AS article)),
df AS (SELECT *, CASE WHEN len(app) > 0 AND NOT list_contains(app, article) THEN 'skip' WHEN chunks = 0 THEN 'empty' WHEN failed THEN 'failed' ELSE 'open' END AS state FROM cs)"""
query("article_defaults", f"""WITH {_DEFAULT} SELECT doc_id, article, CASE state WHEN 'skip' THEN 100 WHEN 'empty' THEN 0 WHEN 'failed' THEN 30 END::DOUBLE AS score, CASE state WHEN 'skip' THEN 0 WHEN 'open' THEN NULL ELSE 1 END::INT AS n_gaps,
CASE state WHEN 'empty' THEN 'critical' WHEN 'failed' THEN 'major' END AS severity, CASE state WHEN 'skip' THEN 0 WHEN 'empty' THEN 2 WHEN 'failed' THEN 1 END::INT AS n_recommendations FROM df""")(
    lambda t: report.article_defaults(_cases(t)).select("doc_id", "article", "score", F.size("gaps").alias("n"), "gaps", "recommendations").select("doc_id", "article", "score", F.when(F.col("gaps").isNotNull(), F.col("n")).alias("n_gaps"), F.try_element_at("gaps", F.lit(1))["severity"].alias("severity"), F.when(F.col("recommendations").isNotNull(), F.size("recommendations")).alias("n_recommendations"))
)
_scores = lambda t: report.article_scores(report.article_defaults(_cases(t)))
_SCORES = _DEFAULT + """, gp AS (SELECT *, CASE state WHEN 'open' THEN
  list_filter([{'t': substr(text, 1, 80), 'd': lang || ' is short', 's': CASE WHEN lower(source) IN ('critical', 'major', 'minor') THEN lower(source) ELSE 'minor' END}, {'t': 'Unnamed gap', 'd': 'no title has been given here', 's': CASE WHEN doc_id % 3 = 0 THEN 'critical' ELSE 'minor' END}], lambda g: trim(g.t) <> '' AND trim(g.d) <> '')
  WHEN 'empty' THEN [{'t': 'No documentation found', 'd': 'No section belongs to article ' || article, 's': 'critical'}] WHEN 'failed' THEN [{'t': 'Analysis failed', 'd': 'No analysis of article ' || article, 's': 'major'}] ELSE [] END AS gaps,
  CASE state WHEN 'open' THEN list_filter(['Keep data logs', lang], lambda r: trim(r) <> '') WHEN 'empty' THEN ['Document article ' || article, 'Map requirements to policies'] WHEN 'failed' THEN ['Retry or review by hand'] ELSE [] END AS recs,
  CASE state WHEN 'skip' THEN 100 WHEN 'empty' THEN 0 WHEN 'failed' THEN 30 ELSE least(greatest(n_chars % 140 - 10, 0), 100) END::DOUBLE AS score, CASE WHEN state = 'open' AND n_chars % 3 <> 0 THEN 1 ELSE 0 END AS np FROM df)"""
query("article_scores", f"""WITH {_SCORES} SELECT doc_id, article, score, array_to_string(list_transform(gaps, lambda g: g.s || ':' || g.t || ':' || g.d), '|') AS gaps, array_to_string(recs, '|') AS recommendations, CASE WHEN state = 'open' THEN 'r ' || doc_id ELSE '' END AS reasoning,
CASE WHEN np = 1 THEN CASE WHEN doc_id % 2 = 0 THEN lang ELSE 'R1' END || ':' || source || ':annex:' ELSE '' END AS passages FROM gp""")(
    lambda t: _scores(t).select("doc_id", "article", "score", F.array_join(F.transform("gaps", lambda g: F.concat_ws(":", g["severity"], g["title"], g["description"])), "|").alias("gaps"), F.array_join("recommendations", "|").alias("recommendations"), "reasoning", F.array_join(F.transform("passages", lambda p: F.concat_ws(":", p["title"], p["text"], p["regulation"], p["article_ref"])), "|").alias("passages"))
)
_gates = lambda t: t("documents").select("doc_id", F.when(F.col("doc_id") % 5 == 0, F.array().cast("array<int>")).when(F.col("doc_id") % 5 == 1, F.array(F.lit(5))).when(F.col("doc_id") % 5 == 2, F.array(F.lit(9), F.lit(11))).alias("articles"))
_overall = lambda t: report.overall_scores(_scores(t), _gates(t))
_OVERALL = _SCORES + """, gt AS (SELECT doc_id, CASE doc_id % 5 WHEN 0 THEN [] WHEN 1 THEN [5] WHEN 2 THEN [9, 11] END AS arts FROM documents),
ov AS (SELECT doc_id, round(coalesce(avg(score) FILTER (WHERE arts IS NULL OR list_contains(arts, article)), 100), 1) AS overall, count(*) FILTER (WHERE arts IS NULL OR list_contains(arts, article)) = 0 AS scope_empty FROM gp JOIN gt USING (doc_id) GROUP BY 1)"""
query("overall_score", f"WITH {_OVERALL} SELECT * FROM ov")(_overall)
query("risk_tier", """SELECT doc_id, CASE WHEN p THEN 'prohibited' WHEN h THEN 'high' WHEN p IS NULL AND h IS NULL THEN lang ELSE 'minimal' END AS tier FROM (SELECT doc_id, lang, CASE WHEN doc_id % 3 < 2 THEN n_chars % 5 = 0 END AS p, CASE WHEN doc_id % 3 < 2 THEN n_chars % 2 = 0 END AS h FROM documents)""")(
    lambda t: t("documents").select("doc_id", report.risk_tier(F.when(F.col("doc_id") % 3 < 2, F.col("n_chars") % 5 == 0), F.when(F.col("doc_id") % 3 < 2, F.col("n_chars") % 2 == 0), F.col("lang")).alias("tier"))
)


def _trust(t) -> DataFrame:
    known = _row_audits(t("documents"), "n_chars")
    actor = F.when(F.col("doc_id") % 9 == 0, "unknown").otherwise(F.col("actor.actor"))
    duties = F.when(F.col("doc_id") % 5 > 0, F.col("coverage.total"))
    chunks = F.col("n_chars") % 6
    return known.select("doc_id", actor.alias("actor"), F.when(F.col("doc_id") % 4 > 0, F.col("actor.confidence")).alias("actor_confidence"), duties.alias("total_obligations"), F.col("coverage.mean_coverage").alias("coverage"), (F.col("n_chars") % 2 == 0).alias("is_high_risk"), chunks.alias("n_chunks"), F.least(chunks, F.col("doc_id") % 4).alias("n_classified"))


_TRUST = ITEMS + """, em AS (SELECT doc_id, count(*) AS total, avg(coverage) AS cov FROM items GROUP BY 1),
tu AS (SELECT doc_id, CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE actor END AS actor, CASE WHEN doc_id % 4 > 0 THEN confidence END AS ac, CASE WHEN doc_id % 5 > 0 THEN coalesce(total, 0) END AS tot, coalesce(cov, 0) AS cov, n_chars % 2 = 0 AS hi, n_chars % 6 AS nch, least(n_chars % 6, doc_id % 4) AS ncl FROM documents JOIN roles USING (doc_id) LEFT JOIN em USING (doc_id)),
tv AS (SELECT doc_id, actor, list_filter([ac, CASE WHEN tot > 0 THEN 0.5 + cov / 2 WHEN tot = 0 AND hi THEN 0.5 END, CASE WHEN nch > 0 THEN ncl / nch END], lambda x: x IS NOT NULL) AS parts FROM tu),
tr AS (SELECT doc_id, CASE WHEN len(parts) = 0 THEN 1.0 ELSE list_avg(parts) END AS mean, actor FROM tv), ts AS (SELECT doc_id, round(mean, 2) AS confidence, mean < 0.7 OR actor = 'unknown' AS needs_review FROM tr)"""
query("confidence_review", f"WITH {_TRUST} SELECT * FROM ts")(lambda t: report.confidence_review(_trust(t)))


def _reports(t) -> DataFrame:
    docs = t("documents").select("doc_id", "lang", "source")
    return report.build_reports(docs, _scores(t), _overall(t), report.confidence_review(_trust(t)), [*ARTICLES, 13])


query("build_reports", f"""WITH {_OVERALL}, {_TRUST.removeprefix("WITH ")}, rp AS (SELECT doc_id, string_agg(article || ':' || score::INT || ':' || chunks || ':' || len(gaps), ',' ORDER BY article) || ',13:0:0:0' AS arts FROM gp GROUP BY 1)
SELECT d.doc_id, lang, source, arts, overall, confidence, needs_review FROM documents d JOIN rp USING (doc_id) JOIN ov USING (doc_id) JOIN ts USING (doc_id)""")(
    lambda t: _reports(t).select("doc_id", "lang", "source", F.array_join(F.transform("article_scores", lambda a: F.concat_ws(":", a["article"], a["score"].cast("int"), a["chunk_count"], F.size(a["gaps"]))), ",").alias("arts"), "overall", "confidence", "needs_review")
)
BACKEND, VERSIONS = "rules", {"classifier": "3", "retrieval": "2"}


def _full_reports(t) -> DataFrame:
    known = _row_audits(t("documents"), "lang", "source", "n_chars")
    doc, n, none = F.col("doc_id"), F.col("n_chars"), F.lit(None)
    gates = F.when(doc % 5 == 0, F.array().cast("array<int>")).when(doc % 5 == 1, F.array(F.lit(5))).when(doc % 5 == 2, F.array(F.lit(9), F.lit(11)))
    audits = known.select(
        "doc_id",
        F.col("lang").alias("language"),
        F.array("source").alias("source_files"),
        (n % 6).alias("total_chunks"),
        F.least(n % 6, doc % 4).alias("classified_chunks"),
        F.col("source").alias("fallback_tier"),
        F.when(n % 2 == 0, "high").alias("wizard_tier"),
        F.struct((n % 3 == 0).alias("detected"), F.when(n % 3 == 0, "workplace").alias("context")).alias("emotion"),
        F.when(doc % 4 > 0, F.struct(F.when(doc % 9 == 0, "unknown").otherwise(F.col("actor.actor")).alias("actor"), F.col("actor.confidence"))).alias("actor"),
        F.when(gates.isNotNull(), F.struct(gates.alias("articles"), (n % 10 == 0).alias("is_prohibited"), (n % 2 == 0).alias("is_high_risk"))).otherwise(none).alias("applicability"),
        F.when(doc % 5 != 3, F.col("coverage")).alias("evidence"),
    )
    return report.full_reports(audits, _scores(t), dict(zip([*ARTICLES, 13], [*DOMAINS, "users"])), VERSIONS, BACKEND)


query("full_reports", f"""WITH {_OVERALL}, {_TRUST.removeprefix("WITH ")}, ar AS (SELECT doc_id, string_agg(concat_ws(':', article, ({_lit(DOMAINS)})[article - 8], score::INT, chunks, len(gaps), len(recs), CASE WHEN state = 'open' THEN 'r ' || doc_id ELSE '' END, np), '|' ORDER BY article) || '|13:users:0:0:0:0::0' AS arts FROM gp GROUP BY 1),
evr AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE coverage >= 1) AS fully, count(*) FILTER (WHERE coverage > 0 AND coverage < 1) AS part, count(*) FILTER (WHERE coverage = 0) AS missing, avg(coverage) AS cov FROM items GROUP BY 1),
fr AS (SELECT d.doc_id, d.lang, d.source, d.n_chars, ar.arts AS arts, gt.arts AS gate, actor AS role, confidence, coalesce(total, 0) AS total, coalesce(fully, 0) AS fully, coalesce(part, 0) AS part, coalesce(missing, 0) AS missing, coalesce(cov, 0) AS cov, (SELECT round(coalesce(sum(score) FILTER (WHERE gt.arts IS NULL OR list_contains(gt.arts, gp.article)) / count(*) FILTER (WHERE gt.arts IS NULL OR list_contains(gt.arts, gp.article)) * CASE WHEN gt.arts IS NULL THEN 0.8 ELSE 1 END, 100), 1) FROM gp WHERE gp.doc_id = d.doc_id) AS overall
  FROM documents d JOIN ar USING (doc_id) JOIN gt USING (doc_id) JOIN roles USING (doc_id) LEFT JOIN evr USING (doc_id)),
ft AS (SELECT *, list_filter([CASE WHEN doc_id % 4 > 0 THEN confidence END, CASE WHEN doc_id % 5 = 3 THEN NULL WHEN total > 0 THEN 0.5 + cov / 2 WHEN gate IS NOT NULL AND n_chars % 2 = 0 THEN 0.5 END, CASE WHEN n_chars % 6 > 0 THEN least(n_chars % 6, doc_id % 4) / (n_chars % 6) END], lambda x: x IS NOT NULL) AS parts FROM fr),
fm AS (SELECT *, CASE WHEN len(parts) = 0 THEN 1.0 ELSE list_avg(parts) END AS mean, CASE WHEN doc_id % 4 > 0 THEN CASE WHEN doc_id % 9 = 0 THEN 'unknown' ELSE role END END AS who FROM ft)
SELECT doc_id, lang AS language, source AS source_files, n_chars % 6 AS total_chunks, least(n_chars % 6, doc_id % 4) AS classified_chunks, CASE WHEN n_chars % 2 = 0 THEN 'high' END AS wizard_tier, n_chars % 3 = 0 AS emotion, who, array_to_string(gate, ',') AS gate, CASE WHEN doc_id % 5 <> 3 THEN concat_ws(':', total, fully, part, missing) END AS evidence, arts, round(overall, 6) AS overall_score,
CASE WHEN gate IS NULL THEN source WHEN n_chars % 10 = 0 THEN 'prohibited' WHEN n_chars % 2 = 0 THEN 'high' ELSE 'minimal' END AS risk_tier, round(mean, 2) AS confidence_score, mean < 0.7 OR coalesce(who = 'unknown', false) AS requires_human_review, 'rules' AS classifier_backend, 'classifier=3,retrieval=2' AS versions FROM fm""")(
    lambda t: _full_reports(t).select("doc_id", "language", F.array_join("source_files", ",").alias("source_files"), "total_chunks", "classified_chunks", "wizard_tier", F.col("emotion.detected").alias("emotion"), F.col("actor.actor").alias("who"), F.array_join(F.col("applicability.articles").cast("array<string>"), ",").alias("gate"), F.when(F.col("evidence").isNotNull(), F.concat_ws(":", "evidence.total", "evidence.fully", "evidence.partial", "evidence.missing")).alias("evidence"), F.array_join(F.transform("article_scores", lambda a: F.concat_ws(":", a["article"], a["domain"], a["score"].cast("int"), a["chunk_count"], F.size(a["gaps"]), F.size(a["recommendations"]), a["reasoning"], F.size(a["passages"]))), "|").alias("arts"), "overall_score", "risk_tier", "confidence_score", "requires_human_review", "classifier_backend", F.array_join(F.transform(F.map_entries("model_versions"), lambda e: F.concat_ws("=", e["key"], e["value"])), ",").alias("versions"))
)
VOCABULARY = ["data", "record", "article", "requirement"]
_PROBLEMS = _SCORES + f""", pb AS (SELECT doc_id, article, 'no passages' AS problem FROM gp WHERE chunks > 0 AND np = 0 UNION ALL
SELECT doc_id, article, 'short description' FROM (SELECT doc_id, article, unnest(gaps) AS g FROM gp) WHERE len(list_filter(string_split_regex(trim(g.d), '\\s+'), lambda w: w <> '')) < 4 UNION ALL
SELECT doc_id, article, 'not grounded' FROM (SELECT doc_id, article, unnest(recs) AS r FROM gp) WHERE NOT ({" OR ".join(f"contains(lower(r), '{w}')" for w in VOCABULARY)}))"""
query("grounding", f"WITH {_PROBLEMS} SELECT * FROM pb")(lambda t: report.grounding_checks(_scores(t), VOCABULARY))
query("citation_rate", f"""WITH {_PROBLEMS}, r AS (SELECT avg((np > 0)::INT) AS rate FROM gp WHERE chunks > 0), n AS (SELECT count(*) AS violations FROM pb) SELECT round(rate, 6) AS rate, violations, CASE WHEN rate >= 0.9 AND violations = 0 THEN 'pass' WHEN rate >= 0.75 THEN 'warn' ELSE 'fail' END AS status FROM r, n""")(
    lambda t: report.citation_rate(_scores(t), report.grounding_checks(_scores(t), VOCABULARY))
)


def _checked(t) -> DataFrame:
    a = F.transform(F.sequence(F.lit(9), F.lit(15)), lambda x: F.struct((F.col("n_chars") % 120).cast("double").alias("score"), F.lit(1).alias("chunk_count"), F.array(F.struct(F.col("lang").alias("title"), F.when(F.col("doc_id") % 4 > 0, "d").otherwise("").alias("description"))).alias("gaps"), F.when(x > 9, "r").otherwise(F.col("lang")).alias("reasoning")))
    rows = t("documents").select("doc_id", (F.col("n_chars") % 120).cast("double").alias("overall"), F.when(F.col("doc_id") % 3 > 0, F.lit(0.5)).alias("confidence"), F.when(F.col("doc_id") % 5 > 0, F.when(F.col("doc_id") % 7 > 0, "provider").otherwise("agent")).alias("actor"), F.lit(1).alias("articles"), F.lit(0).alias("total_obligations"), F.lit(2).alias("n_chunks"), (F.col("doc_id") % 2 + 1).cast("int").alias("n_classified"), a.alias("article_scores"))
    return report.invariant_checks(rows)


query("invariant_checks", """WITH c AS (SELECT doc_id, (doc_id % 2 = 1)::INT AS a, (n_chars % 120 <= 100)::INT AS b, (doc_id % 4 > 0)::INT AS g, (doc_id % 5 > 0)::INT AS p, (doc_id % 5 > 0 AND doc_id % 7 > 0)::INT AS v, (doc_id % 3 > 0)::INT AS f, (coalesce(lang, '') <> '')::INT AS l FROM documents)
SELECT doc_id, (5 + a + 2 * b - 2 + 1 + g - 1 + p + v + f + 2 * l - 1)::BIGINT AS passed, 12::BIGINT AS total, CASE WHEN 5 + a + 2 * b - 2 + g + p + v + f + 2 * l - 1 = 12 THEN 'pass' WHEN 5 + a + 2 * b - 2 + g + p + v + f + 2 * l - 1 >= 11 THEN 'warn' ELSE 'fail' END AS status FROM c""")(
    lambda t: report.pass_ratio(_checked(t))
)
ORACLES["invariant_checks"] = """WITH c AS (SELECT doc_id, [doc_id % 2 = 1, true, n_chars % 120 <= 100, n_chars % 120 <= 100, coalesce(lang <> '', false), coalesce(lang <> '', false), doc_id % 4 > 0, doc_id % 5 > 0, doc_id % 5 > 0 AND doc_id % 7 > 0, true, true, doc_id % 3 > 0] AS k FROM documents), n AS (SELECT doc_id, len(list_filter(k, lambda x: x)) AS passed FROM c)
SELECT doc_id, passed, 12::BIGINT AS total, CASE WHEN passed = 12 THEN 'pass' WHEN passed = 11 THEN 'warn' ELSE 'fail' END AS status FROM n"""
query("grounded", f"""SELECT conv_id, turn, {" OR ".join(f"contains(lower(text), '{w}')" for w in VOCABULARY)} AS grounded FROM conversations""")(lambda t: t("conversations").select("conv_id", "turn", tx.is_grounded(F.col("text"), VOCABULARY).alias("grounded")))


def _contexts(t) -> DataFrame:
    each = t("conversations").groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "role", "text"))).alias("m"))
    law = F.transform("m", lambda x: F.struct(x["role"].alias("title"), x["text"].alias("text")))
    findings = F.transform(F.filter("m", lambda x: x["turn"] % 2 == 1), lambda x: F.struct(x["text"].alias("requirement"), x["text"].alias("finding")))
    return each.select("conv_id", report.build_context(law, findings, F.transform("m", lambda x: x["text"])).alias("c")).select("conv_id", *[F.sha2(f"c.{k}", 256).alias(k) for k in ("law", "findings", "text")])


query("context_assembly", """WITH m AS (SELECT conv_id, turn, role, text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, role, text) AS i, row_number() OVER (PARTITION BY conv_id, turn % 2 ORDER BY turn, role, text) AS j, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn, role, text) AS k FROM conversations)
SELECT conv_id, sha256(string_agg('[' || role || ']' || chr(10) || substr(text, 1, 400), chr(10) || chr(10) ORDER BY i) FILTER (WHERE i <= 5)) AS law,
sha256(coalesce(string_agg('[' || substr(text, 1, 60) || ']: ' || substr(text, 1, 200), chr(10) ORDER BY j) FILTER (WHERE turn % 2 = 1 AND j <= 10), 'No findings could be extracted.')) AS findings,
sha256(string_agg(text, chr(10) || chr(10) ORDER BY k) FILTER (WHERE k <= 15)) AS text FROM m GROUP BY 1""")(_contexts)

# Retrieval as a whole: documents are passages of an article (by length), of a regulation (by id); embeddings belong to them by id.
_DIM = 64


def _passages(t) -> DataFrame:
    d = t("documents").select("doc_id", (F.col("n_chars") % 3 + 9).cast("int").alias("article"), F.when(F.col("doc_id") % 5 > 0, F.when(F.col("doc_id") % 5 > 1, "ai").otherwise("gdpr")).alias("regulation"), "lang", "text")
    e = t("embeddings").select(F.col("vec_id").alias("doc_id"), "embedding")
    return d.join(broadcast_if_small(e.select("doc_id")), "doc_id", "left_semi").join(e, "doc_id")  # texts of no embedding stay


def _asked(t) -> DataFrame:
    rows = _passages(t).where("doc_id % 50 = 0")
    return rows.select("doc_id", F.col("doc_id").alias("query_id"), F.when(F.col("doc_id") % 100 == 0, F.lit(None).cast("int")).otherwise(F.col("article")).alias("article"), "lang", F.substring("text", 1, 200).alias("text"), "embedding")


def _gate(t) -> DataFrame:
    return t("documents").select("doc_id", F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(9), F.lit(10))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(11))).alias("articles"))


_PASS = "ps AS MATERIALIZED (SELECT doc_id, (n_chars % 3 + 9)::INT AS article, CASE WHEN doc_id % 5 > 1 THEN 'ai' WHEN doc_id % 5 = 1 THEN 'gdpr' END AS regulation, lang, text, embedding::DOUBLE[] AS e FROM documents JOIN embeddings ON vec_id = doc_id)"
_ASK = "aq AS MATERIALIZED (SELECT doc_id % 3 AS d, doc_id AS query_id, CASE WHEN doc_id % 100 > 0 THEN article END AS article, lang, substr(text, 1, 200) AS text, e FROM ps WHERE doc_id % 50 = 0)"
_OPEN = "oq AS MATERIALIZED (SELECT * FROM aq WHERE article IS NULL OR d = 2 OR list_contains(CASE d WHEN 0 THEN [9, 10] ELSE [11] END, article))"
query("gate_chunks", f"WITH {_PASS}, {_ASK}, {_OPEN} SELECT query_id, article FROM oq")(lambda t: retrieval.gate_chunks(_asked(t), _gate(t)).select("query_id", "article"))
query("hybrid_retrieve", f"""WITH {_PASS}, {_ASK}, {_OPEN},
pw AS MATERIALIZED (SELECT p.doc_id, a.article, {TOKENS.format("p.text")} AS ws FROM ps p, LATERAL (SELECT unnest([p.article, NULL]) AS article) a),
sz AS (SELECT article, count(*) AS n, avg(len(ws)) AS avgdl FROM pw GROUP BY 1), po AS MATERIALIZED (SELECT article, doc_id, dl, term, count(*) AS tf FROM (SELECT article, doc_id, len(ws) AS dl, unnest(ws) AS term FROM pw) GROUP BY ALL),
rw AS MATERIALIZED (SELECT po.article, term, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po JOIN sz ON po.article IS NOT DISTINCT FROM sz.article GROUP BY 1, 2), mn AS (SELECT article, avg(raw) AS m FROM rw GROUP BY 1),
ix AS MATERIALIZED (SELECT rw.article, term, CASE WHEN raw < 0 THEN 0.25 * m ELSE raw END AS idf FROM rw JOIN mn ON rw.article IS NOT DISTINCT FROM mn.article),
qt AS (SELECT query_id, article, term, count(*) AS qtf FROM (SELECT query_id, article, unnest({TOKENS.format("text")}) AS term FROM oq) GROUP BY ALL),
bs AS (SELECT query_id, po.doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN ix ON ix.term = qt.term AND ix.article IS NOT DISTINCT FROM qt.article JOIN po ON po.term = qt.term AND po.article IS NOT DISTINCT FROM qt.article JOIN sz ON sz.article IS NOT DISTINCT FROM qt.article GROUP BY 1, 2),
bk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS place FROM bs) WHERE place <= 10 AND score > 0),
vs AS (SELECT oq.query_id, ps.doc_id, round(1 - list_cosine_similarity(ps.e, oq.e), 6) AS distance FROM oq JOIN ps ON (oq.article IS NULL OR oq.article = ps.article) AND ps.regulation = 'ai'),
vk AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY distance, doc_id DESC) AS place FROM vs) WHERE place <= 10),
ls AS (SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (ps.lang IS DISTINCT FROM oq.lang)::INT, place) AS rank, 0 AS list FROM bk JOIN ps USING (doc_id) JOIN oq USING (query_id) WHERE regulation = 'ai' UNION ALL
 SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (ps.lang IS DISTINCT FROM oq.lang)::INT, distance, place), 1 FROM vk JOIN ps USING (doc_id) JOIN oq USING (query_id)),
fu AS (SELECT query_id, doc_id, round(sum(1.0 / (60 + rank)), 9) AS f, min((list, rank)) AS first FROM ls GROUP BY 1, 2), fr AS (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY f DESC, first, doc_id) AS r FROM fu),
ov AS (SELECT fr.query_id, fr.doc_id, r, round(len(list_intersect(list_distinct({TOKENS.format("oq.text")}), list_distinct({TOKENS.format("ps.text")}))) / greatest(len(list_distinct({TOKENS.format("oq.text")})), 1), 6) AS score FROM fr JOIN oq USING (query_id) JOIN ps USING (doc_id))
SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT query_id, doc_id, score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, r) AS rank FROM ov) WHERE rank <= 5""")(
    lambda t: retrieval.hybrid_retrieve(_asked(t), _passages(t), _gate(t), regulation="ai")
)
query("flatten_hits", """SELECT conv_id AS query_id, rank::INT AS rank, turn AS id, text, turn / 2.0::DOUBLE AS distance FROM (SELECT conv_id, turn, CASE WHEN turn % 3 = 0 THEN '' ELSE text END AS text, row_number() OVER (PARTITION BY conv_id ORDER BY turn, text) AS rank FROM conversations) WHERE text <> ''""")(
    lambda t: retrieval.flatten_hits(t("conversations").groupBy(F.col("conv_id").alias("query_id")).agg(F.array_sort(F.collect_list(F.struct("turn", "text"))).alias("m")).select("query_id", F.transform("m", lambda x: x["turn"]).alias("ids"), F.transform("m", lambda x: F.when(x["turn"] % 3 == 0, "").otherwise(x["text"])).alias("documents"), F.transform("m", lambda x: x["turn"] / 2).alias("distances")))
)
query("language_rank", """SELECT query_id, doc_id, row_number() OVER (PARTITION BY query_id ORDER BY (lang <> 'en')::INT, distance, doc_id)::INT AS rank FROM (SELECT n_chars % 10 AS query_id, doc_id, lang, n_chars % 7 / 2.0 AS distance FROM documents)""")(
    lambda t: retrieval.language_rank(t("documents").select((F.col("n_chars") % 10).alias("query_id"), "doc_id", "lang", F.lit("en").alias("query_lang"), (F.col("n_chars") % 7 / 2).alias("distance"), F.col("doc_id").alias("place"))).select("query_id", "doc_id", "rank")
)
query("load_corpus", "SELECT count(*) AS passages, count(DISTINCT source) AS partitions FROM documents WHERE coalesce(text, '') <> '' AND n_chars % 2 = 0")(lambda t: retrieval.load_corpus(t("documents").withColumn("text", F.when(F.col("n_chars") % 2 == 0, F.col("text"))), "source")[1])
query("overlap_rerank", f"""WITH d AS (SELECT conv_id AS query_id, turn AS doc_id, text, first_value(text) OVER (PARTITION BY conv_id ORDER BY turn) AS q, turn + 1 AS rank FROM conversations), o AS (SELECT query_id, doc_id, rank, round(len(list_intersect(list_distinct({TOKENS.format("q")}), list_distinct({TOKENS.format("text")}))) / greatest(len(list_distinct({TOKENS.format("q")})), 1), 6) AS overlap FROM d)
SELECT query_id, doc_id, overlap, new_rank::INT AS new_rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY overlap DESC, rank) AS new_rank FROM o) WHERE new_rank <= 3""")(
    lambda t: retrieval.overlap_rerank(t("conversations").join(t("conversations").groupBy(F.col("conv_id").alias("c")).agg(F.min_by("text", "turn").alias("query_text")), F.col("conv_id") == F.col("c")).select(F.col("conv_id").alias("query_id"), F.col("turn").alias("doc_id"), "text", "query_text", (F.col("turn") + 1).alias("rank")), 3).select("query_id", "doc_id", "overlap", "new_rank")
)
_rel = lambda t: retrieval.knn(t("embeddings").where("vec_id % 100 = 0"), t("embeddings"), 5).join(t("embeddings").select("vec_id", "label"), "vec_id").join(t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("relevant", F.col("label") == F.col("ql"))
query("precision_gate", """WITH k AS (SELECT q.vec_id AS query_id, q.label = v.label AS rel, row_number() OVER (PARTITION BY q.vec_id ORDER BY round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6), v.vec_id) AS rank FROM embeddings v JOIN embeddings q ON q.vec_id <> v.vec_id AND q.vec_id % 100 = 0),
h AS (SELECT query_id, max((rel AND rank <= 3)::INT) AS hit FROM k WHERE rank <= 5 GROUP BY 1) SELECT sum(hit)::BIGINT AS hits, count(*) AS queries, round(avg(hit), 6) AS precision, avg(hit) >= 0.8 AS passed FROM h""")(lambda t: evaluate.precision_gate(_rel(t)))
