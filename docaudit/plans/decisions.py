"""Queries of decisions: gates, entities, classifiers."""

from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel

from docaudit.functions import text as tx
from docaudit.operators import classify, evaluate, evidence, prep, rules, scorers, segment
from docaudit.plans.catalog import HITS, OBLIGATIONS, PACK, SYNONYMS, _audits, _lit, _obligations, query, values

_CAPS = [("AI_SYSTEM", r"(?a)\b[Oo]ur [a-z]+"), ("PROHIBITED_USE", r"(?a)\b[A-Z]{5,}\b"), ("RISK_TIER", r"(?a)\b[Hh]igh risk\b"), ("NAME", r"(?a)\b[A-Z][a-z]{9,}\b")]


def _spans(t) -> DataFrame:
    """Entities with their text; a document is its own chunk."""
    spans = rules.annotate(t("documents"), _CAPS, [])
    text = F.substring(F.col("text"), F.col("start") + 1, F.col("end") - F.col("start"))
    return spans.join(t("documents").select("doc_id", "text"), "doc_id").select("doc_id", F.col("doc_id").alias("chunk_id"), "start", "end", "label", text.alias("text"))


_ENTS = r"""en AS (SELECT doc_id, 'AI_SYSTEM' AS label, unnest(regexp_extract_all(text, '\b[Oo]ur [a-z]+')) AS text FROM documents UNION ALL SELECT doc_id, 'PROHIBITED_USE', unnest(regexp_extract_all(text, '\b[A-Z]{5,}\b')) FROM documents
UNION ALL SELECT doc_id, 'RISK_TIER', unnest(regexp_extract_all(text, '\b[Hh]igh risk\b')) FROM documents)"""
query("actor_vote_entities", f"""WITH {HITS}, {_ENTS}, sg AS (SELECT doc_id, rule_group AS g FROM hits UNION ALL SELECT doc_id, 'g1' FROM (SELECT DISTINCT doc_id, text FROM en WHERE label = 'AI_SYSTEM' AND lower(text) LIKE 'our %')),
votes AS (SELECT doc_id, g, count(*) AS n FROM sg GROUP BY ALL), places AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, g) AS p FROM votes),
won AS (SELECT doc_id, max(g) FILTER (WHERE p = 1) AS actor, max(n) FILTER (WHERE p = 1) AS win, coalesce(max(n) FILTER (WHERE p = 2), 0) AS second, sum(n) AS total FROM places GROUP BY 1)
SELECT d.doc_id, coalesce(actor, 'g2') AS actor, round(CASE WHEN total IS NULL THEN 0.3 ELSE least(1, 0.7::DOUBLE * win::DOUBLE / total::DOUBLE + 0.3::DOUBLE * (win - second)::DOUBLE / win::DOUBLE) END::DOUBLE, 2) AS confidence FROM documents d LEFT JOIN won USING (doc_id)""")(
    lambda t: rules.actor_vote(t("documents"), PACK, ["g1", "g2", "g3"], "g2", _spans(t).where("label = 'AI_SYSTEM'"))
)
_pred = lambda t: t("labels").join(t("documents"), "doc_id").select("doc_id", F.when(F.col("quality") == 1, "provider").otherwise("robot").alias("label"), (F.col("n_chars") % 100 / 100).alias("confidence"))
query("actor_override", """SELECT d.doc_id, CASE WHEN n_chars % 100 >= 80 AND quality IS NOT NULL THEN CASE WHEN quality = 1 THEN 'provider' ELSE 'unknown' END ELSE 'deployer' END AS actor, CASE WHEN n_chars % 100 >= 80 AND quality IS NOT NULL THEN n_chars % 100 / 100.0 ELSE 0.3 END::DOUBLE AS confidence FROM documents d LEFT JOIN labels USING (doc_id)""")(
    lambda t: rules.apply_override(t("documents").select("doc_id", F.lit("deployer").alias("actor"), F.lit(0.3).alias("confidence")), _pred(t), known=("provider", "deployer", "importer", "distributor"))
)
query("category_obligations", f"""WITH {HITS}, k AS (SELECT doc_id, rule_group AS category, string_agg(label, ',' ORDER BY rule_idx) AS keywords FROM hits GROUP BY 1, 2)
SELECT doc_id, category, keywords, CASE category WHEN 'g1' THEN 'A1' ELSE 'AIACT_ART6_ANNEXIII_CAT' || category END AS obligation_id, CASE category WHEN 'g1' THEN 'x,y' ELSE '' END AS evidence FROM k""")(
    lambda t: rules.category_matches(t("documents"), PACK, t("documents").sparkSession.createDataFrame([("g1", "A1", ["x", "y"])], "category string, id string, evidence_required array<string>")).select("doc_id", "category", "keywords", "obligation_id", F.array_join("evidence_required", ",").alias("evidence"))
)
query("entity_signals", f"""WITH {_ENTS} SELECT doc_id, count(DISTINCT text)::INT AS n FROM en WHERE label = 'PROHIBITED_USE' GROUP BY 1""")(lambda t: rules.entity_signals(_spans(t), "PROHIBITED_USE").select("doc_id", F.size("signals").alias("n")))
_preds = lambda t: t("documents").select("doc_id", F.when(F.col("doc_id") % 2 == 0, "high_risk").otherwise("prohibited").alias("label"), (F.col("n_chars") % 100 / 100).alias("confidence")).where("doc_id % 10 < 4")
_SAFETY = [("s", 0, "tion", "tion"), ("s", 1, "heit", "heit"), ("s", 2, "keit", "keit")]
_BAN = [("b", 0, "queen", "queen"), ("b", 1, "king", "king")]
_LOW = "(SELECT doc_id, contains(lower(text), 'queen')::INT AS q, contains(lower(text), 'king')::INT AS k, contains(lower(text), 'tion')::INT + contains(lower(text), 'heit')::INT + contains(lower(text), 'keit')::INT AS s, n_chars % 100 AS c FROM documents)"
query("decide", f"""WITH {HITS}, {_ENTS}, ct AS (SELECT doc_id, count(*) AS c FROM hits WHERE rule_group = 'g1' GROUP BY 1), pe AS (SELECT DISTINCT doc_id FROM en WHERE label = 'PROHIBITED_USE'), re AS (SELECT DISTINCT doc_id FROM en WHERE label = 'RISK_TIER'),
a AS (SELECT l.doc_id, q + k > 0 OR pe.doc_id IS NOT NULL OR (l.doc_id % 10 < 4 AND l.doc_id % 2 = 1 AND l.c >= 85) AS p, ct.c IS NOT NULL OR s >= 2 OR re.doc_id IS NOT NULL OR (l.doc_id % 10 < 4 AND l.doc_id % 2 = 0 AND l.c >= 85) AS h FROM {_LOW} l LEFT JOIN ct USING (doc_id) LEFT JOIN pe USING (doc_id) LEFT JOIN re USING (doc_id))
SELECT doc_id, p AS is_prohibited, NOT p AND h AS is_high_risk, CASE WHEN p THEN '5' WHEN h THEN '9,10,11,12,13,14,15' ELSE '' END AS articles, CASE WHEN p THEN 'prohibited' WHEN h THEN 'high risk' ELSE 'no category, no safety signals' END AS why FROM a""")(
    lambda t: rules.decide(t("documents"), _BAN, PACK[:2], _SAFETY, _spans(t), _preds(t)).select("doc_id", "is_prohibited", "is_high_risk", F.array_join(F.col("articles").cast("array<string>"), ",").alias("articles"), F.substring_index("reasoning", ":", 1).alias("why"))
)
query("tier_mismatch", "SELECT event_id, CASE WHEN event_type = 'signup' THEN 'true' WHEN event_type = 'purchase' THEN 'false' END AS mismatch FROM events")(
    lambda t: t("events").select("event_id", rules.tier_mismatch(F.lit("high"), F.when(F.col("event_type") == "signup", " Minimal").when(F.col("event_type") == "purchase", "HIGH").otherwise("soon")).cast("string").alias("mismatch"))
)
_V = "array_to_string([CASE WHEN contains(lower(text), 'heit') THEN 0 ELSE -1 END, CASE WHEN contains(lower(text), 'tion') AND NOT contains(lower(text), 'data') AND NOT contains(lower(text), 'code') THEN 1 ELSE -1 END], ',')"
query("lf_votes_unrelated", f"SELECT doc_id, {_V} AS votes FROM documents")(lambda t: t("documents").select("doc_id", F.array_join(rules.lf_votes(F.col("text"), [["heit"]], (["tion"], ["data", "code"])).cast("array<string>"), ",").alias("votes")))
query("group_entities", r"""WITH e AS (SELECT doc_id, 'PROHIBITED_USE' AS label, regexp_extract_all(text, '\b[A-Z]{5,}\b') AS ts FROM documents UNION ALL SELECT doc_id, 'RISK_TIER', regexp_extract_all(text, '\b[Hh]igh risk\b') FROM documents UNION ALL SELECT doc_id, 'NAME', regexp_extract_all(text, '\b[A-Z][a-z]{9,}\b') FROM documents UNION ALL SELECT doc_id, 'AI_SYSTEM', regexp_extract_all(text, '\b[Oo]ur [a-z]+') FROM documents)
SELECT doc_id, string_agg(label || '=' || array_to_string(ts, ','), ';' ORDER BY label) AS entities FROM e WHERE len(ts) > 0 GROUP BY 1""")(
    lambda t: rules.group_entities(_spans(t)).select("doc_id", F.array_join(F.transform(F.array_sort(F.map_entries("entities")), lambda e: F.concat(e["key"], F.lit("="), F.array_join(e["value"], ","))), ";").alias("entities"))
)
query("entity_records", r"""WITH e AS (SELECT doc_id, text, len(regexp_extract_all(text, '\b[A-Z]{5,}\b')) AS n FROM documents) SELECT doc_id, sha256(text) AS text_key, n::INT AS n FROM e WHERE n > 0""")(
    lambda t: rules.entity_records(t("documents").select("doc_id", "text"), _spans(t).where("label = 'PROHIBITED_USE'")).select("doc_id", F.sha2("text", 256).alias("text_key"), F.size("entities").alias("n"))
)
_entail = lambda t: t("conversations").select(F.col("conv_id").alias("doc_id"), F.col("role").alias("term"), "turn", F.array((F.length("text") % 10 / 10), (F.col("turn") % 10 / 10), F.lit(0.4)).alias("scores"))
query("entail_gate", """SELECT c.conv_id AS doc_id, c.role AS term FROM conversations c WHERE length(text) % 10 >= 5 AND length(text) % 10 >= turn % 10 AND NOT EXISTS (SELECT 1 FROM conversations h WHERE h.conv_id = c.conv_id AND h.role = c.role AND h.turn = 4)""")(
    lambda t: rules.entail_gate(_entail(t), _entail(t).where("turn = 4"), ["entailment", "neutral", "contradiction"])
)
query("domain_map", "SELECT o_orderkey, CASE o_custkey % 4 WHEN 0 THEN 'risk' WHEN 1 THEN 'data' END AS domain, CASE o_custkey % 4 WHEN 0 THEN 9 WHEN 1 THEN 10 END::INT AS article FROM orders")(
    lambda t: t("orders").select("o_orderkey", rules.domain_of((F.col("o_custkey") % 4 + 9).cast("int"), {9: "risk", 10: "data"}).alias("domain")).withColumn("article", rules.article_of(F.col("domain"), {9: "risk", 10: "data"}))
)
query("correct_domain", "SELECT doc_id, CASE WHEN n_chars % 2 = 0 AND doc_id % 3 = 0 THEN 'risk' WHEN n_chars % 2 = 0 THEN 'unrelated' ELSE 'data' END AS domain FROM documents")(
    lambda t: rules.correct_domain(t("documents").select("doc_id", F.when(F.col("n_chars") % 2 == 0, "unrelated").otherwise("data").alias("domain"), F.when(F.col("doc_id") % 3 == 0, F.array(F.lit(9))).when(F.col("doc_id") % 3 == 1, F.array(F.lit(9), F.lit(10))).otherwise(F.array().cast("array<int>")).alias("articles")), {9: "risk", 10: "data"}).select("doc_id", "domain")
)


def _labelled(t) -> DataFrame:
    return t("documents").select("doc_id", "text", F.col("lang").alias("truth"), F.pmod(F.xxhash64("doc_id"), F.lit(5)).alias("fold"))


def _counts(rows: DataFrame) -> DataFrame:
    """Hashed words in place of texts, held for both the model and its predictions."""
    return classify.hashed(rows).drop("text").persist(StorageLevel.MEMORY_AND_DISK)


def _chunk_classes(t) -> DataFrame:
    """Languages as classes: a model of four fifths of the documents names all."""
    rows = _counts(_labelled(t))
    model = classify.train(rows.where("fold > 0"), "truth")
    return classify.predict(rows, model, fallback="unrelated").select("doc_id", "truth", "fold", "label", F.round("confidence", 4).alias("confidence"), "backend")


query("chunk_classifier")(_chunk_classes)
query("document_classifier")(lambda t: (lambda rows: classify.predict(rows, classify.train(rows.where("doc_id % 5 > 0"), "truth"), least=0.8, fallback="unknown").select("doc_id", "truth", "label", F.round("confidence", 4).alias("confidence")))(_counts(t("labels").join(t("documents"), "doc_id").select("doc_id", "text", F.when(F.col("quality") == 1, "good").otherwise("bad").alias("truth")))))

_TEXTS = [("ai", 9, "en", "nine"), ("ai", 9, "de", "neun"), ("ai", 10, "en", "ten"), ("gdpr", 9, "de", "dsgvo")]
query("article_text", f"""SELECT o_orderkey, coalesce(a.text, b.text, '') AS text FROM (SELECT o_orderkey, CASE WHEN o_custkey % 3 = 0 THEN 'gdpr' ELSE 'ai' END AS regulation, (9 + o_custkey % 2)::INT AS article, CASE WHEN o_orderkey % 2 = 0 THEN 'de' ELSE 'fr' END AS lang FROM orders) k
LEFT JOIN {values(_TEXTS, "regulation, article, lang, text")} a USING (regulation, article, lang) LEFT JOIN (SELECT * FROM {values(_TEXTS, "regulation, article, lang, text")} x WHERE lang = 'en') b USING (regulation, article)""")(
    lambda t: evidence.article_text(t("orders").select("o_orderkey", F.when(F.col("o_custkey") % 3 == 0, "gdpr").otherwise("ai").alias("regulation"), (9 + F.col("o_custkey") % 2).cast("int").alias("article"), F.when(F.col("o_orderkey") % 2 == 0, "de").otherwise("fr").alias("lang")), t("orders").sparkSession.createDataFrame(_TEXTS, "regulation string, article int, lang string, text string")).select("o_orderkey", "text")
)
query("evidence_chunks", f"""WITH s AS (SELECT * FROM {values([(k, w) for k, ws in SYNONYMS.items() for w in ws] + [("tion", "tion")], "term, w")} v) SELECT conv_id AS doc_id, term, turn AS chunk_id FROM (SELECT DISTINCT conv_id, term, turn FROM conversations JOIN s ON contains(lower(text), w))""")(
    lambda t: evidence.evidence_hits(t("conversations").select(F.col("conv_id").alias("doc_id"), "turn", "text"), SYNONYMS, ["licence", "tion"], chunk="turn").select("doc_id", "term", "chunk_id")
)
query("validate_obligations", "SELECT CAST(o_orderkey AS VARCHAR) AS obligation_id, p AS problem FROM (SELECT o_orderkey, unnest(list_filter([CASE WHEN o_custkey % 5 = 0 THEN 'article zero' END, CASE WHEN o_orderstatus = 'F' THEN 'unknown actor' END, CASE WHEN o_custkey % 3 = 0 THEN 'blank evidence' END, CASE WHEN o_custkey % 3 = 1 THEN 'no synonyms' END], lambda x: x IS NOT NULL)) AS p FROM orders)")(
    lambda t: evidence.validate_obligations(t("orders").select(F.col("o_orderkey").cast("string").alias("obligation_id"), (F.col("o_custkey") % 5).cast("int").alias("article_num"), F.array("o_orderstatus").alias("actor"), F.array(F.when(F.col("o_custkey") % 3 == 0, " ").when(F.col("o_custkey") % 3 == 1, "zzz").otherwise("licence")).alias("evidence_required")), ["O", "P"], ["licence"])
)
query("span_prf", r"""WITH s AS (SELECT doc_id, unnest(regexp_extract_all(text, '\b[A-Z]{5,}\b')) AS x FROM documents), p AS (SELECT count(*) AS n FROM s), h AS (SELECT count(*) AS n FROM s WHERE doc_id % 2 = 0), g AS (SELECT count(*) AS n FROM s WHERE doc_id % 3 > 0), b AS (SELECT count(*) AS n FROM s WHERE doc_id % 2 = 0 AND doc_id % 3 > 0)
SELECT label, b.n AS tp, h.n - b.n AS fp, g.n - b.n AS fn, round(b.n / h.n, 6) AS precision, round(b.n / g.n, 6) AS recall, round(2 * (b.n / h.n) * (b.n / g.n) / (b.n / h.n + b.n / g.n), 6) AS f1 FROM b, h, g, (SELECT unnest(['CAPS', NULL]) AS label)""")(
    lambda t: (lambda s: evaluate.span_prf(s.where("doc_id % 2 = 0"), s.where("doc_id % 3 > 0")))(rules.annotate(t("documents"), [("CAPS", r"(?a)\b[A-Z]{5,}\b")], []))
)


def _weak_job(t) -> DataFrame:
    """Sentences, less those that stand in the benchmark, labelled by votes, the first of each text."""
    pack = [(g, 10 * k + i, p, label) for k, (g, i, p, label) in enumerate(PACK)]
    s = segment.split_sentences(t("documents")).select((F.col("doc_id") * 10_000 + F.col("sentence_index")).alias("doc_id"), F.col("sentence").alias("text"))
    s = prep.skip_existing(s, t("benchmark").select("text"))
    labelled = s.join(rules.weak_label_vote(s, pack), "doc_id")
    return prep.dedupe_first(labelled, "doc_id").select(F.col("doc_id").alias("sentence_id"), "label")


query("weak_label_job")(_weak_job)


def _unavailable():
    raise FileNotFoundError("no model here")


#: A backend that is missing in every worker, and the one that stands in for it.
_BACKENDS = [scorers.Scorer("large", _unavailable), scorers.word_vote("words", {"transparency": ["the", "and"], "security": ["und", "der"]})]
query("score_backends", """WITH w AS (SELECT doc_id, string_split_regex(lower(text), '[^a-z]+') AS ws FROM documents), n AS (SELECT doc_id, len(list_filter(ws, lambda w: w IN ('the', 'and'))) AS a, len(list_filter(ws, lambda w: w IN ('und', 'der'))) AS b FROM w)
SELECT doc_id, CASE WHEN a + b = 0 THEN 'unrelated' WHEN a >= b THEN 'transparency' ELSE 'security' END AS label, round(coalesce(greatest(a, b) / nullif(a + b, 0), 0), 6) AS confidence, 'words' AS backend FROM n""")(
    lambda t: scorers.classify_chunks(t("documents").select("doc_id", "text"), _BACKENDS).drop("text")
)
