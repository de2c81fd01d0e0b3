"""Queries over the driver's tables, one for each operator, and the SQL that gives the same rows."""

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.functions import text as tx
from docaudit.operators import evaluate, evidence, monitor, packs, postings, prep, registry, report, retrieval, rules, segment, vectors
from docaudit.sources import pages, readers

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLES: dict[str, str] = {}


def word(w: str) -> str:
    """A pattern for a word between spaces or marks; ASCII, so that all engines agree."""
    return rf"(?:^|[ \n]){w}(?:[ \n.,]|$)"


#: A test pack over words that the tables hold: group, index, pattern, label.
PACK = [("g1", 0, word("data"), "data"), ("g1", 1, "License", "license"), ("g2", 0, word("und"), "und"), ("g2", 1, word("the"), "the"), ("g3", 0, word("les"), "les"), ("g3", 1, word("para"), "para")]
SYNONYMS = {"licence": ["license", "cc by"], "english": [" of ", " the "], "german": [" und ", " der "], "rights": ["all rights reserved"]}
#: Obligations: id, regulation, article, actors, evidence.
OBLIGATIONS = [("o1", "ai", 9, ["g2"], ["licence", "english"]), ("o2", "ai", 10, [], ["german", "rights"]), ("o3", "gdpr", 13, [], ["english"]), ("o4", "ai", None, ["g1", "g3"], ["rights"]), ("o5", "gdpr", 22, [], [])]


def _lit(x) -> str:
    if x is None:
        return "NULL"
    if isinstance(x, list):
        return "[" + ", ".join(map(_lit, x)) + "]::VARCHAR[]"
    return "'" + x.replace("'", "''") + "'" if isinstance(x, str) else str(x)


def values(rows: list[tuple], names: str) -> str:
    return "(SELECT * FROM (VALUES " + ", ".join("(" + ", ".join(map(_lit, r)) + ")" for r in rows) + f") AS v({names}))"


HITS = f"""hits AS (SELECT doc_id, g AS rule_group, i AS rule_idx, label FROM documents JOIN {values(PACK, "g, i, p, label")} r ON regexp_matches(text, '(?i)' || r.p))"""
TOKENS = r"list_filter(string_split_regex(regexp_replace(lower({}), '[^\p{{L}}\p{{N}}_\s]', ' ', 'g'), '\s+'), lambda t: t <> '')"


def query(name: str, sql: str | None = None):
    def add(f: Callable[..., DataFrame]):
        def run(spark: SparkSession, sf_dir: str) -> DataFrame:
            df = f(lambda table: spark.read.parquet(f"{sf_dir}/{table}.parquet"))
            return df.select(*[F.round(c, 6).alias(c) if kind == "double" else F.col(c) for c, kind in df.dtypes])

        QUERIES[name] = run
        if sql:
            ORACLES[name] = sql
        return f

    return add


def _obligations(spark: SparkSession) -> DataFrame:
    return spark.createDataFrame(OBLIGATIONS, "obligation_id string, regulation string, article_num int, actor array<string>, evidence_required array<string>")


def _audits(docs: DataFrame) -> DataFrame:
    """Role by vote; articles by whether data or license occurs; second regulation by stop words."""
    hits = F.array_compact(F.array(*[F.when(F.col("text").rlike(tx.FLAGS + p), F.lit(g)) for g, _, p, _ in PACK]))
    high = F.col("text").rlike(tx.FLAGS + PACK[0][2])
    gated = docs.select("doc_id", hits.alias("hits"), rules.applicability(F.col("text").contains("queen"), high).alias("articles"), rules.second_gate(F.col("text"), [PACK[3][2]], {22: [PACK[2][2]]}, [5, 13]).alias("gdpr_articles"))
    return gated.select("doc_id", rules.most_hits(F.col("hits"), ["g1", "g2", "g3"], "g2").alias("role"), "articles", "gdpr_articles")


VOTE = HITS + """, votes AS (SELECT doc_id, rule_group, count(*) AS n FROM hits GROUP BY ALL),
places AS (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, rule_group) AS p FROM votes),
won AS (SELECT doc_id, max(rule_group) FILTER (WHERE p = 1) AS actor, max(n) FILTER (WHERE p = 1) AS win, coalesce(max(n) FILTER (WHERE p = 2), 0) AS second, sum(n) AS total FROM places GROUP BY 1),
roles AS (SELECT d.doc_id, coalesce(actor, 'g2') AS actor, round(CASE WHEN total IS NULL THEN 0.3 ELSE least(1, 0.7::DOUBLE * win::DOUBLE / total::DOUBLE + 0.3::DOUBLE * (win - second)::DOUBLE / win::DOUBLE) END::DOUBLE, 2) AS confidence FROM documents d LEFT JOIN won USING (doc_id))"""
AUDITS = VOTE + f""", audits AS (SELECT doc_id, actor AS role,
  CASE WHEN contains(text, 'queen') THEN [5] WHEN regexp_matches(text, '(?i)' || {_lit(PACK[0][2])}) THEN [9, 10, 11, 12, 13, 14, 15] ELSE [] END AS articles,
  CASE WHEN NOT regexp_matches(text, '(?i)' || {_lit(PACK[3][2])}) THEN [] WHEN regexp_matches(text, '(?i)' || {_lit(PACK[2][2])}) THEN [5, 13, 22] ELSE [5, 13] END AS gdpr_articles
  FROM roles JOIN documents USING (doc_id))"""
APPLIES = AUDITS + f""", due AS (SELECT a.doc_id, a.role, o.* FROM audits a JOIN {values(OBLIGATIONS, "obligation_id, regulation, article_num, actor, evidence_required")} o
  ON (len(o.actor) = 0 OR list_contains(o.actor, a.role)) AND (o.article_num IS NULL OR list_contains(CASE WHEN o.regulation = 'gdpr' THEN a.gdpr_articles ELSE a.articles END, o.article_num)))"""
_SYN = values([(t, w, i) for t, ws in SYNONYMS.items() for i, w in enumerate(ws)], "term, w, i")
EVIDENCE = f"ev AS (SELECT DISTINCT doc_id, term FROM documents JOIN {_SYN} s ON contains(lower(text), s.w))"
ITEMS = APPLIES + ", " + EVIDENCE + """, need AS MATERIALIZED (SELECT doc_id, obligation_id || '' AS obligation_id, regulation || '' AS regulation, unnest(CASE WHEN len(evidence_required) = 0 THEN [NULL] ELSE evidence_required END) AS term, generate_subscripts(CASE WHEN len(evidence_required) = 0 THEN [NULL] ELSE evidence_required END, 1) AS pos FROM due),
items AS (SELECT n.doc_id, n.obligation_id, n.regulation, count(n.term) AS n_required, count(ev.term) AS n_satisfied,
  coalesce(string_agg(n.term, ',' ORDER BY n.pos) FILTER (WHERE ev.term IS NULL AND n.term IS NOT NULL), '') AS missing,
  coalesce(string_agg(n.term, ',' ORDER BY n.pos) FILTER (WHERE ev.term IS NOT NULL), '') AS satisfied,
  round(coalesce(count(ev.term) / nullif(count(n.term), 0), 0)::DOUBLE, 3) AS coverage FROM need n LEFT JOIN ev ON ev.doc_id = n.doc_id AND ev.term = n.term GROUP BY 1, 2, 3)"""


def _items(t) -> DataFrame:
    docs = t("documents")
    return evidence.evidence_items(_audits(docs), _obligations(docs.sparkSession), evidence.evidence_hits(docs, SYNONYMS))


query("rule_hits", f"WITH {HITS} SELECT * FROM hits")(lambda t: tx.rule_scan(t("documents"), PACK))
query("actor_vote", f"WITH {VOTE} SELECT * FROM roles")(lambda t: rules.actor_vote(t("documents"), PACK, ["g1", "g2", "g3"], "g2"))
query("category_matches", f"WITH {HITS} SELECT doc_id, rule_group AS category, string_agg(label, ',' ORDER BY rule_idx) AS keywords FROM hits GROUP BY 1, 2")(lambda t: rules.category_matches(t("documents"), PACK))
query("safety_trigger", f"WITH {HITS} SELECT doc_id, count(*) AS n_signals FROM hits GROUP BY 1 HAVING count(*) >= 2")(lambda t: rules.safety_trigger(t("documents"), PACK))
query("applicability", f"WITH {AUDITS} SELECT doc_id, role, array_to_string(articles, ',') AS articles, array_to_string(gdpr_articles, ',') AS gdpr_articles FROM audits")(
    lambda t: _audits(t("documents")).select("doc_id", "role", *[F.array_join(F.col(c).cast("array<string>"), ",").alias(c) for c in ("articles", "gdpr_articles")])
)
query("applicable_obligations", f"WITH {APPLIES} SELECT doc_id, role, obligation_id FROM due")(lambda t: evidence.applicable_obligations(_audits(t("documents")), _obligations(t("documents").sparkSession)).select("doc_id", "role", "obligation_id"))
query("evidence_hits", f"WITH {EVIDENCE} SELECT * FROM ev")(lambda t: evidence.evidence_hits(t("documents"), SYNONYMS))
def _row_audits(docs: DataFrame, *more: Column | str) -> DataFrame:
    """doc_id, the columns in more, actor (struct), articles and coverage (struct) of each document: one scan, no shuffle. The obligations come along as one row."""
    text = F.col("text")
    duties = _obligations(docs.sparkSession).agg(F.collect_list(F.struct("regulation", "article_num", "actor", "evidence_required")).alias("duties"))
    hits = F.array_compact(F.array(*[F.when(text.rlike(tx.FLAGS + p), F.lit(g)) for g, _, p, _ in PACK]))
    terms = F.array_compact(F.array(*[F.when(text.rlike(tx.synonym_pattern(w)), F.lit(term)) for term, w in SYNONYMS.items()]))
    one = docs.select("doc_id", *more, hits.alias("hits"), terms.alias("terms"), rules.applicability(text.contains("queen"), text.rlike(tx.FLAGS + PACK[0][2])).alias("articles"), rules.second_gate(text, [PACK[3][2]], {22: [PACK[2][2]]}, [5, 13]).alias("gdpr_articles"))
    out = one.withColumn("actor", rules.row_vote(F.col("hits"), ["g1", "g2", "g3"], "g2")).withColumn("role", F.col("actor.actor")).crossJoin(F.broadcast(duties))  # one row
    return out.withColumn("coverage", evidence.row_coverage("role", "articles", "gdpr_articles", "terms", "duties")).drop("hits", "terms", "gdpr_articles", "role", "duties")


query("evidence_items", f"WITH {ITEMS} SELECT * FROM items")(_items)
query("evidence_map", f"""WITH {ITEMS}, m AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE coverage >= 1) AS fully, count(*) FILTER (WHERE coverage > 0 AND coverage < 1) AS partial, count(*) FILTER (WHERE coverage = 0) AS missing, avg(coverage) AS c FROM items GROUP BY 1)
SELECT doc_id, coalesce(total, 0) AS total, coalesce(fully, 0) AS fully, coalesce(partial, 0) AS partial, coalesce(missing, 0) AS missing, round(coalesce(c, 0), 6) AS mean_coverage FROM documents LEFT JOIN m USING (doc_id)""")(lambda t: _row_audits(t("documents")).select("doc_id", "coverage.*"))
query("evidence_rollup", ORACLES["evidence_map"])(lambda t: evidence.evidence_map(t("documents"), _items(t)))
query("coverage_by_regulation", f"""WITH {ITEMS} SELECT doc_id, regulation, count(*) FILTER (WHERE coverage >= 1) AS fully, count(*) FILTER (WHERE coverage > 0 AND coverage < 1) AS partial, count(*) FILTER (WHERE coverage = 0) AS missing, round(avg(coverage) * 100, 6) AS mean_pct, sum(n_required - n_satisfied)::BIGINT AS missing_artefacts FROM items GROUP BY ROLLUP (doc_id, regulation)""")(lambda t: evidence.coverage_by_regulation(_items(t)))

query("lang_detect", f"""WITH w AS (SELECT doc_id, substr(text, 1, 500) AS s, {TOKENS.format("substr(text, 1, 500)")} AS ws FROM documents),
n AS (SELECT doc_id, s, len(list_filter(ws, lambda x: x IN ('der','die','und','das','ist','nicht','mit','von'))) AS de, len(list_filter(ws, lambda x: x IN ('the','and','of','is','to','in','that','with'))) AS en FROM w)
SELECT doc_id, CASE WHEN length(trim(s)) < 20 THEN 'en' WHEN de > en THEN 'de' ELSE 'en' END AS detected FROM n""")(lambda t: t("documents").select("doc_id", tx.detect_lang(F.col("text")).alias("detected")))
query("token_counts", f"SELECT doc_id, len({TOKENS.format('text')})::INT AS n_tokens, len(list_distinct({TOKENS.format('text')}))::INT AS n_distinct FROM documents")(
    lambda t: t("documents").select("doc_id", F.size(tx.tokens(F.col("text"))).alias("n_tokens"), F.size(F.array_distinct(tx.tokens(F.col("text")))).alias("n_distinct"))
)
query("label_norm", """SELECT o_orderkey, CASE WHEN l IN ('security', 'unrelated') THEN l ELSE 'unrelated' END AS label FROM (SELECT o_orderkey, CASE WHEN o_orderstatus = 'F' THEN 'security' ELSE 'unrelated' END AS l FROM orders)""")(
    lambda t: t("orders").select("o_orderkey", tx.norm_label(F.when(F.col("o_orderstatus") == "F", F.lit(' "Security" ')).otherwise(F.lower("o_orderpriority"))).alias("label"))
)
query("keyword_first", "SELECT doc_id, CASE WHEN contains(lower(text), 'license') THEN 'license' WHEN contains(lower(text), 'queen') THEN 'queen' WHEN contains(lower(text), 'tion') THEN 'tion' END AS word FROM documents")(
    lambda t: t("documents").select("doc_id", tx.keyword_first(F.col("text"), ["license", "queen", "tion"]).alias("word"))
)
query("chunk_ids", "SELECT doc_id, regexp_replace(md5('p:' || text), '^(.{8})(.{4})(.{4})(.{4})(.{12})$', '\\1-\\2-\\3-\\4-\\5') AS chunk_id FROM documents")(lambda t: t("documents").select("doc_id", tx.chunk_id("p:", F.col("text")).alias("chunk_id")))
query("text_cache_keys", "SELECT sha256(text) AS text_key, count(*) AS n FROM documents GROUP BY 1")(lambda t: t("documents").groupBy(F.sha2("text", 256).alias("text_key")).agg(F.count("*").alias("n")))
query("article_numbers", r"SELECT o_orderkey, nullif(regexp_extract(o_orderpriority, '[0-9]+'), '')::INT AS n, array_to_string(list_sort(list_distinct(regexp_extract_all(CAST(o_custkey AS VARCHAR) || ' ' || CAST(o_orderkey AS VARCHAR), '\b(9|1[0-5])\b', 1)::INT[])), ',') AS arts FROM orders")(
    lambda t: t("orders").select("o_orderkey", tx.article_num(F.col("o_orderpriority")).alias("n"), F.array_join(tx.article_nums(F.concat_ws(" ", "o_custkey", "o_orderkey")).cast("array<string>"), ",").alias("arts"))
)
query("score_bands", "SELECT c_custkey, CASE WHEN c_acctbal >= 7000 THEN 'good' WHEN c_acctbal >= 4000 THEN 'fair' ELSE 'poor' END AS band, least(greatest(coalesce(c_acctbal / 100, 50), 0), 100) AS clamped FROM customer".replace("least(greatest", "round(least(greatest").replace("100) AS clamped", "100), 6) AS clamped"))(
    lambda t: t("customer").select("c_custkey", tx.score_band(F.col("c_acctbal"), [(7000, "good"), (4000, "fair")], "poor").alias("band"), tx.clamp_score(F.col("c_acctbal") / 100).alias("clamped"))
)
query("risk_tier_keywords", "SELECT doc_id, CASE WHEN contains(lower(text), 'queen') OR contains(lower(text), 'license') THEN 'prohibited' WHEN contains(lower(text), 'data') OR contains(lower(text), 'code') THEN 'high' ELSE 'minimal' END AS tier FROM documents")(
    lambda t: t("documents").select("doc_id", rules.tier_by_keywords(F.col("text"), ["queen", "license"], ["data", "code"]).alias("tier"))
)
query("emotion_flag", """SELECT doc_id, f AS detected, CASE WHEN f THEN c END AS context, f AND c IN ('workplace', 'education') AS prohibited FROM (SELECT doc_id, contains(lower(text), 'heit') OR contains(lower(text), 'tion') AS f,
CASE WHEN contains(lower(text), 'license') THEN 'workplace' WHEN contains(lower(text), 'queen') THEN 'education' WHEN contains(lower(text), 'data') THEN 'commercial' ELSE 'unknown' END AS c FROM documents)""")(
    lambda t: t("documents").select("doc_id", rules.emotion_flag(F.col("text"), ["heit", "tion"], {"workplace": ["license"], "education": ["queen"], "commercial": ["data"]}).alias("e")).select("doc_id", "e.*")
)
query("wizard_tier", "SELECT event_id, CASE WHEN event_type = 'error' THEN 'prohibited' WHEN value > 50 OR event_type = 'purchase' THEN 'high' ELSE 'minimal' END AS tier FROM events")(
    lambda t: t("events").select("event_id", rules.wizard_tier({"q1": F.col("value") > 50, "q2": F.col("event_type") == "purchase", "q9": F.col("event_type") == "error"}).alias("tier"))
)
query("weak_vote")(
    lambda t: rules.weak_label_vote(t("documents"), [(g, 10 * k + i, p, label) for k, (g, i, p, label) in enumerate(PACK)])
)
ORACLES["weak_vote"] = f"WITH {HITS}, n AS (SELECT doc_id, rule_group AS label, count(*) AS n FROM hits GROUP BY 1, 2) SELECT doc_id, label FROM (SELECT *, row_number() OVER (PARTITION BY doc_id ORDER BY n DESC, label) AS r FROM n) WHERE r = 1"
query("weak_binary", "SELECT doc_id, CASE WHEN y > n THEN 'risk' ELSE 'none' END AS label FROM (SELECT doc_id, contains(lower(text), 'heit')::INT + contains(lower(text), 'tion')::INT AS y, contains(lower(text), 'ment')::INT + contains(lower(text), 'keit')::INT AS n FROM documents) WHERE y <> n")(
    lambda t: rules.weak_label_binary(t("documents"), ["heit", "tion"], ["ment", "keit"], ("risk", "none")).select("doc_id", "label")
)
_LEXICON = [["tion"], ["heit", "keit"], ["ment"], ["ción", "data"]]
_VOTES = "votes AS (SELECT doc_id, [CASE WHEN contains(lower(text), 'tion') THEN 0 ELSE -1 END, CASE WHEN contains(lower(text), 'heit') OR contains(lower(text), 'keit') THEN 1 ELSE -1 END, CASE WHEN contains(lower(text), 'ment') THEN 2 ELSE -1 END, CASE WHEN contains(lower(text), 'ción') OR contains(lower(text), 'data') THEN 3 ELSE -1 END] AS v FROM documents)"
_votes = lambda t: t("documents").select("doc_id", rules.lf_votes(F.col("text"), _LEXICON).alias("votes"))
query("lf_votes", f"WITH {_VOTES} SELECT doc_id, array_to_string(v, ',') AS votes FROM votes")(lambda t: _votes(t).select("doc_id", F.array_join(F.col("votes").cast("array<string>"), ",").alias("votes")))
query("lf_summary", f"""WITH {_VOTES}, e AS (SELECT len(list_filter(v, lambda x: x >= 0)) AS n, unnest(v) AS vote, generate_subscripts(v, 1) - 1 AS lf FROM votes)
SELECT lf::INT AS lf, coalesce(string_agg(DISTINCT vote, ',') FILTER (WHERE vote >= 0), '') AS polarity, round(avg((vote >= 0)::INT), 6) AS coverage, round(avg((vote >= 0 AND n > 1)::INT), 6) AS overlaps, round(avg((vote >= 0 AND n > 1)::INT), 6) AS conflicts FROM e GROUP BY 1""")(lambda t: rules.lf_summary(_votes(t)))
query("label_model")(lambda t: rules.label_model(_votes(t), 4).select("doc_id", "label", "confidence"))
query("ingest_gate", "SELECT doc_id, CASE WHEN n_chars IS NULL THEN 400 WHEN lower(source) NOT IN ('src0', 'src1', 'src2') THEN 415 WHEN n_chars > 4000 THEN 413 ELSE 200 END AS status FROM documents")(
    lambda t: readers.ingest_gate(t("documents"), "n_chars", "source", 4000, ["src0", "src1", "src2"]).select("doc_id", "status")
)
query("meaningful_chunks", "SELECT doc_id FROM (SELECT doc_id, (length(trim(text)) >= 3000)::INT AS a, max((length(trim(text)) >= 3000)::INT) OVER (PARTITION BY source) AS b FROM documents) WHERE a = b")(lambda t: report.meaningful(t("documents"), "source", 3000).select("doc_id"))
query("collection_counts", "SELECT source, count(*) AS n FROM documents GROUP BY 1")(lambda t: t("documents").groupBy("source").agg(F.count("*").alias("n")))
query("upsert_passages", "SELECT doc_id, CASE WHEN lang = 'de' THEN 'new' ELSE 'old' END AS state FROM documents")(
    lambda t: registry.upsert(t("documents").select("doc_id", F.lit("old").alias("state")), t("documents").where("lang = 'de'").select("doc_id", F.lit("new").alias("state")), "doc_id")
)
query("sections")(lambda t: segment.detect_sections(t("documents")))
query("chunk_boundary")(lambda t: segment.chunk_boundary(t("documents")))
ORACLES["chunk_boundary"] = r"""WITH RECURSIVE d AS (SELECT doc_id, text, length(text) AS n FROM documents),
w AS (SELECT doc_id, text, n, 0 AS s, 0 AS e, false AS done FROM d WHERE n > 512 UNION ALL
 SELECT doc_id, text, n, e2 - 50 + CASE WHEN e2 - 50 > s1 THEN 0 ELSE 50 END, e2, true FROM (
  SELECT *, CASE WHEN s1 + 512 >= n THEN n WHEN p1 > 0 THEN s1 + p1 + 2 WHEN p2 > 0 THEN s1 + p2 + 1 WHEN p3 > 0 THEN s1 + p3 + 1 ELSE s1 + 512 END AS e2 FROM (
   SELECT doc_id, text, n, s AS s1, CASE WHEN contains(x, '. ') THEN length(x) - length(list_extract(string_split(x, '. '), -1)) - 2 ELSE 0 END AS p1,
    CASE WHEN contains(x, chr(10)) THEN length(x) - length(list_extract(string_split(x, chr(10)), -1)) - 1 ELSE 0 END AS p2, CASE WHEN contains(x, ' ') THEN length(x) - length(list_extract(string_split(x, ' '), -1)) - 1 ELSE 0 END AS p3
   FROM (SELECT *, substr(text, s + 1, 512) AS x FROM w WHERE s < n)))),
c AS (SELECT doc_id, e, text, n, lag(s) OVER (PARTITION BY doc_id ORDER BY s) AS s0 FROM w),
p AS (SELECT doc_id, s0, trim(substr(text, s0 + 1, e - s0), ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)) AS chunk FROM c WHERE s0 IS NOT NULL AND e > 0),
k AS (SELECT doc_id, (row_number() OVER (PARTITION BY doc_id ORDER BY s0) - 1)::INT AS chunk_index, chunk AS text FROM p WHERE chunk <> '')
SELECT * FROM k UNION ALL SELECT doc_id, 0::INT, text FROM d WHERE n <= 512"""
query("chunk_fixed")(lambda t: segment.chunk_fixed(t("documents")))
query("chunk_propositions")(lambda t: segment.chunk_propositions(t("documents")))
query("sentences", r"""WITH s AS (SELECT doc_id, string_split(regexp_replace(text, '([.!?])\s+([A-ZÜÄÖ("''])', '\1' || chr(1) || '\2', 'g'), chr(1)) AS parts FROM documents),
k AS (SELECT doc_id, list_filter(list_transform(parts, lambda x: trim(x, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13))), lambda x: length(x) BETWEEN 60 AND 600) AS kept FROM s)
SELECT doc_id, (generate_subscripts(kept, 1) - 1)::INT AS sentence_index, unnest(kept) AS sentence FROM k""")(lambda t: segment.split_sentences(t("documents")))
query("html_articles")(lambda t: pages.extract_articles(t("pages"), r"^\w", r"^\d", tags=("h1",)))
query("html_sections")(lambda t: readers.extract_sections(t("pages"), r"^[A-Z]", r"^[0-9]"))
_spans = lambda t: rules.annotate(t("documents"), [("CAPS", r"\b[A-Z]{4,}\b")], [("LICENSE", "license"), ("LICENSE", "all rights reserved")])
query("entity_spans")(lambda t: rules.annotate(t("documents"), [("CAPS", r"\b[A-Z]{4,}\b")], [("LICENSE", "license"), ("LICENSE", "all rights reserved")], policy="leftmost"))
query("entity_override")(lambda t: rules.override_spans(_spans(t).where("label = 'CAPS'"), _spans(t).where("label = 'LICENSE'")))



def _lateral(t) -> DataFrame:
    docs = t("documents")
    return segment.register(docs.sparkSession).sql("SELECT doc_id, chunk_index, c.text FROM {docs} d, LATERAL chunk_boundary(d.text) c", docs=docs)


query("chunk_lateral", ORACLES["chunk_boundary"])(_lateral)


def _word_rules(t) -> DataFrame:
    """A pack of one pattern for each word of five letters or more in benchmark."""
    words = t("benchmark").select(F.explode(F.split(F.lower("text"), "[^a-z]+")).alias("w")).where("length(w) >= 5").distinct()
    return words.select(F.lit("words").alias("pack"), F.substring("w", 1, 1).alias("rule_group"), F.length("w").alias("rule_idx"), F.concat(F.lit("(?<![a-z])"), "w", F.lit("(?![a-z])")).alias("pattern"), F.col("w").alias("label"))


query("rule_tables", """WITH r AS (SELECT DISTINCT unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM benchmark), d AS (SELECT DISTINCT doc_id, unnest(string_split_regex(lower(text), '[^a-z]+')) AS w FROM documents)
SELECT doc_id, 'words' AS pack, substr(w, 1, 1) AS rule_group, length(w)::INT AS rule_idx, w AS label FROM d JOIN r USING (w) WHERE length(w) >= 5""")(lambda t: packs.scan(t("documents"), _word_rules(t)))

_BM = f"""p AS (SELECT lang, doc_id, {TOKENS.format("text")} AS ws FROM documents), q AS (SELECT item_id AS query_id, unnest({TOKENS.format("text")}) AS term FROM benchmark),
qt AS (SELECT query_id, term, count(*) AS qtf FROM q GROUP BY ALL), sz AS (SELECT count(*) AS n, avg(len(ws)) AS avgdl FROM p),
po AS (SELECT doc_id, dl, term, count(*) AS tf FROM (SELECT doc_id, len(ws) AS dl, unnest(ws) AS term FROM p) GROUP BY ALL),
raw AS MATERIALIZED (SELECT term, count(*) AS df, any_value(n) AS n, ln(any_value(n) - count(*) + 0.5) - ln(count(*) + 0.5) AS raw FROM po, sz GROUP BY term),
idf AS (SELECT term, df, CASE WHEN raw < 0 THEN 0.25 * (SELECT avg(raw) FROM raw) ELSE raw END AS idf, ln(1 + (n - df + 0.5) / (df + 0.5)) AS lidf FROM raw)"""
query("bm25_stats", f"""WITH w AS (SELECT unnest(list_distinct({TOKENS.format("text")})) AS term FROM documents), d AS MATERIALIZED (SELECT term, count(*) AS df FROM w GROUP BY 1), r AS (SELECT term, df, ln(n - df + 0.5) - ln(df + 0.5) AS raw FROM d, (SELECT count(*) AS n FROM documents))
SELECT term, df, round(CASE WHEN raw < 0 THEN 0.25 * avg(raw) OVER () ELSE raw END, 6) AS idf FROM r""")(lambda t: retrieval.bm25_stats(t("documents"), [])[1].drop("lucene_idf"))
_TOP = "SELECT query_id, doc_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, doc_id) AS rank FROM s) WHERE rank <= 10 AND score > 0"
_bq = lambda t: t("benchmark").select(F.col("item_id").alias("query_id"), "text")
query("bm25_top10", f"WITH {_BM}, s AS (SELECT query_id, doc_id, round(sum(qtf * idf * tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (term), sz GROUP BY 1, 2) {_TOP}")(lambda t: retrieval.bm25_search(_bq(t), t("documents"), [], 10))
query("bm25_indexed", ORACLES["bm25_top10"])(lambda t: postings.search(postings.build(t("documents")), _bq(t), 10))
query("bm25_lucene", f"WITH {_BM}, s AS (SELECT query_id, doc_id, round(sum(qtf * lidf * tf / (tf + 1.2 * (0.25 + 0.75 * dl / avgdl))), 6) AS score FROM qt JOIN idf USING (term) JOIN po USING (term), sz GROUP BY 1, 2) {_TOP}")(lambda t: retrieval.bm25_search(_bq(t), t("documents"), [], 10, k1=1.2, lucene=True))
_KNN = "knn AS (SELECT query_id, vec_id, distance, row_number() OVER (PARTITION BY query_id ORDER BY distance, vec_id) AS rank FROM (SELECT q.vec_id AS query_id, v.vec_id, round(1 - list_cosine_similarity(v.embedding::DOUBLE[], q.embedding::DOUBLE[]), 6) AS distance FROM embeddings v JOIN embeddings q ON q.label = v.label AND q.vec_id <> v.vec_id AND q.vec_id % 100 = 0))"
_knn = lambda t, k: retrieval.knn(t("embeddings").where("vec_id % 100 = 0"), t("embeddings"), k, ["label"])
query("knn_filtered", f"WITH {_KNN} SELECT query_id, vec_id, distance, rank::INT AS rank FROM knn WHERE rank <= 10")(lambda t: _knn(t, 10))
#: Approximate, so without SQL: tests hold it against knn.
query("knn_hashed")(lambda t: vectors.search(t("embeddings").where("vec_id % 100 = 0"), vectors.hash_index(t("embeddings")), 10))
_LISTS = lambda t: [_knn(t, 10), _knn(t, 10).withColumn("rank", 11 - F.col("rank"))]
query("rrf_fusion", f"""WITH {_KNN}, l AS (SELECT query_id, vec_id, rank, 0 AS list FROM knn WHERE rank <= 10 UNION ALL SELECT query_id, vec_id, 11 - rank, 1 FROM knn WHERE rank <= 10),
f AS (SELECT query_id, vec_id, round(sum(1.0 / (60 + rank)), 9) AS score, min(rank) FILTER (WHERE list = 0) AS first FROM l GROUP BY 1, 2)
SELECT query_id, vec_id, round(score, 6) AS score, row_number() OVER (PARTITION BY query_id ORDER BY score DESC, first, vec_id)::INT AS rank FROM f""")(lambda t: retrieval.rrf(_LISTS(t), "vec_id"))
query("recall_mrr", f"""WITH {_KNN.replace("q.label = v.label AND ", "")}, h AS (SELECT query_id, min(rank) FILTER (WHERE v.label = q.label) AS f FROM knn JOIN embeddings v ON v.vec_id = knn.vec_id JOIN embeddings q ON q.vec_id = query_id WHERE rank <= 10 GROUP BY 1)
SELECT round(avg(coalesce((f <= 1)::INT, 0)), 6) AS recall_1, round(avg(coalesce((f <= 3)::INT, 0)), 6) AS recall_3, round(avg(coalesce((f <= 5)::INT, 0)), 6) AS recall_5, round(avg(coalesce(1.0 / f, 0)), 6) AS mrr FROM h""")(
    lambda t: evaluate.recall_mrr(retrieval.knn(t("embeddings").where("vec_id % 100 = 0"), t("embeddings"), 10).join(t("embeddings").select("vec_id", "label"), "vec_id").join(t("embeddings").select(F.col("vec_id").alias("query_id"), F.col("label").alias("ql")), "query_id").withColumn("relevant", F.col("label") == F.col("ql")), [1, 3, 5])
)
query("query_chunk_select", """WITH c AS (SELECT *, CASE WHEN vec_id < 4 THEN 100 WHEN vec_id < 12 THEN 101 ELSE label END AS grp FROM embeddings), t AS (SELECT grp, min_by(embedding, vec_id) AS target FROM c WHERE grp <> 101 GROUP BY 1),
s AS (SELECT grp, vec_id, CASE WHEN target IS NOT NULL AND count(*) OVER (PARTITION BY grp) > 4 THEN round(list_inner_product(embedding::DOUBLE[], target::DOUBLE[]), 6) END AS score FROM c LEFT JOIN t USING (grp))
SELECT grp AS label, vec_id, score, rank::INT AS rank FROM (SELECT *, row_number() OVER (PARTITION BY grp ORDER BY score DESC NULLS LAST, vec_id) AS rank FROM s) WHERE rank <= 4""")(
    lambda t: (lambda c: retrieval.select_query_chunks(c, c.where("label <> 101").groupBy("label").agg(F.min_by("embedding", "vec_id").alias("target")), 4))(t("embeddings").withColumn("label", F.expr("case when vec_id < 4 then 100 when vec_id < 12 then 101 else label end")))
)
query("top_by_length", "SELECT conv_id, turn, rank::INT AS rank FROM (SELECT conv_id, turn, row_number() OVER (PARTITION BY conv_id ORDER BY length(text) DESC, turn) AS rank FROM conversations) WHERE rank <= 3")(
    lambda t: retrieval.top_by(t("conversations"), "conv_id", [F.desc(F.length("text")), "turn"], 3).select("conv_id", "turn", "rank")
)
query("merge_passages", """WITH h AS (SELECT label AS grp, vec_id % 97 AS item, vec_id // 97 AS query_ord, vec_id AS rank FROM embeddings), f AS (SELECT grp, item, min((query_ord, rank)) AS first FROM h GROUP BY 1, 2)
SELECT grp, item, place::INT AS place FROM (SELECT grp, item, row_number() OVER (PARTITION BY grp ORDER BY first, item) AS place FROM f) WHERE place <= 5""")(
    lambda t: retrieval.merge_passages(t("embeddings").select(F.col("label").alias("grp"), (F.col("vec_id") % 97).alias("item"), F.expr("vec_id div 97").alias("query_ord"), F.col("vec_id").alias("rank")))
)
query("embed_distinct", "SELECT doc_id, sha256(text) AS text_key, length(text) AS n FROM documents")(lambda t: retrieval.embed_distinct(t("documents").select("doc_id", "text"), lambda d: d.select("text_key", F.length("text").cast("long").alias("n"))).select("doc_id", "text_key", "n"))

_SEV = "CASE WHEN o_orderpriority IN ('1-URGENT') THEN 'critical' WHEN o_orderpriority IN ('2-HIGH', '3-MEDIUM') THEN 'major' ELSE 'minor' END"
_gaps = lambda t: t("orders").select("o_custkey", "o_orderkey", F.when(F.col("o_orderpriority") == "1-URGENT", "critical").when(F.col("o_orderpriority").isin("2-HIGH", "3-MEDIUM"), "major").otherwise("minor").alias("severity"), (F.col("o_totalprice") / 4000).alias("score"))
query("gap_counts", f"SELECT o_custkey, count(*) FILTER (WHERE s = 'critical') AS critical, count(*) FILTER (WHERE s = 'major') AS major, count(*) FILTER (WHERE s = 'minor') AS minor FROM (SELECT o_custkey, {_SEV} AS s FROM orders) GROUP BY 1")(lambda t: report.gap_counts(_gaps(t), "o_custkey"))
query("priority_gaps", f"""WITH g AS (SELECT o_custkey, o_orderkey, {_SEV} AS severity FROM orders), a AS (SELECT *, count(*) FILTER (WHERE severity = 'critical') OVER (PARTITION BY o_custkey) AS nc, row_number() OVER (PARTITION BY o_custkey, severity ORDER BY o_orderkey) AS k FROM g WHERE severity <> 'minor'),
b AS (SELECT *, row_number() OVER (PARTITION BY o_custkey ORDER BY severity, o_orderkey) AS place FROM a WHERE severity = 'critical' OR k <= greatest(3, 8 - nc)) SELECT o_custkey, o_orderkey, severity, place::INT AS place FROM b WHERE place <= 8""")(lambda t: report.priority_gaps(_gaps(t), "o_custkey", "o_orderkey").drop("score"))
query("article_verdicts", f"""WITH g AS (SELECT o_custkey, {_SEV} AS s, o_totalprice / 4000 AS score FROM orders) SELECT o_custkey, min(s) AS worst, max(score) >= 70 AND bool_or(s <> 'minor') AS contradiction, NOT bool_or(s <> 'minor') AS ready FROM g GROUP BY 1""")(lambda t: report.article_verdicts(_gaps(t), "o_custkey"))
query("article_skeleton", "SELECT d.doc_id, a.article::INT AS article, CASE WHEN d.doc_id % 7 = a.article - 9 THEN n_chars ELSE 0 END AS score, CASE WHEN d.doc_id % 7 = a.article - 9 THEN 1 ELSE 0 END AS chunk_count FROM documents d, (SELECT unnest(range(9, 16)) AS article) a")(
    lambda t: report.article_skeleton(t("documents"), t("documents").select("doc_id", (F.col("doc_id") % 7 + 9).cast("int").alias("article"), F.col("n_chars").alias("score"), F.lit(1).alias("chunk_count")), list(range(9, 16)))
)
query("overall_score", "SELECT doc_id, round(CASE WHEN n_chars % 3 = 0 THEN 100 ELSE (n_chars % 100 + doc_id % 50) / 2.0 END::DOUBLE, 6) AS score, round(CASE WHEN doc_id % 2 = 0 THEN (0.5 + (n_chars % 10) / 10.0) / 2 ELSE 0.5 END::DOUBLE, 6) AS confidence FROM documents")(
    lambda t: t("documents").select("doc_id", evidence.overall_score(F.when(F.col("n_chars") % 3 == 0, F.array().cast("array<double>")).otherwise(F.array((F.col("n_chars") % 100).cast("double"), (F.col("doc_id") % 50).cast("double")))).alias("score"), evidence.confidence(F.lit(0.5), F.when(F.col("doc_id") % 2 == 0, (F.col("n_chars") % 10) / 10)).alias("confidence"))
)

_truth = lambda t: t("labels").join(t("documents").select("doc_id", "lang", "source", "n_chars"), "doc_id").select("doc_id", "lang", "source", (F.col("quality") == 1).alias("truth"), (F.col("n_chars") > 700).alias("pred"))
_TRUTH = "tr AS (SELECT doc_id, lang, source, quality = 1 AS truth, n_chars > 700 AS pred FROM labels JOIN documents USING (doc_id))"
_RATES = "tp, fp, tn, fn, round(r, 6) AS recall, round(s, 6) AS tnr, round(p, 6) AS precision, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, round((r + s) / 2, 6) AS balanced"
query("rates_by_group", f"WITH {_TRUTH}, n AS (SELECT lang, count(*) FILTER (WHERE truth AND pred) AS tp, count(*) FILTER (WHERE NOT truth AND pred) AS fp, count(*) FILTER (WHERE NOT truth AND NOT pred) AS tn, count(*) FILTER (WHERE truth AND NOT pred) AS fn FROM tr GROUP BY 1), x AS (SELECT *, coalesce(tp / nullif(tp + fn, 0), 0) AS r, coalesce(tn / nullif(tn + fp, 0), 0) AS s, coalesce(tp / nullif(tp + fp, 0), 0) AS p FROM n) SELECT lang, {_RATES} FROM x")(lambda t: evaluate.binary_rates(_truth(t), ["lang"]))
_langs = ["de", "en", "es", "fr"]
_pred = lambda t: t("documents").select(F.col("lang").alias("truth"), tx.detect_lang(F.col("text")).alias("pred"))
_PRED = ORACLES["lang_detect"]
query("class_report", f"""WITH pr AS (SELECT lang AS truth, detected AS pred FROM ({_PRED}) JOIN documents USING (doc_id)), l AS (SELECT unnest(['de','en','es','fr']) AS label),
n AS (SELECT label, count(*) FILTER (WHERE truth = label AND pred = label) AS tp, count(*) FILTER (WHERE pred = label) AS np, count(*) FILTER (WHERE truth = label) AS support FROM l, pr GROUP BY 1), x AS (SELECT *, coalesce(tp / nullif(np, 0), 0) AS p, coalesce(tp / nullif(support, 0), 0) AS r FROM n)
SELECT label, round(p, 6) AS precision, round(r, 6) AS recall, round(CASE WHEN p + r > 0 THEN 2 * p * r / (p + r) ELSE 0 END, 6) AS f1, support FROM x""")(lambda t: evaluate.class_report(_pred(t), _langs))
query("confusion", f"WITH pr AS (SELECT lang AS truth, detected AS pred FROM ({_PRED}) JOIN documents USING (doc_id)) SELECT a.l AS truth, b.l AS pred, (SELECT count(*) FROM pr WHERE truth = a.l AND pred = b.l) AS n FROM (SELECT unnest(['de','en','es','fr']) AS l) a, (SELECT unnest(['de','en','es','fr']) AS l) b")(lambda t: evaluate.confusion(_pred(t), _langs))
query("consistency", "WITH n AS (SELECT conv_id, role, count(*) AS n FROM conversations GROUP BY 1, 2) SELECT conv_id, round(max(n) / sum(n), 6) AS share, max(n) / sum(n) >= 0.5 AS consistent FROM n GROUP BY 1")(lambda t: evaluate.consistency(t("conversations"), "conv_id", "role", 0.5))
query("latency_summary", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) - 1 AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, round(avg(value), 6) AS mean, round(median(value), 6) AS median, round(max(value) FILTER (WHERE pos = floor(n * 0.95)), 6) AS p95, round(sum(value), 6) AS total, round(60 * count(*) / sum(value), 6) AS per_minute FROM r GROUP BY 1""")(lambda t: evaluate.latency_summary(t("events"), "event_type", "value"))
_day = lambda t, odd: t("events").where(F.col("user_id") % 2 == odd).groupBy(F.col("event_type").alias("metric"))
query("regression", "WITH c AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 1 GROUP BY 1), b AS (SELECT event_type, avg(value) AS v FROM events WHERE user_id % 2 = 0 GROUP BY 1) SELECT event_type AS metric, round(c.v - b.v, 6) AS delta, CASE WHEN c.v - b.v < -0.02 THEN 'regression' WHEN c.v - b.v > 0.001 THEN 'improvement' ELSE 'same' END AS status FROM c JOIN b USING (event_type)")(
    lambda t: evaluate.compare_to_baseline(_day(t, 1).agg(F.avg("value").alias("value")), _day(t, 0).agg(F.avg("value").alias("base")))
)

query("skip_existing", "SELECT doc_id FROM documents WHERE text NOT IN (SELECT text FROM benchmark)")(lambda t: prep.skip_existing(t("documents"), t("benchmark")).select("doc_id"))
query("dedupe_first", "SELECT min(doc_id) AS doc_id FROM documents GROUP BY text")(lambda t: prep.dedupe_first(t("documents"), "doc_id").select("doc_id"))
query("stratified_split", f"WITH {_TRUTH}, a AS (SELECT *, row_number() OVER (PARTITION BY truth, lang ORDER BY md5(CAST(doc_id AS VARCHAR)), doc_id) AS pos, count(*) OVER (PARTITION BY truth, lang) AS n FROM tr) SELECT doc_id, CASE WHEN pos <= greatest(1, floor(n * 0.85::DOUBLE)) THEN 'train' ELSE 'val' END AS split FROM a")(lambda t: prep.hash_split(_truth(t), ["truth", "lang"], "doc_id", 0.85).select("doc_id", "split"))
query("class_weights", "WITH n AS (SELECT quality, count(*) AS n FROM labels GROUP BY 1) SELECT quality, n, round(least(greatest((SELECT sum(n) FROM n) / (2 * n), 0.5), 2.5), 6) AS weight FROM n")(lambda t: prep.class_weights(t("labels"), "quality", 2, 0.5, 2.5))
query("sufficiency", "WITH n AS (SELECT quality, lang, count(*) AS n FROM labels JOIN documents USING (doc_id) GROUP BY 1, 2) SELECT min(n) AS least, sum(n)::BIGINT AS total, min(n) >= 30 AND sum(n) >= 160 AS sufficient FROM n")(lambda t: prep.sufficiency(t("labels").join(t("documents"), "doc_id").select(F.col("quality").alias("label"), "lang"), 10))
query("label_quota", "SELECT doc_id, rank::INT AS rank FROM (SELECT doc_id, row_number() OVER (PARTITION BY lang, source ORDER BY doc_id) AS rank FROM documents WHERE length(text) >= 20) WHERE rank <= 5")(lambda t: prep.label_quota(t("documents"), ["lang", "source"], 5, "doc_id").select("doc_id", "rank"))
query("pipeline_stats", "SELECT s AS total, p AS successful, e AS failed, round(m, 6) AS mean_duration, greatest(s - p - e, 0) AS active, round(p / greatest(s, 1) * 100, 1) AS success_rate FROM (SELECT count(*) FILTER (WHERE event_type = 'signup') AS s, count(*) FILTER (WHERE event_type = 'purchase') AS p, count(*) FILTER (WHERE event_type = 'error') AS e, avg(value) FILTER (WHERE event_type IN ('purchase', 'error')) AS m FROM events)")(lambda t: monitor.pipeline_stats(t("events"), "signup", "purchase", "error"))
query("stage_stats", """WITH r AS (SELECT event_type, value, row_number() OVER (PARTITION BY event_type ORDER BY value, event_id) AS pos, count(*) OVER (PARTITION BY event_type) AS n FROM events)
SELECT event_type, count(*) AS n, round(avg(value), 6) AS mean, round(min(value), 6) AS least, round(max(value), 6) AS most, round(max(value) FILTER (WHERE pos = greatest(1, floor(n * 0.95))), 6) AS p95 FROM r GROUP BY 1""")(lambda t: monitor.stage_stats(t("events")))
query("node_stats", "SELECT user_id AS node, count(*) AS invocations, round(sum(value), 6) AS total, round(avg(value), 6) AS mean, count(*) FILTER (WHERE event_type = 'error') AS errors FROM events GROUP BY 1")(lambda t: monitor.node_stats(t("events"), "error"))
query("paired_durations", """WITH n AS (SELECT user_id, min(ts) FILTER (WHERE event_type = 'signup') AS b, max(ts) FILTER (WHERE event_type = 'purchase') AS e FROM events GROUP BY 1)
SELECT user_id, round(CASE WHEN e IS NOT NULL THEN CASE WHEN b IS NULL THEN 0 ELSE greatest(0, epoch_us(e) / 1e6 - epoch_us(b) / 1e6) END END, 6) AS seconds, e IS NULL AS active FROM n WHERE b IS NOT NULL OR e IS NOT NULL""")(lambda t: monitor.pair_audits(t("events"), "signup", "purchase"))
query("windowed_stats", "SELECT event_type, epoch(time_bucket(INTERVAL 1 hour, ts))::BIGINT AS began, count(*) AS n, round(avg(value), 6) AS mean, round(max(value), 6) AS most FROM events GROUP BY 1, 2")(lambda t: monitor.windowed_stats(t("events"), "1 hour").withColumn("began", F.unix_seconds(F.col("began").cast("timestamp"))))
query("audit_status", "SELECT user_id, arg_max(event_type, (ts, event_id)) AS status FROM events GROUP BY 1")(lambda t: monitor.audit_status(t("events")))
query("promotions", "SELECT event_id FROM (SELECT event_id, value, max(value) OVER (PARTITION BY user_id ORDER BY ts, event_id ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING) AS best FROM events) WHERE best IS NULL OR value > best")(lambda t: registry.promotions(t("events"), "user_id", ["ts", "event_id"], "value").select("event_id"))
query("next_version", "SELECT lang, 'v' || (max(doc_id) + 1) AS next FROM documents GROUP BY 1")(lambda t: registry.next_version(t("documents").select("lang", F.concat(F.lit("v"), "doc_id").alias("version")), ["lang"]))


def corpus_audit(t) -> DataFrame:
    """Language, chunks, rule groups, decision and evidence coverage of each document: one scan, no shuffle. The obligations come
    along as one row."""
    docs, text = t("documents"), F.col("text")
    duties = _obligations(docs.sparkSession).agg(F.collect_list(F.struct("regulation", "article_num", "actor", "evidence_required")).alias("duties"))
    hits = F.array_compact(F.array(*[F.when(text.rlike(tx.FLAGS + p), F.lit(g)) for g, _, p, _ in PACK]))
    terms = F.array_compact(F.array(*[F.when(text.rlike(tx.synonym_pattern(w)), F.lit(term)) for term, w in SYNONYMS.items()]))
    one = docs.select("doc_id", tx.detect_lang(text).alias("detected"), rules.tier_by_keywords(text, ["queen"], ["data", "license"]).alias("tier"), segment.n_boundary_chunks(text).alias("n_chunks"), hits.alias("hits"), terms.alias("terms"), rules.applicability(text.contains("queen"), text.rlike(tx.FLAGS + PACK[0][2])).alias("articles"), rules.second_gate(text, [PACK[3][2]], {22: [PACK[2][2]]}, [5, 13]).alias("gdpr_articles"))
    out = one.withColumn("role", rules.most_hits(F.col("hits"), ["g1", "g2", "g3"], "g2")).crossJoin(F.broadcast(duties))  # one row
    return out.select("doc_id", "detected", "tier", "n_chunks", F.array_join(F.array_sort(F.array_distinct("hits")), ",").alias("groups"), F.inline(F.array(evidence.row_coverage("role", "articles", "gdpr_articles", "terms", "duties"))))


query("corpus_audit", f"""WITH {ITEMS}, em AS (SELECT doc_id, count(*) AS total, count(*) FILTER (WHERE coverage >= 1) AS fully, count(*) FILTER (WHERE coverage > 0 AND coverage < 1) AS partial, count(*) FILTER (WHERE coverage = 0) AS missing, avg(coverage) AS c FROM items GROUP BY 1),
ch AS (SELECT doc_id, count(*)::INT AS n_chunks FROM ({ORACLES["chunk_boundary"]}) GROUP BY 1), gr AS (SELECT doc_id, string_agg(DISTINCT rule_group, ',' ORDER BY rule_group) AS groups FROM hits GROUP BY 1)
SELECT d.doc_id, detected, CASE WHEN contains(lower(text), 'queen') THEN 'prohibited' WHEN contains(lower(text), 'data') OR contains(lower(text), 'license') THEN 'high' ELSE 'minimal' END AS tier, n_chunks, coalesce(groups, '') AS groups,
coalesce(total, 0) AS total, coalesce(fully, 0) AS fully, coalesce(partial, 0) AS partial, coalesce(missing, 0) AS missing, round(coalesce(c, 0), 6) AS mean_coverage
FROM documents d JOIN ({ORACLES["lang_detect"]}) USING (doc_id) JOIN ch USING (doc_id) LEFT JOIN gr USING (doc_id) LEFT JOIN em USING (doc_id)""")(corpus_audit)

from docaudit.plans import decisions, reports, tables  # noqa: E402, F401  (they add their queries)
