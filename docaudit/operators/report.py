"""Scores, gaps and verdicts of a report."""

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.plan import broadcast_if_small
from docaudit.functions.text import clamp_score, contains_any, norm_severity
from docaudit.operators.evidence import confidence, overall_score


def severity_order(c):
    return F.when(c == "critical", 0).when(c == "major", 1).otherwise(2)


def article_skeleton(docs: DataFrame, scores: DataFrame, articles: list[int]) -> DataFrame:
    """All articles for every document; missing ones score 0 with no chunks."""
    grid = docs.select("doc_id", F.explode(F.array(*map(F.lit, articles))).alias("article"))
    return grid.join(scores, ["doc_id", "article"], "left").na.fill(0, ["score", "chunk_count"])


def gap_counts(gaps: DataFrame, key: str) -> DataFrame:
    return gaps.groupBy(key).agg(*[F.count_if(F.col("severity") == s).alias(s) for s in ("critical", "major", "minor")])


def priority_gaps(gaps: DataFrame, key: str, order: str, limit: int = 8) -> DataFrame:
    """All critical gaps, then the first max(3, limit - criticals) major ones, cut at limit."""
    by = Window.partitionBy(key)
    g = gaps.where(F.col("severity").isin("critical", "major")).withColumn("n_critical", F.count_if(F.col("severity") == "critical").over(by))
    g = g.withColumn("of_kind", F.row_number().over(Window.partitionBy(key, "severity").orderBy(order)))
    g = g.where((F.col("severity") == "critical") | (F.col("of_kind") <= F.greatest(F.lit(3), limit - F.col("n_critical"))))
    return g.withColumn("place", F.row_number().over(by.orderBy(severity_order(F.col("severity")), order))).where(F.col("place") <= limit).drop("n_critical", "of_kind")


def article_verdicts(gaps: DataFrame, key: str) -> DataFrame:
    """Worst severity, whether a high score contradicts it, and whether nothing critical or major is left."""
    serious = F.col("severity").isin("critical", "major")
    out = gaps.groupBy(key).agg(F.min_by("severity", severity_order(F.col("severity"))).alias("worst"), F.bool_or(serious).alias("serious"), F.max("score").alias("score"))
    return out.select(key, "worst", ((F.col("score") >= 70) & F.col("serious")).alias("contradiction"), (~F.col("serious")).alias("ready"))


GAP = "struct<title:string,description:string,severity:string>"


def chunks_by_domain(chunks: DataFrame, domains: list[str]) -> DataFrame:
    """(doc_id, domain, chunk_ids) for each document and each domain; a domain without chunks has an empty list."""
    ids = chunks.where(F.col("domain").isin(*domains)).groupBy("doc_id", "domain").agg(F.sort_array(F.collect_list("chunk_id")).alias("chunk_ids"))
    grid = chunks.select("doc_id").distinct().select("doc_id", F.explode(F.array(*map(F.lit, domains))).alias("domain"))
    return grid.join(ids, ["doc_id", "domain"], "left").withColumn("chunk_ids", F.coalesce("chunk_ids", F.array().cast("array<bigint>")))


def clean_gaps(gaps: Column) -> Column:
    """Gaps with a title of 80 characters at most (a default if it is absent) and a known severity; blank ones go."""
    each = F.transform(F.coalesce(gaps, F.array().cast(f"array<{GAP}>")), lambda g: F.struct(F.substring(F.coalesce(g["title"], F.lit("Unnamed gap")), 1, 80).alias("title"), F.coalesce(g["description"], F.lit("")).alias("description"), norm_severity(F.coalesce(g["severity"], F.lit("minor"))).alias("severity")))
    return F.filter(each, lambda g: (F.trim(g["title"]) != "") & (F.trim(g["description"]) != ""))


def clean_recommendations(recs: Column) -> Column:
    return F.filter(F.coalesce(recs, F.array().cast("array<string>")), lambda r: r.isNotNull() & (F.trim(r) != ""))


def article_defaults(df: DataFrame, skip_when_empty: bool = False) -> DataFrame:
    """score, gaps and recommendations that need no analysis, else NULL: 100 where the article isn't among those that apply (an
    empty list skips nothing unless asked), 0 and a critical gap without chunks, 30 and a major gap where the analysis failed."""
    listed = F.size("applicable") > 0 if not skip_when_empty else F.col("applicable").isNotNull()
    skip, empty, failed = listed & ~F.array_contains("applicable", F.col("article")), F.col("chunk_count") == 0, F.coalesce(F.col("failed"), F.lit(False))
    gap = lambda title, text, severity: F.array(F.struct(F.lit(title).alias("title"), text.alias("description"), F.lit(severity).alias("severity")))
    none, article = F.array().cast(f"array<{GAP}>"), F.col("article").cast("string")
    df = df.withColumn("score", F.when(skip, 100.0).when(empty, 0.0).when(failed, 30.0))
    df = df.withColumn("gaps", F.when(skip, none).when(empty, gap("No documentation found", F.concat(F.lit("No section belongs to article "), article), "critical")).when(failed, gap("Analysis failed", F.concat(F.lit("No analysis of article "), article), "major")))
    recs = F.when(empty, F.array(F.concat(F.lit("Document article "), article), F.lit("Map requirements to policies"))).when(failed, F.array(F.lit("Retry or review by hand")))
    return df.withColumn("recommendations", F.when(skip, F.array().cast("array<string>")).otherwise(recs))


def article_scores(df: DataFrame) -> DataFrame:
    """Scores of articles from parsed replies, after article_defaults: reply (score, gaps, recommendations, reasoning), passages
    (array of structs title, requirement_id, article, text, regulation, source, article_ref)."""
    r = F.col("reply")
    first = lambda p, *names: F.coalesce(*[p[n] for n in names], F.lit(""))
    shown = F.transform("passages", lambda p: F.struct(first(p, "title", "requirement_id", "article").alias("title"), first(p, "text").alias("text"), first(p, "regulation", "source").alias("regulation"), first(p, "article_ref", "article").alias("article_ref")))
    settled = F.col("score").isNotNull()
    return df.select(
        "doc_id",
        "article",
        "chunk_count",
        F.coalesce("score", clamp_score(r["score"])).alias("score"),
        F.coalesce("gaps", clean_gaps(r["gaps"])).alias("gaps"),
        F.when(settled, F.col("recommendations")).otherwise(clean_recommendations(r["recommendations"])).alias("recommendations"),
        F.when(settled, F.lit("")).otherwise(F.trim(F.coalesce(r["reasoning"], F.lit("")))).alias("reasoning"),
        F.when(settled, F.array().cast("array<struct<title:string,text:string,regulation:string,article_ref:string>>")).otherwise(shown).alias("passages"),
    )


def overall_scores(scores: DataFrame, gates: DataFrame) -> DataFrame:
    """(doc_id, overall, scope_empty): the mean of all articles' scores without a gate (articles NULL); 100 if no article applies,
    or none of those scored; else the mean of those that apply; one decimal."""
    rows = scores.select("doc_id", "article", "score").join(gates.select("doc_id", "articles"), "doc_id", "left")
    counts = F.col("articles").isNull() | F.array_contains("articles", F.col("article"))
    out = rows.groupBy("doc_id").agg(F.avg(F.when(counts, F.col("score"))).alias("mean"))
    return out.select("doc_id", F.round(F.coalesce("mean", F.lit(100.0)), 1).alias("overall"), F.col("mean").isNull().alias("scope_empty"))


def risk_tier(prohibited: Column, high: Column, fallback: Column) -> Column:
    """prohibited, high or minimal by the gate; without one (NULL), the fallback."""
    return F.when(prohibited, "prohibited").when(high, "high").when(prohibited.isNull() & high.isNull(), fallback).otherwise("minimal")


def confidence_review(df: DataFrame) -> DataFrame:
    """doc_id, confidence and needs_review, from actor, actor_confidence, total_obligations, coverage, is_high_risk, n_chunks and
    n_classified: the mean of what is known of actor_confidence, half of one plus half the coverage (one half for a high risk
    without obligations), and the share of chunks that are classified; 1 if nothing is known."""
    duties = F.when(F.col("total_obligations") > 0, 0.5 + F.col("coverage") / 2).when((F.col("total_obligations") == 0) & F.col("is_high_risk"), 0.5)
    mean = confidence(F.col("actor_confidence"), duties, F.when(F.col("n_chunks") > 0, F.col("n_classified") / F.col("n_chunks")))
    review = (mean < 0.7) | F.coalesce(F.col("actor") == "unknown", F.lit(False))
    return df.select("doc_id", F.round(mean, 2).alias("confidence"), review.alias("needs_review"))


def build_reports(docs: DataFrame, scores: DataFrame, overall: DataFrame, trust: DataFrame, articles: list[int]) -> DataFrame:
    """One nested row for each document: its columns, overall score, confidence, review flag, and the scores of all articles in
    order, each with its gaps; articles without a score have 0."""
    grid = docs.select("doc_id", F.explode(F.array(*map(F.lit, articles))).alias("article")).join(scores, ["doc_id", "article"], "left")
    one = F.struct("article", F.coalesce("score", F.lit(0.0)).alias("score"), F.coalesce("chunk_count", F.lit(0)).alias("chunk_count"), F.coalesce("gaps", F.array().cast(f"array<{GAP}>")).alias("gaps"))
    nested = grid.groupBy("doc_id").agg(F.array_sort(F.collect_list(one)).alias("article_scores"))
    return docs.join(nested, "doc_id").join(overall, "doc_id", "left").join(trust, "doc_id", "left")


def full_reports(audits: DataFrame, scores: DataFrame, domains: dict[int, str], versions: dict[str, str], backend: str) -> DataFrame:
    """One nested row for each audit with all that its reader sees.

    audits, a row a document: doc_id, total_chunks, classified_chunks, fallback_tier, wizard_tier, emotion (struct or null), actor
    (struct actor, confidence, or null), applicability (struct articles, is_prohibited, is_high_risk, or null), evidence (struct
    total, mean_coverage and more, or null); other columns pass through. scores: as article_scores gives; domains: each article of
    a report with its domain. Articles without a score have 0 and empty lists; scores of other articles are left out.

    overall_score: the mean of the applicable articles' scores, 100 if there is none, of all if applicability is null. risk_tier:
    from applicability, else fallback_tier. confidence_score and requires_human_review: see confidence_review. model_versions and
    classifier_backend: of all reports. Rows of one doc_id each make a report. Of several scores of
    one article the smallest counts. Null doc_id: its articles score 0. The scores are
    shuffled once, by doc_id."""
    text = "array<string>"
    shown = "array<struct<title:string,text:string,regulation:string,article_ref:string>>"
    none = {"score": F.lit(0.0), "chunk_count": F.lit(0), "reasoning": F.lit(""), "gaps": F.array().cast(f"array<{GAP}>"), "recommendations": F.array().cast(text), "passages": F.array().cast(shown)}
    kept = scores.where(F.col("article").isin(*domains))
    held = kept.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("article", *none))).alias("_scored"))
    rows = audits.join(held, "doc_id", "left")

    def one(article: int, domain: str) -> Column:
        own = F.try_element_at(F.filter("_scored", lambda x: x["article"] == article), F.lit(1))
        return F.struct(F.lit(article).alias("article"), F.lit(domain).alias("domain"), *[F.coalesce(own[name], absent).alias(name) for name, absent in none.items()])

    rows = rows.withColumn("article_scores", F.array(*[one(a, d) for a, d in sorted(domains.items())])).drop("_scored")
    gate, duties = F.col("applicability"), F.col("evidence")
    counted = F.filter("article_scores", lambda x: gate.isNull() | F.array_contains(gate["articles"], x["article"]))
    share = F.when(duties["total"] > 0, 0.5 + duties["mean_coverage"] / 2).when((duties["total"] == 0) & gate["is_high_risk"], 0.5)
    mean = confidence(F.col("actor")["confidence"], share, F.when(F.col("total_chunks") > 0, F.col("classified_chunks") / F.col("total_chunks")))
    return rows.select(
        *[c for c in audits.columns if c != "fallback_tier"],
        "article_scores",
        F.round(overall_score(F.transform(counted, lambda x: x["score"])), 1).alias("overall_score"),
        risk_tier(gate["is_prohibited"], gate["is_high_risk"], F.col("fallback_tier")).alias("risk_tier"),
        F.round(mean, 2).alias("confidence_score"),
        ((mean < 0.7) | F.coalesce(F.col("actor")["actor"] == "unknown", F.lit(False))).alias("requires_human_review"),
        F.lit(backend).alias("classifier_backend"),
        F.map_from_arrays(F.array(*map(F.lit, versions)), F.array(*map(F.lit, versions.values()))).cast("map<string,string>").alias("model_versions"),
    )


def context(items: Column, n: int) -> Column:
    """The first n items as one text with blank lines between."""
    return F.array_join(F.slice(items, 1, n), "\n\n")


def build_context(passages: Column, findings: Column, chunks: Column) -> Column:
    """The parts of a prompt: struct (law, findings, text). passages (title, text): five, of 400 characters; findings (requirement,
    finding): ten, of 60 and 200; chunks (text): the fifteen longest, in that order."""
    law = F.transform(passages, lambda p: F.concat(F.lit("["), F.coalesce(p["title"], F.lit("")), F.lit("]\n"), F.substring(p["text"], 1, 400)))
    lines = F.transform(findings, lambda f: F.concat(F.lit("["), F.substring(f["requirement"], 1, 60), F.lit("]: "), F.substring(f["finding"], 1, 200)))
    by_length = F.array_sort(F.transform(chunks, lambda c, i: F.struct((-F.length(c)).alias("n"), i.alias("i"), c.alias("text"))))
    empty = lambda c, text: F.when(F.coalesce(F.size(c), F.lit(0)) > 0, F.lit(None)).otherwise(text)
    return F.struct(
        F.coalesce(empty(passages, "(no regulatory passages retrieved)"), context(law, 5)).alias("law"),
        F.coalesce(empty(findings, "No findings could be extracted."), F.array_join(F.slice(lines, 1, 10), "\n")).alias("findings"),
        F.coalesce(empty(chunks, "(no relevant documentation found)"), context(F.transform(by_length, lambda c: c["text"]), 15)).alias("text"),
    )


def meaningful(df: DataFrame, group: str, least: int = 80) -> DataFrame:
    """Rows of at least so many characters; all rows of a group in which none has. Texts aren't moved: the groups that have a long
    row are a small table."""
    long_ = F.length(F.trim("text")) >= least
    some = broadcast_if_small(df.where(long_).select(F.col(group).alias("_g"), F.lit(True).alias("_some")).distinct())
    kept = df.join(some, F.col(group).eqNullSafe(F.col("_g")), "left")
    return kept.where(long_ | F.col("_some").isNull()).drop("_g", "_some")


def grounding_checks(scores: DataFrame, vocabulary: list[str]) -> DataFrame:
    """(doc_id, article, problem): an analysed article without passages; gaps without title or description, or described in under
    four words; recommendations that name no word of the vocabulary."""
    gap = scores.select("doc_id", "article", F.explode("gaps").alias("g"))
    words = F.size(F.filter(F.split(F.trim("g.description"), r"\s+"), lambda w: w != ""))
    rec = scores.select("doc_id", "article", F.explode("recommendations").alias("r"))
    rows = [
        scores.where((F.col("chunk_count") > 0) & (F.size("passages") <= 0)).select("doc_id", "article", F.lit("no passages").alias("problem")),
        gap.where(F.trim(F.coalesce("g.title", F.lit(""))) == "").select("doc_id", "article", F.lit("empty title")),
        gap.where(F.trim(F.coalesce("g.description", F.lit(""))) == "").select("doc_id", "article", F.lit("empty description")),
        gap.where((F.coalesce("g.description", F.lit("")) != "") & (words < 4)).select("doc_id", "article", F.lit("short description")),
        rec.where(~contains_any(F.col("r"), vocabulary)).select("doc_id", "article", F.lit("not grounded")),
    ]
    out = rows[0]
    for r in rows[1:]:
        out = out.unionAll(r)
    return out


def citation_rate(scores: DataFrame, problems: DataFrame) -> DataFrame:
    """One row: the share of analysed articles that have passages, violations, and pass (0.90 and none), warn (0.75) or fail."""
    rate = scores.where("chunk_count > 0").agg(F.coalesce(F.avg((F.size("passages") > 0).cast("double")), F.lit(0.0)).alias("rate"))
    both = rate.crossJoin(problems.agg(F.count("*").alias("violations")))  # a row each
    return both.withColumn("status", F.when((F.col("rate") >= 0.9) & (F.col("violations") == 0), "pass").when(F.col("rate") >= 0.75, "warn").otherwise("fail"))


def invariant_checks(reports: DataFrame, n_articles: int = 7) -> DataFrame:
    """(doc_id, check, holds): what every report must satisfy, in long form. reports: overall, confidence, actor, articles,
    total_obligations, n_chunks, n_classified, article_scores (score, chunk_count, gaps, reasoning)."""
    a = F.col("article_scores")
    gaps = lambda f: F.forall(a, lambda x: F.forall(x["gaps"], f))
    checks = {
        "all_chunks_classified": F.col("n_chunks") == F.col("n_classified"),
        "all_articles_present": F.size(a) == n_articles,
        "score_in_range": F.col("overall").between(0, 100),
        "article_scores_in_range": F.forall(a, lambda x: x["score"].between(0, 100)),
        "reasoning_populated": F.forall(a, lambda x: (x["chunk_count"] <= 0) | (x["reasoning"] != "")),
        "gap_titles_non_empty": gaps(lambda g: g["title"] != ""),
        "gap_descriptions_non_empty": gaps(lambda g: g["description"] != ""),
        "actor_populated": F.col("actor").isNotNull(),
        "actor_valid": F.col("actor").isin("provider", "deployer", "importer", "distributor", "unknown"),
        "applicability_populated": F.col("articles").isNotNull(),
        "evidence_map_populated": F.col("total_obligations").isNotNull(),
        "confidence_is_number": F.col("confidence").isNotNull() & ~F.isnan("confidence"),
    }
    long_ = F.explode(F.array(*[F.struct(F.lit(k).alias("check"), F.coalesce(c, F.lit(False)).alias("holds")) for k, c in checks.items()])).alias("x")
    return reports.select("doc_id", long_).select("doc_id", "x.*")


def pass_ratio(checks: DataFrame) -> DataFrame:
    """(doc_id, passed, total, status): pass if all hold, warn if one doesn't."""
    n = checks.groupBy("doc_id").agg(F.count_if("holds").alias("passed"), F.count("*").alias("total"))
    return n.withColumn("status", F.when(F.col("passed") == F.col("total"), "pass").when(F.col("passed") >= F.col("total") - 1, "warn").otherwise("fail"))
