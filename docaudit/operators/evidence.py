"""Obligations, the evidence they ask for, and what chunks show."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from docaudit.functions.plan import broadcast_if_small
from docaudit.functions.text import rule_scan, synonym_pattern


#: Obligations that go to every task.
FEW = 1_000


def applicable_obligations(audits: DataFrame, obligations: DataFrame) -> DataFrame:
    """audits (doc_id, role, articles, gdpr_articles) with each obligation that applies: its actors are empty or hold the role,
    and its article, if it has one, is among those of its regulation.

    Up to FEW obligations meet each document where it is read. More of them meet each distinct combination of role and articles
    once, on which alone it rests what applies; documents are joined back by it."""
    names = ["role", "articles", "gdpr_articles"]
    articles = F.when(F.col("regulation") == "gdpr", F.col("gdpr_articles")).otherwise(F.col("articles"))
    fits = (F.coalesce(F.size("actor"), F.lit(0)) <= 0) | F.array_contains("actor", F.col("role"))
    applies = F.col("article_num").isNull() | F.coalesce(F.array_contains(articles, F.col("article_num")), F.lit(False))
    if obligations.limit(FEW + 1).count() <= FEW:
        return audits.join(F.broadcast(obligations), fits & applies).select(*audits.columns, *obligations.columns)
    kinds = broadcast_if_small(audits.select(*names).distinct(), 100_000)
    due = obligations.join(kinds, fits & applies)
    on = [audits[n].eqNullSafe(due[n]) for n in names]
    return audits.join(due, on[0] & on[1] & on[2]).select(audits["*"], *[due[c] for c in obligations.columns])


def evidence_hits(docs: DataFrame, synonyms: dict[str, list[str]], required: list[str] | None = None, chunk: str | None = None) -> DataFrame:
    """(doc_id, term) for each evidence term of which a synonym occurs in the text; a required term without synonyms is looked
    for itself. chunk: a column that tells a document's parts apart; it comes along as chunk_id."""
    words = synonyms | {t: [t] for t in required or [] if t not in synonyms}
    rules = [("evidence", i, synonym_pattern(w).removeprefix("(?diuU)"), term) for i, (term, w) in enumerate(words.items())]
    if chunk is None:
        return rule_scan(docs, rules).select("doc_id", F.col("label").alias("term"))
    return rule_scan(docs.withColumn("doc_id", F.struct("doc_id", chunk)), rules).select("doc_id.doc_id", F.col("label").alias("term"), F.col(f"doc_id.{chunk}").alias("chunk_id"))


def evidence_items(audits: DataFrame, obligations: DataFrame, hits: DataFrame) -> DataFrame:
    """(doc_id, obligation_id, regulation, n_required, n_satisfied, satisfied, missing, coverage) of every obligation that applies,
    the terms in declared order, coverage to three decimals; with chunk_ids, distinct and in order, if hits have chunk_id."""
    due = applicable_obligations(audits, obligations)
    each = ["doc_id", "obligation_id", "regulation", F.posexplode_outer("evidence_required").alias("pos", "term")]
    chunked = "chunk_id" in hits.columns
    if chunked:
        found = hits.groupBy("doc_id", "term").agg(F.lit(True).alias("hit"), F.collect_set("chunk_id").alias("_chunks"))
        got = due.select(*each).join(found, ["doc_id", "term"], "left")
    else:  # a document's terms come along as one row, and what follows stays with it
        found = hits.groupBy("doc_id").agg(F.collect_set("term").alias("_terms"))
        got = due.join(found, "doc_id", "left").select(*each, "_terms").withColumn("hit", F.when(F.array_contains("_terms", F.col("term")), True))
    listed = lambda c: F.array_join(F.transform(F.array_sort(F.collect_list(F.when(c & F.col("term").isNotNull(), F.struct("pos", "term")))), lambda x: x["term"]), ",")
    more = [F.array_sort(F.array_distinct(F.flatten(F.collect_list("_chunks")))).alias("chunk_ids")] * chunked
    out = got.groupBy("doc_id", "obligation_id", "regulation").agg(F.count("term").alias("n_required"), F.count("hit").alias("n_satisfied"), listed(F.col("hit").isNotNull()).alias("satisfied"), listed(F.col("hit").isNull()).alias("missing"), *more)
    return out.withColumn("coverage", F.round(F.coalesce(F.try_divide(F.col("n_satisfied"), F.col("n_required")), F.lit(0.0)), 3))


def evidence_map(docs: DataFrame, items: DataFrame) -> DataFrame:
    """Counts of obligations covered fully, partly and not at all, and mean coverage; zeros without obligations."""
    c = F.col("coverage")
    n = items.groupBy("doc_id").agg(F.count("*").alias("total"), F.count_if(c >= 1).alias("fully"), F.count_if((c > 0) & (c < 1)).alias("partial"), F.count_if(c == 0).alias("missing"), F.avg(c).alias("mean_coverage"))
    return docs.select("doc_id").join(n, "doc_id", "left").na.fill(0)


def row_coverage(role: str, articles: str, gdpr_articles: str, terms: str, duties: str) -> Column:
    """What evidence_map gives, from one row's columns: struct (total, fully, partial, missing, mean_coverage). terms: those found;
    duties: the obligations, an array of structs (regulation, article_num, actor, evidence_required)."""
    listed = lambda o: F.when(o["regulation"] == "gdpr", F.col(gdpr_articles)).otherwise(F.col(articles))
    fits = lambda o: (F.coalesce(F.size(o["actor"]), F.lit(0)) <= 0) | F.array_contains(o["actor"], F.col(role))
    due = F.filter(duties, lambda o: fits(o) & (o["article_num"].isNull() | F.coalesce(F.array_contains(listed(o), o["article_num"]), F.lit(False))))
    share = lambda o: F.try_divide(F.size(F.filter(o["evidence_required"], lambda t: F.array_contains(F.col(terms), t))), F.size(o["evidence_required"]))
    c = F.transform(due, lambda o: F.round(F.coalesce(share(o), F.lit(0.0)), 3))
    n = lambda f: F.size(F.filter(c, f)).cast("long")
    mean = F.coalesce(F.try_divide(F.aggregate(c, F.lit(0.0), lambda s, x: s + x), F.size(c)), F.lit(0.0))
    return F.struct(F.size(c).cast("long").alias("total"), n(lambda x: x >= 1).alias("fully"), n(lambda x: (x > 0) & (x < 1)).alias("partial"), n(lambda x: x == 0).alias("missing"), mean.alias("mean_coverage"))


def coverage_by_regulation(items: DataFrame) -> DataFrame:
    """Counts, mean coverage in percent and missing artefacts of each document and regulation, of each document (regulation NULL)
    and of all (both NULL)."""
    c = F.col("coverage")
    return items.rollup("doc_id", "regulation").agg(F.count_if(c >= 1).alias("fully"), F.count_if((c > 0) & (c < 1)).alias("partial"), F.count_if(c == 0).alias("missing"), (F.avg(c) * 100).alias("mean_pct"), F.sum(F.col("n_required") - F.col("n_satisfied")).alias("missing_artefacts"))


def article_text(keys: DataFrame, texts: DataFrame) -> DataFrame:
    """keys (regulation, article, lang) with text: in the language asked for, else in English, else ''."""
    own = texts.select("regulation", "article", "lang", F.col("text").alias("_own"))
    english = texts.where("lang = 'en'").select("regulation", "article", F.col("text").alias("_en"))
    out = keys.join(own, ["regulation", "article", "lang"], "left").join(english, ["regulation", "article"], "left")
    return out.select(*keys.columns, F.coalesce("_own", "_en", F.lit("")).alias("text"))


def validate_obligations(obligations: DataFrame, actors: list[str], terms: list[str]) -> DataFrame:
    """(obligation_id, problem): article zero, unknown actor, blank evidence, evidence without synonyms."""
    o = obligations
    bad_actor = F.exists("actor", lambda a: ~a.isin(*actors))
    each = o.select("obligation_id", F.explode("evidence_required").alias("term"))
    parts = [o.where(F.col("article_num") == 0).select("obligation_id", F.lit("article zero").alias("problem")), o.where(bad_actor).select("obligation_id", F.lit("unknown actor")), each.where(F.trim("term") == "").select("obligation_id", F.lit("blank evidence")), each.where((F.trim("term") != "") & ~F.col("term").isin(*terms)).select("obligation_id", F.lit("no synonyms"))]
    out = parts[0]
    for p in parts[1:]:
        out = out.union(p)
    return out


def overall_score(scores: Column) -> Column:
    """Mean of an array of article scores; 100 if there are none."""
    return F.when(F.size(scores) > 0, F.aggregate(scores, F.lit(0.0), lambda s, x: s + x) / F.size(scores)).otherwise(100.0)


def confidence(*parts: Column) -> Column:
    """Mean of the parts that are known; 1 if none is."""
    known = F.array_compact(F.array(*parts))
    return F.when(F.size(known) > 0, F.aggregate(known, F.lit(0.0), lambda s, x: s + x) / F.size(known)).otherwise(1.0)
