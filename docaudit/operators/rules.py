"""Decisions by rules: actor, category, tier, applicability, weak labels, entity spans."""

import bisect
import re
from collections.abc import Iterator

import numpy as np
import pandas as pd
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from docaudit.functions.slices import each_text
from docaudit.functions.text import FLAGS, contains_any, rule_scan

Rules = list[tuple[str, int, str, str]]


def actor_vote(docs: DataFrame, rules: Rules, order: list[str], default: str, entities: DataFrame | None = None, prefixes: tuple[str, ...] = ("our ", "unser ", "unsere ")) -> DataFrame:
    """Most signals win, ties by the order of classes; without any, the default at 0.3. Confidence to two decimals.

    entities (doc_id, label, text): each distinct AI_SYSTEM that begins with a prefix is a signal of the first class."""
    n = rule_scan(docs, rules).select("doc_id", F.col("rule_group").alias("actor"))
    if entities is not None:
        own = F.lit(False)
        for p in prefixes:
            own = own | F.lower("text").startswith(p)
        n = n.unionAll(entities.where((F.col("label") == "AI_SYSTEM") & own).select("doc_id", "text").distinct().select("doc_id", F.lit(order[0])))
    n = n.groupBy("doc_id", "actor").agg(F.count("*").alias("n"))
    rank = F.array_position(F.array(*map(F.lit, order)), F.col("actor"))
    by = Window.partitionBy("doc_id").orderBy(F.desc("n"), rank)
    n = n.withColumn("place", F.row_number().over(by)).groupBy("doc_id").agg(F.max(F.when(F.col("place") == 1, F.struct("actor", "n"))).alias("win"), F.coalesce(F.max(F.when(F.col("place") == 2, F.col("n"))), F.lit(0)).alias("second"), F.sum("n").alias("total"))
    share = F.col("win.n") / F.col("total") * 0.7 + (F.col("win.n") - F.col("second")) / F.col("win.n") * 0.3
    n = n.select("doc_id", "win.actor", F.round(F.least(F.lit(1.0), share), 2).alias("confidence"))
    return docs.select("doc_id").join(n, "doc_id", "left").select("doc_id", F.coalesce("actor", F.lit(default)).alias("actor"), F.coalesce("confidence", F.lit(0.3)).alias("confidence"))


def row_vote(hits: Column, order: list[str], default: str) -> Column:
    """What actor_vote gives, from one row's array of classes: struct (actor, confidence)."""
    n = F.array(*[F.size(F.filter(hits, _equals(c))) for c in order])
    places = F.array_sort(F.filter(n, lambda x: x > 0), lambda x, y: y - x)
    win, second = places[0], F.coalesce(F.try_element_at(places, F.lit(2)), F.lit(0))
    share = win / F.aggregate(n, F.lit(0), lambda s, x: s + x) * 0.7 + (win - second) / win * 0.3
    some = F.size(places) > 0
    return F.struct(most_hits(hits, order, default).alias("actor"), F.when(some, F.round(F.least(F.lit(1.0), share), 2)).otherwise(0.3).alias("confidence"))


def most_hits(hits: Column, order: list[str], default: str) -> Column:
    """The class that stands most often in an array of classes, ties by their order; the default if it is empty."""
    n = [F.size(F.filter(hits, _equals(c))) for c in order]
    most = F.greatest(*n) if len(n) > 1 else n[0]
    return F.when(F.size(hits) == 0, default).otherwise(F.coalesce(*[F.when(k == most, F.lit(c)) for k, c in zip(n, order)]))


def _equals(value: str):
    return lambda x: x == value


def apply_override(df: DataFrame, predictions: DataFrame, least: float = 0.8, known: tuple[str, ...] | None = None) -> DataFrame:
    """A prediction of enough confidence replaces the rule's actor; a label that isn't known becomes 'unknown'."""
    p = predictions.select("doc_id", F.col("label").alias("_label"), F.col("confidence").alias("_sure"))
    sure = F.col("_sure") >= least
    label = F.col("_label") if known is None else F.when(F.col("_label").isin(*known), F.col("_label")).otherwise("unknown")
    return df.join(p, "doc_id", "left").select("doc_id", F.when(sure, label).otherwise(F.col("actor")).alias("actor"), F.when(sure, F.col("_sure")).otherwise(F.col("confidence")).alias("confidence"))


def category_matches(docs: DataFrame, rules: Rules, annex: DataFrame | None = None) -> DataFrame:
    """(doc_id, category, keywords): labels in the order of rules, joined by commas.

    annex (category, id, evidence_required): adds obligation_id, by default made from the category, and evidence_required."""
    hits = rule_scan(docs, rules).groupBy("doc_id", F.col("rule_group").alias("category"))
    out = hits.agg(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("rule_idx", "label"))), lambda x: x["label"]), ",").alias("keywords"))
    if annex is None:
        return out
    made = F.concat(F.lit("AIACT_ART6_ANNEXIII_CAT"), F.col("category"))
    return out.join(annex.select("category", "id", "evidence_required"), "category", "left").select("doc_id", "category", "keywords", F.coalesce("id", made).alias("obligation_id"), F.coalesce("evidence_required", F.array().cast("array<string>")).alias("evidence_required"))


def entity_signals(entities: DataFrame, label: str, terms: list[str] | None = None) -> DataFrame:
    """(doc_id, signals): the distinct texts of a label's entities in a document, in order of first place; only those among terms,
    if given, ignoring case."""
    rows = entities.where(F.col("label") == label)
    if terms is not None:
        rows = rows.where(F.lower("text").isin(*terms))
    first = rows.groupBy("doc_id", "text").agg(F.min(F.struct("chunk_id", "start")).alias("first"))
    return first.groupBy("doc_id").agg(F.transform(F.array_sort(F.collect_list(F.struct("first", "text"))), lambda x: F.concat(F.lit("NER: "), x["text"])).alias("signals"))


#: Terms by which an entity says that a system is of high risk (fixed values).
HIGH_RISK_TERMS = ["high-risk", "high risk", "hochriskant", "hohes risiko"]


def decide(docs: DataFrame, prohibited: Rules, categories: Rules, safety: Rules, entities: DataFrame, predictions: DataFrame, least: float = 0.85) -> DataFrame:
    """doc_id, is_prohibited, is_high_risk, articles and reasoning.

    A prohibited practice (rules, PROHIBITED_USE entities, or a prediction of label prohibited with enough confidence) leaves
    article 5 alone. Else a category, two safety signals, a prediction of high_risk or a RISK_TIER entity makes 9 to 15 apply.
    predictions: doc_id, label, confidence; at most one of each label a document. Documents are scanned once for all rules."""
    every = [(f"p:{g}", i, p, x) for g, i, p, x in prohibited] + [(f"c:{g}", i, p, x) for g, i, p, x in categories] + [(f"s:{g}", i, p, x) for g, i, p, x in safety]
    hits = rule_scan(docs, every).groupBy("doc_id")
    of = lambda kind, c: F.transform(F.array_sort(F.collect_list(F.when(F.col("rule_group").startswith(kind), F.struct("rule_idx", c.alias("x"))))), lambda x: x["x"])
    hits = hits.agg(of("p:", F.col("label")).alias("p"), F.array_sort(F.collect_set(F.when(F.col("rule_group").startswith("c:"), F.substring("rule_group", 3, 1000)))).alias("c"), of("s:", F.col("label")).alias("s"))
    sure = predictions.where(F.col("confidence") >= least).groupBy("doc_id").agg(F.max(F.when(F.col("label") == "prohibited", F.col("confidence"))).alias("mp"), F.max(F.when(F.col("label") == "high_risk", F.col("confidence"))).alias("mh"))
    rows = docs.select("doc_id").join(hits, "doc_id", "left").join(sure, "doc_id", "left")
    rows = rows.join(entity_signals(entities, "PROHIBITED_USE").withColumnRenamed("signals", "ep"), "doc_id", "left").join(entity_signals(entities, "RISK_TIER", HIGH_RISK_TERMS).withColumnRenamed("signals", "eh"), "doc_id", "left")
    none = F.array().cast("array<string>")
    p, c, s, ep, eh = (F.coalesce(F.col(x), none) for x in ("p", "c", "s", "ep", "eh"))
    percent = lambda x: F.concat(F.lit("ML model ("), F.round(x * 100).cast("int").cast("string"), F.lit("% confidence)"))
    signals = F.concat(p, ep, F.when(F.col("mp").isNotNull(), F.array(percent(F.col("mp")))).otherwise(none))
    forbidden = F.size(signals) > 0
    cat, safe, ml, ent = F.size(c) > 0, F.size(s) >= 2, F.col("mh").isNotNull(), F.size(eh) > 0
    high = ~forbidden & (cat | safe | ml | ent)
    parts = F.array_compact(F.array(F.when(cat, F.concat(F.lit("categories: "), F.array_join(c, ", "))), F.when(safe, F.concat(F.lit("safety: "), F.array_join(F.slice(s, 1, 3), ", "))), F.when(ml & ~cat & ~safe, percent(F.col("mh"))), F.when(ent & ~cat & ~safe & ~ml, F.array_join(eh, ", "))))
    reasoning = F.when(forbidden, F.concat(F.lit("prohibited: "), F.array_join(signals, ", "))).when(high, F.concat(F.lit("high risk: "), F.array_join(parts, "; "))).otherwise("no category, no safety signals")
    return rows.select("doc_id", forbidden.alias("is_prohibited"), high.alias("is_high_risk"), applicability(forbidden, high).alias("articles"), reasoning.alias("reasoning"))


def tier_mismatch(derived: Column, declared: Column) -> Column:
    """Whether the tier that users declare differs from the derived one; NULL if it is none of the known tiers."""
    known = F.lower(F.trim(declared))
    return F.when(known.isin("prohibited", "high", "minimal"), known != derived)


def safety_trigger(docs: DataFrame, rules: Rules, least: int = 2) -> DataFrame:
    return rule_scan(docs, rules).groupBy("doc_id").agg(F.count("*").alias("n_signals")).where(F.col("n_signals") >= least)


def second_gate(text: Column, base: list[str], extra: dict[int, list[str]], articles: list[int]) -> Column:
    """Articles of the second regulation: none without a base pattern; else the base articles and those with a pattern of their own."""
    def any_of(patterns: list[str]) -> Column:
        out = F.lit(False)
        for p in patterns:
            out = out | text.rlike(FLAGS + p)
        return out

    more = [F.when(any_of(p), F.lit(a)) for a, p in extra.items()]
    return F.when(any_of(base), F.array_sort(F.array_compact(F.array(*map(F.lit, articles), *more)))).otherwise(F.array().cast("array<int>"))


def applicability(prohibited: Column, high: Column) -> Column:
    """Articles that apply: [5] if prohibited, 9 to 15 if high risk, else none."""
    return F.when(prohibited, F.array(F.lit(5))).when(high, F.sequence(F.lit(9), F.lit(15))).otherwise(F.array().cast("array<int>"))


def tier_by_keywords(text: Column, prohibited: list[str], high: list[str]) -> Column:
    return F.when(contains_any(text, prohibited), "prohibited").when(contains_any(text, high), "high").otherwise("minimal")


def emotion_flag(text: Column, emotion: list[str], contexts: dict[str, list[str]]) -> Column:
    """Struct (detected, context, prohibited): the first context whose words occur; the first two contexts are prohibited."""
    names = list(contexts)
    context = F.coalesce(*[F.when(contains_any(text, w), F.lit(n)) for n, w in contexts.items()], F.lit("unknown"))
    found = contains_any(text, emotion)
    return F.struct(found.alias("detected"), F.when(found, context).alias("context"), (found & context.isin(names[:2])).alias("prohibited"))


def wizard_tier(answers: dict[str, Column]) -> Column:
    """Prohibited if q9, high if any other answer is yes, else minimal; absent answers are no."""
    yes = {k: F.coalesce(c, F.lit(False)) for k, c in answers.items()}
    other = F.lit(False)
    for k, c in yes.items():
        if k != "q9":
            other = other | c
    return F.when(yes["q9"], "prohibited").when(other, "high").otherwise("minimal")


def weak_label_vote(df: DataFrame, rules: Rules, key: str = "doc_id") -> DataFrame:
    """(doc_id, label): the class with most rule hits; ties go to the class that voted first in rule order; no vote, no row."""
    hits = rule_scan(df, rules).groupBy("doc_id", F.col("rule_group").alias("label")).agg(F.count("*").alias("n"), F.min("rule_idx").alias("first"))
    return hits.groupBy("doc_id").agg(F.max_by("label", F.struct("n", -F.col("first"))).alias("label"))


def count_hits(text: Column, patterns: list[str]) -> Column:
    out = F.lit(0)
    for p in patterns:
        out = out + text.rlike(FLAGS + p).cast("int")
    return out


def weak_label_binary(df: DataFrame, yes: list[str], no: list[str], names: tuple[str, str]) -> DataFrame:
    """Two-sided labels: the side with more hits; ties and none drop the row."""
    df = df.withColumn("_yes", count_hits(F.col("text"), yes)).withColumn("_no", count_hits(F.col("text"), no))
    return df.where(F.col("_yes") != F.col("_no")).withColumn("label", F.when(F.col("_yes") > F.col("_no"), names[0]).otherwise(names[1])).drop("_yes", "_no")


def lf_votes(text: Column, lexicon: list[list[str]], unrelated: tuple[list[str], list[str]] | None = None) -> Column:
    """ARRAY<INT>: labelling function i votes i if one of its words occurs, else abstains with -1.

    unrelated (words, veto): one function more, which abstains if a veto word occurs."""
    votes = [F.when(contains_any(text, words), F.lit(i)).otherwise(F.lit(-1)) for i, words in enumerate(lexicon)]
    if unrelated:
        votes.append(F.when(contains_any(text, unrelated[0]) & ~contains_any(text, unrelated[1]), F.lit(len(lexicon))).otherwise(F.lit(-1)))
    return F.array(*votes)


def lf_summary(votes: DataFrame) -> DataFrame:
    """Polarity (the labels that it gives), coverage, overlaps and conflicts of each labelling function, as shares of all rows."""
    n = F.size(F.filter("votes", lambda v: v >= 0))
    distinct = F.size(F.array_distinct(F.filter("votes", lambda v: v >= 0)))
    each = votes.select(n.alias("n"), distinct.alias("d"), F.posexplode("votes").alias("lf", "vote"))
    cast = F.col("vote") >= 0
    share = lambda c: F.avg(c.cast("double"))
    polarity = F.array_join(F.array_sort(F.collect_set(F.when(cast, F.col("vote")))).cast("array<string>"), ",")
    return each.groupBy("lf").agg(polarity.alias("polarity"), share(cast).alias("coverage"), share(cast & (F.col("n") > 1)).alias("overlaps"), share(cast & (F.col("d") > 1)).alias("conflicts"))


def _posterior(v: np.ndarray, acc: np.ndarray, prior: np.ndarray) -> np.ndarray:
    """Chances of the classes for each vote vector (-1: abstains), if functions err alone and evenly over the other classes."""
    k = len(prior)
    log = np.tile(np.log(prior), (len(v), 1))
    for j, a in enumerate(acc):
        on = v[:, j] >= 0
        log[on] += np.log((1 - a) / max(1, k - 1))
        log[np.flatnonzero(on), v[on, j]] += np.log(a) - np.log((1 - a) / max(1, k - 1))
    post = np.exp(log - log.max(axis=1, keepdims=True)) if len(v) else log
    return post / post.sum(axis=1, keepdims=True)


def fit_label_model(votes: DataFrame, k: int, rounds: int = 25) -> tuple[np.ndarray, np.ndarray]:
    """Accuracy of each function and share of each class, by expectation maximisation over distinct vote vectors and their counts.

    A round is a job: tasks sum what their vectors tell (a row a function and a class), and only those sums reach the driver. Null
    and empty vote arrays tell nothing; arrays are of one length. No votes at all: accuracies stay 0.7, classes stay even. The last
    round is the use of the model."""
    groups = votes.where(F.size("votes") > 0).groupBy("votes").agg(F.count("*").cast("double").alias("n")).persist()
    try:
        first = groups.agg(F.min(F.size("votes")).alias("m"), F.max(F.size("votes")).alias("most")).first()
        if first["m"] != first["most"]:
            raise ValueError("vote arrays differ in length")
        m = first["m"] or 0
        acc, prior = np.full(m, 0.7), np.full(k, 1 / k)
        for _ in range(rounds - 1 if m else 0):

            def told(batches: Iterator[pd.DataFrame], acc=acc, prior=prior) -> Iterator[pd.DataFrame]:
                right, cast, share = np.zeros(len(acc)), np.zeros(len(acc)), np.zeros(len(prior))
                for batch in batches:
                    v, n = np.array(batch["votes"].tolist(), int).reshape(-1, len(acc)), batch["n"].to_numpy()
                    post = _posterior(v, acc, prior)
                    share += n @ post
                    chosen = np.take_along_axis(post, np.maximum(v, 0), axis=1) * (v >= 0)
                    right += n @ chosen
                    cast += n @ (v >= 0)
                none = np.zeros(len(prior))
                yield pd.DataFrame({"what": ["f"] * len(acc) + ["c"] * len(prior), "i": [*range(len(acc)), *range(len(prior))], "x": [*right, *share], "n": [*cast, *none]})

            sums = groups.mapInPandas(told, "what string, i int, x double, n double").groupBy("what", "i").agg(F.sum("x").alias("x"), F.sum("n").alias("n")).collect()  # m + k rows
            of = {(r["what"], r["i"]): (r["x"], r["n"]) for r in sums}
            right, cast = np.array([of["f", j] for j in range(m)]).T
            acc = np.clip(right / np.maximum(cast, 1e-9), 0.05, 0.95)
            share = np.array([of["c", c][0] for c in range(k)])
            prior = np.clip(share / max(share.sum(), 1e-9), 1e-3, None)
        return acc, prior
    finally:
        groups.unpersist()


def label_model(votes: DataFrame, k: int, rounds: int = 25) -> DataFrame:
    """Denoised labels: adds label and confidence, by the model that fit_label_model gives, row by row and without a join. Rows of
    abstentions only, and ties, are dropped."""
    acc, prior = fit_label_model(votes, k, rounds)

    @F.pandas_udf("struct<label:int,confidence:double>")
    def judged(of: pd.Series) -> pd.DataFrame:
        v = np.array(of.tolist(), int).reshape(len(of), -1)
        post = _posterior(v, acc, prior)
        top = post.max(axis=1)
        sure = (v >= 0).any(axis=1) & (np.isclose(post, top[:, None]).sum(axis=1) == 1)
        return pd.DataFrame({"label": np.where(sure, post.argmax(axis=1), -1), "confidence": top})

    out = votes.where(F.exists("votes", lambda x: x >= 0)).withColumn("_judged", judged("votes"))
    return out.select(*votes.columns, "_judged.label", "_judged.confidence").where("label >= 0")


def settled(spans: list[tuple[int, int, str]], policy: str) -> list[tuple[int, int, str]]:
    """Spans (start, end, label) that don't overlap: greedy from the left (longest first), or longest first. At most one of the
    spans kept begins before a place and ends after it, so neighbours in order decide."""
    kept: list[tuple[int, int, str]] = []
    for s in sorted(spans, key=lambda x: (x[0], -(x[1] - x[0]), x[2]) if policy == "leftmost" else (-(x[1] - x[0]), x[0], x[2])):
        at = bisect.bisect_left(kept, s)
        if (at == 0 or kept[at - 1][1] <= s[0]) and (at == len(kept) or kept[at][0] >= s[1]):
            kept.insert(at, s)
    return kept


SPAN = "doc_id long, start int, end int, label string"


def annotate(docs: DataFrame, patterns: list[tuple[str, str]], phrases: list[tuple[str, str]], exact: tuple[str, ...] = (), policy: str | None = None, most: int | None = None) -> DataFrame:
    """(doc_id, start, end, label) by regular expressions and phrases (all occurrences, overlaps too; one phrase may have several
    labels). Phrases ignore case, but not those of the labels in `exact`. policy: settles overlaps in the same pass. most: reads
    only so many characters. Null text: none. Offsets are of the text as it stands, whatever lower case does to its length."""

    def start():
        import ahocorasick

        compiled = [(re.compile(p), label) for label, p in patterns]
        machines = []
        for case in (False, True):
            own: dict[str, list[tuple[str, int]]] = {}
            for label, phrase in phrases:
                if (label in exact) == case:
                    own.setdefault(phrase if case else phrase.lower(), []).append((label, len(phrase if case else phrase.lower())))
            if own:
                machine = ahocorasick.Automaton()
                for phrase, found in own.items():
                    machine.add_word(phrase, found)
                machine.make_automaton()
                machines.append((machine, case))
        def spans_of(text: str) -> list[tuple[int, int, str]]:
            text = text[:most]
            spans = [(m.start(), m.end(), label) for p, label in compiled for m in p.finditer(text)]
            low = text.lower()
            # a letter may be several in lower case: where each of those stands in the text
            place = range(len(text) + 1) if len(low) == len(text) else [i for i, ch in enumerate(text) for _ in ch.lower()] + [len(text)]
            for machine, case in machines:
                for end, found in machine.iter(text if case else low):
                    spans += [(end + 1 - n, end + 1, label) if case else (place[end + 1 - n], place[end] + 1, label) for label, n in found]
            return settled(spans, policy) if policy else spans

        return spans_of

    return each_text(docs, "doc_id", "text", SPAN.removeprefix("doc_id long, "), start)


def resolve_spans(spans: DataFrame, policy: str = "leftmost", ends: DataFrame | None = None) -> DataFrame:
    """Spans that don't overlap, of one document after another: greedy from the left (longest first), or longest first.

    ends (doc_id, tokens: array of struct start, end): only spans that begin and end with tokens take part."""
    if ends is not None:
        on = F.exists("tokens", lambda t: t["start"] == F.col("start")) & F.exists("tokens", lambda t: t["end"] == F.col("end"))
        spans = spans.join(ends, "doc_id").where(on).select("doc_id", "start", "end", "label")

    def pick(group: pd.DataFrame) -> pd.DataFrame:
        kept = settled(list(group[["start", "end", "label"]].itertuples(index=False, name=None)), policy)
        return pd.DataFrame([(group["doc_id"].iloc[0], *x) for x in kept], columns=["doc_id", "start", "end", "label"])

    return spans.select("doc_id", "start", "end", "label").groupBy("doc_id").applyInPandas(pick, SPAN)  # a document's own spans


def group_entities(spans: DataFrame) -> DataFrame:
    """(doc_id, entities): of each document a map from label to its entities' texts in the order of the text; spans have text."""
    each = spans.groupBy("doc_id", "label").agg(F.transform(F.array_sort(F.collect_list(F.struct("start", "end", "text"))), lambda x: x["text"]).alias("texts"))
    return each.groupBy("doc_id").agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("label", "texts")))).alias("entities"))


def entity_records(sentences: DataFrame, spans: DataFrame) -> DataFrame:
    """Sentences (doc_id, text) that have an entity, with all of theirs."""
    own = spans.groupBy("doc_id").agg(F.array_sort(F.collect_list(F.struct("start", "end", "label"))).alias("entities"))
    return sentences.join(own, "doc_id")


def entail_gate(scores: DataFrame, hits: DataFrame, labels: list[str], least: float = 0.5) -> DataFrame:
    """(doc_id, term) pairs that a model accepts: scores (doc_id, term, scores: array by labels) of pairs that no rule hit, whose
    largest score is that of 'entailment' and at least `least`."""
    open_ = scores.join(hits.select("doc_id", "term").distinct(), ["doc_id", "term"], "left_anti")
    yes = F.element_at("scores", labels.index("entailment") + 1)
    return open_.where((yes == F.array_max("scores")) & (F.array_position("scores", F.array_max("scores")) == labels.index("entailment") + 1) & (yes >= least)).select("doc_id", "term")


def override_spans(model: DataFrame, dictionary: DataFrame) -> DataFrame:
    """Dictionary spans, and the model's that overlap none of them."""
    d = dictionary.select(F.col("doc_id").alias("_d"), F.col("start").alias("_s"), F.col("end").alias("_e"))
    apart = model.join(d, (F.col("doc_id") == F.col("_d")) & (F.col("start") < F.col("_e")) & (F.col("_s") < F.col("end")), "left_anti")
    return apart.unionByName(dictionary)


def correct_domain(chunks: DataFrame, domains: dict[int, str]) -> DataFrame:
    """A chunk of domain 'unrelated' whose articles are one single number gets that article's domain."""
    table = F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])
    one = (F.col("domain") == "unrelated") & (F.size("articles") == 1)
    return chunks.withColumn("domain", F.when(one, F.coalesce(table[F.element_at("articles", 1)], F.col("domain"))).otherwise(F.col("domain")))


def domain_of(article: Column, domains: dict[int, str]) -> Column:
    """The domain of an article; NULL for others."""
    return F.create_map(*[F.lit(x) for kv in domains.items() for x in kv])[article]


def article_of(domain: Column, domains: dict[int, str]) -> Column:
    """The article of a domain; NULL for others."""
    return F.create_map(*[F.lit(x) for n, d in domains.items() for x in (d, n)])[domain]


def known_labels(df: DataFrame, labels: list[str], column: str = "label") -> DataFrame:
    """Rows whose label is listed."""
    return df.join(F.broadcast(df.sparkSession.range(1).select(F.explode(F.array(*map(F.lit, labels))).alias(column))), column, "left_semi").select(df.columns)  # len(labels) rows
