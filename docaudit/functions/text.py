"""Scalar functions over text, as Spark columns."""

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Flags for patterns: Unicode classes and case, and . stops at \n only.
FLAGS = "(?diuU)"
LABELS = ("risk_management", "data_governance", "technical_documentation", "record_keeping", "transparency", "human_oversight", "security", "unrelated")
#: Stop words by which languages are told apart.
STOP_WORDS = {"de": ("der", "die", "und", "das", "ist", "nicht", "mit", "von"), "en": ("the", "and", "of", "is", "to", "in", "that", "with")}


def strip(c: Column) -> Column:
    return F.regexp_replace(c, r"(?U)^\s+|\s+$", "")


def tokens(c: Column) -> Column:
    """Lower-cased words; everything that is no word character separates."""
    return F.regexp_extract_all(F.lower(c), F.lit(r"(?U)\w+"), F.lit(0))


def _among(listed: tuple[str, ...]):
    return lambda w: w.isin(*listed)


def detect_lang(c: Column) -> Column:
    """'de' or 'en' by stop words in the first 500 characters; under 20 characters, 'en'."""
    words = tokens(F.substring(c, 1, 500))
    hits = {k: F.size(F.filter(words, _among(v))) for k, v in STOP_WORDS.items()}
    return F.when(F.length(F.trim(F.substring(c, 1, 500))) < 20, "en").when(hits["de"] > hits["en"], "de").otherwise("en")


def norm_label(c: Column) -> Column:
    """A label as the model wrote it, trimmed and joined by underscores; unknown ones become 'unrelated'."""
    c = F.regexp_replace(F.lower(F.trim(c)), "[- ]", "_")
    for mark in ('"', ",", "'", ".", "!", "?"):
        c = F.regexp_replace(c, f"^[{mark}]+|[{mark}]+$", "")
    return F.when(c.isin(*LABELS), c).otherwise("unrelated")


def article_num(c: Column) -> Column:
    """The first integer in a reference; NULL if there is none."""
    return F.nullif(F.regexp_extract(c, "[0-9]+", 0), F.lit("")).cast("int")


def article_nums(c: Column) -> Column:
    """Distinct article numbers 9 to 15 in a text, in order."""
    return F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(c, F.lit(r"\b(9|1[0-5])\b"), F.lit(1)), lambda x: x.cast("int"))))


def norm_severity(c: Column) -> Column:
    low = F.lower(c)
    return F.when(low.isin("critical", "major", "minor"), low).otherwise("minor")


def clamp_score(c: Column, default: float = 50) -> Column:
    return F.least(F.greatest(F.coalesce(c, F.lit(default)), F.lit(0)), F.lit(100))


def score_band(c: Column, cuts: list[tuple[float, str]], low: str) -> Column:
    """The first band whose lower cut the value reaches; cuts fall."""
    out = None
    for cut, name in cuts:
        out = (out if out is not None else F).when(c >= cut, name)
    return out.otherwise(low)


def chunk_id(prefix: str, c: Column) -> Column:
    """MD5 of prefix and text, written as a UUID."""
    return F.regexp_replace(F.md5(F.concat(F.lit(prefix), c)), "^(.{8})(.{4})(.{4})(.{4})(.{12})$", "$1-$2-$3-$4-$5")


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x.cast("double") * y.cast("double")), F.lit(0.0), lambda s, x: s + x)


def cos_sim(a: Column, b: Column) -> Column:
    return dot(a, b) / F.greatest(F.sqrt(dot(a, a)) * F.sqrt(dot(b, b)), F.lit(1e-9))


def contains_any(c: Column, words: list[str]) -> Column:
    low, out = F.lower(c), F.lit(False)
    for w in words:
        out = out | low.contains(w)
    return out


def keyword_first(c: Column, words: list[str]) -> Column:
    """The first word of the list that the text contains, ignoring case."""
    low = F.lower(c)
    return F.coalesce(*[F.when(low.contains(w), F.lit(w)) for w in words])


def synonym_pattern(words: list[str], word_boundary: bool = False) -> str:
    body = "|".join("".join("\\" + ch if not ch.isalnum() and ord(ch) < 128 and ch != " " else ch for ch in w) for w in words)
    return FLAGS + (rf"\b(?:{body})\b" if word_boundary else f"(?:{body})")


def rule_scan(df: DataFrame, rules: list[tuple[str, int, str, str]], text: str = "text") -> DataFrame:
    """(doc_id, rule_group, rule_idx, label) for each rule whose pattern occurs; one pass, each pattern compiled once a task."""
    hits = [F.when(F.col(text).rlike(FLAGS + p), F.struct(F.lit(g).alias("rule_group"), F.lit(i).alias("rule_idx"), F.lit(label).alias("label"))) for g, i, p, label in rules]
    return df.select("doc_id", F.explode(F.array_compact(F.array(*hits))).alias("hit")).select("doc_id", "hit.*")


def parse_reply(c: Column, schema: str) -> Column:
    """The JSON object in a model's reply: all of it, else from the first { to the last }; NULL if neither parses."""
    inner = F.regexp_extract(c, r"(?s)(\{.*\})", 1)
    return F.coalesce(*[F.from_json(F.when(F.try_parse_json(x).isNotNull(), x), schema) for x in (c, inner)])


def is_grounded(c: Column, vocabulary: list[str]) -> Column:
    """Whether the text names one word of the vocabulary at least (anywhere in it, ignoring case)."""
    return contains_any(c, vocabulary)


def parse_list(c: Column) -> Column:
    """The strings in a model's reply: an array; or an object's array under a usual key; or the first [...] in the text; or its
    lines of more than 20 characters."""
    strings = lambda x: F.from_json(F.when(F.try_parse_json(x).isNotNull() & F.trim(x).startswith("["), x), "array<string>")
    keys = [F.get_json_object(F.when(F.try_parse_json(c).isNotNull(), c), f"$.{k}") for k in ("sentences", "examples", "texts", "items", "data")]
    inner = F.nullif(F.regexp_extract(c, r"(?s)(\[.*?\])", 1), F.lit(""))
    lines = F.filter(F.transform(F.split(c, "\n"), F.trim), lambda x: F.length(x) > 20)
    return F.coalesce(strings(c), *map(strings, keys), strings(inner), lines)


def repair_list(c: Column) -> Column:
    """The strings of an array that may be cut short: from the first [ to the last ], less a trailing comma; else every quoted string."""
    body = F.regexp_replace(F.regexp_extract(c, r"(?s)(\[.*\])", 1), r",\s*\]$", "]")
    whole = F.from_json(F.when(F.try_parse_json(F.nullif(body, F.lit(""))).isNotNull(), body), "array<string>")
    return F.coalesce(whole, F.regexp_extract_all(c, F.lit(r'"((?:[^"\\\\]|\\\\.)*)"'), F.lit(1)))


def l2_normalise(a: Column) -> Column:
    """The vector divided by its length (1e-9 at least)."""
    return F.transform(a, lambda x: x.cast("double") / F.greatest(F.sqrt(dot(a, a)), F.lit(1e-9)))


def mean_pool(vectors: Column, mask: Column) -> Column:
    """The mean of the vectors (an array of arrays) whose mask is 1; their sum divided by the mask's (1e-9 at least)."""
    kept = F.transform(F.filter(F.arrays_zip(vectors.alias("v"), mask.alias("m")), lambda x: x["m"] == 1), lambda x: x["v"])
    zero = F.transform(F.element_at(vectors, 1), lambda x: F.lit(0.0))
    total = F.aggregate(kept, zero, lambda s, v: F.zip_with(s, v, lambda x, y: x + y.cast("double")))
    n = F.greatest(F.aggregate(mask, F.lit(0.0), lambda s, x: s + x.cast("double")), F.lit(1e-9))
    return F.transform(total, lambda x: x / n)
