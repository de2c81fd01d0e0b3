"""Readers and writers of corpora, statutes, obligations and results."""

from html.parser import HTMLParser

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.functions.slices import each_text

OBLIGATION = "id string, regulation string, article string, source_paragraph string, title string, actor array<string>, requirement_type string, requirement string, evidence_required array<string>, severity string, linked_articles array<string>, penalty_relevance boolean, annex_category int"


def ingest_gate(files: DataFrame, size: str, kind: str, most: int, kinds: list[str]) -> DataFrame:
    """status: 400 without a file, 415 for another kind, 413 beyond the size, else 200; in this order."""
    return files.withColumn("status", F.when(F.col(size).isNull(), 400).when(~F.lower(kind).isin(*kinds), 415).when(F.col(size) > most, 413).otherwise(200))


def read_text_corpus(spark: SparkSession, path: str) -> DataFrame:
    rows = spark.read.text(path, wholetext=True).select(F.col("_metadata.file_path").alias("path"), "value")
    return rows.select("path", F.regexp_replace(F.make_valid_utf8("value"), r"\r\n?", "\n").alias("text"))


def read_regulatory(spark: SparkSession, path: str) -> DataFrame:
    """One row for each non-empty language section of a statute file: lang, text, article_num, domain, regulation, title."""
    rows = read_text_corpus(spark, path)
    parts = F.split("text", r"(?m)^=== (?=\w+ ===\s*$)")
    head = F.transform(F.filter(F.split(parts[0], "\n"), lambda x: x.contains(":")), lambda x: F.named_struct(F.lit("k"), F.lower(F.trim(F.substring_index(x, ":", 1))), F.lit("v"), F.trim(F.regexp_replace(x, r"^[^:]*:", ""))))
    last = F.filter(head, lambda x, i: ~F.exists(F.slice(head, i + 2, F.size(head)), lambda y: y["k"] == x["k"]))  # of repeated keys
    rows = rows.select("path", F.map_from_entries(last).alias("head"), F.explode(F.slice(parts, 2, F.greatest(F.size(parts) - 1, F.lit(1)))).alias("part"))
    lang = F.lower(F.regexp_extract("part", r"^(\w+) ===", 1))
    text = F.regexp_replace(F.regexp_replace("part", r"^\w+ ===\s*", ""), r"^\s+|\s+$", "")
    h = lambda k: F.try_element_at("head", F.lit(k) if isinstance(k, str) else k)
    out = rows.select(lang.alias("lang"), text.alias("text"), F.coalesce(h("article").cast("int"), F.lit(0)).alias("article_num"), F.coalesce(h("domain"), F.lit("unknown")).alias("domain"), F.element_at(F.split("path", "/"), -2).alias("regulation"), F.coalesce(h(F.concat(F.lit("title_"), lang)), h("title_en"), F.lit("")).alias("title"))
    return out.where(F.col("text") != "")


def read_lang_sections(spark: SparkSession, path: str, langs: tuple[str, ...] = ("en", "de")) -> DataFrame:
    """(path, lang, text) of the sections in these languages; whatever stands before the first section is ignored."""
    rows = read_text_corpus(spark, path).select("path", F.explode(F.split("text", r"(?m)^=== (?=\w+ ===\s*$)")).alias("part"))
    lang = F.lower(F.regexp_extract("part", r"^(\w+) ===", 1))
    text = F.regexp_replace(F.regexp_replace("part", r"^\w+ ===\s*", ""), r"^\s+|\s+$", "")
    return rows.select("path", lang.alias("lang"), text.alias("text")).where(F.col("lang").isin(*langs) & (F.col("text") != ""))


def read_domain_labels(spark: SparkSession, path: str, trained: list[str], lines: int = 8) -> DataFrame:
    """(path, domain): the DOMAIN header within a file's first lines; files whose domain isn't trained go."""
    head = F.array_join(F.slice(F.split("text", "\n"), 1, lines), "\n")
    domain = F.lower(F.trim(F.regexp_extract(head, r"(?m)^DOMAIN:(.*)$", 1)))
    return read_text_corpus(spark, path).select("path", domain.alias("domain")).where(F.col("domain").isin(*trained))


def read_eval_results(spark: SparkSession, path: str) -> DataFrame:
    """(key, body): every JSON file of a folder by its name without extension; files that don't parse go; none is no error."""
    rows = spark.read.option("pathGlobFilter", "*.json").text(path, wholetext=True).select(F.regexp_extract("_metadata.file_name", r"^(.*)\.json$", 1).alias("key"), F.col("value").alias("body"))
    return rows.where(F.try_parse_json("body").isNotNull())


def to_index_docs(passages: DataFrame, checklist: DataFrame) -> DataFrame:
    """Rows of a search index: passages (id, text, article, regulation, lang, chunk_index, title) and checklist rows (id, text,
    article, regulation, title), which are English and of chunk 0."""
    names = ["id", "text", "article", "regulation", "lang", "chunk_index", "title"]
    return passages.select(names).unionByName(checklist.withColumns({"lang": F.lit("en"), "chunk_index": F.lit(0)}).select(names))


def rebuild(df: DataFrame, path: str, collections: list[str]) -> None:
    """Replaces the partitions of those of these collections that df has rows of; all others stay as they are."""
    df.where(F.col("collection").isin(*collections)).write.mode("overwrite").option("partitionOverwriteMode", "dynamic").partitionBy("collection").parquet(path)


def read_or(df: DataFrame, fallback: DataFrame) -> DataFrame:
    """df, or the fallback rows if df has none."""
    return df.unionByName(fallback.join(df.limit(1).select(F.lit(1).alias("_")), F.lit(True), "left_anti"))


def read_obligations(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(OBLIGATION).option("mode", "DROPMALFORMED").option("recursiveFileLookup", "true").json(path)


def annex_obligations(rows: DataFrame, order: str) -> DataFrame:
    """The last row of each annex category."""
    last = Window.partitionBy("annex_category").orderBy(F.desc(order))
    return rows.where(F.col("annex_category").isNotNull()).withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).drop("_r")


def read_labelled(spark: SparkSession, path: str, schema: str = "text string, label string, lang string, source string") -> DataFrame:
    return spark.read.schema(schema).json(path)


def write_labelled(df: DataFrame, path: str, overwrite: bool = False) -> None:
    """Appends texts that the file doesn't hold yet, each once; or writes it anew."""
    df = df.dropDuplicates(["text"])
    if not overwrite:
        try:
            df = df.join(df.sparkSession.read.schema("text string").json(path).select(F.sha2("text", 256).alias("_k")).distinct(), F.sha2("text", 256) == F.col("_k"), "left_anti")
        except AnalysisException:  # nothing there yet
            pass
    df.write.mode("overwrite" if overwrite else "append").json(path)


def write_reports(df: DataFrame, path: str) -> None:
    df.where(F.col("status") == "complete").select(F.to_json(F.struct(*df.columns)).alias("value")).write.mode("overwrite").text(path)


class _Blocks(HTMLParser):
    """Texts of block elements, in order."""

    BLOCK = {"p", "div", "h1", "h2", "h3", "h4", "li", "td", "section", "article", "br", "tr"}

    def __init__(self):
        super().__init__()
        self.blocks, self.open, self.skip = [], "", 0

    def _end(self):
        if text := " ".join(self.open.split()):
            self.blocks.append(text)
        self.open = ""

    def handle_starttag(self, tag, attrs):
        self.skip += tag in ("script", "style")
        if tag in self.BLOCK:
            self._end()

    def handle_endtag(self, tag):
        self.skip -= tag in ("script", "style") and self.skip > 0
        if tag in self.BLOCK:
            self._end()

    def handle_data(self, data):
        self.open += "" if self.skip else data


def extract_blocks(pages: DataFrame) -> DataFrame:
    """(page_id, block_index, text): the text blocks of each page, scripts and styles left out."""

    def blocks(html: str) -> list[tuple[int, str]]:
        parser = _Blocks()
        parser.feed(html)
        parser._end()
        return list(enumerate(parser.blocks))

    return each_text(pages, "page_id", "html", "block_index int, text string", lambda: blocks)


def extract_sections(pages: DataFrame, start: str, stop: str) -> DataFrame:
    """(page_id, section, title, text): a block that matches start opens a section, which ends before one that matches stop."""
    blocks = extract_blocks(pages)
    by = Window.partitionBy("page_id").orderBy("block_index")
    opens = F.col("text").rlike(start)
    blocks = blocks.withColumn("section", F.sum((opens | F.col("text").rlike(stop)).cast("int")).over(by))
    lines = F.array_sort(F.collect_list(F.struct("block_index", "text")))
    out = blocks.groupBy("page_id", "section").agg(F.transform(lines, lambda x: x["text"]).alias("lines"))
    out = out.where(F.col("lines")[0].rlike(start))
    return out.select("page_id", "section", F.col("lines")[0].alias("title"), F.array_join(F.slice("lines", 2, F.greatest(F.size("lines"), F.lit(1))), "\n").alias("text"))
