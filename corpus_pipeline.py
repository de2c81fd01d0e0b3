"""The corpus pipeline: quality, language, repeated lines, near duplicates, packing. Each stage reads what the last kept."""

from collections.abc import Callable
from functools import wraps

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from docaudit.llm import op01_packing, op02_langid, op08_quality, op09_jaccard, op10_lines
from docaudit.llm.common import broadcast_if_small, cut, discard, noting, remove, table, text_batches, without

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
#: Below this cosine, no prototype fits and the language stage rejects a document, if that rests on so many different trigrams:
#: a cosine of fewer is mostly noise (runs of words cut from sf0.01: some below 0.1 up to 25 trigrams, none below 0.2 from 40 on).
MIN_COSINE, MIN_EVIDENCE = 0.1, 40
#: Folders of tables that the stage before made on its way.
_spent: list[str] = []


def stage(f: Callable[[SparkSession, DataFrame, str], DataFrame]) -> Callable[[SparkSession, DataFrame, str], DataFrame]:
    """A stage removes what the stage before it left in the shared folder, so a stage's result is to be written before the
    next one is called."""

    @wraps(f)
    def run_stage(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
        remove(spark, _spent)
        with noting(_spent):
            return f(spark, docs, sf_dir)

    return run_stage


@stage
def quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the importance resampling selects.

    Null or empty text: weighs as a text that tells nothing, between good and bad. Null doc_id and repeated rows: each row is
    drawn for itself; rows alike stay or go together. No labels: all stay. Empty table: empty. Other columns go."""
    text_batches(spark)
    return op08_quality.resample(docs, table(spark, sf_dir, "labels"))[1].select(COLUMNS)


@stage
def language(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose language is told: not those without letters, nor those that fit no learned language.

    Documents with letters but too few different trigrams to judge stay, whatever their cosine. Null or empty text has no letter
    and goes. Null doc_id, null lang: judged like others. Repeated rows: each for itself. Ties between languages don't matter
    here. Empty table: empty. Other columns go."""
    text_batches(spark)
    langs, prototypes = op02_langid.learn(docs.where(~op02_langid.held_out() & F.col("lang").isNotNull()))
    judged = op02_langid.predict(docs, langs, prototypes, evidence=True)
    fits = (F.col("score") >= MIN_COSINE) | (F.col("evidence") < MIN_EVIDENCE)
    return judged.where((F.col("lang_pred") != "und") & fits).select(COLUMNS)


@stage
def lines(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without their repeated lines; those of which nothing else is left go. n_chars counts the new text.

    Null or empty text: nothing is dropped, so the row stays, a null text as empty. Rows with one doc_id are one document and null
    is one doc_id, smaller than all. Empty table: empty. Other columns go."""
    text_batches(spark)
    kept = op10_lines.dedup_lines(docs).withColumn("n_chars", F.length("text").cast("long"))
    return kept.where((F.col("n_dropped") == 0) | (F.regexp_replace("text", r"\s", "") != "")).select(COLUMNS)


@stage
def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates (five-word shingles, similarity 0.8 or more), the row of the smallest doc_id.

    Rows are judged one by one: of those with one doc_id, only those whose own text is a near copy go. A null doc_id counts
    as the largest; rows of one doc_id in a group go by the hash of the text, then by their other columns; of rows alike in all,
    one stays. Null texts and texts without words stay. Empty table: empty. Other columns go."""
    shared = docs.groupBy("doc_id").count().where("doc_id is null or count > 1").limit(1).count()
    if not shared:  # doc_id tells rows apart, so no copy of the texts is written
        classes = cut(op09_jaccard.jaccard_classes(docs, k=5, num=80, den=100))
        return without(docs, classes.where(F.col("doc_id") != F.col("component_id"))).select(COLUMNS)
    rows = cut(docs.select(COLUMNS).withColumn("_row", F.monotonically_increasing_id()))
    classes = cut(op09_jaccard.jaccard_classes(rows.select(F.col("_row").alias("doc_id"), "text"), k=5, num=80, den=100)).select(F.col("doc_id").alias("_row"), "component_id")
    order = F.struct(F.col("doc_id").isNull(), "doc_id", F.sha2("text", 256), "lang", "source", "n_chars", "_row")
    ranked = classes.join(rows.select("_row", order.alias("order")), "_row")
    stays = ranked.groupBy("component_id").agg(F.min("order")["_row"].alias("_stays"))
    gone = broadcast_if_small(cut(classes.join(stays, "component_id").where("_row <> _stays").select("_row")))
    return rows.join(gone, "_row", "left_anti").select(COLUMNS)


@stage
def packing(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """The sequences: a row for each piece.

    Null or empty text: the end id alone. Null doc_id: kept. Repeated rows: each is packed. Empty table: empty. Other columns go."""
    text_batches(spark)
    import public_tokenizers

    return op01_packing.pack(docs, public_tokenizers.path("word_bpe_49k.json"))


STAGES = [("quality", quality), ("language", language), ("lines", lines), ("near_duplicates", near_duplicates), ("packing", packing)]

#: None: the classifier, the profiles, the components and the tokenizer can't be written in SQL.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the table documents; each stage's result is written and read again."""
    docs, read = table(spark, sf_dir, "documents").select(COLUMNS), []
    for _, apply in STAGES[:-1]:
        docs = cut(apply(spark, docs, sf_dir))
        discard(*read)
        read = [docs]
    return STAGES[-1][1](spark, docs, sf_dir)
