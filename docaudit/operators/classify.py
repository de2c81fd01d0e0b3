"""Text classifiers as MLlib pipelines, and the table of their predictions."""

from pyspark.ml import PipelineModel
from pyspark.ml.classification import LogisticRegression
from pyspark.ml.feature import HashingTF, IDF, IndexToString, RegexTokenizer, StringIndexer
from pyspark.ml.functions import vector_to_array
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.storagelevel import StorageLevel


def _steps(text: str, features: int) -> list:
    return [RegexTokenizer(inputCol=text, outputCol="_words", pattern=r"\W+"), HashingTF(inputCol="_words", outputCol="_tf", numFeatures=features)]


def hashed(df: DataFrame, features: int = 1 << 14) -> DataFrame:
    """df with _tf, the counts of its texts' hashed words, and _chars, their lengths (null: null). train and predict need no more
    than these: where both are to run, hold them without the texts, which are then read once."""
    out = PipelineModel(_steps("_given", features)).transform(df.withColumn("_given", F.coalesce("text", F.lit(""))))
    return out.withColumn("_chars", F.length("text")).drop("_given", "_words")


def train(df: DataFrame, label: str, features: int = 1 << 14, rounds: int = 20) -> PipelineModel:
    """A model over words: df has text, or what hashed gives of it for as many features, and a label (string)."""
    labels = StringIndexer(inputCol=label, outputCol="_label", stringOrderType="alphabetAsc").fit(df)
    own = "_tf" not in df.columns
    rows = hashed(df, features) if own else df
    counts = labels.transform(rows.where(F.col("_chars").isNotNull() & F.col(label).isNotNull())).select("_label", "_tf")
    if own:  # read once for weights and model
        counts = counts.persist(StorageLevel.MEMORY_AND_DISK)
    idf = IDF(inputCol="_tf", outputCol="_x").fit(counts)
    fitted = LogisticRegression(featuresCol="_x", labelCol="_label", predictionCol="_at", probabilityCol="_p", rawPredictionCol="_raw", maxIter=rounds, regParam=1e-3).fit(idf.transform(counts))
    if own:
        counts.unpersist()
    return PipelineModel([labels, *_steps("text", features), idf, fitted, IndexToString(inputCol="_at", outputCol="_name", labels=labels.labels)])


def predict(df: DataFrame, model: PipelineModel, least: float = 0.0, fallback: str = "unrelated", backend: str = "logistic") -> DataFrame:
    """df with label, confidence and backend: the class of most probability; the fallback if its confidence is below `least` or
    the text is null. df has text, or what hashed gives of it."""
    indexer, held = model.stages[0], "_tf" in df.columns
    rows = df if held else df.withColumn("text", F.coalesce("text", F.lit(""))).withColumn("_chars", F.length("text"))
    out = PipelineModel(model.stages[3 if held else 1 :]).transform(rows.withColumn(indexer.getOutputCol(), F.lit(0.0)))
    sure = F.array_max(vector_to_array("_p"))
    label = F.when((sure >= least) & (F.col("_chars") > 0), F.col("_name")).otherwise(fallback)
    return out.select(*[F.col(c) for c in df.columns if c not in ("label", "confidence", "backend", "_tf", "_chars")], label.alias("label"), sure.alias("confidence"), F.lit(backend).alias("backend"))


def first_known(primary: DataFrame, secondary: DataFrame, key: str = "doc_id") -> DataFrame:
    """Predictions of the first backend, and the second's where it has none."""
    p = primary.select(key, *[F.col(c).alias(f"_{c}") for c in ("label", "confidence", "backend")])
    return secondary.select(key, "label", "confidence", "backend").join(p, key, "full_outer").select(key, *[F.coalesce(f"_{c}", c).alias(c) for c in ("label", "confidence", "backend")])
