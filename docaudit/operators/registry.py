"""Versions of data and models, as tables."""

from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from docaudit.operators.prep import row_print

def next_version(versions: DataFrame, by: list[str]) -> DataFrame:
    """v(max + 1); names that aren't v and a number don't count."""
    n = F.regexp_extract("version", r"^v([0-9]+)$", 1)
    return versions.groupBy(*by).agg(F.concat(F.lit("v"), (F.coalesce(F.max(F.nullif(n, F.lit("")).cast("int")), F.lit(0)) + 1).cast("string")).alias("next"))


def promotions(runs: DataFrame, key: str, order: list[str], score: str, pinned: str | None = None) -> DataFrame:
    """Runs that were promoted: the first of each key, and each strictly better than all before. pinned: a boolean column; such a
    run becomes active whatever its score, and those after it have to be better than it."""
    by = Window.partitionBy(key).orderBy(*order)
    if pinned is None:
        runs = runs.withColumn("_era", F.lit(0))
    else:
        runs = runs.withColumn("_era", F.sum(F.coalesce(F.col(pinned), F.lit(False)).cast("int")).over(by.rowsBetween(Window.unboundedPreceding, 0)))
    before = F.max(score).over(Window.partitionBy(key, "_era").orderBy(*order).rowsBetween(Window.unboundedPreceding, -1))
    return runs.withColumn("_best", before).where(F.col("_best").isNull() | (F.col(score) > F.col("_best"))).drop("_best", "_era")


def snapshot_data(current: DataFrame, versions: DataFrame) -> DataFrame:
    """The versions table after a snapshot: current (type, n, print: of its rows) gets a new version, active from now on, where its
    fingerprint isn't that of the type's active version. versions: type, version, n, print, active."""
    active = versions.where("active").select(F.col("type").alias("_t"), F.col("print").alias("_p"))
    changed = current.join(active, (F.col("type") == F.col("_t")) & F.col("print").eqNullSafe(F.col("_p")), "left_anti")
    new = changed.join(next_version(versions, ["type"]), "type", "left").select("type", F.coalesce("next", F.lit("v1")).alias("version"), "n", "print", F.lit(True).alias("active"))
    types = new.select("type", F.lit(True).alias("_new"))
    old = versions.join(types, "type", "left").select("type", "version", "n", "print", (F.col("active") & F.col("_new").isNull()).alias("active"))
    return old.unionByName(new)


def active_versions(types: DataFrame, models: DataFrame) -> DataFrame:
    """(type, version, data_version) of each type's active model; 'untrained' without one, 'unknown' without data version."""
    live = models.where("active").select("type", "version", "data_version")
    return types.join(live, "type", "left").select("type", F.coalesce("version", F.lit("untrained")).alias("version"), F.coalesce("data_version", F.lit("unknown")).alias("data_version"))


def version_number(c):
    """The number in v and a number, NULL for other names: versions sort by it, so v10 comes after v2."""
    return F.nullif(F.regexp_extract(c, r"^v([0-9]+)$", 1), F.lit("")).cast("int")


def list_models(types: DataFrame, models: DataFrame) -> DataFrame:
    """(type, version, active, metric, place) of all versions, newest first; a type without any has one row, untrained."""
    out = types.join(models.select("type", "version", "active", "metric"), "type", "left")
    place = F.row_number().over(Window.partitionBy("type").orderBy(version_number(F.col("version")).desc_nulls_last(), F.desc("version")))
    return out.select("type", F.coalesce("version", F.lit("untrained")).alias("version"), F.coalesce("active", F.lit(False)).alias("active"), "metric", place.alias("place"))


def list_data(types: DataFrame, versions: DataFrame) -> DataFrame:
    """(type, versions, records, active): how many versions a type has, the active one's records and name."""
    n = versions.groupBy("type").agg(F.count("*").alias("versions"), F.max(F.when(F.col("active"), F.col("n"))).alias("records"), F.max(F.when(F.col("active"), F.col("version"))).alias("active"))
    return types.join(n, "type", "left").select("type", F.coalesce("versions", F.lit(0)).alias("versions"), F.coalesce("records", F.lit(0)).alias("records"), "active")


def should_retrain(models: DataFrame, data: DataFrame) -> DataFrame:
    """Per type: no model, yes; a model from the hub, no; unknown versions, yes; else whether they differ."""
    both = data.join(models, "type", "left")
    differs = F.col("data_version").isNull() | F.col("trained_on").isNull() | (F.col("data_version") != F.col("trained_on"))
    return both.select("type", F.when(F.col("model").isNull(), True).when(F.col("from_hub"), False).otherwise(differs).alias("retrain"))


def upsert(old: DataFrame, new: DataFrame, key: str) -> DataFrame:
    """Last write wins by key; of a load's rows with one key, that of the largest print of all columns. Store.upsert keeps it."""
    rows = old.withColumn("_seq", F.lit(0)).unionByName(new.withColumn("_seq", F.lit(1)))
    last = Window.partitionBy(key).orderBy(F.desc("_seq"), F.desc(row_print(new)))
    return rows.withColumn("_r", F.row_number().over(last)).where(F.col("_r") == 1).drop("_r", "_seq")
