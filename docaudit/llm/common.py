"""Helpers shared by the operators: tables cut into the shared folder, global order by prefix sums."""

import tempfile
import uuid
import weakref
from collections.abc import Iterator
from contextlib import contextmanager

import numpy as np
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

_own_dir: list[str] = []
#: Folder of each table made by cut.
_folders: "weakref.WeakKeyDictionary[DataFrame, str]" = weakref.WeakKeyDictionary()
#: Lists that note the folders of new tables.
_noted: list[list[str]] = []


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def work_dir(spark: SparkSession) -> str:
    """A new folder in spark.checkpoint.dir; where that is unset, in a folder of our own, which only a local master can share."""
    root = spark.conf.get("spark.checkpoint.dir", None)
    if not root:
        if not spark.sparkContext.master.startswith("local"):
            raise RuntimeError("spark.checkpoint.dir is unset: on a cluster it must name a folder that all machines share")
        if not _own_dir:
            _own_dir.append("file://" + tempfile.mkdtemp(prefix="checkpoints-"))
        root = _own_dir[0]
    return f"{root}/{uuid.uuid4().hex}"


@contextmanager
def settings(spark: SparkSession, values: dict[str, str]) -> Iterator[None]:
    """Jobs that run inside have these settings; afterwards the session has its own again."""
    own = {name: spark.conf.get(name) for name in values}
    for name, value in values.items():
        spark.conf.set(name, value)
    try:
        yield
    finally:
        for name, value in own.items():
            spark.conf.set(name, value)


#: Spark removes a query's shuffle files when it ends. For queries whose result is written, so nothing reads them again.
CLEANUP = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


def cut(df: DataFrame, narrow: bool = False) -> DataFrame:
    """Cuts lineage: writes df as a table in the shared folder and reads it again, so lost executors cost no recomputation.
    narrow: rows are few and small, so as many files as the cluster has cores, twice over, are enough."""
    spark, path = df.sparkSession, work_dir(df.sparkSession)
    with settings(spark, {CLEANUP: "true"}):
        (df.coalesce(2 * spark.sparkContext.defaultParallelism) if narrow else df).write.parquet(path)
    out = spark.read.schema(df.schema).parquet(path)
    _folders[out] = path
    for noted in _noted:
        noted.append(path)
    return out


@contextmanager
def noting(paths: list[str]) -> Iterator[None]:
    """Folders of tables that cut makes inside are added to paths."""
    _noted.append(paths)
    try:
        yield
    finally:
        _noted.remove(paths)


def remove(spark: SparkSession, paths: list[str]) -> None:
    """Deletes folders made by cut, and empties the list."""
    while paths:
        folder = spark._jvm.org.apache.hadoop.fs.Path(paths.pop())
        folder.getFileSystem(spark._jsc.hadoopConfiguration()).delete(folder, True)


def discard(*tables: DataFrame) -> None:
    """Deletes tables made by cut that nothing reads any more."""
    for t in tables:
        remove(t.sparkSession, [_folders.pop(t)])


@contextmanager
def scratch(spark: SparkSession) -> Iterator[list[DataFrame]]:
    """Tables that cut makes inside are deleted at the end, but for those put into the list."""
    paths: list[str] = []
    kept: list[DataFrame] = []
    with noting(paths):
        yield kept
    held = {_folders.get(t) for t in kept}
    remove(spark, [p for p in paths if p not in held])


def unused(df: DataFrame, name: str) -> str:
    """name, or the like of it that no column of df has (Spark sets letter case aside)."""
    while name.lower() in [c.lower() for c in df.columns]:
        name += "_"
    return name


def numbered(df: DataFrame) -> DataFrame:
    """df, written, with a number for each row, `_row`: it tells rows apart that are alike in all columns."""
    return cut(df.drop("_row").withColumn("_row", F.monotonically_increasing_id()))


ARROW_ROWS, ARROW_BYTES = "spark.sql.execution.arrow.maxRecordsPerBatch", "spark.sql.execution.arrow.maxBytesPerBatch"
#: Rows of an Arrow batch that holds whole texts, or sets as large as texts; and of one that holds narrow rows.
TEXT_ROWS, NARROW_ROWS = 1_000, 10_000
#: Bytes after which a batch ends, whatever its rows: a run of very long texts makes no large batch. A longer text stands alone.
BATCH_BYTES = 4 << 20


def batch_rows(spark: SparkSession, rows: int):
    """Jobs that run inside send batches of so many rows, and of BATCH_BYTES, to Python workers."""
    return settings(spark, {ARROW_ROWS: str(rows), ARROW_BYTES: str(BATCH_BYTES)})


def text_batches(spark: SparkSession) -> None:
    """From now on the session's batches have TEXT_ROWS rows and BATCH_BYTES at most: for DataFrames that run after the caller has returned."""
    if int(spark.conf.get(ARROW_ROWS)) not in range(1, TEXT_ROWS + 1):
        spark.conf.set(ARROW_ROWS, str(TEXT_ROWS))
    spark.conf.set(ARROW_BYTES, str(BATCH_BYTES))


def partitions(spark: SparkSession) -> int:
    return int(spark.conf.get("spark.sql.shuffle.partitions"))


def in_order(df: DataFrame, keys: list, size: str | None = None) -> DataFrame:
    """df in the global order of keys, with `at` (rows before each) and, given a size column, `before` (their sizes' sum).

    Rows are range-partitioned and sorted once; totals of the partitions (one row each) give every partition's offset.
    No key has to fit into one task as long as the keys together tell rows apart."""
    spark = df.sparkSession
    dealt = df.repartitionByRange(partitions(spark), *keys).sortWithinPartitions(*keys)
    dealt = cut(dealt.select("*", F.spark_partition_id().alias("_part"), F.monotonically_increasing_id().bitwiseAND(F.lit((1 << 33) - 1)).alias("_row")))
    earlier = Window.orderBy("_part").rowsBetween(Window.unboundedPreceding, -1)
    sums = [F.count("*").alias("_n"), (F.sum(size) if size else F.lit(0)).alias("_size")]
    offsets = dealt.groupBy("_part").agg(*sums).select("_part", F.coalesce(F.sum("_n").over(earlier), F.lit(0)).alias("_at"), F.coalesce(F.sum("_size").over(earlier), F.lit(0)).alias("_before"))
    out = dealt.join(F.broadcast(offsets), "_part").withColumn("at", F.col("_at") + F.col("_row"))  # one row per partition
    if size:
        here = Window.partitionBy("_part").orderBy("_row").rowsBetween(Window.unboundedPreceding, -1)
        out = out.withColumn("before", F.col("_before") + F.coalesce(F.sum(size).over(here), F.lit(0)))
    return out.drop("_part", "_row", "_at", "_before")


def broadcast_if_small(df: DataFrame, limit: int = 2_000_000) -> DataFrame:
    """df (a table already cut, of a few narrow columns), marked for broadcast only if it has at most `limit` rows; else Spark shuffles."""
    return F.broadcast(df) if df.limit(limit + 1).count() <= limit else df


def without(docs: DataFrame, ids: DataFrame) -> DataFrame:
    """The rows of docs whose doc_id is not among ids.doc_id; null ids compare as equal."""
    gone = broadcast_if_small(cut(ids.select(F.col("doc_id").alias("_gone")).distinct()))
    return docs.join(gone, docs["doc_id"].eqNullSafe(gone["_gone"]), "left_anti")


def mix(x: np.ndarray) -> np.ndarray:
    """A 64-bit finaliser, elementwise on uint64."""
    x = x.astype(np.uint64, copy=True)
    x ^= x >> np.uint64(30)
    x *= np.uint64(0xBF58476D1CE4E5B9)
    x ^= x >> np.uint64(27)
    x *= np.uint64(0x94D049BB133111EB)
    x ^= x >> np.uint64(31)
    return x


def mix_int(x: int) -> int:
    return int(mix(np.array([x & (2**64 - 1)], dtype=np.uint64))[0])


def slices(sizes: list[int], limit: int):
    """(start, end) of runs of items whose sizes add up to about limit; a larger item stands alone."""
    start = total = 0
    for i, n in enumerate(sizes):
        if i > start and total + n > limit:
            yield start, i
            start, total = i, 0
        total += n
    if start < len(sizes):
        yield start, len(sizes)
