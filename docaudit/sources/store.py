"""A versioned store of collections: a change writes new folders for the partitions that it touches, then one manifest. Readers
see the state of the newest manifest, so a change that fails half-way is never seen."""

import json
import uuid
from dataclasses import dataclass

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from docaudit.operators.prep import row_print

BUCKET = "_bucket"


class Conflict(RuntimeError):
    """Another writer committed first: read again, then repeat the change."""


@dataclass
class State:
    """A manifest: the schema, the folder of each partition (collection, bucket) that has rows, and the snapshots taken."""

    version: int
    schema: str | None
    folders: dict[str, dict[str, str]]
    snapshots: list[dict]


class Store:
    """Collections of rows under one path. Rows are dealt by a hash of `key` into buckets within their collection (a string
    column); the number of partitions bounds what the driver holds."""

    def __init__(self, spark: SparkSession, path: str, key: str, buckets: int = 16, collection: str = "collection"):
        self.spark, self.path, self.key, self.buckets, self.collection = spark, path.rstrip("/"), key, buckets, collection
        self._path = spark._jvm.org.apache.hadoop.fs.Path
        self._fs = self._path(self.path).getFileSystem(spark._jsc.hadoopConfiguration())

    # manifests

    def versions(self) -> list[int]:
        folder = self._path(f"{self.path}/manifests")
        if not self._fs.exists(folder):
            return []
        names = [f.getPath().getName() for f in self._fs.listStatus(folder)]
        return sorted(int(n[:-5]) for n in names if n.endswith(".json"))

    def state(self, version: int | None = None) -> State:
        known = self.versions()
        if version is None and not known:
            return State(0, None, {}, [])
        number = known[-1] if version is None else version
        text = self.spark.read.text(f"{self.path}/manifests/{number:020d}.json", wholetext=True).first()[0]
        return State(**json.loads(text))

    def _commit(self, state: State) -> State:
        """Makes state the newest one: written aside, then renamed."""
        name = f"{self.path}/manifests/{state.version:020d}"
        if self._fs.exists(self._path(f"{name}.json")):
            raise Conflict(f"version {state.version} exists")
        aside = self._path(f"{self.path}/manifests/.{uuid.uuid4().hex}")
        out = self._fs.create(aside, False)
        out.write(bytearray(json.dumps(vars(state)).encode()))
        out.close()
        if not self._fs.rename(aside, self._path(f"{name}.json")):
            raise Conflict(f"version {state.version} exists")
        return state

    # reading

    def read(self, collections: list[str] | None = None, version: int | None = None) -> DataFrame:
        """Rows of the collections (default: all) as of a version (default: the newest)."""
        state = self.state(version)
        return self._rows(state, [f for c, buckets in state.folders.items() if collections is None or c in collections for f in buckets.values()])

    def _rows(self, state: State, folders: list[str]) -> DataFrame:
        if state.schema is None:
            raise ValueError(f"nothing was ever written to {self.path}")
        full = [f"{self.path}/{f}" for f in folders]
        return self.spark.read.schema(state.schema).parquet(*full) if full else self.spark.createDataFrame([], state.schema)

    # changes

    def _written(self, rows: DataFrame) -> dict[str, dict[str, str]]:
        """Writes rows to a folder of its own; the folders of the partitions that have any."""
        root = f"data/{uuid.uuid4().hex}"
        part = rows.withColumn("_c", F.col(self.collection)).withColumn(BUCKET, self._bucket())
        part.repartition("_c", BUCKET).write.partitionBy("_c", BUCKET).parquet(f"{self.path}/{root}")
        kept = part.sparkSession.read.parquet(f"{self.path}/{root}").select(F.col("_c").cast("string"), BUCKET, "_metadata.file_path") if self._any(root) else None
        out: dict[str, dict[str, str]] = {}
        for r in kept.groupBy("_c", BUCKET).agg(F.first("file_path").alias("f")).collect() if kept is not None else []:  # a row a partition
            out.setdefault(r["_c"], {})[str(r[BUCKET])] = root + r["f"].split(root, 1)[1].rsplit("/", 1)[0]
        return out

    def _any(self, root: str) -> bool:
        return any(f.isDirectory() for f in self._fs.listStatus(self._path(f"{self.path}/{root}")))

    def _bucket(self):
        return F.pmod(F.xxhash64(F.col(self.key).cast("string")), F.lit(self.buckets)).cast("int")

    def _next(self, state: State, schema: str, folders: dict[str, dict[str, str]], snapshots: list[dict] | None = None) -> State:
        return self._commit(State(state.version + 1, schema, folders, state.snapshots if snapshots is None else snapshots))

    def _schema(self, state: State, df: DataFrame) -> str:
        """The store's columns, which df has to have; of a new store, df's."""
        if self.collection not in df.columns or self.key not in df.columns:
            raise ValueError(f"rows need the columns {self.collection} and {self.key}")
        if state.schema is None:
            return ", ".join(f"`{n}` {t}" for n, t in df.dtypes)
        return state.schema

    def upsert(self, rows: DataFrame, order: str | None = None) -> State:
        """The last write of each key within its collection wins; within rows, that of the largest `order`, then of the largest
        hash of all columns. Only partitions that rows touch are written anew."""
        state = self.state()
        schema = self._schema(state, rows)
        last = Window.partitionBy(self.collection, self.key).orderBy(*([F.desc(order)] if order else []), F.desc("_print"))
        new = rows.withColumn("_print", row_print(rows)).withColumn("_r", F.row_number().over(last)).where("_r = 1").drop("_r", "_print")
        new = new.select(*[n for n, _ in self.spark.createDataFrame([], schema).dtypes])
        touched = [(r[0], str(r[1])) for r in rows.select(self.collection, self._bucket()).distinct().collect()]  # partitions
        before = [state.folders[c][b] for c, b in touched if b in state.folders.get(c, {})]
        if before:
            names = new.select(F.col(self.collection).alias("_c"), F.col(self.key).alias("_k"))
            old = self._rows(state, before)
            new = old.join(names, (old[self.collection] == names["_c"]) & (old[self.key] == names["_k"]), "left_anti").unionByName(new)
        folders = {c: dict(b) for c, b in state.folders.items()}
        for c, buckets in self._written(new).items():
            folders.setdefault(c, {}).update(buckets)
        return self._next(state, schema, folders)

    def drop(self, collections: list[str]) -> State:
        state = self.state()
        return self._next(state, state.schema, {c: b for c, b in state.folders.items() if c not in collections})

    def rebuild(self, rows: DataFrame, collections: list[str]) -> State:
        """These collections hold exactly rows' rows of them from now on: none, if rows has none. Others stay as they are."""
        state = self.state()
        schema = self._schema(state, rows)
        new = self._written(rows.where(F.col(self.collection).isin(collections)))
        return self._next(state, schema, {c: b for c, b in state.folders.items() if c not in collections} | new)

    def snapshot(self, kind: str, rows: DataFrame) -> dict:
        """A snapshot of rows (a data set of some kind), if its content differs from the kind's last one: version, n, print, and the
        store's version that holds it. The same content gives the last one again."""
        state = self.state()
        print_ = rows.agg(F.count("*").alias("n"), F.coalesce(F.sum(row_print(rows)), F.lit(0)).cast("string").alias("print")).first()
        own = [s for s in state.snapshots if s["kind"] == kind]
        if own and own[-1]["print"] == print_["print"] and own[-1]["n"] == print_["n"]:
            return own[-1]
        named = rows.withColumn(self.collection, F.lit(kind))
        schema = self._schema(state, named)
        entry = {"kind": kind, "version": f"v{len(own) + 1}", "n": print_["n"], "print": print_["print"], "at": state.version + 1}
        folders = {c: b for c, b in state.folders.items() if c != kind} | self._written(named)
        self._next(state, schema, folders, [*state.snapshots, entry])
        return entry

    def vacuum(self, keep: int = 1) -> int:
        """Deletes all but the newest `keep` manifests, those of snapshots, and data that no manifest names; gives the number of
        folders deleted. Not while others write."""
        known = self.versions()
        held = set(known[-keep:]) | {s["at"] for s in self.state().snapshots}
        live = {f.split("/")[1] for v in known if v in held for b in self.state(v).folders.values() for f in b.values()}
        for v in known:
            if v not in held:
                self._fs.delete(self._path(f"{self.path}/manifests/{v:020d}.json"), False)
        gone = [f.getPath() for f in self._fs.listStatus(self._path(f"{self.path}/data")) if f.getPath().getName() not in live]
        for folder in gone:
            self._fs.delete(folder, True)
        return len(gone)
