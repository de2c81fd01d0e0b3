"""Line deduplication with a sharded minimal perfect hash over line hashes."""

import hashlib
from collections.abc import Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql import types as T

from .common import cut, mix, table, unused

NO_ID = -(1 << 63)  # stands for a null doc_id
BLANK = b" \t\n\x0b\x0c\r"


def line_key(line: bytes, min_chars: int) -> bytes | None:
    """128-bit hash of the line's key, or None if the key is too short to count."""
    key = line.strip(BLANK).lower()  # bytes.lower: A-Z only
    if len(key) < min_chars or (len(key) < 4 * min_chars and len(key.decode("utf-8", "replace")) < min_chars):
        return None
    return xxhash.xxh3_128_digest(key)


class PerfectHash:
    """Level by level, keys that are alone in their slot of a bit array stay there; the others go on to the next level.
    A key's index is the number of set bits before its own: those before its 64-bit word, held per word, and those in it."""

    def __init__(self, keys: np.ndarray):
        self.slots, words, rest = [], [], keys
        while len(rest) and len(self.slots) < 60:
            size = 2 * len(rest) + 1
            slot = self._slot(rest, len(self.slots), size)
            alone = np.bincount(slot, minlength=size)[slot] == 1
            bits = np.zeros(-(-size // 64) * 64, np.uint8)
            bits[slot[alone]] = 1
            words.append(np.packbits(bits, bitorder="little").view("<u8"))
            self.slots.append(size)
            rest = rest[~alone]
        assert not len(rest), "keys repeat"
        self._index(np.concatenate([*words, np.zeros(0, np.uint64)]))

    def _index(self, words: np.ndarray) -> None:
        self.words = words
        self.first = np.concatenate([[0], np.cumsum([-(-n // 64) for n in self.slots])]).astype(np.int64)  # word of each level
        ones = np.bitwise_count(words).astype(np.int64)
        self.before = (np.cumsum(ones) - ones).astype(np.uint32)

    @staticmethod
    def _slot(keys: np.ndarray, level: int, size: int) -> np.ndarray:
        return (mix(keys + np.uint64(0x9E3779B97F4A7C15 * (level + 1) & (2**64 - 1))) % np.uint64(size)).astype(np.int64)

    def __call__(self, keys: np.ndarray) -> np.ndarray:
        """Indexes; for a key that isn't in the set, -1 or that of any other, so that the fingerprint has to decide."""
        out, open_ = np.full(len(keys), -1), np.arange(len(keys))
        for level, size in enumerate(self.slots):
            slot = self._slot(keys[open_], level, size)
            at, bit = self.first[level] + slot // 64, (slot % 64).astype(np.uint64)
            word = self.words[at]
            hit = (word >> bit) & np.uint64(1) == 1
            lower = word & ((np.uint64(1) << bit) - np.uint64(1))
            out[open_[hit]] = (self.before[at] + np.bitwise_count(lower))[hit]
            open_ = open_[~hit]
        return out

    def pack(self) -> tuple[bytes, bytes]:
        return np.array(self.slots, np.int64).tobytes(), self.words.tobytes()

    @classmethod
    def unpack(cls, sizes: bytes, bits: bytes) -> "PerfectHash":
        out = cls(np.zeros(0, np.uint64))
        out.slots = np.frombuffer(sizes, np.int64).tolist()
        out._index(np.frombuffer(bits, np.uint64))
        return out


ARRAYS = ["sizes", "bits", "fingerprints", "counts", "lasts"]
SHARD = "shard int, " + ", ".join(f"{c} binary" for c in ARRAYS)


def build_shard(keys: pd.DataFrame) -> pd.DataFrame:
    """One shard: the perfect hash of its keys, and by index the fingerprint (the hash's other half), count and last document."""
    mph = PerfectHash(keys["h1"].to_numpy(np.int64).view(np.uint64))
    at = mph(keys["h1"].to_numpy(np.int64).view(np.uint64))
    arrays = []
    for c, kind in (("h2", np.int64), ("n", np.uint32), ("last", np.int64)):
        a = np.zeros(len(keys), kind)
        a[at] = np.minimum(keys[c].to_numpy(np.int64), (1 << 32) - 1) if c == "n" else keys[c].to_numpy(np.int64)
        arrays.append(a.tobytes())
    return pd.DataFrame([[keys["shard"].iloc[0], *mph.pack(), *arrays]], columns=["shard", *ARRAYS])


class Probe:
    """Arrays of one or more shards, held in a task. A line goes if its key is in min_docs documents or more, of which its
    own is not the last."""

    def __init__(self, shards: list[dict], n_shards: int, min_docs: int):
        self.n, self.min_docs = n_shards, min_docs
        of = lambda r: (PerfectHash.unpack(r["sizes"], r["bits"]), np.frombuffer(r["fingerprints"], np.int64), np.frombuffer(r["counts"], np.uint32), np.frombuffer(r["lasts"], np.int64))
        self.shards = {r["shard"]: of(r) for r in shards}

    def __call__(self, h1: np.ndarray, h2: np.ndarray, doc: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Of each line (its hash's halves, its document): whether its key is known, and whether the line goes."""
        known, gone = np.zeros(len(h1), bool), np.zeros(len(h1), bool)
        shard = h1 % self.n
        for s in np.unique(shard):
            if int(s) in self.shards:
                mph, prints, counts, lasts = self.shards[int(s)]
                here = np.flatnonzero(shard == s)
                at = mph(h1[here].view(np.uint64))
                here, at = here[at >= 0], at[at >= 0]
                here, at = here[prints[at] == h2[here]], at[prints[at] == h2[here]]
                known[here] = True
                gone[here] = (counts[at] >= self.min_docs) & (lasts[at] != doc[here])
        return known, gone


def _halves(keys: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    both = np.frombuffer(b"".join(keys), dtype="<i8").reshape(-1, 2)
    return both[:, 0].copy(), both[:, 1].copy()


def _texts(batch: pa.RecordBatch) -> tuple[list[int], list[bytes]]:
    from .words import encoded

    return [NO_ID if x is None else x for x in batch.column("doc_id").to_pylist()], encoded(batch.column("text"))


def repeated_lines(docs: DataFrame, min_chars: int = 20) -> DataFrame:
    """(h1, h2, n, last): hash of each key found in two documents or more, their number, and the largest doc_id."""

    def keys(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found, owner = [], []
            for i, text in zip(*_texts(batch)):
                own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                found += own
                owner += [i] * len(own)
            h1, h2 = _halves(found)
            yield pa.RecordBatch.from_pydict({"h1": h1, "h2": h2, "doc_id": pa.array(owner, pa.int64())})

    each = docs.select("doc_id", "text").mapInArrow(keys, "h1 long, h2 long, doc_id long")
    return each.groupBy("h1", "h2").agg(F.count_distinct("doc_id").alias("n"), F.max("doc_id").alias("last")).where("n >= 2")


def dedup_lines(docs: DataFrame, min_chars: int = 20, min_docs: int = 3, max_broadcast: int = 500_000, shard_keys: int = 100_000, shard_lines: int = 1_000_000) -> DataFrame:
    """docs with text rewritten without repeated lines, and n_lines, n_dropped (long).

    A line's key is the line stripped of white space and with A-Z lower-cased. Keys of min_chars code points or more in
    min_docs documents or more lose all their lines, except in the document of the largest doc_id that holds them.
    The perfect hash indexes the keys found in two documents or more; a key of one document can't lose a line where min_docs
    is two or more, and fails the 64-bit fingerprint. The probe reads the number of documents from the count array. The
    max_broadcast most frequent keys at most (20 bytes each) go to every task; hot keys are always among them. The others stay
    in shards of about shard_keys keys: the lines that are not settled yet are sent past their shard's arrays, in runs of about
    shard_lines, and only those that go come back by doc_id. No run is gathered: a sorted partition begins each run with the
    arrays and streams the lines.
    Null or empty text: one empty line, kept; a null text becomes empty. Null doc_id: one document, smaller than all.
    Rows with one doc_id: one document, so they keep or lose a line together. Other columns pass through; columns named
    n_lines or n_dropped are replaced. Empty table: empty."""
    spark = docs.sparkSession
    docs = docs.drop("n_lines", "n_dropped")
    mark, ident = unused(docs, "_gone"), unused(docs, "_id")
    if min_docs < 2:
        raise ValueError("min_docs: two or more")
    keys = cut(repeated_lines(docs, min_chars))
    n_keys, most = keys.count(), 2
    while keys.where(F.col("n") >= most).limit(max_broadcast + 1).count() > max_broadcast:
        most *= 2

    def shards(rows: DataFrame, n: int) -> tuple[DataFrame, int]:
        n = max(1, -(-n // shard_keys))
        return rows.withColumn("shard", F.pmod("h1", F.lit(n)).cast("int")).groupBy("shard").applyInPandas(build_shard, SHARD), n

    frequent, n_frequent = shards(keys.where(F.col("n") >= most), min(n_keys, max_broadcast))
    held = spark.sparkContext.broadcast([r.asDict() for r in frequent.collect()])  # at most max_broadcast keys
    if most > 2:
        rare, n_rare = shards(keys.where((F.col("n") < most)), n_keys)
        n_lines = docs.agg(F.sum(F.size(F.split("text", "\n")).cast("long"))).first()[0] or 0
        runs = max(1, -(-n_lines // (n_rare * shard_lines)))

        def asked(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = Probe(held.value, n_frequent, min_docs)
            for batch in batches:
                found, owner = [], []
                for i, text in zip(*_texts(batch)):
                    own = {k for line in text.split(b"\n") if (k := line_key(line, min_chars))}
                    found += own
                    owner += [i] * len(own)
                h1, h2 = _halves(found)
                at = np.array(owner, np.int64)
                open_ = ~probe(h1, h2, at)[0]  # lines of frequent keys are settled in place
                h1, h2, at = h1[open_], h2[open_], at[open_]
                yield pa.RecordBatch.from_pydict({"shard": (h1 % n_rare).astype(np.int32), "run": (mix(at.view(np.uint64)) % np.uint64(runs)).astype(np.int32), "h1": h1, "h2": h2, "doc_id": at})

        def answered(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            probe = None
            for batch in batches:
                arrays, gone = batch.column("sizes").is_valid().to_numpy(zero_copy_only=False), []
                shard, h1, h2, doc = (batch.column(c).to_numpy(zero_copy_only=False) for c in ("shard", "h1", "h2", "doc_id"))
                cuts = [0, *np.flatnonzero(arrays).tolist(), len(arrays)]
                for a, b in zip(cuts, cuts[1:]):
                    if a < b and arrays[a]:
                        probe = Probe([{c: batch.column(c)[a].as_py() for c in ("shard", *ARRAYS)}], n_rare, min_docs)
                        a += 1
                    if a < b and probe and int(shard[a]) in probe.shards:
                        here = slice(a, b)
                        # a run's lines all belong to the arrays before them; runs without arrays have none to lose
                        gone.append(a + np.flatnonzero((shard[here] == next(iter(probe.shards))) & probe(h1[here], h2[here], doc[here])[1]))
                gone = np.concatenate([np.zeros(0, np.int64), *gone])
                yield pa.RecordBatch.from_pydict({"doc_id": doc[gone], "h1": h1[gone], "h2": h2[gone]})

        none = [F.lit(None).cast("binary").alias(c) for c in ARRAYS]
        zero = [F.lit(0).cast("long").alias(c) for c in ("h1", "h2", "doc_id")]
        lines = docs.select("doc_id", "text").mapInArrow(asked, "shard int, run int, h1 long, h2 long, doc_id long").select("*", *none)
        rare = rare.withColumn("run", F.explode(F.sequence(F.lit(0), F.lit(runs - 1)))).select("shard", "run", *zero, *ARRAYS)
        both = lines.union(rare).repartition("shard", "run").sortWithinPartitions("shard", "run", F.col("sizes").isNull())
        gone = both.mapInArrow(answered, "doc_id long, h1 long, h2 long")
        gone = gone.groupBy("doc_id").agg(F.collect_list(F.struct("h1", "h2")).alias(mark)).withColumnRenamed("doc_id", ident)  # a document's own lines
        source = docs.withColumn(ident, F.coalesce("doc_id", F.lit(NO_ID))).join(gone, ident, "left").drop(ident)
    else:
        source = docs.withColumn(mark, F.lit(None).cast("array<struct<h1:bigint,h2:bigint>>"))

    def rewrite(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        probe = Probe(held.value, n_frequent, min_docs)
        for batch in batches:
            ids, texts = _texts(batch)
            lines = [t.split(b"\n") for t in texts]
            keys = [(d, j, k) for d, own in enumerate(lines) for j, line in enumerate(own) if (k := line_key(line, min_chars))]
            h1, h2 = _halves([k for _, _, k in keys])
            drop = probe(h1, h2, np.array([ids[d] for d, _, _ in keys], np.int64))[1]
            sent = [None if not g else {(x["h1"], x["h2"]) for x in g} for g in batch.column(mark).to_pylist()]
            for at, (d, _, _) in enumerate(keys):
                if sent[d] and (int(h1[at]), int(h2[at])) in sent[d]:
                    drop[at] = True
            n_lines, n_dropped = [len(x) for x in lines], [0] * len(lines)
            for at in np.flatnonzero(drop):
                d, j, _ = keys[at]
                lines[d][j] = None
                n_dropped[d] += 1
            kept = [t if not n else b"\n".join(x for x in own if x is not None) for t, own, n in zip(texts, lines, n_dropped)]
            columns = {n: pa.array(kept, pa.binary()).cast(pa.string()) if n == "text" else batch.column(n) for n in batch.schema.names if n != mark}
            yield pa.RecordBatch.from_pydict(columns | {"n_lines": pa.array(n_lines, pa.int64()), "n_dropped": pa.array(n_dropped, pa.int64())})

    return source.mapInArrow(rewrite, T.StructType([*docs.schema.fields, T.StructField("n_lines", T.LongType()), T.StructField("n_dropped", T.LongType())]))


def op10_dedup_lines(spark: SparkSession, sf_dir: str) -> DataFrame:
    kept = dedup_lines(table(spark, sf_dir, "documents").select("doc_id", "text"))
    return kept.select("doc_id", "n_lines", "n_dropped", F.sha2(F.col("text"), 256).alias("kept_sha256"))


QUERIES = {"op10_dedup_lines": op10_dedup_lines}
ORACLES = {
    "op10_dedup_lines": r"""
WITH l AS (SELECT doc_id, string_split(coalesce(text, ''), chr(10)) AS ls FROM documents),
e AS (SELECT doc_id, unnest(ls) AS line, generate_subscripts(ls, 1) AS pos FROM l),
k AS (SELECT doc_id, pos, line, translate(trim(line, ' ' || chr(9) || chr(10) || chr(11) || chr(12) || chr(13)), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS key FROM e),
r AS (SELECT key, max(doc_id) AS last FROM k WHERE length(key) >= 20 GROUP BY key HAVING count(DISTINCT doc_id) >= 3),
m AS (SELECT k.doc_id, k.pos, k.line, r.key IS NOT NULL AND r.last <> k.doc_id AS gone FROM k LEFT JOIN r ON r.key = k.key)
SELECT doc_id, count(*) AS n_lines, count(*) FILTER (WHERE gone) AS n_dropped,
       sha256(coalesce(string_agg(line, chr(10) ORDER BY pos) FILTER (WHERE NOT gone), '')) AS kept_sha256
FROM m GROUP BY doc_id"""
}
