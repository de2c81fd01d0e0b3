"""Language identification with hyperdimensional profiles."""

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import mix, slices, table

DIM = 512
#: Letters: 0 is any run of other characters, 1-26 are a-z; every other letter of the world has one of the rest by a hash of its
#: code point, so that letters of one script hardly ever share one.
LETTERS = 1 << 12
N = 3
#: Code points read at once; a longer text is read in pieces.
SEGMENT = 1 << 18
#: Grams whose vectors are made at once.
GRAMS = 4096


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """Letter of each code point; case is set aside."""
    points = np.arange(0x110000)
    lower = np.fromiter((ord(chr(c).lower()[0]) if chr(c).isalpha() else 0 for c in range(0x110000)), np.int64, len(points))
    other = 27 + (mix(lower.astype(np.uint64) + np.uint64(0x4C4554)) % np.uint64(LETTERS - 27)).astype(np.int64)
    return np.where(lower == 0, 0, np.where((lower >= 97) & (lower <= 122), lower - 96, other)).astype(np.int32)


@lru_cache(maxsize=1)
def letter_vectors() -> np.ndarray:
    """A random +1/-1 vector for each letter, in each of the N places of a gram: rotated once more for every place further on."""
    bits = mix(np.arange(LETTERS * DIM // 64, dtype=np.uint64) + np.uint64(0x48443231))
    base = np.unpackbits(bits.view(np.uint8)).reshape(LETTERS, DIM).astype(np.int8) * 2 - 1
    return np.stack([np.roll(base, N - 1 - i, axis=1) for i in range(N)])


def gram_vectors(grams: np.ndarray) -> np.ndarray:
    """The vector of each trigram: its letters' vectors, multiplied together."""
    v = letter_vectors()
    return v[0][grams // LETTERS**2] * v[1][grams // LETTERS % LETTERS] * v[2][grams % LETTERS]


def bundle(grams: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """The weighted sum of trigram vectors."""
    out = np.zeros(DIM)
    for i in range(0, len(grams), GRAMS):
        out += weights[i : i + GRAMS].astype(np.float32) @ gram_vectors(grams[i : i + GRAMS]).astype(np.float32)
    return out


def _tally(grams: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    order = np.argsort(grams, kind="stable")
    grams = grams[order]
    ends = np.append(np.flatnonzero(np.diff(grams)), len(grams) - 1) if len(grams) else order
    total = np.cumsum(counts[order]) if counts is not None else np.arange(1, len(grams) + 1)
    return grams[ends], np.diff(total[ends], prepend=0)


def _points(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le", "surrogatepass"), np.uint32)


def _grams(letters: np.ndarray) -> np.ndarray:
    """Trigrams of letters in which gaps are collapsed; the middle one is a letter."""
    x = letters.astype(np.int64)
    return ((x[:-2] * LETTERS + x[1:-1]) * LETTERS + x[2:])[x[1:-1] != 0]


def _collapsed(letters: np.ndarray) -> np.ndarray:
    """Without all but the first of each run of gaps."""
    keep = np.ones(len(letters), bool)
    keep[1:] = (letters[1:] | letters[:-1]) != 0
    return letters[keep]


def _long_counts(text: str) -> tuple[np.ndarray, np.ndarray]:
    """The grams of one long text, read piece by piece; the last two letters of a piece stand before the next."""
    held, grams, counts = np.zeros(1, np.int32), np.zeros(0, np.int64), np.zeros(0, np.int64)
    for i in range(0, len(text), SEGMENT):
        letters = _collapsed(np.concatenate([held, _letters()[_points(text[i : i + SEGMENT])]]))
        own, n = _tally(_grams(letters))
        grams, counts = _tally(np.concatenate([grams, own]), np.concatenate([counts, n]))
        held = letters[-2:]
    own, n = _tally(_grams(_collapsed(np.append(held, np.int32(0)))))
    return _tally(np.concatenate([grams, own]), np.concatenate([counts, n]))


def gram_counts(texts: list[str | None]):
    """For each whole text, its distinct letter trigrams (the middle one a letter; a gap sets off words) and their counts."""
    texts = [t or "" for t in texts]
    for a, b in slices([len(t) for t in texts], SEGMENT):
        if b == a + 1 and len(texts[a]) > SEGMENT:
            yield _long_counts(texts[a])
            continue
        letters = _letters()[_points(" ".join(["", *texts[a:b], ""]))]
        keep = np.ones(len(letters), bool)
        keep[1:] = (letters[1:] | letters[:-1]) != 0
        ends = np.cumsum(keep)[np.cumsum([len(t) + 1 for t in texts[a:b]]) - 1]
        letters = letters[keep]
        grams, middle = _grams(letters), letters[1:-1] != 0
        ends = np.append(0, np.cumsum(middle))[np.minimum(ends - 1, len(middle))]
        for x, y in zip(np.append(0, ends[:-1]), ends):
            yield _tally(grams[x:y])


def learn(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """Prototypes: the bundle of all n-gram vectors of each language's texts, each document with weight one; as unit rows.

    Every task adds up its own vectors, so one vector for each language and task is shuffled. Null text or no letter: adds
    nothing. Empty table: no languages. Other columns: ignored."""

    def profiles(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        sums: dict[str, np.ndarray] = {}
        for batch in batches:
            for lang, (grams, counts) in zip(batch.column("lang").to_pylist(), gram_counts(batch.column("text").to_pylist())):
                if len(grams):
                    sums[lang] = sums.get(lang, 0) + bundle(grams, counts / counts.sum())
        rows = [(lang, i, float(x)) for lang, v in sums.items() for i, x in enumerate(v)]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.float64())], ["lang", "i", "x"])

    sums = docs.select("lang", "text").mapInArrow(profiles, "lang string, i int, x double").groupBy("lang", "i").agg(F.sum("x").alias("x")).collect()  # languages x DIM numbers
    langs = sorted({r["lang"] for r in sums})
    out = np.zeros((len(langs), DIM))
    for r in sums:
        out[langs.index(r["lang"]), r["i"]] = round(r["x"], 6)
    return langs, out / np.maximum(np.linalg.norm(out, axis=1, keepdims=True), 1e-12)


def predict(docs: DataFrame, langs: list[str], prototypes: np.ndarray, evidence: bool = False) -> DataFrame:
    """docs with lang_pred (string) and score (double): the prototype of largest cosine, and that cosine, 0 at least.

    lang_pred is `und`, score 0, if text is null or has no letter, or nothing was learned; ties go to the first language
    in the alphabet. Whole texts are read, long ones in segments. Null doc_id: a result with null. Repeated rows: a result each. Other columns pass through; columns
    named lang_pred or score are replaced. Empty table: empty.
    evidence: also a column of that name (double, replaced too), how many different trigrams the cosine rests on: the square
    of the counts' sum by the sum of their squares, so that a word said over and over counts once."""
    docs = docs.drop("lang_pred", "score", *["evidence"] * evidence)

    def judge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            best, score, rests = [], [], []
            for grams, counts in gram_counts(batch.column("text").to_pylist()):
                rests.append(float(counts.sum()) ** 2 / max(float(np.square(counts, dtype=np.float64).sum()), 1.0))
                if not len(grams) or not langs:
                    best.append("und")
                    score.append(0.0)
                    continue
                v = bundle(grams, counts)
                cos = np.round(prototypes @ v / max(np.linalg.norm(v), 1e-12), 9)
                best.append(langs[int(cos.argmax())])
                score.append(float(min(max(cos.max(), 0.0), 1.0)))
            told = [pa.array(best, pa.string()), pa.array(score, pa.float64()), pa.array(rests, pa.float64())][: len(added)]
            yield pa.RecordBatch.from_arrays([*batch.columns, *told], [*batch.schema.names, *(f.name for f in added)])

    from pyspark.sql import types as T

    added = [T.StructField("lang_pred", T.StringType()), T.StructField("score", T.DoubleType()), T.StructField("evidence", T.DoubleType())][: 2 + evidence]
    return docs.mapInArrow(judge, T.StructType([*docs.schema.fields, *added]))


def held_out():
    """Whether a document is held out from learning: CRC-32 of its id in decimal leaves 2 on division by 4."""
    return F.coalesce(F.crc32(F.col("doc_id").cast("string").cast("binary")) % 4 == 2, F.lit(False))


def op2_language_profiles(spark: SparkSession, sf_dir: str) -> DataFrame:
    docs = table(spark, sf_dir, "documents")
    langs, prototypes = learn(docs.where(~held_out() & F.col("lang").isNotNull()))
    return predict(docs.select("doc_id", "text", held_out().alias("held_out")), langs, prototypes).drop("text")


QUERIES = {"op2_language_profiles": op2_language_profiles}
