"""Sequence packing by cutting-stock column generation."""

import os
import zlib
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from .common import cut, in_order, table
from .pieces import PieceTable
from .words import encoded

#: A private-use character. Its ids mark the ends of pieces that are encoded together; a piece that holds it is encoded alone.
STOP = "\ue000"
#: Column generation ends when the bound of the linear program is this near.
GAP = 3e-3
#: Lengths are packed in units, so the linear program has capacity / UNIT rows at most, whatever the corpus.
UNIT = 16


class PieceEncoder:
    """Ids of pieces by a tokenizer whose matches hold no white space."""

    def __init__(self, path: str):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.encode_special_tokens = True
        self.stop = np.array(self.tok.encode(STOP, add_special_tokens=False).ids, np.uint32)
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)  # tokens that end a word
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def _words(piece: str) -> int:
        """1 for a word of plain letters, 2 if ASCII marks follow it, 0 for anything else."""
        core = piece.rstrip(".,;:!?*&%$#|")
        return (1 + (len(core) < len(piece))) if core.isalpha() and max(core) < "\u0250" else 0

    def __call__(self, pieces: list[bytes], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        texts = [p.decode() for p in pieces]
        words = np.array([self._words(t) for t in texts], np.int64)
        stops = np.array([STOP in t for t in texts], bool)
        got, counts = [], np.zeros(len(pieces), np.int64)
        plain, other = np.flatnonzero(words), np.flatnonzero((words == 0) & ~stops)
        for group in (plain, other):
            for part in [group[a : a + 2000] for a in range(0, len(group), 2000)]:
                own = [texts[i] for i in part]
                found = self._counted(own, words[part]) if group is plain else None
                ids, counts[part] = found or self._joined(own)
                got.append(ids)
        for i in np.flatnonzero(stops):
            ids, n = self._joined([texts[i]])
            counts[i] = n[0]
            got.append(ids)
        order = np.concatenate([plain, other, np.flatnonzero(stops)])
        ids, n = np.concatenate([*got, np.zeros(0, np.uint32)]), counts[order]
        start = np.zeros(len(pieces), np.int64)
        start[order] = np.cumsum(n) - n
        ends = np.cumsum(counts)
        return ids[np.repeat(start - (ends - counts), counts) + np.arange(len(ids))], counts

    def _counted(self, part: list[str], words: np.ndarray) -> tuple[np.ndarray, np.ndarray] | None:
        """Ids of pieces of known numbers of words, encoded as one text; None if the words don't come out as many."""
        ids = np.array(self.tok.encode(" ".join(part), add_special_tokens=False).ids, np.uint32)
        ends = np.flatnonzero(self.ends[ids]) + 1
        return (ids, np.diff(ends[np.cumsum(words) - 1], prepend=0)) if len(ends) == words.sum() else None

    def _joined(self, part: list[str]) -> tuple[np.ndarray, np.ndarray]:
        """Ids of the pieces, encoded as one text in which STOP stands between them, and how many each has."""
        ids = np.array(self.tok.encode(f" {STOP} ".join(part), add_special_tokens=False).ids, np.uint32)
        k = len(self.stop)
        at = np.ones(max(0, len(ids) - k + 1), bool)
        for i in range(k):
            at &= ids[i : len(ids) - k + 1 + i] == self.stop[i]
        at = np.flatnonzero(at) if len(part) > 1 else np.zeros(0, np.int64)
        keep = np.ones(len(ids), bool)
        for i in range(k):
            keep[at + i] = False
        return ids[keep], np.diff(np.concatenate([[0], at - k * np.arange(len(at)), [int(keep.sum())]]))


@lru_cache(maxsize=2)
def _encoder(path: str) -> PieceTable:
    """Line ends are white space too; the tokenizer ignores letter case."""
    return PieceTable(PieceEncoder(path), b" \n", folded=True, mark_first=False)


def pieces_of(docs: DataFrame, tokenizer_path: str, capacity: int, end_id: int) -> DataFrame:
    """Whole sequences of each document, then its remainder: doc_id, start, length, ids_crc32, doc_tokens."""

    def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        enc = _encoder(tokenizer_path)
        for batch in batches:
            out: list[tuple] = []
            for doc, ids in zip(batch.column("doc_id").to_pylist(), enc(encoded(batch.column("text")))):
                ids = np.append(ids, np.uint32(end_id)).astype("<u4")
                out += [(doc, a, min(capacity, len(ids) - a), zlib.crc32(ids[a : a + capacity].tobytes()), len(ids)) for a in range(0, len(ids), capacity)]
            yield pa.RecordBatch.from_arrays([pa.array(x, pa.int64()) for x in (zip(*out) if out else [[]] * 5)], ["doc_id", "start", "length", "ids_crc32", "doc_tokens"])

    return docs.select("doc_id", "text").mapInArrow(encode, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long")


def knapsack(values: np.ndarray, sizes: np.ndarray, capacity: int) -> tuple[float, np.ndarray]:
    """Unbounded knapsack by dynamic programming: the best value within capacity, and how often each item is in it."""
    best, last = np.zeros(capacity + 1), np.full(capacity + 1, -1)
    for room in range(1, capacity + 1):
        best[room] = best[room - 1]
        n = int(np.searchsorted(sizes, room, side="right"))
        if n:
            got = best[room - sizes[:n]] + values[:n]
            i = int(got.argmax())
            if got[i] > best[room] + 1e-12:
                best[room], last[room] = got[i], i
    counts, room = np.zeros(len(sizes), np.int64), capacity
    while room > 0:
        if last[room] < 0:
            room -= 1
        else:
            counts[last[room]] += 1
            room -= sizes[last[room]]
    return float(best[capacity]), counts


def generate_patterns(sizes: np.ndarray, demand: np.ndarray, capacity: int, rounds: int = 1000) -> tuple[np.ndarray, np.ndarray]:
    """Column generation for the cutting-stock program: min sum x, sum of x_p * pattern_p >= demand, x >= 0.

    The basis starts with one pattern a size. Each round the duals price a new pattern by the knapsack; if it is worth more
    than one sequence it enters, and the pattern that runs out first leaves, until x is within GAP of the dual bound.
    Returns basic patterns (columns) and x."""
    m = len(sizes)
    basis, cost = np.diag(capacity // sizes).astype(float), np.ones(m)
    inverse = np.diag(1 / np.diag(basis))
    x = inverse @ demand
    center = sizes / capacity  # feasible duals: the bound of the material
    bound = float(center @ demand)
    for step in range(rounds):
        duals = cost @ inverse
        if cost @ x <= bound * (1 + GAP):
            break
        low = int(duals.argmin())
        if duals[low] < -1e-9:  # more than the demand of a size is cheaper: its surplus enters
            counts, price = -np.eye(m)[low], 0.0
        else:
            for weight in (0.8, 0.4, 0.0):  # duals drawn towards the best ones so far give steadier patterns
                mixed = weight * center + (1 - weight) * np.maximum(duals, 0)
                value, counts = knapsack(mixed, sizes, capacity)
                if mixed @ demand / max(value, 1) > bound:
                    bound, center = float(mixed @ demand / max(value, 1)), mixed / max(value, 1)
                if duals @ counts > 1 + 1e-7:
                    break
            else:
                break
            price = 1.0
        direction = inverse @ counts
        ratio = np.where(direction > 1e-9, x / np.where(direction > 1e-9, direction, 1), np.inf)
        out = int(ratio.argmin())
        if not np.isfinite(ratio[out]):
            break
        least = ratio[out]
        x = np.maximum(x - least * direction, 0)
        x[out] = least
        basis[:, out], cost[out] = counts, price
        row = inverse[out] / direction[out]
        inverse -= np.outer(direction, row)
        inverse[out] = row
        if step % 200 == 199:
            inverse = np.linalg.inv(basis)
            x = np.maximum(inverse @ demand, 0)
    return basis[:, cost > 0].astype(np.int64), x[cost > 0]


def plan(histogram: dict[int, int], capacity: int) -> pd.DataFrame:
    """Which ranks of each class (length in units) go to which sequences: rows (cls, first, last, each, sequence, slot).

    Ranks first..last-1 are dealt `each` to a sequence from `sequence` on, at slots from `slot`. Patterns are rounded down;
    what is left, less than the basis can hold once, is packed best fit first. Rows: bounded by the square of the classes."""
    room = capacity // UNIT
    sizes = np.array(sorted(histogram), np.int64)
    demand = np.array([histogram[s] for s in sizes], np.int64)
    uses: list[tuple[np.ndarray, int]] = []
    if len(sizes):
        patterns, x = generate_patterns(sizes, demand.astype(float), room)
        left = demand.copy()
        for p, n in sorted(zip(patterns.T, np.floor(x + 1e-6).astype(np.int64)), key=lambda u: -u[1]):
            used = p > 0
            n = min(n, int((left[used] // p[used]).min())) if used.any() else 0
            if n > 0:
                uses.append((p, n))
                left -= n * p
        while left.any():
            p, free = np.zeros(len(sizes), np.int64), room
            for i in range(len(sizes) - 1, -1, -1):
                p[i] = min(left[i], free // sizes[i])
                free -= p[i] * sizes[i]
            used = p > 0
            n = int((left[used] // p[used]).min())
            uses.append((p, n))
            left -= n * p
    rows, sequence, given = [], 0, np.zeros(len(sizes), np.int64)
    for p, n in uses:
        slot = 0
        for i in np.flatnonzero(p)[::-1]:
            rows.append((int(sizes[i]), int(given[i]), int(given[i] + n * p[i]), int(p[i]), sequence, slot))
            given[i] += n * p[i]
            slot += int(p[i])
        sequence += n
    return pd.DataFrame(rows, columns=["cls", "first", "last", "each", "sequence", "slot"], dtype=np.int64)


def pack(docs: DataFrame, tokenizer_path: str, capacity: int = 2048, end_id: int = 1) -> DataFrame:
    """Packs all documents' ids, each document's followed by end_id, into sequences of at most `capacity` ids.

    Pieces: doc_id, start, length, ids_crc32, doc_tokens, sequence_id, offset. A document gives whole sequences and one
    remainder. The remainders' histogram (capacity / 16 classes at most) is all that reaches the driver; the plan that comes
    back is a table of the same bound, by which the pieces, ranked by class, find their sequences.
    Null or empty text: the end id alone. Null doc_id: kept. Repeated rows: each is packed. Empty table: empty. Other
    columns: ignored."""
    units = lambda c: F.ceil(F.col(c) / UNIT).cast("long")
    pieces = cut(pieces_of(docs, tokenizer_path, capacity, end_id))
    pieces = in_order(pieces.withColumn("cls", units("length")), [F.desc("cls"), F.desc("length"), "doc_id", "start", "ids_crc32"])
    histogram = {r["cls"]: r["n"] for r in pieces.groupBy("cls").agg(F.count("*").alias("n")).collect()}  # capacity / 16 rows
    before, starts = 0, {}
    for c in sorted(histogram, reverse=True):
        starts[c] = before
        before += histogram[c]
    by_class = {int(c): rows.sort_values("first") for c, rows in plan(histogram, capacity).groupby("cls")}

    def place(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for batch in batches:
            for c, own in batch.groupby("cls"):
                rows, rank = by_class[int(c)], own["at"].to_numpy() - starts[int(c)]
                row = rows.iloc[np.searchsorted(rows["last"].to_numpy(), rank, side="right")]
                k = rank - row["first"].to_numpy()
                yield own.drop(columns=["cls", "at"]).assign(sequence_id=row["sequence"].to_numpy() + k // row["each"].to_numpy(), slot=row["slot"].to_numpy() + k % row["each"].to_numpy())

    placed = pieces.mapInPandas(place, "doc_id long, start long, length long, ids_crc32 long, doc_tokens long, sequence_id long, slot long")
    earlier = Window.partitionBy("sequence_id").orderBy("slot").rowsBetween(Window.unboundedPreceding, -1)  # at most `capacity` rows
    return placed.withColumn("offset", F.coalesce(F.sum("length").over(earlier), F.lit(0))).drop("slot")


def op1_pack_cutting_stock(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return pack(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op1_pack_cutting_stock": op1_pack_cutting_stock}
