"""Byte-level BPE by merge replay over the distinct words of a block of the corpus."""

import base64
import hashlib
import heapq
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from .common import slices, table
from .pieces import PieceTable
from .words import SEGMENT, encoded

NONE = 1 << 40
#: In UTF-8, a space before more white space or at the end: there the pattern matches several characters as one.
RUN = re.compile(rb" (?:[\x09-\x0d\x1c-\x20]|\xc2[\x85\xa0]|\xe1\x9a\x80|\xe2\x80[\x80-\x8a\xa8\xa9\xaf]|\xe2\x81\x9f|\xe3\x80\x80|\Z)")
#: A place that the pattern never matches across: before a space that stands alone.
ALONE = re.compile(r"(?<=\S)(?= \S)")


class MergeReplay:
    """Encodes many words at once. An inverted index leads from each merge (by its rank) to the positions where the two
    neighbouring tokens form it; merges are applied in rank order to all words, and only touched neighbours are looked up."""

    def __init__(self, ranks: dict[bytes, int]):
        self.ranks = ranks
        self.token = {r: t for t, r in ranks.items()}
        self.pair = {(ranks[t[:i]] << 20) | ranks[t[i:]]: r for t, r in ranks.items() for i in range(1, len(t)) if t[:i] in ranks and t[i:] in ranks}
        self.byte = np.array([ranks[bytes([b])] for b in range(256)])
        self.keys = np.array(sorted(self.pair), np.int64)
        self.merged = np.array([self.pair[k] for k in self.keys.tolist()], np.int64)
        self.size = max(ranks.values()) + 1

    def one(self, word: bytes) -> list[int]:
        """The plain rule: again and again, merge the leftmost pair of least rank."""
        ids = [int(self.byte[b]) for b in word]
        while len(ids) > 1:
            rank, i = min((self.pair.get((a << 20) | b, NONE), i) for i, (a, b) in enumerate(zip(ids, ids[1:])))
            if rank == NONE:
                break
            ids[i : i + 2] = [rank]
        return ids

    def _rank(self, left: np.ndarray, right: np.ndarray) -> np.ndarray:
        """Rank of the merge of each pair of neighbours; NONE if there is none."""
        key = (left.astype(np.int64) << 20) | right
        at = np.minimum(np.searchsorted(self.keys, key), len(self.keys) - 1)
        return np.where(self.keys[at] == key, self.merged[at], NONE)

    def __call__(self, words: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
        """All ids, and where each word's begin (one entry more than words)."""
        sizes = np.fromiter(map(len, words), np.int64, len(words))
        begin = np.concatenate([[0], np.cumsum(sizes)])
        raw = np.frombuffer(b"".join(words), np.uint8)
        ids, n = self.byte[raw].astype(np.int64), len(raw)
        after, before = np.arange(1, n + 1), np.arange(-1, n - 1)
        after[begin[1:][sizes > 0] - 1] = -1
        before[begin[:-1][sizes > 0]] = -1
        owner = np.repeat(np.arange(len(words)), sizes)
        again: set[int] = set()
        index: dict[int, list[np.ndarray]] = {}
        due: list[int] = []  # heap of the ranks in the index

        def enter(ranks: np.ndarray, at: np.ndarray, least: int) -> None:
            low = ranks < least
            if low.any():  # a merge out of order: such a word is replayed alone
                again.update(owner[at[low]].tolist())
            ok = (ranks != NONE) & ~low
            ranks, at = ranks[ok], at[ok]
            if not len(ranks):
                return
            by = np.argsort(ranks, kind="stable")
            ranks, at = ranks[by], at[by]
            cuts = np.flatnonzero(np.diff(ranks)) + 1
            for r, part in zip(ranks[np.concatenate([[0], cuts])].tolist(), np.split(at, cuts)):
                if r not in index:
                    index[r] = []
                    heapq.heappush(due, r)
                index[r].append(part)

        at = np.flatnonzero(after >= 0)
        enter(self._rank(ids[at], ids[at + 1]), at, 0)
        while due:
            rank = heapq.heappop(due)
            at = np.sort(np.concatenate(index.pop(rank)))
            at = at[np.append(True, at[1:] != at[:-1])]
            at = at[(ids[at] >= 0) & (after[at] >= 0)]
            at = at[self._rank(ids[at], ids[after[at]]) == rank]
            if len(at) > 1:
                over = np.append(False, after[at[:-1]] == at[1:])  # pairs that share a token: every other one, from the left
                if over.any():
                    run = np.arange(len(at)) - np.maximum.accumulate(np.where(over, 0, np.arange(len(at))))
                    at = at[run % 2 == 0]
            if not len(at):
                continue
            gone = after[at]
            ids[at] = rank
            ids[gone] = -1
            end = after[at] = after[gone]
            inner = end >= 0
            before[end[inner]] = at[inner]
            left, right = at[inner], at[before[at] >= 0]
            enter(self._rank(ids[left], ids[after[left]]), left, rank)
            enter(self._rank(ids[before[right]], ids[right]), before[right], rank)
        if again:
            spelled = [ids[a:b][ids[a:b] >= 0] for a, b in zip(begin, begin[1:])]
            for w in again:
                spelled[w] = np.array(self.one(words[w]), np.int64)
            return np.concatenate(spelled), np.concatenate([[0], np.cumsum([len(x) for x in spelled])])
        alive = ids >= 0
        return ids[alive], np.concatenate([[0], np.cumsum(alive)])[begin]


def read_ranks(path: str) -> dict[bytes, int]:
    with open(path, "rb") as f:
        return {base64.b64decode(a): int(b) for a, b in map(bytes.split, f)}


class Encoder:
    """Ids of texts. A text is cut before every single space, which the pattern never matches across. Texts in which a space
    is followed by more white space (any that Unicode has), or by the end, are matched in segments that are cut only where a
    space stands alone."""

    def __init__(self, path: str, pattern: str):
        import regex

        self.replay, self.match = MergeReplay(read_ranks(path)), regex.compile(pattern).findall
        self.table = PieceTable(self._pieces, b" ", folded=False, mark_first=True)
        tokens = [self.replay.token.get(i, b"") for i in range(self.replay.size)]
        self.spelled = Spelling(tokens)
        self.decimals = Spelling([b"%d " % i for i in range(self.replay.size)])

    def _matched(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray]:
        matched = [self.match(t) for t in texts]
        place = {w: i for i, w in enumerate({w for m in matched for w in m})}
        ids, begin = self.replay([w.encode() for w in place])
        at = np.array([place[w] for m in matched for w in m], np.int64)
        n = begin[at + 1] - begin[at] if len(at) else np.zeros(0, np.int64)
        ends = np.cumsum(n)
        flat = ids[np.repeat(begin[at] - (ends - n), n) + np.arange(ends[-1])] if len(at) else ids
        return flat, np.diff(np.append(0, ends)[np.cumsum([0, *map(len, matched)])])

    def _pieces(self, pieces: list[bytes], first: list[bool]) -> tuple[np.ndarray, np.ndarray]:
        return self._matched([p.decode() if f else " " + p.decode() for p, f in zip(pieces, first)])

    @staticmethod
    def _segments(text: str) -> Iterator[str]:
        start = 0
        while len(text) - start > 2 * SEGMENT and (at := ALONE.search(text, start + SEGMENT)):
            yield text[start : at.start()]
            start = at.start()
        yield text[start:]

    def _whole(self, texts: list[str]) -> list[np.ndarray]:
        """Ids of texts with runs of white space; about a segment of text is matched at once."""
        parts = [(i, s) for i, t in enumerate(texts) for s in self._segments(t)]
        out: list[list[np.ndarray]] = [[] for _ in texts]
        for a, b in slices([len(s) for _, s in parts], SEGMENT):
            ids, n = self._matched([s for _, s in parts[a:b]])
            for (i, _), own in zip(parts[a:b], np.split(ids, np.cumsum(n)[:-1])):
                out[i].append(own)
        return [np.concatenate(x) for x in out]

    def __call__(self, texts: list[bytes]) -> Iterator[np.ndarray]:
        runs = [RUN.search(t) is not None for t in texts]
        whole = iter(self._whole([t.decode() for t, r in zip(texts, runs) if r]))
        for r, ids in zip(runs, self.table([b"" if r else t for t, r in zip(texts, runs)])):
            yield next(whole) if r else ids


class Spelling:
    """Joins the bytes that stand for each id."""

    def __init__(self, tokens: list[bytes]):
        self.size = np.fromiter(map(len, tokens), np.int64, len(tokens))
        self.start = np.cumsum(self.size) - self.size
        self.raw = np.frombuffer(b"".join(tokens), np.uint8)

    def __call__(self, ids: np.ndarray) -> bytes:
        n = self.size[ids]
        ends = np.cumsum(n)
        return self.raw[np.repeat(self.start[ids] - (ends - n), n) + np.arange(ends[-1])].tobytes() if len(ids) else b""


@lru_cache(maxsize=2)
def _encoder(path: str, pattern: str) -> Encoder:
    return Encoder(path, pattern)


def bpe_digests(docs: DataFrame, ranks_path: str, pattern: str) -> DataFrame:
    """Encodes every whole text and decodes it again: n_tokens, ids_sha256, decoded_sha256 for each doc_id.

    ranks_path: a file of ranks (base64 token, rank) found on every machine. Map only: nothing is shuffled.
    Null or empty text: no ids, digests of the empty string. Null doc_id: a result with null. Repeated rows: a result each.
    Empty table: empty. Other columns: ignored."""

    def digests(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        encode = _encoder(ranks_path, pattern)
        for batch in batches:
            n, ids, back = [], [], []
            for own in encode(encoded(batch.column("text"))):
                n.append(len(own))
                ids.append(hashlib.sha256(encode.decimals(own)[:-1]).hexdigest())
                back.append(hashlib.sha256(encode.spelled(own)).hexdigest())
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(ids, pa.string()), pa.array(back, pa.string())], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    return docs.select("doc_id", "text").mapInArrow(digests, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def op3_bpe_round_trip(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("byte_bpe_50k.tiktoken"), public_tokenizers.PATTERN)


QUERIES = {"op3_bpe_round_trip": op3_bpe_round_trip}
