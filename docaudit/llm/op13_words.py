"""BPE with word ends, over the table of the corpus's distinct words."""

import hashlib
import os
import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW_ROWS, TEXT_ROWS, batch_rows, cut, discard, mix, mix_int, partitions, slices, table, text_batches
from .words import _BASE, _BYTE, _INVERSE, _power, _segments, encoded

#: Bytes of text in a block: documents whose words are numbered together.
BLOCK = 32 << 20
#: Kinds of bytes: 0 white space, 1 ASCII letters and digits, 2 marks that no rule of the tokenizer joins to letters, 3 others.
_KIND = np.full(256, 3, np.int8)
_KIND[[0x20, *range(0x09, 0x0E)]] = 0
_KIND[[b for b in range(128) if chr(b).isalnum()]] = 1
_KIND[[ord(c) for c in '.,;:!?()"-/_=+*#%&$[]{}']] = 2
_PLAIN = re.compile(r"[A-Za-z]+|[0-9]|[.,;:!?()\"\-/_=+*#%&$\[\]{}]+")
#: Words that are gathered at once when a document's digests are made.
STEP = 1 << 18
#: Of many words of a block, as packed numbers: their own, the counts of their ids, the ids.
WORDS = ["numbers", "counts", "ids"]


def split_words(raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Starts and ends of the words: runs of bytes other than white space, cut where ASCII letters or digits meet plain marks.

    The tokenizer never matches across such a place, whatever stands around it. Bytes of kind 3 (the apostrophe, the signs of
    special tokens, all beyond ASCII) stay with their neighbours."""
    kind = np.append(_KIND[raw], np.int8(0))
    before = np.concatenate([np.zeros(1, np.int8), kind[:-1]])
    cuts = np.flatnonzero((kind != before) & ((kind == 0) | (before == 0) | ((kind != 3) & (before != 3))))
    word = kind[cuts] != 0
    return cuts[word], cuts[1:][word[:-1]]


def numbers_packed(x: np.ndarray) -> bytes:
    """Whole numbers as bytes, seven bits each, the lowest first; small numbers take one byte."""
    size = 1 + (x >= 1 << 7) + (x >= 1 << 14) + (x >= 1 << 21) + (x >= 1 << 28)
    ends = np.cumsum(size)
    out = np.zeros(int(ends[-1]) if len(x) else 0, np.uint8)
    for k in range(5):
        has = size > k
        out[(ends - size)[has] + k] = ((x[has] >> (7 * k)) & 127) | np.where(size[has] > k + 1, 128, 0)
    return out.tobytes()


def numbers_unpacked(raw: bytes) -> np.ndarray:
    b = np.frombuffer(raw, np.uint8)
    last = np.flatnonzero(b < 128)
    if not len(last):
        return np.zeros(0, np.int64)
    start = np.append(0, last[:-1] + 1)
    out = np.zeros(len(last), np.int64)
    for k in range(5):
        has = start + k <= last
        out[has] |= (b[start[has] + k].astype(np.int64) & 127) << (7 * k)
    return out


class Block:
    """Numbers the distinct words of some texts, the most frequent first. `name` tells the block by its place and its words,
    so a block that is read again has the same name only if it holds the same words."""

    def __init__(self, texts: list[bytes], place: int):
        segments = [(i, s) for i, t in enumerate(texts) for s in _segments(t)]
        seen, first, backs, self.owners = [], [], [], []
        for a, b in slices([len(s) for _, s in segments], 1 << 18):
            joined = b"\n".join(s for _, s in segments[a:b]) + b"\n"
            raw = np.frombuffer(joined, np.uint8)
            starts, ends = split_words(raw)
            sums = np.zeros(len(raw) + 1, np.uint64)
            np.cumsum(_BYTE[raw] * _power("up", _BASE, len(raw)), out=sums[1:])
            hashes = mix((sums[ends] - sums[starts]) * _power("down", _INVERSE, len(raw))[starts])
            distinct, at, back = np.unique(hashes, return_index=True, return_inverse=True)
            bounds = np.cumsum([len(s) + 1 for _, s in segments[a:b]])
            self.owners.append(([i for i, _ in segments[a:b]], np.diff(np.searchsorted(starts, bounds), prepend=0)))
            seen.append(distinct)
            first.append((joined, starts[at], ends[at]))
            backs.append(back.astype(np.int32))
        every = np.concatenate([*seen, np.zeros(0, np.uint64)])
        distinct, at, back = np.unique(every, return_index=True, return_inverse=True)
        times = np.zeros(len(distinct), np.int64)
        bounds = np.cumsum([0, *map(len, seen)])
        for k, own in enumerate(backs):
            times[back[bounds[k] : bounds[k + 1]]] += np.bincount(own, minlength=len(seen[k]))
        order = np.lexsort((distinct, -times))
        rank = np.empty(len(order), np.int32)
        rank[order] = np.arange(len(order), dtype=np.int32)
        self.codes = [rank[back[bounds[k] : bounds[k + 1]]][own] for k, own in enumerate(backs)]
        part = np.searchsorted(bounds, at[order], side="right") - 1
        self.words = [first[k][0][first[k][1][j] : first[k][2][j]].decode() for k, j in zip(part.tolist(), (at[order] - bounds[part]).tolist())]
        self.name = (mix_int(place) + int(mix(distinct[order] + np.arange(len(order), dtype=np.uint64)).sum(dtype=np.uint64))) % (1 << 64) >> 1

    def documents(self, n: int) -> list[bytes]:
        """Each text as the packed numbers of its words."""
        parts: list[list[bytes]] = [[] for _ in range(n)]
        for (own, counts), codes in zip(self.owners, self.codes):
            for i, c in zip(own, np.split(codes, np.cumsum(counts)[:-1])):
                parts[i].append(numbers_packed(c))
        return [b"".join(p) for p in parts]


def _blocks(batches: Iterator[pa.RecordBatch]) -> Iterator[tuple[pa.Array, Block]]:
    """A task's documents in blocks: their ids, and their words."""
    ids, texts, size, place = [], [], 0, 0
    for batch in batches:
        place = place or batch.num_rows and batch.column("part")[0].as_py() << 24
        new = encoded(batch.column("text"))
        for a, b in slices([len(t) for t in new], BLOCK // 4):
            ids.append(batch.column("doc_id").slice(a, b - a))
            texts += new[a:b]
            size += sum(map(len, new[a:b]))
            if size >= BLOCK:
                place += 1
                yield pa.concat_arrays(ids), Block(texts, place)
                ids, texts, size = [], [], 0
    if texts:
        yield pa.concat_arrays(ids), Block(texts, place + 1)


def _read(docs: DataFrame) -> DataFrame:
    return docs.select("doc_id", "text", F.spark_partition_id().alias("part"))


def word_lists(docs: DataFrame) -> DataFrame:
    """(block, number, word): the distinct words of each block of documents."""

    def lists(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for _, block in _blocks(batches):
            for a in range(0, len(block.words), NARROW_ROWS):
                own = block.words[a : a + NARROW_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block.name, np.int64)), pa.array(np.arange(a, a + len(own), dtype=np.int32)), pa.array(own, pa.string())], ["block", "number", "word"])

    return _read(docs).mapInArrow(lists, "block long, number int, word string")


def coded_documents(docs: DataFrame) -> DataFrame:
    """(block, doc_id, codes): each document as the numbers of its words, in order."""

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for ids, block in _blocks(batches):
            codes = block.documents(len(ids))
            for a in range(0, len(ids), TEXT_ROWS):
                own = codes[a : a + TEXT_ROWS]
                yield pa.RecordBatch.from_arrays([pa.array(np.full(len(own), block.name, np.int64)), ids.slice(a, len(own)), pa.array(own, pa.binary())], ["block", "doc_id", "codes"])

    return _read(docs).mapInArrow(code, "block long, doc_id long, codes binary")


class WordEncoder:
    """Ids of words. Words of plain letters, digits or marks are encoded many at once, as one text between spaces."""

    def __init__(self, path: str, specials: bool):
        os.environ["TOKENIZERS_PARALLELISM"] = "false"
        from tokenizers import Tokenizer

        self.tok = Tokenizer.from_file(path)
        self.tok.no_truncation()
        self.tok.no_padding()
        self.tok.encode_special_tokens = not specials
        self.ends = np.zeros(self.tok.get_vocab_size(), bool)
        self.ends[[i for t, i in self.tok.get_vocab().items() if t.endswith("</w>")]] = True

    @staticmethod
    def _parts(word: str) -> int:
        """Matches of the tokenizer's pattern in a word of plain characters; 0 for any other word."""
        if word.isascii() and word.isalpha():
            return 1
        found = _PLAIN.findall(word)
        return len(found) if sum(map(len, found)) == len(word) else 0

    def __call__(self, words: list[str]) -> list[list[int]]:
        out: list = [None] * len(words)
        parts = np.array([self._parts(w) for w in words], np.int64)
        plain = np.flatnonzero(parts)
        for part in [plain[a : a + 2000] for a in range(0, len(plain), 2000)]:
            ids = np.array(self.tok.encode(" ".join(words[i] for i in part), add_special_tokens=False).ids, np.int32)
            ends = np.flatnonzero(self.ends[ids]) + 1
            if len(ends) == parts[part].sum():
                for i, own in zip(part.tolist(), np.split(ids, ends[np.cumsum(parts[part]) - 1][:-1])):
                    out[i] = own
        rest = [i for i, x in enumerate(out) if x is None]
        for i, e in zip(rest, self.tok.encode_batch_fast([words[i] for i in rest], add_special_tokens=False)):
            out[i] = e.ids
        return out


@lru_cache(maxsize=2)
def _encoder(path: str, specials: bool) -> WordEncoder:
    return WordEncoder(path, specials)


def encoded_words(words: DataFrame, path: str, specials: bool = True) -> DataFrame:
    """(word, ids) of distinct words; keeps the partitioning of words."""

    @F.pandas_udf("array<int>")
    def ids_of(word: pd.Series) -> pd.Series:
        return pd.Series(_encoder(path, specials)(word.tolist()), dtype=object)

    return words.select("word", ids_of("word").alias("ids"))


def vocabulary(spark: SparkSession, path: str) -> DataFrame:
    """(id, piece): all tokens, the special ones too. Rows: the size of the vocabulary, whatever the corpus."""
    from tokenizers import Tokenizer

    pieces = Tokenizer.from_file(path).get_vocab(with_added_tokens=True)
    return spark.createDataFrame(pd.DataFrame({"id": np.array(list(pieces.values()), np.int32), "piece": list(pieces)}), "id int, piece string")


def block_pieces(filled: DataFrame, pieces: DataFrame) -> DataFrame:
    """(block, pieces): what the ids of each block's words stand for, by a join of its distinct ids with the vocabulary. As many
    ids a block as the vocabulary has, at most."""
    each = filled.select("block", F.explode("ids").alias("id")).distinct().join(F.broadcast(pieces), "id")  # rows: the vocabulary
    return each.groupBy("block").agg(F.collect_list(F.struct("id", "piece")).alias("pieces"))


def packed_words(filled: DataFrame) -> DataFrame:
    """Rows (block, number, ids), sorted by block in each task, as one row for each run: arrays of all its words."""

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            block = batch.column("block").to_numpy()
            if not len(block):
                continue
            at = np.concatenate([[0], np.flatnonzero(block[1:] != block[:-1]) + 1, [len(block)]])
            out: list[tuple] = []
            for a, b in zip(at[:-1].tolist(), at[1:].tolist()):
                part = batch.slice(a, b - a)
                arrays = part.column("number").to_numpy(), np.diff(part.column("ids").offsets.to_numpy()), part.column("ids").flatten().to_numpy()
                out.append(tuple(numbers_packed(x.astype(np.int64)) for x in arrays))
            yield pa.RecordBatch.from_arrays([pa.array(block[at[:-1]]), *(pa.array(c, pa.binary()) for c in zip(*out))], ["block", *WORDS])

    sorted_ = filled.select("block", "number", "ids").sortWithinPartitions("block")
    return sorted_.mapInArrow(pack, "block long" + "".join(f", {c} binary" for c in WORDS))


def _joined(filled: DataFrame, pieces: DataFrame, coded: DataFrame) -> DataFrame:
    """Ids by position: within each block, the numbers of each document's words lead to ids, these to pieces; digests of both."""

    class Words:
        """Ids of a block's words, and its pieces, each followed by a space."""

        def __init__(self, parts: list[tuple[bytes, ...]], named: list[dict]):
            number, self.n, self.ids = (np.concatenate([*(numbers_unpacked(p[k]) for p in parts), np.zeros(0, np.int64)]) for k in range(3))
            at, by = np.cumsum(self.n) - self.n, np.argsort(number)
            self.n, self.at, self.ids = self.n[by], at[by], self.ids.astype("<u4")
            text = {x["id"]: x["piece"].encode() + b" " for x in named}
            self.size = np.zeros(max(text, default=-1) + 1, np.int64)
            self.size[list(text)] = list(map(len, text.values()))
            self.begin = np.zeros(len(self.size), np.int64)
            self.begin[list(text)] = np.cumsum(self.size[list(text)]) - self.size[list(text)]
            self.raw = np.frombuffer(b"".join(text.values()), np.uint8)

        @staticmethod
        def _gather(flat: np.ndarray, start: np.ndarray, n: np.ndarray) -> np.ndarray:
            ends = np.cumsum(n)
            return flat[np.repeat(start - (ends - n), n) + np.arange(ends[-1] if len(n) else 0)]

        def digests(self, codes: np.ndarray) -> tuple[int, str, str]:
            ids, text, held = hashlib.sha256(), hashlib.sha256(), b""
            for a in range(0, len(codes), STEP):
                c = codes[a : a + STEP]
                own = self._gather(self.ids, self.at[c], self.n[c])
                ids.update(own.tobytes())
                text.update(held)
                held = self._gather(self.raw, self.begin[own], self.size[own]).tobytes()
                text.update(held[:-1])
                held = held[-1:]
            return int(self.n[codes].sum()), ids.hexdigest(), text.hexdigest()  # the last space goes

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        open_, parts, named, words = None, [], [], None
        for batch in batches:
            block, is_doc = batch.column("block").to_numpy(), batch.column("document").to_numpy(zero_copy_only=False)
            change = np.flatnonzero((block[1:] != block[:-1]) | (is_doc[1:] != is_doc[:-1])) + 1
            out: list[tuple] = []
            for a, b in zip([0, *change.tolist()], [*change.tolist(), len(block)]) if len(block) else ():
                if block[a] != open_:
                    open_, parts, named, words = block[a], [], [], None
                part = batch.slice(a, b - a)
                if not is_doc[a]:
                    for *own, pieces_ in zip(*(part.column(c).to_pylist() for c in (*WORDS, "pieces"))):
                        if pieces_ is None:
                            parts.append(tuple(own))
                        else:
                            named += pieces_
                    continue
                words = words or Words(parts, named)
                for doc, codes in zip(part.column("doc_id").to_pylist(), part.column("codes").to_pylist()):
                    x = numbers_unpacked(codes)
                    if len(x) and x.max() >= len(words.n):
                        raise RuntimeError("the documents were not the same when they were read again: cut them into a table first")
                    out.append((doc, *words.digests(x)))
            columns = zip(*out) if out else [[]] * 4
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(columns, (pa.int64(), pa.int64(), pa.string(), pa.string()))], ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"])

    none = lambda t: F.lit(None).cast(t)
    names = ["block", "document", *WORDS, "pieces", "doc_id", "codes"]
    kinds = ["long", "boolean", *["binary"] * 3, "array<struct<id: int, piece: string>>", "long", "binary"]

    def rows(df: DataFrame, document: bool) -> DataFrame:
        own = df.withColumn("document", F.lit(document))
        return own.select([(F.col(c) if c in own.columns else none(t)).alias(c) for c, t in zip(names, kinds)])

    every = rows(packed_words(filled), False).union(rows(block_pieces(filled, pieces), False)).union(rows(coded, True))
    dealt = every.repartition(partitions(filled.sparkSession), "block").sortWithinPartitions("block", "document")
    return dealt.mapInArrow(digest, "doc_id long, n_tokens long, ids_sha256 string, decoded_sha256 string")


def word_bpe_digests(docs: DataFrame, path: str, specials: bool = True) -> DataFrame:
    """Encodes every whole text and decodes it again: n_tokens, ids_sha256, decoded_sha256 for each doc_id.

    Texts are split into words, block by block (BLOCK bytes). The table of all distinct words is encoded, each word once; ids
    go back to the blocks that hold the word, and by the words' positions into the documents. The ids of each block are joined
    with the vocabulary, and its documents are decoded by those pieces. A block is the largest thing that one task holds; a frequent word is one row a block.
    specials: a special token's own string in a text is that token, as the tokenizers library has it by default.
    docs is read twice and has to give the same rows in the same partitions (a stored table does; else cut it first): a block
    that differs is an error, never another result.
    Null or empty text, or white space alone: no ids, digests of the empty string. Null doc_id: a result with null. Repeated
    rows: a result each. Empty table: empty. Other columns: ignored."""
    spark = docs.sparkSession
    with batch_rows(spark, TEXT_ROWS):
        lists = cut(word_lists(docs))
    with batch_rows(spark, NARROW_ROWS):
        words = encoded_words(lists.select("word").distinct(), path, specials)
        filled = cut(lists.join(words, "word").select("block", "number", "ids"))
    discard(lists)
    text_batches(spark)
    return _joined(filled, vocabulary(spark, path), coded_documents(docs))


def op13_distinct_word_bpe(spark: SparkSession, sf_dir: str) -> DataFrame:
    import public_tokenizers

    return word_bpe_digests(table(spark, sf_dir, "documents"), public_tokenizers.path("word_bpe_49k.json"))


QUERIES = {"op13_distinct_word_bpe": op13_distinct_word_bpe}
