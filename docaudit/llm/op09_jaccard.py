"""n-gram Jaccard join with parity sketches."""

from collections.abc import Iterator
from functools import lru_cache
from itertools import count

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW_ROWS, TEXT_ROWS, batch_rows, broadcast_if_small, cut, discard, mix, mix_int, partitions, table
from .components import components
from .words import encoded, ngrams, token_hashes

#: Bits of one chunk of the pigeonhole sketch, and members of one block of a group.
CHUNK, BLOCK = 4096, 4096
#: Doubtful pairs between two components of a task that are verified before the next one is taken for granted; eight times as
#: many in every round after the first, so that few rounds do even where most pairs fail.
RISKY = 64
#: Pairs whose sketches are compared at once.
PAIRS = 16_000
#: Groups with more doubtful pairs than this many times their members are decided on whole sets inside tasks, where each set is
#: sent once to every pair of parts. A part has at most so many members, about, and so many bytes of sets.
DENSE, PART, PART_BYTES = 2, 1024, 8 << 20
#: Shingles of more sets than this are counted by products of matrices of so many cells, others pair by pair.
COMMON, CELLS = 64, 1 << 21
#: The buckets of one hub are compared as one group unless that makes so many times their pairs.
UNION = 8
BAND = 1.4
#: A key's last bits are its size band.
BAND_BITS = 7


@lru_cache(maxsize=1)
def bands() -> list[int]:
    """Lower ends of the size bands."""
    out = [1]
    while out[-1] < 1 << 40:
        out.append(max(out[-1] + 1, int(out[-1] * BAND)))
    return out


def most_different(total: int, num: int, den: int) -> int:
    """The largest symmetric difference of two linked sets whose sizes add up to total: den * I >= num * U."""
    return (den - num) * total // (den + num)


def own_bands(n: int, num: int, den: int) -> range:
    """The size bands that could hold the larger set of a pair with a set of n shingles."""
    low = bands()
    return range(int(np.searchsorted(low, n, side="right")) - 1, int(np.searchsorted(low, n * den // num, side="right")))


def sketch_keys(shingles: np.ndarray, num: int, den: int) -> np.ndarray:
    """Pigeonhole keys of a set of shingle hashes: two linked sets have one in common, at least.

    In every band that could hold the larger set of a pair, shingles toggle bits of a sketch of c chunks. The symmetric
    difference bounds the Hamming distance, so at most d chunks differ for distance d. Of each sketch the chunks with most
    bits are kept, by an order of chunks alone: one more than differ from any partner that a set of this size has in the
    band. The first chunk in that order of those that are equal in a linked pair is thus kept on both sides."""
    n, low = len(shingles), bands()
    out = []
    for b in own_bands(n, num, den):
        d = most_different(2 * (low[b + 1] - 1), num, den)
        own = most_different(n + min(low[b + 1] - 1, n * den // num), num, den)
        c = d + 1 + (d + 1) // 4
        bit = (shingles >> np.uint64(32)) % np.uint64(c) * np.uint64(CHUNK) + shingles % np.uint64(CHUNK)
        bit, times = np.unique(bit, return_counts=True)
        bit = bit[times % 2 == 1]
        chunk = (bit // np.uint64(CHUNK)).astype(np.int64)
        ones = np.bincount(chunk, minlength=c)
        sums = np.concatenate([[np.uint64(0)], np.cumsum(mix(bit + np.uint64(1)))])
        ends = np.cumsum(ones)
        content = mix(sums[ends] - sums[ends - ones] + np.arange(c, dtype=np.uint64))
        kept = np.lexsort((content, -ones))[: own + 1]
        out.append((mix(content[kept] + np.uint64(mix_int(b + 77))) << np.uint64(BAND_BITS)) | np.uint64(b))
    return np.concatenate(out)


def sketch_bits(band: int) -> int:
    """Bits of the sketches that are compared in a size band: more than the sets have shingles."""
    return 1 << max(6, (3 * bands()[band + 1] // 2 - 1).bit_length())


def bit_sketch(shingles: np.ndarray, bits: int) -> bytes:
    """Each shingle toggles one of so many bits. Half the sketch, with the other half toggled in, is the sketch of half the bits."""
    odd = np.bincount((shingles >> np.uint64(20)).astype(np.int64) % bits, minlength=bits) & 1
    return np.packbits(odd.astype(np.uint8)).tobytes()


def folded(sketch: bytes, bits: int) -> np.ndarray:
    x = np.frombuffer(sketch, np.uint64)
    while len(x) * 64 > bits:
        x = x[: len(x) // 2] ^ x[len(x) // 2 :]
    return x


def shingle_sets(texts: list[bytes], k: int):
    for words in token_hashes(texts):
        yield np.unique(ngrams(words, k))


def set_class(s: np.ndarray) -> int:
    """One 63-bit name for a set, equal for equal sets; -1 for the empty set."""
    return mix_int(int(s.sum(dtype=np.uint64)) + mix_int(int(np.bitwise_xor.reduce(s)) + len(s))) >> 1 if len(s) else -1


def _documents(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """doc_id, n_shingles, cls (set class); for the first document of a class in each task also sketch and keys."""

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        seen: set[int] = set()
        for batch in batches:
            n, cls, sketch, keys = [], [], [], []
            for s in shingle_sets(encoded(batch.column("text")), k):
                c = set_class(s)
                first = len(s) > 0 and c not in seen
                seen.add(c)
                n.append(len(s))
                cls.append(c)
                sketch.append(bit_sketch(s, sketch_bits(own_bands(len(s), num, den)[-1])) if first else None)
                keys.append(sketch_keys(s, num, den).view(np.int64) if first else None)
            yield pa.RecordBatch.from_arrays([batch.column("doc_id"), pa.array(n, pa.int64()), pa.array(cls, pa.int64()), pa.array(sketch, pa.binary()), pa.array(keys, pa.list_(pa.int64()))], ["doc_id", "n_shingles", "cls", "sketch", "keys"])

    return docs.select("doc_id", "text").mapInArrow(scan, "doc_id long, n_shingles long, cls long, sketch binary, keys array<long>")


def _shared(keys: DataFrame) -> DataFrame:
    """Of the keys that two classes or more have: rows (key, cls, hub), hub being the key's smallest class, and for each key
    one row (key, hub, n, x, y) with null cls: how many classes, and two hashes of which. Sorted partitions are streamed; no
    key's rows are gathered."""

    def runs(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        # the bucket that is still open: key, hub, members so far, hashes; and the last class seen
        key0 = hub0 = last = None
        n0, x0, y0 = 0, np.uint64(0), np.uint64(0)

        def rows(members, closed) -> pa.RecordBatch:
            key, cls, hub = [np.concatenate(x) for x in zip(*members)] or [np.zeros(0, np.int64)] * 3
            member = np.arange(len(key) + len(closed[0])) < len(key)
            left = lambda v: pa.array(np.concatenate([v, np.zeros(len(closed[0]), np.int64)]), mask=~member)
            right = lambda v: pa.array(np.concatenate([np.zeros(len(key), np.int64), v]), mask=member)
            whole = lambda u, v: pa.array(np.concatenate([u, v]))
            return pa.RecordBatch.from_arrays([whole(key, closed[0]), left(cls), whole(hub, closed[1]), *map(right, closed[2:])], ["key", "cls", "hub", "n", "x", "y"])

        for batch in batches:
            key, cls = batch.column("key").to_numpy(), batch.column("cls").to_numpy()
            new = np.ones(len(key), bool)
            new[1:] = (key[1:] != key[:-1]) | (cls[1:] != cls[:-1])
            if len(key) and key0 is not None:
                new[0] = key[0] != key0 or cls[0] != last
            key, cls = key[new], cls[new]
            if not len(key):
                continue
            first = np.append(True, key[1:] != key[:-1])
            at = np.flatnonzero(first)
            n = np.diff(np.append(at, len(key)))
            hub, bucket = cls[at].copy(), np.cumsum(first) - 1
            u = cls.view(np.uint64)
            x = np.add.reduceat(mix(u + np.uint64(1)), at)
            y = np.bitwise_xor.reduceat(mix(u + np.uint64(2)), at)
            members = []
            if key[0] == key0:
                if n0 == 1:
                    members.append((key[:1], np.array([hub0]), np.array([hub0])))
                hub[0], n[0], x[:1], y[:1] = hub0, n[0] + n0, x[:1] + x0, y[:1] ^ y0
                done = [np.zeros(0, np.int64)] * 5
            else:
                done = [np.array([v]) for v in (key0, hub0, n0, x0.view(np.int64), y0.view(np.int64))] if n0 > 1 else [np.zeros(0, np.int64)] * 5
            out = n[bucket] > 1
            members.append((key[out], cls[out], hub[bucket][out]))
            full = np.flatnonzero(n[:-1] > 1)  # the last bucket stays open
            closed = [np.concatenate([d, v]) for d, v in zip(done, (key[at][full], hub[full], n[full], x[full].view(np.int64), y[full].view(np.int64)))]
            key0, hub0, last, n0, x0, y0 = key[-1], hub[-1], cls[-1], int(n[-1]), x[-1], y[-1]
            yield rows(members, closed)
        if n0 > 1:
            yield rows([], [np.array([v]) for v in (key0, hub0, n0, x0.view(np.int64), y0.view(np.int64))])

    dealt = keys.repartition(partitions(keys.sparkSession), "key").sortWithinPartitions("key", "cls")
    return dealt.mapInArrow(runs, "key long, cls long, hub long, n long, x long, y long")


def _groups(shared: DataFrame) -> DataFrame:
    """(grp, size, band, cls): classes to compare with each other, all pairs of classes that share a key among them.

    Buckets of the same members count once. Buckets of one hub and band mostly overlap; they are one group, where each class
    stands once, unless that would make many more pairs than they have (UNION)."""
    band = F.col("key").bitwiseAND(F.lit((1 << BAND_BITS) - 1)).cast("int")
    buckets = shared.where("cls is null").groupBy("hub", "n", "x", "y").agg(F.min("key").alias("key"))
    buckets = cut(buckets.select("hub", "n", "key", band.alias("band")), narrow=True)
    spokes = cut(shared.where("cls is not null").select("hub", band.alias("band"), "cls").distinct(), narrow=True)
    pairs = buckets.groupBy("hub", "band").agg(F.sum(F.col("n") * F.col("n")).alias("pairs"))
    hubs = spokes.groupBy("hub", "band").agg(F.count("*").alias("size")).join(pairs, ["hub", "band"])
    hubs = cut(hubs.select("hub", "band", "size", (F.col("size") * F.col("size") <= UNION * F.col("pairs")).alias("whole")), narrow=True)
    whole = spokes.join(broadcast_if_small(hubs.where("whole").select("hub", "band", "size")), ["hub", "band"]).select(F.col("hub").alias("grp"), "size", "band", "cls")
    apart = buckets.join(broadcast_if_small(hubs.where("not whole").select("hub", "band")), ["hub", "band"], "left_semi")
    apart = cut(apart.select("key", F.col("n").alias("size"), "band"), narrow=True)
    single = shared.where("cls is not null").select("key", "cls").join(broadcast_if_small(apart), "key").select(F.col("key").alias("grp"), "size", "band", "cls")
    out = cut(whole.union(single), narrow=True)
    discard(buckets, spokes, hubs, apart)
    return out


def _grouped(batches: Iterator[pd.DataFrame], by: list[str]) -> Iterator[pd.DataFrame]:
    """Batches of a sorted partition, cut so that no group is split."""
    rest = None
    for batch in batches:
        batch = batch if rest is None else pd.concat([rest, batch], ignore_index=True)
        if batch.empty:
            continue
        new = (batch[by] != batch[by].shift()).any(axis=1).to_numpy()
        at = int(np.flatnonzero(new)[-1])
        rest = batch.iloc[at:]
        if at:
            yield batch.iloc[:at].reset_index(drop=True)
    if rest is not None:
        yield rest.reset_index(drop=True)


#: What a task compares: one pair of blocks of one group.
PLACE = ["grp", "size", "band", "lo", "hi"]


def _forest(members: DataFrame, num: int, den: int, turn: int) -> DataFrame:
    """Edges to verify (PLACE, a, b, assumed): within each pair of blocks, pairs that the sizes and the sketches allow, that
    lie in different components so far and did not fail before (rows with a partner).

    Of the pairs whose sketches leave no doubt (in the first round, turn 0, there are such), a spanning forest for the task:
    others are left out because these edges are assumed to hold. Of the doubtful ones, up to RISKY (and more in later rounds)
    between two components of that forest leave without any assumption, and one more that is assumed. Groups with many doubtful
    pairs (DENSE) send none of them, but rows of their members (b is -1): see _decided."""
    tries = RISKY << min(3 * turn, 40)

    def close(i: np.ndarray, j: np.ndarray, sketch: np.ndarray, n: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Pairs that may link, and whether their difference, as the sketch lets one estimate it, is well within the bound."""
        bits = sketch.shape[1] * 64
        far = np.bitwise_count(sketch[i] ^ sketch[j]).sum(axis=-1, dtype=np.int64)
        most = (den - num) * (n[i] + n[j]) // (den + num)
        may = (far <= most) & (np.minimum(n[i], n[j]) * den >= np.maximum(n[i], n[j]) * num)
        estimate = -bits / 2 * np.log(np.maximum(1 - 2 * far / bits, 1e-3))
        return may, (turn == 0) & (estimate <= 0.85 * most)

    def edges(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        root: dict[int, int] = {}
        tried: dict[tuple[int, int], int] = {}

        def find(x: int) -> int:
            while root.get(x, x) != x:
                root[x] = root.get(root[x], root[x])
                x = root[x]
            return x

        def compared(batch: pd.DataFrame, bad: set[tuple[int, int]]) -> list[tuple[int, int, int, bool]]:
            """Of groups of one band: row of one end, both ends, assumed."""
            bits = sketch_bits(int(batch["band"].iloc[0]))
            sketch = np.stack([folded(x, bits) for x in batch["sketch"]])
            n, comp, cls, block = (batch[c].to_numpy(np.int64) for c in ("n_shingles", "comp", "cls", "block"))
            crossing = (batch["lo"] != batch["hi"]).to_numpy()
            new = (batch[PLACE] != batch[PLACE].shift()).any(axis=1).to_numpy()
            starts = np.append(np.flatnonzero(new), len(batch))
            sizes, out = np.diff(starts), []
            place, waiting, dense, involved = np.cumsum(new) - 1, np.zeros(len(sizes), np.int64), np.zeros(len(sizes), bool), np.zeros(len(batch), bool)
            doubtful: list[tuple[np.ndarray, np.ndarray]] = []

            def take(i: np.ndarray, j: np.ndarray) -> None:
                ok = (comp[i] != comp[j]) & (~crossing[i] | (block[i] != block[j]))
                i, j = i[ok], j[ok]
                ok, safe = close(i, j, sketch, n)
                i, j, safe = i[ok], j[ok], safe[ok]
                for row, x, y, cx, cy in zip(i[safe].tolist(), cls[i[safe]].tolist(), cls[j[safe]].tolist(), comp[i[safe]].tolist(), comp[j[safe]].tolist()):
                    if (x, y) not in bad and (y, x) not in bad and (rx := find(cx)) != (ry := find(cy)):
                        root[max(rx, ry)] = min(rx, ry)
                        out.append((row, x, y, True))
                i, j = i[~safe], j[~safe]
                open_ = [(x, y) not in bad and (y, x) not in bad and find(cx) != find(cy) for x, y, cx, cy in zip(cls[i].tolist(), cls[j].tolist(), comp[i].tolist(), comp[j].tolist())]
                i, j = i[np.array(open_, bool)], j[np.array(open_, bool)]
                involved[i] = involved[j] = True
                np.add.at(waiting, place[i], 1)
                dense[waiting > DENSE * sizes] = True
                few = ~dense[place[i]]
                doubtful.append((i[few], j[few]))

            for size in np.unique(sizes[(sizes > 1) & (sizes <= 32)]):
                start = starts[:-1][sizes == size]
                u, v = np.triu_indices(size, 1)
                for p in range(0, len(start), max(1, PAIRS // len(u))):
                    f = start[p : p + max(1, PAIRS // len(u))]
                    take((f[:, None] + u).ravel(), (f[:, None] + v).ravel())
            for s, size in zip(starts[:-1][sizes > 32], sizes[sizes > 32]):
                all_ = np.arange(s, s + size)
                step, at = max(1, PAIRS // size), -1
                for i in range(0, size, step):
                    if at != len(out):  # members joined by now need no look
                        at, roots = len(out), np.array([find(c) for c in comp[s : s + size].tolist()])
                        if (roots == roots[0]).all():
                            break
                    u, v = np.nonzero(np.triu(roots[i : i + step, None] != roots[None, :], i + 1))
                    take(all_[i + u], all_[v])
            for i, j in doubtful:
                few = ~dense[place[i]]
                i, j = i[few], j[few]
                for row, x, y, cx, cy in zip(i.tolist(), cls[i].tolist(), cls[j].tolist(), comp[i].tolist(), comp[j].tolist()):
                    if (rx := find(cx)) != (ry := find(cy)):
                        between = (min(rx, ry), max(rx, ry))
                        tried[between] = tried.get(between, 0) + 1
                        if tried[between] > tries:
                            root[between[1]] = between[0]
                        out.append((row, x, y, tried[between] > tries))
            return out + [(row, int(cls[row]), -1, False) for row in np.flatnonzero(involved & dense[place]).tolist()]

        for batch in _grouped(batches, PLACE):
            failed = batch["partner"] >= 0
            bad = set(zip(batch["cls"][failed].tolist(), batch["partner"][failed].tolist()))
            for _, rows in batch[~failed].groupby("band", sort=False):
                rows = rows.reset_index(drop=True)
                found = compared(rows, bad)
                if found:
                    at, x, y, z = zip(*found)
                    yield rows.iloc[list(at)][PLACE].assign(a=np.array(x, np.int64), b=np.array(y, np.int64), assumed=np.array(z, bool))

    return members.mapInPandas(edges, "grp long, size long, band int, lo int, hi int, a long, b long, assumed boolean")


def jaccard_classes(docs: DataFrame, k: int = 4, num: int = 85, den: int = 100) -> DataFrame:
    """(doc_id, n_shingles, component_id) for each row of docs: documents link when the sets of their k-word shingles have
    den * intersection >= num * union; component_id is the smallest doc_id that links reach.

    Equal sets are one class. Classes that share a pigeonhole key in a size band meet in a bucket; buckets with the same
    members count once, and those of one smallest class are compared as one group. A group is compared in blocks of BLOCK
    members, by size and bit sketch, inside tasks; a spanning forest of the pairs that surely pass leaves a task, and a few of the
    doubtful ones a member, and each of these edges is verified on the whole sets. Where a group has more doubtful pairs, as
    families of one template near the threshold do, its members' sets meet in tasks, which decide all its pairs exactly. Where an edge that was assumed to hold fails, the next round looks again at the
    classes that such edges may have kept apart, without the pairs that failed; so every link between different texts counts.
    Words are split at ASCII white space and A-Z is lower-cased. Fewer than k words: the whole sequence is one shingle.
    Null text or no words: the empty set, linked with nothing. Rows with one doc_id: each has its own set; its component
    is that of its set. Null doc_id: not considered as smallest. Empty table: empty. Other columns: ignored."""
    with batch_rows(docs.sparkSession, NARROW_ROWS):
        return _classes(docs, k, num, den)


def _classes(docs: DataFrame, k: int, num: int, den: int) -> DataFrame:
    spark = docs.sparkSession
    with batch_rows(spark, TEXT_ROWS):
        full = cut(_documents(docs, k, num, den))
    shared = cut(_shared(full.where(F.col("keys").isNotNull()).select("cls", F.explode("keys").alias("key"))))
    rows = cut(full.select("doc_id", "n_shingles", "cls"), narrow=True)
    info = full.where("sketch is not null").groupBy("cls").agg(F.first("n_shingles").alias("n_shingles"), F.first("sketch").alias("sketch"), F.min("doc_id").alias("doc_id"))
    info = cut(info, narrow=True)
    discard(full)
    members = _groups(shared)
    discard(shared)
    links = failed = comp = suspects = None
    for turn in count():
        if comp is None:
            now = members.withColumn("comp", F.col("cls"))
        else:
            roots = comp.select(F.col("node").alias("cls"), "root").join(broadcast_if_small(suspects), "root", "left_semi")
            now = cut(members.join(roots, "cls").withColumnRenamed("root", "comp"), narrow=True)
            # nothing is left to find in a group whose members are all in one component
            apart = now.groupBy("grp", "size").agg(F.min("comp").alias("x"), F.max("comp").alias("y")).where("x <> y").select("grp", "size")
            now = now.join(apart, ["grp", "size"], "left_semi")
        now = now.join(info.select("cls", "n_shingles", "sketch"), "cls")
        blocks = F.expr(f"cast((size + {BLOCK - 1}) div {BLOCK} as int)")
        now = now.withColumn("block", F.pmod(F.xxhash64("cls"), blocks).cast("int")).withColumn("other", F.explode(F.sequence(F.lit(0), blocks - 1)))
        now = now.select("grp", "size", "band", F.least("block", "other").alias("lo"), F.greatest("block", "other").alias("hi"), "block", "cls", "comp", "n_shingles", "sketch", F.lit(-1).cast("long").alias("partner"))
        if failed is not None:
            none = {"block": F.lit(0), "comp": F.lit(0).cast("long"), "n_shingles": F.lit(0).cast("long"), "sketch": F.lit(b"")}  # no nulls: pandas would make longs of doubles
            now = now.unionByName(failed.withColumns(none))
        now = now.repartition(partitions(spark), *PLACE).sortWithinPartitions(*PLACE, "cls")
        edges = cut(_forest(now, num, den, turn), narrow=True)
        if comp is not None and not edges.limit(1).count():
            break
        dense, edges = edges.where("b < 0"), edges.where("b >= 0")
        with batch_rows(spark, TEXT_ROWS):
            checked = cut(_verified(docs, info, edges.select("a", "b").distinct(), k, num, den), narrow=True)
            if dense.limit(1).count():
                decided = cut(_decided(docs, info, dense, k, num, den), narrow=True)
                links = decided if links is None else links.union(decided)
        good, wrong = checked.where("linked").select("a", "b"), broadcast_if_small(checked.where("not linked").select("a", "b"))
        links = good if links is None else links.union(good)
        again = edges.join(wrong, ["a", "b"])
        again_rows = again.select(*PLACE, F.col("a").alias("cls"), F.col("b").alias("partner"))
        failed = again_rows if failed is None else failed.union(again_rows)
        comp = cut(components(links), narrow=True)
        # a pair that was left out because of an edge that failed has both ends in components where such edges end
        ends = again.where("assumed").select(F.explode(F.array("a", "b")).alias("node")).distinct()
        suspects = cut(ends.join(comp, "node", "left").select(F.coalesce("root", "node").alias("root")).distinct(), narrow=True)
        if not suspects.limit(1).count():
            break
        comp = cut(comp.union(ends.join(comp, "node", "left_anti").select("node", F.col("node").alias("root"))), narrow=True)
    smallest = rows.where("cls >= 0").groupBy("cls").agg(F.min("doc_id").alias("smallest"))
    smallest = cut(smallest.join(comp.withColumnRenamed("node", "cls"), "cls", "left").withColumn("root", F.coalesce("root", "cls")), narrow=True)
    joined = comp.select("root").distinct().join(smallest, "root").groupBy("root").agg(F.min("smallest").alias("component"))
    named = cut(smallest.join(joined, "root", "left").select("cls", F.coalesce("component", "smallest").alias("component_id")), narrow=True)
    discard(smallest, members, info)
    out = rows.where("cls >= 0").select("doc_id", "n_shingles", "cls").join(named, "cls").select("doc_id", "n_shingles", "component_id")
    return out.union(rows.where("cls < 0").select("doc_id", "n_shingles", F.col("doc_id").alias("component_id")))


def _whole_sets(docs: DataFrame, info: DataFrame, classes: DataFrame, k: int) -> DataFrame:
    """(cls, shingles) of the classes; only texts of theirs are read again."""
    ends = cut(classes.join(info, "cls").select("cls", "doc_id"), narrow=True)
    wanted = broadcast_if_small(ends.select(F.col("doc_id").alias("_wanted")).distinct())

    def sets(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            found = list(shingle_sets(encoded(batch.column("text")), k))
            yield pa.RecordBatch.from_arrays([pa.array([set_class(s) for s in found], pa.int64()), pa.array([s.tobytes() for s in found], pa.large_binary()).cast(pa.binary())], ["cls", "shingles"])

    texts = docs.select("doc_id", "text").join(wanted, F.col("doc_id").eqNullSafe(F.col("_wanted")), "left_semi")
    return cut(texts.mapInArrow(sets, "cls long, shingles binary").join(broadcast_if_small(ends.select("cls")), "cls", "left_semi").dropDuplicates(["cls"]), narrow=True)


def shared_counts(sets: list[np.ndarray]) -> np.ndarray:
    """How many shingles each two sets share (a square matrix; the diagonal means nothing)."""
    m = len(sets)
    _, at, times = np.unique(np.concatenate(sets), return_inverse=True, return_counts=True)
    order = np.argsort(at, kind="stable")
    owner, often = np.repeat(np.arange(m), [len(s) for s in sets])[order], times[at[order]]
    both = np.zeros(m * m)
    for t in np.unique(times[(times > 1) & (times <= COMMON)]):
        sharing = owner[often == t].reshape(-1, t)
        u, v = np.triu_indices(t, 1)
        step = max(1, CELLS // len(u))
        for i in range(0, len(sharing), step):
            pairs = (sharing[i : i + step, u] * m + sharing[i : i + step, v]).ravel()
            some, n = np.unique(pairs, return_counts=True)
            both[some] += n
    both = both.reshape(m, m)
    both += both.T
    ends = np.cumsum(times[times > COMMON])
    owner, width = owner[often > COMMON], max(1, CELLS // m)
    column = np.repeat(np.arange(len(ends)), np.diff(ends, prepend=0))
    for start in range(0, len(ends), width):
        lo, hi = np.searchsorted(column, [start, start + width])
        x = np.zeros((m, min(width, len(ends) - start)), np.float32)
        x[owner[lo:hi], column[lo:hi] - start] = 1
        both += x @ x.T
    return both


def exact_forest(sets: list[np.ndarray], num: int, den: int) -> list[tuple[int, int]]:
    """A spanning forest of the links between sets, as pairs of their places in the list."""
    if len(sets) < 2:
        return []
    n, both = np.array([len(s) for s in sets]), shared_counts(sets)
    linked = den * both >= num * (n[:, None] + n[None, :] - both)
    seen, out = np.zeros(len(sets), bool), []
    for first in range(len(sets)):
        if seen[first]:
            continue
        seen[first], todo = True, [first]
        while todo:
            i = todo.pop()
            near = np.flatnonzero(linked[i] & ~seen).tolist()
            seen[near] = True
            todo += near
            out += [(i, j) for j in near]
    return out


def _decided(docs: DataFrame, info: DataFrame, dense: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b): links that span what the members of each place are linked to, decided on whole sets. The members are dealt to parts
    by hash, as many as PART and PART_BYTES ask for, and each two parts meet in a task."""
    rows = cut(dense.select(*PLACE, F.col("a").alias("cls")).distinct().join(info.select("cls", "n_shingles"), "cls"), narrow=True)
    parts = F.greatest(F.ceil(F.sum("n_shingles") * 8 / PART_BYTES), F.ceil(F.count("*") / PART)).cast("int")
    dealt = rows.join(rows.groupBy(*PLACE).agg(parts.alias("parts")), PLACE).withColumn("part", F.pmod(F.xxhash64("cls", F.lit(1)), F.col("parts")).cast("int"))
    dealt = dealt.withColumn("other", F.explode(F.sequence(F.lit(0), F.col("parts") - 1)))
    by = [*PLACE, "u", "v"]
    dealt = dealt.select(*PLACE, F.least("part", "other").alias("u"), F.greatest("part", "other").alias("v"), "cls")
    met = dealt.join(_whole_sets(docs, info, rows.select("cls").distinct(), k), "cls")
    met = met.repartition(partitions(docs.sparkSession), *by).sortWithinPartitions(*by, "cls")

    def decide(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        def links(cls: list[int], sets: list[bytes]) -> pa.RecordBatch:
            found = exact_forest([np.frombuffer(x, np.uint64) for x in sets], num, den)
            return pa.RecordBatch.from_arrays([pa.array([cls[e[side]] for e in found], pa.int64()) for side in (0, 1)], ["a", "b"])

        here, cls, sets = None, [], []
        for batch in batches:
            for row in zip(*[batch.column(c).to_pylist() for c in [*by, "cls", "shingles"]]):
                if row[: len(by)] != here:
                    if cls:
                        yield links(cls, sets)
                    here, cls, sets = row[: len(by)], [], []
                cls.append(row[-2])
                sets.append(row[-1])
        if cls:
            yield links(cls, sets)

    return met.select(*by, "cls", "shingles").mapInArrow(decide, "a long, b long").distinct()


def _verified(docs: DataFrame, info: DataFrame, edges: DataFrame, k: int, num: int, den: int) -> DataFrame:
    """(a, b, linked), by the whole shingle sets of both classes; only texts that an edge needs are read again."""
    whole = _whole_sets(docs, info, edges.select(F.col("a").alias("cls")).union(edges.select("b")).distinct(), k)
    pairs = edges.join(whole.select(F.col("cls").alias("a"), F.col("shingles").alias("x")), "a").join(whole.select(F.col("cls").alias("b"), F.col("shingles").alias("y")), "b")

    def verify(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            ok = []
            for x, y in zip(batch.column("x").to_pylist(), batch.column("y").to_pylist()):
                x, y = np.frombuffer(x, np.uint64), np.frombuffer(y, np.uint64)
                both = len(np.intersect1d(x, y, assume_unique=True))
                ok.append(den * both >= num * (len(x) + len(y) - both))
            yield pa.RecordBatch.from_arrays([batch.column("a"), batch.column("b"), pa.array(ok, pa.bool_())], ["a", "b", "linked"])

    return pairs.select("a", "b", "x", "y").mapInArrow(verify, "a long, b long, linked boolean")


def op9_parity_sketch_join(spark: SparkSession, sf_dir: str) -> DataFrame:
    return jaccard_classes(table(spark, sf_dir, "documents"))


QUERIES = {"op9_parity_sketch_join": op9_parity_sketch_join}
#: All pairs that share a shingle, and all that each document reaches: brute force, for small tables.
ORACLES = {
    "op9_parity_sketch_join": r"""
WITH RECURSIVE w AS (SELECT doc_id, list_filter(string_split_regex(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda x: x <> '') AS ws FROM documents),
s AS (SELECT doc_id, CASE WHEN len(ws) = 0 THEN [] WHEN len(ws) < 4 THEN [array_to_string(ws, ' ')] ELSE list_distinct(list_transform(range(1, len(ws) - 2), lambda i: array_to_string(ws[i:i + 3], ' '))) END AS sh FROM w),
e AS MATERIALIZED (SELECT doc_id, len(sh) AS n, unnest(sh) AS x FROM s),
p AS (SELECT a.doc_id AS a, b.doc_id AS b, any_value(a.n) + any_value(b.n) AS n, count(*) AS i FROM e a JOIN e b ON a.x = b.x AND a.doc_id < b.doc_id GROUP BY 1, 2),
l AS MATERIALIZED (SELECT a, b FROM p WHERE 100 * i >= 85 * (n - i)), k AS MATERIALIZED (SELECT a, b FROM l UNION ALL SELECT b, a FROM l),
r AS (SELECT doc_id, doc_id AS root FROM documents UNION SELECT k.b, r.root FROM r JOIN k ON r.doc_id = k.a)
SELECT s.doc_id, len(sh)::BIGINT AS n_shingles, min(root) AS component_id FROM s JOIN r ON r.doc_id = s.doc_id GROUP BY 1, 2"""
}
