"""Operators 11 to 13 against brute force and their SQL, with nulls, empty tables, ties, repeated rows and clashing names."""

import hashlib
import itertools
import random
import re

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from docaudit.llm import common, op11_repair, op12_negatives, op13_words  # noqa: E402


def stored(df, folder, name):
    df.coalesce(1).write.parquet(f"{folder}/{name}.parquet")
    con = duckdb.connect()
    con.sql(f"CREATE VIEW {name} AS SELECT * FROM '{folder}/{name}.parquet/*.parquet'")
    return con


def rows_of(df):
    return sorted(map(tuple, df.collect()), key=str)


# --- 11: conversations


def test_rope_order():
    rnd = random.Random(1)
    for _ in range(500):
        texts = []
        for _ in range(2):
            r, s = op11_repair.Rope(), ""
            for _ in range(rnd.randint(0, 12)):
                t = rnd.choice(["D", "K", "KD", "IKR", "K" * 20])
                r, s = (r + op11_repair.Rope(t), s + t) if rnd.random() < 0.7 else (op11_repair.Rope(t) + r, t + s)
            assert str(r) == s and r.n == len(s)
            texts.append((r, s))
        (a, x), (b, y) = texts
        assert (a < b) == (x < y) and (b < a) == (y < x)


def cheapest(symbols):
    """Every sequence of edits with up to two inserts at a place; the least (cost, audit)."""
    best = None
    n = len(symbols)
    for edits in itertools.product("KRD", repeat=n):
        for gaps in itertools.product(range(3), repeat=n + 1):
            state, cost, audit, ok = 0, 0, "", True
            for i in range(n + 1):
                for _ in range(gaps[i]):
                    state, cost, audit = (3 if state == 2 else 2), cost + 2, audit + "I"
                if i == n:
                    break
                s, e = symbols[i], edits[i]
                audit += e
                if e == "D":
                    cost += 3
                    continue
                if s == "D":
                    ok = False
                    break
                initial = s.lower() if e == "K" else ("a" if state == 2 else "u")
                step = op11_repair.STEPS.get(initial, {})
                if state not in step:
                    ok = False
                    break
                state, cost = step[state], cost + (2 if e == "R" else 0) + s.isupper()
            if ok and state in (0, 3) and (best is None or (cost, audit) < best):
                best = (cost, audit)
    return best


@pytest.mark.parametrize("seed", range(3))
def test_transfer_matrices_are_the_cheapest_edits(seed):
    rnd = random.Random(seed)
    for _ in range(25):
        s = "".join(rnd.choice(op11_repair.TERMINALS) for _ in range(rnd.randint(0, 4)))
        rules = ("ua", "su", chr(0x100) + chr(0x100), "DD", "aU")
        m = [[(0, op11_repair.Rope()) if i == j else None for j in range(4)] for i in range(4)]
        for x in op11_repair.compressed(s, rules):
            m = op11_repair.product(m, op11_repair.matrices(rules)[x])
        row = op11_repair.product(m[:1], op11_repair.inserts())[0]
        cost, audit = op11_repair.better(row[0], row[3])
        assert (cost, str(audit)) == cheapest(s)


def conversations(spark, extra=""):
    rnd = random.Random(5)
    texts = ["Hi.", "Hello there", "  ", "", "ok!", "What?", "bye ", "x.\n", None, "a", " é… ", "Yes.  \t", "...", "z" * 300_000 + "."]
    roles = ["user", "assistant", "system", "tool", None, "User", "", "unknown", "agent"]
    pick = lambda: rnd.choice(roles[:3]) if rnd.random() < 0.8 else rnd.choice(roles)
    rows = [(rnd.choice([None, *range(40)]), rnd.choice([None, *range(1, 14)]), pick(), rnd.choice(texts)) for _ in range(600)]
    rows += [(77, i, rnd.choice(roles[:3]), "same." if i % 3 else f"{i}!") for i in range(500)]
    rows += rows[:20]
    return spark.createDataFrame(rows, "conv_id long, turn int, role string, text string").withColumns({"at": F.lit(1), "h": F.lit("x"), "Head": F.lit(2), "symbols": F.lit(3)})


def test_repair_equals_sql(spark, tmp_path, monkeypatch):
    monkeypatch.setattr(op11_repair, "FRAGMENT", 64)
    con = stored(conversations(spark), tmp_path, "conversations")
    got = op11_repair.op11_repair_conversations(spark, str(tmp_path))
    assert got.columns == ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit", "repaired_sha256"]
    assert rows_of(got) == sorted(con.sql(op11_repair.ORACLES["op11_repair_conversations"]).fetchall(), key=str)


def test_repair_of_nothing(spark):
    table = conversations(spark).withColumn("dropped", F.lit(True))
    assert op11_repair.repair(table.where("1 = 0")).collect() == []
    got = op11_repair.repair(table.where("conv_id < 3")).collect()
    assert {r.conv_id for r in got} == {0, 1, 2}
    assert {tuple(r)[1:] for r in got} == {(0, 0, 0, 0, 0, 0, "", hashlib.sha256(b"").hexdigest())}


def test_repaired_roles_are_legal(spark):
    table = op11_repair.damaged(conversations(spark).drop("at", "h", "Head", "symbols"))
    roles = {}
    for r in table.where("not dropped").select("conv_id", "turn", F.coalesce("role", F.lit(" ")).alias("role"), F.expr("unhex(sha2(concat(octet_length(role), ':', role, text), 256))").alias("h")).orderBy("conv_id", "turn", "h").collect():
        roles.setdefault(r.conv_id, []).append(r.role)
    for r in op11_repair.repair(table).collect():
        own, out, edits = iter(roles.get(r.conv_id, [])), "", op11_repair.repaired_rows(r.audit)
        now = next(edits, None)
        while now:
            edit, role = now
            given = next(own) if edit != "I" else None
            out += "" if edit == "D" else (role or given)[:1]
            try:
                now = edits.send((given or "")[:1])
            except StopIteration:
                now = None
        assert re.fullmatch("(s?(ua)+)?", out) and next(own, None) is None


# --- 12: hard negatives


def vectors(spark):
    rnd = random.Random(3)
    odd = [None, [], [float("nan"), 1.0], [1.0, None], [float("inf")] * 3]
    rows = []
    for i in range(500):
        v = rnd.choice(odd) if i % 5 == 0 else [rnd.choice([-1.0, 0.0, 0.5, 1.0, 0.25, 0.3]) for _ in range(37 if i % 4 else 3)]
        rows.append((rnd.choice([None, *range(-300, 900)]) if i % 9 else 100 * rnd.randrange(5), v, rnd.choice([None, 0, 1, 2, 9])))
    rows += [(100, [1.0] * 37, 3)] * 20 + [(101, [1.0] * 37, 2)] * 20 + [(200, [-1.0] * 37, 3)] * 3
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>, label int").withColumns({"row": F.lit(1), "key": F.lit(2), "g": F.lit(3), "V": F.lit(4), "_row": F.lit(0)})


def test_hard_negatives_equal_sql(spark, tmp_path):
    con = stored(vectors(spark), tmp_path, "embeddings")
    got = rows_of(op12_negatives.op12_hard_negatives(spark, str(tmp_path)))
    assert len(got) > 500 and got == sorted(con.sql(op12_negatives.ORACLES["op12_hard_negatives"]).fetchall(), key=str)


def test_hard_negatives_of_an_empty_table(spark):
    none = vectors(spark).where("1 = 0")
    assert op12_negatives.hard_negatives(none, none).collect() == []


@pytest.mark.parametrize("dim", [1, 7, 64, 130])
def test_summaries_bound_every_product(dim):
    rnd = np.random.default_rng(dim)
    m = rnd.integers(-300, 300, (50, dim))
    exact = m @ m.T
    width = None
    for k in op12_negatives.levels(dim):
        mean, dev = op12_negatives.summaries(m, k)
        middle, reach = mean @ mean.T, dev @ dev.T + 1e-6
        assert (middle - reach <= exact).all() and (exact <= middle + reach).all()
        assert width is None or reach.sum() <= width + 1e-3  # finer levels never bound worse in sum
        width = reach.sum()


def test_bounds_spare_exact_scores(spark, monkeypatch):
    """Of clustered vectors, most are ruled out by their summaries."""
    rnd = np.random.default_rng(0)
    # segments that differ in their means tell clusters apart
    centers = np.repeat(rnd.normal(size=(20, 4)), 16, axis=1)
    m = np.floor(256 * (centers[rnd.integers(0, 20, 4000)] + 0.05 * rnd.normal(size=(4000, 64)))).astype(np.int64)

    class Row:
        dim = 64

    for side in "qc":
        setattr(Row, f"{side}_n", 4000)
        setattr(Row, f"{side}_m", m.tobytes())
        setattr(Row, f"{side}_s", b"".join(x.tobytes() for k in op12_negatives.levels(64) for x in op12_negatives.summaries(m, k)))
    q, c = op12_negatives.Side(Row, "q", []), op12_negatives.Side(Row, "c", [])
    scored = 0
    for i in range(0, 4000, 100):
        at, s = op12_negatives.exact_after_bounds(q, i, c, np.arange(4000), lambda low, high: high >= op12_negatives._kth(low, 5), 20)
        scored += len(at)
        full = np.sort(m @ m[i])[::-1][:5]
        assert (np.sort(s)[::-1][:5] == full).all()
    assert scored < 40 * 4000 / 4


# --- 13: words


def brute_tokens(texts):
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(P.path("word_bpe_49k.json"))
    for t in texts:
        ids = tok.encode(t or "", add_special_tokens=False).ids
        yield len(ids), hashlib.sha256(np.array(ids, "<u4").tobytes()).hexdigest(), hashlib.sha256(tok.decode(ids, skip_special_tokens=False).encode()).hexdigest()


def test_word_bpe_equals_the_library(spark, monkeypatch):
    monkeypatch.setattr(op13_words, "BLOCK", 1 << 14)
    rnd = random.Random(1)
    parts = ["a", "B", "'s", "'", "'T", "<|endoftext|>", "<|", "|>", "é", "é", "́", ".", ",", "!?", "1", "23", " ", "  ", "\n", "\t", " ", "　", "日本", "Σ", "ΣΑΣ", "İ", "ß", "-", "_", "don't", "’s", "\x00", "\x1c", "😀", "re", "'re", "</w>", "w>", "½", "²", "\x85", "ﬁ", "Å"]
    texts = ["".join(rnd.choice(parts) for _ in range(rnd.randint(0, 25))) for _ in range(1500)]
    texts += [None, "", " ", "same text, twice", "same text, twice", " ".join(f"w{i}" for i in range(120_000)), "x" * 50_000]
    df = spark.createDataFrame([(i if i != 3 else None, t) for i, t in enumerate(texts)], "doc_id long, text string").withColumns({"block": F.lit(1), "Number": F.lit(1), "part": F.lit(1), "word": F.lit("w"), "codes": F.lit(1)})
    got = op13_words.word_bpe_digests(common.cut(df.repartition(3)), P.path("word_bpe_49k.json"))
    assert got.columns == ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
    want = [(i if i != 3 else None, *x) for i, x in enumerate(brute_tokens(texts))]
    assert rows_of(got) == sorted(want, key=str)


def test_word_bpe_of_an_empty_table(spark):
    none = common.cut(spark.createDataFrame([], "doc_id long, text string"))
    assert op13_words.word_bpe_digests(none, P.path("word_bpe_49k.json")).collect() == []


def test_numbers_round_trip():
    x = np.array([0, 1, 127, 128, 16383, 16384, (1 << 21) - 1, 1 << 21, 1 << 28, (1 << 31) - 1])
    assert (op13_words.numbers_unpacked(op13_words.numbers_packed(x)) == x).all()
    assert len(op13_words.numbers_unpacked(b"")) == 0


def test_each_distinct_word_is_encoded_once(spark):
    words = spark.createDataFrame([(f"w{i % 50}",) for i in range(1000)], "word string")
    seen = op13_words.encoded_words(words.distinct(), P.path("word_bpe_49k.json"))
    assert seen.count() == 50
    ids = {r.word: r.ids for r in seen.collect()}
    pieces = op13_words.block_pieces(seen.withColumn("block", F.lit(1)), op13_words.vocabulary(spark, P.path("word_bpe_49k.json"))).first().pieces
    assert [dict(map(tuple, pieces))[i] for i in ids["w7"]] == ["w</w>", "7</w>"] and len(pieces) == len({i for x in ids.values() for i in x})
