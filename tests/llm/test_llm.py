"""The training-data operators against brute force, on small fixtures with nulls, empty and repeated rows, ties and clashes."""

import collections
import hashlib
import math
import random
import re
import zlib

import duckdb
import numpy as np
import pytest
from pyspark.sql import functions as F

P = pytest.importorskip("public_tokenizers")
from docaudit.llm import common, components, op01_packing, op02_langid, op03_bpe, op04_sharding, op05_topk, op06_ann, op07_chat, op08_quality, op09_jaccard, op10_lines, pieces  # noqa: E402

DOCS = "doc_id long, text string, lang string, source string, n_chars long"


@pytest.fixture(scope="module")
def texts():
    rnd = random.Random(7)
    words = ["".join(rnd.choice("aeiourstn") for _ in range(rnd.randint(2, 9))) for _ in range(400)]
    make = lambda n: " ".join(rnd.choice(words) for _ in range(n))
    base = [make(rnd.randint(5, 300)) for _ in range(40)]
    near = []
    for b in base[:8]:
        w = b.split(" ")
        for k in range(12):
            v = list(w)
            for _ in range(max(1, len(v) // 70)):
                v[rnd.randrange(len(v))] = rnd.choice(words)
            near.append(" ".join(v))
    shared = "This line of text is shared by many documents."
    lined = [make(20) + "\n" + shared.upper() + "  \n" + make(8) for _ in range(10)]
    odd = [None, "", "   ", "\n\n", "x", "two  spaces and end ", "Straße ÀÉ naïve Ωmega 日本語", "word " * 30, "don't it's we'll", "a\tb\x0bc", "<|endoftext|>  end", make(9000), base[0], base[0], base[3].upper()]
    return base + near + lined + odd


@pytest.fixture(scope="module")
def docs(spark, texts):
    langs = ["en", "de", None]
    return spark.createDataFrame([(i if i != 5 else None, t, langs[i % 3], "s", 1) for i, t in enumerate(texts)], DOCS).cache()


def empty(docs):
    return docs.where("1 = 0")


def test_in_order(spark):
    df = spark.range(50).select((F.col("id") % 7).alias("k"), "id", F.lit(2).alias("s"))
    got = common.in_order(df, ["k", "id"], "s").orderBy("at").collect()
    assert [(r.k, r.id) for r in got] == sorted((i % 7, i) for i in range(50))
    assert [r.at for r in got] == list(range(50)) and [r.before for r in got] == list(range(0, 100, 2))


def test_components(spark):
    rnd = random.Random(3)
    edges = [(rnd.randrange(300), rnd.randrange(300)) for _ in range(220)] + [(i, i + 1) for i in range(400, 460)]
    root = {x: x for e in edges for x in e}

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for a, b in edges:
        a, b = find(a), find(b)
        root[max(a, b)] = min(a, b)
    edges = [e for e in edges if e[0] != e[1]]
    got = {r.node: r.root for r in components.components(spark.createDataFrame(edges, "a long, b long")).collect()}
    assert got == {x: find(x) for e in edges for x in e}


def test_packing(docs, texts):
    from tokenizers import Tokenizer

    path = P.path("word_bpe_49k.json")
    tok = Tokenizer.from_file(path)
    tok.encode_special_tokens = True
    got = op01_packing.pack(docs, path).toPandas()
    want = collections.Counter()
    for t in texts:
        ids = np.array([*tok.encode(t or "", add_special_tokens=False).ids, 1], "<u4")
        for a in range(0, len(ids), 2048):
            want[(a, min(2048, len(ids) - a), zlib.crc32(ids[a : a + 2048].tobytes()), len(ids))] += 1
    assert collections.Counter(got[["start", "length", "ids_crc32", "doc_tokens"]].itertuples(index=False, name=None)) == want
    for _, s in got.sort_values("offset").groupby("sequence_id"):
        assert s["length"].sum() <= 2048 and (s["length"].cumsum() - s["length"] == s["offset"]).all()
    assert got["sequence_id"].nunique() == got["sequence_id"].max() + 1 <= got["length"].sum() / 2048 * 1.2 + 1
    assert op01_packing.pack(empty(docs), path).count() == 0


def test_knapsack_and_patterns():
    sizes, demand = np.array([3, 5, 7]), np.array([40.0, 30.0, 20.0])
    value, counts = op01_packing.knapsack(np.array([3.0, 5.5, 7.2]), sizes, 16)
    assert counts @ sizes <= 16 and value == pytest.approx(counts @ np.array([3.0, 5.5, 7.2])) == pytest.approx(max(3.0 * a + 5.5 * b + 7.2 * c for a in range(6) for b in range(4) for c in range(3) if 3 * a + 5 * b + 7 * c <= 16))
    patterns, x = op01_packing.generate_patterns(sizes, demand, 16)
    assert (patterns @ x >= demand - 1e-6).all() and x.sum() >= demand @ sizes / 16 - 1e-6


def test_language(docs, spark):
    rnd = random.Random(1)
    make = lambda letters: " ".join("".join(rnd.choice(letters) for _ in range(6)) for _ in range(40))
    rows = [(i, make("aeiost" if i % 2 else "uyxzkq"), "a" if i % 2 else "b", "s", 1) for i in range(60)]
    d = spark.createDataFrame(rows, DOCS)
    langs, prototypes = op02_langid.learn(d.where(~op02_langid.held_out()))
    assert langs == ["a", "b"]
    got = op02_langid.predict(d, langs, prototypes).toPandas()
    assert (got["lang_pred"] == got["lang"]).all() and got["score"].between(0, 1).all()
    odd = op02_langid.predict(docs.withColumn("score", F.lit("clash")), langs, prototypes).where("text is null or text in ('', '   ')").collect()
    assert odd and all(r.lang_pred == "und" and r.score == 0 for r in odd)
    assert op02_langid.learn(empty(docs))[0] == [] and op02_langid.predict(empty(docs), [], np.zeros((0, op02_langid.DIM))).count() == 0
    held = {r.doc_id for r in d.where(op02_langid.held_out()).collect()}
    assert held == {i for i in range(60) if zlib.crc32(str(i).encode()) % 4 == 2}


def brute_profile(text):
    """The bundle of a text by the rules, one gram at a time."""
    v, total = op02_langid.letter_vectors().astype(float), np.zeros(op02_langid.DIM)
    letters = [0]
    for ch in text + " ":
        x = int(op02_langid._letters()[ord(ch)])
        if x or letters[-1]:
            letters.append(x)
    for a, b, c in zip(letters, letters[1:], letters[2:]):
        if b:
            total += v[0][a] * v[1][b] * v[2][c]
    return total


def test_language_brute_force(spark, monkeypatch):
    monkeypatch.setattr(op02_langid, "SEGMENT", 64)  # most texts are longer
    rnd = random.Random(2)
    alphabets = {"el": "\u03b1\u03b2\u03b3\u03b4\u03b5\u03b7\u03b9\u03bf\u03c3", "en": "etaoins", "ru": "\u0430\u0431\u0432\u0433\u0435\u0438\u043e\u0441", "uk": "\u0430\u0431\u0456\u0433\u0435\u0457\u043e\u0454"}
    make = lambda a, n: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(2, 7))).capitalize() for _ in range(n))
    rows = [(i, make(alphabets[lang], rnd.randint(3, 80)), lang, "s", 1) for i, lang in enumerate(sorted(alphabets) * 12)]
    rows += [(100, None, "en", "s", 1), (101, "", None, "s", 1), (102, "12 34 !", None, "s", 1), (103, "x" * 300, None, "s", 1), (104, "a, b;  c" * 40, None, "s", 1)]
    langs, prototypes = op02_langid.learn(spark.createDataFrame(rows, DOCS).where("lang is not null").repartition(3))
    assert langs == sorted(alphabets)
    unit = lambda v: v / max(np.linalg.norm(v), 1e-12)
    want = []
    for lang in langs:
        own = [brute_profile(t) for _, t, x, _, _ in rows if x == lang and t]
        grams = [sum(1 for a, b, c in zip(*(lambda z: (z, z[1:], z[2:]))([0, *(int(op02_langid._letters()[ord(ch)]) for ch in t), 0])) if b) for _, t, x, _, _ in rows if x == lang and t]
        want.append(unit(sum(v / n for v, n in zip(own, grams))))
    assert np.allclose(prototypes, want, atol=1e-5)
    got = {r.doc_id: (r.lang_pred, r.score) for r in op02_langid.predict(spark.createDataFrame(rows, DOCS), langs, prototypes).collect()}
    for i, t, _, _, _ in rows:
        v = brute_profile(t or "")
        cos = prototypes @ unit(v)
        assert got[i][0] == (langs[int(cos.argmax())] if v.any() else "und")
        assert abs(got[i][1] - (max(cos.max(), 0) if v.any() else 0)) < 1e-6
    assert sum(got[i][0] == lang for i, _, lang, _, _ in rows[:48]) >= 47


def test_bpe(docs, texts):
    import tiktoken

    path = P.path("byte_bpe_50k.tiktoken")
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op03_bpe.read_ranks(path), special_tokens={})
    want = collections.Counter()
    for t in texts:
        ids = enc.encode_ordinary(t or "")
        want[(len(ids), hashlib.sha256(" ".join(map(str, ids)).encode()).hexdigest(), hashlib.sha256((t or "").encode()).hexdigest())] += 1
    got = op03_bpe.bpe_digests(docs, path, P.PATTERN).toPandas()
    assert collections.Counter(got[["n_tokens", "ids_sha256", "decoded_sha256"]].itertuples(index=False, name=None)) == want
    assert op03_bpe.bpe_digests(empty(docs), path, P.PATTERN).count() == 0
    replay = op03_bpe.MergeReplay(op03_bpe.read_ranks(path))
    words = [w.encode() for w in ["aaaaaaa", "banana", "", "éé", "xyzzyxyzzy", "1234567890"]]
    ids, begin = replay(words)
    assert [ids[a:b].tolist() for a, b in zip(begin, begin[1:])] == [replay.one(w) for w in words]


@pytest.mark.parametrize("segment", [None, 16])
def test_bpe_white_space(segment, monkeypatch):
    import tiktoken

    if segment:  # so small that short texts have several segments
        monkeypatch.setattr(op03_bpe, "SEGMENT", segment)
        monkeypatch.setattr(pieces, "SEGMENT", segment)
    rnd, path = random.Random(11), P.path("byte_bpe_50k.tiktoken")
    chars = [" "] * 8 + ["\xa0"] * 3 + list("\t\n\r\x0b\x0c\x1c\x1f\x85\u1680\u2003\u2028\u202f\u205f\u3000\u200bab\u00e9\u65e51.,!'") + ["don't", "we'll", "\x00"]
    made = ["x \xa0 \xa0 y", "price: \xa0 \xa0 \xa010", " ", "  ", " a", "a ", " \n a"] + ["".join(rnd.choice(chars) for _ in range(rnd.randint(0, 80))) for _ in range(600)]
    enc = tiktoken.Encoding("own", pat_str=P.PATTERN, mergeable_ranks=op03_bpe.read_ranks(path), special_tokens={})
    ours = op03_bpe.Encoder(path, P.PATTERN)
    assert [ids.tolist() for ids in ours([t.encode() for t in made])] == [enc.encode_ordinary(t) for t in made]


def test_shards(docs, texts):
    got = op04_sharding.shard_by_bytes(docs).toPandas()
    assert collections.Counter(zip(got["size"], got["text_crc32"])) == collections.Counter((len((t or "").encode()) + 1, zlib.crc32((t or "").encode())) for t in texts)
    sums, largest = got.groupby("shard")["size"].sum(), got["size"].max()
    assert (abs(sums - got["size"].sum() / 8) <= largest).all()
    assert all(sorted(s["slot"]) == list(range(len(s))) for _, s in got.groupby("shard"))
    order = got.sort_values(["shard", "slot"])["doc_id"].fillna(-1).tolist()
    assert order == sorted(order)
    assert op04_sharding.shard_by_bytes(empty(docs)).count() == 0


@pytest.fixture(scope="module")
def vectors(spark):
    rng = np.random.default_rng(5)
    x = rng.normal(size=(1500, 8))
    x[600:800] = x[600]  # a third of the neighbourhood alike
    rows = [(i, [float(np.float32(c)) for c in v]) for i, v in enumerate(x)]
    rows += [(2000, None), (2001, [None] * 8), (2002, [float("nan")] * 8), (2003, [0.0] * 8), (None, [1.0] * 8), (7, rows[7][1]), (2100, [1.0, 2.0])]
    return spark.createDataFrame(rows, "vec_id long, embedding array<float>"), {i: np.array(v) for i, v in rows[:1500]}


def test_top_k(vectors):
    df, x = vectors
    got = op05_topk.top_k(df, df.where("vec_id % 50 = 0")).toPandas()
    ids, q = np.array([*x, 2003, 7]), np.floor(256 * np.stack([*x.values(), np.zeros(8), x[7]])).astype(np.int64)
    for query, own in got.groupby("query_id"):
        if query == 2100:
            continue
        s = q @ q[list(ids).index(query)]
        want = [(int(ids[i]), int(s[i])) for i in np.lexsort((ids, -s)) if ids[i] != query][:5]
        assert list(own.sort_values("rank")[["vec_id", "score"]].itertuples(index=False, name=None)) == want
    assert len(got) == 5 * 30
    assert op05_topk.top_k(df.where("1 = 0"), df.where("1 = 0")).count() == 0


def test_top_k_large_components(spark, tmp_path):
    rows = [(50, [2e6, 1.0]), (50, [3e6, 0.0]), (50, [2e6, 1.0]), (100, [3e6, -4.5e6]), (1, [-3e6, 1.5e6]), (2, [3.1e6, 3.1e6]), (3, [1e7, 1e7]), (4, [1e30, -1e30]), (5, [0.3, -0.3]), (150, [1.0])]
    df = common.numbered(spark.createDataFrame(rows, "vec_id long, embedding array<double>"))
    got = op05_topk.top_k(df, df.where("vec_id % 50 = 0"), k=4, row="_row").toPandas()
    whole = [(i, [max(min(math.floor(256 * x), 2**63 - 1), -(2**63)) for x in v]) for i, v in rows]
    want = collections.Counter()
    for a, (i, v) in enumerate(whole):
        if i % 50 == 0:
            scores = [(max(min(sum(x * y for x, y in zip(v, w)), 2**63 - 1), -(2**63)), j) for b, (j, w) in enumerate(whole) if b != a and len(w) == len(v)]
            want += collections.Counter((i, r + 1, j, s) for r, (s, j) in enumerate(sorted(scores, key=lambda x: (-x[0], x[1]))[:4]))
    assert collections.Counter(got[["query_id", "rank", "vec_id", "score"]].itertuples(index=False, name=None)) == want
    # the SQL twin, without the vector whose products no long holds
    rows = [r for r in rows if r[0] not in (3, 4)]
    spark.createDataFrame(rows, "vec_id long, embedding array<double>").write.parquet(str(tmp_path / "embeddings.parquet"))
    ours = op05_topk.op5_top_inner_products(spark, str(tmp_path)).toPandas()
    with duckdb.connect() as c:
        c.execute(f"CREATE VIEW embeddings AS SELECT * FROM read_parquet('{tmp_path}/embeddings.parquet/*.parquet')")
        twin = c.execute(op05_topk.ORACLES["op5_top_inner_products"]).df()
    names = ["query_id", "rank", "vec_id", "score"]
    assert collections.Counter(ours[names].itertuples(index=False, name=None)) == collections.Counter(twin[names].itertuples(index=False, name=None))


def test_graph_search(vectors):
    df, x = vectors
    got = op06_ann.nearest(df, df.where("vec_id % 100 = 0")).toPandas()
    ids, m = np.array(list(x)), np.stack(list(x.values()))
    hits = 0
    for query, own in got.groupby("query_id"):
        if query not in x:
            continue
        d = np.sqrt(((m - x[query]) ** 2).sum(axis=1))
        best = [int(ids[i]) for i in np.lexsort((ids, d)) if ids[i] != query][:10]
        own = own.sort_values("rank")
        hits += len(set(best) & set(own["vec_id"]))
        assert np.allclose(own["score"], d[own["vec_id"]], rtol=1e-12) and own["rank"].tolist() == list(range(1, 11))
        if query in (600, 700):
            assert own["vec_id"].tolist() == best
    assert hits / 150 >= 0.9
    assert op06_ann.nearest(df.where("1 = 0"), df.where("1 = 0")).count() == 0


def test_graph_search_shards_and_repeated_ids(spark):
    rng = np.random.default_rng(8)
    rows = [(i, v) for i, v in enumerate(rng.normal(size=(3000, 6)).tolist())] + [(100, [5.0] * 6), (100, [5.0] * 6), (200, [5.1] * 6)]
    df = common.numbered(spark.createDataFrame(rows, "vec_id long, embedding array<double>").withColumn("row", F.lit("clash")).withColumn("dim", F.lit(3)))
    x, ids = np.array([v for _, v in rows]), np.array([i for i, _ in rows])
    want = collections.Counter()
    for a in np.flatnonzero(ids % 100 == 0):
        d = np.sqrt(((x - x[a]) ** 2).sum(axis=1))
        best = [b for b in np.lexsort((ids, d)) if b != a][:10]
        want += collections.Counter((int(ids[a]), int(ids[b]), round(float(d[b]), 9)) for b in best)
    for shard in (400, 2000):
        got = op06_ann.nearest(df, df.where("vec_id % 100 = 0"), shard=shard, row="_row").toPandas()
        have = collections.Counter(zip(got["query_id"].tolist(), got["vec_id"].tolist(), got["score"].round(9).tolist()))
        assert len(got) == 10 * 33 and sum((have & want).values()) / sum(want.values()) >= 0.95
        assert sorted(got[got.query_id == 100]["rank"]) == sorted(list(range(1, 11)) * 3)


def test_quotations(spark):
    rows = [
        (1, 0, "user", "Hello there,\nfriend of mine.\n\nA second thought."),
        (1, 1, "assistant", "> hello   there,\n> friend of MINE.\n\nGood day.\n>> never said"),
        (1, 2, "user", "Fine."),
        (1, 3, "assistant", ">> Hello there, friend of mine.\n> Good day.\nIndeed."),
        (1, 4, None, None),
        (2, 0, "user", "> Good day.\nNo link across conversations."),
        (None, 0, "user", "lost"),
    ]
    got = op07_chat.link_quotes(spark.createDataFrame(rows, "conv_id long, turn long, role string, text string")).toPandas()
    one = got[got.conv_id == 1].sort_values("position")
    assert one["reply_to"].fillna(-1).astype(int).tolist() == [-1, 0, 1, 1, 3]
    assert one["text"].tolist() == [rows[0][3], "Good day.", "Fine.", "Indeed.", ""]
    assert one["n_quotes"].tolist() == [0, 2, 0, 2, 0] and one["n_linked"].tolist() == [0, 1, 0, 2, 0]
    assert one["chat"].tolist()[4] == "<|user|>\n"
    assert got[got.conv_id == 2]["n_linked"].tolist() == [0]
    assert len(got) == 7
    assert op07_chat.link_quotes(spark.createDataFrame([], "conv_id long, turn long, role string, text string")).count() == 0


def brute_quotations(rows):
    """reply_to, n_quotes, n_linked of the messages of one conversation."""
    clean = lambda x: " ".join(x.split()).lower()
    units = lambda own: ([x for x in own if x], [clean(s) for p in re.split(r"\n\n+", "\n".join(own)) for s in re.split(r"(?<=[.!?])\s+", p) if clean(s)])
    parsed = []
    for text in rows:
        own, quotes, before = [], [], None
        for line in text.split("\n"):
            marks = re.match(r"[ \t]*((?:>[ \t]*)*)", line)
            depth, rest = marks[1].count(">"), clean(line[marks.end() :])
            own.append("" if depth else rest)
            if depth and rest:
                if before == depth:
                    quotes[-1][1].append(rest)
                else:
                    quotes.append((depth, [rest]))
            before = depth if rest else None
        parsed.append((units(own), [(d, units(q)) for d, q in quotes]))
    inside = lambda q, o: any(o[i : i + len(q)] == q for i in range(len(o)))
    out = []
    for at, (_, quotes) in enumerate(parsed):
        sources = [(d, [i for i in range(at) if any(inside(q[k], parsed[i][0][k]) for k in (0, 1))]) for d, q in quotes]
        best = max(((-d, s[-1]) for d, s in sources if s), default=(0, at - 1))[1]
        out.append((best, len(quotes), sum(bool(s) for _, s in sources)))
    return out


def test_latest_before(spark):
    rnd = random.Random(9)
    rows = [(rnd.choice([None, 1, 1, 1, 2]), rnd.choice("aaab"), at, rnd.choice([0, 0, 1, 2])) for at in rnd.sample(range(400), 300)]
    d = spark.createDataFrame(rows, "conv_id long, hash string, at long, level int").repartition(4)
    got = {r["at"]: r["source"] for r in op07_chat.latest_before(d, ["conv_id", "hash"]).collect()}
    assert got == {at: max((b for c2, h2, b, v in rows if (c2, h2) == (c, h) and v == 0 and b < at), default=None) for c, h, at, _ in rows}


def test_quotations_of_parts(spark):
    rows = [
        "First line here\nsecond line here\nthird line. Fourth\nsentence ends. Last one!\n\nOther paragraph.",
        "Hm.\nFirst line here\nthird line. Fourth",
        "> second line here\n> third line. Fourth\nSome lines of a paragraph.",
        "> First line here\nAn answer\n> second line here\nin between.\n> third line. Fourth\n> sentence ends. Last one!\nDone.",
        "> Fourth sentence\n> ends. Last one!\nWrapped anew.",
        ">> Fourth sentence ends.\n>> Other paragraph.\n> Wrapped anew.\nNo such row of sentences.",
        "> First line here\n> third line. Fourth\nOf the second message only.",
        "> line here\nNo whole line.",
        "> Last one!\n> Other paragraph.\nOver a blank line.",
        ">\n> \nNothing quoted.",
    ]
    want = brute_quotations(rows)
    assert [w[0] for w in want] == [-1, 0, 0, 1, 0, 4, 1, 6, 0, 8]
    rnd = random.Random(5)
    talk = ["", "yes.", "no", "we go", "on. and on", "Yes. No"]
    long = ["\n".join(rnd.choice(["", "", "> ", ">> "]) + rnd.choice(talk) for _ in range(rnd.randint(1, 7))) for _ in range(120)]
    both = [(None, i, "user", t) for i, t in enumerate(rows)] + [(7, i, "user", t) for i, t in enumerate(long)]
    got = op07_chat.link_quotes(spark.createDataFrame(both, "conv_id long, turn long, role string, text string")).toPandas().sort_values("position")
    for own, texts in ((got[got.conv_id.isna()], rows), (got[got.conv_id == 7], long)):
        assert list(zip(own["reply_to"].fillna(-1).astype(int), own["n_quotes"], own["n_linked"])) == brute_quotations(texts)


def test_quality(spark, docs):
    rnd = random.Random(2)
    words = ["".join(rnd.choice("abcdefgh") for _ in range(4)) for _ in range(150)]
    rows = [(i, " ".join(rnd.choice(words) for _ in range(60)) if i % 3 else " ".join(["spam!!", rnd.choice(words)] * 30), "en", "s", 1) for i in range(300)]
    d = spark.createDataFrame(rows + rows[:1] + [(900, None, None, None, 0), (None, "", None, None, 0)], DOCS)
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(0, 300, 2)] + [(5, None, 0)], "doc_id long, quality int, toxic int")
    ranked, kept = op08_quality.resample(d, labels)
    ids = [r.doc_id for r in kept.collect()]
    assert {i for i in range(300) if i % 3} <= set(ids) and not {i for i in range(0, 300, 3)} & set(ids)
    chosen = ranked.where("selected").toPandas()
    assert len(chosen) == len(ids) and ranked.count() == 303
    assert kept.columns == d.columns
    assert op08_quality.resample(empty(d), labels)[1].count() == 0
    assert op08_quality.resample(d, labels.where("1 = 0"))[1].count() == 303


def test_quality_draw():
    # inclusion rates of the draw against all orders in which documents could be drawn
    w, k = np.array([0.3, 0.1, 0.0, -0.05, -0.2]), 2
    weight = np.exp(op08_quality.EVIDENCE * w)
    want = np.zeros(5)
    for a in range(5):
        for b in range(5):
            if a != b:
                want[[a, b]] += weight[a] / weight.sum() * weight[b] / (weight.sum() - weight[a])
    ids, texts, n = np.arange(5, dtype=np.uint64), np.arange(100, 105, dtype=np.uint64), 20_000
    got = np.zeros(5)
    for seed in range(n):
        got[np.argsort(-(op08_quality.EVIDENCE * w + op08_quality.noise(ids, texts, seed)[0]))[:k]] += 1
    assert np.abs(got / n - want).max() < 0.01 and 0.01 < want.min() and want.max() < 0.995  # none is all but sure
    same = op08_quality.noise(np.array([3, 3], np.uint64), np.array([1, 2], np.uint64), 8)[0]
    assert same[0] != same[1]  # the text has its part in the noise


def test_quality_brute_force(spark):
    rnd = random.Random(5)
    make = lambda a, n: " ".join("".join(rnd.choice(a) for _ in range(rnd.randint(1, 3))) + rnd.choice(["", "", ".", "!!"]) for _ in range(n))
    rows = [(i, make("abc" if i % 2 else "abde", rnd.randint(1, 60)), None, "s", 1) for i in range(200)] + [(300, None, None, "s", 1), (301, "", None, "s", 1), (7, "no no no", None, "t", 1)]
    labels = [(i, i % 2, 0) for i in range(0, 120)]
    ranked, kept = op08_quality.resample(spark.createDataFrame(rows, DOCS), spark.createDataFrame(labels, "doc_id long, quality int, toxic int"), k=90)
    b = op08_quality.BUCKETS

    def grams(text):  # buckets of tokens, of pairs and of repetitions
        t = [int(op08_quality.token_hashes([x.encode()], punct=True, folded=False).__next__()[0]) for x in re.findall(r"[^\s!.]+|[!.]+", text or "")]
        pairs = [int(op08_quality.ngrams(np.array(p, np.uint64), 2)[0]) for p in zip(t, t[1:])] or [int(x) for x in op08_quality.ngrams(np.array(t, np.uint64), 2)]
        return [x % (b - 1) for x in t + pairs] + [b - 1] * sum(x == y for x, y in zip(t, t[1:]))

    raw, good = collections.Counter(), collections.Counter()
    for i, t, *_ in rows:
        raw.update(grams(t))
        if dict((a, q) for a, q, _ in labels).get(i) == 1:
            good.update(grams(t))
    p = lambda c, g: math.log((c[g] + 1) / (sum(c.values()) + b))
    got = {(r.doc_id, r.n_grams, round(r.log_weight, 9)): (r.gumbel_key, r.rank, r.selected) for r in ranked.collect()}
    assert len(got) == len(rows)
    for i, t, *_ in rows:
        g = grams(t)
        w = sum(p(good, x) - p(raw, x) for x in g) / len(g) if g else 0.0
        assert (i, len(g), round(w, 9)) in got
    order = sorted(got.values(), key=lambda x: -x[0])
    assert [x[1] for x in order] == list(range(1, len(rows) + 1)) and [x[2] for x in order] == [True] * 90 + [False] * (len(rows) - 90)
    plain = sorted(got, key=lambda x: -x[2])[:90]
    assert 0 < sum(not got[x][2] for x in plain) < 60  # the draw isn't the plain order by weight
    assert kept.count() == 90 and kept.columns == [c.split()[0] for c in DOCS.split(", ")]


def brute_classes(texts, k, num, den):
    sets = []
    for t in texts:
        w = (t or "").encode().lower().split()
        sets.append({tuple(w[i : i + k]) for i in range(len(w) - k + 1)} if len(w) >= k else {tuple(w)} if w else set())
    root = list(range(len(sets)))

    def find(x):
        while root[x] != x:
            x = root[x]
        return x

    for i, a in enumerate(sets):
        for j in range(i):
            both = len(a & sets[j])
            if a and sets[j] and den * both >= num * (len(a) + len(sets[j]) - both):
                x, y = find(i), find(j)
                root[max(x, y)] = min(x, y)
    return [len(s) for s in sets], [find(i) for i in range(len(sets))]


@pytest.mark.parametrize("k, num, den", [(4, 85, 100), (5, 80, 100)])
def test_jaccard(spark, texts, k, num, den):
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    n, root = brute_classes(texts, k, num, den)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in op09_jaccard.jaccard_classes(d, k, num, den).collect()}
    assert got == {i: (n[i], root[i]) for i in range(len(texts))}
    assert len(set(root)) < len(root) - 40


def test_jaccard_blocks_and_empty(spark, texts, monkeypatch):
    monkeypatch.setattr(op09_jaccard, "BLOCK", 5)
    d = spark.createDataFrame(list(enumerate(texts)), "doc_id long, text string")
    _, root = brute_classes(texts, 4, 85, 100)
    assert {r.doc_id: r.component_id for r in op09_jaccard.jaccard_classes(d).collect()} == dict(enumerate(root))
    assert op09_jaccard.jaccard_classes(d.where("1 = 0")).count() == 0


def brute_lines(rows):
    blank = " \t\n\x0b\x0c\r"
    key = lambda line: "".join(c.lower() if "A" <= c <= "Z" else c for c in line.strip(blank))
    held = collections.defaultdict(set)
    for i, t in rows:
        for line in (t or "").split("\n"):
            if len(key(line)) >= 20:
                held[key(line)].add(i)
    out = {}
    for i, t in rows:
        lines = (t or "").split("\n")
        kept = [x for x in lines if len(key(x)) < 20 or len(held[key(x)]) < 3 or max(held[key(x)]) == i]
        out[i] = (len(lines), len(lines) - len(kept), "\n".join(kept))
    return out


@pytest.mark.parametrize("most", [500_000, 2])
def test_lines(spark, texts, most):
    extra = ["Ünïcode line of twenty", "Ünïcode line of twent"] * 4 + ["A line said over and over again\nA line said over and over again"] * 5 + ["the second long repeated line\nthe third long repeated line!\n"] * 4
    rows = list(enumerate(texts + extra))
    d = spark.createDataFrame(rows, "doc_id long, text string").withColumns({c: F.lit("clash") for c in ("n_lines", "_gone", "_id", "shard", "run")})
    found = op10_lines.dedup_lines(d, max_broadcast=most, shard_keys=2)
    assert found.columns == ["doc_id", "text", "_gone", "_id", "shard", "run", "n_lines", "n_dropped"]
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in found.where("_gone = 'clash' and _id = 'clash'").collect()}
    assert got == brute_lines(rows)
    assert op10_lines.dedup_lines(d.where("1 = 0")).count() == 0


def test_lines_many_keys(spark):
    rnd = random.Random(4)
    common_lines = [f"line number {i} stands in several documents" for i in range(120_000)]
    rows = [(i, "\n".join(rnd.sample(common_lines, 60_000) + [f"line {j} of document {i} and no other" for j in range(5000)])) for i in range(6)]
    rows += [(i, None if i % 2 else "short") for i in range(6, 9)]
    d = spark.createDataFrame(rows, "doc_id long, text string")
    got = {r.doc_id: (r.n_lines, r.n_dropped, r.text) for r in op10_lines.dedup_lines(d, max_broadcast=1000, shard_keys=20_000, shard_lines=10_000).collect()}
    want = brute_lines(rows)
    assert {i: x[:2] for i, x in got.items()} == {i: x[:2] for i, x in want.items()}
    assert got == want


def test_perfect_hash():
    keys = np.random.default_rng(1).integers(0, 2**63, 5000).astype(np.uint64)
    keys = np.unique(keys)
    mph = op10_lines.PerfectHash(keys)
    assert sorted(mph(keys)) == list(range(len(keys)))
    again = op10_lines.PerfectHash.unpack(*mph.pack())
    assert (again(keys) == mph(keys)).all()


def test_pipeline(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    assert [n for n, _ in pipeline.STAGES] == ["quality", "language", "lines", "near_duplicates", "packing"]
    sf = "/root/testdata/sf0.001"
    got = pipeline.run(spark, sf).toPandas()
    docs = common.table(spark, sf, "documents").toPandas()
    assert 0.5 * len(docs) < got["doc_id"].nunique() < len(docs)
    assert (got.groupby("sequence_id")["length"].sum() <= 2048).all()


def test_pipeline_language_short(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf, rnd = "/root/testdata/sf0.001", random.Random(3)
    docs = common.table(spark, sf, "documents").select(pipeline.COLUMNS)
    clean = docs.where("n_chars > 400 and lang is not null").orderBy("doc_id").limit(60).toPandas()
    short = []
    for r in clean.itertuples():
        words = r.text.split()
        for n in (1, 2, 3, 5):
            at = rnd.randrange(len(words) - n)
            run = " ".join(words[at : at + n])
            if any(c.isalpha() for c in run):
                short.append((1_000_000 + len(short), run, r.lang, "short", len(run)))
    odd = [(-1, "geverü " * 12, None, "odd", 84), (-2, "1234 !?", None, "odd", 7), (-3, None, None, "odd", None)]
    odd += [(-4 - i, "".join(rnd.choice("bcdfghjklmnpqrstvwxyz ") for _ in range(400)), None, "odd", 400) for i in range(20)]
    rows = docs.union(spark.createDataFrame(short + odd, docs.schema)).repartition(4)
    held = {r.doc_id for r in pipeline.language(spark, rows, sf).where("source in ('short', 'odd')").collect()}
    assert {i for i in held if i >= -3} == {i for i, *_ in short} | {-1}
    assert len([i for i in held if i < -3]) < 10  # of 20 texts that fit no language


def test_pipeline_near_duplicates(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    rnd = random.Random(4)
    base = [" ".join(f"w{rnd.randrange(3000)}" for _ in range(120)) for _ in range(12)]
    near = lambda t: t + " another end"
    rows = [(1, base[0]), (1, base[0]), (1, near(base[0])), (2, base[0]), (2, base[1]), (None, base[2]), (None, base[2]), (None, near(base[2]))]
    rows += [(None, base[3]), (9, near(base[3])), (None, base[4]), (7, base[5]), (7, base[6]), (8, near(base[6])), (5, None), (5, None), (6, ""), (6, " "), (None, None)]
    rows += [(20 + i, near(base[7 + i % 5]) if i % 3 else base[7 + i % 5]) for i in range(15)]
    sets = [{tuple(w[j : j + 5]) for j in range(max(1, len(w) - 4))} if (w := (t or "").split()) else set() for _, t in rows]
    group = list(range(len(rows)))
    for a in range(len(rows)):
        for b in range(a):
            if sets[a] and sets[b] and 100 * len(sets[a] & sets[b]) >= 80 * len(sets[a] | sets[b]):
                group = [group[b] if g == group[a] else g for g in group]
    order = lambda r: (r[0] is None, r[0] or 0, hashlib.sha256((r[1] or "").encode()).hexdigest())
    want = [min((rows[i] for i in range(len(rows)) if group[i] == g), key=order) for g in set(group)]
    d = spark.createDataFrame([(i, t, "en", "s", 1) for i, t in rows], DOCS).repartition(3)
    got = [(r.doc_id, r.text) for r in pipeline.near_duplicates(spark, d, "").collect()]
    assert collections.Counter(got) == collections.Counter(want)


def test_pipeline_stages_edges(spark):
    pipeline = pytest.importorskip("corpus_pipeline")
    sf = "/root/testdata/sf0.001"
    rows = [tuple(r) for r in common.table(spark, sf, "documents").select(pipeline.COLUMNS).orderBy("doc_id").limit(30).collect()]
    rows += [rows[0], (5000, None, None, None, None), (None, None, None, None, None), (5001, "", "en", "s", 0), (5002, "  \n ", "en", "s", 4), (None, rows[1][1], "en", "s", 9), (5003, "é" * 300_000 + " end", "fr", "s", 300_004)]
    d = spark.createDataFrame(rows, DOCS).repartition(3)
    clash = d.withColumns({c: F.lit("clash") for c in ("rank", "score", "n_lines", "lang_pred", "tie", "log_weight", "_row", "_gone", "cls", "component_id", "selected")})
    for name, stage in pipeline.STAGES:
        plain = [tuple(r) for r in stage(spark, d, sf).collect()]
        assert plain and collections.Counter(tuple(r) for r in stage(spark, clash, sf).collect()) == collections.Counter(plain), name
        assert stage(spark, d.where("1 = 0"), sf).count() == 0, name
        if name == "language":
            assert not {5000, 5001, 5002} & {r[0] for r in plain}
        if name in ("lines", "near_duplicates"):
            assert {5000, 5001, 5002} <= {r[0] for r in plain}
        if name == "packing":
            assert sum(r[2] for r in plain if r[0] == 5001) == 1 and sum(r[2] for r in plain if r[0] == 5003) > 2048


def test_words_across_segments(monkeypatch):
    from docaudit.llm import words

    rnd = random.Random(6)
    texts = [" ".join("".join(rnd.choice("abXY,.") for _ in range(rnd.randint(1, 40))) for _ in range(rnd.randint(0, 200))).encode() for _ in range(40)] + [b"", b" ", b"x" * 900]
    whole = [x.tolist() for x in words.token_hashes(texts)]
    monkeypatch.setattr(words, "SEGMENT", 64)  # texts of many segments
    assert [x.tolist() for x in words.token_hashes(texts)] == whole
    assert [len(x) for x in whole] == [len(t.split()) for t in texts]
