"""Conversation repair: least-cost edits by transfer matrices over a grammar that all conversations share."""

import hashlib
from collections import Counter
from collections.abc import Iterator
from functools import lru_cache

import pandas as pd
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import NARROW_ROWS, batch_rows, cut, in_order, partitions, scratch, table, text_batches

#: Rows of a conversation that are one sequence; a longer conversation is several, whose matrices are multiplied.
FRAGMENT = 4096
#: Rounds in which pairs are counted, and rules that a round may add. They bound the grammar, never the results.
ROUNDS, RULES = 8, 8
SPACE = " \t\n\x0b\x0c\r"
#: Fixed costs of the edits.
REROLE, DELETE, INSERT, CUT_OFF = 2, 3, 2, 1
#: States of the grammar (s?(ua)+)?: nothing yet, after s, after u, after a. Where a role's initial leads.
STEPS = {"s": {0: 1}, "u": {0: 2, 1: 2, 3: 2}, "a": {2: 3}}
ENDS = (0, 3)
LEGAL = ("su", "ua", "au")
#: Symbols of rows: the role's initial (x: any other) in lower case, in upper case if the text is cut off; D for rows to delete.
TERMINALS = "suaxSUAXD"
#: The first symbol of a rule; rules take the symbols from here on.
FIRST_RULE = 0x100


class Rope:
    """A text as a tree of texts, with a hash, so equal ropes are told at once and others are compared where they first differ."""

    __slots__ = ("left", "right", "leaf", "n", "hash", "power")
    MOD, BASE = (1 << 61) - 1, 1_000_003

    def __init__(self, leaf: str = "", left: "Rope | None" = None, right: "Rope | None" = None):
        self.leaf, self.left, self.right = leaf, left, right
        if left is None:
            self.n, self.hash = len(leaf), 0
            for ch in leaf:
                self.hash = (self.hash * self.BASE + ord(ch)) % self.MOD
            self.power = pow(self.BASE, self.n, self.MOD)
        else:
            self.n, self.power = left.n + right.n, left.power * right.power % self.MOD
            self.hash = (left.hash * right.power + right.hash) % self.MOD

    def __add__(self, other: "Rope") -> "Rope":
        if not self.n or not other.n:
            return self if self.n else other
        return Rope(self.leaf + other.leaf) if self.left is None and other.left is None and self.n + other.n <= 16 else Rope("", self, other)

    def leaves(self) -> Iterator[str]:
        todo = [self]
        while todo:
            r = todo.pop()
            if r.left is None:
                yield r.leaf
            else:
                todo += [r.right, r.left]

    def __str__(self) -> str:
        return "".join(self.leaves())

    def _hash_to(self, n: int) -> int:
        """Hash of the first n characters."""
        out, r = 0, self
        while n:
            if n >= r.n:
                return (out * r.power + r.hash) % self.MOD
            if r.left is None:
                return Rope(r.leaf[:n])._joined(out)
            if n >= r.left.n:
                out, n, r = (out * r.left.power + r.left.hash) % self.MOD, n - r.left.n, r.right
            else:
                r = r.left
        return out

    def _joined(self, before: int) -> int:
        return (before * self.power + self.hash) % self.MOD

    def _at(self, i: int) -> str:
        r = self
        while r.left is not None:
            r, i = (r.left, i) if i < r.left.n else (r.right, i - r.left.n)
        return r.leaf[i]

    def __lt__(self, other: "Rope") -> bool:
        if self.n == other.n and self.hash == other.hash:
            return False
        low, high = 0, min(self.n, other.n)  # so many characters are equal, at least and at most
        while low < high:
            mid = (low + high + 1) // 2
            low, high = (mid, high) if self._hash_to(mid) == other._hash_to(mid) else (low, mid - 1)
        return self.n < other.n if low == min(self.n, other.n) else self._at(low) < other._at(low)


#: [from state][to state]: cost and audit of the cheapest edits, ties to the smaller audit; None if there are none.
#: No audit of one row sequence begins another one of the same cost (it would lack inserts, which cost), so the smaller of two
#: audits stays the smaller whatever follows, and products of matrices keep the best.
Matrix = list[list[tuple[int, Rope] | None]]


def better(a: tuple[int, Rope] | None, b: tuple[int, Rope] | None) -> tuple[int, Rope] | None:
    if a is None or b is None:
        return a or b
    return b if b[0] < a[0] or b[0] == a[0] and b[1] < a[1] else a


def product(x: Matrix, y: Matrix) -> Matrix:
    out: Matrix = [[None] * 4 for _ in range(len(x))]
    for i, row in enumerate(x):
        for via, first in enumerate(row):
            if first is not None:
                for j, second in enumerate(y[via]):
                    if second is not None and not (out[i][j] is not None and out[i][j][0] < first[0] + second[0]):
                        out[i][j] = better(out[i][j], (first[0] + second[0], first[1] + second[1]))
    return out


@lru_cache(maxsize=1)
def inserts() -> Matrix:
    """Any number of inserts of user and assistant rows."""
    out: Matrix = [[(0, Rope()) if i == j else None for j in range(4)] for i in range(4)]
    once: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        for initial in "ua":
            if i in STEPS[initial]:
                once[i][STEPS[initial][i]] = (INSERT, Rope("I"))
    for _ in range(2):  # two lead from anywhere to anywhere that inserts lead to
        longer = product(out, once)
        out = [[better(out[i][j], longer[i][j]) for j in range(4)] for i in range(4)]
    return out


def row_matrix(symbol: str) -> Matrix:
    """Inserts, then one edit of a row."""
    edit: Matrix = [[None] * 4 for _ in range(4)]
    for i in range(4):
        edit[i][i] = (DELETE, Rope("D"))
        if symbol != "D":
            more = CUT_OFF * symbol.isupper()
            for initial, cost, name in ((symbol.lower(), 0, "K"), ("u", REROLE, "R"), ("a", REROLE, "R")):
                if i in STEPS.get(initial, {}):
                    j = STEPS[initial][i]
                    edit[i][j] = better(edit[i][j], (cost + more, Rope(name)))
    return product(inserts(), edit)


@lru_cache(maxsize=4)
def matrices(rules: tuple[str, ...]) -> dict[str, Matrix]:
    """The matrix of each symbol: of rows, then of each rule from those of its two parts, bottom up."""
    out = {t: row_matrix(t) for t in TERMINALS}
    for k, (a, b) in enumerate(rules):
        out[chr(FIRST_RULE + k)] = product(out[a], out[b])
    return out


def compressed(sequence: str, rules: tuple[str, ...]) -> str:
    for k, pair in enumerate(rules):
        sequence = sequence.replace(pair, chr(FIRST_RULE + k))
    return sequence


def grammar(sequences: DataFrame) -> tuple[str, ...]:
    """Re-Pair over a table of distinct sequences (column symbols): every round counts neighbouring symbols in all of them and
    makes rules of the most frequent pairs that share no symbol. At most ROUNDS * RULES rules, which is all the driver sees."""
    rules: tuple[str, ...] = ()
    for _ in range(ROUNDS):

        def pairs(batches: Iterator[pd.DataFrame], rules: tuple[str, ...] = rules) -> Iterator[pd.DataFrame]:
            counts: Counter[str] = Counter()  # as many pairs as there are symbols squared, at most
            for batch in batches:
                for s in batch["symbols"]:
                    s = compressed(s, rules)
                    counts.update(map("".join, zip(s, s[1:])))
            yield pd.DataFrame({"pair": pd.Series(list(counts), dtype=object), "n": pd.Series(list(counts.values()), dtype="int64")})

        found = sequences.select("symbols").mapInPandas(pairs, "pair string, n long").groupBy("pair").agg(F.sum("n").alias("n")).where("n > 1")
        used: set[str] = set()
        for row in found.orderBy(F.desc("n"), "pair").limit(4 * RULES).collect():
            if len(rules) < ROUNDS * RULES and used.isdisjoint(row["pair"]) and len(used) < 2 * RULES:
                used.update(row["pair"])
                rules += (row["pair"],)
        if not used:
            break
    return rules


def solved(sequences: DataFrame, rules: tuple[str, ...]) -> DataFrame:
    """(symbols, costs, audits): the matrix of each sequence, row by row; cost -1 where no edits lead."""

    def solve(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        known = matrices(rules)
        for batch in batches:
            costs, audits = [], []
            for s in batch["symbols"]:
                m: Matrix = [[(0, Rope()) if i == j else None for j in range(4)] for i in range(4)]
                for symbol in compressed(s, rules):
                    m = product(m, known[symbol])
                flat = [x for row in m for x in row]
                costs.append([-1 if x is None else x[0] for x in flat])
                audits.append(["" if x is None else str(x[1]) for x in flat])
            yield pd.DataFrame({"symbols": batch["symbols"], "costs": costs, "audits": audits})

    return sequences.select("symbols").mapInPandas(solve, "symbols string, costs array<long>, audits array<string>")


def _fragments(marked: DataFrame) -> DataFrame:
    """Rows in order as sequences of at most FRAGMENT rows of one conversation and task, with their counts."""
    conv = dict(marked.dtypes)["conv_id"]
    names = ["conv_id", "at", "symbols", "blank", "duplicate", "truncated", "illegal", "first", "last", "low", "high", "turns", "turn_first", "turn_last"]
    kinds = f"conv_id {conv}, at long, symbols string, blank long, duplicate long, truncated long, illegal long, first string, last string, low long, high long, turns long, turn_first long, turn_last long"

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, types = None, [pa.int64(), pa.string(), *[pa.int64()] * 4, pa.string(), pa.string(), *[pa.int64()] * 5]
        open_: list = []  # the sequence so far, as names say, symbols in a list
        done: list[list] = []

        def close() -> None:
            if open_:
                done.append([*open_[:2], "".join(open_[2]), *open_[3:]])

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, t) for c, t in zip(columns[1:], types))], names)

        for batch in batches:
            kind, cols = batch.schema.field("conv_id").type, batch.to_pydict()
            for conv_id, at, dropped, initial, blank, truncated, turn, duplicate in zip(*(cols[c] for c in ("conv_id", "at", "dropped", "initial", "blank", "truncated", "turn", "duplicate"))):
                if not open_ or open_[0] != conv_id or len(open_[2]) >= FRAGMENT:
                    close()
                    open_ = [conv_id, at, [], 0, 0, 0, 0, None, None, None, None, 0, None, None]
                if dropped:
                    continue
                symbol = initial if initial in ("s", "u", "a") else "x"
                if open_[7] is None:
                    open_[7] = symbol
                elif open_[8] + symbol not in LEGAL:
                    open_[6] += 1
                open_[8] = symbol
                if blank or duplicate:
                    open_[3 if blank else 4] += 1
                    symbol = "D"
                elif truncated:
                    open_[5] += 1
                    symbol = symbol.upper()
                open_[2].append(symbol)
                if turn is not None and turn != open_[13]:
                    if open_[9] is None:
                        open_[9] = open_[12] = turn
                    open_[10] = open_[13] = turn
                    open_[11] += 1
            if len(done) >= 1000:
                yield out()
        close()
        if done:
            yield out()

    return marked.mapInArrow(scan, kinds)


def _combined(fragments: DataFrame) -> DataFrame:
    """A row for each conversation, from its sequences in order."""
    conv = dict(fragments.dtypes)["conv_id"]
    names = ["conv_id", "gaps", "blank", "duplicate", "truncated", "illegal", "cost", "audit"]

    def combine(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, state, done = None, None, []
        last = inserts()

        def close() -> None:
            if state:
                best = None
                for x in product([state["row"]], last)[0][:: ENDS[1]]:  # both end states
                    best = better(best, x)
                gaps = 0 if state["low"] is None else state["high"] - state["low"] + 1 - state["turns"]
                done.append((state["conv_id"], gaps, *state["sums"], best[0], str(best[1])))

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), pa.array(columns[7], pa.string())], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for r in batch.to_pylist():
                if state is None or state["conv_id"] != r["conv_id"]:
                    close()
                    state = {"conv_id": r["conv_id"], "row": [(0, Rope()), None, None, None], "sums": [0] * 4, "low": None, "high": None, "turns": 0, "last": None}
                m = [[None if r["costs"][4 * i + j] < 0 else (r["costs"][4 * i + j], Rope(r["audits"][4 * i + j])) for j in range(4)] for i in range(4)]
                state["row"] = product([state["row"]], m)[0]
                state["sums"] = [x + r[c] for x, c in zip(state["sums"], ("blank", "duplicate", "truncated", "illegal"))]
                if r["first"] is not None:
                    state["sums"][3] += state["last"] is not None and state["last"] + r["first"] not in LEGAL
                    state["last"] = r["last"]
                if r["low"] is not None:
                    state["turns"] += r["turns"] - (state["high"] == r["turn_first"])
                    state["low"], state["high"] = (r["low"] if state["low"] is None else state["low"]), r["high"]
            if len(done) >= 1000:
                yield out()
        close()
        if done:
            yield out()

    dealt = fragments.repartition(partitions(fragments.sparkSession), "conv_id").sortWithinPartitions("conv_id", "at")
    return dealt.mapInArrow(combine, f"conv_id {conv}, gaps long, blank long, duplicate long, truncated long, illegal long, cost long, audit string")


def repaired_rows(audit: str) -> Iterator[tuple[str, str | None]]:
    """What audit does, in order: the edit, and the role that it sets, which the roles before it decide (None: the row's own;
    the caller sends the initial of a row that is kept)."""
    state = 0
    for edit in audit:
        role = None if edit in "KD" else "assistant" if state == 2 else "user"
        initial = yield edit, role
        if edit != "D":
            state = STEPS[role[0] if role else initial][state]


def _digests(rows: DataFrame, found: DataFrame) -> DataFrame:
    """found with repaired_sha256. A conversation's audit comes first, its rows follow in order and are read as they come."""
    conv = dict(found.dtypes)["conv_id"]
    counts = ["gaps", "blank", "duplicate", "truncated", "illegal", "cost"]
    names = ["conv_id", *counts, "audit", "repaired_sha256"]
    none = lambda t: F.lit(None).cast(t)
    heads = found.select("conv_id", none("long").alias("turn"), none("binary").alias("h"), none("string").alias("role"), none("string").alias("text"), F.struct(*counts, "audit").alias("head"))
    bodies = rows.where("not dropped").select("conv_id", F.col("turn").cast("long").alias("turn"), "h", "role", "text", F.lit(None).cast(heads.schema["head"].dataType).alias("head"))
    dealt = heads.union(bodies).repartition(partitions(found.sparkSession), "conv_id").sortWithinPartitions("conv_id", F.col("head").isNull(), "turn", "h")

    class Repair:
        """One conversation's edits, and the digest of the rows that they leave."""

        def __init__(self, conv_id, head: dict):
            self.conv_id, self.head, self.sha, self.empty = conv_id, head, hashlib.sha256(), True
            self.edits = repaired_rows(head["audit"])
            self.now = next(self.edits, None)

        def line(self, role: str, text: str) -> None:
            self.sha.update(f"{'' if self.empty else chr(10)}{role}:{text}".encode())
            self.empty = False

        def move(self, initial: str | None = None) -> None:
            try:
                self.now = self.edits.send(initial)
            except StopIteration:
                self.now = None

        def insert(self) -> None:
            while self.now and self.now[0] == "I":
                self.line(self.now[1], "")
                self.move()

        def row(self, role: str, text: str) -> None:
            self.insert()
            edit, own = self.now
            if edit != "D":
                self.line(own or role, text)
            self.move(role[:1])

        def result(self) -> tuple:
            self.insert()
            return self.conv_id, *(self.head[c] for c in counts), self.head["audit"], self.sha.hexdigest()

    def digest(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        kind, open_, done = None, None, []

        def out() -> pa.RecordBatch:
            columns = list(zip(*done)) or [[]] * len(names)
            done.clear()
            return pa.RecordBatch.from_arrays([pa.array(columns[0], kind), *(pa.array(c, pa.int64()) for c in columns[1:7]), *(pa.array(c, pa.string()) for c in columns[7:])], names)

        for batch in batches:
            kind = batch.schema.field("conv_id").type
            for conv_id, head, role, text in zip(*(batch.column(c).to_pylist() for c in ("conv_id", "head", "role", "text"))):
                if head is not None:
                    if open_:
                        done.append(open_.result())
                    open_ = Repair(conv_id, head)
                else:
                    open_.row(role, text)
            if len(done) >= 1000:
                yield out()
        if open_:
            done.append(open_.result())
            yield out()

    return dealt.mapInArrow(digest, f"conv_id {conv}, {', '.join(f'{c} long' for c in counts)}, audit string, repaired_sha256 string")


def repair(turns: DataFrame) -> DataFrame:
    """For each conv_id of turns (conv_id, turn, role, text, dropped): faults of its rows, and the cheapest edits that make its
    roles legal: gaps, blank, duplicate, truncated, illegal, cost, audit, repaired_sha256.

    dropped: such rows count for nothing, but their conversation is in the result. Rows are put in order (conv_id, turn, then
    a hash of role and text) by range, so a long conversation spreads over tasks. Each stretch of it is a sequence of symbols
    for role and fault. Distinct sequences are compressed by one grammar (Re-Pair); each rule has one matrix of least costs
    and audits between the states of the legal roles, made of its parts' matrices, and every sequence is a product of them.
    Only the last step, one digest over all of a conversation's text, reads a conversation in one task, as a stream.
    Null turn: before all others, and in no gap. Null role or text: one space. A role without characters is like an unknown
    one. Null conv_id: one conversation. Rows of one turn alike in role and text: the first counts. Rows all dropped: zeros,
    empty audit, digest of the empty string. Empty table: empty. Other columns: ignored."""
    blank = lambda c: F.coalesce(F.col(c), F.lit(" "))
    rows = turns.select("conv_id", "turn", blank("role").alias("role"), blank("text").alias("text"), "dropped")
    rows = rows.withColumn("h", F.unhex(F.sha2(F.concat(F.octet_length("role"), F.lit(":"), "role", "text"), 256)))
    end = F.rtrim("text", F.lit(SPACE))
    narrow = rows.select("conv_id", F.col("turn").cast("long").alias("turn"), "h", "dropped", F.left("role", F.lit(1)).alias("initial"), (end == "").alias("blank"), (~F.right(end, F.lit(1)).isin(".", "!", "?")).alias("truncated"))
    with scratch(turns.sparkSession) as kept:
        placed = cut(in_order(narrow, ["conv_id", "turn", "h", "dropped"]))
        twice = placed.where("not dropped").groupBy("conv_id", "h").agg(F.min("at").alias("first"), F.count("*").alias("n")).where("n > 1")
        again = placed.where("not dropped").alias("p").join(twice.alias("t"), F.expr("p.conv_id <=> t.conv_id and p.h = t.h and p.at > t.first")).select("at", F.lit(True).alias("duplicate"))
        marked = placed.drop("h").join(again, "at", "left")
        marked = marked.repartitionByRange(partitions(turns.sparkSession), "at").sortWithinPartitions("at")
        with batch_rows(turns.sparkSession, NARROW_ROWS):
            fragments = cut(_fragments(marked))
            sequences = cut(fragments.select("symbols").distinct())
            results = cut(solved(sequences, grammar(sequences)))
            found = cut(_combined(fragments.join(results, "symbols")))
        kept.append(found)
    text_batches(turns.sparkSession)
    return _digests(rows, found)


def damaged(conversations: DataFrame) -> DataFrame:
    """Rows of conversations, some of them damaged by crc32 of conv_id:turn modulo 20: 0 dropped, 1 emptied, 2 without marks that
    end sentences, 3 repeated, 4 of role user. Nulls of role and text, and in that key, are one space."""
    text_of = lambda c: F.coalesce(F.col(c).cast("string"), F.lit(" "))
    code = F.crc32(F.concat(text_of("conv_id"), F.lit(":"), text_of("turn"))) % 20
    rows = conversations.select("conv_id", "turn", text_of("role").alias("role"), text_of("text").alias("text"), code.alias("_code"))
    text = F.when(F.col("_code") == 1, "").when(F.col("_code") == 2, F.regexp_replace("text", "[.!?]", "")).otherwise(F.col("text"))
    role = F.when(F.col("_code") == 4, "user").otherwise(F.col("role"))
    times = F.explode(F.when(F.col("_code") == 3, F.array(F.lit(0), F.lit(1))).otherwise(F.array(F.lit(0))))
    return rows.select("conv_id", "turn", role.alias("role"), text.alias("text"), (F.col("_code") == 0).alias("dropped"), times.alias("_copy")).drop("_copy")


def op11_repair_conversations(spark: SparkSession, sf_dir: str) -> DataFrame:
    return repair(damaged(table(spark, sf_dir, "conversations")))


QUERIES = {"op11_repair_conversations": op11_repair_conversations}
#: Dynamic programming over rows and states; a state's best is the least text of its cost, in nine digits, and audit.
ORACLES = {
    "op11_repair_conversations": r"""
WITH RECURSIVE src AS (SELECT dense_rank() OVER (ORDER BY conv_id) AS c, conv_id, turn, coalesce(role, ' ') AS role, coalesce(text, ' ') AS text, coalesce(conv_id::VARCHAR, ' ') || ':' || coalesce(turn::VARCHAR, ' ') AS k FROM conversations),
crc AS (SELECT *, xor(list_reduce([4294967295::BIGINT] || flatten(list_transform(range(1, length(k) + 1), lambda i: [ord(substr(k, i, 1))::BIGINT, -1, -1, -1, -1, -1, -1, -1, -1])),
        lambda s, x: CASE WHEN x >= 0 THEN xor(s, x) ELSE xor(s >> 1, 3988292384 * (s & 1)) END), 4294967295::BIGINT) % 20 AS code FROM src),
d AS (SELECT c, turn, CASE WHEN code = 4 THEN 'user' ELSE role END AS role, CASE code WHEN 1 THEN '' WHEN 2 THEN regexp_replace(text, '[.!?]', '', 'g') ELSE text END AS text, unnest(CASE WHEN code = 3 THEN [0, 1] ELSE [0] END) AS copy FROM crc WHERE code <> 0),
h AS (SELECT *, sha256(strlen(role) || ':' || role || text) AS h FROM d),
p AS MATERIALIZED (SELECT *, row_number() OVER (PARTITION BY c ORDER BY turn NULLS FIRST, h) AS pos, left(role, 1) AS x FROM h),
o AS (SELECT *, row_number() OVER (PARTITION BY c, h ORDER BY pos) AS nth FROM p),
f AS MATERIALIZED (SELECT *, CASE WHEN NOT regexp_matches(text, '[^\x20\x09-\x0D]') THEN 'b' WHEN nth > 1 THEN 'd' WHEN NOT regexp_matches(text, '[.!?][\x20\x09-\x0D]*$') THEN 't' ELSE '' END AS fault, lag(x) OVER (PARTITION BY c ORDER BY pos) || x AS two FROM o),
st(x, i, j) AS (VALUES ('s', 0, 1), ('u', 0, 2), ('u', 1, 2), ('u', 3, 2), ('a', 2, 3)),
ins(i, j, cost, audit, lines) AS (SELECT i, i, 0, '', '' FROM range(4) t(i) UNION ALL SELECT * FROM (VALUES (0, 2, 2, 'I', 'user:' || chr(10)), (1, 2, 2, 'I', 'user:' || chr(10)), (3, 2, 2, 'I', 'user:' || chr(10)), (2, 3, 2, 'I', 'assistant:' || chr(10)),
        (0, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)), (1, 3, 4, 'II', 'user:' || chr(10) || 'assistant:' || chr(10)))),
e AS MATERIALIZED (SELECT c, pos, i, j, CASE WHEN fault = 't' THEN 1 ELSE 0 END AS cost, 'K' AS audit, role || ':' || text || chr(10) AS lines FROM f JOIN st USING (x) WHERE fault NOT IN ('b', 'd')
      UNION ALL SELECT c, pos, i, j, CASE WHEN fault = 't' THEN 3 ELSE 2 END, 'R', CASE st.x WHEN 'u' THEN 'user:' ELSE 'assistant:' END || text || chr(10) FROM f JOIN st ON st.x IN ('u', 'a') WHERE fault NOT IN ('b', 'd')
      UNION ALL SELECT c, pos, i, i, 3, 'D', '' FROM f, range(4) t(i)),
r(c, pos, j, v, lines) AS (SELECT DISTINCT c, 0::BIGINT, 0::BIGINT, '000000000', '' FROM src
      UNION ALL SELECT c, pos, j, min(v), arg_min(lines, v) FROM (SELECT r.c, r.pos + 1 AS pos, e.j::BIGINT AS j, lpad((left(r.v, 9)::BIGINT + ins.cost + e.cost)::VARCHAR, 9, '0') || substr(r.v, 10) || ins.audit || e.audit AS v, r.lines || ins.lines || e.lines AS lines
        FROM r JOIN ins ON ins.i = r.j JOIN e ON e.c = r.c AND e.pos = r.pos + 1 AND e.i = ins.j) t GROUP BY c, pos, j),
n AS (SELECT c, count(*) AS n, coalesce(max(turn) - min(turn) + 1 - count(DISTINCT turn), 0) AS gaps, count(*) FILTER (fault = 'b') AS blank, count(*) FILTER (fault = 'd') AS duplicate, count(*) FILTER (fault = 't') AS truncated, count(*) FILTER (two NOT IN ('su', 'ua', 'au')) AS illegal FROM f GROUP BY c),
z AS (SELECT c, min(v) AS v, arg_min(lines, v) AS lines FROM (SELECT r.c, lpad((left(r.v, 9)::BIGINT + ins.cost)::VARCHAR, 9, '0') || substr(r.v, 10) || ins.audit AS v, r.lines || ins.lines AS lines FROM r LEFT JOIN n ON n.c = r.c JOIN ins ON ins.i = r.j AND ins.j IN (0, 3) WHERE r.pos = coalesce(n.n, 0)) t GROUP BY c)
SELECT s.conv_id, coalesce(gaps, 0)::BIGINT AS gaps, coalesce(blank, 0) AS blank, coalesce(duplicate, 0) AS duplicate, coalesce(truncated, 0) AS truncated, coalesce(illegal, 0) AS illegal, left(v, 9)::BIGINT AS cost, substr(v, 10) AS audit, sha256(left(lines, length(lines) - 1)) AS repaired_sha256
FROM (SELECT DISTINCT c, conv_id FROM src) s JOIN z USING (c) LEFT JOIN n USING (c)"""
}
