"""Rule packs as tables, scanned in one pass: an automaton over the literals that patterns must contain tells which patterns a
text may match at all, and only those are tried."""

import hashlib
import re
from collections.abc import Iterator
from re import _constants as C
from re import _parser

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from docaudit.functions.slices import slices

#: Rules of one scan at most: all of them are held by every worker. More rules are several scans.
MOST = 200_000
RULE = ["pack", "rule_group", "rule_idx", "pattern", "label"]
#: Letters beyond ASCII that match ASCII ones where case is ignored.
FOLDED = str.maketrans({"ſ": "s", "ı": "i", "İ": "i", "K": "k"})
_machines: dict[str, "Machine"] = {}


def _literals(parsed) -> tuple[list[list[str]], str | None]:
    """Of a parsed sequence: sets of literals of which a match contains one each, and its text if it is one literal."""
    found: list[list[str]] = []
    run, whole = "", True
    for op, arg in parsed:
        if op is C.LITERAL and 0 < arg < 128:
            run += chr(arg).lower()
            continue
        if op is C.SUBPATTERN and not arg[1] and not arg[2]:
            inner, text = _literals(arg[3])
            if text is not None:
                run += text
                continue
            found += inner
        elif op is C.BRANCH:
            each = [best_literals(_literals(branch)) for branch in arg[1]]
            if all(each):
                found.append([x for e in each for x in e])
        elif op in (C.MAX_REPEAT, C.MIN_REPEAT) and arg[0] > 0:
            inner, text = _literals(arg[2])
            found += [[text]] if text else inner
        if op is not C.AT:  # a place takes no text
            found.append([run])
            run, whole = "", False
    return [x for x in [*found, [run]] if all(x)], run if whole else None


def best_literals(of: tuple[list[list[str]], str | None]) -> list[str]:
    """The set whose shortest literal is longest; none if no literal is sure."""
    sets = of[0]
    return max(sets, key=lambda s: (min(map(len, s)), -len(s)), default=[])


def required(pattern: str) -> list[str]:
    """Literals, in lower case, of which every match of the pattern contains one; none if there is no such set."""
    parsed = _parser.parse(pattern, re.I)
    return [] if parsed.state.flags & re.X else best_literals(_literals(parsed))


def placed(pattern: str, most: int = 64) -> tuple[str, int, int] | None:
    """A literal that every match contains, in lower case, and how far from the match's begin it stands (least, most); none if
    there is no such literal, or none within `most` places."""
    parsed = _parser.parse(pattern, re.I)
    if parsed.state.flags & re.X:
        return None
    found, run, low, high = [("", 0, 0)], "", 0, 0
    for op, arg in [*parsed, (None, None)]:
        if op in (C.AT, C.ASSERT, C.ASSERT_NOT):
            continue
        if op is C.LITERAL and 0 < arg < 128:
            run += chr(arg).lower()
            continue
        found.append((run, low, high))
        if op is not None:
            least, longest = _parser.SubPattern(parsed.state, [(op, arg)]).getwidth()
            low, high, run = low + len(run) + least, high + len(run) + longest, ""
    best = max((f for f in found if f[2] - f[1] <= most), key=lambda f: len(f[0]))
    return best if best[0] else None


class Machine:
    """Compiled rules: which of them occur in a text, case ignored."""

    def __init__(self, patterns: list[str]):
        import ahocorasick

        self.patterns = [re.compile(p, re.I) for p in patterns]
        self.always, self.places, by_literal = [], [placed(p) for p in patterns], {}
        for i, p in enumerate(patterns):
            wanted = [self.places[i][0]] if self.places[i] else required(p)
            for literal in wanted:
                by_literal.setdefault(literal, []).append(i)
            if not wanted:
                self.always.append(i)
        self.automaton = None
        if by_literal:
            self.automaton = ahocorasick.Automaton()
            for literal, rules in by_literal.items():
                self.automaton.add_word(literal, rules)
            self.automaton.make_automaton()

    def _literals(self, text: str) -> Iterator[tuple[int, list[int]]]:
        """Where a literal ends, and the rules that want it."""
        return iter(()) if self.automaton is None else self.automaton.iter((text if text.isascii() else text.translate(FOLDED)).lower())

    def candidates(self, text: str) -> list[int]:
        return sorted({*self.always, *(i for _, rules in self._literals(text) for i in rules)})

    def __call__(self, text: str) -> list[int]:
        """A rule whose literal's place in a match is known is tried there alone, others on the whole text."""
        found, whole = set(), set(self.always)
        for end, rules in self._literals(text):
            for i in rules:
                if i in found:
                    continue
                if self.places[i] is None:
                    whole.add(i)
                    continue
                literal, low, high = self.places[i]
                start, match = end + 1 - len(literal), self.patterns[i].match
                if any(match(text, at) for at in range(max(0, start - high), start - low + 1)):
                    found.add(i)
        return sorted(found | {i for i in whole if self.patterns[i].search(text)})


def scan(docs: DataFrame, rules: DataFrame, text: str = "text") -> DataFrame:
    """(doc_id, pack, rule_group, rule_idx, label) for each document and rule (a row of RULE) whose pattern occurs in the text.

    One scan of docs, nothing is shuffled. Patterns are Python's, case ignored, `.` stops at line ends. Null text: no hit. A rule
    that stands twice hits twice. A pattern without a sure literal is tried on every text. More than MOST rules: an error."""
    rows = [tuple(r) for r in rules.select(*RULE).orderBy(*RULE).limit(MOST + 1).collect()]
    if len(rows) > MOST:
        raise ValueError(f"more than {MOST} rules in one scan")
    for r in rows:
        re.compile(r[3])  # a pattern that is wrong fails here, not in a task
    held = docs.sparkSession.sparkContext.broadcast(rows)
    name = hashlib.sha256(repr(rows).encode()).hexdigest()

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        if name not in _machines:
            _machines.clear()  # a worker holds one pack
            _machines[name] = Machine([r[3] for r in held.value])
        machine = _machines[name]
        columns = [pa.array([r[k] for r in held.value], kind) for k, kind in ((0, pa.string()), (1, pa.string()), (2, pa.int32()), (4, pa.string()))]
        for batch in batches:
            for part in slices(batch, text):
                docs_, hits = [], []
                for i, t in enumerate(part.column(text).to_pylist()):
                    own = machine(t) if t else []
                    docs_ += [i] * len(own)
                    hits += own
                at = pa.array(hits, pa.int64())
                yield pa.RecordBatch.from_arrays([part.column("doc_id").take(pa.array(docs_, pa.int64())), *[c.take(at) for c in columns]], ["doc_id", "pack", "rule_group", "rule_idx", "label"])

    kind = dict(docs.dtypes)["doc_id"]
    return docs.select("doc_id", F.col(text)).mapInArrow(run, f"doc_id {kind}, pack string, rule_group string, rule_idx int, label string")
