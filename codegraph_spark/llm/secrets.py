"""Secret scan by one combined deterministic automaton (operator 6).

All rule expressions become one nondeterministic automaton (Thompson), then subset construction with an implicit restart
at every byte and Moore minimisation give one transition array. A text is read once, byte by byte; only where an accepting
state is met does the rule's own reversed automaton look back for the start and its anchored one forward for the end.
"""

from __future__ import annotations

import re
from collections import deque
from dataclasses import dataclass
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import arrow_map


@dataclass(frozen=True)
class Rule:
    """kind, an expression over ASCII, and the length that counts: of the match, or of its last run of value characters."""

    kind: str
    pattern: str
    least: int = 0
    value: str | None = None


#: The contract's kinds come first; their order is the order of kinds at equal starts.
BASE_RULES = (
    Rule("assign", r"""(?:[pP][aA][sS][sS][wW][oO][rR][dD]|[pP][aA][sS][sS][wW][dD]|[sS][eE][cC][rR][eE][tT]|[tT][oO][kK][eE][nN]|[aA][pP][iI]_?[kK][eE][yY])["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""", 6, r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?"""),
    Rule("access", r"AKIA[A-Z0-9]+", 20),
    Rule("hex", r"[0-9a-f]{24}[0-9a-f]*"),
)
EXTRA_RULES = (
    Rule("jwt", r"eyJ[A-Za-z0-9_-]+\.eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", 40),
    Rule("pem", r"-----BEGIN (?:RSA |EC |DSA |OPENSSH )?PRIVATE KEY-----"),
    Rule("chat", r"xox[abprs]-[A-Za-z0-9-]+", 15),
)
RULES = BASE_RULES + EXTRA_RULES


def parse(pattern: str) -> list[tuple]:
    """A rule's expression as a list of (set, bytes), (branch, lists) and (repeat, (low, high or None, list)).

    Rules are written in characters, classes with ranges, escapes (\\xNN and escaped signs), groups, `|` and greedy `?`, `*`, `+` and
    `{m,n}`; anything else is an error.
    """
    at = 0

    def peek() -> str:
        return pattern[at] if at < len(pattern) else ""

    def character() -> int:
        nonlocal at
        c = pattern[at]
        at += 1
        if c == "\\":
            c = pattern[at]
            at += 1
            if c == "x":
                at += 2
                return int(pattern[at - 2 : at], 16)
            if c.isalnum():
                raise ValueError(f"rule expressions can't use \\{c}")
        if ord(c) > 127:
            raise ValueError("rule expressions are ASCII")
        return ord(c)

    def chosen() -> frozenset[int]:
        nonlocal at
        at += 1
        out: set[int] = set()
        if peek() == "^":
            raise ValueError("rule expressions can't use negated classes")
        while peek() != "]":
            low = character()
            if peek() == "-" and pattern[at + 1] != "]":
                at += 1
                out |= set(range(low, character() + 1))
            else:
                out.add(low)
        at += 1
        return frozenset(out)

    def one() -> tuple:
        nonlocal at
        if peek() == "[":
            return "set", chosen()
        if peek() == "(":
            at += 3 if pattern.startswith("(?:", at) else 1
            inner = branches()
            if peek() != ")":
                raise ValueError("unclosed group")
            at += 1
            return "branch", inner
        if peek() in "?*+{.^$":
            raise ValueError(f"rule expressions can't use {peek()} here")
        return "set", frozenset([character()])

    def sequence() -> list[tuple]:
        nonlocal at
        out = []
        while peek() not in ("", "|", ")"):
            item = one()
            if peek() and peek() in "?*+":
                low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}[peek()]
                at += 1
                item = "repeat", (low, high, [item])
            elif peek() == "{":
                end = pattern.index("}", at)
                low, comma, high = pattern[at + 1 : end].partition(",")
                at = end + 1
                item = "repeat", (int(low), int(high) if high else None if comma else int(low), [item])
            if peek() and peek() in "?*+{":
                raise ValueError("rule expressions can't use lazy or repeated quantifiers")
            out.append(item)
        return out

    def branches() -> list[list[tuple]]:
        nonlocal at
        out = [sequence()]
        while peek() == "|":
            at += 1
            out.append(sequence())
        return out

    tree = [("branch", branches())]
    if at < len(pattern):
        raise ValueError("unopened group")
    return tree


class Nfa:
    """Thompson automaton over bytes: eps[s] = states, step[s] = (set of bytes, state)."""

    def __init__(self):
        self.eps: list[list[int]] = []
        self.step: list[tuple[frozenset[int], int] | None] = []

    def state(self) -> int:
        self.eps.append([])
        self.step.append(None)
        return len(self.eps) - 1

    def add(self, tree, start: int, reverse: bool) -> int:
        """Append what the parsed expression reads behind start; returns the end state."""
        for op, arg in reversed(tree) if reverse else tree:
            start = self._one(op, arg, start, reverse)
        return start

    def _one(self, op: str, arg, start: int, reverse: bool) -> int:
        if op == "set":
            end, s = self.state(), self.state()
            self.eps[start].append(s)
            self.step[s] = (arg, end)
            return end
        if op == "branch":
            end = self.state()
            for part in arg:
                s = self.state()
                self.eps[start].append(s)
                self.eps[self.add(part, s, reverse)].append(end)
            return end
        low, high, part = arg
        for _ in range(low):
            start = self.add(part, start, reverse)
        if high is None:
            loop = self.state()
            self.eps[start].append(loop)
            self.eps[self.add(part, loop, reverse)].append(loop)
            return loop
        end = self.state()
        self.eps[start].append(end)
        for _ in range(high - low):
            start = self.add(part, start, reverse)
            self.eps[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


def compile_rules(patterns: tuple[str, ...], restart: bool, reverse: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(transitions [states, 256], accepted rules as a bit mask per state); state 0 is the start, -1 is dead.

    restart: a match may begin at any byte, so no state is dead.
    """
    nfa = Nfa()
    root, ends = nfa.state(), {}
    for n, p in enumerate(patterns):
        s = nfa.state()
        nfa.eps[root].append(s)
        ends[nfa.add(parse(p), s, reverse)] = n
    # bytes that every step reads alike have one column until the end
    sets = list({x[0] for x in nfa.step if x})
    classes: dict[tuple[bool, ...], int] = {}
    column = [classes.setdefault(tuple(b in x for x in sets), len(classes)) for b in range(256)]
    sample = [column.index(c) for c in range(len(classes))]
    first = nfa.closure([root])
    numbers, todo, table = {first: 0}, deque([first]), []
    while todo:
        here = todo.popleft()
        steps = [nfa.step[s] for s in here if nfa.step[s]]
        row = []
        for b in sample:
            there = nfa.closure({to for read, to in steps if b in read} | ({root} if restart else set()))
            if there and there not in numbers:
                numbers[there] = len(numbers)
                todo.append(there)
            row.append(numbers[there] if there else -1)
        table.append(row)
    accept = np.array([sum(1 << ends[s] for s in key if s in ends) for key in numbers], np.int64)
    table, accept = minimise(np.array(table, np.int32), accept)
    return table[:, column], accept


def minimise(table: np.ndarray, accept: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Moore's partition refinement; the start stays state 0."""
    _, group = np.unique(accept, return_inverse=True)
    while True:
        to = np.where(table < 0, -1, group[table])
        _, refined = np.unique(np.column_stack([group, to]), axis=0, return_inverse=True)
        refined = refined.ravel()
        if refined.max() == group.max():
            break
        group = refined
    _, first = np.unique(group, return_index=True)
    order = np.argsort(first)
    rank = np.empty_like(order)
    rank[order] = np.arange(len(order))
    keep = first[order]
    moved = table[keep]
    return np.where(moved < 0, -1, rank[group[moved]]).astype(np.int32), accept[keep]


class Scanner:
    """spans(bytes) -> [(kind number, start byte, end byte)] for a tuple of rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules = rules
        table, self.accept = compile_rules(tuple(r.pattern for r in rules), restart=True)
        # accepting states come last, so the loop compares one number a byte
        order = np.argsort(self.accept > 0, kind="stable")
        rank = np.empty_like(order)
        rank[order] = np.arange(len(order))
        self.table = [row.tolist() for row in rank[table[order]]]
        self.accept, self.start = self.accept[order].tolist(), int(rank[0])
        self.least = next((i for i, a in enumerate(self.accept) if a), len(order))
        self.forward = [self._lists(compile_rules((r.pattern,), restart=False)) for r in rules]
        self.backward = [self._lists(compile_rules((r.pattern,), restart=False, reverse=True)) for r in rules]
        self.heads = [re.compile(r.value.encode()) if r.value else None for r in rules]

    @staticmethod
    def _lists(machine):
        return machine[0].tolist(), machine[1].tolist()

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        out, done = [], [0] * len(self.rules)
        table, state, least = self.table, self.start, self.least
        for at, b in enumerate(data, 1):
            state = table[state][b]
            if state >= least:
                mask = self.accept[state]
                for n in range(len(done)):
                    if mask >> n & 1 and at > done[n]:
                        start = self._start(n, data, at, done[n])
                        if start is not None:
                            end = done[n] = self._end(n, data, start)
                            if self._counts(n, data, start, end):
                                out.append((n, start, end))
        return sorted(out, key=lambda x: (x[1], x[0]))

    def _start(self, n: int, data: bytes, end: int, floor: int) -> int | None:
        table, accept = self.backward[n]
        state, found, at = 0, None, end
        while at > floor:
            at -= 1
            state = table[state][data[at]]
            if state < 0:
                break
            if accept[state]:
                found = at
        return found

    def _end(self, n: int, data: bytes, start: int) -> int:
        table, accept = self.forward[n]
        state, found = 0, start
        for at in range(start, len(data)):
            state = table[state][data[at]]
            if state < 0:
                break
            if accept[state]:
                found = at + 1
        return found

    def _counts(self, n: int, data: bytes, start: int, end: int) -> bool:
        head = self.heads[n].match(data, start, end) if self.heads[n] else None
        return end - (head.end() if head else start) >= self.rules[n].least


@lru_cache(4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def in_code_points(data: bytes, spans: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
    if not spans or data.isascii():
        return spans
    before = np.r_[0, np.cumsum((np.frombuffer(data, np.uint8) & 0xC0) != 0x80)]
    return [(n, int(before[s]), int(before[e])) for n, s, e in spans]


def scan_secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """(doc_id, spans array<struct<kind, start, end>>), one row per row of docs, spans by start, then by the rules' order.

    Per rule: leftmost matches that don't overlap, each as long as it can be; a match too short to count still uses up its
    bytes. Offsets are code points, the end exclusive. Null text like an empty one; null and repeated ids pass through; an
    empty table gives no rows; other columns are ignored.
    """
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # its size depends on the rules alone

    def make():
        scan = shared.value

        def one(batch: pa.RecordBatch):
            found = []
            for data in batch.column(1).cast(pa.binary()).to_pylist():
                data = data or b""
                found.append([{"kind": rules[n].kind, "start": s, "end": e} for n, s, e in in_code_points(data, scan.spans(data))])
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind)], ["doc_id", "spans"])

        return one

    return arrow_map(docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).cast("string").alias("text")), make, "doc_id long, spans array<struct<kind:string,start:long,end:long>>")


def redact_secrets(docs: DataFrame, text_col: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """docs with every span replaced by [kind]; overlapping spans become one. Null texts stay null, all columns stay."""
    names = docs.columns
    at = names.index(text_col)

    shared = docs.sparkSession.sparkContext.broadcast(scanner(rules))  # its size depends on the rules alone

    def make():
        scan = shared.value

        def one(batch: pa.RecordBatch):
            texts = []
            for data in batch.column(at).cast(pa.binary()).to_pylist():
                if data:
                    parts, last = [], 0
                    for n, s, e in scan.spans(data):
                        if s >= last:
                            parts += [data[last:s], b"[" + rules[n].kind.encode() + b"]"]
                        last = max(last, e)
                    data = b"".join([*parts, data[last:]]) if parts else data
                texts.append(data)
            yield batch.set_column(at, batch.schema.field(at).with_type(pa.string()), pa.array(texts, pa.binary()).cast(pa.string()))

        return one

    return arrow_map(docs, make, docs.schema)


def digests(found: DataFrame) -> DataFrame:
    """The contract's columns from scan_secrets()'s spans."""
    text = lambda x: F.concat_ws(":", x["kind"], x["start"], x["end"])
    count = lambda k: F.size(F.filter("spans", lambda x: x["kind"] == k)).cast("long").alias(f"n_{k}")
    base = F.filter("spans", lambda x: x["kind"].isin([r.kind for r in BASE_RULES]))
    return found.select("doc_id", *[count(r.kind) for r in BASE_RULES], F.sha2(F.array_join(F.transform(base, text), ","), 256).alias("base_sha256"), F.array_join(F.transform("spans", text), ",").alias("spans"))


__all__ = ["BASE_RULES", "EXTRA_RULES", "RULES", "Rule", "Scanner", "digests", "redact_secrets", "scan_secrets", "scanner"]
