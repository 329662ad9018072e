"""Secrets by one deterministic automaton for all rules.

The rules' expressions are parsed, reversed and joined into one nondeterministic automaton that may start at every byte,
made deterministic by subset construction over classes of bytes, and minimised; what is left are two arrays: a class for
each byte and a row of successors for each state, with the accepting states last.  A text is scanned once, from its end,
byte by byte and for all rules; where the automaton accepts, a match of the rule begins.  Several thousand stretches of a
batch advance together as numpy vectors: a stretch may begin at any byte that leads every state back to the start (line
feeds, most punctuation, all bytes beyond ASCII), so that cutting there changes nothing.  From the leftmost beginning on
the rule's own automaton, made in the same way but held to its place, runs to the last byte at which it accepts; the next
match begins behind it.  So automata alone decide the spans: leftmost, longest, non-overlapping for each kind.  Every byte is
read once by the scan and once for each kind whose match holds it, in texts of any form and length.

Cases.  A null or empty text has no spans; spans are in code points, end exclusive; repeated rows are scanned like any
other; a text without a byte that leads back is one long stretch, read without vectors; an empty table gives no rows.  A
column named `secrets` is replaced; others keep their names and values, whatever they are.
"""

from __future__ import annotations

import re
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType, LongType, StringType, StructField, StructType

from tallyspark.llm.work import table, with_column


@dataclass(frozen=True)
class Rule:
    kind: str
    #: The expression is `head` and `rest`; a match is dropped if `rest` has fewer than `least` characters.
    rest: str
    head: str = ""
    least: int = 1

    @property
    def whole(self) -> str:
        return self.head + self.rest


#: Lengths are counted on matches, since a match that is too short takes its text all the same; only where every match is a
#: whole run of its characters may the automaton count instead.
BASE = (
    Rule("assign", "[A-Za-z0-9+/_.=-]+", "(?i:password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", 6),
    Rule("access", "AKIA[A-Z0-9]+", least=20),
    Rule("hex", "[0-9a-f]{24,}"),
)
MORE = (
    Rule("private_key", "-----BEGIN [A-Z ]*PRIVATE KEY-----"),
    Rule("platform_token", "gh[oprsu]_[A-Za-z0-9]+", least=20),
    Rule("chat_token", "xox[abprs]-[A-Za-z0-9-]+", least=15),
    Rule("map_key", "AIza[A-Za-z0-9_-]+", least=24),
    Rule("web_token", "eyJ[A-Za-z0-9_-]+\\.eyJ[A-Za-z0-9_-]+\\.[A-Za-z0-9_-]+"),
)
RULES = BASE + MORE


class Nfa:
    """Thompson's construction.  `steps[s]` holds (set of bytes, successor); `free[s]` successors without a byte."""

    def __init__(self):
        self.steps: list[list[tuple[frozenset, int]]] = []
        self.free: list[list[int]] = []

    def state(self) -> int:
        self.steps.append([])
        self.free.append([])
        return len(self.steps) - 1

    def add(self, pattern: str) -> tuple[int, int]:
        self.p, self.i, self.fold = pattern, 0, False
        ends = self.either()
        if self.i != len(pattern):
            raise ValueError(f"cannot read {pattern!r} from {self.i}")
        return ends

    def peek(self) -> str:
        return self.p[self.i : self.i + 1]

    def either(self) -> tuple[int, int]:
        a, b = self.state(), self.state()
        while True:
            x, y = self.row()
            self.free[a].append(x)
            self.free[y].append(b)
            if self.peek() != "|":
                return a, b
            self.i += 1

    def row(self) -> tuple[int, int]:
        first = last = self.state()
        while self.peek() and self.peek() not in "|)":
            x, y = self.repeated()
            self.free[last].append(x)
            last = y
        return first, last

    def repeated(self) -> tuple[int, int]:
        begin, fold = self.i, self.fold
        ends = self.atom()
        stop = self.i
        least, most = 1, 1
        if m := re.compile(r"\*|\+|\?|\{(\d+)(,?)(\d*)\}").match(self.p, self.i):
            self.i = m.end()
            least, most = {"*": (0, None), "+": (1, None), "?": (0, 1)}.get(m[0]) or (int(m[1]), int(m[3]) if m[3] else None if m[2] else int(m[1]))
        after = self.i

        def again() -> tuple[int, int]:
            self.i, self.fold = begin, fold
            found = self.atom()
            assert self.i == stop
            return found

        copies = [ends] + [again() for _ in range((least if most is None else most) - 1)]
        self.i = after
        a, b = self.state(), self.state()
        last = a
        for k, (x, y) in enumerate(copies):
            if k >= least:
                self.free[last].append(b)
            self.free[last].append(x)
            last = y
        self.free[last].append(b)
        if most is None:
            self.free[last].append(copies[-1][0])
        return a, b

    def atom(self) -> tuple[int, int]:
        if self.peek() == "(":
            fold = self.fold
            if self.p.startswith("(?i:", self.i):
                self.i, self.fold = self.i + 4, True
            else:
                self.i += 1
            ends = self.either()
            self.i, self.fold = self.i + 1, fold
            return ends
        chars = self.bracket() if self.peek() == "[" else {self.char()}
        if self.fold:
            chars = {y for x in chars for y in (ord(chr(x).lower()), ord(chr(x).upper()))}
        a, b = self.state(), self.state()
        self.steps[a].append((frozenset(chars), b))
        return a, b

    def char(self) -> int:
        if self.peek() == "\\":
            if self.p[self.i + 1] == "x":
                self.i += 4
                return int(self.p[self.i - 2 : self.i], 16)
            self.i += 1
        self.i += 1
        return ord(self.p[self.i - 1])

    def bracket(self) -> set[int]:
        self.i += 1
        chars = set()
        while self.peek() != "]":
            a = b = self.char()
            if self.peek() == "-" and self.p[self.i + 1] != "]":
                self.i += 1
                b = self.char()
            chars.update(range(a, b + 1))
        self.i += 1
        return chars


    def reversed(self) -> Nfa:
        other = Nfa()
        other.steps, other.free = [[] for _ in self.steps], [[] for _ in self.free]
        for s, steps in enumerate(self.steps):
            for chars, t in steps:
                other.steps[t].append((chars, s))
        for s, free in enumerate(self.free):
            for t in free:
                other.free[t].append(s)
        return other


@dataclass
class Automaton:
    classes: np.ndarray  # of each byte
    successors: np.ndarray  # [state, class]
    rules: np.ndarray  # bits of the rules that each state accepts
    first: int  # accepting state; all above accept too
    back: np.ndarray  # whether a byte leads every state to state 0

    def __len__(self) -> int:
        return len(self.rules)


def compiled(patterns: list[str], backwards: bool = False, held: bool = False) -> Automaton:
    """One automaton for all `patterns`, of their reversals if `backwards`; it may start at every byte, or only at the first if `held`."""
    nfa = Nfa()
    begin, ends, parts = nfa.state(), {}, [nfa.add(p) for p in patterns]
    if backwards:
        nfa, parts = nfa.reversed(), [(b, a) for a, b in parts]
    for k, (a, b) in enumerate(parts):
        nfa.free[begin].append(a)
        ends[b] = 1 << k
    # Bytes that no expression tells apart share a class.
    sets = sorted({c for s in nfa.steps for c, _ in s}, key=sorted)
    kinds: dict[tuple, int] = {}
    classes = np.array([kinds.setdefault(tuple(b in s for s in sets), len(kinds)) for b in range(256)], np.uint8)
    example = [int(np.flatnonzero(classes == c)[0]) for c in range(len(kinds))]

    def closed(states) -> frozenset:
        todo, seen = list(states), set(states)
        while todo:
            for t in nfa.free[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(s for s in seen if nfa.steps[s] or s in ends)

    reach = [closed({s}) for s in range(len(nfa.steps))]
    start = closed({begin})
    number, order, rows = {start: 0}, [start], []
    for states in order:  # grows while it is read
        row = []
        for byte in example:
            to = frozenset((frozenset() if held else start).union(*(reach[t] for s in states for chars, t in nfa.steps[s] if byte in chars)))
            if to not in number:
                number[to] = len(order)
                order.append(to)
            row.append(number[to])
        rows.append(row)
    successors = np.array(rows)
    accepted = np.array([sum({ends[s] for s in states if s in ends}) for states in order], np.int64)
    # Moore's refinement: states stay together while they accept the same and their successors stay together.
    group = np.unique(accepted, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[successors]]), axis=0, return_inverse=True)[1].reshape(-1)
        if finer.max() == group.max():
            break
        group = finer
    representative = np.full(group.max() + 1, -1)
    representative[group[::-1]] = np.arange(len(group))[::-1]
    # The start is state 0, accepting states come last.
    ranks = sorted(range(len(representative)), key=lambda g: (g != group[0], accepted[representative[g]] != 0, representative[g]))
    place = np.argsort(ranks)
    kept = representative[ranks]
    successors, accepted = place[group[successors[kept]]], accepted[kept]
    back = (successors == 0).all(axis=0)[classes]
    return Automaton(classes, successors.astype(np.int32), accepted, int((accepted == 0).sum()), back)


#: So few stretches at once are read one by one: a vector's step costs more than theirs.
FEW = 12


def scan(data: np.ndarray, a: Automaton, lanes: int = 8192) -> tuple[np.ndarray, np.ndarray]:
    """Positions of bytes after which a rule is accepted, ascending, and the rules' bits."""
    none = np.zeros(0, np.int64)
    if not len(data):
        return none, none
    cuts = np.flatnonzero(a.back[data])
    wanted = np.linspace(0, len(data), lanes + 1).astype(np.int64)[1:-1]
    cuts = np.append(cuts + 1, len(data))
    starts = np.unique(np.append(0, cuts[np.searchsorted(cuts, wanted)]))
    starts = starts[starts < len(data)]
    lengths = np.diff(np.append(starts, len(data)))
    order = np.argsort(-lengths, kind="stable")
    at, lengths = starts[order], lengths[order]
    width = a.successors.shape[1]
    flat = (a.successors * width).ravel().astype(np.int32)
    symbols = a.classes[data]
    state = np.zeros(len(at), np.int32)
    where, what, limit = [], [], a.first * width
    steps = int(lengths[min(FEW, len(lengths) - 1)]) if len(lengths) > FEW else 0
    active = np.searchsorted(-lengths, -np.arange(steps), side="left")  # lanes longer than each step
    for step in range(steps):
        n = active[step]
        if n < len(state):
            state, at = state[:n], at[:n]
        state = flat[state + symbols[at]]
        found = state >= limit
        if found.any():
            where.append(at[found])
            what.append(state[found] // width)
        at = at + 1
    successors = flat.tolist()
    for k in range(min(FEW, len(lengths))):  # the rest of the longest
        s, first, end = int(state[k]) if len(state) > k else 0, int(starts[order[k]]) + steps, int(starts[order[k]] + lengths[k])
        own, kinds = [], []
        for i, c in enumerate(symbols[first:end].tolist(), first):
            s = successors[s + c]
            if s >= limit:
                own.append(i)
                kinds.append(s // width)
        where.append(np.array(own, np.int64))
        what.append(np.array(kinds, np.int32))
    where, what = np.concatenate(where), np.concatenate(what)
    order = np.argsort(where, kind="stable")
    return where[order], a.rules[what[order]]


class Held:
    """A rule's own automaton, from a given place on."""

    def __init__(self, pattern: str):
        a = compiled([pattern], held=True)
        self.width, self.first = a.successors.shape[1], a.first * a.successors.shape[1]
        self.next, self.classes = (a.successors * self.width).ravel().tolist(), a.classes.tolist()
        self.over = next((s * self.width for s in range(a.first) if (a.successors[s] == s).all()), -1)

    def end(self, text: bytes, at: int) -> int:
        """Behind the last byte at which it accepts, begun at `at`; `at` itself if it never does."""
        s, last, steps, classes = 0, at, self.next, self.classes
        for i in range(at, len(text)):
            s = steps[s + classes[text[i]]]
            if s >= self.first:
                last = i + 1
            elif s == self.over:
                break
        return last


class Finder:
    """The automata of `rules`."""

    def __init__(self, rules: tuple[Rule, ...] = RULES):
        self.rules, self.scanned = rules, compiled([r.whole for r in rules], backwards=True)
        self.whole = [Held(r.whole) for r in rules]
        self.head = [Held(r.head) if r.head else None for r in rules]

    def matches(self, text: bytes, starts: list[int], k: int) -> list[tuple[int, int]]:
        """Spans of rule `k` in `text`, matches of which begin at `starts` (ascending)."""
        out, after = [], 0
        for s in starts:
            if s >= after:
                after = self.whole[k].end(text, s)
                if after - (self.head[k].end(text, s) if self.head[k] else s) >= self.rules[k].least:
                    out.append((s, after))
        return out


def _find(texts: pa.Array, finder: Finder) -> list[list[dict]]:
    texts = texts.fill_null("").cast(pa.large_binary())
    bounds = np.frombuffer(texts.buffers()[1], np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(texts.buffers()[2] or b"", np.uint8)[bounds[0] : bounds[-1]]
    starts = bounds[:-1] - bounds[0] + np.arange(len(texts))  # a line feed after each text
    data = np.insert(raw, bounds[1:] - bounds[0], 10)
    where, what = scan(data[::-1], finder.scanned)
    where, what = len(data) - 1 - where[::-1], what[::-1]
    out: list[list[dict]] = [[] for _ in range(len(texts))]
    rows = np.searchsorted(starts, where, side="right") - 1
    own, first = np.unique(rows, return_index=True)
    for row, at, bits in zip(own.tolist(), np.split(where, first[1:]), np.split(what, first[1:])):
        begin, end = int(starts[row]), int(starts[row + 1]) if row + 1 < len(starts) else len(data)
        at, text = at - begin, data[begin:end].tobytes()
        found = [(s, k, e) for k in range(len(finder.rules)) for s, e in finder.matches(text, at[bits >> k & 1 == 1].tolist(), k)]
        if found:
            points = np.append(0, np.cumsum((data[begin:end] & 0xC0) != 0x80))
            out[row] = [{"kind": finder.rules[k].kind, "start": int(points[s]), "end": int(points[e])} for s, k, e in sorted(found)]
    return out


def with_secrets(df: DataFrame, rules: tuple[Rule, ...] = RULES, at_once: int = 8 << 20) -> DataFrame:
    """`df` (text) with its columns and `secrets`, the spans by start, then rule; about `at_once` bytes are scanned together."""
    finder = Finder(rules)
    at = [f.name for f in df.schema.fields if f.name != "secrets"].index("text")
    span = StructType([StructField("kind", StringType()), StructField("start", LongType()), StructField("end", LongType())])
    kind = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def find(batches):
        for batch in batches:
            sizes = np.cumsum([0, *(x.as_buffer().size if x.is_valid else 0 for x in batch.column(at).cast(pa.large_binary()))])
            i = 0
            while i < batch.num_rows:
                j = max(i + 1, int(np.searchsorted(sizes, sizes[i] + at_once)) - 1)
                some = batch.slice(i, j - i)
                yield some, pa.array(_find(some.column(at), finder), kind)
                i = j

    return with_column(df, find, "secrets", ArrayType(span))


def listed(spans):
    return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"].cast("string"), s["end"].cast("string"))), ",")


def op3_secrets(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts of the base kinds, the digest of their spans, and all spans, for every whole text of `documents`."""
    found = with_secrets(table(spark, sf_dir, "documents").select("doc_id", "text")).select("doc_id", "secrets")
    count = lambda kind: F.size(F.filter("secrets", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")
    base = F.filter("secrets", lambda s: s["kind"].isin(*[r.kind for r in BASE]))
    return found.select("doc_id", *[count(r.kind) for r in BASE], F.sha2(listed(base), 256).alias("base_sha256"), listed(F.col("secrets")).alias("spans"))
