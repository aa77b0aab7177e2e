"""Secrets in texts: all rules in one deterministic automaton, one pass over the bytes."""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass
from functools import cache

import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import quoted, text_of

# Sets of bytes by the letter that stands for them in the rules below.
DIGITS, LOWER = b"0123456789", b"abcdefghijklmnopqrstuvwxyz"
UPPER = LOWER.upper()
WORD = DIGITS + LOWER + UPPER


@dataclass(frozen=True)
class Rule:
    """A pattern as a tree of tuples, the least length of its last run, and whether base or added.

    ("set", bytes), ("seq", ...), ("alt", ...), ("opt", x), ("star", x), ("plus", x). If
    ``least_value`` is above 0, the match counts only if that many bytes at its end follow
    the point where it first was a match (that byte included).
    """

    kind: str
    tree: tuple
    least_value: int = 0
    least_length: int = 0


def one(letters: bytes) -> tuple:
    return ("set", letters)


def word(text: str, fold: bool = False) -> tuple:
    """The letters of a text, in either case if ``fold``."""
    each = [c.lower() + c.upper() if fold and c.lower() != c.upper() else c for c in text]
    return ("seq", *(one(c.encode()) for c in each))


def many(letters: bytes, least: int) -> tuple:
    return ("seq", *[one(letters)] * (least - 1), ("plus", one(letters)))


def _assign() -> tuple:
    names = [word(n, True) for n in ("password", "passwd", "secret", "token")]
    api_key = ("seq", word("api", True), ("opt", one(b"_")), word("key", True))
    quote, spaces = ("opt", one(b"\"'")), ("star", one(b" "))
    value = ("plus", one(WORD + b"+/_.=-"))
    return ("seq", ("alt", *names, api_key), quote, spaces, one(b":="), spaces, quote, value)


def _signed() -> tuple:
    run = ("plus", one(WORD + b"_-"))
    return ("seq", word("eyJ"), run, word(".eyJ"), run, word("."), run)


BASE = (
    Rule("assign", _assign(), least_value=8),
    Rule("access", ("seq", word("AKIA"), ("plus", one(UPPER + DIGITS))), least_length=16),
    Rule("hex", many(DIGITS + b"abcdef", 32)),
)
# Open-ended runs with a least length of the whole match keep the automaton small.
ADDED = (
    Rule("private_key", ("seq", word("-----BEGIN "), ("star", one(UPPER + b" ")), word("PRIVATE KEY-----"))),
    Rule("code_host", ("seq", word("gh"), one(b"pousr"), word("_"), ("plus", one(WORD))), least_length=40),
    Rule("chat_bot", ("seq", word("xox"), one(b"abprs"), word("-"), ("plus", one(WORD + b"-"))), least_length=15),
    Rule("map_key", ("seq", word("AIza"), ("plus", one(WORD + b"_-"))), least_length=39),
    Rule("signed_token", _signed(), least_length=30),
)
RULES = BASE + ADDED


class Nfa:
    """States with byte-set moves and empty moves."""

    def __init__(self):
        self.moves: list[list[tuple[bytes, int]]] = []
        self.empty: list[list[int]] = []

    def state(self) -> int:
        self.moves.append([])
        self.empty.append([])
        return len(self.moves) - 1

    def build(self, tree: tuple, start: int, reverse: bool) -> int:
        """Adds the pattern behind ``start``; the state where it ends."""
        what, *parts = tree
        if what == "set":
            end = self.state()
            self.moves[start].append((parts[0], end))
            return end
        if what == "seq":
            for part in reversed(parts) if reverse else parts:
                start = self.build(part, start, reverse)
            return start
        if what == "alt":
            end = self.state()
            for part in parts:
                self.empty[self.build(part, start, reverse)].append(end)
            return end
        if what == "opt":
            end = self.state()
            self.empty[self.build(parts[0], start, reverse)].append(end)
            self.empty[start].append(end)
            return end
        loop = self.state()
        self.empty[start].append(loop)
        back = self.build(parts[0], loop, reverse)
        if what == "star":
            self.empty[back].append(loop)
            return loop
        end = self.state()
        self.empty[back] += [loop, end]
        return end

    def closure(self, states: frozenset[int]) -> frozenset[int]:
        seen, stack = set(states), list(states)
        while stack:
            for target in self.empty[stack.pop()]:
                if target not in seen:
                    seen.add(target)
                    stack.append(target)
        return frozenset(seen)


class Dfa:
    """Transition array (state * 256 + byte -> state * 256) and the rules accepted by each state.

    Subset construction over byte classes, then minimisation by refining the partition of states
    until no byte tells two states of one block apart. Accepting states have the highest numbers, so
    that a scan tells them by one comparison.
    """

    def __init__(self, trees: list[tuple], *, anywhere: bool, reverse: bool):
        nfa, ends = Nfa(), {}
        root = nfa.state()
        for number, tree in enumerate(trees):
            start = nfa.state()
            nfa.empty[root].append(start)
            ends[nfa.build(tree, start, reverse)] = number
        begin = nfa.closure(frozenset([root]))
        classes: dict[tuple, list[int]] = {}
        sets = sorted({letters for moves in nfa.moves for letters, _ in moves})
        for byte in range(256):
            classes.setdefault(tuple(byte in s for s in sets), []).append(byte)
        groups = list(classes.values())
        numbers, todo, table = {begin: 0}, [begin], []
        while todo:
            states = todo.pop(0)
            row = []
            for group in groups:
                targets = {t for s in states for letters, t in nfa.moves[s] if group[0] in letters}
                targets |= begin if anywhere else set()
                target = nfa.closure(frozenset(targets))
                if target not in numbers:
                    numbers[target] = len(numbers)
                    todo.append(target)
                row.append(numbers[target])
            table.append(row)
        accepted = [frozenset(ends[s] for s in states if s in ends) for states in numbers]
        block = self._minimise(table, accepted)
        first: dict[int, int] = {}
        for state, b in enumerate(block):
            first.setdefault(b, state)
        order = sorted(first, key=lambda b: (bool(accepted[first[b]]), b))
        place = {b: n for n, b in enumerate(order)}
        self.states = len(order)
        self.moves = [0] * (256 * self.states)
        for b, state in first.items():
            for group, target in zip(groups, table[state]):
                for byte in group:
                    self.moves[256 * place[b] + byte] = 256 * place[block[target]]
        self.start = 256 * place[block[0]]
        self.rules = {256 * place[b]: accepted[first[b]] for b in order if accepted[first[b]]}
        self.least_accepting = min(self.rules)
        dead = [b for b in order if not accepted[first[b]] and {block[t] for t in table[first[b]]} == {b}]
        self.dead = 256 * place[dead[0]] if dead else -1

    @staticmethod
    def _minimise(table: list[list[int]], accepted: list[frozenset]) -> list[int]:
        names: dict = {}
        block = [names.setdefault(a, len(names)) for a in accepted]
        while True:
            names = {}
            finer = [
                names.setdefault((block[s], *(block[t] for t in row)), len(names))
                for s, row in enumerate(table)
            ]
            if len(names) == len(set(block)):
                return finer
            block = finer


class Scanner:
    def __init__(self, rules: tuple[Rule, ...]):
        self.rules = rules
        trees = [rule.tree for rule in rules]
        # Read backwards, the union automaton accepts where a match begins.
        self.starts = Dfa(trees, anywhere=True, reverse=True)
        self.ends = [Dfa([tree], anywhere=False, reverse=False) for tree in trees]

    def begins(self, data: bytes) -> dict[int, list[int]]:
        """The rules' positions at which a match begins, ascending: one pass over the bytes."""
        moves, least, state, hits = self.starts.moves, self.starts.least_accepting, self.starts.start, []
        left = len(data)
        for byte in reversed(data):
            left -= 1
            state = moves[state + byte]
            if state >= least:
                hits.append((left, state))
        found: dict[int, list[int]] = {}
        for at, state in reversed(hits):
            for rule in self.starts.rules[state]:
                found.setdefault(rule, []).append(at)
        return found

    def _match(self, data: bytes, start: int, rule: int) -> tuple[int, int]:
        """(end of the longest match, where it first was one)"""
        dfa = self.ends[rule]
        moves, state, end, first = dfa.moves, dfa.start, -1, -1
        for at in range(start, len(data)):
            state = moves[state + data[at]]
            if state in dfa.rules:
                end = at + 1
                first = at if first < 0 else first
            elif state == dfa.dead:
                break
        return end, first

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start, then kind as listed: for each kind the
        leftmost longest matches that do not overlap, without those that are too short."""
        data = text.encode()
        found = []
        for rule, starts in self.begins(data).items():
            free = 0
            for start in starts:
                if start < free:
                    continue
                end, first = self._match(data, start, rule)
                free = end
                wanted = self.rules[rule]
                if end - first >= wanted.least_value and end - start >= wanted.least_length:
                    found.append((start, rule, end))
        found.sort()
        if len(data) != len(text):
            found = self._in_code_points(data, found)
        return [(self.rules[rule].kind, start, end) for start, rule, end in found]

    @staticmethod
    def _in_code_points(data: bytes, found: list[tuple[int, int, int]]) -> list[tuple[int, int, int]]:
        places, at, count = {}, 0, 0
        for place in sorted({p for start, _, end in found for p in (start, end)}):
            count += len(data[at:place].decode())
            places[place], at = count, place
        return [(places[start], rule, places[end]) for start, rule, end in found]


@cache
def scanner(rules: tuple[Rule, ...]) -> Scanner:
    return Scanner(rules)


def find_secrets(
    docs: DataFrame, rules: tuple[Rule, ...] = RULES, *, key: str = "doc_id", text: str = "text"
) -> DataFrame:
    """(key, spans), one row per row of ``docs``; spans are (kind, start, end) in code points, end
    exclusive, sorted by start, then by kind in the order of the rules.

    Per kind these are the leftmost longest matches that do not overlap; a match that is too short
    hides what it covers and is left out. Null and empty texts have none; whole texts are read, in
    time proportional to their length; keys may repeat or be null, other columns are not looked at.
    """
    spans = pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())]))

    def scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        scanning = scanner(rules)
        for batch in batches:
            found = [
                [{"kind": k, "start": s, "end": e} for k, s, e in scanning.spans(text.as_py())]
                for text in batch.column(1)
            ]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, spans)], ["key", "spans"])

    kinds = "key long, spans array<struct<kind:string,start:bigint,end:bigint>>"
    return (
        docs.select(quoted(key).cast("long").alias("key"), text_of(text).alias("text"))
        .mapInArrow(scan, kinds)
        .withColumnRenamed("key", key)
    )


def joined(spans):
    """Spans as comma-joined kind:start:end."""
    return F.array_join(
        F.transform(
            spans,
            lambda s: F.concat(s["kind"], F.lit(":"), s["start"].cast("string"), F.lit(":"), s["end"].cast("string")),
        ),
        ",",
    )


def span_digest(found: DataFrame, key: str = "doc_id") -> DataFrame:
    """Counts and digest of the base kinds and all spans as text."""
    base = [rule.kind for rule in BASE]
    kept = F.filter("spans", lambda s: s["kind"].isin(base))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key,
        *[count(kind).alias(f"n_{kind}") for kind in base],
        F.sha2(joined(kept), 256).alias("base_sha256"),
        joined(F.col("spans")).alias("spans"),
    )
