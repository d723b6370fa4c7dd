"""Secret scan: all rules in one deterministic automaton over bytes.

Rules are regular expressions over bytes. Each is parsed to a non-deterministic automaton;
the subset construction over all of them together gives one deterministic automaton, which
partition refinement makes minimal and numbers as one transition array. It is built from the
reversed rules and runs once over the bytes of a text from the end to the start, so its marked
states say at which byte a match of which rule begins. From the leftmost of these the rule's
own forward automaton runs to the longest end; matches of a rule don't overlap, and
a match that its length limits fail is dropped, as it is where an expression engine scans.

The automata are compiled on the driver and travel with the function as arrays; a rule set whose
automaton would have more than ``MOST_STATES`` states is refused there. A document is one row in
and one row out; there is no shuffle. Null and empty texts have no spans, an empty table gives an
empty table, and further columns are kept as they are by ``redact``, whatever their names.
"""

from __future__ import annotations

import hashlib
import re
from array import array
from dataclasses import dataclass, field
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from tidemark.llm.shared import arrow


@dataclass(frozen=True)
class Rule:
    """``tail`` is the shape of a match's last part, ``least_tail`` how long that must be.

    ``head`` may be given where the rest of the pattern can be empty: a match then begins where
    the head matches, so only the head goes into the automaton that looks for beginnings.
    """

    kind: str
    pattern: str
    least: int = 1
    tail: str = ""
    least_tail: int = 0
    head: str = ""


#: A private key from its BEGIN line to the END line, whatever stands between them except five dashes. Where
#: the END line is missing, the header lines and the runs of 16 or more base64 characters that follow. What separates
#: these shares no character with them (a + only right behind a line break), which keeps the automaton small.
_PEM_BEGIN = "-----BEGIN [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
_PEM = (_PEM_BEGIN + r"(?:(?:[^-]|-{1,4}[^-])*-----END [A-Z0-9 ]*PRIVATE KEY(?: BLOCK)?-----"
        r"|(?:(?:[\x20\t\r\"',>#|]|\n\+?|\\[nr])+(?:[A-Za-z0-9-]+:\x20[^\r\n\\]*|=?[A-Za-z0-9+/]{16,}={0,2}))*)")

#: States of one automaton, before states that no text tells apart are merged; beyond that a rule is an error.
MOST_STATES = 4096

#: The base kinds, in their order, then what this scan adds.
RULES = (
    Rule("assign", r"""(?i:password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?[A-Za-z0-9+/_.=-]+""",
         tail=r"""[:=]\x20*["']?""", least_tail=6),
    Rule("access", r"AKIA[A-Z0-9]+", least=20),
    Rule("hex", r"[0-9a-f]{24,}"),
    Rule("private_key", _PEM, head=_PEM_BEGIN),
    Rule("forge_token", r"gh[pousr]_[A-Za-z0-9]+", least=40),
    Rule("chat_token", r"xox[baprs]-[A-Za-z0-9-]+", least=20),
    Rule("web_token", r"eyJ[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+\.[A-Za-z0-9_-]+", least=40),
)
BASE = ("assign", "access", "hex")


# ---- parsing: a tree of ("set", bytes) | ("cat", ..) | ("or", ..) | ("rep", node, low, high)

class _Parser:
    def __init__(self, pattern: str) -> None:
        self.s, self.i, self.fold = pattern, 0, False

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def either(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return ("or", *options) if len(options) > 1 else options[0]

    def sequence(self):
        parts = []
        while self.peek() not in ("", "|", ")"):
            parts.append(self.repeated(self.atom()))
        return ("cat", *parts)

    def atom(self):
        c = self.take()
        if c == "(":
            fold = self.fold
            if self.s.startswith("?i:", self.i):
                self.i, self.fold = self.i + 3, True
            elif self.s.startswith("?:", self.i):
                self.i += 2
            inner = self.either()
            if not self.peek():
                raise ValueError("missing )")
            self.take()
            self.fold = fold
            return inner
        if c == "[":
            return self.charset()
        if c == ".":
            return ("set", frozenset(range(256)) - {10})
        return self.folded({self.escaped() if c == "\\" else ord(c)})

    def escaped(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2:self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def charset(self):
        negated = self.peek() == "^"
        if negated:
            self.take()
        found: set[int] = set()
        while self.peek() != "]":
            c = self.take()
            low = self.escaped() if c == "\\" else ord(c)
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                c = self.take()
                found.update(range(low, (self.escaped() if c == "\\" else ord(c)) + 1))
            else:
                found.add(low)
        self.take()
        return ("set", frozenset(range(256)) - found) if negated else self.folded(found)

    def folded(self, found: set[int]):
        if self.fold:
            found |= {ord(chr(b).swapcase()) for b in found if b < 128}
        return ("set", frozenset(found))

    def repeated(self, node):
        while self.peek() and self.peek() in "?*+{":
            c = self.take()
            low, high = {"?": (0, 1), "*": (0, None), "+": (1, None)}.get(c, (0, 0))
            if c == "{":
                body = self.s[self.i:self.s.index("}", self.i)]
                self.i += len(body) + 1
                a, comma, b = body.partition(",")
                low, high = int(a), (int(b) if b else None) if comma else int(a)
            node = ("rep", node, low, high)
        return node


def parse(pattern: str):
    parser = _Parser(pattern)
    tree = parser.either()
    if parser.i < len(pattern):
        raise ValueError(f"unbalanced ) in {pattern}")
    return tree


def _mirrored(tree):
    if tree[0] == "set":
        return tree
    if tree[0] == "rep":
        return ("rep", _mirrored(tree[1]), *tree[2:])
    parts = [_mirrored(x) for x in tree[1:]]
    return (tree[0], *(reversed(parts) if tree[0] == "cat" else parts))


@dataclass
class _Net:
    """A non-deterministic automaton: moves on sets of bytes, and free moves."""

    moves: list[list[tuple[frozenset, int]]] = field(default_factory=list)
    free: list[list[int]] = field(default_factory=list)

    def state(self) -> int:
        self.moves.append([])
        self.free.append([])
        return len(self.moves) - 1

    def add(self, tree, at: int) -> int:
        """Build a tree behind a state; returns the state behind the tree."""
        if tree[0] == "set":
            to = self.state()
            self.moves[at].append((tree[1], to))
            return to
        if tree[0] == "cat":
            for part in tree[1:]:
                at = self.add(part, at)
            return at
        if tree[0] == "or":
            to = self.state()
            for part in tree[1:]:
                own = self.state()
                self.free[at].append(own)
                self.free[self.add(part, own)].append(to)
            return to
        _, part, low, high = tree
        for _ in range(low):
            at = self.add(part, at)
        to = self.state()
        if high is None:
            loop = self.state()
            self.free[at].append(loop)
            self.free[self.add(part, loop)].append(loop)
            self.free[loop].append(to)
            return to
        self.free[at].append(to)
        for _ in range(high - low):
            at = self.add(part, at)
            self.free[at].append(to)
        return to

    def closed(self, states) -> frozenset:
        found, todo = set(states), list(states)
        while todo:
            for to in self.free[todo.pop()]:
                if to not in found:
                    found.add(to)
                    todo.append(to)
        return frozenset(found)


@dataclass
class Automaton:
    """``table[state * 256 + byte]`` is the next state times 256; states are ordered so that
    those from ``marked`` on end a match, and ``rules[state]`` has a bit for each rule."""

    table: array
    rules: array
    start: int
    marked: int
    dead: int


def compile_rules(patterns: list[str], backward: bool, anywhere: bool) -> Automaton:
    """Subset construction over all patterns together, then minimisation.

    ``backward`` mirrors them; with ``anywhere`` a match may begin at every byte. More than
    ``MOST_STATES`` states are a ValueError.
    """
    net, ends, begins = _Net(), {}, []
    for k, pattern in enumerate(patterns):
        tree = parse(pattern)
        begins.append(net.state())
        ends[net.add(_mirrored(tree) if backward else tree, begins[-1])] = k
    first = net.closed(begins)
    if any(x in ends for x in first):
        raise ValueError("a rule that matches nothing at all finds everything")
    known, rows, todo = {first: 0}, [], [first]
    while todo:
        own = todo.pop(0)
        targets: list[set[int]] = [set(first) if anywhere else set() for _ in range(256)]
        for state in own:
            for on, to in net.moves[state]:
                for b in on:
                    targets[b].add(to)
        row, seen = [], {}
        for goal in targets:
            key = frozenset(goal)
            if key not in seen:
                closed = net.closed(key)
                if closed not in known:
                    if len(known) == MOST_STATES:
                        raise ValueError(f"more than {MOST_STATES} states: {', '.join(patterns)[:200]}")
                    known[closed] = len(known)
                    todo.append(closed)
                seen[key] = known[closed]
            row.append(seen[key])
        rows.append(row)
    bits = np.zeros(len(known), np.int64)
    for states, i in known.items():
        for state in states:
            if state in ends:
                bits[i] |= 1 << ends[state]
    return _minimal(np.array(rows), bits)


def _minimal(rows: np.ndarray, bits: np.ndarray) -> Automaton:
    """Merge states that no text can tell apart: classes are split until nothing changes."""
    group = np.unique(bits, return_inverse=True)[1]
    while True:
        finer = np.unique(np.column_stack([group, group[rows]]), axis=0, return_inverse=True)[1].ravel()
        if finer.max() == group.max():
            break
        group = finer
    sample = np.unique(group, return_index=True)[1]
    order = np.argsort(bits[sample] > 0, kind="stable")  # those that end a match come last
    place = np.empty(len(order), np.int64)
    place[order] = np.arange(len(order))
    table = place[group[rows[sample[order]]]]
    rules = bits[sample[order]]
    stays = (table == np.arange(len(table))[:, None]).all(1) & (rules == 0)
    dead = int(np.flatnonzero(stays)[0]) if stays.any() else -1
    return Automaton(array("i", (table * 256).ravel().tolist()), array("q", rules.tolist()), int(place[group[0]]) * 256,
                     int((rules == 0).sum()) * 256, dead * 256)


class Scanner:
    """The compiled rules."""

    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        self.back = compile_rules([r.head or r.pattern for r in rules], backward=True, anywhere=True)
        self.ahead = [compile_rules([r.pattern], backward=False, anywhere=False) for r in rules]
        self.tails = [re.compile(r.tail.encode()) if r.tail else None for r in rules]

    def begins(self, raw: bytes) -> list[tuple[int, int]]:
        """(byte, rules as bits) wherever a match begins, from the left: the one pass."""
        table, state, marked = self.back.table, self.back.start, self.back.marked
        found, i = [], len(raw)
        for byte in reversed(raw):
            i -= 1
            state = table[state + byte]
            if state >= marked:
                found.append((i, self.back.rules[state >> 8]))
        found.reverse()
        return found

    def _longest(self, rule: int, raw: bytes, at: int) -> int:
        own = self.ahead[rule]
        table, state, end = own.table, own.start, at
        for i in range(at, len(raw)):
            state = table[state + raw[i]]
            if state >= own.marked:
                end = i + 1
            elif state == own.dead:
                break
        return end

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in characters, by start and then in the order of the rules."""
        raw = text.encode()
        free = [0] * len(self.rules)
        out = []
        for at, bits in self.begins(raw):
            for k, rule in enumerate(self.rules):
                if bits >> k & 1 and at >= free[k]:
                    free[k] = end = self._longest(k, raw, at)
                    tail = self.tails[k].search(raw, at, end).end() if self.tails[k] else at
                    if end - at >= rule.least and end - tail >= rule.least_tail:
                        out.append((at, k, end))
        if len(raw) == len(text):
            return [(self.rules[k].kind, a, b) for a, k, b in sorted(out)]
        return [(self.rules[k].kind, len(raw[:a].decode()), len(raw[:b].decode())) for a, k, b in sorted(out)]


@cache
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


_SPANS = "array<struct<kind: string, start: bigint, end: bigint>>"


def find(rules: tuple[Rule, ...] = RULES):
    """A function of a text column: the spans of all rules."""
    own = scanner(rules)

    @arrow(_SPANS)
    def spans(texts: pa.Array) -> pa.Array:
        return pa.array([[{"kind": k, "start": a, "end": b} for k, a, b in own.spans(x.as_py() or "")]
                         for x in texts],
                        pa.list_(pa.struct([("kind", pa.string()), ("start", pa.int64()), ("end", pa.int64())])))
    return spans


def redact(documents: DataFrame, mark: str = "[secret]", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Documents with each span replaced by ``mark``; overlapping spans become one.

    A column n_chars, where there is one, follows the text. Null texts stay null.
    """
    own = scanner(rules)

    @arrow("string")
    def cleaned(texts: pa.Array) -> pa.Array:
        out = []
        for x in texts:
            text = x.as_py()
            left, parts = 0, []
            for _, a, b in own.spans(text or ""):
                if a >= left:
                    parts += [text[left:a], mark]
                left = max(left, b)
            out.append("".join([*parts, text[left:]]) if parts else text)
        return pa.array(out, pa.string())

    out = documents.withColumn("text", cleaned("text"))
    return out.withColumn("n_chars", F.length("text").cast("long")) if "n_chars" in documents.columns else out


def report(documents: DataFrame, rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """One row per document: base counts, a digest of the base spans, and all spans."""
    @arrow("n_assign bigint, n_access bigint, n_hex bigint, base_sha256 string, spans string")
    def told(spans: pa.Array) -> pa.Array:
        rows = []
        for found in spans.to_pylist():
            text = [f"{x['kind']}:{x['start']}:{x['end']}" for x in found]
            base = ",".join(t for t, x in zip(text, found) if x["kind"] in BASE)
            rows.append({f"n_{k}": sum(x["kind"] == k for x in found) for k in BASE}
                        | {"base_sha256": hashlib.sha256(base.encode()).hexdigest(), "spans": ",".join(text)})
        return pa.array(rows, pa.struct([*((f"n_{k}", pa.int64()) for k in BASE), ("base_sha256", pa.string()),
                                         ("spans", pa.string())]))

    return (documents.select("doc_id", told(find(rules)("text")).alias("s"))
            .select("doc_id", "s.*"))
