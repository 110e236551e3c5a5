"""Secret scans by one combined deterministic automaton over bytes.

``compile_rules`` parses each rule's regex (ASCII classes, groups, alternation, ``* + ? {m,n}``),
builds one automaton for all rules read backwards, and turns it by subset construction and
partition refinement into minimal transition arrays. Scanning a text from its last byte to its
first marks, in one pass, each place where a match of some rule starts; from the leftmost free
start the rule's own (equally minimised) forward automaton takes the longest match. That gives
the leftmost-longest, non-overlapping matches of every rule. Each rule then drops matches that
are too short (``least`` code points, or bytes of its ``value`` tail).

All offsets are code points, ends exclusive. Nulls: a null text is empty and has no spans;
ids may repeat or be null, each row is scanned by itself, further columns are left aside.
"""

from __future__ import annotations

import hashlib
from dataclasses import dataclass
from functools import lru_cache

from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import map_rows, small_batches, texts


@dataclass(frozen=True)
class Rule:
    """A kind of secret: ``regex`` is its whole form; ``value`` (a class with +) the tail that ``least`` counts, else the whole."""

    kind: str
    regex: str
    least: int = 1
    value: str = ""
    fold: bool = False


VALUE = "[A-Za-z0-9+/_.=-]"
#: The base rules in their order, then what the method adds. The hex rule's
#: maximal runs of 24 or more are the same as maximal runs of which shorter ones are dropped.
RULES = (
    Rule("assign", "(password|passwd|secret|token|api_?key)[\"']?\\x20*[:=]\\x20*[\"']?", 6, VALUE, fold=True),
    Rule("access", "AKIA[A-Z0-9]+", 20),
    Rule("hex", "[0-9a-f]{24,}", 24),
    Rule("github", "gh[pousr]_[A-Za-z0-9]+", 40),
    Rule("jwt", "eyJ[A-Za-z0-9_-]+[.][A-Za-z0-9_-]+[.][A-Za-z0-9_-]+", 29),
    Rule("pem", "-----BEGIN\\x20[A-Z\\x20]*PRIVATE\\x20KEY-----", 27),
)
BASE = ("assign", "access", "hex")


# --- regex -> tree -------------------------------------------------------------------------


class _Parser:
    """A tree of ('set', frozenset of bytes), ('cat', ...), ('alt', ...), ('rep', tree, low, high or None)."""

    def __init__(self, text: str, fold: bool) -> None:
        self.s, self.i, self.fold = text, 0, fold

    def peek(self) -> str:
        return self.s[self.i] if self.i < len(self.s) else ""

    def take(self) -> str:
        self.i += 1
        return self.s[self.i - 1]

    def alternatives(self):
        options = [self.sequence()]
        while self.peek() == "|":
            self.take()
            options.append(self.sequence())
        return options[0] if len(options) == 1 else ("alt", *options)

    def sequence(self):
        parts = []
        while self.peek() and self.peek() not in "|)":
            parts.append(self.repeated())
        return ("cat", *parts)

    def repeated(self):
        node = self.atom()
        while (c := self.peek()) and c in "*+?{":
            self.take()
            if c == "{":
                low, comma, high = self.s[self.i : self.s.index("}", self.i)].partition(",")
                self.i = self.s.index("}", self.i) + 1
                node = ("rep", node, int(low), int(high) if high else None if comma else int(low))
            else:
                node = ("rep", node, int(c == "+"), 1 if c == "?" else None)
        return node

    def escape(self) -> int:
        c = self.take()
        if c == "x":
            self.i += 2
            return int(self.s[self.i - 2 : self.i], 16)
        return ord({"n": "\n", "t": "\t", "r": "\r"}.get(c, c))

    def one(self) -> int:
        c = self.take()
        return self.escape() if c == "\\" else ord(c)

    def atom(self):
        if self.peek() == "(":
            self.take()
            node = self.alternatives()
            self.take()
            return node
        if self.peek() != "[":
            return self.bytes({self.one()})
        self.take()
        negated = self.peek() == "^" and bool(self.take())
        got: set[int] = set()
        while self.peek() != "]":
            low = self.one()
            if self.peek() == "-" and self.s[self.i + 1] != "]":
                self.take()
                got |= set(range(low, self.one() + 1))
            else:
                got.add(low)
        self.take()
        return self.bytes(set(range(256)) - got if negated else got)

    def bytes(self, got: set[int]):
        if max(got, default=0) > 127 and len(got) < 128:
            raise ValueError("rules are ASCII")
        if self.fold:
            got = got | {b ^ 32 for b in got if chr(b & ~32) in "ABCDEFGHIJKLMNOPQRSTUVWXYZ"}
        return ("set", frozenset(got))


def _mirror(node):
    kind = node[0]
    if kind == "cat":
        return ("cat", *(_mirror(x) for x in reversed(node[1:])))
    if kind == "alt":
        return ("alt", *map(_mirror, node[1:]))
    return ("rep", _mirror(node[1]), *node[2:]) if kind == "rep" else node


# --- tree -> nondeterministic automaton ----------------------------------------------------


class _Nfa:
    def __init__(self) -> None:
        self.free: list[list[int]] = []
        self.moves: list[list[tuple[frozenset[int], int]]] = []

    def state(self) -> int:
        self.free.append([])
        self.moves.append([])
        return len(self.free) - 1

    def add(self, node, start: int) -> int:
        """Builds ``node`` from ``start`` on; returns the state after it."""
        kind = node[0]
        if kind == "set":
            end = self.state()
            self.moves[start].append((node[1], end))
            return end
        if kind == "cat":
            for x in node[1:]:
                start = self.add(x, start)
            return start
        if kind == "alt":
            end = self.state()
            for x in node[1:]:
                begin = self.state()
                self.free[start].append(begin)
                self.free[self.add(x, begin)].append(end)
            return end
        _, inner, low, high = node
        for _ in range(low):
            start = self.add(inner, start)
        if high is None:
            loop = self.state()
            self.free[start].append(loop)
            self.free[self.add(inner, loop)].append(loop)
            return loop
        end = self.state()
        self.free[start].append(end)
        for _ in range(high - low):
            start = self.add(inner, start)
            self.free[start].append(end)
        return end

    def closure(self, states) -> frozenset[int]:
        seen, todo = set(states), list(states)
        while todo:
            for x in self.free[todo.pop()]:
                if x not in seen:
                    seen.add(x)
                    todo.append(x)
        return frozenset(seen)


# --- subset construction and minimisation --------------------------------------------------


@dataclass
class Automaton:
    """Transition arrays: ``rows[state][byte]`` is the next state; ``accepts[state]`` a mask of rules. State 0 starts."""

    rows: list[list[int]]
    accepts: list[int]

    def linked(self) -> list[list]:
        """The rows with their successors as rows, at 256 the mask, at 257 whether no match can follow: what the byte loop walks."""
        out: list[list] = [[] for _ in self.rows]
        for s, (row, own, mask) in enumerate(zip(self.rows, out, self.accepts, strict=True)):
            own += [out[x] for x in row]
            own += [mask, not mask and set(row) == {s}]
        return out


def _subsets(nfa: _Nfa, start: int, finals: dict[int, int]) -> Automaton:
    classes: dict[tuple, list[int]] = {}
    sets = list({s for m in nfa.moves for s, _ in m})
    for b in range(256):
        classes.setdefault(tuple(b in s for s in sets), []).append(b)
    first = nfa.closure([start])
    ids, todo, rows, accepts = {first: 0}, [first], [], []
    while todo:
        now = todo.pop(0)
        accepts.append(sum({1 << finals[x] for x in now if x in finals}))
        row = [0] * 256
        for members in classes.values():
            b = members[0]
            to = nfa.closure({t for x in now for s, t in nfa.moves[x] if b in s})
            if to not in ids:
                ids[to] = len(ids)
                todo.append(to)
            for m in members:
                row[m] = ids[to]
        rows.append(row)
    return Automaton(rows, accepts)


def minimised(a: Automaton) -> Automaton:
    """States that no input tells apart become one (partition refinement)."""
    block = a.accepts
    columns = list(dict.fromkeys(zip(*a.rows, strict=True)))
    count = len(set(block))
    while True:
        names: dict[tuple, int] = {}
        block = [names.setdefault((block[s], *(block[c[s]] for c in columns)), len(names)) for s in range(len(a.rows))]
        if len(names) == count:
            break
        count = len(names)
    rows: list = [None] * count
    accepts = [0] * count
    for s, b in enumerate(block):
        if rows[b] is None:
            rows[b], accepts[b] = [block[t] for t in a.rows[s]], a.accepts[s]
    return Automaton(rows, accepts)


def compile_rules(rules: tuple[Rule, ...] = RULES) -> tuple[Automaton, list[Automaton]]:
    """The automaton that marks starts of all rules' matches reading backwards, and each rule's forward one."""
    trees = [_Parser(r.regex + (r.value and f"{r.value}+"), r.fold).alternatives() for r in rules]
    back, finals = _Nfa(), {}
    start = back.state()
    back.moves[start].append((frozenset(range(256)), start))
    for k, t in enumerate(trees):
        begin = back.state()
        back.free[start].append(begin)
        finals[back.add(_mirror(t), begin)] = k
    ahead = []
    for t in trees:
        nfa = _Nfa()
        begin = nfa.state()
        ahead.append(minimised(_subsets(nfa, begin, {nfa.add(t, begin): 0})))
    return minimised(_subsets(back, start, finals)), ahead


class Scanner:
    def __init__(self, rules: tuple[Rule, ...] = RULES) -> None:
        self.rules = rules
        back, ahead = compile_rules(rules)
        self.back = back.linked()[0]
        self.ahead = [a.linked()[0] for a in ahead]
        self.tails = [_Parser(r.value, r.fold).atom()[1] if r.value else None for r in rules]

    def starts(self, data: bytes) -> dict[int, list[int]]:
        """By rule, the offsets where a match starts, ascending."""
        row, marks = self.back, []
        at = len(data)
        for b in reversed(data):
            row = row[b]
            at -= 1
            if row[256]:
                marks.append((at, row[256]))
        out: dict[int, list[int]] = {}
        for at, mask in reversed(marks):
            for k in range(len(self.rules)):
                if mask >> k & 1:
                    out.setdefault(k, []).append(at)
        return out

    def matches(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, rule, end) in bytes, by start and then rule."""
        found = []
        for k, places in self.starts(data).items():
            free, rule, first = 0, self.rules[k], self.ahead[k]
            for at in places:
                if at < free:
                    continue
                row, end = first, at
                for i in range(at, len(data)):
                    row = row[data[i]]
                    if row[256]:
                        end = i + 1
                    elif row[257]:
                        break
                free = end
                length = end - at
                if tail := self.tails[k]:
                    length = self._tail(data, at, end, k)
                if length >= rule.least:
                    found.append((at, k, end))
        return sorted(found)

    def _tail(self, data: bytes, at: int, end: int, k: int) -> int:
        """Bytes of the value: what follows the first delimiter, spaces and quote."""
        i = at
        while data[i] not in b":=":
            i += 1
        i += 1
        while data[i] == 32:
            i += 1
        return end - i - (data[i] in b"\"'")

    def spans(self, text: str) -> list[tuple[str, int, int]]:
        """(kind, start, end) in code points, by start and then rule."""
        data = text.encode("utf-8", "surrogatepass")
        found = self.matches(data)
        if not found:
            return []
        if len(data) == len(text):
            return [(self.rules[k].kind, a, b) for a, k, b in found]
        out, seen, chars = [], 0, 0
        for a, k, b in found:
            chars += len(data[seen:a].decode("utf-8", "surrogatepass"))
            seen = a
            out.append((self.rules[k].kind, chars, chars + b - a))  # matches are ASCII
        return out


@lru_cache(maxsize=4)
def scanner(rules: tuple[Rule, ...] = RULES) -> Scanner:
    return Scanner(rules)


def scan(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Rows (key, spans: array of (kind, start, end)) of each text."""
    small_batches(df.sparkSession)
    kind = df.schema[key].dataType.simpleString()

    def run(keys: list, items: list) -> list[tuple]:
        s = scanner(rules)
        return [(k, [{"kind": a, "start": b, "end": c} for a, b, c in s.spans(t)]) for k, t in zip(keys, items, strict=True)]

    return map_rows(texts(df, key, text=text), run, f"`{key}` {kind}, spans array<struct<kind:string,start:long,end:long>>")


def redacted(text: str, rules: tuple[Rule, ...] = RULES) -> str:
    """The text with each secret replaced by its kind in brackets; overlapping spans become one."""
    out, done = [], 0
    for kind, a, b in scanner(rules).spans(text):
        if a >= done:
            out += [text[done:a], f"[{kind}]"]
        done = max(done, b)
    return "".join([*out, text[done:]])


def redact(df: DataFrame, text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """All rows and columns, secrets replaced in the text; null texts stay null. ``n_chars`` follows, where there is one."""
    small_batches(df.sparkSession)
    kinds = ", ".join(f"`{f.name}` {f.dataType.simpleString()}" for f in df.schema)
    at = df.columns.index(text)
    count = df.columns.index("n_chars") if "n_chars" in df.columns else None

    def run(*cols: list) -> list[tuple]:
        cols = list(cols)
        new = [None if t is None else redacted(t, rules) for t in cols[at]]
        if count is not None:
            cols[count] = [n if a == b else len(b) for n, a, b in zip(cols[count], cols[at], new, strict=True)]
        cols[at] = new
        return list(zip(*cols, strict=True))

    return map_rows(df, run, kinds)


def digests(df: DataFrame, key: str = "doc_id", text: str = "text", rules: tuple[Rule, ...] = RULES) -> DataFrame:
    """Counts by base kind, the digest of the base spans, and all spans as text."""

    def joined(spans):
        return F.array_join(F.transform(spans, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")

    found = scan(df, key, text, rules)
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))
    count = lambda kind: F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long")
    return found.select(
        key, *(count(k).alias(f"n_{k}") for k in BASE), F.sha2(joined(base), 256).alias("base_sha256"), joined(F.col("spans")).alias("spans")
    )
