"""Secret scanning with one combined deterministic automaton.

The rules are written as small regular expressions over bytes.  They are
compiled together: Thompson fragments, subset construction over byte classes,
then minimisation by partition refinement, into one flat transition array.  A
document's UTF-8 bytes are read once through that array, for all rules at a
time.  A second array, made the same way from the reversed rules, walks back
from the end of a match to its leftmost start; it reads matched bytes only.
"""

from __future__ import annotations

import hashlib
from collections.abc import Iterator

import pyarrow as pa
from pyspark.sql import DataFrame, functions as F

UPPER = frozenset(range(65, 91))
LOWER = frozenset(range(97, 123))
DIGIT = frozenset(range(48, 58))
ALNUM = UPPER | LOWER | DIGIT
VALUE = ALNUM | frozenset(b"+/_.=-")
URL64 = ALNUM | frozenset(b"_-")



def one(chars) -> tuple:
    return ("set", frozenset(chars if not isinstance(chars, bytes) else chars))


def cat(*parts) -> tuple:
    return ("cat", parts)


def alt(*parts) -> tuple:
    return ("or", parts)


def word(text: str, fold: bool = False) -> tuple:
    return cat(*[one({ord(c), ord(c.upper()), ord(c.lower())} if fold else {ord(c)}) for c in text])


def times(x, least: int, most: int | None = None) -> tuple:
    tail = [("*", x)] if most is None else [("?", x)] * (most - least)
    return cat(*[x] * least, *tail)


QUOTE, SPACE = ("?", one(b"\"'")), ("*", one(b" "))
SEPARATOR = cat(QUOTE, SPACE, one(b":="), SPACE, QUOTE)
KEYWORD = alt(*[word(w, fold=True) for w in ("password", "passwd", "secret", "token", "apikey", "api_key")])
#: Kinds in the order in which they are listed; the first three are the base ones.
RULES: dict[str, tuple] = {
    "assign": cat(KEYWORD, SEPARATOR, times(one(VALUE), 1)),
    "access": cat(word("AKIA"), times(one(UPPER | DIGIT), 1)),
    "hex": times(one(DIGIT | frozenset(b"abcdef")), 5),
    "private_key": cat(word("-----BEGIN "), ("*", one(UPPER | frozenset(b" "))), word("PRIVATE KEY-----")),
    "forge_token": cat(word("gh"), one(b"pousr"), word("_"), times(one(ALNUM), 1)),
    "web_token": cat(word("eyJ"), times(one(URL64), 1), word("."), times(one(URL64), 1), word("."), times(one(URL64), 1)),
    "chat_token": cat(word("xox"), one(b"abprs"), word("-"), times(one(ALNUM | frozenset(b"-")), 1)),
    "pay_key": cat(alt(word("sk_live_"), word("rk_live_")), times(one(ALNUM), 1)),
}
BASE = ("assign", "access", "hex")
#: An assigned value has so many characters at least; shorter ones are matches that are dropped.
LEAST_VALUE = 12
#: So many bytes has a whole match at least; counters in the automaton would multiply its states.
LEAST = {"access": 18, "hex": 16, "forge_token": 34, "web_token": 29, "chat_token": 15, "pay_key": 24}


def _reverse(x: tuple) -> tuple:
    kind, body = x
    if kind == "cat":
        return (kind, tuple(_reverse(p) for p in reversed(body)))
    if kind == "or":
        return (kind, tuple(_reverse(p) for p in body))
    return x if kind == "set" else (kind, _reverse(body))


class _Nfa:
    def __init__(self):
        self.eps: list[list[int]] = []
        self.on: list[list[tuple[frozenset, int]]] = []

    def state(self) -> int:
        self.eps.append([])
        self.on.append([])
        return len(self.eps) - 1

    def add(self, x: tuple, start: int) -> int:
        """Builds x from a start state; returns its end."""
        kind, body = x
        if kind == "set":
            end = self.state()
            self.on[start].append((body, end))
            return end
        if kind == "cat":
            for part in body:
                start = self.add(part, start)
            return start
        if kind == "or":
            end = self.state()
            for part in body:
                at = self.state()
                self.eps[start].append(at)
                self.eps[self.add(part, at)].append(end)
            return end
        loop, end = self.state(), self.state()
        self.eps[start] += [loop, end]
        last = self.add(body, loop)
        self.eps[last] += [loop, end] if kind == "*" else [end]
        return end

    def closure(self, states) -> frozenset:
        seen, todo = set(states), list(states)
        while todo:
            for t in self.eps[todo.pop()]:
                if t not in seen:
                    seen.add(t)
                    todo.append(t)
        return frozenset(seen)


class Dfa:
    """Flat transitions: ``table[state + byte]`` with states that are multiples of 256.

    Accepting states come last, from ``accepting`` on; ``marks[state]`` has the
    bits of the rules that end there.  The dead state, if any, is ``dead``.
    """

    def __init__(self, rules: list[tuple], anywhere: bool):
        nfa = _Nfa()
        root = nfa.state()
        ends = {}
        for i, rule in enumerate(rules):
            at = nfa.state()
            nfa.eps[root].append(at)
            ends[nfa.add(rule, at)] = 1 << i
        classes = self._byte_classes(nfa)
        # sets of states as bits; each state's targets, closed, are made once for each byte class
        bits = lambda states: sum(1 << s for s in states)
        begin = bits(nfa.closure([root]))
        step = [[bits(nfa.closure({t for chars, t in on if byte in chars})) for byte in classes[1]] for on in nfa.on]
        ended = bits(ends)
        index, rows, marks, todo = {begin: 0}, [], [], [begin]
        while len(rows) < len(todo):
            now, members, row = todo[len(rows)], [], [begin if anywhere else 0] * len(classes[1])
            rest = now
            while rest:
                low = rest & -rest
                members.append(low.bit_length() - 1)
                rest ^= low
            for s in members:
                if nfa.on[s]:
                    row = [a | b for a, b in zip(row, step[s], strict=True)]
            for nxt in row:
                if nxt not in index:
                    index[nxt] = len(todo)
                    todo.append(nxt)
            rows.append([index[x] for x in row])
            marks.append(sum(ends[s] for s in members if ended >> s & 1))
        group = self._minimised(rows, marks)
        order = sorted(set(group), key=lambda g: (marks[group.index(g)] != 0, g != group[0], g))
        place = {g: i for i, g in enumerate(order)}
        some = {g: group.index(g) for g in order}
        self.table = [place[group[rows[some[g]][c]]] * 256 for g in order for c in classes[0]]
        self.marks = {place[g] * 256: marks[some[g]] for g in order}
        self.accepting = min((s for s, m in self.marks.items() if m), default=len(self.table))
        self.start = place[group[0]] * 256
        self.dead = next((s for s, m in self.marks.items() if not m and all(t == s for t in self.table[s : s + 256])), -1)

    @staticmethod
    def _byte_classes(nfa: _Nfa) -> tuple[list[int], list[int]]:
        """The class of each byte, and a byte of each class: bytes that no rule tells apart are one."""
        sets = sorted({chars for on in nfa.on for chars, _ in on}, key=sorted)
        seen: dict[tuple, int] = {}
        of = [seen.setdefault(tuple(b in s for s in sets), len(seen)) for b in range(256)]
        return of, [of.index(c) for c in range(len(seen))]

    @staticmethod
    def _minimised(rows: list[list[int]], marks: list[int]) -> list[int]:
        """Groups of equivalent states: refined by the groups they lead to until nothing changes."""
        group = marks
        while True:
            seen: dict[tuple, int] = {}
            new = [seen.setdefault((group[i], *[group[t] for t in row]), len(seen)) for i, row in enumerate(rows)]
            if len(seen) == len(set(group)):
                return new
            group = new


class Scanner:
    def __init__(self, rules: dict[str, tuple]):
        self.kinds = list(rules)
        self.forward = Dfa(list(rules.values()), anywhere=True)
        self.back = [Dfa([_reverse(r)], anywhere=False) for r in rules.values()]

    def ends(self, data: bytes) -> list[tuple[int, int]]:
        """(end, rule) wherever a rule's match can't go on: one pass over the bytes."""
        table, accepting, marks, state, was, out = self.forward.table, self.forward.accepting, self.forward.marks, self.forward.start, 0, []
        rest = iter(data)
        n, left = len(data), rest.__length_hint__
        for b in rest:
            state = table[state + b]
            if state >= accepting or was:
                now = marks[state]
                if gone := was & ~now:
                    end = n - left() - 1
                    out += [(end, i) for i in range(len(self.kinds)) if gone >> i & 1]
                was = now
        return out + [(n, i) for i in range(len(self.kinds)) if was >> i & 1]

    def start(self, data: bytes, end: int, rule: int, least: int) -> int:
        """The leftmost start, ``least`` or later, of a match that ends at ``end``; -1 if none."""
        dfa, found = self.back[rule], -1
        state, at = dfa.start, end
        while at > least:
            at -= 1
            state = dfa.table[state + data[at]]
            if state == dfa.dead:
                break
            if state >= dfa.accepting:
                found = at
        return found

    def spans(self, data: bytes) -> list[tuple[int, int, int]]:
        """(start, end, rule) in bytes: leftmost, longest and non-overlapping for each rule."""
        free, out = [0] * len(self.kinds), []
        for end, rule in self.ends(data):
            start = self.start(data, end, rule, free[rule])
            if start >= 0:
                free[rule] = end
                kind = self.kinds[rule]
                if end - start >= LEAST.get(kind, 0) and (kind != "assign" or _value_length(data[start:end]) >= LEAST_VALUE):
                    out.append((start, end, rule))
        return sorted(out)


def _value_length(match: bytes) -> int:
    """Length of the assigned value, the last part of a match."""
    at = min(i for i in (match.find(b":"), match.find(b"=")) if i >= 0) + 1
    rest = match[at:].lstrip(b" ")
    return len(rest[1:] if rest[:1] in (b'"', b"'") else rest)


_scanner: list[Scanner] = []


def scanner() -> Scanner:
    if not _scanner:
        _scanner.append(Scanner(RULES))
    return _scanner[0]


def find_secrets(text: str | None) -> list[tuple[str, int, int]]:
    """(kind, start, end) in code points, by start and then kind."""
    data = (text or "").encode()
    found = scanner().spans(data)
    if not found:
        return []
    at = {0: 0}
    last = 0
    for i in sorted({x for s, e, _ in found for x in (s, e)}):
        at[i] = at[last] + len(data[last:i].decode())
        last = i
    return [(RULES_LIST[rule], at[s], at[e]) for s, e, rule in found]


RULES_LIST = list(RULES)
_OUT = pa.schema([("doc_id", pa.int64()), ("n_assign", pa.int64()), ("n_access", pa.int64()), ("n_hex", pa.int64()), ("base_sha256", pa.string()), ("spans", pa.string())])


def _scan(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        rows = []
        for text in batch.column("text"):
            found = find_secrets(text.as_py())
            base = [x for x in found if x[0] in BASE]
            said = [",".join(f"{k}:{s}:{e}" for k, s, e in x) for x in (base, found)]
            kinds = [k for k, _, _ in base]
            rows.append((*[kinds.count(k) for k in BASE], hashlib.sha256(said[0].encode()).hexdigest(), said[1]))
        cols = list(zip(*rows, strict=True)) if rows else [()] * 5
        yield pa.RecordBatch.from_arrays([batch.column("doc_id"), *[pa.array(c, f.type) for c, f in zip(cols, list(_OUT)[1:], strict=True)]], schema=_OUT)


def secrets(docs: DataFrame, id_col: str = "doc_id", text_col: str = "text") -> DataFrame:
    """One row per document: doc_id, n_assign, n_access, n_hex, base_sha256, spans.

    A null text is empty; a null id stays null.  Repeated rows are scanned alike,
    other columns are ignored, an empty table gives an empty result.  Spans are
    code points of the original text, end exclusive.
    """
    rows = docs.select(F.col(id_col).cast("long").alias("doc_id"), F.col(text_col).alias("text"))
    return rows.mapInArrow(_scan, "doc_id long, n_assign long, n_access long, n_hex long, base_sha256 string, spans string")
