"""Secret scans with one combined deterministic automaton.

The expressions of all rules are compiled together: an automaton of positions, turned round, then subset construction
over byte classes, then minimisation, into transition arrays. One pass over the bytes of a text, from the last to the
first, scans it for all rules: a state's bits tell which rules have a match that starts at this byte. From each start
that is not inside the match before, the rule's forward automaton, made in the same way, goes on to the end of the
longest match. Nothing else searches the texts.

Many stretches of a batch advance together, one byte each a step, so a step is one array lookup. A stretch begins a
little early to reach the right state; where the state before it shows that this was not enough, it is scanned again
from that state, so the pass equals a sequential one. A byte that UTF-8 does not have separates texts.

Defined results: null or empty text: no spans. Repeated rows get equal results. Extra columns are ignored. An empty
table gives an empty result. Letters are A-Z and a-z only.
"""

from __future__ import annotations

import re
from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

_VALUE = "[A-Za-z0-9+/_.=-]"
_NAME = "(password|passwd|secret|token|api_?key)"
#: kind: (expression, either case, least length, group of that length). Classes name ASCII characters only.
RULES = {
    "assign": (f"{_NAME}[\"']?\\x20*[:=]\\x20*[\"']?({_VALUE}+)", True, 8, 2),
    "access": ("AKIA[A-Z0-9]+", False, 16, 0),
    "hex": ("[0-9a-f]+", False, 32, 0),
    # kinds that the method adds
    "github": ("gh[pousr]_[A-Za-z0-9]{36,}", False, 40, 0),
    "jwt": (r"eyJ[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}\.[A-Za-z0-9_-]{10,}", False, 35, 0),
    "private-key": ("-----BEGIN [A-Z ]*PRIVATE KEY-----", False, 20, 0),
    "slack": ("xox[abprs]-[A-Za-z0-9-]{10,}", False, 15, 0),
}
#: What the automata have in place of expressions whose matches are runs to the end of a class: the run's least length counted in.
_COUNTED = {"access": "AKIA[A-Z0-9]{12,}", "hex": "[0-9a-f]{32,}"}
BASE = ("assign", "access", "hex")
KINDS = list(RULES)
STRETCH, EARLY = 1024, 64
BETWEEN = 0xFF  #: a byte that UTF-8 does not have, set between texts


class Nfa:
    """Positions joined by byte sets and by empty moves, built from a regex of literals, classes, groups, | ? * + {n} {n,}."""

    def __init__(self) -> None:
        self.empty: list[list[int]] = []
        self.moves: list[list[tuple[np.ndarray, int]]] = []

    def new(self) -> int:
        self.empty.append([])
        self.moves.append([])
        return len(self.empty) - 1

    def add(self, pattern: str, either_case: bool, begin: int) -> int:
        """Adds the pattern behind a position; returns its last position."""
        self.text, self.at, self.either = pattern, 0, either_case
        return self._choice(begin)

    def _peek(self) -> str:
        return self.text[self.at : self.at + 1]

    def _choice(self, begin: int) -> int:
        ends = [self._run(begin)]
        while self._peek() == "|":
            self.at += 1
            ends.append(self._run(begin))
        end = self.new()
        for e in ends:
            self.empty[e].append(end)
        return end

    def _run(self, here: int) -> int:
        while self._peek() not in ("", "|", ")"):
            here = self._repeat(here)
        return here

    def _repeat(self, begin: int) -> int:
        mark = self.at
        first = self.new()
        self.empty[begin].append(first)
        end = self._one(first)
        sign = self._peek()
        if sign and sign in "?*+":
            self.at += 1
            out = self.new()
            self.empty[end] += [out] + ([first] if sign in "*+" else [])
            if sign in "?*":
                self.empty[first].append(out)
            return out
        if sign == "{":
            close = self.text.index("}", self.at)
            times, after = self.text[self.at + 1 : close], close + 1
            for _ in range(int(times.rstrip(",")) - 1):
                self.at, first = mark, end
                end = self._one(end)
            if times[-1] == ",":
                self.empty[end].append(first)
            self.at = after
        return end

    def _one(self, begin: int) -> int:
        if self._peek() == "(":
            self.at += 1
            end = self._choice(begin)
            self.at += 1
            return end
        found = re.compile(r"\[[^\]]+\]|\\x[0-9A-Fa-f]{2}|\\?.").match(self.text, self.at)
        self.at = found.end()
        member = np.array([bool(re.fullmatch(found[0].encode(), bytes([b]), re.I if self.either else 0)) for b in range(256)])
        end = self.new()
        self.moves[begin].append((member, end))
        return end


class Automaton:
    """The minimal deterministic automaton of rules: transitions (states x classes), of (class of each byte), bits (rules
    that are complete). backward: reads texts from their last byte, and a match may end at any byte, so bits tell where
    matches start (transitions are flat: offsets of states); else it reads from the start of a match on (steps: lists)."""

    def __init__(self, rules: list[tuple[str, bool]], backward: bool) -> None:
        nfa = Nfa()
        ends = []
        for pattern, either in rules:
            begin = nfa.new()
            ends.append((begin, nfa.add(pattern, either, begin)))
        n = len(nfa.empty)
        empty, moves = [[] for _ in range(n + 1)], [[] for _ in range(n + 1)]
        for s in range(n):
            for t in nfa.empty[s]:
                empty[t if backward else s].append(s if backward else t)
            for m, t in nfa.moves[s]:
                moves[t if backward else s].append((m, s if backward else t))
        empty[n] = [e if backward else b for b, e in ends]
        final = {b if backward else e: 1 << k for k, (b, e) in enumerate(ends)}
        sets = np.array([m for of in moves for m, _ in of])
        kinds, self.of = np.unique(sets.T, axis=0, return_inverse=True)
        self.of = self.of.reshape(-1).astype(np.int32)
        sample = [int(np.flatnonzero(self.of == k)[0]) for k in range(len(kinds))]
        table, bits = self._subsets(empty, moves, final, sample, n, backward)
        self._minimise(table, bits, backward)

    def _subsets(self, empty, moves, final, sample, root: int, stay: bool) -> tuple[np.ndarray, np.ndarray]:
        """Subset construction, all subsets of a round at once: a subset is a row of bits, and what a byte of it leads to
        is looked up whole. stay: the root stays in every subset, so a match may begin at any byte."""
        n = root + 1
        reach = np.zeros((n, n), bool)
        for s in range(n):
            todo = [s]
            while todo:
                t = todo.pop()
                if not reach[s, t]:
                    reach[s, t] = True
                    todo += empty[t]
        use = [s for s in range(n) if moves[s] or s in final]
        reach = reach[:, use]
        width = -(-len(use) // 64)

        def packed(rows: np.ndarray) -> np.ndarray:
            return np.packbits(np.pad(rows, ((0, 0), (0, 64 * width - rows.shape[1]))), axis=1, bitorder="little").view(np.uint64)

        start = packed(reach[[root]])
        to = np.zeros((8 * width, 256, len(sample), width), np.uint64)
        for c, b in enumerate(sample):
            one = np.zeros((64 * width, len(use)), bool)
            for i, s in enumerate(use):
                for m, t in moves[s]:
                    if m[b]:
                        one[i] |= reach[t]
            one = packed(one).reshape(8 * width, 8, width)
            for k in range(8):  # all 256 values of a byte, bit by bit
                to[:, np.flatnonzero(np.arange(256) >> k & 1), c] |= one[:, None, k]
        number, todo, rows, table = {start.tobytes(): 0}, start, [start], []
        while len(todo):
            as_bytes = todo.view(np.uint8).reshape(len(todo), 8 * width)
            got = np.zeros((len(todo), len(sample), width), np.uint64)
            for p in range(8 * width):
                got |= to[p][as_bytes[:, p]]
            if stay:
                got |= start
            flat = got.reshape(-1, width)
            keys = np.ascontiguousarray(flat).view([("", np.uint64)] * width).ravel()
            distinct, first, back = np.unique(keys, return_index=True, return_inverse=True)
            places, new = np.empty(len(distinct), np.int64), []
            for i, x in enumerate(distinct):
                key = x.tobytes()
                if key not in number:
                    number[key] = len(number)
                    new.append(first[i])
                places[i] = number[key]
            table.append(places[back].reshape(len(todo), len(sample)))
            todo = flat[new]
            rows.append(todo)
        member = np.unpackbits(np.concatenate(rows).view(np.uint8), axis=1, bitorder="little")[:, : len(use)]
        bits = np.zeros(len(member), np.int64)
        for i, s in enumerate(use):
            bits |= member[:, i].astype(np.int64) * final.get(s, 0)
        return np.concatenate(table), bits

    def _minimise(self, table: np.ndarray, bits: np.ndarray, backward: bool) -> None:
        """States stay together while their bits and their successors' parts agree; parts are told apart by 64-bit
        signatures of ever longer continuations, and the outcome is tested."""
        keys = S.mix64(np.arange(1, table.shape[1] + 1, dtype=np.uint64))
        sign, n = S.mix64(bits.astype(np.uint64)), 0
        while (found := len(np.unique(sign))) > n:
            n = found
            for _ in range(8):
                sign = S.mix64(sign + sign[table] @ keys)
        part = np.unique(sign, return_inverse=True)[1].reshape(-1)
        first = np.unique(part, return_index=True)[1]
        if (part[table] != part[table[first]][part]).any() or (bits != bits[first][part]).any():
            raise ValueError("two parts have one signature")
        next_, self.bits, self.start = part[table[first]], bits[first], int(part[0])
        self.states, self.classes = next_.shape
        if backward:
            self.flat = (next_ * self.classes).ravel().astype(np.int32)  # successor, as an offset into flat
            self.flat_bits = np.repeat(self.bits, self.classes).astype(np.min_scalar_type(int(self.bits.max())))
        else:
            dead = int(np.flatnonzero((next_ == np.arange(self.states)[:, None]).all(1) & (self.bits == 0))[0])
            self.steps = [[None if t == dead else int(t) for t in row] for row in next_]

    def starts(self, raw: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(places, bits) of the bytes at which matches of rules start: one pass, from the last byte to the first. Many
        stretches advance together, one byte each a step."""
        n = len(raw)
        if not n:
            return np.zeros(0, np.int64), self.flat_bits[:0]
        columns = -(-n // STRETCH)
        kind = np.full(columns * STRETCH, self.of[BETWEEN], np.int32)
        kind[:n] = self.of[raw[::-1]]
        kind = np.ascontiguousarray(kind.reshape(columns, STRETCH).T)
        state = np.full(columns, self.start * self.classes, np.int32)
        for t in range(STRETCH - EARLY, STRETCH):
            state[1:] = self.flat[state[1:] + kind[t, :-1]]
        reached, found = state.copy(), np.zeros((STRETCH, columns), self.flat_bits.dtype)
        at = np.empty_like(state)
        for t in range(STRETCH):
            np.add(state, kind[t], out=at)
            np.take(self.flat, at, out=state)
            np.take(self.flat_bits, state, out=found[t])
        for c in np.flatnonzero(reached[1:] != state[:-1]) + 1:  # in order: a rescan may change the next one's start
            self._again(c, kind, state, found)
            while c + 1 < columns and state[c] != reached[c + 1]:
                c += 1
                self._again(c, kind, state, found)
        found = found.T.ravel()
        place = np.flatnonzero(found)
        place = place[place < n][::-1]
        return n - 1 - place, found[place]

    def _again(self, c: int, kind: np.ndarray, state: np.ndarray, found: np.ndarray) -> None:
        s = int(state[c - 1])
        for t in range(STRETCH):
            s = int(self.flat[s + kind[t, c]])
            found[t, c] = self.flat_bits[s]
        state[c] = s

    def end(self, raw: np.ndarray, at: int) -> int:
        """End of the longest match that starts at a place."""
        state, out = self.start, -1
        while at < len(raw):
            state = self.steps[state][self.of[raw[at]]]
            if state is None:
                break
            at += 1
            if self.bits[state]:
                out = at
        return out


class Automata:
    """All rules backward, to find starts, and each rule forward, to find ends."""

    def __init__(self) -> None:
        rules = [(_COUNTED.get(k, r[0]), r[1]) for k, r in RULES.items()]
        self.all = Automaton(rules, backward=True)
        self.each = [Automaton([r], backward=False) for r in rules]

    def spans(self, raw: np.ndarray) -> Iterator[tuple[int, int, int]]:
        """(start, end, number of the kind): leftmost, longest and non-overlapping within each kind. A match that is too
        short is dropped, but no other match of its kind starts inside."""
        places, bits = self.all.starts(raw)
        for k, kind in enumerate(KINDS):
            starts, i = places[bits >> k & 1 == 1], 0
            while i < len(starts):
                begin = int(starts[i])
                end = self.each[k].end(raw, begin)
                if kind != "assign" or end - _value(raw, begin, end) >= RULES[kind][2]:
                    yield begin, end, k
                i = int(np.searchsorted(starts, end))


def _value(raw: np.ndarray, begin: int, end: int) -> int:
    """Where the value of an assignment begins: behind its first sign, spaces, and a quote."""
    text = raw[begin:end].tobytes()
    at = re.search(rb"[:=]\x20*[\"']?", text).end()
    return begin + at


@lru_cache(maxsize=1)
def automata() -> Automata:
    return Automata()


def _scan(shared):
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        auto: Automata = shared.value
        kind_of = pa.list_(pa.struct([("start", pa.int64()), ("end", pa.int64()), ("kind", pa.string())]))
        for batch in batches:
            raw_all, off_all = S.utf8(batch.column(1))
            found = [[] for _ in range(len(batch))]
            for a, b in S.slices(off_all):
                off = off_all[a : b + 1] - off_all[a]
                raw = np.insert(raw_all[off_all[a] : off_all[b]], off[1:-1], BETWEEN)
                begins = off[:-1] + np.arange(b - a)
                of_row: dict[int, list[tuple[int, int, int]]] = {}
                for begin, end, k in auto.spans(raw):
                    r = int(np.searchsorted(begins, begin, side="right")) - 1
                    of_row.setdefault(r, []).append((begin - int(begins[r]), end - int(begins[r]), k))
                for r, some in of_row.items():
                    text = raw[begins[r] : begins[r] + off[r + 1] - off[r]]
                    points = np.concatenate(([0], np.cumsum((text & 0xC0) != 0x80)))
                    found[a + r] = [{"start": int(points[x]), "end": int(points[y]), "kind": KINDS[k]} for x, y, k in sorted(some, key=lambda x: (x[0], x[2]))]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(found, kind_of)], ["doc_id", "spans"])

    return run


def scan(docs: DataFrame) -> DataFrame:
    """doc_id and spans: array of (start, end, kind), in code points, end exclusive."""
    plain = docs.select("doc_id", F.col("text").cast("string").alias("text"))
    shared = docs.sparkSession.sparkContext.broadcast(automata())  # its size is that of the rules
    return plain.mapInArrow(_scan(shared), f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, spans array<struct<start:bigint,end:bigint,kind:string>>")


def op9_secret_scan(spark, sf_dir: str) -> DataFrame:
    found = scan(S.table(spark, sf_dir, "documents"))
    said = lambda x: F.array_join(F.transform(x, lambda s: F.concat_ws(":", s["kind"], s["start"], s["end"])), ",")
    base = F.filter("spans", lambda s: s["kind"].isin(*BASE))

    def count(kind: str):
        return F.size(F.filter("spans", lambda s: s["kind"] == kind)).cast("long").alias(f"n_{kind}")

    return found.select("doc_id", *map(count, BASE), F.sha2(said(base), 256).alias("base_sha256"), said(F.col("spans")).alias("spans"))


def _found_sql() -> str:
    """A row for each kind's match in SQL: what lies between the matches tells where each starts."""
    parts = []
    for k, (full, either, least, group) in RULES.items():
        # runs that are too short are left out at once where the whole match is measured
        quoted = full.replace("'", "''").replace("[0-9a-f]+", "[0-9a-f]{32,}")
        pattern = f"'{'(?i)' if either else ''}{quoted}'"
        parts.append(f"SELECT doc_id, {KINDS.index(k)} AS place, '{k}' AS kind, {least} AS least, regexp_extract_all(text, {pattern}) AS m, regexp_extract_all(text, {pattern}, {group}) AS v, regexp_split_to_array(text, {pattern}) AS g FROM documents WHERE regexp_matches(text, {pattern})")
    return " UNION ALL ".join(parts)


SQL = f"""
WITH found AS ({_found_sql()}
), each AS (SELECT doc_id, place, kind, least, unnest(m) AS m, unnest(v) AS v, unnest(list_transform(range(1, len(m) + 1), lambda i: list_sum(list_transform(g[1:i], lambda x: length(x))) + coalesce(list_sum(list_transform(m[1:i - 1], lambda x: length(x))), 0))) AS start FROM found
), spans AS (SELECT doc_id, place, kind, kind || ':' || CAST(start AS BIGINT) || ':' || CAST(start + length(m) AS BIGINT) AS said, start FROM each WHERE length(v) >= least)
SELECT d.doc_id, count(*) FILTER (kind = 'assign') AS n_assign, count(*) FILTER (kind = 'access') AS n_access, count(*) FILTER (kind = 'hex') AS n_hex,
  sha256(coalesce(string_agg(said, ',' ORDER BY start, place) FILTER (place < 3), '')) AS base_sha256, coalesce(string_agg(said, ',' ORDER BY start, place), '') AS spans
FROM documents d LEFT JOIN spans s ON d.doc_id = s.doc_id GROUP BY d.doc_id
"""
