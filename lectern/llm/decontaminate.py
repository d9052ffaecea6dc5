"""Benchmark decontamination with a generalised suffix automaton over normalised test items.

The items' words (A-Z lower-cased, ``[^\\x00-\\x2F\\x3A-\\x60\\x7B-\\x7F]+``) form one automaton. The words of each document
stream through it; the state and the length of the longest match that ends at each word tell which windows end
there. A window is 13 consecutive item words; an item of fewer words, but not none, is one window. Words inside any
occurrence of a window are hit.

A word that no item has, or a pair of neighbouring words that no item has, ends every match, so words are first
looked up by hash (numpy, whole batches), and only stretches of known words and pairs go through the automaton. Each
word there is looked up again by its bytes, so equal hashes cannot make a hit.

The items are a stated query set: they are read in blocks of at most BLOCK_WORDS words, and each block's automaton, whose
size that bounds (arrays of some 10 MB), is broadcast and run over all documents, one block after the other.

Defined results: null or empty text: no words, not contaminated. Items without words (or null) have no window.
Repeated items count once for each item_id; a null item_id makes windows but is not listed. Repeated documents get
the same result each. Empty benchmark: nothing is hit. An empty table gives an empty result. doc_id must be a whole
number. Extra columns are ignored.
"""

from __future__ import annotations

import re
import zlib
from array import array
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

WINDOW = 13
LEAST_PERCENT = 5  #: of a document's words; hit words of that share or more contaminate it
BLOCK_WORDS = 100_000
_WORD = re.compile(rb"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+")
_A_Z = bytes(S.LOWER)


def item_words(text: str | None) -> list[bytes]:
    return _WORD.findall((text or "").encode("utf-8", "replace").translate(_A_Z))


class SuffixAutomaton:
    """Generalised suffix automaton over word numbers; state 0 is the root."""

    def __init__(self) -> None:
        self.next: list[dict[int, int]] = [{}]
        self.link, self.length = [-1], [0]

    def _state(self, length: int) -> int:
        self.next.append({})
        self.link.append(-1)
        self.length.append(length)
        return len(self.next) - 1

    def _split(self, p: int, q: int, c: int) -> int:
        """The state for the part of q that p's strings extended by c make up."""
        if self.length[q] == self.length[p] + 1:
            return q
        copy = self._state(self.length[p] + 1)
        self.next[copy], self.link[copy] = dict(self.next[q]), self.link[q]
        self.link[q] = copy
        while p >= 0 and self.next[p].get(c) == q:
            self.next[p][c] = copy
            p = self.link[p]
        return copy

    def extend(self, last: int, c: int) -> int:
        if c in self.next[last]:
            return self._split(last, self.next[last][c], c)
        new, p = self._state(self.length[last] + 1), last
        while p >= 0 and c not in self.next[p]:
            self.next[p][c] = new
            p = self.link[p]
        self.link[new] = 0 if p < 0 else self._split(p, self.next[p][c], c)
        return new


class Matcher:
    """The automaton of a block of items as arrays, with the items of each window.

    Transitions are sorted by (state, word) in one array of keys, so a step is a binary search; an item's words cost some
    100 bytes each."""

    def __init__(self, items: list[tuple[str | None, str | None]], window: int = WINDOW) -> None:
        self.window, self.words = window, {}
        sam, texts = SuffixAutomaton(), [(i, item_words(t)) for i, t in items]
        for _, words in texts:
            last = 0
            for w in words:
                last = sam.extend(last, self.words.setdefault(w, len(self.words)))
        self.base = max(1, len(self.words))
        moves = sorted((s * self.base + c, t) for s, row in enumerate(sam.next) for c, t in row.items())
        self.keys, self.to = array("q", [k for k, _ in moves]), array("q", [t for _, t in moves])
        self.link, self.length = array("q", sam.link), array("q", sam.length)
        # windows that are suffixes of a state's strings: their sizes and items, a run of the arrays for each state
        found: set[tuple[int, int, int]] = set()
        self.items = [i for i, _ in texts]
        for n, (_, words) in enumerate(texts):
            size = min(window, len(words))
            state = length = 0
            for k, w in enumerate(words):
                state, length = self.step(state, length, self.words[w])
                if k + 1 >= size:
                    at = state
                    while self.length[self.link[at]] >= size:
                        at = self.link[at]
                    found.add((at, size, n))
        ends = sorted(found)
        self.end_state, self.end_size, self.end_item = (array("q", [e[i] for e in ends]) for i in range(3))
        raw = b"".join(self.words)
        cut = np.cumsum([0, *map(len, self.words)])
        hashes = S.word_hashes(np.frombuffer(raw, np.uint8), cut[:-1], cut[1:]) if raw else np.zeros(0, np.uint64)
        self.known = np.unique(hashes)
        pairs = [np.array([], np.uint64)]
        for _, words in texts:
            h = hashes[[self.words[w] for w in words]] if words else np.zeros(0, np.uint64)
            pairs.append(S.gram_hashes(h, 2))
        self.pairs = np.unique(np.concatenate(pairs))
        self.least = min((min(window, len(w)) for _, w in texts if w), default=0)

    @staticmethod
    def _in(values: np.ndarray, known: np.ndarray) -> np.ndarray:
        """Membership; a table of one bit for each of 2^20 remainders settles most values."""
        if not len(known):
            return np.zeros(len(values), bool)
        seen = np.zeros(1 << 20, bool)
        seen[known & np.uint64((1 << 20) - 1)] = True
        maybe = seen[values & np.uint64((1 << 20) - 1)]
        where = np.flatnonzero(maybe)
        at = np.minimum(np.searchsorted(known, values[where]), len(known) - 1)
        maybe[where] = known[at] == values[where]
        return maybe

    def stretches(self, words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """Word ranges [a, b) in which every word and every neighbouring pair stands in some item, long enough for a window."""
        if not len(words) or not self.least:
            return (np.zeros(0, np.int64),) * 2
        known = self._in(words, self.known)
        joined = np.zeros(len(words) + 1, bool)
        at = np.flatnonzero(known[1:] & known[:-1] & (row[1:] == row[:-1]))
        pair = S.mix64(S.mix64(words[at] * S._PLACES[0]) + words[at + 1] * S._PLACES[1])
        joined[at[self._in(pair, self.pairs)] + 1] = True
        first = np.flatnonzero(known & ~joined[:-1])
        last = np.flatnonzero(known & ~joined[1:]) + 1
        long = last - first >= self.least
        return first[long], last[long]

    def step(self, state: int, length: int, c: int) -> tuple[int, int]:
        """Longest match after one more word."""
        while True:
            key = state * self.base + c
            at = bisect_left(self.keys, key)
            if at < len(self.keys) and self.keys[at] == key:
                return self.to[at], length + 1
            if not state:
                return 0, 0
            state = self.link[state]
            length = self.length[state]

    def run(self, words: list[bytes]) -> Iterator[tuple[int, int, set[str | None]]]:
        """(start, end, items) of the windows that end at each word."""
        state = length = 0
        for k, w in enumerate(words):
            c = self.words.get(w)
            state, length = (0, 0) if c is None else self.step(state, length, c)
            at, found, size = state, set(), 0
            while at > 0:
                for e in range(bisect_left(self.end_state, at), bisect_left(self.end_state, at + 1)):
                    if self.end_size[e] <= length:
                        found.add(self.items[self.end_item[e]])
                        size = max(size, self.end_size[e])
                at = self.link[at]
            if size:
                yield k + 1 - size, k + 1, found


_HITS = "doc_id long, n_words long, key long, starts array<long>, ends array<long>, items array<string>"


def _hits(matcher) -> object:
    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        m: Matcher = matcher.value
        for batch in batches:
            raw_all, off_all = S.utf8(batch.column(1))
            n, starts, ends, items = np.zeros(len(batch), np.int64), [[] for _ in range(len(batch))], [[] for _ in range(len(batch))], [set() for _ in range(len(batch))]
            for a, b in S.slices(off_all):
                raw, off = S.LOWER[raw_all[off_all[a] : off_all[b]]], off_all[a : b + 1] - off_all[a]
                s, e, row = S.word_spans(raw, off, S.ALNUM)
                n[a:b] = np.bincount(row, minlength=b - a)
                base = np.searchsorted(row, np.arange(b - a))
                for lo, hi in zip(*m.stretches(S.word_hashes(raw, s, e), row), strict=True):
                    r = int(row[lo])
                    shift = int(lo - base[r])
                    for p, q, found in m.run([raw[x:y].tobytes() for x, y in zip(s[lo:hi], e[lo:hi], strict=True)]):
                        items[a + r] |= found
                        p, q = p + shift, q + shift
                        if ends[a + r] and p <= ends[a + r][-1]:
                            ends[a + r][-1] = max(ends[a + r][-1], q)
                            starts[a + r][-1] = min(starts[a + r][-1], p)
                        else:
                            starts[a + r].append(p)
                            ends[a + r].append(q)
            lists = [pa.array(starts, pa.list_(pa.int64())), pa.array(ends, pa.list_(pa.int64())), pa.array([sorted(x for x in i if x is not None) for i in items], pa.list_(pa.string()))]
            key = [zlib.crc32(raw_all[x:y]) for x, y in zip(off_all[:-1], off_all[1:], strict=True)]
            yield pa.RecordBatch.from_arrays([batch.column(0), pa.array(n), pa.array(key, pa.int64()), *lists], ["doc_id", "n_words", "key", "starts", "ends", "items"])

    return run


def item_blocks(items: DataFrame, block_words: int = BLOCK_WORDS) -> Iterator[list[tuple[str | None, str | None]]]:
    """The items in blocks of at most about block_words words (a longer item stands alone)."""
    block, words = [], 0
    for r in items.select(F.col("item_id").cast("string").alias("i"), F.col("text").cast("string").alias("t")).toLocalIterator():
        size = len(item_words(r.t))
        if block and words + size > block_words:
            yield block
            block, words = [], 0
        block.append((r.i, r.t))
        words += size
    yield block


def contamination(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs with n_words, spans (array of word ranges [start, end) that are hit), items (ids whose windows occur) and
    contaminated, keyed by doc_id; one row for each row of docs."""
    spark = docs.sparkSession
    plain = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    found, blocks = [], item_blocks(items)
    block, after = next(blocks), next(blocks, None)
    while block is not None:
        shared = spark.sparkContext.broadcast(Matcher(block))
        hits = plain.mapInArrow(_hits(shared), _HITS)
        if found or after is not None:  # several blocks run one after the other, each written before the next is made
            hits = S.staged(hits, "hits")
            shared.destroy()
        found.append(hits)
        block, after = after, next(blocks, None)
    one = found[0]
    for more in found[1:]:
        one = one.unionByName(more)
    if len(found) > 1:  # the same document has a row for each block
        one = one.groupBy("doc_id", "n_words", "key").agg(
            F.flatten(F.collect_list("starts")).alias("starts"), F.flatten(F.collect_list("ends")).alias("ends"),
            F.array_distinct(F.flatten(F.collect_list("items"))).alias("items"), (F.count("*") / len(found)).cast("int").alias("rows"),
        ).withColumn("row", F.explode(F.sequence(F.lit(1), F.col("rows"))))
    spans = F.array_sort(F.arrays_zip(F.col("starts").alias("start"), F.col("ends").alias("end")))
    # spans of several blocks may overlap: each counts from where those before it have ended
    zero = F.lit(0).cast("long")
    merged = F.aggregate(
        spans,
        F.struct(zero.alias("to"), zero.alias("n")),
        lambda s, x: F.struct(F.greatest(s["to"], x["end"]).alias("to"), (s["n"] + F.greatest(zero, x["end"] - F.greatest(s["to"], x["start"]))).alias("n")),
    )["n"]
    out = one.select("doc_id", "n_words", spans.alias("spans"), F.array_sort("items").alias("items"), merged.alias("n_hit"))
    return out.withColumn("contaminated", (F.col("n_hit") > 0) & (F.col("n_hit") * 100 >= F.col("n_words") * LEAST_PERCENT))


def drop_contaminated(docs: DataFrame, items: DataFrame) -> DataFrame:
    """docs without the contaminated ones; rows with a null doc_id stay."""
    bad = S.staged(contamination(docs, items).where("contaminated and doc_id is not null").select("doc_id").distinct(), "contaminated")
    return S.by_id(docs, bad, "left_anti")


def op10_decontaminate(spark, sf_dir: str) -> DataFrame:
    out = contamination(S.table(spark, sf_dir, "documents"), S.table(spark, sf_dir, "benchmark"))
    return out.select(
        "doc_id", "n_words", "n_hit", F.size("items").cast("long").alias("n_items"),
        F.sha2(F.array_join("items", ","), 256).alias("items_sha256"), "contaminated",
    )


SQL = r"""
WITH dw AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM documents
), iw AS (
  SELECT item_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x00-\x2F\x3A-\x60\x7B-\x7F]+'), lambda w: w <> '') AS w FROM benchmark
), windows AS (
  SELECT item_id, least(len(w), 13) AS size, unnest(list_transform(range(1, len(w) - least(len(w), 13) + 2), lambda i: array_to_string(list_slice(w, i, i + least(len(w), 13) - 1), ' '))) AS g
  FROM iw WHERE len(w) > 0
), sizes AS (SELECT DISTINCT size FROM windows
), places AS (
  SELECT doc_id, size, unnest(range(1, len(w) - size + 2)) AS i, unnest(list_transform(range(1, len(w) - size + 2), lambda i: array_to_string(list_slice(w, i, i + size - 1), ' '))) AS g
  FROM dw, sizes WHERE len(w) >= size
), hits AS (SELECT doc_id, i, p.size, item_id FROM places p JOIN windows v ON p.g = v.g AND p.size = v.size
), hit_words AS (SELECT doc_id, count(DISTINCT k) AS n_hit FROM (SELECT doc_id, unnest(range(i, i + size)) AS k FROM hits) GROUP BY doc_id
), hit_items AS (SELECT doc_id, count(*) AS n_items, string_agg(s, ',' ORDER BY s) AS ids FROM (SELECT DISTINCT doc_id, CAST(item_id AS VARCHAR) AS s FROM hits) GROUP BY doc_id)
SELECT d.doc_id, CAST(len(d.w) AS BIGINT) AS n_words, CAST(coalesce(n_hit, 0) AS BIGINT) AS n_hit, CAST(coalesce(n_items, 0) AS BIGINT) AS n_items,
  sha256(coalesce(ids, '')) AS items_sha256, coalesce(n_hit, 0) > 0 AND 20 * coalesce(n_hit, 0) >= len(d.w) AS contaminated
FROM dw d LEFT JOIN hit_words USING (doc_id) LEFT JOIN hit_items USING (doc_id)
"""
