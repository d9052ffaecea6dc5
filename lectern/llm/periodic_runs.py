"""Periodic runs of words: stretches that repeat one sequence of q words at least four times, found by synchronising sets.

For a scale t, the synchronising set holds the positions i for which, of the windows of t words that start at i ... i + t, the
one with the smallest hash is the first or the last. Windows that are themselves highly periodic (period at most t / 3) take no
part. Whether i is chosen depends on the 2 t words from i on alone, so equal contexts are chosen alike; and each stretch of t
positions has a chosen one, unless the 3 t - 1 words from its start on are highly periodic.

Scales are 2, 4, 8, ... A run with smallest period p meets the scale t in (p / 2, p]. Its first 3 t - 1 words are not highly
periodic (else p were not its smallest period), so some s among its first t positions is chosen; the words from s on and from
s + p on agree, and s + 3 p lies in the run, so both are chosen with the same context of 2 t words. The context stands nowhere
in between, for that would make a smaller period. So the pairs of a chosen position and the next one with the same context, t to
2 t - 1 words on, propose every period from 2 on. The highly periodic windows, which are found by themselves (the next place of
a window's first two thirds tells its period), propose the small periods that the sets leave out, among them period 1.
Each proposal is extended to both sides as far as words q apart agree. Work is n log n for n words; scales
end when no window of a text occurs twice in it.

Texts are handled together, slice by slice, with a word between them that equals no other. Words and windows are compared
by 64-bit hashes. Defined results: a null text and one without words have no run and an empty collapsed text;
rows are independent of each other, so repeated rows and null ids get their own results; an empty table gives an empty result;
extra columns are ignored. Whole texts are processed, however long; a text is one step of a task.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

TIMES, LEAST = 4, 6  #: a run has at least TIMES periods and LEAST words

_ODD = np.uint64(0x9E3779B97F4A7C15)
_OUT = "doc_id long, runs array<struct<start:long,length:long,period:long>>, collapsed string"


class Windows:
    """Hashes of the windows of any length, made from those of power-of-two lengths."""

    def __init__(self, words: np.ndarray):
        self.levels = [words]

    def level(self, k: int) -> np.ndarray:
        while len(self.levels) <= k:
            h, d = self.levels[-1], 1 << (len(self.levels) - 1)
            self.levels.append(S.mix64(h[: len(h) - d] * _ODD + S.mix64(h[d:] + np.uint64(len(self.levels)))) if len(h) > d else h[:0])
        return self.levels[k]

    def hashes(self, length: int) -> np.ndarray:
        """Of all windows of so many words: those at both ends, which overlap, tell the window."""
        k = length.bit_length() - 1
        h, d = self.level(k), length - (1 << k)
        n = len(self.levels[0]) - length + 1
        return h[:0] if n <= 0 else h[:n] if d == 0 else S.mix64(h[:n] * _ODD + S.mix64(h[d : d + n] ^ np.uint64(length)))

    def agree(self, a: np.ndarray, b: np.ndarray, step: int) -> np.ndarray:
        """How many words agree from a and b on (step 1: forwards, a and b included; -1: backwards, they are excluded)."""
        n, out = len(self.levels[0]), np.zeros(len(a), np.int64)
        k = 0
        going = np.arange(len(a))
        while len(going):  # longer and longer windows, while they agree
            k, going = k + 1, going[self._same(a, b, out, going, k, step, n)]
        for j in range(k - 1, -1, -1):
            every = np.arange(len(a))
            self._same(a, b, out, every, j, step, n)
        return out

    def _same(self, a: np.ndarray, b: np.ndarray, out: np.ndarray, at: np.ndarray, k: int, step: int, n: int) -> np.ndarray:
        """Adds 2^k to out where the next 2^k words agree, and tells where."""
        h, d = self.level(k), 1 << k
        x, y = (a[at] + out[at], b[at] + out[at]) if step > 0 else (a[at] - out[at] - d, b[at] - out[at] - d)
        inside = (np.minimum(x, y) >= 0) & (np.maximum(x, y) + d <= n)
        same = np.zeros(len(at), bool)
        same[inside] = h[x[inside]] == h[y[inside]]
        out[at[same]] += d
        return same


def next_equal(h: np.ndarray, at: np.ndarray) -> np.ndarray:
    """For each of the ascending positions ``at`` with hashes h: how far on the next one with an equal hash is (0: nowhere)."""
    order = np.argsort(h, kind="stable")
    out = np.zeros(len(at), np.int64)
    same = h[order[1:]] == h[order[:-1]]
    out[order[:-1][same]] = (at[order[1:]] - at[order[:-1]])[same]
    return out


def highly_periodic(w: Windows, t: int) -> np.ndarray:
    """For each window of t words: its smallest period where that is at most t / 3, else 0."""
    n, head = len(w.levels[0]) - t + 1, -(-2 * t // 3)
    if n <= 0 or t < 3:
        return np.zeros(max(0, n), np.int64)
    q = next_equal(w.hashes(head), np.arange(len(w.levels[0]) - head + 1))[:n]
    q[q > t // 3] = 0
    for p in np.unique(q[q > 0]):  # at most t / 3 periods
        i = np.flatnonzero(q == p)
        h = w.hashes(t - int(p))
        q[i[h[i] != h[i + p]]] = 0
    return q


def synchronising_set(w: Windows, t: int, periodic: np.ndarray) -> np.ndarray:
    """Positions, ascending, whose 2 t words lie in the text."""
    n = len(w.levels[0]) - 2 * t + 1
    if n <= 0:
        return np.zeros(0, np.int64)
    h = w.hashes(t)
    none = np.uint64((1 << 64) - 1)
    h = np.where(periodic > 0, none, np.minimum(h, none - np.uint64(1)))
    k = (t + 1).bit_length() - 1
    least = h
    for j in range(k):  # least hash of 2, 4, ... windows
        least = np.minimum(least[: len(least) - (1 << j)], least[1 << j :])
    d = t + 1 - (1 << k)
    least = np.minimum(least[:n], least[d : d + n])
    return np.flatnonzero((least != none) & ((least == h[:n]) | (least == h[t : t + n])))


def proposals(words: np.ndarray, row: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(position, period) pairs: words ``period`` apart agree around the position. Every run is among them.

    Texts (row: the number of each word's) leave when no larger scale can find anything in them: a run of period p >= t needs
    4 p words, and its windows of t words come again within p words."""
    at, period = [], []
    origin, w, t = np.arange(len(words)), Windows(words), 2
    while t <= len(words):
        if t > 4:
            h = w.hashes(t)
            far = next_equal(h, np.arange(len(h)))
            again = np.flatnonzero((far > 0) & (TIMES * far <= np.bincount(row)[row[: len(h)]]))
            busy = np.zeros(row[-1] + 1, bool)
            busy[row[again[row[again] == row[again + far[again]]]]] = True
            if not busy.any():
                break
            stays = busy[row]
            if 4 * stays.sum() < 3 * len(stays):
                words, row, origin = words[stays], row[stays], origin[stays]
                w = Windows(words)
        periodic = highly_periodic(w, t)
        first = np.flatnonzero((periodic > 0) & (np.concatenate(([0], periodic[:-1])) != periodic))
        at.append(origin[first])
        period.append(periodic[first])
        s = synchronising_set(w, t, periodic)
        far = next_equal(w.hashes(2 * t)[s], s)
        good = (far >= t) & (far < 2 * t)
        at.append(origin[s[good]])
        period.append(far[good])
        t *= 2
    return (np.concatenate(at), np.concatenate(period)) if at else (np.zeros(0, np.int64),) * 2


def runs(words: np.ndarray, row: np.ndarray) -> np.ndarray:
    """(start, length, period) rows of the runs of a sequence of word hashes, by start, then period. row: the text of each word;
    texts end with a word that equals no other."""
    w = Windows(words)
    at, period = proposals(words, row)
    left, right = w.agree(at, at + period, -1), w.agree(at, at + period, 1)
    found = np.stack([at - left, left + right + period, period], 1)
    found = np.unique(found[found[:, 1] >= np.maximum(LEAST, TIMES * period)], axis=0)
    # a stretch that also has a smaller period is found with it, at the same place: the smallest stays
    return found[np.concatenate(([True], (found[1:, :2] != found[:-1, :2]).any(1)))] if len(found) else found


def _slice(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray, list[bytes]]:
    """(runs by text and start, their texts, collapsed texts) of some texts."""
    starts, ends, row = S.word_spans(raw, off, S.SPACED)
    hashes, texts = S.word_hashes(raw, starts, ends), len(off) - 1
    place = np.arange(len(starts)) + row  # one more word after each text
    line = S.mix64(np.arange(len(starts) + texts, dtype=np.uint64) + _ODD)  # equal to nothing else, but for chance
    line[place] = hashes
    first = np.searchsorted(row, np.arange(texts + 1))  # of each text's words
    found = runs(line, np.repeat(np.arange(texts), np.diff(first) + 1))
    of = np.searchsorted(first[:-1] + np.arange(texts), found[:, 0], side="right") - 1
    word = found[:, 0] - of  # in the order of all words
    dropped = np.zeros(len(starts) + 1, np.int64)
    np.add.at(dropped, word + found[:, 2], 1)
    np.add.at(dropped, word + found[:, 1], -1)
    keep = np.cumsum(dropped[:-1]) == 0
    found[:, 0] = word - first[of]
    # kept words and a space after each, copied byte by byte
    a, size = starts[keep], ends[keep] - starts[keep] + 1
    head = np.concatenate(([0], np.cumsum(size)))
    out = np.full(head[-1], 32, np.uint8)
    inside = np.ones(head[-1], bool)
    inside[head[1:] - 1] = False
    out[inside] = raw[(np.repeat(a - head[:-1], size) + np.arange(head[-1]))[inside]]
    cut = head[np.searchsorted(row[keep], np.arange(texts + 1))]
    return found, of, [out[x : max(x, y - 1)].tobytes() for x, y in zip(cut[:-1], cut[1:], strict=True)]


def _run_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        raw, off = S.utf8(batch.column(1))
        for a, b in S.slices(off):
            found, of, collapsed = _slice(raw[off[a] : off[b]], off[a : b + 1] - off[a])
            ends = pa.array(np.searchsorted(of, np.arange(b - a + 1)), pa.int32())
            each = pa.StructArray.from_arrays([pa.array(found[:, i].copy()) for i in range(3)], ["start", "length", "period"])
            yield pa.RecordBatch.from_arrays([batch.column(0).slice(a, b - a), pa.ListArray.from_arrays(ends, each), pa.array(collapsed, pa.binary()).cast(pa.string())], ["doc_id", "runs", "collapsed"])


def periodic_runs(docs: DataFrame) -> DataFrame:
    """doc_id, runs (start, length, period in words, by start and period) and collapsed (the words that no run repeats, joined by
    one space) of each row. No shuffle."""
    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(_run_batches, _OUT)


def planted(doc_id: Column, text: Column) -> Column:
    """The text with the contract's repeats: where crc32 of the id divides by 10, words from a on are words a ... a + p - 1 again
    and again. Other texts stay; a null id plants nothing."""
    h = F.crc32(doc_id.cast("string"))
    g = F.floor(h / 10)
    w = F.filter(F.split(text, r"[\x20\x09-\x0D]+"), lambda x: x != "")
    x = F.transform(F.array(F.struct(w.alias("w"), F.size(w).cast("long").alias("n"))), lambda s: F.struct(s["w"].alias("w"), s["n"].alias("n"), F.try_mod(g, s["n"]).alias("a")))[0]
    again = lambda s: F.transform(
        s["w"], lambda v, i: F.when(i < s["a"], v).otherwise(F.get(s["w"], (s["a"] + (i - s["a"]) % (1 + F.floor((s["n"] - s["a"]) / (3 + g % 8)))).cast("int")))
    )
    return F.when(h % 10 == 0, F.transform(F.array(x), lambda s: F.when(s["n"] > 0, F.array_join(again(s), " ")).otherwise(text))[0]).otherwise(text)


def op13_periodic_runs(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", planted(F.col("doc_id"), F.col("text")).alias("text"))
    found = periodic_runs(docs)
    longest = F.array_max(F.transform("runs", lambda r: F.struct(r["length"].alias("length"), (-r["start"]).alias("start"), (-r["period"]).alias("period"))))
    said = F.array_join(F.transform("runs", lambda r: F.concat_ws(",", r["start"], r["length"], r["period"])), "\n")
    said = F.when(F.size("runs") > 0, F.concat(said, F.lit("\n"))).otherwise("")
    rows = found.select("doc_id", F.size("runs").cast("long").alias("n_runs"), longest.alias("x"), F.sha2(said, 256).alias("runs_sha256"), F.sha2("collapsed", 256).alias("collapsed_sha256"))
    return rows.select(
        "doc_id", "n_runs", (-F.col("x.start")).alias("start"), F.col("x.length").alias("length"), (-F.col("x.period")).alias("period"),
        F.floor(1000 * F.col("x.length") / -F.col("x.period")).alias("exponent_milli"), "runs_sha256", "collapsed_sha256",
    )


SQL = r"""
WITH ids AS (
  SELECT doc_id, text, xor(list_reduce(list_concat([CAST(4294967295 AS BIGINT)], list_transform(string_split(CAST(doc_id AS VARCHAR), ''), lambda x: CAST(ascii(x) AS BIGINT))),
    lambda c, b: list_reduce(list_concat([xor(c, b)], CAST([0, 0, 0, 0, 0, 0, 0, 0] AS BIGINT[])), lambda d, z: CASE WHEN d & 1 = 1 THEN xor(d >> 1, 3988292384) ELSE d >> 1 END)), 4294967295) AS h
  FROM documents
), split AS (
  SELECT doc_id, h, h // 10 AS g, list_filter(regexp_split_to_array(coalesce(text, ''), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w FROM ids
), placed AS (SELECT *, CAST(len(w) AS BIGINT) AS n, CASE WHEN len(w) > 0 THEN g % len(w) END AS a FROM split
), whole AS (
  SELECT doc_id, n, CASE WHEN h % 10 = 0 AND n > 0 THEN list_transform(range(n), lambda i: w[CASE WHEN i < a THEN i ELSE a + (i - a) % (1 + (n - a) // (3 + g % 8)) END + 1]) ELSE w END AS w FROM placed
), word AS (SELECT doc_id, n, generate_subscripts(w, 1) - 1 AS i, unnest(w) AS w FROM whole
), pairs AS (
  SELECT x.doc_id, y.i - x.i AS p, x.i FROM word x JOIN word y ON x.doc_id = y.doc_id AND x.w = y.w AND y.i > x.i AND 4 * (y.i - x.i) <= x.n
), islands AS (SELECT doc_id, p, i, i - row_number() OVER (PARTITION BY doc_id, p ORDER BY i) AS k FROM pairs
), stretch AS (SELECT doc_id, p, min(i) AS a, count(*) + p AS l FROM islands GROUP BY doc_id, p, k HAVING count(*) + p >= greatest(6, 4 * p)
), run AS (SELECT doc_id, a, l, min(p) AS p FROM stretch GROUP BY doc_id, a, l
), of_doc AS (
  SELECT doc_id, count(*) AS n_runs, max((l, -a, -p)) AS x, string_agg(a || ',' || l || ',' || p || chr(10), '' ORDER BY a, p) AS said FROM run GROUP BY doc_id
), gone AS (SELECT DISTINCT doc_id, unnest(range(a + p, a + l)) AS i FROM run
), kept AS (SELECT doc_id, string_agg(w, ' ' ORDER BY i) AS t FROM word ANTI JOIN gone USING (doc_id, i) GROUP BY doc_id)
SELECT d.doc_id, CAST(coalesce(n_runs, 0) AS BIGINT) AS n_runs, CAST(-x[2] AS BIGINT) AS start, CAST(x[1] AS BIGINT) AS length, CAST(-x[3] AS BIGINT) AS period, CAST(1000 * x[1] // -x[3] AS BIGINT) AS exponent_milli,
  sha256(coalesce(said, '')) AS runs_sha256, sha256(coalesce(t, '')) AS collapsed_sha256
FROM documents d LEFT JOIN of_doc USING (doc_id) LEFT JOIN kept USING (doc_id)
"""
