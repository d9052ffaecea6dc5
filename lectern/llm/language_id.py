"""Language identification: multinomial naive Bayes over hashed character n-grams.

Characters are lower-cased, anything that is no letter counts as a space, and n-grams of GRAMS characters fall into
BUCKETS by hash. Learning counts them for each language in Spark; the smoothed log-probability matrix (languages x
BUCKETS, whose size the number of languages bounds) is broadcast, and texts are scored in numpy batches: the rows of
the matrix that a text's n-grams hit are summed. The score is the best language's share under the mean evidence.

About FIT_ROWS rows of each language are learned from (by a hash of doc_id, all if there are fewer); every document is
scored, over its whole text.

Defined results: null text, or text without a letter: ``und``, score 0. Nothing to learn from: every text is ``und``. Repeated
rows get equal results. lang, source and doc_id are not inputs of a prediction. Extra columns are ignored. An empty
table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import lru_cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

GRAMS = (2, 3)
BUCKETS = 1 << 15
FIT_ROWS = 10_000
SMOOTHING = 0.5
SHARPNESS = 60.0  #: of the score: mean log-probabilities count as those of so many n-grams
PIECE = 1 << 19  #: characters summed at once


@lru_cache(maxsize=1)
def _letters() -> np.ndarray:
    """For each code point its lower-case letter, or a space."""
    out = np.full(0x110000, 32, np.uint32)
    for c in range(0x110000):
        x = chr(c)
        if x.isalpha():
            low = x.lower()
            out[c] = ord(low) if len(low) == 1 else c
    return out


def characters(raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(normalised characters, offsets) of UTF-8 bytes."""
    lead = (raw & 0xC0) != 0x80
    at = np.concatenate(([0], np.cumsum(lead)))[off]
    points = np.frombuffer(raw.tobytes().decode("utf-8", "replace").encode("utf-32-le", "replace"), "<u4")
    return _letters()[points], at


def buckets(chars: np.ndarray, off: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(bucket, row) of each n-gram, one size of n-grams at a time; none crosses rows, none is of spaces only."""
    row = np.repeat(np.arange(len(off) - 1), np.diff(off))
    for n in GRAMS:
        m = len(chars) - n + 1
        if m <= 0:
            continue
        h = np.zeros(m, np.uint32)
        for k in range(n):
            h = (h ^ chars[k : k + m].astype(np.uint32)) * np.uint32(0x9E3779B1)
            h ^= h >> np.uint32(15)
        keep = (row[n - 1 :] == row[:m]) & ((chars[:m] != 32) | (chars[n - 1 :] != 32))
        yield (h[keep] % np.uint32(BUCKETS)).astype(np.int64), row[:m][keep]


def _count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    counts: dict[str, np.ndarray] = {}
    for batch in batches:
        raw_all, off_all = S.utf8(batch.column(0))
        langs = np.array(batch.column(1).to_pylist(), object)
        for a, b in S.slices(off_all):
            chars, off = characters(raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a])
            for bucket, row in buckets(chars, off):
                for lang in set(langs[a:b]):
                    mine = (langs[a:b] == lang)[row]
                    found = np.bincount(bucket[mine], minlength=BUCKETS)
                    counts[lang] = counts[lang] + found if lang in counts else found
    for lang, c in counts.items():
        at = np.flatnonzero(c)
        yield pa.RecordBatch.from_arrays([pa.array([lang] * len(at), pa.string()), pa.array(at, pa.int32()), pa.array(c[at], pa.int64())], ["lang", "bucket", "n"])


def fit(docs: DataFrame) -> tuple[list[str], np.ndarray]:
    """(languages, log-probabilities of shape BUCKETS x languages) from rows with text and lang."""
    rows = docs.where("lang is not null and text is not null").select("doc_id", "text", F.col("lang").cast("string").alias("lang"))
    sizes = {r.lang: r.n for r in rows.groupBy("lang").agg(F.count("*").alias("n")).collect()}
    if not sizes:
        return [], np.zeros((BUCKETS, 0), np.float32)
    part = F.element_at(F.create_map(*[F.lit(x) for lang, n in sizes.items() for x in (lang, min(1.0, FIT_ROWS / n))]), F.col("lang"))
    learned = rows.where(F.pmod(F.xxhash64("doc_id"), F.lit(1_000_000)) < part * 1_000_000).select("text", "lang")
    found = learned.mapInArrow(_count, "lang string, bucket int, n long").groupBy("lang", "bucket").agg(F.sum("n").alias("n")).toPandas()
    langs = sorted(set(found["lang"]))
    table = np.full((BUCKETS, len(langs)), SMOOTHING)
    np.add.at(table, (found["bucket"].to_numpy(), np.searchsorted(langs, found["lang"].to_numpy(str))), found["n"].to_numpy())
    return langs, np.log(table / table.sum(0)).astype(np.float32)


def evidence(texts: pa.Array, table: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """(summed log-probabilities by row and language, n-grams by row); rows without a letter have no n-gram."""
    raw_all, off_all = S.utf8(texts)
    total, count = np.zeros((len(texts), table.shape[1])), np.zeros(len(texts), np.int64)
    for a, b in S.slices(off_all):
        chars, off = characters(raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a])
        letter = np.concatenate(([0], np.cumsum(chars != 32)))
        single = np.flatnonzero((np.diff(letter[off]) > 0) & (np.diff(off) < min(GRAMS)))
        count[a + single] += 1  # a letter alone: no n-gram, so every language alike
        for bucket, row in buckets(chars, off):
            count[a:b] += np.bincount(row, minlength=b - a)
            for p in range(0, len(row), PIECE):
                at, of = bucket[p : p + PIECE], row[p : p + PIECE]
                first = np.flatnonzero(np.concatenate(([True], of[1:] != of[:-1])))
                total[a + of[first]] += np.add.reduceat(table[at], first, axis=0, dtype=np.float64)
    return total, count


def predict(docs: DataFrame, langs: list[str], table: np.ndarray) -> DataFrame:
    """doc_id, held_out, lang_pred, score."""
    shared = docs.sparkSession.sparkContext.broadcast((langs, table))

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        langs, table = shared.value
        names = np.array([*langs, "und"], object)
        for batch in batches:
            total, count = evidence(batch.column(2), table)
            pred, score = np.full(len(batch), len(langs)), np.zeros(len(batch))
            some = np.flatnonzero(count)
            if langs and len(some):
                mean = total[some] / count[some, None]
                t = np.exp((mean - mean.max(1, keepdims=True)) * np.minimum(SHARPNESS, count[some])[:, None])
                pred[some], score[some] = mean.argmax(1), t.max(1) / t.sum(1)
            yield pa.RecordBatch.from_arrays([batch.column(0), batch.column(1), pa.array(names[pred].tolist(), pa.string()), pa.array(score)], ["doc_id", "held_out", "lang_pred", "score"])

    plain = docs.select("doc_id", S.held_out(F.col("doc_id")).alias("held_out"), F.col("text").cast("string").alias("text"))
    return plain.mapInArrow(run, f"doc_id {plain.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")


def op2_language_id(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents")
    langs, table = fit(docs.where(~S.held_out(F.col("doc_id"))).select("doc_id", "text", "lang"))
    return predict(docs, langs, table)
