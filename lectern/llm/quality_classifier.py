"""Quality classifier by Bradley-Terry ranking of preference pairs.

Each text gets a vector of statistics (numpy over whole batches). Pairs of a label-1 and a label-0 document are
preferences; the weights minimise the logistic loss of the differences of their vectors, so a document's strength is
the weighted sum of its statistics. The cut is the quantile of the learning documents' strengths that leaves the
share of label 1 above it, and the score 1 / (1 + exp(-(a (strength - cut) + log(0.7 / 0.3)))) is 0.7 at the cut.

About FIT_ROWS labelled rows are fitted (by a hash of doc_id, all if there are fewer), which bounds what reaches the
driver; every document is scored. Labels, lang, source and doc_id are not inputs of a score.

Defined results: null text counts as empty; an empty text has a score like any other. Repeated rows get equal
scores. Repeated or conflicting labels are separate learning rows. Labels that are null or of one class only: every
score is 0.7. Extra columns are kept by ``score`` and ignored by the query; an empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

FIT_ROWS = 20_000
OPPONENTS = 16  #: pairs for each learning document
RIDGE = 1e-3
CUT_SCORE = 0.7
FEATURES = (
    "log words", "mean word bytes", "long words", "upper", "digits", "symbols #*$%&", "bars and tildes", "exclamations",
    "sentence ends", "commas", "other punctuation", "non-ASCII", "white space", "log mean line", "repeated lines",
    "distinct words", "repeated 3-grams", "capital words", "words ending in punctuation",
)


def _class(chars: bytes) -> np.ndarray:
    out = np.zeros(256, bool)
    out[list(chars)] = True
    return out


_UPPER, _DIGIT = _class(bytes(range(65, 91))), _class(b"0123456789")
_CLASSES = [_UPPER, _DIGIT, _class(b"#*$%&"), _class(b"|~^<>{}[]\\_=+"), _class(b"!"), _class(b".?"), _class(b",;:"), _class(b"\"'()-/@`"), _class(bytes(range(128, 256))), _class(b" \t\n\r\x0b\x0c")]
_PUNCT = _class(b"!\"#$%&'()*+,-./:;<=>?@[\\]^_`{|}~")


def _distinct(keys: np.ndarray, row: np.ndarray, n: int) -> np.ndarray:
    """Distinct keys of each row."""
    if not len(keys):
        return np.zeros(n)
    both = np.unique(S.mix64(keys + row.astype(np.uint64) * S._PLACES[0]), return_index=True)[1]
    return np.bincount(row[both], minlength=n).astype(float)


def features(texts: pa.Array) -> np.ndarray:
    """A row of FEATURES for each text."""
    raw_all, off_all = S.utf8(texts)
    out = []
    for a, b in S.slices(off_all):
        raw, off, n = raw_all[off_all[a] : off_all[b]], off_all[a : b + 1] - off_all[a], b - a
        size = np.maximum(1, np.diff(off)).astype(float)
        sums = [np.diff(np.concatenate(([0], np.cumsum(c[raw])))[off]) for c in _CLASSES]
        starts, ends, row = S.word_spans(raw, off, S.SPACED)
        words = np.bincount(row, minlength=n).astype(float)
        some = np.maximum(1, words)
        hashes = S.word_hashes(raw, starts, ends)
        same = row[2:] == row[:-2] if len(row) > 2 else np.zeros(0, bool)
        grams, gram_row = S.gram_hashes(hashes, 3)[same], row[2:][same] if len(row) > 2 else row[:0]
        n_grams = np.bincount(gram_row, minlength=n)
        lines = np.ones(256, bool)
        lines[10] = False
        ls, le, lr = S.word_spans(raw, off, lines)
        n_lines = np.bincount(lr, minlength=n).astype(float)
        per_word = lambda x, some=some, n=n, row=row: np.bincount(row, x, minlength=n) / some
        length = ends - starts
        out.append(
            np.column_stack([
                np.log1p(words), per_word(length) / 10, per_word(length > 12), *[s / size * 10 for s in sums],
                np.log1p(words / np.maximum(1, n_lines)), 1 - _distinct(S.word_hashes(raw, ls, le), lr, n) / np.maximum(1, n_lines),
                _distinct(hashes, row, n) / some, 1 - _distinct(grams, gram_row, n) / np.maximum(1, n_grams),
                per_word(_UPPER[raw[starts]]), per_word(_PUNCT[raw[ends - 1]]),
            ])
        )
    return np.concatenate(out) if out else np.zeros((0, len(FEATURES)))


@dataclass
class Model:
    mean: np.ndarray
    scale: np.ndarray
    weights: np.ndarray
    cut: float
    slope: float

    def strength(self, x: np.ndarray) -> np.ndarray:
        z = np.clip((x - self.mean) / self.scale, -8, 8)
        return np.concatenate((z, z * z), axis=1) @ self.weights

    def score(self, x: np.ndarray) -> np.ndarray:
        t = self.slope * (self.strength(x) - self.cut) + np.log(CUT_SCORE / (1 - CUT_SCORE))
        return 1 / (1 + np.exp(-np.clip(t, -500, 500)))


def fit_pairs(x: np.ndarray, y: np.ndarray) -> Model:
    """Weights from preference pairs: each document of one label meets OPPONENTS of the other, dealt in turn."""
    mean, scale = (x.mean(0), np.maximum(x.std(0), 1e-6)) if len(x) else (np.zeros(len(FEATURES)), np.ones(len(FEATURES)))
    model = Model(mean, scale, np.zeros(2 * x.shape[1]), 0.0, 1.0)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    if not len(good) or not len(bad):
        return model
    z = np.clip((x - mean) / scale, -8, 8)
    z = np.concatenate((z, z * z), axis=1)
    few, many = sorted((good, bad), key=len)
    deal = np.random.default_rng(7)
    left = np.repeat(many, OPPONENTS)
    right = deal.permutation(np.resize(few, len(left)))
    d = (z[left] - z[right]) * (1 if many is good else -1)
    w = np.zeros(d.shape[1])
    for _ in range(25):  # Newton's method on the mean logistic loss
        p = 1 / (1 + np.exp(np.clip(d @ w, -500, 500)))
        step = np.linalg.solve((d * (p * (1 - p))[:, None]).T @ d / len(d) + RIDGE * np.eye(len(w)), d.T @ p / len(d) - RIDGE * w)
        w += step
        if np.abs(step).max() < 1e-8:
            break
    model.weights = w
    s = z @ w
    model.cut = float(np.quantile(s, len(bad) / (len(good) + len(bad))))
    spread = float(np.median(s[good]) - np.median(s[bad]))
    model.slope = 6 / spread if spread > 1e-9 else 1.0
    return model


def fit(docs: DataFrame, labels: DataFrame) -> Model:
    """docs: doc_id, text, without held-out rows; labels: doc_id, quality."""
    marks = labels.where("quality is not null and doc_id is not null").select(F.col("doc_id").alias("l_id"), F.col("quality").cast("int").alias("quality"))
    marks = marks.where("quality in (0, 1)")
    part = min(1.0, FIT_ROWS / max(1, marks.count()))
    marks = marks.where(F.pmod(F.xxhash64("l_id"), F.lit(1_000_000)) < part * 1_000_000)
    # about FIT_ROWS ids and marks: a bounded side
    first = docs.select("doc_id", "text").join(F.broadcast(marks), F.col("doc_id") == F.col("l_id")).select("text", "quality")
    vectors = first.mapInArrow(_vectors, "x array<double>, quality int").collect()
    x = np.array([r.x for r in vectors]).reshape(-1, len(FEATURES))
    y = np.array([r.quality for r in vectors])
    order = np.lexsort((*x.T, y))
    return fit_pairs(x[order], y[order])


def _vectors(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        x = features(batch.column(0))
        lists = pa.FixedSizeListArray.from_arrays(pa.array(x.ravel()), len(FEATURES)).cast(pa.list_(pa.float64()))
        yield pa.RecordBatch.from_arrays([lists, batch.column(1)], ["x", "quality"])


def score(docs: DataFrame, model: Model, name: str = "quality_score") -> DataFrame:
    """docs with a column of scores (replaced if there is one of that name)."""
    spark = docs.sparkSession
    shared = spark.sparkContext.broadcast(model)
    plain = docs.drop(name)
    at = plain.columns.index("text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            s = shared.value.score(features(batch.column(at)))
            yield pa.RecordBatch.from_arrays([*batch.columns, pa.array(s, pa.float64())], [*batch.schema.names, name])

    from pyspark.sql import types as T

    return plain.mapInArrow(run, T.StructType([*plain.schema.fields, T.StructField(name, T.DoubleType())]))


def keep_good(docs: DataFrame, labels: DataFrame) -> DataFrame:
    """docs whose score reaches the cut."""
    model = fit(docs.where(~S.held_out(F.col("doc_id"))), labels)
    return score(docs, model, "_lectern_score").where(F.col("_lectern_score") >= CUT_SCORE).select(docs.columns)


def op7_quality_classifier(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    model = fit(docs.where(~S.held_out(F.col("doc_id"))), S.table(spark, sf_dir, "labels"))
    return score(docs, model).select(
        "doc_id", S.held_out(F.col("doc_id")).alias("held_out"), F.col("quality_score").alias("score"),
        (F.col("quality_score") >= CUT_SCORE).cast("int").alias("predicted"),
    )
