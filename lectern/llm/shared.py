"""Helpers that the corpus operators share: written stages, byte arrays of texts, word hashing."""

from __future__ import annotations

import uuid
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.common import shared_folder

#: Bytes of text that one numpy step handles at once (whole documents; a longer document is one step).
SLICE_BYTES = 1 << 19


def new_path(spark: SparkSession, name: str) -> str:
    """A new place in the folder that driver and executors share."""
    return f"{shared_folder(spark)}/{name}-{uuid.uuid4().hex}"


#: Drops a plan's shuffle files when it has run; what a stage wrote is read from its table, never from them.
_DROP_SHUFFLES = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"


#: Rows of an Arrow batch while a stage is written: texts come in batches of some megabytes, not tens.
_BATCH_ROWS = "spark.sql.execution.arrow.maxRecordsPerBatch"


def staged(df: DataFrame, name: str, batch_rows: int = 2000) -> DataFrame:
    """Writes df as Parquet into the shared folder and reads it back: cuts lineage, survives lost executors."""
    return staged_at(df, new_path(df.sparkSession, name), batch_rows)


def staged_at(df: DataFrame, path: str, batch_rows: int = 2000) -> DataFrame:
    """The same at a given path."""
    spark = df.sparkSession
    wanted = {_DROP_SHUFFLES: "true", _BATCH_ROWS: str(batch_rows)}
    before = {k: spark.conf.get(k) for k in wanted}
    for k, v in wanted.items():
        spark.conf.set(k, v)
    try:
        df.write.parquet(path)
    finally:
        for k, v in before.items():
            spark.conf.set(k, v)
    out = spark.read.schema(df.schema).parquet(path)
    out._lectern_path = path
    return out


def forget(*tables: DataFrame) -> None:
    """Deletes staged tables that nothing unwritten still reads."""
    for t in tables:
        spark = t.sparkSession
        path = spark._jvm.org.apache.hadoop.fs.Path(t._lectern_path)
        path.getFileSystem(spark._jsc.hadoopConfiguration()).delete(path, True)


#: Ids that may be broadcast (8 MB of longs); more are joined by shuffle.
BROADCAST_IDS = 1_000_000


def by_id(df: DataFrame, ids: DataFrame, how: str) -> DataFrame:
    """df's rows whose doc_id is in ids (left_semi) or not (left_anti). ids: one column, a written table. Its rows are
    counted: up to BROADCAST_IDS they go to every task and df is not shuffled, beyond that both sides are."""
    ids = ids.toDF("_lectern_id")
    small = ids.count() <= BROADCAST_IDS
    return df.join(F.broadcast(ids) if small else ids, df["doc_id"] == ids["_lectern_id"], how)


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def held_out(doc_id: Column) -> Column:
    """Rows kept from learning: crc32 of the id's text leaves 2 when divided by 4; a null id is never held out."""
    return F.coalesce(F.crc32(doc_id.cast("string")) % 4 == 2, F.lit(False))


def utf8(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings; null counts as empty."""
    texts = pc.fill_null(texts, "") if texts.null_count else texts
    kind = np.int64 if pa.types.is_large_string(texts.type) or pa.types.is_large_binary(texts.type) else np.int32
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, kind)[texts.offset : texts.offset + len(texts) + 1].astype(np.int64)
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def slices(off: np.ndarray, limit: int = SLICE_BYTES) -> Iterator[tuple[int, int]]:
    """Row ranges [a, b) of about limit bytes; a row that is longer stands alone."""
    a, n = 0, len(off) - 1
    while a < n:
        b = max(a + 1, int(np.searchsorted(off, off[a] + limit, side="right")) - 1)
        yield a, min(b, n)
        a = min(b, n)


#: Bytes that belong to words [^\x20\x09-\x0D]+ and [^\x00-\x2F\x3A-\x60\x7B-\x7F]+ (after lower-casing A-Z).
SPACED = np.ones(256, bool)
SPACED[[0x20, *range(0x09, 0x0E)]] = False
ALNUM = np.zeros(256, bool)
ALNUM[[*range(0x30, 0x3A), *range(0x61, 0x7B), *range(0x80, 0x100)]] = True
#: A-Z to a-z, byte by byte.
LOWER = np.arange(256, dtype=np.uint8)
LOWER[0x41:0x5B] += 32

_MULTIPLIER = np.uint64(0x9E3779B97F4A7C15)
_BYTE_KEYS = np.random.default_rng(20240229).integers(1, 1 << 63, 256, dtype=np.uint64) * np.uint64(2) + np.arange(256, dtype=np.uint64) % np.uint64(2)
_POWERS: dict[str, np.ndarray] = {}


def mix64(h: np.ndarray) -> np.ndarray:
    """A bijective scrambling of 64-bit integers."""
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xFF51AFD7ED558CCD)
    h = (h ^ (h >> np.uint64(33))) * np.uint64(0xC4CEB9FE1A85EC53)
    return h ^ (h >> np.uint64(33))


def _powers(n: int) -> tuple[np.ndarray, np.ndarray]:
    if len(_POWERS.get("up", ())) < n:
        inverse = np.uint64(pow(int(_MULTIPLIER), -1, 1 << 64))
        size = max(n, SLICE_BYTES + 1)
        for name, base in (("up", _MULTIPLIER), ("down", inverse)):
            steps = np.full(size, base, np.uint64)
            steps[0] = 1
            _POWERS[name] = np.cumprod(steps, dtype=np.uint64)
    return _POWERS["up"][:n], _POWERS["down"][:n]


def word_spans(raw: np.ndarray, off: np.ndarray, member: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """(starts, ends, row) of the words in raw; words never cross rows."""
    inside = member[raw]
    if not len(raw):
        return (np.zeros(0, np.int64),) * 3
    edge = np.zeros(len(raw) + 1, bool)
    edge[off] = True
    before = np.concatenate(([False], inside[:-1]))
    after = np.concatenate((inside[1:], [False]))
    starts = np.flatnonzero(inside & (~before | edge[:-1]))
    ends = np.flatnonzero(inside & (~after | edge[1:])) + 1
    return starts, ends, np.searchsorted(off, starts, side="right") - 1


def word_hashes(raw: np.ndarray, starts: np.ndarray, ends: np.ndarray) -> np.ndarray:
    """64-bit hashes of the byte strings raw[start:end]."""
    up, down = _powers(len(raw) + 1)
    sums = np.zeros(len(raw) + 1, np.uint64)
    np.cumsum(_BYTE_KEYS[raw] * up[:-1], out=sums[1:])
    return mix64((sums[ends] - sums[starts]) * down[starts] ^ (ends - starts).astype(np.uint64))


_PLACES = np.array([0xD6E8FEB86659FD93, 0xA0761D6478BD642F, 0xE7037ED1A0B428DB, 0x8EBC6AF09C88C6E3, 0x589965CC75374CC3], np.uint64)


def gram_hashes(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of each run of n consecutive word hashes (len(words) - n + 1 of them)."""
    m = len(words) - n + 1
    if m <= 0:
        return np.zeros(0, np.uint64)
    total = np.zeros(m, np.uint64)
    for k in range(n):
        total = mix64(total + words[k : k + m] * _PLACES[k % len(_PLACES)])
    return total
