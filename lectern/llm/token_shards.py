"""Token-id shards in patched frame-of-reference blocks.

A shard row's ``data`` holds the ids of a run of documents, in order, as blocks of BLOCK ids: each block subtracts its
minimum and packs the rest at the width that holds PERCENTILE of its values; larger values keep their low bits in the
block and stand whole in exception lists. The header indexes where each block starts, so a block can be read alone.

Layout (little-endian): b"PFR1", ids u32, ids a block u32, blocks u32, exceptions u32; then for all blocks minimum u32,
width u8, exceptions u32 (running count), start u32 (of the payload); then the payload; then exceptions (place in block
u8, value u32). Shards are rows of a Parquet table (part, seq, doc_ids, sizes, data), written by Spark's own committer,
so that a lost executor leaves no half-written file and any store that Spark reads can hold them.

Documents are range-partitioned and sorted by the given order, so part and seq give the file order. Ids come from the
tokenizers library. Whole slices of a batch are encoded at once: text is cut where byte-level BPE's pattern always cuts
(such as before white space that follows a visible character), pieces are encoded once or taken from a task's cache of
bounded size, and the slice's ids are put together as arrays.

Defined results: null text is an empty document (the end id alone). Null ids come first. Repeated rows are encoded each;
their order among themselves does not matter, as they are equal, unless texts differ under one id (then by the texts'
hashes, then by text). doc_id must be a whole number (other ids are cast, and null where they have none). A text longer
than a slice is encoded alone. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

import os
import re
import zlib
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

BLOCK = 128
PERCENTILE = 90
END_ID = 0
SHARD_IDS = 1 << 18  #: a shard row ends when it has this many ids
CACHED_PIECES = 400_000  #: of a task; some 30 MB
VOCABULARY = "byte_bpe_50k.json"


# ---- blocks ---------------------------------------------------------------------------------------------------


def _widths(x: np.ndarray) -> np.ndarray:
    """Bits that the values need."""
    return np.where(x > 0, np.floor(np.log2(np.maximum(x, 1).astype(np.float64))).astype(np.int64) + 1, 0)


def pack(ids: np.ndarray) -> bytes:
    n = len(ids)
    blocks = -(-n // BLOCK)
    x = np.zeros(blocks * BLOCK, np.int64)
    x[:n] = ids
    if n and n < len(x):
        x[n:] = x[n - 1]
    x = x.reshape(blocks, BLOCK)
    low = x.min(1) if blocks else np.zeros(0, np.int64)
    x = x - low[:, None]
    at = min(BLOCK - 1, BLOCK * PERCENTILE // 100)
    width = _widths(np.partition(x, at, axis=1)[:, at]) if blocks else np.zeros(0, np.int64)
    row, col = np.nonzero(x >= (np.int64(1) << width)[:, None])
    size = width * BLOCK // 8
    start = np.concatenate(([0], np.cumsum(size)[:-1])) if blocks else size
    payload = np.zeros(int(size.sum()), np.uint8)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        bits = ((x[which].astype(np.uint32)[:, :, None] >> np.arange(w, dtype=np.uint32)) & np.uint32(1)).astype(np.uint8)
        packed = np.packbits(bits.reshape(len(which), -1), axis=1, bitorder="little")
        payload[start[which][:, None] + np.arange(packed.shape[1])] = packed
    outliers = np.bincount(row, minlength=blocks) if blocks else np.zeros(0, np.int64)
    head = np.array([n, BLOCK, blocks, len(row)], "<u4").tobytes()
    index = low.astype("<u4").tobytes() + width.astype(np.uint8).tobytes() + np.cumsum(outliers).astype("<u4").tobytes() + start.astype("<u4").tobytes()
    return b"PFR1" + head + index + payload.tobytes() + col.astype(np.uint8).tobytes() + x[row, col].astype("<u4").tobytes()


def unpack(data: bytes) -> np.ndarray:
    if data[:4] != b"PFR1":
        raise ValueError("not a shard")
    n, block, blocks, outliers = map(int, np.frombuffer(data, "<u4", 4, 4))
    at = 20

    def take(kind: str, count: int) -> np.ndarray:
        nonlocal at
        out = np.frombuffer(data, kind, count, at)
        at += out.nbytes
        return out

    low, width, ends, start = take("<u4", blocks), take("u1", blocks), take("<u4", blocks), take("<u4", blocks)
    payload = take("u1", int((width.astype(np.int64) * block // 8).sum()))
    x = np.zeros((blocks, block), np.uint32)
    for w in np.unique(width[width > 0]):
        which = np.flatnonzero(width == w)
        packed = payload[start[which].astype(np.int64)[:, None] + np.arange(int(w) * block // 8)]
        bits = np.unpackbits(packed, axis=1, bitorder="little").reshape(len(which), block, int(w))
        value = np.zeros((len(which), block), np.uint32)
        for k in range(int(w)):
            value |= bits[:, :, k].astype(np.uint32) << np.uint32(k)
        x[which] = value
    col = take("u1", outliers)
    row = np.repeat(np.arange(blocks), np.diff(ends.astype(np.int64), prepend=0))
    x[row, col] = take("<u4", outliers)
    return (x + low[:, None]).reshape(-1)[:n]


# ---- ids ------------------------------------------------------------------------------------------------------

_WORDS = 3  #: 64-bit words that hold a piece; a longer piece is looked up by its bytes
_MASKS = np.array([(1 << 8 * n) - 1 for n in range(9)], np.uint64)
SLOTS = 1 << 20

_LETTER, _MARK = np.zeros(256, bool), np.zeros(256, bool)
_LETTER[[*range(0x41, 0x5B), *range(0x61, 0x7B)]] = True
_MARK[[*range(0x21, 0x27), *range(0x28, 0x30), *range(0x3A, 0x41), *range(0x5B, 0x61), *range(0x7B, 0x7F)]] = True

#: A piece that the pattern takes as one: letters, or marks but the apostrophe, with a space before them or not.
_ONE = re.compile(r" ?(?:[A-Za-zÀ-ÖØ-öø-ɏ]+|[!-&(-/:-@\[-`{-~]+)|\n")


def _byte_letters() -> str:
    """The letter that stands for each byte in a byte-level vocabulary: printable Latin-1 for itself, others from U+0100."""
    own = {*range(0x21, 0x7F), *range(0xA1, 0xAD), *range(0xAE, 0x100)}
    other = iter(range(0x100, 0x200))
    return "".join(chr(b) if b in own else chr(next(other)) for b in range(256))


def _white(raw: np.ndarray, at: np.ndarray) -> np.ndarray:
    """Whether the character that ends before each place is white space or not visible in ASCII."""
    x = raw[at - 1]
    out = (x <= 0x20) | (x == 0x7F)
    wide = np.flatnonzero(x >= 0x80)
    if len(wide):  # white space beyond ASCII, by its bytes
        x, y, z = x[wide], raw[at[wide] - 2], raw[np.maximum(at[wide] - 3, 0)]
        white = (y == 0xC2) & ((x == 0x85) | (x == 0xA0)) | (z == 0xE1) & (y == 0x9A) & (x == 0x80) | (z == 0xE3) & (y == 0x80) & (x == 0x80)
        out[wide] = white | (z == 0xE2) & ((y == 0x80) & ((x <= 0x8A) | (x == 0xA8) | (x == 0xA9) | (x == 0xAF)) | (y == 0x81) & (x == 0x9F))
    return out


def pieces(raw: np.ndarray, off: np.ndarray) -> np.ndarray:
    """Where the pieces of the texts start, at places where the vocabulary's pattern always cuts.

    These are: before white space that follows a visible character; behind a line end that stands alone between visible
    characters; and between an ASCII letter and a mark other than the apostrophe."""
    cut = np.zeros(len(raw) + 1, bool)
    at = np.flatnonzero((raw == 0x20) | (raw == 0x0A))
    at = at[at > 0]
    at = at[~_white(raw, at)]
    cut[at] = True
    line = at[raw[at] == 0x0A] + 1
    line = line[line < len(raw)]
    cut[line[(raw[line] > 0x20) & (raw[line] < 0x7F)]] = True
    if len(raw) > 1 and not ((raw[:-1] == 0x3C) & (raw[1:] == 0x7C)).any():  # "<|" may begin a special token, which stays whole
        cut[1:-1] |= _LETTER[raw[:-1]] & _MARK[raw[1:]]
    cut[off] = True
    cut[-1] = False
    return np.flatnonzero(cut)


class Encoder:
    """Ids of batches of texts.

    The pieces of a slice are looked up in a table by the bits of their codes and compared byte for byte; those that are
    not found are encoded by the library, once each, and kept. At CACHED_PIECES the cache starts anew."""

    def __init__(self, path: str) -> None:
        os.environ["TOKENIZERS_PARALLELISM"] = "false"  # a task has one core
        from tokenizers import Tokenizer

        self.tokenizer = Tokenizer.from_file(path)
        self.letters = {b: x for b, x in enumerate(_byte_letters())}
        self._clear()

    def _clear(self) -> None:
        """Entry 0 is the end of a document. keys: the words of each piece and its length (0: of a piece kept by its bytes)."""
        self.slot, self.by_bytes = np.zeros(SLOTS, np.int32), {}
        self.keys, self.spans = np.zeros((1, _WORDS + 1), np.uint64), np.array([[0, 1]])
        self.pool = np.array([END_ID], np.uint32)

    def _ids(self, texts: list[bytes]) -> list[list[int]]:
        one, tokenize, space = _ONE.fullmatch, self.tokenizer.model.tokenize, self.letters[0x20]
        out: list[list[int] | None] = [None] * len(texts)
        for k, t in enumerate(texts):
            said = t.decode("utf-8", "replace")
            if one(said):  # ASCII letters and marks stand for themselves
                coded = said.replace(" ", space) if t.isascii() and t[0] != 0x0A else t.decode("latin-1").translate(self.letters)
                out[k] = [x.id for x in tokenize(coded)]
        rest = [k for k, x in enumerate(out) if x is None]
        for k, x in zip(rest, self.tokenizer.encode_batch_fast([texts[k].decode("utf-8", "replace") for k in rest], add_special_tokens=False), strict=True):
            out[k] = x.ids
        return out

    def _add(self, texts: list[bytes], keys: np.ndarray) -> np.ndarray:
        """Entries of new pieces."""
        got = self._ids(texts)
        count = np.array([len(x) for x in got], np.int64)
        first = len(self.pool) + np.cumsum(count) - count
        new = np.arange(len(self.spans), len(self.spans) + len(got))
        self.spans = np.concatenate((self.spans, np.column_stack((first, count))))
        self.pool = np.concatenate((self.pool, np.array([i for x in got for i in x], np.uint32)))
        self.keys = np.concatenate((self.keys, keys))
        return new

    def _differ(self, entry: np.ndarray, keys: np.ndarray) -> np.ndarray:
        found = self.keys[entry] ^ keys
        return (found[:, 0] | found[:, 1] | found[:, 2] | found[:, 3]) != 0

    def _entries(self, raw: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """The cache's entry of each piece raw[start:end]."""
        size, padded = end - start, np.concatenate((raw, np.zeros(8 * _WORDS, np.uint8)))
        every = np.ndarray(len(raw) + 8 * (_WORDS - 1) + 1, np.dtype("<u8"), padded, strides=(1,))  # eight bytes from each place on
        keys = np.empty((len(start), _WORDS + 1), np.uint64)
        for k in range(_WORDS):
            keys[:, k] = every[start + 8 * k] & _MASKS[np.clip(size - 8 * k, 0, 8)]
        keys[:, _WORDS] = size
        code = S.mix64(keys[:, 0] + S.mix64(keys[:, 1] * S._PLACES[0] + keys[:, 2] * S._PLACES[1] + keys[:, 3]))
        at = (code & np.uint64(SLOTS - 1)).astype(np.int64)
        entry = self.slot[at].astype(np.int64)
        miss = np.flatnonzero(self._differ(entry, keys))
        if len(miss):
            codes, first = np.unique(code[miss], return_index=True)
            first = miss[first]
            new = first[(self.slot[at[first]] == 0) & (size[first] <= 8 * _WORDS)]
            new = new[np.unique(at[new], return_index=True)[1]]  # one piece a slot; others are kept by their bytes
            self.slot[at[new]] = self._add([raw[start[i] : end[i]].tobytes() for i in new], keys[new])
            entry[miss] = self.slot[at[miss]]
            miss = miss[self._differ(entry[miss], keys[miss])]
        miss = np.union1d(miss, np.flatnonzero(size > 8 * _WORDS))
        if len(miss):
            texts = [raw[start[i] : end[i]].tobytes() for i in miss]
            fresh = list({t: None for t in texts if t not in self.by_bytes})
            if fresh:
                self.by_bytes.update(zip(fresh, self._add(fresh, np.zeros((len(fresh), _WORDS + 1), np.uint64)).tolist(), strict=True))
            entry[miss] = [self.by_bytes[t] for t in texts]
        return entry

    def encode(self, raw: np.ndarray, off: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """(ids, sizes) of the texts, each with the end id."""
        if len(self.spans) > CACHED_PIECES or len(self.pool) > 4 * CACHED_PIECES:
            self._clear()
        start = pieces(raw, off)
        end = np.append(start[1:], len(raw))[: len(start)]
        entry = np.insert(self._entries(raw, start, end), np.searchsorted(start, off[1:]), 0)
        span = self.spans[entry]
        count = span[:, 1]
        ends = np.cumsum(count)
        ids = self.pool[np.arange(ends[-1] if len(ends) else 0) + np.repeat(span[:, 0] - ends + count, count)]
        return ids, np.diff(ends[np.flatnonzero(entry == 0)], prepend=0)


def vocabulary_path(name: str = VOCABULARY) -> str:
    import public_tokenizers

    return public_tokenizers.path(name)


# ---- shards ---------------------------------------------------------------------------------------------------

_SHARD = "part int, seq int, doc_ids array<long>, sizes array<long>, data binary"


def write_shards(docs: DataFrame, path: str, order: list[str] | None = None, tokenizer: str | None = None) -> DataFrame:
    """Writes shards of docs (doc_id, text) in ascending order of the given columns, by default doc_id; returns the table.

    Rows that agree in these are ordered by their texts' hashes, then texts; texts are no keys of the ranges, as keys
    are sampled to the driver."""
    name = tokenizer or vocabulary_path()
    text = F.col("text").cast("string")
    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), text.alias("text"), F.struct(*(order or ["doc_id"]), F.xxhash64(text)).alias("key"))
    rows = rows.repartitionByRange("key").sortWithinPartitions("key", "text").select("doc_id", "text")

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        coder, part, seq = Encoder(name), TaskContext.get().partitionId(), 0  # the cache ends with the task
        names, sizes, chunks = [], [], []

        def row() -> pa.RecordBatch:
            lists = [pa.ListArray.from_arrays(pa.array([0, sum(map(len, x))], pa.int32()), pa.concat_arrays(x)) for x in (names, sizes)]
            cols = [pa.array([part], pa.int32()), pa.array([seq], pa.int32()), *lists, pa.array([pack(np.concatenate(chunks))], pa.binary())]
            return pa.RecordBatch.from_arrays(cols, ["part", "seq", "doc_ids", "sizes", "data"])

        for batch in batches:
            raw, off = S.utf8(batch.column(1))
            for a, b in S.slices(off):
                ids, size = coder.encode(raw[off[a] : off[b]], off[a : b + 1] - off[a])
                names.append(batch.column(0).slice(a, b - a))
                sizes.append(pa.array(size, pa.int64()))
                chunks.append(ids)
                if sum(map(len, chunks)) >= SHARD_IDS:
                    yield row()
                    seq += 1
                    names, sizes, chunks = [], [], []
        if names:
            yield row()

    return S.staged_at(rows.mapInArrow(run, _SHARD), path)


def _read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for r in range(len(batch)):
            ids = unpack(batch.column(4)[r].as_py()).astype("<u4")
            sizes = batch.column(3)[r].values.to_numpy()
            ends = np.cumsum(sizes)
            crc = [zlib.crc32(ids[e - s : e]) for s, e in zip(sizes, ends, strict=True)]
            n = len(sizes)
            cols = [pa.array(np.full(n, batch.column(k)[r].as_py(), np.int32)) for k in (0, 1)]
            yield pa.RecordBatch.from_arrays([*cols, batch.column(2)[r].values, pa.array(ends - sizes), pa.array(sizes), pa.array(crc, pa.int64())], ["part", "seq", "doc_id", "inner", "n_tokens", "ids_crc32"])


def read_index(shards: DataFrame) -> DataFrame:
    """doc_id, start, n_tokens, ids_crc32 of each document, from the shards' data.

    Starts add up in two steps: shards within a part, then parts (one row for each written partition)."""
    n = F.aggregate("sizes", F.lit(0).cast("long"), lambda a, x: a + x)
    runs = shards.select("part", "seq", n.alias("n"))
    before = lambda w: F.coalesce(F.sum("n").over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    inside = runs.withColumn("in_part", before(Window.partitionBy("part").orderBy("seq")))
    parts = runs.groupBy("part").agg(F.sum("n").alias("n"))
    heads = parts.select("part", before(Window.orderBy("part")).alias("head"))
    starts = inside.join(heads, "part").select("part", "seq", (F.col("head") + F.col("in_part")).alias("base"))
    docs = shards.mapInArrow(_read, "part int, seq int, doc_id long, inner long, n_tokens long, ids_crc32 long")
    return docs.join(starts, ["part", "seq"]).select("doc_id", (F.col("base") + F.col("inner")).alias("start"), "n_tokens", "ids_crc32")


def op4_token_shards(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text")
    return read_index(write_shards(docs, S.new_path(spark, "shards")))
