"""Texts found whole in longer texts, anywhere: a join by hashed byte grams, then the exact test.

UTF-8 strings contain each other just where their bytes do. An item of n bytes is looked up by one gram of the largest
length of LEVELS that fits in it (so every item that is not empty has one, short ones too); a text offers its gram at every
byte, of each length that some item uses. A bitmap of fixed size (two bits a gram) drops most of what no item can have
before anything is shuffled: it lets too much through as the items grow in number, never too little. Of up to SPOTS grams
an item takes the one that the fewest items have, so a common beginning or end does not bring all of them together.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

LEVELS = (1, 2, 4, 8, 16, 32)  #: bytes of a gram, each twice the one before
SPOTS = 8
BITS = 24  #: of a place in the bitmap
PART_BYTES = 1 << 20  #: bytes of text hashed at once; a longer text is cut, with an overlap


def _bytes(texts: pa.Array) -> tuple[np.ndarray, np.ndarray]:
    """(bytes, offsets) of a column of strings without nulls."""
    texts = texts.cast(pa.large_string())
    if not len(texts):
        return np.zeros(0, np.uint8), np.zeros(1, np.int64)
    _, offsets, data = texts.buffers()
    off = np.frombuffer(offsets, np.int64)[texts.offset : texts.offset + len(texts) + 1]
    raw = np.frombuffer(data, np.uint8) if data is not None else np.zeros(0, np.uint8)
    return raw[off[0] : off[-1]], off - off[0]


def _mixed(h: np.ndarray) -> np.ndarray:
    h = (h ^ (h >> np.uint64(32))) * np.uint64(0xD6E8FEB86659FD93)
    return h ^ (h >> np.uint64(32))


def grams(raw: np.ndarray) -> Iterator[tuple[int, np.ndarray]]:
    """(length, hash of the gram at each byte) for each length of LEVELS that fits."""
    h = raw.astype(np.uint64) + np.uint64(1)
    for size in LEVELS:
        if size > 1:
            half = size // 2
            h = _mixed(h[:-half] * np.uint64(0x9E3779B97F4A7C15) + h[half:]) if len(h) > half else h[:0]
        yield size, _mixed(h + np.uint64(size))


def _places(h: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    return (h >> np.uint64(64 - BITS)).astype(np.int64), (h & np.uint64((1 << BITS) - 1)).astype(np.int64)


def item_grams(text: str) -> tuple[int, list[int]]:
    """Length and hashes of the grams that may stand for an item (not empty)."""
    raw = np.frombuffer(text.encode(), np.uint8)
    size, h = [(s, h) for s, h in grams(raw) if len(h)][-1]
    return size, sorted({int(x) for x in h[np.unique(np.linspace(0, len(h) - 1, SPOTS).astype(int))].view(np.int64)})


def _of_items(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for b in batches:
        rows = [(t, *item_grams(t)) for t in b.column(0).to_pylist()]
        yield pa.RecordBatch.from_arrays([pa.array([r[0] for r in rows], pa.string()), pa.array([r[1] for r in rows], pa.int32()), pa.array([r[2] for r in rows], pa.list_(pa.int64()))], ["item", "gram_bytes", "grams"])


def text_grams(raw: np.ndarray, off: np.ndarray, sizes: set[int], bitmap: np.ndarray) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """(rows, hashes): distinct grams of the texts that the bitmap may have, a part of the bytes at a time."""
    for a in range(0, len(raw), PART_BYTES):
        for size, h in grams(raw[a : a + PART_BYTES + LEVELS[-1] - 1]):
            if size not in sizes or not len(h):
                continue
            h = h[:PART_BYTES]
            p, q = _places(h)
            at = np.flatnonzero(bitmap[p >> 3] >> (p & 7).astype(np.uint8) & 1)
            at = at[bitmap[q[at] >> 3] >> (q[at] & 7).astype(np.uint8) & 1 > 0]
            row = np.searchsorted(off, at + a, side="right") - 1
            inside = at + a + size <= off[row + 1]
            if inside.any():
                found = np.unique(np.rec.fromarrays([row[inside], h[at[inside]]], names="r,h"))
                yield found.r, found.h


def contained(texts: DataFrame, items: DataFrame) -> DataFrame:
    """doc_id, item_id for each row of texts (doc_id, text) and each of items (item_id, item) whose item is in the text. As
    in SQL a null is in nothing and has nothing, the empty item is in every text, and repeated rows count each time."""
    spark = texts.sparkSession
    texts, items = texts.where("text is not null"), items.where("item is not null")
    some = items.where("item <> ''").select("item").distinct()
    each = some.mapInArrow(_of_items, "item string, gram_bytes int, grams array<long>").select("item", "gram_bytes", F.explode("grams").alias("gram"))
    held = each.groupBy("gram").agg(F.count("*").alias("n"))
    keys = each.join(held, "gram").groupBy("item").agg(F.min(F.struct("n", "gram", "gram_bytes")).alias("k")).select("item", "k.gram", "k.gram_bytes")

    sizes = {r.gram_bytes for r in keys.select("gram_bytes").distinct().collect()}
    places = F.explode(F.array(F.shiftrightunsigned("gram", 64 - BITS), F.col("gram").bitwiseAND((1 << BITS) - 1)))
    octets = keys.select(places.alias("p")).groupBy(F.shiftright("p", 3).alias("o")).agg(F.bit_or(F.expr("shiftleft(1, cast(p % 8 as int))")).alias("bits"))
    bitmap = np.zeros(1 << BITS - 3, np.uint8)
    got = octets.toArrow()  # 2 ** (BITS - 3) rows at most
    bitmap[got["o"].to_numpy()] = got["bits"].to_numpy().astype(np.uint8)
    shared = spark.sparkContext.broadcast(bitmap)
    kind = texts.schema["doc_id"].dataType

    def probe(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for b in batches:
            raw, off = _bytes(b.column(1))
            for row, h in text_grams(raw, off, sizes, shared.value):
                yield pa.RecordBatch.from_arrays([b.column(0).take(pa.array(row)), pa.array(h.view(np.int64))], ["doc_id", "gram"])

    probes = texts.select("doc_id", "text").mapInArrow(probe, f"doc_id {kind.simpleString()}, gram long")
    maybe = probes.join(keys.select("gram", "item"), "gram").select("doc_id", "item").distinct()
    found = maybe.join(texts.select("doc_id", "text"), "doc_id").where(F.contains("text", "item")).select("doc_id", "item")
    everywhere = texts.select("doc_id", F.lit("").alias("item")).join(items.where("item = ''").select("item_id", "item"), "item")
    return found.join(items, "item").select("doc_id", "item_id").unionByName(everywhere.select("doc_id", "item_id"))
