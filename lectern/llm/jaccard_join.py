"""N-gram Jaccard join: documents whose sets of 5-word shingles have a similarity of at least 0.75.

Size-banded tiles with hashed bitmap signatures. Documents with equal sets are one class, and only the class's
smallest id is compared further. Each set has a signature of 512 hashed bits: a bit of one signature that the
other lacks stands for a shingle that the other set lacks, so bit counts bound the overlap from above. Pairs that
the sizes and the bound allow are compared exactly, by searching one sorted array in the other.

Tiles are the classes that share an index shingle. Shingles have a global order, by their hashes. Of a set of n, of which
a linked set shares at least need = 75 % of n, the first n - need + t are its sketch: the t first shingles that two linked
sets share stand in both sketches. Of these the t - 1 most frequent ones of each set need not be indexed, as among t
shared ones the least frequent is left in both. This loses no link at any size. Lines or passages that very many
documents share are thus seldom indexed, with t = SHARED (or need, if that is less).

The join goes in two steps. First the STAR smallest hashes of each set alone make tiles, in which each class is compared
with the smallest and the largest id (a star, not all pairs); components are formed from the links. So a group of
thousands of near copies costs a few comparisons a document. Then the whole sketches are gathered, but only shingles that
stand in sketches of different components; these make the tiles in which pairs of different components are compared. Tiles with
the same smallest and largest id are one, so near copies that do not link meet a few times, not once for each shingle that they
share; and there each set has a finer signature of 8 to 16 bits a shingle, which tells them from those that link, so few are compared exactly.

Defined results: null text, text without words: empty set, linked with nothing, component_id = doc_id. Fewer than
five words: one shingle, the whole sequence. Rows with one doc_id are one document, whatever their texts: it links where
any of its texts does, and n_shingles is that of the row's text. Rows with a null doc_id are kept, without links
(component_id null). doc_id must be a whole number. Extra columns are ignored. An empty table gives an empty result.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

WORDS = 5  #: words of a shingle
PERCENT = 75  #: similarity of linked documents, in percent
SHARED, STAR = 24, 32
BITS = 8  #: 64-bit words of a signature
BLOCK = 256  #: documents of a tile that meet as many others in one cell

_SIG = [f"s{i}" for i in range(BITS)]
_SKETCHED = "doc_id long, n long, fp0 long, fp1 long, " + ", ".join(f"{s} long" for s in _SIG) + ", sketch array<long>"


def shingle_sets(texts: pa.Array, n: int = WORDS) -> Iterator[np.ndarray]:
    """The sorted distinct hashes of each text's shingles of n words."""
    raw_all, off_all = S.utf8(texts)
    for a, b in S.slices(off_all):
        raw, off = S.LOWER[raw_all[off_all[a] : off_all[b]]], off_all[a : b + 1] - off_all[a]
        starts, ends, row = S.word_spans(raw, off, S.SPACED)
        words = S.word_hashes(raw, starts, ends)
        grams = S.gram_hashes(words, n)
        cut = np.searchsorted(row, np.arange(b - a + 1))
        for lo, hi in zip(cut[:-1], cut[1:], strict=True):
            if hi - lo >= n:
                yield np.unique(grams[lo : hi - n + 1])
            elif hi > lo:
                yield S.gram_hashes(words[lo:hi], hi - lo)
            else:
                yield np.zeros(0, np.uint64)


def sketch_size(n: int) -> int:
    need = -(-PERCENT * n // 100)
    return n - need + min(SHARED, need)


def lists(arrays: list[np.ndarray]) -> pa.Array:
    ends = np.cumsum([0, *map(len, arrays)])
    flat = np.concatenate(arrays).view(np.int64) if arrays else np.zeros(0, np.int64)
    return pa.ListArray.from_arrays(pa.array(ends, pa.int32()), pa.array(flat))


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shifts = np.arange(64, dtype=np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            size, fp, sig, sketch = [], [], [], []
            for s in shingle_sets(part.column(1)):
                size.append(len(s))
                fp.append((s.sum(dtype=np.uint64), np.bitwise_xor.reduce(S.mix64(s)) if len(s) else 0))
                bits = np.zeros(BITS * 64, bool)
                bits[s % np.uint64(BITS * 64)] = True
                sig.append((bits.reshape(BITS, 64).astype(np.uint64) << shifts).sum(1, dtype=np.uint64))
                sketch.append(s[: sketch_size(len(s))])
            fps, sigs = np.array(fp, np.uint64).reshape(-1, 2).view(np.int64), np.array(sig, np.uint64).reshape(-1, BITS).view(np.int64)
            cols = [part.column(0), pa.array(size, pa.int64()), *(pa.array(fps[:, i].copy()) for i in (0, 1)), *(pa.array(sigs[:, i].copy()) for i in range(BITS)), lists(sketch)]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp0", "fp1", *_SIG, "sketch"])


def _set_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 512):
            part = batch.slice(at, 512)
            yield pa.RecordBatch.from_arrays([part.column(0), lists(list(shingle_sets(part.column(1))))], ["doc_id", "grams"])


def _fine_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """doc_id, n, fine: a signature of 8 to 16 bits a shingle; a power of two of words, so that the longer of two folds onto the shorter."""
    for batch in batches:
        for at in range(0, len(batch), 512):
            part, size, fine = batch.slice(at, 512), [], []
            for s in shingle_sets(part.column(1)):
                bits = np.zeros(64 << max(0, len(s) - 1 >> 3).bit_length(), bool)
                bits[s % np.uint64(len(bits))] = True
                size.append(len(s))
                fine.append(np.packbits(bits, bitorder="little").view(np.uint64))
            yield pa.RecordBatch.from_arrays([part.column(0), pa.array(size, pa.int64()), lists(fine)], ["doc_id", "n", "fine"])


def _compare_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    """Keeps the pairs whose sorted arrays overlap enough."""
    for batch in batches:
        keep = []
        ends = [(c.offsets.to_numpy(), c.values.to_numpy().view(np.uint64)) for c in (batch.column(2), batch.column(3))]
        (la, va), (lb, vb) = ends
        for i in range(len(batch)):
            a, b = va[la[i] : la[i + 1]], vb[lb[i] : lb[i + 1]]
            if len(a) > len(b):
                a, b = b, a
            at = np.minimum(np.searchsorted(b, a), max(0, len(b) - 1))
            both = int((b[at] == a).sum()) if len(a) and len(b) else 0
            keep.append(100 * both >= PERCENT * (len(a) + len(b) - both) and both > 0)
        yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in batch.columns[:2]], ["a", "b"])


def _may_link(x: str, y: str) -> Column:
    """Whether sizes and bit counts allow an overlap that links (overlap o of sizes n, m: o >= 75/175 (n + m))."""
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    only_x = sum((F.bit_count(F.col(f"{x}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{y}.{s}")))) for s in _SIG), F.lit(0))
    only_y = sum((F.bit_count(F.col(f"{y}.{s}").bitwiseAND(F.bitwise_not(F.col(f"{x}.{s}")))) for s in _SIG), F.lit(0))
    return _sized(n, m) & _enough(F.least(n - only_x, m - only_y), n, m)


def _sized(n: Column, m: Column) -> Column:
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _enough(overlap: Column, n: Column, m: Column) -> Column:
    return (100 + PERCENT) * overlap >= PERCENT * (n + m)


def _may_link_finely(x: str, y: str) -> Column:
    """The same by finer signatures, for documents that share one of their grams. Linked sizes differ by a third at most, so one folding is enough."""
    n, m, a, b = (F.col(c) for c in (f"{x}.n", f"{y}.n", f"{x}.fine", f"{y}.fine"))
    width = F.least(F.size(a), F.size(b))
    folded = lambda v: F.when(F.size(v) == width, v).otherwise(F.zip_with(F.slice(v, F.lit(1), width), F.slice(v, width + 1, width), lambda p, q: p.bitwiseOR(q)))
    only = lambda v, w: F.aggregate(F.zip_with(folded(v), folded(w), lambda p, q: F.bit_count(p.bitwiseAND(F.bitwise_not(q)))), F.lit(0), lambda s, c: s + c)
    return _sized(n, m) & F.arrays_overlap(f"{x}.grams", f"{y}.grams") & _enough(n - only(a, b), n, m) & _enough(m - only(b, a), n, m)


def _linked(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) that do link, by exact comparison of the sets of their texts; a written table."""
    ids = S.staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    sets = S.by_id(docs, ids, "left_semi").mapInArrow(_set_batches, "doc_id long, grams array<long>")
    written = S.staged(sets, "sets")
    sets = written.repartition("doc_id").distinct()  # dealt once, for both sides
    with_b = pairs.join(sets.select(F.col("doc_id").alias("b"), F.col("grams").alias("grams_b")), "b")
    both = with_b.join(sets.select(F.col("doc_id").alias("a"), F.col("grams").alias("grams_a")), "a")
    links = S.staged(both.select("a", "b", "grams_a", "grams_b").mapInArrow(_compare_batches, "a long, b long").distinct(), "links")
    S.forget(written, ids)
    return links


def distinct_tiles(entries: DataFrame) -> DataFrame:
    """(gram, doc_id) of tiles with two documents or more; of tiles with the same documents, as the shingles of near
    copies have, the first alone. Two 64-bit combinations of hashes, the count and both ends tell sets of documents apart."""
    one, two = F.xxhash64("doc_id"), F.xxhash64("doc_id", F.lit(1))
    of_tile = entries.groupBy("gram").agg(
        F.count("*").alias("n"), F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.bit_xor(one).alias("h1"), F.bit_xor(two).alias("h2"),
    ).where("low < high")
    first = of_tile.groupBy("n", "low", "high", "h1", "h2").agg(F.min("gram").alias("gram")).select("gram")
    return S.staged(entries.join(first, "gram"), "tiles")


def components(nodes: DataFrame, links: DataFrame) -> DataFrame:
    """(id, comp): the smallest id that links reach from each node. Labels pass along links and are then shortened
    through the label's own label, until none changes; each round is written."""
    edges = links.select("a", "b").unionByName(links.select(F.col("b").alias("a"), F.col("a").alias("b"))).distinct()
    edges = S.staged(edges, "edges")
    label = S.staged(nodes.select("id", F.col("id").alias("comp")), "labels")
    while True:
        near = edges.join(label, edges.a == label.id).groupBy(F.col("b").alias("id")).agg(F.min("comp").alias("near"))
        met = label.select("id", "comp").join(near, "id", "left").select("id", "comp", F.least("comp", F.coalesce("near", "comp")).alias("met"))
        up = label.select(F.col("id").alias("met"), F.col("comp").alias("up"))
        new = S.staged(met.join(up, "met", "left").select("id", F.col("comp").alias("old"), F.least("met", F.coalesce("up", "met")).alias("comp")), "labels")
        S.forget(label)
        if new.where("comp < old").isEmpty():
            S.forget(edges)
            return new.select("id", "comp")
        label = new


def linked_components(links: DataFrame) -> DataFrame:
    """components() of the ids that have links."""
    return components(links.select(F.explode(F.array("a", "b")).alias("id")).distinct(), links)


KEY = ["fp0", "fp1", "n"]  #: equal for equal sets


def class_tables(sketches: DataFrame) -> tuple[DataFrame, DataFrame, DataFrame, DataFrame]:
    """Of staged sketches (doc_id, KEY, more), which are then deleted: doc_id and KEY of all rows; KEY and class_id of each
    class of equal sets; the sketches of the classes' smallest ids; (a, b) of classes that have a document in common, as it has several texts."""
    sketched = S.staged(sketches.select("doc_id", *KEY), "keys")
    some = sketched.where("n > 0 and doc_id is not null")
    classes = S.staged(some.groupBy(*KEY).agg(F.min("doc_id").alias("class_id")), "classes")
    leads = classes.withColumnRenamed("class_id", "doc_id")
    # most documents have one row, which is its class's smallest: their sketches stay where they are
    leading = some.join(leads.withColumn("lead", F.lit(1)), ["doc_id", *KEY], "left").groupBy("doc_id").agg(F.count("*").alias("rows"), F.count("lead").alias("leads"))
    other = S.staged(leading.where("rows > 1 or leads = 0").select("doc_id"), "other")
    alone = S.by_id(sketches.where("n > 0 and doc_id is not null"), other, "left_anti")
    rest = S.by_id(sketches, other, "left_semi").join(leads, ["doc_id", *KEY], "left_semi").dropDuplicates(["doc_id", *KEY])
    first = S.staged(alone.unionByName(rest), "first")
    S.forget(sketches, other)
    several = S.staged(some.groupBy("doc_id").agg(F.min("fp0").alias("lo"), F.max("fp0").alias("hi")).where("lo < hi").select("doc_id"), "several")
    of_doc = S.by_id(some, several, "left_semi").join(classes, KEY).groupBy("doc_id").agg(F.min("class_id").alias("a"), F.collect_set("class_id").alias("all"))
    same = S.staged(of_doc.select("a", F.explode("all").alias("b")).where("a < b").distinct(), "same")
    return sketched, classes, first, same


def with_components(sketched: DataFrame, classes: DataFrame, label: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id, component_id of all rows."""
    moved = label.where("comp < id").select(F.col("id").alias("class_id"), "comp")
    whole = classes.join(moved, "class_id", "left").select(*KEY, "class_id", F.coalesce("comp", "class_id").alias("comp"))
    out = sketched.select("doc_id", *KEY).join(whole, KEY, "left")
    own = F.col("doc_id").isNull() | F.col("class_id").isNull()
    return out.select(
        "doc_id",
        F.col("n").alias("n_shingles"),
        F.when(own, F.col("doc_id")).otherwise(F.col("class_id")).alias("class_id"),
        F.when(own, F.col("doc_id")).otherwise(F.col("comp")).alias("component_id"),
    )


def _stars(first: DataFrame, facts: DataFrame) -> DataFrame:
    """Pairs (a, b) of a document and the smallest or largest id of a tile of its STAR smallest hashes; a written table."""
    entries = S.staged(first.select("doc_id", F.explode(F.slice("sketch", 1, STAR)).alias("gram")).distinct(), "entries")
    tiles = distinct_tiles(entries)
    ends = tiles.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high")).where("low < high")
    ends = tiles.join(ends, "gram").select("doc_id", F.explode(F.array("low", "high")).alias("end")).where("doc_id <> end")
    pairs = ends.select(F.least("doc_id", "end").alias("a"), F.greatest("doc_id", "end").alias("b")).distinct()
    out = S.staged(_allowed(pairs, facts), "stars")
    S.forget(entries, tiles)
    return out


def _allowed(pairs: DataFrame, facts: DataFrame) -> DataFrame:
    return pairs.join(facts.toDF("a", "x"), "a").join(facts.toDF("b", "y"), "b").where(_may_link("x", "y")).select("a", "b").distinct()


def _crossing(first: DataFrame, label: DataFrame, docs: DataFrame) -> DataFrame:
    """Pairs (a, b) of different components that share an index shingle and may link; a written table. A document with several
    texts has the sketches of all, and sets as few shingles aside as the text that sets aside the fewest.

    Near copies of one text share many shingles, and most of these tiles have the same smallest and largest document: such tiles are
    brought together, with a row for each document that lists its shingles in them, so a pair comes up in a few places."""
    comp = label.select(F.col("id").alias("doc_id"), "comp")
    named = first.select("doc_id", "sketch").join(comp, "doc_id", "left").select(F.coalesce("comp", "doc_id").alias("comp"), F.explode("sketch").alias("gram"))
    mixed = S.staged(named.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi").select("gram"), "mixed")
    entries = first.select("doc_id", F.explode("sketch").alias("gram"))
    held = S.staged(entries.join(mixed, "gram", "left_semi").distinct(), "held")
    df = held.groupBy("gram").agg(F.count("*").alias("df"))
    of_doc = held.join(df, "gram").groupBy("doc_id").agg(F.sort_array(F.collect_list(F.struct("df", "gram"))).alias("found"))
    aside = first.groupBy("doc_id").agg(F.least(F.lit(SHARED), F.ceil(F.min("n") * PERCENT / 100)).alias("t"))
    free = F.size("found") - F.col("t") + 1
    indexed = of_doc.join(aside, "doc_id").where(free > 0)
    indexed = indexed.select("doc_id", F.explode(F.slice("found", F.lit(1), free.cast("int"))).alias("x")).select("doc_id", F.col("x.gram").alias("gram"))
    indexed = S.staged(indexed.join(comp, "doc_id", "left").withColumn("comp", F.coalesce("comp", "doc_id")), "indexed")
    tiles = indexed.groupBy("gram").agg(F.min("doc_id").alias("low"), F.max("doc_id").alias("high"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    homes = tiles.select("gram", F.xxhash64("low", "high").alias("home"))
    met = S.staged(indexed.join(homes, "gram").groupBy("home", "doc_id", "comp").agg(F.collect_list("gram").alias("grams")).withColumnRenamed("home", "gram"), "met")
    ids = S.staged(met.select("doc_id").distinct(), "ids")
    fine = S.by_id(docs, ids, "left_semi").mapInArrow(_fine_batches, "doc_id long, n long, fine array<long>").where("n > 0").distinct()
    with_fine = met.join(_blocks(met), "gram").join(fine, "doc_id")  # blocks come first, so the wide rows are dealt to their cells at once
    rows = S.staged(with_fine.select("gram", "doc_id", "comp", "blocks", F.struct("n", "fine", "grams").alias("m")), "rows")
    out = S.staged(_cell_pairs(rows, _may_link_finely), "cross")
    S.forget(mixed, held, indexed, met, ids, rows)
    return out


def tile_pairs(rows: DataFrame, may_link: Callable[[str, str], Column]) -> DataFrame:
    """Pairs (a, b) of different components of a tile that may link. rows: gram, doc_id, comp, m (what may_link tells it by).

    A tile's documents are dealt into blocks of about BLOCK; the blocks meet two by two, so no task holds more than two of them
    at once, however many documents a tile has. Tiles of one component make no pair."""
    return _cell_pairs(rows.join(_blocks(rows), "gram"), may_link)


def _blocks(rows: DataFrame) -> DataFrame:
    """gram, blocks of the tiles with several components."""
    ends = rows.groupBy("gram").agg(F.count("*").alias("size"), F.min("comp").alias("lo"), F.max("comp").alias("hi")).where("lo < hi")
    return ends.select("gram", F.ceil(F.col("size") / BLOCK).alias("blocks"))


def _cell_pairs(rows: DataFrame, may_link: Callable[[str, str], Column]) -> DataFrame:
    """tile_pairs() of rows that have the number of their tile's blocks."""
    rest = rows.withColumn("block", F.pmod(F.xxhash64("doc_id"), F.col("blocks")))
    dealt = rest.withColumn("other", F.explode(F.sequence(F.lit(0).cast("long"), F.col("blocks") - 1)))
    dealt = dealt.select("gram", "doc_id", "comp", "block", "m", F.least("block", "other").alias("one"), F.greatest("block", "other").alias("two"))
    x, y = dealt.alias("x"), dealt.alias("y")
    same = (F.col("x.gram") == F.col("y.gram")) & (F.col("x.one") == F.col("y.one")) & (F.col("x.two") == F.col("y.two"))
    once = (F.col("x.one") == F.col("x.two")) | (F.col("x.block") != F.col("y.block"))  # documents of one block meet in its own cell only
    cross = x.join(y, same & once & (F.col("x.comp") < F.col("y.comp")) & may_link("x.m", "y.m"))
    return cross.select(F.least("x.doc_id", "y.doc_id").alias("a"), F.greatest("x.doc_id", "y.doc_id").alias("b")).distinct()


def jaccard_classes(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reached by links)."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched, classes, first, same = class_tables(S.staged(docs.mapInArrow(_sketch_batches, _SKETCHED), "sketches"))
    facts = first.select("doc_id", F.struct("n", *_SIG).alias("m"))

    star_pairs = _stars(first, facts)
    links = S.staged(_linked(star_pairs, docs).unionByName(same), "links")
    label = linked_components(links)

    pairs = S.staged(_crossing(first, label, docs).join(star_pairs, ["a", "b"], "left_anti"), "cross")
    S.forget(first)
    if not pairs.isEmpty():
        links = S.staged(links.unionByName(_linked(pairs, docs)), "links")
        label = linked_components(links)
    return with_components(sketched, classes, label)


def keep_one(docs: DataFrame) -> DataFrame:
    """Of each component one document stays, that with the smallest doc_id; of its rows one for each text that differs.
    Rows with a null doc_id stay."""
    leads = jaccard_classes(docs).where("doc_id is not null").groupBy("doc_id").agg(F.count_if(F.col("component_id") == F.col("doc_id")).alias("n"))
    gone = S.staged(leads.where("n = 0").select("doc_id"), "gone")  # far fewer than those that stay, so the texts stay where they are
    kept = S.by_id(docs, gone, "left_anti")
    again = S.staged(kept.where("doc_id is not null").groupBy("doc_id").agg(F.count("*").alias("n")).where("n > 1").select("doc_id"), "repeated")
    once, twice = S.by_id(kept, again, "left_anti"), S.by_id(kept, again, "left_semi")
    order = Window.partitionBy("doc_id", "text").orderBy(F.to_json(F.struct(*twice.columns)))  # the same row in every attempt
    twice = twice.withColumn("_lectern_row", F.row_number().over(order)).where("_lectern_row = 1").drop("_lectern_row")
    return once.unionByName(twice)


def op8_jaccard_join(spark, sf_dir: str) -> DataFrame:
    return jaccard_classes(S.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id")


def sql(n: int, percent: int, more: str = "") -> str:
    return rf"""
WITH RECURSIVE words AS (
  SELECT doc_id, list_filter(regexp_split_to_array(translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[\x20\x09-\x0D]+'), lambda w: w <> '') AS w
  FROM documents
), grams AS (
  SELECT doc_id, list_distinct(CASE WHEN len(w) = 0 THEN [] WHEN len(w) < {n} THEN [array_to_string(w, ' ')]
         ELSE list_transform(range(1, len(w) - {n - 2}), lambda i: array_to_string(list_slice(w, i, i + {n - 1}), ' ')) END) AS g
  FROM words
), one AS (SELECT doc_id, len(g) AS n, unnest(g) AS x FROM grams
), pairs AS (
  SELECT a.doc_id AS a, b.doc_id AS b FROM one a JOIN one b ON a.x = b.x AND a.doc_id < b.doc_id
  GROUP BY a.doc_id, b.doc_id, a.n, b.n HAVING 100 * count(*) >= {percent} * (a.n + b.n - count(*))
), edges AS (SELECT a, b FROM pairs UNION SELECT b, a FROM pairs
), reach AS (
  SELECT doc_id AS id, doc_id AS seen FROM documents
  UNION SELECT r.id, e.b FROM reach r JOIN edges e ON r.seen = e.a
)
SELECT g.doc_id, CAST(len(g.g) AS BIGINT) AS n_shingles, c.component_id{more}
FROM grams g JOIN (SELECT id, min(seen) AS component_id FROM reach GROUP BY id) c ON c.id = g.doc_id
"""


SQL = sql(WORDS, PERCENT)
