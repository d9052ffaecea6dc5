"""Near duplicates by SuperMinHash: documents whose sets of 3-word shingles have a similarity of at least 0.85.

Each element of a set deals the ranks 0 ... COMPONENTS - 1 to the components of the signature, as a random permutation, with a random
fraction added to each rank; a component keeps the least value that any element gave it. Two sets agree in a component with
a chance equal to their similarity, as in MinHash, but an element that wins one component early is less likely to win others, so the
share of equal components varies less. Ranks are dealt one after the other, and no element goes on when all components
have a value of a lower rank: large sets are done after a few ranks.

BANDS bands of ROWS components are hashed. Documents with a band in common are candidates; a pair at the threshold has none with a
chance of (1 - 0.85 ^ ROWS) ^ BANDS = 6e-9, a closer pair with a smaller one. One bit of each component is kept: of bits that
differ in a pair at the threshold 18 are expected, and more than MOST_BITS with a chance below 1e-10. Candidates that sizes and bits allow are
verified on their whole sets, made again from their texts.

Equal sets are one class, and the class's smallest id stands for it. Then rounds: of a band's documents, each component's
smallest is compared with the smallest of all (a star, whose rows grow with the documents), each document with the closest
such partner; found links form components by union-find (labels pass along links, and are shortened through the
label's own label). When a round finds no link, all other pairs of different components that share a band are compared, but for
those that their overlaps with a common third document rule out (``_crossing``).

Defined results: null text, text without words: empty set, linked with nothing, component_id = doc_id. Fewer than
three words: one shingle, the whole sequence. Rows with one doc_id are one document, whatever their texts: it links where
any of its texts does, and n_shingles is that of the row's text. Rows with a null doc_id are kept, without links
(component_id and kept null). doc_id must be a whole number. Extra columns are ignored. An empty table gives an empty result.
Shingles are compared by 64-bit hashes.
"""

from __future__ import annotations

from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import jaccard_join as J
from . import shared as S

WORDS, PERCENT = 3, 85
ROWS, BANDS = 6, 40
COMPONENTS = ROWS * BANDS
MOST_BITS = 50
HOT = 500  #: pairs of one document that one task reads, before its text is given to several
CHUNK = 1 << 15  #: elements whose permutations are held at once

_SIG = [f"s{i}" for i in range(-(-COMPONENTS // 64))]
_SKETCHED = "doc_id long, n long, fp0 long, fp1 long, " + ", ".join(f"{s} long" for s in _SIG) + ", bands array<long>"
_ODD = np.uint64(0x9E3779B97F4A7C15)
_STEPS = np.arange(1, COMPONENTS + 1, dtype=np.uint64) * _ODD
_OPEN = np.uint64((1 << 64) - 1)


def signatures(sets: list[np.ndarray]) -> np.ndarray:
    """(len(sets), COMPONENTS): rank in the highest byte, the fraction below it. Empty sets have the largest value throughout."""
    out = np.full((len(sets), COMPONENTS), _OPEN)
    flat, of = out.reshape(-1), np.repeat(np.arange(len(sets)), [len(s) for s in sets])
    every = np.concatenate([*sets, np.zeros(0, np.uint64)])
    for at in range(0, len(every), CHUNK):
        x, row = every[at : at + CHUNK], of[at : at + CHUNK]
        deal = np.tile(np.arange(COMPONENTS, dtype=np.uint8), (len(x), 1))
        for rank in range(COMPONENTS):
            going = np.flatnonzero(((out.max(1) >> np.uint64(56)) >= np.uint64(rank))[row])
            if not len(going):
                break
            drawn = S.mix64(x[going] + _STEPS[rank])
            k = rank + ((drawn >> np.uint64(32)) * np.uint64(COMPONENTS - rank) >> np.uint64(32)).astype(np.int64)
            component = deal[going, k]
            deal[going, k] = deal[going, rank]
            value = np.uint64(rank) << np.uint64(56) | S.mix64(drawn ^ _ODD) >> np.uint64(8)
            np.minimum.at(flat, row[going] * COMPONENTS + component, value)
    return out


def band_hashes(sig: np.ndarray) -> np.ndarray:
    """(n, BANDS): each band's number and values, hashed."""
    out = np.broadcast_to(np.arange(BANDS, dtype=np.uint64), (len(sig), BANDS)).copy()
    for i in range(ROWS):
        out = S.mix64(out * _ODD + sig[:, i::ROWS])
    return out


def _sketch_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    shifts = np.arange(64, dtype=np.uint64)
    for batch in batches:
        for at in range(0, len(batch), 256):
            part = batch.slice(at, 256)
            sets = list(J.shingle_sets(part.column(1), WORDS))
            size = np.array([len(s) for s in sets])
            fp = np.array([(s.sum(dtype=np.uint64), np.bitwise_xor.reduce(S.mix64(s)) if len(s) else 0) for s in sets], np.uint64).view(np.int64)
            sig = signatures(sets)
            bits = np.zeros((len(sets), len(_SIG) * 64), np.uint64)
            bits[:, :COMPONENTS] = sig & np.uint64(1)
            words = (bits.reshape(len(sets), -1, 64) << shifts).sum(2, dtype=np.uint64).view(np.int64)
            ends = pa.array(np.concatenate(([0], np.cumsum(np.where(size > 0, BANDS, 0)))), pa.int32())
            bands = pa.ListArray.from_arrays(ends, pa.array(band_hashes(sig[size > 0]).ravel().view(np.int64)))
            cols = [part.column(0), pa.array(size, pa.int64()), *(pa.array(fp[:, i].copy()) for i in (0, 1)), *(pa.array(words[:, i].copy()) for i in range(len(_SIG))), bands]
            yield pa.RecordBatch.from_arrays(cols, ["doc_id", "n", "fp0", "fp1", *_SIG, "bands"])


def _differ(x: str, y: str) -> Column:
    """Bits of the components in which two documents differ."""
    return sum((F.bit_count(F.col(f"{x}.{s}").bitwiseXOR(F.col(f"{y}.{s}"))) for s in _SIG), F.lit(0))


def _sized(x: str, y: str) -> Column:
    n, m = F.col(f"{x}.n"), F.col(f"{y}.n")
    return 100 * F.least(n, m) >= PERCENT * F.greatest(n, m)


def _verify_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            keep = []
            for a, b in zip(J.shingle_sets(part.column(2), WORDS), J.shingle_sets(part.column(3), WORDS), strict=True):
                both = len(np.intersect1d(a, b, assume_unique=True))
                keep.append(both > 0 and 100 * both >= PERCENT * (len(a) + len(b) - both))
            yield pa.RecordBatch.from_arrays([c.filter(pa.array(keep, pa.bool_())) for c in part.columns[:2]], ["a", "b"])


def _with_texts(pairs: DataFrame, docs: DataFrame, one_text: bool = False) -> DataFrame:
    """a, b, text_a, text_b of written pairs (a, b). A document that is a of very many pairs is given to several tasks, by shares of
    its pairs. one_text: of the texts of a, the smallest alone."""
    ids = S.staged(pairs.select(F.explode(F.array("a", "b")).alias("id")).distinct(), "ids")
    texts = S.by_id(docs.where("doc_id is not null"), ids, "left_semi")
    shares = pairs.groupBy("a").agg(F.ceil(F.count("*") / HOT).alias("shares"))
    dealt = pairs.join(shares, "a").select("a", "b", F.pmod(F.xxhash64("b"), F.col("shares")).alias("share"))
    of_a = texts.join(shares.withColumnRenamed("a", "doc_id"), "doc_id")
    if one_text:
        of_a = of_a.groupBy("doc_id", "shares").agg(F.min("text").alias("text"))
    of_a = of_a.select(F.col("doc_id").alias("a"), F.col("text").alias("text_a"), F.explode(F.sequence(F.lit(0).cast("long"), F.col("shares") - 1)).alias("share"))
    both = dealt.join(texts.select(F.col("doc_id").alias("b"), F.col("text").alias("text_b")), "b").join(of_a, ["a", "share"])
    return both.select("a", "b", "text_a", "text_b")


def verified(pairs: DataFrame, docs: DataFrame) -> DataFrame:
    """The pairs (a, b) of a written table whose documents do link; a written table."""
    return S.staged(_with_texts(pairs, docs).mapInArrow(_verify_batches, "a long, b long").distinct(), "links")


def _star(tiles: DataFrame, label: DataFrame, facts: DataFrame, tried: DataFrame | None) -> DataFrame:
    """Pairs (a, b) to verify: for each document the closest of the smallest documents of its bands; components are labels."""
    comp = F.coalesce("comp", "doc_id")
    reps = tiles.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").groupBy("gram", comp.alias("comp")).agg(F.min("doc_id").alias("rep"))
    low = reps.groupBy("gram").agg(F.min(F.struct("comp", "rep")).alias("low"), F.max("comp").alias("high")).where("low.comp < high")
    pairs = reps.join(low, "gram").where("comp <> low.comp").select(F.least("rep", "low.rep").alias("a"), F.greatest("rep", "low.rep").alias("b"), "rep").distinct()
    if tried is not None:
        pairs = pairs.join(tried, ["a", "b"], "left_anti")
    near = pairs.join(facts.toDF("a", "x"), "a").join(facts.toDF("b", "y"), "b").where(_sized("x", "y") & (_differ("x", "y") <= MOST_BITS))
    closest = near.groupBy("rep").agg(F.min(F.struct(_differ("x", "y").alias("bits"), "a", "b")).alias("m"))
    return closest.select("m.a", "m.b").distinct()


def _trace_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        for at in range(0, len(batch), 64):
            part = batch.slice(at, 64)
            size, inside, prefixes = [], [], []
            for r, x in zip(J.shingle_sets(part.column(2), WORDS), J.shingle_sets(part.column(3), WORDS), strict=True):
                rest = np.setdiff1d(x, r, assume_unique=True)
                lacking = -(-PERCENT * len(x) // 100) - (len(x) - len(rest))  # of what any link needs, the pivot cannot give so many
                size.append(len(x))
                inside.append(len(x) - len(rest))
                prefixes.append(rest[: len(rest) - max(0, lacking - 1)])
            yield pa.RecordBatch.from_arrays([*part.columns[:2], pa.array(size, pa.int64()), pa.array(inside, pa.int64()), J.lists(prefixes)], ["r", "doc_id", "n", "inside", "prefix"])


def _crossing(tiles: DataFrame, label: DataFrame, facts: DataFrame, docs: DataFrame) -> DataFrame:
    """All pairs (a, b) of different components that share a band and may link.

    Near copies of one text need not be near to each other, and share bands in all their pairs. So each band has a pivot r, the first
    document of its largest component, and every document of the band is compared with it once. What two documents x and y share lies in
    r or outside: at most the smaller of their overlaps with r, and what their rests have in common. If the rests have nothing
    in common, the overlaps with r must be large enough for a link; this is a test of two numbers. If they have, they share more than either
    lacks, and so a hash among the first of both rests; those are joined. No link is lost, and few pairs come up that do not link."""
    comp = F.coalesce("comp", "doc_id")
    named = S.staged(tiles.join(label.withColumnRenamed("id", "doc_id"), "doc_id", "left").select("gram", "doc_id", comp.alias("comp")), "named")
    sizes = named.groupBy("gram", "comp").agg(F.count("*").alias("n"))
    pivots = sizes.groupBy("gram").agg(F.min("comp").alias("lo"), F.max("comp").alias("hi"), F.max_by("comp", F.struct("n", -F.col("comp"))).alias("r")).where("lo < hi").select("gram", "r")
    held = S.staged(named.join(pivots, "gram"), "held")
    S.forget(named)
    asked = S.staged(held.select(F.col("r").alias("a"), F.col("doc_id").alias("b")).distinct(), "asked")
    traced = S.staged(_with_texts(asked, docs, one_text=True).mapInArrow(_trace_batches, "r long, doc_id long, n long, inside long, prefix array<long>").where("n > 0"), "traced")
    m = F.struct("n", "inside", *[F.col(f"f.{s}").alias(s) for s in _SIG]).alias("m")
    known = traced.join(facts.select("doc_id", F.col("m").alias("f")), "doc_id")
    could = known.where(100 * F.col("inside") >= PERCENT * F.col("n"))  # others cannot reach a link by the pivot's part alone, whatever the other's size
    by_band = held.join(could, ["doc_id", "r"]).select("gram", "doc_id", "comp", m)
    of_doc = held.select("doc_id", "r", "comp").distinct()
    by_rest = known.join(of_doc, ["doc_id", "r"]).select(F.explode("prefix").alias("x"), "r", "doc_id", "comp", m).select(F.xxhash64("r", "x").alias("gram"), "doc_id", "comp", "m")
    near = lambda x, y: _sized(x, y) & (_differ(x, y) <= MOST_BITS)
    shared = lambda x, y: F.least(F.col(f"{x}.inside"), F.col(f"{y}.inside"))
    enough = lambda x, y: near(x, y) & ((100 + PERCENT) * shared(x, y) >= PERCENT * (F.col(f"{x}.n") + F.col(f"{y}.n")))
    out = S.staged(J.tile_pairs(by_band, enough).unionByName(J.tile_pairs(by_rest, near)).distinct(), "cross")
    S.forget(held, asked, traced)
    return out


def near_duplicates(docs: DataFrame) -> DataFrame:
    """doc_id, n_shingles, class_id (smallest id with the same set), component_id (smallest id reached by links), kept."""
    docs = docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text"))
    sketched, classes, first, same = J.class_tables(S.staged(docs.mapInArrow(_sketch_batches, _SKETCHED), "sketches"))
    facts = first.select("doc_id", F.struct("n", *_SIG).alias("m"))
    entries = S.staged(first.select("doc_id", F.explode("bands").alias("gram")).distinct(), "entries")
    tiles = J.distinct_tiles(entries)
    S.forget(entries)

    links, tried, label = same, None, J.linked_components(same)
    while True:
        pairs = S.staged(_star(tiles, label, facts, tried), "stars")
        found = verified(pairs, docs)
        tried = pairs if tried is None else S.staged(tried.unionByName(pairs), "tried")
        if found.isEmpty():
            break
        links = S.staged(links.unionByName(found), "links")
        label = J.linked_components(links)
    cross = S.staged(_crossing(tiles, label, facts, docs).join(tried, ["a", "b"], "left_anti"), "cross")
    if not cross.isEmpty():
        links = S.staged(links.unionByName(verified(cross, docs)), "links")
        label = J.linked_components(links)
    S.forget(first, tiles)
    out = J.with_components(sketched, classes, label)
    return out.withColumn("kept", F.col("doc_id") == F.col("component_id"))


def op11_super_minhash(spark, sf_dir: str) -> DataFrame:
    return near_duplicates(S.table(spark, sf_dir, "documents")).select("doc_id", "n_shingles", "component_id", "kept")


SQL = J.sql(WORDS, PERCENT, ", c.component_id = g.doc_id AS kept")
