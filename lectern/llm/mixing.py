"""Mixing sources to target weights by Pfair scheduling, with DataFrame functions only.

Each source's documents, one behind the other, are cut into blocks of BLOCK_CHARS characters, each of which takes one
slot; a document that crosses the end of a block is split there, so every slot but a source's last carries a whole block.
Block i (from 0) of a source of weight w is released at floor(i / w) and due at ceil((i + 1) / w). There are two ways:

* All weights are whole slots of a period: in each slot the released block with the earliest deadline goes out, which
  keeps every source within one block of its target at every slot. The schedule repeats after each period, when every
  source has exactly its share, so one period is scheduled and block i takes the slot of its place in the period.
  Default targets are whole slots by definition (unless there are more sources than slots), and given weights are tried
  with PERIOD and its multiples up to MULTIPLES.
* Otherwise no period repeats. The sources form a Huffman tree by weight, kept in units of which a slot has UNITS; of
  the first n slots of a node its left child has n times its part of the weight, rounded, and its right child the others.
  A block's slot is the inverse of this along its path, in whole numbers, whatever came before: nothing adds up. A node
  is off its target by half a block at most, and by its part of what its parent is off, so a source by half the sum of
  w / (weight of the node) over its path below the root: under 1 block for three sources or fewer, and under 1.69 for any
  number and weights, as weights grow like Fibonacci numbers along a path.

Nothing runs in sequence over the data. Slots of a source that has run out stay empty: later rows move up, and no
document is lost or repeated. The tree is made on the driver, from the weights of the sources alone.

A document's place in its source is its place by (bucket, doc_id): buckets by hash hold about one block each, and
ranges of RANGE buckets add up first, so no window holds a whole source, however large it is.

Defined results: a null source is a source of its own; a null text is empty and counts one character, as every
document counts its length plus one. Equal doc_ids are ordered by length. Weights that name no source present are
ignored, sources without a weight share what is left to 1 by size (or the smallest weight if nothing is left).
Extra columns are kept. An empty table gives an empty result.
"""

from __future__ import annotations

import heapq

import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from . import shared as S

BLOCK_CHARS = 1 << 16
PERIOD = 500
MULTIPLES = 20
UNITS = 1 << 24  #: of weight in a slot of the period
RANGE = 4096  #: buckets
_TIMES = ("mix_source", "mix_block", "mix_release", "mix_due", "mix_slot")
_ADDED = (*_TIMES, "mix_place", "mix_from", "mix_to")
ALPHA = 0.5  #: default targets: total size to this power


def _key(source: Column) -> Column:
    return F.coalesce(F.concat(F.lit("="), source.cast("string")), F.lit("null"))


def source_shares(docs: DataFrame, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """mix_source, total characters, buckets, period, weight (units), share (slots of the period, with their fraction) for each
    source. Without given weights the shares are whole slots where there are no more sources than slots."""
    if weights:
        whole = sum(weights.values())
        fits = lambda q: whole > 1 - 1e-9 and all(abs(q * w / whole - round(q * w / whole)) < 1e-6 for w in weights.values())
        period = next((k * period for k in range(1, MULTIPLES + 1) if fits(k * period)), period)
    size = F.length(F.coalesce("text", F.lit(""))).cast("long") + 1
    totals = docs.groupBy(_key(F.col("source")).alias("mix_source")).agg(F.sum(size).alias("total"))
    every = Window.partitionBy(F.lit(1))
    if weights:
        named = F.create_map(*[F.lit(x) for s, w in weights.items() for x in ("null" if s is None else f"={s}", float(w))])
        given = F.element_at(named, F.col("mix_source"))
        rest = F.greatest(F.lit(0.0), 1 - F.coalesce(F.sum(given).over(every), F.lit(0.0)))
        others = F.sum(F.when(given.isNull(), F.col("total"))).over(every)
        want = F.coalesce(given, F.when(rest > 0, rest * F.col("total") / others).otherwise(F.lit(min(weights.values()))))
    else:
        want = F.pow("total", F.lit(float(alpha)))
    slot = F.when(F.count(F.lit(1)).over(every) <= period, UNITS).otherwise(1) if not weights else F.lit(1)
    totals = totals.withColumn("want", want).withColumn("slot", slot.cast("long"))
    exact = F.greatest(F.col("want") / F.sum("want").over(every) * F.lit(period * UNITS) / F.col("slot"), F.lit(1.0))
    totals = totals.withColumn("exact", exact).withColumn("floor", F.floor("exact"))
    # largest remainders; what shares raised to one slot have taken is given back by the largest, one each in turn
    left = (F.lit(period * UNITS) / F.col("slot")).cast("long") - F.sum("floor").over(every)
    order = Window.partitionBy(F.lit(1)).orderBy(F.round(F.col("exact") - F.col("floor"), 3).desc(), F.col("want").desc(), F.col("mix_source"))
    largest = Window.partitionBy(F.lit(1)).orderBy(F.col("want").desc(), F.col("mix_source"))
    totals = totals.withColumn("left", left).withColumn("share", F.col("floor") + (F.row_number().over(order) <= F.col("left")).cast("long"))
    spare = Window.partitionBy(F.lit(1)).orderBy(F.col("want").desc(), F.col("mix_source")).rowsBetween(Window.unboundedPreceding, -1)
    before = F.coalesce(F.sum(F.col("share") - 1).over(spare), F.lit(0))  # what larger sources could give
    ever_more = (F.row_number().over(largest) == 1) & (F.sum(F.col("share") - 1).over(every) <= 0)
    give = F.greatest(F.lit(0), F.least(F.col("share") - 1, -F.col("left") - before))
    weight = (F.col("share") - F.when(F.col("left") < 0, F.when(ever_more, 0).otherwise(give)).otherwise(0)) * F.col("slot")
    totals = totals.withColumn("weight", weight.cast("long"))
    return totals.select("mix_source", "total", F.ceil(F.col("total") / block_chars).alias("buckets"), F.lit(period).cast("long").alias("period"), "weight", (F.col("weight") / UNITS).alias("share"))


def paths(weights: dict[str, int]) -> dict[str, list[dict]]:
    """For each source the nodes from itself to below the root of the Huffman tree: weights of node and parent, right child or not."""
    above, heap = {}, [(w, k) for k, (_, w) in enumerate(sorted(weights.items()))]
    heapq.heapify(heap)
    new = len(heap)
    while len(heap) > 1:
        (v, x), (w, y) = heapq.heappop(heap), heapq.heappop(heap)
        above[x], above[y] = (new, v, v + w, False), (new, w, v + w, True)
        heapq.heappush(heap, (v + w, new))
        new += 1
    out = {}
    for k, s in enumerate(sorted(weights)):
        out[s] = []
        while k in above:
            k, own, whole, right = above[k]
            out[s].append({"own": own, "whole": whole, "right": right})
    return out


def _times(a: str, b: str) -> str:
    return f"cast({a} as decimal(20, 0)) * cast({b} as decimal(14, 0))"


def _slot(block: str) -> Column:
    """The slot of a block of the source of path: level by level, the place among the parent's of that place among the node's."""
    part, twice = _times("2 * m - 1", "x.whole"), "cast(2 * x.own as decimal(14, 0))"
    return F.expr(f"aggregate(path, cast({block} + 1 as bigint), (m, x) -> if(x.right, ({part}) div {twice} + 1, ({part} + 2 * x.own - 1) div {twice})) - 1")


def schedule(blocks: DataFrame, shares: DataFrame) -> DataFrame:
    """blocks (mix_source, mix_block, more) with mix_release, mix_due and mix_slot. shares: a written table, a row for each source."""
    whole = F.col("period") * UNITS
    if shares.where(F.col("weight") % UNITS != 0).isEmpty():
        fit = shares.select("mix_source", "period", F.floor("share").alias("share"))
        slots = S.staged(period_slots(fit).join(F.broadcast(fit), "mix_source"), "slots")
        share = F.broadcast(fit.select("mix_source", F.col("share").alias("_share")))
        timed = blocks.join(share, "mix_source").withColumn("i", F.col("mix_block") % F.col("_share")).drop("_share").join(F.broadcast(slots), ["mix_source", "i"])
        timed = timed.withColumn("mix_slot", F.floor(F.col("mix_block") / F.col("share")).cast("long") * F.col("period") + F.col("slot"))
        timed = timed.join(F.broadcast(shares.select("mix_source", "weight", whole.alias("_whole"))), "mix_source")
    else:
        found = paths({r.mix_source: r.weight for r in shares.select("mix_source", "weight").collect()})
        kind = pa.list_(pa.struct({"own": pa.int64(), "whole": pa.int64(), "right": pa.bool_()}))
        tree = shares.sparkSession.createDataFrame(pa.table({"mix_source": pa.array(list(found), pa.string()), "path": pa.array(list(found.values()), kind)}))
        tree = S.staged(tree.join(shares.select("mix_source", "weight", whole.alias("_whole")), "mix_source"), "tree")
        timed = blocks.join(F.broadcast(tree), "mix_source").withColumn("mix_slot", _slot("mix_block"))
    release = F.expr(f"({_times('mix_block', '_whole')}) div weight")
    due = F.expr(f"({_times('mix_block + 1', '_whole')} + weight - 1) div weight")
    return timed.select(*blocks.columns, release.alias("mix_release"), due.alias("mix_due"), "mix_slot")


def period_slots(shares: DataFrame) -> DataFrame:
    """mix_source, i, slot: the slots of one period under earliest deadline first among released blocks.

    One row holds all sources of the period (each has a slot of it at least); the state of the fold is each source's number of blocks sent out."""
    packed = shares.groupBy().agg(F.max("period").alias("q"), F.array_sort(F.collect_list(F.struct("mix_source", "share"))).alias("s"))
    zero = F.lit(0).cast("long")

    def due(done: Column, share: Column, q: Column) -> Column:
        return F.ceil((done + 1) * q / share)

    def send(state: Column, t: Column) -> Column:
        """Adds the slot's source (its index) to state.out and counts it in state.done."""
        ranked = F.transform(
            F.col("s"),
            lambda x, k: F.when(
                (F.floor(F.get(state["done"], k) * F.col("q") / x["share"]) <= t) & (F.get(state["done"], k) < x["share"]),
                F.struct(due(F.get(state["done"], k), x["share"], F.col("q")).alias("due"), k.alias("k")),
            ),
        )
        best = F.array_min(ranked)["k"]
        return F.transform(F.array(best), lambda b: F.struct(
            F.transform(state["done"], lambda d, k: F.when(k == b, d + 1).otherwise(d)).alias("done"),
            F.concat(state["out"], F.array(F.coalesce(b, F.lit(-1)))).alias("out"),
        ))[0]

    start = F.struct(F.transform("s", lambda x: zero).alias("done"), F.array().cast("array<int>").alias("out"))
    out = F.aggregate(F.sequence(zero, F.col("q") - 1), start, send, lambda state: state["out"])
    slots = packed.where("size(s) > 0").select("s", F.posexplode(out).alias("slot", "k")).where("k >= 0")
    slots = slots.select(F.expr("s[k].mix_source").alias("mix_source"), F.col("slot").cast("long").alias("slot"))
    return slots.select("mix_source", "slot", (F.row_number().over(Window.partitionBy("mix_source").orderBy("slot")) - 1).cast("long").alias("i"))


def _scheduled(docs: DataFrame, carry: list[str], split: bool, weights: dict[str, float] | None = None, alpha: float = ALPHA, block_chars: int = BLOCK_CHARS, period: int = PERIOD) -> DataFrame:
    """_doc, a struct of the carried columns (so that their names cannot clash), and the schedule's columns. split: a row for
    each part of a document that lies in one block; else one for each document, with the block in which it starts."""
    shares = S.staged(source_shares(docs, weights, alpha, block_chars, period), "shares")
    size = F.length(F.coalesce("text", F.lit(""))).cast("long") + 1
    rows = docs.select(F.struct(*carry).alias("_doc"), "doc_id", _key(F.col("source")).alias("mix_source"), size.alias("_len"))
    bucket = F.pmod(F.xxhash64("doc_id"), F.col("buckets"))
    rows = rows.join(F.broadcast(shares.select("mix_source", "buckets")), "mix_source").withColumn("_bucket", bucket)

    before = lambda x, w: F.coalesce(F.sum(x).over(w.rowsBetween(Window.unboundedPreceding, -1)), F.lit(0))
    sums = rows.groupBy("mix_source", "_bucket").agg(F.sum("_len").alias("_sum")).withColumn("_range", F.floor(F.col("_bucket") / RANGE))
    ranges = sums.groupBy("mix_source", "_range").agg(F.sum("_sum").alias("_all"))
    ranges = ranges.select("mix_source", "_range", before("_all", Window.partitionBy("mix_source").orderBy("_range")).alias("_first"))
    heads = sums.withColumn("_in", before("_sum", Window.partitionBy("mix_source", "_range").orderBy("_bucket"))).join(ranges, ["mix_source", "_range"])
    heads = heads.select("mix_source", "_bucket", (F.col("_first") + F.col("_in")).alias("_head"))
    inner = Window.partitionBy("mix_source", "_bucket").orderBy("doc_id", "_len")
    placed = rows.withColumn("_in", before("_len", inner)).join(heads, ["mix_source", "_bucket"])
    placed = placed.withColumn("mix_place", (F.col("_head") + F.col("_in")).cast("long"))
    first = F.floor(F.col("mix_place") / block_chars).cast("long")
    last = F.floor((F.col("mix_place") + F.col("_len") - 1) / block_chars).cast("long") if split else first
    placed = placed.withColumn("mix_block", F.explode(F.sequence(first, last)))
    if split:
        begin = F.greatest(F.lit(0), F.col("mix_block") * block_chars - F.col("mix_place"))
        end = F.least(F.col("_len"), (F.col("mix_block") + 1) * block_chars - F.col("mix_place"))
    else:
        begin, end = F.lit(0), F.col("_len")
    placed = placed.select("_doc", "mix_source", "mix_block", "mix_place", begin.cast("long").alias("mix_from"), end.cast("long").alias("mix_to"))
    return schedule(placed, shares).select("_doc", *_ADDED)


def mix(docs: DataFrame, **how) -> DataFrame:
    """docs with mix_block (number of a block in its source), mix_release, mix_due, mix_slot, mix_place (characters of its
    source before the document), and the part of the document in that block: characters mix_from to mix_to, where the
    text's end counts as one. A row for each part; sorted by (mix_slot, mix_source, mix_place) this is the mixed order.
    Columns that docs has under these names are replaced. how: weights, alpha, block_chars, period."""
    return _scheduled(docs, [c for c in docs.columns if c not in _ADDED], True, **how).select("_doc.*", *_ADDED)


def mixed_order(docs: DataFrame, **how) -> DataFrame:
    """docs, written out in mixed order: ranges of slots, sorted within each file. Documents stay whole, each in the slot in
    which it starts, so characters can be off by a document more than slots are."""
    order = ["mix_slot", "mix_source", "mix_place"]
    return _scheduled(docs, docs.columns, False, **how).repartitionByRange(*order).sortWithinPartitions(*order).select("_doc.*")


def op5_mixing(spark, sf_dir: str) -> DataFrame:
    rows = _scheduled(S.table(spark, sf_dir, "documents"), ["doc_id", "source"], True)
    return rows.select("_doc.*", *_ADDED[1:])
