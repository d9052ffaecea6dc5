"""Prototypes, scores against prototypes, contrastive metrics, projections, transport alignment."""

from __future__ import annotations

from collections.abc import Callable, Iterator

import numpy as np
import pandas as pd
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F
from pyspark.sql.types import DoubleType, StructField, StructType

from lectern.functions import common as C

from . import transport as T

TAU = 0.07


def balanced_prototypes(rows: DataFrame, least_groups: int) -> DataFrame:
    """keyword, group_df, sentence_df, available, vector: unit vectors averaged within sentence, then group, then over groups.

    rows: keyword, sentence, grp, vector. Means are sums by dimension, combined before each shuffle; an unavailable
    keyword keeps its row with a zero vector."""
    dims = rows.select("keyword", "sentence", "grp", F.posexplode(C.unit(F.col("vector"))).alias("dim", "x"))
    in_sentence = dims.groupBy("keyword", "grp", "sentence", "dim").agg(F.avg("x").alias("x"))
    in_group = in_sentence.groupBy("keyword", "grp", "dim").agg(F.avg("x").alias("x"))
    over = in_group.groupBy("keyword", "dim").agg(F.avg("x").alias("x"))
    vector = over.groupBy("keyword").agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v")).select("keyword", F.transform("v", lambda s: s["x"]).alias("v"))
    counts = rows.groupBy("keyword").agg(F.countDistinct("grp").alias("group_df"), F.countDistinct("sentence").alias("sentence_df"))
    available = F.col("group_df") >= least_groups
    out = vector.join(counts, "keyword").withColumn("available", available)
    return out.select("keyword", "group_df", "sentence_df", "available", F.when(available, C.unit(F.col("v"))).otherwise(F.transform("v", lambda x: F.lit(0.0))).alias("vector"))


def contributors(rows: DataFrame, member: str) -> DataFrame:
    """keyword, bucket, bits: the ids (whole numbers from 0) of the rows that a keyword's prototype is made of, as bitmaps of 32,768 ids."""
    place = F.col(member).cast("long") + 1  # positions count from 1
    return rows.select("keyword", F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("keyword", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))


def traced_prototypes(rows: DataFrame, least_groups: int, member: str) -> tuple[DataFrame, DataFrame]:
    """(balanced_prototypes, contributors) of the same rows: what the prototypes are made of goes with them."""
    return balanced_prototypes(rows, least_groups), contributors(rows, member)


def contributor_report(made_of: DataFrame, members: DataFrame, member: str) -> DataFrame:
    """keyword, contributors, from_train, leaked, unknown, missing. made_of: contributors(); members: keyword, member, role.

    Counted on bitmaps: what two sets share is the sum of their sizes less that of their union, so only bitmaps meet, a few for
    each keyword, and no ids. leaked: contributors of any other role than train; unknown: of none; missing: train members that do not contribute."""
    size = lambda df, *keys: df.groupBy(*keys).agg(F.sum(F.bitmap_count("bits")).alias("n"))
    side = F.when(F.col("role") == "train", "train").otherwise("other")
    place = F.col(member).cast("long") + 1
    of_role = members.select("keyword", side.alias("side"), F.bitmap_bucket_number(place).alias("bucket"), F.bitmap_bit_position(place).alias("at")).groupBy("keyword", "side", "bucket").agg(F.bitmap_construct_agg("at").alias("bits"))
    with_side = made_of.withColumn("side", F.explode(F.array(F.lit("train"), F.lit("other"))))
    united = of_role.unionByName(with_side).groupBy("keyword", "side", "bucket").agg(F.bitmap_or_agg("bits").alias("bits"))
    sizes = size(of_role, "keyword", "side").withColumnRenamed("n", "own").join(size(united, "keyword", "side"), ["keyword", "side"], "right").na.fill(0, ["own"])
    whole = size(made_of, "keyword").withColumnRenamed("n", "contributors")
    both = sizes.join(whole, "keyword", "left").na.fill(0, ["contributors"]).withColumn("shared", F.col("own") + F.col("contributors") - F.col("n"))
    pick = lambda s, c: F.sum(F.when(F.col("side") == s, F.col(c)).otherwise(0))
    out = both.groupBy("keyword").agg(F.max("contributors").alias("contributors"), pick("train", "shared").alias("from_train"), pick("other", "shared").alias("leaked"), pick("train", "own").alias("train"))
    return out.select("keyword", "contributors", "from_train", "leaked", (F.col("contributors") - F.col("from_train") - F.col("leaked")).alias("unknown"), (F.col("train") - F.col("from_train")).alias("missing"))


def prototype_faults(prototypes: DataFrame, tolerance: float = 1e-5) -> DataFrame:
    """Available prototypes that are not finite or not of unit length, unavailable ones that are not zero."""
    n = C.norm(F.col("vector"))
    return prototypes.where(F.isnan(n) | (F.col("available") & (F.abs(n - 1) > tolerance)) | (~F.col("available") & (n > 0)))


#: Prototypes that every task holds as one matrix; more are dealt by blocks of so many.
BLOCK = 4096
#: States that meet a block of prototypes together.
STATES = 512


def _matrix(column: pa.Array) -> np.ndarray:
    """Unit rows of a list column; zero vectors stay zero."""
    x = column.flatten().to_numpy(zero_copy_only=False).astype(float).reshape(len(column), -1)
    return x / np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), C.EPS)


def _products(states: DataFrame, prototypes: DataFrame, added: list[StructField], make: Callable[[pa.RecordBatch, np.ndarray, pa.Array], tuple[np.ndarray, list[pa.Array]]]) -> DataFrame:
    """States times available prototypes, as matrix products of blocks. make(states, cosines, keywords) gives the places of the states
    that come out, and the columns added to them, for each block of states and of prototypes.

    The prototypes are counted. Up to BLOCK are sent to all tasks as one matrix. More are dealt by blocks, in the order of keywords;
    the states are packed by STATES, and each pack meets each block in a row of its own, by a shuffle, so nothing is broadcast."""
    known = prototypes.where("available").select("keyword", F.col("vector").cast("array<double>").alias("p"))
    schema = StructType([*states.schema.fields, *added])
    names = [f.name for f in schema.fields]
    place = states.columns.index("vector")

    def product(batch: pa.RecordBatch, keys: pa.Array, p: np.ndarray) -> Iterator[pa.RecordBatch]:
        for at in range(0, len(batch), STATES):
            part = batch.slice(at, STATES)
            rows, columns = make(part, _matrix(part.column(place)) @ p.T, keys)
            yield pa.RecordBatch.from_arrays([*part.take(pa.array(rows)).columns, *columns], names)

    if known.count() <= BLOCK:
        table = known.orderBy("keyword").toArrow().combine_chunks()
        flat = table.column("p").combine_chunks() if len(table) else None
        p = flat.flatten().to_numpy(zero_copy_only=False).reshape(len(table), -1) if len(table) else None
        held = states.sparkSession.sparkContext.broadcast((table.column("keyword").combine_chunks(), p))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            keys, p = held.value
            for batch in batches:
                if len(batch) and p is not None:
                    yield from product(batch, keys, p)

        return states.mapInArrow(run, schema)

    placed = C.checkpointed(known.join(C.dense_index(known, ["keyword"], "_at"), "keyword").withColumn("_block", F.floor(F.col("_at") / BLOCK)))
    lists = placed.groupBy("_block").agg(F.array_sort(F.collect_list(F.struct("_at", "keyword", "p"))).alias("x"))
    blocks = lists.select("_block", F.transform("x", lambda v: v["keyword"]).alias("keys"), F.flatten(F.transform("x", lambda v: v["p"])).alias("flat"))

    def pack(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, len(batch), STATES):
                sink = pa.BufferOutputStream()
                with pa.ipc.new_stream(sink, batch.schema) as out:
                    out.write_batch(batch.slice(at, STATES))
                yield pa.RecordBatch.from_arrays([pa.array([sink.getvalue().to_pybytes()], pa.binary())], ["pack"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for i in range(len(batch)):
                part = pa.ipc.open_stream(batch.column(0)[i].as_buffer()).read_next_batch()
                keys = batch.column(1)[i].values
                yield from product(part, keys, batch.column(2)[i].values.to_numpy(zero_copy_only=False).reshape(len(keys), -1))

    last = placed.agg(F.max("_block")).first()[0]
    each = states.mapInArrow(pack, "pack binary").withColumn("_block", F.explode(F.sequence(F.lit(0).cast("long"), F.lit(last).cast("long"))))
    return C.checkpointed(each.join(blocks.hint("shuffle_hash"), "_block").select("pack", "keys", "flat").mapInArrow(meet, schema), 4)


def cosines(states: DataFrame, prototypes: DataFrame) -> DataFrame:
    """states x available prototypes: the states' columns, keyword and cos."""

    def every(part: pa.RecordBatch, cos: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        n, k = cos.shape
        return np.repeat(np.arange(n), k), [keys.take(pa.array(np.tile(np.arange(k), n))), pa.array(cos.ravel())]

    return _products(states, prototypes, [prototypes.schema["keyword"], StructField("cos", DoubleType())], every)


def nearest(states: DataFrame, prototypes: DataFrame, decimals: int = 9) -> DataFrame:
    """The states' columns but the vector, with pred and cos: the available prototype with the largest cosine, of equal ones (to so many
    decimals) that with the smallest keyword. Each block of prototypes gives one candidate a state; states are told by all their columns."""

    def best(part: pa.RecordBatch, cos: np.ndarray, keys: pa.Array) -> tuple[np.ndarray, list[pa.Array]]:
        cos = cos.round(decimals)
        first = cos.argmax(1)  # keywords are in order
        return np.arange(len(cos)), [keys.take(pa.array(first)), pa.array(cos[np.arange(len(cos)), first])]

    found = _products(states, prototypes, [StructField("pred", prototypes.schema["keyword"].dataType), StructField("cos", DoubleType())], best)
    kept = [c for c in states.columns if c != "vector"]
    least = found.groupBy(*kept).agg(F.min(F.struct((-F.col("cos")).alias("less"), "pred")).alias("x"))
    return least.select(*kept, "x.pred", (-F.col("x.less")).alias("cos"))


def log_mean_exp(found: DataFrame, unit: str) -> DataFrame:
    """tau (logsumexp_t(cos / tau) - ln T) by (unit, keyword). Cosines are bounded, so one aggregate of exponentials does, and long
    units split over tasks."""
    sums = found.groupBy(unit, "keyword").agg(F.sum(F.exp(F.col("cos") / TAU)).alias("s"), F.count("cos").alias("n"))
    return sums.select(unit, "keyword", (TAU * (F.log("s") - F.log("n"))).alias("score"))


def unavailable(units: DataFrame, prototypes: DataFrame) -> DataFrame:
    """units x keywords without an available prototype: no score, available false. Spark broadcasts the side that it knows to be small."""
    rest = prototypes.where("not available").select("keyword")
    return units.crossJoin(rest).select(*units.columns, "keyword", F.lit(None).cast("double").alias("score"), F.lit(False).alias("available"))


def exported(scores: DataFrame, sentinel: float = -1e9) -> DataFrame:
    """Scores with a finite sentinel in place of none, as exports have it."""
    return scores.withColumn("score", F.coalesce("score", F.lit(sentinel)))


def mean_pooled(states: DataFrame, sample: str) -> DataFrame:
    """sample and the plain mean of its vectors: sums by dimension, combined before the shuffle."""
    dims = states.select(sample, F.posexplode("vector").alias("dim", "x")).groupBy(sample, "dim").agg(F.avg("x").alias("x"))
    lists = dims.groupBy(sample).agg(F.array_sort(F.collect_list(F.struct("dim", "x"))).alias("v"))
    return lists.select(sample, F.transform("v", lambda s: s["x"]).alias("vector"))


def balanced_mean(rows: DataFrame, levels: list[str], value: str) -> DataFrame:
    """Mean within the last level, then within the one before, and so on; one row."""
    for i in range(len(levels), 0, -1):
        rows = rows.groupBy(*levels[:i]).agg(F.avg(value).alias(value))
    return rows.agg(F.avg(value).alias(value))


def cross_entropy(found: DataFrame, query: str, target: str) -> DataFrame:
    """query and loss over available prototypes; queries whose target is unavailable are left out.

    found holds a row for each (query, keyword) with cos and the query's target."""
    z = found.withColumn("z", F.col("cos") / TAU)
    lse = C.log_sum_exp(z, [query], "z", within=2 / TAU)
    own = z.where(F.col(target) == F.col("keyword"))
    return own.join(lse, query).withColumn("loss", F.col("lse") - F.col("z"))


def info_nce(queries: DataFrame, keys: DataFrame) -> DataFrame:
    """Loss of each query against the keys of its batch: positives have its context, keys of the same surface in another
    context are left out; a query without a positive or without a negative contributes nothing.

    Both: batch, id, context, surface, vector; queries also carry the columns to average by."""
    k = keys.select("batch", F.col("id").alias("k_id"), F.col("context").alias("k_context"), F.col("surface").alias("k_surface"), F.col("vector").alias("k_vector"))
    pairs = queries.join(k, "batch").where((F.col("context") == F.col("k_context")) | (F.col("surface") != F.col("k_surface")))
    z = pairs.select("id", (F.col("context") == F.col("k_context")).alias("pos"), (C.dot(C.unit(F.col("vector")), C.unit(F.col("k_vector"))) / TAU).alias("z"))
    sums = z.groupBy("id").agg(F.sum(F.exp("z")).alias("den"), F.sum(F.when(F.col("pos"), F.exp("z"))).alias("num"), F.count_if(~F.col("pos")).alias("negatives"))  # cosines are bounded
    kept = sums.where("num is not null and negatives > 0").select("id", (F.log("den") - F.log("num")).alias("loss"))
    return queries.drop("vector").join(kept, "id")


def _times(a: float):
    return lambda x, _: x * a


def scalar_mix(layers: Column, weights: tuple[float, ...]) -> Column:
    """The layers' sum by the softmax of the weights: layers is an array of equally long vectors."""
    w = np.exp(np.array(weights) - max(weights))
    w = w / w.sum()
    scaled = [F.zip_with(F.get(layers, F.lit(k)), F.get(layers, F.lit(k)), _times(float(a))) for k, a in enumerate(w)]
    out = scaled[0]
    for more in scaled[1:]:
        out = F.zip_with(out, more, lambda x, y: x + y)
    return out


def project(df: DataFrame, vector: str, weights: np.ndarray, names: list[str]) -> DataFrame:
    """LayerNorm and linear map by given weights (dimensions x outputs), in Arrow batches."""
    shared = df.sparkSession.sparkContext.broadcast(weights)
    kept = [c for c in df.columns if c != vector]

    def run(batches: Iterator[pd.DataFrame]) -> Iterator[pd.DataFrame]:
        for part in batches:
            x = np.array(part[vector].tolist(), dtype=float).reshape(len(part), -1)
            x = layer_projection(x, shared.value) if len(part) else np.zeros((0, len(names)))
            yield pd.concat([part[kept].reset_index(drop=True), pd.DataFrame(x, columns=names)], axis=1)

    schema = df.select(*kept).schema
    for n in names:
        schema = schema.add(n, "double")
    return df.mapInPandas(run, schema)


def pair_costs(states: DataFrame, words: DataFrame, sample: str) -> DataFrame:
    """sample, t, j, cost = 1 - cosine for every state and word of one sample."""
    w = words.select(sample, F.col("id").alias("j"), F.col("vector").alias("w"))
    pairs = states.select(sample, F.col("id").alias("t"), "vector").join(w, sample)
    cos = F.least(F.lit(1.0), F.greatest(F.lit(-1.0), C.dot(C.unit(F.col("vector")), C.unit(F.col("w")))))
    return pairs.select(sample, "t", "j", (1 - cos).alias("cost"))


def sinkhorn(cost: np.ndarray, epsilon: float, rounds: int) -> np.ndarray:
    """Plan with uniform marginals, in logarithms; columns are scaled last, so their sums are exact."""
    k = -cost / epsilon
    rows, cols = -np.log(cost.shape[0]), -np.log(cost.shape[1])
    lse = lambda x, axis: np.squeeze(m := x.max(axis, keepdims=True), axis) + np.log(np.exp(x - m).sum(axis))
    v = np.zeros(cost.shape[1])
    u = np.zeros(cost.shape[0])
    for _ in range(rounds):
        u = rows - lse(k + v, 1)
        v = cols - lse(k + u[:, None], 0)
    return np.exp(k + u[:, None] + v)


def plans(costs: DataFrame, sample: str, epsilon: float = 0.05, rounds: int = 50, most_cells: int = 4_000_000) -> DataFrame:
    """sample, t, j, mass, cost. Samples are counted: those of up to most_cells cells are solved as one pandas group each, larger
    ones in blocks of cells (``transport``), by the same steps."""
    sizes = costs.groupBy(sample).agg(F.count("*").alias("cells"))
    large = C.checkpointed(sizes.where(F.col("cells") > most_cells).select(sample))

    def solve(part: pd.DataFrame) -> pd.DataFrame:
        part = part.sort_values(["t", "j"])
        n = part["j"].nunique()
        return part.assign(mass=sinkhorn(part["cost"].to_numpy().reshape(-1, n), epsilon, rounds).ravel())[[sample, "t", "j", "mass", "cost"]]

    schema = f"{sample} long, t long, j long, mass double, cost double"
    if large.isEmpty():
        return costs.groupBy(sample).applyInPandas(solve, schema)
    small = costs.join(large, sample, "left_anti").groupBy(sample).applyInPandas(solve, schema)
    blocks = T.cell_blocks(costs.join(large, sample, "left_semi"), sample)
    found = T.plan(blocks, *T.potentials(blocks, sample, epsilon, rounds), sample, epsilon)
    return small.unionByName(found.withColumn(sample, F.col(sample).cast("long")))


def layer_projection(x: np.ndarray, weights: np.ndarray) -> np.ndarray:
    """LayerNorm of the rows, then the linear map."""
    return (x - x.mean(1, keepdims=True)) / np.sqrt(x.var(1, keepdims=True) + 1e-5) @ weights


def align(states: DataFrame, words: DataFrame, sample: str, epsilon: float = 0.05, rounds: int = 50, weights: np.ndarray | None = None) -> DataFrame:
    """sample, j, mean_cost, pooled: projection of the words to the states' width (where weights are given), cost, plan and pooling in
    one pass over each sample, which holds a bounded number of states and words (both sides of a sample meet in one pandas group)."""
    kind = "array<double>"
    shared = states.sparkSession.sparkContext.broadcast(weights)

    def solve(left: pd.DataFrame, right: pd.DataFrame) -> pd.DataFrame:
        if not len(left) or not len(right):
            return pd.DataFrame({sample: [], "j": [], "mean_cost": [], "pooled": []})
        right = right.sort_values("j")
        x, y = np.array(left["vector"].tolist(), float), np.array(right["w"].tolist(), float)
        y = y if shared.value is None else layer_projection(y, shared.value)
        unit = lambda m: m / np.maximum(np.sqrt((m * m).sum(1, keepdims=True)), C.EPS)
        cost = 1 - np.clip(unit(x) @ unit(y).T, -1, 1)
        plan = sinkhorn(cost, epsilon, rounds)
        share = plan / plan.sum(0)
        return pd.DataFrame({sample: right[sample], "j": right["j"], "mean_cost": (share * cost).sum(0), "pooled": list(share.T @ x)})

    own = words.select(F.col(sample).cast("long").alias(sample), F.col("id").alias("j"), F.col("vector").alias("w"))
    return states.select(F.col(sample).cast("long").alias(sample), "vector").groupBy(sample).cogroup(own.groupBy(sample)).applyInPandas(solve, f"{sample} long, j long, mean_cost double, pooled {kind}")


def weighted_total(terms: dict[str, DataFrame], weights: dict[str, float]) -> DataFrame:
    """One row: the sum of the terms (one-row tables with value) by their weights. Terms of weight 0 are not worked out."""
    used = [terms[k].select((F.col("value") * w).alias("value")) for k, w in weights.items() if w]
    if not used:
        raise ValueError("no term has a weight")
    rows = used[0]
    for more in used[1:]:
        rows = rows.unionByName(more)
    missing = F.count("*") != F.count("value")  # a term without a value makes no total
    return rows.agg(F.when(~missing, F.sum("value")).alias("weighted_total"))


def compare_stores(a: DataFrame, b: DataFrame, key: str, names: tuple[str, ...]) -> DataFrame:
    """One row: keys of a that b lacks, keys of b that a lacks, and rows that differ in each attribute, nulls equal to nulls."""
    both = a.select(F.col(key).alias("a_key"), F.struct(*names).alias("x")).join(b.select(F.col(key).alias("b_key"), F.struct(*names).alias("y")), F.col("a_key") == F.col("b_key"), "full_outer")
    here = F.col("a_key").isNotNull() & F.col("b_key").isNotNull()
    changed = [F.count_if(here & ~F.col(f"x.{c}").eqNullSafe(F.col(f"y.{c}"))).alias(f"changed_{c}") for c in names]
    return both.agg(F.count_if(F.col("b_key").isNull()).alias("missing"), F.count_if(F.col("a_key").isNull()).alias("unknown"), *changed)


def plan_report(plan: DataFrame, sample: str) -> DataFrame:
    """Transport cost, entropy, mass and the largest errors of the marginals of each sample."""
    p = F.col("mass")
    total = plan.groupBy(sample).agg(
        F.sum(p * F.col("cost")).alias("transport_cost"), (-F.sum(F.when(p > 0, p * F.log(p)).otherwise(0.0))).alias("entropy"), F.sum(p).alias("mass"),
        F.countDistinct("t").alias("n_t"), F.countDistinct("j").alias("n_j"),
    )
    rows = plan.groupBy(sample, "t").agg(F.sum("mass").alias("m")).join(total, sample).groupBy(sample).agg(F.max(F.abs(F.col("m") - 1 / F.col("n_t"))).alias("row_error"))
    cols = plan.groupBy(sample, "j").agg(F.sum("mass").alias("m")).join(total, sample).groupBy(sample).agg(F.max(F.abs(F.col("m") - 1 / F.col("n_j"))).alias("column_error"))
    return total.join(rows, sample).join(cols, sample)


def pool(plan: DataFrame, states: DataFrame, sample: str) -> DataFrame:
    """sample, j, dim, value: states averaged for each word by the plan's mass."""
    dims = states.select(sample, F.col("id").alias("t"), F.posexplode("vector").alias("dim", "x"))
    weighed = plan.select(sample, "t", "j", "mass").join(dims, [sample, "t"])
    return weighed.groupBy(sample, "j", "dim").agg((F.sum(F.col("mass") * F.col("x")) / F.sum("mass")).alias("value"))


def largest_difference(a: Column, b: Column) -> Column:
    return F.array_max(F.transform(F.zip_with(a, b, lambda x, y: x.cast("double") - y.cast("double")), lambda x: F.abs(x)))


def padded(df: DataFrame, array: str, size: int, order: str, pad: int = -1) -> DataFrame:
    """df with batch, place, length, width (longest of the batch) and the array padded to it; batches by order."""
    numbered = df.join(C.dense_index(df.select(order), [order], "place"), order).withColumn("batch", F.floor(F.col("place") / size).cast("long"))
    n = F.size(array).cast("long")
    out = numbered.withColumn("length", n).withColumn("width", F.max(n).over(Window.partitionBy("batch")))
    return out.withColumn(array, F.concat(F.col(array), F.array_repeat(F.lit(pad), (F.col("width") - F.col("length")).cast("int"))))


def padded_together(df: DataFrame, arrays: list[str], size: int, order: str, pad: int = -1) -> DataFrame:
    """The same for several arrays of their own lengths: batch, place, and for each array its length, its width in the batch, the padded
    array and its mask (true where a value is real). A null array counts as empty."""
    placed = df.join(C.dense_index(df.select(order), [order], "place"), order).withColumn("batch", F.floor(F.col("place") / size).cast("long"))
    widest = placed.groupBy("batch").agg(*[F.max(F.coalesce(F.size(a), F.lit(0))).cast("long").alias(f"{a}_width") for a in arrays])
    out = placed.join(widest, "batch")
    for a in arrays:
        held, width = F.coalesce(F.col(a), F.array().cast(df.schema[a].dataType)), F.col(f"{a}_width")
        n = F.size(held).cast("long")
        out = out.withColumns({
            f"{a}_length": n, f"{a}_mask": F.concat(F.transform(held, lambda _: F.lit(True)), F.array_repeat(F.lit(False), (width - n).cast("int"))),
            a: F.concat(held, F.array_repeat(F.lit(pad), (width - n).cast("int")).cast(df.schema[a].dataType)),
        })
    return out
