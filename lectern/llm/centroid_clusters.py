"""Centroid clustering of vectors in whole numbers, by subvector dictionaries.

A vector's components are floor(64 * x). Its dimensions are cut into blocks of WIDTH; each block's distinct subvectors make a
dictionary, and a vector becomes one code for each block, from which it can be read back (nothing is rounded). In a
round, the squared distances of all distinct subvectors to the centroids are worked out once; a vector's distance is the sum
of those of its codes. New centroids need only the number of times that each code stands in each cluster.

The dictionary is counted. Up to DICTIONARY_ROWS subvectors, it and their distances go to every task as arrays. Beyond that the
codes are the subvectors themselves, packed into one number, and distances are joined to them by shuffle; Spark splits
the hot ones, as the other side has one row for each. Centroids are K rows, all that the driver sees besides.

Defined results: only vectors with exactly DIMS components, none null, infinite or not a number, are kept; so a null or empty
vector gives no row. Ties go to the smaller centroid. Repeated rows are vectors by themselves; vectors with the same id may all be
first centroids, in the order of their components, and null ids come last. With fewer than K vectors there are
fewer centroids; an empty table gives an empty result. Extra columns are ignored. A component beyond LIMIT (after scaling)
raises an error, as its distances need not fit a long. Every result is exact.
"""

from __future__ import annotations

import hashlib
from collections.abc import Callable, Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from . import shared as S

DIMS, SCALE, K, ROUNDS = 64, 64.0, 16, 3
WIDTH = 2  #: dimensions of a block
BLOCKS = DIMS // WIDTH
LIMIT = 1 << 26  #: components lie in [-LIMIT, LIMIT), so that two of them are packed into one long
DICTIONARY_ROWS = 1 << 17  #: subvectors that may be broadcast, with K distances each (16 MB)

_PACKED = "row long, vec_id long, subs array<long>"
_CODED = "row long, vec_id long, codes array<int>"
_ASSIGNED = "row long, vec_id long, cluster int, distance long"


def pack(x: np.ndarray) -> np.ndarray:
    """(n, DIMS) whole numbers to (n, BLOCKS) packed subvectors."""
    x = x.reshape(len(x), BLOCKS, WIDTH) + LIMIT
    return x[:, :, 0] * (2 * LIMIT) + x[:, :, 1]


def unpack(subs: np.ndarray) -> np.ndarray:
    """Packed subvectors to their WIDTH components, in a last axis."""
    return np.stack([subs // (2 * LIMIT), subs % (2 * LIMIT)], -1) - LIMIT


def _matrix(lists: pa.Array, kind: type) -> np.ndarray:
    return lists.flatten().to_numpy(zero_copy_only=False).astype(kind).reshape(len(lists), -1)


def _rows(x: np.ndarray) -> pa.Array:
    return pa.ListArray.from_arrays(pa.array(np.arange(0, x.size + 1, x.shape[1]), pa.int32()), pa.array(x.ravel()))


def _pack_batches(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
    for batch in batches:
        if len(batch):
            x = np.floor(_matrix(batch.column(2), np.float64) * SCALE)
            if (np.abs(x) >= LIMIT).any():
                raise ValueError(f"a component is beyond {LIMIT} after scaling")
            yield pa.RecordBatch.from_arrays([*batch.columns[:2], _rows(pack(x.astype(np.int64)))], ["row", "vec_id", "subs"])


def packed_vectors(vectors: DataFrame) -> DataFrame:
    """row, vec_id, subs of the vectors that are kept; vectors: vec_id, embedding. A written table, so that rows keep their numbers."""
    v = F.col("embedding").cast("array<double>")
    sound = F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x) & (F.abs(x) < float("inf")))
    kept = vectors.select(F.col("vec_id").cast("long").alias("vec_id"), v.alias("embedding")).where((F.size("embedding") == DIMS) & sound)
    rows = kept.select(F.monotonically_increasing_id().alias("row"), "vec_id", "embedding")
    return S.staged(rows.mapInArrow(_pack_batches, _PACKED), "packed")


def dictionary(packed: DataFrame) -> DataFrame:
    """block, sub: the distinct subvectors of each block; a written table. Tasks make them distinct before the shuffle."""
    return S.staged(packed.select(F.posexplode("subs").alias("block", "sub")).distinct(), "dictionary")


def first_centroids(packed: DataFrame, k: int) -> np.ndarray:
    """The k vectors whose ids have the smallest hashes, in that order."""
    first = packed.select(F.sha2(F.concat(F.lit("1:"), F.col("vec_id").cast("string")), 256).alias("hash"), "subs").orderBy(F.asc_nulls_last("hash"), "subs").limit(k)
    rows = [r.subs for r in first.collect()]
    return unpack(np.array(rows, np.int64).reshape(-1, BLOCKS)).reshape(-1, DIMS)


def partial_distances(subs: np.ndarray, block: np.ndarray, centroids: np.ndarray) -> np.ndarray:
    """(n, k) squared distances of packed subvectors to the centroids' parts in their blocks."""
    parts = centroids.reshape(-1, BLOCKS, WIDTH)[:, block]
    off = unpack(subs)[None] - parts
    return (off * off).sum(2).T.copy()


class Coded:
    """Vectors as codes of a dictionary that every task holds: places among the sorted subvectors of all blocks."""

    def __init__(self, packed: DataFrame, words: DataFrame):
        rows = words.orderBy("block", "sub").toArrow()  # counted: DICTIONARY_ROWS at most
        self.block, self.subs = rows.column("block").to_numpy(), rows.column("sub").to_numpy()
        self.starts = np.searchsorted(self.block, np.arange(BLOCKS + 1))
        self.context = packed.sparkSession.sparkContext
        held = self.context.broadcast((self.subs, self.starts))

        def encode(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            subs, starts = held.value
            for batch in batches:
                x = _matrix(batch.column(2), np.int64)
                codes = np.empty(x.shape, np.int32)
                for b in range(x.shape[1] if len(x) else 0):
                    codes[:, b] = starts[b] + np.searchsorted(subs[starts[b] : starts[b + 1]], x[:, b])
                if len(x):
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], _rows(codes)], ["row", "vec_id", "codes"])

        self.rows = S.staged(packed.mapInArrow(encode, _CODED), "codes")

    def _nearest(self, centroids: np.ndarray) -> Callable[[pa.RecordBatch], tuple[np.ndarray, np.ndarray, np.ndarray]]:
        held = self.context.broadcast(partial_distances(self.subs, self.block, centroids))  # once a round

        def nearest(batch: pa.RecordBatch) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
            codes, total = _matrix(batch.column(2), np.int64), 0
            for b in range(BLOCKS):
                total = total + held.value[codes[:, b]]
            cluster = total.argmin(1)  # the first of equal ones
            return codes, cluster, total[np.arange(len(total)), cluster]

        return nearest

    def assign(self, centroids: np.ndarray) -> DataFrame:
        nearest = self._nearest(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    _, cluster, distance = nearest(batch)
                    yield pa.RecordBatch.from_arrays([*batch.columns[:2], pa.array(cluster.astype(np.int32)), pa.array(distance)], ["row", "vec_id", "cluster", "distance"])

        return self.rows.mapInArrow(run, _ASSIGNED)

    def sums(self, centroids: np.ndarray) -> DataFrame:
        """cluster, dim, n, total: each task counts the codes of each cluster, and sends K rows of sums for a batch."""
        nearest, k = self._nearest(centroids), len(centroids)
        words = self.context.broadcast((self.subs, self.starts))

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            subs, starts = words.value
            total, n = np.zeros((k, DIMS), np.int64), np.zeros(k, np.int64)
            for batch in batches:
                if len(batch):
                    codes, cluster, _ = nearest(batch)
                    n += np.bincount(cluster, minlength=k)
                    for b in range(BLOCKS):
                        lo, size = starts[b], starts[b + 1] - starts[b]
                        times = np.bincount(cluster * size + codes[:, b] - lo, minlength=k * size).reshape(k, size)
                        total[:, b * WIDTH : (b + 1) * WIDTH] += times @ unpack(subs[lo : lo + size])
            yield pa.RecordBatch.from_arrays([pa.array(np.repeat(np.arange(k), DIMS)), pa.array(np.tile(np.arange(DIMS), k)), pa.array(np.repeat(n, DIMS)), pa.array(total.ravel())], ["cluster", "dim", "n", "total"])

        return self.rows.mapInArrow(run, "cluster long, dim long, n long, total long").groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum("total").alias("total"))


class Joined:
    """The same for a dictionary of any size: a vector's codes are its packed subvectors, and meet their distances in a join."""

    def __init__(self, packed: DataFrame, words: DataFrame):
        self.packed, self.words = packed, words
        self.entries = packed.select("row", F.posexplode("subs").alias("block", "sub"))

    def assign(self, centroids: np.ndarray) -> DataFrame:
        k = len(centroids)

        def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            for batch in batches:
                if len(batch):
                    d = partial_distances(batch.column(1).to_numpy(), batch.column(0).to_numpy(), centroids)
                    yield pa.RecordBatch.from_arrays([*batch.columns, *(pa.array(d[:, i].copy()) for i in range(k))], ["block", "sub", *(f"d{i}" for i in range(k))])

        partial = S.staged(self.words.mapInArrow(run, "block int, sub long, " + ", ".join(f"d{i} long" for i in range(k))), "partial")  # once a round
        near = self.entries.join(partial.hint("merge"), ["block", "sub"]).groupBy("row").agg(*[F.sum(f"d{i}").alias(f"d{i}") for i in range(k)])
        best = F.array_min(F.array(*[F.struct(F.col(f"d{i}").alias("distance"), F.lit(i).alias("cluster")) for i in range(k)]))
        found = near.select("row", best.alias("x")).join(self.packed.select("row", "vec_id"), "row")
        return S.staged(found.select("row", "vec_id", "x.cluster", "x.distance"), "assigned")

    def sums(self, centroids: np.ndarray) -> DataFrame:
        of_row = self.assign(centroids).select("row", "cluster")
        times = self.entries.join(of_row, "row").groupBy("cluster", "block", "sub").agg(F.count("*").alias("n"))
        part = lambda i: (F.floor(F.col("sub") / (2 * LIMIT)) if i == 0 else F.col("sub") % (2 * LIMIT)) - LIMIT
        each = times.select("cluster", "n", F.inline(F.array(*[F.struct((F.col("block") * WIDTH + i).alias("dim"), part(i).alias("x")) for i in range(WIDTH)])))
        return each.groupBy("cluster", "dim").agg(F.sum("n").alias("n"), F.sum(F.col("n") * F.col("x")).alias("total"))


def clusters(vectors: DataFrame, k: int = K, rounds: int = ROUNDS, dictionary_rows: int = DICTIONARY_ROWS) -> tuple[DataFrame, np.ndarray]:
    """(row, vec_id, cluster, distance of each kept vector: a written table; the final centroids, at most k rows)."""
    packed = packed_vectors(vectors)
    centroids = first_centroids(packed, k)
    if not len(centroids):
        return packed.sparkSession.createDataFrame([], _ASSIGNED), centroids
    words = dictionary(packed)
    coded = Coded(packed, words) if words.count() <= dictionary_rows else Joined(packed, words)
    for _ in range(rounds):
        centroids = centroids.copy()
        for r in coded.sums(centroids).where("n > 0").collect():  # k * DIMS rows
            centroids[r.cluster, r.dim] = int(r.total) // int(r.n)
    return S.staged(coded.assign(centroids), "clusters"), centroids


def op12_centroid_clusters(spark, sf_dir: str) -> DataFrame:
    found, centroids = clusters(S.table(spark, sf_dir, "embeddings"))
    hashes = [(i, hashlib.sha256(",".join(map(str, c)).encode()).hexdigest()) for i, c in enumerate(centroids.tolist())]
    sums = found.groupBy("cluster").agg(F.sum("distance").alias("cluster_inertia"))
    whole = sums.agg(F.sum("cluster_inertia").alias("inertia"))
    facts = sums.crossJoin(whole).join(spark.createDataFrame(hashes, "cluster int, centroid_sha256 string"), "cluster")  # K rows at most
    return found.join(F.broadcast(facts), "cluster").select("vec_id", "cluster", "distance", "cluster_inertia", "inertia", "centroid_sha256")


def _sql() -> str:
    def nearest(i: int) -> str:
        return f"""d{i} AS (SELECT v.id, v.x, c.c, CAST(list_sum(list_transform(list_zip(v.x, c.x), lambda p: (p[1] - p[2]) * (p[1] - p[2]))) AS BIGINT) AS d FROM v CROSS JOIN c{i} c
), a{i} AS (SELECT id, any_value(x) AS x, arg_min(c, (d, c)) AS c, min(d) AS d FROM d{i} GROUP BY id)"""

    def moved(i: int) -> str:
        return f"""e{i} AS (SELECT c, k, CAST(sum(y) AS BIGINT) AS s, count(*) AS n FROM (SELECT c, generate_subscripts(x, 1) AS k, unnest(x) AS y FROM a{i}) GROUP BY c, k
), m{i} AS (SELECT c, list(CAST((s - ((s % n) + n) % n) // n AS BIGINT) ORDER BY k) AS x FROM e{i} GROUP BY c
), c{i + 1} AS (SELECT c.c, coalesce(m.x, c.x) AS x FROM c{i} c LEFT JOIN m{i} m USING (c))"""

    parts = [
        "good AS (SELECT vec_id, embedding FROM embeddings WHERE len(embedding) = 64 AND len(list_filter(embedding, lambda y: y IS NULL OR NOT isfinite(y))) = 0)",
        "v AS (SELECT vec_id AS id, list_transform(embedding, lambda y: CAST(floor(64 * CAST(y AS DOUBLE)) AS BIGINT)) AS x FROM good)",
        "c0 AS (SELECT CAST(row_number() OVER (ORDER BY sha256('1:' || id)) - 1 AS INTEGER) AS c, x FROM v QUALIFY c < 16)",
    ]
    for i in range(ROUNDS):
        parts += [nearest(i), moved(i)]
    parts.append(nearest(ROUNDS))
    return f"""WITH {', '.join(parts)}
SELECT a.id AS vec_id, a.c AS cluster, a.d AS distance, CAST(sum(a.d) OVER (PARTITION BY a.c) AS BIGINT) AS cluster_inertia, CAST(sum(a.d) OVER () AS BIGINT) AS inertia,
  sha256(array_to_string(c.x, ',')) AS centroid_sha256 FROM a{ROUNDS} a JOIN c{ROUNDS} c ON a.c = c.c"""


SQL = _sql()
