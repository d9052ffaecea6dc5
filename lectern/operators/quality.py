"""Expectations: each returns the rows that break it, so a job can fail on any, or count them all in one report."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame, Observation
from pyspark.sql import functions as F


def rows_where(df: DataFrame, bad: Column) -> DataFrame:
    return df.where(F.coalesce(bad, F.lit(True)))


def repeated_keys(df: DataFrame, *keys: str) -> DataFrame:
    return df.groupBy(*keys).agg(F.count("*").alias("n")).where("n > 1")


def missing_from(df: DataFrame, other: DataFrame, *keys: str) -> DataFrame:
    """Keys of df that other lacks."""
    return df.select(*keys).distinct().join(other.select(*keys).distinct(), list(keys), "left_anti")


def not_contiguous(df: DataFrame, group: str, position: str) -> DataFrame:
    """Groups whose positions are not 0..n-1: counts and ends tell, without a window."""
    n = df.groupBy(group).agg(F.count("*").alias("n"), F.countDistinct(position).alias("d"), F.min(position).alias("lo"), F.max(position).alias("hi"))
    return n.where((F.col("lo") != 0) | (F.col("hi") != F.col("n") - 1) | (F.col("d") != F.col("n")))


def outside_range(df: DataFrame, value: str, low: int, high: int) -> DataFrame:
    return df.where(~F.col(value).between(low, high))


def conflicting(df: DataFrame, keys: list[str], value: str) -> DataFrame:
    """Keys under which value is not the same everywhere."""
    return df.groupBy(*keys).agg(F.min(value).alias("lo"), F.max(value).alias("hi")).where("lo <> hi")


def empty(df: DataFrame) -> DataFrame:
    """One row if df has none."""
    return df.limit(1).groupBy().agg(F.count("*").alias("n")).where("n = 0")


def report(checks: dict[str, DataFrame]) -> DataFrame:
    """check_name, violations."""
    counted = [df.groupBy().agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations") for name, df in checks.items()]
    return reduce(DataFrame.unionByName, counted)


def require(checks: dict[str, DataFrame]) -> None:
    """Raises if a check has violations."""
    bad = [(r.check_name, r.violations) for r in report(checks).where("violations > 0").collect()]
    if bad:
        raise ValueError(", ".join(f"{name}: {n}" for name, n in bad))


class Watch:
    """Counts of rows that break row-wise checks, collected while a job's own pass over the rows runs: no scan is added.

        watch = Watch(length=F.length("text") != F.col("n_chars"))
        written = watch.on(documents).transform(job).write.parquet(path)
        watch.require()  # the job fails here if a row broke a check

    A check that is null for a row is broken by it. counts() waits for the job's end; it has "rows" besides."""

    def __init__(self, **checks: Column):
        self.names, self._seen = list(checks), Observation()
        self._counts = [F.count(F.lit(1)).alias("rows"), *[F.count_if(F.coalesce(bad, F.lit(True))).alias(name) for name, bad in checks.items()]]

    def on(self, df: DataFrame) -> DataFrame:
        return df.observe(self._seen, *self._counts)

    def counts(self) -> dict[str, int]:
        return {k: v or 0 for k, v in self._seen.get.items()}

    def require(self) -> None:
        found = self.counts()
        bad = [f"{name}: {found[name]}" for name in self.names if found[name]]
        if bad:
            raise ValueError(", ".join(bad))


def in_one_pass(df: DataFrame, checks: dict[str, Column]) -> DataFrame:
    """check_name, violations: each check is an aggregate (a count of violations); all of them are worked out in one scan of df."""
    one = df.agg(*[F.coalesce(c, F.lit(0)).cast("long").alias(name) for name, c in checks.items()])
    rows = F.array(*[F.struct(F.lit(name).alias("check_name"), F.col(f"`{name}`").alias("violations")) for name in checks])
    return one.select(F.inline(rows))


def fingerprint(df: DataFrame, name: str) -> DataFrame:
    """One row that does not depend on the rows' order: count, XOR and sum of row hashes, and the schema's hash."""
    h = F.xxhash64(F.to_json(F.struct(*df.columns)))
    schema = F.sha2(F.lit(df.schema.simpleString()), 256)
    return df.groupBy().agg(F.count("*").alias("n"), F.bit_xor(h).alias("xor_hash"), F.sum(h.cast("decimal(38,0)")).alias("sum_hash")).select(F.lit(name).alias("name"), "n", "xor_hash", F.col("sum_hash").cast("string").alias("sum_hash"), schema.alias("schema_hash"))


def stale(expected: DataFrame, found: DataFrame) -> DataFrame:
    """Names whose fingerprints are gone or differ."""
    f = found.select("name", *[F.col(c).alias(f"_{c}") for c in ("n", "xor_hash", "sum_hash", "schema_hash")])
    same = [F.col(c).eqNullSafe(F.col(f"_{c}")) for c in ("n", "xor_hash", "sum_hash", "schema_hash")]
    return expected.join(f, "name", "left").where(~reduce(lambda a, b: a & b, same))


def guard_targets(samples: DataFrame, vectors: DataFrame, key: str, role: str = "train") -> DataFrame:
    """Vectors joined to the rows of one role only; the others keep null, as the join is not made for them."""
    mine = samples.where(F.col("role") == role).select(key).distinct()
    allowed = vectors.join(mine, key, "left_semi")
    return samples.join(allowed, key, "left")


