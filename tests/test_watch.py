"""Checks that ride on a job's own pass, and what prototypes are made of."""

import pytest
from pyspark.sql import functions as F

from lectern.functions import common as C
from lectern.operators import quality as Q
from lectern.operators import vectors as V


def test_watch_counts_while_a_job_writes(spark):
    df = spark.createDataFrame([(1, 2.0), (2, None), (3, -1.0), (4, 5.0)], "id int, x double")
    watch = Q.Watch(negative=F.col("x") < 0, odd=F.col("id") % 2 == 1)
    out = C.checkpointed(watch.on(df).where("id > 1").groupBy().agg(F.count("*").alias("n")))
    assert out.first().n == 3 and watch.counts() == {"rows": 4, "negative": 2, "odd": 2}  # an unknown value breaks the check
    with pytest.raises(ValueError, match="negative: 2, odd: 2"):
        watch.require()
    sound = Q.Watch(negative=F.col("id") < 0)
    C.checkpointed(sound.on(df))
    sound.require()
    none = Q.Watch(negative=F.col("id") < 0)
    C.checkpointed(none.on(df.limit(0)))
    assert none.counts() == {"rows": 0, "negative": 0}


def test_in_one_pass(spark):
    df = spark.createDataFrame([(1,), (2,), (None,)], "x int")
    got = {r.check_name: r.violations for r in Q.in_one_pass(df, {"null": F.count_if(F.col("x").isNull()), "big": F.sum(F.when(F.col("x") > 5, 1))}).collect()}
    assert got == {"null": 1, "big": 0}


def test_contributors_are_told_by_bitmaps(spark):
    ids = [0, 1, 32766, 32767, 32768, 70000]
    members = spark.createDataFrame([("k", i, "train" if i % 2 == 0 else "test") for i in ids] + [("other", 5, "test"), ("idle", 9, "train")], "keyword string, id long, role string")
    rows = spark.createDataFrame([("k", i, 1, "g", [1.0]) for i in (0, 32766, 32767, 5, 0)] + [("other", 5, 2, "g", [1.0])], "keyword string, id long, sentence int, grp string, vector array<double>")
    prototypes, made = V.traced_prototypes(rows, 1, "id")
    assert prototypes.count() == 2
    got = {r.keyword: tuple(r)[1:] for r in V.contributor_report(made, members, "id").collect()}
    # contributors, from training, leaked, unknown, missing
    assert got == {"k": (4, 2, 1, 1, 2), "other": (1, 0, 1, 0, 0), "idle": (0, 0, 0, 0, 1)}
