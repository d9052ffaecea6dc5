import json
import struct

import pytest
from pyspark.sql import functions as F

from lectern.operators import monitor as M
from lectern.operators import quality as Q
from lectern.operators import splits as P
from lectern.sources import signal, tables
from lectern.streaming import logs


def test_monitor_keeps_the_earlier_epoch_of_equals(spark):
    log = spark.createDataFrame([(1, 0, 1.0), (1, 1, 2.0), (1, 2, 2.0), (1, 3, 1.0), (1, 4, 9.0)], "run long, epoch long, value double")
    r = M.monitor(log, 0.0, 2).first()
    assert (r.best, r.best_epoch, r.bad, r.stopped_at) == (2.0, 1, 2, 3)


def test_monitor_stream(spark, tmp_path):
    for k, line in enumerate(([1, 0, 1.0], [1, 1, 3.0], [1, 2, 2.0])):
        (tmp_path / f"{k}.json").write_text(json.dumps(dict(zip(("run", "epoch", "value"), line))))
    q = logs.best_so_far(spark, str(tmp_path), 0.0, 5).writeStream.outputMode("update").format("memory").queryName("best").trigger(availableNow=True).start()
    q.awaitTermination()
    r = spark.table("best").orderBy(F.desc("last_epoch")).first()
    assert (r.best, r.best_epoch, r.bad) == (3.0, 1, 1)


def test_signal_windows(spark, tmp_path):
    (tmp_path / "a.dat").write_bytes(struct.pack("<6f", 1, 10, 2, 20, 3, 30))
    (tmp_path / "a.hdr").write_text("DataFile=a.dat\nBinaryFormat=IEEE_FLOAT_32\nDataOrientation=MULTIPLEXED\nNumberOfChannels=2\nSamplingInterval=4000\n")
    spark.dataSource.register(signal.SignalWindows)
    ask = lambda stop: spark.read.format("signal_windows").option("windows", json.dumps([{"view_id": "v", "header": str(tmp_path / "a.hdr"), "start": 1, "stop": stop}])).load()
    r = ask(3).first()
    assert (r.sfreq, r.signal) == (250.0, [[2.0, 3.0], [20.0, 30.0]])
    with pytest.raises(Exception, match="window"):
        ask(4).collect()


def test_csv_with_mark_and_flags(spark, tmp_path):
    (tmp_path / "lex.csv").write_bytes("﻿rank,keyword_id,surface_form,canonical_concept,semantic_categories,story_local_flag,include_core,include_main,include_extended\n1,k1,ab,c,x,TRUE , true,false,false\n".encode())
    r = tables.read_lexicon(spark, str(tmp_path / "lex.csv")).first()
    assert (r.rank, r.keyword_idx, r.story_local_flag, r.include_core, r.include_main) == (1, 0, True, True, False)


def test_prototype_guard(spark, tmp_path):
    df = spark.createDataFrame([("k", [1.0])], "keyword string, vector array<double>")
    tables.write_prototypes(df, str(tmp_path / "p"), {"fold": "0"})
    assert tables.read_prototypes(spark, str(tmp_path / "p"), {"fold": "0"}).count() == 1
    with pytest.raises(ValueError, match="stale"):
        tables.read_prototypes(spark, str(tmp_path / "p"), {"fold": "1"})


def test_fold_files_and_hash(spark, tmp_path):
    f = spark.createDataFrame([(0, "a"), (1, "b")], "outer_fold int, role string")
    tables.write_folds(f, str(tmp_path / "f"))
    assert [r.role for r in tables.read_fold(spark, str(tmp_path / "f"), 1).collect()] == ["b"]
    (tmp_path / "x.bin").write_bytes(b"abc")
    assert tables.file_sha256(spark, str(tmp_path / "x.bin")).first().sha256.startswith("ba7816bf")


def test_quality(spark):
    df = spark.createDataFrame([(1, 0), (1, 1), (2, 1)], "g int, p int")
    assert [r.g for r in Q.not_contiguous(df, "g", "p").collect()] == [2]
    with pytest.raises(ValueError, match="keys: 1"):
        Q.require({"keys": Q.repeated_keys(df, "g")})
    one, two = Q.fingerprint(df, "t"), Q.fingerprint(df.repartition(3), "t")
    assert Q.stale(one, two).count() == 0
    assert Q.stale(one, Q.fingerprint(df.where("g = 1"), "t")).count() == 1


def test_only_training_rows_get_targets(spark):
    s = spark.createDataFrame([(1, "train"), (2, "test")], "id int, role string")
    v = spark.createDataFrame([(1, 5), (2, 6)], "id int, x int")
    assert {r.id: r.x for r in Q.guard_targets(s, v, "id").collect()} == {1: 5, 2: None}


def test_deal_is_even_and_atomic(spark):
    labels = spark.createDataFrame([(f"g{i:03d}", f"l{i % 3}") for i in range(60)], "group_id string, label string")
    groups = labels.select("group_id").withColumn("size", F.lit(1).cast("long"))
    dealt = P.deal(groups, labels, 5, 8)
    assert {r["count"] for r in dealt.groupBy("fold").count().collect()} == {12}
