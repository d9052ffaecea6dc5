"""The signal source: pushed filters, bytes read, other readers."""

import json

import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.sources import signal


class Logging(signal.FloatReader):
    """Notes the bytes that it reads beside the recording."""

    def __init__(self, header):
        super().__init__(header)
        self.log = header.removeprefix("file:") + ".log"
        open(self.log, "a").write("open\n")

    def read(self, start, stop):
        open(self.log, "a").write(f"{(stop - start) * 4 * self.channels}\n")
        return super().read(start, stop)


class Reversed(signal.FloatReader):
    def read(self, start, stop):
        return super().read(start, stop)[::-1]


@pytest.fixture
def store(spark, tmp_path):
    signal.register(spark)
    value = lambda r, t, c: float(100 * r + 10 * c + t)
    rows = [(f"r{r}", 250.0, [[value(r, t, c) for c in range(2)] for t in range(9)]) for r in range(4)]
    signal.write_recordings(spark.createDataFrame(rows, "name string, rate double, signal array<array<double>>"), f"file://{tmp_path}/rec")
    windows = [(f"v{r}{k}", f"file:{tmp_path}/rec/r{r}.hdr", k, k + 3) for r in range(4) for k in range(6)]
    spark.createDataFrame(windows, "view_id string, header string, start long, stop long").repartition(3).write.parquet(str(tmp_path / "windows"))
    yield tmp_path, value
    spark.conf.unset("spark.sql.python.filterPushdown.enabled")


def load(spark, folder, kind=None):
    r = spark.read.format("signal_windows").option("windows", f"file://{folder}/windows")
    return (r.option("reader", f"tests.test_signal:{kind}") if kind else r).load()


def test_all_windows(spark, store):
    folder, value = store
    got = {r.view_id: r for r in load(spark, folder).collect()}
    assert len(got) == 24
    for r in range(4):
        for k in range(6):
            x = got[f"v{r}{k}"]
            assert (x.n_channels, x.n_samples, x.sfreq) == (2, 3, 250.0)
            assert np.array_equal(x.signal, [[value(r, k + t, c) for t in range(3)] for c in range(2)])


def test_a_filtered_read_touches_the_named_recordings_and_bytes_only(spark, store):
    folder, _ = store
    rows = load(spark, folder, "Logging").where(F.col("header").endswith("r1.hdr") | True).where(F.col("view_id").isin("v12", "v14")).collect()
    assert sorted(r.view_id for r in rows) == ["v12", "v14"]
    logs = {p.name: p.read_text().split() for p in (folder / "rec").glob("*.log")}
    assert set(logs) == {"r1.hdr.log"} and sorted(x for x in logs["r1.hdr.log"] if x != "open") == ["24", "24"]
    assert load(spark, folder, "Logging").where(f"header = 'file:{folder}/rec/r2.hdr' and view_id = 'v30'").count() == 0
    assert not (folder / "rec" / "r2.hdr.log").exists() and not (folder / "rec" / "r3.hdr.log").exists()


def test_filters_that_are_not_pushed_stay_with_spark(spark, store):
    folder, _ = store
    assert load(spark, folder).where("view_id like 'v0%' and n_samples = 3").count() == 6
    assert load(spark, folder).where("view_id = 'v01' and view_id <> 'v01'").count() == 0


def test_another_reader_and_a_listed_table(spark, store):
    folder, value = store
    x = load(spark, folder, "Reversed").where("view_id = 'v20'").first()
    assert x.signal[0] == [value(2, t, 0) for t in (2, 1, 0)]
    listed = json.dumps([{"view_id": "a", "header": f"{folder}/rec/r0.hdr", "start": 8, "stop": 9}])
    assert spark.read.format("signal_windows").option("windows", listed).load().first().signal == [[8.0], [18.0]]
    beyond = json.dumps([{"view_id": "a", "header": f"{folder}/rec/r0.hdr", "start": 8, "stop": 10}])
    with pytest.raises(Exception, match="window"):
        spark.read.format("signal_windows").option("windows", beyond).load().collect()
