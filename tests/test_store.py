"""Tables that commit: nothing is left of failures, nothing is overwritten, what is read is what was written."""

import pytest
from pyspark.sql import functions as F

from lectern.sources import store


def rows(spark, n=100):
    return spark.range(n).select((F.col("id") * 7 % n).alias("sentence"), (F.col("id") % 3).alias("position"), F.array(F.col("id").cast("double")).alias("vector"))


def test_provenance_order_and_lookup(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    said = store.write(rows(spark), path, {"model": "a", "layers": "2"}, ["sentence", "position"], ranges=4)
    assert said["rows"] == 100 and said["provenance"] == {"model": "a", "layers": "2"} and len(said["files"]) > 1
    back = store.read(spark, path, {"model": "a"})
    assert sorted(map(str, back.collect())) == sorted(map(str, rows(spark).collect()))
    ends = [(f["first"], f["last"]) for f in said["files"]]
    assert all(a <= b for a, b in ends) and all(x[1] <= y[0] for x, y in zip(ends, ends[1:]))  # one order over all files
    one = store.read(spark, path, at=42)
    assert [r.sentence for r in one.collect()] == [42] and len(one.inputFiles()) == 1
    with pytest.raises(ValueError, match="model: 'a' in place of 'b'"):
        store.read(spark, path, {"model": "b"})
    with pytest.raises(ValueError, match="layers must not be recorded"):
        store.read(spark, path, forbidden=("layer",))
    assert store.changed_files(spark, path).count() == 0
    name = said["files"][0]["name"]
    (tmp_path / "t" / name).write_bytes((tmp_path / "t" / said["files"][1]["name"]).read_bytes())
    assert [r.name for r in store.changed_files(spark, path).collect()] == [name]


def test_a_failed_task_leaves_nothing(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    bad = rows(spark).withColumn("vector", F.when(F.col("sentence") == 99, F.raise_error(F.lit("broken")).cast("array<double>")).otherwise(F.col("vector")))
    with pytest.raises(Exception, match="broken"):
        store.write(bad, path, {})
    assert not list(tmp_path.rglob("*.parquet")) and not list(tmp_path.rglob("_manifest*"))
    with pytest.raises(ValueError, match="no committed table"):
        store.read(spark, path)
    store.write(rows(spark, 10), path, {"v": "1"})
    with pytest.raises(Exception, match="broken"):
        store.write(bad, path, {"v": "2"}, overwrite=True)
    assert store.read(spark, path, {"v": "1"}).count() == 10  # the former table stands


def test_overwriting_is_refused_unless_asked_for(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.write(rows(spark, 10), path, {})
    with pytest.raises(Exception, match="exists already"):
        store.write(rows(spark, 20), path, {})
    assert store.read(spark, path).count() == 10
    store.write(rows(spark, 20), path, {}, overwrite=True)
    assert store.read(spark, path).count() == 20
    assert len(list(tmp_path.rglob("*.parquet"))) == len(store.metadata(path)["files"])  # the former files are gone


def test_empty_table(spark, tmp_path):
    path = f"file://{tmp_path}/t"
    store.write(rows(spark, 10).limit(0), path, {"v": "1"}, ["sentence"])
    back = store.read(spark, path, {"v": "1"})
    assert back.count() == 0 and back.columns == ["sentence", "position", "vector"]


def test_vectors_of_a_sentence_by_provenance(spark, tmp_path):
    from lectern.sources import tables

    path = str(tmp_path / "w")
    tables.write_vectors(rows(spark), path, provenance={"model": "a"})
    assert tables.sentence_vectors(spark, path, 7, {"model": "a"}).count() == 1
    with pytest.raises(ValueError, match="stale"):
        tables.sentence_vectors(spark, path, 7, {"model": "b"})
    tables.write_vectors(rows(spark), path, overwrite=True, provenance={"fold": "0"})
    with pytest.raises(ValueError, match="fold must not be recorded"):
        tables.sentence_vectors(spark, path, 7)


def test_folds_are_audited_when_read(spark, tmp_path):
    from lectern.sources import tables

    good = [(k, d, f"g{d // 2}", "test" if d // 2 % 3 == k else "train") for k in range(3) for d in range(12)]
    schema = "outer_fold int, doc_id long, group_id string, role string"

    def audited(name, table):
        tables.write_folds(spark.createDataFrame(table, schema), str(tmp_path / name))
        return tables.read_audited_folds(spark, str(tmp_path / name), 3)

    assert audited("good", good).count() == 36
    for name, table, said in (
        ("lost", good[1:], "rows: 1, tested: 1"), ("twice", good + good[-1:], "rows: 1"), ("role", [(*good[5][:3], "other"), *good[:5], *good[6:]], "role: 1"),
        ("group", [(0, 0, "g9", "test"), *good[1:]], "group: 1"), ("mixed", [(*r[:3], "validation") if r[:2] == (1, 0) else r for r in good], "group in two roles: 1"),
    ):
        with pytest.raises(ValueError, match=said):
            audited(name, table)
