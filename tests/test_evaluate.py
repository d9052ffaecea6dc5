from lectern.operators import evaluate as E


def test_rollup_counts_occurrences_not_views(spark):
    views = spark.createDataFrame([("a", "g", 2.0), ("a", "g", 2.0), ("a", "g", 2.0), ("b", "g", 8.0)], "occ string, grp string, score double").selectExpr("*", "0 AS kw_idx", "1 AS label")
    group = E.rollup(E.rollup(views, "occ", carry=("grp",)), "grp").first()
    assert (group.score, group.members) == (5.0, 2)


def test_label_conflict(spark):
    views = spark.createDataFrame([("a", 0, 1), ("a", 0, 0), ("b", 0, 1)], "occ string, kw_idx int, label int")
    assert [r.occ for r in E.label_conflicts(views, "occ").collect()] == ["a"]


def test_average_precision_and_reasons(spark):
    rows = [(0, s, y) for s, y in zip((0.9, 0.1, 0.8, 0.2), (1, 0, 1, 0))] + [(1, 0.5, 0), (2, 0.5, 1), (3, 0.5, 1), (3, 0.5, 0)]
    ap = E.average_precision(spark.createDataFrame(rows, "kw int, score double, label int"), ["kw"])
    from pyspark.sql import functions as F

    yes = F.lit(True)
    got = {r.kw: (r.ap, r.reason) for r in ap.withColumn("reason", E.reason(yes, yes, yes)).collect()}
    assert got == {0: (1.0, "valid"), 1: (None, "no_positive"), 2: (1.0, "no_negative"), 3: (0.5, "valid")}


def test_ties_do_not_depend_on_order(spark):
    rows = [(0, 0.5, i % 2) for i in range(10)]
    one = E.average_precision(spark.createDataFrame(rows, "kw int, score double, label int"), ["kw"]).first().ap
    two = E.average_precision(spark.createDataFrame(rows[::-1], "kw int, score double, label int").repartition(3), ["kw"]).first().ap
    assert one == two == 0.5


def test_auc_and_recall(spark):
    units = spark.createDataFrame([("a", 0, 0.9, 1), ("a", 1, 0.1, 0), ("b", 0, 0.2, 0), ("b", 1, 0.1, 1)], "unit string, kw_idx int, score double, label int")
    assert E.recall_at(units, "unit", (1, 2)).first()[:] == (2, 0.5, 1.0)
    assert {r.kw_idx: r.auc for r in E.auc(units, ["kw_idx"]).collect()} == {0: 1.0, 1: 0.5}
