import numpy as np
import pytest
from pyspark.sql import functions as F

from lectern.operators import vectors as V


def test_group_balanced_mean(spark):
    rows = spark.createDataFrame([("k", 1, "same", [1.0, 0.0]), ("k", 2, "same", [3.0, 0.0]), ("k", 3, "other", [0.0, 2.0])], "keyword string, sentence int, grp string, vector array<double>")
    r = V.balanced_prototypes(rows, 2).first()
    assert r.available and np.allclose(r.vector, [2**-0.5, 2**-0.5]) and (r.group_df, r.sentence_df) == (2, 3)
    few = V.balanced_prototypes(rows, 3)
    assert few.first().vector == [0.0, 0.0] and V.prototype_faults(few).count() == 0


def test_score_has_no_length_bias(spark):
    p = spark.createDataFrame([("k", True, [1.0, 0.0])], "keyword string, available boolean, vector array<double>")
    s = spark.createDataFrame([("one", [0.6, 0.8])] + [("nine", [0.6, 0.8])] * 9, "unit string, vector array<double>")
    got = [r.score for r in V.log_mean_exp(V.cosines(s, p), "unit").collect()]
    assert got == pytest.approx([0.6, 0.6])


def test_sinkhorn():
    assert np.allclose(V.sinkhorn(np.ones((3, 2)), 0.05, 50), 1 / 6)
    cost = np.random.default_rng(1).random((7, 4))
    plan = V.sinkhorn(cost, 0.05, 200)
    assert np.allclose(plan.sum(0), 1 / 4) and np.allclose(plan.sum(1), 1 / 7, atol=1e-3)
    order = [3, 1, 0, 2]
    assert np.allclose(V.sinkhorn(cost[:, order], 0.05, 200), plan[:, order])


def test_plan_report_and_pool(spark):
    costs = spark.createDataFrame([(0, t, j, float((t * 3 + j) % 4)) for t in range(3) for j in range(2)], "sample long, t long, j long, cost double")
    plan = V.plans(costs, "sample", rounds=300)
    r = V.plan_report(plan, "sample").first()
    assert r.mass == pytest.approx(1) and r.column_error < 1e-9 and r.row_error < 1e-3
    states = spark.createDataFrame([(0, t, [float(t)]) for t in range(3)], "sample long, id long, vector array<double>")
    even = costs.withColumn("mass", F.lit(1 / 6))
    assert [x.value for x in V.pool(even, states, "sample").collect()] == pytest.approx([1.0, 1.0])
    assert V.plans(costs, "sample", rounds=5, most_cells=2).count() == 6


def test_info_nce_without_negatives_is_left_out(spark):
    schema = "batch int, id int, context int, surface int, vector array<double>, sample int"
    q = spark.createDataFrame([(0, 1, 1, 1, [1.0, 0.0], 0), (1, 2, 5, 5, [1.0, 0.0], 0)], schema)
    k = spark.createDataFrame([(0, 11, 1, 1, [1.0, 0.0], 0), (0, 12, 2, 2, [0.0, 1.0], 0), (0, 13, 3, 1, [1.0, 0.0], 0), (1, 14, 5, 5, [1.0, 0.0], 0)], schema)
    got = V.info_nce(q, k).collect()
    assert [r.id for r in got] == [1] and got[0].loss == pytest.approx(np.log1p(np.exp(-1 / 0.07)))


def test_projection_and_padding(spark):
    df = spark.createDataFrame([(1, [1.0, 2.0, 3.0])], "id long, v array<double>")
    r = V.project(df, "v", np.eye(3), ["a", "b", "c"]).first()
    assert [r.a, r.b, r.c] == pytest.approx([-1.2247, 0, 1.2247], abs=1e-3)
    seq = spark.createDataFrame([(1, [1, 2]), (2, [3]), (3, [4])], "id long, a array<int>")
    assert [x.a for x in V.padded(seq, "a", 2, "id").orderBy("id").collect()] == [[1, 2], [3, -1], [4]]


@pytest.mark.parametrize("block", [V.BLOCK, 3])
def test_products_of_blocks(spark, monkeypatch, block):
    monkeypatch.setattr(V, "BLOCK", block)
    monkeypatch.setattr(V, "STATES", 4)
    rng = np.random.default_rng(7)
    p, x = rng.normal(size=(11, 5)), rng.normal(size=(23, 5))
    p[4], x[6] = p[2], 0.0  # a tie, and a state without direction
    p /= np.sqrt((p * p).sum(1, keepdims=True))
    known = spark.createDataFrame([(f"k{i:02d}", i != 8, [float(v) for v in p[i]]) for i in range(11)], "keyword string, available boolean, vector array<double>")
    states = spark.createDataFrame([(i, [float(v) for v in x[i]]) for i in range(23)], "id long, vector array<double>").repartition(3)
    n = np.maximum(np.sqrt((x * x).sum(1, keepdims=True)), 1e-8)
    want = {(i, f"k{j:02d}"): (x / n @ p.T)[i, j] for i in range(23) for j in range(11) if j != 8}
    got = {(r.id, r.keyword): r.cos for r in V.cosines(states, known).collect()}
    assert got.keys() == want.keys() and all(got[k] == pytest.approx(want[k], abs=1e-12) for k in want)
    best = {r.id: (r.pred, round(r.cos, 9)) for r in V.nearest(states, known).collect()}
    assert best == {i: min((-round(want[i, k], 9), k) for k in {k for _, k in want})[::-1][:1] + (max(round(want[i, k], 9) for k in {k for _, k in want}),) for i in range(23)}
    if block == 3:
        plan = V.nearest(states, known)._jdf.queryExecution().executedPlan().toString()
        assert "BroadcastNestedLoop" not in plan and "CartesianProduct" not in plan
    assert V.cosines(states, known.where("not available")).count() == 0


def test_arrays_padded_together(spark):
    df = spark.createDataFrame([(1, [1, 2], [5.0]), (2, [3], None), (3, [], [6.0, 7.0]), (4, [4], [])], "id long, a array<int>, b array<double>")
    got = {r.id: (r.batch, r.a, r.a_mask, r.a_length, r.a_width, r.b, r.b_mask, r.b_length, r.b_width) for r in V.padded_together(df, ["a", "b"], 2, "id").collect()}
    assert got == {
        1: (0, [1, 2], [True, True], 2, 2, [5.0], [True], 1, 1), 2: (0, [3, -1], [True, False], 1, 2, [-1.0], [False], 0, 1),
        3: (1, [-1], [False], 0, 1, [6.0, 7.0], [True, True], 2, 2), 4: (1, [4], [True], 1, 1, [-1.0, -1.0], [False, False], 0, 2),
    }
