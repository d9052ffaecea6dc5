"""Early stopping over tables and streams, and the cursor that aligns words."""

import json
import random

import pytest

from lectern.functions import common as C
from lectern.operators import monitor as M
from lectern.streaming import logs


def brute(values, delta, patience):
    best, at, bad, last = None, -1, 0, -1
    for epoch, v in enumerate(values):
        last = epoch
        if best is None or v > best + delta:
            best, at, bad = v, epoch, 0
        else:
            bad += 1
            if bad >= patience:
                return best, at, bad, last, epoch
    return best, at, bad, last, None


def histories(seed):
    rng = random.Random(seed)
    return {(run, metric): [round(rng.random() * 5, 2) for _ in range(rng.randrange(1, 40))] for run in range(6) for metric in ("loss", "f1", "auc")}


def test_monitor_by_run_and_metric_over_many_batches(spark):
    runs = histories(1)
    rows = [(r, m, e, v) for (r, m), vs in runs.items() for e, v in enumerate(vs)]
    random.Random(2).shuffle(rows)
    log = spark.createDataFrame(rows, "run long, metric string, epoch long, value double")
    spark.conf.set("spark.sql.execution.arrow.maxRecordsPerBatch", "7")
    try:
        got = {(r.run, r.metric): tuple(r)[2:] for r in M.monitor(log, 0.3, 3, ("run", "metric")).collect()}
    finally:
        spark.conf.unset("spark.sql.execution.arrow.maxRecordsPerBatch")
    assert got == {k: brute(v, 0.3, 3) for k, v in runs.items()}
    assert M.monitor(log.limit(0), 0.3, 3, ("run", "metric")).count() == 0
    bad = spark.createDataFrame([(1, 0, 1.0), (1, 1, None)], "run long, epoch long, value double")
    with pytest.raises(Exception, match="run 1, epoch 1: not a number"):
        M.monitor(bad, 0.0, 9).collect()


def test_a_stream_goes_on_after_a_restart_and_equals_the_table(spark, tmp_path):
    runs = histories(3)
    rows = [{"run": r, "metric": m, "epoch": e, "value": v} for (r, m), vs in runs.items() for e, v in enumerate(vs)]
    rows.sort(key=lambda x: x["epoch"])
    (tmp_path / "in").mkdir()
    seen = {}

    def part(k, lines):
        (tmp_path / "in" / f"{k}.json").write_text("\n".join(map(json.dumps, lines)))
        out = logs.best_by_metric(spark, str(tmp_path / "in"), 0.3, 3)
        keep = lambda df, _: seen.update({(r.run, r.metric): tuple(r)[2:] for r in df.collect()})
        q = out.writeStream.outputMode("update").option("checkpointLocation", str(tmp_path / "state")).foreachBatch(keep).trigger(availableNow=True).start()
        q.awaitTermination()

    cut = len(rows) // 3
    part(0, rows[:cut])
    part(1, rows[cut : 2 * cut])  # another query, from the first one's checkpoint
    part(2, rows[2 * cut :] + rows[:5])  # some lines again
    assert {k: (*v[:4], None if v[4] in (None, -1) else v[4]) for k, v in seen.items()} == {k: brute(v, 0.3, 3) for k, v in runs.items()}


def test_words_are_aligned_by_one_cursor(spark):
    rng = random.Random(4)
    rows = [(0, None, ["a"]), (1, "a b", None), (2, "", []), (3, "aa a aa", ["a", "aa"]), (4, "é é x", ["é", "é", "y", "x"]), (5, "ab", ["ab", "ab"]), (6, "q", [None, "q"])]
    for k in range(7, 40):
        words = [rng.choice(["ab", "a", "b", "éa", "💧"]) for _ in range(rng.randrange(30))]
        rows.append((k, rng.choice(["", " "]).join(words), words if k % 3 else words[::-1]))
    rows.append((99, "w " * 100_000, ["w"] * 100_000))
    got = {}
    for r in C.aligned_words(spark.createDataFrame(rows, "doc_id long, text string, words array<string>")).collect():
        got.setdefault(r.doc_id, []).append((r.position, r.surface, r.char_start, r.char_end))
    for key, text, words in rows:
        want, at = [], 0
        for i, w in enumerate(words or []) if text is not None else []:
            begin = text.find(w, at) if at >= 0 and w is not None else -1
            at = begin + len(w) if begin >= 0 else -1
            want.append((i, w, begin if begin >= 0 else None, at if at >= 0 else None))
        assert sorted(got.get(key, [])) == sorted(want, key=lambda x: x[0])
