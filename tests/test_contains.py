"""Items found whole in texts, wherever they stand and however short they are."""

from lectern.operators import contains as C
from lectern.plans.catalog import QUERIES


def test_benchmark_leakage_anywhere(spark, tmp_path):
    long = "what is the capital of the fourth province and who built its harbour"
    items = [(1, long), (2, "tiny"), (3, "é"), (4, ""), (5, None), (6, "\n starts with white space"), (7, "tiny"), (8, long + "?" * 40), (9, "zq"), (10, "exactly 32 bytes long, yes it is")]
    texts = ['he said "' + long + '"', f"({long})", f"pre-{long}", "x" + long[:-1], "untiny!", "café", "ete", "word\n starts with white space", "", None, long[10:] + long, "z q", "xexactly 32 bytes long, yes it isx", "exactly 32 bytes long, yes it i", "z", "q"]
    docs = [(i, t) for i, t in enumerate(texts)] + [(0, texts[0]), (1, "tiny tiny")]
    spark.createDataFrame(docs, "doc_id long, text string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame(items, "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = QUERIES["benchmark_leakage"](spark, str(tmp_path)).collect()
    assert sorted(map(tuple, got)) == sorted((d, i) for d, t in docs for i, x in items if t is not None and x is not None and x in t)


def test_texts_longer_than_a_part(spark, monkeypatch):
    texts = spark.createDataFrame([(k, "ab" * 40 + "." * k + "needle in a haystack of many more bytes" + "cd" * 9) for k in range(70)], "doc_id long, text string").coalesce(1)
    monkeypatch.setattr(C, "PART_BYTES", 64)
    items = [("needle in a haystack of many more bytes", 1), ("needle", 2), ("cda", 3), ("dcd", 4)]
    got = C.contained(texts, spark.createDataFrame(items, "item string, item_id int")).groupBy("item_id").count().collect()
    assert {r.item_id: r["count"] for r in got} == {1: 70, 2: 70, 4: 70}
