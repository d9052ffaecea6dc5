"""Groups of equal texts by the whole rule (NFKC, no-break space to space, strip), which DuckDB cannot say."""

import unicodedata
from collections import defaultdict

from lectern.plans.catalog import QUERIES


def test_copies_under_nfkc_stay_together(spark, tmp_path):
    copies = [["a plain text", "a\u00a0plain text", " a plain text\u3000"], ["e\ufb03cient \ufb01le", "efficient file"]]
    copies += [["caf\u00e9", "cafe\u0301", "\u00a0caf\u00e9"], ["x\u00b2", "x2"], ["\uff58 y", "x y"]]
    texts = [t for c in copies for t in c] + [f"other {k}" for k in range(40)] + [f"\u00e9 {k}" for k in range(40)]
    rows = [(k, t, "en", f"s{k % 3}", len(t)) for k, t in enumerate(texts)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(k, k % 2, 0) for k in range(20)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    want = defaultdict(list)
    for k, t in enumerate(texts):
        want[unicodedata.normalize("NFKC", t).replace("\u00a0", " ").strip()].append(k)
    got = QUERIES["sentence_groups"](spark, str(tmp_path)).collect()
    assert sorted((r.size, r.first_id) for r in got) == sorted((len(v), v[0]) for v in want.values())
    roles = defaultdict(set)
    for r in QUERIES["nested_roles"](spark, str(tmp_path)).collect():
        roles[r.doc_id].add((r.outer_fold, r.role))
    assert all(roles[k] == roles[v[0]] for v in want.values() for k in v)


def test_no_document_is_lost(spark, tmp_path):
    """Null texts are one group, a null language or source is a label, and documents without marks are dealt too."""
    rows = [(1, "a text", "en", "s1"), (2, None, "en", "s1"), (3, "other", None, None), (4, "a text", "de", "s2"), (5, None, None, "s2"), (6, "", "en", None)]
    spark.createDataFrame(rows, "doc_id long, text string, lang string, source string").write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(1, 1, None)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    got = QUERIES["nested_roles"](spark, str(tmp_path)).collect()
    assert sorted((r.outer_fold, r.doc_id) for r in got) == [(k, i) for k in range(5) for i in range(1, 7)]
    roles = {(r.outer_fold, r.doc_id): r.role for r in got}
    assert all(roles[k, 1] == roles[k, 4] and roles[k, 2] == roles[k, 5] for k in range(5))
    assert all(sum(roles[k, i] == "test" for k in range(5)) == 1 for i in range(1, 7))


def test_groups_without_labels_are_dealt(spark):
    from lectern.operators import splits as P

    groups = spark.createDataFrame([("a", 1), ("b", 2), ("c", 3)], "group_id string, size long")
    labels = spark.createDataFrame([("a", "x")], "group_id string, label string")
    dealt = {r.group_id: (r.label, r.rarity, r.size) for r in P.deal(groups, labels, 2, 2).collect()}
    assert dealt == {"a": ("x", 1.0, 1), "b": ("none", 0.0, 2), "c": ("none", 0.0, 3)}
    assert P.deal(groups.limit(0), labels.limit(0), 2, 2).count() == 0
