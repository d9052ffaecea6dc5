"""Each check finds what breaks it, and nothing else."""

import pytest

from lectern.operators import evaluate as E
from lectern.operators import monitor as M
from lectern.operators import protocol as P
from lectern.operators import vectors as V
from lectern.sources import tables


def frame(spark, rows, schema):
    return spark.createDataFrame(rows, schema)


def test_lookup_gives_minus_one_for_empty_and_fails_for_unknown(spark):
    dim = frame(spark, [("red", 0), ("sea", 1)], "word string, word_idx long")
    rows = frame(spark, [(1, "sea"), (2, None), (3, "red")], "id int, word string")
    got = P.lookup(rows, dim, ["word"], "word_idx", empty=rows.word.isNull())
    assert sorted((r.id, r.word_idx) for r in got.collect()) == [(1, 1), (2, -1), (3, 0)]
    with pytest.raises(Exception, match="unknown"):
        P.lookup(rows.na.fill("lake"), dim, ["word"], "word_idx", empty=rows.word.isNull()).collect()


def test_chosen_keeps_the_order_asked_for(spark):
    rows = frame(spark, [(1, "a"), (2, "b"), (3, "c")], "id long, x string")
    assert [(r.place, r.x) for r in P.chosen(rows, "id", [3, 1]).orderBy("place").collect()] == [(0, "c"), (1, "a")]
    with pytest.raises(Exception, match="unknown id 9"):
        P.chosen(rows, "id", [1, 9]).collect()


def test_context_sentences(spark):
    texts = frame(spark, [(i, "blue sky 😀") for i in range(5)], "doc_id long, text string")
    good = [(0, "blue", 0, 4), (1, "sky", 5, 8), (2, "😀", 9, 10)]
    bad = {1: (3, "😀", 9, 10), 2: (2, "😀", 9, 12), 3: (2, "blue", 0, 4), 4: (2, "x", 9, 10)}
    words = [(i, *w) for i in range(5) for w in (good if i == 0 else [*good[:2], bad[i]])]
    s = P.context_sentences(texts, frame(spark, words, "doc_id long, position int, surface string, char_start int, char_end int"), "doc_id")
    assert [w.surface for w in s.where("doc_id = 0").first().words] == ["blue", "sky", "😀"]
    assert {r.doc_id: r.fault for r in P.occurrence_faults(s).collect()} == {1: "positions", 2: "spans", 3: "order", 4: "surfaces"}


def test_lexicon_and_references(spark):
    schema = "rank int, keyword_id string, include_core boolean, include_main boolean, include_extended boolean"
    good = frame(spark, [(1, "a", True, True, True), (2, "b", False, False, True)], schema)
    assert P.lexicon_faults(good).count() == 0
    bad = frame(spark, [(1, "a", True, False, True), (3, "a", False, False, False), (4, " ", False, False, False)], schema)
    assert {r.fault for r in P.lexicon_faults(bad).collect()} == {"ranks", "empty id", "repeated id", "tiers"}
    refs = frame(spark, [(["a", "z"], []), (None, ["b", "y"])], "one array<string>, two array<string>")
    assert {(r.list_name, r.reference) for r in P.unknown_references(refs, ["one", "two"], good, "keyword_id").collect()} == {("one", "z"), ("two", "y")}
    counts = frame(spark, [("x", 3), ("y", 4)], "name string, n long")
    assert {r.name: r.found for r in P.unexpected_counts(counts, {"x": 3, "y": 5, "z": 1}).collect()} == {"y": 4, "z": None}


def test_counts_ids_and_alignment(spark):
    a, b = frame(spark, [(1, 2), (2, 3)], "id int, n long"), frame(spark, [(1, 2), (3, 1)], "id int, n long")
    assert {r.id for r in P.count_differences(a, b, "id").collect()} == {2, 3}
    ids = frame(spark, [("t1", "g", 0), ("t1", "g", 0), ("t2", "g", 1), ("t2", "h", 1)], "token_id string, grp string, position int")
    assert [r.token_id for r in P.collisions(ids, "token_id", ["grp", "position"]).collect()] == ["t2"]
    spans = frame(spark, [(1, [(0, 1)]), (2, [(0, 1), (None, None)])], "id int, spans array<struct<char_start:int,char_end:int>>")
    assert [r.id for r in P.unaligned(spans, "id").collect()] == [2]


def test_folds_views_and_contributors(spark):
    f = frame(spark, [(0, 1, "g"), (1, 1, "h"), (0, 2, "g"), (1, 2, "g")], "outer_fold int, doc_id int, group_id string")
    assert {r.fault: r.n for r in P.fold_faults(f, 3).collect()} == {"group changes": 1, "folds not contiguous": 1}
    views = frame(spark, [(0, "a", "train"), (0, "a", "test"), (0, "b", "train"), (1, "a", "train")], "outer_fold int, view_id string, role string")
    assert [r.view_id for r in P.crossing_views(views).collect()] == ["a"]
    assert [(r.outer_fold, r.view_id) for r in P.uncovered_views(views.where("role = 'train'"), views, 2).collect()] == [(1, "b")]
    roles = frame(spark, [(1, "train"), (2, "train"), (3, "validation"), (4, "test")], "id int, role string")
    faults = {r.id: r.fault for r in P.contributor_faults(frame(spark, [(1,), (3,), (9,)], "id int"), roles, "id").collect()}
    assert faults == {2: "missing", 3: "from validation", 9: "unknown"}
    one, two = frame(spark, [("a", 1, 2), ("b", 3, None)], "k string, x int, y int"), frame(spark, [("a", 1, 2), ("b", 3, 4), ("c", 0, 0)], "k string, x int, y int")
    assert {r.k for r in P.recount_differences(one, two, ["k"], ["x", "y"]).collect()} == {"b", "c"}
    keys = frame(spark, [(0, "a"), (0, "b"), (1, "a"), (1, "z")], "f int, k string")
    assert {tuple(r) for r in P.key_set_differences(keys, frame(spark, [("a",), ("b",)], "k string"), "f", "k").collect()} == {(1, "b"), (1, "z")}


def test_scores_stores_and_shapes(spark):
    s = [("v1", 0, 0.5, 1), ("v1", 1, float("nan"), 1), ("v2", 0, 0.1, 0), ("v2", 1, 0.2, 2), ("v3", 0, 0.2, 2)]
    got = {(r.fault, r.view_id) for r in P.score_faults(frame(spark, s, "view_id string, kw_idx int, score double, members int"), 2).collect()}
    assert got == {("score", "v1"), ("members", "v2"), ("width", "v3")}
    kind = "sentence int, position int, occurrence_id string"
    occ = frame(spark, [(1, 0, "a"), (1, 1, "b"), (2, 0, "c"), (3, 0, "d"), (3, 1, "e")], kind)
    vec = frame(spark, [(1, 0, "b"), (1, 1, "a"), (3, 0, "d"), (4, 0, "x")], kind)
    assert {r.sentence: r.fault for r in P.store_faults(occ, vec).collect()} == {1: "order", 2: "empty", 3: "rows", 4: "unknown"}
    assert P.metadata_differences({"model": "m", "width": "4", "fold": "0"}, {"model": "m", "width": "8", "layers": "2"}) == ["layers: None in place of '2'", "width: '4' in place of '8'", "fold must not be recorded"]
    q = frame(spark, [(1, True), (1, False), (2, True), (3, False)], "sample int, valid boolean")
    t = frame(spark, [(1, True), (1, True), (2, True), (2, True), (3, True), (4, True)], "sample int, valid boolean")
    assert {r.sample: r.fault for r in P.shape_faults({"q": q, "t": t}, "sample").collect()} == {2: "shape", 3: "no word", 4: "missing"}


def test_recordings_batches_masks_and_tokens(spark):
    w = frame(spark, [("a", 0, 5, 250, 2), ("a", 3, 9, 250, 2), ("b", 0, 5, 250, 2), ("b", 1, 4, 500, 2), ("c", -1, 5, 250, 2), ("d", 0, 1, 250, 2)], "recording string, start int, stop int, sfreq int, n_channels int")
    r = frame(spark, [("a", 9), ("b", 9), ("c", 9)], "recording string, samples int")
    assert {x.recording for x in P.recording_faults(w, r).collect()} == {"b", "c", "d"}
    b = frame(spark, [(0, "train", 2), (0, "train", 2), (1, "train", 2), (1, None, 2), (2, "test", 2), (2, "test", 3)], "batch int, role string, channels int")
    assert {x.batch for x in P.mixed_batches(b, ["role", "channels"]).collect()} == {1, 2}
    m = frame(spark, [(1, [True, True, False], 2), (2, [True, False, True], 2), (3, [True, False], 2)], "id int, mask array<boolean>, n int")
    assert {x.id for x in P.mask_faults(m, "mask", "n").collect()} == {2, 3}
    t = frame(spark, [(1, 0, True, True), (1, 1, True, False), (2, 0, True, False), (2, 1, True, False), (3, 0, False, False), (3, 1, True, True), (3, 2, True, False)], "doc_id int, token int, attended boolean, special boolean")
    rows = frame(spark, [(1,), (2,), (3,), (3,)], "doc_id int")
    assert {x.doc_id for x in P.first_token_faults(t, rows).collect()} == {2, 3}


def test_only_training_may_ask_for_targets(spark):
    s, v = frame(spark, [(1, "train"), (2, "test")], "id int, role string"), frame(spark, [(1, 5), (2, 6)], "id int, x int")
    assert [(r.id, r.x) for r in P.targets_for(s, v, "id", "train").collect()] == [(1, 5)]
    with pytest.raises(ValueError, match="test"):
        P.targets_for(s, v, "id", "test")


def test_monitor_refuses_what_is_no_number(spark):
    log = frame(spark, [(1, 0, 1.0), (1, 1, float("nan"))], "run long, epoch long, value double")
    with pytest.raises(Exception, match="not a number"):
        M.monitor(log, 0.0, 2).collect()


def test_weighted_total_leaves_out_zero_weights(spark):
    term = lambda x: frame(spark, [(x,)], "value double")
    broken = spark.sql("SELECT raise_error('read') AS value")
    assert V.weighted_total({"a": term(2.0), "b": term(4.0), "c": broken}, {"a": 1.0, "b": 0.5, "c": 0.0}).first()[0] == 4.0
    with pytest.raises(ValueError):
        V.weighted_total({"a": term(1.0)}, {"a": 0.0})


def test_unavailable_keywords_keep_a_row(spark):
    p = frame(spark, [("k", True), ("z", False)], "keyword string, available boolean")
    got = V.exported(V.unavailable(frame(spark, [(1,)], "sample int"), p)).collect()
    assert [tuple(r) for r in got] == [(1, "z", -1e9, False)]


def test_bootstrap_interval_holds_the_estimate(spark):
    units = frame(spark, [(i, i % 2, (i * 37 % 101) / 101 + (i % 3 == 0) * 0.2, int(i % 3 == 0)) for i in range(400)], "unit int, kw_idx int, score double, label int")
    ap = {r.kw_idx: r.ap for r in E.average_precision(units, ["kw_idx"]).collect()}
    ci = {r.kw_idx: r for r in E.bootstrap(units, "unit", ["kw_idx"], 60).collect()}
    assert all(ci[k].low < ap[k] < ci[k].high and ci[k].high - ci[k].low < 0.3 and ci[k].replicates == 60 for k in ap)
    again = {r.kw_idx: r for r in E.bootstrap(units.repartition(3), "unit", ["kw_idx"], 60).collect()}
    assert ci == again


def test_sinks_with_provenance(spark, tmp_path):
    folds = frame(spark, [(0, "train", 1, "g"), (0, "test", 2, "h"), (1, "test", 1, "g"), (1, "train", 2, "h"), (0, "train", 3, "g"), (1, "test", 3, "g")], "outer_fold int, role string, doc_id int, group_id string")
    eligible = frame(spark, [(0, "b", True), (0, "a", False), (1, "a", True), (1, "b", True)], "outer_fold int, keyword string, eligible boolean")
    r = tables.write_protocol(folds, eligible, str(tmp_path / "p")).first()
    assert (r.role_rows, r.groups, r.repeated_groups, r.largest_group, r.folds.n) == ({"train": 3, "test": 3}, 2, 1, 2, 6)
    index = frame(spark, [("a", 1), ("b", 0)], "keyword string, keyword_idx int")
    assert [(x.keyword, x.eligible) for x in tables.read_eligibility(spark, str(tmp_path / "p"), 0, index).collect()] == [("b", True), ("a", False)]
    with pytest.raises(Exception, match="unknown"):
        tables.read_eligibility(spark, str(tmp_path / "p"), 0, index.where("keyword = 'a'")).collect()
    with pytest.raises(Exception, match="exists"):
        tables.write_protocol(folds, eligible, str(tmp_path / "p"))
    occ = frame(spark, [(2, 0, "x"), (1, 0, "y"), (1, 1, "z")], "sentence int, position int, surface string")
    r = tables.write_occurrences(occ, frame(spark, [(5,), (4,)], "sentence int"), str(tmp_path / "o")).first()
    assert (r.n, r.sentences, r.excluded) == (3, 2, [4, 5]) and spark.read.parquet(str(tmp_path / "o")).count() == 3
    got = tables.write_identities({"surface": occ.select("surface"), "sentence": occ.select("sentence")}, str(tmp_path / "i")).collect()
    assert {(x.name, x.n) for x in got} == {("surface", 3), ("sentence", 3)}


def test_typed_tables(spark, tmp_path):
    head = tables.SENTENCES.replace(" int", "").replace(" string", "").replace(", ", ",")
    (tmp_path / "s.csv").write_text(f"{head}\n0,Title,Title,1,true,1,1,,,,,0\n1, rain ,rain,1,false,1,1,k1|k2,k1,k1,k1|k2,2\n2,none,,0,false,1,1,,,,,0\n")
    s = tables.read_sentences(spark, str(tmp_path / "s.csv"))
    ok = tables.valid_sentences(s).collect()
    assert [(r.text_embedding_idx, r.present_keyword_ids) for r in ok] == [(1, ["k1", "k2"])] and ok[0].sentence_group_id == f"grp:{ok[0].normalized_text_sha256}"
    head = tables.VIEWS.replace(" int", "").replace(" string", "").replace(" double", "").replace(", ", ",")
    row = "s1,one,read,1,{},7,3,0.0,1.0,250.0,{},{},{},a.hdr,b.tsv"
    (tmp_path / "v.csv").write_text("\n".join([head, row.format(4, 0, 9, 9), row.format(5, 9, 9, 0), row.format(6, 0, 9, 9), row.format(6, 1, 9, 8)]))
    v = tables.read_views(spark, str(tmp_path / "v.csv"))
    assert v.first().view_id == "s1/one/read/run-1/row-4" and v.first().sentence_occurrence_id == "occ:3"
    assert sorted(r.local_row_idx for r in tables.view_faults(v).collect()) == [5, 6, 6]
    vec = spark.createDataFrame([(2, 0, [1.0]), (1, 1, [2.0]), (1, 0, [3.0])], "sentence int, position int, vector array<double>")
    tables.write_vectors(vec, str(tmp_path / "w"))
    assert sorted(r.position for r in tables.sentence_vectors(spark, str(tmp_path / "w"), 1).collect()) == [0, 1]
    with pytest.raises(Exception, match="exists"):
        tables.write_vectors(vec, str(tmp_path / "w"))
    tables.append_events(vec.select("sentence"), str(tmp_path / "e"))
    tables.append_events(vec.select("sentence"), str(tmp_path / "e"))
    assert spark.read.json(str(tmp_path / "e")).count() == 6
