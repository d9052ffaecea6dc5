"""Jaccard join, decontamination and suffix dedup against brute force."""

import hashlib
import pickle
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import decontaminate as D
from lectern.llm import jaccard_join as J
from lectern.llm import suffix_dedup as X

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n ", "one", "One  two\tthree", "é" * 60, "a\x00b c", "a b c d e", "A B\nC D E"]


def corpus(seed, n=120):
    rng = random.Random(seed)
    vocabulary = [f"w{i}" for i in range(300)]
    out = []
    for _ in range(n):
        if out and rng.random() < 0.5:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randrange(0, max(2, len(words) // 10))):
                words[rng.randrange(len(words))] = rng.choice(vocabulary)
            out.append(" ".join(words))
        else:
            out.append(" ".join(rng.choice(vocabulary) for _ in range(rng.randrange(1, 200))))
    return out + [x for x in ODD] + out[:5]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 5]) for i in range(len(w) - 4)} if len(w) >= 5 else ({tuple(w)} if w else set())


def classes(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 75 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i)) for i in range(len(texts))}


@pytest.mark.parametrize("seed", [1, 2])
def test_jaccard(documents, folder, spark, seed):
    texts = corpus(seed)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.op8_jaccard_join(spark, folder(documents=documents(texts))).collect()}
    assert got == classes(texts)


def test_jaccard_hot_passage_and_many_near_copies(documents):
    rng = random.Random(3)
    hot = " ".join(f"h{i}" for i in range(40))
    base = [f"b{i}" for i in range(200)]
    texts = [" ".join(f"x{rng.randrange(10**6)}" for _ in range(60)) + " " + hot for _ in range(60)]
    for _ in range(60):
        words = list(base)
        words[rng.randrange(200)] = f"e{rng.randrange(10**6)}"
        texts.append(" ".join(words))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(documents(texts)).collect()}
    assert got == classes(texts)


def test_keep_one(documents):
    docs = documents([(1, "a b c d e f"), (2, "a b c d e f"), (3, "q"), (3, "q"), (None, "a b c d e f"), (4, None)])
    assert sorted((r.doc_id is None, r.doc_id or 0) for r in J.keep_one(docs).collect()) == [(False, 1), (False, 3), (False, 4), (True, 0)]
    assert J.keep_one(docs).columns == docs.columns


def brute_hits(text, items):
    w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (text or "").translate(LOW))
    hit, found = set(), set()
    for item, t in items:
        v = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        n = min(13, len(v))
        for k in range(len(v) - n + 1 if n else 0):
            for p in range(len(w) - n + 1):
                if w[p : p + n] == v[k : k + n]:
                    hit |= set(range(p, p + n))
                    found.add(str(item))
    return len(w), len(hit), len(found), hashlib.sha256(",".join(sorted(found)).encode()).hexdigest(), bool(hit) and 20 * len(hit) >= len(w)


@pytest.mark.parametrize("block", [D.BLOCK_WORDS, 40])
def test_decontamination(documents, spark, folder, monkeypatch, block):
    rng = random.Random(5)
    v = [f"w{i}" for i in range(12)]
    items = [(i, " ".join(rng.choice(v) for _ in range(rng.choice([0, 1, 3, 12, 13, 14, 40])))) for i in range(12)] + [(12, None), (13, "A-b,C"), (14, "w1 w2 zz")]
    items += [items[3]]
    texts = ODD + ["a b c", "x A B c x"]
    for _ in range(40):
        parts = [rng.choice(items)[1] or "" if rng.random() < 0.5 else " ".join(rng.choice(v + ["zz", "yy"]) for _ in range(rng.randrange(30))) for _ in range(4)]
        texts.append(" ".join(parts).upper() if rng.random() < 0.2 else " ".join(parts))
    monkeypatch.setattr(D, "BLOCK_WORDS", block)
    monkeypatch.setattr(D.item_blocks, "__defaults__", (block,))
    d = folder(documents=documents(texts), benchmark=spark.createDataFrame(items, "item_id long, text string"))
    got = {r.doc_id: tuple(r)[1:] for r in D.op10_decontaminate(spark, d).collect()}
    assert got == {i: brute_hits(t, items) for i, t in enumerate(texts)}


def test_decontamination_empty_benchmark(documents, spark):
    none = spark.createDataFrame([], "item_id long, text string")
    assert [r.contaminated for r in D.contamination(documents(["a b"]), none).collect()] == [False]
    assert D.drop_contaminated(documents(["a b", None]), none).count() == 2


def test_decontamination_repeated_rows_empty_documents_and_size(documents, spark):
    items = spark.createDataFrame([("a", "one two three four")], "item_id string, text string")
    docs = documents([(1, "One two, three four five"), (1, "One two, three four five"), (1, "other"), (None, "one two three four")])
    got = Counter((r.doc_id, r.n_hit, r.contaminated) for r in D.contamination(docs, items).collect())
    assert got == {(1, 4, True): 2, (1, 0, False): 1, (None, 4, True): 1}
    assert D.contamination(docs.limit(0), items).count() == 0
    rng = random.Random(1)
    block = [(i, " ".join(f"w{rng.randrange(30_000)}" for _ in range(1000))) for i in range(D.BLOCK_WORDS // 1000)]
    assert len(pickle.dumps(D.Matcher(block))) < 20_000_000


def removed(texts):
    seen, out = set(), {}
    for i, t in enumerate(texts):
        b = (t or "").encode()
        gone = bytearray(len(b))
        windows = [b[k : k + 50] for k in range(len(b) - 49)]
        for k, w in enumerate(windows):
            if w in seen:
                gone[k : k + 50] = b"\1" * 50
        seen |= set(windows)
        spans = sum(1 for k in range(len(b)) if gone[k] and (k == 0 or not gone[k - 1]))
        out[i] = (len(b), sum(gone), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    return out


def test_suffix_dedup(documents, spark, folder):
    rng = random.Random(9)
    texts = corpus(9, 60) + ["a" * 49, "a" * 50, "a" * 200, "ab" * 60, "b" + "ab" * 40, "é" * 30, "xé" * 40]
    long = " ".join(rng.choice(texts) or "" for _ in range(40))
    texts += [long, long[100:400], long[3:60] + "?" + long[60:130]]
    got = {r.doc_id: tuple(r)[1:] for r in X.op6_suffix_dedup(spark, folder(documents=documents(texts))).collect()}
    assert got == removed(texts)


def test_suffix_dedup_nulls_and_empty(documents, spark, folder):
    text = "x" * 30 + "yz" * 20
    docs = documents([(None, text), (5, text), (3, text), (3, text)])
    got = Counter((r.doc_id, r.n_removed) for r in X.op6_suffix_dedup(spark, folder(documents=docs)).collect())
    assert got == {(None, 0): 1, (5, 70): 1, (3, 0): 2}
    assert X.op6_suffix_dedup(spark, folder(documents=docs.limit(0))).count() == 0


def test_transform_equals_sorted_suffixes():
    rng = random.Random(4)
    base = "".join(rng.choice("abc") for _ in range(90))
    strings = sorted({base[rng.randrange(20) :][: rng.randrange(50, 70)] + "d" * (k % 3) for k in range(60)})
    sizes = np.array([len(x) for x in strings])
    t = X.Transform(np.frombuffer("".join(strings).encode(), np.uint8), sizes)
    while t.insert():
        # after each round: the suffixes inserted so far in order (the empty ones by string), what stands before, common prefixes
        suffixes = sorted((x[k:], i, x[k - 1 : k]) for i, x in enumerate(strings) for k in range(max(0, len(x) - t.round), len(x) + 1))
        assert [x[2] for x in suffixes if x[0]] == ["" if b == X.END else chr(b) for b in t.bwt[len(strings) :]]
        assert len(t.bwt) == len(suffixes)
    whole = sorted((x[k:] + "\0", i, k) for i, x in enumerate(strings) for k in range(len(x)))
    for (a, _, _), (b, _, _), c in zip(whole, whole[1:], t.common[len(strings) + 1 :]):
        n = next(k for k in range(len(a) + 1) if k >= len(a) - 1 or k >= len(b) - 1 or a[k] != b[k])
        assert c == min(n, X.LENGTH)
    low = np.array([rng.randrange(1000) for _ in strings])
    least = t.least_by_window(low)
    for i, x in enumerate(strings):
        for k in range(len(x) - X.LENGTH + 1):
            assert least[i, k] == min(low[j] for j, y in enumerate(strings) if x[k : k + X.LENGTH] in y)


def test_suffix_dedup_one_id_with_several_texts(documents, spark, folder):
    text = "".join(chr(97 + k * 7 % 26) for k in range(120))
    docs = documents([(1, text), (4, "q" * 30 + text[:80]), (4, text[40:]), (2, "short"), (9, text[60:] + "z" * 400)])
    got = {(r.doc_id, r.n_bytes): r.n_removed for r in X.op6_suffix_dedup(spark, folder(documents=docs)).collect()}
    assert got == {(1, 120): 0, (4, 110): 80, (4, 80): 80, (2, 5): 0, (9, 460): 60}


def test_stages_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a b c", 0, 1, 2, 3), (2, "q", 4, 5, 6, 7)], "doc_id long, text string, n int, gram int, comp int, id int")
    assert sorted(J.keep_one(docs).collect()) == sorted(docs.collect())
    items = spark.createDataFrame([(1, "a b c")], "item_id long, text string")
    assert [r.id for r in D.drop_contaminated(docs, items).collect()] == [7]


def test_jaccard_keeps_links_of_large_sets_at_the_threshold(documents):
    rng = random.Random(11)
    common = [f"c{i}" for i in range(120)]  # a passage of many documents, no link by itself
    texts = []
    for k in range(40):
        n = rng.choice([50, 65, 130, 400, 900])
        words = [f"t{k}x{rng.randrange(10**6)}" for _ in range(n)] + (common if k % 2 else [])
        texts.append(" ".join(words))
        grams = len(words) - 4
        cut = rng.choice([grams // 4 - 1, grams // 4, grams // 4 + 1, grams // 7])  # one text is part of the other: similarity 1 - cut / grams
        texts.append(" ".join(words[max(0, cut) :] if k % 3 else words[: len(words) - max(0, cut)]))
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(documents(texts)).collect()}
    want = classes(texts)
    assert got == want and 20 < len(texts) - len({c for _, c in want.values()}) < 60


def test_jaccard_one_id_with_several_texts_and_repeated_rows(documents, spark, folder):
    a, b, c = ("alpha beta gamma delta eps zeta", "one two three four five six", "red green blue cyan pink grey")
    docs = documents([(3, a), (3, b), (7, b), (5, a), (5, a), (9, c), (8, c), (8, b), (11, "x y")])
    got = Counter((r.doc_id, r.component_id) for r in J.op8_jaccard_join(spark, folder(documents=docs)).collect())
    assert got == {(3, 3): 2, (7, 3): 1, (5, 3): 2, (9, 3): 1, (8, 3): 2, (11, 11): 1}
    assert sorted((r.doc_id, r.text) for r in J.keep_one(docs).collect()) == sorted([(3, a), (3, b), (11, "x y")])
    assert J.op8_jaccard_join(spark, folder(documents=docs.limit(0))).count() == 0 and J.keep_one(docs.limit(0)).count() == 0


def test_jaccard_near_copies_that_do_not_link_are_seldom_compared(documents, monkeypatch):
    rng = random.Random(11)
    base = [f"w{i}" for i in range(300)]
    texts = []
    for k in range(80):  # about 0.6 similar to each other; the last ones also to a copy with one word changed
        words = list(base)
        for i in rng.sample(range(300), 10):
            words[i] = f"x{k}_{i}"
        texts.append(" ".join(words))
    texts += [t.rsplit(" ", 1)[0] + " end" for t in texts[-3:]]
    asked, plain = [], J._linked

    def counted(pairs, docs):
        asked.append(pairs.count())
        return plain(pairs, docs)

    monkeypatch.setattr(J, "_linked", counted)
    got = {r.doc_id: (r.n_shingles, r.component_id) for r in J.jaccard_classes(documents(texts)).collect()}
    want = classes(texts)
    assert got == want and len({c for _, c in want.values()}) > 60
    assert sum(asked) < 4 * len(texts)  # of 3,403 pairs


def test_finer_signatures_bound_the_overlap(spark):
    rng = np.random.default_rng(5)
    rows = []
    for k in range(40):
        n, m = int(rng.integers(50, 300)), int(rng.integers(50, 300))
        both = rng.integers(0, 1 << 62, int(rng.integers(1, min(n, m))), dtype=np.uint64)
        rows.append([np.unique(np.concatenate((both, rng.integers(0, 1 << 62, x - len(both), dtype=np.uint64)))) for x in (n, m)])

    def side(sets):
        out = []
        for s in sets:
            bits = np.zeros(64 << max(0, len(s) - 1 >> 3).bit_length(), bool)
            bits[s % np.uint64(len(bits))] = True
            out.append((len(s), np.packbits(bits, bitorder="little").view(np.int64).tolist(), [1]))
        return out

    pairs = [(i, x, y) for i, (x, y) in enumerate(zip(side([r[0] for r in rows]), side([r[1] for r in rows]), strict=True))]
    kind = "struct<n:long,fine:array<long>,grams:array<long>>"
    kept = {r.i for r in spark.createDataFrame(pairs, f"i int, x {kind}, y {kind}").where(J._may_link_finely("x", "y")).collect()}
    share = [len(np.intersect1d(a, b)) / len(np.union1d(a, b)) for a, b in rows]
    assert {i for i, s in enumerate(share) if s >= 0.75} <= kept
    assert not {i for i, s in enumerate(share) if s < 0.6} & kept


def test_suffix_dedup_steps_shuffle_nothing(documents, monkeypatch):
    plans, plain = [], X.S.staged

    def watched(df, name, *more):
        if name in ("columns", "spans"):
            plans.append(df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *more)

    monkeypatch.setattr(X.S, "staged", watched)
    line = "the same line of more than fifty bytes stands in several texts here"
    spans = {r.doc_id: (list(r.starts), list(r.ends)) for r in X.repeated_spans(documents([line, "x " + line, line + " y", "other"])).collect()}
    assert set(spans) == {1, 2} and min(spans[1][0]) == 2 and max(spans[1][1]) == 2 + len(line) and max(spans[2][1]) == len(line)
    assert len(plans) >= 2 and not any("Exchange" in p for p in plans)


def test_aligned_transform_ranks_each_suffix_once(monkeypatch):
    rng = random.Random(5)
    left, right = ("".join(rng.choice("ab") for _ in range(k)) for k in (X.REACH, X.LENGTH))
    cut = [(rng.randrange(X.REACH + 1), rng.randrange(X.LENGTH - 16)) for _ in range(300)]  # of the longest string, at its start and its end
    cut = [(a, b) for a, b in cut if X.LONGEST - a - b >= X.LENGTH]
    strings = sorted({("".join(c if rng.random() < 0.98 else "z" for c in left + right)[a : X.LONGEST - b], a, b) for a, b in cut})
    sizes, late = (np.array(x) for x in zip(*((len(x), b) for x, _, b in strings), strict=True))
    ranked, plain = [], X.Transform._ranked
    monkeypatch.setattr(X.Transform, "_ranked", staticmethod(lambda bwt: ranked.append(len(bwt)) or plain(bwt)))
    t = X.Transform(np.frombuffer("".join(x for x, _, _ in strings).encode(), np.uint8), sizes, late=late)
    while t.insert():
        pass
    assert len(t.bwt) == len(t.common) == sizes.sum() + len(sizes) and sum(ranked) <= len(t.bwt)
    low = np.array([rng.randrange(1000) for _ in strings])
    least = t.least_by_window(low)
    for i, (x, a, _) in enumerate(strings):
        for k in range(len(x) - X.LENGTH + 1):
            assert least[i, k] == min(low[j] for j, (y, c, _) in enumerate(strings) if a + k >= c and y[a + k - c :].startswith(x[k : k + X.LENGTH]))


@pytest.fixture
def no_small_sides(spark):
    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    yield
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)


def test_texts_stay_where_they_are_however_many_documents_stay(spark, no_small_sides, monkeypatch):
    """Documents that go are few, so only they are sent: the texts of those that stay are not dealt by a shuffle."""
    monkeypatch.setattr(J.S, "BROADCAST_IDS", 2)
    same = " ".join(f"w{i}" for i in range(40))
    rows = [(i, f"{i} " * 8) for i in range(10, 16)] + [(1, same), (2, same), (None, same), (3, "x"), (3, "x"), (3, "y"), (4, ""), (4, same)]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    kept = J.keep_one(docs)
    plan = kept._jdf.queryExecution().executedPlan().toString()
    assert "SortMergeJoin" not in plan and "ShuffledHashJoin" not in plan
    got = sorted((-1 if r.doc_id is None else r.doc_id, r.text) for r in kept.collect())
    assert got == sorted([(i, f"{i} " * 8) for i in range(10, 16)] + [(1, same), (-1, same), (3, "x"), (3, "y"), (4, ""), (4, same)])


def test_sets_are_dealt_once_and_lone_sketches_not_at_all(spark, no_small_sides, monkeypatch):
    """Disk of the join: whole sets are dealt by their document alone, and sketches of documents with one row, their class's first, are not dealt."""
    plans, plain = {}, J.S.staged

    def noted(df, name, *more):
        plans.setdefault(name, df._jdf.queryExecution().executedPlan().toString())
        return plain(df, name, *more)

    monkeypatch.setattr(J.S, "staged", noted)
    text = " ".join(f"w{i}" for i in range(60))
    rows = [(1, text), (2, text + " more"), (3, text), (4, "a b c d e f g"), (4, "a b c d e f g"), (5, "")]
    got = {(r.doc_id, r.component_id) for r in J.jaccard_classes(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == {(1, 1), (2, 1), (3, 1), (4, 4), (5, 5)}
    assert "grams" in plans["links"] and not [x for x in plans["links"].splitlines() if "hashpartitioning" in x and ", grams" in x]
    assert "LeftAnti" in plans["first"]


def test_collections_of_segments_stay_small_when_all_text_is_shared(documents, spark, folder, monkeypatch):
    """Copies share all their anchors, so their segments are many for their text: more collections take them, none is much larger."""
    rng = random.Random(5)
    texts = ["".join(rng.choice("abcdefgh ") for _ in range(1500)) for _ in range(12)]
    seen, plain = {}, X.S.staged

    def noted(df, name, *more):
        out = plain(df, name, *more)
        if name == "collection":
            seen[len(seen)] = [r.n for r in out.select("n").collect()]
        return out

    monkeypatch.setattr(X.S, "staged", noted)
    monkeypatch.setattr(X, "SEGMENTS", 32, raising=False)
    got = {r.doc_id: (r.n_removed, r.n_spans) for r in X.op6_suffix_dedup(spark, folder(documents=documents(texts * 3))).collect()}
    assert sorted(got.values()) == [(0, 0)] * 12 + [(1500, 1)] * 24
    assert sum(seen[0]) > 2000 and max(seen[0]) < 5 * 32
