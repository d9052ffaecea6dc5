"""Token shards, mixing and the pipeline."""

import random
import zlib
from collections import Counter

import numpy as np
import pyarrow as pa
import pytest
from tokenizers import Tokenizer

from lectern.llm import mixing as M
from lectern.llm import quality_classifier
from lectern.llm import token_shards as T


@pytest.mark.parametrize("n", [0, 1, 127, 128, 129, 3000])
@pytest.mark.parametrize("high", [1, 2, 300, 50257, 2**32 - 1])
def test_pack(n, high):
    ids = np.random.default_rng(n).integers(0, high, n).astype("<u4")
    assert (T.unpack(T.pack(ids)) == ids).all()


def test_pack_outliers():
    ids = np.full(1000, 7, "<u4")
    ids[::50] = 2**31
    assert (T.unpack(T.pack(ids)) == ids).all() and len(T.pack(ids)) < 300


def test_encoder_equals_the_library():
    path = T.vocabulary_path()
    whole, coder, rng = Tokenizer.from_file(path), T.Encoder(path), random.Random(1)
    letters = list("ab'sté zZ09.,!| \n\n  \t$—“ß　中\U0001f600_-<| ́")
    texts = ["".join(rng.choice(letters) for _ in range(rng.randrange(30))) for _ in range(3000)] + ["a <|endoftext|> b", " x", "x ", "it's a  b"]
    texts += ["".join(rng.choice(["\u00a0", "\u2003", "\u3000", "\u0085", "\u1680", "\u205f", "\t", "\x1c", "\x7f", " ", "\n", "é", "a", "中"]) for _ in range(rng.randrange(12))) for _ in range(3000)]
    texts += ["w" * n + " " + "é" * n for n in range(40)] + ["", " "]
    for size in (1, 7, 500):
        for k in range(0, len(texts), size):
            raw, off = T.S.utf8(pa.array(texts[k : k + size]))
            ids, sizes = coder.encode(raw, off)
            want = [[*whole.encode(t, add_special_tokens=False).ids, T.END_ID] for t in texts[k : k + size]]
            assert sizes.tolist() == list(map(len, want)) and ids.tolist() == [i for x in want for i in x], texts[k : k + size]


def test_encoder_with_equal_codes_and_a_small_cache(monkeypatch):
    path = T.vocabulary_path()
    whole = Tokenizer.from_file(path)
    texts = [f"some words {i} and {i % 7}" for i in range(300)]
    for change in ((T.S, "mix64", lambda h: h & np.uint64(3)), (T, "CACHED_PIECES", 5)):
        with monkeypatch.context() as m:
            m.setattr(*change)
            coder = T.Encoder(path)
            for k in range(0, 300, 10):
                ids, _ = coder.encode(*T.S.utf8(pa.array(texts[k : k + 10])))
                assert ids.tolist() == [i for t in texts[k : k + 10] for i in [*whole.encode(t, add_special_tokens=False).ids, T.END_ID]]


def test_token_shards(documents, spark, folder):
    texts = [None, "", "hello world", "x" * 5000, "a\n\nb", "é é"] + [f"text {i} " * (i % 7) for i in range(50)]
    whole, start, want = Tokenizer.from_file(T.vocabulary_path()), 0, {}
    for i, t in enumerate(texts):
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want[i] = (start, len(ids), zlib.crc32(ids.tobytes()))
        start += len(ids)
    docs = documents(texts).repartition(5)
    got = {r.doc_id: tuple(r)[1:] for r in T.op4_token_shards(spark, folder(documents=docs)).collect()}
    assert got == want
    twice = T.op4_token_shards(spark, folder(documents=docs.union(docs))).collect()
    assert len(twice) == 2 * len(texts) and sum(r.n_tokens for r in twice) == 2 * start
    assert T.op4_token_shards(spark, folder(documents=docs.limit(0))).count() == 0


def edf(shares, q):
    """Slot by slot: the released block with the earliest deadline, ties by source."""
    done, out = {s: 0 for s in shares}, []
    for t in range(q):
        due = [(-(-(done[s] + 1) * q // a), s) for s, a in sorted(shares.items()) if done[s] < a and done[s] * q // a <= t]
        out.append(min(due)[1])
        done[out[-1]] += 1
    return out


def test_pfair_schedule(spark):
    shares = {"=a": 5, "=b": 23, "=c": 2, "=d": 20}
    rows = spark.createDataFrame([(s, 50, a) for s, a in shares.items()], "mix_source string, period long, share long")
    slots = {r.slot: r.mix_source for r in M.period_slots(rows).collect()}
    assert [slots[t] for t in range(50)] == edf(shares, 50)
    sent = Counter()
    for t in range(50):
        sent[slots[t]] += 1
        assert all(abs(sent[s] - a * (t + 1) / 50) < 1 for s, a in shares.items())


def test_mix_keeps_every_character_once_within_one_block(spark):
    rng = random.Random(3)
    rows = [(i, "x" * rng.choice([rng.randrange(400), rng.randrange(9000)]), rng.choice(["hot"] * 6 + ["b", "c", None])) for i in range(600)] + [(7, None, "b"), (7, None, "b")]
    docs = spark.createDataFrame(rows, "doc_id long, text string, source string")
    out = M.mix(docs, block_chars=2000, period=20).collect()
    starts = Counter((r.doc_id, r.text, r.source) for r in out if r.mix_from == 0)
    assert starts == Counter(rows) and sum(r.mix_to - r.mix_from for r in out) == sum(len(r[1] or "") + 1 for r in rows)
    assert all(r.mix_release <= r.mix_slot < r.mix_due and r.mix_from < r.mix_to for r in out)
    # while all sources last, each is within one block of its target at every slot, counted in characters
    shares = {r.mix_source: r.share / r.period for r in M.source_shares(docs, block_chars=2000, period=20).collect()}
    last = min(max(r.mix_slot for r in out if r.mix_source == s) for s in shares)
    for t in range(1, last + 1):
        for s, w in shares.items():
            chars = sum(r.mix_to - r.mix_from for r in out if r.mix_source == s and r.mix_slot < t)
            assert abs(chars / 2000 - w * t) < 1
    assert M.mix(docs.limit(0)).count() == 0


def test_shares_are_whole_slots_and_many_sources(spark):
    docs = spark.createDataFrame([(i, "x" * (1 if i else 100_000), f"s{i}") for i in range(30)], "doc_id long, text string, source string")
    for period, whole in ((40, True), (30, True), (29, False)):
        shares = [r.share for r in M.source_shares(docs, period=period).collect()]
        assert abs(sum(shares) - period) < 1e-9 and min(shares) > 0 and all(x == int(x) for x in shares) == whole
        assert M.mix(docs, period=period).select("mix_slot").distinct().count() == 31  # two blocks of the large one
    given = {f"s{i}": 0.001 * (1 + (i == 0) * 970) for i in range(30)}  # needs a period of 1000
    assert {r.period for r in M.source_shares(docs, given).collect()} == {1000}


def test_weights(spark):
    docs = spark.createDataFrame([(1, "a" * 100, "a"), (2, "b" * 300, "b"), (3, "c" * 100, "c")], "doc_id long, text string, source string")
    shares = {r.mix_source: r.share for r in M.source_shares(docs, {"a": 0.5, "gone": 0.1}, period=1000).collect()}
    assert sum(shares.values()) == 1000 and shares["=a"] > shares["=b"] > shares["=c"] > 0


def test_pipeline(spark, tmp_path):
    import corpus_pipeline

    rng = random.Random(5)
    text = lambda n: " ".join(rng.choice(["house", "tree", "river", "stone", "cloud", "grass"]) + str(rng.randrange(50)) for _ in range(n)) + "."
    item = text(30)
    rows = [(i, text(60), "en", f"s{i % 4}") for i in range(200)]
    rows += [(200 + i, rows[i][1] + " more", "en", "s0") for i in range(20)] + [(300, text(20) + " " + item, "en", "s1")]
    rows += [(400 + i, text(60).upper().replace(" ", "!!! "), "en", "s2") for i in range(60)] + [(500, None, None, None)]
    docs = spark.createDataFrame([(*r, len(r[1] or "")) for r in rows], "doc_id long, text string, lang string, source string, n_chars long")
    docs.write.parquet(str(tmp_path / "documents.parquet"))
    spark.createDataFrame([(i, 1, 0) for i in range(150)] + [(400 + i, 0, 0) for i in range(40)], "doc_id long, quality int, toxic int").write.parquet(str(tmp_path / "labels.parquet"))
    spark.createDataFrame([(1, item)], "item_id long, text string").write.parquet(str(tmp_path / "benchmark.parquet"))
    got = corpus_pipeline.run(spark, str(tmp_path)).collect()
    ids = Counter(r.doc_id for r in got)
    assert max(ids.values()) == 1 and 300 not in ids and not any(400 <= i < 460 for i in ids) and not any(200 <= i < 220 for i in ids)
    assert len([i for i in ids if i < 200]) > 195
    ends = sorted((r.start, r.start + r.n_tokens) for r in got)
    assert ends[0][0] == 0 and all(a[1] == b[0] for a, b in zip(ends, ends[1:]))
    before = docs
    for name, stage in corpus_pipeline.STAGES[:-1]:
        out = stage(spark, before, str(tmp_path))
        assert out.columns == docs.columns, name


def test_mix_with_clashing_names(spark):
    docs = spark.createDataFrame([(1, "a", "s", 5, 6, 7, 8, 9)], "doc_id long, text string, source string, share int, total int, i int, mix_slot int, period int")
    assert M.mixed_order(docs).collect() == docs.collect()
    r = M.mix(docs).first()
    assert (r.share, r.total, r.i, r.period, r.mix_slot) == (5, 6, 7, 9, 0)


@pytest.mark.parametrize("weights", [{"a": 0.9, "b": 0.1}, {"a": 0.99, "b": 0.01}, {"a": 0.61803, "b": 0.2718, "c": 0.1}, {"a": 0.5, "b": 0.49, "c": 0.00999, "d": 1e-5}, {f"s{k}": (k + 1) ** 0.5 for k in range(40)}])
def test_mix_holds_given_weights_over_many_periods(spark, weights):
    docs = spark.createDataFrame([(i, "x" * (i + 1), s) for i, s in enumerate(weights)], "doc_id long, text string, source string")
    shares = M.S.staged(M.source_shares(docs, weights), "shares")
    total, slots = sum(weights.values()), 60 * M.PERIOD
    counts = [(f"={s}", int(slots * w / total) + 3) for s, w in weights.items()]
    blocks = spark.createDataFrame(counts, "mix_source string, n long").selectExpr("mix_source", "explode(sequence(0L, n - 1)) as mix_block")
    rows = M.schedule(blocks, shares).toPandas()
    assert rows.mix_slot.is_unique and len(rows) == sum(n for _, n in counts)
    assert set(range(slots - 10 * M.PERIOD)) <= set(rows.mix_slot)  # no slot is left out while all sources last
    w = rows.mix_source.map({f"={s}": w / total for s, w in weights.items()})
    # before its slot mix_block blocks of the source have gone out, after it one more
    off = max((rows.mix_block - w * rows.mix_slot).abs().max(), (rows.mix_block + 1 - w * (rows.mix_slot + 1)).abs().max())
    assert off < (1 if len(weights) <= 3 else 1.69)
    if len(weights) <= 3:
        assert ((rows.mix_release <= rows.mix_slot) & (rows.mix_slot < rows.mix_due)).all()


def test_exact_shares_where_they_fit(spark):
    docs = spark.createDataFrame([(1, "a", "a"), (2, "b", "b")], "doc_id long, text string, source string")
    for one, want in ((0.9, {"=a": 450, "=b": 50}), (0.99, {"=a": 495, "=b": 5})):
        assert {r.mix_source: r.share for r in M.source_shares(docs, {"a": one, "b": 1 - one}).collect()} == want


def test_pipeline_stages_equal_brute_force(spark, tmp_path):
    import corpus_pipeline

    from .test_pairs import brute_hits, classes

    rng = random.Random(8)
    text = lambda n: " ".join(rng.choice(["house", "tree", "river", "stone", "cloud"]) + str(rng.randrange(40)) for _ in range(n)) + "."
    items = [(k, text(20)) for k in range(3)]
    texts = [text(rng.randrange(1, 80)) for _ in range(120)]
    texts += [t + " end" for t in texts[:15]] + texts[15:20] + [text(30) + " " + items[k][1] for k in range(3)] + [None, "", "q"]
    texts += [text(50).upper().replace(" ", "!!! ") for _ in range(40)]
    rows = [(i, t, "en", None if i % 11 == 0 else f"s{i % 3}", len(t or ""), i % 7) for i, t in enumerate(texts)]
    d, of = str(tmp_path), lambda df: sorted((r.doc_id, r.text) for r in df.collect())
    docs = spark.createDataFrame(rows, "doc_id long, text string, lang string, source string, n_chars long, comp int")
    docs.write.parquet(f"{d}/documents.parquet")
    labels = spark.createDataFrame([(i, int(i < 120)) for i in range(len(rows)) if i < 100 or i > 150], "doc_id long, quality int")
    labels.write.parquet(f"{d}/labels.parquet")
    spark.createDataFrame(items, "item_id long, text string").write.parquet(f"{d}/benchmark.parquet")
    at, got = docs, {}
    for k, (name, stage) in enumerate(corpus_pipeline.STAGES):
        stage(spark, at, d).write.parquet(f"{d}/stage{k}")
        got[k] = spark.read.parquet(f"{d}/stage{k}")
        before, at = at, got[k]
        kept = of(before)
        if k == 0:
            scores = {r.doc_id: r.score for r in quality_classifier.op7_quality_classifier(spark, d).collect()}
            want = [x for x in kept if scores[x[0]] >= 0.7]
            assert len(want) < len(kept)
        elif k == 1:
            ids, groups = [i for i, _ in kept], classes([t for _, t in kept])
            want = [x for n, x in enumerate(kept) if groups[n][1] == n]
            assert len(want) < len(kept) and ids == sorted(ids)
        elif k == 2:
            want = [x for x in kept if not brute_hits(x[1], items)[4]]
            assert len(want) < len(kept)
        elif k == 3:
            want = kept
        if k < 4:
            assert of(at) == want and at.columns == docs.columns, name
    order = [(r.doc_id, r.text) for r in got[3].collect()]
    whole, start, want = Tokenizer.from_file(T.vocabulary_path()), 0, []
    for i, t in order:
        ids = np.array([*whole.encode(t or "", add_special_tokens=False).ids, 0], "<u4")
        want.append((i, start, len(ids), zlib.crc32(ids.tobytes())))
        start += len(ids)
    assert sorted(map(tuple, got[4].collect())) == sorted(want)
    empty = docs.limit(0)
    for name, stage in corpus_pipeline.STAGES:
        assert stage(spark, empty, d).count() == 0, name
