"""Centroid clusters and periodic runs against brute force."""

import hashlib
import random
import re
import zlib

import numpy as np
import pytest

from lectern.llm import centroid_clusters as C
from lectern.llm import periodic_runs as P
from lectern.llm import shared as S


def brute_clusters(rows):
    """rows: (id, components). (id, cluster, distance) of the kept ones and the centroids."""
    kept = [(i, [int(np.floor(64 * float(x))) for x in v]) for i, v in rows if v is not None and len(v) == 64 and all(x is not None and np.isfinite(x) for x in v)]
    key = lambda r: (r[0] is None, "" if r[0] is None else hashlib.sha256(f"1:{r[0]}".encode()).hexdigest(), r[1])
    centroids = [v for _, v in sorted(kept, key=key)[:16]]
    nearest = lambda v: min((sum((a - b) ** 2 for a, b in zip(v, c)), k) for k, c in enumerate(centroids))
    for _ in range(3):
        of = [nearest(v)[1] for _, v in kept]
        for k in range(len(centroids)):
            held = [v for (_, v), c in zip(kept, of) if c == k]
            if held:
                centroids[k] = [sum(x) // len(held) for x in zip(*held)]
    return sorted(((i is None, i or 0), *nearest(v)[::-1]) for i, v in kept), centroids


def vectors(seed, n=150):
    rng = np.random.default_rng(seed)
    rows = [(int(i), [float(x) for x in rng.normal(0, rng.choice([0.1, 3, 200]), 64)]) for i in range(n)]
    rows += [(9000 + k, rows[3][1]) for k in range(40)]  # a common vector
    rows += [(5, rows[5][1]), (5, rows[6][1]), (None, rows[7][1]), (None, rows[7][1])]  # repeated ids, null ids
    rows += [(700, None), (701, []), (702, [1.0] * 63), (703, [1.0] * 65), (704, [1.0] * 63 + [None]), (705, [1.0] * 63 + [float("nan")]), (706, [float("-inf")] + [1.0] * 63)]
    rows += [(800 + k, [float(k % 2)] * 64) for k in range(6)]  # ties
    return rows


@pytest.mark.parametrize("dictionary_rows", [C.DICTIONARY_ROWS, 0])
def test_clusters(spark, dictionary_rows):
    rows = vectors(1)
    df = spark.createDataFrame([(i, v, 1, 2, 3) for i, v in rows], "vec_id long, embedding array<double>, cluster int, row int, sub int")
    found, centroids = C.clusters(df, dictionary_rows=dictionary_rows)
    want, want_centroids = brute_clusters(rows)
    assert sorted(((r.vec_id is None, r.vec_id or 0), r.cluster, r.distance) for r in found.collect()) == want
    assert centroids.tolist() == want_centroids


def test_clusters_query(spark, folder):
    rows = [(i, v) for i, v in vectors(2, 60) if i is not None]
    got = C.op12_centroid_clusters(spark, folder(embeddings=spark.createDataFrame(rows, "vec_id long, embedding array<double>"))).collect()
    want, centroids = brute_clusters(rows)
    sums = {k: sum(d for _, c, d in want if c == k) for k in range(16)}
    digest = [hashlib.sha256(",".join(map(str, c)).encode()).hexdigest() for c in centroids]
    assert sorted((r.vec_id, r.cluster, r.distance, r.cluster_inertia, r.inertia, r.centroid_sha256) for r in got) == sorted((i[1], c, d, sums[c], sum(sums.values()), digest[c]) for i, c, d in want)


def test_few_and_no_vectors_and_large_components(spark, folder):
    df = lambda rows: spark.createDataFrame(rows, "vec_id long, embedding array<double>")
    few = [(k, [k / 64 - 2.0] * 64) for k in range(5)]
    found, centroids = C.clusters(df(few))
    assert sorted(((False, r.vec_id), r.cluster, r.distance) for r in found.collect()) == brute_clusters(few)[0] and len(centroids) == 5
    for none in (df([]), df([(1, None), (2, [0.0])])):
        assert C.op12_centroid_clusters(spark, folder(embeddings=none)).count() == 0
    with pytest.raises(Exception, match="beyond"):
        C.clusters(df([(1, [2.0**40] * 64)]))


def test_packed_subvectors_are_lossless():
    x = np.random.default_rng(1).integers(-C.LIMIT, C.LIMIT, (20, C.DIMS))
    assert (C.unpack(C.pack(x)).reshape(20, C.DIMS) == x).all()


def brute_runs(w):
    n, out = len(w), {}
    for p in range(1, n // 4 + 1):
        i = 0
        while i < n - p:
            j = i
            while j < n - p and w[j] == w[j + p]:
                j += 1
            if j + p - i >= max(6, 4 * p) and j > i:
                out.setdefault((i, j + p - i), p)
            i = max(j, i + 1)
    return sorted((a, length, p) for (a, length), p in out.items())


def repeats(rng, k):
    parts = []
    for _ in range(rng.randrange(0, 6)):
        base = [f"é{rng.randrange(k)}" for _ in range(rng.randrange(1, rng.choice([3, 8, 30])))]
        whole = base * (rng.randrange(1, 9) if rng.random() < 0.6 else 1)
        parts += whole[: len(whole) - rng.randrange(len(base))]
    return parts * rng.choice([1, 1, 2, 4, 5])


def structured():
    a, b = ["0"], ["0", "1"]
    while len(b) < 400:
        a, b = b, b + a
    odd = [str(bin(i).count("1") % 2) for i in range(256)]
    return [b, odd, odd * 5, b[:89] * 6 + b[:7], ["x"] * 700, ["x"] * 5, ["x"] * 6, ["x", "y"] * 4, ["x", "x", "x", "x", "x", "y"] * 4, list("aab") * 4 + list("aac") * 4]


@pytest.mark.parametrize("seed", range(4))
def test_runs_of_word_sequences(seed):
    rng = random.Random(seed)
    for w in [repeats(rng, rng.choice([1, 2, 2, 3, 5, 50])) for _ in range(250)] + structured():
        words = S.mix64(np.array([int(re.sub(r"\D", "", x) or ord(x)) for x in w], np.uint64) + np.uint64(99))
        assert [tuple(map(int, r)) for r in P.runs(words, np.zeros(len(w), int))] == brute_runs(w), w


def brute_digest(doc_id, text):
    w = re.findall(r"[^\x20\x09-\x0D]+", text or "")
    h = zlib.crc32(str(doc_id).encode()) if doc_id is not None else 1
    g, n = h // 10, len(w)
    if h % 10 == 0 and n:
        a = g % n
        p = 1 + (n - a) // (3 + g % 8)
        w = [w[i] if i < a else w[a + (i - a) % p] for i in range(n)]
    found = brute_runs(w)
    gone = {i for a, length, p in found for i in range(a + p, a + length)}
    best = min(found, key=lambda r: (-r[1], r[0], r[2]), default=(None, None, None))
    digest = lambda x: hashlib.sha256(x.encode()).hexdigest()
    return (len(found), *best, None if best[0] is None else 1000 * best[1] // best[2], digest("".join(f"{a},{b},{c}\n" for a, b, c in found)), digest(" ".join(x for i, x in enumerate(w) if i not in gone)))


def test_runs_query(spark, documents, folder):
    rng = random.Random(7)
    texts = [None, "", " \n ", "one", "a b c d e f", "x " * 50, "x\ty\n" * 9, "A a " * 8, "é b " * 6, " ".join(["p q r"] * 3), "a\x00b c " * 5]
    texts += [rng.choice([" ", "  ", "\n"]).join(repeats(rng, rng.choice([2, 3, 50]))) for _ in range(300)]
    texts += [" ".join(f"w{rng.randrange(5000)}" for _ in range(3000)), "n " * 3 + "long passage of seven words here now " * 300]
    got = {r.doc_id: tuple(r)[1:] for r in P.op13_periodic_runs(spark, folder(documents=documents(texts))).collect()}
    assert got == {i: brute_digest(i, t) for i, t in enumerate(texts)}
    assert sum(zlib.crc32(str(i).encode()) % 10 == 0 for i in range(len(texts))) > 10


def test_runs_of_a_text_beyond_a_slice_repeated_rows_and_empty_tables(spark, documents, folder):
    long = " ".join(f"v{k}" for k in range(70_000)) + " again and again" * 5 + " end"
    assert len(long) < S.SLICE_BYTES < 2 * len(long)
    docs = documents([(1, long + " " + long), (1, "b b b b b b"), (1, "b b b b b b"), (None, "b " * 6), (-4, "c " * 9)])
    rows = P.periodic_runs(docs).collect()
    assert [(r.doc_id, [tuple(x) for x in r.runs]) for r in rows[1:]] == [(1, [(0, 6, 1)])] * 2 + [(None, [(0, 6, 1)]), (-4, [(0, 9, 1)])]
    want = brute_runs((" again and again" * 5).split())
    assert [(x.length, x.period) for x in rows[0].runs] == [(w[1], w[2]) for w in want] * 2 and [r.collapsed for r in rows[1:]] == ["b", "b", "b", "c"]
    d = folder(documents=docs)
    assert sorted((r.doc_id is None, r.n_runs) for r in P.op13_periodic_runs(spark, d).collect()) == [(False, 1)] * 3 + [(False, 2)] + [(True, 1)]
    assert P.op13_periodic_runs(spark, folder(documents=docs.limit(0))).count() == 0
