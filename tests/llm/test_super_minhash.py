"""SuperMinHash signatures against the algorithm written plainly; near duplicates against brute force."""

import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import shared as S
from lectern.llm import super_minhash as M

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")
ODD = [None, "", " \n ", "one", "One  two", "ONE two", "one two three", "é" * 60, "a\x00b c d", "a b c d e", "A B\nC D E"]


def shingles(text):
    w = re.findall(r"[^\x20\x09-\x0D]+", (text or "").translate(LOW))
    return {tuple(w[i : i + 3]) for i in range(len(w) - 2)} if len(w) >= 3 else ({tuple(w)} if w else set())


def classes(texts):
    sets, parent = [shingles(t) for t in texts], list(range(len(texts)))

    def find(i):
        while parent[i] != i:
            i = parent[i]
        return i

    for i in range(len(texts)):
        for j in range(i):
            if sets[i] and sets[j] and 100 * len(sets[i] & sets[j]) >= 85 * len(sets[i] | sets[j]):
                a, b = sorted((find(i), find(j)))
                parent[b] = a
    return {i: (len(sets[i]), find(i), find(i) == i) for i in range(len(texts))}


def corpus(seed, n=120):
    rng = random.Random(seed)
    out = []
    for _ in range(n):
        if out and rng.random() < 0.6:
            words = rng.choice(out).split(" ")
            for _ in range(rng.randrange(0, max(2, len(words) // 25))):
                words[rng.randrange(len(words))] = f"w{rng.randrange(300)}"
            out.append(" ".join(words))
        else:
            out.append(" ".join(f"w{rng.randrange(300)}" for _ in range(rng.randrange(1, 250))))
    return out + ODD + out[:5]


def plain_signature(elements):
    """One element after the other; a rank at a time, ended early by a histogram's largest rank."""
    m, out = M.COMPONENTS, [int(M._OPEN)] * M.COMPONENTS
    for x in elements:
        deal = list(range(m))
        for rank in range(m):
            if rank > max(v >> 56 for v in out):
                break
            drawn = S.mix64(np.array([x], np.uint64) + np.array([rank + 1], np.uint64) * M._ODD)
            k = rank + (int(drawn[0]) >> 32) * (m - rank) // 2**32
            value = rank << 56 | int(S.mix64(drawn ^ M._ODD)[0]) >> 8
            deal[k], deal[rank] = deal[rank], deal[k]
            out[deal[rank]] = min(out[deal[rank]], value)
    return out


@pytest.mark.parametrize("chunk", [M.CHUNK, 7])
def test_signatures(monkeypatch, chunk):
    monkeypatch.setattr(M, "CHUNK", chunk)
    rng = np.random.default_rng(3)
    sets = [np.unique(rng.integers(0, 1 << 60, n).astype(np.uint64)) for n in (0, 1, 2, 7, 40, 300)]
    got = M.signatures(sets)
    assert [list(map(int, g)) for g in got] == [plain_signature(s.tolist()) for s in sets]


def test_components_agree_as_sets_are_similar_with_less_variance_than_independent_ones():
    rng = np.random.default_rng(4)
    for n in (20, 200):
        shares = []
        for _ in range(60):
            x = rng.integers(0, 1 << 62, n + 6 * n // 20).astype(np.uint64)
            a, b = M.signatures([np.unique(x[: n + 3 * n // 20]), np.unique(np.concatenate([x[:n], x[n + 3 * n // 20 :]]))])
            shares.append((a == b).mean())
        j = n / (n + 6 * n // 20)
        assert abs(np.mean(shares) - j) < 0.015
        if n == 20:
            assert np.var(shares) < 0.8 * j * (1 - j) / M.COMPONENTS


@pytest.mark.parametrize("seed", [1, 2])
def test_near_duplicates(documents, folder, spark, seed):
    texts = corpus(seed)
    want = classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.op11_super_minhash(spark, folder(documents=documents(texts))).collect()}
    assert got == want and sum(k for _, _, k in want.values()) < len(texts) - 20


def test_links_at_the_threshold_chains_and_a_hot_passage(documents, monkeypatch):
    monkeypatch.setattr(M.J, "BLOCK", 4)
    monkeypatch.setattr(M, "HOT", 3)
    rng = random.Random(5)
    texts = []
    for k in range(30):
        words = [f"t{k}x{i}" for i in range(rng.choice([42, 102, 302]))]
        grams = len(words) - 2
        cut = rng.choice([grams * 15 // 100, grams * 15 // 100 + 1])  # similarity 1 - cut / grams: 0.85 or just below
        texts += [" ".join(words), " ".join(words[cut:])]
    base = [f"b{i}" for i in range(150)]
    for k in range(60):  # neighbours are alike, ends are not
        words = list(base)
        words[2 * k : 2 * k + 6] = [f"c{k}y{i}" for i in range(6)]
        texts.append(" ".join(words))
    hot = " ".join(f"h{i}" for i in range(120))
    texts += [hot + " " + " ".join(f"x{rng.randrange(10**6)}" for _ in range(rng.choice([15, 30, 40]))) for _ in range(40)]
    want = classes(texts)
    got = {r.doc_id: (r.n_shingles, r.component_id, r.kept) for r in M.near_duplicates(documents(texts)).collect()}
    assert got == want


def test_null_ids_repeated_rows_one_id_with_several_texts_and_empty_tables(spark, documents, folder):
    a, b, c = ("alpha beta gamma delta eps zeta", "one two three four five six", "red green blue cyan pink grey")
    docs = documents([(3, a), (3, b), (7, b), (5, a), (5, a), (9, c), (8, c), (8, b), (11, "x y"), (None, a), (12, None)])
    got = Counter((r.doc_id, r.component_id, r.kept) for r in M.op11_super_minhash(spark, folder(documents=docs)).collect())
    assert got == {(3, 3, True): 2, (7, 3, False): 1, (5, 3, False): 2, (9, 3, False): 1, (8, 3, False): 2, (11, 11, True): 1, (None, None, None): 1, (12, 12, True): 1}
    assert M.op11_super_minhash(spark, folder(documents=docs.limit(0))).count() == 0
    clash = docs.withColumnsRenamed({"lang": "gram", "source": "comp", "n": "a", "score": "b", "words": "id"})
    assert M.near_duplicates(clash).count() == 11


def test_text_beyond_a_slice(documents):
    long = " ".join(f"v{k}" for k in range(90_000))
    assert len(long) > S.SLICE_BYTES
    rows = M.near_duplicates(documents([(2, long), (1, long + " end"), (4, long[: len(long) // 2])])).collect()
    assert sorted((r.doc_id, r.n_shingles, r.component_id) for r in rows) == [(1, 89_999, 1), (2, 89_998, 1), (4, rows[-1].n_shingles if rows[-1].doc_id == 4 else next(r.n_shingles for r in rows if r.doc_id == 4), 4)]
