"""Licences, languages, quality rules, quality scores and secrets against brute force or held-out accuracy."""

import hashlib
import random
import re
from collections import Counter

import numpy as np
import pytest

from lectern.llm import language_id as L
from lectern.llm import license_scan as G
from lectern.llm import quality_classifier as C
from lectern.llm import quality_rules as R
from lectern.llm import secret_scan as S

LOW = str.maketrans("ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def test_licences(documents, spark, folder):
    texts = [
        None, "", "...", "CC BY", "cc-by cc, by", "All rights reserved. ALL RIGHTS RESERVED", "all rights", "Licensed under the GNU General Public License, version 3.",
        "Released under the MIT License.", "general public é license", "LİCENSE ccİ by", "Kcc by", "cc by nc 4 0", "license " * 50, "lesser general public license general",
    ]
    got = {r.doc_id: r for r in G.op1_license_scan(spark, folder(documents=documents(texts))).collect()}
    for i, t in enumerate(texts):
        w = re.findall(r"[^\x00-\x2F\x3A-\x60\x7B-\x7F]+", (t or "").translate(LOW))
        starts, labels = [], set()
        for label, phrase in G.BASE.items():
            p = phrase.split()
            for k in range(len(w) - len(p) + 1):
                if w[k : k + len(p)] == p:
                    starts.append(k)
                    labels.add(label)
        r = got[i]
        assert (r.n_words, r.n_base, r.first_word, r.last_word, r.base_labels) == (len(w), len(starts), min(starts, default=None), max(starts, default=None), ",".join(sorted(labels))), t
        assert labels <= set(r.labels.split(",")) | {""} and 0 <= r.score <= 1
    assert got[8].labels == "mit" and got[8].score == 1.0 and "gpl-notice" in got[7].labels
    assert G.op1_license_scan(spark, folder(documents=documents(texts).limit(0))).count() == 0


def test_whole_licences(documents):
    texts = []
    for label, (key, text) in G.TEXTS.items():
        words = text.split()
        assert f" {key} " in f" {text} ", label
        texts += [text.title().replace(" The ", ", the "), " ".join(words[: len(words) // 2 * 2 : 2]), "x y " + text[text.index(key) :] + " z", "all rights reserved " + text]
    docs = documents(texts)
    got = {r.doc_id: r for r in G.scan(docs, G.word_idf(docs)).collect()}
    for n, label in enumerate(G.TEXTS):
        whole, half, part, late = ([p for p in got[4 * n + k].places if p.label == label] for k in range(4))
        assert len(whole) == 1 and whole[0].score == 1.0 and not half and len(part) == len(late) == 1 and part[0].score <= 1.0
        assert late[0].start == whole[0].start + 3 and {"reserved"} <= {p.label for p in got[4 * n + 3].places}
    twice = documents([texts[0] + " " + texts[0], texts[0] + " " + texts[0]])
    assert [sum(p.label == "apache-2.0-notice" for p in r.places) for r in G.scan(twice, G.word_idf(twice)).collect()] == [2, 2]


def test_languages(documents, spark, folder, out_of_sample):
    rng = random.Random(1)
    words = {"en": "the of and with this that house".split(), "de": "der und nicht ein schön straße haus".split(), "fr": "le la être et une très maison".split()}
    rows = [(i, " ".join(rng.choice(words[lang]) for _ in range(20)), lang) for i, lang in enumerate(rng.choice(list(words)) for _ in range(300))]
    odd = [(1000, None, "en"), (1001, "123 !!", "en"), (1002, "", None), (1003, "a", "en")]
    docs = spark.createDataFrame(rows + odd, "doc_id long, text string, lang string")
    got = {r.doc_id: r for r in L.op2_language_id(spark, folder(documents=docs)).collect()}
    assert all(got[i].lang_pred == lang for i, _, lang in rows) and all(got[i].held_out == out_of_sample(i) for i, _, _ in rows)
    assert [got[i].lang_pred for i in (1000, 1001, 1002)] == ["und"] * 3 and got[1003].lang_pred in words and 0 <= got[1003].score <= 1
    nothing = docs.selectExpr("doc_id", "text", "CAST(NULL AS string) AS lang")
    assert {r.lang_pred for r in L.op2_language_id(spark, folder(documents=nothing)).collect()} == {"und"}
    assert L.op2_language_id(spark, folder(documents=docs.limit(0))).count() == 0


def statistics(text):
    t = text or ""
    w = re.findall(r"[^\x20\x09-\x0D]+", t)
    seen = Counter(tuple(w[k : k + 3]) for k in range(len(w) - 2))
    covered = {k + j for k in range(len(w) - 2) if seen[tuple(w[k : k + 3])] > 1 for j in range(3)}
    lines = [x for x in t.split("\n") if re.search(r"[^\x20\x09-\x0D]", x)]
    return len(w), sum(map(len, w)), len(re.findall(r"[#*$%&|<>]", t)), len(lines) - len(set(lines)), len(covered)


def test_quality_rule_statistics(documents, spark, folder):
    rng = random.Random(2)
    texts = [None, "", " \n ", "a a a", "a a a a a", "a b c a b c", "x\nx\n\n\n y\n y", "é # $\t<b>|", "a\x0bb\x0cc d", "w " * 2000]
    texts += ["\n".join(" ".join(rng.choice("abcdefgh") for _ in range(rng.randrange(9))) for _ in range(rng.randrange(20))) for _ in range(60)]
    got = {r.doc_id: r for r in R.op3_quality_rules(spark, folder(documents=documents(texts))).collect()}
    for i, t in enumerate(texts):
        want = statistics(t)
        assert tuple(got[i])[1:6] == want, t
        assert got[i].base_failed == (want[0] < 50 or 100 * want[4] > 50 * want[0]) and not (got[i].base_failed and got[i].kept)
    assert R.op3_quality_rules(spark, folder(documents=documents(texts).limit(0))).count() == 0


def test_languages_equal_brute_force(documents, spark, folder, out_of_sample):
    rng = random.Random(12)
    words = {"en": ["the", "House", "of", "that"], "de": ["der", "STRASSE", "schön", "und"], "fr": ["été", "une", "maison", "l'eau"]}
    rows = []
    for i in range(80):
        lang = rng.choice(list(words))
        rows.append((i, " ".join(rng.choice(words[lang] + words["en"][:1]) + rng.choice(["", ",", " 7"]) for _ in range(rng.randrange(1, 8))), lang))
    rows += rows[:3] + [(90, None, "en"), (91, "12", None), (92, "é", "fr"), (93, "x" * 700_000, None)]
    got = Counter((r.doc_id, r.lang_pred, round(r.score, 6)) for r in L.op2_language_id(spark, folder(documents=spark.createDataFrame(rows, "doc_id long, text string, lang string"))).collect())

    def grams(text):
        chars = [ord(c.lower()) if c.isalpha() else 32 for c in text or ""]
        for n in L.GRAMS:
            for k in range(len(chars) - n + 1):
                if chars[k] != 32 or chars[k + n - 1] != 32:
                    h = 0
                    for c in chars[k : k + n]:
                        h = (h ^ c) * 0x9E3779B1 % 2**32
                        h ^= h >> 15
                    yield h % L.BUCKETS

    counts = {lang: Counter() for lang in words}
    for i, text, lang in rows:
        if lang and text is not None and not out_of_sample(i):
            counts[lang].update(grams(text))
    total = {lang: sum(c.values()) + L.SMOOTHING * L.BUCKETS for lang, c in counts.items()}
    want = Counter()
    for i, text, _ in rows:
        g = Counter(grams(text))
        n = sum(g.values())
        if not any(c.isalpha() for c in text or ""):
            want[i, "und", 0.0] += 1
            continue
        mean = {lang: sum(m * np.log((c[b] + L.SMOOTHING) / total[lang]) for b, m in g.items()) / n if n else 0.0 for lang, c in sorted(counts.items())}
        best = max(mean.values())
        t = {lang: np.exp((x - best) * min(L.SHARPNESS, max(n, 1))) for lang, x in mean.items()}
        want[i, max(mean, key=mean.get), round(1 / sum(t.values()), 6)] += 1
    near = lambda c: sorted((i, p, round(s, 4)) for (i, p, s), n in c.items() for _ in range(n))
    assert near(got) == near(want)


def test_pair_weights_minimise_the_loss():
    rng = np.random.default_rng(2)
    x = rng.normal(size=(60, len(C.FEATURES)))
    y = (x[:, 0] + 0.5 * x[:, 3] + rng.normal(size=60) > 0).astype(int)
    model = C.fit_pairs(x, y)
    z = np.clip((x - x.mean(0)) / x.std(0), -8, 8)
    z = np.concatenate((z, z * z), axis=1)
    good, bad = np.flatnonzero(y == 1), np.flatnonzero(y == 0)
    few, many = sorted((good, bad), key=len)
    left = np.repeat(many, C.OPPONENTS)
    right = np.random.default_rng(7).permutation(np.resize(few, len(left)))
    d = (z[left] - z[right]) * (1 if many is good else -1)
    loss = lambda w: np.log1p(np.exp(-d @ w)).mean() + C.RIDGE / 2 * w @ w
    for k in range(len(model.weights)):  # no step along an axis lowers it
        step = np.zeros(len(model.weights))
        step[k] = 1e-3
        assert loss(model.weights + step) > loss(model.weights) < loss(model.weights - step)
    strength = z @ model.weights
    assert model.cut == np.quantile(strength, len(bad) / len(y))
    s = model.score(x)
    assert ((s >= C.CUT_SCORE) == (strength >= model.cut - 1e-12)).all() and (np.argsort(s) == np.argsort(strength)).all()


def test_scans_of_repeated_rows_and_clashing_names(spark, folder):
    schema = "doc_id long, text string, lang string, source string, words string, n int, quality_score double, places int, spans string, d2 double"
    rows = [(1, "all rights reserved token = abcdefgh", "en", "s", "w", 1, 0.5, 2, "x", 1.0)] * 2 + [(2, None, None, None, None, None, None, None, None, None)]
    d = folder(documents=spark.createDataFrame(rows, schema), labels=spark.createDataFrame([], "doc_id long, quality int"))
    for op in (G.op1_license_scan, L.op2_language_id, R.op3_quality_rules, C.op7_quality_classifier, S.op9_secret_scan):
        got = Counter(map(tuple, op(spark, d).collect()))
        assert sorted(got.values()) == [1, 2], op.__name__
    empty = folder(documents=spark.createDataFrame([], schema))
    assert C.op7_quality_classifier(spark, empty).count() == 0


STATS = "doc_id long, lang string, source string, n_words long, word_chars long, n_symbols long, n_dup_lines long, n_repeat_words long"


def test_quality_rules_reject_outliers(spark):
    rng = random.Random(4)
    rows = [(i, None, "s", 200 + rng.randrange(200), 0, 0, 0, 3) for i in range(400)]
    rows = [(i, lang, s, n, n * 5 + rng.randrange(n), a, b, c) for i, lang, s, n, _, a, b, c in rows]
    rows += [(400, None, "s", 300, 1600, 900, 0, 3), (401, None, "s", 300, 9000, 0, 0, 3), (402, "rare", "s", 300, 9000, 0, 0, 3), (403, "rare", "t", 300, 1700, 0, 0, 3)]
    stats = spark.createDataFrame(rows, STATS)
    gone = {r.doc_id for r in R.verdicts(stats).where("not kept").collect()}
    assert gone == {400, 401, 402}  # groups of one are judged as well


def mcd_distances(rows):
    """The same rule by brute force: squared distances of rows (lang, source, x) that pass the base rules."""
    floors = np.array(list(R.VECTOR.values()))

    def factor(c):
        c = c.copy()
        np.fill_diagonal(c, np.maximum(np.diag(c), floors**2))
        out = np.zeros_like(c)
        for i in range(5):
            for j in range(i + 1):
                rest = c[i, j] - out[i, :j] @ out[j, :j]
                out[i, j] = max(rest, (floors[i] / 4) ** 2) ** 0.5 if i == j else rest / out[j, j]
        return out

    def d2(x, m, c):
        return (np.linalg.solve(factor(c), (x - m).T) ** 2).sum(0)

    def moments(x):
        return x.mean(0), np.cov(x.T, bias=True).reshape(5, 5)

    def mcd(x):
        at = lambda p: np.sort(x, axis=0)[max(0, int(np.ceil(p * len(x))) - 1)]
        found = []
        for m, c in ((at(0.5), np.diag(((at(0.75) - at(0.25)) / 1.349) ** 2)), moments(x)):
            least = np.inf
            while True:
                d = d2(x, m, c)
                m2, c2 = moments(x[d <= np.sort(d)[int(np.ceil(R.SUBSET * len(x))) - 1]])
                det = np.log(np.diag(factor(c2))).sum()
                if det >= least - 1e-9:
                    break
                least, m, c = det, m2, c2
            found.append((least, m, c))
        _, m, c = min(found, key=lambda f: f[0])
        m, c = moments(x[d2(x, m, c * R.CONSISTENT) <= R.NEAR])
        return len(x), m, c * R.CONSISTENT_NEAR

    def drawn(n, m, c, m_up, c_up):
        w = n / (n + R.PRIOR)
        return w * m + (1 - w) * m_up, w * c + (1 - w) * c_up + w * (1 - w) * np.outer(m - m_up, m - m_up)

    x = np.array([r[2] for r in rows])
    out, top = np.zeros(len(x)), mcd(x)[1:]
    for lang in {r[0] for r in rows}:
        of_lang = np.array([r[0] == lang for r in rows])
        middle = drawn(*mcd(x[of_lang]), *top)
        for source in {r[1] for r in rows if r[0] == lang}:
            own = of_lang & np.array([r[1] == source for r in rows])
            out[own] = d2(x[own], *drawn(*mcd(x[own]), *middle))
    return out


def test_quality_rules_equal_brute_force(spark):
    rng = np.random.default_rng(5)
    rows = []
    for i in range(900):
        n = int(np.exp(rng.normal(5.7, 0.8))) + 50
        odd = rng.random() < 0.1
        lang, source = ["en", "de", None][int(rng.integers(3))], f"s{int(rng.integers(9)) ** 2 // 8}"
        rows.append((i, lang, source, n, int(n * (rng.normal(5, 0.3) + 3 * odd)), int(rng.integers(200)) * odd, int(rng.integers(3)), int(n * 0.2 * rng.random() ** 4)))
    rows += rows[:20] + [(1000, "xx", "only", 90, 500, 0, 0, 0), (1001, "en", "s1", 3, 9, 0, 0, 0)]
    got = {}
    for r in R.verdicts(spark.createDataFrame(rows, STATS)).collect():
        got.setdefault(r.doc_id, r)
    good = [r for r in rows if r[3] >= 50]
    v = lambda r: (np.log1p(np.log1p(r[3])), r[4] / r[3] / 2, np.log1p(100 * r[5] / r[4]), np.log1p(r[6]) / 2, r[7] / r[3])
    want = mcd_distances([(r[1], r[2], v(r)) for r in good])
    assert np.allclose([got[r[0]].distance for r in good], want, rtol=1e-6)
    assert [got[r[0]].kept for r in good] == (want <= R.CUT).tolist() and 20 < (want > R.CUT).sum() < 200 and not got[1001].kept


def test_quality_scores(spark, folder, out_of_sample):
    rng = random.Random(6)
    plain = lambda: " ".join(rng.choice(["house", "tree", "river", "a", "the"]) for _ in range(40)) + "."
    rows = [(i, plain() if i % 3 else plain().upper().replace(" ", "!! ")) for i in range(300)] + [(900, None), (901, ""), (902, "x")]
    docs = spark.createDataFrame(rows, "doc_id long, text string")
    labels = spark.createDataFrame([(i, int(i % 3 > 0), 0) for i in range(300)] + [(900, None, 0)], "doc_id long, quality int, toxic int")
    got = {r.doc_id: r for r in C.op7_quality_classifier(spark, folder(documents=docs, labels=labels)).collect()}
    assert len(got) == 303 and all(0 <= r.score <= 1 and r.predicted == (r.score >= 0.7) for r in got.values())
    held = [i for i in range(300) if out_of_sample(i)]
    assert np.mean([got[i].predicted == (i % 3 > 0) for i in held]) > 0.97 and all(got[i].held_out for i in held)
    kept = C.keep_good(docs, labels)
    assert kept.columns == docs.columns and 150 < kept.count() < 250
    one_class = labels.where("quality = 1")
    assert {round(r.score, 6) for r in C.op7_quality_classifier(spark, folder(documents=docs, labels=one_class)).collect()} == {0.7}


def base_spans(t):
    found = []
    for m in re.finditer(r"""(password|passwd|secret|token|api_?key)["']?\x20*[:=]\x20*["']?([A-Za-z0-9+/_.=-]+)""", t, re.I | re.A):
        found += [(m.start(), 0, "assign", m.end())] if len(m[2]) >= 8 else []
    for m in re.finditer(r"AKIA[A-Z0-9]+", t):
        found += [(m.start(), 1, "access", m.end())] if len(m[0]) >= 16 else []
    for m in re.finditer(r"[0-9a-f]+", t):
        found += [(m.start(), 2, "hex", m.end())] if len(m[0]) >= 32 else []
    return [(k, a, b) for a, _, k, b in sorted(found)]


def test_secrets(documents, spark, folder):
    rng = random.Random(8)
    pieces = ["password", "PASSWD", "api_key", "apikey", "token", "secret", "=", ":", " ", '"', "'", "abcdef12", "0123456789abcdef" * 2, "AKIA", "ABCDEFGHIJKLMNOP", "é", "\n", "x", "ghp_" + "a1" * 18]
    texts = [None, "", "token" + " " * 3000 + "= " + "a" * 9, "f" * 5000, "secret: token= abcdefgh", "kı ſecret=abcdefgh1"]
    texts += ["".join(rng.choice(pieces) for _ in range(rng.randrange(60))) for _ in range(300)]
    got = {r.doc_id: r for r in S.op9_secret_scan(spark, folder(documents=documents(texts))).collect()}
    for i, t in enumerate(texts):
        want = base_spans(t or "")
        said = ",".join(f"{k}:{a}:{b}" for k, a, b in want)
        assert got[i].base_sha256 == hashlib.sha256(said.encode()).hexdigest(), t
        assert [got[i].n_assign, got[i].n_access, got[i].n_hex] == [sum(k == x for k, _, _ in want) for x in S.BASE]
        assert set(said.split(",")) - {""} <= set(got[i].spans.split(","))
    assert any("github:" in r.spans for r in got.values())


def test_automata_equal_a_sequential_pass_and_the_expressions():
    auto = S.automata().all
    raw = np.frombuffer(("token" + " " * 1500 + "=x ab AKIAX" * 400 + "0123456789abcdef" * 300 + "xoxb-" + "a-" * 700).encode(), np.uint8)
    state, want = auto.start * auto.classes, []
    for k in range(len(raw) - 1, -1, -1):
        state = auto.flat[state + auto.of[raw[k]]]
        if auto.bits[state // auto.classes]:
            want.append((k, auto.bits[state // auto.classes]))
    place, bits = auto.starts(raw)
    assert list(zip(place.tolist(), bits.tolist(), strict=True)) == want[::-1]
    rng = random.Random(3)
    pieces = ["ghp_", "gho_", "eyJ", "-----BEGIN ", "RSA ", "PRIVATE KEY-----", "xoxb-", "a1B2" * 9, "x_-" * 4, ".", " ", "-", "token=", "AKIA", "0f" * 16, "abcdefgh"]
    for _ in range(400):
        t = "".join(rng.choice(pieces) for _ in range(rng.randrange(25)))
        want = []
        for k, (full, either, least, group) in enumerate(S.RULES.values()):
            want += [(m.start(), m.end(), k) for m in re.finditer(full, t, re.A | (re.I if either else 0)) if len(m[group]) >= least]
        assert sorted(S.automata().spans(np.frombuffer(t.encode(), np.uint8))) == sorted(want), t


def test_secrets_in_long_and_repeated_texts(documents, spark, folder):
    long = "lorem ipsum " * 120_000 + "secret = abcdefgh" + " x" * 400_000  # more than a slice
    rows = [(1, "token: 12345678"), (1, "token: 12345678"), (2, long), (3, "AKIA"), (4, "ABCDEFGHIJKLMNOP")]
    got = Counter((r.doc_id, r.n_assign, r.n_access, r.spans) for r in S.op9_secret_scan(spark, folder(documents=documents(rows).coalesce(1))).collect())
    assert got == {(1, 1, 0, "assign:0:15"): 2, (2, 1, 0, "assign:1440000:1440017"): 1, (3, 0, 0, ""): 1, (4, 0, 0, ""): 1}


@pytest.mark.parametrize("op", [S.op9_secret_scan])
def test_empty_tables(documents, spark, folder, op):
    assert op(spark, folder(documents=documents(["x"]).limit(0))).count() == 0
