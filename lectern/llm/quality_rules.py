"""Quality rules: base statistics and robust multivariate outliers, with DataFrame functions only.

For each language and source, for each language, and for all documents together, the minimum-covariance-determinant
(MCD) estimate of transformed statistics is found by concentration: the SUBSET share of rows that are nearest gives the
next mean and covariance (sums that Spark aggregates map-side), for as long as the determinant falls. There are two
starts, medians with quartile ranges and means with covariances, and the least determinant counts. The estimate is made
consistent for normal data, reweighted once (rows within the 0.975 quantile of chi-square), and drawn towards that of
the language, and this towards that of all, with the weight of PRIOR rows, so that small groups need no other rule. A
document whose squared Mahalanobis distance exceeds the 0.999 quantile is rejected. A floor on each standard deviation
keeps statistics that are constant in most of a group (such as no symbols at all) from rejecting every document that
differs a little.

Words in 3-word windows found twice are found without leaving the row: hashes of the windows, with their places in the
low bits, are sorted as plain longs; equal neighbours are compared word by word, and a text in which unequal windows
meet under one hash is worked out again from the windows' words.

Defined results: null text: no words, base_failed true. Null lang or source form groups of their own. Repeated rows count
as often as they stand; rows at the same distance are in the nearest share together. Other columns, whatever their names,
are ignored; an empty table gives an empty result.
"""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from . import shared as S

MIN_WORDS, MAX_REPEAT_PERCENT = 50, 50
SUBSET, PRIOR = 0.75, 50
#: Fixed values for 5 degrees of freedom: chi-square quantiles 0.975 and 0.999, and the factors p / P(chi-square of 7 degrees
#: <= quantile p) that make the covariance of the nearest share p consistent, for p = 0.75 and 0.975.
NEAR, CUT = 12.8325, 20.515
CONSISTENT, CONSISTENT_NEAR = 1.41207, 1.05553
#: Transformed statistics and the floors of their standard deviations.
VECTOR = {"x0": 0.1, "x1": 0.25, "x2": 0.25, "x3": 0.15, "x4": 0.1}
BROADCAST_GROUPS, SALTS = 100_000, 64
_SPACE = r"[\x20\x09-\x0D]+"


def _step(df: DataFrame, **columns: Column) -> DataFrame:
    """df with more columns, as a generator's output: they are worked out once, in generated code, and no later
    lambda repeats them."""
    return df.select("*", F.inline(F.array(F.struct(*[c.alias(k) for k, c in columns.items()]))))


def base_statistics(docs: DataFrame) -> DataFrame:
    """doc_id, lang, source and n_words, word_chars, n_symbols, n_dup_lines, n_repeat_words of every whole text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    df = docs.select("doc_id", "lang", "source", text.alias("t"))
    lines = F.filter(F.split("t", "\n"), lambda x: x.rlike(r"[^\x20\x09-\x0D]"))
    df = _step(df, words=F.filter(F.split("t", _SPACE), lambda w: w != ""), lines=lines)
    marks = F.length("t") - F.length(F.regexp_replace("t", r"[#*$%&|<>]", ""))
    df = _step(
        df.select("doc_id", "lang", "source", "words", "t", "lines"),
        n=F.size("words"), word_chars=F.length(F.regexp_replace("t", _SPACE, "")), n_symbols=marks,
        n_dup_lines=F.size("lines") - F.size(F.array_distinct("lines")),
    ).drop("t", "lines")
    df = _step(df, bits=F.length(F.bin("n")))
    at = lambda i, k: F.get("words", i + k)
    longs = "array<bigint>"
    bits = lambda h: F.call_function("shiftleft", F.call_function("shiftrightunsigned", h, F.col("bits")), F.col("bits"))
    packed = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: bits(F.xxhash64(at(i, 0), at(i, 1), at(i, 2))).bitwiseOR(i.cast("long")))
    df = _step(df, packed=F.sort_array(F.when(F.col("n") >= 3, packed).otherwise(F.array().cast(longs))))
    place = lambda k: (F.get("packed", k).bitwiseAND(F.call_function("shiftleft", F.lit(1).cast("long"), F.col("bits")) - 1)).cast("int")
    head = lambda k: F.call_function("shiftrightunsigned", F.get("packed", k), F.col("bits"))
    twins = F.filter(F.sequence(F.lit(1), F.size("packed") - 1), lambda k: head(k) == head(k - 1))
    df = _step(df, twins=F.when(F.size("packed") > 1, twins).otherwise(F.array().cast("array<int>")))
    same = lambda p, q: (at(p, 0) == at(q, 0)) & (at(p, 1) == at(q, 1)) & (at(p, 2) == at(q, 2))
    pairs = F.transform("twins", lambda k: F.struct(place(k - 1).alias("p"), place(k).alias("q")))
    df = _step(df, pairs=pairs)
    clash = F.exists("pairs", lambda x: ~same(x["p"], x["q"]))
    df = _step(df, found=F.sort_array(F.array_distinct(F.flatten(F.transform("pairs", lambda x: F.array(x["p"], x["q"]))))), clash=clash)
    spelled = F.transform(F.sequence(F.lit(0), F.col("n") - 3), lambda i: F.struct(F.concat_ws(" ", at(i, 0), at(i, 1), at(i, 2)).alias("g"), i.alias("i")))
    df = _step(df, spelled=F.when(F.col("clash"), F.array_sort(spelled)))
    spelt = lambda k: F.get("spelled", k)["g"]
    equal = lambda k, j: F.coalesce(spelt(k) == spelt(j), F.lit(False))
    again = F.filter(F.sequence(F.lit(0), F.size("spelled") - 1), lambda k: equal(k, k - 1) | equal(k, k + 1))
    exact = F.sort_array(F.transform(again, lambda k: F.get("spelled", k)["i"]))
    df = _step(df, starts=F.when(F.col("clash"), exact).otherwise(F.col("found")))
    covered = F.aggregate(
        F.sequence(F.lit(0), F.size("starts") - 1), F.lit(0).cast("long"),
        lambda total, k: total + F.coalesce(F.least(F.lit(3), F.get("starts", k + 1) - F.get("starts", k)), F.lit(3)),
    )
    n_repeat = F.when(F.size("starts") > 0, covered).otherwise(F.lit(0).cast("long"))
    whole = [F.col(c).cast("long").alias(c) for c in ("word_chars", "n_symbols", "n_dup_lines")]
    return df.select("doc_id", "lang", "source", F.col("n").cast("long").alias("n_words"), *whole, n_repeat.alias("n_repeat_words"))


_N = range(len(VECTOR))
_MEANS, _COVS, _LOWER = [f"m{i}" for i in _N], [f"c{i}{j}" for i in _N for j in range(i + 1)], [f"l{i}{j}" for i in _N for j in range(i + 1)]


def _moments() -> list[Column]:
    names = list(VECTOR)
    return [F.avg(x).alias(f"m{i}") for i, x in enumerate(names)] + [F.covar_pop(names[i], names[j]).alias(f"c{i}{j}") for i in _N for j in range(i + 1)]


def _factored(df: DataFrame, scale: float = 1.0) -> DataFrame:
    """df with its covariances times scale, the Cholesky factor of them with floors, and its logarithmic determinant."""
    floors = list(VECTOR.values())
    df = df.withColumns({c: F.col(c) * scale for c in _COVS})
    for i in _N:
        for j in range(i + 1):
            c = F.greatest(F.col(f"c{i}{i}"), F.lit(floors[i] ** 2)) if i == j else F.col(f"c{i}{j}")
            rest = c - sum((F.col(f"l{i}{k}") * F.col(f"l{j}{k}") for k in range(j)), F.lit(0.0))
            df = df.withColumn(f"l{i}{j}", F.sqrt(F.greatest(rest, F.lit((floors[i] / 4) ** 2))) if i == j else rest / F.col(f"l{j}{j}"))
    return df.withColumn("logdet", sum((F.log(f"l{i}{i}") for i in _N), F.lit(0.0)))


def distance() -> Column:
    """Squared Mahalanobis distance of x0.. to m0.. under the factor l00.. (forward substitution)."""
    y: list[Column] = []
    for i, x in enumerate(VECTOR):
        y.append((F.col(x) - F.col(f"m{i}") - sum((F.col(f"l{i}{k}") * y[k] for k in range(i)), F.lit(0.0))) / F.col(f"l{i}{i}"))
    return sum((v * v for v in y), F.lit(0.0))


class _Groups:
    """Rows (x0.., g, salt) and how they meet a table of their groups: it is broadcast up to a counted size; beyond it, a
    group's rows are salted, so that a large group is no one task's."""

    def __init__(self, rows: DataFrame) -> None:
        self.rows = rows
        self.small = rows.select("g").distinct().count() <= BROADCAST_GROUPS

    def beside(self, table: DataFrame) -> DataFrame:
        if self.small:
            return self.rows.join(F.broadcast(table), "g")
        return self.rows.join(table.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g", "salt"])


def _starts(groups: _Groups) -> DataFrame:
    """Two first estimates of each group."""
    q = [F.percentile_approx(x, F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75))).alias(f"q_{x}") for x in VECTOR]
    flat = groups.rows.groupBy("g").agg(*q, *_moments(), F.count("*").alias("n"))
    spread = lambda x: F.pow((F.get(f"q_{x}", F.lit(2)) - F.get(f"q_{x}", F.lit(0))) / 1.349, F.lit(2.0))
    robust = [F.get(f"q_{x}", F.lit(1)).alias(f"m{i}") for i, x in enumerate(VECTOR)] + [(spread(list(VECTOR)[i]) if i == j else F.lit(0.0)).alias(f"c{i}{j}") for i in _N for j in range(i + 1)]
    both = F.array(F.struct(F.lit(0).alias("s"), *robust), F.struct(F.lit(1).alias("s"), *_MEANS, *_COVS))
    # the start itself is no estimate from a nearest share: whatever the first one is, it counts as better
    return _factored(flat.select("g", "n", F.inline(both))).withColumn("logdet", F.lit(float("inf")))


def _concentrated(groups: _Groups) -> DataFrame:
    """The raw MCD estimate of each group."""
    state = S.staged(_starts(groups).withColumn("falls", F.lit(True)), "centre")
    while True:
        near = groups.beside(state.where("falls")).withColumn("d2", distance())
        edge = near.groupBy("g", "s").agg(F.percentile_approx("d2", F.lit(SUBSET)).alias("edge"))
        ahead = state.where("falls").join(F.broadcast(edge) if groups.small else edge, ["g", "s"]).select("g", "s", "n", "edge", *_MEANS, *_LOWER)
        moments = groups.beside(ahead).withColumn("d2", distance()).where("d2 <= edge").groupBy("g", "s").agg(*_moments(), F.first("n").alias("n"))
        new = _factored(moments)
        now = state.where("falls").select("g", "s", F.struct("n", *_MEANS, *_COVS, *_LOWER, "logdet").alias("now"))
        new = new.select("g", "s", F.struct("n", *_MEANS, *_COVS, *_LOWER, "logdet").alias("new"))
        falls = F.col("new.logdet") < F.col("now.logdet") - 1e-9
        moved = now.join(new, ["g", "s"]).select("g", "s", F.when(falls, F.col("new")).otherwise(F.col("now")).alias("x"), falls.alias("falls")).select("g", "s", "x.*", "falls")
        state = S.staged(state.where("not falls").unionByName(moved), "centre")
        if state.where("falls").isEmpty():
            break
    best = F.min(F.struct("logdet", "s", "n", *_MEANS, *_COVS)).alias("x")
    return state.groupBy("g").agg(best).select("g", "x.n", *[f"x.{c}" for c in _MEANS + _COVS])


def _drawn(own: DataFrame, above: DataFrame, key: Column) -> DataFrame:
    """Estimates drawn towards those of the groups above (by key), with the weight of PRIOR rows."""
    up = above.select(F.col("g").alias("up_g"), *[F.col(c).alias(f"up_{c}") for c in _MEANS + _COVS])
    both = own.join(F.broadcast(up), key == F.col("up_g"), "left").withColumn("w", F.col("n") / (F.col("n") + PRIOR))
    w = F.col("w")
    mean = [(w * F.col(f"m{i}") + (1 - w) * F.col(f"up_m{i}")).alias(f"m{i}") for i in _N]
    off = [F.col(f"m{i}") - F.col(f"up_m{i}") for i in _N]
    cov = [(w * F.col(f"c{i}{j}") + (1 - w) * F.col(f"up_c{i}{j}") + w * (1 - w) * off[i] * off[j]).alias(f"c{i}{j}") for i in _N for j in range(i + 1)]
    return both.select("g", "n", *mean, *cov)


def estimates(good: DataFrame) -> DataFrame:
    """g_lang, g_source, m0.. and l00..: the estimate of each language and source. good: x0.., g_lang, g_source, salt."""
    every = F.array(F.array(F.lit("all")), F.array("g_lang"), F.array("g_lang", "g_source"))
    levels = F.transform(every, lambda g, k: F.struct(k.alias("level"), g.alias("g")))
    rows = good.select(*VECTOR, "salt", F.inline(levels)).select(*VECTOR, "salt", F.concat(F.array(F.col("level").cast("string")), "g").alias("g"))
    groups = _Groups(rows)
    raw = S.staged(_factored(_concentrated(groups), CONSISTENT), "raw")
    near = groups.beside(raw.select("g", "n", *_MEANS, *_LOWER)).where(distance() <= NEAR)
    found = S.staged(near.groupBy("g").agg(*_moments(), F.first("n").alias("n")).withColumns({c: F.col(c) * CONSISTENT_NEAR for c in _COVS}), "reweighted")
    level = lambda k: found.where(F.get("g", F.lit(0)) == str(k))
    lang = _drawn(level(1), level(0), F.array(F.lit("0"), F.lit("all")))
    own = _drawn(level(2), lang, F.array(F.lit("1"), F.get("g", F.lit(1))))
    return _factored(own).select(F.get("g", F.lit(1)).alias("g_lang"), F.get("g", F.lit(2)).alias("g_source"), *_MEANS, *_LOWER)


def verdicts(stats: DataFrame) -> DataFrame:
    """stats with base_failed, kept and distance (null where the group has no document that passes the base rules)."""
    n = F.col("n_words")
    failed = (n < MIN_WORDS) | (100 * F.col("n_repeat_words") > MAX_REPEAT_PERCENT * n)
    words = F.greatest(n, F.lit(1))
    vector = {
        "x0": F.log1p(F.log1p(n)), "x1": F.col("word_chars") / words / 2, "x2": F.log1p(100.0 * F.col("n_symbols") / F.greatest(F.col("word_chars"), F.lit(1))),
        "x3": F.log1p(F.col("n_dup_lines")) / 2, "x4": F.col("n_repeat_words") / words,
    }
    group = lambda c: F.coalesce(F.concat(F.lit("="), F.col(c).cast("string")), F.lit("null"))
    salt = F.pmod(F.xxhash64("doc_id", "n_words", "word_chars"), F.lit(SALTS)).cast("int").alias("salt")
    rows = stats.select("*", failed.alias("base_failed"), group("lang").alias("g_lang"), group("source").alias("g_source"), salt, *[c.alias(k) for k, c in vector.items()])
    rows = S.staged(rows, "statistics")
    model = S.staged(estimates(rows.where("not base_failed")), "model")
    if model.count() <= BROADCAST_GROUPS:
        out = rows.join(F.broadcast(model), ["g_lang", "g_source"], "left")
    else:
        out = rows.join(model.withColumn("salt", F.explode(F.sequence(F.lit(0), F.lit(SALTS - 1)))), ["g_lang", "g_source", "salt"], "left")
    out = out.withColumn("d2", distance())
    kept = ~F.col("base_failed") & (F.col("d2") <= CUT)
    return out.select(*stats.columns, "base_failed", F.coalesce(kept, F.lit(False)).alias("kept"), F.col("d2").alias("distance"))


def op3_quality_rules(spark, sf_dir: str) -> DataFrame:
    docs = S.table(spark, sf_dir, "documents").select("doc_id", "text", "lang", "source")
    return verdicts(base_statistics(docs)).select("doc_id", "n_words", "word_chars", "n_symbols", "n_dup_lines", "n_repeat_words", "base_failed", "kept")
