"""Vectors: embeddings are word vectors or states; sentence = vec_id / 2, group = vec_id % 25. Samples and batches are
runs of 64 ids, so their number grows with the table and their size does not."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import common as C
from lectern.operators import transport as T
from lectern.operators import vectors as V

from .base import SQL, query, table

E_SQL = """e0 AS (SELECT vec_id, label, CAST(embedding AS DOUBLE[]) AS v FROM embeddings
), e AS (SELECT vec_id, label, v, list_transform(v, lambda x: x / n) AS u, n FROM (SELECT *, greatest(sqrt(list_dot_product(v, v)), 1e-8) AS n FROM e0))"""
PROTO_SQL = E_SQL + """, d AS (SELECT label AS keyword, vec_id // 2 AS sentence, vec_id % 25 AS grp, unnest(u) AS x, unnest(range(0, len(u))) AS dim FROM e WHERE (vec_id % 25) % 5 > 0
), d1 AS (SELECT keyword, grp, sentence, dim, avg(x) AS x FROM d GROUP BY ALL), d2 AS (SELECT keyword, grp, dim, avg(x) AS x FROM d1 GROUP BY ALL), d3 AS (SELECT keyword, dim, avg(x) AS x FROM d2 GROUP BY ALL
), df AS (SELECT label AS keyword, count(DISTINCT vec_id % 25) AS group_df, count(DISTINCT vec_id // 2) AS sentence_df, count(DISTINCT vec_id % 25) >= 19 AS available FROM e WHERE (vec_id % 25) % 5 > 0 GROUP BY label
), pr AS (SELECT keyword, group_df, sentence_df, available, CASE WHEN available THEN list_transform(v, lambda x: x / greatest(sqrt(list_dot_product(v, v)), 1e-8)) ELSE list_transform(v, lambda x: 0.0) END AS p FROM (SELECT keyword, list(x ORDER BY dim) AS v FROM d3 GROUP BY keyword) JOIN df USING (keyword))"""
COS_SQL = PROTO_SQL + ", c AS (SELECT vec_id, vec_id // 64 AS sample, label, keyword, list_dot_product(u, p) AS cos, list_dot_product(u, p) / 0.07 AS z FROM e CROSS JOIN pr WHERE available)"


def sample_of() -> Column:
    return F.floor(F.col("id") / 64)


def embeddings(spark: SparkSession, d: str) -> DataFrame:
    return table(spark, d, "embeddings").select(F.col("vec_id").cast("long").alias("id"), F.col("label").alias("keyword"), F.col("embedding").cast("array<double>").alias("vector"))


def traced_prototypes(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    """Prototypes from training groups only, and what they are made of."""
    rows = embeddings(spark, d).withColumn("sentence", F.floor(F.col("id") / 2)).withColumn("grp", F.col("id") % 25)
    return V.traced_prototypes(rows.where(F.col("grp") % 5 > 0), 19, "id")


def prototypes(spark: SparkSession, d: str) -> DataFrame:
    return traced_prototypes(spark, d)[0]


def vector_roles(spark: SparkSession, d: str) -> DataFrame:
    """keyword, id, role: by group, independent of what prototypes are made of."""
    role = F.element_at(F.array(F.lit("test"), *[F.lit("train")] * 4), (F.col("id") % 25 % 5 + 1).cast("int"))
    return embeddings(spark, d).select("keyword", "id", role.alias("role"))


@query(f"WITH {E_SQL} SELECT vec_id, round(n, 6) AS length, round(list_sum(u), 6) AS total, round(u[1], 6) AS head FROM e")
def l2_normalize(spark: SparkSession, d: str) -> DataFrame:
    u = embeddings(spark, d).select("id", C.norm(F.col("vector")).alias("n"), C.unit(F.col("vector")).alias("u"))
    total = F.aggregate("u", F.lit(0.0), lambda s, x: s + x)
    return u.select(F.col("id").alias("vec_id"), F.round("n", 6).alias("length"), F.round(total, 6).alias("total"), F.round(F.get("u", F.lit(0)), 6).alias("head"))


@query(f"WITH {PROTO_SQL} SELECT keyword, unnest(range(0, 64)) AS dim, round(unnest(p), 6) AS value FROM pr")
def prototype_three_level(spark: SparkSession, d: str) -> DataFrame:
    return prototypes(spark, d).select("keyword", F.posexplode("vector").alias("dim", "x")).select("keyword", F.col("dim").cast("long").alias("dim"), F.round("x", 6).alias("value"))


@query(f"WITH {PROTO_SQL} SELECT keyword, group_df, sentence_df, available, round(sqrt(list_dot_product(p, p)), 6) AS length FROM pr")
def prototype_availability(spark: SparkSession, d: str) -> DataFrame:
    return prototypes(spark, d).select("keyword", "group_df", "sentence_df", "available", F.round(C.norm(F.col("vector")), 6).alias("length"))


@query(f"WITH {PROTO_SQL} SELECT count(*) FILTER (available) AS n_available, count(*) AS n_keywords, min(group_df) AS least_group_df, max(group_df) AS most_group_df, count(*) FILTER (NOT available AND list_dot_product(p, p) > 0) AS nonzero_unavailable, count(*) FILTER (available AND abs(list_dot_product(p, p) - 1) > 1e-5) AS not_unit FROM pr")
def prototype_report(spark: SparkSession, d: str) -> DataFrame:
    n = C.norm(F.col("vector"))
    return prototypes(spark, d).agg(
        F.count_if("available").alias("n_available"), F.count("*").alias("n_keywords"), F.min("group_df").alias("least_group_df"), F.max("group_df").alias("most_group_df"),
        F.count_if(~F.col("available") & (n > 0)).alias("nonzero_unavailable"), F.count_if(F.col("available") & (F.abs(n * n - 1) > 1e-5)).alias("not_unit"),
    )


@query(f"WITH {COS_SQL} SELECT sample, keyword, round(0.07 * (max(top) + ln(sum(exp(z - top))) - ln(count(*))), 6) AS score, true AS available FROM (SELECT *, max(z) OVER (PARTITION BY sample, keyword) AS top FROM c) GROUP BY sample, keyword UNION ALL SELECT DISTINCT vec_id // 64, keyword, NULL, false FROM e CROSS JOIN pr WHERE NOT available")
def logmeanexp_score(spark: SparkSession, d: str) -> DataFrame:
    states = embeddings(spark, d).withColumn("sample", sample_of()).drop("keyword")
    known = prototypes(spark, d)
    scored = V.log_mean_exp(V.cosines(states, known), "sample").select("sample", "keyword", F.round("score", 6).alias("score"), F.lit(True).alias("available"))
    return scored.unionByName(V.unavailable(states.select("sample").distinct(), known))


@query(f"WITH {PROTO_SQL}, x AS (SELECT vec_id // 64 AS sample, unnest(v) AS x, unnest(range(0, 64)) AS dim FROM e), m AS (SELECT sample, dim, avg(x) AS x FROM x GROUP BY sample, dim), mv AS (SELECT sample, list(x ORDER BY dim) AS v FROM m GROUP BY sample) SELECT sample, keyword, round(list_dot_product(v, p) / greatest(sqrt(list_dot_product(v, v)), 1e-8), 6) AS score FROM mv CROSS JOIN pr WHERE available")
def mean_pool_score(spark: SparkSession, d: str) -> DataFrame:
    """Each sample's mean vector against the prototypes: the baseline of scores by states."""
    pooled = V.mean_pooled(embeddings(spark, d).withColumn("sample", sample_of()), "sample")
    return V.cosines(pooled, prototypes(spark, d)).select("sample", "keyword", F.round("cos", 6).alias("score"))


@query(f"WITH {COS_SQL}, best AS (SELECT vec_id, label, arg_max(keyword, (round(cos, 9), -keyword)) AS pred FROM c GROUP BY vec_id, label) SELECT label, count(*) AS n, round(avg(CAST(pred = label AS INTEGER)), 6) AS accuracy FROM best GROUP BY label")
def nearest_prototype(spark: SparkSession, d: str) -> DataFrame:
    states = embeddings(spark, d).withColumnRenamed("keyword", "label")
    best = V.nearest(states, prototypes(spark, d))
    return best.groupBy("label").agg(F.count("*").alias("n"), F.round(F.avg((F.col("pred") == F.col("label")).cast("int")), 6).alias("accuracy"))


@query(f"WITH {COS_SQL}, l AS (SELECT vec_id, sample, max(top) + ln(sum(exp(z - top))) - max(z) FILTER (keyword = label) AS loss FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM c) GROUP BY vec_id, sample), s AS (SELECT sample, avg(loss) AS loss, count(loss) AS n FROM l WHERE loss IS NOT NULL GROUP BY sample) SELECT round(avg(loss), 6) AS loss, CAST(sum(n) AS BIGINT) AS n_words, (SELECT count(*) FROM e) - CAST(sum(n) AS BIGINT) AS n_ignored FROM s")
def prototype_cross_entropy(spark: SparkSession, d: str) -> DataFrame:
    states = embeddings(spark, d).withColumnRenamed("keyword", "label").withColumn("sample", sample_of())
    each = V.cross_entropy(V.cosines(states, prototypes(spark, d)), "id", "label")
    by_sample = each.groupBy("sample").agg(F.avg("loss").alias("loss"), F.count("*").alias("n"))
    total = states.agg(F.count("*").alias("all"))
    return by_sample.agg(F.round(F.avg("loss"), 6).alias("loss"), F.sum("n").alias("n_words")).crossJoin(total).select("loss", "n_words", (F.col("all") - F.col("n_words")).alias("n_ignored"))


_NCE_SQL = E_SQL + """, s AS (SELECT vec_id, vec_id // 64 AS batch, vec_id // 6 AS context, (vec_id // 6) % 7 AS surface, vec_id // 64 AS sample, vec_id % 25 AS grp, vec_id % 3 = 0 AS word, u FROM e
), p AS (SELECT a.vec_id, a.sample, a.grp, a.word, a.context = b.context AS pos, list_dot_product(a.u, b.u) / 0.07 AS z FROM s a JOIN s b ON a.batch = b.batch AND a.word <> b.word WHERE a.context = b.context OR a.surface <> b.surface
), l AS (SELECT vec_id, sample, grp, word, ln(sum(exp(z - top))) - ln(sum(exp(z - top)) FILTER (pos)) AS loss FROM (SELECT *, max(z) OVER (PARTITION BY vec_id) AS top FROM p) GROUP BY ALL HAVING count(*) FILTER (pos) > 0 AND count(*) FILTER (NOT pos) > 0
), et AS (SELECT avg(x) AS v, (SELECT count(*) FROM l WHERE word) AS n FROM (SELECT sample, avg(loss) AS x FROM l WHERE word GROUP BY sample)
), te AS (SELECT avg(y) AS v, (SELECT count(*) FROM l WHERE NOT word) AS n FROM (SELECT grp, avg(x) AS y FROM (SELECT grp, sample, avg(loss) AS x FROM l WHERE NOT word GROUP BY grp, sample) GROUP BY grp))"""


def _nce(spark: SparkSession, d: str) -> DataFrame:
    s = embeddings(spark, d).drop("keyword")
    i = F.col("id")
    s = s.select("id", "vector", sample_of().alias("batch"), F.floor(i / 6).alias("context"), (F.floor(i / 6) % 7).alias("surface"), sample_of().alias("sample"), (i % 25).alias("grp"))
    words, states = s.where(i % 3 == 0), s.where(i % 3 != 0)
    a, b = V.info_nce(words, states), V.info_nce(states, words)
    one = V.balanced_mean(a, ["sample"], "loss").withColumnRenamed("loss", "e").crossJoin(a.agg(F.count("*").alias("n_e")))
    two = V.balanced_mean(b, ["grp", "sample"], "loss").withColumnRenamed("loss", "t").crossJoin(b.agg(F.count("*").alias("n_t")))
    return one.crossJoin(two)  # one row each


@query(f"WITH {_NCE_SQL} SELECT round(et.v, 6) AS words_to_states, round(te.v, 6) AS states_to_words, round((et.v + te.v) / 2, 6) AS loss, et.n AS n_words, te.n AS n_states FROM et, te")
def infonce(spark: SparkSession, d: str) -> DataFrame:
    return _nce(spark, d).select(F.round("e", 6).alias("words_to_states"), F.round("t", 6).alias("states_to_words"), F.round((F.col("e") + F.col("t")) / 2, 6).alias("loss"), F.col("n_e").alias("n_words"), F.col("n_t").alias("n_states"))


@query(f"""WITH {E_SQL}, s AS (SELECT vec_id, vec_id // 64 AS batch, vec_id // 6 AS context, (vec_id // 6) % 7 AS surface, vec_id % 25 AS grp, u FROM e WHERE vec_id % 3 = 0
), p AS (SELECT a.vec_id, a.batch, a.context = b.context AS pos, list_dot_product(a.u, list_reverse(b.u)) / 0.07 AS z FROM s a JOIN s b ON a.batch = b.batch WHERE a.context = b.context OR a.surface <> b.surface
), l AS (SELECT vec_id, batch, ln(sum(exp(z))) - ln(sum(exp(z)) FILTER (pos)) AS loss, count(*) FILTER (pos) AS positives, count(*) FILTER (NOT pos) AS negatives FROM p GROUP BY vec_id, batch)
SELECT batch, count(*) AS n_words, round(avg(loss), 6) AS loss FROM l WHERE positives > 0 AND negatives > 0 GROUP BY batch""")
def infonce_words(spark: SparkSession, d: str) -> DataFrame:
    """Words against the words of their own batch in a second view (components in reverse order): loss by batch."""
    i = F.col("id")
    words = embeddings(spark, d).where(i % 3 == 0).select("id", "vector", sample_of().alias("batch"), F.floor(i / 6).alias("context"), (F.floor(i / 6) % 7).alias("surface"))
    each = V.info_nce(words, words.withColumn("vector", F.reverse("vector")))
    return each.groupBy("batch").agg(F.count("*").alias("n_words"), F.round(F.avg("loss"), 6).alias("loss"))


#: The fixture's projection: 64 inputs, 4 outputs.
WEIGHTS = np.array([[((i * 7 + j * 13) % 11 - 5) / 10 for j in range(4)] for i in range(64)])


@query(f"WITH {E_SQL}, n AS (SELECT vec_id, list_transform(v, lambda x: (x - m) / sqrt(s + 1e-5)) AS y FROM (SELECT vec_id, v, list_avg(v) AS m, list_var_pop(v) AS s FROM e)) SELECT vec_id, " + ", ".join(f"round(list_dot_product(y, list_transform(range(0, 64), lambda i: ((i * 7 + {j} * 13) % 11 - 5) / 10.0)), 6) AS p{j}" for j in range(4)) + " FROM n")
def project_vectors(spark: SparkSession, d: str) -> DataFrame:
    names = [f"p{j}" for j in range(4)]
    out = V.project(embeddings(spark, d).select(F.col("id").alias("vec_id"), "vector"), "vector", WEIGHTS, names)
    return out.select("vec_id", *[F.round(n, 6).alias(n) for n in names])


@query(f"WITH {E_SQL} SELECT vec_id, round(list_sum(list_transform(v, lambda x: x * (1 + (vec_id % 4) / 10) + (vec_id % 4) / 100)), 5) AS total, round(v[64] * (1 + (vec_id % 4) / 10) + (vec_id % 4) / 100, 6) AS tail FROM e")
def affine_calibration(spark: SparkSession, d: str) -> DataFrame:
    """Each subject's scale and shift, from a table of subjects."""
    s = spark.range(4).select(F.col("id").alias("subject"), F.array_repeat(1 + F.col("id") / 10, 64).alias("gamma"), F.array_repeat(F.col("id") / 100, 64).alias("beta"))
    rows = embeddings(spark, d).withColumn("subject", F.col("id") % 4).join(F.broadcast(s), "subject")
    out = rows.select(F.col("id").alias("vec_id"), C.affine(F.col("vector"), F.col("gamma"), F.col("beta")).alias("y"))
    return out.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.element_at("y", -1), 6).alias("tail"))


# ---- alignment -----------------------------------------------------------------------------------------------

_COST_SQL = E_SQL + """, s AS (SELECT vec_id, vec_id // 64 AS sample, vec_id % 3 = 0 AS word, u, v FROM e
), cost AS (SELECT a.sample, a.vec_id AS t, b.vec_id AS j, 1 - least(1.0, greatest(-1.0, list_dot_product(a.u, b.u))) AS cost FROM s a JOIN s b ON a.sample = b.sample AND NOT a.word AND b.word)"""


def _sides(spark: SparkSession, d: str) -> tuple[DataFrame, DataFrame]:
    s = embeddings(spark, d).withColumn("sample", sample_of())
    return s.where(F.col("id") % 3 != 0), s.where(F.col("id") % 3 == 0)


@query(f"WITH {_COST_SQL} SELECT sample, t, j, round(cost, 6) AS cost FROM cost")
def cosine_cost(spark: SparkSession, d: str) -> DataFrame:
    return V.pair_costs(*_sides(spark, d), "sample").withColumn("cost", F.round("cost", 6))


# The same iterations by recursion: u from the rows' logsumexp, then v from the columns', 50 times.
_ITERATED = """, k0 AS (SELECT sample, t, j, cost, -cost / 0.05 AS k, ln(count(*) OVER (PARTITION BY sample, j)) AS ln_t, ln(count(*) OVER (PARTITION BY sample, t)) AS ln_n FROM cost
), it AS (SELECT 0 AS round, sample, t, j, cost, k, ln_t, ln_n, CAST(0 AS DOUBLE) AS u, CAST(0 AS DOUBLE) AS v FROM k0
  UNION ALL SELECT round + 1, sample, t, j, cost, k, ln_t, ln_n, u, -ln_n - (m + ln(sum(exp(k + u - m)) OVER (PARTITION BY sample, j))) FROM (
    SELECT *, max(k + u) OVER (PARTITION BY sample, j) AS m FROM (
      SELECT round, sample, t, j, cost, k, ln_t, ln_n, v, -ln_t - (m + ln(sum(exp(k + v - m)) OVER (PARTITION BY sample, t))) AS u FROM (
        SELECT *, max(k + v) OVER (PARTITION BY sample, t) AS m FROM it WHERE round < 50)))
), plan AS (SELECT sample, t, j, cost, exp(k + u + v) AS mass, ln_t, ln_n FROM it WHERE round = 50)"""
_PLAN_SQL = "WITH RECURSIVE " + _COST_SQL + _ITERATED
_WHOLE_SQL = "WITH RECURSIVE " + _COST_SQL.replace("vec_id // 64 AS sample", "0 AS sample") + _ITERATED  # all embeddings are one sample


@query(f"{_PLAN_SQL} SELECT sample, t, j, round(mass, 7) AS mass, round(cost, 6) AS cost FROM plan")
def sinkhorn_plan(spark: SparkSession, d: str) -> DataFrame:
    plan = V.plans(V.pair_costs(*_sides(spark, d), "sample"), "sample")
    return plan.select("sample", "t", "j", F.round("mass", 7).alias("mass"), F.round("cost", 6).alias("cost"))


@query(f"WITH {_COST_SQL} SELECT sample, t, j, round(1 / (count(DISTINCT t) OVER (PARTITION BY sample) * count(DISTINCT j) OVER (PARTITION BY sample)), 9) AS mass FROM cost")
def sinkhorn_equal_cost(spark: SparkSession, d: str) -> DataFrame:
    equal = V.pair_costs(*_sides(spark, d), "sample").withColumn("cost", F.lit(1.0))
    return V.plans(equal, "sample").select("sample", "t", "j", F.round("mass", 9).alias("mass"))


@query(f"{_PLAN_SQL}, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS dim FROM s WHERE NOT word) SELECT plan.sample, j, dim, round(sum(mass * x) / sum(mass), 5) + CAST(0 AS DOUBLE) AS value FROM plan JOIN x ON plan.t = x.vec_id GROUP BY plan.sample, j, dim")
def transport_pool(spark: SparkSession, d: str) -> DataFrame:
    """States pooled for each word by the solver's plan."""
    states, words = _sides(spark, d)
    plan = V.plans(V.pair_costs(states, words, "sample"), "sample")
    return V.pool(plan, states, "sample").select("sample", "j", F.col("dim").cast("long").alias("dim"), (F.round("value", 5) + 0.0).alias("value"))  # no negative zero


@query(f"{_PLAN_SQL}, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS dim FROM s WHERE NOT word), pool AS (SELECT plan.sample, j, dim, sum(mass * x) / sum(mass) AS value FROM plan JOIN x ON plan.t = x.vec_id GROUP BY plan.sample, j, dim) SELECT sample, j, round(sum(mass * cost) * any_value(exp(ln_n)), 6) AS mean_cost, (SELECT round(sum(value), 4) FROM pool WHERE pool.sample = plan.sample AND pool.j = plan.j) AS total FROM plan GROUP BY sample, j")
def align_once(spark: SparkSession, d: str) -> DataFrame:
    """Cost, plan and pooled vector of each word in one pass over its sample."""
    states, words = _sides(spark, d)
    total = F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x)
    return V.align(states, words, "sample").select("sample", "j", F.round("mean_cost", 6).alias("mean_cost"), F.round(total, 4).alias("total"))


_REPORT_SQL = _PLAN_SQL + """, tot AS (SELECT sample, sum(mass * cost) AS transport_cost, -sum(mass * ln(mass)) FILTER (mass > 0) AS entropy, sum(mass) AS mass, count(DISTINCT t) AS n_t, count(DISTINCT j) AS n_j FROM plan GROUP BY sample
), re AS (SELECT sample, max(abs(m - 1 / n_t)) AS row_error FROM (SELECT sample, t, sum(mass) AS m FROM plan GROUP BY sample, t) JOIN tot2 USING (sample) GROUP BY sample)""".replace("tot2", "(SELECT sample, n_t FROM tot)")


@query(f"{_REPORT_SQL} SELECT sample, round(transport_cost, 6) AS transport_cost, round(entropy, 5) AS entropy, round(mass, 6) AS mass, n_t, n_j, round(row_error, 6) AS row_error, row_error <= 1e-3 AND abs(mass - 1) <= 1e-3 AS sound FROM tot JOIN re USING (sample)")
def plan_diagnostics(spark: SparkSession, d: str) -> DataFrame:
    """Cost, entropy, mass and row error of each sample's plan, and whether it is sound."""
    report = V.plan_report(V.plans(V.pair_costs(*_sides(spark, d), "sample"), "sample"), "sample")
    sound = (F.abs(F.col("mass") - 1) <= 1e-3) & (F.col("row_error") <= 1e-3) & (F.col("column_error") <= 1e-3)
    said = [F.round(c, n).alias(c) for c, n in (("transport_cost", 6), ("entropy", 5), ("mass", 6))]
    return report.select("sample", *said, "n_t", "n_j", F.round("row_error", 6).alias("row_error"), sound.alias("sound"))


@query(f"SELECT round((SELECT avg(transport_cost) FROM ({_REPORT_SQL} SELECT transport_cost FROM tot)) + (SELECT loss FROM ({SQL['infonce']})) + 0.5 * (SELECT loss FROM ({SQL['prototype_cross_entropy']})), 4) AS weighted_total")
def alignment_report(spark: SparkSession, d: str) -> DataFrame:
    """The weighted total of the three metrics: transport cost, contrastive loss, cross entropy."""
    report = V.plan_report(V.plans(V.pair_costs(*_sides(spark, d), "sample"), "sample"), "sample")
    terms = {
        "transport": report.agg(F.avg("transport_cost").alias("value")), "contrast": infonce(spark, d).select(F.col("loss").alias("value")),
        "prototype": prototype_cross_entropy(spark, d).select(F.col("loss").alias("value")),
    }
    return V.weighted_total(terms, {"transport": 1.0, "contrast": 1.0, "prototype": 0.5}).select(F.round("weighted_total", 4).alias("weighted_total"))


def _whole(spark: SparkSession, d: str) -> DataFrame:
    s = embeddings(spark, d).withColumn("sample", F.lit(0).cast("long"))
    return T.cost_blocks(s.where(F.col("id") % 3 != 0), s.where(F.col("id") % 3 == 0), "sample")


@query(f"{_WHOLE_SQL} SELECT sample, t, j, round(mass * 1e4, 6) AS mass, round(cost, 6) AS cost FROM plan")
def sinkhorn_whole(spark: SparkSession, d: str) -> DataFrame:
    """The plan of one sample that holds all embeddings, however many: solved in blocks of cells. Masses in ten-thousandths."""
    blocks = _whole(spark, d)
    plan = T.plan(blocks, *T.potentials(blocks, "sample"), "sample")
    return plan.select(F.col("sample").cast("int").alias("sample"), "t", "j", F.round(F.col("mass") * 1e4, 6).alias("mass"), F.round("cost", 6).alias("cost"))


@query(f"{_WHOLE_SQL}, tot AS (SELECT sample, sum(mass * cost) AS transport_cost, -sum(mass * ln(mass)) FILTER (mass > 0) AS entropy, sum(mass) AS mass, count(DISTINCT t) AS n_t, count(DISTINCT j) AS n_j FROM plan GROUP BY sample), re AS (SELECT max(abs(m - 1 / n_t)) AS row_error FROM (SELECT t, sum(mass) AS m FROM plan GROUP BY t), (SELECT n_t FROM tot)), ce AS (SELECT max(abs(m - 1 / n_j)) AS column_error FROM (SELECT j, sum(mass) AS m FROM plan GROUP BY j), (SELECT n_j FROM tot)) SELECT round(transport_cost, 6) AS transport_cost, round(entropy, 5) AS entropy, round(mass, 6) AS mass, n_t, n_j, round(row_error, 8) AS row_error, round(column_error, 8) AS column_error, row_error <= 1e-3 AND column_error <= 1e-3 AND abs(mass - 1) <= 1e-3 AS sound FROM tot, re, ce")
def transport_whole(spark: SparkSession, d: str) -> DataFrame:
    """Cost, entropy, mass and errors of that plan, summed by blocks."""
    blocks = _whole(spark, d)
    r = T.report(blocks, *T.potentials(blocks, "sample"), "sample")
    sound = (F.abs(F.col("mass") - 1) <= 1e-3) & (F.col("row_error") <= 1e-3) & (F.col("column_error") <= 1e-3)
    said = [F.round(c, n).alias(c) for c, n in (("transport_cost", 6), ("entropy", 5), ("mass", 6), ("row_error", 8), ("column_error", 8))]
    return r.select(*said[:3], "n_t", "n_j", *said[3:], sound.alias("sound"))


_PROJECTED_SQL = "WITH RECURSIVE " + E_SQL + """, y AS (SELECT vec_id, list_transform(v, lambda x: (x - m) / sqrt(s + 1e-5)) AS y FROM (SELECT vec_id, v, list_avg(v) AS m, list_var_pop(v) AS s FROM e WHERE vec_id % 3 = 0)
), q AS (SELECT vec_id, list_transform(range(0, 64), lambda j: list_dot_product(y, list_transform(range(0, 64), lambda i: ((i * 7 + j * 13) % 11 - 5) / 10.0))) AS q FROM y
), s AS (SELECT vec_id, vec_id // 64 AS sample, false AS word, u, v FROM e WHERE vec_id % 3 <> 0 UNION ALL SELECT vec_id, vec_id // 64, true, list_transform(q, lambda x: x / greatest(sqrt(list_dot_product(q, q)), 1e-8)), q FROM q
), cost AS (SELECT a.sample, a.vec_id AS t, b.vec_id AS j, 1 - least(1.0, greatest(-1.0, list_dot_product(a.u, b.u))) AS cost FROM s a JOIN s b ON a.sample = b.sample AND NOT a.word AND b.word)""" + _ITERATED


@query(f"{_PROJECTED_SQL}, x AS (SELECT vec_id, unnest(v) AS x, unnest(range(0, 64)) AS dim FROM s WHERE NOT word), pool AS (SELECT plan.sample, j, dim, sum(mass * x) / sum(mass) AS value FROM plan JOIN x ON plan.t = x.vec_id GROUP BY plan.sample, j, dim) SELECT sample, j, round(sum(mass * cost) * any_value(exp(ln_n)), 6) AS mean_cost, (SELECT round(sum(value), 4) + CAST(0 AS DOUBLE) FROM pool WHERE pool.sample = plan.sample AND pool.j = plan.j) AS total FROM plan GROUP BY sample, j")
def align_projected(spark: SparkSession, d: str) -> DataFrame:
    """The whole alignment: words normalised and projected by given weights, cost, plan, pooling."""
    states, words = _sides(spark, d)
    total = F.aggregate("pooled", F.lit(0.0), lambda s, x: s + x)
    weights = np.array([[((i * 7 + j * 13) % 11 - 5) / 10 for j in range(64)] for i in range(64)])
    return V.align(states, words, "sample", weights=weights).select("sample", "j", F.round("mean_cost", 6).alias("mean_cost"), (F.round(total, 4) + 0.0).alias("total"))


#: Scalar mix of the fixture: weights of the layers before the softmax.
MIX = (0.2, -0.1, 0.4)


@query(f"WITH {E_SQL}, w AS (SELECT list_transform({list(MIX)}, lambda x: exp(x) / {float(sum(np.exp(MIX)))!r}) AS w) SELECT vec_id, round(list_sum(list_transform(range(1, 65), lambda i: w[1] * v[i] + w[2] * v[65 - i] + w[3] * u[i])), 5) AS total, round(w[1] * v[1] + w[2] * v[64] + w[3] * u[1], 6) AS head FROM e, w")
def mix_layers(spark: SparkSession, d: str) -> DataFrame:
    """Three layers (the vector, its reverse, its unit vector) mixed by softmax weights."""
    v = F.col("vector")
    rows = embeddings(spark, d).select("id", F.array(v, F.reverse(v), C.unit(v)).alias("layers"))
    out = rows.select(F.col("id").alias("vec_id"), V.scalar_mix(F.col("layers"), MIX).alias("y"))
    return out.select("vec_id", F.round(F.aggregate("y", F.lit(0.0), lambda a, x: a + x), 5).alias("total"), F.round(F.get("y", F.lit(0)), 6).alias("head"))


# ---- stores --------------------------------------------------------------------------------------------------


@query(f"WITH {E_SQL}, x AS (SELECT list_max(list_transform(v, lambda x: abs(x - round(x, 3)))) AS e FROM e) SELECT count(*) AS n, count(*) FILTER (e > 4.9e-4) AS beyond, round(max(e), 6) AS largest FROM x")
def vector_diff(spark: SparkSession, d: str) -> DataFrame:
    """Stored vectors and the same with three decimals, joined by id: largest absolute difference, and rows beyond a tolerance."""
    a = embeddings(spark, d).select("id", "vector")
    b = a.select("id", F.transform("vector", lambda x: F.round(x, 3)).alias("other"))
    each = a.join(b, "id").select(V.largest_difference(F.col("vector"), F.col("other")).alias("e"))
    return each.agg(F.count("*").alias("n"), F.count_if(F.col("e") > 4.9e-4).alias("beyond"), F.round(F.max("e"), 6).alias("largest"))


_STORE_SQL = "SELECT count(*) FILTER (l.doc_id IS NULL) AS missing, count(*) FILTER (d.doc_id IS NULL) AS unknown, " + ", ".join(f"count(*) FILTER (l.doc_id IS NOT NULL AND d.{c} IS DISTINCT FROM l.{c}) AS changed_{c}" for c in ("lang", "source", "n_chars", "text", "n_words", "n_lines", "text_sha256"))


@query(_STORE_SQL + """ FROM (SELECT doc_id, lang, source, n_chars, text, len(regexp_split_to_array(text, ' ')) AS n_words, len(string_split(text, chr(10))) AS n_lines, sha256(text) AS text_sha256 FROM documents) d FULL JOIN (
  SELECT l.doc_id, d.lang, CASE WHEN quality = 0 THEN NULL ELSE source END AS source, length(text) AS n_chars, regexp_replace(text, '[ \\n\\t]+', ' ', 'g') AS text, len(list_filter(regexp_split_to_array(text, '[ \\n\\t]+'), lambda w: w <> '')) AS n_words, 1 AS n_lines, sha256(trim(text)) AS text_sha256 FROM labels l JOIN documents d ON l.doc_id = d.doc_id) l ON d.doc_id = l.doc_id""")
def store_compare(spark: SparkSession, d: str) -> DataFrame:
    """Two stores of documents compared on id and seven attributes, nulls equal to nulls: all documents, and those that
    labels mark, with texts of single spaces on one line, words and hashes told otherwise, and no source where the quality is 0."""
    docs, names = table(spark, d, "documents"), ("lang", "source", "n_chars", "text", "n_words", "n_lines", "text_sha256")
    a = docs.select("doc_id", "lang", "source", "n_chars", "text", F.size(F.split("text", " ")).alias("n_words"), F.size(F.split("text", "\n")).alias("n_lines"), F.sha2("text", 256).alias("text_sha256"))
    marked = docs.join(table(spark, d, "labels"), "doc_id")
    source = F.when(F.col("quality") == 0, None).otherwise(F.col("source")).alias("source")
    b = marked.select("doc_id", "lang", source, F.length("text").alias("n_chars"), F.regexp_replace("text", r"[ \n\t]+", " ").alias("text"), F.size(C.words(F.col("text"))).alias("n_words"), F.lit(1).alias("n_lines"), F.sha2(F.trim("text"), 256).alias("text_sha256"))
    return V.compare_stores(a, b, "doc_id", names)


# ---- ragged batches of conversations -------------------------------------------------------------------------

SIZE = 16
_BATCH_SQL = r"""t AS (SELECT conv_id, turn, len(list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda w: w <> '')) AS n FROM conversations
), c AS (SELECT conv_id, list(n ORDER BY turn, n) AS a FROM t GROUP BY conv_id), b AS (SELECT conv_id, a, (row_number() OVER (ORDER BY conv_id) - 1) // 16 AS batch FROM c
), p AS (SELECT conv_id, batch, a, len(a) AS length, max(len(a)) OVER (PARTITION BY batch) AS width FROM b)"""


def _turns(spark: SparkSession, d: str) -> DataFrame:
    n = table(spark, d, "conversations").select("conv_id", "turn", F.size(C.words(F.col("text"))).alias("n"))
    lists = n.groupBy("conv_id").agg(F.array_sort(F.collect_list(F.struct("turn", "n"))).alias("a"))
    return lists.select("conv_id", F.transform("a", lambda x: x["n"]).alias("a"))


@query(f"WITH {_BATCH_SQL} SELECT conv_id, batch, length, width, array_to_string(list_concat(a, list_transform(range(0, width - length), lambda i: -1)), ',') AS padded, array_to_string(list_transform(range(0, width), lambda i: CASE WHEN i < length THEN 1 ELSE 0 END), '') AS mask, (width + 3) // 4 AS frames FROM p")
def pad_batches(spark: SparkSession, d: str) -> DataFrame:
    out = V.padded(_turns(spark, d), "a", SIZE, "conv_id")
    mask = F.transform(C.prefix_mask(F.col("length"), F.col("width").cast("int")), lambda x: x.cast("int"))
    frames = C.conv_length(C.conv_length(F.col("width"), 3, 2, 1), 3, 2, 1)  # two stages of stride 2: ceil(width / 4)
    return out.select("conv_id", "batch", "length", "width", F.array_join("a", ",").alias("padded"), F.array_join(mask, "").alias("mask"), frames.alias("frames"))


@query(f"WITH {_BATCH_SQL} SELECT batch, count(*) AS rows, max(length) AS width, round(sum(length) / (max(length) * count(*)), 6) AS valid_fraction FROM p GROUP BY batch")
def batch_summary(spark: SparkSession, d: str) -> DataFrame:
    out = V.padded(_turns(spark, d), "a", SIZE, "conv_id")
    return out.groupBy("batch").agg(F.count("*").alias("rows"), F.max("length").alias("width"), F.round(F.sum("length") / (F.max("length") * F.count("*")), 6).alias("valid_fraction"))


_PAIR_SQL = r"""t AS (SELECT conv_id, turn, role, len(list_filter(regexp_split_to_array(text, '[ \n\t]+'), lambda w: w <> '')) AS n FROM conversations
), c AS (SELECT conv_id, coalesce(list(n ORDER BY turn, n) FILTER (role = 'user'), []) AS asked, coalesce(list(n ORDER BY turn, n) FILTER (role = 'assistant'), []) AS said FROM t GROUP BY conv_id
), b AS (SELECT *, (row_number() OVER (ORDER BY conv_id) - 1) // 16 AS batch FROM c), p AS (SELECT *, max(len(asked)) OVER (PARTITION BY batch) AS aw, max(len(said)) OVER (PARTITION BY batch) AS sw FROM b)"""
_FILLED = "array_to_string(list_concat({0}, list_transform(range(0, {1} - len({0})), lambda i: -1)), ',')"
_MASK = "array_to_string(list_transform(range(0, {1}), lambda i: CASE WHEN i < len({0}) THEN 1 ELSE 0 END), '')"


@query(f"WITH {_PAIR_SQL} SELECT conv_id, batch, len(asked) AS asked_length, aw AS asked_width, {_FILLED.format('asked', 'aw')} AS asked, {_MASK.format('asked', 'aw')} AS asked_mask, len(said) AS said_length, sw AS said_width, {_FILLED.format('said', 'sw')} AS said, {_MASK.format('said', 'sw')} AS said_mask FROM p")
def pad_pairs(spark: SparkSession, d: str) -> DataFrame:
    """Batches of conversations with two ragged arrays, the words of questions and of answers, each padded with a mask of its own."""
    n = table(spark, d, "conversations").select("conv_id", "turn", "role", F.size(C.words(F.col("text"))).alias("n"))
    of = lambda role: F.transform(F.array_sort(F.collect_list(F.when(F.col("role") == role, F.struct("turn", "n")))), lambda x: x["n"])
    lists = n.groupBy("conv_id").agg(of("user").alias("asked"), of("assistant").alias("said"))
    out = V.padded_together(lists, ["asked", "said"], SIZE, "conv_id")
    mask = lambda c: F.array_join(F.transform(f"{c}_mask", lambda x: x.cast("int")), "").alias(f"{c}_mask")
    return out.select("conv_id", "batch", *[x for c in ("asked", "said") for x in (f"{c}_length", f"{c}_width", F.array_join(c, ",").alias(c), mask(c))])
