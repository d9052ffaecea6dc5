"""Evaluation: lineitem rows are views, orders occurrences, customers context groups, market segments keywords."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions.common import checkpointed
from lectern.operators import evaluate as E

from .base import GRP_SQL, OCC_SQL, VIEWS_SQL, keywords, query, views


@query(f"WITH {VIEWS_SQL} SELECT occ, grp, pk, sk, kw_idx, score, label FROM v")
def view_scores(spark: SparkSession, d: str) -> DataFrame:
    return views(spark, d)


@query(f"WITH {OCC_SQL} SELECT * FROM occ")
def rollup_view_occurrence(spark: SparkSession, d: str) -> DataFrame:
    return E.rollup(views(spark, d), "occ", carry=("grp",))


@query(f"WITH {GRP_SQL} SELECT * FROM g")
def rollup_occurrence_group(spark: SparkSession, d: str) -> DataFrame:
    return E.rollup(rollup_view_occurrence(spark, d), "grp")


@query(f"WITH {OCC_SQL}, x AS (SELECT occ AS unit, kw_idx, label FROM v UNION ALL SELECT grp, kw_idx, label FROM occ) SELECT kw_idx, count(*) AS conflicts FROM (SELECT unit, kw_idx FROM x GROUP BY unit, kw_idx HAVING min(label) <> max(label)) GROUP BY kw_idx")
def label_conflicts(spark: SparkSession, d: str) -> DataFrame:
    both = views(spark, d).select(F.col("occ").alias("unit"), "kw_idx", "label")
    both = both.unionByName(rollup_view_occurrence(spark, d).select(F.col("grp").alias("unit"), "kw_idx", "label"))
    return E.label_conflicts(both, "unit").groupBy("kw_idx").agg(F.count("*").alias("conflicts"))


def _ap_sql(source: str, keys: str) -> str:
    return f"""(SELECT {keys}, CAST(sum(pos) AS BIGINT) AS positives, CAST(sum(n) - sum(pos) AS BIGINT) AS negatives, CASE WHEN sum(pos) > 0 THEN round(sum(pos * cum_pos / cum_n) / sum(pos), 6) END AS ap FROM (
    SELECT {keys}, pos, n, sum(pos) OVER w AS cum_pos, sum(n) OVER w AS cum_n FROM (SELECT {keys}, score, sum(label) AS pos, count(*) AS n FROM {source} GROUP BY {keys}, score)
    WINDOW w AS (PARTITION BY {keys} ORDER BY score DESC ROWS UNBOUNDED PRECEDING)) GROUP BY {keys})"""


@query(f"WITH {GRP_SQL} SELECT * FROM {_ap_sql('g', 'kw_idx')}")
def average_precision(spark: SparkSession, d: str) -> DataFrame:
    return E.average_precision(rollup_occurrence_group(spark, d), ["kw_idx"])


LEVELS_SQL = f"""{GRP_SQL}, levels AS (SELECT 'view' AS level, kw_idx, score, label FROM v UNION ALL SELECT 'occurrence', kw_idx, score, label FROM occ UNION ALL SELECT 'group', kw_idx, score, label FROM g
), ap AS {_ap_sql('levels', 'level, kw_idx')}
, roles AS (SELECT kw_idx, count(*) FILTER (grp % 5 > 1) AS train, count(*) FILTER (grp % 5 = 1) AS validation, count(*) FILTER (grp % 5 = 0) AS test FROM g WHERE label = 1 GROUP BY kw_idx
), tiers AS (SELECT unnest(['core', 'main', 'extended', 'master']) AS tier, unnest([2, 3, 4, 5]) AS below
), rep AS (SELECT level, tier, kw_idx, ap, positives, negatives, kw_idx < below AS in_tier, coalesce(train >= 20 AND validation >= 5 AND test >= 5, false) AS eligible, coalesce(train >= 10, false) AS available
  FROM ap CROSS JOIN tiers LEFT JOIN roles USING (kw_idx)
), why AS (SELECT *, CASE WHEN NOT in_tier THEN 'outside_tier' WHEN NOT eligible THEN 'ineligible_group_20_5_5' WHEN NOT available THEN 'prototype_unavailable' WHEN positives = 0 THEN 'no_positive' WHEN negatives = 0 THEN 'no_negative' ELSE 'valid' END AS reason FROM rep)"""


def _report(spark: SparkSession, d: str) -> DataFrame:
    scored = views(spark, d)
    units = E.levels(scored, "occ", "grp").unionByName(scored.select(F.lit("view").alias("level"), F.col("occ").alias("key"), "kw_idx", "score", "label"))
    role, mine = F.col("key") % 5, (F.col("level") == "group") & (F.col("label") == 1)
    counts = {"train": role > 1, "validation": role == 1, "test": role == 0}
    ap = E.average_precision(units, ["level", "kw_idx"], {name: (mine & c).cast("int") for name, c in counts.items()})
    roles = ap.groupBy("kw_idx").agg(*[F.max(name).alias(name) for name in counts])  # other levels count none
    ap = ap.drop(*counts)
    tiers = F.explode(F.array(*[F.struct(F.lit(t).alias("tier"), F.lit(n).alias("below")) for t, n in (("core", 2), ("main", 3), ("extended", 4), ("master", 5))]))
    rep = ap.join(F.broadcast(roles), "kw_idx", "left").withColumn("t", tiers)  # one row a keyword
    no = F.lit(False)
    rep = rep.select(
        "level", "t.tier", "kw_idx", "ap", "positives", "negatives", (F.col("kw_idx") < F.col("t.below")).alias("in_tier"),
        F.coalesce((F.col("train") >= 20) & (F.col("validation") >= 5) & (F.col("test") >= 5), no).alias("eligible"), F.coalesce(F.col("train") >= 10, no).alias("available"),
    )
    return rep.withColumn("reason", E.reason(F.col("in_tier"), F.col("eligible"), F.col("available")))


@query(f"WITH {LEVELS_SQL} SELECT * FROM why")
def validity_reasons(spark: SparkSession, d: str) -> DataFrame:
    return _report(spark, d)


@query(f"WITH {LEVELS_SQL} SELECT level, tier, round(avg(ap) FILTER (reason = 'valid'), 6) AS macro_ap, count(*) FILTER (reason = 'valid') AS n_valid, count(*) FILTER (in_tier AND eligible) AS n_eligible, count(*) FILTER (in_tier) AS n_tier FROM why GROUP BY level, tier")
def macro_report(spark: SparkSession, d: str) -> DataFrame:
    return E.macro(_report(spark, d), ["level", "tier"])


@query(f"WITH {GRP_SQL}, r AS (SELECT grp, label, row_number() OVER (PARTITION BY grp ORDER BY score DESC, kw_idx) AS place FROM g), u AS (SELECT grp, sum(label) AS pos, sum(label) FILTER (place <= 1) AS h1, sum(label) FILTER (place <= 2) AS h2, sum(label) FILTER (place <= 3) AS h3, sum(label) FILTER (place <= 5) AS h5, sum(label) FILTER (place <= 10) AS h10 FROM r GROUP BY grp HAVING sum(label) > 0) SELECT count(*) AS n_units, round(avg(h1 / pos), 6) AS recall_1, round(avg(h2 / pos), 6) AS recall_2, round(avg(h3 / pos), 6) AS recall_3, round(avg(h5 / pos), 6) AS recall_5, round(avg(h10 / pos), 6) AS recall_10 FROM u")
def recall_at_k(spark: SparkSession, d: str) -> DataFrame:
    return E.recall_at(rollup_occurrence_group(spark, d), "grp", (1, 2, 3, 5, 10))


_AUC_SQL = """(SELECT {k}, round(sum(pos * (below + (n - pos) / 2)) / (sum(pos) * sum(n - pos)), 6) AS auc FROM (SELECT {k}, score, pos, n, coalesce(sum(n - pos) OVER (PARTITION BY {k} ORDER BY score ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS below
  FROM (SELECT {k}, score, sum(label) AS pos, count(*) AS n FROM {s} GROUP BY {k}, score)) GROUP BY {k} HAVING sum(pos) > 0 AND sum(n - pos) > 0)"""


@query(f"WITH {OCC_SQL}, b AS (SELECT kw_idx, least(members, 8) // 2 AS bin, score, label FROM occ) SELECT * FROM {_AUC_SQL.format(k='kw_idx, bin', s='b')}")
def matched_auc(spark: SparkSession, d: str) -> DataFrame:
    """AUC among occurrences of about the same length (number of views)."""
    occ = rollup_view_occurrence(spark, d).withColumn("bin", F.floor(F.least("members", F.lit(8)) / 2).cast("long"))
    return E.auc(occ, ["kw_idx", "bin"])


@query()
def bootstrap_ci(spark: SparkSession, d: str) -> DataFrame:
    return E.bootstrap(rollup_occurrence_group(spark, d), "grp", ["kw_idx"], 50)


@query(f"WITH {GRP_SQL}, prior AS (SELECT kw_idx, round(avg(label), 6) AS p FROM g WHERE grp % 5 > 1 GROUP BY kw_idx), m AS (SELECT grp, kw_idx, members, label FROM g WHERE grp % 5 = 0), z AS (SELECT 'frequency' AS baseline, m.kw_idx, p AS score, label FROM m JOIN prior USING (kw_idx) UNION ALL SELECT 'length', kw_idx, CAST(members AS DOUBLE), label FROM m) SELECT * FROM {_ap_sql('z', 'baseline, kw_idx')}")
def baseline_scores(spark: SparkSession, d: str) -> DataFrame:
    """AP of scores that know only a keyword's frequency in training groups, or a group's length."""
    grp = rollup_occurrence_group(spark, d)
    prior = grp.where(F.col("grp") % 5 > 1).groupBy("kw_idx").agg(F.round(F.avg("label"), 6).alias("score"))
    tested = grp.where(F.col("grp") % 5 == 0).select("kw_idx", "label", F.col("members").cast("double").alias("length"))
    both = tested.join(prior, "kw_idx").select(F.lit("frequency").alias("baseline"), "kw_idx", "score", "label")
    both = both.unionByName(tested.select(F.lit("length").alias("baseline"), "kw_idx", F.col("length").alias("score"), "label"))
    return E.average_precision(both, ["baseline", "kw_idx"])


@query(f"WITH {GRP_SQL}, u AS (SELECT grp % 5 AS fold, grp, kw_idx, score, label FROM g), c AS (SELECT grp, kw_idx, count(*) AS tested FROM u GROUP BY grp, kw_idx) SELECT kw_idx, count(*) AS n_units, CAST(sum(label) AS BIGINT) AS positives, round(avg(score), 6) AS mean_score, max(tested) AS most_tested, count(DISTINCT fold) AS n_folds FROM u JOIN c USING (grp, kw_idx) GROUP BY kw_idx")
def oof_union(spark: SparkSession, d: str) -> DataFrame:
    """Out-of-fold predictions of all folds in one table, each unit tested once."""
    grp = checkpointed(rollup_occurrence_group(spark, d))  # each fold reads it
    parts = [grp.where(F.col("grp") % 5 == k).withColumn("fold", F.lit(k)) for k in range(5)]
    every = parts[0]
    for p in parts[1:]:
        every = every.unionByName(p)
    tested = every.groupBy("grp", "kw_idx").agg(F.count("*").alias("tested"))
    return every.join(tested, ["grp", "kw_idx"]).groupBy("kw_idx").agg(
        F.count("*").alias("n_units"), F.sum("label").alias("positives"), F.round(F.avg("score"), 6).alias("mean_score"),
        F.max("tested").alias("most_tested"), F.countDistinct("fold").alias("n_folds"),
    )
