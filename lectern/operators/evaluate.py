"""Scores of views rolled up to occurrences and groups, tie-aware average precision, validity, macro reports."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

#: Added before rounding, so that means that end in a 5 round alike whatever the order of their sum.
TIE = 1e-9


def rollup(scores: DataFrame, unit: str, *, carry: tuple[str, ...] = ()) -> DataFrame:
    """Equal mean of the members' scores for each (unit, keyword), the label and the number of members."""
    keep = [F.min(c).alias(c) for c in carry]
    return scores.groupBy(unit, "kw_idx").agg(F.round(F.avg("score") + TIE, 6).alias("score"), F.max("label").alias("label"), F.count("*").alias("members"), *keep)


def label_conflicts(scores: DataFrame, unit: str) -> DataFrame:
    """(unit, keyword) whose members disagree about the label."""
    return scores.groupBy(unit, "kw_idx").agg(F.min("label").alias("lo"), F.max("label").alias("hi")).where("lo <> hi")


def average_precision(units: DataFrame, keys: list[str], sums: dict[str, Column] | None = None) -> DataFrame:
    """AP for each key over units (score, label 0/1): equal scores share a threshold. sums: more sums over the units."""
    more = {name: F.sum(c).alias(name) for name, c in (sums or {}).items()}
    tied = units.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"), *more.values())
    down = Window.partitionBy(*keys).orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = tied.withColumn("cum_pos", F.sum("pos").over(down)).withColumn("cum_n", F.sum("n").over(down))
    out = steps.groupBy(*keys).agg(
        F.sum("pos").alias("positives"), (F.sum("n") - F.sum("pos")).alias("negatives"), F.sum(F.col("pos") * F.col("cum_pos") / F.col("cum_n")).alias("raw"),
        *[F.sum(name).alias(name) for name in more],
    )
    return out.withColumn("ap", F.when(F.col("positives") > 0, F.round(F.col("raw") / F.when(F.col("positives") > 0, F.col("positives")), 6))).drop("raw")


def levels(views: DataFrame, unit: str, group: str) -> DataFrame:
    """level, key, kw_idx, score, label of occurrences and groups in one pass over the views: occurrences are rolled up, each
    then stands for itself and in its group, and both levels are averaged together."""
    occ = rollup(views, unit, carry=(group,))
    both = F.inline(F.array(F.struct(F.lit("occurrence").alias("level"), F.col(unit).alias("key")), F.struct(F.lit("group").alias("level"), F.col(group).alias("key"))))
    each = occ.select("kw_idx", "score", "label", both)
    return each.groupBy("level", "key", "kw_idx").agg(F.round(F.avg("score") + TIE, 6).alias("score"), F.max("label").alias("label"))


def reason(in_tier: Column, eligible: Column, available: Column) -> Column:
    """Why a keyword's AP does not count, in order of precedence."""
    return (
        F.when(~in_tier, "outside_tier").when(~eligible, "ineligible_group_20_5_5").when(~available, "prototype_unavailable")
        .when(F.col("positives") == 0, "no_positive").when(F.col("negatives") == 0, "no_negative").otherwise("valid")
    )


def macro(report: DataFrame, keys: list[str]) -> DataFrame:
    """Mean AP over valid keywords (null if none) with the counts of valid, eligible and tier keywords."""
    valid = F.col("reason") == "valid"
    return report.groupBy(*keys).agg(
        F.round(F.avg(F.when(valid, F.col("ap"))), 6).alias("macro_ap"), F.count_if(valid).alias("n_valid"),
        F.count_if(F.col("in_tier") & F.col("eligible")).alias("n_eligible"), F.count_if("in_tier").alias("n_tier"),
    )


def recall_at(units: DataFrame, unit: str, ks: tuple[int, ...]) -> DataFrame:
    """Mean over units with a positive keyword of the share of positives among the k best scores (ties by keyword)."""
    place = F.row_number().over(Window.partitionBy(unit).orderBy(F.col("score").desc(), "kw_idx"))
    ranked = units.withColumn("place", place)
    hits = [F.sum(F.when(F.col("place") <= k, F.col("label")).otherwise(0)).alias(f"h{k}") for k in ks]
    per_unit = ranked.groupBy(unit).agg(F.sum("label").alias("pos"), *hits).where("pos > 0")
    return per_unit.agg(F.count("*").alias("n_units"), *[F.round(F.avg(F.col(f"h{k}") / F.col("pos")), 6).alias(f"recall_{k}") for k in ks])


def auc(units: DataFrame, keys: list[str]) -> DataFrame:
    """Rank-sum AUC for each key; equal scores count half."""
    tied = units.groupBy(*keys, "score").agg(F.sum("label").alias("pos"), F.count("*").alias("n"))
    up = Window.partitionBy(*keys).orderBy("score").rowsBetween(Window.unboundedPreceding, -1)
    below = F.coalesce(F.sum(F.col("n") - F.col("pos")).over(up), F.lit(0))
    won = tied.withColumn("won", F.col("pos") * (below + (F.col("n") - F.col("pos")) / 2))
    out = won.groupBy(*keys).agg(F.sum("won").alias("won"), F.sum("pos").alias("p"), F.sum(F.col("n") - F.col("pos")).alias("q"))
    return out.where("p > 0 and q > 0").select(*keys, F.round(F.col("won") / (F.col("p") * F.col("q")), 6).alias("auc"))


def bootstrap(units: DataFrame, unit: str, keys: list[str], replicates: int) -> DataFrame:
    """Percentile interval of AP by key over replicates in which each unit weighs a Poisson(1) draw from its hash."""
    # cumulative Poisson(1) probabilities
    draw = F.pmod(F.xxhash64(unit, "replicate"), F.lit(1 << 30)) / (1 << 30)
    weight = sum((F.when(draw >= p, 1).otherwise(0) for p in (0.36787944, 0.73575888, 0.91969860, 0.98101184, 0.99634015, 0.99940582)), F.lit(0))
    drawn = units.withColumn("replicate", F.explode(F.sequence(F.lit(1), F.lit(replicates)))).withColumn("w", weight).where("w > 0")
    tied = drawn.groupBy(*keys, "replicate", "score").agg(F.sum(F.col("w") * F.col("label")).alias("pos"), F.sum("w").alias("n"))
    down = Window.partitionBy(*keys, "replicate").orderBy(F.col("score").desc()).rowsBetween(Window.unboundedPreceding, 0)
    steps = tied.withColumn("step", F.col("pos") * F.sum("pos").over(down) / F.sum("n").over(down))
    each = steps.groupBy(*keys, "replicate").agg((F.sum("step") / F.sum("pos")).alias("ap"))
    return each.groupBy(*keys).agg(F.round(F.percentile("ap", F.lit(0.025)), 6).alias("low"), F.round(F.percentile("ap", F.lit(0.975)), 6).alias("high"), F.count("*").alias("replicates"))
