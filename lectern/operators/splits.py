"""Groups of equal texts, label totals, rarity, stratified folds, document frequency by role, eligibility, audits."""

from __future__ import annotations

from collections.abc import Iterator

from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from lectern.functions.common import checkpointed, dense_index

#: Weights of the fold objective: label occurrences, label groups, size.
OCCURRENCE, GROUP, SIZE = 0.1, 0.9, 0.25
#: Thresholds of document frequency in (train, validation, test).
THRESHOLDS = {"1_1_1": (1, 1, 1), "10_3_3": (10, 3, 3), "20_5_5": (20, 5, 5)}


def label_counts(labels: DataFrame) -> DataFrame:
    """group_id, label, n: how often each group has each label; from rows (group_id, label)."""
    return labels.groupBy("group_id", "label").agg(F.count("*").alias("n"))


def totals_of(counts: DataFrame) -> DataFrame:
    """label, total occurrences, total groups; from label_counts."""
    return counts.groupBy("label").agg(F.sum("n").alias("total"), F.count("*").alias("group_total"))


def label_totals(labels: DataFrame) -> DataFrame:
    return totals_of(label_counts(labels))


def rarity_of(counts: DataFrame) -> DataFrame:
    """group_id, rarity, label (its rarest); from label_counts, in one join and one aggregate."""
    share = OCCURRENCE * F.sum(F.col("n") / F.col("total")) + GROUP * F.sum(1.0 / F.col("group_total"))
    return counts.join(totals_of(counts), "label").groupBy("group_id").agg(F.round(share, 6).alias("rarity"), F.min(F.struct("group_total", "label"))["label"].alias("label"))


def rarity(labels: DataFrame) -> DataFrame:
    """group_id, rarity: rare labels make a group come first."""
    return rarity_of(label_counts(labels)).drop("label")


def deal(groups: DataFrame, labels: DataFrame, k: int, inner: int) -> DataFrame:
    """group_id, rarity, size, fold, inner_fold, label (the rarest): groups of each rarest label are dealt in turn, rare and large ones first.

    A group without any label is dealt under the label "none", so no group is lost; group_id must not be null. Places are numbered
    by ranges of (label, rarity, size, group), so a label that holds very many groups is no one task's."""
    counts = checkpointed(label_counts(labels))  # read for totals and for groups
    dealt = groups.select("group_id", "size").join(rarity_of(counts), "group_id", "left")
    keys = dealt.select(F.coalesce("label", F.lit("none")).alias("label"), (-F.coalesce("rarity", F.lit(0.0))).alias("down"), (-F.col("size")).alias("less"), "group_id")
    placed = checkpointed(dense_index(keys, ["label", "down", "less", "group_id"], "place"))
    heads = placed.groupBy("label").agg(F.min("place").alias("first")).withColumn("label_rank", F.row_number().over(Window.orderBy("label")) - 1)  # a row for each label
    at = F.col("place") - F.col("first")
    fold, inner_fold = (at + F.col("label_rank")) % k, (F.floor(at / k) + F.col("label_rank")) % inner
    return placed.join(heads, "label").select("group_id", (0.0 - F.col("down")).alias("rarity"), (-F.col("less")).alias("size"), fold.cast("int").alias("fold"), inner_fold.cast("int").alias("inner_fold"), "label")


ROLES = ("train", "validation", "test")


def role(i: int | Column, inner: int) -> Column:
    """Place in ROLES of a group with fold and inner_fold in outer fold i: test in its own fold, validation by the inner fold, else train."""
    return F.when(F.col("fold") == i, 2).when(F.col("inner_fold") == i % inner, 1).otherwise(0)


def role_codes(members: DataFrame, dealt: DataFrame, k: int, inner: int) -> DataFrame:
    """doc_id, grp, size, roles of members (doc_id, group_id); dealt also has grp, a number for the group. roles: the places in ROLES in the k outer folds as the digits of one number (base 3, fold 0 lowest)."""
    code = sum((role(i, inner) * len(ROLES) ** i for i in range(1, k)), role(0, inner))
    return members.join(dealt.select("group_id", "grp", "size", code.cast("long").alias("roles")), "group_id").select("doc_id", "grp", "size", "roles")


def nested_roles(members: DataFrame, dealt: DataFrame, k: int, inner: int) -> DataFrame:
    """members x k outer folds with role."""
    names = F.array(*[F.element_at(F.array(*map(F.lit, ROLES)), role(i, inner) + 1) for i in range(k)])
    rows = members.join(dealt.select("group_id", names.alias("roles")), "group_id")  # a row for each group is made before members meet it
    return rows.select(*members.columns, F.posexplode("roles").alias("outer_fold", "role"))


def words_by_tag(members: DataFrame, tag: str) -> DataFrame:
    """keyword, tag, n, g: sentences and groups with each word, by a tag that is the same in all of a group. members: a row for each
    sentence with grp, size (of the group), tag and keywords (its distinct words).

    Only a group of several sentences could count a word twice, so only there groups are told apart; all other words are counted before they are shuffled."""
    each = members.select(tag, F.when(F.col("size") > 1, F.col("grp")).alias("_grp"), (F.col("size") > 1).alias("_many"), F.explode("keywords").alias("keyword"))
    by_group = each.groupBy("keyword", tag, "_many", "_grp").agg(F.count("*").alias("n"))
    return by_group.groupBy("keyword", tag).agg(F.sum("n").alias("n"), F.sum(F.when(F.col("_many"), 1).otherwise(F.col("n"))).alias("g"))


def df_by_role(members: DataFrame, k: int, least: int) -> DataFrame:
    """outer_fold, keyword, df and the sentence and group document frequency of each word in each role, zeros included,
    for words of at least so many sentences.

    members: those of words_by_tag, with roles (of role_codes). The counts of the few role codes that there are make all folds and roles, so
    nothing is multiplied by folds."""
    by_code = words_by_tag(members, "roles")
    at = lambda i, r: F.floor(F.col("roles") / len(ROLES) ** i) % len(ROLES) == r
    counts = [F.sum(F.when(at(i, r), F.col(c)).otherwise(0)).alias(f"{c}_{i}_{r}") for i in range(k) for r in range(len(ROLES)) for c in ("n", "g")]
    flat = by_code.groupBy("keyword").agg(F.sum("n").alias("df"), *counts).where(F.col("df") >= least)
    row = lambda i: F.struct(F.lit(i).alias("outer_fold"), *[F.col(f"{c}_{i}_{j}").alias(f"{r}_{name}") for c, name in (("n", "df"), ("g", "group_df")) for j, r in enumerate(ROLES)])
    return flat.select("keyword", "df", F.inline(F.array(*[row(i) for i in range(k)])))


def eligibility(counts: DataFrame) -> DataFrame:
    """counts (every fold x keyword, with zeros) with a flag for each threshold on both counts."""
    flags = []
    for what in ("df", "group_df"):
        for name, least in THRESHOLDS.items():
            ok = [F.col(f"{r}_{what}") >= n for r, n in zip(("train", "validation", "test"), least, strict=True)]
            flags.append((ok[0] & ok[1] & ok[2]).alias(f"eligible_{what}_{name}"))
    return counts.select("*", *flags)


def objective(assigned: DataFrame, labels: DataFrame, k: int) -> DataFrame:
    """Squared relative deviation from equal folds: (restart, objective); assigned: restart, group_id, size, fold."""
    each = labels.groupBy("group_id", "label").agg(F.count("*").alias("n"))
    totals = label_totals(labels)
    held = assigned.join(each, "group_id").groupBy("restart", "fold", "label").agg(F.sum("n").alias("n"), F.count("*").alias("g"))
    cells = assigned.select("restart").distinct().crossJoin(F.broadcast(totals)).withColumn("fold", F.explode(F.sequence(F.lit(0), F.lit(k - 1))))
    full = cells.join(held, ["restart", "fold", "label"], "left").na.fill(0)
    off = lambda have, want: F.pow((have - want / k) / F.greatest(want / k, F.lit(1.0)), F.lit(2.0))
    by_label = full.groupBy("restart").agg((OCCURRENCE * F.avg(off(F.col("n"), F.col("total"))) * k + GROUP * F.avg(off(F.col("g"), F.col("group_total"))) * k).alias("labels"))
    sizes = assigned.groupBy("restart", "fold").agg(F.sum("size").alias("have"))
    every = Window.partitionBy("restart")
    by_size = sizes.withColumn("want", F.sum("have").over(every)).groupBy("restart").agg(F.sum(off(F.col("have"), F.col("want"))).alias("size_cost"))
    return by_label.join(by_size, "restart").select("restart", F.round(F.col("labels") + SIZE * F.col("size_cost"), 6).alias("objective"))


def role_atomic(folds: DataFrame) -> DataFrame:
    """(fold, group) whose members stand in more than one role."""
    return folds.groupBy("outer_fold", "group_id").agg(F.countDistinct("role").alias("roles")).where("roles > 1")


def tested_once(folds: DataFrame) -> DataFrame:
    """Sentences that are not tested in exactly one fold."""
    return folds.groupBy("doc_id").agg(F.count_if(F.col("role") == "test").alias("tested")).where("tested <> 1")


def union_all(frames: Iterator[DataFrame]) -> DataFrame:
    every = None
    for f in frames:
        every = f if every is None else every.unionByName(f)
    return every


def check(name: str, violations: DataFrame) -> DataFrame:
    """One row: the check's name and the number of violating rows."""
    return violations.groupBy().agg(F.count("*").alias("violations")).select(F.lit(name).alias("check_name"), "violations")


