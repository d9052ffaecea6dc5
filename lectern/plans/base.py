"""The register of queries, and the tables that several of them share (see the module docs for their roles)."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
SQL: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a function (spark, sf_dir) under its name, with its SQL if there is any."""

    def put(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql:
            SQL[f.__name__] = sql
        return f

    return put


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# ---- views, occurrences, groups, keywords ---------------------------------------------------------------------

KEYWORDS_SQL = "kw AS (SELECT c_mktsegment AS keyword, CAST(row_number() OVER (ORDER BY c_mktsegment) - 1 AS INTEGER) AS kw_idx FROM (SELECT DISTINCT c_mktsegment FROM customer))"
VIEWS_SQL = KEYWORDS_SQL + """, unit AS (SELECT o_orderkey AS occ, c_custkey AS grp, c_mktsegment AS segment FROM orders JOIN customer ON o_custkey = c_custkey
), v AS (SELECT l_orderkey AS occ, grp, l_partkey AS pk, l_suppkey AS sk, kw_idx, ((l_partkey * 7 + l_suppkey * 13 + kw_idx * 29) % 1000) / 1000.0 AS score, CAST(segment = keyword AS INTEGER) AS label
  FROM lineitem JOIN unit ON l_orderkey = occ CROSS JOIN kw)"""
OCC_SQL = VIEWS_SQL + """, occ AS (SELECT occ, kw_idx, round(avg(score) + 1e-9, 6) AS score, max(label) AS label, count(*) AS members, min(grp) AS grp FROM v GROUP BY occ, kw_idx)"""
GRP_SQL = OCC_SQL + """, g AS (SELECT grp, kw_idx, round(avg(score) + 1e-9, 6) AS score, max(label) AS label, count(*) AS members FROM occ GROUP BY grp, kw_idx)"""


def keywords(spark: SparkSession, d: str) -> DataFrame:
    """keyword, kw_idx (place in sorted order): a handful of segments."""
    from lectern.functions.common import dense_index

    return dense_index(table(spark, d, "customer").select(F.col("c_mktsegment").alias("keyword")), ["keyword"], "kw_idx").withColumn("kw_idx", F.col("kw_idx").cast("int"))


def views(spark: SparkSession, d: str) -> DataFrame:
    """A row for each (view, keyword): occ, grp, pk, sk, kw_idx, score, label. The keyword table is a few rows."""
    units = table(spark, d, "orders").join(table(spark, d, "customer"), F.col("o_custkey") == F.col("c_custkey"))
    units = units.select(F.col("o_orderkey").alias("occ"), F.col("c_custkey").alias("grp"), F.col("c_mktsegment").alias("segment"))
    lines = table(spark, d, "lineitem").select(F.col("l_orderkey").alias("occ"), F.col("l_partkey").alias("pk"), F.col("l_suppkey").alias("sk"))
    each = lines.join(units, "occ").crossJoin(F.broadcast(keywords(spark, d)))
    score = ((F.col("pk") * 7 + F.col("sk") * 13 + F.col("kw_idx") * 29) % 1000) / 1000.0
    return each.select("occ", "grp", "pk", "sk", "kw_idx", score.alias("score"), (F.col("segment") == F.col("keyword")).cast("int").alias("label"))


# ---- sentences, labels, folds ---------------------------------------------------------------------------------

K, INNER = 5, 8

LABELS_SQL = r"""sent AS (SELECT doc_id, lang, source, text, regexp_replace(text, '^[\t-\r\x1c-\x1f ]+|[\t-\r\x1c-\x1f ]+$', '', 'g') AS norm FROM documents
), s AS (SELECT doc_id, lang, source, text, norm, 'grp:' || coalesce(sha256(norm), 'none') AS group_id FROM sent
), sl AS (SELECT doc_id, group_id, 'lang=' || coalesce(lang, 'none') AS label FROM s UNION ALL SELECT doc_id, group_id, 'source=' || coalesce(source, 'none') FROM s
  UNION ALL SELECT s.doc_id, group_id, 'quality=' || coalesce(CAST(quality AS VARCHAR), 'none') FROM s JOIN labels l ON s.doc_id = l.doc_id UNION ALL SELECT s.doc_id, group_id, 'toxic=' || coalesce(CAST(toxic AS VARCHAR), 'none') FROM s JOIN labels l ON s.doc_id = l.doc_id
), gl AS (SELECT group_id, label, count(*) AS n FROM sl GROUP BY group_id, label
), tot AS (SELECT label, CAST(sum(n) AS BIGINT) AS total, count(*) AS group_total FROM gl GROUP BY label
), gs AS (SELECT group_id, count(*) AS size, min(doc_id) AS first_id FROM s GROUP BY group_id
), rar AS (SELECT gl.group_id, round(0.1 * sum(n / total) + 0.9 * sum(1.0 / group_total), 6) AS rarity FROM gl JOIN tot USING (label) GROUP BY gl.group_id)"""
FOLDS_SQL = LABELS_SQL + """, rare AS (SELECT group_id, label FROM (SELECT group_id, label, row_number() OVER (PARTITION BY group_id ORDER BY group_total, label) AS k FROM gl JOIN tot USING (label)) WHERE k = 1
), ranked AS (SELECT label, row_number() OVER (ORDER BY label) - 1 AS label_rank FROM (SELECT DISTINCT label FROM rare)
), deal AS (SELECT group_id, rarity, size, CAST((row_number() OVER (PARTITION BY label ORDER BY rarity DESC, size DESC, group_id) - 1 + label_rank) % 5 AS INTEGER) AS fold,
    CAST(((row_number() OVER (PARTITION BY label ORDER BY rarity DESC, size DESC, group_id) - 1) // 5 + label_rank) % 8 AS INTEGER) AS inner_fold
  FROM rare JOIN ranked USING (label) JOIN rar USING (group_id) JOIN gs USING (group_id)
), ks AS (SELECT unnest([0, 1, 2, 3, 4]) AS outer_fold
), folds AS (SELECT outer_fold, doc_id, s.group_id, CASE WHEN fold = outer_fold THEN 'test' WHEN inner_fold = outer_fold % 8 THEN 'validation' ELSE 'train' END AS role FROM s JOIN deal USING (group_id) CROSS JOIN ks)"""


def sentences(spark: SparkSession, d: str) -> DataFrame:
    """doc_id, group_id, lang, source of all documents; null texts are one group. Texts are normalised in one pass and left behind:
    queries that use the groups more than once write this table first (``written_sentences``).
    LABELS_SQL strips only, as DuckDB has no NFKC: it agrees where NFKC changes no text."""
    return sentences_of(table(spark, d, "documents"))


def sentences_of(docs: DataFrame) -> DataFrame:
    from lectern.functions.common import group_id, normalize_text

    return docs.select("doc_id", group_id(normalize_text(F.col("text"))).alias("group_id"), "lang", "source")


def written_sentences(spark: SparkSession, d: str) -> DataFrame:
    from lectern.functions.common import checkpointed

    return checkpointed(sentences(spark, d))


def sentence_labels(spark: SparkSession, d: str, s: DataFrame) -> DataFrame:
    """doc_id, group_id, label of written sentences: language and source for all (a null is "none"), quality and toxicity where they are marked."""
    marks = table(spark, d, "labels")
    names = [F.concat(F.lit(f"{c}="), F.coalesce(F.col(c).cast("string"), F.lit("none"))) for c in ("lang", "source", "quality", "toxic")]
    own = s.select("doc_id", "group_id", F.explode(F.array(*names[:2])).alias("label"))
    marked = s.join(marks, "doc_id").select("doc_id", "group_id", F.explode(F.array(*names[2:])).alias("label"))
    return own.unionByName(marked)


def order_views(spark: SparkSession, d: str) -> DataFrame:
    """Views of orders: occ and n_samples."""
    return table(spark, d, "lineitem").select(F.col("l_orderkey").alias("occ"), F.col("l_quantity").cast("long").alias("n_samples"))
