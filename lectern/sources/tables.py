"""Typed sources and sinks: CSV tables with fixed schemas, vector stores, prototype banks, fold tables, metric logs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from lectern.functions import common as C
from lectern.operators import protocol as P
from lectern.operators import quality as Q

from . import store

#: The columns of the given files.
LEXICON = "rank int, keyword_id string, surface_form string, canonical_concept string, semantic_categories string, story_local_flag string, include_core string, include_main string, include_extended string"
SENTENCES = (
    "text_embedding_idx int, text string, segmented_words string, token_count int, is_chapter_heading string, chapter int, story_quartile int, "
    "present_keyword_ids string, core_keyword_ids string, main_keyword_ids string, extended_keyword_ids string, keyword_count_all int"
)
VIEWS = (
    "subject string, session string, task string, run int, local_row_idx int, global_row_idx int, text_embedding_idx int, start_time double, stop_time double, "
    "sfreq double, start_sample int, stop_sample int, n_samples int, eeg_vhdr_path string, events_tsv_path string"
)
FOLDS = "protocol_version string, seed int, outer_fold int, role string, text_embedding_idx int, sentence_group_id string, normalized_text_sha256 string, chapter int, story_quartile int, token_count int"
#: Bytes of one file beyond which file_sha256 refuses: a file is one row.
LARGEST_FILE = 1 << 30


def _csv(spark: SparkSession, path: str, schema: str) -> DataFrame:
    """Malformed rows fail the read; nothing is inferred; a byte order mark goes with the header."""
    return spark.read.schema(schema).csv(path, header=True, mode="FAILFAST", multiLine=True, escape='"')


def _flags(df: DataFrame, *names: str) -> DataFrame:
    return df.withColumns({n: C.flag(F.col(n)) for n in names})


def read_lexicon(spark: SparkSession, path: str) -> DataFrame:
    return _flags(_csv(spark, path, LEXICON), "story_local_flag", "include_core", "include_main", "include_extended").withColumn("keyword_idx", F.col("rank") - 1)


def read_sentences(spark: SparkSession, path: str) -> DataFrame:
    lists = ("segmented_words", "present_keyword_ids", "core_keyword_ids", "main_keyword_ids", "extended_keyword_ids")
    df = _flags(_csv(spark, path, SENTENCES), "is_chapter_heading")
    return df.withColumns({n: C.pipe_list(F.coalesce(n, F.lit(""))) for n in lists})


def valid_sentences(sentences: DataFrame) -> DataFrame:
    """Sentences that are no headings and have words, with the hash of their normalised text and their group's id."""
    ok = sentences.where(~F.col("is_chapter_heading") & (F.col("token_count") > 0))
    text = C.normalize_text(F.col("text"))
    return ok.withColumn("normalized_text_sha256", C.text_sha256(text)).withColumn("sentence_group_id", C.group_id(text))


def read_views(spark: SparkSession, path: str) -> DataFrame:
    df = _csv(spark, path, VIEWS)
    ids = C.view_id(F.col("subject"), F.col("session"), F.col("task"), F.col("run"), F.col("local_row_idx"))
    return df.withColumn("view_id", ids).withColumn("sentence_occurrence_id", F.concat(F.lit("occ:"), F.col("text_embedding_idx").cast("string")))


def read_folds(spark: SparkSession, path: str) -> DataFrame:
    return _csv(spark, path, FOLDS)


def view_faults(views: DataFrame) -> DataFrame:
    """Windows that are empty, miscounted or without a rate, and repeated view ids."""
    ok = (F.col("stop_sample") > F.col("start_sample")) & (F.col("n_samples") == F.col("stop_sample") - F.col("start_sample")) & (F.col("sfreq") > 0)
    twice = views.join(Q.repeated_keys(views, "view_id").select("view_id"), "view_id", "left_semi").select(*views.columns)
    return Q.rows_where(views, ~ok).unionByName(twice)


def write_folds(folds: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Partitioned by fold, so that a reader of one fold reads no other. Returns one provenance row."""
    folds.write.mode(mode).partitionBy("outer_fold").parquet(path)
    return Q.fingerprint(folds, "folds")


def write_protocol(folds: DataFrame, eligibility: DataFrame, path: str, mode: str = "errorifexists") -> DataFrame:
    """Folds and eligibility, partitioned by fold. Returns one provenance row: fingerprints, rows by role, groups, repeated
    groups and the largest group. folds: outer_fold, role, doc_id, group_id."""
    for name, df in (("folds", folds), ("eligibility", eligibility)):
        df.write.mode(mode).partitionBy("outer_fold").parquet(f"{path}/{name}")
    roles = folds.groupBy("role").agg(F.count("*").alias("n")).agg(F.map_from_entries(F.array_sort(F.collect_list(F.struct("role", "n")))).alias("role_rows"))
    groups = folds.select("doc_id", "group_id").distinct().groupBy("group_id").agg(F.count("*").alias("n"))
    groups = groups.agg(F.count("*").alias("groups"), F.count_if(F.col("n") > 1).alias("repeated_groups"), F.max("n").alias("largest_group"))
    prints = [Q.fingerprint(df, name).select(F.struct("n", "xor_hash", "sum_hash", "schema_hash").alias(name)) for name, df in (("folds", folds), ("eligibility", eligibility))]
    return roles.crossJoin(groups).crossJoin(prints[0]).crossJoin(prints[1])  # one row each


def read_eligibility(spark: SparkSession, path: str, outer_fold: int, index: DataFrame) -> DataFrame:
    """Eligibility of one fold with the keywords' indexes, in their order (a keyword the index lacks is an error).
    index: keyword, keyword_idx."""
    rows = spark.read.parquet(f"{path}/eligibility").where(F.col("outer_fold") == outer_fold)
    return P.lookup(rows, index, ["keyword"], "keyword_idx").orderBy("keyword_idx")


def write_occurrences(occurrences: DataFrame, excluded: DataFrame, path: str) -> DataFrame:
    """The word occurrences, sorted by sentence within ranges, and one provenance row: fingerprint, counts, excluded ids.
    occurrences: sentence, position, ...; excluded: sentence (a bounded list of headings and empty sentences)."""
    occurrences.repartitionByRange("sentence").sortWithinPartitions("sentence", "position").write.mode("errorifexists").parquet(path)
    gone = excluded.agg(F.sort_array(F.collect_set("sentence")).alias("excluded"))
    sentences = occurrences.agg(F.countDistinct("sentence").alias("sentences"))
    return Q.fingerprint(occurrences, "occurrences").crossJoin(sentences).crossJoin(gone)  # one row each


def write_identities(dims: dict[str, DataFrame], path: str) -> DataFrame:
    """The dimensions of identities (surfaces, context tokens, groups), a committed table each; returns a fingerprint for each."""
    rows = None
    for name, df in sorted(dims.items()):
        store.write(df, f"{path}/{name}", {"dimension": name})
        one = Q.fingerprint(df, name)
        rows = one if rows is None else rows.unionByName(one)
    return rows


def fold_faults(folds: DataFrame, k: int) -> dict[str, DataFrame]:
    """The audits of a fold table (outer_fold, doc_id, group_id, role), by what they find."""
    by_doc = folds.groupBy("doc_id").agg(
        F.count("*").alias("n"), F.countDistinct("outer_fold").alias("folds"), F.count_if(F.col("role") == "test").alias("tested"), (F.min("group_id") != F.max("group_id")).alias("moved"),
        F.count_if(~F.coalesce(F.col("role").isin("train", "validation", "test"), F.lit(False))).alias("odd"), F.min("outer_fold").alias("lo"), F.max("outer_fold").alias("hi"),
    )
    group_roles = folds.groupBy("outer_fold", "group_id").agg(F.countDistinct("role").alias("roles"))
    return {
        "rows": by_doc.where((F.col("n") != k) | (F.col("folds") != k) | (F.col("lo") != 0) | (F.col("hi") != k - 1)), "tested": by_doc.where("tested <> 1"), "group": by_doc.where("moved"), "role": by_doc.where("odd > 0"),
        "group in two roles": group_roles.where("roles > 1"),
    }


def read_audited_folds(spark: SparkSession, path: str, k: int) -> DataFrame:
    """A fold table as write_folds left it, if its audits find nothing: every document in every fold once, tested once, in one group with
    one role in each fold, and no other role than the three; else an error that says what they found."""
    folds = spark.read.parquet(path)
    Q.require(fold_faults(folds, k))
    return folds


def read_fold(spark: SparkSession, path: str, outer_fold: int) -> DataFrame:
    return spark.read.parquet(path).where(F.col("outer_fold") == outer_fold)


def write_vectors(vectors: DataFrame, path: str, overwrite: bool = False, provenance: dict[str, str] | None = None) -> dict:
    """A row a word, sorted by sentence over all files, committed with its provenance; returns the manifest."""
    return store.write(vectors, path, provenance or {}, ["sentence", "position"], overwrite)


def sentence_vectors(spark: SparkSession, path: str, sentence: int, expected: dict[str, str] | None = None) -> DataFrame:
    """The vectors of one sentence, from the files that can hold it; refused if the store's provenance is another than expected, or
    says that it depends on folds, roles or signals."""
    return store.read(spark, path, expected, ("fold", "role", "signal"), sentence)


def write_prototypes(prototypes: DataFrame, path: str, provenance: dict[str, str]) -> None:
    """With the provenance in every row, so that a reader can refuse a stale bank."""
    said = F.struct(*[F.lit(v).alias(k) for k, v in sorted(provenance.items())])
    prototypes.withColumn("provenance", said).write.mode("errorifexists").parquet(path)


def read_prototypes(spark: SparkSession, path: str, expected: dict[str, str]) -> DataFrame:
    """The bank, if its provenance has every expected value; else an error."""
    df = spark.read.parquet(path)
    wrong = [F.col(f"provenance.{k}") != v for k, v in expected.items()]
    for k, bad in zip(expected, wrong, strict=True):
        if not df.where(F.coalesce(bad, F.lit(True))).isEmpty():
            raise ValueError(f"stale prototypes: {k}")
    return df.drop("provenance")


def append_events(events: DataFrame, path: str) -> None:
    events.write.mode("append").json(path)


def file_sha256(spark: SparkSession, pattern: str) -> DataFrame:
    """path, length, sha256 of each file."""
    files = spark.read.format("binaryFile").load(pattern)
    checked = files.withColumn("content", F.when(F.col("length") > LARGEST_FILE, F.raise_error(F.lit("file too large for one row"))).otherwise(F.col("content")))
    return checked.select("path", "length", F.sha2("content", 256).alias("sha256"))
