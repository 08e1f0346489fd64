"""The training-data pipeline: five stages over ``documents``, each written as Parquet and read again.

Every stage takes (spark, docs, sf_dir) and returns the rows it keeps with the
columns of ``documents``; the last adds the keep probability. Stages judge rows,
told apart by a key: rows without an id and rows that share one are documents
like others. An empty table gives an empty table at every stage.
"""

from __future__ import annotations

from pyspark.errors import AnalysisException
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from swardshift.llm import decontaminate, line_crf, line_neighbours, lsh_forest, raking
from swardshift.llm.queries import KEEP_SHARE, SWEEPS, TEMPER, mixing_margins
from swardshift.stages import write_stage

#: Hundredths of Jaccard similarity at which two documents are one.
NEAR_PERCENT = 80
#: Tells rows apart whose ids are missing or repeat.
ROW = "__row"


def _numbered(docs: DataFrame) -> DataFrame:
    """``docs`` with a key for each row, the same whenever it is read: its file and its place there.

    Tables that are no files are written first, with a number for each row.
    """
    try:
        place = [F.xxhash64("_metadata.file_path").alias("file"), F.col("_metadata.row_index").alias("at")]
        return docs.select("*", F.struct(*place).alias(ROW))
    except AnalysisException:
        return write_stage(docs.withColumn(ROW, F.struct(F.lit(0).cast("long").alias("file"), F.monotonically_increasing_id().alias("at"))), "rows")


def _without(rows: DataFrame, gone: DataFrame) -> DataFrame:
    """The rows whose key is not among ``gone`` (one column)."""
    gone = write_stage(gone, "gone").toDF("__gone")
    return rows.join(gone, rows[ROW] == gone["__gone"], "left_anti").drop(ROW)


def good_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose lines the trained field takes for bad go; texts without words are among them."""
    field = line_crf.train(docs, spark.read.parquet(f"{sf_dir}/labels.parquet"))
    scored = line_crf.with_scores(docs, field, score="__score")
    return scored.where(F.col("__score") >= line_crf.THRESHOLD).select(*docs.columns)


def line_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Take out lines that an earlier line repeats (within one edit); a document that loses all its words goes.

    Earlier is what has the smaller id, then the smaller row number.
    """
    words = r"[^\x20\x09-\x0D]"
    rows = _numbered(docs).withColumn("__key", F.struct("doc_id", ROW))
    rows = rows.withColumn("__had_words", F.coalesce(F.col("text").rlike(words), F.lit(False)))
    cleaned = line_neighbours.drop_lines(rows, line_neighbours.repeated_lines(rows, id="__key"), id="__key")
    kept = cleaned.where(~F.col("__had_words") | F.coalesce(F.col("text").rlike(words), F.lit(False)))
    if "n_chars" in docs.columns:
        kept = kept.withColumn("n_chars", F.when(F.col("text").isNull(), F.col("n_chars")).otherwise(F.length("text")).cast(docs.schema["n_chars"].dataType))
    return kept.select(*docs.columns)


def near_dedup(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near duplicates one document stays: that of the smallest id, those without an id last."""
    rows = _numbered(docs).withColumn(ROW, F.concat_ws(":", F.hex(F.col(ROW)["file"]), F.col(ROW)["at"].cast("string")))
    found = lsh_forest.near_duplicates(rows, id=ROW, percent=NEAR_PERCENT).where("component_id is not null and n_shingles > 0")
    named = write_stage(found.select(ROW, "component_id"), "near").join(rows.select(ROW, "doc_id"), ROW)
    order = F.struct(F.col("doc_id").isNull(), "doc_id", ROW)
    stay = named.groupBy("component_id").agg(F.min(order).alias("stay"), F.count(F.lit(1)).alias("size")).where("size > 1")
    gone = named.join(stay.select("component_id", F.col("stay")[ROW].alias("__stay")), "component_id").where(F.col(ROW) != F.col("__stay"))
    return _without(rows, gone.select(ROW))


def decontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents of whose words at least a twentieth lies in benchmark passages go."""
    rows = _numbered(docs)
    found = decontaminate.judge(decontaminate.find_occurrences(rows, spark.read.parquet(f"{sf_dir}/benchmark.parquet"), id=ROW))
    return _without(rows, found.where("contaminated").select(ROW))


def mixed(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Sample documents so that sources, languages and forms come near their target shares of the words, half of which stay.

    The draw follows from the id, for documents without one from the text.
    """
    draw = F.coalesce(F.col("doc_id").cast("string"), F.concat(F.lit("null "), F.md5(F.coalesce("text", F.lit("")).cast("binary"))))
    rows = _numbered(docs)
    return raking.sample_documents(rows, mixing_margins(), row=ROW, temper=TEMPER, sweeps=SWEEPS, keep_share=KEEP_SHARE, draw=draw).drop(ROW)


STAGES = [
    ("quality classifier", good_quality),
    ("line dedup", line_dedup),
    ("MinHash near-dedup", near_dedup),
    ("benchmark decontamination", decontaminated),
    ("mixing sources to target weights", mixed),
]

#: The quality classifier is a trained model, which SQL cannot express; tests hold every stage against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over the whole ``documents`` table."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES:
        docs = write_stage(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return docs
