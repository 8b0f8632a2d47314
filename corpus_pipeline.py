"""The corpus pipeline: five stages over ``documents``, each written and read again.

Every stage takes (spark, docs, sf_dir) and returns a DataFrame.  All but the last keep
the columns of ``documents`` and drop others.  Stages work on rows, not on ids: unlike
documents that share an id all stay, and rows without an id are joined like others.
Null and empty texts are scored, joined with nothing, never contaminated, and encoded to
no token; an empty table passes every stage; texts of any length are taken whole.
"""

from __future__ import annotations

from uuid import uuid4

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from orrery.llm import bpe, decontaminate, jaccard, quality, secrets
from orrery.members import among
from orrery.session import delete, ensure_checkpoints, keep, scratch

COLUMNS = ("doc_id", "text", "lang", "source", "n_chars")


def keep_quality(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the classifier, fitted on the labelled ones, does not reject."""
    labels = spark.read.parquet(f"{sf_dir}/labels.parquet")
    sample = quality.training_rows(docs, labels, "quality", allowed=~quality.held_out(F.col("doc_id")))
    scored = quality.score(docs.select(*COLUMNS), quality.train(sample))
    return scored.where(F.col("score") >= 0.5).select(*COLUMNS)


def keep_one_of_each(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One document of every component of near copies: the least id's, rows without an id last.

    A row repeated as it is counts once; documents without words are in no component, and stay.
    """
    docs = docs.select(*COLUMNS).withColumn("key", jaccard.text_key(F.col("text")))
    worded = F.coalesce("text", F.lit("")).rlike(r"[^\x20\x09-\x0D]")
    found = keep(jaccard.join(docs.select("doc_id", "text")).select("id", "key", "n_links", "first"))
    # A row that links with none stays where it lies; the others, and few besides, are joined.
    linked = among(found.where("n_links > 0"), "id", "key")(F.col("doc_id").cast("long"), F.col("key"))
    marked = docs.withColumn("linked", worded & linked)
    first = found.where("first IS NOT NULL").select(F.col("first.id").alias("first_id"), F.col("first.key").alias("first_key")).distinct()
    kept = marked.where("linked").join(first, F.col("doc_id").eqNullSafe(F.col("first_id")) & (F.col("key") == F.col("first_key")), "left_semi")
    one = Window.partitionBy("doc_id", "key").orderBy("lang", "source", "n_chars")
    kept = kept.withColumn("place", F.row_number().over(one)).where("place = 1")
    return kept.select(*COLUMNS).unionByName(marked.where("NOT linked").select(*COLUMNS))


def keep_uncontaminated(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that the benchmark's windows do not contaminate, by the contract's rule."""
    found = decontaminate.scan(docs.select(*COLUMNS), spark.read.parquet(f"{sf_dir}/benchmark.parquet"))
    return found.where(~decontaminate.contaminated(decontaminate.n_hit(), F.col("n_words"))).select(*COLUMNS)


def redact_secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, with every secret replaced by a mark."""
    model = secrets.train(secrets.labelled_samples(spark, spark.read.parquet(f"{sf_dir}/benchmark.parquet")))
    found = secrets.scan(docs.select(*COLUMNS), model)
    return found.withColumn("text", secrets.redact(F.col("text"), F.col("spans"))).select(
        "doc_id", "text", "lang", "source", F.length("text").cast("long").alias("n_chars")
    )


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token ids of every text, and whether they decode to it."""
    coded = bpe.encode(docs.select(*COLUMNS), checked="identical")
    return coded.select("doc_id", "lang", "source", "n_chars", "n_tokens", "token_ids", "identical")


STAGES = [
    ("quality classifier", keep_quality),
    ("n-gram Jaccard join", keep_one_of_each),
    ("benchmark decontamination", keep_uncontaminated),
    ("secret scans", redact_secrets),
    ("BPE encoding and decoding", encode),
]

#: No SQL says what a fitted classifier rejects; tests compare with brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; each result lies in the checkpoint folder before the next begins.

    What a stage kept for itself is removed when its result is written, and a result when the next is.
    """
    ensure_checkpoints(spark)
    folder = f"{spark.sparkContext.getCheckpointDir()}/pipeline-{uuid4()}"
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for k, (_, stage) in enumerate(STAGES):
        with scratch(spark):
            stage(spark, docs, sf_dir).write.parquet(f"{folder}/{k}")
        docs = spark.read.parquet(f"{folder}/{k}")
        if k:
            delete(spark, f"{folder}/{k - 1}")
    return docs
