"""A corpus pipeline: toxicity, near-duplicates, decontamination, personal data, tokens.

Each stage is a function of (spark, docs, sf_dir); docs has the columns of
`documents`, and every stage but the last returns them again.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from sparkloom.llm import bpe, decontamination, minhash, pii, toxicity
from sparkloom.llm.common import removed, table, written

COLUMNS = ["doc_id", "text", "lang", "source", "n_chars"]
TOXIC = 0.3


def drop_toxic(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents whose toxicity score is below TOXIC; null and empty texts are clean."""
    model = toxicity.fitted(docs, table(spark, sf_dir, "labels"))
    return toxicity.score_toxicity(docs, model, keep=COLUMNS).filter(F.col("toxicity") < TOXIC).select(*COLUMNS)


def drop_near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """One row of each near-duplicate group, the one of the least id; rows without words or alone in their group all stay.

    Rows are told apart by a number of their own, as ids may be null or repeat.
    A null id comes after all others; of equal ids any one row is the one.
    """
    # The numbers hold only once they are written.
    rows = written(docs.select(*COLUMNS, F.monotonically_increasing_id().alias("row_no")), "rows")
    found = minhash.near_duplicates(rows, "row_no").filter("n_shingles > 0").select(F.col("id").alias("row_no"), "component_id")
    named = written(found.join(rows.select("row_no", "doc_id"), "row_no"), "named")
    first = F.min(F.struct(F.col("doc_id").isNull().alias("last"), "doc_id", "row_no"))
    stay = named.groupBy("component_id").agg(first.alias("first")).select("first.row_no")
    gone = written(named.select("row_no").join(stay, "row_no", "left_anti"), "gone")
    removed(named)
    return rows.join(gone, "row_no", "left_anti").select(*COLUMNS)


def drop_leaks(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents without a benchmark item within its error budget."""
    found = decontamination.find_leaks(docs, table(spark, sf_dir, "benchmark"), keep=COLUMNS)
    return found.filter(F.size("leaks") == 0).select(*COLUMNS)


def mask_pii(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Texts with personal data replaced by its kind in brackets; n_chars is that of the new text."""
    found = pii.find_pii(docs, pii.fitted(docs), keep=COLUMNS)
    hit = F.size("found") > 0
    clean = found.withColumn("masked", pii.masked(F.col("text"), F.col("found")))
    return clean.select("doc_id", F.col("masked").alias("text"), "lang", "source", F.when(hit, F.length("masked").cast("long")).otherwise(F.col("n_chars")).alias("n_chars"))


def encode(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Token counts and digests of every document that is left."""
    return bpe.encode_documents(docs)


STAGES = [
    ("toxicity", drop_toxic),
    ("near_duplicates", drop_near_duplicates),
    ("decontamination", drop_leaks),
    ("pii", mask_pii),
    ("bpe", encode),
]

#: The stages are learnt models and sketches, which SQL can't express; tests hold them against brute force.
ORACLE_SQL = None


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over `documents`, each written and read again."""
    docs = table(spark, sf_dir, "documents")
    for k, (name, stage) in enumerate(STAGES):
        docs = stage(spark, docs, sf_dir)
        if k < len(STAGES) - 1:
            docs = written(docs, f"stage-{name}")
    return docs
