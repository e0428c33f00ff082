"""Documents to tokens in five stages: quality, near-duplicates, benchmark passages, secrets, byte-pair encoding.

Each stage works on all documents its predecessor kept and returns them with the columns of ``documents``; the last
one returns their tokens.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from mileglass.llm import bpe, decontamination, quality, secret_scan, simhash
from mileglass.llm.queries import tokenizer_file
from mileglass.llm.text import stored

TOKENIZER = "word_bpe_49k.json"


def quality_rules(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that pass the hard rules and whose votes speak for them."""
    return quality.keep_quality(docs)


def near_duplicates(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Of each group of near-duplicates the document with the smallest id."""
    return simhash.keep_one(docs, shingle=3, max_bits=3)


def benchmark_passages(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Documents that are not contaminated, unchanged."""
    return decontamination.decontaminate(docs, spark.read.parquet(f"{sf_dir}/benchmark.parquet"))


def secrets(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """All documents, the values of secrets replaced; ``n_chars`` follows the text."""
    clean = secret_scan.redact(docs)
    return clean.withColumn("n_chars", F.coalesce(F.length("text").cast("long"), F.col("n_chars")))


def tokens(spark: SparkSession, docs: DataFrame, sf_dir: str) -> DataFrame:
    """Packed ids of every document, their number, and the text they decode to."""
    done = docs.select("doc_id", "lang", "source", bpe.encode_and_decode(spark, F.col("text"), tokenizer_file(TOKENIZER)).alias("bpe"))
    ids = F.col("bpe.ids")
    return done.select("doc_id", "lang", "source", ids.alias("ids"), (F.octet_length(ids) / 4).cast("long").alias("n_tokens"),
                       F.col("bpe.decoded").alias("decoded"))


STAGES = [("quality rules", quality_rules), ("near-duplicates", near_duplicates),
          ("benchmark passages", benchmark_passages), ("secrets", secrets), ("tokens", tokens)]


def run(spark: SparkSession, sf_dir: str) -> DataFrame:
    """All stages over ``documents``; what each returns is written to the shared folder and read by the next."""
    docs = spark.read.parquet(f"{sf_dir}/documents.parquet")
    for name, stage in STAGES[:-1]:
        docs = stored(stage(spark, docs, sf_dir), name.replace(" ", "-"))
    return STAGES[-1][1](spark, docs, sf_dir)


#: Fitted votes, fingerprints and merges have no SQL form.
ORACLE_SQL = None
QUERIES = {"pipeline": run}
ORACLES = {} if ORACLE_SQL is None else {"pipeline": ORACLE_SQL}
