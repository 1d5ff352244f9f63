"""Line-delimited JSON tables with fixed schemas, PDF files' checks, and sinks that never overwrite."""

from __future__ import annotations

import uuid

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.sources import shared

CHUNKS = "chunk_id string, document_id string, company string, year int, section string, page int, text string"
QUERIES = "query_id string, query string, relevant_chunk_ids array<string>, question_type string"
REPORTS = "document_id string, company string, stock_code string, year int, filename string, url string, source string"
LEAST_PDF = 10_000


def _read(spark: SparkSession, path: str, schema: str, needed: list[str]) -> DataFrame:
    rows = spark.read.schema(schema).option("mode", "FAILFAST").json(path)
    for c in needed:
        rows = rows.withColumn(c, F.when(F.col(c).isNull(), F.raise_error(F.lit(f"{c} is missing"))).otherwise(F.col(c)))
    return rows


def read_chunks(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, CHUNKS, ["chunk_id", "document_id", "text"]).withColumn("section", F.coalesce("section", F.lit("")))


def read_queries(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, QUERIES, ["query_id", "query"]).withColumn("question_type", F.coalesce("question_type", F.lit("unknown")))


def read_reports(spark: SparkSession, path: str) -> DataFrame:
    return _read(spark, path, REPORTS, ["document_id"])


def write(rows: DataFrame, path: str) -> None:
    """JSON lines; a path that exists is an error, as for a frozen result."""
    rows.write.mode("errorifexists").json(path)


def write_file(rows: DataFrame, path: str, *order: str) -> None:
    """One file of JSON lines, in the order of these columns where any are given, in folders made for it; a path that exists is an error.

    One task sorts them, on disk where they are many, and writes them: for what is handed to tools that read one file. It
    appears by a rename. No rows make an empty file.
    """
    spark, own = rows.sparkSession, f"{path}.{uuid.uuid4().hex}"
    if shared.exists(spark, path):
        raise FileExistsError(path)
    one = rows.repartition(1)
    (one.sortWithinPartitions(*order) if order else one).write.option("ignoreNullFields", "false").json(own)
    try:
        parts = shared.names(spark, own, "part-*")
        if parts:
            shared.move(spark, parts[0], path)
        else:
            shared.touch(spark, path)
    finally:
        shared.delete(spark, own)


def read_pdfs(spark: SparkSession, path: str) -> DataFrame:
    """(path, length, sha256, valid) of files: large enough and with a PDF's first bytes."""
    files = spark.read.format("binaryFile").load(path)
    valid = (F.col("length") >= LEAST_PDF) & (F.substring("content", 1, 5) == F.lit(b"%PDF-"))
    return files.select("path", "length", F.sha2("content", 256).alias("sha256"), valid.alias("valid"))


def qrels(queries: DataFrame) -> DataFrame:
    return queries.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
