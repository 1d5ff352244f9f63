"""Reports: pages to marked-up documents and passages, a cache of vectors, and locks on files."""

from __future__ import annotations

import json
from collections.abc import Callable, Iterable

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.functions.text import strip
from evispark.operators import chunking


def pages_of(spark: SparkSession, path: str, extract: Callable[[Iterable], Iterable], schema: str = "path string, page int, text string") -> DataFrame:
    """Pages of files by an extractor, a function over Arrow batches of (path, content): a slot, as no PDF library is there."""
    return spark.read.format("binaryFile").load(path).select("path", "content").mapInArrow(extract, schema)


def markdown(reports: DataFrame, pages: DataFrame) -> DataFrame:
    """(document_id, company, year, markdown, pages, empty_pages, extracted_chars) of reports that have pages (document_id, page, text).

    A page is a marker and its text without white space around it; pages are divided by a blank line.
    """
    rows = pages.select("document_id", "page", strip(F.coalesce("text", F.lit(""))).alias("text"))
    block = F.concat(F.lit("<!-- page: "), F.col("page").cast("string"), F.lit(" -->\n"), "text")
    found = rows.groupBy("document_id").agg(
        F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("page", block.alias("block")))), lambda p: p["block"]), "\n\n").alias("markdown"),
        F.count("*").alias("pages"), F.count_if(F.col("text") == "").alias("empty_pages"), F.sum(F.length("text")).alias("extracted_chars"),
    )
    return reports.select("document_id", "company", F.col("year").cast("int").alias("year")).join(found, "document_id")


def parse(reports: DataFrame, pages: DataFrame, only: Iterable[str] | None = None, max_chars: int = 900, overlap_chars: int = 120, min_chars: int = 80) -> tuple[DataFrame, DataFrame, DataFrame]:
    """(chunks, a report on each document, the reports without pages). No chunk at all is an error; `only` names the documents to parse."""
    wanted = reports.where(F.col("document_id").isin(*only)) if only is not None else reports
    documents = markdown(wanted, pages)
    chunks = chunking.chunk(documents.select("document_id", "company", "year", "markdown"), max_chars, overlap_chars, min_chars)
    if chunks.isEmpty():
        raise ValueError("nothing was parsed")
    counts = chunks.groupBy("document_id").agg(F.count("*").alias("chunks"))
    told = documents.drop("markdown").join(counts, "document_id", "left").na.fill({"chunks": 0})
    return chunks, told, wanted.join(documents.select("document_id"), "document_id", "left_anti")


def write_vectors(vectors: DataFrame, path: str, model: str, max_length: int) -> None:
    """Vectors (chunk_id, vector) with the model's name and length limit; a path that exists is an error."""
    vectors.select("chunk_id", "vector", F.lit(model).alias("model"), F.lit(max_length).alias("max_length")).write.mode("errorifexists").parquet(path)


def read_vectors(spark: SparkSession, path: str, chunks: DataFrame, model: str, max_length: int) -> DataFrame:
    """(chunk_id, vector) of a cache that fits: the same model and limit, and a vector for each chunk and for nothing else; else an error."""
    cache = spark.read.parquet(path)
    if cache.where(~F.col("model").eqNullSafe(model)).limit(1).count():
        raise ValueError("the cached vectors are of another model")
    if cache.where(~F.col("max_length").eqNullSafe(max_length)).limit(1).count():
        raise ValueError("the cached vectors were made with another max_length")
    ids = chunks.select("chunk_id")
    if cache.select("chunk_id").exceptAll(ids).limit(1).count() or ids.exceptAll(cache.select("chunk_id")).limit(1).count():
        raise ValueError("the cached vectors are not those of the chunks")
    return cache.select("chunk_id", "vector")


def config(text: str) -> dict:
    """A configuration from YAML, where its library is there, or JSON."""
    try:
        import yaml
    except ImportError:
        return json.loads(text)
    return yaml.safe_load(text)


def digests(spark: SparkSession, paths: Iterable[str]) -> DataFrame:
    """(path, sha256) of files."""
    files = spark.read.format("binaryFile").load(list(paths))
    return files.select("path", F.sha2("content", 256).alias("sha256"))


def lock(files: DataFrame, path: str, status: str = "locked") -> None:
    """Writes files (path, sha256) and a status as a lock; one that exists is never overwritten."""
    files.withColumn("status", F.lit(status)).write.mode("errorifexists").json(path)


def check_lock(spark: SparkSession, path: str, now: DataFrame) -> None:
    """Raises unless the lock's status is locked and `now` (path, sha256) has each of its files, unchanged."""
    known = spark.read.schema("path string, sha256 string, status string").json(path)
    if known.where(~F.col("status").eqNullSafe("locked")).limit(1).count():
        raise ValueError("the configuration is not locked")
    both = known.join(now.withColumnRenamed("sha256", "found"), "path", "left")
    for problem, test in (("is missing", F.col("found").isNull()), ("changed", F.col("found") != F.col("sha256"))):
        if rows := both.where(test).select("path").limit(5).collect():
            raise ValueError(f"a locked file {problem}: {', '.join(r.path for r in rows)}")


def run_once(spark: SparkSession, lock_path: str, now: DataFrame, run: Callable[[], DataFrame], output: str) -> DataFrame:
    """The result of a frozen run, written to output: the lock is checked first, and a second run is refused."""
    where = spark.sparkContext._jvm.org.apache.hadoop.fs.Path(output)
    if where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).exists(where):
        raise FileExistsError(f"{output} exists: a second run is refused")
    check_lock(spark, lock_path, now)
    run().write.mode("errorifexists").parquet(output)
    return spark.read.parquet(output)


def environment(spark: SparkSession) -> DataFrame:
    """(name, value) of what a run depends on."""
    import platform
    import sys

    rows = [("python", sys.version.split()[0]), ("platform", platform.platform()), ("spark", spark.version), ("master", spark.sparkContext.master), ("parallelism", str(spark.sparkContext.defaultParallelism))]
    return spark.createDataFrame(rows, "name string, value string")
