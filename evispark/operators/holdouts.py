"""Frozen question sets over companies that no earlier set has seen: drawn by category, with quarterly passages as decoys."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions.facts import constraints_of, entails, fact_of
from evispark.functions.text import squeeze
from evispark.operators import answering
from evispark.operators.datasets import QUARTER_TABLE, numbered

#: Questions of each category (fixed values), in the order in which they are numbered.
QUOTAS = {"single_year_fact": 20, "cross_year_comparison": 10, "calculation": 8, "annual_quarter_confusion": 8, "multi_evidence": 6, "no_answer": 8}
COLUMNS = ("query", "category", "fact_key", "companies", "years", "answer", "expected_action", "relevant_chunk_ids", "source_pages", "document_ids", "gold_values", "distractor_chunk_ids")


def decoys(facts: DataFrame, chunks: DataFrame, reach: int = 1) -> DataFrame:
    """(chunk_id, distractor_chunk_ids) of each gold chunk: its document's other chunks within `reach` pages of a quarterly table's heading.

    Chunks and headings meet by document and page, a heading standing for the 2 * reach + 1 pages around it: no pairs of all pages.
    """
    near = chunks.where(F.col("text").contains(QUARTER_TABLE)).select("document_id", F.explode(F.sequence(F.col("page") - reach, F.col("page") + reach)).alias("page")).distinct()
    close = chunks.join(near, ["document_id", "page"]).select("document_id", F.col("chunk_id").alias("decoy"))
    gold = facts.select("document_id", "chunk_id").distinct()
    return gold.join(close, "document_id").where("chunk_id <> decoy").groupBy("chunk_id").agg(F.array_sort(F.collect_set("decoy")).alias("distractor_chunk_ids"))


def candidates(facts: DataFrame, chunks: DataFrame, templates: DataFrame, reach: int = 1) -> DataFrame:
    """Every question that the templates (category, fact_key, template) make of facts (company, year, fact_key, answer, value, unit, chunk_id, document_id, page).

    {c}, {y} and {z} stand for the company, the year and the one after. Two-year categories pair a fact with the next
    year's by a join on company, fact and year; calculations want equal units; quarterly ones want a decoy; questions that are to be
    refused (fact_key null in their template) name a qualifier and are left out where a passage of that company and year entails it.
    """
    one = F.struct("year", "answer", "value", "unit", "chunk_id", "document_id", "page")
    base = facts.select("company", "fact_key", "year", one.alias("old"))
    pairs = base.join(base.select("company", "fact_key", (F.col("year") - 1).alias("year"), F.col("old").alias("new")), ["company", "fact_key", "year"], "left")
    made = pairs.join(templates, "fact_key")
    two = F.col("template").contains("{z}")
    made = made.where(~two | F.col("new").isNotNull()).where((F.col("category") != "calculation") | (F.col("old.unit") == F.col("new.unit")))
    filled = lambda text: F.replace(F.replace(F.replace(text, F.lit("{c}"), F.col("company")), F.lit("{y}"), F.col("year").cast("string")), F.lit("{z}"), (F.col("year") + 1).cast("string"))
    used = F.when(two, F.array("old", "new")).otherwise(F.array("old"))
    told = lambda f: F.concat(f["year"].cast("string"), F.lit("年"), f["answer"])
    old, new = F.col("old"), F.col("new")
    difference, percent = answering.change(old["value"], new["value"])
    worked = F.concat(
        F.lit("；"), new["year"].cast("string"), F.lit("年-"), old["year"].cast("string"), F.lit("年："), new["answer"], F.lit("-"), old["answer"], F.lit("="),
        answering.format_decimal(difference, digits=F.greatest(answering.decimals_of(old["answer"]), answering.decimals_of(new["answer"]))), old["unit"], F.lit("，变化率="), F.coalesce(answering.format_decimal(percent, 2), F.lit("无法计算")), F.lit("%"),
    )
    answer = F.when(~two, old["answer"]).when(F.col("category") == "calculation", F.concat(told(old), F.lit("；"), told(new), worked)).otherwise(F.concat(told(old), F.lit("；"), told(new)))
    made = made.withColumn("used", used).join(decoys(facts, chunks, reach), F.col("old.chunk_id") == F.col("chunk_id"), "left")
    confusing = F.col("category") == "annual_quarter_confusion"
    made = made.where(~confusing | F.col("distractor_chunk_ids").isNotNull())
    part = lambda name: F.transform("used", lambda f: f[name])
    empty = F.array().cast("array<string>")
    open_ = made.select(
        filled(F.col("template")).alias("query"), "category", "fact_key", F.array("company").alias("companies"), part("year").alias("years"), answer.alias("answer"), F.lit("answer").alias("expected_action"),
        part("chunk_id").alias("relevant_chunk_ids"), part("page").alias("source_pages"), part("document_id").alias("document_ids"), part("answer").alias("gold_values"), F.when(confusing, F.col("distractor_chunk_ids")).otherwise(empty).alias("distractor_chunk_ids"),
    )

    years = facts.select("company", "year", "document_id").distinct()
    none = years.crossJoin(F.broadcast(templates.where("fact_key is null").select("category", "template")))  # a stated list of templates
    none = none.withColumn("query", filled(F.col("template"))).withColumn("fact_key", fact_of(F.col("query")))
    none = none.where(F.col("fact_key").isNotNull() & (F.size(constraints_of(F.col("query"), F.col("fact_key"))) > 0))
    passages = chunks.select("company", F.col("year").cast("int").alias("year"), "text")
    entailed = none.select("company", "year", "query", "fact_key").join(passages, ["company", "year"]).where(entails(F.col("text"), F.col("query"), F.col("fact_key"))).select("query").distinct()
    none = none.join(entailed, "query", "left_anti")
    refuse = none.select(
        "query", "category", "fact_key", F.array("company").alias("companies"), F.array("year").alias("years"), F.lit(None).cast("string").alias("answer"), F.lit("refuse").alias("expected_action"),
        empty.alias("relevant_chunk_ids"), F.array().cast("array<int>").alias("source_pages"), F.array("document_id").alias("document_ids"), empty.alias("gold_values"), empty.alias("distractor_chunk_ids"),
    )
    return open_.unionByName(refuse)


def build(facts: DataFrame, chunks: DataFrame, templates: DataFrame, prior: DataFrame, quotas: dict[str, int] = QUOTAS, seed: int = 42, prefix: str = "holdout", reach: int = 1) -> DataFrame:
    """A frozen set (query_id and COLUMNS): of each category as many questions as its quota, of companies that prior (column company) lacks.

    Questions are drawn by a seeded digest of category and text, so reruns and other partitionings draw the same; of
    equal texts (but for white space) the first category's counts. A category that has too few is an error. Ids number
    the set by category, in the order of quotas, then by digest.
    """
    spark = facts.sparkSession
    new = facts.join(prior.select("company").distinct(), "company", "left_anti")
    wanted = F.broadcast(spark.createDataFrame([(c, i, n) for i, (c, n) in enumerate(quotas.items())], "category string, place int, quota int"))
    rows = candidates(new, chunks, templates, reach).join(wanted, "category").withColumn("drawn", F.md5(F.concat(F.lit(f"{seed}:"), "category", F.lit(":"), "query")))
    first = F.row_number().over(W.partitionBy(squeeze(F.col("query"))).orderBy("place", "drawn"))
    rows = rows.withColumn("n", first).where("n = 1").withColumn("n", F.row_number().over(W.partitionBy("category").orderBy("drawn"))).where(F.col("n") <= max(quotas.values())).where("n <= quota")
    counts = wanted.join(rows.groupBy("category").agg(F.count("*").alias("found")), "category", "left")
    told = F.raise_error(F.concat(F.lit("too few questions of category "), F.col("category"))).cast("boolean")
    enough = counts.where(F.when(F.coalesce("found", F.lit(0)) < F.col("quota"), told).otherwise(F.lit(True))).select("category")
    return numbered(rows.join(enough, "category"), prefix, "place", "drawn").select("query_id", *COLUMNS)
