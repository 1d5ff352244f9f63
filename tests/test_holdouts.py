"""Frozen question sets: quotas, decoys, what earlier sets have seen, and numbering by ranges."""

import pytest
from pyspark.sql import functions as F

from evispark.operators import datasets, holdouts

CHUNK = "chunk_id string, document_id string, company string, year int, section string, page int, text string"
FACT = "company string, year int, fact_key string, answer string, value decimal(28,4), unit string, chunk_id string, document_id string, page int"
TEMPLATES = [("single_year_fact", "revenue", "{c}{y}年营业收入是多少？"), ("calculation", "revenue", "{c}{z}年营业收入较{y}年变化了多少？"), ("annual_quarter_confusion", "revenue", "{c}{y}年全年营业收入是多少？"), ("multi_evidence", "revenue", "{c}{y}年 营业收入是多少？"), ("no_answer", None, "{c}{y}年北美营业收入是多少？"), ("no_answer", None, "{c}{y}年北美净资产收益是多少？")]


@pytest.fixture(scope="module")
def corpus(spark):
    rows, facts = [], []
    for name in ("甲公司", "乙公司", "丙公司"):
        for year in (2022, 2023, 2024):
            doc = f"{name}-{year}"
            far = 9 if name == "乙公司" else 6
            rows += [(f"{doc}:0", doc, name, year, "s", 5, f"营业收入 {year:,}" + (" 北美" if name == "丙公司" else "")), (f"{doc}:1", doc, name, year, "s", far, "分季度主要财务指标 营业收入 7"), (f"{doc}:2", doc, name, year, "s", 20, "other")]
            facts.append((name, year, "revenue", f"{year:,}元", __import__("decimal").Decimal(year), "万元" if (name, year) == ("甲公司", 2024) else "元", f"{doc}:0", doc, 5))
    return spark.createDataFrame(rows, CHUNK).cache(), spark.createDataFrame(facts, FACT).cache()


def test_candidates(spark, corpus):
    chunks, facts = corpus
    templates = spark.createDataFrame(TEMPLATES, "category string, fact_key string, template string")
    found = {}
    for r in holdouts.candidates(facts, chunks, templates).collect():
        found.setdefault(r.category, {})[r.query] = r
    assert len(found["single_year_fact"]) == 9 and len(found["calculation"]) == 5  # one pair's units differ
    worked = found["calculation"]["乙公司2023年营业收入较2022年变化了多少？"]
    assert worked.answer == "2022年2,022元；2023年2,023元；2023年-2022年：2,023元-2,022元=1元，变化率=0.05%" and list(worked.years) == [2022, 2023] and list(worked.source_pages) == [5, 5]
    confusing = found["annual_quarter_confusion"]
    assert len(confusing) == 9 and all(list(r.distractor_chunk_ids) == [f"{r.document_ids[0]}:1"] for r in confusing.values())  # not the gold passage, nor one far off
    far = {r.chunk_id: list(r.distractor_chunk_ids) for r in holdouts.decoys(facts.withColumn("chunk_id", F.concat("document_id", F.lit(":2"))), chunks).collect()}
    assert far["甲公司-2022:2"] == ["甲公司-2022:0", "甲公司-2022:1"] and far["乙公司-2022:2"] == ["乙公司-2022:1"]
    assert {q[:3] for q in found["no_answer"]} == {"甲公司", "乙公司"} and all(r.expected_action == "refuse" and r.answer is None for r in found["no_answer"].values())


def test_quotas_and_what_was_seen(spark, corpus):
    chunks, facts = corpus
    templates = spark.createDataFrame(TEMPLATES, "category string, fact_key string, template string")
    seen = chunks.where("company = '甲公司'")
    quotas = {"single_year_fact": 4, "calculation": 3, "no_answer": 2}
    rows = holdouts.build(facts, chunks, templates.where("category <> 'multi_evidence'"), seen, quotas).orderBy("query_id").collect()
    assert [r.query_id for r in rows] == [f"holdout-{i:03d}" for i in range(1, 10)] and [r.category for r in rows] == ["single_year_fact"] * 4 + ["calculation"] * 3 + ["no_answer"] * 2
    assert all("甲公司" not in r.companies for r in rows)
    again = holdouts.build(facts.repartition(5), chunks.repartition(3), templates.where("category <> 'multi_evidence'"), seen, quotas).orderBy("query_id").collect()
    assert again == rows and holdouts.build(facts, chunks, templates, seen, quotas, seed=1).orderBy("query_id").collect() != rows
    with pytest.raises(Exception, match="too few questions of category multi_evidence"):  # its texts are those of the first category but for a space
        holdouts.build(facts, chunks, templates, seen, {"single_year_fact": 6, "multi_evidence": 1}).collect()


def test_numbers_follow_the_order_over_many_ranges(spark):
    rows = spark.range(0, 5000, 1, 9).select((F.col("id") * 7919 % 5000).alias("k"), F.when(F.col("id") % 2 == 0, "x").alias("t"))
    found = datasets.numbered(rows, "n", "t", F.col("k").desc(), digits=4).collect()
    ordered = sorted(found, key=lambda r: (r.t is not None, r.t or "", -r.k))
    assert [r.query_id for r in ordered] == [f"n-{i:04d}" for i in range(1, 5001)]
    assert datasets.numbered(rows.limit(0), "n", "k").collect() == []
