import json

import pytest
from pyspark.sql import functions as F

from evispark.operators import datasets
from evispark.sources import jsonl, reports
from evispark.streaming import ledger


def test_round_trip_and_no_overwrite(spark, tmp_path):
    rows = spark.createDataFrame([("c:0000", "c", "甲", 2024, None, None, "文本")], jsonl.CHUNKS)
    jsonl.write(rows, f"{tmp_path}/chunks")
    assert jsonl.read_chunks(spark, f"{tmp_path}/chunks").first().section == ""
    with pytest.raises(Exception, match="(?i)exist"):
        jsonl.write(rows, f"{tmp_path}/chunks")


def test_one_file(spark, tmp_path):
    rows = [("b:0001", "b", "乙", 2024, "s", 1, "two\nlines"), ("a:0000", "a", None, None, "", None, "text")]
    chunks = spark.createDataFrame(rows * 1, jsonl.CHUNKS).repartition(2)
    path = tmp_path / "deep" / "er" / "chunks.jsonl"
    jsonl.write_file(chunks, str(path), "chunk_id")
    assert path.is_file() and [json.loads(x)["chunk_id"] for x in path.read_text().splitlines()] == ["a:0000", "b:0001"]
    assert json.loads(path.read_text().splitlines()[0])["page"] is None and [x.name for x in path.parent.iterdir() if not x.name.startswith(".")] == ["chunks.jsonl"]
    assert sorted(map(tuple, jsonl.read_chunks(spark, str(path)).collect())) == sorted(rows)
    with pytest.raises(FileExistsError):
        jsonl.write_file(chunks, str(path))
    jsonl.write_file(chunks.limit(0), str(tmp_path / "none.jsonl"))
    assert (tmp_path / "none.jsonl").read_text() == "" and jsonl.read_chunks(spark, str(tmp_path / "none.jsonl")).count() == 0


def test_pdf_check(spark, tmp_path):
    (tmp_path / "a.pdf").write_bytes(b"%PDF-" + b"x" * 10_000)
    (tmp_path / "b.pdf").write_bytes(b"<html>" + b"x" * 10_000)
    assert {r.path[-5:]: r.valid for r in jsonl.read_pdfs(spark, str(tmp_path)).collect()} == {"a.pdf": True, "b.pdf": False}


def test_streamed_ledger(spark, tmp_path):
    rows = spark.range(10).select(F.timestamp_seconds(F.col("id") * 600).alias("ts"), F.lit("a").alias("event_type"), F.col("id").alias("tokens"))
    rows.write.parquet(f"{tmp_path}/in")
    stream = ledger.windowed(spark.readStream.schema(rows.schema).parquet(f"{tmp_path}/in"))
    q = stream.writeStream.format("memory").queryName("ledger").outputMode("complete").start()
    q.processAllAvailable()
    q.stop()
    assert sum(r.tokens for r in spark.table("ledger").collect()) == 45


def test_reports_are_parsed(spark):
    known = spark.createDataFrame([("d1", "甲", 2024), ("d2", "乙", 2023), ("d3", "丙", 2022)], "document_id string, company string, year int")
    pages = spark.createDataFrame([("d1", 2, " 研发 " + "长" * 90), ("d1", 1, "# 概览\n" + "文" * 90), ("d1", 3, None), ("d2", 1, "短")], "document_id string, page int, text string")
    chunks, told, skipped = reports.parse(known, pages)
    assert [(r.chunk_id, r.section, r.page) for r in chunks.collect()] == [("d1:0000", "概览", 1), ("d1:0001", "概览", 2)]
    assert {(r.document_id, r.pages, r.empty_pages, r.chunks) for r in told.collect()} == {("d1", 3, 1, 2), ("d2", 1, 0, 0)} and [r.document_id for r in skipped.collect()] == ["d3"]
    with pytest.raises(ValueError, match="parsed"):
        reports.parse(known, pages, only=["d2"])


def test_vector_cache(spark, tmp_path):
    vectors = spark.createDataFrame([("a", [1.0]), ("b", [2.0])], "chunk_id string, vector array<double>")
    reports.write_vectors(vectors, f"{tmp_path}/v", "m", 768)
    ids = vectors.select("chunk_id")
    assert reports.read_vectors(spark, f"{tmp_path}/v", ids, "m", 768).count() == 2
    for of, model, size in ((ids, "n", 768), (ids, "m", 1), (ids.limit(1), "m", 768), (ids.union(ids), "m", 768)):
        with pytest.raises(ValueError):
            reports.read_vectors(spark, f"{tmp_path}/v", of, model, size)


def test_frozen_runs(spark, tmp_path):
    files = [tmp_path / "a.json", tmp_path / "b.json"]
    for f in files:
        f.write_text("{}")
    now = lambda: reports.digests(spark, map(str, files))
    reports.lock(now(), f"{tmp_path}/lock")
    assert reports.run_once(spark, f"{tmp_path}/lock", now(), lambda: spark.range(3).toDF("x"), f"{tmp_path}/out").count() == 3
    with pytest.raises(FileExistsError):
        reports.run_once(spark, f"{tmp_path}/lock", now(), lambda: spark.range(3), f"{tmp_path}/out")
    files[0].write_text("{ }")
    with pytest.raises(ValueError, match="changed"):
        reports.check_lock(spark, f"{tmp_path}/lock", now())
    with pytest.raises(ValueError, match="missing"):
        reports.check_lock(spark, f"{tmp_path}/lock", now().limit(0))
    reports.lock(now(), f"{tmp_path}/draft", "draft")
    with pytest.raises(ValueError, match="not locked"):
        reports.check_lock(spark, f"{tmp_path}/draft", now())
    assert {r.name for r in reports.environment(spark).collect()} >= {"python", "spark"} and reports.config('{"a": 1}') == {"a": 1}


def test_holdouts_are_audited(spark):
    chunks = spark.createDataFrame(
        [("n-1:0", "n-1", "新公司", 2024, 5, "营业收入 1,000"), ("n-1:1", "n-1", "新公司", 2024, 7, "分季度主要财务指标"), ("n-1:2", "n-1", "新公司", 2024, 8, "第一季度 200"), ("n-1:3", "n-1", "新公司", 2024, 20, "境外 营业收入 9")],
        "chunk_id string, document_id string, company string, year int, page int, text string",
    )
    schema = "query_id string, query string, category string, answerable boolean, companies array<string>, years array<int>, relevant_chunk_ids array<string>, source_pages array<int>, document_ids array<string>, gold_values array<string>, distractor_chunk_ids array<string>"
    good = ("q1", "新公司2024年营业收入", "single", True, ["新公司"], [2024], ["n-1:0"], [5], ["n-1"], ["1,000元"], ["n-1:2"])
    none = ("q2", "新公司2024年欧洲营业收入", "none", False, ["新公司"], [2024], [], [], [], [], [])
    prior = spark.createDataFrame([("旧公司",)], "company string")
    audit = lambda rows, before=prior, counts=None: {(r.query_id, r.issue) for r in datasets.audit_holdout(spark.createDataFrame(rows, schema), chunks, before, counts or {"single": 1, "none": 1}).collect()}
    assert audit([good, none]) == set()
    assert audit([good, none], chunks.select("company")) == {(None, "company in the prior corpus: 新公司")}
    assert audit([good, none], counts={"single": 2, "none": 1, "more": 1}) == {(None, "unexpected count of category single"), (None, "unexpected count of category more")}
    bad = [("q1", "x", "single", True, ["别"], [2023], ["n-1:0"], [6], ["n-1"], ["7"], ["n-1:3", "n-9"]), ("q2", "新公司2024年境外营业收入", "none", False, ["新公司"], [2024], [], [], [], [], [])]
    assert {i for _, i in audit(bad)} == {"gold metadata/page mismatch", "gold company/year mismatch", "value absent from gold chunk", "invalid quarterly distractor", "missing distractor", "constrained evidence unexpectedly found"}
