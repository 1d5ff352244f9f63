"""The written index and the vector blocks against searches that read everything."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import index, retrieval, vectors
from evispark.sources import shared

random.seed(5)
TERMS = [f"t{i}" for i in range(60)] + ["营业收入", "研发", "年报2024", "x-1.5"]


def passage(n):
    return " ".join(TERMS[min(int(random.expovariate(0.12)), len(TERMS) - 1)] for _ in range(n))


@pytest.fixture(scope="module")
def corpus(spark):
    rows = [(i, passage(random.choice((0, 1, 5, 30, 200))), "en" if i % 3 else None, f"d{i % 17}") for i in range(400)]
    rows += [(1000 + i, rows[7][1], "en", "d1") for i in range(40)] + [(2000, None, "en", "d2")]
    return spark.createDataFrame(rows, "chunk_id long, text string, lang string, document_id string").repartition(4).cache()


@pytest.fixture(scope="module")
def questions(spark):
    rows = [(i, passage(random.choice((1, 2, 9, 40)))) for i in range(25)] + [(97, "never seen"), (98, ""), (99, None)]
    return spark.createDataFrame(rows, "query_id int, query string")


def rows_of(df):
    return sorted((r.query_id, r.chunk_id, round(r.score, 5), r.rank) for r in df.collect())


@pytest.mark.parametrize(("first", "pairs"), [(2, 10_000), (100, 3)])
def test_index_finds_what_a_full_search_finds(spark, corpus, questions, tmp_path, monkeypatch, first, pairs):
    monkeypatch.setattr(index, "PAIRS", pairs)
    monkeypatch.setattr(index, "ASKED", 120)  # several passes
    index.write(corpus, f"{tmp_path}/i", keys=("lang", "document_id"), per_range=9)
    found = index.read(spark, f"{tmp_path}/i")
    assert found.ranges == 49
    assert rows_of(index.search(found, questions, 10, first=first)) == rows_of(retrieval.bm25(corpus, questions, 10))
    where = F.col("lang").eqNullSafe("en")
    assert rows_of(index.search(found, questions, 7, where=where, first=first)) == rows_of(retrieval.bm25(corpus, questions, 7, where=where))
    by_document = questions.select("query_id", F.when(F.col("query_id") % 4 > 0, F.concat(F.lit("d"), (F.col("query_id") % 9).cast("string"))).alias("document_id"))
    by_chunk = by_document.join(corpus, "document_id").select("query_id", "chunk_id").union(by_document.where("document_id is null").select("query_id", F.lit(None).cast("long")))
    assert rows_of(index.search(found, questions, 5, allowed=by_document, first=first)) == rows_of(retrieval.bm25(corpus, questions, 5, allowed=by_chunk))
    assert index.search(found, questions, 0, first=first).collect() == []


def test_ranges_that_cannot_reach_the_threshold_are_not_read(spark, tmp_path):
    """One chunk a range, a rare word in few: only what promises enough is scored."""
    rows = [(i, "common " * 3 + ("rare rare rare" if i < 20 else f"w{i}")) for i in range(300)]
    index.write(spark.createDataFrame(rows, "chunk_id int, text string"), f"{tmp_path}/i", per_range=1)
    asked = spark.createDataFrame([(1, "rare common")], "query_id int, query string")
    seen = spark.sparkContext.accumulator(0)
    counted = F.udf(lambda x: seen.add(1) or True, "boolean").asNondeterministic()
    hits = index.search(index.read(spark, f"{tmp_path}/i"), asked, 3, where=counted(F.col("chunk_id")), first=40).collect()
    assert [h.chunk_id < 20 for h in hits] == [True] * 3 and seen.value < 2 * 2 * 130


def test_index_is_written_once_and_anew_when_its_files_change(spark, tmp_path, monkeypatch):
    path = f"{tmp_path}/docs"
    spark.createDataFrame([(1, "a b")], "chunk_id int, text string").write.parquet(path)
    made, write = [], index.write
    monkeypatch.setattr(index, "write", lambda *a: made.append(1) or write(*a))
    for turn in range(3):
        docs = spark.read.parquet(path)
        index.of(docs, shared.version(docs))
        assert len(made) == 1
    spark.createDataFrame([(2, "c")], "chunk_id int, text string").write.mode("append").parquet(path)
    docs = spark.read.parquet(path)
    assert index.of(docs, shared.version(docs)).n == 2 and len(made) == 2
    with pytest.raises(ValueError):
        index.of(docs.limit(0), "none")


def test_made_once_survives_a_failed_and_a_parallel_maker(spark, tmp_path):
    path = f"{tmp_path}/x"

    def fails(own):
        spark.range(1).write.parquet(own)
        raise RuntimeError

    with pytest.raises(RuntimeError):
        shared.made_once(spark, path, fails)
    assert not shared.exists(spark, path)

    def overtaken(own):
        spark.range(5).write.parquet(path)
        spark.range(2).write.parquet(own)

    shared.made_once(spark, path, overtaken)
    assert spark.read.parquet(path).count() == 5


@pytest.fixture(scope="module")
def cloud(spark):
    """Four far clusters, one of them a third of all and all alike, with keys."""
    rng = random.Random(3)
    rows = []
    for i in range(900):
        centre = 10.0 * (i % 3)
        rows.append((i, [centre + rng.gauss(0, 1) for _ in range(6)] if i % 3 else [1.0] * 6, i % 7))
    return spark.createDataFrame(rows, "chunk_id int, vector array<float>, label int").repartition(5).cache()


@pytest.fixture(scope="module")
def pointed(spark):
    rng = random.Random(4)
    return spark.createDataFrame([(10 * i, [rng.gauss(0, 1) for _ in range(6)]) for i in range(30)], "query_id int, query_vector array<float>")


@pytest.mark.parametrize("pairs", [10_000, 3])
def test_blocks_find_what_a_full_search_finds(spark, cloud, pointed, tmp_path, monkeypatch, pairs):
    monkeypatch.setattr(vectors, "PAIRS", pairs)
    vectors.write(cloud, f"{tmp_path}/v", ("label",), per_block=16)
    blocks = vectors.read(spark, f"{tmp_path}/v")
    assert blocks.rows.select(F.explode("ids").alias("i")).distinct().count() == 900 and blocks.rows.select(F.max(F.size("ids"))).first()[0] <= 80
    free = F.when(F.col("query_id") % 40 == 0, F.array(F.lit(None).cast("int"))).otherwise(F.array((F.col("query_id") % 7).cast("int"), ((F.col("query_id") + 3) % 7).cast("int")))
    by_label = pointed.where("query_id % 50 <> 0").select("query_id", F.explode(free).alias("label"))
    by_chunk = by_label.join(cloud.select("label", "chunk_id"), "label", "left").select("query_id", "chunk_id")
    scores = {(q.query_id, c.chunk_id): sum(a * b for a, b in zip(q.query_vector, c.vector, strict=True)) for q in pointed.collect() for c in cloud.collect()}
    may = {(r.query_id, r.label) for r in by_label.collect()}
    label = {r.chunk_id: r.label for r in cloud.collect()}

    def plain(top_k, limited):
        out = []
        for q in {x for x, _ in scores}:
            open_ = [(-round(s, 6), c) for (x, c), s in scores.items() if x == q and c != q and (not limited or (q, None) in may or (q, label[c]) in may)]
            out += [(q, c, round(-s, 5), i) for i, (s, c) in enumerate(sorted(open_)[:top_k], 1)]
        return sorted(out)

    assert rows_of(vectors.search(blocks, pointed, 5, True)) == rows_of(retrieval.dense(cloud, pointed, 5, True)) == plain(5, False)
    for allowed in (by_label, by_chunk):
        assert rows_of(retrieval.dense(cloud, pointed, 5, True, allowed=allowed)) == plain(5, True)
        assert rows_of(vectors.search(blocks, pointed, 5, True, allowed)) == plain(5, True)
    assert vectors.search(blocks, pointed.limit(0)).collect() == []


def test_blocks_out_of_reach_are_not_read(spark, cloud, pointed, tmp_path):
    vectors.write(cloud, f"{tmp_path}/v", per_block=16)
    blocks = vectors.read(spark, f"{tmp_path}/v")
    asked = pointed.limit(1).select("query_id", F.transform(F.sequence(F.lit(1), F.lit(6)), lambda i: F.lit(1.0).cast("float")).alias("query_vector"))
    seen = spark.sparkContext.accumulator(0)
    one = F.udf(lambda b: seen.add(1) or b, "string").asNondeterministic()
    hits = vectors.search(blocks._replace(rows=blocks.rows.join(F.broadcast(blocks.heads.select("part", "block")), ["part", "block"]).withColumn("ids", F.when(one("block").isNotNull(), F.col("ids")))), asked, 3).collect()
    assert len(hits) == 3 and all(h.chunk_id % 3 == 2 for h in hits)
    heads = blocks.heads.toArrow().combine_chunks().to_batches()[0]
    from evispark.operators.retrieval import asked_passes

    (held,) = asked_passes(asked, __import__("pyarrow").int32())
    most = vectors.bounds(heads, held)[:, 0]
    assert (most >= hits[-1].score).sum() < len(most) / 2


def test_bounds_hold(spark, cloud, pointed, tmp_path):
    from evispark.operators.retrieval import asked_passes, matrix_of

    vectors.write(cloud, f"{tmp_path}/v", per_block=16)
    rows = spark.read.parquet(f"{tmp_path}/v/blocks").toArrow().combine_chunks().to_batches()[0]
    (held,) = asked_passes(pointed, __import__("pyarrow").int32())
    most = vectors.bounds(rows, held)
    for i in range(rows.num_rows):
        x = rows.column("vectors")[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(-1, 6)
        assert (x @ held.vectors.T <= most[i]).all()
    assert matrix_of(rows.column("centre"), 6).shape == (rows.num_rows, 6)
    with pytest.raises(ValueError):
        vectors.write(spark.createDataFrame([(1, [1.0]), (2, [1.0, 2.0])], "chunk_id int, vector array<double>"), f"{tmp_path}/w")


def test_a_task_makes_the_blocks_of_a_range_from_its_chunks():
    """Of batches in the order of ranges, whatever their bounds; no posting is moved by itself, so none is left to be grouped."""
    import pyarrow as pa

    tokens = [["b", "a", "b"], [], ["a"], ["c", "c", "c", "b"], ["a", "b"]]
    batch = pa.record_batch([pa.array([7, 8, 9, 10, 11]), pa.array(list("xyxyx")), pa.array(tokens, pa.list_(pa.string()))], ["chunk_id", "lang", "tokens"])
    rows = [r for b in index.counted([batch.slice(1, 2), batch.slice(0, 1), batch.slice(3)]) for r in b.to_pylist()]
    assert {r["chunk_id"]: r["dl"] for r in rows} == {7: 3, 8: 0, 9: 1, 10: 4, 11: 2}
    assert {r["chunk_id"]: {t["term"]: t["tf"] for t in r["terms"]} for r in rows}[7] == {"a": 1, "b": 2}
    assert all((r["probe"] in [t["term"] for t in r["terms"]]) if r["dl"] else True for r in rows)
    for r in rows:
        r["range"] = r.pop("chunk_id") // 9
        r["chunk_id"] = {"x": r["range"], "y": -1}[r["lang"]]
        del r["probe"]
    rows.sort(key=lambda r: r["range"])
    kinds = pa.schema([("lang", pa.string()), ("dl", pa.int32()), ("terms", pa.list_(pa.struct([("term", pa.string()), ("tf", pa.int32())]))), ("range", pa.int32()), ("chunk_id", pa.int64())])
    whole = pa.RecordBatch.from_pylist(rows, kinds)
    got = [r for b in index.blocks_of([whole.slice(0, 1), whole.slice(1, 2), whole.slice(3)], ["lang"], 2.0, 1.5, 0.75) for r in b.to_pylist()]
    assert {(r["term"], r["range"]): (r["n"], sorted(h["tf"] for h in r["hits"])) for r in got} == {("a", 0): (1, [1]), ("b", 0): (1, [2]), ("a", 1): (2, [1, 1]), ("b", 1): (2, [1, 1]), ("c", 1): (1, [3])}
    assert all(r["top"] == max(index.gain(h["tf"], h["dl"], 2.0) for h in r["hits"]) and set(r["hits"][0]) == {"chunk_id", "lang", "tf", "dl"} for r in got)


def test_texts_stay_where_they_are_when_hits_are_joined_with_them(spark):
    """Even where neither side is known to be small."""
    from evispark.plans import catalog

    before = spark.conf.get("spark.sql.autoBroadcastJoinThreshold")
    spark.conf.set("spark.sql.autoBroadcastJoinThreshold", "-1")
    try:
        plan = catalog._hits_to_pack(spark, "/root/testdata/sf0.001")._jdf.queryExecution().executedPlan().toString()
    finally:
        spark.conf.set("spark.sql.autoBroadcastJoinThreshold", before)
    assert "SortMergeJoin [chunk_id" not in plan and "BroadcastHashJoin [chunk_id" in plan
