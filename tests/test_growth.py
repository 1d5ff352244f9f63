"""What a query holds doesn't grow with the product of questions and chunks."""

import random

import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from evispark.operators import metrics, retrieval, training


@pytest.mark.parametrize("k", [1, 3, 200])
def test_scores_are_made_a_block_at_a_time_and_allowed_pairs_in_passes(spark, monkeypatch, k):
    monkeypatch.setattr(retrieval, "ROWS", 40)
    monkeypatch.setattr(retrieval, "COLUMNS", 7)
    monkeypatch.setattr(retrieval, "PAIRS", 9)
    rng = random.Random(2)
    points = [[float(rng.randrange(-2, 3)) for _ in range(3)] for _ in range(150)]
    cloud = spark.createDataFrame([(i, p, i % 5 if i % 11 else None) for i, p in enumerate(points)], "chunk_id long, vector array<double>, key int").coalesce(1)
    asked = spark.createDataFrame([(i, points[i]) for i in range(20)], "query_id long, query_vector array<double>")
    may = {(q, (q + i) % 5) for q in range(18) for i in range(2)} | {(3, 9)}
    allowed = spark.createDataFrame([*may, (18, None)], "query_id int, key int")
    for limit in (None, allowed):
        got = {(r.query_id, r.rank): r.chunk_id for r in retrieval.dense(cloud, asked, k, True, allowed=limit).collect()}
        plain = {}
        for q in range(20):
            open_ = [i for i in range(150) if i != q and (limit is None or q == 18 or (q, i % 5 if i % 11 else None) in may)]
            best = sorted(open_, key=lambda i: (-sum(a * b for a, b in zip(points[q], points[i], strict=True)), i))[:k]
            plain |= {(q, n + 1): i for n, i in enumerate(best)}
        assert got == plain


def test_a_block_with_few_open_scores_is_not_ordered_as_a_whole(monkeypatch):
    import numpy as np

    rng = np.random.default_rng(5)
    scores = rng.integers(0, 40, (300, 9)).astype(float)
    for share in (0.0, 0.01, 0.05, 0.5, 1.0):
        open_ = rng.random(scores.shape) < share
        for k in (0, 1, 4, 400):
            at = retrieval.best_at(scores, open_, k)
            assert sorted(zip(*at, strict=True)) == sorted(zip(*np.nonzero(retrieval.best_of(scores, open_, k)), strict=True))
    monkeypatch.setattr(retrieval.np, "partition", None)
    assert len(retrieval.best_at(scores, rng.random(scores.shape) < 0.05, 4)[0]) > 9


def test_a_block_of_allowed_questions_is_what_lists_say():
    import numpy as np

    may = retrieval.Allowed(pa.array([4, 7]), np.array([0, 1, 0]), np.array([0, 1, 2]))
    got = may.opened(pa.array([7, None, 4, 5]), np.array([False, False, False, True]), slice(1, 4))
    assert got.tolist() == [[True, False, True], [False, False, True], [False, True, True], [False, False, True]]


def test_relevance_by_class_gives_what_its_pairs_give_without_making_them(spark):
    rng = random.Random(4)
    label = {i: rng.choice([1, 2, 3, None]) for i in range(60)} | {50: 9}
    chunks = spark.createDataFrame([(f"d:{i}", x) for i, x in label.items()], "chunk_id string, class int")
    queries = spark.createDataFrame([(f"d:{i}", label[i]) for i in (0, 1, 2, 3, 50, 51)], "query_id string, class int")
    pairs = chunks.join(queries, "class").where("query_id <> chunk_id").select("query_id", "chunk_id")
    classes = metrics.Classes(queries, chunks, True)
    hits = [spark.createDataFrame([(f"d:{q}", f"d:{c}", n + 1, "s") for q in (0, 1, 2, 3, 50, 51) for n, c in enumerate(rng.sample(range(60), 12))], "query_id string, chunk_id string, rank int, source string") for _ in range(2)]
    same = lambda f: sorted(map(str, f(pairs).collect())) == sorted(map(str, f(classes).collect()))
    assert same(lambda gold: metrics.per_query(queries.select("query_id"), gold, hits[0], (1, 5)))
    assert same(lambda gold: metrics.first_ranks(None, gold, *hits)) and metrics.first_ranks(None, classes, *hits).count() > 2
    assert same(lambda gold: training.hard_negatives(hits, gold, 8))
    grown = spark.range(200_000).select(F.concat(F.lit("d:"), F.col("id").cast("string")).alias("chunk_id"), (F.col("id") % 2).alias("class"))
    wide = metrics.Classes(grown.withColumnRenamed("chunk_id", "query_id"), grown, True)  # 2e10 pairs
    assert {tuple(r) for r in wide.sizes().groupBy("n").count().collect()} == {(99_999, 200_000)}


def test_what_texts_share_is_hashed_once(monkeypatch):
    """As the loop over words and trigrams that it stands for, with odd characters in it."""
    import hashlib

    import numpy as np

    from evispark.operators import encoding

    rng = random.Random(6)
    texts = ["", "a", "ab", "abc", "\ud800x \ud800x", "İİ ß ǅ", "😀😀😀😀 年报", *("".join(rng.choices("abc \nÄ年😀", k=rng.randrange(60))) for _ in range(600)), "ab cd " * 2000]
    plain = np.zeros((len(texts), 16), np.float32)
    for row, text in zip(plain, texts, strict=True):
        text = text[:500].lower()
        for feature in [*text.split(), *(text[i : i + 3] for i in range(len(text) - 2))]:
            h = int.from_bytes(hashlib.blake2b(feature.encode(errors="replace"), digest_size=8).digest(), "little")
            row[h % 16] += 1 if h >> 63 else -1
    norm = np.sqrt((plain**2).sum(axis=1, keepdims=True))
    hashed, blake2b = [], hashlib.blake2b
    monkeypatch.setattr(hashlib, "blake2b", lambda x, **k: hashed.append(x) or blake2b(x, **k))
    assert (encoding.HashEncoder(16, 500).documents(texts) == plain / np.where(norm > 0, norm, 1)).all()
    assert len(hashed) < 4000  # of 38,000 words and trigrams


def test_a_step_of_the_split_reads_its_window_once(spark):
    """An expression in a fold is computed wherever it stands: windows that stand in it once are cut once."""
    from evispark.operators import chunking

    plan = spark.createDataFrame([("x",)], "t string").select(chunking.split_long(F.col("t"), 60, 11))._jdf.queryExecution().analyzed().toString()
    assert plan.count("substring(t#") == 1
