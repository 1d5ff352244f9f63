"""Token counters and encoders as slots: contexts packed by real tokenizers, vectors kept by content."""

import random

import numpy as np
import pytest
from pyspark.sql import functions as F

from evispark.functions import counters
from evispark.operators import context, encoding, loop, retrieval
from evispark.sources import shared

random.seed(9)
HITS = "query_id int, rank int, chunk_id string, company string, year int, page int, section string, text string"


def passage():
    return " ".join(random.choice(("营业收入", "revenue", "naïve", "1,234", "研发投入", "a", "\n")) for _ in range(random.randint(0, 60)))


def all_counters():
    import public_tokenizers as P

    return [counters.Characters(), counters.Words(), counters.SentencePiece.of(P.path("piece_bpe_32k.model")), counters.Tokenizer.of(P.path("byte_bpe_50k.json"))]


def packed(query, rows, counter, top_k, most, spans):
    """A plain loop over one question's hits."""
    head = lambda r: f"[chunk_id={r[2]};company={r[3]};year={r[4]};page={r[5]};section={r[6]}]\n"
    rows, used, kept = rows[:top_k], 0, []
    n = lambda t: counter.counts([t])[0]
    for r in rows:
        body = spans[r[2]] if spans else r[7]
        gap = n("\n\n") if kept else 0
        if most is not None and used + gap + n(head(r) + body) > most:
            left = most - used - gap - n(head(r))
            body = counter.cut(body, left) if left > 0 else ""
            if not body:
                continue
        kept.append((r[2], head(r) + body, body))
        used += gap + n(head(r) + body)
        if most is not None and used >= most:
            break
    before, text = n("\n\n".join(head(r) + r[7] for r in rows)), "\n\n".join(k[1] for k in kept)
    return text, [k[0] for k in kept], [k[2] for k in kept], len(rows), len(kept), before, n(text), n(text) < before


@pytest.mark.parametrize("spans", [False, True])
def test_contexts_by_real_tokenizers(spark, spans):
    rows = [(q, i + 1, f"c{q}-{i}", "甲", 2024, None, "s", passage()) for q in range(6) for i in range(7)]
    hits = spark.createDataFrame(rows, HITS).repartition(3)
    queries = spark.createDataFrame([(q, "甲2024年营业收入是多少") for q in range(6)], "query_id int, query string")
    shown = {r.chunk_id: r.s for r in hits.select("chunk_id", context.span(F.col("text"), F.lit("甲2024年营业收入是多少")).alias("s")).collect()} if spans else None
    for counter in all_counters():
        for most in (None, 40, 90, 400):
            got = {r.query_id: r for r in context.build(hits, queries, spans, 5, most, counter=counter).collect()}
            for q in range(6):
                wanted = packed("", [tuple("None" if x is None else x for x in r) for r in rows if r[0] == q], counter, 5, most, shown)
                assert tuple(got[q])[1:9] == wanted, (counter.name, most)


def test_characters_as_an_object_and_as_expressions(spark):
    rows = [(1, i + 1, f"c{i}", "甲", 2024, 3, "s", passage()) for i in range(6)]
    hits, queries = spark.createDataFrame(rows, HITS), spark.createDataFrame([(1, "x")], "query_id int, query string")
    for most in (60, 200, None):
        assert context.build(hits, queries, max_tokens=most).collect() == context.build(hits, queries, max_tokens=most, counter=counters.Characters()).collect()


def test_counts_of_a_column_and_of_messages(spark):
    for counter in all_counters():
        texts = ["", "a  b\tc", "营业收入 12", counters.flattened([{"role": "system", "content": "s"}, {"role": "user", "content": "问题"}])]
        df = spark.createDataFrame([(t,) for t in texts] + [(None,)], "t string").coalesce(1)
        assert [r.n for r in df.select(counters.count(counter, F.col("t")).alias("n")).collect()] == [*counter.counts(texts), 0]
    assert counters.flattened([{"role": "user", "content": "x"}]) == "<user>\nx\n<assistant>\n"


def test_texts_are_encoded_once(spark, tmp_path):
    encoder, path = encoding.HashEncoder(16), f"{tmp_path}/cache"
    rows = [(i, None if i == 7 else f"text {i % 20}", "k") for i in range(60)]
    chunks = spark.createDataFrame(rows, "chunk_id int, text string, other string").repartition(3)
    first, n = encoding.encoded(chunks, encoder, path)
    assert n == 21 and first.columns == ["chunk_id", "other", "vector"]
    wanted = encoder.documents([t or "" for _, t, _ in rows])
    got = {r.chunk_id: r.vector for r in first.collect()}
    assert len(got) == 60 and all(np.allclose(got[i], wanted[i]) for i in got)

    class Never(encoding.HashEncoder):
        def documents(self, texts):
            raise AssertionError("a text that is known is encoded again")

    again, n = encoding.encoded(chunks, Never(16), path)
    assert n == 0 and {r.chunk_id: r.vector for r in again.collect()} == got
    more = chunks.union(spark.createDataFrame([(99, "new", "k"), (98, "new", "k")], chunks.schema))
    assert encoding.encoded(more, encoder, path)[1] == 1 and encoding.encoded(more, encoder, path)[0].count() == 62
    assert encoding.encoded(chunks.limit(0), encoder, f"{tmp_path}/none")[0].collect() == []
    assert encoding.cache_path(spark, encoder) != encoding.cache_path(spark, encoding.HashEncoder(16, 100)) != encoding.cache_path(spark, encoding.HashEncoder(32))


def test_a_failing_encoder_adds_nothing(spark, tmp_path):
    class Wrong(encoding.HashEncoder):
        def documents(self, texts):
            return np.full((len(texts), self.width), np.nan)

    chunks = spark.createDataFrame([(1, "a")], "chunk_id int, text string")
    with pytest.raises(Exception, match="numbers that are none"):
        encoding.encoded(chunks, Wrong(8), f"{tmp_path}/c")
    assert not shared.exists(spark, f"{tmp_path}/c")
    assert encoding.encoded(chunks, encoding.HashEncoder(8), f"{tmp_path}/c")[1] == 1


def test_dense_search_by_an_encoder(spark, tmp_path):
    encoder = encoding.HashEncoder(64, instruction="find it")
    chunks = spark.createDataFrame([(i, t) for i, t in enumerate(("the cat sat", "a dog barked loudly", "营业收入增长"))], "chunk_id int, text string")
    queries = spark.createDataFrame([(1, "cat sat"), (2, "营业收入")], "query_id int, query string")
    vectors, _ = encoding.encoded(chunks, encoder, f"{tmp_path}/c")
    asked = encoding.encode_queries(queries, encoder)
    assert asked.columns == ["query_id", "query", "query_vector"]
    assert [(r.query_id, r.chunk_id) for r in retrieval.dense(vectors, encoding.encode_queries(queries, encoding.HashEncoder(64)), 1).orderBy("query_id").collect()] == [(1, 0), (2, 2)]


def test_token_replay(spark):
    """Every profile's tokens are those of the messages it would have sent, and no evidence leaves the prompt's note."""
    rows = [(q, i + 1, f"c{q}-{i}", "甲", 2024, None, "s", "营业收入 1,234 " + passage() * 3) for q in range(3) for i in range(4)]
    hits = spark.createDataFrame(rows, HITS)
    items = spark.createDataFrame([(0, "甲2024年营业收入是多少", 1, "answered", "5元"), (1, "甲2023年和2024年营业收入变化", 1, "answered", "6"), (2, "甲2024年营业收入", 3, "refused", None), (3, "甲2024年营业收入", 1, "refused", None)], "query_id int, query string, rounds int, status string, answer string")
    counter, plans = counters.Words(), loop.PROFILES | {"tight": ("adaptive", True, True, 20)}
    got = {(r.profile, r.query_id): r for r in loop.token_replay(items, hits, counter, plans).collect()}
    assert len(got) == 4 * len(plans)
    for name, (policy, spans, compressed, budget) in plans.items():
        packed = {r.query_id: r for r in context.build(hits, items, spans, 10, budget, counter=counter).collect()}
        for item in items.collect():
            own, row = packed.get(item.query_id), got[name, item.query_id]
            system = context.COMPRESSED_PROMPT if compressed else context.FULL_PROMPT
            user = f"问题：{item.query}\n\n证据：\n{own.context if own and own.context else '[无可用证据]'}"
            assert row.input_tokens == counter.counts([counters.flattened([{"role": "system", "content": system}, {"role": "user", "content": user}])])[0]
            assert (row.context_tokens_before, row.context_tokens_after) == ((own.tokens_before, own.tokens_after) if own else (0, 0)) and row.output_tokens == 1
            assert row.model == ("large" if policy == "always_large" or item.query_id in (1, 2) else "small")
    assert got["tight", 0].context_tokens_after < got["baseline", 0].context_tokens_after
