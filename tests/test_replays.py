"""Replays and their differences, leaks of short passages, names in questions, and rounds that resume, against plain versions."""

import random

import pytest
from pyspark.sql import functions as F

from evispark.operators import answering, loop, replays, routing, training
from evispark.sources import shared

CHUNK = "chunk_id string, document_id string, company string, year int, section string, page int, text string"


@pytest.fixture(scope="module")
def chunks(spark):
    text = "主要会计数据和财务指标 单位：千元 营业收入 {}"
    rows = [(f"r{k}-{y}:000{n}", f"r{k}-{y}", f"第{k}公司", y, "s", 10 + n, text.format(f"{1000 * k + y + n:,}") if n == 0 else f"分季度主要财务指标 第一季度 营业收入 {k}") for k in range(4) for y in (2023, 2024) for n in (0, 1)]
    return spark.createDataFrame(rows, CHUNK).cache()


def questions(spark):
    rows = [("g", "第1公司2024年营业收入是多少？", ["r1-2024:0000"], "3,024千元"), ("w", "第2公司2024年营业收入是多少？", ["r2-2024:0001"], "4,024千元"), ("m", "第3公司2023年营业收入是多少？", ["gone"], "x"), ("o", "第1公司1990年营业收入是多少？", [], None)]
    return spark.createDataFrame(rows, "query_id string, query string, relevant_chunk_ids array<string>, expected string")


def test_losses(spark, chunks):
    items = questions(spark).withColumn("expected", F.when(F.col("query_id") == "g", "3,024千元").otherwise(F.col("expected")))
    gold = replays.on_gold(items, chunks).cache()
    told = {r.query_id: (r.status, r.answer) for r in gold.collect()}
    assert told["g"] == ("answered", "3,024千元") and told["w"] == ("answered", "2元") and told["m"][0] == told["o"][0] == "refused"
    path = spark.createDataFrame([("g", "9元"), ("w", "4,024千元")], "query_id string, answer string")
    seen = spark.createDataFrame([("g", "r1-2024:0000"), ("w", "x")], "query_id string, chunk_id string")
    assert {r.query_id: r.loss for r in replays.losses(items, gold, path, seen).collect()} == {"g": "selection", "w": "none", "m": "extraction", "o": "routing"}
    assert {r.query_id: r.loss for r in replays.losses(items, gold, path, seen.where("query_id = 'w'")).collect()}["g"] == "retrieval"
    row = replays.summary(replays.losses(items, gold, path, seen)).first()
    assert (row.questions, row.answer_rate, row.lost_selection, row.lost_routing) == (4, 0.5, 1, 1)


def test_differences(spark):
    kind = "k int, a string, n array<struct<chunk_id: string, page: int, note: struct<x: double>>>, m map<string, int>, tags array<string>"
    before = spark.createDataFrame([(1, "x", [("c", 1, (1.5,)), ("d", None, None)], {"p": 1}, ["s", "t"]), (2, None, None, None, []), (None, "z", [], {}, None), (4, "only", None, None, None)], kind)
    after = spark.createDataFrame([(1, "y", [("d", 3, None), ("c", 1, (2.5,))], {"q": 1}, ["s"]), (2, None, [], {}, None), (None, "z", None, None, []), (5, "new", None, None, None)], kind)
    got = {(r.k, r.path, r.change, r.before, r.after) for r in replays.differences(before, after, ["k"], ["a", "n", "m", "tags"]).collect()}
    assert got == {
        (1, "a", "changed", "x", "y"), (1, "n[c].note.x", "changed", "1.5", "2.5"), (1, "n[d].page", "added", None, "3"), (1, "tags[1]", "removed", "t", None),
        (1, "m[p].key", "removed", "p", None), (1, "m[p].value", "removed", "1", None), (1, "m[q].key", "added", None, "q"), (1, "m[q].value", "added", None, "1"),
        (4, "a", "removed", "only", None), (5, "a", "added", None, "new"),
    }
    assert replays.differences(before, before, ["k"], ["a", "n", "m", "tags"]).collect() == []


def test_answered_again(spark, chunks):
    items = questions(spark).select("query_id", "query")
    saved = spark.createDataFrame([("g", 1, ["r1-2024:0001"], [0.5]), ("g", 2, ["r1-2024:0000", "r1-2024:0001"], [0.9, 0.4])], "query_id string, round_index int, evidence_chunk_ids array<string>, evidence_scores array<double>")
    (row,) = replays.answered_again(saved, items, chunks).collect()
    assert (row.query_id, row.answer) == ("g", "3,024千元")
    assert replays.answered_again(saved, items, chunks, minimum=0.95).first().status == "refused"


def test_leaks_of_any_length(spark):
    rng = random.Random(2)
    texts = ["".join(rng.choice("ab é\n研") for _ in range(rng.randint(0, 40))) for _ in range(60)] + [None, "", "abab", "abab"]
    passages = sorted({t[i : i + n] for t in texts if t for i in range(0, len(t), 5) for n in (1, 2, 3, 7, 20)} | {"zz", "not there at all", "a b a b a b a"}) + [None, ""]
    got = training.leaks(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")).collect()
    assert {r.item_id: r.documents for r in got} == {i: sum(p in t for t in texts if t is not None) if p else 0 for i, p in enumerate(passages)}


def test_names_in_questions(spark):
    names = ["甲", "甲公司", "乙公司", "Long Name Ltd", "x", None, ""]
    documents = spark.createDataFrame([(f"d{i}-{y}", n, y) for i, n in enumerate(names) for y in (2023, 2024)], "document_id string, company string, year int")
    texts = ["甲公司2024年", "乙公司和甲", "Long Name Ltd 2023", "2024", "none", "ax", ""]
    queries = spark.createDataFrame(list(enumerate(texts)), "query_id int, query string")
    got = sorted(map(tuple, routing.allowed(queries, documents).collect()), key=str)
    wanted = set()
    for q, text in enumerate(texts):
        years = {y for y in (2023, 2024) if str(y) in text}
        named = [i for i, n in enumerate(names) if n and n in text]
        found = [(q, f"d{i}-{y}") for i in (named or (range(len(names)) if years else [])) for y in (2023, 2024) if not years or y in years]
        wanted |= set(found) or {(q, None)}
    assert got == sorted(wanted, key=str)


def test_rounds_resume(spark, chunks, tmp_path, monkeypatch):
    """A run that breaks in its second round repeats just that one, and another run of the same path computes nothing."""
    items = spark.createDataFrame([("a", "第1公司2024年营业收入是多少？"), ("b", "第2公司2023年营业收入是多少？"), ("o", "第1公司1990年营业收入是多少？")], "query_id string, query string")
    first = [("a", "r1-2024:0001", 1), ("a", "r1-2024:0000", 2), ("b", "r2-2023:0000", 1)]
    rounds = spark.createDataFrame(first, "query_id string, chunk_id string, round_index int").join(chunks, "chunk_id").withColumns({"score": F.lit(1.0), "source": F.lit("reranker"), "rank": F.lit(1)})
    policies, path, made = ((answering.STATIC, 1), (answering.ADAPTIVE, 3), (answering.ALWAYS, 2)), f"{tmp_path}/run", []
    once = shared.made_once

    def watched(spark, at, make):
        def doing(own):
            made.append(at[-1])
            if made == ["0", "1", "2"]:
                raise RuntimeError("lost")
            make(own)

        return once(spark, at, doing)

    monkeypatch.setattr(shared, "made_once", watched)
    with pytest.raises(RuntimeError):
        loop.run_rounds(items, routing.scope(chunks), rounds, policies, path=path)
    run = loop.run_rounds(items, routing.scope(chunks), rounds, policies, path=path)
    assert made == ["0", "1", "2", "2"]
    again = loop.run_rounds(items, routing.scope(chunks), rounds, policies, path=path)
    assert made == ["0", "1", "2", "2"]
    told = {(r.policy, r.query_id): (r.round_index, r.answer) for r in again.answers.collect()}
    assert told[answering.STATIC, "a"] == (1, "1元") and told[answering.ADAPTIVE, "a"] == (2, "3,024千元") == told[answering.ALWAYS, "a"]
    assert told[answering.ADAPTIVE, "b"] == (1, "4,023千元") and told[answering.ALWAYS, "b"] == (2, "4,023千元") and told[answering.STATIC, "o"][0] == 0
    assert len(told) == 9 and run.steps.count() == 2 + 3 + 4
    assert {(r.policy, r.chunk_id) for r in run.evidence.where("query_id = 'a'").collect()} == {(answering.STATIC, "r1-2024:0001"), (answering.ADAPTIVE, "r1-2024:0000"), (answering.ALWAYS, "r1-2024:0000")}  # the quarter's passage goes once it was cited
