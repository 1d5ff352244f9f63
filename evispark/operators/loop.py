"""Rounds of retrieval under a policy, their cost, replay of saved rounds, and the one-question run."""

from __future__ import annotations

import uuid
from collections.abc import Callable, Sequence
from typing import NamedTuple

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.types import ArrayType

from evispark.functions import counters
from evispark.functions.counters import Counter
from evispark.operators import answering, context, ledger, retrieval, routing
from evispark.sources import shared

#: What a round costs, besides the two times and the two shares of loading a model (each in milliseconds).
COUNTERS = ("dense_queries", "bm25_queries", "reranker_calls", "candidates_retrieved", "passages_reranked", "planner_input_tokens", "planner_output_tokens")
TIMES = ("retrieval_ms", "rerank_ms", "embedding_load_ms", "reranker_load_ms")
QUESTION = ("query_id", "query", "companies", "years", "requested_company", "requires_calculation", "refusal_reason", "task_type", "should_refuse", "message", "fact")
HIT = ("chunk_id", "document_id", "company", "year", "page", "section", "text", "score", "source")


def wall_clock_ms() -> Column:
    """A round's time with its share of what all questions of it loaded."""
    return sum((F.coalesce(F.col(c), F.lit(0.0)) for c in TIMES[1:]), F.coalesce(F.col(TIMES[0]), F.lit(0.0)))


def summarize_usage(steps: DataFrame, by: Sequence[str] = ("policy", "query_id")) -> DataFrame:
    """Rounds and sums of what they cost (COUNTERS, cost_usd, wall_ms) of a table of steps, one row a round."""
    sums = [F.sum(F.coalesce(F.col(c), F.lit(0))).alias(c) for c in (*COUNTERS, "cost_usd")]
    return steps.groupBy(*by).agg(F.count("*").alias("rounds"), *sums, F.sum(wall_clock_ms()).alias("wall_ms"))


class Runs(NamedTuple):
    """answers: policy and the columns of answers() and verify(), a row a policy and question; steps: a row a round of it; evidence: the hits it ended with."""

    answers: DataFrame
    steps: DataFrame
    evidence: DataFrame


def run_rounds(items: DataFrame, corpus: DataFrame, rounds: DataFrame, policies: Sequence[tuple[str, int]], minimum: float = 0.0, confirm: int = 2, path: str | None = None) -> Runs:
    """Runs of all questions under all policies, kept under path: a table a round, a row a question.

    items: (query_id, query); corpus: scope(); rounds: hits by (query_id, round_index); policies: (policy, max_rounds).
    In each round a question's hits are merged with those it has; once its evidence has mixed up years and quarters, it is
    prepared as escalated() does; then it is answered, verified and decided on. What a question finds and answers in a
    round doesn't depend on the policy, which only says whether it goes on: a round is computed once for all policies that
    still run, and its row holds their decisions. A round's table appears when it is complete, and a run that finds tables
    under its path goes on after them, so a lost driver repeats one round. Refused questions end in round 0, without steps.
    """
    spark = items.sparkSession
    path = path or shared.path_of(spark, "rounds", uuid.uuid4().hex)
    none = rounds.limit(0).select("query_id", *HIT, F.lit(0).alias("rank"))
    kind = rounds.select(F.struct(F.lit(0).alias("rank"), *HIT)).schema[0].dataType
    pending = F.array(*(F.struct(F.lit(p).alias("policy"), F.lit(n).alias("max_rounds")) for p, n in policies))

    def refuse(own: str) -> None:
        routed = routing.route(items, corpus)
        rows = answering.answers(routed.withColumn("mixed_up", F.lit(False)), _no_evidence(none))
        rows = rows.withColumns({"assessment": F.lit("terminal_refusal"), "reasons": F.array("reason"), "confidence": F.lit(1.0), "selected_chunk_ids": F.array().cast("array<string>"), "round_index": F.lit(0)})
        refused = F.struct(F.when(F.col("should_refuse"), "stop").otherwise("retrieve_more").alias("action"), F.lit("terminal_refusal").alias("reason"))
        _decided(rows.withColumn("hits", F.array().cast(ArrayType(kind))), pending, lambda p: refused).write.parquet(own)

    def one_round(own: str, turn: int) -> None:
        before = spark.read.parquet(f"{path}/round-{turn - 1}").where(F.exists("decisions", lambda d: d["action"] != "stop"))
        running = F.transform(F.filter("decisions", lambda d: d["action"] != "stop"), lambda d: F.struct(d["policy"].alias("policy"), d["max_rounds"].alias("max_rounds")))
        active = before.select(*asked, "mixed_up", running.alias("pending"))
        held = before.select("query_id", F.explode("hits").alias("h")).select("query_id", *(F.col(f"h.{c}").alias(c) for c in (*HIT, "rank")))
        new = rounds.where(F.col("round_index") == turn).join(active.select("query_id"), "query_id", "left_semi").select("query_id", *HIT, "rank")
        merged = retrieval.merge(held, new)
        if turn > 1:
            flagged = active.where("mixed_up").select("query_id")
            merged = merged.join(flagged, "query_id", "left_anti").unionByName(answering.escalated(merged.join(flagged, "query_id", "left_semi"), active))
        merged.groupBy("query_id").agg(F.array_sort(F.collect_list(F.struct("rank", *HIT))).alias("hits")).write.parquet(f"{own}-hits")
        hits = spark.read.parquet(f"{own}-hits")
        merged = hits.select("query_id", F.explode("hits").alias("h")).select("query_id", *(F.col(f"h.{c}").alias(c) for c in (*HIT, "rank")))
        answering.evidence(active.select(*asked), merged, minimum).write.parquet(f"{own}-chosen")  # answers and their verification both read it
        chosen = spark.read.parquet(f"{own}-chosen")
        judged = answering.verify(answering.answers(active, chosen), chosen, F.lit(turn), confirm).withColumn("round_index", F.lit(turn))
        judged = judged.withColumn("mixed_up", F.col("mixed_up") | F.array_contains("reasons", "annual_quarter_mismatch"))
        rows = judged.join(hits, "query_id", "left").withColumn("hits", F.coalesce("hits", F.array().cast(ArrayType(kind))))
        _decided(rows, F.col("pending"), lambda p: answering.decide(F.col("assessment"), p["policy"], F.lit(turn), p["max_rounds"])).drop("pending").write.parquet(own)
        for made in ("hits", "chosen"):
            shared.delete(spark, f"{own}-{made}")

    shared.made_once(spark, f"{path}/round-0", refuse)
    done = [spark.read.parquet(f"{path}/round-0")]
    asked = [c for c in done[0].columns if c in QUESTION]
    for turn in range(1, max(n for _, n in policies) + 1):
        if done[-1].where(F.exists("decisions", lambda d: d["action"] != "stop")).isEmpty():
            break
        shared.made_once(spark, f"{path}/round-{turn}", lambda own, turn=turn: one_round(own, turn))
        done.append(spark.read.parquet(f"{path}/round-{turn}"))
    rows = done[0]
    for more in done[1:]:
        rows = rows.unionByName(more)
    each = rows.withColumn("d", F.explode("decisions")).withColumns({"policy": F.col("d.policy"), "max_rounds": F.col("d.max_rounds"), "action": F.col("d.action"), "action_reason": F.col("d.reason")}).drop("d", "decisions")
    ended = each.where("action = 'stop'")
    steps = each.where("round_index > 0").select(
        "policy", "query_id", "round_index", F.transform("hits", lambda h: h["chunk_id"]).alias("evidence_chunk_ids"), F.transform("hits", lambda h: h["score"]).alias("evidence_scores"),
        F.col("status").alias("answer_status"), F.col("reason").alias("answer_reason"), F.col("assessment").alias("assessment_status"), F.col("reasons").alias("assessment_reasons"), "action", "action_reason",
    )
    evidence = ended.select("policy", "query_id", F.explode("hits").alias("h")).select("policy", "query_id", *(F.col(f"h.{c}").alias(c) for c in (*HIT, "rank")))
    return Runs(ended.drop("hits", "mixed_up"), steps, evidence)


def _decided(rows: DataFrame, pending: Column, decide: Callable[[Column], Column]) -> DataFrame:
    """rows with decisions: those of each pending policy on its question."""
    one = lambda p: F.struct(p["policy"].alias("policy"), p["max_rounds"].alias("max_rounds"), decide(p)["action"].alias("action"), decide(p)["reason"].alias("reason"))
    return rows.withColumn("decisions", F.transform(pending, one))


def _no_evidence(hits: DataFrame) -> DataFrame:
    """evidence() of no hits."""
    asked = hits.select("query_id", F.lit("").alias("query"), F.array().cast("array<string>").alias("companies"), F.array().cast("array<int>").alias("years"), F.lit(True).alias("should_refuse"))
    return answering.evidence(asked, hits)


def details(answers: DataFrame, evidence: DataFrame, labels: DataFrame, by: Sequence[str] = ("policy", "query_id")) -> DataFrame:
    """What the metrics are computed from: each answer with its label (query_id, group, expected, gold, pages).

    exact, refusal_correct, gold_found, citations, correct_citations, pages_match; gold and pages are arrays.
    """
    found = evidence.groupBy(*by).agg(F.collect_set("chunk_id").alias("__found"))
    rows = answers.join(labels, "query_id").join(found, list(by), "left")
    empty = F.array().cast("array<string>")
    cited = F.coalesce(F.transform("citations", lambda c: c["chunk_id"].cast("string")), empty)
    pages = F.coalesce(F.filter(F.transform("citations", lambda c: c["page"].cast("int")), lambda p: p.isNotNull()), F.array().cast("array<int>"))
    gold = F.transform("gold", lambda g: g.cast("string"))
    return rows.select(
        *by, "group", "status", "reason", "answer", "expected", F.coalesce(F.col("answer") == F.col("expected"), F.col("answer").isNull() & F.col("expected").isNull()).alias("exact"),
        ((F.col("group") == "hard_no_answer_dev") & (F.col("status") == "refused")).alias("refusal_correct"),
        (F.size(F.array_except(gold, F.coalesce("__found", empty))) == 0).alias("gold_found"), F.size(cited).alias("citations"),
        F.size(F.filter(cited, lambda c: F.array_contains(gold, c))).alias("correct_citations"), (F.array_sort(pages) == F.array_sort(F.transform("pages", lambda p: p.cast("int")))).alias("pages_match"),
    )


def reconstruct(trajectories: DataFrame, chunks: DataFrame) -> DataFrame:
    """Hits of saved runs: trajectories (query_id, round_index, evidence_chunk_ids, evidence_scores), the last round's ids in order.

    A chunk's score is the last that any round gave it; chunks that are gone are left out, ranks stay.
    """
    scored = trajectories.select("query_id", "round_index", F.posexplode(F.arrays_zip("evidence_chunk_ids", "evidence_scores")).alias("pos", "hit"))
    scores = scored.groupBy("query_id", F.col("hit.evidence_chunk_ids").alias("chunk_id")).agg(F.max_by(F.col("hit.evidence_scores").cast("double"), "round_index").alias("score"))
    final = trajectories.groupBy("query_id").agg(F.max_by("evidence_chunk_ids", "round_index").alias("ids")).select("query_id", F.posexplode("ids").alias("pos", "chunk_id"))
    rows = final.join(scores, ["query_id", "chunk_id"], "left").join(chunks, "chunk_id")
    return rows.withColumns({"rank": F.col("pos") + 1, "score": F.coalesce("score", F.lit(0.0)), "source": F.lit("reranker")}).select("query_id", *HIT, "rank")


def profiles(tasks: DataFrame, multipliers: dict[str, float], input_weight: float, output_weight: float) -> DataFrame:
    """Tokens and normalized cost of each profile's tasks (profile, model, input_tokens, output_tokens): a token's weight times its model's multiplier."""
    multiplier = F.element_at(F.create_map(*(F.lit(x) for pair in multipliers.items() for x in pair)), F.col("model"))
    units = multiplier * (F.col("input_tokens") * input_weight + F.col("output_tokens") * output_weight)
    return tasks.groupBy("profile").agg(
        F.count("*").alias("tasks"), F.count_if(F.col("model") == "small").alias("small"), F.count_if(F.col("model") == "large").alias("large"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.sum(units).alias("normalized"),
    )


#: What each profile of a token replay does: model policy, evidence spans, compressed prompt, and the context's budget where it has one.
PROFILES = {
    "baseline": ("always_large", False, False, None), "routing": ("adaptive", False, False, None), "prompt": ("always_large", False, True, None),
    "context": ("always_large", True, False, 1200), "combined": ("adaptive", True, True, 1200),
}


def token_replay(items: DataFrame, hits: DataFrame, counter: Counter, profiles: dict[str, tuple] = PROFILES, top_k: int = 10) -> DataFrame:
    """(profile, query_id, model, reason, context_tokens_before, context_tokens_after, input_tokens, output_tokens) of saved runs, as each profile would have asked them.

    items: (query_id, query, rounds, status, answer); hits: what each question ended with, as for context.build().
    A profile packs the evidence, makes the prompt and picks the model; its input is the counter's tokens of the messages, its output those of
    the saved answer as JSON: nothing is generated. A question without evidence has the prompt's note in its place.
    """
    parts, sizes = [], hits.groupBy("query_id").agg(F.count("*").alias("__hits"))
    for name, (policy, spans, compressed, budget) in profiles.items():
        packed = context.build(hits, items, spans, top_k, budget, counter=counter).select("query_id", "context", "tokens_before", "tokens_after")
        rows = items.join(packed, "query_id", "left").join(sizes, "query_id", "left")
        asked = context.prompt(F.col("query"), F.col("context"), compressed)
        messages = F.concat(F.lit("<system>\n"), asked["system"], F.lit("\n<user>\n"), asked["user"], F.lit("\n<assistant>\n"))
        told = F.to_json(F.struct("status", "answer"), {"ignoreNullFields": "false"})
        model = ledger.choose_model(F.col("query"), F.col("rounds"), F.coalesce("__hits", F.lit(0)), policy)
        rows = rows.select("query_id", model["model"].alias("model"), model["reason"].alias("reason"), F.coalesce("tokens_before", F.lit(0)).alias("context_tokens_before"), F.coalesce("tokens_after", F.lit(0)).alias("context_tokens_after"), messages.alias("__in"), told.alias("__out"))
        parts.append(rows.withColumn("profile", F.lit(name)))
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    out = out.withColumn("input_tokens", counters.count(counter, F.col("__in"))).withColumn("output_tokens", counters.count(counter, F.col("__out")))
    return out.select("profile", "query_id", "model", "reason", "context_tokens_before", "context_tokens_after", "input_tokens", "output_tokens")


def search(queries: DataFrame, chunks: DataFrame, vectors: DataFrame | None = None, scorer: Column | None = None, candidates: int = 50, reranked: int = 20, top_k: int = 10, bm25_weight: float = 10.0) -> DataFrame:
    """Hits of each question: BM25 of the expanded question and, if vectors and question vectors are given, dense search, fused, filtered by metadata, reranked.

    queries (query_id, query, and query_vector where vectors (chunk_id, vector) are given). The scorer is an expression or
    pandas UDF over query and text; by default the share of the question's tokens that a passage holds.
    """
    documents = chunks.select("document_id", "company", "year").distinct()
    may = routing.allowed(queries, documents)
    rankings = [retrieval.bm25(chunks, queries.withColumn("query", routing.expand(F.col("query"))), candidates, allowed=may)]
    weights = [bm25_weight]
    if vectors is not None:
        placed = vectors.select("chunk_id", "vector").join(chunks.select("chunk_id", "document_id"), "chunk_id")
        rankings, weights = [retrieval.dense(placed, queries.select("query_id", "query_vector"), candidates, allowed=may), *rankings], [1.0, *weights]
    fused = retrieval.fuse(rankings, candidates, weights).where(F.col("rank") <= reranked)
    hits = fused.join(queries.select("query_id", "query"), "query_id").join(chunks, "chunk_id")
    ranked = retrieval.rerank(hits, scorer if scorer is not None else retrieval.overlap(F.col("query"), F.col("text")), top_k)
    return ranked.select("query_id", *HIT, "rank")


def ask(spark: SparkSession, query: str, chunks: DataFrame, minimum: float = 0.0, **options) -> DataFrame:
    """One row: the answer to one question over a corpus, a batch of one. A question out of scope retrieves nothing."""
    if len(query.strip()) < 2 or len(query) > 500:
        raise ValueError("a question has 2 to 500 characters")
    asked = spark.createDataFrame([("q", query)], "query_id string, query string")
    routed = routing.route(asked, routing.scope(chunks))
    hits = search(routed.where("not should_refuse").select("query_id", "query"), chunks, **options)
    return answering.answers(routed, answering.evidence(routed, hits, minimum)).select("query", "status", "answer", "reason", "task_type", "companies", "years", "citations", "calculation")
