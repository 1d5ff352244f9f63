"""Context budgets, model choice, token ledgers and costs."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.text import has_any


#: Words that make a question hard, by reason (fixed values).
PERIODS, SUMS, GRANULARITY = ("跨年", "分别", "相比", "变化"), ("计算", "变化率", "增长率", "减少", "增加"), ("季度", "半年度", "年度", "全年")


def choose_model(query: Column, rounds: Column, evidence: Column, policy: str = "adaptive") -> Column:
    """A struct of model, reason and score: two points or more ask for the large model; the policy always_large asks for it always."""
    if policy not in ("adaptive", "always_large"):
        raise ValueError(f"unknown policy {policy}")
    if policy == "always_large":
        return F.struct(F.lit("large").alias("model"), F.lit("baseline_always_large").alias("reason"), F.lit(0).alias("score"))
    years = F.size(F.array_distinct(F.regexp_extract_all(query, F.lit(r"(?U)(20\d{2})"), F.lit(1))))
    tests = (
        ((years >= 2) | has_any(query, PERIODS), 2, "multi_period"),
        (has_any(query, SUMS), 2, "calculation"),
        (has_any(query, GRANULARITY), 1, "time_granularity"),
        (rounds > 1, 2, "retrieval_escalated"),
        (evidence > 10, 1, "many_evidence_chunks"),
    )
    score = sum((F.when(test, points).otherwise(0) for test, points, _ in tests), F.lit(0))
    reason = F.concat_ws("+", *(F.when(test, name) for test, _, name in tests))
    large = score >= 2
    return F.struct(F.when(large, "large").otherwise("small").alias("model"), F.when(large, reason).otherwise("single_fact_sufficient_evidence").alias("reason"), score.alias("score"))


def checked(usage: DataFrame) -> DataFrame:
    """The usage rows; a negative count or cost, or more cached than input tokens, is an error."""
    counts = [c for c in usage.columns if c.endswith("_tokens") or c in ("calls", "cost")]
    wrong = F.lit(False)
    for c in counts:
        wrong = wrong | F.coalesce(F.col(c) < 0, F.lit(False))
    wrong = wrong | F.coalesce(F.col("cached_tokens") > F.col("input_tokens"), F.lit(False))
    return usage.withColumn("input_tokens", F.when(wrong, F.raise_error(F.lit("token usage is negative, or more is cached than was put in"))).otherwise(F.col("input_tokens")))


def cost(inputs: Column, outputs: Column, cached: Column, rate_in: Column, rate_cached: Column, rate_out: Column) -> Column:
    """US dollars by rates for a million tokens; null without an input and an output rate. Cached tokens count up to the input; negative counts are an error."""
    reused = F.least(cached, inputs)
    return F.when(F.least(inputs, outputs, cached) < 0, F.raise_error(F.lit("token counts cannot be negative")).cast("double")).otherwise((inputs - reused) * rate_in + reused * F.coalesce(rate_cached, rate_in) + outputs * rate_out) / 1_000_000


def totals(usage: DataFrame, by: str | None = None) -> DataFrame:
    """Sums of a ledger (input_tokens, output_tokens, cached_tokens, cost, and calls if it has them, else one each); the cost is null if any entry has none."""
    calls = F.sum("calls") if "calls" in usage.columns else F.count("*")
    return (usage.groupBy(by) if by else usage.groupBy()).agg(
        F.count("*").alias("entries"), F.sum("input_tokens").alias("input_tokens"), F.sum("output_tokens").alias("output_tokens"),
        F.sum(F.col("input_tokens") + F.col("output_tokens")).alias("total_tokens"), F.sum("cached_tokens").alias("cached_tokens"), calls.alias("calls"),
        F.when(F.count("cost") == F.count("*"), F.sum("cost")).alias("cost"),
        F.coalesce(F.try_divide(F.count("cost").cast("double"), F.count("*").cast("double")), F.lit(0.0)).alias("price_coverage"),
    )


def usage_from_json(raw: Column) -> Column:
    """A struct of input, output and cached tokens from a provider's usage object under either of its key names."""
    parsed = F.from_json(raw, "prompt_tokens long, input_tokens long, completion_tokens long, output_tokens long, prompt_tokens_details struct<cached_tokens: long>, input_tokens_details struct<cached_tokens: long>")
    return F.struct(
        F.coalesce(parsed["prompt_tokens"], parsed["input_tokens"], F.lit(0)).alias("input_tokens"),
        F.coalesce(parsed["completion_tokens"], parsed["output_tokens"], F.lit(0)).alias("output_tokens"),
        F.coalesce(parsed["prompt_tokens_details"]["cached_tokens"], parsed["input_tokens_details"]["cached_tokens"], F.lit(0)).alias("cached_tokens"),
    )
