"""Answers from evidence, their verification, and the decision to retrieve more, for all questions at once."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions.facts import by_fact, constrained, entails, extract, fact_of, marker_hits
from evispark.functions.text import has_any, last_position, normalize, rejoin_chinese

#: Headings that tell quarterly from annual figures (fixed values).
QUARTER_QUERY = ("季度", "第一季度", "第二季度", "第三季度", "第四季度", "Q1", "Q2", "Q3", "Q4")
QUARTER = ("分季度主要财务指标", "第一季度", "第二季度", "第三季度", "第四季度")
ANNUAL = ("主要会计数据和财务指标", "合并利润表", "合并现金流量表", "本年发生额")


def change(old: Column, new: Column) -> tuple[Column, Column]:
    """(difference, per cent of the old value's size; null for an old value of 0)."""
    return new - old, F.when(old != 0, (new - old) / F.abs(old) * 100)


def format_decimal(value: Column, places: int | None = None, digits: Column | None = None) -> Column:
    """With thousands' commas and as many decimals as the type has, or as `digits` says, or rounded to `places`, half to even.

    The sign of values between -1 and 0 is lost, as int() loses it.
    """
    text = value.cast("string") if places is None else F.bround(value, places).cast(f"decimal(38,{places})").cast("string")
    whole = F.format_number(F.substring_index(text, ".", 1).cast("decimal(38,0)"), 0)
    decimals = F.when(text.contains("."), F.substring_index(text, ".", -1)).otherwise("")
    if digits is not None:
        decimals = F.substring(F.rpad(decimals, 38, "0"), F.lit(1), digits)
    return F.when(decimals != "", F.concat(whole, F.lit("."), decimals)).otherwise(whole)


def decimals_of(value_text: Column) -> Column:
    """How many decimals a number as written has."""
    return F.length(F.regexp_extract(value_text, r"^-?[\d,]*\.(\d+)", 1))


def _fact(routed: DataFrame) -> Column:
    """What a question asks for: a column of routed where that has been found out before."""
    return F.col("fact") if "fact" in routed.columns else fact_of(F.col("query"))


def evidence(routed: DataFrame, hits: DataFrame, minimum: float = 0.0, enforce: bool = True) -> DataFrame:
    """The best extracted value of each (query_id, year): most section markers, then the first page, the score, the first rank.

    routed comes from route(), hits are (query_id, chunk_id, document_id, company, year, page, section, text, score, rank, source).
    """
    rows = hits.join(routed.select("query_id", "query", "companies", "years", "should_refuse", *(["fact"] if "fact" in routed.columns else [])), "query_id").withColumn("fact", _fact(routed))
    rows = rows.where(~F.col("should_refuse") & F.col("fact").isNotNull())
    rows = rows.where((F.size("companies") == 0) | F.array_contains("companies", F.col("company")))
    rows = rows.where((F.size("years") == 0) | F.array_contains("years", F.col("year").cast("int")))
    rows = rows.where((F.col("source") != "reranker") | (F.col("score") >= minimum))
    if enforce:
        rows = rows.where(entails(F.col("text"), F.col("query"), F.col("fact")))
    rows = rows.withColumn("value", extract(F.col("text"), F.col("fact"))).where(F.col("value").isNotNull())
    order = W.partitionBy("query_id", "year").orderBy(marker_hits(F.col("text"), F.col("fact")).desc(), F.coalesce("page", F.lit(10**9)), F.desc("score"), "rank")
    best = rows.withColumn("__n", F.row_number().over(order)).where("__n = 1")
    return best.select("query_id", "fact", "chunk_id", "document_id", "company", "year", "page", "section", "text", "value.*")


#: What a refusal says, by its reason (fixed values); those of questions out of scope come from the route.
REFUSALS = {
    "unsupported_fact": "当前受控回答器尚不支持该问题所需的财务字段。",
    "incomplete": "没有找到同时满足公司、年份、字段和页码要求的完整证据，因此拒绝作答。",
    "insufficient_evidence": "没有找到可核验的字段数值与页码证据，因此拒绝作答。",
    "incompatible_units": "证据中的单位不一致，无法进行可靠计算。",
}


def answers(routed: DataFrame, found: DataFrame) -> DataFrame:
    """routed with status, answer (of a refusal, its message), reason, citations, calculation; found comes from evidence()."""
    one = F.struct("year", "value_text", "numeric_value", "unit", "chunk_id", "document_id", "company", "page", "quote")
    by = found.groupBy("query_id").agg(F.array_sort(F.collect_list(one)).alias("values"))
    rows = routed.join(by, "query_id", "left").withColumn("fact", _fact(routed))
    values, first, last = F.col("values"), F.col("values")[0], F.element_at("values", -1)
    several = F.coalesce(F.size("values") > 1, F.lit(False))
    missing = F.size(F.array_except("years", F.coalesce(F.transform("values", lambda v: v["year"].cast("int")), F.array().cast("array<int>")))) > 0
    calculate = F.col("requires_calculation") & several
    reason = (
        F.when(F.col("should_refuse"), F.col("refusal_reason")).when(F.col("fact").isNull(), "unsupported_fact").when(missing | values.isNull(), "insufficient_evidence")
        .when(calculate & (first["unit"] != last["unit"]), "incompatible_units")
    )
    listed = F.when(several, F.array_join(F.transform("values", lambda v: F.concat(v["year"].cast("string"), F.lit("年"), v["value_text"])), "；")).otherwise(first["value_text"])
    difference, percent = change(first["numeric_value"], last["numeric_value"])
    rate = F.coalesce(format_decimal(percent, 2), F.lit("无法计算"))
    worked = F.when(calculate, F.concat(last["year"].cast("string"), F.lit("年-"), first["year"].cast("string"), F.lit("年："), last["value_text"], F.lit("-"), first["value_text"], F.lit("="), format_decimal(difference, digits=F.greatest(decimals_of(first["value_text"]), decimals_of(last["value_text"]))), first["unit"], F.lit("，变化率="), rate, F.lit("%")))
    told = F.when(F.col("should_refuse"), F.col("message")).when(missing & (F.col("reason") == "insufficient_evidence"), REFUSALS["incomplete"])
    message = told.when(F.col("reason") == "unsupported_fact", REFUSALS["unsupported_fact"]).when(F.col("reason") == "incompatible_units", REFUSALS["incompatible_units"]).otherwise(REFUSALS["insufficient_evidence"])
    rows = rows.withColumn("reason", reason).withColumn("calculation", F.when(F.col("reason").isNull(), worked))
    return (
        rows.withColumn("status", F.when(F.col("reason").isNull(), "answered").otherwise("refused"))
        .withColumn("answer", F.when(F.col("reason").isNull(), F.concat_ws("；", listed, "calculation")).otherwise(message))
        .withColumn("citations", F.when(F.col("reason").isNull(), F.transform("values", lambda v: F.struct(v["chunk_id"].alias("chunk_id"), v["document_id"].alias("document_id"), v["company"].alias("company"), v["year"].alias("year"), v["page"].alias("page"), v["quote"].alias("quote")))))
        .drop("values")
    )


def expects_annual(query: Column, years: Column) -> Column:
    return (F.size(years) > 0) & ~has_any(query, QUARTER_QUERY)


def quarter_only(section: Column, text: Column) -> Column:
    whole = F.concat_ws(" ", section, text)
    return has_any(whole, QUARTER) & ~has_any(whole, ANNUAL)


def cites_quarter(section: Column, text: Column, quote: Column, fact: Column) -> Column:
    """Whether the last heading before the cited label is a quarter's; without the label, the last one in section and quote."""
    plain = normalize(text)
    start = F.instr(plain, quote)
    label = F.call_function("regexp_instr", quote, by_fact(fact, lambda f: "(?U)" + f.label))
    context = F.when((start > 0) & (label > 0), F.substring(plain, F.lit(1), start + label - 2)).otherwise(F.concat_ws(" ", section, quote))
    return last_position(context, QUARTER) > last_position(context, ANNUAL)


def verify(answered: DataFrame, found: DataFrame, round_index: Column, confirm: int = 2) -> DataFrame:
    """answered with assessment (status), reasons, confidence and selected_chunk_ids (those cited, none of a refusal) of a round."""
    if confirm < 1:
        raise ValueError("confirm must be positive")
    cited = found.groupBy("query_id").agg(
        F.collect_set("company").alias("__companies"), F.collect_set(F.col("year").cast("int")).alias("__years"),
        F.max(cites_quarter(F.col("section"), F.col("text"), F.col("quote"), F.col("fact"))).alias("__quarter"), F.array_sort(F.collect_set("chunk_id")).alias("__chunks"),
    )
    rows = answered.join(cited, "query_id", "left")
    refused, empty = F.col("status") == "refused", F.array().cast("array<string>")
    terminal = F.col("should_refuse") | (refused & F.col("reason").isin("unsupported_fact", "incompatible_units"))
    confirmed = refused & F.coalesce(constrained(F.col("query"), F.col("fact")), F.lit(False)) & (round_index >= confirm)
    lacks = F.array_compact(
        F.array(
            F.when(F.col("__companies").isNull(), "missing_citation_evidence"),
            F.when(F.size(F.array_except("companies", F.coalesce("__companies", empty))) > 0, "missing_company_coverage"),
            F.when(F.size(F.array_except("years", F.coalesce("__years", F.array().cast("array<int>")))) > 0, "missing_year_coverage"),
            F.when(expects_annual(F.col("query"), F.col("years")) & F.coalesce("__quarter", F.lit(False)), "annual_quarter_mismatch"),
        )
    )
    reasons = (
        F.when(terminal, F.array("reason")).when(confirmed, F.array(F.lit("constraint_not_disclosed_after_confirmation"))).when(refused, F.array("reason"))
        .when(F.size(lacks) > 0, lacks).otherwise(F.array(F.lit("answer_supported_by_complete_evidence")))
    )
    status = F.when(terminal | confirmed, "terminal_refusal").when(refused | (F.size(lacks) > 0), "insufficient").otherwise("sufficient")
    confidence = F.when(terminal, 1.0).when(confirmed, 0.9).when(refused, 0.2).when(F.size(lacks) > 0, 0.1).otherwise(1.0)
    selected = F.when(refused, empty).otherwise(F.coalesce("__chunks", empty))
    return rows.withColumns({"assessment": status, "reasons": reasons, "confidence": confidence, "selected_chunk_ids": selected}).drop("__companies", "__years", "__quarter", "__chunks")


def escalated(hits: DataFrame, routed: DataFrame) -> DataFrame:
    """Hits for a later round: quarterly passages go where the question is about years, line breaks within Chinese text are undone."""
    rows = hits.join(routed.select("query_id", "query", "years"), "query_id")
    rows = rows.where(~expects_annual(F.col("query"), F.col("years")) | ~quarter_only(F.col("section"), F.col("text")))
    text = F.replace(rejoin_chinese(F.col("text")), F.lit("归属于母公司股东的净利润"), F.lit("归属于上市公司股东的净利润"))
    return rows.withColumn("text", text).select(*hits.columns)


#: The policies: one round, all rounds, as many as the evidence needs (fixed values).
STATIC, ALWAYS, ADAPTIVE = "static_rag", "always_agentic", "adaptive_budget_aware"


def decide(assessment: Column, policy: Column, round_index: Column, max_rounds: Column) -> Column:
    """A struct of action and reason; an unknown policy or a budget without a round is an error."""
    step = lambda action, reason: F.struct(F.lit(action).alias("action"), F.lit(reason).alias("reason"))
    chosen = (
        F.when(assessment == "terminal_refusal", step("stop", "terminal_refusal"))
        .when(round_index >= max_rounds, step("stop", "round_budget_exhausted"))
        .when(policy == STATIC, step("stop", "static_single_round_policy"))
        .when(policy == ALWAYS, step("retrieve_more", "always_agentic_forced_escalation"))
        .when(assessment == "insufficient", step("retrieve_more", "evidence_insufficient"))
        .otherwise(step("stop", "adaptive_evidence_sufficient"))
    )
    known = F.coalesce(policy.isin(STATIC, ALWAYS, ADAPTIVE), F.lit(False))
    kind = "struct<action: string, reason: string>"
    error = F.when(~known, F.raise_error(F.concat(F.lit("unknown policy "), F.coalesce(policy, F.lit("null"))))).otherwise(F.raise_error(F.lit("max_rounds must be positive")))
    return F.when(known & (max_rounds >= 1), chosen).otherwise(error.cast(kind))
