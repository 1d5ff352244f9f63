"""Questions: scope guard, task type, metadata filter, expansion, rewriting by round."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.facts import by_fact, fact_of
from evispark.functions.text import has_any, let, squeeze, strip

#: Words that ask for a comparison, and polite openings of a question (fixed values).
CALCULATION = ("同比", "增长", "下降", "增加", "减少", "差额", "变化", "高出", "低于", "相差")
OPENINGS = ("请问", "请查询", "查询", "请比较", "比较", "请告诉我", "告诉我", "想知道")
YEAR = r"(?U)(?<!\d)((?:19|20)\d{2})(?!\d)"
NAME_BEFORE_YEAR = r"(?U)([一-鿿A-Za-z·]{2,24})(?=(?:19|20)\d{2})"
#: Section names that go with words of a question (fixed values).
SECTION_ANCHORS = (
    (("营业收入", "净利润", "现金流量净额", "总资产", "净资产", "每股收益"), "主要会计数据 财务指标"),
    (("研发投入", "研发人员", "研发资本化"), "公司研发投入情况 公司研发人员情况 研发人员数量"),
    (("员工总数", "在职员工", "技术人员", "生产人员", "硕士研究生"), "公司员工情况 员工数量 专业构成 教育程度"),
    (("现金分红", "现金红利", "每10股", "每 10 股"), "利润分配预案 现金分红"),
)
#: Section names that go with a fact, and what later rounds add to a question (fixed values).
FIELD_ANCHORS = {
    "revenue": "营业收入 主要会计数据和财务指标 合并利润表",
    "net_profit": "归属于上市公司股东的净利润 主要会计数据和财务指标 合并利润表",
    "operating_cash_flow": "经营活动产生的现金流量净额 主要会计数据和财务指标 合并现金流量表",
    "basic_eps": "基本每股收益 主要会计数据和财务指标",
    "roe": "加权平均净资产收益率 主要会计数据和财务指标",
    "total_assets": "总资产 主要会计数据和财务指标 合并资产负债表",
    "rnd_ratio": "研发投入占营业收入比例 公司研发投入情况",
    "rnd_staff": "研发人员数量 公司研发人员情况",
    "rnd_amount": "研发投入金额 公司研发投入情况",
    "net_assets": "归属于上市公司股东的净资产 主要会计数据和财务指标",
    "employees_total": "报告期末在职员工数量 公司员工情况",
    "technical_employees": "技术人员 公司员工情况 专业构成",
    "dividend_per_10": "每10股现金红利 利润分配预案",
}
ANNUAL_WORDS, MISMATCH_WORDS, STATEMENT_WORDS = "年度 全年 报告期 年度报告全文 非分季度", "年度主要会计数据 本年数 全年数据", "合并财务报表 本期金额 审计报告附表"


def scope(chunks: DataFrame) -> DataFrame:
    """One row: the sorted companies and years of the corpus; an empty corpus is an error."""
    known = lambda c: F.when(F.count("*") > 0, F.array_sort(F.collect_set(c))).otherwise(F.raise_error(F.lit("the corpus is empty")))
    return chunks.agg(known("company").alias("companies"), known("year").alias("scope_years"))


def route(queries: DataFrame, corpus: DataFrame) -> DataFrame:
    """queries with companies (in scope order), years, task_type, requires_calculation, should_refuse, refusal_reason, requested_company, message.

    corpus is the one row of scope(): names and years, which a corpus has few of next to its passages.
    """
    plain = squeeze(F.col("query"))
    rows = queries.crossJoin(F.broadcast(corpus.select(F.col("companies").alias("__known"), F.col("scope_years").alias("__covered"))))
    rows = rows.withColumn("companies", F.filter("__known", lambda c: plain.contains(c)))
    rows = rows.withColumn("years", F.array_sort(F.array_distinct(F.transform(F.regexp_extract_all(plain, F.lit(YEAR), F.lit(1)), lambda y: y.cast("int")))))
    rows = rows.withColumn("__outside", F.array_except("years", F.transform("__covered", lambda y: y.cast("int"))))
    name, bare = F.regexp_extract(F.regexp_replace("query", r"(?U)\s+", ""), NAME_BEFORE_YEAR, 1), None
    for opening in OPENINGS:
        rest = F.substring(name, F.lit(len(opening) + 1), F.length(name))
        bare = F.when(name.startswith(opening), rest) if bare is None else bare.when(name.startswith(opening), rest)
    unknown = F.when(F.size("companies") == 0, F.nullif(bare.otherwise(name), F.lit("")))
    rows = rows.withColumn("requested_company", unknown).withColumn("requires_calculation", has_any(plain, CALCULATION))
    rows = rows.withColumn("refusal_reason", F.when(F.size("__outside") > 0, "period_not_covered").when(F.col("requested_company").isNotNull(), "company_not_covered"))
    kind = F.when(F.col("refusal_reason").isNotNull(), "out_of_scope").when(F.size("companies") > 1, "cross_company").when(F.size("years") > 1, "cross_year")
    rows = rows.withColumn("task_type", kind.when(F.col("requires_calculation"), "calculation").otherwise("single_fact")).withColumn("should_refuse", F.col("refusal_reason").isNotNull())
    end = "，因此无法基于现有资料可靠回答。"
    message = F.when(
        F.col("refusal_reason") == "period_not_covered",
        F.concat(F.lit("当前年报语料只覆盖 "), F.array_join("__covered", "、"), F.lit(" 年，未覆盖 "), F.array_join("__outside", "、"), F.lit(" 年" + end)),
    ).when(F.col("should_refuse"), F.concat(F.lit("当前年报语料只覆盖 "), F.array_join("__known", "、"), F.lit("，未收录 "), F.col("requested_company"), F.lit(end)))
    return rows.withColumn("message", message).drop("__known", "__covered", "__outside")


def allowed(queries: DataFrame, documents: DataFrame) -> DataFrame:
    """(query_id, document_id) that a question's companies (as written) and years (digits around allowed) leave.

    A question that names neither, or to which no document is left, has one row with a null document_id: all are allowed.
    documents: one row (document_id, company, year) each. Names meet questions by their first two characters, which a
    question has as many of as it has characters, and documents are joined by company and by year.
    """
    years = F.transform(F.regexp_extract_all("query", F.lit(r"((?:19|20)\d{2})"), F.lit(1)), lambda y: y.cast("int"))
    asked = queries.select("query_id", "query", F.array_distinct(years).alias("__years"))
    pairs = let(F.split("query", ""), lambda c: F.array_distinct(F.concat(c, F.transform(F.sequence(F.lit(1), F.greatest(F.size(c) - 1, F.lit(1))), lambda i: F.array_join(F.slice(c, i, 2), "")))))
    names = documents.select("company", F.left("company", F.lit(2)).alias("__start")).where("company <> ''").distinct()
    named = asked.select("*", F.explode(pairs).alias("__start")).join(names, "__start").where(F.col("query").contains(F.col("company"))).select("query_id", "__years", "company")
    dated = F.size("__years") > 0
    in_year = F.array_contains("__years", F.col("year").cast("int"))
    by_company = named.join(documents, "company").where(~dated | in_year).select("query_id", "document_id")
    unnamed = asked.where(dated).join(named.select("query_id"), "query_id", "left_anti").select("query_id", F.explode("__years").alias("__year"))
    by_year = unnamed.join(documents.withColumn("__year", F.col("year").cast("int")), "__year").select("query_id", "document_id")
    kept = by_company.union(by_year).distinct()
    return kept.union(queries.join(kept, "query_id", "left_anti").select("query_id", F.lit(None).cast(documents.schema["document_id"].dataType)))


def expand(query: Column) -> Column:
    """The question and the section names of every group of words it has one of."""
    return F.concat_ws(" ", query, *(F.when(has_any(query, words), anchor) for words, anchor in SECTION_ANCHORS))


def rewrite(query: Column, years: Column, round_index: Column, mismatch: Column | None = None) -> Column:
    """The question of a round: as it is in the first; with field, annual and (from the third) statement words later."""
    field = by_fact(fact_of(query), lambda f: FIELD_ANCHORS.get(f.name, "年度报告 财务指标"))
    more = F.concat_ws(
        " ", query, F.coalesce(field, F.lit("年度报告")),
        F.when((F.size(years) > 0) & ~query.contains("季度"), ANNUAL_WORDS),
        F.when(mismatch if mismatch is not None else F.lit(False), MISMATCH_WORDS),
        F.when(round_index >= 3, STATEMENT_WORDS),
    )
    return F.when(round_index < 2, query).otherwise(strip(F.regexp_replace(more, r"(?U)\s+", " ")))
