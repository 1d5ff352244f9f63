"""Fact rules: which field a question asks for, and its value, unit and quote in a passage."""

from __future__ import annotations

import json
from collections.abc import Callable
from dataclasses import dataclass

from pyspark.sql import Column
from pyspark.sql import functions as F

from evispark.functions.text import let, normalize, squeeze, strip

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"
UNITS = "千元|万元|亿元|元/股|元|人"


@dataclass(frozen=True)
class Fact:
    name: str
    keywords: tuple[str, ...]
    label: str
    unit: str | None = None
    shape: str = "plain"  # plain, dividend (value before 元), explicit (a unit in brackets is needed)
    markers: tuple[str, ...] = ()


_KEY = ("主要会计数据和财务指标",)
_STAFF = ("公司员工情况", "员工数量、专业构成及教育程度")
#: In order of precedence (fixed values).
FACTS = (
    Fact("basic_eps", ("基本每股收益",), r"基本每股收\s*益", "元/股", markers=_KEY),
    Fact("roe", ("加权平均净资产收益率",), r"加权平均净资产收益\s*率", "%", markers=_KEY),
    Fact("total_assets", ("资产总额", "总资产"), r"(?:资产总\s*额|总资\s*产)", markers=_KEY),
    Fact("rnd_staff", ("研发人员数量", "研发人员有多少", "多少研发人员"), r"研发(?:及技术)?人员数量(?:\s*[（(]人[）)])?", "人", markers=("公司研发人员情况",)),
    Fact("rnd_ratio", ("研发投入占营业收入", "研发费用占营业收入", "研发投入比例", "研发费用比例"), r"研发(?:投入|费用)占营业收入(?:的)?比例", "%", markers=("近三年公司研发投入金额", "公司研发投入情况")),
    Fact("net_assets", ("归属于上市公司股东的净资产",), r"归属于上市公司股东\s*的净资产", markers=_KEY),
    Fact("net_profit", ("归属于上市公司股东的净利润", "净利润"), r"归属于上市公司股东\s*的净利润", markers=_KEY),
    Fact("operating_cash_flow", ("经营活动产生的现金流量净额",), r"经营活动产生的现金\s*流量净额", markers=_KEY),
    Fact("rnd_amount", ("研发投入金额", "研发投入是多少", "研发投入为多少"), "研发投入金额", shape="explicit", markers=("近三年公司研发投入金额",)),
    Fact("employees_total", ("在职员工总数", "在职员工的数量合计"), r"报告期末在职员工的数量合计(?:\s*（人）)?", "人", markers=_STAFF),
    Fact("technical_employees", ("技术人员",), "技术人员", "人", markers=_STAFF),
    Fact("dividend_per_10", ("每10股", "每 10 股"), r"每\s*10\s*股派发(?:现金)?(?:分红|红利)?", "元", "dividend", ("董事会审议的报告期利润分配预案", "年度报告 第一节 重要提示")),
    Fact("revenue", ("营业收入",), "营业收入", markers=_KEY),
)
#: Qualifiers that narrow a fact (fixed values).
REGIONS = ("海外", "境外", "欧洲", "北美")
ATTRIBUTES = ("女性", "博士", "硕士")
SEGMENTS = ("储能电池系统", "动力电池系统", "智慧教育业务", "智慧医疗业务", "新能源汽车业务", "主业产品及服务", "智能家居业务")


def by_fact(name: Column, value: Callable[[Fact], object], kind: str = "string") -> Column:
    """value(fact), a constant, for the fact of that name: looked up in one map, so that plans hold no branch a fact."""
    known = {f.name: v for f in FACTS if (v := value(f)) is not None}
    return F.try_element_at(F.from_json(F.lit(json.dumps(known)), f"map<string, {kind}>"), name)


def fact_of(query: Column) -> Column:
    """The first fact one of whose keywords is in the question without white space; else null."""
    known = F.from_json(F.lit(json.dumps([{"name": f.name, "keywords": f.keywords} for f in FACTS])), "array<struct<name: string, keywords: array<string>>>")
    return let(squeeze(query), lambda plain: F.get(F.filter(known, lambda f: F.exists(f["keywords"], lambda k: F.contains(plain, k))), 0)["name"])


def _pattern(fact: Fact) -> str:
    """Groups: a unit in brackets before the value, the value, and what follows it: a percent sign, or 元 of a dividend."""
    if fact.shape == "dividend":
        return rf"(?U){fact.label}[^\d-]{{0,20}}()({NUMBER})\s*(元)"
    unit = rf"\s*[（(]({UNITS})[）)]"
    unit = unit if fact.shape == "explicit" else f"(?:{unit})?"
    return rf"(?U){fact.label}{unit}[^\d-]{{0,30}}({NUMBER})(%?)"


def extract(passage: Column, name: Column) -> Column:
    """A struct of value_text, numeric_value, unit, quote, or null: the first match of the fact's pattern.

    The pattern is a value computed once a row, so there is one copy of what follows and not one a fact; Spark compiles
    it anew only where it changes from one row to the next.
    """

    def matched(x: Column) -> Column:
        group = lambda i: F.call_function("regexp_extract", x["text"], x["pattern"], F.lit(i))
        start = F.regexp_instr(x["text"], x["pattern"])
        return F.struct(x["text"].alias("text"), x["unit"].alias("unit"), start.alias("start"), *(group(i).alias(f"g{i}") for i in range(4)))

    def value(m: Column) -> Column:
        text, start, end = m["text"], m["start"], m["start"] + F.length(m["g0"])
        before = F.regexp_extract_all(F.substring(text, F.lit(1), start - 1), F.lit(r"(?U)单位[：:]?\s*(千元|万元|亿元|元)"), F.lit(1))
        unit = F.coalesce(F.when(m["g3"] != "", m["g3"]), F.nullif(m["g1"], F.lit("")), m["unit"], F.try_element_at(before, F.lit(-1)), F.lit("元"))
        taxed = (name == "dividend_per_10") & (F.substring(text, end, F.lit(20)).contains("含税") | m["g0"].contains("含税"))
        first = F.greatest(F.lit(1), start - 45)
        found = F.struct(
            F.concat(m["g2"], unit, F.when(taxed, "（含税）").otherwise("")).alias("value_text"),
            F.regexp_replace(m["g2"], ",", "").try_cast("decimal(28,4)").alias("numeric_value"),
            unit.alias("unit"),
            strip(F.substring(text, first, end + 80 - first)).alias("quote"),
        )
        return F.when(start > 0, found)

    given = F.struct(normalize(passage).alias("text"), by_fact(name, _pattern).alias("pattern"), by_fact(name, lambda f: f.unit).alias("unit"))
    return let(given, lambda x: let(matched(x), value))


def marker_hits(passage: Column, name: Column) -> Column:
    """How many of the fact's markers the passage holds."""
    markers = F.coalesce(by_fact(name, lambda f: f.markers, "array<string>"), F.array().cast("array<string>"))
    return let(normalize(passage), lambda text: F.size(F.filter(markers, lambda m: text.contains(m))))


def constraints_of(query: Column, name: Column) -> Column:
    """The qualifiers that the question names, in order, each with the widest gap to the fact's label (term, width)."""
    terms = [(t, 40, False) for t in REGIONS] + [(t, 8, True) for t in ATTRIBUTES] + [(t, 12, False) for t in SEGMENTS]
    known = F.from_json(F.lit(json.dumps([{"term": t, "width": w, "staff": s} for t, w, s in terms])), "array<struct<term: string, width: int, staff: boolean>>")
    staff = F.coalesce(name.isin("technical_employees", "rnd_staff"), F.lit(False))
    return let(squeeze(query), lambda plain: F.filter(known, lambda t: F.contains(plain, t["term"]) & (staff | ~t["staff"]) & name.isNotNull()))


def entails(passage: Column, query: Column, name: Column) -> Column:
    """Whether the passage holds, near the fact's label, every qualifier that the question names."""
    label = by_fact(name, lambda f: f.label)

    def holds(text: Column) -> Column:
        gap = lambda c: F.concat(F.lit(".{0,"), c["width"].cast("string"), F.lit("}"))
        near = lambda c: F.concat(F.lit("(?U)"), c["term"], gap(c), label, F.lit("|"), label, gap(c), c["term"])
        return F.forall(constraints_of(query, name), lambda c: F.call_function("regexp_like", text, near(c)))

    return F.coalesce(let(normalize(passage), holds), F.lit(True))


def constrained(query: Column, name: Column) -> Column:
    """Whether the question names a qualifier."""
    return F.size(constraints_of(query, name)) > 0
