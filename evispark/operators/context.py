"""Evidence contexts and prompts for all questions at once: spans, blocks within a budget, messages."""

from __future__ import annotations

from collections.abc import Callable

import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.functions.counters import Counter
from evispark.functions.facts import extract, fact_of
from evispark.functions.text import let, strip

#: Words of a question to look for in a passage, headings that place a figure, and the two system prompts (fixed values).
ANCHORS = ("营业收入", "基本每股收益", "净资产收益率", "资产总额", "总资产", "研发人员", "研发投入", "净利润", "现金流量净额", "净资产", "员工", "技术人员", "每10股", "海外", "境外", "季度", "年度")
HEADINGS = ("主要会计数据和财务指标", "公司研发人员情况", "近三年公司研发投入金额", "公司研发投入情况", "公司员工情况", "员工数量、专业构成及教育程度", "董事会审议的报告期利润分配预案", "年度报告 第一节 重要提示")
FULL_PROMPT = """你是上市公司年报研究助手。只能依据提供的年报证据回答，不能使用记忆补全。
回答前逐项检查公司、报告年份、年度或季度口径、指标名称、单位和业务范围是否与问题一致。
如果证据缺少任何必要约束，必须拒绝作答，不能根据相似指标猜测。
涉及跨年份比较时，必须分别找到每个年份的证据；涉及计算时使用证据中的原始数值和单位进行计算。
引用必须来自实际支持答案的证据，并保留 chunk_id 与页码。不要引用只是在主题上相似的段落。
最终仅输出 JSON，字段为 status、answer、reason、citations、calculation。status 只能是 answered 或 refused；citations 是包含 chunk_id、page、quote 的数组。"""
COMPRESSED_PROMPT = """仅据给定年报证据答题；核对公司/年份/年度季度/指标/单位/范围，缺一则拒答。跨年须逐年有证据，计算保留原值和单位。只引支持答案的 chunk_id、page、quote。仅输出 JSON：status(answered|refused),answer,reason,citations,calculation。"""
UNIT_NOTE = r"(?U)单位[：:]?\s*(?:千元|万元|亿元|元)"
GAP = "\n\n"


def anchors(query: Column) -> Column:
    """The anchors and years that a question names, in that order, each once."""
    named = F.filter(F.array(*map(F.lit, ANCHORS)), lambda a: query.contains(a))
    return F.array_distinct(F.concat(named, F.regexp_extract_all(query, F.lit(r"(?U)20\d{2}"), F.lit(0))))


def span(passage: Column, query: Column, window: int = 420) -> Column:
    """What of a passage to show: heading, unit note and quote of the value the question asks for, else text around the first anchor that it holds.

    Around an anchor: its line and `window` characters on both sides where the line is of at most two windows, else the
    window around the anchor; without an anchor the first two windows.
    """
    heading = F.coalesce(*(F.when(passage.contains(h), h) for h in HEADINGS))
    note = F.try_element_at(F.regexp_extract_all(passage, F.lit(UNIT_NOTE), F.lit(0)), F.lit(-1))
    quoted = let(extract(passage, fact_of(query)), lambda v: F.when(v.isNotNull(), F.array_join(F.array_distinct(F.filter(F.array(heading, note, v["quote"]), lambda x: x != "")), "\n")))
    places = F.filter(F.transform(anchors(query), lambda a: F.call_function("instr", passage, a)), lambda i: i > 0)

    def around(at: Column) -> Column:
        """at: 1-based."""
        before = F.substring(passage, F.lit(1), at - 1)
        begins = at - F.instr(F.reverse(before), "\n")  # of the line end before the anchor
        ends = at + F.instr(F.substring(passage, at, F.length(passage)), "\n") - 1
        whole = (F.instr(before, "\n") > 0) & (ends >= at) & (ends - begins <= 2 * window)
        first = F.greatest(F.lit(1), F.when(whole, begins).otherwise(at) - window)
        last = F.when(whole, ends).otherwise(at) + window  # exclusive
        return strip(F.substring(passage, first, last - first))

    near = let(F.try_element_at(places, F.lit(1)), lambda at: F.when(at.isNull(), F.substring(passage, 1, 2 * window)).otherwise(around(at)))
    return F.coalesce(quoted, near)


def header() -> Column:
    """What stands above a passage, of the columns of a hit."""
    shown = lambda c: F.coalesce(F.col(c).cast("string"), F.lit("None"))
    return F.concat(F.lit("[chunk_id="), "chunk_id", F.lit(";company="), shown("company"), F.lit(";year="), shown("year"), F.lit(";page="), shown("page"), F.lit(";section="), shown("section"), F.lit("]\n"))


def build(
    hits: DataFrame, queries: DataFrame, spans: bool = False, top_k: int = 10, max_tokens: int | None = None, window: int = 420,
    count: Callable[[Column], Column] = F.length, cut: Callable[[Column, Column], Column] = lambda text, n: F.substring(text, F.lit(1), n), counter: Counter | None = None,
) -> DataFrame:
    """(query_id, context, kept, bodies, chunks_before, chunks_after, tokens_before, tokens_after, truncated, compression) of each question's hits.

    hits: (query_id, rank, chunk_id, company, year, page, section, text); queries: (query_id, query). In rank order
    each block (header and body) is taken whole, or its body is cut to what is left, or skipped where not one token of
    it fits: what is skipped changes what fits later, so it is a fold over a question's top_k. Tokens are counted by
    `count` and `cut`, built-in expressions that count a text's tokens and keep its first n (characters by default),
    or by a `counter`, any object of functions/counters.py, which tasks call by Arrow batches of questions.
    """
    if top_k <= 0 or max_tokens is not None and max_tokens <= 0:
        raise ValueError("top_k and max_tokens must be positive")
    rows = hits.where(F.col("rank") <= top_k).join(queries.select("query_id", "query"), "query_id")
    body = span(F.col("text"), F.col("query"), window) if spans else F.col("text")
    rows = rows.select("query_id", F.struct("rank", "chunk_id", header().alias("head"), body.alias("body"), F.col("text").alias("full")).alias("b"))
    rows = rows.groupBy("query_id").agg(F.array_sort(F.collect_list("b")).alias("blocks"))
    if counter is not None:
        return packed_by(rows, counter, max_tokens)
    limit = F.lit(max_tokens if max_tokens is not None else (1 << 31) - 1).cast("long")
    zero = F.struct(F.lit(0).cast("long").alias("used"), F.array().cast("array<struct<chunk_id: string, head: string, body: string>>").alias("kept"))

    def step(s: Column, x: Column) -> Column:
        gap = F.when(F.size(s["kept"]) > 0, count(F.lit(GAP))).otherwise(0)
        left = limit - s["used"] - gap
        fits = count(F.concat(x["head"], x["body"])) <= left
        shown = F.when(fits, x["body"]).when(left > count(x["head"]), cut(x["body"], (left - count(x["head"])).cast("int")))
        return F.when(F.coalesce(~fits & (F.coalesce(shown, F.lit("")) == ""), F.lit(False)) | (s["used"] >= limit), s).otherwise(
            F.struct(
                (s["used"] + gap + count(F.concat(x["head"], shown))).cast("long").alias("used"),
                F.concat(s["kept"], F.array(F.struct(x["chunk_id"].cast("string").alias("chunk_id"), x["head"].alias("head"), shown.alias("body")))).alias("kept"),
            )
        )

    joined = lambda blocks, part: F.array_join(F.transform(blocks, lambda b: F.concat(b["head"], b[part])), GAP)
    packed = rows.withColumn("p", F.aggregate("blocks", zero, step))
    packed = packed.withColumns({"context": joined("p.kept", "body"), "before": count(joined("blocks", "full"))}).withColumn("after", count(F.col("context")))
    return packed.select(
        "query_id", "context", F.transform("p.kept", lambda k: k["chunk_id"]).alias("kept"), F.transform("p.kept", lambda k: k["body"]).alias("bodies"),
        F.size("blocks").alias("chunks_before"), F.size("p.kept").alias("chunks_after"), F.col("before").cast("long").alias("tokens_before"), F.col("after").cast("long").alias("tokens_after"),
        (F.col("after") < F.col("before")).alias("truncated"), F.when(F.col("before") == 0, 1.0).otherwise(F.col("after") / F.col("before")).alias("compression"),
    )


def packed_by(rows: DataFrame, counter: Counter, max_tokens: int | None) -> DataFrame:
    """build()'s fold of (query_id, blocks) with a counter that only Python has.

    The blocks, heads and whole texts of a batch of questions are counted at once; only a block that is cut is counted
    again, as its tokens at the seam aren't those of its parts. A row is one question's top_k blocks.
    """
    key = rows.schema["query_id"].dataType.simpleString()
    schema = f"query_id {key}, context string, kept array<string>, bodies array<string>, chunks_before int, chunks_after int, tokens_before long, tokens_after long, truncated boolean, compression double"

    def fold(blocks: list[dict], whole: list[int], heads: list[int], gap: int):
        used, kept = 0, []
        for block, n, head in zip(blocks, whole, heads, strict=True):
            own, between = block["body"] or "", gap if kept else 0
            if max_tokens is not None and used + between + n > max_tokens:
                left = max_tokens - used - between - head
                own = counter.cut(own, left) if left > 0 else ""
                if not own:
                    continue
                n = counter.counts([block["head"] + own])[0]
            kept.append((str(block["chunk_id"]), block["head"], own))
            used += between + n
            if max_tokens is not None and used >= max_tokens:
                break
        return kept

    def run(batches):
        for b in batches:
            asked = b.column("blocks").to_pylist()
            flat = [x for blocks in asked for x in blocks]
            whole, heads = counter.counts([x["head"] + (x["body"] or "") for x in flat]), counter.counts([x["head"] for x in flat])
            gap = counter.counts([GAP])[0]
            before = counter.counts([GAP.join(x["head"] + (x["full"] or "") for x in blocks) for blocks in asked])
            kept, at = [], 0
            for blocks in asked:
                kept.append(fold(blocks, whole[at : at + len(blocks)], heads[at : at + len(blocks)], gap))
                at += len(blocks)
            shown = [GAP.join(head + body for _, head, body in k) for k in kept]
            after = counter.counts(shown)
            columns = [shown, [[c for c, _, _ in k] for k in kept], [[x for _, _, x in k] for k in kept], [len(x) for x in asked], [len(k) for k in kept], before, after]
            columns += [[a < n for a, n in zip(after, before, strict=True)], [a / n if n else 1.0 for a, n in zip(after, before, strict=True)]]
            kinds = [pa.string(), pa.list_(pa.string()), pa.list_(pa.string()), pa.int32(), pa.int32(), pa.int64(), pa.int64(), pa.bool_(), pa.float64()]
            names = ["query_id", "context", "kept", "bodies", "chunks_before", "chunks_after", "tokens_before", "tokens_after", "truncated", "compression"]
            yield pa.record_batch([b.column("query_id"), *(pa.array(c, k) for c, k in zip(columns, kinds, strict=True))], names)

    return rows.mapInArrow(run, schema)


def prompt(query: Column, context: Column, compressed: bool = False) -> Column:
    """A struct of the system and user messages and the system prompt's digest."""
    system = COMPRESSED_PROMPT if compressed else FULL_PROMPT
    shown = F.coalesce(F.nullif(context, F.lit("")), F.lit("[无可用证据]"))
    return F.struct(F.lit(system).alias("system"), F.concat(F.lit("问题："), query, F.lit("\n\n证据：\n"), shown).alias("user"), F.sha2(F.lit(system), 256).alias("prompt_sha256"))
