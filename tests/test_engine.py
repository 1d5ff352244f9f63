import pytest
from pyspark.sql import functions as F

from evispark.functions import facts, text
from evispark.operators import answering, chunking, context, datasets, ledger, loop, metrics, retrieval, routing, training
from evispark.plans import catalog

@pytest.mark.parametrize("name", sorted(catalog.ORACLE_SQL))
def test_same_as_sql(same, name):
    same(catalog.QUERIES[name], catalog.ORACLE_SQL[name])


def one(spark, column):
    return spark.range(1).select(column.alias("x")).first().x


def test_chunks(spark):
    schema = "document_id string, company string, year int, markdown string"
    body = "<!-- page: 3 -->\n## 研发投入\n" + "研发投入情况说明。" * 8
    rows = chunking.chunk(spark.createDataFrame([("demo-2024", "甲", 2024, body)], schema)).collect()
    assert [(r.chunk_id, r.section, r.page) for r in rows] == [("demo-2024:0000", "研发投入", 3)]
    with pytest.raises(ValueError):
        chunking.chunk(spark.createDataFrame([], schema), 100, 100)


def pieces(value, size, overlap):
    out, at = [], 0
    while len(value) > size and at < len(value):
        end = min(at + size, len(value))
        if end < len(value):
            cut = max(value.rfind(c, at, end) for c in "\n。；")
            end = cut + 1 if cut > at + size // 2 else end
        out += [p for p in [value[at:end].strip()] if p]
        if end == len(value):
            break
        at = max(end - overlap, at + 1)
    return out or [value]


def test_long_texts_split_alike(spark):
    values = [("a。bc\n" * k + "x" * (k * 7 % 53) + "；y z ") * (k % 5 + 1) for k in range(1, 40)]
    rows = spark.createDataFrame([(v,) for v in values], "t string").select("t", chunking.split_long(F.col("t"), 60, 11).alias("p")).collect()
    assert all(r.p == pieces(r.t, 60, 11) for r in rows)


def test_text_rules(spark):
    assert one(spark, text.normalize(F.lit("营业 ，　收入 ( 元 ) 1 , 2"))) == "营业 ， 收入(元)1,2"
    assert one(spark, text.last_position(F.lit("第一季度 合并利润表 第二季度"), answering.QUARTER)) == 11
    assert one(spark, text.rejoin_chinese(F.lit("营业\n收入 10"))) == "营业收入 10"


def test_change_and_decimals(spark):
    assert one(spark, answering.format_decimal(F.lit("1234.565").cast("decimal(20,4)"), 2)) == "1,234.56"
    assert one(spark, answering.format_decimal(F.lit("100").cast("decimal(20,0)"))) == "100"
    assert one(spark, answering.format_decimal(F.lit("0.3000").cast("decimal(20,4)"))) == "0.3000"
    assert one(spark, answering.format_decimal(F.lit("1234.5").cast("decimal(20,4)"), digits=F.lit(1))) == "1,234.5"
    assert one(spark, answering.format_decimal(F.lit("-0.50").cast("decimal(20,2)"))) == "0.50"
    assert one(spark, answering.change(F.lit(0).cast("decimal(20,4)"), F.lit(10).cast("decimal(20,4)"))[1]) is None


def test_extraction_units(spark):
    row = one(spark, facts.extract(F.lit("单位：千元 营业收入 481,516,234 2,000"), F.lit("revenue")))
    assert (row.value_text, row.unit) == ("481,516,234千元", "千元")
    assert one(spark, facts.extract(F.lit("研发投入金额 12"), F.lit("rnd_amount"))) is None
    assert one(spark, facts.extract(F.lit("加权平均净资产收益 率 16.12%"), F.lit("roe"))).value_text == "16.12%"


def test_fusion_and_metrics(spark):
    hits = lambda rows, s: spark.createDataFrame([(1, c, r, s) for c, r in rows], "query_id int, chunk_id string, rank int, source string")
    top = retrieval.fuse([hits([("a", 1), ("b", 2)], "bm25"), hits([("b", 1), ("c", 2)], "dense")]).collect()
    assert top[0].chunk_id == "b" and top[0].source == "bm25+dense"
    with pytest.raises(ValueError):
        retrieval.fuse([hits([("a", 1)], "x")], weights=[1.0, 2.0])
    queries = spark.createDataFrame([(1, "t"), (2, "t")], "query_id int, question_type string")
    qrels = spark.createDataFrame([(1, "a"), (1, "z"), (2, "b")], "query_id int, chunk_id string")
    got = metrics.evaluate(queries, qrels, hits([("x", 1), ("a", 2)], "s"), (1, 2)).first()
    assert (got.recall_at_1, got.recall_at_2, got.mrr) == (0.0, 0.25, 0.25)
    empty = metrics.evaluate(queries.limit(0), qrels, hits([("a", 1)], "s")).first()
    assert empty.mrr == 0


def test_training_rules(spark):
    gold = spark.createDataFrame([("q", "d:0010")], "query_id string, chunk_id string")
    found = training.drop_adjacent(spark.createDataFrame([("q", "d:0009"), ("q", "d:0007"), ("q", "e:0010")], "query_id string, chunk_id string"), gold)
    assert {r.chunk_id for r in found.collect()} == {"d:0007", "e:0010"}
    with pytest.raises(ValueError):
        training.stride_split(F.lit(1), 1)


HITS = "query_id int, rank int, chunk_id string, company string, year int, page int, section string, text string"


def packed(hits, limit, top_k):
    """The plain loop over one question's hits, in characters: (chunk_id, body) of what is kept, and the length before."""
    blocks = [(f"[chunk_id={c};company={co};year={y};page={p};section={s}]\n", c, t) for _, _, c, co, y, p, s, t in hits[:top_k]]
    used, kept = 0, []
    for head, c, body in blocks:
        gap = 2 if kept else 0
        if used + gap + len(head) + len(body) > limit:
            left = limit - used - gap - len(head)
            body = body[:left] if left > 0 else ""
            if not body:
                continue
        kept.append((c, body))
        used += gap + len(head) + len(body)
        if used >= limit:
            break
    return kept, sum(len(h) + len(t) for h, _, t in blocks) + 2 * (len(blocks) - 1), used


@pytest.mark.parametrize("limit", [1, 60, 61, 140, 400, 100_000])
def test_context_is_packed_as_by_a_loop(spark, limit):
    hits = [(1, i + 1, f"c{i}", "甲" if i % 2 else None, 2024, i if i % 3 else None, "节", "字x" * (i * 37 % 90)) for i in range(12)]
    row = context.build(spark.createDataFrame(hits, HITS), spark.createDataFrame([(1, "q")], "query_id int, query string"), top_k=9, max_tokens=limit).first()
    kept, before, used = packed(hits, limit, 9)
    assert list(zip(row.kept, row.bodies, strict=True)) == kept and (row.tokens_before, row.tokens_after, row.chunks_before) == (before, used, 9)
    assert row.truncated == (used < before) and len(row.context) == used


def test_spans_and_prompts(spark):
    passage = "公司员工情况\n单位：万元\n前文" + "x" * 900 + "\n净资产 见附注\n" + "y" * 900
    assert one(spark, context.span(F.lit(passage), F.lit("2024年净资产"), 20)) == "x" * 20 + "\n净资产 见附注\n" + "y" * 19
    assert one(spark, context.span(F.lit(passage), F.lit("其他"), 20)) == passage[:40]
    assert one(spark, context.span(F.lit("主要会计数据和财务指标 单位：千元 营业收入 1,200"), F.lit("营业收入"))) == "主要会计数据和财务指标\n单位：千元\n主要会计数据和财务指标 单位：千元 营业收入 1,200"
    assert one(spark, context.anchors(F.lit("2024年和2023年净资产、2024年员工"))) == ["净资产", "员工", "2024", "2023"]
    row = one(spark, context.prompt(F.lit("问"), F.lit("")))
    assert row.user == "问题：问\n\n证据：\n[无可用证据]" and len(row.prompt_sha256) == 64


def test_usage_names(spark):
    row = one(spark, ledger.usage_from_json(F.lit('{"prompt_tokens": 5, "output_tokens": 7, "prompt_tokens_details": {"cached_tokens": 2}}')))
    assert tuple(row) == (5, 7, 2)


def test_unknown_company(spark):
    found = spark.createDataFrame([("c", "d", "甲公司", 2024, "", 1, "t")], catalog.CHUNK_SCHEMA)
    asked = spark.createDataFrame([("a", "请问丙公司2024年营业收入"), ("b", "甲公司 2024 年")], "query_id string, query string")
    rows = {r.query_id: r for r in routing.route(asked, routing.scope(found)).collect()}
    assert rows["a"].requested_company == "丙公司" and rows["a"].message.endswith("可靠回答。") and not rows["b"].should_refuse


def chunked(markdown, size, overlap, least):
    """A plain chunker of one document: (section, page, text)."""
    import re

    section, page, held, at, out = "文档开头", None, [], None, []

    def flush():
        text = "\n".join(held).strip()
        if text:
            out.extend((section, at, p) for p in pieces(text, size, overlap) if len(p) >= least)
        held.clear()

    for raw in markdown.splitlines():
        line = raw.rstrip()
        if m := re.match(r"^\s*<!--\s*page\s*:\s*(\d+)\s*-->\s*$", line, re.I):
            flush()
            page = at = int(m[1])
        elif m := re.match(r"^(#{1,6})\s+(.+?)\s*$", line):
            flush()
            section, at = m[2], page
        else:
            held.append(line)
    flush()
    return out


def test_documents_are_chunked_as_by_a_loop(spark):
    import random

    rng = random.Random(3)
    lines = ["<!-- page: 4 -->", "# 一 ", "## 二", "", "  ", "研发投入情况。说明；继续", "x" * 130, "a b c。" * 12, "<!-- Page : 9 -->", "###无空格"]
    ends = ["\n", "\r\n", "\r", "\x0c", "\x0b", "\x85", "\u2028", "\u2029", "\x1c", "\x1e"]
    docs = [(f"d{i}", "甲", 2024, "".join(rng.choice(lines) + rng.choice(ends) for _ in range(rng.randint(0, 25)))) for i in range(60)]
    frame = spark.createDataFrame(docs, "document_id string, company string, year int, markdown string")
    for size, overlap, least in ((60, 11, 5), (100, 60, 1), (30, 29, 3)):
        got = {}
        for r in chunking.chunk(frame, size, overlap, least).collect():
            got.setdefault(r.document_id, {})[int(r.chunk_id.rpartition(":")[2])] = (r.section, r.page, r.text)
        for d, _, _, markdown in docs:
            assert [got.get(d, {})[k] for k in sorted(got.get(d, {}))] == chunked(markdown, size, overlap, least)


def test_what_is_wrong_is_an_error(spark):
    empty = spark.createDataFrame([], catalog.CHUNK_SCHEMA)
    for bad in (lambda: routing.scope(empty).collect(), lambda: retrieval.bm25(empty, spark.createDataFrame([(1, "a")], "query_id int, query string")).collect()):
        with pytest.raises(Exception, match="empty"):
            bad()
    vectors = spark.createDataFrame([(1, [1.0, 2.0]), (2, [1.0])], "chunk_id int, vector array<double>")
    with pytest.raises(Exception, match="length"):
        retrieval.dense(vectors, spark.createDataFrame([(1, [1.0, 0.0])], "query_id int, query_vector array<double>")).collect()
    for policy, most in (("static", 1), (answering.STATIC, 0)):
        with pytest.raises(Exception, match="policy|positive"):
            one(spark, answering.decide(F.lit("sufficient"), F.lit(policy), F.lit(1), F.lit(most)))
    for row in ((-1, 0, 0, None), (1, 0, 2, None), (1, 0, 0, -0.5)):
        with pytest.raises(Exception, match="negative"):
            ledger.totals(ledger.checked(spark.createDataFrame([row], "input_tokens int, output_tokens int, cached_tokens int, cost double"))).collect()
    gold = spark.createDataFrame([(1, "a")], "query_id int, chunk_id string")
    hits = lambda q: spark.createDataFrame([(q, "a", 1)], "query_id int, chunk_id string, rank int")
    with pytest.raises(Exception, match="unlike"):
        metrics.first_ranks(gold, gold, hits(1), hits(2)).collect()
    with pytest.raises(Exception, match="too few"):
        training.exact_quota(hits(1), gold, 2).collect()


def test_refusals_carry_their_message(spark):
    found = spark.createDataFrame([("c", "d", "甲公司", 2024, "", 1, "营业收入 单位：元")], catalog.CHUNK_SCHEMA)
    rows = {q: loop.ask(spark, q, found).first() for q in ("甲公司2024年审计机构", "甲公司2024年营业收入", "甲公司营业收入")}
    assert [r.status for r in rows.values()] == ["refused"] * 3 and rows["甲公司2024年审计机构"].answer.startswith("当前受控回答器")
    assert rows["甲公司2024年营业收入"].answer.startswith("没有找到同时满足") and rows["甲公司营业收入"].answer.startswith("没有找到可核验")
    with pytest.raises(ValueError):
        loop.ask(spark, " a ", found)


def test_triples_are_audited(spark):
    chunks = spark.createDataFrame([(f"d:{i:04d}", "营业收入 1,000" if i == 7 else "其他") for i in range(10)], "chunk_id string, text string")
    train = spark.createDataFrame([("q", "甲公司营业收入", "1,000元", ["d:0003"]), ("r", "x", "y", ["d:0000"])], "query_id string, query string, answer string, relevant_chunk_ids array<string>")
    validation = spark.createDataFrame([("v",)], "query_id string")
    schema = "triple_id string, query_id string, positive string, negative string"
    good = spark.createDataFrame([("1", "q", "d:0003", "d:0005"), ("2", "r", "d:0000", "d:0009")], schema)
    assert datasets.audit_triples(good, train, validation, chunks, 1).count() == 0
    bad = spark.createDataFrame([("1", "q", "d:0003", "d:0004"), ("1", "q", "d:0005", "d:0003"), ("3", "q", "d:0003", "d:0007"), ("4", "v", "d:0003", "d:0099")], schema)
    found = {r.issue for r in datasets.audit_triples(bad, train, validation, chunks, 1).collect()}
    assert found == {
        "duplicate triple ID", "not a training query", "leaked validation query", "invalid positive", "negative chunk missing", "gold used as negative", "adjacent chunk used as negative",
        "answer-bearing chunk used as negative", "some training queries have no triples", "uneven negatives per query",
    }


def test_sets_are_numbered_and_gates_hold(spark):
    a = spark.createDataFrame([("x", 1), ("y", 2)], "query string, k int")
    rows = datasets.merged([("one", a), ("two", a.drop("k"))], "dev", "query").collect()
    assert [(r.query_id, r.query, r.origin) for r in sorted(rows, key=lambda r: r.query_id)] == [("dev-001", "x", "one"), ("dev-002", "y", "one"), ("dev-003", "x", "two"), ("dev-004", "y", "two")]
    companies = spark.createDataFrame([("甲公司", "储能电池系统")], "company string, segment string")
    assert {r.query for r in datasets.hard_no_answers(companies, (2024,)).collect()} == {"甲公司2024年的海外研发投入金额是多少？", "甲公司2024年女性技术人员有多少？", "甲公司2024年储能电池系统的净利润是多少？"}
    assert datasets.unanswerable(companies, (2026, 2027), (("f", "年的营业收入是多少？"),), "period_not_covered").count() == 2
    metric = spark.createDataFrame([("baseline", 0.9), ("small", 0.85)], "profile string, exact double")
    assert not metrics.no_drop(metric, "baseline", {"exact": 0.01}).first().passed and metrics.no_drop(metric, "baseline", {"exact": 0.06}).first().passed
    assert metrics.beats(metric, "exact", "small", "baseline", "profile").first().passed
    assert {(r.metric, round(r.delta, 6)) for r in metrics.deltas(metric.where("profile = 'baseline'").select("exact"), metric.where("profile = 'small'").select("exact")).collect()} == {("exact", -0.05)}


def test_passages_are_found_in_any_place(spark):
    passages = ["alpha beta gamma delta epsilon zeta eta theta", "ta gam", "one two three four", "x", "", "mid word"]
    texts = ["pre" + passages[0] + "post more", "beta gamma", "none two three fourth", "say\tone two three four.", None, "xmid words", ""]
    rows = training.leaks(spark.createDataFrame([(t,) for t in texts], "text string"), spark.createDataFrame(list(enumerate(passages)), "item_id int, passage string")).collect()
    assert {r.item_id: r.documents for r in rows} == {i: sum(p in t for t in texts if t is not None) if p else 0 for i, p in enumerate(passages)}
