"""All queries of the engine's own operators, by name, and the same rows in SQL."""

from __future__ import annotations

import json

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from evispark.functions import counters, facts, text
from evispark.operators import answering, chunking, context, datasets, encoding, holdouts, index, ledger, loop, metrics, replays, retrieval, routing, training, vectors
from evispark.sources import shared

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}
W = text.tokenize
TOP = 10


def query(sql: str | None = None):
    """Registers a query under its function's name."""

    def add(function):
        QUERIES[function.__name__] = function
        if sql:
            ORACLE_SQL[function.__name__] = sql
        return function

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def spread(rows: DataFrame) -> DataFrame:
    """The rows dealt out to all cores where their files are fewer: what follows costs more than moving them once."""
    cores = rows.sparkSession.sparkContext.defaultParallelism
    return rows.repartition(cores) if len(rows.inputFiles()) < cores else rows


def chunks(spark, sf_dir):
    return spread(table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source"))


def written(spark, sf_dir):
    """The index of chunks(), written by the first query that asks it and shared by all that follow."""
    return index.of(chunks(spark, sf_dir), shared.version(table(spark, sf_dir, "documents")), W, ("lang",))


def asked(spark, sf_dir):
    return table(spark, sf_dir, "benchmark").select(F.col("item_id").alias("query_id"), F.col("text").alias("query"))


#: Tokens of a text: Chinese runs give their characters, bigrams and, if short, themselves.
_TOKENS = r"""flatten(list_transform(regexp_extract_all(coalesce({0}, ''), '[A-Za-z]+(?:[-_.][A-Za-z0-9]+)*|\p{{Nd}}+(?:\.\p{{Nd}}+)?|[一-鿿]+'),
 lambda t: CASE WHEN regexp_matches(t, '^[一-鿿]') THEN list_concat(list_transform(range(1, len(t) + 1), lambda i: substr(t, i, 1)), list_transform(range(1, len(t)), lambda i: substr(t, i, 2)),
 CASE WHEN len(t) <= 8 THEN [t] ELSE []::VARCHAR[] END) ELSE [lower(t)] END))"""
_POSTINGS = f"""tok AS (SELECT doc_id AS chunk_id, lang, {_TOKENS.format("text")} AS t FROM documents),
size AS (SELECT count(*) AS n, avg(len(t)) AS avgdl FROM tok),
post AS (SELECT chunk_id, lang, term, dl, count(*) AS tf FROM (SELECT chunk_id, lang, len(t) AS dl, unnest(t) AS term FROM tok) GROUP BY chunk_id, lang, term, dl),
df AS (SELECT term, count(*) AS df FROM post GROUP BY term),
qt AS (SELECT query_id, term, count(*) AS qtf FROM (SELECT item_id AS query_id, unnest({_TOKENS.format("text")}) AS term FROM benchmark) GROUP BY ALL),
scored AS (
  SELECT query_id, chunk_id, any_value(lang) AS lang, sum(qtf * ln(1 + (n - df + 0.5) / (df + 0.5)) * (tf * 2.5 / (tf + 1.5 * (0.25 + 0.75 * dl / avgdl)))) AS score
  FROM post JOIN qt USING (term) JOIN df USING (term), size GROUP BY query_id, chunk_id),
bm AS (SELECT query_id, chunk_id, lang, round(score, 6) AS score FROM scored WHERE score > 0)"""


def _top(rows: str, where: str = "true", k: int = TOP, score: str = "score") -> str:
    return f"SELECT query_id, chunk_id, {score}, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY {score} DESC, chunk_id) AS INTEGER) AS rank FROM {rows} WHERE {where}) WHERE rank <= {k}"


@query(f"SELECT doc_id AS chunk_id, len({_TOKENS.format('text')}) AS n_tokens, len(list_distinct({_TOKENS.format('text')})) AS n_distinct FROM documents")
def tokenize_counts(spark, sf_dir):
    return chunks(spark, sf_dir).select("chunk_id", F.size(W(F.col("text"))).cast("long").alias("n_tokens"), F.size(F.array_distinct(W(F.col("text")))).cast("long").alias("n_distinct"))


@query(f"WITH {_POSTINGS}, cf AS (SELECT term, sum(tf) AS cf FROM post GROUP BY term) SELECT term, df, CAST(cf AS BIGINT) AS cf, round(ln(1 + (n - df + 0.5) / (df + 0.5)), 9) AS idf FROM df JOIN cf USING (term), size")
def term_stats(spark, sf_dir):
    return retrieval.term_stats(chunks(spark, sf_dir), W).withColumn("idf", F.round("idf", 9))


@query(f"WITH {_POSTINGS} " + _top("bm"))
def bm25_topk(spark, sf_dir):
    return index.search(written(spark, sf_dir), asked(spark, sf_dir), TOP, W).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_POSTINGS} " + _top("bm", "lang = 'en'"))
def bm25_filtered_topk(spark, sf_dir):
    return index.search(written(spark, sf_dir), asked(spark, sf_dir), TOP, W, where=F.col("lang").eqNullSafe("en")).select("query_id", "chunk_id", "score", "rank")


def _vectors(spark, sf_dir):
    return table(spark, sf_dir, "embeddings").select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), "label", (F.col("label") % 2).alias("group"))


def _vector_queries(spark, sf_dir):
    rows = _vectors(spark, sf_dir).where("chunk_id % 50 = 0")
    return rows.select(F.col("chunk_id").alias("query_id"), F.col("vector").alias("query_vector"), F.col("label").alias("query_label"), "group")


def _dense(spark, sf_dir, same_parity=False, k=TOP):
    return retrieval.dense(_vectors(spark, sf_dir), _vector_queries(spark, sf_dir), k, not_self=True, group=same_parity)


_DENSE = """dn AS (
  SELECT q.vec_id AS query_id, v.vec_id AS chunk_id, q.label AS query_label, v.label AS label, round(list_dot_product(CAST(v.embedding AS DOUBLE[]), CAST(q.embedding AS DOUBLE[])), 6) AS score
  FROM embeddings v JOIN embeddings q ON q.vec_id % 50 = 0 AND v.vec_id <> q.vec_id)"""


@query(f"WITH {_DENSE} " + _top("dn"))
def dense_topk(spark, sf_dir):
    return _dense(spark, sf_dir).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_DENSE} " + _top("dn", "label % 2 = query_label % 2"))
def dense_filtered_topk(spark, sf_dir):
    return _dense(spark, sf_dir, True).select("query_id", "chunk_id", "score", "rank")


def _allowed_labels(spark, sf_dir):
    """Which labels a question may find: its own and the two after it; every third question's are all."""
    asked_ = _vector_queries(spark, sf_dir)
    label = F.explode(F.when(F.col("query_id") % 3 == 0, F.array(F.lit(None).cast("long"))).otherwise(F.transform(F.array(*map(F.lit, range(3))), lambda i: ((F.col("query_label") + i) % 10).cast("long"))))
    return asked_.select("query_id", label.alias("label"))


_LABELS_ALLOWED = "query_id % 3 = 0 OR (label - query_label + 10) % 10 < 3"


@query(f"WITH {_DENSE} " + _top("dn", _LABELS_ALLOWED))
def dense_allowed_topk(spark, sf_dir):
    rows = _vectors(spark, sf_dir).withColumn("label", F.col("label").cast("long"))
    return retrieval.dense(rows, _vector_queries(spark, sf_dir), TOP, True, allowed=_allowed_labels(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


def _vector_blocks(spark, sf_dir):
    rows = table(spark, sf_dir, "embeddings")
    return vectors.of(rows.select(F.col("vec_id").alias("chunk_id"), F.col("embedding").alias("vector"), F.col("label").cast("long").alias("label")), shared.version(rows), ("label",))


@query(f"WITH {_DENSE} " + _top("dn"))
def dense_blocks_topk(spark, sf_dir):
    return vectors.search(_vector_blocks(spark, sf_dir), _vector_queries(spark, sf_dir), TOP, True).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_DENSE} " + _top("dn", _LABELS_ALLOWED))
def dense_blocks_allowed(spark, sf_dir):
    return vectors.search(_vector_blocks(spark, sf_dir), _vector_queries(spark, sf_dir), TOP, True, _allowed_labels(spark, sf_dir)).select("query_id", "chunk_id", "score", "rank")


@query("""WITH d AS (SELECT doc_id, sha256(coalesce(text, '')) AS k FROM documents), f AS (SELECT k, min(doc_id) AS first FROM d GROUP BY k)
SELECT doc_id AS chunk_id, first AS same_as, CAST(64 AS INTEGER) AS width FROM d JOIN f USING (k)""")
def encoded_texts(spark, sf_dir):
    """Each text's vector by the encoder that needs no model: texts have equal vectors with the first that is equal; lengths are 1 or 0."""
    rows = table(spark, sf_dir, "documents")
    vectors_, _ = encoding.encoded(spread(rows.select(F.col("doc_id").alias("chunk_id"), "text", F.sha2(F.coalesce("text", F.lit("")), 256).alias("k"))), encoding.HashEncoder())
    length = F.aggregate("vector", F.lit(0.0), lambda s, x: s + x.cast("double") * x)
    told = vectors_.where((F.abs(length - 1) < 1e-4) | (length == 0)).groupBy("k", "vector").agg(F.min("chunk_id").alias("same_as"), F.collect_list("chunk_id").alias("ids"))
    return told.select(F.explode("ids").alias("chunk_id"), "same_as", F.size("vector").alias("width"))


_FUSED = f"""a AS ({_top("dn", k=30)}), b AS ({_top("dn", "label % 2 = query_label % 2", 30)}),
parts AS (SELECT query_id, chunk_id, 1.0::DOUBLE / (60 + rank) AS part FROM a UNION ALL SELECT query_id, chunk_id, {{weight}}::DOUBLE / (60 + rank) FROM b),
fu AS (SELECT query_id, chunk_id, round(sum(part), 12) AS score FROM parts GROUP BY ALL)"""


@query(f"WITH {_DENSE}, {_FUSED.format(weight='1.0')} " + _top("fu"))
def rrf_fusion(spark, sf_dir):
    return retrieval.fuse([_dense(spark, sf_dir, k=30), _dense(spark, sf_dir, True, 30)], TOP).select("query_id", "chunk_id", "score", "rank")


@query(f"WITH {_DENSE}, {_FUSED.format(weight='3.0')} " + _top("fu"))
def weighted_rrf(spark, sf_dir):
    return retrieval.fuse([_dense(spark, sf_dir, k=30), _dense(spark, sf_dir, True, 30)], TOP, [1.0, 3.0]).select("query_id", "chunk_id", "score", "rank")


_RERANK = f"""b AS ({_top("bm")}),
ov AS (SELECT b.query_id, b.chunk_id, b.rank AS former, round(len(list_intersect(list_distinct({_TOKENS.format("q.text")}), {_TOKENS.format("d.text")})) / len(list_distinct({_TOKENS.format("q.text")})), 6) AS score
  FROM b JOIN benchmark q ON q.item_id = b.query_id JOIN documents d ON d.doc_id = b.chunk_id)"""


@query(f"WITH {_POSTINGS}, {_RERANK} SELECT query_id, chunk_id, score, rank FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, former) AS INTEGER) AS rank FROM ov) WHERE rank <= 5")
def rerank_topk(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text")
    hits = texts.join(_found(spark, sf_dir), "chunk_id").join(asked(spark, sf_dir), "query_id")
    return retrieval.rerank(hits, retrieval.overlap(F.col("query"), F.col("text"), W), 5).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_DENSE}, a AS ({_top("dn")}), b AS ({_top("dn", "label % 2 = query_label % 2")}),
m AS (SELECT query_id, chunk_id, max(score) AS score, min(turn * 1000 + rank) AS seen FROM (SELECT *, 0 AS turn FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL)
SELECT query_id, chunk_id, score, CAST(row_number() OVER (PARTITION BY query_id ORDER BY score DESC, seen) AS INTEGER) AS rank FROM m""")
def merge_ranked(spark, sf_dir):
    return retrieval.merge(_dense(spark, sf_dir), _dense(spark, sf_dir, True)).select("query_id", "chunk_id", "score", "rank")


def _relevance(spark, sf_dir):
    """The questions with their type, and what is relevant to them: all vectors of their label but their own, as classes."""
    questions = _vector_queries(spark, sf_dir)
    classes = metrics.Classes(questions.select("query_id", F.col("query_label").alias("class")), _vectors(spark, sf_dir).select("chunk_id", F.col("label").alias("class")), True)
    return questions.select("query_id", F.concat(F.lit("label"), F.col("query_label")).alias("question_type")), classes


_METRICS = f"""{_DENSE}, hits AS ({_top("dn")}), rel AS (SELECT query_id, chunk_id, 'label' || query_label AS question_type FROM dn WHERE label = query_label),
per AS (
  SELECT r.query_id, any_value(question_type) AS question_type, count(*) AS n, count(*) FILTER (WHERE rank <= 1) / count(*) AS r1, count(*) FILTER (WHERE rank <= 5) / count(*) AS r5,
         coalesce(1.0::DOUBLE / min(rank), 0) AS rr, sum(CASE WHEN rank <= 5 THEN 1 / log2(rank + 1) ELSE 0 END) AS dcg
  FROM rel r LEFT JOIN hits h ON h.query_id = r.query_id AND h.chunk_id = r.chunk_id GROUP BY r.query_id),
nd AS (SELECT *, dcg / list_sum(list_transform(range(1, least(n, 5) + 1), lambda i: 1 / log2(i + 1))) AS ndcg FROM per)
SELECT {{key}}count(*) AS queries, round(avg(r1), 9) AS recall_at_1, round(avg(r5), 9) AS recall_at_5, round(avg(rr), 9) AS mrr, round(avg(ndcg), 9) AS ndcg_at_5 FROM nd"""


@query("WITH " + _METRICS.format(key=""))
def recall_mrr_ndcg(spark, sf_dir):
    return metrics.evaluate(*_relevance(spark, sf_dir), _dense(spark, sf_dir), (1, 5))


@query("WITH " + _METRICS.format(key="question_type, ") + " GROUP BY ROLLUP (question_type)")
def metrics_by_type(spark, sf_dir):
    return metrics.evaluate(*_relevance(spark, sf_dir), _dense(spark, sf_dir), (1, 5), by="question_type")


@query("""WITH o AS (SELECT d.n_chars / 1000.0 AS score, l.quality = 1 AS answerable, l.toxic = 0 AS correct FROM documents d JOIN labels l USING (doc_id)),
g AS (SELECT *, score >= threshold AS answered FROM o, (VALUES (0.5::DOUBLE), (1.0), (2.0), (4.0)) t(threshold))
SELECT threshold, count(*) FILTER (WHERE answerable AND answered) / nullif(count(*) FILTER (WHERE answerable), 0)::DOUBLE AS answer_rate,
       count(*) FILTER (WHERE answerable AND answered AND correct) / nullif(count(*) FILTER (WHERE answerable), 0)::DOUBLE AS exact,
       count(*) FILTER (WHERE NOT answerable AND NOT answered) / nullif(count(*) FILTER (WHERE NOT answerable), 0)::DOUBLE AS refusal FROM g GROUP BY threshold""")
def threshold_sweep(spark, sf_dir):
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    return metrics.sweep(rows.select((F.col("n_chars") / 1000.0).alias("score"), (F.col("quality") == 1).alias("answerable"), (F.col("toxic") == 0).alias("correct")), (0.5, 1.0, 2.0, 4.0))


def _markdown(spark, sf_dir):
    rows = table(spark, sf_dir, "documents")
    return spread(rows.select(F.col("doc_id").cast("string").alias("document_id"), F.col("source").alias("company"), F.lit(2024).alias("year"), F.coalesce("text", F.lit("")).alias("markdown")))


@query()
def chunk_documents(spark, sf_dir):
    return chunking.chunk(_markdown(spark, sf_dir))


@query()
def chunk_stats(spark, sf_dir):
    return chunking.chunk(_markdown(spark, sf_dir)).groupBy("company").agg(F.count("*").alias("chunks"), F.max(F.length("text")).alias("longest"), F.countDistinct("document_id").alias("documents"))


CHUNK_SCHEMA = "chunk_id string, document_id string, company string, year int, section string, page int, text string"
#: Reports made of the orders of each nation's customers by year: a passage with the year's figures and one with a quarter's.
_CORPUS = """corp AS (
  SELECT c_nationkey AS k, n_regionkey AS r, '第' || c_nationkey || '公司' AS company, CAST(year(o_orderdate) AS INTEGER) AS y, CAST(floor(sum(CAST(o_totalprice AS DECIMAL(28, 2)))) AS BIGINT) AS v, count(*) AS staff
  FROM orders JOIN customer ON o_custkey = c_custkey JOIN nation ON c_nationkey = n_nationkey GROUP BY ALL),
known AS (SELECT list(DISTINCT company ORDER BY company) AS companies, list(DISTINCT y ORDER BY y) AS years FROM corp),
pair AS (SELECT a.k, a.r, a.company, a.y, a.v, b.v AS w FROM corp a JOIN corp b ON a.k = b.k AND b.y = a.y + 1),
asked AS (
  SELECT 'a' || k || '-' || y AS query_id, company || y || '年营业收入是多少？' AS query, company, y, 'revenue' AS fact, format('{:,}', v) || '千元' AS answer, NULL AS reason, 'single_fact' AS kind, [y] AS years FROM corp
  UNION ALL SELECT 'b' || k || '-' || y, company || y || '年和' || (y + 1) || '年营业收入变化是多少？', company, y, 'revenue',
    y || '年' || format('{:,}', v) || '千元；' || (y + 1) || '年' || format('{:,}', w) || '千元；' || (y + 1) || '年-' || y || '年：' || format('{:,}', w) || '千元-' || format('{:,}', v) || '千元=' || format('{:,}', w - v) || '千元，变化率='
    || replace(format('{:,.2f}', round_even((w - v) / CAST(abs(v) AS DOUBLE) * 100, 2)), '-0.', '0.') || '%', NULL, 'cross_year', [y, y + 1] FROM pair
  UNION ALL SELECT DISTINCT 'c' || k, company || '1987年营业收入是多少？', company, 0, 'revenue', '当前年报语料只覆盖 ' || list_aggregate(known.years, 'string_agg', '、') || ' 年，未覆盖 1987 年，因此无法基于现有资料可靠回答。', 'period_not_covered', 'out_of_scope', [1987] FROM corp, known
  UNION ALL SELECT DISTINCT 'd' || y, '请问远方集团' || y || '年营业收入是多少？', NULL, y, 'revenue', '当前年报语料只覆盖 ' || list_aggregate(known.companies, 'string_agg', '、') || '，未收录 远方集团，因此无法基于现有资料可靠回答。', 'company_not_covered', 'out_of_scope', [y] FROM corp, known
  UNION ALL SELECT 'e' || k || '-' || y, company || y || '年海外营业收入是多少？', company, y, 'revenue', '没有找到同时满足公司、年份、字段和页码要求的完整证据，因此拒绝作答。', 'insufficient_evidence', 'single_fact', [y] FROM corp
  UNION ALL SELECT 'f' || k || '-' || y, company || y || '年的审计机构是谁？', company, y, NULL, '当前受控回答器尚不支持该问题所需的财务字段。', 'unsupported_fact', 'single_fact', [y] FROM corp
  UNION ALL SELECT 't' || k || '-' || y, company || y || '年技术人员有多少？', company, y, 'technical_employees', format('{:,}', staff) || '人', NULL, 'single_fact', [y] FROM corp)"""


def _figures(spark, sf_dir):
    """Each nation's orders by year, summed once and kept in the shared folder until the tables change: a row a nation and year."""
    version = [shared.version(table(spark, sf_dir, t)) for t in ("orders", "customer", "nation")]
    path = shared.made_once(spark, shared.path_of(spark, "figures", *version), lambda own: _sums(spark, sf_dir).coalesce(1).write.parquet(own))
    return spark.read.schema("k int, r int, y int, v long, staff long, company string").parquet(path)


def _sums(spark, sf_dir):
    orders, customers, nations = (table(spark, sf_dir, t) for t in ("orders", "customer", "nation"))
    rows = orders.join(customers, F.col("o_custkey") == F.col("c_custkey")).join(nations, F.col("c_nationkey") == F.col("n_nationkey"))
    sums = rows.groupBy(F.col("c_nationkey").alias("k"), F.col("n_regionkey").alias("r"), F.year("o_orderdate").alias("y")).agg(F.floor(F.sum(F.col("o_totalprice").cast("decimal(28,2)"))).cast("long").alias("v"), F.count("*").alias("staff"))
    return sums.withColumn("company", F.concat(F.lit("第"), F.col("k").cast("string"), F.lit("公司")))


def _plain(c):
    return F.format_number(F.col(c) if isinstance(c, str) else c, 0)


def _reports(spark, sf_dir):
    rows = _figures(spark, sf_dir).withColumn("document_id", F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("-"), F.col("y").cast("string")))
    annual = F.concat(F.lit("主要会计数据和财务指标 单位：千元 营业收入 "), _plain("v"), F.lit(" 公司员工情况 技术人员 "), _plain("staff"))
    quarter = F.concat(F.lit("分季度主要财务指标 第一季度 营业收入 "), _plain(F.floor(F.col("v") / 4)))
    passages = F.array(F.struct(F.lit(":0000").alias("n"), F.lit("主要会计数据").alias("section"), (F.col("k") + 10).alias("page"), annual.alias("text")), F.struct(F.lit(":0001").alias("n"), F.lit("分季度").alias("section"), (F.col("k") * 0 + 5).alias("page"), quarter.alias("text")))
    rows = rows.withColumn("p", F.explode(passages))
    return rows.select(F.concat("document_id", "p.n").alias("chunk_id"), "document_id", "company", F.col("y").cast("int").alias("year"), "p.section", F.col("p.page").cast("int").alias("page"), "p.text", "r", "k")


def _asked_of_reports(spark, sf_dir):
    """(query_id, query, k, r, y), questions of seven kinds on every report; those of unknown companies have no k."""
    rows, text = _figures(spark, sf_dir), lambda *parts: F.concat(*(F.lit(p) if p[:1] not in "~" else F.col(p[1:]).cast("string") for p in parts))
    kind = lambda df, letter, *parts: df.select(text(letter, "~k", "-", "~y").alias("query_id"), text(*parts).alias("query"), "k", "r", "y")
    pairs = rows.join(rows.select("k", (F.col("y") - 1).alias("y"), F.col("y").alias("z")), ["k", "y"])
    old = rows.select("k", "r", "company", F.lit(0).alias("y")).distinct().select(text("c", "~k").alias("query_id"), text("~company", "1987年营业收入是多少？").alias("query"), "k", "r", "y")
    strange = rows.select("y").distinct().select(text("d", "~y").alias("query_id"), text("请问远方集团", "~y", "年营业收入是多少？").alias("query"), F.lit(None).cast("long").alias("k"), F.lit(None).cast("long").alias("r"), "y")
    parts = [kind(rows, "a", "~company", "~y", "年营业收入是多少？"), kind(pairs, "b", "~company", "~y", "年和", "~z", "年营业收入变化是多少？"), old, strange, kind(rows, "e", "~company", "~y", "年海外营业收入是多少？"), kind(rows, "f", "~company", "~y", "年的审计机构是谁？"), kind(rows, "t", "~company", "~y", "年技术人员有多少？")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


def _routed(spark, sf_dir):
    return routing.route(_asked_of_reports(spark, sf_dir).select("query_id", "query"), routing.scope(_reports(spark, sf_dir)))


def _answered(spark, sf_dir):
    """Each question with all passages of its region as evidence, in the order of their ids."""
    rank = F.dense_rank().over(Window.partitionBy("query_id").orderBy("chunk_id"))
    hits = _asked_of_reports(spark, sf_dir).select("query_id", "r").join(_reports(spark, sf_dir).drop("k"), "r").withColumns({"score": F.lit(1.0), "rank": rank, "source": F.lit("reranker")}).drop("r")
    routed = _routed(spark, sf_dir)
    chosen = answering.evidence(routed, hits)
    return routed, chosen, answering.answers(routed, chosen)


_PASSAGES = """passages AS (
  SELECT 'r' || k || '-' || y || ':0000' AS chunk_id, '主要会计数据和财务指标 单位：千元 营业收入 ' || format('{:,}', v) || ' 公司员工情况 技术人员 ' || format('{:,}', staff) AS text FROM corp
  UNION ALL SELECT 'r' || k || '-' || y || ':0001', '分季度主要财务指标 第一季度 营业收入 ' || format('{:,}', v // 4) FROM corp)"""


@query(f"WITH {_CORPUS}, {_PASSAGES} SELECT chunk_id, {_TOKENS.format('text')} AS tokens FROM passages")
def cjk_tokenize(spark, sf_dir):
    """Chinese passages: runs give their characters, bigrams and, if short, themselves, and numbers their parts."""
    return _reports(spark, sf_dir).select("chunk_id", text.tokenize(F.col("text")).alias("tokens"))


#: For each fact a question's words, what a passage says of it, and what the value is as written; {} is a number with commas (made for the tests of the rules).
_SAYINGS = {
    "revenue": ("营业收入", "主要会计数据和财务指标 单位：千元 营业收入 {} 其他", "{}千元", "千元"),
    "net_profit": ("净利润", "单位：万元 归属于上市公司股东的净利润 {}", "{}万元", "万元"),
    "operating_cash_flow": ("经营活动产生的现金流量净额", "经营活动产生的现金 流量净额（亿元） {}", "{}亿元", "亿元"),
    "basic_eps": ("基本每股收益", "基本每股收 益 {}", "{}元/股", "元/股"),
    "roe": ("加权平均净资产收益率", "加权平均净资产收益 率 {}%", "{}%", "%"),
    "total_assets": ("总资产", "单位：元 资产总 额 {}", "{}元", "元"),
    "net_assets": ("归属于上市公司股东的净资产", "归属于上市公司股东 的净资产 {}", "{}元", "元"),
    "rnd_ratio": ("研发投入占营业收入比例", "研发投入占营业收入比例 {}%", "{}%", "%"),
    "rnd_staff": ("研发人员数量", "公司研发人员情况 研发人员数量（人） {}", "{}人", "人"),
    "rnd_amount": ("研发投入金额", "近三年公司研发投入金额 研发投入金额（元） {}", "{}元", "元"),
    "employees_total": ("在职员工总数", "公司员工情况 报告期末在职员工的数量合计（人） {}", "{}人", "人"),
    "technical_employees": ("技术人员", "公司员工情况 技术人员 {}", "{}人", "人"),
    "dividend_per_10": ("每10股现金红利", "每 10 股派发现金红利 {} 元（含税）", "{}元（含税）", "元"),
}
_SAID = "said(fact, asked, says, shown, unit) AS (VALUES " + ", ".join(f"('{f}', '{a}', '{t}', '{v}', '{u}')" for f, (a, t, v, u) in _SAYINGS.items()) + ")"


@query(f"""WITH {_CORPUS}, {_SAID} SELECT 's' || k || '-' || y || '-' || fact AS query_id, fact, replace(shown, '{{}}', format('{{:,}}', v)) AS value_text, unit, CAST(v AS DOUBLE) AS number, length(says) > 0 AS answered FROM corp, said""")
def fact_values(spark, sf_dir):
    """Every fact asked of every nation and year, with its value found in a passage among passages on all other facts."""
    said = F.explode(F.from_json(F.lit(json.dumps([dict(zip(("fact", "asked", "says"), (f, a, t), strict=True)) for f, (a, t, _, _) in _SAYINGS.items()])), "array<struct<fact: string, asked: string, says: string>>"))
    rows = _figures(spark, sf_dir).withColumn("s", said).select("k", "y", "company", "v", "s.*")
    asked_ = rows.select(F.concat(F.lit("s"), "k", F.lit("-"), "y", F.lit("-"), "fact").alias("query_id"), F.concat("company", F.col("y").cast("string"), F.lit("年"), "asked", F.lit("是多少？")).alias("query"), "k", "y")
    passage = F.replace(F.col("says"), F.lit("{}"), _plain("v"))
    passages = rows.select("k", "y", "company", passage.alias("text"), F.row_number().over(Window.partitionBy("k", "y").orderBy("fact")).alias("rank"))
    reports = passages.select(F.concat(F.lit("r"), "k", F.lit("-"), "y", F.lit(":"), "rank").alias("chunk_id"), F.concat(F.lit("r"), "k", F.lit("-"), "y").alias("document_id"), "company", F.col("y").cast("int").alias("year"), F.lit("").alias("section"), F.lit(1).alias("page"), "text", "k", "y", "rank")
    routed = routing.route(asked_.select("query_id", "query"), routing.scope(reports))
    hits = asked_.select("query_id", "k", "y").join(reports, ["k", "y"]).drop("k", "y").withColumns({"score": F.lit(1.0), "source": F.lit("reranker")})
    chosen = answering.evidence(routed, hits)
    told = answering.answers(routed, chosen).select("query_id", (F.col("status") == "answered").alias("answered"))
    return chosen.select("query_id", "fact", "value_text", "unit", F.col("numeric_value").cast("double").alias("number")).join(told, "query_id")


@query(f"WITH {_CORPUS} SELECT companies, years AS scope_years FROM known")
def scope_summary(spark, sf_dir):
    return routing.scope(_reports(spark, sf_dir))


@query(f"WITH {_CORPUS} SELECT query_id, CASE WHEN company IS NULL THEN []::VARCHAR[] ELSE [company] END AS companies, years, kind AS task_type, CASE WHEN kind = 'out_of_scope' THEN reason END AS refusal_reason, CASE WHEN kind = 'out_of_scope' THEN answer END AS message FROM asked")
def route_queries(spark, sf_dir):
    return _routed(spark, sf_dir).select("query_id", "companies", "years", "task_type", "refusal_reason", "message")


@query(f"""WITH {_CORPUS} SELECT query_id, query || CASE WHEN fact = 'revenue' THEN ' 主要会计数据 财务指标' WHEN fact = 'technical_employees' THEN ' 公司员工情况 员工数量 专业构成 教育程度' ELSE '' END AS expanded FROM asked""")
def expand_queries(spark, sf_dir):
    return _asked_of_reports(spark, sf_dir).select("query_id", routing.expand(F.col("query")).alias("expanded"))


@query(f"""WITH {_CORPUS} SELECT query_id, round_index, query || CASE WHEN round_index = 1 THEN '' ELSE CASE fact WHEN 'revenue' THEN ' 营业收入 主要会计数据和财务指标 合并利润表' WHEN 'technical_employees' THEN ' 技术人员 公司员工情况 专业构成' ELSE ' 年度报告' END
  || ' 年度 全年 报告期 年度报告全文 非分季度' || CASE WHEN starts_with(query_id, 'e') THEN ' 年度主要会计数据 本年数 全年数据' ELSE '' END || CASE WHEN round_index = 3 THEN ' 合并财务报表 本期金额 审计报告附表' ELSE '' END END AS rewritten
FROM asked, (SELECT unnest([1, 2, 3]) AS round_index)""")
def rewrite_rounds(spark, sf_dir):
    rows = _routed(spark, sf_dir).withColumn("round_index", F.explode(F.array(*map(F.lit, (1, 2, 3)))))
    return rows.select("query_id", "round_index", routing.rewrite(F.col("query"), F.col("years"), F.col("round_index"), F.col("query_id").startswith("e")).alias("rewritten"))


@query(f"""WITH {_CORPUS} SELECT DISTINCT a.query_id, CASE WHEN c.k IS NOT NULL THEN 'r' || c.k || '-' || c.y END AS document_id
FROM asked a LEFT JOIN corp c ON (c.company = a.company OR a.company IS NULL) AND list_contains(a.years, c.y)""")
def metadata_filter(spark, sf_dir):
    return routing.allowed(_asked_of_reports(spark, sf_dir), _reports(spark, sf_dir).select("document_id", "company", "year").distinct())


@query(f"WITH {_CORPUS} SELECT query_id, fact FROM asked")
def fact_spec_match(spark, sf_dir):
    return _asked_of_reports(spark, sf_dir).select("query_id", facts.fact_of(F.col("query")).alias("fact"))


@query(f"""WITH {_CORPUS} SELECT 'r' || k || '-' || y || ':0000' AS chunk_id, format('{{:,}}', v) || '千元' AS value_text, '千元' AS unit, CAST(v AS DOUBLE) AS number FROM corp
UNION ALL SELECT 'r' || k || '-' || y || ':0001', format('{{:,}}', v // 4) || '元', '元', CAST(v // 4 AS DOUBLE) FROM corp""")
def extract_values(spark, sf_dir):
    rows = _reports(spark, sf_dir).withColumn("v", facts.extract(F.col("text"), F.lit("revenue"))).where("v is not null")
    return rows.select("chunk_id", "v.value_text", "v.unit", F.col("v.numeric_value").cast("double").alias("number"))


@query(f"WITH {_CORPUS} SELECT query_id, CASE WHEN reason IS NULL THEN 'answered' ELSE 'refused' END AS status, answer, reason FROM asked")
def answer_questions(spark, sf_dir):
    return _answered(spark, sf_dir)[2].select("query_id", "status", "answer", "reason")


@query(f"""WITH {_CORPUS} SELECT query_id, CASE WHEN reason IS NULL THEN 'sufficient' ELSE 'terminal_refusal' END AS assessment,
  CASE WHEN reason IS NULL THEN 'answer_supported_by_complete_evidence' WHEN reason = 'insufficient_evidence' THEN 'constraint_not_disclosed_after_confirmation' ELSE reason END AS reasons,
  CASE WHEN reason = 'insufficient_evidence' THEN 0.9::DOUBLE ELSE 1.0 END AS confidence,
  CASE WHEN reason IS NOT NULL THEN '' ELSE list_aggregate(list_transform(years, lambda x: 'r' || replace(replace(company, '第', ''), '公司', '') || '-' || x || ':0000'), 'string_agg', ',') END AS selected FROM asked""")
def verify_evidence(spark, sf_dir):
    _, chosen, answered = _answered(spark, sf_dir)
    judged = answering.verify(answered, chosen, F.lit(2))
    return judged.select("query_id", "assessment", F.array_join("reasons", ",").alias("reasons"), F.col("confidence").cast("double").alias("confidence"), F.array_join("selected_chunk_ids", ",").alias("selected"))


def _looped(spark, sf_dir):
    """The questions for a year's revenue, abroad or not, with their runs under the three policies. Nations of an even number find only the quarter's passage at first.

    The run is kept in the shared folder and shared by all that ask for it.
    """
    asked_ = _asked_of_reports(spark, sf_dir).where("query_id like 'a%' or query_id like 'e%'")
    reports = _reports(spark, sf_dir)
    own = asked_.join(reports.withColumnRenamed("year", "y").drop("r"), ["k", "y"]).withColumnRenamed("y", "year")
    first = F.when((F.col("k") % 2 == 0) == F.col("chunk_id").endswith(":0001"), 1).otherwise(2)
    rounds = own.select("query_id", "chunk_id", "document_id", "company", F.col("year").cast("int").alias("year"), "section", "page", "text", F.lit(1.0).alias("score"), F.lit("reranker").alias("source"), F.lit(1).alias("rank"), first.alias("round_index"))
    policies = ((answering.STATIC, 1), (answering.ALWAYS, 3), (answering.ADAPTIVE, 3))
    made_of = [shared.version(table(spark, sf_dir, t)) for t in ("orders", "customer", "nation")]
    return asked_, loop.run_rounds(asked_.select("query_id", "query"), routing.scope(reports), rounds, policies, path=shared.path_of(spark, "rounds", *made_of, policies))


def _details(spark, sf_dir):
    """The run's answers next to their labels; some that are answered are labelled as not to be."""
    asked_, run = _looped(spark, sf_dir)
    label = asked_.join(_figures(spark, sf_dir).select("k", "y", "v"), ["k", "y"])
    answerable = F.col("query_id").startswith("a")
    gold = F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("-"), F.col("y").cast("string"), F.lit(":0000"))
    labels = label.select(
        "query_id", F.when(answerable & (F.col("k") % 7 != 0), "answerable_dev").otherwise("hard_no_answer_dev").alias("group"), F.when(answerable, F.concat(_plain("v"), F.lit("千元"))).alias("expected"),
        F.when(answerable, F.array(gold)).otherwise(F.array().cast("array<string>")).alias("gold"), F.when(answerable, F.array((F.col("k") + 10).cast("int"))).otherwise(F.array().cast("array<int>")).alias("pages"),
    )
    return loop.details(run.answers, run.evidence, labels)


_LOOP = f"""{_CORPUS}, policies(policy, most) AS (VALUES ('static_rag', 1), ('always_agentic', 3), ('adaptive_budget_aware', 3)),
runs AS (
  SELECT policy, 'a' || k || '-' || y AS query_id, k, v, CASE WHEN policy = 'adaptive_budget_aware' THEN CASE WHEN k % 2 = 0 THEN 2 ELSE 1 END ELSE most END AS rounds,
         CASE WHEN k % 2 = 0 AND policy = 'static_rag' THEN format('{{:,}}', v // 4) || '元' ELSE format('{{:,}}', v) || '千元' END AS answer FROM corp, policies
  UNION ALL SELECT policy, 'e' || k || '-' || y, k, v, least(most, 2), '没有找到同时满足公司、年份、字段和页码要求的完整证据，因此拒绝作答。' FROM corp, policies)"""


@query(f"WITH {_LOOP} SELECT policy, query_id, rounds, answer FROM runs")
def policy_rounds(spark, sf_dir):
    return _looped(spark, sf_dir)[1].answers.select("policy", "query_id", F.col("round_index").alias("rounds"), "answer")


@query(f"""WITH {_LOOP}, s AS (SELECT *, unnest(range(1, rounds + 1)) AS round_index FROM runs)
SELECT policy, query_id, CAST(round_index AS INTEGER) AS round_index, CASE WHEN round_index < rounds THEN 'retrieve_more' ELSE 'stop' END AS action,
  CASE WHEN starts_with(query_id, 'e') AND round_index = 2 THEN 'terminal_refusal' WHEN round_index = CASE policy WHEN 'static_rag' THEN 1 ELSE 3 END THEN 'round_budget_exhausted'
       WHEN policy = 'always_agentic' THEN 'always_agentic_forced_escalation' WHEN round_index < rounds THEN 'evidence_insufficient' ELSE 'adaptive_evidence_sufficient' END AS action_reason FROM s""")
def trajectory_steps(spark, sf_dir):
    return _looped(spark, sf_dir)[1].steps.select("policy", "query_id", "round_index", "action", "action_reason")


@query(f"""WITH {_LOOP} SELECT policy, rounds, CAST(rounds * 10 AS BIGINT) AS passages_reranked, CAST(rounds AS BIGINT) AS reranker_calls, rounds * 4.0::DOUBLE AS wall_ms, count(*) AS tasks FROM runs GROUP BY ALL""")
def trajectory_usage(spark, sf_dir):
    cost = {c: F.lit(1) for c in loop.COUNTERS} | {"passages_reranked": F.lit(10), "cost_usd": F.lit(0.0)} | {c: F.lit(1.0) for c in loop.TIMES}
    usage = loop.summarize_usage(_looped(spark, sf_dir)[1].steps.withColumns(cost))
    return usage.groupBy("policy", F.col("rounds").cast("int").alias("rounds"), F.col("passages_reranked").cast("long").alias("passages_reranked"), F.col("reranker_calls").cast("long").alias("reranker_calls"), "wall_ms").agg(F.count("*").alias("tasks"))


@query(f"""WITH {_LOOP}, d AS (SELECT policy, starts_with(query_id, 'a') AND k % 7 <> 0 AS open, starts_with(query_id, 'e') AS refused, (k % 2 = 1 OR policy <> 'static_rag') AS good FROM runs),
g AS (SELECT policy, count(*) FILTER (WHERE open) AS n, count(*) FILTER (WHERE open AND good) AS ok, count(*) FILTER (WHERE NOT open) AS m, count(*) FILTER (WHERE NOT open AND refused) AS rightly FROM d GROUP BY policy)
SELECT policy, n AS answerable_questions, ok / n::DOUBLE AS exact_answer_accuracy, ok / n::DOUBLE AS all_gold_evidence_recall, ok / n::DOUBLE AS citation_chunk_precision, ok / n::DOUBLE AS citation_page_set_accuracy, m AS hard_no_answer_questions, rightly / m::DOUBLE AS hard_no_answer_refusal_accuracy FROM g""")
def quality_metrics(spark, sf_dir):
    return metrics.quality(_details(spark, sf_dir))


def _labelled_questions(spark, sf_dir):
    """Questions for a year's revenue with the answer and the gold passage: of every fifth nation a wrong one, the quarter's."""
    asked_, run = _looped(spark, sf_dir)
    chunk = F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("-"), F.col("y").cast("string"), F.when(F.col("k") % 5 == 0, ":0001").otherwise(":0000"))
    rows = asked_.where("query_id like 'a%'").join(_figures(spark, sf_dir).select("k", "y", "v"), ["k", "y"])
    return rows.select("query_id", "query", F.concat(_plain("v"), F.lit("千元")).alias("expected"), F.array(chunk).alias("relevant_chunk_ids")), run


def _lost(spark, sf_dir):
    items, run = _labelled_questions(spark, sf_dir)
    static = F.col("policy") == answering.STATIC
    return replays.losses(items, replays.on_gold(items, _reports(spark, sf_dir)), run.answers.where(static), run.evidence.where(static))


_LOST = f"""{_CORPUS}, lost AS (SELECT 'a' || k || '-' || y AS query_id, k % 5 <> 0 AS oracle_exact, k % 2 = 1 AS path_exact, CASE WHEN k % 2 = 1 THEN 'none' WHEN k % 5 = 0 THEN 'extraction' ELSE 'retrieval' END AS loss FROM corp)"""


@query(f"WITH {_LOST} SELECT query_id, 'answered' AS oracle_status, oracle_exact, path_exact, loss FROM lost")
def oracle_extraction(spark, sf_dir):
    return _lost(spark, sf_dir)


@query(f"""WITH {_LOST} SELECT count(*) AS questions, 1.0::DOUBLE AS answer_rate, avg(oracle_exact::INTEGER) AS exact_answer_accuracy, avg(path_exact::INTEGER) AS path_accuracy, count(*) FILTER (WHERE loss = 'routing') AS lost_routing,
 count(*) FILTER (WHERE loss = 'extraction') AS lost_extraction, count(*) FILTER (WHERE loss = 'retrieval') AS lost_retrieval, count(*) FILTER (WHERE loss = 'selection') AS lost_selection FROM lost""")
def oracle_summary(spark, sf_dir):
    return replays.summary(_lost(spark, sf_dir))


@query(f"""WITH {_CORPUS}, e AS (SELECT 'a' || k || '-' || y AS query_id, 'r' || k || '-' || y || ':000' AS c, * FROM corp WHERE k % 2 = 0),
d AS (SELECT query_id, 'answer' AS path, format('{{:,}}', v // 4) || '元' AS "before", format('{{:,}}', v) || '千元' AS "after" FROM e
  UNION ALL SELECT query_id, 'citations[' || c || '1].chunk_id', c || '1', NULL FROM e UNION ALL SELECT query_id, 'citations[' || c || '1].page', '5', NULL FROM e
  UNION ALL SELECT query_id, 'citations[' || c || '0].chunk_id', NULL, c || '0' FROM e UNION ALL SELECT query_id, 'citations[' || c || '0].page', NULL, CAST(k + 10 AS VARCHAR) FROM e)
SELECT query_id, path, CASE WHEN "before" IS NULL THEN 'added' WHEN "after" IS NULL THEN 'removed' ELSE 'changed' END AS change, "before", "after" FROM d""")
def answer_replay_diff(spark, sf_dir):
    """The static run's saved answers against those of the adaptive run's saved passages, answered again."""
    asked_, run = _looped(spark, sf_dir)
    again = replays.answered_again(run.steps.where(F.col("policy") == answering.ADAPTIVE), asked_, _reports(spark, sf_dir))
    told = lambda rows: rows.select("query_id", "status", "reason", "answer", F.transform("citations", lambda c: F.struct(c["chunk_id"].alias("chunk_id"), c["page"].alias("page"))).alias("citations"))
    saved = run.answers.where((F.col("policy") == answering.STATIC))
    return replays.differences(told(saved), told(again), ["query_id"], ["status", "reason", "answer", "citations"])


@query(f"""WITH {_CORPUS}, n AS (SELECT query_id, kind = 'out_of_scope' AS refused, CASE WHEN kind = 'out_of_scope' THEN reason END AS given, CAST(regexp_extract(query_id, '[0-9]+') AS INTEGER) AS i FROM asked),
s AS (SELECT *, (query_id[1] IN ('c', 'd') AND NOT (query_id[1] = 'c' AND i % 4 = 0)) OR (query_id[1] = 'a' AND i % 3 = 0) AS hard FROM n)
SELECT count(*) FILTER (WHERE NOT hard) AS dev, count(*) FILTER (WHERE hard) AS no_answer, count(*) FILTER (WHERE NOT hard AND NOT refused) / count(*) FILTER (WHERE NOT hard)::DOUBLE AS dev_accept_rate,
  count(*) FILTER (WHERE hard AND refused) / count(*) FILTER (WHERE hard)::DOUBLE AS no_answer_refusal_accuracy, count(*) FILTER (WHERE hard AND given = 'period_not_covered') / count(*) FILTER (WHERE hard)::DOUBLE AS no_answer_reason_accuracy,
  count(*) FILTER (WHERE hard = refused) / count(*)::DOUBLE AS overall_decision_accuracy, list(query_id ORDER BY query_id) FILTER (WHERE NOT hard AND refused) AS false_refusals, list(query_id ORDER BY query_id) FILTER (WHERE hard AND NOT refused) AS missed_refusals FROM s""")
def scope_guard(spark, sf_dir):
    """Some questions out of scope are labelled as within it, and some within it as out of it: refusals that are wrong or missing."""
    of, i = (lambda kind: F.col("query_id").rlike(f"^[{kind}]")), F.regexp_extract("query_id", "[0-9]+", 0).cast("int")
    hard = (of("cd") & ~(of("c") & (i % 4 == 0))) | (of("a") & (i % 3 == 0))
    return metrics.scope_guard(_routed(spark, sf_dir).withColumns({"split": F.when(hard, "no_answer").otherwise("dev"), "expected_reason": F.when(hard, "period_not_covered")}))


@query(f"WITH {_CORPUS} SELECT kind AS task_type, count(*) AS questions FROM asked GROUP BY kind")
def route_histogram(spark, sf_dir):
    return metrics.route_counts(_routed(spark, sf_dir))


@query(f"""WITH {_CORPUS} SELECT query_id, CASE WHEN reason IS NULL AND starts_with(query_id, 't') THEN '主要会计数据和财务指标' || chr(10) || '单位：千元' || chr(10) ELSE '' END AS span_start, 'r' || c.k || '-' || c.y || ':0000' AS kept
FROM asked a JOIN corp c ON c.company = a.company AND c.y = a.y WHERE starts_with(query_id, 't')""")
def evidence_spans(spark, sf_dir):
    asked_ = _asked_of_reports(spark, sf_dir).where("query_id like 't%'")
    hits = asked_.join(_reports(spark, sf_dir).where("chunk_id like '%:0000'").withColumnRenamed("year", "y").drop("r"), ["k", "y"]).withColumnRenamed("y", "year").withColumn("rank", F.lit(1))
    packed = context.build(hits.drop("query"), asked_, spans=True)
    return packed.select("query_id", F.substring(F.col("bodies")[0], 1, 18).alias("span_start"), F.col("kept")[0].alias("kept"))


@query("""WITH e AS (SELECT event_id, ['static_rag', 'always_agentic', 'adaptive_budget_aware'][user_id % 3 + 1] AS policy, [1, 3, 3][user_id % 3 + 1] AS max_rounds, ['sufficient', 'insufficient', 'terminal_refusal'][event_id % 3 + 1] AS assessment, event_id // 3 % 3 + 1 AS round_index FROM events)
SELECT event_id, CASE WHEN assessment = 'terminal_refusal' OR round_index >= max_rounds OR policy = 'static_rag' OR (policy = 'adaptive_budget_aware' AND assessment <> 'insufficient') THEN 'stop' ELSE 'retrieve_more' END AS action,
 CASE WHEN assessment = 'terminal_refusal' THEN 'terminal_refusal' WHEN round_index >= max_rounds THEN 'round_budget_exhausted' WHEN policy = 'static_rag' THEN 'static_single_round_policy' WHEN policy = 'always_agentic' THEN 'always_agentic_forced_escalation'
  WHEN assessment = 'insufficient' THEN 'evidence_insufficient' ELSE 'adaptive_evidence_sufficient' END AS reason FROM e""")
def policy_decisions(spark, sf_dir):
    """Each event as a round of a run: every policy, assessment and round in turn."""
    turn = lambda i, *of: F.element_at(F.array(*map(F.lit, of)), (i % 3 + 1).cast("int"))
    user, event = F.col("user_id"), F.col("event_id")
    rows = table(spark, sf_dir, "events").select("event_id", turn(user, "static_rag", "always_agentic", "adaptive_budget_aware").alias("policy"), turn(user, 1, 3, 3).alias("max_rounds"), turn(event, "sufficient", "insufficient", "terminal_refusal").alias("assessment"), (F.floor(event / 3) % 3 + 1).cast("int").alias("round_index"))
    chosen = answering.decide(F.col("assessment"), F.col("policy"), F.col("round_index"), F.col("max_rounds"))
    return rows.select("event_id", chosen["action"].alias("action"), chosen["reason"].alias("reason"))


@query("""WITH y AS (SELECT year(o_orderdate) AS year, CAST(sum(CAST(o_totalprice AS DECIMAL(28, 2))) AS DECIMAL(28, 2)) AS revenue FROM orders GROUP BY 1),
p AS (SELECT year, revenue, lag(revenue) OVER (ORDER BY year) AS old FROM y)
SELECT year, CAST(revenue - old AS DOUBLE) AS difference, round(CAST(revenue - old AS DOUBLE) / CAST(abs(old) AS DOUBLE) * 100, 6) AS percent FROM p WHERE old IS NOT NULL""")
def yoy_change(spark, sf_dir):
    sums = table(spark, sf_dir, "orders").groupBy(F.year("o_orderdate").alias("year")).agg(F.sum(F.col("o_totalprice").cast("decimal(28,2)")).cast("decimal(28,2)").alias("revenue"))
    rows = sums.withColumn("old", F.lag("revenue").over(Window.orderBy("year"))).where("old is not null")  # one row a year
    difference, percent = answering.change(F.col("old"), F.col("revenue"))
    return rows.select(F.col("year").cast("long").alias("year"), difference.cast("double").alias("difference"), F.round(percent.cast("double"), 6).alias("percent"))


def _trajectory(spark, sf_dir):
    events = table(spark, sf_dir, "events")
    return events.select(F.col("event_type").alias("policy"), F.col("user_id").alias("query_id"), F.col("event_id").alias("round_index"), F.lit(10).alias("passages"), F.coalesce(F.col("value"), F.lit(0.0)).alias("wall_ms"), (F.col("event_id") % 3 == 0).alias("correct"))


@query("""WITH t AS (SELECT event_type AS policy, user_id, count(*) AS rounds, count(*) * 10 AS passages, sum(coalesce(value, 0)) AS ms, max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) AS correct FROM events GROUP BY ALL)
SELECT policy, count(*) AS tasks, CAST(sum(correct) AS BIGINT) AS correct_tasks, round(avg(rounds), 9) AS mean_rounds, round(avg(CASE WHEN rounds > 1 THEN 1.0::DOUBLE ELSE 0 END), 9) AS escalation_rate, CAST(sum(passages) AS BIGINT) AS passages,
       round(avg(ms), 6) AS mean_ms, round(quantile_cont(ms, 0.5), 6) AS p50_ms, round(quantile_cont(ms, 0.95), 6) AS p95_ms, round(coalesce(sum(passages) / nullif(sum(correct), 0), 0), 6) AS passages_per_correct,
       round(coalesce(sum(ms) / nullif(sum(correct), 0), 0), 6) AS ms_per_correct, 0.0::DOUBLE AS usd_per_correct FROM t GROUP BY policy""")
def budget_metrics(spark, sf_dir):
    return metrics.budget(_trajectory(spark, sf_dir))


@query("""WITH l AS (SELECT lang, event_id, CASE WHEN event_id % 4 <> 0 THEN 0 END AS x FROM (SELECT event_type AS lang, event_id FROM events))
SELECT lang AS event_type, count(*) AS entries, CAST(sum(event_id % 100) AS BIGINT) AS input_tokens, CAST(sum(event_id % 7) AS BIGINT) AS output_tokens, CAST(sum(event_id % 100 + event_id % 7) AS BIGINT) AS total_tokens, CAST(0 AS BIGINT) AS cached_tokens, count(*) AS calls, NULL::DOUBLE AS cost, count(x) / count(*)::DOUBLE AS price_coverage FROM l GROUP BY lang""")
def token_ledger(spark, sf_dir):
    rows = table(spark, sf_dir, "events").select("event_type", (F.col("event_id") % 100).alias("input_tokens"), (F.col("event_id") % 7).alias("output_tokens"), F.lit(0).cast("long").alias("cached_tokens"), F.when(F.col("event_id") % 4 != 0, 0.0).alias("cost"))
    return ledger.totals(ledger.checked(rows), "event_type")


@query("""WITH e AS (SELECT event_id, event_id % 1000 AS i, user_id % 200 AS o, event_id % 1500 AS c, CASE WHEN event_id % 7 > 0 THEN 2.0::DOUBLE END AS ri, CASE WHEN event_id % 3 = 0 THEN 0.5::DOUBLE END AS rc, CASE WHEN user_id % 5 > 0 THEN 8.0::DOUBLE END AS ro FROM events)
SELECT event_id, round(((i - least(c, i)) * ri + least(c, i) * coalesce(rc, ri) + o * ro) / 1000000, 12) AS usd FROM e""")
def cost_usd(spark, sf_dir):
    """Each event as a call: some without a price, some whose cached tokens have none of their own, or are more than the input."""
    event, user = F.col("event_id"), F.col("user_id")
    usd = ledger.cost(event % 1000, user % 200, event % 1500, F.when(event % 7 > 0, 2.0), F.when(event % 3 == 0, 0.5), F.when(user % 5 > 0, 8.0))
    return table(spark, sf_dir, "events").select("event_id", F.round(usd, 12).alias("usd"))


@query(f"WITH {_CORPUS} SELECT query_id, CASE WHEN starts_with(query_id, 'b') THEN 'large' ELSE 'small' END AS model, CASE WHEN starts_with(query_id, 'b') THEN 'multi_period' ELSE 'single_fact_sufficient_evidence' END AS reason FROM asked")
def choose_model(spark, sf_dir):
    chosen = ledger.choose_model(F.col("query"), F.lit(1), F.lit(0))
    return _asked_of_reports(spark, sf_dir).select("query_id", chosen["model"].alias("model"), chosen["reason"].alias("reason"))


def _pack(count, gap, most):
    """A question's hits taken in rank order until the budget is used; count: SQL of a text's tokens."""
    shown = f"least(body, {most} - used - gap - head)"
    return f"""b AS ({_top("bm")}),
h AS (SELECT b.query_id, b.rank, CAST(b.chunk_id AS VARCHAR) AS chunk_id, {count("'[chunk_id=' || b.chunk_id || ';company=' || coalesce(d.source, 'None') || ';year=2024;page=None;section=' || coalesce(d.lang, 'None') || ']' || chr(10)")} AS head, {count("d.text")} AS body
  FROM b JOIN documents d ON d.doc_id = b.chunk_id),
p AS (
  SELECT DISTINCT query_id, 0 AS rank, 0 AS used, []::VARCHAR[] AS kept FROM h
  UNION ALL
  SELECT query_id, rank, CASE WHEN shown IS NULL THEN used ELSE used + gap + head + shown END, CASE WHEN shown IS NULL THEN kept ELSE list_append(kept, chunk_id) END FROM (
    SELECT h.query_id, h.rank, used, gap, head, kept, chunk_id, CASE WHEN used >= {most} THEN NULL WHEN head + body <= {most} - used - gap THEN body WHEN {shown} > 0 THEN {shown} END AS shown
    FROM (SELECT *, CASE WHEN len(kept) > 0 THEN {gap} ELSE 0 END AS gap FROM p) p JOIN h ON h.query_id = p.query_id AND h.rank = p.rank + 1)),
t AS (SELECT query_id, count(*) AS n, sum(head + body) + {gap} * (count(*) - 1) AS before FROM h GROUP BY query_id)
SELECT p.query_id, CAST(n AS INTEGER) AS chunks_before, CAST(len(kept) AS INTEGER) AS chunks_after, CAST(before AS BIGINT) AS tokens_before, CAST(used AS BIGINT) AS tokens_after, kept, used < before AS truncated, used / before::DOUBLE AS compression
FROM p JOIN t ON t.query_id = p.query_id WHERE p.rank = t.n"""


def _found(spark, sf_dir):
    """The BM25 hits of asked(), to be joined with texts: as up to PAIRS go to the texts, these aren't moved."""
    questions = asked(spark, sf_dir)
    hits = index.search(written(spark, sf_dir), questions, TOP, W)
    return F.broadcast(hits) if questions.count() * TOP <= index.PAIRS else hits


def _hits_to_pack(spark, sf_dir):
    texts = table(spark, sf_dir, "documents").select(F.col("doc_id").alias("chunk_id"), "text", "lang", "source")
    hits = texts.join(_found(spark, sf_dir).drop("source"), "chunk_id")
    return hits.select("query_id", "rank", "chunk_id", F.col("source").alias("company"), F.lit(2024).alias("year"), F.lit(None).cast("int").alias("page"), F.col("lang").alias("section"), F.coalesce("text", F.lit("")).alias("text"))


_PACKED = ("query_id", "chunks_before", "chunks_after", "tokens_before", "tokens_after", "kept", "truncated", "compression")


@query(f"WITH RECURSIVE {_POSTINGS}, " + _pack(lambda text: f"len({text})", 2, 4000))
def context_pack(spark, sf_dir):
    return context.build(_hits_to_pack(spark, sf_dir), asked(spark, sf_dir), top_k=TOP, max_tokens=4000).select(*_PACKED)


@query(f"WITH RECURSIVE {_POSTINGS}, " + _pack(lambda text: f"len(regexp_extract_all({text}, '[^\\x20\\x09-\\x0D]+'))", 0, 700))
def context_pack_words(spark, sf_dir):
    return context.build(_hits_to_pack(spark, sf_dir), asked(spark, sf_dir), top_k=TOP, max_tokens=700, counter=counters.Words()).select(*_PACKED)


@query()
def context_pack_tokens(spark, sf_dir):
    """With the tokens of a sentencepiece model."""
    import public_tokenizers

    counter = counters.SentencePiece.of(public_tokenizers.path("piece_bpe_32k.model"))
    return context.build(_hits_to_pack(spark, sf_dir), asked(spark, sf_dir), top_k=TOP, max_tokens=1500, counter=counter).select(*_PACKED)


@query("SELECT doc_id, CASE WHEN n % 5 = 0 THEN 'validation' ELSE 'train' END AS split FROM (SELECT doc_id, row_number() OVER (ORDER BY doc_id) AS n FROM documents)")
def stride_split(spark, sf_dir):
    rows = training.positions(table(spark, sf_dir, "documents").select("doc_id"), "doc_id")
    return rows.select("doc_id", training.stride_split(F.col("n")).alias("split"))


@query(f"""WITH {_DENSE}, gold AS (SELECT query_id, chunk_id FROM dn WHERE label = query_label),
a AS ({_top("dn", k=30)}), b AS ({_top("dn", "label % 2 = query_label % 2", 30)}),
u AS (SELECT query_id, chunk_id, min(turn * 1000 + rank) AS seen FROM (SELECT *, 0 AS turn FROM a UNION ALL SELECT *, 1 FROM b) GROUP BY ALL),
s AS (SELECT * FROM u WHERE NOT EXISTS (SELECT 1 FROM gold g WHERE g.query_id = u.query_id AND abs(g.chunk_id - u.chunk_id) <= 1))
SELECT CAST(query_id AS VARCHAR) AS query_id, 'v:' || chunk_id AS chunk_id, n FROM (SELECT *, CAST(row_number() OVER (PARTITION BY query_id ORDER BY seen) AS INTEGER) AS n FROM s) WHERE n <= 8""")
def hard_negatives(spark, sf_dir):
    named = lambda df: df.withColumns({c: F.concat(F.lit("v:"), F.col(c).cast("string")) for c in ("query_id", "chunk_id") if c in df.columns})
    _, gold = _relevance(spark, sf_dir)
    rankings = [named(_dense(spark, sf_dir, k=30)), named(_dense(spark, sf_dir, True, 30))]
    found = training.hard_negatives(rankings, metrics.Classes(named(gold.queries), named(gold.chunks), True), 8)
    return found.select(F.expr("substring(query_id, 3)").alias("query_id"), "chunk_id", "n")


@query("""SELECT md5(lower(trim(regexp_replace(text, '[\\s]+', ' ', 'g'), ' '))) AS digest, count(*) AS n, min(doc_id) AS first FROM documents GROUP BY 1 HAVING count(*) > 1""")
def dup_normalized_text(spark, sf_dir):
    return training.repeated_texts(table(spark, sf_dir, "documents"), "doc_id")


@query("SELECT b.item_id, count(d.text) AS documents FROM benchmark b LEFT JOIN documents d ON contains(d.text, b.text) AND b.text <> '' GROUP BY b.item_id")
def benchmark_leakage(spark, sf_dir):
    return training.leaks(spread(table(spark, sf_dir, "documents").select("text")), table(spark, sf_dir, "benchmark").select("item_id", F.col("text").alias("passage")))


@query("""WITH d AS (SELECT source, sha256(coalesce(CAST(doc_id AS VARCHAR), '') || chr(1) || coalesce(text, '')) AS d FROM documents),
b AS (SELECT source, substr(d, 1, 4) AS b, count(*) AS n, sha256(string_agg(d, '' ORDER BY d)) AS d FROM d GROUP BY ALL)
SELECT source, CAST(sum(n) AS BIGINT) AS rows, sha256(string_agg(d, '' ORDER BY b)) AS sha256 FROM b GROUP BY source""")
def sha_manifest(spark, sf_dir):
    return training.manifest(table(spark, sf_dir, "documents"), "source", "doc_id")


@query("SELECT DISTINCT c.c_nationkey AS nation FROM customer c JOIN supplier s ON s.s_nationkey = c.c_nationkey")
def holdout_overlap(spark, sf_dir):
    return table(spark, sf_dir, "customer").select(F.col("c_nationkey").alias("nation")).intersect(table(spark, sf_dir, "supplier").select("s_nationkey"))


@query("WITH m AS (WITH " + _METRICS.format(key="") + ") SELECT * FROM (SELECT 'recall_at_5' AS metric, recall_at_5 AS value, 0.01::DOUBLE AS minimum, recall_at_5 >= 0.01 AS passed FROM m UNION ALL SELECT 'mrr', mrr, 0.99, mrr >= 0.99 FROM m)")
def quality_gates(spark, sf_dir):
    return metrics.gates(recall_mrr_ndcg(spark, sf_dir), {"recall_at_5": 0.01, "mrr": 0.99})


_OUTCOMES = """o AS (SELECT event_type AS policy, user_id, count(*) AS rounds, max(CASE WHEN event_id % 3 = 0 THEN 1 ELSE 0 END) = 1 AS correct, user_id % 7 = 0 AS canary FROM events GROUP BY ALL),
t AS (SELECT CASE WHEN policy = (SELECT min(event_type) FROM events) THEN 'static_rag' ELSE policy END AS policy, user_id, rounds, correct, canary FROM o),
j AS (SELECT t.*, s.correct AS sc FROM t JOIN t s ON s.policy = 'static_rag' AND s.user_id = t.user_id)"""


def _outcomes(spark, sf_dir):
    rows = _trajectory(spark, sf_dir)
    first = F.broadcast(rows.agg(F.min("policy").alias("first")))  # one row
    outcomes = rows.groupBy("policy", "query_id").agg(F.count("*").alias("rounds"), F.max("correct").alias("correct")).withColumn("canary", F.col("query_id") % 7 == 0).crossJoin(first)
    return outcomes.withColumn("policy", F.when(F.col("policy") == F.col("first"), "static_rag").otherwise(F.col("policy")))


@query(f"""WITH {_OUTCOMES}
SELECT policy, coalesce(count(*) FILTER (WHERE rounds > 1 AND sc AND NOT canary) / nullif(count(*) FILTER (WHERE sc AND NOT canary), 0)::DOUBLE, 0) AS unnecessary_escalation,
       coalesce(count(*) FILTER (WHERE rounds = 1 AND NOT sc AND NOT canary) / nullif(count(*) FILTER (WHERE NOT sc AND NOT canary), 0)::DOUBLE, 0) AS missed_escalation, count(*) FILTER (WHERE correct AND NOT sc AND canary) AS recovered,
       count(*) FILTER (WHERE NOT sc AND canary) AS recoverable, coalesce(count(*) FILTER (WHERE correct AND NOT sc AND canary) / nullif(count(*) FILTER (WHERE NOT sc AND canary), 0)::DOUBLE, 0) AS canary_recovery FROM j GROUP BY policy""")
def comparative_routing(spark, sf_dir):
    return metrics.routing(_outcomes(spark, sf_dir))


def _labelled(spark, sf_dir):
    """Documents as answered questions: of good quality answerable, toxic ones wrong."""
    rows = table(spark, sf_dir, "documents").join(table(spark, sf_dir, "labels"), "doc_id")
    good = F.col("quality") == 1
    return rows.select(
        F.col("doc_id").alias("query_id"), "source", F.col("lang").alias("category"), F.col("lang").alias("fact_key"), F.when(good, "answerable_dev").otherwise("hard_no_answer_dev").alias("group"), F.when(good, "answered").otherwise("refused").alias("status"),
        F.when(~good, F.col("source")).alias("reason"), F.coalesce(F.col("toxic") == 0, F.lit(False)).alias("exact"), (~good & (F.col("toxic") == 0)).alias("refusal_correct"), (F.col("n_chars") % 3 > 0).alias("gold_found"),
        (F.col("n_chars") % 4).alias("citations"), (F.col("n_chars") % 4 / 2).cast("int").alias("correct_citations"), (F.col("n_chars") % 2 == 0).alias("pages_match"), (F.col("n_chars") % 5 > 0).alias("likely"),
    ).where("status is not null")


_LABELLED = """l AS (SELECT d.doc_id AS query_id, source, lang, quality = 1 AS good, coalesce(toxic = 0, false) AS exact, n_chars FROM documents d JOIN labels USING (doc_id)),
det AS (SELECT *, NOT coalesce(good, false) AND exact AS refusal_correct, n_chars % 3 > 0 AS gold_found, n_chars % 4 AS citations, n_chars % 4 // 2 AS correct_citations, n_chars % 2 = 0 AS pages_match, n_chars % 5 > 0 AS likely FROM l)"""


@query(f"WITH {_LABELLED} SELECT lang AS category, count(*) AS questions, count(*) FILTER (WHERE CASE WHEN good THEN exact ELSE refusal_correct END) AS correct, count(*) FILTER (WHERE CASE WHEN good THEN exact ELSE refusal_correct END) / count(*)::DOUBLE AS accuracy FROM det GROUP BY lang")
def category_metrics(spark, sf_dir):
    return metrics.categories(_labelled(spark, sf_dir))


@query(f"""WITH {_LABELLED} SELECT count(*) FILTER (WHERE good) AS questions, count(*) FILTER (WHERE good AND likely) / count(*) FILTER (WHERE good)::DOUBLE AS answer_rate, count(*) FILTER (WHERE good AND exact) / count(*) FILTER (WHERE good)::DOUBLE AS exact_answer_accuracy,
 count(*) FILTER (WHERE good AND gold_found) / count(*) FILTER (WHERE good)::DOUBLE AS all_gold_evidence_recall, sum(correct_citations) FILTER (WHERE good) / sum(citations) FILTER (WHERE good)::DOUBLE AS citation_chunk_precision,
 count(*) FILTER (WHERE good AND pages_match) / count(*) FILTER (WHERE good)::DOUBLE AS citation_page_set_accuracy, count(*) FILTER (WHERE NOT good) AS no_answer_questions, count(*) FILTER (WHERE NOT good AND likely) / count(*) FILTER (WHERE NOT good)::DOUBLE AS no_answer_refusal_accuracy FROM det""")
def evaluate_predictions(spark, sf_dir):
    """Some questions of either kind are decided otherwise than their label says."""
    rows, answerable = _labelled(spark, sf_dir), F.col("group") == "answerable_dev"
    rows = rows.withColumn("status", F.when(answerable == F.col("likely"), "answered").otherwise("refused"))
    return metrics.predictions(rows.where(answerable), rows.where(~answerable))


@query(f"""WITH {_LABELLED}, d AS (SELECT *, CASE WHEN good THEN 'answered' ELSE 'refused' END AS status FROM det),
parts AS (SELECT 'status' AS kind, status AS value, exact FROM d UNION ALL SELECT 'refusal', source, exact FROM d WHERE status = 'refused' UNION ALL SELECT 'fact', lang, exact FROM d
 UNION ALL SELECT 'test_only_fact', lang, exact FROM d WHERE lang <> 'en' UNION ALL SELECT 'retrieval_miss', CAST(query_id AS VARCHAR), exact FROM d WHERE NOT gold_found)
SELECT kind, value, count(*) AS n, count(*) FILTER (WHERE exact) AS correct FROM parts GROUP BY ALL""")
def failure_analysis(spark, sf_dir):
    return metrics.failures(_labelled(spark, sf_dir).where("fact_key is not null"), spark.createDataFrame([("en",)], "fact_key string"))


def _replayed(spark, sf_dir):
    """The adaptive run's questions and what they ended with, asked again under every profile; tokens are words."""
    _, run = _looped(spark, sf_dir)
    adaptive = F.col("policy") == answering.ADAPTIVE
    items = run.answers.where(adaptive).select("query_id", "query", F.col("round_index").alias("rounds"), "status", "answer")
    return loop.token_replay(items, run.evidence.where(adaptive).drop("policy"), counters.Words())


@query(f"""WITH {_LOOP}, r AS (SELECT * FROM runs WHERE policy = 'adaptive_budget_aware'),
p(profile) AS (VALUES ('baseline'), ('routing'), ('prompt'))
SELECT profile, query_id, CASE WHEN profile = 'routing' AND rounds = 1 THEN 'small' ELSE 'large' END AS model, CAST(rounds AS INTEGER) AS rounds FROM r, p""")
def token_replay_models(spark, sf_dir):
    """Which model each profile without packed contexts asks: all the large one, but routing for questions of one round."""
    _, run = _looped(spark, sf_dir)
    rounds = run.answers.where(F.col("policy") == answering.ADAPTIVE).select("query_id", F.col("round_index").alias("rounds"))
    return _replayed(spark, sf_dir).where("profile in ('baseline', 'routing', 'prompt')").join(rounds, "query_id").select("profile", "query_id", "model", "rounds")


@query()
def token_replay(spark, sf_dir):
    """Tokens and normalized cost of all five profiles."""
    return loop.profiles(_replayed(spark, sf_dir), {"small": 0.25, "large": 1.0}, 1.0, 1.0)


@query(f"""WITH {_DENSE}, a AS ({_top("dn")}), b AS ({_top("dn", "label % 2 = query_label % 2")}), rel AS (SELECT query_id, chunk_id FROM dn WHERE label = query_label)
SELECT r.query_id, min(a.rank) AS "before", min(b.rank) AS "after", count(*) FILTER (WHERE b.rank IS NULL) AS missed FROM rel r LEFT JOIN a USING (query_id, chunk_id) LEFT JOIN b USING (query_id, chunk_id) GROUP BY r.query_id""")
def before_after(spark, sf_dir):
    _, gold = _relevance(spark, sf_dir)
    return metrics.first_ranks(None, gold, _dense(spark, sf_dir), _dense(spark, sf_dir, True))


@query("""WITH s AS (SELECT event_type, user_id, event_id, row_number() OVER (PARTITION BY user_id ORDER BY event_id) AS n FROM events),
l AS (SELECT user_id, max(n) AS last FROM s GROUP BY user_id)
SELECT CAST(user_id AS VARCHAR) AS query_id, event_type AS chunk_id, CAST(max(n) AS DOUBLE) AS score, CAST(1 AS INTEGER) AS rank FROM s JOIN l USING (user_id) WHERE n = last GROUP BY ALL""")
def reconstruct_results(spark, sf_dir):
    order = F.row_number().over(Window.partitionBy("user_id").orderBy("event_id"))
    steps = table(spark, sf_dir, "events").select(F.col("user_id").cast("string").alias("query_id"), order.alias("round_index"), F.array("event_type").alias("evidence_chunk_ids"), F.array(order.cast("double")).alias("evidence_scores"))
    known = table(spark, sf_dir, "events").select(F.col("event_type").alias("chunk_id")).distinct()
    whole = known.select("chunk_id", F.lit("d").alias("document_id"), F.lit("c").alias("company"), F.lit(2024).alias("year"), F.lit(1).alias("page"), F.lit("s").alias("section"), F.lit("t").alias("text"))
    return loop.reconstruct(steps, whole).select("query_id", "chunk_id", "score", "rank")


@query(f"""WITH {_CORPUS} SELECT company || y || '年营业收入是多少？' AS query, 'single' AS question_type, format('{{:,}}', v) || '千元' AS answer FROM corp
UNION ALL SELECT company || y || '年和' || (y + 1) || '年的营业收入分别是多少？', 'cross_year', y || '年' || format('{{:,}}', v) || '千元；' || (y + 1) || '年' || format('{{:,}}', w) || '千元' FROM pair""")
def build_questions(spark, sf_dir):
    facts_ = _figures(spark, sf_dir).select("company", "y", F.concat(_plain("v"), F.lit("千元")).alias("answer"), F.concat(F.lit("r"), F.col("k").cast("string")).alias("chunk_id"), F.lit(1).alias("page"), F.lit("revenue").alias("fact_key")).withColumnRenamed("y", "year")
    templates = spark.createDataFrame([("revenue", "{company}{year}年营业收入是多少？", "single")], "fact_key string, template string, question_type string")
    labels = spark.createDataFrame([("revenue", "营业收入")], "fact_key string, label string")
    return datasets.single_facts(facts_, templates).unionByName(datasets.cross_years(facts_, labels)).select("query", "question_type", "answer")


@query(f"""WITH {_CORPUS} SELECT 'a' || k || '-' || y AS query_id, 'answer token ' || format('{{:,}}', v) || ' absent from evidence' AS issue FROM corp WHERE k % 3 = 0
UNION ALL SELECT 'a' || k || '-' || y, 'source pages do not match chunks' FROM corp WHERE k % 3 IN (0, 1) UNION ALL SELECT 'c' || k, 'no-answer row has evidence' FROM (SELECT DISTINCT k FROM corp) UNION ALL SELECT 'a' || k || '-' || y, 'missing chunk r' || k || '-' || y || ':0009' FROM corp WHERE k % 3 = 1""")
def audit_questions(spark, sf_dir):
    reports = _reports(spark, sf_dir)
    rows = _asked_of_reports(spark, sf_dir).where("query_id like 'a%' or query_id like 'c%'").join(_figures(spark, sf_dir).select("k", "y", "v"), ["k", "y"], "left")
    of = F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("-"), F.col("y").cast("string"))
    third = F.col("k") % 3  # 0: the quarter's passage; 1: a passage that is not there, too; 2: the right one
    ids = F.when(third == 0, F.array(F.concat(of, F.lit(":0001")))).when(third == 1, F.array(F.concat(of, F.lit(":0000")), F.concat(of, F.lit(":0009")))).otherwise(F.array(F.concat(of, F.lit(":0000"))))
    none = F.col("query_id").startswith("c")
    pages = F.when(third == 1, F.array(F.lit(99))).otherwise(F.array((F.col("k") + 10).cast("int")))
    rows = rows.select("query_id", "query", none.alias("no_answer"), ids.alias("relevant_chunk_ids"), F.when(none, "refuse").alias("expected_action"), F.when(~none, F.concat(_plain("v"), F.lit("千元"))).alias("answer"), pages.alias("source_pages"))
    return datasets.audit_questions(rows, reports)


@query(f"""WITH {_CORPUS} SELECT query_id, 'query is not inside corpus scope' AS issue FROM asked WHERE starts_with(query_id, 'c') UNION ALL SELECT query_id, 'no evidence constraint inferred' FROM asked WHERE starts_with(query_id, 'c')""")
def audit_hard_no_answers(spark, sf_dir):
    rows = _routed(spark, sf_dir).where("query_id like 'c%' or query_id like 'e%'")
    rows = rows.select("*", F.col("companies")[0].alias("company"), F.lit("refuse").alias("expected_action"), F.array().cast("array<string>").alias("relevant_chunk_ids"))
    return datasets.audit_hard_no_answers(rows, _reports(spark, sf_dir))


@query(f"""WITH {_CORPUS} SELECT 'a' || k || '-' || y AS query_id, 'r' || k || '-' || x AS negative FROM corp, (SELECT DISTINCT k AS k2, y AS x, v AS v2 FROM corp) n WHERE k = k2 AND y <> x AND v <> v2""")
def leak_free_negatives(spark, sf_dir):
    asked_ = _asked_of_reports(spark, sf_dir).where("query_id like 'a%'").join(_figures(spark, sf_dir).select("k", "y", "v"), ["k", "y"]).withColumn("answer", F.concat(_plain("v"), F.lit("千元")))
    reports = _reports(spark, sf_dir).where("chunk_id like '%:0000'")
    pairs = asked_.select("query_id", "k").join(reports.select("chunk_id", "k"), "k").select("query_id", "chunk_id")
    return datasets.drop_answers(pairs, asked_, reports).select("query_id", F.substring_index("chunk_id", ":", 1).alias("negative"))


@query(f"""WITH {_CORPUS}, p(profile, model) AS (VALUES ('baseline', 'large'), ('routed', 'routed')),
t AS (SELECT profile, query_id, answer, CASE WHEN profile = 'baseline' OR starts_with(query_id, 'b') THEN 'large' ELSE 'small' END AS model, len(query) AS n FROM asked, p)
SELECT profile, count(*) AS tasks, count(*) FILTER (WHERE model = 'small') AS small, CAST(sum(n) AS BIGINT) AS input_tokens, round(sum(n * CASE WHEN model = 'small' THEN 0.25::DOUBLE ELSE 1.0 END), 6) AS normalized FROM t GROUP BY profile""")
def replay_profiles(spark, sf_dir):
    rows = _asked_of_reports(spark, sf_dir)
    parts = [rows.withColumn("profile", F.lit(name)).withColumn("model", ledger.choose_model(F.col("query"), F.lit(1), F.lit(0), policy)["model"]) for name, policy in (("baseline", "always_large"), ("routed", "adaptive"))]
    tasks = parts[0].unionByName(parts[1]).withColumns({"input_tokens": F.length("query"), "output_tokens": F.lit(0)})
    out = loop.profiles(tasks, {"small": 0.25, "large": 1.0}, 1.0, 1.0)
    return out.select("profile", "tasks", "small", "input_tokens", F.round("normalized", 6).alias("normalized"))


#: What the set's questions are made of: category, fact and text.
_TEMPLATES = (
    ("single_year_fact", "revenue", "{c}{y}年营业收入是多少？"), ("single_year_fact", "technical_employees", "{c}{y}年技术人员有多少？"), ("cross_year_comparison", "revenue", "{c}{y}年和{z}年的营业收入分别是多少？"),
    ("calculation", "revenue", "{c}{z}年营业收入较{y}年变化了多少？"), ("annual_quarter_confusion", "revenue", "{c}{y}年全年营业收入是多少（不要使用分季度数据）？"), ("multi_evidence", "technical_employees", "{c}{y}年和{z}年的技术人员分别是多少？"),
    ("no_answer", None, "{c}{y}年北美营业收入是多少？"), ("no_answer", None, "{c}{y}年女性技术人员有多少人？"), ("no_answer", None, "{c}{y}年净利润是多少？"),
)


def _holdout(spark, sf_dir):
    """A frozen set over the nations of an odd number; those of an even one are what earlier sets have seen."""
    reports = _reports(spark, sf_dir)
    said = F.explode(F.array(F.struct(F.lit("revenue").alias("fact_key"), F.col("v").alias("n"), F.lit("千元").alias("unit")), F.struct(F.lit("technical_employees").alias("fact_key"), F.col("staff").alias("n"), F.lit("人").alias("unit"))))
    document = F.concat(F.lit("r"), F.col("k").cast("string"), F.lit("-"), F.col("y").cast("string"))
    rows = _figures(spark, sf_dir).withColumn("s", said).select("company", F.col("y").alias("year"), "s.fact_key", F.concat(_plain("s.n"), "s.unit").alias("answer"), F.col("s.n").cast("decimal(28,4)").alias("value"), "s.unit", F.concat(document, F.lit(":0000")).alias("chunk_id"), document.alias("document_id"), (F.col("k") + 10).cast("int").alias("page"))
    seen = reports.where("k % 2 = 0")
    return holdouts.build(rows, reports, spark.createDataFrame(list(_TEMPLATES), "category string, fact_key string, template string"), seen), reports.where("k % 2 = 1"), seen


_DRAWN = f"""{_CORPUS}, quotas(category, place, quota) AS (VALUES {", ".join(f"('{c}', {i}, {n})" for i, (c, n) in enumerate(holdouts.QUOTAS.items()))}),
one AS (SELECT a.*, b.v AS w, b.staff AS staff2, format('{{:,}}', a.v) || '千元' AS x, format('{{:,}}', b.v) || '千元' AS z, format('{{:,}}', a.staff) || '人' AS s, format('{{:,}}', b.staff) || '人' AS t FROM corp a LEFT JOIN corp b ON a.k = b.k AND b.y = a.y + 1 WHERE a.k % 2 = 1),
made AS (
  SELECT 'single_year_fact' AS category, company || y || '年营业收入是多少？' AS query, x AS answer FROM one
  UNION ALL SELECT 'single_year_fact', company || y || '年技术人员有多少？', s FROM one
  UNION ALL SELECT 'cross_year_comparison', company || y || '年和' || (y + 1) || '年的营业收入分别是多少？', y || '年' || x || '；' || (y + 1) || '年' || z FROM one WHERE w IS NOT NULL
  UNION ALL SELECT 'calculation', company || (y + 1) || '年营业收入较' || y || '年变化了多少？', y || '年' || x || '；' || (y + 1) || '年' || z || '；' || (y + 1) || '年-' || y || '年：' || z || '-' || x || '=' || format('{{:,}}', w - v) || '千元，变化率='
    || replace(format('{{:,.2f}}', round_even((w - v) / CAST(abs(v) AS DOUBLE) * 100, 2)), '-0.', '0.') || '%' FROM one WHERE w IS NOT NULL
  UNION ALL SELECT 'annual_quarter_confusion', company || y || '年全年营业收入是多少（不要使用分季度数据）？', x FROM one
  UNION ALL SELECT 'multi_evidence', company || y || '年和' || (y + 1) || '年的技术人员分别是多少？', y || '年' || s || '；' || (y + 1) || '年' || t FROM one WHERE w IS NOT NULL
  UNION ALL SELECT 'no_answer', company || y || '年北美营业收入是多少？', NULL FROM one
  UNION ALL SELECT 'no_answer', company || y || '年女性技术人员有多少人？', NULL FROM one),
drawn AS (SELECT *, row_number() OVER (PARTITION BY category ORDER BY md5('42:' || category || ':' || query)) AS n FROM made)"""


@query(f"""WITH {_DRAWN} SELECT 'holdout-' || lpad(CAST(row_number() OVER (ORDER BY place, n) AS VARCHAR), 3, '0') AS query_id, category, query, answer FROM drawn JOIN quotas USING (category) WHERE n <= quota""")
def holdout_set(spark, sf_dir):
    return _holdout(spark, sf_dir)[0].select("query_id", "category", "query", "answer")


@query("SELECT NULL::VARCHAR AS query_id, NULL::VARCHAR AS issue WHERE false")
def holdout_audit(spark, sf_dir):
    """No row: nothing is wrong with the set that holdout_set draws."""
    rows, corpus, seen = _holdout(spark, sf_dir)
    return datasets.audit_holdout(rows.withColumn("answerable", F.col("expected_action") == "answer"), corpus, seen, holdouts.QUOTAS)
