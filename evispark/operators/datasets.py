"""Question sets: built from facts by templates, and audited against the corpus. Audits return (query_id, issue), no row where all is well."""

from __future__ import annotations

import uuid
from collections.abc import Sequence

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions.facts import constraints_of, entails, extract, fact_of
from evispark.functions.text import squeeze
from evispark.operators.training import drop_adjacent
from evispark.sources import shared

NUMBER = r"-?\d[\d,]*(?:\.\d+)?"


def single_facts(facts: DataFrame, templates: DataFrame) -> DataFrame:
    """A question for each fact (company, year, fact_key, answer, chunk_id, page) by its template (fact_key, template, question_type)."""
    text = F.replace(F.replace("template", F.lit("{company}"), F.col("company")), F.lit("{year}"), F.col("year").cast("string"))
    rows = facts.join(templates, "fact_key")
    return rows.select(
        text.alias("query"), F.array("chunk_id").alias("relevant_chunk_ids"), "question_type", "fact_key", "company", F.array("year").alias("years"), "answer", F.array("page").alias("source_pages"),
    )


def cross_years(facts: DataFrame, labels: DataFrame) -> DataFrame:
    """A question for each company, fact (fact_key, label) and two years one after the other: both values, by a self-join."""
    last = facts.select("company", "fact_key", (F.col("year") - 1).alias("year"), F.struct("year", "answer", "chunk_id", "page").alias("last"))
    rows = facts.join(last, ["company", "fact_key", "year"]).join(labels, "fact_key")
    query = F.concat("company", F.col("year").cast("string"), F.lit("年和"), F.col("last.year").cast("string"), F.lit("年的"), "label", F.lit("分别是多少？"))
    answer = F.concat(F.col("year").cast("string"), F.lit("年"), "answer", F.lit("；"), F.col("last.year").cast("string"), F.lit("年"), F.col("last.answer"))
    return rows.select(
        query.alias("query"), F.array("chunk_id", "last.chunk_id").alias("relevant_chunk_ids"), F.lit("cross_year").alias("question_type"), F.concat(F.lit("cross_year_"), "fact_key").alias("fact_key"),
        "company", F.array("year", "last.year").alias("years"), answer.alias("answer"), F.array("page", "last.page").alias("source_pages"),
    )


def unanswerable(companies: DataFrame, years: Sequence[int], endings: Sequence[tuple[str, str]], reason: str) -> DataFrame:
    """Questions to refuse: each company (column company) with each year and each (fact_key, ending of the question)."""
    kinds = F.explode(F.array(*(F.struct(F.lit(k).alias("fact_key"), F.lit(e).alias("ending"), F.lit(y).alias("year")) for y in years for k, e in endings)))
    rows = companies.select("company", kinds.alias("k"))
    return rows.select(
        F.concat("company", F.col("k.year").cast("string"), F.col("k.ending")).alias("query"), F.array().cast("array<string>").alias("relevant_chunk_ids"), F.lit("no_answer").alias("question_type"),
        F.col("k.fact_key").alias("fact_key"), "company", F.array("k.year").alias("years"), F.lit("refuse").alias("expected_action"), F.lit(reason).alias("reason"),
    )


def hard_no_answers(companies: DataFrame, years: Sequence[int]) -> DataFrame:
    """Questions whose qualifier the corpus doesn't disclose: each company (company, segment) and year by region, attribute and segment."""
    kinds = [
        ("regional_rnd_amount", F.lit("年的海外研发投入金额是多少？"), F.array(F.lit("海外"), F.lit("研发投入金额"))),
        ("intersection_workforce", F.lit("年女性技术人员有多少？"), F.array(F.lit("女性"), F.lit("技术人员"))),
        ("segment_net_profit", F.concat(F.lit("年"), "segment", F.lit("的净利润是多少？")), F.array(F.col("segment"), F.lit("净利润"))),
    ]
    made = F.explode(F.array(*(F.struct(F.lit(k).alias("constraint_type"), F.concat("company", F.lit(str(y)), end).alias("query"), q.alias("required_qualifiers"), F.array(F.lit(y)).alias("years")) for y in years for k, end, q in kinds)))
    return companies.select("company", made.alias("m")).select("company", "m.*", F.lit("refuse").alias("expected_action"), F.array().cast("array<string>").alias("relevant_chunk_ids"))


def numbered(rows: DataFrame, prefix: str, *order: str | Column, digits: int = 3) -> DataFrame:
    """rows with query_id: the prefix and a number from 1 in the given order; null comes first, ties in any order.

    Rows are dealt out in ranges of the order, sorted and written; a row's number is its place in its range, and the sizes
    of the ranges before it. So no task holds more than a range, but the one that adds up their sizes.
    """
    spark = rows.sparkSession
    path = shared.path_of(spark, "numbered", uuid.uuid4().hex)
    sorted_ = rows.repartitionByRange(*order).sortWithinPartitions(*order).withColumn("__at", F.monotonically_increasing_id())
    sorted_.write.parquet(path)
    held = spark.read.schema(sorted_.schema).parquet(path).withColumn("__range", F.shiftright("__at", 33))
    sizes = held.groupBy("__range").agg(F.count("*").alias("__n"), F.min("__at").alias("__from"))
    before = sizes.select("__range", "__from", F.coalesce(F.sum("__n").over(W.orderBy("__range").rowsBetween(W.unboundedPreceding, -1)), F.lit(0)).alias("__before"))  # a row a range
    n = (F.col("__before") + F.col("__at") - F.col("__from") + 1).cast("string")
    placed = held.join(F.broadcast(before), "__range").withColumn("query_id", F.concat(F.lit(f"{prefix}-"), F.when(F.length(n) < digits, F.lpad(n, digits, "0")).otherwise(n)))
    return placed.select(*(c for c in rows.columns if c != "query_id"), "query_id")


def merged(parts: Sequence[tuple[str, DataFrame]], prefix: str, *order: str) -> DataFrame:
    """Several question sets under one numbering, each row with its origin; columns that one lacks are null."""
    out = None
    for i, (name, rows) in enumerate(parts):
        tagged = rows.drop("query_id").withColumns({"origin": F.lit(name), "__part": F.lit(i)})
        out = tagged if out is None else out.unionByName(tagged, allowMissingColumns=True)
    return numbered(out, prefix, "__part", *order).drop("__part")


def _repeats(rows: DataFrame, key: Column, issue: str) -> DataFrame:
    """A row for each question that is not the first of its key."""
    return rows.groupBy(key.alias("k")).agg(F.count("*").alias("n"), F.max("query_id").alias("query_id")).where("n > 1").select("query_id", F.lit(issue).alias("issue"))


def audit_questions(rows: DataFrame, chunks: DataFrame) -> DataFrame:
    """Answerable and unanswerable questions (no_answer: whether it is to be refused) against their evidence: chunks there, numbers of the answer in them, their pages, ids and texts unique."""
    say = lambda df, text: df.select("query_id", F.lit(text).alias("issue"))
    empty = F.size("relevant_chunk_ids") == 0
    open_ = rows.where("not no_answer").where(~empty)
    cited = open_.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id")).join(chunks.select("chunk_id", "page", "text", F.lit(True).alias("there")), "chunk_id", "left")
    gone = cited.where("there is null").select("query_id", F.concat(F.lit("missing chunk "), F.col("chunk_id").cast("string")).alias("issue"))
    found = cited.where("there").groupBy("query_id").agg(F.collect_list("page").alias("pages"), F.concat_ws(" ", F.collect_list("text")).alias("joined"))
    both = open_.join(found, "query_id", "left").withColumns({"joined": F.coalesce("joined", F.lit("")), "pages": F.coalesce("pages", F.array().cast("array<int>"))})
    numbers = F.regexp_extract_all(F.coalesce("answer", F.lit("")), F.lit(NUMBER), F.lit(0))
    absent = both.select("query_id", F.explode(F.filter(numbers, lambda x: ~F.col("joined").contains(x))).alias("x")).select("query_id", F.concat(F.lit("answer token "), "x", F.lit(" absent from evidence")).alias("issue"))
    parts = [
        say(rows.where("no_answer").where(~empty), "no-answer row has evidence"), say(rows.where("no_answer").where(~F.col("expected_action").eqNullSafe("refuse")), "expected_action must be refuse"),
        say(rows.where("not no_answer").where(empty), "answerable row has no evidence"), gone, absent,
        say(both.where(~F.array_sort("pages").eqNullSafe(F.array_sort(F.transform("source_pages", lambda p: p.cast("int"))))), "source pages do not match chunks"),
        _repeats(rows, F.col("query_id"), "duplicate query_id"), _repeats(rows, squeeze(F.col("query")), "duplicate normalized query text"),
    ]
    return _union(parts)


def audit_hard_no_answers(routed: DataFrame, chunks: DataFrame) -> DataFrame:
    """Routed questions (company, years, expected_action) that must be in scope, ask for a known fact with a qualifier, and find no passage that entails it."""
    rows = routed.withColumn("fact", fact_of(F.col("query")))
    limits = constraints_of(F.col("query"), F.col("fact"))
    say = lambda df, text: df.select("query_id", F.lit(text).alias("issue"))
    asked = rows.where(F.col("fact").isNotNull() & (F.size(limits) > 0)).select("query_id", "query", "fact", "company", F.explode("years").alias("year"))
    near = asked.join(chunks.select("chunk_id", "company", F.col("year").cast("int").alias("year"), "text"), ["company", "year"]).where(entails(F.col("text"), F.col("query"), F.col("fact")))
    told = near.groupBy("query_id").agg(F.array_join(F.slice(F.array_sort(F.collect_set("chunk_id")), 1, 3), ", ").alias("ids")).select("query_id", F.concat(F.lit("possible entailing evidence: "), "ids").alias("issue"))
    parts = [
        say(rows.where("should_refuse"), "query is not inside corpus scope"), say(rows.where((F.size("relevant_chunk_ids") > 0) | ~F.col("expected_action").eqNullSafe("refuse")), "invalid no-answer labels"),
        say(rows.where("fact is null"), "query does not exercise a supported fact"), say(rows.where(F.col("fact").isNotNull() & (F.size(limits) == 0)), "no evidence constraint inferred"),
        told, _repeats(rows, F.col("query_id"), "duplicate query_id"), _repeats(rows, F.col("query"), "duplicate query"),
    ]
    return _union(parts)


def bare(value: Column) -> Column:
    """Without white space, brackets, commas and semicolons."""
    return F.regexp_replace(value, r"(?U)[\s（）()，,；;]", "")


def contains_answer(passage: Column, query: Column, answer: Column) -> Column:
    """Whether the value that the question's fact has in the passage is in the labelled answer."""
    value = bare(extract(passage, fact_of(query))["value_text"])
    return F.coalesce(bare(answer).contains(value), F.lit(False))


def drop_answers(candidates: DataFrame, queries: DataFrame, chunks: DataFrame) -> DataFrame:
    """candidates (query_id, chunk_id) whose passage doesn't hold the question's labelled answer (query, answer)."""
    rows = candidates.join(queries.select("query_id", "query", "answer"), "query_id").join(chunks.select("chunk_id", "text"), "chunk_id")
    return rows.where(~contains_answer(F.col("text"), F.col("query"), F.col("answer"))).select(*candidates.columns)


def audit_triples(triples: DataFrame, train: DataFrame, validation: DataFrame, chunks: DataFrame, each: int) -> DataFrame:
    """Triples (triple_id, query_id, positive, negative) against their questions (query_id, query, answer, relevant_chunk_ids): ids unique, nothing leaked, negatives safe, as many for each question."""
    say = lambda df, text: df.select("query_id", F.lit(text).alias("issue"))
    gold = train.select("query_id", F.explode("relevant_chunk_ids").alias("chunk_id"))
    pairs = lambda c: triples.select("query_id", F.col(c).alias("chunk_id"))
    ids = chunks.select("chunk_id")
    safe = drop_adjacent(pairs("negative"), gold)
    count = train.select("query_id").join(triples.groupBy("query_id").agg(F.count("*").alias("n")), "query_id", "left")
    parts = [
        _repeats(triples.withColumnRenamed("query_id", "q").withColumnRenamed("triple_id", "query_id"), F.col("query_id"), "duplicate triple ID"), _repeats(train, F.col("query_id"), "duplicate training query IDs"),
        say(train.join(validation.select("query_id"), "query_id", "left_semi"), "training/validation query overlap"),
        say(triples.join(train.select("query_id"), "query_id", "left_anti"), "not a training query"), say(triples.join(validation.select("query_id"), "query_id", "left_semi"), "leaked validation query"),
        say(pairs("positive").join(gold, ["query_id", "chunk_id"], "left_anti"), "invalid positive"), say(pairs("positive").join(ids, "chunk_id", "left_anti"), "positive chunk missing"),
        say(pairs("negative").join(ids, "chunk_id", "left_anti"), "negative chunk missing"), say(pairs("negative").join(gold, ["query_id", "chunk_id"], "left_semi"), "gold used as negative"),
        say(pairs("negative").exceptAll(safe).join(gold, ["query_id", "chunk_id"], "left_anti"), "adjacent chunk used as negative"),
        say(pairs("negative").join(drop_answers(pairs("negative"), train, chunks).distinct(), ["query_id", "chunk_id"], "left_anti").join(ids, "chunk_id", "left_semi").join(train.select("query_id"), "query_id", "left_semi"), "answer-bearing chunk used as negative"),
        say(count.where("n is null"), "some training queries have no triples"), say(count.where(F.col("n") != each), "uneven negatives per query"),
    ]
    return _union(parts).distinct()


#: The heading of a table of quarterly figures (fixed value).
QUARTER_TABLE = "分季度主要财务"


def audit_holdout(rows: DataFrame, chunks: DataFrame, prior: DataFrame, categories: dict[str, int], reach: int = 1) -> DataFrame:
    """A frozen set (query_id, query, category, answerable, companies, years, relevant_chunk_ids, source_pages, document_ids, gold_values, distractor_chunk_ids) against its corpus and a prior one (column company).

    No company in both; as many questions a category as stated; gold passages with the stated document, page, company, year
    and value; distractors within `reach` pages of a quarterly table's heading; unanswerable questions without a
    passage that entails them. Problems of the set as a whole have a null query_id.
    """
    say = lambda df, text: df.select("query_id", F.lit(text).alias("issue"))
    whole = lambda df, text: df.select(F.lit(None).cast("string").alias("query_id"), text.alias("issue"))
    shared = chunks.select("company").intersect(prior.select("company"))
    wanted = rows.sparkSession.createDataFrame(list(categories.items()), "category string, n long")
    counted = rows.groupBy("category").agg(F.count("*").alias("found")).join(wanted, "category", "full_outer").where(~F.col("found").eqNullSafe(F.col("n")))
    open_, none = rows.where("answerable"), rows.where("not answerable").withColumn("fact", fact_of(F.col("query")))
    even = F.size("relevant_chunk_ids") == F.size("source_pages")
    gold = open_.where(even).select("query_id", "companies", "years", F.explode(F.arrays_zip("relevant_chunk_ids", "source_pages", "document_ids", "gold_values")).alias("g")).select("query_id", "companies", "years", F.col("g.relevant_chunk_ids").alias("chunk_id"), F.col("g.source_pages").alias("of_page"), F.col("g.document_ids").alias("of_document"), F.col("g.gold_values").alias("value"))
    cited = gold.join(chunks.select("chunk_id", "document_id", "company", F.col("year").cast("int").alias("year"), "page", "text", F.lit(True).alias("there")), "chunk_id", "left")
    there, number = cited.where("there"), F.regexp_extract(F.coalesce("value", F.lit("")), NUMBER, 0)
    headings = chunks.where(F.col("text").contains(QUARTER_TABLE)).select(F.col("document_id").alias("d"), F.col("page").alias("p"))
    decoys = open_.select("query_id", F.explode("distractor_chunk_ids").alias("chunk_id"))
    placed = decoys.join(chunks.select("chunk_id", "document_id", "page"), "chunk_id")
    far = placed.join(headings, (F.col("document_id") == F.col("d")) & (F.abs(F.col("page") - F.col("p")) <= reach), "left_anti")
    asked = none.where("fact is not null").select("query_id", "query", "fact", F.explode("companies").alias("company"), "years").select("query_id", "query", "fact", "company", F.explode("years").alias("year"))
    entailed = asked.join(chunks.select("company", F.col("year").cast("int").alias("year"), "text"), ["company", "year"]).where(entails(F.col("text"), F.col("query"), F.col("fact")))
    return _union([
        whole(shared, F.concat(F.lit("company in the prior corpus: "), "company")), whole(counted, F.concat(F.lit("unexpected count of category "), "category")),
        _repeats(rows, squeeze(F.col("query")), "duplicate normalized query text"), say(open_.where(~even), "gold chunk/page count mismatch"), say(cited.where("there is null"), "missing gold chunk"),
        say(there.where(~(F.col("document_id").eqNullSafe(F.col("of_document")) & F.col("page").eqNullSafe(F.col("of_page").cast("int")))), "gold metadata/page mismatch"),
        say(there.where(~(F.array_contains("companies", F.col("company")) & F.array_contains(F.transform("years", lambda y: y.cast("int")), F.col("year")))), "gold company/year mismatch"),
        say(there.where((number == "") | ~F.col("text").contains(number)), "value absent from gold chunk"), say(decoys.join(chunks.select("chunk_id"), "chunk_id", "left_anti"), "missing distractor"),
        say(far, "invalid quarterly distractor"), say(none.where("fact is null"), "unsupported no-answer fact"), say(entailed, "constrained evidence unexpectedly found"),
    ]).distinct()


def _union(parts: Sequence[DataFrame]) -> DataFrame:
    out = parts[0].select(F.col("query_id").cast("string").alias("query_id"), "issue")
    for p in parts[1:]:
        out = out.union(p.select(F.col("query_id").cast("string").alias("query_id"), "issue"))
    return out
