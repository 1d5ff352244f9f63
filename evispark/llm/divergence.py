"""Source divergence audit: distances between smoothed term distributions by inclusion-exclusion over what each source holds."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.llm import tokens
from evispark.llm.common import saved

LEAST_DOCS, TOP, SMOOTH = 10, 10, 2
#: Terms are of A-Z, a-z and whatever isn't ASCII.
KINDS = tokens.kinds(bytes(c for c in range(128) if not chr(c).isalpha()))


def postings(docs: DataFrame) -> DataFrame:
    """(lang, source, term, n, docs): a group's occurrences of a term and its documents that hold it; null counts as ''.

    Tasks add up a shard of texts at a time, so that a term of every document is a row a shard and group when shuffled.
    """

    def run(batches):
        for shard in tokens.shards(batches):
            found = tokens.coded(shard["text"], KINDS)
            names = max(1, len(found.words))
            lang, source = (shard[c].combine_chunks().dictionary_encode() for c in ("lang", "source"))
            group_of = lang.indices.to_numpy().astype(np.int64) * max(1, len(source.dictionary)) + source.indices.to_numpy()
            groups, group = np.unique(group_of, return_inverse=True)
            once, n = np.unique(found.doc * names + found.codes, return_counts=True)  # each term of each document
            doc, code = np.divmod(once, names)
            known, at, in_docs = np.unique(group[doc] * names + code, return_inverse=True, return_counts=True)
            n = np.bincount(at, n, len(known)).astype(np.int64) if len(known) else np.zeros(0, np.int64)
            own, code = np.divmod(known, names)
            which, of = np.divmod(groups[own] if len(known) else np.zeros(0, np.int64), max(1, len(source.dictionary)))
            columns = [lang.dictionary.take(pa.array(which)), source.dictionary.take(pa.array(of)), found.words.take(pa.array(code)).cast(pa.binary()), pa.array(n), pa.array(in_docs)]
            yield pa.record_batch(columns, ["lang", "source", "term", "n", "docs"])

    read = docs.select(*(F.coalesce(c, F.lit("")).alias(c) for c in ("lang", "source", "text")))
    rows = read.mapInArrow(run, "lang string, source string, term binary, n long, docs long")
    return rows.groupBy("lang", "source", "term").agg(F.sum("n").alias("n"), F.sum("docs").alias("docs")).withColumn("term", F.col("term").cast("string"))


def probability(n: Column | str, total: str, kept: str) -> Column:
    """1 + floor(1e9 * (n + 2) / (total + 2 * kept)), exact: products pass 64 bits."""
    wide = lambda c: (F.col(c) if isinstance(c, str) else c).cast("decimal(19, 0)")
    above = (wide(n) + SMOOTH) * F.lit(1_000_000_000).cast("decimal(10, 0)")
    return F.when(wide(total) + wide(kept) * SMOOTH > 0, F.call_function("div", above, wide(total) + wide(kept) * SMOOTH) + 1)


def distance(p: str, q: str) -> Column:
    """floor((p - q)^2 / (p + q)): p and q are at most 1e9 + 1, so the square is below 2^63."""
    return F.expr(f"(({p}) - ({q})) * (({p}) - ({q})) div (({p}) + ({q}))")


def audit(docs: DataFrame, least_docs: int = LEAST_DOCS, top: int = TOP) -> DataFrame:
    """lang, source, part, item, value, rank, from columns lang, source and text of docs.

    Part `pair`: how far a source's distribution over its language's kept terms is from each other source's. Part
    `term`: the `top` terms that a source has more of than its language. A term is kept if `least_docs` documents of the
    language hold it; all arithmetic is exact.

    A sum over all kept terms has four kinds of terms: those that neither source holds cost a constant, those that one
    holds cost what its count does, whichever term it is, so the group's histogram of counts prices them, and those that
    both hold are met in their postings, where the two one-sided prices are taken back. So work follows what sources
    hold, not sources times vocabulary. Each pair is added up once and told both ways.

    Null and empty texts, langs and sources are '' and form groups that may hold no term; a language without a kept term
    has distances of 0; repeated rows count each; ties go by item; no documents give no rows. Other columns aren't read.
    """
    held = saved(postings(docs), "postings")
    groups = saved(docs.select(F.coalesce("lang", F.lit("")).alias("lang"), F.coalesce("source", F.lit("")).alias("source")).distinct(), "groups")
    of_lang = held.groupBy("lang", "term").agg(F.sum("n").alias("in_lang"), F.sum("docs").alias("docs")).where(F.col("docs") >= least_docs)
    of_lang = saved(of_lang.drop("docs"), "kept")
    sizes = of_lang.groupBy("lang").agg(F.sum("in_lang").alias("lang_total"), F.count("*").alias("kept"))
    kept = saved(held.join(of_lang, ["lang", "term"]).select("lang", "source", "term", "n", "in_lang"), "kept-postings")
    totals = groups.join(kept.groupBy("lang", "source").agg(F.sum("n").alias("total")), ["lang", "source"], "left").join(sizes, "lang", "left").na.fill(0, ["total", "lang_total", "kept"])
    totals = saved(totals.withColumn("none", F.when(F.col("kept") > 0, probability(F.lit(0), "total", "kept"))), "totals")
    priced = kept.join(totals, ["lang", "source"]).withColumn("p", probability("n", "total", "kept")).select("lang", "source", "term", "n", "in_lang", "p", "none", "lang_total", "kept")
    priced = saved(priced, "priced")

    side = lambda s, *cols: [F.col("lang"), *(F.col(c).alias(f"{c}_{s}") for c in ("source", *cols))]
    pairs = totals.select(*side("a", "none"), "kept").join(totals.select(*side("b", "none")), "lang").where("source_a <> source_b")
    histogram = priced.groupBy("lang", "source", "p").agg(F.count("*").alias("terms"))
    one_sided = histogram.select(*side("a", "p", "terms")).join(pairs, ["lang", "source_a"])
    one_sided = one_sided.select("lang", "source_a", "source_b", (F.col("terms_a") * (distance("p_a", "none_b") - distance("none_a", "none_b"))).alias("value"))
    both = priced.select("term", *side("a", "p", "none")).join(priced.select("term", *side("b", "p", "none")), ["lang", "term"]).where("source_a < source_b")
    both = both.select("lang", "source_a", "source_b", (distance("p_a", "p_b") - distance("p_a", "none_b") - distance("none_a", "p_b") + distance("none_a", "none_b")).alias("value"))
    neither = pairs.where("source_a < source_b").select("lang", "source_a", "source_b", F.coalesce(F.col("kept") * distance("none_a", "none_b"), F.lit(0)).alias("value"))
    parts = [x.groupBy("lang", F.least("source_a", "source_b").alias("x"), F.greatest("source_a", "source_b").alias("y")).agg(F.sum("value").alias("value")) for x in (one_sided, both, neither)]
    sums = parts[0].union(parts[1]).union(parts[2]).groupBy("lang", "x", "y").agg(F.sum("value").alias("value"))
    told = F.explode(F.array(F.struct(F.col("x").alias("source"), F.col("y").alias("item")), F.struct(F.col("y").alias("source"), F.col("x").alias("item")))).alias("t")
    pair = sums.select("lang", told, "value").select("lang", "t.source", F.lit("pair").alias("part"), "t.item", "value")

    lang_p = probability("in_lang", "lang_total", "kept")
    more = priced.withColumn("q", lang_p).where("p > q").select("lang", "source", F.lit("term").alias("part"), F.col("term").alias("item"), distance("p", "q").alias("value"))
    order = W.partitionBy("lang", "source").orderBy(F.col("value").desc(), "item")
    term = more.withColumn("rank", F.row_number().over(order)).where(F.col("rank") <= top)
    return pair.withColumn("rank", F.row_number().over(order)).unionByName(term)


_P = "(1 + (1000000000::HUGEINT * ({n} + 2)) // ({total} + 2 * {kept}))"
_F = "(({p} - {q}) * ({p} - {q})) // ({p} + {q})"
DIVERGENCE_SQL = rf"""
WITH d AS (SELECT row_number() OVER () AS row, coalesce(lang, '') AS lang, coalesce(source, '') AS source, coalesce(text, '') AS text FROM documents),
t AS (SELECT row, lang, source, unnest(regexp_extract_all(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[^\x00-\x40\x5B-\x60\x7B-\x7F]+')) AS term FROM d),
kept AS (SELECT lang, term, count(*) AS n FROM t GROUP BY lang, term HAVING count(DISTINCT row) >= 10),
langs AS (SELECT lang, count(*) AS v, sum(n) AS n FROM kept GROUP BY lang),
groups AS (SELECT DISTINCT lang, source FROM d),
counted AS (SELECT lang, source, term, count(*) AS n FROM t JOIN kept USING (lang, term) GROUP BY lang, source, term),
totals AS (SELECT lang, source, sum(n) AS n FROM counted GROUP BY lang, source),
dense AS (
  SELECT g.lang, g.source, k.term, coalesce(c.n, 0) AS n, {_P.format(n="coalesce(c.n, 0)", total="coalesce(s.n, 0)", kept="l.v")} AS p, {_P.format(n="k.n", total="l.n", kept="l.v")} AS q
  FROM groups g JOIN kept k USING (lang) JOIN langs l USING (lang) LEFT JOIN totals s USING (lang, source)
  LEFT JOIN counted c ON c.lang = g.lang AND c.source = g.source AND c.term = k.term),
pair AS (
  SELECT a.lang, a.source, 'pair' AS part, b.source AS item, coalesce(x.value, 0) AS value FROM groups a JOIN groups b ON a.lang = b.lang AND a.source <> b.source
  LEFT JOIN (SELECT a.lang, a.source AS one, b.source AS other, sum({_F.format(p="a.p", q="b.p")}) AS value FROM dense a JOIN dense b USING (lang, term) GROUP BY ALL) x ON x.lang = a.lang AND x.one = a.source AND x.other = b.source),
term AS (SELECT lang, source, 'term' AS part, term AS item, {_F.format(p="p", q="q")} AS value FROM dense WHERE n > 0 AND p > q),
ranked AS (SELECT *, row_number() OVER (PARTITION BY lang, source, part ORDER BY value DESC, encode(item)) AS rank FROM (FROM pair UNION ALL FROM term))
SELECT lang, source, part, item, value::BIGINT AS value, rank::INTEGER AS rank FROM ranked WHERE part = 'pair' OR rank <= 10
"""
