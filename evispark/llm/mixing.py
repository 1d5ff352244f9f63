"""Mixing sources to target weights: capped water-filling and seeded whole and fractional repetitions, in DataFrame functions only."""

from __future__ import annotations

from pyspark.sql import DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.llm.common import WORD, let, prefix_of, quoted, saved, with_text, words

WEIGHTS = (5, 2, 1)
MAX_EPOCHS = 3
SEED = 42


def targets(sources: DataFrame, total_share: float = 1.0, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS) -> DataFrame:
    """source, source_size, target for a table (source, source_size) of one row a source, null among them.

    Sources by code point, null last, weigh as `weights` repeats. Each gets its weight's share of
    total_share * the sum of sizes, at most max_epochs times its size; what is cut off goes to the others by weight,
    again and again until none is above. That end is found at once: in the order of size / weight the clamped sources
    come first, and the level (words for each unit of weight) of the rest is what is left over their weights. The table
    holds one row a source, so its two windows over all of it are small next to the documents.
    """
    ranks = W.orderBy(F.col("source").isNull(), "source")
    up = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.unboundedPreceding, -1)
    rest = W.orderBy(F.col("source_size") / F.col("weight"), "rank").rowsBetween(W.currentRow, W.unboundedFollowing)
    ranked = sources.withColumn("rank", F.row_number().over(ranks) - 1).withColumn("weight", F.element_at(F.array(*map(F.lit, weights)), (F.col("rank") % len(weights) + 1).cast("int")))
    filled = ranked.select(
        "source", "source_size", "weight",
        (F.sum("source_size").over(W.partitionBy(F.lit(0))) * total_share - F.coalesce(F.sum("source_size").over(up), F.lit(0)) * max_epochs).alias("left"),
        F.sum("weight").over(rest).alias("weights_left"),
    )
    # a source's own level if all before it are clamped; that of the first that is not clamped holds for all after it, whose own are lower
    level = F.col("left") / F.col("weights_left")
    levels = filled.withColumn("level", level).withColumn("clamped", F.col("source_size") * max_epochs <= F.col("level") * F.col("weight"))
    levels = levels.withColumn("common", F.max(F.when(~F.col("clamped"), F.col("level"))).over(W.partitionBy(F.lit(0))))
    return levels.select("source", "source_size", F.when(F.col("clamped"), F.col("source_size") * F.lit(float(max_epochs))).otherwise(F.col("common") * F.col("weight")).alias("target"))


def mix(docs: DataFrame, weights=WEIGHTS, max_epochs: int = MAX_EPOCHS, seed: int = SEED, prefix: str = "__") -> DataFrame:
    """The rows of docs with __size, __source_size, __target and __taken: the words that the mix takes of each, repeats counted.

    A source with a target of e times its size has each of its documents floor(e) times whole; the rest of the target
    goes to its documents in the order of a seeded digest of doc_id, each once, the last one in part. So a source's words
    miss its target by less than one, no document exceeds max_epochs times its size, and reruns agree (repeated rows of one
    id may swap their shares). Null and empty texts have size 0 and are never taken; a null source is a source; no
    documents give no rows; texts of any length count whole. The running sums go by 4,096 digest buckets a source, so no
    task holds a source. Other columns stay as they are; `prefix` names the new ones where docs has such names.
    """
    p = prefix_of(docs)
    source = F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit("")))
    digest = F.md5(F.concat(F.lit(f"{seed}:"), F.coalesce(F.col("doc_id").cast("string"), F.lit(""))))
    sized = docs.withColumns({f"{p}size": F.size(words(F.col("text"))).cast("long"), f"{p}source": source, f"{p}digest": digest, f"{p}bucket": F.substring(digest, 1, 3)})
    buckets = saved(sized.groupBy(f"{p}source", f"{p}bucket").agg(F.sum(f"{p}size").alias("words")), "buckets")
    sources = buckets.groupBy(f"{p}source").agg(F.sum("words").alias("source_size")).withColumn("source", F.when(F.col(f"{p}source") != "0", F.expr(f"substring({p}source, 2)")))
    goals = targets(sources.select("source", "source_size"), 1.0, weights, max_epochs)
    goals = goals.select(F.concat(F.when(F.col("source").isNull(), "0").otherwise("1"), F.coalesce("source", F.lit(""))).alias(f"{p}source"), "source_size", "target")
    before = F.coalesce(F.sum("words").over(W.partitionBy(f"{p}source").orderBy(f"{p}bucket").rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    whole = F.when(F.col("source_size") > 0, F.floor(F.col("target") / F.col("source_size"))).otherwise(0)
    extra = F.greatest(F.lit(0), F.floor(F.col("target") - F.col(f"{p}whole") * F.col("source_size")))
    plan = buckets.withColumn(f"{p}before", before).join(goals, f"{p}source").withColumn(f"{p}whole", whole)
    plan = plan.select(f"{p}source", f"{p}bucket", f"{p}before", f"{p}whole", extra.alias(f"{p}extra"), F.col("source_size").alias(f"{p}source_size"), F.col("target").alias(f"{p}target"))
    own = W.partitionBy(f"{p}source", f"{p}bucket").orderBy(f"{p}digest", f"{p}size").rowsBetween(W.unboundedPreceding, -1)
    dealt = sized.join(plan, [f"{p}source", f"{p}bucket"]).withColumn(f"{p}at", F.col(f"{p}before") + F.coalesce(F.sum(f"{p}size").over(own), F.lit(0)))
    taken = F.col(f"{p}whole") * F.col(f"{p}size") + F.least(F.col(f"{p}size"), F.greatest(F.lit(0), F.col(f"{p}extra") - F.col(f"{p}at")))
    return dealt.withColumn(f"{p}taken", taken.cast("long")).select(*map(quoted, docs.columns), *(F.col(f"{p}{c}").alias(f"{prefix}{c}") for c in ("size", "source_size", "target", "taken")))


def repeated(docs: DataFrame, **options) -> DataFrame:
    """docs as the mix takes them: each row once for every whole repetition, and the row taken in part with its first words, joined by a space.

    n_chars, if there is such a column, follows the text. Documents that aren't taken, and those without a word, go.
    """
    own = prefix_of(docs)
    mixed = mix(docs, prefix=own, **options).where(F.col(f"{own}taken") > 0)
    part = (F.col(f"{own}taken") % F.col(f"{own}size")).cast("int")
    copies = F.concat(
        F.array_repeat(F.col("text"), F.floor(F.col(f"{own}taken") / F.col(f"{own}size")).cast("int")),
        F.when(part > 0, F.array(let(words(F.col("text")), lambda w: F.array_join(F.slice(w, 1, part), " ")))).otherwise(F.array().cast("array<string>")),
    )
    return with_text(mixed.withColumn(f"{own}copy", F.explode(copies)), docs, F.col(f"{own}copy"))


#: The same rows in SQL.
MIX_SQL = f"""
WITH sized AS (
  SELECT doc_id, source, len(regexp_extract_all(coalesce(text, ''), '{WORD}')) AS size, md5('{SEED}:' || coalesce(CAST(doc_id AS VARCHAR), '')) AS digest
  FROM documents),
sources AS (
  SELECT source, CAST(sum(size) AS BIGINT) AS source_size, [5, 2, 1][CAST((row_number() OVER (ORDER BY source NULLS LAST) - 1) % 3 AS INTEGER) + 1] AS weight
  FROM sized GROUP BY source),
filled AS (
  SELECT *, CAST(sum(source_size) OVER () AS DOUBLE) - 3 * CAST(coalesce(sum(source_size) OVER below, 0) AS DOUBLE) AS rest, CAST(sum(weight) OVER upward AS DOUBLE) AS weights
  FROM sources
  WINDOW below AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING),
         upward AS (ORDER BY source_size / weight, source NULLS LAST ROWS BETWEEN CURRENT ROW AND UNBOUNDED FOLLOWING)),
levels AS (SELECT *, rest / weights AS level, 3 * source_size <= rest / weights * weight AS clamped FROM filled),
goals AS (
  SELECT source, source_size, CASE WHEN clamped THEN 3.0::DOUBLE * source_size ELSE max(CASE WHEN NOT clamped THEN level END) OVER () * weight END AS target
  FROM levels),
parts AS (
  SELECT *, CASE WHEN source_size > 0 THEN CAST(floor(target / source_size) AS BIGINT) ELSE 0 END AS whole FROM goals),
run AS (
  SELECT s.doc_id, s.size, p.source_size, p.target, p.whole,
         greatest(0, CAST(floor(p.target - p.whole * p.source_size) AS BIGINT)) AS extra,
         CAST(coalesce(sum(s.size) OVER (PARTITION BY s.source ORDER BY s.digest, s.size ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS BIGINT) AS before
  FROM sized s JOIN parts p ON s.source IS NOT DISTINCT FROM p.source)
SELECT doc_id, CAST(size AS BIGINT) AS size, CAST(source_size AS BIGINT) AS source_size, target,
       CAST(whole * size + least(size, greatest(0, extra - before)) AS BIGINT) AS taken
FROM run
"""
