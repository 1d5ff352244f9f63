"""Training and evaluation data: splits, hard negatives, audits."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.functions.text import let, strip
from evispark.operators.metrics import Classes

CHUNK_ID = r"^(.+):(\d+)$"


def stride_split(position: Column, stride: int = 5) -> Column:
    """'validation' for every stride-th row by 1-based position, else 'train'."""
    if stride < 2:
        raise ValueError("the stride must be at least 2")
    return F.when(position % stride == 0, "validation").otherwise("train")


def parts(chunk_id: Column) -> tuple[Column, Column]:
    return F.regexp_extract(chunk_id, CHUNK_ID, 1), F.regexp_extract(chunk_id, CHUNK_ID, 2).cast("int")


def drop_adjacent(candidates: DataFrame, gold: DataFrame, distance: int = 1) -> DataFrame:
    """candidates (query_id, chunk_id) without the gold chunks and their neighbours: an equi-join on question and document, then a band."""
    doc, at = parts(F.col("chunk_id"))
    known = gold.select(F.col("query_id").alias("__q"), parts(F.col("chunk_id"))[0].alias("__doc"), parts(F.col("chunk_id"))[1].alias("__at"))
    rows = candidates.withColumns({"__d": doc, "__i": at})
    close = (F.col("query_id") == F.col("__q")) & (F.col("__d") == F.col("__doc")) & (F.abs(F.col("__i") - F.col("__at")) <= distance)
    return rows.join(known, close, "left_anti").drop("__d", "__i")


def neighbours(candidates: DataFrame, gold: Classes, distance: int = 1) -> DataFrame:
    """(query_id, chunk_id): of the relevant chunks those within `distance` of a candidate of their question, all that drop_adjacent() needs of them."""
    doc, at = parts(F.col("chunk_id"))
    near = candidates.select("query_id", doc.alias("__doc"), F.explode(F.sequence(at - distance, at + distance)).alias("__at")).distinct()
    chunks = gold.chunks.select("chunk_id", doc.alias("__doc"), at.alias("__at"))
    return gold.of(near.join(chunks, ["__doc", "__at"]).select("query_id", "chunk_id"))


def hard_negatives(rankings: list[DataFrame], gold: DataFrame | Classes, quota: int = 24, distance: int = 1) -> DataFrame:
    """(query_id, chunk_id, source, n): the first `quota` candidates of each question, the first ranking that has one names its source."""
    union = None
    for i, r in enumerate(rankings):
        rows = r.select("query_id", "chunk_id", "source", F.lit(i).alias("turn"), "rank")
        union = rows if union is None else union.union(rows)
    first = union.groupBy("query_id", "chunk_id").agg(F.min(F.struct("turn", "rank", "source")).alias("seen"))
    safe = drop_adjacent(first, neighbours(first, gold, distance) if isinstance(gold, Classes) else gold, distance)
    n = F.row_number().over(W.partitionBy("query_id").orderBy("seen.turn", "seen.rank"))
    return safe.select("query_id", "chunk_id", F.col("seen.source").alias("source"), n.alias("n")).where(F.col("n") <= quota)


def triples(negatives: DataFrame, gold: DataFrame) -> DataFrame:
    """(triple_id, query_id, positive, negative): the positives of a question take turns."""
    positives = gold.groupBy("query_id").agg(F.array_sort(F.collect_list("chunk_id")).alias("positives"))
    rows = negatives.join(positives, "query_id")
    positive = F.element_at("positives", ((F.col("n") - 1) % F.size("positives") + 1).cast("int"))
    return rows.select(F.concat("query_id", F.lit("-hn-"), F.when(F.col("n") < 10, F.concat(F.lit("0"), F.col("n").cast("string"))).otherwise(F.col("n").cast("string"))).alias("triple_id"), "query_id", positive.alias("positive"), F.col("chunk_id").alias("negative"))


def repeated_texts(rows: DataFrame, key: str) -> DataFrame:
    """(text, n, first): texts equal but for white space and case that more than one row has."""
    plain = F.lower(strip(F.regexp_replace("text", r"(?U)\s+", " ")))
    return rows.groupBy(F.md5(plain).alias("digest")).agg(F.count("*").alias("n"), F.min(key).alias("first")).where("n > 1")


_BREAKS = r"[ \t\n\x0b\f\r]+"
#: Words of a passage's inside that texts are looked up by.
INSIDE = 5
#: Characters that a passage without an inside is looked up by.
GRAM = 3


def leaks(rows: DataFrame, passages: DataFrame) -> DataFrame:
    """(item_id, documents): for each passage, how many texts hold it.

    A text that holds a passage holds its words but the first and last whole, one after the other. So texts and passages
    meet by the hash of the passage's first INSIDE inner words, or of its first inner word where there are fewer; passages
    of one or two words meet texts by their first three characters. What is exploded is a text's digest and keys; the
    texts themselves are read again for the digests that met, and compared.
    """
    inner = F.slice(F.split("passage", _BREAKS), 2, F.greatest(F.size(F.split("passage", _BREAKS)) - 2, F.lit(0)))
    known = passages.where("passage <> ''").withColumn("__inner", inner).withColumn("__width", F.when(F.size("__inner") >= INSIDE, INSIDE).when(F.size("__inner") > 0, 1).otherwise(-F.least(F.length("passage"), F.lit(GRAM))))
    key = F.when(F.col("__width") > 0, F.xxhash64("__width", F.slice("__inner", 1, F.greatest("__width", F.lit(1))))).otherwise(F.xxhash64("__width", F.left("passage", F.greatest(-F.col("__width"), F.lit(1)))))
    keyed = known.select("item_id", "passage", key.alias("__key"))
    widths = sorted(r[0] for r in known.select("__width").distinct().collect())  # five at most
    none = F.array().cast("array<long>")
    every = lambda parts, w, of: F.when(F.size(parts) >= w, F.transform(F.sequence(F.lit(1), F.size(parts) - w + 1), lambda i: of(F.slice(parts, i, w)))).otherwise(none)
    by_words = [lambda words, w=w: every(words, w, lambda x: F.xxhash64(F.lit(w), x)) for w in widths if w > 0]
    by_characters = [lambda letters, w=w: every(letters, -w, lambda x: F.xxhash64(F.lit(w), F.array_join(x, ""))) for w in widths if w < 0]
    parts = [let(F.split("text", _BREAKS), lambda words: F.concat(*(f(words) for f in by_words)))] if by_words else []
    parts += [let(F.split("text", ""), lambda letters: F.concat(*(f(letters) for f in by_characters)))] if by_characters else []
    if not parts:
        return passages.select("item_id", F.lit(0).cast("long").alias("documents")).distinct()
    texts = rows.where(F.col("text").isNotNull()).select("text", F.sha2("text", 256).alias("__digest"))
    met = texts.select("__digest", F.explode(F.array_distinct(F.concat(*parts))).alias("__key")).join(keyed, "__key").select("__digest", "item_id", "passage").distinct()
    held = texts.join(met, "__digest").where(F.col("text").contains(F.col("passage"))).groupBy("item_id").agg(F.count("*").alias("documents"))
    return passages.select("item_id").distinct().join(held, "item_id", "left").select("item_id", F.coalesce("documents", F.lit(0)).alias("documents"))


def positions(rows: DataFrame, key: str) -> DataFrame:
    """rows with n, their 1-based place in the order of a whole-number key without repeats.

    Keys are counted by blocks of 4,096 and of 16 million: a row's place is the blocks' before its own, and its place in it. No task
    orders more than 4,096 rows or as many blocks.
    """
    block, chapter = F.floor(F.col(key) / 4096).cast("long"), F.floor(F.col(key) / (4096 * 4096)).cast("long")
    counts = rows.groupBy(block.alias("__block"), chapter.alias("__chapter")).agg(F.count("*").alias("__n"))
    before = lambda window: F.coalesce(F.sum("__n").over(window.rowsBetween(W.unboundedPreceding, -1)), F.lit(0))
    chapters = counts.groupBy("__chapter").agg(F.sum("__n").alias("__n")).select("__chapter", before(W.partitionBy(F.lit(0)).orderBy("__chapter")).alias("__start"))
    starts = counts.withColumn("__in", before(W.partitionBy("__chapter").orderBy("__block"))).join(chapters, "__chapter").select("__block", (F.col("__start") + F.col("__in")).alias("__before"))
    placed = rows.withColumn("__block", block).join(starts, "__block").withColumn("n", F.col("__before") + F.row_number().over(W.partitionBy("__block").orderBy(key)))
    return placed.select(*rows.columns, "n")


def manifest(rows: DataFrame, group: str, order: str) -> DataFrame:
    """(group, rows, sha256): a digest of a group's rows, so that any change shows: of its buckets' digests, each of the bucket's sorted row digests.

    A row's bucket is the first four digits of its digest: 65,536 buckets a group, so no row of the result gathers a group's rows.
    """
    digests = rows.select(group, F.sha2(F.concat_ws("\u0001", *(F.coalesce(F.col(c).cast("string"), F.lit("")) for c in (order, "text"))), 256).alias("d"))
    joined = lambda c: F.sha2(F.array_join(F.array_sort(F.collect_list(c)), ""), 256)
    buckets = digests.groupBy(group, F.substring("d", 1, 4).alias("b")).agg(F.count("*").alias("n"), joined("d").alias("d"))
    of = F.sha2(F.array_join(F.transform(F.array_sort(F.collect_list(F.struct("b", "d"))), lambda x: x["d"]), ""), 256)
    return buckets.groupBy(group).agg(F.sum("n").alias("rows"), of.alias("sha256"))


def exact_quota(negatives: DataFrame, queries: DataFrame, quota: int = 24) -> DataFrame:
    """The negatives; a question with fewer than `quota` is an error."""
    counts = queries.select("query_id").join(negatives.groupBy("query_id").agg(F.count("*").alias("__n")), "query_id", "left")
    short = F.coalesce("__n", F.lit(0)) < quota
    told = F.raise_error(F.concat(F.lit("too few negatives for "), F.col("query_id").cast("string"))).cast("boolean")
    return negatives.join(counts.where(F.when(short, told).otherwise(F.lit(True))).select("query_id"), "query_id")


def changed(known: DataFrame, now: DataFrame, key: str) -> DataFrame:
    """The keys whose digests differ, or that only one manifest has."""
    both = known.select(key, F.col("sha256").alias("a")).join(now.select(key, F.col("sha256").alias("b")), key, "full_outer")
    return both.where("not (a <=> b)").select(key)
