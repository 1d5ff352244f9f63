"""Helpers shared by the corpus operators: scratch tables, word expressions, exact range shards."""

from __future__ import annotations

import contextlib
import tempfile
import uuid

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

#: What separates words: the six ASCII white-space characters.
SPACES = " \t\n\x0b\x0c\r"
WORD = r"[^\x20\x09-\x0D]+"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def scratch_dir(spark: SparkSession) -> str:
    """The folder that driver and executors share: spark.checkpoint.dir. Where that is unset, a local session makes one of its own; a cluster must set it."""
    known = spark.conf.get("spark.checkpoint.dir", None) or spark.sparkContext.getCheckpointDir()
    if not known:
        if not spark.sparkContext.master.startswith("local"):
            raise ValueError("spark.checkpoint.dir must name a folder that the driver and the executors share")
        spark.sparkContext.setCheckpointDir(tempfile.mkdtemp(prefix="evispark-"))
        known = spark.sparkContext.getCheckpointDir()
    return known.rstrip("/")


def scratch_path(spark: SparkSession, name: str) -> str:
    """A new path under the shared folder; Hadoop deletes it when the application ends."""
    path = f"{scratch_dir(spark)}/{spark.sparkContext.applicationId}/{name}-{uuid.uuid4().hex}"
    jvm = spark.sparkContext._jvm
    where = jvm.org.apache.hadoop.fs.Path(path)
    where.getFileSystem(spark.sparkContext._jsc.hadoopConfiguration()).deleteOnExit(where)
    return path


def saved(df: DataFrame, name: str) -> DataFrame:
    """Writes df to the shared folder and reads it back: cuts lineage, computes it once, survives lost executors."""
    spark = df.sparkSession
    path = scratch_path(spark, name)
    df.write.parquet(path)
    return spark.read.schema(df.schema).parquet(path)


@contextlib.contextmanager
def shuffles_deleted(spark: SparkSession):
    """Meanwhile what a query has shuffled is deleted as soon as it ends, not whenever the driver's garbage is collected."""
    key = "spark.sql.classic.shuffleDependency.fileCleanup.enabled"
    before = spark.conf.get(key, None)
    spark.conf.set(key, "true")
    try:
        yield
    finally:
        spark.conf.unset(key) if before is None else spark.conf.set(key, before)


def quoted(name: str) -> Column:
    """The column of exactly this name, dots and all."""
    return F.col("`" + name.replace("`", "``") + "`")


def prefix_of(docs: DataFrame) -> str:
    """A prefix that no column of docs begins with, for columns of our own."""
    prefix = "__"
    while any(c.startswith(prefix) for c in docs.columns):
        prefix += "_"
    return prefix


def with_text(rows: DataFrame, docs: DataFrame, text: Column) -> DataFrame:
    """rows with the columns of docs, their text replaced; n_chars, if there is such a column, follows it."""
    size = F.length(text)
    new = {"text": text, "n_chars": size.cast(docs.schema["n_chars"].dataType)} if "n_chars" in docs.columns else {"text": text}
    return rows.select(*(new[c].alias(c) if c in new else quoted(c) for c in docs.columns))


def let(value: Column, body) -> Column:
    """body(value) with value computed once per row: bound as a lambda's variable, which no rule of the optimizer inlines."""
    return F.transform(F.array(value), body)[0]


def words(text: Column) -> Column:
    """The words of a text, repeats included; null gives an empty array."""
    spaced = F.translate(F.coalesce(text, F.lit("")), SPACES, " " * len(SPACES))
    return F.array_remove(F.split(spaced, " "), "")


def text_key(doc_id: Column, text: Column) -> Column:
    """64 bits that tell rows with another id or another text apart."""
    return F.xxhash64(doc_id, F.coalesce(text, F.lit("")))


def hot_join(rows: DataFrame, keyed: DataFrame, key: str, total: int, most: int = 1000) -> DataFrame:
    """rows joined with keyed (one row a key, n: how many of the `total` rows have it) on key; n goes.

    Keys that more than one in `most` rows have, fewer than `most` of them, are broadcast, so that a key which a third of
    all rows share is not dealt to one task; the others are joined by shuffle.
    """
    hot = F.col("n") * most > total
    often = F.broadcast(keyed.where(hot).drop("n"))
    rest = rows.join(F.broadcast(keyed.where(hot).select(key)), key, "left_anti").join(keyed.where(~hot).drop("n"), key)
    return rows.join(often, key).unionByName(rest)


#: Ranges that range_bounds() deals out at most, and the keys a range that it reads for that.
MOST_SHARDS, KEYS_PER_SHARD = 16_384, 25


def range_bounds(keys: DataFrame, key: str, shards: int, rows: int) -> list:
    """Upper-exclusive bounds that deal the non-null keys into about `shards` ranges, MOST_SHARDS at most, of like row counts.

    They come from the keys whose hash falls into a fixed share, about KEYS_PER_SHARD for each range (more for few), so
    the same rows always give the same bounds, unlike bounds from Spark's sampling. About MOST_SHARDS * KEYS_PER_SHARD
    (410,000) keys reach the driver at most, whatever the input; beyond that, ranges grow.
    """
    if shards <= 1 or not rows:
        return []
    shards = min(shards, MOST_SHARDS)
    every = max(1, rows // max(10_000, shards * KEYS_PER_SHARD))
    sample = keys.select(key).where(F.col(key).isNotNull() & (F.pmod(F.xxhash64(key), F.lit(every)) == 0))
    counts = sorted((r[0], r[1]) for r in sample.groupBy(key).count().collect())
    total, seen, bounds = sum(n for _, n in counts), 0, []
    for value, n in counts:
        if seen * shards >= (len(bounds) + 1) * total:
            bounds.append(value)
        seen += n
    return bounds


def shard_of(key: Column, bounds: list) -> Column:
    """How many of the sorted bounds are at most key (null: 0), by binary search inside the JVM."""
    if not bounds:
        return F.lit(0)
    known = F.array(*map(F.lit, bounds))
    start = F.struct(F.lit(0).alias("lo"), F.lit(len(bounds)).alias("hi"))

    def halve(at, known):
        mid = F.floor((at["lo"] + at["hi"]) / 2).cast("int")
        right = F.element_at(known, mid + 1) <= key
        return F.when(at["lo"] >= at["hi"], at).otherwise(
            F.struct(F.when(right, mid + 1).otherwise(at["lo"]).alias("lo"), F.when(right, at["hi"]).otherwise(mid).alias("hi"))
        )

    steps = F.sequence(F.lit(1), F.lit(len(bounds).bit_length()))
    return F.when(key.isNull(), 0).otherwise(F.aggregate(steps, start, lambda at, _: halve(at, known), lambda at: at["lo"]))
