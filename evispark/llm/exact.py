"""Exact dedup: fingerprints counted in quotient filters, those that occur more than once verified byte by byte."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from evispark.llm import quotient
from evispark.llm.common import hot_join, saved

#: Fingerprints of a partition that are held before they become filters, and those of a shard of the key space, on average.
HELD, PER_SHARD = 1 << 22, 1 << 20
LEAST_SHARD_BITS, MOST_SHARD_BITS = 4, 20
#: Repeated fingerprints that are broadcast at most (8 bytes each); more are joined by shuffle.
BROADCAST = 1_000_000


def normal(text: Column) -> Column:
    """A-Z as a-z, nothing else; null is empty."""
    return F.translate(F.coalesce(text, F.lit("")), "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz")


def fingerprint(text: Column, bits: int = 64) -> Column:
    return F.shiftrightunsigned(F.xxhash64(text), 64 - bits)


def filters(fingerprints: DataFrame, rows: int, bits: int = 64) -> DataFrame:
    """(shard, filter): a counting quotient filter of the column fp for each range of the key space.

    Each partition builds filters of what it holds, a range each; those of a range meet in a task, which merges them as
    they come, larger ones less often than small ones. A shard holds about a million distinct fingerprints whatever the
    input, and a fingerprint of a third of all rows is one entry of each partition's filter.
    """
    shard_bits = min(MOST_SHARD_BITS, bits - 1, max(LEAST_SHARD_BITS, (rows // PER_SHARD).bit_length()))
    width = bits - shard_bits
    low = np.uint64((1 << width) - 1)

    def build(batches):
        held, size = [], 0

        def flush():
            fps, n = quotient.distinct(np.concatenate(held))
            shard = (fps >> np.uint64(width)).astype(np.int64)
            cuts = np.flatnonzero(np.r_[True, shard[1:] != shard[:-1]][: len(shard)]).tolist()
            for i, j in zip(cuts, [*cuts[1:], len(shard)], strict=True):
                yield int(shard[i]), quotient.build(fps[i:j] & low, n[i:j], width)

        for b in batches:
            held.append(b.column("fp").to_numpy().view(np.uint64))
            size += len(b)
            if size >= HELD:
                yield from batches_of(flush())
                held, size = [], 0
        if size:
            yield from batches_of(flush())

    def merge(batches):
        at, waiting = None, []
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("filter"), strict=True):
                if shard != at:
                    if waiting:
                        yield from batches_of([(at, quotient.merge(waiting, width))])
                    at, waiting = shard, []
                waiting.append(data.as_py())
                while len(waiting) >= 16 and sum(map(len, waiting[1:])) >= len(waiting[0]):
                    waiting = [quotient.merge(waiting, width)]
        if waiting:
            yield from batches_of([(at, quotient.merge(waiting, width))])

    schema = "shard int, filter binary"
    parts = fingerprints.select("fp").mapInArrow(build, schema)
    return parts.repartition(min(1 << shard_bits, 20_000), "shard").sortWithinPartitions("shard").mapInArrow(merge, schema)


def batches_of(found, limit: int = 32 << 20):
    """Record batches (shard, filter) of about `limit` bytes."""
    shards, data, size = [], [], 0
    for shard, one in found:
        shards.append(shard)
        data.append(one)
        size += len(one)
        if size >= limit:
            yield pa.record_batch([pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["shard", "filter"])
            shards, data, size = [], [], 0
    if shards:
        yield pa.record_batch([pa.array(shards, pa.int32()), pa.array(data, pa.binary())], ["shard", "filter"])


def repeated(merged: DataFrame, rows: int, bits: int = 64) -> DataFrame:
    """(fp, n): the fingerprints that the filters count more than once."""
    shard_bits = min(MOST_SHARD_BITS, bits - 1, max(LEAST_SHARD_BITS, (rows // PER_SHARD).bit_length()))

    def run(batches):
        for b in batches:
            for shard, data in zip(b.column("shard").to_pylist(), b.column("filter"), strict=True):
                fps, n = quotient.entries(data.as_py())
                fps, n = fps[n > 1] | np.uint64(shard << bits - shard_bits), n[n > 1]
                yield pa.record_batch([pa.array(fps.view(np.int64)), pa.array(n)], ["fp", "n"])

    return merged.mapInArrow(run, "fp long, n long")


def several_texts(docs: DataFrame, found: DataFrame, total: int, bits: int = 64) -> DataFrame:
    """fp of those repeated fingerprints under which texts differ, byte by byte; whole texts are compared, each once a task."""
    texts = docs.select(normal(F.col("text")).alias("text")).select(fingerprint(F.col("text"), bits).alias("fp"), "text")
    if found.count() <= BROADCAST:
        texts = texts.join(F.broadcast(found.select("fp")), "fp")
    else:
        texts = hot_join(texts, found, "fp", total)
    return texts.select("fp", "text").distinct().groupBy("fp").count().where("count > 1").select("fp")


def duplicates(docs: DataFrame, bits: int = 64) -> DataFrame:
    """A row for each row of docs: doc_id, fp, text_sha256, keep_id, group_size, kept; from columns doc_id and text.

    Texts are equal if they are after lower-casing A-Z, null being empty. Of equal texts the row with the largest doc_id
    is kept, null being the smallest, and of repeated rows of one id just one. A fingerprint that the filters count once
    is of one row, which is kept; under one that they count more often all texts are compared, and where they differ the
    texts' digests part them, else they are one group. Texts of any length are compared whole; no documents give no rows.
    Other columns aren't read. A text that a third of all rows hold is broadcast as one row, never gathered.
    """
    text = normal(F.col("text"))
    keyed = docs.select("doc_id", text.alias("text"), F.monotonically_increasing_id().alias("row"))
    keyed = saved(keyed.select("row", "doc_id", fingerprint(F.col("text"), bits).alias("fp"), F.unhex(F.sha2("text", 256)).alias("sha")), "keyed")
    total = keyed.count()
    found = saved(repeated(filters(keyed, total, bits), total, bits), "repeated")
    several = saved(several_texts(docs, found, total, bits), "several")
    members = keyed.join(several.withColumn("differ", F.lit(True)), "fp", "left")
    members = members.withColumn("class", F.concat(F.unhex(F.lpad(F.hex("fp"), 16, "0")), F.when(F.col("differ"), F.col("sha")).otherwise(F.lit(b""))))
    groups = hot_join(members, found, "fp", total).groupBy("class").agg(F.max(F.struct("doc_id", "row")).alias("keep"), F.count("*").alias("n"))
    groups = saved(groups.where("n > 1"), "groups")
    hot = F.col("n") * 1000 > total  # fewer than 1,000
    often, others = F.broadcast(groups.where(hot)), groups.where(~hot)
    rest = members.join(F.broadcast(groups.where(hot).select("class")), "class", "left_anti").join(others, "class", "left")
    result = members.join(often, "class").select(*rest.columns).unionByName(rest)
    alone = F.col("n").isNull()
    return result.select(
        "doc_id", "fp", F.lower(F.hex("sha")).alias("text_sha256"), F.when(alone, F.col("doc_id")).otherwise(F.col("keep.doc_id")).alias("keep_id"),
        F.coalesce("n", F.lit(1)).alias("group_size"), (alone | (F.col("row") == F.col("keep.row"))).alias("kept"), "row",
    )


EXACT_SQL = """
WITH d AS (SELECT doc_id, translate(coalesce(text, ''), 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz') AS t FROM documents),
g AS (SELECT t, max(doc_id) AS keep_id, count(*) AS group_size FROM d GROUP BY t)
SELECT doc_id, keep_id, group_size, doc_id = keep_id AS kept, sha256(t) AS text_sha256 FROM d JOIN g USING (t)
"""
