"""Document fingerprints: Order MinHash over occurrence-numbered k-mers of code points."""

from __future__ import annotations

import hashlib

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evispark.llm.common import range_bounds, shard_of, text_key

#: Code points in a k-mer, k-mers in a tuple, tuples in a fingerprint.
K, TUPLE, SIZE = 8, 2, 32
SHARD_BYTES = 16 << 20
_SEEDS = np.random.default_rng(42).integers(1, 1 << 32, (3, SIZE), np.uint32) | np.uint32(1)
_MIX = np.uint64(0x9E3779B97F4A7C15)


def mixed(x: np.ndarray) -> np.ndarray:
    """A bijection of 64 bits that spreads each over all."""
    x = (x ^ (x >> np.uint64(31))) * _MIX
    x = (x ^ (x >> np.uint64(29))) * _MIX
    return x ^ (x >> np.uint64(32))


def sketch(codes: np.ndarray, step: int = 1 << 14) -> np.ndarray:
    """SIZE numbers of a text's code points: for each hash function, the TUPLE smallest occurrence-numbered k-mers, in text order, hashed together.

    A k-mer's first occurrence, its second and so on count as different items, so order and repeats matter as they do
    to edit distance. A text shorter than K is one k-mer; an empty one gives zeros. Long texts go by `step` positions.
    """
    if not len(codes):
        return np.zeros(SIZE, np.uint32)
    n = max(1, len(codes) - K + 1)
    kmers = np.zeros(n, np.uint64)
    for j in range(min(K, len(codes))):
        kmers = kmers * np.uint64(0x100000001B3) + codes[j : j + n]
    kmers = mixed(kmers)
    bits = np.uint64(n.bit_length())
    packed = np.sort((kmers >> bits << bits) | np.arange(n, dtype=np.uint64))
    fresh = np.r_[True, packed[1:] >> bits != packed[:-1] >> bits]
    order = np.arange(n)
    number = np.empty(n, np.uint64)
    number[(packed & ((np.uint64(1) << bits) - np.uint64(1))).astype(np.int64)] = order - np.maximum.accumulate(np.where(fresh, order, 0))
    items = (mixed(kmers + number * _MIX) >> np.uint64(32)).astype(np.uint32)
    rows = np.arange(SIZE)
    best, where = np.empty((SIZE, 0), np.uint32), np.empty((SIZE, 0), np.int64)
    for at in range(0, n, step):
        values = (items[None, at : at + step] ^ _SEEDS[0][:, None]) * _SEEDS[1][:, None]
        for _ in range(min(TUPLE, values.shape[1])):
            i = values.argmin(axis=1)
            best, where = np.c_[best, values[rows, i]], np.c_[where, i + at]
            values[rows, i] = 0xFFFFFFFF
        if best.shape[1] > TUPLE:
            first = np.argsort(best, axis=1, kind="stable")[:, :TUPLE]
            best, where = np.take_along_axis(best, first, 1), np.take_along_axis(where, first, 1)
    where.sort(axis=1)
    out = np.zeros(SIZE, np.uint64)
    for j in range(where.shape[1]):
        out = mixed(out + kmers[where[:, j]])
    return (out >> np.uint64(32)).astype(np.uint32) | np.uint32(1)  # never that of an empty text


def codes_of(text: str) -> np.ndarray:
    return np.frombuffer(text.encode("utf-32-le"), np.uint32)


def likeness(a: np.ndarray, b: np.ndarray) -> float:
    return float((a == b).mean())


def fingerprints(docs: DataFrame, shard_bytes: int = SHARD_BYTES) -> DataFrame:
    """doc_id, n_chars, edited_sha256, fingerprint, edited_fingerprint, near_edited, near_next for each row of docs.

    The edited text ends, in place of its last third, with the beginning of the next document's, in descending order of
    doc_id; the first follows the last. Rows are dealt into ranges of doc_id with bounds that depend on the rows
    alone, and sorted within; each range's first row goes to the range before it as well, so that every row meets its
    next in one task, which holds two texts at a time. One document is its own next. Null text is empty; null ids
    come last; rows with one id follow each other by text, in one task, which streams them. Ids of any type that sorts.
    No documents give no rows. Other columns aren't read.
    """
    kind, id_type = docs.schema["doc_id"].dataType.simpleString(), to_arrow_type(docs.schema["doc_id"].dataType)
    base = docs.select("doc_id", F.coalesce("text", F.lit("")).alias("text"))
    total = base.agg(F.count("*"), F.sum(F.octet_length("text"))).first()
    bounds = range_bounds(base, "doc_id", max(1, -(-(total[1] or 0) // shard_bytes), min(total[0] // 500, 32)), total[0])
    dealt = base.withColumn("shard", shard_of(F.col("doc_id"), bounds).cast("int"))
    firsts = {r[0]: r[1] for r in dealt.groupBy("shard").agg(F.max("doc_id")).collect()}  # one row a range
    if firsts:
        order = sorted(firsts, reverse=True)
        before = {s: order[i - 1] for i, s in enumerate(order)}  # the first range's is the last
        first_of = F.element_at(F.array(*(F.lit(firsts.get(s)).cast(kind) for s in range(len(bounds) + 1))), F.col("shard") + 1)
        goes_to = F.element_at(F.array(*(F.lit(before.get(s, 0)) for s in range(len(bounds) + 1))), F.col("shard") + 1)
        places = F.array(F.struct("shard", F.lit(0).alias("carried")), F.when(F.col("doc_id").eqNullSafe(first_of), F.struct(goes_to.alias("shard"), F.lit(1).alias("carried"))))
        dealt = dealt.withColumn("place", F.explode(F.array_compact(places))).select("doc_id", "text", "place.shard", "place.carried")
    else:
        dealt = dealt.withColumn("carried", F.lit(0))
    ordered = dealt.repartitionById(len(bounds) + 1, F.col("shard")).sortWithinPartitions("shard", "carried", F.desc_nulls_last("doc_id"), text_key(F.col("doc_id"), F.col("text")))

    def run(batches):
        rows, held, ended = [], None, False
        for batch in batches:
            for doc_id, t, carried in zip(batch.column("doc_id"), batch.column("text"), batch.column("carried"), strict=True):
                if ended:
                    continue
                codes = codes_of(t.as_py())
                now = (doc_id.as_py(), codes, sketch(codes))
                if held is not None:
                    rows.append(compared(*held, *now[1:]))
                held, ended = now, bool(carried.as_py())
                if len(rows) >= 256:
                    yield batch_of(rows)
                    rows = []
        yield batch_of(rows)

    def compared(doc_id, codes, own, next_codes, next_own):
        cut = len(codes) // 3
        edited = np.r_[codes[: len(codes) - cut], next_codes[:cut]]
        changed = sketch(edited)
        digest = hashlib.sha256(edited.astype("<u4").tobytes().decode("utf-32-le").encode()).hexdigest()
        return doc_id, len(codes), digest, own.tobytes().hex(), changed.tobytes().hex(), likeness(own, changed), likeness(own, next_own)

    schema = f"doc_id {kind}, n_chars long, edited_sha256 string, fingerprint string, edited_fingerprint string, near_edited double, near_next double"
    types = (pa.int64(), pa.string(), pa.string(), pa.string(), pa.float64(), pa.float64())

    def batch_of(rows):
        cols = list(zip(*rows, strict=True)) or [[]] * 7
        ids = pa.array(cols[0], id_type)
        return pa.record_batch([ids, *(pa.array(x, t) for x, t in zip(cols[1:], types, strict=True))], ["doc_id", "n_chars", "edited_sha256", "fingerprint", "edited_fingerprint", "near_edited", "near_next"])

    return ordered.mapInArrow(run, schema)
