"""Vectors written in blocks around pivots, and exact searches that skip the blocks that can't hold a hit."""

from __future__ import annotations

from collections.abc import Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type
from pyspark.sql.types import IntegerType, StructField, StructType

from evispark.operators.retrieval import Asked, asked_passes, best_of, dense, key_of, matrix_of, opened, ranked
from evispark.sources import shared

#: Vectors of a block, on average; pivots at most (a sample of the vectors, by hash of their ids); folders of blocks.
PER_BLOCK, MOST_PIVOTS, MOST_PARTS = 512, 4_096, 256
#: Blocks that set a question's threshold.
FIRST = 4
#: Pairs of `allowed` that are broadcast at most; more are joined to the vectors.
PAIRS = 1_000_000
#: Numbers of questions, in all blocks, that are broadcast at most (40 MB); beyond that blocks are joined by shuffle.
NEEDED = 10_000_000
#: What rounding may add to a bound, as a share of the lengths multiplied.
SLACK = 1e-9


class Blocks(NamedTuple):
    """heads: (part, block, n, centre, radius, norm), a row a block; rows: (part, block, ids, vectors, keys), the same with what it holds."""

    heads: DataFrame
    rows: DataFrame
    width: int
    keys: tuple[str, ...]


def write(vectors: DataFrame, path: str, keys: Sequence[str] = (), per_block: int = PER_BLOCK) -> None:
    """Writes vectors (chunk_id, vector, keys) in blocks under path; keys are columns that `allowed` may name.

    Each vector goes to its nearest pivot; a pivot's vectors are dealt, by hash of their id, into as many blocks as hold
    per_block each, so that a pivot of a third of all vectors is many rows. A block's head has the mean of its vectors, the
    greatest distance from it and the greatest length.
    """
    spark, kind = vectors.sparkSession, vectors.schema["chunk_id"].dataType
    n, least, width = vectors.agg(F.count("*"), F.min(F.size("vector")), F.max(F.size("vector"))).first()
    if not n:
        raise ValueError("there are no vectors")
    if least != width:
        raise ValueError("vectors differ in length, or one is null")
    chosen = vectors.select("vector", F.xxhash64("chunk_id").alias("h")).orderBy("h").limit(min(MOST_PIVOTS, -(-n // per_block))).collect()
    pivots = np.array([r["vector"] for r in chosen], float)
    parts = min(MOST_PARTS, len(pivots))
    known = spark.sparkContext.broadcast((pivots, (pivots**2).sum(axis=1) / 2))

    def nearest(batches):
        pivots, half = known.value
        for b in batches:
            at = [np.argmax(matrix_of(b.column("vector").slice(i, 4096), width) @ pivots.T - half, axis=1) for i in range(0, b.num_rows, 4096)]
            yield b.append_column("pivot", pa.array(np.concatenate(at) if at else np.zeros(0), pa.int32()))

    columns = vectors.select("chunk_id", "vector", *keys)
    assigned = columns.mapInArrow(nearest, StructType([*columns.schema, StructField("pivot", IntegerType())]))
    assigned.write.parquet(f"{path}/assigned")
    assigned = spark.read.schema(assigned.schema).parquet(f"{path}/assigned")
    sizes = assigned.groupBy("pivot").agg(F.ceil(F.count("*") / per_block).cast("int").alias("blocks"))  # a row a pivot
    dealt = assigned.join(F.broadcast(sizes), "pivot").withColumn("deal", F.pmod(F.xxhash64("chunk_id"), F.col("blocks")).cast("int"))
    element = vectors.schema["vector"].dataType.elementType.simpleString()
    held = ", ".join(f"`{k}` array<{vectors.schema[k].dataType.simpleString()}>" for k in keys)
    schema = f"part int, block string, n int, centre array<double>, radius double, norm double, ids array<{kind.simpleString()}>, vectors array<{element}>" + (f", {held}" if keys else "")

    def gather(batches):
        waiting, of = [], None
        for b in batches:
            cuts = np.flatnonzero(np.diff(b.column("pivot").to_numpy()) | np.diff(b.column("deal").to_numpy())) + 1
            for i, j in zip([0, *cuts.tolist()], [*cuts.tolist(), b.num_rows], strict=True):
                if i == j:
                    continue
                at = (b.column("pivot")[i].as_py(), b.column("deal")[i].as_py())
                if of is not None and at != of:
                    yield block(of, waiting)
                    waiting = []
                of = at
                waiting.append(b.slice(i, j - i))
        if waiting:
            yield block(of, waiting)

    def block(of, slices):
        rows = pa.Table.from_batches(slices).combine_chunks().to_batches()[0]
        x = matrix_of(rows.column("vector"), width)
        centre = x.mean(axis=0)
        radius, norm = np.sqrt(((x - centre) ** 2).sum(axis=1)).max(), np.sqrt((x**2).sum(axis=1)).max()
        one = lambda v: pa.ListArray.from_arrays([0, len(v)], v)
        values = [pa.array([of[0] % parts], pa.int32()), pa.array([f"{of[0]}-{of[1]}"]), pa.array([len(x)], pa.int32()), one(pa.array(centre)), pa.array([radius]), pa.array([norm])]
        values += [one(rows.column("chunk_id")), one(rows.column("vector").flatten()), *(one(rows.column(k)) for k in keys)]
        return pa.record_batch(values, ["part", "block", "n", "centre", "radius", "norm", "ids", "vectors", *keys])

    dealt = dealt.select("chunk_id", "vector", *keys, "pivot", "deal").repartition("pivot", "deal").sortWithinPartitions("pivot", "deal")
    made = dealt.mapInArrow(gather, schema)
    made.hint("rebalance", "part").write.partitionBy("part").option("maxRecordsPerFile", 4096).parquet(f"{path}/blocks")
    shared.delete(spark, f"{path}/assigned")


def read(spark: SparkSession, path: str) -> Blocks:
    rows = spark.read.parquet(f"{path}/blocks")
    own = [f.name for f in rows.schema if f.name not in ("part", "block", "n", "centre", "radius", "norm", "ids", "vectors")]
    return Blocks(rows.select("part", "block", "n", "centre", "radius", "norm"), rows.select("part", "block", "ids", "vectors", *own), len(rows.select("centre").first()[0]), tuple(own))


def of(vectors: DataFrame, version: str, keys: Sequence[str] = (), per_block: int = PER_BLOCK) -> Blocks:
    """The blocks of vectors in the shared folder, written unless there are some of that version and parameters."""
    spark = vectors.sparkSession
    path = shared.path_of(spark, "vectors", version, tuple(keys), vectors.schema.simpleString(), per_block)
    return read(spark, shared.made_once(spark, path, lambda own: write(vectors, own, keys, per_block)))


def bounds(head: pa.RecordBatch, asked: Asked) -> np.ndarray:
    """(blocks, questions): what no inner product of a block's vectors exceeds: by its centre and radius, and by its longest vector."""
    lengths = np.sqrt((asked.vectors**2).sum(axis=1))
    centre = matrix_of(head.column("centre"), asked.vectors.shape[1])
    radius, norm = head.column("radius").to_numpy(), head.column("norm").to_numpy()
    slack = SLACK * np.outer(norm + 1, lengths + 1)
    return np.minimum(centre @ asked.vectors.T + np.outer(radius, lengths), np.outer(norm, lengths)) + slack


def search(blocks: Blocks, queries: DataFrame, top_k: int = 5, not_self: bool = False, allowed: DataFrame | None = None, first: int = FIRST) -> DataFrame:
    """What retrieval.dense() finds, (query_id, chunk_id, score, rank, source), reading only blocks that may hold a hit.

    From the heads come each question's `first` most promising blocks, whose scores give its threshold: the k-th best that
    it may find. Of the others those are read whose bound reaches it, and of them just for the questions concerned; a block
    that isn't read can't hold a hit. `allowed` pairs are applied within the block: broadcast up to PAIRS of them, else
    the blocks' vectors are joined with them as dense() does. Folders without a needed block aren't opened.
    """
    spark, id_kind = queries.sparkSession, queries.schema["query_id"].dataType
    kind = blocks.rows.schema["ids"].dataType.elementType
    schema, hits = f"query_id {id_kind.simpleString()}, chunk_id {kind.simpleString()}, score double", None
    key, lists, keys = None, None, blocks.keys
    if allowed is not None:
        key = key_of(allowed)
        if allowed.where(F.col(key).isNotNull()).limit(PAIRS + 1).count() > PAIRS:
            size = F.lit(blocks.width)
            each = F.arrays_zip(F.col("ids").alias("chunk_id"), F.transform(F.sequence(F.lit(0), F.size("ids") - 1), lambda i: F.slice("vectors", i * size + 1, size)).alias("vector"), *(F.col(k) for k in blocks.keys)).alias("x")
            return dense(blocks.rows.select(F.explode(each).alias("x")).select("x.*"), queries, top_k, not_self, allowed=allowed)
        found = allowed.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("query_id").alias("open")).toArrow().combine_chunks()
        lists = spark.sparkContext.broadcast(tuple(pa.concat_arrays(found[c].chunks) if len(found) else pa.array([], found[c].type) for c in (key, "open")))
    heads = blocks.heads.count()
    pair, need = "part int, block string, query int, most double", "part int, block string, asked array<int>"

    for asked in asked_passes(queries, to_arrow_type(id_kind), allowed=allowed):
        sent = spark.sparkContext.broadcast(asked)

        def promising(batches, sent=sent):
            for b in batches:
                most = bounds(b, sent.value)
                row, query = np.nonzero(best_of(most, np.ones(most.shape, bool), first))
                yield pa.record_batch([b.column("part").take(pa.array(row)), b.column("block").take(pa.array(row)), pa.array(query, pa.int32()), pa.array(most[row, query])], ["part", "block", "query", "most"])

        def scored(batches, sent=sent):
            asked = sent.value
            for b in batches:
                ids, vectors, columns = b.column("ids"), b.column("vectors"), {k: b.column(k) for k in keys}
                for i in range(b.num_rows):
                    some = np.array(b.column("asked")[i].as_py())
                    part = Asked(asked.vectors[some], asked.ids.take(pa.array(some)), None, asked.free[some])
                    own = ids[i].values
                    scores = vectors[i].values.to_numpy(zero_copy_only=False).astype(float).reshape(len(own), -1) @ part.vectors.T
                    open_ = np.ones(scores.shape, bool)
                    if lists is not None:
                        names, open_lists = lists.value
                        where = own if key == "chunk_id" else columns[key][i].values
                        open_ = opened(open_lists.take(pc.index_in(where, names)), part)
                    if not_self:
                        open_ &= own.to_numpy(zero_copy_only=False)[:, None] != part.ids.to_numpy(zero_copy_only=False)[None, :]
                    row, query = np.nonzero(best_of(scores, open_, top_k))
                    yield pa.record_batch([part.ids.take(pa.array(query)), own.take(pa.array(row)), pa.array(scores[row, query])], ["query_id", "chunk_id", "score"])

        chosen = ranked(blocks.heads.mapInArrow(promising, pair).withColumnRenamed("most", "score"), first, "part", "block", by="query").select("part", "block", "query")
        chosen = chosen.groupBy("part", "block").agg(F.array_sort(F.collect_list("query")).alias("asked"))
        begun = ranked(blocks.rows.join(F.broadcast(chosen), ["part", "block"]).mapInArrow(scored, schema), top_k, "chunk_id").select("query_id", "chunk_id", "score", "rank").toArrow()  # at most top_k a question
        taken = chosen.toArrow()  # at most `first` blocks a question
        least = np.full(len(asked.ids), -np.inf)
        last = begun.filter(pc.equal(begun["rank"], top_k))
        least[pc.index_in(last["query_id"].combine_chunks(), asked.ids).to_numpy()] = last["score"].to_numpy()
        done = {b: set(q) for b, q in zip(taken["block"].to_pylist(), taken["asked"].to_pylist(), strict=True)}
        threshold = spark.sparkContext.broadcast((least, done))

        def needed(batches, sent=sent, threshold=threshold):
            least, done = threshold.value
            for b in batches:
                open_ = bounds(b, sent.value) >= least - 1e-6
                names = b.column("block").to_pylist()
                for i in [i for i, x in enumerate(names) if x in done]:
                    open_[i, list(done[names[i]])] = False
                row = np.flatnonzero(open_.any(axis=1))
                asked = pa.array([np.flatnonzero(open_[i]).tolist() for i in row], pa.list_(pa.int32()))
                yield pa.record_batch([b.column("part").take(pa.array(row)), b.column("block").take(pa.array(row)), asked], ["part", "block", "asked"])

        wanted = blocks.heads.mapInArrow(needed, need)
        few = heads * len(asked.ids) <= NEEDED
        rest = blocks.rows.join(F.broadcast(wanted) if few else wanted, ["part", "block"]).mapInArrow(scored, schema)
        both = spark.createDataFrame(begun.select(["query_id", "chunk_id", "score"]), schema).union(rest)
        hits = both if hits is None else hits.union(both)
    hits = hits if hits is not None else spark.createDataFrame([], schema)
    return ranked(hits, top_k, "chunk_id").withColumn("source", F.lit("dense"))
