"""A written inverted index: postings in blocks by term and range of chunks, with the most a block can add to a score."""

from __future__ import annotations

from collections import defaultdict
from collections.abc import Callable, Sequence
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F
from pyspark.sql.pandas.types import to_arrow_type

from evispark.functions.text import tokenize
from evispark.operators.retrieval import DIGITS, K1, Asked, B, best_of, key_of, only, opened, ranked
from evispark.sources import shared

#: Chunks of a range, and ranges at most; beyond that ranges grow.
PER_RANGE, MOST_RANGES = 512, 1 << 22
#: Terms of a bucket of files, and buckets at most.
PER_BUCKET, MOST_BUCKETS = 50_000, 4_096
#: Ranges whose hits set a question's threshold; an index of no more ranges is read without one.
FIRST = 32
#: Pairs (question, term) of a pass, pairs of `allowed` that are broadcast at most, and ranges whose numbers are.
ASKED, PAIRS, NEEDED = 200_000, 1_000_000, 10_000_000


class Index(NamedTuple):
    """chunks: (chunk_id, dl, keys, terms, probe); postings: (bucket, term, range, n, top, hits), a row a block."""

    chunks: DataFrame
    postings: DataFrame
    n: int
    avgdl: float
    ranges: int
    buckets: int


def counted(batches):
    """Rows (tokens and others) with the number of tokens, dl, each distinct one with how often it occurs, terms, and any one of them, probe, in place of the tokens."""
    for b in (x.slice(i, PER_RANGE) for x in batches for i in range(0, x.num_rows, PER_RANGE)):
        lists = b.column("tokens")
        sizes = pc.list_value_length(lists).to_numpy(zero_copy_only=False)
        told = lists.flatten().dictionary_encode()
        width = max(1, len(told.dictionary))
        pairs, tf = np.unique(np.repeat(np.arange(len(lists)), sizes) * width + told.indices.to_numpy(), return_counts=True)
        row, term = np.divmod(pairs, width)
        terms = pa.StructArray.from_arrays([told.dictionary.take(pa.array(term)), pa.array(tf, pa.int32())], ["term", "tf"])
        ends = np.searchsorted(row, np.arange(len(lists) + 1))
        any_ = ends[:-1] + (sizes * 40503 + np.arange(len(lists))) % np.maximum(np.diff(ends), 1)
        probe = told.dictionary.take(pa.array(term[np.minimum(any_, len(term) - 1)])) if len(term) else pa.nulls(len(lists), pa.string())
        kept = [c for c in b.schema.names if c != "tokens"]
        yield pa.record_batch([*(b.column(c) for c in kept), pa.array(sizes, pa.int32()), pa.ListArray.from_arrays(pa.array(ends, pa.int32()), terms), probe], [*kept, "dl", "terms", "probe"])


def ranges_of(batches):
    """(range, rows of it as one table), of rows in the order of ranges."""
    held, of = [], None
    for b in batches:
        ranges = b.column("range").to_numpy()
        cuts = [0, *(np.flatnonzero(np.diff(ranges)) + 1).tolist(), len(ranges)]
        for i, j in zip(cuts[:-1], cuts[1:], strict=True):
            if i == j:
                continue
            if of is not None and ranges[i] != of:
                yield of, pa.Table.from_batches(held).combine_chunks()
                held = []
            of = ranges[i]
            held.append(b.slice(i, j - i))
    if held:
        yield of, pa.Table.from_batches(held).combine_chunks()


def blocks_of(batches, keys: Sequence[str], avgdl: float, k1: float, b: float):
    """A row (term, range, n, top, hits) for each term of each range, of rows (chunk_id, keys, dl, terms, range) in the order of ranges."""
    for of, rows in ranges_of(batches):
        lists, dl = one(rows["terms"]), rows["dl"].to_numpy()
        term, tf = lists.flatten().flatten()
        told = term.dictionary_encode()
        order = np.argsort(told.indices.to_numpy(), kind="stable")
        row = np.repeat(np.arange(len(lists)), pc.list_value_length(lists).to_numpy(zero_copy_only=False))[order]
        n = np.bincount(told.indices.to_numpy(), minlength=len(told.dictionary))
        begins = np.concatenate([[0], np.cumsum(n)])
        if not len(row):
            continue
        tf = tf.take(pa.array(order))
        top = np.maximum.reduceat(gain(tf.to_numpy(), dl[row], avgdl, k1, b), begins[:-1])
        columns = {c: one(rows[c]).take(pa.array(row)) for c in ("chunk_id", *keys)} | {"tf": tf, "dl": pa.array(dl[row], pa.int32())}
        hits = pa.ListArray.from_arrays(pa.array(begins, pa.int32()), pa.StructArray.from_arrays([*columns.values()], [*columns]))
        yield pa.record_batch([told.dictionary, pa.array(np.full(len(n), of), pa.int32()), pa.array(n), pa.array(top), hits], ["term", "range", "n", "top", "hits"])


def one(column: pa.ChunkedArray | pa.Array) -> pa.Array:
    """A column as one array."""
    return column.combine_chunks() if isinstance(column, pa.ChunkedArray) else column


def gain(tf, dl, avgdl, k1: float = K1, b: float = B):
    """Of columns or of arrays."""
    return tf * (k1 + 1) / (tf + k1 * (1 - b + b * dl / avgdl))


def bucket_of(term: Column, buckets: int) -> Column:
    return F.pmod(F.xxhash64(term), F.lit(buckets)).cast("int")


def write(chunks: DataFrame, path: str, tokens: Callable[[Column], Column] = tokenize, keys: Sequence[str] = (), k1: float = K1, b: float = B, per_range: int = PER_RANGE) -> None:
    """Writes the index of chunks (chunk_id, text, keys) under path; keys are columns that searches may filter by.

    Texts are tokenized once, into (term, tf) of each chunk, counted by Arrow batches. A block holds a term's postings of
    a range of chunks (by hash of chunk_id), so that even a term of every chunk is many rows, and the most that one
    of them gains. Chunks are dealt by range, so that a task makes all blocks of a range from its chunks and no posting is
    moved by itself. Blocks lie in folders by bucket of the term, sorted by term, in files that are neither large nor many.
    """
    spark = chunks.sparkSession
    told = "".join(f"`{c}` {chunks.schema[c].dataType.simpleString()}, " for c in ("chunk_id", *keys))
    words = chunks.select("chunk_id", *keys, F.coalesce(tokens(F.col("text")), F.array().cast("array<string>")).alias("tokens"))
    forward = words.mapInArrow(counted, f"{told}dl int, terms array<struct<term: string, tf: int>>, probe string")
    forward.write.parquet(f"{path}/chunks")
    forward = spark.read.schema(forward.schema).parquet(f"{path}/chunks")
    n, avgdl, names = forward.agg(F.count("*"), F.avg("dl"), F.approx_count_distinct("probe")).first()
    if not n:
        raise ValueError("the corpus is empty")
    ranges, buckets = min(MOST_RANGES, -(-n // per_range)), min(MOST_BUCKETS, max(8, names // PER_BUCKET))
    tasks = min(ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), ranges // 16))
    rows = forward.drop("probe").withColumn("range", F.pmod(F.xxhash64("chunk_id"), F.lit(ranges)).cast("int")).repartition(tasks, "range").sortWithinPartitions("range")
    blocks = rows.mapInArrow(lambda batches: blocks_of(batches, keys, avgdl or 1.0, k1, b), f"term string, range int, n long, top double, hits array<struct<{told}tf: int, dl: int>>".replace("` ", "`: "))
    blocks = blocks.withColumn("bucket", bucket_of(F.col("term"), buckets))
    blocks.hint("rebalance", "bucket").sortWithinPartitions("bucket", "term", "range").write.partitionBy("bucket").parquet(f"{path}/postings")
    spark.createDataFrame([(n, float(avgdl or 1.0), ranges, buckets)], "n long, avgdl double, ranges int, buckets int").coalesce(1).write.parquet(f"{path}/meta")


def read(spark: SparkSession, path: str) -> Index:
    meta = spark.read.parquet(f"{path}/meta").first()
    return Index(spark.read.parquet(f"{path}/chunks"), spark.read.parquet(f"{path}/postings"), *meta)


def of(chunks: DataFrame, version: str, tokens: Callable[[Column], Column] = tokenize, keys: Sequence[str] = (), k1: float = K1, b: float = B, per_range: int = PER_RANGE) -> Index:
    """The index of chunks in the shared folder, written unless there is one of that version, tokenizer and parameters."""
    spark = chunks.sparkSession
    path = shared.path_of(spark, "bm25-2", version, f"{tokens.__module__}.{tokens.__qualname__}", tuple(keys), chunks.schema.simpleString(), k1, b, per_range)
    return read(spark, shared.made_once(spark, path, lambda own: write(chunks, own, tokens, keys, k1, b, per_range)))


class Weights(NamedTuple):
    """Stated questions as tasks have them: their ids, and for each term the questions that have it and its weight in each."""

    ids: pa.Array
    of: dict[str, tuple[np.ndarray, np.ndarray]]


def _best_of_ranges(batches, weights: Weights, top_k: int, lists: tuple[str, pa.Array, pa.Array, np.ndarray] | None):
    """The best chunks of each range for each question, from rows (range, question, term, chunk_id, gain) in the order of ranges.

    Rows with a question say which to score in their range; without any all are. A range's scores are one matrix of
    its chunks and these questions, to which each term adds its gains times its weights.
    """

    def best(rows: pa.Table):
        told = pc.unique(rows["question"].drop_null()).to_numpy()
        rows = rows.filter(pc.is_valid(rows["term"]))
        if not len(rows):
            return
        chosen = np.sort(told) if len(told) else np.arange(len(weights.ids))
        place = np.full(len(weights.ids), -1)
        place[chosen] = np.arange(len(chosen))
        chunks, terms = (rows[c].combine_chunks().dictionary_encode() for c in ("chunk_id", "term"))
        chunks, terms = (x.combine_chunks() if isinstance(x, pa.ChunkedArray) else x for x in (chunks, terms))
        at, gains = chunks.indices.to_numpy(), rows["gain"].to_numpy()
        order = np.argsort(terms.indices.to_numpy(), kind="stable")
        ends = np.cumsum(np.bincount(terms.indices.to_numpy(), minlength=len(terms.dictionary)))
        scores = np.zeros((len(chosen), len(chunks.dictionary)))
        for term, i, j in zip(terms.dictionary.to_pylist(), [0, *ends[:-1]], ends, strict=True):
            questions, w = weights.of[term]
            own = place[questions]
            scores[np.ix_(own[own >= 0], at[order[i:j]])] += np.outer(w[own >= 0], gains[order[i:j]])
        open_ = scores.T > 0
        if lists is not None:
            key, names, allowed, free = lists
            first = np.full(len(chunks.dictionary), -1)
            first[at[::-1]] = np.arange(len(at))[::-1]
            own = chunks.dictionary if key == "chunk_id" else rows[key].combine_chunks().take(pa.array(first))
            some = Asked(np.empty((len(chosen), 0)), weights.ids.take(pa.array(chosen)), None, free[chosen])
            open_ &= opened(allowed.take(pc.index_in(own, names)), some)
        chunk, question = np.nonzero(best_of(scores.T, open_, top_k))
        yield pa.record_batch([weights.ids.take(pa.array(chosen[question])), chunks.dictionary.take(pa.array(chunk)), pa.array(scores.T[chunk, question])], ["query_id", "chunk_id", "score"])

    for _, rows in ranges_of(batches):
        yield from best(rows)


def search(index: Index, queries: DataFrame, top_k: int = 5, tokens: Callable[[Column], Column] = tokenize, allowed: DataFrame | None = None, where: Column | None = None, k1: float = K1, b: float = B, first: int = FIRST) -> DataFrame:
    """(query_id, chunk_id, score, rank, source): what retrieval.bm25() gives, from the index alone; k1 and b are those it was written with.

    For a stated set of questions, in passes of ASKED terms, whose weights every task gets. Only the files of the asked
    terms' buckets are read. Each range's blocks tell the most that a chunk in it can score for a question: the
    `first` most promising ranges are scored, and of the others those that can still reach the k-th score found so
    far; the rest can't hold a hit, so none is lost. A posting is read once for all questions, and a range sends
    on each question's best. `where` limits hits by a condition on the index's keys, `allowed` by pairs (query_id, chunk_id)
    or (query_id, a key), a null of which allows all: up to PAIRS are broadcast, of more the hits are joined with them.
    """
    spark, kinds = queries.sparkSession, [f.dataType for f in (queries.schema["query_id"], index.chunks.schema["chunk_id"])]
    schema = f"query_id {kinds[0].simpleString()}, chunk_id {kinds[1].simpleString()}, score double"
    asked = queries.select("query_id", F.explode(tokens(F.col("query"))).alias("term")).groupBy("query_id", "term").agg(F.count("*").alias("qtf"))
    asked = asked.withColumn("bucket", bucket_of(F.col("term"), index.buckets))
    hits, passes = None, -(-asked.count() // ASKED)
    for turn in range(passes if top_k > 0 else 0):
        some = asked.where(F.pmod(F.xxhash64("query_id"), F.lit(passes)) == turn) if passes > 1 else asked
        found = _search(index, some, to_arrow_type(kinds[0]), schema, top_k, allowed, where, k1, b, first)
        hits = found if hits is None else hits.union(found)
    hits = hits if hits is not None else spark.createDataFrame([], schema)
    return ranked(hits, top_k, "chunk_id").withColumn("source", F.lit("bm25"))


def _search(index: Index, asked: DataFrame, kind: pa.DataType, schema: str, top_k: int, allowed: DataFrame | None, where: Column | None, k1: float, b: float, first: int) -> DataFrame:
    spark = asked.sparkSession
    stated = asked.toArrow().combine_chunks()  # ASKED rows at most, roughly
    terms = F.broadcast(spark.createDataFrame(stated.select(["bucket", "term"])).distinct())
    buckets = pc.unique(stated["bucket"]).to_pylist()
    blocks = index.postings.where(F.col("bucket").isin(*buckets)) if len(buckets) < index.buckets else index.postings
    blocks = blocks.join(terms, ["bucket", "term"], "left_semi")
    df = dict(map(tuple, blocks.groupBy("term").agg(F.sum("n")).collect()))  # no longer than the stated terms
    ids = pc.unique(stated["query_id"])
    question = pc.index_in(stated["query_id"], ids).to_numpy()
    known = np.array([df.get(t, 0) for t in stated["term"].to_pylist()], float)
    w = np.where(known > 0, stated["qtf"].to_numpy() * np.log(1 + (index.n - known + 0.5) / (known + 0.5)), 0)
    of = defaultdict(lambda: ([], []))
    for t, q, x in zip(stated["term"].to_pylist(), question.tolist(), w.tolist(), strict=True):
        of[t][0].append(q)
        of[t][1].append(x)
    weights = spark.sparkContext.broadcast(Weights(ids.cast(kind), {t: (np.array(q), np.array(x)) for t, (q, x) in of.items()}))

    key = key_of(allowed) if allowed is not None else "chunk_id"
    pairs = allowed is not None and allowed.where(F.col(key).isNotNull()).limit(PAIRS + 1).count()
    lists, within = None, top_k
    if allowed is not None and pairs <= PAIRS:
        open_ = allowed.where(F.col(key).isNotNull()).groupBy(key).agg(F.collect_set("query_id").alias("open")).toArrow()
        free = pc.is_in(ids, pa.array([r[0] for r in allowed.where(F.col(key).isNull()).select("query_id").distinct().collect()], ids.type))
        lists = spark.sparkContext.broadcast((key, *(pa.concat_arrays(open_[c].chunks) if len(open_) else pa.array([], open_[c].type) for c in (key, "open")), free.to_numpy(zero_copy_only=False)))
    elif allowed is not None:
        within = 0  # all that a range holds, as what is allowed shows later

    tasks = min(index.ranges, max(int(spark.conf.get("spark.sql.shuffle.partitions")), index.ranges // 64))  # rows are few next to what they cost: not to be coalesced by size

    def scored(need: DataFrame | None) -> DataFrame:
        held = blocks
        if need is not None:
            some = need.select("range").distinct()
            held = blocks.join(F.broadcast(some) if index.ranges <= NEEDED else some, "range", "left_semi")
        rows = held.select("range", "term", F.explode("hits").alias("h")).select("range", "term", "h.*")
        if where is not None:
            rows = rows.where(where)
        columns = ["chunk_id"] + ([key] if lists is not None and key != "chunk_id" else [])
        rows = rows.select("range", F.lit(None).cast("int").alias("question"), "term", *columns, gain(F.col("tf"), F.col("dl"), index.avgdl, k1, b).alias("gain"))
        if need is not None:
            rows = rows.unionByName(need.select("range", "question"), allowMissingColumns=True)
        dealt = rows.repartition(tasks, "range").sortWithinPartitions("range")
        found = dealt.mapInArrow(lambda batches: _best_of_ranges(batches, weights.value, within, lists.value if lists is not None else None), schema)
        return found if within else only(found if key == "chunk_id" else found.join(index.chunks.select("chunk_id", key), "chunk_id"), allowed, key).select("query_id", "chunk_id", "score")

    if index.ranges <= first:
        return scored(None)
    local = spark.createDataFrame(pa.table({"question": pa.array(question, pa.int32()), "bucket": stated["bucket"], "term": stated["term"], "w": pa.array(w)}))
    bounds = blocks.select("bucket", "term", "range", "top").join(F.broadcast(local), ["bucket", "term"]).groupBy("question", "range").agg(F.sum(F.col("w") * F.col("top")).alias("most"))
    order = ranked(bounds.withColumn("score", F.col("most")), first, "range", by="question").select("question", "range")
    begun = ranked(scored(order), top_k, "chunk_id").select("query_id", "chunk_id", "score", "rank").toArrow()  # at most top_k a question
    last = begun.filter(pc.equal(begun["rank"], top_k))
    least = np.full(len(ids), -np.inf)
    least[pc.index_in(last["query_id"].combine_chunks(), ids).to_numpy(zero_copy_only=False)] = last["score"].to_numpy()
    least = F.broadcast(spark.createDataFrame(pa.table({"question": pa.array(np.arange(len(ids)), pa.int32()), "least": pa.array(least - 2 * 10.0**-DIGITS)})))
    others = bounds.join(order, ["question", "range"], "left_anti").join(least, "question").where("most >= least")
    return spark.createDataFrame(begun.select(["query_id", "chunk_id", "score"]), schema).union(scored(others))
