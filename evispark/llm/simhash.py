"""SimHash near-duplicates: segment-popcount embedding, grid range-join, exact verification."""

from __future__ import annotations

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm import meeting, shingles
from evispark.llm.common import hot_join, prefix_of, saved, text_key
from evispark.llm.components import components

SEED = 42


def fingerprint(text: str | None, width: int = 4, step: int = 1 << 16) -> int:
    """64 majority bits of the XXH64 of every word shingle; A-Z count as a-z. Long texts go through `step` shingles at a time."""
    found = (text or "").encode().lower().split()  # bytes: only A-Z change, only ASCII white space splits
    if not found:
        return 0
    width = min(width, len(found))
    joined, sizes = b" ".join(found), np.fromiter(map(len, found), np.int64, len(found))
    ends = np.cumsum(sizes + 1) - 1
    starts, ends = (ends - sizes)[: len(found) - width + 1], ends[width - 1 :]
    counts, digest = np.zeros(64, np.int64), xxhash.xxh64_intdigest
    for at in range(0, len(starts), step):
        some = [digest(joined[i:j], SEED) for i, j in zip(starts[at : at + step].tolist(), ends[at : at + step].tolist(), strict=True)]
        bits = np.unpackbits(np.array(some, ">u8").view(np.uint8).reshape(-1, 8), axis=1)
        counts += bits.sum(axis=0, dtype=np.int32)
    return int.from_bytes(np.packbits(counts * 2 > len(starts)).tobytes(), "big")


def fingerprints(docs: DataFrame, width: int = 4) -> DataFrame:
    """doc_id, text_key and the fingerprint as a signed long, a row for each row of docs."""

    def run(batches):
        for b in batches:
            fps = np.array([fingerprint(t.as_py(), width) for t in b.column("text")], np.uint64).view(np.int64)
            yield pa.record_batch([b.column("doc_id"), b.column("text_key"), pa.array(fps, pa.int64())], ["doc_id", "text_key", "fp"])

    return docs.select("doc_id", text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, text_key long, fp long")


def cells_of(fps: np.ndarray, segment_bits: int) -> tuple[np.ndarray, np.ndarray]:
    """(cell, index of fingerprint): the grid points within Manhattan distance 1 of either half's vector of bit counts.

    A half's point is its segments' bit counts as digits of base segment_bits + 1.
    """
    base, segments = segment_bits + 1, 32 // segment_bits
    mask, powers = np.uint64((1 << segment_bits) - 1), base ** np.arange(segments, dtype=np.int64)
    cells, owners, own = [], [], np.arange(len(fps))
    for half in (0, 1):
        shifts = np.arange(segments, dtype=np.uint64) * np.uint64(segment_bits) + np.uint64(32 * half)
        counts = np.bitwise_count((fps[:, None] >> shifts) & mask).astype(np.int64)
        point = counts @ powers + half * base**segments
        cells.append(point)
        owners.append(own)
        for i in range(segments):
            for move in (-1, 1):
                ok = (counts[:, i] + move >= 0) & (counts[:, i] + move <= segment_bits)
                cells.append(point[ok] + move * powers[i])
                owners.append(own[ok])
    return np.concatenate(cells), np.concatenate(owners)


def spanning(fps: np.ndarray, max_bits: int) -> list[tuple[int, int]]:
    """Links that connect within one cell what links of at most max_bits connect: each member once against those not yet reached."""
    rest, found = fps, []
    while len(rest):
        queue, rest = [rest[0]], rest[1:]
        while queue and len(rest):
            x = queue.pop()
            near = np.bitwise_count(rest ^ x) <= max_bits
            if near.any():
                queue.extend(rest[near])
                found += [(x, y) for y in rest[near]]
                rest = rest[~near]
    return found


def run_links(cell: np.ndarray, fps: np.ndarray, max_bits: int, small: int = 48) -> list[tuple[int, int]]:
    """Links of each run of equal cells (sorted). Runs of up to `small` rows are first tested for any link all at once."""
    starts = np.flatnonzero(np.r_[True, cell[1:] != cell[:-1]])
    sizes = np.diff(np.r_[starts, len(cell)])
    live, longest = sizes > small, int(min(small, sizes.max(initial=1)))
    run = np.repeat(np.arange(len(starts)), sizes)
    at = np.flatnonzero(((sizes > 1) & ~live)[run])
    for k in range(1, longest):
        at = at[at + k < len(cell)]
        at = at[cell[at] == cell[at + k]]  # what has no partner at this distance has none further on
        if not len(at):
            break
        live[run[at[np.bitwise_count(fps[at] ^ fps[at + k]) <= max_bits]]] = True
    out = []
    for r in np.flatnonzero(live):
        out += spanning(fps[starts[r] : starts[r] + sizes[r]], max_bits)
    return out


def width_for(fingerprints: int) -> int:
    """The segment width whose cells suit so many distinct fingerprints; any gives the same links."""
    return 2 if fingerprints <= 4_000_000 else 1


def near_links(distinct: DataFrame, max_bits: int = 4, segment_bits: int | None = None) -> DataFrame:
    """(a, b): links between distinct fingerprints (column fp) that connect all that differ in at most max_bits bits.

    A fingerprint's halves of 32 bits are cut into segments; the vectors of segment bit counts of two fingerprints
    are at most as far apart (Manhattan) as their bits. So of two within max_bits, at most 5, one half is within
    2, and a grid point lies within 1 of both: each fingerprint goes to all such points, and only those that meet
    are compared bit by bit. No pair is missed. Narrow segments give more and emptier cells, for larger inputs; the
    result is the same, and the default goes by the number of fingerprints. In a cell, each member meets only those that no link has reached yet, so a large group of
    near copies costs and returns about one link for each member, not all its pairs.
    """
    segment_bits = segment_bits or width_for(distinct.count())
    if not 0 <= max_bits <= 5 or segment_bits not in (1, 2, 4, 8):
        raise ValueError("max_bits: 0 to 5; segment_bits: 1, 2, 4 or 8")

    def embed(batches):
        for b in batches:
            for part in (b.slice(i, 4096) for i in range(0, b.num_rows, 4096)):
                fps = part.column("fp").to_numpy(zero_copy_only=False)
                cell, own = cells_of(fps.view(np.uint64), segment_bits)
                yield pa.record_batch([pa.array(cell), pa.array(fps[own])], ["cell", "fp"])

    def link(batches):
        cell, fps = np.empty(0, np.int64), np.empty(0, np.uint64)
        for b in batches:
            cell = np.r_[cell, b.column("cell").to_numpy()]
            fps = np.r_[fps, b.column("fp").to_numpy().view(np.uint64)]
            cut = int(np.searchsorted(cell, cell[-1])) if len(cell) else 0  # the last run may go on
            yield out(run_links(cell[:cut], fps[:cut], max_bits) if cut else [])
            cell, fps = cell[cut:], fps[cut:]
        if len(cell):
            yield out(run_links(cell, fps, max_bits))

    def out(found):
        a, b = np.array(found, np.uint64).reshape(-1, 2).view(np.int64).T
        return pa.record_batch([pa.array(a), pa.array(b)], ["a", "b"])

    n = int(distinct.sparkSession.conf.get("spark.sql.shuffle.partitions"))
    return distinct.select("fp").mapInArrow(embed, "cell long, fp long").repartition(n, "cell").sortWithinPartitions("cell").mapInArrow(link, "a long, b long")


def near_duplicates(docs: DataFrame, width: int = 4, max_bits: int = 4, segment_bits: int | None = None) -> DataFrame:
    """doc_id, text_key, fp, root, component_id: the smallest doc_id among documents reachable by links of at most max_bits bits.

    root is the component's smallest fingerprint that a link led to.
    Null or empty texts and texts without a word have fingerprint 0 and link like any other; texts of fewer than
    `width` words are one shingle. Repeated rows each get their row. A null doc_id counts as larger than any;
    component_id is null where the component has no other. No documents give no rows. Other columns aren't read.
    """
    fps = saved(fingerprints(docs, width), "fingerprints")
    least = saved(fps.groupBy("fp").agg(F.min("doc_id").alias("least"), F.count("*").alias("n")), "distinct")
    roots = components(near_links(least, max_bits, segment_bits), "a", "b").select(F.col("node").alias("fp"), "root")
    tops = least.join(roots, "fp").groupBy("root").agg(F.min("least").alias("top"))
    tops = roots.join(tops, "root").select("fp", "root", "top")
    linked = F.col("root").isNotNull()
    classes = least.join(tops, "fp", "left").select("fp", "n", F.coalesce("root", "fp").alias("root"), F.when(linked, F.col("top")).otherwise(F.col("least")).alias("component_id"))
    return hot_join(fps, saved(classes, "classes"), "fp", fps.count()).select("doc_id", "text_key", "fp", "root", "component_id")


def fingerprint_hex(fp) -> F.Column:
    return F.lower(F.lpad(F.hex(fp), 16, "0"))


def kept_rows(docs: DataFrame, firsts: DataFrame) -> DataFrame:
    """The rows of docs that are (doc_id, text_key) of firsts, each once."""
    own = prefix_of(docs)
    keys = firsts.select(F.col("doc_id").alias(f"{own}keep_id"), F.col("text_key").alias(f"{own}keep_key"))
    keyed = docs.withColumn(f"{own}key", text_key(F.col("doc_id"), F.col("text")))
    kept = keyed.join(keys, (F.col(f"{own}key") == F.col(f"{own}keep_key")) & F.col("doc_id").eqNullSafe(F.col(f"{own}keep_id")), "left_semi")
    return kept.dropDuplicates([f"{own}key", "doc_id"]).drop(f"{own}key")


def keep_one(docs: DataFrame, **options) -> DataFrame:
    """The rows of docs of which near_duplicates keeps one for each component: that with the smallest doc_id.

    Null ids come last, ties go to the smaller text key, and of wholly repeated rows one stays. Columns are those of docs.
    """
    found = near_duplicates(docs, **options)
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    return kept_rows(docs, found.groupBy("root").agg(F.min(order).alias("first")).select("first.doc_id", "first.text_key"))


def keep_one_similar(docs: DataFrame, max_bits: int = 4) -> DataFrame:
    """The rows of docs of which one stays for each component of documents whose five-word shingles are alike by 0.8: that with the smallest doc_id.

    Candidates are what the SimHashes of the shingles link, at max_bits; as texts that are just 0.8 alike differ in 10
    of 64 bits on average, beyond what a grid of bit counts can find, texts that meet in a min-hash table are candidates
    too. Every link is verified on the shingles. Null ids come last, ties go to the smaller text key, and of wholly
    repeated rows one stays. Texts of the same words are one, those without a word too. Columns are those of docs.
    """
    order = F.struct(F.col("doc_id").isNull().alias("no_id"), "doc_id", "text_key")
    found = saved(shingles.bodies(docs), "bodies").groupBy("body", "fp").agg(F.min(order).alias("first"), F.any_value("cells").alias("cells"))
    distinct = saved(found, "distinct-bodies")
    fps = saved(distinct.groupBy("fp").agg(F.min("body").alias("body"), F.count("*").alias("n")), "distinct")
    links = near_links(fps, max_bits)
    group = lambda a, b: F.shiftrightunsigned(F.xxhash64(a, b), 2).bitwiseOR(F.lit(meeting.GROUP))
    ends = links.join(fps.select(F.col("fp").alias("a"), F.col("body").alias("x")), "a").join(fps.select(F.col("fp").alias("b"), F.col("body").alias("y")), "b")
    pairs = ends.select(group("a", "b").alias("cell"), F.explode(F.array("x", "y")).alias("body"))
    same = distinct.join(fps.where("n > 1").select("fp"), "fp").select(group("fp", "fp").alias("cell"), "body")
    met = meeting.groups(distinct.select(F.explode("cells").alias("cell"), F.col("body").alias("key"))).select("cell", F.col("key").alias("body"))
    members = saved(met.union(pairs).union(same), "document-cells").groupBy("body").agg(F.collect_set("cell").alias("cells"))
    members = members.join(distinct.select("body", "first.text_key"), "body")
    keyed = docs.select(text_key(F.col("doc_id"), F.col("text")).alias("text_key"), "text")
    texts = keyed.join(members, "text_key").dropDuplicates(["text_key"]).select(F.explode("cells").alias("cell"), "body", "text")
    roots = components(shingles.links(texts), "a", "b", "document-links").select(F.col("node").alias("body"), "root")
    tops = distinct.select("body", "first").join(roots, "body", "left").groupBy(F.coalesce("root", "body").alias("root")).agg(F.min("first").alias("first"))
    return kept_rows(docs, tops.select("first.doc_id", "first.text_key"))
