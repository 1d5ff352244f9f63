"""Vectors of texts by an encoder, kept by the texts' contents so that a text is encoded once."""

from __future__ import annotations

import hashlib
import uuid
from collections.abc import Sequence
from typing import Protocol

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from evispark.sources import shared

#: Texts whose words and trigrams are hashed together; what a code point has of a trigram's number.
TOGETHER, MASK = 256, (1 << 21) - 1


class Encoder(Protocol):
    """What makes vectors of texts. name and limit (how much of a text it reads) tell encoders apart; width: a vector's length."""

    name: str
    limit: int
    width: int

    def documents(self, texts: Sequence[str]) -> np.ndarray: ...

    def queries(self, texts: Sequence[str]) -> np.ndarray: ...


class HashEncoder:
    """An encoder that needs no model: signed counts of hashed words and character trigrams, of length 1.

    An instruction is put before questions as models that were trained with one expect; an empty one leaves them as they are.
    """

    def __init__(self, width: int = 64, limit: int = 4096, instruction: str = ""):
        self.name, self.width, self.limit, self.instruction = f"hash-{width}", width, limit, instruction

    def documents(self, texts: Sequence[str]) -> np.ndarray:
        out = np.zeros((len(texts), self.width), np.float32)
        for i in range(0, len(texts), TOGETHER):
            out[i : i + TOGETHER] = self._sums([t[: self.limit].lower() for t in texts[i : i + TOGETHER]])
        norm = np.sqrt((out**2).sum(axis=1, keepdims=True))
        return out / np.where(norm > 0, norm, 1)

    def _sums(self, texts: list[str]) -> np.ndarray:
        """Each text's signed counts; a word or trigram is hashed once for all texts."""
        words = [t.split() for t in texts]
        told = {w: n for n, w in enumerate(dict.fromkeys(w for own in words for w in own))}
        at = np.fromiter((told[w] for own in words for w in own), np.int64)
        row = np.repeat(np.arange(len(texts)), [len(own) for own in words])
        codes = np.frombuffer("".join(texts).encode("utf-32-le", "surrogatepass"), np.uint32).astype(np.int64)
        of = np.repeat(np.arange(len(texts)), [len(t) for t in texts])
        whole = of[:-2] == of[2:]
        grams, place = np.unique((codes[:-2] | codes[1:-1] << 21 | codes[2:] << 42)[whole], return_inverse=True)  # 21 bits a code point
        features = [*told, *(chr(g & MASK) + chr(g >> 21 & MASK) + chr(g >> 42) for g in grams.tolist())]
        h = np.array([int.from_bytes(hashlib.blake2b(f.encode(errors="replace"), digest_size=8).digest(), "little") for f in features], np.uint64)
        at, row = np.concatenate([at, place + len(told)]), np.concatenate([row, of[:-2][whole]])
        slot, sign = (h % np.uint64(self.width)).astype(np.int64), np.where(h >> np.uint64(63), 1.0, -1.0)
        return np.bincount(row * self.width + slot[at], sign[at], len(texts) * self.width).reshape(len(texts), self.width)

    def queries(self, texts: Sequence[str]) -> np.ndarray:
        return self.documents([f"Instruct: {self.instruction}\nQuery: {t}" for t in texts] if self.instruction else texts)


def _vectors(rows: DataFrame, text: str, encoder: Encoder, encode: str, name: str) -> DataFrame:
    """rows with their text's vector in place of the text."""
    kept = [c for c in rows.columns if c != text]

    def run(batches):
        for b in batches:
            for part in (b.slice(i, 1024) for i in range(0, b.num_rows, 1024)):
                made = np.asarray(getattr(encoder, encode)([t or "" for t in part.column(text).to_pylist()]), np.float32)
                if made.shape != (part.num_rows, encoder.width) or not np.isfinite(made).all():
                    raise ValueError(f"the encoder gave vectors of shape {made.shape}, not {(part.num_rows, encoder.width)}, or numbers that are none")
                spans = pa.array(np.arange(part.num_rows + 1, dtype=np.int32) * encoder.width)
                yield pa.record_batch([*(part.column(c) for c in kept), pa.ListArray.from_arrays(spans, pa.array(made.ravel()))], [*kept, name])

    kinds = ", ".join(f"`{c}` {rows.schema[c].dataType.simpleString()}" for c in kept)
    return rows.select(*kept, text).mapInArrow(run, f"{kinds}, {name} array<float>")


def encode_queries(queries: DataFrame, encoder: Encoder) -> DataFrame:
    """queries (query_id, query) with query_vector."""
    return _vectors(queries.select("query_id", "query", F.col("query").alias("__text")), "__text", encoder, "queries", "query_vector")


def cache_path(spark: SparkSession, encoder: Encoder) -> str:
    return shared.path_of(spark, "encoded", encoder.name, encoder.limit, encoder.width)


def _known(spark: SparkSession, path: str) -> DataFrame | None:
    if not shared.exists(spark, path):
        return None
    return spark.read.schema("key binary, vector array<float>").option("recursiveFileLookup", "true").parquet(path)


def encoded(chunks: DataFrame, encoder: Encoder, path: str | None = None) -> tuple[DataFrame, int]:
    """chunks (chunk_id, text, and any others) with their vectors in place of the text, and how many texts had to be encoded.

    The cache holds a vector for each digest of a text that this encoder (by name, limit and width) has met. Digests are
    compared first, without texts; only texts that are new are read again, each once however many chunks repeat it, encoded,
    and added as a folder of their own that is renamed when complete. A lost job adds nothing; two that add the same
    text do no harm, as a digest counts once when read. A null text is empty.
    """
    spark = chunks.sparkSession
    path = path or cache_path(spark, encoder)
    key = F.unhex(F.sha2(F.coalesce("text", F.lit("")), 256))
    new, known = chunks.select(key.alias("key")).distinct(), _known(spark, path)
    if known is not None:
        new = new.join(known.select("key"), "key", "left_anti")
    own = f"{path}.new-{uuid.uuid4().hex}"
    new.write.parquet(f"{own}/keys")
    missing = spark.read.parquet(f"{own}/keys")
    n = missing.count()
    if n:
        texts = chunks.select(key.alias("key"), F.coalesce("text", F.lit("")).alias("text")).join(missing, "key", "left_semi").dropDuplicates(["key"])
        _vectors(texts, "text", encoder, "documents", "vector").write.parquet(f"{own}/vectors")
        shared.move(spark, f"{own}/vectors", f"{path}/batch-{uuid.uuid4().hex}")
    shared.delete(spark, own)
    found = _known(spark, path)
    columns = [c for c in chunks.columns if c != "text"]
    if found is None:
        return chunks.limit(0).select(*columns, F.lit(None).cast("array<float>").alias("vector")), 0
    return chunks.select(*columns, key.alias("key")).join(found.dropDuplicates(["key"]), "key").drop("key"), n
