"""Phrase collocations: suffix automata of shards of texts, their counts added up, cuts scored, phrases within commoner ones dropped."""

from __future__ import annotations

from collections.abc import Callable

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc
import xxhash
from pyspark.sql import Column, DataFrame
from pyspark.sql import Window as W
from pyspark.sql import functions as F

from evispark.llm import tokens
from evispark.llm.automaton import automaton
from evispark.llm.common import saved

DEPTH, LEAST, SHARE, TOP = 4, 30, 80, 2000
KINDS = tokens.kinds(b" \t", b".,;:!?\n\x0b\x0c\r")
#: A sieve's bits for each key, and its bits at most (32 MB): beyond that it lets more through, and no count changes.
SIEVE_BITS, MOST_BITS = 16, 1 << 28
#: Parts of a language in which its best phrases are sought first.
SALTS = 64

Digest = Callable[[bytes, int], int]


def symbols_of(shard: pa.Table, seed: int, digest: Digest) -> tuple[tokens.Words, pa.Array, np.ndarray, np.ndarray]:
    """The shard's words, its languages, and for each word the number of its (language, word) and those numbers' digests."""
    found = tokens.coded(shard["text"], KINDS)
    lang = shard["lang"].combine_chunks().fill_null("und").dictionary_encode() if len(shard) else pa.array([], pa.string()).dictionary_encode()
    lang = lang.combine_chunks() if isinstance(lang, pa.ChunkedArray) else lang
    both = lang.indices.to_numpy().astype(np.int64)[found.doc] * max(1, len(found.words)) + found.codes
    known, symbol = np.unique(both, return_inverse=True)
    heads = [f"{len(x)}:{x}".encode() for x in lang.dictionary.to_pylist()]
    words = found.words.to_pylist()
    which, word = np.divmod(known, max(1, len(words)))
    digests = np.fromiter((digest(heads[i] + words[j], seed) for i, j in zip(which.tolist(), word.tolist(), strict=True)), np.uint64, len(known))
    return found, lang.dictionary.take(pa.array(which)), symbol, digests


def paired(left: np.ndarray, right: np.ndarray) -> np.ndarray:
    """64 bits of two digests in a row."""
    return left ^ (right << np.uint64(17) | right >> np.uint64(47))


def word_counts(docs: DataFrame, seed: int, digest: Digest) -> DataFrame:
    """(w, lang, word, n): every language's words with their occurrences; w is their digest."""

    def run(batches):
        for shard in tokens.shards(batches):
            found, lang, symbol, digests = symbols_of(shard, seed, digest)
            code = np.zeros(len(digests), np.int64)
            code[symbol] = found.codes
            n = np.bincount(symbol, minlength=len(digests))
            yield pa.record_batch([pa.array(digests.view(np.int64)), lang.cast(pa.string()), found.words.take(pa.array(code)).cast(pa.binary()), pa.array(n)], ["w", "lang", "word", "n"])
            del shard, found, lang, symbol, digests, code, n  # not to be held while the next shard is read

    rows = docs.select("lang", "text").mapInArrow(run, "w long, lang string, word binary, n long")
    return rows.groupBy("w", "lang", "word").agg(F.sum("n").alias("n")).withColumn("word", F.col("word").cast("string"))


def sieve(keys: DataFrame, bits_of: Column) -> np.ndarray:
    """A table of 2^k bits, those of the keys set: 16 bits a key, 32 MB at most, so that it can be sent to every task.

    It never denies a key that is there; one that is not passes by chance, the more often the fuller the table. It only
    spares work, as whatever passes is counted exactly afterwards.
    """
    spark = keys.sparkSession
    size = min(MOST_BITS, max(1 << 16, 1 << (SIEVE_BITS * keys.count()).bit_length()))
    at = bits_of.bitwiseAND(F.lit(size - 1))
    words = keys.select(at.alias("at")).groupBy(F.shiftright("at", 6).cast("int").alias("i"))
    found = words.agg(F.bit_or(F.expr("shiftleft(1L, cast(at & 63 as int))")).alias("bits")).toArrow()
    table = np.zeros(size >> 6, np.int64)
    table[found["i"].to_numpy()] = found["bits"].to_numpy()
    return spark.sparkContext.broadcast(table)


def passes(table: np.ndarray, keys: np.ndarray) -> np.ndarray:
    at = keys & np.uint64(len(table) * 64 - 1)
    return (table.view(np.uint64)[(at >> np.uint64(6)).astype(np.int64)] >> (at & np.uint64(63)) & np.uint64(1)).astype(bool)


def longer_counts(docs: DataFrame, lo: int, hi: int, words, pairs, seed: int, digest: Digest) -> DataFrame:
    """(key, a): occurrences of every phrase of lo to hi words that the sieves let through; key is its words' digests in a row.

    Each shard's automaton gives one row for a state, the sequences that end at the same places: the longest and the
    shortest length. The lengths of a state become rows again only when they are added up, after the shuffle's map side.
    """

    def run(batches):
        for shard in tokens.shards(batches):
            found, _, symbol, digests = symbols_of(shard, seed, digest)
            usable = passes(words.value, digests)[symbol] if len(symbol) else np.zeros(0, bool)
            joined = ~found.fresh
            if pairs is not None and len(symbol):
                own = digests[symbol]
                joined[1:] &= passes(pairs.value, paired(own[:-1], own[1:]))
                del own
            states = automaton(symbol, usable, joined, hi)
            del shard, found, usable, joined
            for length in range(lo, hi + 1):
                of = states.hi == length
                if not of.any():
                    continue
                places = states.end[of][:, None] - np.arange(length - 1, -1, -1)
                keys = np.ascontiguousarray(digests[symbol[places]].astype(">u8"))
                spans = np.arange(len(keys) + 1, dtype=np.int32) * (8 * length)
                column = pa.Array.from_buffers(pa.binary(), len(keys), [None, pa.py_buffer(spans), pa.py_buffer(keys)])
                yield pa.record_batch([column, pa.array(np.maximum(states.lo[of], lo).astype(np.int32)), pa.array(states.count[of])], ["key", "lo", "n"])
                del of, places, keys, spans, column
            del symbol, digests, states

    rows = docs.select("lang", "text").mapInArrow(run, "key binary, lo int, n long")
    if hi > lo:
        size = F.explode(F.expr("sequence(lo, cast(length(key) / 8 as int))")).alias("size")
        rows = rows.select("key", "n", size).select(F.expr("substring(key, -8 * size)").alias("key"), "n")
    return rows.groupBy("key").agg(F.sum("n").alias("a"))


def digest64(data: bytes, seed: int) -> int:
    return xxhash.xxh64_intdigest(data, seed)


def counts(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, digest: Digest = digest64) -> tuple[DataFrame, DataFrame]:
    """Words (w, lang, word, n), all of them, and phrases (key, a, lang, word) of 1 to depth words found `least` times or more.

    A phrase is no commoner than its words and pairs of words, so first words, then pairs, then longer phrases are
    counted, and what is rarer breaks the sequences of the next step. Should two words of all share a digest,
    another seed is taken until none do, so that counts are exact.
    """
    seed = 0
    while True:
        words = saved(word_counts(docs, seed, digest), "words")
        if words.groupBy("w").count().where("count > 1").isEmpty():
            break
        seed += 1
    common = words.where(F.col("n") >= least)
    key = F.unhex(F.lpad(F.hex("w"), 16, "0"))
    phrases = common.select(key.alias("key"), F.col("n").alias("a"), "lang", "word")
    known = sieve(common, F.col("w"))
    pairs = None
    none = (F.lit(None).cast("string").alias("lang"), F.lit(None).cast("string").alias("word"))
    for lo, hi in ((2, 2), (3, depth)):
        if hi < lo or depth < lo:
            continue
        found = saved(longer_counts(docs, lo, hi, known, pairs, seed, digest).where(F.col("a") >= least), "phrases")
        phrases = phrases.unionByName(found.select("key", "a", *none))
        if depth > 2 and lo == 2:
            half = lambda at: F.conv(F.hex(F.substring("key", at, 8)), 16, -10).cast("long")
            left, right = half(1), half(9)
            turned = F.shiftleft(right, 17).bitwiseOR(F.shiftrightunsigned(right, 47))
            pairs = sieve(found, left.bitwiseXOR(turned))
    return words, phrases


def scored(phrases: DataFrame, depth: int = DEPTH) -> DataFrame:
    """(key, a, lang, k, l, r, score) of each phrase of two words or more: its lowest-scoring cut, ties to the smallest k."""
    cuts = phrases.where("length(key) > 8").select("key", "a", F.explode(F.expr("sequence(1, cast(length(key) / 8 as int) - 1)")).alias("k"))
    cuts = cuts.select("key", "a", "k", F.expr("substring(key, 1, 8 * k)").alias("left"), F.expr("substring(key, 8 * k + 1)").alias("right"))
    parts = phrases.select(F.col("key").alias("left"), F.col("a").alias("l"), "lang")
    cuts = cuts.join(parts, "left").join(parts.select(F.col("left").alias("right"), F.col("l").alias("r")), "right")
    score = F.expr("cast(a as decimal(20, 0)) * 2000000 div (cast(l as decimal(20, 0)) + r)")
    lowest = F.min(F.struct(score.alias("score"), "k", "l", "r"))
    return cuts.groupBy("key").agg(F.max("a").alias("a"), F.max("lang").alias("lang"), lowest.alias("cut")).select("key", "a", "lang", "cut.*")


def subsumed(phrases: DataFrame, share: int = SHARE) -> DataFrame:
    """Keys of phrases that lie within one a word longer with at least `share` % of their occurrences.

    Those are what a phrase's suffix link (without its first word) and its prefix lead to. One step is enough: what
    stands between a phrase and a longer one is at least as frequent as the longer one.
    """
    long = phrases.where("length(key) > 16").select("key", "a")
    links = long.select(F.expr("substring(key, 9)").alias("key"), "a").union(long.select(F.expr("substring(key, 1, length(key) - 8)"), "a"))
    most = links.groupBy("key").agg(F.max("a").alias("longer"))
    return phrases.select("key", "a").join(most, "key").where(F.col("longer").cast("decimal(20, 0)") * 100 >= F.col("a").cast("decimal(20, 0)") * share).select("key")


def collocations(docs: DataFrame, depth: int = DEPTH, least: int = LEAST, share: int = SHARE, top: int = TOP, digest: Digest = digest64) -> DataFrame:
    """lang, rank, phrase, a, l, r, n, score: the `top` best phrases of each language, from columns lang and text of docs.

    Null and empty texts hold no words, a null lang is `und` (as is a lang of that name), repeated rows count each, a text
    without white space is one word, ties go by phrase; languages without a phrase, and no documents, give no rows.
    Other columns are not read. Tasks hold a shard of 6 MB of text, or one text, and two sieves of 32 MB at most.
    """
    words, phrases = counts(docs, depth, least, digest)
    best = saved(scored(phrases, depth).join(subsumed(phrases, share), "key", "left_anti"), "scored")
    order = (F.col("score").desc(), F.col("a").desc())
    part = W.partitionBy("lang", F.pmod(F.xxhash64("key"), F.lit(SALTS))).orderBy(*order)
    best = best.withColumn("rank", F.rank().over(part)).where(F.col("rank") <= top)
    best = saved(best.withColumn("rank", F.rank().over(W.partitionBy("lang").orderBy(*order))).where(F.col("rank") <= top).drop("rank"), "best")  # ties at the end stay: texts decide
    at = best.select("key", F.explode(F.expr("sequence(1, cast(length(key) / 8 as int))")).alias("i")).withColumn("one", F.expr("substring(key, 8 * i - 7, 8)"))
    text = at.join(phrases.where("length(key) = 8").select(F.col("key").alias("one"), "word"), "one").groupBy("key").agg(F.array_join(F.array_sort(F.collect_list(F.struct("i", "word")))["word"], " ").alias("phrase"))
    sizes = words.groupBy("lang").agg(F.sum("n").alias("n"))
    ranked = best.join(text, "key").withColumn("rank", F.row_number().over(W.partitionBy("lang").orderBy(*order, "phrase")))
    long = lambda c: F.col(c).cast("long").alias(c)
    return ranked.where(F.col("rank") <= top).join(sizes, "lang").select("lang", long("rank"), "phrase", *map(long, ("a", "l", "r", "n", "score")))


_GRAMS = " UNION ALL ".join(
    f"SELECT lang, list_slice(ws, i, i + {m - 1}) g FROM pieces, UNNEST(range(1, len(ws) - {m - 2})) AS u(i)" for m in (1, 2, 3, 4)
)
PHRASES_SQL = rf"""
WITH cut AS (SELECT coalesce(lang, 'und') AS lang, unnest(string_split_regex(translate(text, 'ABCDEFGHIJKLMNOPQRSTUVWXYZ', 'abcdefghijklmnopqrstuvwxyz'), '[.,;:!?\x0A-\x0D]')) AS piece FROM documents WHERE text IS NOT NULL),
pieces AS (SELECT lang, list_filter(string_split_regex(piece, '[\x20\x09]+'), lambda x: x <> '') AS ws FROM cut),
grams AS ({_GRAMS}),
f AS (SELECT lang, g, count(*) AS a FROM grams GROUP BY lang, g HAVING count(*) >= 30),
sizes AS (SELECT lang, sum(len(ws)) AS n FROM pieces GROUP BY lang),
cuts AS (
  SELECT c.lang, c.g, c.a, k, x.a AS l, y.a AS r, (c.a::HUGEINT * 2000000) // (x.a + y.a) AS score
  FROM (SELECT *, unnest(range(1, len(g))) AS k FROM f WHERE len(g) > 1) c
  JOIN f x ON x.lang = c.lang AND x.g = list_slice(c.g, 1, k) JOIN f y ON y.lang = c.lang AND y.g = list_slice(c.g, k + 1, len(c.g))),
lowest AS (SELECT * FROM cuts QUALIFY row_number() OVER (PARTITION BY lang, g ORDER BY score, k) = 1),
longer AS (
  SELECT lang, list_slice(g, i, i + m - 1) AS g, max(a) AS longer
  FROM f, UNNEST(range(2, 4)) AS u(m), UNNEST(range(1, 4)) AS v(i) WHERE m < len(f.g) AND i + m - 1 <= len(f.g) GROUP BY ALL),
ranked AS (
  SELECT c.*, array_to_string(c.g, ' ') AS phrase, row_number() OVER (PARTITION BY c.lang ORDER BY score DESC, a DESC, encode(array_to_string(c.g, ' '))) AS rank
  FROM lowest c LEFT JOIN longer USING (lang, g) WHERE longer IS NULL OR 100 * longer < 80 * a)
SELECT lang, rank::BIGINT AS rank, phrase, a::BIGINT AS a, l::BIGINT AS l, r::BIGINT AS r, n::BIGINT AS n, score::BIGINT AS score
FROM ranked JOIN sizes USING (lang) WHERE rank <= 2000
"""
