"""LM scoring: a hashed maximum-entropy model with n-gram and skip features and a class-factored softmax."""

from __future__ import annotations

import itertools
import math
import zlib
from collections import Counter
from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark import TaskContext
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from evispark.llm.common import saved

#: Classes of WORDS words each, by rank; then the end's; then classes of all other words by their last bytes.
WORD_CLASSES, WORDS, SUFFIXES, SUFFIX_BYTES = 47, 32, 16, 3
CLASSES = WORD_CLASSES + 1 + SUFFIXES
#: Features of a token for its class, and for the word within a class of words.
FEATURES, INNER = 4, 2
#: Rows of weights that features are hashed to, for each square root of the training tokens, and the bounds of their number.
ROWS_PER_ROOT, LEAST_ROWS, MOST_ROWS = 1.5, 1 << 10, 1 << 16
#: Gradient updates, each from a share of the training texts; a step is so many times shorter than one feature alone would take; counts that smooth it.
ROUNDS, DAMPING, PRIOR = 4, 2.0, 16.0
#: Words whose counts are sent to all executors at most; the others' are joined.
FREQUENT = 100_000
STEP = 2048
#: A text's end as a token; no word is empty.
END = b""
_NONE = -80.0


def tokens(text: str | None) -> list[bytes]:
    """The words in UTF-8, A-Z as a-z, and the end."""
    return [*(text or "").encode().lower().split(), END]


def suffix_of(word: bytes) -> int:
    return zlib.crc32(word[-SUFFIX_BYTES:]) % SUFFIXES


@dataclass
class Vocabulary:
    """Frequent words by rank with their counts, the end's count, and what their codes mean.

    A code is a frequent word's rank, the number of frequent words for the end, and beyond, a hash and the suffix class
    of any other word. The first `inner` words are in classes of words.
    """

    rank: dict[bytes, int]
    counts: np.ndarray
    ends: int
    inner: int

    def __post_init__(self):
        n = len(self.rank)
        self.classes = np.full(n + 1, WORD_CLASSES, np.int64)
        self.classes[:n] = np.fromiter(map(suffix_of, self.rank), np.int64, n) + WORD_CLASSES + 1
        self.classes[: self.inner] = np.arange(self.inner) // WORDS

    def class_of(self, codes: np.ndarray) -> np.ndarray:
        rare = codes > len(self.rank)
        return np.where(rare, (codes - len(self.rank) - 1 >> 16) + WORD_CLASSES + 1, self.classes[np.where(rare, 0, codes)])


class Coder(dict):
    """word -> row of its code, log10(count + 0.5) (0 if not frequent) and whether it is frequent; of a fixed size."""

    def __init__(self, vocabulary: Vocabulary, size: int = 400_000):
        n = len(vocabulary.rank)
        self.rank, self.rare, self.size, self.new = vocabulary.rank | {END: n}, n + 1, size, []
        self.counts = np.r_[vocabulary.counts, vocabulary.ends, 0]
        self.codes, self.logs, self.known = np.zeros(size, np.int32), np.zeros(size), np.zeros(size, bool)

    def __missing__(self, word: bytes) -> int:
        i = self[word] = len(self)
        self.new.append(word)
        return i

    def code(self, found: list[bytes]) -> tuple[np.ndarray, ...]:
        """(codes, logs, known) of the words."""
        out = []
        for at in range(0, len(found), step := self.size // 4):
            if len(self) + step > self.size:
                self.clear()
            i = np.fromiter(map(self.__getitem__, found[at : at + step]), np.int64, min(step, len(found) - at))
            self.learn()
            out.append((self.codes[i], self.logs[i], self.known[i]))
        return tuple(map(np.concatenate, zip(*out, strict=True)))

    def learn(self) -> None:
        """Fills the rows of the words met since the last call, which are the last ones."""
        rows, n = slice(len(self) - len(self.new), len(self)), len(self.new)
        codes = np.fromiter(map(self.rank.get, self.new, itertools.repeat(-1)), np.int64, n)
        counts = self.counts[codes]
        self.known[rows], self.logs[rows] = counts > 0, np.where(counts > 0, np.log10(counts + 0.5), 0)
        rare = np.flatnonzero(codes < 0)
        words = [self.new[i] for i in rare.tolist()]
        suffixes = np.fromiter(map(suffix_of, words), np.int64, len(words))
        codes[rare] = self.rare + (suffixes << 16 | np.fromiter(map(zlib.crc32, words), np.int64, len(words)) & 0xFFFF)
        self.codes[rows] = codes
        self.new = []


@dataclass
class Model:
    """Weights of classes and of words within classes by hashed feature; biases are log shares."""

    bias: np.ndarray
    inner_bias: np.ndarray
    weights: np.ndarray
    inner: np.ndarray


def hashed(x: np.ndarray, rows: int) -> np.ndarray:
    """Spreads uint32 values over the rows."""
    x = (x ^ x >> np.uint32(15)) * np.uint32(0xC2B2AE35)
    x = (x ^ x >> np.uint32(13)) * np.uint32(0x27D4EB2F)
    return ((x ^ x >> np.uint32(16)).astype(np.uint64) * np.uint64(rows) >> np.uint64(32)).astype(np.int64)


def contexts(codes: np.ndarray, starts: np.ndarray) -> list[np.ndarray]:
    """For the last token, the one before and the third last of each token: its code and 1, as uint32; 0 before the text begins."""
    place = np.arange(len(codes)) - np.repeat(starts, np.diff(np.r_[starts, len(codes)]))
    own = codes.astype(np.uint32) + np.uint32(1)
    return [np.where(place >= k, np.r_[np.zeros(k, np.uint32), own[:-k]][: len(own)], 0).astype(np.uint32) for k in (1, 2, 3)]


def features(back: list[np.ndarray], rows: int) -> np.ndarray:
    """(tokens, FEATURES) rows of weights: the last word, the last two, the one before the last, the last and third last."""
    a, b, c = (np.uint32(x) for x in (0x85EBCA6B, 0xC2B2AE35, 0x27D4EB2F))
    last = back[0] * a
    return np.stack([hashed(x, rows) for x in (last, (last ^ back[1] * b) + np.uint32(1), back[1] * b + np.uint32(2), (last ^ back[2] * c) + np.uint32(3))], axis=1)


def inner_features(back: list[np.ndarray], classes: np.ndarray, rows: int) -> np.ndarray:
    """(tokens, INNER) rows: the class with the last word, and with the last two."""
    a, b = np.uint32(0x85EBCA6B), np.uint32(0xC2B2AE35)
    of = classes.astype(np.uint32) * np.uint32(0x9E3779B1) + np.uint32(4)
    last = back[0] * a
    return np.stack([hashed(last ^ of, rows), hashed((last ^ back[1] * b) + of, rows)], axis=1)


def raised(weights: np.ndarray, bias: np.ndarray, rows: np.ndarray, level: bool = False) -> tuple[np.ndarray, np.ndarray]:
    """(exp(scores), their sums by token); bias: a row for all or one for each token. Where a batch would overflow or vanish, tokens are levelled."""
    scores = np.take(weights, rows[:, 0], axis=0)
    for j in range(1, rows.shape[1]):
        scores += np.take(weights, rows[:, j], axis=0)
    scores += bias
    level = level or scores.max() > 80
    if level:
        scores -= scores.max(axis=1, keepdims=True)
    np.exp(scores, out=scores)
    sums = scores @ np.ones(scores.shape[1], scores.dtype)
    return (scores, sums) if level or sums.min() > 1e-30 else raised(weights, bias, rows, True)


def row_sums(rows: np.ndarray, values: np.ndarray, short: int = 16) -> tuple[np.ndarray, np.ndarray]:
    """The rows of weights that tokens use (tokens, features), ascending, and for each the sum of its tokens' values.

    Rows that up to `short` tokens use are summed together, the first token of each, then the second, and so on.
    """
    flat = rows.ravel().astype(np.uint16)
    order = np.argsort(flat, kind="stable")
    flat, order = flat[order], order // rows.shape[1]
    first = np.flatnonzero(np.r_[True, flat[1:] != flat[:-1]])
    size = np.diff(np.r_[first, len(flat)])
    total = np.take(values, order[first], axis=0)
    some = np.flatnonzero((size > 1) & (size <= short))
    for k in range(1, short):
        some = some[size[some] > k]
        if not len(some):
            break
        total[some] += np.take(values, order[first[some] + k], axis=0)
    for i in np.flatnonzero(size > short).tolist():
        total[i] = np.take(values, order[first[i] : first[i] + size[i]], axis=0).sum(axis=0)
    return flat[first].astype(np.int64), total


class Gradient:
    """Observed and expected counts of classes and of inner words by row of weights: their difference is the log likelihood's slope."""

    def __init__(self, model: Model, vocabulary: Vocabulary):
        self.model, self.vocabulary, self.tokens = model, vocabulary, 0
        self.seen = [np.zeros(w.size) for w in (model.weights, model.inner)]
        self.expected = [np.zeros(w.shape) for w in (model.weights, model.inner)]

    def add(self, codes: np.ndarray, starts: np.ndarray) -> None:
        m, back, classes = self.model, contexts(codes, starts), self.vocabulary.class_of(codes)
        rows, inside = features(back, len(m.weights)), np.flatnonzero(classes < WORD_CLASSES)
        inner = inner_features([x[inside] for x in back], classes[inside], len(m.inner))
        self.count(0, rows, classes, m.weights, np.broadcast_to(m.bias, (len(rows), len(m.bias))))
        self.count(1, inner, codes[inside] % WORDS, m.inner, m.inner_bias[classes[inside]])
        self.tokens += len(codes)

    def count(self, which: int, rows: np.ndarray, own: np.ndarray, weights: np.ndarray, bias: np.ndarray) -> None:
        if not len(rows):
            return
        width = weights.shape[1]
        np.add.at(self.seen[which], (rows * width + own[:, None]).ravel(), 1.0)
        for at in range(0, len(rows), STEP):
            some = rows[at : at + STEP]
            share, sums = raised(weights, bias[at : at + STEP], some)
            share /= sums[:, None]
            touched, total = row_sums(some, share)
            self.expected[which][touched] += total


def logs_of(model: Model, vocabulary: Vocabulary, codes: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """log10 of each token's class given the words before, times that of the word within its class if it is one of words."""
    back, classes = contexts(codes, starts), vocabulary.class_of(codes)
    out = np.empty(len(codes))
    for at in range(0, len(codes), STEP):
        part = slice(at, at + STEP)
        now, own = [x[part] for x in back], classes[part]
        share, sums = raised(model.weights, model.bias, features(now, len(model.weights)))
        found = np.log10(np.maximum(share[np.arange(len(own)), own], 1e-38).astype(float) / sums)
        inside = np.flatnonzero(own < WORD_CLASSES)
        if len(inside):
            share, sums = raised(model.inner, model.inner_bias[own[inside]], inner_features([x[inside] for x in now], own[inside], len(model.inner)))
            found[inside] += np.log10(np.maximum(share[np.arange(len(inside)), codes[part][inside] % WORDS], 1e-38).astype(float) / sums)
        out[part] = found
    return out


def block_rows(model: Model) -> int:
    """Rows of a block of sums, of about 1 MB."""
    return max(1, (1 << 17) // (CLASSES + WORDS))


def summed(rows: DataFrame, keys: list[str], parts: int, last: bool) -> DataFrame:
    """Sums of (block, salt, data: float32 observed, then expected counts) by keys, one sum in memory at a time; at last the step of each weight."""

    def run(batches):
        at, data = None, None
        for b in batches:
            for r in b.to_pylist():
                now, new = (r["block"], 0 if last else r["salt"]), np.frombuffer(r["data"], np.float32)
                if now == at:
                    data += new
                    continue
                if at is not None:
                    yield out(at, data)
                at, data = now, new.astype(float)
        if at is not None:
            yield out(at, data)

    def out(at, data):
        if last:
            seen, expected = data.reshape(2, -1)
            data = np.log((seen + PRIOR) / (expected + PRIOR)) / DAMPING
        return pa.record_batch([pa.array([at[0]], pa.int32()), pa.array([at[1]], pa.int32()), pa.array([data.astype(np.float32).tobytes()], pa.binary())], ["block", "salt", "data"])

    return rows.repartition(parts, *keys).sortWithinPartitions(*keys).mapInArrow(run, "block int, salt int, data binary")


def grouped(batches: Iterator, size: int = 60_000) -> Iterator[tuple[np.ndarray, np.ndarray]]:
    """The codes of some texts at a time, about `size` or one long text, and where each text begins."""
    held, starts, n = [], [], 0
    for b in batches:
        for x in b.column("codes"):
            codes = np.frombuffer(x.as_buffer(), np.int32)
            held.append(codes)
            starts.append(n)
            n += len(codes)
            if n >= size:
                yield np.concatenate(held), np.array(starts)
                held, starts, n = [], [], 0
    if held:
        yield np.concatenate(held), np.array(starts)


def train(encoded: DataFrame, vocabulary: Vocabulary, model: Model) -> Model:
    """The model after ROUNDS gradient updates, each from the training texts of one share (column round): all texts, once over.

    In a round each task sums what it has observed and what the model, the same for all tasks, expects; the sums go by
    blocks of weights in two steps, streaming, and give each weight's step: its slope over the logarithmic mean of
    its observed and expected counts, damped. So partitioning changes nothing but rounding. The driver holds one
    model of at most MOST_ROWS * (CLASSES + WORDS) * 4 bytes (25 MB), which is what is broadcast; each task sends twice
    as much, so a round has two tasks a core at most.
    """
    context = encoded.sparkSession.sparkContext
    most, each = max(8, 2 * context.defaultParallelism), block_rows(model)
    salts = math.isqrt(most)
    blocks = -(-len(model.weights) // each)
    for turn in range(ROUNDS):
        shared = context.broadcast((model, vocabulary))

        def run(batches, shared=shared):
            model, vocabulary = shared.value
            own = Gradient(model, vocabulary)
            for codes, starts in grouped(batches):
                own.add(codes, starts)
            if own.tokens:
                salt = TaskContext.get().partitionId() % salts
                tables = [x.reshape(len(model.weights), -1) for pair in zip(own.seen, own.expected, strict=True) for x in pair]
                for i in range(blocks):
                    parts = [x[i * each : (i + 1) * each].astype(np.float32).ravel() for x in (tables[0], tables[2], tables[1], tables[3])]
                    data = np.concatenate(parts).tobytes()
                    yield pa.record_batch([pa.array([i], pa.int32()), pa.array([salt], pa.int32()), pa.array([data], pa.binary())], ["block", "salt", "data"])

        texts = encoded.where((F.col("round") == turn) & ~F.col("held_out")).select("codes")
        sums = texts.coalesce(most).mapInArrow(run, "block int, salt int, data binary")
        steps = summed(summed(sums, ["block", "salt"], blocks, False), ["block"], blocks, True).collect()
        weights, inner = model.weights.copy(), model.inner.copy()
        for r in steps:
            step = np.frombuffer(r["data"], np.float32)
            rows = slice(r["block"] * each, (r["block"] + 1) * each)
            n = weights[rows].shape[0]
            weights[rows] += step[: n * CLASSES].reshape(n, CLASSES)
            inner[rows] += step[n * CLASSES :].reshape(n, WORDS)
        model = Model(model.bias, model.inner_bias, weights, inner)
        shared.unpersist()
    return model


def count_words(texts: DataFrame, flush: int = 200_000) -> DataFrame:
    """(word, n) over all rows of texts; the end is the empty word. Tasks send what they have counted whenever it is `flush` words."""

    def run(batches):
        seen: Counter = Counter()
        for b in batches:
            for t in b.column("text"):
                seen.update(tokens(t.as_py()))
                if len(seen) >= flush:
                    yield out(seen)
                    seen = Counter()
        yield out(seen)

    def out(seen):
        return pa.record_batch([pa.array([w.decode() for w in seen], pa.string()), pa.array(list(seen.values()), pa.int64())], ["word", "n"])

    return texts.select("text").mapInArrow(run, "word string, n long").groupBy("word").agg(F.sum("n").alias("n"))


def build(counts: DataFrame, frequent: int = FREQUENT) -> tuple[Vocabulary, Model, np.ndarray, int, int]:
    """The vocabulary, the model before training, the suffix classes' log10 denominators, and the numbers of training tokens and of distinct ones."""
    sizes = {r[0]: (r[1], r[2]) for r in counts.groupBy(F.length(F.bin("n"))).agg(F.count("*"), F.sum("n")).collect()}
    distinct, total = sum(c for c, _ in sizes.values()), sum(n for _, n in sizes.values())
    least, held = 64, 0
    while least > 1 and held + sizes.get(least - 1, (0, 0))[0] <= frequent:
        least, held = least - 1, held + sizes.get(least - 1, (0, 0))[0]
    found = counts.where((F.length(F.bin("n")) >= least) | (F.col("word") == "")).collect()  # at most `frequent` words and the end
    top = sorted(((-r["n"], r["word"].encode()) for r in found if r["word"]))
    vocabulary = Vocabulary({w: i for i, (_, w) in enumerate(top)}, np.array([-n for n, _ in top], float), next((r["n"] for r in found if not r["word"]), 0), min(len(top), WORD_CLASSES * WORDS))
    word = F.col("word").cast("binary")
    suffix = F.when(F.length(word) < SUFFIX_BYTES, word).otherwise(F.substring(word, -SUFFIX_BYTES, SUFFIX_BYTES))
    by = counts.where("word <> ''").groupBy((F.crc32(suffix) % SUFFIXES).cast("int").alias("c")).agg(F.sum("n"), F.count("*")).collect()
    n, v = np.zeros(SUFFIXES), np.zeros(SUFFIXES)
    for r in by:
        n[r[0]], v[r[0]] = r[1], r[2]
    inner = np.zeros(WORD_CLASSES * WORDS)
    inner[: vocabulary.inner] = vocabulary.counts[: vocabulary.inner]
    for (count, w), _ in zip(top, range(vocabulary.inner), strict=False):
        n[suffix_of(w)] += count
        v[suffix_of(w)] -= 1
    slots = inner.reshape(WORD_CLASSES, WORDS)
    classes = np.r_[slots.sum(axis=1), vocabulary.ends, n] + 0.5
    shares = np.where(slots > 0, np.log(np.maximum(slots, 1) / np.maximum(slots.sum(axis=1, keepdims=True), 1)), _NONE)
    rows = int(min(MOST_ROWS, max(LEAST_ROWS, ROWS_PER_ROOT * total**0.5)))
    model = Model(np.log(classes / classes.sum()).astype(np.float32), shares.astype(np.float32), np.zeros((rows, CLASSES), np.float32), np.zeros((rows, WORDS), np.float32))
    below = np.zeros(CLASSES)
    below[WORD_CLASSES + 1 :] = np.log10(n + 0.5 * (v + 1))
    return vocabulary, model, below, total, distinct


def encode(texts: DataFrame, vocabulary: Vocabulary) -> DataFrame:
    """Each row of texts (doc_id, text, held_out, round) with a row number, its tokens' codes and counts, and its words that aren't frequent."""
    kind = texts.schema["doc_id"].dataType.simpleString()
    shared = texts.sparkSession.sparkContext.broadcast(vocabulary)

    def run(batches):
        words, row = Coder(shared.value), TaskContext.get().partitionId() << 40
        for b in batches:
            at = 0
            while at < b.num_rows:
                found, starts, i = [], [], at
                while i < b.num_rows and len(found) < 60_000:
                    starts.append(len(found))
                    found += tokens(b.column("text")[i].as_py())
                    i += 1
                codes, logs, known = words.code(found)
                ends, unknown = [*starts[1:], len(found)], np.flatnonzero(~known)
                cuts = np.searchsorted(unknown, [*starts, len(found)]).tolist()
                rest = [found[j] for j in unknown.tolist()]
                rare = [Counter(rest[j:k]) for j, k in itertools.pairwise(cuts)]
                flat = pa.array([w for r in rare for w in r], pa.binary()).cast(pa.string())
                times = pa.array([k for r in rare for k in r.values()], pa.int64())
                places = pa.array([0, *itertools.accumulate(map(len, rare))], pa.int32())
                some = b.slice(at, i - at)
                yield pa.record_batch(
                    [pa.array(np.arange(row, row + i - at)), some.column("doc_id"), some.column("held_out"), pa.array(np.array(ends) - starts), pa.array(np.add.reduceat(known.astype(np.int64), starts)),
                     pa.array(np.add.reduceat(logs, starts)), pa.array([codes[j:k].tobytes() for j, k in zip(starts, ends, strict=True)], pa.binary()),
                     pa.ListArray.from_arrays(places, pa.StructArray.from_arrays([flat, times], ["word", "n"])), some.column("round")],
                    ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "codes", "rare", "round"],
                )
                row, at = row + i - at, i

    schema = f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, codes binary, rare array<struct<word: string, n: long>>, round int"
    return texts.mapInArrow(run, schema)


def scores(docs: DataFrame, fold: int = 1, folds: int = 5, frequent: int = FREQUENT) -> DataFrame:
    """doc_id, held_out, n_tokens, n_known, train_tokens, base_score, score of every row of docs.

    Learns from rows whose crc32(doc_id as text) mod folds is not fold (a null id counts as empty). A token's
    probability is its class's, from a softmax over hashed features of the three words before it, times its own
    within the class. The commonest WORD_CLASSES * WORDS words lie in classes of words, where a softmax over hashed
    features tells them apart; the end has a class of its own; all other words lie in classes by their last bytes,
    each with (count + 0.5) / (the class's count + half of its distinct words and one), so that unseen words share 0.5 of
    a count a class. All training texts are counted and all trained on; the counts of words beyond the frequent
    ones are joined, combined by document first. Rows of weights grow as the square root of the training tokens.

    Null and empty texts are the end alone; texts of any length count whole; words of equal count rank by their bytes.
    Without training rows all counts are 0; no documents give no rows; repeated rows repeat; other columns aren't read.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold
    turn = F.pmod(F.xxhash64(F.col("doc_id"), F.col("text")), F.lit(ROUNDS)).cast("int")
    base = docs.select("doc_id", "text", held.alias("held_out"), turn.alias("round"))
    counts = saved(count_words(base.where("not held_out")), "word-counts")
    vocabulary, model, below, total, distinct = build(counts, frequent)
    encoded = saved(encode(base, vocabulary), "codes")
    if total:
        model = train(encoded, vocabulary, model)
    shared = docs.sparkSession.sparkContext.broadcast((vocabulary, model, below))

    def run(batches):
        vocabulary, model, below = shared.value
        tail = np.r_[np.zeros(vocabulary.inner), np.log10(vocabulary.counts[vocabulary.inner :] + 0.5), 0.0]
        for b in batches:
            for at in range(0, b.num_rows, 256):
                some = b.slice(at, 256)
                parts = [np.frombuffer(x.as_buffer(), np.int32) for x in some.column("codes")]
                starts = np.cumsum([0, *map(len, parts[:-1])])
                codes = np.concatenate(parts)
                own = logs_of(model, vocabulary, codes, starts)
                own += np.where(codes < len(tail), tail[np.minimum(codes, len(tail) - 1)], 0) - below[vocabulary.class_of(codes)]
                yield pa.record_batch([*(some.column(c) for c in ("row", "doc_id", "held_out", "n_tokens", "known", "logs")), pa.array(np.add.reduceat(own, starts))], ["row", "doc_id", "held_out", "n_tokens", "known", "logs", "model"])

    kind = docs.schema["doc_id"].dataType.simpleString()
    parts = encoded.select("row", "doc_id", "held_out", "n_tokens", "known", "logs", "codes").mapInArrow(run, f"row long, doc_id {kind}, held_out boolean, n_tokens long, known long, logs double, model double")
    rare = encoded.select("row", F.explode("rare").alias("r")).select("row", "r.word", "r.n")
    joined = rare.join(counts.withColumnRenamed("n", "c"), "word", "left").withColumn("c", F.coalesce("c", F.lit(0)))
    part = F.col("n") * F.log10(F.col("c") + 0.5)
    sums = joined.groupBy("row").agg(F.sum(F.when(F.col("c") > 0, F.col("n")).otherwise(0)).alias("k"), F.sum(part).alias("l"), F.sum(F.when(F.col("word") != "", part).otherwise(0.0)).alias("m"))
    out = parts.join(sums, "row", "left").na.fill({"k": 0, "l": 0.0, "m": 0.0})
    return out.select(
        "doc_id", "held_out", "n_tokens", (F.col("known") + F.col("k")).alias("n_known"), F.lit(total).cast("long").alias("train_tokens"),
        (F.col("logs") + F.col("l") - F.col("n_tokens") * F.lit(float(np.log10(total + 0.5 * (distinct + 1))))).alias("base_score"),
        (F.col("model") + F.col("m")).alias("score"),
    )
