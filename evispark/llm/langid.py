"""Language identification: known words by log frequency in each language, unseen words by ever shorter character n-grams."""

from __future__ import annotations

import functools
import itertools
import re
import sys
import unicodedata
from collections import Counter

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

#: The classifier is fitted on about so many labelled documents at most (whole texts), as many of each language, chosen by a hash of their id.
FIT_DOCS = 8_000
#: Words seen so often in them are known; the longest n-grams for other words.
LEAST_SEEN, LONGEST = 2, 4
SMOOTH = 0.5


#: Runs of letters, where a text has neither marks nor numbers that Python counts as parts of words.
_PLAIN = re.compile(r"[^\W\d_]+")


@functools.cache
def letters() -> tuple[re.Pattern, re.Pattern]:
    """A letter of any script and the letters and combining marks that follow it; any mark, or number that isn't a digit."""

    def ranges(kinds: tuple[str, ...]) -> str:
        found = (c for c in range(sys.maxunicode + 1) if unicodedata.category(chr(c)).startswith(kinds))
        runs = [[c for _, c in run] for _, run in itertools.groupby(enumerate(found), lambda x: x[1] - x[0])]
        return "".join(f"\\U{run[0]:08x}-\\U{run[-1]:08x}" for run in runs)

    return re.compile(f"[{ranges(('L',))}][{ranges(('L', 'M'))}]*"), re.compile(f"[{ranges(('M', 'No', 'Nl'))}]")


def words_of(text: str | None) -> list[str]:
    """The runs of letters of a text in lower case, marks included; whatever else stands beside them ends a run."""
    small = (text or "").lower()
    whole, odd = letters()
    return _PLAIN.findall(small) if small.isascii() or not odd.search(small) else whole.findall(small)


def grams(word: str, n: int) -> list[str]:
    word = f" {word} "
    return [word[i : i + n] for i in range(len(word) - n + 1)]


class Model:
    """Log frequencies by language of the kept words and of n-grams, from rows (lang, word, count) and documents a language."""

    def __init__(self, counts: list[tuple[str, str, int]], docs: dict[str, int]):
        self.langs = sorted(docs)
        at = {x: i for i, x in enumerate(self.langs)}
        self.prior = np.log(np.array([docs[x] for x in self.langs], float) / max(1, sum(docs.values()))) if docs else np.zeros(0)
        tables: list[dict[str, list[float]]] = [{} for _ in range(LONGEST + 1)]
        for lang, word, n in counts:
            tables[0].setdefault(word, [0.0] * len(at))[at[lang]] += n
            for size in range(1, LONGEST + 1):
                for g in grams(word, size):
                    tables[size].setdefault(g, [0.0] * len(at))[at[lang]] += n
        self.tables, self.logs = [], []
        for t in tables:
            found = np.array(list(t.values()), float).reshape(len(t), len(at))
            self.tables.append({k: i for i, k in enumerate(t)})
            self.logs.append(np.log((found + SMOOTH) / (found.sum(axis=0) + SMOOTH * (len(t) + 1))))

    def word(self, word: str) -> np.ndarray:
        """The word's log frequency by language, or the mean of its known n-grams' of the greatest length that has any."""
        if (i := self.tables[0].get(word)) is not None:
            return self.logs[0][i]
        for n in range(LONGEST, 0, -1):
            if known := [i for g in grams(word, n) if (i := self.tables[n].get(g)) is not None]:
                return self.logs[n][known].mean(axis=0)
        return np.zeros(len(self.langs))

    def guess(self, scores: np.ndarray) -> tuple[str, float]:
        scores = scores + self.prior
        best = int(scores.argmax())
        return self.langs[best], float(1 / np.exp(scores - scores[best]).sum())


class Scorer(dict):
    """word -> row of `rows`; unseen words are scored as they come and remembered up to a fixed number."""

    def __init__(self, model: Model, size: int = 300_000):
        self.model, self.size = model, size
        self.rows = np.zeros((size, len(model.langs)))

    def __missing__(self, word: str) -> int:
        self.rows[len(self)] = self.model.word(word)
        self[word] = i = len(self)
        return i

    def total(self, found: list[str], step: int = 50_000) -> np.ndarray:
        out = np.zeros(len(self.model.langs))
        for at in range(0, len(found), step):
            if len(self) + step > self.size:
                self.clear()
            rows = list(map(self.__getitem__, found[at : at + step]))
            out += self.rows[rows].sum(axis=0)
        return out


def fit(rows: DataFrame, fit_docs: int = FIT_DOCS, least_seen: int = LEAST_SEEN) -> Model:
    """The model of labelled rows (doc_id, text, lang): the words seen least_seen times or more in a sample of rows come to the driver.

    The sample holds about fit_docs rows in all, fit_docs / languages (at least one) of each language that has so many,
    those with the lowest hashes of doc_id.
    """
    totals = {r[0]: r[1] for r in rows.groupBy("lang").count().collect()}
    some, each = F.pmod(F.xxhash64(F.col("doc_id").cast("string")), F.lit(1 << 20)), max(1, fit_docs // max(1, len(totals)))
    share = F.element_at(F.create_map(*(F.lit(x) for lang, n in totals.items() for x in (lang, min(1 << 20, -(-(each << 20) // n))))), F.col("lang")) if totals else F.lit(0)
    sample = rows.where(some < share).select("lang", "text")

    def run(batches):
        for b in batches:
            found: dict[str, Counter] = {}
            for lang, text in zip(b.column("lang").to_pylist(), b.column("text"), strict=True):
                found.setdefault(lang, Counter()).update(words_of(text.as_py()))
            flat = [(lang, w, n) for lang, c in found.items() for w, n in c.items()]
            yield pa.record_batch([pa.array(x, t) for x, t in zip(list(zip(*flat, strict=True)) or [[]] * 3, (pa.string(), pa.string(), pa.int64()), strict=True)], ["lang", "word", "n"])

    counts = sample.mapInArrow(run, "lang string, word string, n long").groupBy("word", "lang").agg(F.sum("n").alias("n"))
    kept = counts.groupBy("word").agg(F.collect_list(F.struct("lang", "n")).alias("by"), F.sum("n").alias("n")).where(F.col("n") >= least_seen)
    return Model(sorted((lang, r["word"], n) for r in kept.select("word", "by").collect() for lang, n in r["by"]), totals)


def identify(docs: DataFrame, fold: int = 2, folds: int = 4, **limits) -> DataFrame:
    """doc_id, held_out, lang_pred, score of every row of docs, learning from text and lang of those that aren't held out.

    Held out is where crc32(doc_id as text) mod folds is fold. A text's score is the language's posterior over the sum of
    all its words' log frequencies. Null texts and texts without a letter are `und` with score 0, as is everything where
    nothing could be learned; ties go to the first code by code point. Rows with null lang teach nothing; a null
    doc_id counts as an empty one. Repeated rows repeat; texts of any length count whole; other columns aren't read; no
    documents give no rows.
    """
    held = F.pmod(F.crc32(F.coalesce(F.col("doc_id").cast("string"), F.lit(""))), F.lit(folds)) == fold
    base = docs.select("doc_id", "text", "lang", held.alias("held_out"))
    model = fit(base.where("not held_out and lang is not null and text is not null").select("doc_id", "text", "lang"), **limits)
    shared = docs.sparkSession.sparkContext.broadcast(model)

    def run(batches):
        model = shared.value
        scorer = Scorer(model)
        for b in batches:
            guesses = []
            for t in b.column("text"):
                found = words_of(t.as_py())
                guesses.append(model.guess(scorer.total(found)) if found and model.langs else ("und", 0.0))
            langs, scores = zip(*guesses, strict=True) if guesses else ([], [])
            yield pa.record_batch([b.column("doc_id"), b.column("held_out"), pa.array(langs, pa.string()), pa.array(scores, pa.float64())], ["doc_id", "held_out", "lang_pred", "score"])

    return base.select("doc_id", "held_out", "text").mapInArrow(run, f"doc_id {docs.schema['doc_id'].dataType.simpleString()}, held_out boolean, lang_pred string, score double")
