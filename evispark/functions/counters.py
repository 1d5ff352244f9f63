"""Token counters: what counts texts' tokens and cuts a text to its first n. Objects that are sent to tasks, which call them by batches."""

from __future__ import annotations

import re
from collections.abc import Iterable, Mapping, Sequence
from typing import Protocol

import pandas as pd
from pyspark.sql import Column
from pyspark.sql import functions as F


class Counter(Protocol):
    name: str

    def counts(self, texts: Sequence[str]) -> list[int]: ...

    def cut(self, text: str, n: int) -> str: ...


class Characters:
    name = "characters"

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(t) for t in texts]

    def cut(self, text: str, n: int) -> str:
        return text[:n]


class Words:
    """Runs of anything but ASCII white space; a cut ends with its last word."""

    name = "words"
    word = re.compile(r"[^\x20\x09-\x0D]+")

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(self.word.findall(t)) for t in texts]

    def cut(self, text: str, n: int) -> str:
        end = 0
        for i, m in enumerate(self.word.finditer(text)):
            if i == n:
                break
            end = m.end()
        return text[:end]


class _Loaded:
    """A counter of a library: the file's bytes travel with it, each worker loads them once."""

    def __init__(self, name: str, data: bytes):
        self.name, self.data, self._own = name, data, None

    @classmethod
    def of(cls, path: str):
        with open(path, "rb") as f:
            return cls(path.rpartition("/")[2], f.read())

    def __getstate__(self):
        return self.__dict__ | {"_own": None}


class SentencePiece(_Loaded):
    def _library(self):
        if self._own is None:
            import sentencepiece

            self._own = sentencepiece.SentencePieceProcessor(model_proto=self.data)
        return self._own

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(x) for x in self._library().encode(list(texts), num_threads=1)]

    def cut(self, text: str, n: int) -> str:
        return self._library().decode(self._library().encode(text)[:n])


class Tokenizer(_Loaded):
    """A tokenizer file of the tokenizers library; special tokens' strings are ordinary text and none are added."""

    def _library(self):
        if self._own is None:
            import tokenizers

            self._own = tokenizers.Tokenizer.from_str(self.data.decode())
            self._own.encode_special_tokens = True
        return self._own

    def counts(self, texts: Sequence[str]) -> list[int]:
        return [len(x.ids) for x in self._library().encode_batch(list(texts), add_special_tokens=False)]

    def cut(self, text: str, n: int) -> str:
        return self._library().decode(self._library().encode(text, add_special_tokens=False).ids[:n])


def flattened(messages: Iterable[Mapping[str, str]], answer: bool = True) -> str:
    """Messages as one text, for counters without a chat template: each role in angle brackets above its content."""
    shown = "\n".join(f"<{m['role']}>\n{m['content']}" for m in messages)
    return shown + "\n<assistant>\n" if answer else shown


def count(counter: Counter, text: Column) -> Column:
    """How many tokens a column's texts have (null: none), counted in Arrow batches."""

    @F.pandas_udf("long")
    def counted(texts: pd.Series) -> pd.Series:
        return pd.Series(counter.counts([t or "" for t in texts]), dtype="int64")

    return counted(text)
