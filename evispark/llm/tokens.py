"""Words of whole texts as numbers, found by a table of bytes: what separates words and lower case are ASCII, so UTF-8 stays whole."""

from __future__ import annotations

from collections.abc import Iterable, Iterator
from typing import NamedTuple

import numpy as np
import pyarrow as pa
import pyarrow.compute as pc

#: Bytes of text that are held at once, or one text.
SHARD_BYTES = 6 << 20

LOWER = np.arange(256, dtype=np.uint8)
LOWER[ord("A") : ord("Z") + 1] += 32


class Words(NamedTuple):
    """codes: the number of each word in `words`, the distinct ones in UTF-8; doc: the text it is in; fresh: whether it begins a piece."""

    codes: np.ndarray
    words: pa.Array
    doc: np.ndarray
    fresh: np.ndarray


def kinds(between: bytes, breaks: bytes = b"") -> np.ndarray:
    """A table of bytes: 1 for what is between words, 2 for what is between pieces, 0 for what words are made of."""
    out = np.zeros(256, np.uint8)
    out[list(between)] = 1
    out[list(breaks)] = 2
    return out


def shards(batches: Iterable[pa.RecordBatch], limit: int = SHARD_BYTES) -> Iterator[pa.Table]:
    """The rows of batches dealt anew: as many as hold `limit` bytes in their column text, one at least; null texts are empty."""
    held, size = [], 0
    for b in batches:
        place = b.schema.get_field_index("text")
        ends = np.cumsum(pc.binary_length(b.column(place)).fill_null(0).to_numpy(zero_copy_only=False).astype(np.int64))
        at = 0
        while at < len(b):
            before = int(ends[at - 1]) if at else 0
            to = max(at + (not held), int(np.searchsorted(ends, before + limit - size, "right")))
            if to > at:
                part = pa.Table.from_batches([b.slice(at, to - at)])
                held.append(part.set_column(place, "text", part["text"].cast(pa.large_string()).fill_null("")))
                size += int(ends[to - 1]) - before
                at = to
            if at < len(b) or size >= limit:
                yield pa.concat_tables(held).combine_chunks()
                held, size = [], 0
    if held:
        yield pa.concat_tables(held).combine_chunks()


def coded(texts: pa.ChunkedArray, kind_of: np.ndarray) -> Words:
    """The words of all texts (large strings without nulls), A-Z as a-z."""
    texts = texts.combine_chunks() if isinstance(texts, pa.ChunkedArray) else texts
    if isinstance(texts, pa.ChunkedArray):
        texts = texts.chunk(0) if texts.num_chunks else pa.array([], pa.large_string())
    _, spans, data = texts.buffers()
    offsets = np.frombuffer(spans, np.int64)[texts.offset : texts.offset + len(texts) + 1] if spans else np.zeros(1, np.int64)
    data = np.frombuffer(data, np.uint8)[offsets[0] : offsets[-1]] if data else np.zeros(0, np.uint8)
    offsets = offsets - offsets[0]
    kind = kind_of[data]
    inside = kind == 0
    begins, ends = inside.copy(), inside.copy()
    begins[1:] &= ~inside[:-1]
    ends[:-1] &= ~inside[1:]
    cuts = offsets[:-1][offsets[:-1] < len(data)]
    begins[cuts] = inside[cuts]
    ends[cuts[cuts > 0] - 1] = inside[cuts[cuts > 0] - 1]
    starts = np.flatnonzero(begins)
    sizes = np.flatnonzero(ends) - starts + 1
    letters, at = LOWER[data[inside]], np.r_[np.int64(0), np.cumsum(sizes)]
    found = pa.Array.from_buffers(pa.large_binary(), len(starts), [None, pa.py_buffer(at), pa.py_buffer(letters)]).dictionary_encode()
    before = np.searchsorted(starts, offsets)
    fresh = np.zeros(len(starts) + 1, bool)
    fresh[before] = True
    fresh[np.searchsorted(starts, np.flatnonzero(kind == 2))] = True
    return Words(found.indices.to_numpy(), found.dictionary, np.repeat(np.arange(len(texts)), np.diff(before)), fresh[:-1])
