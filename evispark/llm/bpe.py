"""SentencePiece merge-type encoding by backtracking, and decoding, from the library's model files."""

from __future__ import annotations

import functools
import hashlib
import itertools
import re
import struct
from collections.abc import Iterator

import ahocorasick
import pyarrow as pa
from pyspark.sql import DataFrame

#: Piece types in a model file (fixed values).
NORMAL, UNKNOWN, CONTROL, BYTE = 1, 2, 3, 6
SPACE = "▁"
UNKNOWN_SURFACE = " ⁇ "


def fields(data: bytes) -> Iterator[tuple[int, int | bytes]]:
    """(number, value) of a protocol buffer message's fields: an int for varints, else bytes."""
    at = 0

    def varint() -> int:
        nonlocal at
        value = shift = 0
        while True:
            byte = data[at]
            at += 1
            value |= (byte & 127) << shift
            shift += 7
            if byte < 128:
                return value

    while at < len(data):
        key = varint()
        if key & 7 == 0:
            yield key >> 3, varint()
            continue
        size = {1: 8, 5: 4}.get(key & 7) or varint()
        yield key >> 3, data[at : at + size]
        at += size


class Model:
    """Encodes and decodes as the library does for models of merge type with the identity normalizer.

    Other models (a character map, removal of extra spaces, pieces set by users, other algorithms) raise ValueError.
    Merging joins the neighbours whose joint piece has the best score, the leftmost first. A row of pieces is the
    result of merging exactly if each two neighbours, taken alone, merge to themselves. So from the left, the longest
    matching piece that is compatible with the one before it is taken; where none is, the position is noted as failed
    (no other way leads to it, as each prefix has one encoding) and the piece before it gives way to a shorter one.
    """

    def __init__(self, data: bytes, memo: int = 300_000, pair_memo: int = 1_000_000):
        self.scores: dict[str, float] = {}
        self.ids: dict[str, int] = {}
        self.bytes: dict[int, int] = {}
        self.surface: list[bytes] = []
        self.controls: set[int] = set()
        self.unknown = self.end = -1
        normalizer, trainer = {}, {}
        for number, value in fields(data):
            if number == 1:
                piece = dict(fields(value))
                text, kind, i = piece.get(1, b"").decode(), piece.get(3, NORMAL), len(self.surface)
                surface = text.replace(SPACE, " ").encode()
                if kind == NORMAL:
                    self.ids[text], self.scores[text] = i, struct.unpack("<f", piece.get(2, b"\0\0\0\0"))[0]
                elif kind == BYTE:
                    self.bytes[int(text[1:-1], 16)] = i
                    surface = bytes([int(text[1:-1], 16)])
                elif kind == CONTROL:
                    surface = b""
                    self.controls.add(i)
                    self.end = i if text == "</s>" else self.end
                elif kind == UNKNOWN:
                    surface, self.unknown = UNKNOWN_SURFACE.encode(), i
                else:
                    raise ValueError(f"piece {i} has the unsupported type {kind}")
                self.surface.append(surface)
            elif number == 2:
                trainer = dict(fields(value))
            elif number == 3:
                normalizer = dict(fields(value))
        if trainer.get(3, 1) != 2 or normalizer.get(2) or normalizer.get(4, 1) or not normalizer.get(5, 1) or trainer.get(24):
            raise ValueError("only merge-type models with the identity normalizer that keep extra spaces are supported")
        self.prefix = bool(normalizer.get(3, 1))
        self.automaton = ahocorasick.Automaton()
        for text in self.ids:
            self.automaton.add_word(text, text)
        self.automaton.make_automaton()
        long = [p for p in self.ids if len(p) > 1]
        # Where no piece holds two characters side by side, no merge crosses between them.
        alone = "\n" if not any("\n" in p for p in long) else ""
        spaced = not any(SPACE in p.lstrip(SPACE) for p in long)
        self.chunk = re.compile(f"{SPACE}*[^{SPACE}{alone}]+|{SPACE}+" + ("|\n" if alone else "")) if spaced else re.compile(".+", re.DOTALL)
        self.letters = {p for p in self.ids if len(p) == 1}
        self.memo: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.older: dict[str, tuple[tuple[int, ...], str, bytes]] = {}
        self.pairs: dict[str, dict[str, bool]] = {}
        self.paired = 0
        self.wholes: dict[str, bool] = {}
        self.spines: tuple[dict, dict] = ({}, {})
        self.ordered = True
        self.memo_size, self.pair_size = memo, pair_memo

    def remerge(self, text: str, stop: int = 1) -> list[str]:
        """Plain merging of the characters of a short text, to `stop` parts at least."""
        parts, scores = list(text), self.scores
        while len(parts) > stop:
            best = max(((scores[j], -i) for i, j in enumerate(map("".join, zip(parts, parts[1:], strict=False))) if j in scores), default=None)
            if best is None:
                break
            parts[-best[1] : 2 - best[1]] = ["".join(parts[-best[1] : 2 - best[1]])]
        return parts

    def spine(self, piece: str, side: int) -> list[tuple[str, float]]:
        """What stands at the piece's right (side 1) or left (0) edge as its characters merge, first to last, and each's score."""
        known = self.spines[side].get(piece)
        if known is None:
            found, parts = [piece], list(piece)
            while len(parts) > 1:
                parts = self.remerge(found[-1], stop=2)
                found.append(parts[-side])
                parts = list(parts[-side])
            known = self.spines[side][piece] = [(p, self.scores.get(p, 0.0) if len(p) > 1 else 0.0) for p in reversed(found)]
            self.ordered &= all(x >= y for (_, x), (_, y) in itertools.pairwise(known[1:]))
        return known

    def after(self, piece: str) -> dict[str, bool]:
        """What is known of the pieces that may follow this one."""
        known = self.pairs.get(piece)
        if known is None:
            known = self.pairs[piece] = {}
        return known

    def compatible(self, a: str, b: str) -> bool:
        """Whether a and b side by side merge to themselves: merging both again, no joint piece across the border ever comes first."""
        known = self.after(a).get(b)
        if known is None:
            if self.paired >= self.pair_size:
                for row in self.pairs.values():
                    row.clear()
                self.paired = 0
            known = self.after(a)[b] = self.merges_apart(a, b)
            self.paired += 1
        return known

    def merges_apart(self, a: str, b: str) -> bool:
        if not (self.whole(a) and self.whole(b)):
            return False
        left, right = self.spine(a, 1), self.spine(b, 0)
        if not self.ordered:  # parts that score below their whole merge in no fixed order
            return self.remerge(a + b) == [a, b]
        i = j = 0
        while True:
            joint = self.scores.get(left[i][0] + right[j][0])
            more_left = left[i + 1][1] if i + 1 < len(left) else None
            more_right = right[j + 1][1] if j + 1 < len(right) else None
            # of equal scores the leftmost merges first
            if joint is not None and (more_left is None or joint > more_left) and (more_right is None or joint >= more_right):
                return False
            if more_left is None and more_right is None:
                return True
            if more_right is None or more_left is not None and more_left >= more_right:
                i += 1
            else:
                j += 1

    def whole(self, piece: str) -> bool:
        """Whether merging the piece's characters gives the piece."""
        known = self.wholes.get(piece)
        if known is None:
            known = self.wholes[piece] = self.remerge(piece) == [piece]
        return known

    def split(self, text: str) -> list[str]:
        """The pieces of a normalized text; characters without a piece stand for themselves."""
        starts: list[list[str]] = [[] for _ in text]
        for end, piece in self.automaton.iter(text):
            starts[end - len(piece) + 1].append(piece)
        if not self.letters.issuperset(text):
            for i, c in enumerate(text):
                if c not in self.letters:
                    starts[i].insert(0, c)  # matches come by their end, so a start's are in order of size
        failed, some, size = bytearray(len(text) // 8 + 1), False, len(text)
        parts: list[str] = []
        tried: list[int] = []
        pairs = self.pairs
        at, choice, fits = 0, len(starts[0]) if text else 0, self.wholes
        while at < size:
            options = starts[at]
            while choice:
                choice -= 1
                piece = options[choice]
                if some and failed[(end := at + len(piece)) >> 3] >> (end & 7) & 1:
                    continue
                fit = fits.get(piece)
                if fit is None:
                    fit = self.compatible(parts[-1], piece) if parts else self.whole(piece)
                if fit:
                    parts.append(piece)
                    tried.append(choice)
                    at += len(piece)
                    choice, fits = len(starts[at]) if at < size else 0, pairs.get(piece) or self.after(piece)
                    break
            else:
                failed[at >> 3] |= 1 << (at & 7)
                some = True
                at -= len(parts.pop())
                choice, fits = tried.pop(), self.after(parts[-1]) if parts else self.wholes
        return parts

    def chunk_of(self, chunk: str) -> tuple[tuple[int, ...], str, bytes]:
        """The chunk's ids, the same in decimals joined by a space, and their surfaces."""
        known = self.memo.get(chunk) or self.older.get(chunk)
        if known is None:
            found: list[int] = []
            for piece in self.split(chunk):
                if piece in self.ids:
                    found.append(self.ids[piece])
                elif self.bytes:
                    found += [self.bytes[b] for b in piece.encode()]
                else:
                    found.append(self.unknown)
            known = tuple(found), " ".join(map(str, found)), b"".join(map(self.surface.__getitem__, found))
        if len(chunk) <= 64:
            if len(self.memo) >= self.memo_size:  # what is still in use comes back from the older half
                self.older, self.memo = self.memo, {}
            self.memo[chunk] = known
        return known

    def chunks(self, text: str) -> list[tuple[tuple[int, ...], str, bytes]]:
        """chunk_of each chunk of a whole text."""
        if not text:
            return []
        plain = ((SPACE if self.prefix else "") + text).replace(" ", SPACE)
        known, slow = self.memo.get, self.chunk_of
        return [known(chunk) or slow(chunk) for chunk in self.chunk.findall(plain)]

    def encode(self, text: str, end: bool = False) -> list[int]:
        """The ids of a whole text, and the end id if asked for; an empty text has no others."""
        found = list(itertools.chain.from_iterable(ids for ids, _, _ in self.chunks(text)))
        if end:
            found.append(self.end)
        return found

    def decode(self, ids: list[int]) -> str:
        """The text of ids: without the leading space that encoding adds; bytes that aren't UTF-8 each give U+FFFD."""
        runs, control = [[]], self.controls
        if control.isdisjoint(ids[:-1]):
            runs[0] = ids[:-1] if ids and ids[-1] in control else ids
        else:  # bytes on both sides of a control id are no character
            for i in ids:
                if i in control:
                    runs.append([])
                else:
                    runs[-1].append(i)
        raws = [b"".join(map(self.surface.__getitem__, run)) for run in runs]
        lead = next((i for i, run in enumerate(runs) if run), None)
        if lead is not None:
            raws[lead] = self.led(raws[lead], runs[lead][0])
        return "".join(map(readable, raws))

    def led(self, raw: bytes, first: int) -> bytes:
        """The bytes of ids that begin with `first`, without the space that encoding adds."""
        return raw[1:] if self.prefix and raw[:1] == b" " and first not in (self.bytes.get(32), self.unknown) else raw

    def decode_chunks(self, chunks: list[tuple[tuple[int, ...], str, bytes]]) -> str:
        """decode() of the ids of chunks() and the end id, from what is known of each chunk; none of their ids is a control's."""
        raw = b"".join([surface for _, _, surface in chunks])
        return readable(self.led(raw, chunks[0][0][0])) if chunks else ""


@functools.lru_cache(maxsize=2)
def model_of(data: bytes) -> Model:
    """One model for all tasks of a worker."""
    return Model(data)


def readable(raw: bytes) -> str:
    try:
        return raw.decode()
    except UnicodeDecodeError:
        return "".join(lenient(raw))


def lenient(raw: bytes) -> Iterator[str]:
    at = 0
    while at < len(raw):
        for size in (1, 2, 3, 4):
            try:
                yield raw[at : at + size].decode()
                at += size
                break
            except UnicodeDecodeError:
                continue
        else:
            yield "�"
            at += 1


def encode_texts(docs: DataFrame, model_path: str, with_ids: bool = False) -> DataFrame:
    """doc_id, n_tokens, ids_sha256, decoded_sha256 (and token_ids) of every whole text, with an end id.

    The model file is read on the driver and sent to the executors (its size is fixed). Null counts as empty: the end
    id alone, decoded to nothing. Each row is handled by itself, so repeated rows repeat; a task holds a batch of texts
    and one text's ids. Words' encodings are remembered up to a fixed number. Other columns aren't read.
    """
    with open(model_path, "rb") as file:
        model_bytes = docs.sparkSession.sparkContext.broadcast(file.read())

    def run(batches):
        model = model_of(model_bytes.value)
        for batch in batches:
            for b in (batch.slice(i, 256) for i in range(0, batch.num_rows, 256)):
                sizes, digests, decoded, all_ids = [], [], [], []
                for t in b.column("text"):
                    chunks = model.chunks(t.as_py() or "")
                    sizes.append(sum([len(ids) for ids, _, _ in chunks]) + 1)
                    digests.append(hashlib.sha256(" ".join([*(x for _, x, _ in chunks), str(model.end)]).encode()).hexdigest())
                    decoded.append(hashlib.sha256(model.decode_chunks(chunks).encode()).hexdigest())
                    if with_ids:
                        all_ids.append(pa.array([*itertools.chain.from_iterable(ids for ids, _, _ in chunks), model.end], pa.int32()))
                cols = [b.column("doc_id"), pa.array(sizes, pa.int64()), pa.array(digests), pa.array(decoded)]
                names = ["doc_id", "n_tokens", "ids_sha256", "decoded_sha256"]
                if with_ids:
                    offsets = pa.array([0, *itertools.accumulate(sizes)], pa.int32())
                    cols.append(pa.ListArray.from_arrays(offsets, pa.concat_arrays(all_ids) if all_ids else pa.array([], pa.int32())))
                    names.append("token_ids")
                yield pa.record_batch(cols, names)

    kind = docs.schema["doc_id"].dataType.simpleString()
    schema = f"doc_id {kind}, n_tokens long, ids_sha256 string, decoded_sha256 string" + ", token_ids array<int>" * with_ids
    return docs.select("doc_id", "text").mapInArrow(run, schema)
