"""Counting quotient filters: fingerprints of a fixed width, each with its count, in slots whose places hold the upper bits."""

from __future__ import annotations

import struct

import numpy as np

#: A slot below this is a digit (base 256) of the count of the remainder before it; remainders are stored from here on.
BASE = 256
_HEAD = struct.Struct("<BQQ")


def distinct(fingerprints: np.ndarray, counts: np.ndarray | None = None) -> tuple[np.ndarray, np.ndarray]:
    """Sorted distinct fingerprints and how often each occurs; what is sorted in parts is merged."""
    order = np.argsort(fingerprints, kind="stable")
    fingerprints = fingerprints[order]
    starts = np.flatnonzero(np.r_[True, fingerprints[1:] != fingerprints[:-1]][: len(fingerprints)])
    counts = np.ones(len(order), np.int64) if counts is None else counts[order]
    return fingerprints[starts], np.add.reduceat(counts, starts) if len(starts) else counts


def build(fingerprints: np.ndarray, counts: np.ndarray, width: int) -> bytes:
    """A filter of sorted distinct fingerprints of `width` bits, uint64, and their counts, 1 or more.

    The upper bits of a fingerprint, its quotient, are its home slot; the lower ones, its remainder, are kept in the run
    of that quotient, which begins at home or right after the run before it. One bit a quotient says whether it has a
    run, one bit a slot whether a run ends there. Remainders ascend within a run; of a count c above 1 the digits of
    c - 1 follow its remainder. Quotients are as many as leave at least a tenth of the home slots free.
    """
    n = len(fingerprints)
    extra, left = np.zeros(n, np.int64), counts - 1
    while left.any():
        extra += left > 0
        left = left >> 8
    sizes = extra + 1
    total = int(sizes.sum())
    quotient_bits = min(width, max(0, (total + total // 9).bit_length()))
    remainder_bits = width - quotient_bits
    shift = np.uint64(remainder_bits)
    quotient = (fingerprints >> shift).astype(np.int64) if remainder_bits < 64 else np.zeros(n, np.int64)
    remainder = fingerprints & np.uint64((1 << remainder_bits) - 1)
    first = np.cumsum(sizes) - sizes
    at = first + np.maximum.accumulate(quotient - first) if n else first
    slots = int(at[-1] + sizes[-1]) if n else 0
    slot_bytes = ((1 << remainder_bits) - 1 + BASE).bit_length() + 7 >> 3
    if slot_bytes > 8:
        raise ValueError("remainders of at most 63 bits")
    values = np.zeros(slots, np.uint64)
    values[at] = remainder + np.uint64(BASE)
    for digit in range(int(extra.max(initial=0))):
        has = extra > digit
        values[at[has] + 1 + digit] = (counts[has] - 1 >> 8 * digit & 255).astype(np.uint64)
    occupied, ends = np.zeros(1 << quotient_bits, bool), np.zeros(slots, bool)
    occupied[quotient] = True
    ends[(at + extra)[np.flatnonzero(np.r_[quotient[1:] != quotient[:-1], True][:n])]] = True
    packed = values.astype("<u8").view(np.uint8).reshape(-1, 8)[:, :slot_bytes]
    return _HEAD.pack(quotient_bits, remainder_bits, slots) + np.packbits(occupied).tobytes() + np.packbits(ends).tobytes() + packed.tobytes()


def entries(data: bytes) -> tuple[np.ndarray, np.ndarray]:
    """The filter's fingerprints, sorted, and their counts: nothing of them is lost."""
    quotient_bits, remainder_bits, slots = _HEAD.unpack_from(data)
    sizes = ((1 << quotient_bits) + 7 >> 3, slots + 7 >> 3)
    raw = np.frombuffer(data, np.uint8)[_HEAD.size :]
    quotients = np.flatnonzero(np.unpackbits(raw[: sizes[0]])[: 1 << quotient_bits])
    ends = np.flatnonzero(np.unpackbits(raw[sizes[0] : sum(sizes)])[:slots])
    starts = np.maximum(quotients, np.r_[0, ends[:-1] + 1][: len(ends)])
    lengths = ends - starts + 1
    at = np.repeat(starts - (np.cumsum(lengths) - lengths), lengths) + np.arange(lengths.sum())  # slots in use
    packed = raw[sum(sizes) :]
    slot_bytes = len(packed) // slots if slots else 1
    wide = np.zeros((len(at), 8), np.uint8)
    wide[:, :slot_bytes] = packed.reshape(-1, slot_bytes)[at] if slots else 0
    values = wide.view("<u8").ravel()
    head = values >= BASE
    fingerprints = np.repeat(quotients, lengths)[head].astype(np.uint64) << np.uint64(remainder_bits) if remainder_bits < 64 else np.zeros(int(head.sum()), np.uint64)
    fingerprints |= values[head] - np.uint64(BASE)
    owner = np.cumsum(head) - 1
    place = np.arange(len(values)) - np.flatnonzero(head)[owner] - 1  # which digit; -1: the remainder itself
    digits = np.where(head, 0, values.astype(np.int64) << 8 * np.maximum(place, 0))
    heads = np.flatnonzero(head)
    return fingerprints, 1 + (np.add.reduceat(digits, heads) if len(heads) else digits)


def merge(filters: list[bytes], width: int) -> bytes:
    """One filter of all entries, counts added up, by going through the sorted remainders of all filters at once."""
    found = [entries(f) for f in filters]
    return build(*distinct(np.concatenate([f for f, _ in found]), np.concatenate([c for _, c in found])), width)


def count(data: bytes, fingerprint: int) -> int:
    """How often the filter holds a fingerprint, by its run: the k-th quotient in use has the k-th run's end."""
    quotient_bits, remainder_bits, slots = _HEAD.unpack_from(data)
    sizes = ((1 << quotient_bits) + 7 >> 3, slots + 7 >> 3)
    raw = np.frombuffer(data, np.uint8)[_HEAD.size :]
    occupied, ends = np.unpackbits(raw[: sizes[0]]), np.unpackbits(raw[sizes[0] : sum(sizes)])
    quotient, remainder = fingerprint >> remainder_bits, fingerprint & (1 << remainder_bits) - 1
    if not occupied[quotient]:
        return 0
    run = int(occupied[:quotient].sum())
    stops = np.flatnonzero(ends)
    start = max(quotient, int(stops[run - 1]) + 1 if run else 0)
    slot_bytes = (len(raw) - sum(sizes)) // slots
    packed = raw[sum(sizes) :].reshape(slots, slot_bytes)[start : int(stops[run]) + 1]
    seen, place = 0, -1
    for value in (int.from_bytes(x.tobytes(), "little") for x in packed):
        if value >= BASE:
            if seen:
                return seen
            seen = int(value - BASE == remainder)
            place = 0
        elif seen:
            seen += value << 8 * place
            place += 1
    return seen
