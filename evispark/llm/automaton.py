"""A generalised suffix automaton of bounded depth over many sequences, with the number of end positions of each state."""

from __future__ import annotations

from typing import NamedTuple

import numpy as np


class States(NamedTuple):
    """A state holds the sequences of lo to hi symbols that end at the same positions: `count` many, one of them `end`.

    link is the state that its suffix link leads to, that of the next shorter suffix; -1 leads to the root.
    """

    lo: np.ndarray
    hi: np.ndarray
    count: np.ndarray
    end: np.ndarray
    link: np.ndarray


def reaches(joined: np.ndarray, depth: int) -> list[np.ndarray]:
    """For each length up to depth whether a sequence of it ends at each symbol; joined: whether a symbol may follow the one before it.

    A symbol that no sequence may hold is joined to neither neighbour, and the caller leaves it out of length 1.
    """
    out = [np.ones(len(joined), bool)]
    for _ in range(depth - 1):
        more = np.zeros(len(joined), bool)
        more[1:] = out[-1][:-1] & joined[1:]
        out.append(more)
    return out


def automaton(symbols: np.ndarray, usable: np.ndarray, joined: np.ndarray, depth: int) -> States:
    """The states of all sequences of up to `depth` symbols that lie within runs of joined symbols; unusable symbols are in none.

    Suffix links make a tree in which a state's children lengthen it to the left: the tree of all reversed prefixes. It
    is built breadth-first, the node of each end position at one length from that at the length before and the symbol
    further left, by sorting; so a shard takes a few sorts rather than a step a symbol. Nodes with as many end positions
    as their only child end where it ends, and are one state with it. Transitions are not kept: no step needs them.
    """
    ends_at = reaches(joined & usable & np.r_[False, usable[:-1]], depth) if len(symbols) else []
    base = int(symbols.max(initial=0)) + 1
    node = np.full(len(symbols), -1, np.int64)
    levels, first = [], 0
    for d, ok in enumerate(ends_at, 1):
        at = np.flatnonzero(ok & usable)
        if not len(at):
            break
        key = symbols[at].astype(np.int64) if d == 1 else (node[at] - levels[-1]["first"]) * base + symbols[at - d + 1]
        order = np.argsort(key, kind="stable")
        key = key[order]
        starts = np.flatnonzero(np.r_[True, key[1:] != key[:-1]])
        count = np.diff(np.r_[starts, len(key)])
        end = at[order[starts]]
        level = {"first": first, "count": count, "end": end, "parent": node[end] if d > 1 else np.full(len(end), -1), "d": np.full(len(end), d)}
        node = np.full(len(symbols), -1, np.int64)
        node[at[order]] = np.repeat(first + np.arange(len(starts)), count)
        del key, order
        levels.append(level)
        first += len(starts)
    if not levels:
        return States(*(np.zeros(0, np.int64) for _ in range(5)))
    count, end, parent, d = (np.concatenate([x[k] for x in levels]) for k in ("count", "end", "parent", "d"))
    same = (parent >= 0) & (count == count[parent])  # one state with its parent
    lo, above = d.copy(), parent.copy()
    for level in levels[1:]:
        own = np.arange(level["first"], level["first"] + len(level["count"]))
        own = own[same[own]]
        lo[own], above[own] = lo[parent[own]], above[parent[own]]
    longest = np.ones(len(count), bool)
    longest[parent[same]] = False
    number = np.cumsum(longest) - 1
    into = np.arange(len(count))  # the longest node of each node's state
    for level in levels[:0:-1]:
        own = np.arange(level["first"], level["first"] + len(level["count"]))
        own = own[same[own]]
        into[parent[own]] = into[own]
    link = np.where(above >= 0, number[into[above]], -1)
    return States(lo[longest], d[longest], count[longest], end[longest], link[longest])
