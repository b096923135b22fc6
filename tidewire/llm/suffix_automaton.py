"""Generalised suffix automata of bounded depth, built by array passes.

A state is a class of substrings that end at the same places.  The suffix links of the
states form the tree of the reversed texts: the children of a substring are its extensions to the
left.  That tree is grown level by level here; a substring that ends wherever its only
extension to the left ends joins the extension's state.  Sequences never run into each other.
"""

from __future__ import annotations

from dataclasses import dataclass

import numpy as np


@dataclass
class Automaton:
    """``length`` and ``shortest``: lengths of a state's longest and shortest substring; ``link``: the state of the
    longest substring that ends at more places (-1: the empty one); ``count``: how many places these are; ``end``: one of them."""

    length: np.ndarray
    shortest: np.ndarray
    link: np.ndarray
    count: np.ndarray
    end: np.ndarray

    def substrings(self) -> tuple[np.ndarray, np.ndarray]:
        """State and length of every substring: a state holds one of each length."""
        n = self.length - self.shortest + 1
        state = np.repeat(np.arange(len(n)), n)
        return state, self.shortest[state] + np.arange(len(state)) - np.repeat(np.cumsum(n) - n, n)


def grouped(keys: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """The place of one occurrence of each different key (numbers from 0), the number of its key for every place, and counts.

    Keys are sorted together with their places, in one number where both fit.
    """
    bits = max(len(keys) - 1, 1).bit_length()
    if len(keys) and int(keys.max()).bit_length() + bits < 64:
        both = np.sort(keys.astype(np.uint64) << np.uint64(bits) | np.arange(len(keys), dtype=np.uint64))
        order, keys = (both & np.uint64((1 << bits) - 1)).astype(np.int64), both >> np.uint64(bits)
    else:
        order = np.argsort(keys)
        keys = keys[order]
    new = np.ones(len(keys), bool)
    new[1:] = keys[1:] != keys[:-1]
    first = np.flatnonzero(new)
    number = np.empty(len(keys), np.int64)
    number[order] = np.cumsum(new) - 1
    return order[first], number, np.diff(np.append(first, len(keys)))


def build(symbols: np.ndarray, room: np.ndarray, depth: int) -> Automaton:
    """The automaton of the substrings of up to ``depth`` symbols.

    ``symbols``: numbers from 0, one sequence after another; ``room``: how many symbols of
    its own sequence are before each.
    """
    sigma = int(symbols.max(initial=0)) + 1
    place, node = np.arange(len(symbols)), np.zeros(len(symbols), np.int64)
    first = 0  # number of the level's first node
    levels: dict[str, list[np.ndarray]] = {k: [] for k in ("depth", "up", "count", "end", "shortest")}
    counts = shortest = np.zeros(0, np.int64)  # of the level above
    above = 0
    for d in range(1, depth + 1):
        keep = room[place] >= d - 1
        place, node = place[keep], node[keep]
        if not len(place):
            break
        at, own, n = grouped(node * sigma + symbols[place - d + 1])
        parent = node[at]
        same = counts[parent] == n if d > 1 else np.zeros(len(n), bool)
        start = np.where(same, shortest[parent], d) if d > 1 else np.full(len(n), 1)
        for k, v in (("depth", np.full(len(n), d)), ("up", parent + above if d > 1 else np.full(len(n), -1)), ("count", n), ("end", place[at]), ("shortest", start)):
            levels[k].append(v)
        above, first = first, first + len(n)
        counts, shortest, node = n, start, own
    x = {k: np.concatenate([*v, np.zeros(0, np.int64)]).astype(np.int64) for k, v in levels.items()}
    # a node that one of its children equals is part of that child's state
    inner = np.zeros(len(x["up"]), bool)
    child = np.flatnonzero(x["up"] >= 0)
    inner[x["up"][child[x["count"][x["up"][child]] == x["count"][child]]]] = True
    top = np.flatnonzero(~inner)
    number = np.full(len(inner) + 1, -1)
    number[top] = np.arange(len(top))
    link = top.copy()
    while len(climb := np.flatnonzero((link >= 0) & (x["depth"][link] >= x["shortest"][top]))):
        link[climb] = x["up"][link[climb]]
    return Automaton(x["depth"][top], x["shortest"][top], number[link], x["count"][top], x["end"][top])
