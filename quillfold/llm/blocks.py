"""Recursions over whole sequences, many blocks at a time.

A recursion that goes word by word is walked by numpy in all blocks of all sequences at once. Only a sequence's first
block knows the state it begins in; the others begin in a guess. Then each block is walked again from the state in which
the block before it ended, until it goes on as it did, which soon happens; where it never does, its end is new and the
block after it is walked again too. So the result is that of the whole sequence, whatever its length.
"""

from __future__ import annotations

from collections.abc import Callable

import numpy as np


class Blocks:
    """Sequences of these sizes cut into blocks and laid out step by step: at each step the blocks that are long enough,
    longest first. pos has the place in that layout of each element in order of the sequences."""

    def __init__(self, sizes: np.ndarray, most: int):
        number = -(-sizes // most)
        of = np.repeat(np.arange(len(sizes)), number)
        nth = np.arange(len(of)) - np.repeat(np.cumsum(number) - number, number)
        self.of, self.begins, self.ends = of, nth == 0, nth == number[of] - 1
        self.size = np.minimum(sizes[of] - nth * most, most)
        self.order = np.argsort(-self.size, kind="stable")
        self.rank = np.empty(len(of), np.int64)
        self.rank[self.order] = np.arange(len(of))
        self.live = np.searchsorted(-self.size[self.order], -np.arange(1, self.size.max(initial=0) + 1), side="right")
        self.begin = np.concatenate([[0], np.cumsum(self.live)])
        step = np.arange(int(self.size.sum())) - np.repeat(np.cumsum(self.size) - self.size, self.size)
        self.pos = self.begin[step] + np.repeat(self.rank, self.size)

    def laid(self, flat: np.ndarray) -> np.ndarray:
        out = np.empty_like(flat)
        out[self.pos] = flat
        return out

    def first(self, blocks: np.ndarray) -> np.ndarray:
        return self.rank[blocks]

    def last(self, blocks: np.ndarray) -> np.ndarray:
        return self.begin[self.size[blocks] - 1] + self.rank[blocks]


def settle(begins: np.ndarray, walk: Callable[[np.ndarray], np.ndarray]) -> None:
    """walk(blocks) walks them again from the ends of the blocks before them, and says which of them ended otherwise."""
    todo = np.flatnonzero(~begins)
    while len(todo):
        after = todo[walk(todo)] + 1
        after = after[after < len(begins)]
        todo = after[~begins[after]]


def settle_back(ends: np.ndarray, walk: Callable[[np.ndarray], np.ndarray]) -> None:
    """The same from the last block to the first."""
    top = len(ends) - 1
    settle(ends[::-1], lambda blocks: walk(top - blocks))
