"""Exact splits of counts: multivariate hypergeometric draws of any size."""

from __future__ import annotations

import numpy as np

LARGEST = 10**9 - 1  # numpy's limit for exact draws
TRIES = 1 << 20  # at a time


def hypergeometric(rng: np.random.Generator, good: int, bad: int, taken: int) -> int:
    """Good ones among ``taken`` without replacement.

    Beyond numpy's limit as what it is by definition: the good ones among independent draws, given that they are ``taken``
    in all. Tries are as many as the square root of the smaller side times a few, so a draw over 10^12 takes about a second.
    """
    if taken == 0 or good == 0:
        return 0
    if bad == 0:
        return taken
    total = good + bad
    if total <= LARGEST:
        return int(rng.hypergeometric(good, bad, taken))
    if 2 * taken > total:  # those left behind are fewer
        return good - hypergeometric(rng, good, bad, total - taken)
    share = taken / total
    while True:
        found = rng.binomial(good, share, TRIES)
        met = np.flatnonzero(found + rng.binomial(bad, share, TRIES) == taken)
        if len(met):
            return int(found[met[0]])


def draw(rng: np.random.Generator, colours: list[int], taken: int) -> list[int]:
    """How many of each colour are among ``taken`` ones drawn without replacement."""
    out, rest = [], sum(colours)
    for own in colours:
        rest -= own
        got = hypergeometric(rng, own, rest, taken)
        out.append(got)
        taken -= got
    return out


def even(total: int, parts: int) -> list[int]:
    """Sizes at most one apart."""
    return [total // parts + (k < total % parts) for k in range(parts)]


def split_tree(colours: list[int], leaves: list[int], seed: int) -> list[list[int]]:
    """For each leaf how many of each colour it gets: the leaves are halved again and again, each half drawn exactly."""
    rng = np.random.default_rng(seed)

    def split(own: list[int], first: int, after: int) -> list[list[int]]:
        if after - first == 1:
            return [own]
        middle = (first + after) // 2
        left = draw(rng, own, sum(leaves[first:middle]))
        return split(left, first, middle) + split([a - b for a, b in zip(own, left)], middle, after)

    return split(list(colours), 0, len(leaves))
