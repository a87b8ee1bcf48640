"""Average linkage of names by the weight of the tokens they share, from the tokens alone."""

from __future__ import annotations

from collections.abc import Sequence

import numpy as np

#: Similarities are counted in whole billionths, so sums are exact and equal averages are equal.
UNIT = 1e9
#: Sums of clusters with fewer members are made anew from their members' tokens when they are asked for.
KEPT = 16


def agglomerate(sets: Sequence[np.ndarray], weight: np.ndarray, total: np.ndarray, threshold: float) -> np.ndarray:
    """For each name the first name of its cluster.

    ``sets`` holds the numbers of each name's tokens, ``weight`` the weight of each token and ``total`` that of each name
    with all of its tokens. Two names are as alike as the weight they share over the lesser total, to nine digits.
    Clusters that are each other's nearest merge while their average is at least ``threshold``; of equally near ones the
    first is nearest. Which of several such pairs merges first makes no difference, as a merged cluster is never nearer to
    a third than the nearer of its parts; so a chain is followed from any cluster to ever nearer ones until two are each
    other's nearest. It takes at most three sums over a cluster's neighbours a merge, and no pairs are held but the sums of
    clusters of KEPT members or more.
    """
    n = len(total)
    flat, of = np.concatenate([*sets, np.empty(0, np.int64)]).astype(np.int64), np.repeat(np.arange(n), [len(s) for s in sets])
    order = np.argsort(flat, kind="stable")
    holders = np.split(of[order], np.cumsum(np.bincount(flat, minlength=len(weight)))[:-1])
    least = threshold * UNIT
    label, size, open_ = np.arange(n), np.ones(n, np.int64), np.ones(n, bool)
    members, kept = {k: [k] for k in range(n)}, {}

    def alike(a: int) -> tuple[np.ndarray, np.ndarray]:
        shared = np.zeros(n)
        for t in sets[a]:
            shared[holders[t]] += weight[t]
        shared[a] = 0
        at = np.flatnonzero(shared)
        return at, np.floor(shared[at] / np.minimum(total[a], total[at]) * UNIT + 0.5).astype(np.int64)

    def sums(*clusters: int) -> tuple[np.ndarray, np.ndarray]:
        rows = [r for c in clusters for r in ([kept[c]] if c in kept else map(alike, members[c]))]
        out = np.zeros(n, np.int64)
        for at, w in rows:
            np.add.at(out, label[at], w)
        out[list(clusters)] = 0
        at = np.flatnonzero(out)
        at = at[open_[at]]
        return at, out[at]

    def nearest(a: int) -> int | None:
        at, w = sums(a)
        if a in kept:
            kept[a] = at, w
        near = w / (size[a] * size[at])
        return int(at[near.argmax()]) if at.size and near.max() >= least else None

    for start in range(n):
        chain: list[int] = []
        while chain or open_[label[start]]:
            chain = chain or [int(label[start])]
            a = chain[-1]
            b = nearest(a)
            if b is None:
                open_[a] = False
                kept.pop(a, None)
                chain.pop()
            elif chain[-2:-1] == [b]:
                del chain[-2:]
                a, b = min(a, b), max(a, b)
                if size[a] + size[b] >= KEPT:
                    both = sums(a, b)
                    kept.pop(b, None)
                    kept[a] = both
                label[members[b]] = a
                members[a] += members.pop(b)
                size[a] += size[b]
            else:
                chain.append(b)
    return label
