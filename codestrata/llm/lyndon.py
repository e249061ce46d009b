"""Suffix array by Lyndon-prefix groups, without recursion and without renaming."""

import numpy as np

UNSET = -2


def suffix_array(text: list[int]) -> list[int]:
    """Suffix array of whole numbers whose last one is smaller than all others.

    First part: suffixes are grouped by their first symbol and the groups are taken from the largest to the
    smallest. Each suffix of a group points to the nearest suffix before it in a smaller group. What
    is pointed to has the group's prefix behind its own, as often as it is pointed to; so it leaves its group for a
    new one right above, the more pointers the higher. In the end each group holds the suffixes with one
    longest Lyndon prefix, and the pointers lead to previous smaller suffixes.

    Second part: the suffixes are emitted in order. Each one emitted puts the suffix before it, and those along
    the pointers from there, at the next free place of their groups, up to one that has its place.
    """
    n = len(text)
    symbols = np.asarray(text)
    order = np.argsort(symbols, kind="stable")
    cuts = np.nonzero(np.diff(symbols[order]))[0] + 1
    members = [part.tolist() for part in np.split(order, cuts)]
    group = np.repeat(np.arange(len(members)), np.diff(np.concatenate(([0], cuts, [n]))))
    group_of = np.empty(n, np.int64)
    group_of[order] = group
    group_of = group_of.tolist()
    below = list(range(-1, len(members) - 1))
    above = list(range(1, len(members))) + [-1]
    smaller = [UNSET] * n
    start = [0] * len(members)
    place = n
    g = len(members) - 1
    while g >= 0:
        own = [i for i in members[g] if group_of[i] == g]
        members[g] = None
        place -= len(own)
        start[g] = place
        targets: list[int] = []
        times: list[int] = []
        last = -1
        for i in own:
            p = i - 1
            while p >= 0 and (q := smaller[p]) != UNSET:
                p = q
            smaller[i] = p
            if p >= 0:
                if p == last:  # pointers of rising suffixes never fall
                    times[-1] += 1
                else:
                    targets.append(p)
                    times.append(1)
                    last = p
        for m in sorted(set(times), reverse=True) if targets else ():
            fresh: dict[int, int] = {}
            for p, t in zip(targets, times):
                if t != m:
                    continue
                k = group_of[p]
                new = fresh.get(k)
                if new is None:
                    new = fresh[k] = len(members)
                    members.append([p])
                    start.append(0)
                    up = above[k]
                    below.append(k)
                    above.append(up)
                    above[k] = new
                    below[up] = new  # the group at hand stands above, so there is one
                else:
                    members[new].append(p)
                group_of[p] = new
        g = below[g]
    result = [0] * n
    open_ = [True] * n
    result[0] = n - 1
    open_[n - 1] = False
    start[group_of[n - 1]] = 1
    for i in range(n):
        s = result[i] - 1
        while s >= 0 and open_[s]:
            k = group_of[s]
            at = start[k]
            result[at] = s
            start[k] = at + 1
            open_[s] = False
            s = smaller[s]
    return result
