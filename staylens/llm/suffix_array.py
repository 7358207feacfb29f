"""Suffix arrays of many short texts at once by linear grouping.

Phase 1 processes the groups of suffixes that share a Lyndon prefix in descending order. Each member
points to the nearest earlier suffix of a smaller group; suffixes pointed to equally often by one group
move together into a new group directly above the one they leave. Phase 2 walks the array in ascending
order and emits, for each suffix, the chain of pointers that ends before it into the fronts of their
groups. No suffix is renamed or sorted again. All texts advance in step, each at its own group, so every
step is a handful of array operations over all of them.
"""

from __future__ import annotations

import numpy as np


def _ranges(starts: np.ndarray, lengths: np.ndarray) -> np.ndarray:
    """Concatenated start .. start + length - 1."""
    ends = np.cumsum(lengths)
    return np.repeat(starts - (ends - lengths), lengths) + np.arange(ends[-1] if len(ends) else 0)


def lyndon_groups(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """Phase 1: for each suffix the start of its group in the array, and its previous-smaller pointer (-1: none)."""
    n = len(text)
    owner = np.repeat(np.arange(len(begin)), end - begin)
    key = owner * 512 + text
    array = np.argsort(key, kind="stable")
    place = np.empty(n, np.int64)
    place[array] = np.arange(n)
    sorted_key = key[array]
    heads = np.flatnonzero(np.concatenate(([True], sorted_key[1:] != sorted_key[:-1])))
    sizes = np.zeros(n, np.int64)
    sizes[heads] = np.diff(np.append(heads, n))
    group = np.empty(n, np.int64)
    group[array] = np.repeat(heads, sizes[heads])
    previous = np.full(n, -1, np.int64)
    chosen = np.zeros(n, bool)
    at, floor = end.copy(), begin
    while len(at):
        start = group[array[at - 1]]
        lengths = at - start
        members = array[_ranges(start, lengths)]
        own, low = np.repeat(start, lengths), np.repeat(floor, lengths)
        pointer = members - 1
        open_ = np.arange(len(members))
        while len(open_):
            p = pointer[open_]
            inside = p >= low[open_]
            open_, p = open_[inside], p[inside]
            level = group[p]
            higher = level >= own[open_]
            open_, p = open_[higher], p[higher]
            pointer[open_] = np.where(level[higher] == own[open_], p - 1, previous[p])
        pointer[pointer < low] = -1
        previous[members] = pointer
        targets, times = np.unique(pointer[pointer >= 0], return_counts=True)
        if len(targets):
            home = group[targets]
            order = np.lexsort((times, home))
            targets, times, home = targets[order], times[order], home[order]
            first = np.flatnonzero(np.concatenate(([True], home[1:] != home[:-1])))
            moved = np.diff(np.append(first, len(home)))
            bases = home[first]
            tails = bases + sizes[bases] - moved
            slots = _ranges(tails, moved)
            chosen[targets] = True
            sitting = array[slots]
            sitting = sitting[~chosen[sitting]]
            old = place[targets]
            vacated = old[old < np.repeat(tails, moved)]
            array[vacated] = sitting
            place[sitting] = vacated
            array[slots] = targets
            place[targets] = slots
            chosen[targets] = False
            sizes[bases] -= moved
            runs = np.flatnonzero(np.concatenate(([True], (home[1:] != home[:-1]) | (times[1:] != times[:-1]))))
            counts = np.diff(np.append(runs, len(home)))
            sizes[slots[runs]] = counts
            group[targets] = np.repeat(slots[runs], counts)
        going = start > floor
        at, floor = start[going], floor[going]
    return group, previous


def suffix_arrays(text: np.ndarray, begin: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Suffix arrays of the texts ``text[begin:end]``, which follow each other; every text ends in its only 0.

    Entries of a text stand at its own places and are places in ``text``. Letters are below 512.
    """
    group, previous = lyndon_groups(text, begin, end)
    n = len(text)
    result = np.full(n, -1, np.int64)
    free = np.arange(n)
    placed = np.zeros(n, bool)
    result[begin] = end - 1
    placed[end - 1] = True
    i, stop, low = begin.copy(), end, begin
    j = result[i] - 1
    while len(i):
        fresh = (j >= low) & ~placed[np.maximum(j, 0)]
        x = j[fresh]
        slot = free[group[x]]
        result[slot] = x
        free[group[x]] += 1
        placed[x] = True
        i = i + ~fresh
        more = i < stop
        if not more.all():
            i, stop, low, j, fresh = i[more], stop[more], low[more], j[more], fresh[more]
        # -1 ends a chain
        j = np.where(fresh, previous[np.maximum(j, 0)], result[i] - 1)
    return result
