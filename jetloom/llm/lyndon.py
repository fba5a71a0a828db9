"""Suffix arrays by linear grouping: Lyndon-prefix groups first, the order inside them second.

Suffixes are grouped by their longest Lyndon prefix. The first phase starts from groups of equal first symbols and takes
groups in descending order: every suffix of the group in hand is one more factor of the Lyndon prefix of its previous
smaller suffix, so those suffixes move to the upper end of their own groups, by the number of factors gained. The second phase goes
through the suffixes in ascending order and emits, at the front of their groups, those whose next smaller suffix is the one in
hand; they form a chain of previous-smaller pointers. Nothing is renamed or sorted recursively.
"""

from __future__ import annotations


def suffix_array(symbols: list[int]) -> list[int]:
    """Start positions of the suffixes of ``symbols`` in ascending order; a proper prefix comes first."""
    text = [*symbols, min(symbols, default=0) - 1]  # an end marker below every symbol
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of a suffix in ``order``
    group = [0] * n  # of a suffix: first slot of its group
    size = [0] * n  # of a group, by first slot
    start = 0
    for slot, i in enumerate(order):
        if slot and text[i] != text[order[slot - 1]]:
            start = slot
        place[i], group[i] = slot, start
        size[start] += 1

    left = list(range(-1, n - 1))  # towards the previous suffix not taken yet, shortened as it is followed
    taken = [False] * n
    previous = [-1] * n
    end = n
    while end:
        first = group[order[end - 1]]
        members = order[first:end]
        for i in members:
            taken[i] = True
        gained: dict[int, int] = {}
        for i in members:
            j = left[i]
            while j >= 0 and taken[j]:
                j = left[j]
            k = i
            while left[k] != j and k >= 0 and taken[k]:
                left[k], k = j, left[k]
            previous[i] = j
            if j >= 0:
                gained[j] = gained.get(j, 0) + 1
        touched: dict[int, dict[int, list[int]]] = {}
        for j, factors in gained.items():
            touched.setdefault(group[j], {}).setdefault(factors, []).append(j)
        for old, by_factors in touched.items():
            for factors in sorted(by_factors, reverse=True):
                chosen = by_factors[factors]
                if len(chosen) == size[old]:
                    break  # the whole rest of the group: it stays where it is
                size[old] -= len(chosen)
                fresh = old + size[old]
                slot = fresh + len(chosen)
                for j in chosen:
                    slot -= 1
                    other, at = order[slot], place[j]
                    order[at], order[slot] = other, j
                    place[other], place[j] = at, slot
                    group[j] = fresh
                size[fresh] = len(chosen)
        end = first

    front = list(range(n))  # next free slot of a group, by first slot
    result = [-1] * n
    placed = [False] * n
    result[0] = n - 1
    placed[n - 1] = True
    for slot in range(n):
        j = result[slot] - 1
        while j >= 0 and not placed[j]:
            placed[j] = True
            result[front[group[j]]] = j
            front[group[j]] += 1
            j = previous[j]
    return result[1:]


def common_prefixes(symbols: list[int], suffixes: list[int]) -> list[int]:
    """Length of the common prefix of each suffix in order with the one before it (0 for the first)."""
    n = len(symbols)
    rank = [0] * n
    for slot, i in enumerate(suffixes):
        rank[i] = slot
    out = [0] * n
    length = 0
    for i in range(n):
        if rank[i]:
            j = suffixes[rank[i] - 1]
            while i + length < n and j + length < n and symbols[i + length] == symbols[j + length]:
                length += 1
            out[rank[i]] = length
            length = max(0, length - 1)
        else:
            length = 0
    return out
