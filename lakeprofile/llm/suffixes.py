"""Suffix arrays by grouping, without recursion or renaming.

Suffixes are grouped by their Lyndon prefix, the longest Lyndon word they start with. At first only its first symbol is known.
Groups are taken in descending order. For each suffix of the group taken, the pointer to the nearest suffix on its left in a
smaller group tells whose prefix it continues; those suffixes move into new groups right behind their old ones, further the
more often they are continued. When all groups have been taken, each holds the suffixes of one Lyndon prefix, and the order
inside is emitted in one ascending sweep: what stands on the left of a finished suffix, along the same pointers, is next in
its group. Each suffix is looked at a bounded number of times on average.
"""

from __future__ import annotations

from collections import Counter


def suffix_array(text: bytes | str) -> list[int]:
    """The starts of the suffixes of ``text`` in ascending order; an end of the text sorts before every symbol."""
    n = len(text)
    order = sorted(range(n), key=text.__getitem__)
    where, group, size = [0] * n, [0] * n, [0] * n  # place of a suffix, first place of its group, length of the group there
    first = 0
    for place, i in enumerate(order):
        if text[i] != text[order[first]]:
            first = place
        where[i], group[i] = place, first
        size[first] += 1
    left = [-1] * n  # nearest suffix on the left in a smaller group

    end = n
    while end:
        first = group[order[end - 1]]
        if end - first == 1:
            i = order[first]
            j = i - 1
            while j >= 0 and group[j] >= first:
                j = left[j]
            left[i] = j
            if j >= 0:
                old = group[j]
                size[old] -= 1
                new = old + size[old]
                if size[old]:
                    other, place = order[new], where[j]
                    order[place], where[other] = other, place
                    order[new], where[j] = j, new
                group[j] = new
                size[new] = 1
        else:
            continued: list[int] = []
            for i in sorted(order[first:end]):
                j = i - 1
                while j >= 0 and group[j] >= first:
                    j = left[j]
                left[i] = j
                if j >= 0:
                    continued.append(j)
            times = Counter(continued)
            for number in sorted(set(times.values()), reverse=True):
                moved = [j for j in times if times[j] == number]
                for j in moved:
                    old = group[j]
                    size[old] -= 1
                    new = old + size[old]
                    other, place = order[new], where[j]
                    order[place], where[other] = other, place
                    order[new], where[j] = j, new
                starts = [group[j] + size[group[j]] for j in moved]
                for j, new in zip(moved, starts):
                    group[j] = new
                    size[new] += 1
        end = first

    free = list(range(n))  # next free place of the group that starts there
    done = [False] * n
    out = [0] * n

    def emit(j: int) -> None:
        while j >= 0 and not done[j]:
            at = group[j]
            out[free[at]] = j
            free[at] += 1
            done[j] = True
            j = left[j]

    emit(n - 1)
    for place in range(n):
        emit(out[place] - 1)
    return out
