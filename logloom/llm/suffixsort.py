"""Suffix array of a sequence of numbers by grouping.

First, suffixes are grouped by their Lyndon prefix. Groups start as the first
symbols and are processed from the greatest down; a suffix's previous-smaller
pointer leads to the nearest suffix before it in a lower group, and the
suffixes pointed at leave their groups for new ones right behind, those pointed
at more often further behind. Then one pass over the growing suffix array emits
each group's order: every suffix placed puts the chain of previous-smaller
pointers before it at the fronts of their groups. Nothing is renamed or sorted
recursively. The groups are linear work, but first symbols, members and counts are
put in order by comparison sorts, so the whole takes n log n steps at worst.
"""

from __future__ import annotations


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` in lexicographic order. The last symbol
    must be smaller than all others and occur once."""
    n = len(text)
    if n < 2:
        return list(range(n))
    order = sorted(range(n), key=text.__getitem__)
    place = [0] * n  # of a suffix in ``order``
    group = [0] * n  # first place of a suffix's group
    end = [0] * n  # by first place: last place of the group
    first = 0
    for i, s in enumerate(order):
        if text[s] != text[order[first]]:
            first = i
        place[s], group[s], end[first] = i, first, i
    back = [-1] * n  # previous-smaller pointers
    last = n - 1
    while last >= 0:
        lo = group[order[last]]
        count: dict[int, int] = {}
        members = order[lo : last + 1]
        if len(members) > 1:
            members.sort()
        for s in members:
            j = s - 1
            # suffixes of this group met on the way are done, as s ascends
            while j >= 0 and group[j] >= lo:
                j = back[j]
            back[s] = j
            if j >= 0:
                count[j] = count.get(j, 0) + 1
        if count:
            by_count: dict[int, list[int]] = {}
            for j, c in count.items():
                by_count.setdefault(c, []).append(j)
            for c in sorted(by_count, reverse=True):
                # the places at each group's end go to those pointed at c times
                split: dict[int, list[int]] = {}
                for j in by_count[c]:
                    split.setdefault(group[j], []).append(j)
                for g, moved in split.items():
                    e = end[g]
                    if e - g + 1 == len(moved):
                        continue  # the whole group: it stays
                    new = e - len(moved) + 1
                    at = e
                    for j in moved:
                        p, other = place[j], order[at]
                        order[p], place[other] = other, p
                        order[at], place[j] = j, at
                        group[j] = new
                        at -= 1
                    end[g], end[new] = new - 1, e
        last = lo - 1
    out = [-1] * n
    front = list(range(n))  # by first place of a group: its next free place
    done = bytearray(n)
    out[0], done[n - 1] = n - 1, 1
    front[group[n - 1]] += 1
    for i in range(n):
        j = out[i] - 1
        while j >= 0 and not done[j]:
            g = group[j]
            out[front[g]] = j
            front[g] += 1
            done[j] = 1
            j = back[j]
    return out
