"""Suffix arrays of many strings at once, by linear grouping construction.

The first phase keeps the suffixes of a string in groups, ordered as the suffixes will be,
and takes the groups from the highest to the lowest. For each suffix of the current group the
pointer to the nearest earlier suffix of a lower group is followed; suffixes reached that way
are the ones whose Lyndon prefix goes on with the current group's, so they leave their group
for a higher one behind it, those reached more often above those reached less often. In the
end the groups are those of equal Lyndon prefixes. The second phase takes the groups from the
lowest to the highest and gives the suffixes of each group their final order: a placed suffix
places the suffix before it and those on that suffix's pointer chain. No string is renamed and
nothing is recursive.

One string alone would need a step of Python per group. The strings here are many and short,
so all strings of a batch take their next group in the same step, as array operations.
"""

from __future__ import annotations

import numpy as np


def _runs(counts: np.ndarray) -> np.ndarray:
    ends = np.cumsum(counts)
    return np.arange(int(ends[-1]) if len(ends) else 0) - np.repeat(ends - counts, counts)


def _spans(starts: np.ndarray, counts: np.ndarray) -> np.ndarray:
    return np.repeat(starts, counts) + _runs(counts)


def _group(text: np.ndarray, base: np.ndarray, length: np.ndarray):
    """First phase: group (its first place) of each suffix, pointer of each suffix, and size of each group by its first place."""
    n = len(text)
    string = np.repeat(np.arange(len(base)), length)
    order = np.lexsort((text, string))
    place = np.empty(n, np.int64)
    place[order] = np.arange(n)
    fresh = np.ones(n, bool)
    fresh[1:] = (text[order][1:] != text[order][:-1]) | (string[order][1:] != string[order][:-1])
    first = np.flatnonzero(fresh)
    count = np.diff(np.append(first, n))
    group = np.empty(n, np.int64)
    group[order] = np.repeat(first, count)
    size, tail = np.zeros(n, np.int64), np.zeros(n, np.int64)  # tail: first place of the group that ends at a place
    size[first] = count
    tail[first + count - 1] = first
    before = np.full(n, -1)
    chosen = np.zeros(n, bool)

    live = np.arange(len(base))
    end = base + length  # places from here on belong to groups that are done
    while len(live):
        current = tail[end[live] - 1]
        members_of = size[current]
        at = order[_spans(current, members_of)]
        level, low = np.repeat(current, members_of), np.repeat(base[live], members_of)
        back = at - 1
        todo = np.flatnonzero((back >= low) & (group[back] > level))
        while len(todo):
            back[todo] = before[back[todo]]
            todo = todo[(back[todo] >= low[todo]) & (group[back[todo]] > level[todo])]
        before[at] = back
        todo = np.flatnonzero((back >= low) & (group[back] == level))
        while len(todo):  # pointers within the group lead on to where those suffixes point
            back[todo] = before[back[todo]]
            before[at[todo]] = back[todo]
            todo = todo[(back[todo] >= low[todo]) & (group[back[todo]] == level[todo])]
        back = np.sort(back[back >= low])
        if len(back):
            new = np.ones(len(back), bool)
            new[1:] = back[1:] != back[:-1]
            edge = np.flatnonzero(new)
            reached, times = back[edge], np.diff(np.append(edge, len(back)))
            old = group[reached]
            by = np.lexsort((times, old))
            reached, times, old = reached[by], times[by], old[by]
            starts = np.flatnonzero(np.concatenate(([True], old[1:] != old[:-1])))
            leaving = np.diff(np.append(starts, len(old)))
            from_group = old[starts]
            rest = size[from_group] - leaving
            target = _spans(from_group + rest, leaving)  # the leaving suffixes go to the end of their group's places
            was = place[reached]
            chosen[reached] = True
            there = order[target]
            stay = there[~chosen[there]]
            chosen[reached] = False
            vacant = was[was < np.repeat(from_group + rest, leaving)]
            order[vacant] = stay
            place[stay] = vacant
            order[target] = reached
            place[reached] = target
            part = np.flatnonzero(np.concatenate(([True], (old[1:] != old[:-1]) | (times[1:] != times[:-1]))))
            part_size = np.diff(np.append(part, len(old)))
            label = target[part]
            size[from_group] = rest
            left = rest > 0
            tail[(from_group + rest - 1)[left]] = from_group[left]
            size[label] = part_size
            tail[label + part_size - 1] = label
            group[reached] = np.repeat(label, part_size)
        end[live] = current
        live = live[current > base[live]]
    return group, before, size


def suffix_arrays(text: np.ndarray, length: np.ndarray) -> np.ndarray:
    """For strings that stand one after the other in ``text``, their suffix arrays one after the other (places in ``text``).

    Each string must end with a symbol that is smaller than all its others and occurs once in it.
    """
    length = np.asarray(length, np.int64)
    base = np.cumsum(length) - length
    group, before, size = _group(text, base, length)
    n = len(text)
    out = np.full(n, -1)
    placed = np.zeros(n, bool)
    filled = np.zeros(n, np.int64)  # suffixes placed so far, by group
    last = base + length - 1
    out[base], placed[last] = last, True
    filled[base] = 1
    current, head = base.copy(), base.copy()
    live = np.arange(len(base))
    while len(live):
        g = current[live]
        n_new = g + filled[g] - head[live]
        at = out[_spans(head[live], n_new)]
        low = np.repeat(base[live], n_new)
        head[live] = g + filled[g]
        step, found, rank = at - 1, [], []
        todo = np.flatnonzero(step >= low)
        todo = todo[~placed[step[todo]]]
        while len(todo):
            s = step[todo]
            found.append(s)
            rank.append(todo)
            placed[s] = True
            step[todo] = before[s]
            todo = todo[step[todo] >= low[todo]]
            todo = todo[~placed[step[todo]]]
        if found:
            s, k = (np.concatenate(found), np.concatenate(rank)) if len(found) > 1 else (found[0], rank[0])
            to = group[s]
            by = np.lexsort((k, to))
            s, to = s[by], to[by]
            starts = np.flatnonzero(np.concatenate(([True], to[1:] != to[:-1])))
            count = np.diff(np.append(starts, len(to)))
            out[_spans(to[starts] + filled[to[starts]], count)] = s
            filled[to[starts]] += count
        full = head[live] == g + size[g]
        current[live[full]] = (g + size[g])[full]
        live = live[head[live] < base[live] + length[live]]
    return out
