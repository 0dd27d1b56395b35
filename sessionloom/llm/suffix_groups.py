"""Suffix arrays by linear grouping, and what of a block of strings repeats.

Suffixes are first put into groups by their Lyndon prefixes, the groups being
taken in descending order: the members of a group lengthen the prefixes of the
positions their previous-smaller pointers lead to, which splits the groups of
those.  Then one sweep over the order found so far emits every group's order.
No step renames and sorts again what it has sorted.
"""

from __future__ import annotations

import numpy as np

#: Ends each string of a block; it occurs in no UTF-8 text.
END = 0xFF
#: Phrases of a block are about so long, and few of them longer than :data:`LONG`.
PHRASE, LONG = 8, 128


def suffix_array(symbols: list[int]) -> list[int]:
    """Positions of ``symbols`` (integers) by the order of their suffixes; a shorter one comes before those it begins."""
    n = len(symbols)
    first: dict[int, list[int]] = {}
    for at, x in enumerate(symbols, 1):  # positions from 1, so that 0 ends every way back
        first.setdefault(x, []).append(at)
    # groups in a doubly linked list, the next smaller one below
    members = [[0], *(first[x] for x in sorted(first))]
    below, above = list(range(-1, len(members) - 1)), list(range(1, len(members) + 1))
    group = [0] * (n + 1)
    for g, own in enumerate(members):
        for at in own:
            group[at] = g
    done, smaller = bytearray(n + 1), [0] * (n + 1)
    descending: list[tuple[int, list[int]]] = []
    g = len(members) - 1
    while g:
        own = members[g]
        if len(own) > 1:
            own = [at for at in own if group[at] == g]
            own.sort()
        elif own and group[own[0]] != g:
            own = []
        if own:
            descending.append((g, own))
            for at in own:
                done[at] = 1
            times: dict[int, int] = {}
            for at in own:
                p = at - 1
                while done[p]:
                    p = smaller[p]
                smaller[at] = p
                times[p] = times.get(p, 0) + 1
            times.pop(0, None)
            moved: dict[tuple[int, int], list[int]] = {}
            for p, k in times.items():
                moved.setdefault((group[p], k), []).append(p)
            # right above the group they leave, those that gained more of this prefix higher
            for (old, _), those in sorted(moved.items(), reverse=True) if len(moved) > 1 else moved.items():
                if len(those) == len(members[old]):
                    continue  # the whole group, which stays where it is
                new, over = len(members), above[old]
                members.append(those)
                below.append(old)
                above.append(over)
                below[over], above[old] = new, new
                for p in those:
                    group[p] = new
        g = below[g]
    # where the next suffix of each group goes
    start, at = [0] * len(members), 0
    for g, own in reversed(descending):
        start[g] = at
        at += len(own)
    order, placed = [0] * n, bytearray(n + 1)
    placed[0] = 1
    p = n
    for k in range(-1, n):
        if k >= 0:
            p = order[k] - 1
        while not placed[p]:
            g = group[p]
            order[start[g]] = p
            start[g] += 1
            placed[p] = 1
            p = smaller[p]
    return [at - 1 for at in order]


def _phrase_ends(text: np.ndarray) -> np.ndarray:
    """Which byte values end a phrase in this block.

    The end mark, the rarest byte that still is one in :data:`PHRASE` and, while
    over one byte in fifty lies in a longer phrase than :data:`LONG`, the
    commonest byte of those.
    """
    share = np.bincount(text, minlength=256) / len(text)
    ends = np.zeros(256, bool)
    ends[END] = True
    common = np.nonzero(share * PHRASE >= 1)[0]
    if len(common):
        ends[common[share[common].argmin()]] = True
    while True:
        at = np.nonzero(ends[text])[0]
        size = np.diff(at, prepend=-1)
        if size[size > LONG].sum() * 50 <= len(text):
            return ends
        inside = np.repeat(size > LONG, size)
        inside[at] = False
        ends[np.bincount(text[inside], minlength=256).argmax()] = True


def window_order(strings: list[bytes], length: int) -> tuple[np.ndarray, np.ndarray]:
    """(all strings, each with an end mark; the places where ``length`` bytes of a string begin, by the order of what begins there).

    The suffix array is built over phrases, which end with given bytes, so that
    none begins another; a place within a phrase then goes by the rest of its
    phrase and by the rank of the suffix after that.
    """
    joined = b"".join(s + b"\xff" for s in strings)
    text = np.frombuffer(joined, np.uint8)
    ends = np.nonzero(_phrase_ends(text)[text])[0] + 1
    starts = np.concatenate([[0], ends[:-1]])
    phrases = [joined[a:b] for a, b in zip(starts.tolist(), ends.tolist())]
    known = sorted(set(phrases))
    number = {x: k for k, x in enumerate(known)}
    symbols = [number[x] for x in phrases]
    rank = np.zeros(len(symbols) + 1, np.int64)
    rank[np.array(suffix_array(symbols))] = np.arange(1, len(symbols) + 1)
    # rests of the different phrases, ranked among one another
    rests = [x[k:] for x in known for k in range(len(x))]
    place = {x: k for k, x in enumerate(sorted(set(rests)))}
    rest_rank = np.fromiter(map(place.__getitem__, rests), np.int64, len(rests))
    first = np.concatenate([[0], np.cumsum([len(x) for x in known])])[np.array(symbols)]
    of = np.repeat(np.arange(len(symbols)), ends - starts)
    key = rest_rank[first[of] + np.arange(len(text)) - starts[of]] * (len(symbols) + 1) + rank[of + 1]
    left = np.repeat(np.cumsum([len(s) + 1 for s in strings]), [len(s) + 1 for s in strings]) - 1 - np.arange(len(text))
    where = np.nonzero(left >= length)[0]
    return text, where[np.argsort(key[where], kind="stable")]


def repeated(strings: list[bytes], length: int) -> list[np.ndarray]:
    """For each string, which of the ``length`` bytes long windows in it occur at another place of the block."""
    text, order = window_order(strings, length)
    padded = np.concatenate([text, np.zeros(8, np.uint8)])
    eight = padded[: len(text)].astype(np.uint64)
    for k in range(1, 8):
        eight |= padded[k : k + len(text)].astype(np.uint64) << np.uint64(8 * k)
    a, b = order[:-1], order[1:]
    same = np.arange(len(a))
    for k in [*range(0, length - 7, 8), max(0, length - 8)] if length >= 8 else []:
        same = same[eight[a[same] + k] == eight[b[same] + k]]
    if length < 8:
        same = same[[bytes(text[a[i] : a[i] + length]) == bytes(text[b[i] : b[i] + length]) for i in same.tolist()]]
    found = np.zeros(len(text), bool)
    found[a[same]] = found[b[same]] = True
    out, at = [], 0
    for s in strings:
        out.append(found[at : at + max(0, len(s) - length + 1)])
        at += len(s) + 1
    return out
