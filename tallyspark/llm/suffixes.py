"""Suffix arrays by induced sorting, and permuted common prefixes, on numpy arrays.

The steps are those of linear suffix sorting by induction (Nong, Zhang, Chan 2009): classify
suffixes as smaller (S) or larger (L) than their right neighbour, sort the leftmost-S
substrings, recurse on their names, and induce the order of all suffixes from theirs. Each
step works on whole arrays. Common prefixes are kept in text order (Kärkkäinen, Manzini,
Puglisi 2009): only irreducible ones are compared, the others are one less than their left
neighbour's.
"""

from __future__ import annotations

import numpy as np

#: Up to this alphabet, induction goes bucket by bucket; beyond it, along runs.
SMALL_ALPHABET = 600


def suffix_array(s: np.ndarray) -> np.ndarray:
    """Starts of the suffixes of ``s`` (integers from 0) in ascending order, the end smallest."""
    n = len(s)
    if n < 2:
        return np.arange(n)
    s = s.astype(np.int64)
    is_s = _types(s)
    lms = np.flatnonzero(is_s[1:] & ~is_s[:-1]) + 1
    if len(lms) > 1:
        names = _name(s, is_s, lms)
        order = np.argsort(names, kind="stable")
        if (names[order][1:] == names[order][:-1]).any():
            order = suffix_array(_dense(names, order))
        lms = lms[order]
    return _induce_buckets(s, is_s, lms) if s.max() < SMALL_ALPHABET else _induce_runs(s, is_s, lms)


def _types(s: np.ndarray) -> np.ndarray:
    """True where a suffix is smaller than its right neighbour."""
    n = len(s)
    rise = np.append(np.sign(s[1:] - s[:-1]), -1)
    decided = np.where(rise != 0, np.arange(n), n)
    decided = np.minimum.accumulate(decided[::-1])[::-1]
    return rise[decided] > 0


def _dense(names: np.ndarray, order: np.ndarray) -> np.ndarray:
    ranked = names[order]
    out = np.empty_like(names)
    out[order] = np.append(0, np.cumsum(ranked[1:] != ranked[:-1]))
    return out


def _refine(rank: np.ndarray, active: np.ndarray, key: np.ndarray) -> np.ndarray:
    """Split groups of equal rank by ``key``; a rank is the number of smaller entries.

    Returns the active entries whose group still has two or more.
    """
    if not len(active):
        return active
    order = np.lexsort((key, rank[active]))
    active, key = active[order], key[order]
    old = rank[active]
    at = np.arange(len(active))
    head = np.append(True, old[1:] != old[:-1])
    split = head | np.append(True, key[1:] != key[:-1])
    inside = at - np.maximum.accumulate(np.where(head, at, 0))
    rank[active] = old + np.maximum.accumulate(np.where(split, at, 0)) - (at - inside)
    alone = split & np.append(split[1:], True)
    return active[~alone]


def _name(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """Ranks of the substrings from each leftmost-S position to the next, by symbol and type."""
    n = len(s)
    length = np.append(np.diff(lms), n - lms[-1]) + 1
    bits = int(2 * s.max() + 3).bit_length()
    width = max(1, 63 // bits)
    symbols = np.zeros(n + 1 + width, dtype=np.int64)
    symbols[:n] = 2 * (s + 1) + is_s
    symbols[n] = 1
    rank = np.zeros(len(lms), dtype=np.int64)
    active, done = np.arange(len(lms)), 0
    while len(active):
        key = np.zeros(len(active), dtype=np.int64)
        left = length[active] - done
        for i in range(width):
            key = key << bits | np.where(left > i, symbols[np.minimum(lms[active] + done + i, n)], 0)
        active = _refine(rank, active, key)
        done += width
        active = active[length[active] > done]
    return rank


def _induce_buckets(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """All suffixes from the sorted leftmost-S ones, one bucket of first symbols at a time."""
    n, size = len(s), int(s.max()) + 1
    letters = s.astype(np.uint16)
    seeds = _deal(lms, letters, size)
    larger: list[list[np.ndarray]] = [[] for _ in range(size)]
    larger[s[-1]].append(np.array([n - 1]))
    for c in range(size):
        wave, parts = larger[c], []
        larger[c] = parts
        while wave:
            now = np.concatenate(wave)
            parts.append(now)
            wave = []
            _send(now, letters, ~is_s, larger, c, wave)
        _send(np.concatenate(seeds[c]) if seeds[c] else lms[:0], letters, ~is_s, larger, c, [])
    out_l = [np.concatenate(p) if p else lms[:0] for p in larger]
    smaller: list[list[np.ndarray]] = [[] for _ in range(size)]
    for c in range(size - 1, -1, -1):
        wave, parts = smaller[c], []
        smaller[c] = parts
        while wave:
            now = np.concatenate(wave)
            parts.append(now)
            wave = []
            _send(now, letters, is_s, smaller, c, wave)
        _send(out_l[c][::-1], letters, is_s, smaller, c, [])
    out = []
    for c in range(size):
        out.append(out_l[c])
        out.extend(x[::-1] for x in reversed(smaller[c]))
    return np.concatenate(out)


def _send(now, letters, wanted, buckets, c: int, same: list) -> None:
    """Left neighbours of the wanted type, in order, to their buckets; those of bucket ``c`` to ``same``."""
    before = now[now > 0] - 1
    before = before[wanted[before]]
    if not len(before):
        return
    first = letters[before]
    here = first == c
    if here.any():
        same.append(before[here])
        before, first = before[~here], first[~here]
    for d, part in _groups(before, first):
        buckets[d].append(part)


def _groups(values: np.ndarray, letters: np.ndarray):
    if not len(values):
        return
    order = np.argsort(letters, kind="stable")
    values, letters = values[order], letters[order]
    cut = np.flatnonzero(letters[1:] != letters[:-1]) + 1
    for part, d in zip(np.split(values, cut), letters[np.append(0, cut)], strict=True):
        yield int(d), part


def _deal(values: np.ndarray, letters: np.ndarray, size: int) -> list[list[np.ndarray]]:
    out: list[list[np.ndarray]] = [[] for _ in range(size)]
    for d, part in _groups(values, letters[values]):
        out[d].append(part)
    return out


def _induce_runs(s: np.ndarray, is_s: np.ndarray, lms: np.ndarray) -> np.ndarray:
    """The same for large alphabets: along each run of one type down to a suffix already placed."""
    n = len(s)
    place = np.zeros(n + 1, dtype=np.int64)
    place[lms] = np.arange(len(lms)) + 1
    value = np.append(2 * s + is_s, -1)
    known = np.zeros(n + 1, dtype=bool)
    known[lms] = True
    known[n] = True
    l_nodes = np.append(np.flatnonzero(~is_s), np.append(lms, n))
    ordered = _order_runs(l_nodes, value, place, known)
    ordered = ordered[(ordered < n)]
    ordered = ordered[~is_s[ordered]]
    place[:] = 0
    place[ordered] = np.arange(len(ordered)) + 1
    known[:] = False
    known[:n] = ~is_s
    return _order_runs(np.arange(n), value, place, known)


def _order_runs(nodes, value, place, known) -> np.ndarray:
    """Nodes by value, then by place where known, else by the order of the right neighbour."""
    rank = np.zeros(len(value), dtype=np.int64)
    active = _refine(rank, nodes, value[nodes])
    active = _refine(rank, active, place[active])
    active = active[~known[active]]
    after = np.where(known, np.arange(len(value)), np.arange(len(value)) + 1)
    after = np.minimum(after, len(value) - 1)
    while len(active):
        active = _refine(rank, active, rank[after[active]].copy())
        after = after[after]
    return nodes[np.argsort(rank[nodes], kind="stable")]


def common_prefixes(raw: np.ndarray, sa: np.ndarray, room: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """For each position, bytes in common with the suffix sorted before it.

    ``room``: bytes from a position to the end of its segment; prefixes end there.
    ``starts``: True at the first byte of a segment.
    """
    n = len(raw)
    out = np.zeros(n, dtype=np.int64)
    if n < 2:
        return out
    before = np.full(n, -1, dtype=np.int64)
    before[sa[1:]] = sa[:-1]
    usable = before >= 0
    most = np.where(usable, np.minimum(room, room[before]), 0)
    reducible = np.zeros(n, dtype=bool)
    left = np.flatnonzero((before > 0) & ~starts)
    left = left[left > 0]
    left = left[~starts[before[left]]]
    reducible[left] = raw[left - 1] == raw[before[left] - 1]
    reducible &= most > 0
    padded = np.concatenate([raw, np.zeros(8, dtype=np.uint8)])
    words = np.ndarray(shape=(n,), dtype="<u8", buffer=padded.data, strides=(1,))
    active = np.flatnonzero(~reducible & (most > 0))
    done = 0
    while len(active):
        differ = words[active + done] ^ words[before[active] + done]
        low = differ & (~differ + np.uint64(1))
        same = np.where(differ == 0, 8, (np.frexp(low.astype(np.float64))[1] - 1) // 8)
        out[active] = np.minimum(done + same, most[active])
        done += 8
        active = active[(same == 8) & (most[active] > done)]
    last = np.maximum.accumulate(np.where(reducible, 0, np.arange(n)))
    return np.where(reducible, np.maximum(out[last] - (np.arange(n) - last), 0), out)
