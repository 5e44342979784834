"""Suffix arrays by grouping, and what they tell about strings that repeat.

``suffix_array`` sorts in two sweeps and renames nothing. The first takes groups of
suffixes from the highest to the lowest; each hands its place to the nearest
suffix before it that is of a lower group, whose known prefix grows by the group's,
so that in the end a group holds the suffixes with one Lyndon prefix. The second
sweep reads the order off: suffixes of a group follow each other as the suffixes
do that come after their Lyndon prefixes.

``earlier`` uses it on slices of texts that share an anchor. Slices are aligned at
the anchor, so bytes between two places at which any two of them part are equal in
all of them or in none, and are one symbol of the text that is sorted.
"""

from __future__ import annotations

import numpy as np


def suffix_array(text: list[int]) -> list[int]:
    """Starts of the suffixes of ``text`` (whole numbers) in ascending order, a prefix before what it starts; linear but for sorting a group's members."""
    n = len(text)
    if not n:
        return []
    order = np.argsort(np.asarray(text, dtype=np.int64), kind="stable")
    ranked = np.asarray(text, dtype=np.int64)[order]
    first = np.r_[True, ranked[1:] != ranked[:-1]]
    starts = np.flatnonzero(first)
    sa, place = order.tolist(), np.empty(n, dtype=np.int64)
    place[order] = np.arange(n)
    place = place.tolist()
    group = np.empty(n, dtype=np.int64)
    group[order] = np.repeat(starts, np.diff(np.r_[starts, n]))
    group = group.tolist()
    size = np.zeros(n + 1, dtype=np.int64)
    size[starts] = np.diff(np.r_[starts, n])
    size = size.tolist()
    # Neighbours among suffixes that no group taken so far holds; a suffix's left one, when it is taken, is its previous smaller one.
    left, right = list(range(-1, n - 1)), list(range(1, n + 1))
    right.append(0)
    end = n
    while end:
        at = group[sa[end - 1]]
        members = sa[at:end]
        if end - at > 1:
            members.sort()
        end = at
        heirs: list[int] = []
        times: list[int] = []
        most, last = 1, -1
        for s in members:
            before, after = left[s], right[s]
            right[before] = after
            if after < n:
                left[after] = before
            if before < 0:
                continue
            if before == last:
                times[-1] += 1
                if times[-1] > most:
                    most = times[-1]
            else:
                heirs.append(before)
                times.append(1)
                last = before
        if most == 1:
            classes = [heirs]
        else:
            held: dict[int, list[int]] = {}
            for s, t in zip(heirs, times):
                held.setdefault(t, []).append(s)
            classes = [held[t] for t in sorted(held, reverse=True)]
        for same in classes:  # the more often the prefix came, the higher
            for s in same:
                g = group[s]
                size[g] -= 1
                to = g + size[g]
                was = place[s]
                if was != to:
                    other = sa[to]
                    sa[to], sa[was] = s, other
                    place[s], place[other] = to, was
            starts_of = [group[s] + size[group[s]] for s in same]
            for s, to in zip(same, starts_of):
                group[s] = to
                size[to] += 1
    # ``left`` is the previous smaller suffix of each by now, and ``group`` the start of its group.
    out, head = [0] * n, list(range(n))

    def emit(s: int, until: int) -> None:
        while s != until:
            g = group[s]
            out[head[g]] = s
            head[g] += 1
            s = left[s]

    emit(n - 1, -1)
    for i in range(n):
        s = out[i]
        if left[s] != s - 1:
            emit(s - 1, left[s])
    return out


def _joined(parts: list[bytes], width: int) -> np.ndarray:
    """``parts``, each at most ``width`` bytes, as rows of bytes, filled up with zeros."""
    sizes = np.fromiter(map(len, parts), dtype=np.int64, count=len(parts))
    out = np.zeros((len(parts), width), dtype=np.uint8)
    out[np.arange(width) < sizes[:, None]] = np.frombuffer(b"".join(parts), dtype=np.uint8)
    return out


def _agree(rows: np.ndarray, sizes: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Common leading bytes of rows ``a`` and ``b``, pair by pair."""
    out = np.empty(len(a), dtype=np.int64)
    for lo in range(0, len(a), 50_000):
        i, j = a[lo : lo + 50_000], b[lo : lo + 50_000]
        differ = rows[i] != rows[j]
        out[lo : lo + 50_000] = np.where(differ.any(axis=1), differ.argmax(axis=1), rows.shape[1])
    return np.minimum(out, np.minimum(sizes[a], sizes[b]))


def _classes(rows: np.ndarray, sizes: np.ndarray, group: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
    """The order of ``rows`` by group and bytes, and how many leading bytes each shares with the one before, -1 at the start of a group."""
    key = np.concatenate([group.astype(">u4").view(np.uint8).reshape(-1, 4), rows, (sizes + 1).astype(">u2").view(np.uint8).reshape(-1, 2)], axis=1)
    order = np.argsort(np.ascontiguousarray(key).view(f"S{key.shape[1]}").ravel(), kind="stable")
    shared = np.full(len(order), -1, dtype=np.int64)
    same = np.flatnonzero(group[order][1:] == group[order][:-1]) + 1
    shared[same] = _agree(rows, sizes, order[same - 1], order[same])
    return order, shared


def _symbols(order: np.ndarray, shared: np.ndarray, sizes: np.ndarray, group: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """For each row and each place of its group at which two rows part: (row, place, class).

    Rows of a group have the same class at a place if and only if they agree on
    all bytes up to it. Only places within a row, and at most up to its ``ends``, count.
    """
    cut = shared >= 0
    cuts = np.unique(np.stack([group[order][cut], shared[cut]]), axis=1) if cut.any() else np.zeros((2, 0), dtype=np.int64)
    first = np.searchsorted(cuts[0], np.arange(group.max() + 2))
    many = np.diff(first)[group[order]]
    row = np.repeat(np.arange(len(order)), many)  # of the order
    place = cuts[1][np.repeat(first[group[order]], many) + np.arange(len(row)) - np.repeat(np.cumsum(many) - many, many)]
    fits = (place <= sizes[order][row]) & (place <= ends[order][row])
    row, place = row[fits], place[fits]
    at = np.lexsort((row, place, group[order][row]))
    row, place = row[at], place[at]
    # Rows of a class follow each other in the order; a new one begins where any row in between shares less.
    bound = np.maximum.accumulate(np.where(shared < 0, np.arange(len(order)), 0))
    new = np.ones(len(row), dtype=bool)
    if len(row) > 1:
        near = (place[1:] == place[:-1]) & (group[order][row[1:]] == group[order][row[:-1]]) & (row[1:] == row[:-1] + 1)
        new[1:] = ~(near & (shared[row[1:]] >= place[1:]) & (bound[row[1:]] == bound[row[:-1]]))
    return order[row], place, np.cumsum(new) - 1


def earlier(group: np.ndarray, slices: list[bytes], anchor: np.ndarray, rank: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Windows of ``width`` bytes that another slice of the group holds as well and that come earlier there: (slice, start within it).

    ``anchor`` is the place of the anchor in a slice. Windows that hold it are
    compared at equal distance from it; it has to lie in every one of a slice's
    windows. ``rank`` says which slice is earlier. ``group`` numbers from 0.
    """
    n = len(slices)
    size = np.fromiter(map(len, slices), dtype=np.int64, count=n)
    lefts, rights = [s[:a][::-1] for s, a in zip(slices, anchor.tolist())], [s[a:] for s, a in zip(slices, anchor.tolist())]
    before, after = anchor, size - anchor
    left = _joined(lefts, max(1, int(before.max())))
    right = _joined(rights, max(1, int(after.max())))
    l_row, l_place, l_class = _symbols(*_classes(left, before, group), before, group, before)
    r_order, r_shared = _classes(right, after, group)
    r_row, r_place, r_class = _symbols(r_order, r_shared, after, group, after)
    # A slice's text: its classes to the left, farthest first, its classes to the right, and an end.
    base = int(l_class.max(initial=-1)) + 2
    kind = np.concatenate([np.zeros(len(l_row)), np.ones(len(r_row)), np.full(n, 2)]).astype(np.int64)
    row = np.concatenate([l_row, r_row, np.arange(n)])
    place = np.concatenate([-l_place, r_place, np.zeros(n, dtype=np.int64)])
    symbol = np.concatenate([l_class + 1, r_class + base, np.zeros(n, dtype=np.int64)])
    at = np.lexsort((place, kind, row))
    kind, row, place, symbol = kind[at], row[at], place[at], symbol[at]
    sa = np.array(suffix_array(symbol.tolist()), dtype=np.int64)
    sa = sa[kind[sa] == 0]  # suffixes that begin left of an anchor, those of a class one after another
    if not len(sa):
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    who, far, first = row[sa], -place[sa], symbol[sa]
    common = np.full(len(sa), -1, dtype=np.int64)
    same = np.flatnonzero(first[1:] == first[:-1]) + 1
    common[same] = _agree(right, after, who[same - 1], who[same])
    # The windows that begin within a suffix's first symbol: nearer than its own place, not nearer than the next.
    nearer = np.full(len(symbol), -1, dtype=np.int64)
    nearer[:-1] = np.where((kind[1:] == 0) & (row[1:] == row[:-1]), -place[1:], -1)
    low, high = np.maximum(nearer[sa] + 1, np.maximum(0, width - after[who])), np.minimum(far, before[who])
    rows_out, starts_out = [], []
    for back in range(int(low.min()), int(high.max()) + 1):
        mine = np.flatnonzero((low <= back) & (back <= high))
        if len(mine) < 2:
            continue
        # Suffixes in between that have no such window hold no run apart: what they share is less than what runs need.
        run = np.cumsum(common < width - back)[mine]
        begins = np.flatnonzero(np.r_[True, run[1:] != run[:-1]])
        ranks = rank[who[mine]]
        least = np.repeat(np.minimum.reduceat(ranks, begins), np.diff(np.r_[begins, len(mine)]))
        late = mine[ranks > least]
        rows_out.append(who[late])
        starts_out.append(anchor[who[late]] - back)
    if not rows_out:
        return np.empty(0, dtype=np.int64), np.empty(0, dtype=np.int64)
    return np.concatenate(rows_out), np.concatenate(starts_out)
