"""A compressed full-text index over word sequences (FM-index), searched for many texts at once."""

from __future__ import annotations

import numpy as np

#: A span found in more texts than this is counted, and its places are only listed where nothing rarer speaks for a pair.
FREQUENT = 48
#: Parts of at most so many words are near-same only if they are equal, as a fifth of them is less than a word.
EXACT = 3


def least_run(n: np.ndarray | int) -> np.ndarray:
    """Shortest shared run worth a look in texts of n words: a fifth of the words changed one by one leaves such a run."""
    n = np.asarray(n)
    return np.select([n >= 20, n >= 10, n >= 5], [4, 3, 2], 1)


def suffix_array(symbols: np.ndarray) -> np.ndarray:
    """Positions of all suffixes in order, by prefix doubling."""
    n = len(symbols)
    rank = symbols.astype(np.int64)
    rank = np.unique(rank, return_inverse=True)[1].astype(np.int64)
    width = 1
    order = np.argsort(rank, kind="stable")
    while n > 1 and width < n:
        second = np.zeros(n, dtype=np.int64)
        second[:-width] = rank[width:] + 1
        key = rank * (n + 1) + second
        order = np.argsort(key, kind="stable")
        sorted_key = key[order]
        fresh = np.r_[0, np.cumsum(sorted_key[1:] != sorted_key[:-1])]
        rank = np.empty(n, dtype=np.int64)
        rank[order] = fresh
        if fresh[-1] == n - 1:
            break
        width *= 2
    return order


def build(texts: list[np.ndarray]) -> dict[str, np.ndarray]:
    """The index of texts given as word codes. Symbol 0 ends every text; words are numbered from 1 in code order."""
    sizes = np.array([len(t) for t in texts], dtype=np.int64)
    codes = np.concatenate([*texts, np.zeros(0, dtype=np.int64)])
    vocabulary, numbers = np.unique(codes, return_inverse=True)
    # each text is followed by its end symbol; one more stands in front of all
    total = len(codes) + len(texts) + 1
    ends = np.cumsum(sizes + 1)
    symbols = np.zeros(total, dtype=np.int64)
    inside = np.ones(total, dtype=bool)
    inside[0] = False
    inside[ends] = False
    symbols[inside] = numbers + 1
    order = suffix_array(symbols)
    before = symbols[order - 1]  # the Burrows-Wheeler transform; position 0 wraps to the last end symbol
    n = np.int64(total)
    steps = np.sort(before * n + np.arange(total))  # one binary search in it gives C[c] + rank(c, i)
    two = np.r_[symbols[1:], 0]
    three = np.r_[symbols[2:], 0, 0]
    v = np.int64(len(vocabulary) + 1)
    gram = (symbols * v + two) * v + three
    grams, first = np.unique(gram[order], return_index=True)
    return {
        "vocabulary": vocabulary, "symbols": symbols.astype(np.int32), "order": order.astype(np.int32), "steps": steps,
        "grams": grams, "first": np.r_[first, total].astype(np.int64),
        "start": np.r_[1, ends[:-1] + 1].astype(np.int64) if len(texts) else np.zeros(0, dtype=np.int64), "sizes": sizes,
    }


def number(index: dict[str, np.ndarray], codes: np.ndarray) -> np.ndarray:
    """Word numbers of the index for codes; -1 for words that it lacks."""
    vocabulary = index["vocabulary"]
    if not len(vocabulary):
        return np.full(len(codes), -1, dtype=np.int64)
    at = np.minimum(np.searchsorted(vocabulary, codes), len(vocabulary) - 1)
    return np.where(vocabulary[at] == codes, at + 1, -1)


def _seek(places: np.ndarray, keys: np.ndarray) -> np.ndarray:
    """Binary search for many keys in their order, which stays within the processor's caches."""
    order = np.argsort(keys)
    out = np.empty(len(keys), dtype=np.int64)
    out[order] = np.searchsorted(places, keys[order])
    return out


def shared_spans(index: dict[str, np.ndarray], queries: list[np.ndarray]) -> tuple[np.ndarray, np.ndarray]:
    """Maximal matches of the queries, streamed through the index by backward search.

    Gives (query, text, words) triples, one column per matched span, for spans that stand in at most FREQUENT places, and
    per query the number of its words inside more frequent spans. From each end position, all at once, the match is
    extended to the left; when the interval shrinks, the places lost there are matches that can't be extended.
    """
    order, steps, symbols = index["order"], index["steps"], index["symbols"]
    total = np.int64(len(symbols))
    sizes = np.array([len(q) for q in queries], dtype=np.int64)
    base = np.r_[0, np.cumsum(sizes)]
    flat = np.concatenate([*queries, np.zeros(0, dtype=np.int64)])
    owner = np.repeat(np.arange(len(queries)), sizes)
    least = least_run(sizes)[owner] if len(flat) else np.zeros(0, dtype=np.int64)
    cover = np.zeros(len(flat) + 1, dtype=np.int64)
    out: list[np.ndarray] = []
    v = np.int64(len(index["vocabulary"]) + 1)
    end = np.arange(len(flat))
    room = end - base[owner]  # words to the left of the end in its text
    # texts whose runs have three words at least begin with a look-up of the last three
    jump = (least >= 3) & (room >= 2) if len(flat) else np.zeros(0, dtype=bool)
    e = end[jump]
    known = (flat[e] > 0) & (flat[e - 1] > 0) & (flat[e - 2] > 0)
    e = e[known]
    gram = (flat[e - 2] * v + flat[e - 1]) * v + flat[e]
    at = np.minimum(_seek(index["grams"], gram), len(index["grams"]) - 1)
    there = index["grams"][at] == gram
    e, at = e[there], at[there]
    groups = [(e, index["first"][at], index["first"][at + 1], 3)]
    s = end[least < 3] if len(flat) else end
    s = s[flat[s] > 0]
    groups.append((s, np.searchsorted(steps, flat[s] * total), np.searchsorted(steps, (flat[s] + 1) * total), 1))
    for e, lo, hi, length in groups:
        while len(e):
            left = e - length
            inside = left >= base[owner[e]]
            c = np.where(inside, flat[np.maximum(left, 0)], -1)
            more = c > 0
            key = c[more] * total
            both = _seek(steps, np.concatenate([key + lo[more], key + hi[more]]))
            lo2, hi2 = np.zeros(len(e), dtype=np.int64), np.zeros(len(e), dtype=np.int64)
            lo2[more], hi2[more] = both[: len(key)], both[len(key) :]
            lost = (hi - lo) > (hi2 - lo2)
            report = lost & (length >= least[e])
            rare = report & (hi - lo <= FREQUENT)
            if rare.any():
                k = np.flatnonzero(rare)
                n = hi[k] - lo[k]
                row = np.repeat(k, n)
                place = order[np.repeat(lo[k] - np.r_[0, np.cumsum(n)[:-1]], n) + np.arange(n.sum())].astype(np.int64)
                after = e[row] + 1
                follows = np.where(after < base[owner[e[row]] + 1], flat[np.minimum(after, len(flat) - 1)], -1)
                maximal = (symbols[place - 1] != c[row]) & ((symbols[np.minimum(place + length, total - 1)] != follows))
                row, place = row[maximal], place[maximal]
                if len(row):
                    text = np.searchsorted(index["start"], place, side="right") - 1
                    out.append(np.stack([owner[e[row]], text, np.full(len(row), length)]))
            often = e[report & (hi - lo > FREQUENT)]
            np.add.at(cover, often - length + 1, 1)
            np.add.at(cover, often + 1, -1)
            going = more & (hi2 > lo2)
            e, lo, hi, length = e[going], lo2[going], hi2[going], length + 1
    covered = np.cumsum(cover[:-1]) > 0
    frequent = np.bincount(owner[covered], minlength=len(queries)) if len(flat) else np.zeros(len(queries), dtype=np.int64)
    return (np.concatenate(out, axis=1) if out else np.zeros((3, 0), dtype=np.int64)), frequent


def least_shared(n: np.ndarray, near: float) -> np.ndarray:
    """Words that must stand in the same order in both of two texts whose longer one has n words."""
    return np.ceil(near * np.asarray(n) - 1e-9).astype(np.int64)


def lost_spans(n: np.ndarray, m: np.ndarray, width: int, near: float) -> np.ndarray:
    """How many of the spans of `width` words (1 or 2) of a text of n words a near-same text of m words can lack at most.

    A word left out is in `width` spans; a word put in parts one span of two words and none of one.
    """
    t = least_shared(np.maximum(n, m), near)
    return width * (n - t) + (width - 1) * (m - t)


def most_lost(n: np.ndarray, width: int, near: float) -> np.ndarray:
    """The most of lost_spans over the sizes that a near-same text can have: it falls with m from n on, but for rounding."""
    n = np.asarray(n, dtype=np.int64)
    over = [np.where(least_shared(n + k, near) <= n, lost_spans(n, n + k, width, near), 0) for k in range(int(np.ceil(1 / (1 - near))) + 1)]
    return np.max(over, axis=0)


def kin(symbols: np.ndarray, begin: np.ndarray, sizes: np.ndarray) -> np.ndarray:
    """A number for the words of each part of at most EXACT words, the same for equal parts; 0 for longer parts."""
    out = sizes.astype(np.int64)
    for k in range(EXACT):
        out = out * 0x5851F42D4C957F2D + np.where(k < sizes, symbols[np.minimum(begin + k, len(symbols) - 1)], 0)
    return np.where(sizes > EXACT, 0, (out >> 24 & 0x3FFFFFFF) + 1)


def listing_keys(symbols: np.ndarray, start: np.ndarray, sizes: np.ndarray, cuts: np.ndarray) -> list[tuple[np.ndarray, np.ndarray]]:
    """For listing by the first and by the second part of texts: the kin of the other part, and the size of this one."""
    first, second = kin(symbols, start, cuts), kin(symbols, start + cuts, sizes - cuts)
    return [(second, cuts), (first, sizes - cuts)]


def ready(index: dict[str, np.ndarray]) -> dict[str, np.ndarray]:
    """The index with the texts of each interval listed by the kin of one part and the size of the other (parted at `cuts`)."""
    n = max(1, len(index["sizes"]))
    symbols = index["symbols"]
    keys = [other << 32 | sizes for other, sizes in listing_keys(symbols, index["start"], index["sizes"], index["cuts"])]
    if "group" not in index:
        order = index["order"]
        one, two = symbols[order], np.r_[symbols[1:], 0][order]
        index["group"] = np.r_[0, np.cumsum((one[1:] != one[:-1]) | (two[1:] != two[:-1]))].astype(np.int32)
        text = np.maximum(np.searchsorted(index["start"], order, side="right") - 1, 0)
        for p in (0, 1):
            rank = np.empty(n, dtype=np.int64)
            rank[np.argsort(keys[p], kind="stable")] = np.arange(len(keys[p]))
            key = index["group"] * np.int64(n) + rank[text]
            key.sort()
            index[f"rank{p}"] = (key % n).astype(np.int32)
    if "key0" not in index:
        index["heads"] = np.searchsorted(index["steps"], np.arange(len(index["vocabulary"]) + 2) * np.int64(len(symbols)))
        for p in (0, 1):
            index[f"key{p}"] = index["group"] * np.int64(n) + index[f"rank{p}"]
            index[f"texts{p}"] = np.argsort(keys[p], kind="stable")
            index[f"sorted{p}"] = np.sort(keys[p])
    return index


def partners(index: dict[str, np.ndarray], queries: list[np.ndarray], cuts: list[int], near: float) -> np.ndarray:
    """(query, text) pairs, one per column, among which are all whose parts are both near-same.

    Each text has two parts (question and answer, parted at its cut), which share no word numbers. Backward search gives the
    interval of each one- and two-word span of the queries. If two parts are near-same, at most `lost_spans` of the spans of
    one are missing in the other, whatever words are left out, put in or changed. So of the spans of one part the
    rarest are listed, more than can be lost, and texts that hold too few of them are dropped. Which part and which width
    is listed is chosen per query by the number of places; no interval is too frequent to be listed. The places of a two-word
    span lie by the kin of the other part and by size: only those of fitting size are read, and where the other part is so short
    that it must be equal (a label, a rating), only those beside an equal one.
    """
    steps, n_texts = index["steps"], np.int64(max(1, len(index["sizes"])))
    total = np.int64(len(index["symbols"]))
    sizes = np.array([len(q) for q in queries], dtype=np.int64)
    flat = np.concatenate([*queries, np.zeros(0, dtype=np.int64)]).astype(np.int64)
    if not len(flat) or not len(index["sizes"]):
        return np.zeros((2, 0), dtype=np.int64)
    base = np.r_[0, np.cumsum(sizes)]
    owner = np.repeat(np.arange(len(queries)), sizes)
    cut = np.array(cuts, dtype=np.int64)
    segment = 2 * owner + (np.arange(len(flat)) - base[owner] >= cut[owner])
    n = np.stack([cut, sizes - cut], axis=1).ravel()
    # texts of fitting size and kin, per part, as a range of ranks; whoever has none in one of them has no partner
    low, high = np.zeros(len(n), dtype=np.int64), np.zeros(len(n), dtype=np.int64)
    for p, (other, own) in enumerate(listing_keys(flat, base[:-1], sizes, cut)):
        low[p::2] = np.searchsorted(index[f"sorted{p}"], other << 32 | least_shared(own, near), side="left")
        high[p::2] = np.searchsorted(index[f"sorted{p}"], other << 32 | np.floor(own / near + 1e-9).astype(np.int64), side="right")
    fitting = np.flatnonzero((high > low)[0::2] & (high > low)[1::2])
    if len(fitting) < len(queries):
        some = partners(index, [queries[a] for a in fitting.tolist()], cut[fitting].tolist(), near)
        return np.stack([fitting[some[0]], some[1]])
    known = flat > 0
    lo1 = np.where(known, index["heads"][np.maximum(flat, 0)], 0)
    hi1 = np.where(known, index["heads"][np.maximum(flat, 0) + 1], 0)
    head = np.flatnonzero(segment[:-1] == segment[1:])  # where a two-word span begins
    lo2, hi2 = np.zeros(len(head), dtype=np.int64), np.zeros(len(head), dtype=np.int64)
    both = np.flatnonzero(known[head] & known[head + 1])
    key = flat[head[both]] * total
    got = _seek(steps, np.concatenate([key + lo1[head[both] + 1], key + hi1[head[both] + 1]]))
    lo2[both], hi2[both] = got[: len(both)], got[len(both) :]
    options = []
    for width, seg, lo, hi in ((1, segment, lo1, hi1), (2, segment[head], lo2, hi2)):
        lost = most_lost(n, width, near)
        cost = hi - lo
        order = np.argsort(seg << 32 | cost)  # by segment, the rarest first
        seg, lo, hi, cost = seg[order], lo[order], hi[order], cost[order]
        have = np.bincount(seg, minlength=len(n))
        place = np.arange(len(seg)) - (np.cumsum(have) - have)[seg]
        least = np.bincount(seg, weights=np.where(place <= lost[seg], cost, 0), minlength=len(n))
        # of two-word spans, only the places of fitting texts will be read
        options.append((seg, lo, hi, cost, have, place, lost, np.where(have > lost, least * ((high - low) / n_texts if width == 2 else 1), np.inf), least))
    price = np.stack([o[-2] for o in options], axis=1).reshape(len(queries), 4)  # first part by one and two words, second part
    best = price.argmin(axis=1)
    out = []
    for choice in range(4):
        part, width = divmod(choice, 2)  # width 1 is two words
        mine = (best == choice) & np.isfinite(price.min(axis=1))
        if not mine.any():
            continue
        seg, lo, hi, cost, have, place, lost, _, least = options[width]
        begin = np.cumsum(have) - have
        # more spans than needed, as long as the places about double: texts must then hold several
        running = np.cumsum(cost)
        within = running - np.where(begin > 0, running[np.maximum(begin, 1) - 1], 0)[seg]
        pick = (place <= lost[seg]) | (within <= 2 * least[seg] + 64)
        pick &= mine[seg // 2] & (seg % 2 == part)
        chosen = np.bincount(seg[pick], minlength=len(n))
        pick &= cost > 0
        seg, lo, hi = seg[pick], lo[pick], hi[pick]
        if width:  # texts lie by kin and size within the interval of two words
            group = index["group"][lo] * n_texts
            lo, hi = _seek(index[f"key{part}"], group + low[seg]), _seek(index[f"key{part}"], group + high[seg])
        ranks = index[f"rank{part}"]
        edges = np.searchsorted(seg, np.arange(len(queries)) * 2 + part, side="left").tolist(), np.searchsorted(seg, np.arange(len(queries)) * 2 + part, side="right").tolist()
        lo, hi = lo.tolist(), hi.tolist()
        need, first, last = (chosen - lost).tolist(), low.tolist(), high.tolist()
        who, held, counts = [], [], []
        for a in np.flatnonzero(mine).tolist():
            i, j, s = edges[0][a], edges[1][a], 2 * a + part
            if i == j:
                continue
            listed = np.concatenate([ranks[x:y] for x, y in zip(lo[i:j], hi[i:j]) if x < y] or [ranks[:0]])
            if not width:
                listed = listed[(listed >= first[s]) & (listed < last[s])]
            if not len(listed):
                continue
            count = np.bincount(listed - first[s])
            near_by = (count >= need[s]).nonzero()[0]
            if len(near_by):
                who.append(a)
                held.append(near_by + first[s])
                counts.append(count[near_by])
        if not who:
            continue
        a = np.repeat(np.array(who), [len(x) for x in held])
        found, count, s = index[f"texts{part}"][np.concatenate(held)], np.concatenate(counts), 2 * a + part
        m = index["cuts"][found] if part == 0 else index["sizes"][found] - index["cuts"][found]
        other, k = index["sizes"][found] - m, n[s ^ 1]
        keep = (count >= chosen[s] - lost_spans(n[s], m, width + 1, near)) & (np.minimum(k, other) >= near * np.maximum(k, other) - 1e-9)
        out.append(np.stack([a[keep], found[keep]]))
    return np.concatenate(out, axis=1) if out else np.zeros((2, 0), dtype=np.int64)
