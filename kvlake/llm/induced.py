"""Suffix sorting by external induced sorting, with common prefixes.

The suffixes of a string of symbols are sorted from those at its local minima
(S*: smaller than the suffix after, larger neighbour before). A sweep upward through a priority queue takes suffixes in order and
sends the one before each into the queue if that is larger; a sweep downward does the same for smaller
ones, and after both all suffixes are sorted, given the order of the S* suffixes. That order comes from the
same two sweeps over unsorted S* places, which sort the substrings from one to the next; if two substrings are
equal, their names make a shorter string, which is sorted by recursion, or by doubling ranks in memory once it fits there.

The queue holds tuples (symbol, symbol before, place, common prefix with the tuple before) and is served in blocks: as
many of its least tuples as cannot send anything among themselves are taken at once, so that a block costs a few array
operations. What exceeds the budget goes to disk, one segment a range of symbols, as do the string, its
types and all orders. Common prefixes of S* suffixes are compared once, and from there carried by induction: of two neighbours
that suffixes of one symbol were sent by, the prefix is one more than the least among what lies between these. They are
counted up to a cap.
"""

from __future__ import annotations

import tempfile
from pathlib import Path

import numpy as np

#: Ranges of symbols that the queue keeps apart.
RANGES = 512
#: Tuples that the queue holds in memory; longer arrays than that are files.
BUDGET = 1 << 23


class DiskQueue:
    """Rows by range of symbols, in the order they came in; beyond `budget` they go to disk.

    New rows are held as they come. From time to time they are sorted by range into a run, in memory or as a file,
    of which each range is a slice.
    """

    def __init__(self, folder: Path, budget: int, kinds: tuple[np.dtype, ...], ranges: int) -> None:
        self.folder, self.budget, self.kinds, self.ranges = folder, budget, kinds, ranges
        self.step = max(1, min(budget // 8, 1 << 16))
        self.new: list[tuple[np.ndarray, tuple[np.ndarray, ...]]] = []
        self.n_new = self.n_held = self.made = 0
        self.runs: list[tuple[np.ndarray, tuple[np.ndarray, ...] | Path]] = []  # (where each range begins, its columns)

    def push(self, ranges: np.ndarray, columns: tuple[np.ndarray, ...]) -> None:
        if len(ranges):
            self.new.append((ranges, columns))
            self.n_new += len(ranges)
            if self.n_new >= self.step:
                self._gather()

    def _gather(self) -> None:
        """New rows become a run; runs become files if memory is full."""
        ranges = np.concatenate([r for r, _ in self.new])
        order = np.argsort(ranges, kind="stable")
        columns = tuple(np.concatenate([c[i] for _, c in self.new])[order].astype(k, copy=False) for i, k in enumerate(self.kinds))
        self.runs.append((np.searchsorted(ranges[order], np.arange(self.ranges + 1)), columns))
        self.new, self.n_new, self.n_held = [], 0, self.n_held + len(ranges)
        # Runs in memory that are not much longer than the one after join it, so there are few.
        while len(self.runs) > 1 and not isinstance(self.runs[-2][1], Path) and len(self.runs[-2][1][0]) <= 2 * len(self.runs[-1][1][0]):
            (at, a), (bt, b) = self.runs[-2:]
            ranges = np.concatenate([np.repeat(np.arange(self.ranges), np.diff(x)) for x in (at, bt)])
            order = np.argsort(ranges, kind="stable")
            self.runs[-2:] = [(at + bt, tuple(np.concatenate([x, y])[order] for x, y in zip(a, b, strict=True)))]
        if self.n_held > self.budget:
            self.runs = [(at, c if isinstance(c, Path) else self._stored(c)) for at, c in self.runs]
            self.n_held = 0

    def _stored(self, columns: tuple[np.ndarray, ...]) -> Path:
        path = self.folder / f"queue-{id(self):x}-{self.made}"
        self.made += 1
        with open(path, "wb") as f:
            for c in columns:
                f.write(np.ascontiguousarray(c).data)
        return path

    def take(self, range_: int) -> tuple[np.ndarray, ...]:
        """All rows of a range, in the order they came in; ranges are taken in turn."""
        if self.new:
            self._gather()
        parts = []
        for at, columns in self.runs:
            a, b = int(at[range_]), int(at[range_ + 1])
            if a < b and isinstance(columns, Path):
                base, held = 0, []
                for kind in self.kinds:
                    held.append(np.fromfile(columns, kind, b - a, offset=base + a * kind.itemsize))
                    base += int(at[-1]) * kind.itemsize
                parts.append(tuple(held))
            elif a < b:
                parts.append(tuple(c[a:b] for c in columns))
        if len(parts) == 1:
            return parts[0]
        return tuple(np.concatenate([p[i] for p in parts]) if parts else np.zeros(0, k) for i, k in enumerate(self.kinds))


class _Room:
    """Arrays of a sort: in memory, or as files if they are longer than the budget."""

    def __init__(self, folder: Path, budget: int) -> None:
        self.folder, self.budget, self.made = folder, budget, 0

    def array(self, n: int, kind: type) -> np.ndarray:
        if n <= self.budget:
            return np.empty(n, kind)
        self.made += 1
        return np.memmap(self.folder / f"array-{self.made}", kind, "w+", shape=(n,))


def suffix_array(t: np.ndarray, *, cap: int = 0, budget: int = BUDGET, folder: str | None = None) -> tuple[np.ndarray, np.ndarray]:
    """(places of the suffixes of `t` in order, symbols each shares with the one before, up to `cap`).

    t: non-negative symbols, the last its unique least.
    """
    if len(t) == 1:
        return np.zeros(1, np.int32), np.zeros(1, np.uint8)
    with tempfile.TemporaryDirectory(prefix="kvlake-induced-", dir=folder) as d:
        room = _Room(Path(d), max(4, budget))
        held = room.array(len(t), np.int32)
        held[:] = t
        order, prefix = _sort(held, room, cap)
        return np.array(order), np.array(prefix)


def _stars(t: np.ndarray) -> np.ndarray:
    """The S* places of a string that ends with its unique least symbol."""
    rise = np.sign(np.diff(t)).astype(np.int8)  # of each place to the next
    at = np.flatnonzero(rise)
    runs = np.diff(np.concatenate([[-1], at]))
    small = np.concatenate([np.repeat(rise[at] > 0, runs), [True]])  # equal symbols take the type of what follows
    return (np.flatnonzero(small[1:] & ~small[:-1]) + 1).astype(np.int32)


def _counts(cap: int) -> type:
    return np.uint8 if cap < 256 else np.int32


def _shared(t: np.ndarray, a: np.ndarray, b: np.ndarray, cap: int) -> np.ndarray:
    """Symbols that the suffixes at a and b share, up to `cap`."""
    out = np.full(len(a), cap, _counts(cap))
    left, n = np.arange(len(a)), len(t)
    for i in range(cap):
        x, y = a[left] + i, b[left] + i
        same = (x < n) & (y < n)
        same[same] = t[x[same]] == t[y[same]]
        out[left[~same]] = i
        left = left[same]
        if not len(left):
            break
    return out


def _least_between(values: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """The least of values[a + 1 .. b] for each pair a < b."""
    out = np.empty(len(a), values.dtype)
    width = b - a
    level = np.log2(width).astype(np.int64) if len(width) else width
    table, size = values, 1
    for lv in range(int(level.max(initial=-1)) + 1):
        if lv:
            table, size = np.minimum(table[:-size], table[size:]), size * 2
        at = np.flatnonzero(level == lv)
        if len(at):
            out[at] = np.minimum(table[a[at] + 1], table[b[at] - size + 1])
    return out


def _sweep(t: np.ndarray, room: _Room, seeds: np.ndarray, prefix: np.ndarray | None, down: bool, cap: int, keep_seeds: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Induces from seeds (places, in the order of the sweep): what the queue gave, with `keep_seeds` all that was taken, in order."""
    top = int(t.max())
    shift = max(0, top.bit_length() - min(RANGES, max(1, len(t) >> 11)).bit_length() + 1)
    key = (lambda x: top - x) if down else (lambda x: x)
    int_ = np.dtype(np.int32)
    queue = DiskQueue(room.folder, room.budget, (int_, int_, int_, np.dtype(_counts(cap))), (top >> shift) + 1)
    n_out = len(t) + len(seeds) if keep_seeds else len(t)
    out, lcp = room.array(n_out, np.int32), room.array(n_out, _counts(cap)) if cap else None
    at = 0
    # The least prefix since each symbol was last sent; cap + 1: never sent.
    since = np.full(top + 1, cap + 1, np.int64) if cap else None
    first = key(t[seeds])
    cuts = np.searchsorted(first >> shift, np.arange((top >> shift) + 2)) if len(seeds) else np.zeros((top >> shift) + 2, np.int64)
    last = last_place = -1
    reach = 256
    for r in range((top >> shift) + 1):
        s, u, p, l_ = queue.take(r)
        a, b = int(cuts[r]), int(cuts[r + 1])
        # Rows of the range in order: 2 * symbol + 1 for seeds (of a symbol what the queue gave comes first), symbol before, place, prefix.
        front = np.empty((4, len(s) + b - a), np.int32)
        front[0, : len(s)], front[1, : len(s)], front[2, : len(s)], front[3, : len(s)] = 2 * s, u, p, l_
        if a < b:
            own = np.array(seeds[a:b])
            front[0, len(s) :], front[1, len(s) :] = 2 * first[a:b] + 1, np.where(own > 0, key(t[np.maximum(own, 1) - 1]), -1)
            front[2, len(s) :], front[3, len(s) :] = own, prefix[a:b] if cap else 0
        if front.shape[1] > 1 and (shift or a < b):
            front = front[:, np.argsort(front[0], kind="stable")]
        while front.shape[1]:
            place, u = front[0, :reach], front[1, :reach]
            s, mark = place >> 1, place & 1
            sends = u >= s + mark  # a seed sends to greater symbols only
            least = np.minimum.accumulate(np.where(sends & (u > s), u, np.int32(2**31 - 1)))
            clash = s[1:] >= least[:-1]
            end = int(clash.argmax()) + 1 if clash.any() else len(s)
            loops = sends[:end] & (u[:end] == s[:end])
            if loops.any():  # what a symbol sends to itself comes after what is known of it
                end = min(end, int(np.searchsorted(place, 2 * s[loops.argmax()], "right")))
            reach = max(256, 4 * end)
            bs, bm, bp, bl = s[:end], mark[:end], front[2, :end], front[3, :end]
            if cap:
                turn = np.flatnonzero((bm == 1) & np.concatenate([[last_place != place[0]], place[1:end] != place[: end - 1]]))
                for x in turn.tolist():  # the first seed of a symbol
                    before = int(bp[x - 1]) if x else last
                    bl[x] = _shared(t, np.array([before]), bp[x : x + 1], cap)[0] if before >= 0 else 0
            if keep_seeds:
                out[at : at + end] = bp
                if cap:
                    lcp[at : at + end] = bl
                at += end
            else:
                kept = np.flatnonzero(bm == 0)
                out[at : at + len(kept)] = bp[kept]
                if cap:
                    lcp[at : at + len(kept)] = bl[kept]
                at += len(kept)
            # Send what comes before, by symbol.
            i = np.flatnonzero(sends[:end])
            i = i[np.argsort(u[i], kind="stable")]
            new = np.empty((4, len(i)), np.int32)
            to = u[i]
            new[0], new[2], new[3] = 2 * to, bp[i] - 1, 0
            new[1] = np.where(new[2] > 0, key(t[np.maximum(new[2], 1) - 1]), -1)
            if cap:
                ahead = np.minimum.accumulate(bl)
                behind = np.concatenate([np.minimum.accumulate(bl[::-1])[::-1], [cap]])
                if len(i):
                    again = np.concatenate([[False], to[1:] == to[:-1]])
                    head = np.flatnonzero(~again)
                    met = since[to[head]]
                    new[3, head] = np.where(met > cap, 0, np.minimum(cap, np.minimum(met, ahead[i[head]]) + 1))
                    follow = np.flatnonzero(again)
                    new[3, follow] = np.minimum(cap, _least_between(bl, i[follow - 1], i[follow]) + 1)
                np.minimum(since, ahead[-1], out=since, where=since <= cap)
                if len(i):
                    since[to[np.append(head[1:] - 1, len(i) - 1)]] = behind[i[np.append(head[1:] - 1, len(i) - 1)] + 1]
            last, last_place = int(bp[-1]), int(place[end - 1])
            front = front[:, end:]
            here = int(np.searchsorted(to, (r + 1) << shift))
            queue.push(to[here:] >> shift, (to[here:], new[1, here:], new[2, here:], new[3, here:]))
            if here:
                spot = np.searchsorted(front[0], new[0, :here], "right") + np.arange(here)
                old = np.ones(front.shape[1] + here, bool)
                old[spot] = False
                both = np.empty((4, len(old)), np.int32)
                both[:, spot], both[:, old] = new[:, :here], front
                front = both
    return out[:at], lcp[:at] if cap else None


def _induce(t: np.ndarray, room: _Room, stars: np.ndarray, cap: int, everything: bool) -> tuple[np.ndarray, np.ndarray | None]:
    """Both sweeps from S* places in order: all suffixes but the last, descending, or those of the smaller type."""
    prefix = None
    if cap:
        prefix = np.concatenate([np.zeros(1, _counts(cap)), _shared(t, stars[:-1], stars[1:], cap)])
    large, shared = _sweep(t, room, stars, prefix, False, cap, False)
    if cap:
        shared = np.concatenate([np.zeros(1, _counts(cap)), shared[:0:-1]])[: len(large)]
    return _sweep(t, room, large[::-1], shared, True, cap, everything)


def _doubled(names: np.ndarray) -> np.ndarray:
    """The order of the suffixes of a string that fits in memory, by ranks of prefixes of doubled length; only ties are sorted again."""
    order = np.argsort(names, kind="stable")
    held = names[order]
    first = np.searchsorted(held, held)  # of each group of equals
    rank = np.empty(len(names) + 1, np.int64)
    rank[order], rank[-1] = first, -1
    at = np.flatnonzero(np.bincount(first, minlength=len(names))[first] > 1)
    left, width = order[at], 1
    while len(left):
        own, then = rank[left], rank[np.minimum(left + width, len(names))]
        o = np.lexsort((then, own))
        left, own, then = left[o], own[o], then[o]
        spot = np.arange(len(left))
        group = np.concatenate([[True], own[1:] != own[:-1]])
        head = group | np.concatenate([[True], then[1:] != then[:-1]])
        begin = np.maximum.accumulate(np.where(group, spot, 0))
        rank[left] = own + np.maximum.accumulate(np.where(head, spot, 0)) - begin
        alone = head & np.append(head[1:], True)
        left, width = left[~alone], 2 * width
    out = np.empty(len(names), np.int64)
    out[rank[:-1]] = np.arange(len(names))
    return out


def _sort(t: np.ndarray, room: _Room, cap: int) -> tuple[np.ndarray, np.ndarray]:
    n = len(t)
    stars = _stars(t)
    if len(stars) > 1:
        # The substrings between S* places, sorted by induction from places of which only the first symbol is sorted.
        loose = stars[np.argsort(t[stars], kind="stable")]
        small, _ = _induce(t, room, loose, 0, False)
        is_star = np.zeros(n, bool)
        is_star[stars] = True
        ranked = np.concatenate([stars[-1:], small[is_star[small]][::-1]])
        del small, is_star
        # Their names: the same for equal substrings.
        length = np.diff(np.append(stars, n - 1))[np.searchsorted(stars, ranked)] + 1
        same = length[1:] == length[:-1]
        left = np.flatnonzero(same)
        for i in range(int(length.max())):
            differ = t[np.minimum(ranked[left] + i, n - 1)] != t[np.minimum(ranked[left + 1] + i, n - 1)]
            same[left[differ]] = False
            left = left[~differ & (length[left] > i + 1)]
            if not len(left):
                break
        names = room.array(len(stars), np.int32)
        names[np.searchsorted(stars, ranked)] = np.concatenate([[0], np.cumsum(~same)])
        if int(names.max()) + 1 == len(stars):
            order = ranked
        elif len(names) <= room.budget:
            order = stars[_doubled(np.array(names))]
        else:
            order = stars[_sort(names, room, 0)[0]]
        stars = order
    down, shared = _induce(t, room, stars, cap, True)
    out = room.array(n, np.int32)
    out[0], out[1:] = n - 1, down[::-1]
    prefix = np.zeros(n, _counts(cap))
    if cap and n > 2:
        prefix[2:] = shared[:0:-1]
    return out, prefix
