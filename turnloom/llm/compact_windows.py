"""Near-duplicate passages through compact windows of min-hashes.

A text is a sequence of 5-word shingles. For each of several hash functions, all windows of at least
`length` shingles that have the same smallest shingle form one compact window (l, c, r): every window
inside [l, r] that holds c has its minimum at c. The bounds are those of c's subtree in the Cartesian
tree over the hashes; only positions that are the minimum of some window of `length` have one, about
2 in `length`, and they suffice to build that part of the tree.

Two passages that agree share a minimum under each function with the probability of their
similarity. So compact windows of different documents are joined on their minimum, their intervals
are intersected around it, and each window of `length` shingles inside the intersection is verified:
it counts as repeated if enough of its shingles occur beside the other document's c, and the other
way round, for a similarity of `similar`. What repeated windows cover, joined, are the passages; the
earliest document that has one keeps it.

Equal surroundings in a group of compact windows are one entry, so a passage in any number of
documents is compared once. In a group, pairs are found by rarest shingles: of the places that some
windows share, no more than a few may be missing, so one of the rarest shingles there must occur in
the other document. A class of surroundings meets the earliest ones first and stops when no window
outside the range found could be repeated, as too few of its shingles occur in any earlier document
or none reaches as far.
So variants of a frequent passage do not meet in all pairs, and nothing is capped. Before two classes are
compared shingle by shingle, a bitmap of the earlier one's shingles, which misses none, says whether any
window that could still add to the range may have enough of them. A bucket is searched by ranges of its
hashes, so its rows are not all held as numbers at once.

Defined results: words are `[^\\x20\\x09-\\x0D]+` with A-Z in lower case; a null text is empty; texts
shorter than a window have no passages; an exact copy of a text is one whole passage; a null key
neither has passages nor is a source; an empty table gives no rows.
"""

from __future__ import annotations

import math

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from turnloom.llm.runs import Anchors, Entries, Run, pack, search, unpack
from turnloom.llm.suffix_dedup import window_minima

SHINGLE, WORDS, SIMILAR, FUNCTIONS = 5, 50, 0.8, 3
_CHUNK = 1 << 21
_CLASSES = 1 << 14  # classes of equal surroundings searched at once; a larger group is searched whole
_ANCHORS = 1 << 14  # anchors whose surroundings are held at once
_POSTINGS = 1 << 20  # places of chosen shingles looked at at once
_ROWS = 1 << 15  # surroundings of a bucket merged at once; those of a larger group are merged whole
_PAIRS = 1 << 12  # pairs of classes whose bitmaps are looked at at once
_BITS = 1 << 10  # in the bitmap of a class
_BASE = 0x9E3779B97F4A7C15
_MIX = np.uint64(0xD6E8FEB86659FD93)
_LOWER = np.arange(256, dtype=np.uint8)
_LOWER[65:91] += 32
_SPACE = np.zeros(256, bool)
_SPACE[[9, 10, 11, 12, 13, 32]] = True


def _mixed(x: np.ndarray) -> np.ndarray:
    x = (x ^ (x >> np.uint64(32))) * _MIX
    return x ^ (x >> np.uint64(29))


_POWERS: list[np.ndarray] = [np.ones(1, np.uint64), np.ones(1, np.uint64)]


def _powers(size: int) -> list[np.ndarray]:
    """Powers of the base and of its inverse modulo 2**64, kept for the longest text so far."""
    if len(_POWERS[0]) <= size:
        bases = _BASE, pow(_BASE, -1, 1 << 64)
        _POWERS[:] = [np.concatenate(([np.uint64(1)], np.multiply.accumulate(np.full(2 * size, b, np.uint64))))
                      for b in bases]
    return _POWERS


def words_of(text: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and hash of every word of a byte array."""
    gap = np.concatenate(([True], _SPACE[text], [True]))
    turn = np.flatnonzero(gap[1:] != gap[:-1])
    starts, ends = turn[::2], turn[1::2]
    up, down = _powers(len(text))
    total = np.concatenate((np.zeros(1, np.uint64), np.cumsum(_LOWER[text].astype(np.uint64) * up[:len(text)])))
    hashes = (total[ends] - total[starts]) * down[starts]
    return starts, ends, _mixed(hashes + (ends - starts).astype(np.uint64) * _MIX)


def shingles_of(words: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n words from each word on, for all but the last n - 1 words."""
    out = np.zeros(max(0, len(words) - n + 1), np.uint64)
    for i in range(n):
        out = (out + words[i:len(words) - n + 1 + i]) * np.uint64(_BASE)
        out ^= out >> np.uint64(31)
    return _mixed(out)


def extents(values: np.ndarray, places: np.ndarray, low: np.ndarray, high: np.ndarray,
            reach: int = 1 << 40) -> tuple[np.ndarray, np.ndarray]:
    """For each anchor, in order: the first and last position of its subtree in the Cartesian tree, that
    is, up to the nearest smaller value on either side; equal values bound each other on neither side.
    `low` and `high` bound its document; what is more than `reach` away need not be exact."""
    bounds = low.copy(), high - 1
    for step, bound in zip((-1, 1), bounds):
        still, k = np.arange(len(values)), 0
        while len(still):  # the anchors whose k-th neighbour may bound them
            k += step
            still = still[(still + k >= 0) & (still + k < len(values))]
            other = still + k
            near = (low[other] == low[still]) & (np.abs(places[other] - places[still]) <= reach + 1)
            still, other = still[near], other[near]
            less = values[other] < values[still]
            bound[still[less]] = places[other[less]] - step
            still = still[~less]
    return bounds


class _Windows:
    """The method that `runs.search` drives. An anchor's place holds its position (40 bits) and how
    far its compact window reaches left and right of it, up to a window's length (8 bits each)."""

    def __init__(self, shingle: int, words: int, similar: float, functions: int):
        self.shingle, self.words, self.functions = shingle, words, functions
        self.length = words - shingle + 1
        self.reach = self.length - 1
        # of two windows of n shingles, x in common: x / (2n - x) >= similar
        self.enough = math.ceil(2 * self.length * similar / (1 + similar) - 1e-9)

    def _sequence(self, run: Run) -> dict:
        """Words and shingles of the run's documents that take part, kept with the run."""
        if "starts" in run.held:
            return run.held
        parts, group, size = [], [], 0
        use = [i for i, c in enumerate(run.copy) if not c]
        for n, i in enumerate(use):
            group.append(i)
            size += len(run.texts[i])
            if size >= _CHUNK or n == len(use) - 1:
                parts.append(self._chunk([run.texts[i] for i in group], group))
                group, size = [], 0
        names = ("shingles", "docs", "first", "last")
        joined, at = {n: [] for n in names}, 0
        for shingles, docs, first, last in parts:
            for n, x in zip(names, (shingles, docs, first + at, last + at)):
                joined[n].append(x)
            at += len(shingles)
        kinds = (np.uint64, np.int64, np.int64, np.int64)
        run.held.update({n: np.concatenate(joined[n]) if joined[n] else np.zeros(0, k) for n, k in zip(names, kinds)})
        run.held["starts"] = True
        return run.held

    def _chunk(self, texts: list[bytes], group: list[int]):
        sizes = np.array([len(t) + 1 for t in texts], np.int64)
        text = np.frombuffer(b"\n".join(texts) + b"\n", np.uint8)
        starts, _, hashes = words_of(text)
        doc = np.searchsorted(np.cumsum(sizes), starts, "right")
        n = self.shingle
        shingles = shingles_of(hashes, n)
        whole = doc[:len(shingles)] == doc[n - 1:] if len(shingles) else np.zeros(0, bool)
        shingles, doc = shingles[whole], doc[:len(whole)][whole]
        edges = np.flatnonzero(np.append(True, doc[1:] != doc[:-1])) if len(doc) else np.zeros(0, np.int64)
        counts = np.diff(np.append(edges, len(doc)))
        return shingles, np.array(group, np.int64)[doc], np.repeat(edges, counts), np.repeat(edges + counts, counts)

    def anchors(self, run: Run) -> Anchors:
        s = self._sequence(run)
        shingles, out = s["shingles"], ([], [], [])
        size = np.arange(len(shingles))
        valid = size + self.length <= s["last"] if len(shingles) else np.zeros(0, bool)
        for f in range(self.functions if valid.any() else 0):
            values = _mixed(shingles ^ np.uint64((f + 1) * _BASE % (1 << 64)))
            at = window_minima(values, valid, self.length)
            left, right = extents(values[at], at, s["first"][at], s["last"][at], self.reach)
            a = np.minimum(at - left, self.reach)
            b = np.minimum(right - at, self.reach)
            out[0].append(_mixed(values[at] + np.uint64(f)))
            out[1].append(s["docs"][at])
            out[2].append(at | (a << 40) | (b << 48))
        joined = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return Anchors(joined[0].astype(np.uint64), joined[1], joined[2])

    def entries(self, run: Run, found: Anchors, buckets: np.ndarray) -> Entries:
        n = len(found.docs)
        entry, least, messages = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        shown = (self._sequence(run)["shingles"] & np.uint64(0xFFFFFF)).astype(np.uint32)
        shown[shown == 0] = 1  # 0 is no shingle
        pad = np.zeros(self.reach, np.uint32)
        shown = np.concatenate((pad, shown, pad))
        order = np.argsort(buckets, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(buckets[order]) != 0)) if n else [], n).astype(int)
        low = 0
        while low < n:  # whole buckets, some thousand anchors at a time
            high = int(edges[max(np.searchsorted(edges, low + _ANCHORS, "right") - 1, np.searchsorted(edges, low, "right"))])
            part = order[low:high]
            entry[part], least[part] = self._messages(run, found, buckets, part, shown, messages)
            low = high
        return Entries(messages, buckets, entry, least)

    def _messages(self, run: Run, found: Anchors, buckets, part, shown, messages: dict[int, bytes]):
        """Adds the messages of some whole buckets; the entry and least key of each of their anchors."""
        n, reach = len(part), self.reach
        at, a, b = _place(found.places[part])
        offsets = np.arange(2 * reach + 1)
        inside = (offsets >= reach - a[:, None]) & (offsets <= reach + b[:, None])
        near = np.where(inside, shown[at[:, None] + offsets], np.uint32(0))
        row = np.zeros((n, 1 + near.shape[1] * 3 + 8), np.uint8)  # a last byte that is never zero
        row[:, :8] = found.hashes[part].astype(">u8").view(np.uint8).reshape(-1, 8)
        row[:, 8:-1] = near.view(np.uint8).reshape(n, -1, 4)[:, :, :3].reshape(n, -1)
        row[:, -1] = 1
        rank = np.empty(n, np.int64)
        rank[np.argsort(row.view(f"S{row.shape[1]}").ravel(), kind="stable")] = np.arange(n)
        order = np.lexsort((rank, buckets[part]))
        row, bucket, keys = row[order], buckets[part][order], run.keys[found.docs[part]][order]
        new = np.append(True, (bucket[1:] != bucket[:-1]) | (row[1:] != row[:-1]).any(1))
        starts = np.flatnonzero(new)
        first, name = np.minimum.reduceat(keys, starts), np.cumsum(new) - 1
        row, bucket = row[starts], bucket[starts]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1]))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
            messages[int(bucket[i])] = pack(first[i:j].astype("<i8"), np.ascontiguousarray(row[i:j, :-1]))
        entry, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        entry[order] = name - np.repeat(edges, np.diff(np.append(edges, len(bucket))))[name]
        least[order] = first[name]
        return entry, least

    def merge(self, parts: list[bytes]) -> list[bytes]:
        width = 8 + 3 * (2 * self.reach + 1)
        runs = [(k, r.reshape(-1, width)) for k, r in (unpack(p, "<i8", "u1") for p in parts)]
        codes = [np.ascontiguousarray(r[:, :8]).view(">u8").ravel().astype(np.uint64) for _, r in runs]  # sorted
        base = np.cumsum([0, *[len(c) for c in codes]])
        low, high = np.full(base[-1], 127, np.int8), np.full(base[-1], -128, np.int8)
        source = np.full(base[-1], np.iinfo(np.int64).max)
        every, i = np.sort(np.concatenate(codes)), 0
        while i < len(every):  # whole groups, some thousand rows at a time
            j = min(i + _ROWS, len(every))
            if j < len(every):
                j = max(int(np.searchsorted(every, every[j])), int(np.searchsorted(every, every[i], "right")))
            cut = [slice(np.searchsorted(c, every[i]), np.searchsorted(c, every[j - 1], "right")) for c in codes]
            rows = np.concatenate([np.arange(len(c))[x] + n for c, x, n in zip(codes, cut, base)])
            low[rows], high[rows], source[rows] = self._merged(
                np.concatenate([c[x] for c, x in zip(codes, cut)]), np.concatenate([k[x] for (k, _), x in zip(runs, cut)]),
                np.concatenate([_wide(r[x, 8:]) for (_, r), x in zip(runs, cut)]))
            i = j
        return [pack(low[i:j], high[i:j], source[i:j].astype("<i8")) for i, j in zip(base[:-1], base[1:])]

    def _merged(self, code: np.ndarray, keys: np.ndarray, near: np.ndarray):
        """Range and earliest source of each row of some whole groups."""
        low, high = np.full(len(keys), 127, np.int8), np.full(len(keys), -128, np.int8)
        source = np.full(len(keys), np.iinfo(np.int64).max)
        digest = np.zeros(len(keys), np.uint64)
        for i in range(near.shape[1]):
            digest = (digest ^ near[:, i]) * _MIX
            digest ^= digest >> np.uint64(29)
        order = np.lexsort((keys, digest, code))
        new = np.append(True, (code[order[1:]] != code[order[:-1]]) | (digest[order[1:]] != digest[order[:-1]]))
        for i in range(1, len(order), _PAIRS):  # a digest may have several surroundings
            part = slice(i, min(i + _PAIRS, len(order)))
            new[part] |= (near[order[part]] != near[order[part.start - 1:part.stop - 1]]).any(1)
        group = np.cumsum(new) - 1
        lead = order[np.flatnonzero(new)]  # the earliest of each class of equal surroundings
        near = near[lead]
        a, b = self._extent(near)
        mine = lead[group]
        later = keys[order] > keys[mine]
        fits = later & (a + b + 1 >= self.length)[group]
        rest = order[fits]
        low[rest], high[rest] = -a[group[fits]], b[group[fits]]
        source[rest] = keys[mine[fits]]
        low[lead], high[lead], source[lead] = self._similar(code[lead], keys[lead], near, a, b)
        # what the first of a class has in earlier documents, the others of the class have too
        source[rest] = np.minimum(source[rest], source[mine[fits]])
        same = order[~fits]
        low[same], high[same], source[same] = (x[mine[~fits]] for x in (low, high, source))
        return low, high, source

    def _shared(self, group: np.ndarray, near: np.ndarray) -> tuple[int, np.ndarray]:
        """How many shingles occur in a group more than once, and at each place the number of its shingle, or
        how many there are if it is none of them."""
        tagged = near if not group[-1] else (group.astype(np.uint64) << np.uint64(24))[:, None] | near
        flat = np.sort(tagged, axis=None)
        flat = flat[1:][flat[1:] == flat[:-1]]
        flat = flat[np.append(True, flat[1:] != flat[:-1])[:len(flat)]]
        flat = flat[flat & flat.dtype.type(0xFFFFFF) != 0]
        place, ended = np.empty(near.shape, np.int32), np.append(flat, np.iinfo(flat.dtype).max)
        for i in range(0, len(near), _PAIRS):
            at = np.searchsorted(flat, tagged[i:i + _PAIRS])
            place[i:i + _PAIRS] = np.where(ended[at] == tagged[i:i + _PAIRS], at, len(flat))
        return len(flat), place

    def _enough(self, held: np.ndarray) -> np.ndarray:
        """For each window of each row: whether enough of its places are held."""
        upto = np.zeros((len(held), held.shape[1] + 1), np.uint8)
        np.cumsum(held, 1, np.uint8, upto[:, 1:])
        return upto[:, self.length:] - upto[:, :-self.length] >= self.enough

    def _bitmaps(self, near: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """The bit of the shingle at each place, one that no bitmap has if it is not shared; and the bitmap of
        each class, one after the other."""
        bits = np.empty(near.shape, np.uint16)
        maps = np.zeros((len(near), _BITS // 8 + 1), np.uint8)
        for i in range(0, len(near), _PAIRS):
            part = slice(i, i + _PAIRS)
            bits[part] = np.where(shared[part], (near[part] * np.uint32(0x9E3779B1)) >> np.uint32(22), _BITS)
            held = np.zeros((len(bits[part]), _BITS + 8), bool)
            held[np.arange(len(held))[:, None], bits[part]] = True
            held[:, _BITS:] = False
            maps[part] = np.packbits(held, axis=1, bitorder="little")
        return bits, maps.ravel()

    def _extent(self, near: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        held = near != 0
        return held[:, :self.reach].sum(1), held[:, self.reach + 1:].sum(1)

    def _similar(self, code, keys, near, a, b):
        """Per class: the range of its windows around c that earlier classes with the same minimum have,
        and the earliest such class. Whole groups are searched, some thousand classes at a time."""
        low, high = np.full(len(keys), 127, np.int8), np.full(len(keys), -128, np.int8)
        source = np.full(len(keys), np.iinfo(np.int64).max)
        order = np.lexsort((keys, code))
        c = code[order]
        edges = np.flatnonzero(np.append(True, c[1:] != c[:-1])) if len(c) else np.zeros(0, np.int64)
        sizes = np.diff(np.append(edges, len(c)))
        order, sizes = order[np.repeat(sizes > 1, sizes)], sizes[sizes > 1]
        ends = np.cumsum(sizes)
        i = done = 0
        while i < len(sizes):
            j = max(i + 1, int(np.searchsorted(ends, done + _CLASSES, "right")))
            rows, done = order[done:ends[j - 1]], int(ends[j - 1])
            low[rows], high[rows], source[rows] = self._rounds(sizes[i:j], keys[rows], near[rows], a[rows], b[rows])
            i = j
        return low, high, source

    def _rounds(self, sizes, keys, near, a, b):
        """`_similar` for whole groups, each in the order of its keys. A class meets the earliest
        classes of its group first, then ever more, until no other could add to its range: a window
        can be repeated only if enough of its shingles occur in earlier classes at all, and only
        windows outside the range found so far matter."""
        n, length, few = len(keys), self.length, self.length - self.enough + 1
        group, start = np.repeat(np.arange(len(sizes)), sizes), np.repeat(np.cumsum(sizes) - sizes, sizes)
        size, place = self._shared(group, near)  # place `size`: no other class has it
        fits, able = np.zeros((n, length), bool), np.zeros((n, length), bool)
        w = np.arange(length)
        for i in range(0, n, _PAIRS):
            part = slice(i, i + _PAIRS)
            fits[part] = (w >= self.reach - a[part, None]) & (w <= b[part, None])
            able[part] = fits[part] & self._enough(place[part] < size)
        some = able.any(1)  # the others are neither repeated nor a source
        held = np.sort((place[some].astype(np.int64) * n + np.flatnonzero(some)[:, None]).ravel())
        held = held[:np.searchsorted(held, size * n)]
        held = held[np.append(True, held[1:] != held[:-1])[:len(held)]]  # each shingle once for each class
        freq = np.append(np.bincount(held // n, minlength=size), 1)
        begin = np.cumsum(freq[:-1]) - freq[:-1]
        least = np.full(size + 1, np.iinfo(np.int64).max)
        least[:-1][freq[:-1] > 0] = keys[held[begin[freq[:-1] > 0]] % n]
        before = np.concatenate((np.zeros((1, length), np.int32), np.cumsum(fits, 0, dtype=np.int32)))
        bits, maps = self._bitmaps(near, place < size)
        for i in range(0, n, _PAIRS):
            part = slice(i, i + _PAIRS)
            able[part] &= self._enough(least[place[part]] < keys[part, None])
            able[part] &= before[:-1][part] > before[start[part]]  # an earlier class reaches as far
        del fits, before
        first, last = able.argmax(1), length - 1 - able[:, ::-1].argmax(1)
        some = able.any(1)
        left, right = np.full(n, length), np.full(n, -1)  # first and last repeated window so far
        source = np.full(n, np.iinfo(np.int64).max)

        def may(x, y):
            """Which pairs can make y's source earlier or its range wider, as far as bitmaps tell."""
            out = np.zeros(len(x), bool)
            for i in range(0, len(x), _PAIRS):
                x1, y1 = x[i:i + _PAIRS], y[i:i + _PAIRS]
                adds = (keys[x1] < source[y1])[:, None] | (w < left[y1, None]) | (w > right[y1, None])
                adds &= able[y1] & (w >= self.reach - a[x1, None]) & (w <= b[x1, None])
                adds &= self._enough(_held(maps, x1, bits[y1]))
                hope = np.flatnonzero(adds.any(1))
                out[i + hope] = (adds[hope] & self._enough(_held(maps, y1[hope], bits[x1[hope]]))).any(1)
            return out

        from_, to = 0, 4
        while from_ < sizes.max() and some.any():
            live = np.flatnonzero(some & (np.arange(n) - start > from_))
            new = right[live] < 0
            u = np.concatenate((first[live], right[live][~new] + 1))
            v = np.concatenate((np.minimum(left[live] - 1, last[live]), last[live][~new]))
            row = np.concatenate((live, live[~new]))
            wide = v - u >= (length + 1) // 2  # so that all windows of a range share half of their places
            middle = (u + v) // 2
            row, u, v = (np.concatenate(x) for x in (
                (row, row[wide]), (u, middle[wide] + 1), (np.where(wide, middle, v), v[wide])))
            row, u, v = row[u <= v], u[u <= v], v[u <= v]
            later, want = self._rarest(row, u, v, place, freq, few, size + 1)
            later, want = later[want < size], want[want < size]
            lo = np.searchsorted(held, want * n + start[later] + from_)
            many = np.searchsorted(held, want * n + np.minimum(start[later] + to, later)) - lo
            cost = np.cumsum(many)
            i = 0
            while i < len(want):  # some postings at a time
                j = max(i + 1, int(np.searchsorted(cost, (cost[i - 1] if i else 0) + _POSTINGS, "right")))
                m = many[i:j]
                x = held[np.repeat(lo[i:j] - np.cumsum(m) + m, m) + np.arange(m.sum())] % n
                both = np.sort(np.repeat(later[i:j], m) * n + x)
                both = both[np.append(True, both[1:] != both[:-1])[:len(both)]]
                y, x = both // n, both % n
                use = (keys[x] < keys[y]) & (np.minimum(a[x], a[y]) + np.minimum(b[x], b[y]) + 1 >= length)
                x, y, k = x[use], y[use], 1
                # The earliest class that has a window of y is its source; once that is found only windows outside
                # y's range matter: the classes that reach furthest come first and spare those that resemble them.
                while len(x):
                    early = keys[x] < source[y]
                    from_w, to_w = np.maximum(first[y], self.reach - a[x]), np.minimum(last[y], b[x])
                    use = early | (from_w <= np.minimum(left[y] - 1, to_w)) | (np.maximum(right[y] + 1, from_w) <= to_w)
                    if k == 1:
                        use[use] = may(x[use], y[use])
                    x, y, from_w, to_w, early = (z[use] for z in (x, y, from_w, to_w, early))
                    best = np.where(early, _ranked(y * 2 + early, x), np.minimum(_ranked(y, from_w), _ranked(y, -to_w))) < k
                    x1, y1 = x[best], y[best]
                    use = may(x1, y1) if k > 1 else slice(None)
                    for x1, y1, begins, ends in self._verified(x1[use], y1[use], near, a, b):
                        np.minimum.at(left, y1, begins + self.reach)
                        np.maximum.at(right, y1, ends)
                        np.minimum.at(source, y1, keys[x1])
                    x, y, k = x[~best], y[~best], 4 * k
                i = j
            from_, to = to, 4 * to
        hit = right >= 0
        return (np.where(hit, left - self.reach, 127).astype(np.int8), np.where(hit, right, -128).astype(np.int8), source)

    def _rarest(self, row, u, v, place, freq, few, size) -> tuple[np.ndarray, np.ndarray]:
        """Classes and the rarest shingles of which a class that has one of their windows u to v must
        have one: of the places that all these windows share, fewer than `few` may be missing."""
        out = [np.zeros(0, np.int64)]
        at = np.arange(place.shape[1])
        for i in range(0, len(row), _CLASSES):
            p = place[row[i:i + _CLASSES]]
            f = freq[p]
            f[(at < v[i:i + _CLASSES, None]) | (at >= u[i:i + _CLASSES, None] + self.length)] = np.iinfo(f.dtype).max
            rare = np.take_along_axis(p, np.argpartition(f, few - 1, axis=1)[:, :few], 1)
            out.append((rare + row[i:i + _CLASSES, None] * size).ravel())
        chosen = np.unique(np.concatenate(out))
        return chosen // size, chosen % size

    def _verified(self, left, right, near, a, b):
        """The pairs (earlier, later) that have repeated windows, and the range of those around the
        later one's c."""
        reach, n = self.reach, self.length
        at = np.arange(2 * reach + 1)[:, None]  # one row for each place, one column for each pair
        starts = at[:len(at) - n + 1]
        for k in range(0, len(left), 256):
            i, j = left[k:k + 256], right[k:k + 256]
            from_, to = reach - np.minimum(a[i], a[j]), reach + np.minimum(b[i], b[j])
            inside = (at >= from_) & (at <= to)
            x, y = near[i].T, near[j].T
            x = np.where(inside & (x != 0), x, np.uint32(1 << 24))  # no shingle, and another for y
            y = np.where(inside & (y != 0), y, np.uint32(1 << 25))
            hits = np.zeros(x.shape, bool), np.zeros(y.shape, bool)
            for p in range(len(x)):
                same = y == x[p]
                hits[0][p] = same.any(0)
                np.logical_or(hits[1], same, out=hits[1])
            good = (starts >= from_) & (starts + n - 1 <= to)
            for hit in hits:
                upto = np.concatenate((np.zeros((1, len(i)), np.int16), np.cumsum(hit, 0, dtype=np.int16)))
                good &= upto[n:] - upto[:-n] >= self.enough
            some = good.any(0)
            if some.any():
                g = good[:, some]
                lo = g.argmax(0) - reach
                hi = len(g) - 1 - g[::-1].argmax(0) + n - 1 - reach
                yield i[some], j[some], lo.astype(np.int8), hi.astype(np.int8)

    def results(self, run: Run, found: Anchors, entries: Entries, verdicts: dict[int, bytes]) -> pa.Table:
        at, a, b = _place(found.places)
        low, high = np.full(len(at), 127, np.int64), np.full(len(at), -128, np.int64)
        source = np.full(len(at), np.iinfo(np.int64).max)
        order = np.argsort(entries.buckets, kind="stable")
        bucket = entries.buckets[order]
        edges = np.flatnonzero(np.append(True, bucket[1:] != bucket[:-1])[:len(bucket)])
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(bucket)]):
            rows = order[i:j]
            lo, hi, who = unpack(verdicts[int(bucket[i])], "i1", "i1", "<i8")
            e = entries.entry[rows]
            low[rows], high[rows], source[rows] = lo[e], hi[e], who[e]
        later = (run.keys[found.docs] > entries.first) & (a + b + 1 >= self.length)
        low[later], high[later] = -a[later], b[later]
        source[later] = np.minimum(source, entries.first)[later]
        hit = low <= high
        by: dict[int, list[tuple[int, int, int]]] = {}
        first = self._sequence(run)["first"]
        begin = at[hit] + low[hit] - first[at[hit]]
        end = at[hit] + high[hit] - first[at[hit]] + self.shingle
        for d, x, y, who in zip(found.docs[hit].tolist(), begin.tolist(), end.tolist(), source[hit].tolist()):
            by.setdefault(d, []).append((x, y, who))
        keys, counts, kept, passages = [], [], [], []
        for d, text in enumerate(run.texts):
            body = np.frombuffer(text, np.uint8)
            spans = self._joined(by.get(d, []))
            whole = run.copy[d] and not run.nulls[d]
            if not (spans or whole):
                counts.append(None), kept.append(text), passages.append([])
                continue
            starts, ends, _ = words_of(body)
            if whole:
                spans = [(0, len(starts), [int(run.first[d])])] if len(starts) >= self.words else []
            keep = np.ones(len(body), bool)
            rows = []
            for x, y, who in spans:
                stop = int(starts[y]) if y < len(starts) else len(body)
                keep[starts[x]:stop] = False
                rows.append({"start_word": x, "end_word": y, "start_byte": int(starts[x]),
                             "end_byte": int(ends[y - 1]), "sources": who})
            counts.append(len(starts)), kept.append(body[keep].tobytes()), passages.append(rows)
        kind = pa.list_(pa.struct([*[(n, pa.int64()) for n in ("start_word", "end_word", "start_byte", "end_byte")],
                                   ("sources", pa.list_(pa.int64()))]))
        return pa.table({"key": pa.array(run.keys, pa.int64(), mask=run.nulls), "passages": pa.array(passages, kind),
                         "kept": pa.array(kept, pa.binary())})

    @staticmethod
    def _joined(spans: list[tuple[int, int, int]]) -> list[tuple[int, int, list[int]]]:
        """Overlapping or touching word ranges as one, with the documents they come from."""
        out: list[tuple[int, int, set[int]]] = []
        for x, y, who in sorted(spans):
            if out and x <= out[-1][1]:
                out[-1] = (out[-1][0], max(y, out[-1][1]), out[-1][2] | {who})
            else:
                out.append((x, y, {who}))
        return [(x, y, sorted(who)) for x, y, who in out]


def _held(maps: np.ndarray, rows: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """For each row: which of some bits its bitmap has."""
    return maps.take(rows[:, None] * (_BITS // 8 + 1) + (bits >> 3)) >> (bits & 7).astype(np.uint8) & 1


def _wide(rows: np.ndarray) -> np.ndarray:
    """Rows of shingles of three bytes each as numbers."""
    out = np.zeros((len(rows), rows.shape[1] // 3, 4), np.uint8)
    out[:, :, :3] = rows.reshape(len(out), out.shape[1], 3)
    return out.view(np.uint32)[:, :, 0]


def _ranked(group: np.ndarray, value: np.ndarray) -> np.ndarray:
    """Rank of each value inside its group, from zero."""
    order, rank = np.lexsort((value, group)), np.empty(len(group), np.int64)
    g = group[order]
    starts = np.flatnonzero(np.append(True, g[1:] != g[:-1])) if len(g) else np.zeros(0, np.int64)
    rank[order] = np.arange(len(g)) - np.repeat(starts, np.diff(np.append(starts, len(g))))
    return rank


def _place(places: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    return places & ((1 << 40) - 1), places >> 40 & 255, places >> 48 & 255


def find_passages(spark: SparkSession, docs: DataFrame, words: int = WORDS, similar: float = SIMILAR,
                  shingle: int = SHINGLE, functions: int = FUNCTIONS, key: str = "doc_id", text: str = "text",
                  **sizes) -> DataFrame:
    """(key, passages, kept) per document: passages of `words` words or more that an earlier document
    has, in words and bytes with the documents they were matched to, and the text without them."""
    if words - shingle + 1 > 120 or words < shingle:
        raise ValueError("a window is 1 to 120 shingles")
    if not 0.5 <= similar <= 1:
        raise ValueError("similar is 0.5 to 1: below that two windows may share none of their rarest shingles")
    schema = ("key long, passages array<struct<start_word: long, end_word: long, start_byte: long, "
              "end_byte: long, sources: array<long>>>, kept binary")
    method = _Windows(shingle, words, similar, functions)
    return search(spark, docs, method, schema, key, text, **sizes).withColumnRenamed("key", key)


def without_passages(spark: SparkSession, docs: DataFrame, key: str = "doc_id", text: str = "text",
                     **settings) -> DataFrame:
    """`docs` with repeated passages cut from `text`; a document that loses all its words is dropped.

    All columns are returned; other columns are unchanged, also those that describe the text.
    """
    others = [c for c in docs.columns if c not in (key, text)]
    found = find_passages(spark, docs, key=key, text=text, carry=others or [key], **settings)
    left = F.col("kept").cast("string")
    kept = found.where((F.size("passages") == 0) | (F.btrim(left, F.lit(" \t\n\u000b\f\r")) != ""))
    made = {key: F.col(f"`{key}`").cast(docs.schema[key].dataType), text: left}
    return kept.select(*[made[c].alias(c) if c in made else F.col("rest").getField(c).alias(c) for c in docs.columns])
