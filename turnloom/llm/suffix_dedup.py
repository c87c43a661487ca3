"""Exact substring dedup: bytes covered by a string of `width` bytes that an earlier document holds.

A string belongs to the smallest hash among its short grams, so equal strings have an anchor in
common, and there is one anchor for about every `width` / 4 bytes. Suffixes that start at recurring
anchors are sorted in each run, front-coded (the length shared with the one before, and the rest) and
exchanged; a bucket combines its runs by a loser tree that carries the length each run's head shares
with the last suffix taken. Heads that share different lengths are ordered by these lengths alone;
only bytes beyond the known common prefix are ever compared. The merged order and its shared lengths
say which suffixes agree over how many bytes; with the bytes to the left of the anchor this decides,
for every string that holds the anchor, which document has it first.

Suffixes are cut at `width` bytes, since no longer match is asked for; buckets go by the anchor's
hash, so that no range of common prefixes is larger than others.

Defined results: matches never cross documents; a null text is empty; a null key neither removes nor
is removed from; rows with equal key are not earlier than each other; an empty table gives no rows.
"""

from __future__ import annotations

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession

from turnloom.llm.runs import Anchors, Entries, Run, pack, search, unpack

WIDTH = 50
_CHUNK = 1 << 21  # bytes of text whose grams are hashed at once
_ANCHORS = 1 << 16  # anchors whose surroundings are held at once
_BASE = np.uint64(0x9E3779B97F4A7C15)
_MIX = np.uint64(0xD6E8FEB86659FD93)


def _grams(data: np.ndarray, n: int) -> np.ndarray:
    """Hash of the n bytes from each position on, by doubling; the last n - 1 are partial."""
    part, size, out, done = data.astype(np.uint64) * _MIX + np.uint64(1), 1, None, 0
    power = np.full(1, _BASE)  # an array, whose products wrap silently
    while True:
        if n & size:
            if out is None:
                out, done = part.copy(), size
            else:
                moved = np.zeros_like(out)
                moved[:len(out) - size] = out[size:]
                out, done = part * _power(done) + moved, done + size
        if 2 * size > n:
            break
        moved = np.zeros_like(part)
        moved[:len(part) - size] = part[size:]
        part = part * power + moved
        power *= power
        size *= 2
    out ^= out >> np.uint64(32)
    out *= _MIX
    out ^= out >> np.uint64(29)
    return out


def _power(n: int) -> np.uint64:
    return np.uint64(pow(int(_BASE), n, 1 << 64))


def _spread(hashes: np.ndarray) -> np.ndarray:
    """Other hashes, one to one. Smallest hashes have small high bits, by which buckets are dealt out."""
    hashes = (hashes ^ (hashes >> np.uint64(32))) * _MIX
    return hashes ^ (hashes >> np.uint64(29))


def window_minima(hashes: np.ndarray, valid: np.ndarray, count: int) -> np.ndarray:
    """Positions of the leftmost smallest hash of each window of `count`; `valid` says where windows
    start."""
    least, place, size = hashes, np.arange(len(hashes)), 1
    while size < min(count, len(hashes)):
        step = min(size, count - size)  # the last step overlaps
        left, right = least[:-step], least[step:]
        first = left <= right
        least, place = np.where(first, left, right), np.where(first, place[:-step], place[step:])
        size += step
    taken = np.zeros(len(hashes), bool)
    taken[place[valid[:len(place)]]] = True
    return np.flatnonzero(taken)


class _Suffixes:
    """The method that `runs.search` drives."""

    def __init__(self, width: int):
        self.width, self.gram = width, max(1, width // 2 - 1)
        self.left = width - self.gram  # bytes before the anchor that a string can hold

    def anchors(self, run: Run) -> Anchors:
        out: tuple[list, list, list] = ([], [], [])
        group: list[int] = []
        size = 0
        for i, text in enumerate(run.texts):
            if run.copy[i] or len(text) < self.width:
                continue
            group.append(i)
            size += len(text)
            if size >= _CHUNK:
                self._anchors(run, group, out)
                group, size = [], 0
        if group:
            self._anchors(run, group, out)
        joined = [np.concatenate(o) if o else np.zeros(0, np.int64) for o in out]
        return Anchors(joined[0].astype(np.uint64), joined[1], joined[2])

    def _anchors(self, run: Run, group: list[int], out: tuple[list, list, list]) -> None:
        lengths = np.array([len(run.texts[i]) for i in group], np.int64)
        ends = np.cumsum(lengths)
        data = np.frombuffer(b"".join([run.texts[i] for i in group]) + bytes(self.width), np.uint8)
        valid = np.zeros(len(data), bool)
        valid[:ends[-1]] = True
        for back in range(1, self.width):
            valid[ends - back] = False
        hashes = _grams(data, self.gram)
        at = window_minima(hashes, valid, self.width - self.gram + 1)
        doc = np.searchsorted(ends, at, "right")
        out[0].append(_spread(hashes[at]))
        out[1].append(np.array(group, np.int64)[doc])
        out[2].append(at - (ends - lengths)[doc])

    def entries(self, run: Run, found: Anchors, buckets: np.ndarray) -> Entries:
        n, left, width = len(found.docs), self.left, self.width
        entry, least, messages = np.zeros(n, np.int64), np.zeros(n, np.int64), {}
        if not n:
            return Entries(messages, buckets, entry, least)
        used = np.unique(found.docs)
        start = np.zeros(len(run.texts), np.int64)
        lengths = np.array([len(run.texts[i]) for i in used], np.int64)
        start[used] = left + np.concatenate(([0], np.cumsum(lengths + left + width)[:-1]))
        gap = bytes(left + width)
        data = np.frombuffer(bytes(left) + b"".join([x for i in used for x in (run.texts[i], gap)]), np.uint8)
        size = np.zeros(len(run.texts), np.int64)
        size[used] = lengths
        order = np.argsort(buckets, kind="stable")
        edges = np.append(np.flatnonzero(np.append(True, np.diff(buckets[order]) != 0)), n)
        low = 0
        while low < n:  # whole buckets, some thousand anchors at a time
            high = int(edges[max(np.searchsorted(edges, low + _ANCHORS, "right") - 1, np.searchsorted(edges, low, "right"))])
            part = order[low:high]
            entry[part], least[part] = self._messages(run, found, buckets, part, data, start, size, messages)
            low = high
        return Entries(messages, buckets, entry, least)

    def _messages(self, run: Run, found: Anchors, buckets, part, data, start, size, messages: dict[int, bytes]):
        """Adds the messages of some whole buckets; the entry and least key of each of their anchors."""
        n, left, width = len(part), self.left, self.width
        docs, places = found.docs[part], found.places[part]
        # suffix, its length, then the bytes to the left from the anchor outwards and their number
        shape = np.zeros((n, width + left + 2), np.uint8)
        at = start[docs] + places
        shape[:, :width] = data[at[:, None] + np.arange(width)]
        shape[:, width + 1:-1] = data[at[:, None] - np.arange(1, left + 1)]
        shape[:, width], shape[:, -1] = np.minimum(size[docs] - places, width), np.minimum(places, left)
        whole = shape.view(f"S{shape.shape[1]}").ravel()
        rank = np.empty(n, np.int64)
        rank[np.argsort(whole, kind="stable")] = np.arange(n)
        order = np.lexsort((rank, buckets[part]))
        shape, b, keys = shape[order], buckets[part][order], run.keys[docs[order]]
        new = np.append(True, (b[1:] != b[:-1]) | (shape[1:] != shape[:-1]).any(1))
        starts = np.flatnonzero(new)
        first, name = np.minimum.reduceat(keys, starts), np.cumsum(new) - 1
        shape, b = shape[starts], b[starts]
        edges = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(b)]):
            messages[int(b[i])] = self._front_coded(shape[i:j], first[i:j])
        entry, least = np.zeros(n, np.int64), np.zeros(n, np.int64)
        entry[order] = name - np.repeat(edges, np.diff(np.append(edges, len(b))))[name]
        least[order] = first[name]
        return entry, least

    def _front_coded(self, shape: np.ndarray, keys: np.ndarray) -> bytes:
        suffix, width = shape[:, :self.width], self.width
        same = np.zeros((len(suffix), width), bool)
        same[1:] = suffix[1:] == suffix[:-1]
        shared = np.where(same.all(1), width, np.argmin(same, 1)).astype(np.uint8)
        rest = suffix[np.arange(width) >= shared[:, None]]
        return pack(shared, shape[:, width], shape[:, -1], keys.astype("<i8"), rest,
                    np.ascontiguousarray(shape[:, width + 1:-1].T))

    def _decoded(self, message: bytes):
        shared, after, before, keys, rest, near = unpack(message, "u1", "u1", "u1", "<i8", "u1", "u1")
        return shared.astype(np.int64), after, before, keys, rest, near.reshape(self.left, -1).T

    def merge(self, parts: list[bytes]) -> list[bytes]:
        runs = [self._decoded(p) for p in parts]
        taken, lengths = merge_runs([(r[0], r[4]) for r in runs], self.width)
        base = np.cumsum([0, *[len(r[3]) for r in runs]])
        after, before, keys = (np.concatenate([r[i] for r in runs]) for i in (1, 2, 3))
        near = np.concatenate([r[5] for r in runs])
        order = np.concatenate([np.arange(base[r] + i, base[r] + j) for r, i, j in taken])
        shared = np.concatenate([np.append(n, np.full(j - i - 1, self.width))
                                 for n, (_, i, j) in zip(lengths, taken)])
        masks = np.zeros(len(order), np.uint64)
        masks[order] = self._judge(shared, after[order], before[order], keys[order], near[order])
        return [pack(masks[i:j]) for i, j in zip(base[:-1], base[1:])]

    def _judge(self, shared, after, before, keys, near) -> np.ndarray:
        """Bit s of a mask: the string that starts s bytes before the anchor is in an earlier document."""
        masks, side = np.zeros(len(keys), np.uint64), np.zeros(len(keys), np.uint64)
        for s in range(self.left + 1):
            if s:
                side = (side ^ near[:, s - 1].astype(np.uint64)) * _MIX
                side ^= side >> np.uint64(31)
            group = np.cumsum(shared < self.width - s).astype(np.uint64)
            code = (group * _BASE) ^ side
            able = np.flatnonzero((after >= self.width - s) & (before >= s))
            if len(able) < 2:
                continue
            rank = able[np.argsort(code[able], kind="stable")]
            c = code[rank]
            starts = np.flatnonzero(np.append(True, c[1:] != c[:-1]))
            least = np.repeat(np.minimum.reduceat(keys[rank], starts), np.diff(np.append(starts, len(c))))
            masks[rank] |= (least < keys[rank]).astype(np.uint64) << np.uint64(s)
        return masks

    def results(self, run: Run, found: Anchors, entries: Entries, verdicts: dict[int, bytes]) -> pa.Table:
        size = np.array([len(t) for t in run.texts], np.int64)
        ends = np.cumsum(size)
        begun = np.zeros(int(size.sum()), bool)  # where a string starts that an earlier document has
        if len(found.docs):
            bits = self._bits(run, found, entries, verdicts, size)
            at = (ends - size)[found.docs] + found.places
            for s in range(self.left + 1):
                begun[at[(bits >> np.uint64(s)) & np.uint64(1) == 1] - s] = True
        whole = run.copy & ~run.nulls & (size >= self.width)
        kept, span_starts, span_ends, span_count = [], [], [], [0]
        for i, text in enumerate(run.texts):
            gone = self._covered(begun[ends[i] - size[i]:ends[i]])
            if whole[i]:
                kept.append(b"")
                span_starts.append([0]), span_ends.append([size[i]])
            elif gone.any():
                edge = np.flatnonzero(np.diff(np.concatenate(([0], gone.astype(np.int8), [0]))))
                kept.append(np.frombuffer(text, np.uint8)[~gone].tobytes())
                span_starts.append(edge[::2]), span_ends.append(edge[1::2])
            else:
                kept.append(text)
                span_starts.append([]), span_ends.append([])
            span_count.append(span_count[-1] + len(span_starts[-1]))
        flat = [pa.array(np.concatenate(x).astype(np.int64) if x else [], pa.int64()) for x in (span_starts, span_ends)]
        spans = pa.ListArray.from_arrays(pa.array(span_count, pa.int32()),
                                         pa.StructArray.from_arrays(flat, names=["start", "end"]))
        return pa.table({"key": pa.array(run.keys, pa.int64(), mask=run.nulls), "n_bytes": pa.array(size),
                         "spans": spans, "kept": pa.array(kept, pa.binary())})

    def _covered(self, begun: np.ndarray) -> np.ndarray:
        """The bytes of a text that lie in one of the strings that start at `begun`."""
        if not begun.any():
            return begun
        upto = np.cumsum(begun, dtype=np.int32)
        upto[self.width:] -= upto[:-self.width].copy()
        return upto > 0

    def _bits(self, run: Run, found: Anchors, entries: Entries, verdicts: dict[int, bytes], size) -> np.ndarray:
        bucket = entries.buckets
        bits = np.zeros(len(found.docs), np.uint64)
        order = np.argsort(bucket, kind="stable")
        b = bucket[order]
        edges = np.flatnonzero(np.append(True, b[1:] != b[:-1]))
        for i, j in zip(edges.tolist(), [*edges[1:].tolist(), len(b)]):
            rows = order[i:j]
            bits[rows] = unpack(verdicts[int(b[i])], "<u8")[0][entries.entry[rows]]
        # the same context in an earlier document of the run: every string that fits
        later = np.flatnonzero(run.keys[found.docs] > entries.first)
        before, after = found.places[later], (size[found.docs] - found.places)[later]
        full = np.zeros(len(later), np.uint64)
        for s in range(self.left + 1):
            full |= ((before >= s) & (after >= self.width - s)).astype(np.uint64) << np.uint64(s)
        bits[later] = full
        return bits


def merge_runs(runs: list[tuple[np.ndarray, np.ndarray]], width: int) -> tuple[list[tuple[int, int, int]], list[int]]:
    """Sorted front-coded runs (shared lengths, remaining bytes) merged by a loser tree.

    Returns what is taken in order, as (run, from, to) over equal suffixes of one run, and for each
    the length it shares with the one taken before. A node of the tree holds the run that lost there
    and the length its head shares with the suffix that beat it; when the winner moves on, heads that
    share more with it than the new one does win without a look at their bytes.
    """
    heads = []
    for shared, rest in runs:
        starts = np.flatnonzero(shared < width) if len(shared) else np.zeros(0, np.int64)
        if len(shared):
            starts = np.unique(np.concatenate(([0], starts)))
        ends = np.append(starts[1:], len(shared))
        offsets = np.concatenate(([0], np.cumsum(width - shared)))
        heads.append((shared.tolist(), rest.tobytes(), starts.tolist(), ends.tolist(), offsets.tolist()))
    leaves = 1
    while leaves < max(1, len(runs)):
        leaves *= 2
    suffix: list[bytes | None] = [None] * leaves  # each run's head in full
    known = [0] * leaves  # what it shares with the last suffix taken
    turn = [-1] * leaves

    def step(run: int) -> bool:
        """The run's next suffix; it shares `shared` bytes with the run's one before, the last taken."""
        shared, rest, starts, _, offsets = heads[run]
        turn[run] += 1
        if turn[run] >= len(starts):
            suffix[run] = None
            return False
        i = starts[turn[run]]
        n = shared[i] if turn[run] else 0
        suffix[run] = (suffix[run][:n] if n else b"") + rest[offsets[i]:offsets[i] + width - n]
        known[run] = n
        return True

    def play(a: int, b: int) -> tuple[int, int]:
        """(winner, loser); the loser's known length becomes what it shares with the winner."""
        x, y = suffix[a], suffix[b]
        if x is None or y is None:
            return (b, a) if x is None else (a, b)
        if known[a] != known[b]:  # the one that shares more with the last taken comes first
            return (a, b) if known[a] > known[b] else (b, a)
        n = known[a]
        if x[n:] == y[n:]:
            known[b] = width
            return a, b
        while x[n] == y[n]:
            n += 1
        if x[n] < y[n]:
            known[b] = n
            return a, b
        known[a] = n
        return b, a

    for run in range(len(runs)):
        step(run)
    tree = [0] * leaves  # losers; tree[0] the winner
    if leaves == 1:
        tree[0] = 0
    else:
        level = list(range(leaves))
        at = leaves
        while len(level) > 1:
            at //= 2
            winners = []
            for i in range(0, len(level), 2):
                won, lost = play(level[i], level[i + 1])
                tree[at + i // 2] = lost
                winners.append(won)
            level = winners
        tree[0] = level[0]
    taken, lengths = [], []
    while suffix[tree[0]] is not None:
        run = tree[0]
        _, _, starts, ends, _ = heads[run]
        taken.append((run, starts[turn[run]], ends[turn[run]]))
        lengths.append(known[run] if len(taken) > 1 else 0)
        step(run)
        node = (run + leaves) // 2
        while node:
            won, lost = play(run, tree[node])
            tree[node], run = lost, won
            node //= 2
        tree[0] = run
    return taken, lengths


def remove_repeats(spark: SparkSession, docs: DataFrame, width: int = WIDTH, key: str = "doc_id",
                   text: str = "text", **sizes) -> DataFrame:
    """(key, n_bytes, spans, kept): the maximal removed byte spans of every text and the bytes left."""
    if not 2 <= width <= 120:
        raise ValueError("width is 2 to 120 bytes")
    schema = "key long, n_bytes long, spans array<struct<start: long, end: long>>, kept binary"
    return search(spark, docs, _Suffixes(width), schema, key, text, **sizes).withColumnRenamed("key", key)
