"""Suffix-array deduplication of byte strings.

Documents are cut down, without loss, to the stretches around which a repeat is still
possible (see ``repeats``), and these are dealt to shards by the content that equal
windows share, so that equal windows always meet. A shard's suffixes are then sorted by
external induced sorting: names of its LMS substrings give their order, and bucket
queues, which go to disk beyond a bound, carry suffixes with the length of the prefix
they share with their neighbour, first through the L-type and then through the S-type
suffixes. Runs of neighbours that share a whole window are one repeated string; its
first place stays.
"""

from __future__ import annotations

import tempfile
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .repeats import BASES, Sums, Windows, _at, chunks, documents_with, ids_back, mix, removed, repeated_windows, smallest, states

#: Bytes from a sentinel on that every window sharing it holds; they make its key.
KEY = 32
#: Bytes whose hash ranks a place among the candidates for a sentinel.
GRAM = 12
#: Starts of windows around a sentinel that are told possible or not by one stretch, which they all hold.
STARTS = 9
#: Bytes of text that a shard has about, and that its queues hold in memory before they go to disk.
SHARD, IN_MEMORY = 2 << 20, 64 << 20
_BYTE = mix(np.arange(1, 257, dtype=np.uint64) * np.uint64(BASES[2]))


def units(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    counts = np.fromiter(map(len, texts), dtype=np.int64, count=len(texts))
    return _BYTE[np.frombuffer(b"".join(texts), dtype=np.uint8)], counts


def sentinels(windows: Windows):
    """Of the places in each window from which KEY bytes lie in it, the one with the smallest hash of GRAM bytes."""
    width = windows.length - windows.after + 1

    def pick(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        values, counts = units(texts)
        starts = np.cumsum(counts) - counts
        first = Sums(values, BASES[0])
        at = smallest(first.each(GRAM), width)
        text = np.repeat(np.arange(len(texts)), counts)
        if len(at):
            at = at[text[: len(at)] == text[width - 1 : width - 1 + len(at)]]
            at = at[np.concatenate([[True], at[1:] != at[:-1]])[: len(at)]]
        t = text[at]
        low, high = starts[t], starts[t] + counts[t]
        ok = (at + windows.after <= high) & (counts[t] >= windows.length)
        p, t, low, high = at[ok], t[ok], low[ok], high[ok]
        key = first.of(p, p + windows.after)
        a, b = np.maximum(p - windows.left, low), np.minimum(p + windows.right, high)
        context = mix(Sums(values, BASES[1]).of(a, b) + ((p - a) * 4096 + (b - p)).astype(np.uint64))
        return t, p - low, key, context

    return pick


class Queues:
    """A monotone priority queue of (suffix, shared prefix) tuples with one bucket a character.

    Tuples of a bucket come out in the order they went in. Beyond ``IN_MEMORY`` bytes what
    is held goes to an unlinked scratch file of the task.
    """

    def __init__(self, alphabet: int):
        self.held: list[list] = [[] for _ in range(alphabet)]
        self.size, self.file = 0, None

    def put(self, c: int, suffix: np.ndarray, shared: np.ndarray) -> None:
        self.held[c].append((suffix, shared))
        self.size += suffix.nbytes + shared.nbytes
        if self.size > IN_MEMORY:
            self.file = self.file or tempfile.TemporaryFile()
            for bucket in self.held:
                for i, block in enumerate(bucket):
                    if isinstance(block[0], np.ndarray):
                        self.file.seek(0, 2)
                        at = self.file.tell()
                        self.file.write(block[0].tobytes() + block[1].tobytes())
                        bucket[i] = (at, len(block[0]))
            self.size = 0

    def pop(self, c: int) -> tuple[np.ndarray, np.ndarray] | None:
        blocks, self.held[c] = self.held[c], []
        out = []
        for first, second in blocks:
            if isinstance(first, np.ndarray):
                self.size -= first.nbytes + second.nbytes
                out.append((first, second))
            else:
                self.file.seek(first)
                out.append((np.frombuffer(self.file.read(4 * second), dtype=np.int32), np.frombuffer(self.file.read(2 * second), dtype=np.int16)))
        if not out:
            return None
        return out[0] if len(out) == 1 else tuple(np.concatenate(x) for x in zip(*out))


class Least:
    """Smallest of any stretch of an array, from the smallest of stretches of powers of two."""

    def __init__(self, values: np.ndarray):
        self.levels = [values]
        while 2 << (len(self.levels) - 1) <= len(values):
            half, last = 1 << (len(self.levels) - 1), self.levels[-1]
            self.levels.append(np.minimum(last[:-half], last[half:]))

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        """Over [start, end), none of them empty."""
        level = np.frexp((end - start).astype(float))[1] - 1
        out = np.empty(len(start), dtype=self.levels[0].dtype)
        for k in np.unique(level):
            i = level == k
            out[i] = np.minimum(self.levels[k][start[i]], self.levels[k][end[i] - (1 << int(k))])
        return out


class Inducer:
    """Induced sorting of the suffixes of ``text`` (small non-negative ints, the last one a unique 0).

    Shared prefixes are exact up to ``cap`` and at least ``cap`` beyond.
    """

    def __init__(self, text: np.ndarray, cap: int):
        self.text, self.cap, self.alphabet, self.carry = text, cap, int(text.max()) + 1, True
        n = len(text)
        change = np.flatnonzero(text[1:] != text[:-1]) + 1
        self.run = np.repeat(np.append(change, n), np.diff(np.concatenate([[0], change, [n]]))).astype(np.int32)  # where the run of equal characters ends
        rising = np.ones(n, dtype=bool)
        inside = self.run < n
        rising[inside] = text[self.run[inside]] > text[inside]
        self.small = rising  # S-type
        self.lms = (np.flatnonzero(rising[1:] & ~rising[:-1]) + 1).astype(np.int32)

    def _spread(self, queues: Queues, since: np.ndarray, block: np.ndarray, shared: np.ndarray, small: bool) -> None:
        """Put the suffixes that start one character before those of ``block`` and are of the
        type asked for. ``shared`` has what each one shares with the one before it, ``since``
        by character the least of that since a suffix was last put there."""
        before = block - 1
        ok = (before >= 0) & (self.small[before] == small)
        c = self.text[block]
        ok &= (self.text[before] <= c) if small else (self.text[before] >= c)
        place = np.flatnonzero(ok)
        if not len(place):
            np.minimum(since, shared.min(), out=since)
            return
        to = self.text[before[place]]
        order = np.argsort(to, kind="stable")
        place, to = place[order], to[order]
        new = np.concatenate([[True], to[1:] != to[:-1]])
        if not self.carry:
            first, suffix = np.flatnonzero(new), before[place]
            for a, b in zip(first.tolist(), [*first[1:].tolist(), len(place)]):
                queues.put(int(to[a]), suffix[a:b], np.zeros(b - a, dtype=np.int16))
            return
        least = Least(shared)
        common = np.empty(len(place), dtype=np.int16)
        later = np.flatnonzero(~new)
        common[later] = least.of(place[later - 1] + 1, place[later] + 1)
        first = np.flatnonzero(new)
        common[first] = np.minimum(since[to[first]], least.of(np.zeros(len(first), dtype=np.int64), place[first] + 1))
        np.minimum(since, shared.min(), out=since)
        ends = np.append(first[1:], len(place))
        last = place[ends - 1] + 1
        rest = last < len(block)
        since[to[first]] = self.cap
        since[to[first[rest]]] = least.of(last[rest], np.full(int(rest.sum()), len(block)))
        common = np.minimum(common + 1, self.cap).astype(np.int16)
        suffix = before[place]
        for a, b in zip(first.tolist(), ends.tolist()):
            queues.put(int(to[a]), suffix[a:b], common[a:b])

    def _runs(self, a: int, b: int) -> int:
        """What an L-type and an S-type suffix of one bucket share: their characters' shorter run."""
        return int(min(self.run[a] - a, self.run[b] - b, self.cap))

    def induce(self, lms: np.ndarray, shared: np.ndarray) -> tuple[np.ndarray, np.ndarray]:
        """All suffixes in order and what each shares with the one before, from the LMS
        suffixes in order and what these share."""
        queues, since = Queues(self.alphabet), np.zeros(self.alphabet, dtype=np.int16)
        seeds = np.searchsorted(self.text[lms], np.arange(self.alphabet + 1))
        large: list[tuple[np.ndarray, np.ndarray]] = []
        for c in range(self.alphabet):
            got, start = [], True
            while (block := queues.pop(c)) is not None:
                suffix, common = block
                if start:
                    common = common.copy()
                    common[0], start = 0, False
                got.append((suffix, common))
                self._spread(queues, since, suffix, common, False)
            mine = tuple(np.concatenate(x) for x in zip(*got)) if got else (np.zeros(0, dtype=np.int32), np.zeros(0, dtype=np.int16))
            large.append(mine)
            a, b = seeds[c], seeds[c + 1]
            if a < b:
                common = shared[a:b].copy()
                common[0] = self._runs(int(mine[0][-1]), int(lms[a])) if len(mine[0]) else 0
                self._spread(queues, since, lms[a:b], common, False)
        queues, since = Queues(self.alphabet), np.zeros(self.alphabet, dtype=np.int16)
        suffixes, commons = [], []
        for c in range(self.alphabet - 1, -1, -1):
            got, start = [], True
            while (block := queues.pop(c)) is not None:
                suffix, common = block
                if start:
                    common = common.copy()
                    common[0], start = 0, False
                got.append((suffix, common))
                self._spread(queues, since, suffix, common, True)
            if c == 0:
                got = [(np.array([len(self.text) - 1], dtype=np.int32), np.zeros(1, dtype=np.int16))]
            low, low_common = large[c]
            small = np.concatenate([s for s, _ in got])[::-1] if got else np.zeros(0, dtype=np.int32)
            small_common = np.concatenate([x for _, x in got])[::-1] if got else np.zeros(0, dtype=np.int16)
            between = self._runs(int(low[-1]), int(small[0])) if len(low) and len(small) else 0
            if len(low):
                down = np.concatenate([[between], low_common[1:][::-1]]).astype(np.int16)
                self._spread(queues, since, low[::-1], down, True)
            elif c == 0:
                self._spread(queues, since, small, np.zeros(1, dtype=np.int16), True)
            suffixes += [small[::-1], low[::-1]]
            # Ascending, the first S-type suffix shares ``between`` with what is below it, the others what they shared when put.
            up = np.concatenate([[between], small_common[:-1]]).astype(np.int16) if len(small) else small_common
            commons += [up[::-1], low_common[::-1]]
        return np.concatenate(suffixes)[::-1], np.concatenate(commons)[::-1]

    def names(self) -> np.ndarray:
        """Ranks of the LMS substrings in text order, equal ones alike: a first induction from unsorted LMS suffixes sorts them."""
        start = self.lms[np.argsort(self.text[self.lms], kind="stable")]
        self.carry = False
        order, _ = self.induce(start, np.zeros(len(start), dtype=np.int16))
        self.carry = True
        which = np.full(len(self.text), -1, dtype=np.int64)
        which[self.lms] = np.arange(len(self.lms))
        order = which[order]
        order = order[order >= 0]
        end = np.append(self.lms[1:] + 1, len(self.text)).astype(np.int64)
        content = Sums(mix(self.text.astype(np.uint64) + np.uint64(BASES[1])), BASES[0]).of(self.lms.astype(np.int64), end)
        content = mix(content + (end - self.lms).astype(np.uint64))[order]
        name = np.empty(len(order), dtype=np.int64)
        name[order] = np.cumsum(np.concatenate([[1], content[1:] != content[:-1]]))
        return name

    def sort(self) -> tuple[np.ndarray, np.ndarray]:
        """Suffixes in order (up to ``cap`` characters) and what each shares with the one before."""
        if len(self.lms) < 2:
            return self.induce(self.lms, np.zeros(len(self.lms), dtype=np.int16))
        rank, step = self.names(), 1
        while 2 * step < self.cap + 8 and rank.max() < len(rank):  # the reduced string, by ranks of doubled stretches of names of two characters or more
            after = np.zeros(len(rank), dtype=np.int64)
            after[:-step] = rank[step:]
            both = rank * (len(rank) + 1) + after
            order = np.argsort(both)
            rank = np.empty(len(rank), dtype=np.int64)
            rank[order] = np.cumsum(np.concatenate([[1], both[order][1:] != both[order][:-1]]))
            step *= 2
        lms = self.lms[np.argsort(rank, kind="stable")]
        return self.induce(lms, self._compared(lms))

    def _compared(self, suffix: np.ndarray) -> np.ndarray:
        """What each suffix shares with the one before it, up to ``cap``, four characters at a time."""
        wide = np.concatenate([self.text, np.zeros(self.cap + 8, dtype=self.text.dtype)]).astype(np.uint64)
        four = wide[:-3] | wide[1:-2] << np.uint64(16) | wide[2:-1] << np.uint64(32) | wide[3:] << np.uint64(48)
        out = np.full(len(suffix), self.cap, dtype=np.int16)
        out[:1] = 0
        a, b, row = suffix[:-1].astype(np.int64), suffix[1:].astype(np.int64), np.arange(1, len(suffix))
        for k in range(0, self.cap, 4):
            apart = four[a + k] ^ four[b + k]
            differ = apart != 0
            x = apart[differ]
            out[row[differ]] = np.minimum(k + np.bitwise_count((x & -x) - np.uint64(1)).astype(np.int64) // 16, self.cap)
            a, b, row = a[~differ], b[~differ], row[~differ]
            if not len(row):
                break
        return out


def possible(contexts: list[bytes], key: np.ndarray, before: np.ndarray, windows: Windows) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Which contexts may hold a window that another one of their key holds around its sentinel, and from where to where in them.

    ``before`` has the bytes of each context that precede its sentinel. Windows of neighbouring
    starts all hold the stretch that the first and the last of them have in common; where no
    other context has that stretch at the same distance from its sentinel, none of them is a repeat.
    """
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    base = np.cumsum(sizes) - sizes
    sums = Sums(units(contexts)[0], BASES[0])
    low, high = np.full(len(contexts), windows.length), np.full(len(contexts), -1)
    for first in range(-windows.left, 1, STARTS):
        last = min(first + STARTS - 1, 0)
        start, end = before + last, before + first + windows.length
        row = np.flatnonzero((start >= 0) & (end <= sizes))
        both = mix(sums.of(base[row] + start[row], base[row] + end[row]) ^ key[row].view(np.uint64))
        _, which, n = np.unique(both, return_inverse=True, return_counts=True)
        row = row[n[which] > 1]
        low[row] = np.minimum(low[row], np.maximum(before[row] + first, 0))
        high[row] = np.maximum(high[row], np.minimum(before[row] + last + windows.length, sizes[row]))
    row = np.flatnonzero(high - low >= windows.length)
    return row, low[row], high[row]


def shard_repeats(contexts: list[bytes], doc: np.ndarray, at: np.ndarray, length: int) -> tuple[np.ndarray, np.ndarray]:
    """Places (doc, at) of windows in these contexts that also stand in an earlier place of them.

    ``at`` has each context's document hash and the place of its first byte.
    """
    sizes = np.fromiter(map(len, contexts), dtype=np.int64, count=len(contexts))
    raw = np.frombuffer(b"\0".join(contexts) + b"\0", dtype=np.uint8).astype(np.int16) + 2
    starts = np.cumsum(sizes + 1) - sizes - 1
    raw[starts + sizes] = 1
    suffix, shared = Inducer(np.append(raw, np.int16(0)), length).sort()
    owner = np.repeat(np.arange(len(contexts)), sizes + 1)
    # Neighbours that share a whole window; a shared prefix of that length has no end of a context in it but maybe past the shorter rest.
    below = shared >= length
    several = below | np.append(below[1:], False)
    group, suffix = np.cumsum(~below)[several], suffix[several]
    o = owner[suffix]
    whole = (starts + sizes)[o] - suffix >= length
    group, suffix, o = group[whole], suffix[whole], o[whole]
    d, a = doc[o], at[o] + ((suffix - starts[o]).astype(np.int64) << 2)
    order = np.lexsort((a, d, group))
    group, d, a = group[order], d[order], a[order]
    new = np.concatenate([[True], group[1:] != group[:-1]]) if len(group) else np.zeros(0, dtype=bool)
    first = np.flatnonzero(new)[np.cumsum(new) - 1] if len(group) else np.zeros(0, dtype=np.int64)
    repeat = (d != d[first]) | (a != a[first])
    d, a = d[repeat], a[repeat]
    order = np.lexsort((a, d))
    d, a = d[order], a[order]
    fresh = np.concatenate([[True], (d[1:] != d[:-1]) | (a[1:] != a[:-1])])[: len(d)]
    return d[fresh], a[fresh]


def sorted_repeats(docs: DataFrame, marks: DataFrame, windows: Windows) -> DataFrame:
    """Rows (doc, at) of the windows around open sentinels that stand in an earlier place."""

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, ["doc", "sig", "places"]):
                doc, at, key, before, context = [], [], [], [], []
                for d, sig, places, text in rows:
                    p = np.array(places, dtype=np.int64)
                    a, b = np.maximum(p - windows.left, 0), np.minimum(p + windows.right, len(text))
                    doc += [d] * len(p)
                    at.append(_at(np.full(len(p), sig), a, 0))
                    before.append(p - a)
                    context += [text[i:j] for i, j in zip(a.tolist(), b.tolist())]
                    key += [xxhash.xxh64_intdigest(text[i : i + windows.after]) for i in p.tolist()]
                longs = (np.array(key, dtype=np.uint64).view(np.int64), np.array(doc, dtype=np.int64), np.concatenate(at), np.concatenate(before))
                yield pa.RecordBatch.from_arrays([*map(pa.array, longs), pa.array(context, pa.binary())], names=["key", "doc", "at", "before", "context"])

    def sort(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(*(b[c].to_numpy() for c in ("key", "doc", "at", "before")), b["context"].to_pylist()) for b in batches if b.num_rows]
        if got:
            key, doc, at, before = (np.concatenate([g[i] for g in got]) for i in range(4))
            contexts = [c for g in got for c in g[4]]
            row, low, high = possible(contexts, key, before, windows)
            cut = [contexts[i][j:k] for i, j, k in zip(row.tolist(), low.tolist(), high.tolist())]
            d, a = shard_repeats(cut, doc[row], at[row] + (low << 2), windows.length)
            yield pa.RecordBatch.from_arrays([pa.array(d), pa.array(a)], names=["doc", "at"])

    size = marks.agg(F.sum(F.size("open"))).first()[0] or 0
    shards = max(1, -(-size * (windows.left + windows.right) // SHARD))
    rows = documents_with(docs, marks, F.col("open")).drop("cover").mapInArrow(emit, "key long, doc long, at long, before long, context binary")
    return stored(rows.repartition(shards, "key").mapInArrow(sort, "doc long, at long"), "suffix-repeats")


def without_repeats(docs: DataFrame, length: int = 100) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept) of every document.

    A byte of the UTF-8 text goes if a string of ``length`` bytes that covers it also
    starts earlier: in a document with a smaller id, or earlier in the same one. Strings
    don't cross documents and are judged on the input. ``kept`` is binary. A null text is
    empty; a null id comes before all others; different texts under one id come in the
    order of a hash, and repeated rows each give the same row. Other columns are ignored.
    """
    windows = Windows(length, 0, KEY, True)
    marks = states(docs, windows, sentinels(windows), "byte-states")
    starts = sorted_repeats(docs, marks, windows)
    if marks.where(F.size("hot") > 0).limit(1).count():
        starts = starts.union(repeated_windows(docs, marks, windows, units, F.col("hot"), "byte-windows"))
    gone = removed(docs, marks, starts, length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, spans, kept = [], [], [], []
            for text, stretches in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
                data, out, at, count = text.encode("utf-8", "replace"), [], 0, 0
                for s, e in zip((stretches or [])[::2], (stretches or [])[1::2]):
                    out.append(data[at:s])
                    at, count = min(e, len(data)), count + 1
                out.append(data[at:])
                kept.append(b"".join(out))
                n.append(len(data))
                lost.append(len(data) - len(kept[-1]))
                spans.append(count)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], *(pa.array(x, pa.int64()) for x in (n, lost, spans)), pa.array(kept, pa.binary())], names=["doc_id", "n_bytes", "n_removed", "n_spans", "kept"])

    return gone.select(ids_back().alias("doc_id"), "text", "gone").mapInArrow(apply, "doc_id long, n_bytes long, n_removed long, n_spans long, kept binary")


def digest(docs: DataFrame, length: int = 100) -> DataFrame:
    """Rows (doc_id, n_bytes, n_removed, n_spans, kept_sha256)."""
    return without_repeats(docs, length).select("doc_id", "n_bytes", "n_removed", "n_spans", F.sha2("kept", 256).alias("kept_sha256"))
