"""Finding repeated windows of a corpus through shared sentinels.

Both substring operators look for windows of a fixed length (of words, of bytes) that
occur again. Each document picks sentinels by rules that look only at what stands in a
window, so equal windows share a sentinel at the same place in them. A sentinel has a
key, the hash of the stretch around it that every such window holds, and a context hash
over all that any such window can hold. Rows of keys meet in one shuffle:

* the same key and context as in an earlier place: every window of the context is a repeat;
* the same key with another context: some windows may be, and only these go on to be
  compared in full, from one place per context;
* a key of its own: nothing around this sentinel occurs elsewhere.

Rows that a task finds settled among its own go through the shuffle under a key of
their own, so that a stretch found in a third of all documents doesn't meet in one task.
"""

from __future__ import annotations

from collections.abc import Callable, Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from .common import beside, stored

#: Bytes of text that a task holds as arrays at a time; a longer document is held whole.
CHUNK = 1 << 20
OPEN, REPEAT, HOT = 1, 2, 3
#: Contexts from which on a key counts as hot: its places are compared window by window.
HOT_CONTEXTS = 4096
_M32 = (1 << 32) - 1


@dataclass(frozen=True)
class Windows:
    """Windows of ``length`` units; their shared sentinel has at least ``before`` units of the window before it and ``after`` from it on."""

    length: int
    before: int
    after: int
    #: Whether an earlier place in the same document counts.
    within: bool

    @property
    def left(self) -> int:
        return self.length - self.after

    @property
    def right(self) -> int:
        return self.length - self.before


def mix(x: np.ndarray) -> np.ndarray:
    """Finaliser that spreads every bit of a 64-bit value over all others."""
    x = (x ^ (x >> np.uint64(30))) * np.uint64(0xBF58476D1CE4E5B9)
    x = (x ^ (x >> np.uint64(27))) * np.uint64(0x94D049BB133111EB)
    return x ^ (x >> np.uint64(31))


class Sums:
    """Hashes of any stretch of a sequence from prefix sums of its units times powers of an odd base."""

    _powers: dict[int, tuple[np.ndarray, np.ndarray]] = {}

    def __init__(self, units: np.ndarray, base: int):
        n = len(units) + 1
        if base not in self._powers or len(self._powers[base][0]) < n:
            size = 1 << n.bit_length()
            self._powers[base] = tuple(np.multiply.accumulate(np.full(size, b, dtype=np.uint64)) for b in (base, pow(base, -1, 1 << 64)))
        power, self.inverse = self._powers[base]
        self.sums = np.zeros(n, dtype=np.uint64)
        np.cumsum(units * power[: n - 1], out=self.sums[1:])

    def of(self, start: np.ndarray, end: np.ndarray) -> np.ndarray:
        return mix((self.sums[end] - self.sums[start]) * self.inverse[start])

    def each(self, width: int) -> np.ndarray:
        """Hash of every stretch of ``width`` units."""
        n = max(0, len(self.sums) - width)
        return mix((self.sums[width : width + n] - self.sums[:n]) * self.inverse[:n])


BASES = (0x9E3779B97F4A7C15, 0xD6E8FEB86659FD93, 0xC2B2AE3D27D4EB4F)


def smallest(value: np.ndarray, width: int) -> np.ndarray:
    """Place of the smallest of each ``width`` neighbouring values, the last one of equal ones."""
    n = len(value)
    if n < width:
        return np.zeros(0, dtype=np.int64)
    low = np.uint64((1 << 28) - 1)
    best = (value & ~low) | (low - np.arange(n, dtype=np.uint64))
    have = 1
    while have < width:
        step = min(have, width - have)
        best = np.minimum(best[: len(best) - step], best[step:])
        have += step
    return (low - (best & low)).astype(np.int64)


def chunks(batch: pa.RecordBatch, columns: list[str]) -> Iterator[list[tuple]]:
    """Rows of a batch, text last, as bytes, in groups of about CHUNK bytes."""
    held, size = [], 0
    for row in zip(*(batch[c].to_pylist() for c in columns), batch["text"].to_pylist()):
        data = (row[-1] or "").encode("utf-8", "replace")
        held.append((*row[:-1], data))
        size += len(data)
        if size >= CHUNK:
            yield held
            held, size = [], 0
    if held:
        yield held


def identified(docs: DataFrame) -> DataFrame:
    """Rows (doc, sig, text): the id, null as the smallest, a 32-bit hash that tells apart texts under one id, and the text."""
    text = F.coalesce(F.col("text").cast("string"), F.lit(""))
    return docs.select(F.coalesce(F.col("doc_id").cast("long"), F.lit(-(1 << 63))).alias("doc"), F.xxhash64(text).bitwiseAND(F.lit((1 << 31) - 1)).alias("sig"), text.alias("text"))


def _at(sig: np.ndarray, pos: np.ndarray, kind: np.ndarray | int) -> np.ndarray:
    return (sig.astype(np.int64) << 32) | (pos.astype(np.int64) << 2) | kind


def settle(key: np.ndarray, context: np.ndarray, doc: np.ndarray, at: np.ndarray, within: bool) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Order by key, context and place; which of the ordered rows repeat an earlier one; and how many contexts its key has."""
    order = np.lexsort((at, doc, context, key))
    k, c, d, a = key[order], context[order], doc[order], at[order]
    new_key = np.concatenate([[True], k[1:] != k[:-1]])
    new_class = new_key | np.concatenate([[True], c[1:] != c[:-1]])
    first = np.flatnonzero(new_class)[np.cumsum(new_class) - 1]
    repeat = d != d[first]
    if within:
        repeat |= a != a[first]
    run = np.cumsum(new_key) - 1
    return order, repeat, np.bincount(run, new_class)[run]


Sentinels = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]]


def states(docs: DataFrame, windows: Windows, sentinels: Sentinels, name: str) -> DataFrame:
    """Rows (doc, sig, cover, open, hot) of the documents with repeats or open sentinels.

    ``sentinels`` gives for some texts the text, place, key and context hash of each
    sentinel. ``cover`` has the starts and ends of stretches made of repeats, in order;
    ``open`` and ``hot`` the places of sentinels around which windows must be compared in
    full, the latter with keys of very many contexts.
    """
    within = windows.within

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, ["doc", "sig"]):
                text, pos, key, context = sentinels([r[-1] for r in rows])
                doc, sig = (np.array([r[i] for r in rows], dtype=np.int64)[text] for i in (0, 1))
                at = _at(sig, pos, 0)
                if not len(at):
                    continue
                order, repeat, _ = settle(key, context, doc, at, within)
                key, context, doc, at = key[order], context[order], doc[order], at[order]
                own = mix(doc.view(np.uint64) * np.uint64(BASES[0]) + at.view(np.uint64))
                key = np.where(repeat, own, key)
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (key.view(np.int64), context.view(np.int64), doc, at | np.where(repeat, REPEAT, 0))], names=["key", "context", "doc", "at"])

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b[c].to_numpy() for c in ("key", "context", "doc", "at")] for b in batches]
        if got:
            key, context, doc, at = (np.concatenate(c) for c in zip(*got))
            del got
            order, repeat, contexts = settle(key, context, doc, at, within)
            doc, at = doc[order], at[order]
            kind = np.where(repeat | (at & 3 == REPEAT), REPEAT, np.where(contexts > HOT_CONTEXTS, HOT, np.where(contexts > 1, OPEN, 0)))
            told = kind > 0
            yield pa.RecordBatch.from_arrays([pa.array(doc[told]), pa.array((at[told] & ~3) | kind[told])], names=["doc", "at"])

    long4 = "key long, context long, doc long, at long"
    told = identified(docs).mapInArrow(emit, long4).repartition("key").mapInArrow(meet, "doc long, at long")
    return stored(gathered(told, windows), name)


def gathered(told: DataFrame, windows: Windows) -> DataFrame:
    """Settled places (doc, at) as one row per document."""

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            cover, open_, hot = [], [], []
            for at in batch["at"]:
                at = np.sort(at.values.to_numpy(zero_copy_only=False))
                pos, kind = (at & _M32) >> 2, at & 3
                p = pos[kind == REPEAT]
                cover.append(union(np.maximum(p - windows.left, 0), p + windows.right))
                open_.append(pos[kind == OPEN])
                hot.append(pos[kind == HOT])
            ints = pa.list_(pa.int64())
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["sig"], *(pa.array(x, ints) for x in (cover, open_, hot))], names=["doc", "sig", "cover", "open", "hot"])

    grouped = told.groupBy("doc", F.shiftright("at", 32).alias("sig")).agg(F.collect_list("at").alias("at"))
    return grouped.mapInArrow(merge, "doc long, sig long, cover array<bigint>, open array<bigint>, hot array<bigint>")


def union(start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Starts and ends, in turn, of the union of stretches given in order of their starts and ends; stretches that touch are one."""
    if not len(start):
        return np.zeros(0, dtype=np.int64)
    reach = np.maximum.accumulate(end)
    new = np.concatenate([[True], start[1:] > reach[:-1]])
    last = np.concatenate([np.flatnonzero(new)[1:] - 1, [len(start) - 1]])
    return np.stack([start[new], reach[last]], axis=1).reshape(-1)


def documents_with(docs: DataFrame, marks: DataFrame, places: Column) -> DataFrame:
    """Rows (doc, sig, cover, places, text) of the documents with some of ``places`` in their marks."""
    some = marks.select("doc", "sig", "cover", places.alias("places")).where(F.size("places") > 0)
    return identified(docs).join(some, ["doc", "sig"]).select("doc", "sig", "cover", "places", "text")


def _bytes(*arrays: str) -> Column:
    return sum((8 * F.size(a) for a in arrays), F.lit(64))


def removed(docs: DataFrame, marks: DataFrame, starts: DataFrame, length: int) -> DataFrame:
    """Rows (doc, text, gone) for every row of ``docs``: ``gone`` has the stretches covered by repeats, or null.

    ``starts`` holds further repeats as rows (doc, at), the place of each window's first unit.
    """

    def merge(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            out = []
            for cover, at in zip(batch["cover"], batch["at"]):
                c = np.array(cover.values.to_numpy(zero_copy_only=False) if cover.is_valid else [], dtype=np.int64).reshape(-1, 2)
                s = (np.array(at.values.to_numpy(zero_copy_only=False) if at.is_valid else [], dtype=np.int64) & _M32) >> 2
                a, b = np.concatenate([c[:, 0], s]), np.concatenate([c[:, 1], s + length])
                order = np.lexsort((b, a))
                out.append(union(a[order], b[order]))
            yield pa.RecordBatch.from_arrays([batch["doc"], batch["sig"], pa.array(out, pa.list_(pa.int64()))], names=["doc", "sig", "gone"])

    more = starts.groupBy("doc", F.shiftright("at", 32).alias("sig")).agg(F.collect_list("at").alias("at"))
    both = marks.where(F.size("cover") > 0).select("doc", "sig", "cover").join(more, ["doc", "sig"], "full")
    gone = stored(both.mapInArrow(merge, "doc long, sig long, gone array<bigint>"), "repeats")
    return beside(identified(docs), gone, ["doc", "sig"], "left", row_bytes=_bytes("gone"))


def ids_back() -> Column:
    """The document's id as it was: the smallest long stands for null."""
    return F.when(F.col("doc") != F.lit(-(1 << 63)), F.col("doc"))


Units = Callable[[list[bytes]], tuple[np.ndarray, np.ndarray]]


def repeated_windows(docs: DataFrame, marks: DataFrame, windows: Windows, units: Units, places: Column, name: str) -> DataFrame:
    """Rows (doc, at) of the windows around ``places`` that stand in an earlier place, by 128-bit hashes of whole windows.

    ``units`` gives the hashed units of some texts one after another and their number in each.
    """
    length, columns = windows.length, ["h1", "h2", "doc", "at"]

    def emit(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for rows in chunks(batch, ["doc", "sig", "cover", "places"]):
                values, counts = units([r[-1] for r in rows])
                h1, h2 = (Sums(values, b).each(length) for b in BASES[:2])
                found, base = [], 0
                for (doc, sig, cover, near, _), n in zip(rows, counts.tolist()):
                    if n >= length:
                        edge, p = np.zeros(n + 1, dtype=np.int64), np.array(near, dtype=np.int64)
                        a, b = np.maximum(p - windows.left, 0), np.minimum(p - windows.before, n - length) + 1
                        ok = a < b
                        np.add.at(edge, a[ok], 1)
                        np.add.at(edge, b[ok], -1)
                        want = np.cumsum(edge)[: n - length + 1] > 0
                        for s, e in zip(cover[::2], cover[1::2]):  # known to repeat
                            want[s : max(s, min(e, n) - length + 1)] = False
                        s = np.flatnonzero(want)
                        found.append((h1[base + s], h2[base + s], np.full(len(s), doc), _at(np.full(len(s), sig), s, 0)))
                    base += n
                if found:
                    a, b, doc, at = (np.concatenate(c) for c in zip(*found))
                    order, repeat, _ = settle(a, b, doc, at, windows.within)
                    a, b, doc, at = a[order], b[order], doc[order], at[order]
                    a = np.where(repeat, mix(doc.view(np.uint64) + at.view(np.uint64)), a)
                    yield pa.RecordBatch.from_arrays([pa.array(x) for x in (a.view(np.int64), b.view(np.int64), doc, at | np.where(repeat, REPEAT, 0))], names=columns)

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b[c].to_numpy() for c in columns] for b in batches]
        if got:
            a, b, doc, at = (np.concatenate(c) for c in zip(*got))
            order, repeat, _ = settle(a, b, doc, at, windows.within)
            doc, at = doc[order], at[order]
            told = repeat | (at & 3 == REPEAT)
            yield pa.RecordBatch.from_arrays([pa.array(doc[told]), pa.array(at[told])], names=["doc", "at"])

    rows = documents_with(docs, marks, places).mapInArrow(emit, "h1 long, h2 long, doc long, at long")
    return stored(rows.repartition("h1").mapInArrow(meet, "doc long, at long"), name)
