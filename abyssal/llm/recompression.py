"""Substring deduplication by recompression.

Words get names, and rounds of recompression shorten each text: a round names every run
of one symbol by symbol and length, then every pair of neighbours of which the first can
only open and the second only close a pair (a bit of the name says which), so pairs never
overlap. A name is a 64-bit hash of what it stands for, the same in every document, so
names are global without an exchange.

How a symbol came about depends on its own words and on neighbours looked at on the way;
the stretch of all these is carried along. Equal stretches of text are parsed alike in
every symbol whose stretch lies within them, so each window chooses, among the symbols
whose stretch it holds, one of the highest round and there the smallest name, and equal
windows choose the same. The chosen symbols of all documents meet by name (see
``repeats``): one that occurs once shows that nothing around it repeats, shared ones are
verified and extended.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .repeats import BASES, Sums, Windows, ids_back, mix, removed, repeated_windows, states

#: Beyond so many rounds hardly any symbol's stretch lies within a window of 50 words.
ROUNDS = 5


def named(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray]:
    """Names of the words of all texts one after another, and the number of words of each."""
    words = [t.split() for t in texts]
    counts = np.fromiter(map(len, words), dtype=np.int64, count=len(words))
    digest = xxhash.xxh64_intdigest
    return np.fromiter((digest(w) for ws in words for w in ws), dtype=np.uint64, count=int(counts.sum())), counts


@dataclass(frozen=True)
class Symbols:
    """Symbols of a round, in order: name, text and first word of each, and the stretch [low, high) of words that it depends on.

    A stretch that would go on beyond its text ends one word outside, so that no window holds it.
    """

    name: np.ndarray
    text: np.ndarray
    first: np.ndarray
    low: np.ndarray
    high: np.ndarray

    def beside(self, starts: np.ndarray, ends: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Whether the next symbol is in the same text; where the stretch of the one before begins and that of the one after ends."""
        same = self.text[1:] == self.text[:-1]
        before, after = starts[self.text] - 1, ends[self.text] + 1
        before[1:][same], after[:-1][same] = self.low[:-1][same], self.high[1:][same]
        return same, before, after

    def runs(self, starts: np.ndarray, ends: np.ndarray) -> Symbols:
        """Runs of one symbol named by symbol and length; that a run ends is known from its neighbours."""
        same, before, after = self.beside(starts, ends)
        at = np.flatnonzero(np.concatenate([[True], (self.name[1:] != self.name[:-1]) | ~same]))
        size = np.diff(np.append(at, len(self.name)))
        name = self.name[at]
        name = np.where(size > 1, mix(name * np.uint64(BASES[2]) + size.astype(np.uint64)), name)
        return Symbols(name, self.text[at], self.first[at], before[at], after[at + size - 1])

    def pairs(self, level: int, starts: np.ndarray, ends: np.ndarray) -> Symbols:
        """Pairs named by their two symbols. An opening symbol has looked at the one after it, a closing one at the one before."""
        same, before, after = self.beside(starts, ends)
        opens = (mix(self.name + np.uint64(level)) & np.uint64(1)).astype(bool)
        pair = np.append(opens[:-1] & ~opens[1:] & same, False)
        name = np.where(pair, mix(self.name * np.uint64(BASES[0]) + mix(np.roll(self.name, -1) + np.uint64(BASES[1]))), self.name)
        stays = np.concatenate([[True], ~pair[:-1]])
        return Symbols(name[stays], self.text[stays], self.first[stays], np.where(opens, self.low, before)[stays], np.where(opens, after, self.high)[stays])


def recompress(words: np.ndarray, counts: np.ndarray, rounds: int = ROUNDS) -> list[Symbols]:
    """Symbols before the first and after each round, for the names of the words of some texts one after another."""
    text, at, ends = np.repeat(np.arange(len(counts)), counts), np.arange(len(words)), np.cumsum(counts)
    out = [Symbols(words, text, at, at, at + 1)]
    if len(words):
        for level in range(rounds):
            out.append(out[-1].runs(ends - counts, ends).pairs(level, ends - counts, ends))
    return out


def least(value: np.ndarray, start: np.ndarray, end: np.ndarray) -> np.ndarray:
    """Place of the smallest of each stretch [start, end) of values, none of them empty; of equal ones the last."""
    low = np.uint64((1 << 32) - 1)
    levels = [(value & ~low) | (low - np.arange(len(value), dtype=np.uint64))]
    depth = np.frexp((end - start).astype(float))[1] - 1
    for k in range(int(depth.max(initial=0))):
        levels.append(np.minimum(levels[-1][: -(1 << k)], levels[-1][1 << k :]))
    best = np.empty(len(start), dtype=np.uint64)
    for k, level in enumerate(levels):
        i = np.flatnonzero(depth == k)
        best[i] = np.minimum(level[start[i]], level[end[i] - (1 << k)])
    return (low - (best & low)).astype(np.int64)


def chosen(rounds: list[Symbols], counts: np.ndarray, length: int) -> list[tuple[int, np.ndarray]]:
    """Round and places of the symbols that windows of ``length`` words choose: of those whose stretch a window
    holds, one of the highest round, there the smallest name. Single words are in every window, so each chooses one."""
    n, ends = int(counts.sum()), np.cumsum(counts)
    left = np.arange(n) + length <= np.repeat(ends, counts)
    window, out = np.flatnonzero(left), []
    for level in range(len(rounds) - 1, -1, -1):
        if not len(window):
            break
        symbols = rounds[level]
        start = np.cumsum(np.bincount(symbols.low + 1, minlength=n + 3))[window]
        end = np.cumsum(np.bincount(symbols.high, minlength=n + 3))[window + length]
        has = end > start
        if has.any():
            out.append((level, np.unique(least(mix(symbols.name + np.uint64(BASES[2])), start[has], end[has]))))
        window = window[~has]
    return out


def sentinels(windows: Windows):
    """The symbols that windows choose; a key is a symbol's name and round and all words that it depends on."""

    def pick(texts: list[bytes]) -> tuple[np.ndarray, np.ndarray, np.ndarray, np.ndarray]:
        words, counts = named(texts)
        starts = np.cumsum(counts) - counts
        first, second, got = Sums(words, BASES[0]), Sums(words, BASES[1]), []
        rounds = recompress(words, counts)
        for level, at in chosen(rounds, counts, windows.length):
            symbols = rounds[level]
            p, t = symbols.first[at], symbols.text[at]
            low, high = starts[t], starts[t] + counts[t]
            key = mix(first.of(symbols.low[at], symbols.high[at]) + symbols.name[at] + np.uint64(level))
            a, b = np.maximum(p - windows.left, low), np.minimum(p + windows.right, high)
            context = mix(second.of(a, b) + ((p - a) * 4096 + (b - p)).astype(np.uint64))
            got.append((t, p - low, key, context))
        none = np.zeros(0, dtype=np.int64)
        return tuple(np.concatenate(c) for c in zip(*got)) if got else (none, none, none.view(np.uint64), none.view(np.uint64))

    return pick


def without_repeats(docs: DataFrame, length: int = 50) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept) of every document.

    Words are split at ASCII white space, unchanged. A word goes if a window of
    ``length`` words that covers it also stands in a document with a smaller id; ``kept``
    joins the others by one space. A null text has no words; a null id comes before all
    others; documents under one id are compared with smaller ids only, and repeated rows
    each give a row. Other columns are ignored.
    """
    windows = Windows(length, 0, 1, False)
    marks = states(docs, windows, sentinels(windows), "word-states")
    starts = repeated_windows(docs, marks, windows, named, F.concat("open", "hot"), "word-windows")
    gone = removed(docs, marks, starts, length)

    def apply(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n, lost, kept = [], [], []
            for text, stretches in zip(batch["text"].to_pylist(), batch["gone"].to_pylist()):
                words = text.encode("utf-8", "replace").split()
                stays, at = [], 0
                for s, e in zip((stretches or [])[::2], (stretches or [])[1::2]):
                    stays += words[at:s]
                    at = min(e, len(words))
                stays += words[at:]
                n.append(len(words))
                lost.append(len(words) - len(stays))
                kept.append(b" ".join(stays).decode())
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(n, pa.int64()), pa.array(lost, pa.int64()), pa.array(kept, pa.string())], names=["doc_id", "n_words", "n_removed", "kept"])

    return gone.select(ids_back().alias("doc_id"), "text", "gone").mapInArrow(apply, "doc_id long, n_words long, n_removed long, kept string")


def digest(docs: DataFrame, length: int = 50) -> DataFrame:
    """Rows (doc_id, n_words, n_removed, kept_sha256)."""
    return without_repeats(docs, length).select("doc_id", "n_words", "n_removed", F.sha2("kept", 256).alias("kept_sha256"))
