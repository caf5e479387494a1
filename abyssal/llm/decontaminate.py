"""Benchmark decontamination by template windows.

Words become template tokens: numbers, names and units turn into typed placeholders,
other words into their lower-case form without punctuation at the ends. Windows of
template tokens are hash-joined with the benchmark's, so a question asked anew with
other parameters still matches; the values behind the placeholders must then map one
to one between item and document, at one place of the document: values that the same
template has elsewhere don't count against it.
"""

from __future__ import annotations

import re
import string
from bisect import bisect_left
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import stored
from .quality import signature

# Unit words that follow a number.
UNITS = frozenset(
    "mm cm m km inch inches foot feet yard yards mile miles mg g kg ton tons gram grams kilogram kilograms "
    "ml l litre litres liter liters s sec second seconds min minute minutes h hour hours day days week weeks "
    "month months year years percent % usd eur dollar dollars euro euros cent cents kb mb gb tb hz khz mhz ghz "
    "w kw mw v a n j kj pa kpa mph kmh".split()
)
_NUMBER = re.compile(r"[+-]?\d[\d.,:/]*")
_ATTACHED = re.compile(r"([+-]?\d[\d.,]*)([^\W\d_]+|%)")
_ENDS = string.punctuation + "«»“”„‘’¿¡…"
_NUM, _NAME, _UNIT = (np.uint64(xxhash.xxh64_intdigest(x)) for x in ("<number>", "<name>", "<unit>"))
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: Bits of the filter that keeps windows off the shuffle which no item has; its size is fixed, whatever the benchmark.
FILTER_BITS = 23
#: Benchmark windows up to this many rows (about 100 bytes each) are broadcast.
BROADCAST_WINDOWS = 100_000
#: Words whose tokens a Python worker keeps.
CACHED_WORDS = 300_000


class _Words(dict):
    """Place of each word in growing arrays of its token, value and flags."""

    def __init__(self) -> None:
        self.rows: list[tuple[int, int, bool, bool, bool, bool]] = []

    def __missing__(self, word: str) -> int:
        bare = word.strip(_ENDS) or word
        low = bare.lower()
        number = bool(_NUMBER.fullmatch(low)) or bool(_ATTACHED.fullmatch(low))
        h = xxhash.xxh64_intdigest(low)
        self.rows.append((h, h, number, low in UNITS, bare[:1].isupper() and bare[1:] == bare[1:].lower(), word[-1] in ".!?:;|"))
        self[word] = place = len(self)
        return place

    def place(self, words: list[str]) -> np.ndarray:
        return np.fromiter(map(self.__getitem__, words), dtype=np.int64, count=len(words))


class Templates:
    """Template tokens of texts; slots hold the hash of the value behind a placeholder, else 0."""

    def __init__(self) -> None:
        self.words, self.table = _Words(), None

    def tokens(self, texts: list[str]) -> tuple[np.ndarray, np.ndarray, np.ndarray, list[tuple[np.ndarray, np.ndarray]]]:
        """Tokens and slots of all texts one after another, the number of words of each, and each
        reading that a word can have beside others (token, whether it can): itself, a name, a unit."""
        if len(self.words) > CACHED_WORDS:
            self.words, self.table = _Words(), None
        split = [t.split() for t in texts]
        counts = np.array([len(s) for s in split], dtype=np.int64)
        at = self.words.place([w for s in split for w in s])
        if self.table is None or len(self.table[0]) != len(self.words.rows):
            cols = list(zip(*self.words.rows)) or [()] * 6
            self.table = [np.array(cols[0], dtype=np.uint64), np.array(cols[1], dtype=np.uint64), *(np.array(c, dtype=bool) for c in cols[2:])]
        h, value, number, unit, capital, end = (t[at] for t in self.table)
        opens = np.ones(len(at), dtype=bool)
        opens[1:] = end[:-1]
        after_number = np.zeros(len(at), dtype=bool)
        after_number[1:] = number[:-1]
        starts = np.cumsum(counts) - counts
        starts = starts[counts > 0]
        opens[starts], after_number[starts] = True, False
        words = np.ones(len(at), dtype=bool)
        readings = [(h, words & ~number), (np.full(len(at), _NAME), capital & ~number), (np.full(len(at), _UNIT), unit & ~number)]
        unit, name = unit & after_number, capital & ~opens & ~number
        token = np.where(number, _NUM, np.where(unit, _UNIT, np.where(name, _NAME, h)))
        return token, np.where(number | unit | name, value, np.uint64(0)), counts, readings



def _hashes(first: np.ndarray, token: np.ndarray, width: int) -> np.ndarray:
    """Hashes of ``width`` tokens from each token on, with ``first`` in place of the first one."""
    n = max(0, len(token) - width + 1)
    h = np.zeros(n, dtype=np.uint64)
    for k in range(width):
        h = (h + (token if k else first)[k : k + n]) * _BASE
        h ^= h >> np.uint64(29)
    return h


def _whole(counts: np.ndarray, width: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Tokens whose window of ``width`` lies within its text; each token's text and place in it."""
    text = np.repeat(np.arange(len(counts)), counts)
    place = np.arange(len(text)) - (np.cumsum(counts) - counts)[text]
    return np.flatnonzero(place + width <= counts[text]), text, place


def _slots(slot: np.ndarray, at: np.ndarray, width: int) -> np.ndarray:
    return slot[at[:, None] + np.arange(width)] if len(at) else np.zeros((0, width), dtype=np.uint64)


def item_windows(benchmark: DataFrame, width: int) -> DataFrame:
    """Rows (h, item_id, item_pos, item_slots, size, first) of the windows of every item.

    An item of fewer than ``width`` words is one window of ``size`` words. What a window's first
    word is told to be depends on the word before it, which may not be the item's in a document,
    so windows come with every reading of it. With another than the item's own, it stands for
    nothing (its slot is 0) and ``first`` is the value that the document must have behind it, or
    0 where the token says it.
    """

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates = Templates()
        for batch in batches:
            token, slot, counts, readings = templates.tokens([t or "" for t in batch["text"].to_pylist()])
            ids = batch["item_id"].to_numpy(zero_copy_only=False)
            for size in range(1, width + 1):
                whole, text, place = _whole(counts, size)
                if size < width:
                    whole = whole[counts[text[whole]] == size]
                for k, (first, can) in enumerate([(token, np.ones(len(token), dtype=bool)), *readings]):
                    at = whole[can[whole] & ((first[whole] != token[whole]) | (k == 0))]
                    if len(at):
                        slots = _slots(slot, at, size)
                        value = readings[0][0][at] if k > 1 else np.zeros(len(at), dtype=np.uint64)
                        if k:
                            slots[:, 0] = 0
                        yield pa.RecordBatch.from_arrays(
                            [
                                pa.array(_hashes(first, token, size)[at].view(np.int64)), pa.array(ids[text[at]], pa.int64()), pa.array(place[at], pa.int32()),
                                pa.array(list(slots.view(np.int64)), pa.list_(pa.int64())), pa.array(np.full(len(at), size), pa.int32()), pa.array(value.view(np.int64)),
                            ],
                            names=["h", "item_id", "item_pos", "item_slots", "size", "first"],
                        )

    items = benchmark.select(F.col("item_id").cast("long").alias("item_id"), F.col("text").cast("string").alias("text")).where(F.col("item_id").isNotNull())
    return items.mapInArrow(cut, "h long, item_id long, item_pos int, item_slots array<bigint>, size int, first long")


def _together(readings: Iterator[list[dict]], forth: dict[int, int], back: dict[int, int]) -> bool:
    """Whether the pairs map one to one, also with those of ``forth`` and ``back``, which then take them up."""
    more, less = {}, {}
    for pairs in readings:
        for p in pairs:
            mine, theirs = p["item_slots"], p["doc_slots"]
            if forth.get(mine, theirs) != theirs or back.get(theirs, mine) != mine or more.setdefault(mine, theirs) != theirs or less.setdefault(theirs, mine) != mine:
                return False
    forth.update(more)
    back.update(less)
    return True


def best_reading(found: list[dict], n_windows: int, similarity: float) -> tuple[bool, int, int] | None:
    """(exact, n_matched, n_slots) of the best way to read an item's windows in a document, if any holds it.

    ``found`` has the windows (align, item_pos, pairs) of one document and item; ``align`` is
    the place in the document less that in the item, null where no value is behind a window.
    Each alignment is read with all its windows, then with those of the alignments next to
    it (words put in or left out), nearest first, as far as their values agree with it.
    Last, all windows are read together, each with its smallest values.
    """
    free, by, least = set(), {}, {}
    for w in found:
        if w["align"] is None:
            free.add(w["item_pos"])
        else:
            by.setdefault(w["align"], {})[w["item_pos"]] = w["pairs"]
            values = [(p["item_slots"], p["doc_slots"]) for p in w["pairs"]]
            if w["item_pos"] not in least or values < least[w["item_pos"]][0]:
                least[w["item_pos"]] = values, w["pairs"]
    aligns, best = sorted(by), None

    def weigh(matched: int, forth: dict[int, int]) -> None:
        nonlocal best
        if matched >= similarity * n_windows:
            got = (all(a == b for a, b in forth.items()), matched, len(forth))
            best = got if best is None else max(best, got)

    for at in aligns:
        forth, back = {}, {}
        if _together(by[at].values(), forth, back):
            seen = free | by[at].keys()
            near = aligns[bisect_left(aligns, at - n_windows) : bisect_left(aligns, at + n_windows + 1)]
            for other in sorted(near, key=lambda a: (abs(a - at), a))[1:]:
                new = by[other].keys() - seen
                if new and _together((by[other][k] for k in new), forth, back):
                    seen |= new
            weigh(len(seen), forth)
            if best == (True, n_windows, len(forth)):
                return best
    forth = {}
    if _together((pairs for _, pairs in least.values()), forth, {}):
        weigh(len(free | least.keys()), forth)
    return best


def contaminated(docs: DataFrame, benchmark: DataFrame, width: int = 5, similarity: float = 0.8) -> DataFrame:
    """Rows (doc_id, sig, item_id, n_windows, n_matched, n_slots, exact) for documents that hold an item.

    A document holds an item if at least ``similarity`` of the item's windows of ``width``
    template tokens occur in it and the values in the placeholders map one to one at some
    place of the document (see ``best_reading``); other places may hold other values.
    ``exact`` says that they are the same values. An item of fewer than ``width`` words is one
    window of its whole length and must occur with the same values, since so short a template
    says too little; null texts and items without words count as empty, null ids of items are
    left out. ``sig`` is a hash of the document's text. A repeated document gives one row
    an item; empty tables give none; other columns are ignored.
    """
    spark = docs.sparkSession
    items = stored(item_windows(benchmark, width), "item-windows")
    place = F.shiftrightunsigned("h", 64 - FILTER_BITS).cast("int")
    marks = np.zeros(1 << FILTER_BITS, dtype=bool)
    for batch in items.select(place.alias("p")).distinct().groupBy(F.shiftright("p", 9).alias("w")).agg(F.collect_list("p").alias("p")).toLocalIterator():
        marks[batch["p"]] = True
    shared = spark.sparkContext.broadcast(np.packbits(marks))
    widths = sorted({r["size"] for r in items.select("size").distinct().collect()})

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        templates, keep = Templates(), np.unpackbits(shared.value).astype(bool)
        for batch in batches:
            texts, ids, sig = batch["text"].to_pylist(), batch["doc_id"], batch["sig"]
            for at in range(0, len(texts), 512):
                token, slot, counts, _ = templates.tokens([t or "" for t in texts[at : at + 512]])
                for size in widths:
                    h, (whole, text, place) = _hashes(token, token, size), _whole(counts, size)
                    whole = whole[keep[h[whole] >> np.uint64(64 - FILTER_BITS)]]
                    if len(whole):
                        own, slots = pa.array(text[whole] + at), _slots(slot, whole, size).view(np.int64)
                        yield pa.RecordBatch.from_arrays(
                            [pa.array(h[whole].view(np.int64)), ids.take(own), sig.take(own), pa.array(place[whole], pa.int32()), pa.array(list(slots), pa.list_(pa.int64()))],
                            names=["h", "doc_id", "sig", "doc_pos", "doc_slots"],
                        )

    rows = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signature(docs).alias("sig"), F.col("text").cast("string").alias("text"))
    found = rows.mapInArrow(cut, "h long, doc_id long, sig long, doc_pos int, doc_slots array<bigint>")
    small = items.count() <= BROADCAST_WINDOWS
    sizes = items.groupBy("item_id").agg(F.countDistinct("item_pos").alias("n_windows"))
    hits = found.join(F.broadcast(items) if small else items, "h").where((F.size("doc_slots") == F.col("size")) & ((F.col("first") == 0) | (F.element_at("doc_slots", 1) == F.col("first"))))
    pair = F.filter(F.arrays_zip("item_slots", "doc_slots"), lambda s: s["item_slots"] != 0)
    key = ["doc_id", "sig", "item_id"]
    window = F.struct(F.when(F.size("pairs") > 0, F.col("doc_pos") - F.col("item_pos")).alias("align"), "item_pos", "pairs")
    told = hits.withColumn("pairs", pair).where((F.col("size") == width) | F.forall("pairs", lambda p: p["item_slots"] == p["doc_slots"]))
    held = told.groupBy(*key).agg(F.collect_set(window).alias("found"))
    held = held.join(F.broadcast(sizes) if small else sizes, "item_id").where(F.size(F.array_distinct(F.col("found.item_pos"))) >= similarity * F.col("n_windows"))

    def read(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for at in range(0, batch.num_rows, 256):
                some = batch.slice(at, 256)
                got = [best_reading(f, n, similarity) for f, n in zip(some["found"].to_pylist(), some["n_windows"].to_pylist())]
                own = pa.array([i for i, g in enumerate(got) if g is not None], pa.int64())
                exact, matched, slots = list(zip(*filter(None, got))) or [()] * 3
                yield pa.RecordBatch.from_arrays(
                    [*(some[c].take(own) for c in (*key, "n_windows")), pa.array(matched, pa.int64()), pa.array(slots, pa.int64()), pa.array(exact, pa.bool_())],
                    names=[*key, "n_windows", "n_matched", "n_slots", "exact"],
                )

    return held.select(*key, F.col("n_windows").cast("long").alias("n_windows"), "found").mapInArrow(read, "doc_id long, sig long, item_id long, n_windows long, n_matched long, n_slots long, exact boolean")
