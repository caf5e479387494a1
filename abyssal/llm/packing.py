"""Best-fit-decreasing packing of tokenised documents into fixed-length sequences.

Documents are tokenised and cut where they stand. The packing itself needs only how
many pieces there are of each length, at most ``capacity`` numbers: pieces of one
length are interchangeable, and so are bins with the same room. The plan runs
best-fit decreasing over that histogram with a segment tree over remaining
capacities, a whole run of equal pieces and equal bins at a time, which gives just the
bins that placing the documents one after another would give. Ranks within a length
come from a range-partitioned sort, and each piece looks its place up in the plan.
"""

from __future__ import annotations

import base64
import json
import re
import struct
import zlib
from collections.abc import Iterator
from pathlib import Path

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import ranked, stored

#: Words kept with their ids in each Python worker; the memory that a worker's cache takes is about 200 bytes a word.
CACHED_WORDS = 200_000


class _Ids(dict):
    """Little-endian ids of a stretch of text, by the text; a miss is encoded."""

    def __init__(self, ranks_file: str):
        import public_tokenizers
        import tiktoken

        ranks = {base64.b64decode(a): int(b) for a, b in map(bytes.split, open(ranks_file, "rb"))}
        self.encode = tiktoken.Encoding("bpe", pat_str=public_tokenizers.PATTERN, mergeable_ranks=ranks, special_tokens={}).encode_ordinary
        added = json.loads(Path(ranks_file).with_suffix(".json").read_text(encoding="utf-8"))["added_tokens"]
        if any(t["single_word"] or t["lstrip"] or t["rstrip"] for t in added):
            raise ValueError("added tokens that look at their surroundings")
        self.added = {t["content"]: struct.pack("<I", t["id"]) for t in added}
        self.cut = re.compile("(" + "|".join(map(re.escape, sorted(self.added, key=len, reverse=True))) + ")") if added else None

    def __missing__(self, text: str) -> bytes:
        ids = self.encode(text)
        out = struct.pack(f"<{len(ids)}I", *ids)
        self[text] = out
        return out

    def of(self, text: str) -> bytes:
        """Ids of a whole text: those of the vocabulary's added tokens where they occur, and of the texts between them."""
        if self.cut is None or not any(t in text for t in self.added):
            return self.between(text)
        return b"".join(self.added[t] if k % 2 else self.between(t) for k, t in enumerate(self.cut.split(text)) if t)

    def between(self, text: str) -> bytes:
        """Ids of a text without added tokens. A single space between two characters that are not
        white space always starts a pre-token, so the text may be cut there and
        every cut piece encoded on its own."""
        if len(self) > CACHED_WORDS:
            self.clear()
        first, *rest = text.split(" ")
        if rest and first and not any(not w or w[0].isspace() or w[-1].isspace() for w in (first, *rest)):
            return self[first] + b"".join(map(self.__getitem__, map(" ".__add__, rest)))
        ids = self.encode(text)
        return struct.pack(f"<{len(ids)}I", *ids)


def pieces(docs: DataFrame, ranks_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Rows (doc_id, piece, start, length, ids_crc32) of every document.

    ``ranks_file`` holds the byte-pair vocabulary as ranks; the tokenizer's JSON file of the same
    name beside it names the added tokens, which are one id wherever a text has them. ``end_id`` closes each
    document. A document longer than ``capacity`` is cut into pieces of ``capacity``
    ids, the first taking the remainder. A null text counts as empty: one piece with
    ``end_id`` alone. Repeated rows each give their own pieces.
    """
    schema = "doc_id long, piece int, start long, length long, ids_crc32 long"

    def cut(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        ids, end = _Ids(ranks_file), struct.pack("<I", end_id)
        for batch in batches:
            rows = []
            for doc_id, text in zip(batch["doc_id"].to_pylist(), batch["text"].to_pylist()):
                data = memoryview((ids.of(text) if text else b"") + end)
                n = len(data) // 4
                at, k = 0, 0
                while at < n:
                    size = (n - 1) % capacity + 1 if at == 0 else capacity
                    rows.append((doc_id, k, at, size, zlib.crc32(data[4 * at : 4 * (at + size)])))
                    at, k = at + size, k + 1
            cols = list(zip(*rows)) or [()] * 5
            yield pa.RecordBatch.from_arrays(
                [pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int32(), pa.int64(), pa.int64(), pa.int64()))],
                names=["doc_id", "piece", "start", "length", "ids_crc32"],
            )

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(cut, schema)


class _Tightest:
    """Segment tree over remaining capacities: which of them some open bin has."""

    def __init__(self, capacity: int):
        self.leaves = 1 << capacity.bit_length()
        self.has = [False] * (2 * self.leaves)

    def put(self, room: int, any_bin: bool) -> None:
        i = room + self.leaves
        self.has[i] = any_bin
        while i > 1:
            i //= 2
            self.has[i] = self.has[2 * i] or self.has[2 * i + 1]

    def find(self, size: int) -> int | None:
        """Smallest capacity of at least ``size`` that a bin has left."""
        i = size + self.leaves
        if self.has[i]:
            return size
        while i > 1:
            if i % 2 == 0 and self.has[i + 1]:
                i += 1
                break
            i //= 2
        else:
            return None
        while i < self.leaves:
            i = 2 * i if self.has[2 * i] else 2 * i + 1
        return i - self.leaves


def plan(histogram: dict[int, int], capacity: int) -> np.ndarray:
    """Best-fit decreasing over counts by length.

    Returns rows (length, first rank, first bin, pieces a bin, offset of the first):
    piece ``r`` of that length, from the row with the largest first rank not above
    ``r``, goes to bin ``first + (r - rank) // per`` at ``offset + (r - rank) % per * length``.
    The rows and the open runs of bins number at most a few per pair of lengths,
    however many documents there are.
    """
    tree, open_bins, out, new = _Tightest(capacity), {}, [], 0

    def leave(room: int, first: int, count: int) -> None:
        if count and room:
            open_bins.setdefault(room, []).append((first, count))
            tree.put(room, True)

    for size in sorted(histogram, reverse=True):
        left, rank = histogram[size], 0
        while left:
            room = tree.find(size)
            if room is None:
                room = capacity
                first, count = new, -(-left // (capacity // size))
                new += count
            else:
                first, count = open_bins[room].pop()
                if not open_bins[room]:
                    tree.put(room, False)
            per = room // size
            full = min(count, left // per)
            placed = full * per
            out.append((size, rank, first, per, capacity - room))
            leave(room - per * size, first, full)
            rest = left - placed if full < count else 0
            if rest:
                leave(room - rest * size, first + full, 1)
                placed += rest
            leave(room, first + full + bool(rest), count - full - bool(rest))
            left, rank = left - placed, rank + placed
    return np.array(out, dtype=np.int64).reshape(-1, 5)


def pack(docs: DataFrame, ranks_file: str, capacity: int = 2048, end_id: int = 0) -> DataFrame:
    """Every piece of ``docs`` with its sequence_id and offset.

    Takes columns doc_id and text; others are ignored. An empty table gives no rows.
    """
    cut = stored(pieces(docs, ranks_file, capacity, end_id), "cut-pieces")  # else drawing the range bounds tokenises everything once more
    order = ranked(cut, ["length", "doc_id", "piece", "start", "ids_crc32"], "pieces")
    histogram = {r["length"]: r["n"] for r in order.groupBy("length").agg(F.count("*").alias("n")).collect()}
    where = plan(histogram, capacity)
    starts, total = {}, 0
    for size in sorted(histogram):
        starts[size], total = total, total + histogram[size]
    keys = where[:, 1] + np.array([starts[s] for s in where[:, 0].tolist()], dtype=np.int64)
    by = np.argsort(keys, kind="stable")
    plan_by_rank = docs.sparkSession.sparkContext.broadcast((keys[by], where[by]))

    def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        keys, where = plan_by_rank.value
        for batch in batches:
            rank = batch["rank"].to_numpy()
            i = np.searchsorted(keys, rank, "right") - 1
            k = rank - keys[i]
            size, first, per, offset = (where[i, c] for c in (0, 2, 3, 4))
            yield pa.RecordBatch.from_arrays(
                [*(batch[c] for c in ("doc_id", "piece", "start", "length", "ids_crc32")), pa.array(first + k // per), pa.array(offset + k % per * size)],
                names=["doc_id", "piece", "start", "length", "ids_crc32", "sequence_id", "offset"],
            )

    return order.mapInArrow(place, "doc_id long, piece int, start long, length long, ids_crc32 long, sequence_id long, offset long")
