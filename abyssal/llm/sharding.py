"""Minimax contiguous sharding of documents.

Equal texts form an atomic group. Groups stand in the order of their text's digest; a
shard is a stretch of that order. The smallest feasible capacity is found by binary
search, each candidate checked greedily, and the stretches are cut there.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame
from pyspark.sql import functions as F

from .common import parts, ranked, stored

#: Stretches of the order that the driver holds about at a time in the search.
FENCES = 4096


def greedy(ends: np.ndarray, capacity: int, shards: int, at: int = 0) -> list[int] | None:
    """Cut after the farthest end that keeps each stretch within ``capacity``; None if ``shards`` are too few."""
    cuts = []
    for _ in range(shards):
        i = int(np.searchsorted(ends, at + capacity, "right")) - 1
        if i < 0 or ends[i] <= at:
            return None
        at = int(ends[i])
        cuts.append(at)
        if at == ends[-1]:
            return cuts
    return None


@dataclass
class Spans:
    """What the driver knows of the groups' ends: stretches of the order that hold them, as first end, last end and number."""

    low: np.ndarray
    high: np.ndarray
    count: np.ndarray

    def cuts(self, capacity: int, shards: int, hope: bool) -> list[int] | None:
        """``greedy`` over the known ends; with ``hope`` also over any place between the ends of a stretch that holds others."""
        cuts, at, last = [], 0, int(self.high[-1])
        for _ in range(shards):
            most = at + capacity
            i = int(np.searchsorted(self.low, most, "right")) - 1
            if i < 0:
                return None
            if most >= self.high[i]:
                to = int(self.high[i])
            else:
                to = most if hope and self.count[i] > 2 else int(self.low[i])
            if to <= at:
                return None
            at = to
            cuts.append(at)
            if at == last:
                return cuts
        return None

    def least(self, low: int, shards: int, hope: bool) -> int:
        """Smallest capacity of at least ``low`` that these cuts allow."""
        high = max(low, int(self.high[-1]))
        while low < high:
            middle = (low + high) // 2
            low, high = (low, middle) if self.cuts(middle, shards, hope) else (middle + 1, high)
        return low

    def ends(self) -> np.ndarray:
        return np.unique(np.concatenate([self.low, self.high]))


def even_cuts(ends: np.ndarray, capacity: int, shards: int) -> list[int]:
    """Cuts that keep within ``capacity``, each as near as that allows to an even share of what is left.

    Where a group alone sets the capacity, filling every shard up to it would leave the last ones empty.
    """
    cuts, at, total = [], 0, int(ends[-1])
    for left in range(shards, 1, -1):
        if at == total:
            break
        near = ends[(ends > at) & (ends <= at + capacity)]
        low, high = 0, len(near) - 1  # the first end from which the rest still fits
        while low < high:
            middle = (low + high) // 2
            fits = near[middle] == total or greedy(ends, capacity, left - 1, int(near[middle]))
            low, high = (low, middle) if fits else (middle + 1, high)
        share = at + (total - at) / left
        at = int(near[max(low, int(np.abs(near - share).argmin()))])
        cuts.append(at)
    return cuts if at == total else [*cuts, total]


def _summed(groups: DataFrame) -> tuple[DataFrame, int, int]:
    """Groups in digest order with the bytes up to each one's end; their total and the largest."""

    def run(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        from pyspark import TaskContext

        part, total = TaskContext.get().partitionId(), 0
        for batch in batches:
            ends = total + np.cumsum(batch["bytes"].to_numpy())
            total = int(ends[-1]) if len(ends) else total
            yield pa.RecordBatch.from_arrays(
                [batch["key"], batch["bytes"], pa.array(ends), pa.array(np.full(len(ends), part, dtype=np.int32))],
                names=["key", "bytes", "local_end", "part"],
            )

    spark = groups.sparkSession
    local = stored(
        groups.repartitionByRange(parts(spark), "key").sortWithinPartitions("key").mapInArrow(run, "key binary, bytes long, local_end long, part int"),
        "shard-groups",
    )
    sums = local.groupBy("part").agg(F.max("local_end").alias("n"), F.max("bytes").alias("m")).orderBy("part").collect()
    offsets, total = [0] * (max((r["part"] for r in sums), default=0) + 1), 0
    for r in sums:
        offsets[r["part"]], total = total, total + r["n"]
    end = F.col("local_end") + F.element_at(F.lit(offsets).cast("array<bigint>"), F.col("part") + 1)
    return local.select("key", "bytes", end.alias("end")), total, max((r["m"] for r in sums), default=0)


def cut_points(groups: DataFrame, shards: int) -> list[bytes]:
    """Last key of each shard but the empty ones, for groups (key binary, bytes long).

    The driver sees at most about ``FENCES`` stretches of the order at a time. Known ends
    alone bound the smallest capacity from above, known ends and any place where others
    may be bound it from below; the stretches in which the cuts of both bounds fall are
    split further until the bounds meet or there is nothing left to split there.
    """
    sized, total, largest = _summed(groups)
    if not total:
        return []
    least = max(largest, -(-total // shards))
    spans = _split(sized, Spans(np.array([0]), np.array([total]), np.array([1 << 62])), np.array([True]))
    while True:
        lower, upper = spans.least(least, shards, True), spans.least(least, shards, False)
        if lower == upper:
            break
        # Cut j of any capacity between the bounds lies between cut j over known ends of the lower and hoped-for cut j of the upper.
        near, at = np.zeros(len(spans.low), dtype=bool), 0
        hoped = spans.cuts(upper, shards, True)
        for j in range(shards):
            i = max(0, int(np.searchsorted(spans.low, at + lower, "right")) - 1)
            at = max(at, int(spans.high[i] if spans.high[i] <= at + lower else spans.low[i]))
            near |= (spans.high >= at) & (spans.low <= (hoped[j] if j < len(hoped) else total))
        near &= spans.count > 2
        if not near.any():
            break
        spans = _split(sized, spans, near)
    cuts = even_cuts(spans.ends(), upper, shards)
    last = {r["end"]: bytes(r["key"]) for r in sized.where(F.col("end").isin(cuts)).collect()}
    return [last[c] for c in cuts]


def _split(sized: DataFrame, spans: Spans, which: np.ndarray) -> Spans:
    """The spans with those of ``which`` split into about ``FENCES`` in all."""
    low, high = spans.low[which], spans.high[which]
    each = max(2, FENCES // len(low))
    step = np.maximum(1, -(-(high - low + 1) // each))

    def slots(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            end = np.sort(batch["end"].to_numpy())
            i = np.searchsorted(low, end, "right") - 1
            ok = (i >= 0) & (end <= high[i])
            end, i = end[ok], i[ok]
            names, start, n = np.unique(i * each + (end - low[i]) // step[i], return_index=True, return_counts=True)
            if len(names):
                yield pa.RecordBatch.from_arrays([pa.array(x) for x in (names, end[start], end[start + n - 1], n)], names=["slot", "low", "high", "n"])

    summed = sized.select("end").mapInArrow(slots, "slot long, low long, high long, n long").groupBy("slot")
    found = summed.agg(F.min("low").alias("low"), F.max("high").alias("high"), F.sum("n").alias("n")).collect()
    columns = [np.concatenate([a[~which], np.array([r[c] for r in found], dtype=np.int64)]) for a, c in ((spans.low, "low"), (spans.high, "high"), (spans.count, "n"))]
    order = np.argsort(columns[0])
    return Spans(*(c[order] for c in columns))


def shard(docs: DataFrame, shards: int = 8) -> DataFrame:
    """Rows (doc_id, size, text_crc32, law, shard, slot, grown_shard) of every document.

    ``size`` is the text's UTF-8 bytes plus 1. The law is ``bytes``: the largest shard
    is as small as contiguous stretches of whole groups of equal texts allow, and the
    others are as even as that lets them be. Null
    texts (no bytes, checksum 0) form a group of their own. Repeated rows each get a
    slot; slots of a shard run from 0 without gaps. An empty table gives no rows;
    other columns are ignored.
    """
    raw = F.col("text").cast("string").cast("binary")
    rows = stored(
        docs.select(
            F.col("doc_id").cast("long").alias("doc_id"),
            (F.coalesce(F.octet_length(raw), F.lit(0)) + 1).cast("long").alias("size"),
            F.coalesce(F.crc32(raw), F.lit(0)).cast("long").alias("text_crc32"),
            F.coalesce(F.unhex(F.sha2(raw, 256)), F.lit(b"")).alias("key"),
        ),
        "shard-rows",
    )
    last = cut_points(rows.groupBy("key").agg(F.sum("size").alias("bytes")), shards)
    number = F.lit(0)
    for key in last[:-1]:
        number = number + (F.col("key") > F.lit(key)).cast("int")
    order = ranked(rows.withColumn("shard", number), ["key", "doc_id"], "shard-order")
    counts = {r["shard"]: r["n"] for r in order.groupBy("shard").agg(F.count("*").alias("n")).collect()}
    starts = np.concatenate([[0], np.cumsum([counts.get(s, 0) for s in range(shards)])])[:-1].tolist()
    slot = F.col("rank") - F.element_at(F.lit(starts).cast("array<bigint>"), F.col("shard") + 1)
    return order.select("doc_id", "size", "text_crc32", F.lit("bytes").alias("law"), "shard", slot.alias("slot"), F.lit(None).cast("int").alias("grown_shard"))
