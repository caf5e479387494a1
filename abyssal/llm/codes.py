"""Vector codes by a filtering Lloyd iteration on product codebooks.

Vectors become integers and are cut into parts. Each task builds, over chunks of its
rows, one kd-tree a part, whose nodes keep bounding boxes, sums and counts, and writes
them once; no round builds them anew. A round walks each tree from the root with all
codebook entries: an entry leaves a node's list if no point of the node's box can be
nearer to it than to the entry nearest to the box's middle. A node with one entry left
is assigned whole, by its cached sum and count; only leaves with several left compare
points. Sums and counts of all chunks meet by part and entry in one aggregation.
"""

from __future__ import annotations

import hashlib
import io
from collections.abc import Iterator
from functools import cache

import numpy as np
import pyarrow as pa
from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .common import bytes_of, stored

CHUNK = 16_384
LEAF = 16
#: Numbers held at once for the (node, entry) pairs of a level.
_PAIRS = 1 << 21


@cache
def shape(n: int) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Start, end and first child (or -1) of each node of the balanced tree over ``n`` points; the root is node 0."""
    spans, child = [(0, n)], []
    for start, end in spans:
        child.append(len(spans) if end - start > LEAF else -1)
        if end - start > LEAF:
            middle = (start + end) // 2
            spans += [(start, middle), (middle, end)]
    at = np.array(spans, dtype=np.int64)
    return at[:, 0], at[:, 1], np.array(child, dtype=np.int64)


class Tree:
    """A kd-tree over integer points: their order in it, and each node's box and sum."""

    def __init__(self, points: np.ndarray, order: np.ndarray, low: np.ndarray, high: np.ndarray, total: np.ndarray):
        self.points, self.order, self.low, self.high, self.total = points, order, low, high, total

    @classmethod
    def over(cls, points: np.ndarray) -> Tree:
        starts, ends, child = shape(len(points))
        order, width = np.arange(len(points)), points.shape[1]
        low, high, total = (np.zeros((len(starts), width), dtype=np.int64) for _ in range(3))
        for node, (start, end) in enumerate(zip(starts, ends)):
            own = points[order[start:end]]
            low[node], high[node], total[node] = own.min(0), own.max(0), own.sum(0)
            if child[node] >= 0 and width:
                axis, middle = int((high[node] - low[node]).argmax()), (start + end) // 2 - start
                order[start:end] = order[start:end][np.argpartition(own[:, axis], middle)]
        return cls(points[order], order, low, high, total)

    def assigned(self, book: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
        """Nearest entry of each point in the tree's order, ties to the lower index, and each entry's count and sum of points."""
        starts, ends, child = shape(len(self.points))
        size = (book * book).sum(1)
        label, counts, sums = np.zeros(len(self.points), dtype=np.int64), np.zeros(len(book), dtype=np.int64), np.zeros_like(book)
        nodes, lists = np.zeros(1, dtype=np.int64), np.zeros((1, len(book)), dtype=bool)
        lists[:] = True
        while len(nodes):
            after: list[tuple[np.ndarray, np.ndarray]] = []
            step = max(1, _PAIRS // max(1, len(book) * book.shape[1]))
            for at in range(0, len(nodes), step):
                node, left = nodes[at : at + step], self._filtered(nodes[at : at + step], lists[at : at + step], book, size)
                alone = left.sum(1) == 1
                entry = left[alone].argmax(1)
                for start, end, e in zip(starts[node[alone]], ends[node[alone]], entry):
                    label[start:end] = e
                np.add.at(counts, entry, ends[node[alone]] - starts[node[alone]])
                np.add.at(sums, entry, self.total[node[alone]])
                leaf = ~alone & (child[node] < 0)
                for i, one in zip(node[leaf], left[leaf]):
                    own, entries = self.points[starts[i] : ends[i]], np.flatnonzero(one)
                    label[starts[i] : ends[i]] = best = entries[(size[entries] - 2 * (own @ book[entries].T)).argmin(1)]
                    np.add.at(counts, best, 1)
                    np.add.at(sums, best, own)
                inner = ~alone & (child[node] >= 0)
                after += [(child[node[inner]] + side, left[inner]) for side in (0, 1)]
            nodes, lists = (np.concatenate(x) for x in zip(*after)) if after else (nodes[:0], lists[:0])
        return label, counts, sums

    def _filtered(self, node: np.ndarray, lists: np.ndarray, book: np.ndarray, size: np.ndarray) -> np.ndarray:
        """Which entries of each node's list stay: those that can be nearest to some point of its box."""
        row, entry = np.nonzero(lists)
        low, high = self.low[node], self.high[node]
        first = np.searchsorted(row, np.arange(len(node)))
        gap = (2 * book[entry] - (low + high)[row]) ** 2
        gap = gap.sum(1)
        nearest = np.flatnonzero(gap == np.minimum.reduceat(gap, first)[row])
        best = entry[nearest[np.searchsorted(row[nearest], np.arange(len(node)))]]
        way = book[entry] - book[best][row]
        corner = np.where(way > 0, high[row], low[row])
        more = size[entry] - size[best][row] - 2 * (corner * way).sum(1)
        out = np.zeros_like(lists)
        stays = (more < 0) | ((more == 0) & (entry <= best[row]))
        out[row[stays], entry[stays]] = True
        return out


def cuts(length: int, parts: int) -> list[tuple[int, int]]:
    return [(i * length // parts, (i + 1) * length // parts) for i in range(parts)]


def _saved(points: np.ndarray, parts: int) -> bytes:
    """Trees of all parts as bytes, each array in the smallest type that holds it."""
    arrays, kinds = {}, (np.int16, np.int32, np.int64)
    for p, (start, end) in enumerate(cuts(points.shape[1], parts)):
        tree = Tree.over(points[:, start:end])
        for name in ("points", "order", "low", "high", "total"):
            x = getattr(tree, name)
            arrays[f"{name}{p}"] = x.astype(next(k for k in kinds if not x.size or np.iinfo(k).min <= x.min() and x.max() <= np.iinfo(k).max))
    out = io.BytesIO()
    np.savez(out, **arrays)
    return out.getvalue()


def _loaded(saved: bytes, parts: int) -> list[Tree]:
    with np.load(io.BytesIO(saved)) as x:
        return [Tree(*(x[f"{name}{p}"].astype(np.int64) for name in ("points", "order", "low", "high", "total"))) for p in range(parts)]


def _trees(rows: DataFrame, length: int, parts: int, kind: str) -> DataFrame:
    """Rows (ids, labels, trees), each over at most ``CHUNK`` vectors of a task."""
    most = 1 << (30 - max(1, length).bit_length() // 2)

    def build(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        held: list[pa.RecordBatch] = []

        def row(some: pa.Table) -> pa.RecordBatch:
            some = some.combine_chunks()
            v = some["v"].chunk(0).flatten().to_numpy(zero_copy_only=False).astype(np.int64).reshape(some.num_rows, length)
            if v.size and np.abs(v).max() >= most:
                raise ValueError(f"a component is {np.abs(v).max()} after scaling; squared distances are exact below {most}")
            one = lambda c: pa.ListArray.from_arrays(pa.array([0, some.num_rows], pa.int32()), some[c].chunk(0))
            return pa.RecordBatch.from_arrays([one("vec_id"), one("label"), pa.array([_saved(v, parts)], pa.binary())], names=["ids", "labels", "trees"])

        n = 0
        for batch in batches:
            for at in range(0, batch.num_rows, CHUNK):
                held.append(batch.slice(at, CHUNK))
                n += held[-1].num_rows
                if n >= CHUNK:
                    whole = pa.Table.from_batches(held)
                    yield row(whole.slice(0, CHUNK))
                    held, n = whole.slice(CHUNK).to_batches(), n - CHUNK
        if n:
            yield row(pa.Table.from_batches(held))

    return rows.mapInArrow(build, f"ids array<bigint>, labels array<{kind}>, trees binary")


def _round(chunks: DataFrame, books: list[np.ndarray], parts: int) -> list[np.ndarray]:
    """The next codebooks: each entry the floor of the mean of the parts nearest to it; unused ones stay."""

    def sums(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        counts, totals = [np.zeros(len(b), dtype=np.int64) for b in books], [np.zeros_like(b) for b in books]
        for batch in batches:
            for saved in batch["trees"]:
                for p, tree in enumerate(_loaded(saved.as_py(), parts)):
                    _, n, total = tree.assigned(books[p])
                    counts[p] += n
                    totals[p] += total
        some = [(p, e, int(n), totals[p][e].tolist()) for p in range(parts) for e, n in enumerate(counts[p]) if n]
        kinds = (pa.int32(), pa.int32(), pa.int64(), pa.list_(pa.int64()))
        yield pa.RecordBatch.from_arrays([pa.array(c, k) for c, k in zip(list(zip(*some)) or [()] * 4, kinds)], names=["part", "entry", "n", "total"])

    found = chunks.select("trees").mapInArrow(sums, "part int, entry int, n bigint, total array<bigint>")
    met = found.select("part", "entry", "n", F.posexplode_outer("total").alias("place", "x")).groupBy("part", "entry", "place").agg(F.sum("n").alias("n"), F.sum("x").alias("x"))
    out = [b.copy() for b in books]
    for r in met.collect():  # a row a number of the codebooks at most
        if r["place"] is not None:
            out[r["part"]][r["entry"], r["place"]] = r["x"] // r["n"]
    return out


def _coded(chunks: DataFrame, books: list[np.ndarray], parts: int, kind: str) -> DataFrame:
    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            for ids, labels, saved in zip(batch["ids"], batch["labels"], batch["trees"]):
                trees = _loaded(saved.as_py(), parts)
                codes, error = np.zeros((len(ids), parts), dtype=np.uint8), np.zeros(len(ids), dtype=np.int64)
                for p, tree in enumerate(trees):
                    label, _, _ = tree.assigned(books[p])
                    codes[tree.order, p] = label
                    error[tree.order] += ((tree.points - books[p][label]) ** 2).sum(1)
                text = pa.array([c.tobytes().hex() for c in codes], pa.string())
                yield pa.RecordBatch.from_arrays([ids.values, labels.values, text, pa.array(error)], names=["vec_id", "label", "code", "error"])

    return chunks.mapInArrow(code, f"vec_id bigint, label {kind}, code string, error bigint")


def _digest(books: list[np.ndarray]) -> str:
    return hashlib.sha256(",".join(str(x) for b in books for x in b.ravel().tolist()).encode()).hexdigest()


def encode(
    vectors: DataFrame, parts: int = 4, entries: int = 256, rounds: int = 4, scale: int = 1024, id_col: str = "vec_id", vector_col: str = "embedding", label_col: str = "label"
) -> DataFrame:
    """Rows (vec_id, code, error, label_error, codebooks_sha256) of all vectors with finite components.

    Components become floor(scale * x), vectors are cut into ``parts`` consecutive parts (of lengths that differ
    by one at most where ``parts`` does not divide). A part's codebook starts as that part of the ``entries``
    smallest ids and goes through ``rounds`` rounds. ``code`` is two hex digits a part, ``error`` the sum of squared
    distances, ``label_error`` their sum over the rows of the same label (nulls are one label).

    Vectors that are null or hold null or non-finite components are left out; zero vectors stay. Rows without an id are
    coded, and come after all ids where codebooks start; of repeated ids, the smallest vector starts them. Repeated rows are
    rows. Vectors of several lengths are coded each length on its own, so ``codebooks_sha256`` is one a length; vectors of no
    length get code 0 and no error. Fewer vectors than entries give a shorter codebook, an empty table no rows. Components
    too large for exact 64-bit distances (about 2^17 for 64 components) raise an error. Other columns are not looked at.
    """
    if not 1 <= entries <= 256:
        raise ValueError("codes have one byte a part, so 1 to 256 entries")
    spark, kind = vectors.sparkSession, vectors.schema[label_col].dataType.simpleString()
    v = F.col(vector_col)
    finite = v.isNotNull() & F.forall(v, lambda x: x.isNotNull() & ~F.isnan(x.cast("double")) & (F.abs(x.cast("double")) < float("inf")))
    whole = F.transform(v, lambda x: F.floor(x.cast("double") * scale).cast("bigint"))
    rows = vectors.where(finite).select(F.col(id_col).cast("bigint").alias("vec_id"), F.col(label_col).alias("label"), whole.alias("v"))
    coded = [_of_length(spark, rows.where(F.size("v") == n), n, parts, entries, rounds, kind) for n in sorted(r[0] for r in rows.select(F.size("v")).distinct().collect())]
    if not coded:
        return spark.createDataFrame([], "vec_id bigint, code string, error bigint, label_error bigint, codebooks_sha256 string")
    out = coded[0]
    for more in coded[1:]:
        out = out.unionByName(more)
    out = stored(out, "vector-codes")
    sums = out.groupBy(F.col("label").alias("_label")).agg(F.sum("error").alias("label_error"))
    small = bytes_of(sums, F.lit(48)) <= 24 << 20
    met = out.join(F.broadcast(sums) if small else sums, F.col("label").eqNullSafe(F.col("_label")))
    return met.select("vec_id", "code", "error", "label_error", "codebooks_sha256")


def _of_length(spark: SparkSession, rows: DataFrame, length: int, parts: int, entries: int, rounds: int, kind: str) -> DataFrame:
    ids = rows.select(F.col("vec_id").alias("_id")).distinct().orderBy(F.col("_id").asc_nulls_last()).limit(entries)
    first = rows.join(F.broadcast(ids), F.col("vec_id").eqNullSafe(F.col("_id"))).groupBy("vec_id").agg(F.min("v").alias("v"))
    seeds = sorted(((r["vec_id"], r["v"]) for r in first.collect()), key=lambda x: (x[0] is None, x[0] or 0))
    start = np.array([v for _, v in seeds], dtype=np.int64).reshape(len(seeds), length)
    books = [start[:, a:b] for a, b in cuts(length, parts)]
    chunks = stored(_trees(rows, length, parts, kind), "vector-trees")
    for _ in range(rounds):
        books = _round(chunks, books, parts)
    return _coded(chunks, books, parts, kind).withColumn("codebooks_sha256", F.lit(_digest(books)))
