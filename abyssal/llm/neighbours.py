"""Approximate nearest neighbours with score-aware (anisotropic) quantisation.

Every vector is scaled to unit length and coded by 4-bit product quantisation whose
loss weighs the residual along the vector more than the residual across it, since the
former moves inner products. Queries and coded vectors meet in blocks; a block's
codes are scanned with per-query lookup tables. The best of each scan are scored exactly
on the original vectors, and so is every other vector whose scan score and quantisation
error leave it a chance to enter, before the blocks' results are merged.
"""

from __future__ import annotations

from collections.abc import Iterator
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import stored

CODES = 16
#: Queries whose lookup tables a task holds at a time.
TABLES = 64


@dataclass(frozen=True)
class Quantiser:
    """Codebooks of shape (subspaces, 16, width) and the weight of parallel residuals."""

    books: np.ndarray
    eta: float

    def split(self, unit: np.ndarray) -> np.ndarray:
        m, _, width = self.books.shape
        out = np.zeros((len(unit), m * width))
        out[:, : unit.shape[1]] = unit
        return out.reshape(len(unit), m, width)

    def encode(self, unit: np.ndarray, sweeps: int = 2) -> np.ndarray:
        """Codes (rows, subspaces): nearest ones first, then each in turn against the others' parallel residual."""
        x = self.split(unit)
        codes = np.stack([((x[:, j, None] - b) ** 2).sum(2).argmin(1) for j, b in enumerate(self.books)], axis=1)
        residual = x - self.books[np.arange(len(self.books)), codes]
        along = (residual * x).sum(2)
        for _ in range(sweeps):
            for j, b in enumerate(self.books):
                gap = x[:, j, None] - b
                own = (gap * x[:, j, None]).sum(2)
                rest = along.sum(1) - along[:, j]
                codes[:, j] = ((gap**2).sum(2) + (self.eta - 1) * (rest[:, None] + own) ** 2).argmin(1)
                along[:, j] = own[np.arange(len(x)), codes[:, j]]
        return codes.astype(np.uint8)

    def decode(self, codes: np.ndarray) -> np.ndarray:
        """Coded vectors (rows, subspaces * width) of codes packed two a byte."""
        one = np.stack([codes >> 4, codes & 15], axis=2).reshape(len(codes), -1)[:, : len(self.books)]
        return self.books[np.arange(len(self.books)), one].reshape(len(codes), -1)

    def tables(self, queries: np.ndarray) -> np.ndarray:
        """Inner products (queries, pairs of subspaces, 256) for a byte that holds two codes."""
        one = np.einsum("qmw,mcw->qmc", self.split(queries), self.books)
        if one.shape[1] % 2:
            one = np.concatenate([one, np.zeros_like(one[:, :1])], axis=1)
        return (one[:, 0::2, :, None] + one[:, 1::2, None, :]).reshape(len(queries), -1, 256).astype(np.float32)


def packed(codes: np.ndarray) -> np.ndarray:
    """Two 4-bit codes a byte."""
    if codes.shape[1] % 2:
        codes = np.concatenate([codes, np.zeros_like(codes[:, :1])], axis=1)
    return (codes[:, 0::2] << 4) | codes[:, 1::2]


def fit(sample: np.ndarray, width: int = 2, threshold: float = 0.2, sweeps: int = 5, seed: int = 7) -> Quantiser:
    """Codebooks for unit vectors: k-means by subspace, then alternating updates of the
    anisotropic loss, whose weight follows from the score ``threshold`` of interest."""
    dim = sample.shape[1]
    m, rng = -(-dim // width), np.random.default_rng(seed)
    eta = max(1.0, (dim - 1) * threshold**2 / (1 - threshold**2))
    x = np.zeros((len(sample), m * width))
    x[:, :dim] = sample
    x = x.reshape(len(sample), m, width)
    books = np.stack([x[rng.choice(len(x), CODES, replace=len(x) < CODES), j] for j in range(m)])
    for _ in range(8):
        for j in range(m):
            code = ((x[:, j, None] - books[j]) ** 2).sum(2).argmin(1)
            n = np.bincount(code, minlength=CODES)
            for w in range(width):
                books[j, :, w] = np.where(n, np.bincount(code, x[:, j, w], CODES) / np.maximum(n, 1), books[j, :, w])
    for _ in range(sweeps):
        codes = Quantiser(books, eta).encode(sample, 1).astype(int)
        along = ((x - books[np.arange(m), codes]) * x).sum(2)
        for j in range(m):
            code, xj = codes[:, j], x[:, j]
            rest = along.sum(1) - along[:, j]
            n = np.bincount(code, minlength=CODES)
            pull = (eta - 1) * (rest + (xj * xj).sum(1))
            a = np.zeros((CODES, width, width))
            b = np.zeros((CODES, width))
            for u in range(width):
                b[:, u] = np.bincount(code, xj[:, u] * (1 + pull), CODES)
                for v in range(width):
                    a[:, u, v] = (u == v) * (n + 1e-9) + (eta - 1) * np.bincount(code, xj[:, u] * xj[:, v], CODES)
            solved = np.linalg.solve(a, b[:, :, None])[:, :, 0]
            books[j] = np.where(n[:, None] > 0, solved, books[j])
            along[:, j] = ((xj - books[j][code]) * xj).sum(1)
    return Quantiser(books, eta)


def usable(vector: Column) -> Column:
    """Not null, not zero, and without null or non-finite components."""
    finite = F.forall(vector, lambda v: v.isNotNull() & ~F.isnan(v) & (F.abs(v) < float("inf")))
    return F.coalesce(vector.isNotNull() & finite & F.exists(vector, lambda v: v != 0), F.lit(False))


def _matrix(column: pa.Array | pa.ChunkedArray, dim: int) -> np.ndarray:
    if isinstance(column, pa.ChunkedArray):
        column = column.combine_chunks()
    return column.flatten().to_numpy(zero_copy_only=False).astype(np.float64).reshape(-1, dim)


def _unit(x: np.ndarray) -> np.ndarray:
    x = x / np.abs(x).max(axis=1, keepdims=True)
    return x / np.sqrt((x * x).sum(1, keepdims=True))


#: Rounding of a scan in single precision, far above what sums of table entries can lose.
_SLACK = 1e-5


def _bounds(unit: np.ndarray, coded: np.ndarray) -> tuple[np.ndarray, np.ndarray, np.ndarray]:
    """Length of each coded vector, and cosine and sine of its angle to the unit vector that it codes."""
    norm = np.maximum(np.sqrt((coded * coded).sum(1)), 1e-30)
    cos = np.clip((unit * coded[:, : unit.shape[1]]).sum(1) / norm, -1, 1)
    return norm, cos, np.sqrt(1 - cos * cos)


def _at_most(score: np.ndarray, norm: np.ndarray, cos: np.ndarray, sin: np.ndarray) -> np.ndarray:
    """Largest exact score that each scan score allows: the angle to the query is no less
    than the query's angle to the coded vector less that between coded and exact vector."""
    c = np.clip(score / norm, -1, 1)
    return np.where(c >= cos, 1.0, c * cos + np.sqrt(1 - c * c) * sin) + _SLACK + _SLACK / norm


def _scale(x: np.ndarray) -> np.ndarray:
    """``x`` with each row brought near one by a power of two, which changes no digit of a cosine."""
    return np.ldexp(x, -np.frexp(np.abs(x).max(axis=1, keepdims=True))[1])


def _dots(x: np.ndarray, y: np.ndarray) -> np.ndarray:
    """Inner products of the rows of ``x`` with ``y``, summed component by component, so that equal rows score alike anywhere."""
    out = np.zeros(len(x))
    for j in range(x.shape[1]):
        out += x[:, j] * y[..., j]
    return out


def _first(score: np.ndarray, k: int) -> np.ndarray:
    """Places of the ``k`` largest scores; of equal ones those that come first."""
    if len(score) <= k:
        return np.arange(len(score))
    edge = np.partition(score, len(score) - k)[len(score) - k]
    above = np.flatnonzero(score > edge)
    return np.concatenate([above, np.flatnonzero(score == edge)[: k - len(above)]])


def search(
    vectors: DataFrame,
    query_every: int = 50,
    k: int = 5,
    id_col: str = "vec_id",
    vector_col: str = "embedding",
    fit_rows: int = 20_000,
    block_rows: int = 20_000,
    query_rows: int = 32_768,
    rerank: int = 100,
) -> DataFrame:
    """Rows (query_id, rank, vec_id, score): the ``k`` nearest by cosine of every vector whose
    id is divisible by ``query_every``, its own row left out.

    ``fit_rows`` bounds the sample that the quantiser is fitted on (by hash of the id);
    every row is coded and scanned. Of each block of ``block_rows`` coded vectors the
    ``rerank`` best by table scan are scored exactly in double precision, then, in growing
    batches, all whose scan score and quantisation error allow a score as good as the
    ``k``-th best so far, so the result is that of comparing all vectors. Vectors that are
    null, zero or hold null or non-finite components take no part, nor do those of
    another length than most of the sample and rows without an id; repeated rows are
    candidates of their own, but each id asks once, by the smallest of its vectors. Ties go
    to the smaller id. ``score`` is the sum of products over the product of both lengths,
    each summed in the order of the components. An empty table gives no rows.
    """
    spark, schema = vectors.sparkSession, "query_id long, rank int, vec_id long, score double"
    rows = vectors.select(F.col(id_col).cast("long").alias("vec_id"), F.col(vector_col).cast("array<double>").alias("v")).where(F.col("vec_id").isNotNull() & usable(F.col("v")))
    sample = [r["v"] for r in rows.withColumn("h", F.xxhash64("vec_id")).orderBy("h", "vec_id").limit(fit_rows).select("v").collect()]
    if not sample:
        return spark.createDataFrame([], schema)
    lengths = np.bincount([len(v) for v in sample])
    dim = int(lengths.argmax())
    quantiser = fit(np.unique(_unit(np.array([v for v in sample if len(v) == dim])), axis=0))
    shared = spark.sparkContext.broadcast(quantiser)

    def code(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            if batch.num_rows:
                codes = packed(shared.value.encode(_unit(_matrix(batch["v"], dim))))
                yield pa.RecordBatch.from_arrays([batch["vec_id"], batch["v"], pa.array([c.tobytes() for c in codes], pa.binary())], names=["vec_id", "v", "code"])

    index = stored(rows.where(F.size("v") == dim).mapInArrow(code, "vec_id long, v array<double>, code binary"), "vector-index")
    asking = index.where(F.col("vec_id") % query_every == 0).groupBy("vec_id").agg(F.min("v").alias("v"))
    total, asked = index.count(), asking.count()
    blocks, query_blocks = max(1, -(-total // block_rows)), max(1, -(-asked // query_rows))

    def dealt(df: DataFrame, by: str, n: int, over: str, times: int) -> DataFrame:
        every = F.explode(F.sequence(F.lit(0), F.lit(times - 1)))
        return df.withColumn(by, F.pmod(F.xxhash64("vec_id"), F.lit(n)).cast("int")).withColumn(over, every)

    against = dealt(index, "block", blocks, "query_block", query_blocks).groupBy("block", "query_block")
    queries = dealt(asking, "query_block", query_blocks, "block", blocks).groupBy("block", "query_block")

    def scan(asked: pa.Table, coded: pa.Table) -> pa.Table:
        out: list[tuple[int, int, float]] = []
        if asked.num_rows and coded.num_rows:
            coded = coded.sort_by("vec_id")
            ids, v = coded["vec_id"].to_numpy(), _matrix(coded["v"], dim)
            byte = np.frombuffer(b"".join(coded["code"].to_pylist()), dtype=np.uint8).reshape(len(ids), -1).T
            asked_v = _matrix(asked["v"], dim)
            q, bounds, v, wanted = _unit(asked_v), _bounds(_unit(v), shared.value.decode(byte.T)), _scale(v), _scale(asked_v)
            length, own = np.sqrt(_dots(v, v)), np.sqrt(_dots(wanted, wanted))
            exact_of = lambda i, rows: _dots(v[rows], wanted[i]) / (own[i] * length[rows])
            for i, name in enumerate(asked["vec_id"].to_pylist()):
                if i % TABLES == 0:
                    tables = shared.value.tables(q[i : i + TABLES])
                score = np.zeros(len(ids), dtype=np.float32)
                for part, codes in zip(tables[i % TABLES], byte):
                    score += part[codes]
                most = _at_most(score.astype(np.float64), *bounds)
                score[ids == name] = most[ids == name] = -np.inf
                near = np.sort(_first(score, rerank))
                near = near[ids[near] != name]
                exact = exact_of(i, near)
                most[near] = -np.inf
                best, size = np.lexsort((ids[near], -exact))[:k], rerank
                while True:
                    left = np.flatnonzero(most >= exact[best[-1]]) if len(best) == k else np.flatnonzero(most > -np.inf)
                    if not len(left):
                        break
                    left = left[_first(most[left], size)]
                    near, exact, most[left] = np.concatenate([near[best], left]), np.concatenate([exact[best], exact_of(i, left)]), -np.inf
                    best, size = np.lexsort((ids[near], -exact))[:k], 2 * size
                out += [(name, int(ids[near[b]]), float(exact[b])) for b in best]
        cols = list(zip(*out)) or [()] * 3
        return pa.table([pa.array(c, t) for c, t in zip(cols, (pa.int64(), pa.int64(), pa.float64()))], names=["query_id", "vec_id", "score"])

    found = queries.cogroup(against).applyInArrow(scan, "query_id long, vec_id long, score double")
    place = F.row_number().over(Window.partitionBy("query_id").orderBy(F.desc("score"), "vec_id"))
    return found.withColumn("rank", place).where(F.col("rank") <= k).select("query_id", F.col("rank").cast("int").alias("rank"), "vec_id", "score")
