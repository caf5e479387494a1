"""Helpers shared by the operators of this subpackage."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from ..storage import numbered, shared_dir, stored


def parts(spark: SparkSession, at_least: int = 1) -> int:
    return max(at_least, int(spark.conf.get("spark.sql.shuffle.partitions")))


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def ranked(df: DataFrame, keys: list[str], name: str, rank: str = "rank") -> DataFrame:
    """Number all rows from 0 in the order of ``keys``; ties get different numbers."""
    return numbered(df, keys, name, rank)


def bytes_of(df: DataFrame, *sizes: Column) -> int:
    """Measured size of a table: the sum of the given per-row sizes."""
    total = df.agg(F.sum(sum(sizes, F.lit(0)).cast("long")).alias("n")).first()["n"]
    return int(total or 0)


def beside(big: DataFrame, small: DataFrame, key: str, how: str = "left", limit: int = 24 << 20, row_bytes: Column | None = None) -> DataFrame:
    """Join ``small`` (one row a key) to ``big``.

    ``small`` is broadcast if its measured size is within ``limit`` bytes; beyond that
    both sides are shuffled on ``key``.
    """
    size = bytes_of(small, row_bytes if row_bytes is not None else F.lit(48))
    return big.join(F.broadcast(small) if size <= limit else small, key, how)


def components(edges: DataFrame, name: str = "components", rounds: int = 40) -> DataFrame:
    """Connected components of ``edges`` (a long, b long), as rows (node, root).

    ``root`` is the smallest node of the component; nodes without an edge don't
    appear. Alternates large-star and small-star steps until all components are stars; each
    step is one aggregation and one equi-join, written to the shared folder, so the
    lineage stays short and hot centres are split by skew joins.
    """
    now = stored(_star(edges.select("a", "b").where("a <> b").select(F.greatest("a", "b").alias("a"), F.least("a", "b").alias("b")).distinct(), False), f"{name}-0")
    for i in range(1, rounds + 1):
        if _stars(now):
            break
        now = stored(_star(_star(now, True), False), f"{name}-{i}")
    else:
        raise RuntimeError(f"components did not settle in {rounds} rounds")
    roots = now.select(F.col("b").alias("node")).distinct()
    return now.select(F.col("a").alias("node"), F.col("b").alias("root")).union(roots.select("node", F.col("node").alias("root"))).distinct()


def _stars(edges: DataFrame) -> bool:
    """Whether every a has one b only and no b is an a, for edges with a > b: then each b is the smallest node of its component."""
    ends = edges.select(F.explode(F.array(F.struct(F.col("a").alias("node"), F.lit(1).alias("up")), F.struct(F.col("b").alias("node"), F.lit(0).alias("up")))).alias("e")).select("e.*")
    open_ = ends.groupBy("node").agg(F.sum("up").alias("up"), F.min("up").alias("least")).where("up > 1 OR up = 1 AND least = 0")
    return not open_.limit(1).count()


def _star(edges: DataFrame, large: bool) -> DataFrame:
    """One star step over edges with a > b. Large: link every larger neighbour to the
    smallest one, repeated edges left to the small step that follows; small: link every
    smaller neighbour and the node itself to it."""
    if large:
        both = edges.union(edges.select(F.col("b").alias("a"), F.col("a").alias("b")))
        least = both.groupBy("a").agg(F.min("b").alias("m")).select("a", F.least("a", "m").alias("m"))
        return both.where("b > a").join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).where("a <> b")
    least = edges.groupBy("a").agg(F.min("b").alias("m"))
    out = edges.join(least, "a").select(F.col("b").alias("a"), F.col("m").alias("b")).union(least.select("a", F.col("m").alias("b")))
    return out.where("a <> b").distinct()


def without(docs: DataFrame, rejected: DataFrame, limit: int = 1_000_000) -> DataFrame:
    """``docs`` but those that ``rejected`` names by (doc_id long, sig long), a hash of the text; nulls equal nulls.

    The pairs are broadcast if there are no more than ``limit`` (16 bytes each), else both sides are shuffled.
    """
    some = stored(rejected.select(F.coalesce("doc_id", F.lit(-(1 << 63))).alias("_doc"), F.coalesce("sig", F.lit(0)).alias("_sig")).distinct(), "rejected")
    named = docs.select(F.struct(*docs.columns).alias("_row"), F.coalesce(docs["doc_id"].cast("long"), F.lit(-(1 << 63))).alias("_doc"), F.xxhash64(docs["text"].cast("string")).alias("_sig"))
    return named.join(F.broadcast(some) if some.count() <= limit else some, ["_doc", "_sig"], "left_anti").select("_row.*")
