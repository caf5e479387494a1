"""Ranked lexical search over blocks of postings with maxima, per shard of documents.

A pass over the texts keeps, for each document, its number of terms and the counts of the
terms that are asked for. Each task turns its rows into shards: documents in the
order of their ids and, for each term, its postings with their parts of the score.
Dynamic programming cuts postings into blocks of variable length, so that the sum of
what the blocks' maxima overstate, plus a cost a block, is least. A search bounds every document
by the maxima of the blocks that reach over it; those whose bound reaches the k-th best
score known so far are the pivots, tested all at once. It takes the lists from the one with the largest part
on, reads only their blocks with a pivot, and puts what it reads in place of the maxima, so that
pivots fall away and the blocks of long lists are skipped. The best of all shards meet at the end.
"""

from __future__ import annotations

import math
import re
from collections import Counter
from collections.abc import Iterator

import numpy as np
import pyarrow as pa
from pyspark.sql import Column, DataFrame, Window
from pyspark.sql import functions as F

from .common import numbered, stored

#: Fixed values of the ranking: what a term is, and the letters that are lower-cased.
TERM = r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+"
UPPER, LOWER = "ABCDEFGHIJKLMNOPQRSTUVWXYZ", "abcdefghijklmnopqrstuvwxyz"

#: Documents and postings of a shard at most (one document may hold more postings).
SHARD_DOCS, SHARD_POSTINGS = 32_768, 2_000_000
#: Postings of a block at most, and of the stretches of a list that are cut on their own.
LONGEST, STRETCH = 64, 256
#: What a block costs, in postings of the list's mean part of the score.
BLOCK_COST = 1.0

_FIND = re.compile(TERM).findall
_LOWER = str.maketrans(UPPER, LOWER)


def terms_of(text: str) -> list[str]:
    return _FIND(text.translate(_LOWER))


def cut(values: np.ndarray, starts: np.ndarray) -> np.ndarray:
    """Whether a block starts at each posting, for lists of ``values`` that begin at ``starts`` (the last is the end)."""
    out = np.zeros(len(values), dtype=bool)
    sizes = np.diff(starts)
    mean = np.add.reduceat(values, starts[:-1]) / sizes if len(sizes) else np.zeros(0)
    pieces = -(-sizes // STRETCH)
    of = np.repeat(np.arange(len(sizes)), pieces)
    nth = np.arange(len(of)) - np.repeat(np.cumsum(pieces) - pieces, pieces)
    first = starts[:-1][of] + nth * STRETCH
    length = np.minimum(STRETCH, starts[1:][of] - first)
    order = np.argsort(length, kind="stable")
    for at in range(0, len(order), 4096):
        some = order[at : at + 4096]
        _cut(values, first[some], length[some], BLOCK_COST * mean[of[some]], out)
    return out


def _cut(values: np.ndarray, first: np.ndarray, length: np.ndarray, cost: np.ndarray, out: np.ndarray) -> None:
    """Least sum of (length of block x its maximum) plus ``cost`` a block, for many stretches side by side."""
    n, rows = int(length.max(initial=0)), np.arange(len(first))
    peak, before = np.zeros((len(first), LONGEST)), np.full((len(first), LONGEST), np.inf)
    size = np.zeros(LONGEST)
    choice, best = np.zeros((n, len(first)), dtype=np.int64), np.zeros(len(first))
    for i in range(n):
        here = values[np.minimum(first + i, len(values) - 1)].astype(np.float64)
        slot = i % LONGEST  # blocks that start at i take the place of those that would be too long
        peak[:, slot], before[:, slot], size[slot] = 0.0, best, 0.0
        size += 1
        np.maximum(peak, here[:, None], out=peak)
        total = before + peak * size
        back = total.argmin(1)
        best = total[rows, back] + cost
        choice[i] = size[back]
    end = length.copy()
    while (end > 0).any():
        live = np.flatnonzero(end > 0)
        end[live] -= choice[end[live] - 1, live]
        out[first[live] + end[live]] = True


class Shard:
    """Postings of some documents by term, in blocks."""

    def __init__(self, docs: list[int | None], sizes: np.ndarray, counts: np.ndarray, terms: np.ndarray, tfs: np.ndarray, weights: np.ndarray, total: int, words: int):
        order = np.array(sorted(range(len(docs)), key=lambda i: (docs[i] is None, docs[i] or 0)), dtype=np.int64)
        self.docs, place = [docs[i] for i in order], np.empty(len(docs), dtype=np.int64)
        place[order] = np.arange(len(docs))
        lengths, which = np.unique(sizes, return_inverse=True)
        norm = np.array([50 + 50 * n * total // words for n in lengths.tolist()], dtype=np.int64)[which]
        owner = np.repeat(np.arange(len(docs)), counts)
        part = weights[terms] * (1_000_000_000 * tfs // (1000 * tfs + 20 * norm[owner]))
        doc = place[owner]
        by = np.lexsort((doc, terms))
        by = by[part[by] > 0]
        self.doc, self.part, term = doc[by], part[by], terms[by]
        edges = np.flatnonzero(np.diff(term, prepend=-1))
        lists = np.append(edges, len(term))
        self.starts = np.flatnonzero(cut(self.part, lists)) if len(term) else edges
        ends = np.append(self.starts[1:], len(term))
        self.ends, self.low, self.high = ends, self.doc[self.starts] if len(term) else edges, self.doc[ends - 1] if len(term) else edges
        self.most = np.maximum.reduceat(self.part, self.starts) if len(term) else edges
        at = np.searchsorted(self.starts, lists)
        self.blocks = {int(t): (int(a), int(b)) for t, a, b in zip(term[edges], at[:-1], at[1:])}
        self.read = 0

    def search(self, terms: list[int], k: int) -> list[tuple[int, int]]:
        """The ``k`` best (document's place, score) with a score above 0, best first, ties by place."""
        spans = [self.blocks[t] for t in terms if t in self.blocks]
        if not spans:
            return []
        n = len(self.docs)
        spans.sort(key=lambda s: (-self.most[s[0] : s[1]].max(), s))
        score, bound = np.zeros(n, dtype=np.int64), sum(self._cover(a, b) for a, b in spans)
        least, look = 1, 1
        for i, (a, b) in enumerate(spans, 1):
            open_ = np.concatenate([[0], np.cumsum(bound >= least)])
            live = a + np.flatnonzero(open_[self.high[a:b] + 1] > open_[self.low[a:b]])
            size = self.ends[live] - self.starts[live]
            posting = np.repeat(self.starts[live] - np.cumsum(size) + size, size) + np.arange(size.sum())
            self.read += len(posting)
            bound -= self._cover(a, b)
            bound[self.doc[posting]] += self.part[posting]
            score[self.doc[posting]] += self.part[posting]
            if i == look and k < n:  # what a document has so far is no more than its score
                least, look = max(least, int(np.partition(score, n - k)[n - k])), 2 * look
        whole = np.flatnonzero((bound >= least) & (score > 0))
        best = np.lexsort((whole, -score[whole]))[:k]
        return [(int(whole[i]), int(score[whole[i]])) for i in best]

    def _cover(self, a: int, b: int) -> np.ndarray:
        """For each document the maximum of the block of a list, from its ``a``-th to before its ``b``-th, that reaches over it, or 0."""
        out = np.zeros(len(self.docs) + 1, dtype=np.int64)
        np.add.at(out, self.low[a:b], self.most[a:b])
        np.subtract.at(out, self.high[a:b] + 1, self.most[a:b])
        return np.cumsum(out)[:-1]


def _counted(docs: DataFrame, known: dict[str, int], id_col: str, text_col: str) -> DataFrame:
    """Rows (doc_id, n, terms, tfs) of documents with a term: their number of terms and the counts of the ``known`` ones."""
    shared = docs.sparkSession.sparkContext.broadcast(known)

    def count(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        number = shared.value
        for batch in batches:
            rows = []
            for doc, text in zip(batch["doc_id"].to_pylist(), batch["text"]):
                if found := terms_of(text.as_py()):
                    own = Counter(map(number.get, found))
                    own.pop(None, None)
                    rows.append((doc, len(found), list(own), list(own.values())))
            kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
            yield pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(list(zip(*rows)) or [()] * 4, kinds)], names=["doc_id", "n", "terms", "tfs"])

    texts = docs.select(F.col(id_col).cast("bigint").alias("doc_id"), F.col(text_col).cast("string").alias("text")).where("text IS NOT NULL")
    return texts.mapInArrow(count, "doc_id bigint, n bigint, terms array<int>, tfs array<int>")


def _best(counted: DataFrame, asked: list[tuple[int, int | None, list[int]]], weights: np.ndarray, total: int, words: int, k: int) -> DataFrame:
    """Rows (item, item_id, doc_id, score): the ``k`` best of each shard."""
    shared = counted.sparkSession.sparkContext.broadcast((asked, weights))

    def search(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        items, w = shared.value

        def found(held: list[pa.RecordBatch]) -> pa.RecordBatch:
            t = pa.Table.from_batches(held).combine_chunks()
            terms, tfs = t["terms"].combine_chunks(), t["tfs"].combine_chunks()
            numbers = lambda a: a.flatten().to_numpy(zero_copy_only=False).astype(np.int64)
            counts = np.array([0 if x is None else x for x in terms.value_lengths().to_pylist()], dtype=np.int64)
            shard = Shard(t["doc_id"].to_pylist(), t["n"].to_numpy(), counts, numbers(terms), numbers(tfs), w, total, words)
            rows = [(item, name, shard.docs[place], score) for item, name, own in items for place, score in shard.search(own, k)]
            return pa.RecordBatch.from_arrays([pa.array(c, pa.int64()) for c in (zip(*rows) if rows else [()] * 4)], names=["item", "item_id", "doc_id", "score"])

        held, docs, postings = [], 0, 0
        for batch in batches:
            at = 0
            sizes = np.cumsum([0, *(x or 0 for x in batch["terms"].value_lengths().to_pylist())])
            while at < batch.num_rows:
                room = int(np.searchsorted(sizes, sizes[at] + SHARD_POSTINGS - postings, "right")) - 1
                end = min(batch.num_rows, at + SHARD_DOCS - docs, max(at + (not held), room))
                if end > at:
                    held.append(batch.slice(at, end - at))
                docs, postings, at = docs + end - at, postings + int(sizes[end] - sizes[at]), end
                if at < batch.num_rows:
                    yield found(held)
                    held, docs, postings = [], 0, 0
        if held:
            yield found(held)

    return counted.mapInArrow(search, "item bigint, item_id bigint, doc_id bigint, score bigint")


def _terms(text: Column) -> Column:
    return F.array_distinct(F.regexp_extract_all(F.translate(text, UPPER, LOWER), F.lit(TERM), F.lit(0)))


def search(
    docs: DataFrame, items: DataFrame, k: int = 50, id_col: str = "doc_id", text_col: str = "text", item_col: str = "item_id", item_text_col: str = "text", block_items: int = 1024, block_terms: int = 200_000
) -> DataFrame:
    """Rows (item_id, rank, doc_id, score): for each item its ``k`` highest-scoring documents with a score above 0.

    Terms are maximal runs of letters and digits of ASCII and of all characters beyond it, A-Z lower-cased. With N documents that
    hold a term, L terms in all and df documents that hold a term t, t weighs w = floor(1000 ln((2N + 2) / (2df + 1))); a
    document of n terms that holds t tf times scores w * (10^9 tf div (1000 tf + 20 m)) for it, where m = 50 + 50nN div L.
    Equal scores come by ascending id, documents without an id last.

    Items are a stated query set, searched in blocks of at most ``block_items`` items and about ``block_terms`` terms, which
    bounds what is broadcast; each block is one pass over the texts. Rows of one item id are one item with the terms of
    all of them (also those without an id), so repeated rows change nothing; items without a term give no rows. Repeated
    rows of documents are documents of their own. Null texts have no terms; an empty table gives no rows. Other columns are not looked at.
    """
    spark, out = docs.sparkSession, None
    one = items.select(F.col(item_col).cast("bigint").alias("item_id"), F.explode(_terms(F.col(item_text_col).cast("string"))).alias("term")).distinct()
    asked = numbered(one.groupBy("item_id").agg(F.collect_list("term").alias("terms")), ["item_id"], "items", "item")
    size = asked.agg(F.count("*").alias("n"), F.max(F.size("terms")).alias("most")).first()
    step = max(1, min(block_items, block_terms // (size["most"] or 1)))
    for at in range(0, size["n"], step):
        rows = [(r["item"], r["item_id"], r["terms"]) for r in asked.where(F.col("item").between(at, at + step - 1)).collect()]
        known = {t: i for i, t in enumerate(sorted({t for _, _, terms in rows for t in terms}))}
        counted = stored(_counted(docs, known, id_col, text_col), "counted-terms")
        whole = counted.agg(F.count("*").alias("N"), F.sum("n").alias("L")).first()
        if not whole["N"]:
            break
        weights = np.zeros(len(known), dtype=np.int64)
        for r in counted.select(F.explode("terms").alias("t")).groupBy("t").count().collect():  # a row a term of this block
            weights[r["t"]] = math.floor(1000 * math.log((2 * whole["N"] + 2) / (2 * r["count"] + 1)))
        found = _best(counted, [(i, name, [known[t] for t in terms]) for i, name, terms in rows], weights, whole["N"], whole["L"], k)
        out = found if out is None else out.unionByName(found)
    if out is None:
        return spark.createDataFrame([], "item_id bigint, rank int, doc_id bigint, score bigint")
    place = F.row_number().over(Window.partitionBy("item").orderBy(F.desc("score"), F.col("doc_id").asc_nulls_last()))
    return out.withColumn("rank", place).where(F.col("rank") <= k).select("item_id", F.col("rank").cast("int").alias("rank"), "doc_id", "score")
