"""SimHash near-duplicates by meet-in-the-middle ball hashing.

Two fingerprints that differ in at most three bits differ in at most two once some
third of the bits is taken away: if every third had fewer than one of three differing
bits there would be none. So each fingerprint, with each third masked in turn, emits
itself and all variants with one bit flipped (half the remaining radius); fingerprints
within the radius meet on a variant. Meetings are verified on the whole fingerprints
and joined into components.

Texts whose five-word shingles agree to 0.8 differ in far more than three of 64 bits.
``near_clusters`` finds them exactly: sets of shingles that agree to 0.8 share a shingle
among the first fifth of each in any order of all shingles, here rare ones first. Sets meet
on these; of the pairs that sizes, places and 128 bits of parity leave possible, those that about a bit of parity
a shingle leaves too are compared in full, from their texts.
"""

from __future__ import annotations

from collections.abc import Iterator
from functools import reduce

import numpy as np
import pyarrow as pa
import xxhash
from pyspark.sql import DataFrame, Window
from pyspark.sql import functions as F

from .common import beside, components, parts, stored
from .quality import signature

RADIUS = 3
#: Least Jaccard similarity of the sets of shingles of near copies that link.
SIMILARITY = 0.8
#: Candidates that a set of shingles is compared with in the rounds that come before all pairs left are.
NEAREST = 2
#: Pairs left for each row at which all of them are compared.
PAIRS_A_ROW = 16
#: Texts whose shingles are counted to tell common ones, and how many of the most common are told. Both set the order of shingles only, so results don't depend on them.
SAMPLED_TEXTS, COMMON = 20_000, 200_000
#: Rows of a shingle that meet in one group; those of a more common one meet block by block.
BLOCK = 2048
#: First shingles that meet at a time, at least, and the most parts that they are dealt to for it. A part's shuffle files go before the next one.
SLICE, SLICES = 4 << 20, 4
#: Parts of the texts' shingles that a step of comparing ships at most, and the least number that is worth a step of its own.
SHIPPED, LEAST = 8, 1 << 21
#: Words whose hashes a Python worker keeps.
CACHED_WORDS = 300_000
_BASE = np.uint64(0x9E3779B97F4A7C15)
#: The three blocks of bits, one of which is masked at a time.
_BLOCKS = ((1 << 22) - 1, ((1 << 21) - 1) << 22, ((1 << 21) - 1) << 43)


def fingerprint(text: str | None, width: int = 3, seed: int = 42) -> int:
    """64-bit SimHash over shingles of ``width`` words, repeats included.

    Words are split at ASCII white space, A-Z in lower case; fewer words than ``width``
    are one shingle, no word at all gives 0.
    """
    words = (text or "").encode("utf-8", "replace").lower().split()
    if not words:
        return 0
    joined = b" ".join(words)
    if len(words) <= width:
        return xxhash.xxh64_intdigest(joined, seed)
    ends = np.cumsum(np.fromiter(map(len, words), dtype=np.int64, count=len(words)) + 1) - 1
    n = len(words) - width + 1
    starts = np.concatenate([[0], ends[:-1] + 1])[:n].tolist()
    digest, out, counts = xxhash.xxh64_intdigest, 0, np.zeros(64, dtype=np.int64)
    hashes = np.fromiter((digest(joined[a:b], seed) for a, b in zip(starts, ends[width - 1 :].tolist())), dtype=np.uint64, count=n)
    for at in range(0, n, 1 << 16):
        counts += np.unpackbits(hashes[at : at + (1 << 16)].view(np.uint8).reshape(-1, 8), axis=1, bitorder="little").sum(axis=0, dtype=np.int64)
    for bit in np.flatnonzero(2 * counts > n).tolist():
        out |= 1 << bit
    return out


def fingerprints(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp) with the fingerprint as a signed long."""

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            fp = np.array([fingerprint(t, width, seed) for t in batch["text"].to_pylist()], dtype=np.uint64).view(np.int64)
            yield pa.RecordBatch.from_arrays([batch["doc_id"], pa.array(fp)], names=["doc_id", "fp"])

    return docs.select(F.col("doc_id").cast("long").alias("doc_id"), F.col("text").cast("string").alias("text")).mapInArrow(score, "doc_id long, fp long")


def _signed(x: int) -> int:
    return x - (1 << 64) if x >> 63 else x


def variants(fps: DataFrame) -> DataFrame:
    """Rows (key, fp): the masked fingerprint and its one-bit variants. The masked block's
    lowest bits, free now, hold the block's number."""
    keys = []
    for number, block in enumerate(_BLOCKS):
        low = (block & -block) * number
        bits = [1 << i for i in range(64) if not block >> i & 1]
        keep = _signed(~block & ((1 << 64) - 1))
        for flip in (0, *bits):
            keys.append((keep, _signed(low ^ flip)))
    masks = F.lit([k for k, _ in keys]).cast("array<bigint>")
    flips = F.lit([f for _, f in keys]).cast("array<bigint>")
    exploded = fps.select("fp", F.explode(F.arrays_zip(masks.alias("m"), flips.alias("f"))).alias("v"))
    return exploded.select(F.col("fp").bitwiseAND(F.col("v.m")).bitwiseXOR(F.col("v.f")).alias("key"), "fp")


def meetings(key: np.ndarray, fp: np.ndarray) -> np.ndarray:
    """Links (fp, fp) that join all fingerprints of these rows that meet on a key and lie within the radius.

    Within a key, rows are compared at growing distances in sorted order, all keys at a
    time, and joined as they are found; of each joined set every member is linked to one,
    so there are never more links than rows.
    """
    order = np.argsort(key, kind="stable")
    key, fp = key[order], fp[order]
    same = np.flatnonzero(key[1:] == key[:-1])
    if not len(same):
        return np.zeros((0, 2), dtype=np.int64)
    keep = np.unique(np.concatenate([same, same + 1]))
    key, (names, node) = key[keep], np.unique(fp[keep], return_inverse=True)
    value = names.view(np.uint64)[node]
    first = np.flatnonzero(np.concatenate([[True], key[1:] != key[:-1]]))
    size = np.diff(np.concatenate([first, [len(key)]]))
    after = np.repeat(first + size, size) - np.arange(len(key))  # rows of the key from this one on
    group = np.repeat(np.arange(len(first)), size)
    label, rows, lag = np.arange(len(names)), np.arange(len(key)), 1
    while True:
        rows = rows[after[rows] > lag]
        if not len(rows):
            break
        apart = rows[label[node[rows]] != label[node[rows + lag]]]
        hit = apart[np.bitwise_count(value[apart] ^ value[apart + lag]) <= RADIUS]
        if len(hit):
            label = _joined(label, node[hit], node[hit + lag])
        if lag & (lag - 1) == 0:  # keys whose rows are all joined need no more comparing
            of = label[node]
            rows = rows[(np.minimum.reduceat(of, first) != np.maximum.reduceat(of, first))[group[rows]]]
        lag += 1
    own = np.arange(len(names))
    moved = own[label != own]
    return np.stack([names[moved], names[label[moved]]], axis=1)


def possible(n_a: np.ndarray, n_b: np.ndarray, rest: np.ndarray, bits: np.ndarray) -> np.ndarray:
    """Which pairs of sets may agree to ``SIMILARITY``: of sizes ``n_a`` and ``n_b``, with ``rest`` elements at most in both
    and with parities that differ in ``bits`` bits, each of which takes an element of one set alone."""
    total, slack = n_a + n_b, 1e-6
    ok = np.minimum(n_a, n_b) >= SIMILARITY * np.maximum(n_a, n_b) - slack
    return ok & ((1 + SIMILARITY) * rest >= SIMILARITY * total - slack) & ((1 + SIMILARITY) * bits <= (1 - SIMILARITY) * total + slack)


def parity(h: np.ndarray) -> bytes:
    """Whether the number of elements is odd, in each of 2^k ranges of hashes, at least as many as there are elements and 128."""
    k = max(7, (len(h) - 1).bit_length())
    return np.packbits(np.bincount((h.view(np.uint64) >> np.uint64(64 - k)).view(np.int64), minlength=1 << k).astype(np.uint8) & 1, bitorder="little").tobytes()


def differing(a: bytes, b: bytes) -> int:
    """Bits in which two parities differ, over the ranges of the coarser one; each takes an element of one set alone."""
    if len(a) == len(b):
        return int(np.bitwise_count(np.frombuffer(a, dtype=np.uint64) ^ np.frombuffer(b, dtype=np.uint64)).sum())
    x, y = sorted((np.unpackbits(np.frombuffer(p, dtype=np.uint8), bitorder="little") for p in (a, b)), key=len)
    return int((x != np.bitwise_xor.reduce(y.reshape(len(x), -1), axis=1)).sum())


def partners(group: np.ndarray, side: np.ndarray, split: np.ndarray, root: np.ndarray, name: np.ndarray, n: np.ndarray, rest: np.ndarray, bits: np.ndarray, every: bool) -> Iterator[np.ndarray]:
    """Rows (name, name, differing bits) of possible pairs of a group from different roots, the smaller name first.

    With ``every`` these are all; otherwise each row has at most two, the first one after those of its root and the first of its group. A
    ``split`` group pairs one ``side`` with the other. ``bits`` has two longs of parity a row.
    """
    if not len(group):
        return
    order = np.lexsort((name, root, side, group))
    group, side, split, root, name, n, rest, bits = (x[order] for x in (group, side, split, root, name, n, rest, bits))
    last = lambda new: np.repeat(np.append(np.flatnonzero(new)[1:], len(new)), np.diff(np.append(np.flatnonzero(new), len(new))))
    new_group = np.concatenate([[True], group[1:] != group[:-1]])
    new_side = new_group | np.concatenate([[True], side[1:] != side[:-1]])
    end, own = last(new_group), last(new_side | np.concatenate([[True], root[1:] != root[:-1]]))
    at = np.where(split, last(new_side), own)
    rows = np.flatnonzero(at < end)
    first = np.flatnonzero(new_group)[np.cumsum(new_group) - 1]

    def of(a: np.ndarray, b: np.ndarray) -> np.ndarray:
        far = np.bitwise_count((bits[a] ^ bits[b]).view(np.uint64)).sum(axis=1, dtype=np.int64)
        ok = possible(n[a], n[b], np.minimum(rest[a], rest[b]), far) & (root[a] != root[b])
        x, y = name[a[ok]], name[b[ok]]
        return np.stack([np.minimum(x, y), np.maximum(x, y), far[ok]], axis=1)

    if not every:
        far = np.flatnonzero(root[first] != root)
        yield np.unique(np.concatenate([of(rows, at[rows]), of(far, first[far])]), axis=0)
        return
    held, size, lag = [], 0, 0
    while len(rows):
        held.append(of(rows, at[rows] + lag))
        size, lag = size + len(held[-1]), lag + 1
        rows = rows[at[rows] + lag < end[rows]]
        if size >= 1 << 18:
            yield np.unique(np.concatenate(held), axis=0)
            held, size = [], 0
    if held:
        yield np.unique(np.concatenate(held), axis=0)


def _joined(label: np.ndarray, a: np.ndarray, b: np.ndarray) -> np.ndarray:
    """Labels after linking each a to its b: the smallest place of each connected set."""
    while True:
        x, y = label[a], label[b]
        if (x == y).all():
            return label
        low = np.minimum(x, y)
        np.minimum.at(label, x, low)
        np.minimum.at(label, y, low)
        while not (label == label[label]).all():
            label = label[label]


def links(fps: DataFrame) -> DataFrame:
    """Links (a, b) between distinct fingerprints, enough to connect all within the radius."""
    n = parts(fps.sparkSession, -(-fps.count() * (3 + sum(64 - bin(b).count("1") for b in _BLOCKS)) >> 20))

    def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [(b["key"].to_numpy(), b["fp"].to_numpy()) for b in batches]
        if got:
            found = meetings(*(np.concatenate(c) for c in zip(*got)))
            yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in (0, 1)], names=["a", "b"])

    return variants(fps.repartition(parts(fps.sparkSession))).repartition(n, "key").mapInArrow(meet, "a long, b long").distinct()


def clusters(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fp, component_id) of every document.

    Fingerprints link at three or fewer differing bits; ``component_id`` is the smallest
    doc_id that links reach, the document's own included. Documents without words all
    have fingerprint 0 and link like others. Repeated rows each give a row; a null id
    never becomes a component's unless all its ids are null; other columns are ignored.
    """
    rows = stored(fingerprints(docs, width, seed), "fingerprints")
    classes = stored(rows.groupBy("fp").agg(F.min("doc_id").alias("first")), "fp-classes")
    return _labelled(rows, classes, links(classes.select("fp")))


def _labelled(rows: DataFrame, classes: DataFrame, linked: DataFrame) -> DataFrame:
    """Rows (doc_id, fp, component_id) from rows (doc_id, fp), classes (fp, first) and their links."""
    joined = _rooted(classes, linked, "fp")
    least = joined.groupBy("root").agg(F.min("first").alias("component_id"))
    ids = stored(joined.join(least, "root").select("fp", "component_id"), "fp-components")
    return beside(rows, ids, "fp", "inner", row_bytes=F.lit(24)).select("doc_id", "fp", "component_id")


def _rooted(classes: DataFrame, linked: DataFrame, key: str) -> DataFrame:
    """``classes`` with the ``root`` that links reach from each ``key``, its own if none."""
    roots = components(linked, "simhash").withColumnsRenamed({"node": key})
    return classes.join(roots, key, "left").withColumn("root", F.coalesce("root", key))


class _Words(dict):
    """Hash of each word."""

    def __missing__(self, word: bytes) -> int:
        self[word] = h = xxhash.xxh64_intdigest(word)
        return h


class Shingles:
    """Distinct shingles of texts as hashes, in order; A-Z in lower case, without words none."""

    def __init__(self, width: int) -> None:
        self.width, self.words = width, _Words()

    def of(self, text: str | None) -> np.ndarray:
        split = (text or "").encode("utf-8", "replace").lower().split()
        if not split:
            return np.zeros(0, dtype=np.int64)
        if len(self.words) > CACHED_WORDS:
            self.words = _Words()
        words = np.fromiter(map(self.words.__getitem__, split), dtype=np.uint64, count=len(split))
        n = max(1, len(words) - self.width + 1)
        h = np.zeros(n, dtype=np.uint64)
        for k in range(min(self.width, len(words))):  # fewer words are one run
            h = (h + words[k : k + n]) * _BASE
            h ^= h >> np.uint64(29)
        h = h.view(np.int64)
        h.sort()
        return h[np.concatenate([[True], h[1:] != h[:-1]])]


def prefix(h: np.ndarray, common: np.ndarray, counts: np.ndarray) -> np.ndarray:
    """The first shingles of a set (hashes in order) by how common they are (``common`` in order, with ``counts``; others are rare) and then by
    hash: so many that sets which agree to ``SIMILARITY`` share the first common one among them."""
    n = len(h) and len(h) - int(np.ceil(SIMILARITY * len(h) - 1e-6)) + 1
    if not n or not len(common):
        return h[:n]
    at = np.minimum(np.searchsorted(common, h), len(common) - 1)
    return h[np.argsort(np.where(common[at] == h, counts[at], 0), kind="stable")[:n]]


def near_clusters(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc_id, set_id, component_id) of every document, near copies in one component; ``set_id`` names its set of shingles.

    Documents link if their sets of shingles of ``width`` words have a Jaccard similarity of
    ``SIMILARITY`` or more; no link between components is missed. Sets meet on the shingles of their prefixes. In rounds each one is compared
    with the nearest that it meets in another component, so that no group of copies, however
    large, is compared pair by pair; then all pairs left that meet from different components are. Equal texts always
    share a component, as do all documents without words. Repeated rows, null ids and
    other columns are dealt with as by ``clusters``.
    """
    rows, classes, linked = _near(docs, width)
    sets = _labelled(rows.select("doc_id", F.col("name").alias("fp")), classes.withColumnRenamed("name", "fp"), linked)
    return sets.withColumnRenamed("fp", "set_id")


def near_roots(docs: DataFrame, width: int = 5) -> DataFrame:
    """Rows (doc_id, sig, root) of every document: a hash of its text, and the set of shingles that
    names its component of ``near_clusters``, whatever the ids are."""
    rows, classes, linked = _near(docs, width)
    roots = stored(_rooted(classes, linked, "name").select("name", "root"), "near-roots")
    return beside(rows, roots, "name", "inner", row_bytes=F.lit(24)).select("doc_id", "sig", "root")


def _shingled(texts: DataFrame, width: int) -> DataFrame:
    """Rows (name, shingles) of rows (name, text)."""

    def split(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                yield pa.RecordBatch.from_arrays([batch["name"], pa.array([shingles.of(t) for t in batch["text"].to_pylist()], pa.list_(pa.int64()))], names=["name", "shingles"])

    return texts.select("name", "text").mapInArrow(split, "name long, shingles array<bigint>")


def _common(texts: DataFrame, width: int) -> tuple[np.ndarray, np.ndarray]:
    """Hashes, in order, of the most common shingles of a sample of different texts (sig, text), and their counts."""
    step = max(1, texts.count() // SAMPLED_TEXTS)
    some = texts.where(F.pmod(F.xxhash64("sig"), F.lit(step)) == 0).groupBy("sig").agg(F.first("text").alias("text"))
    each = _shingled(some.withColumnRenamed("sig", "name"), width).select(F.explode("shingles").alias("h")).groupBy("h").agg(F.count("*").alias("n")).where("n > 2")
    got = stored(each.orderBy(F.desc("n"), "h").limit(COMMON), "near-common").toArrow()
    h, n = got["h"].to_numpy(), got["n"].to_numpy()
    order = np.argsort(h)
    return h[order], n[order].astype(np.int32)


def _near(docs: DataFrame, width: int) -> tuple[DataFrame, DataFrame, DataFrame]:
    """Rows (doc_id, sig, name, ...) of the documents, classes (name, first) and links of near copies; a name is a hash of the set of shingles."""
    spark = docs.sparkSession
    texts = docs.select(F.col("doc_id").cast("long").alias("doc_id"), signature(docs).alias("sig"), F.col("text").cast("string").alias("text"))
    common, counts = _common(texts, width)

    def score(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles = Shingles(width)
        for whole in batches:
            for at in range(0, whole.num_rows, 1024):
                batch = whole.slice(at, 1024)
                sets = [shingles.of(t) for t in batch["text"].to_pylist()]
                name = np.array([xxhash.xxh64_intdigest(h.tobytes()) for h in sets], dtype=np.uint64).view(np.int64)
                odd = np.array([np.bincount(h.view(np.uint64) >> np.uint64(57), minlength=128) & 1 for h in sets], dtype=np.uint8).reshape(-1, 128)
                bits = np.packbits(odd, axis=1, bitorder="little").view(np.int64)
                firsts = pa.array([prefix(h, common, counts) for h in sets], pa.list_(pa.int64()))
                longs = (name, np.array([len(h) for h in sets], dtype=np.int64), bits[:, 0].copy(), bits[:, 1].copy())
                odds = pa.array([parity(h) for h in sets], pa.binary())
                yield pa.RecordBatch.from_arrays([batch["doc_id"], batch["sig"], *map(pa.array, longs), odds, firsts], names=["doc_id", "sig", "name", "n", "p", "q", "parity", "firsts"])

    rows = stored(texts.mapInArrow(score, "doc_id long, sig long, name long, n long, p long, q long, parity binary, firsts array<bigint>"), "near-rows")
    one = rows.groupBy("name").agg(F.min("doc_id").alias("first"), F.min(F.struct("sig", "n", "p", "q", "parity")).alias("one"))
    classes = stored(one.select("name", "first", "one.*"), "near-classes")
    whole = rows.agg(F.sum(F.size("firsts")).alias("firsts"), F.sum("n").alias("shingles"), F.sum(F.length("parity")).alias("parity"), F.count("*").alias("rows")).first()
    made = whole["firsts"] or 0
    slices, shipped = min(SLICES, max(1, made // SLICE)), max(LEAST, (whole["shingles"] or 0) // SHIPPED)

    def placed(k: int) -> DataFrame:
        """Rows (h, name, at) of the first shingles of a slice, a set's once a task."""

        def place(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            seen: set[int] = set()
            for whole in batches:
                for start in range(0, whole.num_rows, 1024):
                    batch = whole.slice(start, 1024)
                    fresh = np.array([x not in seen and not seen.add(x) for x in batch["name"].to_pylist()], dtype=bool)
                    offsets, h = batch["firsts"].offsets.to_numpy(), batch["firsts"].values.to_numpy()
                    size = np.where(fresh, np.diff(offsets), 0)
                    at = np.arange(size.sum()) - np.repeat(np.cumsum(size) - size, size)
                    h, name = h[np.repeat(offsets[:-1], size) + at], np.repeat(batch["name"].to_numpy(), size)
                    own = (h.view(np.uint64) >> np.uint64(20)) % np.uint64(slices) == k
                    yield pa.RecordBatch.from_arrays([pa.array(x[own]) for x in (h, name, at)], names=["h", "name", "at"])

        return rows.select("name", "firsts").mapInArrow(place, "h long, name long, at long")

    def several(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        got = [[b[c].to_numpy() for c in ("h", "name", "at")] for b in batches if b.num_rows]
        if got:
            h, name, at = (np.concatenate(c) for c in zip(*got))
            order = np.lexsort((name, h))
            h, name, at = h[order], name[order], at[order]
            once = np.concatenate([[True], (h[1:] != h[:-1]) | (name[1:] != name[:-1])])
            h, name, at = h[once], name[once], at[once]
            _, which, n = np.unique(h, return_inverse=True, return_counts=True)
            m = n[which]
            yield pa.RecordBatch.from_arrays([pa.array(x[m > 1]) for x in (h, name, at, m)], names=["h", "name", "at", "m"])

    tasks = parts(spark, -(-(made // slices) >> 20))
    met = [stored(placed(k).repartition(tasks, "h").mapInArrow(several, "h long, name long, at long, m long"), "near-met") for k in range(slices)]

    def candidates(held: DataFrame, every: bool) -> DataFrame:
        """Possible pairs (a, b, far) of rows of different roots that meet: all of them, or some of each row."""
        blocks = F.expr(f"if(m > {BLOCK}, cast(ceil(m / {BLOCK}) as int), 1)") if every else F.lit(1)
        mine = F.pmod(F.xxhash64("name"), F.col("blocks")).cast("int")
        dealt = held.withColumn("blocks", blocks).withColumn("mine", mine).withColumn("other", F.explode(F.sequence(F.lit(0), F.col("blocks") - 1)))
        low, high = F.least("mine", "other"), F.greatest("mine", "other")
        group = F.when(F.col("blocks") > 1, F.xxhash64("h", low, high)).otherwise(F.col("h"))
        side = F.when(F.col("mine") > F.col("other"), 1).otherwise(0).cast("long")
        dealt = dealt.select(group.alias("group"), side.alias("side"), (low < high).cast("long").alias("split"), "root", "name", "n", (F.col("n") - F.col("at")).alias("rest"), "p", "q")

        def meet(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
            got = [[b[c].to_numpy() for c in b.schema.names] for b in batches if b.num_rows]
            if got:
                group, side, split, root, name, n, rest, p, q = (np.concatenate(c) for c in zip(*got))
                for found in partners(group, side, split > 0, root, name, n, rest, np.stack([p, q], axis=1), every):
                    yield pa.RecordBatch.from_arrays([pa.array(found[:, i].copy()) for i in range(3)], names=["a", "b", "far"])

        return dealt.repartition(parts(spark), "group").mapInArrow(meet, "a long, b long, far long").distinct()

    def screen(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        for batch in batches:
            n_a, n_b = batch["n_a"].to_numpy(), batch["n_b"].to_numpy()
            far = np.array([differing(a, b) for a, b in zip(batch["parity_a"].to_pylist(), batch["parity_b"].to_pylist())], dtype=np.int64)
            ok = pa.array(possible(n_a, n_b, np.minimum(n_a, n_b), far))
            yield pa.RecordBatch.from_arrays([*(batch[c].filter(ok) for c in ("a", "b", "sig_a", "sig_b")), pa.array(n_a + n_b).filter(ok)], names=["a", "b", "sig_a", "sig_b", "n"])

    def compare(batches: Iterator[pa.RecordBatch]) -> Iterator[pa.RecordBatch]:
        shingles, last, own = Shingles(width), None, None
        for whole in batches:
            for at in range(0, whole.num_rows, 256):
                batch, ok = whole.slice(at, 256), []
                for a, text_a, text_b in zip(batch["a"].to_pylist(), batch["text_a"].to_pylist(), batch["text_b"].to_pylist()):
                    last, own = a, own if a == last else shingles.of(text_a)
                    ok.append(alike(own, shingles.of(text_b)))
                yield pa.RecordBatch.from_arrays([batch[c].filter(pa.array(ok, pa.bool_())) for c in ("a", "b")], names=["a", "b"])

    def sliced(pairs: DataFrame, n: int) -> list[DataFrame]:
        return [pairs.where(F.pmod(F.xxhash64("a", "b"), F.lit(n)) == k) for k in range(n)] if n > 1 else [pairs]

    def verified(pairs: DataFrame) -> DataFrame:
        """Links among ``pairs`` (a, b): what their parities rule out goes first, then texts meet and are compared, some pairs at a time."""
        of = lambda end: classes.select(F.col("name").alias(end), *(F.col(c).alias(f"{c}_{end}") for c in ("sig", "n", "parity")))
        odds = pairs.count() * (whole["parity"] or 0) // max(1, whole["rows"])
        likely = [stored(some.join(of("a"), "a").join(of("b"), "b").mapInArrow(screen, "a long, b long, sig_a long, sig_b long, n long"), "near-likely") for some in sliced(pairs, -(-odds // (2 * shipped)) or 1)]
        likely = reduce(DataFrame.union, likely)
        left = likely.agg(F.count("*").alias("rows"), F.sum("n").alias("n")).first()
        links = []
        for some in sliced(likely, max(1, -(-(left["n"] or 0) // shipped), -(-left["rows"] * 64 // (24 << 20)))):
            ends = some.select(F.explode(F.array(*(F.struct(F.col(f"sig_{end}").alias("sig"), "a", "b", F.lit(end).alias("end")) for end in "ab"))).alias("e")).select("e.*")
            held = beside(texts.select("sig", "text"), ends, "sig", "inner", row_bytes=F.lit(32))
            both = held.groupBy("a", "b").agg(*(F.first(F.when(F.col("end") == end, F.col("text")), ignorenulls=True).alias(f"text_{end}") for end in "ab"))
            links.append(stored(both.mapInArrow(compare, "a long, b long"), "near-links"))
        return reduce(DataFrame.union, links)

    linked, roots = None, None
    while True:
        named = classes.select("name", "n", "p", "q")
        named = named.withColumn("root", F.col("name")) if roots is None else named.join(roots, "name", "left").withColumn("root", F.coalesce("root", "name"))
        held, rows_left, pairs_left = [part.join(named, "name") for part in met], 0, 0
        for k, part in enumerate(held):
            if roots is None:  # all rows of a shingle differ in their roots
                left = met[k].agg(F.count("*").alias("rows"), F.sum((F.col("m") - 1) / 2).alias("pairs")).first()
            else:
                of = part.groupBy("h", "root").agg(F.count("*").alias("n")).groupBy("h").agg(F.count("*").alias("roots"), F.sum("n").alias("n"), F.sum(F.col("n") * F.col("n")).alias("own"))
                mixed = stored(of.where("roots > 1").select("h", ((F.col("n") * F.col("n") - F.col("own")) / 2).alias("pairs"), F.col("n").alias("m")), "near-mixed")
                left = mixed.agg(F.sum("m").alias("rows"), F.sum("pairs").alias("pairs")).first()
                held[k] = part.drop("m").join(mixed.drop("pairs"), "h")
            rows_left, pairs_left = rows_left + (left["rows"] or 0), pairs_left + (left["pairs"] or 0)
        # Rounds of nearest ones come first and end once one links nothing more.
        every = pairs_left <= PAIRS_A_ROW * rows_left or (linked is not None and not found.limit(1).count())
        near = [candidates(part, every) for part in held]
        near = near[0] if slices == 1 else reduce(DataFrame.union, [stored(part, "near-candidates") for part in near]).distinct()
        if not every:
            ends = near.select(F.explode(F.array(F.struct("a", "b", "far"), F.struct(F.col("b").alias("a"), F.col("a").alias("b"), "far"))).alias("e")).select("e.*")
            nearest = ends.withColumn("i", F.row_number().over(Window.partitionBy("a").orderBy("far", "b"))).where(F.col("i") <= NEAREST)
            near = nearest.select(F.least("a", "b").alias("a"), F.greatest("a", "b").alias("b")).distinct()
        found = verified(stored(near.select("a", "b"), "near-pairs"))
        linked = found if linked is None else linked.union(found)
        if every:
            return rows, classes.select("name", "first"), linked
        roots = components(linked, "near-found").withColumnsRenamed({"node": "name"})


def alike(a: np.ndarray, b: np.ndarray) -> bool:
    """Whether two sets of shingles, hashes in order, have a Jaccard similarity of at least ``SIMILARITY``."""
    both = len(np.intersect1d(a, b, assume_unique=True))
    return both >= SIMILARITY * (len(a) + len(b) - both)


def digest(docs: DataFrame, width: int = 3, seed: int = 42) -> DataFrame:
    """Rows (doc_id, fingerprint, component_id), the fingerprint as 16 lowercase hex digits."""
    return clusters(docs, width, seed).select("doc_id", F.lower(F.lpad(F.hex("fp"), 16, "0")).alias("fingerprint"), "component_id")
