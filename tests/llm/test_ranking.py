"""Ranked search against brute force, with awkward rows."""

from __future__ import annotations

import itertools
import math
import random
import re
from collections import Counter

import numpy as np
from pyspark.sql import functions as F

from abyssal.llm import ranking

FIND = re.compile(r"[^\x00-\x2F\x3A-\x40\x5B-\x60\x7B-\x7F]+").findall


def terms(text):
    return FIND("".join(c.lower() if "A" <= c <= "Z" else c for c in text or ""))


def brute(docs, items, k):
    """Scores of all documents for each item, sorted."""
    counts = [(i, Counter(terms(t))) for i, t in docs]
    counts = [(i, c, sum(c.values())) for i, c in counts if c]
    n_docs, words = len(counts), sum(n for _, _, n in counts)
    df = Counter(t for _, c, _ in counts for t in c)
    asked = {}
    for i, t in items:
        asked.setdefault(i, set()).update(terms(t))
    out = []
    for item, own in asked.items():
        scores = []
        for i, c, n in counts:
            m = 100 - 50 + (50 * n * n_docs) // words
            s = sum(math.floor(1000 * math.log((2 * n_docs + 2) / (2 * df[t] + 1))) * ((1000000000 * c[t]) // (1000 * c[t] + 20 * m)) for t in own if t in c)
            if s > 0:
                scores.append((-s, i is None, i or 0, i))
        out += [(item, r, x[3], -x[0]) for r, x in enumerate(sorted(scores, key=lambda x: x[:3])[:k], 1)]
    return sorted(out, key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def corpus(seed=1, n=300):
    rng = random.Random(seed)
    words = [f"w{i}" for i in range(200)] + ["Ünï", "x_y", "9é", "The", "the", "THE"]
    weights = [1 / (i + 1) for i in range(len(words))]
    say = lambda n: " ".join(rng.choices(words, weights, k=n))
    docs = [(i, say(rng.randint(1, 80))) for i in range(n)]
    rng.shuffle(docs)
    docs += [(900, None), (901, ""), (902, " .,\n"), (903, docs[0][1]), (904, docs[0][1]), (904, docs[0][1]), (None, docs[0][1]), (None, "w3 w3"), (905, "w1 " * 30_000), (-7, docs[1][1])]
    items = [(i, say(12)) for i in range(12)] + [(50, None), (51, "..."), (52, "none of these"), (53, docs[0][1]), (53, docs[0][1]), (54, "w1"), (54, "W2 W1"), (None, "w3 w4"), (55, "ÜNÏ ünï Ünï 9é")]
    return docs, items


def frames(spark, docs, items):
    more = {c: F.lit("1") for c in ("n", "terms", "term", "item", "rank", "score", "tfs")}
    return spark.createDataFrame(docs, "doc_id long, text string").withColumns(more), spark.createDataFrame(items, "item_id long, text string").withColumns(more)


def result(df):
    return sorted((tuple(r) for r in df.collect()), key=lambda r: (r[0] is None, r[0] or 0, r[1]))


def test_ranks_are_those_of_brute_force(spark):
    docs, items = corpus()
    for k in (1, 7, 50):
        assert result(ranking.search(*frames(spark, docs, items), k=k)) == brute(docs, items, k)


def test_blocks_of_items_and_small_shards(spark, monkeypatch):
    docs, items = corpus(2, 120)
    d, i = frames(spark, docs, items)
    assert result(ranking.search(d.coalesce(1), i, k=5, block_items=5)) == brute(docs, items, 5)


def test_empty_tables(spark):
    docs, items = frames(spark, *corpus(3, 5))
    assert result(ranking.search(docs.limit(0), items)) == result(ranking.search(docs, items.limit(0))) == []
    assert result(ranking.search(docs.where("text IS NULL"), items)) == []


def test_cuts_are_the_best_ones():
    rng = np.random.default_rng(5)
    for n in (1, 2, 7, 12):
        values = rng.integers(1, 40, n)
        got = ranking.cut(values, np.array([0, n]))
        cost = ranking.BLOCK_COST * values.mean()

        def total(starts):
            ends = [*starts[1:], n]
            return sum((e - s) * values[s:e].max() + cost for s, e in zip(starts, ends))

        every = ([0, *(i for i in range(1, n) if mask >> i & 1)] for mask in range(0, 1 << n, 2))
        assert math.isclose(total(np.flatnonzero(got).tolist()), min(map(total, every)))


def test_long_lists_are_cut_into_short_blocks():
    values = np.random.default_rng(6).integers(1, 1000, 5000)
    starts = np.flatnonzero(ranking.cut(values, np.array([0, 700, 701, 5000])))
    assert {0, 700, 701} <= set(starts.tolist()) and np.diff([*starts, 5000]).max() <= ranking.LONGEST


def test_shards_skip_blocks():
    """Where rare terms weigh most, few blocks of the common ones are read."""
    rng = np.random.default_rng(7)
    n, terms_ = 20_000, 30
    tfs = rng.geometric(0.7, (n, terms_)) * (rng.random((n, terms_)) < 0.3)
    tfs[:, :5] *= rng.random((n, 1)) < 0.01
    weights = np.where(np.arange(terms_) < 5, 4000, 60)
    counts = (tfs > 0).sum(1)
    owner, term = np.nonzero(tfs)
    shard = ranking.Shard(list(range(n)), np.full(n, 9), counts, term, tfs[owner, term], weights, n, 9 * n)
    got = shard.search(list(range(terms_)), 50)
    score = np.zeros(n, dtype=np.int64)
    np.add.at(score, shard.doc, shard.part)
    want = sorted(((-s, i) for i, s in enumerate(score.tolist())))[:50]
    assert [(-s, i) for i, s in got] == want and shard.read < len(shard.doc) / 10


def test_shards_of_few_postings(monkeypatch):
    """Batches are dealt to shards without losing or repeating a row, whatever the limits."""
    import pyarrow as pa

    docs = [(i, n, list(range(n)), [1] * n) for i, n in enumerate([3, 0, 5, 1, 1, 9, 2])]
    kinds = (pa.int64(), pa.int64(), pa.list_(pa.int32()), pa.list_(pa.int32()))
    batch = pa.RecordBatch.from_arrays([pa.array(c, t) for c, t in zip(zip(*docs), kinds)], names=["doc_id", "n", "terms", "tfs"])

    class Frame:
        class sparkSession:
            class sparkContext:
                broadcast = staticmethod(lambda x: type("B", (), {"value": x}))

        def mapInArrow(self, f, schema):
            return f

    for most, each in itertools.product((1, 4, 100), (1, 2, 100)):
        monkeypatch.setattr(ranking, "SHARD_POSTINGS", most)
        monkeypatch.setattr(ranking, "SHARD_DOCS", each)
        f = ranking._best(Frame(), [(0, 0, list(range(9)))], np.full(9, 700), 7, 21, 50)
        rows = [r["doc_id"] for b in f(iter([batch, batch])) for r in b.to_pylist()]
        assert sorted(rows) == sorted(2 * [0, 2, 3, 4, 5, 6])
