"""Each stage of the pipeline against brute force on its own input."""

from __future__ import annotations

import os
from urllib.parse import urlparse

import pytest

import corpus_pipeline
from abyssal.llm import quality, simhash
from abyssal.llm.common import table

DATA = "/root/testdata/sf0.001"
pytestmark = pytest.mark.skipif(not os.path.isdir(DATA), reason="no test tables")


def shingles(text: str | None) -> frozenset:
    words = (text or "").lower().split()
    return frozenset(" ".join(words[k : k + 5]) for k in range(max(1, len(words) - 4)))


def jaccard(a: frozenset, b: frozenset) -> float:
    return len(a & b) / len(a | b)


def test_stages(spark, tmp_path):
    docs, seen = table(spark, DATA, "documents"), []
    for name, stage in corpus_pipeline.STAGES:
        out = stage(spark, docs, DATA)
        out.write.parquet(str(tmp_path / name))
        seen.append(docs)
        docs = spark.read.parquet(str(tmp_path / name))
        if name != "pack":
            assert docs.dtypes == seen[0].dtypes
    text = [{r["doc_id"]: r["text"] for r in d.collect()} for d in seen]
    kept = {r["doc_id"] for r in quality.classify(seen[0], table(spark, DATA, "labels")).where("keep").collect()}
    assert set(text[1]) == kept and text[1] == {i: text[0][i] for i in kept}
    assert set(text[2]) == set(text[1])
    assert all(text[2][i] == t for i, t in text[3].items())
    sets = {i: shingles(t) for i, t in text[2].items()}
    alike = {(i, k): jaccard(sets[i], sets[k]) for i in sets for k in sets if i < k}
    same = {p for p, j in alike.items() if j >= 0.8}
    kept = text[3].keys()
    assert sum(i in kept and k in kept for i, k in same) <= 0.05 * len(same)
    assert not any(i in kept and k in kept for (i, k), j in alike.items() if j >= 0.9)
    near = {i for (i, k), j in alike.items() if j >= 0.5 for i in (i, k)}
    assert {i for i in sets if i not in near} <= kept
    for i in sets.keys() - kept:
        assert any(k < i and (k, i) in alike and alike[k, i] >= 0.5 for k in sets)
    bench = {r["item_id"]: r["text"].lower().split() for r in table(spark, DATA, "benchmark").collect()}
    holds = lambda t, b: sum(" ".join(b[k : k + 5]) in t for k in range(len(b) - 4)) >= 0.8 * (len(b) - 4)
    joined = {i: " ".join(t.lower().split()) for i, t in text[3].items()}
    assert set(text[4]) == {i for i, t in joined.items() if not any(holds(t, b) for b in bench.values())}
    assert {r["doc_id"] for r in docs.collect()} == set(text[4])


def test_repeated_rows_leave_one(spark):
    rows = [(1, "a b c d", 1), (1, "a b c d", 1), (2, "a b c d", 2), (3, "other words here", 3)]
    from abyssal.llm import stages

    got = stages.one_of_near_copies(spark.createDataFrame(rows, "doc_id long, text string, _doc int")).collect()
    assert sorted(r["doc_id"] for r in got) == [1, 3]
    assert simhash.RADIUS == 3


def test_near_copies_of_five_word_shingles(spark):
    """Copies of a text with few words changed share a component, others don't; edge rows have a defined result."""
    import random

    rng = random.Random(3)
    words = [f"w{i}" for i in range(4000)]
    base = [rng.choices(words, k=400) for _ in range(40)]
    rows, truth = [], {}
    for i, b in enumerate(base):
        for v in range(4):
            copy = list(b)
            for at in rng.sample(range(400), v):
                copy[at] = "changed"
            rows.append((10 * i + v, " ".join(copy), "x"))
            truth[10 * i + v] = 10 * i
    edge = [(1000, None, "x"), (1001, "", "x"), (1002, " \n ", None), (1003, "one two", "x"), (1004, "ONE two", "x"), (None, "word " * 30_000, "x")]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(spark.createDataFrame(rows + edge, "doc_id long, text string, fp string")).collect()}
    assert got == truth | {1000: 1000, 1001: 1000, 1002: 1000, 1003: 1003, 1004: 1003, None: None}
    assert simhash.near_clusters(spark.createDataFrame([], "doc_id long, text string")).count() == 0


def test_pairs_below_the_similarity_stay(spark):
    """Texts that share a long passage, at similarity 0.6 to 0.75, don't link; nearly all of 0.87 do."""
    import random

    rng, rows = random.Random(11), []
    word = lambda: f"w{rng.randrange(100_000)}"
    for i in range(200):
        base = [word() for _ in range(300)]
        own = rng.choice([45, 60, 75])
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(base[:-own] + [word() for _ in range(own)]))]
        if i % 2:
            rows.append((10 * i + 2, " ".join(base[:-20] + [word() for _ in range(20)])))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    for i in range(0, 2000, 10):
        assert jaccard(sets[i], sets[i + 1]) < 0.8 and got[i] == i and got[i + 1] == i + 1
    linked = [got[i] == i - 2 for i in got if i % 10 == 2]
    assert all(got[i] in (i, i - 2) for i in got if i % 10 == 2) and sum(linked) >= 0.85 * len(linked)


def test_pairs_at_the_similarity_link(spark):
    """Nine in ten pairs of similarity 0.80 to 0.85 link, whether the changed words stand together or apart, and no text joins another pair."""
    import random

    rng, rows = random.Random(7), []
    word = lambda: f"w{rng.randrange(100_000)}"
    for i in range(300):
        base = [word() for _ in range(300)]
        copy = list(base)
        for at in range(300 - rng.randrange(25, 32), 300) if i % 2 else rng.sample(range(5, 295), 5):
            copy[at] = word()
        rows += [(10 * i, " ".join(base)), (10 * i + 1, " ".join(copy))]
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    sets = {i: shingles(t) for i, t in rows}
    pairs = [i for i in range(0, 3000, 10) if 0.8 <= jaccard(sets[i], sets[i + 1]) <= 0.85]
    assert len(pairs) > 200 and all(c in (i, i - i % 10) for i, c in got.items())
    assert sum(got[i + 1] == i for i in pairs) >= 0.9 * len(pairs)


def test_chain_of_copies_is_one_component(spark):
    """Each text is near only to its neighbours; links reach from end to end."""
    import random

    rng = random.Random(5)
    base = [f"w{rng.randrange(100_000)}" for _ in range(400)]
    rows = [(0, " ".join(base))]
    for i in range(1, 13):  # each changes twelve more words of the one before: neighbours at 0.94, the ends far apart
        base = base[:12 * (i - 1)] + [f"c{i}_{k}" for k in range(12)] + base[12 * i :]
        rows.append((i, " ".join(base)))
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert set(got.values()) == {0}


def linked_by_brute_force(rows: list[tuple[int, str]]) -> dict[int, int]:
    sets, root = {i: shingles(t) for i, t in rows}, {i: i for i, _ in rows}

    def of(i: int) -> int:
        while root[i] != i:
            i = root[i]
        return i

    for i, a in sets.items():
        for k, b in sets.items():
            if i < k and 5 * len(a & b) >= 4 * len(a | b):
                x, y = sorted((of(i), of(k)))
                root[y] = x
    return {i: of(i) for i in root}


def families(seed: int) -> list[tuple[int, str]]:
    """Texts of families around a base each, at similarities about 0.8, so that many that meet don't link."""
    import random

    rng, rows = random.Random(seed), []
    for f in range(12):
        base = [f"f{f}w{k}" for k in range(rng.choice((1, 4, 8, 30, 60, 150)))]
        for v in range(40):
            text = list(base)
            for at in rng.sample(range(len(base)), min(len(base), rng.randrange(1 + len(base) // 24 + (len(base) < 30)))):
                text[at] = f"c{rng.randrange(3)}" if rng.random() < 0.5 else f"x{f}_{v}"
            rows.append((len(rows), " ".join(text if rng.random() < 0.7 else text[: len(text) - rng.randrange(1 + len(text) // 5)])))
    return rows


def test_no_link_is_lost(spark):
    """Components are those of all pairs, also where sets meet more that are almost near than rounds compare."""
    rows = families(2)
    want = linked_by_brute_force(rows)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert len(set(want.values())) > 30 and got == want


def test_rounds_and_blocks_lose_no_link(spark, monkeypatch):
    """With rounds of one nearest and blocks of a few rows the components are the same."""
    rows = families(3)
    for name, value in (("BLOCK", 7), ("PAIRS_A_ROW", 0), ("NEAREST", 1), ("COMMON", 20)):
        monkeypatch.setattr(simhash, name, value)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(spark.createDataFrame(rows, "doc_id long, text string")).collect()}
    assert got == linked_by_brute_force(rows)


def test_written_tables_follow_the_texts(spark, monkeypatch):
    """Long texts that share passages, but are no near copies, meet without their sets of shingles being written; slices and steps lose no link."""
    import random

    rng, rows = random.Random(13), []
    word = lambda: f"w{rng.randrange(1_000_000)}"
    for i in range(60):
        shared = [[word() for _ in range(9)] for _ in range(60)]
        for k in range(2):
            rows.append((len(rows), " ".join(w for s in shared for w in s + [word() for _ in range(30)])))
        if i % 6 == 0:
            rows.append((len(rows), rows[-1][1] + " end"))
    docs, words = spark.createDataFrame(rows, "doc_id long, text string"), sum(len(t.split()) for _, t in rows)
    for name, value in (("SLICE", 1000), ("LEAST", 20_000)):
        monkeypatch.setattr(simhash, name, value, raising=False)
    written, stored = {}, simhash.stored

    def measured(df, name):
        out = stored(df, name)
        written[name] = written.get(name, 0) + sum(os.path.getsize(urlparse(f).path) for f in out.inputFiles())
        return out

    monkeypatch.setattr(simhash, "stored", measured)
    got = {r["doc_id"]: r["component_id"] for r in simhash.near_clusters(docs).collect()}
    assert got == {i: i - rows[i][1].endswith(" end") for i, _ in rows}
    assert written["near-rows"] and sum(written.values()) < 5 * words


def test_parities_bound_the_difference():
    """Bits that differ are never more than the elements of one set alone, also of sets whose parities have unlike ranges."""
    import numpy as np

    rng = np.random.default_rng(3)
    for _ in range(300):
        n, own = int(rng.integers(1, 900)), int(rng.integers(0, 300))
        both = rng.integers(-(1 << 63), 1 << 63, n)
        a, b = (np.unique(np.append(both, rng.integers(-(1 << 63), 1 << 63, rng.integers(0, own + 1)))) for _ in range(2))
        apart = len(np.setxor1d(a, b))
        far = simhash.differing(simhash.parity(a), simhash.parity(b))
        assert far <= apart and far % 2 == apart % 2
        assert simhash.differing(simhash.parity(a), simhash.parity(a)) == 0
