"""The ten operators against brute force, with awkward rows."""

from __future__ import annotations

import hashlib
import random
import re
import zlib
from collections import Counter

import numpy as np
import pytest
import xxhash
from pyspark.sql import functions as F

from abyssal.llm import decontaminate, language, lines, neighbours, packing, quality, recompression, sharding, simhash, suffix

SCHEMA = "doc_id long, text string, lang string, source string, n_chars long"
WORD = re.compile(r"[^\x20\x09-\x0D]+")


def corpus() -> list[tuple[int, str | None]]:
    rng = random.Random(5)
    words = [f"w{i}" for i in range(400)]
    say = lambda n: " ".join(rng.choice(words) for _ in range(n))
    passage, line = say(70), "A common line of text"
    out: list[tuple[int, str | None]] = [(i, say(rng.randint(1, 120))) for i in range(30)]
    out += [(100 + i, say(20) + " " + passage + " " + say(15)) for i in range(4)]
    out += [(200 + i, f"{line.upper() if i % 2 else line}  \n{say(9)}\n\n{line}") for i in range(12)]
    base = say(300)
    out += [(300, base), (301, base), (302, base + " tail"), (303, base.replace("w1 ", "w2 ", 1)), (400, None), (401, ""), (402, " \n\t"), (403, "É é ñ Ünïcode\x0bwords"), (404, "same " * 500), (405, "x" * 5000)]
    return out


@pytest.fixture(scope="module")
def docs(spark):
    rows = [(i, t, "en", "s", len(t or "")) for i, t in corpus()]
    return spark.createDataFrame(rows, SCHEMA).withColumns({c: F.lit(1) for c in ("key", "sig", "keep", "rank", "fp", "_row", "_doc")}).cache()


@pytest.fixture(scope="module")
def empty(spark):
    return spark.createDataFrame([], SCHEMA)


def rows(df, *columns):
    return {r[0]: tuple(r)[1:] for r in df.select(*columns).collect()}


def test_sharding(docs, empty):
    got = sharding.shard(docs, 4).collect()
    text = dict(corpus())
    assert len(got) == len(text) and all(r["size"] == len((text[r["doc_id"]] or "").encode()) + 1 and r["text_crc32"] == zlib.crc32((text[r["doc_id"]] or "").encode()) for r in got)
    load, slots, of = Counter(), {}, {}
    for r in got:
        load[r["shard"]] += r["size"]
        slots.setdefault(r["shard"], []).append(r["slot"])
        assert of.setdefault(text[r["doc_id"]], r["shard"]) == r["shard"]
    assert all(sorted(s) == list(range(len(s))) for s in slots.values())
    sizes = Counter()
    for i, t in text.items():
        sizes[hashlib.sha256(t.encode()).digest() if t is not None else b""] += len((t or "").encode()) + 1
    order = [sizes[k] for k in sorted(sizes)]

    def fits(c):
        n, at = 1, 0
        for s in order:
            if s > c:
                return False
            n, at = (n, at + s) if at + s <= c else (n + 1, s)
        return n <= 4

    assert max(load.values()) == min(c for c in range(1, sum(order) + 1) if fits(c)) if sum(order) < 50_000 else fits(max(load.values()))
    assert sharding.shard(empty, 4).count() == 0


def test_even_cuts_keep_within_the_capacity():
    rng = random.Random(2)
    for _ in range(200):
        ends = np.cumsum([rng.choice([1, 2, 5, 80]) for _ in range(rng.randint(1, 40))])
        shards = rng.choice([2, 5])
        capacity = next(c for c in range(1, int(ends[-1]) + 1) if sharding.greedy(ends, c, shards))
        cuts = sharding.even_cuts(ends, capacity, shards)
        assert cuts[-1] == ends[-1] and len(cuts) <= shards and max(np.diff([0, *cuts])) <= capacity


def test_decontamination(spark, empty):
    bench = [(1, "If a train travels 60 km in 2 hours how far does it go in 5 hours then"), (2, "The capital that Alice visited last year was known for its old river bridges"), (3, "too short"), (4, None)]
    text = {
        1: "intro words here. " + bench[0][1] + " and more", 2: "If a train travels 75 km in 3 hours how far does it go in 8 hours then", 3: "If a train travels 75 km in 75 hours how far does it go in 8 hours then",
        4: "we say The capital that Alice visited last year was known for its old river bridges.", 5: "nothing to see in this one", 6: None, 7: "The capital that Alice visited last year had good weather and food",
    }
    docs = spark.createDataFrame([*((i, t, 1) for i, t in text.items()), (1, text[1], 1)], "doc_id long, text string, h long")
    found = decontaminate.contaminated(docs, spark.createDataFrame(bench, "item_id long, text string"))
    got = {(r["doc_id"], r["item_id"]): r["exact"] for r in found.collect()}
    assert got == {(1, 1): True, (2, 1): False, (4, 2): True}
    assert decontaminate.contaminated(empty, spark.createDataFrame(bench, "item_id long, text string")).count() == 0
    assert decontaminate.contaminated(docs, spark.createDataFrame([], "item_id long, text string")).count() == 0


def test_decontamination_reads_each_place_by_itself(spark):
    """The same template with other values elsewhere in the document doesn't hide a copy; nor do words put in or left out."""
    ask = "If a train travels {} km in {} hours how far does it go in {} hours then and who will {} meet at the old gate".format
    item, strays = ask(60, 2, 5, "Bob"), [ask(n, n + 1, n + 1, "Eve") for n in range(70, 90)]
    text = {
        1: f"{item}. {' '.join(strays)}", 2: f"{' '.join(strays)}. {item}.", 3: f"{ask(61, 3, 8, 'Tom')}. {ask(90, 4, 7, 'Ann')}", 4: " ".join(strays),
        5: item.replace("how", "say how") + ". " + " ".join(strays), 6: " ".join(strays) + " " + item.replace(" old", ""),
    }
    docs = spark.createDataFrame(list(text.items()), "doc_id long, text string")
    got = {r["doc_id"]: (r["exact"], r["n_windows"] == r["n_matched"]) for r in decontaminate.contaminated(docs, spark.createDataFrame([(1, item)], "item_id long, text string")).collect()}
    assert got.keys() == {1, 2, 3, 5, 6} and got[1] == got[2] == (True, True) and got[3] == (False, True)


def brute_fingerprint(t):
    w = WORD.findall("".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in t or ""))
    h = [xxhash.xxh64_intdigest(" ".join(w[i : i + 3]).encode(), 42) for i in range(max(1, len(w) - 2))] if w else []
    return sum(1 << b for b in range(64) if 2 * sum(x >> b & 1 for x in h) > len(h))


def components(fps: dict[int, int]) -> dict[int, int]:
    ids, of = sorted(fps), {}
    for i in ids:
        if i not in of:
            todo = [i]
            while todo:
                a = todo.pop()
                if a not in of:
                    of[a] = i
                    todo += [b for b in ids if b not in of and (fps[a] ^ fps[b]).bit_count() <= 3]
    return of


def test_simhash(docs, empty):
    fps = {i: brute_fingerprint(t) for i, t in corpus()}
    of = components(fps)
    assert rows(simhash.digest(docs), "doc_id", "fingerprint", "component_id") == {i: (f"{f:016x}", of[i]) for i, f in fps.items()}
    assert simhash.digest(empty).count() == 0


def test_meetings_find_all_within_three_bits():
    rng = random.Random(9)
    base = [rng.getrandbits(64) for _ in range(30)]
    fps = list({b ^ sum(1 << k for k in rng.sample(range(64), rng.randint(0, 5))) for b in base for _ in range(8)})
    key, fp = [], []
    for f in fps:
        for number, block in enumerate(simhash._BLOCKS):
            for flip in (0, *(1 << i for i in range(64) if not block >> i & 1)):
                key.append((f & ~block & (1 << 64) - 1) ^ ((block & -block) * number) ^ flip)
                fp.append(f)
    links = simhash.meetings(np.array(key, dtype=np.uint64), np.array(fp, dtype=np.uint64).view(np.int64)).view(np.uint64).tolist()
    of = {f: f for f in fps}

    def root(x):
        while of[x] != x:
            x = of[x]
        return x

    for a, b in links:
        assert root(a) == root(b) or of.update({root(a): root(b)}) is None
    index = {i: f for i, f in enumerate(fps)}
    want = components(index)
    assert all((root(fps[i]) == root(fps[j])) == (want[i] == want[j]) for i in index for j in index)


def test_packing(docs, empty):
    import public_tokenizers
    from tokenizers import Tokenizer

    tok = Tokenizer.from_file(public_tokenizers.path("byte_bpe_50k.json"))
    ranks = public_tokenizers.path("byte_bpe_50k.tiktoken")
    got = packing.pack(docs, ranks, 64).collect()
    by = {}
    for r in got:
        by.setdefault(r["doc_id"], []).append(r)
    for i, t in corpus():
        ids = [*tok.encode(t or "", add_special_tokens=False).ids, 0]
        at = 0
        for k, r in enumerate(sorted(by[i], key=lambda r: r["piece"])):
            assert (r["piece"], r["start"]) == (k, at) and (r["length"] == 64 or k == 0)
            assert r["ids_crc32"] == zlib.crc32(np.array(ids[at : at + r["length"]], dtype="<u4").tobytes())
            at += r["length"]
        assert at == len(ids)
    bins = {}
    for r in got:
        bins.setdefault(r["sequence_id"], []).append((r["offset"], r["length"]))
    for b in bins.values():
        at = 0
        for offset, length in sorted(b):
            assert offset == at
            at += length
        assert at <= 64
    rooms: list[int] = []
    for n in sorted((r["length"] for r in got), reverse=True):
        fit = min((x for x in rooms if x >= n), default=None)
        if fit is None:
            rooms.append(64 - n)
        else:
            rooms[rooms.index(fit)] -= n
    assert len(bins) == len(rooms)
    assert packing.pack(empty, ranks, 64).count() == 0


def test_line_dedup(docs, empty):
    key = lambda s: "".join(chr(ord(c) + 32) if "A" <= c <= "Z" else c for c in s.strip(" \t\n\x0b\f\r"))
    seen = Counter(k for _, t in corpus() for k in {key(x) for x in (t or "").split("\n")})
    want = {}
    for i, t in corpus():
        parts = (t or "").split("\n")
        kept = [x for x in parts if not (key(x) and seen[key(x)] >= 10)]
        want[i] = (len(parts), len(parts) - len(kept), hashlib.sha256("\n".join(kept).encode()).hexdigest())
    assert rows(lines.digest(docs), "doc_id", "n_lines", "n_dropped", "kept_sha256") == want
    assert lines.digest(empty).count() == 0


def test_suffix_dedup(docs, empty):
    seen, want = set(), {}
    for i, t in sorted(corpus()):
        b = (t or "").encode()
        gone = np.zeros(len(b) + 1, dtype=bool)
        for k in range(len(b) - 99):
            if b[k : k + 100] in seen:
                gone[k : k + 100] = True
            seen.add(b[k : k + 100])
        spans = int((gone[:-1] & ~np.concatenate([[False], gone[:-2]])).sum()) if len(b) else 0
        want[i] = (len(b), int(gone.sum()), spans, hashlib.sha256(bytes(x for x, g in zip(b, gone) if not g)).hexdigest())
    assert rows(suffix.digest(docs), "doc_id", "n_bytes", "n_removed", "n_spans", "kept_sha256") == want
    assert suffix.digest(empty).count() == 0


def test_contexts_are_cut_to_possible_repeats():
    """Contexts of one key go to the sorting only around windows that another one may hold; none of those is lost."""
    from abyssal.llm import repeats

    rng, windows = random.Random(4), repeats.Windows(100, 0, suffix.KEY, True)
    noise = lambda n: bytes(rng.choices(b"abcdefgh", k=n))
    key, contexts, before = noise(32), [], []
    for i in range(400):
        left, right = rng.randrange(69), rng.randrange(69)
        before.append(rng.choice((68, left)))
        contexts.append(noise(before[-1]) + key + noise(rng.choice((68, right))))
        if i % 4 == 3 and before[-1] and len(contexts[-1]) > before[-1] + 32:  # shares some bytes around the key with one before
            other, b = contexts[-2], before[-2]
            x, y = rng.randrange(min(b, before[-1]) + 1), rng.randrange(min(len(other) - b, len(contexts[-1]) - before[-1]) + 1)
            c = contexts[-1]
            contexts[-1] = c[: before[-1] - x] + other[b - x : b + y] + c[before[-1] + y :]
    hashed = np.zeros(len(contexts), dtype=np.int64)
    row, low, high = suffix.possible(contexts, hashed, np.array(before), windows)
    kept = {r: (a, b) for r, a, b in zip(row.tolist(), low.tolist(), high.tolist())}
    holders = {}
    for i, (c, b) in enumerate(zip(contexts, before)):
        for s in range(max(0, b - 68), min(b, len(c) - 100) + 1):
            holders.setdefault((s - b, c[s : s + 100]), []).append((i, s))
    shared = [p for h in holders.values() if len(h) > 1 for p in h]
    assert len(shared) > 50
    assert all(i in kept and kept[i][0] <= s and s + 100 <= kept[i][1] for i, s in shared)
    assert len(kept) <= len({i for i, _ in shared}) + 20 and sum(b - a for a, b in kept.values()) < 0.3 * sum(map(len, contexts))
    assert all(0 <= a and b <= len(contexts[i]) for i, (a, b) in kept.items())


def test_window_hashes_find_what_sorting_finds(docs):
    """Places with keys of very many contexts take the other way; both must remove the same."""
    from abyssal.llm import repeats

    windows = repeats.Windows(100, 0, suffix.KEY, True)
    marks = repeats.states(docs, windows, suffix.sentinels(windows), "test")
    hashed = repeats.repeated_windows(docs, marks, windows, suffix.units, F.col("open"), "test")
    gone = [rows(repeats.removed(docs, marks, s, 100).where("gone IS NOT NULL"), "doc", "gone") for s in (hashed, suffix.sorted_repeats(docs, marks, windows))]
    assert gone[0] == gone[1] and len(gone[0]) > 5


def test_induced_sorting_carries_prefixes(monkeypatch):
    rng = random.Random(1)
    monkeypatch.setattr(suffix, "IN_MEMORY", 64)  # queues go to disk all the time
    for _ in range(150):
        t = [rng.randint(1, rng.choice([1, 2, 3, 8])) for _ in range(rng.randint(1, 60))] + [0]
        cap = rng.choice([5, 100])
        order, shared = suffix.Inducer(np.array(t, dtype=np.int16), cap).sort()
        keys = [t[i : i + cap] for i in order.tolist()]
        assert sorted(order.tolist()) == list(range(len(t))) and keys == sorted(keys)
        for a, b, n in zip(keys, keys[1:], shared[1:].tolist()):
            k = next((k for k, (x, y) in enumerate(zip(a, b)) if x != y), min(len(a), len(b)))
            assert min(n, cap) == k


def test_substring_dedup(docs, empty):
    first, want = {}, {}
    for i, t in sorted(corpus()):
        w = WORD.findall(t or "")
        gone = [False] * len(w)
        for k in range(len(w) - 49):
            if first.setdefault(tuple(w[k : k + 50]), i) < i:
                gone[k : k + 50] = [True] * 50
        want[i] = (len(w), sum(gone), hashlib.sha256(" ".join(x for x, g in zip(w, gone) if not g).encode()).hexdigest())
    assert rows(recompression.digest(docs), "doc_id", "n_words", "n_removed", "kept_sha256") == want
    assert recompression.digest(empty).count() == 0


def test_quality(spark, empty):
    rng = random.Random(3)
    word = lambda: "".join(rng.choice("abcdefgh") for _ in range(5))
    data = []
    for i in range(400):
        body = [word() for _ in range(40)]
        kind = i % 4
        if kind == 1:
            body = [w + "!!" for w in body]
        if kind == 2:
            body[rng.randrange(40)] = "badword"
        data.append((i, " ".join(body), "en", f"host{i % 7}", 0, kind))
    docs = spark.createDataFrame([(*d[:5], 1) for d in data] + [(900, None, None, None, None, 1), (901, "", "en", "x", 0, 1)], SCHEMA + ", sig long")
    labels = spark.createDataFrame([(d[0], int(d[5] != 1), int(d[5] == 2)) for d in data if d[0] % 3], "doc_id long, quality int, toxic int")
    got = rows(quality.classify(docs, labels), "doc_id", "keep")
    assert len(got) == 402 and all(got[d[0]][0] == (d[5] in (0, 3)) for d in data)
    assert quality.classify(empty, labels).count() == 0
    assert {r["keep"] for r in quality.classify(docs, labels.where("false")).collect()} == {True}


def test_neighbours(spark):
    rng = np.random.default_rng(4)
    x = rng.normal(size=(900, 16))
    x[5] = x[7] = x[3]
    data = [(i, v.tolist()) for i, v in enumerate(x)] + [(1000, None), (1050, [0.0] * 16), (1100, [float("nan")] + [1.0] * 15), (1101, [None] + [1.0] * 15), (None, [1.0] * 16)]
    got = neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>").withColumn("v", F.lit(1)), 50, 5, block_rows=300).collect()
    unit, hits = x / np.linalg.norm(x, axis=1, keepdims=True), 0
    for q in range(0, 900, 50):
        score = unit @ unit[q]
        score[q] = -9
        want = np.lexsort((np.arange(900), -score))[:5].tolist()
        mine = sorted((r["rank"], r["vec_id"], r["score"]) for r in got if r["query_id"] == q)
        assert [m[0] for m in mine] == [1, 2, 3, 4, 5] and all(abs(score[v] - s) < 1e-12 for _, v, s in mine)
        hits += len({m[1] for m in mine} & set(want))
    assert hits >= 0.9 * 5 * 18 and {r["query_id"] for r in got} == set(range(0, 900, 50))
    assert neighbours.search(spark.createDataFrame([], "vec_id long, embedding array<double>")).count() == 0


def test_equal_vectors_come_by_id(spark):
    data = [(i, [1.0, 2.0, 3.0]) for i in range(1, 40)] + [(50, [1.0, 2.0, 3.0])]
    got = sorted((r["rank"], r["vec_id"]) for r in neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block_rows=10).collect())
    assert got == [(k, k) for k in range(1, 6)]


def test_neighbours_among_near_copies(spark):
    """A third of the vectors lie around one centre and share a few codes; all their nearest must be found."""
    rng = np.random.default_rng(8)
    x = rng.normal(size=(6000, 32))
    x[::3] = rng.normal(size=32) + rng.normal(size=(2000, 32)) * 0.003
    data = [(i, v.tolist()) for i, v in enumerate(x)]
    got = neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), 100, 5, block_rows=6000).collect()
    unit, mine = x / np.linalg.norm(x, axis=1, keepdims=True), {}
    for r in sorted(got, key=lambda r: r["rank"]):
        mine.setdefault(r["query_id"], []).append(r["vec_id"])
    for q in range(0, 6000, 100):
        score = unit @ unit[q]
        score[q] = -9
        assert mine[q] == np.lexsort((np.arange(6000), -score))[:5].tolist()


def test_language(spark, empty):
    rng = random.Random(6)
    parts = {"aa": ["ka", "ko", "ri", "mu"], "bb": ["sch", "ung", "ein", "tz"], "cc": ["eau", "oi", "ché", "que"]}
    say = lambda lang: " ".join("".join(rng.choice(parts[lang]) for _ in range(3)) for _ in range(rng.randint(3, 40)))
    data = [(i, say(lang), lang, "s", 0, 1) for i, lang in enumerate(list(parts) * 80)] + [(900, None, "aa", "s", 0, 1), (901, "12 !?", "aa", "s", 0, 1), (None, say("bb"), "bb", "s", 0, 1), (902, say("cc"), None, "s", 0, 1)]
    got = language.predict(spark.createDataFrame(data, SCHEMA + ", score int")).collect()
    by = {r["doc_id"]: r for r in got}
    assert len(got) == len(data) and all(by[i]["held_out"] == (zlib.crc32(str(i).encode()) % 4 == 2) for i in range(240))
    assert np.mean([by[i]["lang_pred"] == lang for i, _, lang, *_ in data[:240] if by[i]["held_out"]]) > 0.95
    assert by[900]["lang_pred"] == by[901]["lang_pred"] == "und" and by[902]["lang_pred"] == "cc" and all(0 <= r["score"] <= 1 for r in got)
    assert language.predict(empty).count() == 0


def test_neighbours_of_repeated_rows(spark):
    """A repeated query row asks once; of two vectors under one id the smaller asks and neither is the other's neighbour."""
    data = [(i, [float(i % 7), 1.0, float(i % 3)]) for i in range(1, 120)] + [(50, [1.0, 1.0, 2.0]), (100, [9.0, 0.0, 0.0]), (7, [0.0, 1.0, 1.0])]
    got = neighbours.search(spark.createDataFrame(data, "vec_id long, embedding array<double>"), block_rows=40).collect()
    assert sorted((r["query_id"], r["rank"]) for r in got) == [(q, k) for q in (50, 100) for k in range(1, 6)]
    for q, v in ((50, [1.0, 1.0, 2.0]), (100, [2.0, 1.0, 1.0])):
        score = sorted(((-np.dot(v, x) / np.linalg.norm(v) / np.linalg.norm(x), i) for i, x in data if i != q))[:5]
        assert np.allclose([s for s, _ in score], [-r["score"] for r in sorted(got, key=lambda r: r["rank"]) if r["query_id"] == q])


def test_equal_windows_choose_equal_symbols():
    """Wherever a window stands, it holds a chosen symbol at the same place of it; runs, short alphabets and text ends included."""
    rng = random.Random(1)
    for _ in range(120):
        letters, length = rng.choice([1, 2, 3, 50]), rng.choice([8, 12, 20])
        some = lambda n: [rng.randrange(letters) for _ in range(n)]
        base = some(2 * length)
        texts = [some(rng.randrange(15)) + base + some(rng.randrange(15)) for _ in range(4)]
        counts = np.array([len(t) for t in texts])
        words = np.array([xxhash.xxh64_intdigest(bytes([x])) for t in texts for x in t], dtype=np.uint64)
        rounds = recompression.recompress(words, counts)
        starts, held = np.cumsum(counts) - counts, {}
        for level, at in recompression.chosen(rounds, counts, length):
            s = rounds[level]
            for i in at.tolist():
                for k in range(max(int(starts[s.text[i]]), int(s.high[i]) - length), min(int(s.low[i]), int(starts[s.text[i]] + counts[s.text[i]]) - length) + 1):
                    held.setdefault(k, set()).add((level, int(s.first[i]) - k, int(s.low[i]) - k, int(s.high[i]) - k, int(s.name[i])))
        seen = {}
        for t, text in enumerate(texts):
            for k in range(len(text) - length + 1):
                seen.setdefault(tuple(text[k : k + length]), []).append(held[int(starts[t]) + k])
        assert all(set.intersection(*places) for places in seen.values())
