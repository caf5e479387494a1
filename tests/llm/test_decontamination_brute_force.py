"""Template windows against comparing every item with every place of every document."""

from __future__ import annotations

import random

from abyssal.llm import decontaminate


def template(words: list[str]) -> list[tuple[str, str | None]]:
    """Token and value of each word; here numbers are digits, names capitalised words that don't open a sentence, units km and kg behind numbers."""
    out = []
    for i, w in enumerate(words):
        bare = w.strip(".,")
        if bare.isdigit():
            out.append(("#", bare))
        elif bare in ("km", "kg") and i and words[i - 1].isdigit():
            out.append(("unit", bare))
        elif bare.istitle() and i and not words[i - 1].endswith("."):
            out.append(("name", bare))
        else:
            out.append((bare.lower(), None))
    return out


def held(doc: list[str], item: list[str]) -> bool:
    d, b = template(doc), template(item)
    for off in range(5 - len(b), len(d) - 4):
        forth, back, n, ok = {}, {}, 0, True
        for k in range(len(b) - 4):
            if 0 <= off + k and off + k + 5 <= len(d) and all(d[off + k + j][0] == b[k + j][0] for j in range(5)):
                n += 1
                for j in range(5):
                    mine, theirs = b[k + j][1], d[off + k + j][1]
                    ok &= mine is None or forth.setdefault(mine, theirs) == theirs and back.setdefault(theirs, mine) == mine
        if ok and n >= 0.8 * (len(b) - 4):
            return True
    return False


def test_same_as_every_place(spark):
    rng = random.Random(21)
    plain, names = [f"w{chr(97 + i)}{chr(97 + k)}" for i in range(9) for k in range(9)], ["Alice", "Bob", "Carol", "Dave", "Erin"]
    other = [f"z{chr(97 + i)}{chr(97 + k)}" for i in range(9) for k in range(9)]
    kinds = ["w"] * 6 + ["n", "u", "p"]

    def words(shape: list[tuple[str, str]], values: dict[str, str]) -> list[str]:
        return [values.get(v, v) for k, v in shape]

    items, rows = [], []
    for i in range(12):
        shape: list[tuple[str, str]] = []
        for kind in (rng.choice(kinds) for _ in range(rng.randint(12, 25))):
            shape += [("w", rng.choice(plain))] if kind == "w" else [("n", f"n{rng.randrange(2)}"), ("u", "u0")] if kind == "u" else [(kind, f"{kind}{rng.randrange(2)}")]
        shape = [("w", rng.choice(plain)), *shape]
        give = lambda: {"n0": str(rng.randint(10, 99)), "n1": str(rng.randint(100, 999)), "u0": rng.choice(["km", "kg"]), **dict(zip(("p0", "p1"), rng.sample(names, 2)))}
        items.append((i, words(shape, give())))
        for _ in range(12):
            copy, mode = words(shape, give()), rng.randrange(5)
            if mode == 1:  # a value that does not agree with its other places
                at = rng.randrange(len(copy))
                copy[at] = "7" if copy[at].isdigit() else copy[at]
            if mode == 2:
                copy = copy[: int(len(copy) * rng.choice([0.7, 0.8, 0.9, 0.95]))]
            if mode == 3:
                copy[rng.randrange(len(copy))] = rng.choice(other)
            before, after = ([rng.choice(other) for _ in range(rng.randrange(30))] for _ in range(2))
            rows.append((len(rows), before + ([] if mode == 4 else copy) + after))
    docs = spark.createDataFrame([(i, " ".join(w)) for i, w in rows], "doc_id long, text string")
    bench = spark.createDataFrame([(i, " ".join(w)) for i, w in items], "item_id long, text string")
    got = {(r["doc_id"], r["item_id"]) for r in decontaminate.contaminated(docs, bench).collect()}
    want = {(d, i) for d, t in rows for i, b in items if held(t, b)}
    assert got == want and 40 < len(want) < len(rows)
