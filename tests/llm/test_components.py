"""Connected components against a walk over the graph."""

from __future__ import annotations

import random

import pytest

from abyssal.llm.common import components


def walked(edges: list[tuple[int, int]]) -> dict[int, int]:
    near: dict[int, set[int]] = {}
    for a, b in edges:
        if a != b:
            near.setdefault(a, set()).add(b)
            near.setdefault(b, set()).add(a)
    out: dict[int, int] = {}
    for node in sorted(near):
        todo = [node] if node not in out else []
        while todo:
            at = todo.pop()
            if at not in out:
                out[at] = node
                todo.extend(near[at])
    return out


_RNG = random.Random(5)
CASES = {
    "none": [],
    "loops": [(3, 3), (-(1 << 63), -(1 << 63))],
    "star": [(0, i) for i in range(1, 50)] + [(i, 0) for i in range(1, 50)],
    "chain": [(i, i + 1) for i in range(60)],
    "shuffled chain": (lambda p: list(zip(p, p[1:])))(_RNG.sample(range(-1000, 1000), 80)),
    "ring with repeats": [(i, (i + 1) % 20) for i in range(20)] * 2,
    "sparse": [(_RNG.randrange(300), _RNG.randrange(300)) for _ in range(180)],
    "dense": [(_RNG.randrange(40), _RNG.randrange(40)) for _ in range(200)],
}


@pytest.mark.parametrize("name", list(CASES))
def test_components(spark, name):
    got = components(spark.createDataFrame(CASES[name], "a long, b long"), "test").collect()
    want = walked(CASES[name])
    assert len(got) == len(want) and {r["node"]: r["root"] for r in got} == want
