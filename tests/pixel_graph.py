"""Shortest paths on one machine, to hold the Spark rounds against."""

from __future__ import annotations

import heapq
import math

import numpy as np

from abyssal.operators.graph import STEPS


def _vectors(lon: np.ndarray, lat: np.ndarray) -> np.ndarray:
    a, b = np.radians(lat), np.radians(lon)
    return np.stack([np.cos(a) * np.cos(b), np.cos(a) * np.sin(b), np.sin(a)], axis=-1)


def inside(points: np.ndarray, ring: np.ndarray) -> np.ndarray:
    """Which unit vectors lie inside a ring of vertices smaller than a hemisphere, by winding number."""
    v = ring[None] - (points @ ring.T)[..., None] * points[:, None]
    w = np.roll(v, -1, axis=1)
    turn = np.arctan2(np.einsum("pk,pvk->pv", points, np.cross(v, w)), np.einsum("pvk,pvk->pv", v, w)).sum(1)
    return (np.abs(turn) > math.pi) & (points @ ring.mean(0) > 0)


def crosses(a: np.ndarray, b: np.ndarray, c: np.ndarray, d: np.ndarray) -> np.ndarray:
    """Whether each short arc a-b crosses any of the short arcs c-d."""
    n, m = np.cross(a, b), np.cross(c, d)
    sa, sb = a @ m.T, b @ m.T
    sc, sd = n @ c.T, n @ d.T
    near = (a + b) @ (c + d).T > 0
    return ((sa * sb < 0) & (sc * sd < 0) & near).any(1)


class PixelGraph:
    """Nodes and neighbours of a depth, less what polygons and lines block."""

    def __init__(self, depth: int, rings: list[np.ndarray], lines: list[np.ndarray]):
        self.n_lon, self.n_lat, size = 4 << depth, 2 << depth, 90.0 / (1 << depth)
        i = np.arange(self.n_lon * self.n_lat)
        self.xyz = _vectors(-180 + (i % self.n_lon + 0.5) * size, -90 + (i // self.n_lon + 0.5) * size)
        self.size = math.radians(size)
        self.outside = np.ones(len(i), dtype=bool)
        for ring in rings:
            self.outside &= ~inside(self.xyz, ring)
        arcs = [(x, np.roll(x, -1, axis=0)) for x in rings] + [(x[:-1], x[1:]) for x in lines]
        starts, ends = (np.concatenate([a[k] for a in arcs]) for k in (0, 1)) if arcs else (np.zeros((0, 3)), np.zeros((0, 3)))
        self.edges: list[tuple[np.ndarray, np.ndarray]] = []
        for dr, dc in STEPS:
            row = i // self.n_lon + dr
            ok = (row >= 0) & (row < self.n_lat)
            to = np.where(ok, row * self.n_lon + (i % self.n_lon + dc) % self.n_lon, 0)
            ok &= self.outside & self.outside[to]
            if len(starts):
                at = np.flatnonzero(ok)
                for k in range(0, len(at), 4096):
                    part = at[k : k + 4096]
                    ok[part] &= ~crosses(self.xyz[part], self.xyz[to[part]], starts, ends)
            dist = 2 * np.arcsin(np.minimum(1, np.linalg.norm(self.xyz - self.xyz[to], axis=1) / 2))
            self.edges.append((np.where(ok, to, -1), dist))

    def distances(self, sources: np.ndarray, threshold: float = math.pi) -> np.ndarray:
        """Distance of each node from the nearest source (points), infinite where there's no way or it is beyond the threshold."""
        best = np.full(len(self.xyz), np.inf)
        gap = 2 * np.arcsin(np.minimum(1, np.linalg.norm(self.xyz[:, None] - sources[None], axis=2) / 2))
        for s in range(gap.shape[1]):  # seeds: outside nodes not much farther than the nearest one
            g = np.where(self.outside, gap[:, s], np.inf)
            seed = g <= min(g.min() + 0.7 * self.size, threshold)
            best[seed] = np.minimum(best[seed], g[seed])
        to = np.stack([e[0] for e in self.edges], axis=1)
        cost = np.stack([e[1] for e in self.edges], axis=1)
        heap = [(d, n) for n, d in enumerate(best.tolist()) if d < np.inf]
        heapq.heapify(heap)
        to_list, cost_list, best = to.tolist(), cost.tolist(), best.tolist()
        while heap:
            d, n = heapq.heappop(heap)
            if d > best[n]:
                continue
            for m, c in zip(to_list[n], cost_list[n]):
                if m >= 0 and d + c < best[m] and d + c <= threshold:
                    best[m] = d + c
                    heapq.heappush(heap, (d + c, m))
        return np.array(best)
