"""Pieces of SQL for vectors and rotations on the sphere; a vector is three expressions, a quaternion four."""

from __future__ import annotations

V = tuple[str, ...]


def named(prefix: str) -> V:
    return tuple(f"{prefix}{c}" for c in "xyz")


def turn(prefix: str) -> V:
    return tuple(f"{prefix}{c}" for c in "wxyz")


def as_(value: V, prefix: str) -> str:
    return ", ".join(f"{e} AS {prefix}{c}" for e, c in zip(value, "xyz" if len(value) == 3 else "wxyz"))


def from_lon_lat(lon: str, lat: str) -> V:
    return f"cos(radians({lat})) * cos(radians({lon}))", f"cos(radians({lat})) * sin(radians({lon}))", f"sin(radians({lat}))"


def lon_of(v: V) -> str:
    return f"degrees(atan2({v[1]}, {v[0]}))"


def lat_of(v: V) -> str:
    return f"degrees(atan2({v[2]}, sqrt({v[0]} * {v[0]} + {v[1]} * {v[1]})))"


def dot(a: V, b: V) -> str:
    return "(" + " + ".join(f"{x} * {y}" for x, y in zip(a, b)) + ")"


def cross(a: V, b: V) -> V:
    return tuple(f"({a[i]} * {b[j]} - {a[j]} * {b[i]})" for i, j in ((1, 2), (2, 0), (0, 1)))


def norm(a: V) -> str:
    return f"sqrt({dot(a, a)})"


def scaled(a: V, k: str) -> V:
    return tuple(f"({x} * ({k}))" for x in a)


def plus(a: V, b: V) -> V:
    return tuple(f"({x} + {y})" for x, y in zip(a, b))


def angle(a: V, b: V) -> str:
    return f"atan2({norm(cross(a, b))}, {dot(a, b)})"


def times(a: V, b: V) -> V:
    (p, x, y, z), (q, u, v, w) = a, b
    return (
        f"({p} * {q} - {x} * {u} - {y} * {v} - {z} * {w})", f"({p} * {u} + {x} * {q} + {y} * {w} - {z} * {v})",
        f"({p} * {v} - {x} * {w} + {y} * {q} + {z} * {u})", f"({p} * {w} + {x} * {v} - {y} * {u} + {z} * {q})",
    )


def inverse(a: V) -> V:
    return a[0], *(f"(-{x})" for x in a[1:])


def turned(q: V, v: V) -> V:
    t = scaled(cross(q[1:], v), "2")
    return plus(plus(v, scaled(t, q[0])), cross(q[1:], t))


def part_of_arc(a: V, b: V, length: str, part: str) -> V:
    """Point at ``part`` of the arc from a to b."""
    return plus(scaled(a, f"sin((1 - {part}) * {length}) / sin({length})"), scaled(b, f"sin({part} * {length}) / sin({length})"))


def velocity(step: V, at: V, interval: str, radius_km: float) -> V:
    """Centimetres a year at a point of what makes the turn ``step`` in ``interval`` million years."""
    n = norm(step[1:])
    rate = f"CASE WHEN {n} > 0 THEN 2 * atan2({n}, abs({step[0]})) * CASE WHEN {step[0]} < 0 THEN -1 ELSE 1 END / {n} ELSE 0 END * {radius_km!r} * 0.1 / {interval}"
    return scaled(cross(step[1:], at), rate)


def arc_distance(p: V, a: V, b: V) -> str:
    """Distance of a point to the shorter arc from a to b, which has a length."""
    n = cross(a, b)
    beside = f"{dot(cross(n, a), p)} >= 0 AND {dot(cross(b, n), p)} >= 0"
    return f"CASE WHEN {beside} THEN abs(asin(greatest(-1.0, least(1.0, {dot(p, n)} / {norm(n)})))) ELSE least({angle(p, a)}, {angle(p, b)}) END"
