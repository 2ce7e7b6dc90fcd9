"""Planar and spherical geometry on WKT texts, with GeoJSON polygons for the geopoly family."""

from __future__ import annotations

import json
import math
import re
from dataclasses import dataclass
from functools import lru_cache

from .arrow import register_all

Point = tuple[float, float]


@dataclass(frozen=True)
class Shape:
    """kind, and parts: rings of points for each member (a point or line is one member of one ring)."""

    kind: str
    members: tuple[tuple[tuple[Point, ...], ...], ...]
    srid: int = 0

    @property
    def points(self) -> list[Point]:
        return [p for m in self.members for ring in m for p in ring]

    @property
    def dimension(self) -> int:
        return 0 if "POINT" in self.kind else 1 if "LINE" in self.kind else 2


_KINDS = ("POINT", "LINESTRING", "POLYGON", "MULTIPOINT", "MULTILINESTRING", "MULTIPOLYGON")


def _point(text: str) -> Point:
    x, y = text.replace("(", " ").replace(")", " ").split()[:2]
    return float(x), float(y)


def _ring(text: str) -> tuple[Point, ...]:
    return tuple(_point(p) for p in text.split(","))


@lru_cache(8192)
def parse(text: str) -> Shape | None:
    """A shape from WKT or EWKT; None where it isn't one."""
    m = re.fullmatch(r"\s*(?:SRID=(\d+);)?\s*([A-Za-z]+)\s*(?:\((.*)\)|EMPTY)\s*", text, re.S)
    if not m or m[2].upper() not in _KINDS:
        return None
    kind, body, srid = m[2].upper(), m[3], int(m[1] or 0)
    if body is None:
        return Shape(kind, (), srid)
    try:
        if kind in ("POINT", "LINESTRING"):
            members = (((_ring(body)),),)
        elif kind == "POLYGON":
            members = (tuple(_ring(r) for r in re.findall(r"\(([^()]*)\)", body)),)
        elif kind == "MULTIPOINT":
            members = tuple(((p,),) for p in _ring(body))
        elif kind == "MULTILINESTRING":
            members = tuple((_ring(r),) for r in re.findall(r"\(([^()]*)\)", body))
        else:
            members = tuple(tuple(_ring(r) for r in re.findall(r"\(([^()]*)\)", p)) for p in re.findall(r"\(\s*(\([^()]*\)(?:\s*,\s*\([^()]*\))*)\s*\)", body))
    except ValueError:
        return None
    return Shape(kind, members, srid) if members and all(r for m in members for r in m) else None


def num(x: float) -> str:
    return str(int(x)) if x == int(x) and abs(x) < 1e15 else repr(x)


def _points_text(ring) -> str:
    return ",".join(f"{num(x)} {num(y)}" for x, y in ring)


def text(s: Shape | None) -> str | None:
    if s is None:
        return None
    head = f"SRID={s.srid};" if s.srid else ""
    if not s.members:
        return f"{head}{s.kind} EMPTY"
    if s.kind in ("POINT", "LINESTRING"):
        body = _points_text(s.members[0][0])
    elif s.kind == "POLYGON":
        body = ",".join(f"({_points_text(r)})" for r in s.members[0])
    elif s.kind == "MULTIPOINT":
        body = _points_text(m[0][0] for m in s.members)
    elif s.kind == "MULTILINESTRING":
        body = ",".join(f"({_points_text(m[0])})" for m in s.members)
    else:
        body = ",".join("(" + ",".join(f"({_points_text(r)})" for r in m) + ")" for m in s.members)
    return f"{head}{s.kind}({body})"


def line(points) -> Shape:
    return Shape("LINESTRING", ((tuple(points),),))


def point(p: Point) -> Shape:
    return Shape("POINT", (((p,),),))


def polygon(ring) -> Shape:
    return Shape("POLYGON", ((tuple(ring),),))


def geojson(s: Shape) -> str:
    pts = lambda ring: [[x, y] for x, y in ring]
    name = {k: n for k, n in zip(_KINDS, ("Point", "LineString", "Polygon", "MultiPoint", "MultiLineString", "MultiPolygon"), strict=True)}[s.kind]
    rings = [[pts(r) for r in m] for m in s.members]
    coordinates = {"POINT": lambda: rings[0][0][0], "LINESTRING": lambda: rings[0][0], "POLYGON": lambda: rings[0], "MULTIPOINT": lambda: [r[0][0] for r in rings], "MULTILINESTRING": lambda: [r[0] for r in rings], "MULTIPOLYGON": lambda: rings}[s.kind]()
    whole = lambda v: [whole(x) for x in v] if isinstance(v, list) else int(v) if v == int(v) else v
    return json.dumps({"type": name, "coordinates": whole(coordinates)}, separators=(",", ":"))


# --- measures -----------------------------------------------------------------------------------


def ring_area(ring) -> float:
    return sum(x1 * y2 - x2 * y1 for (x1, y1), (x2, y2) in zip(ring, ring[1:] + ring[:1], strict=True)) / 2


def area(s: Shape) -> float:
    return sum(abs(ring_area(m[0])) - sum(abs(ring_area(h)) for h in m[1:]) for m in s.members) if s.dimension == 2 else 0.0


def _segments(s: Shape) -> list[tuple[Point, Point]]:
    return [(a, b) for m in s.members for r in m for a, b in zip(r, r[1:], strict=False)]


def length(s: Shape) -> float:
    return sum(math.dist(a, b) for a, b in _segments(s)) if s.dimension == 1 else 0.0


def perimeter(s: Shape) -> float:
    return sum(math.dist(a, b) for a, b in _segments(s)) if s.dimension == 2 else 0.0


def _to_segment(p: Point, a: Point, b: Point) -> float:
    dx, dy = b[0] - a[0], b[1] - a[1]
    n = dx * dx + dy * dy
    t = max(0.0, min(1.0, ((p[0] - a[0]) * dx + (p[1] - a[1]) * dy) / n)) if n else 0.0
    return math.dist(p, (a[0] + t * dx, a[1] + t * dy))


def _side(a: Point, b: Point, p: Point) -> float:
    return (b[0] - a[0]) * (p[1] - a[1]) - (b[1] - a[1]) * (p[0] - a[0])


def _on(p: Point, a: Point, b: Point) -> bool:
    return abs(_side(a, b, p)) < 1e-12 * max(1, math.dist(a, b)) and min(a[0], b[0]) - 1e-12 <= p[0] <= max(a[0], b[0]) + 1e-12 and min(a[1], b[1]) - 1e-12 <= p[1] <= max(a[1], b[1]) + 1e-12


def _cross(a: Point, b: Point, c: Point, d: Point) -> bool:
    """Whether two segments meet, ends included."""
    s = [_side(a, b, c), _side(a, b, d), _side(c, d, a), _side(c, d, b)]
    if s[0] * s[1] < 0 and s[2] * s[3] < 0:
        return True
    return _on(c, a, b) or _on(d, a, b) or _on(a, c, d) or _on(b, c, d)


def _properly(a: Point, b: Point, c: Point, d: Point) -> bool:
    return _side(a, b, c) * _side(a, b, d) < 0 and _side(c, d, a) * _side(c, d, b) < 0


def _in_ring(p: Point, ring) -> int:
    """1 inside, 0 on the edge, -1 outside."""
    inside = False
    for a, b in zip(ring, ring[1:] + ring[:1], strict=True):
        if _on(p, a, b):
            return 0
        if (a[1] > p[1]) != (b[1] > p[1]) and p[0] < (b[0] - a[0]) * (p[1] - a[1]) / (b[1] - a[1]) + a[0]:
            inside = not inside
    return 1 if inside else -1


def locate(p: Point, s: Shape) -> int:
    """1 in the interior, 0 on the boundary, -1 outside."""
    best = -1
    for m in s.members:
        if s.dimension == 2:
            at = _in_ring(p, m[0])
            for hole in m[1:]:
                h = _in_ring(p, hole)
                at = min(at, -h)
            best = max(best, at)
        elif s.dimension == 1:
            r = m[0]
            if any(_on(p, a, b) for a, b in zip(r, r[1:], strict=False)):
                best = max(best, 0 if p in (r[0], r[-1]) and r[0] != r[-1] else 1)
        elif math.dist(p, m[0][0]) < 1e-12:
            best = 1
    return best


def intersects(a: Shape, b: Shape) -> bool:
    if any(locate(p, b) >= 0 for p in a.points) or any(locate(p, a) >= 0 for p in b.points):
        return True
    return any(_cross(*s, *t) for s in _segments(a) for t in _segments(b))


def distance(a: Shape, b: Shape) -> float | None:
    if not a.points or not b.points:
        return None
    if intersects(a, b):
        return 0.0
    sa, sb = _segments(a), _segments(b)
    best = min(math.dist(p, q) for p in a.points for q in b.points)
    for p in a.points:
        best = min([best, *(_to_segment(p, *s) for s in sb)])
    for p in b.points:
        best = min([best, *(_to_segment(p, *s) for s in sa)])
    return best


def _samples(s: Shape) -> list[Point]:
    """Points, midpoints and, of areas, an inner point of each member."""
    out = list(s.points) + [((a[0] + b[0]) / 2, (a[1] + b[1]) / 2) for a, b in _segments(s)]
    return out + [_inner(m) for m in s.members] if s.dimension == 2 else out


def _inner(member) -> Point:
    """A point in the interior: midway along the widest run of a horizontal line that meets no vertex."""
    ys = sorted({p[1] for r in member for p in r})
    y = (ys[0] + ys[1]) / 2 if len(ys) > 1 else ys[0]
    xs = sorted(a[0] + (y - a[1]) * (b[0] - a[0]) / (b[1] - a[1]) for r in member for a, b in zip(r, r[1:] + r[:1], strict=True) if (a[1] > y) != (b[1] > y))
    runs = [(xs[i + 1] - xs[i], (xs[i] + xs[i + 1]) / 2) for i in range(0, len(xs) - 1, 2)]
    return (max(runs)[1], y) if runs else member[0][0]


def _breaks(a: Shape, b: Shape) -> list[Point]:
    """Midpoints of a's segments cut where b's cross them."""
    out = []
    for p, q in _segments(a):
        at = [0.0, 1.0]
        for c, d in _segments(b):
            if _cross(p, q, c, d):
                den = (q[0] - p[0]) * (d[1] - c[1]) - (q[1] - p[1]) * (d[0] - c[0])
                if den:
                    at.append(((c[0] - p[0]) * (d[1] - c[1]) - (c[1] - p[1]) * (d[0] - c[0])) / den)
        at = sorted(t for t in at if 0 <= t <= 1)
        out += [(p[0] + (s + t) / 2 * (q[0] - p[0]), p[1] + (s + t) / 2 * (q[1] - p[1])) for s, t in zip(at, at[1:], strict=False)]
    return out


def covers(a: Shape, b: Shape) -> bool:
    pts = b.points + _breaks(b, a) + ([_inner(m) for m in b.members] if b.dimension == 2 else [])
    if any(locate(p, a) < 0 for p in pts):
        return False
    holes = [h for m in a.members for h in m[1:]] if a.dimension == 2 else []
    return not (b.dimension == 2 and any(locate(p, b) > 0 for h in holes for p in h))


def contains(a: Shape, b: Shape) -> bool:
    return covers(a, b) and any(locate(p, a) > 0 for p in _samples(b) + _breaks(b, a))


def interiors_meet(a: Shape, b: Shape) -> bool:
    if a.dimension == b.dimension == 1 and any(_properly(*s, *t) for s in _segments(a) for t in _segments(b)):
        return True
    pts = _samples(a) + _samples(b) + _breaks(a, b) + _breaks(b, a)
    if a.dimension == b.dimension == 2 and any(_properly(*s, *t) for s in _segments(a) for t in _segments(b)):
        return True
    return any(locate(p, a) > 0 and locate(p, b) > 0 for p in pts)


def touches(a: Shape, b: Shape) -> bool:
    return intersects(a, b) and not interiors_meet(a, b)


def equals(a: Shape, b: Shape) -> bool:
    return a.dimension == b.dimension and covers(a, b) and covers(b, a)


def overlaps(a: Shape, b: Shape) -> bool:
    return a.dimension == b.dimension and interiors_meet(a, b) and not covers(a, b) and not covers(b, a)


def crosses(a: Shape, b: Shape) -> bool:
    if a.dimension == b.dimension == 1:
        return any(_properly(*s, *t) for s in _segments(a) for t in _segments(b))
    low, high = (a, b) if a.dimension < b.dimension else (b, a)
    return low.dimension < high.dimension and interiors_meet(low, high) and not covers(high, low)


def spheroid(p: Point, q: Point) -> float:
    """Metres on the WGS 84 ellipsoid by Vincenty's iteration, on the sphere where it doesn't settle."""
    a, f = 6378137.0, 1 / 298.257223563
    b = a * (1 - f)
    u1, u2 = (math.atan((1 - f) * math.tan(math.radians(y))) for y in (p[1], q[1]))
    gap = lam = math.radians(q[0] - p[0])
    for _ in range(200):
        sin_s = math.hypot(math.cos(u2) * math.sin(lam), math.cos(u1) * math.sin(u2) - math.sin(u1) * math.cos(u2) * math.cos(lam))
        if sin_s == 0:
            return 0.0
        cos_s = math.sin(u1) * math.sin(u2) + math.cos(u1) * math.cos(u2) * math.cos(lam)
        s = math.atan2(sin_s, cos_s)
        sin_a = math.cos(u1) * math.cos(u2) * math.sin(lam) / sin_s
        cos2 = 1 - sin_a**2
        mid = cos_s - 2 * math.sin(u1) * math.sin(u2) / cos2 if cos2 else 0.0
        c = f / 16 * cos2 * (4 + f * (4 - 3 * cos2))
        last, lam = lam, gap + (1 - c) * f * sin_a * (s + c * sin_s * (mid + c * cos_s * (2 * mid**2 - 1)))
        if abs(lam - last) < 1e-12:
            u = cos2 * (a * a - b * b) / (b * b)
            big = 1 + u / 16384 * (4096 + u * (-768 + u * (320 - 175 * u)))
            small = u / 1024 * (256 + u * (-128 + u * (74 - 47 * u)))
            d = small * sin_s * (mid + small / 4 * (cos_s * (2 * mid**2 - 1) - small / 6 * mid * (4 * sin_s**2 - 3) * (4 * mid**2 - 3)))
            return b * big * (s - d)
    return sphere(p, q)


def sphere(p: Point, q: Point, radius: float = 6371008.8) -> float:
    dy, dx = math.radians(q[1] - p[1]) / 2, math.radians(q[0] - p[0]) / 2
    return 2 * radius * math.asin(math.sqrt(min(1.0, math.sin(dy) ** 2 + math.cos(math.radians(p[1])) * math.cos(math.radians(q[1])) * math.sin(dx) ** 2)))


# --- new shapes ---------------------------------------------------------------------------------


def box(x1: float, y1: float, x2: float, y2: float) -> Shape:
    return polygon([(x1, y1), (x1, y2), (x2, y2), (x2, y1), (x1, y1)])


def bounds(s: Shape) -> tuple[float, float, float, float]:
    xs, ys = zip(*s.points, strict=True)
    return min(xs), min(ys), max(xs), max(ys)


def envelope(s: Shape) -> Shape:
    x1, y1, x2, y2 = bounds(s)
    if (x1, y1) == (x2, y2):
        return point((x1, y1))
    return line([(x1, y1), (x2, y2)]) if x1 == x2 or y1 == y2 else box(x1, y1, x2, y2)


def centroid(s: Shape) -> Shape:
    weights: list[tuple[float, Point]] = []
    for m in s.members:
        for k, r in enumerate(m):
            if s.dimension == 2 and (a := ring_area(r)):
                pairs = list(zip(r, r[1:] + r[:1], strict=True))
                c = tuple(sum((p[i] + q[i]) * (p[0] * q[1] - q[0] * p[1]) for p, q in pairs) / (6 * a) for i in (0, 1))
                weights.append((abs(a) * (-1 if k else 1), c))
            elif s.dimension == 1:
                weights += [(math.dist(p, q), ((p[0] + q[0]) / 2, (p[1] + q[1]) / 2)) for p, q in zip(r, r[1:], strict=False)]
            else:
                weights += [(1.0, p) for p in r]
    total = sum(w for w, _ in weights)
    return point(tuple(sum(w * c[i] for w, c in weights) / total for i in (0, 1))) if total else point(s.points[0])


def hull(s: Shape) -> Shape:
    pts = sorted(set(s.points))
    if len(pts) == 1:
        return point(pts[0])

    def half(ordered):
        out = []
        for p in ordered:
            while len(out) > 1 and _side(out[-2], out[-1], p) <= 0:
                out.pop()
            out.append(p)
        return out

    low, high = half(pts), half(pts[::-1])
    ring = low[:-1] + high[:-1]
    return line(pts[:: len(pts) - 1]) if len(ring) < 3 else polygon([*ring, ring[0]])


def moved(s: Shape, change) -> Shape:
    return Shape(s.kind, tuple(tuple(tuple(change(p) for p in r) for r in m) for m in s.members), s.srid)


def _turn(angle: float):
    c, n = math.cos(angle), math.sin(angle)
    return lambda p: (p[0] * c - p[1] * n, p[0] * n + p[1] * c)


def reverse(s: Shape) -> Shape:
    return Shape(s.kind, tuple(tuple(r[::-1] for r in m) for m in s.members), s.srid)


def valid(s: Shape | None) -> bool:
    if s is None:
        return False
    return all(len(r) >= 4 and r[0] == r[-1] for m in s.members for r in m) if s.dimension == 2 else all(len(m[0]) >= 2 for m in s.members) if s.dimension == 1 else True


def _nth(ring, n: int) -> Shape | None:
    n = n - 1 if n > 0 else len(ring) + n
    return point(ring[n]) if 0 <= n < len(ring) else None


def _line_of(s: Shape):
    return s.members[0][0] if s.kind == "LINESTRING" and s.members else None


def _closed(s: Shape) -> bool:
    return all(m[0][0] == m[0][-1] for m in s.members) if s.dimension == 1 else True


def _simple(ring) -> bool:
    segs = list(zip(ring, ring[1:], strict=False))
    return not any(_cross(*segs[i], *segs[j]) for i in range(len(segs)) for j in range(i + 2, len(segs)) if not (i == 0 and j == len(segs) - 1))


# --- geopoly ------------------------------------------------------------------------------------


@lru_cache(8192)
def geopoly(t: str) -> Shape | None:
    """A closed ring of at least three distinct points from a JSON array of [x, y]."""
    try:
        pts = [(float(p[0]), float(p[1])) for p in json.loads(t)]
    except (ValueError, TypeError, IndexError, KeyError):
        return None
    return polygon(pts) if len(pts) >= 4 and pts[0] == pts[-1] else None


def poly_text(s: Shape | None) -> str | None:
    return None if s is None else "[" + ",".join(f"[{num(x)},{num(y)}]" for x, y in s.members[0][0]) + "]"


def _overlap(a: Shape, b: Shape) -> int:
    """0 apart, 1 overlapping, 2 a within b, 3 b within a, 4 equal."""
    if equals(a, b):
        return 4
    return 2 if covers(b, a) else 3 if covers(a, b) else 1 if interiors_meet(a, b) else 0


def _regular(x: float, y: float, r: float, n: float) -> str | None:
    if r <= 0 or n < 3:
        return None
    n = min(int(n), 1000)
    ring = [(x + r * math.cos(2 * math.pi * i / n), y + r * math.sin(2 * math.pi * i / n)) for i in range(n)]
    return poly_text(polygon([*ring, ring[0]]))


def _ccw(s: Shape) -> Shape:
    return reverse(s) if ring_area(s.members[0][0]) < 0 else s


def _on_shape(fn, needs_points: bool = False):
    """A function of a shape's text; None for what isn't a shape (or has no points)."""

    def run(t: str, *rest):
        s = parse(t)
        return None if s is None or (needs_points and not s.points) else fn(s, *rest)

    return run


def _on_two(fn):
    def run(a: str, b: str):
        x, y = parse(a), parse(b)
        return None if x is None or y is None else fn(x, y)

    return run


def _on_poly(fn):
    def run(t: str, *rest):
        s = geopoly(t)
        return None if s is None else fn(s, *rest)

    return run


def _two_polys(fn):
    def run(a: str, b: str):
        x, y = geopoly(a), geopoly(b)
        return None if x is None or y is None else fn(x, y)

    return run


def _bound(i: int):
    def run(t: str):
        s = parse(t) or geopoly(t)
        return bounds(s)[i] if s is not None and s.points else None

    return run


def _box_poly(x1: float, y1: float, x2: float, y2: float) -> str:
    return poly_text(polygon([(x1, y1), (x2, y1), (x2, y2), (x1, y2), (x1, y1)]))


def register(spark) -> None:
    s, d, i, b = "string", "double", "bigint", "boolean"
    shape = lambda fn, kind, n=1, points=True: (_on_shape(fn, points), kind, n)
    made = {
        "st_x": shape(lambda g: g.points[0][0] if g.kind == "POINT" else None, d), "st_y": shape(lambda g: g.points[0][1] if g.kind == "POINT" else None, d), "st_srid": shape(lambda g: g.srid, i, 1, False),
        "st_astext": shape(lambda g: text(Shape(g.kind, g.members)), s, 1, False), "st_asgeojson": shape(geojson, s), "st_geometrytype": shape(lambda g: g.kind, s, 1, False), "st_npoints": shape(lambda g: len(g.points), i, 1, False),
        "st_numpoints": shape(lambda g: len(_line_of(g)) if _line_of(g) else None, i), "st_isvalid": (lambda t: valid(parse(t)), b, 1), "st_startpoint": shape(lambda g: text(point(_line_of(g)[0])) if _line_of(g) else None, s),
        "st_endpoint": shape(lambda g: text(point(_line_of(g)[-1])) if _line_of(g) else None, s), "st_pointn": shape(lambda g, n: text(_nth(_line_of(g), n)) if _line_of(g) else None, s, 2),
        "st_numinteriorrings": shape(lambda g: len(g.members[0]) - 1 if g.kind == "POLYGON" else None, i), "st_exteriorring": shape(lambda g: text(line(g.members[0][0])) if g.kind == "POLYGON" else None, s),
        "st_interiorringn": shape(lambda g, n: text(line(g.members[0][n])) if g.kind == "POLYGON" and 1 <= n < len(g.members[0]) else None, s, 2), "st_isclosed": shape(_closed, b),
        "st_isring": shape(lambda g: bool(_line_of(g)) and _closed(g) and _simple(_line_of(g)), b), "st_area": shape(area, d, 1, False), "st_length": shape(length, d, 1, False), "st_perimeter": shape(perimeter, d, 1, False),
        "st_distance": (_on_two(distance), d, 2), "st_distancespheroid": (_on_two(lambda x, y: spheroid(x.points[0], y.points[0])), d, 2),
        "st_contains": (_on_two(contains), b, 2), "st_within": (_on_two(lambda x, y: contains(y, x)), b, 2), "st_intersects": (_on_two(intersects), b, 2), "st_disjoint": (_on_two(lambda x, y: not intersects(x, y)), b, 2),
        "st_touches": (_on_two(touches), b, 2), "st_crosses": (_on_two(crosses), b, 2), "st_overlaps": (_on_two(overlaps), b, 2), "st_equals": (_on_two(equals), b, 2),
        "st_envelope": shape(lambda g: text(envelope(g)), s), "st_expand": shape(lambda g, x, y: text(box(bounds(g)[0] - x, bounds(g)[1] - y, bounds(g)[2] + x, bounds(g)[3] + y)), s, 3), "st_centroid": shape(lambda g: text(centroid(g)), s),
        "st_translate": shape(lambda g, x, y: text(moved(g, lambda p: (p[0] + x, p[1] + y))), s, 3), "st_scale": shape(lambda g, x, y: text(moved(g, lambda p: (p[0] * x, p[1] * y))), s, 3), "st_rotate": shape(lambda g, a: text(moved(g, _turn(a))), s, 2),
        "st_reverse": shape(lambda g: text(reverse(g)), s), "st_convexhull": shape(lambda g: text(hull(g)), s), "st_makeline": (_on_two(lambda x, y: text(line(x.points + y.points))), s, 2),
        "st_point": (lambda x, y: text(point((x, y))), s, 2), "st_geomfromtext": (lambda t, n: (lambda g: text(Shape(g.kind, g.members, n or g.srid)) if g else None)(parse(t)), s, 2), "st_setsrid": shape(lambda g, n: text(Shape(g.kind, g.members, n)), s, 2, False),
        "st_makeenvelope": (lambda x1, y1, x2, y2, n: text(Shape("POLYGON", box(x1, y1, x2, y2).members, n)), s, 5), "st_xmin": (_bound(0), d, 1), "st_ymin": (_bound(1), d, 1), "st_xmax": (_bound(2), d, 1), "st_ymax": (_bound(3), d, 1),
        "bbox_of": (_box_poly, s, 4), "geopoly_area": (_on_poly(lambda g: ring_area(g.members[0][0])), d, 1), "geopoly_bbox": (_on_poly(lambda g: _box_poly(*bounds(g))), s, 1), "geopoly_ccw": (_on_poly(lambda g: poly_text(_ccw(g))), s, 1),
        "geopoly_json": (_on_poly(poly_text), s, 1), "geopoly_blob": (_on_poly(poly_text), s, 1), "geopoly_svg": (_on_poly(lambda g: "<polyline points='" + " ".join(f"{num(x)},{num(y)}" for x, y in g.members[0][0]) + "'></polyline>"), s, 1),
        "geopoly_overlap": (_two_polys(_overlap), i, 2), "geopoly_within": (_two_polys(lambda x, y: 2 if equals(x, y) else 1 if covers(y, x) else 0), i, 2), "geopoly_contains_point": (_on_poly(lambda g, x, y: {1: 2, 0: 1, -1: 0}[locate((x, y), g)]), i, 3),
        "geopoly_regular": (_regular, s, 4), "geopoly_xform": (_on_poly(lambda g, a, bb, c, dd, e, f: poly_text(moved(g, lambda p: (a * p[0] + bb * p[1] + e, c * p[0] + dd * p[1] + f)))), s, 7),
    }
    register_all(spark, {f"s_{k}": v for k, v in made.items()})
