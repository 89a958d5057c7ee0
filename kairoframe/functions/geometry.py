"""Table geometry and pose geometry as column expressions, for one table or for one in each row."""

from __future__ import annotations

import numpy as np
from pyspark.sql import Column
from pyspark.sql import functions as F

from .binding import bound

#: Table length and width in metres.
LENGTH_M, WIDTH_M = 2.74, 1.525


def homography(corners: list[tuple[float, float]], length: float = LENGTH_M, width: float = WIDTH_M) -> list[float]:
    """The nine entries of the projective map that takes image corners to (0,0), (L,0), (L,W), (0,W)."""
    rows, right = [], []
    for (x, y), (u, v) in zip(corners, [(0, 0), (length, 0), (length, width), (0, width)], strict=True):
        rows += [[x, y, 1, 0, 0, 0, -u * x, -u * y], [0, 0, 0, x, y, 1, -v * x, -v * y]]
        right += [u, v]
    return [*np.linalg.solve(np.array(rows, float), np.array(right, float)).tolist(), 1.0]


def _named(**values: Column) -> Column:
    return F.struct(*[v.alias(k) for k, v in values.items()])


def _map(p: Column) -> Column:
    """Entries a to h of the map of the unit square to four points (x0, y0 to x3, y3), each step worked out once."""
    sides = _named(sx=p["x0"] - p["x1"] + p["x2"] - p["x3"], sy=p["y0"] - p["y1"] + p["y2"] - p["y3"], ax=p["x1"] - p["x2"], ay=p["y1"] - p["y2"], bx=p["x3"] - p["x2"], by=p["y3"] - p["y2"])

    def bent(s: Column) -> Column:
        below = s["ax"] * s["by"] - s["bx"] * s["ay"]
        return _named(g=F.try_divide(s["sx"] * s["by"] - s["bx"] * s["sy"], below), h=F.try_divide(s["ax"] * s["sy"] - s["sx"] * s["ay"], below))

    def whole(q: Column) -> Column:
        g, h = q["g"], q["h"]
        return _named(a=p["x1"] - p["x0"] + g * p["x1"], b=p["x3"] - p["x0"] + h * p["x3"], c=p["x0"], d=p["y1"] - p["y0"] + g * p["y1"], e=p["y3"] - p["y0"] + h * p["y3"], f=p["y0"], g=g, h=h)

    return bound(sides, lambda s: bound(bent(s), whole))


def _back(m: Column, length: float, width: float) -> Column:
    """The adjugate of a map, which leads back, with the unit square stretched to length and width; null if it is singular."""
    a, b, c, d, e, f, g, h = (m[k] for k in "abcdefgh")
    rows = [e - f * h, c * h - b, b * f - c * e, f * g - d, a - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d]
    scale = [length] * 3 + [width] * 3 + [1.0] * 3
    return F.when(a * rows[0] + b * rows[3] + c * rows[6] != 0, F.array(*[v * k for v, k in zip(rows, scale, strict=True)]))


def _points(corners: list[tuple[Column, Column]]) -> Column:
    return _named(**{f"{c}{i}": v.cast("double") for i, p in enumerate(corners) for c, v in zip("xy", p, strict=True)})


def solved(corners: list[tuple[Column, Column]], length: float = LENGTH_M, width: float = WIDTH_M) -> Column:
    """The nine entries of ``homography``'s map, up to a factor, as an array, for corners that differ by row.

    The map of the unit square to four points has a closed form, and its adjugate leads back. Null where three corners lie on
    a line, or one is missing.
    """
    return bound(_points(corners), lambda p: bound(_map(p), lambda m: _back(m, length, width)))


def table_of(corners: list[tuple[Column, Column]]) -> Column:
    """A table's scalars from its corners (far left, far right, near right, near left) as a struct; null without a table.

    h: entries of the map to metres; net_x, length_px, m_per_px; x0, x1, y0, y1: the corners' range; slope and level: height
    in the image of the near edge, level + slope * x.
    """

    def scalars(p: Column) -> Column:
        xs, ys = ([p[f"{c}{i}"] for i in range(4)] for c in "xy")
        plain = _named(
            map=_map(p), length_px=(F.hypot(xs[1] - xs[0], ys[1] - ys[0]) + F.hypot(xs[2] - xs[3], ys[2] - ys[3])) / 2,
            x0=F.least(*xs), x1=F.greatest(*xs), y0=F.least(*ys), y1=F.greatest(*ys), slope=(ys[2] - ys[3]) / F.greatest(xs[2] - xs[3], F.lit(1e-6)), x=xs[3], y=ys[3],
        )
        return bound(plain, lambda t: bound(_named(h=_back(t["map"], LENGTH_M, WIDTH_M), t=t), placed))

    def placed(v: Column) -> Column:
        t, m = v["t"], v["t"]["map"]
        net = F.try_divide((m["a"] + m["b"]) / 2 + m["c"], (m["g"] + m["h"]) / 2 + 1)
        keep = {k: t[k] for k in ("length_px", "x0", "x1", "y0", "y1", "slope")}
        return F.when(v["h"].isNotNull() & net.isNotNull(), _named(h=v["h"], net_x=net, m_per_px=F.try_divide(F.lit(LENGTH_M), t["length_px"]), level=t["y"] - t["slope"] * t["x"], **keep))

    return bound(_points(corners), scalars)


def over_table(table: Column, x: Column, y: Column) -> Column:
    """``TableShape.over`` with the scalars of ``table_of``."""
    side = 0.03 * (table["x1"] - table["x0"])
    return x.between(table["x0"] - side, table["x1"] + side) & y.between(table["y0"] - 0.06 * table["length_px"], table["y1"] + 0.02 * table["length_px"])


def to_table(x: Column, y: Column, h: list[float] | Column) -> tuple[Column, Column]:
    """Image point to metres on the table; null where the point is at infinity. h: nine numbers, or an array column of them."""
    if isinstance(h, Column):
        h = [F.get(h, i) for i in range(9)]
    w = h[6] * x + h[7] * y + h[8]
    return F.try_divide(h[0] * x + h[1] * y + h[2], w), F.try_divide(h[3] * x + h[4] * y + h[5], w)


def half(u: Column) -> Column:
    return F.when(u < LENGTH_M / 2, "left").when(u.isNotNull(), "right")


class TableShape:
    """Scalars of a table in the image, from its corners (far left, far right, near right, near left)."""

    def __init__(self, corners: list[tuple[float, float]]):
        self.corners = corners
        self.h = homography(corners)
        inverse = np.linalg.inv(np.array(self.h).reshape(3, 3))
        x, _, w = inverse @ np.array([LENGTH_M / 2, WIDTH_M / 2, 1.0])
        self.net_x = float(x / w)
        c = np.array(corners, float)
        near, far = np.linalg.norm(c[2] - c[3]), np.linalg.norm(c[1] - c[0])
        self.length_px = float((near + far) / 2)
        self.m_per_px = LENGTH_M / self.length_px
        self.x_range = (float(c[:, 0].min()), float(c[:, 0].max()))

    def over(self, x: Column, y: Column) -> Column:
        """Whether a point is over the table in the image, a little to either side, above and below it."""
        (x0, x1), ys = self.x_range, [c[1] for c in self.corners]
        side = 0.03 * (x1 - x0)
        return x.between(x0 - side, x1 + side) & y.between(min(ys) - 0.06 * self.length_px, max(ys) + 0.02 * self.length_px)

    def surface_y(self, x: Column) -> Column:
        """Height in the image of the table's near edge at a column of pixels."""
        (rx, ry), (lx, ly) = self.corners[2], self.corners[3]
        return ly + (x - lx) / max(rx - lx, 1e-6) * (ry - ly)


def order_corners(points: list[tuple[float, float]]) -> list[tuple[float, float]]:
    """The two of least y are the far ones; far left, far right, near right, near left."""
    by_y = sorted(points, key=lambda p: p[1])
    far, near = sorted(by_y[:2]), sorted(by_y[2:])
    return [far[0], far[1], near[1], near[0]]


def polygon_distance(x: Column, y: Column, corners: list[tuple[float, float]]) -> Column:
    """Signed distance to a convex polygon's border: positive inside, negative outside."""
    edges = list(zip(corners, corners[1:] + corners[:1], strict=True))
    turn = sum((b[0] - a[0]) * (b[1] + a[1]) for a, b in edges)
    sign = -1.0 if turn > 0 else 1.0
    distances, sides = [], []
    for (ax, ay), (bx, by) in edges:
        dx, dy = bx - ax, by - ay
        t = F.greatest(F.lit(0.0), F.least(F.lit(1.0), ((x - ax) * dx + (y - ay) * dy) / (dx * dx + dy * dy)))
        distances.append(F.hypot(x - ax - t * dx, y - ay - t * dy))
        sides.append(sign * (dx * (y - ay) - dy * (x - ax)) >= 0)
    inside = sides[0]
    for s in sides[1:]:
        inside = inside & s
    return F.when(inside, F.least(*distances)).otherwise(-F.least(*distances))


def iou(a: list[Column], b: list[Column]) -> Column:
    """Intersection over union of boxes (x1, y1, x2, y2)."""
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = lambda r: (r[2] - r[0]) * (r[3] - r[1])
    return w * h / (area(a) + area(b) - w * h + 1e-9)


def same_row(a_top: Column, a_bottom: Column, b_top: Column, b_bottom: Column) -> Column:
    """Vertical overlap of more than half of the smaller one."""
    return F.least(a_bottom, b_bottom) - F.greatest(a_top, b_top) > 0.5 * F.least(a_bottom - a_top, b_bottom - b_top)


def angle(ax: Column, ay: Column, bx: Column, by: Column, cx: Column, cy: Column) -> Column:
    """Angle at b in degrees; null where an arm has no length."""
    dot = (ax - bx) * (cx - bx) + (ay - by) * (cy - by)
    n = F.hypot(ax - bx, ay - by) * F.hypot(cx - bx, cy - by)
    return F.when(n > 0, F.degrees(F.acos(F.greatest(F.lit(-1.0), F.least(F.lit(1.0), dot / n)))))
