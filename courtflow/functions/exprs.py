"""Column expressions over boxes, court points and transforms."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

#: Court margins and zone limits in feet (fixed values).
TEAM_MARGIN, ROI_MARGIN = 3.0, 1.5
PAINT_X, KEY_X, CORNER_X, WING_X = 19.0, 25.0, 14.0, 25.0
ZONES = ["PAINT", "TOP_OF_KEY", "PERIMETER", "LEFT_CORNER", "RIGHT_CORNER", "LEFT_WING", "RIGHT_WING"]


def col(c) -> Column:
    return F.col(c) if isinstance(c, str) else c


def feet_point(x1, y1, x2, y2) -> tuple[Column, Column]:
    """Ground contact of a box."""
    return (col(x1) + col(x2)) / 2, col(y2)


def center(x1, y1, x2, y2) -> tuple[Column, Column]:
    return (col(x1) + col(x2)) / 2, (col(y1) + col(y2)) / 2


def project(h: list, x, y) -> tuple[Column, Column, Column]:
    """Point through a 3x3 transform given as nine columns: (X, Y, w); null where |w| < 1e-9."""
    x, y, h = col(x), col(y), [col(c) for c in h]
    w = h[6] * x + h[7] * y + h[8]
    safe = F.when(F.abs(w) >= 1e-9, w)
    return (h[0] * x + h[1] * y + h[2]) / safe, (h[3] * x + h[4] * y + h[5]) / safe, w


def compose(a: list, b: list) -> list[Column]:
    """A times B, normalised by the last element; null where that is 0."""
    a, b = [col(c) for c in a], [col(c) for c in b]
    raw = [sum((a[3 * i + k] * b[3 * k + j] for k in range(1, 3)), a[3 * i] * b[j]) for i in range(3) for j in range(3)]
    return [F.try_divide(c, raw[8]) for c in raw]


def inverse(m: list) -> list[Column]:
    """Adjugate over determinant; null where the determinant is 0."""
    a, b, c, d, e, f, g, h, i = (col(x) for x in m)
    det = a * (e * i - f * h) - b * (d * i - f * g) + c * (d * h - e * g)
    det = F.when(det != 0, det)
    return [x / det for x in (e * i - f * h, c * h - b * i, b * f - c * e, f * g - d * i, a * i - c * g, c * d - a * f, d * h - e * g, b * g - a * h, a * e - b * d)]


def in_court(x, y, length: float, width: float, margin: float) -> Column:
    return col(x).between(-margin, length + margin) & col(y).between(-margin, width + margin)


def point_to_box(x, y, x1, y1, x2, y2) -> Column:
    """Distance from a point to a box, 0 inside."""
    dx = F.greatest(col(x1) - col(x), F.lit(0.0), col(x) - col(x2))
    dy = F.greatest(col(y1) - col(y), F.lit(0.0), col(y) - col(y2))
    return F.sqrt(dx * dx + dy * dy)


def iou(a: list, b: list) -> Column:
    a, b = [col(c) for c in a], [col(c) for c in b]
    w = F.greatest(F.lit(0.0), F.least(a[2], b[2]) - F.greatest(a[0], b[0]))
    h = F.greatest(F.lit(0.0), F.least(a[3], b[3]) - F.greatest(a[1], b[1]))
    area = (a[2] - a[0]) * (a[3] - a[1]) + (b[2] - b[0]) * (b[3] - b[1]) - w * h
    return F.when(area > 0, w * h / area).otherwise(F.lit(0.0))


def third(x) -> Column:
    """Length-third of an 84-foot court."""
    return F.when(col(x) < 28, "left").when(col(x) >= 56, "right").otherwise("middle")


def zone_of(x, y, length: float = 84.0, lane: tuple[float, float] = (19.0, 31.0)) -> Column:
    """One of ``ZONES``, by depth from the nearer baseline; behind it counts as on it. Sides are those of the diagram."""
    x, y = col(x), col(y)
    depth = F.greatest(F.when(x <= length / 2, x).otherwise(length - x), F.lit(0.0))
    side = F.when(y < lane[0], "LEFT").otherwise("RIGHT")
    straight = F.when(depth <= PAINT_X, "PAINT").when(depth <= KEY_X, "TOP_OF_KEY").otherwise("PERIMETER")
    wide = F.when(depth <= CORNER_X, F.concat(side, F.lit("_CORNER"))).when(depth <= WING_X, F.concat(side, F.lit("_WING"))).otherwise("PERIMETER")
    return F.when(y.between(*lane), straight).otherwise(wide)


def shot_zone(x, y, length: float = 84.0, rim: float = 5.25, mid: float = 25.0) -> tuple[Column, Column]:
    """(zone, distance to the nearer rim in feet)."""
    x, y = col(x), col(y)
    d = F.least(F.sqrt((x - rim) * (x - rim) + (y - mid) * (y - mid)), F.sqrt((x - (length - rim)) * (x - (length - rim)) + (y - mid) * (y - mid)))
    return F.when(d > 19.75, "three").when(d <= 8, "paint").otherwise("midrange"), d


def timestamp_s(frame, fps) -> Column:
    return F.bround(col(frame) / col(fps), 3)


def stable_bucket(key) -> Column:
    """100..255 from md5."""
    return F.lit(100) + F.pmod(F.conv(F.substring(F.md5(col(key).cast("string")), 1, 2), 16, 10).cast("int"), F.lit(156))
