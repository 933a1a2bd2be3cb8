"""Columns over boxes, points, polygons and image frames."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .tensor import half_up, let

#: Labels of eight directions clockwise from "right" in image coordinates, and of no motion.
DIRECTIONS = ("右", "右下", "下", "左下", "左", "左上", "上", "右上")
STILL = "静止"

BOX = "struct<x1:float,y1:float,x2:float,y2:float,score:float,class_id:int>"


def box(x1: Column, y1: Column, x2: Column, y2: Column, score: Column, class_id: Column) -> Column:
    return F.struct(*(c.cast("float").alias(n) for c, n in ((x1, "x1"), (y1, "y1"), (x2, "x2"), (y2, "y2"), (score, "score"))), class_id.cast("int").alias("class_id"))


def center_x(b: Column) -> Column:
    return ((b["x1"] + b["x2"]) * F.lit(0.5).cast("float")).cast("float")


def center_y(b: Column) -> Column:
    return ((b["y1"] + b["y2"]) * F.lit(0.5).cast("float")).cast("float")


def width(b: Column) -> Column:
    return b["x2"] - b["x1"]


def height(b: Column) -> Column:
    return b["y2"] - b["y1"]


def is_empty(b: Column) -> Column:
    return (width(b) <= 0) | (height(b) <= 0)


def _overlap(a: Column, b: Column) -> tuple[Column, Column, Column]:
    zero = F.lit(0.0)
    w = F.greatest(zero, F.least(a["x2"], b["x2"]) - F.greatest(a["x1"], b["x1"]))
    h = F.greatest(zero, F.least(a["y2"], b["y2"]) - F.greatest(a["y1"], b["y1"]))
    inter = w * h
    area = lambda r: F.greatest(zero, width(r)) * F.greatest(zero, height(r))
    return inter, area(a), area(b)


def iou(a: Column, b: Column) -> Column:
    """Intersection over union of float boxes, 0 where the union is empty."""
    inter, aa, bb = _overlap(a, b)
    union = aa + bb - inter
    return F.when(union <= 0, F.lit(0.0)).otherwise(inter / union).cast("float")


def iou_floored(a: Column, b: Column) -> Column:
    """Corners are floored first; 0 where the union is under 1e-10."""
    fl = lambda r: F.struct(*(F.floor(r[c]).cast("double").alias(c) for c in ("x1", "y1", "x2", "y2")))
    inter, aa, bb = _overlap(fl(a), fl(b))
    union = aa + bb - inter
    return F.when(union < 1e-10, F.lit(0.0)).otherwise(inter / union).cast("float")


def anchor_x(b: Column) -> Column:
    return center_x(b)


def anchor_y(b: Column, policy: str = "CENTER") -> Column:
    if policy not in ("CENTER", "BOTTOM_CENTER"):
        raise ValueError(f"unknown anchor {policy}")
    return center_y(b) if policy == "CENTER" else b["y2"]


def in_rectangle(x: Column, y: Column, x1: float, y1: float, x2: float, y2: float) -> Column:
    """Half-open: lower edges belong to the rectangle, upper ones do not."""
    return (x >= min(x1, x2)) & (x < max(x1, x2)) & (y >= min(y1, y2)) & (y < max(y1, y2))


def in_polygon(x: Column, y: Column, points: list[tuple[float, float]]) -> Column:
    """Even-odd rule over the polygon's edges, in float32."""
    if len(points) < 3:
        raise ValueError("a polygon has three points at least")
    f = lambda v: F.lit(float(v)).cast("float")
    crossings = F.lit(0)
    for (xi, yi), (xj, yj) in zip(points, points[-1:] + points[:-1], strict=True):
        if yi == yj:
            continue  # a level edge is never crossed
        at = ((f(xj) - f(xi)) * (y - f(yi)) / (f(yj) - f(yi))).cast("float") + f(xi)
        hit = ((f(yi) > y) != (f(yj) > y)) & (x < at)
        crossings = crossings + hit.cast("int")
    return crossings % 2 == 1


def side_of_line(x: Column, y: Column, ax: float, ay: float, bx: float, by: float) -> Column:
    """Cross product of the line's direction with the point; positive is forward."""
    return F.lit(float(bx - ax)) * (y - ay) - F.lit(float(by - ay)) * (x - ax)


def direction_degrees(vx: Column, vy: Column) -> Column:
    d = F.degrees(F.atan2(vy.cast("double"), vx.cast("double")))
    return F.when(d < 0, d + 360).otherwise(d)


def direction_label(vx: Column, vy: Column) -> Column:
    index = ((direction_degrees(vx, vy) + 22.5) / 45).cast("int") % 8
    return F.when((vx == 0) & (vy == 0), F.lit(STILL)).otherwise(F.element_at(F.array(*map(F.lit, DIRECTIONS)), index + 1))


# --- letterboxes ------------------------------------------------------------------


def letterbox_centred(w: Column, h: Column, side: int, rounding: bool = False) -> dict[str, Column]:
    """Scale, new size and left/top padding; sizes truncated, or rounded half up."""
    ratio = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    to = half_up if rounding else F.floor
    nw, nh = to(w * ratio), to(h * ratio)
    return {"scale": ratio, "width": nw, "height": nh, "left": F.floor((side - nw) / 2), "top": F.floor((side - nh) / 2)}


def letterbox_corner(w: Column, h: Column, side: int) -> dict[str, Column]:
    """Content in the top left corner, sizes rounded half up and at least 1."""
    ratio = F.least(F.lit(float(side)) / w, F.lit(float(side)) / h)
    return {"scale": ratio, "width": F.greatest(F.lit(1), half_up(w * ratio)), "height": F.greatest(F.lit(1), half_up(h * ratio)), "left": F.lit(0), "top": F.lit(0)}


def letterbox_inverse(v: Column, pad: Column, scale: Column, limit: Column) -> Column:
    """Model coordinate to image coordinate, clamped to the image."""
    return F.greatest(F.lit(0.0), F.least(limit.cast("double"), (v - pad) / scale))


# --- tiles ------------------------------------------------------------------------


def tile_starts(length: Column, tile: int, step: int) -> Column:
    """Starts every ``step`` from 0 and one that ends at ``length``; 0 alone where it fits one tile."""
    if tile < 1 or step < 1:
        raise ValueError("tile and step are positive")
    last = (length - tile).cast("int")
    many = F.array_distinct(F.concat(F.sequence(F.lit(0), last, F.lit(step)), F.array(last)))
    return F.when(length <= tile, F.array(F.lit(0))).otherwise(many)


def core_tiles(length: Column, tile: int, overlap: int) -> Column:
    """ARRAY<STRUCT<start, core, from, to>>: cores that cover the length once, and the inputs around them."""
    step, margin = max(1, tile - overlap), overlap // 2
    starts = F.sequence(F.lit(0), (length - 1).cast("int"), F.lit(step))

    def one(s: Column) -> Column:
        core = F.least(F.lit(step), length - s)
        return F.struct(s.alias("start"), core.cast("int").alias("core"), F.greatest(F.lit(0), s - margin).cast("int").alias("from"), F.least(length, s + core + margin).cast("int").alias("to"))

    return F.when(length > 0, F.transform(starts, one)).otherwise(F.array().cast("array<struct<start:int,core:int,from:int,to:int>>"))


def grid_tiles(w: Column, h: Column, rows: int, cols: int, overlap: float) -> Column:
    """ARRAY<STRUCT<row, col, x1, y1, x2, y2>> of a rows x cols grid widened by a share of the smaller cell side."""
    tw, th = F.floor(w / cols), F.floor(h / rows)
    pad = F.floor(F.least(tw, th) * overlap)
    cells = F.array(*(F.struct(F.lit(r).alias("row"), F.lit(c).alias("col")) for r in range(rows) for c in range(cols)))
    lo = lambda i, t: F.greatest(F.lit(0), i * t - pad).cast("int")
    hi = lambda i, t, n: F.least(n, (i + 1) * t + pad).cast("int")
    tiles = F.transform(cells, lambda q: F.struct(q["row"].alias("row"), q["col"].alias("col"), lo(q["col"], tw).alias("x1"), lo(q["row"], th).alias("y1"), hi(q["col"], tw, w).alias("x2"), hi(q["row"], th, h).alias("y2")))
    return F.when((tw > 0) & (th > 0), tiles).otherwise(F.array().cast("array<struct<row:int,col:int,x1:int,y1:int,x2:int,y2:int>>"))


# --- quadrilaterals ---------------------------------------------------------------


def distance(ax: Column, ay: Column, bx: Column, by: Column) -> Column:
    return F.sqrt((ax - bx) * (ax - bx) + (ay - by) * (ay - by))


def _next(points: Column) -> Column:
    return F.concat(F.slice(points, 2, F.size(points) - 1), F.slice(points, 1, 1))


def shoelace(points: Column) -> Column:
    """Absolute area of a polygon of STRUCT<x, y>."""
    terms = F.zip_with(points, _next(points), lambda a, b: (a["x"] * b["y"] - b["x"] * a["y"]).cast("double"))
    return F.abs(F.aggregate(terms, F.lit(0.0), lambda s, t: s + t)) / 2


def centroid(points: Column) -> Column:
    """Area centroid; the bounding box's centre where the area is under 1e-9."""
    pairs = F.zip_with(points, _next(points), lambda a, b: F.struct((a["x"] * b["y"] - b["x"] * a["y"]).cast("double").alias("c"), (a["x"] + b["x"]).cast("double").alias("x"), (a["y"] + b["y"]).cast("double").alias("y")))
    total = lambda f: F.aggregate(F.transform(pairs, f), F.lit(0.0), lambda s, t: s + t)
    area = total(lambda p: p["c"]) / 2
    xs, ys = F.transform(points, lambda p: p["x"].cast("double")), F.transform(points, lambda p: p["y"].cast("double"))
    flat = F.abs(area) < 1e-9
    x = F.when(flat, (F.array_min(xs) + F.array_max(xs)) / 2).otherwise(total(lambda p: p["c"] * p["x"]) / (6 * area))
    y = F.when(flat, (F.array_min(ys) + F.array_max(ys)) / 2).otherwise(total(lambda p: p["c"] * p["y"]) / (6 * area))
    return F.struct(x.alias("x"), y.alias("y"))


def is_convex(points: Column) -> Column:
    """All turns of the polygon have one sign (turns under 1e-9 count as none) and its area is 1 at least."""
    nxt, nxt2 = _next(points), _next(_next(points))
    edges = F.zip_with(points, nxt, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    edges2 = F.zip_with(nxt, nxt2, lambda a, b: F.struct((b["x"] - a["x"]).alias("x"), (b["y"] - a["y"]).alias("y")))
    cross = F.filter(F.zip_with(edges, edges2, lambda a, b: (a["x"] * b["y"] - a["y"] * b["x"]).cast("double")), lambda c: F.abs(c) >= 1e-9)
    return (shoelace(points) >= 1.0) & (F.size(cross) > 0) & (F.forall(cross, lambda c: c > 0) | F.forall(cross, lambda c: c < 0))


def quad_ratio(points: Column) -> Column:
    """Longer over shorter mean of opposite edges; 0 for a flat quadrilateral."""
    means = let(edge_lengths(points), lambda e: F.struct(((e[0] + e[2]) / 2).alias("w"), ((e[1] + e[3]) / 2).alias("h")))
    return let(means, lambda m: F.when((m["w"] <= 0) | (m["h"] <= 0), F.lit(0.0)).otherwise(F.greatest(m["w"], m["h"]) / F.least(m["w"], m["h"])))


def edge_deviation(points: Column) -> Column:
    """Largest relative difference of opposite edges."""
    pair = lambda e, i: F.when(F.greatest(e[i], e[i + 2]) <= 0, F.lit(1.0)).otherwise(F.abs(e[i] - e[i + 2]) / F.greatest(e[i], e[i + 2]))
    return let(edge_lengths(points), lambda e: F.greatest(pair(e, 0), pair(e, 1)))


def touches_border(points: Column, w: Column, h: Column, margin: int) -> Column:
    return F.exists(points, lambda p: (p["x"] <= margin) | (p["y"] <= margin) | (p["x"] >= w - 1 - margin) | (p["y"] >= h - 1 - margin))


def edge_lengths(points: Column) -> Column:
    return let(points, lambda q: F.zip_with(q, _next(q), lambda a, b: F.sqrt(((a["x"] - b["x"]) * (a["x"] - b["x"]) + (a["y"] - b["y"]) * (a["y"] - b["y"])).cast("double"))))


def order_corners(points: Column) -> Column:
    """Four corners by angle around their mean, from the least x + y on, a long edge first."""
    n = F.size(points)
    mx = F.aggregate(F.transform(points, lambda p: p["x"].cast("double")), F.lit(0.0), lambda s, v: s + v) / n
    my = F.aggregate(F.transform(points, lambda p: p["y"].cast("double")), F.lit(0.0), lambda s, v: s + v) / n
    by_angle = F.transform(F.array_sort(F.transform(points, lambda p: F.struct(F.atan2(p["y"] - my, p["x"] - mx).alias("a"), p.alias("p")))), lambda s: s["p"])
    sums = F.transform(by_angle, lambda p: p["x"] + p["y"])
    first = F.array_position(sums, F.array_min(sums)).cast("int")
    turned = F.concat(F.slice(by_angle, first, n), F.slice(by_angle, F.lit(1), first - 1))
    lengths = edge_lengths(turned)
    return F.when(lengths[0] >= lengths[3], turned).otherwise(_next(turned))


def output_size(corners: Column) -> Column:
    """Width and height, at least 1, for warping a quadrilateral LT, RT, RB, LB."""
    e = edge_lengths(corners)
    return F.struct(F.greatest(F.lit(1), half_up(F.greatest(e[0], e[2]))).cast("int").alias("width"), F.greatest(F.lit(1), half_up(F.greatest(e[1], e[3]))).cast("int").alias("height"))


def rotate_point(x: Column, y: Column, w: Column, h: Column, degrees: int) -> tuple[Column, Column]:
    """A point's place after the image (w by h) turned clockwise by 0, 90, 180 or 270 degrees."""
    return {0: (x, y), 90: (h - y, x), 180: (w - x, h - y), 270: (y, w - x)}[degrees % 360]


def rotate_back(x: Column, y: Column, w: Column, h: Column, degrees: int) -> tuple[Column, Column]:
    """The inverse of :func:`rotate_point`; w and h are those of the image before it turned."""
    return {0: (x, y), 90: (y, h - x), 180: (w - x, h - y), 270: (w - y, x)}[degrees % 360]


def rotate_box(b: Column, w: Column, h: Column, degrees: int) -> Column:
    (ax, ay), (cx, cy) = rotate_point(b["x1"], b["y1"], w, h, degrees), rotate_point(b["x2"], b["y2"], w, h, degrees)
    return F.struct(F.least(ax, cx).alias("x1"), F.least(ay, cy).alias("y1"), F.greatest(ax, cx).alias("x2"), F.greatest(ay, cy).alias("y2"))


def head_pose(left_x: Column, left_y: Column, right_x: Column, right_y: Column, nose_x: Column, nose_y: Column) -> Column:
    """STRUCT<yaw, pitch>: the nose against the eyes' middle in eye distances; null under 1 pixel."""
    d = distance(left_x, left_y, right_x, right_y)
    pose = F.struct(((nose_x - (left_x + right_x) / 2) / d).cast("float").alias("yaw"), ((nose_y - (left_y + right_y) / 2) / d).cast("float").alias("pitch"))
    return F.when(d >= 1, pose)


def millimetres_to_pixels(mm: Column, dpi: int) -> Column:
    return half_up(mm / 25.4 * dpi).cast("int")


def card_candidate(points: Column, area: Column, w: Column, h: Column, expected: float = 1.586, tolerance: float = 0.25, least_area: float = 1.0, margin: int = 2) -> Column:
    """STRUCT<points, area, ratio, ratio_score> of a contour of four corners that may be a card; null for others.

    Dropped: small areas, contours that touch the border, flat ones, those
    whose ratio or whose opposite edges deviate by more than the tolerance.
    """
    found = lambda p: F.struct(p.alias("p"), quad_ratio(p).alias("ratio"), edge_deviation(p).alias("skew"))

    def judged(c: Column) -> Column:
        deviation = F.abs(c["ratio"] - expected) / expected
        fits = (area >= least_area) & ~touches_border(c["p"], w, h, margin) & (c["ratio"] > 0) & (deviation <= tolerance) & (c["skew"] <= tolerance)
        return F.when(fits, F.struct(c["p"].alias("points"), area.cast("double").alias("area"), c["ratio"].alias("ratio"), (1 - deviation / tolerance).alias("ratio_score")))

    return let(points, lambda p: F.when(F.size(p) == 4, let(found(p), judged)))


def window_affine(box: Column, landmarks: Column | None = None, face_scale: float = 2.0, vertical_offset: float = 0.0, degrees: float = 0.0) -> Column:
    """STRUCT<m00, m01, tx, m10, m11, ty, side>: the similarity that cuts a square window around a face.

    The side is ``face_scale`` times the longer edge, rounded, 2 to 16384; with
    ``landmarks`` (eyes first) the window turns with the line of the eyes.  A
    box without width or height raises.
    """
    d = lambda c: box[c].cast("double")
    bw, bh = d("x2") - d("x1"), d("y2") - d("y1")
    wanted = F.greatest(bw, bh) * face_scale
    side = F.greatest(F.lit(2.0), F.least(F.lit(16384.0), half_up(wanted).cast("double")))
    turn = F.lit(degrees * 3.141592653589793 / 180)
    if landmarks is not None:
        eyes = F.atan2((landmarks[1]["y"] - landmarks[0]["y"]).cast("double"), (landmarks[1]["x"] - landmarks[0]["x"]).cast("double"))
        turn = turn + F.when((F.size(landmarks) >= 2) & ~F.isnan(eyes), eyes).otherwise(F.lit(0.0))
    k = side / wanted
    cx, cy = (d("x1") + d("x2")) / 2, (d("y1") + d("y2")) / 2 + vertical_offset * bh
    a, b = k * F.cos(turn), k * F.sin(turn)
    out = F.struct(a.alias("m00"), b.alias("m01"), (side / 2 - (a * cx + b * cy)).alias("tx"), (-b).alias("m10"), a.alias("m11"), (side / 2 - (a * cy - b * cx)).alias("ty"), side.cast("int").alias("side"))
    return F.when((bw > 0) & (bh > 0), out).otherwise(F.raise_error(F.lit("a face box without extent")).cast("struct<m00:double,m01:double,tx:double,m10:double,m11:double,ty:double,side:int>"))


def window_quad(window: Column) -> Column:
    """The window's corners LT, RT, RB, LB in image coordinates: the inverse similarity of its own corners."""
    a, b, tx, ty, s = (window[c] for c in ("m00", "m01", "tx", "ty", "side"))
    det = a * a + b * b
    at = lambda x, y: F.struct(((a * (x - tx) - b * (y - ty)) / det).cast("float").alias("x"), ((b * (x - tx) + a * (y - ty)) / det).cast("float").alias("y"))
    zero = F.lit(0.0)
    return F.array(at(zero, zero), at(s, zero), at(s, s), at(zero, s))
