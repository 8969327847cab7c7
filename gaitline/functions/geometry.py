"""Planar geometry as Column builders. A point is a struct with x and y; a missing number is NULL and stays NULL."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .skeleton import CLINICAL_ANGLES, CLINICAL_POINTS, HEAD, JOINT_ANGLES, KP, SIGNATURE


def point(x: Column, y: Column) -> Column:
    return F.struct(x.alias("x"), y.alias("y"))


def joint(kp: Column, name: str) -> Column:
    return kp[KP[name]]


def middle(a: Column, b: Column) -> Column:
    return point((a["x"] + b["x"]) / 2, (a["y"] + b["y"]) / 2)


def distance(a: Column, b: Column) -> Column:
    dx, dy = a["x"] - b["x"], a["y"] - b["y"]
    return F.sqrt(dx * dx + dy * dy)


def clip(x: Column, lo: float, hi: float) -> Column:
    """x within lo..hi; NULL stays NULL, though greatest() and least() skip it."""
    return F.when(x.isNotNull(), F.greatest(F.lit(lo), F.least(F.lit(hi), x)))


def _arms(a: Column, b: Column, c: Column) -> tuple[Column, Column]:
    ax, ay, cx, cy = a["x"] - b["x"], a["y"] - b["y"], c["x"] - b["x"], c["y"] - b["y"]
    return ax * cx + ay * cy, F.sqrt(ax * ax + ay * ay) * F.sqrt(cx * cx + cy * cy)


def angle_at(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b; NULL where an arm has no length."""
    dot, length = _arms(a, b, c)
    return F.when(length >= 1e-8, F.degrees(F.acos(clip(F.try_divide(dot, length), -1.0, 1.0))))


def angle_padded(a: Column, b: Column, c: Column) -> Column:
    """Degrees at b with a padded denominator: 90 where an arm has no length."""
    dot, length = _arms(a, b, c)
    return F.degrees(F.acos(clip(dot / (length + 1e-8), -1.0, 1.0)))


def joint_angles(kp: Column) -> dict[str, Column]:
    return {name: angle_at(*(joint(kp, x) for x in t)) for name, t in JOINT_ANGLES.items()}


def hip_center(kp: Column) -> Column:
    return middle(joint(kp, "left_hip"), joint(kp, "right_hip"))


def shoulder_center(kp: Column) -> Column:
    return middle(joint(kp, "left_shoulder"), joint(kp, "right_shoulder"))


def torso_length(kp: Column) -> Column:
    return distance(shoulder_center(kp), hip_center(kp))


def head_center(kp: Column) -> Column:
    """Mean of the head's present points, else the nose (which is then missing too)."""
    points = F.filter(F.array(*(joint(kp, n) for n in HEAD)), lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    mean = lambda axis: F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]), F.size(points))
    return point(mean("x"), mean("y"))


def self_touch(wrist: Column, head: Column, scale: Column) -> Column:
    """1 in contact, 0 from one scale unit on; NULL without a scale or a point."""
    near = 1.0 - F.try_divide(distance(wrist, head), scale)
    return F.when((scale >= 1e-6) & near.isNotNull(), F.greatest(F.lit(0.0), near))


def self_touch_now(kp: Column) -> Column:
    """The nearer wrist's score; a missing wrist doesn't count."""
    head, scale = head_center(kp), torso_length(kp)
    return F.greatest(*(self_touch(joint(kp, f"{s}_wrist"), head, scale) for s in ("left", "right")))


def padded_box(kp: Column, pad: float = 0.25, least: int = 4) -> Column:
    """Box of the present joints, widened by pad of its size each side; NULL with fewer than `least` joints or no extent."""
    points = F.filter(kp, lambda p: p["x"].isNotNull() & p["y"].isNotNull())
    xs, ys = F.transform(points, lambda p: p["x"]), F.transform(points, lambda p: p["y"])
    x1, x2, y1, y2 = F.array_min(xs), F.array_max(xs), F.array_min(ys), F.array_max(ys)
    w, h = x2 - x1, y2 - y1
    box = F.struct((x1 - pad * w).alias("x1"), (y1 - pad * h).alias("y1"), (x2 + pad * w).alias("x2"), (y2 + pad * h).alias("y2"))
    return F.when((F.size(points) >= least) & (w >= 1e-6) & (h >= 1e-6), box)


def head_radius(kp: Column) -> Column:
    """0.6 of the shoulders' width, 40 pixels where that is missing or nothing."""
    width = distance(joint(kp, "left_shoulder"), joint(kp, "right_shoulder"))
    return F.when(width >= 1e-3, 0.6 * width).otherwise(F.lit(40.0))


def confident(kp: Column, least: float = 0.3) -> Column:
    """The joints present with at least this confidence."""
    return F.filter(kp, lambda p: (p["conf"] >= least) & p["x"].isNotNull() & p["y"].isNotNull())


def face_region(kp: Column, width: int, height: int, least: float = 0.3) -> Column:
    """Square to blur around the head's confident points, clamped to the frame; NULL without any or off the frame."""
    points = confident(F.array(*(joint(kp, n) for n in HEAD)), least)
    mean = lambda axis: F.try_divide(F.aggregate(points, F.lit(0.0), lambda s, p: s + p[axis]), F.size(points)).cast("int")
    r = F.greatest(head_radius(kp).cast("int"), F.lit(10))
    x0, x1 = F.greatest(F.lit(0), mean("x") - r), F.least(F.lit(width), mean("x") + r)
    y0, y1 = F.greatest(F.lit(0), mean("y") - r), F.least(F.lit(height), mean("y") + r)
    return F.when((F.size(points) > 0) & (x1 > x0) & (y1 > y0), F.struct(x0.alias("x0"), y0.alias("y0"), x1.alias("x1"), y1.alias("y1")))


def hair_corners(kp: Column) -> list[Column]:
    """Four corners of the region above the ears, raised by the way from neck to nose; missing where a point is."""
    neck, nose, left, right = shoulder_center(kp), joint(kp, "nose"), joint(kp, "left_ear"), joint(kp, "right_ear")
    up_x, up_y = nose["x"] - neck["x"], nose["y"] - neck["y"]
    whole = (left["x"] + left["y"] + right["x"] + right["y"] + up_x + up_y).isNotNull()
    corners = [point(right["x"], right["y"]), point(left["x"], left["y"]), point(left["x"] + up_x, left["y"] + up_y), point(right["x"] + up_x, right["y"] + up_y)]
    return [F.when(whole, c) for c in corners]


# --- clinical features -------------------------------------------------------------------------------------------


def clinical_point(kp: Column, name: str) -> Column:
    if name == "neck":
        return shoulder_center(kp)
    if name == "mid_hip":
        return hip_center(kp)
    side, _, part = name.partition("_")
    return joint(kp, name if name == "nose" else f"{dict(l='left', r='right')[side]}_{part}")


def normalized(kp: Column) -> Column:
    """struct of CLINICAL_POINTS relative to the hips in torso lengths; NULL coordinates where the torso is missing or under 1e-3."""
    hip, torso = hip_center(kp), torso_length(kp)
    unit = F.when(torso >= 1e-3, torso)
    return F.struct(*(point(F.try_divide(clinical_point(kp, n)["x"] - hip["x"], unit), F.try_divide(clinical_point(kp, n)["y"] - hip["y"], unit)).alias(n) for n in CLINICAL_POINTS))


def derived(norm: Column) -> dict[str, Column]:
    """27 angles, distances, differences, centre and spread of normalized points."""
    p = {n: norm[n] for n in CLINICAL_POINTS}
    out = {name: angle_padded(*(p[x] for x in t)) for name, t in CLINICAL_ANGLES.items()}
    d = lambda a, b: distance(p[a], p[b])
    out |= {"eye_to_eye": d("l_eye", "r_eye"), "nose_to_neck": d("nose", "neck")}
    out |= {f"{s}_wrist_to_hip": d(f"{s}_wrist", "mid_hip") for s in "rl"}
    out |= {f"{s}_wrist_to_nose": d(f"{s}_wrist", "nose") for s in "rl"}
    out |= {name: (d(a, "l_ankle") + d(a, "r_ankle")) / 2 for name, a in (("nose_to_ankles", "nose"), ("hip_to_ankle", "mid_hip"))}
    out |= {f"{n}_y_diff": p[f"l_{n}"]["y"] - p[f"r_{n}"]["y"] for n in ("shoulder", "hip")}
    out |= {f"{n}_diff": out[f"l_{n}"] - out[f"r_{n}"] for n in ("elbow_angle", "knee_angle", "wrist_to_hip", "shoulder_angle")}
    out |= {f"com_{axis}": (p["mid_hip"][axis] + p["neck"][axis]) / 2 for axis in "xy"}
    for axis, names in (("x", ("l_wrist", "r_wrist", "l_ankle", "r_ankle")), ("y", ("nose", "l_ankle", "r_ankle"))):
        values = [p[n][axis] for n in names]
        out[f"body_spread_{axis}"] = F.greatest(*values) - F.least(*values)  # these skip what is missing
    return out


# --- identity signatures --------------------------------------------------------------------------------------------


def signature(kp: Column) -> Column:
    """Twelve body proportions in torso lengths, NULL where a joint is missing."""
    torso = torso_length(kp)
    unit = F.when(torso >= 1e-6, torso)
    return F.array(*(F.try_divide(distance(joint(kp, a), joint(kp, b)), unit) for a, b in SIGNATURE.values()))


def _both(a: Column, b: Column) -> Column:
    pairs = F.zip_with(a, b, lambda x, y: F.struct(x.alias("a"), y.alias("b")))
    return F.filter(pairs, lambda p: p["a"].isNotNull() & p["b"].isNotNull())


def signature_distance(a: Column, b: Column, least: int = 3) -> Column:
    """Root mean square over the dimensions present in both; NULL with fewer than `least`."""
    both = _both(a, b)
    total = F.aggregate(both, F.lit(0.0), lambda s, p: s + (p["a"] - p["b"]) * (p["a"] - p["b"]))
    return F.when(F.size(both) >= least, F.sqrt(total / F.size(both)))


def color_similarity(a: Column, b: Column) -> Column:
    """1 for equal (hue, saturation) triples, hue on a circle of length 1; NULL with fewer than 2 dimensions."""
    diffs = F.zip_with(a, b, lambda x, y: F.abs(x - y))
    dists = F.transform(diffs, lambda d, k: F.when(k % 2 == 0, F.least(d, 1.0 - d)).otherwise(d))
    held = F.filter(dists, lambda d: d.isNotNull())
    mean = F.try_divide(F.aggregate(held, F.lit(0.0), lambda s, d: s + d), F.size(held))
    return F.when(F.size(held) >= 2, clip(1.0 - mean, 0.0, 1.0))


def position_similarity(a: Column, b: Column, torso: Column, gap_s: Column, reach: float = 4.0, memory_s: float = 20.0) -> Column:
    """Linear decay over `reach` torso lengths times linear decay over memory_s; NULL without a point or scale."""
    away = F.try_divide(distance(a, b), torso)
    near = F.greatest(F.lit(0.0), 1.0 - away / reach) * F.greatest(F.lit(0.0), 1.0 - gap_s / memory_s)
    return F.when((torso >= 1e-6) & away.isNotNull() & gap_s.isNotNull(), near)


def dot(a: Column, b: Column) -> Column:
    return F.aggregate(F.zip_with(a, b, lambda x, y: x * y), F.lit(0.0), lambda s, x: s + x)


def embedding_similarity(a: Column, b: Column) -> Column:
    """Cosine of unit vectors moved to 0..1; NULL if either is missing."""
    return F.when(a.isNotNull() & b.isNotNull(), clip((dot(a, b) + 1.0) / 2.0, 0.0, 1.0))


def histogram_similarity(a: Column, b: Column) -> Column:
    """Intersection of histograms that sum to 1."""
    return clip(F.aggregate(F.zip_with(a, b, lambda x, y: F.least(x, y)), F.lit(0.0), lambda s, x: s + x), 0.0, 1.0)


def shape_descriptor(bbox: Column, area: Column, n_points: Column) -> tuple[Column, Column]:
    """(width to height, area to box); NULL for fewer than 3 points."""
    w, h = F.greatest(bbox["x2"] - bbox["x1"], F.lit(1e-6)), F.greatest(bbox["y2"] - bbox["y1"], F.lit(1e-6))
    return F.when(n_points >= 3, w / h), F.when(n_points >= 3, area / (w * h))


def shape_similarity(a: tuple[Column, Column], b: tuple[Column, Column]) -> Column:
    aspect = F.abs(a[0] - b[0]) / F.greatest(a[0], b[0], F.lit(1e-6))
    return clip(1.0 - (F.least(aspect, F.lit(1.0)) + F.abs(a[1] - b[1])) / 2.0, 0.0, 1.0)


def pose_pair_cost(proportions: Column, color: Column, position: Column, embedding: Column, weights: tuple[float, float, float] = (0.5, 0.5, 0.7)) -> tuple[Column, Column]:
    """(cost, signal used): the proportions' distance, lowered by the strongest of the weighted signals, never by several.

    Of equal signals the embedding counts before colour, and colour before position.
    """
    c, p, e = (F.coalesce(w * x, F.lit(0.0)) for w, x in zip(weights, (color, position, embedding)))
    best = F.greatest(c, p, e)
    used = F.when(proportions.isNull() | (best == 0), F.lit(None)).when(best == e, F.lit("embedding")).when(best == c, F.lit("color")).otherwise(F.lit("position"))
    return proportions * (1.0 - best), used


def seg_pair_score(position: Column, color: Column, shape: Column, embedding: Column, weights: tuple[float, ...] = (0.5, 0.3, 0.2, 0.7)) -> Column:
    """Weighted sum of the signals; a missing one counts 0."""
    total = F.lit(0.0)
    for w, x in zip(weights, (position, color, shape, embedding)):
        total = total + w * F.coalesce(x, F.lit(0.0))
    return total


def fragment_similarity(embedding: Column, histogram: Column) -> Column:
    """The stronger of both; 0 without either."""
    return F.coalesce(F.greatest(embedding, histogram), F.lit(0.0))


# --- polygons, boxes, masks --------------------------------------------------------------------------------------------


def polygon_centroid(poly: Column) -> Column:
    """Mean of the vertices; NULL coordinates for none."""
    mean = lambda axis: F.try_divide(F.aggregate(poly, F.lit(0.0), lambda s, p: s + p[axis]), F.size(poly))
    return point(mean("x"), mean("y"))


def polygon_area(poly: Column) -> Column:
    """Shoelace area; 0 for fewer than 3 vertices."""
    turned = F.concat(F.slice(poly, 2, F.greatest(F.size(poly) - 1, F.lit(0))), F.slice(poly, 1, 1))
    cross = F.zip_with(poly, turned, lambda p, q: p["x"] * q["y"] - q["x"] * p["y"])
    return F.when(F.size(poly) >= 3, F.abs(F.aggregate(cross, F.lit(0.0), lambda s, x: s + x)) / 2.0).otherwise(F.lit(0.0))


def polygon_box(poly: Column) -> Column:
    """Bounding box; zeros for an empty polygon."""
    of = lambda f, axis: F.coalesce(f(F.transform(poly, lambda p: p[axis])), F.lit(0.0))
    return F.struct(of(F.array_min, "x").alias("x1"), of(F.array_min, "y").alias("y1"), of(F.array_max, "x").alias("x2"), of(F.array_max, "y").alias("y2"))


def box_polygon(box: Column) -> Column:
    c = [("x1", "y1"), ("x2", "y1"), ("x2", "y2"), ("x1", "y2")]
    return F.array(*(point(box[x], box[y]) for x, y in c))


def shift(poly: Column, dx: Column, dy: Column) -> Column:
    return F.transform(poly, lambda p: point(p["x"] + dx, p["y"] + dy))


def touches_border(poly: Column, height: int, width: int, margin: int = 1) -> Column:
    """Whether the polygon's box comes within `margin` of the frame; false for an empty one."""
    b = polygon_box(poly)
    return (F.size(poly) > 0) & ((b["x1"] <= margin) | (b["y1"] <= margin) | (b["x2"] >= width - 1 - margin) | (b["y2"] >= height - 1 - margin))


def box_iou(a: Column, b: Column, names: tuple[str, str, str, str] = ("x0", "y0", "x1", "y1"), border: int = 0) -> Column:
    """Overlap of boxes; border 0: half open, 1: both edges are pixels of the box. 0 where the union is nothing."""
    x0, y0, x1, y1 = names
    side = lambda lo, hi: F.greatest(F.lit(0.0), (hi - lo + border).cast("double"))
    inter = side(F.greatest(a[x0], b[x0]), F.least(a[x1], b[x1])) * side(F.greatest(a[y0], b[y0]), F.least(a[y1], b[y1]))
    union = side(a[x0], a[x1]) * side(a[y0], a[y1]) + side(b[x0], b[x1]) * side(b[y0], b[y1]) - inter
    return F.coalesce(F.try_divide(inter, F.when(union > 0, union)), F.lit(0.0))


def xywh_to_xyxy(x: Column, y: Column, w: Column, h: Column, width: int, height: int) -> Column:
    """Corners in pixels; values that are all at most 1.5 are shares of the frame."""
    sx = F.when(F.greatest(x, y, w, h) <= 1.5, F.lit(float(width))).otherwise(F.lit(1.0))
    sy = F.when(F.greatest(x, y, w, h) <= 1.5, F.lit(float(height))).otherwise(F.lit(1.0))
    return F.struct((x * sx).alias("x1"), (y * sy).alias("y1"), ((x + w) * sx).alias("x2"), ((y + h) * sy).alias("y2"))


def padded_crop(box: Column, width: int, height: int, padding: float = 0.15) -> Column:
    """Whole-pixel crop around a box, truncated toward 0 and clamped to the frame."""
    w, h = box["x2"] - box["x1"], box["y2"] - box["y1"]
    return F.struct(
        F.greatest(F.lit(0), (box["x1"] - w * padding).cast("int")).alias("x1"),
        F.greatest(F.lit(0), (box["y1"] - h * padding).cast("int")).alias("y1"),
        F.least(F.lit(width), (box["x2"] + w * padding).cast("int")).alias("x2"),
        F.least(F.lit(height), (box["y2"] + h * padding).cast("int")).alias("y2"),
    )


#: Least crop of a person in pixels, least share of it that a mask must fill to be used.
LEAST_CROP, LEAST_FILL = (24, 48), 0.15


def person_crop(box: Column, width: int, height: int, fill: Column) -> Column:
    """struct(x1, y1, x2, y2, masked): whole-pixel crop, rounded half to even and clamped to the frame; NULL under LEAST_CROP.

    fill: share of the crop that the person's mask covers; masked tells whether what lies outside it is to be blacked out.
    """
    at = lambda c, most: F.greatest(F.lit(0), F.least(F.lit(most), F.rint(box[c]).cast("int")))
    x1, x2, y1, y2 = at("x1", width), at("x2", width), at("y1", height), at("y2", height)
    big = (x2 - x1 >= LEAST_CROP[0]) & (y2 - y1 >= LEAST_CROP[1])
    return F.when(big, F.struct(x1.alias("x1"), y1.alias("y1"), x2.alias("x2"), y2.alias("y2"), F.coalesce(fill >= LEAST_FILL, F.lit(False)).alias("masked")))


def track_color(track_id: Column, palette: int = 8) -> Column:
    return F.pmod(track_id, F.lit(palette))
