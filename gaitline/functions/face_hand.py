"""Head, face and hand signals as Column builders over landmark arrays."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F

from .geometry import angle_at, clip, distance
from .skeleton import HAND_CURLS, HAND_TIPS, MIDDLE_KNUCKLE, WRIST

#: Landmark numbers of the published 478-point face layout. An eye: corner, top, top, corner, bottom, bottom.
MOUTH = (13, 14, 61, 291)
RIGHT_EYE, LEFT_EYE = (33, 160, 158, 133, 153, 144), (362, 385, 387, 263, 373, 380)
RIGHT_BROW, LEFT_BROW = (70, 63, 105, 66, 107), (336, 296, 334, 293, 300)
FOV, TOLERANCE = 60.0, 20.0


def euler(rot: Column) -> dict[str, Column]:
    """yaw, pitch, roll in degrees of a row-major 3x3 rotation."""
    r = lambda i, j: rot[3 * i + j]
    flat = F.sqrt(r(0, 0) * r(0, 0) + r(1, 0) * r(1, 0))
    single = flat < 1e-6
    return {
        "yaw": F.degrees(F.when(single, F.lit(0.0)).otherwise(F.atan2(r(1, 0), r(0, 0)))),
        "pitch": F.degrees(F.atan2(-r(2, 0), flat)),
        "roll": F.degrees(F.when(single, F.atan2(-r(1, 2), r(1, 1))).otherwise(F.atan2(r(2, 1), r(2, 2)))),
    }


def rotation(yaw: Column, pitch: Column, roll: Column) -> Column:
    """Row-major 3x3 rotation of angles in degrees; inverse of euler()."""
    (cy, sy), (cp, sp), (cr, sr) = ((F.cos(F.radians(x)), F.sin(F.radians(x))) for x in (yaw, pitch, roll))
    return F.array(cy * cp, cy * sp * sr - sy * cr, cy * sp * cr + sy * sr, sy * cp, sy * sp * sr + cy * cr, sy * sp * cr - cy * sr, -sp, cp * sr, cp * cr)


def bearing(head_x: Column, target_x: Column, width: float, fov: float = FOV) -> Column:
    return (target_x - head_x) / (width / 2.0) * (fov / 2.0)


def joint_attention(head_x: Column, yaw: Column, target_x: Column, width: float, fov: float = FOV, tolerance: float = TOLERANCE) -> Column:
    off = F.abs(yaw - bearing(head_x, target_x, width, fov))
    return F.when(off.isNotNull(), F.greatest(F.lit(0.0), 1.0 - off / tolerance))


def _over(a: Column, b: Column) -> Column:
    return F.try_divide(a, F.when(b >= 1e-6, b))


def mouth_ratio(lm: Column) -> Column:
    top, bottom, left, right = (lm[k] for k in MOUTH)
    return _over(distance(top, bottom), distance(left, right))


def eye_ratio(lm: Column, eye: tuple[int, ...]) -> Column:
    a, t1, t2, c, b2, b1 = (lm[k] for k in eye)
    return _over((distance(t1, b1) + distance(t2, b2)) / 2.0, distance(a, c))


def mean_eye_ratio(lm: Column) -> Column:
    left, right = eye_ratio(lm, LEFT_EYE), eye_ratio(lm, RIGHT_EYE)
    return F.when(left.isNull(), right).when(right.isNull(), left).otherwise((left + right) / 2.0)


def interocular(lm: Column) -> Column:
    return distance(lm[RIGHT_EYE[0]], lm[LEFT_EYE[0]])


def brow_raise(lm: Column, brow: tuple[int, ...], eye: tuple[int, ...]) -> Column:
    height = sum((lm[k]["y"] for k in brow[1:]), lm[brow[0]]["y"]) / float(len(brow))
    return _over((lm[eye[1]]["y"] + lm[eye[2]]["y"]) / 2.0 - height, interocular(lm))


def face_signals(lm: Column) -> dict[str, Column]:
    return {"mouth_ratio": mouth_ratio(lm), "eye_ratio": mean_eye_ratio(lm), "left_eyebrow_raise": brow_raise(lm, LEFT_BROW, LEFT_EYE), "right_eyebrow_raise": brow_raise(lm, RIGHT_BROW, RIGHT_EYE)}


def finger_curls(lm: Column) -> dict[str, Column]:
    return {f"{name}_curl": angle_at(*(lm[k] for k in t)) for name, t in HAND_CURLS.items()}


def hand_openness(lm: Column) -> Column:
    """0 for a fist, 1 for an open hand; NULL without a palm."""
    reach = sum((distance(lm[WRIST], lm[k]) for k in HAND_TIPS[1:]), distance(lm[WRIST], lm[HAND_TIPS[0]])) / float(len(HAND_TIPS))
    return clip(_over(reach, distance(lm[WRIST], lm[MIDDLE_KNUCKLE])) - 1.0, 0.0, 1.0)
