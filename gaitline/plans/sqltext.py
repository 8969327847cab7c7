"""DuckDB SQL of the adapters and of the geometry, for the queries' equivalents. A point is a pair of SQL expressions."""

from __future__ import annotations

from gaitline.functions.skeleton import CLINICAL_ANGLES, CLINICAL_POINTS, KP
from gaitline.sources.adapters import CHUNK, FPS, HEIGHT, WIDTH

SIG = "sig AS (SELECT CAST(floor(user_id / 20) AS BIGINT) AS session, user_id AS track_id, row_number() OVER (PARTITION BY user_id ORDER BY ts, event_id) - 1 AS frame, event_id, value AS v FROM events)"
_JOINTS = ", ".join(
    f"CASE WHEN (event_id + {k}) % 23 <> 0 THEN CAST((event_id * {7 + 2 * k} + track_id * 13) % {WIDTH} AS DOUBLE) END AS x{k}, "
    f"CASE WHEN (event_id + {k}) % 23 <> 0 THEN CAST((event_id * {11 + 3 * k} + track_id * 5) % {HEIGHT} AS DOUBLE) END AS y{k}, "
    f"CAST((event_id * {3 + k}) % 100 AS DOUBLE) / 100 AS c{k}"
    for k in range(17)
)
KPW = f"{SIG}, kpw AS (SELECT session, track_id, frame, frame / {FPS}e0 AS t_s, event_id, {_JOINTS} FROM sig)"
DET = """det AS (SELECT frame, det, x1, y1, x1 + w AS x2, y1 + h AS y2, w, h, conf FROM (
  SELECT l_orderkey AS frame, row_number() OVER (PARTITION BY l_orderkey ORDER BY l_linenumber, l_partkey, l_suppkey, l_extendedprice, l_shipdate, l_quantity, l_discount, l_tax) AS det,
  CAST(l_partkey % 560 AS DOUBLE) AS x1, CAST((l_suppkey * 7) % 400 AS DOUBLE) AS y1, CAST(20 + CAST(floor(l_quantity) AS INT) AS DOUBLE) AS w, CAST(30 + 10 * l_linenumber AS DOUBLE) AS h, abs(l_discount) * 10 AS conf FROM lineitem))"""
_X, _Y = (f"[{', '.join(f'{axis}{k}' for k in range(17))}]" for axis in "xy")
_CELL = "SELECT *, track_id % 20 AS o, ((track_id % 20) // 2 % 5) * 128 AS lx, ((track_id % 20) // 10) * 240 AS ty, frame // {chunk} AS c FROM sig".format(chunk=CHUNK)
_PLACED = f"SELECT *, lx + 12 + (event_id * 7) % 40 AS x, ty + 20 + (event_id * 11) % 90 AS y, 30 + (event_id * 13) % 31 AS w, 60 + (event_id * 17) % 51 AS h FROM ({_CELL})"
#: Both runs, all overlaps of a frame, and the assignment. At most two people of each run share a part of the image, which
#: no other's box reaches, so the best of both ways to match them is the optimum of the frame.
RUNS = f"""{SIG}, pl AS MATERIALIZED ({_PLACED}),
ora AS MATERIALIZED (SELECT session, frame, o AS id, o // 2 AS cell, x AS bx0, y AS by0, x + w AS bx1, y + h AS by1, c FROM pl),
bas AS MATERIALIZED (SELECT session, frame, o // 2 AS cell, CASE WHEN c % 4 = 3 AND o % 2 = 1 THEN ((o + 1) % 20) * 10 + 7 WHEN c % 4 = 2 AND o % 2 = 0 THEN o * 10 + 7 ELSE o * 10 + c % 3 END AS id,
  CASE WHEN far THEN lx ELSE mx END AS bx0, CASE WHEN far THEN ty ELSE my END AS by0, CASE WHEN far THEN lx + 30 ELSE mx + w - event_id % 7 END AS bx1, CASE WHEN far THEN ty + 50 ELSE my + h - event_id % 11 END AS by1
  FROM (SELECT *, event_id % 13 = 5 AS far, x + (event_id * 5) % 25 - 12 AS mx, y + (event_id * 3) % 41 - 20 AS my FROM pl WHERE event_id % 17 <> 3)),
hit AS (SELECT a.session, a.frame, a.cell, a.id AS oracle_id, b.id AS baseline_id, CAST((least(a.bx1, b.bx1) - greatest(a.bx0, b.bx0)) * (least(a.by1, b.by1) - greatest(a.by0, b.by0)) AS DOUBLE) AS i, (a.bx1 - a.bx0) * (a.by1 - a.by0) + (b.bx1 - b.bx0) * (b.by1 - b.by0) AS s
  FROM ora a JOIN bas b ON a.session = b.session AND a.frame = b.frame WHERE a.bx0 < b.bx1 AND b.bx0 < a.bx1 AND a.by0 < b.by1 AND b.by0 < a.by1),
iou AS MATERIALIZED (SELECT session, frame, cell, oracle_id, baseline_id, i / (s - i) AS iou, dense_rank() OVER (PARTITION BY session, frame, cell ORDER BY oracle_id) AS r, dense_rank() OVER (PARTITION BY session, frame, cell ORDER BY baseline_id) AS k FROM hit),
way AS (SELECT session, frame, cell, coalesce(sum(iou) FILTER (r = k), 0) >= coalesce(sum(iou) FILTER (r <> k), 0) - 1e-11 AS straight FROM iou GROUP BY session, frame, cell),
met AS (SELECT i.session, i.frame, oracle_id, baseline_id, iou FROM iou i JOIN way w ON i.session = w.session AND i.frame = w.frame AND i.cell = w.cell WHERE (r = k) = straight AND iou >= 1e-1),
corr AS MATERIALIZED (SELECT o.session, o.frame, o.id AS oracle_id, m.baseline_id, m.iou, bx0, by0, bx1, by1 FROM ora o LEFT JOIN met m ON m.session = o.session AND m.frame = o.frame AND m.oracle_id = o.id)"""

#: The masks of both runs as pixels.
PIXELS = f"""bx AS (SELECT run, session, id, frame, (frame + id) % 3 AS kind, bx0 // 8 AS x0, by0 // 8 AS y0, bx1 // 8 AS x1, by1 // 8 AS y1 FROM (SELECT 'oracle' AS run, session, id, frame, bx0, by0, bx1, by1 FROM ora UNION ALL SELECT 'baseline', session, id, frame, bx0, by0, bx1, by1 FROM bas)),
bxy AS (SELECT *, unnest(generate_series(y0, y1 - 1)) AS y FROM bx WHERE x1 > x0 AND y1 > y0), bxx AS (SELECT *, unnest(generate_series(x0, x1 - 1)) AS x FROM bxy),
px AS MATERIALIZED (SELECT run, session, id, frame, x, y, y * {WIDTH // 8} + x AS p FROM bxx WHERE NOT (kind = 2 AND (y = y0 + 3 OR y = y0 + 4)) AND NOT (kind = 1 AND x1 - x0 > 2 AND y > y0 AND y < y1 - 1 AND x > x0 AND x < x1 - 1))"""

Point = tuple[str, str]


def joint(name: str) -> Point:
    return f"x{KP[name]}", f"y{KP[name]}"


def mid(a: Point, b: Point) -> Point:
    return f"(({a[0]} + {b[0]}) / 2)", f"(({a[1]} + {b[1]}) / 2)"


def dist(a: Point, b: Point) -> str:
    dx, dy = f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})"
    return f"sqrt({dx} * {dx} + {dy} * {dy})"


def clip(x: str, lo: float, hi: float) -> str:
    return f"(CASE WHEN {x} IS NOT NULL THEN greatest({lo}e0, least({hi}e0, {x})) END)"


def _arms(a: Point, b: Point, c: Point) -> tuple[str, str]:
    ax, ay, cx, cy = f"({a[0]} - {b[0]})", f"({a[1]} - {b[1]})", f"({c[0]} - {b[0]})", f"({c[1]} - {b[1]})"
    return f"({ax} * {cx} + {ay} * {cy})", f"(sqrt({ax} * {ax} + {ay} * {ay}) * sqrt({cx} * {cx} + {cy} * {cy}))"


def angle(a: Point, b: Point, c: Point) -> str:
    d, n = _arms(a, b, c)
    return f"(CASE WHEN {n} >= 1e-8 THEN degrees(acos(greatest(-1e0, least(1e0, {d} / {n})))) END)"


def angle_padded(a: Point, b: Point, c: Point) -> str:
    d, n = _arms(a, b, c)
    return f"degrees(acos({clip(f'({d} / ({n} + 1e-8))', -1.0, 1.0)}))"


HIP, SHOULDER = mid(joint("left_hip"), joint("right_hip")), mid(joint("left_shoulder"), joint("right_shoulder"))
TORSO = dist(SHOULDER, HIP)


def clinical(name: str) -> Point:
    if name in ("neck", "mid_hip"):
        return SHOULDER if name == "neck" else HIP
    side, _, part = name.partition("_")
    return joint(name if name == "nose" else f"{dict(l='left', r='right')[side]}_{part}")


def clinical_derived() -> dict[str, str]:
    """Over columns <point>_x and <point>_y."""
    p = {n: (f"{n}_x", f"{n}_y") for n in CLINICAL_POINTS}
    out = {n: angle_padded(*(p[x] for x in t)) for n, t in CLINICAL_ANGLES.items()}
    d = lambda a, b: dist(p[a], p[b])
    out |= {"eye_to_eye": d("l_eye", "r_eye"), "nose_to_neck": d("nose", "neck")}
    out |= {f"{s}_wrist_to_{n}": d(f"{s}_wrist", "mid_hip" if n == "hip" else n) for n in ("hip", "nose") for s in "rl"}
    out |= {"nose_to_ankles": f"(({d('nose', 'l_ankle')} + {d('nose', 'r_ankle')}) / 2)", "hip_to_ankle": f"(({d('mid_hip', 'l_ankle')} + {d('mid_hip', 'r_ankle')}) / 2)"}
    out |= {f"{n}_y_diff": f"(l_{n}_y - r_{n}_y)" for n in ("shoulder", "hip")}
    out |= {f"{n}_diff": f"({out[f'l_{n}']} - {out[f'r_{n}']})" for n in ("elbow_angle", "knee_angle", "wrist_to_hip", "shoulder_angle")}
    out |= {f"com_{a}": f"((mid_hip_{a} + neck_{a}) / 2)" for a in "xy"}
    for a, names in (("x", ("l_wrist", "r_wrist", "l_ankle", "r_ankle")), ("y", ("nose", "l_ankle", "r_ankle"))):
        v = ", ".join(f"{n}_{a}" for n in names)
        out[f"body_spread_{a}"] = f"(greatest({v}) - least({v}))"
    return out
