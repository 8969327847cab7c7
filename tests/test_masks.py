"""Masks as runs, against arrays of pixels."""

import numpy as np
import pyarrow as pa
import pytest
from pyspark.sql import functions as F

from gaitline.operators import fragments, identity, masks, matching
from gaitline.sources import files, registry

KIND = pa.list_(pa.struct([("start", pa.int64()), ("len", pa.int32())]))
H, W = 9, 13


def runs(pixels):
    """Runs over the whole frame, which go on over the ends of rows."""
    edge = np.diff(np.concatenate(([0], pixels.ravel().astype(int), [0])))
    return [{"start": int(s), "len": int(e - s)} for s, e in zip(np.flatnonzero(edge == 1), np.flatnonzero(edge == -1))]


def random_masks(n, seed):
    rng = np.random.default_rng(seed)
    return [rng.random((H, W)) < p for p in rng.choice([0.0, 0.1, 0.3, 0.6, 1.0], n)]


def flood(pixels):
    left, n = {tuple(p) for p in np.argwhere(pixels)}, 0
    while left:
        n, todo = n + 1, [left.pop()]
        while todo:
            y, x = todo.pop()
            near = {(y + i, x + j) for i in (-1, 0, 1) for j in (-1, 0, 1)} & left
            left -= near
            todo += near
    return n


def test_shared_pixels_and_parts():
    a, b = random_masks(300, 1), random_masks(300, 2)
    ra, rb = (pa.array([runs(m) for m in x], KIND) for x in (a, b))
    assert masks.shared(ra, rb).tolist() == [int((x & y).sum()) for x, y in zip(a, b)]
    assert masks.parts(ra, np.full(300, W)).tolist() == [flood(m) for m in a]
    by_row = pa.array([files._runs_of(m) for m in a], KIND)
    assert masks.parts(by_row, np.full(300, W)).tolist() == [flood(m) for m in a]
    none = pa.array([[], None], KIND)
    assert masks.parts(none, np.full(2, W)).tolist() == [0, 0] and masks.shared(none, none).tolist() == [0, 0]


def test_holes_and_disjoint_parts():
    ring = np.ones((5, 5), bool)
    ring[1:4, 1:4] = False
    inner = np.zeros((5, 5), bool)
    inner[2, 2] = True
    corner = np.eye(5, dtype=bool)
    two = np.zeros((5, 5), bool)
    two[0], two[4] = True, True
    some = pa.array([files._runs_of(m) for m in (ring, ring | inner, corner, two)], KIND)
    assert masks.parts(some, np.full(4, 5)).tolist() == [1, 2, 1, 2]
    assert masks.shared(some.slice(0, 1), pa.array([files._runs_of(inner)], KIND)).tolist() == [0]  # boxes overlap, pixels don't


def table(spark, rows):
    return spark.createDataFrame(rows, "run string, id long, frame long, session long, h int, w int, rle array<struct<start:bigint,len:int>>")


def test_union_area_and_bounds(spark):
    pixels = random_masks(60, 3)
    df = table(spark, [("r", k % 6, k // 12, 0, H, W, files._runs_of(m)) for k, m in enumerate(pixels)])
    want = {}
    for k, m in enumerate(pixels):
        key = (k % 6) // 3, k // 12
        want[key] = want.get(key, np.zeros((H, W), bool)) | m
    canonical = spark.createDataFrame([("r", k, k // 3) for k in range(6)], "run string, id long, canonical long")
    got = {(r["id"], r["frame"]): [(x["start"], x["len"]) for x in r["rle"]] for r in fragments.merged_masks(df, canonical).collect()}
    assert got == {k: [(x["start"], x["len"]) for x in runs(m)] for k, m in want.items() if m.any()}
    box = masks.bounds(F.col("rle"), F.col("w"))
    for r in df.select("id", "frame", masks.area(F.col("rle")).alias("area"), box.alias("box"), "rle").collect():
        m = np.zeros(H * W, bool)
        for x in r["rle"]:
            m[x["start"] : x["start"] + x["len"]] = True
        m = m.reshape(H, W)
        assert r["area"] == m.sum()
        ys, xs = np.nonzero(m)
        assert (r["box"] is None) == (not len(ys)) and (r["box"] is None or tuple(r["box"]) == (xs.min(), ys.min(), xs.max() + 1, ys.max() + 1))


def test_identities_by_pixels(spark):
    one, other = np.zeros((H, W), bool), np.zeros((H, W), bool)
    one[0], other[:, 0] = True, True  # their boxes overlap, their pixels in a corner
    df = lambda rows: table(spark, [("r", k, f, 0, H, W, files._runs_of(m)) for k, f, m in rows])
    oracle, base = df([(1, 0, one), (2, 0, other), (1, 1, one)]), df([(7, 0, other), (8, 0, one), (7, 1, other)])
    got = {(r["frame"], r["oracle_id"]): r["baseline_id"] for r in identity.correspondence(oracle, base, pixels=True).collect()}
    assert got == {(0, 1): 8, (0, 2): 7, (1, 1): None}


def test_masks_from_images(spark, tmp_path):
    pixels = random_masks(4, 5)
    for k, m in enumerate(pixels):
        (tmp_path / str(k // 2)).mkdir(exist_ok=True)
        (tmp_path / str(k // 2) / f"{k % 2}.pgm").write_bytes(b"P5\n# made\n%d %d\n255\n" % (W, H) + (m.astype(np.uint8) * 200).tobytes())
    (tmp_path / "notes.txt").write_text("no image")
    got = {(r["id"], r["frame"]): (r["h"], r["w"], [x.asDict() for x in r["rle"]]) for r in files.mask_frames(spark, str(tmp_path)).collect()}
    assert got == {(k // 2, k % 2): (H, W, files._runs_of(m)) for k, m in enumerate(pixels)}
    (tmp_path / "0" / "9.pgm").write_bytes(b"P5 4 4 255 ")
    with pytest.raises(Exception, match="9.pgm"):
        files.mask_frames(spark, str(tmp_path)).collect()


def test_mask_folders(spark, tmp_path):
    assert files.mask_files(spark, str(tmp_path / "none")).count() == 0 and files.mask_frames(spark, str(tmp_path / "none")).count() == 0
    with pytest.raises(FileNotFoundError):
        files.mask_files(spark, str(tmp_path / "none"), required=True)
    (tmp_path / "x.txt").write_text("no mask")
    with pytest.raises(ValueError, match="mp4"):
        files.mask_files(spark, str(tmp_path), required=True)


def test_registry(spark):
    registry.register("three", lambda spark, folder, n=3: spark.range(n), replace=True)
    assert registry.build("three", spark, "").count() == 3 and registry.build("three", spark, "", n=5).count() == 5 and "three" in registry.names()
    for bad in (lambda: registry.build("four", spark, ""), lambda: registry.build("three", spark, "", m=1), lambda: registry.register("three", None)):
        with pytest.raises(ValueError):
            bad()


def test_solving_many_groups_at_once():
    rng = np.random.default_rng(8)
    rows = [(g, a, b, float(rng.integers(1, 1000)) / 1000) for g in range(120) for a in range(rng.integers(1, 6)) for b in range(rng.integers(1, 6)) if rng.random() < 0.6]
    group, a, b, score = (np.array(c) for c in zip(*rows))
    for how, limit in (("optimal", np.inf), ("greedy", 0.7)):
        got = matching.solve(group, a, b, score, how, limit)
        for g in range(120):
            here = [r for r in rows if r[0] == g]
            if not here:
                continue
            m = np.full((6, 6), np.inf if how == "greedy" else 0.0)
            for _, x, y, s in here:
                m[x, y] = s
            picked = {(x, y) for (_, x, y, _), k in zip(here, got[group == g]) if k}
            if how == "greedy":
                kept = sorted({x for _, x, _, _ in here})
                want = {(kept[r], c) for r, c in matching.greedy(m[kept], limit)}
                assert picked == want
            else:
                want = {(r, c) for r, c in matching.optimal(-m) if m[r, c] > 0}
                assert sum(m[p] for p in picked) == pytest.approx(sum(m[p] for p in want)) and len({x for x, _ in picked}) == len({y for _, y in picked}) == len(picked)
