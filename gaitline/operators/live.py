"""The live row: every windowed signal of a track in one pass, the same in batch and in a stream.

Dense signals (the body) have a value for each frame; sparse ones (face, hands, touch) are kept for the last frames that have
them. What a row needs of the past is a bounded history, so a stream goes on where the last batch ended.
"""

from __future__ import annotations

from collections.abc import Sequence
from dataclasses import dataclass

import numpy as np
import pyarrow as pa
from numpy.lib.stride_tricks import sliding_window_view
from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

from gaitline.functions import geometry as G
from gaitline.functions.skeleton import COCO17, KP

from .motion import TRACK
from .ordered import whole
from .spectral import peaks

SIDES = ("left", "right")
#: Signals that go in: one value a frame, NULL where missing; `pose` has x and y of all joints.
SPARSE = ("touch", "yaw", "pitch", "mouth_ratio", "eye_ratio")
SIGNALS = (*SPARSE, "hip_y", "torso", "face", *(f"{s}_tip_{a}" for s in SIDES for a in "xy"))
#: Columns that come out.
FEATURES = (
    "movement_energy", "activity_ratio", "peak_freq_hz", "peak_power_ratio", "vertical_excursion", "self_touch_ratio", "blink_rate_per_min",
    *(f"{n}_rep_{k}" for n in ("mouth", "yaw", "pitch", "left_hand", "right_hand") for k in ("freq_hz", "power_ratio")),
)
SCHEMA = ", ".join(f"{n} double" for n in FEATURES) + ", full boolean"


@dataclass(frozen=True)
class Window:
    """rows: frames of a window; thresholds of energy, touch and closed eyes."""

    rows: int
    fps: float
    window_s: float
    activity: float = 40.0
    touch: float = 0.5
    blink: float = 0.2

    def fresh(self) -> dict[str, np.ndarray]:
        """The history of a track that has not been seen."""
        pairs = {f"{s}_tip": np.zeros((0, 2)) for s in SIDES}
        return {"pose": np.zeros((0, 2 * len(COCO17))), "hip_y": np.zeros(0), "torso": np.zeros(0), **{k: np.zeros(0) for k in SPARSE}, **pairs}

    def step(self, new: dict[str, np.ndarray], past: dict[str, np.ndarray]) -> tuple[dict[str, np.ndarray], dict[str, np.ndarray]]:
        """(FEATURES and full of each new frame, history after them); new: SIGNALS and pose, frames in order."""
        m, rows, n_past = len(new["hip_y"]), self.rows, len(past["pose"])
        out = {k: np.full(m, np.nan) for k in FEATURES}
        pose = np.concatenate((past["pose"], new["pose"]))
        full = np.arange(n_past, n_past + m) >= rows - 1
        later = {"pose": pose[-(rows - 1) :]}
        dense = {k: np.concatenate((past[k], new[k])) for k in ("hip_y", "torso")}
        later |= {k: v[-(rows - 1) :] for k, v in dense.items()}
        if full.any():
            last = np.flatnonzero(full) + n_past
            moved = np.diff(pose.reshape(len(pose), -1, 2), axis=0) * self.fps
            speed = np.sqrt((moved * moved).sum(2))
            energy = (speed * speed).sum(1)
            wrists = (speed[:, KP["left_wrist"]] + speed[:, KP["right_wrist"]]) / 2
            # the steps inside a window: one fewer than its frames
            steps, wrist_steps = (sliding_window_view(v, rows - 1)[last - rows + 1] for v in (energy, wrists))
            out["movement_energy"][full] = _mean(steps)
            out["activity_ratio"][full] = _mean(np.where(np.isnan(steps), np.nan, steps > self.activity))
            out["peak_freq_hz"][full], out["peak_power_ratio"][full] = peaks(wrist_steps, self.fps)
            hips, torsos = (sliding_window_view(v, rows)[last - rows + 1] for v in (dense["hip_y"], dense["torso"]))
            held = ~np.isnan(hips).all(1)
            span = np.full(len(last), np.nan)
            span[held] = np.nanmax(hips[held], 1) - np.nanmin(hips[held], 1)
            size = _mean(np.where(torsos > 1e-6, torsos, np.nan))
            out["vertical_excursion"][full] = np.divide(span, size, out=np.full(len(last), np.nan), where=size > 0)
        for name in SPARSE:
            seen = np.flatnonzero(~np.isnan(new[name]))
            kept = np.concatenate((past[name], new[name][seen]))
            later[name] = kept[-rows:]
            # frames without the signal see the window of the last one that has it
            upto = len(past[name]) + np.cumsum(~np.isnan(new[name]))
            ready = np.flatnonzero(upto >= rows)
            if not len(ready):
                continue
            windows, which = np.unique(upto[ready] - rows, return_inverse=True)
            held = sliding_window_view(kept, rows)[windows]
            if name == "touch":
                out["self_touch_ratio"][ready] = (held > self.touch).mean(1)[which]
            elif name == "eye_ratio":
                shut = held < self.blink
                out["blink_rate_per_min"][ready] = ((~shut[:, :-1] & shut[:, 1:]).sum(1) / self.window_s * 60)[which]
            else:
                freq, share = peaks(held, self.fps)
                short = name.removesuffix("_ratio")
                out[f"{short}_rep_freq_hz"][ready], out[f"{short}_rep_power_ratio"][ready] = freq[which], share[which]
        for side in SIDES:
            at = np.stack([new[f"{side}_tip_{a}"] for a in "xy"], 1)
            seen = np.flatnonzero(~np.isnan(at).any(1))
            kept = np.concatenate((past[f"{side}_tip"], at[seen]))
            later[f"{side}_tip"] = kept[-rows:]
            ready = np.flatnonzero(len(past[f"{side}_tip"]) + np.arange(1, len(seen) + 1) >= rows)
            if len(ready):
                moved = np.diff(kept, axis=0)
                speed = np.sqrt((moved * moved).sum(1)) * self.fps
                held = sliding_window_view(speed, rows - 1)[len(past[f"{side}_tip"]) + ready - rows + 1]
                out[f"{side}_hand_rep_freq_hz"][seen[ready]], out[f"{side}_hand_rep_power_ratio"][seen[ready]] = peaks(held, self.fps)
        # a face's windows are told where there is a face
        for k in ("blink_rate_per_min", *(f"{n}_rep_{x}" for n in ("mouth", "yaw", "pitch") for x in ("freq_hz", "power_ratio"))):
            out[k][np.isnan(new["face"])] = np.nan
        out["full"] = full
        return out, later


def _mean(x: np.ndarray) -> np.ndarray:
    """Mean of the present values of each row."""
    held = ~np.isnan(x)
    return np.divide(np.where(held, x, 0.0).sum(1), held.sum(1), out=np.full(len(x), np.nan), where=held.any(1))


def signals(df: DataFrame, *keep: str) -> DataFrame:
    """The columns to keep, pose and SIGNALS of rows with kp, yaw, pitch, mouth_ratio, eye_ratio, left_tip and right_tip (points), NULL
    where there is no face or hand; a face is there where any of its signals is.
    """
    kp = F.col("kp")
    pose = F.flatten(F.transform(kp, lambda p: F.array(p["x"], p["y"])))
    given: dict[str, Column] = {"touch": G.self_touch_now(kp), "hip_y": G.hip_center(kp)["y"], "torso": G.torso_length(kp), "face": F.coalesce("yaw", "pitch", "mouth_ratio", "eye_ratio")}
    given |= {n: F.col(n) for n in SPARSE if n != "touch"} | {f"{s}_tip_{a}": F.col(f"{s}_tip")[a] for s in SIDES for a in "xy"}
    return df.select(*keep, pose.alias("pose"), *(given[n].cast("double").alias(n) for n in SIGNALS))


def columns(table: pa.Table | pa.RecordBatch) -> dict[str, np.ndarray]:
    """SIGNALS and pose of a table as arrays, NaN where missing."""
    out = {n: np.array(table.column(n).to_numpy(zero_copy_only=False) if isinstance(table, pa.RecordBatch) else table.column(n).to_numpy(), np.float64) for n in SIGNALS}
    flat = table.column("pose")
    flat = flat.combine_chunks() if isinstance(flat, pa.ChunkedArray) else flat
    return out | {"pose": np.array(flat.flatten().to_numpy(zero_copy_only=False), np.float64).reshape(len(table.column("pose")), -1)}


def windowed(df: DataFrame, window: Window, keys: Sequence[str] = TRACK, order: str = "frame", keep: Sequence[str] = ()) -> DataFrame:
    """keys, order, the columns to keep, FEATURES and full of signals()' rows; a track has to fit a task.

    One sort; tracks are worked on many to a batch. Missing values are NULL.
    """
    kinds = dict(df.dtypes)
    first = [*keys, order, *keep]

    def run(table: pa.Table, starts: np.ndarray) -> pa.Table:
        values = columns(table)
        ends = np.append(starts[1:], table.num_rows)
        parts = [window.step({k: v[s:e] for k, v in values.items()}, window.fresh())[0] for s, e in zip(starts.tolist(), ends.tolist())]
        out = table.select(first)
        for n in FEATURES:
            v = np.concatenate([p[n] for p in parts])
            out = out.append_column(n, pa.array(v, mask=np.isnan(v)))
        return out.append_column("full", pa.array(np.concatenate([p["full"] for p in parts])))

    return whole(df.select(*first, "pose", *SIGNALS), keys, [order], run, ", ".join(f"`{c}` {kinds[c]}" for c in first) + f", {SCHEMA}")
