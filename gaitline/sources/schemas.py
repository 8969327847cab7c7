"""Declared schemas of the source tables; missing numbers are NULL, never NaN."""

from __future__ import annotations

from pyspark.sql import types as T


def _struct(**fields: T.DataType) -> T.StructType:
    return T.StructType([T.StructField(k, v) for k, v in fields.items()])


D, I, L, S = T.DoubleType(), T.IntegerType(), T.LongType(), T.StringType()  # noqa: E741
POINT = _struct(x=D, y=D)
JOINT = _struct(x=D, y=D, conf=D)
BBOX = _struct(x1=D, y1=D, x2=D, y2=D)
#: Half open, as rows y0..y1-1 and columns x0..x1-1.
MASK_BOX = _struct(y0=I, y1=I, x0=I, x1=I)
RUN = _struct(start=L, len=I)

KEYPOINTS = _struct(session=S, frame=I, t_s=D, track_id=L, kp=T.ArrayType(JOINT))
DETECTIONS = _struct(session=S, frame=I, t_s=D, track_id=L, bbox=BBOX, poly=T.ArrayType(POINT), conf=D)
MASKS = _struct(run=S, id=L, frame=I, h=I, w=I, box=MASK_BOX, rle=T.ArrayType(RUN))
RUNS = _struct(run=S, total_frames=I, chunk_size=I, overlap=I)
FRAMES = _struct(session=S, frame=I, t_s=D)
FACES = _struct(session=S, frame=I, face_idx=I, lm=T.ArrayType(POINT), rot=T.ArrayType(D))
HANDS = _struct(session=S, frame=I, hand_idx=I, handedness=S, lm=T.ArrayType(POINT))
EMBEDDINGS = _struct(session=S, frame=I, track_id=L, vec=T.ArrayType(D))
HISTOGRAMS = _struct(session=S, frame=I, track_id=L, hue=T.ArrayType(D))
CHUNK_OUT = _struct(run=S, chunk=I, local_frame=I, pos=I, local_id=L, box=MASK_BOX)

ALL = {
    "keypoints": KEYPOINTS, "detections": DETECTIONS, "masks": MASKS, "runs": RUNS, "frames": FRAMES, "faces": FACES,
    "hands": HANDS, "embeddings": EMBEDDINGS, "histograms": HISTOGRAMS, "chunk_out": CHUNK_OUT,
}
