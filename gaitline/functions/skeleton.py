"""The keypoint vocabulary, fixed values of two kinds.

Values of published layouts: COCO17, BLAZEPOSE_OF_COCO, and the landmark numbers of HAND_TIPS, HAND_CURLS, WRIST and MIDDLE_KNUCKLE.
Values that results are required to have, as they name output columns or decide what these measure: HEAD, LIMBS,
JOINT_ANGLES, SIGNATURE, CLINICAL_POINTS, CLINICAL_ANGLES and CLINICAL_MOVING.
"""

from __future__ import annotations

COCO17 = (
    "nose", "left_eye", "right_eye", "left_ear", "right_ear", "left_shoulder", "right_shoulder", "left_elbow", "right_elbow",
    "left_wrist", "right_wrist", "left_hip", "right_hip", "left_knee", "right_knee", "left_ankle", "right_ankle",
)
KP = {name: k for k, name in enumerate(COCO17)}
HEAD = ("nose", "left_eye", "right_eye", "left_ear", "right_ear")
LIMBS = ("shoulder", "elbow", "wrist", "hip", "knee", "ankle")

#: Joint angles: (first, vertex, last).
JOINT_ANGLES = {
    "left_elbow_angle": ("left_shoulder", "left_elbow", "left_wrist"),
    "right_elbow_angle": ("right_shoulder", "right_elbow", "right_wrist"),
    "left_knee_angle": ("left_hip", "left_knee", "left_ankle"),
    "right_knee_angle": ("right_hip", "right_knee", "right_ankle"),
    "left_shoulder_angle": ("left_hip", "left_shoulder", "left_elbow"),
    "right_shoulder_angle": ("right_hip", "right_shoulder", "right_elbow"),
}

#: Body proportions of an identity signature: segment -> its two joints.
SIGNATURE = {
    "shoulder_width": ("left_shoulder", "right_shoulder"), "hip_width": ("left_hip", "right_hip"),
    "upper_arm_l": ("left_shoulder", "left_elbow"), "upper_arm_r": ("right_shoulder", "right_elbow"),
    "forearm_l": ("left_elbow", "left_wrist"), "forearm_r": ("right_elbow", "right_wrist"),
    "thigh_l": ("left_hip", "left_knee"), "thigh_r": ("right_hip", "right_knee"),
    "shin_l": ("left_knee", "left_ankle"), "shin_r": ("right_knee", "right_ankle"),
    "eye_to_eye": ("left_eye", "right_eye"), "ear_to_ear": ("left_ear", "right_ear"),
}

#: Landmark of the 33-point layout for each joint of the 17.
BLAZEPOSE_OF_COCO = (0, 2, 5, 7, 8, 11, 12, 13, 14, 15, 16, 23, 24, 25, 26, 27, 28)

#: Clinical points (r_/l_ names), their angles and the points with time derivatives.
CLINICAL_POINTS = (
    "nose", "neck", "mid_hip", "r_shoulder", "l_shoulder", "r_elbow", "l_elbow", "r_wrist", "l_wrist", "r_hip", "l_hip",
    "r_knee", "l_knee", "r_ankle", "l_ankle", "r_eye", "l_eye", "r_ear", "l_ear",
)
CLINICAL_ANGLES = {
    "r_elbow_angle": ("r_shoulder", "r_elbow", "r_wrist"), "l_elbow_angle": ("l_shoulder", "l_elbow", "l_wrist"),
    "r_shoulder_angle": ("neck", "r_shoulder", "r_elbow"), "l_shoulder_angle": ("neck", "l_shoulder", "l_elbow"),
    "r_knee_angle": ("r_hip", "r_knee", "r_ankle"), "l_knee_angle": ("l_hip", "l_knee", "l_ankle"),
    "r_hip_angle": ("mid_hip", "r_hip", "r_knee"), "l_hip_angle": ("mid_hip", "l_hip", "l_knee"),
    "trunk_angle": ("nose", "neck", "mid_hip"),
}
CLINICAL_MOVING = ("com", "nose", "l_wrist", "r_wrist", "l_ankle", "r_ankle", "neck", "mid_hip")

#: Hand landmarks: tips, and (first, vertex, last) of each finger's curl.
HAND_TIPS = (4, 8, 12, 16, 20)
HAND_CURLS = {"thumb": (2, 3, 4), "index": (5, 6, 8), "middle": (9, 10, 12), "ring": (13, 14, 16), "pinky": (17, 18, 20)}
WRIST, MIDDLE_KNUCKLE = 0, 9
