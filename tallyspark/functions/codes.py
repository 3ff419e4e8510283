"""Fixed code lists and names.

FIXED VALUES: these must equal the label codes and class names used by the
labelled data (manner-of-collision codes, crash-category codes), so they are
stated here plainly, in natural order.
"""

# Manner of collision: code -> name (3, 7, 8 unused).
MANCOLL_NAMES = {
    0: "Not Collision with Vehicle in Transport",
    1: "Rear-End",
    2: "Head-On",
    4: "Angle",
    5: "Sideswipe, Same Direction",
    6: "Sideswipe, Opposite Direction",
    9: "Unknown",
}
MANCOLL_CODES = [0, 1, 2, 4, 5, 6, 9]
UNKNOWN_CODE = 9

# Class index of a 7-way classifier -> manner-of-collision code.
INDEX_TO_MANCOLL = {3: 4, 4: 5, 5: 6, 6: 9}

# Crash category: code -> short name (9 = unclassifiable).
CRASHCAT_NAMES = {
    1: "Single Driver",
    2: "Same Trafficway, Same Direction",
    3: "Same Trafficway, Opposite Direction",
    4: "Changing Trafficway, Vehicle Turning",
    5: "Intersecting Paths (Vehicle Damage)",
    6: "Miscellaneous",
}
CRASHCAT_UNKNOWN = 9

# Letters that turn into two-digit numbers when parsing a crash-type answer.
SYMBOL_LETTERS = {"A": 10, "B": 11, "C": 12, "D": 13}

# Phrase that replaces references to the vehicle being classified.
FOCUS_TEXT = "the vehicle to be classified"

# File-name prefix of prediction runs; a trailing "-<digits>" is the run id.
RUN_FILE_PREFIX = "bert_test_results_"

# Noise levels (percent) of the label-noise experiments.
NOISE_LEVELS = [5, 10, 15, 20, 30, 40, 70]

# Training-set sizes of the small-sample learning curve.
SWEEP_SIZES = [200, 400, 600]

# FIXED VALUES: column names that prediction files use, per canonical column.
PRED_ALIASES = {
    "summary": ["SUMMARY", "summary"],
    "gt": ["MANCOLL", "mancoll", "label", "labels"],
    "pred": ["collision_type", "pred", "prediction", "output"],
}

# FIXED VALUES: summaries of the metric rows at the end of a prediction file.
METRIC_ROWS = ["METRICS (ALL)", "METRICS (EXCL 9)"]
