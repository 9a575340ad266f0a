"""Fixed values.

Everything here has to equal the published model constants for results to be
right, so it is stated plainly and in its natural order.
"""

from __future__ import annotations

# -- glucose units ----------------------------------------------------------
MGDL_PER_MMOL = 18.0182
AXIS_MGDL_PER_MMOL = 18.0

# -- insulin kinetics: onset, peak, duration, half life (minutes) ------------
INSULIN = {
    "bolus": {"onset": 15.0, "peak": 75.0, "duration": 240.0, "half_life": 55.0},
    "basal": {"onset": 90.0, "peak": 360.0, "duration": 1440.0, "half_life": 300.0},
}

# -- glycaemic index keywords, first hit in this order wins -------------------
GI_KEYWORDS = [
    ("bread", 75), ("rice", 73), ("potato", 78), ("sugar", 100), ("glucose", 100),
    ("candy", 85), ("soda", 90), ("juice", 80), ("cereal", 75), ("pasta", 55),
    ("oatmeal", 58), ("fruit", 55), ("banana", 62), ("pizza", 60), ("beans", 30),
    ("lentils", 28), ("nuts", 20), ("vegetables", 15), ("dairy", 35), ("apple", 38),
    ("default", 60), ("mixed", 55),
]
GI_MODIFIERS = [
    ("whole grain", 50), ("wholegrain", 50), ("white", 70), ("fiber", 45), ("fibre", 45),
]
GI_DEFAULT = 60

# -- alcohol: absorption half life (min), sensitivity modifier, effect (h) ----
DRINKS = {
    "beer": {"half_life": 20.0, "modifier": 0.85, "effect_hours": 12.0},
    "wine": {"half_life": 25.0, "modifier": 0.8, "effect_hours": 14.0},
    "spirit": {"half_life": 15.0, "modifier": 0.75, "effect_hours": 16.0},
    "mixed": {"half_life": 25.0, "modifier": 0.8, "effect_hours": 12.0},
}
GRAMS_PER_UNIT = 10.0
ELIMINATION_GRAMS_PER_HOUR = 8.0
BODY_WATER_FACTOR = 0.6
REFERENCE_WEIGHT_KG = 70.0

# -- circadian tables, index = local hour ------------------------------------
CIRCADIAN_BASE = [
    0.95, 0.9, 0.85, 0.85, 0.9, 1.0, 1.15, 1.2, 1.15, 1.1, 1.0, 1.0,
    1.05, 1.0, 0.95, 0.95, 1.0, 1.05, 1.1, 1.05, 1.0, 0.95, 0.9, 0.95,
]
DAWN_EFFECT = [
    0.0, 0.0, 0.0, 0.2, 0.5, 0.8, 1.0, 0.8, 0.4, 0.1, 0.0, 0.0,
    0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0, 0.0,
]
OVERNIGHT_WEIGHTS = {4: 0.15, 5: 0.2, 6: 0.25, 7: 0.2, 8: 0.1}

# -- user parameters when a subject has none of its own -----------------------
USER_DEFAULTS = {
    "insulin_to_carb_ratio": 10.0,
    "correction_factor": 2.0,
    "target_bsl": 6.0,
    "body_weight_kg": 70.0,
}

# -- history kept before a prediction window opens (hours) --------------------
LOOKBACK_HOURS = {"insulin": 24, "meal": 6, "bsl": 12}

# -- event vocabulary ---------------------------------------------------------
EVENT_TYPES = ["meal", "insulin", "bsl", "exercise"]
INSULIN_TYPES = ["bolus", "basal"]
BSL_UNITS = ["mmol/L", "mg/dL"]
INTENSITIES = ["low", "moderate", "high"]

# -- trend codes 1..7 ---------------------------------------------------------
TRENDS = [
    "rising-fast", "rising", "rising-slow", "stable",
    "falling-slow", "falling", "falling-fast",
]

# -- food category keywords, first group in this order wins -------------------
CATEGORY_KEYWORDS = [
    ("grain", ["bread", "rice", "pasta", "cereal"]),
    ("protein", ["chicken", "beef", "fish", "egg"]),
    ("dairy", ["milk", "cheese", "yogurt"]),
    ("fruit", ["apple", "banana", "orange", "fruit"]),
    ("vegetable", ["carrot", "broccoli", "salad", "vegetable"]),
    ("fat", ["oil", "butter", "cream"]),
    ("beverage", ["soda", "juice", "coffee", "tea"]),
    ("snack", ["cookie", "chip", "candy", "snack"]),
]

# -- serving shapes: height ratio, volume multiplier --------------------------
SHAPES = {
    "flat": (0.1, 1.0),
    "dome": (0.4, 0.67),
    "pile": (0.6, 0.5),
    "bowl": (0.8, 0.85),
    "cylinder": (1.0, 1.0),
    "irregular": (0.35, 0.6),
}
SHAPE_KEYWORDS = [
    ("flat", ["pizza", "sandwich", "toast", "bread", "pancake", "flatbread"]),
    ("dome", ["rice", "mash", "potato", "pasta", "noodle", "oatmeal"]),
    ("pile", ["chip", "fries", "salad", "veg", "fruit", "berr"]),
    ("bowl", ["soup", "stew", "curry", "cereal", "yogurt"]),
]
DEFAULT_PIXELS_PER_MM = 3.0

# -- CGM export files ---------------------------------------------------------
LIBRE_MARKERS = [
    "freestyle libre", "libre", "historic glucose", "scan glucose", "device timestamp",
]
DEXCOM_MARKERS = ["dexcom", "egv", "transmitter", "glucose value (mg/dl)"]
LIBRE_COLUMNS = {
    "timestamp": ["Device Timestamp", "Timestamp", "Time"],
    "mmol": ["Historic Glucose mmol/L", "Glucose Value (mmol/L)", "Scan Glucose mmol/L"],
    "mgdl": ["Historic Glucose mg/dL", "Glucose Value (mg/dL)", "Scan Glucose mg/dL"],
    "record_type": ["Record Type"],
    "device": ["Device", "Device Type"],
}
LIBRE_RECORD_TYPES = ["0", "1"]
DEXCOM_COLUMNS = {
    "timestamp": ["Timestamp (YYYY-MM-DDThh:mm:ss)", "Timestamp", "Time"],
    "mgdl": ["Glucose Value (mg/dL)", "Glucose Value", "EGV Value"],
    "mmol": ["Glucose Value (mmol/L)"],
    "record_type": ["Event Type"],
    "device": ["Transmitter ID", "Transmitter"],
}
DEXCOM_RECORD_TYPES = ["EGV", "egv", "Calibration", "calibration"]
MAPPING_PATTERNS = {
    "timestamp": ["timestamp", "time", "date", "datetime", "device timestamp", "reading time"],
    "value": ["glucose", "value", "reading", "bg", "blood glucose", "bsl", "blood sugar"],
    "unit": ["unit", "units"],
    "device": ["device", "meter", "source"],
}

# -- traced graphs: value digits and confidence per device --------------------
GRAPH_PROFILES = {
    "freestyle-libre": {"digits": 1, "confidence": 0.85},
    "dexcom": {"digits": 0, "confidence": 0.82},
    "local": {"digits": 1, "confidence": 0.8},
}
DEFAULT_VALUE_RANGES = {
    "freestyle-libre": ("mmol/L", 2.2, 13.3),
    "dexcom": ("mg/dL", 40.0, 400.0),
    "medtronic": ("mg/dL", 40.0, 400.0),
    "generic": ("mmol/L", 2.0, 15.0),
}

# -- food dimension: id, name, category, g/ml, then per gram kcal, carbs, protein, fat
FOODS = [
    ("rice-white-cooked", "White Rice (cooked)", "grains", 1.1, 1.3, 0.28, 0.027, 0.003),
    ("rice-brown-cooked", "Brown Rice (cooked)", "grains", 1.05, 1.11, 0.23, 0.026, 0.009),
    ("pasta-cooked", "Pasta (cooked)", "grains", 1.15, 1.31, 0.25, 0.05, 0.011),
    ("bread-white", "White Bread", "grains", 0.35, 2.65, 0.49, 0.09, 0.033),
    ("bread-whole-wheat", "Whole Wheat Bread", "grains", 0.38, 2.47, 0.41, 0.13, 0.041),
    ("oatmeal-cooked", "Oatmeal (cooked)", "grains", 1.0, 0.68, 0.12, 0.025, 0.014),
    ("potato-mashed", "Mashed Potato", "grains", 1.1, 0.83, 0.15, 0.019, 0.021),
    ("potato-roasted", "Roasted Potato", "grains", 0.9, 1.01, 0.21, 0.023, 0.01),
    ("chips-hot", "Hot Chips / Fries", "grains", 0.55, 3.12, 0.41, 0.034, 0.15),
    ("noodles-cooked", "Noodles (cooked)", "grains", 1.1, 1.38, 0.25, 0.047, 0.021),
    ("chicken-breast", "Chicken Breast (cooked)", "proteins", 1.1, 1.65, 0.0, 0.31, 0.036),
    ("chicken-thigh", "Chicken Thigh (cooked)", "proteins", 1.05, 2.09, 0.0, 0.26, 0.109),
    ("beef-steak", "Beef Steak (cooked)", "proteins", 1.15, 2.71, 0.0, 0.26, 0.18),
    ("beef-mince", "Beef Mince (cooked)", "proteins", 1.0, 2.5, 0.0, 0.26, 0.15),
    ("pork-chop", "Pork Chop (cooked)", "proteins", 1.1, 2.31, 0.0, 0.27, 0.133),
    ("fish-white", "White Fish (cooked)", "proteins", 1.05, 1.05, 0.0, 0.22, 0.012),
    ("fish-salmon", "Salmon (cooked)", "proteins", 1.08, 2.08, 0.0, 0.2, 0.133),
    ("egg-whole", "Egg (whole, cooked)", "proteins", 1.03, 1.55, 0.011, 0.126, 0.109),
    ("tofu", "Tofu", "proteins", 1.05, 0.76, 0.019, 0.08, 0.048),
    ("beans-kidney", "Kidney Beans (cooked)", "proteins", 1.08, 1.27, 0.225, 0.087, 0.005),
    ("lentils-cooked", "Lentils (cooked)", "proteins", 1.05, 1.16, 0.2, 0.09, 0.004),
    ("broccoli", "Broccoli", "vegetables", 0.4, 0.34, 0.07, 0.028, 0.004),
    ("carrots-cooked", "Carrots (cooked)", "vegetables", 0.9, 0.35, 0.082, 0.008, 0.002),
    ("peas", "Green Peas", "vegetables", 0.75, 0.81, 0.143, 0.054, 0.004),
    ("corn", "Corn Kernels", "vegetables", 0.72, 0.96, 0.21, 0.032, 0.014),
    ("spinach-cooked", "Spinach (cooked)", "vegetables", 0.85, 0.23, 0.036, 0.029, 0.003),
    ("lettuce", "Lettuce", "vegetables", 0.1, 0.15, 0.029, 0.013, 0.002),
    ("tomato", "Tomato", "vegetables", 0.95, 0.18, 0.039, 0.009, 0.002),
    ("capsicum", "Capsicum / Bell Pepper", "vegetables", 0.5, 0.26, 0.06, 0.01, 0.002),
    ("mushrooms", "Mushrooms", "vegetables", 0.45, 0.22, 0.033, 0.031, 0.003),
    ("onion-cooked", "Onion (cooked)", "vegetables", 0.85, 0.44, 0.104, 0.013, 0.002),
    ("zucchini", "Zucchini", "vegetables", 0.6, 0.17, 0.031, 0.012, 0.003),
    ("apple-diced", "Apple (diced)", "fruits", 0.65, 0.52, 0.138, 0.003, 0.002),
    ("banana-sliced", "Banana (sliced)", "fruits", 0.95, 0.89, 0.228, 0.011, 0.003),
    ("berries-mixed", "Mixed Berries", "fruits", 0.6, 0.43, 0.097, 0.01, 0.003),
    ("grapes", "Grapes", "fruits", 0.65, 0.69, 0.181, 0.007, 0.002),
    ("orange-segments", "Orange (segments)", "fruits", 0.85, 0.47, 0.118, 0.009, 0.001),
    ("mango-diced", "Mango (diced)", "fruits", 0.8, 0.6, 0.15, 0.008, 0.004),
    ("watermelon", "Watermelon", "fruits", 0.6, 0.3, 0.076, 0.006, 0.002),
    ("pineapple", "Pineapple", "fruits", 0.75, 0.5, 0.131, 0.005, 0.001),
    ("milk", "Milk (whole)", "dairy", 1.03, 0.61, 0.049, 0.032, 0.033),
    ("yogurt-plain", "Yogurt (plain)", "dairy", 1.05, 0.61, 0.047, 0.035, 0.033),
    ("yogurt-greek", "Greek Yogurt", "dairy", 1.08, 0.97, 0.036, 0.09, 0.05),
    ("cheese-cheddar", "Cheddar Cheese", "dairy", 1.1, 4.03, 0.013, 0.249, 0.331),
    ("cheese-mozzarella", "Mozzarella", "dairy", 1.0, 3.0, 0.022, 0.22, 0.224),
    ("cream", "Cream (heavy)", "dairy", 0.98, 3.4, 0.028, 0.021, 0.365),
    ("ice-cream", "Ice Cream", "dairy", 0.55, 2.07, 0.239, 0.035, 0.11),
    ("pizza-slice", "Pizza", "mixed", 0.6, 2.66, 0.33, 0.11, 0.103),
    ("burger-patty", "Burger (with bun)", "mixed", 0.75, 2.95, 0.24, 0.17, 0.14),
    ("sandwich", "Sandwich (typical)", "mixed", 0.5, 2.32, 0.29, 0.13, 0.08),
    ("stir-fry", "Stir Fry (mixed)", "mixed", 0.85, 1.2, 0.08, 0.1, 0.06),
    ("curry", "Curry (with sauce)", "mixed", 1.0, 1.5, 0.08, 0.12, 0.09),
    ("soup-thick", "Soup (thick/creamy)", "mixed", 1.02, 0.75, 0.08, 0.03, 0.035),
    ("soup-broth", "Soup (broth based)", "mixed", 1.0, 0.35, 0.05, 0.02, 0.01),
    ("salad-mixed", "Mixed Salad", "mixed", 0.3, 0.2, 0.035, 0.012, 0.003),
    ("fried-rice", "Fried Rice", "mixed", 1.0, 1.63, 0.24, 0.043, 0.059),
    ("sushi-roll", "Sushi Roll", "mixed", 0.9, 1.5, 0.27, 0.06, 0.025),
    ("chips-packet", "Potato Chips (packet)", "snacks", 0.12, 5.36, 0.53, 0.065, 0.345),
    ("popcorn", "Popcorn", "snacks", 0.03, 3.87, 0.78, 0.125, 0.044),
    ("nuts-mixed", "Mixed Nuts", "snacks", 0.55, 6.07, 0.21, 0.2, 0.54),
    ("chocolate", "Chocolate", "snacks", 1.3, 5.46, 0.598, 0.049, 0.31),
    ("cookie", "Cookie", "snacks", 0.5, 4.88, 0.64, 0.052, 0.236),
    ("cake", "Cake (typical)", "snacks", 0.4, 3.57, 0.51, 0.043, 0.156),
    ("crackers", "Crackers", "snacks", 0.15, 4.84, 0.65, 0.095, 0.21),
    ("sauce-tomato", "Tomato Sauce", "sauces", 1.05, 0.82, 0.178, 0.016, 0.004),
    ("sauce-cream", "Cream Sauce", "sauces", 1.0, 1.5, 0.06, 0.025, 0.13),
    ("gravy", "Gravy", "sauces", 1.05, 0.47, 0.068, 0.019, 0.015),
    ("hummus", "Hummus", "sauces", 1.1, 1.66, 0.144, 0.078, 0.096),
    ("mayonnaise", "Mayonnaise", "sauces", 0.95, 6.8, 0.006, 0.01, 0.75),
]
