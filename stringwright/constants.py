"""Word lists, vocabularies and model constants."""

# Type names with a processing rule of their own.
FEATURE_TYPES = [
    "coordinate", "day", "email", "filepath", "month", "numerical", "ordinal",
    "sentence", "url", "zipcode",
]
BOOLEAN_TYPES = ["boolean", "gender"]
DATE_TYPES = ["date-iso-8601", "date-eu"]
NUMERIC_TYPES = ["integer", "float"]

# Texts that stand for a missing value.
NA_TOKENS = ["", "-", "?", "NA", "N/A", "n/a", "nan", "NaN", "null", "NULL", "None"]

# Vocabularies of the two enumerated types.
BOOLEAN_WORDS = [
    "yes", "no", "Yes", "No", "YES", "NO", "true", "false", "True", "False",
    "TRUE", "FALSE", "y", "n", "Y", "N", "t", "f", "T",
]
GENDER_WORDS = [
    "M", "F", "m", "f", "male", "female", "Male", "Female", "MALE", "FEMALE",
    "man", "woman", "Man", "Woman",
]

# Effective alphabet size of each recogniser (smaller = more specific).
ALPHABET = {
    "integer": 10, "float": 11, "date-iso-8601": 10, "date-eu": 10, "numerical": 20,
    "month": 8, "day": 5, "coordinate": 12, "zipcode": 30, "url": 45, "email": 40,
    "filepath": 50, "ordinal": 30, "sentence": 60, "string": 72,
}

# Mixture of the three explanations of a value.
STOP_PROBABILITY = 1e-4
WEIGHT_TYPE = 0.98
WEIGHT_MISSING = 0.01
WEIGHT_ANOMALY = 0.01
ANOMALY_ALPHABET = 256
ANOMALY_PENALTY = 10.0

# Column names that hint at unordered / ordered categories.
NOMINAL_NAMES = [
    "address", "age", "area", "category", "city", "code", "color", "colour", "country",
    "gender", "group", "location", "mode", "name", "nationality", "place", "post", "race",
    "role", "sex", "type", "zip",
]
ORDINAL_NAMES = [
    "stage", "phase", "rating", "level", "size", "rank", "order", "grade", "opinion",
    "scale", "degree", "year",
]

# Words that hint at ordered categories; repeated words count twice.
ORDINAL_KEYWORDS = [
    "probably", "hardly", "scarcely", "minutely", "vaguely", "barely", "slightly",
    "moderately", "pretty", "strongly", "very", "intensely", "immensely", "extremely",
    "absolutely", "infinitely", "unlimitedly", "completely", "ultimately", "much", "many",
    "a lot", "plenty", "numerous",
    "agree", "neutral", "low", "medium", "high", "good", "better", "best", "bad", "worse",
    "worst", "much", "many", "more", "most", "far", "less", "lesser", "least", "well",
    "better", "best",
]

# Month -> (number, days); February always has 28.
MONTHS = {
    "jan": (1, 31), "feb": (2, 28), "mar": (3, 31), "apr": (4, 30), "may": (5, 31),
    "jun": (6, 30), "jul": (7, 31), "aug": (8, 31), "sep": (9, 30), "oct": (10, 31),
    "nov": (11, 30), "dec": (12, 31),
}

# Cardinal and ordinal number words.
NUMBER_WORDS = {
    "one": 1, "two": 2, "three": 3, "four": 4, "five": 5, "six": 6, "seven": 7, "eight": 8,
    "nine": 9, "ten": 10, "eleven": 11, "twelve": 12, "thirteen": 13, "fourteen": 14,
    "fifteen": 15, "sixteen": 16, "seventeen": 17, "eighteen": 18, "nineteen": 19,
    "twenty": 20, "thirty": 30, "forty": 40, "fifty": 50, "sixty": 60, "seventy": 70,
    "eighty": 80, "ninety": 90, "hundred": 100, "thousand": 1000, "million": 1000000,
    "billion": 1000000000,
}
IRREGULAR_ORDINALS = {
    "first": "one", "second": "two", "third": "three", "fifth": "five", "eighth": "eight",
    "ninth": "nine", "twelfth": "twelve",
}

# Decision thresholds.
MISSING_ROWS_RATIO = 0.05
MCAR_P_VALUE = 0.05
RARE_FREQUENCY = 0.025
DISTINCT_RATIO = 0.8
NGRAM_JACCARD = 0.75
REPAIR_RATIO = 0.05
KEYWORD_SHARE = 0.2
BALANCE_RATIO = 0.5
LOW_CARDINALITY = 30
HIGH_CARDINALITY = 100
EMBEDDING_SCALE = 0.6
EMBEDDING_DIMS = 50
MINHASH_SIZE = 30
GAP_TOPICS = 10
