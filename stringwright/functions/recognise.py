"""Recognisers: what a single text looks like.

Every pattern is matched against the whole text. ``PATTERNS`` is shared with the
reference SQL of the checks, so only constructs known to both Java and RE2 appear
(the sentence rule, which needs a look-behind in Java, is the one exception).
"""

from __future__ import annotations

from pyspark.sql import Column

from stringwright import constants as K

# Letters and signs allowed in sentences besides word characters.
SENTENCE_EXTRA = (
    "áéíóúýàèìòùäëïöüÿâêîôûãñõÁÉÍÓÚÝÀÈÌÒÙÄËÏÖÜŸÂÊÎÔÛÃÑÕŠšŽž$¢£€¥¤©®™—–’“”`~@#%'\"¡¿"
)
SENTENCE_WORD = r"[\w&.,;:?!/\-\s()" + SENTENCE_EXTRA + "]"
SENTENCE_GAP = r"[\s+.,;:?!%—–]"

# Letters before the digits of a British postcode.
UK_AREAS = [
    "AB", "AL", "B", "BA", "BB", "BD", "BH", "BL", "BN", "BR", "BS", "BT", "CA", "CB", "CF", "CH", "CM", "CO",
    "CR", "CT", "CV", "CW", "DA", "DD", "DE", "DG", "DH", "DL", "DN", "DT", "DY", "E", "EC", "EH", "EN", "EX",
    "FK", "FY", "G", "GL", "GY", "GU", "HA", "HD", "HG", "HP", "HR", "HS", "HU", "HX", "IG", "IM", "IP", "IV",
    "JE", "KA", "KT", "KW", "KY", "L", "LA", "LD", "LE", "LL", "LN", "LS", "LU", "M", "ME", "MK", "ML", "N", "NE",
    "NG", "NN", "NP", "NR", "NW", "OL", "OX", "PA", "PE", "PH", "PL", "PO", "PR", "RG", "RH", "RM", "S", "SA",
    "SE", "SG", "SK", "SL", "SM", "SN", "SO", "SP", "SR", "SS", "ST", "SW", "SY", "TA", "TD", "TF", "TN", "TQ",
    "TR", "TS", "TW", "UB", "W", "WA", "WC", "WD", "WF", "WN", "WR", "WS", "WV", "YO", "ZE",
]
UK_INWARD = r"\d[\dA-Z]? ?\d[ABD-HJLN-UW-Z]{2}"

# National postal code formats.
ZIP_FORMATS = [
    "GIR ?0AA",
    "(?:" + "|".join(UK_AREAS) + ")" + UK_INWARD,
    r"BFPO ?\d{1,4}",
    r"(?:JE|GY|IM)" + UK_INWARD,
    r"[ABCEGHJKLMNPRSTVXY]\d[ABCEGHJ-NPRSTV-Z] ?\d[ABCEGHJ-NPRSTV-Z]\d",
    r"\d{4} ?[A-Z]{2}",
    r"AD\d{3}",
    r"[A-HJ-NP-Z]?\d{4}(?:[A-Z]{3})?",
    r"BB\d{5}",
    r"[A-Z]{2} ?[A-Z0-9]{2}",
    "BBND 1ZZ",
    r"[A-Z]{2} ?\d{4}",
    r"[A-Z]\d{4}[A-Z]",
    r"[A-Z]{2}\d{6}",
    r"[A-Z]{3} ?\d{2,4}",
    r"(?:PC )?\d{3}",
    "FIQQ 1ZZ",
    "SIQQ 1ZZ",
    "PCRN 1ZZ",
    "(?:ASCN|STHL) 1ZZ",
    r"[HLMS]\d{3}",
    "TKCA 1ZZ",
    r"\d{3}[A-Z]{2}\d{3}",
]

_LATITUDE = r"[NSZ](?:[0-8]?[0-9](?:[.:][0-5]\d){2}|90(?:[.:]00){2})"
_LONGITUDE = r"[EOW](?:(?:\d{1,2}|0\d\d|1[0-7]\d)(?:[.:][0-5]\d){2}|180(?:[.:]00){2})"
_DMS = r"(?:(?: *\d{1,2}(?:[.,]\d+)?(?:\*|°|º|\\?'|\"|´|:|d|m|s) *){3}[NSZEOW] *){1,2}"

_PATH = r"[\w.\-\\/\[\]() ]"
_PATH_NAME = r"[\w.\-\[\]() ]"

# One pattern per type.
PATTERNS = {
    "integer": r"[+\-]?\d+",
    "float": r"[+\-]?(?:\d+\.\d*|\.\d+)(?:[eE][+\-]?\d+)?",
    "date-iso-8601": (
        r"\d{4}-(?:0[1-9]|1[0-2])-(?:0[1-9]|[12]\d|3[01])(?:[T ]\d{2}:\d{2}(?::\d{2})?)?"
    ),
    "date-eu": r"(?:0?[1-9]|[12]\d|3[01])[/.\-](?:0?[1-9]|1[0-2])[/.\-]\d{4}",
    "coordinate": rf"{_LATITUDE}\s?(?:{_LONGITUDE})?|\s?{_LONGITUDE}|{_DMS}",
    "day": (
        r"(?:[Mm]on|[Tt]ues|[Ww]ednes|[Tt]hurs|[Ff]ri|[Ss]atur|[Ss]un)(?:day)?"
        r"|[Mm]o|[Tt]ue?|[Ww]ed?|[Tt]hu?|[Ff]r|[Ss]at?|[Ss]u"
    ),
    "email": r"[a-zA-Z0-9_.+\-]+@[a-zA-Z0-9\-]+\.[a-zA-Z0-9\-.]+",
    "filepath": rf"(?:[a-zA-Z]:[\\/])?(?:[\\/]{_PATH}+|{_PATH_NAME}+[\\/]{_PATH}*)",
    "month": (
        r"(?:'?\d{1,4}[,.\-_ ]*)?"
        r"(?:[Jj]an(?:uary)?|[Ff]eb(?:ruary)?|[Mm]ar(?:ch)?|[Aa]pr(?:il)?|[Mm]ay|[Jj]une?|[Jj]uly?"
        r"|[Aa]ug(?:ust)?|[Ss]ep(?:tember)?|[Oo]ct(?:ober)?|(?:[Nn]ov|[Dd]ec)(?:ember)?)"
        r"(?:[,.\-_ ']*\d{1,4})?(?:, \d{1,4})?"
    ),
    "numerical": (
        r"[0-9]+ ?(?:[\-+_/:;&'(to)]|to) ?[0-9]+"
        r"|(?:[<>$#@%=]+|(?:[Ll]ess|[Ll]ower|[Gg]reater|[Hh]igher) than"
        r"|[Uu]nder|[Bb]elow|[Oo]ver|[Aa]bove)[ \-]?[0-9]+"
        r"|[0-9]+ ?[<>+$%=]+"
    ),
    "ordinal": r"[\s\w\-]+(?:st|nd|rd|th)",
    "url": (
        r"(?:(?:https?|ftp)://)?[a-zA-Z0-9\-.]+\.[a-zA-Z]{2,3}(?::[a-zA-Z0-9]*)?/?"
        r"[a-zA-Z0-9\-._?,/\\+&;%$#=~]*"
    ),
    "zipcode": "|".join(ZIP_FORMATS),
    "string": r"[@#]*[a-zA-Z0-9 .,\\\-_%:;&]+ ?",
}

# A run of five (words, gap) pairs. Starting only where a run of word characters starts
# and never giving back what was consumed keeps the match linear in the text.
SENTENCE_RULE = rf"(?<!{SENTENCE_WORD})(?>{SENTENCE_WORD}+?{SENTENCE_GAP}\+*){{5}}"

WORD_LISTS = {"boolean": K.BOOLEAN_WORDS, "gender": K.GENDER_WORDS}

TYPES = sorted([*PATTERNS, *WORD_LISTS, "sentence"])


def whole(pattern: str) -> str:
    """Anchor a pattern to the complete text, line breaks included."""
    return rf"\A(?:{pattern})\z"


def looks_like(value: Column, kind: str) -> Column:
    """True where the whole text is of the given kind."""
    if kind in WORD_LISTS:
        return value.isin(WORD_LISTS[kind])
    if kind == "sentence":
        return value.rlike(SENTENCE_RULE)
    return value.rlike(whole(PATTERNS[kind]))
