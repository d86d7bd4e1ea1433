"""Text normalisation: ordered regular-expression rewrites as column expressions."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column
from pyspark.sql import functions as F

# Fixed values that the results depend on: patterns with their replacements, in the order in which they
# are applied, and brand names in the order in which they are looked for. An empty alternative of the
# first list of insignificant words is left out: it never changes a result here.
BASELINE_PATTERNS = (
    (r"['\"”]", "inch"),
    (r"\s*inches?\b", "inch"),
    (r"[\/\(\)\-\[\]\:\–\—\,\&\+\|]", " "),
    (r"(?<!\d)\.(?!\d|\w)", " "),
    (r"hertz", "hz"),
    (r"\b-\s*hz\b|\s*hz", "hz"),
    (r"\b(\w+)\b(?=.*\b\1\b)", ""),
    (r"\s+", " "),
    (r"^\s+|\s+$", ""),
)
PATTERNS = (
    (r"newegg\.com|thenerds\.net| - best buy| - thenerds\.net", " "),
    (r"['\"”]", "inch"),
    (r"\s*inches?\b", "inch"),
    (r"\b(built[\s\-]?in|wi[\s\-]?fi)\b", "wifi"),
    (r"3 d", "3d"),
    (r"blu ray", "bluray"),
    (r"[\/\(\)\-\[\]\:\–\—\,\&\+\|]", " "),
    (r"(?<!\d)\.(?!\d|\w)", " "),
    (r"(\d+)(?:\.0)?\s*inch", "$1inch"),
    (r"hertz", "hz"),
    (r"\b-\s*hz\b|\s*hz", "hz"),
    (r"\bplasma tv\b|\bplasma\b", "plasma"),
    (r"ledlcd |led backlit lcd|led backlight lcd", "led lcd"),
    (r"lcdtv", "lcd"),
    (r"hdtv", "hd"),
    (r"\b(tv|class|diagonal|size|measured|screen|series|refurbished|westinghouse|clearscn|with|theater|and|of|four|pairs|glasses|internet|apps|factory re certified)\b", ""),
    (r"\b(cinema|theater|slim|glossy|syncmaster|black|grey|gray|gold|sleek|smart|classic|edition|model|year)\b", ""),
    (r"diag.", " "),
    (r"\b(\w+)\b(?=.*\b\1\b)", ""),
    (r"\s+", " "),
    (r"^\s+|\s+$", ""),
)
BRANDS = (
    "lg", "samsung", "toshiba", "sony", "sunbritetv", "sharp", "vizio", "sceptre", "hisense", "haier", "supersonic", "sansui",
    "nec", "sanyo", "sigmac", "panasonic", "coby", "philips", "rca", "proscan", "seiki", "viewsonic", "upstar", "epson", "affinity",
    "hannspree", "magnavox", "compaq", "westinghouse", "jvc", "craig", "jvc tv", "insignia", "dynex", "mitsubishi",
)
TITLE_WORD = r"([a-zA-Z0-9]*(([0-9]+[^0-9, ]+)|([^\d, ]+[0-9]+))[a-zA-Z0-9]*)"
FEATURE_WORD = r"(\d+(\.\d+)?[a-zA-Z]+$|\d+(\.\d+)?$)"
NUMBER = r"\d+\.?\d*"


def rewrite(text: Column, patterns=PATTERNS) -> Column:
    """Applies the patterns in turn; character classes and word boundaries are Unicode's."""
    return reduce(lambda c, p: F.regexp_replace(c, "(?U)" + p[0], p[1]), patterns, text)


def clean_title(title: Column, patterns=PATTERNS) -> Column:
    return rewrite(F.lower(title), patterns)


def clean_title_baseline(title: Column) -> Column:
    return rewrite(F.lower(title), BASELINE_PATTERNS)


def tokens(text: Column) -> Column:
    """Words between white space; no word for a null or empty text."""
    return F.filter(F.split(F.coalesce(text, F.lit("")), r"(?U)\s+"), lambda x: x != "")


def unique_sorted(words: Column) -> Column:
    return F.array_sort(F.array_distinct(words))


def title_words(title: Column) -> Column:
    """Runs that mix digits with other characters."""
    return F.regexp_extract_all(F.lower(title), F.lit(TITLE_WORD), F.lit(1))


def feature_words(values: Column) -> Column:
    """Of each value, the number with an optional unit at its end."""
    return F.filter(F.transform(values, lambda v: F.regexp_extract(F.lower(v), FEATURE_WORD, 0)), lambda w: w != "")


def numeric_part(word: Column) -> Column:
    return F.array_join(F.regexp_extract_all(word, F.lit(f"({NUMBER})"), F.lit(1)), "")


def other_part(word: Column) -> Column:
    return F.regexp_replace(word, NUMBER, "")
