"""Column expressions on text: keys, humanising, trimming, truncation."""

from __future__ import annotations

from pyspark.sql import Column, functions as F

# Blocks of ideographs that are letters since Unicode 15 and that Java 17 does not know.
_NEW_IDEOGRAPHS = r"\x{2EBF0}-\x{2EE5D}\x{31350}-\x{323AF}"
#: A letter or a digit (Unicode categories L and N), and everything that is neither.
ALNUM = rf"[\p{{L}}\p{{N}}{_NEW_IDEOGRAPHS}]"
NOT_ALNUM = rf"[^\p{{L}}\p{{N}}{_NEW_IDEOGRAPHS}]"


def value_key(value: Column) -> Column:
    """The value in lower case without anything but letters and digits; null where nothing is left."""
    key = F.regexp_replace(F.lower(value), NOT_ALNUM, "")
    return F.when(key != "", key)


def has_key(value: Column) -> Column:
    """Whether :func:`value_key` is not null; cheaper than the key, since the first letter or digit decides."""
    return F.coalesce(value.rlike(ALNUM), F.lit(False))


def humanize(value: Column) -> Column:
    """Underscores become spaces."""
    return F.translate(value, "_", " ")


def strip_outer(value: Column) -> Column:
    """Strip every kind of white space, not just blanks, at both ends."""
    return F.regexp_replace(value, r"^\s+|\s+$", "")


def compare_key(value: Column) -> Column:
    """Key of a part of a fact in duplicate checks: underscores as spaces, lower case, stripped."""
    return strip_outer(F.lower(humanize(value)))


def agent_key(value: Column) -> Column:
    """Key of a rendered fact: lower case, no blanks, underscores or parentheses; commas become bars."""
    return F.translate(F.lower(value), ", _()", "|")


def capitalize_first(value: Column) -> Column:
    """First letter upper, all others lower."""
    return F.concat(F.upper(F.substring(value, 1, 1)), F.lower(value.substr(F.lit(2), F.length(value))))


def truncated(value: Column, keep: int, ellipsis: str = "...") -> Column:
    """Cut to ``keep`` characters and mark the cut; shorter values stay as they are."""
    return F.when(F.length(value) > keep, F.concat(F.substring(value, 1, keep), F.lit(ellipsis))).otherwise(value)


def contains_folded(haystack: Column, needle: Column) -> Column:
    """Case-insensitive substring test that knows no wildcards."""
    return F.contains(F.lower(haystack), F.lower(needle))


def years_in(value: Column) -> Column:
    """All years from 1900 to 2099 that stand alone in a text, as integers."""
    return F.transform(F.regexp_extract_all(value, F.lit(r"\b(19\d{2}|20\d{2})\b"), F.lit(1)), lambda y: y.cast("int"))


def quoted_in(value: Column) -> Column:
    """All double-quoted strings of a text."""
    return F.regexp_extract_all(value, F.lit('"([^"]+)"'), F.lit(1))


def clamp(value: Column, low: int, high: int) -> Column:
    """Limit a number to a closed range."""
    return F.greatest(F.lit(low), F.least(value, F.lit(high)))


def unit_interval(value: Column, default: float = 0.5) -> Column:
    """Limit to [0, 1]; null becomes the default."""
    return F.greatest(F.lit(0.0), F.least(F.coalesce(value, F.lit(default)), F.lit(1.0)))
