"""Scalar normalisation: numbers, flags, ids, group names, ratios, angles."""

from __future__ import annotations

from functools import reduce

from pyspark.sql import Column, DataFrame
from pyspark.sql import functions as F

#: Texts that count as true for each flag reader; fixed values.
TRUE_WORDS = {"plain": ("true", "1", "yes", "y"), "with_t": ("true", "1", "yes", "y", "t")}
#: Texts that name the two groups exactly; fixed values.
WILD_TYPE_WORDS = ("wt", "wildtype", "wild_type", "control")
MUTANT_WORDS = ("mut", "mutant", "tert", "tert_mutant", "tert-/ -", "tert-/-")
#: Patterns that name the two groups within a text in upper case, and within one in lower case; fixed values.
WILD_TYPE_PATTERN, MUTANT_PATTERN = r"(^|[^A-Z])WT([^A-Z]|$)|WILD TYPE", r"MUT"
WILD_TYPE_IN_NAME, MUTANT_IN_NAME = r"(?U)\bwt\b|wildtype|wild_type", r"(?U)\bmut\b|mutant|tert"
#: Scale of the median absolute deviation to a standard deviation: fixed value.
MAD_SCALE = 1.4826


def number(c: Column) -> Column:
    """A double, with text that is no number, NaN and infinities as null."""
    x = c.try_cast("double")
    return F.when(F.isnan(x) | (F.abs(x) == float("inf")), None).otherwise(x)


def parse_bool(c: Column, words: str = "plain", positive_only: bool = False, numbers: bool = True) -> Column:
    """A flag from text, number or boolean; null and unknown text are false.

    With numbers, text that is a number is true unless zero, or if positive; without, only the words are true, so that
    2 and 1.0 as text are false.
    """
    text = c.cast("string")
    word = F.lower(F.trim(text)).isin(*TRUE_WORDS[words])
    if not numbers:
        return F.coalesce(word, F.lit(False))
    x = text.try_cast("double")
    truthy = x > 0 if positive_only else x != 0
    return F.coalesce(F.when(x.isNotNull() & ~F.isnan(x), truthy), word, F.lit(False))


def column_flags(df: DataFrame, column: str, name: str) -> DataFrame:
    """df with a flag read as the whole column suggests: if any of its texts is a number, positive numbers are true and
    all else is false; if none is, the plain words are, as they stand but for case."""
    text = F.col(column).cast("string")
    x = number(text)
    if df.agg(F.bool_or(x.isNotNull() | text.try_cast("double").isin(float("inf"), float("-inf")))).first()[0]:
        flag = text.try_cast("double") > 0
        flag = flag & ~F.isnan(text.try_cast("double"))
    else:
        flag = F.lower(text).isin(*TRUE_WORDS["plain"])
    return df.withColumn(name, F.coalesce(flag, F.lit(False)))


def normalise_id(c: Column) -> Column:
    """91, 91.0 and '91 ' are one id."""
    text = F.trim(c.cast("string"))
    x = text.try_cast("double")
    return F.when(x == F.floor(x), x.try_cast("bigint").cast("string")).otherwise(text)


def group_name(c: Column, rule: str = "wild_type_first") -> Column:
    """WT or MUT from free text, which stays as it is where neither is found; null stays null.

    By pattern: WT between other signs than letters or WILD TYPE, and MUT anywhere, in either order; or by exact words.
    """
    text = F.trim(c)
    if rule == "exact":
        word = F.lower(text)
        return F.when(word.isin(*WILD_TYPE_WORDS), "WT").when(word.isin(*MUTANT_WORDS), "MUT").otherwise(text)
    wild, mutant = F.upper(text).rlike(WILD_TYPE_PATTERN), F.upper(text).rlike(MUTANT_PATTERN)
    if rule == "mutant_first":
        return F.when(mutant, "MUT").when(wild, "WT").otherwise(c)
    return F.when(wild, "WT").when(mutant, "MUT").otherwise(text)


def group_in_name(c: Column) -> Column:
    """WT or MUT that a file name or other text tells, else null."""
    text = F.lower(c)
    return F.when(text.rlike(WILD_TYPE_IN_NAME), "WT").when(text.rlike(MUTANT_IN_NAME), "MUT")


def safe_name(c: Column) -> Column:
    """Text with runs of anything but word signs, hyphens and dots as one underscore, none at the ends."""
    text = F.regexp_replace(F.regexp_replace(c, r"(?U)[^\w\-.]+", "_"), "_+", "_")
    return F.regexp_replace(text, "^_+|_+$", "")


def track_key(block: Column, track: Column) -> Column:
    return F.concat_ws("::", block.cast("string"), track.cast("string"))


def ratio(a: Column, b: Column) -> Column:
    """a / b, null where b is not positive."""
    return F.when(b > 0, a / b)


def norm(*parts: Column) -> Column:
    return F.sqrt(reduce(lambda x, y: x + y, [p * p for p in parts]))


def relative_difference(a: Column, b: Column, eps: float = 1e-6) -> Column:
    return F.abs(a - b) / F.greatest(F.abs(a), F.abs(b), F.lit(eps))


def wrap_angle(a: Column) -> Column:
    """An angle in [-pi, pi)."""
    pi = 3.141592653589793
    return F.pmod(a + F.lit(pi), F.lit(2 * pi)) - F.lit(pi)


def middle_of(a: Column, b: Column, c: Column) -> Column:
    return a + b + c - F.greatest(a, b, c) - F.least(a, b, c)


def rounded(df: DataFrame, digits: int = 6, nudge: float = 0.0) -> DataFrame:
    """df with every double rounded, and negative zero as zero."""
    return df.select(*[(F.round(F.col(n) + F.lit(nudge), digits) + F.lit(0.0)).alias(n) if t in ("double", "float") else F.col(n) for n, t in df.dtypes])
