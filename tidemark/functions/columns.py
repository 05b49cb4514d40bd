"""Scalar column builders: cleaning, parsing, bounding and feature arithmetic.

Every function takes and returns a Column built from native expressions, so the
whole cleaning pass stays in one generated stage.
"""

from __future__ import annotations

from collections.abc import Mapping, Sequence

from pyspark.sql import Column
from pyspark.sql import functions as F

EPS = 1e-6


def null_if_nan(c: Column) -> Column:
    """NaN sorts above every number in Spark; missing values must be NULL."""
    return F.when(~F.isnan(c), c)


def clean_numeric(c: Column) -> Column:
    """Keep digits, dot and minus; anything that is still not a number is NULL."""
    return F.regexp_replace(c.cast("string"), r"[^0-9.\-]", "").try_cast("double")


def parse_duration_months(c: Column) -> Column:
    """'22 Years and 9 Months' -> 273.0; nothing found -> NULL."""
    text = c.cast("string")

    def count_of(pattern: str) -> Column:
        found = F.regexp_extract(text, pattern, 1).try_cast("int")
        return F.coalesce(found, F.lit(0))

    months = count_of(r"([0-9]+)\s*[Yy]ear") * 12 + count_of(r"([0-9]+)\s*[Mm]onth")
    return F.nullif(months, F.lit(0)).cast("double")


def extract_amount(c: Column) -> Column:
    """First number in a text after removing thousands separators."""
    return F.regexp_extract(F.regexp_replace(c.cast("string"), ",", ""),
                            r"([0-9]+\.?[0-9]*)", 1).try_cast("double")


def parse_date(c: Column, fmt: str = "dd-MM-yyyy") -> Column:
    """Formatted text to DATE; failures are NULL."""
    return F.try_to_timestamp(c.cast("string"), F.lit(fmt)).cast("date")


def clamp_floor(c: Column, floor: float = 0.0) -> Column:
    return F.when(c.isNotNull(), F.greatest(c, F.lit(floor)))


def clip(c: Column, lo: float | Column | None, hi: float | Column | None) -> Column:
    """Null-preserving clip (greatest/least alone would ignore the NULL)."""
    out = c
    if lo is not None:
        out = F.greatest(out, lo if isinstance(lo, Column) else F.lit(float(lo)))
    if hi is not None:
        out = F.least(out, hi if isinstance(hi, Column) else F.lit(float(hi)))
    return F.when(c.isNotNull(), out)


def null_out_of_range(c: Column, lo: float, hi: float) -> Column:
    return F.when(c.between(lo, hi), c)


def map_category(c: Column, mapping: Mapping[str, float], default: float) -> Column:
    """Trim, lower-case and look up; unknown or missing text gets ``default``."""
    pairs = [F.lit(x) for item in mapping.items() for x in item]
    return F.coalesce(F.create_map(*pairs)[F.lower(F.trim(c.cast("string")))], F.lit(default))


def tier_ordinal(c: Column, tiers: Sequence[str], default: int = 2) -> Column:
    pairs = [F.lit(x) for i, name in enumerate(tiers) for x in (name, i)]
    return F.coalesce(F.create_map(*pairs)[c], F.lit(default))


def tier_name(ordinal: Column, tiers: Sequence[str]) -> Column:
    return F.element_at(F.array(*[F.lit(t) for t in tiers]), ordinal.cast("int") + 1)


def normalise_name(c: Column, bonus: bool = False) -> Column:
    """Join key of a scheme name: lower case, no plan/option suffix, letters and digits only."""
    words = "regular|direct|growth|dividend|idcw|option|plan"
    if bonus:
        words = "regular|direct|growth|dividend|idcw|bonus|option|plan"
    text = F.regexp_replace(F.lower(F.trim(F.coalesce(c.cast("string"), F.lit("")))), r"\s+", " ")
    text = F.regexp_replace(text, rf"\s*[-–]\s*({words}).*$", "")
    return F.trim(F.regexp_replace(text, "[^a-z0-9 ]", ""))


def normalise_code(c: Column) -> Column:
    return F.regexp_replace(F.lower(F.coalesce(c.cast("string"), F.lit(""))), "[^a-z0-9]", "")


def contains_any(text: Column, keywords: Sequence[str]) -> Column:
    hit = F.lit(False)
    for word in keywords:
        hit = hit | F.contains(text, F.lit(word))
    return hit


def first_keyword(text: Column, rules: Sequence[tuple[str, object]]) -> Column:
    """Value of the first rule whose keyword occurs in the lower-cased text, else NULL."""
    low = F.lower(text)
    (word, value), *rest = rules
    out = F.when(F.contains(low, F.lit(word)), F.lit(value))
    for word, value in rest:
        out = out.when(F.contains(low, F.lit(word)), F.lit(value))
    return out


def group_rules(groups: Sequence[tuple[str, Sequence[str]]]) -> list[tuple[str, str]]:
    """Flatten (value, keywords) groups to ordered (keyword, value) rules."""
    return [(word, value) for value, words in groups for word in words]


def safe_ratio(num: Column, den: Column, lo: float, hi: float) -> Column:
    return clip(num / (den + EPS), lo, hi)


def age_proxy(age: Column) -> Column:
    years = clip(F.coalesce(age.cast("double"), F.lit(35.0)), 18, 70)
    return clip((70.0 - years) / 52.0, 0, 1)


def min_max(c: Column, lo: Column, hi: Column, constant: float = 0.0) -> Column:
    """(c-lo)/(hi-lo); a constant column maps to ``constant``."""
    return F.when(hi - lo > 1e-12, (c - lo) / (hi - lo)).otherwise(
        F.when(c.isNotNull(), F.lit(constant)))


def spread_share(c: Column, lo: Column, hi: Column, eps: float) -> Column:
    """Min-max share with a small constant in the denominator."""
    return (c - lo) / (hi - lo + eps)


def hash_bucket(key: Column, seed: str = "", buckets: int = 10_000) -> Column:
    """Portable pseudo-random bucket in [0, buckets) from md5 of the key."""
    text = F.concat(key.cast("string"), F.lit("|" + seed))
    return F.conv(F.substring(F.md5(text), 1, 8), 16, 10).cast("bigint") % buckets


def half_even(c: Column, digits: int) -> Column:
    """Round like numpy: scale, round half to even, scale back."""
    factor = float(10 ** digits)
    return F.rint(c * factor) / factor


def fixed2(c: Column) -> Column:
    """Two-decimal text of a value in [0, 8), rounded on its exact binary value like C printf.

    The JVM formatter rounds the shortest decimal form instead, which differs for
    values such as 0.475.  c * 2^60 is an exact integer in this range, so the
    remainder against half a cent is compared exactly.  Larger values fall back.
    """
    whole = float(2 ** 60)
    n = (c * whole).cast("bigint").cast("decimal(20,0)") * F.lit(100).cast("decimal(3,0)")
    unit = F.lit(2 ** 60).cast("decimal(20,0)")
    cents = F.floor(n / unit).cast("bigint")
    rest = n - cents.cast("decimal(20,0)") * unit
    half = F.lit(2 ** 59).cast("decimal(20,0)")
    up = (rest > half) | ((rest == half) & (cents % 2 == 1))
    total = cents + up.cast("bigint")
    exact = F.format_string("%d.%02d", F.floor(total / 100).cast("bigint"), total % 100)
    return F.when((c >= 0) & (c < 8), exact).otherwise(F.format_string("%.2f", c))
