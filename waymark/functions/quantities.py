"""Quantities with units in parameter texts, and whether they are plausible."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, functions as F

from waymark.rulesets import fabrication as fab


QUANTITY_TYPE = ("array<struct<quantity:string,raw_value:double,unit:string,canonical_value:double,"
                 "lo:double,hi:double>>")


def normalise(text: Column) -> Column:
    """Superscripts to digits, 'x10' to 'e', micro sign to u, special blanks to blanks."""
    out = F.translate(text, *fab.SUPERSCRIPTS)
    for old, new in [("×10", "e"), ("x10", "e"), ("·", " "), (" ", " "), (" ", " "), (" ", " "),
                     ("µ", "u"), ("μ", "u")]:
        out = F.replace(out, F.lit(old), F.lit(new))
    return out


def quantities(text: Column) -> Column:
    """array<struct<quantity, raw_value, unit, canonical_value, lo, hi>> of a text."""
    return F.concat(*[_of_kind(text, letters, *kind) for letters, kind in zip(fab.UNIT_LETTERS, fab.QUANTITIES)])


def _of_kind(text: Column, letters: str, pattern: str, quantity: str, factor: float, lo: float, hi: float, unit: str) -> Column:
    numbers = F.regexp_extract_all(text, F.lit(fab.NUMBER + r"\s*(?:" + pattern + ")"), F.lit(1))
    found = F.transform(numbers, lambda n: F.struct(
        F.lit(quantity).alias("quantity"), n.cast("double").alias("raw_value"), F.lit(unit).alias("unit"),
        (n.cast("double") * factor).alias("canonical_value"), F.lit(lo).alias("lo"), F.lit(hi).alias("hi")))
    # a substring test is far cheaper than a pattern that has to fail at every position
    return F.when(text.contains(letters), found).otherwise(F.array().cast(QUANTITY_TYPE))


def extract(df: DataFrame, text: str) -> DataFrame:
    """One row per quantity found; the text column is normalised first."""
    clean = df.withColumn("__text", normalise(F.col(text)))
    out = clean.select(*[c for c in df.columns if c != text], F.explode(quantities(F.col("__text"))).alias("q"))
    return out.select(*[c for c in df.columns if c != text], "q.*")


def implausible(found: DataFrame) -> DataFrame:
    """The quantities outside their bounds, with the reason."""
    bad = (F.col("canonical_value") < F.col("lo")) | (F.col("canonical_value") > F.col("hi"))
    reason = F.format_string("%s %s %s is outside the plausible range [%s, %s] %s", "quantity",
                             _short(F.col("canonical_value")), "unit", _short(F.col("lo")), _short(F.col("hi")),
                             "unit")
    return found.filter(bad).withColumn("reason", reason)


def _short(value: Column) -> Column:
    """At most six significant digits: plain between 1e-4 and 1e6, else with an exponent."""
    power = F.floor(F.log10(F.abs(value)))
    plain = F.regexp_replace(F.regexp_replace(F.format_string("%.10f", F.round(value, 6)), r"0+$", ""), r"\.$", "")
    wide = F.format_string("%.5e", value)
    short = F.regexp_replace(wide, r"\.?0*e", "e")
    return F.when((value == 0) | ((power >= -4) & (power < 6)), plain).otherwise(short)
