"""Numbers as text."""

from __future__ import annotations

from pyspark.sql import Column
from pyspark.sql import functions as F


def fixed_texts(values: Column, places: int) -> Column:
    """An array of doubles as texts with so many (up to 6) decimals, as C's printf writes them; null stays null.

    The binary value is rounded, not the shortest decimal that stands for it, and exact halves go to the even digit. The
    fraction is split on grids of 20 and 40 bits, so that its parts times the power of ten are exact, and what is left is far
    below the distance of any double from a half. From 2^63 on Spark's own digits are taken.
    """
    power = float(10**places)
    long = lambda c: F.floor(c).cast("long")

    def signed(x: Column) -> Column:
        return F.struct(x.alias("x"), x.cast("string").startswith("-").alias("less"), F.abs(x).alias("size"), long(F.abs(x)).alias("whole"))

    def fraction(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["less"].alias("less"), s["whole"].alias("whole"), (s["size"] - s["whole"]).alias("f"))

    def upper(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["less"].alias("less"), s["whole"].alias("whole"), s["f"].alias("f"), (long(s["f"] * 2.0**20) / 2.0**20).alias("h"))

    def middle(s: Column) -> Column:
        return F.struct(s["x"].alias("x"), s["less"].alias("less"), s["whole"].alias("whole"), s["h"].alias("h"), (s["f"] - s["h"]).alias("r"), (long((s["f"] - s["h"]) * 2.0**40) / 2.0**40).alias("m"))

    def scaled(s: Column) -> Column:
        top = s["h"] * power
        return F.struct(s["x"].alias("x"), s["less"].alias("less"), s["whole"].alias("whole"), long(top).alias("k"), (top - long(top) + s["m"] * power).alias("t"), ((s["r"] - s["m"]) * power).alias("low"))

    def digits(s: Column) -> Column:
        k = s["k"] + long(s["t"])
        return F.struct(s["x"].alias("x"), s["less"].alias("less"), s["whole"].alias("whole"), k.alias("k"), (s["t"] - long(s["t"]) - 0.5 + s["low"]).alias("over"))

    def rounded(s: Column) -> Column:
        up = (s["over"] > 0) | ((s["over"] == 0) & (s["k"] % 2 == 1))
        return F.struct(s["x"].alias("x"), s["less"].alias("less"), s["whole"].alias("whole"), (s["k"] + up.cast("long")).alias("k"))

    def text(s: Column) -> Column:
        full = (s["k"] >= int(power)).cast("long")
        shown = F.concat(F.when(s["less"], "-").otherwise(""), (s["whole"] + full).cast("string"), F.lit("."), F.lpad((s["k"] - full * int(power)).cast("string"), places, "0"))
        return F.when(F.isnan(s["x"]), "nan").when(F.abs(s["x"]) < 2.0**63, shown).otherwise(F.format_string(f"%.{places}f", s["x"]))

    told = values
    for step in (signed, fraction, upper, middle, scaled, digits, rounded, text):
        told = F.transform(told, step)
    return F.transform(F.arrays_zip(values.alias("x"), told.alias("t")), lambda z: F.when(z["x"].isNotNull(), z["t"]))
