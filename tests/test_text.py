"""Doubles as text, against C's printf (as Python prints)."""

import math
import random
import struct

from pyspark.sql import functions as F

from rillflow.functions.text import fixed_texts


def test_decimals_are_those_of_printf(spark):
    r = random.Random(1)
    values = [0.0, -0.0, 0.125, 0.375, 2.675, 1.005, -0.001, 0.995, 0.9999999, 1e15 + 0.5, 2.0**53 - 0.5, 2.0**62, 5e-324, 0.5e-6, 1.5e-6, 2.5e-6, 1 / 3, math.pi * 1e9]
    values += [(2 * k + 1) / 128 for k in range(128)] + [math.nextafter((2 * k + 1) / 128, d) for k in range(64) for d in (0.0, 2.0)]  # halves of the sixth decimal and their neighbours
    values += [k / 8 for k in range(-40, 40)] + [math.nextafter(k / 200, d) for k in range(1, 400) for d in (0.0, 9.0)]
    values += [r.random() * 10 ** r.randint(-9, 12) for _ in range(4000)] + [round(r.random() * 1000, 3) for _ in range(2000)]
    values += [x for x in (struct.unpack("d", r.randbytes(8))[0] for _ in range(4000)) if x == x and 1e-30 < abs(x) < 2.0**63]
    df = spark.createDataFrame([(values[k : k + 500],) for k in range(0, len(values), 500)], "v array<double>")
    for places in (2, 6):
        got = [t for row in df.select(F.col("v"), fixed_texts(F.col("v"), places).alias("t")).collect() for t in zip(row.v, row.t, strict=True)]
        assert [(v, t) for v, t in got if t != f"{v:.{places}f}"] == []
    assert spark.range(1).select(fixed_texts(F.array(F.lit(None).cast("double"), F.lit(float("nan"))), 2)).first()[0] == [None, "nan"]
