import random

import numpy as np
from pyspark.sql import functions as F

from harborline.functions.num import (
    clamp_unit,
    fixed_text,
    money_text,
    round_exact,
    round_product,
    round_product_sql,
    to_number,
)


def values(spark, xs):
    return spark.createDataFrame([(float(x),) for x in xs], "x double")


def test_rounding_matches_numpy_and_python(spark):
    rng = random.Random(1)
    xs = [rng.uniform(-3, 3) for _ in range(3000)]
    xs += [k / 2000 for k in range(-400, 400)] + [k / 80 for k in range(200)] + [0.0, 1e6 + 0.5]
    rows = values(spark, xs).select(
        "x", round_product(F.col("x"), 4).alias("p"), round_exact(F.col("x"), 3).alias("e"),
        fixed_text(F.col("x"), 2).alias("t"), fixed_text(F.col("x"), 3).alias("t3"),
        F.expr(round_product_sql("x", 4)).alias("s"),
    ).collect()
    for r in rows:
        assert r.p == r.s == float(np.round(r.x, 4))
        assert r.e == round(r.x, 3)
        assert r.t == f"{r.x:.2f}" and r.t3 == f"{r.x:.3f}"


def test_numbers_from_text(spark):
    df = spark.createDataFrame([("1.5",), ("n/a",), ("NaN",), (None,), ("7",)], "t string")
    got = [r[0] for r in df.select(to_number(F.col("t"))).collect()]
    assert got == [1.5, None, None, None, 7.0]


def test_clamp_and_money(spark):
    df = spark.createDataFrame([(-1.0, "1234.50"), (0.4, "2.50"), (7.0, "3.51")], "x double, m string")
    rows = df.select(clamp_unit(F.col("x")), money_text(F.col("m").cast("decimal(18,2)"))).collect()
    assert [tuple(r) for r in rows] == [(0.0, "$1,234"), (0.4, "$2"), (1.0, "$4")]
