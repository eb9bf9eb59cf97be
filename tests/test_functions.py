import datetime as dt

import numpy as np
import pytest
from pyspark.sql import functions as F

from slotwise.functions import (
    BUFFER_LABELS, DELAY_LABELS, PREP_LABELS, bucket_label, buffer_bucket, clean_procedure_name, clip_low,
    day_type, delay_bucket, flag_count, minutes_between, occupied_or_default, outside_values, pearson,
    position_label, prep_bucket, share, stamps_differ, within, within_abs,
)
from slotwise.operators import attach, translate


def one(spark, values, kind, expression):
    df = spark.createDataFrame([(v,) for v in values], f"x {kind}")
    return [r[0] for r in df.select(expression(F.col("x"))).collect()]


def test_minutes(spark):
    t = dt.datetime(2024, 3, 31, 1, 30)
    ends = [t + dt.timedelta(seconds=119.9), t - dt.timedelta(seconds=118), t + dt.timedelta(hours=2), None]
    df = spark.createDataFrame([(t, e) for e in ends], "a timestamp_ntz, b timestamp_ntz")

    def got(unit, negative="keep"):
        return [r[0] for r in df.select(minutes_between(F.col("a"), F.col("b"), unit, negative)).collect()]

    assert got("minute") == [1, -1, 120, None]
    assert got("minute", "null") == [1, None, 120, None]
    assert got("second") == [119 / 60, -118 / 60, 120.0, None]
    assert got("micro")[:3] == pytest.approx([119.9 / 60, -118 / 60, 120.0]) and got("micro")[3] is None
    with pytest.raises(ValueError):
        got("hour")


def test_buckets(spark):
    minutes = [None, -5, 0, 1, 10, 11, 20, 21, 30, 31, 45, 46]
    assert one(spark, minutes, "int", prep_bucket) == [None, None, 0, 1, 1, 2, 2, 3, 3, 3, 3, 3]
    assert one(spark, minutes, "int", buffer_bucket) == [None, None, 0, 1, 1, 2, 2, 3, 3, 4, 4, 5]
    assert one(spark, [None, -9, 0, 1, 15, 16, 30, 60, 61], "int", delay_bucket) == [None, 0, 0, 1, 1, 2, 2, 3, 4]
    assert one(spark, [0, 3, None], "int", lambda c: bucket_label(c, PREP_LABELS)) == ["0", "20+", None]
    assert len(BUFFER_LABELS) == 6 and len(DELAY_LABELS) == 5
    assert one(spark, [1, 4, 5, 9], "int", position_label) == ["1", "4", "5+", "5+"]
    assert one(spark, [0.6, 0.5, -0.2, -0.3, None], "double", day_type) == [
        "Cascading", "One-time shock", "One-time shock", "Recovery", None]


def test_filters(spark):
    assert one(spark, [0, 240, 241, -1, None], "int", lambda c: within(c, (0, 240))) == [True, True, False, False, None]
    assert one(spark, [-299.0, 300.0, None], "double", lambda c: within_abs(c, 300)) == [True, False, None]
    assert one(spark, ["a", "b", None], "string", lambda c: outside_values(c, ("a",))) == [False, True, False]
    assert one(spark, [-1.0, 0.0, 2.0, None], "double", lambda c: occupied_or_default(c, 35)) == [35, 35, 2, 35]
    assert one(spark, [-1.0, 2.0, None], "double", clip_low) == [0, 2, None]
    assert one(spark, [1, 2, None], "int", lambda c: stamps_differ(c, F.lit(1))) == [False, True, None]


def test_text(spark):
    names = ["HIP [KNFB]", "A [x] b [y]", "plain ", None]
    assert one(spark, names, "string", clean_procedure_name) == ["HIP", "A", "plain", None]
    assert one(spark, ["a", "b", None], "string", lambda c: translate(c, {"a": "A"})) == ["A", "b", None]


def test_flag_count(spark):
    df = spark.createDataFrame([(True, None, False, 1), (None, None, None, 1)], "staff_a boolean, staff_b boolean, staff_c boolean, x int")
    assert [r[0] for r in df.select(flag_count(df, "staff_")).collect()] == [1, 0]
    assert [r[0] for r in df.select(flag_count(df, "resource_")).collect()] == [0, 0]


def test_many_flags_stay_one_projection(spark):
    df = spark.range(10).select(*[(F.col("id") % (i + 2) == 0).alias(f"resource_{i}") for i in range(210)])
    got = [r[0] for r in df.select(flag_count(df, "resource_")).collect()]
    assert got == [sum(n % (i + 2) == 0 for i in range(210)) for n in range(10)]


def test_pearson(spark):
    rng = np.random.default_rng(3)
    x, y = rng.normal(size=50), rng.normal(size=50)
    rows = [(float(a), float(b)) for a, b in zip(x, y)] + [(None, 1.0), (2.0, None)]
    df = spark.createDataFrame(rows, "x double, y double")
    r = df.agg(pearson(F.col("x"), F.col("y"))).first()[0]
    assert r == pytest.approx(np.corrcoef(x, y)[0, 1])
    flat = spark.createDataFrame([(1.0, 2.0), (1.0, 3.0)], "x double, y double")
    assert flat.agg(pearson(F.col("x"), F.col("y"))).first()[0] is None


def test_share_ignores_unknown(spark):
    df = spark.createDataFrame([(1,), (-1,), (None,), (3,)], "x int")
    assert df.agg(share(F.col("x") > 0)).first()[0] == pytest.approx(200 / 3)


@pytest.mark.parametrize("limit", [100, 0])
def test_attach_small_and_large(spark, limit):
    df = spark.createDataFrame([("a", 1), ("b", 2), (None, 3)], "k string, v int")
    lookup = spark.createDataFrame([("a", 10), (None, 99)], "k string, w int")
    joined = attach(df, lookup, ["k"], broadcast_rows=limit)
    assert sorted((r.v, r.w) for r in joined.collect()) == [(1, 10), (2, None), (3, None)]
    plan = joined._jdf.queryExecution().logical().toString()
    assert ("hint" in plan.lower() or "broadcast" in plan.lower()) == (limit > 0)
