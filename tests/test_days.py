"""Ordered steps: the split path must give exactly what the plain one gives."""

import random

import pytest
from pyspark.sql import functions as F

from slotwise.operators import DAY, encode, first_in_group, first_rows, hot_days, ordered_list, sequence_days, value_codes
from slotwise.operators.days import number_rows

STEPS = {
    "position": "place", "size": "n_day",
    "previous": {"prev_value": "value", "prev_name": "name"},
    "running": {"upto": ("value", True), "before": ("value", False)},
}
NEW = ["place", "n_day", "prev_value", "prev_name", "upto", "before"]


def _rows(seed=1):
    """A third of all rows in one room-day, many ties, null keys, null order."""
    rng = random.Random(seed)
    rows = []
    for i in range(900):
        hot = rng.random() < 0.35
        room = "hot" if hot else rng.choice(["a", "b", None])
        day = 1 if hot else rng.choice([1, 2, None])
        when = rng.choice([None, *range(6)]) if rng.random() < 0.2 else rng.choice([3, 3, 3, 5])
        rows.append((i, room, day, when, rng.choice([None, 1, 2, 3]), f"n{i}"))
    rng.shuffle(rows)
    return rows


def _expected(rows):
    days = {}
    for row in rows:
        days.setdefault((row[1], row[2]), []).append(row)
    out = {}
    for members in days.values():
        members.sort(key=lambda r: (r[3] is None, r[3] or 0, r[0]))
        known, total, before_row = sum(r[3] is not None for r in members), 0, None
        for i, r in enumerate(members):
            before = total
            total += r[4] or 0
            out[r[0]] = (i + 1 if r[3] is not None else None, known,
                         before_row[4] if before_row else None, before_row[5] if before_row else None,
                         total, before)
            before_row = r
    return out


@pytest.mark.parametrize("limit", [None, 1, 40, 200])
def test_split_days_equal_plain(spark, limit):
    rows = _rows()
    df = spark.createDataFrame(rows, "row_seq long, or_room string, date int, t int, value int, name string").repartition(5)
    hot = None if limit is None else hot_days(df, rows=limit)
    assert (hot is None) == (limit is None)
    got = sequence_days(df, "t", **STEPS, hot=hot, slice_rows=limit or 1).select("row_seq", *NEW)
    result = {r[0]: tuple(r)[1:] for r in got.collect()}
    assert result == _expected(rows)


def test_hot_day_is_spread(spark):
    df = spark.range(3000).select(
        F.col("id").alias("row_seq"), F.lit("r").alias("or_room"), F.lit(1).alias("date"), F.lit(7).alias("t"))
    hot = hot_days(df, rows=1000)
    got = sequence_days(df, "t", position="p", hot=hot, slice_rows=500)
    sizes = [r["count"] for r in got.groupBy(F.floor((F.col("p") - 1) / 750)).count().collect()]
    assert sum(sizes) == 3000
    assert got.select("p").distinct().count() == 3000
    assert got.where(F.col("p") != F.col("row_seq") + 1).count() == 0


def test_no_hot_days(spark):
    df = spark.createDataFrame([("a", 1)], "or_room string, date int")
    assert hot_days(df) is None


def test_number_rows(spark):
    names = [f"p{i:03d}" for i in range(57)]
    random.Random(2).shuffle(names)
    df = spark.createDataFrame([(n,) for n in names], "name string").repartition(4)
    got = dict(number_rows(df, "name", "i", slices=5).collect())
    assert got == {n: i for i, n in enumerate(sorted(names))}


def test_encode_unseen(spark):
    train = spark.createDataFrame([("b",), ("a",), ("b",), (None,)], "p string")
    test = spark.createDataFrame([("a",), ("b",), ("z",), (None,)], "p string")
    got = {r.p: r.code for r in encode(test, value_codes(train, "p", "code"), "p", "code").collect()}
    assert got == {"a": 0, "b": 1, "z": -1, None: -1}


def test_first_rows_reduced_before_the_shuffle(spark, log):
    plan = first_rows(log)._jdf.queryExecution().executedPlan().toString()
    partial, exchange = plan.find("Partial"), plan.find("Exchange")
    assert 0 < exchange < partial, "the limit per key must lie below the exchange"


def test_first_rows_keeps_lowest(spark):
    df = spark.createDataFrame([("x", 5, "late"), ("x", 2, "early"), ("y", 9, "only")], "case_id string, row_seq int, v string")
    assert sorted(r.v for r in first_rows(df).collect()) == ["early", "only"]
    again = first_rows(first_rows(df))
    assert again.count() == 2


def test_first_in_group_of_hot_key(spark):
    df = spark.range(1000).withColumn("k", F.when(F.col("id") < 900, 0).otherwise(F.col("id")))
    got = first_in_group(df, ["k"], [F.col("id").desc()], 2).where("k = 0").collect()
    assert sorted(r.id for r in got) == [898, 899]


def test_one_exchange_for_all_steps(spark, cases):
    df = spark.createDataFrame(_rows(), "row_seq long, or_room string, date int, t int, value int, name string")
    plan = sequence_days(df, "t", **STEPS)._jdf.queryExecution().executedPlan().toString()
    assert plan.count("Exchange hashpartitioning") == 1
    assert DAY == ("or_room", "date")


def test_sums_of_fractions_do_not_depend_on_slices(spark):
    """Bit for bit, whether days are split or not."""
    df = spark.range(3000).selectExpr("id AS row_seq", "concat('R', id % 2) AS or_room", "DATE'2024-01-01' AS date",
                                      "id * 37 % 1009 AS at", "(id * 7919 % 999983) / 7.0D AS x")
    hot = hot_days(df, rows=0)
    both = [
        sorted(sequence_days(df, "at", running={"upto": ("x", True), "before": ("x", False)}, hot=h, slice_rows=400).collect(), key=lambda r: r.row_seq)
        for h in (None, hot)
    ]
    assert [(r.upto, r.before) for r in both[0]] == [(r.upto, r.before) for r in both[1]]
    assert both[0][0].__fields__ == [*df.columns, "upto", "before"]
    last = max((r for r in both[0] if r.or_room == "R0"), key=lambda r: r.upto)
    assert last.upto == pytest.approx(sum(r.x for r in both[0] if r.or_room == "R0"), rel=1e-12)


def test_lists_of_long_days_come_in_segments(spark):
    df = spark.range(200_000).selectExpr("id AS row_seq", "id AS case_id", "IF(id < 199990, 'default', 'R1') AS or_room", "DATE'2024-01-01' AS date",
                                         "id * 7919 % 200003 AS at")
    placed = sequence_days(df, "at", position="position", hot=hot_days(df, rows=50_000), slice_rows=30_000)
    cut = ordered_list(placed, DAY, "position", ["case_id", "at"], length=1000)
    assert cut.where("size(at_list) > 1000").count() == 0 and cut.where("or_room = 'default'").count() == 200
    short = ordered_list(placed.where("or_room = 'R1'"), DAY, "position", ["case_id", "at"])
    assert [r.at_list for r in cut.where("or_room = 'R1'").collect()] == [r.at_list for r in short.collect()]
    inside = cut.where("or_room = 'default' and segment = 77").first()
    every = sorted(i * 7919 % 200003 for i in range(199_990))
    assert list(inside.at_list) == every[77_000:78_000]


def test_last_known_value_before(spark):
    df = spark.range(400).selectExpr("id AS row_seq", "concat('R', id % 3) AS or_room", "DATE'2024-01-01' AS date", "id * 37 % 401 AS at",
                                     "IF(id % 4 = 0 OR (id * 37 % 401) BETWEEN 100 AND 300, NULL, id) AS x")
    hot = hot_days(df, rows=0)
    got = [{r.row_seq: r.before for r in sequence_days(df, "at", previous_known={"before": "x"}, hot=h, slice_rows=50).collect()} for h in (None, hot)]
    want = {}
    for room in ("R0", "R1", "R2"):
        last = None
        for r in sorted((r for r in df.collect() if r.or_room == room), key=lambda r: r["at"]):
            want[r.row_seq], last = last, r.x if r.x is not None else last
    assert got[0] == want and got[1] == want
