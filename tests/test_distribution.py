import numpy as np
import pytest

from slotwise.operators import box_stats, density, distribution, histogram, violin
from slotwise.operators import merged_sketches, quantile_sketches, rank_error, sketch_quantiles
from slotwise.operators import correlation_table, group_fit, line_fit, prediction_quality, wide_by_flag


@pytest.fixture(scope="module")
def values():
    rng = np.random.default_rng(7)
    return {"a": rng.integers(-20, 90, 301), "b": rng.integers(0, 40, 40), "c": np.array([5])}


@pytest.fixture(scope="module")
def frame(spark, values):
    rows = [(k, int(v)) for k, vs in values.items() for v in vs] + [("a", None)]
    return spark.createDataFrame(rows, "k string, x int").repartition(6)


QS = {"p25": 0.25, "p75": 0.75, "p90": 0.9}


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_distribution(frame, values, method):
    for row in distribution(frame, "x", QS, ["k"], method).collect():
        v = np.sort(values[row.k])
        assert row.n == len(v) and row.mean == pytest.approx(v.mean()) and row.median == np.median(v)
        for name, q in QS.items():
            i = q * (len(v) - 1)
            want = v[int(np.floor(i + 0.5))] if method == "nearest" else np.quantile(v, q)
            assert row[name] == pytest.approx(want)


@pytest.mark.parametrize("method", ["nearest", "linear"])
def test_many_values_give_the_same_quantiles(frame, method):
    for keys in (["k"], []):
        few, many = (distribution(frame, "x", QS, keys, method, many=m).collect() for m in (False, True))
        assert sorted(few) == sorted(many) and few
    assert sorted(box_stats(frame, "x", "k", 30, many=True).collect()) == sorted(box_stats(frame, "x", "k", 30).collect())
    assert distribution(frame.where("k = 'zz'"), "x", QS, ["k"], many=True).collect() == []


def test_a_million_distinct_values(spark):
    """Fractional values, as many as rows; a third of them in one group."""
    n = 1_000_000
    df = spark.range(n).selectExpr("IF(id % 3 = 0, 'hot', concat('g', id % 50)) AS k", "id * 7919 % 1000003 + id / 3e6 AS x")
    got = distribution(df, "x", QS, method="linear")
    plan = got._jdf.queryExecution().optimizedPlan().toString()
    assert "Window" in plan and not any("Window" in line and ", [_value" in line and "_slice" not in line for line in plan.splitlines())
    i = np.arange(n)
    x = np.sort(i * 7919 % 1000003 + i / 3e6)
    row = got.first()
    assert row.n == n and row.mean == pytest.approx(x.mean()) and row.median == pytest.approx(np.median(x))
    assert [row[k] for k in QS] == pytest.approx([np.quantile(x, q) for q in QS.values()])
    groups = {r.k: r for r in distribution(df, "x", QS, ["k"]).collect()}
    hot = np.sort((i * 7919 % 1000003 + i / 3e6)[i % 3 == 0])
    assert groups["hot"].p90 == pytest.approx(hot[int(np.floor(0.9 * (len(hot) - 1) + 0.5))])


def test_sketches_merge_and_keep_their_bound(spark):
    n, size = 200_000, 400
    df = spark.range(n).selectExpr("id % 2 AS half", "cast(id * 7919 % 200003 AS double) AS x", "CAST(NULL AS double) AS none")
    x = np.sort(np.arange(n) * 7919 % 200003)
    halves = quantile_sketches(df, "x", ["half"], size)
    for sketches in (merged_sketches(halves, size=size), quantile_sketches(df, "x", size=size)):
        row = sketch_quantiles(sketches, {**QS, "median": 0.5}).first()
        assert row.n == n and row["mean"] == pytest.approx(x.mean())
        for name, q in {**QS, "median": 0.5}.items():
            assert abs(np.searchsorted(x, row[name]) / n - q) < 2 * rank_error(size)
    few = df.where("x < 300")  # fewer than the sketch keeps: exact
    want = np.sort(x[x < 300])
    assert distribution(few, "x", QS, method="approx").first().p90 == want[int(np.ceil(0.9 * len(want))) - 1]
    assert distribution(df, "none", QS, method="approx").collect() == []
    assert sketch_quantiles(merged_sketches(quantile_sketches(df.limit(0), "x")), QS).collect() == []


def test_stray_values_make_no_sequence(spark):
    """A value of a thousand million minutes."""
    df = spark.createDataFrame([(3,), (4,), (12,), (10**9,), (-5,)], "x long")
    runs = [tuple(r) for r in sorted(histogram(df, "x", width=5, merge_empty=True).collect())]
    assert runs == [(0, 0.0, 5.0, 2), (1, 5.0, 10.0, 0), (2, 10.0, 15.0, 1), (3, 15.0, 1e9, 0), (2 * 10**8, 1e9, 1e9 + 5, 1)]
    every = histogram(df, "x", width=5)
    assert every.where("n > 0").count() == 3 and every.agg({"n": "sum"}).first()[0] == 4
    assert every.rdd.getNumPartitions() > 1
    assert histogram(df.limit(0), "x", width=5).count() == 0 == histogram(df.limit(0), "x", width=5, merge_empty=True).count()


def test_histogram(frame, values):
    every = np.concatenate(list(values.values()))
    got = sorted(histogram(frame, "x", bins=12).collect())
    counts, edges = np.histogram(every, bins=12)
    assert [r.n for r in got] == list(counts)
    assert [r.bin_start for r in got] == pytest.approx(edges[:-1])
    got = sorted(histogram(frame, "x", width=5).collect())
    counts, _ = np.histogram(every, bins=np.arange(0, every.max() + 6, 5)[: len(got) + 1])
    assert [r.n for r in got][:-1] == list(counts)[:-1]
    assert [r.bin_start for r in got] == [5.0 * i for i in range(len(got))]
    bounded = histogram(frame, "x", bins=6, bounds=(-30, 30)).collect()
    assert [r.n for r in sorted(bounded)] == list(np.histogram(every, bins=6, range=(-30, 30))[0])


def test_histogram_of_one_value_and_none(frame):
    one = histogram(frame.where("k = 'c'"), "x", bins=4).collect()
    assert [r.n for r in sorted(one)] == list(np.histogram([5], bins=4)[0])
    assert histogram(frame.where("k = 'zz'"), "x", bins=4).collect() == []


def _kde(v, grid, h):
    z = (grid[:, None] - v[None, :]) / h
    return np.exp(-0.5 * z * z).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))


def test_density(frame, values):
    got = {}
    for r in density(frame, "x", ["k"], bounds=(-60, 120), points=50).collect():
        got.setdefault(r.k, {})[r.point] = r.density
    grid = np.linspace(-60, 120, 50)
    assert set(got) == {"a", "b"}  # one value has no spread
    for k, points in got.items():
        v = values[k].astype(float)
        want = _kde(v, grid, 0.15 * v.std(ddof=1))
        assert [points[i] for i in range(50)] == pytest.approx(list(want))


def kernels(v, x, h):
    return np.exp(-0.5 * ((x[:, None] - v[None, :]) / h) ** 2).sum(1) / (len(v) * h * np.sqrt(2 * np.pi))


@pytest.mark.parametrize("error", [None, 1e-4])
def test_density_of_fractional_values(spark, error):
    """Values between minutes, a stray far off, a null group, and no group at all; points out of reach are 0."""
    rng = np.random.default_rng(3)
    of = {"a": np.append(rng.normal(0, 1, 800), 1e6), None: rng.normal(5, 2, 400), "one": np.array([4.5])}
    df = spark.createDataFrame([(k, float(v)) for k, vs in of.items() for v in vs], "k string, x double").repartition(6)
    got = {}
    for r in density(df, "x", ["k"], points=40, factor=None if error else 0.001, error=error).collect():
        got.setdefault(r.k, []).append(r)
    assert set(got) == {"a", None}
    for k, rows in got.items():
        v, rows = of[k], sorted(rows, key=lambda r: r.point)
        h = v.std(ddof=1) * (len(v) ** -0.2 if error else 0.001)
        assert [r.point for r in rows] == list(range(40)) and rows[0].n == len(v)
        off = np.abs(np.array([r.density for r in rows]) - kernels(v, np.linspace(v.min(), v.max(), 40), h))
        assert off.max() <= (error or 1e-9) / (h * np.sqrt(2 * np.pi))
    assert error or sum(r.density == 0 for r in got["a"]) > 30
    alone = df.where("k IS NULL")
    rows = sorted(density(alone, "x", points=40, bounds=(0, 10), error=error).collect(), key=lambda r: r.point)
    h = of[None].std(ddof=1) * 0.15
    assert np.abs(np.array([r.density for r in rows]) - kernels(of[None], np.linspace(0, 10, 40), h)).max() <= (error or 1e-9) / (h * np.sqrt(2 * np.pi))
    assert density(df.where("k = 'zz'"), "x", points=40, error=error).collect() == []


def test_kernels_are_bounded_by_the_bandwidth(spark):
    """Of 200,000 values each meets few of the points, and with an error the cells stand for them."""
    df = spark.range(200_000).selectExpr("id / 7.0D AS x")
    plan = density(df, "x", factor=0.0001, error=1e-3)
    assert "Window" not in plan._jdf.queryExecution().executedPlan().toString()
    got = {r.point: r.density for r in plan.collect()}
    want = {r.point: r.density for r in density(df, "x", factor=0.0001).collect()}
    h = np.std(np.arange(200_000) / 7, ddof=1) * 0.0001
    assert len(got) == 500 and max(abs(got[p] - want[p]) for p in want) <= 1e-3 / (h * np.sqrt(2 * np.pi))


def test_violin(frame, values):
    rows = [r for r in violin(frame, "x", "k", points=20).collect() if r.k == "b"]
    v = values["b"].astype(float)
    grid = np.linspace(v.min(), v.max(), 20)
    want = _kde(v, grid, v.std(ddof=1) * len(v) ** -0.2)
    assert [r.density for r in sorted(rows, key=lambda r: r.point)] == pytest.approx(list(want))
    assert rows[0].median == np.median(v) and rows[0].n == len(v)


def test_box(frame, values):
    rows = {r.k: r for r in box_stats(frame, "x", "k", 30).collect()}
    assert set(rows) == {"a", "b"}
    for k, r in rows.items():
        v = values[k]
        low, high = np.quantile(v, [0.05, 0.95])
        assert (r.q1, r.median, r.q3) == pytest.approx(tuple(np.quantile(v, [0.25, 0.5, 0.75])))
        assert r.whisker_low == v[v >= low].min() and r.whisker_high == v[v <= high].max()


@pytest.fixture(scope="module")
def numbers(spark):
    rng = np.random.default_rng(11)
    rows = [(int(g), float(x), float(g * 3 + x + rng.normal()), 1.0) for g, x in zip(rng.integers(0, 4, 200), rng.normal(size=200))]
    return rows, spark.createDataFrame(rows, "g int, x double, y double, flat double")


def test_group_fit(numbers):
    rows, df = numbers
    g, x, y = (np.array(c) for c in list(zip(*rows))[:3])
    means = np.array([y[g == k].mean() for k in range(4)])[g]
    row = group_fit(df, ["g"], "y", ["x"]).first()
    assert row.n == 200 and row.n_groups == 4
    assert row.r2 == pytest.approx(1 - ((y - means) ** 2).sum() / ((y - y.mean()) ** 2).sum())
    assert row.r_x == pytest.approx(np.corrcoef(y - means, x)[0, 1])


def test_correlation_table_skips_flat(numbers):
    rows, df = numbers
    x, y = (np.array(c) for c in list(zip(*rows))[1:3])
    (line,) = correlation_table(df, {"x": "x", "flat": "flat"}, {"r": "y"}, min_spread=0.01).collect()
    assert line.predictor == "x" and line.r == pytest.approx(np.corrcoef(x, y)[0, 1])
    table = correlation_table(df, {"x": "x", "flat": "flat"}, {"r": "y"}).collect()
    assert {t.predictor: t.r is None for t in table} == {"x": False, "flat": True}


def test_line_and_quality(numbers):
    rows, df = numbers
    x, y = (np.array(c) for c in list(zip(*rows))[1:3])
    line = line_fit(df, "x", "y").first()
    assert (line.slope, line.intercept) == pytest.approx(tuple(np.polyfit(x, y, 1)))
    q = prediction_quality(df, "y", "x").first()
    assert q.mae == pytest.approx(np.abs(y - x).mean()) and q.bias == pytest.approx((y - x).mean())
    assert q.r2 == pytest.approx(1 - ((y - x) ** 2).sum() / ((y - y.mean()) ** 2).sum())


def test_wide_by_flag(spark):
    df = spark.createDataFrame([("s", True, 2.0), ("s", True, 4.0), ("t", False, 1.0)], "s string, f boolean, v double")
    got = {r.s: (r.no, r.yes) for r in wide_by_flag(df, "s", "f", "v", "no", "yes").collect()}
    assert got == {"s": (None, 3.0), "t": (1.0, None)}
