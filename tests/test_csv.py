import csv
import datetime as dt
import random

import pytest
from pyspark.sql import functions as F

from slotwise.schema import CANCELLED_COLUMNS, COMPLETED_COLUMNS
from slotwise.sources import read_cancelled, read_completed, write_result
from slotwise.sources.csvlog import flag_name, parse_ts_mixed, rename_columns
from slotwise.sources.records import ends_quoted, read_csv, text_rows


def _write(path, header, lines):
    path.write_text("\n".join(";".join(line) for line in [header, *lines]) + "\n", encoding="utf-8")
    return str(path)


HEADER = [*COMPLETED_COLUMNS, "Staff.Læge A", " Ressource.Røntgen (C-bue)"]


def _completed(tmp_path, *records):
    lines = [[record.get(h, "") for h in HEADER] for record in records]
    return _write(tmp_path / "completed.csv", HEADER, lines)


def test_completed_types_and_bad_values(spark, tmp_path):
    path = _completed(
        tmp_path,
        {"Case-ID Anonymous": "7", "Patient Alder": "44", "Akut case (J/N)": "Ja", "Speciale": '"a;b"',
         "Dato": "2024-01-02 00:00:00,000", "Patient på stuen": "2024-01-02 03:04:05,678",
         "Stue klargjort": "bad", "Stue rengjort": "2024-01-02 03:04:05", "Forsinkelse (minutter)": "-12",
         "Staff.Læge A": "1", " Ressource.Røntgen (C-bue)": "x"},
        {"Case-ID Anonymous": "7", "Akut case (J/N)": "Nej", "Staff.Læge A": "0"},
        {"Case-ID Anonymous": "8"},
    )
    df = read_completed(spark, path)
    types = dict(df.dtypes)
    assert types["ts_patient_in_or"] == "timestamp_ntz" and types["date"] == "date"
    assert types["is_acute"] == types["staff_lege_a"] == types["resource_rontgen_c_bue"] == "boolean"
    a, b, c = df.orderBy("row_seq").collect()
    assert a.ts_patient_in_or == dt.datetime(2024, 1, 2, 3, 4, 5, 678000)
    assert a.date == dt.date(2024, 1, 2) and a.specialty == "a;b" and a.patient_age == 44
    assert a.delay_minutes == -12
    assert a.ts_or_prep_done is None and a.ts_or_cleaned is None and a.ts_anesthesia_start is None
    assert (a.is_acute, b.is_acute, c.is_acute) == (True, False, None)
    assert (a.staff_lege_a, b.staff_lege_a, c.staff_lege_a) == (True, False, None)
    assert a.resource_rontgen_c_bue is None
    assert [r.case_id for r in (a, b, c)] == ["7", "7", "8"]


def test_headers(spark):
    assert flag_name("Staff.Læge A") == "staff_lege_a"
    assert flag_name(" Ressource.Røntgen (C-bue)") == "resource_rontgen_c_bue"
    assert flag_name("Stue") is None
    twice = spark.createDataFrame([(1, 2)], "`Staff.A B` int, `Staff.A-B` int")
    with pytest.raises(ValueError, match="staff_a_b"):
        rename_columns(twice, {}, flags=True)
    with pytest.raises(ValueError, match="missing"):
        rename_columns(twice, {"Stue": "or_room"})


def test_cancelled(spark, tmp_path):
    header = list(CANCELLED_COLUMNS)
    path = _write(tmp_path / "cancelled.csv", header, [
        ["1", "2024-05-01 08:00:00,000", "P", "Ja", "Nej", "ill", "45.5", "", "S1", "G"],
    ])
    (row,) = read_cancelled(spark, path).collect()
    assert row.scheduled_datetime == dt.datetime(2024, 5, 1, 8)
    assert row.cancelled_after_program_planned is True and row.cancelled_on_day_of_surgery is False
    assert row.is_rebooked is None and row.expected_duration_min == 45.5


def test_mixed_stamps(spark):
    df = spark.createDataFrame(
        [("2024-01-02 03:04:05,678",), ("2024-01-02 03:04:05",), ("2024-01-02",), ("02/01/2024 03:04",), ("x",)], "s string")
    got = [r[0] for r in df.select(parse_ts_mixed(F.col("s"), "dd/MM/yyyy HH:mm")).collect()]
    assert got == [dt.datetime(2024, 1, 2, 3, 4, 5, 678000), dt.datetime(2024, 1, 2, 3, 4, 5),
                   dt.datetime(2024, 1, 2), dt.datetime(2024, 1, 2, 3, 4), None]


def test_write_result(spark, tmp_path):
    out = str(tmp_path / "t")
    write_result(spark.range(5).withColumn("part", F.col("id") % 2), out, ("part",))
    assert spark.read.parquet(out).count() == 5


def test_only_named_partitions_are_replaced(spark, tmp_path):
    out = str(tmp_path / "t")
    rows = spark.range(100).selectExpr("id", "concat('2024-0', 1 + id % 3) AS month")
    write_result(rows, out, ("month",))
    files = lambda month: sorted((p.name, p.stat().st_mtime_ns) for p in (tmp_path / "t" / f"month={month}").iterdir())
    before = {m: files(m) for m in ("2024-01", "2024-02", "2024-03")}
    write_result(spark.createDataFrame([(7, "2024-02")], "id long, month string"), out, ("month",), replace="partitions")
    assert files("2024-01") == before["2024-01"] and files("2024-03") == before["2024-03"]
    assert [r.id for r in spark.read.parquet(out).where("month = '2024-02'").collect()] == [7]
    held = {m: files(m) for m in before}
    bad = spark.range(50, numPartitions=4).selectExpr("IF(id = 49, CAST(raise_error('stop') AS long), id) AS id", "'2024-01' AS month")
    with pytest.raises(Exception, match="stop"):
        write_result(bad, out, ("month",), replace="partitions")
    assert {m: files(m) for m in before} == held
    with pytest.raises(ValueError):
        write_result(rows, out, replace="partitions")


def test_log_to_report(spark, tmp_path):
    """A file goes through loader, deduplication and a report."""
    from slotwise.operators import prepared
    from slotwise.plans.delays import delay_by_prep_bucket

    stamp = "2024-01-02 {}:00,000"
    row = {"Case-ID Anonymous": "1", "Planlagt stue klargøring start": stamp.format("08:00"),
           "Patient på stuen (Planlagt)": stamp.format("08:15"), "Patient på stuen": stamp.format("08:45")}
    path = _completed(tmp_path, row, {**row, "Patient på stuen": stamp.format("09:45")})
    (line,) = delay_by_prep_bucket(prepared(read_completed(spark, path))).collect()
    assert (line.label, line.n, line.mean_start_delay_min) == ("11-20", 1, 30.0)


def test_files_follow_each_other_by_path(spark, tmp_path):
    """The first row of a case is in the first file, also if that file is the smaller one."""
    from slotwise.operators import prepared

    rows = [{"Case-ID Anonymous": "1", "Patient Alder": "10"}], [{"Case-ID Anonymous": str(i % 500), "Patient Alder": "20"} for i in range(3000)]
    for name, part in zip(("2024", "2025"), rows):
        (tmp_path / name).mkdir()
        _completed(tmp_path / name, *part)
    log = read_completed(spark, str(tmp_path / "*/completed.csv"))
    assert log.count() == 3001 and log.select("row_seq").distinct().count() == 3001
    first = prepared(log).where("case_id = '1'").first()
    assert first.patient_age == 10 and first.row_seq == log.agg({"row_seq": "min"}).first()[0]


def test_quoted_line_breaks(spark, tmp_path):
    path = tmp_path / "log.csv"
    path.write_text('Case-ID Anonymous;Speciale\n1;"a\nb"\n2;c\n', encoding="utf-8")
    rows = text_rows(spark, str(path), True).orderBy("row_seq").collect()
    assert [r[2] for r in rows] == ["a\nb", "c"]


@pytest.fixture
def small_splits(spark):
    """Splits of some hundred bytes."""
    old = {k: spark.conf.get(k) for k in ("spark.sql.files.maxPartitionBytes", "spark.sql.files.openCostInBytes")}
    for k in old:
        spark.conf.set(k, "300b")
    yield
    for k, v in old.items():
        spark.conf.set(k, v)


def _plain_csv(path):
    with open(path, encoding="utf-8", newline="") as f:
        return [r for r in csv.reader(f, delimiter=";", strict=True) if r]


def test_thousands_of_files_are_one_scan(spark, tmp_path):
    for i in range(3000):
        (tmp_path / f"{i:05d}.csv").write_text(f"a;b\n{i};x\n{i};y\n")
    rows = text_rows(spark, str(tmp_path))
    plan = rows._jdf.queryExecution().executedPlan().toString()
    assert "Union" not in plan and plan.count("FileScan csv") == 1
    assert [(r.a, r.b) for r in rows.orderBy("row_seq").collect()] == [(str(i), c) for i in range(3000) for c in "xy"]


def test_a_split_file_keeps_its_order(spark, tmp_path, small_splits):
    (tmp_path / "b.csv").write_text("a;b\n" + "".join(f"{i};{'z' * (i % 50)}\n" for i in range(500)))
    (tmp_path / "a.csv").write_text("a;b\nfirst;1\n")
    rows = text_rows(spark, str(tmp_path))
    assert rows.rdd.getNumPartitions() > 5
    assert [r.a for r in rows.orderBy("row_seq").collect()] == ["first", *map(str, range(500))]


def test_another_header_is_an_error(spark, tmp_path):
    (tmp_path / "a.csv").write_text("a;b\n1;2\n")
    (tmp_path / "b.csv").write_text("b;a\n1;2\n")
    for multi_line in (False, True):
        with pytest.raises(Exception, match="header"):
            text_rows(spark, str(tmp_path), multi_line).collect()


def test_line_breaks_at_split_edges(spark, tmp_path, small_splits):
    pick = random.Random(4)
    value = lambda: pick.choice(["", "x", 'say "so"', "one\ntwo", "a;b", "\n", '"\n"', "line\n" * pick.randint(1, 60), "ø" * 20])
    quoted = lambda v: '"' + v.replace('"', '""') + '"' if set(v) & set('";\n') or pick.random() < 0.2 else v
    for name, n in (("a.csv", 300), ("b.csv", 1), ("c.csv", 120)):
        lines = [f"{name}{i};{quoted(value())};{quoted(value())}" for i in range(n)]
        (tmp_path / name).write_text("\n".join(['id;"two\nlines";c', *lines]) + "\n", encoding="utf-8")
    rows = text_rows(spark, str(tmp_path), True)
    assert rows.columns == ["row_seq", "id", "two\nlines", "c"]
    got = [[c or "" for c in r[1:]] for r in rows.orderBy("row_seq").collect()]
    assert got == [r for name in ("a.csv", "b.csv", "c.csv") for r in _plain_csv(tmp_path / name)[1:]]
    assert spark.read.text(str(tmp_path)).rdd.getNumPartitions() > 20
    whole = read_csv(spark, str(tmp_path), True)  # files read by a task each
    assert sorted(map(tuple, got)) == sorted(tuple(c or "" for c in r) for r in whole.collect())


def test_quotes_open_only_at_the_start_of_a_value():
    assert not ends_quoted('5" pipe;x', False) and not ends_quoted('"a""b";c', False)
    assert ends_quoted('a;"b', False) and ends_quoted('a;"b""', False) and not ends_quoted('b";c', True)
    assert ends_quoted('b";"c', True) and not ends_quoted('"a"b"c;d', False) and ends_quoted("plain", True)
