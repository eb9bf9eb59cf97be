"""An operating-room log derived from the generic ``events`` table.

The mapping is arithmetic on the event's own columns, so it runs inside the scan
stage and the log grows with the table: one row per event.
"""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession

# Given to the reader, so no job opens files to infer it.
EVENTS_SCHEMA = "event_id LONG, ts TIMESTAMP_NTZ, user_id LONG, event_type STRING, value DOUBLE"


def read_events(spark: SparkSession, path: str) -> DataFrame:
    return spark.read.schema(EVENTS_SCHEMA).parquet(path)


def _at(start: str, minutes: str) -> str:
    return f"timestampadd(MINUTE, CAST({minutes} AS INT), {start})"


def _cased(condition: str, value: str) -> str:
    return f"CASE WHEN {condition} THEN {value} END"


def case_log(events: DataFrame) -> DataFrame:
    basic = events.selectExpr(
        "event_id AS row_seq",
        "ts AS planned_in",
        "user_id",
        "event_type AS kind",
        "event_id % 3 <> 0 AS sedated",
        "(event_id * event_id) % 97 AS code",
        """CASE WHEN event_id % 10 < 8 THEN 0L WHEN event_id % 20 < 12 THEN 8L
           WHEN event_id % 40 < 38 THEN 15L ELSE 25L END AS allocated""",
        """if(event_id % 3 = 0, 5 + (event_id * 11) % 20, 30 + (event_id * 13) % 40)
           - if(event_id % 211 = 0, 60, 0) AS setup""",
        "30 + CAST(floor(value) AS BIGINT) % 120 AS slot",
        "10 + CAST(floor(value * 0.7D) AS BIGINT) % 150 AS surgery",
        "5 + (event_id * 7) % 25 AS closing",
        "10 + (event_id * 17) % 45 AS room_prep",
    )
    timed = basic.selectExpr(
        "*", "(row_seq * 37) % 61 - 15 + if(allocated = 0, 12, 0) AS late", "setup + surgery + closing AS stay"
    ).selectExpr("*", f"{_cased('row_seq % 89 <> 0', _at('planned_in', 'late'))} AS entered")
    cleaned = "row_seq % 12 >= 7"
    return timed.selectExpr(
        "row_seq",
        "row_seq - if(row_seq % 10 = 9, 1, 0) AS case_id",
        "concat('R', CAST(CAST(floor(user_id / 4.0D) AS BIGINT) AS STRING)) AS or_room",
        "CAST(planned_in AS DATE) AS date",
        f"{_cased('row_seq % 53 <> 0', 'concat(kind, "-", CAST(user_id % 6 AS STRING))')} AS specialty",
        "row_seq % 5 = 0 AS is_acute",
        "row_seq % 100 AS patient_age",
        "concat('PROC ', CAST(code AS STRING), ' [K', CAST(code AS STRING), ']') AS procedure_text_id",
        "concat('DG', CAST(code % 9 AS STRING)) AS diagnosis_group",
        f"{_at('planned_in', '-allocated')} AS ts_or_prep_planned_start",
        f"{_at('entered', '-room_prep')} AS ts_or_prep_start",
        f"{_at('entered', '-if(row_seq % 8 < 5, room_prep, row_seq % 9)')} AS ts_or_prep_done",
        "planned_in AS ts_patient_in_or_planned",
        "entered AS ts_patient_in_or",
        f"{_cased('sedated', _at('entered', '2'))} AS ts_anesthesia_start",
        f"{_cased('sedated AND row_seq % 7 <> 0', _at('entered', '2 + row_seq % 25'))} AS ts_anesthesia_ready",
        f"{_at('entered', 'setup')} AS ts_procedure_start",
        f"{_at('entered', 'setup + surgery')} AS ts_procedure_end",
        f"{_at('planned_in', 'slot')} AS ts_patient_leaves_or_planned",
        f"{_at('entered', 'stay')} AS ts_patient_leaves_or",
        f"{_at('planned_in', 'slot + if(sedated, 15, 0)')} AS ts_or_cleaned_planned",
        f"{_cased(cleaned, _at('entered', 'stay + row_seq % 6'))} AS ts_or_cleaning_start",
        f"{_cased(cleaned, _at('entered', 'stay + row_seq % 6 + if(row_seq % 5 < 4, 0, 12)'))} AS ts_or_cleaned",
        f"{_cased('entered IS NOT NULL', 'late')} AS delay_minutes",
        f"{_cased('entered IS NOT NULL', 'late + stay - slot')} AS overtime_minutes",
        f"""{_cased('entered IS NOT NULL AND late > 0 AND row_seq % 4 <> 0',
                    "concat('REASON ', CAST((row_seq * row_seq) % 13 AS STRING))")} AS delay_reason""",
        "true AS staff_a",
        "sedated AS staff_b",
        "row_seq % 2 = 0 AS staff_c",
        "code > 40 AS staff_d",
        f"{_cased('row_seq % 17 <> 0', 'setup > 40')} AS staff_e",
        "code > 60 AS resource_a",
        "row_seq % 7 = 0 AS resource_b",
        "surgery > 60 AS resource_c",
        "row_seq % 4 = 1 AS resource_d",
    )
