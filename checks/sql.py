"""The queries of ``entries`` as SQL on the driver tables, written independently.

Every statement starts from the ``events`` view. Fractions are rounded to six
decimals on both sides; ``+ 0.0`` turns minus zero into zero. Dates are text.
"""

from __future__ import annotations

CUTOFF = "DATE '2024-01-21'"
MONTH_END = "DATE '2024-01-31'"
EXCLUDED = "('error-0', 'view-5')"

LOG = """
b AS (
 SELECT event_id AS e, ts, user_id AS u, event_type AS et, value AS v, event_id % 3 AS m3 FROM events),
k AS (SELECT *,
  CASE WHEN e % 10 < 8 THEN 0 WHEN e % 20 < 12 THEN 8 WHEN e % 40 < 38 THEN 15 ELSE 25 END AS pp,
  CASE WHEN m3 = 0 THEN 5 + (e * 11) % 20 ELSE 30 + (e * 13) % 40 END - CASE WHEN e % 211 = 0 THEN 60 ELSE 0 END AS w2,
  30 + CAST(FLOOR(v) AS BIGINT) % 120 AS pin,
  10 + CAST(FLOOR(v * 0.7) AS BIGINT) % 150 AS proc,
  5 + (e * 7) % 25 AS post FROM b),
d AS (SELECT *, (e * 37) % 61 - 15 + CASE WHEN pp = 0 THEN 12 ELSE 0 END AS sd FROM k),
t AS (SELECT *, CASE WHEN e % 89 = 0 THEN NULL ELSE ts + sd * INTERVAL '1' MINUTE END AS in_or FROM d),
log AS (
SELECT e AS row_seq, e - CASE WHEN e % 10 = 9 THEN 1 ELSE 0 END AS case_id,
 CONCAT('R', CAST(CAST(FLOOR(u / 4.0) AS BIGINT) AS VARCHAR)) AS or_room, CAST(ts AS DATE) AS date,
 CASE WHEN e % 53 = 0 THEN NULL ELSE CONCAT(et, '-', CAST(u % 6 AS VARCHAR)) END AS specialty,
 e % 5 = 0 AS is_acute, e % 100 AS patient_age,
 CONCAT('PROC ', CAST((e * e) % 97 AS VARCHAR), ' [K', CAST((e * e) % 97 AS VARCHAR), ']') AS procedure_text_id,
 CONCAT('DG', CAST((e * e) % 97 % 9 AS VARCHAR)) AS diagnosis_group,
 ts - pp * INTERVAL '1' MINUTE AS ts_or_prep_planned_start,
 in_or - (10 + (e * 17) % 45) * INTERVAL '1' MINUTE AS ts_or_prep_start,
 in_or - CASE WHEN e % 8 < 5 THEN 10 + (e * 17) % 45 ELSE e % 9 END * INTERVAL '1' MINUTE AS ts_or_prep_done,
 ts AS ts_patient_in_or_planned, in_or AS ts_patient_in_or,
 CASE WHEN m3 = 0 THEN NULL ELSE in_or + 2 * INTERVAL '1' MINUTE END AS ts_anesthesia_start,
 CASE WHEN m3 = 0 OR e % 7 = 0 THEN NULL ELSE in_or + (2 + e % 25) * INTERVAL '1' MINUTE END AS ts_anesthesia_ready,
 in_or + w2 * INTERVAL '1' MINUTE AS ts_procedure_start,
 in_or + (w2 + proc) * INTERVAL '1' MINUTE AS ts_procedure_end,
 ts + pin * INTERVAL '1' MINUTE AS ts_patient_leaves_or_planned,
 in_or + (w2 + proc + post) * INTERVAL '1' MINUTE AS ts_patient_leaves_or,
 ts + (pin + CASE WHEN m3 = 0 THEN 0 ELSE 15 END) * INTERVAL '1' MINUTE AS ts_or_cleaned_planned,
 CASE WHEN e % 12 < 7 THEN NULL ELSE in_or + (w2 + proc + post + e % 6) * INTERVAL '1' MINUTE END AS ts_or_cleaning_start,
 CASE WHEN e % 12 < 7 THEN NULL ELSE in_or + (w2 + proc + post + e % 6 + CASE WHEN e % 5 < 4 THEN 0 ELSE 12 END) * INTERVAL '1' MINUTE END AS ts_or_cleaned,
 CASE WHEN in_or IS NULL THEN NULL ELSE sd END AS delay_minutes,
 CASE WHEN in_or IS NULL THEN NULL ELSE sd + (w2 + proc + post) - pin END AS overtime_minutes,
 CASE WHEN in_or IS NOT NULL AND sd > 0 AND e % 4 <> 0 THEN CONCAT('REASON ', CAST((e * e) % 13 AS VARCHAR)) END AS delay_reason,
 TRUE AS staff_a, m3 <> 0 AS staff_b, e % 2 = 0 AS staff_c, (e * e) % 97 > 40 AS staff_d,
 CASE WHEN e % 17 = 0 THEN NULL ELSE w2 > 40 END AS staff_e,
 (e * e) % 97 > 60 AS resource_a, e % 7 = 0 AS resource_b, proc > 60 AS resource_c, e % 4 = 1 AS resource_d
FROM t),
cases AS (SELECT * EXCLUDE (rn) FROM (
 SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY row_seq) AS rn FROM log) WHERE rn = 1)"""

SPANS = {
    "planned_prep": ("ts_or_prep_planned_start", "ts_patient_in_or_planned"),
    "actual_prep": ("ts_or_prep_start", "ts_patient_in_or"),
    "delay": ("ts_patient_in_or_planned", "ts_patient_in_or"),
    "w2": ("ts_patient_in_or", "ts_procedure_start"),
    "surgery": ("ts_procedure_start", "ts_procedure_end"),
    "post": ("ts_procedure_end", "ts_patient_leaves_or"),
    "actual_inor": ("ts_patient_in_or", "ts_patient_leaves_or"),
    "planned_inor": ("ts_patient_in_or_planned", "ts_patient_leaves_or_planned"),
    "room_overrun": ("ts_patient_leaves_or_planned", "ts_patient_leaves_or"),
    "proc_overrun": ("ts_patient_leaves_or_planned", "ts_procedure_end"),
    "planned_cleaning": ("ts_patient_leaves_or_planned", "ts_or_cleaned_planned"),
    "actual_cleaning": ("ts_or_cleaning_start", "ts_or_cleaned"),
    "to_ready": ("ts_anesthesia_start", "ts_anesthesia_ready"),
    "to_knife": ("ts_anesthesia_ready", "ts_procedure_start"),
}


def _mins(start: str, end: str) -> str:
    return f"date_sub('minute', {start}, {end})"


_FLAGS = """
 (CAST(staff_a AS INT) + CAST(staff_b AS INT) + CAST(staff_c AS INT) + CAST(staff_d AS INT) + coalesce(CAST(staff_e AS INT), 0)) AS staff_count,
 (CAST(resource_a AS INT) + CAST(resource_b AS INT) + CAST(resource_c AS INT) + CAST(resource_d AS INT)) AS resource_count,
 ts_anesthesia_start IS NOT NULL AS anes,
 trim(regexp_replace(procedure_text_id, '\\s*\\[.*\\]', '')) AS procedure_name"""

# m: whole minutes; s: whole seconds over 60; lm: whole minutes on raw rows;
# v: the surgical set; vp: with places; lk: the prep lookup; pv: with predictions.
MEASURED = f"""
m0 AS (SELECT *, {', '.join(f'{_mins(a, b)} AS {n}' for n, (a, b) in SPANS.items())}, {_FLAGS} FROM cases),
m AS (SELECT *, actual_prep - planned_prep AS prep_gap, actual_inor - planned_inor AS inor_gap FROM m0),
s AS (SELECT * REPLACE ({', '.join(f"date_sub('second', {a}, {b}) / 60.0 AS {n}" for n, (a, b) in SPANS.items())}) FROM m),
v0 AS (SELECT * REPLACE (
  CASE WHEN planned_prep >= 0 THEN planned_prep END AS planned_prep,
  CASE WHEN actual_prep >= 0 THEN actual_prep END AS actual_prep,
  CASE WHEN planned_inor >= 0 THEN planned_inor END AS planned_inor,
  CASE WHEN actual_inor >= 0 THEN actual_inor END AS actual_inor) FROM m),
v AS (SELECT * REPLACE (actual_prep - planned_prep AS prep_gap, actual_inor - planned_inor AS inor_gap) FROM v0
  WHERE abs(actual_prep - planned_prep) < 300 AND abs(actual_inor - planned_inor) < 300
   AND ts_or_prep_start <> ts_or_prep_done AND specialty NOT IN {EXCLUDED}),
vp0 AS (SELECT *, row_number() OVER w AS position, count(*) OVER (PARTITION BY or_room, date) AS day_size
  FROM v WINDOW w AS (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq)),
vp AS (SELECT *, position = 1 AS is_first, position = day_size AS is_last FROM vp0),
lk AS (SELECT specialty, anes, sum(w2) / count(*) AS lookup_prep, count(*) AS n FROM s
  WHERE w2 BETWEEN 0 AND 240 AND specialty IS NOT NULL GROUP BY 1, 2),
pv AS (SELECT vp.*, lk.lookup_prep AS predicted FROM vp LEFT JOIN lk USING (specialty, anes)),
sl AS (SELECT s.*, lk.lookup_prep FROM s LEFT JOIN lk ON s.specialty = lk.specialty AND s.anes = lk.anes)"""


def _corr(x: str, y: str) -> str:
    both = f"{x} IS NOT NULL AND {y} IS NOT NULL"
    return (
        f"covar_pop({y}, {x}) / nullif(stddev_pop(CASE WHEN {both} THEN {x} END)"
        f" * stddev_pop(CASE WHEN {both} THEN {y} END), 0)"
    )


def _pct(condition: str) -> str:
    return f"avg(CAST({condition} AS INT)) * 100"


def _nearest(x: str, q: float) -> str:
    """The value at the rounded index of the sorted values."""
    return f"list_sort(list({x}) FILTER ({x} IS NOT NULL))[CAST(round({q} * (count({x}) - 1)) AS BIGINT) + 1]"


def _dist(x: str, quantiles: dict[str, float], linear: bool = False) -> str:
    qs = ", ".join(
        f"{f'quantile_cont({x}, {q})' if linear else _nearest(x, q)} AS {n}" for n, q in quantiles.items()
    )
    return f"count({x}) AS n, avg({x}) AS mean, median({x}) AS median" + (", " + qs if qs else "")


QUARTILES = {"p25": 0.25, "p75": 0.75, "p90": 0.9}


def _q(body: str, keep: str = "", longs: str = "", floats: str = "", ctes: str = "") -> str:
    """A full statement: keep, cast and round the columns of ``body``."""
    dates = ("date", "first_date", "last_date")
    columns = [f"CAST({c} AS VARCHAR) AS {c}" if c in dates else c for c in keep.split()]
    columns += [*[f"CAST({c} AS BIGINT) AS {c}" for c in longs.split()]]
    columns += [f"round(CAST({c} AS DOUBLE), 6) + 0.0 AS {c}" for c in floats.split()]
    more = f",\n{ctes}" if ctes else ""
    return f"WITH {LOG},{MEASURED}{more}\nSELECT {', '.join(columns)} FROM (\n{body}\n) AS result"


def _bucket(x: str, bounds: tuple[int, ...], floor: bool = True) -> str:
    whens = " ".join(f"WHEN {x} <= {b} THEN {i}" for i, b in enumerate(bounds))
    low = f"WHEN {x} < 0 THEN NULL " if floor else ""
    return f"CASE WHEN {x} IS NULL THEN NULL {low}{whens} ELSE {len(bounds)} END"


def _label(bucket: str, labels: tuple[str, ...]) -> str:
    return "CASE " + bucket + " " + " ".join(f"WHEN {i} THEN '{t}'" for i, t in enumerate(labels)) + " END"


PREP = (0, 10, 20)
PREP_LABELS = ("0", "1-10", "11-20", "20+")
BUFFER = (0, 10, 20, 30, 45)
BUFFER_LABELS = ("0", "1-10", "11-20", "21-30", "31-45", "45+")
DELAY = (0, 15, 30, 60)
DELAY_LABELS = ("on time", "1-15", "16-30", "31-60", "60+")

PLACES = """
ct AS (SELECT * FROM cases WHERE ts_patient_in_or_planned IS NOT NULL AND ts_patient_in_or IS NOT NULL
  AND delay_minutes IS NOT NULL),
cp AS (SELECT *, row_number() OVER w AS case_position,
  count(*) OVER (PARTITION BY or_room, date) AS cases_in_day FROM ct
  WINDOW w AS (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq)),
ends AS (SELECT or_room, date, max(CASE WHEN case_position = 1 THEN delay_minutes END) AS first_delay,
  max(CASE WHEN case_position = cases_in_day THEN delay_minutes END) AS last_delay, count(*) AS n_cases,
  avg(CASE WHEN case_position > 1 THEN delay_minutes END) AS mean_later FROM cp GROUP BY 1, 2)"""

TURN = f"""
mv AS (SELECT *, lag(ts_patient_leaves_or) OVER w AS pl, lag(ts_or_cleaning_start) OVER w AS pcs,
  lag(ts_or_cleaned) OVER w AS pc FROM m WHERE ts_patient_leaves_or IS NOT NULL AND ts_patient_in_or IS NOT NULL
  WINDOW w AS (PARTITION BY or_room, date ORDER BY ts_patient_in_or, row_seq)),
ta AS (SELECT *, {_mins('pl', 'ts_patient_in_or')} AS turnaround_min,
  {_mins('pl', 'pcs')} AS wait_before_cleaning_min, {_mins('pcs', 'pc')} AS cleaning_min,
  {_mins('pc', 'ts_patient_in_or')} AS post_cleaning_gap_min FROM mv
  WHERE {_mins('pl', 'ts_patient_in_or')} BETWEEN 0 AND 180),
idle0 AS (SELECT *, {_mins('pc', 'ts_or_prep_start')} AS gap_before_prep_min,
  {_mins('ts_or_prep_start', 'ts_or_prep_done')} AS room_prep_min,
  {_mins('ts_or_prep_done', 'ts_patient_in_or')} AS gap_after_prep_min FROM ta),
idle AS (SELECT * FROM idle0 WHERE gap_before_prep_min BETWEEN -5 AND 120 AND room_prep_min BETWEEN 0 AND 120
  AND gap_after_prep_min BETWEEN -5 AND 120)"""

BUFF = f"""
bf0 AS (SELECT *, lag(ts_patient_leaves_or_planned) OVER w AS plp, lag(ts_patient_leaves_or) OVER w AS pl FROM m
  WHERE ts_patient_in_or_planned IS NOT NULL AND ts_patient_leaves_or_planned IS NOT NULL
   AND ts_patient_in_or IS NOT NULL AND ts_patient_leaves_or IS NOT NULL
  WINDOW w AS (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq)),
bf AS (SELECT *, {_mins('plp', 'ts_patient_in_or_planned')} AS planned_buffer_min,
  {_mins('pl', 'ts_patient_in_or')} AS turnaround_min, delay AS entry_delay_min FROM bf0
  WHERE {_mins('plp', 'ts_patient_in_or_planned')} BETWEEN 0 AND 120
   AND {_mins('pl', 'ts_patient_in_or')} BETWEEN 0 AND 180)"""

IDLE_MEANS = """avg(gap_before_prep_min) AS mean_gap_before_prep, avg(room_prep_min) AS mean_room_prep,
 avg(gap_after_prep_min) AS mean_gap_after_prep, avg(gap_before_prep_min + gap_after_prep_min) AS mean_wasted,
 avg(turnaround_min) AS mean_turnaround, count(*) AS n_pairs"""
IDLE_FLOATS = "mean_gap_before_prep mean_room_prep mean_gap_after_prep mean_wasted mean_turnaround"

GAPS = """
g AS (SELECT *, procedure_text_id AS procedure FROM m WHERE abs(prep_gap) < 300 AND abs(inor_gap) < 300),
gp AS (SELECT procedure, count(*) AS n, avg(prep_gap) AS mean_prep_gap, avg(inor_gap) AS mean_inor_gap,
  avg(planned_prep) AS mean_planned_prep, avg(staff_count) AS mean_staff, avg(resource_count) AS mean_resources
  FROM g WHERE procedure IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)"""
SIGNAL = f"""
sig AS (SELECT 'staff_count' AS predictor, {_corr('mean_staff', 'mean_prep_gap')} AS r_actual,
  {_corr('mean_staff', 'mean_planned_prep')} AS r_planned FROM gp
 UNION ALL SELECT 'resource_count', {_corr('mean_resources', 'mean_prep_gap')},
  {_corr('mean_resources', 'mean_planned_prep')} FROM gp)"""

PHASED = """
ph AS (SELECT *, actual_inor - planned_inor AS slot_gap FROM m WHERE w2 BETWEEN 0 AND 240 AND surgery BETWEEN 0 AND 600
  AND post BETWEEN 0 AND 240 AND planned_inor BETWEEN 0 AND 600),
pp50 AS (SELECT procedure_text_id, count(*) AS n, avg(w2) AS mean_prep, avg(surgery) AS mean_procedure,
  avg(post) AS mean_post, avg(planned_inor) AS mean_planned, avg(staff_count) AS mean_staff,
  avg(resource_count) AS mean_resources FROM ph WHERE procedure_text_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)"""
PHASE_MEANS = """avg(w2) AS mean_prep, avg(surgery) AS mean_procedure, avg(post) AS mean_post,
 avg(actual_inor) AS mean_actual, avg(planned_inor) AS mean_planned, count(*) AS n_cases"""
PHASE_FLOATS = "mean_prep mean_procedure mean_post mean_actual mean_planned"

COMPARED = """
pc0 AS (SELECT procedure_name, count(*) AS n, avg(planned_prep) AS planned_prep, avg(actual_prep) AS actual_prep,
  avg(prep_gap) AS prep_gap, avg(planned_inor) AS planned_surgery, avg(actual_inor) AS actual_surgery,
  avg(inor_gap) AS surgery_gap FROM v GROUP BY 1 HAVING count(*) >= 50),
pc AS (SELECT *, abs(round(prep_gap, 1)) > abs(round(surgery_gap, 1)) AS prep_worse,
  round(planned_prep, 1) = 0 AS zero_planned FROM pc0)"""

DAYS = f"""
ld AS (SELECT * FROM vp WHERE day_size >= 3),
dc0 AS (SELECT or_room, date, round({_corr('position', 'delay')}, 9) AS position_delay_corr,
  max(CASE WHEN is_first THEN delay END) AS first_case_delay,
  max(CASE WHEN is_first THEN prep_gap END) AS first_case_prep_gap, avg(delay) AS mean_day_delay,
  max(CASE WHEN is_last THEN room_overrun END) AS last_case_finish_delay, max(day_size) AS n_cases,
  max(CASE WHEN is_first THEN specialty END) AS specialty FROM ld GROUP BY 1, 2),
dc AS (SELECT *, CASE WHEN position_delay_corr > 0.5 THEN 'Cascading' WHEN position_delay_corr < -0.2 THEN 'Recovery'
  ELSE 'One-time shock' END AS day_type FROM dc0 WHERE position_delay_corr IS NOT NULL AND first_case_delay IS NOT NULL
  AND first_case_prep_gap IS NOT NULL AND last_case_finish_delay IS NOT NULL AND specialty IS NOT NULL),
ex AS (SELECT or_room, date, day_type FROM (SELECT *, row_number() OVER (PARTITION BY day_type ORDER BY
   CASE day_type WHEN 'Cascading' THEN position_delay_corr WHEN 'Recovery' THEN -position_delay_corr
   ELSE -abs(position_delay_corr) END DESC, date, or_room) AS rn FROM dc WHERE n_cases >= 4) WHERE rn = 1),
exc AS (SELECT ld.*, ex.day_type FROM ld JOIN ex USING (or_room, date))"""

REPLAY = """
bn AS (SELECT *, least(predicted, actual_prep) AS benefit FROM pv),
cd AS (SELECT *, CASE WHEN delay IS NOT NULL AND sum(benefit) OVER w IS NOT NULL
   THEN greatest(delay - sum(benefit) OVER w, 0) END AS corrected_delay FROM bn
  WINDOW w AS (PARTITION BY or_room, date ORDER BY position ROWS UNBOUNDED PRECEDING))"""


def _replay(planned: str) -> str:
    return f"""
rp0 AS (SELECT *, greatest(CAST({planned} AS DOUBLE), 0) AS alloc_prep,
  CAST(CASE WHEN planned_inor > 0 THEN planned_inor ELSE 35 END AS DOUBLE) AS alloc_inor,
  CAST(CASE WHEN actual_inor > 0 THEN actual_inor ELSE 35 END AS DOUBLE) AS real_inor FROM pv),
rp1 AS (SELECT *, coalesce(sum(alloc_prep + alloc_inor) OVER w, 0) AS alloc_start,
  coalesce(sum(CASE WHEN actual_prep > 0 THEN actual_prep ELSE 0 END + real_inor) OVER w, 0) AS actual_start FROM rp0
  WINDOW w AS (PARTITION BY or_room, date ORDER BY position ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING)),
rp2 AS (SELECT *, greatest(least(real_inor, alloc_start + alloc_prep + alloc_inor - (actual_start + actual_prep)), 0)
   AS inor_within FROM rp1),
rp AS (SELECT or_room, date, position, case_id, procedure_name, alloc_start, alloc_prep, alloc_inor, actual_start,
  least(actual_prep, alloc_prep) AS prep_within, greatest(actual_prep - alloc_prep, 0) AS prep_outside, inor_within,
  greatest(real_inor - inor_within, 0) AS inor_outside, actual_start - alloc_start AS minutes_late,
  actual_start + actual_prep + real_inor AS finish FROM rp2)"""


REPLAY_FLOATS = ("alloc_start alloc_prep alloc_inor actual_start prep_within prep_outside inor_within"
                 " inor_outside minutes_late finish")


def _bucket_report(value: str, out: str, extra: str = "") -> str:
    more = f", {extra}" if extra else ""
    return f"""SELECT bucket, {_label('bucket', PREP_LABELS)} AS label, n, mean_{out}, pct_of_total{', pct_late, pct_late_15' if extra else ''} FROM (
 SELECT {_bucket('planned_prep', PREP)} AS bucket, count(*) AS n, avg({value}) AS mean_{out},
  count(*) * 100.0 / sum(count(*)) OVER () AS pct_of_total{more}
 FROM s WHERE planned_prep IS NOT NULL AND {value} IS NOT NULL GROUP BY 1) WHERE bucket IS NOT NULL"""


def _density(source: str, key: str, value: str, points: int, lo: str, hi: str, factor: str) -> str:
    """Kernel sums per grid point over rows ``key``, ``value`` of ``source``."""
    return f"""
kc AS (SELECT {key} AS key, CAST({value} AS DOUBLE) AS x, count(*) AS c FROM {source} GROUP BY 1, 2),
kg AS (SELECT key, sum(c) AS n, min(x) AS lo, max(x) AS hi,
  sqrt((sum(x * x * c) - sum(x * c) * sum(x * c) / sum(c)) / (sum(c) - 1)) AS sd FROM kc GROUP BY 1),
kh AS (SELECT *, sd * {factor} AS h, {lo} AS glo, {hi} AS ghi FROM kg),
kd AS (SELECT kh.key, p.point, kh.glo + p.point * (kh.ghi - kh.glo) / {points - 1} AS gx,
  sum(kc.c * exp(-0.5 * power((kh.glo + p.point * (kh.ghi - kh.glo) / {points - 1} - kc.x) / kh.h, 2))
   / (kh.n * kh.h * sqrt(2 * pi()))) AS density
  FROM kh JOIN kc USING (key) CROSS JOIN (SELECT unnest(range({points})) AS point) AS p GROUP BY 1, 2, 3)"""


def _density_split(value: str) -> str:
    ctes = f"""
dr AS (SELECT {value} AS val, planned_prep FROM s WHERE planned_prep IS NOT NULL AND {value} BETWEEN -60 AND 120),
dp AS (SELECT 'all' AS part, val FROM dr UNION ALL SELECT 'zero prep', val FROM dr WHERE planned_prep = 0
 UNION ALL SELECT 'has prep', val FROM dr WHERE planned_prep > 0),{_density('dp', 'part', 'val', 500, '-60.0', '120.0', '0.15')}"""
    return _q(
        "SELECT key AS part, point, gx AS x, density * kg.n / (SELECT count(*) FROM dr) AS density"
        " FROM kd JOIN kg USING (key)",
        "part", "point", "x density", ctes,
    )


def _hist(source: str, x: str, bins: int, tag: str = "", where: str = "TRUE") -> str:
    """Rows bin, bin_start, bin_end, n of equal-width bins between min and max."""
    return f"""SELECT r.bin, lo + r.bin * ((hi - lo) / {bins}) AS bin_start, lo + (r.bin + 1) * ((hi - lo) / {bins}) AS bin_end,
 count(x) AS n{tag} FROM (SELECT CAST(unnest(range({bins})) AS BIGINT) AS bin) AS r
 CROSS JOIN (SELECT CAST(min({x}) AS DOUBLE) AS lo, CAST(max({x}) AS DOUBLE) AS hi FROM {source} WHERE {where}) AS e
 LEFT JOIN (SELECT CAST({x} AS DOUBLE) AS x FROM {source} WHERE {where}) AS d
  ON least(CAST(floor((d.x - lo) * {bins} / (hi - lo)) AS BIGINT), {bins - 1}) = r.bin
 WHERE lo IS NOT NULL GROUP BY r.bin, lo, hi"""


def _before_after(value: str) -> str:
    new = f"({value} - (lookup_prep - planned_prep))"
    return f"""SELECT count(*) AS n, avg({value}) AS mean_before, avg({new}) AS mean_after,
 {_pct(f'{value} > 0')} AS pct_late_before, {_pct(f'{new} > 0')} AS pct_late_after,
 {_pct(f'{value} > 15')} AS pct_late_15_before, {_pct(f'{new} > 15')} AS pct_late_15_after,
 count(*) FILTER ({value} > 0) - count(*) FILTER ({new} > 0) AS n_removed
 FROM sl WHERE {value} IS NOT NULL AND {new} IS NOT NULL"""


BEFORE_AFTER_FLOATS = ("mean_before mean_after pct_late_before pct_late_after pct_late_15_before"
                       " pct_late_15_after")


def _fit(source: str, keys: str, y: str, where: str = "TRUE") -> str:
    return f"""SELECT sum(n) AS n, count(*) AS n_groups, 1 - sum(sse) / nullif(max(sst), 0) AS r2 FROM (
 SELECT count(*) AS n, count(*) * var_pop({y}) AS sse,
  (SELECT count(*) * var_pop({y}) FROM {source} WHERE {y} IS NOT NULL AND {where}) AS sst
 FROM {source} WHERE {y} IS NOT NULL AND {where} GROUP BY {keys})"""


def _feature_r2(y: str) -> str:
    sets = (("procedure_text_id",), ("specialty",), ("diagnosis_group",), ("anes",), ("specialty", "anes"),
            ("procedure_text_id", "specialty"))
    lines = [
        f"SELECT '{' + '.join(s).replace('anes', 'has_anesthesia')}' AS features, * FROM ({_fit('m', ', '.join(s), y)})"
        for s in sets
    ]
    return " UNION ALL ".join(lines)


def _residual_r(x: str) -> str:
    return _corr("res", x)


WHATIF_DAYS = """
un AS (SELECT * FROM sl WHERE lookup_prep IS NOT NULL AND planned_prep = 0 AND w2 IS NOT NULL
  AND surgery BETWEEN 20 AND 180 AND hour(ts_patient_in_or_planned) BETWEEN 0 AND 23),
uf AS (SELECT * FROM un WHERE proc_overrun BETWEEN 10 AND 90 AND delay IS NOT NULL AND lookup_prep > 20),
ud AS (SELECT or_room, date, count(*) AS n_cases, avg(proc_overrun) AS mean_overrun, avg(delay) AS mean_start_delay
  FROM uf GROUP BY 1, 2 HAVING count(*) BETWEEN 2 AND 4 AND avg(proc_overrun) > 15 AND avg(proc_overrun) < 90),
uh AS (SELECT * FROM (SELECT uf.*, row_number() OVER (PARTITION BY or_room, date
   ORDER BY ts_patient_in_or_planned, row_seq) AS rn FROM uf SEMI JOIN ud USING (or_room, date)) WHERE rn <= 3),
ug AS (SELECT or_room, date, date_sub('second', lag(ts_patient_leaves_or_planned) OVER w, ts_patient_in_or_planned)
   / 60.0 >= lag(lookup_prep) OVER w AS fits FROM uh
  WINDOW w AS (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq)),
fd AS (SELECT ud.* FROM ud SEMI JOIN (SELECT or_room, date FROM ug GROUP BY 1, 2
  HAVING coalesce(bool_and(fits), TRUE)) AS ok USING (or_room, date))"""


def build() -> dict[str, str]:
    q: dict[str, str] = {}

    # --- delays
    position = f"""SELECT CASE WHEN case_position >= 5 THEN '5+' ELSE CAST(case_position AS VARCHAR) END AS position_label,
 avg(delay_minutes) AS mean_delay, median(delay_minutes) AS median_delay, {_pct('delay_minutes > 0')} AS pct_delayed,
 count(*) AS n_cases FROM %s GROUP BY 1"""
    floats = "mean_delay median_delay pct_delayed"
    q["delay_by_position"] = _q(position % "cp", "position_label", "n_cases", floats, PLACES)
    q["delay_by_position_all"] = _q(
        position % "(SELECT * FROM ca WHERE ts_patient_in_or IS NOT NULL AND delay_minutes IS NOT NULL)",
        "position_label", "n_cases", floats,
        """ca AS (SELECT *, row_number() OVER (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq)
 AS case_position FROM cases WHERE ts_patient_in_or_planned IS NOT NULL)""",
    )
    q["cascade_correlation"] = _q(
        f"""SELECT count(*) AS n_days, {_corr('first_delay', 'mean_later')} AS r,
 {_pct('mean_later > first_delay')} AS pct_later_worse FROM ends WHERE n_cases >= 3""",
        "", "n_days", "r pct_later_worse", PLACES,
    )
    q["worst_cascade_days"] = _q(
        """SELECT or_room, date, n_cases, first_delay, last_delay, last_delay - first_delay AS cascade_gap
 FROM ends WHERE n_cases >= 3 ORDER BY cascade_gap DESC, date, or_room LIMIT 10""",
        "or_room date", "n_cases first_delay last_delay cascade_gap", "", PLACES,
    )
    own = """own AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY case_id ORDER BY row_seq) AS rn
 FROM log WHERE specialty = 'click-0') WHERE rn = 1)"""
    reasons = """SELECT delay_reason, count(*) AS n_cases, avg(delay_minutes) AS mean_delay,
 sum(delay_minutes) / 60.0 AS hours_lost, count(*) * 100.0 / sum(count(*)) OVER () AS pct_of_delayed
 FROM %s WHERE delay_minutes > 0 AND delay_reason IS NOT NULL GROUP BY 1 ORDER BY %s DESC, delay_reason LIMIT %d"""
    cols = ("delay_reason", "n_cases", "mean_delay hours_lost pct_of_delayed")
    q["top_delay_reasons"] = _q(reasons % ("cases", "n_cases", 15), *cols)
    q["one_specialty_reasons"] = _q(reasons % ("own", "n_cases", 15), *cols, own)
    q["time_lost_by_reason"] = _q(
        reasons % ("cases", "hours_lost", 10), "delay_reason", "n_cases", "mean_delay hours_lost"
    )
    q["top_reason_per_specialty"] = _q(
        """SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY specialty ORDER BY n_cases DESC, delay_reason) AS rn
 FROM (SELECT specialty, delay_reason, count(*) AS n_cases, avg(delay_minutes) AS mean_delay FROM cases
  WHERE delay_minutes > 0 AND delay_reason IS NOT NULL GROUP BY 1, 2)) WHERE rn = 1""",
        "specialty delay_reason", "n_cases", "mean_delay",
    )

    # --- turnaround
    parts = "turnaround_min wait_before_cleaning_min cleaning_min post_cleaning_gap_min"
    q["turnaround_pairs"] = _q("SELECT * FROM ta", "or_room date specialty", f"case_id {parts}", "", TURN)
    q["turnaround_distribution"] = _q(
        f"SELECT {_dist('turnaround_min', QUARTILES)} FROM ta", "", "n", "mean median p25 p75 p90", TURN)
    q["turnaround_distribution_linear"] = _q(
        f"SELECT {_dist('turnaround_min', QUARTILES, True)} FROM ta", "", "n", "mean median p25 p75 p90", TURN)
    q["turnaround_components"] = _q(
        f"""SELECT avg(wait_before_cleaning_min) AS mean_wait_before_cleaning, avg(cleaning_min) AS mean_cleaning,
 avg(post_cleaning_gap_min) AS mean_post_cleaning_gap,
 {_pct('wait_before_cleaning_min IS NOT NULL')} AS cleaning_coverage_pct FROM ta""",
        "", "", "mean_wait_before_cleaning mean_cleaning mean_post_cleaning_gap cleaning_coverage_pct", TURN)
    q["turnaround_by_specialty"] = _q(
        """SELECT specialty, avg(turnaround_min) AS mean_turnaround, median(turnaround_min) AS median_turnaround,
 avg(post_cleaning_gap_min) AS mean_post_cleaning_gap, count(*) AS n_pairs FROM ta GROUP BY 1 HAVING count(*) >= 5""",
        "specialty", "n_pairs", "mean_turnaround median_turnaround mean_post_cleaning_gap", TURN)
    q["turnaround_sketched"] = _q(
        """SELECT specialty, count(*) AS n, avg(turnaround_min) AS mean, quantile_disc(turnaround_min, 0.25) AS p25,
 quantile_disc(turnaround_min, 0.5) AS median, quantile_disc(turnaround_min, 0.75) AS p75, quantile_disc(turnaround_min, 0.9) AS p90
 FROM ta GROUP BY 1""", "specialty", "n", "mean p25 median p75 p90", TURN)
    q["turnaround_bins"] = _q(
        """SELECT bin, bin * 20 AS bin_start, bin * 20 + 20 AS bin_end, n FROM tb
 UNION ALL SELECT prev + 1, prev * 20 + 20, bin * 20, 0 FROM (SELECT bin, coalesce(lag(bin) OVER (ORDER BY bin), -1) AS prev FROM tb) WHERE bin > prev + 1""",
        "", "bin n", "bin_start bin_end", TURN + ",\ntb AS (SELECT turnaround_min // 20 AS bin, count(*) AS n FROM ta GROUP BY 1)")
    q["idle_pairs"] = _q(
        "SELECT * FROM idle", "or_room date specialty",
        "case_id turnaround_min gap_before_prep_min room_prep_min gap_after_prep_min", "", TURN)
    q["idle_breakdown"] = _q(f"SELECT {IDLE_MEANS} FROM idle", "", "n_pairs", IDLE_FLOATS, TURN)
    q["idle_by_specialty"] = _q(
        f"SELECT specialty, {IDLE_MEANS} FROM idle GROUP BY 1 HAVING count(*) >= 2",
        "specialty", "n_pairs", IDLE_FLOATS, TURN)
    q["overtime_by_specialty"] = _q(
        f"""SELECT specialty, avg(overtime_minutes) AS mean_overtime, median(overtime_minutes) AS median_overtime,
 {_pct('overtime_minutes > 0')} AS pct_over, {_pct('overtime_minutes < 0')} AS pct_under, count(*) AS n_cases
 FROM cases WHERE overtime_minutes IS NOT NULL AND ts_procedure_start IS NOT NULL AND ts_procedure_end IS NOT NULL
 GROUP BY 1 HAVING count(*) >= 50""",
        "specialty", "n_cases", "mean_overtime median_overtime pct_over pct_under")
    for name in ("planned_cleaning", "actual_cleaning"):
        q[f"{name}_coverage"] = _q(
            f"""SELECT count(*) AS n_cases, count({name}) AS n_known, {_pct(f'{name} IS NOT NULL')} AS coverage_pct,
 count(*) FILTER ({name} = 0) AS n_zero, {_pct(f'{name} = 0')} AS zero_pct FROM m""",
            "", "n_cases n_known n_zero", "coverage_pct zero_pct")
    q["planned_cleaning_distribution"] = _q(
        f"SELECT {_dist('planned_cleaning', {'p75': 0.75})} FROM m WHERE planned_cleaning > 0",
        "", "n", "mean median p75")
    q["actual_cleaning_distribution"] = _q(
        f"SELECT {_dist('actual_cleaning', QUARTILES)} FROM m WHERE actual_cleaning BETWEEN 1 AND 120",
        "", "n", "mean median p25 p75 p90")
    q["planned_buffer_pairs"] = _q(
        "SELECT * FROM bf", "or_room date specialty", "case_id planned_buffer_min turnaround_min entry_delay_min", "", BUFF)
    q["planned_buffer_summary"] = _q(
        f"""SELECT count(*) AS n_pairs, count(*) FILTER (planned_buffer_min = 0) AS n_zero_buffer,
 {_pct('planned_buffer_min = 0')} AS zero_buffer_pct, avg(planned_buffer_min) AS mean_buffer,
 median(planned_buffer_min) AS median_buffer, avg(turnaround_min) AS mean_turnaround,
 median(turnaround_min) AS median_turnaround FROM bf""",
        "", "n_pairs n_zero_buffer",
        "zero_buffer_pct mean_buffer median_buffer mean_turnaround median_turnaround", BUFF)
    by_buffer = f"""SELECT *, {_label('bucket', BUFFER_LABELS)} AS label FROM (
 SELECT {_bucket('planned_buffer_min', BUFFER)} AS bucket, count(*) AS n_pairs, %s FROM bf GROUP BY 1)"""
    q["entry_delay_by_buffer"] = _q(
        by_buffer % f"""avg(entry_delay_min) AS mean_entry_delay, median(entry_delay_min) AS median_entry_delay,
 {_pct('entry_delay_min > 0')} AS pct_late, avg(turnaround_min) AS mean_turnaround""",
        "label", "bucket n_pairs", "mean_entry_delay median_entry_delay pct_late mean_turnaround", BUFF)
    q["buffer_delay_correlation"] = _q(
        f"SELECT {_corr('planned_buffer_min', 'entry_delay_min')} AS r, count(*) AS n_pairs FROM bf",
        "", "n_pairs", "r", BUFF)
    exceeded = f"""{_pct('turnaround_min > planned_buffer_min')} AS pct_exceeded,
 avg(turnaround_min - planned_buffer_min) FILTER (turnaround_min > planned_buffer_min) AS mean_overshoot"""
    q["buffer_overshoot"] = _q(f"SELECT {exceeded} FROM bf", "", "", "pct_exceeded mean_overshoot", BUFF)
    q["overshoot_by_buffer"] = _q(
        by_buffer % exceeded, "label", "bucket n_pairs", "pct_exceeded mean_overshoot", BUFF)
    q["turnaround_histogram"] = _q(
        _hist("ta", "turnaround_min", 60), "", "bin n", "bin_start bin_end", TURN)
    q["turnaround_boxes"] = _q(
        """SELECT specialty, any_value(n) AS n, any_value(q1) AS q1, any_value(med) AS median, any_value(q3) AS q3,
 min(turnaround_min) FILTER (turnaround_min >= p5) AS whisker_low,
 max(turnaround_min) FILTER (turnaround_min <= p95) AS whisker_high
 FROM ta JOIN (SELECT specialty, count(*) AS n, quantile_cont(turnaround_min, 0.25) AS q1, median(turnaround_min) AS med,
  quantile_cont(turnaround_min, 0.75) AS q3, quantile_cont(turnaround_min, 0.05) AS p5,
  quantile_cont(turnaround_min, 0.95) AS p95 FROM ta GROUP BY 1 HAVING count(*) >= 5) AS b USING (specialty) GROUP BY 1""",
        "specialty", "n whisker_low whisker_high", "q1 median q3", TURN)

    # --- patient prep and gaps
    valid_prep = "FROM m WHERE w2 BETWEEN 0 AND 240"
    q["patient_prep_distribution"] = _q(
        f"SELECT {_dist('w2', QUARTILES)} {valid_prep}", "", "n", "mean median p25 p75 p90")
    q["patient_prep_by_anesthesia"] = _q(
        f"""SELECT anes AS has_anesthesia, avg(w2) AS mean_prep, median(w2) AS median_prep, avg(actual_inor) AS mean_inor,
 count(*) AS n_cases {valid_prep} GROUP BY 1""",
        "has_anesthesia", "n_cases", "mean_prep median_prep mean_inor")
    q["patient_prep_by_specialty"] = _q(
        f"""SELECT specialty, avg(w2) AS mean_prep, median(w2) AS median_prep, avg(staff_count) AS mean_staff,
 avg(resource_count) AS mean_resources, count(*) AS n_cases {valid_prep} GROUP BY 1 HAVING count(*) >= 100""",
        "specialty", "n_cases", "mean_prep median_prep mean_staff mean_resources")
    complexity = f"""
x AS (SELECT procedure_text_id, avg(w2) AS mp, avg(planned_inor) AS mi, avg(staff_count) AS ms, avg(resource_count) AS mr
 {valid_prep} AND planned_inor BETWEEN 0 AND 600 AND procedure_text_id IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)"""
    q["prep_complexity_correlation"] = _q(
        " UNION ALL ".join(
            f"SELECT '{n}' AS predictor, {_corr(c, 'mp')} AS r_actual_prep, {_corr(c, 'mi')} AS r_planned_inor FROM x"
            for n, c in (("staff_count", "ms"), ("resource_count", "mr"))),
        "predictor", "", "r_actual_prep r_planned_inor", complexity)
    gap_floats = "mean_prep_gap mean_inor_gap pct_prep_worse procedure_prep_gap procedure_inor_gap"

    def gap_report(compare: str) -> str:
        return f"""SELECT (SELECT count(*) FROM g) AS n_rows, (SELECT avg(prep_gap) FROM g) AS mean_prep_gap,
 (SELECT avg(inor_gap) FROM g) AS mean_inor_gap, count(*) AS n_procedures, {_pct(compare)} AS pct_prep_worse,
 avg(mean_prep_gap) AS procedure_prep_gap, avg(mean_inor_gap) AS procedure_inor_gap FROM gp"""

    signed = "mean_prep_gap > mean_inor_gap"
    q["prep_vs_inor_gap"] = _q(gap_report(signed), "", "n_rows n_procedures", gap_floats, GAPS)
    q["prep_vs_inor_gap_absolute"] = _q(
        gap_report("abs(mean_prep_gap) > abs(mean_inor_gap)"), "", "n_rows n_procedures", gap_floats, GAPS)
    micro = "date_sub('microsecond', {}, {}) / 60e6"
    q["prep_vs_inor_gap_rows"] = _q(
        gap_report(signed), "", "n_rows n_procedures", gap_floats,
        f"""g0 AS (SELECT {micro.format(*SPANS['actual_prep'])} - {micro.format(*SPANS['planned_prep'])} AS prep_gap,
  {micro.format(*SPANS['actual_inor'])} - {micro.format(*SPANS['planned_inor'])} AS inor_gap,
  trim(regexp_replace(procedure_text_id, '\\s*\\[.*\\]', '')) AS procedure FROM log),
g AS (SELECT * FROM g0 WHERE abs(prep_gap) < 300 AND abs(inor_gap) < 300),
gp AS (SELECT procedure, avg(prep_gap) AS mean_prep_gap, avg(inor_gap) AS mean_inor_gap FROM g
  WHERE procedure IS NOT NULL GROUP BY 1 HAVING count(*) >= 50)""")
    q["gap_complexity_signal"] = _q("SELECT * FROM sig", "predictor", "", "r_actual r_planned", f"{GAPS},{SIGNAL}")
    q["gap_signal_long"] = _q(
        """SELECT predictor, 'r_actual' AS metric, r_actual AS r FROM sig
 UNION ALL SELECT predictor, 'r_planned', r_planned FROM sig""",
        "predictor metric", "", "r", f"{GAPS},{SIGNAL}")
    q["gap_signal_capture"] = _q(
        "SELECT avg(abs(r_planned) / nullif(abs(r_actual), 0)) AS capture_ratio FROM sig",
        "", "", "capture_ratio", f"{GAPS},{SIGNAL}")
    q["worst_prep_gap"] = _q(
        "SELECT * FROM gp ORDER BY mean_prep_gap DESC, procedure LIMIT 10",
        "procedure", "n", "mean_prep_gap mean_inor_gap mean_staff mean_resources", GAPS)
    q["gap_independence"] = _q(
        f"SELECT {_corr('prep_gap', 'inor_gap')} AS r, count(*) AS n FROM g", "", "n", "r", GAPS)

    # --- time in the room
    q["inor_breakdown"] = _q(f"SELECT {PHASE_MEANS} FROM ph", "", "n_cases", PHASE_FLOATS, PHASED)
    q["inor_phase_share"] = _q(
        """SELECT avg(w2 * 100.0 / actual_inor) AS prep_pct, avg(surgery * 100.0 / actual_inor) AS procedure_pct,
 avg(post * 100.0 / actual_inor) AS post_pct FROM ph WHERE actual_inor > 0""",
        "", "", "prep_pct procedure_pct post_pct", PHASED)
    q["slot_overrun"] = _q(
        f"SELECT {_pct('slot_gap > 0')} AS pct_over, avg(slot_gap) AS mean_gap, count(*) AS n_cases FROM ph",
        "", "n_cases", "pct_over mean_gap", PHASED)
    targets = {"r_prep": "mean_prep", "r_procedure": "mean_procedure", "r_post": "mean_post", "r_planned": "mean_planned"}
    q["phase_complexity"] = _q(
        " UNION ALL ".join(
            f"SELECT '{n}' AS predictor, " + ", ".join(f"{_corr(c, t)} AS {o}" for o, t in targets.items()) + " FROM pp50"
            for n, c in (("staff_count", "mean_staff"), ("resource_count", "mean_resources"))),
        "predictor", "", " ".join(targets), PHASED)
    q["inor_by_specialty"] = _q(
        f"SELECT specialty, {PHASE_MEANS}, avg(slot_gap) AS mean_gap FROM ph GROUP BY 1 HAVING count(*) >= 100",
        "specialty", "n_cases", f"{PHASE_FLOATS} mean_gap", PHASED)
    q["prep_staff_points"] = _q("SELECT * FROM pp50", "procedure_text_id", "n", "mean_prep mean_staff", PHASED)
    q["prep_staff_fit"] = _q(
        f"""SELECT regr_slope(mean_prep, mean_staff) AS slope, regr_intercept(mean_prep, mean_staff) AS intercept,
 {_corr('mean_staff', 'mean_prep')} AS r FROM pp50""",
        "", "", "slope intercept r", PHASED)
    q["duration_lookup"] = _q(
        """SELECT procedure_text_id, count(*) AS n, avg(actual_inor) AS mean_actual, avg(planned_inor) AS mean_planned,
 avg(inor_gap) AS mean_gap FROM m WHERE inor_gap IS NOT NULL AND procedure_text_id IS NOT NULL
 GROUP BY 1 HAVING count(*) >= 50""",
        "procedure_text_id", "n", "mean_actual mean_planned mean_gap")
    q["feature_r2"] = _q(_feature_r2("actual_inor"), "features", "n n_groups", "r2")
    q["prep_feature_r2"] = _q(_feature_r2("w2"), "features", "n n_groups", "r2")
    residual = """res AS (SELECT *, actual_inor - avg(actual_inor) OVER (PARTITION BY procedure_text_id) AS res
 FROM m WHERE actual_inor IS NOT NULL)"""
    q["residual_correlation"] = _q(
        f"""SELECT f.*, r_patient_age, r_staff_count, r_resource_count FROM ({_fit('m', 'procedure_text_id', 'actual_inor')}) AS f
 CROSS JOIN (SELECT {', '.join(f"{_residual_r(c)} AS r_{c}" for c in ('patient_age', 'staff_count', 'resource_count'))}
  FROM res) AS r""",
        "", "n n_groups", "r2 r_patient_age r_staff_count r_resource_count", residual)
    q["residual_spread"] = _q(
        "SELECT count(*) AS n, avg(abs(res)) AS mae, sqrt(avg(res * res)) AS std FROM res", "", "n", "mae std", residual)

    # --- surgical set
    q["data_funnel"] = _q(
        f"""SELECT step, name, n, n * 100.0 / (SELECT count(*) FROM log) AS pct_of_raw FROM (
 SELECT 1 AS step, 'raw rows' AS name, (SELECT count(*) FROM log) AS n
 UNION ALL SELECT 2, 'clean prep stamps', (SELECT count(*) FROM log WHERE ts_or_prep_start <> ts_or_prep_done)
 UNION ALL SELECT 3, 'surgical specialties', (SELECT count(*) FROM log WHERE ts_or_prep_start <> ts_or_prep_done
  AND specialty NOT IN {EXCLUDED})
 UNION ALL SELECT 4, 'analysis set', (SELECT count(*) FROM v))""",
        "name", "step n", "pct_of_raw")
    means = "planned_prep actual_prep prep_gap planned_surgery actual_surgery surgery_gap"
    q["phase_comparison"] = _q("SELECT * FROM pc", "procedure_name prep_worse zero_planned", "n", means, COMPARED)
    q["phase_gap_summary"] = _q(
        f"""SELECT count(*) AS n, avg(prep_gap) AS mean_prep_gap, avg(inor_gap) AS mean_surgery_gap,
 (SELECT {_pct('prep_worse')} FROM pc) AS pct_prep_worse FROM v""",
        "", "n", "mean_prep_gap mean_surgery_gap pct_prep_worse", COMPARED)
    split = """SELECT zero_planned, count(*) AS n_procedures, avg(planned_prep) AS mean_planned_prep,
 avg(actual_prep) AS mean_actual_prep, avg(prep_gap) AS mean_prep_gap, avg(surgery_gap) AS mean_surgery_gap
 FROM pc GROUP BY 1"""
    split_cols = ("zero_planned", "n_procedures", "mean_planned_prep mean_actual_prep mean_prep_gap mean_surgery_gap")
    by_age = COMPARED.replace("procedure_name", "patient_age").replace(">= 50", ">= 10")
    q["zero_allocation_split"] = _q(split, *split_cols, COMPARED)
    q["zero_allocation_split_by_age"] = _q(split, *split_cols, by_age)
    q["zero_allocation_top"] = _q(
        "SELECT * FROM pc WHERE zero_planned ORDER BY prep_gap DESC, patient_age LIMIT 10",
        "", "patient_age n", "planned_prep actual_prep prep_gap surgery_gap", by_age)
    q["zero_allocation_histogram"] = _q(
        _hist("za", "actual_prep", 40), "", "bin n", "bin_start bin_end",
        f"{by_age},\nza AS (SELECT v.* FROM v SEMI JOIN (SELECT * FROM pc WHERE zero_planned) AS z USING (patient_age))")
    q["or_day_classification"] = _q(
        "SELECT * FROM dc", "or_room date specialty day_type",
        "first_case_delay first_case_prep_gap last_case_finish_delay n_cases", "position_delay_corr mean_day_delay", DAYS)
    q["day_type_summary"] = _q(
        """SELECT day_type, count(*) AS n_days, avg(first_case_delay) AS mean_first_delay,
 avg(first_case_prep_gap) AS mean_first_prep_gap, avg(mean_day_delay) AS mean_day_delay,
 avg(last_case_finish_delay) AS mean_last_finish_delay FROM dc GROUP BY 1""",
        "day_type", "n_days", "mean_first_delay mean_first_prep_gap mean_day_delay mean_last_finish_delay", DAYS)
    q["delay_curve_by_day_type"] = _q(
        """SELECT day_type, position, avg(delay) AS mean_delay, count(*) AS n FROM ld JOIN dc USING (or_room, date)
 GROUP BY 1, 2 HAVING count(*) >= 5""",
        "day_type", "position n", "mean_delay", DAYS)
    q["day_examples"] = _q(
        "SELECT *, delay AS start_delay_min FROM exc", "day_type or_room date", "position case_id start_delay_min", "", DAYS)
    intervals = (("planned", "ts_patient_in_or_planned", "ts_patient_leaves_or_planned"),
                 ("room prep", "ts_or_prep_start", "ts_patient_in_or"),
                 ("patient prep", "ts_patient_in_or", "ts_procedure_start"),
                 ("surgery", "ts_procedure_start", "ts_procedure_end"),
                 ("closing", "ts_procedure_end", "ts_patient_leaves_or"))
    q["day_timeline"] = _q(
        " UNION ALL ".join(
            f"""SELECT day_type, or_room, date, position, case_id, '{n}' AS phase,
 date_sub('microsecond', CAST(date AS TIMESTAMP), {a}) / 60e6 AS start_min,
 date_sub('microsecond', CAST(date AS TIMESTAMP), {b}) / 60e6 AS end_min FROM exc WHERE {b} > {a}"""
            for n, a, b in intervals),
        "day_type or_room date phase", "position case_id", "start_min end_min", DAYS)
    q["waiting_impact"] = _q(
        f"""SELECT *, mean_delay - mean_prep_gap AS corrected_mean_delay, mean_prep_gap * n_cases / 60.0 AS correctable_hours,
 mean_prep_gap * n_cases / 60.0 / 500.0 AS correctable_hours_per_day FROM (
 SELECT count(delay) AS n_cases, {_pct('delay > 0')} AS pct_late, {_pct('delay > 15')} AS pct_late_15,
  {_pct('delay > 30')} AS pct_late_30, avg(delay) AS mean_delay, median(delay) AS median_delay,
  avg(prep_gap) AS mean_prep_gap, sum(delay) FILTER (delay > 0) / 60.0 AS wait_hours FROM v)""",
        "", "n_cases",
        "pct_late pct_late_15 pct_late_30 mean_delay median_delay mean_prep_gap wait_hours corrected_mean_delay"
        " correctable_hours correctable_hours_per_day")
    q["waiting_distribution"] = _q(
        f"""{_hist('wd', 'cur', 60, ", 'current' AS series", 'cur BETWEEN -30 AND 120')}
 UNION ALL {_hist('wd', 'cor', 60, ", 'corrected' AS series", 'cor BETWEEN -30 AND 120')}""",
        "series", "bin n", "bin_start bin_end",
        "wd AS (SELECT CAST(delay AS DOUBLE) AS cur, delay - (SELECT avg(prep_gap) FROM v) AS cor FROM v)")
    profile = """
pf0 AS (SELECT procedure_name, avg(actual_prep) AS ap, avg(planned_prep) AS pp, avg(staff_count) AS c1,
 avg(resource_count) AS c2, avg(CAST(anes AS INT)) AS c3, avg(CAST(is_first AS INT)) AS c4,
 avg(CAST(is_last AS INT)) AS c5, avg(patient_age) AS c7, avg(position) AS c8, avg(day_size) AS c9
 FROM vp GROUP BY 1 HAVING count(*) >= 50),
pf AS (SELECT *, CAST(row_number() OVER (ORDER BY procedure_name) - 1 AS DOUBLE) AS c6 FROM pf0)"""
    names = {"c1": "staff count", "c2": "equipment count", "c3": "pct anesthesia", "c4": "pct first of day",
             "c5": "pct last of day", "c6": "procedure code", "c7": "mean age", "c8": "mean position",
             "c9": "mean cases that day"}

    def signals(columns: list[str], spread: bool) -> str:
        having = " HAVING coalesce(stddev_samp({}), 1) >= 0.01" if spread else ""
        return " UNION ALL ".join(
            f"SELECT '{names[c]}' AS predictor, {_corr(c, 'ap')} AS r_actual, {_corr(c, 'pp')} AS r_planned,"
            f" {_corr(c, 'ap')} - {_corr(c, 'pp')} AS schedule_gap FROM pf{having.format(c)}" for c in columns)

    signal = ("predictor", "", "r_actual r_planned schedule_gap", profile)
    q["scheduling_signal_table"] = _q(signals(list(names)[:5], True), *signal)
    q["scheduling_signal_table_wide"] = _q(signals(list(names), False), *signal)

    # --- replay
    q["cascade_day_candidates"] = _q(
        """SELECT or_room, date, string_agg(procedure_name, ',' ORDER BY position) AS procedure_name_list,
 string_agg(CAST(delay AS VARCHAR), ',' ORDER BY position) AS start_delay_min_list,
 string_agg(CAST(planned_prep AS VARCHAR), ',' ORDER BY position) AS planned_prep_min_list,
 string_agg(CAST(actual_prep AS VARCHAR), ',' ORDER BY position) AS actual_prep_min_list,
 count(*) AS n_cases, count(DISTINCT procedure_name) AS n_procedures, avg(abs(actual_prep - predicted)) AS mean_error,
 max(delay) - min(delay) AS cascade, max(corrected_delay) AS max_corrected
 FROM (SELECT *, delay > lag(delay) OVER (PARTITION BY or_room, date ORDER BY position) AS grows
  FROM cd WHERE predicted IS NOT NULL) GROUP BY 1, 2
 HAVING count(*) >= 2 AND bool_and(grows) AND max(CASE WHEN is_first THEN prep_gap END) >= 5
  AND max(CASE WHEN is_first THEN abs(actual_prep - predicted) END) <= 40
  AND max(CASE WHEN is_first THEN delay END) >= 0 AND round(max(corrected_delay), 1) <= 60
 ORDER BY n_procedures DESC, cascade DESC, date, or_room LIMIT 10""",
        "or_room date procedure_name_list start_delay_min_list planned_prep_min_list actual_prep_min_list",
        "n_cases n_procedures cascade", "mean_error max_corrected", REPLAY)
    corrected = ("or_room date procedure_name", "position case_id planned_prep_min actual_prep_min start_delay_min",
                 "predicted_prep corrected_delay")
    aliases = "planned_prep AS planned_prep_min, actual_prep AS actual_prep_min, delay AS start_delay_min, predicted AS predicted_prep"
    q["corrected_days"] = _q(f"SELECT *, {aliases} FROM cd", *corrected, REPLAY)
    q["corrected_days_unplanned_part"] = _q(
        f"SELECT *, {aliases} FROM cd", *corrected,
        REPLAY.replace("least(predicted, actual_prep) AS", "greatest(least(predicted, actual_prep) - planned_prep, 0) AS"))
    q["increasing_days"] = _q(
        """SELECT or_room, date, count(*) AS n_known, coalesce(bool_and(grows), TRUE) AS increasing FROM (
 SELECT *, delay > lag(delay) OVER (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq) AS grows
 FROM v WHERE delay IS NOT NULL) GROUP BY 1, 2""",
        "or_room date increasing", "n_known")
    for name, planned in (("replay_days", "planned_prep"), ("replay_days_predicted", "predicted")):
        q[name] = _q("SELECT * FROM rp", "or_room date procedure_name", "position case_id", REPLAY_FLOATS, _replay(planned))
    q["waiting_saved"] = _q(
        f"""SELECT count(*) AS n_cases, sum(greatest(delay, 0)) AS minutes_before, sum(corrected_delay) AS minutes_after,
 (sum(greatest(delay, 0)) - sum(corrected_delay)) / 60.0 AS hours_saved,
 avg(greatest(delay, 0) - corrected_delay) AS mean_saved
 FROM cd WHERE date BETWEEN {CUTOFF} AND {MONTH_END} AND corrected_delay IS NOT NULL""",
        "", "n_cases minutes_before", "minutes_after hours_saved mean_saved", REPLAY)

    # --- allocation classes and densities
    late = f"{_pct('delay > 0')} AS pct_late, {_pct('delay > 15')} AS pct_late_15"
    q["delay_by_prep_bucket"] = _q(
        _bucket_report("delay", "start_delay_min"), "label", "bucket n", "mean_start_delay_min pct_of_total")
    q["prep_bucket_profile"] = _q(
        _bucket_report("delay", "start_delay_min", late), "label", "bucket n",
        "mean_start_delay_min pct_of_total pct_late pct_late_15")
    q["overrun_by_prep_bucket"] = _q(
        _bucket_report("proc_overrun", "procedure_overrun_min"), "label", "bucket n",
        "mean_procedure_overrun_min pct_of_total")
    q["delay_density_split"] = _density_split("delay")
    q["overrun_density_split"] = _density_split("proc_overrun")
    q["prep_violin"] = _q(
        """SELECT key AS has_anesthesia, point, gx AS x, density, vs.n, mean, median FROM kd JOIN (
 SELECT anes AS key, count(*) AS n, avg(w2) AS mean, median(w2) AS median FROM vw GROUP BY 1) AS vs USING (key)""",
        "has_anesthesia", "point n", "x density mean median",
        f"vw AS (SELECT anes, w2 FROM s WHERE w2 BETWEEN 0 AND 240),"
        f"{_density('vw', 'anes', 'w2', 100, 'lo', 'hi', 'power(n, -0.2)')}")

    # --- lookup and what-if
    q["prep_lookup"] = _q(
        "SELECT specialty, anes AS has_anesthesia, lookup_prep, n FROM lk", "specialty has_anesthesia", "n", "lookup_prep")
    display = """CASE specialty WHEN 'click-0' THEN 'Clicking' WHEN 'view-1' THEN 'Viewing' WHEN 'signup-2' THEN 'Signing'
 ELSE specialty END AS display_name"""
    grid = f"""gr AS (SELECT specialty, max(CASE WHEN NOT anes THEN lookup_prep END) AS no_anesthesia,
 max(CASE WHEN anes THEN lookup_prep END) AS with_anesthesia, {display} FROM lk GROUP BY 1)"""
    q["prep_lookup_grid"] = _q("SELECT * FROM gr", "specialty display_name", "", "no_anesthesia with_anesthesia", grid)
    q["prep_lookup_grid_ends"] = _q(
        """SELECT * FROM (SELECT *, 'first' AS part FROM gr ORDER BY specialty LIMIT 5)
 UNION ALL SELECT * FROM (SELECT *, 'last' AS part FROM gr ORDER BY specialty DESC LIMIT 5)""",
        "specialty display_name part", "", "no_anesthesia with_anesthesia", grid)
    overrun = f"""SELECT bucket, {_label('bucket', PREP_LABELS)} AS label, n_before, mean_before, n_after, mean_after FROM (
 SELECT {_bucket('planned_prep', PREP)} AS bucket, count(*) AS n_before, avg(room_overrun) AS mean_before,
  count(room_overrun - (lookup_prep - planned_prep)) AS n_after,
  avg(room_overrun - (lookup_prep - planned_prep)) AS mean_after FROM %s
 WHERE planned_prep IS NOT NULL AND room_overrun IS NOT NULL GROUP BY 1) WHERE bucket IS NOT NULL"""
    overrun_cols = ("label", "bucket n_before n_after", "mean_before mean_after")
    q["whatif_room_overrun"] = _q(overrun % "sl", *overrun_cols)
    q["whatif_room_overrun_temporal"] = _q(
        overrun % "st", *overrun_cols,
        f"""lt AS (SELECT specialty, anes, avg(w2) AS lookup_prep FROM s WHERE w2 BETWEEN 0 AND 240
  AND specialty IS NOT NULL AND date < {CUTOFF} GROUP BY 1, 2),
st AS (SELECT s.*, lt.lookup_prep FROM s LEFT JOIN lt ON s.specialty = lt.specialty AND s.anes = lt.anes)""")
    q["whatif_start_delay"] = _q(_before_after("delay"), "", "n n_removed", BEFORE_AFTER_FLOATS)
    q["whatif_procedure_overrun"] = _q(_before_after("proc_overrun"), "", "n n_removed", BEFORE_AFTER_FLOATS)
    q["lookup_residual"] = _q(
        f"""SELECT count(*) AS n, {_pct('w2 > lookup_prep')} AS pct_over, {_pct('w2 - lookup_prep > 15')} AS pct_over_15,
 avg(abs(w2 - lookup_prep)) AS mae FROM sl WHERE lookup_prep IS NOT NULL AND w2 BETWEEN 0 AND 240""",
        "", "n", "pct_over pct_over_15 mae")
    q["feasible_whatif_days"] = _q(
        "SELECT * FROM fd", "or_room date", "n_cases", "mean_overrun mean_start_delay", WHATIF_DAYS)
    q["feasible_whatif_day"] = _q(
        """SELECT or_room, date, case_id, specialty, lookup_prep, delay AS start_delay_min, proc_overrun AS old_overrun,
 proc_overrun - lookup_prep AS new_overrun FROM uh SEMI JOIN (
 SELECT * FROM fd ORDER BY mean_overrun DESC, date, or_room LIMIT 1) AS f USING (or_room, date)""",
        "or_room date specialty", "case_id", "lookup_prep start_delay_min old_overrun new_overrun", WHATIF_DAYS)
    q["best_whatif_days"] = _q(
        """SELECT *, round(mean_old_overrun - mean_abs_new_overrun, 9) AS score FROM (
 SELECT or_room, date, count(*) AS n_cases, avg(proc_overrun) AS mean_old_overrun,
  avg(proc_overrun - lookup_prep) AS mean_new_overrun, avg(abs(proc_overrun - lookup_prep)) AS mean_abs_new_overrun,
  count(*) FILTER (abs(proc_overrun - lookup_prep) < 15) AS n_good_fix
 FROM un WHERE proc_overrun BETWEEN 15 AND 90 GROUP BY 1, 2)
 WHERE n_cases BETWEEN 1 AND 4 AND n_good_fix >= 1 AND mean_old_overrun > 15 AND mean_abs_new_overrun < 30
 ORDER BY score DESC, date, or_room LIMIT 10""",
        "or_room date", "n_cases n_good_fix",
        "mean_old_overrun mean_new_overrun mean_abs_new_overrun score", WHATIF_DAYS)

    # --- audits
    q["overtime_identity"] = _q(
        """SELECT count(*) AS n_cases, count(off) AS n_known, count(*) FILTER (off <> 0) AS n_differ,
 max(abs(off)) AS max_difference FROM (SELECT overtime_minutes - delay - inor_gap AS off FROM m)""",
        "", "n_cases n_known n_differ max_difference")
    q["metric_identity"] = _q(
        f"""SELECT {_corr('delay_minutes', 'delay')} AS r_delay, {_pct('delay_minutes = delay')} AS pct_delay_equal,
 {_corr('overtime_minutes', 'room_overrun')} AS r_overtime, {_pct('overtime_minutes = room_overrun')} AS pct_overtime_equal
 FROM m""",
        "", "", "r_delay pct_delay_equal r_overtime pct_overtime_equal")
    q["two_failures"] = _q(
        f"""SELECT count(*) AS n_cases, {_pct('delay > 0')} AS pct_late, {_pct('delay > 15')} AS pct_late_15,
 avg(delay) AS mean_start_delay, {_pct('inor_gap > 0')} AS pct_over, {_pct('inor_gap > 15')} AS pct_over_15,
 avg(inor_gap) AS mean_duration_gap, {_pct('room_overrun > 0')} AS pct_finish_late,
 avg(room_overrun) AS mean_finish_overrun FROM m""",
        "", "n_cases",
        "pct_late pct_late_15 mean_start_delay pct_over pct_over_15 mean_duration_gap pct_finish_late mean_finish_overrun")
    q["failure_distributions"] = _q(
        " UNION ALL ".join(
            f"SELECT '{n}' AS series, {_dist(c, QUARTILES)} FROM m"
            for n, c in (("start_delay_min", "delay"), ("inor_gap_min", "inor_gap"),
                         ("actual_inor_min", "actual_inor"), ("planned_inor_min", "planned_inor"))),
        "series", "n", "mean median p25 p75 p90")
    q["hours_lost_by_specialty"] = _q(
        f"""SELECT specialty, count(*) AS n_cases, {_pct('delay > 0')} AS pct_late, {_pct('inor_gap > 0')} AS pct_over,
 sum(greatest(delay, 0)) / 60.0 AS hours_late, sum(greatest(inor_gap, 0)) / 60.0 AS hours_over FROM m GROUP BY 1""",
        "specialty", "n_cases", "pct_late pct_over hours_late hours_over")
    q["gap_by_delay_bucket"] = _q(
        f"""SELECT *, {_label('bucket', DELAY_LABELS)} AS label FROM (
 SELECT {_bucket('delay', DELAY, False)} AS bucket, count(*) AS n, {_pct('inor_gap > 0')} AS pct_over,
  avg(inor_gap) AS mean_duration_gap FROM m WHERE delay IS NOT NULL AND inor_gap IS NOT NULL GROUP BY 1)""",
        "label", "bucket n", "pct_over mean_duration_gap")
    q["delay_gap_independence"] = _q(
        f"SELECT {_corr('delay', 'inor_gap')} AS r_delay_duration_gap FROM m", "", "", "r_delay_duration_gap")
    stamps = (("room prep", "ts_or_prep_start", "ts_or_prep_done"), ("cleaning", "ts_or_cleaning_start", "ts_or_cleaned"),
              ("patient prep", "ts_patient_in_or", "ts_procedure_start"))
    q["same_click_audit"] = _q(
        " UNION ALL ".join(
            f"""SELECT '{n}' AS pair, count({a} = {b}) AS n_known, {_pct(f'{a} = {b}')} AS same_click_pct,
 count(*) FILTER ({a} <> {b}) AS n_usable, count(*) FILTER ({a} <> {b}) * 100.0 / count(*) AS usable_pct FROM m"""
            for n, a, b in stamps),
        "pair", "n_known n_usable", "same_click_pct usable_pct")
    q["measure_coverage"] = _q(
        " UNION ALL ".join(
            f"SELECT '{n}' AS measure, {_pct(f'{c} IS NOT NULL')} AS coverage_pct FROM m"
            for n, c in (("planned_prep_min", "planned_prep"), ("start_delay_min", "delay"), ("patient_prep_min", "w2"),
                         ("actual_prep_min", "actual_prep"), ("actual_cleaning_min", "actual_cleaning"))),
        "measure", "", "coverage_pct")
    ahead = _mins("ts_or_prep_start", "ts_or_prep_planned_start")
    clean = "ts_or_prep_start <> ts_or_prep_done"
    q["clean_subset_bias"] = _q(
        f"""SELECT count(*) AS n_cases, count(*) FILTER ({clean}) AS n_clean, {_pct('anes')} AS anesthesia_pct_all,
 avg(CAST(anes AS INT)) FILTER ({clean}) * 100 AS anesthesia_pct_clean,
 avg(CAST({ahead} > 0 AS INT)) FILTER ({clean}) * 100 AS early_prep_pct_clean,
 avg({ahead}) FILTER ({clean}) AS mean_minutes_ahead_clean FROM m""",
        "", "n_cases n_clean", "anesthesia_pct_all anesthesia_pct_clean early_prep_pct_clean mean_minutes_ahead_clean")
    for name, key in (("zero_prep_by_acute", "is_acute"), ("zero_prep_by_specialty", "specialty")):
        q[name] = _q(
            f"""SELECT {key}, count(planned_prep) AS n, {_pct('planned_prep = 0')} AS zero_prep_pct,
 avg(delay) AS mean_start_delay FROM m GROUP BY 1""",
            key, "n", "zero_prep_pct mean_start_delay")
    q["case_inventory"] = _q(
        f"""SELECT (SELECT count(*) FROM log) AS n_rows, count(*) AS n_cases, count(DISTINCT specialty) AS n_specialties,
 count(DISTINCT or_room) AS n_rooms, count(DISTINCT procedure_text_id) AS n_procedures, min(date) AS first_date,
 max(date) AS last_date, {_pct('is_acute')} AS pct_acute FROM cases""",
        "first_date last_date", "n_rows n_cases n_specialties n_rooms n_procedures", "pct_acute")
    q["anesthesia_subphases"] = _q(
        """SELECT count(to_ready) AS n_ready, avg(to_ready) AS mean_start_to_ready, count(to_knife) AS n_knife,
 avg(to_knife) AS mean_ready_to_knife FROM m""",
        "", "n_ready n_knife", "mean_start_to_ready mean_ready_to_knife")
    q["room_prep_vs_delay"] = _q(
        f"SELECT {_corr('actual_prep', 'delay')} AS r, count(actual_prep) AS n FROM m WHERE {clean}", "", "n", "r")
    q["lookup_fit_by_target"] = _q(
        f"""SELECT *, 'room prep' AS target FROM ({_fit('m', 'specialty, anes', 'actual_prep', f'specialty IS NOT NULL AND {clean}')})
 UNION ALL SELECT *, 'patient prep' FROM ({_fit('m', 'specialty, anes', 'w2', 'specialty IS NOT NULL AND w2 BETWEEN 0 AND 240')})""",
        "target", "n n_groups", "r2")
    q["delay_amplification"] = _q(
        """SELECT count(*) AS n, avg(delay) AS mean_start_delay, avg(room_overrun) AS mean_finish_overrun,
 avg(room_overrun - delay) AS mean_growth FROM m WHERE planned_prep = 0""",
        "", "n", "mean_start_delay mean_finish_overrun mean_growth")

    # --- operators on their own
    stamps_all = """ts_or_prep_planned_start ts_or_prep_start ts_or_prep_done ts_patient_in_or_planned ts_patient_in_or
 ts_anesthesia_start ts_anesthesia_ready ts_procedure_start ts_procedure_end ts_patient_leaves_or_planned
 ts_patient_leaves_or ts_or_cleaned_planned ts_or_cleaning_start ts_or_cleaned"""
    keep = f"""or_room date specialty is_acute procedure_text_id diagnosis_group delay_reason {stamps_all}
 staff_a staff_b staff_c staff_d staff_e resource_a resource_b resource_c resource_d"""
    longs = "row_seq case_id patient_age delay_minutes overtime_minutes"
    q["case_log"] = _q("SELECT * FROM log", keep, longs)
    q["first_case_rows"] = _q("SELECT * FROM cases", keep, longs)
    q["row_measures"] = _q(
        """SELECT case_id, delay AS delay_whole,
 date_sub('second', ts_patient_in_or_planned, ts_patient_in_or) / 60.0 AS delay_second,
 date_sub('microsecond', ts_patient_in_or_planned, ts_patient_in_or) / 60e6 AS delay_micro,
 w2 AS prep_signed, CASE WHEN w2 >= 0 THEN w2 END AS prep_known, prep_gap, inor_gap FROM m""",
        "", "case_id delay_whole prep_signed prep_known prep_gap inor_gap", "delay_second delay_micro")
    q["unit_measures"] = _q(
        """SELECT case_id, """ + ", ".join(
            f"date_sub('{part}', {a}, {b}) / {per} AS {name}_{unit}"
            for name, a, b in (("start_delay", "ts_patient_in_or_planned", "entered"), ("patient_prep", "entered", "cut_open"))
            for unit, part, per in (("minute", "minute", "1"), ("second", "second", "60.0"), ("micro", "microsecond", "60e6")))
        + """ FROM (SELECT *, ts_patient_in_or + to_microseconds(row_seq * 7919 % 999983 * 60) AS entered,
 ts_procedure_start - to_microseconds(row_seq * 104729 % 999983 * 60) AS cut_open FROM cases)""",
        "", "case_id start_delay_minute patient_prep_minute",
        "start_delay_second start_delay_micro patient_prep_second patient_prep_micro")
    q["case_flags"] = _q(
        f"""SELECT *, anes AS has_anesthesia, {display}, year(date) AS year, hour(ts_patient_in_or_planned) AS hour,
 specialty IS NOT NULL AND coalesce(specialty NOT IN {EXCLUDED}, FALSE) AS surgical FROM m""",
        "has_anesthesia procedure_name display_name surgical", "case_id staff_count resource_count year hour")
    q["bucket_codes"] = _q(
        f"""SELECT case_id, {_bucket('planned_prep', PREP)} AS prep_bucket, {_bucket('delay', DELAY, False)} AS delay_bucket,
 {_bucket('planned_cleaning', BUFFER)} AS buffer_bucket,
 {_label(f"({_bucket('planned_prep', PREP)})", PREP_LABELS)} AS label FROM m""",
        "label", "case_id prep_bucket delay_bucket buffer_bucket")
    q["case_positions"] = _q(
        "SELECT *, CASE WHEN case_position >= 5 THEN '5+' ELSE CAST(case_position AS VARCHAR) END AS position_label FROM cp",
        "position_label", "case_id case_position cases_in_day", "", PLACES)
    q["running_delay"] = _q(
        """SELECT case_id, lag(delay_minutes) OVER w AS previous_delay,
 sum(delay_minutes) OVER (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq ROWS UNBOUNDED PRECEDING) AS upto,
 coalesce(sum(delay_minutes) OVER (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq
  ROWS BETWEEN UNBOUNDED PRECEDING AND 1 PRECEDING), 0) AS before
 FROM cases WHERE delay_minutes IS NOT NULL AND ts_patient_in_or_planned IS NOT NULL
 WINDOW w AS (PARTITION BY or_room, date ORDER BY ts_patient_in_or_planned, row_seq)""",
        "", "case_id previous_delay upto before")
    q["packed_flags"] = _q(
        f"SELECT row_seq, {_FLAGS}, coalesce(staff_e, false) AS staff_e, resource_d FROM log",
        "staff_e resource_d", "row_seq staff_count resource_count")
    q["first_three_cases"] = _q(
        """SELECT or_room, date, case_id FROM (SELECT *, row_number() OVER (PARTITION BY or_room, date
 ORDER BY ts_patient_in_or_planned, row_seq) AS rn FROM cases WHERE ts_patient_in_or_planned IS NOT NULL) WHERE rn <= 3""",
        "or_room date", "case_id")
    q["day_lists"] = _q(
        """SELECT or_room, date, (case_position - 1) // 8 AS segment, string_agg(CAST(case_id AS VARCHAR), ',' ORDER BY case_position) AS case_id_list,
 string_agg(CAST(delay_minutes AS VARCHAR), ',' ORDER BY case_position) AS delay_minutes_list
 FROM cp SEMI JOIN (SELECT * FROM ends WHERE n_cases >= 3 ORDER BY n_cases DESC, date, or_room LIMIT 3) AS e
 USING (or_room, date) GROUP BY 1, 2, 3""",
        "or_room date case_id_list delay_minutes_list", "segment", "", PLACES)
    q["large_specialty_cases"] = _q(
        """SELECT case_id, specialty FROM cases WHERE specialty IN (
 SELECT specialty FROM cases GROUP BY 1 HAVING count(*) >= 100)""",
        "specialty", "case_id")
    for how, where in (("left", "TRUE"), ("inner", "lookup_prep IS NOT NULL")):
        q[f"lookup_{how}_join"] = _q(
            f"SELECT case_id, specialty, anes AS has_anesthesia, lookup_prep FROM sl WHERE {where}",
            "specialty has_anesthesia", "case_id", "lookup_prep")
    q["patient_prep_bins"] = _q(
        """SELECT r.bin, r.bin * 5.0 AS bin_start, (r.bin + 1) * 5.0 AS bin_end, count(w2) AS n
 FROM (SELECT unnest(range((SELECT CAST(floor(max(w2) / 5.0) AS BIGINT) + 1 FROM m WHERE w2 BETWEEN 0 AND 240))) AS bin) AS r
 LEFT JOIN (SELECT w2 FROM m WHERE w2 BETWEEN 0 AND 240) AS d ON CAST(floor(d.w2 / 5.0) AS BIGINT) = r.bin GROUP BY r.bin""",
        "", "bin n", "bin_start bin_end")
    q["placed_cases"] = _q(
        """SELECT case_id, position, day_size AS total_cases_that_day, is_first AS is_first_of_day,
 is_last AS is_last_of_day FROM vp""",
        "is_first_of_day is_last_of_day", "case_id position total_cases_that_day")

    # --- models
    q["split_sizes"] = _q(
        f"""SELECT 'train' AS part, count(*) AS n FROM vp WHERE date < {CUTOFF}
 UNION ALL SELECT 'test', count(*) FROM vp WHERE date >= {CUTOFF}""",
        "part", "n")
    q["procedure_codes"] = _q(
        f"""SELECT case_id, coalesce(c.code, -1) AS procedure_code FROM vp LEFT JOIN (
 SELECT procedure_name, row_number() OVER (ORDER BY procedure_name) - 1 AS code FROM (
  SELECT DISTINCT procedure_name FROM vp WHERE date < {CUTOFF})) AS c USING (procedure_name) WHERE date >= {CUTOFF}""",
        "", "case_id procedure_code")
    q["schedule_quality"] = _q(
        f"""SELECT count(*) AS n, avg(abs(prep_gap)) AS mae,
 1 - sum(prep_gap * prep_gap) / (count(*) * var_pop(actual_prep)) AS r2, avg(prep_gap) AS bias
 FROM vp WHERE date >= {CUTOFF} AND prep_gap IS NOT NULL""",
        "", "n", "mae r2 bias")
    q["forest_rows_by_first"] = _q(
        f"""SELECT is_first, count(*) AS n, avg(actual_prep) AS mean_actual_prep, avg(planned_prep) AS mean_planned_prep
 FROM vp WHERE date >= {CUTOFF} AND actual_prep IS NOT NULL AND planned_prep IS NOT NULL GROUP BY 1""",
        "is_first", "n", "mean_actual_prep mean_planned_prep")
    known = "specialty IS NOT NULL AND patient_age IS NOT NULL AND is_acute IS NOT NULL AND planned_inor IS NOT NULL"
    q["overrun_labels"] = _q(
        f"""SELECT overtime_minutes > 0 AS overran, count(*) AS n FROM m
 WHERE {known} AND w2 BETWEEN 0 AND 240 AND date >= {CUTOFF} AND overtime_minutes IS NOT NULL GROUP BY 1""",
        "overran", "n")
    q["planned_slot_quality"] = _q(
        f"""SELECT count(*) AS n, avg(abs(inor_gap)) AS mae,
 1 - sum(inor_gap * inor_gap) / (count(*) * var_pop(actual_inor)) AS r2, avg(inor_gap) AS bias
 FROM m WHERE {known} AND actual_inor BETWEEN 0 AND 600 AND date >= {CUTOFF}""",
        "", "n", "mae r2 bias")
    q["saturated_line"] = _q(
        f"""SELECT count(*) AS n, avg(abs(w2 - p)) AS mae, 1 - sum((w2 - p) * (w2 - p)) / (count(*) * var_pop(w2)) AS r2,
 avg(w2 - p) AS bias FROM (SELECT specialty, anes, w2 FROM m WHERE {known} AND w2 BETWEEN 0 AND 240 AND date >= {CUTOFF})
 JOIN (SELECT specialty, anes, avg(w2) AS p FROM m WHERE {known} AND w2 BETWEEN 0 AND 240 AND date < {CUTOFF} GROUP BY 1, 2)
 USING (specialty, anes)""",
        "", "n", "mae r2 bias")
    crc_table = """(SELECT list(list_reduce([x, 0, 0, 0, 0, 0, 0, 0, 0], lambda c, z:
  CASE WHEN c & 1 = 1 THEN xor(c >> 1, 3988292384) ELSE c >> 1 END) ORDER BY x) AS t FROM (SELECT unnest(range(256)) AS x))"""
    crc = """xor(list_reduce(list_prepend(4294967295, list_transform(string_split(case_id::VARCHAR, ''), lambda x: ascii(x)::BIGINT)),
  lambda c, b: xor(c >> 8, t[(xor(c, b) & 255) + 1])), 4294967295)"""

    def drawn(column: str) -> str:
        """The mean over the training rows with this row's value, own fold left out, drawn to the overall mean by 10 rows."""
        others = f"FROM r AS o WHERE o.train AND o.{column} = r.{column} AND (NOT r.train OR o.fold <> r.fold)"
        return (f"(SELECT CASE WHEN count(*) > 0 THEN (sum(w2) + 10 * (SELECT avg(w2) FROM r AS a WHERE a.train)) / (count(*) + 10)"
                f" ELSE (SELECT avg(w2) FROM r AS a WHERE a.train) END {others})")

    q["mean_codes"] = _q(
        f"SELECT case_id, train, {drawn('specialty')} AS specialty_code, {drawn('procedure_text_id')} AS text_code FROM r",
        "train", "case_id", "specialty_code text_code",
        f"""r AS (SELECT case_id, specialty, procedure_text_id, w2, date < {CUTOFF} AS train, {crc} % 5 AS fold FROM m, {crc_table} AS tab
 WHERE {known} AND w2 BETWEEN 0 AND 240)""")
    q["tier_rows"] = _q(
        f"""SELECT count(*) AS n, avg(staff_count) AS mean_staff_count, avg(resource_count) AS mean_resource_count,
 avg(actual_prep) AS mean_actual_prep_min, avg(overtime_minutes) AS mean_overtime_minutes
 FROM m WHERE {known} AND w2 BETWEEN 0 AND 240 AND actual_prep IS NOT NULL AND overtime_minutes IS NOT NULL""",
        "", "n", "mean_staff_count mean_resource_count mean_actual_prep_min mean_overtime_minutes")
    q["known_procedure_test"] = _q(
        f"""SELECT procedure_name, count(actual_prep) AS n_test, avg(actual_prep) AS mean_actual_prep,
 avg(planned_prep) AS mean_planned_prep FROM vp WHERE date >= {CUTOFF} AND procedure_name IN (
 SELECT procedure_name FROM vp WHERE date < {CUTOFF}) GROUP BY 1 HAVING count(actual_prep) >= 5
 ORDER BY n_test DESC, procedure_name LIMIT 20""",
        "procedure_name", "n_test", "mean_actual_prep mean_planned_prep")
    return q
