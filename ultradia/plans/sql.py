"""Common beginnings of the SQL that the queries are checked with."""

from __future__ import annotations

BASE = r"""
WITH counted AS (
  SELECT measurement_id, experiment_id, fly_id, datetime, value, reading_type FROM (
    SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, datetime, reading_type ORDER BY measurement_id) AS rn
    FROM readings WHERE value IS NOT NULL) WHERE rn = 1),
expt AS (SELECT experiment_id, any_value(start_date) AS start_date, any_value(end_date) AS end_date,
  any_value(lights_on_hour) AS lights_on, any_value(lights_off_hour) AS lights_off FROM experiments GROUP BY 1),
fly AS (SELECT fly_id, min(monitor) AS monitor, min(channel) AS channel, min(strain) AS genotype, min(sx) AS sex, min(trim(treatment)) AS treatment FROM (
  SELECT f.*, s.genotype AS strain, CASE upper(substr(trim(f.sex), 1, 1)) WHEN 'F' THEN 'Female' WHEN 'M' THEN 'Male' END AS sx
  FROM flies f LEFT JOIN strains s ON lower(regexp_replace(f.genotype, '^\s+|\s+$', '', 'g')) = lower(s.genotype)) GROUP BY 1),
alltimed AS (SELECT c.*, e.start_date, e.end_date, e.lights_on, e.lights_off, CAST(datetime AS DATE) AS blk,
  ((hour(datetime) + minute(datetime) / 60.0 - lights_on) % 24 + 24) % 24 AS raw,
  date_diff('day', start_date, CAST(datetime AS DATE)) + 1 AS exp_day
  FROM counted c JOIN expt e USING (experiment_id)),
ztimed AS (SELECT *, CAST(floor(raw) AS INTEGER) AS zt, CASE WHEN raw < 12 THEN 'Light' ELSE 'Dark' END AS phase FROM alltimed),
timed AS (SELECT * FROM ztimed WHERE reading_type = 'MT' AND value BETWEEN 0 AND 1000),
minutes AS (SELECT experiment_id, fly_id, blk, exp_day, zt, phase, lights_on, lights_off, date_trunc('minute', datetime) AS minute, CAST(sum(value) AS BIGINT) AS value
  FROM timed GROUP BY ALL),
hourly AS (SELECT experiment_id, fly_id, blk, exp_day, zt, CAST(sum(value) AS BIGINT) AS hourly FROM timed GROUP BY ALL)
"""

RUNS = (
    BASE
    + """, flagged AS (SELECT *, value = 0 AS z, CASE WHEN (value = 0) = lag(value = 0) OVER (PARTITION BY experiment_id, fly_id, blk ORDER BY minute) THEN 0 ELSE 1 END AS nw FROM minutes),
islands AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id, fly_id, blk ORDER BY minute ROWS UNBOUNDED PRECEDING) AS run FROM flagged),
runs AS (SELECT experiment_id, fly_id, blk, exp_day, z, run, min(minute) AS start, max(minute) AS "end", count(*) AS length, CAST(sum(value) AS BIGINT) AS total FROM islands GROUP BY ALL)
"""
)

DAILY = (
    RUNS
    + """, daily AS (SELECT experiment_id, fly_id, blk, exp_day, CAST(sum(total) AS BIGINT) AS total_activity,
  CAST(coalesce(max(length) FILTER (WHERE z), 0) AS BIGINT) AS longest_zero, CAST(coalesce(sum(length) FILTER (WHERE z AND length >= 5), 0) AS BIGINT) AS total_sleep
  FROM runs GROUP BY ALL),
direct AS (SELECT experiment_id, fly_id, blk, avg(CASE WHEN value > 0 THEN 1.0 ELSE 0.0 END) AS activity_index,
  CAST(coalesce(sum(value) FILTER (WHERE abs(hour(minute) + minute(minute) / 60.0 - lights_on) <= 10 / 60.0 OR abs(hour(minute) + minute(minute) / 60.0 - lights_off) <= 10 / 60.0), 0) AS BIGINT) AS transition_counts
  FROM minutes GROUP BY ALL),
missing AS (SELECT experiment_id, fly_id, CAST(datetime AS DATE) AS blk, avg(CASE WHEN value IS NULL THEN 1.0 ELSE 0.0 END) AS missing_fraction FROM readings WHERE reading_type = 'MT' GROUP BY ALL),
refd AS (SELECT d.*, x.activity_index, x.transition_counts, m.missing_fraction,
  max(total_activity) FILTER (WHERE exp_day = 4) OVER (PARTITION BY d.experiment_id, d.fly_id) AS ref_activity
  FROM daily d JOIN direct x USING (experiment_id, fly_id, blk) LEFT JOIN missing m USING (experiment_id, fly_id, blk)),
rel AS (SELECT *, CASE WHEN ref_activity > 0 THEN total_activity / ref_activity END AS rel_activity FROM refd),
declined AS (SELECT *, CASE WHEN ref_activity IS NULL THEN 'No Reference' WHEN rel_activity < 0.2 THEN 'Dead (by decline)' WHEN rel_activity < 0.5 THEN 'Unhealthy (by decline)' ELSE 'Stable' END AS decline_status FROM rel),
rawstatus AS (SELECT *, CASE WHEN longest_zero >= 1440 THEN 'Dead' WHEN longest_zero >= 720 AND transition_counts = 0 THEN 'Dead'
  WHEN (total_activity <= 50 OR activity_index <= 0.02 OR total_sleep >= 1300 OR longest_zero >= 720) AND transition_counts = 0 THEN 'Unhealthy'
  WHEN missing_fraction > 0.1 THEN 'QC_Fail' ELSE 'Alive' END AS one_day,
  CASE WHEN longest_zero >= 1440 THEN 'Dead' WHEN longest_zero >= 720 AND transition_counts = 0 THEN 'Dead' WHEN decline_status = 'Dead (by decline)' THEN 'Dead'
  WHEN (total_activity <= 50 OR activity_index <= 0.02 OR total_sleep >= 1300 OR longest_zero >= 720) AND transition_counts = 0 THEN 'Unhealthy'
  WHEN decline_status = 'Unhealthy (by decline)' THEN 'Unhealthy' WHEN missing_fraction > 0.1 THEN 'QC_Fail' ELSE 'Alive' END AS with_decline FROM declined),
statuses AS (SELECT *, CASE WHEN bool_or(with_decline = 'Dead') OVER (PARTITION BY experiment_id, fly_id ORDER BY exp_day ROWS UNBOUNDED PRECEDING) THEN 'Dead' ELSE with_decline END AS status FROM rawstatus)
"""
)

FIT = """
  CASE WHEN n >= 3 AND vcc * vss - vcs * vcs > 1e-12 THEN (vyc * vss - vys * vcs) / (vcc * vss - vcs * vcs) END AS a,
  CASE WHEN n >= 3 AND vcc * vss - vcs * vcs > 1e-12 THEN (vys * vcc - vyc * vcs) / (vcc * vss - vcs * vcs) END AS b"""


def cosinor(source: str, keys: str, hour: str, value: str) -> str:
    """Common table expressions ending in ``fit``: keys, n, mesor, amplitude, phase, p_value."""
    c, s = f"cos(2 * pi() * {hour} / 24)", f"sin(2 * pi() * {hour} / 24)"
    return f""", moments AS (SELECT {keys}, count(*) AS n, avg({value}) AS my, avg({c}) AS mc, avg({s}) AS ms, var_pop({c}) AS vcc, var_pop({s}) AS vss, covar_pop({c}, {s}) AS vcs,
  covar_pop({value}, {c}) AS vyc, covar_pop({value}, {s}) AS vys, var_pop({value}) AS vyy FROM {source} GROUP BY {keys}),
ab AS (SELECT *, {FIT} FROM moments),
ex AS (SELECT *, a * vyc + b * vys AS explained FROM ab),
fit AS (SELECT {keys}, n, my - a * mc - b * ms AS mesor, sqrt(a * a + b * b) AS amplitude,
  ((atan2(-b, a) * 24 / (2 * pi())) % 24 + 24) % 24 AS phase,
  CASE WHEN n <= 3 OR vyy <= 0 OR a IS NULL THEN NULL WHEN greatest(0, vyy - explained) <= 1e-12 * vyy THEN 0.0
    ELSE power(1 + 2 * ((explained / 2) / (greatest(0, vyy - explained) / (n - 3))) / (n - 3), -(n - 3) / 2.0) END AS p_value FROM ex)
"""
