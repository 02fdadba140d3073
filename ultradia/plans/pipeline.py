"""Queries of the data-processing problems 1 to 6 over the given tables, and the SQL they are checked with."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ultradia.operators import badrows, grid, hotdeck, rolling, sessions, spikes
from ultradia.operators.readings import SOURCE, day_stamp, stamp, usable_readings
from ultradia.session import scratch_path, written

SESSION_GAP_S = 1800
ARRIVALS = 4


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


# 1 -------------------------------------------------------------------------------------------

def activity_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sessions of all readings, loaded in ARRIVALS batches by order of arrival into one session table."""
    readings = table(spark, sf_dir, "readings")
    low, high = readings.agg(F.min("measurement_id"), F.max("measurement_id")).first()
    active = usable_readings(readings, low=1).withColumn("batch", sessions.arrival_batch("measurement_id", low or 0, high or 0, ARRIVALS))
    parts = written(sessions.local_sessions(active, [*SOURCE, "batch"], "datetime", SESSION_GAP_S, placed_by=["blk"]), "local-sessions")
    store = sessions.SessionTable(spark, scratch_path(spark, "sessions"), SOURCE, SESSION_GAP_S)
    for i in range(ARRIVALS):
        store.upsert(parts.where(F.col("batch") == i), name=f"arrival-{i}")
    return sessions.described(store.sessions(parts), SOURCE)


def p1_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity_sessions(spark, sf_dir)
    return found.select(*SOURCE, stamp(F.col("session_start")).alias("session_start"), stamp(F.col("session_end")).alias("session_end"))


def p1_sessions(spark: SparkSession, sf_dir: str) -> DataFrame:
    found = activity_sessions(spark, sf_dir)
    return found.select(
        *SOURCE, stamp(F.col("session_start")).alias("session_start"), stamp(F.col("session_end")).alias("session_end"), F.col("duration_s").cast("long").alias("duration_s"), "n_events"
    )


# 2 -------------------------------------------------------------------------------------------

def filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    return hotdeck.filled_fields(table(spark, sf_dir, "features"), table(spark, sf_dir, "flies"), table(spark, sf_dir, "strains"))


def p2_filled(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every fly and field, filled; the two numbers as numbers, the genotype as text."""
    numbers = {k: F.expr(f"try_cast({c} as double)") for k, c in (("number", "value"), ("filled_number", "filled_value"))}
    texts = {k: F.when(F.col("field") == "genotype", F.col(c)) for k, c in (("genotype", "value"), ("filled_genotype", "filled_value"))}
    return filled(spark, sf_dir).withColumns(numbers | texts).drop("value", "filled_value")


def p2_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the deck filled, and what it found no donor for."""
    return filled(spark, sf_dir).where("was_filled or filled_value is null").select(*SOURCE, "field")


# 3 -------------------------------------------------------------------------------------------

def p3_flags(spark: SparkSession, sf_dir: str) -> DataFrame:
    flags = spikes.implausible_readings(table(spark, sf_dir, "readings"))
    return flags.withColumns({"datetime": stamp(F.col("datetime")), "score": F.round("score", 6), "deviation": F.round("deviation", 6)})


def p3_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return p3_flags(spark, sf_dir).where("is_impossible or is_spike or is_stuck").select("measurement_id")


# 4 -------------------------------------------------------------------------------------------

def p4_grid(spark: SparkSession, sf_dir: str) -> DataFrame:
    return grid.regular_grid(table(spark, sf_dir, "readings"))


def p4_marked(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The grid with the status of every hour, and the totals of the observed ones."""
    g = p4_grid(spark, sf_dir)
    return g.select(*SOURCE, stamp(F.col("hour")).alias("hour"), "status", F.when(F.col("status") == "observed", F.col("total")).alias("observed_total"))


def p4_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    gaps = grid.hour_gaps(p4_grid(spark, sf_dir))
    return gaps.select(*SOURCE, stamp(F.col("gap_start")).alias("gap_start"), stamp(F.col("gap_end")).alias("gap_end"))


# 5 -------------------------------------------------------------------------------------------

def p5_loaded(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.split_lines(table(spark, sf_dir, "details"))[0]


def p5_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    return badrows.split_lines(table(spark, sf_dir, "details"))[1].select("line_id", "reason")


# 6 -------------------------------------------------------------------------------------------

def p6_rolling(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Totals and averages of the last 7 and 30 days for every source and day of both origins."""
    ends = table(spark, sf_dir, "experiments").select("experiment_id", "end_date")
    from_readings = usable_readings(table(spark, sf_dir, "readings")).groupBy(*SOURCE, F.col("blk").alias("day")).agg(F.sum("value").alias("total"))
    reports = table(spark, sf_dir, "health_reports").where(F.col("report_date").isNotNull())
    from_reports = reports.groupBy(*SOURCE, F.col("report_date").alias("day")).agg(F.max_by("total_activity", "health_report_id").cast("long").alias("total"))
    daily = from_readings.withColumn("origin", F.lit("readings")).unionByName(from_reports.withColumn("origin", F.lit("health_reports")))
    keys = ["origin", *SOURCE]
    days = rolling.daily_grid(daily.join(ends, "experiment_id"), keys, "day", "total", "end_date")
    return rolling.trailing_sums(days, keys, (7, 30)).withColumns({"day": day_stamp(F.col("day")), "first_day": day_stamp(F.col("first_day"))})


def p6_found(spark: SparkSession, sf_dir: str) -> DataFrame:
    days = p6_rolling(spark, sf_dir)
    case = (F.datediff("day", "first_day") >= 29) & (F.col("total_30") > 0) & (120 * F.col("total_7") < 7 * F.col("total_30"))
    return days.where(case).select("origin", *SOURCE, "day")


QUERIES = {
    "p1_found": p1_found,
    "p1_sessions": p1_sessions,
    "p2_found": p2_found,
    "p2_filled": p2_filled,
    "p3_found": p3_found,
    "p3_flags": p3_flags,
    "p4_found": p4_found,
    "p4_grid": p4_grid,
    "p4_marked": p4_marked,
    "p5_found": p5_found,
    "p5_loaded": p5_loaded,
    "p6_found": p6_found,
    "p6_rolling": p6_rolling,
}

COUNTED = """
WITH counted AS (
  SELECT measurement_id, experiment_id, fly_id, datetime, value, reading_type FROM (
    SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, datetime, reading_type ORDER BY measurement_id) AS rn
    FROM readings WHERE value IS NOT NULL) WHERE rn = 1),
mt AS (SELECT * FROM counted WHERE reading_type = 'MT'),
usable AS (SELECT * FROM mt WHERE value BETWEEN 0 AND 1000)
"""

_SESSIONS = (
    COUNTED
    + """, marked AS (
  SELECT *, CASE WHEN date_diff('second', lag(datetime) OVER w, datetime) <= 1800 THEN 0 ELSE 1 END AS is_new
  FROM usable WHERE value > 0 WINDOW w AS (PARTITION BY experiment_id, fly_id ORDER BY datetime)),
numbered AS (SELECT *, sum(is_new) OVER (PARTITION BY experiment_id, fly_id ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS s FROM marked)
SELECT experiment_id, fly_id, strftime(min(datetime), '%Y-%m-%d %H:%M:%S') AS session_start, strftime(max(datetime), '%Y-%m-%d %H:%M:%S') AS session_end{more}
FROM numbered GROUP BY experiment_id, fly_id, s"""
)

_ROLLED = (
    COUNTED
    + """, days AS (
  SELECT 'readings' AS origin, experiment_id, fly_id, CAST(datetime AS DATE) AS day, CAST(sum(value) AS BIGINT) AS total FROM usable GROUP BY ALL
  UNION ALL
  SELECT 'health_reports', experiment_id, fly_id, report_date, CAST(coalesce(total_activity, 0) AS BIGINT) FROM (
    SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, report_date ORDER BY health_report_id DESC) AS rn FROM health_reports) WHERE rn = 1),
firsts AS (SELECT d.origin, d.experiment_id, d.fly_id, min(d.day) AS first_day, any_value(e.end_date) AS end_date
  FROM days d JOIN experiments e USING (experiment_id) GROUP BY 1, 2, 3),
grid AS (SELECT f.origin, f.experiment_id, f.fly_id, f.first_day, CAST(g.d AS DATE) AS day
  FROM firsts f, LATERAL (SELECT unnest(generate_series(f.first_day, f.end_date, INTERVAL 1 DAY)) AS d) g),
filled AS (SELECT g.*, coalesce(d.total, 0) AS total, d.day IS NOT NULL AS observed
  FROM grid g LEFT JOIN days d USING (origin, experiment_id, fly_id, day)),
rolled AS (SELECT *, CAST(sum(total) OVER (w ROWS 6 PRECEDING) AS BIGINT) AS total_7, CAST(sum(total) OVER (w ROWS 29 PRECEDING) AS BIGINT) AS total_30
  FROM filled WINDOW w AS (PARTITION BY origin, experiment_id, fly_id ORDER BY day))
"""
)

_GENOTYPE = """SELECT f.experiment_id, f.fly_id, 'genotype' AS field FROM flies f
  LEFT JOIN (SELECT lower(genotype) AS code FROM strains) s ON lower(regexp_replace(f.genotype, '^\\s+|\\s+$', '', 'g')) = s.code
  GROUP BY 1, 2 HAVING count(s.code) = 0"""

_MEDIANS = """, levels AS (SELECT experiment_id, fly_id, median(value) AS level FROM mt WHERE value BETWEEN 1 AND 1000 GROUP BY 1, 2),
marked AS (SELECT *, CASE WHEN value = lag(value) OVER (PARTITION BY experiment_id, fly_id ORDER BY datetime) THEN 0 ELSE 1 END AS is_new FROM mt),
runs AS (SELECT *, sum(is_new) OVER (PARTITION BY experiment_id, fly_id ORDER BY datetime ROWS UNBOUNDED PRECEDING) AS run FROM marked),
sized AS (SELECT *, count(*) OVER (PARTITION BY experiment_id, fly_id, run) AS n FROM runs)
"""
#: Missing values beside every donor of the same field, ranked as the deck does.
_DECK = r"""
WITH known AS (SELECT f.experiment_id, f.fly_id, min(s.genotype) AS strain, lower(substr(min(trim(f.sex)), 1, 1)) AS sex, min(trim(f.treatment)) AS treatment
  FROM flies f LEFT JOIN strains s ON lower(regexp_replace(f.genotype, '^\s+|\s+$', '', 'g')) = lower(s.genotype) GROUP BY 1, 2),
alike AS (SELECT fly_id, min(concat_ws('|', strain, sex, treatment)) AS alike FROM known GROUP BY 1),
per AS (SELECT experiment_id, fly_id, min(CASE WHEN NOT isnan(p_doze_mean) AND p_doze_mean BETWEEN 0 AND 1 THEN p_doze_mean END) AS p_doze_mean,
  min(CASE WHEN NOT isnan(total_sleep_mean) AND total_sleep_mean BETWEEN 0 AND 1440 THEN total_sleep_mean END) AS total_sleep_mean FROM features GROUP BY 1, 2),
cells AS (SELECT experiment_id, fly_id, coalesce(alike, '') AS alike, 'p_doze_mean' AS field, p_doze_mean AS number, NULL AS genotype FROM per LEFT JOIN alike USING (fly_id)
  UNION ALL SELECT experiment_id, fly_id, coalesce(alike, ''), 'total_sleep_mean', total_sleep_mean, NULL FROM per LEFT JOIN alike USING (fly_id)
  UNION ALL SELECT experiment_id, fly_id, '', 'genotype', NULL, strain FROM known),
placed AS (SELECT *, coalesce(regexp_extract(fly_id, '^M(.*)_Ch[0-9]+$', 1), '') AS monitor, coalesce(TRY_CAST(regexp_extract(fly_id, '_Ch([0-9]+)$', 1) AS DOUBLE), 0) AS o, number IS NULL AND genotype IS NULL AS missing FROM cells),
pairs AS (SELECT m.experiment_id, m.fly_id, m.field, d.fly_id AS donor, d.number AS filled_number, d.genotype AS filled_genotype, abs(d.o - m.o) AS distance,
  CASE WHEN d.experiment_id <> m.experiment_id THEN 3 WHEN d.monitor <> m.monitor THEN 2 WHEN d.alike <> m.alike THEN 1 ELSE 0 END AS scope, d.o < m.o OR (d.o = m.o AND d.fly_id < m.fly_id) AS before
  FROM placed m JOIN placed d ON m.field = d.field AND m.missing AND NOT d.missing),
sided AS (SELECT *, before AND NOT (scope > 0 AND distance = 0) AS back FROM pairs),
best AS (SELECT * FROM sided QUALIFY row_number() OVER (PARTITION BY experiment_id, fly_id, field ORDER BY scope, distance, back DESC, CASE WHEN back THEN donor END DESC, donor) = 1)
SELECT p.experiment_id, p.fly_id, p.field, p.number, p.genotype, coalesce(p.number, b.filled_number) AS filled_number, coalesce(p.genotype, b.filled_genotype) AS filled_genotype, p.missing AS was_missing,
  b.donor IS NOT NULL AS was_filled, b.donor, CAST(CASE WHEN p.field = 'genotype' THEN greatest(b.scope - 1, 0) ELSE b.scope END AS INTEGER) AS donor_scope, b.distance
FROM placed p LEFT JOIN best b USING (experiment_id, fly_id, field)"""
_FIELD = r'(?: *"[^"]*(?:""[^"]*)*" *|[^"\x{E000}]*)'
_NUMBER = r"(?:[0-9]*[1-9][0-9]*(?:\.[0-9]+)?|[0-9]+\.[0-9]*[1-9][0-9]*|\.[0-9]*[1-9][0-9]*)"
_DOSE = _NUMBER + r" ?[mu]M [A-Za-z]{2,}"


def _text(i: int) -> str:
    cell = f"trim(fields[{i}], ' ')"
    return f"""CASE WHEN five THEN replace(CASE WHEN starts_with({cell}, '"') THEN replace(substr({cell}, 2, length({cell}) - 2), '""', '"') ELSE {cell} END, chr(57344), delimiter) END"""


_LINES = rf"""
WITH heads AS (SELECT source_file, min(regexp_extract(raw_line, '^ *Monitor(.)Channel', 1)) AS delimiter FROM details WHERE line_no = 1 AND regexp_matches(raw_line, '^ *Monitor(.)Channel') GROUP BY 1),
marked AS (SELECT l.*, delimiter, CASE WHEN delimiter IS NULL THEN raw_line ELSE replace(raw_line, delimiter, chr(57344)) END AS line FROM details l LEFT JOIN heads USING (source_file)),
formed AS (SELECT *, regexp_matches(line, '^{_FIELD}(?:\x{{E000}}{_FIELD})*$') AS form FROM marked),
cut AS (SELECT *, CASE WHEN form THEN regexp_extract_all(chr(57344) || line, '\x{{E000}}({_FIELD})', 1) END AS fields FROM formed),
counted AS (SELECT *, coalesce(len(fields) = 5, false) AS five FROM cut),
named AS (SELECT *, {_text(1)} AS monitor, {_text(2)} AS channel, {_text(3)} AS genotype, {_text(4)} AS sex, {_text(5)} AS treatment FROM counted),
ruled AS (SELECT *, regexp_matches(channel, '^[cC][hH](0?[1-9]|[12][0-9]|3[0-2])$') AS good_channel, regexp_matches(treatment, '^(?:VEH|{_DOSE}(?: \+ {_DOSE})*)(?: \([^()]*\))?$') AS good_treatment FROM named
  WHERE line_no <> 1 AND NOT regexp_matches(raw_line, '^ *$')),
kept AS (SELECT *, CASE WHEN NOT form THEN 'quoting' WHEN NOT five THEN 'columns' WHEN NOT good_channel THEN 'channel' WHEN NOT good_treatment THEN 'treatment' END AS reason FROM ruled
  WHERE NOT (five AND good_channel AND lower(genotype) = 'na' AND lower(sex) = 'na' AND lower(treatment) = 'na'))
"""

ORACLE = {
    "p1_found": _SESSIONS.replace("{more}", ""),
    "p1_sessions": _SESSIONS.replace("{more}", ", CAST(date_diff('second', min(datetime), max(datetime)) AS BIGINT) AS duration_s, count(*) AS n_events"),
    "p2_found": f"""
SELECT experiment_id, fly_id, 'p_doze_mean' AS field FROM features GROUP BY 1, 2
HAVING count(*) FILTER (WHERE NOT isnan(p_doze_mean) AND p_doze_mean BETWEEN 0 AND 1) = 0
UNION ALL SELECT experiment_id, fly_id, 'total_sleep_mean' FROM features GROUP BY 1, 2
HAVING count(*) FILTER (WHERE NOT isnan(total_sleep_mean) AND total_sleep_mean BETWEEN 0 AND 1440) = 0
UNION ALL {_GENOTYPE}""",
    "p2_filled": _DECK,
    "p3_flags": COUNTED
    + _MEDIANS
    + """, steps AS (SELECT experiment_id, fly_id, abs(value - lag(value) OVER (PARTITION BY experiment_id, fly_id, CAST(datetime AS DATE) ORDER BY datetime)) AS step FROM mt),
scales AS (SELECT experiment_id, fly_id, median(step) * 1.4826 AS deviation FROM steps WHERE step BETWEEN 0 AND 1000 GROUP BY 1, 2),
smooth AS (SELECT *, avg(value) OVER (d ROWS 1 PRECEDING) AS s1, avg(value) OVER (d ROWS 3 PRECEDING) AS s2, avg(value) OVER (d ROWS 7 PRECEDING) AS s3
  FROM sized WINDOW d AS (PARTITION BY experiment_id, fly_id, CAST(datetime AS DATE) ORDER BY datetime))
SELECT measurement_id, experiment_id, fly_id, strftime(datetime, '%Y-%m-%d %H:%M:%S') AS datetime, value, level, round(deviation, 6) AS deviation,
  CASE WHEN level IS NOT NULL THEN round(greatest(value - s1, s1 - s2, s2 - s3, s3 - level) / level, 6) END AS score, n AS run_length, value NOT BETWEEN 0 AND 1000 AS is_impossible,
  coalesce(value > 6 * level, false) AS is_spike, value > 0 AND n >= 12 AS is_stuck
FROM smooth LEFT JOIN levels USING (experiment_id, fly_id) LEFT JOIN scales USING (experiment_id, fly_id)""",
    "p3_found": COUNTED
    + _MEDIANS
    + """SELECT measurement_id FROM sized LEFT JOIN levels USING (experiment_id, fly_id)
WHERE value < 0 OR value > 1000 OR value > 6 * level OR (value > 0 AND n >= 12)""",
    "p4_found": COUNTED
    + """, hours AS (SELECT DISTINCT experiment_id, fly_id, date_trunc('hour', datetime) AS h FROM usable),
following AS (SELECT *, lead(h) OVER (PARTITION BY experiment_id, fly_id ORDER BY h) AS later FROM hours)
SELECT experiment_id, fly_id, strftime(h + INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS gap_start,
  strftime(later - INTERVAL 1 HOUR, '%Y-%m-%d %H:%M:%S') AS gap_end FROM following WHERE later > h + INTERVAL 1 HOUR""",
    "p4_marked": COUNTED
    + """, hours AS (SELECT experiment_id, fly_id, date_trunc('hour', datetime) AS h, CAST(sum(value) AS DOUBLE) AS total FROM usable GROUP BY ALL),
ends AS (SELECT experiment_id, fly_id, min(h) AS a, max(h) AS b, count(*) AS n FROM hours GROUP BY 1, 2),
grid AS (SELECT e.experiment_id, e.fly_id, e.n, g.h FROM ends e, LATERAL (SELECT unnest(generate_series(e.a, e.b, INTERVAL 1 HOUR)) AS h) g)
SELECT experiment_id, fly_id, strftime(h, '%Y-%m-%d %H:%M:%S') AS hour, CASE WHEN total IS NOT NULL THEN 'observed' WHEN n >= 3 THEN 'filled' ELSE 'unsupported' END AS status, total AS observed_total
FROM grid LEFT JOIN hours USING (experiment_id, fly_id, h)""",
    "p5_found": _LINES + "SELECT line_id, reason FROM kept WHERE reason IS NOT NULL",
    "p5_loaded": _LINES + "SELECT line_id, source_file, line_no, monitor, CAST(regexp_extract(channel, '([0-9]+)', 1) AS INTEGER) AS channel, genotype, sex, treatment FROM kept WHERE reason IS NULL",
    "p6_found": _ROLLED
    + """SELECT origin, experiment_id, fly_id, strftime(day, '%Y-%m-%d') AS day FROM rolled
WHERE date_diff('day', first_day, day) >= 29 AND total_30 > 0 AND 120 * total_7 < 7 * total_30""",
    "p6_rolling": _ROLLED
    + """SELECT origin, experiment_id, fly_id, strftime(day, '%Y-%m-%d') AS day, strftime(first_day, '%Y-%m-%d') AS first_day, total, observed, total_7, total_30, total_7 / 7.0 AS mean_7, total_30 / 30.0 AS mean_30 FROM rolled""",
}
