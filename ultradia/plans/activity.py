"""Queries of the activity analytics over readings, flies and experiments, and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import Column, DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ultradia.functions import timecols as T
from ultradia.operators import badrows, death, health, prepared, removal, rhythm, runs, sleep
from ultradia.operators.prepared import DAY
from ultradia.operators.readings import SOURCE, counted_readings, day_stamp, stamp
from ultradia.plans.sql import BASE, DAILY, RUNS, cosinor
from ultradia.session import written
from ultradia.sources import store

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}


def query(sql: str | None = None) -> Callable:
    """Registers a query under its function's name, with its SQL where there is one."""
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def timed(spark: SparkSession, sf_dir: str, types: tuple[str, ...] = ("MT",), low: int | None = 0) -> DataFrame:
    return prepared.timed_readings(table(spark, sf_dir, "readings"), table(spark, sf_dir, "experiments"), types, low)


def minutes(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared.minute_series(timed(spark, sf_dir))


def dense(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared.dense_minutes(minutes(spark, sf_dir))


def flies(spark: SparkSession, sf_dir: str) -> DataFrame:
    return prepared.fly_dim(table(spark, sf_dir, "flies"), table(spark, sf_dir, "strains"))


def r6(c: str | Column, name: str | None = None) -> Column:
    return F.round(F.col(c) if isinstance(c, str) else c, 6).alias(name or c)


# time columns and filters ----------------------------------------------------------------------

@query(BASE + "SELECT experiment_id, zt, phase, count(*) AS n, CAST(sum(value) AS BIGINT) AS total, CAST(min(exp_day) AS BIGINT) AS first_day, CAST(max(exp_day) AS BIGINT) AS last_day FROM timed GROUP BY ALL")
def t_zt_phase(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Circadian hour, phase and experiment day."""
    days = [F.min("exp_day").cast("long").alias("first_day"), F.max("exp_day").cast("long").alias("last_day")]
    return timed(spark, sf_dir).groupBy("experiment_id", "zt", "phase").agg(F.count(F.lit(1)).alias("n"), F.sum("value").alias("total"), *days)


@query(BASE + "SELECT experiment_id, CAST(round_even(raw, 0) AS INTEGER) % 24 AS zt, count(*) AS n, round(avg(raw), 6) AS mean_raw FROM timed GROUP BY ALL")
def t_zt_rounded(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The hour with its fraction, and rounded half to even."""
    on = F.col("lights_on")
    rows = timed(spark, sf_dir).select("experiment_id", T.raw_zt(F.col("datetime"), on).alias("raw"), T.rounded_zt(F.col("datetime"), on).alias("zt"))
    return rows.groupBy("experiment_id", "zt").agg(F.count(F.lit(1)).alias("n"), r6(F.avg("raw"), "mean_raw"))


@query(
    BASE
    + """, days AS (SELECT DISTINCT experiment_id, blk FROM timed)
SELECT experiment_id, strftime(blk, '%Y-%m-%d') AS day, CAST(dense_rank() OVER (PARTITION BY experiment_id ORDER BY blk) AS BIGINT) AS exp_day FROM days"""
)
def t_dense_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """T4: days numbered without gaps, over the distinct days."""
    days = timed(spark, sf_dir).select("experiment_id", "blk").distinct()
    rank = F.dense_rank().over(Window.partitionBy("experiment_id").orderBy("blk")).cast("long")
    return days.select("experiment_id", day_stamp(F.col("blk")).alias("day"), rank.alias("exp_day"))


@query(
    """SELECT fly_id, 'M' || monitor || '_Ch' || lpad(CAST(channel AS VARCHAR), 2, '0') AS built, monitor || '-ch' || CAST(channel AS VARCHAR) AS fly_key,
  round(sin(2 * pi() * channel / 24), 6) AS on_sin, round(cos(2 * pi() * channel / 24), 6) AS on_cos,
  lower(trim(coalesce(genotype, ''))) NOT IN ('', 'na', 'nan') AS genotype_ok, lower(trim(coalesce(genotype, ''))) NOT IN ('', 'na') AS genotype_ok_csv FROM flies"""
)
def t_fly_keys(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Identities, validity and the circular code."""
    f = table(spark, sf_dir, "flies")
    s, c = T.on_circle(F.col("channel"))
    return f.select(
        "fly_id",
        T.fly_id(F.col("monitor"), F.col("channel")).alias("built"),
        T.fly_key(F.col("monitor"), F.col("channel")).alias("fly_key"),
        r6(s, "on_sin"),
        r6(c, "on_cos"),
        T.is_ok(F.col("genotype")).alias("genotype_ok"),
        T.is_ok(F.col("genotype"), nan_is_ok=True).alias("genotype_ok_csv"),
    )


@query("SELECT feature_id, CASE WHEN NOT isnan(total_sleep_mean) AND NOT isinf(total_sleep_mean) THEN greatest(0, least(1440, total_sleep_mean)) END AS sleep, CASE WHEN NOT isnan(p_doze_mean) AND NOT isinf(p_doze_mean) THEN greatest(0, least(1, p_doze_mean)) END AS p_doze FROM features")
def t_clipped(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Values clipped to what their column can hold, NaN and infinite as null."""
    return table(spark, sf_dir, "features").select("feature_id", T.clipped(F.col("total_sleep_mean"), 0, 1440).alias("sleep"), T.clipped(F.col("p_doze_mean"), 0, 1).alias("p_doze"))


@query(
    BASE
    + """, r AS (SELECT *, min(hourly) OVER w AS lo, max(hourly) OVER w AS hi FROM hourly WINDOW w AS (PARTITION BY experiment_id, fly_id, blk))
SELECT experiment_id, fly_id, strftime(blk, '%Y-%m-%d') AS day, zt, hourly, round(CASE WHEN hi > lo THEN 0.8 * (hourly - lo) / (hi - lo) ELSE 0 END, 6) AS height FROM r"""
)
def t_actogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly totals scaled within each day."""
    w = Window.partitionBy(*DAY)
    lo, hi = F.min("hourly").over(w), F.max("hourly").over(w)
    height = F.when(F.col("hi") > F.col("lo"), 0.8 * (F.col("hourly") - F.col("lo")) / (F.col("hi") - F.col("lo"))).otherwise(0.0)
    rows = rhythm.hourly_totals(timed(spark, sf_dir)).withColumn("lo", lo).withColumn("hi", hi)
    return rows.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), "zt", "hourly", r6(height, "height"))


@query(
    BASE
    + """SELECT reading_type, experiment_id, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM ztimed
WHERE datetime >= CAST(start_date AS TIMESTAMP) + INTERVAL 33 HOUR AND datetime < CAST(start_date AS TIMESTAMP) + INTERVAL 153 HOUR AND exp_day NOT IN (1, 7) GROUP BY ALL"""
)
def f_date_window(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five days from 09:00 of the second day on, without the excluded days."""
    rows = timed(spark, sf_dir, ("MT", "CT", "Pn"), None)
    at = F.expr("timestampdiff(HOUR, cast(start_date as timestamp_ntz), datetime)")
    kept = rows.where((at >= 33) & (at < 153) & ~F.col("exp_day").isin(1, 7))
    return kept.groupBy("reading_type", "experiment_id").agg(F.count(F.lit(1)).alias("n"), F.sum(F.col("value").cast("long")).alias("total"))


@query(BASE + "SELECT fly_id, genotype, sex, treatment FROM fly WHERE upper(treatment) = 'VEH' AND genotype IS NOT NULL")
def f_vehicle(spark: SparkSession, sf_dir: str) -> DataFrame:
    """vehicle flies with a genotype."""
    return flies(spark, sf_dir).where((F.upper("treatment") == "VEH") & F.col("genotype").isNotNull()).select("fly_id", "genotype", "sex", "treatment")


@query(
    BASE
    + """, best AS (SELECT experiment_id, fly_id, max(value) FILTER (WHERE reading_type = 'MT') AS mt, max(value) FILTER (WHERE reading_type = 'Pn') AS pn FROM counted GROUP BY ALL)
SELECT experiment_id, fly_id FROM best WHERE coalesce(mt, 0) <= 0 OR coalesce(pn, 0) <= 0"""
)
def f_unusable_sources(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F8: sources without a positive MT or Pn reading."""
    rows = counted_readings(table(spark, sf_dir, "readings"), ("MT", "Pn", "CT"))
    best = rows.groupBy(*SOURCE).agg(*[F.coalesce(F.max(F.when(F.col("reading_type") == t, F.col("value"))), F.lit(0)).alias(t) for t in ("MT", "Pn")])
    return best.where("MT <= 0 or Pn <= 0").select(*SOURCE)


def removal_stage(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fly-days of the latest reports with the first rule that removes them: status, fly, day, metadata, or kept.

    Rules in use: status Dead; channel 13; days 1 and 7; genotype Obd or treatment 10mM Gly, case aside.
    """
    reports = health.latest_reports(table(spark, sf_dir, "health_reports"))
    known = table(spark, sf_dir, "experiments").select("experiment_id", "start_date").dropDuplicates(["experiment_id"])
    dead = reports.where("status = 'Dead'").select(*SOURCE).distinct().withColumn("dead", F.lit(True))
    rows = reports.join(known, "experiment_id").join(dead, SOURCE, "left").join(flies(spark, sf_dir), "fly_id", "left")
    stage = (
        F.when(F.col("dead"), "status")
        .when(F.col("channel") == 13, "fly")
        .when(T.exp_day(F.col("report_date"), F.col("start_date")).isin(1, 7), "day")
        .when((F.lower("genotype") == "obd") | (F.lower("treatment") == "10mm gly"), "metadata")
        .otherwise("kept")
    )
    return rows.withColumn("stage", stage)


_REMOVAL = BASE + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, report_date ORDER BY health_report_id DESC) AS rn FROM health_reports) WHERE rn = 1),
staged AS (SELECT l.*, CASE WHEN (l.experiment_id, l.fly_id) IN (SELECT (experiment_id, fly_id) FROM latest WHERE status = 'Dead') THEN 'status'
  WHEN channel = 13 THEN 'fly' WHEN date_diff('day', start_date, report_date) + 1 IN (1, 7) THEN 'day'
  WHEN lower(genotype) = 'obd' OR lower(treatment) = '10mm gly' THEN 'metadata' ELSE 'kept' END AS stage
  FROM latest l JOIN expt USING (experiment_id) LEFT JOIN fly USING (fly_id))
"""


@query(_REMOVAL + "SELECT stage, count(*) AS n, count(DISTINCT (experiment_id, fly_id)) AS sources FROM staged GROUP BY 1")
def f_removal_counters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Rows removed by each stage."""
    return removal_stage(spark, sf_dir).groupBy("stage").agg(F.count(F.lit(1)).alias("n"), F.count_distinct(*SOURCE).alias("sources"))


@query(_REMOVAL + "SELECT health_report_id FROM staged WHERE stage = 'kept'")
def f_removal_kept(spark: SparkSession, sf_dir: str) -> DataFrame:
    """the rows no stage removes."""
    return removal_stage(spark, sf_dir).where("stage = 'kept'").select("health_report_id")


def removal_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fly-days of the latest reports with what removal looks at."""
    reports = health.latest_reports(table(spark, sf_dir, "health_reports"))
    known = table(spark, sf_dir, "experiments").select("experiment_id", "start_date").dropDuplicates(["experiment_id"])
    rows = reports.join(known, "experiment_id").join(flies(spark, sf_dir), "fly_id", "left")
    return rows.withColumn("exp_day", T.exp_day(F.col("report_date"), F.col("start_date")))


def removal_by_arguments(spark: SparkSession, sf_dir: str, which: str) -> DataFrame:
    """Rows staged with one set of arguments; flies are the first key of each experiment, days the first three of its last key."""
    rows = removal_rows(spark, sf_dir)
    keys = rows.where("monitor is not null and channel is not null").groupBy("experiment_id").agg(F.min(removal.fly_key()).alias("low"), F.max(removal.fly_key()).alias("high"))
    first = keys.select(F.col("low").alias("fly_key"))
    days = keys.select(F.col("high").alias("fly_key"), F.explode(F.array(*[F.lit(i) for i in (1, 2, 3)])).alias("exp_day"))
    reports = rows.select(*SOURCE, "status")
    given = {
        "nothing": {},
        "flies": {"flies": first},
        "days": {"fly_days": days},
        "metadata": {"genotypes": ["obd"], "sexes": ["MALE"], "treatments": ["veh"]},
        "status": {"statuses": ["Dead", "QC_Fail"], "reports": reports},
        "all": {"flies": first, "fly_days": days, "genotypes": ["obd"], "statuses": ["Dead"], "reports": reports},
    }
    return removal.staged(rows, **given[which])


_STAGED = (
    BASE
    + """, latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, report_date ORDER BY health_report_id DESC) AS rn FROM health_reports) WHERE rn = 1),
r AS (SELECT l.*, monitor, channel, genotype, sex, treatment, lower(monitor || '-ch' || channel) AS key, CAST(date_diff('day', start_date, report_date) + 1 AS INTEGER) AS exp_day FROM latest l JOIN expt USING (experiment_id) LEFT JOIN fly USING (fly_id)),
keys AS (SELECT experiment_id, min(key) AS low, max(key) AS high FROM r GROUP BY 1),
f AS (SELECT *, (experiment_id, fly_id) IN (SELECT (experiment_id, fly_id) FROM latest WHERE status = 'Dead') AS dead, (experiment_id, fly_id) IN (SELECT (experiment_id, fly_id) FROM latest WHERE status IN ('Dead', 'QC_Fail')) AS failed,
  coalesce(key IN (SELECT low FROM keys), false) AS fly, coalesce(key IN (SELECT high FROM keys), false) AND exp_day IN (1, 2, 3) AS day, coalesce(lower(genotype) = 'obd', false) AS obd FROM r),
s AS (SELECT 'nothing' AS arguments, 'kept' AS stage, experiment_id, fly_id FROM f
  UNION ALL SELECT 'flies', CASE WHEN fly THEN 'fly' ELSE 'kept' END, experiment_id, fly_id FROM f
  UNION ALL SELECT 'days', CASE WHEN day THEN 'day' ELSE 'kept' END, experiment_id, fly_id FROM f
  UNION ALL SELECT 'metadata', CASE WHEN obd OR coalesce(lower(sex) = 'male', false) OR coalesce(lower(treatment) = 'veh', false) THEN 'metadata' ELSE 'kept' END, experiment_id, fly_id FROM f
  UNION ALL SELECT 'status', CASE WHEN failed THEN 'status' ELSE 'kept' END, experiment_id, fly_id FROM f
  UNION ALL SELECT 'all', CASE WHEN dead THEN 'status' WHEN fly THEN 'fly' WHEN day THEN 'day' WHEN obd THEN 'metadata' ELSE 'kept' END, experiment_id, fly_id FROM f)
"""
)


@query(_STAGED + "SELECT arguments, stage, count(*) AS n, count(DISTINCT (experiment_id, fly_id)) AS sources FROM s GROUP BY 1, 2")
def f_removal_arguments(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counters of each stage for six sets of arguments."""
    out = None
    for which in ("nothing", "flies", "days", "metadata", "status", "all"):
        part = removal.counters(removal_by_arguments(spark, sf_dir, which)).select(F.lit(which).alias("arguments"), "stage", "n", "sources")
        out = part if out is None else out.unionByName(part)
    return out


_TABLES = ("features_z", "features", "health_reports", "readings", "flies", "experiments")


@query(" UNION ALL ".join(f"SELECT '{t}' AS table_name, count(*) AS n FROM {t} WHERE experiment_id <> (SELECT max_by(experiment_id, (created_at, experiment_id)) FROM experiments)" for t in _TABLES))
def k_cascade(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7, SNK8: rows that each table keeps when the latest experiment is deleted."""
    gone = table(spark, sf_dir, "experiments").agg(F.max_by("experiment_id", F.struct("created_at", "experiment_id")).alias("experiment_id"))
    out = None
    for name in store.CASCADE:
        part = store.without_experiments(table(spark, sf_dir, name).where("experiment_id is not null"), gone).agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("table_name"), "n")
        out = part if out is None else out.unionByName(part)
    return out


@query(" UNION ALL ".join(f"SELECT experiment_id, '{t}' AS table_name, count(*) AS n FROM {t} GROUP BY 1" for t in _TABLES))
def k_experiment_info(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK10, SNK11: rows of each experiment in each table."""
    return store.experiment_info(spark, sf_dir)


# joins -------------------------------------------------------------------------------------------

@query(BASE + "SELECT genotype, sex, reading_type, count(*) AS n, CAST(sum(value) AS BIGINT) AS total FROM counted LEFT JOIN fly USING (fly_id) WHERE reading_type IN ('MT', 'CT') AND value BETWEEN 0 AND 1000 GROUP BY ALL")
def j_readings_flies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC6, J1, J2: readings with their fly's metadata; summed per fly before the join, so the hot fly is one row."""
    rows = counted_readings(table(spark, sf_dir, "readings"), ("MT", "CT")).where(F.col("value").between(0, 1000))
    per = rows.groupBy("fly_id", "reading_type").agg(F.count(F.lit(1)).alias("k"), F.sum("value").alias("v"))
    joined = prepared.with_flies(per, flies(spark, sf_dir))
    return joined.groupBy("genotype", "sex", "reading_type").agg(F.sum("k").alias("n"), F.sum("v").alias("total"))


@query(
    BASE
    + """, hours AS (SELECT experiment_id, fly_id, date_trunc('hour', datetime) AS hour, CAST(sum(value) AS BIGINT) AS v FROM timed GROUP BY ALL),
span AS (SELECT experiment_id, fly_id, min(hour) AS a, max(hour) AS b FROM hours GROUP BY ALL),
dense AS (SELECT s.experiment_id, s.fly_id, g.h AS hour FROM span s, LATERAL (SELECT unnest(generate_series(s.a, s.b, INTERVAL 1 HOUR)) AS h) g)
SELECT experiment_id, fly_id, strftime(hour, '%Y-%m-%d %H:%M:%S') AS hour, CAST(coalesce(v, 0) AS BIGINT) AS value FROM dense LEFT JOIN hours USING (experiment_id, fly_id, hour)"""
)
def j_dense_hours(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hourly sums of every hour from a source's first to its last; missing hours are put in after each present one, without a cross join."""
    w = Window.partitionBy(*SOURCE).orderBy("hour")
    hours = timed(spark, sf_dir).groupBy(*DAY, F.hour("datetime").alias("h")).agg(F.sum("value").alias("v")).withColumn("hour", F.expr("timestampadd(HOUR, h, cast(blk as timestamp_ntz))"))
    nxt = F.coalesce(F.expr("timestampadd(HOUR, -1, _next)"), F.col("hour"))
    dense = hours.withColumn("_next", F.lead("hour").over(w)).withColumn("at", F.explode(F.sequence("hour", nxt, F.expr("interval 1 hour"))))
    return dense.select(*SOURCE, stamp(F.col("at")).alias("hour"), F.when(F.col("at") == F.col("hour"), F.col("v")).otherwise(F.lit(0)).alias("value"))


@query("SELECT fly_id, experiment_id FROM flies f WHERE EXISTS (SELECT 1 FROM readings r WHERE r.fly_id = f.fly_id) AND NOT EXISTS (SELECT 1 FROM features x WHERE x.fly_id = f.fly_id)")
def j_semi_anti(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Flies with readings but without features."""
    have = table(spark, sf_dir, "readings").select("fly_id").distinct()
    f = table(spark, sf_dir, "flies")
    return f.join(have, "fly_id", "left_semi").join(table(spark, sf_dir, "features").select("fly_id").distinct(), "fly_id", "left_anti").select("fly_id", "experiment_id")


# aggregates --------------------------------------------------------------------------------------

@query(DAILY + "SELECT experiment_id, fly_id, strftime(blk, '%Y-%m-%d') AS day, exp_day, total_activity, round(activity_index, 6) AS activity_index, longest_zero, total_sleep, transition_counts, round(missing_fraction, 6) AS missing_fraction FROM refd")
def a_daily_metrics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Daily metrics and the startle counts, one pass."""
    daily = health.daily_metrics(minutes(spark, sf_dir)).join(health.missing_share(table(spark, sf_dir, "readings")), DAY, "left")
    cols = [F.col(c).cast("long").alias(c) for c in ("exp_day", "total_activity", "longest_zero", "total_sleep", "transition_counts")]
    return daily.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), *cols, r6("activity_index"), r6("missing_fraction"))


def statuses(spark: SparkSession, sf_dir: str, decline: bool = False) -> DataFrame:
    daily = health.daily_metrics(minutes(spark, sf_dir)).join(health.missing_share(table(spark, sf_dir, "readings")), DAY, "left")
    return health.irreversible(health.with_reference_day(daily).withColumn("status", health.status_of(decline=decline)))


@query(DAILY + "SELECT experiment_id, fly_id, exp_day, ref_activity, round(rel_activity, 6) AS rel_activity, decline_status FROM declined")
def w_reference_day(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Activity against the reference day, by a window instead of a self join."""
    daily = health.with_reference_day(health.daily_metrics(minutes(spark, sf_dir)))
    return daily.select(*SOURCE, F.col("exp_day").cast("long").alias("exp_day"), "ref_activity", r6("rel_activity"), "decline_status")


@query(DAILY + "SELECT experiment_id, fly_id, exp_day, one_day AS status, CASE one_day WHEN 'Dead' THEN 'dead' WHEN 'Unhealthy' THEN 'dying' WHEN 'QC_Fail' THEN 'qc_fail' ELSE 'alive' END AS mapped FROM (SELECT *, CASE WHEN bool_or(one_day = 'Dead') OVER (PARTITION BY experiment_id, fly_id ORDER BY exp_day ROWS UNBOUNDED PRECEDING) THEN 'Dead' ELSE one_day END AS o2 FROM rawstatus)".replace("one_day AS status", "o2 AS status").replace("CASE one_day WHEN 'Dead' THEN 'dead'", "CASE o2 WHEN 'Dead' THEN 'dead'"))
def c_status(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The status of each fly-day and its short name."""
    s = statuses(spark, sf_dir)
    return s.select(*SOURCE, F.col("exp_day").cast("long").alias("exp_day"), "status", health.mapped_status(F.col("status")).alias("mapped"))


@query(DAILY + "SELECT experiment_id, fly_id, exp_day, status FROM statuses")
def c_status_decline(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The variant in which decline decides too."""
    return statuses(spark, sf_dir, decline=True).select(*SOURCE, F.col("exp_day").cast("long").alias("exp_day"), "status")


@query(
    DAILY
    + """SELECT experiment_id, fly_id, count(*) FILTER (WHERE status = 'Alive') AS days_alive, count(*) FILTER (WHERE status = 'Unhealthy') AS days_unhealthy,
  count(*) FILTER (WHERE status = 'Dead') AS days_dead, count(*) FILTER (WHERE status = 'QC_Fail') AS days_qc_fail, min(exp_day) AS first_day, max(exp_day) AS last_day,
  min(exp_day) FILTER (WHERE status = 'Dead') AS first_dead_day, arg_max(status, exp_day) AS final_status FROM statuses GROUP BY 1, 2"""
)
def a_health_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A3: one row per source."""
    s = health.summary(statuses(spark, sf_dir, decline=True))
    return s.withColumns({c: F.col(c).cast("long") for c in ("first_day", "last_day", "first_dead_day")})


@query(
    """WITH latest AS (SELECT * FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, report_date ORDER BY health_report_id DESC) AS rn FROM health_reports) WHERE rn = 1)
SELECT experiment_id, status, count(*) AS reports, count(DISTINCT fly_id) AS flies, CAST(sum(total_activity) AS BIGINT) AS total,
  round(100.0 * count(DISTINCT fly_id) / (SELECT count(DISTINCT fly_id) FROM flies), 6) AS percent FROM latest GROUP BY 1, 2"""
)
def a_health_breakdown(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Statuses of the latest reports, percent of all flies."""
    everything = table(spark, sf_dir, "flies").agg(F.count_distinct("fly_id").alias("all"))
    g = health.latest_reports(table(spark, sf_dir, "health_reports")).groupBy("experiment_id", "status").agg(
        F.count(F.lit(1)).alias("reports"), F.count_distinct("fly_id").alias("flies"), F.sum(F.col("total_activity").cast("long")).alias("total")
    )
    return g.crossJoin(F.broadcast(everything)).select("experiment_id", "status", "reports", "flies", "total", r6(100.0 * F.col("flies") / F.col("all"), "percent"))


@query(BASE + "SELECT experiment_id, fly_id, zt, hourly, CAST(exp_day AS BIGINT) AS exp_day FROM hourly")
def a_hourly_totals(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A5: totals by source, day and zt."""
    return rhythm.hourly_totals(timed(spark, sf_dir)).select(*SOURCE, "zt", "hourly", F.col("exp_day").cast("long").alias("exp_day"))


@query(
    BASE
    + """, b AS (SELECT experiment_id, fly_id, time_bucket(INTERVAL 5 MINUTE, datetime) AS bin, count(*) FILTER (WHERE reading_type = 'MT') AS n_mt,
  CAST(coalesce(sum(value) FILTER (WHERE reading_type = 'MT'), 0) AS BIGINT) AS mt_sum, coalesce(var_samp(value) FILTER (WHERE reading_type = 'Pn'), 0) AS pn_var
  FROM ztimed WHERE reading_type IN ('MT', 'Pn') AND value BETWEEN 0 AND 1000 GROUP BY ALL)
SELECT experiment_id, fly_id, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, n_mt, mt_sum, round(pn_var, 6) AS pn_var FROM b"""
)
def a_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Five-minute bins: sum of MT and sample variance of Pn, none as 0."""
    b = bins(spark, sf_dir)
    return b.select(*SOURCE, stamp(F.col("bin")).alias("bin"), "n_mt", "mt_sum", r6("pn_var"))


@query(
    BASE
    + """, b AS (SELECT experiment_id, fly_id, time_bucket(INTERVAL 5 MINUTE, datetime) AS bin, count(*) FILTER (WHERE reading_type = 'MT') AS n_mt,
  CAST(coalesce(sum(value) FILTER (WHERE reading_type = 'MT'), 0) AS BIGINT) AS mt_sum, coalesce(var_samp(value) FILTER (WHERE reading_type = 'Pn'), 0) AS pn_var
  FROM ztimed WHERE reading_type IN ('MT', 'Pn') AND value BETWEEN 0 AND 1000 GROUP BY ALL)
SELECT b.experiment_id, b.fly_id, strftime(bin, '%Y-%m-%d %H:%M:%S') AS bin, coalesce(genotype, 'Unknown') AS genotype, coalesce(sex, 'Unknown') AS sex, coalesce(treatment, 'Unknown') AS treatment, mt_sum, round(pn_var, 6) AS pn_var
FROM b LEFT JOIN fly USING (fly_id) WHERE n_mt = 5"""
)
def a_bins_whole(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A11, A13, SNK15: bins with a reading for each of their five minutes, with their fly's metadata, Unknown where there is none."""
    b = prepared.with_flies(bins(spark, sf_dir).where("n_mt = 5"), flies(spark, sf_dir))
    names = [F.coalesce(c, F.lit("Unknown")).alias(c) for c in ("genotype", "sex", "treatment")]
    return b.select(*SOURCE, stamp(F.col("bin")).alias("bin"), *names, "mt_sum", r6("pn_var"))


def bins(spark: SparkSession, sf_dir: str, n_minutes: int = 5) -> DataFrame:
    """experiment_id, fly_id, blk, bin, n_mt, mt_sum, pn_var; bins never cross a day, so they are made where the rows are."""
    rows = timed(spark, sf_dir, ("MT", "Pn"), 0)
    start = F.expr(f"timestampadd(MINUTE, cast((hour(datetime) * 60 + minute(datetime)) div {n_minutes} * {n_minutes} as int), cast(blk as timestamp_ntz))")
    mt, pn = F.when(F.col("reading_type") == "MT", F.col("value")), F.when(F.col("reading_type") == "Pn", F.col("value").cast("double"))
    return rows.groupBy(*DAY, start.alias("bin")).agg(F.count(mt).alias("n_mt"), F.coalesce(F.sum(mt), F.lit(0)).alias("mt_sum"), F.coalesce(F.var_samp(pn), F.lit(0.0)).alias("pn_var"))


@query(
    BASE
    + """, per AS (SELECT experiment_id, fly_id, zt, avg(hourly) AS v FROM hourly GROUP BY ALL)
SELECT genotype, sex, zt, round(avg(v), 6) AS mean, round(stddev_samp(v), 6) AS sd, count(*) AS n, round(stddev_samp(v) / sqrt(count(*)), 6) AS sem
FROM per LEFT JOIN fly USING (fly_id) GROUP BY ALL"""
)
def a_group_means(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean, deviation, n and standard error of groups per zt."""
    per = rhythm.hourly_totals(timed(spark, sf_dir)).groupBy(*SOURCE, "zt").agg(F.avg("hourly").alias("v"))
    g = prepared.with_flies(per, flies(spark, sf_dir)).groupBy("genotype", "sex", "zt")
    sd = F.stddev_samp("v")
    return g.agg(r6(F.avg("v"), "mean"), r6(sd, "sd"), F.count(F.lit(1)).alias("n"), r6(sd / F.sqrt(F.count(F.lit(1))), "sem"))


@query(
    BASE
    + """, g AS (SELECT experiment_id, fly_id, count(*) AS n, avg(hourly) AS m, var_pop(hourly) AS v FROM hourly GROUP BY ALL),
h AS (SELECT experiment_id, fly_id, zt, avg(hourly) AS mh FROM hourly GROUP BY ALL)
SELECT experiment_id, fly_id, round(CASE WHEN any_value(n) >= 2 AND any_value(v) * any_value(n) > 1e-9 THEN sum((mh - m) ** 2) / (count(*) * any_value(v)) END, 6) AS interdaily_stability
FROM g JOIN h USING (experiment_id, fly_id) GROUP BY 1, 2"""
)
def a_interdaily_stability(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A8."""
    return rhythm.interdaily_stability(rhythm.hourly_totals(timed(spark, sf_dir))).select(*SOURCE, r6("interdaily_stability"))


# windows -----------------------------------------------------------------------------------------

@query(RUNS + "SELECT experiment_id, fly_id, z AS flag, strftime(start, '%Y-%m-%d %H:%M:%S') AS start, strftime(\"end\", '%Y-%m-%d %H:%M:%S') AS \"end\", length FROM runs")
def w_runs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Runs of active and inactive rows within each day."""
    found = runs.run_lengths(minutes(spark, sf_dir), DAY, ["minute"], F.col("value") == 0)
    return found.select(*SOURCE, "flag", stamp(F.col("start")).alias("start"), stamp(F.col("end")).alias("end"), "length")


@query(
    BASE
    + """, f AS (SELECT *, CASE WHEN (value = 0) = lag(value = 0) OVER (PARTITION BY experiment_id, fly_id ORDER BY minute) THEN 0 ELSE 1 END AS nw FROM minutes),
i AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id, fly_id ORDER BY minute ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT experiment_id, fly_id, run, min(minute) AS start, count(*) AS n FROM i WHERE value = 0 GROUP BY ALL)
SELECT experiment_id, fly_id, strftime(min(start), '%Y-%m-%d %H:%M:%S') AS death_datetime FROM r WHERE n >= 3 GROUP BY 1, 2"""
)
def w_long_zero(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Where the first run of zero rows begins; three rows, as the series is sparse."""
    return death.long_zero_starts(minutes(spark, sf_dir), 3).select(*SOURCE, stamp(F.col("death_datetime")).alias("death_datetime"))


_DEATHS = BASE + """, active AS (SELECT DISTINCT experiment_id, fly_id, minute FROM minutes WHERE value > 0),
ends AS (SELECT experiment_id, fly_id, min(minute) AS a, any_value(end_date) AS end_date FROM minutes JOIN expt USING (experiment_id) GROUP BY 1, 2),
borders AS (SELECT experiment_id, fly_id, a - INTERVAL 1 MINUTE AS minute FROM ends UNION ALL SELECT experiment_id, fly_id, minute FROM active
  UNION ALL SELECT experiment_id, fly_id, CAST(end_date AS TIMESTAMP) + INTERVAL 1 DAY FROM ends),
gaps AS (SELECT *, date_diff('minute', lag(minute) OVER w, minute) - 1 AS n, lag(minute) OVER w + INTERVAL 1 MINUTE AS start FROM borders WINDOW w AS (PARTITION BY experiment_id, fly_id ORDER BY minute)),
deaths AS (SELECT experiment_id, fly_id, min(start) AS death_datetime FROM gaps WHERE n >= 1440 GROUP BY 1, 2)
"""


@query(_DEATHS + "SELECT experiment_id, fly_id, strftime(death_datetime, '%Y-%m-%d %H:%M:%S') AS death_datetime FROM deaths")
def w_dense_deaths(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The first day without activity on the dense minute grid, from gaps between active minutes."""
    d = death.dense_deaths(minutes(spark, sf_dir), table(spark, sf_dir, "experiments"), 24)
    return d.select(*SOURCE, stamp(F.col("death_datetime")).alias("death_datetime"))


@query(
    _DEATHS
    + """, span AS (SELECT d.*, e.a, date_diff('minute', e.a, d.death_datetime) AS m FROM deaths d JOIN ends e USING (experiment_id, fly_id)),
wins AS (SELECT experiment_id, fly_id, death_datetime, k, least(360, m - (k - 1) * 360) AS n, a + to_minutes(CAST(greatest(0, m - k * 360) AS BIGINT)) AS ws
  FROM span, LATERAL (SELECT unnest(generate_series(1, CAST(ceil(m / 360.0) AS BIGINT))) AS k) WHERE m > 0),
kept AS (SELECT * FROM wins WHERE n >= 180),
dense AS (SELECT k.*, k.ws + to_minutes(CAST(i AS BIGINT)) AS minute, i FROM kept k, LATERAL (SELECT unnest(generate_series(0, CAST(k.n AS BIGINT) - 1)) AS i)),
d2 AS (SELECT d.*, coalesce(x.v, 0) = 0 AS inactive FROM dense d LEFT JOIN (SELECT experiment_id, fly_id, minute, value AS v FROM minutes) x USING (experiment_id, fly_id, minute)),
d3 AS (SELECT *, CASE WHEN inactive = lag(inactive) OVER (PARTITION BY experiment_id, fly_id, k ORDER BY i) THEN 0 ELSE 1 END AS nw FROM d2),
d4 AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id, fly_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS run FROM d3),
d5 AS (SELECT *, inactive AND count(*) OVER (PARTITION BY experiment_id, fly_id, k, run) >= 5 AS asleep FROM d4),
d6 AS (SELECT *, CASE WHEN asleep = lag(asleep) OVER (PARTITION BY experiment_id, fly_id, k ORDER BY i) THEN 0 ELSE 1 END AS nb FROM d5),
d7 AS (SELECT *, sum(nb) OVER (PARTITION BY experiment_id, fly_id, k ORDER BY i ROWS UNBOUNDED PRECEDING) AS bout FROM d6),
bouts AS (SELECT experiment_id, fly_id, k, asleep, bout, count(*) AS len, any_value(n) AS n, any_value(ws) AS ws FROM d7 GROUP BY ALL)
SELECT experiment_id, fly_id, CAST((k - 1) * 6 AS INTEGER) AS ttd, strftime(any_value(ws), '%Y-%m-%d %H:%M:%S') AS window_start, CAST(coalesce(sum(len) FILTER (WHERE asleep), 0) AS DOUBLE) AS total_sleep_min,
  CAST(count(*) FILTER (WHERE asleep) AS INTEGER) AS n_sleep_bouts, round(coalesce(avg(len) FILTER (WHERE asleep), 0), 6) AS mean_bout_min, CAST(coalesce(max(len) FILTER (WHERE asleep), 0) AS DOUBLE) AS longest_bout_min,
  round(coalesce(avg(len) FILTER (WHERE NOT asleep), 0), 6) AS mean_wake_bout_min, round(coalesce(sum(len) FILTER (WHERE NOT asleep), 0) / any_value(n), 6) AS p_wake FROM bouts GROUP BY 1, 2, 3"""
)
def w_backward_windows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Six-hour windows counted back from death."""
    m = written(minutes(spark, sf_dir), "minutes")
    d = death.dense_deaths(m, table(spark, sf_dir, "experiments"), 24)
    x = death.backward_windows(m, d)
    return x.select(*SOURCE, "ttd", stamp(F.col("window_start")).alias("window_start"), "total_sleep_min", "n_sleep_bouts", r6("mean_bout_min"), "longest_bout_min", r6("mean_wake_bout_min"), r6("p_wake"))


_DENSE = """, ahead AS (SELECT *, lead(minute) OVER (PARTITION BY experiment_id, fly_id, blk ORDER BY minute) AS nxt FROM minutes),
dminutes AS (SELECT a.experiment_id, a.fly_id, a.blk, a.exp_day, a.lights_on, a.lights_off, g.m AS minute,
  CAST(floor(((hour(g.m) + minute(g.m) / 60.0 - a.lights_on) % 24 + 24) % 24) AS INTEGER) AS zt, CASE WHEN g.m = a.minute THEN a.value ELSE 0 END AS value
  FROM ahead a, LATERAL (SELECT unnest(generate_series(a.minute, coalesce(a.nxt - INTERVAL 1 MINUTE, a.minute), INTERVAL 1 MINUTE)) AS m) g), flagged AS"""

_SLEEP = RUNS.replace("FROM minutes)", "FROM dminutes)").replace(", flagged AS", _DENSE) + """, sized AS (SELECT *, count(*) OVER (PARTITION BY experiment_id, fly_id, blk, run) AS len FROM islands),
s0 AS (SELECT *, z AND len >= 5 AS asleep, zt < 12 AS is_day FROM sized),
s1 AS (SELECT *, lag(asleep) OVER w AS before, row_number() OVER w AS rn FROM s0 WINDOW w AS (PARTITION BY experiment_id, fly_id, blk ORDER BY minute)),
s2 AS (SELECT *, sum(CASE WHEN asleep AND NOT coalesce(before, false) THEN 1 ELSE 0 END) OVER w AS bout, sum(CASE WHEN NOT asleep AND coalesce(before, true) THEN 1 ELSE 0 END) OVER w AS wake,
  max(CASE WHEN asleep AND NOT is_day THEN 1 ELSE 0 END) OVER w AS dark_slept FROM s1 WINDOW w AS (PARTITION BY experiment_id, fly_id, blk ORDER BY minute ROWS UNBOUNDED PRECEDING)),
bouts AS (SELECT experiment_id, fly_id, blk, bout, count(*) AS len, arg_min(is_day, minute) AS day_bout FROM s2 WHERE asleep GROUP BY ALL),
bagg AS (SELECT experiment_id, fly_id, blk, count(*) AS nb, count(*) FILTER (WHERE day_bout) AS nd, avg(len) AS mb, max(len) AS xb, avg(len) FILTER (WHERE day_bout) AS md, max(len) FILTER (WHERE day_bout) AS xd,
  avg(len) FILTER (WHERE NOT day_bout) AS mn, max(len) FILTER (WHERE NOT day_bout) AS xn FROM bouts GROUP BY ALL),
wakes AS (SELECT experiment_id, fly_id, blk, avg(len) AS mw FROM (SELECT experiment_id, fly_id, blk, wake, count(*) AS len FROM s2 WHERE NOT asleep GROUP BY ALL) GROUP BY ALL),
dayagg AS (SELECT experiment_id, fly_id, blk, exp_day, count(*) AS n, count(*) FILTER (WHERE asleep) AS ns, count(*) FILTER (WHERE asleep AND is_day) AS nds,
  count(*) FILTER (WHERE before AND NOT asleep) AS sw, count(*) FILTER (WHERE NOT before AND asleep) AS ws, max(dark_slept) AS ds,
  count(*) FILTER (WHERE NOT is_day AND dark_slept = 0) AS lat, count(*) FILTER (WHERE NOT is_day AND dark_slept = 1 AND NOT asleep) AS wa FROM s2 GROUP BY ALL),
sleepd AS (SELECT d.experiment_id, d.fly_id, d.blk, d.exp_day, CAST(ns AS DOUBLE) AS total_sleep, CAST(nds AS DOUBLE) AS day_sleep, CAST(ns - nds AS DOUBLE) AS night_sleep, coalesce(nb, 0) AS total_bouts,
  coalesce(nd, 0) AS day_bouts, coalesce(nb - nd, 0) AS night_bouts, mb AS mean_bout, CAST(xb AS DOUBLE) AS max_bout, md AS mean_day_bout, CAST(xd AS DOUBLE) AS max_day_bout, mn AS mean_night_bout, CAST(xn AS DOUBLE) AS max_night_bout,
  coalesce(nb, 0) / (n / 60.0) AS frag_bouts_per_hour, CASE WHEN ns > 0 THEN nb / ns END AS frag_bouts_per_min_sleep, mw AS mean_wake_bout, CASE WHEN ns > 0 THEN sw / ns END AS p_wake, CASE WHEN n > ns THEN ws / (n - ns) END AS p_doze,
  CASE WHEN ds = 1 THEN CAST(lat AS DOUBLE) END AS sleep_latency, CASE WHEN ds = 1 THEN CAST(wa AS DOUBLE) END AS waso
  FROM dayagg d LEFT JOIN bagg USING (experiment_id, fly_id, blk) LEFT JOIN wakes USING (experiment_id, fly_id, blk))
"""
_SLEEP_COLS = ", ".join(f"round({c}, 6) AS {c}" if c not in ("total_bouts", "day_bouts", "night_bouts") else c for c in sleep.DAILY)


@query(_SLEEP + f"SELECT experiment_id, fly_id, strftime(blk, '%Y-%m-%d') AS day, {_SLEEP_COLS} FROM sleepd")
def w_sleep_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """19 sleep measures of each fly-day."""
    d = sleep.daily_sleep(dense(spark, sf_dir))
    return d.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), *[r6(c) if c not in ("total_bouts", "day_bouts", "night_bouts") else F.col(c) for c in sleep.DAILY])


@query(_SLEEP + "SELECT experiment_id, fly_id, " + ", ".join(f"round(avg({c}), 6) AS {c}_mean" for c in sleep.DAILY) + ", count(*) AS n_days FROM sleepd WHERE exp_day NOT IN (1, 7) GROUP BY 1, 2")
def a_sleep_features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Means over days."""
    d = sleep.per_source_means(sleep.daily_sleep(dense(spark, sf_dir)))
    return d.select(*SOURCE, *[r6(f"{c}_mean") for c in sleep.DAILY], "n_days")


@query(
    _SLEEP
    + """, b2 AS (SELECT experiment_id, fly_id, blk, bout, count(*) AS len, CASE WHEN count(*) FILTER (WHERE NOT is_day) >= count(*) FILTER (WHERE is_day) THEN 'Dark' ELSE 'Light' END AS ph, arg_min(zt, minute) AS z0 FROM s2 WHERE asleep GROUP BY ALL)
SELECT experiment_id, fly_id, strftime(blk, '%Y-%m-%d') AS day, CAST(sum(len) AS BIGINT) AS total_sleep, count(*) AS bouts, CAST(min(z0) * 60 AS BIGINT) AS latency,
  round(coalesce(sum(len) FILTER (WHERE ph = 'Dark'), 0) / 720.0, 6) AS efficiency, CAST(sum(len) - coalesce(sum(len) FILTER (WHERE ph = 'Dark'), 0) AS BIGINT) AS waso FROM b2 GROUP BY 1, 2, 3"""
)
def w_sleep_legacy(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The older measures."""
    d = sleep.legacy_daily_sleep(dense(spark, sf_dir))
    return d.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), "total_sleep", "bouts", F.col("latency").cast("long").alias("latency"), r6("efficiency"), "waso")


@query(
    BASE
    + """, sm AS (SELECT *, avg(hourly) OVER (PARTITION BY experiment_id, fly_id, blk ORDER BY zt ROWS BETWEEN 1 PRECEDING AND 1 FOLLOWING) AS s, row_number() OVER (PARTITION BY experiment_id, fly_id, blk ORDER BY zt) AS i FROM hourly),
lv AS (SELECT experiment_id, fly_id, blk, quantile_cont(s, 0.1) + stddev_pop(s) AS level, count(*) AS n FROM sm GROUP BY ALL),
lo AS (SELECT experiment_id, fly_id, blk, i AS low FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, blk ORDER BY s, i) AS r FROM sm) WHERE r = 1),
ab AS (SELECT sm.*, s > level AS above, n, low FROM sm JOIN lv USING (experiment_id, fly_id, blk) JOIN lo USING (experiment_id, fly_id, blk)),
nx AS (SELECT *, lead(above, 1) OVER w AS n1, lead(above, 2) OVER w AS n2 FROM ab WINDOW w AS (PARTITION BY experiment_id, fly_id, blk ORDER BY zt))
SELECT experiment_id, fly_id, strftime(blk, '%Y-%m-%d') AS day, CASE WHEN any_value(n) >= 3 THEN min(zt) FILTER (WHERE above AND n1 AND i >= low) END AS onset_zt,
  CASE WHEN any_value(n) >= 3 THEN max(zt) FILTER (WHERE above AND NOT n1 AND NOT n2) END AS offset_zt FROM nx GROUP BY 1, 2, 3"""
)
def w_onset_offset(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W13."""
    found = rhythm.onset_offset(rhythm.hourly_totals(timed(spark, sf_dir)))
    return found.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), "onset_zt", "offset_zt")


@query(
    DAILY
    + """, lab AS (SELECT experiment_id, fly_id, exp_day, CASE WHEN bool_or(one_day = 'Dead') OVER (PARTITION BY experiment_id, fly_id ORDER BY exp_day ROWS UNBOUNDED PRECEDING) THEN 'Dead' ELSE one_day END AS status FROM rawstatus),
w0 AS (SELECT *, CAST(minute - to_hours(lights_on) AS DATE) + 1 AS day FROM minutes),
w1 AS (SELECT *, CASE WHEN (value = 0) = lag(value = 0) OVER (PARTITION BY experiment_id, fly_id, day ORDER BY minute) THEN 0 ELSE 1 END AS nw FROM w0),
w2 AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id, fly_id, day ORDER BY minute ROWS UNBOUNDED PRECEDING) AS run FROM w1),
w3 AS (SELECT experiment_id, fly_id, day, run, value = 0 AS z, count(*) AS n FROM w2 GROUP BY ALL),
w4 AS (SELECT experiment_id, fly_id, day, coalesce(max(n) FILTER (WHERE z), 0) AS lz, coalesce(sum(n) FILTER (WHERE z AND n >= 5), 0) AS sl FROM w3 GROUP BY ALL),
w5 AS (SELECT experiment_id, fly_id, day, count(*) AS n, avg(value) AS mean, var_pop(value) AS variance FROM w0 GROUP BY ALL HAVING count(*) >= 20),
dead AS (SELECT experiment_id, fly_id, min(exp_day) AS dd FROM lab WHERE status = 'Dead' GROUP BY 1, 2)
SELECT w5.experiment_id, w5.fly_id, strftime(w5.day, '%Y-%m-%d') AS day, n, round(mean, 4) AS mean, round(variance, 2) AS variance, round(lz / 60.0, 6) AS longest_zero_h, CAST(sl AS BIGINT) AS sleep_min, status,
  dd - (date_diff('day', start_date, w5.day) + 1) AS days_until_death
FROM w5 JOIN w4 USING (experiment_id, fly_id, day) JOIN expt e ON e.experiment_id = w5.experiment_id
LEFT JOIN lab ON lab.experiment_id = w5.experiment_id AND lab.fly_id = w5.fly_id AND lab.exp_day = date_diff('day', start_date, w5.day) + 1
LEFT JOIN dead ON dead.experiment_id = w5.experiment_id AND dead.fly_id = w5.fly_id"""
)
def w_sliding_days(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Windows that end at lights on, with the day's label; from 20 rows on, as the series is sparse."""
    labels = statuses(spark, sf_dir).select(*SOURCE, "exp_day", "status")
    x = death.sliding_days(minutes(spark, sf_dir), labels, 20)
    return x.select(*SOURCE, day_stamp(F.col("day")).alias("day"), "n", F.round("mean", 4).alias("mean"), F.round("variance", 2).alias("variance"), r6("longest_zero_h"), "sleep_min", "status", F.col("days_until_death").cast("long").alias("days_until_death"))


@query(
    BASE
    + """, f AS (SELECT *, CASE WHEN (value = 0) = lag(value = 0) OVER (PARTITION BY experiment_id, fly_id ORDER BY minute) THEN 0 ELSE 1 END AS nw FROM minutes),
i AS (SELECT *, sum(nw) OVER (PARTITION BY experiment_id, fly_id ORDER BY minute ROWS UNBOUNDED PRECEDING) AS run FROM f),
r AS (SELECT experiment_id, fly_id, run, min(minute) AS a, max(minute) AS b FROM i WHERE value = 0 GROUP BY ALL)
SELECT experiment_id, fly_id, strftime(a, '%Y-%m-%d %H:%M:%S') AS start, strftime(b, '%Y-%m-%d %H:%M:%S') AS "end", date_diff('minute', a, b) + 1 AS minutes FROM r WHERE date_diff('minute', a, b) + 1 >= 30"""
)
def w_death_periods(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Zero periods by the clock, from 30 minutes on, as the series is sparse."""
    d = death.death_periods(minutes(spark, sf_dir), 30)
    return d.select(*SOURCE, stamp(F.col("start")).alias("start"), stamp(F.col("end")).alias("end"), "minutes")


# rhythm ------------------------------------------------------------------------------------------

_FIT_COLS = "round(mesor, 4) AS mesor, round(amplitude, 4) AS amplitude, round(p_value, 6) AS p_value, n"


def fit_columns() -> list[Column]:
    return [F.round("mesor", 4).alias("mesor"), F.round("amplitude", 4).alias("amplitude"), r6("p_value"), F.col("n")]


@query(BASE + cosinor("hourly", "experiment_id, fly_id, blk, exp_day", "zt", "hourly") + f"SELECT experiment_id, fly_id, strftime(blk, '%Y-%m-%d') AS day, {_FIT_COLS} FROM fit")
def n_cosinor_daily(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N1."""
    fit = rhythm.cosinor(rhythm.hourly_totals(timed(spark, sf_dir)), [*DAY, "exp_day"], "zt", "hourly")
    return fit.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), *fit_columns())


@query(
    BASE
    + ", tot AS (SELECT experiment_id, fly_id, zt, sum(hourly) AS hourly FROM hourly GROUP BY ALL)"
    + cosinor("tot", "experiment_id, fly_id", "zt", "hourly")
    + f"SELECT experiment_id, fly_id, {_FIT_COLS}, round(phase, 4) AS phase, n > 3 AND coalesce(p_value < 0.05, false) AS rhythmic FROM fit"
)
def n_cosinor_source(spark: SparkSession, sf_dir: str) -> DataFrame:
    """One fit per source over its hourly totals."""
    fit = rhythm.cosinor(rhythm.hourly_totals(timed(spark, sf_dir), by_day=False), SOURCE, "zt", "hourly")
    rhythmic = (F.col("n") > 3) & F.coalesce(F.col("p_value") < 0.05, F.lit(False))
    return fit.select(*SOURCE, *fit_columns(), F.round("phase", 4).alias("phase"), rhythmic.alias("rhythmic"))


@query(
    BASE
    + ", per AS (SELECT experiment_id, fly_id, zt, avg(hourly) AS v FROM hourly GROUP BY ALL), gm AS (SELECT genotype, zt, avg(v) AS v FROM per JOIN fly USING (fly_id) WHERE genotype IS NOT NULL GROUP BY ALL)"
    + cosinor("gm", "genotype", "zt", "v")
    + f"SELECT genotype, {_FIT_COLS} FROM fit"
)
def n_cosinor_group(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Fits of the groups' mean profiles."""
    per = rhythm.hourly_totals(timed(spark, sf_dir)).groupBy(*SOURCE, "zt").agg(F.avg("hourly").alias("v"))
    means = per.join(flies(spark, sf_dir).where("genotype is not null"), "fly_id").groupBy("genotype", "zt").agg(F.avg("v").alias("v"))
    return rhythm.cosinor(means, ["genotype"], "zt", "v").select("genotype", *fit_columns())


@query()
def n_periodogram(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Best period and power of each fly-day."""
    found = rhythm.periodogram(rhythm.hourly_totals(timed(spark, sf_dir)))
    return found.select(*SOURCE, day_stamp(F.col("blk")).alias("day"), r6("period"), r6("power"))


@query()
def a_feature_table(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The feature table: rhythm and sleep features of every source."""
    series = written(prepared.minute_series(timed(spark, sf_dir)), "minutes")
    hourly = written(rhythm.hourly_totals(series.where(~F.col("exp_day").isin(1, 7))), "hourly")
    day = [*DAY, "exp_day"]
    features = rhythm.rhythm_features(rhythm.cosinor(hourly, day, "zt", "hourly"), rhythm.periodogram(hourly), rhythm.onset_offset(hourly), rhythm.interdaily_stability(hourly))
    slept = sleep.per_source_means(sleep.daily_sleep(prepared.dense_minutes(series))).drop("n_days")
    return prepared.with_flies(features.join(slept, SOURCE), flies(spark, sf_dir))


@query("SELECT reading_type, count(*) AS n, count(value) AS with_value, count(DISTINCT fly_id) AS flies, min(value) AS low, max(value) AS high FROM readings GROUP BY 1")
def k_split_summary(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK13, SNK14: what a split by reading type holds."""
    return table(spark, sf_dir, "readings").groupBy("reading_type").agg(
        F.count(F.lit(1)).alias("n"), F.count("value").alias("with_value"), F.count_distinct("fly_id").alias("flies"), F.min("value").alias("low"), F.max("value").alias("high")
    )


@query(
    """SELECT experiment_id, 'flies' AS tbl, count(*) AS n FROM flies GROUP BY 1 UNION ALL SELECT experiment_id, 'readings', count(*) FROM readings GROUP BY 1
UNION ALL SELECT experiment_id, 'health_reports', count(*) FROM health_reports GROUP BY 1 UNION ALL SELECT experiment_id, 'features', count(*) FROM features GROUP BY 1
UNION ALL SELECT experiment_id, 'features_z', count(*) FROM features_z GROUP BY 1"""
)
def k_experiment_counts(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK9: rows of each experiment by table."""
    parts = [table(spark, sf_dir, t).groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n")).withColumn("tbl", F.lit(t)) for t in ("flies", "readings", "health_reports", "features", "features_z")]
    out = parts[0]
    for p in parts[1:]:
        out = out.unionByName(p)
    return out


@query("SELECT experiment_id, name FROM experiments ORDER BY created_at DESC, experiment_id DESC LIMIT 1")
def k_latest_experiment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC8, SRC14: the experiment created last (one row is the feature)."""
    return table(spark, sf_dir, "experiments").orderBy(F.desc("created_at"), F.desc("experiment_id")).limit(1).select("experiment_id", "name")


@query()
def k_metadata(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SRC2: the metadata lines as a typed table with fly ids."""
    good = badrows.split_lines(table(spark, sf_dir, "details"))[0]
    return good.withColumn("fly_id", T.fly_id(F.col("monitor"), F.col("channel")))


@query("SELECT health_report_id, status, total_activity FROM (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id, report_date ORDER BY health_report_id DESC) AS rn FROM health_reports) WHERE rn = 1")
def k_latest_reports(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK2, SNK3, SRC7: the upserted reports: one per source and date, the last to arrive."""
    latest = store.latest_by_key(table(spark, sf_dir, "health_reports"), [*SOURCE, "report_date"], "health_report_id")
    return latest.select("health_report_id", "status", "total_activity")


@query(
    """WITH dead AS (SELECT DISTINCT experiment_id, fly_id FROM health_reports WHERE status = 'Dead')
SELECT experiment_id, count(*) AS n, count(DISTINCT fly_id) AS flies FROM readings r WHERE NOT EXISTS (SELECT 1 FROM dead d WHERE d.experiment_id = r.experiment_id AND d.fly_id = r.fly_id) GROUP BY 1"""
)
def k_without_dead(spark: SparkSession, sf_dir: str) -> DataFrame:
    """SNK7, F11: readings left after all rows of dead flies are removed."""
    dead = table(spark, sf_dir, "health_reports").where("status = 'Dead'")
    left = store.without_flies(table(spark, sf_dir, "readings"), dead)
    return left.groupBy("experiment_id").agg(F.count(F.lit(1)).alias("n"), F.count_distinct("fly_id").alias("flies"))


@query(
    """WITH rows AS (SELECT fly_id, experiment_id FROM features), other AS (SELECT fly_id, experiment_id FROM features_z)
SELECT 'both' AS part, count(*) AS n FROM (SELECT * FROM rows INTERSECT SELECT * FROM other) UNION ALL SELECT 'first only', count(*) FROM (SELECT * FROM rows EXCEPT SELECT * FROM other)
UNION ALL SELECT 'either', count(*) FROM (SELECT * FROM rows UNION SELECT * FROM other)"""
)
def k_set_operations(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Set operations of the inventory: sources in both feature tables, in the first only, in either."""
    a, b = (table(spark, sf_dir, t).select("fly_id", "experiment_id") for t in ("features", "features_z"))
    parts = {"both": a.intersect(b), "first only": a.subtract(b), "either": a.union(b).distinct()}
    out = None
    for name, df in parts.items():
        n = df.agg(F.count(F.lit(1)).alias("n")).select(F.lit(name).alias("part"), "n")
        out = n if out is None else out.unionByName(n)
    return out


@query(
    BASE
    + """SELECT genotype, count(*) FILTER (WHERE status = 'Alive') AS alive, count(*) FILTER (WHERE status = 'Unhealthy') AS unhealthy, count(*) FILTER (WHERE status = 'Dead') AS dead, count(*) FILTER (WHERE status = 'QC_Fail') AS qc_fail
FROM health_reports LEFT JOIN fly USING (fly_id) GROUP BY 1"""
)
def a_status_by_genotype(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A18, pivot: statuses of the reports by genotype, with the values of the pivot given."""
    per = table(spark, sf_dir, "health_reports").groupBy("fly_id", "status").agg(F.count(F.lit(1)).alias("n"))
    wide = prepared.with_flies(per, flies(spark, sf_dir)).groupBy("genotype").pivot("status", ["Alive", "Unhealthy", "Dead", "QC_Fail"]).agg(F.sum("n")).na.fill(0)
    return wide.select("genotype", F.col("Alive").alias("alive"), F.col("Unhealthy").alias("unhealthy"), F.col("Dead").alias("dead"), F.col("QC_Fail").alias("qc_fail"))
