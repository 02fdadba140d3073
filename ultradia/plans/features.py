"""Queries over the feature tables: cleaning, statistics, clusters, models; and the SQL they are checked with."""

from __future__ import annotations

from collections.abc import Callable

from pyspark.sql import DataFrame, SparkSession, Window
from pyspark.sql import functions as F

from ultradia.operators import clean, cluster, death, hmm, ml, rolling_states, stats
from ultradia.operators.readings import SOURCE, stamp
from ultradia.plans.activity import bins, flies, minutes, r6, table
from ultradia.plans.sql import BASE
from ultradia.session import written

QUERIES: dict[str, Callable[[SparkSession, str], DataFrame]] = {}
ORACLE: dict[str, str] = {}
#: The numeric columns of the features table, in its order.
NUMERIC = (
    "mesor_mean", "mesor_sd", "amplitude_mean", "amplitude_sd", "phase_mean", "phase_sd", "rhythmic_days", "periodogram_period_mean", "periodogram_period_sd", "periodogram_power_mean",
    "activity_onset_zt_mean", "activity_onset_zt_sd", "activity_offset_zt_mean", "activity_offset_zt_sd", "interdaily_stability", "total_sleep_mean", "day_sleep_mean", "night_sleep_mean",
    "total_bouts_mean", "day_bouts_mean", "night_bouts_mean", "mean_bout_mean", "max_bout_mean", "mean_day_bout_mean", "max_day_bout_mean", "mean_night_bout_mean", "max_night_bout_mean",
    "frag_bouts_per_hour_mean", "frag_bouts_per_min_sleep_mean", "mean_wake_bout_mean", "p_wake_mean", "p_doze_mean", "sleep_latency_mean", "waso_mean",
)
TESTED = tuple(f"{c}_z" for c in NUMERIC if c != "rhythmic_days")


def query(sql: str | None = None) -> Callable:
    def add(f: Callable) -> Callable:
        QUERIES[f.__name__] = f
        if sql is not None:
            ORACLE[f.__name__] = sql
        return f

    return add


def features(spark: SparkSession, sf_dir: str) -> DataFrame:
    """features with their fly's genotype, sex and treatment; NaN as null; one row per feature_id."""
    f = clean.without_nan(table(spark, sf_dir, "features"))
    return f.join(flies(spark, sf_dir).select("fly_id", *clean.GROUP), "fly_id", "left")


def features_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    f = clean.without_nan(table(spark, sf_dir, "features_z"))
    return f.join(flies(spark, sf_dir).select("fly_id", *clean.GROUP), "fly_id", "left")


def model_rows(spark: SparkSession, sf_dir: str) -> DataFrame:
    """What the models read: keys, genotype and z columns, written once, so that each pass of a fit is a plain scan."""
    z = features_z(spark, sf_dir)
    return written(z.select("feature_id", "genotype", *clean.feature_columns(z, "_z")), "model-rows")


def long_z(spark: SparkSession, sf_dir: str) -> DataFrame:
    """feature, grp, value of every z column."""
    z = features_z(spark, sf_dir)
    return stats.long_features(z, clean.feature_columns(z, "_z"), "genotype")


_NULLED = "SELECT * REPLACE (" + ", ".join(
    f"CASE WHEN isnan({c}) THEN NULL ELSE {c} END AS {c}" for c in NUMERIC if c != "rhythmic_days"
) + ") FROM features"
FEATURES = BASE + f", ft AS (SELECT x.*, genotype, sex, treatment FROM ({_NULLED}) x LEFT JOIN fly USING (fly_id))\n"
_UNPIVOT = " UNION ALL ".join(f"SELECT '{c}' AS feature, genotype AS grp, {c} AS value FROM fz WHERE genotype IS NOT NULL AND {c} IS NOT NULL AND NOT isnan({c})" for c in TESTED)
LONG = BASE + f", fz AS (SELECT z.*, genotype, sex, treatment FROM features_z z LEFT JOIN fly USING (fly_id)), long AS ({_UNPIVOT})\n"
RANKS = LONG + """, ranked AS (SELECT *, rank() OVER (PARTITION BY feature ORDER BY value) + (count(*) OVER (PARTITION BY feature, value) - 1) / 2.0 AS rk FROM long),
tie AS (SELECT feature, sum(c * c * c - c) AS t, sum(c) AS nn FROM (SELECT feature, value, CAST(count(*) AS DOUBLE) AS c FROM long GROUP BY 1, 2) GROUP BY 1),
rs AS (SELECT feature, grp, CAST(count(*) AS DOUBLE) AS n, sum(rk) AS r FROM ranked GROUP BY 1, 2)
"""


# cleaning ----------------------------------------------------------------------------------------

@query(FEATURES + "SELECT feature_id, CASE WHEN (total_sleep_mean IS NULL OR total_sleep_mean = 0) AND (total_bouts_mean IS NULL OR total_bouts_mean = 0) THEN 'no sleep; no bouts' WHEN total_sleep_mean IS NULL OR total_sleep_mean = 0 THEN 'no sleep' ELSE 'no bouts' END AS why FROM ft WHERE total_sleep_mean IS NULL OR total_sleep_mean = 0 OR total_bouts_mean IS NULL OR total_bouts_mean = 0")
def f_problem_flies(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12."""
    return clean.problem_rows(features(spark, sf_dir)).select("feature_id", "why")


@query(FEATURES + "SELECT feature_id FROM ft WHERE total_sleep_mean = 0 OR total_bouts_mean = 0 OR p_doze_mean IS NULL OR p_doze_mean = 0")
def f_problem_flies_csv(spark: SparkSession, sf_dir: str) -> DataFrame:
    """F12v."""
    return clean.problem_rows(features(spark, sf_dir), file_variant=True).select("feature_id")


_IQR = FEATURES + """, b AS (SELECT genotype, sex, treatment, quantile_cont(total_sleep_mean, 0.25) AS q1, quantile_cont(total_sleep_mean, 0.75) AS q3, count(*) AS n FROM ft
  WHERE total_sleep_mean IS NOT NULL AND genotype IS NOT NULL AND sex IS NOT NULL AND treatment IS NOT NULL GROUP BY ALL)
"""


@query(_IQR + "SELECT genotype, sex, treatment, round(q1, 6) AS q1, round(q3, 6) AS q3, round(q1 - 1.5 * (q3 - q1), 6) AS low, round(q3 + 1.5 * (q3 - q1), 6) AS high, n FROM b")
def a_iqr_bounds(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A9."""
    b = clean.iqr_bounds(features(spark, sf_dir).dropna(subset=clean.GROUP))
    return b.select(*clean.GROUP, *[r6(c) for c in ("q1", "q3", "low", "high")], "n")


@query(_IQR + "SELECT feature_id, coalesce(total_sleep_mean < q1 - 1.5 * (q3 - q1) OR total_sleep_mean > q3 + 1.5 * (q3 - q1), false) AS is_outlier FROM ft LEFT JOIN b USING (genotype, sex, treatment) WHERE genotype IS NOT NULL AND sex IS NOT NULL AND treatment IS NOT NULL")
def a_iqr_outliers(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A10, J7, SNK12: every row with its verdict."""
    return clean.iqr_marked(features(spark, sf_dir)).select("feature_id", "is_outlier")


@query(FEATURES + "SELECT feature_id, coalesce(day_bouts_mean, 0) AS day_bouts_mean, coalesce(night_bouts_mean, 0) AS night_bouts_mean, round(coalesce(sleep_latency_mean, avg(sleep_latency_mean) OVER (PARTITION BY genotype, sex, treatment)), 6) AS sleep_latency_mean FROM ft")
def n_nan_fix(spark: SparkSession, sf_dir: str) -> DataFrame:
    """N6."""
    f = clean.filled_nan(features(spark, sf_dir))
    return f.select("feature_id", "day_bouts_mean", "night_bouts_mean", r6("sleep_latency_mean"))


@query(FEATURES + "SELECT feature_id, " + ", ".join(f"round(({c} - avg({c}) OVER ()) / nullif(stddev_samp({c}) OVER (), 0), 6) AS {c}_z" for c in NUMERIC) + " FROM ft")
def n_z_scores(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Z-scores of all numeric columns over all rows."""
    f = features(spark, sf_dir)
    cols = clean.feature_columns(f)
    z = clean.z_scored(f.select("feature_id", *cols), cols)
    return z.select("feature_id", *[r6(f"{c}_z") for c in cols])


@query(" UNION ALL ".join(f"SELECT '{c}' AS feature, count(*) FILTER (WHERE {c} IS NULL OR isnan(CAST({c} AS DOUBLE))) AS n_null, count(*) AS n FROM features" for c in NUMERIC))
def n_diagnostics(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every numeric column."""
    f = clean.without_nan(table(spark, sf_dir, "features"))
    return clean.null_counts(f, clean.feature_columns(f))


@query(LONG + "SELECT grp AS genotype, feature, round(avg(value), 10) AS mean_z, round(stddev_samp(value), 6) AS sd_z, count(*) AS n FROM long GROUP BY 1, 2")
def a_genotype_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean and deviation of z of each genotype (means to ten places: six would round ties of short numbers)."""
    return long_z(spark, sf_dir).groupBy(F.col("grp").alias("genotype"), "feature").agg(F.round(F.avg("value"), 10).alias("mean_z"), r6(F.stddev_samp("value"), "sd_z"), F.count(F.lit(1)).alias("n"))


@query(LONG + "SELECT grp, feature, round(quantile_cont(value, 0.5), 8) AS median, round(quantile_cont(value, 0.75) - quantile_cont(value, 0.25), 8) AS iqr, count(*) AS n FROM long GROUP BY 1, 2")
def a_group_signature(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Median and quartile range per group and feature, from counts by value."""
    counts = long_z(spark, sf_dir).groupBy("grp", "feature", "value").agg(F.count(F.lit(1)).alias("_n"))
    q = counts.groupBy("grp", "feature").agg(F.percentile("value", F.array(F.lit(0.25), F.lit(0.5), F.lit(0.75)), F.col("_n")).alias("q"), F.sum("_n").alias("n"))
    return q.select("grp", "feature", F.round(F.col("q")[1], 8).alias("median"), F.round(F.col("q")[2] - F.col("q")[0], 8).alias("iqr"), "n")


@query(BASE + "SELECT treatment, genotype, count(*) AS n, round(100.0 * count(*) / sum(count(*)) OVER (PARTITION BY treatment), 6) AS percent FROM fly WHERE genotype IS NOT NULL GROUP BY 1, 2")
def a_enrichment(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Counts and percent of genotypes within treatments."""
    g = flies(spark, sf_dir).where("genotype is not null").groupBy("treatment", "genotype").agg(F.count(F.lit(1)).alias("n"))
    return g.select("treatment", "genotype", "n", r6(100.0 * F.col("n") / F.sum("n").over(Window.partitionBy("treatment")), "percent"))


# statistics --------------------------------------------------------------------------------------

@query(
    LONG
    + """, g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_pop(value) AS v FROM long GROUP BY 1, 2),
t AS (SELECT feature, CAST(sum(n) AS BIGINT) AS n, count(*) AS k, sum(n * m) / sum(n) AS mean, sum(n * v) AS within FROM g GROUP BY 1),
b AS (SELECT feature, sum(g.n * (m - mean) ** 2) AS between_ FROM g JOIN t USING (feature) GROUP BY 1)
SELECT feature, n, k, round((between_ / (k - 1)) / (within / (n - k)), 4) AS f, round(between_ / (between_ + within), 6) AS eta2 FROM t JOIN b USING (feature) WHERE k >= 2"""
)
def s_anova(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S2."""
    return stats.anova(long_z(spark, sf_dir)).select("feature", "n", "k", F.round("f", 4).alias("f"), r6("eta2"))


@query(
    RANKS
    + """, s AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(r * r / n) AS q FROM rs GROUP BY 1),
h AS (SELECT s.*, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM s JOIN tie USING (feature))
SELECT feature, CAST(n AS BIGINT) AS n, k, round(h, 4) AS h, round(greatest(0, (h - k + 1) / (n - k)), 6) AS epsilon2 FROM h WHERE k >= 2"""
)
def s_kruskal(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S3, S4, S13."""
    return stats.kruskal(long_z(spark, sf_dir)).select("feature", "n", "k", F.round("h", 4).alias("h"), r6("epsilon2"))


@query(
    RANKS
    + """, u AS (SELECT feature, grp, n AS n1, nn - n AS n2, r - n * (n + 1) / 2 AS u, nn, t FROM rs JOIN tie USING (feature))
SELECT feature, grp, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u, round(2 * u / (n1 * n2) - 1, 6) AS r,
  round(sign(u - n1 * n2 / 2) * greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((nn + 1) - t / (nn * (nn - 1)))), 4) AS z FROM u WHERE n2 > 0"""
)
def s_mann_whitney(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each genotype against the rest."""
    m = stats.mann_whitney_one_vs_rest(long_z(spark, sf_dir))
    return m.select("feature", "grp", "n1", F.col("n2").cast("long").alias("n2"), F.round("u", 2).alias("u"), r6("r"), F.round("z", 4).alias("z"))


@query()
def s_adjusted(spark: SparkSession, sf_dir: str) -> DataFrame:
    """P values of all tests, adjusted within each genotype, with the direction of the effect."""
    m = stats.mann_whitney_one_vs_rest(long_z(spark, sf_dir))
    adjusted = stats.benjamini_hochberg(m, "p", ("grp",))
    return adjusted.select("feature", "grp", r6("p"), r6("p_adj"), F.when(F.col("r") > 0, "higher").otherwise("lower").alias("direction"))


@query(
    LONG
    + """, pr AS (SELECT a.feature, a.grp AS a, b.grp AS b, sum(CASE WHEN a.value > b.value THEN 1 WHEN a.value < b.value THEN -1 ELSE 0 END) / CAST(count(*) AS DOUBLE) AS delta
  FROM long a JOIN long b ON a.feature = b.feature AND a.grp < b.grp GROUP BY ALL)
SELECT feature, a, b, round(delta, 6) AS delta, CASE WHEN abs(delta) < 0.147 THEN 'negligible' WHEN abs(delta) < 0.33 THEN 'small' WHEN abs(delta) < 0.474 THEN 'medium' ELSE 'large' END AS magnitude FROM pr"""
)
def s_cliffs_delta(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two genotypes, without pairing rows."""
    return stats.cliffs_delta(long_z(spark, sf_dir)).select("feature", "a", "b", r6("delta"), "magnitude")


@query(
    RANKS
    + """, m AS (SELECT feature, grp, n, r / n AS mean FROM rs)
SELECT a.feature, a.grp AS a, b.grp AS b, round((a.mean - b.mean) / sqrt((nn * (nn + 1) / 12 - t / (12 * (nn - 1))) * (1 / a.n + 1 / b.n)), 4) AS z
FROM m a JOIN m b ON a.feature = b.feature AND a.grp < b.grp JOIN tie ON tie.feature = a.feature"""
)
def s_dunn(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Every two genotypes after Kruskal-Wallis."""
    return stats.dunn(long_z(spark, sf_dir)).select("feature", "a", "b", F.round("z", 4).alias("z"))


def clustered_z(spark: SparkSession, sf_dir: str, group: str, features_of: Callable = lambda c: F.col("feature")) -> DataFrame:
    """feature, grp, value of the rows with both sleep measures; ``cluster`` is the quadrant of total and night sleep."""
    z = features_z(spark, sf_dir).where("total_sleep_mean_z is not null and night_sleep_mean_z is not null")
    quadrant = F.concat(F.when(F.col("total_sleep_mean_z") > 0, "long").otherwise("short"), F.lit("-"), F.when(F.col("night_sleep_mean_z") > 0, "night").otherwise("day"))
    z = z.withColumn("cluster", quadrant).where(F.col(group).isNotNull())
    pairs = F.explode(F.array(*[F.struct(F.lit(c).alias("feature"), F.col(c).cast("double").alias("value")) for c in clean.feature_columns(z, "_z")]))
    rows = z.select("cluster", F.col(group).alias("grp"), pairs.alias("x")).select("cluster", "grp", "x.feature", "x.value").where(F.col("value").isNotNull() & ~F.isnan("value"))
    return rows.select(features_of("cluster").alias("feature"), "grp", "value")


def within_cluster(_: str):
    return F.concat_ws("|", "cluster", "feature")


_QUADRANT = "CASE WHEN total_sleep_mean_z > 0 THEN 'long' ELSE 'short' END || '-' || CASE WHEN night_sleep_mean_z > 0 THEN 'night' ELSE 'day' END"


def _clustered(group: str, feature: str) -> str:
    """LONG and RANKS over the rows with a cluster, grouped by another column, features perhaps within clusters."""
    cells = " UNION ALL ".join(f"SELECT {feature.format(c=c)} AS feature, {group} AS grp, {c} AS value FROM fz WHERE {group} IS NOT NULL AND {c} IS NOT NULL AND NOT isnan({c})" for c in TESTED)
    head = BASE + f", fz AS (SELECT z.*, genotype, sex, treatment, {_QUADRANT} AS cluster FROM features_z z LEFT JOIN fly USING (fly_id) WHERE total_sleep_mean_z IS NOT NULL AND NOT isnan(total_sleep_mean_z) AND night_sleep_mean_z IS NOT NULL AND NOT isnan(night_sleep_mean_z)), long AS ({cells})\n"
    return head + RANKS[len(LONG):]


_U = """, u AS (SELECT feature, grp, n AS n1, nn - n AS n2, r - n * (n + 1) / 2 AS u, nn, t FROM rs JOIN tie USING (feature))
SELECT feature, grp, CAST(n1 AS BIGINT) AS n1, CAST(n2 AS BIGINT) AS n2, round(u, 2) AS u, round(2 * u / (n1 * n2) - 1, 6) AS r,
  round(sign(u - n1 * n2 / 2) * greatest(0, abs(u - n1 * n2 / 2) - 0.5) / sqrt(n1 * n2 / 12 * ((nn + 1) - t / (nn * (nn - 1)))), 4) AS z FROM u WHERE n2 > 0"""


def _tested(m: DataFrame) -> DataFrame:
    return m.select("feature", "grp", "n1", F.col("n2").cast("long").alias("n2"), F.round("u", 2).alias("u"), r6("r"), F.round("z", 4).alias("z"))


@query(_clustered("sex", "cluster || '|{c}'") + _U + " AND n1 >= 3 AND n2 >= 3 AND grp = 'Female'")
def s_sexes_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Females against males within each cluster, three of each at least."""
    m = stats.mann_whitney_one_vs_rest(clustered_z(spark, sf_dir, "sex", within_cluster)).where("grp = 'Female' and n1 >= 3 and n2 >= 3")
    return _tested(m)


@query(_clustered("cluster", "'{c}'") + _U)
def s_clusters_against_rest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each cluster against all others."""
    return _tested(stats.mann_whitney_one_vs_rest(clustered_z(spark, sf_dir, "cluster")))


@query(
    _clustered("genotype", "cluster || '|{c}'")
    + """, s AS (SELECT feature, sum(n) AS n, count(*) AS k, sum(r * r / n) AS q FROM rs GROUP BY 1),
h AS (SELECT s.*, (12 / (n * (n + 1)) * q - 3 * (n + 1)) / (1 - t / (n * n * n - n)) AS h FROM s JOIN tie USING (feature))
SELECT feature, CAST(n AS BIGINT) AS n, k, round(h, 4) AS h, round(greatest(0, (h - k + 1) / (n - k)), 6) AS epsilon2 FROM h WHERE k >= 2"""
)
def s_genotypes_in_clusters(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotypes within each cluster."""
    return stats.kruskal(clustered_z(spark, sf_dir, "genotype", within_cluster)).select("feature", "n", "k", F.round("h", 4).alias("h"), r6("epsilon2"))


_COHEN = LONG + """, g AS (SELECT feature, grp, count(*) AS n, avg(value) AS m, var_samp(value) AS v FROM long GROUP BY 1, 2),
r AS (SELECT g.feature, g.grp, any_value(g.n) AS n, any_value(g.m) AS m, any_value(g.v) AS v, count(*) AS n2, avg(l.value) AS m2, var_samp(l.value) AS v2
  FROM g JOIN long l ON l.feature = g.feature AND l.grp <> g.grp GROUP BY 1, 2),
d AS (SELECT feature, grp, (m - m2) / sqrt(((n - 1) * v + (n2 - 1) * v2) / (n + n2 - 2)) AS d FROM r WHERE n >= 2 AND n2 >= 2)
"""


@query(_COHEN + "SELECT feature, grp, round(d, 6) AS d FROM d")
def s_cohens_d(spark: SparkSession, sf_dir: str) -> DataFrame:
    """S15."""
    return stats.cohens_d_one_vs_rest(long_z(spark, sf_dir)).select("feature", "grp", r6("d"))


@query(_COHEN + "SELECT feature, grp, round(d, 6) AS d, position FROM (SELECT *, CAST(row_number() OVER (PARTITION BY grp ORDER BY abs(d) DESC, feature) AS INTEGER) AS position FROM d) WHERE position <= 2")
def s_top_effects(spark: SparkSession, sf_dir: str) -> DataFrame:
    """The two strongest features of each genotype (a top-k report)."""
    top = stats.top_by_size(stats.cohens_d_one_vs_rest(long_z(spark, sf_dir)), "grp", "d", 2)
    return top.select("feature", "grp", r6("d"), "position")


@query(
    BASE
    + """, c AS (SELECT genotype AS a, sex AS b, count(*) AS n FROM fly WHERE genotype IS NOT NULL AND sex IS NOT NULL GROUP BY 1, 2),
ra AS (SELECT a, sum(n) AS ra FROM c GROUP BY 1), cb AS (SELECT b, sum(n) AS cb FROM c GROUP BY 1), tt AS (SELECT sum(n) AS total FROM c),
e AS (SELECT coalesce(c.n, 0) AS o, ra * cb / total AS e, total FROM ra CROSS JOIN cb CROSS JOIN tt LEFT JOIN c USING (a, b))
SELECT CAST(any_value(total) AS BIGINT) AS n, (SELECT count(*) FROM ra) AS "rows", (SELECT count(*) FROM cb) AS cols, round(sum((o - e) ** 2 / e), 4) AS chi2 FROM e"""
)
def s_chi_square(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Sexes against genotypes."""
    return stats.chi_square(flies(spark, sf_dir), "genotype", "sex").select("n", "rows", "cols", F.round("chi2", 4).alias("chi2"))


@query()
def s_fisher(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Each genotype's sexes against those of all others, exactly."""
    t = stats.fisher_one_vs_rest(flies(spark, sf_dir), "genotype", "sex")
    return t.select(F.col("grp").alias("genotype"), F.col("trait").alias("sex"), "a", "b", "c", "d", r6("p"))


@query(
    BASE
    + """, x AS (SELECT z.feature_id, CASE WHEN total_sleep_mean_z > 0 THEN 'long' ELSE 'short' END AS a, genotype AS b FROM features_z z JOIN fly USING (fly_id) WHERE total_sleep_mean_z IS NOT NULL AND NOT isnan(total_sleep_mean_z) AND genotype IS NOT NULL),
c AS (SELECT a, b, CAST(count(*) AS DOUBLE) AS n FROM x GROUP BY 1, 2), pa AS (SELECT a, sum(n) AS n FROM c GROUP BY 1), pb AS (SELECT b, sum(n) AS n FROM c GROUP BY 1),
s AS (SELECT (SELECT sum(n) FROM c) AS n, (SELECT sum(n * (n - 1) / 2) FROM c) AS c2, (SELECT sum(n * (n - 1) / 2) FROM pa) AS ca, (SELECT sum(n * (n - 1) / 2) FROM pb) AS cb,
  (SELECT sum(n * ln(n)) FROM c) AS nl, (SELECT sum(n * ln(n)) FROM pa) AS la, (SELECT sum(n * ln(n)) FROM pb) AS lb)
SELECT CAST(n AS BIGINT) AS n, round((c2 - ca * cb / (n * (n - 1) / 2)) / ((ca + cb) / 2 - ca * cb / (n * (n - 1) / 2)), 6) AS ari,
  round(((nl - la - lb) / n + ln(n)) / ((ln(n) - la / n + ln(n) - lb / n) / 2), 6) AS nmi FROM s"""
)
def s_agreement(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Agreement of two labelings."""
    z = features_z(spark, sf_dir).where("total_sleep_mean_z is not null").withColumn("a", F.when(F.col("total_sleep_mean_z") > 0, "long").otherwise("short"))
    return stats.agreement(z, "a", "genotype").select("n", r6("ari"), r6("nmi"))


# clusters and models -----------------------------------------------------------------------------

@query(
    "WITH x AS (SELECT label, " + ", ".join(f"CAST(embedding[{i + 1}] AS DOUBLE) AS e{i}" for i in range(64)) + " FROM embeddings WHERE label IS NOT NULL), c AS (SELECT label, count(*) AS n, "
    + ", ".join(f"avg(e{i}) AS m{i}, var_pop(e{i}) AS v{i}" for i in range(64)) + " FROM x GROUP BY 1), g AS (SELECT " + ", ".join(f"avg(e{i}) AS g{i}" for i in range(64)) + " FROM x), "
    + "d AS (SELECT x.label, avg(sqrt(" + " + ".join(f"(x.e{i} - m{i}) ** 2" for i in range(64)) + ")) AS s FROM x JOIN c USING (label) GROUP BY 1), "
    + "w AS (SELECT a.label, max((da.s + db.s) / sqrt(" + " + ".join(f"(a.m{i} - b.m{i}) ** 2" for i in range(64)) + ")) AS r FROM c a JOIN c b ON a.label <> b.label JOIN d da ON da.label = a.label JOIN d db ON db.label = b.label GROUP BY 1), "
    + "t AS (SELECT CAST(sum(n) AS BIGINT) AS n, count(*) AS clusters, sum(n * (" + " + ".join(f"(m{i} - g{i}) ** 2" for i in range(64)) + ")) AS b, sum(n * (" + " + ".join(f"v{i}" for i in range(64)) + ")) AS w FROM c CROSS JOIN g) "
    + "SELECT n, clusters, round(b * (n - clusters) / (w * (clusters - 1)), 4) AS calinski_harabasz, round((SELECT avg(r) FROM w), 4) AS davies_bouldin FROM t"
)
def m_cluster_measures(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Measures of the labels of the embeddings."""
    m = cluster.centroid_measures(table(spark, sf_dir, "embeddings"), "label", "embedding")
    return m.select("n", "clusters", F.round("calinski_harabasz", 4).alias("calinski_harabasz"), F.round("davies_bouldin", 4).alias("davies_bouldin"))


@query()
def m_dbscan(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Density clusters of the flies by two sleep features."""
    z = table(spark, sf_dir, "features_z")
    return cluster.dbscan(z, "feature_id", ("total_sleep_mean_z", "night_sleep_mean_z"), 0.1, 6)


@query()
def m_pca(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L1, L2: five components of all z columns and each row's scores."""
    z = model_rows(spark, sf_dir)
    scores, _, _ = ml.principal_components(z, clean.feature_columns(z, "_z"), 5)
    return scores.select("feature_id", *[r6(f"pc{i}") for i in range(1, 6)])


@query()
def m_pca_loadings(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Summed squared loadings of the first components beside the forest's importances, ranked side by side."""
    z = model_rows(spark, sf_dir)
    cols = clean.feature_columns(z, "_z")
    _, _, loadings = ml.principal_components(z, cols, 8)
    _, important = ml.forest(z.where("genotype is not null"), cols, "genotype", "feature_id", trees=20, depth=6)
    strength = spark.createDataFrame([(c, float((loadings[i] ** 2).sum())) for i, c in enumerate(cols)], "pca_feature string, pca_strength double")
    ranked = strength.withColumn("position", F.row_number().over(Window.orderBy(F.desc("pca_strength"), "pca_feature")))
    return ranked.join(important, "position", "full").select("position", "pca_feature", r6("pca_strength"), F.col("feature").alias("rf_feature"), r6("importance"))


@query()
def m_forest(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Genotype from the z columns: held-out measures."""
    z = model_rows(spark, sf_dir).where("genotype is not null")
    tested, _ = ml.forest(z, clean.feature_columns(z, "_z"), "genotype", "feature_id", trees=20, depth=6)
    return ml.class_measures(tested, "genotype")


@query()
def m_near_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Dead within two days, from the latest health reports, split by fly."""
    from ultradia.operators.health import latest_reports

    reports = latest_reports(table(spark, sf_dir, "health_reports"))
    died = reports.where("status = 'Dead'").groupBy(*SOURCE).agg(F.min("report_date").alias("died"))
    rows = reports.join(died, SOURCE, "left").withColumn("near", F.coalesce(F.datediff("died", "report_date").between(0, 2), F.lit(False)).cast("int"))
    measures = ["total_activity", "longest_zero_hours", "missing_fraction"]
    filled = rows.withColumns({c: F.coalesce(F.nanvl(F.col(c).cast("double"), F.lit(0.0)), F.lit(0.0)) for c in measures})
    got = ml.boosted(written(filled.select("fly_id", "near", *measures), "reports"), measures, "near", "fly_id", rounds=10, depth=3)
    return ml.class_measures(got, "near")


@query()
def m_time_to_death(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Hours to death from the sleep of six-hour windows, folds by fly."""
    m = written(minutes(spark, sf_dir), "minutes")
    w = death.backward_windows(m, death.dense_deaths(m, table(spark, sf_dir, "experiments"), 24))
    cols = ["total_sleep_min", "n_sleep_bouts", "mean_bout_min", "longest_bout_min", "bouts_per_hour", "interruption_rate", "mean_wake_bout_min", "p_wake", "p_doze"]
    return ml.regression_folds(written(w, "windows"), cols, "ttd", "fly_id", trees=20, depth=8)


def labelled_bins(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Bins with their labels; thresholds fit for the sparse series: bouts of one bin, half a day to warm up counted in bins present."""
    return rolling_states.prelabelled(bins(spark, sf_dir), min_bout=1, warmup=24)


@query(
    BASE
    + """, b AS (SELECT experiment_id, fly_id, time_bucket(INTERVAL 5 MINUTE, datetime) AS bin, CAST(coalesce(sum(value) FILTER (WHERE reading_type = 'MT'), 0) AS DOUBLE) AS mt, coalesce(var_samp(value) FILTER (WHERE reading_type = 'Pn'), 0) AS pn
  FROM ztimed WHERE reading_type IN ('MT', 'Pn') AND value BETWEEN 0 AND 1000 GROUP BY ALL),
s AS (SELECT *, CASE WHEN mt = 0 THEN 'Sleep' ELSE 'Active' END AS st FROM b),
w AS (SELECT *, CASE WHEN st = 'Active' THEN mt END AS am, CASE WHEN st = 'Active' THEN pn END AS ap FROM s),
z AS (SELECT *, stddev_samp(am) OVER p AS sm, stddev_samp(ap) OVER p AS sp, coalesce(stddev_samp(am) OVER q * 0.01, 0) AS fm, coalesce(stddev_samp(ap) OVER q * 0.01, 0) AS fp, count(am) OVER (q ORDER BY bin ROWS UNBOUNDED PRECEDING) AS seen
  FROM w WINDOW p AS (PARTITION BY experiment_id, fly_id ORDER BY bin ROWS 287 PRECEDING), q AS (PARTITION BY experiment_id, fly_id)),
l AS (SELECT *, CASE WHEN st = 'Sleep' THEN 'Sleep' WHEN seen < 24 THEN 'Warmup' WHEN coalesce(sm < CASE WHEN fm > 0 THEN fm ELSE 1e-6 END, false) OR coalesce(sp < CASE WHEN fp > 0 THEN fp ELSE 1e-6 END, false) THEN 'Low_Data' ELSE 'HMM_candidate' END AS hs FROM z)
SELECT experiment_id, fly_id, count(*) AS n_bins, round(100 * avg(CASE WHEN hs = 'Sleep' THEN 1.0 ELSE 0 END), 1) AS pct_sleep, round(100 * avg(CASE WHEN hs = 'Warmup' THEN 1.0 ELSE 0 END), 1) AS pct_warmup,
  round(100 * avg(CASE WHEN hs = 'HMM_candidate' THEN 1.0 ELSE 0 END), 1) AS pct_hmm_candidate FROM l GROUP BY 1, 2"""
)
def w_state_shares(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Shares of the labels of each source."""
    return rolling_states.state_shares(labelled_bins(spark, sf_dir)).select(*SOURCE, "n_bins", "pct_sleep", "pct_warmup", "pct_hmm_candidate")


@query(
    BASE
    + """, b AS (SELECT experiment_id, fly_id, time_bucket(INTERVAL 5 MINUTE, datetime) AS bin, CAST(coalesce(sum(value) FILTER (WHERE reading_type = 'MT'), 0) AS DOUBLE) AS mt, coalesce(var_samp(value) FILTER (WHERE reading_type = 'Pn'), 0) AS pn
  FROM ztimed WHERE reading_type IN ('MT', 'Pn') AND value BETWEEN 0 AND 1000 GROUP BY ALL),
still AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id ORDER BY bin) - row_number() OVER (PARTITION BY experiment_id, fly_id, mt = 0 AND pn = 0 ORDER BY bin) AS g FROM b),
dead AS (SELECT experiment_id, fly_id, min(a) AS dead_at FROM (SELECT experiment_id, fly_id, min(bin) AS a, count(*) AS n FROM still WHERE mt = 0 AND pn = 0 GROUP BY experiment_id, fly_id, g) WHERE n >= 144 GROUP BY 1, 2),
s AS (SELECT b.*, CASE WHEN bin >= dead_at THEN 'Dead' WHEN mt = 0 THEN 'Sleep' ELSE 'Active' END AS st FROM b LEFT JOIN dead USING (experiment_id, fly_id)),
i AS (SELECT *, row_number() OVER (PARTITION BY experiment_id, fly_id ORDER BY bin) - row_number() OVER (PARTITION BY experiment_id, fly_id, st ORDER BY bin) AS g FROM s),
t AS (SELECT * EXCLUDE (st), CASE WHEN st = 'Active' AND count(*) OVER (PARTITION BY experiment_id, fly_id, st, g) < 6 THEN 'Sleep' ELSE st END AS st FROM i),
w AS (SELECT *, CASE WHEN st = 'Active' THEN mt END AS am, CASE WHEN st = 'Active' THEN pn END AS ap FROM t),
z AS (SELECT *, stddev_samp(am) OVER p AS sm, stddev_samp(ap) OVER p AS sp, coalesce(stddev_samp(am) OVER q * 0.01, 0) AS fm, coalesce(stddev_samp(ap) OVER q * 0.01, 0) AS fp, count(am) OVER (q ORDER BY bin ROWS UNBOUNDED PRECEDING) AS seen
  FROM w WINDOW p AS (PARTITION BY experiment_id, fly_id ORDER BY bin ROWS 287 PRECEDING), q AS (PARTITION BY experiment_id, fly_id)),
l AS (SELECT *, CASE WHEN st <> 'Active' THEN st WHEN seen < 144 THEN 'Warmup' WHEN coalesce(sm < CASE WHEN fm > 0 THEN fm ELSE 1e-6 END, false) OR coalesce(sp < CASE WHEN fp > 0 THEN fp ELSE 1e-6 END, false) THEN 'Low_Data' ELSE 'HMM_candidate' END AS hs FROM z)
SELECT experiment_id, fly_id, count(*) AS n_bins, round(100 * avg(CASE WHEN hs = 'Dead' THEN 1.0 ELSE 0 END), 1) AS pct_dead, round(100 * avg(CASE WHEN hs = 'Sleep' THEN 1.0 ELSE 0 END), 1) AS pct_sleep,
  round(100 * avg(CASE WHEN hs = 'Warmup' THEN 1.0 ELSE 0 END), 1) AS pct_warmup, round(100 * avg(CASE WHEN hs = 'HMM_candidate' THEN 1.0 ELSE 0 END), 1) AS pct_hmm_candidate FROM l GROUP BY 1, 2"""
)
def w_state_shares_usual(spark: SparkSession, sf_dir: str) -> DataFrame:
    """W14, W9, C9 with the usual thresholds: bouts of six bins, 144 active bins to warm up, death after 144 still ones."""
    return rolling_states.state_shares(rolling_states.prelabelled(bins(spark, sf_dir))).select(*SOURCE, "n_bins", "pct_dead", "pct_sleep", "pct_warmup", "pct_hmm_candidate")


@query()
def m_hidden_states(spark: SparkSession, sf_dir: str) -> DataFrame:
    """L11, W15, SNK5: states of the candidate bins by one model per genotype."""
    bouts = rolling_states.candidate_bouts(labelled_bins(spark, sf_dir), 60)
    known = bouts.join(flies(spark, sf_dir).select("fly_id", "genotype"), "fly_id", "left")
    found = hmm.decoded_states(known)
    return found.select(*SOURCE, stamp(F.col("bin")).alias("bin"), "state")
