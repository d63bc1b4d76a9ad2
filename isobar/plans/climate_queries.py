"""Seasons, climatologies, trends, correlations."""

from __future__ import annotations

from pyspark.sql import functions as F

from isobar.functions.caltime import season_year
from isobar.functions.stats import mean_circular, mean_ignoring_missing, multi_ols, spearman, spread, sum_ignoring_missing, trend
from isobar.operators import climate as C, moisture as M
from isobar.plans.adapters import FIELD_SQL, OBS_SQL, SEASON_SQL, field, obs, season_rows
from isobar.plans.grid_queries import SHIFT, near, rounded
from isobar.plans.registry import query

MONTH_SQL = SEASON_SQL + ", mo AS (SELECT region, year, month, sum(value) AS total, avg(value) AS mean, count(value) AS n FROM sy GROUP BY ALL)"
ROLL_SQL = MONTH_SQL + """, ro AS (SELECT * FROM (SELECT *, sum(total) OVER w AS season_total, count(*) OVER w AS k FROM mo WINDOW w AS (PARTITION BY region ORDER BY year*12 + month - 1 RANGE BETWEEN 2 PRECEDING AND CURRENT ROW)) WHERE k = 3)"""


def months(spark, sf_dir):
    return C.monthly(season_rows(spark, sf_dir), ["region"])


@query(f"WITH {MONTH_SQL} SELECT region, year, month, round(total, 3) AS total, round(mean, 5) AS mean, n FROM mo")
def monthly_means(spark, sf_dir):
    return months(spark, sf_dir).withColumns({"total": F.round("total", 3), "mean": F.round("mean", 5)})


@query(f"WITH {ROLL_SQL} SELECT region, year, month, round(season_total, 3) AS season_total FROM ro")
def seasonal_sum_rolling3(spark, sf_dir):
    return C.three_month(months(spark, sf_dir), ["region"]).select("region", "year", "month", F.round("season_total", 3).alias("season_total"))


@query(f"WITH {ROLL_SQL} SELECT region, month, round(avg(season_total), 3) AS clim, count(*) AS years FROM ro WHERE year BETWEEN 1996 AND 2000 GROUP BY ALL")
def seasonal_climatology(spark, sf_dir):
    return C.seasonal_climatology(months(spark, sf_dir), ["region"], 1996, 2000).withColumn("clim", F.round("clim", 3))


ENDS_SQL = MONTH_SQL + ", en AS (SELECT *, CAST((month - 1 + k) % 12 + 1 AS INTEGER) AS endmonth FROM mo, range(3) t(k) WHERE year BETWEEN 1996 AND 2000)"


@query(f"WITH {ENDS_SQL} SELECT region, endmonth, round(avg(mean), 5) AS clim, count(mean) AS months FROM en GROUP BY ALL")
def pooled_climatology(spark, sf_dir):
    return C.pooled_climatology(months(spark, sf_dir), ["region"], 1996, 2000).withColumn("clim", F.round("clim", 5))


@query(f"WITH {ENDS_SQL} SELECT region, endmonth, round(sum(mean*n)/sum(n), 5) AS clim, count(mean) AS months FROM en GROUP BY ALL")
def weighted_climatology(spark, sf_dir):
    return C.pooled_climatology(months(spark, sf_dir), ["region"], 1996, 2000, "n").withColumn("clim", F.round("clim", 5))


def p_value(t: str, df: str) -> str:
    """DuckDB text of the two-sided p of t at a whole number of degrees of freedom, by the finite series in the angle."""
    angle = f"atan(abs({t})/sqrt({df}))"
    log_cos = f"(-0.5e0*ln(1 + ({t})*({t})/({df})))"
    even = f"sin({angle})*list_sum(list_transform(range(0, CAST({df} AS BIGINT)//2), lambda j: exp(lgamma(j + 0.5e0) - lgamma(0.5e0) - lgamma(j + 1e0) + 2*j*{log_cos})))"
    odd = f"2/pi()*({angle} + sin({angle})*coalesce(list_sum(list_transform(range(0, (CAST({df} AS BIGINT) - 1)//2), lambda j: exp(lgamma(j + 1e0) + lgamma(1.5e0) - lgamma(j + 1.5e0) + (2*j + 1)*{log_cos}))), 0))"
    return f"CASE WHEN {df} > 0 THEN 1 - CASE WHEN CAST({df} AS BIGINT) % 2 = 0 THEN {even} ELSE {odd} END END"


def _trend(rows: str, keys: str, y: str) -> str:
    return f"""SELECT {keys}, n, CASE WHEN n >= 5 THEN round(b, 4) END AS trend, CASE WHEN n >= 5 THEN round(a, 0) END AS yint, CASE WHEN n >= 5 THEN round(r, 7) END AS r2, CASE WHEN n >= 5 AND n > 2 THEN round(sqrt(greatest((1 - r)*syy/sxx/(n - 2), 0)), 4) END AS stderr
 FROM (SELECT {keys}, regr_count({y}, year) AS n, regr_slope({y}, year) AS b, regr_intercept({y}, year) AS a, regr_r2({y}, year) AS r, regr_sxx({y}, year) AS sxx, regr_syy({y}, year) AS syy FROM {rows} GROUP BY {keys})"""


def _round_trend(frame):
    return frame.withColumns({"trend": F.round("trend", 4), "yint": F.round("yint", 0), "r2": F.round("r2", 7), "stderr": F.round("stderr", 4)})


@query(f"WITH {ROLL_SQL} " + _trend("ro", "region, month", "season_total"))
def trend_ols(spark, sf_dir):
    return _round_trend(C.seasonal_trend(months(spark, sf_dir), ["region"], 5))


@query(f"WITH {MONTH_SQL} " + _trend("mo", "region, month", "mean"))
def monthly_trend(spark, sf_dir):
    return _round_trend(C.monthly_trend(months(spark, sf_dir), ["region"], "mean", 5))


@query(f"""WITH {ROLL_SQL}, g AS (SELECT region, month, regr_count(season_total, year) AS n, regr_slope(season_total, year) AS b, regr_r2(season_total, year) AS r, regr_sxx(season_total, year) AS sxx, regr_syy(season_total, year) AS syy FROM ro GROUP BY ALL),
 e AS (SELECT *, b/nullif(sqrt(greatest((1 - r)*syy/nullif(sxx, 0)/nullif(n - 2, 0), 0)), 0) AS tt FROM g)
 SELECT region, month, n, CASE WHEN n >= 5 THEN round(b, 4) END AS trend, CASE WHEN n >= 5 THEN round({p_value('tt', '(n - 2)')}, 7) END AS pvalue FROM e""")
def trend_p_values(spark, sf_dir):
    made = C.seasonal_trend(months(spark, sf_dir), ["region"], 5, p_values=True)
    return made.select("region", "month", "n", F.round("trend", 4).alias("trend"), F.round("pvalue", 7).alias("pvalue"))


@query(f"""WITH {SEASON_SQL}, r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY value) + (count(*) OVER (PARTITION BY region, value) - 1)/2e0 AS rx, rank() OVER (PARTITION BY region ORDER BY bal) + (count(*) OVER (PARTITION BY region, bal) - 1)/2e0 AS ry FROM sy)
 SELECT region, round(corr(rx, ry), 9) AS rho, count(*) AS n FROM r GROUP BY region""")
def spearman_rank(spark, sf_dir):
    return spearman(season_rows(spark, sf_dir), ["region"], "value", "bal").withColumn("rho", F.round("rho", 9))


@query(f"""WITH {SEASON_SQL}, r AS (SELECT region, rank() OVER (PARTITION BY region ORDER BY value) + (count(*) OVER (PARTITION BY region, value) - 1)/2e0 AS rx, rank() OVER (PARTITION BY region ORDER BY bal) + (count(*) OVER (PARTITION BY region, bal) - 1)/2e0 AS ry FROM sy),
 c AS (SELECT region, corr(rx, ry) AS rho, count(*) AS n FROM r GROUP BY region), e AS (SELECT *, rho*sqrt((n - 2)/nullif(1 - rho*rho, 0)) AS tt FROM c)
 SELECT region, round(rho, 9) AS rho, n, round({p_value('tt', '(n - 2)')}, 6) AS pvalue FROM e""")
def spearman_p_values(spark, sf_dir):
    made = spearman(season_rows(spark, sf_dir), ["region"], "value", "bal", p_values=True)
    return made.select("region", F.round("rho", 9).alias("rho"), "n", F.round("pvalue", 6).alias("pvalue"))


@query(f"""WITH {SEASON_SQL}, s AS (SELECT region, count(*) AS n, corr(bal, year) AS a, corr(bal, month) AS b, corr(year, month) AS c, corr(bal, value) AS p, corr(year, value) AS q, corr(month, value) AS r FROM sy GROUP BY region),
 d AS (SELECT *, 1 + 2*a*b*c - a*a - b*b - c*c AS det FROM s),
 f AS (SELECT region, n, (1 - c*c)/det AS i1, (1 - b*b)/det AS i2, (1 - a*a)/det AS i3, (p*(1 - c*c) + q*(b*c - a) + r*(a*c - b))/det AS b1, (p*(b*c - a) + q*(1 - b*b) + r*(a*b - c))/det AS b2, (p*(a*c - b) + q*(a*b - c) + r*(1 - a*a))/det AS b3, p, q, r FROM d),
 g AS (SELECT *, (n - (b1*p + b2*q + b3*r)*n)/(n - 3) AS s2 FROM f),
 h AS (SELECT region, n, 1 - s2 AS adj_r2, unnest(['bal', 'year', 'month']) AS term, unnest([b1, b2, b3]) AS coef, unnest([b1/sqrt(i1/n*s2), b2/sqrt(i2/n*s2), b3/sqrt(i3/n*s2)]) AS tt FROM g)
 SELECT region, term, round(coef, 7) AS coef, n, round(adj_r2, 7) AS adj_r2, round({p_value('tt', '(n - 3)')}, 6) AS pvalue FROM h""")
def multi_ols_zscore(spark, sf_dir):
    rows = season_rows(spark, sf_dir).withColumns({"year": F.col("year").cast("double"), "month": F.col("month").cast("double")})
    made = multi_ols(rows, ["region"], "value", ["bal", "year", "month"])
    return made.select("region", "term", F.round("coef", 7).alias("coef"), "n", F.round("adj_r2", 7).alias("adj_r2"), F.round("pvalue", 6).alias("pvalue"))


@query(f"""WITH {SEASON_SQL}, w AS (SELECT region, bal, year, bal*(year - 1995) AS z, value AS y FROM sy),
 s AS (SELECT region, count(*) AS n, var_pop(bal) AS aa, var_pop(z) AS zz, covar_pop(bal, z) AS az, covar_pop(bal, y) AS ay, covar_pop(z, y) AS zy FROM w GROUP BY region)
 SELECT region, unnest(['bal', 'bal_year']) AS term, unnest([round((ay*zz - zy*az)/(aa*zz - az*az), 3), round((zy*aa - ay*az)/(aa*zz - az*az), 6)]) AS coef, n FROM s""")
def interaction_ols(spark, sf_dir):
    """A fit with an interaction term, the product of a variable and the years from 1995."""
    rows = season_rows(spark, sf_dir).withColumn("bal_year", F.col("bal") * (F.col("year") - 1995))
    made = multi_ols(rows, ["region"], "value", ["bal", "bal_year"], scaled=False, constant=True).where("term <> 'const'")
    return made.select("region", "term", F.when(F.col("term") == "bal", F.round("coef", 3)).otherwise(F.round("coef", 6)).alias("coef"), "n")


@query(f"""WITH {SEASON_SQL}, s AS (SELECT region, count(*) AS n, avg(value) AS my, avg(year) AS m1, avg(month) AS m2, var_pop(year) AS s11, var_pop(month) AS s22, covar_pop(year, month) AS s12, covar_pop(year, value) AS s1y, covar_pop(month, value) AS s2y FROM sy GROUP BY region)
 SELECT region, unnest(['year', 'month']) AS term, unnest([round((s1y*s22 - s2y*s12)/(s11*s22 - s12*s12), 5), round((s2y*s11 - s1y*s12)/(s11*s22 - s12*s12), 5)]) AS coef, n FROM s""")
def ols_with_constant(spark, sf_dir):
    made = multi_ols(season_rows(spark, sf_dir), ["region"], "value", ["year", "month"], scaled=False, constant=True)
    return made.where("term <> 'const'").select("region", "term", F.round("coef", 5).alias("coef"), "n")


@query(f"WITH {MONTH_SQL} SELECT region, month, CASE WHEN count(mean) >= 7 THEN round(stddev(mean), 5) END AS sd FROM mo GROUP BY ALL")
def spread_over_time(spark, sf_dir):
    return months(spark, sf_dir).groupBy("region", "month").agg(F.round(spread(F.col("mean"), 7), 5).alias("sd"))


@query(f"""WITH {SEASON_SQL}, a AS (SELECT region, CASE WHEN month >= 11 THEN year + 1 ELSE year END AS syear, value FROM sy) SELECT region, syear, round(sum(value), 3) AS total FROM a GROUP BY ALL""")
def season_year_totals(spark, sf_dir):
    rows = season_rows(spark, sf_dir).withColumn("syear", season_year(F.col("year"), F.col("month")))
    return rows.groupBy("region", "syear").agg(F.round(F.sum("value"), 3).alias("total"))


@query(f"""WITH {SEASON_SQL}, e AS (SELECT region, CAST(floor((year*12 + month - 1 + k)/12) AS INTEGER) AS season_year, CAST((month - 1 + k) % 12 + 1 AS INTEGER) AS endmonth, value FROM sy, range(3) t(k)) SELECT region, season_year, endmonth, round(avg(value), 5) AS value FROM e GROUP BY ALL""")
def season_means_overlapping(spark, sf_dir):
    return M.by_seasons(season_rows(spark, sf_dir), ["region"], ["value"]).withColumn("value", F.round("value", 5))


@query(f"""WITH {OBS_SQL}, c AS (SELECT y, x, count(dsqp) AS ncap, sum(dsqp) AS captot, avg(dsqp) AS caprate, count(DISTINCT tid) AS ncyc, count(tid) AS hcyc, avg(lat) AS uv FROM obs GROUP BY y, x)
 SELECT y, x, ncap, {near('captot')} AS captot, {near('caprate')} AS caprate, ncyc, hcyc, {near('uv')} AS uv, {near('1/uv')} AS uvinv, {near('captot - ncyc*caprate*(hcyc/ncyc)')} AS capresid FROM c""")
def cap_decomposition(spark, sf_dir):
    cells = obs(spark, sf_dir).select("y", "x", F.col("dsqp").alias("cap"), F.col("tid").alias("sid"), F.col("lat").alias("uv"))
    return rounded(C.cap_decomposition(cells), "y", "x", digits=4, shift=SHIFT)


@query(f"WITH {MONTH_SQL} SELECT region, year, month, round(CASE WHEN mean > 150000 THEN total END/nullif(total, 0), 6) AS share FROM mo")
def cyclone_share(spark, sf_dir):
    part = F.when(F.col("mean") > 150000, F.col("total"))
    return months(spark, sf_dir).select("region", "year", "month", F.round(C.cyclone_share(part, F.col("total")), 6).alias("share"))


@query(f"""WITH {FIELD_SQL}, m AS (SELECT y, x, CASE WHEN t % 5 <> 0 THEN v END AS v FROM field) SELECT y, x, round(avg(v), 9) AS mean, round(sum(v), 9) AS total, count(*) > count(v) AS incomplete FROM m GROUP BY y, x""")
def array_means(spark, sf_dir):
    rows = field(spark, sf_dir).withColumn("v", F.when(F.col("t") % 5 != 0, F.col("v")).otherwise(float("nan")))
    made = rows.groupBy("y", "x").agg(mean_ignoring_missing(F.col("v")).alias("mean"), sum_ignoring_missing(F.col("v")).alias("total"), F.max(F.isnan("v")).alias("incomplete"))
    return rounded(made, "y", "x", digits=9)


@query(f"""WITH RECURSIVE {OBS_SQL}, v AS (SELECT tid, lon + 180 AS v, row_number() OVER (PARTITION BY tid ORDER BY lon DESC, time) AS i FROM obs),
 f(tid, i, mean) AS (SELECT tid, i, CAST(v AS DOUBLE) FROM v WHERE i = 1 UNION ALL
  SELECT tid, i, CASE WHEN m < 0 THEN 360 + m WHEN m > 360 THEN m - 360 ELSE m END FROM (SELECT v.tid, v.i, f.mean*(v.i - 1)/v.i + (CASE WHEN (f.mean - v.v)/360 < 0.5e0 THEN v.v ELSE v.v + 360 END)/v.i AS m FROM f JOIN v ON v.tid = f.tid AND v.i = f.i + 1))
 SELECT tid, round(CASE WHEN mean = 0 THEN 360 ELSE mean END, 6) AS mean FROM (SELECT tid, arg_max(mean, i) AS mean FROM f GROUP BY tid)""")
def circular_mean(spark, sf_dir):
    return obs(spark, sf_dir).groupBy("tid").agg(F.round(mean_circular(F.collect_list(F.col("lon") + 180), 0.0, 360.0), 6).alias("mean"))


@query(f"WITH {FIELD_SQL} " + "SELECT y, x, CAST(regr_count(v, t) AS BIGINT) AS n, CASE WHEN count(*) >= 10 THEN round(regr_slope(v, t), 9) END AS trend, CASE WHEN count(*) >= 10 THEN round(regr_r2(v, t), 8) END AS r2 FROM field GROUP BY y, x")
def field_trend(spark, sf_dir):
    made = trend(field(spark, sf_dir), ["y", "x"], "t", "v", 10)
    return made.select("y", "x", "n", F.round("trend", 9).alias("trend"), F.round("r2", 8).alias("r2"))
