"""The registered queries of the engine and their SQL."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from .functions.indices import INDICES, Index, list_vi
from .functions.safe import divide
from .operators import fuse, panels, plots, qc, rank, segment, temporal, views, zonal
from .operators.components import label_cells
from .operators.resample import Grid, resample
from .operators.stack import VIStack, compute_vi, field_means
from .operators.stencil import sobel
from .plans import fixtures as fx

QUERIES: dict = {}
ORACLE_SQL: dict[str, str] = {}

PX4_CTE = f"px4 AS ({fx.PX4_SQL.format(lineitem='lineitem')}), px4n AS (SELECT flight, flight_date, y, x, green, red, rededge, {fx.PX4N_NIR} AS nir FROM px4)"
VI_CTE = f"{PX4_CTE}, vi AS (SELECT flight, flight_date, y, x, greatest(-1, least(1, (nir - red) / (nir + red))) AS v FROM px4), vin AS (SELECT flight, flight_date, y, x, CASE WHEN nir IS NOT NULL THEN greatest(-1, least(1, (nir - red) / (nir + red))) END AS v FROM px4n)"
PLOT_SQL = "CAST(floor(y / 5) * 4 + floor(x / 5) + 1 AS INT)"
TRUTH_CTE = f"n_plots AS (SELECT max({PLOT_SQL}) AS n FROM px4), n4 AS (SELECT 4 * ((max(y) // 5) + 1) AS n FROM px4), gt AS (SELECT o_orderkey AS seq, printf('P%03d', CAST(o_custkey % (SELECT n FROM n4) + 1 AS INT)) AS plot_id, make_date(2024, CAST(month(o_orderdate) AS INT), CAST(day(o_orderdate) AS INT)) AS gdate, o_totalprice AS trait FROM orders)"


def rd(sql: str, digits: int = 9) -> str:
    return f"round({sql}, {digits}) + 0.0"


def rounded(df: DataFrame, digits: int = 9) -> DataFrame:
    """Doubles to so many places: engines add up in different orders."""
    return df.select(*[(F.round(c, digits) + 0.0).alias(c) if t == "double" else F.col(c) for c, t in df.dtypes])


def query(sql: str | None = None, digits: int = 9):
    def add(f):
        QUERIES[f.__name__] = lambda spark, sf_dir: rounded(f(spark, sf_dir), digits)
        if sql:
            ORACLE_SQL[f.__name__] = sql
        return f

    return add


def ndvi(spark: SparkSession, sf_dir: str, nulls: bool = False) -> VIStack:
    return compute_vi(fx.px4(spark, sf_dir, nulls), "NDVI")


def flagship(spark: SparkSession, sf_dir: str) -> DataFrame:
    """Mean seasonal NDVI integral per plot."""
    auc = fx.located(temporal.integrate_season(ndvi(spark, sf_dir)))
    return rounded(auc.groupBy("plot_id").agg(F.avg("auc").alias("mean_auc"), F.count("auc").alias("n_pixels")))


# Stacks and indices


@query(f"WITH {PX4_CTE} SELECT flight, flight_date, CAST(NULL AS VARCHAR) AS bbch, 4 AS n_bands, max(y) + 1 AS n_row, max(x) + 1 AS n_col FROM px4 GROUP BY ALL")
def stack_summary(spark, sf_dir):
    return fx.px4(spark, sf_dir).summary()


@query("SELECT * FROM (VALUES " + ", ".join(f"('{k}', '{v.desc}', '{', '.join(f'{x:g}' for x in sorted(v.bands.values()))}', CAST({v.tol} AS DOUBLE))" for k, v in INDICES.items()) + ") AS t(name, description, wavelengths, tolerance)")
def vi_catalogue(spark, sf_dir):
    return list_vi(spark)


@query(f"WITH {PX4_CTE} SELECT flight, y, x, {rd('green')} AS green, {rd('red')} AS red, {rd('rededge')} AS rededge, {rd('nir')} AS nir FROM px4 WHERE flight IN (2, 5)")
def stack_subset(spark, sf_dir):
    s = fx.px4(spark, sf_dir)[[1, 4]]
    return s.pixels.select((F.col("flight") * 3 - 1).alias("flight"), "y", "x", *s.bands)


def _register_vi() -> None:
    """vi_<index> for every index, on the four-band view where its bands are there, else on spectra."""
    e = lambda nm: f"((CAST(embedding[{(nm - 400) // 10 + 1}] AS DOUBLE) + 1) / 2)"
    four = {"NDVI": "(nir - red) / (nir + red)", "NDRE": "(nir - rededge) / (nir + rededge)", "GNDVI": "(nir - green) / (nir + green)"}
    many = {
        "VARI": f"({e(550)} - {e(670)}) / nullif({e(550)} + {e(670)} - {e(480)}, 0)",
        "MCARI": f"(({e(700)} - {e(670)}) - 0.2 * ({e(700)} - {e(550)})) * ({e(700)} / nullif({e(670)}, 0))",
        "mNDVI705": f"({e(750)} - {e(700)}) / nullif({e(750)} + {e(700)} - 2 * {e(440)}, 0)",
        "LCI": f"({e(850)} - {e(710)}) / nullif({e(850)} + {e(670)}, 0)",
        "CRI1": f"1 / nullif({e(510)}, 0) - 1 / nullif({e(550)}, 0)",
        "WBI": f"{e(900)} / nullif({e(970)}, 0)",
        "PSRI": f"({e(680)} - {e(500)}) / nullif({e(750)}, 0)",
    }
    clip = lambda k, v: f"CASE WHEN ({v}) IS NOT NULL THEN greatest(-1, least(1, {v})) END" if INDICES[k].clamped else v
    for name in INDICES:
        source = fx.px4 if name in four else fx.px64
        q = f"vi_{name.lower()}"
        QUERIES[q] = lambda spark, sf_dir, n=name, f=source: rounded(compute_vi(f(spark, sf_dir), n).pixels.select("flight_date", "y", "x", F.col(n).alias("vi")))
        if name in four:
            ORACLE_SQL[q] = f"WITH {PX4_CTE} SELECT flight_date, y, x, {rd(clip(name, four[name]))} AS vi FROM px4"
        else:
            ORACLE_SQL[q] = f"SELECT DATE '2024-03-01' + CAST(21 * label AS INT) AS flight_date, CAST(floor(n / 5) AS INT) AS y, CAST(n % 5 AS INT) AS x, {rd(clip(name, many[name]))} AS vi FROM (SELECT *, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM embeddings) AS t"


_register_vi()


@query(f"WITH {PX4_CTE} SELECT flight_date, y, x, {rd('(nir - red) / (nir + red + 0.5)')} AS vi FROM px4")
def vi_custom_savi(spark, sf_dir):
    savi = Index({"nir": 800, "red": 670}, 30, lambda c: divide(c["nir"] - c["red"], c["nir"] + c["red"] + 0.5), "soil adjusted")
    return compute_vi(fx.px4(spark, sf_dir), (), savi).pixels.select("flight_date", "y", "x", F.col("CUSTOM").alias("vi"))


@query(f"""WITH {PX4_CTE}, m AS (SELECT flight_date, avg((nir - red) / (nir + red)) AS NDVI, avg((nir - green) / (nir + green)) AS GNDVI FROM px4 GROUP BY 1)
SELECT flight_date, 'NDVI' AS index, {rd("NDVI")} AS mean_vi FROM m UNION ALL SELECT flight_date, 'GNDVI', {rd("GNDVI")} FROM m""")
def vi_field_mean(spark, sf_dir):
    return field_means(compute_vi(fx.px4(spark, sf_dir), ("NDVI", "GNDVI")))


# Seasons

AUC = "WITH {cte}, sel AS (SELECT * FROM vi WHERE {where}), n AS (SELECT count(DISTINCT flight) AS n, max(flight) AS last FROM sel), p AS (SELECT y, x, flight, v, {time} AS t, lead(v) OVER w AS v2, lead({time}) OVER w AS t2 FROM sel WINDOW w AS (PARTITION BY y, x ORDER BY flight)) SELECT y, x, CASE WHEN count(v) = (SELECT n FROM n) THEN round(sum((v + v2) / 2 * (t2 - t)), 9) + 0.0 END AS auc FROM p GROUP BY y, x"


def auc_sql(where: str = "TRUE", time: str = "flight_date - DATE '2024-01-15'") -> str:
    return AUC.format(cte=VI_CTE, where=where, time=time)


@query(auc_sql())
def auc_trapezoid(spark, sf_dir):
    return temporal.integrate_season(ndvi(spark, sf_dir))


@query(f"""WITH {VI_CTE}, d AS (SELECT flight, flight_date, lead(flight_date) OVER (ORDER BY flight) - flight_date AS gap FROM (SELECT DISTINCT flight, flight_date FROM vi)),
used AS (SELECT y, x, v * gap AS a FROM vi JOIN d USING (flight) WHERE gap IS NOT NULL)
SELECT y, x, CASE WHEN count(a) = (SELECT count(*) FROM d WHERE gap IS NOT NULL) THEN {rd("sum(a)")} END AS auc FROM used GROUP BY y, x""")
def auc_step(spark, sf_dir):
    return temporal.integrate_season(ndvi(spark, sf_dir), method="step")


@query(auc_sql(time="dayofyear(flight_date)"))
def auc_doy(spark, sf_dir):
    return temporal.integrate_season(ndvi(spark, sf_dir), units="doy")


@query(auc_sql("flight_date BETWEEN DATE '2024-04-01' AND DATE '2024-08-15'"))
def auc_dates(spark, sf_dir):
    return temporal.integrate_season(ndvi(spark, sf_dir), date_from=date(2024, 4, 1), date_to=date(2024, 8, 15))


# Of the nearest stages 55 begins on the flight of April and 75 ends on that of October.
@query(auc_sql("flight_date BETWEEN DATE '2024-04-15' AND DATE '2024-10-15'"))
def auc_bbch(spark, sf_dir):
    stack = temporal.phenostage_tag(fx.px4(spark, sf_dir), fx.bbch_obs(spark))
    return temporal.integrate_season(compute_vi(stack, "NDVI"), bbch_from=50, bbch_to=75, stack=stack)


DDT = """WITH {cte}, s AS (SELECT flight, flight_date, y, x, {value} AS v FROM {vi}), d AS (SELECT flight, flight_date AS date_from, lead(flight_date) OVER (ORDER BY flight) AS date_to FROM (SELECT DISTINCT flight, flight_date FROM px4))
SELECT a.y, a.x, CAST(date_from AS VARCHAR) || '_to_' || CAST(date_to AS VARCHAR) AS interval, date_from, date_to, round((b.v - a.v) / ({gap}), 9) + 0.0 AS ddt
FROM s AS a JOIN d ON a.flight = d.flight AND date_to IS NOT NULL LEFT JOIN s AS b ON a.y = b.y AND a.x = b.x AND b.flight = a.flight + 1"""


@query(DDT.format(cte=VI_CTE, value="v", vi="vi", gap="date_to - date_from"))
def derivative_days(spark, sf_dir):
    return temporal.vi_derivative(ndvi(spark, sf_dir))


@query(DDT.format(cte=VI_CTE, value="v", vi="vin", gap="(date_to - date_from) / 7.0"))
def derivative_weeks(spark, sf_dir):
    return temporal.vi_derivative(ndvi(spark, sf_dir, nulls=True), units="weeks")


# The smoothed values are made once, then meet themselves one flight on.
SMOOTH = """WITH {cte}, sm AS MATERIALIZED (SELECT flight, y, x, CASE WHEN count(v) OVER w = least(12, flight + 1) - greatest(1, flight - 1) + 1 THEN sum(v) OVER w / (least(12, flight + 1) - greatest(1, flight - 1) + 1) END AS v
FROM vin WINDOW w AS (PARTITION BY y, x ORDER BY flight RANGE BETWEEN 1 PRECEDING AND 1 FOLLOWING)),
d AS MATERIALIZED (SELECT flight, flight_date AS date_from, lead(flight_date) OVER (ORDER BY flight) AS date_to FROM (SELECT DISTINCT flight, flight_date FROM px4)),
nx AS MATERIALIZED (SELECT flight - 1 AS flight, y, x, v FROM sm)
SELECT a.y, a.x, CAST(date_from AS VARCHAR) || '_to_' || CAST(date_to AS VARCHAR) AS interval, date_from, date_to, round((b.v - a.v) / (date_to - date_from), 9) + 0.0 AS ddt
FROM sm AS a JOIN d USING (flight) LEFT JOIN nx AS b USING (flight, y, x) WHERE date_to IS NOT NULL"""


@query(SMOOTH.format(cte=VI_CTE))
def derivative_smooth(spark, sf_dir):
    return temporal.vi_derivative(ndvi(spark, sf_dir, nulls=True), smoothed=True)


@query("WITH r AS (SELECT interval, avg(ddt) AS rate FROM (" + DDT.format(cte=VI_CTE, value="v", vi="vi", gap="date_to - date_from").replace("round((b.v - a.v) / (date_to - date_from), 9) + 0.0", "(b.v - a.v) / (date_to - date_from)") + f""") GROUP BY 1)
SELECT 'fastest' AS kind, arg_max(interval, rate) AS interval, {rd("max(rate)")} AS rate FROM r UNION ALL SELECT 'slowest', arg_min(interval, rate), {rd("min(rate)")} FROM r""")
def rate_extremes(spark, sf_dir):
    return temporal.rate_extremes(temporal.vi_derivative(ndvi(spark, sf_dir)))


OBS = "obs(seq, d, bbch) AS (VALUES (1, DATE '2024-01-20', '10'), (2, DATE '2024-06-15', '55'), (3, DATE '2024-12-01', '89'), (4, DATE '2024-09-20', '75'), (5, DATE '2024-09-10', '71')), f AS (SELECT DISTINCT flight, flight_date FROM px4)"


@query(f"WITH {PX4_CTE}, {OBS} SELECT flight, flight_date, arg_min(bbch, abs(d - flight_date) * 100 + seq) AS bbch FROM f, obs GROUP BY ALL")
def pheno_nearest(spark, sf_dir):
    return temporal.tag_flights(fx.px4(spark, sf_dir).flights_frame(), fx.bbch_obs(spark))


@query(f"""WITH {PX4_CTE}, {OBS}, n AS (SELECT d, CAST(bbch AS DOUBLE) AS b FROM obs),
p AS (SELECT flight, flight_date, max(d) FILTER (d <= flight_date) AS d1, min(d) FILTER (d >= flight_date) AS d2 FROM f, n GROUP BY ALL),
q AS (SELECT flight, flight_date, coalesce(d1, d2) AS d1, coalesce(d2, d1) AS d2 FROM p)
SELECT flight, flight_date, CAST(CAST(round_even(CASE WHEN d1 = d2 THEN a.b ELSE a.b + (z.b - a.b) * (flight_date - d1) / (d2 - d1) END, 0) AS INT) AS VARCHAR) AS bbch
FROM q JOIN n AS a ON a.d = d1 JOIN n AS z ON z.d = d2""")
def pheno_linear(spark, sf_dir):
    return temporal.tag_flights(fx.px4(spark, sf_dir).flights_frame(), fx.bbch_obs(spark), "linear")


# Plots


def grid_sql(number: str, angle: float = 0.0, dx: float = 0.0, dy: float = 0.0) -> str:
    p = lambda x, y: f"({x}) * cos(radians({angle})) + ({y}) * sin(radians({angle})) + 434825 + {dx}", lambda x, y: f"-({x}) * sin(radians({angle})) + ({y}) * cos(radians({angle})) + 6668735 + {dy}"
    w, n = "(c * 1.3)", "(-r * 2.8)"
    return f"""SELECT printf('P%03d', {number}) AS plot_id, CAST(r + 1 AS INT) AS "row", CAST(c + 1 AS INT) AS col, CAST(2.5 AS DOUBLE) AS area_m2, CAST(1.0 AS DOUBLE) AS quality,
{rd(p[0](w, n), 4)} AS west, {rd(p[1](w, n), 4)} AS north, {rd(p[0](w + " + 1", n + " - 2.5"), 4)} AS east, {rd(p[1](w + " + 1", n + " - 2.5"), 4)} AS south
FROM range(3) AS a(r), range(4) AS b(c)"""


def _grid(spark, **kw) -> DataFrame:
    g = plots.generate_plot_grid(spark, plots.PlotGrid(3, 4, 2.5, 1.0, 434825, 6668735, 0.3, 0.3, **kw))
    return g.select("plot_id", "row", "col", "area_m2", "quality", F.col("ring")[0]["x"].alias("west"), F.col("ring")[0]["y"].alias("north"), F.col("ring")[2]["x"].alias("east"), F.col("ring")[2]["y"].alias("south"))


@query(grid_sql("r * 4 + c + 1"), 4)
def grid_row_major(spark, sf_dir):
    return _grid(spark)


@query(grid_sql("c * 3 + r + 1"), 4)
def grid_col_major(spark, sf_dir):
    return _grid(spark, order="col_major")


@query(grid_sql("r * 4 + CASE WHEN r % 2 = 1 THEN 3 - c ELSE c END + 1"), 4)
def grid_snake(spark, sf_dir):
    return _grid(spark, order="snake")


@query(grid_sql("r * 4 + c + 1", 30.0, -4.9, 8.1), 4)
def grid_rotated(spark, sf_dir):
    return _grid(spark, orientation_deg=30.0, corner="se")


STATS = """SELECT index, flight_date, plot_id, count(v) AS n_pixels, CASE WHEN count(v) >= 5 THEN round(avg(v), 9) + 0.0 END AS mean, CASE WHEN count(v) >= 5 THEN round(stddev_samp(v), 9) + 0.0 END AS sd,
CASE WHEN count(v) >= 5 THEN round(median(v), 9) + 0.0 END AS median, CASE WHEN count(v) >= 5 THEN round(stddev_samp(v) / nullif(avg(v), 0) * 100, 9) + 0.0 END AS cv"""


@query(f"""WITH {VI_CTE}, own AS (SELECT printf('P%03d', {PLOT_SQL}) AS plot_id, flight_date, v FROM vin),
wanted AS (SELECT plot_id, flight_date FROM (SELECT DISTINCT plot_id FROM own), (SELECT DISTINCT flight_date FROM vin)),
u AS (SELECT 'NDVI' AS index, wanted.plot_id, wanted.flight_date, v FROM wanted LEFT JOIN own USING (plot_id, flight_date)) {STATS} FROM u GROUP BY ALL""")
def extract_stats(spark, sf_dir):
    vi = ndvi(spark, sf_dir, nulls=True)
    own = fx.located(vi.pixels)
    return zonal.extract_plot(vi, own, own.select("plot_id"), stats=("mean", "sd", "median", "cv"))


FIELD = Grid(10_000, fx.WIDTH, 0.0, 0.0, 1.0)


def _blocks(spark, sf_dir) -> plots.PlotGrid:
    """Blocks of five by five metres over the whole field."""
    return plots.PlotGrid(fx.n_plots(spark, sf_dir) // (fx.WIDTH // fx.PLOT), fx.WIDTH // fx.PLOT, 5.0, 5.0, 0.0, 0.0)


@query(f"WITH {VI_CTE}, own AS (SELECT printf('P%03d', {PLOT_SQL}) AS plot_id, flight_date, v FROM vi) SELECT plot_id, flight_date, count(v) AS n_pixels, {rd('avg(v)')} AS mean FROM own GROUP BY ALL")
def extract_polygons(spark, sf_dir):
    """The same blocks as polygons, by the binned spatial join."""
    rings = plots.generate_plot_grid(spark, _blocks(spark, sf_dir))
    met = zonal.join_polygons(ndvi(spark, sf_dir).pixels, rings, FIELD)
    return zonal.plot_stats(met, ["plot_id", "flight_date"], "NDVI", min_pixels=1)


@query(f"WITH {PX4_CTE} SELECT flight, y, x, {rd('nir')} AS nir FROM px4 WHERE {PLOT_SQL} % 3 = 1")
def mask_plots(spark, sf_dir):
    """The pixels that every third block holds."""
    rings = plots.generate_plot_grid(spark, _blocks(spark, sf_dir)).where("((row - 1) * 4 + col) % 3 = 1")
    return zonal.mask(fx.px4(spark, sf_dir).pixels.select("flight", "y", "x", "nir"), rings, FIELD)


@query(f"WITH {VI_CTE} SELECT flight_date, CAST(floor(y / 5) + 1 AS INT) AS \"row\", CAST(floor(x / 5) + 1 AS INT) AS col, count(*) AS n_pixels, {rd('avg(v)')} AS mean FROM vi GROUP BY ALL")
def extract_regular_grid(spark, sf_dir):
    """The same blocks in closed form, without a join."""
    met = zonal.join_grid(ndvi(spark, sf_dir).pixels, _blocks(spark, sf_dir), FIELD)
    return zonal.plot_stats(met, ["flight_date", "row", "col"], "NDVI", min_pixels=1)


FUSE = f"""WITH {VI_CTE}, {TRUTH_CTE}, s AS (SELECT flight_date, printf('P%03d', {PLOT_SQL}) AS plot_id, count(v) AS n_pixels, CASE WHEN count(v) >= 5 THEN avg(v) END AS mean FROM vin GROUP BY ALL),
j AS (SELECT s.*, abs(gdate - flight_date) AS lag, trait, row_number() OVER (PARTITION BY s.plot_id, flight_date ORDER BY abs(gdate - flight_date), seq) AS k FROM s {{join}} gt ON gt.plot_id = s.plot_id {{on}})
SELECT plot_id, flight_date, n_pixels, {rd("mean")} AS mean, CAST(lag AS INT) AS date_lag_days, {rd("trait")} AS trait FROM j WHERE k = 1 AND (lag <= 7 {{extra}})"""


def _fused(spark, sf_dir, gt: DataFrame, **kw) -> DataFrame:
    vi = ndvi(spark, sf_dir, nulls=True)
    stats = zonal.plot_stats(fx.located(vi.pixels), ["plot_id", "flight_date"], "NDVI")
    return fuse.fuse_ground(stats, gt, **kw)


@query(FUSE.format(join="JOIN", on="", extra=""))
def fuse_nearest(spark, sf_dir):
    return _fused(spark, sf_dir, fx.truth(spark, sf_dir))


@query(FUSE.format(join="LEFT JOIN", on="AND gt.plot_id <> 'P003'", extra="OR lag IS NULL"))
def fuse_allow_missing(spark, sf_dir):
    return _fused(spark, sf_dir, fx.truth(spark, sf_dir).where("plot_id <> 'P003'"), allow_missing=True)


# Ranking

MEANS = f"""WITH {VI_CTE}, {TRUTH_CTE}, own AS (SELECT printf('P%03d', {PLOT_SQL}) AS plot_id, flight, flight_date, y, x, v FROM vin),
single AS (SELECT plot_id, flight AS i, flight AS j, avg(v) AS v FROM own GROUP BY ALL),
fl AS (SELECT DISTINCT flight, flight_date FROM vin), px AS (SELECT DISTINCT plot_id, y, x FROM own),
dense AS (SELECT px.*, fl.flight, fl.flight_date, own.v FROM px CROSS JOIN fl LEFT JOIN own USING (plot_id, y, x, flight)),
cum AS (SELECT *, sum(coalesce((v + pv) / 2 * (flight_date - pd), 0)) OVER w AS c, sum(CAST(v IS NULL AS INT)) OVER w AS nn FROM (SELECT *, lag(v) OVER w2 AS pv, lag(flight_date) OVER w2 AS pd FROM dense WINDOW w2 AS (PARTITION BY y, x ORDER BY flight)) WINDOW w AS (PARTITION BY y, x ORDER BY flight ROWS UNBOUNDED PRECEDING)),
win AS (SELECT a.plot_id, a.flight AS i, b.flight AS j, avg(CASE WHEN b.nn - a.nn + CAST(a.v IS NULL AS INT) = 0 THEN b.c - a.c END) AS v FROM cum AS a JOIN cum AS b ON a.y = b.y AND a.x = b.x AND a.flight < b.flight GROUP BY ALL),
tr AS (SELECT plot_id, avg(trait) AS t FROM gt GROUP BY 1)"""
CORR = "SELECT i, j, round(covar_samp(a, b) / nullif(stddev_samp(a) * stddev_samp(b), 0), 9) + 0.0 AS r, any_value(n_plots) AS n_plots FROM (SELECT i, j, {a} AS a, {b} AS b, n_plots FROM (SELECT *, count(*) OVER (PARTITION BY i, j) AS n_plots FROM {m} JOIN tr USING (plot_id)) WHERE v IS NOT NULL AND t IS NOT NULL) GROUP BY i, j HAVING any_value(n_plots) >= 3"


def _ow(spark, sf_dir, means, method="pearson") -> DataFrame:
    vi = ndvi(spark, sf_dir, nulls=True)
    gt = fx.truth(spark, sf_dir).groupBy("plot_id").agg(F.avg("trait").alias("trait"))
    return rank.correlate(means(vi, fx.located(vi.pixels), "NDVI"), gt, "trait", method).select("i", "j", "r", "n_plots")


@query(MEANS + CORR.format(m="single", a="v", b="t"))
def ow_single_pearson(spark, sf_dir):
    return _ow(spark, sf_dir, rank.single_means)


@query(MEANS + CORR.format(m="win", a="v", b="t"))
def ow_window_pearson(spark, sf_dir):
    return _ow(spark, sf_dir, rank.window_means)


RANKED = "rank() OVER (PARTITION BY i, j ORDER BY {0}) + (count(*) OVER (PARTITION BY i, j, {0}) - 1) / 2.0"


@query(MEANS + CORR.format(m="single", a=RANKED.format("v"), b=RANKED.format("t")))
def ow_spearman(spark, sf_dir):
    return _ow(spark, sf_dir, rank.single_means, "spearman")


@query(MEANS + ", every_w AS (SELECT * FROM single UNION ALL SELECT * FROM win), r AS (" + CORR.format(m="every_w", a="v", b="t").replace("round(", "(").replace(", 9) + 0.0 AS r", ") AS r") + """), fd AS (SELECT DISTINCT flight, flight_date FROM vin)
SELECT CASE WHEN i = j THEN 'single' ELSE 'window' END AS type, a.flight_date AS date_from, b.flight_date AS date_to, round(r, 9) + 0.0 AS r, round(r * r, 9) + 0.0 AS r2, n_plots
FROM r JOIN fd AS a ON a.flight = i JOIN fd AS b ON b.flight = j ORDER BY abs(r) DESC NULLS LAST, CASE WHEN i = j THEN 0 ELSE 1 END, i, j LIMIT 10""")
def ow_top(spark, sf_dir):
    return optimal_window(spark, sf_dir).drop("p_value")


# Two-sided p of Student's t by its finite series; nu degrees of freedom.
P_SQL = """CASE WHEN n < 3 OR r IS NULL THEN NULL ELSE greatest(0, 1 - CASE WHEN nu % 2 = 0
THEN abs(r) * list_sum(list_transform(range(0, nu // 2), lambda k: exp(lgamma(k + 0.5) - lgamma(0.5) - lgamma(k + 1)) * pow(1 - r * r, k)))
ELSE 2 / pi() * (asin(abs(r)) + abs(r) * coalesce(list_sum(list_transform(range(0, (nu - 1) // 2), lambda k: sqrt(pi()) / 2 * exp(lgamma(k + 1) - lgamma(k + 1.5)) * pow(1 - r * r, k + 0.5))), 0)) END) END"""


@query(MEANS + ", every_w AS (SELECT * FROM single UNION ALL SELECT * FROM win), r AS (" + CORR.format(m="every_w", a="v", b="t").replace("round(", "(").replace(", 9) + 0.0 AS r", ") AS r").replace("any_value(n_plots) AS n_plots FROM", "any_value(n_plots) AS n_plots, count(*) AS n, count(*) - 2 AS nu FROM") + f"""), fd AS (SELECT DISTINCT flight, flight_date FROM vin)
SELECT CASE WHEN i = j THEN 'single' ELSE 'window' END AS type, a.flight_date AS date_from, b.flight_date AS date_to, {rd("r")} AS r, {rd("r * r")} AS r2, {rd(P_SQL)} AS p_value, n_plots
FROM r JOIN fd AS a ON a.flight = i JOIN fd AS b ON b.flight = j ORDER BY abs(r) DESC NULLS LAST, CASE WHEN i = j THEN 0 ELSE 1 END, i, j LIMIT 10""")
def optimal_window(spark, sf_dir):
    vi = ndvi(spark, sf_dir, nulls=True)
    gt = fx.truth(spark, sf_dir).groupBy("plot_id").agg(F.avg("trait").alias("trait"))
    return rank.optimal_window(vi, gt, "trait", fx.located(vi.pixels))


@query(MEANS + """, p AS (SELECT i, v AS x, t AS y FROM single JOIN tr USING (plot_id) WHERE v IS NOT NULL)
SELECT CAST(i AS VARCHAR) AS facet, count(*) AS n, round(regr_slope(y, x), 2) + 0.0 AS slope, round(regr_intercept(y, x), 2) + 0.0 AS intercept, round(regr_r2(y, x), 2) + 0.0 AS r2,
round(sqrt((regr_syy(y, x) - regr_slope(y, x) * regr_sxy(y, x)) / (count(*) - 2) / regr_sxx(y, x)), 2) + 0.0 AS se FROM p GROUP BY i""", 2)
def trait_lines(spark, sf_dir):
    vi = ndvi(spark, sf_dir, nulls=True)
    gt = fx.truth(spark, sf_dir).groupBy("plot_id").agg(F.avg("trait").alias("trait"))
    met = rank.single_means(vi, fx.located(vi.pixels), "NDVI").join(gt, "plot_id")
    return views.plot_vi_traits(met, "trait", "v", None, "i")["fit"]


# Quality

LAP = """k(dy, dx, w) AS (VALUES (0, 0, -4.0), (-1, 0, 1.0), (1, 0, 1.0), (0, -1, 1.0), (0, 1, 1.0)),
lap AS (SELECT a.flight, a.y, a.x, sum(w * b.{band}) AS l FROM {px} AS a CROSS JOIN k JOIN {px} AS b ON b.flight = a.flight AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.{band} IS NOT NULL GROUP BY ALL)"""


@query(f"WITH {PX4_CTE}, {LAP.format(band='nir', px='px4n')} SELECT flight, {rd('var_samp(l)')} AS lap_var FROM lap GROUP BY 1")
def qc_laplacian(spark, sf_dir):
    return qc.laplacian_variance(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], "nir")


SAT = """lg AS (UNPIVOT (SELECT flight, green, red, rededge, nir FROM px4n) ON green, red, rededge, nir INTO NAME band VALUE v),
th AS (SELECT flight, band, quantile_cont(CAST(v AS DOUBLE), 0.95) AS threshold FROM lg GROUP BY ALL),
sat AS (SELECT flight, band, any_value(threshold) AS threshold, avg(CAST(v >= threshold AS DOUBLE)) AS frac FROM lg JOIN th USING (flight, band) GROUP BY ALL)"""


@query(f"WITH {PX4_CTE}, {SAT} SELECT flight, band, {rd('threshold', 12)} AS threshold FROM sat", 12)
def qc_thresholds(spark, sf_dir):
    return qc.saturation(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], fx.PX4_BANDS).drop("frac")


@query(f"""WITH {PX4_CTE}, {LAP.format(band="green", px="px4")}, lv AS (SELECT flight, var_samp(l) AS lap_var FROM lap GROUP BY 1)
SELECT CAST(flight AS VARCHAR) AS label, CAST(flight_date AS VARCHAR) AS date, 4 AS n_bands, CAST(any_value(lap_var) < 100 AS BOOLEAN) AS flag_blur,
{rd("(avg(green) + avg(red) + avg(rededge) + avg(nir)) / 4")} AS mean_brightness,
{rd("(stddev_samp(green) / avg(green) + stddev_samp(red) / avg(red) + stddev_samp(rededge) / avg(rededge) + stddev_samp(nir) / avg(nir)) / 4")} AS irradiance_cv, {rd("any_value(lap_var)")} AS lap_var
FROM px4 JOIN lv USING (flight) GROUP BY flight, flight_date""")
def qc_metrics(spark, sf_dir):
    m = qc.flight_metrics(fx.px4(spark, sf_dir).pixels, fx.PX4_BANDS, ["flight", "flight_date"])
    return m.select(F.col("flight").cast("string").alias("label"), F.col("flight_date").cast("string").alias("date"), F.lit(4).alias("n_bands"), (F.col("lap_var") < 100).alias("flag_blur"), "mean_brightness", "irradiance_cv", "lap_var")


@query(f"""WITH {PX4_CTE}, {LAP.format(band="green", px="px4n")}, lv AS (SELECT flight, var_samp(l) AS lap FROM lap GROUP BY 1), {SAT}, sf AS (SELECT flight, avg(frac) AS sat FROM sat GROUP BY 1),
m AS (SELECT flight, flight_date, avg(CAST(green IS NULL AS DOUBLE)) AS nod, (avg(green) + avg(red) + avg(rededge) + avg(nir)) / 4 AS bright,
(stddev_samp(green) / avg(green) + stddev_samp(red) / avg(red) + stddev_samp(rededge) / avg(rededge) + stddev_samp(nir) / avg(nir)) / 4 AS irr FROM px4n GROUP BY ALL),
g AS (SELECT *, nod > 0.1 AS f1, lap < 100 AS f2, irr > 0.15 AS f3, sat > 0.02 AS f4, 100 - 20 * CAST(nod > 0.1 AS INT) - 25 * CAST(lap < 100 AS INT) - 20 * CAST(irr > 0.15 AS INT) - 15 * CAST(sat > 0.02 AS INT) AS score FROM m JOIN lv USING (flight) JOIN sf USING (flight))
SELECT CAST(flight AS VARCHAR) AS label, CAST(flight_date AS VARCHAR) AS date, 4 AS n_bands, {rd("round_even(nod * 100, 1)")} AS nodata_pct, {rd("round_even(bright, 4)")} AS mean_brightness, {rd("round_even(irr, 4)")} AS irradiance_cv,
{rd("round_even(lap, 1)")} AS blur_laplacian, {rd("round_even(sat * 100, 2)")} AS sat_frac_pct, FALSE AS flag_bands, f1 AS flag_nodata, f2 AS flag_blur, f3 AS flag_irradiance, f4 AS flag_saturation,
greatest(0, score) AS overall_score, CASE WHEN score >= 80 THEN 'Accept' WHEN score >= 50 THEN 'Caution' ELSE 'Reject' END AS recommendation FROM g""")
def qc_summary(spark, sf_dir):
    return qc.flight_qc(fx.px4(spark, sf_dir, nulls=True).pixels, fx.PX4_BANDS, qc.QCParams(expected_bands=4), date="flight_date")


# Calibration

BANDS4 = ("green", "red", "rededge", "nir")


def _panels(spark, sf_dir, n: int) -> tuple[DataFrame, DataFrame]:
    """All flights' pixels, and the mean DN of the first n plots of each flight as its panels."""
    px = fx.px4(spark, sf_dir).pixels
    dn = px.withColumn("panel_id", F.format_string("panel_%d", fx.plot_no())).where(F.col("panel_id").isin([f"panel_{k}" for k in range(1, n + 1)]))
    return px, dn.groupBy("flight", "panel_id").agg(*[F.avg(b).alias(b) for b in BANDS4])


def calib_sql(expr: str, n: int) -> str:
    cols = ", ".join(f"CASE WHEN {expr.format(b=b)} IS NOT NULL THEN round(greatest(0, least(1, {expr.format(b=b)})), 9) + 0.0 END AS {b}" for b in BANDS4)
    fit = ", ".join(f"avg({b}) AS {b}" for b in BANDS4)
    coef = ", ".join(f"CASE WHEN max({b}) - min({b}) > 1e-9 THEN regr_slope(known, {b}) END AS g_{b}, CASE WHEN max({b}) - min({b}) > 1e-9 THEN regr_intercept(known, {b}) END AS o_{b}, any_value(known / greatest({b}, 1e-9)) AS k_{b}" for b in BANDS4)
    return f"""WITH {PX4_CTE}, p AS (SELECT flight, {PLOT_SQL} AS plot, {fit} FROM px4 WHERE {PLOT_SQL} <= {n} GROUP BY 1, 2),
c AS (SELECT flight, {coef} FROM (SELECT *, CASE plot WHEN 1 THEN 0.5 ELSE 0.2 END AS known FROM p) GROUP BY 1) SELECT flight, y, x, {cols} FROM px4 JOIN c USING (flight)"""


def _calibrated(spark, sf_dir, known: list[float], **kw) -> DataFrame:
    px, dn = _panels(spark, sf_dir, len(known))
    fit = panels.fit_coefficients(dn, BANDS4, known, key="flight", **kw)
    return panels.apply_coefficients(px, fit, key="flight").select("flight", "y", "x", *BANDS4)


@query(calib_sql("{b} * k_{b}", 1))
def calib_gain_only(spark, sf_dir):
    return _calibrated(spark, sf_dir, [0.5])


@query(calib_sql("{b} * g_{b} + o_{b}", 2))
def calib_empirical_line(spark, sf_dir):
    return _calibrated(spark, sf_dir, [0.5, 0.2])


@query(calib_sql("{b} * g_green + o_green", 2))
def calib_global(spark, sf_dir):
    return _calibrated(spark, sf_dir, [0.5, 0.2], per_band=False)


# Images

def sobel_sql(px: str, v: str) -> str:
    return f"""sk(dy, dx) AS (SELECT * FROM (VALUES (-1), (0), (1)) AS a(dy), (VALUES (-1), (0), (1)) AS b(dx)),
sob AS (SELECT a.flight, a.y, a.x, sum(dy * (2 - abs(dx)) * b.{v}) AS gx, sum(dx * (2 - abs(dy)) * b.{v}) AS gy FROM {px} AS a CROSS JOIN sk JOIN {px} AS b ON b.flight = a.flight AND b.y = a.y + dy AND b.x = a.x + dx WHERE a.{v} IS NOT NULL AND b.{v} IS NOT NULL GROUP BY ALL),
mag AS (SELECT *, sqrt(gx * gx + gy * gy) AS m FROM sob)"""


SOBEL = sobel_sql("px4n", "nir")


@query(f"WITH {PX4_CTE} SELECT flight, y, x, {rd('2 * red / (green + red + rededge + 1e-9) - green / (green + red + rededge + 1e-9) - rededge / (green + red + rededge + 1e-9)')} AS contrast FROM px4")
def contrast_exg(spark, sf_dir):
    return fx.px4(spark, sf_dir).pixels.select("flight", "y", "x", segment.contrast_column(["green", "red", "rededge"]).alias("contrast"))


@query(f"WITH {PX4_CTE}, {SOBEL} SELECT flight, y, x, {rd('gx')} AS gx, {rd('gy')} AS gy, {rd('m')} AS magnitude FROM mag")
def sobel_magnitude(spark, sf_dir):
    return sobel(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], "nir")


def orientation_sql(where: str) -> str:
    return f"""WITH {PX4_CTE}, {SOBEL}, b AS (SELECT flight, greatest(1, ceil((degrees(atan2(gy, gx)) - 180 * floor(degrees(atan2(gy, gx)) / 180)) / 5)) AS bin FROM mag WHERE {where}),
c AS (SELECT flight, bin, count(*) AS n FROM b GROUP BY ALL), t AS (SELECT flight, bin, row_number() OVER (PARTITION BY flight ORDER BY n DESC, bin) AS k FROM c)
SELECT flight, CAST((bin * 5 - 2.5 + 90) - 180 * floor((bin * 5 - 2.5 + 90) / 180) AS DOUBLE) AS orientation_deg FROM t WHERE k = 1"""


@query(orientation_sql("m > 1e-9"))
def orientation_mode(spark, sf_dir):
    return segment.orientation(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], "nir")


@query(orientation_sql("TRUE"))
def orientation_mode_reference(spark, sf_dir):
    return segment.orientation(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], "nir", compat="reference")


KERNEL = segment.kernel(1.0)
def gaps_sql(px: str, v: str) -> str:
    return f"""dim AS (SELECT flight, max(y) + 1 AS nr, max(x) + 1 AS nc FROM {px} GROUP BY 1),
pr AS (SELECT flight, 'y' AS axis, y AS at, sum(coalesce({v}, 0)) / any_value(nc) AS mean FROM {px} JOIN dim USING (flight) GROUP BY flight, y UNION ALL SELECT flight, 'x', x, sum(coalesce({v}, 0)) / any_value(nr) FROM {px} JOIN dim USING (flight) GROUP BY flight, x),
ke(o, w) AS (VALUES {", ".join(f"({k - 3}, {w!r}::DOUBLE)" for k, w in enumerate(KERNEL))}),
sm AS (SELECT a.flight, a.axis, a.at, CASE WHEN count(b.mean) = 7 THEN sum(w * b.mean) ELSE any_value(a.mean) END AS smooth FROM pr AS a CROSS JOIN ke LEFT JOIN pr AS b ON b.flight = a.flight AND b.axis = a.axis AND b.at = a.at + o GROUP BY a.flight, a.axis, a.at),
gl AS (SELECT sm.*, smooth < quantile_cont(smooth, 0.2) OVER (PARTITION BY flight, axis) AS gap FROM sm),
pg AS (SELECT {px}.flight, {px}.y, {px}.x, CAST(r.gap OR c.gap AS INT) AS gap FROM {px} JOIN gl AS r ON r.flight = {px}.flight AND r.axis = 'y' AND r.at = y JOIN gl AS c ON c.flight = {px}.flight AND c.axis = 'x' AND c.at = x)"""


GAPS = gaps_sql("px4n", "nir") + """,
gg AS (SELECT flight, y, x, CAST(m > (avg(m) OVER (PARTITION BY flight)) + (stddev_samp(m) OVER (PARTITION BY flight)) AS INT) AS gap FROM mag)"""


@query(f"WITH {PX4_CTE}, {SOBEL}, {GAPS} SELECT * FROM pg")
def profile_gaps(spark, sf_dir):
    return segment.profile_gaps(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], "nir", 1.0).select("flight", "y", "x", "gap")


@query(f"WITH {PX4_CTE}, {SOBEL}, {GAPS} SELECT * FROM gg")
def gradient_gaps(spark, sf_dir):
    return segment.gradient_gaps(fx.px4(spark, sf_dir, nulls=True).pixels, ["flight"], "nir").drop("magnitude")


@query(f"WITH {PX4_CTE}, {SOBEL}, {GAPS} SELECT flight, y, x, greatest(pg.gap, gg.gap) AS gap FROM pg LEFT JOIN gg USING (flight, y, x)")
def combined_gaps(spark, sf_dir):
    return segment.gap_mask(fx.px4(spark, sf_dir, nulls=True).pixels, "combined", ["flight"], "nir", 1.0).select("flight", "y", "x", "gap")


BRIGHT = f"""WITH RECURSIVE {PX4_CTE}, f AS (SELECT *, (green + red + rededge + nir) / 4 AS b FROM px4),
q AS (SELECT flight, quantile_cont(b, 0.92) - 1e-12 AS low FROM f GROUP BY 1), c AS MATERIALIZED (SELECT f.* FROM f JOIN q USING (flight) WHERE b >= low),
nb AS MATERIALIZED (SELECT a.flight, a.y, a.x, b.y AS y2, b.x AS x2 FROM c AS a, range(-1, 2) AS dy(dy), range(-1, 2) AS dx(dx), c AS b WHERE b.flight = a.flight AND b.y = a.y + dy AND b.x = a.x + dx),
reach(flight, y, x, l) AS (SELECT flight, y, x, CAST(y AS BIGINT) * 4294967296 + x FROM c UNION SELECT nb.flight, nb.y2, nb.x2, r.l FROM reach AS r JOIN nb USING (flight, y, x)),
lb AS (SELECT flight, y, x, min(l) AS label FROM reach GROUP BY ALL)"""


@query(BRIGHT + " SELECT * FROM lb")
def components_8(spark, sf_dir):
    return label_cells(panels.bright_cells(fx.px4(spark, sf_dir).pixels, BANDS4, keys=["flight"]), ["flight"])


PATCHES = BRIGHT + """, p AS (SELECT flight, label, CAST(count(*) AS DOUBLE) AS area_m2, avg(green) AS green, avg(red) AS red, avg(rededge) AS rededge, avg(nir) AS nir FROM lb JOIN c USING (flight, y, x) GROUP BY ALL HAVING count(*) BETWEEN 1 AND 50),
cv AS (SELECT *, (green + red + rededge + nir) / 4 AS brightness, list_aggregate([green, red, rededge, nir], 'stddev_samp') / ((green + red + rededge + nir) / 4) AS cv FROM p),
t AS (SELECT *, round_even(greatest(0, least(1, 1 - cv / 2.0)), 3) AS confidence, round_even(cv, 4) AS spectral_cv FROM cv),
k AS (SELECT *, row_number() OVER (PARTITION BY flight ORDER BY CAST(spectral_cv <= 2 AS INT) DESC, confidence DESC, label) AS k FROM t),
top AS (SELECT *, 'panel_' || k AS panel_id FROM k WHERE k <= 3)"""


def _panels_found(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    px = fx.px4(spark, sf_dir).pixels
    return px, panels.detect_panels(px, BANDS4, FIELD, 3, (1.0, 50.0), flatness=2.0, keys=["flight"])


@query(PATCHES + f" SELECT flight, panel_id, {rd('brightness')} AS brightness, {rd('spectral_cv')} AS spectral_cv, area_m2, {rd('confidence')} AS confidence FROM top")
def panels_detect(spark, sf_dir):
    return _panels_found(spark, sf_dir)[1].drop("mean_dn", "ring", "parts")


@query(PATCHES + " SELECT flight, panel_id, CAST(x AS DOUBLE) AS x, round(v, 9) + 0.0 AS mean_dn FROM (SELECT flight, panel_id, unnest([550.0, 660.0, 735.0, 790.0]) AS x, unnest([green, red, rededge, nir]) AS v FROM top)")
def panel_spectra(spark, sf_dir):
    px, found = _panels_found(spark, sf_dir)
    return views.panel_qc_plot(px, found, list(BANDS4), list(fx.PX4_NM), keys=["flight"])["spectra"]


FINE = Grid(10_000, fx.WIDTH, 0.0, 0.0, 0.1)
CELL = FINE.res**2
# Profile gaps are whole lines, so patches are what lies between two gap rows and two gap columns. Distances
# from an outline are those from the unit sides of its cells, in cells.
SEGMENTED = f"""seg AS (SELECT flight, y, x, green, (nir - red) / (nir + red + 1e-9) AS c FROM px4), {gaps_sql("seg", "c")},
run AS (SELECT *, sum(CAST(gap AS INT)) OVER (PARTITION BY flight, axis ORDER BY gl.at) AS run FROM gl),
bl AS MATERIALIZED (SELECT seg.flight, y, x, c, min(CAST(y AS BIGINT) * 4294967296 + x) OVER (PARTITION BY seg.flight, a.run, b.run) AS label
FROM seg JOIN run AS a ON a.flight = seg.flight AND a.axis = 'y' AND a.at = y AND NOT a.gap JOIN run AS b ON b.flight = seg.flight AND b.axis = 'x' AND b.at = x AND NOT b.gap),
patch AS (SELECT flight, label, count(*) * {CELL!r}::DOUBLE AS area_m2, avg(x) AS cx, -avg(y) AS north, min(x) AS x0, min(y) AS y0 FROM bl GROUP BY ALL HAVING count(*) * {CELL!r}::DOUBLE >= 0.05),
span AS (SELECT *, count(*) OVER f AS n, min(cx) OVER f AS cl, max(cx) OVER f AS ch, min(north) OVER f AS nl, max(north) OVER f AS nh FROM patch WINDOW f AS (PARTITION BY flight)),
bin AS (SELECT *, coalesce(greatest(1, least(b, ceil((north - nl) / nullif((nh - nl) / b, 0)))), ceil(b / 2)) AS r, coalesce(greatest(1, least(b, ceil((cx - cl) / nullif((ch - cl) / b, 0)))), ceil(b / 2)) AS col FROM (SELECT *, greatest(2, least(30, n)) AS b FROM span)),
plot AS MATERIALIZED (SELECT *, CAST(max(r) OVER (PARTITION BY flight) + 1 - r AS INT) AS row_idx, CAST(col AS INT) AS col_idx, 'P' || lpad(CAST(row_number() OVER (PARTITION BY flight ORDER BY label) AS VARCHAR), CAST(length(CAST(n AS VARCHAR)) AS INT), '0') AS plot_id FROM bin),
kept AS (SELECT bl.* FROM bl JOIN plot USING (flight, label)),
turn(dy, dx, ey, ex, flat) AS (VALUES (-1, 0, 0, 0, TRUE), (1, 0, 1, 0, TRUE), (0, -1, 0, 0, FALSE), (0, 1, 0, 1, FALSE)),
side AS MATERIALIZED (SELECT a.flight, a.label, a.y + ey AS ey, a.x + ex AS ex, flat FROM kept AS a CROSS JOIN turn LEFT JOIN kept AS b ON b.flight = a.flight AND b.label = a.label AND b.y = a.y + dy AND b.x = a.x + dx WHERE b.x IS NULL),
near AS MATERIALIZED (SELECT side.flight, side.label, seg.y, seg.x, {FINE.res!r}::DOUBLE * min(CASE WHEN flat THEN sqrt(pow(greatest(ex - seg.x - 0.5, 0, seg.x + 0.5 - ex - 1), 2) + pow(seg.y + 0.5 - ey, 2)) ELSE sqrt(pow(greatest(ey - seg.y - 0.5, 0, seg.y + 0.5 - ey - 1), 2) + pow(seg.x + 0.5 - ex, 2)) END) AS dist
FROM side, range(-3, 4) AS dy(dy), range(-3, 4) AS dx(dx), seg WHERE seg.flight = side.flight AND seg.y = ey + dy AND seg.x = ex + dx GROUP BY ALL)"""


def _segmented(spark, sf_dir) -> tuple[DataFrame, DataFrame]:
    px = fx.px4(spark, sf_dir).pixels
    return px, segment.segment_plots(px, BANDS4, FINE, fx.PX4_NM, sigma=1.0, min_area_m2=0.05, keys=["flight"])


@query(f"""WITH {PX4_CTE}, {SEGMENTED},
gf AS (SELECT flight, label, avg(gap) AS gap_frac FROM near JOIN pg USING (flight, y, x) WHERE dist <= 0.2 GROUP BY ALL),
inn AS (SELECT kept.flight, kept.label, avg(c) AS v FROM kept LEFT JOIN near USING (flight, label, y, x) WHERE coalesce(dist, 9) >= 0.1 GROUP BY ALL)
SELECT flight, plot_id, row_idx, col_idx, {rd("area_m2")} AS area_m2, {rd("area_m2")} AS ring_area_m2,
CASE WHEN gap_frac IS NULL OR v IS NULL THEN 0.5 ELSE {rd("round_even(greatest(0, least(1, 0.5 * least(gap_frac * 2, 1) + 0.5 * least(v + 0.5, 1))), 3)")} END AS quality
FROM plot LEFT JOIN gf USING (flight, label) LEFT JOIN inn USING (flight, label)""")
def segment_plots(spark, sf_dir):
    return segment.outlines(_segmented(spark, sf_dir)[1]).drop("ring", "parts")


@query(f"""WITH {PX4_CTE}, {SEGMENTED}, {sobel_sql("seg", "green")}, lim AS (SELECT flight, min(m) AS lo, max(m) AS hi FROM mag GROUP BY 1),
edge AS (SELECT flight, y, x FROM mag JOIN lim USING (flight) WHERE (m - lo) / (hi - lo + 1e-9) >= 0.2),
ce AS (SELECT flight, label, count(*) AS n, avg((x + 0.5) * {FINE.res!r}::DOUBLE) AS ex, -avg((y + 0.5) * {FINE.res!r}::DOUBLE) AS ey FROM near JOIN edge USING (flight, y, x) WHERE dist <= 0.3 GROUP BY ALL),
d AS (SELECT p.flight, plot_id, x0, y0, ce.n, ex - (cx + 0.5) * {FINE.res!r}::DOUBLE AS dx, ey - (north - 0.5) * {FINE.res!r}::DOUBLE AS dy FROM plot AS p LEFT JOIN ce ON ce.flight = p.flight AND ce.label = p.label),
m AS (SELECT *, CASE WHEN n >= 4 THEN least(sqrt(dx * dx + dy * dy), 0.3) ELSE 0 END AS moved, CASE WHEN n >= 4 THEN coalesce(least(sqrt(dx * dx + dy * dy), 0.3) / nullif(sqrt(dx * dx + dy * dy), 0), 0) ELSE 0 END AS k FROM d)
SELECT flight, plot_id, round(x0 * {FINE.res!r}::DOUBLE + coalesce(dx * k, 0), 9) + 0.0 AS west, round(-y0 * {FINE.res!r}::DOUBLE + coalesce(dy * k, 0), 9) + 0.0 AS north, round(round_even(moved, 3), 9) + 0.0 AS shift_m FROM m""")
def refine_plot_boundaries(spark, sf_dir):
    px, found = _segmented(spark, sf_dir)
    moved = segment.refine_plot_boundaries(found, px, "green", FINE, keys=["flight"])
    return moved.select("flight", "plot_id", F.array_min(F.transform("ring", lambda p: p["x"])).alias("west"), F.array_max(F.transform("ring", lambda p: p["y"])).alias("north"), "shift_m")


@query(f"""WITH {PX4_CTE}, n AS (SELECT CAST(floor((max(y) + 1) / 1.5) + 1 AS BIGINT) AS n FROM px4), t AS (SELECT CAST(v AS INT) AS y, CAST(u AS INT) AS x, 0.25 + (u + 0.5) * 1.5 - 0.5 AS sx, 0.5 + (v + 0.5) * 1.5 - 0.5 AS sy FROM (SELECT unnest(range(n)) AS v FROM n), range(13) AS b(u)),
k AS (SELECT * FROM (VALUES (0), (1)) AS a(dy), (VALUES (0), (1)) AS b(dx)),
j AS (SELECT flight, t.y, t.x, nir, (1 - abs(sx - px4.x)) * (1 - abs(sy - px4.y)) AS w FROM t CROSS JOIN k JOIN px4 ON px4.y = floor(sy) + dy AND px4.x = floor(sx) + dx)
SELECT flight, y, x, CASE WHEN abs(sum(w) - 1) < 1e-6 THEN {rd("sum(w * nir)", 12)} END AS nir FROM j WHERE w > 0 GROUP BY ALL""", 12)
def resample_bilinear(spark, sf_dir):
    """All flights on cells of one and a half metres over the whole field."""
    n_row = 5 * _blocks(spark, sf_dir).n_row
    px = fx.px4(spark, sf_dir).pixels.select("flight", "y", "x", "nir")
    return resample(px, FIELD, Grid(int(n_row / 1.5) + 1, 13, 0.25, -0.5, 1.5), ["nir"], ["flight"])


@query(f"WITH {VI_CTE}, d AS (SELECT plot_id, avg(auc) AS a, count(auc) AS n FROM (SELECT printf('P%03d', {PLOT_SQL}) AS plot_id, auc FROM ({auc_sql().replace('WITH ' + VI_CTE + ',', 'WITH').replace('round(sum((v + v2) / 2 * (t2 - t)), 9) + 0.0', 'sum((v + v2) / 2 * (t2 - t))')})) GROUP BY 1) SELECT plot_id, {rd('a')} AS mean_auc, n AS n_pixels FROM d")
def plot_season_means(spark, sf_dir):
    return flagship(spark, sf_dir)
