"""Views of the test tables as flights, plots and ground truth."""

from __future__ import annotations

from datetime import date

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from ..operators.stack import FlightStack, stack_table

PX4_BANDS, PX4_NM = ("green", "red", "rededge", "nir"), (550.0, 660.0, 735.0, 790.0)
PX64_NM = tuple(400.0 + 10 * k for k in range(64))
WIDTH, PLOT = 20, 5

#: The same text for both engines: a grid of 20 columns per month of shipping.
PX4_SQL = """
SELECT CAST(m AS INT) AS flight, make_date(2024, CAST(m AS INT), 15) AS flight_date,
       CAST(floor(n / 20) AS INT) AS y, CAST(n % 20 AS INT) AS x,
       0.05 + l_tax AS green, 0.02 + l_discount AS red, 0.20 + l_quantity / 250.0 AS rededge, 0.30 + l_extendedprice / 200000.0 AS nir
FROM (SELECT *, month(l_shipdate) AS m,
             row_number() OVER (PARTITION BY month(l_shipdate) ORDER BY l_orderkey, l_linenumber, l_partkey,
               l_suppkey, l_shipdate, l_quantity, l_extendedprice, l_discount, l_tax) - 1 AS n FROM {lineitem}) AS t
"""
PX4N_NIR = "CASE WHEN (flight * 31 + y * 7 + x) % 17 <> 0 THEN nir END"


def table(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def months(spark: SparkSession, sf_dir: str) -> list[date]:
    rows = table(spark, sf_dir, "lineitem").select(F.month("l_shipdate").alias("m")).distinct().collect()
    return [date(2024, r["m"], 15) for r in rows if r["m"]]


def px4(spark: SparkSession, sf_dir: str, nulls: bool = False) -> FlightStack:
    pixels = spark.sql(PX4_SQL, lineitem=table(spark, sf_dir, "lineitem"))
    if nulls:
        pixels = pixels.withColumn("nir", F.expr(PX4N_NIR))
    return stack_table(pixels, PX4_BANDS, PX4_NM, dates=months(spark, sf_dir))


def px64(spark: SparkSession, sf_dir: str) -> FlightStack:
    """Embeddings as spectra: a flight per label, five columns."""
    bands = [f"b{k}" for k in range(64)]
    rows = spark.sql("SELECT label, embedding, row_number() OVER (PARTITION BY label ORDER BY vec_id) - 1 AS n FROM {e}", e=table(spark, sf_dir, "embeddings"))
    when = F.date_add(F.lit(date(2024, 3, 1)), (21 * F.col("label")).cast("int"))
    cols = [((F.element_at("embedding", k + 1).cast("double") + 1) / 2).alias(b) for k, b in enumerate(bands)]
    pixels = rows.select(F.floor(F.col("n") / 5).cast("int").alias("y"), (F.col("n") % 5).cast("int").alias("x"), when.alias("flight_date"), *cols)
    return stack_table(pixels, bands, PX64_NM)


def plot_no() -> F.Column:
    return (F.floor(F.col("y") / PLOT) * (WIDTH // PLOT) + F.floor(F.col("x") / PLOT) + 1).cast("int")


def located(pixels: DataFrame) -> DataFrame:
    """pixels with plot_id: blocks of five by five."""
    return pixels.withColumn("plot_id", F.format_string("P%03d", plot_no()))


def n_plots(spark: SparkSession, sf_dir: str) -> int:
    """The plots of the largest flight."""
    most = table(spark, sf_dir, "lineitem").groupBy(F.month("l_shipdate")).count().agg(F.max("count")).first()[0] or 0
    return -(-(-(-most // WIDTH)) // PLOT) * (WIDTH // PLOT)


def truth(spark: SparkSession, sf_dir: str) -> DataFrame:
    """seq, plot_id, date, trait from orders."""
    n = n_plots(spark, sf_dir)
    o = table(spark, sf_dir, "orders")
    plot = F.format_string("P%03d", (F.col("o_custkey") % n + 1).cast("int"))
    day = F.make_date(F.lit(2024), F.month("o_orderdate"), F.dayofmonth("o_orderdate"))
    return o.select(F.col("o_orderkey").alias("seq"), plot.alias("plot_id"), day.alias("date"), F.col("o_totalprice").alias("trait"))


def bbch_obs(spark: SparkSession) -> DataFrame:
    """Observations of growth stages; the last two are equally far from the flight of 15 September."""
    rows = [(1, date(2024, 1, 20), "10"), (2, date(2024, 6, 15), "55"), (3, date(2024, 12, 1), "89"), (4, date(2024, 9, 20), "75"), (5, date(2024, 9, 10), "71")]
    return spark.createDataFrame(rows, "seq int, date date, bbch string")
