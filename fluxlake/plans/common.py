"""Tables, rounding and SQL fragments shared by the registered queries."""

from __future__ import annotations

from pyspark.sql import Column, DataFrame, SparkSession
from pyspark.sql import functions as F

from fluxlake.session import prepare
from fluxlake.sources.observations import observations, scan

DIGITS = 6
EVENT_CHANNELS = ["click", "error", "purchase", "signup", "view"]


def table(spark: SparkSession, sf_dir: str, name: str, columns: list[str]) -> DataFrame:
    return scan(prepare(spark), f"{sf_dir}/{name}.parquet", columns)


def event_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``events`` as samples of five series: event type = series, value = flux."""
    raw = table(spark, sf_dir, "events", ["event_id", "ts", "event_type", "value"])
    return observations(raw, "ts", "value", "event_type", {"event_id": F.col("event_id")})


def order_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``orders`` as a long history of three series: order status = series, price = flux."""
    raw = table(spark, sf_dir, "orders", ["o_orderkey", "o_orderdate", "o_orderstatus",
                                          "o_totalprice"])
    return observations(raw, "o_orderdate", "o_totalprice", "o_orderstatus",
                        {"order_id": F.col("o_orderkey")})


def line_obs(spark: SparkSession, sf_dir: str) -> DataFrame:
    """``lineitem`` as a dense history: return flag = series, extended price = flux."""
    raw = table(spark, sf_dir, "lineitem", ["l_shipdate", "l_returnflag", "l_extendedprice"])
    return observations(raw, "l_shipdate", "l_extendedprice", "l_returnflag")


def rnd(col: str | Column, digits: int = DIGITS) -> Column:
    """Rounded for comparison, with negative zero folded into zero."""
    c = F.col(col) if isinstance(col, str) else col
    return F.round(c.cast("double"), digits) + F.lit(0.0)


def rounded(df: DataFrame, cols: list[str], digits: int = DIGITS) -> DataFrame:
    return df.select(*[rnd(c, digits).alias(c) if c in cols else F.col(c) for c in df.columns])


def stamp(col: str | Column) -> Column:
    """Time as text, so that both engines print it alike."""
    return F.date_format(col, "yyyy-MM-dd HH:mm:ss")


# ---- SQL counterparts -------------------------------------------------------------------------

def r(expr: str, alias: str | None = None, digits: int = DIGITS) -> str:
    text = f"(round(CAST({expr} AS DOUBLE), {digits}) + 0.0)"
    return f"{text} AS {alias}" if alias else text


def ts(expr: str, alias: str) -> str:
    return f"strftime({expr}, '%Y-%m-%d %H:%M:%S') AS {alias}"


def bin_of(time: str, minutes: int) -> str:
    return f"CAST(floor(epoch({time}) / {minutes * 60}) AS BIGINT)"


def bin_start(index: str, minutes: int) -> str:
    return f"CAST(make_timestamp(({index}) * {minutes * 60_000_000}) AS TIMESTAMP)"


def term_sql(time: str) -> str:
    return (f"(CAST(year({time}) AS VARCHAR) || CASE WHEN month({time}) <= 6 THEN '-H1' "
            f"ELSE '-H2' END)")


EVENT_OBS = ("SELECT ts AS t, event_type AS series, value AS v, event_id AS id FROM events "
             "WHERE ts IS NOT NULL")
ORDER_OBS = ("SELECT CAST(o_orderdate AS TIMESTAMP) AS t, o_orderstatus AS series, "
             "o_totalprice AS v, o_orderkey AS id FROM orders WHERE o_orderdate IS NOT NULL")
LINE_OBS = ("SELECT CAST(l_shipdate AS TIMESTAMP) AS t, l_returnflag AS series, "
            "l_extendedprice AS v FROM lineitem WHERE l_shipdate IS NOT NULL")


def bins_sql(obs: str, minutes: int, transform: str = "none", min_count: int = 1) -> str:
    """SELECT giving (series, idx, n, value) of binned means."""
    mean = f"CASE WHEN count(v) >= {min_count} THEN avg(v) END"
    if transform == "log10":
        mean = f"CASE WHEN count(v) >= {min_count} AND avg(v) > 0 THEN log10(avg(v)) END"
    return (f"SELECT series, {bin_of('t', minutes)} AS idx, count(v) AS n, {mean} AS value "
            f"FROM ({obs}) GROUP BY 1, 2")
