"""Views over the driver's tables that stand for the engine's inputs."""

from __future__ import annotations

from pyspark.sql import DataFrame, SparkSession
from pyspark.sql import functions as F

from claimlab.functions.ordering import densify
from claimlab.operators import panel as P


def read(spark: SparkSession, sf_dir: str, name: str) -> DataFrame:
    return spark.read.parquet(f"{sf_dir}/{name}.parquet")


def close_panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, market, close: monthly order value by market segment, dense."""
    orders = read(spark, sf_dir, "orders").select("o_custkey", F.trunc("o_orderdate", "month").alias("date"), "o_totalprice")
    customers = read(spark, sf_dir, "customer").select(F.col("c_custkey").alias("o_custkey"), F.col("c_mktsegment").alias("market"))
    return densify(orders.join(customers, "o_custkey").groupBy("date", "market").agg(F.sum("o_totalprice").alias("close")))


def panel(spark: SparkSession, sf_dir: str) -> DataFrame:
    """... with returns and rolling volatility."""
    return P.realised_vol(P.market_returns(close_panel(spark, sf_dir)))


def stream(spark: SparkSession, sf_dir: str) -> DataFrame:
    return read(spark, sf_dir, "events").select("ts", "event_id", F.col("value").alias("score"), (F.col("event_type") == "purchase").cast("int").alias("label"))


def series(spark: SparkSession, sf_dir: str) -> DataFrame:
    """date, ret (strategy), passive, xs: three aligned return series, from one pass over
    the panel."""
    p = panel(spark, sf_dir)
    kinds = {"ret": P.tsmom_positions, "passive": P.passive_positions, "xs": P.xsmom_positions}
    for name, positions in kinds.items():
        p = positions(p).withColumnRenamed("position", f"p_{name}").drop("trailing", "rank", "pct")
    held = p.select("date", *[(F.lag(f"p_{k}").over(P.by_market()) * F.col("ret")).alias(f"c_{k}") for k in kinds])
    return held.groupBy("date").agg(*[F.avg(f"c_{k}").alias(k) for k in kinds]).dropna()


def trades(spark: SparkSession, sf_dir: str) -> DataFrame:
    """A ledger from line items: list price in, sale price out, ten-thousand budget."""
    lines = read(spark, sf_dir, "lineitem").select("l_orderkey", "l_linenumber", "l_partkey", "l_suppkey", "l_shipdate", "l_returnflag", "l_discount", (F.col("l_extendedprice") / F.nullif(F.col("l_quantity"), F.lit(0.0))).alias("s_out"))
    parts = read(spark, sf_dir, "part").select(F.col("p_partkey").alias("l_partkey"), F.col("p_retailprice").alias("s_in"), "p_brand", "p_size")
    return lines.join(parts, "l_partkey")
